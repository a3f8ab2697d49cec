"""Tables written to the shared checkpoint folder, to cut lineage between stages."""

from lodestar.storage import discard, materialise, shared_dir

__all__ = ["discard", "materialise", "shared_dir"]
