"""Registered collections and the signature of the models they were built with."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession

from lodestar.schemas import COLLECTIONS
from lodestar.sources.files import Files

MOST_COLLECTIONS, LONGEST_NAME = 4, 64
NAME = re.compile(r"[a-zA-Z0-9][a-zA-Z0-9_-]*")


class Catalog:
    """Collections of one home folder, kept as JSON and offered as a DataFrame."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark = spark
        self.path = os.path.join(home, "collections.json")
        self.signature_path = os.path.join(home, "signature.json")

        self.files = Files(spark)

    def _load(self, path: str, default):
        text = self.files.read(path)
        return default if text is None else json.loads(text)

    def _save(self, path: str, value) -> None:
        self.files.replace(path, json.dumps(value, indent=2))

    def all(self) -> dict[str, dict]:
        return self._load(self.path, {})

    def table(self) -> DataFrame:
        rows = [(n, c["folder_path"], c["ignore_patterns"], c["ignore_extensions"]) for n, c in self.all().items()]
        return self.spark.createDataFrame(rows, COLLECTIONS)

    def get(self, name: str) -> dict:
        if (found := self.all().get(name)) is None:
            raise KeyError(f"no such collection: {name}")
        return found

    def _check(self, name: str, folder: str) -> None:
        have = self.all()
        rules = (
            (bool(name), "name is empty"),
            (len(name) <= LONGEST_NAME, f"name is longer than {LONGEST_NAME} characters"),
            (bool(NAME.fullmatch(name)), "name may hold letters, digits, _ and -, and begins with a letter or digit"),
            (name in have or len(have) < MOST_COLLECTIONS, f"there are {MOST_COLLECTIONS} collections already"),
            (name not in have, "name is taken"),
            (all(c["folder_path"] != folder for c in have.values()), "folder is taken"),
        )
        for holds, message in rules:
            if not holds:
                raise ValueError(message)

    def register(self, name: str, folder: str, ignore_patterns: list[str] | None = None, ignore_extensions: list[str] | None = None) -> None:
        self._check(name, folder)
        entry = {"folder_path": folder, "ignore_patterns": list(ignore_patterns or []), "ignore_extensions": [e.lower() for e in ignore_extensions or []]}
        self._save(self.path, self.all() | {name: entry})

    def update(self, name: str, ignore_patterns: list[str] | None = None, ignore_extensions: list[str] | None = None, clear_patterns: bool = False, clear_extensions: bool = False) -> dict:
        """Change the ignore rules; None leaves them, a clear flag goes before a value."""
        entry = dict(self.get(name))
        for key, value, clear in (("ignore_patterns", ignore_patterns, clear_patterns), ("ignore_extensions", ignore_extensions, clear_extensions)):
            if clear:
                entry[key] = []
            elif value is not None:
                entry[key] = [v.lower() for v in value] if key == "ignore_extensions" else list(value)
        self._save(self.path, self.all() | {name: entry})
        return entry

    def unregister(self, name: str) -> None:
        """Nothing happens for an unknown name."""
        self._save(self.path, {n: c for n, c in self.all().items() if n != name})

    def model_changed(self, dense: str, sparse: str) -> tuple[bool, dict | None, dict]:
        """(changed, old, new); the first call saves and reports no change."""
        old, new = self._load(self.signature_path, None), {"dense_model": dense, "sparse_model": sparse}
        if old is None:
            self._save(self.signature_path, new)
        return old is not None and old != new, old, new

    def save_signature(self, dense: str, sparse: str) -> None:
        self._save(self.signature_path, {"dense_model": dense, "sparse_model": sparse})
