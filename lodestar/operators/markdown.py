"""Markdown blocks and heading-aware windows over them.

Each kind of block is one entry of KINDS: a function that, given the lines and a
position, returns the position after the block, or None if no such block begins
there. The first that matches wins; what none claims is a paragraph. Blocks are
state that runs along a document's lines, so this is Python code, run as a
table function over whole documents in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

# The patterns that define the block grammar.
ATX = re.compile(r"^#{1,6}(\s|$)")
LIST_ITEM = re.compile(r"^\s*([-*+•·–—▪▸◦]|\d+[.)]) ")
FENCE = re.compile(r"^(`{3,}|~{3,})")
IMAGE = re.compile(r"^!\[{1,2}[^\]]*\]{1,2}(\([^)]*\))?$")
RULE = re.compile(r"^[-*_](\s*[-*_]){2,}\s*$")
UNDERLINE = re.compile(r"^(=+|-+)\s*$")

BLOCKS_PER_CHUNK, OVERLAP = 4, 1


@dataclass(frozen=True)
class Block:
    kind: str
    text: str


class _Lines:
    def __init__(self, text: str):
        self.raw = text.splitlines()
        self.bare = [line.strip() for line in self.raw]

    def __len__(self) -> int:
        return len(self.raw)

    def until(self, start: int, closes: Callable[[str], bool]) -> int:
        """After the first line from ``start`` on that closes; the end of the text if none does."""
        return next((k + 1 for k in range(start, len(self)) if closes(self.bare[k])), len(self))

    def while_(self, start: int, goes_on: Callable[[str], bool]) -> int:
        return next((k for k in range(start, len(self)) if not goes_on(self.bare[k])), len(self))


def _frontmatter(t: _Lines, i: int) -> int | None:
    return t.until(1, lambda s: s == "---") if i == 0 and t.bare[0] == "---" else None


def _fence(t: _Lines, i: int) -> int | None:
    if not (mark := FENCE.match(t.bare[i])):
        return None
    sign, least = mark[0][0], len(mark[0])
    return t.until(i + 1, lambda s: len(s) >= least and not s.strip(sign))


def _math(t: _Lines, i: int) -> int | None:
    return t.until(i + 1, lambda s: s == "$$") if t.bare[i] == "$$" else None


def _line(pattern: re.Pattern) -> Callable[[_Lines, int], int | None]:
    return lambda t, i: i + 1 if pattern.match(t.bare[i]) else None


def _prefixed(sign: str) -> Callable[[_Lines, int], int | None]:
    return lambda t, i: t.while_(i, lambda s: s.startswith(sign)) if t.bare[i].startswith(sign) else None


def _list(t: _Lines, i: int) -> int | None:
    belongs = lambda k: bool(LIST_ITEM.match(t.bare[k])) or t.raw[k][:1] in (" ", "\t")
    if not LIST_ITEM.match(t.bare[i]):
        return None
    end = i + 1
    while end < len(t):
        # Blank lines are part of the list if it goes on after them.
        after = t.while_(end, lambda s: not s)
        if after == len(t) or not belongs(after):
            break
        end = after + 1
    return end


def _underlined(t: _Lines, i: int) -> int | None:
    return i + 2 if i + 1 < len(t) and UNDERLINE.match(t.bare[i + 1]) else None


KINDS: tuple[tuple[str, Callable[[_Lines, int], int | None]], ...] = (
    ("frontmatter", _frontmatter),
    ("fence", _fence),
    ("math", _math),
    ("heading", _line(ATX)),
    ("table", _prefixed("|")),
    ("quote", _prefixed(">")),
    ("rule", _line(RULE)),
    ("list", _list),
    ("image", _line(IMAGE)),
    ("underlined", _underlined),
)
#: Kinds that end a paragraph; frontmatter and underlined headings don't.
_BREAKS = {"fence", "math", "heading", "table", "quote", "rule", "list", "image"}


def line_kind(bare: str) -> str:
    """Kind of block that a stripped line would begin, "blank" or "text"."""
    if not bare:
        return "blank"
    one = _Lines(bare)
    return next((name for name, ends in KINDS if name in _BREAKS and ends(one, 0)), "text")


def blocks(text: str | None) -> Iterator[Block]:
    """Blocks of a Markdown text in order; each has its lines as they were."""
    t = _Lines(text or "")
    i = 0
    while i < len(t):
        if not t.bare[i]:
            i += 1
            continue
        kind, end = next(((name, e) for name, ends in KINDS if (e := ends(t, i))), ("paragraph", None))
        if end is None:
            end = next((k for k in range(i + 1, len(t)) if not t.bare[k] or line_kind(t.bare[k]) in _BREAKS), len(t))
        yield Block(kind, "\n".join(t.raw[i:end]))
        i = end


def is_heading(block: str) -> bool:
    """By its text: a first line that is a heading, or two lines of which the second underlines."""
    lines = block.strip().splitlines()
    return bool(lines) and bool(ATX.match(lines[0]) or (len(lines) == 2 and UNDERLINE.match(lines[1])))


def windows(heads: list[bool], size: int = BLOCKS_PER_CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Ranges of blocks, given which are headings.

    A window never ends on a heading that has its body next, begins at a
    heading if one is near, and otherwise repeats ``overlap`` blocks.
    """
    n, start = len(heads), 0
    while n:
        end = min(start + size, n)
        if n > size and end < n and heads[end - 1] and not heads[end]:
            end += 1
        yield start, end
        if end >= n:
            return
        if heads[end]:
            start = end
        else:
            again = end - overlap
            start = max(start + 1, next((k for k in range(again, start, -1) if heads[k]), again))


def chunks(text: str | None, size: int = BLOCKS_PER_CHUNK, overlap: int = OVERLAP) -> list[str]:
    found = [b.text for b in blocks(text)]
    return ["\n\n".join(found[a:e]) for a, e in windows([is_heading(b) for b in found], size, overlap)]
