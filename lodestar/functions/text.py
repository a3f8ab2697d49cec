"""Scalar expressions over text, paths and bytes. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORACLE_TOKEN = "[a-z0-9]+"
WORD_TOKEN = r"(?U)\w+"

# Suffixes of files that are read as text.
TEXT_SUFFIXES = (
    ".md", ".markdown", ".txt", ".rst", ".org",
    ".json", ".jsonl", ".yaml", ".yml", ".toml", ".csv", ".tsv", ".xml",
    ".html", ".htm",
    ".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".sh", ".zsh", ".bash", ".fish",
    ".ini", ".cfg", ".conf", ".env", ".log",
)


def stripped(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def repaired(content: Column) -> Column:
    """Bytes as text: invalid sequences become U+FFFD, all line ends a newline."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; a leading or trailing dot makes none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?s)(?<=.)\.[^.]+\z", "")


def glob_regex(pattern: str) -> str:
    """Whole-string regex of a shell pattern; ``*`` also crosses slashes."""
    out, at = [], 0
    quote = lambda c: "\\" + c if c in "\\^$.|?*+()[]{}" else c
    while at < len(pattern):
        c = pattern[at]
        close = pattern.find("]", at + 2 + (pattern[at + 1 : at + 2] == "!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = pattern[at + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[^{body[1:]}]" if body[0] == "!" else f"[\\{body}]" if body[0] == "^" else f"[{body}]")
            at = close
        else:
            out.append(quote(c))
        at += 1
    return f"(?s:{''.join(out)})"


def is_hidden(rel_path: Column) -> Column:
    return rel_path.rlike(r"(^|/)\.")


def is_indexable(rel_path: Column, ignore_patterns: list[str] = (), ignore_extensions: list[str] = (), suffixes: tuple[str, ...] = TEXT_SUFFIXES) -> Column:
    """The file filter: visible, a known suffix, and neither ignored by suffix nor by pattern.

    All patterns become one alternation, so there is no join with a pattern table.
    """
    ext = suffix(rel_path)
    keep = ~is_hidden(rel_path) & ext.isin(*suffixes)
    if ignore_extensions:
        keep &= ~ext.isin(*[e.lower() for e in ignore_extensions])
    if ignore_patterns:
        keep &= ~rel_path.rlike(f"^(?:{'|'.join(map(glob_regex, ignore_patterns))})\\z")
    return keep


def tokens(text: Column, pattern: str = WORD_TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def point_id(collection: Column, source_file: Column, chunk_index: Column) -> Column:
    """Deterministic id, so that writing a chunk again replaces it."""
    return F.sha2(F.concat_ws("\0", collection, source_file, chunk_index.cast("string")), 256)


def embed_input(title: Column, text: Column) -> Column:
    """What the embedder sees: the title in brackets on a line of its own, then the chunk."""
    return F.concat(F.lit("["), title, F.lit("]\n"), text)


def name_error(name: Column, folder: Column, names: list[str], folders: list[str], most: int = 4, longest: int = 64) -> Column:
    """Text of the first rule that a new collection breaks, or null."""
    return (
        F.when(name.isNull() | (name == ""), F.lit("name is empty"))
        .when(F.length(name) > longest, F.lit(f"name is longer than {longest} characters"))
        .when(~name.rlike(r"\A[a-zA-Z0-9][a-zA-Z0-9_-]*\z"), F.lit("name may hold letters, digits, _ and -, and begins with a letter or digit"))
        .when(F.lit(len(names) >= most), F.lit(f"there are {most} collections already"))
        .when(name.isin(*names) if names else F.lit(False), F.lit("name is taken"))
        .when(folder.isin(*folders) if folders else F.lit(False), F.lit("folder is taken"))
    )
