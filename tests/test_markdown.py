import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.operators.markdown import blocks, chunks, is_heading, line_kind, windows


def kinds(text):
    return [b.kind for b in blocks(text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", []),
        ("  \n\t\n", []),
        ("# A\n## B\n### C\ntext\n#### D\n##### E\n###### F", ["heading"] * 3 + ["paragraph"] + ["heading"] * 3),
        ("#no space", ["paragraph"]),
        ("One\n===\n\nTwo\n---\n\nbody", ["underlined", "underlined", "paragraph"]),
        ("p\n\n```py\na\n\n# not a heading\n```\n\nq\n\n~~~\nx\n~~~\nr", ["paragraph", "fence", "paragraph", "fence", "paragraph"]),
        ("````\n```\n````\nafter", ["fence", "paragraph"]),
        ("```\nnever closed\n\n# x", ["fence"]),
        ("a\n\n$$\nx\n\ny\n$$\n\nb", ["paragraph", "math", "paragraph"]),
        ("| a | b |\n|---|---|\n| 1 | 2 |\ntext", ["table", "paragraph"]),
        ("> q\n> r\n\np\n\n> s", ["quote", "paragraph", "quote"]),
        ("- a\n- b\n  - c\n\n- d\n\nend", ["list", "paragraph"]),
        ("1. a\n2) b\n\n    more\n\nend", ["list", "paragraph"]),
        ("- a\nplain", ["list", "paragraph"]),
        ("![alt](x.png)\n![[y]]", ["image", "image"]),
        ("a\n\n---\n\nb\n\n* * *\nc\n-*_", ["paragraph", "rule", "paragraph", "rule", "paragraph", "rule"]),
        ("---\nk: v\n---\n\n# T\n\np", ["frontmatter", "heading", "paragraph"]),
        ("---\nk: v", ["frontmatter"]),
        ("p1\np2\n# H\np3", ["paragraph", "heading", "paragraph"]),
        ("two lines\nof text\n---", ["paragraph", "rule"]),
        ("two lines\nof text\n===", ["paragraph"]),
        ("-", ["paragraph"]),
    ],
)
def test_block_kinds(text, expected):
    assert kinds(text) == expected


def test_blocks_keep_every_line():
    text = "# H\n\n- a\n\n  b\n\npara\n> q\n"
    kept = [line for b in blocks(text) for line in b.text.splitlines() if line.strip()]
    assert kept == [line for line in text.splitlines() if line.strip()]


def test_line_kinds():
    assert [line_kind(s) for s in ("", "# x", "```", "$$", "|", ">", "---", "- a", "![a](b)", "x")] == ["blank", "heading", "fence", "math", "table", "quote", "rule", "list", "image", "text"]


def test_headings_by_text():
    assert is_heading("# a") and is_heading("a\n---") and is_heading("---\n---")
    assert not is_heading("a\n  ---") and not is_heading("a\nb\n---") and not is_heading("")


@pytest.mark.parametrize(
    "heads, size, overlap, expected",
    [
        ("....", 4, 1, [(0, 4)]),
        ("HHHH", 4, 1, [(0, 4)]),
        ("HHHHH", 4, 1, [(0, 4), (4, 5)]),
        (".........", 3, 1, [(0, 3), (2, 5), (4, 7), (6, 9)]),
        ("H..H....", 4, 1, [(0, 5), (3, 7), (6, 8)]),
        ("H...H...", 4, 1, [(0, 4), (4, 8)]),
        ("H..H......", 4, 1, [(0, 5), (3, 7), (6, 10)]),
    ],
)
def test_windows(heads, size, overlap, expected):
    assert list(windows([h == "H" for h in heads], size, overlap)) == expected


def test_mixed_document():
    text = "# T\n\nintro\n\n## A\n\n- x\n- y\n\n### B\n\nbody\n\n## C\n\n| a |\n|---|\n\n```\ncode\n```\n\nlast"
    assert len(kinds(text)) == 10
    assert [c.count("\n\n") + 1 for c in chunks(text)] == [4, 4, 4]
    assert chunks("# Hello\n") == ["# Hello"] and chunks("  \n") == [] and chunks(None) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.integers(2, 6))
def test_windows_cover_all_and_advance(heads, size):
    got = list(windows(heads, size, 1))
    assert sorted({k for a, e in got for k in range(a, e)}) == list(range(len(heads)))
    assert all(a < b for (a, _), (b, _) in zip(got, got[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#-*>|$`~ \n\tab1.=", max_size=120))
def test_no_line_is_lost(text):
    kept = [line for b in blocks(text) for line in b.text.split("\n") if line.strip()]
    assert kept == [line for line in text.splitlines() if line.strip()]


def test_an_empty_bullet_ends_a_list():
    found = lambda t: [(b.kind, b.text) for b in blocks(t)]
    assert found("- a\n- \n- b") == [("list", "- a"), ("paragraph", "- "), ("list", "- b")]
    assert found("- a\n\n- \n") == [("list", "- a"), ("paragraph", "- ")]
    assert found("1. a\n\n  b\n* c\nd") == [("list", "1. a\n\n  b\n* c"), ("paragraph", "d")]
