import random

import pytest

from loamdex.functions.counters import BasicCounter, WordPieceCounter
from loamdex.operators import chunking as c

WORDS = "one two three four five six seven eight"


def spans(pieces):
    return [(p.start, p.end) for p in pieces]


def test_known_cases():
    for f in (c.text_pieces, c.source_pieces, c.markdown_pieces):
        assert spans(f(WORDS, 4, 2)) == [(0, 19), (8, 28), (19, 39)]
        assert f("", 4, 0) == f(" \n\t", 4, 0) == []
    assert spans(c.text_pieces("One. Two.\n \nThree four five six seven eight.", 8, 0)) == [(0, 12), (12, 44)]
    assert spans(c.source_pieces("one\ntwo\nthree\nfour\nfive", 3, 1)) == [(0, 14), (8, 23)]
    assert spans(c.source_pieces("first\n    nested\nend\nlast\nextra", 4, 0)) == [(0, 17), (17, 31)]
    found = c.markdown_pieces("# Root\nintro\n## Child\n- one\n- two", 62, 0)
    assert spans(found) == [(0, 33)] and found[0].headings == ["Root"]
    assert spans(c.markdown_pieces("# Root\n\n```java\nint value = 1;\n```\n", 62, 0)) == [(0, 35)]
    assert spans(c.markdown_pieces("```\n" + WORDS + "\n```", 4, 0)) == [(0, 4), (4, 23), (23, 44), (44, 47)]


EIGHT, LINES, NUMBERS = [(0, 19, 1, 1, []), (8, 28, 1, 1, []), (19, 39, 1, 1, [])], "one two\nthree four\nfive six", "one\ntwo\nthree\nfour\nfive"
BLANK = " \t\r\n\u00a0 \u2003"
# Texts, model budgets (two tokens are special), overlaps and the chunks they must give: UTF-16 offsets, lines, titles.
CASES = {
    "text/empty": ("", 32, 0, []),
    "text/whitespace": (BLANK, 32, 0, []),
    "text/turkish-unicode": ("İstanbul, ıslak çığ; 😀 e\u0301.\n", 64, 0, [(0, 28, 1, 1, [])]),
    "text/lf": (LINES, 6, 0, [(0, 19, 1, 2, []), (19, 27, 3, 3, [])]),
    "text/crlf": (LINES.replace("\n", "\r\n"), 6, 0, [(0, 21, 1, 2, []), (21, 29, 3, 3, [])]),
    "text/oversized-overlap": (WORDS, 6, 2, EIGHT),
    "text/paragraphs": ("One. Two.\n \nThree four five six seven eight.", 10, 0, [(0, 12, 1, 2, []), (12, 44, 3, 3, [])]),
    "source/empty": ("", 32, 0, []),
    "source/whitespace": (BLANK, 32, 0, []),
    "source/turkish-unicode": ("// İstanbul 😀 e\u0301\n", 64, 0, [(0, 18, 1, 1, [])]),
    "source/lf": (NUMBERS, 5, 0, [(0, 14, 1, 3, []), (14, 23, 4, 5, [])]),
    "source/crlf": (NUMBERS.replace("\n", "\r\n"), 5, 0, [(0, 17, 1, 3, []), (17, 27, 4, 5, [])]),
    "source/oversized-overlap": (WORDS, 6, 2, EIGHT),
    "source/line-overlap": (NUMBERS, 5, 1, [(0, 14, 1, 3, []), (8, 23, 3, 5, [])]),
    "source/dedent": ("first\n    nested\nend\nlast\nextra", 6, 0, [(0, 17, 1, 2, []), (17, 31, 3, 5, [])]),
    "markdown/empty": ("", 32, 0, []),
    "markdown/whitespace": (BLANK, 32, 0, []),
    "markdown/turkish-unicode": ("# Başlık 😀\nİstanbul, ıslak çığ.\n", 64, 0, [(0, 33, 1, 2, ["Başlık 😀"])]),
    "markdown/oversized-overlap": (WORDS, 6, 2, EIGHT),
    "markdown/headings-lf": ("# Root\nintro\n## Child\n- one\n- two", 64, 0, [(0, 33, 1, 5, ["Root"])]),
    "markdown/headings-crlf": ("# Root\r\nintro\r\n## Child\r\n- one\r\n- two", 64, 0, [(0, 37, 1, 5, ["Root"])]),
    "markdown/fenced-code": ("# Root\n\n```java\nint value = 1;\n```\n", 64, 0, [(0, 35, 1, 5, ["Root"])]),
    "markdown/oversized-fence": ("```\n" + WORDS + "\n```", 6, 0, [(0, 4, 1, 1, []), (4, 23, 2, 2, []), (23, 44, 2, 2, []), (44, 47, 3, 3, [])]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases_with_known_chunks(name):
    text, budget, overlap, want = CASES[name]
    kind = {"text": "PLAIN_TEXT", "source": "SOURCE_CODE", "markdown": "MARKDOWN"}[name.split("/")[0]]
    rows = c.chunk_document("f", kind, text, budget - 2, overlap)
    assert [(int(a["startOffset"]), int(a["endOffset"]), first, last, titles) for _, _, _, _, first, last, titles, a in rows] == want
    wide = text.encode("utf-16-le")
    assert [r[3] for r in rows] == [wide[2 * a : 2 * b].decode("utf-16-le") for a, b, *_ in want]


# Pieces of the public uncased vocabulary with their ids, and texts with the ids they must give.
PIECES = {"[PAD]": 0, "[UNK]": 100, "[CLS]": 101, "[SEP]": 102, "[MASK]": 103, "&": 1004, "'": 1005, "(": 1006, ")": 1007, ",": 1010, "-": 1011, ".": 1012, "1": 1015, ";": 1025, "?": 1029, "!": 999, '"': 1000, "hello": 7592, "world": 2088, "payment": 7909, "validation": 27354, "runs": 3216, "before": 2077, "the": 1996, "order": 2344, "is": 2003, "confirmed": 4484, "cafe": 7668, "naive": 15743, "resume": 13746, "angstrom": 17076, "facade": 8508, "##s": 2015, "tab": 21628, "and": 1998, "new": 2047, "lines": 3210, "around": 2105, "token": 19204, "appear": 3711, "as": 2004, "text": 3793, "first": 2034, "second": 2117, "third": 2353, "fourth": 2959, "deploy": 21296, "succeeded": 4594, "wait": 3524, "what": 2054, "really": 2428, "yes": 2748, "quoted": 9339, "single": 2309}
ENCODED = {
    "": [101, 102],
    "hello world": [101, 7592, 2088, 102],
    "Payment validation runs before the order is confirmed.": [101, 7909, 27354, 3216, 2077, 1996, 2344, 2003, 4484, 1012, 102],
    "PaYmEnT VALIDATION Runs": [101, 7909, 27354, 3216, 102],
    "Wait... what?! (Really) -- yes; \"quoted\" & 'single'.": [101, 3524, 1012, 1012, 1012, 2054, 1029, 999, 1006, 2428, 1007, 1011, 1011, 2748, 1025, 1000, 9339, 1000, 1004, 1005, 2309, 1005, 1012, 102],
    "  tabs\tand\nnew lines\r\n  around  ": [101, 21628, 2015, 1998, 2047, 3210, 2105, 102],
    "the [SEP] token and [CLS] appear as text": [101, 1996, 102, 19204, 1998, 101, 3711, 2004, 3793, 102],
    "first\u2028second\u2029third\u3000fourth": [101, 2034, 2117, 2353, 2959, 102],
    "deploy 🚀 succeeded ✅": [101, 21296, 100, 4594, 100, 102],
}


def test_word_pieces_with_known_ids(tmp_path):
    by_id = {i: w for w, i in PIECES.items()}
    (tmp_path / "vocab.txt").write_text("\n".join(by_id.get(i, f"[unused{i}]") for i in range(max(by_id) + 1)), encoding="utf-8")
    w = WordPieceCounter(str(tmp_path / "vocab.txt"))
    assert {t: w.encode(t) for t in ENCODED} == ENCODED
    assert w.encode("payment validation " * 200) == [101, *[7909, 27354] * 127, 102]


# Texts and the kinds and last lines of the blocks that CommonMark sees at the top.
BLOCKS = {
    "a\nb\n\nc": [("paragraph", 2), ("paragraph", 4)],
    "a\n    not code\n\n    code\n\n    more\n\nb": [("paragraph", 2), ("code", 6), ("paragraph", 8)],
    "> a\nlazy\n\nb": [("quote", 2), ("paragraph", 4)],
    "> a\n# h": [("quote", 1), ("heading", 2)],
    "> ```\ncode?\n": [("quote", 1), ("paragraph", 2)],
    "> - a\nlazy\n> b": [("quote", 3)],
    "- a\n\n  b\n\nc": [("list", 3), ("paragraph", 5)],
    "- a\n* b\n+ c": [("list", 1), ("list", 2), ("list", 3)],
    "1. a\n2. b\n3) c": [("list", 2), ("list", 3)],
    "- a\nlazy\n- b": [("list", 3)],
    "- a\n# h": [("list", 1), ("heading", 2)],
    "- a\n  ```\n  x\n\n  # no heading\n  ```\n- b": [("list", 7)],
    "-\n\n  a": [("list", 1), ("paragraph", 3)],
    "text\n14. not a list\n": [("paragraph", 2)],
    "text\n1. a list\n": [("paragraph", 1), ("list", 2)],
    "text\n-\n": [("heading", 2)],
    "Title\nmore\n===\nx": [("heading", 3), ("paragraph", 4)],
    "***\na\n---\n***": [("rule", 1), ("heading", 3), ("rule", 4)],
    "- - -\n- a": [("rule", 1), ("list", 2)],
    "<div>\n*a*\n\nb": [("html", 2), ("paragraph", 4)],
    "<!-- a\n\nb -->\nc": [("html", 3), ("paragraph", 4)],
    "<pre>\n\nx\n</pre>\nc": [("html", 4), ("paragraph", 5)],
    "<a href='x'>\ny\n\nz": [("html", 2), ("paragraph", 4)],
    "<a href='x'> y\nz": [("paragraph", 2)],
    "text\n<i>\nz": [("paragraph", 3)],
    "text\n<p>\nz": [("paragraph", 1), ("html", 3)],
    "```` md\n```\n````\na": [("fence", 3), ("paragraph", 4)],
    "``` a`b\nc": [("paragraph", 2)],
    "~~~\nnever closed\n\nx": [("fence", 4)],
    "#no\n# yes #\n####### no": [("paragraph", 1), ("heading", 2), ("paragraph", 3)],
}


@pytest.mark.parametrize("text", BLOCKS)
def test_blocks(text):
    rows = text.split("\n")
    assert [(b.kind, b.end) for b in c.markdown_blocks(rows, 0, len(rows))] == BLOCKS[text]


def test_markdown_sections_and_titles():
    text = "# A *b* `c`\n\n" + "word " * 60 + "\n\n## Sub\n\n" + "other " * 60 + "\n\nTop\n===\n\n" + "more " * 60 + "\n\n<!-- only -->\n"
    found = c.markdown_pieces(text, 80, 0)
    assert [p.headings for p in found][:3] == [["A b c"], ["A b c", "Sub"], ["Top"]]
    assert c.markdown_pieces("<!-- a -->\n<br/>\n", 80, 0) == []
    items = "\n".join(f"- item {k} " + "x " * 10 for k in range(20))
    assert all(text.strip() for text in (items[p.start : p.end] for p in c.markdown_pieces(items, 30, 0)))


@pytest.mark.parametrize("chunker", [c.text_pieces, c.source_pieces, c.markdown_pieces])
def test_invariants(chunker, data):
    import pyarrow.parquet as pq

    rnd = random.Random(4)
    texts = [t for t in pq.read_table(f"{data}/documents.parquet").column("text").to_pylist() if t]
    texts += ["".join(rnd.choice(["a", "bb ", "\n", "\r\n", "\n\n", "  x", "# h\n", "- i\n", "> q\n", "東京", "😀 ", ". ", "\t"]) for _ in range(300)) for _ in range(30)] + ["x" * 3000, "a\n" * 3000]
    count = BasicCounter().count
    for t in texts:
        budget, overlap = rnd.choice([(6, 2), (20, 0), (60, 10), (220, 32)])
        pieces = chunker(t, budget, overlap)
        last = 0
        for i, p in enumerate(pieces):
            body = t[p.start : p.end]
            assert body.strip() and p.end > last and (count(body) <= budget or len(body) == 1)
            assert not (t[p.start - 1 : p.start + 1] == "\r\n" and p.start) and not t[p.end - 1 : p.end + 1] == "\r\n"
            if p.start < last:
                assert count(t[p.start : last]) <= overlap
            elif chunker is not c.markdown_pieces:
                assert not t[last : p.start].strip()
            last = p.end
        if chunker is not c.markdown_pieces:
            assert not t[last:].strip()


def test_chunk_rows(spark):
    docs = [("a.md", "MARKDOWN", "# T\r\n\r\n😀 text"), ("b.py", "SOURCE_CODE", "x = 1\n"), ("c.txt", "PLAIN_TEXT", None), ("d.txt", "PLAIN_TEXT", " ")]
    rows = c.chunk_documents(spark.createDataFrame([(*d, 1) for d in docs], "source_path string, document_type string, content string, chunk_index int"), 100, 10).collect()
    got = {r.source_path: r for r in rows}
    assert set(got) == {"a.md", "b.py"} and got["a.md"].attributes["endOffset"] == "14" and got["a.md"].end_line == 3 and got["a.md"].heading_path == ["T"]
    own = c.chunk_documents(spark.createDataFrame([docs[1]], "source_path string, document_type string, content string"), 100, 10, overrides={"py": lambda t, b, o, n: [c.Piece(0, 1)]}).collect()
    assert own[0].content == "x"


def test_counters(tmp_path):
    count = BasicCounter().count
    assert count("Hello, world!") == 4 and count("東京 abc") == 3 and count("") == 0 and count("a\u200bb [UNK]") == 2
    vocab = tmp_path / "vocab.txt"
    vocab.write_text("\n".join(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "un", "##aff", "##able", "hello", ",", "東"]))
    w = WordPieceCounter(str(vocab))
    assert w.tokenize("Héllo, UNAFFable 東xyz [MASK]") == ["hello", ",", "un", "##aff", "##able", "東", "[UNK]", "[MASK]"]
    assert w.encode("hello") == [2, 8, 3] and w.tokenize("a" * 101) == ["[UNK]"]


def test_embedding_input():
    assert c.embedding_input("a/b.md", ["T", "S"], "body") == "a/b.md > T > S\n\nbody"
    long = c.embedding_input("a/b.md", ["T " * 40, "last"], "body")
    assert long.startswith("… ") and BasicCounter().count(long.split("\n")[0]) <= 32
