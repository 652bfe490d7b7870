import random
import re

import pytest

from loamdex.llm import bpe, pieces

CHUNK = "id long, file_id long, chunk_index int, content string, start_line int, end_line int"
PROFILE = "file_id long, tokenizer_key string, max_tokens int, overlap_tokens int, updated_at timestamp_ntz"


def brute(content, start, most, overlap):
    toks = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\r\n]+", content)]
    if len(toks) <= most:
        return []
    count = lambda a, b: len(re.findall(r"\r\n|\r|\n", content[a:b]))
    line = [start + count(0, a) for a, _ in toks]
    gap = [0] + [count(toks[i - 1][1], toks[i][0]) for i in range(1, len(toks))]
    out, new = [], 0
    while new < len(toks):
        first = new - min(overlap, new, most - 1)
        end = first + most
        if end >= len(toks):
            end = len(toks)
        else:
            for least in (2, 1):
                if fits := [e for e in range(new + 1, end + 1) if gap[e] >= least]:
                    end = fits[-1]
                    break
        out.append((line[first], line[end - 1], end - first))
        new = end
    return [(i, *x) for i, x in enumerate(out)]


@pytest.mark.parametrize("range_bytes", [1 << 20, 64, 5])
def test_pieces_agree_with_brute_force(spark, range_bytes):
    from datetime import datetime

    rnd = random.Random(range_bytes)
    rows = []
    for i in range(60):
        text = "".join(rnd.choice(["a", "bb", "ü東", " ", " ", " ", "\t", "\n", "\r\n", "\r", "\n\n", ". "]) for _ in range(rnd.choice([0, 3, 40, 200])))
        rows.append((i, i % 7, 0, text, rnd.randrange(1, 50), 0))
    rows += [(100, 1, 0, None, 1, 1), (101, 99, 0, "a b c d e f g h", 1, 1), *rows[:9]]
    limits = {f: (rnd.randrange(1, 12), rnd.choice([None, 0, 2, 15])) for f in range(7)}
    profiles = [(f, "t", m, o, datetime(2030, 1, 2)) for f, (m, o) in limits.items()] + [(f, "t", 3, 1, datetime(2030, 1, 1)) for f in range(7)]
    chunks = spark.createDataFrame(rows, CHUNK)
    profiles = spark.createDataFrame(profiles, PROFILE)
    found = pieces.split_oversized(chunks, profiles, range_bytes).collect()
    want = {(r[0], *p) for r in rows if r[3] is not None and r[1] in limits for p in brute(r[3], r[4], limits[r[1]][0], limits[r[1]][1] or 0)}
    assert {(r.chunk_id, r.piece_no, r.start_line, r.end_line, r.n_tokens) for r in found} == want and len(found) == len(want)


def test_piece_texts_hold_the_tokens(spark):
    from datetime import datetime

    text = "one two\r\n\r\nthree fünf six seven"
    chunks = spark.createDataFrame([(1, 1, 0, text, 5, 8)], CHUNK)
    profiles = spark.createDataFrame([(1, "t", 3, 1, datetime(2030, 1, 1))], PROFILE)
    found = pieces.split_oversized(chunks, profiles)
    texts = [r.text for r in pieces.piece_texts(chunks, found).orderBy("piece_no").collect()]
    assert texts == ["one two", "two\r\n\r\nthree fünf", "fünf six seven"]
    assert pieces.split_oversized(chunks.limit(0), profiles).count() == 0 == pieces.split_oversized(chunks, profiles.limit(0)).count()


@pytest.mark.parametrize("range_bytes", [7, 100, 1 << 20])
def test_files_are_split_by_ranges(spark, tmp_path, range_bytes):
    rnd = random.Random(9)
    rows, want, bodies = [], set(), {}
    for i in range(12):
        body = "".join(rnd.choice(["a", "bb", "ü東", " ", " ", "\t", "\n", "\r\n", "\r", "\n\n"]) for _ in range(rnd.choice([0, 5, 60, 200])))
        path = tmp_path / f"f{i}"
        path.write_bytes(body.encode())
        rows.append((i, str(path), len(body.encode()), "x"))
        bodies[i] = body
        want |= {(i, *p) for p in brute(body, 1, 6, 2)}
    files = spark.createDataFrame(rows, "id long, path string, byte_size long, text string")
    found = pieces.split_files(files, 6, 2, range_bytes).collect()
    assert {(r.chunk_id, r.piece_no, r.start_line, r.end_line, r.n_tokens) for r in found} == want and len(found) == len(want)
    for r in found:
        assert r.text.encode() == bodies[r.chunk_id].encode()[r.start_byte : r.end_byte] and len(re.findall(r"[^ \t\r\n]+", r.text)) == r.n_tokens and r.text == r.text.strip(" \t\r\n")
    assert pieces.split_files(files.limit(0), 6, 2).count() == 0


def test_ids_equal_the_public_tokenizer(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    rnd = random.Random(1)
    odd = [None, "", " ", "<|endoftext|>x", "a" * 30_000, "\r\n \r\n\t", "é🇹🇷👩‍💻﻿\u0000\u0085", "ab1" * 9_000]
    odd += ["".join(rnd.choice("aab .\n'sş東1") for _ in range(500)) for _ in range(50)]
    texts = odd + odd + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids0 string")
    got = bpe.encode_corpus(df, keep=["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == ref.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    with pytest.raises(ValueError):
        bpe.encode_corpus(df, keep=["doc_id"], output="doc_id")
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_forgetting_words_changes_nothing():
    texts = ["some words here", "other words there", "some words"]
    path = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"
    small = bpe.CorpusEncoder(path, memory=1)
    assert [small.encode([t])[0] for t in texts] == bpe.CorpusEncoder(path).encode(texts)
