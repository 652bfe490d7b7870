import math
import random
import sqlite3
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamdex.functions.progress import duration_text, progress_text
from loamdex.functions import scoring, text
from loamdex.operators import evaluate, hybrid, incremental, lexical, semantic
from loamdex.operators import snippets
from loamdex.operators.snippets import snippet


def column(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_terms_fold_as_the_index_does(spark):
    cases = {"Load_Config loadConfig": ["load", "config", "loadconfig"], "İstanbul ISPARTA ılık": ["istanbul", "isparta", "ılık"], "Čaj naïve ß ﬁ œ": ["caj", "naive", "ß", "ﬁ", "œ"], "e\u0301tude 東京 ½ x²": ["etude", "東京", "½", "x²"], "": [], "-- !": [], None: []}
    got = column(spark, [(k,) for k in cases], "t string", text.tokens(F.col("t")))
    assert [r[0] for r in got] == list(cases.values())


def test_query_parts_and_shape(spark):
    long = " ".join(["w"] * 65)
    rows = [("authentication middleware",), ('say "hi" -- !',), ("a\u00a0b\u0085c",), ("",), (long,)]
    got = column(spark, rows, "t string", text.match_expression(F.col("t")), text.part_count(F.col("t")))
    assert got[0] == ('"authentication" AND "middleware"', 2) and got[1] == ('"say" AND """hi"""', 4) and got[2][1] == 3 and got[3] == (None, 0) and got[4][1] == 65
    code = ["HeroStat", "BUFFER_THRESHOLD", "com.iluwatar.retry", "std::vector", "node->next", "HTTP2", "retry maxAttempts"]
    plain = ["retry", "RETRY", "where is getActiveCalls defined", "a-b", "page 2", ""]
    got = column(spark, [(t,) for t in code + plain], "t string", text.query_shape(F.col("t")))
    assert [r[0] for r in got] == ["IDENTIFIER"] * len(code) + ["NATURAL_LANGUAGE"] * len(plain)


def test_paths_and_types(spark):
    cases = {"a/README": "PLAIN_TEXT", "x.MD": "MARKDOWN", "Dockerfile": "SOURCE_CODE", "a.tar.json": "STRUCTURED_TEXT", ".py": "PLAIN_TEXT", "a.": "PLAIN_TEXT", "a/b.unknown": "PLAIN_TEXT", None: None}
    assert [r[0] for r in column(spark, [(k,) for k in cases], "p string", text.document_type(F.col("p")))] == list(cases.values())
    admitted = {"a.md": True, "x/Y.PY": True, "node_modules/a.js": False, "x/target/a.md": False, "app.min.js": False, "a.exe": False, "Makefile": True, ".env": False}
    assert [r[0] for r in column(spark, [(k,) for k in admitted], "p string", text.admitted(F.col("p")))] == list(admitted.values())
    valid = {"a/b": True, "/a": False, "a/../b": False, "a//b": False, "./a": False, "a\\b": False, "C:/a": False, "": False}
    assert [r[0] for r in column(spark, [(k,) for k in valid], "p string", text.valid_path(F.col("p")))] == list(valid.values())
    assert [r[0] for r in column(spark, [("target",), ("a/target",), ("targets",)], "p string", text.pruned_directory(F.col("p")))] == [True, True, False]


def test_texts(spark):
    got = column(spark, [("a" * 400 + "\x01\x02\x03\x04",), ("\x01\x02\x03\x04",), ("\x01\x02\x03",), ("a\n\t\r\f",), ("﻿x",)], "t string", text.looks_binary(F.col("t")), text.strip_bom(F.col("t")))
    assert [r[0] for r in got] == [False, True, False, False, False] and got[4][1] == "x"
    markup = ["<!-- a -->\n> <br/>", "text", "`code`", "<b>bold</b>", "  \n"]
    assert [r[0] for r in column(spark, [(t,) for t in markup], "t string", text.only_markup(F.col("t")))] == [True, False, False, False, True]
    assert [len(r[0]) for r in column(spark, [("x" * 401,), ("x" * 400,)], "t string", text.bounded(F.col("t")))] == [400, 400]
    est = column(spark, [("MARKDOWN", 0), ("MARKDOWN", 1), ("MARKDOWN", 581), ("SOURCE_CODE", 60100)], "k string, n long", text.chunk_estimate(F.col("k"), F.col("n")))
    assert [r[0] for r in est] == [0, 1, 2, 100]


def test_identities(spark):
    i = text.ChunkingIdentity("wordpiece", "a" * 64, 100, 256, 2, 128, 16)
    assert len(i.fingerprint()) == 64 and i.budget == 126 and text.ChunkingIdentity("wordpiece", "a" * 64, 100, 256, 2, 256, 32).budget == 222
    assert i.fingerprint() != text.ChunkingIdentity("wordpiece", "a" * 64, 100, 256, 2, 128, 17).fingerprint()
    with pytest.raises(ValueError):
        text.ChunkingIdentity("w", "a" * 64, 1, 256, 2, 300, 0)
    with pytest.raises(ValueError):
        text.ChunkingIdentity("w", "a" * 64, 1, 256, 2, 100, 98)
    import hashlib

    def framed(s):
        return len(s.encode()).to_bytes(4, "big") + s.encode()

    want = hashlib.sha256(framed("index-chunk-id-v1") + framed("東京/🧪-ı.txt") + (17).to_bytes(4, "big") + framed("f" * 64)).hexdigest()
    assert column(spark, [("東京/🧪-ı.txt", 17)], "p string, i int", text.stable_id(F.col("p"), F.col("i"), F.lit("f" * 64)))[0][0] == want
    assert text.closest("max_token", ["max_tokens", "other"]) == "max_tokens" and text.closest("zzz", ["abc"]) is None and text.closest("ab", ["ba"]) is None


def index_of(spark, rows):
    df = spark.createDataFrame([(i, i, 0, *r, 1, 1) for i, r in enumerate(rows)], "chunk_id long, file_id long, chunk_index int, content string, headings string, source_path string, start_line int, end_line int")
    return df, lexical.postings(df), lexical.totals(lexical.chunk_lengths(df))


def test_scores_equal_full_text_search(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(content, headings, source_path, tokenize = 'unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this sqlite")
    rnd = random.Random(6)
    words = ["alpha", "beta", "Gamma", "delta_eps", "naïve", "the"]
    rows = [tuple(" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 4, 12]))) for _ in range(3)) for _ in range(60)]
    con.executemany("insert into t(rowid, content, headings, source_path) values (?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    queries = [" ".join(rnd.choice(words + ["beta-gamma", "alpha_the"]) for _ in range(rnd.choice([1, 2, 3]))) for _ in range(25)] + ["beta beta", "nothing"]
    df, index, lengths = index_of(spark, rows)
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    for many in (True, False):
        got = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25_scores(index, lengths, asked, many).collect()}
        want = {}
        for i, q in enumerate(queries):
            expression = " AND ".join(f'"{p}"' for p in q.split())
            for rowid, score in con.execute("select rowid, bm25(t, 1, 1, 1) from t where t match ?", (expression,)):
                want[i, rowid] = score
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    one = spark.createDataFrame([(3, queries[3])], "query_id long, text string")
    few = lexical.wanted_terms(index, one.select(text.phrases(F.col("text")).alias("p")).first().p)
    assert {r.chunk_id: r.score for r in lexical.bm25_scores(few, lengths, one, many=False).collect()} == pytest.approx({k[1]: s for k, s in want.items() if k[0] == 3})
    top = lexical.search(index, lengths, df, asked, 3)
    for r in top.collect():
        better = [k for k, s in want.items() if k[0] == r.query_id and s < want[r.query_id, r.chunk_id] - 1e-9]
        assert len(better) < r["rank"] <= 3


def test_index_of_nulls_and_nothing(spark):
    chunks = spark.createDataFrame([(1, 1, 0, None, 1, 1), (1, 1, 0, None, 1, 1), (2, 9, 0, "x", 1, 1), (None, 1, 0, "y", 1, 1)], "id long, file_id long, chunk_index int, content string, start_line int, end_line int")
    files = spark.createDataFrame([(1, "a.md"), (1, "a.md")], "id long, source_path string")
    rows = lexical.index_rows(chunks, files)
    assert [r.chunk_id for r in rows.collect()] == [1] and {r.term for r in lexical.postings(rows).collect()} == {"a", "md"}
    empty = lexical.index_rows(chunks.limit(0), files)
    asked = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (2, None)], "query_id long, text string")
    assert lexical.search(lexical.postings(empty), lexical.totals(lexical.chunk_lengths(empty)), empty, asked, 5).count() == 0
    stats = lexical.corpus_stats(lexical.chunk_lengths(empty)).first()
    assert stats.n_rows == 0 and stats.total_tokens == 0


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    x[5] = x[6]
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "chunk_id long, profile_id int, vector array<float>").repartition(3)
    q = df.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in semantic.nearest_batch(df, q, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for i in range(0, 300, 50):
        s = [(-round(float(unit[i] @ unit[j]), 12), j) for j in range(300) if j % 2 == i % 2]
        assert [c for _, c in sorted(got[i])] == [j for _, j in sorted(s)[:4]]
    own = semantic.nearest_to(df.filter("profile_id = 0"), x[0].tolist(), 1).first()
    assert own.chunk_id == 0 and math.isclose(own.score, 1.0)
    assert semantic.nearest_batch(df, q.limit(0), 4).count() == 0
    assert column(spark, [([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>", scoring.cosine(F.col("a"), F.col("b"))) == [(-1.0,), (None,), (None,)]


def test_pooling_and_embedding(spark):
    h = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    got = semantic.pooled(h, [2, 1])
    want = h[0, :2].mean(axis=0)
    assert np.allclose(got[0], want / np.linalg.norm(want)) and np.allclose(np.linalg.norm(got, axis=1), 1)
    with pytest.raises(ValueError):
        semantic.pooled(np.zeros((1, 2, 3)), [2])

    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] for t in texts]

    rows = semantic.embed(spark.createDataFrame([(1, "aa"), (2, "bad"), (3, "a"), (4, None)], "id long, input string"), "input", model, 2).collect()
    assert {r.id: (list(r.vector) if r.vector else None, bool(r.error)) for r in rows} == {1: ([2.0, 1.0], False), 2: (None, True), 3: ([1.0, 1.0], False)}


def test_fusion_and_collapsing(spark):
    lex = [(1, i + 1, c, f"p{c}", 0) for i, c in enumerate([5, 3, 9])] + [(2, 1, 4, "p4", 0)]
    sem = [(1, i + 1, c, f"p{c}", 0) for i, c in enumerate([9, 7, 5])] + [(3, 1, 8, "p8", 0)]
    schema = "query_id long, rank int, chunk_id long, source_path string, chunk_index int"
    shapes = [(1, "NATURAL_LANGUAGE"), (2, "IDENTIFIER"), (3, "IDENTIFIER")]
    a, b, q = spark.createDataFrame(lex, schema), spark.createDataFrame(sem, schema), spark.createDataFrame(shapes, "query_id long, shape string")
    got = hybrid.fuse(a, b, q, 10).orderBy("query_id", "rank").collect()
    score = {c: sum(1 / (60 + r) for q_, r, x, _, _ in lex + sem if q_ == 1 and x == c) for c in (3, 5, 7, 9)}
    assert [r.chunk_id for r in got if r.query_id == 1] == sorted(score, key=lambda c: (-round(score[c], 12), f"p{c}"))
    assert [(r.query_id, r.chunk_id, r.lexical_rank, r.semantic_rank) for r in got if r.query_id > 1] == [(2, 4, 1, None), (3, 8, None, 1)]
    short = hybrid.fuse(a, b, q, 2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in short if r.query_id == 1] == [tuple(r) for r in got if r.query_id == 1][:2]
    ident = hybrid.fuse(a, b, q.withColumn("shape", F.lit("IDENTIFIER")), 10).filter("query_id = 1").orderBy("rank").collect()
    assert [r.chunk_id for r in ident][:3] == [5, 3, 9]
    hits = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "b"), (1, 4, "c")], "query_id long, rank int, source_path string")
    assert [r.source_path for r in hybrid.collapse_to_files(hits).orderBy("rank").collect()] == ["b", "a", "c"]


def test_quality_measures(spark):
    ranking = spark.createDataFrame([(1, f"f{i}", i + 1) for i in range(12)], "query_id long, source_path string, rank int")
    grades = spark.createDataFrame([(1, "f2", 2), (1, "f7", 2), (1, "f0", 1), (1, "gone", 2), (2, "x", 2), (3, "x", 1)], "query_id long, source_path string, grade int")
    got = {r.query_id: r for r in evaluate.query_metrics(ranking, grades).collect()}
    dcg, ideal = 1 / math.log2(2) + 3 / math.log2(4) + 3 / math.log2(9), sum(g / math.log2(i + 2) for i, g in enumerate([3, 3, 3, 1]))
    assert set(got) == {1, 2} and math.isclose(got[1].recall_at_5, 1 / 3) and math.isclose(got[1].recall_at_10, 2 / 3) and math.isclose(got[1].reciprocal_rank, 1 / 3) and math.isclose(got[1].ndcg_at_10, dcg / ideal)
    assert tuple(got[2])[1:] == (0.0, 0.0, 0.0, 0.0)
    means = evaluate.mean_metrics(spark.createDataFrame([(k, *tuple(r)[1:]) for k, r in zip("ab", got.values())], "kind string, recall_at_5 double, recall_at_10 double, reciprocal_rank double, ndcg_at_10 double"), "kind")
    gates = spark.createDataFrame([("a", 0.3, 0.9, 0.3, 0.0)], "kind string, recall_at_5 double, recall_at_10 double, mrr double, ndcg_at_10 double")
    assert [r.metric for r in evaluate.below(means, gates, "kind").collect()] == ["recall_at_10"]
    p = evaluate.percentiles(spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("a", None), ("a", math.nan)], "k string, v double"), "k", "v").first()
    assert (p.median, p.p95) == (10.0, 19.0)


def test_decisions_and_snapshots(spark):
    stored = spark.createDataFrame([("a", "AA", "T", "f"), ("b", "bb", "T", "f"), ("c", "cc", "T", "g"), ("d", "dd", "T", "f"), ("sub/e", "ee", "T", None)], "source_path string, content_hash string, document_type string, chunking_fingerprint string")
    found = spark.createDataFrame([("a", "aa", "T"), ("b", "xx", "T"), ("c", "cc", "T"), ("n", "nn", "T"), ("sub/e", "ee", "T")], "source_path string, content_hash string, document_type string")
    got = {r.source_path: r.decision for r in incremental.decisions(found, stored, "f").collect()}
    assert got == {"a": "UNCHANGED", "b": "CHANGED", "c": "RECHUNKED", "n": "NEW", "sub/e": "RECHUNKED"}
    assert [r.source_path for r in incremental.deletions(stored, found).collect()] == ["d"]
    assert incremental.deletions(stored, found, rejected=1).count() == 0 == incremental.deletions(stored, found, issues=1).count() == incremental.deletions(stored, found, wanted=F.col("source_path") != "d").count()
    new = found.filter("source_path in ('b', 'n')").withColumn("chunking_fingerprint", F.lit("f"))
    after = {r.source_path: r.content_hash for r in incremental.replace_files(stored, new, incremental.deletions(stored, found)).collect()}
    assert after == {"a": "AA", "b": "xx", "c": "cc", "n": "nn", "sub/e": "ee"}
    left = incremental.checked_removal(stored, spark.createDataFrame([("a", "AA")], "source_path string, content_hash string"))
    assert left.count() == 4
    with pytest.raises(Exception, match="changed since"):
        incremental.checked_removal(stored, spark.createDataFrame([("a", "ZZ")], "source_path string, content_hash string")).collect()


def test_vectors_of_two_profiles_are_refused(spark):
    v = spark.createDataFrame([(1, "f"), (2, "f")], "chunk_id long, fingerprint string")
    assert semantic.only_profile(v, "f").count() == 2
    for bad in ("g", None):
        with pytest.raises(Exception, match="another profile"):
            semantic.only_profile(v.union(spark.createDataFrame([(3, bad)], v.schema)), "f").collect()


def test_fusion_refuses_what_does_not_fit(spark):
    side, q = "query_id long, rank int, chunk_id long, source_path string, chunk_index int", spark.createDataFrame([(1, "IDENTIFIER")], "query_id long, shape string")
    lex, sem = spark.createDataFrame([(1, 1, 5, "a", 0), (1, 2, 6, "b", 0)], side), spark.createDataFrame([(1, 1, 6, "b", 0)], side)
    assert [r.chunk_id for r in hybrid.fuse(lex, sem, q, 5).orderBy("rank").collect()] == [5, 6]
    for bad, said in ((spark.createDataFrame([(1, 1, 6, "c", 0)], side), "different positions"), (spark.createDataFrame([(1, 1, 6, "b", 0), (1, 2, 6, "b", 0)], side), "twice")):
        with pytest.raises(Exception, match=said):
            hybrid.fuse(lex, bad, q, 5).collect()


def test_progress_as_text():
    assert [duration_text(x) for x in (0.04, 9.99, 12.7, 60, 185, 3600, 7500)] == ["0.0 s", "10.0 s", "12 s", "1 min", "3 min 5 s", "1 h", "2 h 5 min"]
    assert progress_text("embedding", 500, 2000, 20, "chunk") == "embedding: 500 of 2,000 chunks, 25 chunks/s, about 1 min left"
    assert progress_text("x", 1, 1, 0.2, "file") == "x: 1 of 1 file" and progress_text("x", 1, 3, 2, "file") == "x: 1 of 3 files, 0.5 files/s, about 4 s left"


def test_coverage(spark):
    chunks = spark.createDataFrame([(i, i % 2, "c") for i in range(6)] + [(0, 0, "c")], "id long, file_id long, content string")
    vectors = spark.createDataFrame([(0, "f"), (1, "g"), (2, "f"), (2, "g")], "chunk_id long, fingerprint string")
    assert tuple(semantic.coverage(chunks, vectors, "f").first()) == (2, 1, 3)
    assert {r.file_id: tuple(r)[1:] for r in semantic.coverage(chunks, vectors, "f", "file_id").collect()} == {0: (2, 0, 1), 1: (0, 1, 2)}
    assert sorted(r.id for r in semantic.unembedded(chunks, vectors, "f").collect()) == [1, 3, 4, 5]
    new = spark.createDataFrame([(0, "c"), (3, "c"), (4, "old")], "chunk_id long, content string")
    assert [r.chunk_id for r in semantic.still_current(new, chunks, vectors).collect()] == [3]


def test_snippets():
    body = "Intro words here. " + "filler " * 40 + "Then the ledger keeps totals. " + "more " * 40
    s, ranges = snippet(body, [["ledger"], ["totals"]])
    assert [s[a:b] for a, b in ranges] == ["ledger", "totals"] and s.startswith("…") and s.endswith("…") and len(s) <= 400
    assert snippet("İade süresi", [["iade"], ["suresi"]]) == ("İade süresi", [(0, 11)]) or snippet("İade süresi", [["iade"], ["suresi"]])[1]
    assert snippet("nothing here", [["zzz"]]) == ("nothing here", []) and snippet("", [["a"]]) == ("", [])
    long, marks = snippet("w" * 500 + " end", [["end"]])
    assert len(long) == 400 and long.endswith("…") and all(b <= 399 for _, b in marks)


def test_snippets_equal_full_text_search(monkeypatch):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(content, headings, source_path, tokenize = 'unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this sqlite")
    monkeypatch.setattr(snippets, "MOST", 10**9)
    rnd, seen = random.Random(1), 0
    words = "alpha beta gamma delta eps zeta eta theta naïve İade x1 long_name".split()
    gaps = [" "] * 8 + [". ", ": ", ".\n", "! ", ", ", "  ", ".)", " (", ".", ":\t", "\n\n"]
    for _ in range(1500):
        body = "".join(rnd.choice(words + ["filler"] * rnd.choice([1, 30])) + rnd.choice(gaps) for _ in range(rnd.choice([0, 3, 10, 31, 32, 33, 40, 70, 150])))
        parts = [rnd.choice([*words, "alpha beta", "beta gamma delta", "filler alpha"]) for _ in range(rnd.choice([1, 2, 3]))]
        con.execute("delete from t")
        con.execute("insert into t values (?, '', ?)", (body, " ".join(parts)))
        want = con.execute("select snippet(t, 0, '\1', '\2', '…', 32) from t where t match ?", (" AND ".join(f'"{p}"' for p in parts),)).fetchone()
        if want:
            got, ranges = snippet(body, [[snippets.fold_term(m[0]) for m in snippets._term().finditer(p)] for p in parts])
            for a, b in reversed(ranges):
                got = got[:a] + "\1" + got[a:b] + "\2" + got[b:]
            assert got == want[0]
            seen += 1
    assert seen > 1000


def test_rankings_do_not_depend_on_partitions(spark):
    rows = [(f"alpha beta {'gamma ' * (i % 7)}", "", f"f{i % 5}.md") for i in range(40)]
    asked = spark.createDataFrame([(1, "alpha gamma")], "query_id long, text string")
    out = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df, index, lengths = index_of(spark, rows)
        out.append([tuple(r) for r in lexical.search(index, lengths, df.repartition(n), asked, 10).orderBy("rank").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert out[0] == out[1] == out[2] and len(out[0]) == 10


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(list(product(entry.queries(), [0]))) > 50
