import glob
import json
import random

import pytest

from loamdex.operators import batch, lexical
from loamdex.plans import retrieval
from loamdex.session import shared_dir

CHUNKS = "id long, file_id long, chunk_index int, content string, start_line int, end_line int"


def shuffled(spark):
    """Bytes that all shuffles of the session have written."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite()


def stored(spark, folder, chunks, queries):
    spark.createDataFrame(chunks, CHUNKS).write.parquet(f"{folder}/chunks.parquet")
    spark.createDataFrame([(1, "a/one.md"), (2, "b/two.md")], "id long, source_path string").write.parquet(f"{folder}/files.parquet")
    spark.createDataFrame(queries, "query_id long, text string").write.parquet(f"{folder}/search_queries.parquet")
    return str(folder)


def frequent(spark, folder):
    """1,500 chunks of which every second has any word, and all pairs of 40 words as queries, each of them twice: 585,000 hits before they are cut."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    chunks = [(i, 1 + i % 2, i, " ".join(rnd.sample(words, 20)), i, i) for i in range(1500)]
    pairs = [f"{a} {b}" for a in words for b in words if a < b]
    return stored(spark, folder, chunks, list(enumerate(pairs * 2)))


def test_bm25_batch_topk_shuffles_no_hit_that_is_cut(spark, tmp_path):
    folder = frequent(spark, tmp_path)
    before = shuffled(spark)
    assert retrieval.QUERIES["bm25_batch_topk"](spark, folder).count() == 1560 * 10
    assert shuffled(spark) - before < 600_000


def test_hits_json_shuffles_no_hit_that_is_cut(spark, tmp_path):
    folder = frequent(spark, tmp_path)
    before = shuffled(spark)
    rows = retrieval.QUERIES["hits_json"](spark, folder).collect()
    assert shuffled(spark) - before < 1_000_000
    got = {r.query_id: json.loads(r.json)["hits"] for r in rows}
    assert len(rows) == len(got) == 1560 and all([h["rank"] for h in hits] == [1, 2, 3] for hits in got.values())
    assert all(got[i] == got[i + 780] for i in range(780))


def test_snippet_and_matches_shuffles_no_hit_that_is_cut(spark, tmp_path):
    folder = frequent(spark, tmp_path)
    before = shuffled(spark)
    rows = retrieval.QUERIES["snippet_and_matches"](spark, folder).collect()
    assert shuffled(spark) - before < 1_000_000
    assert len({(r.query_id, r["rank"]) for r in rows}) == len(rows) == 1560 * 3 and all(len(r.matches) == 2 for r in rows)


def test_snippet_and_matches_shuffles_only_texts_that_are_shown(spark, tmp_path):
    rnd = random.Random(7)
    chunks = [(i, 1 + i % 2, i, f"w{i % 500} " + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=4000)), i, i) for i in range(2000)]
    folder = stored(spark, tmp_path, [*chunks, *chunks[:20]], [(i, f"w{i}") for i in range(20)])
    before = shuffled(spark)
    rows = retrieval.QUERIES["snippet_and_matches"](spark, folder).collect()
    assert shuffled(spark) - before < 1_500_000  # the texts: 8 MB; those shown: 0.25 MB
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in rows) == [(q, k + 1, c) for q in range(20) for k, c in enumerate(sorted(range(q, 2000, 500), key=lambda c: (c % 2, c))[:3])]


def test_no_matches_stay_behind_a_search(spark, tmp_path):
    folder = stored(spark, tmp_path, [(i, 1, i, "some words", 1, 1) for i in range(9)], [(1, "words"), (2, "some words")])
    left = set(glob.glob(f"{shared_dir(spark)}/*/matches-*"))
    assert retrieval.QUERIES["snippet_and_matches"](spark, folder).count() == 6
    assert set(glob.glob(f"{shared_dir(spark)}/*/matches-*")) == left


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_search_by_files_equals_the_search_of_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(lexical, "SIEVE", bits)
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma_1", "x", "one"]
    each = [(rnd.choice([None, *range(150)]), rnd.choice([None, 1, 2, 3, 9]), rnd.randrange(3), rnd.choice([None, " ".join(rnd.choices(words, k=rnd.randrange(1, 9)))]), rnd.choice([None, [rnd.choice(words)]]), 1, rnd.randrange(9)) for _ in range(400)]
    chunks = spark.createDataFrame(each, "id long, file_id long, chunk_index int, content string, heading_path array<string>, start_line int, end_line int")
    files = spark.createDataFrame([(1, "a/one.md"), (1, "a/alpha.md"), (2, "gamma/x_1.md"), (3, None), (None, "beta.md")], "id long, source_path string")
    alone = lexical.single_rows_in_place(chunks)
    assert sorted(alone.collect(), key=str) == sorted(lexical.single_rows(chunks).collect(), key=str)
    asked = batch.distinct_queries(spark.createDataFrame([*enumerate(["alpha", "gamma-1 x", "one", "md alpha", "a_one", "gamma_x"])], "query_id long, text string"))
    got = batch.search(alone, asked, 40, paths=lexical.file_paths(files)).collect()
    assert sorted(got, key=str) == sorted(batch.search(lexical.index_rows(chunks, files), asked, 40).collect(), key=str) and len(got) > 60


def test_sifted_rows_lose_no_key(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SIEVE", 1 << 12)
    rows = lexical.sifted(spark.range(-1000, 3000), "id", spark.range(-5, 200, 3).union(spark.range(5))).collect()
    may = {r.id for r in rows if r._may}
    assert len(rows) == 4000 and may >= {*range(-5, 200, 3), *range(5)} and len(may) < 250
    assert not any(r._may for r in lexical.sifted(spark.range(50), "id", spark.range(0)).collect())


@pytest.mark.parametrize("block, held", [(65_536, 2_000_000), (7, 40)])
def test_batch_search_equals_the_search_of_an_index(spark, monkeypatch, block, held):
    monkeypatch.setattr(batch, "BLOCK", block)
    monkeypatch.setattr(batch, "MATCHES", held)
    rnd = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta_eps", "naïve", "the", "a_a_a", "İstanbul"]
    rows = [(i, i % 7, i, *(" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 4, 12]))) for _ in range(2)), f"{'ab'[i % 2]}/gamma_{i % 5}.md", 1, 1) for i in range(300)]
    df = spark.createDataFrame([*rows, (300, 1, 0, None, None, "a/x.md", 1, 1)], "chunk_id long, file_id long, chunk_index int, content string, headings string, source_path string, start_line int, end_line int")
    texts = [" ".join(rnd.choice([*words, "beta-gamma", "a_a", "alpha_the_beta"]) for _ in range(rnd.choice([1, 1, 2, 3]))) for _ in range(60)] + ["beta beta", "nothing", "-- !", "", "md", " ".join(["beta"] * 65)]
    queries = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "beta"), (99, None)], "query_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        asked = batch.distinct_queries(queries)
        assert asked.select("ask").distinct().count() < asked.count()
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.source_path, r.chunk_index, round(r.score, 9)) for r in batch.search(df, asked, 5, digits=9).join(asked, "ask").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    scores = lexical.bm25_scores(lexical.postings(df), lexical.totals(lexical.chunk_lengths(df)), queries)
    want = {(r.query_id, r["rank"]): (r.chunk_id, r.source_path, r.chunk_index, round(r.score, 9)) for r in lexical.top_hits(scores, df, 5, digits=9).collect()}
    assert got == want and len(got) > 150


def test_batch_search_of_nothing(spark, tmp_path):
    folder = stored(spark, tmp_path, [(1, 1, 0, "x", 1, 1)], [(1, "nothing"), (2, "..."), (3, None)])
    assert retrieval.QUERIES["bm25_batch_topk"](spark, folder).count() == 0
    none = stored(spark, tmp_path / "none", [], [])
    assert retrieval.QUERIES["bm25_batch_topk"](spark, none).count() == 0


def test_one_of_two_rows_under_an_id_is_always_the_same(spark):
    rows = [(1, 2, 0, "later", 1, 1), (1, 1, 0, "first", 1, 1)]
    files = spark.createDataFrame([(1, "a.md"), (2, "b.md")], "id long, source_path string")
    for some in (rows, rows[::-1]):
        got = lexical.index_rows(spark.createDataFrame(some, CHUNKS), files).collect()
        assert [(r.chunk_id, r.file_id, r.content, r.source_path) for r in got] == [(1, 1, "first", "a.md")]
