import math
from collections import Counter

import numpy as np

from loamdex.llm import bpe, mixture

DOCS = "doc_id long, text string, source string, seed int"


def corpus():
    rows = []
    for i in range(240):
        source = [" Big ", "big", "BIG", "mid-one", "Mid_one", "small"][i % 6] if i % 40 else "unlisted"
        rows.append((i, f"document {i} " + "some words and more of them " * (1 + i % 90), source, 0))
    return rows + [(900, None, "big", 0), (901, "", "big", 0), (902, "no source", None, 0)]


def test_shares_caps_and_content(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK", 64)
    monkeypatch.setattr(mixture, "SHARD_SLOTS", 50)
    docs = spark.createDataFrame(corpus(), DOCS).repartition(3)
    targets = spark.createDataFrame([("big", 0.3, 1.0), ("mid_one", 0.4, 3.0), ("small", 0.2, 2.0), ("absent", 0.1, 2.0)], "source string, target_share double, max_repeats double")
    mixed, shares = mixture.mix(docs, targets)
    rows, said = mixed.collect(), {r.source: r for r in shares.collect()}
    enc = bpe.CorpusEncoder(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    total = Counter()
    for _, text, source, _ in corpus():
        name = (source or "").strip().lower().replace("-", "_")
        total[name] += len(enc.encode([text])[0])
    used, times = Counter(), Counter()
    for r in rows:
        used[r.source] += len(r.ids)
        times[r.source, r.block_no] += 1
        assert len(r.ids) == min(64, total[r.source] - 64 * r.block_no)
    for r in targets.collect():
        s = said[r.source]
        assert s.tokens == total[r.source] and s.used == used[r.source] <= r.max_repeats * total[r.source]
        if r.source != "absent":
            assert abs(s.actual_share - r.target_share / 0.9) < 0.02
    assert said["absent"].used == 0
    for (s, b), n in times.items():
        assert n <= math.ceil(said[s].max_repeats)
    assert max(u / t for u, t in ((said[s].used, said[s].max_repeats * total[s]) for s in ("big", "mid_one", "small"))) > 0.9
    slots = Counter((r.shard, r.slot) for r in rows)
    assert max(slots.values()) == 1 and len({r.shard for r in rows}) > 2
    again = mixture.mix(docs, targets)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_blocks_hold_the_stream(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK", 64)
    docs = spark.createDataFrame(corpus(), DOCS)
    targets = spark.createDataFrame([("small", 1.0, 1.0)], "source string, target_share double, max_repeats double")
    rows = mixture.mix(docs, targets)[0].collect()
    enc = bpe.CorpusEncoder(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    want = Counter(x for _, t, s, _ in corpus() if s == "small" for x in enc.encode([t])[0])
    got = Counter(x for r in rows for x in r.ids)
    assert len({r.block_no for r in rows}) == len(rows)
    assert sum((want - got).values()) <= 64 and not got - want


def test_empty_tables(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    targets = spark.createDataFrame([("big", 1.0, 1.0)], "source string, target_share double, max_repeats double")
    mixed, shares = mixture.mix(docs.limit(0), targets)
    assert mixed.count() == 0 and [r.used for r in shares.collect()] == [0]
    mixed, shares = mixture.mix(docs, targets.limit(0))
    assert mixed.count() == 0 == shares.count()


def test_permutations():
    for n in (1, 2, 5, 64, 1000):
        p = mixture.permuted(np.arange(n), n, "k")
        assert sorted(p.tolist()) == list(range(n))
    assert mixture.permuted(np.arange(1000), 1000, "a").tolist() != mixture.permuted(np.arange(1000), 1000, "b").tolist()
