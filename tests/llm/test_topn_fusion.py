import math
import random

from pyspark.sql import functions as F

from loamdex.llm import fusion, topn

HIT = "hit_id long, query_id long, query_mode string, source_path string, chunk_index int, chunk_id long, score double, score_kind string, fused_ranks struct<lexical:int,semantic:int>, extra string"


def brute_top(rows, n):
    groups = {}
    for g, s, i in set(rows):
        groups.setdefault(g, []).append((s, i))
    return {(g, *x) for g, v in groups.items() for x in sorted(v)[:n]}


def test_top_n_hot_and_cold_groups_agree_with_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 6 + [f"g{k}" for k in range(9)] + [None]), float(rnd.randrange(40)), rnd.randrange(300)) for _ in range(4000)]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "g string, s double, i long").repartition(5)
    want = brute_top(rows, 7)
    for hot_rows in (10**9, 800, 1):
        got = topn.top_n_per_group(df, ["g"], [F.col("s"), F.col("i")], 7, hot_rows).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_the_threshold_follows_from_the_rows_of_a_partition(spark):
    rows = [("hot", float(i), i) for i in range(3000)] + [(f"g{i % 90}", 1.0, i) for i in range(900)] + [(None, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, s double, i long")
    hot = topn.hot_hashes(df, ["g"])
    assert hot == [df.filter("g = 'hot'").select(F.xxhash64("g")).first()[0]]
    assert topn.hot_hashes(df.filter("g <> 'hot'"), ["g"]) == topn.hot_hashes(df.limit(0), ["g"]) == []
    best = topn.top_n_per_group(df, ["g"], [F.col("s"), F.col("i")], 2)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Union" in plan
    assert {tuple(r) for r in best.collect()} == brute_top(rows, 2)


def test_top_n_of_nothing_and_empty_tables(spark):
    df = spark.createDataFrame([], "g string, s double, i long")
    assert topn.top_n_per_group(df, ["g"], [F.col("s"), F.col("i")], 3).count() == 0
    one = spark.createDataFrame([("a", 1.0, 1)], "g string, s double, i long")
    assert topn.top_n_per_group(one, ["g"], [F.col("s"), F.col("i")], 0).count() == 0


def test_positions_of_hot_groups_are_exact(spark):
    rnd = random.Random(4)
    rows = [("hot" if k % 3 else f"g{k % 7}", rnd.random(), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, i long").repartition(6)
    want = {}
    for g in {r[0] for r in rows}:
        for p, r in enumerate(sorted((s, i) for h, s, i in rows if h == g)):
            want[r[1]] = p + 1
    for hot_rows in (10**9, 500):
        got = topn.positions(df, ["g"], [F.col("s"), F.col("i")], "p", hot_rows).collect()
        assert {r["i"]: r["p"] for r in got} == want and len(got) == 3000


def hits(spark):
    rnd = random.Random(5)
    rows = []
    for q in range(12):
        for mode in (["hybrid"] if q % 3 == 0 else ["lexical", "semantic"][: 1 + (q % 3)]):
            for c in rnd.sample(range(40), 15):
                score = rnd.choice([None, math.nan, 1.0, 2.0, rnd.random()])
                ranks = None
                if mode == "hybrid":
                    ranks = rnd.choice([(rnd.randrange(1, 20), None), (None, rnd.randrange(1, 20)), (rnd.randrange(1, 20), rnd.randrange(1, 20))])
                rows.append((len(rows), q, mode, f"p{c % 5}", c, c, score, "k", ranks, "x"))
    rows += rows[::7] + [(9999, None, "lexical", "p", 1, 1, 1.0, "k", None, "x")]
    return rows, spark.createDataFrame(rows, HIT)


def brute_places(rows):
    sides = {}
    for hid, q, mode, path, ci, c, score, _, ranks, _ in set(rows):
        if q is None:
            continue
        if mode == "hybrid":
            for m, p in zip(("lexical", "semantic"), ranks):
                if p is not None:
                    sides.setdefault((q, m), []).append((p, c))
    for q, mode in {(r[1], r[2]) for r in rows if r[2] != "hybrid" and r[1] is not None}:
        own = sorted({((r[6] if mode == "lexical" else -r[6]), r[3], r[4], r[5], r[0]) for r in rows if (r[1], r[2]) == (q, mode) and r[6] is not None and not math.isnan(r[6])})
        sides[q, mode] = [(p + 1, x[3]) for p, x in enumerate(own)]
    out = {}
    for q in {k[0] for k in sides}:
        if (q, "lexical") in sides and (q, "semantic") in sides:
            place = [{}, {}]
            for d, m in zip(place, ("lexical", "semantic")):
                for p, c in sides[q, m]:
                    d[c] = min(p, d.get(c, p))
            most = [max(d.values()) for d in place]
            out[q] = {c: tuple(d.get(c, m + 1) for d, m in zip(place, most)) for c in place[0].keys() | place[1].keys()}, most
    return out


def test_fusion_agrees_with_brute_force(spark):
    rows, df = hits(spark)
    want = brute_places(rows)
    for hot_rows in (10**9, 5):
        places = fusion.side_places(df, hot_rows).cache()
        first = {r["query_id"]: r["chunk_id"] for r in fusion.first_of_each(places, "query_id", "chunk_id", ["lexical", "semantic"]).collect()}
        assert first.keys() == want.keys()
        for q, c in first.items():
            assert sum(want[q][0][c]) == min(sum(v) for v in want[q][0].values())
        ranked = fusion.leximin_ranking(places, "query_id", "chunk_id", ["lexical", "semantic"]).collect()
        for q, (all_places, most) in want.items():
            key = {c: sorted((m + 1 - p) / m for p, m in zip(v, most)) for c, v in all_places.items()}
            order = sorted(key, key=lambda c: ([-x for x in key[c]], c))
            assert [r["chunk_id"] for r in sorted((r for r in ranked if r["query_id"] == q), key=lambda r: r["rank"])] == order
        places.unpersist()


def test_fusion_of_an_empty_table(spark):
    assert fusion.first_of_each(fusion.side_places(spark.createDataFrame([], HIT)), "query_id", "chunk_id", ["lexical", "semantic"]).count() == 0
