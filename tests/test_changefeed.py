import random
from datetime import datetime, timedelta

import pytest

from loamdex.operators.incremental import pending_paths
from loamdex.session import fresh_dir
from loamdex.streaming.changefeed import ChangeFeed

LOG = "path string, seq long, v string, batch string"


def feed(spark):
    return ChangeFeed(spark, fresh_dir(spark, "t"), "path", "seq", partitions=4)


def log(spark, rows):
    return spark.createDataFrame([(p, s, v, "clash") for p, s, v in rows], LOG)


def test_each_record_once_and_only_new_ones(spark):
    f = feed(spark)
    rows = [(f"p{i % 5}", i, f"v{i}") for i in range(20)] + [(None, 3, "x"), ("p1", None, "y")]
    assert f.sink() is None and f.run(log(spark, [])) == 0
    assert f.run(log(spark, rows + rows[:4])) == 1 and f.run(log(spark, rows)) == 0
    more = rows + [("p1", 100, "new"), ("q", 101, "new")]
    seen = []

    def work(df):
        seen.extend(r.seq for r in df.collect())
        return df

    assert f.run(log(spark, more), work) == 1
    assert sorted(seen) == [100, 101]
    assert sorted((r.path, r.seq, r.v) for r in f.sink().collect()) == sorted(r for r in more if None not in r)


@pytest.mark.parametrize("where", ["work", "written", "commit"])
def test_a_run_that_dies_is_replayed_exactly(spark, where, monkeypatch):
    f = feed(spark)
    rows = [(f"p{i % 3}", i, "a") for i in range(12)]
    f.run(log(spark, rows))
    newer = rows + [(f"p{i % 3}", i, "b") for i in range(12, 20)]

    class Died(Exception):
        pass

    def die(*_):
        raise Died

    def half(df):
        raise Died

    real = ChangeFeed._write
    if where == "written":
        monkeypatch.setattr(ChangeFeed, "_write", lambda self, b, r: (real(self, b, r), die()))
    if where == "commit":
        monkeypatch.setattr(ChangeFeed, "_commit", die)
    with pytest.raises(Died):
        f.run(log(spark, newer), half if where == "work" else lambda df: df)
    monkeypatch.undo()
    assert sorted(r.seq for r in f.sink().collect()) == list(range(12))
    newest = newer + [("p0", 50, "c")]
    batches = []
    g = ChangeFeed(spark, f.folder, "path", "seq", partitions=4)
    assert g.run(log(spark, newest), lambda df: (batches.append(sorted(r.seq for r in df.collect())), df)[1]) == 2
    assert batches == [list(range(12, 20)), [50]]
    assert sorted(r.seq for r in g.sink().collect()) == [*range(20), 50]


def test_a_stream_is_followed(spark, tmp_path):
    f = feed(spark)
    source = str(tmp_path / "log")
    log(spark, [(f"p{i % 3}", i, "a") for i in range(9)]).write.parquet(source)
    for extra in ([], [("p1", 20, "b"), ("q", 21, "b")], []):
        if extra:
            log(spark, extra).write.mode("append").parquet(source)
        stream = spark.readStream.schema("path string, seq long, v string, batch string").parquet(source)
        f.follow(stream).awaitTermination(120)
    assert sorted(r.seq for r in f.sink().collect()) == [*range(9), 20, 21]


def test_late_records_at_or_below_the_mark_are_not_lost(spark, tmp_path):
    f = ChangeFeed(spark, fresh_dir(spark, "t"), "path", "seq", partitions=1)
    rows = [("a", 100, "x")]
    assert f.run(log(spark, rows)) == 1
    rows += [("b", 60, "x"), ("b", 100, "x"), ("a", 7, "x")]
    seen = []
    assert f.run(log(spark, rows + rows), lambda df: (seen.extend((r.path, r.seq) for r in df.collect()), df.filter("seq <> 60"))[1]) == 1
    assert set(seen) == {("b", 60), ("b", 100), ("a", 7)}
    assert f.run(log(spark, rows)) == 0 and f.committed() == {0: 100}
    assert sorted((r.path, r.seq) for r in f.sink().collect()) == [("a", 7), ("a", 100), ("b", 100)]

    g = ChangeFeed(spark, fresh_dir(spark, "t"), "path", "seq", partitions=1)
    source = str(tmp_path / "log")
    for part in ([("a", 100, "x")], [("b", 60, "x")]):
        log(spark, part).write.mode("append").parquet(source)
        g.follow(spark.readStream.schema(LOG).parquet(source)).awaitTermination(120)
    assert sorted((r.path, r.seq) for r in g.sink().collect()) == [("a", 100), ("b", 60)]


def test_only_partitions_with_late_records_are_compared_with_history(spark, monkeypatch):
    f = ChangeFeed(spark, fresh_dir(spark, "t"), "path", "seq", partitions=8)
    compared = []
    real = ChangeFeed._look
    monkeypatch.setattr(ChangeFeed, "_look", lambda self, log, marks: (found := real(self, log, marks), compared.append(found[1]))[0])
    rows = [(f"p{i}", 10 * i, "x") for i in range(1, 30)]
    assert f.run(log(spark, rows)) == 1 and f.run(log(spark, rows)) == 0
    rows += [(f"p{i}", 1000 + i, "x") for i in range(1, 30)]
    assert f.run(log(spark, rows)) == 1
    assert compared == [[], [], []]
    late = ("p3", 5, "late")
    assert f.run(log(spark, [*rows, late])) == 1 and len(compared[-1]) == 1
    assert f.run(log(spark, [*rows, late])) == 0 and compared[-1] == []
    assert f.run(log(spark, [*rows, late, late])) == 0 and len(compared[-1]) == 1  # a repeated record looks late once
    assert f.run(log(spark, [*rows, late, late])) == 0 and compared[-1] == []
    assert sorted((r.path, r.seq) for r in f.sink().collect()) == sorted((p, s) for p, s, _ in [*rows, late])


def test_merged_batches_hold_the_same_rows(spark):
    f = ChangeFeed(spark, fresh_dir(spark, "t"), "path", "seq", partitions=2)
    rows = []
    f.compact()
    for turn in range(5):
        rows += [(f"p{i}", 10 * turn + i, "x") for i in range(3)]
        if turn == 3:
            rows.append(("p0", 1, "late"))
        assert f.run(log(spark, rows)) == 1
        if turn in (1, 2, 4):
            f.compact()
            assert f.run(log(spark, rows)) == 0
        assert sorted((r.path, r.seq) for r in f.sink().collect()) == sorted((p, s) for p, s, _ in rows)
    assert len(f.plans.names()) == len(f.commits.names()) == 1
    assert f.run(log(spark, [*rows, ("p2", 3, "x"), ("p0", 1, "late")])) == 1
    assert f.sink().count() == len(rows) + 1


def test_a_replay_leaves_out_what_came_after_the_plan(spark):
    f = ChangeFeed(spark, fresh_dir(spark, "t"), "path", "seq", partitions=1)
    rows = [("a", 10, "x"), ("a", 90, "x")]
    assert f.next_batch(log(spark, rows)).number == 0
    batches = []
    assert f.run(log(spark, rows + [("b", 50, "x")]), lambda df: (batches.append(sorted(r.seq for r in df.collect())), df)[1]) == 2
    assert batches == [[10, 90], [50]]


def test_pending_paths_agree_with_brute_force(spark):
    rnd = random.Random(8)
    t = datetime(2030, 1, 1)
    runs = [(1, "COMPLETE", "v1"), (2, "FAILED", "v2"), (3, "PARTIAL", "v2"), (4, "RUNNING", "v2")]
    names = [f"P{i}" for i in range(40)] + ["p1", "ü/東"]
    scans, files, profiles = [], [], []
    for n in names:
        for _ in range(rnd.choice([0, 1, 1, 3])):
            scans.append((len(scans), 4, n, rnd.choice([None, "AB", "ab", "cd"]), t + timedelta(rnd.randrange(3))))
    for i, n in enumerate(names):
        for r in rnd.sample([1, 2, 3], rnd.randrange(4)):
            files.append((i, n, r, rnd.choice(["ab", "cd"])))
            if rnd.random() < 0.8:
                profiles.append((i, r, rnd.choice(["v1", "v2", "v2"])))
    want = set()
    for n in names:
        own = sorted((s[4], s[0], s[3]) for s in scans if s[2] == n)
        if not own or own[-1][2] is None:
            continue
        stored = sorted((r, h, i) for i, m, r, h in files if m == n and r in (1, 3))
        if stored and stored[-1][1] == own[-1][2].lower() and (stored[-1][2], stored[-1][0], "v2") in profiles:
            continue
        want.add(n)
    frames = [
        spark.createDataFrame(scans + scans[:5] + [(900, 4, None, "ab", t)], "scan_id long, run_id int, source_path string, content_hash string, scanned_at timestamp_ntz"),
        spark.createDataFrame(files + files[:3], "id long, source_path string, run_id int, content_hash string"),
        spark.createDataFrame(profiles + profiles[:3], "file_id long, run_id int, chunking_version string"),
        spark.createDataFrame(runs, "run_id int, status string, chunking_version string"),
    ]
    got = [r.source_path for r in pending_paths(*frames).collect()]
    assert set(got) == want and len(got) == len(want)
    assert pending_paths(frames[0].limit(0), *frames[1:]).count() == 0
    assert pending_paths(*frames[:3], frames[3].limit(0)).count() == 0
    assert {r.source_path for r in pending_paths(frames[0], frames[1].limit(0), *frames[2:]).collect()} >= want
