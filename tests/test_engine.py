import json
import os
import shutil

import numpy as np
import pytest

from loamdex.cli import main
from loamdex.functions.text import EmbeddingProfile
from loamdex.operators import lexical, semantic
from loamdex.plans import engine as engine_module
from loamdex.plans.engine import Engine, QueryError, hit_text, result_json, score_text
from loamdex.sources.config import Config, ConfigError, find_project, parse_config, write_default
from loamdex.sources import files as source_files
from loamdex.sources.files import IgnoreRules, Vanished, admit, load, read_one, scan, scan_frame, stored_files
from loamdex.sources.storage import IndexAccessError, SnapshotStore, StorageFailure, storage_failure

FILES = {
    "docs/guide.md": "# Guide\n\nThe payment retry policy waits.\n\n## Limits\n\nRetries stop after five tries. Ödeme yapılır.\n",
    "src/Retry.java": "class PaymentRetryPolicy {\n    int maxAttempts = 5;\n}\n",
    "notes.txt": "A note about payment. The window closes.\n",
    "conf/app.yaml": "payment:\n  retry: 3\n",
}


@pytest.fixture
def project(tmp_path):
    for name, body in FILES.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "x.md").write_text("payment")
    return tmp_path


def toy_model():
    def embed(texts):
        out = np.zeros((len(texts), 8))
        for row, t in zip(out, texts):
            for w in t.lower().split():
                row[sum(map(ord, w)) % 8] += 1
            row[0] += 0.1
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return embed  # nested, so that workers get it by value


PROFILE = EmbeddingProfile("toy", "r1", "0" * 64, 8, "basic-tokens-v1", "0" * 64, 256)


def test_index_query_and_incremental_runs(spark, project):
    e = Engine(spark, str(project), buckets=4)
    assert e.preview()["decisions"]["NEW"]["files"] == 5
    first = e.index()
    assert first.status == "COMPLETE" and first.counts == {"NEW": 5} and first.version == 1 and first.chunks == 4
    got = e.query("payment retry")
    assert got.effective_mode == "lexical" and got.fallback["reason"] == "EMBEDDINGS_MISSING"
    assert {h["source_path"] for h in got.hits} == {"docs/guide.md", "conf/app.yaml"}
    hit = got.hits[0]
    assert [hit["snippet"][m["start"] : m["end"]] for m in hit["matches"]]
    assert e.query("odeme", mode="lexical").hits[0]["source_path"] == "docs/guide.md"
    assert e.query("...", mode="lexical").hits == []
    assert json.loads(result_json(got))["schemaVersion"] == 1 and hit_text(hit).startswith("1. ")
    again = e.index()
    assert again.counts == {"UNCHANGED": 5} and again.version == 1
    (project / "notes.txt").write_text("Entirely different words.\n")
    os.remove(project / "conf" / "app.yaml")
    (project / "bad.txt").write_bytes(b"\xc3\x28")
    part = e.index()
    assert part.status == "PARTIAL" and part.rejected == 1 and part.deleted == 0 and part.counts == {"UNCHANGED": 3, "CHANGED": 1} and part.chunks == 4
    os.remove(project / "bad.txt")
    done = e.index()
    assert done.status == "COMPLETE" and done.deleted == 1 and done.chunks == 3
    assert e.query("note about payment", mode="lexical").hits == []
    smaller = Engine(spark, str(project), Config(max_tokens=12, overlap_tokens=2))
    more = smaller.index()
    assert more.counts == {"RECHUNKED": 4} and more.chunks > 3
    batch = smaller.search(spark.createDataFrame([(1, "payment"), (2, "five tries")], "query_id long, text string")).collect()
    assert {r.query_id for r in batch} == {1, 2}


def test_semantic_and_hybrid(spark, project):
    e = Engine(spark, str(project), Config(semantic=True), model=toy_model(), profile=PROFILE, buckets=4)
    run = e.index()
    assert run.embedded == run.chunks == 4
    h = e.query("payment policy")
    assert h.effective_mode == "hybrid" and h.query_shape == "NATURAL_LANGUAGE" and h.coverage == {"embedded": 4, "stale": 0, "missing": 0}
    assert [x["rank"] for x in h.hits] == list(range(1, len(h.hits) + 1)) and len(h.hits) == 4
    assert [x["stable_id"] for x in e.query("payment policy", limit=2).hits] == [x["stable_id"] for x in h.hits][:2]
    s = e.query("payment policy", mode="semantic")
    assert all(-1 <= x["score"] <= 1 for x in s.hits) and s.hits[0]["matches"] == []
    assert e.query(" ".join(["word"] * 70), mode="hybrid").notices == ["LEXICAL_SIDE_SKIPPED"]
    other = Engine(spark, str(project), model=toy_model(), profile=EmbeddingProfile("toy", "r2", "0" * 64, 8, "a", "0" * 64, 256))
    with pytest.raises(QueryError) as x:
        other.query("payment", mode="semantic")
    assert x.value.reason == "EMBEDDINGS_OUTDATED"
    assert other.query("payment").fallback["reason"] == "EMBEDDINGS_OUTDATED"
    for text, limit, reason in ((" ", 10, "BLANK"), ("a\0b", 10, "NUL"), ("x" * 4097, 10, "TOO_LONG"), ("a", 0, "LIMIT"), ("a", 101, "LIMIT"), (" ".join(["w"] * 65), 10, "TOO_MANY_PARTS")):
        with pytest.raises(QueryError) as x:
            e.query(text, limit, "lexical")
        assert x.value.reason == reason


def test_every_failed_embedding_is_reported(spark, tmp_path):
    for i in range(130):
        (tmp_path / f"f{i}.txt").write_text("bad words" if i < 110 else "short words" if i < 115 else "good words")
    (tmp_path / "broken.txt").write_bytes(b"\xff\xfe\xff")
    good = toy_model()

    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [v[:3] if "short" in t else v for t, v in zip(texts, good(texts))]

    e = Engine(spark, str(tmp_path), Config(semantic=True), model=model, profile=PROFILE)
    done = e.index()
    assert (done.status, done.embedded, done.failed_embeddings, done.issue_count) == ("PARTIAL", 15, 115, 116)
    assert json.loads(result_json(done))["failed_embeddings"] == 115
    rows = e.problems.collect()
    assert {r.source_path for r in rows if r.kind == "embedding"} == {f"f{i}.txt" for i in range(115)} and len(rows) == 116
    assert all(r.chunk_id is not None and r.problem for r in rows if r.kind == "embedding")


def test_store_refuses_what_is_not_its_own(spark, tmp_path):
    with pytest.raises(IndexAccessError) as x:
        SnapshotStore(spark, str(tmp_path / "none"), "p").current()
    assert x.value.reason == "NOT_FOUND"
    s = SnapshotStore(spark, str(tmp_path / "s"), "p")
    s.create()
    assert s.current() is None
    with pytest.raises(IndexAccessError) as x:
        SnapshotStore(spark, str(tmp_path / "s"), "q").current()
    assert x.value.reason == "WRONG_PROJECT"
    df = spark.range(3)
    old = s.commit({"files": df})
    s.commit({"files": spark.range(5)})
    assert old.table("files").count() == 3 and s.current().table("files").count() == 5
    s.folder.write("CURRENT-000099", "99")
    with pytest.raises(IndexAccessError) as x:
        s.current()
    assert x.value.reason == "CORRUPT_INDEX"
    s.folder.write("meta-000099", '{"project": "p", "format": 99}')
    with pytest.raises(IndexAccessError) as x:
        s.current()
    assert x.value.reason == "INCOMPATIBLE"


def test_a_pointer_is_never_missing(spark, tmp_path, monkeypatch):
    s = SnapshotStore(spark, str(tmp_path / "s"), "p")
    s.create()
    s.commit({"files": spark.range(3)})

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr("loamdex.sources.storage.Folder.write", die)
        with pytest.raises(KeyboardInterrupt):
            s.commit({"files": spark.range(9)})
    assert s.current().number == 1 and s.current().table("files").count() == 3
    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "_tidy", die)
        with pytest.raises(KeyboardInterrupt):
            s.commit({"files": spark.range(5)})
    base = s.current()
    assert base.number == 2 and base.table("files").count() == 5
    s.commit({"files": spark.range(6)}, base=base)
    with pytest.raises(StorageFailure) as x:
        s.commit({"files": spark.range(7)}, base=base)
    assert x.value.reason == "BUSY" and s.current().table("files").count() == 6
    for n in range(12):
        s.commit({"files": spark.range(n)})
    kept = s.folder.names()
    assert s.current().table("files").count() == 11 and sum(n.startswith("CURRENT-") for n in kept) == s.keep
    assert not any(n in kept for n in ("v000001", "v000005", "CURRENT-000001"))


def test_a_changed_file_rewrites_its_bucket_only(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i}.txt").write_text(f"words of file {i} about payment")
    e = Engine(spark, str(tmp_path), buckets=16)
    e.index()
    (tmp_path / "f3.txt").write_text("zebra crossing")
    e.index()
    now = e.store.current()
    own = e._buckets(spark.createDataFrame([("f3.txt",)], "source_path string"))
    assert {b for b, v in now.buckets["postings"].items() if v == 2} == {str(own[0])} and now.number == 2
    assert now.totals() == (30, now.table("lengths").agg({"n_tokens": "sum"}).first()[0])
    assert [h["source_path"] for h in e.query("zebra", mode="lexical").hits] == ["f3.txt"] and len(e.query("payment", limit=100, mode="lexical").hits) == 29
    plan = lexical.wanted_terms(now.table("postings"), [["zebra"]])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,zebra)" in plan or "In(term, [zebra])" in plan


def test_an_index_of_the_format_before_is_migrated(spark, project):
    e = Engine(spark, str(project), buckets=4)
    e.index()
    now, old = e.store.current(), project / "old"
    for n in ("files", "chunks", "postings", "lengths", "vectors"):
        now.table(n).write.parquet(str(old / "v000003" / n))
    (old / "meta.json").write_text(json.dumps({"project": str(project), "format": 1}))
    (old / "CURRENT").write_text("3")
    f = Engine(spark, str(project), store=str(old))
    with pytest.raises(IndexAccessError) as x:
        f.query("payment", mode="lexical")
    assert x.value.reason == "MIGRATION_REQUIRED" and storage_failure(x.value) == "INCOMPATIBLE"
    again = f.index()
    assert again.counts == {"UNCHANGED": 5} and again.version == 4 and not (old / "CURRENT").exists() and not (old / "v000003").exists()
    assert [h["source_path"] for h in f.query("payment", mode="lexical").hits] == [h["source_path"] for h in e.query("payment", mode="lexical").hits]


def test_only_what_is_really_gone_is_removed(spark, project):
    for n in ("a/x.txt", "a/y.txt", "b/z.txt", "B2/w.txt", "conf/loamdex.toml", "k/link.txt", "k/dir.txt", "gone/deep/u.txt"):
        (project / n).parent.mkdir(parents=True, exist_ok=True)
        (project / n).write_text("payment")
    e = Engine(spark, str(project), buckets=4)
    assert e.index().counts == {"NEW": 12}

    def left():
        return {r.source_path for r in e.store.current().table("files").collect()}

    stored = left()
    assert "conf/loamdex.toml" not in stored
    e.config = Config(exclude=(*Config().exclude, "a/**"))
    assert e.index().deleted == 0
    os.remove(project / "a" / "x.txt")  # excluded by now: nobody looked for it
    assert e.index().deleted == 0 and left() == stored
    e.config = Config()
    assert e.index().deleted == 1 and left() == stored - {"a/x.txt"}
    (project / ".gitignore").write_text("y.txt\n")
    assert e.index().deleted == 0
    os.remove(project / "k" / "link.txt")
    os.remove(project / "k" / "dir.txt")
    os.symlink(project / "notes.txt", project / "k" / "link.txt")
    (project / "k" / "dir.txt").mkdir()
    assert e.index().deleted == 0
    os.rename(project / "B2" / "w.txt", project / "B2" / "W.txt")
    shutil.rmtree(project / "gone")
    os.remove(project / "b" / "z.txt")
    part = e.index(str(project / "b"))
    assert part.deleted == 1 and "gone/deep/u.txt" in left()
    done = e.index()
    assert done.deleted == 2 and {"B2/W.txt"} == {p for p in left() if p.startswith("B2")} and "gone/deep/u.txt" not in left()
    config = Vanished(str(project), str(project), Config())
    assert config("sub/loamdex.toml") and not config("notes.txt") and config("nowhere/n.txt") and not config("k/link.txt")


def test_a_path_that_comes_back_before_the_write_stays(spark, project, monkeypatch):
    e = Engine(spark, str(project), buckets=4)
    e.index()
    os.remove(project / "notes.txt")
    real, calls = source_files.vanished, []

    def late(candidates, *more):
        calls.append(1)
        if len(calls) == 2:
            (project / "notes.txt").write_text("back again")
        return real(candidates, *more)

    monkeypatch.setattr(source_files, "vanished", late)
    assert e.index().deleted == 0 and len(calls) == 2


def test_classes_of_storage_failures(spark, tmp_path):
    cases = {"DISK_FULL": OSError(28, "x"), "READ_ONLY": PermissionError(13, "x"), "IO_ERROR": OSError(5, "x"), "BUSY": FileExistsError(17, "x"), "CORRUPT": RuntimeError("a.parquet is not a Parquet file"), "OTHER": ValueError("x"), "WRONG_PROJECT": IndexAccessError("WRONG_PROJECT", "x")}
    assert {k: storage_failure(e) for k, e in cases.items()} == {k: k for k in cases}
    (tmp_path / "a.txt").write_text("words")
    e = Engine(spark, str(tmp_path))
    e.index()
    for f in (tmp_path / ".loamdex" / "index" / "v000001" / "files").rglob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / ".loamdex").rglob(".*.crc"):
        f.unlink()
    (tmp_path / "b.txt").write_text("words")
    with pytest.raises(StorageFailure) as x:
        e.index()
    assert x.value.reason == "CORRUPT"
    assert main(["index", str(tmp_path)], spark) == 1


def test_embedding_in_pages(spark, tmp_path, monkeypatch):
    for i in range(24):
        (tmp_path / f"f{i}.txt").write_text(f"words {i}")
    monkeypatch.setattr(engine_module, "PAGE", 1)
    good, lines = toy_model(), []

    def breaks(texts):
        if any("f7.txt" in t for t in texts):
            raise semantic.BrokenModel("gone")
        return good(texts)

    e = Engine(spark, str(tmp_path), Config(semantic=True), model=breaks, profile=PROFILE, buckets=8)
    part = e.index(progress=lambda name, _: lines.append(name))
    assert part.status == "PARTIAL" and part.stopped == "INVALID_MODEL" and part.embedded < 24 and part.chunks == 24
    e.model = good
    rest = e.index(progress=lambda name, _: lines.append(name))
    assert rest.status == "COMPLETE" and rest.embedded == 24 - part.embedded and any(x.startswith("embedding: ") for x in lines)
    for i in range(24):
        (tmp_path / f"f{i}.txt").write_text(f"other words {i}")

    def fails(texts):
        raise ValueError("refused")

    e.model = fails
    none = e.index()
    assert none.stopped == "INFERENCE_FAILED" and none.embedded == 0 and 0 < none.failed_embeddings < 24
    e.model = good
    long = e.query("word " * 60 + "end " * 60 + "word " * 150, mode="hybrid") if e.index().embedded == 24 else None
    assert "QUERY_CUT_TO_MODEL_INPUT" in long.notices


def test_scan_rules(spark, project, monkeypatch):
    (project / ".gitignore").write_text("*.log\nsecret/\n!keep.log\ndocs/*.tmp.md\n")
    (project / "docs" / ".gitignore").write_text("guide.md\n!deep/\n")
    (project / "docs" / "a.tmp.md").write_text("x")
    (project / "secret").mkdir()
    (project / "secret" / "s.md").write_text("x")
    os.symlink(project / "notes.txt", project / "link.txt")
    found = scan(str(project), str(project), Config())
    assert found.complete and found.files == ["conf/app.yaml", "empty.txt", "notes.txt", "src/Retry.java"]
    assert scan(str(project), str(project / "src"), Config()).files == ["src/Retry.java"]
    assert scan(str(project), str(project), Config(include=("**/*.MD",), exclude=())).files == ["target/x.md"]
    monkeypatch.setattr(source_files, "FOLDERS", 2)
    for target, config in ((project, Config()), (project / "src", Config()), (project / "notes.txt", Config()), (project / "secret", Config()), (project, Config(include=("**/*.MD",), exclude=()))):
        rows = scan_frame(spark, str(project), str(target), config).collect()
        assert sorted(r.source_path for r in rows) == scan(str(project), str(target), config).files and not any(r.issue for r in rows)
    r = IgnoreRules.parse("build/\n/top.txt\na/**/b\n\\#x\n*.py[co]\n")
    assert r.decide("x/build", True) and r.decide("x/build", False) is None and r.decide("top.txt", False) and r.decide("x/top.txt", False) is None
    assert r.decide("a/b", False) and r.decide("a/x/y/b", False) and r.decide("#x", False) and r.decide("m.pyc", False) and r.decide("m.py", False) is None


def test_admission(spark, tmp_path):
    cases = {"a.txt": (b"", None), "b.txt": (b"\xef\xbb\xbfhi", None), "c.txt": (b"\xc3\x28", "INVALID_UTF8"), "d.txt": (b"a\0b", "BINARY_CONTENT"), "e.txt": (b"\x01\x02\x03\x04abc", "BINARY_CONTENT"), "f.txt": (b"x" * 65, "TOO_LARGE"), "g.txt": (b"x" * 64, None), "h.txt": (b"\xed\xa0\x80", "INVALID_UTF8"), "i.txt": (b"\xff\xfea\0", "INVALID_UTF8"), "j.txt": (b"\xc0\xaf", "INVALID_UTF8")}
    for name, (body, _) in cases.items():
        (tmp_path / name).write_bytes(body)
    os.symlink(tmp_path / "a.txt", tmp_path / "l.txt")
    got = {r.source_path: r for r in admit(load(spark, str(tmp_path), [*cases, "l.txt", "gone.txt"], 64)).collect()}
    assert {n: got[n].problem for n in cases} == {n: p for n, (_, p) in cases.items()}
    assert got["b.txt"].content == "hi" and got["l.txt"].problem == "NOT_REGULAR_FILE" and got["gone.txt"].problem == "READ_FAILED"
    assert read_one(str(tmp_path / "g.txt"), 10)[2] == "TOO_LARGE"
    os.remove(tmp_path / "l.txt")
    other = {r.source_path: r.problem for r in admit(stored_files(spark, str(tmp_path), Config(max_file_bytes=64))).collect()}
    assert other == {n: p for n, (_, p) in cases.items() if n != "a.txt"}


def test_settings(tmp_path):
    c = parse_config('﻿[index]\nexclude = ["**/x/**"]\n[chunk]\nmax_tokens = 100\nmax_token = 3\n[zzz]\nqqqqqq = 1\n')
    assert c.exclude == ("**/x/**",) and c.max_tokens == 100 and "did you mean chunk.max_tokens" in c.warnings[0] and len(c.warnings) == 2
    for bad in ("[chunk]\nmax_tokens = 300", "[chunk]\noverlap_tokens = 254", "[search]\nmode = 'x'", "[index]\ninclude = 'a'", "[index]\nmax_file_bytes = 3000000000", "[store]\npath = '../x'", "x = ", "[semantic]\nenabled = 1"):
        with pytest.raises(ConfigError):
            parse_config(bad)
    write_default(str(tmp_path / "loamdex.toml"))
    assert parse_config((tmp_path / "loamdex.toml").read_text()) == Config()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert find_project(str(tmp_path / "a" / "b"))[0] == str(tmp_path)


def test_command_line(spark, project, capsys):
    root = str(project)
    assert main(["init", root]) == 0 and main(["init", root]) == 2
    assert main(["query", "payment", "--root", root], spark) == 1
    assert main(["index", root, "--dry-run"], spark) == 0 and main(["index", root, "--json", "--progress"], spark) == 0
    capsys.readouterr()
    assert main(["query", "payment", "--root", root, "--json", "--mode", "lexical"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["hits"]) == 3
    assert main(["query", " ", "--root", root], spark) == 2 and main(["nonsense"]) == 2


def test_scores_as_text():
    assert [score_text(x) for x in (0.0163934, -12.345, 1234.5, 0.00000123, 0)] == ["0.0164", "-12.3", "1234", "0.00000123", "0"]
