import base64
import random

from loamdex.llm import handwritten as h

FILES = "id long, source_path string, document_type string, run_id int, text string"
DOCS = "doc_id long, file_id long, text string, document_type string, source_path string"
PLAIN = "def f(x):\n    return x + 1\n\n\nclass A:\n    pass\n"


def kinds(text):
    return dict(zip(("generated", "vendored", "minified", "data", "denied"), h.evidence(text)[:5]))


def test_evidence_of_texts():
    rnd = random.Random(1)
    assert not any(kinds(PLAIN).values()) and not any(kinds(None).values()) and not any(kinds(" \n").values())
    for head in ("# Code generated by toolx. DO NOT EDIT.", "// <auto-generated />", "/* @generated by toolx 1.2 */", "-- This file was automatically produced from a.b; do not modify it by hand.", "# このファイルは自動生成されました。", "# Bu dosya otomatik olarak üretilmiştir, elle değiştirmeyin.", "# Internal module.\n\nx = 1\n\n# Generated on build from a.md. Manual edits are lost."):
        assert kinds(head + "\n" + PLAIN)["generated"], head
    for head in ("# Bundled copy of libx 2.1, unmodified.", "// Copyright (c) 2029 the libx contributors. All rights reserved.", "/*! libx v5.8 */", "# upstream: libx 2.1; pulled in for offline builds"):
        assert kinds(head + "\n" + PLAIN)["vendored"], head
        assert h.evidence(head + "\n" + PLAIN)[5] == ["libx"]
    for head in ("# Not generated, despite the name.", '# Writes the header "do not edit" into the files it generates.', "# Copyright (c) 2030 our own team.", "# We looked at vendored copies and chose to write this ourselves.", "# The generated report is sent to the desk.", "# Do not edit the order below, a and b depend on it.", "# TODO: stop using generated ids here"):
        found = kinds(head + "\n" + PLAIN)
        assert not (found["generated"] or found["vendored"]), head
    assert kinds("!function(e,t){" + "var a=e.b||{},c=[1,2];function u(l,m){return t(c,8)};" * 12 + "}()")["minified"]
    assert not any(kinds("x = [y for y in z if y.a and y.b > 17 and y.c not in (" + ", ".join(f'"word{k}"' for k in "abcdefghijklmnopqrst") + ")]\n" + PLAIN).values())
    assert kinds("T = [\n" + ",\n".join(", ".join(f"0x{rnd.randrange(256):02x}" for _ in range(12)) for _ in range(40)) + "]\n")["data"]
    assert kinds('B = """\n' + base64.b64encode(rnd.randbytes(3000)).decode() + '\n"""\n')["data"]
    assert kinds("\n".join(f"INSERT INTO t VALUES ({k},{k * 7},'{rnd.randbytes(4).hex()}');" for k in range(60)))["data"]
    assert kinds("\n".join(f"func (x *a) GetField{k}() int {{ return x.f{k}[8] + {k % 7} }}" for k in range(20)))["generated"]


def run(spark, files, docs):
    f = spark.createDataFrame([(i, p, t, 1, "clash") for i, p, t in files], FILES)
    d = spark.createDataFrame([(n, i, x, t, "clash") for n, (i, x, t) in enumerate(docs)], DOCS)
    return {r.file_id: r for r in h.unwritten_files(f, d).collect()}


def test_attribute_files_decide_by_depth_and_order(spark):
    s = "SOURCE_CODE"
    files = [(1, "p/.gitattributes", "PLAIN_TEXT"), (2, "p/sub/.gitattributes", "PLAIN_TEXT"), (3, "p/made/a.py", s), (4, "p/made/keep.py", s), (5, "p/sub/made/b.py", s), (6, "p/sub/x/y/z.py", s), (7, "q/made/a.py", s), (8, "p/vendor/own.py", s), (9, "p/sub/c.tab.py", s)]
    docs = [(1, "# c\nmade/** linguist-generated\nmade/keep.py -linguist-generated\n*.tab.py linguist-generated=true\nvendor/** -linguist-vendored\n", "PLAIN_TEXT"), (2, "made/** linguist-generated=false\r\nx/** linguist-vendored\r\n", "PLAIN_TEXT")]
    docs += [(i, PLAIN, s) for i in range(3, 10)]
    assert set(run(spark, files, docs)) == {3, 6, 9}


def test_attribute_lines_as_version_control_reads_them(spark):
    s, t = "SOURCE_CODE", "PLAIN_TEXT"
    rules = [
        ("made/", "a/made/x.py", None), ("made", "a/made/x.py", None), ("made/**", "a/made/x.py", True), ("**/made/**", "a/b/made/c/x.py", True), ("*.tab.py", "a/b/x.tab.py", True), ("/x.py", "a/x.py", True), ("/x.py", "a/b/x.py", None),
        ('"odd name.py"', "a/odd name.py", True), ('"\\303\\274.py"', "a/ü.py", True), ("st\\*r.py", "a/st*r.py", True), ("st\\*r.py", "a/star.py", None), ("[xy].py", "a/y.py", True), ("[!xy].py", "a/y.py", None), ("x?z.py", "a/x/z.py", None), ("!x.py", "a/x.py", None),
    ]
    for pattern, path, want in rules:
        got = [bool(h.glob_regex(p).match(path.partition("/")[2])) for p, _, _ in h.parse_attributes(pattern + " linguist-generated")]
        assert (got == [True]) == bool(want), (pattern, path)
    assert h.glob_regex("[z-a].py").match("b.py") is None
    assert list(h.parse_attributes("# c\n\n[attr]ours -linguist-vendored -diff\n*.py ours linguist-generated=true !text")) == [(None, "ours", {"linguist-vendored": "unset", "diff": "unset"}), ("*.py", None, {"ours": "set", "linguist-generated": "=true", "text": "unspecified"})]
    files = [(1, "p/.gitattributes", t), (2, "p/sub/.gitattributes", t), (3, "q/.gitattributes", t), (10, "p/lib/a.py", s), (11, "p/sub/lib/b.py", s), (12, "p/sub/own/c.py", s), (13, "q/lib/d.py", s), (14, "q/x.py", s), (15, "p/sub/gen/e.py", s), (16, "p/sub/un/f.py", s), (17, "p/all.py", s)]
    docs = [(1, "[attr]copied linguist-vendored -diff\n[attr]twice copied\n*.py linguist-generated\nlib/** copied\n", t), (2, "lib/** twice\nown/** -linguist-generated\nun/** !linguist-generated\n", t), (3, "lib/** copied\n", t)]
    docs += [(i, ("# @generated by t\n" if i == 17 else "") + PLAIN, s) for i in range(10, 18)]
    got = run(spark, files, docs)
    assert set(got) == {10, 11, 15, 17} and all(got[i].declared for i in got)  # a macro of one repository means nothing in another


def test_declarations_are_mined_for_other_repositories(spark):
    s, t = "SOURCE_CODE", "PLAIN_TEXT"
    files = [(1, "p/.gitattributes", t)] + [(10 + i, f"p/emitted/m{i}.py", s) for i in range(8)] + [(30, "q/emitted/x.py", s), (31, "q/plain/x.py", s)]
    files += [(40 + i, f"r/vendor/v{i}.py", s) for i in range(6)] + [(50, "s/deps/d.py", s)]
    docs = [(1, "emitted/** linguist-generated\n", t)] + [(i, PLAIN, s) for i, _, kind in files if kind == s]
    got = run(spark, files, docs)
    assert set(got) == {*range(10, 18), 30, 50}  # six files in vendor show nothing, one in deps is too few to tell
    assert got[30].by_mining and got[30].declared is None and not got[30].by_text and got[50].by_path


def test_paths_texts_and_mined_patterns(spark):
    s = "SOURCE_CODE"
    files = [(i, f"p{i}/emitted/m{i}.py", s) for i in range(10)] + [(20, "p/emitted/plain.py", s), (21, "p/emitted/denied.py", s), (30, "p/node_modules/a.js", s), (31, "p/vendor_portal/a.js", s), (32, "p/x/a.min.js", s), (33, "p/libx@4/a.js", s), (34, "p/x/nothing.js", s), (35, None, s), (36, "p/vendor/n.js", s), (37, "p/vendor/doc.md", "MARKDOWN")]
    docs = [(i, "# @generated by t 1.0\n" + PLAIN, s) for i in range(10)] + [(20, PLAIN, s), (21, "# Not generated, despite the name.\n" + PLAIN, s)]
    docs += [(30, PLAIN, s), (31, PLAIN, s), (32, "# Bundled copy of libx 1, unmodified.\n", s), (6, "# Bundled copy of libx 1, unmodified.\n", s), (33, PLAIN, s), (34, PLAIN, s), (35, PLAIN, s), (36, None, s), (37, PLAIN, "MARKDOWN")]
    got = run(spark, files + files[:5], docs + docs[:5])
    assert set(got) == {*range(10), 20, 30, 32, 33, 36}
    assert got[20].by_mining and not got[20].by_text and got[30].by_path
    assert run(spark, files, docs[:0]) == {}
    assert run(spark, files[:0], docs) == {}


def test_very_long_texts_take_linear_time():
    import time

    for text in ("x" * 300_000, "// " + "a b" * 100_000, '"' * 100_001, "'" * 100_001, "/* " + " " * 50_000, "A" * 39 + " " + "a1" * 100_000, ("word " * 20 + "\n") * 5_000, "{" * 100_000, "0x1f, " * 50_000):
        began = time.time()
        h.evidence(text)
        assert time.time() - began < 5
    assert kinds("/* banner */!function(e,t){" + "var a=e.b||{},c=[1,2];function u(l,m){return t(c,8)};" * 12 + "}()")["minified"]


def test_long_comments_are_searched_whole():
    import time

    licence = "".join(f"Permission is granted to use {w} text {w} times.\n" for w in "one two three four five six seven eight nine ten eleven twelve".split())
    long = "no warranty of any kind is given, " * 20
    for text in ("/*\n" + licence + "This file was generated by toolx\n*/\n", "/* " + long + "This file was generated by toolx */\n", "// " + long + "code generated by toolx\n", "/* a */\n/*\n" + licence + "This file was generated by toolx\n*/\n", "# " + long + "generated with toolx, " + long + "do not edit\n", "/*\r" + licence.replace("\n", "\r") + "@generated by toolx\r*/\r"):
        assert kinds(text + PLAIN)["generated"], text
    for text in ("/*\n" + licence + "Copyright (c) 2029 the libx contributors\n*/\n", "// Bundled copy of libx 2.1, " + long + "\n"):
        assert kinds(text + PLAIN)["vendored"] and h.evidence(text + PLAIN)[5] == ["libx"], text
    assert not any(kinds("/*\n" + licence + "*/\n" + PLAIN + "s = 'This file was generated by toolx'\n").values())
    for text in ("// " + "generated by x " * 20_000, "// generated by " + "x" * 300_000, "// " + "أُنشئ " * 60_000, "/*\n" * 100_000, "/* a */\n" * 50_000, "\n /" * 100_000, "# " + "*" * 200_000, "# a" + " " * 200_000 + "b", "// copyright " + "1 " * 100_000, "/*\n" + "generated by x " * 20_000 + "\n*/"):
        began = time.time()
        h.evidence(text)
        assert time.time() - began < 5, text[:20]
