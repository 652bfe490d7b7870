import re

import pytest

from loamdex.llm.sentences import sentence_units, units

CASES = [
    ("See Fig. 3 and Sec. 2 for it. Dr. Roe left at 5 p.m. Then he slept.", ["See Fig. 3 and Sec. 2 for it.", "Dr. Roe left at 5 p.m.", "Then he slept."]),
    ('The log says "Stop. Try again." and goes on. It took 3.5 s.', ['The log says "Stop. Try again." and goes on.', "It took 3.5 s."]),
    ('It ends with "no file." The next one starts.', ['It ends with "no file."', "The next one starts."]),
    ('Was it "now!" or "never!" that it printed? Yes.', ['Was it "now!" or "never!" that it printed?', "Yes."]),
    ("Im Log steht „Halt. Noch einmal.“ und es läuft. Am 21. Mai endet es. Das sind ca. 3 Mio. Zeilen.", ["Im Log steht „Halt. Noch einmal.“ und es läuft.", "Am 21. Mai endet es.", "Das sind ca. 3 Mio. Zeilen."]),
    ("Notizen, Skripte usw. Das ist alles.", ["Notizen, Skripte usw.", "Das ist alles."]),
    ("Bu işlemin 7. adımı bekler. a/b.py yoksa durur! Notlar vb. öğeleri okur mı? Evet.", ["Bu işlemin 7. adımı bekler.", "a/b.py yoksa durur!", "Notlar vb. öğeleri okur mı?", "Evet."]),
    ("¿Por qué? El valor aprox. es 2, p. ej. aquí. ¡Nadie!", ["¿Por qué?", "El valor aprox. es 2, p. ej. aquí.", "¡Nadie!"]),
    ("記録には「報告する。もう一度。」とある。なぜx.yは0.5を返すのか？誰だ！？次。", ["記録には「報告する。もう一度。」とある。", "なぜx.yは0.5を返すのか？", "誰だ！？", "次。"]),
    ("读取器……跳过键。路径提示“停止。再试。”然后跳过。", ["读取器……跳过键。", "路径提示“停止。再试。”然后跳过。"]),
    ("हम जाते हैं। क्या वह आया? हाँ!", ["हम जाते हैं।", "क्या वह आया?", "हाँ!"]),
    ("الإصدار v4.1 يحفظ. يقول «قف. أعد.» ثم يكمل. لماذا؟ نعم", ["الإصدار v4.1 يحفظ.", "يقول «قف. أعد.» ثم يكمل.", "لماذا؟", "نعم"]),
    ("ตัวกรองใช้เวลา 2.71 วินาที คิวบันทึก name_x แล้ว ชั้นอ่าน", ["ตัวกรองใช้เวลา 2.71 วินาที", "คิวบันทึก name_x แล้ว", "ชั้นอ่าน"]),
    ("Call it first... then wait. It waits for x... Next one… or so. (All of it ended.) Done", ["Call it first... then wait.", "It waits for x...", "Next one… or so.", "(All of it ended.)", "Done"]),
    ("A title\n\nOne\nsentence; here: yes.\r\n \t\r\n* item one. Still it\n* b\n1) c\n\n\r\rLast", ["A title", "One\nsentence; here: yes.", "* item one. Still it", "* b", "1) c", "Last"]),
    ('He said "never closed. Then went. End.', ['He said "never closed.', "Then went.", "End."]),
    ("A. B. Roe wrote it. It works.", ["A. B. Roe wrote it.", "It works."]),
    ("- a\n  deeper\n- b", ["- a\n  deeper", "- b"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert [text[a:b] for a, b in units(text)] == want


def test_units_hold_everything_but_white_space(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += [None, "", " \r\n\t", "\r\n", ".", "«»„“\"''()" * 50, "((((" * 500 + "a. B", "x" * 100_000, "a. " * 30_000, '"' * 5001]
    for t in texts:
        last = 0
        for a, b in units(t):
            assert last <= a < b and not re.search(r"[^ \t\r\n]", t[last:a]) and t[a] not in " \t\r\n" and t[b - 1] not in " \t\r\n"
            last = b
        assert not t or not re.search(r"[^ \t\r\n]", t[last:])
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start_char int")
    got = sentence_units(df).collect()
    assert len(got) == sum(len(units(t)) for t in texts)
    assert sentence_units(df.limit(0)).count() == 0


def test_very_long_texts_take_linear_time():
    import time

    for t in ("End. " + "x" * 300_000, "ก" + " " * 200_000 + "ข", "a. b " * 60_000, '"a. ' * 40_000, "(" * 100_000 + ".", "." * 200_000, "x\n" * 100_000, "- a\n" * 50_000):
        began = time.time()
        units(t)
        assert time.time() - began < 8, t[:20]


def test_names_are_told_by_their_whole_word():
    import random
    import re
    import time

    from loamdex.llm.sentences import _follows

    for tail in ("9", "/b", "_b", ".py", "X", "()x"):
        text = 'He asked "Which?" ' + "a" * 200 + tail + " is it."
        assert _follows(text, 18) == "name" and len(units(text)) == 2, tail
    assert _follows("a" * 200, 0) == _follows("a" * 200 + "(). b", 0) == "lower"
    whole = re.compile(r"\w*(?:[a-zß-ÿ]\w*[A-Z]|[_/\\]\w|\.\w|\w\(\)|\d)")
    rnd = random.Random(4)
    for _ in range(20_000):
        t = "a" + "".join(rnd.choices("abéXÉ9_/\\.()÷-,… \n。", k=rnd.randrange(9)))
        word = re.match(r"[^ \t\r\n]+", t)[0].rstrip(".,;:!?…)")
        assert _follows(t, 0) == ("name" if whole.match(word) else "lower"), t
    for t in ("End. " + "x" * 300_000, "a.b" * 100_000, "。a" * 100_000, "。a()." * 50_000, "Go… " + "a_" * 150_000, "。÷a" * 80_000):
        began = time.time()
        units(t)
        assert time.time() - began < 8, t[:20]


def test_a_second_scan_leaves_nothing_open():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from loamdex.llm.sentences import _scan

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet="a. !\"“”„«»‹›‘’()[]「」『』", max_size=60))
    def check(s):
        _, open_ = _scan(s, set())
        assert _scan(s, set(open_))[1] == []

    check()
    deep = "".join("([{"[i % 3] + '"' for i in range(500)) + "one. Two. Three"
    assert len(units(deep)) == 3
