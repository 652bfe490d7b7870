"""Sentence units of texts in many languages and scripts.

A pushdown automaton reads the marks of a paragraph: quotations and brackets are pushed and popped, so a mark inside them ends nothing; abbreviations are found by a trie read backwards from the full stop; terminators of each script carry their own rule about the white space after them. Lists are kept by level: an indented line after a list line belongs to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamdex.session import ship

# Abbreviations that stand before the rest of their sentence.
INNER = "approx aprox abb art bd bkz bsp bzw ca cap cf ch dr ed eds ej eq eqs esp fig figs gen hr hrsg inkl kap lt mio mr mrd mrs ms mt nr núm no nos nro örn pág págs par pp prof ref refs resp rev sec sgt sra sr sta st str tab tbl vd vgl vol vs yy zb bl krş sn çev dgl evtl ggf max min tel e.g i.e z.b d.h u.a p.ej v.chr a.k.a s.o o.ä d h p z b u".split()
# Abbreviations that may also end a sentence.
OUTER = "a.m p.m etc usw vb vs. ltd inc corp co jr bros plc gmbh ff ibid al ph.d u.s u.k d.c b.c a.d ee.uu s.a std sek min. std. uff cia".split()
# Names of months before which a number with a full stop is a day.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jänner ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık".split()
# Quotes and brackets, opening and closing.
PAIRS = {"«": "»", "‹": "›", "“": "”", "„": "“”", "‘": "’", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "［": "］", "{": "}", "【": "】", "《": "》", "〈": "〉", '"': '"'}
QUOTES = set("«‹“„‘「『\"")
#: Marks that end a sentence without white space behind them.
FREE = set("。！？｡।॥։።")
_EVENT = re.compile(r"\.{2,}|…+|[.!?。！？｡।॥؟۔։።]|[«»‹›“”„「」『』()（）\[\]［］{}【】《》〈〉\"]|(?<=[ก-๛])[ \t\r\n]+(?=[ก-๛])")
_MARKS = re.compile(r"[.!?…。！？｡।॥؟۔։።]*")
_SPACE = re.compile(r"[ \t\r\n]*")
_WORD = re.compile(r"[^ \t\r\n]+")
_LINE = re.compile(r"[^\r\n]*(\r\n|\r|\n|$)")
_ITEM = re.compile(r"([ \t]*)(?:[-*+•‣◦·–—]|\(?\d{1,3}[.)]|[①-⑳])[ \t]+(?=[^ \t])")
# Looks only at the letters and digits a word begins with and what follows them, each in linear time.
_NAME = re.compile(r"[^\Wa-zß-ÿ]*+[a-zß-ÿ]\w*[A-Z]|\w*+(?:[/\\.]\w|\(\)[.,;:!?…)]*+[^ \t\r\n]|÷\w*[A-Z])|\w*?(?:_\w|\d)")


def _trie(words: list[str], mark: str, root: dict) -> dict:
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node[""] = mark
    return root


_ABBREVIATIONS = _trie(OUTER, "outer", _trie(INNER, "inner", {}))


def _abbreviation(s: str, dot: int) -> str | None:
    """inner or outer if an abbreviation as a whole word stands before the full stop."""
    node, i, found = _ABBREVIATIONS, dot, None
    while True:
        if "" in node and (i == 0 or not (s[i - 1].isalnum() or s[i - 1] in "._-/")):
            found = node[""]
        if i == 0:
            return found
        i -= 1
        node = node.get(s[i].lower())
        if node is None:
            return found


def _follows(s: str, at: int) -> str:
    """What starts at a place: lower (a plain word in lower case), caseless (a letter of a script without case), name (of a file or in code), or start (a capital, a number or a mark that can open a sentence)."""
    c = s[at]
    if c.islower():
        return "name" if _NAME.match(s, at) else "lower"
    if c.isalpha() and not c.isupper() and not c.istitle():
        return "caseless"
    if c in ",;:–—-&+/=%":
        return "lower"
    return "start"


def _ends(s: str, mark: int, after: int, end: int, opened: list[tuple[str, bool]]) -> bool:
    """Whether the sentence ends at ``end``: the marks are s[mark:after], then come the closing quotes and brackets that ``opened`` describes (mark, whether it opened the sentence)."""
    nxt = _SPACE.match(s, end).end()
    if nxt == len(s):
        return True
    spaced, marks, what = nxt > end, s[mark:after], _follows(s, nxt)
    free = any(c in FREE for c in marks)
    if not spaced and not free and not (marks[-1] in "!?؟" and what == "caseless" and len(opened) == 0):
        return False
    if any(q in QUOTES for q, _ in opened):
        if all(first for q, first in opened if q in QUOTES) and what == "caseless":
            return spaced or not "ぁ" <= s[nxt] <= "ゟ"
        return what not in ("lower", "caseless")
    if opened:
        return what == "start" or what == "name" or any(first for _, first in opened) and what != "lower"
    if "…" in marks or ".." in marks:
        return spaced and what != "lower"
    if marks != "." or free:
        return True
    kind = _abbreviation(s, mark)
    if kind == "inner":
        return False
    if kind == "outer":
        return what != "lower" and not s[nxt].isdigit()
    i = mark
    while i and s[i - 1].isalnum():
        i -= 1
    word = s[i:mark]
    alone = i == 0 or s[i - 1] in ' \t\r\n("«„“['
    if alone and len(word) == 1 and word.isupper() and word.isascii():
        return False
    if alone and word.isdigit() and len(word) <= 3:
        if what == "lower":
            return False
        return _WORD.match(s, nxt)[0].strip(".,;:!?").lower() not in MONTHS
    return True


def _scan(s: str, skip: set[int]) -> tuple[list[int], list[int]]:
    """Ends of the sentences of a paragraph; places of openers that nothing closes."""
    ends: list[int] = []
    stack: list[tuple[str, int]] = []
    start, done = _SPACE.match(s).end(), 0
    for m in _EVENT.finditer(s):
        at, c = m.start(), m[0]
        if at < done or at in skip:
            continue
        if c[0] in " \t\r\n":
            if not stack:
                ends.append(at)
                start = m.end()
            continue
        if stack and c in PAIRS[stack[-1][0]]:
            stack.pop()
        elif c in PAIRS:
            stack.append((c, at))
        elif c[0] in "»›”」』)）]］}】》〉":
            continue
        else:
            after = end = _MARKS.match(s, at).end()
            opened = []
            while end < len(s) and stack and s[end] in PAIRS[stack[-1][0]]:
                q, place = stack.pop()
                opened.append((q, place == start))
                end += 1
            done = end
            if not stack and not (end < len(s) and opened and s[end] in ".!?…。！？") and _ends(s, at, after, end, opened):
                ends.append(end)
                start = _SPACE.match(s, end).end()
    return ends, [place for _, place in stack]


def _sentences(s: str) -> Iterator[tuple[int, int]]:
    """Borders of the sentences of one paragraph; a quote or bracket that is never closed is read as an ordinary character.

    Two scans always do: an opener that stays open has only such openers below it, so a scan without them sees the same marks on its stack, less these, and leaves none open.
    """
    ends, open_ = _scan(s, set())
    if open_:
        ends, _ = _scan(s, set(open_))
    at = 0
    for end in [*ends, len(s)]:
        a = _SPACE.match(s, at).end()
        b = end
        while b > a and s[b - 1] in " \t\r\n":
            b -= 1
        if a < b:
            yield a, b
        at = end


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit of a text, in code points; none for null, empty and blank texts.

    Units neither start nor end with space, tab, CR or LF and hold all other characters. Blank lines separate units; a list line is a unit with its marker and the deeper lines below it; all else is cut into sentences, whose last may lack its mark.
    """
    if not text:
        return []
    out: list[tuple[int, int]] = []
    begin = level = -1  # where the paragraph or item began; the item's indent
    last = 0

    def close() -> None:
        nonlocal begin, level
        if begin >= 0:
            if level >= 0:
                out.append((begin + _SPACE.match(text, begin).end() - begin, last))
            else:
                out.extend((begin + a, begin + b) for a, b in _sentences(text[begin:last]))
        begin = level = -1

    at = 0
    while at < len(text):
        m = _LINE.match(text, at)
        body = text[at : m.start(1)].rstrip(" \t")
        first = len(body) - len(body.lstrip(" \t"))
        if not body:
            close()
        else:
            item = _ITEM.match(body)
            if item and begin >= 0 and level < 0 and text[last - 1] not in ".!?…:。！？।؟":
                item = None  # a wrapped line that happens to begin with a number
            if item:
                close()
                begin, level = at, first
            elif begin < 0 or (level >= 0 and first <= level):
                close()
                begin = at
            last = at + len(body)
        at = m.end()
    close()
    return out


def sentence_units(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start_char, end_char of each sentence unit of each row's text; a narrow stage without shuffle."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [units(t) for t in batch.column(1).to_pylist()]
            rows = pa.array([i for i, u in enumerate(found) for _ in u], pa.int64())
            flat = [x for u in found for x in u]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([a for a, _ in flat], pa.int32()), pa.array([b for _, b in flat], pa.int32())], names=[key, "start_char", "end_char"])

    return df.select(key, text).mapInArrow(run, schema)
