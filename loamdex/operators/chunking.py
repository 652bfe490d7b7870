"""Cutting documents into chunks within a token budget: plain and structured text, source code, Markdown.

Each chunker is a function of one document; a document's rows are independent, so chunking is one narrow stage. Offsets inside are code points; what is given out counts UTF-16 units, as stored indexes do.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from loamdex.functions.counters import BasicCounter
from loamdex.session import ship

#: Tab stops of indentation, and what makes a Markdown section tiny.
TAB, TINY = 4, 24
_BREAK = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"[.!?。！？][\"'”’»)\]}」』]*$")


@dataclass
class Source:
    """A text with its words (each with the white space behind it) and lines."""

    text: str
    ends: list[int] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.ends = [m.end() for m in re.finditer(r"\S+\s*", self.text)]
        self.lines = [0, *(m.end() for m in _BREAK.finditer(self.text))]
        if self.lines[-1] == len(self.text) and len(self.lines) > 1:
            self.lines.pop()

    def line(self, at: int) -> int:
        """Number from 1 of the line that holds a character."""
        return bisect_right(self.lines, at)


@dataclass
class Piece:
    start: int
    end: int
    headings: list[str] = field(default_factory=list)


Fits = Callable[[int, int], bool]


def _furthest(places: list[int], first: int, fits: Callable[[int], bool]) -> int | None:
    """The furthest fitting place from index ``first``: probes grow by 1, 2, 4, ... until one does not fit, then the gap is halved. None if the first does not fit. Counts need not be monotonic: only places that were seen to fit are returned."""
    if first >= len(places) or not fits(places[first]):
        return None
    good, step = first, 1
    while True:
        probe = min(good + step, len(places) - 1)
        if probe == good:
            return places[good]
        if not fits(places[probe]):
            break
        good, step = probe, 2 * step
    low, high = good, probe
    while high - low > 1:
        mid = (low + high) // 2
        if fits(places[mid]):
            low = mid
        else:
            high = mid
    return places[low]


def _by_characters(s: Source, start: int, stop: int, fits: Fits) -> int:
    """The end of the longest part of a word that fits, at least one character; CRLF stays whole; white space behind comes along if it fits."""
    end = start
    while end < stop:
        step = end + (2 if s.text.startswith("\r\n", end) else 1)
        if end > start and not fits(start, step):
            break
        end = step
    after = re.compile(r"\s*").match(s.text, end, stop).end()
    return after if after > end and fits(start, after) else end


def _overlap_start(places: list[int], start: int, end: int, most: int, count: Callable[[int, int], int]) -> int:
    """The first of the places inside a chunk from which at most ``most`` tokens are left, by halving; the chunk's end if there is none."""
    if most <= 0:
        return end
    low, high = bisect_right(places, start), bisect_left(places, end)
    best = end
    while low < high:
        mid = (low + high) // 2
        if count(places[mid], end) <= most:
            best, high = places[mid], mid
        else:
            low = mid + 1
    return best


def text_pieces(text: str, budget: int, overlap: int, counter=None) -> list[Piece]:
    """Chunks of plain or structured text: as many whole words as fit, cut back to the last paragraph end, else sentence end, else line end."""
    if not text.strip():
        return []
    s, count = Source(text), (counter or BasicCounter()).over(text)
    paragraph, sentence, line, at = [], [], [], 0
    for end in s.ends:
        word = text[at:end]
        body = word.strip()
        breaks = len(_BREAK.findall(word[word.rindex(body[-1]) + 1 :]))
        if breaks >= 2:
            paragraph.append(end)
        if _SENTENCE.search(body):
            sentence.append(end)
        if breaks:
            line.append(end)
        at = end

    def fits(a: int, b: int) -> bool:
        return count(a, b) <= budget

    out: list[Piece] = []
    start = covered = 0
    while covered < len(text):
        while True:
            end = _furthest(s.ends, bisect_right(s.ends, start), lambda e: fits(start, e))
            if end is None:
                end = _by_characters(s, start, s.ends[bisect_right(s.ends, start)], fits)
            elif end < len(text):
                for kind in (paragraph, sentence, line):
                    i = bisect_right(kind, end)
                    if i and kind[i - 1] > max(start, covered):
                        if fits(start, kind[i - 1]):
                            end = kind[i - 1]
                        break
            if end > covered or start == covered:
                break
            start = covered
        out.append(Piece(start, end))
        covered = end
        start = _overlap_start(s.ends, start, end, overlap, count)
    return out


def _indent(line: str) -> int:
    width = 0
    for c in line:
        if c == "\t":
            width += TAB - width % TAB
        elif c == " ":
            width += 1
        else:
            break
    return width


def source_pieces(text: str, budget: int, overlap: int, counter=None) -> list[Piece]:
    """Chunks of source code: whole lines, cut after the last blank lines, else before the last line indented less than the one before, else at a line end; a line that doesn't fit alone is cut by words, then characters."""
    if not text.strip():
        return []
    s, count = Source(text), (counter or BasicCounter()).over(text)
    line_ends = [*s.lines[1:], len(text)]
    blank_ends, dedents, last, indent = [], [], False, 0
    for a, b in zip(s.lines, line_ends):
        row = text[a:b]
        if not row.strip():
            last = True
            continue
        if last:
            blank_ends.append(a)
        if _indent(row) < indent:
            dedents.append(a)
        indent, last = _indent(row), False

    def fits(a: int, b: int) -> bool:
        return count(a, b) <= budget

    out: list[Piece] = []
    start = covered = 0
    while covered < len(text):
        while True:
            end = _furthest(line_ends, bisect_right(line_ends, start), lambda e: fits(start, e))
            if end is None:
                stop = line_ends[bisect_right(line_ends, start)]
                words = [e for e in s.ends[bisect_right(s.ends, start) : bisect_right(s.ends, stop)] if e <= stop]
                end = _furthest(words, 0, lambda e: fits(start, e))
                if end is None:
                    end = _by_characters(s, start, words[0] if words else stop, fits)
            elif end < len(text):
                for kind in (blank_ends, dedents):
                    i = bisect_right(kind, end)
                    if i and kind[i - 1] > max(start, covered):
                        if fits(start, kind[i - 1]):
                            end = kind[i - 1]
                        break
            if end > covered or start == covered:
                break
            start = covered
        if not text[end:].strip() and fits(start, len(text)):
            end = len(text)
        if text[start:end].strip():
            out.append(Piece(start, end))
        covered = end
        start = _overlap_start(s.lines, start, end, overlap, count)
        if start == end:
            start = _overlap_start(s.ends, out[-1].start if out else 0, end, overlap, count)
    return out


@dataclass
class Block:
    """A Markdown block: kind, first line, line after it, heading level, and where its parts begin."""

    kind: str
    first: int
    end: int
    level: int = 0
    title: str = ""
    parts: list[int] = field(default_factory=list)


_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(?:(`{3,})[^`]*$|(~{3,}))")
_ITEM = re.compile(r"( {0,3})([-*+]|(\d{1,9})[.)])(?:([ \t]+)(?=\S)|[ \t]*$)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}>")
# The tag names that begin an HTML block which a blank line ends.
_TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
# How HTML blocks begin and end (None: before a blank line); the last kind can't break into a paragraph.
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(_TAGS.split())})(?:\s|/?>|$)", re.I), None),
    (re.compile(r""" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"""), None),
]


def heading_title(raw: str) -> str:
    """The visible text of a heading: code and link texts stay, marks and tags go."""
    t = re.sub(r"!?\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", raw)
    t = re.sub(r"<[^>]+>", "", t)
    kept = re.split(r"(`+)(.*?)\1", t)
    t = "".join(x if i % 3 == 2 else "" if i % 3 == 1 else re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", re.sub(r"(?<![\w\\])([*_]{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", x)) for i, x in enumerate(kept))
    return re.sub(r"\s+", " ", t).strip()


def _html_end(row: str, kinds: list) -> tuple[bool, re.Pattern | None]:
    """Whether an HTML block begins with a line, and what ends it."""
    for begin, end in kinds:
        if begin.match(row):
            return True, end
    return False, None


def _breaks_paragraph(row: str) -> bool:
    """Whether a line ends the paragraph before it by beginning another block. A list does so only with a text and, if numbered, from 1."""
    if _HEADING.match(row) or _FENCE.match(row) or _RULE.match(row) or _QUOTE.match(row) or _html_end(row, _HTML[:6])[0]:
        return True
    m = _ITEM.match(row)
    return bool(m and m[4] and (m[3] is None or int(m[3]) == 1))


def _closing(fence: str) -> re.Pattern:
    return re.compile(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$")


class _Inside:
    """Follows the lines inside a list item or quote far enough to know whether a paragraph is open at their end, which a line outside then goes on."""

    def __init__(self):
        self.fence: re.Pattern | None = None
        self.paragraph = False

    def line(self, row: str) -> None:
        row = row.expandtabs(TAB)
        if self.fence:
            if self.fence.match(row):
                self.fence = None
            return
        while True:  # containers inside have their own marks in front
            if m := _QUOTE.match(row):
                row, self.paragraph = row[m.end() :].removeprefix(" "), False
            elif (m := _ITEM.match(row)) and not _RULE.match(row):
                row, self.paragraph = row[m.end() :], False
            else:
                break
        if m := _FENCE.match(row):
            self.fence, self.paragraph = _closing(m[1] or m[2]), False
        elif not row.strip() or _HEADING.match(row) or _RULE.match(row) or (self.paragraph and _SETEXT.match(row)):
            self.paragraph = False
        elif not self.paragraph:
            self.paragraph = _indent(row) < TAB and not _html_end(row, _HTML)[0]


def _quote_end(rows: list[str], i: int, end: int) -> int:
    inside = _Inside()
    while i < end:
        if m := _QUOTE.match(rows[i]):
            inside.line(rows[i][m.end() :].removeprefix(" "))
        elif not rows[i].strip() or not inside.paragraph or _breaks_paragraph(rows[i]):
            break
        i += 1
    return i


def _list_end(rows: list[str], i: int, end: int) -> tuple[int, list[int]]:
    """The line after a list and the first lines of its items. A mark of another kind begins another list."""
    first = _ITEM.match(rows[i])
    kind, parts, width, inside, last = first[2][-1], [], 0, _Inside(), i
    while i < end:
        row = rows[i]
        m = _ITEM.match(row)
        if not row.strip():
            if parts and i == parts[-1] + 1 and not rows[parts[-1]][_ITEM.match(rows[parts[-1]]).end() :].strip():
                width = 10**9  # an item may begin with one blank line only
            inside.line("")
            i += 1
            continue
        if parts and _indent(row) >= width:
            inside.line(row.expandtabs(TAB)[width:])
        elif m and m[2][-1] == kind and not _RULE.match(row):
            parts.append(i)
            gap = len(m[4].expandtabs(TAB)) if m[4] else 1
            width = len(m[1]) + len(m[2]) + (gap if gap <= TAB else 1)
            inside = _Inside()
            inside.line(row[len(m[1]) + len(m[2]) :].lstrip(" \t") if gap <= TAB else row[len(m[1]) + len(m[2]) + 1 :])
        elif not inside.paragraph or m or _breaks_paragraph(row) or not rows[i - 1].strip():
            break
        i += 1
        last = i
    return last, parts


def markdown_blocks(rows: list[str], first: int, end: int) -> list[Block]:
    """The blocks of some lines, by the block rules of CommonMark: headings of both kinds, fences, indented code, lists, quotes with the lines that go on outside, seven kinds of HTML, rules, paragraphs. What is inside lists and quotes is looked at only when they are cut."""
    out: list[Block] = []
    i = first
    while i < end:
        row = rows[i]
        if not row.strip():
            i += 1
            continue
        begin = i
        html, closes = _html_end(row, _HTML)
        if _indent(row) >= TAB:
            while i < end and (not rows[i].strip() or _indent(rows[i]) >= TAB):
                i += 1
            while not rows[i - 1].strip():
                i -= 1
            out.append(Block("code", begin, i))
        elif m := _FENCE.match(row):
            close = _closing(m[1] or m[2])
            i += 1
            while i < end and not close.match(rows[i]):
                i += 1
            i = min(end, i + 1)
            out.append(Block("fence", begin, i))
        elif m := _HEADING.match(row):
            i += 1
            out.append(Block("heading", begin, i, len(m[1]), heading_title(m[2] or "")))
        elif _RULE.match(row):
            i += 1
            out.append(Block("rule", begin, i))
        elif _ITEM.match(row):
            i, parts = _list_end(rows, i, end)
            out.append(Block("list", begin, i, parts=parts))
        elif _QUOTE.match(row):
            i = _quote_end(rows, i, end)
            out.append(Block("quote", begin, i))
        elif html:
            if closes:
                while i < end and not closes.search(rows[i]):
                    i += 1
                i = min(end, i + 1)
            else:
                while i < end and rows[i].strip():
                    i += 1
            out.append(Block("html", begin, i))
        else:
            i += 1
            while i < end and rows[i].strip():
                if m := _SETEXT.match(rows[i]):
                    out.append(Block("heading", begin, i + 1, 1 if m[1][0] == "=" else 2, heading_title(" ".join(x.strip() for x in rows[begin:i]))))
                    break
                if _breaks_paragraph(rows[i]):
                    break
                i += 1
            if out and out[-1].first == begin:
                i += 1
            else:
                out.append(Block("paragraph", begin, i))
    return out


def _child_starts(block: Block, rows: list[str]) -> list[int]:
    """First lines of the parts an oversized list, item or quote is cut into."""
    if block.kind == "list":
        return block.parts
    inner = [re.sub(r"^ {0,3}> ?", "", r) for r in rows]
    return [b.first for b in markdown_blocks(inner, block.first, block.end)]


def markdown_pieces(text: str, budget: int, overlap: int, counter=None) -> list[Piece]:
    """Chunks of Markdown: top-level blocks packed until a heading or the budget; oversized lists and quotes are cut into their parts, other oversized blocks as text; tiny sections join a neighbour under the same parent; what is only markup is dropped. Each chunk carries the titles above its first character."""
    if not text.strip():
        return []
    counter = counter or BasicCounter()
    s, count = Source(text), counter.over(text)
    rows = [text[a:b].rstrip("\r\n") for a, b in zip(s.lines, [*s.lines[1:], len(text)])]
    blocks = markdown_blocks(rows, 0, len(rows))
    starts = [0 if i == 0 else s.lines[b.first] for i, b in enumerate(blocks)]
    sections: list[tuple[int, list[str]]] = []
    path: dict[int, str] = {}
    for b, at in zip(blocks, starts):
        if b.kind == "heading":
            path = {k: v for k, v in path.items() if k < b.level}
            if b.title:
                path[b.level] = b.title
            sections.append((at, [path[k] for k in sorted(path)]))

    groups: list[tuple[int, int, bool]] = []
    open_: list[int] = []

    def flush(end: int) -> None:
        if open_:
            groups.append((open_[0], end, False))
            open_.clear()

    def add(block: Block, at: int, end: int) -> None:
        if block.kind == "heading":
            flush(at)
        if count(at, end) > budget:
            flush(at)
            inner = [x for x in _child_starts(block, rows) if block.first < x < block.end] if block.kind in ("list", "quote", "item") else []
            if block.kind == "item":
                inner = _item_parts(block, rows)
            if inner or block.kind == "list" and len(block.parts) == 1:
                edges = [at, *(s.lines[x] for x in inner), end]
                lines = [block.first, *inner, block.end]
                for (a, b), (fl, el) in zip(zip(edges, edges[1:]), zip(lines, lines[1:])):
                    add(Block("item" if block.kind == "list" else "paragraph", fl, el), a, b)
                flush(end)
            else:
                groups.append((at, end, True))
            return
        if open_ and count(open_[0], end) > budget:
            flush(at)
        if not open_:
            open_.append(at)

    for b, at, end in zip(blocks, starts, [*starts[1:], len(text)]):
        add(b, at, end)
    flush(len(text))

    def headed(a: int, b: int) -> list[str]:
        first = a + len(text[a:b]) - len(text[a:b].lstrip())
        i = bisect_right([x for x, _ in sections], first)
        return sections[i - 1][1] if i else []

    merged = _merge_tiny([[a, b, split, headed(a, b)] for a, b, split in groups], count, budget)
    out: list[Piece] = []
    for a, b, split, titles in merged:
        if split:
            out += [Piece(a + p.start, a + p.end, titles) for p in text_pieces(text[a:b], budget, overlap, counter)]
        elif text[a:b].strip() and not _only_markup(text[a:b]):
            out.append(Piece(a, b, titles))
    return out


def _item_parts(block: Block, rows: list[str]) -> list[int]:
    """First lines of the blocks inside a list item, after its first."""
    lead = _ITEM.match(rows[block.first])
    width = len(lead[0]) if lead else 0
    inner = [r[min(width, len(r) - len(r.lstrip())) :] if k != block.first else " " * 0 + r[width:] for k, r in enumerate(rows)]
    return [b.first for b in markdown_blocks(inner, block.first, block.end) if b.first > block.first]


def _only_markup(content: str) -> bool:
    if re.search(r"(?m)^ {0,3}(?:```|~~~)|`", content):
        return False
    bare = re.sub(r"</?[A-Za-z][^<>]*>", "", re.sub(r"(?s)<!--.*?-->", "", content))
    return not re.search(r"[^\s>]", bare)


def _merge_tiny(groups: list[list], count: Callable[[int, int], int], budget: int) -> list[list]:
    """Joins groups below the threshold to the next, else the one before, if their titles share all but at most the last and both fit together; the joined path is the shared one."""
    least = min(TINY, budget // 8)

    def join(a: list, b: list) -> list | None:
        if a[2] or b[2] or count(a[0], b[1]) > budget:
            return None
        shared = 0
        while shared < min(len(a[3]), len(b[3])) and a[3][shared] == b[3][shared]:
            shared += 1
        return [a[0], b[1], False, a[3][:shared]] if shared >= max(len(a[3]), len(b[3])) - 1 and (shared or not (a[3] and b[3]) or a[3] == b[3]) else None

    done: list[list] = []
    for g in groups:
        if done and count(done[-1][0], done[-1][1]) < least and (both := join(done[-1], g)):
            done[-1] = both
        else:
            done.append(g)
    back: list[list] = []
    for g in done:
        if back and count(g[0], g[1]) < least and (both := join(back[-1], g)):
            back[-1] = both
        else:
            back.append(g)
    return back


CHUNKERS = {"PLAIN_TEXT": text_pieces, "STRUCTURED_TEXT": text_pieces, "SOURCE_CODE": source_pieces, "MARKDOWN": markdown_pieces}
CHUNK = "source_path string, document_type string, chunk_index int, content string, start_line int, end_line int, heading_path array<string>, attributes map<string,string>"


def chunk_document(path: str, kind: str, text: str, budget: int, overlap: int, counter=None, overrides: dict | None = None) -> list[tuple]:
    """The chunk rows of one document; ``overrides`` maps file extensions of source code to chunkers of one's own."""
    chunker = CHUNKERS.get(kind, text_pieces)
    if kind == "SOURCE_CODE" and overrides:
        chunker = overrides.get(path.rsplit(".", 1)[-1].lower(), chunker)
    lines, units = Source(text), _units(text)
    return [
        (path, kind, i, text[p.start : p.end], lines.line(p.start), lines.line(max(p.start, p.end - 1)), list(p.headings), {"startOffset": str(units(p.start)), "endOffset": str(units(p.end))})
        for i, p in enumerate(chunker(text, budget, overlap, counter))
    ]


def _units(text: str) -> Callable[[int], int]:
    """Code points to UTF-16 units."""
    wide = [i for i, c in enumerate(text) if ord(c) > 0xFFFF]
    return lambda at: at + bisect_left(wide, at)


def chunk_documents(documents: DataFrame, budget: int, overlap: int, counter=None, overrides: dict | None = None) -> DataFrame:
    """The chunks of documents (source_path, document_type, content). Null, empty and blank contents have none; the overlap is kept below the budget."""
    ship(documents.sparkSession)
    counter = counter or BasicCounter()
    overlap = max(0, min(overlap, budget - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for d in b.itertuples(index=False) if d.content for r in chunk_document(d.source_path, d.document_type, d.content, budget, overlap, counter, overrides)]
            yield pd.DataFrame(rows, columns=["source_path", "document_type", "chunk_index", "content", "start_line", "end_line", "heading_path", "attributes"])

    return documents.select("source_path", "document_type", "content").mapInPandas(run, CHUNK)


def embedding_input(path: str, headings: list[str], content: str, counter=None, most: int = 32) -> str:
    """What is embedded for a chunk: its path and titles in one line, a blank line, its content. A line over ``most`` tokens loses its leading parts behind an ellipsis."""
    counter = counter or BasicCounter()
    parts = [path, *headings]
    line = " > ".join(parts)
    while counter.count(line) > most and len(parts) > 1:
        parts.pop(0)
        line = "… " + " > ".join(parts)
    while counter.count(line) > most and line:
        line = "… " + line.removeprefix("… ")[max(1, len(line) // 8) :]
    return f"{line}\n\n{content}"
