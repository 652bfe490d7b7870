"""Snippets of hits with the ranges that matched."""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

#: Terms of a snippet and its most characters.
WINDOW, MOST = 32, 400


@lru_cache(maxsize=1)
def _term():
    import regex

    return regex.compile(r"[\p{L}\p{N}\p{Co}̀-ͯ]+")


@lru_cache(maxsize=65_536)
def fold_term(word: str) -> str:
    """One term as the index has it."""
    from loamdex.functions.text import FOLD_FROM, FOLD_TO

    table = _table(FOLD_FROM, FOLD_TO)
    return "".join(c for c in word if not "̀" <= c <= "ͯ").translate(table).lower()


@lru_cache(maxsize=1)
def _table(a: str, b: str) -> dict:
    return str.maketrans(a, b)


def _instances(terms: list[str], phrases: list[list[str]]) -> list[tuple[int, int, int]]:
    """(first term, phrase, terms) of each place where a phrase stands, in order of place and phrase."""
    starts: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        starts.setdefault(t, []).append(i)
    return sorted((i, k, len(p)) for k, p in enumerate(phrases) if p for i in starts.get(p[0], []) if terms[i : i + len(p)] == p)


def _score(found: list[tuple[int, int, int]], at: int) -> tuple[int, int]:
    """(score, start) of the window that begins at a term: a thousand for each phrase in it, one for each further place; the start is moved so that what was found lies in the middle."""
    inside = [f for f in found if at <= f[0] < at + WINDOW]
    different = len({k for _, k, _ in inside})
    first, last = inside[0][0] if inside else 0, inside[-1][0] + inside[-1][2] if inside else 0
    return 1000 * different + len(inside) - different, first - int((WINDOW - (last - first)) / 2)


def window_start(content: str, spans: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> int:
    """The term at which the best window of WINDOW terms begins.

    Each place is tried with the window around it and with the one that begins at the sentence it stands in, which is worth 100 (the first sentence 120); the first of the best counts. A sentence begins with the text, and behind a full stop or colon and white space.
    """
    n, best, start = len(spans), 0, 0
    gaps = [content[spans[i - 1][1] : a] for i, (a, _) in enumerate(spans) if i]
    sentences = [0, *(i for i, gap in enumerate(gaps, 1) if gap.rstrip(" \t\r\n")[-1:] in (".", ":") and gap[-1:] in " \t\r\n" and gap.rstrip(" \t\r\n"))]
    for i, _, _ in found:
        score, middle = _score(found, i)
        if score > best:
            best, start = score, max(0, min(middle, n - WINDOW))
        if n > WINDOW:
            sentence = sentences[bisect_right(sentences, i) - 1]
            if sentence < i:
                score = _score(found, sentence)[0] + (100 if sentence else 120)
                if score > best:
                    best, start = score, sentence
    return start


def snippet(content: str, phrases: list[list[str]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, ranges): the best window of WINDOW terms (see ``window_start``) and where phrases stand in it, overlapping ones as one range; the beginning of the content if no phrase stands in it. An ellipsis marks what is left out. At most MOST characters."""
    spans = [m.span() for m in _term().finditer(content)]
    found = _instances([fold_term(content[a:b]) for a, b in spans], phrases)
    start = window_start(content, spans, found)
    end = min(len(spans), start + WINDOW)
    a = spans[start][0] if start else 0
    b = spans[end - 1][1] if end < len(spans) else len(content)
    lead = "…" if start else ""
    joined: list[list[int]] = []
    for i, _, n in found:
        if joined and i < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], i + n)
        else:
            joined.append([i, i + n])
    shift = len(lead) - a
    ranges = [(spans[i][0] + shift, spans[min(j, end) - 1][1] + shift) for i, j in joined if start <= i < end]
    return _bounded(lead + content[a:b] + ("…" if end < len(spans) else ""), ranges)


def _bounded(text: str, ranges: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    if len(text) <= MOST:
        return text, ranges
    return text[: MOST - 1] + "…", [(a, min(b, MOST - 1)) for a, b in ranges if a < MOST - 1]
