"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

The merges are not run text by text: each task gathers the distinct words of its share of the corpus, builds an inverted index from token pair to word positions over all of them, and applies the merges in rank order, touching only the neighbours of each merge. Words already encoded are kept for the task's later batches, so a frequent word is encoded once a task, and no text is ever shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamdex.session import ship

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
#: The published pre-tokenizer pattern of byte_bpe_50k (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words, and of their ids, that a task remembers between batches; only speed depends on it.
MEMORY = 48 << 20


@lru_cache(maxsize=2)
def load_merges(path: str) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]]]:
    """The ids of the 256 bytes, and for each mergeable pair of ids its rank and the merged id, from a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    sign = {b: chr(b) for b in shown}
    sign |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in sign)}
    merges = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return [vocab[sign[b]] for b in range(256)], merges


def largest_id(path: str) -> int:
    """The largest id that a vocabulary can give."""
    singles, merges = load_merges(path)
    return max(max(singles), max((m for _, m in merges.values()), default=0))


def replay(words: list[bytes], singles: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[list[int]]:
    """The ids of each word, by replaying the merges over all words at once.

    ``left``/``right`` chain the live positions of a word; ``where`` is the inverted index from the rank of a pair to the positions at which the pair may start. Ranks are taken smallest first; positions of one rank go left to right, so of overlapping pairs the left one merges, and a position whose pair has changed since is skipped.
    """
    ids: list[int] = []
    starts: list[int] = []
    left: list[int] = []
    right: list[int] = []
    where: dict[int, list[int]] = {}
    for w in words:
        at = len(ids)
        starts.append(at)
        ids += [singles[b] for b in w]
        end = len(ids)
        left += range(at - 1, end - 1)
        right += range(at + 1, end + 1)
        if end > at:
            left[at] = right[end - 1] = -1
        for p in range(at, end - 1):
            if found := merges.get((ids[p], ids[p + 1])):
                where.setdefault(found[0], []).append(p)
    due = list(where)
    heapify(due)
    while due:
        rank = heappop(due)
        spots = where.pop(rank, None)
        if spots is None:
            continue
        spots.sort()
        for p in spots:
            n = right[p]
            if n == -1 or ids[p] == -1:
                continue
            found = merges.get((ids[p], ids[n]))
            if not found or found[0] != rank:
                continue
            ids[p], ids[n] = found[1], -1
            after = right[n]
            right[p] = after
            if after != -1:
                left[after] = p
                if (more := merges.get((ids[p], ids[after]))) is not None:
                    if more[0] not in where:
                        where[more[0]] = []
                        heappush(due, more[0])
                    where[more[0]].append(p)
            before = left[p]
            if before != -1 and (more := merges.get((ids[before], ids[p]))) is not None:
                if more[0] not in where:
                    where[more[0]] = []
                    heappush(due, more[0])
                where[more[0]].append(before)
    ends = [*starts[1:], len(ids)]
    return [[x for x in ids[a:b] if x != -1] for a, b in zip(starts, ends)]


class CorpusEncoder:
    """Encodes lists of texts, keeping the ids of words between calls."""

    def __init__(self, vocabulary: str, memory: int = MEMORY):
        import regex

        self.singles, self.merges = load_merges(vocabulary)
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.size, self.memory = 0, memory

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """One list of ids a text; empty for null and empty texts."""
        split = [self.find(t) if t else [] for t in texts]
        new = {w for words in split for w in words} - self.known.keys()
        if self.size > self.memory:
            self.known, self.size = {}, 0
            new = {w for words in split for w in words}
        if new:
            order = list(new)
            for w, ids in zip(order, replay([w.encode("utf-8", "surrogatepass") for w in order], self.singles, self.merges)):
                self.known[w] = ids
                self.size += 150 + 12 * len(w)
        known = self.known
        out = []
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out


@lru_cache(maxsize=2)
def shared_encoder(vocabulary: str) -> CorpusEncoder:
    """The encoder of this worker process, which one task after the other uses."""
    return CorpusEncoder(vocabulary)


def slices(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Borders of runs of texts with about ``most`` characters each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_corpus(df: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json", output: str = "ids") -> DataFrame:
    """The columns ``keep`` (default: all but ``text``) and ``output``, the token ids of ``text``, one row for each row.

    No special tokens; text that looks like one is plain text; null and empty texts give an empty list. Whole texts are encoded, whatever their length, in time about proportional to it. One narrow stage: no shuffle.
    """
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    if output in keep:
        raise ValueError(f"{output} is among the columns kept")
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(output, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in slices(texts, 4 << 20):
                lists = encoder.encode(texts[a:b])
                ids = pa.array(lists, pa.list_(pa.field("element", pa.int32(), False)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*keep, output])

    return df.select(*keep, text).mapInArrow(run, schema)
