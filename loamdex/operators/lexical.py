"""The inverted index and ranked phrase search over it, for one query or many at once.

The index is derived from index rows (chunk_id, content, headings, source_path, chunk_index): nothing is kept in step by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions import scoring, text
from loamdex.session import materialise

COLUMNS = ["content", "headings", "source_path"]
#: Bits of what ``sifted`` ships: 2 MB, whatever the table.
SIEVE = 1 << 24


def index_rows(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunk_id, file_id, chunk_index, content, headings, source_path, start_line, end_line: each chunk once, with its file's path.

    Chunks of unknown files drop out. Contents are shuffled once, by chunk; only ids meet the files.
    """
    rows = single_rows(chunks)
    paths = file_paths(files).withColumnRenamed("file_id", "_file")
    named = chunks.select(F.col("id").alias("chunk_id"), F.col("file_id").alias("_file")).join(paths, "_file").dropDuplicates(["_file", "chunk_id"])
    same = F.array_contains(F.array("_file"), F.col("file_id"))  # an equality would become a key of the join and shuffle contents again
    return rows.join(named, "chunk_id").filter(same).select("file_id", "chunk_id", "chunk_index", "content", "headings", "start_line", "end_line", "source_path")


def file_paths(files: DataFrame) -> DataFrame:
    """file_id, source_path: each file once."""
    return files.groupBy(F.col("id").alias("file_id")).agg(F.max("source_path").alias("source_path"))


def _fields(chunks: DataFrame) -> list[Column]:
    headings = F.coalesce(F.array_join("heading_path", " "), F.lit("")) if "heading_path" in chunks.columns else F.lit("")
    return [*map(F.col, ("file_id", "chunk_index", "content")), headings.alias("headings"), *map(F.col, ("start_line", "end_line"))]


def single_rows(chunks: DataFrame) -> DataFrame:
    """chunk_id, file_id, chunk_index, content, headings, start_line, end_line: each chunk once; of rows that differ under one id always the same.

    A heading_path column becomes headings, joined by spaces; without one they are empty.
    """
    return chunks.filter("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.min(F.struct(*_fields(chunks))).alias("r")).select("chunk_id", "r.*")


def single_rows_in_place(chunks: DataFrame) -> DataFrame:
    """The same as ``single_rows``, but only rows whose id may stand in several rows are shuffled with their contents; of the others not even the ids are, behind a count of each id."""
    known = chunks.filter("id is not null")
    several = known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = sifted(known, "id", several)
    alone = dealt.filter("not _may").select(F.col("id").alias("chunk_id"), *_fields(chunks))
    return alone.unionByName(single_rows(dealt.filter("_may").drop("_may")))


def sifted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``_may``: false only where no row of ``wanted`` has the row's ``key``. No row is shuffled: SIEVE bits are shipped, one for each hash of a wanted key."""
    bit = F.pmod(F.xxhash64(key), F.lit(SIEVE))
    each = wanted.select(bit.alias("_bit")).selectExpr("shiftright(_bit, 6) as _word", "shiftleft(1L, cast(_bit & 63 as int)) as _bits")
    words = F.broadcast(each.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")))
    met = rows.withColumn("_bit", bit).join(words, F.expr("shiftright(_bit, 6) = _word"), "left")
    return met.withColumn("_may", F.expr("coalesce(shiftrightunsigned(_bits, cast(_bit & 63 as int)) & 1L = 1L, false)")).drop("_bit", "_word", "_bits")


def postings(rows: DataFrame) -> DataFrame:
    """term, chunk_id, col, positions (ascending), tf, n_tokens (of the whole chunk).

    Grouped by the rows' own keys first, so rows that are already split by file or chunk are not shuffled again, let alone their tokens.
    """
    cols = F.array(*[F.struct(F.lit(c).alias("col"), text.tokens(F.col(c)).alias("terms")) for c in COLUMNS])
    keys = [c for c in ("file_id", "chunk_id") if c in rows.columns]
    each = rows.select(*keys, cols.alias("cols")).withColumn("n_tokens", F.aggregate("cols", F.lit(0).cast("long"), lambda n, c: n + F.size(c["terms"])))
    spread = each.select(*keys, "n_tokens", F.explode("cols").alias("c")).select(*keys, "n_tokens", "c.col", F.posexplode("c.terms").alias("pos", "term"))
    grouped = spread.groupBy(*keys, "col", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.max("n_tokens").alias("n_tokens"))
    return grouped.select("term", *keys, "col", "positions", F.size("positions").alias("tf"), "n_tokens")


def chunk_lengths(rows: DataFrame, *more: str) -> DataFrame:
    """chunk_id, n_tokens over all columns; and ``more`` columns of the rows."""
    sizes = [F.size(text.tokens(F.col(c))) for c in COLUMNS]
    return rows.select(*more, "chunk_id", (sizes[0] + sizes[1] + sizes[2]).cast("long").alias("n_tokens"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_rows, total_tokens, avg_tokens."""
    return lengths.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"), F.avg("n_tokens").alias("avg_tokens"))


def document_frequency(index: DataFrame) -> DataFrame:
    """term, df (chunks that hold it), cf (times it occurs)."""
    per_chunk = index.groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"))
    return per_chunk.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def searchable(queries: DataFrame) -> DataFrame:
    """query_id, phrases (arrays of terms): the searchable parts of each query; queries with more than 64 parts or none have no row. Repeated query rows count once."""
    fine = queries.filter(F.col("query_id").isNotNull() & F.col("text").isNotNull() & (text.part_count(F.col("text")) <= text.MAX_PARTS)).select("query_id", "text").dropDuplicates(["query_id"])
    return fine.select("query_id", F.filter(text.phrases(F.col("text")), lambda p: F.size(p) > 0).alias("phrases")).filter(F.size("phrases") > 0)


def query_phrases(queries: DataFrame) -> DataFrame:
    """query_id, part, phrase (array of terms), parts: the parts of each searchable query."""
    return searchable(queries).select("query_id", F.size("phrases").alias("parts"), F.posexplode("phrases").alias("part", "phrase"))


def totals(lengths: DataFrame) -> tuple[int, int]:
    """(chunks, tokens) of a corpus, as scores need them."""
    row = corpus_stats(lengths).first()
    return row.n_rows, row.total_tokens


def wanted_terms(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """The postings of one query's terms. They are few (a query has at most 64 parts), so the condition reaches the scan, which skips what lies elsewhere in the sorted files."""
    return index.filter(F.col("term").isin(sorted({t for p in phrases for t in p})))


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, chunk_id, frequency, n_tokens for each distinct phrase and chunk that holds it in some column.

    The postings are read once. A phrase of one term takes its counts; of a longer one, positions are moved back by the term's place and must meet for all its terms in one column.
    """
    wanted = phrases.select("phrase").distinct().filter(F.size("phrase") > 0).select("phrase", F.posexplode("phrase").alias("place", "term"))
    start = F.struct(F.lit(None).cast("int").alias("start"), F.col("tf").alias("n"))
    starts = F.when(F.size("phrase") == 1, F.array(start)).otherwise(F.transform("positions", lambda p: F.struct((p - F.col("place")).alias("start"), F.lit(1).alias("n"))))
    moved = wanted.join(index, "term").select("phrase", "chunk_id", "col", "n_tokens", F.explode(starts).alias("s"))
    met = moved.groupBy("phrase", "chunk_id", "col", "s.start").agg(F.sum("s.n").alias("n"), F.max("n_tokens").alias("n_tokens")).filter((F.size("phrase") == 1) | (F.col("n") == F.size("phrase")))
    return met.groupBy("phrase", "chunk_id").agg(F.sum(F.when(F.size("phrase") == 1, F.col("n")).otherwise(1)).alias("frequency"), F.max("n_tokens").alias("n_tokens"))


def bm25_scores(index: DataFrame, corpus: tuple[int, int], queries: DataFrame, many: bool = True) -> DataFrame:
    """query_id, chunk_id, score of each chunk that holds all phrases of a query; lower is better. ``corpus``: chunks and tokens in all.

    Phrases are matched once however many queries share them, and the matches are written once. With ``many`` queries each query meets first the chunks of its rarest phrase and only for these its other phrases, so a frequent word costs no more than the rare one beside it.
    """
    asked = query_phrases(queries)
    found = materialise(phrase_matches(index, asked), "matches")
    counts = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    rows, tokens = corpus
    part = scoring.bm25_part(scoring.idf(F.lit(rows), F.col("n")), F.col("frequency"), F.col("n_tokens"), F.lit(tokens / max(rows, 1)))
    scored = found.join(counts, "phrase").select("phrase", "chunk_id", part.alias("part_score"))
    if many:
        known = asked.join(counts, "phrase").groupBy("query_id").agg(F.min_by("phrase", F.struct("n", "part")).alias("phrase"), (F.count(F.lit(1)) == F.max("parts")).alias("all"))
        candidates = known.filter("all").join(found.select("phrase", "chunk_id"), "phrase").select("query_id", "chunk_id")
        met = candidates.join(asked, "query_id").join(scored, ["phrase", "chunk_id"])
    else:
        met = asked.join(scored, "phrase")
    sums = met.groupBy("query_id", "chunk_id").agg(F.sum("part_score").alias("score"), F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"))
    return sums.filter("n = parts").select("query_id", "chunk_id", "score")


def top_hits(scores: DataFrame, rows: DataFrame, limit: int, best: str = "asc", digits: int = 12) -> DataFrame:
    """query_id, rank, chunk_id, score, source_path, chunk_index of the first ``limit`` chunks of each query; ties (scores equal to ``digits`` digits) by path, chunk_index, chunk_id.

    Scores are cut first, with all that tie with the last; only these meet the paths that decide ties. Contents are joined to hits only.
    """
    keys = rows.select("chunk_id", "source_path", "chunk_index")
    score = F.round("score", digits)
    by_score: Column = score.asc() if best == "asc" else score.desc()
    first = scores.withColumn("_tied", F.rank().over(Window.partitionBy("query_id").orderBy(by_score))).filter(F.col("_tied") <= limit).drop("_tied")
    w = Window.partitionBy("query_id").orderBy(by_score, F.col("source_path"), F.col("chunk_index"), F.col("chunk_id"))
    ranked = first.join(keys, "chunk_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "chunk_id", "score", "source_path", "chunk_index")


def search(index: DataFrame, corpus: tuple[int, int], rows: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """The lexical hits of each query."""
    return top_hits(bm25_scores(index, corpus, queries), rows, limit)
