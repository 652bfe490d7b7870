"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm import bpe, fusion, handwritten, mixture, neighbours, pieces, sentences, topn
from loamdex.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """hit_id of the three best hits of each (source_path, score_kind)."""
    key = F.when(F.col("score_kind") == "SQLITE_BM25", F.col("score")).otherwise(-F.col("score"))
    hits = table(spark, d, "search_hits").filter("score is not null and not isnan(score)").select("source_path", "score_kind", key.alias("key"), "chunk_index", "hit_id")
    best = topn.top_n_per_group(hits, ["source_path", "score_kind"], [F.col("key"), F.col("chunk_index"), F.col("hit_id")], 3)
    return best.select("hit_id").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """query_id, chunk_id of the first chunk of each query with hits on both sides."""
    places = fusion.side_places(table(spark, d, "search_hits"))
    return fusion.first_of_each(places, "query_id", "chunk_id", ["lexical", "semantic"])


def p2_leximin(spark: SparkSession, d: str) -> DataFrame:
    """query_id, chunk_id, rank: the whole leximin ranking of each query."""
    places = fusion.side_places(table(spark, d, "search_hits"))
    return fusion.leximin_ranking(places, "query_id", "chunk_id", ["lexical", "semantic"]).select("query_id", "chunk_id", "rank")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """profile_id, chunk_a, chunk_b of each pair of at least 0.92 of which one is among the five most similar of the other."""
    near = neighbours.nearest(table(spark, d, "chunk_embeddings"), table(spark, d, "embedding_profiles"), 5, 0.92)
    return near.select("profile_id", F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """file_id of each SOURCE_CODE file that nobody on the project wrote by hand."""
    return handwritten.unwritten_files(table(spark, d, "files"), table(spark, d, "documents")).select("file_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, piece_no, start_line, end_line, n_tokens of the pieces of oversized chunks."""
    found = pieces.split_oversized(table(spark, d, "chunks"), table(spark, d, "file_indexing_profiles"))
    return found.select("chunk_id", "piece_no", "start_line", "end_line", "n_tokens")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ids of each document."""
    return bpe.encode_corpus(table(spark, d, "documents"), keep=["doc_id"])


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """shard, slot, source, block_no, pass, ids: the mixture itself."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each listed source."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, start_char, end_char of each sentence unit of the PLAIN_TEXT documents."""
    return sentences.sentence_units(table(spark, d, "documents").filter("document_type = 'PLAIN_TEXT'"))


_PLACES = """
with h as (select distinct hit_id, query_id, query_mode, source_path, chunk_index, chunk_id, score, fused_ranks.lexical fl, fused_ranks.semantic fs from search_hits where query_id is not null and chunk_id is not null),
s as (select query_id, chunk_id, query_mode m, row_number() over (partition by query_id, query_mode order by case when query_mode = 'lexical' then score else -score end, source_path, chunk_index, chunk_id, hit_id) p from h where query_mode in ('lexical', 'semantic') and score is not null and not isnan(score)
 union all select query_id, chunk_id, 'lexical', fl from h where query_mode = 'hybrid' and fl is not null
 union all select query_id, chunk_id, 'semantic', fs from h where query_mode = 'hybrid' and fs is not null),
c as (select query_id, chunk_id, min(p) filter (m = 'lexical') l, min(p) filter (m = 'semantic') e from s group by all),
x as (select query_id, max(l) ml, max(e) me from c group by all having ml is not null and me is not null),
f as (select query_id, chunk_id, coalesce(l, ml + 1) l, coalesce(e, me + 1) e, ml, me from c join x using (query_id))
"""

SQL = {
    "p1_found": """
with h as (select distinct hit_id, source_path, score_kind, case when score_kind = 'SQLITE_BM25' then score else -score end k, chunk_index from search_hits where score is not null and not isnan(score)),
r as (select hit_id, row_number() over (partition by source_path, score_kind order by k, chunk_index, hit_id) p from h)
select distinct hit_id from r where p <= 3""",
    "p2_found": _PLACES + "select query_id, arg_min(chunk_id, l + e) chunk_id from f group by query_id",
    "p2_leximin": _PLACES + """, k as (select query_id, chunk_id, (ml + 1 - l) / ml a, (me + 1 - e) / me b from f)
select query_id, chunk_id, row_number() over (partition by query_id order by least(a, b) desc, greatest(a, b) desc, chunk_id) "rank" from k""",
}

SQL["p3_found"] = """
with n as (select * from (select profile_id, chunk_id, vector, row_number() over (partition by profile_id, chunk_id order by embedded_at desc nulls last) p from chunk_embeddings) where p = 1),
v as (select profile_id, chunk_id, vector::double[] x from n join embedding_profiles e on e.id = n.profile_id where vector is not null and len(vector) = dimensions and len(list_filter(vector, lambda y: y is null or isnan(y))) = 0 and len(list_filter(vector, lambda y: y <> 0)) > 0),
s as (select a.profile_id, a.chunk_id a, b.chunk_id b, list_cosine_similarity(a.x, b.x) c from v a join v b on a.profile_id = b.profile_id and len(a.x) = len(b.x) and a.chunk_id <> b.chunk_id),
r as (select *, row_number() over (partition by profile_id, a order by c desc, b) p from s where c >= 0.92)
select distinct profile_id, least(a, b) chunk_a, greatest(a, b) chunk_b from r where p <= 5"""

# Greedy pieces by recursion: b holds the line breaks before each token, c the tokens done, f the first token of a piece, e its end.
_END = "case when {f} + m >= len(b) then len(b) else coalesce(list_max(list_transform(range({c} + 1, {f} + m + 1), lambda x: case when b[x + 1] >= 2 then 1000000000 + x when b[x + 1] = 1 then x end)) % 1000000000, {f} + m) end"
_FIRST = "(e - least(o, e, m - 1))"
SQL["p6_found"] = rf"""
with recursive l as (select file_id, max_tokens m, greatest(coalesce(overlap_tokens, 0), 0) o from (select *, row_number() over (partition by file_id order by updated_at desc nulls last) r from file_indexing_profiles) where r = 1 and max_tokens >= 1),
k as (select distinct c.id, coalesce(c.start_line, 1) s, c.content, m::bigint m, o::bigint o from chunks c join l using (file_id) where c.content is not null),
t as (select id, s, m, o, list_transform(regexp_extract_all(content, '[ \t\r\n]*[^ \t\r\n]+'), lambda p: len(regexp_extract_all(regexp_extract(p, '^[ \t\r\n]+'), '\r\n|\r|\n'))) b from k),
p as (select id, s, m, o, b, 0 no, 0::bigint f, {_END.format(f='0', c='0')} e from t where len(b) > m
 union all select id, s, m, o, b, no + 1, {_FIRST}, {_END.format(f=_FIRST, c='e')} from p where e < len(b))
select distinct id chunk_id, no piece_no, (s + list_sum(b[1:f + 1]))::int start_line, (s + list_sum(b[1:e]))::int end_line, (e - f)::int n_tokens from p"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p2_found, p2_leximin, p3_found, p5_found, p6_found, p7_ids, p8_mixture, p8_shares, p9_found)}
