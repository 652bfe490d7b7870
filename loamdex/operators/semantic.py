"""Exact nearest neighbours by cosine similarity, pooling of token vectors, and the state of embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.functions import scoring
from loamdex.session import ship

#: Rows of vectors, and of queries, that are compared at once.
BLOCK = 2048


def current_vectors(embeddings: DataFrame, profiles: DataFrame) -> DataFrame:
    """chunk_id, profile_id, fingerprint, vector: the newest row of each chunk and profile, if its vector is valid (of the profile's length, finite, not all zero)."""
    newest = Window.partitionBy("chunk_id", "profile_id").orderBy(F.desc_nulls_last("embedded_at"), "vector")
    rows = embeddings.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select("chunk_id", "profile_id", "vector")
    dims = profiles.groupBy(F.col("id").alias("profile_id")).agg(F.max("dimensions").alias("dimensions"), F.max("fingerprint").alias("fingerprint"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.join(dims, "profile_id").filter((F.size("vector") == F.col("dimensions")) & fine).select("chunk_id", "profile_id", "fingerprint", "vector")


def nearest_to(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """chunk_id, score of the vectors nearest to one query; the planner keeps only ``limit`` rows a partition."""
    target = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("chunk_id", scoring.cosine(F.col("vector"), target).alias("score")).filter("score is not null").orderBy(F.desc("score"), "chunk_id").limit(limit)


def _blocks(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows packed into blocks: group, keys, matrix (float64 unit rows), one group's vectors a block."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("group", T.IntegerType()), T.StructField(f"{prefix}_keys", T.ArrayType(kind)), T.StructField(f"{prefix}_rows", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups, keys = b.column(0).to_numpy(), b.column(1)
            for g in np.unique(groups):
                rows = np.flatnonzero(groups == g)
                for at in range(0, len(rows), BLOCK):
                    part = pa.array(rows[at : at + BLOCK])
                    x = np.stack([np.asarray(v, np.float64) for v in b.column(2).take(part).to_pylist()])
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    yield pa.RecordBatch.from_arrays([pa.array([int(g)], pa.int32()), pa.array([keys.take(part).to_pylist()]), pa.array([x.tobytes()])], names=["group", f"{prefix}_keys", f"{prefix}_rows"])

    return df.select(F.col("profile_id").cast("int"), key, "vector").mapInArrow(run, schema)


def nearest_batch(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """query_id, chunk_id, score: for each query (query_id, profile_id, vector) the ``limit`` most similar vectors of its profile, exact; ties by chunk_id.

    A stated set of queries against all rows, in blocks: vectors are packed into blocks of up to BLOCK rows, each block of queries meets each block of its profile, a block product is cut to its first ``limit`` before it leaves the worker, and the rest meets in one window a query. Data blocks are dealt to salts, and the query blocks are repeated for each salt, not the other way round, so no task holds a whole profile.
    """
    salts = max(8, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    data = _blocks(vectors, "chunk_id", "c").withColumn("salt", F.pmod(F.xxhash64("c_keys"), F.lit(salts)).cast("int"))
    asked = _blocks(queries, "query_id", "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = data.hint("merge").join(asked, ["group", "salt"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ck, qk = np.asarray(r.c_keys), np.asarray(r.q_keys)
                x, q = np.frombuffer(r.c_rows).reshape(len(ck), -1), np.frombuffer(r.q_rows).reshape(len(qk), -1)
                s = np.clip(q @ x.T, -1, 1)
                order = np.lexsort((np.broadcast_to(ck, s.shape), -s.round(12)))[:, :limit] if len(ck) > limit else np.broadcast_to(np.arange(len(ck)), s.shape)
                yield pd.DataFrame({"query_id": np.repeat(qk, order.shape[1]), "chunk_id": ck[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    schema = T.StructType([queries.schema["query_id"], vectors.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    found = pairs.mapInPandas(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "rank", "chunk_id", "score")


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, value: the mean vector of each key, scaled to unit length, per dimension; keys whose mean has no direction drop out. Combined on the map side, no vector is gathered."""
    means = df.select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = means.groupBy(key).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length")).filter("length > 0")
    return means.join(length, key).select(key, "dim", (F.col("m") / F.col("length")).alias("value"))


def pooled(hidden: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Mean of each text's first ``lengths`` token vectors, scaled to unit length, in double precision; an error where that has no direction."""
    mask = np.arange(hidden.shape[1])[None, :] < np.asarray(lengths)[:, None]
    total = (hidden.astype(np.float64) * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
    size = np.linalg.norm(total, axis=1, keepdims=True)
    if not np.isfinite(size).all() or (size == 0).any():
        raise ValueError("a pooled vector has no direction")
    return (total / size).astype(np.float32)


def coverage(chunks: DataFrame, vectors: DataFrame, fingerprint: str, by: str | None = None) -> DataFrame:
    """embedded, stale, missing: chunks with a vector of the profile, with only others', with none; over all or for each ``by``."""
    state = vectors.groupBy("chunk_id").agg(F.max(F.col("fingerprint") == fingerprint).alias("_mine"))
    ids = chunks.select(F.col("id").alias("chunk_id"), *([by] if by else [])).filter("chunk_id is not null").dropDuplicates(["chunk_id"])
    joined = ids.join(state, "chunk_id", "left")
    aggs = [F.count_if(F.col("_mine")).alias("embedded"), F.count_if(~F.col("_mine")).alias("stale"), F.count_if(F.col("_mine").isNull()).alias("missing")]
    return (joined.groupBy(by) if by else joined).agg(*aggs)


def unembedded(chunks: DataFrame, vectors: DataFrame, fingerprint: str) -> DataFrame:
    """The chunks without a vector of the profile."""
    return chunks.dropDuplicates(["id"]).join(vectors.filter(F.col("fingerprint") == fingerprint).select(F.col("chunk_id").alias("id")), "id", "left_anti")


def still_current(new: DataFrame, chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """New vectors (chunk_id, content, ...) whose chunk still has that content and no vector yet."""
    same = chunks.select(F.col("id").alias("chunk_id"), "content")
    return new.join(same, ["chunk_id", "content"], "left_semi").join(existing.select("chunk_id"), "chunk_id", "left_anti")


def only_profile(vectors: DataFrame, fingerprint: str) -> DataFrame:
    """The vectors, of which one of another profile fails the job: vectors of two models must not be stored side by side."""
    other = F.raise_error(F.concat(F.lit("a vector of another profile: chunk "), F.col("chunk_id").cast("string")))
    return vectors.filter(F.when(F.col("fingerprint").eqNullSafe(fingerprint), F.lit(True)).otherwise(other))


class BrokenModel(RuntimeError):
    """Raised by a model that can't embed anything any more; the run stops instead of trying the rest."""


def embed(chunks: DataFrame, inputs: str, model: Callable[[list[str]], np.ndarray], batch: int = 8) -> DataFrame:
    """id, vector, error: the model's vector of each text, in batches of ``batch`` sorted by length; a batch that fails is tried text by text, and a text that fails alone gets an error instead of a vector. The model is any function from texts to rows of numbers; it is shipped to the workers, so it should load what it needs on first use."""
    ship(chunks.sparkSession)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            order = b[inputs].str.len().argsort(kind="stable").to_numpy()
            vectors: list = [None] * len(b)
            errors: list = [None] * len(b)
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                try:
                    for i, v in zip(rows, model(b[inputs].iloc[rows].tolist())):
                        vectors[i] = np.asarray(v, np.float32)
                except BrokenModel:
                    raise
                except Exception:  # noqa: BLE001 - any failure of a foreign model
                    for i in rows:
                        try:
                            vectors[i] = np.asarray(model([b[inputs].iloc[i]])[0], np.float32)
                        except BrokenModel:
                            raise
                        except Exception as e:  # noqa: BLE001
                            errors[i] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"id": b["id"], "vector": vectors, "error": errors})

    return chunks.select("id", inputs).filter(F.col(inputs).isNotNull()).mapInPandas(run, schema)
