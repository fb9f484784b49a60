"""Exact cosine search over a distributed set of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saleslake import vocab

VECTOR_BLOCK, QUERY_BLOCK = 1 << 13, 1 << 10  # vectors and queries that one product compares
# Scores are compared at this many decimals, so that equal vectors tie whatever the order
# in which their products were summed; ties go to the smaller id.
COMPARE_DECIMALS = 10


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a list column as rows."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _names(column: pa.ChunkedArray) -> np.ndarray:
    names = column.combine_chunks().to_numpy(zero_copy_only=False)
    return names.astype(str) if names.dtype == object else names


def _best_of_pair(k: int):
    """Best ``k`` vectors of a block for every query of a block: one matrix product."""

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names, rows, asked, scores = _names(vectors["vec_id"]), [], [], []
        if len(vectors) and len(queries):
            product = np.round(_matrix(queries["embedding"]) @ _matrix(vectors["embedding"]).T, COMPARE_DECIMALS)
            for i, line in enumerate(product):
                near = np.flatnonzero(line >= np.partition(line, -k)[-k]) if len(line) > k else np.arange(len(line))
                top = near[np.lexsort((names[near], -line[near]))[:k]]
                rows.extend(top.tolist())
                asked.extend([i] * len(top))
                scores.extend(line[top].tolist())
        return pa.table({"query_id": queries["query_id"].take(pa.array(asked, pa.int64())), "vec_id": vectors["vec_id"].take(pa.array(rows, pa.int64())),
                         "score": pa.array(scores, pa.float64())})

    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = vocab.TOP_K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k most similar vectors per query.

    ``vectors`` has ``vec_id`` (a number or a text, as chunks have) and ``embedding``, ``queries`` has ``query_id`` and
    ``embedding``; a ``scope`` column in both restricts a query to equal scopes. Both are cut into blocks by a hash of
    their ids, every pair of a vector block and a query block is one task's matrix product, and the k best of each pair
    are merged by query. Nothing passes the driver; a task holds two blocks whatever the sizes of the tables. Rows
    without an embedding are left out, on both sides.
    """
    scope = ["scope"] if "scope" in queries.columns else []
    vectors, queries = (df.where(F.col("embedding").isNotNull()) for df in (vectors, queries))
    cuts = [max(1, -(-df.count() // size)) for df, size in ((vectors, VECTOR_BLOCK), (queries, QUERY_BLOCK))]
    sides = []
    for df, key, own, other in ((vectors, "vec_id", 0, 1), (queries, "query_id", 1, 0)):
        blocks = {f"_block{own}": F.pmod(F.xxhash64(key), F.lit(cuts[own])).cast("int"), f"_block{other}": F.explode(F.sequence(F.lit(0), F.lit(cuts[other] - 1)))}
        placed = df.select(key, "embedding", *scope)
        for name, value in blocks.items():
            placed = placed.withColumn(name, value)
        sides.append((placed.where(F.col("scope").isNotNull()) if scope else placed).groupBy(*scope, "_block0", "_block1"))
    kinds = f"query_id {_kind(queries, 'query_id')}, vec_id {_kind(vectors, 'vec_id')}, score double"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        sides[0].cogroup(sides[1]).applyInArrow(_best_of_pair(k), kinds)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 4).alias("score"))
    )


def above_floor(matches: DataFrame, floor: float = vocab.SCORE_FLOOR) -> DataFrame:
    """Keep the matches of a finished top-k that are similar enough."""
    return matches.where(F.col("score") > floor)


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group, one average per dimension, combined map-side."""
    first = vectors.select(F.size("embedding").alias("n")).first()
    dims = first.n if first else 0
    mean = F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(dims)])
    return vectors.groupBy(group).agg(mean.alias("embedding"))


def replace_documents(index: DataFrame, chunks: DataFrame, prefix: str = "source_doc_prefix") -> DataFrame:
    """The index after re-indexing: all chunks of the incoming documents replaced."""
    incoming = chunks.select(prefix).distinct()
    return index.join(incoming, prefix, "left_anti").unionByName(chunks, allowMissingColumns=True)


def stats(vectors: DataFrame, namespace: str) -> DataFrame:
    """Vector count and dimension per namespace."""
    return vectors.groupBy(F.col(namespace).alias("namespace")).agg(
        F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).cast("bigint").alias("dimension")
    )
