"""Exact dedup in DataFrame functions: two passes of a Bloom filter, then an exact grouping of what it lets through.

Pass one hashes every normalised text to ``PROBES`` positions of a bit array and keeps the bits that were hit at least
twice. Pass two probes each row: a row with a bit that was hit once only is unique and passes straight through; the
rest, all true repeats and a few false ones, are shuffled and grouped by SHA-256.

The texts are read once: a narrow stored table (id, digest, positions) serves both passes. The bits have a fixed upper
size (``MAX_BITS``), so the broadcast is bounded at every input size; beyond that size more unique rows are shuffled
and grouped, which costs time, not correctness. Counts are aggregated per task before each shuffle and the join of the
repeats with their groups is between two stored tables, where adaptive execution splits a hot group.

Defined cases: a null text counts as empty; a null id is smaller than every other and is returned as null; rows that
share id and text get the same result and count once each in ``group_size``; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import quoted, stored, unused

#: Bits for each row; probes of each row; bits at most (64 MB), a power of two like the least.
BITS_PER_ROW, PROBES, MIN_BITS, MAX_BITS = 16, 2, 1 << 15, 1 << 29
#: Bits in one bitmap of Spark's bitmap functions.
BITMAP = 32768

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def filter_bits(rows: int) -> int:
    wanted = max(MIN_BITS, rows * BITS_PER_ROW)
    return min(MAX_BITS, 1 << (wanted - 1).bit_length())


def repeated_bits(digests: DataFrame) -> DataFrame:
    """Bitmaps of the positions that were hit at least twice."""
    hits = digests.select(F.explode("at").alias("at")).groupBy("at").count().filter("count > 1")
    return hits.groupBy((F.col("at") / BITMAP).cast("long").alias("block")).agg(
        F.expr(f"bitmap_construct_agg(at % {BITMAP})").alias("bits"))


def probe(digests: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Marks each row ``maybe``: whether all of its positions were hit at least twice."""
    out = digests
    for i in range(PROBES):
        side = F.broadcast(bitmaps.select(F.col("block").alias(f"block{i}"), F.col("bits").alias(f"bits{i}")))
        out = out.join(side, (F.col("at")[i] / BITMAP).cast("long") == F.col(f"block{i}"), "left").drop(f"block{i}")
        place = F.col("at")[i] % BITMAP
        byte = F.conv(F.hex(F.substring(F.col(f"bits{i}"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.expr("true") & (F.call_function("shiftright", byte, (place % 8).cast("int")) % 2 == 1), F.lit(False))
        out = out.withColumn(f"hit{i}", hit).drop(f"bits{i}")
    return out.withColumn("maybe", F.expr(" AND ".join(f"hit{i}" for i in range(PROBES))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The largest id of a group stays."""
    text = normalised(F.col(f"`{text_col}`").cast("string"))
    bits = filter_bits(docs.count())
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("body")).select(
        "doc_id", F.unhex(F.sha2("body", 256)).alias("digest"))
    at = F.array(*[F.pmod(F.xxhash64(F.lit(i), "digest"), F.lit(bits)) for i in range(PROBES)])
    digests = stored(narrow.withColumn("at", at))
    marked = stored(probe(digests, repeated_bits(digests)).select("doc_id", "digest", "maybe"))
    repeats, single = marked.filter("maybe"), marked.filter("NOT maybe")
    groups = stored(repeats.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    through = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    grouped = repeats.join(groups.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    return through.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns; of rows that share id and text, one stays."""
    key, digest, keep_id, keep_digest = unused(docs, "_key", "_digest", "_keep_id", "_keep_digest")
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_digest)).distinct()
    rows = docs.withColumns({
        key: F.col(f"`{id_col}`").cast("long"), digest: F.sha2(F.encode(normalised(F.col(f"`{text_col}`").cast("string")), "UTF-8"), 256)})
    same = F.col(key).eqNullSafe(F.col(keep_id)) & (F.col(digest) == F.col(keep_digest))
    return rows.dropDuplicates([key, digest]).join(kept, same, "left_semi").select(*quoted(docs))
