"""Overlapping text windows for the vector index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake import vocab
from saleslake.functions.parsing import bind, strip


def window_texts(text: Column, size: int = vocab.CHUNK_SIZE, overlap: int = vocab.CHUNK_OVERLAP) -> Column:
    """Array of the overlapping windows covering ``text``.

    A window ends after the last ``". "`` in its final fifth, else after ``size``
    characters; the next one starts ``overlap`` characters earlier. One regular
    expression cuts the text at the window ends in a single pass, the first part being
    longer than the others by the overlap: what is left if it fits, else up to the last
    sentence end in reach, else the full step. A window is a part with the end of the
    part before it.
    """

    def part(length: int) -> str:
        shortest = length - size // 5
        return rf".{{1,{length}}}\z|.{{{shortest},{length - 2}}}\.(?= )|.{{{length}}}"

    pattern = rf"(?s)\A(?:{part(size)})|{part(size - overlap)}"

    def joined(parts: Column) -> Column:
        return F.transform(
            parts,
            lambda p, i: F.concat(
                F.when(i > 0, F.right(F.get(parts, i - 1), F.lit(overlap))).otherwise(F.lit("")), p
            ),
        )

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), joined)


def doc_prefix(filename: Column, account: Column) -> Column:
    """Id shared by all chunks of a document: hash of its file and account name."""
    raw = F.concat(strip(F.lower(filename)), F.lit("|"), strip(F.lower(F.coalesce(account, F.lit("")))))
    return F.substring(F.sha2(raw, 256), 1, 16)


def chunk(docs: DataFrame, filename: str = "filename", account: str = "account_name", text: str = "text") -> DataFrame:
    """One row per chunk of every document of at least 50 characters.

    No shuffle: windows are computed and exploded where the document lies.
    """
    prefix = doc_prefix(F.col(filename), F.col(account))
    texts = bind(
        strip(F.col(text)),
        lambda body: F.when(
            F.length(body) >= vocab.MIN_TEXT_CHARS,
            F.filter(F.transform(window_texts(body), strip), lambda t: t != ""),
        ),
    )
    kept = [c for c in docs.columns if c != text]
    # The outer form keeps Spark from adding a filter that would cut every text twice.
    return (
        docs.withColumns({"source_doc_prefix": prefix, "_texts": texts})
        .withColumn("total_chunks", F.size("_texts").cast("bigint"))
        .select(*kept, "source_doc_prefix", "total_chunks", F.posexplode_outer("_texts").alias("_pos", "chunk_text"))
        .where(F.col("chunk_text").isNotNull())
        .select(
            *kept,
            "source_doc_prefix",
            "total_chunks",
            F.col("_pos").cast("bigint").alias("chunk_index"),
            F.concat("source_doc_prefix", F.lit("_chunk_"), F.col("_pos").cast("string")).alias("chunk_id"),
            "chunk_text",
        )
    )
