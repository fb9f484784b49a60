"""Benchmark decontamination: a broadcast hash set of the benchmark's windows, probed by every window of the documents.

The benchmark is cut into blocks of items (``BLOCK_BYTES`` of text each, checked by a sum before anything is sent);
every block is hashed, sent to the tasks, and scanned against all documents, and the findings of the blocks are
merged per document. A usual benchmark is one block and one scan, without a shuffle. Hits of the hash set are verified
word by word before they count.

Defined cases: null and empty texts have no words, so nothing is hit; an item without words matches nothing; an item
without an id is hit and cut like any other, but is not counted or listed among the items; an item
repeated or sharing words with others counts under each of its ids; rows that share an id are separate documents;
an empty benchmark or table gives no hits; other columns are ignored by the report and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import NOT_ALNUM, Words, buffers, covered, keyed, lower_ascii, prefix_hashes, quoted, row_key, runs, separators, text_pieces, unused, window_hash, within

WINDOW = 10
#: Benchmark text, in bytes, that one scan of the documents carries.
BLOCK_BYTES = 64 << 20
#: Bits of the first filter of window hashes.
FILTER_BITS = 22

FOUND = pa.schema([
    ("doc_id", pa.int64()), ("tk", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())),
    ("word_starts", pa.list_(pa.int64())), ("word_ends", pa.list_(pa.int64())),
    ("byte_starts", pa.list_(pa.int64())), ("byte_ends", pa.list_(pa.int64())),
])
FOUND_SQL = (
    "doc_id long, tk long, n_words long, items array<string>, word_starts array<long>, word_ends array<long>, "
    "byte_starts array<long>, byte_ends array<long>"
)


def word_list(data: np.ndarray, words: Words, first: int, last: int) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(words.starts[first:last], words.ends[first:last]))


def index_items(items: pa.Table, width: int) -> dict:
    """For each window length: hashes of the windows, and the items of each window's words."""
    data, offsets = buffers(items.column("text"))
    data = lower_ascii()[data]
    words = Words(data, offsets, separators(NOT_ALNUM))
    prefix = prefix_hashes(words.hashes(data))
    by_length: dict[int, dict] = {}
    for i, item in enumerate(items.column("item_id").to_pylist()):
        first, last = int(words.bounds[i]), int(words.bounds[i + 1])
        size = min(width, last - first)
        for k in range(first, last - size + 1) if size else ():
            spot = by_length.setdefault(size, {"at": [], "items": {}})
            spot["at"].append(k)
            spot["items"].setdefault(word_list(data, words, k, k + size), set()).add(item)
    for size, spot in by_length.items():
        spot["hashes"] = np.unique(window_hash(prefix, size)[np.array(spot.pop("at"))])
        few = np.zeros(1 << FILTER_BITS, bool)
        few[spot["hashes"] >> np.uint64(64 - FILTER_BITS)] = True
        spot["filter"] = few
    return by_length


def scan(shared):
    """Function for ``mapInArrow``: what of the broadcast index occurs in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, fold, separator = shared.value, lower_ascii(), separators(NOT_ALNUM)
        for rows, raw, offsets in text_pieces(batches):
            data = fold[raw]
            words = Words(data, offsets, separator)
            n = len(words.starts)
            prefix = prefix_hashes(words.hashes(data))
            steps, found = np.zeros(n + 1, np.int64), {}
            for size, spot in index.items():
                hashes = window_hash(prefix, size)
                hit = np.flatnonzero(spot["filter"][hashes >> np.uint64(64 - FILTER_BITS)])
                where = np.searchsorted(spot["hashes"], hashes[hit]).clip(max=len(spot["hashes"]) - 1)
                hit = hit[spot["hashes"][where] == hashes[hit]]
                hit = hit[within(words.bounds, n, size)[hit]]
                for k, doc in zip(hit.tolist(), (np.searchsorted(words.bounds, hit, "right") - 1).tolist()):
                    items = spot["items"].get(word_list(data, words, k, k + size))
                    if items is not None:
                        found.setdefault(doc, set()).update(items)
                        steps[k] += 1
                        steps[k + size] -= 1
            first, last = runs(np.cumsum(steps[:-1]) > 0)
            # A run that reaches over the end of a document is cut there.
            cuts = words.bounds[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            inside = covered(first, last - first, n) if len(first) else np.zeros(n, bool)
            cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
            first, last = np.sort(np.concatenate([first, cuts])), np.sort(np.concatenate([last, cuts]))
            low, high = np.searchsorted(first, words.bounds[:-1]), np.searchsorted(first, words.bounds[1:])
            out = {name: [] for name in ("items", "word_starts", "word_ends", "byte_starts", "byte_ends")}
            for doc in range(len(rows)):
                a, b = first[low[doc] : high[doc]], last[low[doc] : high[doc]]
                out["items"].append(sorted(str(i) for i in found.get(doc, ()) if i is not None))
                out["word_starts"].append(a - words.bounds[doc])
                out["word_ends"].append(b - words.bounds[doc])
                out["byte_starts"].append(words.starts[a] - offsets[doc] if len(a) else a)
                out["byte_ends"].append(words.ends[b - 1] - offsets[doc] if len(a) else a)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("tk"), pa.array(words.counts, pa.int64())]
                + [pa.array(out[name], FOUND.field(name).type) for name in out], schema=FOUND)

    return run


def findings(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its words, the items that occur, and the hit ranges in words and bytes (those may overlap)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    source = keyed(docs, id_col, text_col).withColumn("tk", row_key())
    parts = []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        shared = spark.sparkContext.broadcast(index_items(own, width))
        parts.append(source.mapInArrow(scan(shared), FOUND_SQL))
    if blocks == 1:
        return parts[0]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # Rows that share id and text are counted, so that each is returned.
    per_row = out.groupBy("doc_id", "tk").agg(
        F.first("n_words").alias("n_words"), (F.count(F.lit(1)) / blocks).cast("int").alias("times"),
        *[F.flatten(F.collect_set(c)).alias(c) for c in ("items",)],
        F.array_sort(F.flatten(F.collect_set(F.arrays_zip("word_starts", "word_ends")))).alias("w"),
        F.array_sort(F.flatten(F.collect_set(F.arrays_zip("byte_starts", "byte_ends")))).alias("b"))
    return per_row.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(
        "doc_id", "tk", "n_words", F.array_distinct("items").alias("items"), F.col("w.word_starts"), F.col("w.word_ends"),
        F.col("b.byte_starts"), F.col("b.byte_ends"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = findings(docs, benchmark, width, block_bytes, id_col, text_col)
    ranges = F.arrays_zip("word_starts", "word_ends")
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))
    hit = F.aggregate(ranges, start, lambda acc, r: F.struct(
        (acc["total"] + F.greatest(F.lit(0).cast("long"), r["word_ends"] - F.greatest(acc["reach"], r["word_starts"]))).alias("total"),
        F.greatest(acc["reach"], r["word_ends"]).alias("reach")), lambda acc: acc["total"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def cut(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    """``text`` without byte ranges that may overlap."""
    if text is None or starts is None or len(starts) == 0:
        return text
    raw, kept, at = text.encode(), [], 0
    for s, e in sorted(zip(starts, ends)):
        kept.append(raw[at : max(at, s)])
        at = max(at, e)
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with hit spans cut out of their texts (``remove='spans'``), or without the hit documents
    (``'documents'``), with all their columns. Word and byte ranges refer to the text as it was."""
    if remove not in ("spans", "documents"):
        raise ValueError(remove)
    own, key, doc, tk, ranges = unused(docs, "_own", "_key", "_doc", "_tk", "_ranges")
    found = findings(docs, benchmark, width, block_bytes, id_col, text_col).filter(F.size("byte_starts") > 0).dropDuplicates(["doc_id", "tk"]).select(
        F.col("doc_id").alias(doc), F.col("tk").alias(tk), F.struct("byte_starts", "byte_ends").alias(ranges))
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.withColumns({own: F.col(f"`{id_col}`").cast("long"), key: F.xxhash64(text)})
    same = F.col(own).eqNullSafe(F.col(doc)) & (F.col(key) == F.col(tk))
    if remove == "documents":
        return rows.join(found, same, "left_anti").select(*quoted(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.schema.get_field_index(text_col)
            texts, spans = batch.column(spot).to_pylist(), batch.column(ranges).to_pylist()
            new = [cut(t, s["byte_starts"], s["byte_ends"]) if s else t for t, s in zip(texts, spans)]
            yield batch.set_column(spot, batch.schema.field(spot), pa.array(new, batch.schema.field(spot).type)).drop_columns([ranges])

    return rows.join(found, same, "left").select(*quoted(docs), ranges).mapInArrow(run, docs.schema)
