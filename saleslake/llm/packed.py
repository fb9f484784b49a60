"""Token ids as compressed binary blocks with a shared zstandard dictionary.

Format: a folder with three Parquet tables.

* ``dictionary``: one row with the dictionary's bytes, its SHA-256 and the width of an id in bytes.
* ``blocks``: documents in ascending order of id, ``BLOCK_BYTES`` of payload or one document in a row. ``payload`` holds
  one zstandard frame for each document, ``ends`` the offset after each frame, ``counts`` the ids in it, ``doc_ids`` the
  documents; ``part`` and ``start`` give the ids before the block in its part, ``dictionary_sha256`` the dictionary.
* ``parts``: for each part the ids before it.

One document is read by its block's ids (pruned by the file's statistics), its offset and one small frame. Spark's
writer commits the tables, so a lost executor leaves no half block. Texts are dealt out by ranges of ids and each task
writes its own; the only sums that pass the driver are one number for each task. The dictionary is trained on
``SAMPLE_ROWS`` documents at most, ``SAMPLE_BYTES`` of ids each; it bears on size, not on results.

Defined cases: a null or empty text has only the end id; the string of a special token becomes its id, as in the
library's plain call; a missing id comes first; rows that share an id are stored one
by one, ordered by text; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslake.llm.common import NO_ID, keyed
from saleslake.llm.tokens import batches_of, json_coder

BLOCK_BYTES, DICTIONARY_BYTES, LEVEL = 1 << 18, 64 << 10, 3
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8 << 10

BLOCKS = (
    "part int, start long, first_doc long, last_doc long, doc_ids array<long>, counts array<int>, ends array<long>, "
    "payload binary, dictionary_sha256 string"
)
FIELDS = pa.schema([
    ("part", pa.int32()), ("start", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())),
    ("payload", pa.binary()), ("dictionary_sha256", pa.string()),
])


def narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """Dictionary of a bounded sample of documents, drawn by a hash of the id."""
    import zstandard

    rows = docs.count()
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // SAMPLE_ROWS))) == 0).limit(SAMPLE_ROWS)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = json_coder(tokenizer)
        for batch in batches_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([narrow(x + end, width)[:SAMPLE_BYTES] for x in coder.encode(batch.column("text").to_pylist())], pa.binary())], ["ids"])

    samples = sorted(drawn.select("text").mapInArrow(run, "ids binary").toArrow().column("ids").to_pylist())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"".join(samples)[:DICTIONARY_BYTES]  # too few or too small to train on: plain content serves


def compression(dictionary: bytes):
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text with a tokenizer (its JSON text), append ``end_id``, and write the tables under ``path``."""
    import zstandard
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    width = 2 if max(end_id, Tokenizer.from_str(tokenizer).get_vocab_size()) < 1 << 16 else 4
    dictionary = train_dictionary(rows, tokenizer, end_id, width)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary), width)], "sha256 string, dictionary binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    sent = spark.sparkContext.broadcast((tokenizer, dictionary))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = json_coder(sent.value[0])
        pack = zstandard.ZstdCompressor(level=LEVEL, **compression(sent.value[1]))
        part, start = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, int, bytes]] = []
        size = 0

        def block() -> pa.RecordBatch:
            known = [NO_ID if i is None else i for i, _, _ in held]
            row = [part, start, known[0], known[-1], [i for i, _, _ in held], [n for _, n, _ in held],
                   np.cumsum([len(f) for _, _, f in held]), b"".join(f for _, _, f in held), name]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, FIELDS.types)], schema=FIELDS)

        for batch in batches_of(batches):
            for i, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist())):
                frame = pack.compress(narrow(ids + end, width))
                if held and size + len(frame) > BLOCK_BYTES:
                    yield block()
                    start += sum(n for _, n, _ in held)
                    held, size = [], 0
                held.append((i, len(ids) // 4 + 1, frame))
                size += len(frame)
        if held:
            yield block()

    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([r["n"] for r in totals])])[:-1] if totals else []
    spark.createDataFrame([(r["part"], int(x)) for r, x in zip(totals, before)], "part int, before long").coalesce(1).write.parquet(f"{path}/parts")


def opened(spark: SparkSession, path: str):
    """The dictionary, checked against its name, and the width of an id."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError(f"damaged dictionary in {path}")
    return row["sha256"], dictionary, row["width"]


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None, digests: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids (``digests``: their CRC-32 as unsigned 32-bit integers); of ``doc_ids`` only
    the asked frames are decompressed."""
    import zstandard

    name, dictionary, width = opened(spark, path)
    sent = spark.sparkContext.broadcast(dictionary)
    wanted = None if doc_ids is None else set(doc_ids)
    blocks = spark.read.parquet(f"{path}/blocks")
    if wanted is not None:
        near = F.lit(False)
        for i in sorted(wanted):
            near = near | ((F.col("first_doc") <= i) & (F.col("last_doc") >= i))
        blocks = blocks.filter(near)
    placed = blocks.join(F.broadcast(spark.read.parquet(f"{path}/parts")), "part").withColumn("start", F.col("start") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**compression(sent.value))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != name:
                    raise ValueError(f"block of another dictionary in {path}")
                counts = np.array(row["counts"], np.int64)
                starts = row["start"] + np.cumsum(counts) - counts
                begins = [0, *row["ends"][:-1]]
                pick = [k for k, i in enumerate(row["doc_ids"]) if wanted is None or i in wanted]
                ids = [np.frombuffer(unpack.decompress(row["payload"][begins[k] : row["ends"][k]]), f"<u{width}") for k in pick]
                last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()) if digests else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["doc_ids"][k] for k in pick], pa.int64()), pa.array(starts[pick], pa.int64()), pa.array(list(map(len, ids)), pa.int64()), last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    kept = placed.select("start", "doc_ids", "counts", "ends", "payload", "dictionary_sha256")
    return kept.mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<int>"))
