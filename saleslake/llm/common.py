"""What several operators share: stored tables, Arrow text buffers, words and hashes of byte strings."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslake.session import discard, release, shared_dir  # noqa: F401

#: Stands for a missing id wherever ids are compared: smaller than every other.
NO_ID = -(2**63)
#: Text that is worked on at once in a task; one longer document is worked on alone.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: lost executors re-read files, and every use sees the same rows.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Remove the stored tables of this application; call it when no result of it is read any more."""
    path = f"{shared_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` of a table, whatever other columns it has."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def row_key() -> Column:
    """Second half of a document's key: tells rows apart that share an id but not the text."""
    return F.xxhash64("text").alias("tk")


def safe_id() -> Column:
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker, over all tasks that it runs."""
    module = sys.modules.setdefault("worker_state_of_llm", types.ModuleType("worker_state_of_llm"))
    return module.__dict__.setdefault(name, {})


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, without a Python object per row; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts take up to ``limit`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def text_pieces(batches, column: str = "text", limit: int = PIECE_BYTES):
    """(batch rows, bytes, offsets) of every piece of every record batch."""
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        for a, b in pieces(offsets, limit):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
    give_back()


def give_back() -> None:
    """Return freed memory to the system. Workers outlive their tasks; what they keep would add to the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a finaliser of multiplications and shifts)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_table(seed: int, size: int = 256) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, size, dtype=np.uint64)


#: Odd multiplier of the rolling hashes and its inverse modulo 2**64.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 2**64)
#: Sums modulo 2**64 cancel on some regular texts whatever the multiplier is; a second sum, modulo a prime, does not.
PRIME_BITS = 31
PRIME = (1 << PRIME_BITS) - 1
PRIME_BASE = 1_186_298_651
PRIME_INVERSE = pow(PRIME_BASE, -1, PRIME)


def reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2**62 modulo the prime, in place of slow divisions."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(PRIME_BITS))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(PRIME_BITS))
    x[x == PRIME] = 0
    return x


def prime_powers(base: int, size: int) -> np.ndarray:
    """Powers of a base modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, reduced(out * np.uint64(pow(base, len(out), PRIME)))])
    return out[:size]


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First ``n`` powers of the multiplier and of its inverse, and of the prime's base and its, kept by the worker."""
    state = worker_state("powers")
    if "up" not in state or len(state["up"]) < n:
        size = max(n, PIECE_BYTES + 4096)
        one = np.ones(1, np.uint64)
        state["up"] = np.cumprod(np.concatenate([one, np.full(size - 1, MULTIPLIER, np.uint64)]))
        state["down"] = np.cumprod(np.concatenate([one, np.full(size - 1, INVERSE, np.uint64)]))
        state["rise"], state["fall"] = (prime_powers(base, size).astype(np.uint32) for base in (PRIME_BASE, PRIME_INVERSE))
    return state["up"], state["down"], state["rise"], state["fall"]


class Prefix:
    """Prefix sums of values times powers, modulo 2**64 and (of the mixed values) modulo the prime."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, _, rise, _ = powers(n + 1)
        self.wide, self.prime = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.wide[1:])
        np.cumsum(reduced((values >> np.uint64(64 - PRIME_BITS)) * rise[:n]), out=self.prime[1:])

    def __len__(self) -> int:
        return len(self.wide)

    def hashes(self, starts, ends) -> np.ndarray:
        """One value for both sums of each range, moved to where it would stand at the start."""
        _, down, _, fall = powers(len(self))
        wide = (self.wide[ends] - self.wide[starts]) * down[: len(self)][starts]
        return mixed(wide ^ mixed(reduced(reduced(self.prime[ends] - self.prime[starts]) * fall[: len(self)][starts])))


def prefix_hashes(values: np.ndarray) -> Prefix:
    """``range_hash`` takes the hash of any range of the values from it."""
    return Prefix(values)


def range_hash(prefix: Prefix, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range, the same wherever the range stands."""
    return prefix.hashes(starts, ends)


def window_hash(prefix: Prefix, width: int) -> np.ndarray:
    """Hash of every range of ``width`` values."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return prefix.hashes(slice(0, n), slice(width, None))


class Words:
    """Words of texts laid end to end: byte ranges, document of each, and where each document's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
        inside = ~separator[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:] | edge[1:n]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finish) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self, data: np.ndarray, seed: int = 1) -> np.ndarray:
        return range_hash(prefix_hashes(random_table(seed)[data]), self.starts, self.ends)


def separators(spans: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in spans:
        table[first : last + 1] = True
    return table


#: The characters that end a word by the queries' contracts.
BLANKS = ((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def within(bounds: np.ndarray, n: int, width: int) -> np.ndarray:
    """Whether the range of ``width`` items that starts at each of ``n`` items stays in its document."""
    last = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n) + width <= last


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def covered(starts: np.ndarray, width, n: int) -> np.ndarray:
    """Mask of the items inside the ranges that begin at ``starts`` (``width``: one number or one for each)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0
