"""Quality classifier: a convolutional network over bytes, in numpy.

``FILTERS`` filters of ``TAPS`` bytes slide over the text, starting at every byte; a filter is a table of a weight for
every byte at every tap. Their outputs are max-pooled over overlapping chunks of ``CHUNK_BLOCKS`` blocks of
``BLOCK`` bytes that cover the whole document, passed through a ramp, averaged over the chunks and combined by a hidden
layer to one probability. Training is by stochastic gradient descent on ``SAMPLE_ROWS`` labelled documents at most,
evenly of both classes by a hash of the id; training reads all chunks of these, scoring every byte of every document.

Defined cases: null and empty texts have one empty chunk and get its score; byte 0 starts no window; several labels of
a document count as their majority (a tie as 1); without labels of both classes every score is the share of label 1,
or 0.5 without any; a missing id is never learned from; rows that share an id are scored one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import keyed, text_pieces
from saleslake.llm.language import held_out

FILTERS, TAPS, HIDDEN = 16, 6, 16
BLOCK, CHUNK_BLOCKS, CHUNK_STEP = 64, 8, 7
#: Labelled documents to learn from, at most, and chunks that a step of training filters at once.
SAMPLE_ROWS, CHUNKS_AT_ONCE = 1600, 512
EPOCHS, BATCH, RATE, SEED = 12, 24, 0.01, 5
#: Output of a window that starts in padding: below every other.
NOTHING = -1e6


@dataclass
class Network:
    taps: np.ndarray  # (TAPS, 256, FILTERS)
    floor: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zeros to whole blocks, and each text's first block. Enough zeros follow every text that no
    window reaches into the next one."""
    size = np.diff(offsets)
    blocks = -(-(size + TAPS) // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(first[-1] * BLOCK + TAPS, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], size)] = data
    return out, first


def pair_tables(taps: np.ndarray) -> list[np.ndarray]:
    """For each pair of taps the summed weights of both bytes: half as many look-ups."""
    weights = taps.copy()
    weights[0, 0, :] = NOTHING
    return [np.ascontiguousarray((weights[k][:, None, :] + weights[k + 1][None, :, :]).reshape(65536, -1)) for k in range(0, TAPS, 2)]


def block_peaks(padded: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Largest output of each filter in each block."""
    n = len(padded) - TAPS
    pairs = padded[:-1].astype(np.uint16) << 8 | padded[1:]
    out = tables[0][pairs[:n]]
    for k in range(1, len(tables)):
        out += tables[k][pairs[2 * k : 2 * k + n]]
    return out.reshape(-1, BLOCK, out.shape[1]).max(axis=1)


def chunk_bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block of every chunk, and how many chunks each text has."""
    blocks = np.diff(first)
    count = np.maximum(1, -(-(blocks - 1) // CHUNK_STEP))
    of = np.repeat(np.arange(len(blocks)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    low = first[of] + k * CHUNK_STEP
    return low, np.minimum(low + CHUNK_BLOCKS, first[of + 1]), count


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def scores(network: Network, tables: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    padded, first = laid_out(data, offsets)
    peaks = np.concatenate([block_peaks(padded, tables), np.zeros((1, FILTERS), np.float32)])
    low, high, count = chunk_bounds(first)
    pooled = np.maximum.reduceat(peaks, np.stack([low, high], axis=1).ravel(), axis=0)[::2]
    ramp = np.maximum(0, pooled + network.floor)
    mean = np.add.reduceat(ramp, np.cumsum(count) - count, axis=0) / count[:, None]
    return sigmoid(np.tanh(mean @ network.inner + network.inner_bias) @ network.outer + network.outer_bias)


def all_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the chunks of each text."""
    for rows, data, offsets in text_pieces(batches):
        padded, first = laid_out(data, offsets)
        low, high, count = chunk_bounds(first)
        start = np.cumsum(count) - count
        out = [b"".join(padded[a * BLOCK : b * BLOCK].tobytes().ljust(CHUNK_BLOCKS * BLOCK, b"\0") for a, b in zip(low[s : s + n], high[s : s + n])) for s, n in zip(start, count)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "chunks"])


def highest(taps: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in each chunk each filter's output is largest, and that output."""
    places = CHUNK_BLOCKS * BLOCK - TAPS + 1
    peaks, pooled = [], []
    for first in range(0, len(x), CHUNKS_AT_ONCE):
        part = x[first : first + CHUNKS_AT_ONCE]
        out = taps[0][part[:, :places]]
        for k in range(1, TAPS):
            out += taps[k][part[:, k : k + places]]
        out[part[:, :places] == 0] = NOTHING
        peaks.append(out.argmax(axis=1))
        pooled.append(np.take_along_axis(out, peaks[-1][:, None, :], axis=1)[:, 0, :])
    return np.concatenate(peaks), np.concatenate(pooled)


def train(chunks: list[np.ndarray], labels: np.ndarray, prior: float) -> Network:
    """``chunks``: for each document an array (chunks, bytes)."""
    random = np.random.default_rng(SEED)
    net = Network(
        random.normal(0, 0.3, (TAPS, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        random.normal(0, 0.4, (FILTERS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
        random.normal(0, 0.4, HIDDEN).astype(np.float32), 0.0)
    weights = [net.taps, net.floor, net.inner, net.inner_bias, net.outer, np.zeros(1, np.float32)]
    speed = [np.zeros_like(w) for w in weights]
    square = [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(labels))
        for part in np.array_split(order, max(1, len(order) // BATCH)):
            held = [chunks[i] for i in part]
            count = np.array([len(x) for x in held])
            x = np.concatenate(held)
            peak, pooled = highest(weights[0], x)
            ramp = np.maximum(0, pooled + weights[1])
            starts = np.cumsum(count) - count
            mean = np.add.reduceat(ramp, starts, axis=0) / count[:, None]
            middle = np.tanh(mean @ weights[2] + weights[3])
            slope = (sigmoid(middle @ weights[4] + weights[5][0]) - labels[part]) / len(part)
            back = (slope[:, None] * weights[4]) * (1 - middle**2)
            to_ramp = np.repeat(back @ weights[2].T / count[:, None], count, axis=0) * (pooled + weights[1] > 0)
            taps = np.zeros_like(weights[0])
            chunk = np.arange(len(x))[:, None]
            for k in range(TAPS):
                np.add.at(taps[k], (x[chunk, peak + k], np.arange(FILTERS)[None, :]), to_ramp)
            slopes = [taps, to_ramp.sum(axis=0), mean.T @ back, back.sum(axis=0), middle.T @ slope, slope.sum(keepdims=True)]
            # Stochastic gradient steps of adapted size (running mean and square of the slopes).
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for w, v, s, g in zip(weights, speed, square, slopes):
                v += 0.1 * (g - v)
                s += 0.001 * (g * g - s)
                w -= rate * (v / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
    drawn = labels.mean()
    shift = np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn))
    return Network(weights[0], weights[1], weights[2], weights[3], weights[4], float(weights[5][0] + shift))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample_rows: int = SAMPLE_ROWS,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network | float:
    """Network from the labelled documents for which ``learn`` (on doc_id) holds; without both classes, a share."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    if learn is not None:
        known = known.filter(learn)
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return 0.5 if not total else float(counts.get(1, 0) > 0)
    each = sample_rows // 2
    share = F.when(F.col("label") == 1, -(-each * 1_000_000 // counts[1])).otherwise(-(-each * 1_000_000 // counts[0]))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).limit(2 * sample_rows)
    texts = keyed(docs, id_col, text_col).filter("doc_id IS NOT NULL").join(F.broadcast(drawn), "doc_id").limit(2 * sample_rows)
    got = texts.mapInArrow(all_chunks, "doc_id long, label int, chunks binary").toArrow().sort_by([("doc_id", "ascending")])
    marks = got.column("label").to_numpy().astype(np.float32)
    if not len(marks) or marks.min() == marks.max():
        return counts[1] / total
    chunks = [np.frombuffer(x, np.uint8).reshape(-1, CHUNK_BLOCKS * BLOCK) for x in got.column("chunks").to_pylist()]
    return train(chunks, marks, counts[1] / total)


def score(docs: DataFrame, network: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    rows = keyed(docs, id_col, text_col)
    if isinstance(network, float):
        out = rows.select("doc_id", F.lit(network).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(vars(network))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Network(**shared.value)
            tables = pair_tables(held.taps)
            for part, data, offsets in text_pieces(batches, limit=1 << 20):
                found = scores(held, tables, data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.astype(np.float64))], ["doc_id", "score"])

        out = rows.mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def report(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1) -> DataFrame:
    """Learns from the labels outside the fold and scores all: doc_id, held_out, score, predicted."""
    fold = held_out(F.col("doc_id"), parts, part)
    return score(docs, fit(docs, labels, ~fold)).withColumn("held_out", fold).select("doc_id", "held_out", "score", "predicted")
