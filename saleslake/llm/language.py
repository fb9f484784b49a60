"""Language identification: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection.

A text is folded (A-Z to lower case, other ASCII signs to one blank) and every 3 and 4 bytes of it, word edges
included, are hashed to a bucket; its vector is the mean of the buckets' embeddings. Embeddings and softmax are trained
by stochastic gradient descent in numpy, on ``SAMPLE_ROWS`` labelled documents at most, spread evenly over the
languages by a hash of the id. As both layers are linear, scoring uses one table of buckets by languages.

Another ``CHECK_ROWS`` documents calibrate the scores (a temperature) and the rejection. The largest of n softmax values
says which language is nearest, not whether any is near; so a second table holds the logarithm of each bucket's share
in each language, and a text's typicality is its mean there less the usual mean of the language's check documents, under
the language where that is largest. Check documents scored without their own language stand for unlearned languages.
The bound is where the shares of unknown texts that go and of known texts that stay are largest together, in the middle
of such a range, with ``REJECT_SHARE`` of the known ones rejected at most; ``known_rejected`` and ``unknown_rejected`` of
the model tell both shares.

Defined cases: a null text or one without letters is ``und`` with score 0 and rejected; without labelled documents every
text is; rows that share an id are scored one by one; a missing id is in no held-out fold and not learned from; an
empty table gives an empty result; other columns are ignored by ``identify`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import buffers, keyed, text_pieces

ORDERS, BUCKETS, DIMENSIONS = (3, 4), 4096, 16
#: Labelled documents to learn from and to calibrate with, at most; and languages, the most frequent ones.
SAMPLE_ROWS, CHECK_ROWS, LANGUAGES = 1600, 1600, 200
EPOCHS, BATCH, RATE, SEED = 30, 32, 0.5, 11
REJECT_SHARE = 0.002
#: Of a language's bucket shares, what stands for those that it has not shown.
UNSEEN = 0.02
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (orders * buckets + 1, languages): embedding times softmax weights; the last row is zero
    bias: np.ndarray
    temperature: float
    usual: np.ndarray  # (orders * buckets + 1, languages): logarithms of the buckets' shares; the last row is zero
    mean: np.ndarray  # usual mean of each language's documents under it
    threshold: float
    known_rejected: float
    unknown_rejected: float


def held_out(id_col: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def folding() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def subwords(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket of the subword at every byte (the number of all buckets: none)."""
    folded = folding()[data].astype(np.uint32)
    n = len(data)
    last = np.repeat(offsets[1:], np.diff(offsets))
    none = len(ORDERS) * BUCKETS
    out = []
    for k, order in enumerate(ORDERS):
        if n < order:
            out.append(np.full(n, none, np.int32))
            continue
        code = np.zeros(n - order + 1, np.uint32)
        blank = np.ones(n - order + 1, bool)
        for i in range(order):
            part = folded[i : n - order + 1 + i]
            code = code * np.uint32(0x01000193) + part
            blank &= part == 32
        code ^= code >> np.uint32(15)
        bucket = np.full(n, none, np.int32)
        bucket[: len(code)] = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)).astype(np.int32) + k * BUCKETS
        bucket[: len(code)][blank] = none
        bucket[np.arange(n) + order > last] = none
        out.append(bucket)
    return out


def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of every bucket in a text, as 16-bit floats (times 256)."""
    size = len(ORDERS) * BUCKETS
    for rows, data, offsets in text_pieces(batches):
        found = subwords(data, offsets)
        out = []
        for i in range(len(rows)):
            counts = sum(np.bincount(x[offsets[i] : offsets[i + 1]], minlength=size + 1) for x in found)[:size]
            out.append((256 * counts / max(1, counts.sum())).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([rows.column("lang"), pa.array(out, pa.binary())], ["lang", "shares"])


def fit(docs: DataFrame, learn: Column | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model from the documents with a language for which ``learn`` holds; None without any."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    if learn is not None:
        rows = rows.filter(learn)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    each = max(1, (sample_rows + CHECK_ROWS) // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, -(-each * 1_000_000 // n))])
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")]).limit(2 * (sample_rows + CHECK_ROWS))
    got = drawn.select("text", "lang").mapInArrow(histograms, "lang string, shares binary").toArrow()
    if not len(got):
        return None
    labels = np.array(got.column("lang").to_pylist())
    packed = buffers(got.column("shares"))[0].view(np.float16).reshape(len(got), -1)
    order = np.lexsort(((packed[:, :64].astype(np.float32) / 256).sum(axis=1), labels))  # not the order in which tasks ended
    shares = packed[order].astype(np.float32)
    del got, packed  # the driver holds the sample once
    shares /= 256
    return train(shares, labels[order], sample_rows)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bound(known: np.ndarray, unknown: np.ndarray) -> float:
    """Middle of the typicalities below which most unknown and fewest known texts lie, at most ``REJECT_SHARE`` of these."""
    known, unknown = np.sort(known), np.sort(unknown)
    cuts = np.unique(np.concatenate([known[: int(REJECT_SHARE * len(known)) + 1], unknown[unknown <= known[int(REJECT_SHARE * len(known))]]]))
    gain = np.searchsorted(unknown, cuts) / max(1, len(unknown)) - np.searchsorted(known, cuts) / len(known)
    best = cuts[gain == gain.max()][-1]
    below = unknown[unknown < best]
    return float((best + below[-1]) / 2 if len(below) else best)


def train(shares: np.ndarray, labels: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> Model:
    languages = sorted(set(labels.tolist()))
    target = np.searchsorted(languages, labels)
    random = np.random.default_rng(SEED)
    order = random.permutation(len(labels))
    checked = max(len(order) // 5, len(order) - sample_rows)
    check, own = (order[:checked], order[checked:]) if len(order) >= 50 else (order, order)
    spread = 1 / np.sqrt(np.maximum(np.mean([np.dot(shares[i], shares[i]) for i in own]), 1e-9))
    embedding = random.normal(0, 0.1, (shares.shape[1], DIMENSIONS)).astype(np.float32)
    weights, bias = random.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(random.permutation(own), max(1, len(own) // BATCH)):
            x = shares[part] * spread
            middle = x @ embedding
            slope = softmax(middle @ weights + bias)
            slope[np.arange(len(part)), target[part]] -= 1
            slope /= len(part)
            back = slope @ weights.T
            weights -= rate * middle.T @ slope
            bias -= rate * slope.sum(axis=0)
            embedding -= rate * x.T @ back
    table = np.concatenate([spread * embedding @ weights, np.zeros((1, len(languages)), np.float32)])
    logits = shares[check] @ table[:-1] + bias
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(check)), target[check]] + 1e-12).mean() for t in np.geomspace(0.05, 5, 40)}
    temperature = float(min(losses, key=losses.get))
    usual = np.stack([shares[own[target[own] == k]].mean(axis=0) if (target[own] == k).any() else np.zeros(shares.shape[1]) for k in range(len(languages))], axis=1) + UNSEEN / shares.shape[1]
    usual = np.log(usual / usual.sum(axis=0)).astype(np.float32)
    means = shares @ usual
    seen = [own_rows if len(own_rows := check[target[check] == k]) else np.flatnonzero(target == k) for k in range(len(languages))]
    mean = np.array([means[rows, k].mean() for k, rows in enumerate(seen)], np.float32)
    typical = means[check] - mean
    others = np.where(np.arange(len(languages)) == target[check][:, None], -np.inf, typical).max(axis=1)[: len(check) * (len(languages) > 1)]
    known = typical.max(axis=1)
    threshold = bound(known, others)
    usual = np.concatenate([usual, np.zeros((1, len(languages)), np.float32)])
    return Model(languages, table.astype(np.float32), bias, temperature, usual, mean, threshold, float((known < threshold).mean()), float((others < threshold).mean()) if len(others) else float("nan"))


def scored(shared):
    """For ``mapInArrow``: language, score and typicality of every text, whatever its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        none, n = len(ORDERS) * BUCKETS, len(model.languages)
        table = np.concatenate([model.table, model.usual], axis=1)
        added = ("lang_pred", "score", "typical")
        for rows, data, offsets in text_pieces(batches):
            total = np.zeros((len(rows) + 1, 2 * n), np.float32)
            count = np.zeros(len(rows), np.int64)
            starts = offsets[:-1]
            full = np.flatnonzero(np.diff(offsets) > 0)
            for bucket in subwords(data, offsets) if len(full) else ():
                total[full] += np.add.reduceat(table[bucket], starts[full], axis=0)
                count[full] += np.add.reduceat((bucket != none).astype(np.int64), starts[full])
            mean = total[:-1] / np.maximum(count, 1)[:, None]
            chance = softmax((mean[:, :n] + model.bias) / model.temperature)
            typical = (mean[:, n:] - model.mean).max(axis=1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([
                *[rows.column(c) for c in rows.schema.names if c not in added],
                pa.array(np.array(model.languages)[chance.argmax(axis=1)], pa.string()), pa.array(chance.max(axis=1).astype(np.float64).clip(0, 1)), pa.array(typical)],
                [*[c for c in rows.schema.names if c not in added], *added])

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected."""
    rows = keyed(docs, id_col, text_col).withColumn("letters", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    out = rows.mapInArrow(scored(shared), "doc_id long, text string, letters boolean, lang_pred string, score double, typical double")
    return out.select(
        "doc_id", F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
        (~F.col("letters") | (F.col("typical") < model.threshold)).alias("rejected"))


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns, in one pass without a shuffle."""
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    score_batches, threshold = scored(shared), model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text_col))], ["text"])
            scores = [part.column("typical").to_numpy() for part in score_batches(iter([text]))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return docs.filter(F.col(f"`{text_col}`").rlike("\\p{L}")).mapInArrow(run, docs.schema)


def report(docs: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """Learns from the documents outside the fold and predicts all: doc_id, held_out, lang_pred, score, rejected."""
    fold = held_out(F.col("doc_id"), parts, part)
    model = fit(docs, ~fold)
    return identify(docs, model).withColumn("held_out", fold).select("doc_id", "held_out", "lang_pred", "score", "rejected")

