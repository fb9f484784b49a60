"""Ranked lexical search over max-sketches: bounds for all documents of a batch of queries, exact scores for few.

The index holds one row per document: its number of terms, its text, and a sketch of 65,536 coordinates. A term falls on
a coordinate by its hash, and a coordinate keeps the largest impact (the part of a score that hangs on the document) of
the terms that fall on it; only coordinates above zero are stored, impacts are rounded up. The sum of the coordinates of
a query's terms, times their weights, is therefore never below the document's score.

A search takes the queries in batches of bounded size. Each task looks the terms of the whole batch up in the sketches
of a few thousand documents and multiplies them with the weights, which gives all bounds at once. It then scores
documents exactly, by descending bound and a few for each query at a time, until no bound reaches the query's tenth best
exact score. That threshold is kept for the rest of the task, which therefore scores fewer and fewer documents. A task
gives at most ten rows a query; these are merged by a salted and then a final ranking.

Terms are compared byte by byte; the hash only finds them. Sums are whole numbers below 2^53 and stay exact in doubles.
What is broadcast is one batch, at most ``BATCH_CELLS`` weights and ``BATCH_BYTES`` of terms, whatever the size of either
table; a single longer query is a batch of its own.

Defined cases: null and empty texts have no terms, so such a document is never found and such a query finds nothing;
rows of documents that share an id, or are repeated, are ranked as documents of their own; a missing id is smaller than
every other and is returned as null; a repeated query row (same id and text) is answered once, texts that share an
id are answered each; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saleslake.llm.common import NO_ID, NOT_ALNUM, Words, buffers, keyed, lower_ascii, pieces, safe_id, separators, stored, text_pieces

COORDINATES = 1 << 16
#: Impacts are below a million; a stored one counts this many, rounded up.
IMPACT_STEP = 16
#: Weights (terms times queries) and bytes of terms of one batch of queries.
BATCH_CELLS, BATCH_BYTES = 1 << 21, 8 << 20
#: Documents whose bounds are taken at once, and documents scored for each query before bounds are looked at again.
DOCS_AT_ONCE, STEP = 2048, 16
#: Parts in which a query's candidates are ranked first.
SALT = 64
#: Bits of the first filter of term hashes.
FILTER_BITS = 20

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
SKETCHES = "doc_id long, n long, coordinates binary, impacts binary, text string"
FOUND = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass(frozen=True)
class Index:
    """Stored sketches, with the number of documents that have terms and of all their terms."""

    rows: DataFrame
    documents: int
    terms: int


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """How much longer than usual each document is, a hundred being usual."""
    return 10 + (90 * n * documents) // max(terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def split(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words]:
    data = lower_ascii()[raw]
    return data, Words(data, offsets, separators(NOT_ALNUM))


def sketched(documents: int, terms: int):
    """For ``mapInArrow``: the sketch of every document."""

    def binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * 2).astype(np.int32)), pa.py_buffer(values.astype(np.uint16))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in text_pieces(batches):
            data, words = split(raw, offsets)
            doc = np.repeat(np.arange(len(rows), dtype=np.uint64), words.counts)
            # Terms of a document that share the upper 40 bits of the hash count as one: the impact is then too high at most.
            key, tf = np.unique(doc << np.uint64(40) | words.hashes(data) >> np.uint64(24), return_counts=True)
            doc = (key >> np.uint64(40)).astype(np.int64)
            own = impact(tf.astype(np.int64), lengths(words.counts, documents, terms)[doc])
            spot, first = np.unique(key >> np.uint64(24), return_index=True)
            most = np.maximum.reduceat(own, first) if len(first) else own
            starts = np.searchsorted(spot >> np.uint64(16), np.arange(len(rows) + 1).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), pa.array(words.counts.astype(np.int64)), binary(spot & np.uint64(COORDINATES - 1), starts),
                binary(-(-most // IMPACT_STEP), starts), rows.column("text")], ["doc_id", "n", "coordinates", "impacts", "text"])

    return run


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every document: one pass for the number of terms, one for the sketches."""
    plain = keyed(docs, id_col, text_col)
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[0-9A-Za-z\x80-\x{10FFFF}]+"))
    sums = plain.select(n.cast("long").alias("n")).filter("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    rows = plain.select(safe_id(), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sketched(sums["documents"], sums["terms"]), SKETCHES)
    return Index(stored(rows), sums["documents"], sums["terms"])


def askedof(text: str | None) -> list[bytes]:
    """The distinct terms of a query, in order."""
    return sorted(set(TERM.findall((text or "").encode().lower())))


def hashed(terms: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(terms), np.uint8)
    return Words(data, np.array([0, len(data)]), separators(NOT_ALNUM)).hashes(data) if terms else np.zeros(0, np.uint64)


class Vocabulary:
    """The terms of a batch of queries, found in texts by hash and compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        hashes = hashed(terms)
        order = np.argsort(hashes)
        self.terms = [terms[k] for k in order]
        self.hashes = hashes[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two terms of one batch share a hash")
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.terms])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(self.terms), np.uint8)
        self.few = np.zeros(1 << FILTER_BITS, bool)
        self.few[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def occurrences(self, data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(document, term) of every word that is one of the terms."""
        hashes = words.hashes(data)
        at = np.flatnonzero(self.few[hashes >> np.uint64(64 - FILTER_BITS)])
        term = np.searchsorted(self.hashes, hashes[at]).clip(max=max(len(self.hashes) - 1, 0))
        fits = self.hashes[term] == hashes[at] if len(self.hashes) else np.zeros(len(at), bool)
        at, term = at[fits], term[fits]
        size = words.ends[at] - words.starts[at]
        fits = size == self.starts[term + 1] - self.starts[term]
        at, term, size = at[fits], term[fits], size[fits]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        equal = data[np.repeat(words.starts[at], size) + step] == self.bytes[np.repeat(self.starts[term], size) + step]
        fits = np.logical_and.reduceat(equal, first) if len(first) else np.zeros(0, bool)
        return np.searchsorted(words.bounds, at[fits], "right") - 1, term[fits]


def frequencies(index: Index, shared) -> dict[int, int]:
    """Number of documents that hold each term of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        total = np.zeros(len(vocabulary.terms), np.int64)
        for rows, raw, offsets in text_pieces(batches):
            doc, term = vocabulary.occurrences(*split(raw, offsets))
            total += np.bincount(np.unique(doc * len(total) + term) % max(len(total), 1), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0])], ["term", "df"])

    counted = index.rows.select("text").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counted.collect()}


class Best:
    """The best rows of every query so far: higher scores, then smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(queries)]
        self.floor = np.ones(queries)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for q in np.flatnonzero((scores >= self.floor).any(axis=0)).tolist():
            fit = np.flatnonzero(scores[:, q] >= self.floor[q])
            rows = self.rows[q] + [(-int(s), int(i)) for s, i in zip(scores[fit, q], ids[fit])]
            self.rows[q] = sorted(rows)[: self.k]
            if len(self.rows[q]) == self.k:
                self.floor[q] = -self.rows[q][-1][0]


def searched(shared, documents: int, terms: int, k: int):
    """For ``mapInArrow`` over the index: the best documents of the task for every query of the batch."""

    def exact(rows: pa.RecordBatch, n: np.ndarray, vocabulary: Vocabulary, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), weights.shape[1]))
        raw, offsets = buffers(rows.column("text"))
        for a, b in pieces(offsets):
            doc, term = vocabulary.occurrences(*split(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            key, tf = np.unique(doc * weights.shape[0] + term, return_counts=True)
            doc, term = key // weights.shape[0], key % weights.shape[0]
            own = np.zeros((b - a, weights.shape[0]))
            own[doc, term] = impact(tf.astype(np.int64), lengths(n[a:b], documents, terms)[doc])
            out[a:b] = own @ weights
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        vocabulary = Vocabulary(asked)
        spots = (vocabulary.hashes >> np.uint64(48)).astype(np.int64)
        used, column = np.unique(spots, return_inverse=True)
        at_spot = np.zeros((len(used), weights.shape[1]))
        np.add.at(at_spot, column, weights)
        place = np.full(COORDINATES, -1)
        place[used] = np.arange(len(used))
        best = Best(weights.shape[1], k)
        for batch in batches:
            for first in range(0, len(batch), DOCS_AT_ONCE):
                rows = batch.slice(first, DOCS_AT_ONCE)
                ids, n = rows.column("doc_id").to_numpy(), rows.column("n").to_numpy()
                data, starts = buffers(rows.column("coordinates"))
                spot = place[data.view(np.uint16)]
                doc = np.repeat(np.arange(len(rows)), np.diff(starts) // 2)
                impacts = buffers(rows.column("impacts"))[0].view(np.uint16)
                hit = spot >= 0
                sketch = np.zeros((len(rows), len(used)))
                sketch[doc[hit], spot[hit]] = impacts[hit].astype(np.float64) * IMPACT_STEP
                bounds = sketch @ at_spot
                while True:
                    open_ = bounds >= best.floor
                    if not open_.any():
                        break
                    pick = []
                    for q in np.flatnonzero(open_.any(axis=0)).tolist():
                        own = np.flatnonzero(open_[:, q])
                        pick.append(own if len(own) <= STEP else own[np.argpartition(-bounds[own, q], STEP)[:STEP]])
                    pick = np.unique(np.concatenate(pick))
                    best.add(ids[pick], exact(rows.take(pa.array(pick)), n[pick], vocabulary, weights))
                    bounds[pick] = -1
        out = [(q, i, -s) for q, found in enumerate(best.rows) for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(FOUND.types)], schema=FOUND)

    return run


def query_batches(items: DataFrame) -> Iterator[list[tuple]]:
    """Queries (id, terms) in batches of bounded size; queries without terms are left out."""
    held, terms, size = [], set(), 0
    for item_id, text in items.toLocalIterator():
        own = askedof(text)
        more = terms.union(own)
        if held and (len(more) * (len(held) + 1) > BATCH_CELLS or size + sum(map(len, own)) > BATCH_BYTES):
            yield held
            held, more, size = [], set(own), 0
        if own:
            held.append((item_id, own))
            terms, size = more, size + sum(map(len, own))
    if held:
        yield held


def answered(index: Index, batch: list[tuple], k: int, item_type) -> DataFrame:
    """item_id, rank, doc_id, score of one batch."""
    spark = index.rows.sparkSession
    vocabulary = Vocabulary(sorted(set().union(*[terms for _, terms in batch])))
    df = frequencies(index, spark.sparkContext.broadcast(vocabulary.terms))
    number = {t: k for k, t in enumerate(vocabulary.terms)}
    weights = np.zeros((len(vocabulary.terms), len(batch)))
    for q, (_, terms) in enumerate(batch):
        for t in terms:
            weights[number[t], q] = weight(index.documents, df.get(number[t], 0))
    run = searched(spark.sparkContext.broadcast((vocabulary.terms, weights)), index.documents, index.terms, k)
    found = index.rows.mapInArrow(run, "query int, doc_id long, score long")
    order = [F.desc("score"), F.asc("doc_id")]
    some = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))).withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(q, item_id) for q, (item_id, _) in enumerate(batch)], f"query int, item_id {item_type}")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of every item with a score above 0: item_id, rank, doc_id, score."""
    spark: SparkSession = index.rows.sparkSession
    asked = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for batch in query_batches(asked):
        part = answered(index, batch, k, kind)
        out = out.unionByName(stored(part))
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return search(build(docs, id_col, text_col), items, k)
