"""Finds windows of items (bytes or words) that occur more than once, with work that spreads evenly.

Every window of ``width`` items has one anchor: the gram of ``gram`` items with the smallest hash in it. Equal windows
have equal anchors at equal places, so windows can only repeat under the same anchor. Neighbouring windows with one
anchor occurrence form a segment; a document is cut into one segment for every ``(width - gram + 2) / 2`` items or so.

1. A scan hashes the anchors to a bit array of bounded size: bits hit twice, and bits hit with different segment texts.
2. A second scan keeps the segments on repeated bits, with their text where texts differ (once for each 2 MB of input).
3. Different texts of one anchor are compared by the operator's own method, in chunks of many anchors; this finds what
   repeats in the first copy of each text. An anchor with more than ``CROWD`` texts is dealt out by window: each text
   goes to the shares that its windows hash to.
4. Equal segments form a class; its first place is an aggregate, combined in each task before the shuffle. The copies
   after the first repeat as a whole.

Order of documents: by id, a missing id first, then by a hash of the text where rows share an id. Rows that share both
are one document and get the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import NO_ID, Words, buffers, keyed, mixed, prefix_hashes, random_table, range_hash, release, safe_id, separators, stored, text_pieces, window_hash

#: Bits for each expected segment; bits at least and at most (64 MB a map), powers of two.
BITS_PER_SEGMENT, MIN_BITS, MAX_BITS = 8, 1 << 16, 1 << 29
BITMAP = 32768
#: Texts of one anchor that are compared in one share.
CROWD = 1500
#: Crowded anchors that are split, the most crowded ones; each of the rest has less than one in so many of the texts.
CROWDS = 1 << 16
#: Bytes of text that are compared at once.
CHUNK_BYTES = 1 << 20
#: Room for positions in the packed minima, and window starts that are packed at once.
PLACE_BITS, SLICE = 24, 1 << 23


@dataclass(frozen=True)
class Items:
    """What a window consists of: ``width`` bytes, or ``width`` words ended by ``blanks``."""

    width: int
    gram: int
    blanks: tuple[tuple[int, int], ...] | None = None

    def values(self, data: np.ndarray, offsets: np.ndarray):
        """Hash of every item, bounds of the documents in items, and the items' byte ranges (None: items are bytes)."""
        if self.blanks is None:
            return random_table(7)[data], offsets, None
        words = Words(data, offsets, separators(list(self.blanks)))
        return words.hashes(data, 7), words.bounds, words


def sliding_minimum(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours, from running minima over blocks of that size in both directions."""
    n = len(x) - size + 1
    padded = np.full(-(-len(x) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, size)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[size - 1 : size - 1 + n])


def segments(values: np.ndarray, bounds: np.ndarray, items: Items):
    """Segments of documents laid end to end: first window, number of windows, anchor, class."""
    none = np.zeros(0, np.int64)
    n = len(values) - items.width + 1
    if n <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hashes(values)
    grams = window_hash(prefix, items.gram)
    size = items.width - items.gram + 1
    at = np.empty(n, np.int64)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for low in range(0, n, SLICE):
        high = min(n, low + SLICE)
        own = grams[low : high + size - 1]
        packed = (own & ~mask) | np.arange(len(own), dtype=np.uint64)
        at[low:high] = (sliding_minimum(packed, size) & mask).astype(np.int64) + low
    last = np.repeat(bounds[1:], np.diff(bounds))[:n]
    fits = np.arange(n) + items.width <= last
    fresh = np.ones(n, bool)
    fresh[1:] = (at[1:] != at[:-1]) | ~fits[:-1]
    first = np.flatnonzero(fits & fresh)
    stop = np.flatnonzero(np.concatenate([fits[:-1] & (fresh[1:] | ~fits[1:]), fits[-1:]])) + 1
    count = stop - first
    return first, count, grams[at[first]], range_hash(prefix, first, stop - 1 + items.width)


def bit_of(anchor: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(anchor) & np.uint64(bits - 1)).astype(np.int64)


def hits(items: Items, bits: int):
    """For ``mapInArrow``: the bits that anchors hit, how often, and the least and greatest of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_pieces(batches):
            values, bounds, _ = items.values(data, offsets)
            _, _, anchor, kind = segments(values, bounds, items)
            bit = bit_of(anchor, bits)
            kind = (kind >> np.uint64(33)).astype(np.int32)
            order = np.argsort(bit, kind="stable")
            bit, kind = bit[order], kind[order]
            new = np.flatnonzero(np.concatenate([[True], bit[1:] != bit[:-1]])) if len(bit) else np.zeros(0, np.int64)
            if len(new):
                yield pa.RecordBatch.from_arrays([
                    pa.array(bit[new]), pa.array(np.diff(np.append(new, len(bit))).astype(np.int32)),
                    pa.array(np.minimum.reduceat(kind, new)), pa.array(np.maximum.reduceat(kind, new))], ["bit", "n", "low", "high"])

    return run


def bit_maps(source: DataFrame, items: Items, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which bits were hit twice, and which with different classes; two maps of ``bits`` bits on the driver."""
    found = source.mapInArrow(hits(items, bits), "bit long, n int, low int, high int").groupBy("bit").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).filter("n > 1")
    out = gathered(found.withColumn("other", F.when(F.col("low") != F.col("high"), F.col("bit"))), ["bit", "other"], bits)
    return out[0], out[1]


def gathered(rows: DataFrame, columns: list[str], bits: int) -> np.ndarray:
    """A map of ``bits`` bits on the driver for each column of bit numbers (null: none); every row's are in one block."""
    place = [F.expr(f"bitmap_construct_agg({c} % {BITMAP})").alias(c) for c in columns]
    maps = rows.groupBy((F.col(columns[0]) / BITMAP).cast("long").alias("block")).agg(*place)
    out = np.zeros((len(columns), bits // 8), np.uint8)
    for row in maps.toLocalIterator():
        for k, name in enumerate(columns):
            part = np.frombuffer(row[name], np.uint8)
            at = row["block"] * BITMAP // 8
            out[k, at : at + len(part)] = part[: out.shape[1] - at]
    return out


def read_bits(held: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


SEGMENTS = "doc_id long, tk int, at long, n int, anchor long, cls long, body binary, ats array<long>, tks array<int>"


def candidates(items: Items, bits: int, shared, same_document: bool):
    """For ``mapInArrow``: segments on repeated bits. Where texts differ, the first place of each class in a piece has
    the text, and all places of the class in that document (unless ``same_document``, in all rows of its id, with the
    rows' keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, differ = shared.value
        for rows, data, offsets in text_pieces(batches):
            values, bounds, words = items.values(data, offsets)
            first, count, anchor, kind = segments(values, bounds, items)
            bit = bit_of(anchor, bits)
            keep = np.flatnonzero(read_bits(twice, bit))
            first, count, anchor, kind, bit = first[keep], count[keep], anchor[keep], kind[keep], bit[keep]
            doc = np.searchsorted(bounds, first, "right") - 1
            at = first - bounds[doc]
            ids, keys = rows.column("doc_id").to_numpy(), rows.column("tk").to_numpy()
            rank = np.lexsort((keys, ids)).argsort()[doc]
            told = np.flatnonzero(read_bits(differ, bit))
            told = told[np.lexsort((at[told], rank[told], kind[told], anchor[told]))]
            same = (anchor[told[1:]] == anchor[told[:-1]]) & (kind[told[1:]] == kind[told[:-1]])
            new_class = np.concatenate([[True], ~same]) if len(told) else np.zeros(0, bool)
            new_doc = new_class.copy()
            told_by = rank if same_document else ids[doc]
            new_doc[1:] |= told_by[told[1:]] != told_by[told[:-1]]
            heads = np.flatnonzero(new_class)
            edges = np.append(np.flatnonzero(new_doc), len(told))
            ends = edges[np.searchsorted(edges, heads) + 1] if len(heads) else heads
            bodies, ats, tks = [None] * len(first), [None] * len(first), [None] * len(first)
            for a, b in zip(heads.tolist(), ends.tolist()):
                k = told[a]
                low, high = first[k], first[k] + count[k] - 1 + items.width
                if words is not None:
                    low, high = words.starts[low], words.ends[high - 1]
                bodies[k], ats[k] = data[low:high].tobytes(), at[told[a:b]]
                if not same_document:
                    tks[k] = keys[doc[told[a:b]]]
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id").take(pick), rows.column("tk").take(pick), pa.array(at), pa.array(count.astype(np.int32)),
                pa.array(anchor.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(bodies, pa.binary()), pa.array(ats, pa.list_(pa.int64())),
                pa.array(tks, pa.list_(pa.int32()))], ["doc_id", "tk", "at", "n", "anchor", "cls", "body", "ats", "tks"])

    return run


TEXTS = "doc_id long, tk int, anchor long, cls long, body binary, ats array<long>, tks array<int>, share int, shares int"
RUNS = "doc_id long, tk int, start long, count long"


def dealt(items: Items, crowds):
    """For ``mapInArrow`` over texts: of a crowded anchor, one row for each share that a window of the text falls to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded, parts = (np.array(x, np.int64) for x in (sorted(crowds.value), [crowds.value[k] for k in sorted(crowds.value)]))
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            shares = np.ones(len(batch), np.int64)
            if len(crowded) and len(anchor):
                spot = np.searchsorted(crowded, anchor).clip(max=len(crowded) - 1)
                shares = np.where(crowded[spot] == anchor, parts[spot], 1)
            take, share = [np.flatnonzero(shares == 1)], [np.zeros(int((shares == 1).sum()), np.int64)]
            many = np.flatnonzero(shares > 1)
            base = 0
            for rows, data, offsets in text_pieces([batch.take(pa.array(many))], "body") if len(many) else ():
                values, bounds, _ = items.values(data, offsets)
                hashes = window_hash(prefix_hashes(values), items.width)
                for i in range(len(rows)):
                    own = np.unique(hashes[bounds[i] : bounds[i + 1] - items.width + 1] % np.uint64(shares[many[base + i]]))
                    take.append(np.full(len(own), many[base + i]))
                    share.append(own.astype(np.int64))
                base += len(rows)
            take, share = np.concatenate(take), np.concatenate(share)
            out = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(share.astype(np.int32)), pa.array(shares[take].astype(np.int32))], [*out.schema.names, "share", "shares"])

    return run


def compare(items: Items, resolve: Callable, same_document: bool):
    """For ``mapInArrow`` over texts sorted by anchor and share: runs of windows that repeat those of other texts.

    Chunks hold whole groups. ``resolve`` gets the items of the chunk's distinct texts, each with its first place, and
    returns for every window start whether an equal window of an earlier place is in the chunk. Runs are those of the
    text's first place, or (unless ``same_document``) of all its places in the document with the smallest id."""

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        anchor, cls, share, doc, tk = (rows.column(c).to_numpy() for c in ("anchor", "cls", "share", "doc_id", "tk"))
        at = rows.column("ats").combine_chunks()
        at = at.flatten().to_numpy()[np.asarray(at.offsets)[:-1] - np.asarray(at.offsets)[0]]
        order = np.lexsort((at, tk, doc, cls, share, anchor))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (cls[order[1:]] != cls[order[:-1]]) | (anchor[order[1:]] != anchor[order[:-1]]) | (share[order[1:]] != share[order[:-1]])
        pick = order[fresh]
        data, offsets = buffers(rows.column("body").take(pa.array(pick)))
        values, bounds, words = items.values(data, offsets)
        again = resolve(data if words is None else None, values, bounds, doc[pick], tk[pick], at[pick], items.width)
        seg = np.repeat(np.arange(len(pick)), np.diff(bounds))[: len(again)]
        shares = rows.column("shares").to_numpy()[pick]
        if (shares > 1).any():
            hashes = window_hash(prefix_hashes(values), items.width)
            again[len(hashes) :] = False
            of = seg[: len(hashes)]
            again[: len(hashes)] &= hashes % shares[of].astype(np.uint64) == share[pick][of].astype(np.uint64)
        edge = np.ones(len(again) + 1, bool)
        edge[1:-1] = (seg[1:] != seg[:-1]) | ~again[1:] | ~again[:-1]
        first = np.flatnonzero(again & edge[:-1])
        count = np.flatnonzero(again & edge[1:]) + 1 - first
        local, text = first - bounds[seg[first]], seg[first]
        if not len(first):
            return None
        group = np.append(np.flatnonzero(fresh), len(order))
        out: list[list] = [[], [], [], []]
        every, rows_of = rows.column("ats"), rows.column("tks")
        for t in np.unique(text).tolist():
            a, b = np.searchsorted(text, [t, t + 1])
            members = pick[t : t + 1] if same_document else order[group[t] : group[t + 1]]
            for k in members.tolist():
                if doc[k] != doc[pick[t]]:
                    continue
                for place, row in [(at[k], tk[k])] if same_document else zip(every[k].as_py(), rows_of[k].as_py()):
                    out[0].extend([doc[k]] * (b - a))
                    out[1].extend([row] * (b - a))
                    out[2].extend((place + local[a:b]).tolist())
                    out[3].extend(count[a:b].tolist())
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["doc_id", "tk", "start", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            key = batch.column("anchor").to_numpy() ^ batch.column("share").to_numpy().astype(np.int64)
            cut = int(np.flatnonzero(np.diff(key))[-1]) + 1 if len(key) and (key != key[0]).any() else 0
            held.append(batch.slice(0, cut) if cut else batch)
            size += batch.column("body").nbytes
            if cut and size > CHUNK_BYTES:
                if out := solve(pa.Table.from_batches(held)):
                    yield out
                held, size = [], 0
            if cut:
                held.append(batch.slice(cut))
        if held and sum(map(len, held)) and (out := solve(pa.Table.from_batches(held))):
            yield out

    return run


def power_of_two(n: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, int(n) - 1).bit_length()))


def ids_repeat(source: DataFrame) -> bool:
    """Whether an id is on several rows. Where none is, the id alone tells documents apart."""
    return source.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0


def text_key(repeat: bool, text_col: str = "text") -> Column:
    """Second half of a document's key: a hash of the text where ids repeat."""
    return F.hash(F.col(f"`{text_col}`").cast("string")) if repeat else F.lit(0)


def repeats(docs: DataFrame, items: Items, resolve: Callable, same_document: bool, crowd: int = CROWD,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document (doc_id, text) with its runs of repeated windows: ``starts`` and ``counts``, null without any.

    ``same_document``: whether an earlier place in the same document counts, or smaller ids only."""
    spark = docs.sparkSession
    plain = keyed(docs, id_col, text_col)
    tk = text_key(ids_repeat(plain)).alias("tk")
    source = plain.select(safe_id(), tk, "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = (items.width - items.gram + 2) / 2 * (1 if items.blanks is None else 6)
    bits = power_of_two(size / each * BITS_PER_SEGMENT, MIN_BITS, MAX_BITS)
    maps = spark.sparkContext.broadcast(bit_maps(source, items, bits))
    release(spark)
    found = stored(source.mapInArrow(candidates(items, bits, maps, same_document), SEGMENTS))

    texts = found.filter("body IS NOT NULL").select("doc_id", "tk", "anchor", "cls", "body", "ats", "tks")
    crowded = texts.groupBy("anchor").count().filter(F.col("count") > crowd).orderBy(F.desc("count")).limit(CROWDS).collect()
    crowds = spark.sparkContext.broadcast({r["anchor"]: -(-r["count"] // crowd) for r in crowded})
    inner = stored(texts.mapInArrow(dealt(items, crowds), TEXTS).repartition("anchor", "share").sortWithinPartitions("anchor", "share").mapInArrow(
        compare(items, resolve, same_document), RUNS))

    place = F.struct("doc_id", "tk", "at")
    classes = stored(found.groupBy("anchor", "cls").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"))
    later = place > F.col("first") if same_document else F.col("doc_id") > F.col("first.doc_id")
    outer = found.select("doc_id", "tk", "at", "n", "anchor", "cls").join(classes.hint("merge"), ["anchor", "cls"]).filter(later).select(
        "doc_id", "tk", F.col("at").alias("start"), F.col("n").cast("long").alias("count"))

    lists = outer.unionByName(inner).groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "count")).alias("r")).select(
        F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "r.start", "r.count")
    rows = plain.select("doc_id", "text", tk)
    same = (F.coalesce(rows["doc_id"], F.lit(NO_ID)) == lists["_id"]) & (rows["tk"] == lists["_tk"])
    return rows.join(lists, same, "left").select("doc_id", "text", F.col("start").alias("starts"), F.col("count").alias("counts"))
