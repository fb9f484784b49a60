"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Words are folded (A-Z to lower case); documents with the same words in the same order are one node with a weight.
   A node has ``HASHES`` MinHash values of its shingles.
2. Nodes that agree on a band of ``ROWS`` values meet. A pair at the threshold misses all bands with a chance of
   ``(1 - 0.8**ROWS)**bands``: 2e-9. Pairs that meet are compared value by value, ``STEP`` at a time, and dropped as
   soon as the posterior chance that their similarity reaches the threshold, given the agreements so far and an even
   prior, falls below ``TOLERANCE`` (1e-9). What is left links nodes to candidate clusters. A bucket with more than
   ``CROWD`` nodes is not compared but linked as a whole, so it costs a link a node.
3. In each cluster every pair of nodes goes through the same pruning and the survivors are verified exactly on their
   shingle sets. Large clusters are dealt out in pairs of blocks. Tasks return for each node how many documents it
   links to and a spanning forest of the links, never all pairs.
4. Classes are the connected components of verified links.

Defined cases: null and empty texts and texts without words have no shingles, no links, and a class each; a text of one
to four words has all of its words as its only shingle; documents of equal words are linked to each other; rows that
share an id count as separate documents; a missing id is the smallest; an empty table gives an empty result; other
columns are ignored by ``links`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.anchors import CROWDS, MAX_BITS, MIN_BITS, gathered, ids_repeat, power_of_two, read_bits, text_key
from saleslake.llm.common import BLANKS, NO_ID, Words, keyed, lower_ascii, mixed, prefix_hashes, quoted, random_table, range_hash, safe_id, separators, stored, text_pieces, unused
from saleslake.llm.graph import Forest, components

SHINGLE, THRESHOLD = 5, 0.8
HASHES, ROWS, STEP, TOLERANCE = 84, 3, 12, 1e-9
#: Nodes of a bucket that are compared; nodes of a cluster that one task compares with each other.
CROWD, BLOCK = 256, 1024


def least_agreements(threshold: float, tolerance: float, hashes: int, step: int) -> list[int]:
    """After every ``step`` values: the fewest agreements with which a pair may still reach the threshold.

    With an even prior the posterior of the similarity is a beta distribution; its upper tail is a binomial sum."""
    out = []
    for n in range(step, hashes + 1, step):
        terms = [comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(n + 1)]
        tail = np.cumsum(terms)
        out.append(int(np.searchsorted(tail, tolerance)))
    return out


def shingles(data: np.ndarray, offsets: np.ndarray):
    """Shingle hashes of each document with repeats, bounds of the documents in them, and a hash of all its words."""
    folded = lower_ascii()[data]
    words = Words(folded, offsets, separators(list(BLANKS)))
    prefix = prefix_hashes(words.hashes(folded, 31))
    size = np.maximum(0, words.counts - SHINGLE + 1)
    size[(words.counts > 0) & (size == 0)] = 1
    bounds = np.concatenate([[0], np.cumsum(size)])
    start = np.repeat(words.bounds[:-1] - bounds[:-1], size) + np.arange(bounds[-1])
    stop = np.minimum(start + SHINGLE, np.repeat(words.bounds[1:], size))
    return range_hash(prefix, start, stop), bounds, range_hash(prefix, words.bounds[:-1], words.bounds[1:])


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and MinHash values of every document with words."""
    factors = random_table(33, HASHES) | np.uint64(1)
    addends = random_table(34, HASHES)
    for rows, data, offsets in text_pieces(batches):
        hashes, bounds, node = shingles(data, offsets)
        full = np.flatnonzero(np.diff(bounds) > 0)
        values = np.zeros((len(full), HASHES), np.uint32)
        if len(full):
            for i in range(HASHES):
                values[:, i] = np.minimum.reduceat(((hashes * factors[i] + addends[i]) >> np.uint64(32)).astype(np.uint32), bounds[full])
        pick = pa.array(full)
        yield pa.RecordBatch.from_arrays([
            rows.column("doc_id").take(pick), rows.column("tk").take(pick), pa.array(node[full].view(np.int64)),
            pa.array([v.tobytes() for v in values], pa.binary())], ["doc_id", "tk", "node", "values"])


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("values").to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
        node = batch.column("node").to_numpy()
        parts = values.reshape(len(node), -1, ROWS)
        key = np.zeros(parts.shape[:2], np.uint64) + np.arange(parts.shape[1], dtype=np.uint64)
        for r in range(ROWS):
            key = mixed(key ^ parts[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node, parts.shape[1]))], ["key", "node"])


def shared_buckets(crowd: int):
    """For ``mapInArrow`` over rows sorted by key and node: the rows of buckets with 2 to ``crowd`` nodes, and of larger
    ones a link of each node to the first (``other``). At most ``crowd`` rows are held from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = np.zeros(0, np.int64)
        held_node = np.zeros(0, np.int64)
        hub = None  # (key, first node) of a bucket that is known to be too large

        def out(key, node, other):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(other, pa.int64(), mask=other == -1)], ["key", "node", "other"])

        def settle(key, node):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(key)))
            of, head = np.repeat(size, size), np.repeat(node[first], size)
            small, large = (of > 1) & (of <= crowd), of > crowd
            keep = small | large
            return out(key[keep], node[keep], np.where(large, head, -1)[keep])

        for batch in batches:
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            if not len(key):
                continue
            if hub is not None:
                mine = key == hub[0]
                yield out(key[mine], node[mine], np.full(int(mine.sum()), hub[1]))
                key, node = key[~mine], node[~mine]
                if not len(key):
                    continue
                hub = None
            key, node = np.concatenate([held_key, key]), np.concatenate([held_node, node])
            last = int(np.searchsorted(key, key[-1]))  # rows come sorted
            yield settle(key[:last], node[:last])
            held_key, held_node = key[last:], node[last:]
            if len(held_key) > crowd:
                yield settle(held_key, held_node)
                hub = (held_key[0], held_node[0])
                held_key, held_node = held_key[:0], held_node[:0]
        yield settle(held_key, held_node)

    return run


def survivors(left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature tables that are not dropped, comparing ``STEP`` values at a time."""
    agree = np.zeros((len(left), len(right)), np.int16)
    for k in range(STEP):
        agree += left[:, k][:, None] == right[:, k][None, :]
    i, j = np.nonzero(agree >= least[0])
    agree = agree[i, j]
    for step in range(1, len(least)):
        if not len(i):
            break
        part = slice(step * STEP, (step + 1) * STEP)
        agree = agree + (left[i, part] == right[j, part]).sum(axis=1)
        keep = agree >= least[step]
        i, j, agree = i[keep], j[keep], agree[keep]
    return i, j


def candidate_links(least: list[int]):
    """For ``mapInArrow`` over bucket rows sorted by key: a forest of the pairs that are not dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            key, node = rows.column("key").to_numpy(), rows.column("node").to_numpy()
            values = np.frombuffer(b"".join(rows.column("values").to_pylist()), np.uint32).reshape(-1, HASHES)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            left, right = [], []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
                i, j = survivors(values[a:b], values[a:b], least)
                trees = Forest(b - a)
                for x, y in zip(i.tolist(), j.tolist()):
                    if x < y and trees.join(x, y):
                        left.append(node[a + x])
                        right.append(node[a + y])
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

        for batch in batches:
            key = batch.column("key").to_numpy()
            cut = int(np.flatnonzero(np.diff(key))[-1]) + 1 if len(key) and key[0] != key[-1] else 0
            if len(key) and held and held[-1].num_rows and held[-1].column("key")[-1].as_py() != key[0]:
                yield solve()
                held.clear()
            if cut:
                held.append(batch.slice(0, cut))
                yield solve()
                held.clear()
            if len(key):
                held.append(batch.slice(cut))
        if held:
            yield solve()

    return run


def sets_of(bits: int, shared):
    """For ``mapInArrow`` over documents: node and sorted distinct shingles of the nodes on the given bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_pieces(batches):
            hashes, bounds, node = shingles(data, offsets)
            full = np.diff(bounds) > 0
            pick = np.flatnonzero(full & read_bits(shared.value, (node & np.uint64(bits - 1)).astype(np.int64)))
            _, once = np.unique(node[pick], return_index=True)
            pick = pick[once]
            yield pa.RecordBatch.from_arrays([
                pa.array(node[pick].view(np.int64)), pa.array([np.unique(hashes[bounds[i] : bounds[i + 1]]).tobytes() for i in pick.tolist()], pa.binary())], ["node", "body"])

    return run


def verified(threshold: float, least: list[int]):
    """For ``mapInArrow`` over cluster rows sorted by root and share: documents linked to each node, and a forest.

    Rows of a share are one block, or two blocks whose pairs across are compared."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        node, weight, block = (rows.column(c).to_numpy() for c in ("node", "weight", "block"))
        values = np.frombuffer(b"".join(rows.column("values").to_pylist()), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("body").to_pylist()]
        size = np.array(list(map(len, sets)))
        # Shingles as numbers from 0 on, so that a set is marked by its numbers.
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(size)])
        mark = np.zeros(int(number.max()) + 1, bool)
        links, trees = np.zeros(len(node), np.int64), Forest(len(node))
        left, right = [], []
        low = np.flatnonzero(block == block.min())
        high = np.flatnonzero(block == block.max())
        within = len(low) == len(node)
        for part in np.array_split(low, -(-len(low) // 256)):
            i, j = survivors(values[part], values[high], least)
            i, j = part[i], high[j]
            keep = i < j if within else np.ones(len(i), bool)
            # Sets of too different sizes can't reach the threshold.
            keep &= np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
            i, j = i[keep], j[keep]
            for x in np.unique(i).tolist():
                to = j[i == x]
                mark[number[ends[x] : ends[x + 1]]] = True
                spot = np.repeat(ends[to] - np.concatenate([[0], np.cumsum(size[to])[:-1]]), size[to]) + np.arange(size[to].sum())
                common = np.add.reduceat(mark[number[spot]].astype(np.int64), np.concatenate([[0], np.cumsum(size[to])[:-1]]))
                mark[number[ends[x] : ends[x + 1]]] = False
                near = to[common >= threshold * (size[x] + size[to] - common) - 1e-9]
                links[x] += weight[near].sum()
                links[near] += weight[x]
                for y in near.tolist():
                    if trees.join(x, y):
                        left.append(node[x])
                        right.append(node[y])
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([node[some], np.array(left, np.int64)])), pa.array(np.concatenate([links[some], np.zeros(len(left), np.int64)])),
            pa.array([None] * len(some) + right, pa.int64())], ["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            root, share = batch.column("root").to_numpy(), batch.column("share").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (root[1:] != root[:-1]) | (share[1:] != share[:-1])])) if len(root) else []
            for a, b in zip(first, [*first[1:], len(root)]):
                if last is not None and last != (root[a], share[a]):
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = (root[a], share[a])
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def classes(source: DataFrame, threshold: float, crowd: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Of documents (doc_id, tk, text): those that others have links to, with the first of their class (``first``: a
    struct of id and tk) and ``n_links``; and those that are alone (doc_id)."""
    spark = source.sparkSession
    least = least_agreements(threshold, TOLERANCE, HASHES, STEP)
    found = stored(source.mapInArrow(signatures, "doc_id long, tk int, node long, values binary"))
    nodes = stored(found.groupBy("node").agg(F.min(F.struct("doc_id", "tk")).alias("first"), F.count(F.lit(1)).alias("weight"), F.max("values").alias("values")))

    keys = nodes.select("node", "values").mapInArrow(bands, "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    met = stored(keys.mapInArrow(shared_buckets(crowd), "key long, node long, other long"))
    hubs = met.filter("other IS NOT NULL AND other <> node").select(F.col("node").alias("a"), F.col("other").alias("b"))
    rows = met.filter("other IS NULL").select("key", "node").join(nodes.select("node", "values").hint("merge"), "node").select("key", "node", "values")
    pairs = rows.repartition("key").sortWithinPartitions("key").mapInArrow(candidate_links(least), "a long, b long")
    clusters = stored(components(stored(pairs.unionByName(hubs).distinct())))

    bits = power_of_two(8 * clusters.count(), MIN_BITS, MAX_BITS)
    shared = spark.sparkContext.broadcast(gathered(clusters.select(F.pmod("node", F.lit(bits)).alias("bit")).distinct(), ["bit"], bits)[0])
    sets = stored(source.select("text").mapInArrow(sets_of(bits, shared), "node long, body binary").groupBy("node").agg(F.max("body").alias("body")))
    large = clusters.groupBy("root").count().filter(F.col("count") > block).orderBy(F.desc("count")).limit(CROWDS)
    large = large.select("root", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    shares = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("block")) * F.col("blocks") + F.greatest(o, F.col("block")))
    placed = clusters.join(F.broadcast(large), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", own)
    placed = placed.select("root", "node", "block", F.explode(shares).alias("share"))
    whole = placed.join(nodes.select("node", "weight", "values").hint("merge"), "node").join(sets.hint("merge"), "node")
    solved = stored(whole.repartition("root", "share").sortWithinPartitions("root", "share", "node").mapInArrow(
        verified(threshold, least), "node long, links long, other long"))

    counts = solved.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(stored(solved.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))))
    placed = nodes.select("node", "first", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed.join(counts, "node", "left").filter("weight > 1 OR links > 0"))
    first = placed.groupBy("root").agg(F.min("first").alias("head"))
    info = stored(placed.join(first.hint("merge"), "root").select("node", "head", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))

    several = found.select("doc_id", "tk", "node").join(info.hint("merge"), "node").select("doc_id", "tk", F.col("head").alias("first"), "n_links")
    # Documents that are alone: those without words, and the only ones of nodes without links.
    alone = nodes.filter("weight = 1").select("first.doc_id", "node").join(info.select("node"), "node", "left_anti").select("doc_id")
    wordless = source.filter("text IS NULL OR NOT text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").select("doc_id")
    return several, alone.union(wordless)


def links(docs: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), n_links (other documents at the threshold)."""
    source = keyed(docs, id_col, text_col).select(safe_id(), F.lit(0).alias("tk"), "text")
    several, alone = classes(source, threshold, crowd, block)
    linked = several.select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links")
    single = alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    back = [F.when(F.col(c) != NO_ID, F.col(c)).alias(c) for c in ("doc_id", "class_id")]
    return linked.unionByName(single).select(*back, "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows of one document of each class, the one with the smallest id; of rows that share id and text, one.

    Documents without words are all kept."""
    own, key, gone_id, gone_key = unused(docs, "_own", "_key", "_gone_id", "_gone_key")
    plain = keyed(docs, id_col, text_col)
    repeat = ids_repeat(plain)
    several, _ = classes(plain.select(safe_id(), text_key(repeat).alias("tk"), "text"), threshold, CROWD, BLOCK)
    gone = several.filter(F.struct("doc_id", "tk") != F.col("first")).select(F.col("doc_id").alias(gone_id), F.col("tk").alias(gone_key)).distinct()
    rows = docs.withColumns({own: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), key: text_key(repeat, text_col)})
    kept = rows.join(gone, (F.col(own) == F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti")
    return (kept.dropDuplicates([own, key]) if repeat else kept).select(*quoted(docs))
