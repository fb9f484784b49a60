"""Language-model scoring: an interpolated modified Kneser-Ney model of word pairs, counted in Spark, read by mapping.

Counting. Each task counts the word pairs of some millions of tokens and sends them on in packed arrays, one for each
shard of pairs (``SHARD_BYTES`` of text each; pairs are dealt out by their hash, so a frequent word is in all shards alike).
A shard is one task's, which merges its arrays into distinct pairs with their counts, a range of hashes at a time. From these follow, by word and combined before
the shuffle: its count, the number of words seen before it, and the numbers of words seen after it once, twice and more
often. Discounts come from the counts of counts of pairs and of words. Nothing is pruned, at any size.

Storage. A shard is one file under the shared folder: a header of two lengths, then sorted hashes with their values
(pairs seen once need none). A file is written under a name of its own and then renamed, so a repeated task, after an
executor was lost, replaces a shard by an equal one. Workers map files and search the sorted distinct hashes of a
piece of text in them; pages are the operating system's to keep or drop, and at most ``MAPS`` files are open. Where the
shared folder is no mounted one, a file is copied to an unnamed local one first.

Probability of a word w after v, with discounts D for counts of one, two and more:
p(w|v) = (n(vw) - D) / n(v) + g(v) p(w), p(w) = (b(w) - D') / B + g' / (V + 1), where b(w) counts the distinct words
before w, B the distinct pairs, g the mass that the discounts free; an unknown word has g' / (V + 1), an unknown v leaves p(w).

Words and pairs are told apart by 64-bit hashes. Of all pairs and words only sums and the numbers of shards reach the driver.

Defined cases: a null text counts as empty and has the end token only; a missing id counts as empty in the checksum of
the fold; rows that share an id or are repeated are learnt from and scored each; without training tokens all
probabilities are 1; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslake.llm.common import BLANKS, Words, give_back, keyed, lower_ascii, mixed, release, scratch, separators, stored, text_pieces, worker_state

#: Text, in bytes, whose pairs make a shard; tokens that a task holds before it counts and sends them on; files mapped at once.
SHARD_BYTES, COUNTED_AT_ONCE, MAPS = 16 << 20, 2 << 20, 512
#: Packed pairs of a shard that are merged at once.
RANGE_PAIRS = 1 << 19
#: Tokens that are no words.
BEGIN, END = np.uint64(0x5D1C0B1E6A9F3E21), np.uint64(0xA37B92D4F0186C55)
#: Discounts where the counts of counts leave them open.
USUAL = (0.5, 1.0, 1.5)
SPREAD = np.uint64(0x9E3779B97F4A7C15)

PACKED = "shard int, before binary, runs binary, words binary, counts binary"
SUMS = "kind int, word long, n long, pairs long, once long, twice long, more long"


@dataclass(frozen=True)
class Model:
    """Where the shards are, and the numbers that hold for all of them."""

    folder: str
    shards: int
    tokens: int
    types: int
    discounts: tuple[float, float, float]
    unknown: float


def fold_of(doc_id: Column, parts: int) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % parts


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * SPREAD + mixed(word))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every token and the one before it, an end after each text, and where each text's tokens begin."""
    data = lower_ascii()[raw]
    words = Words(data, offsets, separators(list(BLANKS)))
    bounds = words.bounds + np.arange(len(offsets))
    token = np.full(bounds[-1], END)
    inside = np.ones(len(token), bool)
    inside[bounds[1:] - 1] = False
    token[inside] = words.hashes(data)
    before = np.concatenate([[BEGIN], token[:-1]]) if len(token) else token
    before[bounds[:-1]] = BEGIN
    return token, before, bounds


def small(values: np.ndarray) -> bytes:
    """Counts in one byte each where all fit."""
    return values.astype(np.uint8 if len(values) and values.max() < 256 else np.int64).tobytes()


def counts_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else np.int64).astype(np.int64)


def counted(shards: int):
    """For ``mapInArrow`` over training texts: packed counts of pairs for every shard."""

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        before, word = (np.concatenate([x[side] for x in held]) for side in (0, 1))
        held.clear()
        hashes = pair_hash(before, word)
        order = np.argsort(hashes)
        hashes = hashes[order]
        fresh = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        n = np.diff(np.append(fresh, len(order)))
        shard, first = shard_of(hashes[fresh], shards), order[fresh]
        del hashes, order, fresh
        before, word = before[first], word[first]
        edges = np.searchsorted(shard, np.arange(shards + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            part = edges[k] + np.argsort(before[edges[k] : edges[k + 1]])
            own, runs = np.unique(before[part], return_counts=True)
            row = [k, own.tobytes(), small(runs), word[part].tobytes(), small(n[part])]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *[pa.array([x], pa.binary()) for x in row[1:]]], ["shard", "before", "runs", "words", "counts"])
        del before, word, n, shard, first, part, own, runs, row
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, raw, offsets in text_pieces(batches):
            token, before, _ = tokens_of(raw, offsets)
            held.append((before, token))
            size += len(token)
            if size >= COUNTED_AT_ONCE:
                yield from packed(held)
                size = 0
        if held:
            yield from packed(held)

    return run


def opened(folder: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def write_shard(folder: str, name: str, first: int, second: int, columns: list[np.ndarray]) -> None:
    """Lengths and columns as one file, which appears whole."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    task = TaskContext.get()
    draft = f"{path}/.{name}-{task.taskAttemptId() if task else os.getpid()}"
    with system.open_output_stream(draft) as file:
        file.write(np.array([first, second], np.int64).tobytes())
        for column in columns:
            file.write(column.tobytes())
    system.move(draft, f"{path}/{name}")


def mapped(folder: str, name: str) -> np.ndarray | None:
    """A shard's file as mapped 64-bit numbers; none if the shard is empty. Kept by the worker, the latest ``MAPS``."""
    from pyarrow import fs

    kept = worker_state("kneser").setdefault("maps", OrderedDict())
    key = (folder, name)
    if key not in kept:
        system, path = opened(folder)
        info = system.get_file_info(f"{path}/{name}")
        if info.type == fs.FileType.NotFound:
            kept[key] = None
        elif isinstance(system, fs.LocalFileSystem):
            kept[key] = np.memmap(info.path, np.uint64, "r")
        else:
            import shutil
            import tempfile

            with tempfile.TemporaryFile() as file, system.open_input_stream(info.path) as source:
                shutil.copyfileobj(source, file)
                file.flush()
                kept[key] = np.memmap(file, np.uint64, "r")
    kept.move_to_end(key)
    if len(kept) > MAPS:
        kept.popitem(last=False)
    return kept[key]


def merged(folder: str, shards: int):
    """For ``mapInArrow`` over packed counts sorted by shard: writes each shard's pairs and gives the sums by word
    (kind 0) and the counts of counts of pairs (kind 1, the count as word). A shard is merged in ranges of its hashes, of
    ``RANGE_PAIRS`` packed pairs or so, and only what a range needs is unpacked at once."""

    def merge(parts: list[tuple], of: int, place: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, words before, words and counts of the distinct pairs in one of all ranges, by their hashes."""
        held = []
        for b, r, w, c in parts:
            before, word = np.repeat(np.frombuffer(b, np.uint64), counts_of(r, len(b) // 8)), np.frombuffer(w, np.uint64)
            hashes = pair_hash(before, word)
            pick = np.flatnonzero(shard_of(hashes, of) == place)
            held.append((hashes[pick], before[pick], word[pick], counts_of(c, len(w) // 8)[pick]))
        hashes, before, word, n = (np.concatenate([x[i] for x in held]) for i in range(4))
        held.clear()
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order]
        fresh = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
        pick = order[fresh]
        return hashes[fresh], before[pick], word[pick], np.add.reduceat(n, fresh) if len(n) else n

    def sums_of(before: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        words, place = np.unique(np.concatenate([word, before]), return_inverse=True)
        after, ahead = place[: len(word)], place[len(word) :]
        sums = [np.bincount(after, n, len(words)), np.bincount(after, minlength=len(words))]
        sums += [np.bincount(ahead[pick], minlength=len(words)) for pick in (n == 1, n == 2, n > 2)]
        of = np.array([(n == k).sum() for k in (1, 2, 3, 4)])
        columns = [np.concatenate([words.view(np.int64), [1, 2, 3, 4]]), np.concatenate([sums[0], of])] + [np.concatenate([s, np.zeros(4)]) for s in sums[1:]]
        kind = np.concatenate([np.zeros(len(words)), np.ones(4)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(kind), *[pa.array(c.astype(np.int64)) for c in columns]], ["kind", "word", "n", "pairs", "once", "twice", "more"])

    def finish(shard: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ranges = -(-sum(len(w) // 8 for _, _, w, _ in parts) // RANGE_PAIRS)
        once, more, counts = [], [], []
        for place in range(shard * ranges, (shard + 1) * ranges):
            hashes, before, word, n = merge(parts, shards * ranges, place)
            once.append(hashes[n == 1])
            more.append(hashes[n > 1])
            counts.append(n[n > 1])
            yield sums_of(before, word, n)
        parts.clear()
        write_shard(folder, f"pairs-{shard}", sum(map(len, once)), sum(map(len, more)), [*once, *more, *counts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []
        for batch in batches:
            for k in range(len(batch)):
                shard = batch.column("shard")[k].as_py()
                if shard != here and parts:
                    yield from finish(here, parts)
                here = shard
                parts.append(tuple(memoryview(batch.column(c)[k].as_buffer()) for c in ("before", "runs", "words", "counts")))
        if parts:
            yield from finish(here, parts)
        give_back()

    return run


def discounts(of: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of items seen once to four times."""
    n = [of.get(k, 0) for k in (1, 2, 3, 4)]
    if not all(n[:3]):
        return USUAL
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(d if 0 < d <= k else usual for k, d, usual in zip((1, 2, 3), found, USUAL))


def freed(d: tuple, once, twice, more):
    return d[0] * once + d[1] * twice + d[2] * more


def taken(d: tuple, n: np.ndarray) -> np.ndarray:
    """The discount of each count."""
    return np.array([0.0, *d])[np.minimum(n, 3)]


def word_shards(folder: str, shards: int, of_pairs: tuple, of_words: tuple, pairs: int, base: float, texts: int):
    """For ``mapInArrow`` over the sums by word, sorted by shard and word: writes each shard's words, gives its number."""

    def finish(shard: int, parts: list[pa.RecordBatch]) -> None:
        columns = {c: np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("word", "n", "pairs", "once", "twice", "more")}
        word = columns["word"].view(np.uint64)
        order = np.argsort(word)
        seen = np.where(word == BEGIN, texts, columns["n"])
        chance = (columns["pairs"] - taken(of_words, columns["pairs"])) / max(pairs, 1) + base
        rest = freed(of_pairs, columns["once"], columns["twice"], columns["more"]) / np.maximum(seen, 1)
        write_shard(folder, f"words-{shard}", len(word), 0, [word[order], seen[order], chance[order], rest[order]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, done = None, [], []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if parts and shard[a] != here:
                    finish(here, parts)
                    done.append(here)
                    parts = []
                here = int(shard[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            finish(here, parts)
            done.append(here)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], ["shard"])

    return run


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count the texts and write the model's shards."""
    spark = train.sparkSession
    texts = keyed(train, id_col, text_col).select(F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    folder = scratch(spark)
    packed = texts.mapInArrow(counted(shards), PACKED)
    sums = packed.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(merged(folder, shards), SUMS)
    words = stored(sums.groupBy("kind", "word").agg(*[F.sum(c).alias(c) for c in ("n", "pairs", "once", "twice", "more")]))
    of_pairs = discounts({r["word"]: r["n"] for r in words.filter("kind = 1").collect()})
    known = words.filter("kind = 0")
    level = F.least("pairs", F.lit(5))
    by_level = {r["level"]: r for r in known.filter("pairs > 0").groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("types"), F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).collect()}
    types, tokens, pairs = (sum(r[c] for r in by_level.values()) for c in ("types", "n", "pairs"))
    end = known.filter(F.col("word") == int(END.view(np.int64))).first()
    at = {k: r["types"] for k, r in by_level.items()}
    of_words = discounts(at)
    unknown = freed(of_words, at.get(1, 0), at.get(2, 0), types - at.get(1, 0) - at.get(2, 0)) / pairs / (types + 1) if pairs else 1.0
    if pairs:
        spot = F.shiftrightunsigned("word", 32)
        placed = known.withColumn("shard", F.shiftrightunsigned(spot * shards, 32).cast("int"))
        write = word_shards(folder, shards, of_pairs, of_words, pairs, unknown, end["n"])
        placed.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(write, "shard int").agg(F.count(F.lit(1))).first()
    release(spark)
    return Model(folder, shards if pairs else 0, tokens, types, of_pairs, unknown)


def found(folder: str, kind: str, shards: int, hashes: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """For every shard that sorted hashes fall in: which of them, and its file's numbers."""
    shard = shard_of(hashes, shards) if shards else np.zeros(0, np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        file = mapped(folder, f"{kind}-{shard[a]}")
        if file is not None:
            yield slice(int(a), int(b)), file


def places(sorted_hashes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked hash is, and which are there at all."""
    if not len(sorted_hashes):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.searchsorted(sorted_hashes, asked).clip(max=len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == asked


def pair_counts(model: Model, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes), np.int64)
    for part, file in found(model.folder, "pairs", model.shards, hashes):
        once, more = int(file[0]), int(file[1])
        body = file[2:]
        out[part][places(body[:once], hashes[part])[1]] = 1
        at, there = places(body[once : once + more], hashes[part])
        out[part][there] = body[once + more :][at[there]].view(np.int64)
    return out


def word_values(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, lower-order chance and freed mass of every word; zero, the unknown word's and one if it is not known."""
    seen, chance, rest = np.zeros(len(hashes), np.int64), np.full(len(hashes), model.unknown), np.ones(len(hashes))
    for part, file in found(model.folder, "words", model.shards, hashes):
        n = int(file[0])
        body = file[2:].reshape(4, n)
        at, there = places(body[0], hashes[part])
        for out, column, kind in ((seen, 1, np.int64), (chance, 2, np.float64), (rest, 3, np.float64)):
            out[part][there] = body[column][at[there]].view(kind)
    return seen, chance, rest


def scored(settings: dict):
    """For ``mapInArrow``: numbers of tokens and log10 probabilities of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**settings)
        for rows, raw, offsets in text_pieces(batches):
            token, before, bounds = tokens_of(raw, offsets)
            words, place = np.unique(np.concatenate([token, before]), return_inverse=True)
            seen, chance, rest = word_values(model, words)
            at, ahead = place[: len(token)], place[len(token) :]
            hashes, back = np.unique(pair_hash(before, token), return_inverse=True)
            n = pair_counts(model, hashes)[back]
            first = (n - taken(model.discounts, n)) / np.maximum(seen[ahead], 1)
            p = first + rest[ahead] * chance[at]
            plain = np.log10((seen[at] + 1) / (model.tokens + model.types + 1))
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("fold"), pa.array(np.diff(bounds).astype(np.int64)),
                pa.array(np.add.reduceat((seen[at] > 0).astype(np.int64), bounds[:-1])),
                pa.array(np.add.reduceat(plain, bounds[:-1])), pa.array(np.add.reduceat(np.log10(p), bounds[:-1]))],
                ["doc_id", "fold", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, parts: int, part: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    plain = keyed(docs, id_col, text_col).select("doc_id", fold_of(F.col("doc_id"), parts).alias("fold"), F.coalesce("text", F.lit("")).alias("text"))
    rows = plain.mapInArrow(scored(asdict(model)), "doc_id long, fold long, n_tokens long, n_known long, base_score double, score double")
    return rows.select(
        "doc_id", (F.col("fold") == part).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def report(docs: DataFrame, parts: int = 7, part: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the documents outside the fold and scores all."""
    fold = fold_of(F.col(f"`{id_col}`").cast("long"), parts)
    return score(docs, fit(docs.filter(fold != part), id_col, text_col), parts, part, id_col, text_col)
