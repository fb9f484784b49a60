"""Spelling variants: words one insertion, deletion or replacement apart, found by a bit-sliced position index.

Words are counted in DataFrame functions. The vocabulary is then cut into blocks of words of one length that share
their first or their last ``STEM`` letters: one edit leaves one of the two ends of a word of seven letters as it is. A
block holds, for every position and letter, the set of its words with that letter there, one bit a word. A query walks
its letters and keeps two sets for all words of the block at once, 64 words an operation: those that agree so far, and
those with one error so far (a replaced letter at the same position, or a letter more, which shifts the positions by
one). Queries are the words of the block's length and, for a letter more, those one letter shorter.

A stem that many words share is dealt out: its words go to blocks of some ``BLOCK_LETTERS`` letters by hash, and its queries
meet each block; queries are streamed, so a task holds one block at a time. Both ends may find a pair; the last letters
only count where the first differ. Counts and best neighbours are combined in each task before they are shuffled.

Every form has ten times its word's count, so a chain of forms has at most as many links as the largest count has
digits; roots are found by joining the forms with themselves, which doubles the links followed each time.

Defined cases: a null text has no words; a missing id counts as empty in the checksum; rows that share an id or are
repeated count each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import keyed, stored

#: Letters of a run, and the upper case that is folded.
RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAST_LETTERS, LEAST_COUNT, TIMES, DELETE_EVERY = 7, 2, 10, 31
STEM = 3
#: Letters of the words of one block; queries that are worked on at once.
BLOCK_LETTERS, QUERIES_AT_ONCE = 1 << 16, 256

PAIRS = "word string, near string, near_n long"


def words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, delete_every: int = DELETE_EVERY,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the lower-cased runs of letters, one letter of some deleted by a checksum of id and run."""
    runs = keyed(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"),
        F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{{least_letters},}})"))).alias("run"))
    lowered = runs.select("i", F.translate("run", UPPER, LOWER).alias("run"))
    summed = lowered.select("run", F.crc32(F.encode(F.concat("i", F.lit(":"), "run"), "UTF-8")).alias("h"))
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    spelt = summed.select(F.when(F.col("h") % delete_every == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = spelt.filter(F.char_length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


def spread(vocabulary: DataFrame) -> DataFrame:
    """Every word once as part of a block (role 0) and as a query (role 1) of blocks of its own and of the next length."""
    size = F.char_length("word")
    ends = F.array(
        F.struct(F.concat(F.lit("a"), F.substring("word", 1, STEM)).alias("stem")),
        F.struct(F.concat(F.lit("z"), F.substring("word", -STEM, STEM)).alias("stem")))
    roles = F.array(*[F.struct(F.lit(role).alias("role"), (size + more).alias("size")) for role, more in ((0, 0), (1, 0), (1, 1))])
    rows = vocabulary.select("word", "n", F.explode(ends).alias("e"), F.lit(1).alias("_")).select("word", "n", "e.stem", F.explode(roles).alias("r")).select(
        "word", "n", "stem", "r.role", "r.size")
    blocks = F.ceil(F.count(F.lit(1)) * F.col("size") / BLOCK_LETTERS)
    crowded = rows.filter("role = 0").groupBy("stem", "size").agg(blocks.cast("int").alias("blocks")).filter("blocks > 1")
    met = rows.join(crowded, ["stem", "size"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    each = F.when(F.col("role") == 0, own).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = met.select("word", "n", "role", "stem", "size", F.explode(each).alias("block"))
    return dealt.select(F.concat_ws(" ", "stem", F.col("size").cast("string"), F.col("block").cast("string")).alias("place"), "role", "word", "n")


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words laid end to end, and where each begins."""
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), starts


class Block:
    """Bit-sliced index of words of one length."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = len(words[0])
        flat, _ = letters(words)
        self.alphabet, places = np.unique(flat, return_inverse=True)
        self.table = places.reshape(len(words), self.size)
        self.width = -(-len(words) // 64)
        self.none = np.zeros((len(self.alphabet) + 1, self.width), np.uint64)

    def slice(self, position: int) -> np.ndarray:
        """For every letter (and last for one that no word has) the set of words with that letter at the position."""
        if not 0 <= position < self.size:
            return self.none
        bits = np.zeros((len(self.alphabet) + 1, self.width * 64), bool)
        bits[self.table[:, position], np.arange(len(self.words))] = True
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs one edit apart, for queries of one length: the block's own or one less."""
        m = len(queries[0])
        flat, _ = letters(queries)
        spots = np.searchsorted(self.alphabet, flat).clip(max=len(self.alphabet) - 1)
        spots = np.where(self.alphabet[spots] == flat, spots, len(self.alphabet)).reshape(len(queries), m)
        exact = np.full((len(queries), self.width), ~np.uint64(0))
        one = np.zeros_like(exact)
        here, after = self.slice(0), self.slice(1)
        longer = m < self.size
        for j in range(m):
            same = here[spots[:, j]]
            if longer:
                one = (one | exact) & after[spots[:, j]]
            else:
                one = (one & same) | (exact & ~same)
            exact &= same
            here, after = after, self.slice(j + 2) if longer or j + 1 < m else after
        found = one | exact if longer else one
        bits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little", count=len(self.words))
        return np.nonzero(bits)


def matched(place: str, block: Block, counts: list[int], queries: list[str], numbers: list[int]) -> Iterator[pa.RecordBatch]:
    """The block's pairs with queries, in both directions where the lengths differ."""
    by_size: dict[int, list[int]] = {}
    for k, q in enumerate(queries):
        by_size.setdefault(len(q), []).append(k)
    for size, picked in by_size.items():
        for k in range(0, len(picked), QUERIES_AT_ONCE):
            part = picked[k : k + QUERIES_AT_ONCE]
            a, b = block.near([queries[i] for i in part])
            out: list[list] = [[], [], []]
            for i, j in zip(a.tolist(), b.tolist()):
                query, word = queries[part[i]], block.words[j]
                if place[0] == "z" and query[:STEM] == word[:STEM]:
                    continue
                for row in [(query, word, counts[j])] + [(word, query, numbers[part[i]])] * (size < block.size):
                    for column, value in zip(out, row):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over rows sorted by place and role: a block's words come before its queries."""
    here, members, counts, block = None, [], [], None
    for batch in batches:
        places = batch.column("place")
        change = np.flatnonzero(pc.not_equal(places[1:], places[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(batch) > 1 else []
        roles = batch.column("role").to_numpy()
        for first, last in zip([0, *change], [*change, len(batch)]):
            if first == last:
                continue
            if (place := places[int(first)].as_py()) != here:
                here, members, counts, block = place, [], [], None
            middle = first + int(np.searchsorted(roles[first:last], 1))
            words, numbers = batch.column("word").slice(first, last - first).to_pylist(), batch.column("n").slice(first, last - first).to_pylist()
            members += words[: middle - first]
            counts += numbers[: middle - first]
            if middle < last and members:
                block = block or Block(members)
                yield from matched(here, block, counts, words[middle - first :], numbers[middle - first :])


def variants(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n of every word of a stored table (word, n)."""
    rows = spread(vocabulary).repartition("place").sortWithinPartitions("place", "role")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    pairs = rows.select("place", "role", "word", "n").mapInArrow(neighbours, PAIRS)
    found = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    form_n = -F.col("best.less")
    much = form_n >= TIMES * F.col("n")
    return vocabulary.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(much, F.col("best.near")).alias("form"), F.when(much, form_n).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form."""
    links = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = formed.agg(F.max("n")).first()[0] or 0
    hops = max(1, len(str(most)))
    for _ in range(math.ceil(math.log2(hops))):
        links = stored(links)
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return links


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocabulary = stored(words(docs, id_col=id_col, text_col=text_col))
    formed = stored(variants(vocabulary))
    out = formed.join(roots(formed), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
