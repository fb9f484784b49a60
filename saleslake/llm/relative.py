"""Substring dedup by relative Lempel-Ziv parsing over words.

The texts that share an anchor are reference blocks for each other: the windows of all of them are indexed by hash with
the earliest document of each. A text is parsed greedily from left to right: where the window at the cursor is in the
index for an earlier document, the factor is extended against that block word by word as far as it goes; where it is
not, the cursor moves on by one word. After a factor the cursor goes back to the first window that reaches over its
end, so that matches across a factor boundary are found as well. Factors of ``width`` words and more are duplicate
spans. All texts of a chunk are parsed side by side.

Defined cases: a null text has no words; a missing id is the smallest; rows that share an id don't remove words from
each other; texts of fewer words than the width keep all; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from saleslake.llm.anchors import CROWD, Items, repeats
from saleslake.llm.common import BLANKS, Words, buffers, covered, prefix_hashes, separators, window_hash

WIDTH, GRAM = 50, 16


def match_length(values: np.ndarray, here: np.ndarray, there: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Equal words from each pair of places on, up to ``room``."""
    length = np.zeros(len(here), np.int64)
    going = np.flatnonzero(room > 0)
    while len(going):
        same = values[here[going] + length[going]] == values[there[going] + length[going]]
        going = going[same]
        length[going] += 1
        going = going[length[going] < room[going]]
    return length


def parse(data, values, bounds, doc, tk, at, width) -> np.ndarray:
    """For ``anchors.compare``: window starts inside factors against blocks of documents with smaller ids."""
    size = np.diff(bounds)
    seg = np.repeat(np.arange(len(size)), size)
    hashes = window_hash(prefix_hashes(values), width)
    starts = np.flatnonzero(np.arange(len(values)) + width <= bounds[1:][seg])
    factors = np.zeros(len(values), bool)
    if not len(starts):
        return factors
    # Index: for the hash of a window, the place in the block of the earliest document.
    order = starts[np.lexsort((doc[seg[starts]], hashes[starts]))]
    head = np.flatnonzero(np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]]))
    source = np.zeros(len(values), np.int64)
    source[order] = order[np.repeat(head, np.diff(np.append(head, len(order))))]
    indexed = np.zeros(len(values), bool)
    indexed[starts] = doc[seg[source[starts]]] < doc[seg[starts]]
    # Greedy parse of every text, one factor or word a round.
    cursor = bounds[:-1][size >= width].astype(np.int64)
    while len(cursor):
        hit = cursor[indexed[cursor]]
        there = source[hit]
        room = np.minimum(bounds[1:][seg[hit]] - hit, bounds[1:][seg[there]] - there)
        length = match_length(values, hit, there, room)
        long = length >= width
        factors |= covered(hit[long], length[long] - width + 1, len(values))
        step = np.ones(len(cursor), np.int64)
        step[indexed[cursor]] = np.maximum(1, length - width + 1)
        cursor = cursor + step
        cursor = cursor[(cursor < len(values)) & (cursor > 0)]
        last = np.searchsorted(bounds, cursor, "right") - 1
        inside = (cursor + width <= bounds[last + 1]) & (cursor != bounds[last])
        cursor = cursor[inside]
    return factors


def kept_words(data: np.ndarray, starts, counts, width: int, separator: np.ndarray) -> tuple[bytes, int, int]:
    words = Words(data, np.array([0, len(data)]), separator)
    n = len(words.starts)
    gone = np.zeros(n, bool)
    if starts is not None and len(starts):
        gone = covered(np.asarray(starts, np.int64), np.asarray(counts, np.int64) + width - 1, n)
    kept = b" ".join([data[a:b].tobytes() for a, b in zip(words.starts[~gone].tolist(), words.ends[~gone].tolist())])
    return kept, n, int(gone.sum())


REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def substring_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD, digests: bool = False,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the kept words joined by spaces (``digests``: their SHA-256)."""
    rows = repeats(docs, Items(width, gram, BLANKS), parse, False, crowd, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        separator = separators(list(BLANKS))
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            starts, counts = batch.column("starts").to_pylist(), batch.column("counts").to_pylist()
            out = [kept_words(data[offsets[i] : offsets[i + 1]], starts[i], counts[i], width, separator) for i in range(len(batch))]
            kept = [hashlib.sha256(x[0]).hexdigest() if digests else x[0].decode() for x in out]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()),
                pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256" if digests else "kept"])

    return rows.mapInArrow(run, REPORT if digests else REPORT.replace("kept_sha256", "kept"))
