"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A rank file becomes a tokenizer of that library: bytes are written as the characters of the byte table, and every way
to cut a token into two other tokens is a merge with that token's rank, so that the lowest rank merges first whatever
its halves. Texts are cut where no token can reach across (before a single space, after white space, between letters
and common punctuation); each distinct chunk is encoded once per worker and its ids are kept, up to ``CACHE`` chunks.

Defined cases: a null or empty text has no ids; the strings of a tokenizer file's added tokens become their ids, as in
the library's plain call (a rank file has none); ids outside the table are an error; rows that share an id are encoded
one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from saleslake.llm.common import keyed, worker_state

#: Distinct chunks whose ids a worker keeps, and chunks encoded in one call.
CACHE, TOGETHER = 1_000_000, 20_000
#: The white space of the split pattern, and punctuation that ends a word safely.
WHITE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
MARKS = ".,;:!?"
LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
CHUNK = re.compile(
    f" ?[{LETTERS}]+(?![^{WHITE}{MARKS}])|[{MARKS}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Chunks that a line end before them may not be told apart from: white space but for one space in front.
UNSURE = re.compile(f"[\t-\r\x85\xa0]|[{WHITE}]$|.[^{WHITE}]*[{WHITE}]", re.DOTALL)


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else one from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_table()
    shown = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [
        (shown[token[:i]], shown[token[i:]])
        for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
    ]
    out = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def token_bytes(tokenizer) -> list[bytes]:
    """Bytes of every id, by the reversed byte table."""
    back = {c: b for b, c in enumerate(byte_table())}
    size = tokenizer.get_vocab_size()
    words = (tokenizer.id_to_token(i) or "" for i in range(size))
    return [bytes(back[c] for c in word) if all(c in back for c in word) else word.encode() for word in words]


class Coder:
    """Encodes texts by chunks and decodes ids."""

    def __init__(self, tokenizer, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel work; no threads besides
        self.tokenizer, self.limit = tokenizer, cache
        self.ids: dict[str, bytes] = {}
        added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, added))})") if added else None
        self.table = token_bytes(tokenizer)
        line = self.encode_plain("\n")
        self.line = line[0] if len(line) == 1 and self.table[line[0]] == b"\n" else None

    def encode_plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without the library's offsets

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks. Many go in one call with line ends between them: a line end before a chunk without one
        is a token of its own, so the ids fall apart there again."""
        plain = [c for c in chunks if not UNSURE.match(c)] if self.line is not None else []
        for i in range(0, len(plain), TOGETHER):
            some = plain[i : i + TOGETHER]
            got = np.array(self.encode_plain("\n".join(some)), "<u4")
            ends = np.flatnonzero(got == self.line)
            if len(ends) == len(some) - 1:
                raw, ends = got.tobytes(), (4 * ends).tolist()
                self.ids.update(zip(some, [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)])]))
        for chunk in chunks:
            if chunk not in self.ids:
                self.ids[chunk] = np.array(self.encode_plain(chunk), "<u4").tobytes()

    def chunks(self, text: str | None) -> list[str]:
        """The text in pieces that no token reaches across; the tokenizer's added tokens are pieces of their own."""
        if not text:
            return []
        if self.added is None or not self.added.search(text):
            return CHUNK.findall(text)
        return [c for k, part in enumerate(self.added.split(text)) for c in ([part] if k % 2 else CHUNK.findall(part))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [self.chunks(text) for text in texts]
        if len(self.ids) > self.limit:
            self.ids.clear()
        new = set(filterfalse(self.ids.__contains__, chain.from_iterable(cut)))
        if new:
            self.learn(list(new))
        get = self.ids.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def offsets(self, text: str, ids: Iterable[int]) -> list[tuple[int, int]]:
        """First character of each id and the one after its last; a character that is split over several ids is in
        the range of each of them."""
        raw = np.frombuffer(text.encode(), np.uint8)
        begins = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to each byte
        out, at = [], 0
        for i in ids:
            size = len(self.table[i])
            out.append((int(begins[at]) - 1, int(begins[at + size - 1])))
            at += size
        return out

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids one by one; a character comes with its last byte, a broken one as U+FFFD."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.table[i])
        if rest := decoder.decode(b"", final=True):
            yield rest


def rank_coder(lines: list[bytes], pattern: str) -> Coder:
    """The worker's coder for a rank file; built once for all tasks of a worker."""
    state = worker_state("coders")
    key = hashlib.sha256(b"".join(lines) + pattern.encode()).hexdigest()
    if key not in state:
        state[key] = Coder(tokenizer_of_ranks(read_ranks(lines), pattern))
    return state[key]


def json_coder(text: str) -> Coder:
    """The worker's coder for a tokenizer file."""
    from tokenizers import Tokenizer

    state = worker_state("coders")
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in state:
        state[key] = Coder(Tokenizer.from_str(text))
    return state[key]


def batches_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


CODED = "doc_id long, ids array<int>, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
PACKED = DIGESTS + ", ids binary"


def encode_decode(docs: DataFrame, path: str, pattern: str, digests: bool = False, packed: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its ids and the bytes that they decode to, or (``digests``) only their digests, and (``packed``) the ids as
    little-endian 32-bit integers besides.

    The rank file is read by the driver and sent along: its size is that of a vocabulary."""
    with open(path, "rb") as file:
        lines = docs.sparkSession.sparkContext.broadcast(file.readlines())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_coder(lines.value, pattern)
        decimal = worker_state("decimal")
        for batch in batches_of(batches):
            raw = coder.encode(batch.column("text").to_pylist())
            coded = [np.frombuffer(x, "<u4").tolist() for x in raw]
            decoded = [coder.decode(ids) for ids in coded]
            if not (digests or packed):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(coded, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])
                continue
            if not decimal:
                decimal.update((i, b"%d" % i) for i in range(len(coder.table)))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(map(len, coded), pa.int64()),
                pa.array([hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest() for ids in coded], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                *([pa.array(raw, pa.binary())] if packed else []),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * packed])

    return keyed(docs, id_col, text_col).mapInArrow(run, PACKED if packed else DIGESTS if digests else CODED)


