"""Regular texts that weak hashes equate, rows that share an id, and plain forward passes of both classifiers."""

from __future__ import annotations

import math
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_training_operators import rows_of, same

import corpus_pipeline
from saleslake.llm import common, language, lines, neighbours, quality, relative, suffixes


def alternating(n: int, signs: str = "ab") -> str:
    """The Thue-Morse order: sums of powers modulo 2**64 are the same for it and its complement."""
    return "".join(signs[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_alternating_texts_have_different_hashes(n):
    for one, other in (("ab", "ba"), ("xy", "yx")):
        data = np.frombuffer((alternating(n, one) + alternating(n, other)).encode(), np.uint8)
        a, b = common.range_hash(common.prefix_hashes(common.random_table(21)[data]), np.array([0, n]), np.array([n, 2 * n]))
        assert a != b


def test_operators_tell_alternating_texts_apart(spark):
    texts = [alternating(n, signs) for n in (1024, 2048) for signs in ("ab", "ba")]
    words = [" ".join(alternating(n, signs)) for n in (1024, 2048) for signs in ("xy", "yx")]
    rows = list(enumerate([*texts, *words, texts[0], words[1]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(neighbours.links(docs), brute.near_links(rows))
    same(suffixes.suffix_dedup(docs, digests=True), brute.repeated_bytes(rows))
    same(relative.substring_dedup(docs, digests=True), brute.repeated_words(rows))
    kept = [(i, brute.sha((t or "").encode())) for i, _, _, t in brute.kept_texts(rows)]
    same(lines.report(docs).select("doc_id", "kept_sha256"), kept)


@pytest.mark.parametrize("pieces", [1, 4])
def test_rows_of_one_id_that_share_a_passage(spark, pieces):
    """Every row of a later id loses the windows of a smaller one, however rows fall into pieces."""
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(400)]
    passage = [rng.choice(pool) for _ in range(70)]
    other = lambda n: [rng.choice(pool) for _ in range(n)]
    rows = [(1, " ".join(other(12) + passage[k % 3 : 62 + k % 5] + other(9))) for k in range(3)]
    rows += [(i, " ".join(other(5 + k) + passage[k : 60 + k] + other(20))) for i in (2, 3) for k in range(4)]
    rows += [(4, " ".join(passage)), (None, " ".join(other(3) + passage)), (4, " ".join(passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(pieces)
    same(relative.substring_dedup(docs, digests=True), brute.repeated_words(rows))


# forward passes, one look-up at a time

def plain_language(model, text):
    raw = [b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in text.encode()]
    total, seen = [0.0] * len(model.languages), 0
    for k, order in enumerate(language.ORDERS):
        for s in range(len(raw) - order + 1):
            gram = raw[s : s + order]
            if all(b == 32 for b in gram):
                continue
            code = 0
            for b in gram:
                code = (code * 0x01000193 + b) % 2**32
            code ^= code >> 15
            bucket = (code * 0x9E3779B1 % 2**32 >> 20) + k * language.BUCKETS
            total = [t + float(v) for t, v in zip(total, model.table[bucket])]
            seen += 1
    logits = [(t / max(seen, 1) + float(b)) / model.temperature for t, b in zip(total, model.bias)]
    top = max(logits)
    chances = [math.exp(x - top) for x in logits]
    return [c / sum(chances) for c in chances]


def test_language_scores_equal_a_plain_forward_pass(spark, odd_docs, odd_rows, tied_docs):
    """Every subword of every text counts, also of the longest, of repeated rows and of rows without an id."""
    model = language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for docs in (odd_docs, tied_docs):
        texts = {}
        for r in docs.select("doc_id", "text").collect():
            texts.setdefault(r["doc_id"], []).append(r["text"])
        out = language.identify(docs, model).collect()
        assert sorted((repr(r["doc_id"]) for r in out)) == sorted(repr(i) for i, ts in texts.items() for _ in ts)
        got = {}
        for r in out:
            got.setdefault(r["doc_id"], []).append((r["lang_pred"], round(r["score"], 4)))
        for i, ts in texts.items():
            want = []
            for t in ts:
                if t is None or not re.search(r"[^\W\d_]", t):
                    want.append(("und", 0.0))
                    continue
                chances = plain_language(model, t)
                want.append((model.languages[int(np.argmax(chances))], max(chances)))
            assert len(got[i]) == len(want)
            for (a, x), (b, y) in zip(sorted(got[i]), sorted(want)):
                assert a == b and x == pytest.approx(y, abs=2e-3)


def plain_quality(net, text):
    raw, size = list(text), quality.BLOCK
    blocks = -(-(len(raw) + quality.TAPS) // size)
    padded = raw + [0] * (blocks * size + quality.TAPS - len(raw))
    peak = [[max([sum(float(net.taps[k, padded[s + k], f]) for k in range(quality.TAPS)) for s in range(b * size, (b + 1) * size) if padded[s]], default=quality.NOTHING)
             for f in range(quality.FILTERS)] for b in range(blocks)]
    chunks = max(1, -(-(blocks - 1) // quality.CHUNK_STEP))
    mean = np.zeros(quality.FILTERS)
    for c in range(chunks):
        part = peak[c * quality.CHUNK_STEP : c * quality.CHUNK_STEP + quality.CHUNK_BLOCKS]
        mean += [max(0.0, max(p[f] for p in part) + float(net.floor[f])) for f in range(quality.FILTERS)]
    middle = np.tanh(mean / chunks @ net.inner + net.inner_bias)
    return 1 / (1 + math.exp(-(float(middle @ net.outer) + net.outer_bias)))


def small_network():
    rng = np.random.default_rng(2)
    return quality.train([rng.integers(1, 255, (2, quality.CHUNK_BLOCKS * quality.BLOCK)).astype(np.uint8) for _ in range(8)], np.array([0, 1] * 4, np.float32), 0.5)


def test_quality_scores_equal_a_plain_forward_pass(spark, tied_docs):
    """Every window of every chunk counts; repeated rows and rows without an id are scored one by one."""
    net = small_network()
    rng = random.Random(12)
    texts = ["", "a", "ab " * 20, "x" * 63, "y" * 64, "z" * 65, "".join(rng.choice("abc \u00e9\n") for _ in range(1500)), None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for frame in (docs, tied_docs):
        want = sorted((repr(r["doc_id"]), plain_quality(net, (r["text"] or "").encode())) for r in frame.collect())
        got = sorted((repr(r["doc_id"]), r["score"]) for r in quality.score(frame, net).collect())
        assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-4)


def test_a_pattern_counts_wherever_it_starts():
    """A shift by one byte changes nothing: filters apply at every byte."""
    net = small_network()
    tables = quality.pair_tables(net.taps)
    score = lambda text: float(quality.scores(net, tables, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])
    plain = [plain_quality(net, b" " * k + b"pattern") for k in range(4)]
    assert [score(b" " * k + b"pattern") for k in range(4)] == pytest.approx(plain, abs=1e-4)


# pipeline

def test_stages_with_odd_tables(spark, tied_docs, no_docs):
    """Null ids, repeated rows, clashing columns and an empty table go through all stages."""
    sf = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [F.lit(name).alias(name) for name in ("tk", "key", "root", "_numbers", "_own", "digest")]
    twice = real.limit(20)
    odd = real.unionByName(twice).unionByName(twice.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(
        tied_docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars"), allowMissingColumns=True).select("*", *extra)
    before = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == odd.columns
            after = spark.createDataFrame(after.collect(), odd.schema)
            ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
            assert ids(after) <= ids(before) and after.count() <= before.count()
        else:
            assert after.count() == before.count()
        before = after
    empty = real.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert rows_of(stage(spark, empty, sf)) == []


def test_verified_in_lanes_as_one_by_one():
    """Edits at, below and above the allowance, lines of one and of several words, characters of all sizes."""
    rng = random.Random(1)
    bodies = []
    for _ in range(300):
        one = "".join(rng.choice("abcdé\U0001f600") for _ in range(rng.choice([1, 2, 3, 20, 39, 40, 171, 640, 700, 1400])))
        other = list(one)
        most = int(lines.allowed(2, len(one)))
        for _ in range(rng.choice([0, 1, most - 1, most, most + 1, 2 * most])):
            spot = rng.randrange(len(other) + 1)
            other[spot : spot + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        bodies += [one, "".join(other)]
    p, q = np.arange(0, len(bodies), 2), np.arange(1, len(bodies), 2)
    want = [lines.near(bodies[i], bodies[j], 2) for i, j in zip(p, q)]
    assert lines.Verifier(bodies, 2).near(p, q).tolist() == want and 50 < sum(want) < 290
    counts = lines.profiles(bodies)
    most = lines.allowed(2, np.minimum(*(np.array([len(bodies[i]) for i in side]) for side in (p, q))))
    assert not (np.array(want) & ~lines.may_be_near(counts[p], counts[q], most)).any()
