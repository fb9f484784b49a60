"""Language-model scoring, ranked search and spelling variants against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from test_training_operators import rows_of, same, text_rows

from saleslake.llm import common, kneser, lexical, spelling

RUNS = re.compile("[A-Za-z\u00C0-\u00FF]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# spelling variants

def spelt(rows, least=7, count=2, every=31):
    seen = Counter()
    for i, text in rows:
        for run in RUNS.findall(text or ""):
            word = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                seen[word] += 1
    return {w: n for w, n in seen.items() if n >= count}


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(counts):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and one_apart(w, x)] for w in counts}
    best = {w: min(xs, key=lambda x: (-counts[x], x), default=None) for w, xs in near.items()}
    form = {w: b if b is not None and counts[b] >= 10 * counts[w] else None for w, b in best.items()}
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def misspelt_rows():
    """Chains of forms, ties, accents, deletions at every place, and one long run."""
    rng = random.Random(5)
    base = ["language", "spelling", "variant\u00e9s", "\u00c9l\u00e9phants", "abababab", "language\u00ff", "tokenizers", "x" * 300]
    rows, i = [], 0
    for k, word in enumerate(base):
        for copies, edits in ((300, 0), (25, 1), (2, 2)):
            for _ in range(3 if edits else 1):
                w = word
                for _ in range(edits):
                    spot = rng.randrange(len(w))
                    w = rng.choice([w[:spot] + w[spot + 1 :], w[:spot] + rng.choice("ae\u00e9") + w[spot:], w[:spot] + "z" + w[spot + 1 :]])
                rows += [(i := i + 1, " ".join([w, w.upper()][: 1 + (k % 2)] * (copies // 10 or 2))) for _ in range(10 if copies > 9 else 1)]
    return rows


@pytest.mark.parametrize("letters", [1 << 16, 40])
def test_spelling_variants(spark, odd_docs, odd_rows, tied_docs, no_docs, monkeypatch, letters):
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", letters)
    rows = misspelt_rows()
    wrong = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = variants(spelt(rows))
    assert sum(r[1] is not None and r[2] != r[1] for r in want) and any(r[4] > 3 for r in want)
    same(spelling.spelling_variants(wrong), want)
    same(spelling.spelling_variants(odd_docs), variants(spelt(odd_rows)))
    same(spelling.spelling_variants(tied_docs), variants(spelt(text_rows(tied_docs))))
    same(spelling.spelling_variants(no_docs), [])


def test_every_pair_of_a_small_alphabet(spark):
    rng = random.Random(6)
    counts = {"".join(rng.choice("ab\u00e9") for _ in range(rng.randint(7, 9))): rng.choice([2, 20, 200]) for _ in range(700)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    found = spelling.variants(table).select("word", "form", "n", "n_near", "form_n")
    same(found, [(w, f, n, k, m) for w, f, _, n, k, m in variants(counts)])


# ranked search

def ranking(rows, items, k=10):
    terms = lambda text: re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(brute.LOWER))
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    N, L = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        found = []
        for i, c, n in docs:
            m = 10 + 90 * n * N // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            found += [(-score, brute.order((i,)), i)] * (score > 0)
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda r: r[:2])[:k])]
    return out


def asked_items(rows):
    texts = [t for _, t in rows if t]
    items = [(k, t[:400]) for k, t in enumerate(texts[::3])]
    return items + [(900, None), (901, ""), (902, "..."), (903, "seven Seven SEVEN of"), (903, "the line"), (None, "gamma \u00c9t\u00e9"), (904, "nowhere1 to2 be3 found4"), (0, items[0][1])]


@pytest.mark.parametrize("cells,docs_at_once,step", [(1 << 21, 2048, 16), (60, 7, 1)])
def test_ranked_search(spark, odd_docs, odd_rows, tied_docs, no_docs, monkeypatch, cells, docs_at_once, step):
    for name, value in (("BATCH_CELLS", cells), ("DOCS_AT_ONCE", docs_at_once), ("STEP", step)):
        monkeypatch.setattr(lexical, name, value)
    items = asked_items(odd_rows)
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score int").repartition(2)
    same(lexical.ranked_search(odd_docs, asked), ranking(odd_rows, items))
    if cells > 100:
        same(lexical.ranked_search(odd_docs, asked, k=3), ranking(odd_rows, items, 3))
        few = spark.createDataFrame([(1, "the quick text"), (2, "one dog another")], "item_id int, text string")
        same(lexical.ranked_search(tied_docs, few), ranking(text_rows(tied_docs), [(1, "the quick text"), (2, "one dog another")]))
        same(lexical.ranked_search(no_docs, few), [])
        same(lexical.ranked_search(odd_docs, few.limit(0)), [])


def test_bounds_are_never_below_scores(spark, odd_docs, odd_rows):
    """Every coordinate bounds the impact of each term that falls on it."""
    index = lexical.build(odd_docs)
    for r in index.rows.collect():
        places, impacts = np.frombuffer(r["coordinates"], np.uint16), np.frombuffer(r["impacts"], np.uint16)
        words = Counter(lexical.TERM.findall(r["text"].encode().translate(brute.LOWER)))
        assert r["n"] == sum(words.values())
        sketch = dict(zip(places.tolist(), impacts.tolist()))
        m = lexical.lengths(np.array([r["n"]]), index.documents, index.terms)
        for term, tf in words.items():
            spot = int(lexical.hashed([term])[0] >> np.uint64(48))
            assert sketch[spot] * lexical.IMPACT_STEP >= lexical.impact(np.array([tf]), m)[0]


# language model

def model_of(rows, learnt):
    big = Counter()
    for i, words in rows:
        if learnt(i):
            big.update(zip(["<s>", *words], words))
    ahead, count, total, after = Counter(), Counter(), Counter(), defaultdict(list)
    for (v, w), n in big.items():
        ahead[w] += 1
        count[w] += n
        total[v] += n
        after[v].append(n)

    def discounts(of):
        n = [None, *[of.get(k, 0) for k in (1, 2, 3, 4)]]
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return [x if 0 < x <= k else (0, 0.5, 1, 1.5)[k] for k, x in enumerate(d)]

    d2, d1 = discounts(Counter(big.values())), discounts(Counter(ahead.values()))
    unknown = sum(d1[min(n, 3)] for n in ahead.values()) / len(big) / (len(ahead) + 1) if big else 1.0

    def p(v, w):
        low = (ahead[w] - d1[min(ahead[w], 3)]) / len(big) + unknown if w in ahead else unknown
        if v not in after:
            return low
        n = big.get((v, w), 0)
        return (n - d2[min(n, 3)]) / total[v] + sum(d2[min(x, 3)] for x in after[v]) / total[v] * low

    return p, count


def check_scores(df, rows, parts=7, part=2):
    rows = [(i, [*brute.BLANK_WORD.findall((t or "").encode().translate(brute.LOWER)), None]) for i, t in rows]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % parts == part
    p, count = model_of(rows, lambda i: not fold(i))
    N, V = sum(count.values()), len(count)
    want = [(i, fold(i), len(ws), sum(w in count for w in ws), N, sum(math.log10((count[w] + 1) / (N + V + 1)) for w in ws),
             sum(math.log10(p(v, w)) for v, w in zip(["<s>", *ws], ws))) for i, ws in rows]
    got = [tuple(r) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    key = lambda r: (repr(r[:5]), r[5], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return p, count


@pytest.mark.parametrize("shard,at_once", [(16 << 20, 4 << 20), (2000, 300)])
def test_language_model(spark, odd_docs, odd_rows, tied_docs, no_docs, monkeypatch, shard, at_once):
    monkeypatch.setattr(kneser, "SHARD_BYTES", shard)
    monkeypatch.setattr(kneser, "COUNTED_AT_ONCE", at_once)
    check_scores(kneser.report(odd_docs), odd_rows)
    check_scores(kneser.report(tied_docs), text_rows(tied_docs))
    check_scores(kneser.report(odd_docs, parts=1, part=0), odd_rows, 1, 0)  # nothing to learn from
    assert kneser.report(no_docs).count() == 0


def test_chances_add_up(odd_rows):
    rows = [(i, [*brute.BLANK_WORD.findall((t or "").encode()), None]) for i, t in odd_rows]
    p, count = model_of(rows, lambda i: True)
    for v in ["<s>", rows[3][1][0], b"never seen"]:
        assert sum(p(v, w) for w in count) + p(v, b"unknown") == pytest.approx(1)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in kneser.report(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.9 * sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.9 * len(rows)


def test_a_repeated_write_replaces_a_shard_whole(spark, tmp_path):
    for n in (5, 3):
        kneser.write_shard(str(tmp_path), "pairs-0", n, 0, [np.arange(n, dtype=np.uint64)])
    file = kneser.mapped(f"file://{tmp_path}", "pairs-0")
    assert isinstance(file, np.memmap) and file.tolist() == [3, 0, 0, 1, 2]
    assert [p.name for p in tmp_path.iterdir()] == ["pairs-0"]
    assert kneser.mapped(str(tmp_path), "pairs-9") is None


def test_scores_survive_a_second_use(spark, odd_docs):
    """The model's files stay: scoring twice gives the same rows."""
    model = kneser.fit(odd_docs)
    assert rows_of(kneser.score(odd_docs, model, 7, 2)) == rows_of(kneser.score(odd_docs, model, 7, 2))
    assert common.scratch(spark).rsplit("/", 1)[0] in model.folder


@pytest.mark.parametrize("pairs", [1, 40])
def test_shards_are_merged_in_ranges_of_hashes(odd_docs, odd_rows, monkeypatch, pairs):
    whole = rows_of(kneser.report(odd_docs))
    monkeypatch.setattr(kneser, "RANGE_PAIRS", pairs)
    assert rows_of(kneser.report(odd_docs)) == whole


def test_merging_a_shard_unpacks_a_part_of_it_at_once(tmp_path):
    import tracemalloc

    rng, n = np.random.default_rng(1), 250_000
    columns = [], [], [], []
    for _ in range(8):
        before, runs = np.unique(rng.integers(0, 2**63, n // 4, dtype=np.uint64), return_counts=True)
        word = rng.integers(0, 2**63, runs.sum() * 4, dtype=np.uint64)
        for column, value in zip(columns, (before.tobytes(), kneser.small(runs * 4), word.tobytes(), kneser.small(np.ones(len(word), np.int64)))):
            column.append(value)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 8, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], ["shard", "before", "runs", "words", "counts"])
    del columns
    tracemalloc.start()
    rows = sum(len(x) for x in kneser.merged(str(tmp_path), 1)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 2_000_000 and peak < 250e6, peak  # 410 MB and more when all is unpacked
    assert np.fromfile(tmp_path / "pairs-0", np.int64, 2).tolist() == [2_000_000, 0]
