from __future__ import annotations

import random

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from saleslake.llm import common, decontaminate, exact, graph, language, lines, neighbours, packed, quality, relative, suffixes, tokens

TIKTOKEN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same(df, expected):
    assert rows_of(df) == sorted(expected, key=repr)


def text_rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


# exact dedup

def test_exact_dedup(odd_docs, odd_rows, tied_docs, no_docs):
    same(exact.exact_dedup(odd_docs), brute.copies(odd_rows))
    same(exact.exact_dedup(tied_docs), brute.copies(text_rows(tied_docs)))
    same(exact.exact_dedup(no_docs), [])


def test_exact_dedup_with_a_full_filter(odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(exact, "filter_bits", lambda rows: 64)  # every row is a possible repeat
    same(exact.exact_dedup(odd_docs), brute.copies(odd_rows))


def test_without_copies_keeps_columns(odd_docs, odd_rows, tied_docs):
    kept = exact.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in brute.copies(odd_rows) if r[3])
    assert exact.without_copies(tied_docs).count() == 4  # a text of id 2, its empty one, and two of the others


# suffix-array and substring dedup

@pytest.mark.parametrize("crowd", [1500, 2])
def test_suffix_dedup(odd_docs, odd_rows, crowd):
    same(suffixes.suffix_dedup(odd_docs, crowd=crowd, digests=True), brute.repeated_bytes(odd_rows))


def test_suffix_dedup_small_alphabet(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) + "ab" * rng.randint(0, 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for crowd in (1500, 3):
        same(suffixes.suffix_dedup(df, width=12, gram=4, crowd=crowd, digests=True), brute.repeated_bytes(rows, 12))


def test_suffix_order_is_the_order_of_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = np.append(rng.integers(0, 4, rng.integers(1, 60)), 0).astype(np.uint8)
        wanted = np.flatnonzero(text > 0)
        depth = 8
        got = suffixes.suffix_order(text, wanted, depth)
        raw = text.tobytes() + b"\0" * depth
        keys = [raw[p : p + depth].split(b"\0")[0] for p in got]
        assert sorted(got) == sorted(wanted) and keys == sorted(keys)
        shared = suffixes.common_prefixes(text, got, depth)
        for k in range(1, len(got)):
            a, b = keys[k - 1], keys[k]
            assert shared[k] == next((i for i in range(depth) if a[i : i + 1] != b[i : i + 1] or not a[i : i + 1]), depth)


def test_suffix_dedup_ties_and_empty(tied_docs, no_docs):
    out = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffixes.suffix_dedup(tied_docs).collect()}
    alone = brute.repeated_bytes([(0, text_rows(tied_docs)[0][1])])[0][2]
    size = len("the quick brown fox jumps over the lazy dog and runs on " * 12)
    assert out[None, size + 3] < size  # a missing id comes first: only what it repeats of itself goes
    assert out[1, size] >= alone and out[2, size] == size
    same(suffixes.suffix_dedup(no_docs), [])


@pytest.mark.parametrize("crowd", [1500, 2])
def test_substring_dedup(odd_docs, odd_rows, crowd):
    same(relative.substring_dedup(odd_docs, crowd=crowd, digests=True), brute.repeated_words(odd_rows))


def test_substring_dedup_small_vocabulary(spark):
    rng = random.Random(5)
    rows = [(i % 37, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(37)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for crowd in (1500, 3):
        same(relative.substring_dedup(df, width=8, gram=3, crowd=crowd, digests=True), brute.repeated_words(rows, 8))


def test_substring_dedup_ties_and_empty(tied_docs, no_docs):
    same(relative.substring_dedup(tied_docs, digests=True), brute.repeated_words(text_rows(tied_docs)))
    same(relative.substring_dedup(no_docs), [])


# lines

def test_bounded_distance():
    rng = random.Random(1)
    for n in range(4000):
        a = "".join(rng.choice("ab" if n % 2 else "abcdé") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        for most in (1, 2, 3):
            assert lines.bounded_distance(a, b, most) == min(most + 1, brute.distance(a, b))


def edited_lines(rng: random.Random):
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 40))) for _ in range(25)]

    def edited(line: str) -> str:
        b = list(line)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        return "".join(b)

    return [(i, "\n".join([edited(rng.choice(base)) for _ in range(rng.randint(0, 6))] + [""] * rng.randint(0, 2))) for i in range(70)]


@pytest.mark.parametrize("crowd", [512, 2])
def test_line_dedup_edits(spark, crowd):
    rows = edited_lines(random.Random(2))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(lines.report(df, crowd=crowd), [(i, n, gone, brute.sha((text or "").encode())) for i, n, gone, text in brute.kept_texts(rows)])


def longer_lines(rng: random.Random):
    """Lines of 55 to 400 characters with edits up to and beyond a twentieth of them, in one place and spread out."""
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([58, 60, 61, 79, 80, 100, 160, 400]))) for _ in range(14)]

    def edited(line: str) -> str:
        b, n = list(line), rng.randint(0, max(3, len(line) // 20) + 1)
        spots = [round((i + 0.5) * len(b) / max(1, n)) for i in range(n)] if rng.random() < 0.6 else [len(b) // 3 + i for i in range(n)]
        for k in reversed(spots):
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        return "".join(b)

    return [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(0, 4)))) for i in range(60)]


@pytest.mark.parametrize(("crowd", "few"), [(512, 8), (2, 0)])
def test_line_dedup_edits_grow_with_length(spark, crowd, few):
    rows = longer_lines(random.Random(6))
    rows += [(100, "one word of this long line is another one here, as " * 4), (101, "one word of this long line is replaced one here, as " + "one word of this long line is another one here, as " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.kept_texts(rows)
    assert want[-1][2] == 1 and sum(x[2] for x in want) > sum(x[2] for x in brute.kept_texts(rows, per_edit=1000))
    same(lines.report(df, crowd=crowd, few=few), [(i, n, gone, brute.sha((text or "").encode())) for i, n, gone, text in want])


def test_line_dedup_odd(odd_docs, odd_rows, tied_docs, no_docs):
    kept = lines.without_repeated_lines(odd_docs)
    assert kept.columns == odd_docs.columns
    same(kept.select("doc_id", "text"), [(i, text) for i, _, _, text in brute.kept_texts(odd_rows)])
    out = text_rows(lines.without_repeated_lines(tied_docs))
    assert sorted(out, key=repr)[:2] and len(out) == 7 and sum(t is None for _, t in out) == 1
    assert [t for i, t in out if i == 2] == ["", ""]
    same(lines.without_repeated_lines(no_docs), [])


# components

def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(5, k) for k in range(200, 260)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    names = sorted({x for e in edges if e[0] != e[1] for x in e})
    root = brute.roots(len(names), [(names.index(a), names.index(b)) for a, b in edges if a != b])
    assert got == {x: names[r] for x, r in zip(names, root)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# near neighbours

def test_least_agreements_never_drops_a_likely_pair():
    least = neighbours.least_agreements(0.8, 1e-9, 84, 12)
    assert least == sorted(least) and least[-1] < 0.8 * 84


@pytest.mark.parametrize(("crowd", "block"), [(256, 1024), (2, 3)])
def test_near_links(odd_docs, odd_rows, crowd, block):
    same(neighbours.links(odd_docs, crowd=crowd, block=block), brute.near_links(odd_rows))


def test_near_links_ties_and_empty(tied_docs, no_docs):
    same(neighbours.links(tied_docs), brute.near_links(text_rows(tied_docs)))
    same(neighbours.links(no_docs), [])
    # Of the class of the long text the one without an id, the other text of id 1, and the two without words.
    assert neighbours.one_of_each(tied_docs).count() == 4


def test_one_of_each(odd_docs, odd_rows):
    kept = neighbours.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c, n in brute.near_links(odd_rows) if i == c)


# decontamination

ITEMS = [(1, "the line of the ALPHA, beta"), (2, None), (3, "..."), (4, "One two three"), (5, "one two three"), (6, "seven " * 14), (None, "x seven"), (None, "naïve")]


@pytest.fixture(scope="session")
def items(odd_rows):
    passage = odd_rows[30][1].split("\n")[0]
    return [*ITEMS, (7, " ".join(passage.split()[30:55])), (8, " ".join(passage.split()[40:52]).upper())]


@pytest.mark.parametrize("block_bytes", [1 << 26, 60])
def test_contamination(spark, odd_docs, odd_rows, tied_docs, items, block_bytes):
    bench = spark.createDataFrame(items, "item_id long, text string")

    def expected(rows):
        return [(i, n, sum(hit), len(names), brute.sha(",".join(names).encode()), any(hit)) for i, n, hit, names, _ in brute.benchmark_hits(rows, items)]

    same(decontaminate.contamination(odd_docs, bench, block_bytes=block_bytes), expected(odd_rows))
    same(decontaminate.contamination(tied_docs, bench, block_bytes=block_bytes), expected(text_rows(tied_docs)))


def test_decontaminate(spark, odd_docs, odd_rows, items, no_docs):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = brute.benchmark_hits(odd_rows, items)
    cut = decontaminate.decontaminate(odd_docs, bench)
    assert cut.columns == odd_docs.columns
    same(cut.select("doc_id", "text"), [(i, brute.without(t, f[4])) for (i, t), f in zip(odd_rows, found)])
    left = decontaminate.decontaminate(odd_docs, bench, remove="documents")
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(f[0] for f in found if not any(f[2]))
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert not decontaminate.contamination(odd_docs, bench.limit(0)).filter("contaminated").count()


# token ids

def tiktoken_encoding():
    import tiktoken

    with open(TIKTOKEN, "rb") as file:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.read_ranks(file), special_tokens={})


def test_encode_decode(odd_docs, odd_rows, tied_docs, no_docs):
    coding = tiktoken_encoding()

    def expected(rows):
        ids = [(i, coding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
        return [(i, len(x), brute.sha(",".join(map(str, x)).encode()), brute.sha(raw)) for i, x, raw in ids]

    same(tokens.encode_decode(odd_docs, TIKTOKEN, public_tokenizers.PATTERN, digests=True), expected(odd_rows))
    same(tokens.encode_decode(tied_docs, TIKTOKEN, public_tokenizers.PATTERN, digests=True), expected(text_rows(tied_docs)))
    same(tokens.encode_decode(no_docs, TIKTOKEN, public_tokenizers.PATTERN, digests=True), [])
    full = tokens.encode_decode(odd_docs, TIKTOKEN, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: bytes(r["decoded"]) for r in full} == {i: (t or "").encode() for i, t in odd_rows}


def test_coder_against_tiktoken_on_random_texts():
    coding, rng = tiktoken_encoding(), random.Random(9)
    with open(TIKTOKEN, "rb") as file:
        coder = tokens.rank_coder(file.readlines(), public_tokenizers.PATTERN)
    signs = list(" \n\t\r.,!?'’sdabcxyzABC019-_()é ñ漢字\U0001f600́ \x1c\x85\xa0​") + ["the", " of", "'ll", "  ", "aaaa"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, raw in zip(texts, coder.encode(texts)):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == coding.encode_ordinary(text)
        assert coder.decode(ids) == text.encode() and "".join(coder.stream(ids)) == text
        offsets = coder.offsets(text, ids)
        for (a, b), i in zip(offsets, ids):
            assert coder.table[i] in text[a:b].encode()
        assert not ids or (offsets[0][0] == 0 and offsets[-1][1] == len(text))


def test_stream_of_broken_ids():
    with open(TIKTOKEN, "rb") as file:
        coder = tokens.rank_coder(file.readlines(), public_tokenizers.PATTERN)
    ids = np.frombuffer(coder.encode(["\U0001f600"])[0], "<u4").tolist()
    assert len(ids) > 1 and "".join(coder.stream(ids[:-1])).endswith("�")


def test_packed_ids(spark, odd_docs, odd_rows, tied_docs, no_docs):
    from tokenizers import Tokenizer

    with open(JSON) as file:
        text = file.read()
    tokenizer = Tokenizer.from_str(text)
    special = [(1, "hello <|endoftext|> world"), (2, "<|endoftext|>"), (3, "a<|endoftext|><|endoftext|>\n\n b <|endoftext|"), (4, "  <|endoftext|>  <|ENDOFTEXT|>")]
    special_docs = spark.createDataFrame(special, "doc_id long, text string")

    def expected(rows):
        out, start = [], 0
        for i, t in sorted(rows, key=lambda r: (brute.order(r), r[1] is not None, r[1] or "")):
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
            out.append((i, start, ids))
            start += len(ids)
        return out

    assert 50256 in expected(special)[0][2]
    for docs, rows in ((odd_docs, odd_rows), (special_docs, special), (tied_docs, text_rows(tied_docs)), (no_docs, [])):
        path = common.scratch(spark)
        packed.write_ids(docs, text, path, 2)
        want = expected(rows)
        same(packed.read_ids(spark, path, digests=True), [(i, s, len(x), brute.crc(x)) for i, s, x in want])
        same(packed.read_ids(spark, path).select("doc_id", "start", "ids"), [(i, s, x) for i, s, x in want])
        if docs is odd_docs:
            same(packed.read_ids(spark, path, [101, 300, 999]).select("doc_id", "ids"), [(i, x) for i, _, x in want if i in (101, 300)])


# classifiers

def test_language_id(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'")
    right, total = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right > 0.97 and total > 150
    model = language.fit(docs)
    odd = {r["doc_id"]: r for r in language.identify(odd_docs, model).collect()}
    for i in (300, 301, 302, 303):
        assert odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and odd[i]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    kept = language.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in odd.items() if not r["rejected"])
    assert language.fit(no_docs) is None
    assert {r["lang_pred"] for r in language.identify(odd_docs, None).collect()} == {"und"}
    assert language.accepted(no_docs, None).count() == language.report(no_docs).count() == 0


def test_an_unlearned_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL")
    model = language.fit(docs.filter("lang <> 'de'"))
    assert model.known_rejected <= language.REJECT_SHARE + 0.005 and model.unknown_rejected > 0.95
    out = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").groupBy(F.col("lang") == "de").agg(F.avg(F.col("rejected").cast("int")))
    share = dict(map(tuple, out.collect()))
    assert share[True] > 0.95 and share[False] < 0.02
    rng = random.Random(8)
    noise = spark.createDataFrame([(i, "".join(rng.choice("bcdfghjklmnpqrstvwxz  ") for _ in range(rng.randint(60, 900)))) for i in range(40)], "doc_id long, text string")
    assert language.identify(noise, model).filter("rejected").count() == 40 and language.accepted(noise, model).count() == 0


def test_language_model_reads_whole_texts():
    shares = np.eye(4, len(language.ORDERS) * language.BUCKETS, dtype=np.float32).repeat(30, axis=0)
    model = language.train(shares, np.array(["a", "b", "c", "d"]).repeat(30))
    assert (np.argmax(shares @ model.table[:-1] + model.bias, axis=1) == np.arange(4).repeat(30)).all()


def test_quality(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    network = quality.fit(docs, labels, ~language.held_out(F.col("doc_id"), 3, 1))
    marked = labels.filter(language.held_out(F.col("doc_id"), 3, 1))
    out = quality.score(docs.join(marked.select("doc_id"), "doc_id"), network).join(marked, "doc_id")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    assert out.filter("quality = 0").agg(F.avg(1 - F.col("predicted"))).first()[0] > 0.8
    odd = quality.score(odd_docs, network).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.fit(docs, labels.limit(0)) == 0.5
    assert quality.fit(docs, labels.filter("quality = 1").limit(5)) == 1.0
    assert quality.report(no_docs, labels.limit(0)).count() == 0


def test_quality_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    network = quality.train([rng.integers(1, 255, (2, quality.CHUNK_BLOCKS * quality.BLOCK)).astype(np.uint8) for _ in range(8)], np.array([0, 1] * 4, np.float32), 0.5)
    tables = quality.pair_tables(network.taps)
    texts = [rng.integers(1, 255, n).astype(np.uint8) for n in (0, 1, 5, 63, 64, 65, 600, 5000, 0)]
    offsets = np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    together = quality.scores(network, tables, np.concatenate(texts), offsets)
    single = [quality.scores(network, tables, t, np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, single)


def test_new_chunks_are_encoded_together_and_without_offsets(odd_rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)

    class Fast:
        """The library's tokenizer without its slower call, which keeps offsets."""

        calls = 0

        def __getattr__(self, name):
            assert name not in ("encode", "encode_batch")
            Fast.calls += name == "encode_batch_fast"
            return getattr(plain, name)

    texts = [t for _, t in odd_rows] + ["\n", " ", "\t", "a\n", " \n", "\n\n b", "\x85", "\xa0 x", " <|endoftext|>x", "x y", "　"] + [" ".join(f"w{i}ert{i * 7}" for i in range(3000))]
    got = tokens.Coder(Fast()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert Fast.calls < 200


def test_lines_meet_alike_however_many_rows_are_compared_at_once(monkeypatch):
    rng, n = np.random.default_rng(6), 6000
    key = rng.integers(0, 900, n).astype(np.uint64) << np.uint64(50)
    rows = lines.rows_of(key, rng.integers(0, 400, n), rng.integers(0, 2, n), rng.integers(-1, 30, n), rng.integers(40, 60, n))
    rows = rows[np.unique(rows[["key", "line"]], return_index=True)[1]]  # copies of a row are alike in a table

    def met(at_once):
        monkeypatch.setattr(lines, "ROWS_AT_ONCE", at_once)
        monkeypatch.setattr(lines, "COMPARED_AT_ONCE", at_once)
        sent = lines.packed(lambda _: iter(np.array_split(rows, 9)), 1)(iter([]))
        return {tuple(r.values()) for batch in lines.meeting(2, 2)(sent) for r in batch.to_pylist()}

    assert met(1) == met(1 << 20)
    assert len(met(1)) > 100


def test_rows_of_lines_are_sent_packed():
    import pyarrow as pa

    rng, n = np.random.default_rng(5), 100_000
    rows = lines.rows_of(rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(-2**63, 2**63, n), rng.integers(0, 2, n), rng.integers(-1, 900, n), rng.integers(20, 1000, n))
    rows["size"][:3], rows["at"][:3] = 70_000, 69_000
    sent = list(lines.packed(lambda _: iter([rows[:60_000], rows[60_000:]]), 5)(iter([])))
    assert sorted(b.column("part")[0].as_py() for b in sent) == [0, 1, 2, 3, 4]
    got = np.concatenate([lines.unpacked(b, 0) for b in sent])
    rows["key"] &= ~np.int64(0xFFFF)
    assert sorted(got.tolist()) == sorted(rows.tolist())
    size = [sum(len(pa.compress(c[0].as_buffer(), "lz4", asbytes=True)) for c in b.columns[1:]) / (len(b.column("lines")[0].as_py()) / 8) for b in sent]
    assert sorted(size)[2] < 19


def test_keys_of_one_line_are_not_sent():
    import pyarrow as pa
    from types import SimpleNamespace as Held

    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in [30] * 40 + [200] * 40]
    texts = ["\n".join(base), base[3][:9] + "x" + base[3][9:], base[50][:70] + "x" + base[50][71:], base[60]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([0] * 4, pa.int32()), pa.array(texts)], ["doc_id", "tk", "text"])
    bits, rare = 1 << 18, Held(value=np.zeros(1 << lines.RARITY_BITS, np.uint8))

    def mapped(found, several=False):
        sent = [b for b in lines.bits_sent(found, bits, 4)(iter([batch]))]
        out = np.concatenate([np.frombuffer(b.column("bits")[0].as_py(), np.uint8) for b in sorted(lines.bits_met(bits // 4, several)(iter(sent)), key=lambda b: b.column("part")[0].as_py())])
        return Held(value=out)

    firsts = Held(value=np.full(bits // 8, 255, np.uint8))
    indexed = mapped(lines.indexed_bits(2, 20, bits, firsts, rare))
    shared = mapped(lines.probed_bits(2, 20, bits, firsts, rare, indexed), several=True)
    every, some = (sum((lines.unpacked(b, 0).tolist() for b in lines.rows_of_lines(2, 20, firsts, rare, held, 1)(iter([batch]))), []) for held in (firsts, shared))
    assert 0 < len(some) < len(every) / 10
    met = [r for b in lines.meeting(2, 8)(lines.packed(lambda _: iter([np.array(some, lines.ROW)]), 1)(iter([batch]))) for r in b.to_pylist()]
    name = {x: int(h) for data, ends, h in lines.distinct(iter([batch]), firsts.value) for x, h in zip([data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])], h.view(np.int64))}
    assert {tuple(sorted((name[base[3]], name[texts[1]]))), tuple(sorted((name[base[50]], name[texts[2]])))} <= {(r["a"], r["b"]) for r in met}


def test_two_lines_are_compared_in_one_of_their_sets():
    sets = [[5, 9], [5, 9, 2], [9, 2], [9]]
    want = [[any(s < 9 and s in b for s in a) for b in sets] for a in sets]
    assert (lines.met_before(sets, 9) & ~np.eye(4, dtype=bool)).tolist() == [[x and i != j for j, x in enumerate(row)] for i, row in enumerate(want)]
    assert not lines.met_before(sets, 2).any()


def test_rows_of_lines_go_in_turns(spark, monkeypatch):
    sent, rng = [], random.Random(11)
    plain = lines.rows_of_lines

    def counted(*args):
        sent.append(args[-1])
        return plain(*args)

    base = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in [30] * 40 + [200] * 40 + [75, 76, 130] * 20]
    rows = [(i, "\n".join(base[i::20])) for i in range(20)]
    rows += [(100 + k, x[:-9] + rng.choice(["", "x", "xyz"]) + x[-7:]) for k, x in enumerate(base[::3])]
    want = [(i, n, gone, brute.sha((text or "").encode())) for i, n, gone, text in brute.kept_texts(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in {"TURN_TEXTS": 0, "TURN_BYTES": 1, "PART_BYTES": 1 << 11, "rows_of_lines": counted}.items():
        monkeypatch.setattr(lines, name, value, raising=False)
    same(lines.report(df), want)
    assert len(sent) > 4 and sent[0][0] == 0
    assert all(a[1] == b[0] for a, b in zip(sent, sent[1:]))


def test_turns_hold_so_many_rows(monkeypatch):
    monkeypatch.setattr(lines, "TURN_BYTES", 1000)
    gb = 1 << 30
    assert lines.turns_of(0, 0, 1) == [(0, 1)] and lines.turns_of(2 * gb // 18, gb, 128) == [(0, 128)]
    assert lines.turns_of(9 * gb // 18, gb, 128) == [(0, 25), (25, 51), (51, 76), (76, 102), (102, 128)]
