"""Operators against brute force on small inputs, and on skewed ones."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleslake.operators import chunking, containment, identity, joins, mapping, merge, quality, search, vectors
from saleslake.operators.ranking import number_rows


# ------------------------------------------------------------------ chunks
def test_windows(spark):
    rng = random.Random(5)
    texts = ["a" * 1200, "x" * 450 + ". " + "y" * 700, "z" * 500, "z" * 501, "q" * 51, "😀" * 1300]
    texts += ["".join(rng.choice("ab . .\n") for _ in range(rng.randrange(50, 3000))).strip() or "b" * 60 for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", chunking.window_texts(F.col("t")).alias("w")).collect()}
    assert [len(w) for w in got[0]] == [500, 500, 400]
    assert [len(w) for w in got[1]] == [451, 500, 401]
    for i, text in enumerate(texts):
        ends = [0]
        for n, window in enumerate(got[i]):
            # Every window starts 100 before the end of the one before it, and nothing lies between.
            start = ends[-1] - 100 if n else 0
            assert 0 < len(window) <= 500 and text[start : start + len(window)] == window, i
            ends.append(start + len(window))
            if n < len(got[i]) - 1:
                # It ends at the last sentence end of its final fifth if there is one, else it is full.
                stops = [m for m in range(400, 499) if text[start + m : start + m + 2] == ". "]
                assert len(window) == (stops[-1] + 1 if stops else 500), i
        assert ends[-1] == len(text), i
        assert len(got[i]) == 1 or len(text) - ends[-2] > 0, i


def test_short_documents_have_no_chunks(spark):
    docs = spark.createDataFrame([("f", "A", " " + "x" * 49 + " "), ("g", None, "x" * 50)], "filename string, account_name string, text string")
    rows = chunking.chunk(docs).collect()
    assert [(r.filename, r.chunk_index, r.total_chunks) for r in rows] == [("g", 0, 1)]


# ------------------------------------------------------------------ joins and ranks
def test_hot_keys_are_salted_without_changing_the_result(spark):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.col("id").cast("string")).alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), ("5", 3), (None, 4)], "k string, v int")
    got = joins.fan_out_join(facts, dim, ["k"], "id", hot_rows=100)
    assert joins.hot_keys(facts, ["k"], 100).count() == 2
    by_value = {r.v: r.n for r in got.groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert by_value == {1: 1000, 2: 1000, 3: 1, 4: 1000, None: 999}


def test_lookup_join_spreads_missing_ids(spark):
    facts = spark.range(100).select("id", F.when(F.col("id") < 5, F.col("id")).alias("ref"))
    dim = spark.range(3).select(F.col("id").alias("dim_id"))
    got = joins.lookup_join(facts, dim, "ref", "dim_id", F.col("id"))
    assert got.count() == 100 and got.where("dim_id is not null").count() == 3


def test_global_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("v"), F.col("id").alias("name")).repartition(5)
    rows = number_rows(df, [F.desc("v"), F.asc("name")], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 1001))
    assert [(r.v, r.name) for r in rows] == sorted(((r.v, r.name) for r in rows), key=lambda x: (-x[0], x[1]))


# ------------------------------------------------------------------ containment and identity
def test_contained_pairs_match_brute_force(spark):
    rng = random.Random(3)
    inner = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(20)})
    outer = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)})
    a = spark.createDataFrame([(x,) for x in inner], "inner_text string")
    b = spark.createDataFrame([(x,) for x in outer], "outer_text string")
    got = {(r.inner_text, r.outer_text) for r in containment.contained_in(a, b, "inner_text", "outer_text", "outer_text").collect()}
    assert got == {(x, y) for x in inner for y in outer if x in y}


def test_overview_counts_by_containment(spark):
    accounts = spark.createDataFrame([(1, "Cyberdyne"), (2, "Cyberdyne Systems"), (3, ""), (4, None)], "id bigint, account_name string")
    contacts = spark.createDataFrame([("CYBERDYNE SYSTEMS",), ("other",), (None,)], "account_name string")
    deals = spark.createDataFrame([("cyberdyne", "5"), ("Cyberdyne Systems", "x")], "account_name string, deal_value string")
    got = {
        r.id: (r.contact_count, r.deal_count, r.deal_total_value, r.interaction_count)
        for r in containment.counts_by_contained_name(accounts, contacts, deals, contacts).collect()
    }
    assert got == {1: (1, 2, 5.0, 1), 2: (1, 1, 0.0, 1), 3: (2, 2, 5.0, 2), 4: (0, 0, 0.0, 0)}


def resolved(spark, accounts, names):
    known = spark.createDataFrame(accounts, "id bigint, account_name string")
    batch = spark.createDataFrame([(n, "s", i) for i, n in enumerate(names)], "name string, source string, seq bigint")
    rows, created = identity.resolve(batch, known)
    return {r.name: (r.account_id, r.tier) for r in rows.collect()}, {r.id: r.account_name for r in created.collect()}


def test_resolution_tiers(spark):
    accounts = [(1, "Cyberdyne"), (2, "Cyberdyne Systems"), (3, "")]
    got, created = resolved(spark, accounts, ["cyberdyne", "Cyberdyne Sys", "Cyberdyne", "cy", "  ", None])
    assert got == {"cyberdyne": (1, 2), "Cyberdyne Sys": (1, 3), "Cyberdyne": (1, 1), "cy": (4, 4)}
    assert created == {4: "cy"}


def sequential(accounts, names):
    """Name by name, each against the accounts existing at that moment."""
    known, out = list(accounts), {}
    top = max((i for i, _ in known), default=0)
    for name in names:
        if name in out:
            continue
        same = [i for i, a in known if a == name] or [i for i, a in known if a.strip().lower() == name.strip().lower()]
        near = sorted(
            (len(a), i) for i, a in known if len(name) >= 3 and (a.lower() in name.lower() or name.lower() in a.lower())
        )
        if same:
            out[name] = min(same)
        elif near:
            out[name] = near[0][1]
        else:
            top += 1
            known.append((top, name))
            out[name] = top
    return out, {i: a for i, a in known[len(accounts):]}


@pytest.mark.parametrize("seed", [1, 2])
def test_creation_follows_the_order_of_names(spark, seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abX ") for _ in range(rng.randrange(1, 7))).strip() for _ in range(60)]
    names = [n for n in names if n]
    accounts = [(10, "abab"), (11, "bXb a")]
    got, created = resolved(spark, accounts, names)
    expected, expected_created = sequential(accounts, names)
    assert created == expected_created
    assert {n: i for n, (i, _) in got.items()} == expected


# ------------------------------------------------------------------ merges and mapping
def test_later_values_win_unless_empty(spark):
    batch = spark.createDataFrame(
        [("k", 1, "a", "x"), ("k", 2, None, "y"), ("k", 3, "", None), (None, 1, "n", "n")], "key string, seq int, a string, b string"
    )
    got = {r.key: (r.a, r.b) for r in merge.last_non_null(batch, ["key"], "seq").collect()}
    assert got == {"k": ("a", "y"), None: ("n", "n")}


def test_upsert_is_idempotent_and_null_safe(spark):
    current = spark.createDataFrame([(1, "Ann", None, "CEO")], "id bigint, contact_name string, account_name string, role string")
    batch = spark.createDataFrame([("Ann", None, None, 1), ("Bob", None, "CTO", 2)], "contact_name string, account_name string, role string, seq int")
    keys = ["contact_name", "account_name"]
    once = merge.assign_ids(merge.upsert(current, batch, keys, "seq"))
    twice = merge.upsert(once, batch, keys, "seq")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    assert {r.contact_name: r.role for r in once.collect()} == {"Ann": "CEO", "Bob": "CTO"}


def test_unmapped_and_evolved_fields(spark):
    batch = spark.createDataFrame(
        [(1, "A", None, "x" * 150, "s"), (2, "A", "9", "late", "s")], "seq int, account_name string, Deal-Score string, note string, source string"
        .replace("Deal-Score", "`Deal-Score`"),
    )
    rows = {r.field: r.sample_value for r in mapping.unmapped_fields(batch, "crm", "seq").collect()}
    assert rows == {"Deal-Score": "9", "note": "x" * 100, "source": "s"}
    outcome = mapping.evolve(list(rows), {"Deal-Score": "silver.dim_account"})
    assert outcome.added == {"dim_account": {"deal_score": "Deal-Score"}} and set(outcome.ignored) == {"note", "source"}
    got = mapping.map_table(batch, "crm", "dim_account", ["seq"], outcome.added["dim_account"])
    assert [r.deal_score for r in got.orderBy("seq").collect()] == [None, "9"]


def test_rows_without_content_are_not_emitted(spark):
    batch = spark.createDataFrame([("A", "Ann", None), ("A", "Ann", "x")], "account_name string, contact_name string, deal_stage string")
    assert mapping.map_table(batch, "crm", "fact_deals").count() == 1
    assert mapping.map_table(batch, "crm", "dim_account").count() == 2


def test_other_accounts(spark):
    batch = spark.createDataFrame([("Acme", None), (" acme ", None), (None, "Beta"), ("x", None)], "account_name string, company string")
    assert {r[0] for r in mapping.other_accounts(batch, "ACME").collect()} == {"Beta"}


def test_split_partitions_the_input(spark):
    df = spark.createDataFrame([(1, "D", "A", "1"), (2, "", "A", "1"), (3, "D", "A", "x")], "id bigint, deal_name string, account_name string, deal_value string")
    valid, rejects = quality.split(df, "fact_deals")
    assert {r.id for r in valid.collect()} | {r.id for r in rejects.collect()} == {1, 2, 3}
    assert valid.count() == 1 and '"deal_value":"x"' in rejects.where("id = 3").first().raw_record


# ------------------------------------------------------------------ vectors and raw search
@pytest.mark.parametrize("vector_block,query_block", [(1 << 13, 1 << 10), (37, 2)])
def test_top_k_matches_brute_force(spark, monkeypatch, vector_block, query_block):
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", vector_block)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(200, 8))
    base[50] = base[3]  # equal vectors tie by id
    base[60:75] = base[3]
    queries = np.vstack([base[3], rng.normal(size=(5, 8))])
    v = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(base)], "vec_id bigint, embedding array<double>, scope int").repartition(5)
    q = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(queries)], "query_id bigint, embedding array<double>, scope int")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(queries) @ unit(base).T, 10)
    for scoped in (False, True):
        got = vectors.top_k(v, q, 5) if scoped else vectors.top_k(v.drop("scope"), q.drop("scope"), 5)
        found = {(r.query_id, r["rank"]): r.vec_id for r in got.collect()}
        for i in range(len(queries)):
            pool = [j for j in range(200) if not scoped or j % 3 == i % 3]
            best = sorted(pool, key=lambda j: (-scores[i, j], j))[:5]
            assert [found[(i, n)] for n in range(1, 6)] == best


def test_reindexing_replaces_a_document(spark):
    make = lambda text: chunking.chunk(spark.createDataFrame([("F.txt", "Acme", text), ("g", "Acme", "y" * 60)], "filename string, account_name string, text string"))
    before = make("x" * 1200)
    after = vectors.replace_documents(before, make("z" * 70).where("filename = 'F.txt'"))
    assert sorted((r.filename, r.chunk_index, r.chunk_text[0]) for r in after.collect()) == [("F.txt", 0, "z"), ("g", 0, "y")]


def test_keywords_and_records(spark):
    assert search.question_keywords("What did Big Corp and Al say to Big Corp?", "Acme") == ["Acme", "Big Corp"]
    rows = [(i, "s", "t", f'{{"raw_transcript":"{"Big Corp" if i in (1, 2, 3, 4) else "none"} {i}"}}', f"2024-01-0{i}") for i in range(1, 8)]
    bronze = spark.createDataFrame(rows, "id bigint, source string, data_type string, raw_payload string, created_at string")
    ids = lambda question: [r.id for r in search.relevant_records(bronze, question).collect()]
    assert ids("What about Big Corp?") == [4, 3, 2]
    assert ids("What about Nobody?") == [7, 6]
    assert ids("no names here") == [7, 6]


def test_vector_ids_may_be_texts(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "vec_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in vectors.top_k(rows, asked, 2).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]


def test_search_without_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id bigint, embedding array<double>")
    asked = rows.withColumnRenamed("vec_id", "query_id")
    assert [tuple(r) for r in vectors.top_k(rows, asked).collect()] == [(1, 1, 1, 1.0)]
    assert vectors.top_k(rows.limit(0), asked).count() == vectors.top_k(rows, asked.limit(0)).count() == 0
