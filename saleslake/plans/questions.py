"""Batch jobs over questions, conversations and the query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslake import vocab
from saleslake.functions.parsing import strip
from saleslake.functions.text import count_contained
from saleslake.operators.containment import name_lengths, substrings
from saleslake.operators.joins import fan_out_join, union_all


def keyword_scores(question: Column) -> tuple[Column, Column]:
    body = strip(F.lower(question))
    return count_contained(body, vocab.NARRATIVE_KEYWORDS), count_contained(body, vocab.METRIC_KEYWORDS)


def intent(question: Column) -> Column:
    """Narrative when it has any narrative sign and at least as many as metric signs."""
    narrative, metric = keyword_scores(question)
    return F.when((narrative > 0) & (narrative >= metric), "narrative").otherwise("metric")


def is_greeting(question: Column) -> Column:
    body = strip(F.lower(question))
    found = F.lit(False)
    for word in vocab.GREETINGS:
        found = found | (body == word) | body.startswith(word + " ") | body.startswith(word + "!")
    return found


def recent_context(turns: DataFrame, cut: int | None = vocab.HISTORY_CHARS) -> DataFrame:
    """Last six turns of each conversation as one text, long turns cut when asked to."""
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    content = F.col("text")
    if cut is not None:
        content = F.when(F.length(content) > cut, F.concat(F.substring(content, 1, cut), F.lit("..."))).otherwise(content)
    line = F.concat(F.upper("role"), F.lit(": "), content)
    return (
        turns.withColumn("back", F.row_number().over(latest))
        .where(F.col("back") <= vocab.HISTORY_TURNS)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
        .select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))
    )


def with_row_counts(asked: DataFrame, tiers: dict[str, DataFrame], row_id: str) -> DataFrame:
    """The questions with the rows that each tier has for their account, 0 for none.

    One aggregate holds the counts of all tiers, and one join brings them to the questions; an account that most
    questions are about is salted by ``row_id``.
    """
    counted = [
        rows.groupBy("account_name").agg(F.count(F.lit(1)).alias("n")).withColumn("tier", F.lit(tier)) for tier, rows in tiers.items()
    ]
    counts = union_all(counted).where(F.col("account_name").isNotNull()).groupBy("account_name").agg(
        *[F.sum(F.when(F.col("tier") == tier, F.col("n"))).alias(tier) for tier in tiers]
    )
    return fan_out_join(asked, counts, ["account_name"], row_id).fillna(0, list(tiers))


def answer_route(questions: DataFrame) -> DataFrame:
    """Which tier answers, from the row counts each tier would return.

    Rows carry ``question`` and the counts ``gold_rows``, ``silver_rows``, ``bronze_rows``
    and ``vector_rows``.
    """
    gold, silver = F.col("gold_rows") > 0, F.col("silver_rows") > 0
    bronze, vector = F.col("bronze_rows") > 0, F.col("vector_rows") > 0
    tables = F.when(gold, "gold").when(silver, "silver").when(bronze, "bronze")
    narrative = F.when(vector, "vector").otherwise(F.coalesce(tables, F.lit("none")))
    metric = F.coalesce(tables, F.when(vector, "vector"), F.lit("none"))
    return questions.withColumn("intent", intent(F.col("question"))).withColumn(
        "route",
        F.when(is_greeting(F.col("question")), "greeting")
        .when(F.col("intent") == "narrative", narrative)
        .otherwise(metric),
    )


def silver_tables(sql_text: Column) -> Column:
    """Silver tables a statement names, sorted, as ``silver.a,silver.b``."""
    names = F.transform(F.regexp_extract_all(sql_text, F.lit(vocab.SILVER_TABLE_PATTERN), F.lit(1)), F.lower)
    kept = F.filter(names, lambda n: ~n.isin(vocab.SQL_WORDS))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(kept)), lambda n: F.concat(F.lit("silver."), n)), ",")


def new_proposals(fallbacks: DataFrame, pending: DataFrame, row_id: str, head: int = 30) -> DataFrame:
    """Fallback questions no pending proposal already covers.

    A proposal covers a question when it contains the question's first 30 characters, or
    was made for the same list of tables. Both tests are equality joins: containment is
    tested on the proposals' own substrings of the lengths that occur. They run on the distinct
    pairs of head and tables; the log is joined to what is left, with hot pairs salted by ``row_id``.
    """
    asked = fallbacks.withColumn("_head", F.lower(F.substring("question", 1, head)))
    kinds = asked.select("_head", "tables").distinct()
    lengths = name_lengths(kinds, "_head") or [1]
    covered = pending.select(F.explode(substrings(F.lower("question"), lengths)).alias("_head")).distinct()
    left = kinds.join(covered, "_head", "left_anti").join(pending.select("tables").distinct(), "tables", "left_anti")
    return fan_out_join(asked, left, ["_head", "tables"], row_id, how="inner").drop("_head")


def fallback_candidates(log: DataFrame) -> DataFrame:
    """Table sets by how often questions fell back to them."""
    return log.groupBy("tables").agg(F.count(F.lit(1)).alias("fallbacks"), F.min("question").alias("example"))
