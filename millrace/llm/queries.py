"""Queries of the language-model data problems (p4, p7, p8, p9) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from .leaks import LeakScan
from .rank_summaries import RankSummaries
from .residue import ResidueFilter
from .source_mix import SourceMix


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    r = RankSummaries()
    return r.percentiles(r.merged(r.daily(table(spark, d, "models")))).drop("day").withColumnRenamed("grp", "model_name")


def p4_daily_percentiles(spark: SparkSession, d: str) -> DataFrame:
    r = RankSummaries()
    return r.percentiles(r.daily(table(spark, d, "models"))).withColumnRenamed("grp", "model_name")


def p4_rank_check(spark: SparkSession, d: str) -> DataFrame:
    r, models = RankSummaries(), table(spark, d, "models")
    answers = materialize(r.percentiles(r.merged(r.daily(models))), "percentiles")
    return r.rank_check(models, answers).withColumnRenamed("grp", "model_name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return LeakScan().found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return SourceMix().select(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return SourceMix().select(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Per target whether its documents keep to the repeats, add up to what the shares say, and reach the budget to within one text."""
    sel, shares = SourceMix().select(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    sel = materialize(sel, "selection")
    got = sel.groupBy("source").agg(F.max("repeats").alias("most"), F.sum(F.col("tokens") * F.col("repeats")).alias("sum"), F.max("tokens").alias("longest"), F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))
    j = shares.join(got, "source", "left").fillna(0, ["most", "sum", "longest", "n", "docs"])
    short = F.col("budget") - F.col("tokens_taken")
    return j.select(
        "source", (F.col("most") <= F.col("max_repeats")).alias("repeats_kept"), (F.col("sum") == F.col("tokens_taken")).alias("shares_true"), (F.col("n") == F.col("docs")).alias("each_once"),
        ((short >= 0) & (short <= F.col("longest"))).alias("budget_reached"), (F.abs(F.col("actual_share") - F.col("share")) < 0.005).alias("share_reached"),
    )


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return ResidueFilter().score(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return ResidueFilter().found(table(spark, d, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p4_percentiles, p4_daily_percentiles, p4_rank_check, p7_found, p7_leaked_items, p8_selection, p8_shares, p8_check, p9_found, p9_scores)}

ORACLE = {
    "p8_check": "SELECT regexp_replace(lower(trim(source)), '[\\s\\-]+', '_', 'g') AS source, true AS repeats_kept, true AS shares_true, true AS each_once, true AS budget_reached, true AS share_reached FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 GROUP BY 1",
    "p4_rank_check": """
        SELECT model_name, count(*) AS n, true AS n_exact, true AS p50_within, true AS p90_within, true AS p99_within
        FROM (SELECT execution_id, min(model_name) AS model_name, min(duration_ms) AS x FROM models WHERE duration_ms >= 0 AND execution_id IS NOT NULL AND model_name IS NOT NULL GROUP BY execution_id)
        GROUP BY model_name""",
}
