"""Scores of chunks: mined from answers, taken from observations, merged and filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from chronotext.operators import timejoin
from chronotext.operators.clean import with_times

NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def _clamp(c: Column) -> Column:
    """Within 0 and 1; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def mine_scores(resp: DataFrame, column: str = "body") -> DataFrame:
    """``resp`` with score (0 to 1) and the rule that found it.

    1 the whole answer is a number; 2 it is JSON with a score; 3 a number follows score, importance, rating or value
    (above 1: out of ten); 4 its first number between 0 and 1; 5 its first number, out of ten; 0 none of these: 0.5.
    """
    body = F.regexp_replace(F.coalesce(column, F.lit("")), r"^[ \t\n\r\"']+|[ \t\n\r\"']+$", "")
    whole = F.when(body.rlike(rf"^-?{NUMBER}$"), _clamp(body.try_cast("double")))
    in_json = F.get_json_object(F.when(body.rlike(r"^\{"), body), "$.score")
    json = F.when(in_json.rlike(rf"^-?{NUMBER}$"), _clamp(in_json.try_cast("double")))
    named = F.nullif(F.regexp_extract(F.lower(body), rf"(?:score|importance|rating|value)[: \t\n=]+({NUMBER})", 1), F.lit("")).try_cast("double")
    named = F.when(named > 1, _clamp(named / 10)).otherwise(named)
    numbers = F.transform(F.regexp_extract_all(body, F.lit(NUMBER), F.lit(0)), lambda x: x.try_cast("double"))
    inside = F.get(F.filter(numbers, lambda x: x <= 1), F.lit(0))
    first = _clamp(F.get(numbers, F.lit(0)) / 10)
    rules = [(1, whole), (2, json), (3, named), (4, inside), (5, first)]
    rule = F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for k, c in rules), F.lit(0))
    return resp.withColumn("score", F.coalesce(*(c for _, c in rules), F.lit(0.5))).withColumn("rule", rule)


def visual_scores(chunks: DataFrame, obs: DataFrame, tol: float = 15.0) -> DataFrame:
    """(source_id, chunk_no, visual_score) of chunks with an observation near their midpoint: its change, else its content score, within 0 and 1."""
    near = timejoin.nearest(with_times(chunks).select("source_id", "chunk_no", "midpoint"), obs, "midpoint", ["chunk_no"], tol)
    value = F.coalesce("near.scene_diff", "near.content_score") if "content_score" in obs.columns else F.col("near.scene_diff")
    return near.select("source_id", "chunk_no", _clamp(value).alias("visual_score"), value.alias("_v")).filter("_v IS NOT NULL").drop("_v")


def composite(llm: Column, visual: Column, w_llm: float = 0.7, w_visual: float = 0.3) -> Column:
    return llm * w_llm + visual * w_visual


def with_composite(df: DataFrame, w_llm: float = 0.7, w_visual: float = 0.3, important: float = 0.4) -> DataFrame:
    """``df`` (llm_score, visual_score) with composite_score and is_important."""
    return df.withColumn("composite_score", composite(F.col("llm_score"), F.col("visual_score"), w_llm, w_visual)).withColumn("is_important", F.col("composite_score") >= important)


def merge_scores(scored: DataFrame, visual: DataFrame, obs: DataFrame, w_llm: float = 0.7, w_visual: float = 0.3) -> DataFrame:
    """``scored`` (source_id, chunk_no, llm_score, visual_score, composite_score) with visual scores put in, missing ones as 0.

    Sources without any observation stay as they are.
    """
    seen = obs.select("source_id").distinct().withColumn("_seen", F.lit(True))
    rows = scored.join(visual.withColumnRenamed("visual_score", "_v").hint("shuffle_merge"), ["source_id", "chunk_no"], "left").join(seen.hint("shuffle_merge"), "source_id", "left")
    v = F.when(F.col("_seen"), F.coalesce("_v", F.lit(0.0))).otherwise(F.col("visual_score"))
    c = F.when(F.col("_seen"), composite(F.col("llm_score"), v, w_llm, w_visual)).otherwise(F.col("composite_score"))
    return rows.withColumn("composite_score", c).withColumn("visual_score", v).drop("_seen", "_v")


def above_counts(scored: DataFrame, threshold: float = 0.15) -> DataFrame:
    return scored.groupBy("source_id").agg(F.count_if(F.col("composite_score") >= threshold).alias("n_above"), F.count("*").alias("n_total"))


def filter_detail(scored: DataFrame, detail: str = "high", threshold: float = 0.15) -> DataFrame:
    """``high`` keeps all; ``low`` keeps the best quarter (at least one) of the chunks above ``threshold``, or of all where none is."""
    if detail == "high":
        return scored
    src = W.Window.partitionBy("source_id")
    above = F.col("composite_score") >= threshold
    rows = scored.withColumn("_any", F.max(above).over(src)).filter(above | ~F.col("_any"))
    best = src.orderBy(F.col("composite_score").desc(), "start", "end", "chunk_no")
    rows = rows.withColumn("_n", F.count("*").over(src)).withColumn("_r", F.row_number().over(best))
    return rows.filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 4))).drop("_any", "_n", "_r")


def first_success(resp: DataFrame, requests: DataFrame, key: list[str]) -> DataFrame:
    """The first answer without an error by priority, for each request; an error row where all failed.  ``resp`` has priority, provider, body, error."""
    good = resp.filter("error IS NULL").groupBy(*key).agg(F.min_by(F.struct("provider", "body"), F.struct("priority", "provider")).alias("r"))
    rows = requests.select(*key).join(good, key, "left")
    return rows.select(*key, F.col("r.provider").alias("provider"), F.col("r.body").alias("body"), F.when(F.col("r").isNull(), "all providers failed").alias("error"))
