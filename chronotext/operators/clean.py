"""Projections, filters, validation and per-source statistics of segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from chronotext.functions import text as X
from chronotext.sources.readers import ordered_text

#: A segment that is one bracketed label.  Fixed value.
NOISE = r"^[ \t\n\r\f]*[\[\(][^\]\)]{1,30}[\]\)][ \t\n\r\f]*$"


def strip_noise(seg: DataFrame) -> DataFrame:
    """Without segments that are one bracketed label."""
    return seg.filter(~F.coalesce(F.col("text").rlike(NOISE), F.lit(False)))


def normalise_ws(seg: DataFrame) -> DataFrame:
    """White space collapsed and stripped; blank segments dropped."""
    # The filter looks for one character, so no text is cleaned twice.
    return seg.filter(F.col("text").rlike(r"[^ \t\n\r\f\x0B]")).withColumn("text", X.clean_space(F.col("text")))


def fill_gaps(seg: DataFrame, max_gap: float = 2.0) -> DataFrame:
    """A gap of at most ``max_gap`` before the next segment is closed by stretching the end."""
    following = F.lead("start").over(W.Window.partitionBy("source_id").orderBy("start", "seq"))
    gap = following - F.col("end")
    return seg.withColumn("end", F.when((gap > 0) & (gap <= max_gap), following).otherwise(F.col("end")))


def align(seg: DataFrame, max_gap: float = 2.0) -> DataFrame:
    return fill_gaps(normalise_ws(strip_noise(seg)), max_gap)


def bounds_ok(scores: tuple[str, ...] = ()) -> Column:
    ok = F.coalesce(F.col("end") >= F.col("start"), F.lit(False))
    for c in scores:
        ok = ok & F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))
    return ok


def validate_bounds(df: DataFrame, scores: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """``df`` with is_valid: end >= start, scores within 0 and 1.  In strict mode an invalid row fails the query."""
    ok = bounds_ok(scores)
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("row out of bounds")).cast("boolean"))
    return df.withColumn("is_valid", ok)


def quarantine(df: DataFrame, scores: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: the rows within bounds, and the others with ``reason``, the first rule that they break (a null bound breaks it too)."""
    broken = F.when(~F.coalesce(F.col("end") >= F.col("start"), F.lit(False)), "end before start")
    for c in scores:
        broken = broken.when(~F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False)), f"{c} out of bounds")
    rows = df.withColumn("reason", broken)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def with_times(df: DataFrame) -> DataFrame:
    return df.withColumn("duration", F.col("end") - F.col("start")).withColumn("midpoint", (F.col("start") + F.col("end")) / 2)


def transcript_stats(seg: DataFrame, counter: Callable[[Column], Column] = X.token_count) -> DataFrame:
    """Words, segments and the last segment's end of each source."""
    return seg.groupBy("source_id").agg(F.sum(counter(F.col("text"))).cast("long").alias("word_count"), F.count("*").alias("n_segments"), F.max_by("end", "seq").alias("duration"))


def full_text(seg: DataFrame) -> DataFrame:
    return ordered_text(seg, " ").withColumnRenamed("text", "full_text")


def with_placeholder(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("is_placeholder", X.is_placeholder(F.col(column)))


def valid_rows(df: DataFrame, texts: tuple[str, ...], points: str) -> DataFrame:
    """``df`` with is_valid: no placeholder among ``texts`` and a key point that is none."""
    ok = F.coalesce(F.exists(points, lambda p: ~X.is_placeholder(p)), F.lit(False))
    for c in texts:
        ok = ok & ~X.is_placeholder(F.col(c))
    return df.withColumn("is_valid", ok)


def with_fallback(fallback: DataFrame, generated: DataFrame, key: list[str]) -> DataFrame:
    """Each row of ``fallback``, or in its place the generated row of the same key where that is valid (is_valid)."""
    fields = [c for c in fallback.columns if c not in key]
    made = generated.filter("is_valid").select(*key, F.struct(*fields).alias("_made"))
    rows = fallback.join(made, key, "left")
    pick = [F.when(F.col("_made").isNotNull(), F.col(f"_made.{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    return rows.select(*key, *pick, F.col("_made").isNotNull().alias("was_generated"))


def metadata_rows(sources: DataFrame) -> DataFrame:
    """What metadata.json says of a source, as a struct in JSON."""
    fields = ["video_id", "title", "channel", "duration_seconds", F.left(F.coalesce("description", F.lit("")), F.lit(500)).alias("description"), "word_count", "language"]
    return sources.select("source_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("metadata_json"))
