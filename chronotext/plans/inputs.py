"""The engine's input tables, derived from the driver's tables, in Spark SQL and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as timed segments; some lines become noise labels or blanks."""
    return spark.sql(
        """
WITH l AS (SELECT doc_id AS source_id, pos AS seq, line FROM {docs} LATERAL VIEW posexplode(split(text, '\n')) t AS pos, line),
n AS (SELECT source_id, seq,
        CASE WHEN (source_id*31+seq)%17=0 THEN '[Music]' WHEN (source_id*31+seq)%19=0 THEN '   ' ELSE line END AS text,
        length(line) AS n_ch FROM l),
c AS (SELECT *, 40*n_ch AS dur_ms, ((source_id*7+seq*13)%6)*1000 AS gap_ms FROM n)
SELECT source_id, seq, text, coalesce(sum(dur_ms+gap_ms) OVER w, 0)/1000.0D AS start,
       (coalesce(sum(dur_ms+gap_ms) OVER w, 0)+dur_ms)/1000.0D AS `end`
FROM c WINDOW w AS (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        docs=table(spark, sf_dir, "documents"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed observations of a source."""
    e = table(spark, sf_dir, "events")
    second = F.expr("unix_seconds(cast(ts as timestamp))")
    return e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("frame_id"), (second % 240).cast("double").alias("ts"), F.col("value").alias("size"), (F.col("value") / 500.0).alias("scene_diff"))


def playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as playback positions of viewers."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("viewer_event"), F.col("user_id").alias("source_id"), F.col("ts").alias("event_time"), F.col("value").alias("t"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id"), F.col("quality").cast("double").alias("llm_score"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as model answers of seven kinds."""
    return spark.sql(
        """
SELECT conv_id, turn, CASE (conv_id*3+turn)%7 WHEN 0 THEN '0.8' WHEN 1 THEN '{{"score": 0.75}}' WHEN 2 THEN concat('Score: ', turn, '/10. ', text)
  WHEN 3 THEN concat('<think>', text, '</think>\n{{"heading": "H', turn, '", "summary": "', 'abcd', '", "key_points": ["kp one"]}}')
  WHEN 4 THEN '' WHEN 5 THEN concat(text, ' 0.', turn) ELSE text END AS body FROM {t}""",
        t=turns(spark, sf_dir),
    )


SEGMENTS = """d0 AS (SELECT doc_id AS source_id, string_split(text, chr(10)) AS a FROM documents),
l0 AS (SELECT source_id, unnest(range(len(a)))::INT AS seq, unnest(a) AS line FROM d0),
n0 AS (SELECT source_id, seq, CASE WHEN (source_id*31+seq)%17=0 THEN '[Music]' WHEN (source_id*31+seq)%19=0 THEN '   ' ELSE line END AS text, length(line) AS n_ch FROM l0),
c0 AS (SELECT *, 40*n_ch AS dur_ms, ((source_id*7+seq*13)%6)*1000 AS gap_ms FROM n0),
segments AS (SELECT source_id, seq, text, coalesce(sum(dur_ms+gap_ms) OVER w, 0)::BIGINT/1000.0::DOUBLE AS start,
  (coalesce(sum(dur_ms+gap_ms) OVER w, 0)+dur_ms)::BIGINT/1000.0::DOUBLE AS "end"
  FROM c0 WINDOW w AS (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
FRAMES = """frames AS (SELECT user_id AS source_id, event_id AS frame_id, (floor(epoch(ts))::BIGINT % 240)::DOUBLE AS ts, value AS size, value/500.0::DOUBLE AS scene_diff FROM events)"""
PLAYBACK = "playback AS (SELECT event_id AS viewer_event, user_id AS source_id, ts AS event_time, value AS t FROM events)"
SCORES = "scores AS (SELECT doc_id AS source_id, CAST(quality AS DOUBLE) AS llm_score FROM labels)"
#: Answers with deeper objects, braces and quotes in strings, and objects that never end; both dialects read it.
DEEP = """CASE conv_id % 4 WHEN 0 THEN concat('{"a": {"b": {"c": {"d": {"e": ', turn, '}}}}, "t": "brace } ', chr(92), '" { in ', turn, '"} then ', body)
WHEN 1 THEN concat('{ never ends "', body, ' {"heading": "a {b", "summary": "s', turn, '"} end') WHEN 2 THEN concat(body, ' {"score": "', turn, '"} {"score": 0.', turn, '} {"x": {}}') ELSE body END"""
RESPONSES = """responses AS (SELECT conv_id, turn, CASE (conv_id*3+turn)%7 WHEN 0 THEN '0.8' WHEN 1 THEN '{"score": 0.75}' WHEN 2 THEN concat('Score: ', turn, '/10. ', text)
  WHEN 3 THEN concat('<think>', text, '</think>'||chr(10)||'{"heading": "H', turn, '", "summary": "', 'abcd', '", "key_points": ["kp one"]}')
  WHEN 4 THEN '' WHEN 5 THEN concat(text, ' 0.', turn) ELSE text END AS body FROM conversations)"""
