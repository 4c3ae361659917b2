"""Scans: captions, recognised speech, transcript documents, saved notes and source metadata as rows keyed by ``source_id``."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from chronotext.functions import text as X
from chronotext.sources import bundle

TRANSCRIPT_DDL = "segments array<struct<start: double, `end`: double, text: string>>, source string, language string"
_STAMP = r"^\[(\d{1,2}:)?\d{1,2}:\d{2}\][ \t]*"


def read_captions(df: DataFrame) -> DataFrame:
    """(source_id, entries array<struct<start, duration, text>>) -> segments; texts are stripped and blank ones dropped."""
    rows = df.select("source_id", F.posexplode("entries").alias("seq", "e"))
    text = X.clean_ends(F.col("e.text"))
    out = rows.select("source_id", "seq", F.col("e.start").alias("start"), (F.col("e.start") + F.col("e.duration")).alias("end"), text.alias("text"), F.lit("youtube_manual").alias("origin"))
    return out.filter("text <> ''")


def read_asr(df: DataFrame) -> DataFrame:
    """(source_id, seq, start, end, text, avg_logprob, language) -> segments with the log-probability as confidence; blanks stay."""
    return df.select("source_id", "seq", "start", "end", X.clean_ends(F.col("text")).alias("text"), F.col("avg_logprob").alias("confidence"), "language", F.lit("whisper").alias("origin"))


def parse_transcript_json(df: DataFrame, column: str = "body") -> DataFrame:
    """(source_id, JSON document) -> segments with origin and language."""
    rows = df.select("source_id", F.from_json(column, TRANSCRIPT_DDL).alias("j"))
    return rows.select("source_id", F.posexplode("j.segments").alias("seq", "s"), F.col("j.source").alias("origin"), F.col("j.language").alias("language")).select("source_id", "seq", "s.start", "s.end", "s.text", "origin", "language")


def read_transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """Transcript documents under ``path``, one a file; the file's path is the source_id."""
    return parse_transcript_json(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("body")))


def seconds_of(stamp: Column) -> Column:
    """Seconds of ``[MM:SS]`` or ``[H:MM:SS]`` at the start of a line; null where there is none."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(stamp, r"^\[(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\]", i), F.lit("")).cast("int"), F.lit(0))
    return F.when(stamp.rlike(_STAMP), part(1) * 3600 + part(2) * 60 + part(3))


def read_transcript_text(df: DataFrame, column: str = "body") -> DataFrame:
    """(source_id, text) -> its body lines (source_id, seq, start, text): blank and # lines go, leading time stamps become seconds."""
    lines = df.select("source_id", F.posexplode(F.split(column, "\n")).alias("seq", "line")).withColumn("line", X.clean_ends(F.col("line")))
    kept = lines.filter("line <> '' AND NOT startswith(line, '#')")
    return kept.select("source_id", "seq", seconds_of(F.col("line")).alias("start"), F.regexp_replace("line", _STAMP, "").alias("text"))


def transcript_body(df: DataFrame, column: str = "body") -> DataFrame:
    """One row a source: the body lines joined by blanks."""
    return ordered_text(read_transcript_text(df, column), " ").withColumnRenamed("text", "body")


def ordered_text(rows: DataFrame, separator: str) -> DataFrame:
    """(source_id, text): the texts of a source in order of seq."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return rows.groupBy("source_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"))


def parse_notes(df: DataFrame, column: str = "notes") -> DataFrame:
    """(source_id, Markdown notes) -> sections (source_id, section_no, level, heading, summary, key_points).

    Headings of levels 2 to 6 open a section; under Contents and Executive Summary nothing is read.  Bullets are key points;
    blank lines, emphasis, videos and images are skipped; the rest, joined by blanks, is the summary.
    """
    lines = df.select("source_id", F.posexplode(F.split(column, "\n")).alias("seq", "line"))
    is_head = F.col("line").rlike(r"^#{2,6}[ \t]+")
    lines = lines.withColumn("section_no", F.sum(is_head.cast("int")).over(W.Window.partitionBy("source_id").orderBy("seq")))
    line = X.clean_ends(F.col("line"))
    kind = F.when(is_head, "head").when((line == "") | line.rlike(r"^(\*|<video|!\[)"), "skip").when(line.startswith("- "), "point").otherwise("text")
    lines = lines.filter("section_no > 0").withColumn("kind", kind)
    lines = lines.withColumn("value", F.when(is_head, F.regexp_replace("line", r"^#{2,6}[ \t]+", "")).when(F.col("kind") == "point", F.substring(line, 3, 1 << 20)).otherwise(line))
    pick = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("seq", "value")))), lambda p: p["value"])
    out = lines.groupBy("source_id", "section_no").agg(
        F.max(F.when(is_head, F.length(F.regexp_extract("line", "^(#+)", 1)))).alias("level"),
        X.clean_ends(F.max(F.when(is_head, F.col("value")))).alias("heading"),
        F.array_join(pick("text"), " ").alias("summary"),
        pick("point").alias("key_points"),
    )
    out = out.filter(~F.col("heading").isin("Contents", "Executive Summary"))
    return out.withColumn("section_no", F.row_number().over(W.Window.partitionBy("source_id").orderBy("section_no")) - 1)


def extract_exec_summary(df: DataFrame, column: str = "notes") -> DataFrame:
    """(source_id, executive_summary): what follows that heading, up to a rule or the next heading; empty where there is none."""
    found = F.regexp_extract(column, r"(?s)(?:^|\n)## Executive Summary[ \t]*\n(.*?)(?:\n---\n|\n## |$)", 1)
    return df.select("source_id", X.clean_ends(found).alias("executive_summary"))


def leaf_by_level(sections: DataFrame) -> DataFrame:
    """Sections that no deeper one follows directly; all of a source where that leaves none."""
    next_level = F.lead("level").over(W.Window.partitionBy("source_id").orderBy("section_no"))
    rows = sections.withColumn("_leaf", ~F.coalesce(next_level > F.col("level"), F.lit(False)))
    rows = rows.withColumn("_any", F.max("_leaf").over(W.Window.partitionBy("source_id")))
    return rows.filter("_leaf OR NOT _any").drop("_leaf", "_any")


def normalise_sources(df: DataFrame) -> DataFrame:
    """Source metadata with defaults: id unknown, title Untitled, channel uploader, channel or Unknown, duration 0."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return df.select(
        F.coalesce(F.col("id").cast("string"), F.lit("unknown")).alias("video_id"),
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce(blank("uploader"), blank("channel"), F.lit("Unknown")).alias("channel"),
        F.coalesce(F.col("duration").cast("double"), F.lit(0.0)).alias("duration_seconds"),
        "upload_date",
        F.left(F.coalesce("description", F.lit("")), F.lit(500)).alias("description"),
    )


def scan_library(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, notes) of each notes.md in ``path`` or a folder of it, no deeper, by path; its first line, without its mark, is the title.

    A library without any notes gives no rows.
    """
    root = path.rstrip("/")
    uri = root if "://" in root else f"file://{quote(root)}"
    at = F.concat(F.lit(uri), F.when(F.col("folder") != "", F.concat(F.lit("/"), F.col("folder"))).otherwise(""), F.lit("/notes.md"))
    # Names are brought in order, and files are read in the order of their names, each once.
    of = bundle.folders(spark, root).withColumn("path", at).repartitionByRange(bundle.tasks(spark), "path").sortWithinPartitions("path")
    return library(bundle.contents(of, root, "notes.md").select(at.alias("path"), F.col("content").alias("notes")))


def library(df: DataFrame) -> DataFrame:
    """(path, notes) -> path, title, notes."""
    first = F.regexp_replace(F.substring_index("notes", "\n", 1), "^# ", "")
    return df.select("path", first.alias("title"), "notes")


def find_output(df: DataFrame, keyword: str) -> DataFrame:
    """The first folder, by path, whose name contains ``keyword``."""
    return df.filter(F.contains("path", F.lit(keyword))).orderBy("path").limit(1)


def library_stats(df: DataFrame, frames: DataFrame) -> DataFrame:
    """Of each output: frames, and whether it has a transcript and a viewer.  ``df`` has source_id, transcript_md, viewer."""
    n = frames.groupBy("source_id").agg(F.count("*").alias("n_frames"))
    return df.join(n.hint("shuffle_merge"), "source_id", "left").select("source_id", F.coalesce("n_frames", F.lit(0)).alias("n_frames"), F.coalesce(F.col("transcript_md") != "", F.lit(False)).alias("has_transcript"), F.coalesce(F.col("viewer") != "", F.lit(False)).alias("has_viewer"))


def prefer_origin(rows: DataFrame, prefer_manual: bool = True) -> DataFrame:
    """One transcript a source: captions where preferred and present, else recognised speech, else what there is."""
    order = F.when(F.col("origin") == ("youtube_manual" if prefer_manual else "whisper"), 0).otherwise(1)
    best = F.min(F.struct(order.alias("rank"), "origin")).over(W.Window.partitionBy("source_id"))
    return rows.withColumn("_best", best["origin"]).filter("origin = _best").drop("_best")
