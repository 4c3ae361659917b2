"""Prompt tables, the seam to a model, and what is mined from its answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from chronotext.functions import text as X
from chronotext.functions.objects import objects

RECORD_DDL = "heading string, summary string, main_idea string, key_points array<string>, keywords array<string>, transition string, executive_summary string, highlights array<string>"


def strip_reasoning(text: Column) -> Column:
    """Without thinking blocks and a leading paragraph of reasoning or thoughts.  The patterns are fixed values."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?is)^reasoning\s*:.*?(?:\n\s*\n|$)", "")
    return X.clean_ends(F.regexp_replace(out, r"(?is)^thoughts?\s*:.*?(?:\n\s*\n|$)", ""))


def _unfenced(text: Column) -> Column:
    return X.clean_ends(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))


def mine_records(resp: DataFrame, column: str = "body") -> DataFrame:
    """``resp`` with record (JSON text) and rule: 1 the whole answer, 2 the first flat object with a heading, 3 the first flat object, 0 none.

    The two patterns of flat objects are fixed values.
    """
    body = _unfenced(strip_reasoning(F.col(column)))
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), c)
    heading = F.nullif(F.regexp_extract(body, r'(\{[^{}]*"heading"[^{}]*\})', 1), F.lit(""))
    any_one = F.nullif(F.regexp_extract(body, r"(\{[^{}]+\})", 1), F.lit(""))
    found = [(1, ok(body)), (2, ok(heading)), (3, ok(any_one))]
    rule = F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for k, c in found), F.lit(0))
    return resp.withColumn("record", F.coalesce(*(c for _, c in found))).withColumn("rule", rule)


def typed_records(mined: DataFrame) -> DataFrame:
    """``mined`` with the record's fields as columns; fields of another type are null."""
    return mined.withColumn("r", F.from_json("record", RECORD_DDL)).select("*", "r.*").drop("r")


def json_objects(resp: DataFrame, column: str = "body") -> DataFrame:
    """All top-level JSON objects of each answer, in order, as rows (…, object_no, object), of any depth; balanced text that is no JSON is left out."""
    found = F.filter(objects(F.col(column)), lambda o: F.try_parse_json(o).isNotNull())
    return resp.select("*", F.posexplode(found).alias("object_no", "object"))


def answer_from_trace(resp: DataFrame, key: list[str], column: str = "body") -> DataFrame:
    """(key, answer, rule): the answer in a reasoning trace.

    5 the largest object with a heading or summary; 4 else the last with a numeric score; 3 else the last object; 2 else a
    score in words and 1 else a bare number from 0 to 1 near the end, either as an object; 0 else the last line that is not
    blank.  Of equally large objects the first is taken.  The two patterns of numbers are fixed values.
    """
    found = json_objects(resp, column).filter(~F.col("object").rlike(r"^\{\s*\}$"))
    has = lambda k: F.array_contains(F.json_object_keys("object"), k)
    number = F.expr("schema_of_variant(try_variant_get(try_parse_json(object), '$.score', 'variant'))").rlike("^(BIGINT|DECIMAL|DOUBLE)")
    rank = F.when(has("heading") | has("summary"), 5).when(number, 4).otherwise(3)
    size = F.when(rank == 5, F.length("object")).otherwise(0)
    order = F.when(rank == 5, -F.col("object_no")).otherwise(F.col("object_no"))
    best = found.groupBy(*key).agg(F.max_by(F.struct("object", rank.alias("rank")), F.struct(rank, size, order)).alias("b"))
    text = F.coalesce(F.col(column), F.lit(""))
    score = F.nullif(F.regexp_extract(text, r"[Ss]core[:\s=]+([0-9]+\.?[0-9]*)", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(F.right(text, F.lit(200)), r"(?:^|[^\p{L}\p{N}_])(0\.[0-9]+|1\.0)(?:$|[^\p{L}\p{N}_])", 1), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), X.clean_ends), lambda s: s != "")
    last = F.coalesce(F.get(lines, F.size(lines) - 1), F.lit(""))
    rows = resp.join(best.hint("shuffle_merge"), key, "left")
    said = F.coalesce(score, bare)
    answer = F.coalesce(F.col("b.object"), F.when(said.isNotNull(), F.concat(F.lit('{"score": '), said, F.lit("}"))), last)
    return rows.select(*key, answer.alias("answer"), F.coalesce(F.col("b.rank"), F.when(score.isNotNull(), 2), F.when(bare.isNotNull(), 1), F.lit(0)).alias("rule"))


def rule_report(mined: DataFrame) -> DataFrame:
    return mined.groupBy("rule").agg(F.count("*").alias("n"))


def history(turns: DataFrame, n: int = 8) -> DataFrame:
    """(conv_id, history): the last ``n`` turns as lines, blank ones skipped; roles other than user count as the assistant."""
    last = W.Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = turns.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n)
    who = F.when(F.lower(F.trim(F.coalesce("role", F.lit("user")))) == "user", "User: ").otherwise("Assistant: ")
    said = X.clean_ends(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("_l", F.when(said != "", F.concat(who, said)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "_l"))), lambda x: x["_l"])
    return rows.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("history"))


def context_length(texts: DataFrame, turns: DataFrame, drafts: DataFrame) -> DataFrame:
    """(conv_id, context_length): characters of the transcript, the turns and the draft."""
    t = texts.groupBy("conv_id").agg(F.sum(F.length("text")).alias("t"))
    h = turns.groupBy("conv_id").agg(F.sum(F.length("text")).alias("h"))
    rows = drafts.join(t.hint("shuffle_merge"), "conv_id", "left").join(h.hint("shuffle_merge"), "conv_id", "left")
    return rows.select("conv_id", (F.coalesce("t", F.lit(0)) + F.coalesce("h", F.lit(0)) + F.length(F.coalesce("draft", F.lit("")))).alias("context_length"))


def scoring_prompts(chunks: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Rate from 0 to 1 how much this passage matters to someone learning the subject. Answer with the number.\n\n"), F.left("text", F.lit(800)))
    return chunks.select("source_id", "chunk_no", F.lit("score").alias("kind"), text.alias("prompt"))


def chunk_prompts(chunks: DataFrame, context: DataFrame, style: str = "well_explained") -> DataFrame:
    """Prompts for chunk summaries, with what comes before and after."""
    rows = chunks.join(context, ["source_id", "chunk_no"], "left")
    ask = F.lit("Summarise this passage as JSON with heading, main_idea, key_points, keywords and transition (continue, shift or conclusion).\n")
    return rows.select("source_id", "chunk_no", F.lit("chunk").alias("kind"), F.concat(ask, X.style_guidance(F.lit(style)), F.lit("\n"), F.coalesce("context", F.lit("")), F.lit("\n\n"), F.left("text", F.lit(3000))).alias("prompt"))


def _span(start: str, end: str) -> Column:
    return F.concat(F.lit("["), X.format_time(F.col(start)), F.lit("-"), X.format_time(F.col(end)), F.lit("]"))


def _section_ask(kind: str, style: str, context: Column, outline: Column) -> list[Column]:
    """kind and prompt of a section: what to write, in which style, between which neighbours, from which outline."""
    ask = F.lit("Write a section as JSON with heading, summary and key_points from this outline.\n" if kind != "parent" else "Write the overview of a topic as JSON with heading, summary and key_points; introduce its parts without repeating them.\n")
    around = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\n"), context)).otherwise("")
    return [F.lit(kind).alias("kind"), F.concat(ask, X.style_guidance(F.lit(style)), around, F.lit("\n\n"), outline).alias("prompt")]


def topic_prompts(sections: DataFrame, style: str = "well_explained", context: DataFrame | None = None) -> DataFrame:
    """Prompts for sections from their outline; ``context`` (source_id, topic_no, context) is that of top-level sections, whose ord is the topic."""
    rows = sections.withColumn("_top", F.when(F.col("parent_id").isNull(), F.col("ord"))) if context is not None else sections.withColumn("context", F.lit(None).cast("string"))
    if context is not None:
        rows = rows.join(context.withColumnRenamed("topic_no", "_top").hint("shuffle_merge"), ["source_id", "_top"], "left")
    outline = F.concat(_span("start", "end"), F.lit(" "), F.col("heading"), F.lit(": "), F.col("summary"))
    return rows.select("source_id", "section_id", *_section_ask("topic", style, F.col("context"), outline))


def leaf_prompts(chunks: DataFrame, context: DataFrame, style: str = "well_explained") -> DataFrame:
    """(source_id, chunk_no, kind, prompt) for sections of one chunk, from its text and its neighbours (:func:`topics.neighbour_context`)."""
    rows = chunks.join(context, ["source_id", "chunk_no"], "left")
    outline = F.concat(_span("start", "end"), F.lit("\n- ["), X.format_time(F.col("start")), F.lit("] "), F.left("text", F.lit(2500)))
    return rows.select("source_id", "chunk_no", *_section_ask("leaf", style, F.col("context"), outline))


def parent_prompts(sections: DataFrame, context: DataFrame, style: str = "well_explained") -> DataFrame:
    """(source_id, section_id, kind, prompt) for sections with subsections, from these and the topic's neighbours (:func:`topics.topic_context`)."""
    line = F.concat(F.lit("- "), _span("start", "end"), F.lit(" "), F.col("heading"), F.lit(": "), F.col("summary"))
    kids = sections.filter("parent_id IS NOT NULL").withColumn("_line", line)
    kids = kids.groupBy("source_id", F.col("parent_id").alias("section_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_line"))), lambda x: x["_line"]), "\n").alias("_kids"))
    rows = sections.filter("parent_id IS NULL").join(kids.hint("shuffle_merge"), ["source_id", "section_id"])
    rows = rows.join(context.withColumnRenamed("topic_no", "ord").hint("shuffle_merge"), ["source_id", "ord"], "left")
    return rows.select("source_id", "section_id", *_section_ask("parent", style, F.col("context"), F.concat(_span("start", "end"), F.lit("\n"), F.col("_kids"))))


def ranked_ids(resp: DataFrame, key: list[str], column: str = "body") -> DataFrame:
    """(key, ids): the names that an answer ranks, best first: ranked_ids of the JSON object between its first and last brace.

    Answers without such an object, or whose ranked_ids is no list of texts, rank nothing; which names are known is for the
    join that uses them (:func:`topics.section_frames`) to say.
    """
    found = F.get_json_object(F.regexp_extract(F.coalesce(column, F.lit("")), r"(?s)\{.*\}", 0), "$.ranked_ids")
    ids = F.from_json(F.when(found.startswith("["), found), "array<string>")
    return resp.select(*key, F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("ids"))


def exec_prompts(outlines: DataFrame) -> DataFrame:
    """(source_id, executive_summary) -> prompts for the executive summary."""
    ask = F.lit("Write an executive summary as JSON with executive_summary and highlights from these sections.\n\n")
    return outlines.select("source_id", F.lit("executive").alias("kind"), F.concat(ask, F.col("executive_summary")).alias("prompt"))


def rank_prompts(sections: DataFrame, picked: DataFrame, keep: int = 2) -> DataFrame:
    """Prompts that ask for the best frames of a section; at most four key points are quoted."""
    names = F.transform(F.array_sort(F.collect_list("pick_no")), lambda i: F.concat(F.lit("frame_"), i.cast("string")))
    shots = picked.groupBy("source_id", "section_id").agg(F.array_join(names, ", ").alias("names"))
    rows = sections.join(shots, ["source_id", "section_id"])
    return rows.select("source_id", "section_id", F.lit("rank").alias("kind"), F.concat(F.lit(f"Name the {keep} frames that best show this section, best first.\n"), F.col("heading"), F.lit("\n"), F.array_join(F.slice("key_points", 1, 4), "\n"), F.lit("\n"), F.col("names")).alias("prompt"))


def chat_prompts(questions: DataFrame, texts: DataFrame, past: DataFrame) -> DataFrame:
    """Prompts for questions (conv_id, source_id, question) about a transcript, with the recent turns."""
    rows = questions.join(texts.hint("shuffle_merge"), "source_id", "left").join(past.hint("shuffle_merge"), "conv_id", "left")
    return rows.select("conv_id", F.lit("chat").alias("kind"), F.concat_ws("\n\n", F.lit("Answer from this transcript; say so where it does not suffice."), F.coalesce("full_text", F.lit("")), F.nullif(F.coalesce("history", F.lit("")), F.lit("")), F.col("question")).alias("prompt"))


def infer(prompts: DataFrame, fn: Callable[[list[str]], list[str]], partitions: int | None = None) -> DataFrame:
    """``prompts`` with body and error: ``fn`` answers a batch of prompts; a batch that fails is tried again row by row, so one bad row costs only itself."""
    df = prompts.repartition(partitions) if partitions else prompts
    schema = df.withColumn("body", F.lit("")).withColumn("error", F.lit("")).schema
    schema["body"].nullable = schema["error"].nullable = True

    def run(batches):
        for pdf in batches:
            asked = pdf["prompt"].tolist()
            try:
                body, error = list(fn(asked)), [None] * len(asked)
            except Exception:  # noqa: BLE001 - any failure of the user's model becomes an error row
                body, error = [], []
                for p in asked:
                    try:
                        body.append(fn([p])[0])
                        error.append(None)
                    except Exception as e:  # noqa: BLE001
                        body.append(None)
                        error.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(body=pd.Series(body, dtype=object, index=pdf.index), error=pd.Series(error, dtype=object, index=pdf.index))

    return df.mapInPandas(run, schema)
