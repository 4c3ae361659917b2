"""Summaries, topic boundaries, section hierarchies and their frames.

Generated fields have deterministic fallbacks, computed here; :func:`chronotext.operators.clean.with_fallback` puts generated
rows in their place.  Sections are adjacency rows: a parent_id, null at the top, to any depth (:mod:`tree`); those built here
have two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from chronotext.functions import text as X
from chronotext.operators import timejoin, tree
from chronotext.operators.chunk import chunk_id


def chunk_fallback(chunks: DataFrame, brief: bool = False) -> DataFrame:
    """A summary of each chunk from its own sentences: heading, main idea, key points, keywords in text order, transition.

    The chunk's chunk_id and cue stand beside it, so that the chunks need not be joined again.  With ``brief`` it has what
    sections are made of: of key points the first one.
    """
    s = F.col("_s")
    points = 1 if brief else 4
    cue = X.has_cue(F.left("text", F.lit(250)))
    rows = chunks.withColumn("_s", X.sentences(F.col("text")))
    some = F.size(s) > 0
    return rows.select(
        "source_id",
        "chunk_no",
        "start",
        "end",
        F.when(some, F.left(F.get(s, F.lit(0)), F.lit(50))).otherwise(F.concat(F.lit("Chunk "), X.format_time(F.col("start")))).alias("heading"),
        F.when(some, F.left(F.array_join(F.slice(s, 1, 2), ". "), F.lit(300))).otherwise(F.left("text", F.lit(300))).alias("main_idea"),
        F.when(some, F.slice(s, 1, points)).otherwise(F.array(F.left("text", F.lit(200)))).alias("key_points"),
        F.slice(X.topic_tokens(F.col("text")), 1, 6).alias("keywords"),
        F.when(cue, "shift").otherwise("continue").alias("transition"),
        "chunk_id",
        cue.alias("cue"),
    )


def section_fallback(chunks: DataFrame) -> DataFrame:
    """One section of each chunk: heading by time, the first two sentences as summary, the next ones as key points."""
    s = F.col("_s")
    body = X.clean_ends(F.col("text"))
    rows = chunks.withColumn("_s", F.when(F.size(X.sentences(F.col("text"))) > 0, X.sentences(F.col("text"))).otherwise(F.array(F.left(body, F.lit(300)))))
    two = F.array_join(F.slice(s, 1, 2), ". ")
    summary = F.when(two.endswith("."), two).otherwise(F.concat(two, F.lit(".")))
    return rows.select("source_id", "chunk_no", F.concat(F.lit("Section at "), X.format_time(F.col("start"))).alias("heading"), F.left(summary, F.lit(500)).alias("summary"), F.slice(s, 2, 4).alias("key_points"))


def boundary_scores(summaries: DataFrame, chunks: DataFrame, obs: DataFrame | None = None, weights: tuple[float, float, float, float] = (0.45, 0.30, 0.10, 0.15), tol: float = 4.0) -> DataFrame:
    """(source_id, chunk_no, boundary_score): how likely a topic ends between this chunk and the next; null for the last chunk.

    ``chunks`` say whether a chunk begins with a cue, unless the summaries do.
    """
    w = W.Window.partitionBy("source_id").orderBy("chunk_no")
    # Words and cues are taken before the join, so no text is shuffled.
    known = ["cue"] if "cue" in summaries.columns else []
    rows = summaries.select("source_id", "chunk_no", "start", "end", "transition", *known, X.summary_tokens(F.col("keywords"), F.col("heading"), F.col("main_idea")).alias("tok"))
    if not known:
        rows = rows.join(chunks.select("source_id", "chunk_no", X.has_cue(F.left("text", F.lit(250))).alias("cue")), ["source_id", "chunk_no"])
    nxt = {f"n_{c}": F.lead(c).over(w) for c in ("tok", "transition", "cue", "start")}
    rows = rows.withColumns(nxt).withColumn("mid", (F.col("end") + F.col("n_start")) / 2)
    cue = F.when(F.col("transition") == "conclusion", 0.6).otherwise(0.0) + F.when(F.col("n_transition") == "shift", 0.8).otherwise(0.0) + F.when(F.col("n_cue"), 0.5).otherwise(0.0)
    gap = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("n_start") - F.col("end")) / 4)
    a, b, c, d = weights
    # What words, cues and gaps are worth is one number before observations come in, so no words go on from here.
    worth = a * (1 - X.jaccard(F.col("tok"), F.col("n_tok"))) + b * F.least(F.lit(1.0), cue) + c * gap
    rows = rows.select("source_id", "chunk_no", "mid", worth.alias("worth"))
    if obs is not None:
        shown = obs.select("source_id", "frame_id", "ts", *(c for c in ("scene_diff", "content_score") if c in obs.columns))
        near = timejoin.nearest(rows.filter("mid IS NOT NULL").select("source_id", "chunk_no", "mid"), shown, "mid", ["chunk_no"], tol).select("source_id", "chunk_no", "near")
        content = F.col("near.content_score") if "content_score" in obs.columns else F.lit(None).cast("double")
        rows = rows.join(near.hint("shuffle_merge"), ["source_id", "chunk_no"], "left").withColumn("visual", F.coalesce(F.nullif(F.col("near.scene_diff"), F.lit(0.0)), F.nullif(content, F.lit(0.0)), F.lit(0.0)))
    else:
        rows = rows.withColumn("visual", F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("worth") + d * F.col("visual")))
    return rows.select("source_id", "chunk_no", F.when(F.col("mid").isNotNull(), score).alias("boundary_score"))


def group_topics(boundaries: DataFrame, max_chunks: int = 4, threshold: float = 0.58) -> DataFrame:
    """``boundaries`` with topic_no and the position in the topic.

    A topic ends at a boundary of at least ``threshold`` or at ``max_chunks``; counting from the last boundary, every
    ``max_chunks`` chunks make a topic, so windows say what a loop would.
    """
    w = W.Window.partitionBy("source_id").orderBy("chunk_no")
    opens = F.coalesce(F.lag("boundary_score").over(w) >= threshold, F.lit(False)).cast("int")
    rows = boundaries.withColumn("_island", F.sum(opens).over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    pos = F.row_number().over(W.Window.partitionBy("source_id", "_island").orderBy("chunk_no")) - 1
    rows = rows.withColumn("_part", F.floor(pos / max_chunks)).withColumn("pos", (pos % max_chunks).cast("int"))
    return rows.withColumn("topic_no", F.dense_rank().over(W.Window.partitionBy("source_id").orderBy("_island", "_part")) - 1).drop("_island", "_part")


def build_topics(grouped: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, topic_no, topic_id, start, end, chunk_ids, boundary_strength); the strength is the score that closed the topic, 0 for the last."""
    rows = grouped.join(chunks.select("source_id", "chunk_no", "chunk_id", "start", "end"), ["source_id", "chunk_no"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_id"))), lambda p: p["chunk_id"])
    out = rows.groupBy("source_id", "topic_no").agg(F.min_by("start", "chunk_no").alias("start"), F.max_by("end", "chunk_no").alias("end"), ids.alias("chunk_ids"), F.max_by(F.coalesce("boundary_score", F.lit(0.0)), "chunk_no").alias("boundary_strength"))
    return out.withColumn("topic_id", chunk_id("topic", F.col("topic_no")))


def partition_topics(grouped: DataFrame, summaries: DataFrame, max_summaries: int = 3) -> DataFrame:
    """``grouped`` with sub_no, the part of its topic that a chunk falls in.

    A part closes at ``max_summaries``, or with two or more chunks at one whose transition is shift or conclusion, unless the
    topic ends there.  Where the last part began depends on all before, so this is a fold over a topic's few chunks.
    """
    rows = grouped.join(summaries.select("source_id", "chunk_no", "transition"), ["source_id", "chunk_no"])
    item = F.struct("chunk_no", F.col("transition").isin("shift", "conclusion").alias("turn"))
    per = rows.groupBy("source_id", "topic_no").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.expr("cast(named_struct('no', 0, 'n', 0, 'out', array()) as struct<no: int, n: int, out: array<struct<chunk_no: int, sub_no: int>>>)")

    def step(s, r):
        n = s["n"] + 1
        close = (n >= max_summaries) | (r["turn"] & (n >= 2))
        out = F.array_append(s["out"], F.struct(r["chunk_no"].cast("int").alias("chunk_no"), s["no"].alias("sub_no")))
        return F.struct(F.when(close, s["no"] + 1).otherwise(s["no"]).alias("no"), F.when(close, 0).otherwise(n).alias("n"), out.alias("out"))

    parts = per.select("source_id", F.explode(F.aggregate("items", start, step)["out"]).alias("p")).select("source_id", "p.chunk_no", "p.sub_no")
    return grouped.join(parts.hint("shuffle_merge"), ["source_id", "chunk_no"])


def _rolled(p: Column) -> list[Column]:
    """The extractive section of summaries in order: times, heading, summary, key points and chunks."""
    first = F.get(p, F.lit(0))
    points = F.flatten(F.transform(F.slice(p, 1, 4), lambda x: x["points"]))
    return [
        first["start"].alias("start"),
        F.element_at(p, -1)["end"].alias("end"),
        first["heading"].alias("heading"),
        F.trim(F.array_join(F.transform(F.slice(p, 1, 2), lambda x: x["main_idea"]), " ")).alias("summary"),
        F.when(F.size(points) > 0, F.slice(points, 1, 5)).otherwise(F.array(first["main_idea"])).alias("key_points"),
        F.transform(p, lambda x: x["chunk_id"]).alias("chunk_ids"),
    ]


def _gathered(grouped: DataFrame, summaries: DataFrame, chunks: DataFrame, *more: str) -> DataFrame:
    """(source_id, topic_no, p): what sections are made of, for each topic in order; of key points a section takes the first of each.

    Ids and times are those of ``chunks``, unless the summaries have a chunk_id.  A chunk's topic stands in front of it as a
    row of its own, so that texts go to their source once and their topics are put together there.
    """
    told = summaries
    if "chunk_id" not in summaries.columns:
        told = summaries.drop("start", "end").join(chunks.select("source_id", "chunk_no", "chunk_id", "start", "end").hint("shuffle_merge"), ["source_id", "chunk_no"])
    told = told.select("source_id", "chunk_no", "chunk_id", "heading", "main_idea", F.slice("key_points", 1, 1).alias("points"), "start", "end")
    texts, of = [c for c in told.columns if c not in ("source_id", "chunk_no")], F.struct("topic_no", *more)
    asked = grouped.select("source_id", "chunk_no", of.alias("_of"), *(F.lit(None).cast(told.schema[c].dataType).alias(c) for c in texts))
    line = told.withColumn("_of", F.lit(None).cast(asked.schema["_of"].dataType)).unionByName(asked).withColumn("_is", F.col("_of").isNull().cast("int"))
    w = W.Window.partitionBy("source_id").orderBy("chunk_no", "_is")
    asks = F.when(F.lag("chunk_no").over(w) == F.col("chunk_no"), F.lag("_of").over(w))
    rows = line.withColumn("_asks", asks).filter("_is = 1 AND _asks IS NOT NULL").select("source_id", "chunk_no", *texts, "_asks.*")
    return rows.groupBy("source_id", "topic_no").agg(F.array_sort(F.collect_list(F.struct("chunk_no", *more, "chunk_id", "heading", "main_idea", "points", "start", "end"))).alias("p"))


def topic_fallback(grouped: DataFrame, summaries: DataFrame, chunks: DataFrame) -> DataFrame:
    """One extractive section a topic: heading of the first summary, first two main ideas, first key point of the first four."""
    return _gathered(grouped, summaries, chunks).select("source_id", "topic_no", F.size("p").alias("n"), *_rolled(F.col("p")))


def build_sections(parts: DataFrame, summaries: DataFrame, chunks: DataFrame, max_summaries: int = 3) -> DataFrame:
    """Section rows (source_id, section_id, parent_id, ord, start, end, heading, summary, key_points, chunk_ids), with the paths of :func:`tree.paths`.

    A topic of at most ``max_summaries`` chunks is one section; a longer one is a parent with its parts below it, rolled up
    from them: the first part's heading, the first two summaries, the first five headings as key points.
    """
    # A topic's few chunks meet once; its sections follow from them where they are.
    per = _gathered(parts, summaries, chunks, "sub_no").withColumn("top_id", chunk_id("section", F.col("topic_no")))
    subs = F.when(F.size("p") > max_summaries, F.array_sort(F.array_distinct(F.transform("p", lambda x: x["sub_no"]))))
    per = per.withColumn("kids", F.transform(subs, lambda k: F.struct(k.alias("sub_no"), F.filter("p", lambda x: x["sub_no"] == k).alias("p"))))
    per = per.withColumn("kids", F.transform("kids", lambda k: F.struct(k["sub_no"].alias("sub_no"), F.struct(*_rolled(k["p"])).alias("s")))).withColumn("whole", F.struct(*_rolled(F.col("p"))))
    topic_no, top_id, whole, kids = (F.col(c) for c in ("topic_no", "top_id", "whole", "kids"))
    fields = ["start", "end", "heading", "summary", "key_points", "chunk_ids"]
    top = [top_id.alias("section_id"), F.lit(None).cast("string").alias("parent_id"), topic_no.cast("long").alias("ord")]
    top_path = F.array(F.struct(topic_no.cast("long").alias("ord"), top_id.alias("id"))).alias("path")
    flat = F.struct(*top, *(whole[f].alias(f) for f in fields), top_path)
    up = {
        "heading": F.get(kids, F.lit(0))["s"]["heading"],
        "summary": F.trim(F.array_join(F.transform(F.slice(kids, 1, 2), lambda k: k["s"]["summary"]), " ")),
        "key_points": F.transform(F.slice(kids, 1, 5), lambda k: k["s"]["heading"]),
    }
    parent = F.struct(*top, *(up.get(f, whole[f]).alias(f) for f in fields), top_path)

    def below(k):
        own, no = F.concat(top_id, F.lit("_"), F.lpad(k["sub_no"].cast("string"), 2, "0")), k["sub_no"].cast("long")
        path = F.array(F.struct(topic_no.cast("long").alias("ord"), top_id.alias("id")), F.struct(no.alias("ord"), own.alias("id")))
        return F.struct(own.alias("section_id"), top_id.alias("parent_id"), no.alias("ord"), *(k["s"][f].alias(f) for f in fields), path.alias("path"))

    rows = per.select("source_id", F.inline(F.when(kids.isNull(), F.array(flat)).otherwise(F.concat(F.array(parent), F.transform(kids, below)))))
    return rows.withColumns({"open_from": F.col("start"), "open_to": F.col("end")})


def leaves(sections: DataFrame) -> DataFrame:
    """Sections without subsections, of any depth, numbered depth first."""
    # Depth first, the first section below another follows it, so one sort tells leaves and numbers them.
    w = W.Window.partitionBy("source_id").orderBy("path")
    out = tree.paths(sections).withColumn("_next", F.lead("parent_id").over(w)).filter(~F.col("_next").eqNullSafe(F.col("section_id"))).drop("_next")
    return out.withColumn("leaf_no", F.row_number().over(w) - 1)


def cut_list(sections: DataFrame) -> DataFrame:
    return leaves(sections).select("source_id", "section_id", "start", "end", (F.col("end") - F.col("start")).alias("duration"))


def section_counts(sections: DataFrame) -> DataFrame:
    return leaves(sections).groupBy("source_id").agg(F.count("*").alias("section_count"))


def exec_fallback(sections: DataFrame) -> DataFrame:
    """(source_id, executive_summary): the number of sections and a line on each leaf."""
    line = F.concat(F.lit("- **"), F.col("heading"), F.lit("** ("), X.format_time(F.col("start")), F.lit("): "), F.left("summary", F.lit(120)))
    # A section's line is made before leaves are told, so no longer texts move.
    rows = leaves(tree.paths(sections).withColumn("_line", line)).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("leaf_no", "_line"))).alias("l"), F.count("*").alias("n"))
    head = F.concat(F.lit("This video covers "), F.col("n").cast("string"), F.lit(" sections:\n"))
    return rows.select("source_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["_line"]), "\n")).alias("executive_summary"))


def exec_assembly(df: DataFrame) -> DataFrame:
    """(source_id, summary, highlights array) -> one text with the highlights as bullets."""
    bullets = F.array_join(F.transform("highlights", lambda h: F.concat(F.lit("- "), h)), "\n")
    return df.select("source_id", F.when(F.size("highlights") > 0, F.concat_ws("\n", "summary", F.lit(""), F.lit("**Key highlights:**"), bullets)).otherwise(F.col("summary")).alias("executive_summary"))


def neighbour_context(chunks: DataFrame) -> DataFrame:
    """(source_id, chunk_no, context): the chunks before and after, each cut to 180 characters, on lines of their own."""
    w = W.Window.partitionBy("source_id").orderBy("chunk_no")
    line = lambda name, c: F.concat(F.lit(name), X.compact(c))
    before, after = F.lag("text").over(w), F.lead("text").over(w)
    rows = chunks.withColumn("_b", before).withColumn("_a", after)
    return rows.select("source_id", "chunk_no", F.concat_ws("\n", F.when(F.col("_b").isNotNull(), line("Before: ", F.col("_b"))), F.when(F.col("_a").isNotNull(), line("After: ", F.col("_a")))).alias("context"))


def topic_context(grouped: DataFrame, summaries: DataFrame) -> DataFrame:
    """(source_id, topic_no, context): a topic's first three headings, the last summary before it and the first one after it, on lines of their own."""
    line = X.outline(F.col("start"), F.col("end"), F.col("heading"), F.col("main_idea"), F.col("key_points"), F.col("keywords"), F.col("transition"))
    rows = grouped.select("source_id", "chunk_no", "topic_no").join(summaries.select("source_id", "chunk_no", "heading").hint("shuffle_merge"), ["source_id", "chunk_no"])
    heads = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("chunk_no", "heading"))), 1, 3), lambda x: x["heading"])
    per = rows.groupBy("source_id", "topic_no").agg(F.min("chunk_no").alias("_first"), F.max("chunk_no").alias("_last"), heads.alias("_heads"))
    w = W.Window.partitionBy("source_id").orderBy("topic_no")
    # Numbers tell which summary a topic needs from either side; its line then goes to that topic alone.
    asked = per.select("source_id", "topic_no", F.lag("_last").over(w).alias("_b"), F.lead("_first").over(w).alias("_a"))
    asked = asked.select("source_id", "topic_no", F.posexplode(F.array("_b", "_a")).alias("_side", "chunk_no")).filter("chunk_no IS NOT NULL")
    told = asked.join(summaries.select("source_id", "chunk_no", line.alias("_line")).hint("shuffle_merge"), ["source_id", "chunk_no"])
    told = told.groupBy("source_id", "topic_no").agg(*(F.max(F.when(F.col("_side") == k, F.col("_line"))).alias(c) for k, c in enumerate(("_before", "_after"))))
    per = per.join(told.hint("shuffle_merge"), ["source_id", "topic_no"], "left")
    # A part that is null leaves no line.
    parts = [F.concat(F.lit("Focus: "), F.array_join("_heads", " | ")), F.concat(F.lit("Before: "), F.col("_before")), F.concat(F.lit("After: "), F.col("_after"))]
    return per.select("source_id", "topic_no", F.concat_ws("\n", *parts).alias("context"))


def candidates(sections: DataFrame, obs: DataFrame, most: int = 4, pad: float = 3.0, spacing: float = 4.0) -> DataFrame:
    """(source_id, section_id, pick_no, frame_id, ts, score): diverse observations of each section.

    Evenly spaced anchors each take their best observation within reach that is ``spacing`` away from those taken; what is
    missing comes from the rest by distance to an anchor; where nothing fits, the best scored are taken.
    """
    sec = sections.select("source_id", "section_id", "start", "end")
    near = timejoin.within(sec, obs.select("source_id", "frame_id", "ts", "scene_diff", "content_score"), pad)
    mid, dur = (F.col("start") + F.col("end")) / 2, F.greatest(F.lit(1.0), F.col("end") - F.col("start"))
    prox = 1 - F.least(F.lit(1.0), F.abs(F.col("ts") - mid) / F.greatest(F.lit(1.0), (F.col("end") - F.col("start")) / 2 + 2))
    near = near.withColumn("score", F.coalesce("content_score", F.lit(0.0)) * 0.55 + F.coalesce("scene_diff", F.lit(0.0)) * 0.20 + prox * 0.25)
    one = F.struct((-F.col("score")).alias("neg"), "ts", "frame_id")
    rows = near.groupBy("source_id", "section_id", "start", "end").agg(F.array_sort(F.collect_list(one)).alias("f"))
    a = F.least(F.lit(most), F.size("f"))
    anchors = F.when(a == 1, F.array(mid)).otherwise(F.transform(F.sequence(F.lit(0), a - 1), lambda i: F.col("start") + dur * i / (a - 1)))
    rows = rows.withColumn("anchors", anchors).withColumn("reach", F.greatest(F.lit(4.0), dur / (F.size(anchors) * 2)))
    kind = rows.schema["f"].dataType.simpleString()
    free = lambda got, x: ~F.exists(got, lambda y: F.abs(x["ts"] - y["ts"]) < spacing)

    def take(got, anchor):
        first = F.get(F.filter("f", lambda x: (F.abs(x["ts"] - anchor) <= F.col("reach")) & free(got, x)), F.lit(0))
        return F.when(first.isNotNull() & (F.size(got) < most), F.array_append(got, first)).otherwise(got)

    rows = rows.withColumn("got", F.aggregate("anchors", F.expr(f"cast(array() as {kind})"), take))
    by_anchor = F.array_sort(F.transform("f", lambda x: F.struct(F.array_min(F.transform("anchors", lambda q: F.abs(x["ts"] - q))).alias("d"), x.alias("x"))))
    rows = rows.withColumn("rest", F.transform(by_anchor, lambda y: y["x"]))
    rows = rows.withColumn("got", F.aggregate("rest", F.col("got"), lambda got, x: F.when((F.size(got) < most) & free(got, x), F.array_append(got, x)).otherwise(got)))
    got = F.when(F.size("got") > 0, F.col("got")).otherwise(F.slice("f", 1, most))
    return rows.select("source_id", "section_id", F.posexplode(got).alias("pick_no", "x")).select("source_id", "section_id", "pick_no", "x.frame_id", "x.ts", (-F.col("x.neg")).alias("score"))


def section_frames(picked: DataFrame, ranked: DataFrame | None = None, keep: int = 2) -> DataFrame:
    """The frames a section keeps, in time order: the first ``keep`` of the ranking given for it, else of the candidates' own order.

    ``ranked`` (source_id, section_id, ids array) holds names like ``frame_0`` in ranked order; unknown names are skipped.
    """
    rows = picked.withColumn("_rank", F.col("pick_no"))
    if ranked is not None:
        r = ranked.select("source_id", "section_id", F.posexplode("ids").alias("_pos", "_id"))
        r = r.groupBy("source_id", "section_id", "_id").agg(F.min("_pos").alias("_pos"))
        hits = picked.withColumn("_id", F.concat(F.lit("frame_"), F.col("pick_no").cast("string"))).join(r.hint("shuffle_merge"), ["source_id", "section_id", "_id"]).drop("_id")
        own = rows.join(hits.select("source_id", "section_id").distinct().hint("shuffle_merge"), ["source_id", "section_id"], "left_anti")
        rows = own.unionByName(hits.withColumnRenamed("_pos", "_rank"))
    best = W.Window.partitionBy("source_id", "section_id").orderBy("_rank")
    line = W.Window.partitionBy("source_id", "section_id").orderBy("ts", "frame_id")
    return rows.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= keep).drop("_r", "_rank").withColumn("frame_no", F.row_number().over(line) - 1)


def child_rollup(kids: DataFrame) -> DataFrame:
    """(source_id, parent_id, heading, summary, key_points) rolled up from subsections (ord, heading, summary)."""
    up = F.array_sort(F.collect_list(F.struct("ord", "heading", "summary")))
    rows = kids.groupBy("source_id", "parent_id").agg(up.alias("u"))
    two: Column = F.trim(F.array_join(F.transform(F.slice("u", 1, 2), lambda x: x["summary"]), " "))
    return rows.select("source_id", "parent_id", F.get("u", F.lit(0))["heading"].alias("heading"), two.alias("summary"), F.transform(F.slice("u", 1, 5), lambda x: x["heading"]).alias("key_points"))
