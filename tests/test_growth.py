"""What grows with the data: ties between segments, how often texts are shuffled, and files that no one lists at once."""

import os
import re
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from chronotext.operators import docs, timejoin, topics, tree
from chronotext.plans import queries
from chronotext.sources import bundle, readers
from chronotext.streaming import tracking


def test_neighbours_take_the_first_of_equally_near_segments(spark):
    # Halfway between two midpoints, but in doubles the second one is a trace nearer.
    rows, at = [], []
    for k in range(2000):
        a, b = 0.1 + k * 0.37, 0.5 + k * 0.41
        if (t := (a + b) / 2) - a > b - t:
            rows += [(k, 0, a, a), (k, 1, b, b)]
            at.append((k, k, t))
    assert len(at) > 100
    seg = spark.createDataFrame(rows, "source_id long, seq int, start double, end double")
    pos = spark.createDataFrame(at, "source_id long, p long, t double")
    got = timejoin.centred(pos, timejoin.numbered(seg))
    assert got.count() == len(at) and got.filter("_centre <> 1").count() == 0
    assert timejoin.neighbours(pos, seg).groupBy("p").agg(F.count("*").alias("n")).filter("n <> 2").count() == 0


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    df = spark.createDataFrame([(k, f"T {k}", "c" if k % 2 else None) for k in range(300)], "source_id long, title string, channel string").repartition(3)
    path = str(tmp_path / "bundle")
    docs.write_bundle(df, path)
    docs.write_bundle(df.filter("source_id = 7").withColumn("channel", F.lit("new")), path)
    read = bundle.read_bundle(spark, path, "source_id long, title string, channel string")
    assert read.inputFiles() == [] and sorted(os.listdir(path))[0] == "out_key=T_0_0" and len(os.listdir(path)) == 300
    assert {(r.source_id, r.out_key, r.channel) for r in read.collect()} == {(k, f"T_{k}_{k}", "new" if k == 7 else "c" if k % 2 else None) for k in range(300)}
    assert read.count() == spark.read.parquet(path).count() == 300
    path = str(tmp_path / "library")
    bundle.write_documents(df.withColumns({"notes_md": F.concat(F.lit("# é "), "title"), "transcript_txt": F.lit("x\n")}), path)
    files = bundle.read_documents(spark, path)
    assert files.inputFiles() == [] and sorted((r.folder, r.file, r.content) for r in files.collect()) == sorted(x for k in range(300) for x in ((f"T_{k}_{k}", "notes.md", f"# é T {k}"), (f"T_{k}_{k}", "transcript.txt", "x\n")))
    library = readers.scan_library(spark, path)
    assert library.inputFiles() == [] and (at := [r.path for r in library.collect()]) == sorted(at) and len(at) == 300


def test_sections_from_briefs_need_no_chunks_and_move_no_words(spark):
    rows = [(1, k, f"chunk_{k:04d}", f"{'Now' if k % 3 == 0 else 'Then'} we say {'alpha beta' if k < 4 else 'gamma delta'} {k}. Second one {k}. Third {k}.", 10.0 * k, 10.0 * k + 9) for k in range(12)]
    chunks = spark.createDataFrame(rows, "source_id long, chunk_no int, chunk_id string, text string, start double, end double")
    obs = spark.createDataFrame([(1, k, 9.5 + 10 * k, 0.5, f"f{k}") for k in range(0, 12, 2)], "source_id long, frame_id long, ts double, scene_diff double, path string")
    whole, brief = topics.chunk_fallback(chunks), topics.chunk_fallback(chunks, brief=True)
    assert brief.filter("size(key_points) <> 1").count() == 0

    def made(summaries, of):
        bounds = topics.boundary_scores(summaries, of, obs)
        parts = topics.partition_topics(topics.group_topics(bounds), summaries)
        return bounds, topics.build_sections(parts, summaries, of)

    (a, b), (c, d) = made(whole, chunks), made(brief, None)
    assert a.filter("boundary_score > 0").count() > 5 and sorted(a.collect()) == sorted(c.collect())
    assert sorted(map(str, b.collect())) == sorted(map(str, d.collect()))
    # Below the join with observations is one number a chunk, and of observations only what is asked for.
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert " AS worth#" in plan.splitlines()[2] and "path, path" not in plan


def test_topic_context_sends_each_summary_to_the_topic_that_asks_for_it(spark):
    summaries = spark.createDataFrame([(1, k, float(k), k + 1.0, f"H{k}", f"idea {k}", [f"p{k}"], [f"k{k}"], "continue") for k in range(6)], "source_id long, chunk_no int, start double, end double, heading string, main_idea string, key_points array<string>, keywords array<string>, transition string")
    grouped = spark.createDataFrame([(1, k, t) for k, t in enumerate((0, 0, 1, 2, 2, 2))], "source_id long, chunk_no int, topic_no int")
    got = topics.topic_context(grouped, summaries)
    said = {r.topic_no: [x.split(" | Points")[0] for x in r.context.split("\n")] for r in got.collect()}
    assert said == {0: ["Focus: H0 | H1", "After: [00:02-00:03] H2: idea 2"], 1: ["Focus: H2", "Before: [00:01-00:02] H1: idea 1", "After: [00:03-00:04] H3: idea 3"], 2: ["Focus: H3 | H4 | H5", "Before: [00:02-00:03] H2: idea 2"]}
    # Windows over a source pass numbers, no lines.
    assert not any("main_idea" in x or "_line" in x for x in got._jdf.queryExecution().analyzed().toString().splitlines() if "Window [" in x)


def test_outlines_and_notes_move_the_texts_of_sections_once(spark):
    rows = [(s, k, f"chunk_{k:04d}", f"Say {k}. Second one {k}. Third {k}.", 10.0 * k, 10.0 * k + 9) for s, n in ((1, 15), (2, 1), (3, 6)) for k in range(n)]
    chunks = spark.createDataFrame(rows, "source_id long, chunk_no int, chunk_id string, text string, start double, end double")
    outline = queries._outline(SimpleNamespace(summaries=topics.chunk_fallback(chunks)))
    # The paths are those that joins level by level would find, without a join.
    assert sorted(map(str, outline.collect())) == sorted(map(str, tree.paths(outline.drop("path", "open_from", "open_to")).select(*outline.columns).collect()))
    assert outline.filter("source_id = 1").count() == 15 + 5 + 3 and outline.filter("source_id = 1").agg(F.max(F.size("path"))).first()[0] == 3
    plan = outline._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    meta = spark.createDataFrame([(1, "T", "C", 9.0, None, "v")], "source_id long, title string, channel string, duration_seconds double, upload_date string, video_id string")
    kept = outline.select("source_id", "section_id", F.lit(1).cast("long").alias("frame_id"), F.col("start").alias("ts"), F.lit("f").alias("path"))
    notes = docs.notes_md(meta, outline, topics.exec_fallback(outline), docs.slot_frames(outline, kept))
    assert notes.first().notes_md.count("![Frame at ") == 23
    joins = [x for x in notes._jdf.queryExecution().analyzed().toString().splitlines() if "Join" in x and "section_id" in x]
    joined = notes._jdf.queryExecution().optimizedPlan().toString()
    assert len(joins) == 2 and "summary" not in "".join(x for x in joined.splitlines() if "Join" in x)


def test_captions_send_lines_to_their_source_once(spark):
    said = ["One fish here. Two fish there. ", "Red fish\nand blue. Some fish swim! ", " ", "Old fish rest now. New fish Swim. Fish one fish two", "Nothing to see", "Last words are said. Red fish two"]
    seg = spark.createDataFrame([(s, k, 10.0 * k, 10.0 * k + 8, t) for s in (1, 2) for k, t in enumerate(said)], "source_id long, seq int, start double, end double, text string")
    asked = spark.createDataFrame([(1, 0), (1, 4), (2, 2)], "source_id long, seq int")
    got = {(r.source_id, r.seq): [x.text for x in r.w] for r in timejoin.beside(asked, seg, ["text"]).collect()}
    assert got == {(1, 0): said[:4], (1, 4): said[1:], (2, 2): said}
    # Against every sentence and line, for frames in, near and years away from the transcript, where rounding makes ties.
    at = [-3.0, 4.0, 21.0, 39.5, 54.0, 9e8, 4e9]
    obs = spark.createDataFrame([(1, k, t) for k, t in enumerate(at)], "source_id long, frame_id long, ts double")
    shown = {r.frame_id: r.caption for r in docs.captions(obs, seg).collect()}
    for k, t in enumerate(at):
        c = min(range(6), key=lambda j: (abs(10.0 * j + 4 - t), j))
        near = [(10.0 * j + 4, said[j].replace("\n", " ").strip()) for j in range(max(0, c - 3), min(6, c + 4)) if said[j].strip()]
        cut = [x for x in re.sub(r"([.!?]) +([A-Z])", "\\1\u0001\\2", " ".join(x for _, x in near)).split("\u0001") if len(x) > 10]
        worth = lambda s: round(max(len(set(s.lower().split()) & set(x.lower().split())) / (1 + abs(m - t)) for m, x in near), 9)  # noqa: B023, E731
        best = sorted(range(len(cut)), key=lambda i: (-worth(cut[i]), i))[:2]
        two = " ".join(cut[i] for i in best)
        assert shown[k] == (two if two[-1] in ".!?" else two + "."), (k, t)


def test_playback_state_lies_in_buckets(spark, tmp_path):
    ddl = "viewer long, source_id long, event_time timestamp, t double, section_id string, line_seq int"
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    # Viewers 0 to 29 of two sources, then half of them again, then one whose time leaves the others behind, then one of those.
    rows = [[(v, s, at(v + k), float(k), None if k == 3 else f"s{k // 2}", None if k == 4 else v) for v in range(30) for s in (1, 2) for k in range(5)]]
    rows += [[(v, 1, at(100 + v), 9.0, "s2", None) for v in range(15)] + [(99, 9, at(9000), 0.0, None, None)], [(99, 9, at(9100), 0.0, None, 5)], [(3, 1, at(9200), 0.0, "s2", None), (99, 9, at(9200), 1.0, None, 5)]]
    for k, of in enumerate(rows):
        spark.createDataFrame(of, ddl).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
        os.utime(next(f"{tmp_path}/in/b{k}/{f}" for f in os.listdir(f"{tmp_path}/in/b{k}") if f.endswith(".parquet")), (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = tracking.track_positions(stream, "0 seconds", 1_000_000, buckets=4).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(300)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(kept) <= 4 and query.exception() is None
    want, last = [], {}
    for k, of in enumerate(rows):
        if k == 3:
            last = {w: x for w, x in last.items() if w == (99, 9)}
        for v, s, when, _, section, line in sorted(of, key=lambda r: (r[2], r[3])):
            if (section, line) != last.get((v, s), (None, None)):
                want.append((v, s, when, section, line))
            last[v, s] = (section, line)
    assert len(want) > 200 and sorted(map(str, map(tuple, spark.table("changes").collect()))) == sorted(map(str, want))


def test_chunks_meet_their_topics_without_a_join_and_texts_are_counted_once(spark):
    rows = [(s, k, f"chunk_{k:04d}", f"Say {s} {k}. Second one.", 10.0 * k, 10.0 * k + 9) for s in (1, 2) for k in range(7)]
    chunks = spark.createDataFrame(rows, "source_id long, chunk_no int, chunk_id string, text string, start double, end double")
    grouped = spark.createDataFrame([(s, k, k // 3) for s in (1, 2) for k in range(7) if (s, k) != (2, 4)], "source_id long, chunk_no int, topic_no int")
    summaries = topics.chunk_fallback(chunks)
    made = topics.topic_fallback(grouped, summaries, chunks)
    got = {(r.source_id, r.topic_no): (r.start, r.end, r.heading, r.chunk_ids) for r in made.collect()}
    want = {(s, t): [k for k in range(7) if k // 3 == t and (s, k) != (2, 4)] for s in (1, 2) for t in range(3)}
    assert got == {(s, t): (10.0 * k[0], 10.0 * k[-1] + 9, f"Say {s} {k[0]}.", [f"chunk_{x:04d}" for x in k]) for (s, t), k in want.items()}
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    plain = topics.topic_fallback(grouped, summaries.drop("chunk_id", "cue"), chunks)
    assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))
