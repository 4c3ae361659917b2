"""Small facts about operators that no SQL check covers, and invariants of those that depend on earlier decisions."""

import random

import pytest
from pyspark.sql import functions as F

from chronotext.functions import text as X
from chronotext.operators import chunk, clean, docs, infer, sample, score, timejoin, topics
from chronotext.sources import readers
from chronotext.streaming import tracking


def seg(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "source_id long, seq int, start double, end double, text string")


def test_alignment(spark):
    got = clean.align(seg(spark, [(0.0, 5.0, " a  b "), (6.0, 10.0, "[Music]"), (6.5, 8.0, "c"), (20.0, 25.0, "d"), (30.0, 31.0, "  ")])).orderBy("start").collect()
    assert [(r.text, r.end) for r in got] == [("a b", 6.5), ("c", 8.0), ("d", 25.0)]
    bad = seg(spark, [(5.0, 1.0, "x")])
    assert not clean.validate_bounds(bad).first().is_valid
    with pytest.raises(Exception, match="out of bounds"):
        clean.validate_bounds(bad, strict=True).collect()


def test_chunks(spark):
    rows = seg(spark, [(float(i), i + 1.0, "w " * 7 + ("end." if i % 3 == 2 else "go")) for i in range(40)])
    tokens = chunk.chunk_tokens(rows, 20, 8).orderBy("chunk_no").collect()
    assert all(r.token_count <= 20 for r in tokens) and {i for r in tokens for i in r.segment_indices} == set(range(40))
    by_sentence = chunk.chunk_sentences(rows, 40, 8).orderBy("chunk_no").collect()
    assert {i for r in by_sentence for i in r.segment_indices} == set(range(40))
    assert all(r.text.endswith("end.") for r in by_sentence[:-1])
    plain = chunk.chunk_sentences(seg(spark, [(float(i), i + 1.0, "a b c d") for i in range(12)]), 10, 4).collect()
    assert all(r.token_count <= 10 for r in plain)
    assert chunk.chunk_tokens(rows.limit(0)).count() == 0
    # A text that is null has no tokens and leaves no gap in the joined text.
    odd = spark.createDataFrame([(1, 0, 0.0, 1.0, "a b"), (1, 1, 1.0, 2.0, None), (1, 2, 2.0, 3.0, "c"), (2, 0, None, None, "d")], "source_id long, seq int, start double, end double, text string")
    assert {(r.source_id, r.text, r.token_count, tuple(r.segment_indices)) for r in chunk.chunk_sentences(odd).collect()} == {(1, "a b c", 3, (0, 1, 2)), (2, "d", 1, (0,))}


def test_near(spark):
    obs = spark.createDataFrame([(1, i, t, s, 0.0) for i, (t, s) in enumerate([(10.0, 1.0), (11.0, 5.0), (12.5, 2.0), (15.0, 4.0), (20.0, 1.0), (22.0, 9.0)])], "source_id long, frame_id long, ts double, size double, scene_diff double")
    kept = [r.ts for r in sample.dedup_near(obs).orderBy("ts").collect()]
    assert kept == [11.0, 15.0, 22.0]
    at = spark.createDataFrame([(1, 0, 10.5), (1, 1, 17.5), (1, 2, 30.0), (2, 3, 1.0)], "source_id long, p int, t double")
    near = {r.p: r.near.ts if r.near else None for r in timejoin.nearest(at, obs, "t", ["p"], 2.5).collect()}
    assert near == {0: 10.0, 1: 15.0, 2: None, 3: None}
    assert {r.p: r.near.ts if r.near else None for r in timejoin.nearest_any(at, obs, "t").collect()} == {0: 10.0, 1: 15.0, 2: 22.0, 3: None}


def test_candidates_keep_apart(spark):
    frames = [(10.0, 0.9), (11.0, 0.85), (15.0, 0.7), (20.0, 0.8), (24.0, 0.6)]
    obs = spark.createDataFrame([(1, i, t, c, None) for i, (t, c) in enumerate(frames)], "source_id long, frame_id long, ts double, content_score double, scene_diff double")
    sec = spark.createDataFrame([(1, "s", 8.0, 26.0)], "source_id long, section_id string, start double, end double")
    ts = sorted(r.ts for r in topics.candidates(sec, obs, 3).collect())
    assert len(ts) == 3 and all(b - a >= 4 for a, b in zip(ts, ts[1:], strict=False))
    ranked = spark.createDataFrame([(1, "s", ["frame_1", "frame_7", "frame_0"])], "source_id long, section_id string, ids array<string>")
    assert [r.pick_no for r in topics.section_frames(topics.candidates(sec, obs, 3), ranked).orderBy("pick_no").collect()] == [0, 1]


def test_timeline_tiles(spark):
    s = seg(spark, [(float(5 * i), 5.0 * i + 5, f"t{i}") for i in range(8)])
    sec = spark.createDataFrame([(1, "a", 0.0, 20.0), (1, "b", 12.5, 40.0), (1, "c", 12.5, 13.0)], "source_id long, section_id string, start double, end double")
    b = docs.timeline(sec, s).orderBy("block_no").collect()
    assert b[0].block_start == 0.0 and b[-1].block_end == 40.0 and all(x.block_end == y.block_start for x, y in zip(b, b[1:], strict=False))
    assert timejoin.contained(s, docs.timeline(sec, s)).count() == 8


def test_notes_round_trip(spark):
    sections = spark.createDataFrame([(1, "section_0000", None, 0, 0.0, 10.0, "Head", "Sum one.", ["p", "q"], ["c"]), (1, "section_0000_00", "section_0000", 0, 0.0, 5.0, "Kid", "Sum two.", ["r"], ["c"])], "source_id long, section_id string, parent_id string, ord long, start double, end double, heading string, summary string, key_points array<string>, chunk_ids array<string>")
    meta = spark.createDataFrame([(1, "T", "C", 65.0, "20240102", "v")], "source_id long, title string, channel string, duration_seconds double, upload_date string, video_id string")
    execs = spark.createDataFrame([(1, "All of it.")], "source_id long, executive_summary string")
    slots = spark.createDataFrame([(1, "section_0000", 7, 1.0, "f7", 0)], "source_id long, section_id string, frame_id long, ts double, path string, slot int")
    notes = docs.notes_md(meta, sections, execs, slots)
    assert "**Duration:** 1:05" in notes.first().notes_md and "![Frame at 00:01](f7)" in notes.first().notes_md
    got = [(r.level, r.heading, r.summary, list(r.key_points)) for r in readers.parse_notes(notes, "notes_md").orderBy("section_no").collect()]
    assert got == [(2, "Head", "Sum one.", ["p", "q"]), (3, "Kid", "Sum two.", ["r"])]
    assert readers.extract_exec_summary(notes, "notes_md").first().executive_summary == "All of it."
    assert [r.heading for r in readers.leaf_by_level(readers.parse_notes(notes, "notes_md")).collect()] == ["Kid"]
    assert "sections" in docs.nested_payload(meta, sections, seg(spark, [(0.0, 4.0, "x")])).first().payload


def test_mining(spark):
    bodies = ["7", "Score: 7", "0.8", '{"score": 0.3}', "nothing", "", None, "it is 0.25 or so", "nan"]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    assert [(r.score, r.rule) for r in score.mine_scores(df).orderBy("k").collect()] == [(1.0, 1), (0.7, 3), (0.8, 1), (0.3, 2), (0.5, 0), (0.5, 0), (0.5, 0), (0.25, 4), (0.5, 0)]
    trace = spark.createDataFrame([(0, 'x {"a": {"b": 1}} y {"heading": "h", "summary": "s"} {"score": 1}'), (1, "Score 0.4 seems right"), (2, "one\n\nlast ")], "k int, body string")
    assert [r.rule for r in infer.answer_from_trace(trace, ["k"]).orderBy("k").collect()] == [5, 2, 0]
    fenced = spark.createDataFrame([(0, '```json\n{"heading": "H", "key_points": ["a"]}\n```')], "k int, body string")
    assert infer.typed_records(infer.mine_records(fenced)).first().heading == "H"


def test_infer_isolates_failures(spark):
    def model(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    got = infer.infer(spark.createDataFrame([(i, p) for i, p in enumerate(["a", "bad", "c"])], "k int, prompt string").coalesce(1), model).orderBy("k").collect()
    assert [(r.body, r.error) for r in got] == [("A", None), (None, "ValueError: no"), ("C", None)]


def test_text(spark):
    row = spark.range(1).select(
        X.format_time(F.lit(3725.9)).alias("a"), X.format_time(F.lit(65.0)).alias("b"), X.duration_human(F.lit(65.0)).alias("c"), X.anchor(F.lit(" A (b) #c ")).alias("d"),
        X.output_key(F.lit("a/b: c"), F.lit(7)).alias("e"), X.has_cue(F.lit("and Now we")).alias("f"), X.has_cue(F.lit("known")).alias("g"), X.spoken(F.lit("- **b** ![x](y) <i>z</i>")).alias("h"),
    ).first()
    assert tuple(row) == ("1:02:05", "01:05", "1:05", "a-b-c", "a_b__c_7", True, False, "b  z")


def test_streams(spark, tmp_path):
    turns = [(1, t, "user" if t % 2 else "bot", f"m{t}") for t in range(12)] + [(2, 0, "user", " ")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/turns")
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{tmp_path}/turns")
    tracking.rolling_history(stream, 3, ttl_ms=None).writeStream.format("memory").queryName("past").outputMode("update").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination(120)
    want = {r.conv_id: r.history for r in infer.history(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 3).collect()}
    assert {r.conv_id: r.history for r in spark.table("past").collect()} == want
    lines = seg(spark, [(0.0, 4.0, "a"), (5.0, 9.0, "b")])
    sections = spark.createDataFrame([(1, "s", None, 0, 0.0, 4.5), (1, "k", "s", 0, 0.0, 2.0)], "source_id long, section_id string, parent_id string, ord int, sec_start double, sec_end double")
    spark.sql("SELECT 7L viewer, 1L source_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id) event_time, cast(id as double) t FROM range(8)").coalesce(1).write.parquet(f"{tmp_path}/pos")
    pos = spark.readStream.schema("viewer long, source_id long, event_time timestamp, t double").parquet(f"{tmp_path}/pos")
    shown = tracking.drained(pos, str(tmp_path), "append", lambda rows: tracking.located(rows, sections, lines))
    tracking.track_positions(tracking.following(shown)).writeStream.format("memory").queryName("shown").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination(120)
    got = [(r.section_id, r.line_seq) for r in spark.table("shown").orderBy("event_time").collect()]
    assert got == [("k", 0), ("s", 0), (None, 1)]


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, "a: b", "n1"), (2, "c", "n2")], "source_id long, title string, notes_md string")
    docs.write_bundle(df, f"{tmp_path}/out")
    docs.write_bundle(df.filter("source_id = 2").withColumn("notes_md", F.lit("new")), f"{tmp_path}/out")
    assert {r.out_key: r.notes_md for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a__b_1": "n1", "c_2": "new"}


def test_interval_joins(spark):
    """Against every pair: intervals of all lengths, in the wrong order, touching, equal, negative, endless or without a bound."""
    rng = random.Random(4)
    odd = [(5.0, 5.0), (9.0, 3.0), (-40.0, -2.0), (0.0, 1e12), (7.0, None), (None, None), (16.0, 32.0), (32.0, 48.0), (float("nan"), 1.0)]
    made = lambda n: [(x, x + rng.choice([0.5, 3.0, 16.0, 40.0, 900.0, 70_000.0])) for x in (float(rng.randrange(-50, 400)) for _ in range(n))]
    a, b = [*odd, *made(60)], [*odd, *made(60)]
    left = spark.createDataFrame([(1, i, *x) for i, x in enumerate(a)], "source_id long, seq int, start double, end double")
    right = spark.createDataFrame([(1, i, *x) for i, x in enumerate(b)], "source_id long, no int, sec_start double, sec_end double")
    got = [(r.seq, r.no) for r in timejoin.overlap(left, right).collect()]
    plain = left.crossJoin(right.drop("source_id")).filter("end > sec_start AND start < sec_end AND sec_end IS NOT NULL AND start IS NOT NULL")
    assert len(got) > 500 and sorted(got) == sorted((r.seq, r.no) for r in plain.collect())
    lines = left.filter("start <= end")
    at = spark.createDataFrame([(1, k, x) for k, x in enumerate([-3.0, 5.0, 16.0, 250.5, 5e5, None])], "source_id long, p int, t double")
    shown = {r.p: r.line_seq for r in timejoin.active_line(at, lines, ["p"]).collect()}
    for r in at.collect():
        own = [(s, x, y) for s, (x, y) in enumerate(a) if r.t is not None and x is not None and y is not None and x <= y]
        opened = [s for s, x, y in own if x - 0.12 <= r.t < y + 0.12]
        close = sorted((abs(r.t - (x + y) / 2), s) for s, x, y in own if abs(r.t - (x + y) / 2) <= 1.5)
        assert shown[r.p] == (max(opened) if opened else close[0][1] if close else None)


def test_drained(spark, tmp_path):
    """A drained stream gives what the batch twin gives; a stream without input gives no rows."""
    ddl = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(6)] + [(2, 0, None, None)], ddl).repartition(3).write.parquet(f"{tmp_path}/turns")
    spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/none")
    read = lambda name: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    last = tracking.drained(tracking.rolling_history(read("turns"), 3, ttl_ms=None), str(tmp_path), "update").groupBy("conv_id").agg(F.max_by("history", F.struct("batch", "turn")).alias("history"))
    assert {r.conv_id: r.history for r in last.collect()} == {1: "User: m3\nUser: m4\nUser: m5", 2: ""}
    assert tracking.drained(tracking.rolling_history(read("none"), 3, ttl_ms=None), str(tmp_path), "update").count() == 0


def test_outline(spark):
    df = spark.createDataFrame([(0.0, 65.0, "H", "Idea.", ["a", "b", "c", "d", "e"], ["k"], "shift"), (0.0, 1.0, None, None, None, None, None)], "s double, e double, h string, m string, p array<string>, k array<string>, t string")
    got = [r.o for r in df.select(X.outline(*map(F.col, "s e h m p k t".split())).alias("o")).collect()]
    assert got == ["[00:00-01:05] H: Idea. | Points: a; b; c; d | Keywords: k | Transition: shift", "[00:00-00:01] :  | Points:  | Keywords:  | Transition: continue"]
    assert spark.sql("SELECT 'One is 1.5 long. but this. Two! Été' t").select(X.strict_sentences(F.col("t")).alias("s")).first().s == ["One is 1.5 long. but this.", "Two! Été"]


def test_file_scans(spark, tmp_path):
    """Transcripts and notes as files, one document each, in folders of their own."""
    import json

    for name, title in (("one", "# First"), ("two", "Second")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "notes.md").write_text(f"{title}\n\n## A\n")
        (tmp_path / name / "transcript.json").write_text(json.dumps({"segments": [{"start": 0.0, "end": 1.5, "text": name}, {"start": 1.5, "end": 2.0, "text": "x"}], "source": "whisper", "language": "en"}))
    got = {r.path.rsplit("/", 2)[1]: (r.title, r.notes) for r in readers.scan_library(spark, str(tmp_path)).collect()}
    assert got == {"one": ("First", "# First\n\n## A\n"), "two": ("Second", "Second\n\n## A\n")}
    rows = readers.read_transcript_json(spark, f"{tmp_path}/*/transcript.json").orderBy("source_id", "seq").collect()
    assert [(r.source_id.rsplit("/", 2)[1], r.seq, r.start, r.end, r.text, r.origin, r.language) for r in rows] == [(n, k, *s, "whisper", "en") for n in ("one", "two") for k, s in enumerate([(0.0, 1.5, n), (1.5, 2.0, "x")])]


def test_quarantine(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0, 0.5), (2, 2.0, 1.0, 9.0), (3, 0.0, None, 0.5), (4, 0.0, 0.0, 1.5), (5, 0.0, 0.0, None), (6, 1.0, 1.0, 0.0)], "k int, start double, end double, score double")
    good, bad = clean.quarantine(rows, ("score",))
    assert sorted(r.k for r in good.collect()) == [1, 6] and good.columns == rows.columns
    assert {r.k: r.reason for r in bad.collect()} == {2: "end before start", 3: "end before start", 4: "score out of bounds", 5: "score out of bounds"}


def test_ranked_ids(spark):
    bodies = ['{"ranked_ids": ["frame_2", "frame_0"]}', 'Sure {"ranked_ids": ["a"], "reason": "x"} ok', "no", None, '{"ranked_ids": "a"}', '{"ranked_ids": []}', '{"other": ["a"]}', '{"ranked_ids": ["a", null]}']
    got = {r.k: list(r.ids) for r in infer.ranked_ids(spark.createDataFrame(list(enumerate(bodies)), "k int, body string"), ["k"]).collect()}
    assert got == {0: ["frame_2", "frame_0"], 1: ["a"], 2: [], 3: [], 4: [], 5: [], 6: [], 7: ["a"]}
