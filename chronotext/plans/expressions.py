"""Registered queries of the column expressions, of two small list operators and of the streams, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions import text as X
from chronotext.operators import tree
from chronotext.plans import ctes, inputs
from chronotext.plans.oracles import ORACLES as BASE, q
from chronotext.plans.queries import on
from chronotext.staging import folder, staged
from chronotext.streaming import tracking

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Keys of the derived tables.
KEYS = {"aligned": ["source_id", "seq"], "chunks": ["source_id", "chunk_no"], "summaries": ["source_id", "chunk_no"], "meta": ["source_id"], "execs": ["source_id"]}


def expression(name: str, of: str, made: dict[str, tuple[Callable[[DataFrame], Column], str]]) -> None:
    """Register a query that works out columns over all rows of a derived table, and its SQL."""
    keys = KEYS[of]

    def run(spark, sf):
        rows = getattr(on(spark, sf), of)
        return rows.select(*keys, *(make(rows).alias(k) for k, (make, _) in made.items()))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = q(of, f"SELECT {', '.join(keys)}, {', '.join(f'{sql} AS {k}' for k, (_, sql) in made.items())} FROM {of}")


def listed(sql: str) -> str:
    return f"array_to_string({sql}, '|')"


def _strict(text: str) -> str:
    cut = rf"string_split(regexp_replace({text}, '([.!?])[ \t\n\r\f]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {ctes.ends('s')}), lambda s: s <> '')"


def _spoken(text: str) -> str:
    bold = rf"regexp_replace({text}, '\*\*([^*]+)\*\*', '\1', 'g')"
    plain = rf"regexp_replace(regexp_replace({bold}, '(?m)^- ', '', 'g'), '!\[[^\]]*\]\([^)]+\)', '', 'g')"
    return ctes.ends(f"regexp_replace({plain}, '<[^>]+>', '', 'g')")


def _anchor(text: str) -> str:
    plain = rf"regexp_replace(lower(trim({text})), '[#\[\](){{}}|\\^`]', '', 'g')"
    return rf"regexp_replace(regexp_replace({plain}, '{ctes.WS}', '-', 'g'), '^-+|-+$', '', 'g')"


def _key(title: str, source_id: str) -> str:
    safe = ctes.ends(rf"regexp_replace({title}, '[<>:\"/\\|?*\x00-\x1f]', '_', 'g')")
    return rf"left(regexp_replace({safe}, '[ \t\n\r\f]+', '_', 'g'), 60) || '_' || {source_id}"


JOINED = "array_to_string(keywords, ' ')"
expression("j1_topic_tokens", "aligned", {"tokens": (lambda d: F.array_join(F.array_sort(X.topic_tokens(d.text)), "|"), listed(f"list_sort({ctes.topic_tokens('text')})"))})
expression("j2_caption_tokens", "aligned", {"tokens": (lambda d: F.array_join(X.caption_tokens(d.text), "|"), listed(ctes.caption_tokens("text")))})
# With every third row's keywords taken away, so that heading and main idea step in.
expression("j3_summary_tokens", "summaries", {"tokens": (lambda d: F.array_join(F.array_sort(X.summary_tokens(F.when(F.col("chunk_no") % 3 > 0, F.col("keywords")).otherwise(F.array().cast("array<string>")), d.heading, d.main_idea)), "|"), listed(f"list_sort(CASE WHEN chunk_no % 3 > 0 AND len({ctes.topic_tokens(JOINED)}) > 0 THEN {ctes.topic_tokens(JOINED)} ELSE {ctes.topic_tokens('heading || chr(32) || main_idea')} END)"))})
expression("j4_cue", "aligned", {"has_cue": (lambda d: X.has_cue(F.concat(F.when(F.col("seq") % 5 == 0, "Moving on, ").otherwise(""), d.text)), ctes.cue("CASE WHEN seq % 5 = 0 THEN 'Moving on, ' ELSE '' END || text"))})
expression("j5_token_count", "aligned", {"n_tokens": (lambda d: X.token_count(d.text), ctes.tokens("text"))})
expression("j6_format_time", "aligned", {"at": (lambda d: X.format_time(d.start * 9), ctes.time("(start * 9)"))})
expression("j7_duration", "meta", {"duration": (lambda d: X.duration_human(F.col("duration_seconds") * 9), ctes.human("(duration_seconds * 9)"))})
expression("j8_upload_date", "meta", {"day": (lambda d: X.upload_date(F.col("upload_date")), "left(upload_date, 4) || '-' || upload_date[5:6] || '-' || upload_date[7:]")})
expression("j9_anchor", "summaries", {"anchor": (lambda d: X.anchor(F.concat(F.lit("# "), d.heading, F.lit(" (part) - "))), _anchor("'# ' || heading || ' (part) - '"))})
expression("j10_output_key", "aligned", {"out_key": (lambda d: X.output_key(F.concat(d.text, F.lit(" a/b: c?")), F.col("source_id")), _key("text || ' a/b: c?'", "source_id"))})
expression("j11_compact", "chunks", {"short": (lambda d: X.compact(d.text), ctes.compact("text"))})
expression("j12_outline", "summaries", {"outline": (lambda d: X.outline(d.start, d.end, d.heading, d.main_idea, F.col("key_points"), F.col("keywords"), F.col("transition")), f"""'[' || {ctes.time('start')} || '-' || {ctes.time('"end"')} || '] ' || heading || ': ' || main_idea || ' | Points: ' || array_to_string(key_points[1:4], '; ') || ' | Keywords: ' || array_to_string(keywords[1:8], ', ') || ' | Transition: ' || transition""")})
expression("j13_spoken", "execs", {"spoken": (lambda d: X.spoken(F.concat(F.col("executive_summary"), F.lit("\n- ![frame](f.png) <b>end</b> "))), _spoken("executive_summary || chr(10) || '- ![frame](f.png) <b>end</b> '"))})
STYLES = {0: "Concise", 1: " well-explained", 2: "educational ", 3: "other"}
expression("j15_style", "meta", {"style": (lambda d: X.style_guidance(F.element_at(F.create_map(*(F.lit(x) for p in STYLES.items() for x in p)), (F.col("source_id") % 4).cast("int"))), "CASE source_id % 4 WHEN 0 THEN 'Give the main takeaway in few words and leave background out.' WHEN 2 THEN 'Teach: build intuition, link each step to the one before, say why each idea matters.' ELSE 'Explain clearly, keep the steps of an argument and define terms where needed.' END")})
expression("j16_sentences", "chunks", {"loose": (lambda d: F.array_join(X.sentences(d.text), "|"), listed(ctes.sentences("text"))), "strict": (lambda d: F.array_join(X.strict_sentences(d.text), "|"), listed(_strict("text")))})
expression("d3_chunk_build", "chunks", {"n_chars": (lambda d: F.length("text"), "length(text)"), "span": (lambda d: F.round(d.end - d.start, 6), 'round("end" - start, 6)'), "token_count": (lambda d: F.col("token_count"), ctes.tokens("text")), "n_segments": (lambda d: F.size("segment_indices"), "len(seqs)")})
expression("f5_first_n", "summaries", {"points": (lambda d: F.array_join(F.slice("key_points", 1, 4), "|"), listed("key_points[1:4]")), "words": (lambda d: F.array_join(F.slice("keywords", 1, 8), "|"), listed("keywords[1:8]"))})


def followed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream; as a glob, since a stream's plain path has to be a folder."""
    return spark.readStream.schema(inputs.table(spark, sf, name).schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def l1_playback_tracking(spark: SparkSession, sf: str) -> DataFrame:
    """The stream of playback positions, drained: a row whenever what a viewer of a source is shown changes."""
    t = on(spark, sf)
    events = followed(spark, sf, "events")
    pos = events.select((F.col("event_id") % 4).alias("viewer"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("event_time"), F.col("value").alias("t"))
    sections, lines = staged(tree.paths(t.secs, "sec_start", "sec_end"), "secs"), staged(t.aligned, "aligned")
    shown = tracking.drained(pos, folder(spark), "append", lambda rows: tracking.located(rows, sections, lines))
    out = tracking.drained(tracking.track_positions(tracking.following(shown)), folder(spark), "append")
    return out.select("viewer", "source_id", F.unix_micros("event_time").alias("event_us"), "section_id", "line_seq")


def l2_rolling_history(spark: SparkSession, sf: str) -> DataFrame:
    """The stream of conversation turns, drained: the last three turns of every conversation after its last batch."""
    out = tracking.drained(tracking.rolling_history(followed(spark, sf, "conversations"), 3, ttl_ms=None), folder(spark), "update")
    return out.groupBy("conv_id").agg(F.max_by("history", F.struct("batch", "turn")).alias("history"))


QUERIES |= {"l1_playback_tracking": l1_playback_tracking, "l2_rolling_history": l2_rolling_history}
ORACLES["l2_rolling_history"] = BASE["e17_history"]
ORACLES["l1_playback_tracking"] = f"""SELECT viewer, source_id, epoch_us(ts) AS event_us, section_id, line_seq FROM (
SELECT *, section_id IS DISTINCT FROM lag(section_id) OVER w OR line_seq IS DISTINCT FROM lag(line_seq) OVER w AS changed FROM (
SELECT event_id % 4 AS viewer, e.user_id AS source_id, ts, value, section_id, nullif(line_seq, -1) AS line_seq FROM events e
JOIN ({BASE['c9_active_section']}) s ON s.viewer_event = event_id JOIN ({BASE['c10_active_line']}) l ON l.viewer_event = event_id)
WINDOW w AS (PARTITION BY viewer, source_id ORDER BY ts, value)) WHERE changed"""

ORACLES["e16_leaf_levels"] = f"""SELECT source_id, section_no, level, heading FROM (
SELECT *, lead(level) OVER (PARTITION BY source_id ORDER BY section_no) AS next_level FROM ({BASE['a5_notes_sections']})) WHERE next_level IS NULL OR next_level <= level"""
ORACLES["k8_chat_prompts"] = f"""SELECT q.conv_id, 'chat' AS kind, concat_ws(chr(10) || chr(10), 'Answer from this transcript; say so where it does not suffice.', coalesce(full_text, ''), nullif(coalesce(history, ''), ''), question) AS prompt
FROM (SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id) q
LEFT JOIN ({BASE['d2_full_text']}) t ON t.source_id = q.conv_id LEFT JOIN ({BASE['e17_history']}) h ON h.conv_id = q.conv_id"""
def walked(of: str) -> str:
    """Objects of the bodies of ``of``, character by character: i is the next one, s where the open object began; at the end of the
    text an object that is still open is given up, and the walk goes on behind its brace."""
    c, done = "body[i]", "i > length(body)"
    ends = f"depth = 1 AND NOT instr AND {c} = '}}' AND NOT {done}"
    return f"""walk AS (SELECT conv_id, turn, body, 1::BIGINT AS i, 0::BIGINT AS s, 0 AS depth, false AS instr, false AS esc, []::VARCHAR[] AS found FROM {of} WHERE contains(body, '{{')
UNION ALL SELECT conv_id, turn, body, CASE WHEN {done} THEN s + 1 ELSE i + 1 END, CASE WHEN depth = 0 THEN i ELSE s END,
CASE WHEN {done} THEN 0 WHEN depth = 0 THEN ({c} = '{{')::INT WHEN instr OR esc THEN depth WHEN {c} = '{{' THEN depth + 1 WHEN {c} = '}}' THEN depth - 1 ELSE depth END,
CASE WHEN {done} OR depth = 0 THEN false WHEN {c} = '"' AND NOT esc THEN NOT instr ELSE instr END,
CASE WHEN {done} OR depth = 0 THEN false ELSE instr AND NOT esc AND {c} = chr(92) END,
CASE WHEN {ends} THEN list_append(found, body[s:i]) ELSE found END FROM walk WHERE NOT ({done} AND depth = 0)),
objects AS (SELECT conv_id, turn, unnest(range(len(found))) AS no, unnest(found) AS object FROM walk WHERE i > length(body) AND depth = 0)"""


OBJECTS = "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY no) - 1)::INT AS object_no, object FROM objects WHERE json_valid(object)"
ANSWER = f"""SELECT r.conv_id, r.turn, coalesce(o.object, '{{"score": ' || coalesce(s, b) || '}}', last, '') AS answer, coalesce(o.rank, CASE WHEN s IS NOT NULL THEN 2 WHEN b IS NOT NULL THEN 1 ELSE 0 END) AS rule FROM (
SELECT conv_id, turn, nullif(regexp_extract(body, '[Ss]core[:\\s=]+([0-9]+\\.?[0-9]*)', 1), '') AS s, nullif(regexp_extract(right(body, 200), '(?:^|[^\\p{{L}}\\p{{N}}_])(0\\.[0-9]+|1\\.0)(?:$|[^\\p{{L}}\\p{{N}}_])', 1), '') AS b,
list_filter(list_transform(string_split(body, chr(10)), lambda x: {ctes.ends('x')}), lambda x: x <> '')[-1] AS last FROM %s) r
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY rank DESC, CASE WHEN rank = 5 THEN length(object) ELSE 0 END DESC, CASE WHEN rank = 5 THEN -object_no ELSE object_no END DESC) AS rn FROM (
SELECT *, CASE WHEN len(list_intersect(json_keys(object), ['heading', 'summary'])) > 0 THEN 5 WHEN json_type(object, '$.score') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 4 ELSE 3 END AS rank
FROM ({OBJECTS}) WHERE NOT regexp_matches(object, '^\\{{\\s*\\}}$'))) o ON o.conv_id = r.conv_id AND o.turn = r.turn AND rn = 1"""
for suffix, of in (("", "responses"), ("_deep", "deep")):
    ORACLES["i3_objects" + suffix] = q(of, OBJECTS, walked(of))
    ORACLES["i4_trace_answer" + suffix] = q(of, ANSWER % of, walked(of))



def _object(sql: str) -> str:
    return f"CASE WHEN json_valid({sql}) AND starts_with({sql}, '{{') THEN {sql} END"


ORACLES["i2_records"] = rf"""SELECT conv_id, turn, CASE WHEN a IS NOT NULL THEN 1 WHEN h IS NOT NULL THEN 2 WHEN o IS NOT NULL THEN 3 ELSE 0 END AS rule, json_extract_string(coalesce(a, h, o), '$.heading') AS heading,
json_extract_string(coalesce(a, h, o), '$.summary') AS summary, array_to_string(json_extract(coalesce(a, h, o), '$.key_points')::VARCHAR[], ' | ') AS key_points FROM (
SELECT conv_id, turn, {_object('b')} AS a, {_object('h0')} AS h, {_object('o0')} AS o FROM (
SELECT conv_id, turn, answer AS b, nullif(regexp_extract(answer, '(\{{[^{{}}]*"heading"[^{{}}]*\}})', 1), '') AS h0, nullif(regexp_extract(answer, '(\{{[^{{}}]+\}})', 1), '') AS o0 FROM ({BASE['i5_strip_reasoning']})))"""
