"""DuckDB's SQL for queries whose steps choose greedily or whose results are whole documents."""

from __future__ import annotations

from chronotext.plans.ctes import WS, caption_tokens, compact, human, time, tokens
from chronotext.plans.expressions import _anchor as anchor, _strict as strict
from chronotext.plans.oracles import ORACLES as BASE, q

NL = "chr(10)"
FRAME = "STRUCT(neg DOUBLE, ts DOUBLE, frame_id BIGINT)[]"

#: Diverse observations of each section: anchors take their best free one in turn, then the rest by distance to an anchor.
PICKED = f"""near0 AS (SELECT s.source_id, section_id, s.start, s."end", frame_id, ts, coalesce(content_score, 0.0) * 0.55 + coalesce(scene_diff, 0.0) * 0.20
  + (1 - least(1.0, abs(ts - (s.start + s."end") / 2) / greatest(1.0, (s."end" - s.start) / 2 + 2))) * 0.25 AS score FROM sections s JOIN obs o ON o.source_id = s.source_id AND ts BETWEEN s.start - 3.0 AND s."end" + 3.0),
cand0 AS (SELECT source_id, section_id, start, "end", list_sort(list({{'neg': -score, 'ts': ts, 'frame_id': frame_id::BIGINT}})) AS f FROM near0 GROUP BY ALL),
cand1 AS (SELECT *, greatest(1.0, "end" - start) AS dur, least(4, len(f)) AS a FROM cand0),
cand2 AS (SELECT *, CASE WHEN a = 1 THEN [(start + "end") / 2] ELSE list_transform(range(a), lambda i: start + dur * i / (a - 1)) END AS anchors FROM cand1),
cand AS MATERIALIZED (SELECT *, greatest(4.0, dur / (len(anchors) * 2)) AS reach, list_transform(list_sort(list_transform(f, lambda x: {{'d': list_min(list_transform(anchors, lambda g: abs(x.ts - g))), 'x': x}})), lambda y: y.x) AS rest FROM cand2),
pk AS (SELECT source_id, section_id, 0 AS k, []::{FRAME} AS got FROM cand UNION ALL
SELECT source_id, section_id, k + 1, CASE WHEN hit IS NOT NULL AND len(got) < 4 THEN list_append(got, hit) ELSE got END FROM (
  SELECT p.source_id, p.section_id, k, got, list_filter(f, lambda x: abs(x.ts - anchors[k + 1]) <= reach AND len(list_filter(got, lambda y: abs(x.ts - y.ts) < 4.0)) = 0)[1] AS hit
  FROM pk p JOIN cand c ON c.source_id = p.source_id AND c.section_id = p.section_id WHERE k < a)),
pr AS (SELECT p.source_id, p.section_id, 0 AS j, got FROM pk p JOIN cand c ON c.source_id = p.source_id AND c.section_id = p.section_id WHERE k = a UNION ALL
SELECT r.source_id, r.section_id, j + 1, CASE WHEN len(list_filter(got, lambda y: abs(rest[j + 1].ts - y.ts) < 4.0)) = 0 THEN list_append(got, rest[j + 1]) ELSE got END
  FROM pr r JOIN cand c ON c.source_id = r.source_id AND c.section_id = r.section_id WHERE j < len(rest) AND len(got) < 4),
picked AS MATERIALIZED (SELECT source_id, section_id, unnest(range(len(got)))::INT AS pick_no, unnest(got).frame_id AS frame_id, unnest(got).ts AS ts, -unnest(got).neg AS score FROM (SELECT source_id, section_id, arg_max(got, j) AS got FROM pr GROUP BY source_id, section_id))"""
NUMBERED = "(row_number() OVER (PARTITION BY source_id, section_id ORDER BY ts, frame_id) - 1)::INT AS frame_no"
KEPT = f"kept AS MATERIALIZED (SELECT *, {NUMBERED} FROM picked WHERE pick_no < 2)"
SHOTS = "shots AS (SELECT k.*, o.path, o.content_score FROM kept k JOIN obs o ON o.source_id = k.source_id AND o.frame_id = k.frame_id)"
SLOTS = """slots AS (SELECT k.source_id, k.section_id, frame_id, ts, coalesce(list_min(list_filter(range(n), lambda i: ts < s.start + (i + 1) * ((s."end" - s.start) / n))), n - 1)::INT AS slot
FROM kept k JOIN (SELECT *, len(key_points) AS n FROM sections) s ON s.source_id = k.source_id AND s.section_id = k.section_id WHERE n > 0)"""


def picture(path: str = "path") -> str:
    return f"'![Frame at ' || {time('ts')} || '](' || {path} || ')'"


#: The list of contents, and each section of the notes.
CONTENTS = f"""contents AS (SELECT source_id, string_agg(CASE WHEN parent_id IS NULL THEN '' ELSE '  ' END || '- ' || {time('start')} || ' — [' || heading || '](#' || {anchor('heading')} || ')', {NL} ORDER BY section_id) AS contents FROM sections GROUP BY source_id)"""
NOTES = f"""shotmd AS (SELECT source_id, section_id, slot, string_agg('  ' || {picture("'f' || frame_id")}, {NL} ORDER BY ts, frame_id) AS m FROM slots GROUP BY source_id, section_id, slot),
points AS (SELECT source_id, section_id, unnest(key_points) AS p, unnest(range(len(key_points)))::INT AS i FROM sections),
pointmd AS (SELECT p.source_id, p.section_id, string_agg('- ' || p || CASE WHEN m IS NOT NULL THEN {NL} || {NL} || m || {NL} ELSE '' END, {NL} ORDER BY i) AS md FROM points p LEFT JOIN shotmd s ON s.source_id = p.source_id AND s.section_id = p.section_id AND slot = i GROUP BY p.source_id, p.section_id),
bodies AS (SELECT s.source_id, string_agg(concat_ws({NL}, CASE WHEN parent_id IS NULL THEN '## ' ELSE '### ' END || heading, '', '*' || {time('start')} || '*', '', summary, '', coalesce(md, ''), ''), {NL} ORDER BY s.section_id) AS body
  FROM sections s LEFT JOIN pointmd p ON p.source_id = s.source_id AND p.section_id = s.section_id GROUP BY s.source_id),
notes AS (SELECT m.source_id, regexp_replace(concat_ws({NL}, '# ' || title, '', '**Channel:** ' || channel || '  ', '**Duration:** ' || {human('duration_seconds')} || '  ', '**Uploaded:** ' || upload_date[1:4] || '-' || upload_date[5:6] || '-' || upload_date[7:] || '  ',
  '**Video ID:** `' || video_id || '`  ', '', '---', '', '## Contents' || {NL}, contents, '', '## Executive Summary' || {NL} || {NL} || executive_summary || {NL} || {NL} || '---' || {NL}, body), '\\s+$', '') || {NL} AS notes_md
  FROM meta m JOIN bodies b USING (source_id) JOIN contents c USING (source_id) JOIN execs e USING (source_id))"""


def tiled(name: str, spans: str, parts: str, key: str) -> str:
    """Blocks that tile the spans (key, r0, r1) by their parts (key, section_id, start, end)."""
    on = " AND ".join(f"x.{k} = s.{k}" for k in key.split(", "))
    mine = ", ".join(f"s.{k}" for k in key.split(", "))
    return f"""{name}1 AS (SELECT {mine}, r0, r1, x.section_id, x.start, x."end", least(x."end", coalesce(lead(x.start) OVER w, r1), r1) AS stop FROM {spans} s LEFT JOIN {parts} x ON {on} WINDOW w AS (PARTITION BY {mine} ORDER BY x.start, x."end", x.section_id)),
{name}2 AS (SELECT *, coalesce(max(greatest(r0, start, stop)) OVER (PARTITION BY {key} ORDER BY start, "end", section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r0) AS cur FROM {name}1),
{name}3 AS (SELECT {key}, cur AS a, least(greatest(cur, start), r1) AS b, NULL AS section_id FROM {name}2 WHERE section_id IS NOT NULL UNION ALL SELECT {key}, least(greatest(cur, start), r1), stop, section_id FROM {name}2 WHERE section_id IS NOT NULL
UNION ALL SELECT {key}, max(greatest(r0, start, stop)), max(r1), NULL FROM {name}2 WHERE section_id IS NOT NULL GROUP BY {key} UNION ALL SELECT {key}, r0, r1, NULL FROM {name}2 WHERE section_id IS NULL),
{name} AS MATERIALIZED (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY a) - 1 AS block_no, a, b, section_id FROM {name}3 WHERE b > a)"""


def times(a: str, b: str) -> str:
    return f"'*' || {time(a)} || ' — ' || {time(b)} || '*' || {NL} || {NL}"


#: A transcript in nested blocks: leaf blocks lb, the lines in each, their blurbs, and the section's frames behind these.
TRANSCRIPT = [
    'span AS (SELECT source_id, arg_min(start, seq) AS r0, arg_max("end", seq) AS r1 FROM aligned GROUP BY source_id)',
    "tops AS (SELECT * FROM sections WHERE parent_id IS NULL)",
    tiled("tb", "span", "tops", "source_id"),
    "par AS (SELECT t.source_id, t.block_no AS top_no, s.section_id, s.start AS r0, s.\"end\" AS r1, heading, summary, key_points FROM tb t JOIN sections s ON s.source_id = t.source_id AND s.section_id = t.section_id WHERE EXISTS (SELECT 1 FROM sections k WHERE k.source_id = s.source_id AND k.parent_id = s.section_id))",
    'kidp AS (SELECT p.source_id, p.top_no, k.section_id, k.start, k."end" FROM par p JOIN sections k ON k.source_id = p.source_id AND k.parent_id = p.section_id)',
    tiled("kb", "par", "kidp", "source_id, top_no"),
    f"""lb AS MATERIALIZED (SELECT x.*, coalesce(s.heading, 'Transcript ' || {time('a')}) AS heading FROM (SELECT source_id, block_no AS top_no, 0 AS block_no, a, b, section_id, '## ' AS mark FROM tb WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.source_id = tb.source_id AND par.top_no = tb.block_no)
UNION ALL SELECT source_id, top_no, block_no, a, b, section_id, '### ' FROM kb) x LEFT JOIN sections s ON s.source_id = x.source_id AND s.section_id = x.section_id)""",
    """ln AS (SELECT l.source_id, top_no, block_no, l.section_id, seq, x.start, x."end", text, lag(x."end") OVER (PARTITION BY l.source_id, top_no, block_no ORDER BY x.start, seq) AS prev FROM lb l JOIN span p ON p.source_id = l.source_id JOIN aligned x ON x.source_id = l.source_id AND x.start >= a AND (x.start < b OR (b = r1 AND x.start <= b)))""",
    "lc AS (SELECT *, coalesce(EXISTS (SELECT 1 FROM shots f WHERE f.source_id = ln.source_id AND f.section_id = ln.section_id AND f.ts BETWEEN prev - 1.0 AND ln.start + 1.0), false) AS cut FROM ln)",
    "ld AS (SELECT *, sum(cut::INT) OVER (PARTITION BY source_id, top_no, block_no ORDER BY start, seq ROWS UNBOUNDED PRECEDING) AS no FROM lc)",
    "bl AS (SELECT source_id, top_no, block_no, any_value(section_id) AS section_id, no, arg_min(start, (start, seq)) AS a, arg_max(\"end\", (start, seq)) AS b, string_agg(text, ' ' ORDER BY start, seq) AS said FROM ld GROUP BY source_id, top_no, block_no, no)",
    "pl AS (SELECT l.source_id, l.top_no, l.block_no, f.ts, f.frame_id, f.path, coalesce(min(CASE WHEN f.ts <= bl.b + 1.5 THEN no END), max(no), -1) AS no FROM lb l JOIN shots f ON f.source_id = l.source_id AND f.section_id = l.section_id LEFT JOIN bl ON bl.source_id = l.source_id AND bl.top_no = l.top_no AND bl.block_no = l.block_no GROUP BY ALL)",
    f"pm AS (SELECT source_id, top_no, block_no, no, string_agg({picture()} || {NL} || {NL}, '' ORDER BY ts, frame_id) AS md FROM pl GROUP BY ALL)",
    f"bt AS (SELECT bl.source_id, bl.top_no, bl.block_no, string_agg('**[' || {time('bl.a')} || ']**' || {NL} || {NL} || said || {NL} || {NL} || coalesce(md, ''), '' ORDER BY bl.no) AS t FROM bl LEFT JOIN pm ON pm.source_id = bl.source_id AND pm.top_no = bl.top_no AND pm.block_no = bl.block_no AND pm.no = bl.no GROUP BY bl.source_id, bl.top_no, bl.block_no)",
    f"""lt AS (SELECT l.source_id, l.top_no, string_agg(mark || heading || {NL} || {NL} || {times('a', 'b')} || coalesce(t, '') || coalesce(md, ''), '' ORDER BY l.block_no) AS t FROM lb l LEFT JOIN bt ON bt.source_id = l.source_id AND bt.top_no = l.top_no AND bt.block_no = l.block_no
LEFT JOIN pm ON pm.source_id = l.source_id AND pm.top_no = l.top_no AND pm.block_no = l.block_no AND pm.no = -1 GROUP BY l.source_id, l.top_no)""",
    f"""tt AS (SELECT t.source_id, string_agg(CASE WHEN p.section_id IS NOT NULL THEN '## ' || heading || {NL} || {NL} || {times('p.r0', 'p.r1')} || CASE WHEN coalesce(summary, '') <> '' THEN summary || {NL} || {NL} ELSE '' END
  || CASE WHEN len(key_points) > 0 THEN array_to_string(list_transform(key_points, lambda k: '- ' || k), {NL}) || {NL} || {NL} ELSE '' END ELSE '' END || coalesce(lt.t, '') || '---' || {NL} || {NL}, '' ORDER BY t.block_no) AS body
FROM tb t LEFT JOIN par p ON p.source_id = t.source_id AND p.top_no = t.block_no LEFT JOIN lt ON lt.source_id = t.source_id AND lt.top_no = t.block_no GROUP BY t.source_id)""",
    f"counts AS (SELECT source_id, count(*) AS n, sum({tokens('text')}) AS words FROM aligned GROUP BY source_id)",
]

#: What is said around a frame, as the best one or two sentences.
BAG = f"list_distinct(list_filter(string_split_regex(lower(%s), '{WS}'), lambda w: w <> ''))"
CUT = "CASE WHEN length({0}) > 200 THEN rtrim(left({0}, 197)) || '...' ELSE {0} END"
CAPTIONS = [
    'mid AS (SELECT *, (start + "end") / 2 AS mid, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS rn FROM aligned)',
    "centre AS (SELECT o.source_id, frame_id, ts, arg_min(rn, (abs(mid - ts), mid, rn)) AS c FROM obs o JOIN mid m ON m.source_id = o.source_id GROUP BY ALL)",
    f"around AS (SELECT c.source_id, frame_id, ts, seq, mid, regexp_replace(replace(text, {NL}, ' '), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS text FROM centre c JOIN mid m ON m.source_id = c.source_id AND rn BETWEEN c - 3 AND c + 3)",
    f"seven AS (SELECT source_id, frame_id, ts, list({{'text': text, 'mid': mid, 'bag': {BAG % 'text'}}} ORDER BY seq) AS w, string_agg(text, ' ' ORDER BY seq) AS joined FROM around WHERE text <> '' GROUP BY ALL)",
    f"said AS (SELECT *, list_filter({strict('joined')}, lambda s: length(s) > 10) AS s FROM seven)",
    f"""worth AS (SELECT *, list_transform(list_sort(list_transform(s, lambda x, i: {{'neg': -round(coalesce(list_max(list_transform(w, lambda y: len(list_intersect({BAG % 'x'}, y.bag)) / (1.0::DOUBLE + abs(y.mid - ts)))), 0.0), 9), 'i': i, 's': x}})), lambda z: z.s) AS r FROM said)""",
    "best AS (SELECT *, CASE WHEN length(r[1] || ' ' || r[2]) <= 200 THEN r[1] || ' ' || r[2] ELSE r[1] END AS b0 FROM worth)",
    f"""caps AS MATERIALIZED (SELECT source_id, frame_id, ts, CASE WHEN len(s) > 0 THEN {CUT.format("(CASE WHEN regexp_matches(b0, '[.!?]$') THEN b0 ELSE b0 || '.' END)")} ELSE {CUT.format('joined')} END AS caption FROM best)""",
]
WEIGHT = "CASE WHEN length({0}) > 5 THEN 2 ELSE 1 END"
BOTH = f"coalesce(list_sum(list_transform(list_intersect(a, b), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))) * {WEIGHT.format('w')})), 0)"
ALL = f"list_sum(list_transform(a, lambda w: {WEIGHT.format('w')})) + list_sum(list_transform(b, lambda w: {WEIGHT.format('w')}))"
#: Key points matched to frames, best first, each used once.
MATCHED = [
    "kp AS (SELECT source_id, section_id, start, \"end\", unnest(key_points) AS point, unnest(range(len(key_points)))::INT AS point_no FROM sections)",
    f"mt0 AS (SELECT k.source_id, k.section_id, point_no, s.frame_id, s.ts, start, \"end\", s.content_score, {caption_tokens('point')} AS a, {caption_tokens('caption')} AS b FROM kp k JOIN shots s ON s.source_id = k.source_id AND s.section_id = k.section_id JOIN caps c ON c.source_id = s.source_id AND c.frame_id = s.frame_id)",
    'mt1 AS (SELECT *, greatest(1 - abs(ts - (start + "end") / 2) / greatest("end" - start, 1.0), 0.0) AS prox FROM mt0)',
    f"mt2 AS (SELECT *, round(CASE WHEN len(b) = 0 THEN 0.05 * prox ELSE CASE WHEN len(a) = 0 THEN 0.0 ELSE {BOTH}::DOUBLE / ({ALL} - {BOTH}) END + 0.02 * prox + 0.01 * coalesce(content_score, 0.0) END, 9) AS score FROM mt1)",
    "mt AS MATERIALIZED (SELECT source_id, section_id, list_sort(list({'neg': -score, 'point_no': point_no, 'ts': ts, 'frame_id': frame_id})) AS c FROM mt2 WHERE score >= 0.08 GROUP BY source_id, section_id)",
    """mf AS (SELECT source_id, section_id, 0 AS k, list_filter(c, lambda x: false) AS got FROM mt UNION ALL SELECT f.source_id, f.section_id, k + 1, CASE WHEN len(list_filter(got, lambda y: y.point_no = c[k + 1].point_no OR y.frame_id = c[k + 1].frame_id)) = 0 THEN list_append(got, c[k + 1]) ELSE got END
FROM mf f JOIN mt m ON m.source_id = f.source_id AND m.section_id = f.section_id WHERE k < len(c))""",
]
OUTLINE = f"""'[' || {time('start')} || '-' || {time('"end"')} || '] ' || heading || ': ' || main_idea || ' | Points: ' || array_to_string(key_points[1:4], '; ') || ' | Keywords: ' || array_to_string(keywords[1:8], ', ') || ' | Transition: ' || transition"""
CONTEXT = f"""tc0 AS (SELECT g.source_id, topic_no, arg_min({OUTLINE}, chunk_no) AS f, arg_max({OUTLINE}, chunk_no) AS l, array_to_string(list(heading ORDER BY chunk_no)[1:3], ' | ') AS h FROM grouped g JOIN summaries s USING (source_id, chunk_no) GROUP BY g.source_id, topic_no),
tc AS (SELECT source_id, topic_no, concat_ws({NL}, 'Focus: ' || h, 'Before: ' || lag(l) OVER w, 'After: ' || lead(f) OVER w) AS context FROM tc0 WINDOW w AS (PARTITION BY source_id ORDER BY topic_no))"""
CLEAR = "'Explain clearly, keep the steps of an argument and define terms where needed.'"
SECTION_ASK = f"'Write a section as JSON with heading, summary and key_points from this outline.' || {NL}"
PARENT_ASK = f"'Write the overview of a topic as JSON with heading, summary and key_points; introduce its parts without repeating them.' || {NL} || 'Give the main takeaway in few words and leave background out.'"
AT = f"""'[' || {time('s.start')} || '-' || {time('s."end"')} || ']'"""
RANK = f"""ask AS (SELECT s.source_id, s.section_id, 'Name the 2 frames that best show this section, best first.' || {NL} || heading || {NL} || array_to_string(key_points[1:4], {NL}) || {NL} || names AS prompt FROM sections s JOIN (SELECT source_id, section_id, string_agg('frame_' || pick_no, ', ' ORDER BY pick_no) AS names FROM picked GROUP BY source_id, section_id) n ON n.source_id = s.source_id AND n.section_id = s.section_id)"""
CTX = f"""ctx AS (SELECT source_id, chunk_no, start, "end", text, concat_ws({NL}, CASE WHEN b IS NOT NULL THEN 'Before: ' || {compact('b')} END, CASE WHEN a IS NOT NULL THEN 'After: ' || {compact('a')} END) AS context FROM (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a FROM chunks WINDOW w AS (PARTITION BY source_id ORDER BY chunk_no)))"""
#: The transcript lines of each section.
LINES = 'li AS (SELECT s.source_id, s.section_id, count(*)::INT AS n, string_agg(text, \' \' ORDER BY seq, a.start, text) AS said FROM sections s JOIN aligned a ON a.source_id = s.source_id AND a."end" > s.start AND a.start < s."end" GROUP BY s.source_id, s.section_id)'


def ranked(hits: str) -> str:
    """Frames of the sections for which ``hits`` holds by the ranking frame_2, frame_0; of the others by their own order."""
    return f"SELECT source_id, section_id, {NUMBERED}, frame_id, ts FROM picked p WHERE CASE WHEN {hits} THEN pick_no IN (0, 2) ELSE pick_no < 2 END"


ORACLES: dict[str, str] = {
    "b3_quarantine": q("frames", "SELECT source_id, frame_id, CASE WHEN ts + size - 100 >= ts THEN CASE WHEN size / 200 BETWEEN 0 AND 1 THEN 'none' ELSE 'score out of bounds' END ELSE 'end before start' END AS reason FROM frames"),
    "f4_candidates": q("sections obs", "SELECT source_id, section_id, pick_no, frame_id, ts, round(score, 6) AS score FROM picked", PICKED),
    "f3_section_frames": q("sections obs", "SELECT source_id, section_id, frame_no, frame_id, ts FROM kept", PICKED, KEPT),
    "c14_ranked": q("sections obs", ranked("source_id % 2 = 0"), PICKED),
    "n3_ranker": q("sections obs", ranked("EXISTS (SELECT 1 FROM ask WHERE ask.source_id = p.source_id AND ask.section_id = p.section_id AND length(prompt) % 3 > 0)"), PICKED, RANK),
    "e14_slots": q("sections obs", "SELECT source_id, section_id, frame_id, slot FROM slots", PICKED, KEPT, SLOTS),
    "g3_effective": q("sections obs", "SELECT source_id, section_id, frame_id, path, ts FROM (SELECT *, row_number() OVER (PARTITION BY source_id, section_id, path, round(ts * 10) ORDER BY p, ts, frame_id) AS rn FROM eff) WHERE rn = 1", PICKED, KEPT, SHOTS,
                      "eff AS (SELECT source_id, section_id, frame_id, path, ts, 0 AS p FROM shots UNION ALL SELECT f.source_id, s.parent_id, frame_id, path, ts, 1 FROM shots f JOIN sections s ON s.source_id = f.source_id AND s.section_id = f.section_id AND parent_id IS NOT NULL WHERE (SELECT count(*) FROM shots o WHERE o.source_id = f.source_id AND o.section_id = s.parent_id) < 2)"),
    "k1_notes_md": q("sections obs execs meta", "SELECT * FROM notes", PICKED, KEPT, SLOTS, CONTENTS, NOTES),
    "k2_transcript_md": q("sections obs meta", f"""SELECT m.source_id, concat_ws({NL}, '# ' || title || ' — Full Transcript', '', '**Channel:** ' || channel || '  ', '**Duration:** ' || {human('duration_seconds')} || '  ', '**Segments:** ' || n || ' | **Words:** ' || words || '  ', '', '---', '', '## Sections', '', contents, '')
|| {NL} || regexp_replace(body, '\\s+$', '') || {NL} AS transcript_md FROM meta m JOIN counts USING (source_id) JOIN tt USING (source_id) JOIN contents USING (source_id)""", PICKED, KEPT, SHOTS, CONTENTS, *TRANSCRIPT),
    "f6_captions": q("aligned obs", "SELECT * FROM caps", *CAPTIONS),
    "c15_match_points": q("sections obs", "SELECT source_id, section_id, unnest(got).point_no AS point_no, unnest(got).frame_id AS frame_id, round(-unnest(got).neg, 6) AS score FROM (SELECT source_id, section_id, arg_max(got, k) AS got FROM mf GROUP BY source_id, section_id)", PICKED, KEPT, SHOTS, *CAPTIONS, *MATCHED),
    "k7_bundle": q("meta", "SELECT source_id, 'doc_' || source_id || '__a_b___' || source_id AS out_key, title || ': a/b ?' AS title, channel FROM meta"),
    "e10_topic_context": q("grouped", "SELECT * FROM tc", CONTEXT),
    "k8_leaf_prompts": q("chunks", f"""SELECT source_id, chunk_no, 'leaf' AS kind, {SECTION_ASK} || 'Teach: build intuition, link each step to the one before, say why each idea matters.' || CASE WHEN context <> '' THEN {NL} || context ELSE '' END || {NL} || {NL} || {AT} || {NL} || '- [' || {time('s.start')} || '] ' || left(text, 2500) AS prompt FROM ctx s""", CTX),
    "k8_parent_prompts": q("sections", f"""SELECT s.source_id, s.section_id, 'parent' AS kind, {PARENT_ASK} || {NL} || context || {NL} || {NL} || {AT} || {NL} || kids AS prompt FROM sections s JOIN kl ON kl.source_id = s.source_id AND kl.section_id = s.section_id JOIN tc ON tc.source_id = s.source_id AND topic_no = s.ord
UNION ALL SELECT s.source_id, section_id, 'topic', {SECTION_ASK} || {CLEAR} || coalesce({NL} || context, '') || {NL} || {NL} || {AT} || ' ' || heading || ': ' || summary FROM sections s LEFT JOIN tc ON tc.source_id = s.source_id AND parent_id IS NULL AND topic_no = ord""", CONTEXT,
                           f"kl AS (SELECT source_id, parent_id AS section_id, string_agg('- ' || {AT} || ' ' || heading || ': ' || summary, {NL} ORDER BY ord) AS kids FROM sections s WHERE parent_id IS NOT NULL GROUP BY source_id, parent_id)"),
    "k8_section_prompts": q("sections obs execs", f"""SELECT source_id, section_id, 'topic' AS kind, {SECTION_ASK} || {CLEAR} || {NL} || {NL} || {AT} || ' ' || heading || ': ' || summary AS prompt FROM sections s UNION ALL SELECT source_id, section_id, 'rank', prompt FROM ask
UNION ALL SELECT source_id, NULL, 'executive', 'Write an executive summary as JSON with executive_summary and highlights from these sections.' || {NL} || {NL} || executive_summary FROM execs""", PICKED, RANK),
    "h4_payload_sections": q("sections meta", """SELECT s.source_id, title, s.section_id, heading, array_to_string(key_points, ' | ') AS key_points, coalesce(n, 0)::INT AS n_lines, coalesce(said, '') AS said FROM sections s JOIN meta m USING (source_id) LEFT JOIN li ON li.source_id = s.source_id AND li.section_id = s.section_id""", LINES),
}


def outlined(sql: str) -> str:
    """The same over the three levels of ``outline``: ordered by path, indented and marked by depth."""
    for old, new in (("sections", "outline"), ("CASE WHEN parent_id IS NULL THEN '' ELSE '  ' END", "repeat('  ', depth)"), ("CASE WHEN parent_id IS NULL THEN '## ' ELSE '### ' END", "repeat('#', least(depth + 2, 6)) || ' '"), ("ORDER BY section_id", "ORDER BY path"), ("ORDER BY s.section_id", "ORDER BY s.path")):
        sql = sql.replace(old, new)
    return sql


def blocks(depth: int) -> list[str]:
    """Blocks of so many levels (x), the sections that are divided further (par), and what is said and shown in the others."""
    out, k = ['span AS (SELECT source_id, arg_min(start, seq) AS r0, arg_max("end", seq) AS r1 FROM aligned GROUP BY source_id)', "tops AS (SELECT * FROM outline WHERE parent_id IS NULL)"], "source_id, path"
    for d in range(depth):
        out.append(tiled(f"t{d}", f"par{d - 1}" if d else "span", f"kids{d}" if d else "tops", k if d else "source_id"))
        out.append(f"x{d} AS MATERIALIZED (SELECT source_id, {'list_append(path, block_no)' if d else '[block_no]'} AS path, a, b, section_id FROM t{d})")
        out.append(f'par{d} AS MATERIALIZED (SELECT x.source_id, x.path, s.section_id, s.start AS r0, s."end" AS r1, heading, summary, key_points FROM x{d} x JOIN outline s ON s.source_id = x.source_id AND s.section_id = x.section_id WHERE EXISTS (SELECT 1 FROM outline k WHERE k.source_id = s.source_id AND k.parent_id = s.section_id))')
        out.append(f'kids{d + 1} AS (SELECT p.source_id, p.path, k.section_id, k.start, k."end" FROM par{d} p JOIN outline k ON k.source_id = p.source_id AND k.parent_id = p.section_id)')
    leaf = " UNION ALL ".join(f"SELECT *, '{'#' * min(d + 2, 6)} ' AS mark FROM x{d} x WHERE NOT EXISTS (SELECT 1 FROM par{d} p WHERE p.source_id = x.source_id AND p.path = x.path)" for d in range(depth))
    head = " UNION ALL ".join(f"SELECT source_id, path, '{'#' * min(d + 2, 6)} ' || heading || {NL} || {NL} || {times('r0', 'r1')} || CASE WHEN coalesce(summary, '') <> '' THEN summary || {NL} || {NL} ELSE '' END || CASE WHEN len(key_points) > 0 THEN array_to_string(list_transform(key_points, lambda p: '- ' || p), {NL}) || {NL} || {NL} ELSE '' END AS t FROM par{d}" for d in range(depth))
    return out + [
        f"lb AS MATERIALIZED (SELECT x.*, coalesce(s.heading, 'Transcript ' || {time('a')}) AS heading FROM ({leaf}) x LEFT JOIN outline s ON s.source_id = x.source_id AND s.section_id = x.section_id)",
        f'ln AS (SELECT l.source_id, l.path, l.section_id, seq, x.start, x."end", text, lag(x."end") OVER (PARTITION BY l.source_id, l.path ORDER BY x.start, seq) AS prev FROM lb l JOIN span p ON p.source_id = l.source_id JOIN aligned x ON x.source_id = l.source_id AND x.start >= a AND (x.start < b OR (b = r1 AND x.start <= b)))',
        "lc AS (SELECT *, coalesce(EXISTS (SELECT 1 FROM shots f WHERE f.source_id = ln.source_id AND f.section_id = ln.section_id AND f.ts BETWEEN prev - 1.0 AND ln.start + 1.0), false) AS cut FROM ln)",
        f"ld AS (SELECT *, sum(cut::INT) OVER (PARTITION BY {k} ORDER BY start, seq ROWS UNBOUNDED PRECEDING) AS no FROM lc)",
        f"bl AS (SELECT {k}, no, arg_min(start, (start, seq)) AS a, arg_max(\"end\", (start, seq)) AS b, string_agg(text, ' ' ORDER BY start, seq) AS said FROM ld GROUP BY {k}, no)",
        "pl AS (SELECT l.source_id, l.path, f.ts, f.frame_id, f.path AS file, coalesce(min(CASE WHEN f.ts <= bl.b + 1.5 THEN no END), max(no), -1) AS no FROM lb l JOIN shots f ON f.source_id = l.source_id AND f.section_id = l.section_id LEFT JOIN bl ON bl.source_id = l.source_id AND bl.path = l.path GROUP BY ALL)",
        f"pm AS (SELECT {k}, no, string_agg({picture('file')} || {NL} || {NL}, '' ORDER BY ts, frame_id) AS md FROM pl GROUP BY {k}, no)",
        f"bt AS (SELECT bl.source_id, bl.path, string_agg('**[' || {time('bl.a')} || ']**' || {NL} || {NL} || said || {NL} || {NL} || coalesce(md, ''), '' ORDER BY bl.no) AS t FROM bl LEFT JOIN pm ON pm.source_id = bl.source_id AND pm.path = bl.path AND pm.no = bl.no GROUP BY bl.source_id, bl.path)",
        f"tx AS (SELECT l.source_id, l.path, mark || heading || {NL} || {NL} || {times('l.a', 'l.b')} || coalesce(t, '') || coalesce(md, '') AS t FROM lb l LEFT JOIN bt ON bt.source_id = l.source_id AND bt.path = l.path LEFT JOIN pm ON pm.source_id = l.source_id AND pm.path = l.path AND pm.no = -1 UNION ALL {head})",
        f"tt AS (SELECT source_id, string_agg(t || '---' || {NL} || {NL}, '' ORDER BY no) AS body FROM (SELECT source_id, path[1] AS no, string_agg(t, '' ORDER BY path) AS t FROM tx GROUP BY source_id, path[1]) GROUP BY source_id)",
        TRANSCRIPT[-1],
    ]


DEEP = [outlined(x) for x in (PICKED, KEPT, SHOTS)]
ORACLES |= {
    "h1_leaves_deep": q("outline", "SELECT source_id, section_id, (row_number() OVER (PARTITION BY source_id ORDER BY ord) - 1)::INT AS leaf_no FROM outline WHERE depth = 2"),
    "h4_payload_deep": q("outline meta", "SELECT x.source_id, x.depth, coalesce(p.heading, title) AS above, (row_number() OVER (PARTITION BY x.source_id, x.depth, x.parent_id ORDER BY x.ord) - 1)::INT AS place, x.section_id, x.heading, coalesce(n, 0)::INT AS n_lines, coalesce(said, '') AS said FROM outline x JOIN meta m ON m.source_id = x.source_id LEFT JOIN outline p ON p.source_id = x.source_id AND p.section_id = x.parent_id LEFT JOIN li ON li.source_id = x.source_id AND li.section_id = x.section_id", outlined(LINES)),
    "k1_notes_md_deep": q("outline obs execs meta", "SELECT * FROM notes", *DEEP, *(outlined(x) for x in (SLOTS, CONTENTS, NOTES))),
    "k2_transcript_md_deep": q("outline obs meta", outlined(ORACLES["k2_transcript_md"][ORACLES["k2_transcript_md"].rindex("SELECT m.source_id") :]).replace("## Outline", "## Sections"), *DEEP, outlined(CONTENTS), *blocks(3)),
    "c9_active_section_deep": q("outline playback", "SELECT viewer_event, source_id, section_id FROM (SELECT p.viewer_event, p.source_id, coalesce(c.section_id, b.section_id, a.section_id) AS section_id, row_number() OVER (PARTITION BY viewer_event ORDER BY a.ord NULLS LAST, b.ord NULLS LAST, c.ord NULLS LAST) AS rn FROM playback p" + "".join(f' LEFT JOIN outline {x} ON {x}.source_id = p.source_id AND {x}.depth = {d} AND {x}.start <= t AND t < {x}."end"' + (f" AND {x}.parent_id = {up}.section_id" if up else "") for d, (x, up) in enumerate((("a", ""), ("b", "a"), ("c", "b")))) + ") WHERE rn = 1"),
    "g3_effective_deep": q("outline obs", "SELECT source_id, section_id, frame_id, path, ts FROM (SELECT *, row_number() OVER (PARTITION BY source_id, section_id, path, round(ts * 10) ORDER BY p, ts, frame_id) AS rn FROM eff) WHERE rn = 1", *DEEP,
                           "own AS (SELECT * FROM shots WHERE frame_id % 3 = 0)", "up AS (SELECT source_id, section_id, parent_id AS above FROM outline WHERE depth > 0 UNION ALL SELECT x.source_id, x.section_id, p.parent_id FROM outline x JOIN outline p ON p.source_id = x.source_id AND p.section_id = x.parent_id WHERE x.depth = 2)",
                           "eff AS (SELECT source_id, section_id, frame_id, path, ts, 0 AS p FROM own UNION ALL SELECT f.source_id, above, frame_id, path, ts, 1 FROM own f JOIN up ON up.source_id = f.source_id AND up.section_id = f.section_id WHERE (SELECT count(*) FROM own o WHERE o.source_id = f.source_id AND o.section_id = above) < 2)"),
}



KEYED = "'doc_' || n.source_id || '_' || n.source_id AS out_key"
ORACLES |= {
    "a8_library_files": f"SELECT {KEYED}, 'doc ' || source_id AS title, notes_md AS notes FROM ({ORACLES['k1_notes_md']}) n",
    "k7_documents": f"""SELECT {KEYED}, 'notes.md' AS file, notes_md AS content FROM ({ORACLES['k1_notes_md']}) n UNION ALL SELECT {KEYED}, 'transcript.txt', transcript_txt FROM ({BASE['k3_transcript_txt']}) n
UNION ALL SELECT {KEYED}, 'metadata.json', to_json({{'video_id': n.source_id::VARCHAR, 'title': n.title, 'channel': channel, 'duration_seconds': duration_seconds, 'description': '', 'word_count': word_count, 'language': 'en'}})::VARCHAR FROM ({BASE['k4_metadata_json']}) n JOIN ({q('meta', 'SELECT * FROM meta')}) m ON m.source_id = n.source_id""",
    "c4_containment_sections": q("sections", """SELECT l.source_id, x.seq, l.block_no, l.section_id FROM tb l JOIN span p ON p.source_id = l.source_id JOIN aligned x ON x.source_id = l.source_id AND x.start >= a AND (x.start < b OR (b = r1 AND x.start <= b))""", *TRANSCRIPT[:3]),
    # The document as text: a section's JSON without its last brace, its lines if it has any, then the sections below it.
    "h4_payload": q("sections meta", """SELECT m.source_id, '{"title":' || to_json(title)::VARCHAR || ',"sections":[' || string_agg(j || coalesce(',"subsections":[' || kids || ']', '') || '}', ',' ORDER BY ord, w.section_id) || ']}' AS payload
FROM meta m JOIN whole w ON w.source_id = m.source_id AND parent_id IS NULL LEFT JOIN (SELECT source_id, parent_id AS section_id, string_agg(j || '}', ',' ORDER BY ord, section_id) AS kids FROM whole WHERE parent_id IS NOT NULL GROUP BY source_id, parent_id) k ON k.source_id = w.source_id AND k.section_id = w.section_id GROUP BY m.source_id, title""",
                    'sl AS (SELECT s.source_id, s.section_id, list({\'seq\': seq, \'start\': a.start, \'text\': text} ORDER BY seq, a.start, text) AS l FROM sections s JOIN aligned a ON a.source_id = s.source_id AND a."end" > s.start AND a.start < s."end" GROUP BY s.source_id, s.section_id)',
                    """whole AS (SELECT s.source_id, s.section_id, parent_id, ord, rtrim(to_json({'ord': ord, 'section_id': s.section_id, 'sec_start': s.start, 'sec_end': s."end", 'heading': heading, 'summary': summary, 'key_points': key_points})::VARCHAR, '}') || coalesce(',"lines":' || to_json(l)::VARCHAR, '') AS j FROM sections s LEFT JOIN sl ON sl.source_id = s.source_id AND sl.section_id = s.section_id)"""),
}
