"""DuckDB's SQL for the registered queries."""

from __future__ import annotations

from chronotext.plans.ctes import NOISE, compact, ends, human, nearest, oracle, placeholder, sentences, space, time, tokens, topic_tokens, caption_tokens

COMPOSITE = "llm_score * 0.7 + visual_score * 0.3"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
SCORED = f"""scored AS (SELECT *, {COMPOSITE} AS composite_score FROM (SELECT c.*, coalesce(s.llm_score * (1 + chunk_no % 4) / 4, 0.5) AS llm_score, 0.0 AS visual_score FROM chunks c LEFT JOIN scores s ON s.source_id = c.source_id))"""
TOPS = "tops AS (SELECT source_id, section_id, sec_start AS start, sec_end AS \"end\" FROM secs WHERE parent_id IS NULL)"
TIMELINE = """span AS (SELECT source_id, arg_min(start, seq) AS r0, arg_max("end", seq) AS r1 FROM aligned GROUP BY source_id),
t1 AS (SELECT t.*, r0, r1, least(t."end", coalesce(lead(t.start) OVER w, r1), r1) AS stop FROM tops t JOIN span USING (source_id) WINDOW w AS (PARTITION BY t.source_id ORDER BY t.start, t."end", section_id)),
t2 AS (SELECT *, coalesce(max(greatest(r0, start, stop)) OVER (PARTITION BY source_id ORDER BY start, "end", section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r0) AS cur FROM t1),
t3 AS (SELECT source_id, cur AS a, least(greatest(cur, start), r1) AS b, NULL AS section_id FROM t2 UNION ALL SELECT source_id, least(greatest(cur, start), r1), stop, section_id FROM t2
UNION ALL SELECT source_id, max(greatest(r0, start, stop)), max(r1), NULL FROM t2 GROUP BY source_id),
blocks AS (SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY a) - 1)::INT AS block_no, a AS block_start, b AS block_end, section_id FROM t3 WHERE b > a)"""
BREAKS = """br AS (SELECT a.*, coalesce(EXISTS (SELECT 1 FROM frames f WHERE f.source_id = a.source_id AND f.ts BETWEEN a.prev - 1.0 AND a.start + 1.0), false) AS breaks FROM (SELECT *, lag("end") OVER (PARTITION BY source_id ORDER BY start, seq) AS prev FROM aligned) a)"""
BLURBS = BREAKS + f""", bn AS (SELECT *, sum(breaks::INT) OVER (PARTITION BY source_id ORDER BY start, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS blurb_no FROM br),
blurbs AS (SELECT source_id, blurb_no, arg_min(start, seq) AS start, arg_max("end", seq) AS "end", string_agg(text, ' ' ORDER BY start, seq) AS text FROM bn GROUP BY source_id, blurb_no)"""
POINTS_T = """tp AS (SELECT DISTINCT source_id, t FROM (SELECT source_id, unnest([start, (start + "end") / 2, CASE WHEN "end" - start > 15 THEN "end" - 5 END]) AS t FROM chunks) WHERE t IS NOT NULL)"""
CHUNK_COLS = "source_id, chunk_no, chunk_id, text, start, \"end\", token_count, array_to_string(seqs, ',') AS segment_indices"
PAIRS = "pairs AS (SELECT a.source_id, a.seq, a.text, b.text AS other FROM aligned a JOIN aligned b ON a.source_id = b.source_id AND b.seq = a.seq + 1)"
#: Proximity dedup follows the last row kept, so it is a recursion over a source's rows in order.
DEDUP = """dn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts, frame_id) AS rn FROM frames),
dd AS (SELECT source_id, rn, frame_id, ts, size, 1 AS slot FROM dn WHERE rn = 1 UNION ALL
SELECT n.source_id, n.rn, CASE WHEN n.ts - d.ts >= 3.0 OR n.size > d.size THEN n.frame_id ELSE d.frame_id END, CASE WHEN n.ts - d.ts >= 3.0 OR n.size > d.size THEN n.ts ELSE d.ts END,
CASE WHEN n.ts - d.ts >= 3.0 OR n.size > d.size THEN n.size ELSE d.size END, CASE WHEN n.ts - d.ts >= 3.0 THEN d.slot + 1 ELSE d.slot END FROM dd d JOIN dn n ON n.source_id = d.source_id AND n.rn = d.rn + 1)"""
GEN = f"""gen AS (SELECT source_id, chunk_no, CASE WHEN chunk_no % 3 = 0 THEN 'tbd' ELSE 'Made ' || heading END AS heading, main_idea, transition, CASE WHEN chunk_no % 4 = 1 THEN ['...'] ELSE key_points END AS key_points FROM summaries),
judged AS (SELECT *, NOT {placeholder('heading')} AND NOT {placeholder('main_idea')} AND len(list_filter(key_points, lambda p: NOT {placeholder('p')})) > 0 AS is_valid FROM gen)"""
ANSWERS = " UNION ALL ".join(f"SELECT conv_id, turn, {p} AS priority, 'model{p}' AS provider, CASE WHEN (conv_id + turn) % {m} = 0 THEN 'failed' END AS error FROM responses" for p, m in ((0, 2), (1, 3), (2, 5)))
BODY = "regexp_replace(coalesce(body, ''), '^[ \t\n\r\"'']+|[ \t\n\r\"'']+$', '', 'g')"
SCORES = rf"""ms AS (SELECT conv_id, turn, {BODY} AS b FROM responses),
mt AS (SELECT *, CASE WHEN regexp_matches(b, '^-?{NUMBER}$') THEN greatest(0.0, least(1.0, b::DOUBLE)) END AS s1,
CASE WHEN regexp_matches(b, '^\{{') AND regexp_matches(json_extract_string(CASE WHEN json_valid(b) THEN b END, '$.score'), '^-?{NUMBER}$') THEN greatest(0.0, least(1.0, json_extract_string(CASE WHEN json_valid(b) THEN b END, '$.score')::DOUBLE)) END AS s2,
nullif(regexp_extract(lower(b), '(?:score|importance|rating|value)[: \t\n=]+({NUMBER})', 1), '')::DOUBLE AS n3, list_transform(regexp_extract_all(b, '{NUMBER}'), lambda x: x::DOUBLE) AS ns FROM ms),
mined AS (SELECT conv_id, turn, coalesce(s1, s2, CASE WHEN n3 > 1 THEN least(1.0, n3 / 10) ELSE n3 END, list_filter(ns, lambda x: x <= 1)[1], CASE WHEN len(ns) > 0 THEN least(1.0, ns[1] / 10) END, 0.5) AS score,
CASE WHEN s1 IS NOT NULL THEN 1 WHEN s2 IS NOT NULL THEN 2 WHEN n3 IS NOT NULL THEN 3 WHEN len(list_filter(ns, lambda x: x <= 1)) > 0 THEN 4 WHEN len(ns) > 0 THEN 5 ELSE 0 END AS rule FROM mt)"""

SCORE_ASK = "'Rate from 0 to 1 how much this passage matters to someone learning the subject. Answer with the number.' || chr(10) || chr(10)"


def q(names: str, select: str, *more: str) -> str:
    """An oracle over shared tables and tables of its own."""
    base = oracle(names.split(), "")
    own = ",\n".join(more)
    return (base.rstrip("\n") + (",\n" if own and base else "") + own if base else ("WITH " + own if own else "")) + "\n" + select


def near(points: str, keys: str, at: str, obs: str, tol: float | None) -> str:
    return f"nb AS ({nearest(points, keys, at, obs, tol, 'frame_id, ts, scene_diff')})"


ORACLES: dict[str, str] = {
    "a1_captions": q("segments", f"""SELECT source_id, seq, start, round(start + round("end" - start, 3), 6) AS "end", {ends('text')} AS text, 'youtube_manual' AS origin FROM segments WHERE {ends('text')} <> ''"""),
    "a2_asr": q("segments", f"""SELECT source_id, seq, start, "end", {ends('text')} AS text, -(seq % 10) / 10.0::DOUBLE AS confidence, 'en' AS language, 'whisper' AS origin FROM segments"""),
    "a3_transcript_json": q("aligned", """SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1)::INT AS seq, start, "end", text, 'whisper' AS origin, 'en' AS language FROM aligned"""),
    "a4_transcript_text": q("aligned", "SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY start, seq) + 1)::INT AS seq, floor(start)::INT AS start, text FROM aligned"),
    "a7_sources": """SELECT doc_id::VARCHAR AS video_id, CASE WHEN doc_id % 5 <> 0 THEN 'doc ' || doc_id ELSE 'Untitled' END AS title, coalesce(CASE WHEN doc_id % 3 = 1 THEN nullif(source, '') END, CASE WHEN doc_id % 2 = 0 THEN nullif(lang, '') END, 'Unknown') AS channel,
coalesce(CASE WHEN doc_id % 4 <> 0 THEN n_chars END, 0)::DOUBLE AS duration_seconds, '20240101' AS upload_date, left(coalesce(text, ''), 500) AS description FROM documents""",
    "a9_lookup": q("meta", "SELECT path, source_id FROM (SELECT 'doc_' || source_id || '_' || source_id AS path, source_id FROM meta) WHERE contains(path, '_7') ORDER BY path LIMIT 1"),
    "b1_noise": q("segments", f"SELECT * FROM segments WHERE NOT regexp_matches(text, '{NOISE}')"),
    "b2_whitespace": q("segments", f"""SELECT source_id, seq, {space('text')} AS text, start, "end" FROM segments WHERE {space('text')} <> ''"""),
    "b3_bounds": q("frames", "SELECT source_id, frame_id, size - 100 >= 0 AND ts + size - 100 >= ts AND size / 200 BETWEEN 0 AND 1 AS is_valid FROM frames"),
    "b4_derived": q("segments", 'SELECT source_id, seq, round("end" - start, 6) AS duration, round((start + "end") / 2, 6) AS midpoint FROM segments'),
    "b5_importance": q("chunks scores", "SELECT source_id, chunk_no, composite_score >= 0.4 AS is_important FROM scored", SCORED),
    "b6_composite": q("frames scores", f"SELECT source_id, frame_id, round({COMPOSITE}, 6) AS composite_score, {COMPOSITE} >= 0.4 AS is_important FROM (SELECT s.source_id, frame_id, llm_score, least(scene_diff, 1.0) AS visual_score FROM scores s JOIN frames USING (source_id))"),
    "b7_placeholder": q("segments", f"SELECT source_id, seq, {placeholder('t')} AS is_placeholder FROM (SELECT *, CASE seq % 7 WHEN 0 THEN ' TBD ' WHEN 1 THEN '. - .' WHEN 2 THEN 'N/A' ELSE text END AS t FROM segments)"),
    "b8_validity": q("summaries", "SELECT source_id, chunk_no, is_valid FROM judged", GEN),
    "b9_fallback": q("summaries", "SELECT s.source_id, s.chunk_no, CASE WHEN is_valid THEN j.heading ELSE s.heading END AS heading, s.main_idea, s.transition, is_valid AS was_generated FROM summaries s JOIN judged j USING (source_id, chunk_no)", GEN),
    "b10_metadata": "SELECT doc_id AS source_id, left(coalesce(text, ''), 500) AS description, NULL::INT AS word_count FROM documents",
    "c1_nearest": q("mids frames", "SELECT source_id, chunk_no, coalesce(frame_id, -1) AS frame_id, coalesce(ts, -1.0) AS ts FROM nb", near("mids", "source_id, chunk_no", "midpoint", "frames", 5.0)),
    "c2_within": q("chunks obs", 'SELECT c.source_id, chunk_no, frame_id, ts, round(content_score, 6) AS content_score FROM chunks c JOIN obs o ON o.source_id = c.source_id AND ts BETWEEN start - 3 AND "end" + 3'),
    "c3_overlap": q("secs", 'SELECT a.source_id, seq, section_id FROM aligned a JOIN secs s ON s.source_id = a.source_id AND parent_id IS NULL AND "end" > sec_start AND start < sec_end'),
    "c4_containment": q("secs", """SELECT a.source_id, seq, block_no FROM aligned a JOIN blocks b ON a.source_id = b.source_id JOIN span s ON s.source_id = a.source_id WHERE start >= block_start AND (start < block_end OR (block_end = r1 AND start <= block_end))""", TOPS, TIMELINE),
    "c5_anti": q("chunks frames", "SELECT * FROM tp WHERE NOT EXISTS (SELECT 1 FROM frames f WHERE f.source_id = tp.source_id AND abs(f.ts - tp.t) < 3)", POINTS_T),
    "c6_visual": q("mids frames", "SELECT source_id, chunk_no, round(greatest(0.0, least(1.0, scene_diff)), 6) AS visual_score FROM nb WHERE scene_diff IS NOT NULL", near("mids", "source_id, chunk_no", "midpoint", "frames", 15.0)),
    "c7_merge": q("mids scores frames", f"""SELECT s.source_id, s.chunk_no, round(v, 6) AS visual_score, round(llm_score * 0.7 + v * 0.3, 6) AS composite_score FROM (SELECT s.*, CASE WHEN n.scene_diff IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, n.scene_diff)) END AS v FROM scored s JOIN nb n USING (source_id, chunk_no)) s""", SCORED, near("mids", "source_id, chunk_no", "midpoint", "frames", 15.0)),
    "c8_e7_boundaries": q("bounds", "SELECT source_id, chunk_no, round(boundary_score, 6) AS boundary_score FROM bounds"),
    "c9_active_section": q("secs playback", """SELECT p.viewer_event, p.source_id, coalesce(arg_min(k.section_id, k.ord), any_value(top_id)) AS section_id FROM (SELECT viewer_event, p.source_id, p.t, arg_min(section_id, ord) AS top_id FROM playback p LEFT JOIN secs s ON s.source_id = p.source_id AND parent_id IS NULL AND sec_start <= t AND t < sec_end GROUP BY ALL) p
LEFT JOIN secs k ON k.source_id = p.source_id AND k.parent_id = p.top_id AND k.sec_start <= p.t AND p.t < k.sec_end GROUP BY p.viewer_event, p.source_id"""),
    "c10_active_line": q("aligned playback", """SELECT viewer_event, p.source_id, coalesce(max(CASE WHEN start - 0.12 <= t AND t < "end" + 0.12 THEN seq END), arg_min(CASE WHEN abs(t - (start + "end") / 2) <= 1.5 THEN seq END, CASE WHEN abs(t - (start + "end") / 2) <= 1.5 THEN abs(t - (start + "end") / 2) * 1e6 + seq * 1e-3 END), -1) AS line_seq
FROM playback p LEFT JOIN aligned a ON a.source_id = p.source_id GROUP BY viewer_event, p.source_id"""),
    "c11_blurb_breaks": q("aligned frames", "SELECT source_id, seq, breaks FROM br", BREAKS),
    "c12_origin": q("aligned", "SELECT source_id, seq, CASE WHEN source_id % 3 = 0 THEN 'youtube_manual' ELSE 'whisper' END AS origin FROM aligned"),
    "c13_first_success": q("responses", f"SELECT r.conv_id, r.turn, arg_min(provider, priority) AS provider, CASE WHEN count(provider) = 0 THEN 'all providers failed' END AS error FROM responses r LEFT JOIN an ON an.conv_id = r.conv_id AND an.turn = r.turn AND an.error IS NULL GROUP BY r.conv_id, r.turn", f"an AS ({ANSWERS})"),
    "c16_neighbours": q("aligned playback", """SELECT viewer_event, c.source_id, r.seq FROM (SELECT viewer_event, p.source_id, arg_min(rn, abs(t - mid) * 1e6 + rn * 1e-3) AS c FROM playback p JOIN rows USING (source_id) GROUP BY ALL) c JOIN rows r ON r.source_id = c.source_id AND r.rn BETWEEN c.c - 3 AND c.c + 3""", 'rows AS (SELECT *, (start + "end") / 2 AS mid, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS rn FROM aligned)'),
    "d1_stats": q("aligned", f"""SELECT source_id, sum({tokens('text')})::BIGINT AS word_count, count(*) AS n_segments, arg_max("end", seq) AS duration FROM aligned GROUP BY source_id"""),
    "d2_full_text": q("aligned", "SELECT source_id, string_agg(text, ' ' ORDER BY seq) AS full_text FROM aligned GROUP BY source_id"),
    "d4_totals": q("chunks", "SELECT source_id, sum(token_count)::BIGINT AS total_tokens, count(*) AS n_chunks FROM chunks GROUP BY source_id"),
    "d5_above": q("chunks scores", "SELECT source_id, count(*) FILTER (composite_score >= 0.4) AS n_above, count(*) AS n_total FROM scored GROUP BY source_id", SCORED),
    "d6_section_count": q("leaf", "SELECT source_id, count(*) AS section_count FROM leaf GROUP BY source_id"),
    "d7_content_score": q("obs", "SELECT source_id, frame_id, round(content_score, 6) AS content_score FROM obs"),
    "d8_library_stats": q("meta frames", "SELECT m.source_id, count(frame_id) AS n_frames, m.source_id % 2 = 0 AS has_transcript, m.source_id % 3 = 0 AS has_viewer FROM meta m LEFT JOIN frames f ON f.source_id = m.source_id GROUP BY m.source_id"),
    "d9_context_length": "SELECT conv_id, (coalesce(length(any_value(d.text)), 0) + sum(length(c.text)) + 4)::BIGINT AS context_length FROM conversations c LEFT JOIN documents d ON d.doc_id = conv_id GROUP BY conv_id",
    "d10_topics": q("grouped", """SELECT source_id, 'topic_' || lpad(topic_no::VARCHAR, 4, '0') AS topic_id, arg_min(start, chunk_no) AS start, arg_max("end", chunk_no) AS "end", string_agg(chunk_id, ',' ORDER BY chunk_no) AS chunk_ids, round(arg_max(coalesce(boundary_score, 0.0), chunk_no), 6) AS boundary_strength FROM grouped JOIN chunks USING (source_id, chunk_no) GROUP BY source_id, topic_no"""),
    "d11_rollup": q("sections", "SELECT source_id, parent_id, list(heading ORDER BY ord)[1] AS heading, trim(array_to_string(list(summary ORDER BY ord)[1:2], ' ')) AS summary, array_to_string(list(heading ORDER BY ord)[1:5], ' | ') AS key_points FROM sections WHERE parent_id IS NOT NULL GROUP BY source_id, parent_id"),
    "e1_fill_gaps": q("aligned", "SELECT * FROM aligned"),
    "e2_chunk_tokens": q("chunks", f"SELECT {CHUNK_COLS} FROM chunks"),
    "e3_chunk_sentences": q("schunks", f"SELECT {CHUNK_COLS} FROM schunks"),
    "e4_hybrid": q("hybrid", "SELECT * FROM hybrid"),
    "e5_overlap_suffix": q("aligned", f"SELECT source_id, seq, tail_tokens FROM (SELECT *, sum({tokens('text')}) OVER (PARTITION BY source_id ORDER BY start DESC, seq DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS tail_tokens FROM aligned) WHERE tail_tokens <= 40"),
    "e6_numbering": q("chunks", "SELECT source_id, chunk_no, chunk_id FROM chunks"),
    "e8_topic_groups": q("grouped", "SELECT source_id, chunk_no, pos, topic_no FROM grouped"),
    "e9_partition": q("parts", "SELECT source_id, chunk_no, topic_no, sub_no FROM parts"),
    "e10_context": q("chunks", f"""SELECT source_id, chunk_no, concat_ws(chr(10), CASE WHEN b IS NOT NULL THEN 'Before: ' || {compact('b')} END, CASE WHEN a IS NOT NULL THEN 'After: ' || {compact('a')} END) AS context
FROM (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a FROM chunks WINDOW w AS (PARTITION BY source_id ORDER BY chunk_no))"""),
    "e11_dedup_near": q("frames", "SELECT source_id, arg_max(frame_id, rn) AS frame_id, arg_max(ts, rn) AS ts, arg_max(size, rn) AS size FROM dd GROUP BY source_id, slot", DEDUP),
    "e12_timeline": q("secs", "SELECT * FROM blocks", TOPS, TIMELINE),
    "e13_blurbs": q("aligned frames", f"SELECT *, {time('start')} AS label FROM blurbs", BLURBS),
    "e15_placement": q("aligned frames", 'SELECT f.source_id, frame_id, ts, coalesce(min(CASE WHEN ts <= b."end" + 1.5 THEN blurb_no END), max(blurb_no)) AS blurb_no FROM frames f JOIN blurbs b ON b.source_id = f.source_id GROUP BY ALL', BLURBS),
    "e17_history": f"""SELECT conv_id, coalesce(string_agg(CASE WHEN {ends('text')} <> '' THEN CASE WHEN lower(trim(role)) = 'user' THEN 'User: ' ELSE 'Assistant: ' END || {ends('text')} END, chr(10) ORDER BY turn), '') AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3 GROUP BY conv_id""",
    "f1_top_k": q("obs", "SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY ts, frame_id) - 1)::INT AS frame_no, frame_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY content_score DESC, ts, frame_id) AS rn FROM obs) WHERE rn <= 10"),
    "f2_detail": q("chunks scores", """SELECT source_id, chunk_no FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS n, row_number() OVER (PARTITION BY source_id ORDER BY composite_score DESC, start, "end", chunk_no) AS rn
FROM (SELECT *, max(composite_score >= 0.4) OVER (PARTITION BY source_id) AS hit FROM scored) WHERE composite_score >= 0.4 OR NOT hit) WHERE rn <= greatest(1, n // 4)""", SCORED),
    "g1_union": q("chunks frames", """SELECT source_id, frame_id, ts FROM prim UNION ALL SELECT source_id, frame_id, ts FROM nb WHERE frame_id IS NOT NULL""", POINTS_T,
                  "prim AS (SELECT * FROM frames WHERE scene_diff > 0.25 UNION ALL SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, floor(ts / 30) ORDER BY ts, frame_id) AS rn FROM frames f WHERE NOT EXISTS (SELECT 1 FROM frames g WHERE g.source_id = f.source_id AND g.scene_diff > 0.25)) WHERE rn = 1)",
                  "far AS (SELECT * FROM tp WHERE NOT EXISTS (SELECT 1 FROM prim f WHERE f.source_id = tp.source_id AND abs(f.ts - tp.t) < 3))", near("far", "source_id, t", "t", "frames", None)),
    "g2_transitions": q("chunks", "SELECT * FROM tp", POINTS_T),
    "g4_jaccard": q("aligned", "SELECT source_id, seq, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM sets", PAIRS, f"sets AS (SELECT source_id, seq, {topic_tokens('text')} AS a, {topic_tokens('other')} AS b FROM pairs)"),
    "g5_weighted_jaccard": q("aligned", """SELECT s.source_id, s.seq, round(CASE WHEN len(s.a) = 0 OR len(s.b) = 0 THEN 0.0 ELSE lo / hi END, 6) AS similarity FROM sets s LEFT JOIN (SELECT source_id, seq, sum(least(na, nb) * w)::DOUBLE AS lo, sum(greatest(na, nb) * w)::DOUBLE AS hi FROM (
SELECT source_id, seq, x, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb, CASE WHEN length(x) > 5 THEN 2 ELSE 1 END AS w FROM (SELECT source_id, seq, unnest(a) AS x, 0 AS side FROM sets UNION ALL SELECT source_id, seq, unnest(b), 1 FROM sets) GROUP BY source_id, seq, x) GROUP BY source_id, seq) c ON c.source_id = s.source_id AND c.seq = s.seq""",
                             PAIRS, f"sets AS (SELECT source_id, seq, {caption_tokens('text')} AS a, {caption_tokens('other')} AS b FROM pairs)"),
    "h1_leaves": q("leaf", "SELECT source_id, section_id, leaf_no::INT AS leaf_no FROM leaf"),
    "h2_sections": q("sections", "SELECT source_id, section_id, parent_id, ord, start, \"end\", heading, summary, array_to_string(key_points, ' | ') AS key_points, array_to_string(chunk_ids, ',') AS chunk_ids FROM sections"),
    "h3_cut_list": q("leaf", 'SELECT source_id, section_id, start, "end", round("end" - start, 6) AS duration FROM leaf'),
    "i1_scores": q("responses", "SELECT conv_id, turn, round(score, 6) AS score, rule FROM mined", SCORES),
    "i5_strip_reasoning": q("responses", rf"""SELECT conv_id, turn, {ends(r"regexp_replace(regexp_replace(regexp_replace(body, '(?is)<think>.*?</think>', '', 'g'), '(?is)^reasoning\s*:.*?(?:\n\s*\n|$)', '', 'g'), '(?is)^thoughts?\s*:.*?(?:\n\s*\n|$)', '', 'g')")} AS answer FROM responses"""),
    "i6_chunk_fallback": q("summaries", "SELECT source_id, chunk_no, heading, main_idea, array_to_string(key_points, ' | ') AS key_points, array_to_string(keywords, ',') AS keywords, transition FROM summaries"),
    "i7_topic_fallback": q("sections", "SELECT source_id, topic_no, heading, summary, array_to_string(CASE WHEN len(kp) > 0 THEN kp[1:5] ELSE [lead_idea] END, ' | ') AS key_points FROM wh"),
    "i8_section_fallback": q("chunks", f"""SELECT source_id, chunk_no, 'Section at ' || {time('start')} AS heading, left(CASE WHEN ends_with(two, '.') THEN two ELSE two || '.' END, 500) AS summary, array_to_string(s[2:5], ' | ') AS key_points
FROM (SELECT *, array_to_string(s[1:2], '. ') AS two FROM (SELECT source_id, chunk_no, start, CASE WHEN len({sentences('text')}) > 0 THEN {sentences('text')} ELSE [left({ends('text')}, 300)] END AS s FROM chunks))"""),
    "i9_exec_fallback": q("execs", "SELECT * FROM execs"),
    "i10_exec_assembly": q("summaries", "SELECT source_id, string_agg(main_idea, ' ' ORDER BY chunk_no) || chr(10) || chr(10) || '**Key highlights:**' || chr(10) || string_agg('- ' || heading, chr(10) ORDER BY chunk_no) AS executive_summary FROM summaries GROUP BY source_id"),
    "c3_overlap_sections": q("sections", 'SELECT a.source_id, seq, section_id FROM aligned a JOIN sections s ON s.source_id = a.source_id AND a."end" > s.start AND a.start < s."end"'),
    "i_rule_report": q("responses", "SELECT rule, count(*) AS n FROM mined GROUP BY rule", SCORES),
    "k3_transcript_txt": q("meta", f"""SELECT m.source_id, '# ' || any_value(title) || chr(10) || '# Channel: ' || any_value(channel) || '  |  Duration: ' || {human('any_value(duration_seconds)')} || chr(10) || '# Source: whisper  |  Language: en' || chr(10) || '# Segments: ' || count(*) || '  |  Words: ' || sum({tokens('text')}) || chr(10) || chr(10) || string_agg('[' || {time('start')} || '] ' || text, chr(10) ORDER BY start, seq) || chr(10) AS transcript_txt FROM meta m JOIN aligned a ON a.source_id = m.source_id GROUP BY m.source_id"""),
    "k4_metadata_json": q("meta", f"SELECT m.source_id, any_value(title) AS title, '' AS description, sum({tokens('text')})::BIGINT AS word_count FROM meta m JOIN aligned a ON a.source_id = m.source_id GROUP BY m.source_id"),
    "k6_script": q("leaf execs", """SELECT source_id, regexp_replace(regexp_replace(any_value(executive_summary), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '(?m)^- ', '', 'g') || chr(10) || chr(10) || string_agg('Section: ' || heading, '. ' ORDER BY leaf_no) || chr(10) || chr(10) || string_agg(heading || '. ' || summary, chr(10) || chr(10) ORDER BY leaf_no) || chr(10) || chr(10) || string_agg(heading || '. ' || array_to_string(key_points, '. '), chr(10) || chr(10) ORDER BY leaf_no) AS script FROM leaf JOIN execs USING (source_id) GROUP BY source_id"""),
    "k7_bundle_keys": q("meta", "SELECT source_id, 'doc_' || source_id || '__a_b___' || source_id AS out_key FROM meta"),
    "m1_by_interval": q("frames", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, floor(ts / 30) ORDER BY ts, frame_id) AS rn FROM frames) WHERE rn = 1"),
    "m2_by_change": q("frames", "SELECT * FROM frames WHERE scene_diff > 0.25 UNION ALL SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, floor(ts / 30) ORDER BY ts, frame_id) AS rn FROM frames f WHERE NOT EXISTS (SELECT 1 FROM frames g WHERE g.source_id = f.source_id AND g.scene_diff > 0.25)) WHERE rn = 1"),
    "m3_at_points": q("mids frames", "SELECT source_id, chunk_no, frame_id, ts FROM nb WHERE frame_id IS NOT NULL", near("mids", "source_id, chunk_no", "midpoint", "frames", None)),
    "n2_token_counter": q("aligned", 'SELECT source_id, sum(ceil(length(text) / 4))::BIGINT AS word_count, count(*) AS n_segments, arg_max("end", seq) AS duration FROM aligned GROUP BY source_id'),
    "a5_notes_sections": q("sections", f"""SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY section_id) - 1)::INT AS section_no, CASE WHEN parent_id IS NULL THEN 2 ELSE 3 END AS level, {ends('heading')} AS heading, {ends('summary')} AS summary, array_to_string(list_transform(key_points, lambda k: {ends('k')}), ' | ') AS key_points FROM sections"""),
    "a6_exec_summary": q("execs", f"SELECT source_id, {ends('executive_summary')} AS executive_summary FROM execs"),
    "a8_library": q("meta", "SELECT 'out/' || source_id || '/notes.md' AS path, title FROM meta"),
    "k8_prompts": q("chunks", f"""SELECT source_id, chunk_no, 'score' AS kind, {SCORE_ASK} || left(text, 800) AS prompt FROM chunks UNION ALL SELECT source_id, chunk_no, 'chunk', 'Summarise this passage as JSON with heading, main_idea, key_points, keywords and transition (continue, shift or conclusion).' || chr(10) || 'Give the main takeaway in few words and leave background out.' || chr(10) || context || chr(10) || chr(10) || left(text, 3000) FROM ctx""",
                    f"""ctx AS (SELECT source_id, chunk_no, text, concat_ws(chr(10), CASE WHEN b IS NOT NULL THEN 'Before: ' || {compact('b')} END, CASE WHEN a IS NOT NULL THEN 'After: ' || {compact('a')} END) AS context FROM (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a FROM chunks WINDOW w AS (PARTITION BY source_id ORDER BY chunk_no)))"""),
    "n1_infer": q("chunks", "SELECT source_id, chunk_no, CASE WHEN n % 11 <> 0 THEN '0.' || (n % 10) END AS body, CASE WHEN n % 11 = 0 THEN 'ValueError: bad prompt' END AS error FROM asked", f"asked AS (SELECT source_id, chunk_no, length({SCORE_ASK} || left(text, 800)) AS n FROM chunks)"),
    "n3_scorer": q("chunks", "SELECT source_id, chunk_no, CASE WHEN n % 11 <> 0 THEN (n % 10) / 10.0::DOUBLE ELSE 0.5 END AS score, CASE WHEN n % 11 <> 0 THEN 1 ELSE 0 END AS rule FROM asked", f"asked AS (SELECT source_id, chunk_no, length({SCORE_ASK} || left(text, 800)) AS n FROM chunks)"),
    "m4_observe": q("chunks frames", """SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY ts, frame_id) - 1)::INT AS frame_no, frame_id, ts, round(content_score, 6) AS content_score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY content_score DESC, ts, frame_id) AS best FROM (
SELECT *, CASE WHEN max(size) OVER (PARTITION BY source_id) > 0 THEN least(1.0::DOUBLE, size / max(size) OVER (PARTITION BY source_id)) ELSE 0.0 END AS content_score FROM (SELECT source_id, arg_max(frame_id, rn) AS frame_id, arg_max(ts, rn) AS ts, arg_max(size, rn) AS size FROM dd GROUP BY source_id, slot))) WHERE best <= 12""", POINTS_T,
                    "prim AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, floor(ts / 10) ORDER BY ts, frame_id) AS rn FROM frames) WHERE rn = 1)",
                    "far AS (SELECT * FROM tp WHERE NOT EXISTS (SELECT 1 FROM prim f WHERE f.source_id = tp.source_id AND abs(f.ts - tp.t) < 3))",
                    f"nb AS ({nearest('far', 'source_id, t', 't', 'frames', None, 'frame_id, ts, size')})",
                    "bag AS (SELECT source_id, frame_id, ts, size FROM prim UNION ALL SELECT source_id, frame_id, ts, size FROM nb WHERE frame_id IS NOT NULL)", DEDUP.replace("FROM frames", "FROM bag")),
}
