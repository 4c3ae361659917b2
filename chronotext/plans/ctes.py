"""DuckDB's SQL for the derived tables that several oracles share."""

from __future__ import annotations

from chronotext.functions.text import CAPTION_STOPWORDS, CUE_PATTERN, PLACEHOLDERS, TOPIC_STOPWORDS
from chronotext.plans import inputs

WS = r"[ \t\n\r\f\x0B]+"
ENDS = r"^[ \t\n\r\f]+|[ \t\n\r\f]+$"
NOISE = r"^[ \t\n\r\f]*[\[\(][^\]\)]{1,30}[\]\)][ \t\n\r\f]*$"
MAX, OVERLAP, MIN, THRESHOLD = 120, 15, 30, 0.52


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens(text: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({text}, ''), '{WS}'), lambda w: w <> ''))"


def space(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}', ' ', 'g'))"


def ends(text: str) -> str:
    return f"regexp_replace({text}, '{ENDS}', '', 'g')"


def sentences(text: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda s: {ends('s')}), lambda s: s <> '')"


def time(seconds: str) -> str:
    s = f"floor({seconds})::BIGINT"
    return f"(CASE WHEN {s} >= 3600 THEN ({s} // 3600)::VARCHAR || ':' ELSE '' END || lpad(({s} % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({s} % 60)::VARCHAR, 2, '0'))"


def human(seconds: str) -> str:
    return f"CASE WHEN {seconds} >= 3600 THEN {time(seconds)} ELSE regexp_replace({time(seconds)}, '^0', '') END"


def compact(text: str, limit: int = 180) -> str:
    return f"CASE WHEN length({space(text)}) <= {limit} THEN {space(text)} ELSE rtrim(left({space(text)}, {limit - 3})) || '...' END"


def topic_tokens(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]{{3,}}'), lambda w: w NOT IN ({quoted(TOPIC_STOPWORDS)})))"


def all_tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]{{3,}}'), lambda w: w NOT IN ({quoted(TOPIC_STOPWORDS)}))"


def caption_tokens(text: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({text}), '[^a-z0-9 \t\n\r\f]', ' ', 'g'), '[ \t\n\r\f]+'), lambda w: length(w) > 1 AND w NOT IN ({quoted(CAPTION_STOPWORDS)}))"


def cue(text: str) -> str:
    return f"regexp_matches(lower({text}), '{CUE_PATTERN.replace(chr(39), chr(39) * 2)}')"


def placeholder(text: str) -> str:
    one = f"lower({space(f'coalesce({text}, chr(39)[1:0])')})".replace("chr(39)[1:0]", "''")
    return rf"({one} IN ({quoted(PLACEHOLDERS)}) OR regexp_matches({one}, '^[.\-• ]+$') OR length({one}) < 4)"


def suffix(lo: str, hi: str) -> str:
    """First index of the longest run that ends at ``hi`` with at most OVERLAP tokens; hi + 1 if none."""
    return f"coalesce(list_min(list_filter(range({lo}, {hi} + 1), lambda i: up[{hi} + 1] - up[i + 1] + tk[i + 1] <= {OVERLAP})), {hi} + 1)::INT"


def fold(at: str) -> str:
    over = f"(f.f0 < f.idx + 1 AND up[f.idx + 2] - up[f.f0 + 1] + tk[f.f0 + 1] > {MAX})"
    return f"""SELECT source_id, 0 AS idx, 0 AS f0, -1 AS carried, NULL::INT AS lo, NULL::INT AS hi FROM arr UNION ALL
SELECT source_id, idx + 1, CASE WHEN ov THEN {suffix('f0', 'cutat')} ELSE f0 END, CASE WHEN ov THEN cutat ELSE carried END, CASE WHEN ov THEN f0 END, CASE WHEN ov THEN cutat END
FROM (SELECT f.*, tk, up, {over} AS ov, ({at})::INT AS cutat FROM %s f JOIN arr USING (source_id) WHERE f.idx + 1 < n)"""


def cut(name: str) -> str:
    return f"""SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY lo, hi) - 1)::INT AS chunk_no, lo, hi FROM (
SELECT source_id, lo, hi FROM {name} WHERE lo IS NOT NULL UNION ALL SELECT f.source_id, f.f0, n - 1 FROM {name} f JOIN arr ON arr.source_id = f.source_id AND f.idx = n - 1) WHERE lo <= hi"""


def built(cuts: str) -> str:
    return f"""SELECT source_id, chunk_no, 'chunk_' || lpad(chunk_no::VARCHAR, 4, '0') AS chunk_id, text, start, "end", {tokens('text')} AS token_count, seqs FROM (
SELECT c.source_id, chunk_no, string_agg(text, ' ' ORDER BY idx) AS text, arg_min(start, idx) AS start, arg_max("end", idx) AS "end", list(seq ORDER BY idx) AS seqs
FROM counted c JOIN {cuts} k ON c.source_id = k.source_id AND idx BETWEEN lo AND hi GROUP BY c.source_id, chunk_no)"""


def nearest(points: str, keys: str, at: str, obs: str, tol: float | None, cols: str) -> str:
    """Points with columns of their nearest observation (null if none)."""
    keyed = ", ".join(f"p.{k}" for k in keys.split(", "))
    limit = f"AND abs(o.ts - p.{at}) <= {tol}" if tol is not None else ""
    on = " AND ".join(f"p.{k} = b.{k}" for k in keys.split(", "))
    return f"""SELECT p.*, {', '.join(f'b.{c}' for c in cols.split(', '))} FROM {points} p LEFT JOIN (
SELECT {keyed}, {', '.join(f'o.{c}' for c in cols.split(', '))}, row_number() OVER (PARTITION BY {keyed} ORDER BY abs(o.ts - p.{at}), o.ts, o.frame_id) AS rn
FROM {points} p JOIN {obs} o ON o.source_id = p.source_id {limit}) b ON {on} AND b.rn = 1"""


TOK = f"{topic_tokens('array_to_string(keywords, chr(32))')}"
CTES: dict[str, tuple[list[str], str]] = {
    "segments": ([], inputs.SEGMENTS),
    "frames": ([], inputs.FRAMES),
    "playback": ([], inputs.PLAYBACK),
    "scores": ([], inputs.SCORES),
    "responses": ([], inputs.RESPONSES),
    "deep": (["responses"], f"deep AS (SELECT conv_id, turn, {inputs.DEEP} AS body FROM responses)"),
    "aligned": (["segments"], f"""aligned AS MATERIALIZED (SELECT source_id, seq, text, start, CASE WHEN nx - "end" > 0 AND nx - "end" <= 2 THEN nx ELSE "end" END AS "end" FROM (
SELECT source_id, seq, {space('text')} AS text, start, "end", lead(start) OVER (PARTITION BY source_id ORDER BY start, seq) AS nx FROM segments WHERE NOT regexp_matches(text, '{NOISE}') AND {space('text')} <> ''))"""),
    "arr": (["aligned"], rf"""counted AS (SELECT *, (row_number() OVER w - 1)::INT AS idx, sum(tok) OVER (PARTITION BY source_id ORDER BY start, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
FROM (SELECT *, {tokens('text')} AS tok FROM aligned) WINDOW w AS (PARTITION BY source_id ORDER BY start, seq)),
arr AS (SELECT source_id, list(tok ORDER BY idx) AS tk, list(upto ORDER BY idx) AS up, list(regexp_matches(text, '[.!?]+[ \t\n\r\f]*$') ORDER BY idx) AS st, count(*)::INT AS n FROM counted GROUP BY source_id)"""),
    "chunks": (["arr"], f"tf AS ({fold('f.idx') % 'tf'}), tcut AS ({cut('tf')}), chunks AS MATERIALIZED ({built('tcut')})"),
    "schunks": (["arr"], f"sf AS ({fold('coalesce(list_max(list_filter(range(f.f0, f.idx + 1), lambda i: i > f.carried AND st[i + 1])), f.idx)') % 'sf'}), scut AS ({cut('sf')}), schunks AS MATERIALIZED ({built('scut')})"),
    "hybrid": (["schunks"], f"""h1 AS (SELECT *, sum(CASE WHEN token_count >= {MIN} OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY chunk_no ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chunk_no) AS rn FROM schunks)),
h2 AS (SELECT *, (CASE WHEN sum(CASE WHEN g = 1 THEN token_count ELSE 0 END) OVER (PARTITION BY source_id) < {MIN} AND g > 1 THEN g - 1 ELSE g END - 1)::INT AS no FROM h1),
hybrid AS (SELECT source_id, no AS chunk_no, 'chunk_' || lpad(no::VARCHAR, 4, '0') AS chunk_id, string_agg(text, ' ' ORDER BY chunk_no) AS text, arg_min(start, chunk_no) AS start, arg_max("end", chunk_no) AS "end", sum(token_count)::BIGINT AS token_count, string_agg(array_to_string(seqs, ','), ',' ORDER BY chunk_no) AS segment_indices FROM h2 GROUP BY source_id, no)"""),
    "obs": (["frames"], "obs AS MATERIALIZED (SELECT *, CASE WHEN max(size) OVER w > 0 THEN least(1.0::DOUBLE, size / max(size) OVER w) ELSE 0.0 END AS content_score, 'f' || frame_id AS path FROM frames WINDOW w AS (PARTITION BY source_id))"),
    "mids": (["chunks"], 'mids AS (SELECT source_id, chunk_no, (start + "end") / 2 AS midpoint FROM chunks)'),
    "secs": (["chunks"], """kidsec AS (SELECT source_id, chunk_id AS section_id, 'top_' || (chunk_no // 3) AS parent_id, chunk_no AS ord, start AS sec_start, "end" AS sec_end FROM chunks),
secs AS (SELECT * FROM kidsec UNION ALL SELECT source_id, parent_id, NULL, min(ord) // 3, min(sec_start), max(sec_end) FROM kidsec GROUP BY source_id, parent_id)"""),
    # Three levels: chunks, parts of three, two parts to a whole; depth tells them apart.
    "outline": (["summaries"], """o2 AS (SELECT s.source_id, c.chunk_id AS section_id, 'part_' || (s.chunk_no // 3) AS parent_id, s.chunk_no::BIGINT AS ord, s.start, s."end", heading, main_idea AS summary, key_points, 2 AS depth FROM summaries s JOIN chunks c ON c.source_id = s.source_id AND c.chunk_no = s.chunk_no),
o1 AS (SELECT source_id, parent_id AS section_id, 'whole_' || (min(ord) // 3 // 2) AS parent_id, min(ord) // 3 AS ord, min(start) AS start, max("end") AS "end", arg_min(heading, ord) AS heading, arg_min(summary, ord) AS summary, arg_min(key_points, ord) AS key_points, 1 AS depth FROM o2 GROUP BY source_id, o2.parent_id),
o0 AS (SELECT source_id, parent_id AS section_id, NULL::VARCHAR AS parent_id, min(ord) // 2 AS ord, min(start) AS start, max("end") AS "end", arg_min(heading, ord) AS heading, arg_min(summary, ord) AS summary, arg_min(key_points, ord) AS key_points, 0 AS depth FROM o1 GROUP BY source_id, o1.parent_id),
o9 AS (SELECT * FROM o2 UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o0),
outline AS MATERIALIZED (SELECT x.*, CASE x.depth WHEN 0 THEN [x.ord] WHEN 1 THEN [p.ord, x.ord] ELSE [g.ord, p.ord, x.ord] END AS path FROM o9 x LEFT JOIN o9 p ON p.source_id = x.source_id AND p.section_id = x.parent_id LEFT JOIN o9 g ON g.source_id = p.source_id AND g.section_id = p.parent_id)"""),
    "summaries": (["chunks"], f"""summaries AS MATERIALIZED (SELECT source_id, chunk_no, start, "end", CASE WHEN len(s) > 0 THEN left(s[1], 50) ELSE 'Chunk ' || {time('start')} END AS heading,
CASE WHEN len(s) > 0 THEN left(array_to_string(s[1:2], '. '), 300) ELSE left(text, 300) END AS main_idea, CASE WHEN len(s) > 0 THEN s[1:4] ELSE [left(text, 200)] END AS key_points,
list_filter(ft, lambda x, i: list_position(ft, x) = i)[1:6] AS keywords, CASE WHEN {cue('left(text, 250)')} THEN 'shift' ELSE 'continue' END AS transition FROM (SELECT *, {sentences('text')} AS s, {all_tokens('text')} AS ft FROM chunks))"""),
    "bounds": (["summaries", "obs"], f"""bs0 AS (SELECT s.source_id, s.chunk_no, s."end", s.transition, CASE WHEN len({TOK}) > 0 THEN {TOK} ELSE {topic_tokens("concat_ws(' ', heading, main_idea)")} END AS tok, {cue('left(c.text, 250)')} AS c, s.start FROM summaries s JOIN chunks c ON s.source_id = c.source_id AND s.chunk_no = c.chunk_no),
bs1 AS (SELECT *, lead(tok) OVER w AS n_tok, lead(transition) OVER w AS n_tr, lead(c) OVER w AS n_c, lead(start) OVER w AS n_start, ("end" + lead(start) OVER w) / 2 AS mid FROM bs0 WINDOW w AS (PARTITION BY source_id ORDER BY chunk_no)),
bs2 AS ({nearest('bs1', 'source_id, chunk_no', 'mid', 'obs', 4.0, 'scene_diff, content_score')}),
bounds AS MATERIALIZED (SELECT source_id, chunk_no, CASE WHEN mid IS NOT NULL THEN greatest(0.0, least(1.0,
0.45 * (1 - CASE WHEN len(list_distinct(list_concat(tok, n_tok))) = 0 THEN 1.0 ELSE len(list_intersect(tok, n_tok))::DOUBLE / len(list_distinct(list_concat(tok, n_tok))) END)
+ 0.30 * least(1.0, CASE WHEN transition = 'conclusion' THEN 0.6 ELSE 0 END + CASE WHEN n_tr = 'shift' THEN 0.8 ELSE 0 END + CASE WHEN n_c THEN 0.5 ELSE 0 END)
+ 0.10 * least(1.0, greatest(0.0, n_start - "end") / 4) + 0.15 * coalesce(nullif(scene_diff, 0), nullif(content_score, 0), 0))) END AS boundary_score FROM bs2)"""),
    "grouped": (["bounds"], f"""g1 AS (SELECT *, sum(CASE WHEN prev >= {THRESHOLD} THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY chunk_no ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(boundary_score) OVER (PARTITION BY source_id ORDER BY chunk_no) AS prev FROM bounds)),
g2 AS (SELECT *, row_number() OVER (PARTITION BY source_id, island ORDER BY chunk_no) - 1 AS p FROM g1),
grouped AS MATERIALIZED (SELECT source_id, chunk_no, boundary_score, (p % 4)::INT AS pos, (dense_rank() OVER (PARTITION BY source_id ORDER BY island, p // 4) - 1)::INT AS topic_no FROM g2)"""),
    # With at most four chunks a topic and three a part, a part ends before the third chunk if the second one turns, else before the fourth.
    "parts": (["grouped", "summaries"], """p0 AS (SELECT g.*, max(CASE WHEN pos = 1 THEN s.transition IN ('shift', 'conclusion') END) OVER (PARTITION BY source_id, topic_no) AS turn FROM grouped g JOIN summaries s USING (source_id, chunk_no)),
parts AS MATERIALIZED (SELECT source_id, chunk_no, boundary_score, pos, topic_no, CASE WHEN pos = 3 OR (pos = 2 AND turn) THEN 1 ELSE 0 END AS sub_no FROM p0)"""),
    "sections": (["parts", "summaries"], """ss AS MATERIALIZED (SELECT p.source_id, p.topic_no, p.sub_no, p.chunk_no, c.chunk_id, c.start, c."end", heading, main_idea, key_points FROM parts p JOIN summaries s USING (source_id, chunk_no) JOIN chunks c ON c.source_id = p.source_id AND c.chunk_no = p.chunk_no),
wh0 AS MATERIALIZED (SELECT source_id, topic_no, list_sort(list({'no': chunk_no, 'start': start, 'stop': "end", 'heading': heading, 'main_idea': main_idea, 'kp': key_points, 'id': chunk_id})) AS l FROM ss GROUP BY source_id, topic_no),
wh AS MATERIALIZED (SELECT source_id, topic_no, l[1].start AS start, l[-1].stop AS "end", len(l) AS n, l[1].heading AS heading, trim(array_to_string(list_transform(l[1:2], lambda x: x.main_idea), ' ')) AS summary,
 flatten(list_transform(l[1:4], lambda x: x.kp[1:1])) AS kp, l[1].main_idea AS lead_idea, list_transform(l, lambda x: x.id) AS ids FROM wh0),
su0 AS MATERIALIZED (SELECT source_id, topic_no, sub_no, list_sort(list({'no': chunk_no, 'start': start, 'stop': "end", 'heading': heading, 'main_idea': main_idea, 'kp': key_points, 'id': chunk_id})) AS l FROM ss GROUP BY source_id, topic_no, sub_no),
su AS MATERIALIZED (SELECT source_id, topic_no, sub_no, l[1].start AS start, l[-1].stop AS "end", len(l) AS n, l[1].heading AS heading, trim(array_to_string(list_transform(l[1:2], lambda x: x.main_idea), ' ')) AS summary,
 flatten(list_transform(l[1:4], lambda x: x.kp[1:1])) AS kp, l[1].main_idea AS lead_idea, list_transform(l, lambda x: x.id) AS ids FROM su0),
kid AS (SELECT su.* FROM su JOIN wh USING (source_id, topic_no) WHERE wh.n > 3),
up AS (SELECT source_id, topic_no, list(heading ORDER BY sub_no)[1] AS heading, trim(array_to_string(list(summary ORDER BY sub_no)[1:2], ' ')) AS summary, list(heading ORDER BY sub_no)[1:5] AS kp FROM kid GROUP BY source_id, topic_no),
sections AS MATERIALIZED (SELECT source_id, 'section_' || lpad(topic_no::VARCHAR, 4, '0') AS section_id, NULL::VARCHAR AS parent_id, topic_no::BIGINT AS ord, start, "end", heading, summary, CASE WHEN len(kp) > 0 THEN kp[1:5] ELSE [lead_idea] END AS key_points, ids AS chunk_ids FROM wh WHERE n <= 3
UNION ALL SELECT source_id, 'section_' || lpad(topic_no::VARCHAR, 4, '0') || '_' || lpad(sub_no::VARCHAR, 2, '0'), 'section_' || lpad(topic_no::VARCHAR, 4, '0'), sub_no, start, "end", heading, summary, CASE WHEN len(kp) > 0 THEN kp[1:5] ELSE [lead_idea] END, ids FROM kid
UNION ALL SELECT wh.source_id, 'section_' || lpad(wh.topic_no::VARCHAR, 4, '0'), NULL, wh.topic_no, start, "end", up.heading, up.summary, up.kp, ids FROM wh JOIN up USING (source_id, topic_no) WHERE wh.n > 3)"""),
    "leaf": (["sections"], "leaf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY section_id) - 1 AS leaf_no FROM sections s WHERE NOT EXISTS (SELECT 1 FROM sections k WHERE k.source_id = s.source_id AND k.parent_id = s.section_id))"),
    "execs": (["leaf"], f"""execs AS (SELECT source_id, 'This video covers ' || count(*) || ' sections:' || chr(10) || string_agg('- **' || heading || '** (' || {time('start')} || '): ' || left(summary, 120), chr(10) ORDER BY leaf_no) AS executive_summary FROM leaf GROUP BY source_id)"""),
    "meta": (["aligned"], """meta AS (SELECT source_id, 'doc ' || source_id AS title, 'src' || (source_id % 7) AS channel, max("end") AS duration_seconds, '2024' || lpad((source_id % 12 + 1)::VARCHAR, 2, '0') || lpad((source_id % 28 + 1)::VARCHAR, 2, '0') AS upload_date, source_id::VARCHAR AS video_id FROM aligned GROUP BY source_id)"""),
}


def oracle(names: list[str], select: str) -> str:
    """``select`` behind the shared tables ``names`` and all that they build on."""
    out: list[str] = []

    def add(n):
        for d in CTES[n][0]:
            add(d)
        if CTES[n][1] not in out:
            out.append(CTES[n][1])

    for n in names:
        add(n)
    return ("WITH RECURSIVE " + ",\n".join(out) + "\n" if out else "") + select
