"""Sections of any depth, and balanced objects, against plain Python."""

import json
import random

from pyspark.sql import functions as F

from chronotext.functions.objects import balanced
from chronotext.operators import docs, infer, sample, timejoin, topics, tree


def nested(rng, depth, start, end, name):
    """A section with up to three below it, each inside its time, and so on down."""
    kids, at = [], start
    for k in range(rng.randrange(4) if depth else 0):
        a = at + rng.randrange(0, 3)
        b = a + rng.randrange(1, 12)
        if b > end:
            break
        kids.append(nested(rng, depth - 1, a, b, f"{name}.{k}"))
        at = b - rng.randrange(0, 2)
    return {"id": name, "start": float(start), "end": float(end), "kids": kids}


def rows_of(source, tops):
    def walk(node, parent, ord):
        yield (source, node["id"], parent, ord, node["start"], node["end"], f"H{node['id']}", "S", ["k"])
        for k, kid in enumerate(node["kids"]):
            yield from walk(kid, node["id"], k)

    for k, top in enumerate(tops):
        yield from walk(top, None, k)


DDL = "source_id long, section_id string, parent_id string, ord long, start double, end double, heading string, summary string, key_points array<string>"


def depth_first(nodes):
    for n in nodes:
        yield n
        yield from depth_first(n["kids"])


def active(nodes, t):
    for n in nodes:
        if n["start"] <= t < n["end"]:
            return active(n["kids"], t) or n["id"]
    return None


def test_trees_of_any_depth(spark):
    rng = random.Random(7)
    sources = {s: [nested(rng, 5, 40 * k, 40 * k + 40, f"{k}") for k in range(12)] for s in range(3)}
    data = [r for s, tops in sources.items() for r in rows_of(s, tops)] + [(9, "lost", "nowhere", 0, 0.0, 1.0, "x", "x", []), (9, "a", "b", 0, 0.0, 1.0, "x", "x", []), (9, "b", "a", 0, 0.0, 1.0, "x", "x", [])]
    sections = spark.createDataFrame(data, DDL).repartition(3)
    found = tree.paths(sections)
    assert tree.deepest(found) >= 4 and found.filter("source_id = 9").count() == 0
    got = {s: [r.section_id for r in found.filter(F.col("source_id") == s).orderBy("path").collect()] for s in sources}
    assert got == {s: [n["id"] for n in depth_first(tops)] for s, tops in sources.items()}
    leaf = topics.leaves(sections).orderBy("source_id", "leaf_no").collect()
    assert [(r.source_id, r.section_id) for r in leaf] == [(s, n["id"]) for s, tops in sources.items() for n in depth_first(tops) if not n["kids"]]
    pos = [(k, s, t / 4) for s in sources for k, t in enumerate(range(s, 2000, 37))]
    at = timejoin.active_section(spark.createDataFrame(pos, "k int, source_id long, t double"), sections.withColumnsRenamed({"start": "sec_start", "end": "sec_end"}), ["k"]).collect()
    assert {(r.k, r.source_id): r.section_id for r in at} == {(k, s): active(sources[s], t) for k, s, t in pos}
    shots = [(s, n["id"], i, f"p{rng.randrange(9)}", float(rng.randrange(50))) for s, tops in sources.items() for i, n in enumerate(depth_first(tops)) if rng.random() < 0.7]
    own = spark.createDataFrame(shots, "source_id long, section_id string, frame_id int, path string, ts double")
    got = {(r.source_id, r.section_id, r.path, r.ts) for r in sample.effective(own, tree.beneath(own, sections), ["source_id", "section_id"]).collect()}
    want = set()
    for s, tops in sources.items():
        for n in depth_first(tops):
            mine = {x[3:] for x in shots if x[:2] == (s, n["id"])}
            if sum(x[:2] == (s, n["id"]) for x in shots) < 2:
                mine |= {x[3:] for x in shots if x[0] == s and x[1] in {m["id"] for m in depth_first(n["kids"])}}
            want |= {(s, n["id"], *x) for x in mine}
    assert got == want
    meta = spark.createDataFrame([(s, f'T "{s}"') for s in [*sources, 9]], "source_id long, title string")
    lines = spark.createDataFrame([(0, 0, 1.0, 2.0, "said")], "source_id long, seq int, start double, end double, text string")
    plain = lambda n: {"id": n["section_id"], "kids": [plain(k) for k in n.get("subsections", [])]}
    shape = lambda n: {"id": n["id"], "kids": [shape(k) for k in n["kids"]]}
    payloads = {r.source_id: json.loads(r.payload) for r in docs.nested_payload(meta, sections, lines).collect()}
    assert {s: [plain(n) for n in p["sections"]] for s, p in payloads.items()} == {s: [shape(n) for n in tops] for s, tops in sources.items()}
    assert payloads[1]["title"] == 'T "1"' and docs.nested_payload(meta, sections.limit(0), lines).count() == 0


def slow_balanced(text):
    """Each brace in turn, scanned to its end."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "{":
            depth, inside, skip = 0, False, False
            for j in range(i, len(text)):
                c = text[j]
                if skip:
                    skip = False
                elif c == "\\":
                    skip = inside
                elif c == '"':
                    inside = not inside
                elif not inside and c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        out.append(text[i : j + 1])
                        i = j
                        break
        i += 1
    return out


def test_balanced_objects(spark):
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice('{}{}"\\ax') for _ in range(rng.randrange(30)))
        assert balanced(text) == slow_balanced(text), text
    assert balanced("{" * 200_000) == [] and balanced("{" * 100_000 + "}") == ["{}"] and len(balanced('{"a": {}} ' * 50_000)) == 50_000
    bodies = ['{"score": 0.8} more', 'x {"heading":"a {b","summary":"s"} y', '{"a":{"b":{"c":{"d":{"e":1}}}}}', r'{"text": "curly \"{\" brace"}', "none", None, '{"a": 1} text {"b": 2} {bad}']
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = {}
    for r in infer.json_objects(df).orderBy("k", "object_no").collect():
        got.setdefault(r.k, []).append(json.loads(r.object))
    assert got == {0: [{"score": 0.8}], 1: [{"heading": "a {b", "summary": "s"}], 2: [{"a": {"b": {"c": {"d": {"e": 1}}}}}], 3: [{"text": 'curly "{" brace'}], 6: [{"a": 1}, {"b": 2}]}


def test_answers_from_traces(spark):
    cases = [
        ("Let me think... 0.8\n{'score': 0.8}\nWait:\n" + json.dumps({"score": 0.75}), '{"score": 0.75}', 4),
        (json.dumps({"score": 0.5}) + "\nthen\n" + json.dumps({"heading": "Intro", "summary": "An intro."}), json.dumps({"heading": "Intro", "summary": "An intro."}), 5),
        ('After: {"heading": "T", "metadata": {"source": "c {1"}}\nDone.', '{"heading": "T", "metadata": {"source": "c {1"}}', 5),
        ('{"x": 1} {"y": {"z": 2}} {}', '{"y": {"z": 2}}', 3),
        ('{"score": "0.4"} {"z": 2}', '{"z": 2}', 3),
        ("Moderate.\nScore: 0.65\n", '{"score": 0.65}', 2),
        ("Hmm, fairly important.\n0.72", '{"score": 0.72}', 1),
        ("0.72" + "x" * 300 + "\nNo output here.\nJust this last line.", "Just this last line.", 0),
        ("", "", 0),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "k int, body string")
    got = {r.k: (r.answer, r.rule) for r in infer.answer_from_trace(df, ["k"]).collect()}
    assert got == {i: (a, rule) for i, (_, a, rule) in enumerate(cases)}
