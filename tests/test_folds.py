"""Chunk cuts and proximity dedup against plain loops."""

import random

from chronotext.operators import sample
from chronotext.operators.chunk import Cuts, chunk_sentences, chunk_tokens


def slow_cuts(rows, most, overlap, at_stops):
    """Segment by segment: rows are (tokens, ends a sentence)."""
    held, total, carried, out = [], 0, 0, []
    for i, (tokens, stop) in enumerate(rows):
        if held and total + tokens > most:
            cut = max((k + 1 for k in range(carried, len(held)) if held[k][1]), default=len(held)) if at_stops else len(held)
            out.append([h[2] for h in held[:cut]])
            first, room = cut, overlap
            while first and held[first - 1][0] <= room:
                first -= 1
                room -= held[first][0]
            held, carried = held[first:], cut - first
            total = sum(h[0] for h in held)
        held.append((tokens, stop, i))
        total += tokens
    return [*out, [h[2] for h in held]] if held else out


def test_cuts_by_search():
    rng = random.Random(1)
    for _ in range(5000):
        rows = [(rng.choice([0, 1, 2, 3, 5, 30]) if rng.random() < 0.9 else 80, rng.random() < 0.3) for _ in range(rng.randrange(40))]
        most, overlap, at_stops = rng.randrange(1, 60), rng.randrange(40), rng.random() < 0.5
        cuts, got, at = Cuts(most, overlap, at_stops), [], 0
        places = [(i // 7, i % 7) for i in range(len(rows))]
        while at < len(rows):
            to = at + rng.randrange(1, 15)
            got += list(cuts.add([t for t, _ in rows[at:to]], [s for _, s in rows[at:to]], places[at:to]))
            at = to
            if rng.random() < 0.3:
                cuts.forget()
        got += list(cuts.rest())
        assert got == [(no, sorted({x // 7 for x in c}), c[0] % 7, c[-1] % 7) for no, c in enumerate(slow_cuts(rows, most, overlap, at_stops))]


def test_chunks_of_a_hot_source(spark):
    """Many cells, ties in time, gaps of years, null texts; one source has nearly all rows."""
    rng, data, at = random.Random(4), [], 0.0
    for i in range(1500):
        at += rng.choice([0.0, 0.0, 1.0, 5.0, 300.0, 4e7 if i == 700 else 2.0])
        data.append((1, i, at, at + 1.0, None if i % 50 == 7 else " ".join(rng.choice(["a", "bc", "end."]) for _ in range(rng.randrange(9)))))
    data += [(2, 0, 5.0, 6.0, "x y."), (3, 0, None, None, "no time"), (3, 1, 1.0, 2.0, "then")]
    df = spark.createDataFrame(data, "source_id long, seq int, start double, end double, text string").repartition(5)
    for at_stops, make in ((False, chunk_tokens), (True, chunk_sentences)):
        got = {(r.source_id, r.chunk_no): (r.text, r.start, r.end, list(r.segment_indices)) for r in make(df, 40, 9).collect()}
        want = {}
        for source in (1, 2, 3):
            own = sorted((d for d in data if d[0] == source), key=lambda d: (d[2] is not None, d[2] or 0, d[1]))
            rows = [(len((d[4] or "").split()), (d[4] or "").endswith(".")) for d in own]
            for no, c in enumerate(slow_cuts(rows, 40, 9, at_stops)):
                part = [own[i] for i in c]
                want[source, no] = (" ".join(d[4] for d in part if d[4] is not None), part[0][2], part[-1][3], [d[1] for d in part])
        assert got == want


def test_proximity_dedup_by_runs(spark):
    rng = random.Random(9)
    data = [(s, i, round(rng.uniform(0, 3000 if s else 600), 1), rng.choice([None, 1.0, 2.0, 3.0, 4.5])) for s in range(3) for i in range(700)]
    df = spark.createDataFrame(data, "source_id long, frame_id int, ts double, size double").repartition(4)
    for gap in (0.5, 3.0, 20.0):
        got = sorted((r.source_id, r.ts, r.frame_id) for r in sample.dedup_near(df, gap).collect())
        want = []
        for s in range(3):
            kept = []
            for _, i, ts, size in sorted((d for d in data if d[0] == s), key=lambda d: (d[2], d[1])):
                if not kept or ts - kept[-1][0] >= gap:
                    kept.append((ts, i, size or 0.0))
                elif (size or 0.0) > kept[-1][2]:
                    kept[-1] = (ts, i, size)
            want += [(s, ts, i) for ts, i, _ in kept]
        assert got == sorted(want)


def test_null_texts_of_a_cell_leave_no_blank(spark):
    """A chunk over several time cells, of which some have null texts alone."""
    data = [(1, 0, 0.0, 1.0, "a"), (1, 1, 600.0, 601.0, None), (1, 2, 1200.0, 1201.0, "b"), (1, 3, 1800.0, 1801.0, ""), (2, 0, 0.0, 1.0, None), (2, 1, 600.0, 601.0, None), (3, 0, 0.0, 1.0, None)]
    df = spark.createDataFrame(data, "source_id long, seq int, start double, end double, text string")
    for make in (chunk_tokens, chunk_sentences):
        assert sorted((r.source_id, r.text, r.token_count, list(r.segment_indices)) for r in make(df, 40, 9).collect()) == [(1, "a b ", 2, [0, 1, 2, 3]), (2, "", 0, [0, 1]), (3, "", 0, [0])]
