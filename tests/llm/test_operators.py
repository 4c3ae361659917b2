"""The ten operators against brute force, and on nulls, empty tables, very long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F

from chronotext.llm import bpe, components, embed_dedup, exact_dedup, licenses, mixing, quality, sharding, simhash, toxicity, url_filter

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, score string"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def docs(spark, rows):
    """Rows (doc_id, text, source) with further columns, some of which clash with results."""
    return spark.createDataFrame([(i, t, "en", s, 1, "x", "y", "z") for i, t, s in rows], DDL)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [words(rng, rng.randrange(1, 90)) for _ in range(60)]
    texts = [*base, *base[:25], None, None, "", " \n\t ", "one", "One TWO", "é ñ 漢字 \u00a0x", words(rng, 30_000)]
    near = base[59] + " " + words(rng, 200)
    texts += [near, near + " tail", near.upper()]
    rows = [(i, t, [None, "a", "b", "", "c"][i % 5]) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3]]


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*pairs, pairs[0], (7, 7)], "a long, b long")).collect()}
    want = union(600, pairs)
    assert got == {x: want[x] for p in pairs for x in p if any(x in q and q[0] != q[1] for q in pairs)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact(spark, corpus):
    df = docs(spark, corpus)
    rows = exact_dedup.exact_groups(df).collect()
    groups = {}
    for i, t, _ in corpus:
        groups.setdefault(t or "", []).append(i)
    assert len(rows) == len(corpus)
    for r in rows:
        text = next(t for i, t, _ in corpus if i == r.doc_id) or ""
        assert (r.keep_id, r.group_size, r.text_sha256) == (max(groups[text]), len(groups[text]), hashlib.sha256(text.encode()).hexdigest())
    assert sorted(r.doc_id for r in rows if r.kept) == sorted(max(g) for g in groups.values())
    kept = exact_dedup.dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.exact_groups(df.limit(0)).count() == exact_dedup.dedup(df.limit(0)).count() == 0


def test_exact_hot_group_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    rows = [(i, "same text" if i % 3 else f"other {i}", "a") for i in range(900)]
    got = exact_dedup.exact_groups(docs(spark, rows))
    assert {(r.keep_id, r.group_size) for r in got.collect() if r.group_size > 1} == {(899, 600)}
    assert got.filter("kept").count() == exact_dedup.dedup(docs(spark, rows)).count() == 301
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_exact_long_runs(spark, monkeypatch):
    """Runs whose ids are not held, in the middle of a partition and at its edges, with ids that repeat or are missing."""
    monkeypatch.setattr(exact_dedup, "HELD", 3)
    rows = [(i, ["a" * 40, "b", None, "c"][i % 4] if i % 7 else f"only {i}", "a") for i in range(200)] + [(8, "a" * 40, "a")] * 9 + [(None, "c", "a")] * 5 + [(None, "d", "b")] * 8
    for parts in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = exact_dedup.exact_groups(docs(spark, rows)).collect()
        want = {}
        for i, t, _ in rows:
            want.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
        assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted((str(i), k) for k, ids in want.items() for i in ids)
        for k, ids in want.items():
            own = [r for r in got if r.text_sha256 == k]
            top = max((i for i in ids if i is not None), default=None)
            assert {(r.keep_id, r.group_size) for r in own} == {(top, len(ids))} and [r.doc_id for r in own if r.kept] == [top]
        assert exact_dedup.dedup(docs(spark, rows)).count() == len(want)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def slow_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, corpus):
    small = [r for r in corpus if len(r[1] or "") < 50_000]
    rng = random.Random(9)
    rows = simhash.near_components(docs(spark, small)).collect()
    fps = {i: slow_print(t) for i, t, _ in small}
    assert {r.doc_id: r.fp % 2**64 for r in rows} == fps
    ids = sorted(fps)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= 3]
    want = union(len(ids), pairs)
    assert {r.doc_id: r.component_id for r in rows} == {ids[k]: ids[w] for k, w in enumerate(want)}
    assert simhash.dedup(docs(spark, small).limit(0)).count() == 0
    got = simhash.dedup(docs(spark, small))
    assert got.columns == docs(spark, small).columns and {r.doc_id for r in got.collect()} == {ids[w] for w in want}
    # Random fingerprints at small distances, many of them around one point: linked as by brute force, with anchors split too.
    centre = rng.getrandbits(64)
    points = list({centre ^ sum(1 << b for b in set(rng.sample(range(64), rng.randrange(6)))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)})
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, k) for k, p in enumerate(points)], "fp long, rep long")
    want = union(len(points), [(a, b) for a, b in itertools.combinations(range(len(points)), 2) if (points[a] ^ points[b]).bit_count() <= 3])
    for homes in (simhash.HOMES, 20):
        edges = [tuple(r) for r in simhash.linked_pairs(df, homes).collect()]
        assert all((points[a] ^ points[b]).bit_count() <= 3 for a, b in edges)
        assert union(len(points), edges) == want


def test_sharding(spark, corpus, tmp_path):
    df = docs(spark, corpus)
    rows = sharding.shard_documents(df, str(tmp_path / "maps"), 4).collect()
    assert len(rows) == len(corpus)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        text = next(t for i, t, _ in corpus if i == r.doc_id) or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    even = [(i, 1000 + i % 7, 1) for i in range(2000)]
    old = sharding.build_map(even, 16)
    load = lambda m, n: [sum(b for s, b, _ in even if m[s] == k) for k in range(n)]
    assert max(load(old, 16)) - min(load(old, 16)) <= 1006
    grown = sharding.rebalance(old, even, 17)
    assert all(grown[s] in (k, 16) for s, k in old.items()) and max(load(grown, 17)) - min(load(grown, 17)) < 4000
    shrunk = sharding.rebalance(old, even, 15)
    assert sum(shrunk[s] != k for s, k in old.items() if k < 15) < 200 and set(shrunk.values()) == set(range(15))
    sharding.write_map(spark, str(tmp_path / "maps"), 2, grown, even)
    assert sharding.read_map(spark, str(tmp_path / "maps"), 1).count() == sharding.SLOTS
    assert {r.vslot: r.shard for r in sharding.read_map(spark, str(tmp_path / "maps"), 2).collect()} == grown
    assert sharding.shard_documents(df.limit(0), str(tmp_path / "none")).count() == 0


def fair(sizes, share=1.5, most=2.0):
    """Targets by repeated sharing of what is cut off."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def test_mixing(spark, corpus):
    rng = random.Random(4)
    rows = [*corpus, *((1000 + i, words(rng, rng.randrange(60)), rng.choice(["hot", "hot", "hot", "q", None])) for i in range(900))]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fair(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {(r.source_size, round(r.target, 6)) for r in mine} == {(sizes[s], round(want[s], 6))}
        assert abs(sum(r.size * r.times for r in mine) - want[s]) <= max(r.size for r in mine)
    assert all(0 <= r.times <= 2 for r in got)
    again = mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted((r.doc_id, r.times) for r in again) == sorted((r.doc_id, r.times) for r in got)
    assert mixing.mixed(docs(spark, rows)).count() == sum(r.times for r in got)
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0


def test_mixing_prefers_quality(spark):
    rows = docs(spark, [(i, "a b c d e f g h i j", "s" if i < 2000 else f"t{i}") for i in range(2200)])
    got = mixing.mix(rows, weight=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), share=0.5)
    n = {r["even"]: r["n"] for r in got.filter("source = 's'").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.sum("times").alias("n")).collect()}
    assert n[True] > 1.5 * n[False]


def test_bpe(spark, corpus, monkeypatch):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    odd = [(900, "aaaa" * 3000, "a"), (901, "<|endoftext|> don't  \n\n x\u2003y", "a"), (902, "".join(map(chr, range(1, 700))), None), (None, "no id", "a"), (None, "no id", "a")]
    df = docs(spark, [*corpus, *odd]).withColumn("ids", F.lit("clash")).withColumn("round_trip", F.lit("clash")).withColumn("text_", F.lit("kept"))
    got = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect()
    for r in got:
        assert list(r.ids) == own.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    packed = {r.doc_id: bytes(r.ids) for r in bpe.encode(df, PATH, P.PATTERN, packed=True).collect()}
    assert all(packed[r.doc_id] == np.array(r.ids, "<u4").tobytes() for r in got if r.doc_id is not None)
    both = bpe.transcode(df, PATH, P.PATTERN)
    assert both.columns == [c for c in df.columns if c not in ("text", "ids", "round_trip")] + ["ids", "decoded", "round_trip"]
    rows = both.collect()
    texts = {i: t or "" for i, t, _ in [*corpus, *odd]}
    assert len(rows) == len(corpus) + len(odd) and all(r.round_trip and r.text_ == "kept" for r in rows)
    assert all(bytes(r.ids) == np.array(own.encode_ordinary(texts[r.doc_id]), "<u4").tobytes() and bytes(r.decoded) == texts[r.doc_id].encode() for r in rows)
    kept = bpe.transcode(df, PATH, P.PATTERN, keep=["text", "doc_id"])
    assert kept.columns == ["text", "doc_id", "ids", "decoded", "round_trip"] and all(bytes(r.decoded) == (r.text or "").encode() for r in kept.collect())
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == bpe.transcode(df.limit(0), PATH, P.PATTERN).count() == 0
    with pytest.raises(IndexError):
        bpe.decode_ids([1 << 20], PATH)
    # Small slices, matches held in parts, and a memory that forgets give the same ids.
    for name, value in (("SLICE", 50), ("MATCHES", 8), ("REMEMBERED", 5)):
        monkeypatch.setattr(bpe, name, value)
    long = " ".join(str(t) for t in texts.values())
    assert bpe.encode_texts([long], PATH, P.PATTERN) == [np.array(own.encode_ordinary(long), "<u4").tobytes()]


def slow_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_of_many_pieces(spark):
    rng, ranks = random.Random(5), bpe.read_ranks(PATH)
    pairs = bpe.Pairs(ranks)
    pieces = [bytes(rng.choice(b"aaabcdeinst \xc3\xa9\xe6") for _ in range(rng.randrange(1, 65))) for _ in range(1500)] + [b"a" * 64, b"\xff\x00", b" "]
    want = [slow_merge(p, ranks) for p in pieces]
    flat, counts = bpe.merge_rows(pieces, pairs)
    assert counts.tolist() == [len(w) for w in want] and flat.tolist() == [x for w in want for x in w]
    assert [bpe.merge(p, ranks) for p in pieces] == want
    assert bpe.merge_rows([b"x"], pairs)[0].tolist() == [ranks[b"x"]]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 24))
    rows = [x.tolist() for x in v]
    rows += [(v[i] + rng.standard_normal(24) * s).tolist() for i in range(60) for s in (0.05, 0.3)]
    rows += [rows[5]] * 30 + [(3 * v[7]).tolist(), [0.0] * 24, None, [], [1.0, None], [float("nan")] * 24, [float("inf")] * 24, [1.0, 0.0], [1.0, 0.1]]
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(rows)], "vec_id long, embedding array<double>, kept string")
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    assert len(got) == len(rows)
    good = [i for i, x in enumerate(rows) if x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    cos = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) if len(a) == len(b) else 0
    pairs = [(a, b) for a, b in itertools.combinations(good, 2) if cos(np.array(rows[a]), np.array(rows[b])) >= 0.9]
    true = [0] * len(rows)
    for a, b in pairs:
        true[a] += 1
        true[b] += 1
    assert all(got[i].n_links <= true[i] for i in range(len(rows)))
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(true)
    want = union(len(rows), pairs)
    assert np.mean([got[i].component_id == want[i] for i in range(len(rows))]) > 0.95
    assert all(got[i].component_id == i and got[i].kept and not got[i].n_links for i in set(range(len(rows))) - set(good))
    tile, embed_dedup.TILE = embed_dedup.TILE, 8
    try:
        split = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    finally:
        embed_dedup.TILE = tile
    assert all(split[i].n_links == got[i].n_links and split[i].component_id == got[i].component_id for i in got)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold(spark):
    """Of the links whose cosine is just above the threshold, equal vectors aside, at least 0.9 are found, also in buckets that are cut."""
    rng = np.random.default_rng(5)
    one = embed_dedup.unit(rng.standard_normal((500, 64)))
    side = rng.standard_normal((500, 64))
    side = embed_dedup.unit(side - (side * one).sum(axis=1, keepdims=True) * one)
    cos = rng.uniform(0.9, 0.92, (500, 1))
    rows = np.concatenate([one, cos * one + np.sqrt(1 - cos**2) * side, rng.standard_normal((3000, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<float>")
    true = embed_dedup.unit(rows.astype(np.float64))
    true = true @ true.T >= 0.9
    np.fill_diagonal(true, False)
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    found = sum(r.n_links for r in got.values())
    assert true.sum() > 900 and 0.9 * true.sum() <= found <= true.sum()
    assert all(got[i].n_links <= true[i].sum() for i in got)
    assert sum(got[i + 500].component_id == i for i in range(500)) >= 0.9 * sum(true[i, i + 500] for i in range(500))


def labelled(spark, bad, mark, column):
    rng = random.Random(8)
    rows = [(i, mark(rng, words(rng, 60)) if bad(i) else words(rng, 60), "a") for i in range(500)]
    labels = spark.createDataFrame([(i, int(bad(i)), "extra") for i in range(500)], f"doc_id long, {column} int, text string")
    return rows, labels


def test_toxicity(spark):
    def mark(rng, text):
        parts = text.split()
        for _ in range(4):
            parts.insert(rng.randrange(len(parts)), rng.choice(["dreadfulword", "nastyphrase", "vileterm"]))
        return " ".join(parts)

    rows, labels = labelled(spark, lambda i: i % 4 == 0, mark, "toxic")
    df = docs(spark, [*rows, (900, None, None), (901, "", "b"), (902, " ".join(["w1"] * 50_000) + " vileterm", "b"), rows[0]])
    model = toxicity.train(df, labels, F.col("doc_id") % 5 != 0)
    got = toxicity.score(df, model).collect()
    assert len(got) == 504 and "text" not in got[0].asDict() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id < 500 and r.doc_id % 5 == 0]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.9
    none = toxicity.train(df, labels.limit(0), F.lit(True))
    assert toxicity.score(df.limit(0), none).count() == 0 and 0 < none.score(None) < 1
    assert 0 < toxicity.train(df, labels.withColumn("toxic", F.lit(1)), F.lit(True)).score(b"x") < 1
    # Every window of every whole text, compressed again one by one.
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=13, chain_log=13, search_log=4, min_match=4, strategy=zstandard.STRATEGY_LAZY2, target_length=16, write_content_size=0, write_dict_id=0)
    texts = {i: t for i, t, _ in [*rows, (900, None, None), (901, "", "b"), (902, " ".join(["w1"] * 50_000) + " vileterm", "b")]}
    for r in got[::25] + [r for r in got if r.doc_id >= 900]:
        w = (texts[r.doc_id] or "").lower().split()
        saved = []
        for k in range(len(w)):
            window = f"The quick brown fox jumps over the lazy dog; {w[k]} 01234567".encode()
            sizes = [len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d + b"The quick brown fox jumps over the lazy dog;", dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(window)) for d in (model.ordinary, model.toxic)] if k < 800 or k > 49_900 else None
            saved.append(saved[-1] if sizes is None else sizes[0] - sizes[1])
        lo, mid, hi = model.thresholds
        x = [1, np.log1p(len(saved)) / 4, *(np.log1p(sum(a <= s < b for s in saved)) for a, b in ((lo, mid), (mid, hi), (hi, 999)))]
        assert abs(1 / (1 + np.exp(-np.dot(x, model.curve))) - r.score) < 1e-9


def test_toxicity_counts(spark):
    texts = [("Such a nastyphrase, x.", 1), ("such a nastyphrase x", 1), ("Other nastyphrase here", 1), (None, 1), ("nastyones ordinary", 0), ("", 0), ("Such a nastyphrase, x.", 1)]
    got = {bytes(r.passage): (r.toxic, r.ordinary) for r in toxicity.counted(spark.createDataFrame([(t, y) for t, y in texts], "text string, label int").fillna("")).collect()}
    # Words in the same company count once; beginnings are shared by what begins with them.
    assert got[b"nastyphrase"] == got[b"nastyph"] == (2, 0) and got[b"nasty"] == (2, 1) and got[b"ordinary"] == (0, 1) and got[b"x"] == (1, 0)
    few = toxicity.train(spark.createDataFrame([(i, "w " * 100 + "awfulterm" * (i % 2)) for i in range(40)], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"), F.lit(True), most_bytes=1)
    assert few.toxic == b""


def test_quality(spark):
    rows, labels = labelled(spark, lambda i: i % 3 == 0, lambda rng, t: " ".join(w + "###" for w in t.split()), "quality")
    df = docs(spark, [*rows, (900, None, None), (901, "", "b"), (902, "w1 " * 50_000, "b"), rows[0]])
    model = quality.train(df, labels, F.col("doc_id") % 5 != 0)
    scored = quality.score(df, model)
    got = scored.collect()
    assert len(got) == 504 and all(0 <= r.score <= 1 for r in got) and set(df.columns) <= set(scored.columns)
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id < 500 and r.doc_id % 5 == 0]) > 0.95
    none = quality.train(df, labels.limit(0), F.lit(True))
    assert {r.predicted for r in quality.score(df, none).collect()} == {1} and quality.score(df.limit(0), none).count() == 0


def test_quality_scores_are_table_sums(spark):
    """A score by hand: base rate, one entry of each feature's table, one of each pair's."""
    rows, labels = labelled(spark, lambda i: i % 3 == 0, lambda rng, t: " ".join(w + "#|" for w in t.split()), "quality")
    df = docs(spark, [*rows, (900, None, None), (901, "", "b"), (902, "A1! w\n" * 200_000, "b")])
    model = quality.train(df, labels, F.col("doc_id") % 5 != 0)
    assert model.pairs
    for r in quality.score(df, model).collect()[::20] + quality.score(df.filter("doc_id >= 900"), model).collect():
        x, odds, at = quality.features(r.text.encode() if r.text else None), model.base, []
        for v, edges, entries in zip(x, model.edges, model.single, strict=True):
            at.append(sum(e <= v for e in edges))
            odds += entries[at[-1]]
        for i, j, entries in model.pairs:
            odds += entries[at[i] * len(entries) // len(model.single[i])][at[j] * len(entries[0]) // len(model.single[j])]
        assert abs(1 / (1 + np.exp(-odds)) - r.score) < 1e-9
    text = "Ab 1# x|\nAb !\ny\t"
    want = [np.log1p(16), np.log1p(6), (16 - 6) / 6, 2 / 16, 1 / 16, 1 / 16, 1 / 16, 1 / 16, 6 / 16, 0, 5 / 6, 1, np.log1p(16 / 3), 0]
    assert np.allclose(quality.features(text.encode()), want)


def test_quality_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert np.mean((m.score(x[3000:]) >= 0.5) == y[3000:]) > 0.85


def test_licenses(spark):
    full = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore", "a"), (2, full, "a"), (3, None, None), (4, "", "a"), (5, "Licensed under the Apache License, Version 2.0. All rights reserved. Released under the MIT License", "a"), (6, "mit license", "a"), (7, "Released under the MIT License.\n" * 3000, "a")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert [got[i].licenses for i in range(1, 8)] == ["mit", "bsd-2-clause", "", "", "all-rights-reserved,apache-2.0,mit", "", "mit"]
    assert (got[1].license_sequence, got[7].n_notices) == ("#,1,#", 3000)
    assert licenses.scan(docs(spark, rows).limit(0)).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    cases = {
        "http://a.Example.ORG/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2#x": ("example.org", "/en/2", "org/", "allow"),
        "x://org": ("org", "", None, "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "ftp://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
        "http://com/fr/://q": ("com", "/fr/://q", "com/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://ÉX.com/de/": ("Éx.com", "/de/", "com/de/", "block"),
        "http://" + "a." * 3000 + "com/de/": ("a." * 3000 + "com", "/de/", "com/de/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*cases, "no scheme"])], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and len(got) == len(cases) + 1
    many = spark.range(3000).selectExpr("'block' verdict", "concat('h', id, '.net') host", "'/' path")
    listed = spark.range(6000).selectExpr("id page_id", "concat('http://www.h', id, '.net/x') url")
    assert url_filter.judge(listed, many).filter("verdict = 'block'").count() == 3000
    assert url_filter.judge(pages, rules.limit(0)).filter("rule IS NOT NULL").count() == 0 and url_filter.judge(pages.limit(0), rules).count() == 0
