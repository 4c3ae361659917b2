"""Merkle dataset manifest with octopus multiproofs.

Every row is a leaf; the leaves of a source, by id, make a ternary tree, and the roots of the sources make another one above
them.  Leaves are numbered by a range sort, so a source that holds a third of all rows lies in many partitions.  Chunks of
3^HEIGHT consecutive leaves, aligned to the tree, are hashed up in one task each; their tops are the leaves of the next
round, so a tree takes log(n) / HEIGHT rounds, each 3^HEIGHT times smaller.

A leaf partition is a chunk of a large source, or neighbouring small sources.  For the proofs of all its leaves it works out
the smallest set of node coordinates that it can't derive itself, one union over all its leaves; these are fetched once, in
one join of all partitions' coordinates with the stored nodes.  Interiors that several leaves share are then derived once,
and each leaf's own proof is read off locally.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm.shared import few, remainder, written

ARITY = 3
#: Levels of a chunk: it has at most 3^6 = 729 leaves, and a leaf partition at most three times as many.
HEIGHT = 6
CHUNK = ARITY**HEIGHT
#: Node and source tables of at most so many rows are broadcast, larger ones joined by a shuffle.
BROADCAST = 100_000
#: The tree above the sources; those of the sources are numbered from 0.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` leaves: as long as there are several nodes, each run of three (the last may be shorter) becomes one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def leaf_digest(*fields: Column) -> Column:
    """Hex sha256 of the fields: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def parts(batches):
    """The rows, as dicts, of each leaf partition of batches that are sorted by ``part``."""
    for _, rows in groupby((row for b in batches for row in b.to_pylist()), lambda r: r["part"]):
        yield list(rows)


def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """``rows`` as a batch with the columns of ``schema``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


NODES = "tree long, n long, level int, idx long, digest binary, top boolean"


def climb(nodes: DataFrame, base: int, everything: bool) -> DataFrame:
    """What ``nodes`` (part, tree, n, idx, digest), at level ``base`` of trees with ``n`` leaves, become up to HEIGHT levels higher.

    ``everything`` also returns the nodes on the way, but not ``nodes`` themselves; ``top`` marks the root of a tree.
    """

    def run(batches):
        for rows in parts(batches):
            out = []
            for (tree, n, chunk), own in groupby(rows, lambda r: (r["tree"], r["n"], r["idx"] // CHUNK)):
                level, of, to = base, [r["digest"].hex() for r in own], min(depth(n), base + HEIGHT)
                if level == to:
                    out.append((tree, n, level, chunk, bytes.fromhex(of[0]), True))
                while level < to:
                    of, level = [joined(of[i : i + ARITY]) for i in range(0, len(of), ARITY)], level + 1
                    if everything or level == to:
                        at = chunk * CHUNK // ARITY ** (level - base)
                        out.extend((tree, n, level, at + i, bytes.fromhex(d), level == depth(n)) for i, d in enumerate(of))
            yield arrow(out, NODES)

    return nodes.select("part", "tree", "n", "idx", "digest").repartition("part").sortWithinPartitions("part", "tree", "idx").mapInArrow(run, NODES)


def missing(known: set[int], size: int, level: int = 0):
    """Coordinates (level, idx) that nodes ``known`` of a level with ``size`` nodes lack on the way to the root; what they can derive is left out."""
    while size > 1:
        above = {k // ARITY for k in known}
        yield from ((level, c) for g in sorted(above) for c in range(ARITY * g, min(ARITY * g + ARITY, size)) if c not in known)
        known, size, level = above, -(-size // ARITY), level + 1


class Shared:
    """The nodes that a leaf partition knows of one tree, from a level on: its own, those fetched, and the interiors derived from both."""

    def __init__(self, own: dict[int, str], size: int, level: int, fetched: dict[tuple[int, int], str]):
        self.levels = []
        while True:
            nodes = {i: d for (at, i), d in fetched.items() if at == level} | own
            self.levels.append(nodes)
            if size <= 1:
                break
            own = {g: joined(nodes[c] for c in range(ARITY * g, min(ARITY * g + ARITY, size))) for g in {k // ARITY for k in own}}
            size, level = -(-size // ARITY), level + 1
        self.root = nodes[0]

    def path(self, at: int) -> list[tuple[str, str]]:
        """Siblings left and right of node ``at`` of the lowest level, of its parent, and so on."""
        out = []
        for nodes in self.levels[:-1]:
            g = at - at % ARITY
            out.append(("".join(nodes[c] for c in range(g, at)), "".join(nodes[c] for c in range(at + 1, g + ARITY) if c in nodes)))
            at //= ARITY
        return out


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = joined((left, digest, right))
    return digest


@dataclass
class Manifest:
    """``leaves`` (part, tree, n, idx, doc_id, digest, changed), ``spans`` (the chunks that a run of leaves touches), ``nodes``
    (tree, n, level, idx, digest, top) and the number of sources and root of the whole (None without rows)."""

    leaves: DataFrame
    spans: DataFrame
    nodes: DataFrame
    sources: int
    root: str | None


def build(docs: DataFrame) -> Manifest:
    """The manifest of all rows of ``docs`` (doc_id, source, lang, n_chars, text); other columns are not looked at.

    Any field may be null.  Rows of a source that share an id (null ids come first) are ordered by their digest.  ``changed``
    is the leaf of the same row after the tampering that :func:`proofs` looks for, null where nothing changes.
    """
    spark = docs.sparkSession
    fields = [F.col(c) for c in FIELDS]
    tampered = (remainder(F.col("doc_id"), 2) == 0) & F.col("text").contains("\n")
    changed = F.when(tampered, F.unhex(leaf_digest(*fields[:4], F.translate("text", "\n", ""))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.unhex(leaf_digest(*fields)).alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("tie"))
    order = ["source", "doc_id", "digest", "tie"]
    ordered = written(rows, "leaves").repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    # The row number within a partition; its upper bits are the partition.
    ordered = written(ordered.withColumn("mid", F.monotonically_increasing_id()), "leaves-ordered")
    pid = F.shiftright("mid", 33).alias("pid")
    spans = written(ordered.groupBy(pid, "source").agg(F.min("mid").alias("first"), F.count("*").alias("rows")), "spans")
    # One row for each partition comes to the driver: what its first source has in the partitions before it.
    edge = [F.struct("source", "rows"), F.col("first")]
    starts, before, sources, tail, tail_rows = [], 0, 0, None, 0
    for e in spans.groupBy("pid").agg(F.count("*").alias("sources"), F.sum("rows").alias("rows"), F.min_by(*edge).alias("head"), F.max_by(*edge).alias("tail")).orderBy("pid").collect():
        again = bool(starts) and e.head.source == tail
        carry = tail_rows if again else 0
        starts.append((e.pid, sources - again, carry, before))
        tail, tail_rows = e.tail.source, e.tail.rows + (carry if e.sources == 1 else 0)
        before, sources = before + e.rows, sources - again + e.sources
    base = F.broadcast(spark.createDataFrame(starts, "pid long, base long, carry long, before long"))
    spans = spans.join(base, "pid").withColumn("no", F.row_number().over(Window.partitionBy("pid").orderBy("first")) - 1)
    spans = spans.withColumn("tree", F.col("base") + F.col("no")).withColumn("skip", F.when(F.col("no") == 0, F.col("carry")).otherwise(0))
    start = F.col("before") + F.col("first") - F.shiftleft("pid", 33) - F.col("skip")
    spans = spans.select("pid", "source", "tree", "first", "skip", "rows", start.alias("start"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    spans = written(spans, "spans-numbered")
    one = ordered.withColumn("pid", pid).alias("o").join(few(spans, BROADCAST).alias("s"), F.expr("o.pid = s.pid AND o.source <=> s.source"))
    leaves = one.withColumn("idx", F.expr("mid - first + skip")).select(part_of(f"idx div {CHUNK}"), "tree", "n", "idx", "doc_id", "digest", "changed")
    nodes, root = _nodes(spark, leaves, spans, sources)
    return Manifest(leaves, spans, nodes, sources, root)


def part_of(chunk: str) -> Column:
    """The leaf partition of a chunk of a source whose leaves begin at ``start``: chunks of a source never share one."""
    return F.expr(f"(start + ({chunk}) * {CHUNK}) div {CHUNK}").alias("part")


def _nodes(spark, leaves: DataFrame, spans: DataFrame, sources: int) -> tuple[DataFrame, str | None]:
    """All nodes from level HEIGHT on, the roots of all sources and all nodes of the tree above them, and the root."""
    made = [written(climb(leaves, 0, False), "nodes-0")]
    largest = spans.agg(F.max("n")).first()[0] or 0
    chunked = F.expr(f"idx div {CHUNK}")
    for base in range(HEIGHT, depth(largest), HEIGHT):
        rest = made[-1].filter(f"level = {base} AND NOT top")
        made.append(written(climb(rest.withColumn("part", F.xxhash64("tree", chunked)), base, True), f"nodes-{base}"))
    roots = made[0]
    for more in made[1:]:
        roots = roots.unionByName(more)
    above = roots.filter("top").select(F.lit(TOP).cast("long").alias("tree"), F.lit(sources).cast("long").alias("n"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "digest", F.lit(sources == 1).alias("top"))
    made.append(written(above, "subroots"))
    for base in range(0, depth(sources), HEIGHT):
        rest = made[-1].filter(f"level = {base}").withColumn("part", chunked)
        made.append(written(climb(rest, base, True), f"top-{base}"))
    nodes = made[0]
    for more in made[1:]:
        nodes = nodes.unionByName(more)
    root = made[-1].filter("top").select(F.lower(F.hex("digest"))).first()
    return nodes, root[0] if root else None


def requests(m: Manifest) -> DataFrame:
    """(part, tree, level, idx): the nodes that each leaf partition has to fetch, each once for all of its leaves."""
    sources = m.sources
    chunk = F.explode(F.expr(f"sequence(skip div {CHUNK}, (skip + rows - 1) div {CHUNK})"))
    held = m.spans.select("tree", "n", "start", chunk.alias("chunk")).distinct().select(part_of("chunk"), "tree", "n", "chunk")
    schema = "part long, tree long, level int, idx long"

    def run(batches):
        for rows in parts(batches):
            part = rows[0]["part"]
            out = [(part, TOP, level, i) for level, i in missing({r["tree"] for r in rows}, sources)]
            for r in rows:
                if r["n"] > CHUNK:
                    out.extend((part, r["tree"], level, i) for level, i in missing({r["chunk"]}, -(-r["n"] // CHUNK), HEIGHT))
            if out:
                yield arrow(out, schema)

    return held.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(m: Manifest, siblings: bool = False) -> DataFrame:
    """A row for each leaf: doc_id, leaf, subroot, root, the digest of its proof (all siblings, level by level, left to right), and
    what the tampered leaf, or else the leaf, folds to with the siblings; verified if that is the root.

    ``siblings`` adds the proof itself, an array of digests.  A manifest without rows gives no rows.
    """
    root, sources, schema = m.root, m.sources, PROOFS + (", proof array<string>" if siblings else "")
    none = lambda kind: F.lit(None).cast(kind)
    fetched = requests(m).join(few(written(m.nodes.select("tree", "level", "idx", "digest"), "nodes"), BROADCAST, "merge"), ["tree", "level", "idx"])
    fetched = fetched.select("part", F.lit(0).alias("own"), "tree", none("long").alias("n"), "level", "idx", none("long").alias("doc_id"), "digest", none("binary").alias("changed"))
    leaves = m.leaves.select("part", F.lit(1).alias("own"), "tree", "n", F.lit(0).alias("level"), "idx", "doc_id", "digest", "changed")
    rows = fetched.unionByName(leaves).repartition("part").sortWithinPartitions("part", "own", "tree", "idx")

    def run(batches):
        for part in parts(batches):
            fetched, trees = {}, {}
            for r in part:
                if r["own"]:
                    trees.setdefault((r["tree"], r["n"], r["idx"] // CHUNK), []).append(r)
                else:
                    fetched.setdefault(r["tree"], {})[r["level"], r["idx"]] = r["digest"].hex()
            chunks, subroots = [], {}
            for (tree, n, chunk), own in trees.items():
                inner = Shared({i: r["digest"].hex() for i, r in enumerate(own)}, len(own), 0, {})
                # The last chunk of a large source may be too small to be HEIGHT levels high by itself.
                alone = [("", "")] * (HEIGHT - depth(len(own)) if n > CHUNK else 0)
                outer = Shared({chunk: folded(inner.root, alone)}, -(-n // CHUNK), HEIGHT, fetched.get(tree, {}))
                subroots[tree] = outer.root
                chunks.append((tree, own, inner, alone + outer.path(chunk)))
            above = Shared(subroots, sources, 0, fetched.get(TOP, {}))
            if above.root != root:
                raise ValueError("the nodes of the manifest do not lead to its root")
            out = []
            for tree, own, inner, rest in chunks:
                rest = rest + above.path(tree)
                for i, r in enumerate(own):
                    path = inner.path(i) + rest
                    proof = "".join(left + right for left, right in path)
                    found = folded((r["changed"] or r["digest"]).hex(), path)
                    row = (r["doc_id"], r["digest"].hex(), subroots[tree], root, joined([proof]), found, found == root)
                    out.append((*row, [proof[k : k + 64] for k in range(0, len(proof), 64)]) if siblings else row)
            yield arrow(out, schema)

    return rows.mapInArrow(run, schema)


def oracle() -> str:
    """The same in SQL: trees as lists of nodes, a level for each step of a recursive query."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, FIELDS[:4]), field(text)]) + ")"
    left, right = "array_to_string(nodes[3 * (pos // 3) + 1 : pos], '')", "array_to_string(nodes[pos + 2 : 3 * (pos // 3) + 3], '')"
    up = "list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))"
    return f"""WITH RECURSIVE leaves AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS shown FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
tree AS (SELECT source, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY source UNION ALL SELECT source, lvl + 1, {up} FROM tree WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM tree WHERE len(nodes) = 1),
top AS (SELECT 0 AS lvl, list(subroot ORDER BY pos) AS nodes FROM subroots UNION ALL SELECT lvl + 1, {up} FROM top WHERE len(nodes) > 1),
walk AS (SELECT doc_id, source, leaf, shown, pos, 0 AS lvl, '' AS proof FROM placed UNION ALL
  SELECT doc_id, walk.source, leaf, sha256({left} || shown || {right}), pos // 3, walk.lvl + 1, proof || {left} || {right}
  FROM walk JOIN tree ON tree.source IS NOT DISTINCT FROM walk.source AND tree.lvl = walk.lvl WHERE len(nodes) > 1),
ends AS (SELECT w.doc_id, w.leaf, w.shown, w.proof, s.subroot, s.pos FROM walk w JOIN tree t ON t.source IS NOT DISTINCT FROM w.source AND t.lvl = w.lvl
  JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source WHERE len(t.nodes) = 1),
rise AS (SELECT *, 0 AS lvl FROM ends UNION ALL
  SELECT doc_id, leaf, sha256({left} || shown || {right}), proof || {left} || {right}, subroot, pos // 3, lvl + 1 FROM rise JOIN top USING (lvl) WHERE len(nodes) > 1)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256, shown AS folded_root, shown = nodes[1] AS verified FROM rise JOIN top USING (lvl) WHERE len(nodes) = 1"""
