"""Byte-level BPE encoding and decoding.

Each match of the vocabulary's pattern is encoded by itself.  A segment tree over its byte positions holds, in each node,
the leftmost of the mergeable pairs of smallest rank that start below it; a merge changes three leaves, so a piece of n
bytes takes O(n log n) steps even where it is one long run.  The trees of many pieces of like length are the rows of one
array, and one step merges a pair in each of them; pieces too long for that have trees of their own.  Encoding and
decoding happen in one Python step, a few megabytes of text at a time, and pieces in steady use are remembered, up to a
fixed number.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker remembers in each of two generations, and the longest of them in bytes.  Only speed depends on them.
REMEMBERED, LONGEST = 1 << 17, 64
#: Text bytes that are encoded and sent back at once, and matches that are held at once.
SLICE, MATCHES = 1 << 21, 1 << 18
NEVER = 1 << 62
#: Ids must be smaller than this, so that a rank and a position among LONGEST bytes fit 31 bits, and a pair of ids 62.
IDS = 1 << 24


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the leftmost pair of smallest rank is merged until none can be.

    A leaf of the tree is rank * 2**32 + position, so a node's smaller child is also its leftmost smallest pair.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece[i : i + 1]] for i in range(n)]
    get, m = ranks.get, n - 1
    end = list(range(1, n + 1))  # where the token that starts here ends
    before = list(range(-1, n - 1))  # where the token before it starts
    tree = [NEVER] * m
    for i in range(m):
        rank = get(piece[i : i + 2])
        tree.append(NEVER if rank is None else rank << 32 | i)
    for k in range(m - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    while (best := tree[1]) != NEVER:
        i = best & 0xFFFFFFFF
        j = end[i]
        stop = end[i] = end[j]
        tree[m + j if j < m else 0] = NEVER  # leaf 0 is not used: the last token starts no pair
        ups = [(m + j) >> 1, (m + i) >> 1] if j < m else [(m + i) >> 1]
        if stop < n:
            before[stop] = i
            rank = get(piece[i : end[stop]])
            tree[m + i] = NEVER if rank is None else rank << 32 | i
        else:
            tree[m + i] = NEVER
        h = before[i]
        if h >= 0:
            rank = get(piece[h:stop])
            tree[m + h] = NEVER if rank is None else rank << 32 | h
            ups.append((m + h) >> 1)
        for k in ups:
            while k:
                x, y = tree[2 * k], tree[2 * k + 1]
                if y < x:
                    x = y
                if tree[k] == x:
                    break
                tree[k] = x
                k >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """Which rank the bytes of two neighbouring tokens have, for whole arrays of pairs of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= IDS:
            raise ValueError(f"ids from {IDS} on are not supported")
        found = sorted((a * IDS + b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None)
        self.keys = np.array([k for k, _ in found] + [NEVER], np.int64)
        self.ranks = np.array([r for _, r in found] + [-1], np.int32)
        self.byte = np.array([ranks.get(bytes([x]), -1) for x in range(256)], np.int32)
        self.bytes = np.array([ranks.get(bytes([x, y]), -1) for x in range(256) for y in range(256)], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 where it can't be merged."""
        key = a.astype(np.int64) * IDS + b
        at = self.keys.searchsorted(key)
        return np.where(self.keys.take(at) == key, self.ranks.take(at), -1)


def merge_rows(pieces: list[bytes], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many pieces of at most LONGEST bytes, as :func:`merge` finds them: (ids one after another, how many each piece has).

    The trees of all pieces lie one behind the other in one array, each with as many leaves as the longest piece has bytes,
    rounded up to a power of two.  A leaf is rank * leaves + position; ``r`` and ``t`` are where a piece's positions and its
    tree begin.
    """
    never = np.int32(2**31 - 1)
    lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
    shift = max(1, int(lengths.max() - 1).bit_length())
    width = 1 << shift
    raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(-1, width)
    column = np.arange(width, dtype=np.int32)
    token = np.where(column < lengths[:, None], pairs.byte[raw], -1)
    rank = pairs.bytes[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
    tree = np.full((len(pieces), 2 * width), never, np.int32)
    tree[:, width:-1] = np.where((column[1:] < lengths[:, None]) & (rank >= 0), rank << shift | column[:-1], never)
    half = width
    while half > 1:  # each level is the smaller of the two halves below it
        tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
        half //= 2
    live = np.flatnonzero(tree[:, 1] != never)
    after, before = (np.tile(column + k, len(pieces)) for k in (1, -1))
    tree, token = tree.ravel(), token.ravel()
    n, r, t = lengths[live], live * width, live * (2 * width)
    while len(r):
        best = tree.take(t + 1)
        i = best & (width - 1)
        j = after.take(r + i)
        stop = after.take(r + j)
        token[r + i] = best >> shift  # a merged token's id is its rank
        token[r + j] = -1
        after[r + i] = stop
        h = before.take(r + i)
        tree[t + (width + j)] = never
        tree[t + (width + i)] = never
        right, left = np.flatnonzero(stop < n), np.flatnonzero(h >= 0)
        before[r[right] + stop[right]] = i[right]
        at, a = np.concatenate([right, left]), np.concatenate([i[right], h[left]])
        new = pairs.rank(token.take(r[at] + a), token.take(r[at] + np.concatenate([stop[right], i[left]])))
        tree[t[at] + (width + a)] = np.where(new < 0, never, new << shift | a)
        up = np.stack([j, i, np.maximum(h, 0)]) + width  # where there is no token before, leaf 0 is brought up to date once more
        for _ in range(shift):
            up >>= 1
            below = t + 2 * up
            tree[t + up] = np.minimum(tree.take(below), tree.take(below + 1))
        on = np.flatnonzero(tree.take(t + 1) != never)
        n, r, t = n[on], r[on], t[on]
    keep = token >= 0
    return token[keep], keep.reshape(-1, width).sum(axis=1)


class Pieces:
    """Ids of pieces of text as little-endian unsigned 32-bit integers.

    When REMEMBERED pieces are held they become the old ones, which are asked before a piece is worked out again, so
    pieces in steady use survive and memory stays bounded.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs, self.new, self.old = ranks, Pairs(ranks), {}, {}

    def encode(self, found: list[list[str]]) -> dict[str, bytes]:
        """A dictionary that has the ids of all pieces in ``found``, and perhaps of others."""
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        wanted = set().union(*found)
        wanted.difference_update(self.new)
        ids = {p: self.old[p] for p in wanted.intersection(self.old)}
        groups: dict[int, list[str]] = {}
        long = {}
        for p in wanted.difference(self.old):
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                ids[p] = whole.to_bytes(4, "little")
            elif len(raw) > LONGEST:
                long[p] = np.array(merge(raw, self.ranks), "<u4").tobytes()
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append(p)
        for group in groups.values():
            for k in range(0, len(group), 1 << 15):
                part = group[k : k + (1 << 15)]
                flat, counts = merge_rows([p.encode() for p in part], self.pairs)
                packed, ends = flat.astype("<u4").tobytes(), (4 * counts.cumsum()).tolist()
                ids.update(zip(part, map(packed.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        self.new.update(ids)
        return self.new | long if long else self.new


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    return regex.compile(pattern), Pieces(read_ranks(path))


@lru_cache(maxsize=2)
def decoder(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode_texts(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """The ids of each text, packed as little-endian unsigned 32-bit integers.  The matches of long texts are held in parts."""
    find, pieces = encoder(path, pattern)
    if sum(map(len, texts)) > 4 * MATCHES and len(texts) == 1:
        matches, parts = (m.group() for m in find.finditer(texts[0])), []
        while part := list(islice(matches, MATCHES)):
            parts.append(b"".join(map(pieces.encode([part]).__getitem__, part)))
        return [b"".join(parts)]
    found = [find.findall(t) for t in texts]
    ids = pieces.encode(found).__getitem__
    return [b"".join(map(ids, f)) for f in found]


def decode_ids(ids: bytes | Iterable[int] | None, path: str) -> bytes:
    """The bytes that ids (packed, or integers) stand for; None gives none.  An id the vocabulary lacks raises IndexError."""
    numbers = memoryview(ids).cast("I") if isinstance(ids, bytes) else ids if ids is not None else ()
    return b"".join(map(decoder(path).__getitem__, numbers))


def slices(batches, column: str):
    """The batches in slices of about SLICE bytes of ``column``, which has no nulls; a longer value is a slice of its own."""
    for b in batches:
        start, held = 0, 0
        for k, n in enumerate(pc.binary_length(b.column(column)).to_pylist()):
            if held and held + n > SLICE:
                yield b.slice(start, k - start)
                start, held = k, 0
            held += n
        yield b.slice(start)


def transcode(df: DataFrame, path: str, pattern: str, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``column`` if not given) with ids, decoded and round_trip, made in one Python step.

    ids are the token ids of ``column`` as little-endian unsigned 32-bit integers, decoded the bytes that those ids stand
    for, and round_trip tells whether these are the text's own.  A null text counts as empty; columns of the three names
    are replaced; rows that repeat, ids that are null and empty tables pass through as they are.  ``path`` names the
    vocabulary on every worker.
    """
    made = ("ids", "decoded", "round_trip")
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in made and (keep is not None or c != column)]
    schema = df.select(*keep, *(F.lit(None).cast(k).alias(c) for c, k in zip(made, ("binary", "binary", "boolean"), strict=True))).schema
    source = "".join(keep) + column + "_"  # a name that no kept column has
    rows = df.select(*keep, F.coalesce(F.col(column).cast("string"), F.lit("")).alias(source))

    def run(batches):
        for b in slices(batches, source):
            texts = b.column(source).to_pylist()
            ids = encode_texts(texts, path, pattern)
            decoded = [decode_ids(x, path) for x in ids]
            same = [d == t.encode() for d, t in zip(decoded, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()), pa.array(same, pa.bool_())], names=[*keep, *made])

    return rows.mapInArrow(run, schema)


def _mapped(df: DataFrame, source: str, target: str, kind: str, arrow, function) -> DataFrame:
    """``df`` with the binary or list column ``target`` made from ``source``; all other columns pass through as they are."""
    keep = [c for c in df.columns if c.lower() != target.lower()]
    schema = df.select(*keep).withColumn(target, F.lit(None).cast(kind)).schema

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(function(b.column(source).to_pylist()), arrow)], names=[*keep, target])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, column: str = "text", target: str = "ids", packed: bool = False) -> DataFrame:
    """``df`` with the token ids of ``column``: an array of longs, or with ``packed`` their little-endian 32-bit bytes.

    Null counts as empty; no special tokens are known, so their names in a text are ordinary text.  ``target`` replaces a
    column of that name.  ``path`` names the vocabulary on every worker.
    """

    def function(texts):
        ids = [x for t in texts for x in encode_texts([t or ""], path, pattern)]
        return ids if packed else [np.frombuffer(x, "<u4").astype(np.int64) for x in ids]

    return _mapped(df, column, target, "binary" if packed else "array<long>", pa.binary() if packed else pa.list_(pa.int64()), function)


def decode(df: DataFrame, path: str, column: str = "ids", target: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids in ``column`` (packed, or an array of integers) stand for; null ids give no bytes.

    Cast to string for text.  An id that the vocabulary lacks fails the job (IndexError).
    """
    return _mapped(df, column, target, "binary", pa.binary(), lambda rows: [decode_ids(x, path) for x in rows])
