"""Near duplicates by the similarity of word shingles: an exact set-similarity join (Jaccard 0.8 or more).

A text is the set of its lower-cased SHINGLE-word shingles, as 64-bit hashes; a text of fewer words is one shingle.
Texts x and y of similarity 0.8 share at least ceil(0.8 n) shingles, n the larger set's size. So of the first
n - ceil(0.8 n) + ceil(0.2 n) of each in one common order (their hashes') they share at least ceil(0.16 n), n now
either set's size. Only these `prefixes` are dealt out, packed by hash. Hashes that two different texts have come back;
a text with fewer of them than ceil(0.16 n) has no partner. Of the others' s hashes each takes part by its
s - ceil(0.16 n) + 1 rarest: two partners still have one of those in common. What these connect is a candidate group,
which a task holds with the texts and links exactly by whole sets; of the links a spanning forest leaves.

A hash that very many texts have is dealt out by text as well, so that no task gets all of its rows: `common` finds such
hashes on a sample, and all of them rank behind every other hash. Which ones they are changes the candidates, never the
links: partners meet in any order of hashes that is the same for all texts, and a hash that only one text has does no
harm.

Hashes are cut to fewer bits on the way to the groups, which only adds candidates. Copies count as one text. A group
beyond `limit` texts is dealt into blocks, and each pair of blocks is a task. A null or blank text has no shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import lean, publish, short
from tally.llm.simhash import components, text_hash

SHINGLE = 5
BUCKETS = 256
#: Texts that share a task of a common hash; texts of the sample; the part of them that makes a hash common.
DEALT, SAMPLE, COMMON = 65_536, 2048, 0.02
#: The frequency that ranks a common hash.
LAST = 1 << 40
MAX_GROUP = 2048
#: Words whose hashes a task remembers (about 180 bytes each).
KNOWN = 200_000
#: Hashes that a task deals out at once (about 100 bytes each).
AT_ONCE = 1 << 18
#: Hashes that the prefixes of partners share at least.
NEEDED = "(4 * n + 24) DIV 25"
#: Odd multipliers for the words of a shingle.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
PART = np.dtype([("key", "<u4"), ("n", "<u4"), ("h", "<i8")])


def shingles(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The set of a text's shingles, in order; known remembers the hashes of words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    for w in words:
        if w not in known:
            if len(known) > KNOWN:
                known.clear()
            known[w] = xxh64_intdigest(w)
    x = np.fromiter((known[w] if w in known else xxh64_intdigest(w) for w in words), np.uint64, len(words))
    k = min(SHINGLE, x.size)
    return np.unique(sum((x[i : x.size - k + 1 + i] * MIX[i] for i in range(k)), np.uint64(SHINGLE - k)))


def similar(common, a, b):
    """Whether sets of a and b members with so many in common have a Jaccard similarity of 0.8 or more."""
    return 9 * common >= 4 * (a + b)


def prefix(text: str | None, known: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """The number of a text's shingles, and those of its prefix."""
    s = shingles(text, known)
    n = s.size
    return n, s[: n - (4 * n + 4) // 5 + (n + 4) // 5]


def token(key: np.ndarray, bucket) -> np.ndarray:
    return key.astype(np.int64) << 24 | bucket


def common(rows: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Tokens that COMMON of a sample of about SAMPLE different texts have in their prefixes, or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            for t in b.column(1):
                s = prefix(t.as_py(), known)[1]
                own = token(s >> np.uint64(32), (s & np.uint64(buckets - 1)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(own)], ["token"])

    few = rows.where(F.pmod("h", F.lit(max(1, n // SAMPLE))) == 0).dropDuplicates(["h"])
    seen = few.mapInArrow(lean(run), "token long").groupBy("token").agg(F.count("*").alias("c"))
    return np.array([r.token for r in seen.where(F.col("c") >= max(2.0, COMMON * min(n, SAMPLE))).collect()], np.int64)


def prefixes(buckets: int, often: np.ndarray, salts: int):
    """Function for mapInArrow: rows (h, text) to packed prefixes by bucket. AT_ONCE hashes are held, whatever the batches hold."""

    def dealt(keys: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        key, row = np.concatenate(keys), np.concatenate(rows)
        salt = 1 + row["h"] % salts
        salt[~np.isin(token(row["key"], key), often)] = 0
        place = key * (salts + 1) + salt
        order = np.argsort(place, kind="stable")
        place, row = place[order], row[order]
        cut = np.flatnonzero(np.diff(place, prepend=-1))
        parts = [row[i:j].tobytes() for i, j in zip(cut, [*cut[1:], row.size], strict=True)]
        bucket, salt = np.divmod(place[cut], salts + 1)
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(salt), pa.array(parts, pa.binary())], ["bucket", "salt", "part"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        keys, rows, held = [], [], 0
        for b in batches:
            for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, s = prefix(t.as_py(), known)
                own = np.empty(s.size, PART)
                own["key"], own["n"], own["h"] = s >> np.uint64(32), n, h
                keys.append((s & np.uint64(buckets - 1)).astype(np.int64))
                rows.append(own)
                held += s.size
                if held >= AT_ONCE:
                    yield dealt(keys, rows)
                    keys, rows, held = [], [], 0
        if held:
            yield dealt(keys, rows)

    return run


def shared(t: pa.Table) -> pa.Table:
    """Of a bucket, the hashes that different texts have: (token, h, n, df). Of common hashes all rows stay."""
    x = np.concatenate([np.frombuffer(p.as_py(), PART) for p in t.column("part")])
    x = x[np.lexsort((x["h"], x["key"]))]
    if x.size:  # of copies, one
        x = x[np.concatenate([[True], (x["key"][1:] != x["key"][:-1]) | (x["h"][1:] != x["h"][:-1])])]
    if t.column("salt")[0].as_py():
        df = np.full(x.size, LAST, np.int64)
    else:
        _, inverse, df = np.unique(x["key"], return_inverse=True, return_counts=True)
        df = df[inverse]
        x, df = x[df > 1], df[df > 1]
    own = token(x["key"], t.column("bucket")[0].as_py())
    return pa.table({"token": own, "h": x["h"], "n": x["n"].astype(np.int64), "df": df.astype(np.int64)})


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the links among sets."""
    size = np.array([s.size for s in sets], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    of = np.repeat(np.arange(size.size), size)
    order = np.argsort(flat, kind="stable")
    _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
    at, post = np.concatenate([[0], np.cumsum(df)]), of[order]
    out, left, todo = [], np.arange(size.size), []
    while left.size:
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        u = todo.pop()
        own = code[start[u] : start[u + 1]]
        if int(df[own].sum()) <= 4 * int(size[left].sum()):
            rep = df[own]
            idx = np.repeat(at[own] - np.cumsum(rep) + rep, rep) + np.arange(int(rep.sum()))
            common = np.bincount(post[idx], minlength=size.size)[left]
        else:
            common = np.array([np.isin(code[start[v] : start[v + 1]], own, assume_unique=True).sum() for v in left.tolist()], np.int64)
        near = similar(common, size[u], size[left]) & (size[left] > 0)
        if near.any():
            hit = left[near].tolist()
            out += [(u, v) for v in hit]
            left = left[~near]
            todo += hit
    return out


def linked(t: pa.Table) -> pa.Table:
    """Links (a, b) among a group's texts, by their hashes."""
    known: dict[bytes, int] = {}
    h = t.column("h").to_numpy()
    pairs = np.array(forest([shingles(x.as_py(), known) for x in t.column("text")]), np.int64).reshape(-1, 2)
    return pa.table({"a": h[pairs[:, 0]], "b": h[pairs[:, 1]]})


def links(docs: DataFrame, limit: int = MAX_GROUP, dealt: int = DEALT) -> DataFrame:
    """(a, b): hashes of texts, edges that connect exactly what Jaccard similarities of 0.8 or more connect."""
    rows = docs.select(text_hash(F.col("text")).alias("h"), "text")
    n = rows.count()
    buckets, salts = BUCKETS << min(16, (n // 4_000_000).bit_length()), 1 + n // dealt
    often = common(rows, n, buckets) if salts > 1 else np.empty(0, np.int64)  # a single task would get them anyway
    parts = rows.mapInArrow(lean(prefixes(buckets, often, salts)), "bucket long, salt long, part binary")
    both = publish(parts.groupBy("bucket", "salt").applyInArrow(shared, "token long, h long, n long, df long"), "shingles")
    enough = both.groupBy("h").agg(F.count("*").alias("s"), F.first("n").alias("n")).withColumn("take", F.expr(f"s - {NEEDED} + 1")).where("take > 0").select("h", "take")
    # a text's rarest hashes: its own rows only, at most two fifths of its shingles
    ranked = both.join(enough, "h").withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("df", "token")))
    cells = publish(ranked.where("r <= take").select("token", "h"), "cells")
    first = cells.groupBy("token").agg(F.min("h").alias("b"))
    groups = components(cells.join(first, "token").select(F.col("h").alias("a"), "b").distinct())
    size = groups.groupBy("root").agg(F.ceil(F.count("*") / max(1, limit // 2)).alias("k"), F.count("*").alias("m"))
    groups = groups.join(size, "root").withColumn("k", F.when(F.col("m") <= limit, 1).otherwise(F.col("k")))
    texts = rows.join(short(publish(groups.select(F.col("node").alias("h"), "root", "k"), "groups")), "h").dropDuplicates(["h"])
    texts = texts.withColumn("own", F.pmod(F.xxhash64("h"), "k")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    texts = texts.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "h", "text")
    return texts.groupBy("root", "x", "y").applyInArrow(linked, "a long, b long").distinct()
