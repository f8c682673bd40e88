"""Near duplicates by SimHash, found through segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits; the embedding holds each segment's number of set bits. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, so links (4 or fewer
differing bits) are searched among embeddings first: a range join on a grid, then the lower bound, then the exact test.

The embedding is kept as a thermometer code (each segment's bits sorted), so that equal counts are equal bits and the
Manhattan distance is a popcount of an exclusive or. The grid: the segments form g groups; embeddings within distance
4 agree in at least g - 4 groups, so each choice of g - 4 groups is a projection whose cells (equal counts there) meet
every link at least once. More groups mean finer cells and more copies of each fingerprint; `groups_for` weighs both by
the number of fingerprints, and any g gives the same links.

Skew: copies collapse to distinct fingerprints before the grid. Inside a cell only a spanning forest of the links
leaves, never all pairs. A cell beyond MAX_CELL fingerprints is put off, dealt into blocks, and each pair of blocks
becomes a task of its own, so no task holds more than two blocks. Components come from contraction rounds in Spark with
random priorities (expected logarithmically many), each round's edges written to the shared folder.

Defined results: null text or no words: fingerprint zero, linked like any other. Null doc_id: the row stays, and counts
for component_id only if no other member has an id. Repeated rows: one result row each. Empty table: no rows. Further
columns are ignored. `keep_one` tells documents apart by doc_id and text, so of two components whose first rows share a
doc_id, or have none, each keeps its own; all columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import discard, fresh, lean, publish, short

RADIUS = 4
SEGMENTS = 32
MAX_CELL = 16_384
EVEN = 0x5555555555555555
ROUNDS = 60
CHUNK = 1 << 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a text's lower-cased word shingles, repeats included; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both for ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    last = ends[shingle - 1 :].tolist()
    n, ones = len(last), np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): one row per row of docs; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(fingerprint(t.as_py(), shingle, seed)) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, text_hash long, fp long")


def embedding(fp: Column) -> Column:
    """Thermometer code of the popcounts of 2-bit segments."""
    half = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(half).bitwiseAND(F.lit(EVEN))
    both = fp.bitwiseAND(half).bitwiseAND(F.lit(EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _embed(x: np.ndarray) -> np.ndarray:
    half, even = x >> np.uint64(1), np.uint64(EVEN)
    return ((x | half) & even) | (((x & half) & even) << np.uint64(1))


def projections(groups: int) -> list[int]:
    """Masks over the embedding, one for each choice of groups - RADIUS groups of segments."""
    cut = [round(k * SEGMENTS / groups) for k in range(groups + 1)]
    own = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(cut, cut[1:], strict=False)]
    return [sum(c) for c in combinations(own, groups - RADIUS)]


def groups_for(n: int) -> int:
    """The number of groups with the least work for n fingerprints: copies on the grid against chance meetings.

    A 2-bit segment's count is equal by chance with probability 3/8.
    """
    cost = {g: comb(g, RADIUS) * 30 + n * sum(0.375 ** (m.bit_count() / 2) for m in projections(g)) for g in range(6, 11)}
    return min(cost, key=cost.get)


def forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links among distinct fingerprints."""
    out, left, todo = [], fps, []
    while left.size:
        if not todo:
            todo, left = [left[0]], left[1:]
        u = todo.pop()
        near = np.bitwise_count(left ^ u) <= RADIUS
        if near.any():
            hit = left[near]
            out.append((np.full(hit.size, u), hit))
            left = left[~near]
            todo.extend(hit)
    return out


def _few(rid: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside many small cells at once; rid numbers the cells. The embedding's distance is tested first."""
    out, emb, k = [], _embed(fp), 1
    while k < rid.size and (same := np.flatnonzero(rid[k:] == rid[:-k])).size:
        same = same[np.bitwise_count(emb[same] ^ emb[same + k]) <= RADIUS]
        same = same[np.bitwise_count(fp[same] ^ fp[same + k]) <= RADIUS]
        out.append((fp[same], fp[same + k]))
        k += 1
    return out


def _links(keys: int, limit: int | None):
    """mapInArrow function over rows (keys..., fp), sorted: rows (a, b, keys...); a null b marks a row put off."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, over = None, None

        def table(pairs, off=None):
            a = np.concatenate([np.empty(0, np.uint64), *(p[0] for p in pairs)]).view(np.int64)
            b = np.concatenate([np.empty(0, np.uint64), *(p[1] for p in pairs)]).view(np.int64)
            cols = [pa.array(a), pa.array(b)] + [pa.nulls(a.size, pa.int64())] * keys
            if off is not None:
                fp = off[-1].view(np.int64)
                cols = [pa.array(fp), pa.nulls(fp.size, pa.int64()), *(pa.array(k) for k in off[:-1])]
            return pa.RecordBatch.from_arrays(cols, ["a", "b", *(f"k{i}" for i in range(keys))])

        def work(cols: list[np.ndarray], last: bool):
            """Handles the cells that have ended; gives the rest."""
            nonlocal over
            fp = cols[-1]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:-1]])) + 1
            cut = np.concatenate([[0], change, [fp.size]])
            if over is not None:  # a cell that is put off goes on
                end = int(cut[1]) if all(c[0] == k for c, k in zip(cols, over, strict=False)) else 0
                if end:
                    yield table([], [c[:end] for c in cols])
                if end < fp.size:
                    over = None
                cols = [c[end:] for c in cols]
                if not cols[-1].size:
                    return cols
                fp, cut = cols[-1], cut[cut >= end] - end
                cut = cut if cut[0] == 0 else np.concatenate([[0], cut])
            stop = int(cut[-1] if last else cut[-2])
            if limit and fp.size - stop > limit:
                over = [c[-1] for c in cols[:-1]]
                yield table([], [c[stop:] for c in cols])
                rest = [c[:0] for c in cols]
            else:
                rest = [c[stop:] for c in cols]
            sizes = np.diff(cut if last else cut[:-1])
            pairs = []
            if sizes.size:
                rid = np.repeat(np.arange(sizes.size), sizes)
                small = (sizes > 1) & (sizes <= 24)
                at = np.flatnonzero(small[rid])
                pairs += _few(rid[at], fp[at])
                for i in np.flatnonzero(sizes > 24):
                    if limit and sizes[i] > limit:
                        yield table([], [c[cut[i] : cut[i + 1]] for c in cols])
                    else:
                        pairs += forest(fp[cut[i] : cut[i + 1]])
            yield table(pairs)
            return rest

        for b in batches:
            cols = [np.asarray(b.column(i)) for i in range(keys)] + [np.asarray(b.column(keys)).view(np.uint64)]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            if cols[-1].size:
                carry = yield from work(cols, False)
        if carry is not None and carry[-1].size:
            yield from work(carry, True)

    return run


def _search(cells: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    dealt = cells.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(_links(len(keys), limit), "a long, b long, " + ", ".join(f"k{i} long" for i in range(len(keys))))


def links(distinct: DataFrame, groups: int, limit: int = MAX_CELL) -> DataFrame:
    """(a, b): edges among distinct fingerprints `fp` that connect exactly what the links connect."""
    emb = embedding(F.col("fp"))
    cells = distinct.select("fp", emb.alias("emb")).select(
        "fp", F.posexplode(F.array(*(F.col("emb").bitwiseAND(F.lit(signed(m))) for m in projections(groups)))).alias("k0", "k1")
    )
    cells = cells.select(F.col("k0").cast("long").alias("k0"), "k1", "fp")
    found = publish(_search(cells, ["k0", "k1"], limit), "links")
    edges = found.where("b IS NOT NULL").select("a", "b")
    off = found.where("b IS NULL").select("k0", "k1", F.col("a").alias("fp"))
    if off.isEmpty():
        return edges.distinct()
    half = max(1, limit // 2)
    blocks = off.groupBy("k0", "k1").agg(F.ceil(F.count("*") / half).alias("n"))
    dealt = off.join(blocks, ["k0", "k1"]).withColumn("own", F.pmod(F.xxhash64("fp"), "n"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = dealt.withColumn("k2", F.least("own", "other")).withColumn("k3", F.greatest("own", "other"))
    rest = _search(dealt, ["k0", "k1", "k2", "k3"], None)
    return edges.union(rest.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes of one component share their root.

    Each round every node joins the neighbour (or itself) with the least random priority, and edges are renamed.
    """
    edges = publish(edges.where("a <> b"), "edges")
    names = None
    for k in range(ROUNDS):
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        to = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
        to = publish(to.select("node", F.least(F.col("m"), rank("node"))["v"].alias("root")), "round")
        go = lambda c: to.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to"))  # noqa: B023, E731
        if names is None:
            names = to
        else:
            before, named = names, names.withColumnRenamed("root", "old").join(go("old"), "old", "left")
            names = publish(named.select("node", F.coalesce("old_to", "old").alias("root")), "names")
            discard(before)
        before = edges
        edges = edges.join(go("a"), "a").join(go("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = publish(edges.where("a <> b").distinct(), "edges")
        discard(before, None if names is to else to)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return names if names is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, shingle: int = 4, seed: int = 42, groups: int | None = None, limit: int = MAX_CELL, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The fingerprints of docs; (fp, root) of the distinct ones; (root, first) of the components.

    more: further links (a, b) among texts, by their `text_hash`.
    first is a component's first row by doc_id (nulls last), then the text's hash: struct(none, doc_id, text_hash).
    """
    fps = publish(fingerprints(docs, shingle, seed), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = publish(fps.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    edges = links(distinct.select("fp"), groups or groups_for(distinct.count()), limit)
    if more is not None:
        of = fps.select("text_hash", "fp").distinct()
        end = lambda c: of.select(F.col("text_hash").alias(c), F.col("fp").alias(f"{c}_fp"))
        edges = edges.union(more.join(end("a"), "a").join(end("b"), "b").select("a_fp", "b_fp"))
    named = components(edges)
    of = distinct.join(named, distinct["fp"] == named["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return fps, of.select("fp", "root"), of.groupBy("root").agg(F.min("first").alias("first"))


def near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links. Options as of `classes`."""
    fps, of, firsts = classes(docs, **kw)
    ids = publish(of.join(firsts, "root").select("fp", F.col("first.doc_id").alias("component_id")), "components")
    return fps.join(ids, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (of repeated rows, one). All columns stay.

    Texts are shuffled only where a kept row is repeated, or if the list of what goes is too long to be broadcast.
    """
    names = docs.columns
    own_id, own_hash = fresh(docs, "_id", "_hash")
    fps, _, firsts = classes(docs, **kw)
    firsts = firsts.select(F.col("first.doc_id").alias("_keep"), F.col("first.text_hash").alias("_keep_hash"))
    keys = fps.groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).agg(F.count("*").alias("_n"))
    keys = keys.join(firsts, keys[own_id].eqNullSafe(firsts["_keep"]) & (keys[own_hash] == firsts["_keep_hash"]), "left")
    keys = keys.select(own_id, own_hash, F.col("_keep_hash").isNotNull().alias("_first"), "_n").where("NOT _first OR _n > 1")
    keys = publish(keys, "copies")
    rows = docs.select("*", F.col("doc_id").cast("long").alias(own_id), text_hash(F.col("text")).alias(own_hash))
    match = lambda k: rows[own_id].eqNullSafe(k[own_id]) & (rows[own_hash] == k[own_hash])
    slim = short(keys.select(own_id, own_hash))
    kept = rows.join(slim, match(slim), "left_anti")
    again = keys.where("_first").select(own_id, own_hash)
    if not again.isEmpty():
        again = short(again)
        kept = kept.union(rows.join(again, match(again), "left_semi").dropDuplicates([own_id, own_hash]))
    return kept.select(*names)
