"""Benchmark decontamination: rare word pairs as seeds, then Smith-Waterman alignment.

One pass over the documents finds pairs of adjacent words that some test item has, and groups those of one item that lie
near each other in the document into a passage, cut out with room on both sides. A passage goes on to alignment if it
can reach the threshold: a match of m words in r runs scores at most m - (r - 1) / 2, so it keeps at least
(2 * threshold - 1) * n - 1 of an item's pairs, n being the item's number of words. Of that many pairs but one an item
can do without as seeds: its most common ones (COMMON), and so many fewer are asked for. Rarity saves work; it never
decides a result. A task remembers the scores of the passages it has met (CACHE), so copies cost little. The alignment
is local and exact, over words; its score, divided by the item's number of words, is 1 for a verbatim copy. A match must
also score FLOOR words, which tells short items from chance.

The test items are shipped to the executors in slices of a checked size (SLICE_BYTES of text each); a larger benchmark
means more passes, never a larger broadcast. Only matches are shuffled.

Defined results: null and empty texts and items never match, nor do items of fewer than FLOOR words. Items without an id
are items (their item_id is null). Repeated item rows count as one item; repeated documents give the same answer, once.
A null doc_id is carried as null beside the hash of its text. Empty tables: no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import fresh, lean, publish, short

RARE_SHARE = 1e-4
RARE_LEAST = 20
MIN_LINE = 3
SLACK = 8
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
THRESHOLD = 0.6
FLOOR = 4
COMMON = 8
SLICE_BYTES = 8 << 20
CACHE = 1 << 14
WORDS = re.compile(r"\w+")
#: An odd multiplier for hashing pairs of word numbers.
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class Items:
    """Test items of one slice: numbered words, seeds and how many of them a match must keep."""

    def __init__(self, rows: list[tuple[int | None, str]], threshold: float = THRESHOLD):
        self.vocab: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.texts: list[str] = []
        self.words: list[np.ndarray] = []
        for item_id, text in rows:
            w = words_of(text)
            if len(w) < FLOOR:
                continue
            self.ids.append(item_id)
            self.texts.append(text)
            self.words.append(np.array([self.vocab.setdefault(v, len(self.vocab) + 1) for v in w], np.int64))
        self.pairs = [pairs(x) for x in self.words]
        every = np.concatenate([np.empty(0, np.uint64), *self.pairs])
        kinds, code, df = np.unique(every, return_inverse=True, return_counts=True)
        df, at, keep = df[code], 0, np.ones(every.size, bool)
        size = np.array([x.size for x in self.words], np.int64)
        self.least = np.maximum(threshold * size, FLOOR) - 1e-6
        self.span = size + np.floor(2 * (size - self.least)).astype(np.int64) + 1  # words that a match can reach over
        self.need = np.maximum(np.ceil(2 * self.least - size - 1), 1).astype(np.int64)
        for k, p in enumerate(self.pairs):
            own = df[at : at + p.size]
            drop = np.argsort(-own, kind="stable")[: self.need[k] - 1]
            drop = drop[own[drop] > COMMON]
            keep[at + drop] = False
            self.need[k] -= drop.size
            at += p.size
        place = np.array([(k, i) for k, p in enumerate(self.pairs) for i in range(p.size)], np.int64).reshape(-1, 2)
        order = np.argsort(every[keep], kind="stable")
        self.keys, start = np.unique(every[keep][order], return_index=True)
        self.start, self.at = np.append(start, order.size), place[keep][order]

    def number(self, words: list[str]) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, 0) for w in words], np.int64)

    def hits(self, x: np.ndarray) -> np.ndarray:
        """Rows (item, place in the item, place in x) of seeds, by item and place in x, where enough lie close together."""
        none = np.empty((0, 3), np.int64)
        if x.size < 2 or not self.keys.size:
            return none
        places = np.flatnonzero((x[1:] != 0) & (x[:-1] != 0))
        k = pairs(x)[places]
        at = np.minimum(np.searchsorted(self.keys, k), self.keys.size - 1)
        same = self.keys[at] == k
        places, at = places[same], at[same]
        n = self.start[at + 1] - self.start[at]
        if not places.size:
            return none
        rep = np.repeat(np.arange(n.size), n)
        of = np.arange(rep.size) - np.repeat(np.cumsum(n) - n, n) + self.start[at][rep]
        item = self.at[of, 0]
        some = (np.bincount(item, minlength=self.need.size) >= self.need)[item]
        if not some.any():
            return none
        out = np.column_stack([self.at[of[some]], places[rep[some]]])
        out = out[np.lexsort((out[:, 2], out[:, 0]))]
        own = out[:, 0]
        first = np.arange(own.size)
        last = first + self.need[own] - 1
        end = np.minimum(last, own.size - 1)
        ok = (last < own.size) & (own[end] == own) & (out[end, 2] - out[:, 2] < self.span[own])
        cover = np.zeros(own.size + 1, np.int64)
        np.add.at(cover, first[ok], 1)
        np.add.at(cover, last[ok] + 1, -1)
        return out[np.cumsum(cover[:-1]) > 0]

    def reach(self, item: int, x: np.ndarray, own: np.ndarray) -> float:
        """The most that the item can score in words x with pairs `own`."""
        m = int(np.isin(self.words[item], x).sum())
        return min(m, (m + int(np.isin(self.pairs[item], own).sum()) + 1) / 2)


def pairs(x: np.ndarray) -> np.ndarray:
    """Hashes of all pairs of neighbours; equal hashes of different ones only cost an alignment."""
    u = x.astype(np.uint64)
    return u[:-1] * MIX + u[1:]


def on_line(hits: np.ndarray) -> int:
    """The most different seeds whose offsets (document minus item) differ by SLACK at most, counted up to MIN_LINE."""
    off, places = hits[:, 2] - hits[:, 1], hits[:, 1]
    order = np.argsort(off, kind="stable")
    off, places = off[order], places[order].tolist()
    held: Counter[int] = Counter()
    best = end = 0
    for i, to in enumerate(np.searchsorted(off, off + SLACK, "right").tolist()):
        while end < to and best < MIN_LINE:
            held[places[end]] += 1
            end += 1
            best = max(best, len(held))
        if best >= MIN_LINE:
            break
        held[places[i]] -= 1
        if not held[places[i]]:
            del held[places[i]]
    return best


def passages(items: Items, text: str | None) -> Iterator[tuple[int, str, int]]:
    """(item, words of the passage, its first word's place) of each passage that can reach the threshold."""
    w = words_of(text)
    x = items.number(w)
    h = items.hits(x)
    if not h.shape[0]:
        return
    own = pairs(x)
    cut = np.flatnonzero((h[1:, 0] != h[:-1, 0]) | (h[1:, 2] - h[:-1, 2] >= items.span[h[1:, 0]])) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), h.shape[0]], strict=True):
        item = int(h[a, 0])
        n = items.words[item].size
        off, room = h[a:b, 2] - h[a:b, 1], int(items.span[item]) - n
        first, last = max(0, int(off.min()) - room), min(len(w), int(off.max()) + n + room)
        if items.reach(item, x[first:last], own[first : last - 1]) >= items.least[item]:
            yield item, " ".join(w[first:last]), first


def align(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of a within b, and the place behind its end in b (Smith-Waterman, linear gaps)."""
    idx = np.arange(b.size + 1) * -GAP
    prev, best, end = np.zeros(b.size + 1), 0.0, 0
    for x in a:
        cur = np.maximum(prev + GAP, 0)
        np.maximum(cur[1:], prev[:-1] + np.where(b == x, MATCH, MISMATCH), out=cur[1:])
        prev = np.maximum.accumulate(cur + idx) - idx
        j = int(prev.argmax())
        if prev[j] > best:
            best, end = float(prev[j]), j
    return best, end


def similarity(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """(score by the item's words, first and last place of the best alignment in the passage, end exclusive)."""
    vocab = {w: i for i, w in enumerate(item, 1)}
    a, b = (np.array([vocab.get(w, 0) for w in x], np.int64) for x in (item, passage))
    best, end = align(a, b)
    _, back = align(a[::-1], b[:end][::-1])
    return best / len(item), end - back, end


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, slice_bytes: int = SLICE_BYTES, rare_least: int = RARE_LEAST, rare_share: float = RARE_SHARE) -> DataFrame:
    """(doc_id, text_hash, item_id, score, first_word, end_word) for each document and item that align well enough.

    Places count words (`\\w+`, lower case) of the document. rare_least and rare_share decide nothing any more.
    """
    spark = docs.sparkSession
    items = publish(benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), "items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-size // slice_bytes))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    out = None
    for k in range(slices):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k)
        shared = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # slice_bytes of text, give or take

        def find(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Items(sorted(shared.value, key=lambda r: (r[0] is not None, r)), threshold)

            @lru_cache(CACHE)
            def aligned(item: int, words: str) -> tuple[float, int, int]:
                score, a, b = similarity(words_of(known.texts[item]), words.split(" "))
                return round(score, 6), a, b

            for batch in batches:
                rows: list[list] = [[] for _ in range(5)]
                for i, t in enumerate(batch.column(2)):
                    for item, words, first in passages(known, t.as_py()):
                        score, a, b = aligned(item, words)
                        if score * known.words[item].size >= known.least[item]:
                            for c, v in zip(rows, (i, known.ids[item], score, first + a, first + b), strict=True):
                                c.append(v)
                at = pa.array(rows[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())],
                    ["doc_id", "text_hash", "item_id", "score", "first_word", "end_word"],
                )

        found = base.mapInArrow(lean(find), "doc_id long, text_hash long, item_id long, score double, first_word long, end_word long")
        out = found if out is None else out.union(found)
    best = F.min(F.struct((-F.col("score")).alias("s"), "first_word", "end_word")).alias("m")
    scored = publish(out, "matches").groupBy("doc_id", "text_hash", "item_id").agg(best)
    return scored.select("doc_id", "text_hash", "item_id", (-F.col("m.s")).alias("score"), F.col("m.first_word").alias("first_word"), F.col("m.end_word").alias("end_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents in which no test item is found, with their columns."""
    own_id, own_hash = fresh(docs, "_id", "_hash")
    bad = contaminated(docs, benchmark, **kw).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    bad = short(publish(bad, "contaminated"))
    same = docs["doc_id"].cast("long").eqNullSafe(bad[own_id]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad[own_hash])
    return docs.join(bad, same, "left_anti")
