"""Packing by lexical retrieval: a sharded BM25 index finds what fills a window.

Documents are indexed in shards that a task holds in memory: up to SHARD_DOCS documents and SHARD_TOKENS ids of the
rows at hand, without a shuffle (the document that reaches either number ends its shard, however long it is). A document's full windows
are cut off first, and its rest opens a window: BM25 over the shard's words ranks the unused rests against the words of
the seed's rest, and they fill the window in that order; the last one is cut where the window ends, and what is left of
it stays unused. Without related rests, unused ones follow in order, so only a shard's last window can have room left.
Terms in more than half of a shard's documents carry no weight, as in BM25 with its idf kept from going below zero.

A sequence holds `window` ids; a shorter one is padded to `window`, except at a power of two.

Defined results: null text counts as empty (it has the end id alone). Each row is a document of its own, also with a
null or repeated doc_id. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import lean
from tally.llm.tokens import TEXTS, encoder

WINDOW = 1024
END_ID = 0
SHARD_DOCS = 1024
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
SHARD_BITS = 20
#: Chunks that a worker remembers.
CHUNKS = 1_200_000
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Index:
    """BM25 over a shard's rests; terms are words."""

    def __init__(self, docs: list[list[str]]):
        n = len(docs)
        size = np.fromiter(map(len, docs), np.int64, n)
        flat = np.empty(int(size.sum()), object)
        flat[:] = list(chain.from_iterable(docs))
        code, vocab = pd.factorize(flat)
        both, tf = np.unique(np.repeat(np.arange(n), size) << 32 | code, return_counts=True)
        of, term = both >> 32, both & 0xFFFFFFFF
        self.term, self.term_at = term, np.searchsorted(of, np.arange(n + 1))
        df = np.bincount(term, minlength=len(vocab))
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[of] / max(size.mean() if n else 1, 1e-9)))
        order = np.argsort(term, kind="stable")
        self.of, self.weight = of[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(df)])
        self.idf = idf

    def neighbours(self, i: int) -> np.ndarray:
        """Documents that share a term of weight with document i, best first; all of its terms ask."""
        t = self.term[self.term_at[i] : self.term_at[i + 1]]
        n = self.at[t + 1] - self.at[t]
        use = (self.idf[t] > 0) & (n > 1)
        t, n = t[use], n[use]
        if not t.size:
            return t
        own = np.repeat(self.at[t] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        score = np.bincount(self.of[own], self.weight[own])
        docs = np.flatnonzero(score)
        return docs[np.argsort(-score[docs], kind="stable")]


def pack_shard(sizes: list[int], index: Index, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); every id of every document in exactly one."""
    left = [0] * len(sizes)  # where the unused rest starts
    queue: deque[int] = deque()
    for i, n in enumerate(sizes):
        full = n // window * window
        for at in range(0, full, window):
            yield [(i, at, window)]
        left[i] = full
        if full < n:
            queue.append(i)
    while queue:
        seed = queue.popleft()
        if left[seed] == sizes[seed]:
            continue
        row, room = [(seed, left[seed], sizes[seed] - left[seed])], window - (sizes[seed] - left[seed])
        left[seed] = sizes[seed]
        near = iter(index.neighbours(seed).tolist()) if room else iter(())
        while room:
            i = next(near, None)
            if i is None:
                while queue and left[queue[0]] == sizes[queue[0]]:
                    queue.popleft()
                if not queue:
                    break
                i = queue[0]
            if take := min(room, sizes[i] - left[i]):
                row.append((i, left[i], take))
                left[i] += take
                room -= take
        yield row


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW, keep_blank: bool = True, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS, chunks: int = CHUNKS) -> DataFrame:
    """One row per piece; ids are little-endian unsigned 32-bit integers. chunks: how many the encoder remembers."""

    def pieces(shard: list[tuple[int | None, bytes, str]], first: int) -> Iterator[pa.RecordBatch]:
        sizes = [len(raw) // 4 for _, raw, _ in shard]
        index = Index([text.split() for _, _, text in shard])
        rows: list[list] = [[] for _ in range(7)]
        for k, row in enumerate(pack_shard(sizes, index, window)):
            at = 0
            for i, start, n in row:
                doc_id, raw, _ = shard[i]
                for c, v in zip(rows, (doc_id, start, n, raw[4 * start : 4 * (start + n)], sizes[i], first + k, at), strict=True):
                    c.append(v)
                at += n
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], [x.split()[0] for x in PIECE.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, keep_blank, chunks), int(end_id).to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 40
        shard, tokens = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                own = b.slice(lo, TEXTS)
                texts = own.column(1).to_pylist()
                for doc_id, text, raw in zip(own.column(0).to_pylist(), texts, enc.encode(texts), strict=True):
                    raw += end
                    rest = len(raw) // 4 % window
                    # the words that stand for the rest: the text's end, in proportion
                    tail = text[len(text) - len(text) * rest * 4 // len(raw) :]
                    shard.append((doc_id, raw, tail))
                    tokens += len(raw) // 4
                    if len(shard) >= shard_docs or tokens >= shard_tokens:
                        yield from pieces(shard, first)
                        first += 1 << SHARD_BITS
                        shard, tokens = [], 0
        if shard:
            yield from pieces(shard, first)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(run, "encoders"), PIECE)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
