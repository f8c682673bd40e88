"""Sharding along a Hilbert curve, in DataFrame functions only.

Size, language and source are quantised to BITS bits each: sizes by their logarithm, names by their place in the order
of all names, so that a step holds a range of names and steps hold about equal counts of rows (a name that many rows
have is a step of its own). The cell's place on the three-dimensional Hilbert curve is the sort key, and the sorted rows
are cut into runs of equal counts (law `rows`). Neighbours on the curve are neighbours in all three, so a shard's files
hold narrow ranges of each, and readers prune by any of them.

The order is total and needs no sort of all rows in one place: the curve has 2 ** (3 * BITS) cells, each cell is dealt
into SUBS parts by a hash of doc_id and text, rows are ranked within a part, and the counts of parts and cells (at most that
many, whatever the input) give the rank before each. A cell that holds a third of all rows is SUBS tasks' work.

Defined results: null text has size 1; null lang or source counts as an empty string. Null doc_ids sort first within
their part. Rows that are equal in all that orders them are interchangeable, and in one part.
Empty table: no rows. Further columns are kept on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import fresh, publish, short

BITS = 4
SHARDS = 16
SUBS = 256
#: Cells whose counts one task may sum, and a broadcast may hold.
MAX_CELLS = 1 << 15


def curve_index(axes: tuple[int, ...], bits: int) -> int:
    """Place on the Hilbert curve of a cell, by Skilling's transposition."""
    x, top = list(axes), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for j in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> j & 1)
    return out


def steps(names: DataFrame, bits: int) -> DataFrame:
    """(name, step) of a column's names (name, n): names in order, cut where their rows reach the next of 2 ** bits parts.

    Names are few beside rows, but no bound is assumed: runs of names are summed by first letters before any order.
    """
    head = F.substring("name", 1, 2)
    runs = names.groupBy(head.alias("_run")).agg(F.sum("n").alias("_in"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_run", before(Window.orderBy("_run"), "_in").alias("_first"), F.sum("_in").over(Window.partitionBy()).alias("_all"))
    own = names.withColumn("_run", head).withColumn("_own", before(Window.partitionBy("_run").orderBy("name"), "n")).join(runs, "_run")
    middle = F.col("_first") + F.col("_own") + F.col("n") / 2
    return own.select("name", F.least(F.floor(middle * (1 << bits) / F.col("_all")), F.lit((1 << bits) - 1)).cast("int").alias("step"))


def curve(bits: int) -> Column:
    """Places on the curve of all cells, by (size, lang, source)."""
    n = 1 << bits
    return F.lit([curve_index((a, b, c), bits) for a in range(n) for b in range(n) for c in range(n)])


def placed(docs: DataFrame, keep: list[str] | None = None, shards: int = SHARDS, bits: int = BITS, subs: int = SUBS) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) and the columns `keep`."""
    keep = [c for c in keep or [] if c not in ("doc_id", "size", "text_crc32", "curve", "shard", "slot")]
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    n = 1 << bits
    if n**3 > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    octave = F.least(F.greatest(F.floor(F.log2(size.cast("double"))) - 4, F.lit(0)), F.lit(n - 1)).cast("int")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        octave.alias("_octave"),
        name("lang").alias("_lang"),
        name("source").alias("_source"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(subs)).cast("int").alias("_sub"),
        *keep,
    )
    if not keep:
        rows = publish(rows, "sizes")  # the texts are read once
    counts = lambda c: (docs.select(name(c[1:]).alias("name")) if keep else rows.select(F.col(c).alias("name"))).groupBy("name").agg(F.count("*").alias("n"))
    for c in ("_lang", "_source"):
        of = short(publish(steps(counts(c), bits), "steps")).select(F.col("name").alias(c), F.col("step").alias(f"{c}_step"))
        rows = rows.join(of, c)
    at = (F.col("_octave") * n + F.col("_lang_step")) * n + F.col("_source_step")
    rows = rows.withColumn("curve", F.get(curve(bits), at))
    parts = publish(rows.groupBy("curve", "_sub").agg(F.count("*").alias("_n")), "parts")
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # At most 2 ** (3 * bits) cells: a fixed number, so one task may sum them.
    cells = parts.groupBy("curve").agg(F.sum("_n").alias("_in"))
    cells = cells.select("curve", F.coalesce(F.sum("_in").over(up_to(Window.orderBy("curve"))), F.lit(0)).alias("_before"), F.sum("_in").over(Window.partitionBy()).alias("_all"))
    own = F.coalesce(F.sum("_n").over(up_to(Window.partitionBy("curve").orderBy("_sub"))), F.lit(0))
    starts = parts.join(F.broadcast(cells), "curve").select("curve", "_sub", "_all", (F.col("_before") + own).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("curve", "_sub").orderBy("doc_id", "text_crc32", "size"))
    at = F.col("_first") + F.col("_rank") - 1
    ranked = rows.withColumn("_rank", rank).join(starts, ["curve", "_sub"]).withColumn("_at", at)
    shard = F.expr(f"_at * {shards} DIV _all")
    return ranked.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "curve", *keep, "shard", F.expr(f"_at - (CAST(shard AS LONG) * _all + {shards - 1}) DIV {shards}").alias("slot")
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 4, **kw) -> None:
    """Parquet under path/shard=N: each shard in `files` runs of the curve, sorted, for pruning by files and row groups.

    Columns shard, curve and slot are added; of columns with these names, the operator's get underscores before them.
    """
    own = fresh(docs, "shard", "curve", "slot")
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang", "source")
    out = placed(whole, ["_row"], shards, **kw)
    top = out.select(*(F.col(a).alias(b) for a, b in zip(("shard", "curve", "slot"), own, strict=True)), *(F.col("_row")[c].alias(c) for c in docs.columns))
    top.repartitionByRange(shards * files, own[0], own[2]).sortWithinPartitions(own[0], own[2]).write.partitionBy(own[0]).parquet(path)
