"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on doc_id.

A document's ids stand in rows of at most BLOCK ids, so a very long text is many rows of bounded size. Documents are
dealt by ranges of doc_id and sorted within, so files, stripes and row groups hold narrow ranges of ids; the min/max
statistics and the Bloom filters of the index streams let a reader of some documents (`lookup`) skip the rest, and any
stripe can be read on its own. Each row carries its place in its file (`file_start`), and a table of parts (one row per file) the
ids before each file, so reading needs no ordering between stripes.

Defined results: null text counts as empty (it has the end id alone). Null doc_ids come first. Repeated doc_ids are
dealt and ordered by their text's hash too, and keep their rows apart; rows equal in both are interchangeable. Empty
table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.llm.tokens import TEXTS, encoder

BLOCK = 65_536
#: Ids to hand over at once, in bytes.
BATCH_BYTES = 4 << 20
END_ID = 1
#: Chunks that a worker remembers.
CHUNKS = 1_000_000
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "2000",
    "orc.create.index": "true",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}
ROWS = "part int, doc_no long, doc_id long, block int, blocks int, n_tokens long, file_start long, ids array<int>"


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID, keep_blank: bool = False, block: int = BLOCK) -> DataFrame:
    """Rows of the file format, in ascending doc_id order within and between partitions."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = slim.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at, doc_no, end = encoder(tokenizer, keep_blank, CHUNKS), TaskContext.get().partitionId(), 0, 0, end_id.to_bytes(4, "little")
        rows: list[tuple] = []
        ids: list[bytes] = []

        def ready() -> pa.RecordBatch:
            sizes = [len(x) // 4 for x in ids]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part, np.int32)), *cols, lists], ["part", "doc_no", "doc_id", "block", "blocks", "n_tokens", "file_start", "ids"])

        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                own = b.slice(lo, TEXTS)
                for doc_id, raw in zip(own.column(0).to_pylist(), enc.encode(own.column(1).to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    blocks = -(-n // block)
                    for k in range(blocks):
                        rows.append((doc_no, doc_id, k, blocks, n, at))
                        ids.append(raw if blocks == 1 else raw[4 * k * block : 4 * (k + 1) * block])
                    at += n
                    doc_no += 1
                if sum(map(len, ids)) > BATCH_BYTES:
                    yield ready()
                    rows.clear(), ids.clear()
        if rows:
            yield ready()

    return dealt.mapInArrow(run, ROWS)


def write(docs: DataFrame, path: str, tokenizer: str, **kw) -> None:
    """Files under path/ids, and the table of parts under path/parts."""
    spark = docs.sparkSession
    rows = encode(docs, tokenizer, **kw)
    rows.write.options(**ORC).orc(f"{path}/ids")
    ids = spark.read.schema(ROWS).orc(f"{path}/ids")
    parts = ids.where("block = 0").groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    # One row per file: the only thing that is summed in one task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", "tokens", "docs", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first_id")).coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, with `start`: ids of all documents before this one."""
    ids = spark.read.schema(ROWS).orc(f"{path}/ids")
    parts = spark.read.parquet(f"{path}/parts").select("part", "first_id")
    return ids.join(parts, "part").withColumn("start", F.col("first_id") + F.col("file_start")).drop("first_id")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents. The ids reach the ORC reader, which skips files and stripes by their ranges, and row
    groups by ranges and Bloom filters."""
    return read(spark, path).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document of `read`; a document of several rows is put together in order."""
    narrow = ["doc_id", "start", "n_tokens", "part", "doc_no", "block", "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(6)
            values, off = np.asarray(ids.values).astype("<u4", copy=False), np.asarray(ids.offsets)
            crc = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted blocks of long documents: one running checksum each."""
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (3, 4, 0, 1, 2)), b.column(6), strict=True))
        for (_, _, *head), own in groupby(rows, key=lambda r: r[:5]):
            crc = 0
            for r in own:
                crc = zlib.crc32(np.asarray(r[5].values).astype("<u4", copy=False).tobytes(), crc)
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), (*head, crc), strict=True))], schema=OUT)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    whole = rows.where("blocks = 1").select(*narrow).mapInArrow(run, schema)
    long = rows.where("blocks > 1").select(*narrow)
    return whole.union(long.repartition("part", "doc_no").sortWithinPartitions("part", "doc_no", "block").mapInArrow(gather, schema))


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
