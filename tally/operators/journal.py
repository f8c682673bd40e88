"""Writing a book in batches: which submissions are accepted, and the log that records them.

Most of a batch is decided in parallel. Only what is sequential by nature runs as a stream of sorted rows in one task
per ledger: the hash chain, and acceptance in ledgers where some bound is crossed (a refusal changes what follows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.functions import domain
from tally.plans.prefix import running_sums

UNBOUNDED = "address = 'world' OR address LIKE 'external:%'"


def chained(logs: DataFrame) -> DataFrame:
    """Log entries (ledger, id, data ...) and `hash`, each over the one before it. Rows stream; nothing is held."""
    names = logs.columns
    at = {c: names.index(c) for c in ("ledger", "data")}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, last = None, b""
        for b in batches:
            out = []
            for own, data in zip(b.column(at["ledger"]).to_pylist(), b.column(at["data"]).to_pylist(), strict=True):
                if own != ledger:
                    ledger, last = own, b""
                last = hashlib.sha256(last + data.encode()).digest()
                out.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*names, "hash"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in logs.schema)
    return logs.repartition("ledger").sortWithinPartitions("ledger", "id").mapInArrow(run, f"{columns}, hash binary")


def crossings(moves: DataFrame) -> DataFrame:
    """(ledger, tx_id, address, asset, balance): balances after each transaction that a bounded account may not have.

    Balances are judged at the end of a transaction, in the order of insertion; within one they may pass through zero.
    """
    delta = moves.where(f"NOT ({UNBOUNDED})").groupBy("ledger", "tx_id", "address", "asset").agg(F.sum(F.when(F.col("is_source"), -F.col("amount")).otherwise(F.col("amount"))).alias("d"))
    run = running_sums(delta, ["ledger", "address", "asset"], ["tx_id"], {"balance": F.col("d")}, F.expr("tx_id DIV 4096"), F.expr("tx_id DIV 16777216"))
    return run.where("balance < 0").select("ledger", "tx_id", "address", "asset", "balance")


def content_hash() -> Column:
    return domain.canonical_hash(*(F.col(c) for c in ("source", "destination", "asset", "amount")))


def applied(submissions: DataFrame) -> DataFrame:
    """Each submission (ledger, arrival, source, destination, asset, amount, idem_key) with tx_id and outcome.

    Outcomes: accepted, replayed, idempotency mismatch, insufficient funds, or what is wrong with the posting. An
    accepted key replays later submissions of the same content and refuses others. Ids are gapless over the accepted
    submissions of a ledger. Where no bounded account of a ledger goes below zero, all is decided by windows; only other
    ledgers are folded in order, holding their balances.
    """
    p = F.struct("source", "destination", "asset", "amount", F.lit(False).alias("up_to"))
    rows = submissions.withColumn("fault", domain.posting_fault(p)).withColumn("content", content_hash())
    good = rows.where("fault IS NULL")
    first = Window.partitionBy("ledger", "idem_key").orderBy("arrival")
    keyed = good.where("idem_key IS NOT NULL").withColumn("first", F.first("content").over(first)).withColumn("n", F.row_number().over(first))
    keyed = keyed.withColumn("outcome", F.when(F.col("n") == 1, "accepted").when(F.col("first") == F.col("content"), "replayed").otherwise("idempotency mismatch")).drop("first", "n")
    hopeful = good.where("idem_key IS NULL").withColumn("outcome", F.lit("accepted")).unionByName(keyed)
    legs = hopeful.where("outcome = 'accepted'").select("ledger", F.col("arrival").alias("tx_id"), "asset", "amount", F.inline(F.array(F.struct(F.col("source").alias("address"), F.lit(True).alias("is_source")), F.struct(F.col("destination").alias("address"), F.lit(False).alias("is_source")))))
    tight = crossings(legs).select("ledger").distinct()
    parallel = hopeful.join(tight, "ledger", "left_anti")
    cols = ["ledger", "arrival", "source", "destination", "asset", "amount", "idem_key", "content"]
    folded = good.join(tight, "ledger", "left_semi").select(*cols).repartition("ledger").sortWithinPartitions("ledger", "arrival")
    kinds = "ledger string, arrival long, source string, destination string, asset string, amount long, idem_key string, content string, outcome string"
    folded = folded.mapInArrow(_fold, kinds)
    out = parallel.select(*cols, "outcome").unionByName(folded).unionByName(rows.where("fault IS NOT NULL").select(*cols, F.col("fault").alias("outcome")))
    ids = running_sums(out.where("outcome = 'accepted'").select("ledger", "arrival"), ["ledger"], ["arrival"], {"tx_id": F.lit(1).cast("long")}, F.expr("arrival DIV 4096"), F.expr("arrival DIV 16777216"))
    return out.join(ids, ["ledger", "arrival"], "left").drop("content")


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ledger, funds, keys = None, {}, {}
    for b in batches:
        out = []
        for own, _, source, destination, asset, amount, key, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if own != ledger:
                ledger, funds, keys = own, {}, {}
            if key is not None and key in keys:
                out.append("replayed" if keys[key] == content else "idempotency mismatch")
                continue
            free = source == "world" or source.startswith("external:") or source == destination
            if not free and amount and funds.get((source, asset), 0) < amount:
                out.append("insufficient funds")
                continue
            funds[source, asset] = funds.get((source, asset), 0) - amount
            funds[destination, asset] = funds.get((destination, asset), 0) + amount
            if key is not None:
                keys[key] = content
            out.append("accepted")
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "outcome"])


def swept(postings: Column, balances: Column) -> Column:
    """Amounts of a transaction's postings with ceilings resolved: an `up_to` posting moves what its source holds, its
    amount at most; postings before it count. `balances` maps account to balance (one asset)."""
    held = lambda m, a: F.coalesce(F.element_at(m, a), F.lit(0).cast("long"))
    put = lambda m, a, v: F.map_concat(F.map_filter(m, lambda k, _: k != a), F.create_map(a, v))

    def step(acc: Column, p: Column) -> Column:
        has = F.greatest(held(acc["m"], p["source"]), F.lit(0).cast("long"))
        amount = F.when(p["up_to"], F.least(F.coalesce(p["amount"], has), has)).otherwise(p["amount"])
        left = put(acc["m"], p["source"], held(acc["m"], p["source"]) - amount)
        return F.struct(put(left, p["destination"], held(left, p["destination"]) + amount).alias("m"), F.array_append(acc["out"], amount).alias("out"))

    start = F.struct(balances.alias("m"), F.expr("CAST(array() AS array<bigint>)").alias("out"))
    return F.aggregate(postings, start, step, lambda acc: acc["out"])


def revert(tx: DataFrame, at_effective: bool = False, at: Column | None = None) -> DataFrame:
    """Reversals of transactions: dated `at` (now, if not given), or like the original on request."""
    when = F.col("eff") if at_effective else F.localtimestamp() if at is None else at
    return tx.select("ledger", F.col("tx_id").alias("reverts"), when.alias("timestamp"), domain.reversed_postings(F.col("postings")).alias("postings"))


def metadata_now(changes: DataFrame) -> DataFrame:
    """(target, key, value) after SET and DELETE entries (target, id, op, key, value): the last entry of a key holds."""
    last = changes.groupBy("target", "key").agg(F.max_by(F.struct("op", "value"), "id").alias("l"))
    return last.where("l.op = 'SET'").select("target", "key", F.col("l.value").alias("value"))


def policies(touched: DataFrame, settings: DataFrame) -> DataFrame:
    """Bounds of accounts: the last setting (address, asset, id, allow_negative), else what creation gives."""
    last = settings.groupBy("address", "asset").agg(F.max_by("allow_negative", "id").alias("set_negative"))
    default = F.col("address") == domain.WORLD
    return touched.join(last, ["address", "asset"], "left").select("address", "asset", F.when(default, True).otherwise(F.coalesce("set_negative", F.lit(False))).alias("allow_negative"))


def unknown_assets(moves: DataFrame, registry: DataFrame) -> DataFrame:
    used = moves.groupBy("ledger", "asset").agg(F.count("*").alias("n"))
    return used.join(registry, ["ledger", "asset"], "left_anti")


def scale_conflicts(registry: DataFrame) -> DataFrame:
    """Asset codes registered with more than one scale."""
    code = domain.asset_code(F.col("asset"))
    return registry.groupBy("ledger", code.alias("code")).agg(F.count_distinct(domain.asset_scale(F.col("asset"))).alias("scales")).where("scales > 1")


def recovery(logs: DataFrame, watermarks: DataFrame) -> DataFrame:
    """RECOVERY entries for ledgers that have fallen back behind a watermark (ledger, watermark): the id above it, and
    the gap that it declares."""
    last = logs.groupBy("ledger").agg(F.max("id").alias("last"))
    rows = watermarks.join(last, "ledger", "left").withColumn("last", F.coalesce("last", F.lit(0))).where("watermark > last")
    return rows.select("ledger", (F.col("watermark") + 1).alias("id"), F.lit("RECOVERY").alias("type"), F.col("last").alias("resumed_from"), F.col("watermark").alias("skipped_through"))
