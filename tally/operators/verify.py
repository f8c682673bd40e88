"""Whole-book checks. Each gives its findings; `summary` gives one row per check."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.functions import domain
from tally.operators import book

#: Log ids per part of a chain when each entry's predecessor is found.
PART = 4096


def predecessors(logs: DataFrame, *columns: str) -> DataFrame:
    """Logs and `prev_<column>` of the entry before each, of its ledger.

    Ids are dealt into parts; the last entry of each part is handed to the parts behind, so no task sorts a whole
    ledger.
    """
    parts = logs.withColumn("_part", F.expr(f"id DIV {PART}"))
    inside = Window.partitionBy("ledger", "_part").orderBy("id")
    last = parts.groupBy("ledger", "_part").agg(F.max_by(F.struct(*columns), "id").alias("_last"))
    last = last.select("ledger", "_part", F.lag("_last").over(Window.partitionBy("ledger").orderBy("_part")).alias("_edge"))
    rows = parts.withColumn("_own", F.lag(F.struct(*columns)).over(inside)).join(last, ["ledger", "_part"])
    prev = F.coalesce("_own", "_edge")
    return rows.select(*logs.columns, *(prev[c].alias(f"prev_{c}") for c in columns))


def conservation(volumes: DataFrame) -> DataFrame:
    """Per ledger and asset: drift must be 0."""
    return volumes.groupBy("ledger", "asset").agg((F.sum("input") - F.sum("output")).alias("drift"), F.count("*").alias("checked"))


def log_hashes(logs: DataFrame) -> DataFrame:
    """Entries whose hash does not follow from the stored hash before them and their data."""
    rows = predecessors(logs, "hash")
    return rows.where(F.unhex(domain.chain_hash(F.col("prev_hash"), F.col("data"))) != F.col("hash")).select("ledger", "id")


def log_gaps(logs: DataFrame) -> DataFrame:
    """Gaps of ids that no RECOVERY entry right behind them declares."""
    rows = predecessors(logs, "id")
    has = {"resumed_from", "skipped_through"} <= set(logs.columns)
    told = (F.col("type") == "RECOVERY") & (F.col("resumed_from") == F.col("prev")) & (F.col("skipped_through") == F.col("id") - 1) if has else F.lit(False)
    rows = rows.withColumn("prev", F.coalesce("prev_id", F.lit(0)))
    return rows.where((F.col("id") != F.col("prev") + 1) & ~F.coalesce(told, F.lit(False))).select("ledger", "id", F.col("prev").alias("after"))


def projection(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """Stored volumes against the log's replay; a stored row of zeros may be extra."""
    s, r = stored.alias("s"), replayed.alias("r")
    on = [F.col(f"s.{c}") == F.col(f"r.{c}") for c in book.KEY]
    both = s.join(r, reduce(Column.__and__, on), "full_outer")
    kind = (
        F.when(F.col("s.address").isNull(), "missing")
        .when(F.col("r.address").isNull(), F.when((F.col("s.input") != 0) | (F.col("s.output") != 0), "extra"))
        .when((F.col("s.input") != F.col("r.input")) | (F.col("s.output") != F.col("r.output")), "mismatch")
    )
    cols = [F.coalesce(f"s.{c}", f"r.{c}").alias(c) for c in book.KEY]
    return both.select(*cols, kind.alias("finding")).where("finding IS NOT NULL")


def logged(tx: DataFrame, logs: DataFrame) -> DataFrame:
    """Transactions that no log entry records, and entries of none."""
    t, entries = tx.select("ledger", F.col("tx_id").alias("id")), logs.where("type = 'NEW_TRANSACTION'").select("ledger", "id")
    lost = t.join(entries, ["ledger", "id"], "left_anti").withColumn("finding", F.lit("not logged"))
    return lost.union(entries.join(t, ["ledger", "id"], "left_anti").withColumn("finding", F.lit("no transaction")))


def effective_volumes(stored: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves whose stored effective volumes differ from the replay's."""
    due = book.with_pcev(moves).select("ledger", "seq", F.col("pcev_input").alias("i"), F.col("pcev_output").alias("o"), "address", "asset", "is_source")
    rows = stored.select("ledger", "seq", F.coalesce("pcev_input", F.lit(0)).alias("si"), F.coalesce("pcev_output", F.lit(0)).alias("so")).join(due, ["ledger", "seq"])
    return rows.where("si <> i OR so <> o").select("ledger", "seq", "address", "asset")


def balance_permissions(volumes: DataFrame) -> DataFrame:
    """Accounts outside a bound that they have."""
    b = domain.balance(F.col("input"), F.col("output"))
    side = F.when(~F.col("allow_negative") & (b < 0), "below").when(~F.col("allow_positive") & (b > 0), "above")
    return volumes.select(*book.KEY, b.alias("balance"), side.alias("side")).where("side IS NOT NULL")


def closed_accounts(accounts: DataFrame, volumes: DataFrame) -> DataFrame:
    """Closed accounts that hold or owe anything."""
    rows = accounts.where("closed").select("ledger", "address").join(volumes, ["ledger", "address"])
    return rows.where("input <> output").select(*book.KEY, (F.col("input") - F.col("output")).alias("balance"))


def stale(volumes: DataFrame, moves: DataFrame, cutoff: str, prefix: str = "") -> DataFrame:
    """Money that has not moved, by insertion, since before the cutoff."""
    own = lambda df: df.where(domain.has_prefix(F.col("address"), prefix)) if prefix else df
    idle = book.last_activity(own(moves)).where(F.col("last_at") < F.lit(cutoff).cast("timestamp_ntz"))
    rows = own(volumes).where("input <> output").join(idle, book.KEY)
    return rows.select(*book.KEY, (F.col("input") - F.col("output")).alias("balance"), "last_at")


def tips(logs: DataFrame) -> DataFrame:
    """The last entry of each ledger, also as text: ledger:id:base64url of the hash."""
    last = logs.groupBy("ledger").agg(F.max("id").alias("id"), F.max_by("hash", "id").alias("hash"))
    text = F.rtrim(F.translate(F.base64("hash"), "+/\r\n", "-_"), F.lit("="))
    return last.select("ledger", "id", F.lower(F.hex("hash")).alias("hash"), F.concat_ws(":", "ledger", F.col("id").cast("string"), text).alias("tip"))


def check_tips(logs: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded tips (ledger, id, hash in hex) against the logs: ok, behind, or forked."""
    own = logs.select("ledger", "id", F.lower(F.hex("hash")).alias("found"))
    rows = recorded.join(own, ["ledger", "id"], "left")
    verdict = F.when(F.col("found").isNull(), "behind").when(F.col("found") != F.col("hash"), "forked").otherwise("ok")
    return rows.select("ledger", "id", verdict.alias("verdict"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def monotone(old: DataFrame, new: DataFrame) -> DataFrame:
    """Volumes that went down between two states."""
    o = old.select(*book.KEY, F.col("input").alias("old_input"), F.col("output").alias("old_output"))
    return new.join(o, book.KEY).where("input < old_input OR output < old_output").select(*book.KEY)


def illegal_changes(old: DataFrame, new: DataFrame, key: list[str], fixed: list[str]) -> DataFrame:
    """Rows of an append-only table that went away, or changed in a column that may not change."""
    o = old.select(*key, F.struct(*fixed).alias("was"))
    rows = o.join(new.select(*key, F.struct(*fixed).alias("now")), key, "left")
    finding = F.when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return rows.select(*key, finding.alias("finding")).where("finding IS NOT NULL")


def summary(checks: dict[str, tuple[Callable[[], DataFrame], Callable[[], DataFrame]]]) -> DataFrame:
    """One row per check (name, checked, findings): `checks` gives for each its findings and the rows it examines."""
    rows = []
    for name, (found, seen) in checks.items():
        both = seen().select(F.lit(0).alias("f")).union(found().select(F.lit(1).alias("f")))
        both = both.agg(F.count_if(F.col("f") == 0).alias("checked"), F.count_if(F.col("f") == 1).alias("findings"))
        rows.append(both.select(F.lit(name).alias("check_name"), "checked", "findings", (F.col("findings") == 0).alias("ok")))
    return reduce(DataFrame.union, rows)


def whole_book(tx: DataFrame, moves: DataFrame, volumes: DataFrame, stored: DataFrame, accounts: DataFrame, logs: DataFrame) -> dict[str, tuple[Callable[[], DataFrame], Callable[[], DataFrame]]]:
    """The six checks of a whole book, for `summary`; stored: moves with their stored effective volumes.

    The log is checked for hashes and gaps; the projection for volumes, and for transactions that are not in the log.
    """
    one = lambda df: df.select(F.lit(1))
    return {
        "conservation": (lambda: conservation(volumes).where("drift <> 0"), lambda: conservation(volumes)),
        "log": (lambda: one(log_hashes(logs)).union(one(log_gaps(logs))), lambda: logs),
        "projection": (lambda: one(projection(volumes, book.account_volumes(moves))).union(one(logged(tx, logs))), lambda: volumes),
        "effective_volumes": (lambda: effective_volumes(stored, moves), lambda: moves),
        "balance_permissions": (lambda: balance_permissions(volumes), lambda: volumes),
        "closed_accounts": (lambda: closed_accounts(accounts, volumes), lambda: accounts.where("closed")),
    }


def last_runs(runs: DataFrame) -> DataFrame:
    """The last run of each check."""
    return runs.groupBy("check_name").agg(F.max("ran_at").alias("ran_at"), F.max_by("ok", "ran_at").alias("ok"))


def overdue(runs: DataFrame, checks: list[str], now: str, max_age: str) -> DataFrame:
    """(check_name, finding): checks whose last run is older than `max_age` (as in `2 days`), failed, or was never."""
    names = runs.sparkSession.createDataFrame([(c,) for c in checks], "check_name string")
    rows = names.join(last_runs(runs), "check_name", "left")
    oldest = F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {max_age}")
    finding = F.when(F.col("ran_at").isNull(), "never run").when(F.col("ran_at") < oldest, "too old").when(~F.col("ok"), "failed")
    return rows.select("check_name", finding.alias("finding")).where("finding IS NOT NULL")


def record(results: DataFrame, path: str, ran_at: str) -> None:
    """Appends a run's rows (check_name, checked, findings, ok, and detail if there is one); nothing is overwritten."""
    detail = domain.short_detail(F.col("detail")) if "detail" in results.columns else F.lit(None).cast("string")
    rows = results.select("check_name", F.lit(ran_at).cast("timestamp_ntz").alias("ran_at"), "checked", "findings", "ok", detail.alias("detail"))
    rows.write.mode("append").parquet(path)


def counters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ledgers whose last log id went down, or that went away, between two states of the logs."""
    last = lambda logs, name: logs.groupBy("ledger").agg(F.max("id").alias(name))
    rows = last(old, "was").join(last(new, "now"), "ledger", "left")
    return rows.where("now IS NULL OR now < was")


def percentiles(samples: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """Percentiles as a sorted sample has them: values that occur, nothing between two."""
    return samples.groupBy(*by).agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in at))


def converted(tx: DataFrame, tolerance: int = 1) -> DataFrame:
    """(ledger, tx_id, sold, bought, due) of conversions whose postings are off the rate that their metadata states.

    Metadata keys: rate, from, to. What leaves in the one asset is sold and in the other bought, summed over postings.
    """
    m = lambda k: F.element_at("metadata", k)
    rows = tx.where(F.map_contains_key("metadata", "rate"))
    total = lambda asset: F.aggregate(F.filter("postings", lambda p: p["asset"] == asset), F.lit(0).cast("long"), lambda a, p: a + p["amount"])
    bought = F.when(m("from") == m("to"), F.lit(0).cast("long")).otherwise(total(m("to")))
    rows = rows.select("ledger", "tx_id", total(m("from")).alias("sold"), bought.alias("bought"), m("rate").alias("rate"), m("from").alias("a"), m("to").alias("b"))
    due = domain.receives(F.col("sold"), F.col("rate"), domain.asset_scale(F.col("a")), domain.asset_scale(F.col("b")))["amount"].cast("long")
    rows = rows.withColumn("due", due)
    return rows.where(~F.coalesce(F.abs(F.col("bought") - F.col("due")) <= tolerance, F.lit(False))).select("ledger", "tx_id", "sold", "bought", "due")
