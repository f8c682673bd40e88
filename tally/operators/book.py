"""Reading a book: moves, running volumes under both clocks, balances, statements, pages.

A transactions table has (ledger, tx_id, k, eff, ins, postings ...); `k` is its global order. Moves are two per posting,
source first; `seq` orders them globally and may have gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.functions import domain
from tally.plans.prefix import running_sums

KEY = ["ledger", "address", "asset"]
STRIDE = 1024
#: Global order keys per bucket of a running sum.
SPAN = 4096


def into() -> Column:
    return F.when(~F.col("is_source"), F.col("amount")).otherwise(0)


def out_of() -> Column:
    return F.when(F.col("is_source"), F.col("amount")).otherwise(0)


def numbered(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """Gapless numbers from 1 per `by`, in `order` (a long), without sorting a `by` in one task."""
    return running_sums(df, [by], [order], {name: F.lit(1).cast("long")}, F.expr(f"{order} DIV {SPAN}"), F.expr(f"{order} DIV {SPAN * SPAN}"))


def moves_of(tx: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Two moves per posting, in order. A transaction of more than stride / 2 postings is an error: a greater stride, the
    same for all transactions of a book, has room for it."""
    p = tx.select("ledger", "tx_id", "k", F.col("eff").alias("effective_date"), F.col("ins").alias("insertion_date"), F.posexplode("postings").alias("p", "x"))
    sides = F.inline(F.array(F.struct(F.col("x.source").alias("address"), F.lit(True).alias("is_source")), F.struct(F.col("x.destination").alias("address"), F.lit(False).alias("is_source"))))
    m = p.select("ledger", "tx_id", "k", F.col("p").cast("long").alias("p"), "effective_date", "insertion_date", F.col("x.asset").alias("asset"), F.col("x.amount").alias("amount"), sides)
    place = F.when(2 * F.col("p") < stride, F.col("p") * 2).otherwise(F.raise_error(F.lit(f"a transaction of more than {stride // 2} postings")).cast("long"))
    return m.withColumn("seq", F.col("k") * stride + place + F.when(F.col("is_source"), 0).otherwise(1))


def volume_updates(moves: DataFrame) -> DataFrame:
    return moves.groupBy("ledger", "tx_id", "address", "asset").agg(F.sum(into()).alias("input"), F.sum(out_of()).alias("output"))


def with_pcv(moves: DataFrame) -> DataFrame:
    """Volumes after each move, in the order of insertion."""
    return running_sums(moves, KEY, ["seq"], {"pcv_input": into(), "pcv_output": out_of()}, F.expr(f"seq DIV {SPAN * STRIDE}"), F.expr(f"seq DIV {SPAN * SPAN * STRIDE}"))


def with_pcev(moves: DataFrame) -> DataFrame:
    """Volumes after each move, in the order of effect; of equal dates the earlier inserted comes first.

    Buckets: moves of one date that were inserted near each other, then hours, then months.
    """
    at = F.col("effective_date")
    one = F.struct(at.alias("at"), F.expr(f"seq DIV {SPAN * STRIDE}").alias("run"))
    return running_sums(moves, KEY, ["effective_date", "seq"], {"pcev_input": into(), "pcev_output": out_of()}, one, F.date_trunc("hour", at), F.date_trunc("month", at))


def account_volumes(moves: DataFrame) -> DataFrame:
    return moves.groupBy(*KEY).agg(F.sum(into()).alias("input"), F.sum(out_of()).alias("output"))


def balances(volumes: DataFrame, *by: str) -> DataFrame:
    """Volumes and balance summed by these columns."""
    out = volumes.groupBy(*by).agg(F.sum("input").alias("input"), F.sum("output").alias("output"))
    return out.withColumn("balance", domain.balance(F.col("input"), F.col("output")))


def volumes_asof(moves: DataFrame, at: str) -> DataFrame:
    """Volumes of each account by effective date, the date included: one aggregation, no window."""
    return account_volumes(moves.where(F.col("effective_date") <= F.lit(at).cast("timestamp_ntz")))


def snapshots_asof(pcev: DataFrame, at: str) -> DataFrame:
    """The same from stored snapshots: the last move not after the date.

    Snapshots that are worked out on the way need only the moves up to the date.
    """
    last = F.max_by(F.struct("pcev_input", "pcev_output"), F.struct("effective_date", "seq")).alias("v")
    out = pcev.where(F.col("effective_date") <= F.lit(at).cast("timestamp_ntz")).groupBy(*KEY).agg(last)
    return out.select(*KEY, F.col("v.pcev_input").alias("input"), F.col("v.pcev_output").alias("output"))


def first_usage(moves: DataFrame) -> DataFrame:
    return moves.groupBy("ledger", "address").agg(F.min("effective_date").alias("first_usage"))


def last_activity(moves: DataFrame) -> DataFrame:
    return moves.groupBy(*KEY).agg(F.max("insertion_date").alias("last_at"))


def page(df: DataFrame, order: list[str], after: tuple | None = None, limit: int = 25, more: int = 0) -> DataFrame:
    """A keyset page: the `limit` rows behind the position `after` in `order`, and `more`. Limits run from 1 to 100."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    if after is not None:
        past = F.lit(False)
        for i, (c, v) in enumerate(zip(order, after, strict=True)):
            same = F.lit(True)
            for d, w in list(zip(order, after, strict=True))[:i]:
                same = same & (F.col(d) == F.lit(w).cast(df.schema[d].dataType))
            past = past | (same & (F.col(c) > F.lit(v).cast(df.schema[c].dataType)))
        df = df.where(past)
    return df.orderBy(*order).limit(limit + more)


def statement(moves: DataFrame, ledger: str, address: str, start: str, end: str, asset: str | None = None) -> DataFrame:
    """Moves of an account between two effective dates, both included, with volumes by effect."""
    own = moves.where((F.col("ledger") == ledger) & (F.col("address") == address))
    own = own.where(F.col("asset") == asset) if asset else own
    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    return with_pcev(own).where(F.col("effective_date").between(lit(start), lit(end)))


def touching(tx: DataFrame, test) -> DataFrame:
    """Transactions with an endpoint that passes `test` (a function of a column)."""
    return tx.where(F.exists("postings", lambda p: test(p["source"]) | test(p["destination"])))


def post_commit_volumes(moves: DataFrame) -> DataFrame:
    """Volumes of each touched account right after each transaction."""
    last = F.max_by(F.struct("pcv_input", "pcv_output"), F.col("seq")).alias("v")
    out = with_pcv(moves).groupBy("ledger", "tx_id", "address", "asset").agg(last)
    return out.select("ledger", "tx_id", "address", "asset", F.col("v.pcv_input").alias("input"), F.col("v.pcv_output").alias("output"))


def expanded(accounts: DataFrame, volumes: DataFrame, moves: DataFrame, ledger: str, address: Column, at: str) -> DataFrame:
    """Accounts with current and effective volumes, one row per asset."""
    mine = lambda df: df.where((F.col("ledger") == ledger) & address)
    then = volumes_asof(mine(moves), at).withColumnsRenamed({"input": "effective_input", "output": "effective_output"})
    return mine(accounts).join(mine(volumes), ["ledger", "address"], "left").join(then, KEY, "left")


class Book:
    """One ledger's tables behind methods; every method filters by ledger first, so no tenant sees another."""

    def __init__(self, ledger: str, tx: DataFrame):
        self.ledger = ledger
        self.tx = tx.where(F.col("ledger") == ledger)
        self.moves = moves_of(self.tx)

    def transaction(self, tx_id: int) -> DataFrame:
        return self.tx.where(F.col("tx_id") == tx_id)

    def transactions(self, after: int | None = None, limit: int = 25, account: str | None = None) -> DataFrame:
        df = touching(self.tx, lambda a: a == account) if account else self.tx
        return page(df, ["tx_id"], None if after is None else (after,), limit)

    def balances(self, address: str, at: str | None = None) -> DataFrame:
        own = self.moves.where(F.col("address") == address)
        return balances(volumes_asof(own, at) if at else account_volumes(own), "asset")

    def aggregate(self, prefix: str = "") -> DataFrame:
        return balances(account_volumes(self.moves.where(domain.has_prefix(F.col("address"), prefix))), "asset")

    def statement(self, address: str, start: str, end: str, asset: str | None = None) -> DataFrame:
        return statement(self.moves, self.ledger, address, start, end, asset)
