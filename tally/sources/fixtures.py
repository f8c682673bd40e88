"""A double-entry book derived from the TPC-H-like tables, and its tampered variants."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators import book, journal

POSTING = "struct<source:string,destination:string,asset:string,amount:bigint,up_to:boolean>"

#: Customer segment -> asset.
ASSETS = {"HOUSEHOLD": "USD/2", "MACHINERY": "EUR/2", "FURNITURE": "USDT/6", "BUILDING": "POINTS", "AUTOMOBILE": "BTC/8"}


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def raw_tx(self) -> DataFrame:
        """One row per order: the transaction, its postings as an array, without its gapless id."""
        asset = F.create_map(*(F.lit(x) for kv in ASSETS.items() for x in kv))
        df = self.table("orders").join(self.table("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        df = df.select(
            F.when(F.col("o_custkey") % 4 == 0, "eu").otherwise("main").alias("ledger"),
            F.col("o_orderkey").cast("long").alias("k"),
            F.col("o_custkey").cast("long").alias("ck"),
            F.col("o_orderstatus").alias("st"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("eff"),
            F.expr("timestampadd(SECOND, CAST(o_orderkey AS INT), TIMESTAMP_NTZ '2002-01-01 00:00:00')").alias("ins"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("a"),
            asset[F.col("c_mktsegment")].alias("asset"),
            F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("reference"),
        )
        df = df.withColumn(
            "ext_ref",
            F.expr("""CASE WHEN st = 'F' AND k % 5 = 0 THEN concat('BATCH-', asset, '-', CAST(k DIV 500 AS STRING))
                WHEN st IN ('F', 'P') THEN concat('EXT-', CAST(k AS STRING)) END"""),
        )
        p = "named_struct('source', {}, 'destination', {}, 'asset', asset, 'amount', {}, 'up_to', false)".format
        wallet, bank, wire = "concat('customers:', ck, ':wallet')", "concat('external:bank:b', ck % 8)", "concat('pending:wire:', k)"
        own = f"""CASE st
            WHEN 'O' THEN array({p("'world'", wallet, "a")})
            WHEN 'F' THEN array({p("'world'", wallet, "a")}, {p(wallet, bank, "a - a DIV 400")}, {p(wallet, "'fees:platform'", "a DIV 400")})
            WHEN 'P' THEN IF(k % 3 <> 0, array({p(bank, wire, "a")}, {p(wire, wallet, "a")}), array({p(bank, wire, "a")})) END"""
        return df.withColumn("postings", F.expr(own))

    @cached_property
    def tx(self) -> DataFrame:
        return book.numbered(self.raw_tx, "ledger", "k", "tx_id")

    @cached_property
    def moves(self) -> DataFrame:
        return book.moves_of(self.tx)

    @cached_property
    def volumes(self) -> DataFrame:
        """The state table: volumes and bounds of each account and asset."""
        v = book.account_volumes(self.moves)
        free = (F.col("address") == "world") | F.col("address").startswith("external:")
        return v.withColumn("allow_negative", free).withColumn("allow_positive", F.lit(True))

    @cached_property
    def tampered_volumes(self) -> DataFrame:
        number = F.get(F.split("address", ":"), F.lit(1)).try_cast("long")
        bad = F.col("address").startswith("customers:") & (number % 97 == 0)
        v = self.volumes.withColumn("input", F.col("input") + F.when(bad, 1).otherwise(0))
        return v.withColumn("allow_positive", F.col("address") != "fees:platform")

    @cached_property
    def accounts(self) -> DataFrame:
        return book.first_usage(self.moves).withColumn("closed", F.col("address").startswith("pending:"))

    @cached_property
    def assets(self) -> DataFrame:
        rows = [(led, a) for led in ("eu", "main") for a in ASSETS.values() if (led, a) != ("eu", "BTC/8")]
        return self.spark.createDataFrame(rows, "ledger string, asset string")

    @cached_property
    def log_rows(self) -> DataFrame:
        data = F.concat_ws("|", F.lit("tx"), F.col("tx_id").cast("string"), F.col("asset"), F.col("a").cast("string"))
        return self.tx.select("ledger", F.col("tx_id").alias("id"), F.lit("NEW_TRANSACTION").alias("type"), data.alias("data"), F.col("ins").alias("date"), "k")

    @cached_property
    def logs(self) -> DataFrame:
        return journal.chained(self.log_rows)

    @cached_property
    def event_log(self) -> DataFrame:
        """The log as JSON: every entry holds its transaction whole."""
        data = F.to_json(F.struct(F.col("tx_id").alias("id"), "postings", F.col("eff").alias("timestamp"), "reference"))
        return self.tx.select("ledger", F.col("tx_id").alias("id"), F.lit("NEW_TRANSACTION").alias("type"), data.alias("data"), F.col("ins").alias("date"), "k")

    @cached_property
    def commits(self) -> DataFrame:
        """Orders as submissions of one to three postings; some in batches, some with a key or a reference used before."""
        return self.raw_tx.select(
            "ledger",
            F.col("k").alias("arrival"),
            F.expr("IF(k % 3 = 0, concat('batch-', CAST(k DIV 12 AS STRING)), NULL)").alias("batch"),
            "postings",
            F.expr("IF(k % 50 = 1, concat('R', CAST(k DIV 100 AS STRING)), NULL)").alias("reference"),
            F.expr("IF(k % 40 = 7, concat('K', CAST(k DIV 80 AS STRING)), NULL)").alias("idem_key"),
        )

    @cached_property
    def tampered_logs(self) -> DataFrame:
        """Altered data at k % 997 = 0, no entry 500."""
        bad = self.logs.withColumn("data", F.when(F.col("k") % 997 == 0, F.concat("data", F.lit("!"))).otherwise(F.col("data")))
        return bad.where("id <> 500")

    @cached_property
    def recon_records(self) -> DataFrame:
        """Statement lines of two sources, with what an honest source and a sloppy one get wrong."""
        t = self.raw_tx
        line = lambda source, rid, ref, amount, way: [F.lit(source).alias("source"), F.expr(rid).alias("record_id"), F.expr(ref).alias("reference"), "asset", F.expr(amount).cast("long").alias("amount"), F.expr(way).alias("direction"), F.col("ins").alias("ingested_at")]
        alpha = t.where("st = 'P' AND k % 10 < 7").select("ledger", *line("alpha", "concat('L', lpad(CAST(k AS STRING), 10, '0'))", "IF(k % 10 = 6, NULL, ext_ref)", "a + IF(k % 10 = 3, 500, 0)", "CASE k % 10 WHEN 4 THEN 'out' WHEN 5 THEN NULL ELSE 'in' END"))
        rival = t.where("st = 'P' AND k % 100 = 0").select("ledger", *line("alpha", "concat('Z', CAST(k AS STRING))", "ext_ref", "a", "'in'"))
        ghost = t.where("st = 'O' AND k % 50 = 0").select("ledger", *line("alpha", "concat('G', CAST(k AS STRING))", "concat('GHOST-', CAST(k AS STRING))", "a", "'in'"))
        batch = t.where("st = 'F' AND k % 5 = 0").groupBy("ledger", "ext_ref", "asset", F.expr("k DIV 500").alias("b")).agg(F.sum(F.expr("a - a DIV 400")).alias("s"), F.max("ins").alias("ins"))
        batch = batch.select("ledger", *line("beta", "ext_ref", "ext_ref", "s + IF(b % 4 = 0, 1, 0)", "'out'"))
        return alpha.union(rival).union(ghost).union(batch)

    @cached_property
    def conversions(self) -> DataFrame:
        """Currency conversions stated with a rate; every fiftieth supplier's amounts are off."""
        from tally.functions import domain

        df = self.table("lineitem").select(
            *(F.col(c).cast("long").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
            (F.round(F.col("l_extendedprice") * 100).cast("long") * 10000).alias("sold"),
            F.concat(F.lit("0.9"), F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "0")).alias("rate"),
        )
        got = domain.receives(F.col("sold"), F.col("rate"), F.lit(6), F.lit(2))
        df = df.withColumn("_r", got).withColumn("due", F.col("_r.amount").cast("long")).withColumn("exact", F.col("_r.exact")).drop("_r")
        return df.withColumn("bought", F.col("due") + F.expr("IF(l_suppkey % 50 = 0, 3, l_suppkey % 2)"))

    @cached_property
    def submissions(self) -> DataFrame:
        """Payments from the event stream, for the journal."""
        user = "concat('users:', CAST(user_id AS STRING))"
        return self.table("events").select(
            F.lit("main").alias("ledger"),
            F.col("event_id").cast("long").alias("arrival"),
            F.expr(f"IF(event_type = 'purchase', {user}, 'world')").alias("source"),
            F.expr(f"IF(event_type = 'purchase', 'shop:main', {user})").alias("destination"),
            F.lit("USD/2").alias("asset"),
            F.round(F.col("value") * 100).cast("long").alias("amount"),
            F.expr("IF(event_id % 40 < 2, concat('k', CAST(event_id DIV 2 AS STRING)), NULL)").alias("idem_key"),
        )
