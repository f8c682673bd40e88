"""Hand-computed scenarios, properties with replayable seeds, and tampering."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tally.functions import domain
from tally.operators import book, journal, recon, verify
from tally.plans.prefix import running_sums
from tally.sources.fixtures import Fixture
from tally.sources.statements import pulled

TX = "ledger string, tx_id long, k long, eff timestamp_ntz, ins timestamp_ntz, reference string, ext_ref string, postings array<struct<source:string,destination:string,asset:string,amount:long,up_to:boolean>>"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def tx(spark, *rows):
    """rows: (day, [(source, destination, amount)])"""
    out = [("main", i, i, day(d), day(i), f"r{i}", None, [(s, t, "USD/2", a, False) for s, t, a in p]) for i, (d, p) in enumerate(rows, 1)]
    return spark.createDataFrame(out, TX)


def test_backdated_snapshots(spark):
    t = tx(spark, (1, [("world", "alice", 100)]), (3, [("world", "alice", 50)]), (5, [("alice", "world", 30)]), (2, [("world", "alice", 50)]))
    m = book.moves_of(t).where("address = 'alice'")
    by = lambda df, i, o: [r[i] - r[o] for r in df.orderBy("effective_date").collect()]
    assert by(book.with_pcv(m), "pcv_input", "pcv_output") == [100, 170, 150, 120]
    assert by(book.with_pcev(m), "pcev_input", "pcev_output") == [100, 150, 200, 170]
    for d, want in ((1, 100), (2, 150), (4, 200), (9, 170)):
        assert [r.balance for r in book.balances(book.volumes_asof(m, str(day(d))), "asset").collect()] == [want]
    assert book.volumes_asof(m, str(day(0))).count() == 0


def test_ties_by_insertion(spark):
    t = tx(spark, *[(1, [("world", "alice", a)]) for a in (100, 50, 25)])
    v = book.snapshots_asof(book.with_pcev(book.moves_of(t)), str(day(1))).where("address = 'alice'").first()
    assert (v.input, v.output) == (175, 0)


def test_two_ledgers_never_mix(spark):
    t = tx(spark, (1, [("world", "users:alice", 100), ("world", "fees:users:x", 900)]))
    both = t.union(t.withColumn("ledger", F.lit("theirs")))
    assert [r.balance for r in book.Book("main", both).aggregate("users:").collect()] == [100]
    assert book.Book("main", both).transactions().count() == 1


def test_pages(spark):
    t = tx(spark, *[(1, [("world", "a", 1)])] * 7)
    b = book.Book("main", t)
    assert [r.tx_id for r in b.transactions(limit=3).collect()] == [1, 2, 3]
    assert [r.tx_id for r in b.transactions(after=3, limit=3).collect()] == [4, 5, 6]
    with pytest.raises(ValueError):
        b.transactions(limit=101)


def test_prefix_equals_plain_window(spark):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randint(0, 5)}", i, rng.randint(-50, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, seq long, v long")
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.seq: r.s for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    assert {r.seq: r.s for r in running_sums(df, ["key"], ["seq"], {"s": F.col("v")}, F.expr("seq DIV 64")).collect()} == want


@pytest.mark.parametrize(
    "amount,rate,scales,want",
    [
        (100000000000, "0.99960", (6, 2), (9996000, True)),
        (42317482915, "1", (6, 2), (4231748, False)),
        (100, "1.5", (2, 6), (1500000, True)),
        (1, "0.1", (2, 2), (0, False)),
        (10, "1e3", (2, 2), None),
        (10, "-1", (2, 2), None),
        (10, "0", (2, 2), None),
        (10, " 1", (2, 2), None),
    ],
)
def test_receives(spark, amount, rate, scales, want):
    df = spark.createDataFrame([(amount, rate)], "a long, r string")
    got = df.select(domain.receives(F.col("a"), F.col("r"), F.lit(scales[0]), F.lit(scales[1])).alias("x")).first().x
    assert (got.amount is None) if want is None else (int(got.amount), got.exact) == want


def fold(rows):
    funds, keys, out = {}, {}, []
    for arrival, s, d, a, key in rows:
        if key and key in keys:
            out.append((arrival, "replayed" if keys[key] == (s, d, a) else "idempotency mismatch"))
        elif s != "world" and a and funds.get(s, 0) < a:
            out.append((arrival, "insufficient funds"))
        else:
            funds[s], funds[d] = funds.get(s, 0) - a, funds.get(d, 0) + a
            if key:
                keys[key] = (s, d, a)
            out.append((arrival, "accepted"))
    return out


@pytest.mark.parametrize("seed,tight", [(1, True), (2, True), (3, False)])
def test_journal_equals_fold(spark, seed, tight):
    rng = random.Random(seed)
    rows = []
    for i in range(200):
        s = rng.choice(["world", "a", "b", "c"]) if tight else "world"
        rows.append((i, s, rng.choice([x for x in "abc" if x != s]), rng.randint(0, 30), rng.choice([None, None, f"k{rng.randint(0, 20)}"])))
    df = spark.createDataFrame([("main", i, s, d, "USD/2", a, k) for i, s, d, a, k in rows], "ledger string, arrival long, source string, destination string, asset string, amount long, idem_key string")
    got = journal.applied(df).orderBy("arrival").collect()
    assert [(r.arrival, r.outcome) for r in got] == fold(rows)
    assert [r.tx_id for r in got if r.outcome == "accepted"] == list(range(1, 1 + sum(r.outcome == "accepted" for r in got)))


def test_chain_and_tampering(spark):
    rows = [("main", i, "NEW_TRANSACTION", f"d{i}") for i in range(1, 6)]
    logs = journal.chained(spark.createDataFrame(rows, "ledger string, id long, type string, data string"))
    assert verify.log_hashes(logs).count() == 0
    bad = logs.withColumn("data", F.when(F.col("id") == 3, "x").otherwise(F.col("data")))
    assert [r.id for r in verify.log_hashes(bad).collect()] == [3]
    told = logs.where("id <> 3").withColumns({"resumed_from": F.when(F.col("id") == 4, 2), "skipped_through": F.when(F.col("id") == 4, 3)})
    assert [(r.id, r.after) for r in verify.log_gaps(told).collect()] == [(4, 2)]
    assert verify.log_gaps(told.withColumn("type", F.when(F.col("id") == 4, "RECOVERY").otherwise(F.col("type")))).count() == 0


def test_whole_book_sees_every_fault(spark, sf):
    f = Fixture(spark, sf)
    own = {"tx": f.tx, "moves": f.moves, "volumes": f.volumes, "stored": book.with_pcev(f.moves), "accounts": f.accounts.where("NOT closed"), "logs": f.logs}
    bad = lambda names, **kw: {r.check_name for r in verify.summary({k: v for k, v in verify.whole_book(**own | kw).items() if k in names}).collect() if not r.ok}
    assert bad(["effective_volumes"], stored=own["stored"].withColumn("pcev_input", F.col("pcev_input") + 1)) == {"effective_volumes"}
    assert bad(["balance_permissions"], volumes=f.volumes.withColumn("allow_positive", F.lit(False))) == {"balance_permissions"}
    kept = f.logs.where("id <> 50")
    assert bad(["projection"], logs=kept) == {"projection"}
    again = journal.chained(f.log_rows.where("id <> 50"))  # no hash is wrong
    assert bad(["log"], logs=again) == {"log"}


def test_sweep(spark):
    p = [("w", "x", 100, True), ("w", "y", None, True), ("y", "z", 5, False)]
    df = spark.createDataFrame([(p, {"w": 130})], "p array<struct<source:string,destination:string,amount:long,up_to:boolean>>, m map<string,long>")
    assert df.select(journal.swept(F.col("p"), F.col("m")).alias("x")).first().x == [100, 30, 5]


def test_reconciliation_counts(spark, sf):
    f = Fixture(spark, sf.replace("sf0.001", "sf0.01"))
    found, pairs, sets = recon.matched(f.recon_records, f.tx, f.moves)
    assert (pairs.count(), pairs.where("variance <> 0").count(), sets.select(*recon.LINE).distinct().count()) == (2671, 573, 153)


def test_staging(spark):
    df = spark.createDataFrame([("main", "a", "1", "r", "USD/2", 5, "in", day(1)), ("main", "a", "", "r", "USD/2", 5, "in", day(1)), ("main", "a", "2", None, "USD/2", 0, "up", day(1))], "ledger string, source string, record_id string, reference string, asset string, amount long, direction string, ingested_at timestamp_ntz")
    assert {(r.record_id, r.fault) for r in recon.faults(df).collect()} == {("", "no id"), ("2", "amount")}
    got = pulled(spark, lambda s, since: df.withColumn("extra", F.lit(1)), "2024-01-01")
    assert "extra" not in got.columns


def test_follow(spark, tmp_path, sf):
    from tally.streaming.tail import follow, windowed_activity

    f = Fixture(spark, sf)
    f.moves.repartition(3).write.parquet(f"{tmp_path}/moves")
    stream = spark.readStream.schema(f.moves.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/moves")
    follow(stream, f"{tmp_path}/volumes", f"{tmp_path}/check").awaitTermination(120)
    last = max((tmp_path / "volumes").glob("v=*"), key=lambda p: int(p.name[2:]))
    assert int(last.name[2:]) >= 2 and len(list((tmp_path / "volumes").glob("v=*"))) == 2
    got = {tuple(r) for r in spark.read.parquet(str(last)).select(*book.KEY, "input", "output").collect()}
    assert got == {tuple(r) for r in book.account_volumes(f.moves).collect()}
    assert windowed_activity(f.moves).agg(F.sum("n")).first()[0] == f.moves.count()


def test_date_of_reversal(spark):
    t = tx(spark, (1, [("world", "alice", 100)]))
    date = lambda **kw: journal.revert(t, **kw).first().timestamp
    assert date(at_effective=True) == day(1) and date(at=F.lit(day(9)).cast("timestamp_ntz")) == day(9)
    assert date() > day(700)


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and all(r.drift == 0 for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())
