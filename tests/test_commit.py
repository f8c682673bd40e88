"""The write path by hand-computed scenarios; pages, runs, and books of one hot account."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tally.operators import book, commit, recon, verify
from tally.plans import cursor

SUB = f"ledger string, arrival long, batch string, postings array<struct<{commit.FIELDS}>>, reference string, idem_key string"


def leg(source, destination, amount, up_to=False, asset="USD/2"):
    return (source, destination, asset, amount, up_to)


@pytest.fixture(scope="module")
def run(spark):
    accounts = spark.createDataFrame([("m", "shut", True), ("m", "a", False)], "ledger string, address string, closed boolean")
    rules = [("m", "bank", "USD/2", True, True), ("m", "debt", "USD/2", True, False)]
    policies = spark.createDataFrame(rules, "ledger string, address string, asset string, allow_negative boolean, allow_positive boolean")
    registry = spark.createDataFrame([("m", "USD/2"), ("n", "USD/2")], "ledger string, asset string")
    volumes = spark.createDataFrame([("m", "rich", "USD/2", 100, 0)], "ledger string, address string, asset string, input long, output long")

    def go(*rows):
        got = commit.committed(spark.createDataFrame([("m", i, *r) if len(r) == 4 else (r[4], i, *r[:4]) for i, r in enumerate(rows)], SUB), accounts, policies, registry, volumes).collect()
        got.sort(key=lambda r: r.arrival)
        return [r.outcome for r in got], [r.tx_id for r in got], [[p.amount for p in r.postings] for r in got]

    return go


def test_single_submissions(run):
    outcome, ids, _ = run(
        (None, [leg("world", "a", 50)], None, None),
        (None, [leg("a", "b", 60)], None, None),  # more than there is
        (None, [leg("a", "b", 80), leg("world", "a", 30)], None, None),  # through zero within one transaction
        (None, [leg("a", "shut", 0)], None, None),
        (None, [leg("world", "a", 1, asset="EUR/2")], None, None),
        (None, [leg("world", "a b", 1)], None, None),
        (None, [leg("rich", "b", 100)], None, None),  # what it held before
        (None, [leg("rich", "b", 1)], None, None),
        (None, [leg("bank", "b", 5)], None, None),
        (None, [leg("world", "debt", 5)], None, None),  # may owe, may not own
        (None, [leg("debt", "a", 7)], None, None),
        (None, [], None, None),
        (None, [leg("rich", "b", 1)], None, None, "n"),  # another ledger holds nothing
        (None, [leg("world", "a", 1)], None, None, "n"),
    )
    assert outcome == ["accepted", "insufficient funds", "accepted", "account closed", "unknown asset", "destination", "accepted", "insufficient funds", "accepted", "unexpected credit", "accepted", "no postings", "insufficient funds", "accepted"]
    assert ids == [1, None, 2, None, None, None, 3, None, 4, None, 5, None, None, 1]


def test_keys_references_and_sweeps(run):
    outcome, _, amounts = run(
        (None, [leg("world", "a", 50)], "r1", "k1"),
        (None, [leg("world", "a", 50)], "r1", "k1"),
        (None, [leg("world", "a", 51)], "r1", "k1"),
        (None, [leg("world", "a", 1)], "r1", None),
        (None, [leg("a", "b", 999)], "r2", "k2"),  # refused: neither key nor reference is used up
        (None, [leg("a", "b", 20)], "r2", "k2"),
        (None, [leg("a", "b", 10, True), leg("a", "c", None, True), leg("a", "d", 5, True)], None, None),
        (None, [leg("bank", "b", None, True)], None, None),
        (None, [leg("c", "b", 100, True)], None, None),
    )
    assert outcome == ["accepted", "replayed", "idempotency mismatch", "duplicate reference", "insufficient funds", "accepted", "accepted", "unbounded sweep", "accepted"]
    assert amounts[6] == [10, 20, 0] and amounts[8] == [20]


def test_batches_are_whole(run):
    outcome, ids, _ = run(
        ("b1", [leg("world", "a", 10)], None, "kb"),
        (None, [leg("a", "z", 10)], None, None),  # after the batch, whose items come first
        ("b1", [leg("a", "b", 10)], "r1", None),
        ("b2", [leg("world", "a", 5)], None, None),
        ("b2", [leg("a", "b", 6)], "r2", None),
        ("b3", [leg("world", "a", 5)], "r2", None),  # what a refused batch used is free
        ("b4", [leg("world", "a", 10)], None, "kb"),
        ("b4", [leg("a", "b", 10)], "r1", None),
        ("b5", [leg("world", "a", 11)], None, "kb"),
    )
    assert outcome == ["accepted", "insufficient funds", "accepted", "batch refused", "insufficient funds", "accepted", "replayed", "replayed", "idempotency mismatch"]
    assert [i for i in ids if i] == [1, 2, 3]
    big, *_ = run(*[("b", [leg("world", "a", 1)], None, None)] * 101)
    assert set(big) == {"batch too large"}


def test_log_of_what_was_accepted_replays(spark):
    rows = [("m", 1, None, [leg("world", "a", 50), leg("a", "b", None, True)], "r", None), ("m", 2, None, [leg("b", "c", 60)], None, None)]
    none = lambda cols: spark.createDataFrame([], cols)
    done = commit.committed(
        spark.createDataFrame(rows, SUB),
        none("ledger string, address string, closed boolean"),
        none("ledger string, address string, asset string, allow_negative boolean, allow_positive boolean"),
        spark.createDataFrame([("m", "USD/2")], "ledger string, asset string"),
        none("ledger string, address string, asset string, input long, output long"),
    )
    log = commit.logged(done, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    got = {(r.address, r.input, r.output) for r in book.account_volumes(book.moves_of(commit.replayed(log))).collect()}
    assert got == {("world", 0, 50), ("a", 50, 50), ("b", 50, 0)}
    entry = json.loads(log.collect()[0].data)
    assert entry["reference"] == "r" and entry["postings"][1] == {"source": "a", "destination": "b", "asset": "USD/2", "amount": 50, "up_to": False}


@pytest.mark.parametrize("n", [513, 5000])
def test_long_transactions(spark, n):
    tx = spark.createDataFrame([("m", 1, 1, [leg("world", "a", 1)] * n), ("m", 2, 2, [leg("a", "b", 1)])], f"ledger string, tx_id long, k long, postings array<struct<{commit.FIELDS}>>")
    tx = tx.withColumns({"eff": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "ins": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")})
    with pytest.raises(Exception, match="more than 512 postings"):
        book.moves_of(tx).collect()
    moves = book.moves_of(tx, 16_384)
    rows = sorted(book.with_pcv(moves).where("address = 'a'").collect(), key=lambda r: r.seq)
    assert moves.select("seq").distinct().count() == 2 * n + 2
    assert [r.pcv_input for r in rows] == [*range(1, n + 1), n] and rows[-1].pcv_output == 1


def test_hot_account_on_one_date(spark, monkeypatch):
    """Most moves are one account's, on one date; no bucket is large and all sums are the plain window's."""
    monkeypatch.setattr(book, "SPAN", 4)
    rng = random.Random(1)
    rows = [("m", i, i, rng.choice(["1996-05-05 00:00:00"] * 8 + ["1996-05-05 10:00:00", "1995-01-01 00:00:00", "2001-02-03 04:05:06"]), rng.random() < 0.4, rng.randrange(50)) for i in rng.sample(range(1, 4000), 900)]
    df = spark.createDataFrame(rows, "ledger string, tx_id long, k long, d string, is_source boolean, amount long")
    moves = df.select("ledger", "tx_id", F.lit("hot").alias("address"), F.lit("USD").alias("asset"), F.col("d").cast("timestamp_ntz").alias("effective_date"), (F.col("k") * book.STRIDE).alias("seq"), "is_source", "amount")
    for got, order, names in ((book.with_pcv(moves), ["seq"], ("pcv_input", "pcv_output")), (book.with_pcev(moves), ["effective_date", "seq"], ("pcev_input", "pcev_output"))):
        w = Window.partitionBy(*book.KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        plain = moves.select("seq", F.sum(book.into()).over(w).alias("i"), F.sum(book.out_of()).over(w).alias("o"))
        assert {(r.seq, r[names[0]], r[names[1]]) for r in got.collect()} == {tuple(r) for r in plain.collect()}
    most = moves.groupBy("effective_date", F.expr(f"seq DIV {book.SPAN * book.STRIDE}")).count().agg(F.max("count")).first()[0]
    assert most <= book.SPAN


def test_pages_follow_each_other(spark):
    df = spark.range(60).select(F.col("id"), (F.col("id") % 2).cast("string").alias("side"))
    pick = lambda d, f: d.where(F.col("side") == f["side"])
    seen, at = [], None
    while True:
        p = cursor.pages(df, ["id"], at, {"side": "1"} if at is None else {"side": "0"}, 7, pick)
        seen += [r.id for r in p.rows]
        at = p.next
        if at is None:
            break
    assert seen == list(range(1, 60, 2))
    assert cursor.Cursor.decode(cursor.Cursor((1, "x"), (("a", "b"),), 3).encode()) == cursor.Cursor((1, "x"), (("a", "b"),), 3)
    for bad in ("", "!!", "e30", cursor.Cursor().encode()[:-3]):
        with pytest.raises(ValueError):
            cursor.Cursor.decode(bad)
    with pytest.raises(ValueError):
        cursor.Cursor(limit=101)


def test_runs_are_recorded(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3, 0, True, "x" * 5000), ("b", 1, 1, False, "")], "check_name string, checked long, findings long, ok boolean, detail string")
    for day in ("2024-01-01", "2024-01-05"):
        verify.record(rows.where("check_name = 'a' OR " + ("true" if day < "2024-01-03" else "false")), f"{tmp_path}/runs", f"{day} 00:00:00")
    runs = spark.read.parquet(f"{tmp_path}/runs")
    assert runs.count() == 3 and runs.where("check_name = 'a'").first().detail == "x" * 4000 + "... (truncated)"
    assert runs.where("check_name = 'b'").first().detail is None
    late = {(r.check_name, r.finding) for r in verify.overdue(runs, ["a", "b", "c"], "2024-01-06 00:00:00", "2 days").collect()}
    assert late == {("b", "too old"), ("c", "never run")}


def test_a_bad_line_refuses_its_batch(spark):
    line = "ledger string, source string, record_id string, reference string, asset string, amount long, direction string, ingested_at timestamp_ntz"
    rows = [("m", "s", "1", None, "USD", 5, "in", None), ("m", "s", "2", None, "USD", 0, "in", None)]
    df = spark.createDataFrame(rows, line)
    with pytest.raises(ValueError, match="'2': amount"):
        recon.ingested(df, df.limit(0))
    assert recon.ingested(df.where("amount > 0"), df.limit(0)).count() == 1
    known = spark.createDataFrame([("m", "s")], "ledger string, source string")
    assert [r.source for r in recon.registered(spark.createDataFrame([("m", "s"), ("m", "t"), ("m", "t")], "ledger string, source string"), known).collect()] == ["t"]


def test_batch_hash(spark):
    df = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y"), ("c", 2, "x"), ("c", 1, "y"), ("d", 5, "x"), ("d", 6, "y")], "batch string, arrival long, content string")
    got = {r.batch: r.batch_hash for r in commit.batch_hash(df, "batch").collect()}
    assert got["b"] == got["d"] != got["c"]


def test_command_line(sf, spark, capsys):
    from tally.__main__ import main

    assert main(["tip", sf, "--json"]) == 0
    tips = [json.loads(x)["tip"] for x in capsys.readouterr().out.splitlines()]
    assert [t.split(":")[0] for t in tips] == ["eu", "main"]


def test_what_no_bound_can_refuse_is_not_folded(spark, sf):
    from tally import queries

    plan = queries.QUERIES["commit_outcomes"](spark, sf)._jdf.queryExecution().toString()
    assert "InArrow" not in plan


def test_outcomes_equal_the_fold_in_order(spark):
    """Forty ledgers: tight ones, rich ones, ones with ceilings, keys, references, batches with faults."""
    rng = random.Random(3)
    rows, had = [], {}
    for n in range(40):
        led, rich, sweeps, knots = f"l{n:02}", n % 2 == 0, n % 5 == 0, n % 3 == 0
        had[led] = {a: 60 if rich else rng.choice([0, 5]) for a in "abc"}
        for i in range(24):
            pay = lambda: leg(rng.choice(["world", "a", "b", "c", "debt"]), rng.choice(["a", "b", "c", "debt", "shut", "bank"] + ["a"] * 6), rng.randrange(4), rng.random() < 0.15 and sweeps, rng.choice(["USD/2"] * 12 + ["EUR/2"]))  # noqa: B023, E731
            batch = rng.choice([None, None, f"b{i // 6}", f"b{rng.randrange(4)}"])
            rows.append((led, i, batch, [pay() for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))], rng.choice([None, f"r{rng.randrange(9)}"]) if knots else None, rng.choice([None, f"k{rng.randrange(9)}"]) if knots else None))
    rows.append(("wide", 0, None, [leg("world", "a", 2**62), leg("world", "b", 2**62)], None, None))
    rules = [(led, a, "USD/2", True, a == "bank") for led in had for a in ("bank", "debt")]
    heads, want = {}, {}
    for led, i, batch, *_ in rows:
        if batch:
            heads[led, batch] = min(i, heads.get((led, batch), i))
    folds, groups = {}, {}
    for led, i, batch, postings, reference, key in rows:
        legs = [dict(zip(("source", "destination", "asset", "amount", "up_to"), p, strict=True)) for p in postings]
        sides = sorted({(p[s], p["asset"]) for p in legs for s in ("source", "destination")})
        fault = "no postings" if not legs else "unknown asset" if any(x == "EUR/2" for _, x in sides) else "account closed" if any(a == "shut" for a, _ in sides) else None
        state = [{"address": a, "asset": x, "allow_negative": a == "world" or x == "USD/2" and (a in ("bank", "debt") and led in had), "allow_positive": not (a == "debt" and x == "USD/2" and led in had), "balance": had.get(led, {}).get(a, 0) if x == "USD/2" else 0} for a, x in sides]
        head = heads.get((led, batch), i)
        groups.setdefault((led, head, batch), []).append({"ledger": led, "arrival": i, "batch": batch, "postings": legs, "reference": reference, "idem_key": key, "content": repr((legs, reference)), "fault": fault, "state": state})
    for (led, _, batch), items in sorted(groups.items(), key=lambda g: g[0][:2]):
        for r in folds.setdefault(led, commit.Fold()).group(items, batch is not None):
            want[led, r["arrival"]] = (r["outcome"], [(p["amount"], bool(p["up_to"])) for p in r["postings"]])
    frame = lambda own, cols: spark.createDataFrame(own, cols)
    got = commit.committed(
        frame(rows, SUB),
        frame([(led, "shut", True) for led in had], "ledger string, address string, closed boolean"),
        frame(rules, "ledger string, address string, asset string, allow_negative boolean, allow_positive boolean"),
        frame([(led, "USD/2") for led in [*had, "wide"]], "ledger string, asset string"),
        frame([(led, a, "USD/2", v, 0) for led, own in had.items() for a, v in own.items()], "ledger string, address string, asset string, input long, output long"),
    ).collect()
    assert {(r.ledger, r.arrival): (r.outcome, [(p.amount, p.up_to) for p in r.postings]) for r in got} == want
    assert len({x for x, _ in want.values()}) >= 9 and len(got) == len(rows)
    for led in had:
        assert [r.tx_id for r in sorted(got, key=lambda r: r.arrival) if r.ledger == led and r.tx_id] == [*range(1, 1 + sum(v[0] == "accepted" for k, v in want.items() if k[0] == led))]
