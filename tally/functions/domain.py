"""Scalar rules of the double-entry model as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What addresses and assets look like, and the caps of metadata. \z, as $ also matches before a newline.
ADDRESS = r"^[a-zA-Z0-9_-]+(:[a-zA-Z0-9_-]+)*\z"
ASSET = r"^[A-Z][A-Z0-9_]*(/[0-9]{1,6})?\z"
MAX_KEYS, MAX_KEY_BYTES, MAX_VALUE_BYTES = 32, 128, 1024
WORLD = "world"
AMOUNT = "decimal(38,0)"


def address_valid(a: Column) -> Column:
    return F.coalesce(a.rlike(ADDRESS), F.lit(False))


def segments(a: Column) -> Column:
    return F.split(a, ":")


def address_like(a: Column, pattern: str) -> Column:
    """A positional pattern: `users:*:wallet` fixes segments, `*` stands for one, a trailing `...` for any further."""
    want = pattern.split(":")
    deep = want[-1] == "..."
    want = want[:-1] if deep else want
    parts = segments(a)
    out = F.size(parts) >= len(want) if deep else F.size(parts) == len(want)
    for i, w in enumerate(want):
        if w != "*":
            out = out & (F.get(parts, F.lit(i)) == w)
    return F.coalesce(out, F.lit(False))


def has_prefix(a: Column, prefix: str, compat_like: bool = False) -> Column:
    """A literal prefix; compat_like reads `_` and `%` in it as wildcards."""
    return a.like(prefix + "%") if compat_like else a.startswith(prefix)


def asset_valid(a: Column) -> Column:
    return F.coalesce(a.rlike(ASSET), F.lit(False))


def asset_code(a: Column) -> Column:
    return F.split_part(a, F.lit("/"), F.lit(1))


def asset_scale(a: Column) -> Column:
    """Digits behind the slash, 0 without one, null for an invalid asset."""
    digits = F.regexp_extract(a, "/([0-9]+)", 1)
    return F.when(asset_valid(a), F.when(digits == "", 0).otherwise(digits.try_cast("int")))


def balance(into: Column, out: Column) -> Column:
    return F.coalesce(into, F.lit(0)) - F.coalesce(out, F.lit(0))


def chain_hash(previous: Column, data: Column) -> Column:
    """Hex SHA-256 of the previous hash's bytes and the data's bytes; the first entry has no previous hash."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit(b"")), data.cast("binary")), 256)


def reversed_postings(p: Column) -> Column:
    """Sides swapped, order reversed, no ceilings."""
    return F.transform(F.reverse(p), lambda x: F.struct(x["destination"].alias("source"), x["source"].alias("destination"), x["asset"].alias("asset"), x["amount"].alias("amount"), F.lit(False).alias("up_to")))


def endpoints(p: Column, side: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(p, lambda x: x[side])))


def posting_fault(p: Column) -> Column:
    """Why a posting is refused, or null: source, destination, asset, amount, in that order."""
    return (
        F.when(~address_valid(p["source"]), "source")
        .when(~address_valid(p["destination"]), "destination")
        .when(~asset_valid(p["asset"]), "asset")
        .when(p["amount"].isNull() & ~p["up_to"], "amount missing")
        .when(p["amount"] < 0, "amount negative")
    )


def postings_fault(p: Column) -> Column:
    """struct(index, reason) of the first refused posting, or null."""
    faults = F.transform(p, lambda x, i: F.struct(i.alias("index"), posting_fault(x).alias("reason")))
    return F.get(F.filter(faults, lambda x: x["reason"].isNotNull()), F.lit(0))


def metadata_valid(m: Column) -> Column:
    keys, values = F.map_keys(m), F.map_values(m)
    return (
        (F.cardinality(m) <= MAX_KEYS)
        & ~F.exists(keys, lambda k: (k == "") | (F.octet_length(k) > MAX_KEY_BYTES))
        & ~F.exists(values, lambda v: F.octet_length(v) > MAX_VALUE_BYTES)
    )


def canonical_hash(*parts: Column) -> Column:
    """Hex SHA-256 of the JSON of the parts; maps must come through `sorted_map`."""
    return F.sha2(F.to_json(F.struct(*parts)).cast("binary"), 256)


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def rate_parts(rate: Column) -> tuple[Column, Column]:
    """(unscaled, scale) of a plain positive decimal string, null for anything else."""
    ok = rate.rlike(r"^[0-9]+(\.[0-9]+)?\z") & rate.rlike("[1-9]")
    places = F.length(F.regexp_extract(rate, r"\.([0-9]+)", 1))
    return F.when(ok, F.replace(rate, F.lit("."), F.lit("")).try_cast(AMOUNT)), F.when(ok, places)


def receives(amount: Column, rate: Column, from_scale: Column, to_scale: Column) -> Column:
    """struct(amount, exact): the bought amount, truncated, by exact decimal arithmetic.

    Only powers of ten divide, so digits are dropped from the product's text; decimal division would round.
    """
    unscaled, scale = rate_parts(rate)
    product = (amount.cast("decimal(19,0)") * unscaled.cast("decimal(18,0)")).cast("decimal(38,0)").cast("string")
    drop = scale + from_scale - to_scale
    more = F.concat(product, F.repeat(F.lit("0"), F.greatest(-drop, F.lit(0))))

    def cut(x: Column) -> Column:
        d, m = x["d"], x["m"]
        kept = F.when(d >= F.length(m), F.lit("0")).when(d > 0, F.left(m, F.length(m) - d)).otherwise(m)
        lost = F.when(d > 0, F.right(m, d)).otherwise(F.lit(""))
        return F.struct(kept.try_cast(AMOUNT).alias("amount"), (~lost.rlike("[1-9]")).alias("exact"))

    # one element, so that the product is worked out once
    return F.transform(F.array(F.struct(drop.alias("d"), more.alias("m"))), cut)[0]


def has_up_to(p: Column) -> Column:
    """Whether any posting is a ceiling."""
    return F.exists(p, lambda x: F.coalesce(x["up_to"], F.lit(False)))


def merged(old: Column, new: Column) -> Column:
    """Maps joined; the new value of a key wins."""
    keep = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(keep, new)


def without_key(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def holds(m: Column, part: Column) -> Column:
    """Whether a map has all entries of another."""
    return F.forall(F.map_entries(part), lambda e: F.coalesce(F.element_at(m, e["key"]) == e["value"], F.lit(False)))


def tagged(m: Column, key: str, value: Column) -> Column:
    """The metadata with the batch's tag."""
    return merged(m, F.create_map(F.lit(key), value))


def tip_parts(tip: Column) -> Column:
    """struct(ledger, id, hash in lower-case hex) of a tip's text, or null."""
    parts = F.split(tip, ":")
    raw = F.translate(F.element_at(parts, 3), "-_", "+/")
    ok = tip.rlike(r"^[^:]+:[0-9]{1,18}:[A-Za-z0-9_-]{43}\z")
    return F.when(ok, F.struct(F.element_at(parts, 1).alias("ledger"), F.element_at(parts, 2).try_cast("long").alias("id"), F.lower(F.hex(F.unbase64(F.concat(raw, F.lit("="))))).alias("hash")))


MAX_DETAIL = 4000


def short_detail(detail: Column) -> Column:
    """A check's detail, cut where it is too long; empty is null."""
    cut = F.concat(F.left(detail, F.lit(MAX_DETAIL)), F.lit("... (truncated)"))
    return F.when(detail != "", F.when(F.char_length(detail) > MAX_DETAIL, cut).otherwise(detail))
