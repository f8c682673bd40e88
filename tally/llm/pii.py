"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base kinds (email, ip, card, phone) come from patterns and checks. Candidates for more are units: runs without blanks,
quotes and brackets that hold a digit or an @, and whatever stands behind a label and `=` or `:`. Seeds are the base
entities and the units that look like a key (a long run of hexadecimal digits, letters and digits mixed). A lexical
pattern is what stands around a unit, in lower case: the two or three words before it, a label before it, the word
before and the one behind it, or the two words behind it (`my key is _`, `token = "_`, `_ is my`).

Spark scores the graph of patterns and distinct values, for each kind apart. A value is believed as a seed of its kind
(1), as a seed of another (0), or as much as its patterns (their noisy-or, damped); a pattern's confidence is the mean
belief in its values. Rounds go on until no confidence moves by more than TOLERANCE. Patterns of enough seeds (SUPPORT)
and CONFIDENCE give their kind to every unit that they surround and that has the look of the kind (LOOKS). A unit that
looks like a key and stands behind a label is a span of kind `secret` by confidence alone, however few keys there are.

Only units and their graph are shuffled, never texts; equal texts count once. A pattern that a third of all rows carry
is summed in parts.

Regular expressions are possessive, and begin only where a run begins or a match has ended, so that long runs of
letters or digits take linear time; places and masks are summed by blocks (BLOCK), so that many spans do, too.

Defined results: null text counts as empty. A unit that overlaps a base span adds nothing. Left of a unit the last
LEFT characters count, right of it the first RIGHT. Repeated rows: one result row each. A null doc_id is kept; rows are
told apart by the hash of the text. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import MAX_BROADCAST, SPACE, bind, discard, fresh, publish, short

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
LOCAL = "A-Za-z0-9._%+-"
PATTERN = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that must hold for the pattern to find anything that passes its check.
GUARD = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: What units are made of.
CHAR = r"\x20\x09-\x0D\"'=:,;()\[\]{}<>"
LABEL = r"[A-Za-z0-9_-]\x20?[=:]\x20?[\"']?"
UNIT = "|".join(
    [
        PATTERN["phone"],
        rf"(?<![^{CHAR}])[0-9]++(?:[\x20-][0-9]++)++(?![^{CHAR}])",
        rf"(?<![^{CHAR}])(?:(?=[^{CHAR}0-9@]*+[0-9@])|(?<={LABEL}))[^{CHAR}]++",
    ]
)
UNIT_GUARD = r"[0-9@]|[A-Za-z0-9_-]\x20?[=:]"
#: Not part of a value where they stand at its ends.
EDGE = r"[.!?#*$%&|]+"
KEY = r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}$"
LOOKS = {"email": "@.", "ip": r"[0-9]+[.:][0-9]", "card": "(?:[0-9][^0-9]?){8}", "phone": "(?:[0-9][^0-9]{0,2}){6}", "secret": "^.{4}"}
LEFT, RIGHT = 96, 48
BLOCK = 256
DAMPING = 0.5
TOLERANCE = 0.01
STEPS = 3
MAX_ROUNDS = 300
SUPPORT = 5
CONFIDENCE = 0.8
PLACE = "struct<start:int,value:string,left:string,right:string>"
NONE = "CAST(array() AS array<struct<start:int,k:int,end:int,value:string>>)"


def scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of int under `join` (associative, 0 at the start), by blocks."""
    none = F.expr("CAST(array() AS array<int>)")
    zero = F.lit(0)
    count = F.floor((F.size(values) + BLOCK - 1) / BLOCK).cast("int")
    blocks = F.when(F.size(values) > 0, F.transform(F.sequence(zero, count - 1), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))).otherwise(F.expr("CAST(array() AS array<array<int>>)"))

    def run(x: Column) -> Column:
        step = lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.array_append(acc["out"], join(acc["at"], v)).alias("out"))
        return F.aggregate(x, F.struct(zero.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(inner: Column) -> Column:
        ends = run(F.transform(inner, lambda x: F.element_at(x, -1)))
        return F.flatten(bind(ends, lambda e: F.transform(inner, lambda x, i: F.transform(x, lambda v: join(F.when(i > 0, F.get(e, i - 1)).otherwise(0), v)))))

    return bind(F.transform(blocks, run), whole)


def plus(a: Column, b: Column) -> Column:
    return a + b


def places(text: Column, pattern: str, around: bool = False) -> Column:
    """array of struct(start, value) of all matches; start counts code points. around: also what stands left and right
    of each, up to its neighbours, or up to LEFT and RIGHT characters (^ and $ at the text's ends)."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def walk(found: Column, between: Column) -> Column:
        ends = scan(F.transform(found, lambda m, i: F.char_length(F.get(between, i)) + F.char_length(m)), plus)

        def one(m: Column, i: Column, ends: Column) -> Column:
            own = [(F.get(ends, i) - F.char_length(m)).alias("start"), m.alias("value")]
            if around:
                before, after = F.get(between, i), F.get(between, i + 1)
                left = F.when(F.char_length(before) > LEFT, F.regexp_replace(F.substring(before, -LEFT, LEFT), rf"^[^\x20\x09-\x0D]*+{SPACE}", ""))
                left = left.otherwise(F.concat(F.when(i > 0, "# ").otherwise("^ "), before))
                right = F.when(F.char_length(after) > RIGHT, F.regexp_replace(F.substring(after, 1, RIGHT), rf"{SPACE}[^\x20\x09-\x0D]*$", ""))
                own += [left.alias("left"), right.otherwise(F.concat(after, F.when(i + 1 < F.size(found), " #").otherwise(" $"))).alias("right")]
            return F.struct(*own)

        return bind(ends, lambda e: F.transform(found, lambda m, i: one(m, i, e)))

    return bind(F.struct(found.alias("f"), between.alias("b")), lambda s: walk(s["f"], s["b"]))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    figures = F.transform(F.split(F.reverse(d), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    twice = F.transform(figures, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int").between(0, 255) & (F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3))
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans in order: array of struct(start, k, end, value); k numbers the kinds."""

    def of(k: int, kind: str) -> Column:
        span = lambda p: F.struct(p["start"].alias("start"), F.lit(k).alias("k"), (p["start"] + F.char_length(p["value"])).alias("end"), p["value"].alias("value"))
        found = F.transform(F.filter(places(text, PATTERN[kind]), lambda p: F.coalesce(passes(kind, p["value"]), F.lit(False))), span)
        return F.when(text.rlike(GUARD[kind]), found).otherwise(F.expr(NONE))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS[:4]))))


def units(text: Column) -> Column:
    """array of struct(start, value, left, right) of all units."""
    return F.when(text.rlike(UNIT_GUARD), places(text, UNIT, True)).otherwise(F.expr(f"CAST(array() AS array<{PLACE}>)"))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, units): one row per row of docs, kept for the rounds."""
    text = F.col("_text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    return rows.select("doc_id", F.xxhash64("_text").alias("text_hash"), base_spans(text).alias("base"), units(text).alias("units"))


def patterns(left: Column, right: Column) -> Column:
    """Lexical patterns around a unit; # stands for another unit, ^ and $ for the text's ends."""
    before = F.array_remove(F.split(F.lower(left), SPACE), "")
    behind = F.array_remove(F.split(F.lower(right), SPACE), "")

    def made(w: Column) -> Column:
        a, b = w["a"], w["b"]
        last = lambda n: F.when(F.size(a) >= n, F.concat(F.array_join(F.slice(a, -n, n), " "), F.lit(" _")))
        word = lambda c: F.coalesce(c.rlike(r"[^#^$]"), F.lit(False))
        l1, l2, r1, r2 = F.element_at(a, -1), F.get(a, F.size(a) - 2), F.get(b, F.lit(0)), F.get(b, F.lit(1))
        l1 = F.when(F.size(a) > 0, F.get(a, F.size(a) - 1))
        return F.array_compact(
            F.array(
                F.when(word(l1) & word(l2), last(3)),
                F.when(word(l1) & word(l2), last(2)),
                F.when(l1.rlike("[^=:\"']+[=:]"), last(1)),
                F.when(word(l1) & word(r1), F.concat_ws(" ", l1, F.lit("_"), r1)),
                F.when(word(r1) & word(r2), F.concat_ws(" ", F.lit("_"), r1, r2)),
            )
        )

    return bind(F.struct(before.alias("a"), behind.alias("b")), made)


def mentioned(rows: DataFrame) -> DataFrame:
    """(text_hash, start, end, value, patterns, base, labelled): units of distinct texts; base is the kind of a base
    span that the unit overlaps, or -1."""
    texts = rows.where(F.size("units") > 0).select("text_hash", "base", "units").dropDuplicates(["text_hash"])
    own = lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["k"].alias("k"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"))
    unit = lambda u: F.struct(u["start"].alias("start"), (u["start"] + F.char_length(u["value"])).alias("end"), F.lit(None).cast("int").alias("k"), u["value"].alias("raw"), u["left"].alias("left"), u["right"].alias("right"))
    both = texts.select("text_hash", F.inline(F.concat(F.transform("base", own), F.transform("units", unit))))
    # Both frames grow from their first row: one that shrinks would be summed anew for every row.
    so_far = lambda *order: Window.partitionBy("text_hash").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.col("k").isNotNull()
    before = F.max(F.when(base, F.struct("end", "k"))).over(so_far("start"))
    behind = F.min(F.when(base, F.struct("start", "k"))).over(so_far(F.desc("start")))
    both = both.withColumns({"_before": before, "_behind": behind}).where("k IS NULL")
    kind = F.when(F.col("_before.end") > F.col("start"), F.col("_before.k")).when(F.col("_behind.start") < F.col("end"), F.col("_behind.k")).otherwise(-1)
    value = F.regexp_replace(F.regexp_replace("raw", rf"^{EDGE}", ""), f"{EDGE}$", "")
    start = F.col("start") + F.char_length("raw") - F.char_length(F.regexp_replace("raw", rf"^{EDGE}", ""))
    out = both.select("text_hash", "start", "raw", "left", "right", kind.alias("base"), value.alias("value"), start.alias("_at"))
    return out.where("value <> ''").select(
        "text_hash",
        F.col("_at").alias("start"),
        (F.col("_at") + F.char_length("value")).alias("end"),
        "value",
        patterns(F.col("left"), F.col("right")).alias("patterns"),
        "base",
        F.col("left").rlike(rf"{LABEL}$").alias("labelled"),
    )


def scored(edges: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(pattern, k, confidence, support) of the graph `edges` (pattern, value, seed), distinct in pattern and value.

    seed is a kind, or -1. A pattern of one value says nothing of it: with a seed its confidence is 1, else it is left
    out. Rounds add belief only, so confidences rise to a fixed point; STEPS rounds make a table.
    """
    seeds = publish(edges.where("seed >= 0").select("value", F.col("seed").alias("k"), F.lit(1.0).alias("r")).distinct(), "seeds")
    support = edges.where("seed >= 0").groupBy("pattern", F.col("seed").alias("k")).agg(F.count("*").alias("support"))
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    fixed = publish(size.join(support, "pattern").select("pattern", "k", "size", "support"), "support")
    open_ = publish(edges.where("seed < 0").select("pattern", "value").join(seeds.select("value"), "value", "left_anti").join(size.where("size > 1"), "pattern"), "open")
    now = fixed.select("pattern", "k", (F.col("support") / F.col("size")).alias("confidence"))
    if open_.isEmpty():
        return fixed.select("pattern", "k", (F.col("support") / F.col("size")).alias("confidence"), "support")

    def step(now: DataFrame) -> DataFrame:
        doubt = F.exp(F.sum(F.log(F.lit(1.0) - DAMPING * F.col("confidence"))))
        belief = open_.select("pattern", "value").join(now, "pattern").groupBy("value", "k").agg((1.0 - doubt).alias("r"))
        told = open_.join(belief, "value").select("pattern", "k", (F.col("r") / F.col("size")).alias("c"))
        told = told.union(fixed.select("pattern", "k", (F.col("support") / F.col("size")).alias("c")))
        return told.groupBy("pattern", "k").agg(F.sum("c").alias("confidence"))

    last = None
    for _ in range(0, MAX_ROUNDS, STEPS):
        for _ in range(STEPS - 1):
            now = step(now)
        was = now.select("pattern", "k", F.col("confidence").alias("was"))
        new = publish(step(now).join(was, ["pattern", "k"], "left"), "patterns")
        moved = new.agg(F.max(F.col("confidence") - F.coalesce("was", F.lit(0.0))).alias("m")).first()["m"]
        discard(last)
        last, now = new, new.select("pattern", "k", "confidence")
        if moved is None or moved <= tolerance:
            return now.join(fixed.select("pattern", "k", "support"), ["pattern", "k"], "left").select("pattern", "k", "confidence", F.coalesce("support", F.lit(0)).alias("support"))
    raise RuntimeError(f"patterns did not settle in {MAX_ROUNDS} rounds")


def looks(k: Column, value: Column) -> Column:
    """Whether a value could be of the kind."""
    return F.element_at(F.array(*(value.rlike(LOOKS[x]) for x in KINDS)), k + 1)


def found(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, text_hash, base, spans): spans holds base spans and those that confident patterns add, in order."""
    rows = publish(scanned(docs), "scanned")
    m = mentioned(rows).withColumn("seed", F.when(F.col("base") >= 0, F.col("base")).when(F.col("value").rlike(KEY), SECRET).otherwise(-1))
    m = publish(m, "units")
    edges = m.select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    edges = publish(edges, "graph")
    good = scored(edges).where(F.col("confidence") >= confidence)
    span = lambda k: F.struct("start", k.alias("k"), "end", "value").alias("span")
    open_ = m.where("base < 0").select("text_hash", "start", "end", "value", "seed", "labelled", F.explode("patterns").alias("pattern")).join(good, "pattern")
    open_ = open_.where((F.col("support") >= support) | (F.col("labelled") & (F.col("seed") == SECRET) & (F.col("k") == SECRET)))
    best = F.max_by("k", F.struct("confidence", -F.col("k"))).alias("k")
    new = open_.where(looks(F.col("k"), F.col("value"))).groupBy("text_hash", "start", "end", "value").agg(best).select("text_hash", span(F.col("k")))
    new = new.groupBy("text_hash", "span.start", "span.end").agg(F.min("span").alias("span"))
    new = publish(new.groupBy("text_hash").agg(F.array_sort(F.collect_list("span")).alias("new")), "learnt")
    both = rows.join(short(new, MAX_BROADCAST // 8), "text_hash", "left")
    spans = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new")))
    return both.select("doc_id", "text_hash", "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with <KIND> in place of each span; of overlapping spans the first names the whole.

    The text is cut for BLOCK spans at a time, so that no span counts from the text's beginning.
    """
    name = lambda k: F.element_at(F.array(*(F.lit(f"<{x.upper()}>") for x in KINDS)), k + 1)

    def put(s: Column) -> Column:
        spans, reach = s["s"], s["r"]
        until = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)

        def block(b: Column) -> Column:
            first = until(b * BLOCK)
            last = F.get(reach, F.least((b + 1) * BLOCK, F.size(spans)) - 1)
            piece = lambda cut: F.transform(
                F.slice(spans, b * BLOCK + 1, BLOCK),
                lambda x, i: F.when(
                    x["start"] >= until(b * BLOCK + i),
                    F.concat(F.substring(cut, until(b * BLOCK + i) - first + 1, x["start"] - until(b * BLOCK + i)), name(x["k"])),
                ).otherwise(""),
            )
            return F.array_join(bind(F.substring(text, first + 1, last - first), piece), "")

        count = F.floor((F.size(spans) + BLOCK - 1) / BLOCK).cast("int")
        end = F.element_at(reach, -1)
        tail = F.substring(text, end + 1, F.char_length(text))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), block), ""), tail)

    reach = scan(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) > 0, bind(F.struct(spans.alias("s"), reach.alias("r")), put)).otherwise(text)


def mask(docs: DataFrame, **kw) -> DataFrame:
    """The documents with personal data masked; n_chars, where there is one, follows the text.

    Where the list of spans is too long to be broadcast, only texts that hold anything like a unit are shuffled.
    """
    names = docs.columns
    own_hash, own = fresh(docs, "_hash", "_spans")
    spans = found(docs, **kw).where(F.size("spans") > 0).select(F.col("text_hash").alias(own_hash), F.col("spans").alias(own)).dropDuplicates([own_hash])
    spans = publish(spans, "spans")
    text = F.coalesce(docs["text"], F.lit(""))

    def put(rows: DataFrame, side: DataFrame) -> DataFrame:
        out = rows.join(side, F.xxhash64(F.coalesce(rows["text"], F.lit(""))) == side[own_hash], "left")
        clean = F.col(own).isNull()
        out = out.withColumn("text", F.when(clean, F.col("text")).otherwise(masked(F.col("text"), F.col(own))))
        if "n_chars" in names:
            out = out.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
        return out.select(*names)

    if spans.count() <= MAX_BROADCAST // 8:
        return put(docs, F.broadcast(spans))
    some = text.rlike("|".join([*GUARD.values(), UNIT_GUARD]))
    return docs.where(~some).union(put(docs.where(some), spans))
