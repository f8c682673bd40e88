"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Measures of the whole text come first (they are part of the result); then the rules. Each rule's cost and rejection
rate are estimated on a bounded sample of rows, and the cascade asks the rules in order of rejection per cost, so most
bad documents never meet the expensive ones. A rule's cost is what it adds to a pass over the sample repeated REPEAT
times, less that of a pass without rules. The order changes the time, never the verdict: a document is kept if no rule
rejects it.

Defined results: null text counts as empty: no words, rejected. Repeated rows: one result row each. Empty table: no
rows. All columns of the input stay beside the measures when asked for; measures win clashes of names.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm.common import bind, publish, word_array

SAMPLE_ROWS = 512
SAMPLE_BYTES = 32 << 10
REPEAT = 20
#: No rule counts as cheaper, for a pass: what timing can tell.
LEAST_SECONDS = 1e-3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


#: Columns that the operator makes; they win clashes of names.
OWN = ("doc_id", "_text", "_words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")


def count_chars(text: Column, chars: str) -> Column:
    """How often any of these ASCII characters stands in a text."""
    n = F.octet_length(text)
    return sum((n - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars[1:]), n - F.octet_length(F.replace(text, F.lit(chars[0]), F.lit(""))))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that are found at least twice in the text.

    Windows are compared by 64-bit hash. Texts without a repeated window (a hash set tells) skip the sort.
    """
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.filter(F.transform(s, lambda x, i: F.when(twin(x, i - 1) | twin(x, i + 1), x["i"])), lambda p: p.isNotNull())

        return F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            bind(bind(order, starts), lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2))))),
        ).otherwise(0)

    return bind(windows, covered)


def dup_lines(text: Column) -> tuple[Column, Column]:
    """(lines with a word, those equal to an earlier one)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.size(lines), bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` and doc_id, _text, and the measures, all long."""
    keep = [c for c in keep or [] if c not in OWN]
    own = [F.col(c) for c in keep]
    text = F.col("_text")
    base = docs.select("doc_id", *own, F.coalesce("text", F.lit("")).alias("_text"))
    base = base.select("*", word_array(text).alias("_words"))
    return base.select(
        "doc_id",
        *keep,
        "_text",
        F.size("_words").cast("long").alias("n_words"),
        (F.char_length(text) - count_chars(text, BLANKS)).cast("long").alias("word_chars"),
        count_chars(text, SYMBOLS).cast("long").alias("n_symbols"),
        dup_lines(text)[1].cast("long").alias("n_dup_lines"),
        bind(F.col("_words"), repeat_words).cast("long").alias("n_repeat_words"),
    )


def rules() -> dict[str, Column]:
    """name -> whether the rule rejects, over the measures and _text. Never null."""
    text, n = F.col("_text"), F.col("n_words")
    letters = lambda kind: F.char_length(text) - F.char_length(F.regexp_replace(text, kind, ""))
    return {
        "short": n < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "same_lines": (F.col("n_dup_lines") > 3) & (10 * F.col("n_dup_lines") > 3 * dup_lines(text)[0]),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "shouting": bind(letters(r"\p{Lu}+"), lambda up: (up > 200) & (2 * up > F.col("word_chars"))),
        "marks": bind(letters("!+"), lambda x: 5 * x > n),
    }


BASE = ("short", "repetitive")


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """The first rows at hand with texts of SAMPLE_BYTES at most, through the driver: Spark reads one partition, and more
    only if they hold too few."""
    spark: SparkSession = docs.sparkSession
    own = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    few = spark.createDataFrame(own.take(rows), own.schema)
    return publish(measured(few.repartition(max(1, min(8, rows // 64)))), "sample")


def seconds(sample: DataFrame, rule: Column | None) -> float:
    """The lesser time of two passes over the sample, each row REPEAT times; the rule is asked anew for each."""
    again = sample.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))
    again = again.withColumn("_text", F.concat(F.col("_text"), F.substring(F.lit("  "), 1, F.col("_k") % 2)))
    ask = F.count_if(F.length("_text") >= 0 if rule is None else (F.length("_text") >= 0) & rule)
    took = []
    for _ in range(2):
        began = time.perf_counter()
        again.agg(ask).first()
        took.append(time.perf_counter() - began)
    return min(took)


def cascade_order(sample: DataFrame, chosen: dict[str, Column]) -> list[tuple[str, float, float]]:
    """(rule, rejection rate, seconds per row) by rejection per cost, best first; measured on a sample of rows."""
    names = list(chosen)
    row = sample.agg(F.count("*").alias("_n"), *(F.count_if(chosen[k]).alias(k) for k in names)).first()
    n = max(1, row["_n"])
    seconds(sample, None)  # compiles the code
    took = {k: seconds(sample, chosen[k]) for k in names}
    idle = seconds(sample, None)
    out = [(k, row[k] / n, max(took[k] - idle, LEAST_SECONDS) / (n * REPEAT)) for k in names]
    return sorted(out, key=lambda x: (-x[1] / x[2], names.index(x[0])))


def judged(docs: DataFrame, keep: list[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the columns `keep`, the measures, base_failed, kept, and the first rule of the cascade that rejects.

    The sample (the first `sample_rows` rows at hand) only sets the order of the rules.
    """
    sample = sampled(docs, sample_rows)
    all_rules = rules()
    order = [k for k, *_ in cascade_order(sample, all_rules)]
    out = measured(docs, keep)
    base_failed = all_rules[BASE[0]] | all_rules[BASE[1]]
    first = F.lit(None).cast("string")
    for k in reversed(order):
        first = F.when(all_rules[k], F.lit(k)).otherwise(first)
    out = out.withColumn("base_failed", base_failed).withColumn("rejected_by", first)
    # A filter on the verdict must not be pushed below the measures, which would then be computed twice: as far as the
    # optimizer knows, the verdict depends on the row's number.
    return out.withColumn("kept", F.col("rejected_by").isNull() & (F.monotonically_increasing_id() >= 0)).drop("_text")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    names = docs.columns
    bare = docs.select(F.struct(*names).alias("_row"), "text", "doc_id")
    return judged(bare, ["_row"]).where("kept").select(*(F.col("_row")[c].alias(c) for c in names))
