"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once: a document's ledger row holds its measurements and ``failures``, a long with bit i set where
rule i fails.  A policy is a versioned choice of rules; applying one, or counting what a rule alone rejects, is bitwise
arithmetic on the ledger and reads no text again.

Repeats are found by hashes: 5-word windows of a text get a 64-bit hash each, and a text whose hashes all differ (most do)
is done; else the hashes are sorted with their positions and the windows found twice or more are laid over the words.

Defined results: null text has no words; with fewer than 5 words there is no window; repeated rows get repeated results;
an empty table gives an empty result; every column of the input is kept, whatever its name, and the ledger is one struct
column whose name ``add_ledger`` takes.  Identifiers keep their type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ._names import unused, unused_prefix

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5

#: Name and failure condition, over the measurements, of each rule; bit i is rule i, and rules are only ever appended.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "10 * word_chars < 20 * n_words"),
    ("long_words", "10 * word_chars > 200 * n_words"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any of ``rules``."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("web-1", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words")))}
PRODUCTION = "web-1"


MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, prefix: str, column: str = "text") -> DataFrame:
    """``docs`` with a column ``<prefix>_<name>`` for each of MEASUREMENTS.

    Flat columns that are used more than once keep the optimiser from repeating their expressions.
    """
    p, k = prefix, REPEAT_WINDOW
    df = docs.withColumn(f"{p}_text", F.coalesce(F.col(f"`{column}`"), F.lit("")))
    df = df.withColumn(f"{p}_words", F.expr(rf"filter(split({p}_text, r'{BLANKS}'), w -> w <> '')"))
    df = df.withColumn(f"{p}_lines", F.expr(rf"filter(split({p}_text, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')"))
    df = df.withColumn(f"{p}_h", F.expr(f"transform({p}_words, w -> xxhash64(w))"))
    window = ", ".join(f"{p}_h[i + {j}]" for j in range(k))
    df = df.withColumn(f"{p}_g", F.expr(f"if(size({p}_h) >= {k}, transform(sequence(0, size({p}_h) - {k}), i -> xxhash64({window})), array())"))
    df = df.withColumn(f"{p}_twice", F.expr(f"size(array_distinct({p}_g)) < size({p}_g)"))
    # only texts with repeats sort their windows
    df = df.withColumn(f"{p}_s", F.expr(f"if({p}_twice, array_sort(transform({p}_g, (g, i) -> struct(g, i))), array())"))
    df = df.withColumn(f"{p}_p", F.expr(f"array_sort(transform(filter({p}_s, (s, i) -> (i > 0 and {p}_s[i - 1].g = s.g) or (i < size({p}_s) - 1 and {p}_s[i + 1].g = s.g)), s -> s.i))"))
    repeat = F.expr(f"aggregate(transform({p}_p, (p, i) -> if(i < size({p}_p) - 1, least({k}, {p}_p[i + 1] - p), {k})), 0L, (a, x) -> a + x)")
    m = {
        "n_words": F.size(f"{p}_words").cast("long"),
        "word_chars": F.length(F.translate(f"{p}_text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(f"{p}_text") - F.length(F.translate(f"{p}_text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(f"{p}_lines").cast("long"),
        "n_dup_lines": (F.size(f"{p}_lines") - F.size(F.array_distinct(f"{p}_lines"))).cast("long"),
        "n_repeat_words": repeat,
    }
    return df.withColumns({f"{p}_{k}": v for k, v in m.items()}).drop(*[f"{p}_{x}" for x in ("text", "words", "lines", "h", "g", "twice", "s", "p")])


def add_ledger(docs: DataFrame, name: str = "ledger", column: str = "text") -> DataFrame:
    """``docs`` with one struct column ``name`` added (or replaced): the measurements and ``failures``."""
    p = unused_prefix([*docs.columns, name])
    df = measured(docs, p, column)
    bits: Column = F.lit(0).cast("long")
    for i, (_, rule) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(re.sub(rf"\b({'|'.join(MEASUREMENTS)})\b", rf"{p}_\1", rule)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    df = df.withColumn(f"{p}_failures", bits)
    fields = (*MEASUREMENTS, "failures")
    return df.withColumn(name, F.struct(*[F.col(f"{p}_{f}").alias(f) for f in fields])).drop(*[f"{p}_{f}" for f in fields])


def rejected(failures: Column, policy: Policy) -> Column:
    return failures.bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def filtered(docs: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """The documents that a policy keeps, with the columns they came with."""
    ledger, failures = unused(docs.columns, "ledger", "failures")
    # A filter is pushed below the projections that make its columns, each use of a column repeating all it is made of:
    # here that is exponential.  Adding a row number's bits to the column, none of which remain, keeps the filter above.
    fence = F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))
    marked = add_ledger(docs, ledger).withColumn(failures, F.col(f"{ledger}.failures").bitwiseOR(fence))
    return marked.where(~rejected(F.col(failures), POLICIES[version])).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablations(ledger: DataFrame, version: str = PRODUCTION, name: str = "ledger") -> DataFrame:
    """For each rule of a policy: documents it fails, and documents that only it rejects; one pass, one group a failure pattern."""
    policy = POLICIES[version]
    patterns = ledger.groupBy(F.col(f"{name}.failures").bitwiseAND(F.lit(policy.mask).cast("long")).alias("failures")).agg(F.count("*").alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in policy.rules])).alias("r")
    return patterns.select("failures", "n", rows).groupBy("r.rule").agg(
        F.sum(F.when(F.col("failures").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("failures") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejects_alone"),
    )


def digest(docs: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failures."""
    rows = add_ledger(docs.select("doc_id", "text"), "__l")
    base, own = rejected(F.col("__l.failures"), BASE), rejected(F.col("__l.failures"), POLICIES[version])
    return rows.select("doc_id", *[f"__l.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base.alias("base_failed"), (~base & ~own).alias("kept"), "__l.failures")
