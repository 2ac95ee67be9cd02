"""Licence notices in documents by the Dice coefficient of word bigrams, with DataFrame functions only.

Text is normalised: lower case, runs of what is neither letter nor digit become one blank.  Bigrams count as often as they
occur, so a segment of n words has n - 1, and its coefficient with a template of m words is at most
2 min(n - 1, m - 1) / (n + m - 2): a segment is compared only with templates whose size leaves the threshold within reach.

A document is compared as a whole, by paragraph (between blank lines), by line and by windows.  A window has as many words as a
template and begins where a bigram of the text and the same first like it of the template come to lie on each other, so that a notice
is found within a line, in a paragraph that goes on, or wrapped over lines of a comment.

First the whole text is normalised once and the bigrams that any template has are noted.  A coefficient at the threshold
needs common bigrams in some share of a template's (see ``least_common``), so a template with fewer of its bigrams in the
whole text is out; with none left, as for most documents, that is all.

All work is within a row, no shuffle, and in proportion to the text's length (times a template's, where it has its bigrams).  Defined results: null and wordless text and segments of one word match nothing;
repeated rows get repeated results; an empty table gives an empty result; other columns are ignored.  Of equal coefficients
that with the longer template is the best one, then the smaller licence name.  Identifiers keep their type.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .license_templates import TEMPLATES

#: Least Dice coefficient of a match, in per cent.
THRESHOLD = 80
NOT_WORD = r"[^\p{L}\p{N}]+"


def template_rows(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, int, list[str]]]:
    """(licence, bigrams, the k-th occurrence of bigram "a b" as "a b k")"""
    out = []
    for name, text in templates:
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        seen: Counter[str] = Counter()
        grams = []
        for p in pairs:
            seen[p] += 1
            grams.append(f"{p} {seen[p]}")
        out.append((name, len(pairs), grams))
    return out


def _sql_templates(rows: list[tuple[str, int, list[str]]], threshold: int) -> str:
    quote = lambda s: "'" + s + "'"  # noqa: E731  words hold letters and digits alone
    plain = lambda g: [x.rsplit(" ", 1)[0] for x in g]
    return "array(" + ", ".join(f"named_struct('license', {quote(a)}, 'n', {n}, 'least', {least_common(n, threshold)}, 'grams', array({', '.join(map(quote, g))}), 'plain', array({', '.join(map(quote, plain(g)))}))" for a, n, g in rows) + ")"


def least_common(n: int, threshold: int = THRESHOLD) -> int:
    """Bigrams that any text must have in common with a template of ``n`` to reach the threshold: all its own are common, at best."""
    return -(-threshold * n // (200 - threshold))


def reach(n: int, threshold: int = THRESHOLD) -> tuple[int, int]:
    """Least and most bigrams of a segment that can reach the threshold with a template of ``n``."""
    return -(-threshold * n // (200 - threshold)), (200 - threshold) * n // threshold


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value worked out once: inside a lambda an expression is worked out again wherever it stands."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def matches(text: Column, threshold: int = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> Column:
    """array of (license, n, dice) of every segment and template at or above the threshold."""
    rows = template_rows(templates)
    least, most = min(reach(n, threshold)[0] for _, n, _ in rows), max(reach(n, threshold)[1] for _, n, _ in rows)
    words = lambda s: F.filter(F.split(F.regexp_replace(F.lower(s), NOT_WORD, " "), " "), lambda w: w != "")
    bigrams = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    numbered = lambda p: F.transform(p, lambda g, i: F.concat(g, F.lit(" "), (i + 2 - F.array_position(p, g)).cast("string")))  # noqa: E731  of a sorted array
    known = F.expr(_sql_templates(rows, threshold))
    text = F.coalesce(text, F.lit(""))
    # places of the bigrams that any template has
    every = sorted({x.rsplit(" ", 1)[0] for _, _, g in rows for x in g})
    grams = F.filter(F.array(words(text)), lambda w: F.size(w) > 1)
    noted = F.transform(grams, lambda w: F.struct((F.size(w) - 1).alias("n"), F.filter(F.transform(bigrams(w), lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda h: h["g"].isin(every)).alias("hits")))
    own = lambda hits, t: F.filter(hits, lambda h: F.array_contains(t["plain"], h["g"]))
    # a template's bigrams that the text has at all, however often, bound what any part of it has in common with the template
    open_ = lambda x: _let(F.array_distinct(F.transform(x["hits"], lambda h: h["g"])), lambda there: F.filter(known, lambda t: F.size(F.filter(t["plain"], lambda p: F.array_contains(there, p))) >= t["least"]))
    # one element at most: the text's templates, places and size, each worked out once
    left = F.filter(F.transform(noted, lambda x: F.struct(x["n"].alias("n"), x["hits"].alias("hits"), open_(x).alias("templates"))), lambda x: F.size(x["templates"]) > 0)

    lines = F.split(text, "\n")
    blocks = F.when(F.contains(text, F.lit("\n")), F.concat(F.array(text), F.split(text, r"\n[\x20\x09-\x0D]*\n"))).otherwise(F.array().cast("array<string>"))
    segments = F.filter(F.transform(F.array_distinct(F.concat(lines, blocks)), words), lambda w: F.size(w).between(least + 1, most + 1))
    pairs = F.transform(F.transform(segments, lambda w: F.array_sort(bigrams(w))), numbered)
    within = lambda g, t: (F.size(g) * (200 - threshold) >= t["n"] * threshold) & (F.size(g) * threshold <= t["n"] * (200 - threshold))
    scored = lambda g, ts: F.transform(F.filter(ts, lambda t: within(g, t)), lambda t: F.struct(t["license"].alias("license"), t["n"].alias("n"), (2 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("dice")))
    of_segments = lambda x: F.flatten(F.transform(pairs, lambda g: scored(g, x["templates"])))

    def windows(x: Column, t: Column) -> Column:
        """The best window of a template.  Hits are in order of place and one a place, so those of a window that begins where the k-th
        hit asks for it are among the n hits before and after that; the work is in proportion to hits times n.
        """
        share = lambda w: F.when(F.size(w) >= t["least"], _let(F.array_sort(w), lambda p: F.size(F.array_intersect(numbered(p), t["grams"]))) / t["n"]).otherwise(F.lit(0.0))
        inside = lambda hits, a: F.transform(F.filter(F.slice(hits, F.greatest(F.lit(1), a["k"] + 1 - t["n"]), 2 * t["n"] + 1), lambda h: (h["i"] >= a["s"]) & (h["i"] < a["s"] + t["n"])), lambda h: h["g"])
        begins = lambda hits: F.transform(hits, lambda h, k: F.struct((h["i"] - F.array_position(t["plain"], h["g"]).cast("int") + 1).alias("s"), k.alias("k")))
        # neighbouring hits of one notice ask for the same start
        fresh = lambda st: F.filter(st, lambda a, k: (a["s"] >= 0) & (a["s"] + t["n"] <= x["n"]) & ((k == 0) | (F.get(st, k - 1)["s"] != a["s"])))
        best = lambda hits: F.array_max(F.transform(_let(begins(hits), fresh), lambda a: _let(inside(hits, a), share)))
        return F.struct(t["license"].alias("license"), t["n"].alias("n"), F.coalesce(_let(own(x["hits"], t), best), F.lit(0.0)).alias("dice"))

    of_windows = lambda x: F.transform(x["templates"], lambda t: windows(x, t))
    found = F.flatten(F.transform(left, lambda x: F.concat(of_segments(x), of_windows(x))))
    return F.filter(found, lambda m: m["dice"] * 100 >= threshold)


def scan(docs: DataFrame, threshold: int = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, licenses (sorted, comma-joined; empty without), best_license, best_dice (null without)."""
    df = docs.select("doc_id", matches(F.col("text"), threshold, templates).alias("m"))
    best = F.element_at(F.array_sort(F.transform("m", lambda m: F.struct((-m["dice"]).alias("d"), (-m["n"]).alias("n"), m["license"].alias("license")))), 1)
    df = df.withColumn("best", F.when(F.size("m") > 0, best))
    return df.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda m: m["license"]))), ",").alias("licenses"),
        F.col("best.license").alias("best_license"),
        F.round(-F.col("best.d"), 6).alias("best_dice"),
    )
