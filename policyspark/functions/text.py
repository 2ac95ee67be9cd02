"""Column functions on text: normalisation steps and views (in code in the reference unless marked planned)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .fence import fenced

#: What counts as alphanumeric, inside a character class.
ALNUM = r"\p{IsAlphabetic}\p{N}"
#: Texts of an Arrow batch that are strings of Python's at a time.
FEW = 64


#: Letters and marks, inside a character class, that NFKC leaves alone and that compose with nothing before them: ASCII, and of
#: Latin, Greek, Cyrillic, quotes, dashes and Han what prose in those is mostly made of.
NFKC_STABLE = (
    r"\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E"
    r"\u0388-\u038A\u038C\u038E-\u03A1\u03A3-\u03CE\u0400-\u0482\u048A-\u052F\u2013-\u2016\u2018-\u2023\u20AC\u4E00-\u9FA5"
)


def nfkc(text: Column) -> Column:
    """NFKC form.  Only texts with a character that it may change go to Python; Spark has no such function."""

    @F.arrow_udf("string")
    def normalised(texts: pa.Array) -> pa.Array:
        import unicodedata

        forms = lambda part: pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in part.to_pylist()], pa.string())
        return pa.concat_arrays([forms(texts.slice(i, FEW)) for i in range(0, max(len(texts), 1), FEW)])

    beyond = text.rlike(r"[^\x00-\x7F]") & text.rlike(f"[^{NFKC_STABLE}]")  # the second, dearer, of few texts
    return F.coalesce(normalised(F.when(beyond, text)), text)


def collapse(text: Column) -> Column:
    """Trimmed, every run of Unicode white space as one blank."""
    return F.trim(F.regexp_replace(text, r"\p{IsWhite_Space}+", " "))


def separator_tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"[^{ALNUM}]+"), lambda t: t != "")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{ALNUM}]", "")


def leet_fold(text: Column) -> Column:
    """0 to o, 1 to i, 3 to e, 4 to a, 5 to s, 7 to t."""
    return F.translate(text, "013457", "oieast")


def squeeze(text: Column) -> Column:
    """Planned in the reference: three or more of a character become two."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1")


#: Planned in the reference: Cyrillic and Greek letters that look Latin, by their look-alike.
HOMOGLYPHS = ("асеорхуіΑΒΕΗΙΚΜΝΟΡΤΧ", "aceopxyiABEHIKMNOPTX")


def homoglyph_fold(text: Column) -> Column:
    return F.translate(text, *HOMOGLYPHS)


#: Planned in the reference: characters that optical recognition takes for one another, by the form they are folded to.
OCR_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"))
OCR_SINGLES = ("0|!", "oll")


def ocr_fold(text: Column) -> Column:
    """Variants that a reader of screens confuses, folded to one form: of both sides of a comparison."""
    for a, b in OCR_PAIRS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.translate(text, *OCR_SINGLES)


#: Steps by language: English lower-cases and folds, others keep the text's case and digits.
ENGLISH = "en"


def normalized_text(text: Column, english: Column, with_nfkc: bool = True) -> Column:
    """The normalized view of a text by its language's own steps."""
    base = collapse(nfkc(text) if with_nfkc else text)
    return F.when(F.coalesce(english, F.lit(False)), F.lower(base)).otherwise(base)


def views(df: DataFrame, text: str = "text", lang: str = "lang", with_nfkc: bool = True, steps: list[Callable[[Column], Column]] | None = None) -> DataFrame:
    """Adds raw, normalized, separator_tokens, compact, leet_compact; null text gives null views.

    ``steps`` replaces the language's own normalisation steps.
    """
    df = df.withColumn("raw", F.col(text))
    english = F.coalesce(F.col(lang) == ENGLISH, F.lit(False))
    if steps is None:
        normalized = normalized_text(F.col("raw"), english, with_nfkc)
    else:
        normalized = F.col("raw")
        for step in steps:
            normalized = step(normalized)
    df = fenced(df, normalized=normalized)  # filters on what follows would repeat it
    df = df.withColumn("separator_tokens", separator_tokens(F.col("normalized"))).withColumn("compact", compact(F.col("normalized")))
    return df.withColumn("leet_compact", F.when(english, leet_fold(F.col("compact"))).otherwise(F.col("compact")))


def looks_url_like(chunk: Column) -> Column:
    """Has ``://`` or ``/``, or two or more dot-separated parts with an alphanumeric."""
    parts = F.filter(F.split(chunk, r"\."), lambda p: p.rlike(f"[{ALNUM}]"))
    return F.contains(chunk, F.lit("/")) | (F.size(parts) >= 2)


def url_token_streams(text: Column) -> Column:
    """Lower-case tokens of each URL-like chunk of a text: array of arrays."""
    trimmed = F.transform(F.split(text, r"\p{IsWhite_Space}+"), lambda c: F.regexp_replace(c, f"^[^{ALNUM}./:-]+|[^{ALNUM}./:-]+$", ""))
    bare = F.transform(F.filter(trimmed, looks_url_like), lambda c: F.when(F.contains(c, F.lit("://")), F.substr(c, F.locate("://", c) + 3)).otherwise(c))
    return F.filter(F.transform(bare, lambda c: F.transform(separator_tokens(c), F.lower)), lambda t: F.size(t) > 0)


def assemble(fragments: Column, limit: int = 4000) -> Column:
    """Fragments trimmed, joined and collapsed, cut at ``limit`` characters at the last blank; null if nothing is left."""
    parts = F.filter(F.transform(fragments, lambda f: F.trim(f)), lambda f: f.isNotNull() & (f != ""))
    text = collapse(F.array_join(parts, " "))
    head = F.left(text, F.lit(limit))
    at_blank = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(F.length(text) <= limit, text).when(F.substr(text, F.lit(limit + 1), F.lit(1)) == " ", head).when(at_blank != "", at_blank).otherwise(head)
    return F.when(text != "", cut)


def word_jaccard(a: Column, b: Column) -> Column:
    """Planned in the reference: Jaccard similarity of the texts' distinct words; null where both have none."""
    x, y = F.array_distinct(separator_tokens(F.lower(a))), F.array_distinct(separator_tokens(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union)
