"""Lexicon matching in four modes, scores, evidence and verdicts, as joins of token n-grams with the lexicon.

``lexicon`` has term_id, dictionary, phrase, category, severity, modes (array) and surfaces (array, other spellings of the
phrase, or null).  ``docs`` has doc_id, text and lang; a null text has no matches, a null lang takes the steps of no language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.fence import fenced, once
from ..functions.joins import side
from ..functions.places import SPAN, keys_placed, known as known_places, places
from ..functions.tables import local_table, stored
from ..functions.text import ALNUM, ENGLISH, compact, leet_fold, normalized_text, separator_tokens, url_token_streams, views

#: Points by severity, shares by match mode (ordinal order), by source, and exceptions.
BASE = {"high": 80, "medium": 35, "low": 15}
MODES = {"exact_phrase": "1.00", "token_sequence": "0.80", "compact": "0.75", "url_token_sequence": "1.00"}
SOURCES = {"browser_title": "1.00", "browser_url": "1.00", "accessibility_tree": "1.00", "ocr_high": "0.90", "ocr_medium": "0.70", "ocr_low": "0.40"}
EXCEPTIONS = ("education_exception", "medical_exception", "safety_exception")
EXCEPTION_POINTS, MOST_POINTS, BLOCK_AT, WARN_AT = 40, 100, 80, 50
#: Surfaces (one for each mode and language form) up to which keys are looked up within a text's row, compact ones up to which
#: each is searched for by itself, and all up to which they are broadcast, with all their columns or with key, term and mode alone
#: (166 bytes a key, 200 MB at most).  Characters of a phrase of marks that a join looks up.
INLINE, INLINE_COMPACT, BROADCAST_TERMS, BROADCAST_KEYS, SEED = 2_000, 200, 400_000, 1_200_000, 4
_HIT = "struct<kind:string,start:int,stop:int,gram:string,spelled:string,before:string,after:string,last:boolean>"


def lexicon_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (term_id, phrase, category, severity, modes) and, if wanted, dictionary and surfaces."""
    full = [(r[0], r[5] if len(r) > 5 else "core", *r[1:5], list(r[6]) if len(r) > 6 else []) for r in rows]
    return local_table(spark, full, "term_id int, dictionary string, phrase string, category string, severity string, modes array<string>, surfaces array<string>")


def lexicon_errors(lexicon: DataFrame) -> DataFrame:
    """term_id and problem of each faulty term: empty dictionary, empty phrase, no modes, empty surface, unknown mode, repeated id."""
    blank = lambda c: F.coalesce(c, F.lit("")).rlike(r"^\p{IsWhite_Space}*$")
    problem = (
        F.when(blank(F.col("dictionary")), "empty_dictionary").when(blank(F.col("phrase")), "empty_phrase").when(F.size("modes") == 0, "no_modes")
        .when(F.exists(F.coalesce("surfaces", F.array().cast("array<string>")), blank), "empty_surface").when(~F.forall("modes", lambda m: m.isin(*MODES)), "unknown_mode")
    )
    twice = lexicon.groupBy("term_id").count().where("count > 1").select("term_id", F.lit("repeated_id").alias("problem"))
    return lexicon.select("term_id", problem.alias("problem")).where("problem is not null").unionAll(twice)


def patterns(lexicon: DataFrame, with_nfkc: bool = True) -> DataFrame:
    """The distinct surfaces of each term and mode, in the form for English texts and in the one for others.

    term_id, mode, form, surface (normalised, of compact mode folded), kind (what it is looked up among: tokens, url tokens,
    compact text or, without letters and digits, marks), key (its tokens, else the surface), n (tokens), first (the first of
    them), and of an exact phrase lead, core and trail: what stands before its first token, between and behind its last.
    """
    spellings = F.array_distinct(F.concat(F.array("phrase"), F.coalesce("surfaces", F.array().cast("array<string>"))))
    t = lexicon.select("term_id", F.explode(F.array_distinct("modes")).alias("mode"), spellings.alias("s")).select("term_id", "mode", F.explode("s").alias("spelling"))
    t = views(t.withColumn("form", F.explode(F.array(F.lit(ENGLISH), F.lit("")))), "spelling", "form", with_nfkc).withColumn("n", F.size("separator_tokens"))
    kind = F.when(F.col("mode") == "compact", "c").when(F.col("mode") == "url_token_sequence", "u").when(F.col("n") > 0, "t").when(F.col("mode") == "exact_phrase", "m")
    surface = F.when(F.col("mode") == "compact", F.col("leet_compact")).otherwise(F.col("normalized"))
    edge = lambda rx: F.regexp_extract("normalized", rx, 0)
    t = t.select("term_id", "mode", "form", surface.alias("surface"), kind.alias("kind"), "n", F.get("separator_tokens", F.lit(0)).alias("first"), F.array_join("separator_tokens", "\x00").alias("key"), edge(f"^[^{ALNUM}]*").alias("lead"), edge(rf"[^{ALNUM}]*\z").alias("trail"), F.regexp_replace("normalized", rf"^[^{ALNUM}]+|[^{ALNUM}]+\z", "").alias("core"))
    t = t.where("surface <> '' and kind is not null and (kind <> 'u' or (n > 0 and form = 'en'))")
    return t.withColumn("key", F.when(F.col("kind").isin("c", "m"), F.col("surface")).otherwise(F.col("key"))).distinct()


def _hits(kind: str, spans: Column, spelled=None, before=None, after=None, last=None) -> Column:
    """Hits of an array of (start, stop, gram); the others are functions of one of them."""
    text = lambda f, g: F.lit(None).cast("string") if f is None else f(g)
    hit = lambda g: F.struct(F.lit(kind).alias("kind"), g["start"].cast("int").alias("start"), g["stop"].cast("int").alias("stop"), g["gram"].alias("gram"), text(spelled, g).alias("spelled"), text(before, g).alias("before"), text(after, g).alias("after"), (F.lit(None).cast("boolean") if last is None else last(g)).alias("last"))
    return F.transform(spans, hit)


def _ngrams(tokens: Column, known: dict[int, list[str]], firsts: list[str] | None) -> Column:
    """array of (start, stop, gram) of the wanted lengths; where ``firsts`` are given, only of the keys in ``known``."""
    if firsts is None:
        places = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: i < F.size(tokens))
    else:  # the places of the few tokens that a key begins with, found once for all lengths
        begins = F.transform(tokens, lambda t, i: F.when(t.isin(firsts), i).otherwise(-1))
        places = F.filter(begins, lambda i: i >= 0)

    def one(at: Column, n: int, keys: list[str]) -> Column:
        if n == 1 and firsts is not None:
            grams = F.transform(at, lambda i: F.struct(i.alias("start"), (i + 1).alias("stop"), F.get(tokens, i).alias("gram")))
        else:
            grams = F.transform(F.filter(at, lambda i: i + n <= F.size(tokens)), lambda i: F.struct(i.alias("start"), (i + n).alias("stop"), F.array_join(F.slice(tokens, i + 1, n), "\x00").alias("gram")))
        return grams if firsts is None else F.filter(grams, lambda g: g["gram"].isin(keys))

    return once(places, lambda at: F.flatten(F.array(*[one(at, n, keys) for n, keys in sorted(known.items())])))


def _places(text: str, zero_width: str, surface: str) -> Column:
    """(start, stop, gram) of a surface where the zero-width pattern fits in column ``text``; matches may overlap."""
    pieces = F.split(F.concat(F.lit("\x00"), F.col(text)), zero_width)
    starts = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda _, i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(-1), lambda a, x: a + F.length(x)))
    found = F.transform(starts, lambda i: F.struct(i.alias("start"), (i + len(surface)).alias("stop"), F.lit(surface).alias("gram")))
    return F.when(F.contains(F.col(text), F.lit(surface)), found).otherwise(F.array().cast(SPAN))


def _seeded_terms(terms: DataFrame, kind: str) -> tuple[DataFrame, list[int], int]:
    """(terms of a kind keyed by their first SEED characters, the lengths of such keys, the longest surface)"""
    terms = terms.withColumn("key", F.when(F.col("kind") == kind, F.left("surface", F.lit(SEED))).otherwise(F.col("key")))
    r = terms.where(F.col("kind") == kind).agg(F.collect_set(F.length("key")).alias("sizes"), F.max(F.length("surface")).alias("longest")).first()
    return terms, sorted(r.sizes), r.longest


def matches(docs: DataFrame, lexicon: DataFrame, with_nfkc: bool = True) -> DataFrame:
    """doc_id, term_id, mode, surface, start, stop, one row a distinct match.

    Offsets count tokens, in compact mode and for phrases without a letter or digit characters of the text's own view; those of
    other exact phrases are their tokens' (marks around them belong to the phrase but have no token).  A surface takes the
    language steps of the text it is matched with; tokens in URLs are lower-case in all languages.

    The texts' views are worked out once.  Keys of a small lexicon are looked up within the row, so that only hits become rows;
    of a large one only the places become rows at which a bitmap of its keys may hold what stands there (functions.places), of URLs
    all n-grams of its lengths, and for phrases of marks alone the SEED characters from each on.
    """
    terms = patterns(lexicon, with_nfkc)
    rows = terms.limit(INLINE + 1).collect()
    inline = len(rows) <= INLINE
    if inline:  # a small lexicon is worked out once
        terms = local_table(docs.sparkSession, rows, terms.schema)
        sizes = [(*k, c) for k, c in Counter((r.kind, r.n, r["mode"] == "exact_phrase") for r in rows).items()]
    else:
        terms = stored(terms)
        sizes = [tuple(r) for r in terms.groupBy("kind", "n", (F.col("mode") == "exact_phrase").alias("exact")).count().collect()]  # a few rows a length
    n_terms = sum(c for *_, c in sizes)
    lengths = {k: sorted({n for kind, n, *_ in sizes if kind == k}) for k in {kind for kind, *_ in sizes}}
    n_tokens, n_compact, n_marks = (sum(c for kind, *_, c in sizes if kind == k) for k in "tcm")
    known = rows if inline else []

    def wanted(kind: str) -> tuple[dict[int, list[str]], list[str] | None]:
        own = [r for r in known if r.kind == kind]
        return {n: sorted({r.key for r in own if r.n == n}) for n in lengths[kind]}, sorted({r["first"] for r in own}) if inline else None

    def shared(kind: str, n: int, edge: str = ""):
        return docs.sparkSession.sparkContext.broadcast(known_places(terms.where(F.col("kind") == kind).select("key"), n, edge))

    english = F.col("own") == ENGLISH
    base = docs.select("doc_id", F.col("text").alias("raw"), F.when(F.col("lang") == ENGLISH, ENGLISH).otherwise("").alias("own"))
    base = fenced(base, normalized=normalized_text(F.col("raw"), english, with_nfkc))
    parts: dict[str, Column] = {}
    hits: list[Column] = []
    if "t" in lengths:
        tokens, grams = F.col("tokens"), F.col("grams")
        base = fenced(base, tokens=separator_tokens(F.col("normalized")))
        base = fenced(base, grams=_ngrams(tokens, *wanted("t")) if inline else places(F.array_join(tokens, "\x00"), shared("t", n_tokens, "\x00"), "\x00"))
    if "t" in lengths and not any(kind == "t" and exact for kind, _, exact, _ in sizes):
        hits.append(_hits("t", grams))
    elif "t" in lengths:
        # each token with what stands before it, and what stands behind the last; only of texts with a candidate
        parts["pieces"] = F.when(F.size("grams") > 0, F.regexp_extract_all("normalized", F.lit(f"[^{ALNUM}]*[{ALNUM}]+|[^{ALNUM}]+$"), F.lit(0)))
        apart = lambda i: F.coalesce(F.regexp_extract(F.get(F.col("pieces"), i), f"^[^{ALNUM}]*", 0), F.lit(""))
        spelled = lambda g: F.regexp_replace(F.array_join(F.slice("pieces", g["start"] + 1, g["stop"] - g["start"]), ""), f"^[^{ALNUM}]+", "")
        hits.append(_hits("t", grams, spelled, lambda g: apart(g["start"]), lambda g: apart(g["stop"]), lambda g: g["stop"] == F.size(tokens)))
    if n_marks and not inline:
        # phrases of marks alone, by their first characters from each place that no letter or digit stands before
        terms, sizes_m, longest_m = _seeded_terms(terms, "m")
        parts["marks"] = F.split("normalized", "")
        mark = lambda i, n: F.array_join(F.slice("marks", i + 1, n), "")
        free = lambda i: ~F.get("marks", i).rlike(f"[{ALNUM}]") & ((i == 0) | ~F.get("marks", i - 1).rlike(f"[{ALNUM}]"))
        open_ = F.filter(F.sequence(F.lit(0), F.size("marks") - 1), free)
        begun = lambda n: lambda i: F.struct(i.alias("start"), i.alias("stop"), mark(i, n).alias("gram"))
        hits.append(_hits("m", F.concat(*[F.transform(open_, begun(n)) for n in sizes_m]), lambda g: mark(g["start"], longest_m + 1)))
    for x in sorted({r.key for r in known if r.kind == "m"}):
        hits.append(_hits("m", _places("normalized", rf"(?<![{ALNUM}])(?=\Q{x}\E(?![{ALNUM}]))", x)))
    if "u" in lengths:
        parts["streams"] = url_token_streams(F.col("raw"))
        hits.append(_hits("u", F.flatten(F.transform("streams", lambda t: _ngrams(t, *wanted("u"))))))
    if "c" in lengths:
        bare = compact(F.col("normalized"))
        parts["leet"] = F.when(english, leet_fold(bare)).otherwise(bare)
        if inline and n_compact <= INLINE_COMPACT:
            hits += [_hits("c", _places("leet", f"(?={x})", x)) for x in sorted({r.key for r in known if r.kind == "c"})]
        else:
            parts["bare"] = places(F.col("leet"), shared("c", n_compact))
            hits.append(_hits("c", F.col("bare")))
    if not hits:
        return base.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("term_id", "int"), ("mode", "string"), ("surface", "string"), ("start", "int"), ("stop", "int"))]).limit(0)
    if "leet" in parts and "bare" in parts:
        base = fenced(base, leet=parts.pop("leet"))
    h = fenced(base, **parts) if parts else base
    h = h.select("doc_id", "own", F.explode(F.concat(*hits)).alias("h")).select("doc_id", F.when(F.col("h.kind") == "u", ENGLISH).otherwise(F.col("own")).alias("form"), "h.*").withColumnRenamed("gram", "key")
    j = h.join(F.broadcast(terms) if n_terms <= BROADCAST_TERMS else terms.hint("merge"), ["kind", "form", "key"])
    # an exact phrase's own outer marks, with no letter or digit right beside them
    led = (F.col("lead") == "") | (F.endswith("before", F.col("lead")) & ((F.col("start") == 0) | (F.length("before") > F.length("lead"))))
    trailed = (F.col("trail") == "") | (F.startswith("after", F.col("trail")) & (F.col("last") | (F.length("after") > F.length("trail"))))
    phrase = (F.col("mode") != "exact_phrase") | (F.col("kind") == "m") | ((F.col("spelled") == F.col("core")) & led & trailed)
    seeded = ~F.col("kind").isin("c", "m") | F.col("spelled").isNull() | F.startswith("spelled", F.col("surface"))
    ends = (F.col("kind") != "m") | F.col("spelled").isNull() | ~F.substr("spelled", F.length("surface") + 1, F.lit(1)).rlike(f"[{ALNUM}]")
    stop = F.when(F.col("kind").isin("c", "m"), F.col("start") + F.length("surface")).otherwise(F.col("stop"))
    return j.where(phrase & seeded & ends).select("doc_id", "term_id", "mode", "surface", "start", stop.alias("stop")).distinct()


def matched_terms(docs: DataFrame, lexicon: DataFrame, with_nfkc: bool = True) -> DataFrame:
    """doc_id, term_id, mode of :func:`matches`, each once.

    Of a large lexicon whose terms' keys decide by themselves (tokens but no exact phrases, and compact ones), a key becomes one
    row of a text however often it stands there, and no places are kept.
    """
    terms = patterns(lexicon, with_nfkc)
    if terms.limit(INLINE + 1).count() <= INLINE:
        return matches(docs, lexicon, with_nfkc).select("doc_id", "term_id", "mode").distinct()
    terms = stored(terms)
    counts = {r.kind: r for r in terms.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("mode") == "exact_phrase").alias("exact")).collect()}  # a row a kind
    if not set(counts) <= {"t", "c"} or ("t" in counts and counts["t"].exact):
        return matches(docs, lexicon, with_nfkc).select("doc_id", "term_id", "mode").distinct()
    own = F.when(F.col("lang") == ENGLISH, ENGLISH).otherwise("").alias("form")
    base = fenced(docs.select("doc_id", "text", own), normalized=normalized_text(F.col("text"), F.col("form") == ENGLISH, with_nfkc))
    base = fenced(base, bare=compact(F.col("normalized")))
    looked = {"t": (F.array_join(separator_tokens(F.col("normalized")), "\x00"), "\x00"), "c": (F.when(F.col("form") == ENGLISH, leet_fold(F.col("bare"))).otherwise(F.col("bare")), "")}
    share = lambda k: docs.sparkSession.sparkContext.broadcast(known_places(terms.where(F.col("kind") == k).select("key"), counts[k].n, looked[k][1]))
    found = keys_placed(base.select("doc_id", "form", *[looked[k][0].alias(k) for k in counts]), {k: (share(k), looked[k][1]) for k in counts})
    tagged = F.concat("kind", "form", F.lit(" "), "key").alias("key")
    t = terms.select(tagged, "term_id", "mode")
    few = sum(r.n for r in counts.values()) <= BROADCAST_KEYS
    j = found.select("doc_id", tagged).join(F.broadcast(t) if few else t.hint("merge"), "key").select("doc_id", "term_id", "mode")
    # where no term has two keys and no document two rows, none comes twice, and so many rows needn't be shuffled to find that out
    twice = lambda df, *key: df.groupBy(*key).count().where("count > 1").limit(1).count() > 0
    return j.distinct() if twice(terms, "term_id", "mode", "form") or twice(docs, "doc_id") else j


def term_hits(found: DataFrame, spans: bool = False) -> DataFrame:
    """Per doc_id and term_id: best mode (greatest share, then first) and occurrences (most of any one mode); span, if wanted: start
    and stop of the best mode's first match."""
    share = F.create_map(*[F.lit(x) for m, s in MODES.items() for x in (m, float(s))])
    order = F.create_map(*[F.lit(x) for i, m in enumerate(MODES) for x in (m, -i)])
    rank = F.struct(share[F.col("mode")], order[F.col("mode")])
    by_mode = found.groupBy("doc_id", "term_id", "mode").agg(F.count("*").alias("n"), *([F.min(F.struct("start", "stop")).alias("span")] if spans else []))
    return by_mode.groupBy("doc_id", "term_id").agg(F.max_by("mode", rank).alias("best_mode"), F.max("n").alias("occurrences"), *([F.max_by("span", rank).alias("span")] if spans else []))


def evidence(found: DataFrame, lexicon: DataFrame, source_multiplier: str = "1.00") -> DataFrame:
    """Per document and term with hits that is no exception: what the score rests on.

    doc_id, term_id, rule_id (dictionary:phrase), category, severity, best_mode, start and stop (of the best mode's first match),
    base, multiplier (of mode and source), occurrences.
    """
    base = F.create_map(*[F.lit(x) for k, v in BASE.items() for x in (k, v)])
    share = F.create_map(*[F.lit(x) for k, v in MODES.items() for x in (F.lit(k), F.lit(v).cast("decimal(3,2)"))])
    hits = term_hits(found, spans=True)
    known = hits.join(_broadcast_terms(lexicon.select("term_id", F.concat_ws(":", "dictionary", "phrase").alias("rule_id"), "category", "severity")), "term_id").where(~F.col("category").isin(*EXCEPTIONS))
    return known.select("doc_id", "term_id", "rule_id", "category", "severity", "best_mode", "span.start", "span.stop", base[F.col("severity")].alias("base"), (share[F.col("best_mode")] * F.lit(source_multiplier).cast("decimal(3,2)")).alias("multiplier"), "occurrences")


def evidence_lists(found: DataFrame, lexicon: DataFrame, source_multiplier: str = "1.00") -> DataFrame:
    """Per document with evidence: doc_id and evidence, an array of :func:`evidence` in the order in which the terms are first seen.

    Matches are listed by term, mode and place (see :func:`ordered`), so that is the order of terms.
    """
    e = evidence(found, lexicon, source_multiplier)
    own = F.struct(*[c for c in e.columns if c != "doc_id"])  # begins with term_id, one a document
    return e.groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("evidence"))


def _broadcast_terms(terms: DataFrame) -> DataFrame:
    return side(terms, BROADCAST_TERMS)


def scores(hits: DataFrame, lexicon: DataFrame, source_multiplier: str = "1.00") -> DataFrame:
    """Per document with hits: score (0 to 100), dominant_category, and n_terms that are evidence (exceptions only lower the score)."""
    base = F.create_map(*[F.lit(x) for k, v in BASE.items() for x in (k, v)])
    share = F.create_map(*[F.lit(x) for k, v in MODES.items() for x in (F.lit(k), F.lit(v).cast("decimal(3,2)"))])
    known = hits.join(_broadcast_terms(lexicon.select("term_id", "category", "severity")), "term_id")
    exception = F.col("category").isin(*EXCEPTIONS)
    points = F.when(exception, F.lit(0)).otherwise(base[F.col("severity")] * share[F.col("best_mode")] * F.lit(source_multiplier).cast("decimal(3,2)") * F.col("occurrences"))
    known = known.withColumn("points", points.cast("decimal(18,4)")).withColumn("less", F.when(exception, EXCEPTION_POINTS * F.col("occurrences")).otherwise(0))
    by_category = known.groupBy("doc_id", "category").agg(F.sum("points").alias("points"), F.sum("less").alias("less"), F.count_if(~exception).alias("terms"))
    raw = F.sum("points") - F.sum("less")
    return by_category.groupBy("doc_id").agg(
        F.least(F.lit(MOST_POINTS), F.round(F.greatest(raw, F.lit(0)), 0)).cast("int").alias("score"),
        F.max_by(F.when(F.col("points") > 0, F.col("category")), F.struct("points", "category")).alias("dominant_category"),
        F.sum("terms").alias("n_terms"),
    )


def action(score: Column, block_at: int = BLOCK_AT, warn_at: int = WARN_AT) -> Column:
    return F.when(score >= block_at, "block").when(score >= warn_at, "warn").otherwise("allow")


def verdicts(docs: DataFrame, lexicon: DataFrame, with_nfkc: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, score, action, dominant_category, n_terms."""
    scored = scores(term_hits(matches(docs, lexicon, with_nfkc)), lexicon)
    score = F.coalesce("score", F.lit(0))
    return docs.select("doc_id").join(scored.hint("merge"), "doc_id", "left").select("doc_id", score.alias("score"), action(score).alias("action"), "dominant_category", F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"))


def with_model(done: DataFrame, texts: DataFrame, model: Callable[[Column], Column], block_above: float) -> DataFrame:
    """Verdicts with a model asked for the warn band only: ``model`` maps text to a probability (a pandas UDF, say).

    The reference accepts such a hook and never calls it; here it is off unless this function is used.
    """
    band = done.where("action = 'warn'").join(texts.select("doc_id", "text").hint("merge"), "doc_id").withColumn("p", model(F.col("text")))
    harder = band.where(F.col("p") >= block_above).select("doc_id").distinct().withColumn("harder", F.lit(True))
    return done.join(harder.hint("merge"), "doc_id", "left").withColumn("action", F.when(F.col("harder"), "block").otherwise(F.col("action"))).drop("harder")


def amplified(found: DataFrame, lexicon: DataFrame, span: int, points: int = 15) -> DataFrame:
    """Planned in the reference: per document and category, ``points`` once where two matches start within ``span`` tokens."""
    m = found.where("mode <> 'compact'").join(_broadcast_terms(lexicon.select("term_id", "category")), "term_id").select("doc_id", "category", "start").distinct()
    gap = F.col("start") - F.lag("start").over(Window.partitionBy("doc_id", "category").orderBy("start"))
    return m.withColumn("gap", gap).groupBy("doc_id", "category").agg(F.min("gap").alias("gap")).select("doc_id", "category", F.when(F.col("gap") <= span, points).otherwise(0).alias("points"))


#: Planned in the reference: points for a matching image, a category that the user calls high-risk, and a risky app or site.
IMAGE_POINTS, HIGH_RISK_POINTS, CONTEXT_POINTS = 20, 20, 10


def amplifiers(found: DataFrame, lexicon: DataFrame, span: int, images: DataFrame, high_risk: DataFrame, risky: DataFrame) -> DataFrame:
    """Planned in the reference: all context amplifiers of each document and category with a match that isn't compact.

    ``images``: doc_id, category of what a scanner saw beside the text; ``high_risk``: category; ``risky``: doc_id seen in a known
    risky app or site.  Columns: doc_id, category, repeated, image, configured, context, points (their sum).
    """
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    own = amplified(found, lexicon, span).withColumnRenamed("points", "repeated")
    j = own.join(flag(images.select("doc_id", "category"), "seen").hint("merge"), ["doc_id", "category"], "left")
    j = j.join(side(flag(high_risk.select("category"), "high")), "category", "left").join(flag(risky.select("doc_id"), "risky").hint("merge"), "doc_id", "left")
    points = {"repeated": F.col("repeated"), "image": F.when(F.col("seen"), IMAGE_POINTS).otherwise(0), "configured": F.when(F.col("high"), HIGH_RISK_POINTS).otherwise(0), "context": F.when(F.col("risky"), CONTEXT_POINTS).otherwise(0)}
    return j.select("doc_id", "category", *[c.alias(n) for n, c in points.items()], reduce(Column.__add__, points.values()).alias("points"))


def worst(items: DataFrame) -> DataFrame:
    """Per item of several scanners' rows (item, action): the worst action, block before warn before allow."""
    rank = F.create_map(F.lit("block"), F.lit(2), F.lit("warn"), F.lit(1), F.lit("allow"), F.lit(0))
    return items.groupBy("item").agg(F.max_by("action", rank[F.col("action")]).alias("action"))


def ordered(found: DataFrame, partitions: int) -> DataFrame:
    """Matches by document, term, mode (in its order), start and stop, over range partitions."""
    at = F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col("mode"))
    return found.withColumn("at", at).repartitionByRange(partitions, "doc_id", "term_id").sortWithinPartitions("doc_id", "term_id", "at", "start", "stop", "surface").drop("at")
