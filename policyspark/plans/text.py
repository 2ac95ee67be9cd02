"""Queries on text, with SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as fx
from ..operators import text_policy as tp
from .tables import local_table, stored, table

#: Terms that the test documents hold: id, phrase, category, severity, modes, dictionary, other surfaces.
LEXICON = [
    (1, "idiot", "insult", "high", ["exact_phrase", "token_sequence", "compact"]),
    (2, "moron", "insult", "medium", ["token_sequence", "compact"]),
    (3, "of the", "prose", "low", ["exact_phrase", "token_sequence"]),
    (4, "pathetic", "insult", "medium", ["exact_phrase", "compact"]),
    (5, "clown", "mockery", "low", ["exact_phrase"]),
    (6, "and the", "medical_exception", "low", ["exact_phrase", "token_sequence"]),
    (7, "disgusting", "mockery", "high", ["compact"]),
    (8, "der", "prose", "low", ["exact_phrase", "token_sequence"], "german", ["und", "Und"]),
    (9, "que", "prose", "medium", ["token_sequence"], "spanish", ["de la"]),
    (10, "les", "safety_exception", "low", ["token_sequence", "exact_phrase"], "french"),
]
URL_LEXICON = [(1, "example com", "site", "high", ["url_token_sequence"]), (2, "page 2", "paging", "low", ["url_token_sequence"]), (3, "spam farm", "spam", "medium", ["url_token_sequence"])]
_W = r"[\p{L}\p{N}]"


def text_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.verdicts(table(spark, sf_dir, "documents"), tp.lexicon_table(spark, LEXICON))


def text_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.term_hits(tp.matches(table(spark, sf_dir, "documents"), tp.lexicon_table(spark, LEXICON)))


def text_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = tp.lexicon_table(spark, LEXICON)
    e = tp.evidence(tp.matches(table(spark, sf_dir, "documents"), lexicon), lexicon)
    return e.withColumn("multiplier", F.col("multiplier").cast("double"))


def text_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_verdicts(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"), F.sum("score").alias("points"))


def text_model_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with a model asked in the warn band; its probability here is the text's length modulo 100, in per cent."""
    docs = table(spark, sf_dir, "documents")
    return tp.with_model(text_verdicts(spark, sf_dir), docs, lambda t: F.length(t) % 100 / 100, 0.5).select("doc_id", "action")


def text_custom_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.views(table(spark, sf_dir, "documents"), steps=[fx.collapse, F.lower, fx.leet_fold])
    return v.select("doc_id", F.md5("normalized").alias("normalized"), F.size("separator_tokens").cast("long").alias("n_tokens"))


CUSTOM_SQL = rf"""WITH n AS (SELECT doc_id, translate(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '013457', 'oieast') AS t FROM documents)
SELECT doc_id, md5(t) AS normalized, len(regexp_extract_all(t, '{_W}+'))::BIGINT AS n_tokens FROM n"""


def text_amplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = tp.lexicon_table(spark, LEXICON)
    return tp.amplified(tp.matches(table(spark, sf_dir, "documents"), lexicon), lexicon, 4)


def lexicon_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a lexicon of one term a document: its first word, in the dictionary of its source."""
    d = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 997).cast("int").alias("term_id"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).otherwise(" ").alias("dictionary"), F.substring_index("text", " ", 1).alias("phrase"), F.lit("c").alias("category"), F.lit("low").alias("severity"),
        F.expr("case doc_id % 7 when 0 then cast(array() as array<string>) when 1 then array('compact', 'odd') else array('compact') end").alias("modes"), F.expr("case when doc_id % 11 = 0 then array('x', '') end").alias("surfaces"),
    )
    return tp.lexicon_errors(d).groupBy("problem").agg(F.count("*").alias("n"))


LEXICON_PROBLEMS_SQL = """WITH d AS (SELECT doc_id % 997 AS term_id, doc_id % 5 > 0 AND regexp_matches(source, '\\S') AS named, regexp_matches(split_part(text, ' ', 1), '\\S') AS worded, doc_id % 7 AS m, doc_id % 11 = 0 AS hollow FROM documents),
p AS (SELECT CASE WHEN named IS NOT TRUE THEN 'empty_dictionary' WHEN worded IS NOT TRUE THEN 'empty_phrase' WHEN m = 0 THEN 'no_modes' WHEN hollow THEN 'empty_surface' WHEN m = 1 THEN 'unknown_mode' END AS problem FROM d
  UNION ALL SELECT 'repeated_id' FROM d GROUP BY term_id HAVING count(*) > 1)
SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY problem"""


def _terms() -> list[tuple]:
    return [(r[0], r[5] if len(r) > 5 else "core", *r[1:5], r[6] if len(r) > 6 else []) for r in LEXICON]


def _modes_values() -> str:
    return ", ".join(f"({i}, '{d}:{p}', '{x}', '{c}', '{s}', '{m}')" for i, d, p, c, s, modes, more in _terms() for m in modes for x in [p, *more])


_HITS = rf"""
WITH doc AS (
  SELECT doc_id, lang, CASE WHEN lang = 'en' THEN lower(b) ELSE b END AS t FROM (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b FROM documents)
), tok AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_W}+') AS w, regexp_extract_all(t, '[^\p{{L}}\p{{N}}]*{_W}+') AS p,
         CASE WHEN lang = 'en' THEN translate(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g'), '013457', 'oieast') ELSE regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g') END AS c, lang FROM doc
), lex0(term_id, rule_id, surface, category, severity, mode) AS (VALUES {_modes_values()}
), lex AS (
  SELECT DISTINCT en, term_id, rule_id, CASE WHEN en THEN lower(surface) ELSE surface END AS phrase, category, severity, mode FROM lex0, (VALUES (true), (false)) v(en)
), lexn AS (
  SELECT *, string_split(phrase, ' ') AS ws, len(string_split(phrase, ' ')) AS n FROM lex
), pos AS (
  SELECT doc_id, lang = 'en' AS en, w, p, unnest(range(1, len(w) + 1)) AS i FROM tok
), seq AS (
  SELECT doc_id, term_id, mode, i - 1 AS start, i - 1 + n AS stop, category FROM pos JOIN lexn ON pos.en = lexn.en AND w[i] = ws[1] AND (n = 1 OR w[i + 1] = ws[2])
  WHERE mode IN ('token_sequence', 'exact_phrase') AND (mode = 'token_sequence' OR n = 1 OR p[i + 1] = ' ' || ws[2])
), counted AS (
  SELECT doc_id, term_id, mode, count(*) AS n, min((start, stop)) AS span FROM seq GROUP BY ALL
  UNION ALL
  SELECT doc_id, term_id, mode, (length(c) - length(replace(c, phrase, ''))) // length(phrase) AS n, (strpos(c, phrase) - 1, strpos(c, phrase) - 1 + length(phrase)) AS span
  FROM tok JOIN lexn ON (lang = 'en') = en WHERE mode = 'compact' AND contains(c, phrase)
), hits AS (
  SELECT doc_id, term_id, first(mode ORDER BY CASE mode WHEN 'exact_phrase' THEN 1 WHEN 'token_sequence' THEN 2 ELSE 3 END) AS best_mode, max(n)::BIGINT AS occurrences,
         first(span ORDER BY CASE mode WHEN 'exact_phrase' THEN 1 WHEN 'token_sequence' THEN 2 ELSE 3 END) AS span FROM counted GROUP BY ALL
)"""
HITS_SQL = _HITS + "\nSELECT doc_id, term_id, best_mode, occurrences FROM hits"
_SHARE = "CASE best_mode WHEN 'exact_phrase' THEN 1.00 WHEN 'token_sequence' THEN 0.80 ELSE 0.75 END"
_BASE = "CASE severity WHEN 'high' THEN 80 WHEN 'medium' THEN 35 ELSE 15 END"
EVIDENCE_SQL = _HITS + f"""
SELECT doc_id, term_id, rule_id, category, severity, best_mode, span[1]::INTEGER AS start, span[2]::INTEGER AS stop, {_BASE} AS base, ({_SHARE})::DOUBLE AS multiplier, occurrences
FROM hits JOIN (SELECT DISTINCT term_id, rule_id, category, severity FROM lex) l USING (term_id) WHERE category NOT LIKE '%_exception'"""
AMPLIFIED_SQL = _HITS + """, m AS (SELECT DISTINCT doc_id, category, start FROM seq), g AS (SELECT doc_id, category, start - lag(start) OVER (PARTITION BY doc_id, category ORDER BY start) AS gap FROM m)
SELECT doc_id, category, CASE WHEN min(gap) <= 4 THEN 15 ELSE 0 END AS points FROM g GROUP BY doc_id, category"""
_VERDICTS = (
    _HITS
    + rf""", pts AS (
  SELECT h.*, l.category, CASE WHEN l.category LIKE '%_exception' THEN 0.0::DECIMAL(18,4) ELSE ({_BASE} * ({_SHARE})::DECIMAL(18,4) * occurrences)::DECIMAL(18,4) END AS points,
    CASE WHEN l.category LIKE '%_exception' THEN 40 * occurrences ELSE 0 END AS less, CASE WHEN l.category LIKE '%_exception' THEN 0 ELSE 1 END AS one
  FROM hits h JOIN (SELECT DISTINCT term_id, category, severity FROM lex) l USING (term_id)
), cat AS (
  SELECT doc_id, category, sum(points) AS points, sum(less) AS less, sum(one) AS terms FROM pts GROUP BY ALL
), s AS (
  SELECT doc_id, least(100, floor(greatest(sum(points) - sum(less), 0) + 0.5))::INTEGER AS score,
         first(category ORDER BY points DESC, category DESC) FILTER (points > 0) AS dominant_category, sum(terms)::BIGINT AS n_terms FROM cat GROUP BY doc_id
), v AS (
  SELECT d.doc_id, coalesce(score, 0) AS score, CASE WHEN coalesce(score, 0) >= 80 THEN 'block' WHEN coalesce(score, 0) >= 50 THEN 'warn' ELSE 'allow' END AS action,
         dominant_category, coalesce(n_terms, 0)::BIGINT AS n_terms FROM doc d LEFT JOIN s USING (doc_id)
)"""
)
VERDICTS_SQL = _VERDICTS + "\nSELECT * FROM v"
MODEL_SQL = _VERDICTS + "\nSELECT doc_id, CASE WHEN action = 'warn' AND length(text) % 100 >= 50 THEN 'block' ELSE action END AS action FROM v JOIN documents USING (doc_id)"
ACTIONS_SQL = _VERDICTS + "\nSELECT action, count(*) AS n, sum(score)::BIGINT AS points FROM v GROUP BY action"


def text_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.views(table(spark, sf_dir, "documents"))
    return v.select("doc_id", F.md5("normalized").alias("normalized"), F.size("separator_tokens").cast("long").alias("n_tokens"), F.md5("compact").alias("compact"), F.md5("leet_compact").alias("leet"))


VIEWS_SQL = rf"""
WITH v AS (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b FROM documents),
n AS (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN lower(b) ELSE b END AS t FROM v),
c AS (SELECT doc_id, lang, t, regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g') AS c FROM n)
SELECT doc_id, md5(t) AS normalized, len(regexp_extract_all(t, '{_W}+'))::BIGINT AS n_tokens, md5(c) AS compact,
       md5(CASE WHEN lang = 'en' THEN translate(c, '013457', 'oieast') ELSE c END) AS leet FROM c
"""


def url_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"), F.lit("en").alias("lang"))
    return tp.matches(pages, tp.lexicon_table(spark, URL_LEXICON)).select(F.col("doc_id").alias("page_id"), "term_id", "start", "stop")


URL_HITS_SQL = rf"""
WITH p AS (SELECT page_id, regexp_extract_all(lower(split_part(url, '://', 2)), '{_W}+') AS w FROM pages),
lex(term_id, a, b) AS (VALUES (1, 'example', 'com'), (2, 'page', '2'), (3, 'spam', 'farm')),
pos AS (SELECT page_id, w, unnest(range(1, len(w))) AS i FROM p)
SELECT page_id, term_id, (i - 1)::INTEGER AS start, (i + 1)::INTEGER AS stop FROM pos JOIN lex ON w[i] = a AND w[i + 1] = b
"""


def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    j = c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(fx.word_jaccard(F.col("text"), F.col("before")), 6).alias("jaccard"))
    return j.withColumn("same", F.col("jaccard") >= 0.8)


TURN_SIMILARITY_SQL = rf"""
WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '{_W}+')) AS w FROM conversations),
j AS (SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS x, len(b.w) AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
SELECT conv_id, turn, round(i / (x + y - i), 6) AS jaccard, round(i / (x + y - i), 6) >= 0.8 AS same FROM j
"""


def assembled_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    a = c.select("conv_id", fx.assemble(F.col("t.text")).alias("text"))
    return a.select("conv_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


ASSEMBLED_SQL = r"""
WITH a AS (SELECT conv_id, trim(regexp_replace(string_agg(trim(text), ' ' ORDER BY turn), '\s+', ' ', 'g')) AS t FROM conversations WHERE trim(text) <> '' GROUP BY conv_id),
c AS (SELECT conv_id, CASE WHEN length(t) <= 4000 THEN t WHEN substr(t, 4001, 1) = ' ' THEN left(t, 4000)
  WHEN regexp_extract(left(t, 4000), '(?s)^(.*) ', 1) <> '' THEN regexp_extract(left(t, 4000), '(?s)^(.*) ', 1) ELSE left(t, 4000) END AS t FROM a)
SELECT conv_id, length(t)::BIGINT AS n, md5(t) AS digest FROM c
"""

def text_evidence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's evidence as one list, in the order in which its terms are first seen."""
    lexicon = tp.lexicon_table(spark, LEXICON)
    e = tp.evidence_lists(tp.matches(table(spark, sf_dir, "documents"), lexicon), lexicon)
    one = lambda x: F.concat_ws("|", x["rule_id"], x["best_mode"], x["start"].cast("string"), x["occurrences"].cast("string"))
    return e.select("doc_id", F.array_join(F.transform("evidence", one), ";").alias("evidence"))


EVIDENCE_LISTS_SQL = _HITS + """
SELECT doc_id, string_agg(concat_ws('|', rule_id, best_mode, span[1], occurrences), ';' ORDER BY term_id) AS evidence
FROM hits JOIN (SELECT DISTINCT term_id, rule_id, category FROM lex) l USING (term_id) WHERE category NOT LIKE '%_exception' GROUP BY doc_id"""


def ordered_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches in order, with each one's place in its document's list."""
    found = tp.ordered(tp.matches(table(spark, sf_dir, "documents"), tp.lexicon_table(spark, LEXICON)), 8)
    at = F.array_position(F.array(*[F.lit(m) for m in tp.MODES]), F.col("mode"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("term_id", at, "start", "stop", "surface"))
    return found.select("doc_id", "term_id", "mode", "start", "stop", place.alias("place"))


ORDERED_SQL = _HITS + """, every AS (
  SELECT DISTINCT doc_id, seq.term_id, seq.mode, start::INTEGER AS start, stop::INTEGER AS stop FROM seq
  UNION ALL SELECT doc_id, term_id, mode, (i - 1)::INTEGER, (i - 1 + length(phrase))::INTEGER FROM (SELECT doc_id, c, term_id, mode, phrase, unnest(range(1, length(c) + 1)) AS i FROM tok JOIN lexn ON (lang = 'en') = en WHERE mode = 'compact' AND contains(c, phrase)) WHERE substr(c, i, length(phrase)) = phrase
) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY term_id, CASE mode WHEN 'exact_phrase' THEN 1 WHEN 'token_sequence' THEN 2 ELSE 3 END, start, stop)::INTEGER AS place FROM every"""


def text_amplifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All context amplifiers; images, high-risk categories and risky contexts are derived from the documents' numbers."""
    lexicon, d = tp.lexicon_table(spark, LEXICON), table(spark, sf_dir, "documents")
    images = d.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "insult").otherwise("prose").alias("category"))
    high = local_table(spark, [("mockery",), ("insult",)], "category string")
    return tp.amplifiers(tp.matches(d, lexicon), lexicon, 4, images, high, d.where("doc_id % 5 = 0").select("doc_id"))


AMPLIFIERS_SQL = _HITS + """, m AS (SELECT DISTINCT doc_id, category, start FROM seq), g AS (SELECT doc_id, category, start - lag(start) OVER (PARTITION BY doc_id, category ORDER BY start) AS gap FROM m),
a AS (SELECT doc_id, category, CASE WHEN min(gap) <= 4 THEN 15 ELSE 0 END AS repeated, CASE WHEN doc_id % 3 = 0 AND category = CASE WHEN doc_id % 2 = 0 THEN 'insult' ELSE 'prose' END THEN 20 ELSE 0 END AS image,
  CASE WHEN category IN ('mockery', 'insult') THEN 20 ELSE 0 END AS configured, CASE WHEN doc_id % 5 = 0 THEN 10 ELSE 0 END AS context FROM g GROUP BY doc_id, category)
SELECT *, repeated + image + configured + context AS points FROM a"""


def text_large_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that each document has of a lexicon of the first two words of every document: one that is looked up by joins."""
    d = table(spark, sf_dir, "documents")
    w = fx.separator_tokens(F.col("text"))
    phrases = d.select(F.concat_ws(" ", F.get(w, 0), F.get(w, 1)).alias("phrase")).where(F.col("phrase").contains(" ")).distinct()
    lexicon = phrases.select(F.xxhash64("phrase").alias("term_id"), F.lit("made").alias("dictionary"), "phrase", F.lit("c").alias("category"), F.lit("low").alias("severity"), F.array(F.lit("token_sequence"), F.lit("compact")).alias("modes"), F.lit(None).cast("array<string>").alias("surfaces"))
    return tp.matched_terms(d, stored(lexicon)).groupBy("doc_id", "mode").agg(F.count("*").alias("terms"))


LARGE_LEXICON_SQL = rf"""
WITH term AS (
  SELECT DISTINCT w[1] || ' ' || w[2] AS phrase FROM (SELECT regexp_extract_all(text, '{_W}+') AS w FROM documents) WHERE len(w) > 1
), form AS (
  SELECT phrase, en, CASE WHEN en THEN lower(phrase) ELSE phrase END AS p FROM term, (VALUES (true), (false)) v(en)
), key AS (
  SELECT *, string_split(p, ' ') AS ws, CASE WHEN en THEN translate(replace(p, ' ', ''), '013457', 'oieast') ELSE replace(p, ' ', '') END AS k FROM form
), doc AS (
  SELECT doc_id, lang = 'en' AS en, CASE WHEN lang = 'en' THEN lower(b) ELSE b END AS t FROM (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b FROM documents)
), tok AS (
  SELECT doc_id, en, regexp_extract_all(t, '{_W}+') AS w, CASE WHEN en THEN translate(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g'), '013457', 'oieast') ELSE regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g') END AS c FROM doc
), pair AS (
  SELECT DISTINCT doc_id, en, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, en, w, unnest(range(1, len(w))) AS i FROM tok)
)
SELECT doc_id, 'token_sequence' AS mode, count(DISTINCT phrase) AS terms FROM pair JOIN key ON pair.en = key.en AND a = ws[1] AND b = ws[2] GROUP BY doc_id
UNION ALL SELECT doc_id, 'compact', count(DISTINCT phrase) FROM tok JOIN key ON tok.en = key.en AND contains(c, k) GROUP BY doc_id"""


def nfkc_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with letters replaced by full-width ones and ligatures, brought to one form again."""
    spoofed = F.replace(F.translate("text", "aeo", "ａｅｏ"), F.lit("fi"), F.lit("ﬁ"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", spoofed.alias("spoofed"))
    return d.select("doc_id", F.md5(fx.nfkc(F.col("spoofed"))).alias("form"), (F.col("spoofed") != F.col("text")).alias("spoofed"))


NFKC_SQL = "SELECT doc_id, md5(text) AS form, contains(text, 'a') OR contains(text, 'e') OR contains(text, 'o') OR contains(text, 'fi') AS spoofed FROM documents"


QUERIES = {"text_evidence_lists": text_evidence_lists, "ordered_matches": ordered_matches, "text_amplifiers": text_amplifiers, "text_large_lexicon": text_large_lexicon, "nfkc_forms": nfkc_forms, "text_model_verdicts": text_model_verdicts, "text_custom_views": text_custom_views, "text_evidence": text_evidence, "text_amplified": text_amplified, "lexicon_problems": lexicon_problems, "text_verdicts": text_verdicts, "text_term_hits": text_term_hits, "text_actions": text_actions, "text_views": text_views, "url_term_hits": url_term_hits, "turn_similarity": turn_similarity, "assembled_conversations": assembled_conversations}
SQL = {"text_evidence_lists": EVIDENCE_LISTS_SQL, "ordered_matches": ORDERED_SQL, "text_amplifiers": AMPLIFIERS_SQL, "text_large_lexicon": LARGE_LEXICON_SQL, "nfkc_forms": NFKC_SQL, "text_model_verdicts": MODEL_SQL, "text_custom_views": CUSTOM_SQL, "text_evidence": EVIDENCE_SQL, "text_amplified": AMPLIFIED_SQL, "lexicon_problems": LEXICON_PROBLEMS_SQL, "text_verdicts": VERDICTS_SQL, "text_term_hits": HITS_SQL, "text_actions": ACTIONS_SQL, "text_views": VIEWS_SQL, "url_term_hits": URL_HITS_SQL, "turn_similarity": TURN_SIMILARITY_SQL, "assembled_conversations": ASSEMBLED_SQL}
