"""Queries on scores and vectors, with SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fence import fenced
from ..functions.vectors import difference_hash, linear_head
from ..operators import evaluation as ev, hashes as hx, neighbours as nb
from .tables import table

_SCORES = "SELECT event_id, event_type AS corpus, cast(least(1.0, value / 100) as double) AS score, CASE WHEN value * (1 + event_id % 3) > 40 THEN 1 ELSE 0 END AS label FROM {e}"
_S = f"WITH s AS ({_SCORES.format(e='events')})"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SCORES.replace("{e}", "{events}"), events=table(spark, sf_dir, "events"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def score_summary(spark, sf_dir):
    return _rounded(ev.summary(scores(spark, sf_dir), ["corpus"]))


def threshold_sweep(spark, sf_dir):
    return _rounded(ev.sweep(scores(spark, sf_dir), ["corpus"]))


def confusion(spark, sf_dir):
    return _rounded(ev.confusion(scores(spark, sf_dir), 0.4))


def threshold_profiles(spark, sf_dir):
    return ev.profiles(scores(spark, sf_dir))


def ranking_quality(spark, sf_dir):
    return _rounded(ev.ranking_quality(scores(spark, sf_dir)))


def operating_points(spark, sf_dir):
    return _rounded(ev.operating_points(scores(spark, sf_dir), (0.02, 0.05, 0.1)))


def error_confidence(spark, sf_dir):
    return _rounded(ev.error_confidence(scores(spark, sf_dir), 0.4))


def deferral_curve(spark, sf_dir):
    return _rounded(ev.deferral_curve(scores(spark, sf_dir), 0.4))


def guardrail(spark, sf_dir):
    s = scores(spark, sf_dir)
    rates = lambda t: ev.confusion(s, t).select("recall", (F.col("fp") / (F.col("fp") + F.col("tn"))).alias("fpr"))
    return _rounded(ev.guardrail(rates(0.4), rates(0.35)))


def top_items(spark, sf_dir):
    return ev.top_items(scores(spark, sf_dir).withColumnRenamed("event_id", "item")).select("item", F.round("score", 6).alias("score"))


def tile_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 16).alias("image_id"), (F.col("event_id") % 16).cast("int").alias("tile"), (F.col("value") / 200 - 0.1).alias("score"))
    return _rounded(ev.tile_max(e).withColumn("tiles", F.array_join(F.transform("tiles", lambda t: t.cast("string")), ",")))


def federated_mean(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("client"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return _rounded(ev.trimmed_mean(u, 0.1, 500))


_HEAD = ([((i * 7) % 13 - 6) / 6 for i in range(64)], [((i * 5) % 11 - 5) / 5 for i in range(64)])


def head_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(linear_head(F.col("embedding"), _HEAD, (0.1, -0.1)), 5).alias("score"))


def head_classes(spark, sf_dir):
    """Each embedding's class by a softmax head that was trained on the labels of all."""
    e = table(spark, sf_dir, "embeddings")
    weights, biases = ev.train_classes(e)
    p = ev.class_scores(F.col("embedding"), weights, biases)
    return fenced(e.select("vec_id", "label", "embedding"), p=p).select("vec_id", "label", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("predicted"))


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    grid = F.transform(F.concat(F.col("embedding"), F.slice("embedding", 1, 8)), lambda x: x.cast("double"))
    return e.select("vec_id", "label", difference_hash(grid).alias("hash"))


def difference_hashes(spark, sf_dir):
    return _hashes(spark, sf_dir).select("vec_id", "hash")


def nearest_hashes(spark, sf_dir):
    """One hash in a hundred, with up to 14 of its bits turned, against all."""
    h = _hashes(spark, sf_dir)
    turned = F.col("hash").bitwiseXOR((F.col("vec_id") * 40_503).bitwiseAND(F.lit(0x7F7F).cast("long")))
    queries = h.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), turned.alias("hash"))
    return hx.nearest_hash(queries, h.select(F.col("label").cast("string").alias("label"), "hash"))


def latency_profiles(spark, sf_dir):
    return ev.latencies(scores(spark, sf_dir).withColumn("millis", (F.col("score") * 1000).cast("int")), ["corpus"])


def nearest_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return hx.nearest_vectors(e.where("id % 100 = 0"), e, 5)


def indexed_neighbours(spark, sf_dir):
    """nearest_vectors by an index with exact bounds."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nb.nearest(e.where("id % 100 = 0"), nb.fit(e), 5)


def neighbour_labels(spark, sf_dir):
    """Labels by the votes of neighbours, asked by three users of whom two have labels of their own."""
    e = table(spark, sf_dir, "embeddings")
    vectors = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = nb.nearest(vectors.where("id % 100 = 0"), nb.fit(vectors), 5)
    labels = e.where("vec_id % 7 > 0").select(F.col("vec_id").alias("id"), "label")
    own = e.where("vec_id % 3 < 2").select((F.col("vec_id") % 3).alias("user_id"), F.col("vec_id").alias("id"), F.lit(1).alias("label"))
    askers = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("user_id"))
    return nb.voted(found, labels, own, askers)


_HASH_SQL = """g AS (SELECT vec_id, label, list_concat(embedding, embedding[1:8])::DOUBLE[] AS v FROM embeddings),
bit AS (SELECT vec_id, label, i, v[(i // 8) * 9 + i % 8 + 1] > v[(i // 8) * 9 + i % 8 + 2] AS b FROM g, range(0, 64) r(i)),
h AS (SELECT vec_id, any_value(label) AS label, string_agg(CASE WHEN b THEN '1' ELSE '0' END, '' ORDER BY i) AS bits,
  (sum(CASE WHEN b AND i > 0 THEN (1::HUGEINT << (63 - i)) ELSE 0 END) - max(CASE WHEN b AND i = 0 THEN (1::HUGEINT << 63) ELSE 0 END))::BIGINT AS hash FROM bit GROUP BY vec_id)"""
_BY = _S + ", b AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM b)"
_CONF = "count(*) FILTER (score >= {t} AND label = 1) AS tp, count(*) FILTER (score >= {t} AND label = 0) AS fp, count(*) FILTER (score < {t} AND label = 0) AS tn, count(*) FILTER (score < {t} AND label = 1) AS fn"
_W = ["[" + ", ".join(f"{x!r}" for x in w) + "]" for w in _HEAD]

_NEIGHBOURS = "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings), p AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_dot_product(q.v, b.v) / (q.l * b.l), 6) AS similarity FROM n q JOIN n b ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id)::INTEGER AS rank FROM p)"
_VOTED_SQL = """, v AS (SELECT query_id, u.user_id, CASE WHEN neighbour_id % 3 = u.user_id AND u.user_id < 2 THEN 1 WHEN neighbour_id % 7 > 0 THEN e.label END AS label FROM r JOIN embeddings e ON e.vec_id = neighbour_id, (VALUES (0), (1), (2)) u(user_id) WHERE rank <= 5),
c AS (SELECT query_id, user_id, label, count(*) AS votes FROM v WHERE label IS NOT NULL GROUP BY ALL)
SELECT query_id, user_id::BIGINT AS user_id, first(label ORDER BY votes DESC, label) AS label, max(votes) AS votes FROM c GROUP BY ALL"""

QUERIES = {
    "score_summary": score_summary, "threshold_sweep": threshold_sweep, "confusion": confusion, "threshold_profiles": threshold_profiles, "ranking_quality": ranking_quality,
    "operating_points": operating_points, "error_confidence": error_confidence, "deferral_curve": deferral_curve, "guardrail": guardrail, "top_items": top_items,
    "tile_scores": tile_scores, "federated_mean": federated_mean, "head_scores": head_scores, "head_classes": head_classes, "difference_hashes": difference_hashes, "nearest_hashes": nearest_hashes, "nearest_vectors": nearest_vectors, "indexed_neighbours": indexed_neighbours, "neighbour_labels": neighbour_labels, "latency_profiles": latency_profiles,
}
SQL = {
    "score_summary": _S + " SELECT corpus, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(quantile_disc(score, 0.9), 6) AS p90, round(quantile_disc(score, 0.95), 6) AS p95, round(quantile_disc(score, 0.99), 6) AS p99, round(min(score), 6) AS least, round(max(score), 6) AS most FROM s GROUP BY corpus",
    "threshold_sweep": _S + " SELECT corpus, t::DOUBLE AS threshold, round(avg(CASE WHEN score >= t::DOUBLE THEN 1.0 ELSE 0.0 END), 6) AS share FROM s, (VALUES (0.1), (0.2), (0.3), (0.5), (0.7), (0.9)) v(t) GROUP BY corpus, t",
    "confusion": _S + f", c AS (SELECT {_CONF.format(t='0.4::DOUBLE')} FROM s) SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c",
    "threshold_profiles": _S + " SELECT profile, t::DOUBLE AS threshold, count(*) FILTER (score >= t::DOUBLE AND label = 1) AS tp, count(*) FILTER (score >= t::DOUBLE AND label = 0) AS fp, count(*) FILTER (score < t::DOUBLE AND label = 1) AS fn FROM s, (VALUES ('strict', 0.3), ('balanced', 0.5), ('light', 0.7)) v(profile, t) GROUP BY profile, t",
    "ranking_quality": _BY + " SELECT round(sum(neg * (tp - pos + pos / 2)) / (max(p) * max(n)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(p), 6) AS pr_auc FROM c",
    "operating_points": _BY + ", m AS (SELECT x::DOUBLE AS budget, max(score) AS threshold FROM c, (VALUES (0.02), (0.05), (0.1)) v(x) WHERE 1 - tp / p <= x + 1e-12 GROUP BY x) SELECT budget, round(threshold, 6) AS threshold, round(fp / n, 6) AS over_block, round(1 - tp / p, 6) AS miss FROM m JOIN c ON threshold = score",
    "error_confidence": _S + " SELECT label, count(*) AS n, round(avg(greatest(score, 1 - score)), 6) AS mean_confidence FROM s WHERE (score >= 0.4::DOUBLE) <> (label = 1) GROUP BY label",
    "deferral_curve": _S + ", g AS (SELECT greatest(score, 1 - score) AS confidence, count(*) AS n, count(*) FILTER ((score >= 0.4::DOUBLE) <> (label = 1)) AS w FROM s GROUP BY 1) SELECT round(confidence, 6) AS confidence, round(sum(n) OVER o / (SELECT count(*) FROM s), 6) AS coverage, round(sum(w) OVER o / sum(n) OVER o, 6) AS risk FROM g WINDOW o AS (ORDER BY g.confidence DESC)",
    "guardrail": _S + f", a AS (SELECT {_CONF.format(t='0.4::DOUBLE')} FROM s), b AS (SELECT {_CONF.format(t='0.35::DOUBLE')} FROM s), r AS (SELECT a.tp / (a.tp + a.fn) AS r0, a.fp / (a.fp + a.tn) AS f0, b.tp / (b.tp + b.fn) AS r1, b.fp / (b.fp + b.tn) AS f1 FROM a, b) SELECT round(r1, 6) AS recall, round(f1, 6) AS fpr, CASE WHEN r1 < r0 THEN 'CRITICAL' WHEN f1 >= f0 THEN 'WARNING' ELSE 'OK' END AS status FROM r",
    "top_items": _S + " SELECT event_id AS item, round(score, 6) AS score FROM s ORDER BY s.score DESC, event_id DESC LIMIT 10",
    "tile_scores": "WITH t AS (SELECT event_id // 16 AS image_id, event_id % 16 AS tile, value / 200 - 0.1 AS score FROM events) SELECT image_id, round(greatest(max(score), 0), 6) AS score, greatest(max(score), 0) >= 0.4650 AS blocked, coalesce(string_agg(tile::VARCHAR, ',' ORDER BY tile) FILTER (score >= 0.4650), '') AS tiles FROM t GROUP BY image_id",
    "federated_mean": "WITH c AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), r AS (SELECT i, x, row_number() OVER (PARTITION BY i ORDER BY x, vec_id) AS r, count(*) OVER (PARTITION BY i) AS n FROM c) SELECT i::INTEGER AS i, round(avg(x), 6) AS mean FROM r WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1) AND (SELECT count(*) FROM embeddings) >= 500 GROUP BY i",
    "head_scores": f"WITH l AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({_W[0]})[i])) + 0.1 AS a, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({_W[1]})[i])) - 0.1 AS b FROM embeddings) SELECT vec_id, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 5) AS score FROM l",
    "difference_hashes": f"WITH {_HASH_SQL} SELECT vec_id, hash FROM h",
    "nearest_hashes": f"WITH {_HASH_SQL}, q AS (SELECT vec_id AS id, xor(hash, (vec_id * 40503) & 32639) AS hash FROM h WHERE vec_id % 100 = 0), j AS (SELECT q.id, b.label::VARCHAR AS label, bit_count(xor(q.hash, b.hash))::INTEGER AS distance FROM q JOIN h b ON bit_count(xor(q.hash, b.hash)) <= 10), m AS (SELECT id, first(label ORDER BY distance, label) AS label, min(distance) AS distance FROM j GROUP BY id) SELECT q.id, m.label, distance FROM q LEFT JOIN m USING (id)",
    "latency_profiles": _S + ", m AS (SELECT corpus, trunc(score * 1000)::INTEGER AS millis FROM s) SELECT corpus, quantile_disc(millis, 0.5) AS p50, quantile_disc(millis, 0.95) AS p95 FROM m GROUP BY corpus",
    "indexed_neighbours": _NEIGHBOURS + " SELECT * FROM r WHERE rank <= 5",
    "neighbour_labels": _NEIGHBOURS + _VOTED_SQL,
    "nearest_vectors": _NEIGHBOURS + " SELECT * FROM r WHERE rank <= 5",
}
