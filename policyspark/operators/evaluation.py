"""Classifier evaluation on tables of scores, without a window over all rows: counts by distinct score come first."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fence import once
from ..functions.joins import side
from ..functions.vectors import dot
from .selection import middle, nearest_rank, selected

#: Sweep thresholds, guardrail, tile threshold (inclusive).
SWEEP = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
TILE_BLOCK = 0.4650
PROFILES = {"strict": 0.3, "balanced": 0.5, "light": 0.7}


def _beside(groups: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of a row a group side by side, nulls in ``by`` being alike."""
    if not by:
        return groups.crossJoin(found)  # one row each
    f = found.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in found.columns if c not in by]).hint("merge")
    on = reduce(Column.__and__, [groups[c].eqNullSafe(f[f"__{c}"]) for c in by])
    return groups.join(f, on, "left").drop(*[f"__{c}" for c in by])


def summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """count, mean, median, nearest-rank p90, p95, p99, min, max of score.  Callers treat an empty result as an error."""
    ranks = {"m0": middle(False), "m1": middle(True), "p90": nearest_rank(0.9), "p95": nearest_rank(0.95), "p99": nearest_rank(0.99)}
    g = scores.groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"))
    j = _beside(g, selected(scores, by, "score", ranks), by)
    return j.select(*by, "n", "mean", ((F.col("m0") + F.col("m1")) / 2).alias("median"), "p90", "p95", "p99", "least", "most")


def sweep(scores: DataFrame, by: list[str], thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """Share of scores at or above each threshold: the false-positive rate of benign items, the recall of others."""
    shares = [F.struct(F.lit(t).alias("threshold"), F.avg((F.col("score") >= t).cast("double")).alias("share")) for t in thresholds]
    return scores.groupBy(*by).agg(F.array(*shares).alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.*")


def confusion(scores: DataFrame, threshold: float) -> DataFrame:
    """One row: tp, fp, tn, fn, accuracy, precision, recall.  ``scores``: label (0/1), score."""
    yes, pos = F.col("score") >= threshold, F.col("label") == 1
    c = scores.agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & ~pos).alias("tn"), F.count_if(~yes & pos).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return c.select("*", ratio(F.col("tp") + F.col("tn"), total).alias("accuracy"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def profiles(scores: DataFrame) -> DataFrame:
    """Precision and recall at each named threshold: profile, threshold, tp, fp, fn."""
    pos = F.col("label") == 1
    rows = F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(t).alias("threshold"), F.count_if((F.col("score") >= t) & pos).alias("tp"), F.count_if((F.col("score") >= t) & ~pos).alias("fp"), F.count_if((F.col("score") < t) & pos).alias("fn")) for n, t in PROFILES.items()])
    return scores.agg(rows.alias("p")).select(F.explode("p").alias("p")).select("p.*")


def latencies(scores: DataFrame, by: list[str]) -> DataFrame:
    """Nearest-rank median and 95th percentile of ``millis``."""
    return selected(scores, by, "millis", {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95)})


def _between(score: Column, bounds: list[float], first: int = 0) -> Column:
    """``first`` and the number of ascending ``bounds`` at or below score, by halving."""
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(score < bounds[m], _between(score, bounds[:m], first)).otherwise(_between(score, bounds[m + 1 :], first + m + 1))


def by_score(scores: DataFrame, decimals: int | None = None) -> DataFrame:
    """score, pos, neg and the totals at or above it, by exact score.  ``decimals`` bins scores on request.

    Scores are dealt into ranges at approximate quantiles; totals run within a range, and those of the ranges above are added.
    """
    s = F.col("score") if decimals is None else F.round("score", decimals)
    g = scores.groupBy(s.alias("score")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    n = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = F.col("score").cast("double")
    bounds = g.select(x.alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.5 / n) if n > 1 else []
    g = g.withColumn("part", F.when(x.isNull(), -1).otherwise(_between(x, sorted(set(bounds)))))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    over = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    parts = g.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select("part", over("p").alias("tp0"), over("n").alias("fp0"))
    w = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    j = g.join(F.broadcast(parts), "part")
    return j.select("score", "pos", "neg", (F.col("tp0") + F.sum("pos").over(w)).alias("tp"), (F.col("fp0") + F.sum("neg").over(w)).alias("fp"))


def ranking_quality(scores: DataFrame, decimals: int | None = None) -> DataFrame:
    """One row: roc_auc (ties count half) and pr_auc (step-wise average precision); null without both classes."""
    b = by_score(scores, decimals)
    total = b.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    j = b.crossJoin(total)  # one row
    roc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)) / F.when(F.max("p") * F.max("n") > 0, F.max("p") * F.max("n"))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.when(F.max("p") > 0, F.max("p"))
    return j.agg(roc.alias("roc_auc"), ap.alias("pr_auc"))


def operating_points(scores: DataFrame, budgets: tuple[float, ...], decimals: int | None = None) -> DataFrame:
    """For each miss budget the highest threshold that stays within it and the over-block rate there."""
    b = by_score(scores, decimals)
    j = b.crossJoin(b.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")))  # one row
    miss, over = 1 - F.col("tp") / F.col("p"), F.col("fp") / F.col("n")
    best = lambda x: F.max_by(F.struct(F.col("score").alias("threshold"), over.alias("over_block"), miss.alias("miss")), F.when(miss <= x + 1e-12, F.col("score")))
    return j.agg(F.array(*[F.struct(F.lit(x).alias("budget"), best(x).alias("b")) for x in budgets]).alias("r")).select(F.explode("r").alias("r")).select("r.budget", "r.b.threshold", "r.b.over_block", "r.b.miss")


def error_confidence(scores: DataFrame, threshold: float) -> DataFrame:
    """Mean confidence of the misclassified rows by label."""
    wrong = (F.col("score") >= threshold) != (F.col("label") == 1)
    return scores.where(wrong).groupBy("label").agg(F.count("*").alias("n"), F.avg(F.greatest("score", 1 - F.col("score"))).alias("mean_confidence"))


def guardrail(baseline: DataFrame, candidate: DataFrame, recall_drop: float = 0.0) -> DataFrame:
    """One row of (recall, fpr) each: CRITICAL where recall falls, WARNING where the rate of false positives doesn't, else OK."""
    j = baseline.select(F.col("recall").alias("r0"), F.col("fpr").alias("f0")).crossJoin(candidate.select("recall", "fpr"))  # one row each
    return j.select("recall", "fpr", F.when(F.col("recall") < F.col("r0") - recall_drop, "CRITICAL").when(F.col("fpr") >= F.col("f0"), "WARNING").otherwise("OK").alias("status"))


def deferral_curve(scores: DataFrame, threshold: float, decimals: int | None = None) -> DataFrame:
    """confidence, coverage and risk (share of errors) of the rows at least so confident, by exact confidence; ``decimals`` bins on request."""
    wrong = (F.col("score") >= threshold) != (F.col("label") == 1)
    c = by_score(scores.select(F.greatest("score", 1 - F.col("score")).alias("score"), wrong.cast("int").alias("label")), decimals)
    covered = F.col("tp") + F.col("fp")
    return c.crossJoin(scores.agg(F.count("*").alias("total"))).select(F.col("score").alias("confidence"), (covered / F.col("total")).alias("coverage"), (F.col("tp") / covered).alias("risk"))  # one row


def top_items(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring items, ties by item descending."""
    return scores.orderBy(F.desc("score"), F.desc("item")).limit(k)


def tile_max(tiles: DataFrame, threshold: float = TILE_BLOCK) -> DataFrame:
    """Per image: score (the greatest tile's, 0 at least), blocked, and the tiles over the threshold; none of them means the whole surface."""
    s = F.greatest(F.max("score"), F.lit(0.0))
    return tiles.groupBy("image_id").agg(s.alias("score"), (s >= threshold).alias("blocked"), F.array_sort(F.collect_list(F.when(F.col("score") >= threshold, F.col("tile")))).alias("tiles"))


def trimmed_mean(updates: DataFrame, trim: float, least_clients: int) -> DataFrame:
    """Planned in the reference: mean of each coordinate without its ``trim`` smallest and greatest shares; nothing below ``least_clients``.

    ``updates``: client, vector.  It is no defence against colluding clients.
    """
    enough = updates.agg((F.countDistinct("client") >= least_clients).alias("ok"))
    c = updates.select(F.posexplode("vector").alias("i", "x")).where("x is not null")  # summed up in each task, not shuffled
    cut = lambda n: F.floor(n * trim).cast("long")
    ends = selected(c, ["i"], "x", {"a": lambda n: cut(n) + 1, "b": lambda n: n - cut(n)})
    j = c.join(side(ends), "i")
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    g = j.groupBy("i", "a", "b").agg(F.count("*").alias("n"), F.count_if(x <= a).alias("upto_a"), F.count_if(x < b).alias("under_b"), F.coalesce(F.sum(F.when((x > a) & (x < b), x)), F.lit(0.0)).alias("mid"))
    # of the values like the first or the last kept, as many as are not cut
    first, last, kept = F.col("upto_a") - cut(F.col("n")), F.col("n") - cut(F.col("n")) - F.col("under_b"), F.col("n") - 2 * cut(F.col("n"))
    mean = F.when(a == b, a).otherwise((F.col("mid") + a * first + b * last) / kept)
    return g.where(kept > 0).select("i", mean.alias("mean")).crossJoin(enough).where("ok").select("i", "mean")  # one row


def score_corpus(files: DataFrame, score: Callable[[Column], Column], corpus: str) -> DataFrame:
    """Scores of a corpus scan (path, content) by the caller's function, a pandas UDF say: corpus, item, score."""
    return files.select(F.lit(corpus).alias("corpus"), F.col("path").alias("item"), score(F.col("content")).cast("double").alias("score"))


def train_head(labelled: DataFrame, rounds: int = 50, ridge: float = 1e-3) -> tuple[list[float], float]:
    """Planned in the reference: (weights, bias) of a logistic head on ``labelled`` (embedding, label 0/1), data-parallel.

    For two classes the softmax head has logits (0, w.e + b).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = labelled.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(maxIter=rounds, regParam=ridge).fit(rows)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def train_classes(labelled: DataFrame, rounds: int = 50, ridge: float = 1e-3) -> tuple[list[list[float]], list[float]]:
    """Planned in the reference: (weights of each class, biases) of a softmax head on ``labelled`` (embedding, label 0 to K - 1), data-parallel."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = labelled.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(maxIter=rounds, regParam=ridge, family="multinomial").fit(rows)
    return model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()


def class_scores(embedding: Column, weights: list[list[float]], biases: list[float]) -> Column:
    """Softmax of a head of any number of classes: an array of probabilities."""
    logits = F.array(*[dot(embedding, F.array(*[F.lit(float(x)) for x in w])) + F.lit(float(b)) for w, b in zip(weights, biases, strict=True)])
    return once(logits, lambda z: once(F.transform(z, lambda x: F.exp(x - F.array_max(z))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))))
