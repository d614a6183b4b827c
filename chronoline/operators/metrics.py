"""Discrimination and calibration of (label, probability) tables.

All functions take `counts`: (keys, prob, n, pos), rows condensed by exact
probability. Everything after that is at most one row per key and threshold,
bin or grid point.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators import multinomial, smoothing

EPS = 1e-8


def probability_counts(df: DataFrame, keys: Sequence[str] = (), label: str = "label",
                       prob: str = "prob", weight: str | None = None,
                       clip: float | None = None) -> DataFrame:
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    p = F.col(prob)
    if clip is not None:
        p = F.least(F.greatest(p, F.lit(clip)), F.lit(1.0 - clip))
    return (df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull())
            .groupBy(*keys, p.alias("prob"))
            .agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).alias("pos")))


def probability_bounds(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*keys).agg(F.min("prob").alias("p_min"), F.max("prob").alias("p_max"))


def _attach(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on the keys, or add the columns of a one-row frame."""
    if keys:
        return df.join(other, list(keys))
    return df.withColumns({n: other.select(n).scalar() for n in other.columns})


def confusion_by_threshold(counts: DataFrame, keys: Sequence[str] = (), thresholds: int = 100,
                           bounds: DataFrame | None = None, bound_keys: Sequence[str] | None = None
                           ) -> DataFrame:
    """(keys, k, threshold, tp, fp, fn, tn) at evenly spaced thresholds, lowest first.

    A row is positive if prob >= threshold. Each probability finds the highest
    threshold it reaches; counts are then summed downwards. `bounds` fixes the
    threshold range, e.g. to that of the full data in a bootstrap.
    """
    keys = list(keys)
    bound_keys = keys if bound_keys is None else list(bound_keys)
    bounds = probability_bounds(counts, bound_keys) if bounds is None else bounds
    limits = bounds.withColumns({"lo": F.col("p_min") - EPS, "hi": F.col("p_max") + EPS}).withColumn(
        "step", (F.col("hi") - F.col("lo")) / (thresholds - 1)).select(*bound_keys, "lo", "hi", "step")

    def at(k: Column) -> Column:
        return F.when(k >= thresholds - 1, F.col("hi")).otherwise(F.col("lo") + k * F.col("step"))

    placed = _attach(counts, limits, bound_keys)
    guess = F.floor((F.col("prob") - F.col("lo")) / F.col("step"))
    placed = placed.withColumn("__g", guess)
    k = (F.when(at(F.col("__g") + 1) <= F.col("prob"), F.col("__g") + 1)
         .when(at(F.col("__g")) > F.col("prob"), F.col("__g") - 1).otherwise(F.col("__g")))
    k = F.least(F.greatest(k, F.lit(-1)), F.lit(thresholds - 1)).cast("int")
    hist = placed.groupBy(*keys, k.alias("k")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    groups = hist.select(*keys).distinct() if keys else hist.select(F.lit(0).alias("__one")).distinct()
    spine = groups.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1)))).select(
        *keys, "k", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"))
    full = hist.unionByName(spine).groupBy(*keys, "k").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    group = Window.partitionBy(*keys)
    down = group.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = full.select(
        *keys, "k", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("__pred"),
        F.sum("pos").over(group).alias("__p"), F.sum("n").over(group).alias("__n"))
    out = summed.filter(F.col("k") >= 0).select(
        *keys, "k", "tp", (F.col("__pred") - F.col("tp")).alias("fp"),
        (F.col("__p") - F.col("tp")).alias("fn"),
        (F.col("__n") - F.col("__p") - F.col("__pred") + F.col("tp")).alias("tn"))
    return _attach(out, limits, bound_keys).withColumn("threshold", at(F.col("k"))).drop(
        "lo", "hi", "step")


def threshold_metrics(confusion: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return confusion.withColumns({
        "sensitivity": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp),
        "precision": F.try_divide(tp, tp + fp), "npv": F.try_divide(tn, tn + fn),
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)})


def roc_curve(confusion: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return confusion.withColumns({"tpr": tp / (tp + fn + EPS), "fpr": fp / (fp + tn + EPS)})


def _area(curve: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("k").desc())
    base = F.coalesce(F.col(x) - F.lag(x).over(w), F.lit(0.0))
    height = (F.col(y) + F.coalesce(F.lag(y).over(w), F.lit(0.0))) / 2
    return curve.select(*keys, x, (base * height).alias("__a")).groupBy(*keys).agg(
        F.sum("__a").alias("area"), F.min(x).alias("__first"))


def auroc(confusion: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _area(roc_curve(confusion), keys, "fpr", "tpr").select(*keys, F.col("area").alias("auroc"))


def pr_curve(confusion: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(n) for n in ("tp", "fp", "fn"))
    curve = confusion.withColumns({"recall": F.try_divide(tp, tp + fn),
                                   "precision": F.try_divide(tp, tp + fp)})
    return curve.filter(F.col("recall").isNotNull() & F.col("precision").isNotNull())


def auprc(confusion: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under precision over recall; before the first recall precision counts as 1."""
    return _area(pr_curve(confusion), keys, "recall", "precision").select(
        *keys, (F.col("area") + F.col("__first")).alias("auprc"))


def best_threshold(confusion: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold closest to the corner (0, 1) and threshold of the highest F1."""
    curve = roc_curve(threshold_metrics(confusion))
    distance = F.sqrt(F.pow(1 - F.col("tpr"), 2) + F.pow(F.col("fpr"), 2))
    return curve.groupBy(*keys).agg(
        F.min_by("threshold", F.struct(distance, F.col("k"))).alias("corner_threshold"),
        F.min_by("threshold", F.struct(-F.coalesce("f1", F.lit(0.0)), F.col("k"))).alias("f1_threshold"),
        F.max(F.coalesce("f1", F.lit(0.0))).alias("best_f1"))


def bootstrap_metrics(rows: DataFrame, weights: DataFrame, row_id: str, keys: Sequence[str] = (),
                      thresholds: int = 100, label: str = "label", prob: str = "prob") -> DataFrame:
    """AUROC and AUPRC per replicate, thresholds taken from the full data."""
    keys = list(keys)
    full = probability_bounds(probability_counts(rows, keys, label, prob), keys)
    drawn = probability_counts(weights.join(rows, row_id), [*keys, "replicate"], label, prob, "weight")
    return _replicate_areas(drawn, full, keys, thresholds)


def _replicate_areas(drawn: DataFrame, full: DataFrame, keys: list[str], thresholds: int) -> DataFrame:
    by = [*keys, "replicate"]
    confusion = confusion_by_threshold(drawn, by, thresholds, full, keys)
    return auroc(confusion, by).join(auprc(confusion, by), by)


def condensed_bootstrap_metrics(counts: DataFrame, replicates: int, keys: Sequence[str] = (), thresholds: int = 100,
                                seed: int = 0, piece: int = multinomial.PIECE,
                                keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """`bootstrap_metrics` from condensed counts: cells are drawn by a digest tree, rows are not read again.

    Several branches read the drawn counts; `keep(name, df)` may store them.
    """
    keys, keep = list(keys), keep or (lambda name, df: df)
    drawn = keep("drawn_counts", multinomial.bootstrap_probability_counts(counts, replicates, keys, seed, piece))
    return _replicate_areas(drawn, probability_bounds(counts, keys), keys, thresholds)


def bootstrap_metric_ci(replicates: DataFrame, keys: Sequence[str] = (), ci: float = 0.95) -> DataFrame:
    """(keys, metric, mean, lower, upper) over the replicates."""
    from chronoline.operators.resample import bootstrap_ci
    long = replicates.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auroc", "auprc")
    ])).alias("m")).select(*keys, "m.*")
    return bootstrap_ci(long, [*keys, "metric"], ci=ci)


def calibration_bins(counts: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(keys, bin, center, n, observed): observed rate per probability bin, empty bins kept."""
    keys = list(keys)
    width = 1.0 / bins
    guess = F.floor(F.col("prob") * bins)
    b = (F.when((guess + 1) * F.lit(width) <= F.col("prob"), guess + 1)
         .when(guess * F.lit(width) > F.col("prob"), guess - 1).otherwise(guess))
    b = F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("int")
    hist = counts.groupBy(*keys, b.alias("bin")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    groups = hist.select(*keys).distinct() if keys else hist.select(F.lit(0).alias("__one")).distinct()
    spine = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        *keys, "bin", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"))
    return (hist.unionByName(spine).groupBy(*keys, "bin")
            .agg(F.sum("n").alias("n"), F.sum("pos").alias("__p"))
            .select(*keys, "bin", (F.col("bin") * F.lit(width) + F.lit(width / 2)).alias("center"), "n",
                    F.try_divide("__p", "n").alias("observed")))


def oe_ratio(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*keys).agg(
        F.try_divide(F.sum("pos"), F.sum(F.col("prob") * F.col("n"))).alias("oe"))


def logistic_recalibration(counts: DataFrame, keys: Sequence[str] = (), steps: int = 8) -> DataFrame:
    """Calibration in the large, slope and intercept per key.

    Newton steps of the two logistic refits on logit(prob). Each step is one
    aggregation per key over the condensed counts, so a key of any size is
    summed in parallel.
    """
    if not keys:
        # a constant key keeps every step one join and one aggregation
        return logistic_recalibration(counts.withColumn("__one", F.lit(0)), ["__one"], steps).drop("__one")
    keys = list(keys)
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-10)), F.lit(1 - 1e-10))
    data = counts.select(*keys, "n", "pos", F.log(p / (1 - p)).alias("x"))
    coef = data.groupBy(*keys).agg(F.lit(0.0).alias("a"), F.lit(0.0).alias("i"), F.lit(1.0).alias("s"))
    for _ in range(steps):
        rows = _attach(data, coef, keys)
        offset = 1 / (1 + F.exp(-(F.col("a") + F.col("x"))))
        fit = 1 / (1 + F.exp(-(F.col("i") + F.col("s") * F.col("x"))))
        wo, wf = F.col("n") * offset * (1 - offset), F.col("n") * fit * (1 - fit)
        sums = rows.groupBy(*keys).agg(
            F.max("a").alias("a"), F.max("i").alias("i"), F.max("s").alias("s"),
            F.sum(F.col("pos") - F.col("n") * offset).alias("ga"), F.sum(wo).alias("ha"),
            F.sum(F.col("pos") - F.col("n") * fit).alias("g0"),
            F.sum((F.col("pos") - F.col("n") * fit) * F.col("x")).alias("g1"),
            F.sum(wf).alias("h00"), F.sum(wf * F.col("x")).alias("h01"),
            F.sum(wf * F.col("x") * F.col("x")).alias("h11"))
        det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
        coef = sums.select(
            *keys, (F.col("a") + F.try_divide("ga", "ha")).alias("a"),
            (F.col("i") + F.try_divide(F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1"), det)).alias("i"),
            (F.col("s") + F.try_divide(F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0"), det)).alias("s"))
    return coef.select(*keys, F.col("a").alias("citl"), F.col("s").alias("slope"),
                       F.col("i").alias("intercept"))


def lowess_curve(counts: DataFrame, keys: Sequence[str] = (), frac: float = 0.5, step: float = 0.005,
                 bounds: DataFrame | None = None, bound_keys: Sequence[str] | None = None,
                 few_values: bool = False) -> DataFrame:
    """(keys, g, x, smooth): local linear smooth of the labels on an even grid of at most 1/step points.

    Tricube weights within the distance of the nearest `frac` of the rows, by the
    prefix moments of `smoothing`: no value meets a grid point. `few_values` says that
    a key has a bounded number of distinct probabilities, such as shares of a number of
    simulations; its sorted values are then scanned as a whole.
    """
    if not keys:
        # a constant key keeps look-ups keyed joins
        return lowess_curve(counts.withColumn("__one", F.lit(0)), ["__one"], frac, step,
                            probability_bounds(counts) if bounds is None else bounds, (), few_values).drop("__one")
    keys = list(keys)
    bound_keys = keys if bound_keys is None else list(bound_keys)
    bounds = probability_bounds(counts, bound_keys) if bounds is None else bounds
    points = F.greatest(F.ceil((F.col("p_max") - F.col("p_min")) / step) - 1, F.lit(0)).cast("int")
    grid = _attach(counts.select(*keys).distinct(), bounds, bound_keys).withColumn(
        "g", F.explode(F.sequence(F.lit(0), points))).select(
        *keys, "g", (F.col("p_min") + F.col("g") * F.lit(step)).alias("x"), (F.col("p_max") - F.col("p_min")).alias("range"))
    return smoothing.lowess(counts, grid, keys, frac, few_values)


def bootstrap_calibration(rows: DataFrame, weights: DataFrame, row_id: str, bins: int = 10,
                          ci: float = 0.95, label: str = "label", prob: str = "prob",
                          few_values: bool = False) -> DataFrame:
    """(item, mean, lower, upper): bands of bins, smooth, O/E, slope and intercepts."""
    full = probability_bounds(probability_counts(rows, (), label, prob, clip=1e-4))
    drawn = probability_counts(weights.join(rows, row_id), ["replicate"], label, prob, "weight", clip=1e-4)
    return _calibration_bands(drawn, full, bins, ci, few_values)


def condensed_bootstrap_calibration(counts: DataFrame, replicates: int, bins: int = 10, ci: float = 0.95, seed: int = 0,
                                    piece: int = multinomial.PIECE, few_values: bool = False,
                                    keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """`bootstrap_calibration` from condensed (prob, n, pos), drawn by a digest tree; `keep` as above."""
    keep = keep or (lambda name, df: df)
    drawn = keep("drawn_counts", multinomial.bootstrap_probability_counts(counts, replicates, (), seed, piece))
    return _calibration_bands(drawn, probability_bounds(counts), bins, ci, few_values)


def _calibration_bands(drawn: DataFrame, full: DataFrame, bins: int, ci: float, few_values: bool) -> DataFrame:
    from chronoline.operators.resample import bootstrap_ci
    by = ["replicate"]
    one = lambda name, value: F.struct(F.lit(name).alias("item"), value.alias("value"))
    oe = oe_ratio(drawn, by).select(one("oe", F.col("oe")).alias("s"))
    refit = logistic_recalibration(drawn, by).select(F.explode(F.array(
        one("citl", F.col("citl")), one("slope", F.col("slope")),
        one("intercept", F.col("intercept")))).alias("s"))
    binned = calibration_bins(drawn, by, bins).select(F.struct(
        F.concat(F.lit("bin_"), F.col("bin").cast("string")).alias("item"),
        F.col("observed").alias("value")).alias("s"))
    curve = lowess_curve(drawn, by, bounds=full, bound_keys=(), few_values=few_values).select(F.struct(
        F.concat(F.lit("smooth_"), F.col("g").cast("string")).alias("item"),
        F.col("smooth").alias("value")).alias("s"))
    every = oe.unionByName(refit).unionByName(binned).unionByName(curve).select("s.*")
    return bootstrap_ci(every, ["item"], ci=ci)
