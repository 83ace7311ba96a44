"""Reference distributions, feature drift and prediction drift."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.exprs import finite, ladder
from wanetrack.functions.quantiles import exact_quantiles
from wanetrack.functions.ranges import running
from wanetrack.operators.preprocess import per_column, unpivot
from wanetrack.sources.tables import written

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
DECILES = tuple(i / 10 for i in range(1, 10))


def numeric_reference(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """REF1: a row a feature: count, missing rate, moments, quantiles, inner bin edges (distinct deciles), constancy.

    A feature without any finite value has null quantiles and counts as constant.
    """
    levels = sorted({*QUANTILES, *DECILES})
    pick = lambda wanted: F.array(*[F.col("_q")[levels.index(q)] for q in wanted])
    held = exact_quantiles(df, columns, levels).select("feature", F.col("quantiles").alias("_q"))
    g = per_column(
        df, columns, n=lambda c: F.count(finite(c)), missing_rate=lambda c: F.avg(finite(c).isNull().cast("int")), mean=lambda c: F.avg(finite(c)),
        std=lambda c: F.stddev_samp(finite(c)), low=lambda c: F.min(finite(c)), high=lambda c: F.max(finite(c)),
    ).join(F.broadcast(held), "feature")  # a row a feature
    some = F.col("n") > 0
    g = g.withColumns({"quantiles": F.when(some, pick(QUANTILES)), "deciles": F.when(some, pick(DECILES))}).drop("_q")
    width = (F.col("high") - F.col("low")) / 10
    equal = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.col("low") + i * width)
    inner = F.array_sort(F.array_distinct("deciles"))
    edges = F.when(F.coalesce(F.size(inner), F.lit(0)) >= 2, inner).otherwise(equal)
    constant = F.coalesce(F.col("high") - F.col("low") <= 1e-12, F.lit(True))
    out = g.withColumn("edges", F.when(constant, F.array().cast("array<double>")).otherwise(edges)).withColumn("constant", constant).drop("deciles")
    return written(out, "reference")  # a row a feature, read again and again


def bin_of(value: Column, edges: Column) -> Column:
    """The number of inner edges that a value exceeds; the outer bins are open."""
    return F.size(F.filter(edges, lambda e: value > e))


def with_frequencies(reference: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The reference with the frequency of each of its bins, so that drift needs no reference rows later."""
    f = bin_frequencies(df, reference, columns).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "frequency"))).alias("frequencies"))
    return reference.join(f, "feature", "left")


def bin_frequencies_of(reference: DataFrame) -> DataFrame:
    """(feature, bin, frequency) as stored by with_frequencies()."""
    return reference.select("feature", F.inline("frequencies"))


def bin_frequencies(df: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, bin, frequency): values dealt into the reference's bins; bins without any are left out."""
    long = unpivot(df, columns).withColumn("value", finite("value")).filter("value is not null")
    b = long.join(F.broadcast(reference.select("feature", "edges")), "feature")  # one row a feature
    g = b.groupBy("feature", bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("feature", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias("frequency"))


def categorical_reference(df: DataFrame, column: str, most: int = 12) -> DataFrame:
    """REF2: (feature, category, proportion) of a column of at most `most` categories."""
    g = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy()
    g = g.withColumn("proportion", F.col("n") / F.sum("n").over(all_)).withColumn("_k", F.count(F.lit(1)).over(all_))
    return g.filter(F.col("_k") <= most).select(F.lit(column).alias("feature"), "category", "n", "proportion")


def every_kth(df: DataFrame, order: Sequence[str], cap: int) -> DataFrame:
    """REF3: evenly spaced rows of a declared order, at most `cap` (the sampling operator's own limit).

    The first column of the order is a number; rows without it are left out.
    """
    rows = running(df, order[0], {"_rn": F.lit(1)}, ties=order[1:], totals=True)
    step = F.greatest(F.ceil(F.col("total__rn") / cap), F.lit(1))
    return rows.filter((F.col("_rn") - 1) % step == 0).drop("_rn", "total__rn")


def reference_rows(df: DataFrame, splits: Sequence[str] = ("train",)) -> DataFrame:
    """REF4: never the test rows."""
    return df.filter(F.col("split").isin(*[s for s in splits if s != "test"]))


def current_batch(df: DataFrame, rows: int = 10, entity: str = "battery_id", order: str = "cycle_index") -> DataFrame:
    """REF5: the last rows of each entity."""
    w = Window.partitionBy(entity).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rows).drop("_rn")


def aligned(reference: DataFrame, current: DataFrame, floor: float = 1e-6) -> DataFrame:
    """(feature, bin, r, c): both frequencies of every bin, clipped from below and scaled to one."""
    both = reference.select("feature", "bin", F.col("frequency").alias("r")).join(
        current.select("feature", "bin", F.col("frequency").alias("c")), ["feature", "bin"], "full_outer"
    )
    both = both.withColumns({k: F.greatest(F.coalesce(k, F.lit(0.0)), F.lit(floor)) for k in "rc"})
    own = Window.partitionBy("feature")
    return both.withColumns({k: F.col(k) / F.sum(k).over(own) for k in "rc"})


def population_stability(both: DataFrame) -> DataFrame:
    """DRF1, DRF2: population stability index and Jensen-Shannon divergence (natural logarithm)."""
    r, c = F.col("r"), F.col("c")
    m = (r + c) / 2
    js = (r * F.log(r / m) + c * F.log(c / m)) / 2
    return both.groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"), F.sum(js).alias("js"))


def quantile_sample(reference: DataFrame, n: int = 200) -> DataFrame:
    """DRF3: (feature, value): n points on the line through each feature's stored quantiles, from the first level to the last."""
    low, high = QUANTILES[0], QUANTILES[-1]
    level = F.lit(low) + F.col("i") * ((high - low) / (n - 1))
    points = reference.filter(F.size("quantiles") > 0).select("feature", "quantiles", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("p", level)
    value = F.element_at("quantiles", len(QUANTILES))
    for k in range(len(QUANTILES) - 2, -1, -1):
        (p0, p1), v0, v1 = QUANTILES[k : k + 2], F.col("quantiles")[k], F.col("quantiles")[k + 1]
        value = F.when(F.col("p") <= p1, v0 + (v1 - v0) * ((F.col("p") - p0) / (p1 - p0))).otherwise(value)
    return points.select("feature", value.alias("value"))


def two_sample(a: DataFrame, b: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """DRF3, DRF4: Kolmogorov-Smirnov statistic and Wasserstein-1 distance, from running counts over ranges of distinct values."""
    keys = list(by)
    rows = a.select(*keys, F.col(value).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(*keys, value, F.lit(0), F.lit(1)))
    g = rows.filter("v is not null").groupBy(*keys, "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    g = running(g, "v", {"_x": F.col("x"), "_y": F.col("y")}, keys, totals=True, following="_after")
    d = F.abs(F.col("_x") / F.col("total__x") - F.col("_y") / F.col("total__y"))
    g = g.select(*keys, "x", "y", d.alias("d"), (F.col("_after") - F.col("v")).alias("step"))
    return g.groupBy(*keys).agg(F.max("d").alias("ks"), F.coalesce(F.sum(F.col("d") * F.col("step")), F.lit(0.0)).alias("wasserstein"), F.sum("x").alias("n"), F.sum("y").alias("m"))


def ks_p(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """DRF3: the asymptotic two-sided p-value of a two-sample statistic."""
    n, m = n.cast("double"), m.cast("double")
    en = F.sqrt(n * m / (n + m))
    t = (en + 0.12 + 0.11 / en) * d
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(terms - 1)), F.lit(0.0), lambda acc, k: acc + F.exp(-2.0 * k * k * t * t) * F.when(k % 2 == 1, 2.0).otherwise(-2.0))
    return F.when(t < 0.2, 1.0).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def chi_square(reference: DataFrame, current: DataFrame) -> DataFrame:
    """DRF5: statistic of the 2 x K table (Yates for K = 2), its degrees of freedom, and the rate of unseen categories."""
    both = reference.select("category", F.col("n").alias("a")).join(current.select("category", F.col("n").alias("b")), "category", "full_outer")
    both = both.withColumn("unseen", F.col("a").isNull()).withColumns({k: F.coalesce(k, F.lit(0)) for k in "ab"})
    all_ = Window.partitionBy()
    a, b = F.sum("a").over(all_), F.sum("b").over(all_)
    rows = both.select("*", a.alias("total_a"), b.alias("total_b"), F.count(F.lit(1)).over(all_).alias("k"))
    share = (F.col("a") + F.col("b")) / (F.col("total_a") + F.col("total_b"))

    def part(n: str, total: str) -> Column:
        e = F.col(total) * share
        off = F.abs(F.col(n) - e)
        off = F.when(F.col("k") == 2, F.greatest(off - 0.5, F.lit(0.0))).otherwise(off)
        return off * off / e

    return rows.agg(
        F.sum(part("a", "total_a") + part("b", "total_b")).alias("chi2"), (F.max("k") - 1).alias("dof"),
        (F.sum(F.when(F.col("unseen"), F.col("b")).otherwise(0)) / F.max("total_b")).alias("unseen_rate"),
    )


def log_gamma_half(dof: Column) -> Column:
    """ln gamma(dof / 2) of a positive integer, by its recurrence."""
    odd = dof % 2 == 1
    steps = F.when(dof > 2, F.sequence(F.lit(1), F.ceil(dof / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    start = F.when(odd, F.lit(0.5 * math.log(math.pi))).otherwise(F.lit(0.0))
    return F.aggregate(steps, start, lambda acc, i: acc + F.log(i - F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))))


def chi_square_p(x: Column, dof: Column, terms: int = 400) -> Column:
    """DRF5: the upper tail of the chi-square distribution, the regularised incomplete gamma function at (dof / 2, x / 2).

    By its series below the mean and by its continued fraction, from the far end, above it.
    """
    a, h = dof / 2.0, x / 2.0
    scale = F.exp(-h + a * F.log(h) - log_gamma_half(dof))
    first = F.struct((F.lit(1.0) / a).alias("term"), (F.lit(1.0) / a).alias("total"))

    def grow(acc: Column, k: Column) -> Column:
        term = acc["term"] * h / (a + k)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), first, grow, lambda acc: acc["total"])
    ladder_up = F.sequence(F.lit(terms), F.lit(1), F.lit(-1))
    fraction = F.aggregate(ladder_up, h + 2 * terms + 1 - a, lambda t, i: h + 2 * i - 1 - a - i * (i - a) / t)
    tail = F.when(h < a + 1, 1 - series * scale).otherwise(scale / fraction)
    return F.when(dof >= 1, F.when(x <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0))))


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, category, n) of all columns in one pass, nulls left out; small groups before any shuffle."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in columns])
    return df.select(F.inline(rows)).filter("category IS NOT NULL").groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))


def categorical_references(df: DataFrame, columns: Sequence[str], most: int = 12) -> DataFrame:
    """REF2: (feature, category, n, proportion) of the columns of at most `most` categories."""
    own = Window.partitionBy("feature")
    g = category_counts(df, columns).withColumn("proportion", F.col("n") / F.sum("n").over(own)).withColumn("_k", F.count(F.lit(1)).over(own))
    return g.filter(F.col("_k") <= most).drop("_k")


def categorical_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], min_rows: int = 30) -> DataFrame:
    """DRF7: (feature, metric, value, p_value) of categorical features: chi2 and unseen_rate, or why there are none.

    reference: from categorical_references(); columns: those of the batch. All features are
    counted in one pass and tested as 2 x K tables of one joined table (Yates for K = 2).
    A feature that the batch lacks is a row `missing`; one with fewer than min_rows values,
    or with a single category in the reference, `small_sample`, or `constant` if it has no
    value at all. chi2 is null where both samples have the same single category.
    """
    have = [c for c in columns if c in current.columns]
    now = category_counts(current, have) if have else reference.limit(0).select("feature", "category", "n")
    both = reference.select("feature", "category", F.col("n").alias("a")).join(now.select("feature", "category", F.col("n").alias("b")), ["feature", "category"], "full_outer")
    own = Window.partitionBy("feature")
    known = F.max(F.col("a").isNotNull()).over(own)
    both = both.withColumns({"known": known, "unseen": F.col("a").isNull()}).filter("known").withColumns({k: F.coalesce(k, F.lit(0)) for k in "ab"})
    both = both.withColumns({"total_a": F.sum("a").over(own), "total_b": F.sum("b").over(own), "k": F.count(F.lit(1)).over(own)})
    share = (F.col("a") + F.col("b")) / (F.col("total_a") + F.col("total_b"))

    def part(n: str, total: str) -> Column:
        e = F.col(total) * share
        off = F.abs(F.col(n) - e)
        off = F.when(F.col("k") == 2, F.greatest(off - 0.5, F.lit(0.0))).otherwise(off)
        return F.when(F.col("k") > 1, F.try_divide(off * off, e))

    g = both.groupBy("feature").agg(
        F.sum(part("a", "total_a") + part("b", "total_b")).alias("chi2"), F.max("k").alias("k"), F.count_if(~F.col("unseen")).alias("known"), F.max("total_b").alias("sample"),
        F.try_divide(F.sum(F.when(F.col("unseen"), F.col("b")).otherwise(0)), F.max("total_b")).alias("unseen_rate"),
    )
    gone = ~F.col("feature").isin(*have) if have else F.lit(True)
    odd = ladder((gone, "missing"), (F.col("sample") == 0, "constant"), ((F.col("sample") < min_rows) | (F.col("known") < 2), "small_sample"))
    g = g.withColumn("odd", odd)
    none = F.lit(None).cast("double")
    row = lambda k, v, p: F.struct(k.alias("metric"), v.cast("double").alias("value"), p.alias("p_value"))
    tests = F.when(F.col("odd").isNotNull(), F.array(row(F.col("odd"), none, none))).otherwise(
        F.array(row(F.lit("chi2"), F.col("chi2"), chi_square_p(F.col("chi2"), (F.col("k") - 1).cast("int"))), row(F.lit("unseen_rate"), F.col("unseen_rate"), none))
    )
    return g.select("feature", F.inline(tests))


def adjust_p(tests: DataFrame, how: str = "bh", p: str = "p_value") -> DataFrame:
    """DRF6: Benjamini-Hochberg or Bonferroni over the tests that have a p-value; `none` leaves all unadjusted (null)."""
    if how == "none":
        return tests.withColumn("adjusted", F.lit(None).cast("double"))
    has = F.col(p).isNotNull()
    part = Window.partitionBy(has)
    n = F.count(p).over(part)
    if how == "bonferroni":
        return tests.withColumn("adjusted", F.when(has, F.least(F.col(p) * n, F.lit(1.0))))
    order = part.orderBy(p, "feature")  # one row a feature and test
    tests = tests.withColumn("_q", F.when(has, F.col(p) * n / F.row_number().over(order)))
    # From the largest p down, so that the frame grows row by row; one that ends at the last row is taken anew for each.
    least = F.min("_q").over(part.orderBy(F.desc(p), F.desc("feature")).rowsBetween(Window.unboundedPreceding, 0))
    return tests.withColumn("adjusted", F.when(has, F.least(least, F.lit(1.0)))).drop("_q")


#: Fixed values of the surveyed drift policy: (warning, critical) of each metric and of the part of drifted features.
DRIFT_LEVELS = {"psi": (0.10, 0.25), "js": (0.10, 0.25), "ks": (0.10, 0.20), "wasserstein": (0.10, 0.25), "unseen_rate": (0.01, 0.05)}
DRIFTED_PARTS, ALPHA, LEAST_ROWS = (0.10, 0.25), 0.05, 30


def feature_drift(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], min_rows: int = LEAST_ROWS, how: str = "bh", alpha: float = ALPHA,
    categories: DataFrame | None = None, labels: Sequence[str] = (),
) -> DataFrame:
    """DRF7: a row a feature and metric: (feature, metric, value, p_value, adjusted, severity, reliable, drifted).

    With `categories`, from categorical_references(), and the batch's columns `labels`,
    categorical features are tested too, and p-values are adjusted over both kinds.

    reference: from numeric_reference(); columns: the batch's numeric columns. A feature
    that the batch lacks, one that the reference lacks, a constant reference and a small
    sample are rows of their own (metric missing, new, constant, small_sample), unscored.
    A metric with a p-value counts only if that is significant after adjustment.
    """
    have = [c for c in columns if c in current.columns]
    now = numeric_reference(current, have) if have else reference.limit(0)
    state = reference.select("feature", "constant", "std", "low", "high", F.lit(True).alias("_r")).join(
        now.select("feature", F.col("n").alias("sample")), "feature", "full_outer"
    )
    kind = ladder(
        (F.col("_r").isNull(), "new"), (F.col("sample").isNull(), "missing"), (F.col("constant"), "constant"), (F.col("sample") < min_rows, "small_sample"),
    )
    state = state.withColumn("kind", kind)
    odd = state.filter("kind IS NOT NULL").select("feature", F.col("kind").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("p_value"))
    sound = state.filter("kind IS NULL").select("feature", "std", "low", "high")
    known = reference.join(sound.select("feature"), "feature", "left_semi")
    both = aligned(bin_frequencies_of(reference), bin_frequencies(current, reference, have)).join(sound.select("feature"), "feature", "left_semi")
    bins = population_stability(both)
    long = unpivot(current, have).select("feature", finite("value").alias("value"))
    ts = two_sample(quantile_sample(known), long.join(sound.select("feature"), "feature", "left_semi"), by=["feature"]).join(sound, "feature")
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    scale = F.when(F.col("std") > 0, F.col("std")).otherwise(span)
    none = F.lit(None).cast("double")
    rows = lambda *xs: F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), p.alias("p_value")) for k, v, p in xs]))
    scored = bins.select("feature", rows(("psi", F.col("psi"), none), ("js", F.col("js"), none))).union(
        ts.select("feature", rows(("ks", F.col("ks"), ks_p(F.col("ks"), F.col("n"), F.col("m"))), ("wasserstein", F.col("wasserstein") / scale, none)))
    )
    tests = scored.union(odd)
    if categories is not None:
        tests = tests.unionByName(categorical_drift(categories, current, labels, min_rows))
    return drift_severity(adjust_p(tests, how), alpha)


def drift_severity(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """DRF7: tests (feature, metric, value, p_value, adjusted) with severity, reliability and whether they show drift.

    chi2 has no levels of its own: it warns where its p-value is at most alpha.
    """
    level = lambda i: F.create_map(*[F.lit(x) for k, v in DRIFT_LEVELS.items() for x in (k, v[i])])[F.col("metric")]
    sig = F.coalesce(F.col("adjusted") <= alpha, F.lit(True))
    value = F.col("value")
    severity = ladder(
        ((F.col("metric") == "chi2") & value.isNull(), "ok"), (value.isNull(), "unknown"), ((F.col("metric") == "chi2") & (F.col("p_value") <= alpha) & sig, "warning"),
        ((value >= level(1)) & sig, "critical"), ((value >= level(0)) & sig, "warning"), otherwise="ok",
    )
    return tests.withColumn("severity", severity).withColumn("reliable", value.isNotNull()).withColumn("drifted", F.col("severity").isin("warning", "critical"))


def fleet_drift(tests: DataFrame) -> DataFrame:
    """DRF7: features that could be tested, those that drifted by any metric, and the fleet's status.

    Critical: enough of them drifted, or one critically; warning: any drifted.
    """
    own = tests.groupBy("feature").agg(
        F.max(F.col("reliable").cast("int")).alias("t"), F.max(F.col("drifted").cast("int")).alias("d"), F.max((F.col("severity") == "critical").cast("int")).alias("c")
    )
    out = own.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_drifted"), F.coalesce(F.max("c"), F.lit(0)).alias("_c"), F.count_if(F.col("t") == 0).alias("n_skipped"))
    part = F.coalesce(F.try_divide("n_drifted", "n"), F.lit(0.0))
    status = ladder(
        (F.col("n") == 0, "unknown"), ((part >= DRIFTED_PARTS[1]) | (F.col("_c") == 1), "critical"), ((part >= DRIFTED_PARTS[0]) | (F.col("n_drifted") > 0), "warning"), otherwise="ok",
    )
    return out.select("n", "n_drifted", "n_skipped", part.alias("fraction"), status.alias("status"))


#: Fixed values of the surveyed prediction-drift policy: levels of summaries, least scored rows, (warning, critical) of each metric.
SUMMARY_LEVELS, LEAST_SCORED, BINS = {"q5": 0.05, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q95": 0.95}, 20, 10
SHIFT_LEVELS = {"mean_shift": (0.25, 0.50), "quantile_shift": (0.25, 0.50), "psi": (0.10, 0.25), "class_distance": (0.15, 0.30), "width_ratio": (1.25, 1.75)}


def prediction_summary(df: DataFrame, outputs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """PDR1: a row an output: count, moments, ends and quantiles. Without groups the quantiles are selected in passes."""
    moments = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "least": F.min, "most": F.max}
    if by:
        long = unpivot(df, outputs, by).withColumn("value", finite("value"))
        return long.groupBy(*by, F.col("feature").alias("output")).agg(
            *[f("value").alias(k) for k, f in moments.items()], *[F.percentile("value", F.lit(q)).alias(k) for k, q in SUMMARY_LEVELS.items()]
        )
    held = exact_quantiles(df, outputs, tuple(SUMMARY_LEVELS.values())).select("feature", *[F.col("quantiles")[i].alias(k) for i, k in enumerate(SUMMARY_LEVELS)])
    out = per_column(df, outputs, **{k: (lambda c, f=f: f(finite(c))) for k, f in moments.items()}).join(F.broadcast(held), "feature")  # a row an output
    return out.withColumnRenamed("feature", "output")


def output_histograms(df: DataFrame, summary: DataFrame, outputs: Sequence[str], bins: int = BINS) -> DataFrame:
    """PDR1: (output, bin, frequency) of equal widths from each output's least to its most; one bin where these are equal."""
    span = summary.select("output", "least", "most")
    long = unpivot(df, outputs).select(F.col("feature").alias("output"), finite("value").alias("v")).filter("v IS NOT NULL").join(F.broadcast(span), "output")  # a row an output
    at = F.least(F.floor((F.col("v") - F.col("least")) * bins / (F.col("most") - F.col("least"))), F.lit(bins - 1))
    flat = F.col("most") - F.col("least") <= 1e-8 + 1e-5 * F.abs("most")
    g = long.groupBy("output", F.when(flat, 0).otherwise(at).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("output", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("output"))).alias("frequency"))


def output_psi(reference: DataFrame, current: DataFrame, r_bins: DataFrame, c_bins: DataFrame, bins: int = BINS) -> DataFrame:
    """PDR3: (output, psi): the current histograms dealt into the reference's bins by the centres of theirs."""
    ends = lambda d, k: d.select("output", F.col("least").alias(f"{k}0"), F.col("most").alias(f"{k}1"))
    flat = lambda k: F.col(f"{k}1") - F.col(f"{k}0") <= 1e-8 + 1e-5 * F.abs(f"{k}1")
    span = F.broadcast(ends(reference, "r").join(ends(current, "c"), "output"))  # a row an output
    moved = c_bins.join(span, "output")
    width = F.when(flat("c"), F.col("c1") - F.col("c0")).otherwise((F.col("c1") - F.col("c0")) / bins)
    centre = F.col("c0") + (F.col("bin") + 0.5) * width
    at = F.least(F.greatest(F.floor((centre - F.col("r0")) * bins / (F.col("r1") - F.col("r0"))), F.lit(0)), F.lit(bins - 1))
    moved = moved.groupBy("output", F.when(flat("r"), 0).otherwise(at).cast("int").alias("bin")).agg(F.sum("frequency").alias("frequency"))
    named = lambda d: d.withColumnRenamed("output", "feature")
    return population_stability(aligned(named(r_bins), named(moved))).select(F.col("feature").alias("output"), "psi")


def class_frequencies(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """PDR1: (output, class, frequency) of all class columns in one pass."""
    g = category_counts(df, classes)
    return g.select(F.col("feature").alias("output"), F.col("category").alias("class"), (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias("frequency"))


def prediction_drift(
    reference: DataFrame, current: DataFrame, outputs: Sequence[str], classes: Sequence[str] = (), width: str = "interval_width", min_rows: int = LEAST_SCORED
) -> DataFrame:
    """PDR2, PDR3, PDR4: the report: (output, metric, value, severity, drifted) for scored rows of two batches.

    By numeric output the shift of the mean and of the quantiles 0.1, 0.5 and 0.9 in
    standard deviations of the reference (its span where that is 0, else 1) and the
    stability index over the reference's bins; the ratio of median widths; by class column
    the total variation distance. Outputs that either batch lacks are left out. With fewer
    than min_rows current rows there are no rows at all.
    """
    r, c = prediction_summary(reference, outputs), prediction_summary(current, outputs)
    both = r.select("output", F.struct(*r.columns[1:]).alias("r")).join(c.select("output", F.struct(*c.columns[1:]).alias("c")), "output")
    both = both.filter((F.col("r.n") > 0) & (F.col("c.n") > 0))
    span = F.when(F.col("r.most") > F.col("r.least"), F.col("r.most") - F.col("r.least")).otherwise(1.0)
    scale = F.when(F.col("r.std") > 0, F.col("r.std")).otherwise(span)
    shift = lambda k: F.abs(F.col(f"c.{k}") - F.col(f"r.{k}")) / scale
    row = lambda name, k, v: F.struct(name.alias("output"), F.lit(k).alias("metric"), v.alias("value"))
    tests = [row(F.col("output"), "mean_shift", shift("mean"))]
    tests += [row(F.concat("output", F.lit(f"[{k}]")), "quantile_shift", shift(k)) for k in ("q10", "q50", "q90")]
    found = both.select(F.inline(F.array(*tests)))
    psi = output_psi(r, c, output_histograms(reference, r, outputs), output_histograms(current, c, outputs))
    found = found.unionByName(psi.select("output", F.lit("psi").alias("metric"), F.col("psi").alias("value")))
    if width in outputs:
        positive = (F.col("r.q50") > 0) & (F.col("c.q50") != 0)
        found = found.unionByName(both.filter((F.col("output") == width) & positive).select("output", F.lit("width_ratio").alias("metric"), (F.col("c.q50") / F.col("r.q50")).alias("value")))
    if classes:
        a, b = class_frequencies(reference, classes), class_frequencies(current, classes)
        pair = a.withColumnRenamed("frequency", "a").join(b.withColumnRenamed("frequency", "b"), ["output", "class"], "full_outer")
        g = pair.groupBy("output").agg(F.count("a").alias("ka"), F.count("b").alias("kb"), (0.5 * F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).alias("value"))
        found = found.unionByName(g.filter("ka > 0 AND kb > 0").select("output", F.lit("class_distance").alias("metric"), "value"))
    enough = current.agg((F.count(F.lit(1)) >= min_rows).alias("enough"))
    level = lambda i: F.create_map(*[F.lit(x) for k, v in SHIFT_LEVELS.items() for x in (k, v[i])])[F.col("metric")]
    value = F.col("value")
    severity = ladder((value.isNull() | F.isnan("value"), "unknown"), (value >= level(1), "critical"), (value >= level(0), "warning"), otherwise="ok")
    found = found.join(F.broadcast(enough), F.col("enough"), "inner").drop("enough")  # one row
    return found.withColumn("severity", severity).withColumn("drifted", F.col("severity").isin("warning", "critical"))


def prediction_status(tests: DataFrame) -> DataFrame:
    """PDR2: one row: the worst severity of a prediction_drift() report, unknown without tests, and how many outputs drifted."""
    rank = F.create_map(*[F.lit(x) for kv in {"ok": 0, "unknown": 1, "warning": 2, "critical": 3}.items() for x in kv])[F.col("severity")]
    return tests.agg(F.coalesce(F.max_by("severity", rank), F.lit("unknown")).alias("status"), F.count_if("drifted").alias("n_drifted"), F.count(F.lit(1)).alias("n_tests"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """PDR1: (bin, n) of equal widths; the ends take what lies outside."""
    b = F.least(F.greatest(F.floor((F.col(value) - low) * bins / (high - low)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def prediction_shift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """PDR2: standardised shifts of mean, median and tails between two summaries."""
    c = current.select("output", *[F.col(x).alias(f"c_{x}") for x in ("mean", "q5", "q50", "q95")])
    shift = lambda x: F.try_divide(F.col(f"c_{x}") - F.col(x), "std")
    return reference.join(c, "output").select("output", *[shift(x).alias(f"{x}_shift") for x in ("mean", "q5", "q50", "q95")])


def rebinned_psi(reference: DataFrame, current: DataFrame, low: float, high: float, c_low: float, c_high: float, bins: int = 10) -> DataFrame:
    """PDR3: stability index of two histograms, the current one re-binned by the centres of its bins."""
    centre = c_low + (F.col("bin") + 0.5) * (c_high - c_low) / bins
    at = F.least(F.greatest(F.floor((centre - low) * bins / (high - low)), F.lit(0)), F.lit(bins - 1)).cast("int")
    total = Window.partitionBy()
    f = lambda d: d.select(F.lit("all").alias("feature"), "bin", (F.col("n") / F.sum("n").over(total)).alias("frequency"))
    moved = current.withColumn("bin", at).groupBy("bin").agg(F.sum("n").alias("n"))
    return population_stability(aligned(f(reference), f(moved))).select("psi")


def class_distance(reference: DataFrame, current: DataFrame, c: str) -> DataFrame:
    """PDR4: total variation distance of class frequencies."""
    total = Window.partitionBy()
    f = lambda d, n: d.groupBy(c).agg(F.count(F.lit(1)).alias("k")).select(c, (F.col("k") / F.sum("k").over(total)).alias(n))
    both = f(reference, "a").join(f(current, "b"), c, "full_outer")
    return both.agg((0.5 * F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).alias("distance"))


def width_ratio(reference: DataFrame, current: DataFrame, c: str = "interval_width") -> DataFrame:
    """PDR4: the ratio of median interval widths."""
    m = lambda d, n: exact_quantiles(d, [c], (0.5,)).select(F.col("quantiles")[0].alias(n))
    return m(reference, "a").join(m(current, "b"), F.lit(True), "cross").select(F.try_divide("b", "a").alias("ratio"))  # one row each
