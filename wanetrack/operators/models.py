"""Baselines as window aggregates, and learned families on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.arrays import added_up, column_means, doubles, matrix, partials
from wanetrack.functions.exprs import finite, history, ladder, median, trailing
from wanetrack.functions.ranges import running
from wanetrack.operators.metrics import regression_metrics
from wanetrack.sources.tables import written


def cohort_median(train: DataFrame, life: str = "rul_raw_cycles", entity: str = "battery_id") -> DataFrame:
    """MDL1: the median over entities of their median life."""
    return train.groupBy(entity).agg(median(life).alias("m")).agg(median("m").alias("cohort_median"))


def fade_extrapolation(
    df: DataFrame, fallback: float, most: float, threshold: float = 1.4, rows: int = 20, min_points: int = 3,
    value: str = "capacity_ah", entity: str = "battery_id", order: str = "cycle_index",
) -> DataFrame:
    """MDL2: rows until the trailing line reaches the threshold; the fallback where it doesn't fall."""
    w = trailing(entity, order, rows)
    slope, cut = F.regr_slope(value, order).over(w), F.regr_intercept(value, order).over(w)
    hit = (threshold - F.col("_b")) / F.col("_a") - F.col(order)
    df = df.withColumn("_a", slope).withColumn("_b", cut).withColumn("_n", F.count(value).over(w))
    ok = (F.col("_n") >= min_points) & (F.col("_a") < -1e-9)
    raw = F.when(ok, hit).otherwise(F.lit(fallback))
    return df.withColumn("y_pred", F.least(F.greatest(raw, F.lit(0.0)), F.lit(most))).drop("_a", "_b", "_n")


def nearest_analogues(df: DataFrame, reference: DataFrame, k: int = 25, soh: str = "soh", rul: str = "rul", keys: Sequence[str] = ()) -> DataFrame:
    """JON7: the median remaining life of the k reference rows around the place of a row's health.

    One pass over ranges of health gives each row its place among the reference rows. The
    median from each place on is taken once, over blocks of places that reach k - 1 places
    into the next, and a row looks up the one where its k places, clipped at the ends, begin.
    """
    ref = reference.filter(finite(soh).isNotNull()).select(F.col(soh).alias("soh"), F.col(rul).alias("rul"))
    ranked = running(ref, "soh", {"pos": F.lit(1)}, ties=["rul"]).withColumn("pos", F.col("pos") - 1)
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    both = df.select(*keys, F.col(soh).alias(soh), F.lit(0).alias("_kind")).unionByName(
        ref.select(F.col("soh").alias(soh), F.lit(1).alias("_kind")), allowMissingColumns=True
    )
    placed = running(both, soh, {"at": F.col("_kind")}, ties=["_kind"]).filter("_kind = 0").join(F.broadcast(n), F.lit(True), "cross")  # n: one row
    low = F.greatest(F.least(F.col("at") - k // 2, F.col("n") - k), F.lit(0))
    size = max(4096, k)
    block = F.floor(F.col("pos") / size)
    begins = F.when((F.col("pos") % size < k - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    ahead = Window.partitionBy("_block").orderBy("pos").rowsBetween(0, k - 1)
    starts = ranked.withColumn("_block", F.explode(begins)).select("_block", "pos", median("rul").over(ahead).alias("y_pred"), F.count(F.lit(1)).over(ahead).alias("n_analogues"))
    starts = starts.filter(F.col("_block") == block).drop("_block")
    return placed.select(*keys, low.alias("pos")).join(starts, "pos").drop("pos")


REGRESSORS = ("linear", "ridge", "elastic_net", "random_forest", "boosted_trees")


def regressor(family: str, label: str, seed: int = 42):
    """MDL3."""
    from pyspark.ml import regression as R

    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "y_pred"}
    return {
        "linear": lambda: R.LinearRegression(**common, solver="normal"),
        "ridge": lambda: R.LinearRegression(**common, regParam=1.0, solver="normal"),
        "elastic_net": lambda: R.LinearRegression(**common, regParam=0.1, elasticNetParam=0.5, maxIter=30),
        "random_forest": lambda: R.RandomForestRegressor(**common, numTrees=10, maxDepth=5, seed=seed),
        "boosted_trees": lambda: R.GBTRegressor(**common, maxIter=5, maxDepth=3, seed=seed),
    }[family]()


def pipeline(family: str, columns: Sequence[str], label: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"{c}_filled" for c in columns]
    return Pipeline(stages=[
        Imputer(inputCols=list(columns), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="features"), regressor(family, label),
    ])


def risk_classifier(columns: Sequence[str], label: str):
    """MDL3: logistic regression with weights that balance the classes (column `weight`)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip"),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=20),
    ])


def balanced(df: DataFrame, label: str) -> DataFrame:
    n = Window.partitionBy(label)
    return df.withColumn("weight", F.count(F.lit(1)).over(Window.partitionBy()) / (2.0 * F.count(F.lit(1)).over(n)))


def fold_rows(df: DataFrame, folds: DataFrame, columns: Sequence[str], label: str, entity: str = "battery_id", order: str = "cycle_index") -> DataFrame:
    """The labelled rows with their fold, only what fits need, written once: a fit passes over its rows several times, and whatever made them would run each time."""
    return written(df.join(folds, entity).filter(F.col(label).isNotNull()).select(*dict.fromkeys([entity, order, "fold", label, *columns])), "folds")


def _fold_predictions(rows: DataFrame, held: Sequence[int], family: str, columns: Sequence[str], label: str, entity: str) -> DataFrame:
    """The rows of each held fold, predicted by a model of the other folds' rows."""
    out = None
    for f in held:
        model = pipeline(family, columns, label).fit(rows.filter(F.col("fold") != f))
        part = model.transform(rows.filter(F.col("fold") == f)).select(
            entity, "cycle_index", "fold", F.col(label).cast("double").alias("y_true"), "y_pred", F.lit(family).alias("model")
        )
        out = part if out is None else out.unionByName(part)
    return out


def out_of_fold(df: DataFrame, folds: DataFrame, k: int, family: str | Sequence[str], columns: Sequence[str], label: str, entity: str = "battery_id") -> DataFrame:
    """MDL4: predictions of every row by a model that has not seen its entity, by one family or several. One fit a fold and family; k is small."""
    rows = fold_rows(df, folds, columns, label, entity)
    families = [family] if isinstance(family, str) else family
    return reduce(DataFrame.unionByName, [_fold_predictions(rows, range(k), x, columns, label, entity) for x in families])


def _moments(df: DataFrame, columns: Sequence[str], label: str, entity: str) -> tuple[DataFrame, np.ndarray]:
    """(entity, sums) and a shift: count, sums and cross products of (columns, label), less the shift, over each entity's complete rows.

    Tasks add up what they read entity by entity, so a large entity costs a task no more
    than its own rows, and only one short array an entity and batch leaves it.
    """
    used = [*columns, label]
    names = [f"_{i}" for i in range(len(used))]
    shift = column_means(df, used)

    def run(batches):
        for batch in batches:
            x = matrix(batch, names) - shift
            ok = np.isfinite(x).all(axis=1)
            if not ok.any():
                continue
            x = np.column_stack([np.ones(ok.sum()), x[ok]])
            coded = batch.column(0).filter(pa.array(ok)).dictionary_encode()
            which = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(which, kind="stable")
            x, which = x[order], which[order]
            cuts = np.flatnonzero(np.diff(which, prepend=-1))
            found = [coded.dictionary[int(which[c])].as_py() if which[c] < len(coded.dictionary) else None for c in cuts]
            sums = [(r.T @ r).ravel() for r in np.split(x, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(found, coded.dictionary.type), pa.array(sums, pa.list_(pa.float64()))], names=["entity", "sums"])

    kind = dict(df.dtypes)[entity]
    return added_up(partials(doubles(df, used, [entity]), run, f"entity {kind}, sums array<double>"), "entity"), shift


def leave_one_out_ridge(df: DataFrame, columns: Sequence[str], label: str, reg: float = 1.0, entity: str = "battery_id") -> DataFrame:
    """MDL4: (entity, n_train, intercept, coefficients) of the ridge fit to all other entities' complete rows, for every entity.

    One aggregation serves all fits: an entity's cross products are taken off the total,
    and a small system is solved a row. The penalty is that of the library's linear
    regression: reg / 2 times the squares of the coefficients of standardised columns. A
    column that is constant among the others has coefficient 0; an entity without others
    has null coefficients.
    """
    d = len(columns)
    sums, shift = _moments(df, columns, label, entity)
    kind = dict(df.dtypes)[entity]
    total = added_up(sums.select(F.lit(0).alias("k"), "sums", (F.abs(F.xxhash64("entity")) % 4096).cast("int").alias("part")), "k").select(F.col("sums").alias("total"))

    def run(batches):
        for batch in batches:
            n_train, cut, weights = [], [], []
            for mine, whole in zip(batch.column(1), batch.column(2), strict=True):
                g = np.array(whole.as_py()).reshape(d + 2, -1) - np.array(mine.as_py()).reshape(d + 2, -1)
                n = int(round(g[0, 0]))
                n_train.append(n)
                if n < 1:
                    cut.append(None)
                    weights.append(None)
                    continue
                mean = g[0, 1:] / n
                cov = g[1:, 1:] / n - np.outer(mean, mean)
                var = np.maximum(np.diag(cov), 0)
                live = np.flatnonzero(var[:d] > 1e-12 * np.diag(g)[1:-1] / n)
                w = np.zeros(d)
                if len(live) and var[d] > 0:
                    a = cov[np.ix_(live, live)] + np.diag(reg * var[live] / np.sqrt(var[d]))
                    size = np.sqrt(var[live])
                    w[live] = np.linalg.lstsq(a / np.outer(size, size), cov[live, d] / size, rcond=None)[0] / size
                weights.append(w.tolist())
                cut.append(float(mean[d] + shift[d] - w @ (mean[:d] + shift[:d])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_train, pa.int64()), pa.array(cut, pa.float64()), pa.array(weights, pa.list_(pa.float64()))],
                names=["entity", "n_train", "intercept", "coefficients"],
            )

    fits = sums.join(F.broadcast(total), F.lit(True)).mapInArrow(run, f"entity {kind}, n_train long, intercept double, coefficients array<double>")  # total: one row
    return fits.withColumnRenamed("entity", entity)


def leave_one_out(df: DataFrame, columns: Sequence[str], label: str, reg: float = 1.0, entity: str = "battery_id", order: str = "cycle_index") -> DataFrame:
    """MDL4: every labelled row predicted by the ridge fit without its entity; null where a column is missing or nothing else was complete."""
    rows = df.filter(F.col(label).isNotNull())
    fits = leave_one_out_ridge(rows, columns, label, reg, entity)
    p = reduce(lambda acc, i: acc + F.col("coefficients")[i] * finite(columns[i]), range(len(columns)), F.col("intercept"))
    return rows.join(fits, entity, "left").select(entity, order, F.col(label).cast("double").alias("y_true"), p.alias("y_pred"), F.lit("ridge").alias("model"))


def select_family(predictions: DataFrame, metric: str = "mae") -> DataFrame:
    """MDL5: the families ranked by their pooled out-of-fold error."""
    m = regression_metrics(predictions, ["model"])
    return m.select("model", "n", metric, F.row_number().over(Window.orderBy(metric, "model")).alias("rank"))


def nested_selection(
    df: DataFrame, folds: DataFrame, k: int, families: Sequence[str], columns: Sequence[str], label: str, metric: str = "mae", entity: str = "battery_id"
) -> DataFrame:
    """MDL5: by outer fold the family that the other folds choose by their own out-of-fold error, and its error on the fold.

    The inner choice never sees the outer fold. k and the number of families are small;
    each fit is a Spark job over all rows.
    """
    chosen, rows = [], fold_rows(df, folds, columns, label, entity)
    for f in range(k):
        inner = rows.filter(F.col("fold") != f)
        tried = [_fold_predictions(inner, [i for i in range(k) if i != f], x, columns, label, entity) for x in families]
        best = select_family(reduce(DataFrame.unionByName, tried), metric).filter("rank = 1").first()  # one row
        out = _fold_predictions(rows, [f], best["model"], columns, label, entity)
        m = regression_metrics(out, ["fold"]).select(
            F.lit(f).alias("fold"), F.lit(best["model"]).alias("model"), F.lit(best[metric]).alias(f"inner_{metric}"), F.col(metric).alias(f"outer_{metric}"), "n"
        )
        chosen.append(m)
    return reduce(DataFrame.unionByName, chosen)


def selection_frequency(picks: DataFrame) -> DataFrame:
    """MDL5: (model, n, frequency) over outer folds."""
    g = picks.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "model")


def search(df: DataFrame, columns: Sequence[str], label: str, reg: Sequence[float] = (0.01, 1.0), k: int = 3):
    """MDL6: the best ridge strength by entity-grouped folds (integer column `fold`)."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    lr = LinearRegression(featuresCol="features", labelCol=label, predictionCol="y_pred")
    cv = CrossValidator(
        estimator=lr, estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, list(reg)).build(), numFolds=k, foldCol="fold", parallelism=2,
        evaluator=RegressionEvaluator(labelCol=label, predictionCol="y_pred", metricName="mae"),
    )
    rows = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(written(df.filter(F.col(label).isNotNull()).select("fold", label, *columns), "search"))
    fitted = cv.fit(rows)
    return [(r, m) for r, m in zip(reg, fitted.avgMetrics, strict=True)]


def scored_cycles(df: DataFrame, prediction: str = "y_pred", warmup: int = 10, label: str | None = None, order: str = "cycle_index") -> DataFrame:
    """MDL7."""
    p = F.when(F.col(order) > warmup, F.col(prediction))
    df = df.withColumn("is_warmup", F.col(order) <= warmup).withColumn(prediction, p).withColumn("predicted_eol", F.col(order) + p)
    if label:
        df = df.withColumn("residual", F.col(prediction) - F.col(label)).withColumn("abs_error", F.abs("residual"))
    return df


def permuted(df: DataFrame, c: str, seed: int = 1, entity: str = "battery_id", order: str = "cycle_index") -> DataFrame:
    """XPL1: the column shuffled within each entity."""
    nat = df.withColumn("_i", F.row_number().over(history(entity, order)))
    mix = df.select(entity, F.col(c).alias("_v"), F.row_number().over(Window.partitionBy(entity).orderBy(F.xxhash64(F.lit(seed), F.lit(c), order), order)).alias("_i"))
    return nat.drop(c).join(mix, [entity, "_i"]).withColumnRenamed("_v", c).drop("_i")


def permutation_importance(df: DataFrame, model, columns: Sequence[str], label: str, seed: int = 1) -> DataFrame:
    """XPL1: (feature, delta_rmse): how much the error grows when the feature is shuffled within entities."""
    rmse = lambda d: d.agg(F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col(label), 2))).alias("rmse"))
    base = rmse(model.transform(df)).withColumnRenamed("rmse", "base")
    out = None
    for c in columns:
        one = rmse(model.transform(permuted(df, c, seed))).select(F.lit(c).alias("feature"), "rmse")
        out = one if out is None else out.union(one)
    return out.join(F.broadcast(base), F.lit(True), "cross").select("feature", (F.col("rmse") - F.col("base")).alias("delta_rmse"))  # one row


def ablation(df: DataFrame, model, columns: Sequence[str], keys: Sequence[str], k: int = 3) -> DataFrame:
    """XPL2: by row the k features whose setting to 0 changes the prediction most, signed. One scoring for all."""
    which = F.explode(F.array(F.lit(""), *map(F.lit, columns)))
    rows = df.withColumn("feature", which)
    rows = rows.withColumns({c: F.when(F.col("feature") == c, F.lit(0.0)).otherwise(F.col(c)) for c in columns})
    scored = model.transform(rows).select(*keys, "feature", "y_pred")
    base = F.max(F.when(F.col("feature") == "", F.col("y_pred"))).over(Window.partitionBy(*keys))
    scored = scored.withColumn("contribution", base - F.col("y_pred")).filter("feature != ''")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("contribution")), "feature"))
    return scored.select(*keys, "feature", "contribution", rank.alias("rank")).filter(F.col("rank") <= k)


def signal_family(c: str = "feature") -> Column:
    """XPL3: the signal behind a feature's name."""
    x = F.col(c)
    return ladder(
        (x.startswith("capacity") | x.startswith("soh"), "capacity"), (x.startswith("voltage"), "voltage"),
        (x.rlike("^(temperature|t_excess|ambient)"), "temperature"), (x.rlike("^(internal_resistance|r_times|c_over_r)"), "resistance"),
        (x.rlike("^(discharge|charge|cum_|energy)"), "duty"), (x.startswith("pos"), "age"), otherwise="other",
    )


def family_importance(importance: DataFrame, weight: str = "importance") -> DataFrame:
    """XPL3: (family, total, n, names): a feature table summed by signal family, with readable names, sorted."""
    rows = importance.withColumns({"family": signal_family(), "name": display_name()})
    return rows.groupBy("family").agg(F.sum(weight).alias("total"), F.count(F.lit(1)).alias("n"), F.concat_ws("; ", F.array_sort(F.collect_list("name"))).alias("names"))


def display_name(c: str = "feature") -> Column:
    x = F.regexp_replace(c, r"_roll(\d+)_(\w+)$", " rolling $2 ($1)")
    x = F.regexp_replace(x, r"_lag(\d+)$", " lag $1")
    x = F.regexp_replace(x, r"_slope(\d+)$", " slope ($1)")
    return F.regexp_replace(x, "_", " ")
