"""Conformal intervals by entity blocks and life stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.exprs import ladder
from wanetrack.functions.ranges import running
from wanetrack.operators.metrics import paired


def life_stage(soh: str = "soh") -> Column:
    """UNC3."""
    x = F.col(soh)
    return ladder((x.isNull(), "unknown"), (x >= 0.9, "early"), (x >= 0.8, "mid"), otherwise="late")


def conformal_quantile(scores: DataFrame, by: Sequence[str] = (), coverage: float = 0.9, score: str = "score") -> DataFrame:
    """UNC1: the order statistic at ceil(level * (n - 1)), level = min(ceil((n + 1) coverage) / n, 1)."""
    own = Window.partitionBy(*by)
    rows = scores.withColumn("_rn", F.row_number().over(own.orderBy(score)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    # (n + 1) * coverage is rounded first, so that 0.9 * 10 counts as 9
    level = F.least(F.ceil(F.round((F.col("_n") + 1) * coverage, 9)) / F.col("_n"), F.lit(1.0))
    at = F.ceil(F.round(level * (F.col("_n") - 1), 9))
    return rows.filter(F.col("_rn") == at).select(*by, F.col(score).alias("quantile"), F.col("_n").alias("n_scores"))


def block_scores(df: DataFrame, by: Sequence[str] = (), entity: str = "battery_id") -> DataFrame:
    """UNC2: the largest absolute residual of each entity."""
    rows = paired(df).withColumn("score", F.abs(F.col("y_pred") - F.col("y_true")))
    return rows.groupBy(*by, entity).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_rows"))


def stage_quantiles(df: DataFrame, coverage: float = 0.9, min_entities: int = 3, min_rows: int = 20) -> DataFrame:
    """UNC2: (stage, quantile); a stage with too little to go by takes the global quantile."""
    staged = df.withColumn("stage", life_stage())
    blocks = block_scores(staged, ["stage"])
    size = blocks.groupBy("stage").agg(F.count(F.lit(1)).alias("entities"), F.sum("n_rows").alias("rows"))
    own = conformal_quantile(blocks, ["stage"], coverage).select("stage", F.col("quantile").alias("own"))
    whole = conformal_quantile(block_scores(df), (), coverage).select(F.col("quantile").alias("global"))
    out = size.join(own, "stage").join(F.broadcast(whole), F.lit(True), "cross")  # one row
    enough = (F.col("entities") >= min_entities) & (F.col("rows") >= min_rows)
    return out.select("stage", F.when(enough, F.col("own")).otherwise(F.col("global")).alias("quantile"), (~enough).alias("fell_back"))


def apply_intervals(df: DataFrame, quantiles: DataFrame, prediction: str = "y_pred") -> DataFrame:
    """UNC4: lower and upper bounds, never below zero, with the point inside. quantiles: one row a stage, four at most."""
    rows = df.withColumn("stage", life_stage()).join(F.broadcast(quantiles.select("stage", "quantile")), "stage", "left")
    p = F.greatest(F.col(prediction), F.lit(0.0))
    return rows.withColumn("lower", F.greatest(p - F.col("quantile"), F.lit(0.0))).withColumn("upper", p + F.col("quantile")).withColumn("point", p)


def cross_conformal(df: DataFrame, coverage: float = 0.9, entity: str = "battery_id") -> DataFrame:
    """UNC5: (entity, quantile) from the block scores of all other entities, without a pair of entities in sight."""
    own = block_scores(df, (), entity).withColumn("_one", F.lit(1))
    found = F.broadcast(leave_one_out_quantiles(own, ["_one"], coverage, entity=entity))  # one row
    after = F.struct("score", entity) > F.col("pivot")
    return own.join(found, "_one").filter("entities > 1").select(entity, F.when(after, F.col("kept")).otherwise(F.col("next")).alias("quantile"))


def leave_one_out_quantiles(scores: DataFrame, by: Sequence[str], level: float = 0.9, score: str = "score", entity: str = "battery_id", rows: str = "n_rows") -> DataFrame:
    """A row a group: entities, rows, `whole`, the quantile of all scores, and what leaving one out makes of it.

    Of n scores in order (ties by entity), leaving one out moves the wanted order statistic
    by at most one place: scores after `pivot` leave `kept`, those up to it `next`. So no
    pair of entities is formed and a group has one short row. Ranks come from ranges of
    the scores, so a group of any size is spread over tasks.
    """
    ranked = running(scores, score, {"_at": F.lit(1)}, by, ties=[entity], totals=True).withColumn("_at", F.col("_at") - 1)

    def wanted(n: Column) -> Column:
        # (n + 1) * level is rounded first, so that 0.9 * 10 counts as 9
        share = F.least(F.ceil(F.round((n + 1) * level, 9)) / n, F.lit(1.0))
        return F.ceil(F.round(share * (n - 1), 9))

    n = F.col("total__at")
    place = lambda at, x: F.max(F.when(F.col("_at") == at, x))
    lone = wanted(n - 1)
    return ranked.groupBy(*by).agg(
        F.max(n).alias("entities"), F.sum(rows).alias("rows"), place(wanted(n), F.col(score)).alias("whole"),
        place(F.when(n > 1, lone), F.struct(score, entity)).alias("pivot"), place(F.when(n > 1, lone), F.col(score)).alias("kept"),
        place(F.when(n > 1, lone + 1), F.col(score)).alias("next"),
    )


def cross_conformal_intervals(
    df: DataFrame, level: float = 0.9, min_entities: int = 3, min_rows: int = 20, entity: str = "battery_id", prediction: str = "y_pred"
) -> DataFrame:
    """UNC5: df with stage, lower, upper, and source, from quantiles of all other entities' rows.

    A row's quantile is that of its stage (source `stage`) if at least min_entities other
    entities with min_rows scored rows have been in it, else that of all stages (`all`), if
    the other entities have as many altogether, else none (`none`, no bounds). The lower
    bound is not below zero. Rows without a prediction get no bounds; an entity's rows
    without a truth are covered by the others like the rest.
    """
    staged = df.withColumn("stage", life_stage())
    own = block_scores(staged, ["stage"], entity)
    whole = block_scores(df, (), entity)
    both = own.unionByName(whole.withColumn("stage", F.lit("*")))
    found = leave_one_out_quantiles(both, ["stage"], level, entity=entity)

    def others(left: Column, held: Column, q: str) -> Column:
        """The quantile without the row's own entity, null where too little is left."""
        more = left["entities"] - F.when(held.isNotNull(), 1).otherwise(0)
        rest = left["rows"] - F.coalesce(held["n_rows"], F.lit(0))
        after = F.struct(held["score"].alias("score"), F.col(entity).alias(entity)) > left["pivot"]
        value = F.when(held.isNull(), left["whole"]).when(after, left["kept"]).otherwise(left["next"])
        return F.when((more >= min_entities) & (rest >= min_rows), value).alias(q)

    mine = own.select(entity, "stage", F.struct("score", "n_rows").alias("_own"))
    total = whole.select(entity, F.struct("score", "n_rows").alias("_all"))
    # at most five rows: the four stages and all of them
    stages = F.broadcast(found.filter("stage <> '*'").select("stage", F.struct(*found.columns[1:]).alias("_stage")))
    everything = F.broadcast(found.filter("stage = '*'").select(F.struct(*found.columns[1:]).alias("_whole")))
    rows = staged.join(mine, [entity, "stage"], "left").join(total, entity, "left").join(stages, "stage", "left").join(everything, F.lit(True), "left")
    rows = rows.select(*staged.columns, others(F.col("_stage"), F.col("_own"), "_q"), others(F.col("_whole"), F.col("_all"), "_g"))
    q, p = F.coalesce("_q", "_g"), F.col(prediction)
    source = ladder((F.col("_q").isNotNull(), "stage"), (F.col("_g").isNotNull(), "all"), otherwise="none")
    return rows.select(*staged.columns, F.greatest(p - q, F.when((p - q).isNotNull(), F.lit(0.0))).alias("lower"), (p + q).alias("upper"), source.alias("source"))


def coverage(df: DataFrame, y: str = "y_true", low: str = "lower", high: str = "upper", entity: str = "battery_id") -> DataFrame:
    """UNC6: coverage and width overall, by entity and by stage, in one pass."""
    rows = df.filter(F.col(y).isNotNull() & F.col(low).isNotNull())
    g = rows.groupingSets([[], [F.col(entity)], [F.col("stage")]], F.col(entity), F.col("stage")).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.avg(F.col(y).between(F.col(low), F.col(high)).cast("int")).alias("coverage"),
        F.avg(F.col(high) - F.col(low)).alias("width"),
    )
    level = ladder((F.col("g") == 3, "all"), (F.col("g") == 1, "entity"), otherwise="stage")
    return g.select(level.alias("level"), F.coalesce(entity, "stage", F.lit("")).alias("name"), "n", "coverage", "width")


def worst_entity(cov: DataFrame) -> DataFrame:
    return cov.filter("level = 'entity'").orderBy("coverage", "name").limit(1)
