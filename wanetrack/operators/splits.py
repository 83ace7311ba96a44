"""Splits and folds that keep entities, or their futures, apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.exprs import history, whole

ID, ORDER = "battery_id", "cycle_index"


def _sizes(df: DataFrame, entity: str) -> DataFrame:
    n = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("n"), entity)))


def entity_holdout(
    df: DataFrame, test: int = 4, val: int = 5, entity: str = ID, test_ids: Sequence[str] = (), val_ids: Sequence[str] = (), least: int = 3
) -> DataFrame:
    """SPL1: (entity, split): by falling length every test-th entity, then of the rest every val-th. Ties by id.

    Lists of ids override the rule for both. Fewer than `least` entities are an error, as
    are listed ids that are not there or are listed twice.
    """
    n = df.select(entity).distinct().limit(least).count()
    if n < least:
        raise ValueError(f"{n} entities cannot be split into train, val and test")
    if test_ids or val_ids:
        wanted = [*test_ids, *val_ids]
        found = {r[0] for r in df.filter(F.col(entity).isin(wanted)).select(entity).distinct().collect()}
        if len(set(wanted)) < len(wanted) or found != set(wanted):
            raise ValueError(f"listed twice or not there: {sorted(set(w for w in wanted if wanted.count(w) > 1 or w not in found))}")
        split = F.when(F.col(entity).isin(list(test_ids)), "test").when(F.col(entity).isin(list(val_ids)), "val").otherwise("train")
        return df.select(entity).distinct().select(entity, split.alias("split"))
    s = _sizes(df, entity).withColumn("is_test", (F.col("rn") - 1) % test == 0)
    rest = F.sum((~F.col("is_test")).cast("int")).over(Window.orderBy("rn"))
    split = F.when(F.col("is_test"), "test").when((rest - 1) % val == 0, "val").otherwise("train")
    return s.select(entity, split.alias("split"))


def chronological(df: DataFrame, test: float = 0.25, val: float = 0.2, gap: int = 2, min_rows: int = 10, entity: str = ID, order: str = ORDER) -> DataFrame:
    """SPL2: each entity's last rows test, those before val, with purged rows between; short ones all train."""
    rn, n = F.row_number().over(history(entity, order)), F.count(F.lit(1)).over(whole(entity))
    df = df.withColumn("_rn", rn).withColumn("_n", n)
    n_test, n_val = F.bround(F.col("_n") * test), F.bround(F.col("_n") * val)
    test_from, val_from = F.col("_n") - n_test, F.col("_n") - n_test - n_val
    split = (
        F.when(F.col("_n") < min_rows, "train").when(F.col("_rn") > test_from, "test")
        .when(F.col("_rn") > test_from - gap, "unused").when(F.col("_rn") > val_from, "val")
        .when(F.col("_rn") > val_from - gap, "unused").otherwise("train")
    )
    return df.withColumn("split", split).drop("_rn", "_n")


def walk_forward(df: DataFrame, folds: int = 4, least: float = 0.4, gap: int = 2, horizon: int = 10, entity: str = ID, order: str = ORDER) -> DataFrame:
    """SPL3: rows x folds with role train (prefix), test (horizon after the gap) or unused."""
    fractions = [least + (1 - least) * k / folds for k in range(folds)]
    fold = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(f).alias("f")) for k, f in enumerate(fractions)]))
    df = df.withColumn("_rn", F.row_number().over(history(entity, order))).withColumn("_n", F.count(F.lit(1)).over(whole(entity)))
    df = df.withColumn("_f", fold).withColumn("fold", F.col("_f.fold")).withColumn("_cut", F.floor(F.col("_n") * F.col("_f.f")))
    df = df.filter((F.col("_cut") >= 2) & (F.col("_cut") < F.col("_n")))
    after = F.col("_rn") - F.col("_cut") - gap
    role = F.when(F.col("_rn") <= F.col("_cut"), "train").when((after > 0) & (after <= horizon), "test").otherwise("unused")
    return df.withColumn("role", role).drop("_rn", "_n", "_f", "_cut")


def final_fold(folds: DataFrame, last: int) -> DataFrame:
    """SPL4: the last fold's test is the holdout, the test of the fold before validates."""
    split = F.when((F.col("fold") == last) & (F.col("role") == "test"), "test").when(
        (F.col("fold") == last - 1) & (F.col("role") == "test"), "val"
    ).when((F.col("fold") == last - 1) & (F.col("role") == "train"), "train")
    return folds.withColumn("split", split).filter("split is not null").drop("fold", "role")


def grouped_folds(df: DataFrame, k: int = 5, seed: int = 42, entity: str = ID) -> DataFrame:
    """SPL5: (entity, fold): equal numbers of entities a fold, in seeded hash order."""
    w = Window.orderBy(F.xxhash64(entity, F.lit(seed)), entity)
    return df.select(entity).distinct().select(entity, (F.ntile(k).over(w) - 1).alias("fold"))


def leave_one_out(df: DataFrame, entity: str = ID, most: int = 100_000) -> DataFrame:
    """SPL6: rows x entities with the role that a row has when the entity `held` is out.

    The result itself has rows times entities, so there may be no more than `most` entities.
    """
    held = df.select(F.col(entity).alias("held")).distinct()
    n = held.limit(most + 1).count()
    if n > most:
        raise ValueError(f"leave_one_out() would put out every row once for each of more than {most} entities")
    return df.join(F.broadcast(held), F.lit(True), "cross").withColumn("role", F.when(F.col(entity) == F.col("held"), "test").otherwise("train"))


def leave_one_out_sizes(df: DataFrame, entity: str = ID) -> DataFrame:
    """SPL6: (held, role, n), the rows of each role of leave_one_out(), from one count an entity; no row is put out twice.

    A null entity is held out once as well, and equals no row, so all rows train then.
    """
    own = df.groupBy(F.col(entity).alias("held")).agg(F.count(F.lit(1)).alias("n"))
    total = own.agg(F.sum("n").alias("total"))
    test = F.when(F.col("held").isNotNull(), F.col("n")).otherwise(0)
    roles = F.array(F.struct(F.lit("test").alias("role"), test.alias("n")), F.struct(F.lit("train").alias("role"), (F.col("total") - test).alias("n")))
    return own.join(F.broadcast(total), F.lit(True), "cross").select("held", F.inline(roles)).filter("n > 0")  # total: one row


def split_sizes(df: DataFrame, entity: str = ID) -> DataFrame:
    """SPL7: rows and entities a split; entities in several splits are a leak."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities"))


def checked_split(df: DataFrame, entity: str = ID, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """SPL7: split_sizes(), refused if a split leaks or is empty.

    An entity that lies in several splits, a row with another split's name, and an empty
    train or test split raise an error; the validation split may be empty. One job over the
    rows counts per entity before anything is compared.
    """
    per = df.groupBy(entity, "split").agg(F.count(F.lit(1)).alias("n"))
    own = per.groupBy(entity).agg(F.count_distinct("split").alias("k"), F.array_sort(F.collect_set("split")).alias("in"))
    shared = own.filter("k > 1").orderBy(entity).limit(1).collect()
    if shared:
        raise ValueError(f"{entity} {shared[0][entity]} is in the splits {', '.join(shared[0]['in'])}: this would leak")
    sizes = {r["split"]: (r["n_rows"], r["n_entities"]) for r in per.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_entities")).limit(len(splits) + 1).collect()}
    other = sorted(str(k) for k in sizes if k not in splits)
    if other:
        raise ValueError(f"unknown splits: {', '.join(other)}")
    for name in ("train", "test"):
        if name not in sizes:
            raise ValueError(f"the split {name} is empty")
    return df.sparkSession.createDataFrame([(k, *v) for k, v in sizes.items()], "split string, n_rows long, n_entities long")  # three rows at most


def learning_subsets(df: DataFrame, counts: Sequence[int] = (5, 10), part: float = 0.5, entity: str = ID, order: str = ORDER) -> DataFrame:
    """SPL8: (n, rows): the first n entities and the earliest part of each."""
    first = df.select(entity).distinct().orderBy(entity).limit(max(counts))  # the subsets' own limit
    first = first.withColumn("_e", F.row_number().over(Window.orderBy(entity)))
    df = df.join(F.broadcast(first), entity)
    df = df.withColumn("_rn", F.row_number().over(history(entity, order))).withColumn("_n", F.count(F.lit(1)).over(whole(entity)))
    df = df.filter(F.col("_rn") <= F.ceil(F.col("_n") * part)).withColumn("subset", F.explode(F.array(*map(F.lit, counts))))
    return df.filter(F.col("_e") <= F.col("subset")).drop("_e", "_rn", "_n")
