"""Encoding, scaling, feature choice and projection."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.ordered import bounded_windows, number_rows, running_totals
from gridloom.operators.products import shifts, sums_by_pair
from gridloom.operators.profile import numeric_columns
from gridloom.schema import ENCODED_COLUMNS, TASKS, UNSCALED_COLUMNS
from gridloom.session import materialize, small

log = logging.getLogger(__name__)

LISTED_CLASSES = 200  # classes of a column that fit into an expression
SMALL_DICTIONARY = 50_000  # classes of a column that may go to every executor


def feature_matrix(df: DataFrame, features, target: str | None = None) -> DataFrame:
    """The features that exist (a warning names the others) and the target."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        log.warning("columns not in the table, left out: %s", missing)
    return df.select(*[c for c in features if c in df.columns], *([target] if target else []))


def task_features(spark: SparkSession) -> DataFrame:
    """Feature list, target and kind of every task, one row per feature."""
    rows = [(t, i, f, y, kind) for t, (fs, y, kind) in TASKS.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "task string, place int, feature string, target string, kind string")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def classes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (column, value) pairs as text, in one pass; a null is the class ``nan``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("value")) for c in columns])
    return df.select(F.inline(cells)).distinct()


def label_encode(df: DataFrame, columns=ENCODED_COLUMNS) -> DataFrame:
    """Add ``<column>_enc``: the place of the value among the sorted classes.

    A few classes become a literal list inside the projection, a small
    dictionary is broadcast, a large one is numbered in parallel and joined.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    found = materialize(classes(df, columns), "classes")
    sizes = {r["column"]: r["count"] for r in found.groupBy("column").count().collect()}
    short = [c for c in columns if sizes.get(c, 0) <= LISTED_CLASSES]
    lists: dict[str, list[str]] = {c: [] for c in short}
    for row in found.filter(F.col("column").isin(short)).collect() if short else ():
        lists[row["column"]].append(row["value"])
    listed = {f"{c}_enc": (F.array_position(F.lit(sorted(v)), _text(c)) - 1).cast("int") for c, v in lists.items() if v}
    for c in columns:
        if c in short:
            continue
        mine = found.filter(F.col("column") == c).select(F.col("value").alias("_value"))
        codes = number_rows(mine, ["_value"], f"{c}_enc").withColumn(f"{c}_enc", F.col(f"{c}_enc").cast("int"))
        if sizes[c] <= SMALL_DICTIONARY:
            codes = F.broadcast(codes)
        df = df.join(codes, _text(c) == F.col("_value"), "left").drop("_value")
    return df.withColumns(listed)


def fit_encoder(df: DataFrame, path: str, columns=ENCODED_COLUMNS) -> DataFrame:
    """Write the dictionary (column, value, code) of the columns that exist to ``path`` and return it.

    Codes are those of ``label_encode``: the place among the sorted classes of
    a column. All classes are numbered in one distributed order.
    """
    columns = [c for c in columns if c in df.columns]
    if columns:
        numbered = materialize(number_rows(classes(df, columns), ["column", "value"], "_n"), "classes")
        first = numbered.groupBy("column").agg(F.min("_n").alias("_first"))
        table = numbered.join(small(first), "column").select("column", "value", (F.col("_n") - F.col("_first")).cast("int").alias("code"))
    else:
        table = df.sparkSession.createDataFrame([], "column string, value string, code int")
    table.write.mode("overwrite").parquet(path)
    return load_encoder(df.sparkSession, path)


def load_encoder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("column string, value string, code int").parquet(path)


def encode_with(df: DataFrame, dictionary: DataFrame, unseen: int | None = -1) -> DataFrame:
    """Add ``<column>_enc`` by a fitted dictionary, for a batch or a stream; ``unseen`` stands for other values.

    A few classes become a literal list, more are joined, by broadcast while
    the dictionary of the column is small. A column that is missing, here or in
    the dictionary, is left out.
    """
    listed, other = {}, F.lit(unseen).cast("int")
    sizes = {r["column"]: r["count"] for r in dictionary.groupBy("column").count().collect() if r["column"] in df.columns}
    short = [c for c in sorted(sizes) if sizes[c] <= LISTED_CLASSES]
    lists: dict[str, list[tuple[int, str]]] = {c: [] for c in short}
    for row in dictionary.filter(F.col("column").isin(short)).collect() if short else ():
        lists[row["column"]].append((row["code"], row["value"]))
    for c, found in lists.items():
        place = F.array_position(F.lit([v for _, v in sorted(found)]), _text(c)).cast("int")
        listed[f"{c}_enc"] = F.when(place > 0, place - 1).otherwise(other)
    for c in sorted(set(sizes) - set(short)):
        mine = dictionary.filter(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        if sizes[c] <= SMALL_DICTIONARY:
            mine = F.broadcast(mine)
        df = df.join(mine, _text(c) == F.col("_value"), "left").withColumn(f"{c}_enc", F.coalesce("_code", other)).drop("_value", "_code")
    return df.withColumns(listed)


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column."""

    stats: dict[str, tuple[float, float]]

    def apply(self, df: DataFrame, prefix: str = "") -> DataFrame:
        return df.withColumns(
            {f"{prefix}{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()}
        )


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """One aggregation; a constant column is centred and divided by 1."""
    row = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return Scaler({c: (row[c]["m"] or 0.0, row[c]["s"] or 1.0) for c in columns})


def scale_features(df: DataFrame, exclude: list[str] = ()) -> tuple[DataFrame, Scaler]:
    """Standardise all numeric columns but the excluded, target and calendar ones."""
    skip = set(exclude) | set(UNSCALED_COLUMNS)
    scaler = fit_scaler(df, [c for c in numeric_columns(df) if c not in skip])
    return scaler.apply(df), scaler


def min_max(df: DataFrame, column: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Add the column scaled to 0..1 over the table or per key; a constant gives 0."""
    span = F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))
    if by:
        df = df.join(small(df.groupBy(*by).agg(span.alias("_span"))), list(by))
        lo, hi = F.col("_span")["lo"], F.col("_span")["hi"]
    else:
        ends = df.agg(span.alias("s")).scalar()
        lo, hi = ends["lo"], ends["hi"]
    scaled = F.coalesce(F.try_divide(F.col(column) - lo, hi - lo), F.when(F.col(column).isNotNull(), F.lit(0.0)))
    return df.withColumn(name, scaled).drop("_span")


def anova_f(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """F statistic of each feature between the classes of ``label``.

    One aggregation per class; everything after it works on one row per class
    and feature.
    """
    per_class = df.groupBy(label).agg(
        F.count("*").alias("n"),
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.var_pop(c).alias("var"))
                for c in columns
            ]
        ).alias("_f"),
    ).select("n", F.inline("_f"))
    whole = per_class.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.count("*").alias("k"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
    )
    return (
        per_class.join(whole, "feature")
        .groupBy("feature")
        .agg(
            (F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)) / (F.first("k") - 1)).alias("_between"),
            (F.sum(F.col("n") * F.col("var")) / (F.first("rows") - F.first("k"))).alias("_within"),
        )
        .select("feature", F.try_divide("_between", "_within").alias("score"))
    )


def equal_width_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin 0..bins-1 of a value between lo and hi."""
    place = F.floor(F.try_divide(value - lo, hi - lo) * bins)
    return F.least(F.coalesce(place, F.lit(0).cast("long")), F.lit(bins - 1).cast("long"))


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10, label_bins: int | None = None) -> DataFrame:
    """Mutual information of each binned feature with the (binned) label, in nats.

    The counts shrink map-side to features x bins x classes rows.
    """
    ends = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in {*columns, label}]).first()
    target = F.col(label)
    if label_bins:
        target = equal_width_bin(target, F.lit(ends[label]["lo"]), F.lit(ends[label]["hi"]), label_bins)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                equal_width_bin(F.col(c).cast("double"), F.lit(ends[c]["lo"]), F.lit(ends[c]["hi"]), bins).alias("bin"),
            )
            for c in columns
        ]
    )
    joint = df.select(target.alias("y"), F.inline(cells)).groupBy("feature", "bin", "y").agg(F.count("*").alias("n"))
    w_f, w_b, w_y = Window.partitionBy("feature"), Window.partitionBy("feature", "bin"), Window.partitionBy("feature", "y")
    total, p_b, p_y = F.sum("n").over(w_f), F.sum("n").over(w_b), F.sum("n").over(w_y)
    term = F.col("n") / total * F.log(F.col("n") * total / (p_b * p_y))
    return joint.select("feature", term.alias("t")).groupBy("feature").agg(F.sum("t").alias("score"))


def _digamma(n: Column) -> Column:
    """Digamma of a whole number above 0: ten steps up, then the asymptotic series."""
    x = n.cast("double") + 10
    series = F.log(x) - F.lit(1.0) / (2 * x) - F.lit(1.0) / (12 * x * x) + F.lit(1.0) / (120 * x * x * x * x)
    return series - sum((F.lit(1.0) / (n + i) for i in range(1, 10)), F.lit(1.0) / n)


def neighbour_information(
    df: DataFrame, columns: list[str], label: str, neighbours: int = 3, block_rows: int | None = None,
) -> DataFrame:
    """(feature, score): mutual information of numeric features with a class, in nats, by nearest neighbours.

    A value's radius is its distance to the k-th nearest value of its class (k =
    ``neighbours``, or all others of a smaller class). The score compares how many
    rows of the class and of the table lie strictly within that radius, itself
    included (k rows of the class, if none tie), and is never below 0. Where the
    radius is 0 the copies of the value are counted instead, so columns of few
    values need no noise to tell equal ones apart. Values that are null or not
    finite, rows without a class and classes of one row take no part; a feature
    with no row left gives no row.

    Equal values are counted before anything is sorted. Radii come from the
    values next to each other in (feature, class, value) order, the numbers
    within them from running counts over values and interval ends in one order.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    rows = df.select(F.col(label).alias("y"), F.inline(cells)).filter(F.col("y").isNotNull() & (F.abs("v") < math.inf))
    counted = rows.groupBy("feature", "y", (F.col("v") + 0.0).alias("v")).agg(F.count("*").alias("n"))
    counted = materialize(counted, "information-values")
    sizes = counted.groupBy("feature", "y").agg(F.sum("n").alias("size")).filter("size > 1")
    reach = range(1, neighbours + 1)

    def beside(window) -> dict[str, Column]:
        shifted = [F.lag(F.struct("v", "n"), j).over(window) for j in reach] + [F.lead(F.struct("v", "n"), j).over(window) for j in reach]
        return {"near": F.array_compact(F.array(*shifted))}

    found = bounded_windows(counted.join(small(sizes), ["feature", "y"]), ["v"], beside, ["feature", "y"], neighbours, neighbours, block_rows)
    wanted = F.least(F.lit(neighbours), F.col("size") - 1)
    far = F.transform("near", lambda e: F.struct(F.abs(e["v"] - F.col("v")).alias("d"), e["v"].alias("v"), e["n"].alias("n")))
    found = found.withColumn("near", far)

    def rows_within(d: Column) -> Column:
        return F.aggregate("near", F.col("n") - 1, lambda total, e: total + F.when(e["d"] <= d, e["n"]).otherwise(0))

    reached = F.array_min(F.transform(F.filter("near", lambda e: rows_within(e["d"]) >= wanted), lambda e: e["d"]))
    found = found.withColumn("radius", F.when(F.col("n") > wanted, 0.0).otherwise(reached))
    closer = F.aggregate("near", F.col("n"), lambda total, e: total + F.when(e["d"] < F.col("radius"), e["n"]).otherwise(0))
    found = found.withColumn("k", closer)

    def end(sign: int) -> Column:
        """Where the radius ends; the neighbour's own value, if it lies there, is free of rounding."""
        there = F.filter("near", lambda e: (e["d"] == F.col("radius")) & ((e["v"] - F.col("v")) * sign > 0))
        return F.when(F.col("radius") == 0, F.col("v")).otherwise(F.coalesce(F.get(there, F.lit(0))["v"], F.col("v") + F.col("radius") * sign))

    # At one place come ends that exclude it (0), values (1), ends that include it (2).
    point = F.col("radius") == 0
    upper = F.struct(end(1).alias("at"), F.when(point, 2).otherwise(0).alias("turn"), F.lit(1).alias("sign"))
    lower = F.struct(end(-1).alias("at"), F.when(point, 0).otherwise(2).alias("turn"), F.lit(-1).alias("sign"))
    ends = found.select("feature", "y", "v", "n", "size", "k", F.inline(F.array(upper, lower))).withColumn("rows", F.lit(0).cast("long"))
    values = counted.join(small(sizes.select("feature", "y")), ["feature", "y"], "left_semi")
    values = values.groupBy("feature", "v").agg(F.sum("n").alias("rows")).select("feature", F.col("v").alias("at"), F.lit(1).alias("turn"), "rows")
    order = ["feature", "at", "turn", "v"]
    totals = running_totals(ends.unionByName(values, allowMissingColumns=True), order, {"upto": F.col("rows")}, block_rows)
    met = totals.filter("sign is not null").groupBy("feature", "y", "v").agg(
        F.max("n").alias("n"), F.max("size").alias("size"), F.max("k").alias("k"), F.sum(F.col("sign") * F.col("upto")).alias("m"))
    term = _digamma(F.col("k")) - _digamma(F.col("size")) - _digamma(F.greatest("m", "k"))
    out = met.groupBy("feature").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * term).alias("terms"))
    return out.select("feature", F.greatest(F.lit(0.0), _digamma(F.col("rows")) + F.col("terms") / F.col("rows")).alias("score"))


def select_k_best(df: DataFrame, columns: list[str], label: str, k: int = 20, task: str = "classification") -> DataFrame:
    """The k features with the highest score, ranked; nulls count as 0.

    Scores are F statistics for a classification, else mutual information by
    neighbours; a label with fractions is then cut into ten classes of equal width.
    """
    filled = df.fillna(0, subset=list(columns))
    if task == "classification":
        scores = anova_f(filled, columns, label)
    else:
        if dict(df.dtypes)[label] in ("float", "double"):
            ends = df.agg(F.struct(F.min(label).alias("lo"), F.max(label).alias("hi")).alias("s")).scalar()
            held = F.when(F.col(label).isNotNull(), equal_width_bin(F.col(label), ends["lo"], ends["hi"], 10))
            filled = filled.withColumn("_class", held)
        else:
            filled = filled.withColumn("_class", F.col(label))
        scores = neighbour_information(filled, columns, "_class")
    ranked = scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "feature")))
    return ranked.filter(F.col("rank") <= min(k, len(columns)))


@dataclass(frozen=True)
class Projection:
    """Principal axes: centre, one weight list per component, explained shares."""

    columns: list[str]
    mean: list[float]
    axes: list[list[float]]
    explained: list[float]

    def coordinates(self) -> list[Column]:
        centred = [F.col(c) - F.lit(m) for c, m in zip(self.columns, self.mean)]
        return [sum((x * F.lit(w) for x, w in zip(centred[1:], axis[1:])), centred[0] * F.lit(axis[0])) for axis in self.axes]

    def apply(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        return df.withColumns({f"{prefix}{i + 1}": c for i, c in enumerate(self.coordinates())})

    def reconstruction_error(self) -> Column:
        """Mean squared distance to the projection, by the Pythagorean identity."""
        centred = [F.col(c) - F.lit(m) for c, m in zip(self.columns, self.mean)]
        whole = sum((x * x for x in centred[1:]), centred[0] * centred[0])
        kept = sum((p * p for p in self.coordinates()), F.lit(0.0))
        return F.greatest(whole - kept, F.lit(0.0)) / F.lit(float(len(self.columns)))


def fit_pca(df: DataFrame, columns: list[str], k: int) -> Projection:
    """Axes of the covariance matrix, whose entries come from one pass over the rows.

    Only the columns x columns matrix reaches the driver.
    """
    k, d = min(k, len(columns)), len(columns)
    shift = shifts(df, columns)
    sums = sums_by_pair(df, columns, shift)
    n = np.maximum(sums["n"], 1)
    mean = [float(shift[i] + sums["sx"][i, i] / n[i, i]) for i in range(d)]
    covariance = (sums["sxy"] - sums["sx"] * sums["sx"].T / n) / np.maximum(sums["n"] - 1, 1)
    covariance = (covariance + covariance.T) / 2
    values, vectors = np.linalg.eigh(covariance)
    largest = np.argsort(values)[::-1][:k]
    # A component's sign is free: make its largest weight positive.
    axes = [vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i]) for i in largest]
    whole = float(values.sum()) or 1.0
    return Projection(list(columns), mean, [[float(w) for w in a] for a in axes], [float(values[i]) / whole for i in largest])


def class_weights(df: DataFrame, label: str, name: str = "weight", positive: float | None = None) -> DataFrame:
    """Add a weight column: n / (classes * class size), or ``positive`` for label 1."""
    if positive is not None:
        return df.withColumn(name, F.when(F.col(label) == 1, F.lit(float(positive))).otherwise(F.lit(1.0)))
    sizes = {r[0]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    n, weight = sum(sizes.values()), F.lit(None).cast("double")
    for value, size in sizes.items():
        weight = F.when(F.col(label) == value, F.lit(n / (len(sizes) * size))).otherwise(weight)
    return df.withColumn(name, weight)
