"""Encodings, imputation and standardisation of structured features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import quantiles


def hash_uniform(seed: str, *cols: Column) -> Column:
    """A number in (0, 1) from the md5 of the given values."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols])), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0


def hash_normal(seed: str, *cols: Column) -> Column:
    """A standard normal number from two hashes, the same in every run."""
    u, v = hash_uniform(f"{seed}-u", *cols), hash_uniform(f"{seed}-v", *cols)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: mean, sample deviation, median, minimum, maximum."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")
    ).select("e.feature", "e.x").where(F.col("x").isNotNull())
    base = long.groupBy("feature").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    return base.join(quantiles(long, "x", {"median": 0.5}, by=["feature"]), "feature")


def moments(df: DataFrame, columns: Sequence[str]) -> Column:
    """Scalar struct of mean_<c> and std_<c>, computed in one pass of ``df``."""
    parts = []
    for c in columns:
        parts += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    row = df.agg(*parts)
    return row.select(F.struct(*row.columns)).scalar()


def zscore(value: Column, stats: Column, name: str) -> Column:
    """Null for a column without spread."""
    return F.try_divide(value - stats[f"mean_{name}"], stats[f"std_{name}"])


def mean_impute_log1p(value: Column, stats: Column, name: str) -> Column:
    return F.log1p(F.coalesce(value, stats[f"mean_{name}"]))


def gaussian_impute_floor(value: Column, centre: Column, spread: Column, seed: str, row_id: Column) -> Column:
    """Null -> floor(centre + spread * z), z from the row id."""
    return F.coalesce(value, F.floor(centre + spread * hash_normal(seed, row_id)).cast("double"))


def ordered_bin(value: Column) -> Column:
    """Bins (-1,39], (39,44], (44,49], (49,54], (54,100]; null or outside -> -1."""
    return (
        F.when((value > -1) & (value <= 39), 0).when((value > 39) & (value <= 44), 1)
        .when((value > 44) & (value <= 49), 2).when((value > 49) & (value <= 54), 3)
        .when((value > 54) & (value <= 100), 4).otherwise(-1)
    )


def min_max(df: DataFrame, column: str) -> DataFrame:
    """Scale a column to 0..1 by its minimum and maximum; a constant column becomes null."""
    ends = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("e")).scalar()
    scaled = F.try_divide(F.col(column) - F.col("_ends.lo"), F.col("_ends.hi") - F.col("_ends.lo"))
    return df.withColumn("_ends", ends).withColumn(column, scaled).drop("_ends")


def standardise_features(
    df: DataFrame, row_id: str, *, stats_from: DataFrame | None = None, seed: str = "impute",
    gaussian: str = "menarche_age", bounded: str = "menopause_age", age: str = "age_at_exam",
    log_columns: Sequence[str] = ("payment_min", "payment_max"), z_columns: Sequence[str] = ("bmi", "age_at_first", "age_at_exam"),
) -> DataFrame:
    """Impute, log, z-score and bin the structured features in one projection.

    ``stats_from`` names the table whose statistics are used (normally the training split),
    by default the table itself; the ends of the bins are part of them.  An imputed ``bounded``
    age counts only up to the raw age.  The statistics are attached once, as one struct column.
    """
    source = df if stats_from is None else stats_from
    median_row = quantiles(source, bounded, {"median": 0.5})
    stats_row = moments(source, [gaussian, bounded, *log_columns, *z_columns])

    def with_stats(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_stats": stats_row, "_median": median_row.scalar()})

    stats, median = F.col("_stats"), F.col("_median")
    out = {}
    filled = gaussian_impute_floor(F.col(gaussian), stats[f"mean_{gaussian}"], stats[f"std_{gaussian}"], f"{seed}-a", F.col(row_id))
    out[gaussian] = zscore(filled, stats, gaussian)
    guess = gaussian_impute_floor(F.col(bounded), median, stats[f"std_{bounded}"], f"{seed}-b", F.col(row_id))
    known = F.coalesce(F.col(bounded), F.when(guess <= F.col(age), guess))
    out[bounded] = ordered_bin(known)
    for c in log_columns:
        out[c] = mean_impute_log1p(F.col(c), stats, c)
    for c in z_columns:
        out[c] = zscore(F.col(c), stats, c)
    bins = with_stats(source).select(out[bounded].alias("bin"))
    ends = bins.agg(F.struct(F.min("bin").alias("lo"), F.max("bin").alias("hi")).alias("e")).scalar()
    lo, hi = F.col("_ends.lo"), F.col("_ends.hi")
    out[bounded] = F.try_divide(out[bounded] - lo, hi - lo)
    return with_stats(df).withColumn("_ends", ends).withColumns(out).drop("_stats", "_median", "_ends")


def one_hot(df: DataFrame, column: str, levels: Sequence[int], missing: int = -1) -> DataFrame:
    """One 0/1 column per level; null counts as the missing level."""
    value = F.coalesce(F.col(column), F.lit(missing))
    return df.withColumns({f"{column}_{str(v).replace('-', 'm')}": (value == v).cast("int") for v in levels})


def missing_indicator(df: DataFrame, column: str, sentinel: int = -1) -> DataFrame:
    return df.withColumns(
        {f"is_missing_{column}": F.col(column).isNull().cast("int"), column: F.coalesce(F.col(column), F.lit(sentinel))}
    )


def category_table(df: DataFrame, column: str) -> DataFrame:
    """Distinct categories with a dense code from 0, in sorted order."""
    order = Window.orderBy(column)
    return df.select(column).distinct().withColumn("category_index", (F.row_number().over(order) - 1).cast("int"))


def category_index(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Attach the code of a category; an unseen one is -1."""
    return df.join(codes, column, "left").withColumn("category_index", F.coalesce("category_index", F.lit(-1)))


def category_embedding(category: Column, dim: int = 8, seed: str = "category") -> Column:
    """A fixed random vector per category."""
    return F.array(*[hash_normal(f"{seed}-{i}", category) for i in range(dim)])
