"""Sequential parameter search by Parzen densities over a table of trials.

A study's trials are split into the best few and all others. Each parameter's next value is
drawn from a kernel density of the best (with a uniform part) and, of ``CANDIDATES`` draws, the
one is taken whose density among the best is largest against that among the others. Draws come
from md5 of (seed, study, trial, parameter, draw), kernels are logistic, and everything is
column expressions over the trial table, so a proposal can be computed again from the table,
for one study or for many at once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 24
#: The best are a tenth of the trials, at most ``MOST_BEST``.
BEST_SHARE, MOST_BEST = 0.1, 25
#: Trials with random values before the first proposal.
START_TRIALS = 8
#: Kernel width as a share of the range: ``WIDTH`` / n ** 0.2, at least ``LEAST_WIDTH``.
WIDTH, LEAST_WIDTH = 0.2, 0.02


@dataclass(frozen=True)
class Parameter:
    """A number between two bounds; ``log`` searches its logarithm, ``whole`` rounds it."""

    name: str
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, value: Column) -> Column:
        """Value to the scale of the search, 0 to 1."""
        low, high = self._bounds()
        x = F.ln(value) if self.log else value.cast("double")
        return (x - F.lit(low)) / F.lit(high - low)

    def outer(self, x: Column) -> Column:
        low, high = self._bounds()
        y = F.lit(low) + x * F.lit(high - low)
        y = F.exp(y) if self.log else y
        return F.round(y) if self.whole else y

    def _bounds(self) -> tuple[float, float]:
        from math import log

        return (log(self.low), log(self.high)) if self.log else (float(self.low), float(self.high))


def draw(*parts: Column) -> Column:
    """A number between 0 and 1 (both excluded) from the md5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def kernel(x: Column, centre: Column, width: Column) -> Column:
    """Density of a logistic distribution."""
    e = F.exp(-F.abs(x - centre) / width)
    return e / (width * (F.lit(1.0) + e) * (F.lit(1.0) + e))


def _width(n: Column) -> Column:
    return F.greatest(F.lit(LEAST_WIDTH), F.lit(WIDTH) / F.pow(F.greatest(n, F.lit(1)), F.lit(0.2)))


def propose(
    trials: DataFrame, space: Sequence[Parameter], *, study: Sequence[str] = (), trial: str = "trial", result: str = "result", seed: int = 42,
) -> DataFrame:
    """The next values of every study: study columns, n_trials and a column for each parameter.

    ``trials`` has the study columns, a trial number, the parameters and the result (larger is
    better; trials with a null result or parameter are left out). Work grows with trials x
    candidates; only the best few of a study are held together.
    """
    names = [p.name for p in space]
    rows = trials.dropna(subset=[result, *names]).select(
        F.struct(*[F.col(c) for c in study], F.lit(0).alias("_one")).alias("study"), F.col(trial).alias("trial"), F.col(result).alias("result"),
        F.array(*[p.inner(F.col(p.name)) for p in space]).alias("x"),
    )
    order = Window.partitionBy("study").orderBy(F.desc("result"), "trial")
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_BEST)
    number = rows.groupBy("study").agg(F.count("*").alias("n"))
    best_of = F.least(F.ceil(F.col("n") * BEST_SHARE), F.lit(MOST_BEST))
    best = top.join(number, "study").where(F.col("place") <= best_of).groupBy("study", "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("best")  # at most MOST_BEST
    )
    wide = best.select(
        "study", "n", "best", F.size("best").alias("m"), F.posexplode(F.array(*[F.lit(c) for c in names])).alias("p", "name"),
    ).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(CANDIDATES - 1))))
    label = F.concat_ws("/", *[F.col(f"study.{c}") for c in study], F.lit("")) if study else F.lit("")
    u = lambda kind: draw(F.lit(seed), label, F.col("n"), F.col("name"), F.col("draw"), F.lit(kind))
    wide = wide.withColumns({"u": u("kernel"), "v": u("place")}).withColumn("k", F.floor(F.col("u") * (F.col("m") + 1)).cast("int"))
    centre = F.element_at(F.element_at("best", F.least(F.col("k") + 1, F.col("m"))), F.col("p") + 1)
    spread = centre + _width(F.col("m")) * F.ln(F.col("v") / (F.lit(1.0) - F.col("v")))
    at = F.when(F.col("k") == F.col("m"), F.col("v")).otherwise(F.least(F.greatest(spread, F.lit(0.0)), F.lit(1.0)))
    wide = wide.withColumn("at", at)
    near = lambda width: F.aggregate("best", F.lit(0.0), lambda s, x: s + kernel(F.col("at"), F.element_at(x, F.col("p") + 1), width))
    wide = wide.withColumns({"other_width": _width(F.col("n") - F.col("m"))}).withColumns({"good": near(_width(F.col("m"))), "shared": near(F.col("other_width"))})
    each = wide.select("study", F.struct("p", "name", "draw").alias("key"), "at", "other_width")
    every = rows.select("study", "x").join(each, "study").groupBy("study", "key").agg(
        F.sum(kernel(F.col("at"), F.element_at("x", F.col("key.p") + 1), F.col("other_width"))).alias("all")
    )
    both = wide.withColumn("key", F.struct("p", "name", "draw")).join(every, ["study", "key"])
    # one uniform kernel belongs to either side
    good = (F.col("good") + 1) / (F.col("m") + 1)
    others = (F.greatest(F.col("all") - F.col("shared"), F.lit(0.0)) + 1) / (F.col("n") - F.col("m") + 1)
    gain = F.round(F.ln(good) - F.ln(others), 9)
    chosen = both.groupBy("study", "n", "p").agg(F.max_by("at", F.struct(gain, -F.col("draw"))).alias("at"))
    values = chosen.groupBy("study", "n").agg(F.map_from_entries(F.collect_list(F.struct("p", "at"))).alias("at"))  # one entry for each parameter
    return values.select(
        *[F.col(f"study.{c}").alias(c) for c in study], F.col("n").alias("n_trials"), *[p.outer(F.col("at")[i]).alias(p.name) for i, p in enumerate(space)]
    )


def first_values(space: Sequence[Parameter], trial: int, seed: int = 42) -> list[Column]:
    """Random values of an early trial."""
    return [p.outer(draw(F.lit(seed), F.lit("start"), F.lit(trial), F.lit(p.name))).alias(p.name) for p in space]


def search(
    spark, space: Sequence[Parameter], objective: Callable[[Mapping[str, float]], Mapping[str, float | int | None]], path: str, *,
    trials: int = 20, seed: int = 42, result: str = "result", schema: str = "",
    together: Callable[[Sequence[Mapping[str, float]]], Sequence[Mapping[str, float | int | None]]] | None = None,
) -> DataFrame:
    """Run trials one after another and append each to the table at ``path``; returns the table.

    ``objective`` trains with the given values and returns ``result`` and further columns, named
    in ``schema`` with their types. Every proposal is computed from the table alone, so a search
    that is started again on the same table goes on after its last trial. ``together`` is the
    objective of several trials: those with random values do not wait for one another.
    """
    columns = f"trial int, {', '.join(f'{p.name} double' for p in space)}, {result} double{', ' + schema if schema else ''}"
    spark.createDataFrame([], columns).write.mode("append").parquet(path)
    i, names = spark.read.schema(columns).parquet(path).count(), [p.name for p in space]
    while i < trials:
        table = spark.read.schema(columns).parquet(path)
        if i < START_TRIALS or table.where(F.col(result).isNotNull()).isEmpty():
            last = min(START_TRIALS, trials) if together and i < START_TRIALS else i + 1
            rows = [spark.range(1).select(*first_values(space, k, seed)).first() for k in range(i, last)]
        else:
            rows = [propose(table, space, result=result, seed=seed).select(*names).first()]
        values = [{n: float(row[n]) for n in names} for row in rows]
        got = together(values) if together else [objective(v) for v in values]
        order = [c.split()[0] for c in columns.split(", ")]
        done = [{"trial": i + k, **v, **g} for k, (v, g) in enumerate(zip(values, got, strict=True))]
        spark.createDataFrame([tuple(t[c] for c in order) for t in done], columns).coalesce(1).write.mode("append").parquet(path)
        i += len(done)
    return spark.read.schema(columns).parquet(path)
