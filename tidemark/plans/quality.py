"""Data-quality checks as result tables, and feed anomalies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import running_max
from tidemark.session import cut


def _row(check: str, severity: str, failures: Column) -> Column:
    status = F.when(failures == 0, "pass").otherwise(severity)
    return F.struct(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"),
        failures.alias("failures"), status.alias("status"),
    )


def row_checks(
    df: DataFrame, not_null: Sequence[str] = (), accepted: Mapping[str, Sequence] | None = None,
    warn: Sequence[str] = (),
) -> DataFrame:
    """not-null and accepted-values checks of a table, all in one pass.

    Nulls are the not-null check's business, so they pass the accepted-values check.
    Checks named in `warn` report `warn` instead of `error`.
    """
    failures = {f"not_null:{c}": F.count_if(F.col(c).isNull()) for c in not_null}
    for col, values in (accepted or {}).items():
        failures[f"accepted_values:{col}"] = F.count_if(~F.col(col).isin(list(values)))
    one = df.agg(*[f.alias(f"_{i}") for i, f in enumerate(failures.values())])
    rows = [
        _row(check, "warn" if check in warn else "error", F.col(f"_{i}"))
        for i, check in enumerate(failures)
    ]
    return one.select(F.inline(F.array(*rows)))


def unique_check(df: DataFrame, cols: Sequence[str], severity: str = "error") -> DataFrame:
    """Key values that occur more than once; keys with a null are left out."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    repeated = df.filter(complete).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    one = repeated.agg(F.count(F.lit(1)).alias("_f"))
    return one.select(F.inline(F.array(_row(f"unique:{','.join(cols)}", severity, F.col("_f")))))


def reference_check(
    df: DataFrame, col: str, parents: DataFrame, parent_col: str, severity: str = "error"
) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    keys = parents.select(F.col(parent_col).alias(col)).distinct()
    orphans = df.filter(F.col(col).isNotNull()).join(keys, col, "left_anti")
    one = orphans.agg(F.count(F.lit(1)).alias("_f"))
    return one.select(F.inline(F.array(_row(f"relationships:{col}", severity, F.col("_f")))))


def report(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


# Hours that one task looks at, besides the trailing ones before them.
BLOCK_HOURS = 4096
_HOUR = 3_600_000_000


def _hours(df: DataFrame, ts: str, *aggs: Column) -> DataFrame:
    """Aggregates for every hour between the first and the last row, empty hours included.

    Hours are numbered since 1970 and made in parallel, so a far-off timestamp is many rows, not
    one large one.
    """
    spark, kind = df.sparkSession, df.schema[ts].dataType
    hour = F.date_trunc("hour", ts).cast("timestamp")
    number = F.floor(F.unix_micros(hour) / F.lit(_HOUR))
    counted = cut(df.filter(F.col(ts).isNotNull()).groupBy(number.alias("n")).agg(*aggs))
    first, last = counted.agg(F.min("n"), F.max("n")).first()
    spine = spark.range(*((first, last + 1) if first is not None else (0, 0))).withColumnRenamed("id", "n")
    return spine.join(counted, "n", "left").withColumn("hour", F.timestamp_micros(F.col("n") * F.lit(_HOUR)).cast(kind))


def _scored(
    hours: DataFrame, metric: str, trailing: int, limit: float, severity: str, both: bool
) -> DataFrame:
    """z-score of each hour `n` against the hours before it; `hours` has all of them.

    Hours are cut in blocks, and a block gets the trailing hours before it once more, so a window
    sees a block and what it looks back on. `both` reports unusually low values as well as high ones.
    """
    own = F.floor(F.col("n") / BLOCK_HOURS)
    again = F.floor((F.col("n") + trailing) / BLOCK_HOURS)
    blocks = hours.withColumn("_block", F.explode(F.sequence(own, again)))
    past = Window.partitionBy("_block").orderBy("n").rowsBetween(-trailing, -1)
    value = F.col(metric)
    mean, spread = F.avg(value).over(past), F.stddev_samp(value).over(past)
    z = (value - mean) / F.nullif(spread, F.lit(0.0))
    scored = blocks.withColumn("z_score", z).filter(F.col("_block") == own).drop("_block", "n")
    odd = (F.abs("z_score") if both else F.col("z_score")) > limit
    return scored.withColumn("status", F.when(odd, severity).otherwise("pass"))


def volume_anomalies(
    df: DataFrame, ts: str, trailing: int = 336, limit: float = 3.0, severity: str = "warn"
) -> DataFrame:
    """Rows loaded per hour, compared with the two weeks before."""
    hours = _hours(df, ts, F.count(F.lit(1)).alias("row_count"))
    hours = hours.withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("bigint")))
    return _scored(hours, "row_count", trailing, limit, severity, both=True)


def freshness_anomalies(
    df: DataFrame, ts: str, trailing: int = 336, limit: float = 3.0, severity: str = "warn"
) -> DataFrame:
    """Seconds since the newest load at the end of each hour, compared with the hours before."""
    hours = _hours(df, ts, F.max(ts).alias("_newest"))
    hours = running_max(hours, [], "_newest", ["n"], "_so_far")
    stale = ((F.col("n") + 1) * F.lit(_HOUR) - F.unix_micros(F.col("_so_far").cast("timestamp"))) / 1e6
    hours = hours.select("n", "hour", stale.alias("staleness_seconds"))
    return _scored(hours, "staleness_seconds", trailing, limit, severity, both=False)
