"""Statistics over measured runs: metrics, counts, paired t-tests and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.student_t import upper_tail
from driftwatch.operators.ranking import numbered
from driftwatch.schemas import BASELINE_MODEL, CANDIDATE_MODEL

CONFIG = ["motor_groups", "window_ms"]
SIGNIFICANCE = 0.05
RUNS_PER_BLOCK = 1_000_000


def run_metrics(runs: DataFrame) -> DataFrame:
    """The compared quantities as columns: total CPU time, peak memory, load average."""
    return runs.withColumns({
        "cpu_time": (F.col("utime") + F.col("stime") + F.col("cutime") + F.col("cstime")).cast("double"),
        "peak_memory": F.col("vmhwm").cast("double"),
        "load_average": F.col("load_average").cast("double"),
    })


METRICS = ["cpu_time", "peak_memory", "load_average", "delay"]


def long_metrics(runs: DataFrame, ids: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """One row per run and metric."""
    return runs.unpivot(ids, metrics, "metric", "value")


def number_runs(runs: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """Number the runs of each configuration and model in the order of their identifier."""
    block = F.call_function("div", F.col(order), F.lit(RUNS_PER_BLOCK).cast("bigint"))
    return numbered(runs, keys, order, block, "run_no")


def alert_counts(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def paired_differences(runs: DataFrame, config: list[str] = CONFIG, metrics: list[str] = METRICS,
                       baseline: str = BASELINE_MODEL, candidate: str = CANDIDATE_MODEL) -> DataFrame:
    """Candidate minus baseline for runs of equal number, up to the shorter sample.

    `runs` carries `run_no` from `number_runs`. A pair is at most two rows, so pairing is an
    aggregation on (configuration, run number): one shuffle, spread evenly even when one
    configuration holds most runs.
    """
    pairs = (
        runs.where(F.col("model").isin(baseline, candidate))
        .groupBy(*config, "run_no")
        .agg(
            F.count(F.lit(1)).alias("_sides"),
            *[F.max(F.when(F.col("model") == candidate, F.col(m))).alias(f"_c_{m}") for m in metrics],
            *[F.max(F.when(F.col("model") == baseline, F.col(m))).alias(f"_b_{m}") for m in metrics],
        )
        .where(F.col("_sides") == 2)
    )
    differences = pairs.select(*config, *[(F.col(f"_c_{m}") - F.col(f"_b_{m}")).alias(m) for m in metrics])
    return differences.unpivot(config, metrics, "metric", "difference")


DIRECTIONS = {"candidate_greater": 1.0, "baseline_greater": -1.0}


def paired_t_test(differences: DataFrame, config: list[str] = CONFIG) -> DataFrame:
    """One-sided paired t-test in both directions.

    A small p says the named side's values are greater. Fewer than two pairs give p = 0; equal
    differences give 0 or 1 by their sign, and null when there is no difference at all.
    """
    keys = ["metric", *config]
    stats = differences.groupBy(*keys).agg(
        F.count("difference").alias("n"),
        F.avg("difference").alias("mean"),
        F.stddev_samp("difference").alias("sd_diff"),
    )
    both = stats.withColumn(
        "_d", F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(s).alias("sign"))
                                  for d, s in DIRECTIONS.items()]))
    ).select(*keys, F.col("_d.direction").alias("direction"), "n",
             (F.col("mean") * F.col("_d.sign")).alias("mean_diff"), "sd_diff")
    error = F.nullif(F.col("sd_diff") / F.sqrt("n"), F.lit(0.0))
    both = both.withColumn("t", F.when(F.col("n") >= 2, F.col("mean_diff") / error))
    p = (
        F.when(F.col("n") < 2, 0.0)
        .when(F.col("sd_diff") > 0, upper_tail(F.col("t"), F.col("n") - F.lit(1)))
        .when(F.col("mean_diff") > 0, 0.0)
        .when(F.col("mean_diff") < 0, 1.0)
    )
    return both.withColumn("p", p)


def verdicts(tests: DataFrame, config: list[str] = CONFIG, level: float = SIGNIFICANCE) -> DataFrame:
    """Which model needs less, per metric and configuration."""
    keys = ["metric", *config]
    wide = tests.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("direction") == d, F.col("p"))).alias(d) for d in DIRECTIONS],
    )
    candidate, baseline = F.col("candidate_greater"), F.col("baseline_greater")
    verdict = (
        F.when(F.col("n") < 2, "insufficient")
        .when(candidate.isNull() | ((candidate > level) & (baseline > level)), "equal")
        .when(candidate > level, "declarative better")
        .otherwise("baseline better")
    )
    return wide.select(*keys, verdict.alias("verdict"))
