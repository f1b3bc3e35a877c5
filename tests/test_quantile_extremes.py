"""Quantiles of large groups that hold infinite, undefined and very large values."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from driftwatch.operators import quantiles

P = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _rows(spark):
    random.seed(5)
    values = {
        "both": [random.gauss(0, 1) for _ in range(2000)] + [math.inf] * 3 + [-math.inf] * 2,
        "nan": [random.gauss(0, 1) for _ in range(500)] + [math.nan] * 100 + [math.inf] * 50,
        "only": [math.inf] * 40 + [-math.inf] * 40,
        "wide": [-1.7e308, 1.7e308, *[float(k) for k in range(100)]],
    }
    return spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")


def test_narrowing_agrees_with_the_built_in_percentile(spark):
    rows = _rows(spark)
    got = {r.k: r for r in quantiles.exact_quantiles(rows, ["k"], "v", P, rows_per_task=20).collect()}
    for want in rows.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", P).alias("q")).collect():
        assert got[want.k].n == want.n
        assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(got[want.k].q, want.q)), want.k


def test_images_keep_the_order(spark):
    values = [-math.inf, -1.7e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, math.nextafter(1.0, 2.0), 1.7e308, math.inf, math.nan]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    got = rows.select("k", quantiles.image_of("v").alias("image")).orderBy("k").collect()
    images = [r.image for r in got]
    assert images == sorted(images) and images[4] == images[5] and len(set(images)) == len(images) - 1
    back = rows.select("k", quantiles.value_of(quantiles.image_of("v")).alias("v")).orderBy("k").collect()
    assert all(r.v == v or math.isnan(r.v) and math.isnan(v) for r, v in zip(back, values))


def test_a_million_values_within_few_bits(spark):
    """Neighbouring doubles, which no histogram of equal widths tells apart, and no task with more than a table of counts."""
    ulp = math.ulp(1.0)
    rows = spark.range(1_000_000, numPartitions=8).select(
        F.lit("near").alias("k"), (F.lit(1.0) + (F.col("id") * 7919 % 1_000_000) * F.lit(ulp)).alias("v"))
    q = quantiles.exact_quantiles(rows, ["k"], "v", P, rows_per_task=1000).first()
    assert q.n == 1_000_000
    for p, got in zip(P, q.q):
        place = p * 999_999
        assert abs((got - 1.0) / ulp - place) <= 1
    wide = rows.select("k", quantiles.image_of("v").alias("image"))
    counts = wide.groupBy("k", F.shiftright("image", 16).alias("prefix"), F.col("image").bitwiseAND(65535).alias("digit")).count()
    assert counts.groupBy("k", "prefix").count().agg(F.max("count")).first()[0] <= 65536


def test_many_groups_without_broadcast(spark):
    draw = random.Random(8)
    data = [(draw.randrange(30), draw.choice([draw.gauss(0, 5), float(draw.randrange(4))])) for _ in range(4000)]
    rows = spark.createDataFrame([(k, v) for k, v in data], "k int, v double")
    images = rows.select("k", quantiles.image_of("v").alias("image"))
    wanted = spark.createDataFrame([(k, s, r) for k in range(30) for s, r in enumerate((0, 17, 80))], "k int, slot int, rank bigint")
    got = quantiles.selected(images, ["k"], wanted, broadcast_rows=0).withColumn("v", quantiles.value_of("image")).collect()
    for r in got:
        assert r.v == sorted(v for k, v in data if k == r.k)[(0, 17, 80)[r.slot]]
    assert len(got) == 90
