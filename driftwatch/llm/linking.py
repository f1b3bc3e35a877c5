"""From candidate buckets to classes: verified links and distributed union-find."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from driftwatch.llm.tables import saved

# Pivots a bucket tries in the rounds that follow each other; the last number repeats.
PIVOTS = (1, 8, 64, 512)
# From so many candidates of a round on, each member first meets the pivot nearest to it.
MANY_PAIRS = 20_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) as (id, root), root the least id; only ids with a link appear.

    Alternating stars: every larger neighbour is hooked to the least one, then every node and its smaller
    neighbours to the least of them, until nothing changes. Each step is an aggregation to one row per
    node and a join with it, so that the hub of a star is neither collected nor a group in memory.
    """
    edges = saved(_ordered(edges), "edges")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = saved(_ordered(both.join(least, "u").where(F.col("v") > F.col("u"))
                               .select(F.col("m").alias("a"), F.col("v").alias("b"))), "large-star")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        hooked = large.join(low, "b")
        small = saved(_ordered(
            hooked.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(
                low.select(F.col("m").alias("a"), "b"))), "small-star")
        # A star forest: no node is both a root and hooked, and every node is hooked once.
        ends = small.select(F.col("b").alias("id"), F.lit(1).alias("hooked")).unionByName(
            small.select(F.col("a").alias("id"), F.lit(0).alias("hooked")))
        hooks = ends.groupBy("id").agg(F.sum("hooked").alias("times"), F.min("hooked").alias("least"))
        if hooks.where("times > 1 OR times = 1 AND least = 0").isEmpty():
            return small.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(
                small.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
        edges = small


def _ordered(edges: DataFrame) -> DataFrame:
    return (edges.where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def shared_buckets(members: DataFrame) -> DataFrame:
    """The rows (bucket, id) of buckets that hold two ids or more."""
    shared = members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    return members.join(shared.select("bucket"), "bucket", "left_semi")


def _places(sketch: StructType) -> Column:
    """In how many places the sketches of a member and a pivot differ.

    Fields are the bit planes of small numbers, named plane_word; a place differs if it does in any plane.
    """
    words: dict[str, Column] = {}
    for field in sketch.fieldNames():
        differs = F.col(f"sketch.{field}").bitwiseXOR(F.col(f"pivot_sketch.{field}"))
        word = field.rpartition("_")[2]
        words[word] = words[word].bitwiseOR(differs) if word in words else differs
    return reduce(lambda x, y: x + y, map(F.bit_count, words.values()))


def _at_roots(pairs: DataFrame, roots: DataFrame | None, a: str, b: str) -> DataFrame:
    """The pairs with the roots of both ends, as a_root and b_root; an id without a link is its own."""
    for side in (a, b):
        if roots is None:
            pairs = pairs.withColumn(f"{side}_root", F.col(side))
        else:
            root = roots.select(F.col("id").alias(side), F.col("root").alias(f"{side}_root"))
            pairs = pairs.join(root, side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    return pairs


def _merged(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """(id, root) with further links (a, b) taken in. Only the classes that a new link touches are joined anew, as their roots."""
    edges = _at_roots(found, roots, "a", "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    more = saved(components(edges), "merged")
    if roots is None:
        return more
    moved = roots.join(more.select(F.col("id").alias("root"), F.col("root").alias("now")), "root", "left")
    moved = moved.select("id", F.coalesce("now", "root").alias("root"))
    return saved(moved.unionByName(more.join(roots, "id", "left_anti").select("id", "root")), "roots")


def classes(members: DataFrame, verify: Callable[[DataFrame], DataFrame], sketches: DataFrame | None = None,
            apart: int = 0) -> DataFrame:
    """(id, root) for the ids of candidate buckets that verified links connect.

    members: saved rows (bucket, id) of buckets with several ids. verify: keeps the pairs (a, b) that are links.
    sketches: if given, a row (id, sketch) for each id, the sketch a struct of longs; pairs that differ in more than `apart` places
    are no candidates.

    A round compares a few pivots of each bucket with its members of other classes and joins classes. Pivots
    come from outside a bucket's largest class, those with the most candidates in all their buckets first: the text that
    many copies were made from meets most of them and joins them at once. Each serves once, against the whole bucket. The rounds end
    when no bucket has such a member left that has not served. Then for any two members of different
    classes one has served, so every candidate pair that could still join classes was verified; pairs within
    one class need no look, and a group of thousands of copies takes one comparison each. A pair that shares several buckets
    belongs to the least of them alone, so it is not made once for each; `before` holds an id's lesser buckets.
    Where a round has many pairs and sketches are given, each member meets its nearest pivot first, and of the other pairs
    only those that are still of two classes then are verified.
    """
    spark = members.sparkSession
    crowds = members.groupBy("bucket").agg(F.count("*").alias("crowd"))
    # An id has one bucket a band at most, so the list is short.
    owned = members.join(crowds, "bucket").groupBy("id").agg(
        F.sum("crowd").alias("degree"), F.sort_array(F.collect_set("bucket")).alias("all"))
    extra = [] if sketches is None else ["sketch"]
    owned = owned if sketches is None else owned.join(sketches, "id")
    labelled = saved(owned.select("id", "degree", "all", *extra, F.posexplode("all").alias("at", "bucket")).select(
        "bucket", "id", "degree", F.col("id").alias("root"), F.lit(False).alias("served"),
        F.slice("all", F.lit(1), F.col("at")).alias("before"), *extra), "labelled")
    roots = None
    for turn in count():
        sizes = labelled.groupBy("bucket", "root").agg(F.count("*").alias("count"), F.max("degree").alias("degree"))
        tops = sizes.groupBy("bucket").agg(
            F.max(F.struct("count", (-F.col("degree")).alias("apart"), "root")).alias("top"), F.count("*").alias("n"))
        mixed = tops.where("n > 1").select("bucket", F.col("top.root").alias("top"))
        live = labelled.join(mixed, "bucket")
        order = Window.partitionBy("bucket").orderBy(F.desc("degree"), "id")
        width = PIVOTS[min(turn, len(PIVOTS) - 1)]
        pivots = (live.where(~F.col("served") & (F.col("root") != F.col("top")))
                  .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= width)
                  .select("bucket", F.col("id").alias("pivot"), F.col("root").alias("pivot_root"), F.col("before").alias("pivot_before"),
                          *[F.col(c).alias(f"pivot_{c}") for c in extra]))
        pivots = saved(pivots, "pivots")
        if pivots.isEmpty():
            break
        wanted = ~F.arrays_overlap("before", "pivot_before")
        places = F.lit(0)
        if sketches is not None:
            places = _places(sketches.schema["sketch"].dataType)
            wanted = (places <= apart) & wanted
        pairs = saved(live.join(pivots, (live["bucket"] == pivots["bucket"]) & (live["root"] != pivots["pivot_root"]) & wanted)
                      .select("id", "pivot", places.alias("places")), "pairs")
        if sketches is not None and pairs.count() >= MANY_PAIRS:
            nearest = saved(pairs.groupBy("id").agg(F.min(F.struct("places", "pivot")).alias("best"))
                            .select("id", F.col("best.pivot").alias("pivot")), "nearest")
            roots = _merged(roots, verify(_ordered(nearest.toDF("a", "b"))))
            pairs = (_at_roots(pairs, roots, "id", "pivot").where(F.col("id_root") != F.col("pivot_root"))
                     .join(nearest, ["id", "pivot"], "left_anti"))
        pairs = saved(_ordered(pairs.select(F.col("id").alias("a"), F.col("pivot").alias("b"))), "open")
        roots = _merged(roots, saved(verify(pairs), "links"))
        served = pivots.select("bucket", F.col("pivot").alias("id"), F.lit(True).alias("now"))
        labelled = saved(
            live.drop("root", "top").join(roots, "id", "left").join(served, ["bucket", "id"], "left")
            .select("bucket", "id", "degree", F.coalesce("root", "id").alias("root"),
                    (F.col("served") | F.coalesce("now", F.lit(False))).alias("served"), "before", *extra), "labelled")
    if roots is None:
        return spark.createDataFrame([], members.select("id", F.col("id").alias("root")).schema)
    return roots
