"""URL filters by a temporal list join.

A dated list tells from when on a pattern is blocked, allowed again or dropped. Each entry holds until the next one of
its pattern, which makes validity intervals. A capture is judged by the entries active when it was fetched: those of its
host, of every parent domain, and of its host with the first path segment. The most specific active entry decides.

A capture meets the entries of a pattern by an as-of join: per pattern and time chunk the last entry before the chunk is
carried in, and captures and entries of the chunk are merged in time order. Chunks with many captures are salted,
with a copy of their entries for each salt, so a pattern with a third of all captures is many small groups.

Defined cases: a null or malformed URL has no pattern and is kept; so is a capture without a time. An entry without
pattern or time is left out. Of entries with one pattern and time the last by action name holds. An entry is active from its own
instant on. Repeated captures are judged each. Empty lists keep all, and an empty table of captures gives no rows.
Columns of captures other than the named ones play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftwatch.llm.tables import saved

CHUNK_SECONDS = 86_400
SALT_ROWS = 50_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or the dot at its end; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))
    return F.when(host != "", host)


def section_of(url: Column) -> Column:
    """Host and first path segment; null if the path has none."""
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    return F.when((segment != "") & host_of(url).isNotNull(), F.concat(host_of(url), F.lit("/"), segment))


def patterns(url: Column) -> Column:
    """(pattern, weight) of a URL, the more specific the heavier: domains by their labels, the section above all."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.struct(
        F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("pattern"), n.alias("weight")))
    section = F.array(F.struct(section_of(url).alias("pattern"), F.lit(1000).alias("weight")))
    both = F.concat(F.when(host_of(url).isNotNull(), domains), section)
    return F.filter(both, lambda p: p["pattern"].isNotNull())


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (pattern, action, listed_at in seconds) as intervals [valid_from, valid_to); an open end is null.

    One entry per pattern and instant is left. The interval ends are for reports; the join needs the starts only.
    """
    once = (entries.where("pattern IS NOT NULL AND listed_at IS NOT NULL")
            .groupBy("pattern", "listed_at").agg(F.max("action").alias("action")))
    ends = F.lead("listed_at").over(Window.partitionBy("pattern").orderBy("listed_at"))
    return once.select("pattern", "action", F.col("listed_at").alias("valid_from"), ends.alias("valid_to"))


def active_entries(asked: DataFrame, entries: DataFrame, chunk_seconds: int = CHUNK_SECONDS,
                   salt_rows: int = SALT_ROWS) -> DataFrame:
    """As-of join: rows (ask, pattern, at) with the entry of their pattern active at `at`, if there is one.

    Adds action and valid_from. Rows that share pattern and time are merged in one group of bounded size.
    """
    chunk = F.call_function("div", F.col("at"), F.lit(chunk_seconds).cast("bigint"))
    asked = asked.withColumn("chunk", chunk)
    entry = F.struct(F.col("valid_from"), F.col("action"))
    listed = entries.withColumn("at", F.col("valid_from")).withColumn("chunk", chunk).withColumn("entry", entry)
    load = asked.groupBy("pattern", "chunk").agg(F.count("*").alias("asks"))
    last = listed.groupBy("pattern", "chunk").agg(F.max("entry").alias("last"))
    before = Window.partitionBy("pattern").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (load.join(last, ["pattern", "chunk"], "full_outer")
              .withColumn("carried", F.last("last", True).over(before))
              .where("asks IS NOT NULL")
              .select("pattern", "chunk", "carried", F.ceil(F.col("asks") / salt_rows).cast("int").alias("salts")))
    chunks = saved(chunks, "chunks")
    asks = asked.join(chunks, ["pattern", "chunk"]).select(
        "pattern", "chunk", "at", "ask", "carried", F.pmod(F.xxhash64("ask"), F.col("salts")).cast("int").alias("salt"),
        F.lit(None).cast(listed.schema["entry"].dataType).alias("entry"))
    spread = listed.join(chunks, ["pattern", "chunk"]).select(
        "pattern", "chunk", "at", F.lit(None).cast(asked.schema["ask"].dataType).alias("ask"), "carried",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "entry")
    # Entries come before captures of the same instant.
    order = Window.partitionBy("pattern", "chunk", "salt").orderBy("at", F.col("entry").isNull())
    now = F.coalesce(F.last("entry", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried"))
    return (asks.withColumn("is_ask", F.lit(True)).unionByName(spread.withColumn("is_ask", F.lit(False)))
            .withColumn("now", now).where("is_ask AND now IS NOT NULL")
            .select("ask", "pattern", F.col("now.action").alias("action"), F.col("now.valid_from").alias("valid_from")))


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
           time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: id, fetched_at, host, verdict (keep or drop), pattern, listed_at (null if nothing was active).

    captures: time in seconds. entries: (pattern, action, listed_at in seconds); action block, allow or unlist.
    """
    rows = saved(captures.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(time_col).cast("bigint").alias("at"))
        .withColumn("ask", F.monotonically_increasing_id()), "captures")
    asked = (rows.where("at IS NOT NULL").select("ask", "at", F.explode(patterns(F.col("url"))).alias("p"))
             .select("ask", "at", "p.pattern", "p.weight"))
    # The weight is known from the pattern: sections have a slash, domains are as heavy as they have labels.
    active = active_entries(asked.select("ask", "pattern", "at"), validity(entries)).where("action != 'unlist'")
    weight = F.when(F.contains("pattern", F.lit("/")), 1000).otherwise(F.size(F.split("pattern", r"\.")))
    decisive = active.groupBy("ask").agg(F.max_by(F.struct("action", "pattern", "valid_from"), weight).alias("entry"))
    return rows.join(decisive, "ask", "left").select(
        "page_id", F.col("at").alias("fetched_at"), host_of(F.col("url")).alias("host"),
        F.when(F.col("entry.action") == "block", "drop").otherwise("keep").alias("verdict"),
        F.col("entry.pattern").alias("pattern"), F.col("entry.valid_from").alias("listed_at"))
