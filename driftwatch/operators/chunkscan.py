"""Order-dependent selection over keys of any size.

Some operators pick rows one after another, and each pick depends on the one before. All they carry
forward is the position of the last pick. That makes it possible to split a large key into time chunks:

1. every chunk is scanned as if no pick had happened before it;
2. the picks tell each chunk which pick really came before it;
3. chunks that assumed otherwise are scanned again, until all assumptions hold.

The first chunk of a key is right from the start, so each round settles at least one more chunk per key
and the outcome is the sequential one. Chains that start differently usually meet after a few picks, so
few rounds are needed; in the worst case a key takes as many rounds as it has chunks. Keys of ordinary
size are a single chunk, need one round and take no part in the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftwatch.operators.splitting import ROWS_PER_TASK, cut_rows, hot_keys, whole_rows
from driftwatch.session import ensure_checkpoint_dir

Columns = dict[str, np.ndarray]
Step = Callable[[Columns, int], Columns]


def _pieces(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[tuple[int, int], Columns]]:
    """Cut batches sorted by (key, chunk) where either changes. A long chunk comes in several pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, chunks = batch[key].to_numpy(), batch["chunk"].to_numpy()
        changes = np.flatnonzero((np.diff(keys) != 0) | (np.diff(chunks) != 0)) + 1
        edges = [0, *changes.tolist(), batch.num_rows]
        columns = {name: batch[name].to_numpy(zero_copy_only=False) for name in batch.schema.names}
        for begin, end in zip(edges, edges[1:]):
            part = {name: values[begin:end] for name, values in columns.items()}
            yield (int(keys[begin]), int(chunks[begin])), part


def recent(columns: Columns, lookback_us: int) -> Columns:
    """The rows later steps may look back at, marked as no longer fresh."""
    ts = columns["ts_us"]
    kept = ts >= ts[-1] - lookback_us
    return {name: values[kept] if name != "fresh" else np.zeros(kept.sum(), bool) for name, values in columns.items()}


def appended(before: Columns | None, after: Columns) -> Columns:
    if before is None:
        return after
    return {name: np.concatenate([before[name], after[name]]) for name in after}


def repeat_numbers(positions: np.ndarray, picks: list[int]) -> np.ndarray:
    """For each pick, how many rows of its position there are up to and with it."""
    picks = np.array(picks, np.int64)
    return picks + 1 - np.searchsorted(positions, positions[picks], "left")


def chunked_scan(rows: DataFrame, key: str, step: Step, picks: str, start: int, order: str,
                 lookback_us: int | None = None, rows_per_task: int = ROWS_PER_TASK, ties: list[str] | None = None) -> DataFrame:
    """Scan `rows` per key and return the picked rows: key, `position` and the columns of `picks` (DDL).

    `step(columns, entry)` receives arrays of rows in the order of `order` and the position of the last
    pick before them (`start` if none). It returns arrays of the picks in order: `position` and the
    columns of `picks`. Positions grow along the key. A step that looks back gets, in front of its rows,
    those of the last `lookback_us` with `fresh` false.

    Where positions may repeat, `ties` names columns that settle the order of rows of one position. The step then also gets, as
    `repeat`, how many rows of the last pick's position there are up to it, and returns `repeat` with its picks.

    Rows are sorted by the shuffle, which may spill, and reach Python in batches; memory holds a batch
    and the look-back. For large keys this runs jobs while it builds the result, and keeps their rows and
    each round in the checkpoint folder, so that a lost executor does not undo settled rounds.
    """
    hot = hot_keys(rows, key, rows_per_task)
    fields = T.StructType.fromDDL(picks).fields
    names = ["position", "repeat", *[field.name for field in fields]]
    # A chunk without picks reports its assumption in a single row that is not `picked`.
    schema = T.StructType([
        *[T.StructField(name, T.LongType()) for name in (key, "chunk", "entry", "entry_repeat")],
        T.StructField("picked", T.BooleanType()),
        T.StructField("position", T.LongType()),
        T.StructField("repeat", T.LongType()),
        *fields,
    ])
    arrow = to_arrow_schema(schema)
    nothing = {field.name: [""] if isinstance(field.dataType, T.StringType) else [0] for field in fields}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = {name: [] for name in arrow.names}
        group, entry, last, picked, history = None, (0, 0), (0, 0), False, None

        def add(found: dict, size: int, is_pick: bool) -> None:
            for name in names:
                columns[name].extend(found[name])
            for name, value in ((key, group[0]), ("chunk", group[1]), ("entry", entry[0]), ("entry_repeat", entry[1]),
                                ("picked", is_pick)):
                columns[name].extend([value] * size)

        for piece, values in _pieces(batches, key):
            if piece != group:
                if group is not None and not picked:
                    add({**nothing, "position": [entry[0]], "repeat": [entry[1]]}, 1, False)
                group, entry = piece, (int(values["entry"][0]), int(values["entry_repeat"][0]))
                picked, history = False, None
                last = entry
            seen = appended(history, values)
            found = step(seen, last[0], repeat=last[1]) if ties else step(seen, last[0])
            size = len(found["position"])
            if size:
                found.setdefault("repeat", [0] * size)
                add(found, size, True)
                picked, last = True, (int(found["position"][-1]), int(found["repeat"][-1]))
            if lookback_us is not None:
                history = recent(seen, lookback_us)
            if len(columns[key]) >= 10_000:
                yield pa.RecordBatch.from_pydict(columns, schema=arrow)
                columns = {name: [] for name in arrow.names}
        if group is not None and not picked:
            add({**nothing, "position": [entry[0]], "repeat": [entry[1]]}, 1, False)
        yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    def run(assumed: DataFrame) -> DataFrame:
        # Python sees whatever a task holds, and asks the planner for nothing. Spreading by a hash of the
        # keys, not by the keys, makes this shuffle differ from any layout below it, so it is always kept.
        ordered = assumed.repartition(F.xxhash64(key, "chunk")).sortWithinPartitions(key, "chunk", order, *(ties or []))
        return ordered.mapInArrow(scan, schema)

    first = {"entry": F.lit(start).cast("bigint"), "entry_repeat": F.lit(0).cast("bigint")}
    result = [key, *[name for name in names if name != "repeat"]]
    small = rows if hot is None else rows.join(hot, key, "left_anti")
    settled_at_once = run(whole_rows(small, lookback_us).withColumns(first)).where("picked").select(*result)
    if hot is None:
        return settled_at_once

    ensure_checkpoint_dir(rows.sparkSession)
    chunked = cut_rows(rows, key, hot, rows_per_task, lookback_us).checkpoint()
    earlier = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    done = run(chunked.withColumns(first)).checkpoint()
    assumed, exit = F.struct("entry", "entry_repeat"), F.struct(F.col("position").alias("entry"), F.col("repeat").alias("entry_repeat"))
    while True:
        chunks = done.groupBy(key, "chunk").agg(
            F.max(assumed).alias("assumed"), F.max(F.when(F.col("picked"), exit)).alias("exit")
        )
        before = F.struct(*[column.alias(name) for name, column in first.items()])
        wrong = (
            chunks.withColumn("before", F.coalesce(F.last("exit", ignorenulls=True).over(earlier), before))
            .where(F.col("before") != F.col("assumed"))
            .select(key, "chunk", "before.*")
            .checkpoint()
        )
        if wrong.isEmpty():
            return settled_at_once.unionByName(done.where("picked").select(*result))
        settled = done.join(wrong, [key, "chunk"], "left_anti").select(*schema.names)
        done = settled.unionByName(run(chunked.join(wrong, [key, "chunk"]))).checkpoint()


def first_true(flags: Callable[[int, int], np.ndarray], start: int, stop: int) -> int:
    """First index in [start, stop) whose flag holds, or `stop`; flags are computed in growing blocks."""
    size = 64
    while start < stop:
        end = min(stop, start + size)
        hits = np.flatnonzero(flags(start, end))
        if len(hits):
            return start + int(hits[0])
        start, size = end, size * 2
    return stop


def first_fresh(columns: Columns) -> int:
    """Index of the first row that belongs to the chunk itself."""
    fresh = columns["fresh"]
    return int(fresh.argmax()) if fresh.any() else len(fresh)
