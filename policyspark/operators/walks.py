"""Rows walked in order with a state by key; a key's rows may be spread over any number of tasks.

The rows are range-partitioned by key and order, so that a partition holds a stretch of the sequence of all rows, and a key with
very many rows is cut into many stretches.  Every stretch is walked at once, each key as if it began there.  What that gets wrong
are rows at the head of a stretch, of a key that the stretch before ends with:

* a *cut* is a row whose outcome and state don't depend on the state before it (a gap, a changed event); from a stretch's first
  cut on all is right, and so is the state that it ends with;
* the rows before it are walked again with the state that the stretch before ends with.  A stretch without any cut may then
  end with another state, so that the next one is walked again as well.  States mostly agree after a few rows; where they don't,
  each round joins twice as many neighbouring stretches into one walk, so that there are log2 of their number rounds at most.

What passes the driver is one row for each stretch (partition): its first and last key and the state at its end.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.tables import stored

#: Names of our own; the rows must not have them.
PART, OPEN, SUMMARY = "__part", "__open", "__summary"


def _frozen(x):
    """Lists of JSON as the tuples that they were."""
    return tuple(_frozen(v) for v in x) if isinstance(x, list) else x


def _dumped(x) -> str:
    return json.dumps(x, default=str)


def _batches(batch: pa.RecordBatch, key: str, columns: list[str]):
    make = namedtuple("Row", columns)._make
    return zip(batch.column(key).to_pylist(), map(make, zip(*[batch.column(c).to_pylist() for c in columns], strict=True)) if columns else [()] * batch.num_rows, strict=True)


def _first_walk(key: str, columns: list[str], step: Callable, cut: Callable | None, names: list[str], types: list[pa.DataType], batches):
    """Walks a stretch; adds outcome, the stretch's number and whether the row depends on the state before the stretch, and at last a
    row that sums the stretch up.
    """
    part = TaskContext.get().partitionId()
    now, first, state, memo, runs, is_open = None, None, None, None, 0, True
    for batch in batches:
        outcomes, opens = [], []
        for k, row in _batches(batch, key, columns):
            if not runs or k != now:
                now, state, memo, runs = k, None, None, runs + 1
                first, is_open = (k, True) if runs == 1 else (first, False)
            if cut:
                certain, memo = cut(memo, row)
                is_open = is_open and not certain
            found, state = step(state, row)
            outcomes.append(found)
            opens.append(is_open)
        own = [pa.array(outcomes, pa.string()), pa.array([part] * batch.num_rows, pa.int32()), pa.array(opens, pa.bool_()), pa.nulls(batch.num_rows, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *own], names)
    if runs:
        told = {"first": _dumped(first), "last": _dumped(now), "exit": _dumped(state), "open": is_open and runs == 1}
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types], pa.nulls(1, pa.string()), pa.array([part], pa.int32()), pa.array([False]), pa.array([json.dumps(told)])], names)


def _next_walk(columns: list[str], step: Callable, outcome: str, entries: dict[int, tuple[int, str]], names: list[str], types: list[pa.DataType], batches):
    """Walks chunks of stretches, sorted, each from its entry state; ``entries``: {stretch: (chunk, entry of the chunk)}."""
    now, chunk, state = None, None, None

    def told(part):
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types], pa.nulls(1, pa.string()), pa.array([part], pa.int32()), pa.array([True]), pa.array([_dumped(state)])], names)

    for batch in batches:
        outcomes, ended = [], []
        for part, row in _batches(batch, PART, columns):
            if part != now:
                if now is not None:
                    ended.append(told(now))
                now = part
                if entries[part][0] != chunk:
                    chunk, state = entries[part][0], _frozen(json.loads(entries[part][1]))
            found, state = step(state, row)
            outcomes.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(outcomes, pa.string()) if n == outcome else batch.column(n) for n in names], names)
        yield from ended
    if now is not None:
        yield told(now)


def walked(df: DataFrame, key: str, order: list[str], columns: list[str], step: Callable, outcome: str = "outcome", cut: Callable | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with a string column ``outcome`` added: what ``step(state or None, row of columns)`` returns, with the new state.

    States are tuples of strings, numbers, nulls and such tuples.  ``cut(memo or None, row)`` returns (whether the row's outcome
    and state are certain whatever the state before, new memo); the memo is null at a key's first row in a stretch.  ``parts``:
    number of stretches (by default Spark's number of shuffle partitions, joined where they are small).  Memory is bounded by
    an Arrow batch.  Null keys are one key; rows that ``order`` leaves equal may be walked in any order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, own = df.sparkSession, df.columns
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    schema = T.StructType([*fields, T.StructField(outcome, T.StringType()), T.StructField(PART, T.IntegerType()), T.StructField(OPEN, T.BooleanType()), T.StructField(SUMMARY, T.StringType())])
    types, names = [f.type for f in to_arrow_schema(T.StructType(fields))], schema.names
    by: list[str | Column] = [key, *order]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    first = stored(ranged.sortWithinPartitions(*by).mapInArrow(lambda batches: _first_walk(key, columns, step, cut, names, types, batches), schema))
    told = {r[PART]: json.loads(r[SUMMARY]) for r in first.where(F.col(SUMMARY).isNotNull()).select(PART, SUMMARY).collect()}
    numbers = sorted(told)
    before = {p: q for q, p in zip(numbers, numbers[1:], strict=False) if told[p]["first"] == told[q]["last"]}  # stretches that a key goes on in
    ends = {p: told[p]["exit"] for p in numbers}
    used = {p: _dumped(None) for p in before}
    taken, tables, length = {}, [first], 1
    while pending := [p for p in before if used[p] != ends[before[p]]]:
        entries: dict[int, tuple[int, str]] = {}
        chunk: list[int] = []
        for p in pending:
            # a chunk goes on while each stretch follows the one before and its end depends on what it begins with
            if not (chunk and before[p] == chunk[-1] and told[chunk[-1]]["open"] and len(chunk) < length):
                chunk = []
            chunk.append(p)
            entries[p] = (chunk[0], ends[before[chunk[0]]])
        again = first.where(F.col(OPEN) & F.col(PART).isin(list(entries))) if len(entries) < 1000 else first.where(OPEN).join(F.broadcast(spark.createDataFrame([(p,) for p in entries], f"{PART} int")), PART).select(*names)
        chunk_of = F.broadcast(spark.createDataFrame([(p, c) for p, (c, _) in entries.items()], f"{PART} int, __chunk int"))  # a row a stretch
        dealt = again.join(chunk_of, PART).repartition("__chunk").sortWithinPartitions("__chunk", PART, *order)
        shared = spark.sparkContext.broadcast(entries)
        redone = stored(dealt.select(*names).mapInArrow(lambda batches, shared=shared: _next_walk(columns, step, outcome, shared.value, names, types, batches), schema))
        exits = {r[PART]: r[SUMMARY] for r in redone.where(F.col(SUMMARY).isNotNull()).select(PART, SUMMARY).collect()}
        for p, (c, entry) in entries.items():
            used[p] = entry if p == c else exits.get(before[p], used[before[p]])
            if told[p]["open"]:
                ends[p] = exits[p]
            taken[p] = len(tables)
        tables.append(redone)
        length *= 2
    if not taken:
        return first.where(F.col(SUMMARY).isNull()).select(*own, outcome)
    last = F.broadcast(spark.createDataFrame(list(taken.items()), f"{PART} int, __last int"))  # a row a stretch
    out = None
    for i, t in enumerate(tables):
        rows = t.where(F.col(SUMMARY).isNull()).join(last, PART, "left")
        rows = rows.where(~F.col(OPEN) | F.col("__last").isNull()) if i == 0 else rows.where(F.col("__last") == i)
        out = rows.select(*own, outcome) if out is None else out.unionAll(rows.select(*own, outcome))
    return out
