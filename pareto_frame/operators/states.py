"""Mergeable skyline states: the frontier of each group, packed into binary columns.

A state holds distinct tuples, none of which dominates another, as 64-bit integers in Spark's sort order of
their dimensions (zeros come back without a sign). States of parts of the rows, of other keys below a coarser one, or of yesterday and today
merge into the state of the whole, so frontiers can be stored and rolled up without the rows.

Merging goes in a salted tree: up to FAN states of a group meet in one step, so a group with states from
every partition is as spread as any. A batch of states is one array, whatever the number of groups.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pareto_frame.functions.dominance import every
from pareto_frame.operators.local import (
    _buffered,
    _group_codes,
    _sweep_groups,
    _total_order,
    local_skyline,
    supports,
)
from pareto_frame.operators.merge import global_skyline
from pareto_frame.session import default_partitions, materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE, SALT = "state", "__sky_salt"
#: Most tuples of one state; a larger frontier is several states of its group.
STATE_ROWS = 50_000
#: States of a group that meet in one step of the tree.
FAN = 16
#: A level that leaves more than this share of the states has to do with frontiers beyond STATE_ROWS.
WORTHWHILE = 0.8


def skyline_states(df: DataFrame, keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """``keys`` and STATE: what a local pass leaves of each group in each scan partition. No shuffle.

    Rows with a null dimension take no part; null keys are groups of their own.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    if not all(supports(types[c]) for c in dims):
        raise ValueError("dimensions of a state have an exact 64-bit form: numbers, decimals up to 18 digits, times")
    complete = df.filter(every([F.col(c).isNotNull() for c in dims]))
    local = local_skyline(complete, dims, keys) if keys else local_skyline(complete, dims)
    laid = local.sortWithinPartitions(*keys) if keys else local
    schema = T.StructType([*df.select(*keys).schema.fields, T.StructField(STATE, T.BinaryType())])
    return laid.mapInArrow(partial(_pack_tuples, n_keys=len(keys)), schema)


def merge_states(states: DataFrame, keys: Sequence[str], dims: Sequence[T.StructField]) -> DataFrame:
    """The states of the groups of ``keys``, from any states of the same ``dims``; other columns are dropped.

    Keys may be fewer than those of the states. A group has one state, or several if its frontier
    has more than STATE_ROWS tuples.
    """
    n = default_partitions(states)
    phase = materialise(states.select(*keys, STATE))
    while True:
        sizes = phase.rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return phase.rows
        buckets = ceil(most / FAN)
        salt = F.pmod(F.xxhash64(STATE), F.lit(buckets)).cast("int").alias(SALT)
        salted = phase.rows.select(*keys, salt, STATE)
        laid = salted.repartition(n, *keys, SALT).sortWithinPartitions(*keys, SALT)
        merge = partial(_merge_sorted, n_keys=len(keys) + 1, width=len(dims))
        merged = materialise(laid.mapInArrow(merge, salted.schema))
        if buckets == 1:
            return merged.rows.drop(SALT)
        if merged.count > WORTHWHILE * phase.count:
            tuples = state_rows(merged.rows.drop(SALT), keys, dims)
            whole = global_skyline(materialise(tuples.distinct()), [f.name for f in dims], keys)
            return _packed_again(whole, keys, [f.name for f in dims], n)
        phase = merged


def _packed_again(rows: DataFrame, keys: Sequence[str], names: Sequence[str], n: int) -> DataFrame:
    laid = rows.select(*keys, *names).repartition(n, *keys, *names).sortWithinPartitions(*keys)
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField(STATE, T.BinaryType())])
    return laid.mapInArrow(partial(_pack_tuples, n_keys=len(keys)), schema)


def state_rows(states: DataFrame, keys: Sequence[str], dims: Sequence[T.StructField]) -> DataFrame:
    """``keys`` and the tuples of their states, in the names and types of ``dims``."""
    schema = T.StructType([*states.select(*keys).schema.fields, *dims])
    types = [to_arrow_type(f.dataType) for f in dims]
    names = [f.name for f in schema.fields]
    return states.select(*keys, STATE).mapInArrow(partial(_unpack, n_keys=len(keys), types=types, names=names), schema)


# Inside the tasks


def _points(states: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All tuples of a column of states, a row each, and how many each state has."""
    binary = states.cast(pa.large_binary()).combine_chunks()
    if isinstance(binary, pa.ChunkedArray):
        binary = binary.chunk(0)
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(flat.tobytes(), np.int64).reshape(-1, width)
    return points, np.diff(offsets) // (8 * width)


def _states(keys: pa.Table, points: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row of ``keys`` for every run of ``counts`` points, or several if it has more than STATE_ROWS."""
    pieces = np.maximum(1, -(-counts // STATE_ROWS))
    owner = np.repeat(np.arange(len(counts)), pieces)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(np.cumsum(counts) - counts, pieces) + place * STATE_ROWS
    if not len(first):
        return
    ends = np.append(first, counts.sum()) * 8 * points.shape[1]
    # a column of states may be larger than 32-bit offsets allow, so it goes in parts
    step = max(1, (1 << 30) // (8 * points.shape[1] * STATE_ROWS))
    data = pa.py_buffer(np.ascontiguousarray(points, np.int64).tobytes())
    for at in range(0, len(first), step):
        offsets = ends[at : at + step + 1]
        part = pa.py_buffer(data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])))
        cut = pa.py_buffer((offsets - offsets[0]).astype(np.int32).tobytes())
        states = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, cut, part])
        taken = keys.take(pa.array(owner[at : at + step])).combine_chunks()
        yield from pa.table([*taken.columns, states], [*keys.schema.names, STATE]).combine_chunks().to_batches()


def _runs(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))


def _codes(table: pa.Table, n_keys: int) -> np.ndarray:
    return _group_codes(table.columns[:n_keys]) if n_keys else np.zeros(table.num_rows, dtype=np.int64)


def _pack_tuples(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Tuples listed by key; the last group of a buffer waits for the next one, up to STATE_ROWS tuples."""
    held = None
    for table in _buffered(batches):
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        starts = _runs(_codes(table, n_keys))
        whole = int(starts[-1])
        if table.num_rows - whole >= STATE_ROWS:
            whole = table.num_rows
        yield from _pack_table(table.slice(0, whole), n_keys)
        held = table.slice(whole) if whole < table.num_rows else None
    if held is not None:
        yield from _pack_table(held, n_keys)


def _pack_table(table: pa.Table, n_keys: int) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    starts = _runs(_codes(table, n_keys))
    points = np.stack([_total_order(c) for c in table.columns[n_keys:]], axis=1)
    counts = np.diff(np.append(starts, table.num_rows))
    keys = table.select(list(range(n_keys))).take(pa.array(starts)) if n_keys else _NoKeys()
    yield from _states(keys, points, counts)


class _NoKeys:
    """Stands for a table without columns, which has no rows of its own."""

    schema, columns = pa.schema([]), []

    def take(self, rows: pa.Array) -> _NoKeys:
        return self

    def combine_chunks(self) -> _NoKeys:
        return self


def _merge_sorted(batches: Iterator[pa.RecordBatch], n_keys: int, width: int) -> Iterator[pa.RecordBatch]:
    """States listed by key: those of equal keys become one frontier. The last group waits for the next buffer."""
    held = None
    for table in _buffered(batches):
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        whole = int(_runs(_codes(table, n_keys))[-1])
        for batch in _merge_table(table.slice(0, whole), n_keys, width):
            yield batch
        held = table.slice(whole)
        if held.num_rows > 1:
            # merged at once, so that what waits is a frontier and not all its states
            held = pa.Table.from_batches(list(_merge_table(held, n_keys, width)))
    if held is not None:
        yield from held.combine_chunks().to_batches()


def _merge_table(table: pa.Table, n_keys: int, width: int) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    starts = _runs(_codes(table, n_keys))
    group = np.zeros(table.num_rows, dtype=np.int64)
    group[starts[1:]] = 1
    points, counts = _points(table.column(n_keys), width)
    codes = np.repeat(np.cumsum(group), counts)
    # in lexicographic order dominators come first
    order = np.lexsort([*points.T[::-1], codes])
    points, codes = points[order], codes[order]
    stay = _sweep_groups(list(points.T), codes)
    keys = table.select(list(range(n_keys))).take(pa.array(starts))
    yield from _states(keys, points[stay], np.bincount(codes[stay], minlength=len(starts)))


def _unpack(
    batches: Iterator[pa.RecordBatch], n_keys: int, types: list[pa.DataType], names: list[str]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        points, counts = _points(pa.chunked_array([batch.column(n_keys)]), len(types))
        owner = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        keys = [batch.column(i).take(owner) for i in range(n_keys)]
        values = [_value(points[:, i], kind) for i, kind in enumerate(types)]
        yield from pa.table([*keys, *values], names).to_batches(max_chunksize=1 << 16)


def _value(order: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The inverse of ``_total_order``."""
    order = np.ascontiguousarray(order)
    if pa.types.is_floating(kind):
        bits = np.where(order < 0, order ^ np.int64(0x7FFFFFFFFFFFFFFF), order)
        return pa.array(bits.view(np.float64)).cast(kind)
    if pa.types.is_decimal(kind):
        words = np.stack([order, order >> 63], axis=1)
        return pa.Array.from_buffers(kind, len(order), [None, pa.py_buffer(np.ascontiguousarray(words).tobytes())])
    if pa.types.is_date32(kind):
        return pa.array(order.astype(np.int32)).cast(kind)
    if pa.types.is_boolean(kind):
        return pa.array(order.astype(bool))
    return pa.array(order).cast(kind)
