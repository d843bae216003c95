"""Local skylines: the one place where rows pass through Python.

``mapInArrow`` hands each task its own partition as a stream of Arrow batches.
Only the dimension columns (and group keys) are shipped, and what a task keeps
is its current set of non-dominated tuples, not its partition.

Dimensions are compared as 64-bit integers in Spark's own sort order, so large
integers, decimals, times and NaN need no lossy conversion.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The task function travels with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BUFFER_ROWS = 32_768
_BLOCK_ROWS = 256
_PANEL_ROWS = 8_192
_MOST_KEPT = 500_000
OVER = "__sky_over"


def supports(dtype: T.DataType) -> bool:
    """Whether the type has an exact order-preserving 64-bit form."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision <= 18
    exact = (
        T.IntegralType,
        T.FloatType,
        T.DoubleType,
        T.DateType,
        T.TimestampType,
        T.TimestampNTZType,
        T.BooleanType,
    )
    return isinstance(dtype, exact)


def local_skyline(
    df: DataFrame,
    dims: Sequence[str],
    keys: Sequence[str] = (),
    presorted: bool = False,
    by_key: bool = False,
) -> DataFrame:
    """Distinct non-dominated tuples of every partition, per key if keys are given.

    ``by_key`` partitions list the rows of each key together: a task then holds the skyline
    of one key at a time. Otherwise a task holds those of all keys it has met, up to
    ``_MOST_KEPT`` rows; beyond, it lets them go and starts anew, so that a tuple may come
    twice and the result is a first reduction only.

    ``presorted`` partitions must list dominators before what they dominate (any
    monotone score, then the dimensions). A kept tuple is then final and leaves
    at once; otherwise later tuples may evict earlier ones. Without nulls in ``dims``.

    Without keys a task holds at most about ``_MOST_KEPT`` tuples as well: beyond, an unsorted pass lets
    them go and starts anew, and a sorted one compares with the first ones only. ``window_pass``
    is the pass whose result is exact with any bound.
    """
    narrow = df.select(*keys, *dims)
    task = partial(
        _frontier_of_partition, n_keys=len(keys), presorted=presorted, by_key=by_key
    )
    return narrow.mapInArrow(task, narrow.schema)


def _frontier_of_partition(
    batches: Iterator[pa.RecordBatch], n_keys: int, presorted: bool, by_key: bool = False
) -> Iterator[pa.RecordBatch]:
    if n_keys:
        tables = _keep_per_group(batches, n_keys, by_key)
    elif presorted:
        tables = _keep_in_order(batches)
    else:
        tables = _keep_with_eviction(batches)
    for table in tables:
        yield from table.combine_chunks().to_batches()


def _keep_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted input: what survives all earlier tuples is final."""
    kept = None
    for table in _buffered(batches):
        order = [_total_order(c) for c in table.columns]
        rows = np.arange(table.num_rows)
        if kept is not None:
            rows = np.flatnonzero(~_covered(order, kept))
        rows = rows[_sweep([o[rows] for o in order])]
        if rows.size:
            if kept is None or len(kept[0]) < _MOST_KEPT:
                kept = _append(kept, [o[rows] for o in order])
            yield table.take(pa.array(rows))


def _keep_with_eviction(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Any input order: new tuples are tested both ways against the kept ones."""
    kept, kept_order, scale = None, None, None
    for table in _buffered(batches):
        order = [_total_order(c) for c in table.columns]
        scale = scale or [_linear_scale(c) for c in table.columns]
        rows = _dominators_first(table.columns, order, None, scale)
        if kept is not None:
            rows = rows[~_covered([o[rows] for o in order], kept_order)]
        rows = rows[_sweep([o[rows] for o in order])]
        if rows.size == 0:
            continue
        fresh, fresh_order = table.take(pa.array(rows)), [o[rows] for o in order]
        if kept is not None:
            stay = np.flatnonzero(~_covered(kept_order, fresh_order))
            fresh = pa.concat_tables([kept.take(pa.array(stay)), fresh])
            fresh_order = _append([o[stay] for o in kept_order], fresh_order)
        kept, kept_order = fresh, fresh_order
        if kept.num_rows > _MOST_KEPT:
            yield kept
            kept, kept_order = None, None
    if kept is not None:
        yield kept


def window_pass(df: DataFrame, dims: Sequence[str], window: int) -> DataFrame:
    """One pass with a window of at most ``window`` tuples over every partition; adds OVER.

    Rows with OVER false are not dominated in their partition, finally. Those with OVER true have to
    go through another pass among each other: tuples that found the window full, and tuples of the window
    that have not met all of those.
    """
    narrow = df.select(*dims)
    schema = T.StructType([*narrow.schema.fields, T.StructField(OVER, T.BooleanType())])
    return narrow.mapInArrow(partial(_through_window, window=window), schema)


def _through_window(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    kept, kept_order, scale = None, None, None
    # of each kept tuple, whether it came before the first one that was turned away
    early, turned_away = np.zeros(0, dtype=bool), False

    def out(table: pa.Table, over: bool) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            flag = pa.array(np.full(table.num_rows, over))
            yield from table.append_column(OVER, flag).combine_chunks().to_batches()

    for table in _buffered(batches):
        order = [_total_order(c) for c in table.columns]
        scale = scale or [_linear_scale(c) for c in table.columns]
        rows = _dominators_first(table.columns, order, None, scale)
        if kept is not None:
            rows = rows[~_covered([o[rows] for o in order], kept_order)]
        rows = rows[_sweep([o[rows] for o in order])]
        if kept is not None and rows.size:
            stay = np.flatnonzero(~_covered(kept_order, [o[rows] for o in order]))
            kept, kept_order = kept.take(pa.array(stay)), [o[stay] for o in kept_order]
            early = early[stay]
        room = window - len(early)
        fits, rest = rows[:room], rows[room:]
        if fits.size:
            fresh = table.take(pa.array(fits))
            kept = fresh if kept is None else pa.concat_tables([kept, fresh])
            kept_order = _append(kept_order, [o[fits] for o in order])
            # it has met all tuples of this buffer, but none that was turned away before
            early = np.concatenate([early, np.full(fits.size, not turned_away)])
        if rest.size:
            turned_away = True
            yield from out(table.take(pa.array(rest)), True)
    if kept is not None:
        for over in (False, True):
            yield from out(kept.take(pa.array(np.flatnonzero(early != over))), over)


def _keep_per_group(
    batches: Iterator[pa.RecordBatch], n_keys: int, by_key: bool
) -> Iterator[pa.Table]:
    """Any input order of tuples; they only compete within their group."""
    kept, scale = None, None
    # waiting for as many new rows as are kept makes the repeated sweeps linear
    for table in _buffered(batches, lambda: kept.num_rows if kept is not None else 0):
        scale = scale or [_linear_scale(c) for c in table.columns[n_keys:]]
        if kept is not None:
            table = pa.concat_tables([kept, table]).combine_chunks()
        order = [_total_order(c) for c in table.columns[n_keys:]]
        codes = _group_codes(table.columns[:n_keys])
        rows = _dominators_first(table.columns[n_keys:], order, codes, scale)
        rows = rows[_sweep_groups([o[rows] for o in order], codes[rows])]
        if by_key:
            # only the group of the last row may go on
            open_group = codes[rows] == codes[-1]
            if not open_group.all():
                yield table.take(pa.array(rows[~open_group]))
            rows = rows[open_group]
        kept = table.take(pa.array(rows))
        if not by_key and kept.num_rows > _MOST_KEPT:
            yield kept
            kept = None
    if kept is not None:
        yield kept


def _append(old: list[np.ndarray] | None, new: list[np.ndarray]) -> list[np.ndarray]:
    if old is None:
        return new
    return [np.concatenate(pair) for pair in zip(old, new, strict=True)]


def _buffered(
    batches: Iterator[pa.RecordBatch], at_least: Callable[[], int] = lambda: 0
) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= max(_BUFFER_ROWS, at_least()):
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _total_order(column: pa.ChunkedArray) -> np.ndarray:
    """int64 values that sort exactly like the column does in Spark."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0)
    kind = array.type
    if pa.types.is_floating(kind):
        values = array.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        values[np.isnan(values)] = np.nan
        bits = values.view(np.int64)
        return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    if pa.types.is_decimal(kind):
        words = np.frombuffer(array.buffers()[1], dtype=np.int64)
        return words[2 * array.offset :: 2][: len(array)].copy()
    if pa.types.is_date32(kind):
        array = array.cast(pa.int32())
    elif pa.types.is_timestamp(kind):
        array = array.cast(pa.int64())
    elif pa.types.is_boolean(kind):
        array = array.cast(pa.int8())
    return array.to_numpy(zero_copy_only=False).astype(np.int64)


def _as_floats(column: pa.ChunkedArray) -> np.ndarray:
    kind = column.type
    if pa.types.is_floating(kind):
        values = column.to_numpy().astype(np.float64)
        return np.where(np.isnan(values), np.inf, values)
    return _total_order(column).astype(np.float64)


def _linear_scale(column: pa.ChunkedArray) -> tuple[float, float]:
    values = _as_floats(column)
    values = values[np.isfinite(values)]
    if values.size == 0:
        return 0.0, 1.0
    lo, hi = float(values.min()), float(values.max())
    width = hi - lo
    return lo, width if 0 < width < np.inf else 1.0


def _dominators_first(columns, order, codes, scale) -> np.ndarray:
    """Row order by group, then scaled sum, then the dimensions themselves.

    Clipping and rounding are monotone, so a dominator never has the larger sum,
    and the dimensions settle equal sums.
    """
    total = np.zeros(len(order[0]))
    for column, (lo, width) in zip(columns, scale, strict=True):
        total += np.clip((_as_floats(column) - lo) / width, -1.0, 2.0)
    sort_keys = [*reversed(order), total]
    if codes is not None:
        sort_keys.append(codes)
    return np.lexsort(sort_keys)


def _pairwise(p: Sequence[np.ndarray], q: Sequence[np.ndarray]) -> np.ndarray:
    """Matrix of "column tuple q is nowhere worse than row tuple p"."""
    matrix = q[0][None, :] <= p[0][:, None]
    for a, b in zip(p[1:], q[1:], strict=True):
        matrix &= b[None, :] <= a[:, None]
    return matrix


def _covered(p: Sequence[np.ndarray], q: Sequence[np.ndarray]) -> np.ndarray:
    """Which rows of ``p`` are weakly dominated by some row of ``q``."""
    n = len(p[0])
    result = np.zeros(n, dtype=bool)
    for start in range(0, n, _PANEL_ROWS):
        rows = np.arange(start, min(start + _PANEL_ROWS, n))
        panel = [c[rows] for c in p]
        at, width = 0, 32
        while at < len(q[0]) and rows.size:
            hit = _pairwise(panel, [c[at : at + width] for c in q]).any(axis=1)
            if hit.any():
                result[rows[hit]] = True
                rows = rows[~hit]
                panel = [c[~hit] for c in panel]
            at, width = at + width, min(2 * width, _BLOCK_ROWS)
    return result


def _sweep(order: Sequence[np.ndarray]) -> np.ndarray:
    """Positions of the non-dominated rows, one per distinct tuple."""
    alive = np.arange(len(order[0]))
    kept, width = [], 32
    while alive.size:
        head, alive = alive[:width], alive[width:]
        tuples = [o[head] for o in order]
        good = head[~np.tril(_pairwise(tuples, tuples), -1).any(axis=1)]
        kept.append(good)
        if alive.size:
            rest = [o[alive] for o in order]
            alive = alive[~_covered(rest, [o[good] for o in order])]
        width = min(2 * width, _BLOCK_ROWS)
    return np.concatenate(kept) if kept else np.empty(0, dtype=np.int64)


def _sweep_groups(order: Sequence[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Like ``_sweep`` within each group of rows that are sorted by group.

    Neighbouring small groups share one comparison in which other groups'
    rows do not count; a large group is swept by itself.
    """
    n = len(codes)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    ends = np.r_[starts[1:], n]
    kept = []
    i = 0
    while i < len(starts):
        begin = starts[i]
        if ends[i] - begin > _BLOCK_ROWS:
            end = ends[i]
            kept.append(begin + _sweep([o[begin:end] for o in order]))
            i += 1
            continue
        j = int(np.searchsorted(ends, begin + _BLOCK_ROWS, side="right"))
        end = ends[j - 1]
        tuples = [o[begin:end] for o in order]
        same = codes[begin:end][None, :] == codes[begin:end][:, None]
        hit = np.tril(_pairwise(tuples, tuples) & same, -1).any(axis=1)
        kept.append(begin + np.flatnonzero(~hit))
        i = j
    return np.concatenate(kept) if kept else np.empty(0, dtype=np.int64)


def _group_codes(columns: Sequence[pa.ChunkedArray]) -> np.ndarray:
    """Small integers that are equal where all key values are; null equals null, -0.0 equals 0.0.

    No key value becomes a Python object, so the number of groups costs nothing but the sort of the codes.
    """
    codes = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        if pa.types.is_floating(column.type):
            column = pc.add(column, pa.scalar(0.0, column.type))
        coded = column.combine_chunks()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        coded = coded.dictionary_encode(null_encoding="encode")
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = codes * max(1, len(coded.dictionary)) + index
        if len(columns) > 1:
            # keep the running code small, so that it cannot overflow
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    return codes
