"""The merge beyond the broadcast bound: super-boxes in an order that lists dominators first.

Candidates are sorted by a Z-order of per-dimension quantile buckets, then by the dimensions. Whatever
dominates a tuple has no larger bucket anywhere, so it comes earlier in this order: a box needs to meet earlier
boxes only, and one test direction is enough.

1. Range partitions of that order are thinned out by a sorted local pass, and what is left of them are
   *super-boxes* of bounded size.
2. Each row is shipped once to every later super-box whose upper corner it reaches. The key is the super-box, an
   equality; there is no join of boxes, and no row is copied per pair of blocks.
3. A task holds the rows of its super-box and reads the shipped ones as a stream, earliest first. Both sides
   are cut into blocks; blocks meet only if the lower corner of one reaches the upper corner
   of the other.

With keys, the order starts with them, and rows are shipped only to super-boxes in which their own group goes on.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareto_frame.functions.dominance import every
from pareto_frame.functions.geometry import as_number, has_number
from pareto_frame.operators.local import (
    _buffered,
    _pairwise,
    _total_order,
    local_skyline,
)
from pareto_frame.operators.partitioning import piece
from pareto_frame.session import Phase, default_partitions, materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What the rows of one super-box may take in a task, and the fewest rows worth a task.
SUPER_BYTES = 16 << 20
LEAST_ROWS = 4_000
#: Super-boxes for each shuffle partition, so that late ones, which meet more rows, balance out.
WAVES = 3
PANEL, LEAF, FAN = 512, 128, 32
#: What one share of the points of a filter may take, in the driver and in every task.
SHARE_BYTES = 32 << 20
BOX, ORDER, OPEN, GROUP = "__sky_box", "__sky_z", "__sky_open", "__sky_group"
SLOT, SIDE = "__sky_slot", "__sky_side"


def z_order(rows: DataFrame, dims: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Adds ORDER, a number that is never larger for a dominator: interleaved bits of quantile buckets.

    It says how near tuples are to each other; the order of equal numbers is settled by the dimensions. Types
    without a number all get 0. The quantiles are those of ``rows``.
    """
    types = {f.name: f.dataType for f in rows.schema.fields}
    used = list(dims)[:60]
    if not all(has_number(types[c]) for c in used):
        return lambda df: df.withColumn(ORDER, F.lit(0).cast("long"))
    bits = max(1, min(4, ceil(18 / len(used))))
    names = [f"__sky_n{i}" for i in range(len(used))]
    numbers = {n: as_number(F.col(c), types[c]) for c, n in zip(used, names, strict=True)}
    shares = [i / 2**bits for i in range(1, 2**bits)]
    # one mergeable sketch per dimension
    sketches = [F.percentile_approx(n, shares, 200).alias(n) for n in names]
    found = rows.select(*[x.alias(n) for n, x in numbers.items()]).agg(*sketches).first()
    terms = []
    for i, name in enumerate(names):
        steps = " + ".join(f"int({name} > double('{v!r}'))" for v in sorted(set(found[name] or []))) or "0"
        terms += [
            f"shiftleft(shiftright({steps}, {level}) & 1L, {level * len(used) + len(used) - 1 - i})"
            for level in range(bits)
        ]
    # as text: a tree of so many Columns takes longer to build than the query
    number = F.expr(" + ".join(terms))
    return lambda df: df.withColumns(numbers).withColumn(ORDER, number).drop(*names)


def super_boxes(
    candidates: Phase, dims: Sequence[str], keys: Sequence[str] = (), box_rows: int | None = None
) -> Phase:
    """What a sorted pass over each range leaves: keys, dims, number of the super-box, place in the order.

    A range is one super-box, or, with more of them than tasks, is cut into some of ``box_rows`` rows after the pass.
    """
    tasks = WAVES * default_partitions(candidates.rows)
    held = SUPER_BYTES // (8 * len(dims))
    fair = max(LEAST_ROWS, ceil(candidates.count / tasks))
    n = max(1, ceil(candidates.count / (box_rows or min(held, fair))))
    # small super-boxes share a pass: what it drops need not be shipped to any of them
    passes = min(n, max(tasks, ceil(candidates.count / held)))
    with_order = z_order(candidates.rows, dims)
    placed = with_order(candidates.rows.select(*keys, *dims))
    order = [*keys, ORDER, *dims]
    laid = placed.repartitionByRange(passes, *order).sortWithinPartitions(*order)
    kept = local_skyline(laid, dims, keys, presorted=not keys, by_key=bool(keys))
    box = F.spark_partition_id().cast("long")
    if passes < n:
        # the pass by key gives each group in another order
        kept, box = with_order(kept).sortWithinPartitions(*order), piece(box_rows)
    return materialise(with_order(kept.withColumn(BOX, box)), phase="super-boxes")


def box_merge(
    candidates: Phase,
    dims: Sequence[str],
    keys: Sequence[str] = (),
    mark: Callable[[DataFrame], DataFrame] | None = None,
    after_local: Callable[[Phase], DataFrame | None] = lambda phase: None,
    box_rows: int | None = None,
) -> DataFrame:
    """Candidates (distinct tuples) that no other one of the same key dominates.

    ``mark`` may add a boolean column OPEN; rows for which it is false are known to stay and only
    serve against others. ``after_local`` may end the merge with the rows left by the local pass.
    ``box_rows``: most rows of a super-box; by default as memory and the number of tasks allow.
    """
    boxes = super_boxes(candidates, dims, keys, box_rows)
    ended = after_local(Phase(boxes.rows.select(*keys, *dims), boxes.count))
    if ended is not None:
        return ended
    rows = boxes.rows
    groups, corners = _groups(rows, dims, keys)
    if not corners:
        return rows.select(*keys, *dims)
    if keys:
        same = every([F.col(k).eqNullSafe(F.col(f"{GROUP}{i}")) for i, k in enumerate(keys)])
        # at most one group goes on from each super-box to the next
        rows = rows.join(F.broadcast(groups), same, "left")
    else:
        rows = rows.withColumn(GROUP, F.lit(0))
    rows = mark(rows) if mark else rows.withColumn(OPEN, F.lit(True))
    met = F.col(GROUP).isNotNull()
    settled = rows.filter(~(met & F.col(OPEN))).select(*keys, *dims)

    n_slots = sum(len(boxes) for boxes, _, _ in corners.values())
    shipped = rows.filter(met).select(GROUP, BOX, OPEN, ORDER, *dims)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shipped.select(*dims).schema.fields)
    layout = f"{SLOT} int, {SIDE} int, {GROUP} int, {ORDER} long, {types}"
    copies = shipped.mapInArrow(partial(_ship, corners=corners), layout)
    laid = copies.repartitionById(n_slots, F.col(SLOT)).sortWithinPartitions(SLOT, SIDE, ORDER)
    tuples = laid.mapInArrow(_not_covered, layout).select(GROUP, *dims)
    if keys:
        # the same small table gives the key values back
        names = groups.select(GROUP, *[F.col(f"{GROUP}{i}").alias(k) for i, k in enumerate(keys)])
        tuples = tuples.join(F.broadcast(names), GROUP)
    return settled.unionByName(tuples.select(*keys, *dims))


def _groups(rows: DataFrame, dims: Sequence[str], keys: Sequence[str]):
    """Groups that lie in several super-boxes, by number, and the upper corners of their parts.

    Of each group: its super-boxes in order, the upper corners (a row each), and the number of the first slot. A slot is one
    part of one group. A super-box passes on at most one group, so there are at
    most twice as many parts as super-boxes.
    """
    high = [F.max(c).alias(c) for c in dims]
    parts = rows.groupBy(*keys, BOX).agg(*high)
    if keys:
        several = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        numbered = several.select(
            F.struct(*[F.col(k).alias(f"{GROUP}{i}") for i, k in enumerate(keys)]).alias("key")
        ).agg(F.sort_array(F.collect_list("key")).alias("keys"))
        groups = materialise(
            numbered.select(F.posexplode("keys").alias(GROUP, "key")).select(GROUP, "key.*")
        ).rows
        same = every([F.col(k).eqNullSafe(F.col(f"{GROUP}{i}")) for i, k in enumerate(keys)])
        parts = parts.join(F.broadcast(groups), same)
    else:
        groups, parts = None, parts.withColumn(GROUP, F.lit(0))
    table = parts.select(GROUP, BOX, *dims).orderBy(GROUP, BOX).toArrow()
    group, box = (table.column(c).to_numpy() for c in (GROUP, BOX))
    upper = np.stack([_total_order(table.column(c)) for c in dims], axis=1) if table.num_rows else None
    corners, slot = {}, 0
    for g in np.unique(group).tolist():
        own = group == g
        if own.sum() > 1:
            corners[g] = (box[own], upper[own], slot)
            slot += int(own.sum())
    return groups, corners


def _ship(batches: Iterator[pa.RecordBatch], corners: dict) -> Iterator[pa.RecordBatch]:
    """Open rows for their own slot (side 0); every row for the later slots it may matter in (side 1)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group, box, is_open = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        payload = pa.table([batch.column(i) for i in range(3, batch.num_columns)], batch.schema.names[3:])
        order = np.stack([_total_order(c) for c in payload.columns[1:]], axis=1)
        for g in np.unique(group).tolist():
            boxes, upper, first = corners[g]
            rows = np.flatnonzero(group == g)
            place = np.searchsorted(boxes, box[rows])
            own = is_open[rows]
            yield from _parts(payload, rows[own], first + place[own], 0, g)
            for target in range(int(place.min()) + 1, len(boxes)):
                reach = (place < target) & (order[rows] <= upper[target]).all(axis=1)
                yield from _parts(payload, rows[reach], np.full(int(reach.sum()), first + target), 1, g)


def _parts(payload: pa.Table, rows: np.ndarray, slots: np.ndarray, side: int, group: int):
    if rows.size:
        taken = payload.take(pa.array(rows))
        lead = [pa.array(slots, pa.int32()), *[pa.array(np.full(rows.size, v), pa.int32()) for v in (side, group)]]
        table = pa.table([*lead, *taken.columns], [SLOT, SIDE, GROUP, *taken.schema.names])
        yield from table.combine_chunks().to_batches()


def _not_covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of side 0 that no row of side 1 of the same slot covers; of side 1 only a buffer is held."""
    slot, own, order = None, [], None
    for table in _buffered(batches):
        slots, sides = table.column(0).to_numpy(), table.column(1).to_numpy()
        turns = np.flatnonzero(np.concatenate([[True], (slots[1:] != slots[:-1]) | (sides[1:] != sides[:-1])]))
        for at, end in zip(turns, [*turns[1:], table.num_rows], strict=True):
            part = table.slice(at, end - at)
            if slots[at] != slot:
                yield from _flushed(own)
                slot, own, order = slots[at], [], None
            if sides[at] == 0:
                own.append(part)
                continue
            if not own:
                continue
            if order is None:
                own = [pa.concat_tables(own).combine_chunks()]
                order = np.stack([_total_order(c) for c in own[0].columns[4:]])
            rivals = np.stack([_total_order(c) for c in part.columns[4:]])
            stay = np.flatnonzero(~covered_in_order(order, PackedBoxes(rivals)))
            if stay.size < order.shape[1]:
                own, order = [own[0].take(pa.array(stay))], order[:, stay]
    yield from _flushed(own)


def _flushed(own: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    for table in own:
        yield from table.combine_chunks().to_batches()


class PackedBoxes:
    """Points (a column each) in an order of neighbours, under a tree of lower corners.

    Leaves have LEAF points, inner nodes FAN children; all are neighbours, so the tree is an array of
    minima per level.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.levels = [_lower(points, LEAF)] if points.shape[1] else []
        while self.levels and self.levels[-1].shape[1] > FAN:
            self.levels.append(_lower(self.levels[-1], FAN))
        # the least corner of each leaf and all later ones
        self.to_come = np.minimum.accumulate(self.levels[0][:, ::-1], axis=1)[:, ::-1] if self.levels else None

    def reaching(self, upper: np.ndarray) -> np.ndarray:
        """Leaves, in order, with a corner that ``upper`` is nowhere below.

        The running minimum of the corners still to come ends the search as soon as no later leaf can matter.
        """
        if not self.levels or not (self.levels[-1] <= upper[:, None]).all(axis=0).any():
            return np.zeros(0, dtype=np.int64)
        nodes = np.arange(self.levels[-1].shape[1])
        for depth in range(len(self.levels) - 1, -1, -1):
            corners = self.levels[depth]
            nodes = nodes[(corners[:, nodes] <= upper[:, None]).all(axis=0)]
            if depth:
                children = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = children[children < self.levels[depth - 1].shape[1]]
        last = np.count_nonzero((self.to_come <= upper[:, None]).all(axis=0))
        return nodes[nodes < last]

    def leaf(self, number: int) -> np.ndarray:
        return self.points[:, number * LEAF : (number + 1) * LEAF]


def _lower(points: np.ndarray, size: int) -> np.ndarray:
    return np.minimum.reduceat(points, np.arange(0, points.shape[1], size), axis=1)


def covered_in_order(p: np.ndarray, boxes: PackedBoxes, strict: bool = False) -> np.ndarray:
    """Which columns of ``p`` some point of ``boxes`` weakly dominates; with ``strict`` equal ones don't count.

    Neighbours in ``p`` should be near each other. Panels of them meet only the leaves that reach their upper
    corner, then only the tuples that reach the corner of the other side.
    """
    result = np.zeros(p.shape[1], dtype=bool)
    for start in range(0, p.shape[1], PANEL):
        panel = p[:, start : start + PANEL]
        rows = np.arange(start, start + panel.shape[1])
        upper = panel.max(axis=1)
        for number in boxes.reaching(upper).tolist():
            some = boxes.leaf(number)
            near = (panel >= some.min(axis=1)[:, None]).all(axis=0)
            some = some[:, (some <= upper[:, None]).all(axis=0)]
            if not near.any() or not some.shape[1]:
                continue
            pairs = _pairwise(panel[:, near], some)
            if strict:
                below, above = np.nonzero(pairs)
                pairs[below, above] = (panel[:, near][:, below] != some[:, above]).any(axis=0)
            hit = np.flatnonzero(near)[pairs.any(axis=1)]
            if hit.size:
                result[rows[hit]] = True
                rows, panel = np.delete(rows, hit), np.delete(panel, hit, axis=1)
                if not rows.size:
                    break
                upper = panel.max(axis=1)
    return result


# A filter by many points


def not_dominated_by(
    rows: DataFrame, dims: Sequence[str], rivals: Phase, strict: bool = True
) -> DataFrame:
    """Rows, with all their columns, that none of any number of ``rivals`` dominates (or, not ``strict``, equals).

    Rivals are sent to the tasks as a packed tree, in shares of at most SHARE_BYTES; the rows left by
    one share are stored before the next one is sent, so one tree is alive at a time.
    """
    shares = max(1, ceil(rivals.count * 8 * len(dims) / SHARE_BYTES))
    with_order = z_order(rivals.rows, dims)
    numbered = with_order(rivals.rows.select(*dims, F.pmod(F.xxhash64(*dims), F.lit(shares)).alias(SLOT)))
    context = rows.sparkSession.sparkContext
    schema = rows.schema
    for share in range(shares):
        table = numbered.filter(F.col(SLOT) == share).sort(ORDER).select(*dims).toArrow()
        if not table.num_rows:
            continue
        tree = context.broadcast(np.stack([_total_order(c) for c in table.columns]))
        task = partial(_outside, tree=tree, dims=list(dims), strict=strict)
        rows = with_order(rows).mapInArrow(task, schema)
        if share < shares - 1:
            rows = materialise(rows).rows
    return rows


def _outside(
    batches: Iterator[pa.RecordBatch], tree, dims: list[str], strict: bool
) -> Iterator[pa.RecordBatch]:
    boxes = PackedBoxes(tree.value)
    for table in _buffered(batches):
        near = np.argsort(table.column(ORDER).to_numpy(), kind="stable")
        table = table.drop_columns([ORDER])
        points = np.stack([_total_order(table.column(c)) for c in dims])[:, near]
        stay = np.sort(near[~covered_in_order(points, boxes, strict)])
        if stay.size:
            yield from table.take(pa.array(stay)).combine_chunks().to_batches()
