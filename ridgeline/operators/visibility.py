"""Viewsheds of many observers at once, within a radius, over stored blocks.

Observers of one block form groups, so a block of elevations travels once for a group and not once for each observer.
No task ever holds the surroundings of an observer whole: what it holds does not grow with the radius.

* Lines of sight: a task has one group and one block of targets. The blocks that lie between them stream through it one
  by one and hide the targets behind what stands in them.
* Rings: the horizon moves outward as a wave over the blocks around a group, nearest first. A block takes the lines of
  the horizon that its neighbours towards the observers hand on, fills in its own cells and hands on its own border.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.model import Layout
from ridgeline.operators.blocks import BLOCK_KEY, to_blocks
from ridgeline.session import cut_lineage, joinable, tasks_for

VIEW_SCHEMA = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("observer_id", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("col", T.LongType()),
        T.StructField("visible", T.IntegerType()),
    ]
)
#: Pairs of an observer and a target in a task.
PAIRS = 1 << 20
#: Groups of observers, with their lists, that are sent to the blocks by broadcast; more of them meet in a shuffle.
SENT_ROWS = 5_000
GROUP_KEY = ["layer", "orow", "ocol", "grp"]
#: Rounding up sample positions of exactly a half; other positions are much further from one.
HALF = 0.5 + 1e-9


def _groups(observers: DataFrame, stored: DataFrame, layout: Layout) -> DataFrame:
    """``layer, orow, ocol, grp`` (block and number of the group), and ``ids, rows, cols, eyes`` of its observers.

    Observers outside the layout raise; those on a cell without a known elevation see nothing and are left out.
    """
    t = layout.tile_size
    placed = layout.checked(observers.select("layer", "observer_id", "row", "col")).distinct()
    placed = placed.withColumns({"brow": F.expr(f"row div {t}"), "bcol": F.expr(f"col div {t}")})
    sizes = placed.groupBy(*BLOCK_KEY).agg(F.ceil(F.count("*") / max(1, PAIRS // (t * t))).alias("groups"))
    dealt = placed.join(sizes, BLOCK_KEY).withColumn("grp", F.pmod(F.xxhash64("observer_id", "row", "col"), F.col("groups")))
    named = cut_lineage(dealt.groupBy(*BLOCK_KEY, "grp").agg(F.collect_list(F.struct("observer_id", "row", "col")).alias("o")))
    met = joinable(named, named.count(), SENT_ROWS).join(stored.select(*BLOCK_KEY, "cells"), BLOCK_KEY)
    eye = lambda o: F.get("cells", ((o["row"] % t) * t + o["col"] % t).cast("int"))
    seen = met.withColumn("o", F.filter(F.transform("o", lambda o: F.struct(o["observer_id"].alias("id"), o["row"].alias("row"), o["col"].alias("col"), eye(o).alias("eye"))), lambda o: o["eye"].isNotNull()))
    return cut_lineage(
        seen.where(F.size("o") > 0).select(
            "layer", F.col("brow").alias("orow"), F.col("bcol").alias("ocol"), "grp",
            F.col("o.id").alias("ids"), F.col("o.row").alias("rows"), F.col("o.col").alias("cols"), F.col("o.eye").alias("eyes"),
        )
    )


def _around(groups: DataFrame, layout: Layout, radius: int) -> DataFrame:
    """A row for each block, ``brow, bcol``, in which a cell may lie within the radius of an observer of the group."""
    t = layout.tile_size

    def reach(axis: str, size: int):
        low, high = f"greatest(0L, array_min({axis}) - {radius}L)", f"least({size - 1}L, array_max({axis}) + {radius}L)"
        return F.explode(F.expr(f"sequence({low} div {t}L, {high} div {t}L)"))

    def gap(axis: str, block: str):
        return F.greatest(F.lit(0).cast("long"), F.expr(f"{block} * {t} - array_max({axis})"), F.expr(f"array_min({axis}) - {block} * {t} - {t - 1}"))

    rows = groups.withColumn("brow", reach("rows", layout.rows)).withColumn("bcol", reach("cols", layout.cols))
    dr, dc = gap("rows", "brow").cast("double"), gap("cols", "bcol").cast("double")
    return rows.where(dr * dr + dc * dc <= float(radius) ** 2)


def _views(layer: str, ids: np.ndarray, rows: np.ndarray, cols: np.ndarray, visible: np.ndarray) -> pa.RecordBatch:
    columns = [pa.repeat(pa.scalar(layer, pa.string()), len(ids)), pa.array(ids), pa.array(rows), pa.array(cols), pa.array(visible.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=VIEW_SCHEMA.names)


def _floats(scalar: pa.Scalar) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False).astype(np.float64)


# Lines of sight


def corridor(own: tuple[int, int, int, int], target: tuple[int, int], t: int) -> Iterator[tuple[int, int]]:
    """The blocks that a line from a cell of the box ``own`` (rows and columns from, to) to one of the target block may cross."""
    far = (target[0] * t, target[0] * t + t - 1, target[1] * t, target[1] * t + t - 1)
    ends = [[(float(r), float(c)) for r in box[:2] for c in box[2:]] for box in (own, far)]
    for block_row in range(min(own[0], far[0]) // t, max(own[1], far[1]) // t + 1):
        low, high = block_row * t - 1.0, block_row * t + float(t)  # the rows of these blocks, and what may be rounded into them
        seen = [c for box in (own, far) if box[1] >= low and box[0] <= high for c in box[2:]]
        for r0, c0 in ends[0]:
            for r1, c1 in ends[1]:
                if max(r0, r1) >= low and min(r0, r1) <= high:
                    for edge in (low, high):
                        share = 0.0 if r0 == r1 else min(1.0, max(0.0, (edge - r0) / (r1 - r0)))
                        seen.append(c0 + share * (c1 - c0))
        if seen:
            for block_col in range(int(math.floor(min(seen) - 1)) // t, int(math.ceil(max(seen) + 1)) // t + 1):
                yield block_row, block_col


class _Targets:
    """The targets in one block of the observers of a group, and which of them are still in sight."""

    def __init__(self, row: dict, layout: Layout, radius: int, observer_height: float, target_height: float):
        t = layout.tile_size
        self.layer, self.ids = row["layer"], np.asarray(row["ids"], np.int64)
        grid = row["cells"]
        known = np.flatnonzero(~np.isnan(grid))
        tr, tc = row["brow"] * t + known // t, row["bcol"] * t + known % t
        orow, ocol = np.asarray(row["rows"], np.int64), np.asarray(row["cols"], np.int64)
        # square distances are exact in doubles up to far beyond any radius in cells
        near = (tr[None, :] - orow[:, None]).astype(float) ** 2 + (tc[None, :] - ocol[:, None]).astype(float) ** 2 <= float(radius) ** 2
        who, which = np.nonzero(near)
        steps = np.maximum(np.abs(tr[which] - orow[who]), np.abs(tc[which] - ocol[who]))
        order = np.argsort(-steps, kind="stable")  # the targets that have a k-th sample are the first ones
        self.who, which, self.steps = who[order], which[order], steps[order]
        self.row, self.col = tr[which], tc[which]
        self.orow, self.ocol = orow[self.who], ocol[self.who]
        divisor = np.maximum(self.steps, 1)
        self.dr, self.dc = (self.row - self.orow) / divisor, (self.col - self.ocol) / divisor
        self.eye = np.asarray(row["eyes"], float)[self.who] + observer_height
        self.rise = grid[known][which] + target_height - self.eye
        self.hidden = np.zeros(len(which), bool)

    def cross(self, block_row: int, block_col: int, grid: np.ndarray, t: int) -> None:
        """Hide the targets whose sight lines meet something higher in this block."""
        if not len(self.steps):
            return
        r0, c0 = block_row * t, block_col * t
        nearest = np.maximum(_gap(self.orow, r0, t), _gap(self.ocol, c0, t))
        furthest = np.maximum(np.maximum(np.abs(self.orow - r0), np.abs(r0 + t - 1 - self.orow)), np.maximum(np.abs(self.ocol - c0), np.abs(c0 + t - 1 - self.ocol)))
        first, last = max(1, int(nearest.min())), min(int(self.steps[0]) - 1, int(furthest.max()))
        longest = -self.steps
        for k in range(first, last + 1):
            n = int(np.searchsorted(longest, -k, "left"))  # those with more than k steps
            r = self.orow[:n] - r0 + np.floor(k * self.dr[:n] + HALF).astype(np.int64)
            c = self.ocol[:n] - c0 + np.floor(k * self.dc[:n] + HALF).astype(np.int64)
            met = np.flatnonzero((r >= 0) & (r < t) & (c >= 0) & (c < t))
            with np.errstate(invalid="ignore"):
                above = (grid[r[met] * t + c[met]] - self.eye[met]) * self.steps[met] > self.rise[met] * k
            self.hidden[met[above]] = True

    def views(self) -> pa.RecordBatch:
        return _views(self.layer, self.ids[self.who], self.row, self.col, ~self.hidden)


def _gap(position: np.ndarray, first: int, t: int) -> np.ndarray:
    """Cells from a position to a block's rows or columns, 0 inside."""
    return np.maximum(0, np.maximum(first - position, position - first - t + 1))


def viewshed_of_blocks(observers: DataFrame, stored: DataFrame, layout: Layout, radius: int, observer_height: float = 0.0, target_height: float = 0.0) -> DataFrame:
    """Straight-line visibility of every known cell within ``radius`` cells of each observer.

    A cell is hidden if an elevation along the line stands above it. NODATA does not hide.
    """
    if radius < 1:
        raise ValueError("the radius must be at least one cell")
    t, spark = layout.tile_size, stored.sparkSession
    near = _around(_groups(observers, stored, layout), layout, radius)
    kinds = {T.StringType: pa.string(), T.LongType: pa.int64()}
    crossed = T.StructType(near.schema.fields + [T.StructField(n, T.LongType()) for n in ("crow", "ccol")])

    def cross(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {n: one.column(n)[0].as_py() for n in ("rows", "cols", "brow", "bcol")}
                own = (min(row["rows"]), max(row["rows"]), min(row["cols"]), max(row["cols"]))
                places = sorted({(row["brow"], row["bcol"]), *corridor(own, (row["brow"], row["bcol"]), t)})
                many = one.take(pa.array(np.zeros(len(places), np.int64)))
                extra = [pa.array([p[k] for p in places], kinds[T.LongType]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*many.columns, *extra], names=crossed.names)

    pairs = cut_lineage(near.mapInArrow(cross, crossed))
    n = pairs.count()
    stored = stored.select("layer", F.col("brow").alias("crow"), F.col("bcol").alias("ccol"), "cells")
    met = joinable(pairs, n, SENT_ROWS).join(stored, ["layer", "crow", "ccol"])
    key = [*GROUP_KEY, "brow", "bcol"]
    own = (F.col("crow") == F.col("brow")) & (F.col("ccol") == F.col("bcol"))
    streams = met.withColumn("between", ~own).repartition(tasks_for(spark, n), *key).sortWithinPartitions(*key, "between", "crow", "ccol")

    def look(batches):
        now, targets = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in (*key, "between", "crow", "ccol")}
                row["cells"] = _floats(batch.column("cells")[i])
                here = tuple(row[n] for n in key)
                if here != now:
                    if targets is not None:
                        yield targets.views()
                    now, targets = here, None
                    if not row["between"]:  # else the block holds no known target
                        lists = {n: batch.column(n)[i].as_py() for n in ("ids", "rows", "cols", "eyes")}
                        targets = _Targets(row | lists, layout, radius, observer_height, target_height)
                if targets is not None:
                    targets.cross(row["crow"], row["ccol"], row["cells"], t)
        if targets is not None:
            yield targets.views()

    return streams.mapInArrow(look, VIEW_SCHEMA)


def viewshed(observers: DataFrame, elevation: DataFrame, layout: Layout, radius: int, observer_height: float = 0.0, target_height: float = 0.0) -> DataFrame:
    """``viewshed_of_blocks`` of a cell table."""
    return viewshed_of_blocks(observers, cut_lineage(to_blocks(elevation, layout)), layout, radius, observer_height, target_height)


# Rings


def _runs(who: np.ndarray, line: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each run from ``first`` to ``last`` spelled out: observer, line and position of every cell."""
    count = np.maximum(0, last - first + 1)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(who, count), np.repeat(line, count), np.repeat(first, count) + at


def ring_cells(a: np.ndarray, b: np.ndarray, ring: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observer, row and column of the cells of a block on the square ring around each observer at ``a, b``."""
    every = np.arange(len(a))
    found = []
    for row in (a - ring, a + ring)[: 1 if ring == 0 else 2]:
        on = every[(row >= 0) & (row < t)]
        who, line, place = _runs(on, row[on], np.maximum(0, b[on] - ring), np.minimum(t - 1, b[on] + ring))
        found.append((who, line, place))
    for col in (b - ring, b + ring)[: 0 if ring == 0 else 2]:
        on = every[(col >= 0) & (col < t)]
        who, line, place = _runs(on, col[on], np.maximum(0, a[on] - ring + 1), np.minimum(t - 1, a[on] + ring - 1))
        found.append((who, place, line))
    return tuple(np.concatenate(x) for x in zip(*found))


def ring_block(grid: np.ndarray, a: np.ndarray, b: np.ndarray, eye: np.ndarray, base: np.ndarray, radius: int):
    """Fill in the horizon of one block: ``base`` has it one cell around the block already, for each observer.

    Returns it filled in, and observer, row, column and visibility of the known cells within the radius.
    """
    t = grid.shape[0]
    horizon, seen = base, []
    near = np.maximum(_gap(a, 0, t), _gap(b, 0, t)).min()
    far = np.maximum(np.maximum(np.abs(a), np.abs(t - 1 - a)), np.maximum(np.abs(b), np.abs(t - 1 - b))).max()
    for ring in range(int(near), min(radius, int(far)) + 1):
        who, r, c = ring_cells(a, b, ring, t)
        dr, dc = r - a[who], c - b[who]
        inside = dr * dr + dc * dc <= radius * radius
        who, r, c, dr, dc = who[inside], r[inside], c[inside], dr[inside], dc[inside]
        z = grid[r, c]
        if ring <= 1:
            level = z
        else:
            upright = np.abs(dr) == ring
            along = np.where(upright, dc, dr) * (ring - 1)
            low = np.floor_divide(along, ring)
            exact = low * ring == along
            high = np.where(exact, low, low + 1)
            share = np.where(exact, 0.0, along / ring - low)
            inward = np.where(upright, np.sign(dr), np.sign(dc)) * (ring - 1)
            at = lambda v: horizon[who, np.where(upright, inward, v) + a[who] + 1, np.where(upright, v, inward) + b[who] + 1]  # noqa: B023, E731
            before = (1.0 - share) * at(low) + share * at(high)
            reach = before + (before - eye[who]) / (ring - 1)
            level = np.where(np.isnan(reach) | np.isnan(z), np.nan, np.fmax(z, reach))
        horizon[who, r + 1, c + 1] = level
        known = ~np.isnan(z)
        seen.append((who[known], r[known], c[known], (z == level)[known]))
    empty = np.zeros(0, np.int64)
    return horizon, tuple(np.concatenate(x) for x in zip(*seen)) if seen else (empty, empty, empty, empty.astype(bool))


#: Where a neighbour's border lies in the padded square, and which of a block's own lines a neighbour there is given.
def _edge(d: int, t: int) -> slice:
    return {-1: slice(0, 1), 0: slice(1, t + 1), 1: slice(t + 1, t + 2)}[d]


def _own_edge(d: int, t: int) -> slice:
    return {-1: slice(1, 2), 0: slice(1, t + 1), 1: slice(t, t + 1)}[d]


#: ``seen`` packs observer, place in the block and visibility of each view; ``line`` is a border for the neighbour at si, sj.
_arrays = {"ids": T.LongType(), "seen": T.LongType(), "line": T.DoubleType()}
WAVE = T.StructType(
    [T.StructField("layer", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in (*GROUP_KEY[1:], "brow", "bcol", "si", "sj")]
    + [T.StructField(n, T.ArrayType(k)) for n, k in _arrays.items()]
)


def ring_viewshed_of_blocks(observers: DataFrame, stored: DataFrame, layout: Layout, radius: int, observer_height: float = 0.0) -> DataFrame:
    """Approximate viewshed: a horizon carried outward ring by ring.

    The horizon above a cell is interpolated from the ring before it and extended along the line of
    sight; a cell is visible when it reaches its horizon. NODATA carries outward.
    """
    if radius < 1:
        raise ValueError("the radius must be at least one cell")
    t = layout.tile_size
    plan = _around(_groups(observers, stored, layout), layout, radius)
    plan = cut_lineage(plan.withColumn("wave", F.abs(F.col("brow") - F.col("orow")) + F.abs(F.col("bcol") - F.col("ocol"))))
    sizes = {r["wave"]: r["count"] for r in plan.groupBy("wave").count().collect()}  # as many as blocks along the radius
    key = [*GROUP_KEY, "brow", "bcol"]
    given = T.ArrayType(T.StructType([T.StructField("si", T.LongType()), T.StructField("sj", T.LongType()), T.StructField("line", T.ArrayType(T.DoubleType()))]))

    def fill(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in (*key, "ids", "rows", "cols", "eyes")}
                ids, rows, cols = (np.asarray(row[n], np.int64) for n in ("ids", "rows", "cols"))
                a, b = rows - row["brow"] * t, cols - row["bcol"] * t
                base = np.full((len(ids), t + 2, t + 2), np.nan)
                for part in batch.column("given")[i].values or ():
                    place = base[:, _edge(part["si"].as_py(), t), _edge(part["sj"].as_py(), t)]
                    place[...] = _floats(part["line"]).reshape(place.shape)
                grid = _floats(batch.column("cells")[i]).reshape(t, t)
                horizon, (who, r, c, visible) = ring_block(grid, a, b, np.asarray(row["eyes"], float) + observer_height, base, radius)
                none = {"ids": np.zeros(0, np.int64), "seen": np.zeros(0, np.int64), "line": np.zeros(0)}
                outs = [(row["brow"], row["bcol"], None, None, none | {"ids": ids, "seen": (who * t * t + r * t + c) * 2 + visible})]
                # outward: away from the observers' block, or along it
                away = lambda here, there: (-1, 0, 1) if here == there else (0, 1) if here > there else (0, -1)
                for di in away(row["brow"], row["orow"]):
                    for dj in away(row["bcol"], row["ocol"]):
                        line = horizon[:, _own_edge(di, t), _own_edge(dj, t)]
                        if (di or dj) and not np.isnan(line).all():
                            outs.append((row["brow"] + di, row["bcol"] + dj, -di, -dj, none | {"line": line.ravel()}))
                for brow, bcol, si, sj, lists in outs:
                    plain = [batch.column(n).slice(i, 1) for n in GROUP_KEY] + [pa.array([v], pa.int64()) for v in (brow, bcol, si, sj)]
                    packed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(lists[n]) for n in _arrays)]
                    yield pa.RecordBatch.from_arrays(plain + packed, names=WAVE.names)

    views, handed = [], []
    for wave in range(max(sizes, default=-1) + 1):
        todo = plan.where(F.col("wave") == wave)
        n = sizes.get(wave, 0)
        todo = joinable(todo, n, SENT_ROWS).join(stored.select(*BLOCK_KEY, "cells"), BLOCK_KEY)
        todo = todo.repartition(tasks_for(stored.sparkSession, n), *key)
        if handed:  # a block hears from the wave before, and by its corner from the one before that
            lines = handed[-1] if len(handed) == 1 else handed[-1].unionByName(handed[-2])
            told = lines.groupBy(*key).agg(F.collect_list(F.struct("si", "sj", "line")).alias("given"))
            todo = todo.join(told, key, "left")
        else:
            todo = todo.withColumn("given", F.lit(None).cast(given))
        done = cut_lineage(todo.mapInArrow(fill, WAVE))
        handed.append(done.where("si IS NOT NULL"))
        views.append(done.where("si IS NULL").select(*BLOCK_KEY, "ids", "seen"))
    if not views:
        return observers.sparkSession.createDataFrame([], VIEW_SCHEMA)
    out = views[0]
    for more in views[1:]:
        out = out.unionByName(more)

    def spell(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                layer, brow, bcol = (batch.column(n)[i].as_py() for n in BLOCK_KEY)
                ids, seen = (batch.column(n)[i].values.to_numpy() for n in ("ids", "seen"))
                who, at = np.divmod(seen >> 1, t * t)
                yield _views(layer, ids[who], brow * t + at // t, bcol * t + at % t, seen & 1)

    return out.mapInArrow(spell, VIEW_SCHEMA)


def ring_viewshed(observers: DataFrame, elevation: DataFrame, layout: Layout, radius: int, observer_height: float = 0.0) -> DataFrame:
    """``ring_viewshed_of_blocks`` of a cell table."""
    return ring_viewshed_of_blocks(observers, cut_lineage(to_blocks(elevation, layout)), layout, radius, observer_height)


def cumulative(views: DataFrame) -> DataFrame:
    """Cells that any observer sees."""
    return views.groupBy("layer", "row", "col").agg(F.max("visible").alias("visible"))


def center_observer(spark, layout: Layout, layer: str) -> DataFrame:
    """The single observer in the middle of a layer."""
    return spark.createDataFrame(
        [(layer, 0, layout.rows // 2, layout.cols // 2)], "layer string, observer_id long, row long, col long"
    )
