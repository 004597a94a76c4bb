"""Points and lines on the grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.model import CELL_KEY, Layout
from ridgeline.operators import kernels
from ridgeline.operators.neighbours import per_block

# Ring codes and their buffers in map units, outermost first.
SYMBOL_RINGS = ((100, 13.0), (110, 8.0), (120, 2.0))
CENTER_CLASS = 3
LINE_CODE = 20
#: About so many rows does one task make of its points; an aggregate that follows holds no more cells at once.
ROWS_OF_TASK = 1 << 20


def cells_around(points: DataFrame, layout: Layout, radius: float) -> DataFrame:
    """One row per point and cell within ``radius`` map units of the point's cell centre.

    The offsets are a constant of the radius, so a point yields a bounded number of rows. ``d2`` is
    the squared distance in cells. Cells outside the layout are dropped. Points are counted and dealt to
    tasks by their place first.
    """
    if layout.cell_w != layout.cell_h:
        raise ValueError("distances in cells need square cells")
    widths = kernels.disc_widths(radius / layout.cell_w)
    rows = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(w).alias("w")) for dr, w in widths.items()])
    near = _dealt(points, sum(2 * w + 1 for w in widths.values()))
    out = near.withColumn("o_", F.explode(rows)).withColumn("dc_", F.explode(F.expr("sequence(-o_.w, o_.w)")))
    out = out.withColumns(
        {
            "row": F.col("row") + F.col("o_.dr"),
            "col": F.col("col") + F.col("dc_"),
            "d2": F.col("o_.dr") * F.col("o_.dr") + F.col("dc_") * F.col("dc_"),
        }
    ).drop("o_", "dc_")
    return out.where(layout.contains(F.col("row"), F.col("col")))


def _dealt(points: DataFrame, each: int) -> DataFrame:
    """Points that give ``each`` rows, in as many tasks as ROWS_OF_TASK asks for: a few bytes of a file hold very many.

    Neighbours share a task, so their cells meet there; points of one cell may be split by their other columns.
    """
    tasks = -(-points.count() * each // ROWS_OF_TASK)
    if tasks <= 1:
        return points
    others = [c for c, kind in points.dtypes if c not in ("row", "col") and "map<" not in kind and "variant" not in kind]
    return points.repartitionByRange(tasks, "row", "col", F.xxhash64("row", "col", *others))


def symbol_rings(
    cells: DataFrame, layout: Layout, rings: Sequence[tuple[int, float]] = SYMBOL_RINGS, marked: int = CENTER_CLASS
) -> DataFrame:
    """Codes around the cells of class ``marked``; inner rings override outer ones.

    A third of a layer may be marked, so nothing is emitted per marked cell: each block asks, for
    every cell, whether a disc sum of marks is positive. One halo exchange for all rings, and rings
    cross tile borders.
    """
    radii, halo = ring_radii(layout, rings)
    kernel = lambda arrays, inside, origin: {"value": kernels.rings(arrays["value"], marked, radii, halo)}
    return per_block(cells, layout, halo, kernel, ("value",), keep="filled")


def ring_radii(layout: Layout, rings: Sequence[tuple[int, float]]):
    """Rings as codes and radii in cells, outermost first, and the halo they need."""
    if layout.cell_w != layout.cell_h:
        raise ValueError("distances in cells need square cells")
    radii = [(code, buffer / layout.cell_w) for code, buffer in sorted(rings, key=lambda r: -r[1])]
    return radii, int(math.floor(radii[0][1]))


def burn_points(cells: DataFrame, points: DataFrame, layout: Layout, radius: float, code: int) -> DataFrame:
    """``code`` on the layer's cells within ``radius`` of a point, 0 on the others."""
    touched = cells_around(points, layout, radius).select(*CELL_KEY).distinct()
    # The optimizer does not see how far an explode multiplies rows: never broadcast that side.
    burnt = touched.withColumn("code", F.lit(code)).hint("merge")
    return cells.select(*CELL_KEY).join(burnt, CELL_KEY, "left").select(
        *CELL_KEY, F.coalesce("code", F.lit(0)).alias("value")
    )


def segments(vertices: DataFrame) -> DataFrame:
    """Pairs of successive vertices. ``seq`` counts 0, 1, 2, ... along each line.

    A join on ``(line_id, seq)``, not a window per line, so a very long line is no hot group.
    """
    ends = vertices.select("line_id", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return vertices.join(ends, ["line_id", "seq"])


def burn_lines(vertices: DataFrame, layout: Layout, code: int = LINE_CODE, layer: str = "lines") -> DataFrame:
    """Cells touched by lines, walked one cell at a time along the longer axis.

    A segment is clipped to the layout first, so one that lies far outside gives no row; what is left of it is cut into
    runs of a block's length, so no array is longer than that.
    """
    t = layout.tile_size
    seg = segments(vertices).select(
        layout.row_of(F.col("y")).alias("r0"),
        layout.col_of(F.col("x")).alias("c0"),
        layout.row_of(F.col("y1")).alias("r1"),
        layout.col_of(F.col("x1")).alias("c1"),
    )
    steps = seg.withColumns({"dr": F.col("r1") - F.col("r0"), "dc": F.col("c1") - F.col("c0")})
    steps = steps.withColumn("n", F.greatest(F.abs("dr"), F.abs("dc"), F.lit(1).cast("long")))
    rows, cols = _inside("r0", "dr", layout.rows), _inside("c0", "dc", layout.cols)
    last = F.greatest(F.abs("dr"), F.abs("dc"))
    steps = steps.withColumns({"k0": F.greatest(F.lit(0).cast("long"), rows[0], cols[0]), "k1": F.least(last, rows[1], cols[1])})
    runs = steps.where("k0 <= k1").withColumn("run", F.explode(F.expr(f"sequence(k0 div {t}, k1 div {t})")))
    walk = runs.withColumn("k", F.explode(F.expr(f"sequence(greatest(k0, run * {t}), least(k1, run * {t} + {t - 1}))")))
    touched = walk.select(F.lit(layer).alias("layer"), _at("r0", "dr").alias("row"), _at("c0", "dc").alias("col"))
    return (
        touched.where(layout.contains(F.col("row"), F.col("col"))).distinct().withColumn("value", F.lit(code))
    )


def _inside(start: str, by: str, size: int):
    """First and last step at which a walk from ``start`` may be inside 0 .. size - 1: never too narrow, wider by a step or two."""
    a, d, n = (F.col(c).cast("double") for c in (start, by, "n"))
    enter, leave = (F.lit(-1.5) - a) * n, (F.lit(size + 0.5) - a) * n
    outside = (a < 0) | (a > size - 1)
    first = F.when(d > 0, F.floor(enter / d)).when(d < 0, F.floor(leave / d)).when(outside, F.col("n") + 1).otherwise(F.lit(0))
    last = F.when(d > 0, F.ceil(leave / d)).when(d < 0, F.ceil(enter / d)).when(outside, F.lit(-1)).otherwise(F.col("n"))
    return first.cast("long"), last.cast("long")


def _at(start: str, by: str):
    """The cell at step ``k``: ``start + floor((2 k by + n) / (2 n))``, exact also where products pass 53 or 64 bits."""
    x, y = f"(2 * cast(k as decimal(18,0)) * cast({by} as decimal(18,0)) + n)", "(2 * cast(n as decimal(18,0)))"
    wide = f"cast({x} div {y} as bigint) - if({x} % {y} < 0, 1L, 0L)"
    return F.expr(f"{start} + if(n < {2**25}L, cast(floor((2 * k * {by} + n) / (2.0D * n)) as bigint), {wide})")
