"""Contiguous areas of equal value (4 neighbours).

Blocks label their own cells first. What remains to connect is the small graph of block areas that touch across a block
border; rounds over it are checkpointed. Its roots go back as one short table for each block, which renames the areas in
its array of labels: cells are neither joined nor shuffled on their own. A region that covers a third of the layer is one
node per block in the graph, never one group of cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.model import BLOCK_SCHEMA, Layout
from ridgeline.operators import kernels
from ridgeline.operators.blocks import BLOCK_KEY, to_blocks
from ridgeline.session import cut_lineage

SALTS = 16
#: Blocks with, for each cell, the least cell id (row * cols + col) of its area or region; NULL where the value is.
LABELLED = T.StructType(BLOCK_SCHEMA.fields + [T.StructField("regions", T.ArrayType(T.LongType()))])
SIDES = ("N", "E", "S", "W")


def _per_block(blocks: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``run`` turns one row of a batch (a dict of arrays and key values) into a dict of new columns, a row at a time."""

    def values(scalar: pa.Scalar):
        if not isinstance(scalar, pa.ListScalar):
            return scalar.as_py()
        if not scalar.is_valid:
            return None
        flat = scalar.values
        if pa.types.is_integer(flat.type):
            return flat.fill_null(-1).to_numpy(zero_copy_only=False)
        return flat.to_numpy(zero_copy_only=False).astype(np.float64)

    def call(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: values(batch.column(n)[i]) for n in batch.schema.names}
                found = row | run(row)
                columns = []
                for field in schema:
                    cell = found[field.name]
                    if isinstance(field.dataType, T.ArrayType):
                        if field.dataType.elementType == T.LongType():
                            cell = pa.array(cell, pa.int64(), mask=np.asarray(cell) < 0)
                        else:
                            cell = pa.array(cell, pa.float64(), from_pandas=True)
                        columns.append(pa.ListArray.from_arrays(pa.array([0, len(cell)], pa.int32()), cell))
                    else:
                        columns.append(batch.column(field.name).slice(i, 1))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return blocks.mapInArrow(call, schema)


def _block_areas(stored: DataFrame, layout: Layout) -> DataFrame:
    """Add ``regions``: the least cell id of the cell's area in its own block."""
    t, cols = layout.tile_size, layout.cols
    if layout.rows * layout.cols >= 2**63:
        raise ValueError("cell ids do not fit 64 bits")

    def run(row):
        labels = kernels.label_runs(row["cells"].reshape(t, t)).ravel()
        ids = (row["brow"] * t + labels // t) * cols + row["bcol"] * t + labels % t
        return {"regions": np.where(labels < 0, -1, ids)}

    return _per_block(stored.select(*BLOCK_KEY, "cells"), run, LABELLED)


def _lines(blocks: DataFrame, t: int, columns: dict[str, str]) -> DataFrame:
    """The first and last row and column of each block, of the named array columns: ``N_``, ``E_``, ``S_``, ``W_`` and a letter."""

    def line(array: str, first: int, step: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(t - 1)), lambda i: F.get(array, F.lit(first) + i * step))

    places = {"N": (0, 1), "E": (t - 1, t), "S": (t * (t - 1), 1), "W": (0, t)}
    return blocks.select(*BLOCK_KEY, *[line(array, *places[s]).alias(f"{s}_{n}") for s in SIDES for array, n in columns.items()])


def _border_links(areas: DataFrame, t: int) -> DataFrame:
    """Pairs of areas that touch across a block border and hold the same value. Blocks are joined, not cells."""
    lines = cut_lineage(_lines(areas, t, {"cells": "v", "regions": "a"}))

    def across(side: str, other: str, axis: str) -> DataFrame:
        here = lines.select("layer", *[(F.col(c) + int(c == axis)).alias(c) for c in ("brow", "bcol")], f"{side}_v", f"{side}_a")
        there = lines.select(*BLOCK_KEY, F.col(f"{other}_v").alias("w"), F.col(f"{other}_a").alias("b"))
        met = here.join(there, BLOCK_KEY)
        pairs = met.select("layer", F.explode(F.arrays_zip(F.col(f"{side}_v").alias("v"), F.col(f"{side}_a").alias("a"), "w", "b")).alias("p"))
        return pairs.where("p.v = p.w").select("layer", "p.a", "p.b")

    return across("S", "N", "brow").unionByName(across("E", "W", "bcol")).distinct()


def _spread_join(links: DataFrame, least: DataFrame) -> DataFrame:
    """Give both ends' least neighbour to every link; hubs are split over ``SALTS`` keys."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS))).join(salted, ["layer", "a", "salt"]).drop("salt")


def _connect(links: DataFrame) -> DataFrame:
    """``layer, a, root`` for every linked area: the least id of its connected set.

    Alternates the "large star" and "small star" steps (Kiveris et al., 2014): each links a node's
    greater, then its smaller, neighbours to the least one it knows. The minima are plain
    aggregates, so a hub costs no more than other nodes; the number of rounds grows with the log of
    the set's size.
    """
    edges = cut_lineage(links.where("a <> b").select("layer", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = edges.count()
    while True:
        both = edges.unionByName(edges.select("layer", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("layer", "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            _spread_join(both, least).where("b > a").select("layer", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        large = cut_lineage(large)
        down = large.groupBy("layer", "a").agg(F.min("b").alias("m"))
        joined = _spread_join(large, down)
        small = (
            joined.select("layer", F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(down.select("layer", "a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        small = cut_lineage(small)
        # Both are sets: equal if of one size and none of the new links is new.
        before, size = size, small.count()
        changed = size != before or not small.join(edges, ["layer", "a", "b"], "left_anti").isEmpty()
        edges = small
        if not changed:
            return edges.select("layer", "a", F.col("b").alias("root"))


def label_blocks(stored: DataFrame, layout: Layout) -> DataFrame:
    """Stored blocks with ``regions``: for each cell the least cell id of the contiguous area of equal value."""
    t, cols = layout.tile_size, layout.cols
    areas = cut_lineage(_block_areas(stored, layout))
    roots = _connect(_border_links(areas, t))
    place = {"brow": F.expr(f"(a div {cols}L) div {t}"), "bcol": F.expr(f"(a % {cols}L) div {t}")}
    # At most 4 * tile_size areas of a block touch its border.
    names = roots.withColumns(place).groupBy(*BLOCK_KEY).agg(F.sort_array(F.collect_list(F.struct("a", "root"))).alias("m"))

    def run(row):
        regions, old, new = row["regions"], row["old"], row["new"]
        if old is not None:
            at = np.minimum(np.searchsorted(old, regions), len(old) - 1)
            regions = np.where(old[at] == regions, new[at], regions)
        return {"regions": regions}

    tables = names.select(*BLOCK_KEY, F.col("m.a").alias("old"), F.col("m.root").alias("new"))
    return _per_block(areas.join(tables, BLOCK_KEY, "left"), run, LABELLED)


def label(cells: DataFrame, layout: Layout) -> DataFrame:
    """Add ``region`` to the known cells: the least cell id of the contiguous area of equal value."""
    t = layout.tile_size
    blocks = label_blocks(to_blocks(cells, layout), layout)
    each = blocks.select(*BLOCK_KEY, "cells", F.posexplode("regions").alias("at", "region")).where("region IS NOT NULL")
    return each.select(
        "layer",
        F.expr(f"brow * {t} + at div {t}").alias("row"),
        F.expr(f"bcol * {t} + at % {t}").alias("col"),
        F.get("cells", F.col("at")).alias("value"),
        "region",
    )


def summary(labelled: DataFrame, layout: Layout) -> DataFrame:
    """Value, cells and bounds of each region of labelled blocks: one row for each region and block is exchanged."""
    t = layout.tile_size
    names = ("region", "cells", "row0", "row1", "col0", "col1")
    schema = T.StructType(
        LABELLED.fields[:3] + [T.StructField("value", T.ArrayType(T.DoubleType()))] + [T.StructField(n, T.ArrayType(T.LongType())) for n in names]
    )

    def run(row):
        known = np.flatnonzero(row["regions"] >= 0)
        region, first, which, count = np.unique(row["regions"][known], return_index=True, return_inverse=True, return_counts=True)
        r, c = row["brow"] * t + known // t, row["bcol"] * t + known % t
        least, most = lambda v: np.full(len(region), np.iinfo(np.int64).max), lambda v: np.full(len(region), -1)
        out = {"value": row["cells"][known][first], "region": region, "cells": count}
        for name, axis, start, op in (("row0", r, least, np.minimum), ("row1", r, most, np.maximum), ("col0", c, least, np.minimum), ("col1", c, most, np.maximum)):
            out[name] = start(axis)
            op.at(out[name], which, axis)
        return out

    parts = _per_block(labelled, run, schema)
    rows = parts.select("layer", F.explode(F.arrays_zip("value", *names)).alias("p")).select("layer", "p.*")
    return rows.groupBy("layer", "region").agg(
        F.first("value").alias("value"),
        F.sum("cells").alias("cells"),
        F.min("row0").alias("row0"),
        F.max("row1").alias("row1"),
        F.min("col0").alias("col0"),
        F.max("col1").alias("col1"),
    )


def regions_per_value(labelled: DataFrame, layout: Layout) -> DataFrame:
    """Number of regions of each value."""
    return summary(labelled, layout).groupBy("layer", "value").agg(F.count("*").alias("regions"))


def outline(labelled: DataFrame, layout: Layout) -> DataFrame:
    """Boundary edges of labelled blocks: ``side`` N, E, S or W of a cell whose neighbour there is not in its region.

    Blocks get the lines beside them from the four blocks around; only those are exchanged on their own.
    """
    t = layout.tile_size
    lines = _lines(labelled, t, {"regions": "a"})
    step = {"N": (-1, 0), "E": (0, 1), "S": (1, 0), "W": (0, -1)}
    facing = {"N": "S", "S": "N", "E": "W", "W": "E"}
    sent = F.array(
        *[F.struct(F.lit(facing[s]).alias("side"), (F.col("brow") + dr).alias("r"), (F.col("bcol") + dc).alias("c"), F.col(f"{s}_a").alias("line")) for s, (dr, dc) in step.items()]
    )
    beside = lines.select("layer", F.explode(sent).alias("p")).groupBy("layer", F.col("p.r").alias("brow"), F.col("p.c").alias("bcol"))
    beside = beside.agg(*[F.max(F.when(F.col("p.side") == s, F.col("p.line"))).alias(s) for s in SIDES])
    names = ("region", "row", "col", "side")
    schema = T.StructType(LABELLED.fields[:3] + [T.StructField(n, T.ArrayType(T.LongType())) for n in names])

    def run(row):
        grid = np.full((t + 2, t + 2), -1, dtype=np.int64)
        grid[1:-1, 1:-1] = row["regions"].reshape(t, t)
        for side, place in (("N", grid[0, 1:-1]), ("E", grid[1:-1, -1]), ("S", grid[-1, 1:-1]), ("W", grid[1:-1, 0])):
            if row[side] is not None:
                place[...] = row[side]
        own = grid[1:-1, 1:-1]
        found = []
        for k, s in enumerate(SIDES):
            dr, dc = step[s]
            r, c = np.nonzero((own >= 0) & (grid[1 + dr : 1 + dr + t, 1 + dc : 1 + dc + t] != own))
            found.append((own[r, c], row["brow"] * t + r, row["bcol"] * t + c, np.full(len(r), k)))
        return dict(zip(names, (np.concatenate(x) for x in zip(*found))))

    parts = _per_block(labelled.join(beside, BLOCK_KEY, "left"), run, schema)
    edges = parts.select("layer", F.explode(F.arrays_zip(*names)).alias("p")).select("layer", "p.region", "p.row", "p.col", "p.side")
    return edges.withColumn("side", F.element_at(F.array(*map(F.lit, SIDES)), (F.col("side") + 1).cast("int")))
