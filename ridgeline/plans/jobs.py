"""Whole jobs on stored blocks: from a request document to stored tiles or a stored layer. No cell has a row of its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.model import Layout
from ridgeline.operators import grid, render, reshape, visibility
from ridgeline.operators.blocks import BLOCK_KEY, to_cells
from ridgeline.plans import layers, stored
from ridgeline.session import cut_lineage
from ridgeline.sources import catalog, requests, scenes, sinks

_number = lambda p, key, default: float(p.get(key, default))
_named = lambda found, name: found.select(*BLOCK_KEY, F.col(name).alias("cells"))

# Products by the op name of a request; each takes blocks, layout and the request's properties.
PRODUCTS = {
    "slope": lambda b, lay, p: stored.slope(b, lay, 1.0),
    "artslope": lambda b, lay, p: stored.slope(b, lay, 1.0),
    "aspect": lambda b, lay, p: _named(stored.surface(b, lay), "aspect"),
    "hillshade": lambda b, lay, p: _named(stored.surface(b, lay), "hillshade"),
    "tpi": lambda b, lay, p: _named(stored.positions(b, lay, int(_number(p, "cellsize", 3.0))), "tpi"),
    "ruggedness": lambda b, lay, p: _named(stored.positions(b, lay, int(_number(p, "cellsize", 1.0))), "ruggedness"),
    "hlz": lambda b, lay, p: stored.suitability(
        b,
        lay,
        diameter=_number(p, "diameter", 25.0),
        radius_units=p.get("radiusunits", "map"),
        smooth=int(_number(p, "cellsize", 1.0)),
        slope_limit=_number(p, "slope", 15.0),
    ),
    "draw": lambda b, lay, p: b,
    "hover": lambda b, lay, p: b,
}


def product(op: str, blocks: DataFrame, layout: Layout, properties: dict[str, str] | None = None) -> DataFrame:
    if op not in PRODUCTS:
        raise ValueError(f"unknown operation: {op}")
    return PRODUCTS[op](blocks, layout, properties or {})


@dataclass(frozen=True)
class Command:
    """One parsed request, on the driver."""

    kind: str
    op: str
    job_id: str
    box: tuple[float, float, float, float] | None
    properties: dict[str, str]


def read_command(spark: SparkSession, body: str) -> Command:
    one = requests.parse(spark.createDataFrame([(body,)], "body string"))
    row = one.select(
        "command.type",
        "command.properties",
        requests.is_pipeline().alias("pipeline"),
        F.array(*requests.box()).alias("box"),
    ).first()
    properties = dict(row["properties"] or {})
    if not properties.get("op"):
        raise ValueError("the request names no operation")
    box = None
    if not row["pipeline"]:
        if any(v is None for v in row["box"]):
            raise ValueError("the request's geometry is not a box")
        box = tuple(row["box"])
    return Command(row["type"], properties["op"], properties.get("jobid", ""), box, properties)


def box_cells(box: tuple[float, float, float, float], layout: Layout) -> tuple[int, int, int, int]:
    """First and last row and column of a lon/lat box on a layout, whether or not the layout reaches that far."""
    west, south, east, north = box
    (x0, y0), (x1, y1) = (grid.geo.project_point(4326, layout.crs, *p) for p in ((west, south), (east, north)))
    r0, r1 = (int((layout.y0 - y) // layout.cell_h) for y in (y1, y0))
    c0, c1 = (int((x - layout.x0) // layout.cell_w) for x in (x0, x1))
    return r0, r1, c0, c1


def run_analytic(
    spark: SparkSession,
    body: str,
    scene_table: DataFrame,
    scene_blocks: DataFrame,
    layout: Layout,
    tiles_root: str,
    documents_root: str,
    end_zoom: int = 0,
    clip: bool = False,
    tile_size: int = 256,
) -> str:
    """Search, mosaic, reproject, compute, build the pyramid, colour and store; returns the job id.

    ``scene_blocks`` (``scenes.read_scenes``) has ``scene_id, brow, bcol, cells`` on the grid ``layout``: only the scenes
    that the search finds are read. The pyramid is built from the product. ``clip`` keeps the request's box, and reads
    only the blocks around it.
    """
    command = read_command(spark, body)
    if command.op not in PRODUCTS:
        raise ValueError(f"unknown operation: {command.op}")
    if command.box is None:
        raise ValueError("an analytic request needs a box")
    chosen = catalog.job_scenes(scene_table, command.kind, *command.box).select("scene_id")
    found = scenes.of_scenes(scene_blocks, chosen)
    if clip:
        t, (r0, r1, c0, c1) = layout.tile_size, box_cells(command.box, layout)
        found = found.where(F.col("brow").between((r0 - 1) // t, (r1 + 1) // t) & F.col("bcol").between((c0 - 1) // t, (c1 + 1) // t))
    readings = found.select(F.lit(command.job_id).alias("layer"), "brow", "bcol", "cells", F.col("scene_id").alias("scene_rank"))
    zoom, target = grid.zoom_layout(grid.target_layout(layout, 3857), tile_size)
    projected = reshape.resample_blocks(reshape.mosaic_blocks(readings), layout, target)
    if clip:
        projected = reshape.crop_blocks(projected, target, *box_cells(command.box, target))
    result = cut_lineage(product(command.op, projected, target, command.properties))  # for the pyramid and the breaks
    levels = reshape.pyramid_blocks(result, tile_size, zoom, end_zoom)
    painted = render.paint_blocks(levels, command.op, reference=to_cells(result, target), stored=True)
    sinks.write_tiles(render.block_tiles(painted, command.job_id), tiles_root)
    west, south, east, north = (F.lit(v) for v in command.box)
    document = catalog.job_document(
        F.lit(command.job_id),
        F.lit(command.op),
        F.lit(str(layout.resolution)),
        west,
        south,
        east,
        north,
        F.lit("Success"),
    )
    sinks.write_documents(spark.range(1).select(document.alias("d")).select("d.*"), documents_root, "jobid")
    return command.job_id


@dataclass(frozen=True)
class Derived:
    """What a pipeline has stored: a document for each layer, and for the combined removal which steps ran."""

    documents: list[DataFrame]
    flags: DataFrame | None = None


def run_pipeline(
    spark: SparkSession,
    body: str,
    inputs: dict[str, tuple[DataFrame, Layout] | str],
    root: str,
    documents_root: str,
) -> Derived:
    """Derive layers, store them and register their documents. A second run replaces its own layers and adds nothing.

    ``inputs`` names the rasters by role, as blocks and layout or by the URI of a layer stored under ``root``:
    ``bareearth``, ``firstreturn``, ``dem``, ``landcover`` or ``upload``. All but the land cover are brought to lon/lat
    first. ``buildcombined`` does without ``firstreturn`` or ``landcover`` where they are absent; its flags tell.
    """
    command = read_command(spark, body)

    def given(role: str) -> tuple[DataFrame, Layout]:
        if role not in inputs:
            raise ValueError(f"the {command.op} pipeline needs the raster {role!r}")
        found = inputs[role]
        return scenes.open_layer(spark, root, found) if isinstance(found, str) else found

    def store(blocks: DataFrame, lay: Layout, kind: str) -> DataFrame:
        return scenes.write_layer(blocks, lay, root, kind, scenes.resolution_label(lay), command.job_id)

    flags = None
    if command.op == "upload":
        document, _ = scenes.upload(*given("upload"), command.properties.get("type", "sources"), root, command.job_id)
        out = [document]
    elif command.op in ("buildobs", "buildhover", "buildcombined"):
        bare, lay = scenes.to_lonlat(*given("bareearth"))
        bare = cut_lineage(bare)
        first = None
        if command.op != "buildcombined" or "firstreturn" in inputs:
            first_blocks, first_lay = given("firstreturn")
            first = cut_lineage(reshape.resample_blocks(first_blocks, first_lay, lay))
        sources = [(bare, "bareearth")] + ([(first, "firstreturn")] if first is not None else [])
        if command.op == "buildobs":
            derived = [(stored.obstruction_removed(bare, first), "noobs"), *sources]
        elif command.op == "buildhover":
            derived = [(stored.object_height(bare, first), "hover")]
        else:
            cover = given("landcover") if "landcover" in inputs else (None, None)
            combined, steps = stored.combined_removal(bare, lay, first, *cover)
            derived, flags = [(combined, "combined"), *sources], layers.flags_row(spark, steps)
        out = [store(blocks, lay, kind) for blocks, kind in derived]
    elif command.op == "buildobslc":
        dem, lay = scenes.to_lonlat(*given("dem"))
        out = [store(stored.cover_filtered(dem, lay, *given("landcover")), lay, "lcnoobs")]
    else:
        raise ValueError(f"unknown operation: {command.op}")
    for document in out:
        sinks.write_documents(document, documents_root, "uri")
    return Derived(out, flags)


def center_viewshed(cells: DataFrame, layout: Layout, layer: str, radius: int) -> DataFrame:
    """What the middle of a layer sees."""
    return visibility.viewshed(visibility.center_observer(cells.sparkSession, layout, layer), cells, layout, radius)
