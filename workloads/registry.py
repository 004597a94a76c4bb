"""One query per operator, over the driver's tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import colour, geo, text
from ridgeline.model import Layout, grid_to_map, map_to_grid
from ridgeline.operators import blocks, focal, grid, joins, local, regions, render, reshape, stats, surface, vector, visibility
from ridgeline.plans import layers, products, stored
from ridgeline.session import ship
from ridgeline.sources import catalog, requests, scenes
from workloads import rasters as ras

QUERIES = {}

BOX = (-77.6, 36.2, -77.3, 36.6)
DIAMETER = 1200.0
RADIUS = 3.0
RINGS = ((100, 600.0), (110, 400.0), (120, 200.0))


def query(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        return fn(ship(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def r4(value: Column) -> Column:
    """Four decimals by plain arithmetic, the same in any engine."""
    return F.floor(value * 10000 + 0.5) / 10000


def out(cells: DataFrame, value: Column | None = None) -> DataFrame:
    return cells.select("row", "col", (F.col("value") if value is None else value).alias("v"))


def whole(cells: DataFrame) -> DataFrame:
    return out(cells, F.col("value").cast("long"))


def rounded(cells: DataFrame) -> DataFrame:
    return out(cells, r4(F.col("value")))


# Sources


@query
def s1_scene_box_search(spark, d):
    return catalog.search_box(ras.scenes(spark, d), "sources", *BOX).select("scene_id", "type", "uri")


@query
def s2_scene_radius_search(spark, d):
    found = catalog.search_radius(ras.scenes(spark, d), -77.5, 36.4, 40000.0)
    return found.select("scene_id", r4(F.col("metres")).alias("metres"))


@query
def s3_box_to_radius_search(spark, d):
    found = catalog.search_box_radius(ras.scenes(spark, d), *BOX)
    return found.select("scene_id", r4(F.col("metres")).alias("metres"))


@query
def s4_job_scenes(spark, d):
    return catalog.job_scenes(ras.scenes(spark, d), "noobs", *BOX).select("scene_id", "uri")


@query
def s5_document_match(spark, d):
    stored = catalog.envelopes(ras.scenes(spark, d))
    return catalog.match_documents(stored, "type", "NoObs").select("scene_id", "uri", "bucket", "key")


@query
def s6_uri_split(spark, d):
    bucket, key = text.split_uri(F.col("uri"))
    return ras.scenes(spark, d).select("scene_id", bucket.alias("bucket"), key.alias("key"), text.file_stem(F.col("uri")).alias("stem"))


@query
def s7_scene_files(spark, d):
    return ras.scenes(spark, d).where(text.is_scene_file(F.col("uri"))).groupBy("type").agg(F.count("*").alias("n"))


def _held(spark, d, wanted):
    """The inventory: scenes of suppliers whose balance is not negative."""
    good = ras.table(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("scene_id"))
    return wanted.join(good, "scene_id").select("uri")


@query
def s11_missing_scenes(spark, d):
    wanted = ras.scenes(spark, d).select("scene_id", "uri")
    held = _held(spark, d, wanted)
    return joins.missing(wanted, held, "uri").select("scene_id")


@query
def s11_present_scenes(spark, d):
    wanted = ras.scenes(spark, d).select("scene_id", "uri")
    held = _held(spark, d, wanted)
    return joins.present(wanted, held, "uri").select("scene_id")


@query
def s12_load_scenes(spark, d):
    """Cells of the scenes a job reads; a line item is a cell of its supplier's scene."""
    chosen = catalog.job_scenes(ras.scenes(spark, d), "hover", -78.0, 36.0, -77.0, 37.0).select("scene_id")
    cells = ras.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("scene_id"),
        F.col("l_orderkey").alias("row"),
        F.col("l_partkey").alias("col"),
        F.floor("l_extendedprice").cast("long").alias("value"),
    )
    return (
        scenes.of_scenes(cells, chosen)
        .groupBy("scene_id")
        .agg(F.count("*").alias("n"), F.min("value").alias("zmin"), F.max("value").alias("zmax"))
    )


@query
def s15_job_documents(spark, d):
    box = [F.col(c) for c in joins.BOX]
    job = F.concat(F.lit("job-"), F.col("request_id").cast("string"))
    resolution = F.when(F.col("request_id") % 4 == 0, "").otherwise("10M")
    doc = catalog.job_document(job, F.lit("tpi"), resolution, *box, F.lit("Success"))
    parsed = ras.request_boxes(spark, d).select(
        F.from_json(F.to_json(doc), catalog.JOB_DOCUMENT).alias("j")
    )
    return parsed.select(
        "j.jobid", "j.resolution", F.col("j.bbox")["@WKT"].alias("wkt"), F.col("j.urlRoot").alias("url"), "j.result"
    )


@query
def s16_layer_documents(spark, d):
    lay = ras.layout(spark, d)
    parts = ras.dem(spark, d).unionByName(ras.sparse(spark, d))
    size = parts.groupBy("layer").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    west, north = geo.project(3857, 4326, F.lit(lay.x0), F.lit(lay.y0))
    east, south = geo.project(
        3857, 4326, F.lit(lay.x0) + F.col("cols") * lay.cell_w, F.lit(lay.y0) - F.col("rows") * lay.cell_h
    )
    metres = geo.haversine(west, north, west, south) / F.col("rows")
    doc = catalog.scene_document("sources", F.concat("layer", F.lit(".tif")), geo.resolution_label(metres), west, south, east, north)
    parsed = size.select("layer", F.from_json(F.to_json(doc), catalog.SCENE_DOCUMENT).alias("j"))
    return parsed.select("layer", "j.type", "j.resolution", "j.uri", F.col("j.bbox")["@WKT"].alias("wkt"))


def _low_blocks(spark, d, rows=None, cols=None):
    """Elevation above 900 in blocks of 16 cells; of the named rows and columns only."""
    cells = ras.dem(spark, d).withColumn("value", F.col("value") - 900)
    if rows is not None:
        cells = cells.where(F.col("row").between(rows[0], rows[-1]) & F.col("col").between(cols[0], cols[-1]))
    return blocks.to_blocks(cells, ras.layout(spark, d).with_tile_size(16))


@query
def s17_picture_tiles(spark, d):
    tiles = render.block_tiles(render.paint_blocks(reshape.pyramid_blocks(_low_blocks(spark, d), 16, 5, 2), "hover"), "job")
    shown = F.filter("rgba", lambda c: c != 0)
    return tiles.select("z", "x", "y", F.size(shown).cast("long").alias("n"), F.aggregate(shown, F.lit(0).cast("long"), lambda a, c: a + c).alias("total"))


def _request_bodies(spark, d):
    box = [F.col(c) for c in joins.BOX]
    k = F.col("request_id")
    given = {"op": F.when(k % 2 == 0, "tpi").otherwise("slope"), "jobid": F.concat(F.lit("job-"), k.cast("string"))}
    full = {**given, "cellsize": (k % 5 + 1).cast("string")}
    feature = lambda p: requests.feature_json(F.lit("sources"), "Polygon", requests.box_ring(*box), p)
    pipeline = requests.pipeline_json(F.lit("pipeline"), given)
    body = F.when(k % 7 == 0, pipeline).when(k % 3 == 0, feature(given)).otherwise(feature(full))
    return ras.request_boxes(spark, d).select(body.alias("body"))


@query
def s19_request_params(spark, d):
    parsed = requests.parse(_request_bodies(spark, d))
    west, south, east, north = requests.box()
    return parsed.select(
        requests.text_property("jobid").alias("jobid"),
        requests.text_property("op").alias("op"),
        requests.number_property("cellsize", 3.0).alias("cellsize"),
        requests.is_pipeline().cast("int").alias("pipeline"),
        west.alias("west"),
        south.alias("south"),
        east.alias("east"),
        north.alias("north"),
    )


@query
def s20_request_rings(spark, d):
    box = [F.col(c) for c in joins.BOX]
    ring = ras.request_boxes(spark, d).select("request_id", F.posexplode(requests.box_ring(*box)[0]).alias("pos", "pt"))
    return ring.select("request_id", "pos", F.col("pt")[0].alias("lon"), F.col("pt")[1].alias("lat"))


@query
def j2_requests_x_scenes(spark, d):
    return joins.overlap_join(ras.request_boxes(spark, d), ras.scenes(spark, d), "request_id", "scene_id", 0.1)


# Local algebra


def _slope4(spark, d, cells=None):
    lay = ras.layout(spark, d)
    sloped = surface.slope(ras.dem_gaps(spark, d) if cells is None else cells, lay)
    return sloped.withColumn("value", r4(F.col("value")))


@query
def p2_slope_class(spark, d):
    return out(local.local_map(_slope4(spark, d), local.threshold_class(15.0)))


@query
def p3_ring_class(spark, d):
    rings = local.ring_class(F.lit(30.0), F.lit(20.0), F.lit(10.0))
    return out(local.local_map(_slope4(spark, d), rings))


@query
def p4_difference(spark, d):
    return out(local.subtract(ras.first_return(spark, d), ras.dem(spark, d)))


@query
def p5_product(spark, d):
    return out(local.multiply(ras.first_return(spark, d), ras.dem_gaps(spark, d)))


@query
def p6_ratio(spark, d):
    base = local.local_map(ras.dem(spark, d), lambda v: v - 1000)
    return out(local.divide(ras.first_return(spark, d), base), r4(F.col("value")))


@query
def p7_abs(spark, d):
    return out(local.local_map(ras.dem(spark, d), lambda v: F.abs(v - 1000)))


@query
def p8_sqrt(spark, d):
    return rounded(local.local_map(ras.dem(spark, d), lambda v: local.local_sqrt(v - 1000)))


@query
def p9_equal(spark, d):
    return out(local.equal(ras.dem(spark, d), ras.first_return(spark, d)))


@query
def p10_local_if(spark, d):
    return out(local.local_if(ras.dem(spark, d), ras.first_return(spark, d), lambda a, b: b > a + 10, -1))


@query
def p11_suitable_mask(spark, d):
    return out(local.local_map(ras.landcover(spark, d), local.suitable_mask))


@query
def p11_legend_report(spark, d):
    legend = local.land_cover_legend(spark)
    cells = ras.landcover(spark, d).groupBy(F.col("value").alias("cls")).agg(F.count("*").alias("n"))
    return cells.join(legend, "cls").select("cls", "title", "suitable", "dry", "n")


@query
def p12_water_mask(spark, d):
    return out(local.local_map(ras.landcover(spark, d), local.water_mask))


@query
def p13_keep_class(spark, d):
    return out(local.local_map(ras.landcover(spark, d), local.keep_class(3)))


@query
def p13_keep_positive(spark, d):
    return out(local.local_map(ras.dem(spark, d), lambda v: local.keep_positive(v - 1000)))


@query
def p14_cell_to_map(spark, d):
    lay = ras.layout(spark, d)
    cells = grid_to_map(ras.dem(spark, d).select("row", "col"), lay)
    back = map_to_grid(cells.withColumnsRenamed({"row": "row0", "col": "col0"}), lay)
    return back.select(
        F.col("row0").alias("row"), F.col("col0").alias("col"), "x", "y", F.col("row").alias("row2"), F.col("col").alias("col2")
    )


@query
def p16_identity(spark, d):
    return out(ras.dem_gaps(spark, d))


@query
def p17_colorize(spark, d):
    cells = local.local_map(ras.dem(spark, d), lambda v: v - 900)
    return render.colorize(cells, "hover").groupBy("rgba").agg(F.count("*").alias("n"))


@query
def p18_ramp_by_op(spark, d):
    lay = ras.layout(spark, d)
    position = products.tpi(ras.dem_gaps(spark, d), lay, 1).withColumn("value", r4(F.col("value")))
    return render.paint(position, "tpi").groupBy("rgba").agg(F.count("*").alias("n"))


@query
def p19_quantile_ramp(spark, d):
    painted = render.colorize_by_quantiles(ras.dem(spark, d), "green-red-orange")
    return painted.groupBy("rgba").agg(F.count("*").alias("n"))


# Focal and surface


@query
def f1_focal_min(spark, d):
    return whole(focal.focal_min(ras.dem_gaps(spark, d), ras.layout(spark, d), 2))


@query
def f2_focal_max(spark, d):
    return whole(focal.focal_max(ras.dem_gaps(spark, d), ras.layout(spark, d), 2))


@query
def f3_focal_mean(spark, d):
    return rounded(focal.focal_mean(ras.dem_gaps(spark, d), ras.layout(spark, d), 2))


@query
def f3_focal_mean_window_form(spark, d):
    return rounded(focal.focal_mean(ras.dem_gaps(spark, d), ras.layout(spark, d), 2, form="window"))


@query
def f4_focal_sum_circle(spark, d):
    return whole(focal.focal_sum(ras.dem_gaps(spark, d), ras.layout(spark, d), RADIUS))


@query
def f5_slope(spark, d):
    return rounded(surface.slope(ras.dem_gaps(spark, d), ras.layout(spark, d)))


@query
def f5_slope_window_form(spark, d):
    return rounded(surface.slope(ras.dem_gaps(spark, d), ras.layout(spark, d), form="window"))


@query
def f6_aspect(spark, d):
    return rounded(surface.aspect(ras.dem_gaps(spark, d), ras.layout(spark, d)))


@query
def f7_hillshade(spark, d):
    return out(surface.hillshade(ras.dem_gaps(spark, d), ras.layout(spark, d)))


@query
def f8_artslope(spark, d):
    return render.colorize(_slope4(spark, d), "artslope").groupBy("rgba").agg(F.count("*").alias("n"))


@query
def f9_horn_gather(spark, d):
    east, south = F.col("east").cast("long"), F.col("south").cast("long")
    return surface.horn(ras.dem_gaps(spark, d), ras.layout(spark, d)).select("row", "col", east.alias("east"), south.alias("south"))


# Composite products


@query
def c1_tpi(spark, d):
    return rounded(products.tpi(ras.dem_gaps(spark, d), ras.layout(spark, d), 2))


@query
def c2_tpi_ratio(spark, d):
    return rounded(products.tpi_ratio(ras.dem_gaps(spark, d), ras.layout(spark, d), 1))


@query
def c3_ruggedness(spark, d):
    return rounded(products.ruggedness(ras.dem_gaps(spark, d), ras.layout(spark, d), 1))


@query
def c4_suitability_cells(spark, d):
    cells = ras.dem_gaps(spark, d)
    return whole(products.suitability(cells, ras.layout(spark, d), 2 * RADIUS, "cells", rings=RINGS, decimals=4))


@query
def c5_suitability_water(spark, d):
    lay = ras.layout(spark, d)
    cover, cover_lay = ras.landcover(spark, d), ras.landcover_layout(lay)
    return whole(
        products.suitability_on_dry_land(
            ras.dem_gaps(spark, d), lay, cover, cover_lay, diameter=DIAMETER, rings=RINGS, decimals=4
        )
    )


@query
def c6_suitability(spark, d):
    return whole(products.suitability(ras.dem_gaps(spark, d), ras.layout(spark, d), DIAMETER, rings=RINGS, decimals=4))


@query
def c6_suitability_classes(spark, d):
    return whole(products.suitability(ras.dem_gaps(spark, d), ras.layout(spark, d), DIAMETER, rings=(), decimals=4))


@query
def c7_suitability_masked(spark, d):
    lay = ras.layout(spark, d)
    cover, cover_lay = ras.landcover(spark, d), ras.landcover_layout(lay)
    return whole(
        products.suitability_on_cover(
            ras.dem(spark, d), lay, cover, cover_lay, z_factor=1.0, diameter=DIAMETER, rings=RINGS, decimals=4
        )
    )


@query
def c8_breaks(spark, d):
    lay = ras.layout(spark, d)
    cover, cover_lay = ras.landcover(spark, d), ras.landcover_layout(lay)
    kept = products.suitable_elevation(ras.dem(spark, d), lay, cover, cover_lay)
    scores = products.site_scores(kept, lay, RADIUS, smooth=None, decimals=4)
    found = products.suitability_statistics(scores)
    return found.select(
        F.explode(F.transform("breaks", lambda b: b.cast("long"))).alias("brk"),
        F.col("top").cast("long").alias("top"),
        r4(F.col("mean")).alias("mean"),
    )


@query
def c9_batch(spark, d):
    """Three files with their own cell sizes in one pass."""
    sized = lambda cells, layer, size: cells.select(
        F.lit(layer).alias("layer"), "row", "col", "value", F.lit(size).alias("cell_w"), F.lit(size).alias("cell_h")
    )
    files = (
        sized(ras.dem(spark, d), "a.tif", 200.0)
        .unionByName(sized(ras.dem_gaps(spark, d), "b.tif", 100.0))
        .unionByName(sized(ras.first_return(spark, d), "c.tif", 50.0))
    )
    found = products.batch(files, ras.TILE, 1)
    return found.select(
        "layer",
        "row",
        "col",
        r4(F.col("slope")).alias("slope"),
        r4(F.col("aspect")).alias("aspect"),
        F.col("hillshade").cast("int").alias("hillshade"),
        r4(F.col("tpi")).alias("tpi"),
        r4(F.col("tpi_ratio")).alias("tpi_ratio"),
    )


# Derived layers


@query
def l1_noobs(spark, d):
    return out(layers.obstruction_removed(ras.dem(spark, d), ras.first_return(spark, d)))


@query
def l2_lcnoobs(spark, d):
    lay = ras.layout(spark, d)
    return out(layers.cover_filtered(ras.dem(spark, d), lay, ras.landcover(spark, d), ras.landcover_layout(lay)))


@query
def l3_hover(spark, d):
    return out(layers.object_height(ras.dem(spark, d), ras.first_return(spark, d)))


@query
def l4_combined(spark, d):
    lay = ras.layout(spark, d)
    cells, _ = layers.combined_removal(
        ras.dem_gaps(spark, d), lay, ras.first_return(spark, d), ras.landcover(spark, d), ras.landcover_layout(lay)
    )
    return out(cells)


# Reshaping


def lonlat(spark, d) -> Layout:
    """A lon/lat grid that grows with the raster."""
    return Layout(4326, -77.75, 38.95, 0.002, 0.002, 100, 4 * ras.layout(spark, d).rows, ras.TILE)


@query
def t1_reproject_bilinear(spark, d):
    return rounded(grid.resample(ras.dem_gaps(spark, d), ras.layout(spark, d), lonlat(spark, d), "bilinear"))


@query
def t1_reproject_nearest(spark, d):
    return whole(grid.resample(ras.dem_gaps(spark, d), ras.layout(spark, d), lonlat(spark, d), "nearest"))


@query
def t2_tiles(spark, d):
    lay = ras.layout(spark, d).with_tile_size(16)
    tiled = grid.tile_to_layout(ras.sparse_records(spark, d), lay)
    return tiled.groupBy("trow", "tcol").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query
def t3_mosaic(spark, d):
    return out(grid.mosaic(ras.sparse_records(spark, d)))


@query
def t4_nearest_onto(spark, d):
    lay = ras.layout(spark, d)
    return grid.nearest_onto(ras.dem(spark, d), lay, ras.landcover(spark, d), ras.landcover_layout(lay), "cls").select("row", "col", "cls")


@query
def t5_crop(spark, d):
    cells, _ = grid.crop(ras.dem(spark, d), ras.layout(spark, d), -8652100.0, 4650100.0, -8644000.0, 4705000.0)
    return out(cells)


@query
def t6_retile(spark, d):
    return grid.retile(ras.dem_gaps(spark, d), ras.layout(spark, d), 32, F.lit("dem")).drop("layer")


@query
def t7_slippy_keys(spark, d):
    keyed = grid.slippy_keys(ras.dem(spark, d), ras.layout(spark, d))
    return keyed.groupBy("z", "x", "y").agg(F.count("*").alias("n"))


@query
def t8_pyramid(spark, d):
    return grid.pyramid(ras.dem_gaps(spark, d), 6, 0, "nearest", 16).select("z", "row", "col", F.col("value").alias("v"))


@query
def t8_pyramid_average(spark, d):
    return grid.pyramid(ras.dem_gaps(spark, d), 6, 0, "average", 16).select("z", "row", "col", r4(F.col("value")).alias("v"))


@query
def t9_stitch(spark, d):
    lay = ras.layout(spark, d)
    return whole(blocks.to_cells(blocks.to_blocks(ras.dem_gaps(spark, d), lay), lay))


# Statistics


@query
def a1_histogram(spark, d):
    return stats.histogram(ras.sparse(spark, d)).select("value", "n")


@query
def a2_tile_histogram(spark, d):
    return stats.tile_histogram(ras.dem(spark, d), 16).select("trow", "tcol", "value", "n")


@query
def a3_breaks(spark, d):
    both = ras.dem(spark, d).unionByName(ras.sparse(spark, d))
    return stats.quantile_breaks(both, 10).select("layer", F.col("i").cast("long").alias("i"), "brk")


@query
def a4_stats(spark, d):
    both = ras.dem(spark, d).unionByName(ras.sparse(spark, d))
    found = stats.summary(both)
    return found.select("layer", "n", "vmin", "vmax", r4(F.col("vmean")).alias("vmean"))


def _sites(spark, d):
    tie = F.struct("pos", "part", "supp")
    return requests.site_parameters(ras.aircraft(spark, d), tie)


@query
def a5_largest_aircraft(spark, d):
    return _sites(spark, d).select("request_id", "largest.diameter", "largest.kind")


@query
def a6_area_diameter(spark, d):
    return ras.aircraft(spark, d).groupBy("request_id").agg(requests.area_diameter(requests.NIGHT_BUFFER).alias("total"))


@query
def a7_site_params(spark, d):
    at = lambda k: F.col("properties")[k]
    return _sites(spark, d).select(
        "request_id", "total", at("kind").alias("kind"), at("diameter").alias("diameter"), at("distanceBuffer").alias("buffer")
    )


@query
def a8_tile_count(spark, d):
    both = ras.dem(spark, d).unionByName(ras.sparse(spark, d))
    return stats.tile_count(both, 16)


def _classes(spark, d):
    return local.local_map(ras.dem_gaps(spark, d), lambda v: F.expr("(value div 100) % 4"))


def _labelled(cells, lay):
    return regions.label_blocks(blocks.to_blocks(cells, lay), lay)


@query
def a9_regions(spark, d):
    lay = ras.layout(spark, d)
    found = regions.summary(_labelled(_classes(spark, d), lay), lay)
    return found.select("region", F.col("value").cast("long").alias("value"), "cells", "row0", "row1", "col0", "col1")


@query
def a9_regions_per_value(spark, d):
    lay = ras.layout(spark, d)
    found = regions.regions_per_value(_labelled(_classes(spark, d), lay), lay)
    return found.select(F.col("value").cast("long").alias("value"), "regions")


@query
def a10_region_outline(spark, d):
    one = _classes(spark, d).where("value = 1")
    lay = ras.layout(spark, d)
    return regions.outline(_labelled(one, lay), lay).select("region", "row", "col", "side")


# Vector and visibility


def _observers(spark, d):
    return ras.points(spark, d).withColumnRenamed("point_id", "observer_id")


@query
def v1_ring_viewshed(spark, d):
    seen = visibility.ring_viewshed(_observers(spark, d), ras.dem(spark, d), ras.layout(spark, d), 12)
    return seen.select("observer_id", "row", "col", "visible")


@query
def v2_viewshed(spark, d):
    seen = visibility.viewshed(_observers(spark, d), ras.dem_gaps(spark, d), ras.layout(spark, d), 12)
    return seen.select("observer_id", "row", "col", "visible")


@query
def v3_symbol_rings(spark, d):
    marks = local.local_map(ras.dem_gaps(spark, d), lambda v: F.when(v % 97 == 0, 3).otherwise(v % 3))
    return whole(vector.symbol_rings(marks, ras.layout(spark, d), RINGS))


@query
def v4_buffers(spark, d):
    lay = ras.layout(spark, d)
    return out(vector.burn_points(ras.dem_gaps(spark, d), ras.points(spark, d), lay, 600.0, 7))


@query
def v5_lines(spark, d):
    lay = ras.layout(spark, d)
    ends = grid_to_map(ras.points(spark, d), lay)
    vertices = ends.select(
        F.expr("point_id div 10").alias("line_id"), (F.col("point_id") % 10).cast("int").alias("seq"), "x", "y"
    )
    return out(vector.burn_lines(vertices, lay))


@query
def v6_cumulative(spark, d):
    seen = visibility.viewshed(
        _observers(spark, d), ras.dem(spark, d), ras.layout(spark, d), 8, observer_height=3.0, target_height=2.0
    )
    return visibility.cumulative(seen).select("row", "col", "visible")


@query
def j3_cells_near_points(spark, d):
    """Distance in cells, squared, from each cell to the nearest point within three cells."""
    near = vector.cells_around(ras.points(spark, d), ras.layout(spark, d), 600.0)
    return near.groupBy("row", "col").agg(F.min("d2").cast("int").alias("d2"))


# Layers stored as blocks


def _stored(spark, d):
    return blocks.to_blocks(ras.dem_gaps(spark, d), ras.layout(spark, d))


@query
def f5_slope_stored_blocks(spark, d):
    lay = ras.layout(spark, d)
    return rounded(blocks.to_cells(stored.slope(_stored(spark, d), lay), lay))


@query
def f3_focal_mean_stored_blocks(spark, d):
    lay = ras.layout(spark, d)
    found = stored.square_stats(_stored(spark, d), lay, 2)
    mean = found.withColumn("cells", F.zip_with("vsum", "vcount", F.try_divide))
    return rounded(blocks.to_cells(mean, lay))


@query
def f4_focal_sum_stored_blocks(spark, d):
    lay = ras.layout(spark, d)
    return whole(blocks.to_cells(stored.focal_sum(_stored(spark, d), lay, RADIUS), lay))


@query
def c1_tpi_stored_blocks(spark, d):
    lay = ras.layout(spark, d)
    return rounded(blocks.to_cells(stored.positions(_stored(spark, d), lay, 2), lay, "tpi"))


@query
def c6_suitability_stored_blocks(spark, d):
    lay = ras.layout(spark, d)
    return whole(blocks.to_cells(stored.suitability(_stored(spark, d), lay, DIAMETER, rings=RINGS, decimals=4), lay))


def _elevations(spark, d, lay):
    return blocks.to_blocks(ras.dem(spark, d), lay), blocks.to_blocks(ras.first_return(spark, d), lay)


@query
def l3_hover_stored_blocks(spark, d):
    lay = ras.layout(spark, d)
    return whole(blocks.to_cells(stored.object_height(*_elevations(spark, d, lay)), lay))


def _cover(spark, d, lay):
    cover_lay = ras.landcover_layout(lay)
    return blocks.to_blocks(ras.landcover(spark, d), cover_lay), cover_lay


@query
def l2_lcnoobs_stored_blocks(spark, d):
    lay = ras.layout(spark, d)
    bare, _ = _elevations(spark, d, lay)
    return whole(blocks.to_cells(stored.cover_filtered(bare, lay, *_cover(spark, d, lay)), lay))


@query
def l4_combined_stored_blocks(spark, d):
    """Cells that are left; one that is removed has no row."""
    lay = ras.layout(spark, d)
    _, first = _elevations(spark, d, lay)
    cells, _ = stored.combined_removal(_stored(spark, d), lay, first, *_cover(spark, d, lay))
    return whole(blocks.to_cells(cells, lay))


@query
def t1_reproject_stored_blocks(spark, d):
    target = lonlat(spark, d)
    return rounded(blocks.to_cells(reshape.resample_blocks(_stored(spark, d), ras.layout(spark, d), target), target))


@query
def t3_mosaic_stored_blocks(spark, d):
    """Scenes of one line number each, the least one first."""
    lay = ras.sparse_layout(spark, d)
    price = F.floor("l_extendedprice").cast("double")
    cells = ras.table(spark, d, "lineitem").groupBy(
        F.col("l_linenumber").cast("string").alias("layer"), F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")
    )
    scenes_ = blocks.to_blocks(cells.agg(F.min(price).alias("value")), lay, sparse=True)
    ranked = scenes_.select(F.lit("m").alias("layer"), "brow", "bcol", "places", "cells", F.col("layer").cast("int").alias("scene_rank"))
    return whole(blocks.to_cells(reshape.mosaic_blocks(ranked), lay))


@query
def t4_nearest_stored_blocks(spark, d):
    lay = ras.layout(spark, d)
    found = blocks.to_cells(reshape.resample_blocks(*_cover(spark, d, lay), lay, "nearest"), lay)
    return found.select("row", "col", F.col("value").cast("int").alias("cls"))


@query
def t8_pyramid_stored_blocks(spark, d):
    lay = ras.layout(spark, d).with_tile_size(16)
    levels = reshape.pyramid_blocks(blocks.to_blocks(ras.dem_gaps(spark, d), lay), 16, 6, 0)
    cells = levels.select("z", "brow", "bcol", F.posexplode("cells").alias("at", "v")).where("v IS NOT NULL")
    return cells.select("z", F.expr("brow * 16 + at div 16").alias("row"), F.expr("bcol * 16 + at % 16").alias("col"), F.col("v").cast("long").alias("v"))


# Scalar functions


@query
def m1_haversine(spark, d):
    metres = geo.haversine(*[F.col(c) for c in joins.BOX])
    return ras.request_boxes(spark, d).select("request_id", r4(metres).alias("metres"))


@query
def m2_resolution_label(spark, d):
    """Labels of account balances taken as centimetres."""
    metres = F.abs(F.col("c_acctbal")) / 100
    return ras.table(spark, d, "customer").select("c_custkey", geo.resolution_label(metres).alias("label"))


@query
def m3_wkt(spark, d):
    box = [F.col(c) for c in joins.BOX]
    return ras.request_boxes(spark, d).select("request_id", text.box_wkt(*box).alias("box"), text.point_wkt(box[0], box[3]).alias("corner"))


@query
def m9_colour_channels(spark, d):
    """Colours packed from four columns and taken apart again."""
    part = lambda k: F.pmod(F.col("l_orderkey") * k, F.lit(256)).cast("int")
    packed = colour.pack(part(1), part(3), part(5), part(7))
    one = ras.table(spark, d, "lineitem").select(packed.alias("rgba")).groupBy("rgba").agg(F.count("*").alias("n"))
    return one.select("rgba", "n", colour.channels(F.col("rgba")).alias("ch")).select("rgba", "n", "ch.*")


@query
def s18_read_tile(spark, d):
    """The cells of one picture tile, from the 32 rows and columns that lie below it at the base zoom."""
    low = _low_blocks(spark, d, rows=range(96, 128), cols=range(32, 64))
    tiles = render.tile_on_demand(low, "hover", 16, 5, 4, 1, 3)
    return tiles.select(F.posexplode("rgba").alias("at", "rgba"))
