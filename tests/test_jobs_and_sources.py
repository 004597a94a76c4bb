import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_array, grid_cells
from ridgeline.functions import colour, text
from ridgeline.model import Layout
from ridgeline.operators import blocks, joins, render, reshape
from ridgeline.plans import jobs, layers, stored as stored_plans
from ridgeline.sources import catalog, requests, scenes, sinks

LAY = Layout(4326, -77.0, 39.0, 0.0005, 0.0005, 40, 40, 16)
BODY = """{"type": "sources", "geometry": {"type": "Polygon", "coordinates":
  [[[-77.0, 38.98], [-76.98, 38.98], [-76.98, 39.0], [-77.0, 39.0], [-77.0, 38.98]]]},
  "properties": {"op": "%s", "jobid": "job-1", "cellsize": "2"}}"""


def scene_table(spark):
    rows = [
        (1, "sources", "hdfs://sources/a.tif", -77.0, 38.98, -76.98, 39.0),
        (2, "sources", "hdfs://sources/b_wgs84.tif", -77.0, 38.98, -76.98, 39.0),
        (3, "hover", "hdfs://hover/c.tif", -77.0, 38.98, -76.98, 39.0),
        (4, "sources", "hdfs://sources/d.tif", 10.0, 10.0, 11.0, 11.0),
    ]
    return spark.createDataFrame(rows, "scene_id long, type string, uri string, xmin double, ymin double, xmax double, ymax double")


def scene_blocks(spark):
    r, c = np.mgrid[0:40, 0:40]
    stored = blocks.to_blocks(grid_cells(spark, 100.0 + 10 * np.sin(r / 5.0) + c), LAY)
    each = stored.select(F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3, 4)])).alias("scene_id"), "brow", "bcol", "cells")
    return each.withColumn("cells", F.when(F.col("scene_id") == 1, F.col("cells")).otherwise(F.transform("cells", lambda v: F.lit(-9999.0))))


@pytest.mark.parametrize("op", ["artslope", "tpi", "slope", "hlz"])
def test_analytic_job_end_to_end(spark, tmp_path, op):
    tiles, docs = str(tmp_path / "tiles"), str(tmp_path / "docs")
    job = jobs.run_analytic(spark, BODY % op, scene_table(spark), scene_blocks(spark), LAY, tiles, docs, end_zoom=8, clip=True)
    assert job == "job-1"
    stored = spark.read.parquet(tiles)
    levels = [r["z"] for r in stored.select("z").distinct().orderBy("z").collect()]
    assert levels == list(range(8, max(levels) + 1)) and len(levels) > 2
    one = stored.orderBy(F.desc("z")).first()
    again = sinks.read_tile(spark, tiles, "job-1", one["z"], one["x"], one["y"]).collect()
    assert len(again) == 1 and list(again[0]["rgba"]) == list(one["rgba"]) and len(one["rgba"]) == 65536
    assert any(v for v in one["rgba"])
    document = spark.read.json(docs).first()
    assert (document["jobid"], document["jobtype"], document["result"]) == ("job-1", op, "Success")


def test_unknown_operation_raises(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown operation"):
        jobs.run_analytic(spark, BODY % "nothing", scene_table(spark), scene_blocks(spark), LAY, str(tmp_path / "t"), str(tmp_path / "d"))
    with pytest.raises(ValueError):
        jobs.product("nothing", None, LAY)


COVER, COVER_LAY = np.array([[4.0, 11.0], [1.0, 7.0]]), Layout(4326, -77.0, 39.0, 0.01, 0.01, 2, 2, 8)


def rasters(spark, **arrays):
    return {role: (blocks.to_blocks(grid_cells(spark, a), lay), lay) for role, (a, lay) in arrays.items()}


def test_pipelines_store_layers_and_documents(spark, tmp_path):
    bare = np.full((20, 20), 50.0)
    first = bare.copy()
    first[5:8, 5:8] += 12.0
    first[1, 1] += 0.5
    lay = Layout(4326, -77.0, 39.0, 0.001, 0.001, 20, 20, 8)
    inputs = rasters(spark, bareearth=(bare, lay), firstreturn=(first, lay), dem=(bare, lay), landcover=(COVER, COVER_LAY))
    body = '{"type": "pipeline", "properties": {"op": "%s", "jobid": "p"}}'
    root, docs = str(tmp_path / "layers"), str(tmp_path / "docs")
    for op in ("buildobs", "buildhover", "buildobslc"):
        jobs.run_pipeline(spark, body % op, inputs, root, docs)
    label = scenes.resolution_label(lay)
    assert label == "100M"
    noobs = as_array(scenes.read_layer(spark, root, "noobs", lay, label), (20, 20))
    want = bare.copy()
    want[5:8, 5:8] = np.nan
    np.testing.assert_allclose(noobs, want)
    hover = as_array(scenes.read_layer(spark, root, "hover", lay), (20, 20))
    np.testing.assert_allclose(hover, np.where(first - bare > 1, first - bare, 0))
    lc = as_array(scenes.read_layer(spark, root, "lcnoobs", lay), (20, 20))
    assert (lc[:10, :10] == 50).all() and (lc[:10, 10:] == 0).all() and (lc[10:, :10] == 0).all() and (lc[10:, 10:] == 50).all()
    assert {r["type"] for r in spark.read.json(docs).collect()} == {"noobs", "bareearth", "firstreturn", "hover", "lcnoobs"}
    with pytest.raises(ValueError):
        jobs.run_pipeline(spark, body % "buildnothing", inputs, root, docs)
    with pytest.raises(ValueError):
        jobs.run_pipeline(spark, body % "buildobs", {"bareearth": inputs["bareearth"]}, root, docs)


def test_upload_brings_scenes_to_lonlat(spark, tmp_path):
    lay = Layout(3857, -8654000.0, 4710000.0, 200.0, 200.0, 24, 24, 8)
    stored = blocks.to_blocks(grid_cells(spark, np.full((24, 24), 9.0)), lay)
    document, target = scenes.upload(stored, lay, "bareearth", str(tmp_path / "up"))
    row = document.first()
    assert target.crs == 4326 and row["type"] == "bareearth" and row["resolution"].endswith("M")
    assert row["uri"].startswith("hdfs://bareearth/100M/")
    cells = scenes.read_layer(spark, str(tmp_path / "up"), "bareearth", target)
    assert cells.where("abs(value - 9) > 1e-9").count() == 0 and cells.count() > 400


def test_scene_files_by_uri(spark, tmp_path):
    path = str(tmp_path / "scene")
    grid_cells(spark, np.ones((3, 3))).write.parquet(path)
    back = scenes.read_cells(spark, [path])
    assert back.count() == 9 and back.where("uri LIKE '%scene%'").count() == 9
    with pytest.raises(ValueError):
        scenes.read_cells(spark, [])
    files = catalog.inventory(spark, path, "*.parquet").collect()
    assert files and all(r["path"].endswith(".parquet") and r["length"] > 0 for r in files)


def test_uri_split_reads_the_scheme_only(spark):
    uris = ["s3://b/k/x.tif", "s3a://b/k", "hdfs://p/s3/x.tif", "file:///x", "hdfs://hdfs-s3"]
    bucket, key = text.split_uri(F.col("u"))
    got = spark.createDataFrame([(u,) for u in uris], "u string").select(bucket, key).collect()
    assert [tuple(r) for r in got] == [("b", "k/x.tif"), ("b", "k"), ("hdfs", "p/s3/x.tif"), ("empty", "empty"), ("hdfs", "hdfs-s3")]


def test_request_properties(spark):
    body = '{"type": "t", "properties": {"n": "4", "bad": "x"}}'
    parsed = requests.parse(spark.createDataFrame([(body,)], "body string"))
    row = parsed.select(
        requests.number_property("n", 1).alias("n"),
        requests.number_property("m", 7).alias("m"),
        requests.integer_property("n", 1).alias("i"),
        requests.text_property("zz").alias("t"),
        requests.is_pipeline().alias("p"),
    ).first()
    assert tuple(row) == (4.0, 7.0, 4, "", True)
    with pytest.raises(Exception):
        parsed.select(requests.number_property("bad", 1)).collect()
    with pytest.raises(Exception):
        requests.parse(spark.createDataFrame([("{nonsense",)], "body string")).collect()


def test_site_request_from_lists(spark):
    craft = lambda d, t: {"diameter": d, "approach": "6", "dimension": "16", "degrees": "Degrees", "obstacleRatio": "10", "type": t}
    rows = [(1, [craft("50", "a"), craft("125", "b"), craft("125", "c")])]
    schema = "request_id long, helicopters array<struct<diameter string, approach string, dimension string, degrees string, obstacleRatio string, type string>>"
    spread = requests.aircraft_of(spark.createDataFrame(rows, schema))
    row = requests.site_parameters(spread, F.col("pos")).first()
    assert row["largest"]["kind"] == "c" and row["total"] == 300.0 + 3 * 35
    assert row["properties"]["obstacleRatio"] == "10" and row["properties"]["diameter"] == "25"


def test_overlap_join_finds_every_pair_once(spark):
    rng = np.random.default_rng(2)

    def boxes(n, widest):
        x, y = rng.random(n) * 10 - 5, rng.random(n) * 10 - 5
        w = rng.random((n, 2)) * widest
        return [(i, float(x[i]), float(y[i]), float(x[i] + w[i, 0]), float(y[i] + w[i, 1])) for i in range(n)]

    a, b = boxes(60, 1.0), boxes(80, 4.0) + [(100, -5.0, -5.0, 5.0, 5.0)]
    names = ", ".join(f"{c} double" for c in joins.BOX)
    left = spark.createDataFrame(a, "rid long, " + names)
    right = spark.createDataFrame(b, "sid long, " + names)
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    for size in (0.05, 0.5, 20.0):
        got = sorted(tuple(r) for r in joins.overlap_join(left, right, "rid", "sid", size).collect())
        assert got == want
    assert not joins.overlap_join(left.limit(0), right, "rid", "sid", 0.5).count()


def test_large_and_small_boxes_on_both_sides(spark):
    """Sizes over eight orders, points, and boxes that touch."""
    rng = np.random.default_rng(4)

    def boxes(n, shift):
        w = 10.0 ** rng.uniform(-6, 2, n) * (rng.random(n) > 0.1)
        x, y = rng.random(n) * 4 - 2, rng.random(n) * 4 - 2
        every = [(i + shift, float(x[i]), float(y[i]), float(x[i] + w[i]), float(y[i] + w[i] / 2)) for i in range(n)]
        return every + [(900 + shift, -180.0, -90.0, 180.0, 90.0), (901 + shift, 0.0, 0.0, 1.0, 1.0), (902 + shift, 1.0, 1.0, 2.0, 2.0)]

    a, b = boxes(70, 0), boxes(90, 1000)
    names = ", ".join(f"{c} double" for c in joins.BOX)
    left, right = spark.createDataFrame(a, "rid long, " + names), spark.createDataFrame(b, "sid long, " + names)
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    assert sorted(tuple(r) for r in joins.overlap_join(left, right, "rid", "sid", 0.01).collect()) == want
    world = joins._buckets(left.withColumn("own_", joins._level(0.01)).where("rid = 900"), list(range(40)), 0.01, 1)
    assert world.count() <= 4 * 40
    fine = joins._buckets(left.withColumn("own_", joins._level(0.01)), [16], 0.01, 1)
    assert fine.groupBy("rid").count().agg(F.max("count")).first()[0] <= 12


def test_colours(spark):
    assert colour.rgba(1, 2, 3, 4) == 0x01020304
    frame = spark.createDataFrame([(0.0,), (3.0,), (100.0,), (121.0,), (None,), (0.5,)], "value double")
    got = [r["rgba"] for r in render.colorize(frame, "hlz").collect()]
    assert got == [0xFFFFFF00, 0x00FF0000, 0xFFFF667F, None, None, 0xFFFF6600]
    packed = frame.limit(1).select(colour.channels(colour.pack(*[F.lit(v) for v in (9, 8, 7, 6)])).alias("c")).first()["c"]
    assert tuple(packed) == (9, 8, 7, 6)
    with pytest.raises(ValueError):
        render.colorize(frame, "none")


def test_combined_removal_flags(spark):
    bare = grid_cells(spark, np.ones((4, 4)))
    lay = Layout(3857, 0, 0, 1, 1, 4, 4, 4)
    cells, flags = layers.combined_removal(bare, lay)
    assert cells.count() == 16 and flags["landcoverincluded"] is False
    row = layers.flags_row(spark, flags).first()
    assert row["result"] == "true" and row["firstreturnincluded"] == "false"


def test_center_viewshed(spark):
    lay = Layout(3857, 0, 0, 1, 1, 9, 9, 4)
    assert jobs.center_viewshed(grid_cells(spark, np.zeros((9, 9))), lay, "a", 3).where("visible = 1").count() == 29


def test_only_the_scenes_found_are_read(spark, tmp_path):
    """The search's scenes prune the folders of the scan, also inside a job."""
    root, catalog_path = str(tmp_path / "scenes"), str(tmp_path / "catalog")
    scenes.write_scenes(scene_blocks(spark), root)
    scene_table(spark).write.parquet(catalog_path)
    table = spark.read.parquet(catalog_path)
    chosen = catalog.job_scenes(table, "sources", -77.0, 38.98, -76.98, 39.0)
    found = scenes.of_scenes(scenes.read_scenes(spark, root), chosen)
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in shown[shown.index("PartitionFilters") :]
    assert {r["scene_id"] for r in found.collect()} == {1} and found.count() == 9
    scenes.write_scenes(scene_blocks(spark).where("scene_id = 1"), root)  # again: its own folder only
    assert scenes.read_scenes(spark, root).count() == 4 * 9
    tiles = [str(tmp_path / f"t{k}") for k in (0, 1)]
    jobs.run_analytic(spark, BODY % "slope", table, scenes.read_scenes(spark, root), LAY, tiles[0], str(tmp_path / "d0"), end_zoom=14, clip=True)
    jobs.run_analytic(spark, BODY % "slope", scene_table(spark), scene_blocks(spark), LAY, tiles[1], str(tmp_path / "d1"), end_zoom=14, clip=True)
    bag = [sorted((r["z"], r["x"], r["y"], tuple(r["rgba"])) for r in spark.read.parquet(t).collect()) for t in tiles]
    assert bag[0] == bag[1] and bag[0]


def test_a_large_list_of_scenes_meets_them_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(scenes, "SENT_SCENES", 1)
    found = scenes.of_scenes(scene_blocks(spark), spark.createDataFrame([(1,), (3,), (9,)], "scene_id long"))
    assert {r["scene_id"] for r in found.collect()} == {1, 3}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_catalog_round_trip_and_second_run(spark, tmp_path):
    """Write, search, read by the URI found; a second run changes nothing."""
    root, docs = str(tmp_path / "layers"), str(tmp_path / "docs")
    lay = Layout(4326, -77.0, 39.0, 0.001, 0.001, 20, 20, 8)
    rng = np.random.default_rng(1)
    bare = rng.integers(0, 50, (20, 20)).astype(float)
    body = '{"type": "pipeline", "properties": {"op": "%s", "jobid": "%s", "type": "bareearth"}}'
    inputs = rasters(spark, upload=(bare, lay))

    def state():
        layer_rows = spark.read.parquet(root).select("type", "resolution", "filename", "brow", "bcol", F.sha2(F.to_json("cells"), 256))
        return sorted(map(tuple, layer_rows.collect())), sorted(r["uri"] for r in spark.read.json(docs).collect())

    jobs.run_pipeline(spark, body % ("upload", "a"), inputs, root, docs)
    first = state()
    jobs.run_pipeline(spark, body % ("upload", "a"), inputs, root, docs)
    assert state() == first and len(first[1]) == 1
    jobs.run_pipeline(spark, body % ("upload", "b"), inputs, root, docs)  # another job's layer stands beside it
    assert len(state()[1]) == 2
    box = F.regexp_extract_all(F.col("bbox")["@WKT"], F.lit(r"(-?[0-9.]+)"), F.lit(1)).cast("array<double>")
    table = spark.read.json(docs).select("type", "uri", F.array_min(F.filter(box, lambda v: v < 0)).alias("xmin"), F.lit(-76.98).alias("xmax"), F.lit(38.98).alias("ymin"), F.lit(39.0).alias("ymax"))
    uris = [r["uri"] for r in catalog.job_scenes(table, "bareearth", -77.0, 38.9, -76.9, 39.0).collect()]
    assert len(uris) == 2 and all(u.startswith("hdfs://bareearth/100M/") for u in uris)
    for uri in uris:
        back, found = scenes.open_layer(spark, root, uri)
        assert found == lay
        np.testing.assert_array_equal(as_array(blocks.to_cells(back, found), (20, 20)), bare)
    shown = scenes.open_layer(spark, root, uris[0])[0]._jdf.queryExecution().executedPlan().toString()
    assert "filename" in shown[shown.index("PartitionFilters") : shown.index("PushedFilters")]
    # a pipeline that reads its inputs by URI
    done = jobs.run_pipeline(spark, body % ("buildhover", "c"), {"bareearth": uris[0], "firstreturn": uris[1]}, root, docs)
    blocks_, found = scenes.open_layer(spark, root, done.documents[0].first()["uri"])
    assert set(as_array(blocks.to_cells(blocks_, found), (20, 20)).ravel()) == {0.0}
    for wrong in ("s3://b/k", "hdfs://a/b", "hdfs://bareearth/100M/none.tif"):
        with pytest.raises(ValueError):
            scenes.open_layer(spark, root, wrong)


@pytest.mark.parametrize("have", [(), ("firstreturn",), ("landcover",), ("firstreturn", "landcover")])
def test_combined_removal_job_with_each_input_absent(spark, tmp_path, have):
    bare = np.full((20, 20), 50.0)
    first = bare.copy()
    first[5:8, 5:8] += 12.0
    lay = Layout(4326, -77.0, 39.0, 0.001, 0.001, 20, 20, 8)
    every = rasters(spark, bareearth=(bare, lay), firstreturn=(first, lay), landcover=(COVER, COVER_LAY))
    inputs = {k: v for k, v in every.items() if k == "bareearth" or k in have}
    body = '{"type": "pipeline", "properties": {"op": "buildcombined", "jobid": "p"}}'
    root, docs = str(tmp_path / "layers"), str(tmp_path / "docs")
    done = jobs.run_pipeline(spark, body, inputs, root, docs)
    flags = done.flags.first()
    assert flags["result"] == "true" and flags["bareearthstored"] == "true"
    assert (flags["firstreturnincluded"], flags["landcoverincluded"]) == tuple(str(k in have).lower() for k in ("firstreturn", "landcover"))
    want = np.where(first > bare + 1, np.nan, bare) if "firstreturn" in have else bare.copy()
    if "landcover" in have:
        want[:10, 10:] = want[10:, :10] = np.nan
    got = as_array(scenes.read_layer(spark, root, "combined", lay), (20, 20))
    np.testing.assert_array_equal(got, want)
    assert {r["type"] for r in spark.read.json(docs).collect()} == {"combined", "bareearth"} | ({"firstreturn"} & set(have))
    with pytest.raises(ValueError):
        jobs.run_pipeline(spark, body, {}, root, docs)


@pytest.mark.parametrize("z, x, y", [(5, 1, 0), (4, 0, 1), (3, 0, 0), (1, 0, 0)])
def test_tiles_on_demand_equal_the_pyramid(spark, tmp_path, z, x, y):
    rng = np.random.default_rng(3)
    a = np.where(rng.random((60, 50)) < 0.2, np.nan, rng.integers(0, 256, (60, 50)).astype(float))
    lay = Layout(3857, 0, 0, 1, 1, 50, 60, 8)
    path = str(tmp_path / "base")
    blocks.to_blocks(grid_cells(spark, a), lay).sortWithinPartitions("brow", "bcol").write.parquet(path)
    base = spark.read.parquet(path)
    one = render.tile_on_demand(base, "hover", 8, 5, z, x, y)
    whole = render.block_tiles(render.paint_blocks(reshape.pyramid_blocks(base, 8, 5, 0), "hover"), "")
    want = [list(r["rgba"]) for r in whole.where(f"z = {z} AND x = {x} AND y = {y}").collect()]
    shown = one._jdf.queryExecution().executedPlan().toString()
    assert [list(r["rgba"]) for r in one.collect()] == want and len(want) == 1
    pushed = shown[shown.index("PushedFilters") :]
    assert f"GreaterThanOrEqual(brow,{y << (5 - z)})" in pushed and "IsNotNull(bcol)" in pushed
    assert shown.count("FlatMapGroupsInArrow") == -(-(5 - z) // 3)  # one step for each three levels, not one for each


def test_stored_plans_reject_unknown_masks(spark):
    with pytest.raises(ValueError):
        stored_plans.cover_filtered(None, LAY, None, LAY, mask="other")


def test_documents_are_parsed_once(spark):
    table = scene_table(spark).withColumns({c: F.lit("x") for c in ("dataset", "directory", "location", "filetype", "filename", "resolution")})
    found = catalog.match_documents(catalog.envelopes(table), "type", "HOVER")
    assert [tuple(r) for r in found.collect()] == [(3, "hdfs://hover/c.tif", "hdfs", "hover/c.tif")]
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("from_json") == 2  # the envelope, and the document in it
