"""SQL over the same tables, written as independent formulas (offset joins, not kernels)."""

from __future__ import annotations

from ridgeline.functions.colour import RAMPS, RUNS
from ridgeline.operators.local import LAND_COVER

ORACLE = {}

# Shared subqueries. Cells are (r, c, z).
COMMON = {
    "size": "SELECT count(*) AS n FROM embeddings",
    "dem": """SELECT vec_id AS r, unnest(range(0, 64)) AS c, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) + 1000 AS z
        FROM embeddings""",
    "gaps": "SELECT r, c, z FROM dem WHERE (r * 13 + c * 29) % 11 <> 0",
    "fr": """SELECT r, c, z + CASE WHEN (r * 31 + c * 17) % 7 = 0 THEN (r + c) % 40 ELSE 0 END AS z FROM dem""",
    "lc": """SELECT DISTINCT r // 4 AS r, c // 4 AS c, CAST(1 + ((r // 4) * 7 + (c // 4) * 3) % 15 AS INTEGER) AS cls FROM dem""",
    "sparse": """SELECT l_partkey AS r, l_suppkey AS c, min(CAST(floor(l_extendedprice) AS BIGINT)) AS z
        FROM lineitem GROUP BY ALL""",
    "scenes": """SELECT s_suppkey AS scene_id,
          ['sources', 'noobs', 'lcnoobs', 'hover'][s_suppkey % 4 + 1] AS type,
          CASE WHEN s_suppkey % 2 = 0 THEN 's3://scenes/' ELSE 'hdfs://' END
            || ['sources', 'noobs', 'lcnoobs', 'hover'][s_suppkey % 4 + 1] || '/10M/scene_' || s_suppkey
            || CASE WHEN s_suppkey % 9 = 0 THEN '_wgs84' ELSE '' END
            || CASE WHEN s_suppkey % 5 = 0 THEN '.TIF' ELSE '.tif' END AS uri,
          CAST(-78000000 + (s_suppkey % 10) * 90000 AS DOUBLE) / 1e6 AS xmin,
          CAST(36000000 + ((s_suppkey * 7) % 13) * 70000 AS DOUBLE) / 1e6 AS ymin,
          CAST(-78000000 + (s_suppkey % 10) * 90000 + 100000 AS DOUBLE) / 1e6 AS xmax,
          CAST(36000000 + ((s_suppkey * 7) % 13) * 70000 + 100000 AS DOUBLE) / 1e6 AS ymax
        FROM supplier""",
    "boxes": """SELECT c_custkey AS request_id,
          CAST(-78000000 + ((c_custkey * 37) % 1000) * 900 AS DOUBLE) / 1e6 AS xmin,
          CAST(36000000 + ((c_custkey * 53) % 1000) * 900 AS DOUBLE) / 1e6 AS ymin,
          CAST(-78000000 + ((c_custkey * 37) % 1000) * 900 + 20000 AS DOUBLE) / 1e6 AS xmax,
          CAST(36000000 + ((c_custkey * 53) % 1000) * 900 + 20000 AS DOUBLE) / 1e6 AS ymax
        FROM customer""",
    "points": "SELECT c_custkey AS id, (c_custkey * 11) % n AS r, (c_custkey * 7) % 64 AS c FROM customer, size",
}
NEEDS = {"gaps": ["dem"], "fr": ["dem"], "lc": ["dem"], "points": ["size"]}


def sql(body: str, *names: str, recursive: bool = False, **extra: str) -> str:
    """A query with the shared subqueries it names, then its own."""
    order: list[str] = []

    def add(name):
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    # Materialized, so that no planner merges the cross products of two of them.
    parts = [f"{n} AS MATERIALIZED ({COMMON[n]})" for n in order] + [f"{n} AS {'MATERIALIZED ' if n in ('st', 'tg', 'cl', 'look') or n[0] == 'h' and n[1:].isdigit() else ''}({q})" for n, q in extra.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def r4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def offsets(n: int) -> str:
    return f"(SELECT dr, dc FROM range({-n}, {n + 1}) a(dr), range({-n}, {n + 1}) b(dc))"


def square(source: str, n: int) -> str:
    return f"""SELECT s.r + dr AS r, s.c + dc AS c, min(z) AS lo, max(z) AS hi, CAST(sum(z) AS DOUBLE) AS total, count(*) AS k
        FROM {source} s, {offsets(n)}, size
        WHERE z IS NOT NULL AND s.r + dr BETWEEN 0 AND size.n - 1 AND s.c + dc BETWEEN 0 AND 63 GROUP BY 1, 2"""


def near(source: str) -> str:
    """The nine values around each known cell, a missing one replaced by the centre."""
    at = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
    pick = ", ".join(f"max(CASE WHEN dr = {a} AND dc = {b} THEN z END) AS {k}" for k, (a, b) in at.items())
    fill = ", ".join(f"coalesce({k}, z0) AS {k}" for k in at)
    return f"""SELECT r, c, z0, {fill} FROM (
          SELECT s.r - dr AS r, s.c - dc AS c, max(CASE WHEN dr = 0 AND dc = 0 THEN z END) AS z0, {pick}
          FROM {source} s, {offsets(1)} WHERE z IS NOT NULL GROUP BY 1, 2) WHERE z0 IS NOT NULL"""


def horn(source: str) -> str:
    return f"""SELECT r, c, (ne + 2 * e + se) - (nw + 2 * w + sw) AS east, (sw + 2 * s + se) - (nw + 2 * n + ne) AS south
        FROM ({near(source)})"""


def slope(horned: str, cell: float = 200.0) -> str:
    g = 8 * cell
    return f"SELECT r, c, degrees(atan(sqrt((east / {g}) * (east / {g}) + (south / {g}) * (south / {g})))) AS v FROM {horned}"


def aspect(cell: float = 200.0) -> str:
    g = 8 * cell
    a = f"degrees(atan2(-(east / {g}), south / {g}))"
    return f"CASE WHEN east <> 0 OR south <> 0 THEN CASE WHEN {a} < 0 THEN {a} + 360 ELSE {a} END END"


def shade(cell: float = 200.0) -> str:
    g = 8 * cell
    steep = f"atan(sqrt((east / {g}) * (east / {g}) + (south / {g}) * (south / {g})))"
    lit = (
        f"sin(radians(40)) * cos({steep}) + cos(radians(40)) * sin({steep}) "
        f"* cos(radians(90) - atan2(-(east / {g}), south / {g}))"
    )
    light = f"CASE WHEN east = 0 AND south = 0 THEN sin(radians(40)) ELSE {lit} END"
    return f"CAST(floor(127 * greatest(0, {light}) + 0.5) AS INTEGER)"


def colour(value: str, ramp: str) -> str:
    cases = " ".join(f"WHEN {value} <= {b!r} THEN {c}" for b, c in sorted(RAMPS[ramp]))
    return f"CAST(CASE {cases} END AS BIGINT)"


def breaks(source: str, k: int = 10) -> str:
    """i, brk of the values z of a subquery."""
    return f"""SELECT i, min(z) AS brk FROM (
          SELECT z, sum(n) OVER (ORDER BY z) AS cum, sum(n) OVER () AS total
          FROM (SELECT z, count(*) AS n FROM {source} WHERE z IS NOT NULL GROUP BY z)), range(1, {k + 1}) t(i)
        WHERE cum * {k} >= i * total GROUP BY i"""


MAP_X = "(CAST(-8654000 AS DOUBLE) + (c + CAST(0.5 AS DOUBLE)) * CAST(200 AS DOUBLE))"
MAP_Y = "(CAST(4710000 AS DOUBLE) - (r + CAST(0.5 AS DOUBLE)) * CAST(200 AS DOUBLE))"
GAPS_SLOPE = {"h": horn("gaps"), "sl": slope("h"), "s4": f"SELECT r, c, {r4('v')} AS v FROM sl"}
OUT = 'SELECT r AS "row", c AS col, '

# Sources
BOXED = "xmin <= -77.3 AND xmax >= -77.6 AND ymin <= 36.6 AND ymax >= 36.2"
ORACLE["s1_scene_box_search"] = sql(f"SELECT scene_id, type, uri FROM scenes WHERE type = 'sources' AND {BOXED}", "scenes")
ORACLE["s4_job_scenes"] = sql(
    f"SELECT scene_id, uri FROM scenes WHERE type = 'noobs' AND {BOXED} AND uri NOT LIKE '%wgs84%'", "scenes"
)


def haversine(x1: str, y1: str, x2: str, y2: str) -> str:
    a = (
        f"(sin(radians({y2} - {y1}) / 2) * sin(radians({y2} - {y1}) / 2) + cos(radians({y1})) * cos(radians({y2}))"
        f" * sin(radians({x2} - {x1}) / 2) * sin(radians({x2} - {x1}) / 2))"
    )
    return f"(6371.0 * (2 * atan2(sqrt({a}), sqrt(1 - {a}))) * 1000)"


def radius_search(lon: str, lat: str, metres: str) -> str:
    far = haversine(lon, lat, "((xmin + xmax) / 2)", "((ymin + ymax) / 2)")
    return sql(f"SELECT scene_id, {r4('m')} AS metres FROM (SELECT scene_id, {far} AS m FROM scenes) WHERE m <= {metres}", "scenes")


ORACLE["s2_scene_radius_search"] = radius_search("-77.5", "36.4", "40000.0")
ORACLE["s3_box_to_radius_search"] = radius_search("-77.45", "36.4", "sqrt(0.15 * 0.15 + 0.2 * 0.2) * 110996.45")
SPLIT = """CASE WHEN uri LIKE 's3://%' THEN split_part(uri, '/', 3) ELSE 'hdfs' END AS bucket,
    CASE WHEN uri LIKE 's3://%' THEN substr(uri, length('s3://') + length(split_part(uri, '/', 3)) + 2) ELSE substr(uri, 8) END AS key"""
ORACLE["s5_document_match"] = sql(f"SELECT scene_id, uri, {SPLIT} FROM scenes WHERE type = 'noobs'", "scenes")
ORACLE["s6_uri_split"] = sql(
    f"SELECT scene_id, {SPLIT}, replace(replace(split_part(uri, '/', -1), '.tif', ''), '.TIF', '') AS stem FROM scenes", "scenes"
)
ORACLE["s7_scene_files"] = sql("SELECT type, count(*) AS n FROM scenes WHERE uri ILIKE '%.tif%' GROUP BY type", "scenes")
ORACLE["s11_missing_scenes"] = sql(
    "SELECT scene_id FROM scenes WHERE scene_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)", "scenes"
)
ORACLE["s11_present_scenes"] = sql(
    "SELECT scene_id FROM scenes WHERE scene_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)", "scenes"
)
ORACLE["s12_load_scenes"] = sql(
    """SELECT l_suppkey AS scene_id, count(*) AS n, min(CAST(floor(l_extendedprice) AS BIGINT)) AS zmin,
        max(CAST(floor(l_extendedprice) AS BIGINT)) AS zmax FROM lineitem
      WHERE l_suppkey IN (SELECT scene_id FROM scenes WHERE type = 'hover' AND uri NOT LIKE '%wgs84%'
        AND xmin <= -77.0 AND xmax >= -78.0 AND ymin <= 37.0 AND ymax >= 36.0) GROUP BY 1""",
    "scenes",
)


def wkt(x0: str, y0: str, x1: str, y1: str) -> str:
    pts = [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
    return "'POLYGON ((' || " + " || ',' || ".join(f"printf('%.6f', {x}) || ' ' || printf('%.6f', {y})" for x, y in pts) + " || '))'"


ORACLE["s15_job_documents"] = sql(
    f"""SELECT 'job-' || request_id AS jobid,
        CASE WHEN request_id % 4 = 0 THEN 'Unknown' ELSE '10M' END AS resolution,
        CASE WHEN request_id % 4 = 0 THEN 'Unknown' ELSE {wkt('xmin', 'ymin', 'xmax', 'ymax')} END AS wkt,
        CASE WHEN request_id % 4 = 0 THEN 'Unknown' ELSE '/api/catalog/tile/for/job-' || request_id END AS url,
        'Success' AS result FROM boxes""",
    "boxes",
)
LON = "degrees(({}) / 6378137.0)"
LAT = "degrees(2.0 * atan(exp(({}) / 6378137.0)) - pi() / 2)"
ORACLE["s16_layer_documents"] = sql(
    f"""SELECT layer, 'sources' AS type, label AS resolution, 'hdfs://sources/' || label || '/' || layer || '.tif' AS uri,
        {wkt('west', 'south', 'east', 'north')} AS wkt FROM labelled""",
    "dem",
    "sparse",
    parts="SELECT 'dem' AS layer, r, c FROM dem UNION ALL SELECT 'sparse', r, c FROM sparse",
    sized="SELECT layer, max(r) + 1 AS nr, max(c) + 1 AS nc FROM parts GROUP BY layer",
    cornered=f"""SELECT layer, nr, {LON.format('-8654000.0')} AS west, {LAT.format('4710000.0')} AS north,
        {LON.format('-8654000.0 + nc * 200.0')} AS east, {LAT.format('4710000.0 - nr * 200.0')} AS south FROM sized""",
    metred=f"SELECT *, {haversine('west', 'north', 'west', 'south')} / nr AS m FROM cornered",
    labelled="""SELECT *, CASE WHEN m >= 100 THEN CAST(CAST(floor(m / 100) * 100 AS BIGINT) AS VARCHAR) || 'M'
        WHEN m >= 10 THEN CAST(CAST(floor(m / 10) * 10 AS BIGINT) AS VARCHAR) || 'M'
        WHEN m >= 1 THEN CAST(CAST(floor(m) AS BIGINT) AS VARCHAR) || 'M'
        ELSE CAST(CAST(floor(m * 10) * 10 AS BIGINT) AS VARCHAR) || 'cm' END AS label FROM metred""",
)


def pyramid_levels(source: str, top: int, end: int, last: bool = True) -> dict[str, str]:
    """One subquery per zoom level; each takes the first known child in row-major order."""
    levels = {f"p{top}": f"SELECT r, c, z FROM {source} WHERE z IS NOT NULL"}
    for zoom in range(top - 1, end - 1, -1):
        levels[f"p{zoom}"] = f"SELECT r // 2 AS r, c // 2 AS c, arg_min(z, r * 1000000 + c) AS z FROM p{zoom + 1} GROUP BY 1, 2"
    return levels


def all_levels(top: int, end: int) -> str:
    return " UNION ALL ".join(f"SELECT CAST({z} AS INTEGER) AS zoom, r, c, z FROM p{z}" for z in range(top, end - 1, -1))


RED = "CASE WHEN z <= 0 THEN 255 WHEN z <= 255 THEN CAST(z AS BIGINT) * 16777216 + 255 END"
ORACLE["s17_picture_tiles"] = sql(
    f"""SELECT zoom AS z, c // 16 AS x, r // 16 AS y, count(*) AS n, CAST(sum({RED}) AS BIGINT) AS total
      FROM ({all_levels(5, 2)}) WHERE {RED} IS NOT NULL GROUP BY ALL""",
    "dem",
    low="SELECT r, c, z - 900 AS z FROM dem",
    **pyramid_levels("low", 5, 2),
)
ORACLE["s19_request_params"] = sql(
    """SELECT 'job-' || request_id AS jobid, CASE WHEN request_id % 2 = 0 THEN 'tpi' ELSE 'slope' END AS op,
        CAST(CASE WHEN request_id % 7 = 0 OR request_id % 3 = 0 THEN 3 ELSE request_id % 5 + 1 END AS DOUBLE) AS cellsize,
        CAST(request_id % 7 = 0 AS INTEGER) AS pipeline,
        CASE WHEN request_id % 7 <> 0 THEN xmin END AS west, CASE WHEN request_id % 7 <> 0 THEN ymin END AS south,
        CASE WHEN request_id % 7 <> 0 THEN xmax END AS east, CASE WHEN request_id % 7 <> 0 THEN ymax END AS north
      FROM boxes""",
    "boxes",
)
ORACLE["s20_request_rings"] = sql(
    """SELECT request_id, CAST(p AS INTEGER) AS pos, CASE WHEN p IN (1, 2) THEN xmax ELSE xmin END AS lon,
        CASE WHEN p IN (2, 3) THEN ymax ELSE ymin END AS lat FROM boxes, range(0, 5) t(p)""",
    "boxes",
)
ORACLE["j2_requests_x_scenes"] = sql(
    """SELECT request_id, scene_id FROM boxes b JOIN scenes s
      ON b.xmin <= s.xmax AND b.xmax >= s.xmin AND b.ymin <= s.ymax AND b.ymax >= s.ymin""",
    "boxes",
    "scenes",
)

# Local algebra
ORACLE["p2_slope_class"] = sql(OUT + "CAST(v > 0 AND v < 15 AS INTEGER) AS v FROM s4", "gaps", **GAPS_SLOPE)
ORACLE["p3_ring_class"] = sql(
    OUT + "CASE WHEN v >= 30 THEN 3 WHEN v >= 20 THEN 2 WHEN v >= 10 THEN 1 ELSE 0 END AS v FROM s4", "gaps", **GAPS_SLOPE
)
PAIR = "FROM dem a JOIN fr b USING (r, c)"
ORACLE["p4_difference"] = sql(OUT + f"b.z - a.z AS v {PAIR}", "dem", "fr")
ORACLE["p5_product"] = sql(OUT + "a.z * b.z AS v FROM gaps a JOIN fr b USING (r, c)", "gaps", "fr")
ORACLE["p6_ratio"] = sql(
    OUT + f"CASE WHEN a.z <> 1000 THEN {r4('CAST(b.z AS DOUBLE) / CAST(a.z - 1000 AS DOUBLE)')} END AS v {PAIR}", "dem", "fr"
)
ORACLE["p7_abs"] = sql(OUT + "abs(z - 1000) AS v FROM dem", "dem")
ORACLE["p8_sqrt"] = sql(OUT + f"CASE WHEN z >= 1000 THEN {r4('sqrt(greatest(z - 1000, 0))')} END AS v FROM dem", "dem")
ORACLE["p9_equal"] = sql(OUT + f"CAST(a.z = b.z AS INTEGER) AS v {PAIR}", "dem", "fr")
ORACLE["p10_local_if"] = sql(OUT + f"CASE WHEN b.z > a.z + 10 THEN -1 ELSE a.z END AS v {PAIR}", "dem", "fr")
ORACLE["p11_suitable_mask"] = sql(OUT + "CAST(cls IN (4, 5, 7, 8) AS INTEGER) AS v FROM lc", "lc")
ORACLE["p12_water_mask"] = sql(OUT + "CAST(cls NOT IN (9, 10, 11, 14) AS INTEGER) AS v FROM lc", "lc")
LEGEND = " UNION ALL ".join(f"SELECT {k} AS cls, '{t}' AS title" for k, t in LAND_COVER.items())
ORACLE["p11_legend_report"] = sql(
    """SELECT cls, title, CAST(cls IN (4, 5, 7, 8) AS INTEGER) AS suitable, CAST(cls NOT IN (9, 10, 11, 14) AS INTEGER) AS dry,
        count(*) AS n FROM lc JOIN legend USING (cls) GROUP BY ALL""",
    "lc",
    legend=LEGEND,
)
ORACLE["p13_keep_class"] = sql(OUT + "CASE WHEN cls = 3 THEN cls END AS v FROM lc", "lc")
ORACLE["p13_keep_positive"] = sql(OUT + "CASE WHEN z > 1000 THEN z - 1000 END AS v FROM dem", "dem")
ORACLE["p14_cell_to_map"] = sql(
    f"""SELECT r AS "row", c AS col, {MAP_X} AS x, {MAP_Y} AS y, r AS row2, c AS col2 FROM dem""", "dem"
)
ORACLE["p16_identity"] = sql(OUT + "z AS v FROM gaps", "gaps")
ORACLE["p17_colorize"] = sql(
    f"SELECT CAST({RED} AS BIGINT) AS rgba, count(*) AS n FROM (SELECT z - 900 AS z FROM dem) GROUP BY 1", "dem"
)
ORACLE["p18_ramp_by_op"] = sql(
    f"SELECT {colour('v', 'tpi')} AS rgba, count(*) AS n FROM t GROUP BY 1",
    "gaps",
    "size",
    q=square("gaps", 1),
    t=f"SELECT CASE WHEN hi > lo THEN {r4('(total / k - lo) / (hi - lo)')} END AS v FROM q",
)
RUN = RUNS["green-red-orange"]
ORACLE["p19_quantile_ramp"] = sql(
    f"""SELECT CAST([{', '.join(map(str, RUN))}][(CASE WHEN k = 1 THEN 0 ELSE (below * {len(RUN) - 1}) // (k - 1) END) + 1] AS BIGINT) AS rgba,
        count(*) AS n FROM (
          SELECT (SELECT count(*) FROM d) AS k, (SELECT count(*) FROM d WHERE d.brk < dem.z) AS below FROM dem)
      WHERE below < k GROUP BY 1""",
    "dem",
    b=breaks("dem", len(RUN)),
    d="SELECT DISTINCT brk FROM b",
)

# Focal and surface
SQ2 = {"q": square("gaps", 2)}
ORACLE["f1_focal_min"] = sql(OUT + "lo AS v FROM q", "gaps", "size", **SQ2)
ORACLE["f2_focal_max"] = sql(OUT + "hi AS v FROM q", "gaps", "size", **SQ2)
ORACLE["f3_focal_mean"] = sql(OUT + f"{r4('total / k')} AS v FROM q", "gaps", "size", **SQ2)
ORACLE["f3_focal_mean_window_form"] = ORACLE["f3_focal_mean"]
DISC3 = f"(SELECT dr, dc FROM {offsets(3)} WHERE dr * dr + dc * dc <= 9)"


def disc(source: str) -> str:
    return f"""SELECT s.r + dr AS r, s.c + dc AS c, CAST(sum(z) AS BIGINT) AS z FROM {source} s, {DISC3}, size
        WHERE z IS NOT NULL AND s.r + dr BETWEEN 0 AND size.n - 1 AND s.c + dc BETWEEN 0 AND 63 GROUP BY 1, 2"""


ORACLE["f4_focal_sum_circle"] = sql(OUT + "z AS v FROM q", "gaps", "size", q=disc("gaps"))
ORACLE["f5_slope"] = sql(OUT + "v FROM s4", "gaps", **GAPS_SLOPE)
ORACLE["f5_slope_window_form"] = ORACLE["f5_slope"]
ORACLE["f6_aspect"] = sql(OUT + f"{r4(aspect())} AS v FROM h", "gaps", h=horn("gaps"))
ORACLE["f7_hillshade"] = sql(OUT + f"{shade()} AS v FROM h", "gaps", h=horn("gaps"))
ORACLE["f8_artslope"] = sql(f"SELECT {colour('v', 'artslope')} AS rgba, count(*) AS n FROM s4 GROUP BY 1", "gaps", **GAPS_SLOPE)
ORACLE["f9_horn_gather"] = sql(OUT + "east, south FROM h", "gaps", h=horn("gaps"))

# Composite products
ORACLE["c1_tpi"] = sql(OUT + f"CASE WHEN hi > lo THEN {r4('(total / k - lo) / (hi - lo)')} END AS v FROM q", "gaps", "size", **SQ2)
SQ1 = {"q": square("gaps", 1)}
RATIO = "(total / k - lo) / (CAST(hi AS DOUBLE) / CAST(lo AS DOUBLE))"
ORACLE["c2_tpi_ratio"] = sql(OUT + f"{r4(RATIO)} AS v FROM q", "gaps", "size", **SQ1)
ORACLE["c3_ruggedness"] = sql(OUT + f"{r4('sqrt(CAST(abs(hi * hi - lo * lo) AS DOUBLE))')} AS v FROM q", "gaps", "size", **SQ1)


def site(elevation: str, smooth: bool, mask: str | None = None) -> dict[str, str]:
    """Subqueries from an elevation to scores ``sc`` and classes ``ring``."""
    parts = {}
    base = elevation
    if smooth:
        parts["mq"] = square(elevation, 1)
        parts["mn"] = "SELECT r, c, total / k AS z FROM mq"
        base = "mn"
    parts["h"] = horn(base)
    parts["sl"] = slope("h")
    masked = f"SELECT sl.r, sl.c, v * {mask} AS v FROM sl" if mask else "SELECT r, c, v FROM sl"
    parts["mk"] = masked
    parts["ok"] = f"SELECT r, c, CAST({r4('v')} > 0 AND {r4('v')} < 15 AS INTEGER) AS z FROM mk WHERE v IS NOT NULL"
    parts["sc"] = disc("ok")
    parts["br"] = breaks("sc")
    parts["db"] = "SELECT DISTINCT brk FROM br"
    parts["th"] = """SELECT max(brk) AS b0,
        CASE WHEN count(*) >= 3 THEN (SELECT brk FROM db ORDER BY brk DESC LIMIT 1 OFFSET 1) ELSE max(brk) END AS b1,
        CASE WHEN count(*) >= 3 THEN (SELECT brk FROM db ORDER BY brk DESC LIMIT 1 OFFSET 2) ELSE max(brk) END AS b2 FROM db"""
    parts["ring"] = """SELECT r, c, CAST(CASE WHEN z >= b0 THEN 3 WHEN z >= b1 THEN 2 WHEN z >= b2 THEN 1 ELSE 0 END AS BIGINT) AS z
        FROM sc, th"""
    return parts


def symbols(source: str) -> str:
    """Rings of 3, 2 and 1 cells around the cells of value 3."""
    return f"""SELECT coalesce(a.r, m.r) AS "row", coalesce(a.c, m.c) AS col,
        CAST(CASE WHEN d2 <= 1 THEN 120 WHEN d2 <= 4 THEN 110 WHEN d2 <= 9 THEN 100 ELSE z END AS BIGINT) AS v
      FROM (SELECT * FROM {source} WHERE z IS NOT NULL) a FULL JOIN (
        SELECT s.r + dr AS r, s.c + dc AS c, min(dr * dr + dc * dc) AS d2 FROM {source} s, {DISC3}, size
        WHERE z = 3 AND s.r + dr BETWEEN 0 AND size.n - 1 AND s.c + dc BETWEEN 0 AND 63 GROUP BY 1, 2) m
      ON a.r = m.r AND a.c = m.c"""


ORACLE["c6_suitability"] = sql(symbols("ring"), "gaps", "size", **site("gaps", True))
ORACLE["c4_suitability_cells"] = ORACLE["c6_suitability"]
ORACLE["c6_suitability_classes"] = sql(OUT + "z AS v FROM ring", "gaps", "size", **site("gaps", True))
# The mask belongs to known elevations: only they carry a cover cell here.
WET = """(SELECT CASE WHEN cls IN (9, 10, 11, 14) THEN 0 ELSE 1 END FROM gaps g JOIN lc ON lc.r = g.r // 4 AND lc.c = g.c // 4
    WHERE g.r = sl.r AND g.c = sl.c)"""
ORACLE["c5_suitability_water"] = sql(symbols("ring"), "gaps", "lc", "size", **site("gaps", True, WET))
KEPT = """SELECT d.r, d.c, d.z FROM dem d JOIN lc ON lc.r = d.r // 4 AND lc.c = d.c // 4 WHERE cls IN (4, 5, 7, 8) AND z > 0"""
ORACLE["c7_suitability_masked"] = sql(symbols("ring"), "lc", "size", kept=KEPT, **site("kept", False))
ORACLE["c8_breaks"] = sql(
    f"SELECT brk, (SELECT max(z) FROM sc) AS top, (SELECT {r4('avg(z)')} FROM sc) AS mean FROM db",
    "lc",
    "size",
    kept=KEPT,
    **site("kept", False),
)


def one_file(layer: str, source: str, cell: float) -> str:
    g = 8 * cell
    steep = f"degrees(atan(sqrt((east / {g}) * (east / {g}) + (south / {g}) * (south / {g}))))"
    above = "(total / k - lo)"
    return f"""SELECT '{layer}' AS layer, h.r AS "row", h.c AS col, {r4(steep)} AS slope, {r4(aspect(cell))} AS aspect,
        {shade(cell)} AS hillshade, CASE WHEN hi > lo THEN {r4(above + ' / (hi - lo)')} END AS tpi,
        {r4(above + ' / (CAST(hi AS DOUBLE) / CAST(lo AS DOUBLE))')} AS tpi_ratio
      FROM ({horn(source)}) h JOIN ({square(source, 1)}) q ON h.r = q.r AND h.c = q.c"""


ORACLE["c9_batch"] = sql(
    " UNION ALL ".join([one_file("a.tif", "dem", 200.0), one_file("b.tif", "gaps", 100.0), one_file("c.tif", "fr", 50.0)]),
    "dem",
    "gaps",
    "fr",
    "size",
)

# Derived layers
COVER = "JOIN lc ON lc.r = a.r // 4 AND lc.c = a.c // 4"
ORACLE["l1_noobs"] = sql(OUT + f"CASE WHEN b.z > a.z + 1 THEN NULL ELSE a.z END AS v {PAIR}", "dem", "fr")
ORACLE["l2_lcnoobs"] = sql(
    f"""SELECT a.r AS "row", a.c AS col, CASE WHEN cls IN (4, 5, 7, 8) THEN z ELSE 0 END AS v FROM dem a {COVER}""", "dem", "lc"
)
ORACLE["l3_hover"] = sql(OUT + f"CASE WHEN b.z - a.z > 1 THEN b.z - a.z ELSE 0 END AS v {PAIR}", "dem", "fr")
ORACLE["l4_combined"] = sql(
    f"""SELECT a.r AS "row", a.c AS col, CASE WHEN b.z > a.z + 1 OR cls NOT IN (4, 5, 7, 8) THEN NULL ELSE a.z END AS v
      FROM gaps a JOIN fr b ON a.r = b.r AND a.c = b.c {COVER}""",
    "gaps",
    "fr",
    "lc",
)

# Reshaping: lon/lat grid of 0.002 degrees from (-77.75, 38.95)
TARGET = {
    "ty": """SELECT j, (4710000.0 - 6378137.0 * ln(tan(pi() / 4 + radians(38.95 - 0.002 * (j + 0.5)) / 2))) / 200.0 - 0.5 AS fr
        FROM size, range(0, n * 4) t(j)""",
    "tx": "SELECT i, (6378137.0 * radians(-77.75 + 0.002 * (i + 0.5)) + 8654000.0) / 200.0 - 0.5 AS fc FROM range(0, 100) t(i)",
}
ORACLE["t1_reproject_bilinear"] = sql(
    f"""SELECT j AS "row", i AS col, {r4('sum(w * z) / sum(w)')} AS v FROM wanted JOIN gaps g ON g.r = pr AND g.c = pc
      GROUP BY j, i HAVING sum(w) > 0""",
    "gaps",
    "size",
    **TARGET,
    wanted="""SELECT j, i, CAST(floor(fr) AS BIGINT) + dr AS pr, CAST(floor(fc) AS BIGINT) + dc AS pc,
        (CASE WHEN dr = 0 THEN 1 - (fr - floor(fr)) ELSE fr - floor(fr) END)
          * (CASE WHEN dc = 0 THEN 1 - (fc - floor(fc)) ELSE fc - floor(fc) END) AS w
      FROM ty, tx, range(0, 2) a(dr), range(0, 2) b(dc)""",
)
ORACLE["t1_reproject_nearest"] = sql(
    """SELECT j AS "row", i AS col, z AS v FROM wanted JOIN gaps g ON g.r = pr AND g.c = pc""",
    "gaps",
    "size",
    **TARGET,
    wanted="SELECT j, i, CAST(floor(fr + 0.5) AS BIGINT) AS pr, CAST(floor(fc + 0.5) AS BIGINT) AS pc FROM ty, tx",
)
FIRST = """SELECT l_partkey AS r, l_suppkey AS c,
    arg_min(CAST(floor(l_extendedprice) AS BIGINT), {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice}) AS z
  FROM lineitem GROUP BY 1, 2"""
ORACLE["t3_mosaic"] = sql(OUT + "z AS v FROM f", f=FIRST)
ORACLE["t2_tiles"] = sql(
    "SELECT r // 16 AS trow, c // 16 AS tcol, count(*) AS n, CAST(sum(z) AS BIGINT) AS total FROM f GROUP BY 1, 2", f=FIRST
)
ORACLE["t4_nearest_onto"] = sql(f"""SELECT a.r AS "row", a.c AS col, cls FROM dem a {COVER}""", "dem", "lc")
ORACLE["t5_crop"] = sql(
    """SELECT r - 25 AS "row", c - 9 AS col, z AS v FROM dem WHERE c BETWEEN 9 AND 50 AND r BETWEEN 25 AND 299""", "dem"
)
ORACLE["t6_retile"] = sql(
    """SELECT r // 32 AS trow, c // 32 AS tcol, count(*) AS n, 'dem_' || (c // 32 + 1) || '_' || (r // 32 + 1) AS name,
        CAST(-8654000 + min(c) * 200 AS DOUBLE) AS xmin, CAST(4710000 - (max(r) + 1) * 200 AS DOUBLE) AS ymin,
        CAST(-8654000 + (max(c) + 1) * 200 AS DOUBLE) AS xmax, CAST(4710000 - min(r) * 200 AS DOUBLE) AS ymax FROM gaps GROUP BY r // 32, c // 32""",
    "gaps",
)
SPAN = "(2 * 20037508.342789244 / 1024)"
ORACLE["t7_slippy_keys"] = sql(
    f"""SELECT CAST(10 AS INTEGER) AS z, CAST(floor(({MAP_X} + 20037508.342789244) / {SPAN}) AS BIGINT) AS x,
        CAST(floor((20037508.342789244 - {MAP_Y}) / {SPAN}) AS BIGINT) AS y, count(*) AS n FROM dem GROUP BY 1, 2, 3""",
    "dem",
)
ORACLE["t8_pyramid"] = sql(
    f"""SELECT zoom AS z, r AS "row", c AS col, z AS v FROM ({all_levels(6, 0)})""", "gaps", **pyramid_levels("gaps", 6, 0)
)
ORACLE["t8_pyramid_average"] = sql(
    f"""SELECT CAST(6 - k AS INTEGER) AS z, r // (1 << k) AS "row", c // (1 << k) AS col,
        {r4('CAST(sum(z) AS DOUBLE) / count(*)')} AS v FROM gaps, (SELECT CAST(k AS INTEGER) AS k FROM range(0, 7) t(k)) GROUP BY 1, 2, 3""",
    "gaps",
)
ORACLE["t9_stitch"] = sql(OUT + "z AS v FROM gaps", "gaps")

# Statistics
ORACLE["a1_histogram"] = sql("SELECT z AS value, count(*) AS n FROM sparse GROUP BY 1", "sparse")
ORACLE["a2_tile_histogram"] = sql(
    "SELECT r // 16 AS trow, c // 16 AS tcol, z AS value, count(*) AS n FROM dem GROUP BY 1, 2, 3", "dem"
)
ORACLE["a3_breaks"] = sql(
    f"SELECT 'dem' AS layer, i, brk FROM ({breaks('dem')}) UNION ALL SELECT 'sparse', i, brk FROM ({breaks('sparse')})",
    "dem",
    "sparse",
)
ORACLE["a4_stats"] = sql(
    " UNION ALL ".join(
        f"SELECT '{t}' AS layer, count(*) AS n, min(z) AS vmin, max(z) AS vmax, {r4('CAST(sum(z) AS DOUBLE) / count(*)')} AS vmean FROM {t}"
        for t in ("dem", "sparse")
    ),
    "dem",
    "sparse",
)
BIGGEST = """SELECT l_orderkey AS request_id, max(l_quantity) AS diameter,
    arg_max(l_returnflag, {'a': l_quantity, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}) AS kind,
    sum(l_quantity + 35) AS total, sum(l_quantity + 50) AS night FROM lineitem GROUP BY 1"""
ORACLE["a5_largest_aircraft"] = sql("SELECT request_id, diameter, kind FROM g", g=BIGGEST)
ORACLE["a6_area_diameter"] = sql("SELECT request_id, night AS total FROM g", g=BIGGEST)
ORACLE["a7_site_params"] = sql("SELECT request_id, total, kind, '25' AS diameter, '35' AS buffer FROM g", g=BIGGEST)
ORACLE["a8_tile_count"] = sql(
    " UNION ALL ".join(f"SELECT '{t}' AS layer, count(DISTINCT (r // 16, c // 16)) AS tiles FROM {t}" for t in ("dem", "sparse")),
    "dem",
    "sparse",
)
CLASSES = {"k": "SELECT r, c, r * 64 + c AS id, (z // 100) % 4 AS z FROM gaps"}
STEPS = "(SELECT * FROM (VALUES (-1, 0, 'N'), (0, 1, 'E'), (1, 0, 'S'), (0, -1, 'W')) AS t(dr, dc, side))"


def region_parts(where: str = "TRUE") -> dict[str, str]:
    return {
        **CLASSES,
        "k1": f"SELECT * FROM k WHERE {where}",
        "link": f"""SELECT a, b.id AS b FROM (SELECT id AS a, z, r + dr AS r, c + dc AS c FROM k1, {STEPS}) a
            JOIN k1 b USING (r, c, z)""",
        "reach": "SELECT id AS a, id AS b FROM k1 UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a",
        "lab": "SELECT k1.*, m.region FROM k1 JOIN (SELECT a, min(b) AS region FROM reach GROUP BY a) m ON m.a = k1.id",
    }


ORACLE["a9_regions"] = sql(
    """SELECT region, min(z) AS value, count(*) AS cells, min(r) AS row0, max(r) AS row1, min(c) AS col0, max(c) AS col1
      FROM lab GROUP BY region""",
    "gaps",
    recursive=True,
    **region_parts(),
)
ORACLE["a9_regions_per_value"] = sql(
    "SELECT z AS value, count(DISTINCT region) AS regions FROM lab GROUP BY z", "gaps", recursive=True, **region_parts()
)
ORACLE["a10_region_outline"] = sql(
    f"""SELECT a.region, a.r AS "row", a.c AS col, side FROM lab a, {STEPS}
      WHERE NOT EXISTS (SELECT 1 FROM k1 b WHERE b.r = a.r + dr AND b.c = a.c + dc)""",
    "gaps",
    recursive=True,
    **region_parts("z = 1"),
)


# Vector and visibility
def sight(elevation: str, radius: int, eye: float, target: float) -> dict[str, str]:
    reach = f"(SELECT dr, dc FROM {offsets(radius)} WHERE dr * dr + dc * dc <= {radius * radius})"
    return {
        "ob": f"SELECT p.id, p.r, p.c, e.z + {eye} AS zo FROM points p JOIN {elevation} e ON e.r = p.r AND e.c = p.c",
        # Sight lines run over the observer's other targets, so their steps are worked out once for all observers.
        "st": f"""SELECT dr, dc, k, (2 * k * dr + n + 2 * n * 1000) // (2 * n) - 1000 AS sr, (2 * k * dc + n + 2 * n * 1000) // (2 * n) - 1000 AS sc
            FROM (SELECT dr, dc, greatest(abs(dr), abs(dc)) AS n FROM {reach}), range(1, {radius}) t(k) WHERE k < n""",
        "tg": f"""SELECT id, ob.r, ob.c, zo, dr, dc, greatest(abs(dr), abs(dc)) AS n, e.z, e.z + {target} AS zt
            FROM ob, {reach} JOIN {elevation} e ON e.r = ob.r + dr AND e.c = ob.c + dc""",
        "hid": """SELECT DISTINCT a.id, a.dr, a.dc FROM tg a JOIN st USING (dr, dc)
            JOIN tg b ON b.id = a.id AND b.dr = sr AND b.dc = sc WHERE (b.z - b.zo) * a.n > (a.zt - a.zo) * k""",
        "seen": """SELECT id, r + dr AS r, c + dc AS c, CAST(hid.id IS NULL AS INTEGER) AS visible
            FROM tg LEFT JOIN hid USING (id, dr, dc)""",
    }


ORACLE["v2_viewshed"] = sql(
    'SELECT id AS observer_id, r AS "row", c AS col, visible FROM seen', "gaps", "points", **sight("gaps", 12, 0, 0)
)
ORACLE["v6_cumulative"] = sql(
    'SELECT r AS "row", c AS col, max(visible) AS visible FROM seen GROUP BY 1, 2', "dem", "points", **sight("dem", 8, 3, 2)
)


def ring_sight(elevation: str, radius: int) -> dict[str, str]:
    """A horizon carried outward: ring k needs ring k - 1 only. Doubles in the order of the recurrence."""
    parts = {
        "cl": f"""SELECT p.id, a.dr, a.dc, CAST(o.z AS DOUBLE) AS eye, CAST(e.z AS DOUBLE) AS z
            FROM points p JOIN {elevation} o ON o.r = p.r AND o.c = p.c, {offsets(radius)} a
            JOIN {elevation} e ON e.r = p.r + a.dr AND e.c = p.c + a.dc""",
        "rg": f"""SELECT dr, dc, k, CASE WHEN abs(dr) = k THEN dc ELSE dr END AS along, abs(dr) = k AS down,
            CASE WHEN abs(dr) = k THEN sign(dr) ELSE sign(dc) END * (k - 1) AS inward
            FROM (SELECT dr, dc, greatest(abs(dr), abs(dc)) AS k FROM {offsets(radius)})""",
        "lh": """SELECT *, CASE WHEN (along * (k - 1)) % k = 0 THEN low ELSE low + 1 END AS high,
            CASE WHEN (along * (k - 1)) % k = 0 THEN 0.0::DOUBLE ELSE CAST(along * (k - 1) AS DOUBLE) / k - low END AS share
            FROM (SELECT *, CAST(floor(CAST(along * (k - 1) AS DOUBLE) / k) AS BIGINT) AS low FROM rg WHERE k > 1)""",
        "look": """SELECT dr, dc, k, share, CASE WHEN down THEN inward ELSE low END AS lr, CASE WHEN down THEN low ELSE inward END AS lc,
            CASE WHEN down THEN inward ELSE high END AS hr, CASE WHEN down THEN high ELSE inward END AS hc FROM lh""",
        "h1": "SELECT id, dr, dc, z, eye, z AS h FROM cl WHERE greatest(abs(dr), abs(dc)) <= 1",
    }
    for k in range(2, radius + 1):
        parts[f"h{k}"] = f"""SELECT id, dr, dc, z, eye, greatest(z, before + (before - eye) / {k - 1}) AS h FROM (
            SELECT cl.*, (1.0::DOUBLE - share) * a.h + share * b.h AS before FROM look JOIN cl USING (dr, dc)
            LEFT JOIN h{k - 1} a ON a.id = cl.id AND a.dr = lr AND a.dc = lc
            LEFT JOIN h{k - 1} b ON b.id = cl.id AND b.dr = hr AND b.dc = hc WHERE k = {k})"""
        # greatest() leaves NULL out, but a horizon that is not known stays unknown
        parts[f"h{k}"] = f"SELECT id, dr, dc, z, eye, CASE WHEN before IS NOT NULL THEN h END AS h FROM ({parts[f'h{k}'].replace(' AS h FROM (', ' AS h, before FROM (', 1)})"
    parts["hz"] = " UNION ALL ".join(f"SELECT id, dr, dc, z, h FROM h{k}" for k in range(1, radius + 1))
    return parts


ORACLE["v1_ring_viewshed"] = sql(
    """SELECT p.id AS observer_id, p.r + dr AS "row", p.c + dc AS col, CAST(coalesce(z = h, FALSE) AS INTEGER) AS visible
      FROM hz JOIN points p ON p.id = hz.id WHERE dr * dr + dc * dc <= 144""",
    "dem",
    "points",
    **ring_sight("dem", 12),
)
ORACLE["v3_symbol_rings"] = sql(
    symbols("marks"), "gaps", "size", marks="SELECT r, c, CASE WHEN z % 97 = 0 THEN 3 ELSE z % 3 END AS z FROM gaps"
)
ORACLE["v4_buffers"] = sql(
    f"""SELECT g.r AS "row", g.c AS col, CASE WHEN t.r IS NULL THEN 0 ELSE 7 END AS v FROM gaps g
      LEFT JOIN (SELECT DISTINCT p.r + dr AS r, p.c + dc AS c FROM points p, {DISC3}) t ON t.r = g.r AND t.c = g.c""",
    "gaps",
    "points",
)
ORACLE["v5_lines"] = sql(
    """SELECT DISTINCT a.r + CASE WHEN n = 0 THEN 0 ELSE (2 * k * (b.r - a.r) + n + 2 * n * 100000) // (2 * n) - 100000 END AS "row",
        a.c + CASE WHEN n = 0 THEN 0 ELSE (2 * k * (b.c - a.c) + n + 2 * n * 100000) // (2 * n) - 100000 END AS col, 20 AS v
      FROM (SELECT a.*, b.r AS br, b.c AS bc FROM v a JOIN v b ON b.line = a.line AND b.seq = a.seq + 1) a,
        LATERAL (SELECT br AS r, bc AS c) b, LATERAL (SELECT greatest(abs(br - a.r), abs(bc - a.c)) AS n) s,
        LATERAL (SELECT unnest(range(0, n + 1)) AS k) w""",
    "points",
    v="SELECT id // 10 AS line, id % 10 AS seq, r, c FROM points",
)
ORACLE["j3_cells_near_points"] = sql(
    f"""SELECT r + dr AS "row", c + dc AS col, CAST(min(dr * dr + dc * dc) AS INTEGER) AS d2 FROM points, {DISC3}, size
      WHERE r + dr BETWEEN 0 AND size.n - 1 AND c + dc BETWEEN 0 AND 63 GROUP BY 1, 2""",
    "points",
)

# Stored blocks give the same cells.
ORACLE["f5_slope_stored_blocks"] = ORACLE["f5_slope"]
ORACLE["f3_focal_mean_stored_blocks"] = ORACLE["f3_focal_mean"]
ORACLE["f4_focal_sum_stored_blocks"] = ORACLE["f4_focal_sum_circle"]
ORACLE["c1_tpi_stored_blocks"] = sql(
    OUT + f"{r4('(total / k - lo) / (hi - lo)')} AS v FROM q WHERE hi > lo", "gaps", "size", **SQ2
)
ORACLE["c6_suitability_stored_blocks"] = ORACLE["c6_suitability"]
ORACLE["l3_hover_stored_blocks"] = ORACLE["l3_hover"]

# Scalar functions
ORACLE["m1_haversine"] = sql(f"SELECT request_id, {r4(haversine('xmin', 'ymin', 'xmax', 'ymax'))} AS metres FROM boxes", "boxes")
ORACLE["m2_resolution_label"] = """SELECT c_custkey, CASE
    WHEN m >= 100 THEN CAST(CAST(floor(m / 100) * 100 AS BIGINT) AS VARCHAR) || 'M'
    WHEN m >= 10 THEN CAST(CAST(floor(m / 10) * 10 AS BIGINT) AS VARCHAR) || 'M'
    WHEN m >= 1 THEN CAST(CAST(floor(m) AS BIGINT) AS VARCHAR) || 'M'
    ELSE CAST(CAST(floor(m * 10) * 10 AS BIGINT) AS VARCHAR) || 'cm' END AS label
  FROM (SELECT c_custkey, abs(c_acctbal) / 100 AS m FROM customer)"""
ORACLE["m3_wkt"] = sql(
    f"""SELECT request_id, {wkt('xmin', 'ymin', 'xmax', 'ymax')} AS box,
        'POINT (' || printf('%.6f', xmin) || ' ' || printf('%.6f', ymax) || ')' AS corner FROM boxes""",
    "boxes",
)
ORACLE["m9_colour_channels"] = """SELECT CAST(red * 16777216 + green * 65536 + blue * 256 + alpha AS BIGINT) AS rgba, count(*) AS n,
    CAST(red AS INTEGER) AS red, CAST(green AS INTEGER) AS green, CAST(blue AS INTEGER) AS blue, CAST(alpha AS INTEGER) AS alpha
  FROM (SELECT l_orderkey % 256 AS red, l_orderkey * 3 % 256 AS green, l_orderkey * 5 % 256 AS blue, l_orderkey * 7 % 256 AS alpha
    FROM lineitem) GROUP BY ALL"""
ORACLE["l2_lcnoobs_stored_blocks"] = ORACLE["l2_lcnoobs"]
ORACLE["l4_combined_stored_blocks"] = f"SELECT * FROM ({ORACLE['l4_combined']}) WHERE v IS NOT NULL"
ORACLE["t1_reproject_stored_blocks"] = ORACLE["t1_reproject_bilinear"]
ORACLE["t4_nearest_stored_blocks"] = ORACLE["t4_nearest_onto"]
ORACLE["t8_pyramid_stored_blocks"] = ORACLE["t8_pyramid"]
ORACLE["t3_mosaic_stored_blocks"] = """SELECT l_partkey AS "row", l_suppkey AS col, arg_min(z, l_linenumber) AS v
    FROM (SELECT l_linenumber, l_partkey, l_suppkey, min(CAST(floor(l_extendedprice) AS BIGINT)) AS z FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2"""
ORACLE["s18_read_tile"] = sql(
    f"""SELECT CAST(i AS INTEGER) AS at, CAST(coalesce(max(CASE WHEN r = 48 + i // 16 AND c = 16 + i % 16 THEN {RED} END), 0) AS BIGINT) AS rgba
      FROM p4, range(0, 256) t(i) WHERE r // 16 = 3 AND c // 16 = 1 GROUP BY i""",
    "dem",
    low="SELECT r, c, z - 900 AS z FROM dem",
    **pyramid_levels("low", 5, 2),
)
