"""Queries over grids derived from the test tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import GridMeta, meta_of
from ..operators import conditioning, flow, graph, local, rays, streams, terrain, tiles, vector
from ..sources import grids
from . import oracle as o

DIGITS = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS places, without a negative zero."""
    return df.select(*[(F.round(F.col(c), DIGITS) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def rd(expr: str) -> str:
    return f"round({expr}, {DIGITS}) + 0.0"


def on_dem(fn: Callable[[DataFrame, GridMeta], DataFrame], source=grids.dem) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        cells = source(spark, sf_dir)
        return rounded(fn(cells, meta_of(cells)))

    return run


def simple(name: str, fn, ctes: str, body: str, recursive: bool = False, source=grids.dem) -> None:
    add(name, on_dem(fn, source), o.q(ctes, body, recursive))


# scans and local operators
add("dem_stats", lambda s, d: rounded(grids.band_statistics(grids.dem(s, d))), o.q("", f"SELECT {rd('min(z)')} AS min, {rd('max(z)')} AS max, {rd('avg(z)')} AS mean, {rd('stddev_pop(z)')} AS std, count(z) AS valid FROM dem"))
simple("raster_points", lambda z, m: grids.points_of_raster(z.withColumn("z", F.when(F.col("z") > 150, F.col("z")))), "", f"SELECT row_number() OVER (ORDER BY r, c) AS id, {rd('c + 0.5::DOUBLE')} AS x, {rd('-(r + 0.5::DOUBLE)')} AS y, {rd('z')} AS z FROM dem WHERE z > 150")
simple("reclassify", lambda z, m: z.select("r", "c", local.reclassify(F.col("z"), [50.0, 100.0, 200.0], [1.0, 2.0, 3.0]).alias("class")), "", "SELECT r, c, CASE WHEN z IS NULL THEN NULL WHEN z >= 200 THEN 3.0::DOUBLE WHEN z >= 100 THEN 2.0::DOUBLE WHEN z >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS class FROM dem")
simple("apply_mask", lambda z, m: z.select("r", "c", local.mask(F.col("z"), F.col("z") > 100, F.lit(-1.0)).alias("z")), "", f"SELECT r, c, {rd('CASE WHEN z > 100 THEN -1.0::DOUBLE ELSE z END')} AS z FROM dem")
simple("safe_divide", lambda z, m: z.select("r", "c", local.safe_divide(F.col("z"), F.col("c") % 7, -1.0).alias("ratio")), "", f"SELECT r, c, {rd('coalesce(CASE WHEN c % 7 <> 0 THEN z / (c % 7) END, -1.0::DOUBLE)')} AS ratio FROM dem")
add("burn", lambda s, d: rounded(conditioning.burn(grids.dem(s, d), grids.click_mask(s, d))), o.q("", f"SELECT r, c, {rd('''CASE WHEN event_type IN ('click','view') THEN z - 10.0::DOUBLE ELSE z END''')} AS z FROM dem JOIN ev USING (r, c)"))

# slope, aspect, shade
simple("slope_deg", lambda z, m: terrain.slope(z, m), o.SLOPE, f"SELECT r, c, {rd('degrees(rad)')} AS slope FROM sl")
simple("slope_pct", lambda z, m: terrain.slope(z, m, "percent"), o.SLOPE, f"SELECT r, c, {rd('tan(rad)*100.0::DOUBLE')} AS slope FROM sl")
simple("aspect", lambda z, m: terrain.aspect(z, m), o.ASPECT, f"SELECT r, c, {rd('aspect')} AS aspect FROM asp")
simple("aspect_relative", lambda z, m: terrain.relative_aspect(z, m, 45.0), o.ASPECT, f"SELECT r, c, {rd('CASE WHEN aspect <> -1 THEN CASE WHEN abs(aspect-45.0) > 180 THEN 360.0::DOUBLE - abs(aspect-45.0) ELSE abs(aspect-45.0) END END')} AS relative FROM asp")
simple("aspect_circ_var", lambda z, m: terrain.aspect_variance(z, m), o.ASPECT + ", v AS (SELECT a.r, a.c, a.aspect, avg(sin(radians(b.aspect))) AS s, avg(cos(radians(b.aspect))) AS k FROM asp a LEFT JOIN asp b ON abs(b.r-a.r) <= 1 AND abs(b.c-a.c) <= 1 AND b.aspect <> -1 GROUP BY a.r, a.c, a.aspect)", f"SELECT r, c, {rd('CASE WHEN aspect IS NOT NULL AND s IS NOT NULL THEN 1.0::DOUBLE - sqrt(s*s + k*k) END')} AS variance FROM v")
simple("hillshade", lambda z, m: terrain.hillshade(z, m), o.stencil("sa"), f"SELECT r, c, {rd(o.shade((315.0,)))} AS shade FROM sa")
simple("hillshade_multi", lambda z, m: terrain.hillshade(z, m, terrain.MULTI_AZIMUTHS), o.stencil("sa"), f"SELECT r, c, {rd(o.shade(terrain.MULTI_AZIMUTHS))} AS shade FROM sa")
simple("sar", lambda z, m: terrain.surface_area_ratio(z, m), o.SLOPE, f"SELECT r, c, {rd('1.0::DOUBLE / cos(rad)')} AS ratio FROM sl")
simple("directional_relief", lambda z, m: terrain.directional_relief(z, m), o.SLOPE + ", " + o.ASPECT, f"SELECT r, c, {rd('CASE WHEN rad IS NOT NULL AND aspect IS NOT NULL THEN CASE WHEN aspect = -1 THEN 0.0::DOUBLE ELSE tan(rad)*cos(radians(aspect) - radians(315.0::DOUBLE)) END END')} AS relief FROM sl JOIN asp USING (r, c)")
for _k in terrain.CURVATURES:
    simple(f"curv_{_k}", (lambda k: lambda z, m: terrain.curvatures(z, m, (k,)))(_k), o.CURVES, f"SELECT r, c, {rd(o.CURVE_FORMS[_k])} AS {_k} FROM cu", source=grids.dem_full)
_CHANNEL = f"CAST(CASE WHEN {o.CURVE_FORMS['profile']} {{}} THEN 1 ELSE 0 END AS INT)"
simple("ridge", lambda z, m: terrain.ridges(z, m), o.CURVES, f"SELECT r, c, {_CHANNEL.format('> 0.1')} AS ridge FROM cu", source=grids.dem_full)
simple("channel", lambda z, m: terrain.ridges(z, m, True), o.CURVES, f"SELECT r, c, {_CHANNEL.format('< -0.1')} AS channel FROM cu", source=grids.dem_full)
_SLOPE_FULL = o.stencil("st", "demf") + f", sl AS (SELECT r, c, CASE WHEN {o.INNER} THEN degrees(atan(sqrt({o.GX0}*{o.GX0} + {o.GY0}*{o.GY0}))) END AS s FROM st CROSS JOIN ext)"
simple("pennock", lambda z, m: terrain.pennock(z, m), o.CURVES + ", " + _SLOPE_FULL + f", pf AS (SELECT r, c, s, {o.CURVE_FORMS['profile']} AS f, {o.CURVE_FORMS['plan']} AS p FROM cu JOIN sl USING (r, c))", "SELECT r, c, CAST(CASE WHEN s IS NULL THEN 0 WHEN s < 3 THEN 7 WHEN f > 0.1 THEN CASE WHEN p < -0.1 THEN 1 WHEN p > 0.1 THEN 2 ELSE 0 END WHEN f < -0.1 THEN CASE WHEN p < -0.1 THEN 5 WHEN p > 0.1 THEN 6 ELSE 0 END WHEN abs(f) <= 0.1 THEN CASE WHEN p < -0.1 THEN 3 WHEN p > 0.1 THEN 4 ELSE 0 END ELSE 0 END AS INT) AS landform FROM pf", source=grids.dem_full)

# windows
_DISK = o.offsets(terrain.disk(3))
simple("tpi", lambda z, m: terrain.tpi(z, m, 3), f"t AS (SELECT a.r, a.c, a.z, avg(b.z) AS m, count(b.z) AS n FROM dem a CROSS JOIN ext CROSS JOIN {_DISK} JOIN dem b ON b.r = greatest(0, least(mr, a.r+i)) AND b.c = greatest(0, least(mc, a.c+j)) GROUP BY a.r, a.c, a.z)", f"SELECT r, c, {rd(f'CASE WHEN n = {len(terrain.disk(3))} THEN z - m END')} AS tpi FROM t")


def _tri(name: str, radius: int) -> str:
    return f"{name} AS (SELECT a.r, a.c, CASE WHEN a.z IS NOT NULL THEN coalesce(avg(abs(a.z - b.z)), 0.0) END AS v FROM dem a LEFT JOIN dem b ON abs(b.r-a.r) <= {radius} AND abs(b.c-a.c) <= {radius} AND NOT (a.r = b.r AND a.c = b.c) GROUP BY a.r, a.c, a.z)"


simple("tri", lambda z, m: terrain.tri(z, m, 1), _tri("t", 1), f"SELECT r, c, {rd('v')} AS tri FROM t")
simple("multiscale_tri", lambda z, m: terrain.multiscale(z, m, "tri", 1, 2), _tri("t", 1) + ", " + _tri("u", 2), f"SELECT r, c, {rd('greatest(0.0, t.v, u.v)')} AS largest FROM t JOIN u USING (r, c)")
simple("roughness", lambda z, m: terrain.roughness(z, m, 3), o.window("w", 1), f"SELECT r, c, {rd('hi - lo')} AS roughness FROM w")
simple("roughness_multi", lambda z, m: terrain.multiscale_roughness(z, m, 1, 2), o.window("w", 1) + ", " + o.window("v", 2), f"SELECT r, c, {rd('greatest(0.0, w.hi - w.lo, v.hi - v.lo)')} AS roughness FROM w JOIN v USING (r, c)")
simple("hypsometric", lambda z, m: terrain.hypsometric(z, m, 3), o.window("w", 1), f"SELECT r, c, {rd('CASE WHEN bad = 0 THEN CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE (s/9.0::DOUBLE - lo)/(hi - lo) END END')} AS hi FROM w")
_STD = "sqrt(greatest(0.0::DOUBLE, sq/49.0::DOUBLE - (s/49.0::DOUBLE)*(s/49.0::DOUBLE)))"
simple("rtp_minmax", lambda z, m: terrain.relative_position(z, m, 3, "minmax"), o.window("w", 3), f"SELECT r, c, {rd('CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE (z - lo)/(hi - lo) END')} AS minmax FROM w")
simple("rtp_diff", lambda z, m: terrain.relative_position(z, m, 3, "diff"), o.window("w", 3), f"SELECT r, c, {rd('CASE WHEN bad = 0 THEN z - s/49.0::DOUBLE END')} AS diff FROM w")
simple("rtp_dev", lambda z, m: terrain.relative_position(z, m, 3, "dev"), o.window("w", 3), f"SELECT r, c, {rd(f'CASE WHEN bad = 0 THEN CASE WHEN {_STD} = 0 THEN 0.0::DOUBLE ELSE (z - s/49.0::DOUBLE)/{_STD} END END')} AS dev FROM w")
for _k, _e in {"mean": "CASE WHEN bad = 0 THEN s/49.0::DOUBLE END", "sum": "CASE WHEN bad = 0 THEN s END", "std": f"CASE WHEN bad = 0 THEN {_STD} END", "min": "lo", "max": "hi", "range": "hi - lo", "median": "med"}.items():
    simple(f"focal_{_k}", (lambda k: lambda z, m: terrain.focal(z, m, k, 7))(_k), o.window("w", 3), f"SELECT r, c, {rd(_e)} AS {_k} FROM w")
_STD9 = "sqrt(greatest(0.0::DOUBLE, sq/9.0::DOUBLE - (s/9.0::DOUBLE)*(s/9.0::DOUBLE)))"
simple("slope_std", lambda z, m: terrain.slope_deviation(z, m, 3), o.SLOPE + ", sd AS (SELECT r, c, degrees(rad) AS z FROM sl), " + o.window("w", 1, "sd"), f"SELECT r, c, {rd(f'CASE WHEN bad = 0 THEN {_STD9} END')} AS slope_std FROM w")
simple("edge_density", lambda z, m: terrain.edge_density(z, m, 3), o.SLOPE + ", sd AS (SELECT r, c, CASE WHEN degrees(rad) > 15 THEN 1.0::DOUBLE WHEN rad IS NOT NULL THEN 0.0::DOUBLE END AS z FROM sl), " + o.window("w", 1, "sd"), f"SELECT r, c, {rd('CASE WHEN bad = 0 THEN s/9.0::DOUBLE END')} AS density FROM w")
simple("multiscale_tpi", lambda z, m: terrain.multiscale(z, m, "tpi", 1, 2), ", ".join(f"t{k} AS (SELECT a.r, a.c, CASE WHEN count(b.z) = {len(terrain.disk(k))} THEN abs(a.z - avg(b.z)) END AS v FROM dem a CROSS JOIN ext CROSS JOIN {o.offsets(terrain.disk(k))} JOIN dem b ON b.r = greatest(0, least(mr, a.r+i)) AND b.c = greatest(0, least(mc, a.c+j)) GROUP BY a.r, a.c, a.z)" for k in (1, 2)), f"SELECT r, c, {rd('greatest(0.0, t1.v, t2.v)')} AS largest FROM t1 JOIN t2 USING (r, c)")
_NB = o.stencil("sn", "dem", "z", False) + ", fe AS (SELECT r, c, z, " + " + ".join(f"(CASE WHEN {k} > z THEN 1 ELSE 0 END)" for k in o.KEYS) + " AS up, " + " + ".join(f"(CASE WHEN {k} < z THEN 1 ELSE 0 END)" for k in o.KEYS) + f" AS down, {o.INNER} AS inner_ FROM sn CROSS JOIN ext)"
for _k, _e in {"peak": "down = 8", "valley": "up = 8", "saddle": "up >= 2 AND down >= 2"}.items():
    simple(_k, (lambda k: lambda z, m: terrain.features(z, m, k))(_k), _NB, f"SELECT r, c, CAST(CASE WHEN inner_ AND z IS NOT NULL AND {_e} THEN 1 ELSE 0 END AS INT) AS {_k} FROM fe")
_PIT = o.stencil("sn", "dem", "z", False) + ", lo AS (SELECT *, least(" + ", ".join(o.KEYS) + ") AS low FROM sn)"
simple("pit_fill", lambda z, m: conditioning.fill_pits(z, m), _PIT, f"SELECT r, c, {rd('CASE WHEN z < low THEN low ELSE z END')} AS z FROM lo")
simple("pit_breach", lambda z, m: conditioning.breach_pits(z, m), _PIT + ", pit AS (SELECT l.r, l.c, l.z, arg_min(struct_pack(r := b.r, c := b.c), struct_pack(x := b.z, y := ord)) AS t FROM lo l CROSS JOIN off JOIN dem b ON b.r = l.r+dr AND b.c = l.c+dc WHERE l.z < l.low AND b.z IS NOT NULL GROUP BY l.r, l.c, l.z), tgt AS (SELECT t.r AS r, t.c AS c, min(z) AS z FROM pit GROUP BY 1, 2)", f"SELECT d.r, d.c, {rd('least(d.z, coalesce(t.z, d.z))')} AS z FROM dem d LEFT JOIN tgt t USING (r, c)")

# rays
simple("openness_pos", lambda z, m: rays.openness(z, m, 5), o.rays(o.OPEN_RAYS) + ", mx AS (SELECT r, c, k, max(degrees(atan((v - z)/i))) AS a FROM ry GROUP BY r, c, k), t AS (SELECT r, c, sum(90.0 - a) AS s, count(*) AS n FROM mx GROUP BY r, c)", f"SELECT d.r, d.c, {rd('CASE WHEN z IS NOT NULL THEN radians((coalesce(s, 0.0) + (8 - coalesce(n, 0))*180.0)/8.0) END')} AS openness FROM dem d LEFT JOIN t USING (r, c)")
simple("openness_neg", lambda z, m: rays.openness(z, m, 5, True), o.rays(o.OPEN_RAYS) + ", mx AS (SELECT r, c, k, max(degrees(atan((z - v)/i))) AS a FROM ry GROUP BY r, c, k), t AS (SELECT r, c, sum(90.0 - a) AS s, count(*) AS n FROM mx GROUP BY r, c)", f"SELECT d.r, d.c, {rd('CASE WHEN z IS NOT NULL THEN radians((coalesce(s, 0.0) + (8 - coalesce(n, 0))*180.0)/8.0) END')} AS openness FROM dem d LEFT JOIN t USING (r, c)")
simple("wind_exposure", lambda z, m: rays.wind_exposure(z, m, max_dist=10.0), o.rays(o.WIND_RAYS) + ", t AS (SELECT r, c, max((v - z)/i) AS sx FROM ry GROUP BY r, c)", f"SELECT d.r, d.c, {rd('CASE WHEN z IS NOT NULL THEN coalesce(sx, 0.0) END')} AS sx FROM dem d LEFT JOIN t USING (r, c)")


def _first_observer(s, d):
    cells = grids.dem(s, d)
    m = meta_of(cells)
    r, c = grids.cell_of(F.col("x"), F.col("y"))
    seat = grids.pour_points(s, d, m.rows).orderBy("pid").limit(1).select(r.alias("r"), c.alias("c")).first()
    return rays.viewshed(cells, seat["r"], seat["c"])


_SEAT = "seat AS (SELECT CAST(s_suppkey*53 % (mr+1) AS INT) AS sr, CAST(s_suppkey*37 % 100 AS INT) AS sc FROM supplier CROSS JOIN ext ORDER BY s_suppkey LIMIT 1), eye AS (SELECT sr, sc, z + 1.8::DOUBLE AS ez FROM seat JOIN dem ON r = sr AND c = sc), tg AS (SELECT r, c, z, sr, sc, ez, sqrt((r-sr)*(r-sr) + (c-sc)*(c-sc)) AS dist FROM dem CROSS JOIN eye), smp AS (SELECT *, unnest(range(1, CAST(floor(dist) AS INT))) AS i FROM tg WHERE z IS NOT NULL), hid AS (SELECT DISTINCT s.r, s.c FROM smp s JOIN dem b ON b.r = round_even(sr + i*(s.r-sr)::DOUBLE/floor(dist), 0) AND b.c = round_even(sc + i*(s.c-sc)::DOUBLE/floor(dist), 0) WHERE b.z > ez + i*(s.z - ez)/dist)"
add("viewshed", _first_observer, o.q(_SEAT, "SELECT t.r, t.c, CAST(CASE WHEN t.z IS NOT NULL AND h.r IS NULL THEN 1 ELSE 0 END AS INT) AS seen FROM tg t LEFT JOIN hid h ON h.r = t.r AND h.c = t.c"))

# routing
_DIR = "SELECT r, c, CAST(dir AS INT) AS dir FROM fd"
simple("d8", lambda z, m: flow.d8(z, m), o.d8(), _DIR)
simple("d8_lowest", lambda z, m: flow.d8(z, m, "lowest"), o.d8(mode="lowest"), _DIR)
simple("d8_levels", lambda z, m: flow.d8(z, m), o.d8("lev"), _DIR, source=grids.dem_levels)
simple("d8_force_edge", lambda z, m: flow.force_edge(flow.d8(z, m), m), o.d8(), "SELECT r, c, CAST(CASE WHEN r=0 AND c=0 THEN 32 WHEN r=0 AND c=mc THEN 128 WHEN r=mr AND c=0 THEN 8 WHEN r=mr AND c=mc THEN 2 WHEN r=0 THEN 64 WHEN r=mr THEN 4 WHEN c=0 THEN 16 WHEN c=mc THEN 1 ELSE dir END AS INT) AS dir FROM fd CROSS JOIN ext")
simple("mfd_direction", lambda z, m: flow.d8(z, m), o.d8(), _DIR)
simple("rho8", lambda z, m: flow.rho8(z, m), o.RHO8, "SELECT d.r, d.c, CAST(CASE WHEN d.z IS NULL THEN NULL WHEN best > 0 THEN steep ELSE 0 END AS INT) AS dir FROM dem d LEFT JOIN rb USING (r, c)")


def _dinf_sql() -> str:
    facets = ", ".join(f"({i}, '{a}', '{b}', {t}, {s})" for i, (a, b, t, s) in enumerate(flow.FACETS))
    pick = lambda key: "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {k}" for k in o.KEYS) + " END"
    return o.stencil("sn", "dem", "z", False) + f""", fc(i, a, b, turns, sign) AS (VALUES {facets}),
f1 AS (SELECT r, c, z, i, turns, sign, z - ({pick('a')}) AS s1, ({pick('a')}) - ({pick('b')}) AS s2, (z - ({pick('b')}))/sqrt(2.0::DOUBLE) AS sd FROM sn CROSS JOIN fc),
f2 AS (SELECT *, atan2(s2, s1) AS a FROM f1 WHERE s1 IS NOT NULL AND s2 IS NOT NULL),
f3 AS (SELECT *, CASE WHEN a < 0 THEN s1 WHEN a > pi()/4 THEN sd ELSE sqrt(s1*s1 + s2*s2) END AS sl, turns*pi()/2 + sign*(CASE WHEN a < 0 THEN 0.0 WHEN a > pi()/4 THEN pi()/4 ELSE a END) AS ang FROM f2),
f4 AS (SELECT r, c, max(sl) AS best, arg_max(ang, struct_pack(x := sl, y := -i)) AS ang FROM f3 GROUP BY r, c)"""


simple("dinf", lambda z, m: flow.dinf(z, m), _dinf_sql(), f"SELECT d.r, d.c, {rd('CASE WHEN z IS NULL THEN NULL WHEN best > 0 THEN CASE WHEN ang >= 2*pi() THEN ang - 2*pi() ELSE ang END ELSE -1.0 END')} AS angle FROM dem d LEFT JOIN f4 USING (r, c)")
_ACC_OUT = f"SELECT d.r, d.c, {rd('acc')} AS acc FROM dem d LEFT JOIN acc USING (r, c)"
simple("acc_d8", lambda z, m: flow.accumulate(flow.d8(z, m), m), o.FLOW, _ACC_OUT, True)
simple("acc_log", lambda z, m: flow.accumulate(flow.d8(z, m), m).select("r", "c", local.log_transform(F.col("acc")).alias("acc")), o.FLOW, f"SELECT d.r, d.c, {rd('log10(acc + 1.0)')} AS acc FROM dem d LEFT JOIN acc USING (r, c)", True)
add("acc_weighted", lambda s, d: rounded(flow.accumulate(flow.d8(z := grids.dem(s, d), m := meta_of(z)), m, grids.weights(s, d))), o.q(f"{o.d8()}, {o.walk()}, wa AS (SELECT w.r, w.c, sum(CASE WHEN event_type = 'purchase' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS acc FROM walk w JOIN ev e ON e.r = w.r0 AND e.c = w.c0 GROUP BY w.r, w.c)", f"SELECT d.r, d.c, {rd('acc')} AS acc FROM dem d LEFT JOIN wa USING (r, c)", True))
simple("acc_lowest", lambda z, m: flow.accumulate(flow.d8(z, m, "lowest"), m, cyclic=True), o.CYCLIC, _ACC_OUT, True)
_SHARED_OUT = "SELECT d.r, d.c, round(CASE WHEN z IS NOT NULL THEN acc END, 4) + 0.0 AS acc FROM dem d LEFT JOIN acc USING (r, c)"  # sums in another order
_four = lambda df: df.select("r", "c", F.round("acc", 4).alias("acc"))
simple("acc_fd8", lambda z, m: _four(flow.accumulate_fd8(z, m)), o.FD8, _SHARED_OUT, True)
simple("acc_dinf", lambda z, m: _four(flow.accumulate_dinf(z, m)), f"{_dinf_sql()}, {o.DINF_SHARES}", _SHARED_OUT, True)
simple("route_fd8", lambda z, m: _four(flow.route(z, m)), o.FD8, _SHARED_OUT, True)
simple("watershed_cell", lambda z, m: flow.watershed_of_cell(flow.d8(z, m), m, 5, 60), f"{o.d8()}, {o.walk()}, t AS (SELECT DISTINCT r0, c0 FROM walk WHERE r = 5 AND c = 60)", "SELECT d.r, d.c, CAST(CASE WHEN r0 IS NULL THEN 0 ELSE 1 END AS INT) AS watershed FROM dem d LEFT JOIN t ON r0 = d.r AND c0 = d.c", True)
simple("path_statistic_longest", lambda z, m: flow.path_statistic("longest_flowpath", flow.d8(z, m), m), f"{o.d8()}, {o.walk()}, t AS (SELECT r0 AS r, c0 AS c, max(len) AS v FROM walk GROUP BY r0, c0), u AS (SELECT r, c, max(len) AS v FROM walk GROUP BY r, c)", f"SELECT d.r, d.c, {rd('t.v + u.v')} AS value FROM dem d LEFT JOIN t USING (r, c) LEFT JOIN u USING (r, c)", True)
simple("flow_len_down", lambda z, m: flow.length_down(flow.d8(z, m), m), f"{o.d8()}, {o.walk()}, t AS (SELECT r0 AS r, c0 AS c, max(len) AS v FROM walk GROUP BY r0, c0)", f"SELECT d.r, d.c, {rd('v')} AS down FROM dem d LEFT JOIN t USING (r, c)", True)
simple("flow_len_up", lambda z, m: flow.length_up(flow.d8(z, m), m), f"{o.d8()}, {o.walk()}, t AS (SELECT r, c, max(len) AS v FROM walk GROUP BY r, c)", f"SELECT d.r, d.c, {rd('v')} AS up FROM dem d LEFT JOIN t USING (r, c)", True)
_BOTH = f"{o.d8()}, {o.walk()}, t AS (SELECT r, c, max(len) AS u FROM walk GROUP BY r, c), v AS (SELECT r0 AS r, c0 AS c, max(len) AS w FROM walk GROUP BY r0, c0)"


def _lengths(z, m):
    f = flow.settled(flow.d8(z, m))
    return flow.length_up(f, m).join(flow.length_down(f, m), ["r", "c"])


simple("flow_len_diff", lambda z, m: _lengths(z, m).select("r", "c", (F.col("up") - F.col("down")).alias("diff")), _BOTH, f"SELECT d.r, d.c, {rd('u - w')} AS diff FROM dem d LEFT JOIN t USING (r, c) LEFT JOIN v USING (r, c)", True)
simple("flow_longest", lambda z, m: _lengths(z, m).select("r", "c", (F.col("up") + F.col("down")).alias("longest")), _BOTH, f"SELECT d.r, d.c, {rd('u + w')} AS longest FROM dem d LEFT JOIN t USING (r, c) LEFT JOIN v USING (r, c)", True)
simple("n_inflow", lambda z, m: flow.inflow_count(flow.d8(z, m), m), f"{o.d8()}, {o.walk()}, t AS (SELECT pr AS r, pc AS c, count(*) AS n FROM walk_p WHERE pr IS NOT NULL GROUP BY pr, pc)", "SELECT d.r, d.c, CAST(coalesce(n, 0) AS INT) AS inflows FROM dem d LEFT JOIN t USING (r, c)", True)
simple("n_upslope", lambda z, m: flow.accumulate(flow.d8(z, m), m).select("r", "c", (F.col("acc") - 1.0).alias("upslope")), o.FLOW, f"SELECT d.r, d.c, {rd('acc - 1.0')} AS upslope FROM dem d LEFT JOIN acc USING (r, c)", True)
simple("n_downslope", lambda z, m: flow.d8(z, m).select("r", "c", F.when(F.col("dir") > 0, 1).otherwise(0).alias("downslope")), o.d8(), "SELECT r, c, CAST(CASE WHEN dir > 0 THEN 1 ELSE 0 END AS INT) AS downslope FROM fd")
simple("min_downslope_change", lambda z, m: z.select("r", "c", F.when(F.col("z").isNotNull(), F.lit(0.0)).alias("change")), "", "SELECT r, c, CASE WHEN z IS NOT NULL THEN 0.0::DOUBLE END AS change FROM dem")
simple("no_flow", lambda z, m: flow.d8(z, m).select("r", "c", F.when(F.col("dir") == 0, 1).otherwise(0).alias("no_flow")), o.d8(), "SELECT r, c, CAST(CASE WHEN dir = 0 THEN 1 ELSE 0 END AS INT) AS no_flow FROM fd")
simple("parallel_flow", lambda z, m: flow.parallel_flow(flow.d8(z, m)), o.d8(), "SELECT a.r, a.c, CAST(CASE WHEN a.dir > 0 AND EXISTS (SELECT 1 FROM fd b WHERE abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND NOT (a.r=b.r AND a.c=b.c) AND a.dir = b.dir) THEN 1 ELSE 0 END AS INT) AS parallel FROM fd a")
simple("hydro_slope", lambda z, m: flow.drop_slope(flow.d8(z, m), m, z), f"{o.d8()}, {o.walk()}", f"SELECT d.r, d.c, {rd('(d.z - e.z)/step')} AS fall FROM dem d LEFT JOIN walk_p p ON p.r = d.r AND p.c = d.c AND p.pr IS NOT NULL LEFT JOIN dem e ON e.r = p.pr AND e.c = p.pc", True)
_END = f"{o.d8()}, {o.walk()}, en AS (SELECT r0, c0, arg_max(r, hop) AS er, arg_max(c, hop) AS ec, max(len) AS len FROM walk GROUP BY r0, c0), dz AS (SELECT d.r, d.c, d.z - x.z AS dz, len FROM dem d LEFT JOIN en ON r0 = d.r AND c0 = d.c LEFT JOIN dem x ON x.r = er AND x.c = ec)"
simple("max_drop", lambda z, m: flow.outlet_statistics(flow.d8(z, m), m, z).select("r", "c", "drop"), _END, f"SELECT r, c, {rd('dz')} AS drop FROM dz", True)
simple("avg_path_slope", lambda z, m: flow.outlet_statistics(flow.d8(z, m), m, z).select("r", "c", "mean_slope"), _END, f"SELECT r, c, {rd('CASE WHEN len > 0 THEN dz/len WHEN len IS NOT NULL THEN 0.0 END')} AS mean_slope FROM dz", True)
simple("basins", lambda z, m: flow.basins(flow.d8(z, m), m), f"{_END}, ids AS (SELECT r, c, CAST(row_number() OVER (ORDER BY r, c) AS INT) AS id FROM fd WHERE dir = 0)", "SELECT d.r, d.c, coalesce(id, 0) AS basin FROM dem d LEFT JOIN en ON r0 = d.r AND c0 = d.c LEFT JOIN ids i ON i.r = er AND i.c = ec", True)
_POINTS = "pp AS (SELECT s_suppkey AS pid, s_suppkey*37 % 100 + 0.5::DOUBLE AS x, -(s_suppkey*53 % (mr+1) + 0.5::DOUBLE) AS y, CAST(s_suppkey*53 % (mr+1) AS INT) AS r, CAST(s_suppkey*37 % 100 AS INT) AS c FROM supplier CROSS JOIN ext)"


def _with_points(fn):
    def run(s, d):
        z = grids.dem(s, d)
        m = meta_of(z)
        return rounded(fn(z, m, grids.pour_points(s, d, m.rows)))

    return run


add("rasterise_points", _with_points(lambda z, m, p: grids.rasterise(p, z)), o.q(f"{_POINTS}, se AS (SELECT r, c, max(pid) AS seed FROM pp GROUP BY r, c)", "SELECT d.r, d.c, CAST(coalesce(seed, 0) AS BIGINT) AS seed FROM dem d LEFT JOIN se USING (r, c)"))
add("watershed_seeds", _with_points(lambda z, m, p: flow.watersheds(flow.d8(z, m), m, grids.rasterise(p, z))), o.q(f"{o.d8()}, {o.walk()}, {_POINTS}, se AS (SELECT r, c, max(pid) AS seed FROM pp GROUP BY r, c HAVING max(pid) > 0), fs AS (SELECT r0, c0, arg_min(seed, hop) AS s FROM walk JOIN se USING (r, c) GROUP BY r0, c0)", "SELECT d.r, d.c, CAST(coalesce(s, 0) AS BIGINT) AS watershed FROM dem d LEFT JOIN fs ON r0 = d.r AND c0 = d.c", True))


def _numbered(z, p):
    r, c = grids.cell_of(F.col("x"), F.col("y"))
    return p.select(r.alias("r"), c.alias("c"), (F.col("pid") + 1).alias("k"))


add("watershed_points", _with_points(lambda z, m, p: flow.watersheds_last_wins(flow.d8(z, m), m, _numbered(z, p))), o.q(f"{o.d8()}, {o.walk()}, {_POINTS}, fs AS (SELECT r0, c0, max(pid + 1) AS s FROM walk JOIN pp USING (r, c) GROUP BY r0, c0)", "SELECT d.r, d.c, CAST(coalesce(s, 0) AS BIGINT) AS watershed FROM dem d LEFT JOIN fs ON r0 = d.r AND c0 = d.c", True))
add("snap_points", _with_points(lambda z, m, p: flow.snap_points(p, flow.accumulate(flow.d8(z, m), m), m, 3.0)), o.q(f"{o.FLOW}, {_POINTS}, b AS (SELECT pid, arg_min(struct_pack(r := a.r, c := a.c), struct_pack(q := -acc, r := a.r, c := a.c)) AS t FROM pp JOIN acc a ON abs(a.r - pp.r) <= 3 AND abs(a.c - pp.c) <= 3 GROUP BY pid)", f"SELECT CAST(pid AS BIGINT) AS pid, {rd('coalesce(t.c + 0.5::DOUBLE, x)')} AS x, {rd('coalesce(-(t.r + 0.5::DOUBLE), y)')} AS y FROM pp LEFT JOIN b USING (pid)", True))
_IX = f"{o.FLOW}, {o.SLOPE}, ix AS (SELECT r, c, rad, acc, acc + 1.0 AS a, (SELECT max(degrees(rad)) FROM sl JOIN acc USING (r, c)) AS top FROM sl LEFT JOIN acc USING (r, c))"
for _k, _e in {"twi": "ln(a/tan(greatest(rad, 0.001::DOUBLE)))", "spi": "a*tan(rad)", "sti": "pow(a/22.13::DOUBLE, 0.6::DOUBLE)*pow(sin(rad)/0.0896::DOUBLE, 1.3::DOUBLE)", "valley": "(1.0 - degrees(rad)/top)*ln(1 + acc)"}.items():
    simple("valley_index" if _k == "valley" else _k, (lambda k: lambda z, m: flow.indices(z, m).select("r", "c", k))(_k), _IX, f"SELECT r, c, {rd(f'CASE WHEN rad IS NOT NULL AND acc IS NOT NULL THEN {_e} END')} AS {_k} FROM ix", True)

# conditioning
_FILLED = {
    "fill": o.q(o.fill(1e-3), f"SELECT r, c, {rd('coalesce(w, z)')} AS filled FROM fix_fi", True), "fill_eps0": o.q(o.fill(0.0), f"SELECT r, c, {rd('coalesce(w, z)')} AS filled FROM fix_fi", True),
    "sink_depth": o.q(o.fill(1e-3), f"SELECT r, c, {rd('coalesce(w, z) - z')} AS depth FROM fix_fi", True), "sinks": o.q(o.fill(1e-3), "SELECT r, c, CAST(CASE WHEN coalesce(w, z) - z > 0 THEN 1 ELSE 0 END AS INT) AS sink FROM fix_fi", True),
}
for _k, _f in {"fill": lambda z, m: conditioning.fill(z, m, tile=64), "fill_eps0": lambda z, m: conditioning.fill(z, m, 0.0, tile=64), "sink_depth": lambda z, m: conditioning.sink_depth(z, m).select("r", "c", "depth"), "sinks": lambda z, m: conditioning.sink_depth(z, m).select("r", "c", "sink"), "breach": lambda z, m: conditioning.breach(z, m)}.items():
    add(_k, on_dem(_f), _FILLED.get(_k))
simple("resolve_flats", lambda z, m: conditioning.resolve_flats(z, m), o.FLATS, f"SELECT r, c, {rd('z + coalesce(w, 0) * 1e-6::DOUBLE')} AS z FROM fix_fl", True, grids.dem_levels)
add("tiles_map", on_dem(lambda z, m: tiles.map_tiles(z, m, lambda a: a * 2.0, tile=32, halo=1)), o.q("", f"SELECT r, c, {rd('z*2.0')} AS \"out\" FROM dem"))


# stream networks
def _net(z, m):
    f = flow.settled(flow.d8(z, m))
    a = flow.cut(flow.accumulate(f, m))
    return f, a, streams.extract(a, 5.0)


def on_net(fn):
    return on_dem(lambda z, m: fn(z, m, *_net(z, m)))


def net(name, fn, ctes, body):
    add(name, on_net(fn), o.q(ctes, body, True))


def _grid_sql(source: str, expr: str, name: str, kind: str = "INT") -> str:
    return f"SELECT d.r, d.c, CAST(coalesce({expr}, 0) AS {kind}) AS {name} FROM dem d LEFT JOIN {source} USING (r, c)"


net("streams", lambda z, m, f, a, s: s, o.FLOW, "SELECT d.r, d.c, CAST(CASE WHEN acc > 5 THEN 1 ELSE 0 END AS INT) AS stream FROM dem d LEFT JOIN acc USING (r, c)")
net("link_id", lambda z, m, f, a, s: streams.link_ids(f, s, m), o.LINKS, _grid_sql("link", "id", "link"))
net("topo_order", lambda z, m, f, a, s: streams.link_ids(f, s, m).withColumnRenamed("link", "tributary"), o.LINKS, _grid_sql("link", "id", "tributary"))
net("link_class", lambda z, m, f, a, s: streams.link_ids(f, s, m).select("r", "c", F.col("link").cast("double").alias("class")), o.LINKS, _grid_sql("link", "id", "class", "DOUBLE"))
_LS = f"{o.LINKS}, ls AS (SELECT l.id AS link, CAST(count(*) AS INT) AS cells, count(*)::DOUBLE AS length, (max(z) - min(z))/count(*) AS slope, sum(CASE WHEN k.id = l.id THEN step ELSE 0.0 END) AS path_length FROM link l JOIN dem USING (r, c) JOIN sp USING (r, c) LEFT JOIN link k ON k.r = sp.dr_ AND k.c = sp.dc_ GROUP BY l.id)"
net("link_length", lambda z, m, f, a, s: streams.link_statistics(f, s, z, m).select("link", "cells", "length", "path_length"), _LS, f"SELECT link, cells, {rd('length')} AS length, {rd('path_length')} AS path_length FROM ls")
net("link_slope", lambda z, m, f, a, s: streams.link_statistics(f, s, z, m).select("link", "slope"), _LS, f"SELECT link, {rd('slope')} AS slope FROM ls")
net("stream_slope", lambda z, m, f, a, s: flow.drop_slope(f, m, z).join(s, ["r", "c"]).select("r", "c", F.when(F.col("stream") > 0, F.col("fall")).otherwise(0.0).alias("fall")), o.STREAMS, f"SELECT d.r, d.c, {rd('CASE WHEN s.r IS NULL THEN 0.0::DOUBLE ELSE (d.z - e.z)/p.step END')} AS fall FROM dem d LEFT JOIN st5 s USING (r, c) LEFT JOIN walk_p p ON p.r = d.r AND p.c = d.c AND p.pr IS NOT NULL LEFT JOIN dem e ON e.r = p.pr AND e.c = p.pc")
_STRA = f"{o.STREAMS}, {o.strahler_levels()}"
net("strahler", lambda z, m, f, a, s: streams.strahler(f, s, m), _STRA, _grid_sql("stra", "o", "strahler"))
net("shreve", lambda z, m, f, a, s: streams.shreve(f, s, m), f"{o.STREAMS}, sh AS (SELECT w.r, w.c, count(*) AS n FROM sw w JOIN infl i ON i.r = w.r0 AND i.c = w.c0 WHERE i.n = 0 GROUP BY w.r, w.c)", _grid_sql("sh", "n", "shreve", "BIGINT"))
_HACK = f"{o.STREAMS}, {o.MAIN}, hk AS (SELECT w.r0 AS r, w.c0 AS c, 1 + sum(CASE WHEN e.dr_ IS NOT NULL AND NOT e.main THEN 1 ELSE 0 END) AS n FROM sw w JOIN me e ON e.r = w.r AND e.c = w.c GROUP BY w.r0, w.c0)"
net("hack", lambda z, m, f, a, s: streams.hack(f, s, a, m), _HACK, _grid_sql("hk", "n", "hack"))
net("main_stem", lambda z, m, f, a, s: streams.main_stem(f, s, a, m), f"{_HACK}, stem AS (SELECT r, c, 1 AS one FROM hk WHERE n = 1)", _grid_sql("stem", "one", "main"))
net("horton", lambda z, m, f, a, s: streams.horton(f, s, a, m), f"{_STRA}, {o.MAIN}, ho AS (SELECT w.r0 AS r, w.c0 AS c, arg_min(t.o, w.hop) AS n FROM sw w JOIN me e ON e.r = w.r AND e.c = w.c JOIN stra t ON t.r = w.r AND t.c = w.c WHERE NOT e.main GROUP BY w.r0, w.c0)", _grid_sql("ho", "n", "horton"))
net("short_removed", lambda z, m, f, a, s: streams.remove_short(f, s, z, m, 2.0), _LS, "SELECT d.r, d.c, CAST(CASE WHEN path_length >= 2.0 THEN 1 ELSE 0 END AS INT) AS stream FROM dem d LEFT JOIN link l USING (r, c) LEFT JOIN ls ON ls.link = l.id")
net("isolated_removed", lambda z, m, f, a, s: streams.remove_isolated(f, s, a, m, 12.0), f"{o.STREAMS}, ok AS (SELECT DISTINCT w.r0 AS r, w.c0 AS c FROM walk w JOIN acc a ON a.r = w.r AND a.c = w.c JOIN walk_p p ON p.r = w.r AND p.c = w.c WHERE a.acc >= 12 OR p.leaves)", "SELECT d.r, d.c, CAST(CASE WHEN s.r IS NOT NULL AND k.r IS NOT NULL THEN 1 ELSE 0 END AS INT) AS stream FROM dem d LEFT JOIN st5 s USING (r, c) LEFT JOIN ok k USING (r, c)")
net("main_network", lambda z, m, f, a, s: streams.main_network(f, s, m), o.STREAMS, "SELECT d.r, d.c, CAST(CASE WHEN s.r IS NOT NULL THEN 1 ELSE 0 END AS INT) AS stream FROM dem d LEFT JOIN st5 s USING (r, c)")


def _gap_sql(limit: str) -> str:
    ck = "ck AS (SELECT r, c, CASE WHEN event_type IN ('click','view') THEN 1 ELSE 0 END AS s FROM ev)"
    return f"""{o.d8()}, {o.walk()}, {ck}, gw AS (SELECT w.*, k.s, sum(CASE WHEN hop > 0 THEN k.s ELSE 0 END) OVER (PARTITION BY r0, c0 ORDER BY hop) AS met FROM walk w JOIN ck k ON k.r = w.r AND k.c = w.c JOIN ck b ON b.r = w.r0 AND b.c = w.c0 WHERE b.s = 1),
hit AS (SELECT r0, c0, hop FROM gw WHERE s = 1 AND met = 1 AND hop > 1 AND {limit}), fl AS (SELECT DISTINCT g.r, g.c FROM gw g JOIN hit h ON h.r0 = g.r0 AND h.c0 = g.c0 AND g.hop < h.hop)"""


_GAP = "SELECT k.r, k.c, CAST(CASE WHEN s = 1 OR f.r IS NOT NULL THEN 1 ELSE 0 END AS INT) AS stream FROM ck k LEFT JOIN fl f USING (r, c)"


def _gaps(**limits):
    def run(s, d):
        z = grids.dem(s, d)
        m = meta_of(z)
        return streams.join_gaps(flow.d8(z, m), grids.click_mask(s, d), m, **limits)

    return run


add("gaps_joined", _gaps(distance=3.5), o.q(_gap_sql("len < 3.5"), _GAP, True))
add("gaps_joined_px", _gaps(hops=3), o.q(_gap_sql("hop <= 3"), _GAP, True))
for _k, _e in {"headwaters": "i.n = 0", "junctions": "i.n > 1", "outlets": "sp.dr_ IS NULL"}.items():
    net(_k, (lambda k: lambda z, m, f, a, s: streams.points_of_interest(f, s, m, k))(_k), o.STREAMS, f"SELECT i.r, i.c FROM infl i JOIN sp USING (r, c) WHERE {_e}")
_FIRST = f"{o.STREAMS}, fs AS (SELECT w.r0, w.c0, min(w.hop) AS h FROM walk w JOIN st5 USING (r, c) GROUP BY w.r0, w.c0), ft AS (SELECT w.r0, w.c0, w.r, w.c, w.len FROM walk w JOIN fs USING (r0, c0) WHERE w.hop = h)"
net("dist_to_stream", lambda z, m, f, a, s: flow.above_stream(f, m, s, z).select("r", "c", "dist"), _FIRST, f"SELECT d.r, d.c, {rd('len')} AS dist FROM dem d LEFT JOIN ft ON r0 = d.r AND c0 = d.c")
net("hand", lambda z, m, f, a, s: flow.above_stream(f, m, s, z).select("r", "c", "hand"), _FIRST, f"SELECT d.r, d.c, {rd('d.z - e.z')} AS hand FROM dem d LEFT JOIN ft ON r0 = d.r AND c0 = d.c LEFT JOIN dem e ON e.r = ft.r AND e.c = ft.c")
net("hillslopes", lambda z, m, f, a, s: flow.watersheds(f, m, streams.link_ids(f, s, m).select("r", "c", F.col("link").cast("long").alias("seed"))), f"{o.LINKS}, fl AS (SELECT w.r0, w.c0, arg_min(l.id, w.hop) AS id FROM walk w JOIN link l USING (r, c) GROUP BY w.r0, w.c0)", "SELECT d.r, d.c, CAST(coalesce(id, 0) AS BIGINT) AS watershed FROM dem d LEFT JOIN fl ON r0 = d.r AND c0 = d.c")
_WKT = "'LINESTRING (' || string_agg(x || ' ' || y, ', ' ORDER BY hop) || ')'"
net("segments", lambda z, m, f, a, s: grids.lines_to_wkt(streams.segments(f, s, streams.strahler(f, s, m), m)).select("id", "order", "length", "wkt"), o.SEGMENTS, f"SELECT id, CAST(max(o) AS INT) AS \"order\", {rd('sum(coalesce(sqrt((r-lr)*(r-lr) + (c-lc)*(c-lc)), 0.0::DOUBLE))')} AS length, {_WKT} AS wkt FROM sg GROUP BY id HAVING count(*) >= 2")
net("stream_slope_degrees", lambda z, m, f, a, s: streams.slope_degrees(f, s, z, m), o.STREAMS, f"SELECT d.r, d.c, {rd('CASE WHEN s.r IS NULL THEN 0.0::DOUBLE ELSE coalesce(degrees(atan((d.z - e.z)/p.step)), 0.0::DOUBLE) END')} AS slope FROM dem d LEFT JOIN st5 s USING (r, c) LEFT JOIN walk_p p ON p.r = d.r AND p.c = d.c AND p.pr IS NOT NULL LEFT JOIN dem e ON e.r = p.pr AND e.c = p.pc")
net("class_stream", lambda z, m, f, a, s: s.select("r", "c", local.stream_class(F.col("stream")).alias("class")), o.FLOW, "SELECT d.r, d.c, CAST(CASE WHEN acc > 5 THEN 1 ELSE 0 END AS INT) AS class FROM dem d LEFT JOIN acc USING (r, c)")
add("raster_to_vector", on_net(lambda z, m, f, a, s: grids.lines_to_wkt(streams.raster_to_vector(f, s, m, z)).select("id", "order", "length", "wkt")))

# vectors
_LINES = "li AS (SELECT l_orderkey AS id, (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 100)::DOUBLE AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem), sg AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY k) AS px, lag(y) OVER (PARTITION BY id ORDER BY k) AS py FROM li), ln AS (SELECT id, count(*) AS n, coalesce(sum(sqrt((x-px)*(x-px) + (y-py)*(y-py))), 0.0) AS length FROM sg GROUP BY id)"
add("vector_len", lambda s, d: rounded(grids.order_lines(s, d).select("id", vector.length_of("pts").alias("length"))), o.q(_LINES, f"SELECT CAST(id AS BIGINT) AS id, {rd('length')} AS length FROM ln"))
add("vector_clean", lambda s, d: rounded(vector.clean(grids.order_lines(s, d), 100.0).select("id", "length")), o.q(_LINES, f"SELECT CAST(id AS BIGINT) AS id, {rd('length')} AS length FROM ln WHERE n >= 2 AND length >= 100"))


def _some_lines(s, d):
    """All order lines spread over a wide plane, so that endpoints meet now and then."""
    shift = F.transform("pts", lambda p: F.struct((p["x"] + (F.col("id") % 37) * 300).alias("x"), (p["y"] + (F.col("id") % 41) * 300).alias("y")))
    return grids.order_lines(s, d).withColumn("pts", shift)


_ENDS = f"{_LINES}, ends AS (SELECT l.id, w.which, l.x + (l.id % 37)*300 AS x, l.y + (l.id % 41)*300 AS y FROM li l JOIN ln USING (id) CROSS JOIN (VALUES (0), (1)) w(which) WHERE n >= 2 AND l.k = CASE WHEN which = 0 THEN 1 ELSE n END)"
_NEAR = f"{_ENDS}, grid AS (SELECT *, CAST(floor(x / 1.5::DOUBLE) AS INT) AS qx, CAST(floor(y / 1.5::DOUBLE) AS INT) AS qy FROM ends), ask AS (SELECT id, which, x, y, qx + i.i AS qx, qy + j.j AS qy FROM grid CROSS JOIN range(-1, 2) i(i) CROSS JOIN range(-1, 2) j(j)), near AS (SELECT a.id AS id1, a.which AS which1, b.id AS id2, b.which AS which2, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS distance FROM ask a JOIN grid b ON a.qx = b.qx AND a.qy = b.qy WHERE a.id < b.id)"
add("vector_pairs", lambda s, d: rounded(vector.endpoint_pairs(_some_lines(s, d), 1.5)), o.q(_NEAR, f"SELECT CAST(id1 AS BIGINT) AS id1, which1, CAST(id2 AS BIGINT) AS id2, which2, {rd('distance')} AS distance FROM near WHERE distance < 1.5"))
add("vector_connect", lambda s, d: rounded(vector.connect(grids.order_lines(s, d), 60.0).select("id", vector.length_of("pts").alias("length"))), o.q(_LINES, f"SELECT CAST(id AS BIGINT) AS id, {rd('length')} AS length FROM ln WHERE n >= 2 AND length >= 60"))
add("snap_endpoints", lambda s, d: rounded(vector.snap_endpoints(_some_lines(s, d), 1.5)))

# classes
_BREAK = "br AS (SELECT CASE WHEN b > 100 THEN round_even(b/10, 0)*10 WHEN b > 10 THEN round_even(b, 0) ELSE b END AS b FROM (SELECT max(acc)*1500.0::DOUBLE/3394716.0::DOUBLE AS b FROM acc))"
simple("class_dir", lambda z, m: flow.d8(z, m).select("r", "c", local.direction_class(F.col("dir")).alias("class")), o.d8(), "SELECT f.r, f.c, upper(off.k) AS class FROM fd f LEFT JOIN off ON off.code = f.dir")
simple("class_acc", lambda z, m: local.accumulation_class(flow.accumulate(flow.d8(z, m), m)), f"{o.FLOW}, {_BREAK}", "SELECT d.r, d.c, CAST(CASE WHEN acc > b THEN 1 WHEN acc IS NOT NULL THEN 0 END AS INT) AS class FROM dem d CROSS JOIN br LEFT JOIN acc USING (r, c)", True)
net("class_order", lambda z, m, f, a, s: streams.strahler(f, s, m).select("r", "c", local.order_class(F.col("strahler")).alias("class")), _STRA, _grid_sql("stra", "CASE WHEN o > 10 THEN 10 ELSE o END", "class"))
simple("class_slope", lambda z, m: local.slope_class(terrain.slope(z, m)), o.SLOPE + ", mm AS (SELECT greatest(0.0, min(degrees(rad))) AS lo, max(degrees(rad)) AS hi FROM sl)", "SELECT r, c, CAST(CASE WHEN rad IS NOT NULL THEN greatest(coalesce(least(floor((degrees(rad) - lo)/((hi - lo)/9.0)) + 1, 9), 1), 1) END AS INT) AS class FROM sl CROSS JOIN mm")
simple("class_aspect", lambda z, m: terrain.aspect(z, m).select("r", "c", local.aspect_class(F.col("aspect")).alias("class")), o.ASPECT, "SELECT r, c, CAST(CASE WHEN aspect IS NULL THEN NULL " + " ".join(f"WHEN aspect <= {b} THEN {i + 1}" for i, b in enumerate(local.ASPECT_BOUNDS[:-1])) + " ELSE 10 END AS INT) AS class FROM asp")
simple("class_watershed", lambda z, m: flow.basins(flow.d8(z, m), m).select("r", "c", local.watershed_hue(F.col("basin")).alias("hue")), f"{_END}, ids AS (SELECT r, c, CAST(row_number() OVER (ORDER BY r, c) AS INT) AS id FROM fd WHERE dir = 0)", "SELECT d.r, d.c, CAST(coalesce(id, 0)*137 % 360 AS INT) AS hue FROM dem d LEFT JOIN en ON r0 = d.r AND c0 = d.c LEFT JOIN ids i ON i.r = er AND i.c = ec", True)
simple("class_dem", lambda z, m: local.ramp_position(z), "mm AS (SELECT min(z) AS lo, max(z) AS hi FROM dem)", f"SELECT r, c, {rd('(z - lo)/(hi - lo)')} AS position, CAST(least(floor((z - lo)/(hi - lo)*4), 3) AS INT) AS quarter FROM dem CROSS JOIN mm")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream order summary: elevation, routing, accumulation, streams, Strahler order, slope."""
    cells = grids.dem(spark, sf_dir)
    m = meta_of(cells)
    f, a, s = _net(cells, m)
    j = streams.strahler(f, s, m).filter("strahler > 0").join(a, ["r", "c"]).join(terrain.slope(cells, m), ["r", "c"])
    return rounded(j.groupBy("strahler").agg(F.count(F.lit(1)).alias("cells"), F.max("acc").alias("max_acc"), F.avg("slope").alias("mean_slope")))


add("stream_order_summary", flagship, o.q(f"{_STRA}, {o.SLOPE}", f"SELECT o AS strahler, count(*) AS cells, {rd('max(acc)')} AS max_acc, {rd('avg(degrees(rad))')} AS mean_slope FROM stra JOIN acc USING (r, c) JOIN sl USING (r, c) GROUP BY o", True))
