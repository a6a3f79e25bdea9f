"""DuckDB building blocks for checking the raster queries: the same grids, neighbour joins
instead of window passes, hop-by-hop recursion instead of pointer doubling."""

from __future__ import annotations

from math import cos, pi, radians, sin

DEM = """ev AS (SELECT CAST(event_id // 100 AS INT) AS r, CAST(event_id % 100 AS INT) AS c, event_id, event_type, CAST(value AS DOUBLE) AS value FROM events),
dem AS (SELECT r, c, CASE WHEN event_id % 89 = 7 THEN NULL ELSE 0.5::DOUBLE * r + 2.0::DOUBLE * c + value * 0.125::DOUBLE END AS z FROM ev),
demf AS (SELECT r, c, 0.5::DOUBLE * r + 2.0::DOUBLE * c + value * 0.125::DOUBLE AS z FROM ev),
lev AS (SELECT r, c, floor(z / 4) AS z FROM dem),
ext AS (SELECT max(r) AS mr, max(c) AS mc FROM ev),
off(k, ord, code, dr, dc) AS (VALUES ('e',0,1,0,1),('se',1,2,1,1),('s',2,4,1,0),('sw',3,8,1,-1),('w',4,16,0,-1),('nw',5,32,-1,-1),('n',6,64,-1,0),('ne',7,128,-1,1))"""

KEYS = ("nw", "n", "ne", "w", "e", "sw", "s", "se")


def stencil(name: str, src: str = "dem", col: str = "z", nearest: bool = True) -> str:
    at = "b.r = greatest(0, least(mr, a.r + dr)) AND b.c = greatest(0, least(mc, a.c + dc))" if nearest else "b.r = a.r + dr AND b.c = a.c + dc"
    picks = ", ".join(f"max(CASE WHEN k = '{k}' THEN b.{col} END) AS \"{k}\"" for k in KEYS)
    return f"{name} AS (SELECT a.r, a.c, a.{col} AS z, {picks} FROM {src} a CROSS JOIN off CROSS JOIN ext LEFT JOIN {src} b ON {at} GROUP BY a.r, a.c, a.{col})"


INNER = "(r > 0 AND c > 0 AND r < mr AND c < mc)"
HOLE = {k: f"coalesce({k},0)" for k in KEYS}


def sobel(hole: bool) -> tuple[str, str]:
    v = {k: f"coalesce({k},0.0)" if hole else k for k in KEYS}
    gx = f"((({v['nw']} + 2*{v['w']} + {v['sw']}) - ({v['ne']} + 2*{v['e']} + {v['se']})) / 8.0::DOUBLE)"
    gy = f"((({v['nw']} + 2*{v['n']} + {v['ne']}) - ({v['sw']} + 2*{v['s']} + {v['se']})) / 8.0::DOUBLE)"
    return gx, gy


GX0, GY0 = sobel(True)
GX, GY = sobel(False)
SLOPE = stencil("st") + f", sl AS (SELECT r, c, CASE WHEN {INNER} AND z IS NOT NULL THEN atan(sqrt({GX0}*{GX0} + {GY0}*{GY0})) END AS rad FROM st CROSS JOIN ext)"
ASPECT = stencil("sa") + f", asp AS (SELECT r, c, CASE WHEN z IS NULL THEN NULL WHEN {GX} = 0 AND {GY} = 0 THEN -1.0::DOUBLE ELSE (CASE WHEN 90.0::DOUBLE - degrees(atan2({GY}, -{GX})) < 0 THEN 450.0::DOUBLE - degrees(atan2({GY}, -{GX})) ELSE 90.0::DOUBLE - degrees(atan2({GY}, -{GX})) END) END AS aspect FROM sa)"


def shade(azimuths: tuple[float, ...], altitude: float = 45.0) -> str:
    s, a, up = f"atan(sqrt({GX}*{GX} + {GY}*{GY}))", f"atan2({GY}, -{GX})", repr(radians(altitude))
    parts = [f"greatest(sin({up}::DOUBLE)*sin({s}) + cos({up}::DOUBLE)*cos({s})*cos({radians(450.0 - x)!r}::DOUBLE - {a}), 0.0)*255.0::DOUBLE" for x in azimuths]
    return f"CASE WHEN z IS NOT NULL AND {GX} IS NOT NULL AND {GY} IS NOT NULL THEN ({' + '.join(parts)}) / {float(len(azimuths))}::DOUBLE END"


def grad(src: str, v: str, out_x: str, out_y: str) -> str:
    """Columns of np-style gradients of v over src aliased a, by joins aliased w e n s."""
    gx = f"CASE WHEN w.r IS NULL THEN e.{v} - a.{v} WHEN e.r IS NULL THEN a.{v} - w.{v} ELSE (e.{v} - w.{v}) / 2.0::DOUBLE END AS {out_x}"
    gy = f"CASE WHEN n.r IS NULL THEN s.{v} - a.{v} WHEN s.r IS NULL THEN a.{v} - n.{v} ELSE (s.{v} - n.{v}) / 2.0::DOUBLE END AS {out_y}"
    return f"{gx}, {gy}"


def _cross(src: str) -> str:
    return f"{src} a LEFT JOIN {src} w ON w.r=a.r AND w.c=a.c-1 LEFT JOIN {src} e ON e.r=a.r AND e.c=a.c+1 LEFT JOIN {src} n ON n.r=a.r-1 AND n.c=a.c LEFT JOIN {src} s ON s.r=a.r+1 AND s.c=a.c"


CURVES = f"""g1 AS (SELECT a.r, a.c, a.z, {grad('demf', 'z', 'gx', 'gy')} FROM {_cross('demf')}),
g2 AS (SELECT a.r, a.c, a.z, a.gx, a.gy, {grad('g1', 'gx', 'gxx', 'gxy1')}, {grad('g1', 'gy', 'gyx1', 'gyy')} FROM {_cross('g1')}),
g3 AS (SELECT *, 0.5::DOUBLE*(gxy1 + gyx1) AS gxy, gx*gx + gy*gy AS p, 1.0 + (gx*gx + gy*gy) AS q FROM g2),
g4 AS (SELECT *, gxx*gy*gy - 2.0::DOUBLE*gxy*gx*gy + gyy*gx*gx AS a_, gxx*gx*gx + 2.0::DOUBLE*gxy*gx*gy + gyy*gy*gy AS b_, (1.0+gy*gy)*gxx - 2.0::DOUBLE*gx*gy*gxy + (1.0+gx*gx)*gyy AS m_ FROM g3),
g5 AS (SELECT *, -m_/(2.0::DOUBLE*q*sqrt(q)) AS h_, (gxx*gyy - gxy*gxy)/(q*q) AS k_ FROM g4),
cu AS (SELECT *, sqrt(greatest(0.0::DOUBLE, h_*h_ - k_)) AS d_ FROM g5)"""


def over(a: str, b: str) -> str:
    return f"(CASE WHEN {b} <> 0 THEN ({a})/({b}) WHEN {a} <> 0 THEN 0.0::DOUBLE END)"


_PLAN, _PROFILE = over("a_", "p*sqrt(q)"), over("-b_", "p*q*sqrt(q)")
CURVE_FORMS = {
    "plan": _PLAN, "profile": _PROFILE, "tangential": _PLAN, "mean": "h_", "total": "gxx+gyy", "gaussian": "k_", "maximal": "h_+d_", "minimal": "h_-d_",
    "horizontal_excess": over("a_", "p"), "vertical_excess": over("-b_", "p"), "difference": f"{_PLAN} - {_PROFILE}", "accumulation": f"{over('a_', 'p')} + {over('-b_', 'p')}",
    "curvedness": "sqrt(((h_+d_)*(h_+d_) + (h_-d_)*(h_-d_))/2.0::DOUBLE)", "unsphericity": "d_", "rotor": "((gxx-gyy)*(gxx-gyy) + 4.0::DOUBLE*gxy*gxy)/4.0::DOUBLE",
    "shape_index": "CASE WHEN d_ <> 0 THEN 0.6366197723675814::DOUBLE*atan(h_/d_) END", "ring": "2.0::DOUBLE*h_*k_",
}


def window(name: str, k: int, src: str = "dem", col: str = "z") -> str:
    """Padded (2k+1)^2 windows: n, bad, s, sq, lo, hi, med."""
    return f"""{name} AS (SELECT a.r, a.c, a.{col} AS z, count(b.{col}) AS n, count(*) - count(b.{col}) AS bad, sum(b.{col}) AS s, sum(b.{col}*b.{col}) AS sq, min(b.{col}) AS lo, max(b.{col}) AS hi, median(b.{col}) AS med
FROM {src} a CROSS JOIN ext CROSS JOIN range({-k}, {k + 1}) i(i) CROSS JOIN range({-k}, {k + 1}) j(j) JOIN {src} b ON b.r = greatest(0, least(mr, a.r + i.i)) AND b.c = greatest(0, least(mc, a.c + j.j)) GROUP BY a.r, a.c, a.{col})"""


def offsets(cells: list[tuple[int, int]]) -> str:
    return "(VALUES " + ", ".join(f"({i},{j})" for i, j in cells) + ") o(i, j)"


def d8(src: str = "dem", mode: str = "outlet", name: str = "fd") -> str:
    """Steepest neighbour by an ordered pick over a neighbour join."""
    low = "low" if mode == "lowest" else "0"
    return f"""{name}_n AS (SELECT a.r, a.c, a.z, ord, code, b.z AS nz, (a.z - b.z) / (CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END) AS drop FROM {src} a CROSS JOIN off JOIN {src} b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z IS NOT NULL AND b.z IS NOT NULL),
{name}_b AS (SELECT r, c, max(drop) AS best, arg_max(code, struct_pack(x := drop, y := -ord)) AS steep, arg_min(code, struct_pack(x := nz, y := ord)) AS low FROM {name}_n GROUP BY r, c),
{name} AS (SELECT a.r, a.c, CASE WHEN a.z IS NULL THEN NULL WHEN b.best > 0 THEN b.steep WHEN b.r IS NULL THEN 0 ELSE {low} END AS dir FROM {src} a LEFT JOIN {name}_b b USING (r, c))"""


def walk(flow: str = "fd", name: str = "walk") -> str:
    """All hops of all paths: start cell, visited cell, length so far, hop."""
    return f"""{name}_p AS (SELECT f.r, f.c, f.dir, g.r AS pr, g.c AS pc, CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END AS step, (o.code IS NOT NULL AND (f.r+dr < 0 OR f.c+dc < 0 OR f.r+dr > mr OR f.c+dc > mc)) AS leaves FROM {flow} f CROSS JOIN ext LEFT JOIN off o ON o.code = f.dir LEFT JOIN {flow} g ON g.r = f.r + dr AND g.c = f.c + dc WHERE f.dir IS NOT NULL),
{name} AS (SELECT r AS r0, c AS c0, r, c, 0.0::DOUBLE AS len, 0 AS hop FROM {flow} WHERE dir IS NOT NULL
UNION ALL SELECT w.r0, w.c0, p.pr, p.pc, w.len + p.step, w.hop + 1 FROM {name} w JOIN {name}_p p ON p.r = w.r AND p.c = w.c WHERE p.pr IS NOT NULL)"""


ACC = "acc AS (SELECT r, c, count(*)::DOUBLE AS acc FROM walk GROUP BY r, c)"
FLOW = f"{d8()}, {walk()}, {ACC}"
STREAMS = f"""{FLOW}, st5 AS (SELECT d.r, d.c FROM acc d WHERE acc > 5),
sp AS (SELECT p.r, p.c, p.dir, q.r AS dr_, q.c AS dc_, p.step FROM walk_p p JOIN st5 USING (r, c) LEFT JOIN st5 q ON q.r = p.pr AND q.c = p.pc),
infl AS (SELECT a.r, a.c, count(b.r) AS n FROM sp a LEFT JOIN sp b ON b.dr_ = a.r AND b.dc_ = a.c GROUP BY a.r, a.c),
sw AS (SELECT w.* FROM walk w JOIN st5 s ON s.r = w.r0 AND s.c = w.c0 JOIN st5 t ON t.r = w.r AND t.c = w.c)"""
LINKS = f"""{STREAMS}, heads AS (SELECT r, c, CAST(row_number() OVER (ORDER BY r, c) AS INT) AS id FROM infl WHERE n <> 1),
runs AS (SELECT w.r, w.c, h.id, sum(CASE WHEN i.n <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY w.r0, w.c0 ORDER BY hop) AS k FROM sw w JOIN heads h ON h.r = w.r0 AND h.c = w.c0 JOIN infl i ON i.r = w.r AND i.c = w.c),
link AS (SELECT r, c, id FROM runs WHERE k = 1)"""


def strahler_levels(levels: int = 7) -> str:
    parts = ["s1 AS (SELECT r, c FROM st5)"]
    for k in range(2, levels + 1):
        parts.append(f"m{k} AS (SELECT dr_ AS r, dc_ AS c FROM sp JOIN s{k - 1} USING (r, c) WHERE dr_ IS NOT NULL GROUP BY dr_, dc_ HAVING count(*) > 1), s{k} AS (SELECT DISTINCT w.r, w.c FROM sw w JOIN m{k} m ON m.r = w.r0 AND m.c = w.c0)")
    total = " + ".join(f"(CASE WHEN EXISTS (SELECT 1 FROM s{k} x WHERE x.r = t.r AND x.c = t.c) THEN 1 ELSE 0 END)" for k in range(1, levels + 1))
    return ", ".join(parts) + f", stra AS (SELECT t.r, t.c, CAST({total} AS INT) AS o FROM st5 t)"


MAIN = """me AS (SELECT sp.*, (dr_ IS NOT NULL AND row_number() OVER (PARTITION BY dr_, dc_ ORDER BY acc DESC, (ord + 4) % 8) = 1) AS main FROM sp JOIN acc USING (r, c) JOIN off ON off.code = sp.dir OR (sp.dir = 0 AND off.code = 1))"""


def _spread(name: str, start: str, take: str, extra: str = "") -> str:
    """Rounds in which every cell takes the least of its own value w and what its neighbours
    (b) give it, until none changes; fix_<name> holds the last values."""
    return f"""{name} AS (SELECT r, c, z, {start} AS w, 0 AS k, true AS moved {extra}
UNION ALL SELECT r, c, z, nw, k + 1, bool_or(nw IS DISTINCT FROM w) OVER () FROM (SELECT a.r, a.c, a.z, a.w, a.k, least(a.w, min({take})) AS nw FROM {name} a CROSS JOIN off LEFT JOIN {name} b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.moved GROUP BY a.r, a.c, a.z, a.w, a.k)),
fix_{name} AS (SELECT r, c, any_value(z) AS z, min(w) AS w FROM {name} GROUP BY r, c)"""


def fill(eps: float) -> str:
    return _spread("fi", "CASE WHEN r = 0 OR c = 0 OR r = mr OR c = mc THEN z END", f"CASE WHEN a.z >= b.w THEN a.z WHEN a.z < b.w THEN b.w + {eps!r}::DOUBLE END", "FROM dem CROSS JOIN ext")


FLATS = stencil("fn", "lev", "z", False) + ", " + _spread("fl", 'CASE WHEN least(nw, n, ne, w, e, sw, s, se) < z OR ((r = 0 OR c = 0 OR r = mr OR c = mc) AND z IS NOT NULL) THEN 0 END', "CASE WHEN a.z = b.z THEN b.w + 1 END", "FROM fn CROSS JOIN ext")

#: Accumulation on routing with cycles, whose cells pass nothing on (cycles of up to 400 cells).
CYCLIC = f"""{d8(mode='lowest')}, lp AS MATERIALIZED (SELECT f.r, f.c, g.r AS pr, g.c AS pc FROM fd f LEFT JOIN off o ON o.code = f.dir LEFT JOIN fd g ON g.r = f.r + dr AND g.c = f.c + dc WHERE f.dir IS NOT NULL),
rounds AS (SELECT r AS r0, c AS c0, r, c, 0 AS hop FROM lp UNION ALL SELECT w.r0, w.c0, p.pr, p.pc, hop + 1 FROM rounds w JOIN lp p ON p.r = w.r AND p.c = w.c WHERE p.pr IS NOT NULL AND hop < 400 AND (hop = 0 OR w.r <> w.r0 OR w.c <> w.c0)),
looped AS (SELECT DISTINCT r, c FROM rounds WHERE hop > 0 AND r = r0 AND c = c0),
free AS MATERIALIZED (SELECT * FROM lp WHERE pr IS NOT NULL AND NOT EXISTS (SELECT 1 FROM looped l WHERE l.r = lp.r AND l.c = lp.c)),
wl AS (SELECT r AS r0, c AS c0, r, c FROM lp UNION ALL SELECT w.r0, w.c0, p.pr, p.pc FROM wl w JOIN free p ON p.r = w.r AND p.c = w.c),
acc AS (SELECT r, c, count(*)::DOUBLE AS acc FROM wl GROUP BY r, c)"""

#: What moves along shares shr(r, c, r2, c2, s), round by round.
SHARED = "mv AS (SELECT r, c, 1.0::DOUBLE AS a, 0 AS k FROM dem WHERE z IS NOT NULL UNION ALL SELECT r2, c2, sum(a * s), any_value(k) + 1 FROM mv JOIN shr USING (r, c) GROUP BY r2, c2), acc AS (SELECT r, c, sum(a) AS acc FROM mv GROUP BY r, c)"
FD8 = f"sh AS (SELECT a.r, a.c, b.r AS r2, b.c AS c2, pow((a.z - b.z) / (CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END), 1.1::DOUBLE) AS w FROM dem a CROSS JOIN off JOIN dem b ON b.r = a.r + dr AND b.c = a.c + dc WHERE b.z < a.z), shr AS MATERIALIZED (SELECT r, c, r2, c2, w / sum(w) OVER (PARTITION BY r, c) AS s FROM sh), {SHARED}"
DINF_SHARES = f"""ring(k, dr, dc) AS (VALUES (0,0,1),(1,-1,1),(2,-1,0),(3,-1,-1),(4,0,-1),(5,1,-1),(6,1,0),(7,1,1)),
da AS (SELECT r, c, CASE WHEN ang >= 2*pi() THEN ang - 2*pi() ELSE ang END / (pi()/4) AS q FROM f4 WHERE best > 0),
db AS (SELECT r, c, CAST(floor(q) AS INT) % 8 AS k, 1.0 - (q - floor(q)) AS s FROM da UNION ALL SELECT r, c, (CAST(floor(q) AS INT) + 1) % 8, q - floor(q) FROM da),
shr AS MATERIALIZED (SELECT a.r, a.c, b.r AS r2, b.c AS c2, db.s FROM db JOIN dem a USING (r, c) JOIN ring USING (k) JOIN dem b ON b.r = a.r + dr AND b.c = a.c + dc WHERE db.s > 1e-12 AND b.z < a.z), {SHARED}"""
RHO8 = """rn AS (SELECT a.r, a.c, ord, code, (a.z - b.z) / (CASE WHEN dr <> 0 AND dc <> 0 THEN 2.0::DOUBLE - CAST('0x' || substr(md5(a.r || ',' || a.c || ',' || code || ',1'), 1, 5) AS INT) / 1048576.0::DOUBLE ELSE 1.0::DOUBLE END) AS drop FROM dem a CROSS JOIN off JOIN dem b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z IS NOT NULL AND b.z IS NOT NULL),
rb AS (SELECT r, c, max(drop) AS best, arg_max(code, struct_pack(x := drop, y := -ord)) AS steep FROM rn GROUP BY r, c)"""
SEGMENTS = f"""{LINKS}, {strahler_levels()},
placed AS (SELECT w.r, w.c, h.id, w.hop, sum(CASE WHEN i.n <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY w.r0, w.c0 ORDER BY hop) AS k FROM sw w JOIN heads h ON h.r = w.r0 AND h.c = w.c0 JOIN infl i ON i.r = w.r AND i.c = w.c),
own AS (SELECT p.r, p.c, p.id, p.hop, t.o FROM placed p JOIN stra t USING (r, c) WHERE k = 1),
pts AS (SELECT id, hop, r, c, o FROM own UNION ALL SELECT a.id, a.hop + 1, b.r, b.c, NULL FROM own a JOIN sp ON sp.r = a.r AND sp.c = a.c JOIN own b ON b.r = sp.dr_ AND b.c = sp.dc_ WHERE b.id <> a.id),
sg AS (SELECT *, c + 0.5::DOUBLE AS x, -(r + 0.5::DOUBLE) AS y, lag(r) OVER (PARTITION BY id ORDER BY hop) AS lr, lag(c) OVER (PARTITION BY id ORDER BY hop) AS lc FROM pts)"""


def rays(table: list[tuple[int, int, float, float]], name: str = "ry") -> str:
    rows = ", ".join(f"({k},{i},{dy!r}::DOUBLE,{dx!r}::DOUBLE)" for k, i, dy, dx in table)
    return f"{name}_o(k, i, dy, dx) AS (VALUES {rows}), {name} AS (SELECT a.r, a.c, a.z, k, i, b.z AS v FROM dem a CROSS JOIN {name}_o JOIN dem b ON b.r = round_even(a.r + dy, 0) AND b.c = round_even(a.c + dx, 0) WHERE a.z IS NOT NULL AND b.z IS NOT NULL)"


OPEN_RAYS = [(k, i, -i * cos(k * pi / 4), i * sin(k * pi / 4)) for k in range(8) for i in range(1, 6)]
WIND_RAYS = [(0, i, -i * cos(radians(315.0)), i * sin(radians(315.0))) for i in range(1, 11)]


def q(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{DEM}{', ' if ctes else ''}{ctes} {body}"
