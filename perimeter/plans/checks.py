"""Views the SQL checks are built from: the same domain tables, stated for a SQL engine with
plain joins and without any of the Spark formulations."""

from __future__ import annotations

from perimeter.config import FIXTURE
from perimeter.functions.geo import ALBERS, LAMBERT
from perimeter.operators.cells import disk
from perimeter.plans.registry import view


def albers_sql(lon: str, lat: str) -> tuple[str, str]:
    p = ALBERS
    s = f"sin(radians({lat}))"
    q = (f"(({s} / (1 - {s} * {s} * {p.e2!r}) - ln((1 - {s} * {p.e!r}) / (1 + {s} * {p.e!r})) / (2 * {p.e!r}))"
         f" * (1 - {p.e2!r}))")
    rho = f"(sqrt({p.c!r} - {q} * {p.n!r}) * {p.a / p.n!r})"
    th = f"(radians({lon} - ({p.lon0!r})) * {p.n!r})"
    return f"({rho} * sin({th}))", f"({p.rho0!r} - {rho} * cos({th}))"


def albers_inverse_sql(x: str, y: str) -> tuple[str, str]:
    p = ALBERS
    dy = f"({p.rho0!r} - ({y}))"
    q = f"(({p.c!r} - (({x}) * ({x}) + {dy} * {dy}) * {p.n * p.n / (p.a * p.a)!r}) / {p.n!r})"
    b = f"asin({q} / {p.q(90.0)!r})"
    e2, e4, e6 = p.e2, p.e2**2, p.e2**3
    lat = (f"({b} + sin({b} * 2) * {e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040!r}"
           f" + sin({b} * 4) * {23 * e4 / 360 + 251 * e6 / 3780!r} + sin({b} * 6) * {761 * e6 / 45360!r})")
    return f"(degrees(atan2({x}, {dy}) / {p.n!r}) + ({p.lon0!r}))", f"degrees({lat})"


def lambert_sql(lon: str, lat: str) -> tuple[str, str]:
    p = LAMBERT
    rho = f"({p.r * p.f!r} / pow(tan(radians({lat}) / 2 + pi() / 4), {p.n!r}))"
    th = f"(radians({lon} - ({p.lon0!r})) * {p.n!r})"
    return f"({rho} * sin({th}))", f"({p.rho0!r} - {rho} * cos({th}))"


def lambert_inverse_sql(x: str, y: str) -> tuple[str, str]:
    p = LAMBERT
    dy = f"({p.rho0!r} - ({y}))"
    lat = f"(atan(pow({p.r * p.f!r} / sqrt(({x}) * ({x}) + {dy} * {dy}), {1 / p.n!r})) * 2 - pi() / 2)"
    return f"(degrees(atan2({x}, {dy}) / {p.n!r}) + ({p.lon0!r}))", f"degrees({lat})"


def offsets_sql(offsets) -> str:
    return "(VALUES " + ", ".join(f"({r}, {c})" for r, c in offsets) + ") AS o(dr, dc)"


_X, _Y = albers_sql("longitude", "latitude")
_OUT = FIXTURE.no_data_windows


def outage_overlap(start: str, end: str) -> str:
    tests = [f"({start} <= TIMESTAMP '{b}' + INTERVAL 1 DAY AND {end} >= TIMESTAMP '{a}')" for a, b in _OUT]
    return "(" + " OR ".join(tests) + ")"


def outage_start(ts: str) -> str:
    tests = [f"({ts} >= TIMESTAMP '{a}' AND {ts} < TIMESTAMP '{b}' + INTERVAL 1 DAY)" for a, b in _OUT]
    return "(" + " OR ".join(tests) + ")"


view("v_raw", """
SELECT 'chunk_' || lpad(CAST(d // 5 AS VARCHAR), 2, '0') AS file, event_id AS det_id,
       (3600000 + 36000 * (site // 16) + (event_id * 211) % 3600 + 180 * d) / 100000.0::DOUBLE AS latitude,
       (-12400000 + 45000 * (site % 16) + (event_id * 137) % 4500 + 300 * d) / 100000.0::DOUBLE AS longitude,
       printf('%04d-%02d-%02d', 2023 - site % 9, month(ts), day(ts)) AS acq_date,
       CAST(hour(ts) * 100 + minute(ts) AS INTEGER) AS acq_time,
       CASE WHEN event_type = 'error' OR (site % 12 = 5 AND d BETWEEN 10 AND 12)
                 OR (site % 12 = 7 AND d BETWEEN 8 AND 13) THEN 'Low'
            WHEN event_type = 'purchase' THEN 'h' ELSE ' nominal' END AS confidence,
       value AS frp, CASE WHEN value < 1 THEN 2 ELSE 0 END AS type, 'N' AS satellite
FROM (SELECT *, datediff('day', TIMESTAMP '2024-01-01', ts) AS d, user_id // 12 AS site FROM events)""")
view("v_kept", """
SELECT * FROM v_raw
WHERE CASE lower(substring(trim(confidence), 1, 1)) WHEN 'l' THEN 0 WHEN 'n' THEN 1 WHEN 'h' THEN 2 ELSE -1 END >= 1
  AND type = 0""")
view("v_landed", """
SELECT * FROM v_kept WHERE file <> 'chunk_03' AND NOT (datediff('day', DATE '2015-01-01', CAST(acq_date AS DATE)) % 11 + 11) % 11 BETWEEN 2 AND 5""")
view("v_timed", """
SELECT *, CAST(acq_date || ' ' || lpad(CAST(acq_time // 100 AS VARCHAR), 2, '0') || ':'
               || lpad(CAST(acq_time % 100 AS VARCHAR), 2, '0') || ':00' AS TIMESTAMP) AS acq FROM v_kept""")
view("v_det", f"""
SELECT *, CAST(epoch(acq) AS BIGINT) AS t_s, {_X} AS x, {_Y} AS y
FROM (SELECT *, row_number() OVER (PARTITION BY latitude, longitude, acq ORDER BY file, confidence, frp, det_id) AS rn
      FROM v_timed) WHERE rn = 1""")
view("v_boxed", """
SELECT *, CAST(floor(x / (2000 / sqrt(2.0))) AS BIGINT) AS bx, CAST(floor(y / (2000 / sqrt(2.0))) AS BIGINT) AS by_,
       CAST(floor(t_s / 345600.0) AS BIGINT) AS bt FROM v_det""")
view("v_pairs", """
SELECT a.det_id AS a, b.det_id AS b, a.bt AS abt, a.by_ AS aby, a.bx AS abx, b.bt AS bbt, b.by_ AS bby, b.bx AS bbx
FROM v_boxed a JOIN v_boxed b
  ON b.t_s BETWEEN a.t_s AND a.t_s + 345600 AND (b.t_s > a.t_s OR b.det_id > a.det_id)
 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4000000.0""")
view("v_links", """
SELECT DISTINCT abt, aby, abx, bbt, bby, bbx FROM v_pairs WHERE (abt, aby, abx) <> (bbt, bby, bbx)""")
view("v_vertex", """
SELECT bt, by_, bx, row_number() OVER (ORDER BY bt, by_, bx) AS v FROM (SELECT DISTINCT bt, by_, bx FROM v_boxed)""")
view("v_edge", """
SELECT p.v AS a, q.v AS b FROM v_links l
JOIN v_vertex p ON (l.abt, l.aby, l.abx) = (p.bt, p.by_, p.bx)
JOIN v_vertex q ON (l.bbt, l.bby, l.bbx) = (q.bt, q.by_, q.bx)""")
view("v_both", "SELECT a, b FROM v_edge UNION SELECT b, a FROM v_edge")
view("v_reach", "SELECT v, v AS r FROM v_vertex UNION SELECT v_reach.v, e.b FROM v_reach JOIN v_both e ON v_reach.r = e.a")
view("v_label", "SELECT v, min(r) AS comp FROM v_reach GROUP BY v")
view("v_point", """
SELECT d.*, l.comp FROM v_boxed d JOIN v_vertex x ON (d.bt, d.by_, d.bx) = (x.bt, x.by_, x.bx)
JOIN v_label l ON l.v = x.v""")
view("v_comp", """
SELECT comp, count(*) AS n_detections, min(acq) AS start_ts, max(acq) AS end_ts, avg(latitude) AS lat,
       avg(longitude) AS lon, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max,
       max(frp) AS frp_max, count(DISTINCT t_s // 86400) AS n_timesteps, arg_min(det_id, (t_s, det_id)) AS root_id
FROM v_point GROUP BY comp""")
view("v_events", f"""
SELECT *, row_number() OVER (ORDER BY start_ts, root_id) - 1 AS event, year(start_ts) AS year,
       printf('%d_%04d', year(start_ts), row_number() OVER (PARTITION BY year(start_ts) ORDER BY start_ts, root_id)) AS fire_id,
       (epoch(end_ts) - epoch(start_ts)) / 3600 AS duration_h,
       CAST(round_even((x_max - x_min) / 100, 0) AS INTEGER) AS extent_px_x,
       CAST(round_even((y_max - y_min) / 100, 0) AS INTEGER) AS extent_px_y,
       n_detections >= {FIXTURE.min_detections} AND n_timesteps >= {FIXTURE.min_timesteps} AS keep,
       {outage_overlap('start_ts', 'end_ts')} AS touches_no_data
FROM v_comp""")
view("v_lab", "SELECT p.*, e.event, e.fire_id FROM v_point p JOIN v_events e ON e.comp = p.comp WHERE e.keep")
view("v_grid", f"""
SELECT fire_id, x0, y1, CAST((x1 - x0) // 100 AS INTEGER) AS width, CAST((y1 - y0) // 100 AS INTEGER) AS height
FROM (SELECT fire_id, CAST(floor((x_min - {FIXTURE.grid_margin_m}) / 100) * 100 AS BIGINT) AS x0,
             CAST(ceil((x_max + {FIXTURE.grid_margin_m}) / 100) * 100 AS BIGINT) AS x1,
             CAST(floor((y_min - {FIXTURE.grid_margin_m}) / 100) * 100 AS BIGINT) AS y0,
             CAST(ceil((y_max + {FIXTURE.grid_margin_m}) / 100) * 100 AS BIGINT) AS y1 FROM v_events WHERE keep)""")
view("v_bins", "SELECT fire_id, t_s // 86400 AS bin, count(*) AS n FROM v_lab GROUP BY ALL")
view("v_spine", """
SELECT fire_id, UNNEST(range(b0, b1 + 1)) AS bin, b0
FROM (SELECT fire_id, min(bin) AS b0, max(bin) AS b1 FROM v_bins GROUP BY fire_id)""")
view("v_win", f"""
SELECT *, n_det > 0 AND NOT gap_flag AND NOT no_data AS usable FROM (
  SELECT s.fire_id, CAST(s.bin - s.b0 AS INTEGER) AS t_index, s.bin,
         TIMESTAMP '1970-01-01' + to_days(CAST(s.bin AS INTEGER)) AS window_time, coalesce(b.n, 0) AS n_det,
         coalesce((s.bin - p.prev) * 24, 0) AS gap_h, coalesce((s.bin - p.prev) * 24, 0) > 48 AS gap_flag,
         {outage_start("(TIMESTAMP '1970-01-01' + to_days(CAST(s.bin AS INTEGER)))")} AS no_data
  FROM v_spine s LEFT JOIN v_bins b USING (fire_id, bin)
  LEFT JOIN (SELECT s.fire_id, s.bin, max(b.bin) AS prev FROM v_spine s JOIN v_bins b
             ON b.fire_id = s.fire_id AND b.bin < s.bin GROUP BY ALL) p ON p.fire_id = s.fire_id AND p.bin = s.bin)""")
view("v_pts", """
SELECT DISTINCT l.fire_id, CAST(l.t_s // 86400 - s.b0 AS INTEGER) AS t_index,
       CAST(floor((g.y1 - l.y) / 100) AS INTEGER) AS row, CAST(floor((l.x - g.x0) / 100) AS INTEGER) AS col
FROM v_lab l JOIN v_grid g USING (fire_id) JOIN (SELECT DISTINCT fire_id, b0 FROM v_spine) s USING (fire_id)""")
view("v_dil", f"SELECT DISTINCT fire_id, t_index, row + dr AS row, col + dc AS col FROM v_pts, {offsets_sql(disk(2))}")
view("v_wide", f"SELECT DISTINCT fire_id, t_index, row + dr AS row, col + dc AS col FROM v_dil, {offsets_sql(disk(4))}")
view("v_burn", f"""
SELECT fire_id, t_index, row, col FROM (
  SELECT fire_id, t_index, row + dr AS row, col + dc AS col, count(*) AS n FROM v_wide, {offsets_sql(disk(4))}
  GROUP BY ALL) WHERE n = {len(disk(4))}""")
view("v_first", "SELECT fire_id, row, col, min(t_index) AS first_t FROM v_burn GROUP BY ALL")

P, ST, TS = FIXTURE.patch, FIXTURE.stride, FIXTURE.t_steps


def origins_sql(lo: str, hi: str, n: str) -> str:
    last = f"({n} - {P})"
    start = f"greatest(0, least({lo}, {last}))"
    tail = f"greatest(0, least({hi} - {P} + 1, {last}))"
    regular = f"range({start}, least({hi}, {last}) + 1, {ST})"
    covering = f"CASE WHEN list_last({regular}) < {tail} THEN list_append({regular}, {tail}) ELSE {regular} END"
    return (f"CASE WHEN {n} <= {P} THEN [0] WHEN {hi} - {lo} + 1 <= {P}"
            f" THEN [greatest(0, least(({lo} + {hi}) // 2 - {P // 2}, {last}))]"
            f" ELSE {covering} END")


view("v_target", """
SELECT b.fire_id, b.t_index - 1 AS t_index, b.row, b.col FROM v_burn b WHERE b.t_index >= 1 AND NOT EXISTS (
  SELECT 1 FROM v_burn p WHERE p.fire_id = b.fire_id AND p.row = b.row AND p.col = b.col AND p.t_index < b.t_index)""")
view("v_bbox", """
SELECT fire_id, t_index, min(row) AS r_min, max(row) AS r_max, min(col) AS c_min, max(col) AS c_max
FROM v_burn GROUP BY ALL""")
view("v_cand", f"""
SELECT w.fire_id, w.t_index, w.window_time, b.* EXCLUDE (fire_id, t_index), g.* EXCLUDE (fire_id)
FROM (SELECT *, lead(usable) OVER (PARTITION BY fire_id ORDER BY t_index) AS next_usable FROM v_win) w
JOIN v_bbox b USING (fire_id, t_index) JOIN v_grid g USING (fire_id)
JOIN (SELECT DISTINCT fire_id, t_index FROM v_target) t USING (fire_id, t_index)
WHERE w.usable AND w.next_usable AND w.t_index >= {TS - 1}""")
view("v_tile", f"""
SELECT *, UNNEST({origins_sql('c_min', 'c_max', 'width')}) AS col0 FROM (
  SELECT *, UNNEST({origins_sql('r_min', 'r_max', 'height')}) AS row0 FROM v_cand)""")
view("v_mark", """
SELECT fire_id, t_index, row, col, 0 AS y FROM v_burn UNION ALL SELECT fire_id, t_index, row, col, 1 FROM v_target""")
view("v_index", f"""
SELECT t.fire_id, t.t_index, t.window_time, CAST(t.row0 AS INTEGER) AS row0, CAST(t.col0 AS INTEGER) AS col0,
       CAST(t.x0 + t.col0 * 100 AS DOUBLE) AS x0_m, CAST(t.y1 - t.row0 * 100 AS DOUBLE) AS y1_m,
       count(*) FILTER (m.y = 0) AS n_active_px, count(*) FILTER (m.y = 1) AS n_target_px,
       coalesce(bool_or(m.y = 1 AND (m.row IN (t.row0, t.row0 + {P - 1}) OR m.col IN (t.col0, t.col0 + {P - 1}))), false)
         AS tile_clipped,
       t.fire_id || ':' || t.t_index || ':' || t.row0 || ':' || t.col0 AS sample_id
FROM v_tile t JOIN v_mark m ON m.fire_id = t.fire_id AND m.t_index = t.t_index
 AND m.row BETWEEN t.row0 AND t.row0 + {P - 1} AND m.col BETWEEN t.col0 AND t.col0 + {P - 1}
GROUP BY t.fire_id, t.t_index, t.window_time, t.row0, t.col0, t.x0, t.y1""")


def tile_join(cells: str, extra: str, on: str) -> str:
    """Cells of a view inside the tiles of the index."""
    return f"""SELECT s.sample_id, s.fire_id, s.t_index AS t, b.row - s.row0 AS r, b.col - s.col0 AS c, {extra}
FROM v_index s JOIN {cells} b ON b.fire_id = s.fire_id AND {on}
 AND b.row BETWEEN s.row0 AND s.row0 + {P - 1} AND b.col BETWEEN s.col0 AND s.col0 + {P - 1}"""


view("v_cum", tile_join("v_first", "b.first_t", "b.first_t <= s.t_index"))
view("v_y", tile_join("v_first", "b.first_t", "b.first_t = s.t_index + 1"))
_N4 = "(VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) AS o(dr, dc)"
view("v_ring0", "SELECT sample_id, r, c FROM v_cum")
for _k in range(1, 9):
    view(f"v_ring{_k}", f"""SELECT DISTINCT sample_id, r + dr AS r, c + dc AS c FROM v_ring{_k - 1}, {_N4}
WHERE r + dr BETWEEN 0 AND {P - 1} AND c + dc BETWEEN 0 AND {P - 1}""")


def ring_counts(k: int) -> str:
    pred = "SELECT * FROM v_ring0" if k == 0 else f"SELECT * FROM v_ring{k} EXCEPT SELECT * FROM v_ring0"
    name = "persistence" if k == 0 else f"ring{k}"
    return f"""SELECT '{name}' AS baseline, sample_id, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp,
 count(*) FILTER (y AND NOT p) AS fn FROM (
  SELECT coalesce(p.sample_id, y.sample_id) AS sample_id, p.r IS NOT NULL AS p, y.r IS NOT NULL AS y
  FROM ({pred}) p FULL JOIN v_y y ON (p.sample_id, p.r, p.c) = (y.sample_id, y.r, y.c)) GROUP BY ALL"""


view("v_base", " UNION ALL ".join(ring_counts(k) for k in (0, 1, 3, 5, 8)))

view("v_scored", """
SELECT *, CAST((dist >= 1)::INT + (dist >= 2)::INT + (dist >= 3)::INT + (dist >= 5)::INT + (dist >= 8)::INT
               + (dist >= 12)::INT + (dist >= 20)::INT + (dist >= 32)::INT AS INTEGER) AS band FROM (
  SELECT l_orderkey AS sample_id, l_suppkey AS fire_id,
         CAST(((l_partkey * 31 + l_linenumber * 17) % 1000) / 1000.0 AS DOUBLE) AS prob,
         l_returnflag = 'R' AS target, l_quantity - 1 AS dist FROM lineitem)""")
view("v_thr", "SELECT UNNEST([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98])::DOUBLE AS threshold")


def counts_sql(keys: str, source: str = "v_scored") -> str:
    k = keys + ", " if keys else ""
    return f"""SELECT {k}threshold, count(*) FILTER (prob > threshold AND target) AS tp,
 count(*) FILTER (prob > threshold AND NOT target) AS fp, count(*) FILTER (NOT prob > threshold AND target) AS fn
FROM {source}, v_thr GROUP BY ALL"""


def csi_sql(keys: str, thr: float, source: str = "v_scored") -> str:
    return f"""SELECT {keys}, count(*) FILTER (prob > {thr} AND target)
 / greatest(count(*) FILTER (prob > {thr} OR target), 1) AS csi FROM {source} GROUP BY {keys}"""


view("v_pooled", "SELECT *, tp / greatest(tp + fp + fn, 1) AS csi FROM (" + counts_sql("") + ")")
view("v_far", "SELECT *, tp / greatest(tp + fp + fn, 1) AS csi FROM (" + counts_sql("", "(SELECT * FROM v_scored WHERE band >= 6)") + ")")
view("v_fire", f"SELECT f.*, s.burned_px FROM ({csi_sql('fire_id', 0.5)}) f JOIN "
               "(SELECT fire_id, count(*) AS burned_px FROM v_scored WHERE target GROUP BY 1) s USING (fire_id)")
view("v_years", """
SELECT o_orderkey AS sample_id, o_custkey AS fire_id, year(o_orderdate) AS year,
       CAST(floor(o_totalprice) AS BIGINT) % 500 AS n_target, o_orderpriority = '1-URGENT' AS clipped FROM orders""")


def right_closed_sql(value: str, edges: str) -> str:
    return f"CASE WHEN {value} = {edges}[1] THEN 0 ELSE len(list_filter({edges}, lambda e: e < {value})) - 1 END"


def edges_sql(value: str, source: str) -> str:
    return f"(SELECT list_sort(list_distinct(quantile_cont({value}, [0.0, 0.25, 0.5, 0.75, 1.0]))) FROM {source})"

# --- terrain ---------------------------------------------------------------------------------
from perimeter.config import FUEL_CODES  # noqa: E402

_CODES = "[" + ", ".join(str(c) for c in FUEL_CODES) + "]"
view("v_cell", """
SELECT fire_id, height, width, CAST(-y1 // 100 AS INTEGER) + row AS arow, CAST(x0 // 100 AS INTEGER) + col AS acol,
       CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col
FROM (SELECT *, UNNEST(range(width)) AS col FROM (SELECT *, UNNEST(range(height)) AS row FROM v_grid))""")
view("v_land", "SELECT DISTINCT arow, acol, arow + 30000 AS u, acol + 30000 AS v FROM v_cell")
view("v_demtile", """
SELECT arow, acol, printf('t%05d_%05d', u // 50, v // 50) AS tile,
       CASE WHEN (u * 17 + v) % 211 = 0 OR v % 1600 < 12 THEN NULL ELSE 500 + ((u * 13 + v * 7) % 97) * 3 + u * 0.05::DOUBLE END AS value
FROM v_land UNION ALL
SELECT arow, acol, printf('t%05d_%05d', u // 50 - 1, v // 50),
       CASE WHEN (u + v) % 5 = 0 THEN NULL ELSE 1000 + (u % 7) * 10::DOUBLE END FROM v_land WHERE u % 50 < 3""")
view("v_dem", """
SELECT arow, acol, arg_max(value, tile) AS dem FROM v_demtile WHERE value IS NOT NULL GROUP BY ALL""")
view("v_elev", "SELECT c.*, d.dem FROM v_cell c LEFT JOIN v_dem d USING (arow, acol)")
view("v_cover", "SELECT fire_id, avg((dem IS NOT NULL)::INT) AS coverage FROM v_elev GROUP BY 1")
view("v_filled", """
SELECT e.* REPLACE (coalesce(e.dem, m.med) AS dem) FROM v_elev e
JOIN (SELECT fire_id, median(dem) AS med FROM v_elev GROUP BY 1) m USING (fire_id)
WHERE fire_id IN (SELECT fire_id FROM v_cover WHERE coverage >= 0.98)""")
view("v_grad", """
SELECT f.*, (coalesce(e.dem, f.dem) - coalesce(w.dem, f.dem)) / (100.0 * ((e.dem IS NOT NULL)::INT + (w.dem IS NOT NULL)::INT)) AS de,
       -(coalesce(s.dem, f.dem) - coalesce(n.dem, f.dem)) / (100.0 * ((s.dem IS NOT NULL)::INT + (n.dem IS NOT NULL)::INT)) AS dn
FROM v_filled f
LEFT JOIN v_filled e ON e.fire_id = f.fire_id AND e.row = f.row AND e.col = f.col + 1
LEFT JOIN v_filled w ON w.fire_id = f.fire_id AND w.row = f.row AND w.col = f.col - 1
LEFT JOIN v_filled s ON s.fire_id = f.fire_id AND s.row = f.row + 1 AND s.col = f.col
LEFT JOIN v_filled n ON n.fire_id = f.fire_id AND n.row = f.row - 1 AND n.col = f.col""")
view("v_slope", """
SELECT *, degrees(atan(sqrt(de * de + dn * dn))) AS slope, atan2(-de, -dn) AS aspect FROM v_grad""")
view("v_rowmean", """
SELECT f.fire_id, f.row, f.col, avg(g.dem) AS m FROM (SELECT fire_id, row, col, width, UNNEST(range(-3, 4)) AS d FROM v_filled) f
JOIN v_filled g ON g.fire_id = f.fire_id AND g.row = f.row AND g.col = least(greatest(f.col + f.d, 0), f.width - 1)
GROUP BY ALL""")
view("v_focal", """
SELECT f.fire_id, f.row, f.col, avg(g.m) AS m FROM (SELECT fire_id, row, col, height, UNNEST(range(-3, 4)) AS d FROM v_filled) f
JOIN v_rowmean g ON g.fire_id = f.fire_id AND g.col = f.col AND g.row = least(greatest(f.row + f.d, 0), f.height - 1)
GROUP BY ALL""")
view("v_pix", f"""
SELECT prow - 50000 AS prow, pcol - 50000 AS pcol,
       {_CODES}[((prow // 3) * 31 + (pcol // 3) * 17) % 45 + 1] AS code,
       CASE WHEN (prow + pcol * 3) % 17 = 0 THEN NULL ELSE CAST((prow + pcol) % 100 AS DOUBLE) END AS cc,
       CAST((prow * 3 + pcol) % 300 AS DOUBLE) AS ch
FROM (SELECT DISTINCT prow, pcol FROM (SELECT prow, UNNEST(range((v * 100) // 60, (v * 100 + 99) // 60 + 1)) AS pcol
  FROM (SELECT v, UNNEST(range((u * 100) // 60, (u * 100 + 99) // 60 + 1)) AS prow FROM v_land)))""")
view("v_over", """
SELECT *, (least((prow + 1) * 60, (arow + 1) * 100) - greatest(prow * 60, arow * 100))
        * (least((pcol + 1) * 60, (acol + 1) * 100) - greatest(pcol * 60, acol * 100)) AS w FROM (
  SELECT *, CAST(UNNEST(range(CAST(floor(pcol * 60 / 100) AS BIGINT), CAST(ceil((pcol + 1) * 60 / 100) AS BIGINT))) AS INTEGER) AS acol FROM (
    SELECT *, CAST(UNNEST(range(CAST(floor(prow * 60 / 100) AS BIGINT), CAST(ceil((prow + 1) * 60 / 100) AS BIGINT))) AS INTEGER) AS arow
    FROM v_pix))""")
view("v_mode", """
SELECT arow, acol, code FROM (
  SELECT *, row_number() OVER (PARTITION BY arow, acol ORDER BY n DESC, code) AS k FROM (
    SELECT arow, acol, code, sum(w) AS n FROM v_over GROUP BY ALL)) WHERE k = 1""")
view("v_area", """
SELECT arow, acol, sum(w * cc) / sum(w) FILTER (cc IS NOT NULL) AS cc, sum(w * ch) / sum(w) FILTER (ch IS NOT NULL) AS ch
FROM v_over GROUP BY arow, acol""")
view("v_static", f"""
SELECT s.fire_id, s.row, s.col, s.height, s.width, s.dem AS elevation, s.slope,
       CASE WHEN s.slope < 0.1 THEN 0 ELSE sin(s.aspect) END AS aspect_sin,
       CASE WHEN s.slope < 0.1 THEN 0 ELSE cos(s.aspect) END AS aspect_cos, s.dem - f.m AS tpi,
       coalesce(a.cc, 0) AS cc, coalesce(a.ch, 0) / 10 AS ch, coalesce(list_position({_CODES}, m.code), 0) AS fuel_idx, m.code
FROM v_slope s JOIN v_focal f USING (fire_id, row, col) LEFT JOIN v_mode m USING (arow, acol)
LEFT JOIN v_area a USING (arow, acol)""")

# --- weather ---------------------------------------------------------------------------------
_WX, _WY = lambert_sql("longitude", "latitude")
_GLON, _GLAT = lambert_inverse_sql("(ix * 3000.0 - 2700000)", "(iy * 3000.0 - 1600000)")
view("v_wgrid", f"""
SELECT year, iy, ix, {_GLON} + 360 AS longitude, {_GLAT} AS latitude FROM (
  SELECT DISTINCT year, iy, ix0 + dx AS ix FROM (
    SELECT DISTINCT year, iy0 + dy AS iy, ix0 FROM (
      SELECT DISTINCT year(acq) AS year, CAST(round(({_WY} + 1600000) / 3000) AS INTEGER) AS iy0,
             CAST(round(({_WX} + 2700000) / 3000) AS INTEGER) AS ix0 FROM v_det), range(-10, 11) t(dy)), range(-10, 11) u(dx))""")
view("v_wsource", """
SELECT datediff('day', DATE '1970-01-01', make_date(year, 1, 1)) * 24 - 72 + h AS hour, h, iy, ix, longitude, latitude,
       CAST((iy * 7 + ix * 3 + h) % 21 - 10 AS DOUBLE) AS u10,
       CASE WHEN h % 130 = 7 AND ix % 5 = 0 THEN NULL ELSE CAST((iy * 5 + ix * 11 + h * 2) % 21 - 10 AS DOUBLE) END AS v10,
       280.0::DOUBLE + (iy + ix + h) % 25 AS t2m,
       CASE WHEN h % 50 < 5 THEN NULL ELSE 5.0::DOUBLE + (iy * 3 + ix + h * 7) % 90 END AS r2,
       280.0::DOUBLE + (iy + ix + h) % 25 - (iy + h) % 20 AS d2m
FROM v_wgrid, range(0, 816) t(h) WHERE h % 25 <> 0 AND h NOT BETWEEN 400 AND 408""")
_E = "exp(17.625 * ({0} - 273.15) / ({0} - 273.15 + 243.04))"
_RH = f"least(greatest({_E.format('d2m')} / {_E.format('t2m')} * 100, 0), 100)"
view("v_scan", f"""
SELECT hour, iy, ix, ((longitude + 180) % 360) - 180 AS lon, latitude AS lat, u10, v10, t2m, coalesce(r2, {_RH}) AS rh2m,
       r2 IS NULL AND d2m IS NOT NULL AS rh_derived FROM v_wsource
WHERE hour NOT IN (SELECT hour FROM v_wsource WHERE u10 IS NULL OR v10 IS NULL OR t2m IS NULL OR coalesce(r2, d2m) IS NULL)""")
view("v_lagged", """
SELECT DISTINCT fire_id, t_index - s AS k, lag, (bin - s) * 24 - lag AS hour
FROM v_win, (VALUES (0), (1), (2)) a(s), (VALUES (0), (6), (12)) b(lag) WHERE usable""")
view("v_needed", "SELECT DISTINCT fire_id, hour FROM v_lagged")
view("v_hours", "SELECT DISTINCT hour FROM v_scan")


def neighbours(listed: str) -> str:
    return f"""SELECT DISTINCT fire_id, hour + d AS hour FROM {listed}, (VALUES (-1), (1)) t(d)
WHERE hour NOT IN (SELECT hour FROM v_hours) AND (fire_id, hour + d) NOT IN (SELECT fire_id, hour FROM {listed})"""


view("v_rep1", neighbours("v_needed"))
view("v_list1", "SELECT * FROM v_needed UNION ALL SELECT * FROM v_rep1")
view("v_rep2", neighbours("v_list1"))
view("v_wanted", """
SELECT fire_id, hour, 0 AS round FROM v_needed UNION ALL SELECT *, 1 FROM v_rep1 UNION ALL SELECT *, 2 FROM v_rep2""")


def box_sql(corners: str, margin: float) -> str:
    lon, lat = albers_inverse_sql("x", "y")
    return f"""SELECT fire_id, min(lon) - {margin} / (111.0 * greatest(cos(radians(avg(lat))), 0.1)) AS lon_min,
 min(lat) - {margin} / 111.0 AS lat_min, max(lon) + {margin} / (111.0 * greatest(cos(radians(avg(lat))), 0.1)) AS lon_max,
 max(lat) + {margin} / 111.0 AS lat_max FROM (SELECT fire_id, {lon} AS lon, {lat} AS lat FROM ({corners})) GROUP BY fire_id"""


view("v_bounds", box_sql("""SELECT fire_id, x0 + a * width * 100 AS x, y1 - b * height * 100 AS y
 FROM v_grid, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)""", FIXTURE.weather_margin_km))
view("v_crop", """
SELECT fire_id, min(iy) AS iy0, max(iy) AS iy1, min(ix) AS ix0, max(ix) AS ix1 FROM v_bounds b
JOIN (SELECT DISTINCT iy, ix, ((longitude + 180) % 360) - 180 AS lon, latitude AS lat FROM v_wgrid) c
  ON c.lon BETWEEN b.lon_min AND b.lon_max AND c.lat BETWEEN b.lat_min AND b.lat_max GROUP BY fire_id""")
view("v_store", """
SELECT w.fire_id, s.* FROM (SELECT DISTINCT fire_id, hour FROM v_wanted) w JOIN v_crop c USING (fire_id)
JOIN v_scan s ON s.hour = w.hour AND s.iy BETWEEN c.iy0 AND c.iy1 AND s.ix BETWEEN c.ix0 AND c.ix1""")
view("v_filledhour", "SELECT DISTINCT fire_id, hour FROM v_store")
view("v_plan", """
SELECT fire_id, k, lag, hour, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo END AS lo,
       CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN hi END AS hi,
       CASE WHEN lo IS NULL OR hi IS NULL THEN NULL WHEN lo = hi THEN 0.0 ELSE (hour - lo) / (hi - lo)::DOUBLE END AS w FROM (
  SELECT n.fire_id, n.k, n.lag, n.hour, max(f.hour) FILTER (f.hour <= n.hour) AS lo, min(f.hour) FILTER (f.hour >= n.hour) AS hi
  FROM v_lagged n LEFT JOIN v_filledhour f ON f.fire_id = n.fire_id AND f.hour BETWEEN n.hour - 3 AND n.hour + 3 GROUP BY ALL)""")
view("v_badwin", "SELECT DISTINCT fire_id, k FROM v_plan WHERE lo IS NULL")
view("v_sample", """
SELECT i.* FROM v_index i WHERE fire_id IN (SELECT fire_id FROM v_cover WHERE coverage >= 0.98)
  AND (fire_id, t_index) NOT IN (SELECT fire_id, k + d FROM v_badwin, range(0, 3) t(d))""")
view("v_lonlat", f"SELECT DISTINCT fire_id, iy, ix, lon, lat FROM v_store")
_FX, _FY = lambert_sql("lon", "lat")
view("v_proj", f"SELECT fire_id, iy, ix, {_FX} AS x, {_FY} AS y FROM v_lonlat")
view("v_fit", """
SELECT a.fire_id, arg_min(a.x, (a.iy, a.ix)) AS wx0, arg_min(a.y, (a.iy, a.ix)) AS wy0, avg(r.x - a.x) AS dx, avg(b.y - a.y) AS dy,
       greatest(max(r.x - a.x) - avg(r.x - a.x), avg(r.x - a.x) - min(r.x - a.x), max(b.y - a.y) - avg(b.y - a.y),
                avg(b.y - a.y) - min(b.y - a.y)) AS residual,
       min(a.iy) AS iy0, max(a.iy) AS iy1, min(a.ix) AS ix0, max(a.ix) AS ix1 FROM v_proj a
LEFT JOIN v_proj r ON r.fire_id = a.fire_id AND r.iy = a.iy AND r.ix = a.ix + 1
LEFT JOIN v_proj b ON b.fire_id = a.fire_id AND b.iy = a.iy + 1 AND b.ix = a.ix GROUP BY a.fire_id""")
view("v_tcell", f"""
SELECT DISTINCT fire_id, row, CAST(col0 + c AS INTEGER) AS col FROM (
  SELECT fire_id, CAST(row0 + r AS INTEGER) AS row, col0 FROM (SELECT DISTINCT fire_id, row0, col0 FROM v_sample), range({P}) t(r)),
 range({P}) t(c)""")
_CLON, _CLAT = albers_inverse_sql("cx", "cy")
_CX, _CY = lambert_sql("clon", "clat")
view("v_corner", f"""
SELECT fire_id, row, col, CAST(least(floor(r), iy1 - iy0 - 1) + iy0 AS INTEGER) AS qy,
       CAST(least(floor(c), ix1 - ix0 - 1) + ix0 AS INTEGER) AS qx, r - least(floor(r), iy1 - iy0 - 1) AS fr,
       c - least(floor(c), ix1 - ix0 - 1) AS fc FROM (
  SELECT *, least(greatest(({_CY} - wy0) / dy, 0), iy1 - iy0) AS r, least(greatest(({_CX} - wx0) / dx, 0), ix1 - ix0) AS c FROM (
    SELECT *, {_CLON} AS clon, {_CLAT} AS clat FROM (
      SELECT t.fire_id, t.row, t.col, f.wx0, f.wy0, f.dx, f.dy, f.iy0, f.iy1, f.ix0, f.ix1, g.x0 + (t.col + 0.5) * 100 AS cx, g.y1 - (t.row + 0.5) * 100 AS cy
      FROM v_tcell t JOIN v_grid g USING (fire_id) JOIN v_fit f USING (fire_id))))""")
_LERP = ", ".join(f"a.{f} * (1 - p.w) + b.{f} * p.w AS {f}" for f in ("u10", "v10", "t2m", "rh2m"))
_PIV = ", ".join(f"max({f}) FILTER (lag = {x}) AS {f}_lag{x}" for f in ("u10", "v10") for x in (0, 6, 12))
view("v_field", f"""
SELECT fire_id, k, iy, ix, {_PIV}, max(rh2m) FILTER (lag = 0) AS rh2m, max(t2m) FILTER (lag = 0) AS t2m FROM (
  SELECT p.fire_id, p.k, p.lag, a.iy, a.ix, {_LERP} FROM v_plan p
  JOIN v_store a ON a.fire_id = p.fire_id AND a.hour = p.lo
  JOIN v_store b ON b.fire_id = p.fire_id AND b.hour = p.hi AND b.iy = a.iy AND b.ix = a.ix
  WHERE (p.fire_id, p.k) NOT IN (SELECT fire_id, k FROM v_badwin)) GROUP BY ALL""")
_WV = ["u10_lag0", "u10_lag6", "u10_lag12", "v10_lag0", "v10_lag6", "v10_lag12", "rh2m", "t2m"]
_BI = ", ".join(f"(a.{v} * (1 - c.fc) + b.{v} * c.fc) * (1 - c.fr) + (d.{v} * (1 - c.fc) + e.{v} * c.fc) * c.fr AS {v}" for v in _WV)
_TF, _H = "((t2m - 273.15) * 9 / 5 + 32)", "least(greatest(rh2m, 0), 100)"
view("v_wcell", f"""
SELECT *, least(greatest(1.28 * CASE WHEN {_H} < 10 THEN 0.03229 + 0.281073 * {_H} - 0.000578 * {_H} * {_TF}
   WHEN {_H} < 50 THEN 2.22749 + 0.160107 * {_H} - 0.014784 * {_TF}
   ELSE 21.0606 + 0.005565 * {_H} * {_H} - 0.00035 * {_H} * {_TF} - 0.483199 * {_H} END, 1), 40) AS fosberg_10h FROM (
  SELECT c.fire_id, c.row, c.col, a.k, {_BI} FROM v_corner c
  JOIN v_field a ON a.fire_id = c.fire_id AND a.iy = c.qy AND a.ix = c.qx
  JOIN v_field b ON b.fire_id = c.fire_id AND b.k = a.k AND b.iy = c.qy AND b.ix = c.qx + 1
  JOIN v_field d ON d.fire_id = c.fire_id AND d.k = a.k AND d.iy = c.qy + 1 AND d.ix = c.qx
  JOIN v_field e ON e.fire_id = c.fire_id AND e.k = a.k AND e.iy = c.qy + 1 AND e.ix = c.qx + 1)""")

# --- assembled samples -------------------------------------------------------------------------
view("v_cw", """
SELECT w.*, s.elevation - s.em AS elevation_centred, s.slope, s.aspect_sin, s.aspect_cos, s.tpi, s.cc, s.ch, s.fuel_idx,
       f.first_t, (coalesce(f.first_t <= w.k, false))::INT::DOUBLE AS burn_mask
FROM v_wcell w JOIN (SELECT *, avg(elevation) OVER (PARTITION BY fire_id) AS em FROM v_static) s USING (fire_id, row, col)
LEFT JOIN v_first f USING (fire_id, row, col)""")
view("v_step", """
SELECT sample_id, fire_id, t_index AS t, row0, col0, step, t_index - 2 + step AS k FROM v_sample, (VALUES (0), (1), (2)) x(step)""")
view("v_asm", f"""
SELECT s.sample_id, s.step, b.row - s.row0 AS r, b.col - s.col0 AS c, b.* EXCLUDE (fire_id, row, col, k, first_t),
       coalesce(b.first_t = s.t + 1, false) AS target, s.fire_id, s.t
FROM v_step s JOIN v_cw b ON b.fire_id = s.fire_id AND b.k = s.k
 AND b.row BETWEEN s.row0 AND s.row0 + {P - 1} AND b.col BETWEEN s.col0 AND s.col0 + {P - 1}""")
view("v_train", "SELECT a.* FROM v_asm a JOIN v_events e USING (fire_id) WHERE e.year BETWEEN 2015 AND 2020")
CH = FIXTURE.channels
_DIR = {c: g for g in (("u10_lag0", "u10_lag6", "u10_lag12", "v10_lag0", "v10_lag6", "v10_lag12"), ("aspect_sin", "aspect_cos")) for c in g}


def stat_row(c: str) -> str:
    if c == "burn_mask":
        return "SELECT 'burn_mask' AS channel, 0.0 AS mean, 1.0 AS std"
    if c in _DIR:
        members = " + ".join(f"avg({m} * {m})" for m in _DIR[c])
        return f"SELECT '{c}' AS channel, 0.0 AS mean, greatest(sqrt(({members}) / {len(_DIR[c])}), 1e-6) AS std FROM v_train"
    return f"SELECT '{c}' AS channel, avg({c}) AS mean, greatest(stddev_pop({c}), 1e-6) AS std FROM v_train"


view("v_stats", " UNION ALL ".join(stat_row(c) for c in CH))
view("v_tcum", tile_join("v_first", "b.first_t", "b.first_t <= s.t_index").replace("v_index", "v_sample"))
view("v_ty", tile_join("v_first", "b.first_t", "b.first_t = s.t_index + 1").replace("v_index", "v_sample"))
view("v_sid", "SELECT sample_id, fire_id, row_number() OVER (ORDER BY sample_id) AS sid FROM v_sample")
view("v_vert", f"""
SELECT sid, r, c, min((r - br) * (r - br)) AS g FROM (
  SELECT n.sid, b.r AS br, b.c FROM v_tcum b JOIN v_sid n USING (sample_id)), range({P}) t(r) GROUP BY ALL""")
view("v_dist", f"""
SELECT n.sample_id, n.fire_id, d.* EXCLUDE (sid) FROM (
  SELECT sid, CAST(r AS INTEGER) AS r, CAST(x AS INTEGER) AS c, min((x - c) * (x - c) + g) AS d2 FROM v_vert, range({P}) t(x) GROUP BY ALL) d
JOIN v_sid n USING (sid)""")
view("v_tscore", f"""
SELECT sample_id, fire_id, t_index, row0, col0, r, c,
       (((row0 + r) * 31 + (col0 + c) * 17 + t_index * 7 + row0 * 3 + col0 * 5) % 1000) / 1000.0::DOUBLE AS prob
FROM v_sample, range({P}) a(r), range({P}) b(c)""")
view("v_stitch", """
SELECT fire_id, t_index, CAST(row0 + r AS INTEGER) AS row, CAST(col0 + c AS INTEGER) AS col, avg(prob) AS prob, count(*) AS tiles
FROM v_tscore GROUP BY ALL""")
view("v_frame", """
SELECT s.fire_id, s.t_index, s.new_px, b.burned_px, s.pred_px, s.tp / greatest(s.tp + s.fp + s.fn, 1) AS csi FROM (
  SELECT coalesce(p.fire_id, y.fire_id) AS fire_id, coalesce(p.t_index, y.t_index) AS t_index,
         count(*) FILTER (y.row IS NOT NULL) AS new_px, count(*) FILTER (p.prob > 0.70005) AS pred_px, count(*) FILTER (p.prob > 0.70005 AND y.row IS NOT NULL) AS tp,
         count(*) FILTER (p.prob > 0.70005 AND y.row IS NULL) AS fp,
         count(*) FILTER (y.row IS NOT NULL AND NOT coalesce(p.prob > 0.70005, false)) AS fn
  FROM v_stitch p FULL JOIN v_target y ON (p.fire_id, p.t_index, p.row, p.col) = (y.fire_id, y.t_index, y.row, y.col) GROUP BY 1, 2) s
JOIN (SELECT DISTINCT fire_id, t_index FROM v_stitch) w USING (fire_id, t_index)
JOIN (SELECT w.fire_id, w.t_index, count(*) AS burned_px FROM v_win w JOIN v_first f ON f.fire_id = w.fire_id AND f.first_t <= w.t_index
      GROUP BY ALL) b USING (fire_id, t_index)""")
view("v_lines", """
SELECT file, concat_ws(':', msg, CASE WHEN l_quantity = 50 THEN 'x' ELSE CAST(CAST(start AS BIGINT) AS VARCHAR) END, 'd=0', var, level, 'anl') AS value,
       msg, CAST(start AS BIGINT) AS start, var, level, l_quantity = 50 AS bad FROM (
  SELECT l_orderkey AS file, l_quantity, msg, start, CASE msg WHEN 1 THEN 'UGRD' WHEN 2 THEN 'VGRD' WHEN 3 THEN 'TMP' WHEN 4 THEN 'RH' WHEN 5 THEN 'DPT' ELSE 'OTHER' END AS var,
         CASE WHEN msg <= 2 THEN '10 m above ground' ELSE '2 m above ground' END AS level FROM (
    SELECT *, row_number() OVER w AS msg, coalesce(sum(l_quantity * 100) OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)))""")
view("v_msg", """
SELECT file, CAST(msg AS INTEGER) AS msg, start, var, level, coalesce(lead(start) OVER (PARTITION BY file ORDER BY start, msg) - 1, -1) AS "end"
FROM v_lines WHERE NOT bad""")
view("v_found", """
SELECT m.* FROM v_msg m JOIN (SELECT file, bool_or(var = 'RH') AS rh FROM v_msg GROUP BY file) n USING (file)
WHERE var IN ('UGRD', 'VGRD', 'TMP') OR (var = 'RH' AND rh) OR (var = 'DPT' AND NOT rh)""")
view("v_selected", "SELECT * FROM v_found WHERE file IN (SELECT file FROM v_found GROUP BY file HAVING count(*) = 4)")

#: Unburned cells and targets of the training tiles per distance band, empty bands included.
BAND_RATES = """(SELECT CAST(x.band AS INTEGER) AS band, count(q) AS n_pixels, count(y) AS n_positive, count(y) / nullif(count(q), 0) AS base_rate FROM range(9) x(band)
  LEFT JOIN (SELECT (q >= 1)::INT + (q >= 2)::INT + (q >= 3)::INT + (q >= 5)::INT + (q >= 8)::INT + (q >= 12)::INT + (q >= 20)::INT + (q >= 32)::INT AS band, q, y
    FROM (SELECT sqrt(d.d2) AS q, t.r AS y FROM v_dist d JOIN v_events e ON e.fire_id = d.fire_id AND e.year BETWEEN 2015 AND 2020
          LEFT JOIN v_ty t ON (t.sample_id, t.r, t.c) = (d.sample_id, d.r, d.c) WHERE d.d2 > 0)) z ON z.band = x.band GROUP BY x.band)"""
