"""DuckDB statements for the registered queries.

Each statement is assembled from named relations; a relation is included when
its name occurs in the text that needs it. The relations compute with plain
windows and joins, independently of the Spark operators.
"""

from __future__ import annotations

import re

RELATIONS: dict[str, str] = {}


def relation(name: str, sql: str) -> None:
    RELATIONS[name] = sql.strip()


def _used(sql: str) -> list[str]:
    return [n for n in RELATIONS if re.search(rf"\b{n}\b", sql)]


def statement(sql: str) -> str:
    """The query with a WITH clause of every relation it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in _used(RELATIONS[name]):
            if other != name:
                visit(other)
        order.append(name)

    for name in _used(sql):
        visit(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({RELATIONS[n]})" for n in order)
    return f"WITH {ctes}\n{sql.strip()}" if ctes else sql.strip()


# Derived inputs ---------------------------------------------------------------

_LON_M = "(0.001 * 111320.0 * cos(radians(42.0)))"
_SHORT = f"sqrt(667.92*667.92 + {_LON_M}*{_LON_M})"
_LONG = f"sqrt(667.92*667.92 + 4*{_LON_M}*{_LON_M})"


def along(k: str) -> str:
    return f"({_SHORT} * (({k}) - (({k}) // 3)) + {_LONG} * (({k}) // 3))"


def shape(g: str) -> str:
    return f"('678' || lpad(CAST({g} AS VARCHAR), 5, '0'))"


relation("grp", "SELECT DISTINCT user_id // 5 AS g FROM events")
relation("kk", "SELECT CAST(range AS BIGINT) AS k FROM range(25)")
relation("shape_pts", f"""
SELECT {shape('g')} AS shape_id, k + 1 AS seq, 42.02 - 0.006*k AS lat,
       -87.67 + 0.02*(g % 5) + 0.001*(k % 3) AS lon,
       CASE WHEN g % 5 <> 4 THEN round({along('k')} * 3.28084, 1) / 3.28084 END AS dist_m, g, k
FROM grp, kk""")
relation("ev_run", """
SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us0,
       sum(CAST(round(value*100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) * 4 / 100.0 AS d
FROM events""")
relation("pings", f"""
SELECT 'T' || user_id AS trip_id, 'B' || (user_id % 7) AS bus_id, CAST(22 + g % 5 AS VARCHAR) AS route_id,
       CAST(g AS VARCHAR) AS pattern_id, {shape('g')} AS shape_id, event_id, user_id, event_type, value,
       make_timestamp(1704110400000000 + user_id*60000000 + (us - us0) // 900) AS ts,
       42.02 - d/111320.0 AS lat,
       -87.67 + 0.02*(g % 5) + 0.001*((k % 3) + (d/667.92 - k) * CASE WHEN k < 24 THEN ((k+1) % 3) - (k % 3) ELSE 0 END)
         + 0.00003*(event_id % 7 - 3) AS lon, d AS true_m, g
FROM (SELECT *, user_id // 5 AS g, least(24, CAST(floor(d/667.92) AS BIGINT)) AS k FROM ev_run)""")
relation("stops", f"""
SELECT {shape('g')} AS shape_id, CAST(g*1000 + 2*k + near AS VARCHAR) AS stop_id, 'Stop ' || (g*1000 + 2*k + near) AS name,
       round(CASE WHEN near = 0 THEN ({along('k')} + {along('k+1')}) / 2 ELSE {along('k+1')} - 20.0 END, 3) AS dist_m,
       2*k + near AS stop_seq
FROM grp, kk, (VALUES (0), (1)) v(near) WHERE k < 24 AND (near = 0 OR k % 4 = 0)""")
relation("controls", f"""
SELECT {shape('g')} AS shape_id, 1000*(g+1) + k AS node_id, 42.02 - 0.006*k AS lat,
       -87.67 + 0.02*(g % 5) + 0.001*(k % 3) AS lon, round({along('k')}, 3) AS dist_m, 100*(g+1) + k // 6 AS on_way_id,
       CASE WHEN k % 5 IN (0,1) THEN 'traffic_signals' WHEN k % 5 = 2 THEN 'stop' WHEN k % 5 = 3 THEN 'ped_crossing_signal'
            ELSE 'ped_crossing_marked' END AS control_type,
       CASE WHEN k % 6 <> 0 THEN ['Street ' || k] ELSE CAST([] AS VARCHAR[]) END AS cross_street_names, k, g
FROM grp, kk WHERE k BETWEEN 1 AND 23""")

# Map matching -----------------------------------------------------------------

relation("frame0", "SELECT shape_id, sum(lat)/count(*) AS lat0, sum(lon)/count(*) AS lon0, count(dist_m) = count(*) AS has_dist FROM shape_pts GROUP BY 1")
relation("seg0", """
SELECT p.shape_id, p.seq - 1 AS seg_idx, lat0, lon0, has_dist,
       (lon - lon0)*111320.0*cos(radians(lat0)) AS ax, (lat - lat0)*111320.0 AS ay,
       (lead(lon) OVER w - lon0)*111320.0*cos(radians(lat0)) AS bx, (lead(lat) OVER w - lat0)*111320.0 AS "by",
       dist_m, lead(dist_m) OVER w AS dist_b
FROM shape_pts p JOIN frame0 USING (shape_id) WINDOW w AS (PARTITION BY p.shape_id ORDER BY seq)""")
relation("shapes", """
SELECT shape_id, seg_idx, lat0, lon0, ax, ay, bx, "by",
       coalesce(dist_m, sum(len) OVER (PARTITION BY shape_id ORDER BY seg_idx) - len) AS s0,
       coalesce(dist_b - dist_m, len) AS ds,
       coalesce(max(dist_b) OVER (PARTITION BY shape_id), sum(len) OVER (PARTITION BY shape_id)) AS shape_len_m
FROM (SELECT *, sqrt((bx-ax)*(bx-ax) + ("by"-ay)*("by"-ay)) AS len FROM seg0 WHERE bx IS NOT NULL)""")


def snap(points: str, extra: str, partition: str, perp: float = 50.0) -> str:
    return f"""
SELECT * EXCLUDE (rn, d2), sqrt(d2) AS perp_m, coalesce(sqrt(d2) <= {perp}, false) AS on_route FROM (
 SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY d2, seg_idx) AS rn FROM (
  SELECT {extra}, seg_idx, frac, s0 + frac*ds AS dist_m,
    (px-(ax+frac*(bx-ax)))*(px-(ax+frac*(bx-ax))) + (py-(ay+frac*("by"-ay)))*(py-(ay+frac*("by"-ay))) AS d2
  FROM (SELECT *, CASE WHEN (bx-ax)*(bx-ax)+("by"-ay)*("by"-ay) > 0 THEN greatest(0.0, least(1.0,
      ((px-ax)*(bx-ax)+(py-ay)*("by"-ay))/((bx-ax)*(bx-ax)+("by"-ay)*("by"-ay)))) ELSE 0.0 END AS frac
    FROM (SELECT p.*, s.seg_idx, s.s0, s.ds, s.ax, s.ay, s.bx, s."by", (p.lon - s.lon0)*111320.0*cos(radians(s.lat0)) AS px,
       (p.lat - s.lat0)*111320.0 AS py FROM {points} p JOIN shapes s ON p.shape_id = s.shape_id)))) WHERE rn = 1"""


relation("matched", snap("pings", "trip_id, bus_id, route_id, shape_id, event_id, user_id, event_type, value, ts, lat, lon, true_m", "event_id"))
relation("clocked", """
SELECT *, (epoch_us(ts) - epoch_us(t_start)) // 1000 / 1000.0 AS t,
       CAST(sum(CAST(on_route AS BIGINT)) OVER (PARTITION BY trip_id ORDER BY ts, event_id) AS BIGINT) - CAST(on_route AS BIGINT) AS i
FROM (SELECT *, min(ts) OVER (PARTITION BY trip_id) AS t_start, count(*) OVER (PARTITION BY trip_id) AS n_pings,
        CAST(sum(CAST(on_route AS BIGINT)) OVER (PARTITION BY trip_id) AS BIGINT) AS n FROM matched)""")
relation("trace", "SELECT *, dist_m AS d FROM clocked WHERE on_route AND n >= 2")

# Smoothing ----------------------------------------------------------------------


def locreg(src: str, keys: str, bw: str) -> str:
    """Local cubic at every row of src (keys, i, n, t, d, shape_id)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    dets = []
    from itertools import permutations
    for swap in (True, False):
        terms = []
        for p in permutations(range(4)):
            sign = -1 if sum(p[x] > p[y] for x in range(4) for y in range(x + 1, 4)) % 2 else 1
            f = "*".join((f"b{r}" if swap and c == 0 else f"s{r + c}") for r, c in enumerate(p))
            terms.append(("+" if sign > 0 else "-") + f)
        dets.append("".join(terms))
    sums = ", ".join([f"sum(w*u**{k}) AS s{k}" for k in range(7)] + [f"sum(w*u**{k}*y) AS b{k}" for k in range(4)])
    return f"""
SELECT {keys}, shape_id, i, n, t, d, d + CASE WHEN kk_n <= 4 THEN cy ELSE ({dets[0]})/({dets[1]}) END AS x_smooth FROM (
 SELECT {keys}, shape_id, i, n, t, d, {sums}, count(DISTINCT CASE WHEN w > 0 THEN u END) AS kk_n, avg(CASE WHEN u = 0 THEN y END) AS cy
 FROM (SELECT *, CASE WHEN abs(u) < 1 THEN (1-abs(u)*abs(u)*abs(u))**3 ELSE 0.0 END AS w FROM (
  SELECT *, (tj - t) / greatest(max(abs(tj - t)) OVER (PARTITION BY {keys}, i), 1e-9) AS u FROM (
   SELECT {ak}, a.shape_id, a.i, a.n, a.t, a.d, b.t AS tj, b.d - a.d AS y
   FROM (SELECT *, least(CAST({bw} AS BIGINT), n) AS bwe, greatest(0, least(greatest(0, i - least(CAST({bw} AS BIGINT), n)//2) + least(CAST({bw} AS BIGINT), n), n) - least(CAST({bw} AS BIGINT), n)) AS lo FROM {src}) a
   JOIN {src} b ON {on} AND b.i >= a.lo AND b.i < a.lo + a.bwe))) GROUP BY ALL)"""


def pieces(src: str, keys: str) -> str:
    """Knots and Hermite slopes from smoothed rows."""
    inner = "CASE WHEN {d0}*{d1} <= 0 THEN 0.0 ELSE (3*({h0}+{h1}))/((2*{h1}+{h0})/{d0}+({h1}+2*{h0})/{d1}) END"

    def end(h0, d0, h1, d1):
        m = f"(((2*{h0}+{h1})*{d0}-{h0}*{d1})/({h0}+{h1}))"
        return f"CASE WHEN sign({m}) <> sign({d0}) THEN 0.0 WHEN sign({d0}) <> sign({d1}) AND abs({m}) > 3*abs({d0}) THEN 3*{d0} ELSE {m} END"

    slope = f"""CASE WHEN n_knots = 1 THEN 0.0 WHEN n_knots = 2 THEN coalesce(dr, dl)
      WHEN k = 0 THEN {end('hr', 'dr', 'lead(hr) OVER w', 'lead(dr) OVER w')}
      WHEN k = n_knots - 1 THEN {end('hl', 'dl', 'lag(hl) OVER w', 'lag(dl) OVER w')}
      ELSE {inner.format(h0='hl', d0='dl', h1='hr', d1='dr')} END"""
    return f"""
SELECT *, lead(t) OVER w AS t_next, lead(x) OVER w AS x_next, lead(m) OVER w AS m_next FROM (
 SELECT *, {slope} AS m FROM (
  SELECT *, t - lag(t) OVER w AS hl, lead(t) OVER w - t AS hr, (x - lag(x) OVER w)/(t - lag(t) OVER w) AS dl,
    (lead(x) OVER w - x)/(lead(t) OVER w - t) AS dr FROM (
   SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY {keys}) AS n_knots, min(t) OVER (PARTITION BY {keys}) AS t_first,
     max(t) OVER (PARTITION BY {keys}) AS t_last, min(x) OVER (PARTITION BY {keys}) AS x_first, max(x) OVER (PARTITION BY {keys}) AS x_last FROM (
    SELECT {keys}, shape_id, t, avg(xm) AS x FROM (
      SELECT *, max(x_smooth) OVER (PARTITION BY {keys} ORDER BY i) AS xm FROM {src}) GROUP BY ALL)
   WINDOW w AS (PARTITION BY {keys} ORDER BY t)) WINDOW w AS (PARTITION BY {keys} ORDER BY t))
  WINDOW w AS (PARTITION BY {keys} ORDER BY t)) WHERE n_knots >= 2 WINDOW w AS (PARTITION BY {keys} ORDER BY t)"""


relation("smoothed", locreg("trace", "trip_id", "20"))
relation("pieces", pieces("smoothed", "trip_id"))

_H = "(t_next-t)"
_D = f"((x_next-x)/{_H})"
_C2 = f"((3*{_D}-2*m-m_next)/{_H})"
_C3 = f"((m+m_next-2*{_D})/({_H}*{_H}))"


def value_at(t: str) -> str:
    return f"coalesce(x+({t}-t)*(m+({t}-t)*({_C2}+({t}-t)*{_C3})), x)"


def speed_at(t: str) -> str:
    return f"coalesce(m+({t}-t)*(2*{_C2}+3*({t}-t)*{_C3}), m)"


def grid(src: str, keys: str, first: str, last: str, at: str) -> str:
    return f"""
SELECT {keys}, shape_id, i, ts AS t, {value_at('ts')} AS x, {speed_at('ts')}*2.236936292054402 AS v_mph FROM (
 SELECT *, {at} AS ts FROM (
  SELECT *, unnest(range(CAST({first} AS BIGINT), CAST({last} AS BIGINT) + 1)) AS i FROM {src}))"""


_FINAL = "t_next IS NULL"
relation("samples", grid(
    "pieces", "trip_id", "ceil((t-t_first)/2.0)",
    f"CASE WHEN {_FINAL} THEN ceil((t-t_first)/2.0) ELSE ceil((t_next-t_first)/2.0)-1 END",
    "least(t_first + i*2.0, t_last)",
))

# Slow events --------------------------------------------------------------------


def events_from(src: str, keys: str, limit: float = 5.0, min_s: float = 15.0, merge: float = 20.0) -> str:
    return f"""
SELECT {keys}, shape_id, min(t_start) AS t_start, max(t_end) AS t_end, arg_min(x_start, t_start) AS x_start,
       arg_max(x_end, t_start) AS x_end, min(min_v_mph) AS min_v_mph FROM (
 SELECT *, sum(CASE WHEN x_start - px >= {merge} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY t_start) AS e FROM (
  SELECT *, lag(x_end) OVER (PARTITION BY {keys} ORDER BY t_start) AS px FROM (
   SELECT {keys}, shape_id, min(t) AS t_start, max(t) AS t_end, arg_min(x, i) AS x_start, arg_max(x, i) AS x_end, min(v_mph) AS min_v_mph
   FROM (SELECT *, i - row_number() OVER (PARTITION BY {keys} ORDER BY i) AS run FROM {src} WHERE v_mph < {limit})
   GROUP BY {keys}, shape_id, run HAVING max(t) - min(t) >= {min_s}))) GROUP BY {keys}, shape_id, e"""


relation("slow", events_from("samples", "trip_id"))

# Segments -----------------------------------------------------------------------

relation("signals", "SELECT * FROM controls WHERE control_type IN ('traffic_signals','ped_crossing_signal')")
relation("segs", """
SELECT shape_id, 'SIG_' || node_id || '__SIG_' || nn AS seg_id, dist_m AS x_start, nd AS x_end, node_id AS up_node, nn AS down_node, nt AS down_type
FROM (SELECT *, lead(node_id) OVER w AS nn, lead(dist_m) OVER w AS nd, lead(control_type) OVER w AS nt FROM signals
      WINDOW w AS (PARTITION BY shape_id ORDER BY dist_m, node_id)) WHERE nn IS NOT NULL""")
relation("near_stops", """
SELECT s.*, c.node_id IS NOT NULL AS is_near_side, c.node_id AS signal_node_id, c.dist_m - s.dist_m AS signal_gap_m FROM stops s
LEFT JOIN (SELECT s.stop_id, min(c.dist_m) AS cd FROM stops s JOIN signals c ON c.shape_id = s.shape_id AND c.dist_m >= s.dist_m
  AND c.dist_m - s.dist_m <= 90/3.28084 GROUP BY 1) m ON m.stop_id = s.stop_id
LEFT JOIN signals c ON c.shape_id = s.shape_id AND c.dist_m = m.cd""")
relation("seg_stops", """
SELECT t.*, g.seg_id, g.x_start, g.x_end FROM near_stops t JOIN segs g ON t.shape_id = g.shape_id AND t.dist_m > g.x_start AND t.dist_m <= g.x_end""")
relation("seg_controls", """
SELECT c.*, g.seg_id, g.x_start, g.x_end FROM controls c JOIN segs g ON c.shape_id = g.shape_id AND c.dist_m > g.x_start AND c.dist_m < g.x_end""")
relation("zones", """
SELECT s.*, greatest(dist_m - 30.0, x_start, (SELECT max(c.dist_m) FROM seg_controls c WHERE c.shape_id = s.shape_id AND c.seg_id = s.seg_id AND c.dist_m >= s.dist_m - 30.0 AND c.dist_m < s.dist_m)) AS zone_lo,
       least(dist_m + 10.0, x_end, (SELECT min(c.dist_m) FROM seg_controls c WHERE c.shape_id = s.shape_id AND c.seg_id = s.seg_id AND c.dist_m > s.dist_m AND c.dist_m <= s.dist_m + 10.0)) AS zone_hi
FROM seg_stops s""")

# Times and causes ---------------------------------------------------------------


def times_from(src: str, keys: str, name: str) -> str:
    """Observed times by searching 4000 even samples of every trip."""
    on = " AND ".join(f"p.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    pk = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    relation(f"even_{name}", grid(
        src, keys, f"CASE WHEN {_FINAL} THEN 3999 ELSE ceil((t-t_first)/((t_last-t_first)/3999.0)) END",
        f"CASE WHEN {_FINAL} THEN 3999 ELSE least(ceil((t_next-t_first)/((t_last-t_first)/3999.0))-1, 3998) END",
        "CASE WHEN i = 3999 THEN t_last ELSE t_first + i*((t_last-t_first)/3999.0) END",
    ))
    relation(f"even2_{name}", f"SELECT *, lead(t) OVER w AS tn, lead(x) OVER w AS xn FROM even_{name} WINDOW w AS (PARTITION BY {keys} ORDER BY i)")
    relation(f"at_{name}", f"""
SELECT {pk}, p.shape_id, q.pos_m, CASE WHEN x_last < q.pos_m THEN t_last WHEN x_first >= q.pos_m THEN t_first
   WHEN x_last <= q.pos_m + 1e-6 THEN t_last ELSE e.tt END AS t_at
FROM (SELECT {keys}, shape_id, min(x) AS x_first, max(x) AS x_last, min(t_first) AS t_first, max(t_last) AS t_last FROM {src} GROUP BY ALL) p
JOIN (SELECT DISTINCT shape_id, x_start AS pos_m FROM segs UNION SELECT shape_id, x_end FROM segs) q ON p.shape_id = q.shape_id
LEFT JOIN (SELECT {keys}, z.pos_m, CASE WHEN xn = x THEN t ELSE t + greatest(0.0, least(1.0, (z.pos_m - x)/(xn - x)))*(tn - t) END AS tt
   FROM even2_{name} s JOIN (SELECT DISTINCT shape_id, x_start AS pos_m FROM segs UNION SELECT shape_id, x_end FROM segs) z
   ON s.shape_id = z.shape_id AND s.x <= z.pos_m + 1e-6 AND s.xn > z.pos_m + 1e-6) e
 ON {on.replace('q.', 'e.')} AND e.pos_m = q.pos_m""")
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    ab = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT {ak}, a.shape_id, g.seg_id, g.x_start, g.x_end, g.down_node, a.t_at AS t_in, b.t_at AS t_out, b.t_at - a.t_at AS t_obs
FROM segs g JOIN at_{name} a ON a.shape_id = g.shape_id AND a.pos_m = g.x_start
JOIN at_{name} b ON b.shape_id = g.shape_id AND b.pos_m = g.x_end AND {ab}"""


relation("seg_times", times_from("pieces", "trip_id", "trip"))
relation("freeflow", "SELECT shape_id, seg_id, quantile_cont(t_obs, 0.05) AS t_ff FROM seg_times WHERE t_obs > 0 AND CAST(substr(trip_id, 2) AS BIGINT) % 3 = 0 GROUP BY 1, 2")


_ZONE_DWELL = """
(SELECT arg_min({'s': z.stop_id, 'n': z.is_near_side}, z.dist_m) FROM zones z WHERE z.shape_id = p.shape_id AND z.seg_id = p.seg_id AND p.x_start <= z.zone_hi AND p.x_end >= z.zone_lo)"""


def causes_from(slow: str, times: str, keys: str, name: str, dwell: str = _ZONE_DWELL) -> str:
    on = " AND ".join(f"e.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    ek = ", ".join(f"e.{k.strip()}" for k in keys.split(","))
    relation(f"pairs_{name}", f"""
SELECT e.*, s.seg_id, s.x_start AS seg_start, s.x_end AS seg_end, s.down_node, s.t_in, s.t_out,
       least(e.t_end, s.t_out) - greatest(e.t_start, s.t_in) AS in_seg_s
FROM {slow} e JOIN {times} s ON {on} AND least(e.t_end, s.t_out) > greatest(e.t_start, s.t_in)""")
    relation(f"primary_{name}", f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, t_start ORDER BY in_seg_s DESC, seg_start) AS rn FROM pairs_{name}) WHERE rn = 1""")
    relation(f"named_{name}", f"""
SELECT *, CASE WHEN dw IS NOT NULL THEN 'dwell' WHEN cx IS NOT NULL THEN 'crossing' WHEN sg THEN 'signal_uniform' ELSE 'slowdown' END AS cat0,
  CASE WHEN dw IS NOT NULL THEN dw.s WHEN cx IS NOT NULL THEN 'CX_' || cx WHEN sg THEN 'SIG_' || down_node END AS fac0,
  coalesce(dw.n, false) AS dwell_near_signal FROM (
 SELECT p.*, x_start <= seg_end + 10 AND x_end >= seg_end - 91.44 AS sg,
  {dwell} AS dw,
  (SELECT arg_min(c.node_id, c.dist_m) FROM seg_controls c WHERE c.shape_id = p.shape_id AND c.seg_id = p.seg_id
     AND c.control_type NOT IN ('traffic_signals','ped_crossing_signal') AND p.x_start <= c.dist_m + 10 AND p.x_end >= c.dist_m - 50) AS cx
 FROM primary_{name} p)""")
    w = f"OVER (PARTITION BY {keys}, seg_id ORDER BY t_start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"""
SELECT {keys}, shape_id, t_start, t_end, x_start, x_end, min_v_mph, seg_id, dwell_near_signal, t_end - t_start AS core_s,
  CASE WHEN over THEN 'signal_overflow' ELSE cat0 END AS category, CASE WHEN over THEN nf ELSE fac0 END AS facility_id, cat0 FROM (
 SELECT *, cat0 = 'slowdown' AND coalesce(nc = 'signal_uniform', false) AS over FROM (
  SELECT *, first_value(CASE WHEN cat0 <> 'slowdown' THEN cat0 END IGNORE NULLS) {w} AS nc,
            first_value(CASE WHEN cat0 <> 'slowdown' THEN fac0 END IGNORE NULLS) {w} AS nf FROM named_{name}))"""


relation("attributed", causes_from("slow", "seg_times", "trip_id", "trip"))


def decomposed_from(times: str, attributed: str, pairs: str, keys: str, freeflow: bool = True) -> str:
    on = " AND ".join(f"p.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    tk = " AND ".join(f"t.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    sums = ", ".join(
        f"sum(CASE WHEN category = '{c}' THEN in_seg_s ELSE 0.0 END) AS {n}"
        for n, c in (("t_dwell", "dwell"), ("d_signal_uniform", "signal_uniform"), ("d_signal_overflow", "signal_overflow"), ("d_crossing", "crossing"))
    )
    ff = "f.t_ff" if freeflow else "CAST(NULL AS DOUBLE)"
    join = "LEFT JOIN freeflow f ON f.shape_id = t.shape_id AND f.seg_id = t.seg_id" if freeflow else ""
    return f"""
SELECT *, d_signal_uniform + d_signal_overflow AS d_signal, t_obs - t_ff - t_dwell - d_signal_uniform - d_signal_overflow - d_crossing AS d_congestion FROM (
 SELECT t.* EXCLUDE (down_node), {ff} AS t_ff, coalesce(t_dwell, 0.0) AS t_dwell, coalesce(d_signal_uniform, 0.0) AS d_signal_uniform,
   coalesce(d_signal_overflow, 0.0) AS d_signal_overflow, coalesce(d_crossing, 0.0) AS d_crossing, coalesce(t_dwell_near_signal, 0.0) AS t_dwell_near_signal
 FROM {times} t LEFT JOIN (SELECT {", ".join("p." + k.strip() for k in keys.split(","))}, p.seg_id, {sums},
    sum(CASE WHEN category = 'dwell' AND dwell_near_signal THEN in_seg_s ELSE 0.0 END) AS t_dwell_near_signal
   FROM {pairs} p JOIN {attributed} a ON {on} AND p.t_start = a.t_start GROUP BY ALL) b ON {tk} AND t.seg_id = b.seg_id {join})"""


relation("decomposed", decomposed_from("seg_times", "attributed", "pairs_trip", "trip_id"))
