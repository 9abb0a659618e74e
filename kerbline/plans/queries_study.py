"""Sensitivity, observed-ride, motion and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators import compare, delay, motion, select, sensitivity, smooth
from kerbline.operators.stage import new_path, stage
from kerbline.plans import derived
from kerbline.plans.oracle import _FINAL, causes_from, decomposed_from, events_from, grid, locreg, pieces, relation, times_from
from kerbline.plans.queries_select import door_log, rides_of
from kerbline.plans.registry import query
from kerbline.plans.workspace import TRIP
from kerbline.streaming import live

# Sensitivity study ----------------------------------------------------------------------

_LK = "trip_id, level"
relation("laddered", """
SELECT m.*, l.level FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY ts, event_id) - 1 AS ping_no FROM matched) m
JOIN (SELECT CAST(range AS INT) AS level FROM range(8)) l ON m.ping_no % CAST(pow(2, l.level) AS BIGINT) = 0""")
relation("cadences", """
SELECT trip_id, level, quantile_cont(gap, 0.5) AS cadence_s FROM (SELECT trip_id, level, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY trip_id, level ORDER BY ts, event_id)))/1e6 AS gap FROM laddered) GROUP BY 1, 2""")
relation("ladder", """
SELECT *, (epoch_us(ts) - epoch_us(t_start)) // 1000 / 1000.0 AS t,
  CAST(sum(CAST(on_route AS BIGINT)) OVER (PARTITION BY trip_id, level ORDER BY ts, event_id) AS BIGINT) - CAST(on_route AS BIGINT) AS i FROM (
 SELECT l.*, cadence_s, CAST(round_even(greatest(5.0, least(20.0, 40.0/coalesce(cadence_s, 2.0*pow(2.0, l.level)))), 0) AS INT) AS bandwidth, min(ts) OVER (PARTITION BY l.trip_id, l.level) AS t_start,
  count(*) OVER (PARTITION BY l.trip_id, l.level) AS n_pings, CAST(sum(CAST(on_route AS BIGINT)) OVER (PARTITION BY l.trip_id, l.level) AS BIGINT) AS n
 FROM laddered l JOIN cadences c ON c.trip_id = l.trip_id AND c.level = l.level)""")
relation("l_trace", "SELECT *, dist_m AS d FROM ladder WHERE on_route AND n >= 2")
relation("l_smooth", locreg("l_trace", _LK, "bandwidth"))
relation("l_pieces", pieces("l_smooth", _LK))
relation("l_samples", "SELECT * REPLACE (greatest(v_mph, 0.0) AS v_mph) FROM (" + grid("l_pieces", _LK, "ceil(t)", f"CASE WHEN {_FINAL} THEN floor(t) ELSE ceil(t_next)-1 END", "CAST(i AS DOUBLE)") + ")")
relation("l_events", events_from("l_samples", _LK, min_s=10.0))
relation("l_clip", grid("l_pieces", _LK, "ceil(t-t_first)", f"CASE WHEN {_FINAL} THEN ceil(t-t_first) ELSE ceil(t_next-t_first)-1 END", "least(t_first + i, t_last)"))
relation("l_slow", events_from("l_clip", _LK, min_s=10.0))
relation("l_times", times_from("l_pieces", _LK, "level"))
relation("l_attr", causes_from("l_slow", "l_times", _LK, "level"))
relation("l_rows", decomposed_from("l_times", "l_attr", "pairs_level", _LK, freeflow=False))


def _levels(w):
    if not hasattr(w, "levels"):
        w.ladder = stage(sensitivity.downsample_ladder(w.matched), "ladder")
        w.levels = sensitivity.run_levels(w.ladder, w.segs, w.zones, w.seg_controls)
    return w


def _components(w):
    if not hasattr(w, "components"):
        _levels(w)
        w.components = stage(sensitivity.score(w.levels, derived.door_events(w.spark, w.sf_dir), _clock(w)), "components")
    return w.components


def _clock(w) -> DataFrame:
    return w.clocked.groupBy("trip_id").agg(F.min("t_start").alias("t_start"))


@query("downsample_ladder", "trip_id level event_id t:3 bandwidth cadence_s:s", "SELECT * REPLACE (CAST(round(cadence_s, 3) AS VARCHAR) AS cadence_s) FROM ladder")
def _(w):
    return _levels(w).ladder.withColumn("cadence_s", F.round("cadence_s", 3))


@query("every_nth", "trip_id level n", "SELECT trip_id, level, count(*) AS n FROM laddered GROUP BY 1, 2")
def _(w):
    rows = sensitivity.every_nth(sensitivity.number_pings(w.matched, TRIP), TRIP)
    return rows.groupBy("trip_id", "level").agg(F.count(F.lit(1)).alias("n"))


@query("level_trajectories", "trip_id level k t:3 x:3 m:4", "SELECT * FROM l_pieces")
def _(w):
    return _levels(w).levels["pieces"]


@query("level_events", "trip_id level t_start:3 t_end:3", "SELECT * FROM l_events")
def _(w):
    return _levels(w).levels["events"]


@query("level_success_rate", "level n_trips n_ok ok_share:4", """
SELECT level, count(*) AS n_trips, count(p.trip_id) AS n_ok, avg(CASE WHEN p.trip_id IS NULL THEN 0.0 ELSE 1.0 END) AS ok_share FROM (SELECT DISTINCT trip_id, level FROM ladder) l
LEFT JOIN (SELECT DISTINCT trip_id, level FROM l_pieces) p USING (trip_id, level) GROUP BY 1""")
def _(w):
    return sensitivity.level_success_rate(_levels(w).ladder, w.levels["pieces"])


relation("l_span", """
SELECT s.trip_id, s.level, greatest(a, a0) AS t_lo, least(b, b0) AS t_hi FROM (SELECT trip_id, level, min(i) AS a, max(i) AS b FROM l_samples GROUP BY 1, 2) s
JOIN (SELECT trip_id, min(i) AS a0, max(i) AS b0 FROM l_samples WHERE level = 0 GROUP BY 1) z USING (trip_id) WHERE least(b, b0) > greatest(a, a0)""")
relation("m_grid", """
SELECT v.trip_id, v.level, count(*) AS n_sec, sum(CAST(abs(v.x-b.x) <= 50 AS BIGINT)) AS pos_ok, sum(abs(v.x-b.x)) AS pos_abs_sum, sum(pow(v.x-b.x, 2)) AS pos_sq_sum,
  sum(CAST(abs(v.v_mph-b.v_mph) <= 2.5 AS BIGINT)) AS spd_ok, sum(abs(v.v_mph-b.v_mph)) AS spd_abs_sum, sum(pow(v.v_mph-b.v_mph, 2)) AS spd_sq_sum,
  sum(CAST(b.v_mph < 5 AND v.v_mph < 5 AS BIGINT)) AS tp, sum(CAST(b.v_mph >= 5 AND v.v_mph < 5 AS BIGINT)) AS fp, sum(CAST(b.v_mph < 5 AND v.v_mph >= 5 AS BIGINT)) AS fn
FROM l_samples v JOIN l_samples b ON b.trip_id = v.trip_id AND b.level = 0 AND b.i = v.i GROUP BY 1, 2 HAVING max(v.i) > min(v.i)""")


@query("position_agreement", "trip_id level n_sec:0 pos_ok:0 pos_abs_sum:1 pos_sq_sum:0", "SELECT * FROM m_grid")
def _(w):
    return sensitivity.grid_components(_levels(w).levels["pieces"])


@query("speed_agreement", "trip_id level spd_ok:0 spd_abs_sum:1 spd_sq_sum:0", "SELECT * FROM m_grid")
def _(w):
    return sensitivity.grid_components(_levels(w).levels["pieces"])


@query("slow_state_f1", "trip_id level tp:0 fp:0 fn:0", "SELECT * FROM m_grid")
def _(w):
    return sensitivity.grid_components(_levels(w).levels["pieces"])


relation("e_bench", "SELECT e.trip_id, s.level, e.t_start AS b0, e.t_end AS b1 FROM l_events e JOIN l_span s ON s.trip_id = e.trip_id AND e.level = 0 WHERE greatest(0.0, least(e.t_end, s.t_hi) - greatest(e.t_start, s.t_lo)) >= 0.5*(e.t_end - e.t_start)")
relation("e_var", "SELECT e.trip_id, e.level, e.t_start AS v0, e.t_end AS v1 FROM l_events e JOIN l_span s ON s.trip_id = e.trip_id AND e.level = s.level WHERE greatest(0.0, least(e.t_end, s.t_hi) - greatest(e.t_start, s.t_lo)) >= 0.5*(e.t_end - e.t_start)")
relation("e_pairs", """
SELECT *, row_number() OVER (PARTITION BY trip_id, level ORDER BY ov DESC, b0 DESC, v0 DESC) AS rn FROM (
 SELECT b.trip_id, b.level, b0, b1, v0, v1, least(b1, v1) - greatest(b0, v0) AS ov FROM e_bench b JOIN e_var v ON v.trip_id = b.trip_id AND v.level = b.level AND least(b1, v1) > greatest(b0, v0)
 WHERE least(b1, v1) - greatest(b0, v0) >= 0.5*least(b1-b0, v1-v0))""")
relation("e_greedy", """
WITH RECURSIVE f AS (SELECT trip_id, level, 1 AS rn, [b0] AS ub, [v0] AS uv FROM e_pairs WHERE rn = 1
 UNION ALL SELECT p.trip_id, p.level, p.rn, CASE WHEN list_contains(f.ub, p.b0) OR list_contains(f.uv, p.v0) THEN f.ub ELSE list_append(f.ub, p.b0) END,
   CASE WHEN list_contains(f.ub, p.b0) OR list_contains(f.uv, p.v0) THEN f.uv ELSE list_append(f.uv, p.v0) END
 FROM f JOIN e_pairs p ON p.trip_id = f.trip_id AND p.level = f.level AND p.rn = f.rn + 1)
SELECT trip_id, level, max(len(ub)) AS n FROM f GROUP BY 1, 2""")
relation("m_event", """
SELECT s.trip_id, s.level, coalesce(b.n, 0) AS n_bench_ev, coalesce(v.n, 0) AS n_var_ev, coalesce(g.n, 0) AS n_match_ev FROM l_span s
LEFT JOIN (SELECT trip_id, level, count(*) AS n FROM e_bench GROUP BY 1, 2) b ON b.trip_id = s.trip_id AND b.level = s.level
LEFT JOIN (SELECT trip_id, level, count(*) AS n FROM e_var GROUP BY 1, 2) v ON v.trip_id = s.trip_id AND v.level = s.level
LEFT JOIN e_greedy g ON g.trip_id = s.trip_id AND g.level = s.level""")


@query("match_events", "trip_id level overlap_s:3", "SELECT *, ov AS overlap_s FROM e_pairs")
def _(w):
    return sensitivity.event_pairs(_levels(w).levels["events"], w.levels["spans"])


@query("event_f1", "trip_id level n_bench_ev n_var_ev n_match_ev", "SELECT * FROM m_event")
def _(w):
    return sensitivity.event_components(_levels(w).levels["events"], w.levels["spans"])


_CLIP = "greatest(0.0, least(a.t_end, s.t_hi) - greatest(a.t_start, s.t_lo))"
relation("a_bench", f"SELECT a.trip_id, s.level, category, coalesce(facility_id, '') AS f, sum({_CLIP}) AS sec FROM l_attr a JOIN l_span s ON s.trip_id = a.trip_id AND a.level = 0 WHERE {_CLIP} > 0 GROUP BY 1, 2, 3, 4")
relation("a_var", f"SELECT a.trip_id, s.level, category, coalesce(facility_id, '') AS f, sum({_CLIP}) AS sec FROM l_attr a JOIN l_span s ON s.trip_id = a.trip_id AND a.level = s.level WHERE {_CLIP} > 0 GROUP BY 1, 2, 3, 4")
relation("a_both", """
SELECT coalesce(b.trip_id, v.trip_id) AS trip_id, coalesce(b.level, v.level) AS level, coalesce(b.category, v.category) AS category, coalesce(b.f, v.f) AS facility_id, coalesce(b.sec, 0.0) AS bench, coalesce(v.sec, 0.0) AS var
FROM a_bench b FULL JOIN a_var v ON b.trip_id = v.trip_id AND b.level = v.level AND b.category = v.category AND b.f = v.f""")
relation("m_attr", "SELECT s.trip_id, s.level, coalesce(sum(least(bench, var)), 0.0) AS attr_min_sum, coalesce(sum(greatest(bench, var)), 0.0) AS attr_max_sum FROM l_span s LEFT JOIN a_both a ON a.trip_id = s.trip_id AND a.level = s.level GROUP BY 1, 2")


def _seconds_both(w):
    return sensitivity.attribution_seconds(_levels(w).levels["attributed"], w.levels["spans"])


@query("attribution_outer", "trip_id level category facility_id bench:3 var:3", "SELECT * FROM a_both")
def _(w):
    return _seconds_both(w)


@query("attribution_jaccard", "trip_id level attr_min_sum:3 attr_max_sum:3", "SELECT * FROM m_attr")
def _(w):
    return sensitivity.attribution_components(_seconds_both(w), w.levels["spans"])


relation("clock0", "SELECT trip_id, min(ts) AS t0 FROM pings GROUP BY 1")
relation("doors", "SELECT d.trip_id, d.event_id, d.stop_id, d.event_type, d.dwell_s, (epoch_us(d.ts) - epoch_us(c.t0))/1e6 AS open_s, (epoch_us(d.ts) - epoch_us(c.t0))/1e6 + d.dwell_s AS close_s FROM door_log d JOIN clock0 c USING (trip_id)")
relation("m_door", """
SELECT s.trip_id, s.level, coalesce(n, 0) AS door_sec, coalesce(k, 0) AS door_slow FROM l_span s LEFT JOIN (
 SELECT s.trip_id, s.level, count(*) AS n, sum(CAST(v.v_mph < 5 AS BIGINT)) AS k FROM doors d JOIN l_span s ON s.trip_id = d.trip_id
 JOIN l_samples v ON v.trip_id = s.trip_id AND v.level = s.level AND v.i >= ceil(greatest(open_s, t_lo)) AND v.i <= floor(least(close_s, t_hi))
 WHERE event_type IN (3,4,5) AND dwell_s BETWEEN 10 AND 180 AND least(close_s, t_hi) - greatest(open_s, t_lo) >= 10 GROUP BY 1, 2) x ON x.trip_id = s.trip_id AND x.level = s.level""")


def _doors(w):
    return derived.door_events(w.spark, w.sf_dir)


@query("door_speed", "trip_id level door_sec:0 door_slow:0", "SELECT * FROM m_door")
def _(w):
    _levels(w)
    doors = sensitivity.door_intervals(_doors(w), _clock(w), 10.0, (3, 4, 5))
    return sensitivity.door_speed_components(w.levels["pieces"], w.levels["spans"], doors)


relation("claims", f"SELECT a.* FROM l_attr a JOIN l_span s ON s.trip_id = a.trip_id AND s.level = a.level WHERE category = 'dwell' AND {_CLIP} > 0")
relation("m_dwell", """
WITH t AS (SELECT s.trip_id, s.level, d.event_id, d.stop_id, open_s - 30 AS d0, close_s + 30 AS d1 FROM doors d JOIN l_span s ON s.trip_id = d.trip_id WHERE event_type = 3 AND dwell_s BETWEEN 10 AND 180 AND open_s >= t_lo AND close_s <= t_hi),
r AS (SELECT t.trip_id, t.level, count(*) AS dwell_targets, sum(CAST(EXISTS (SELECT 1 FROM claims c WHERE c.trip_id = t.trip_id AND c.level = t.level AND c.facility_id = t.stop_id AND least(c.t_end, d1) > greatest(c.t_start, d0)) AS BIGINT)) AS dwell_match_id,
  sum(CAST(EXISTS (SELECT 1 FROM claims c WHERE c.trip_id = t.trip_id AND c.level = t.level AND least(c.t_end, d1) > greatest(c.t_start, d0)) AS BIGINT)) AS dwell_match_time FROM t GROUP BY 1, 2),
p AS (SELECT c.trip_id, c.level, count(*) AS dwell_pred, sum(ok) AS dwell_pred_ok, sum(CAST(near AS BIGINT)) AS dwell_pred_near, sum(CAST(near AS BIGINT)*(1-ok)) AS dwell_fp_near FROM (
 SELECT c.trip_id, c.level, c.dwell_near_signal AS near, CAST(EXISTS (SELECT 1 FROM doors d WHERE d.trip_id = c.trip_id AND d.event_type IN (3,4,5) AND d.dwell_s BETWEEN 5 AND 180 AND d.stop_id = c.facility_id AND least(d.close_s, c.t_end + 30) > greatest(d.open_s, c.t_start - 30)) AS BIGINT) AS ok FROM claims c) c GROUP BY 1, 2)
SELECT s.trip_id, s.level, coalesce(dwell_targets, 0) AS dwell_targets, coalesce(dwell_match_id, 0) AS dwell_match_id, coalesce(dwell_match_time, 0) AS dwell_match_time, coalesce(dwell_pred, 0) AS dwell_pred,
  coalesce(dwell_pred_ok, 0) AS dwell_pred_ok, coalesce(dwell_pred_near, 0) AS dwell_pred_near, coalesce(dwell_fp_near, 0) AS dwell_fp_near
FROM l_span s LEFT JOIN r ON r.trip_id = s.trip_id AND r.level = s.level LEFT JOIN p ON p.trip_id = s.trip_id AND p.level = s.level""")


@query("dwell_recall_precision", "trip_id level dwell_targets:0 dwell_match_id:0 dwell_match_time:0 dwell_pred:0 dwell_pred_ok:0 dwell_pred_near:0 dwell_fp_near:0", "SELECT * FROM m_dwell")
def _(w):
    _levels(w)
    serviced = sensitivity.door_intervals(_doors(w), _clock(w), 10.0, (3,))
    active = sensitivity.door_intervals(_doors(w), _clock(w), 5.0, (3, 4, 5))
    return sensitivity.dwell_components(w.levels["attributed"], w.levels["spans"], serviced, active)


relation("components", """
SELECT g.*, n_bench_ev, n_var_ev, n_match_ev, attr_min_sum, attr_max_sum, door_sec, door_slow, dwell_targets, dwell_match_id, dwell_match_time, dwell_pred, dwell_pred_ok, dwell_pred_near, dwell_fp_near FROM m_grid g
JOIN m_event USING (trip_id, level) JOIN m_attr USING (trip_id, level) JOIN m_door USING (trip_id, level) JOIN m_dwell USING (trip_id, level)""")
_RATIOS = """
 100*sum(pos_ok)/nullif(CAST(sum(n_sec) AS DOUBLE), 0) AS m1_position_pct, 100*sum(spd_ok)/nullif(CAST(sum(n_sec) AS DOUBLE), 0) AS m2_speed_pct, 100*2*sum(tp)/nullif(CAST(2*sum(tp)+sum(fp)+sum(fn) AS DOUBLE), 0) AS m3_slow_f1,
 100*2*sum(n_match_ev)/nullif(CAST(sum(n_bench_ev)+sum(n_var_ev) AS DOUBLE), 0) AS m4_event_f1, 100*sum(attr_min_sum)/nullif(sum(attr_max_sum), 0) AS m5_jaccard, 100*sum(door_slow)/nullif(CAST(sum(door_sec) AS DOUBLE), 0) AS m6_door_speed_pct,
 100*sum(dwell_match_id)/nullif(CAST(sum(dwell_targets) AS DOUBLE), 0) AS m7_recall_pct, 100*sum(dwell_pred_ok)/nullif(CAST(sum(dwell_pred) AS DOUBLE), 0) AS m7_precision_pct, sqrt(sum(pos_sq_sum)/sum(n_sec)) AS pos_rmse_m, sum(spd_abs_sum)/sum(n_sec) AS spd_mae_mph"""
_MCOLS = "m1_position_pct:3 m2_speed_pct:3 m3_slow_f1:3 m4_event_f1:3 m5_jaccard:3 m6_door_speed_pct:3 m7_recall_pct:3 m7_precision_pct:3 pos_rmse_m:2 spd_mae_mph:3"
relation("pooled", f"SELECT level, {_RATIOS} FROM components GROUP BY level")
relation("per_trip", f"SELECT trip_id, level, {_RATIOS} FROM components GROUP BY trip_id, level")


@query("pool_metrics", f"level {_MCOLS}", "SELECT * FROM pooled")
def _(w):
    return sensitivity.pool_metrics(_components(w))


@query("per_trip_metrics", f"trip_id level {_MCOLS}", "SELECT * FROM per_trip")
def _(w):
    return sensitivity.per_trip_metrics(_components(w))


@query("complete_trips", "trip_id", "SELECT trip_id FROM components GROUP BY 1 HAVING count(DISTINCT level) = 8")
def _(w):
    return sensitivity.complete_trips(_components(w), 8)


@query("iqr_by_level", "level q25:3 median:3 q75:3", """
SELECT p.level, quantile_cont(100*p.m1_position_pct/b.m1_position_pct, 0.25) AS q25, quantile_cont(100*p.m1_position_pct/b.m1_position_pct, 0.5) AS median, quantile_cont(100*p.m1_position_pct/b.m1_position_pct, 0.75) AS q75
FROM per_trip p JOIN per_trip b ON b.trip_id = p.trip_id AND b.level = 0 GROUP BY 1""")
def _(w):
    return sensitivity.iqr_by_level(sensitivity.per_trip_metrics(_components(w)), "m1_position_pct", normalise=True)


@query("knee", "metric knee_level:s", """
SELECT metric, CASE WHEN k < last THEN k END AS knee_level FROM (SELECT u.metric, max(u.level) AS last, max(CASE WHEN u.value >= 0.9*b.value THEN u.level END) AS k FROM
 (SELECT * FROM (SELECT level, m1_position_pct, m2_speed_pct, m4_event_f1 FROM pooled) UNPIVOT INCLUDE NULLS (value FOR metric IN (m1_position_pct, m2_speed_pct, m4_event_f1))) u
 JOIN (SELECT * FROM (SELECT level, m1_position_pct, m2_speed_pct, m4_event_f1 FROM pooled WHERE level = 0) UNPIVOT INCLUDE NULLS (value FOR metric IN (m1_position_pct, m2_speed_pct, m4_event_f1))) b USING (metric) GROUP BY 1)""")
def _(w):
    return sensitivity.knee(sensitivity.pool_metrics(_components(w)), ["m1_position_pct", "m2_speed_pct", "m4_event_f1"])


relation("seg_ledger", """
SELECT v.trip_id, v.level, v.seg_id, v.x_end - v.x_start AS length_m, b.t_dwell AS bench_dwell_s, v.t_dwell AS var_dwell_s, b.d_signal AS bench_signal_s, v.d_signal AS var_signal_s
FROM l_rows v JOIN l_rows b ON b.trip_id = v.trip_id AND b.level = 0 AND b.seg_id = v.seg_id
JOIN (SELECT trip_id, level, min(x) AS a, max(x) AS z FROM l_pieces GROUP BY 1, 2) s ON s.trip_id = v.trip_id AND s.level = v.level
JOIN (SELECT trip_id, min(x) AS a, max(x) AS z FROM l_pieces WHERE level = 0 GROUP BY 1) o ON o.trip_id = v.trip_id
WHERE v.x_start >= greatest(s.a, o.a) AND v.x_end <= least(s.z, o.z)""")


@query("segment_ledger", "trip_id level seg_id length_m:3 bench_dwell_s:2 var_dwell_s:2 bench_signal_s:2 var_signal_s:2", "SELECT * FROM seg_ledger")
def _(w):
    return sensitivity.segment_ledger(_levels(w).levels["rows"], w.levels["pieces"])


@query("segment_agreement", "level n_segments dwell_agree_pct:3 dwell_mae_s:3 signal_agree_pct:3 signal_bench_s:2", """
SELECT level, count(*) AS n_segments, 100*sum(least(bench_dwell_s, var_dwell_s))/greatest(sum(greatest(bench_dwell_s, var_dwell_s)), 1e-9) AS dwell_agree_pct,
  coalesce(avg(CASE WHEN bench_dwell_s > 0 OR var_dwell_s > 0 THEN abs(var_dwell_s - bench_dwell_s) END), 0.0) AS dwell_mae_s,
  100*sum(least(bench_signal_s, var_signal_s))/greatest(sum(greatest(bench_signal_s, var_signal_s)), 1e-9) AS signal_agree_pct, sum(bench_signal_s) AS signal_bench_s FROM seg_ledger GROUP BY 1""")
def _(w):
    return sensitivity.segment_agreement(sensitivity.segment_ledger(_levels(w).levels["rows"], w.levels["pieces"]))


@query("scope_ladder", "level scope s_min:2 s_max:2 agree_pct:3", """
SELECT level, scope, sum(lo) AS s_min, sum(hi) AS s_max, 100*sum(lo)/nullif(sum(hi), 0) AS agree_pct FROM (
 SELECT trip_id, level, 'total' AS scope, least(sum(bench), sum(var)) AS lo, greatest(sum(bench), sum(var)) AS hi FROM a_both GROUP BY 1, 2
 UNION ALL SELECT trip_id, level, 'category', least(sum(bench), sum(var)), greatest(sum(bench), sum(var)) FROM a_both GROUP BY trip_id, level, category
 UNION ALL SELECT trip_id, level, 'facility', least(bench, var), greatest(bench, var) FROM a_both
 UNION ALL SELECT trip_id, level, 'cat:' || category, least(bench, var), greatest(bench, var) FROM a_both) GROUP BY 1, 2""")
def _(w):
    return sensitivity.scope_ladder(_seconds_both(w))


# Observed rides ---------------------------------------------------------------------------


@query("door_of_trip", "event_id trip_key event_type", "SELECT event_id, trip_id || '!' AS trip_key, event_type FROM door_log WHERE event_type IN (3, 5)")
def _(w):
    doors = door_log(w)
    trips = doors.select("bus_id", "trip_id", "trip_start").distinct().withColumn("trip_key", F.concat("trip_id", F.lit("!")))
    return compare.door_of_trip(doors, trips, (3, 5))


@query("passenger_metrics", "event_id on_total off_total flow load_before dwell_per_pax:1", """
SELECT event_id, fon + ron AS on_total, foff + roff AS off_total, fon + ron + foff + roff AS flow, passenger_load - (fon + ron - foff - roff) AS load_before,
  CASE WHEN fon + ron + foff + roff > 0 THEN round(dwell_s/(fon + ron + foff + roff) + 1e-9, 1) END AS dwell_per_pax FROM door_log""")
def _(w):
    return compare.passenger_metrics(_doors(w).withColumn("dwell_s", F.col("dwell_s") + 0.0)).withColumn(
        "dwell_per_pax", F.when(F.col("flow") > 0, F.round(F.col("dwell_s") / F.col("flow") + 1e-9, 1))
    )


def _windows(w):
    spans = w.pings.groupBy(F.col("trip_id").alias("trip_key"), "bus_id", "route_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return spans.withColumn("t0", F.col("lo"))


@query("door_bands", "trip_key event_id t_start:1 t_end:1 category event_desc label load_after", """
SELECT w.trip_key, d.event_id, round((epoch_us(d.ts) - epoch_us(w.lo))/1e6 + 1e-7, 1) AS t_start, round((epoch_us(d.ts) - epoch_us(w.lo))/1e6 + floor(dwell_s) + 1e-7, 1) AS t_end,
  CASE WHEN event_type = 3 THEN 'avl_stop' ELSE 'avl_other' END AS category, CASE WHEN event_type = 3 THEN 'Serviced stop' ELSE 'event ' || event_type END AS event_desc, 'Stop ' || d.stop_id AS label, passenger_load AS load_after
FROM door_log d JOIN (SELECT trip_id AS trip_key, bus_id, route_id, min(ts) AS lo, max(ts) AS hi FROM pings GROUP BY 1, 2, 3) w ON w.bus_id = d.bus_id AND w.route_id = d.route_id
 AND epoch_us(d.ts)/1e6 BETWEEN epoch_us(lo)/1e6 - 300 AND epoch_us(hi)/1e6 + 300 WHERE event_type = 3 OR floor(dwell_s) > 0""")
def _(w):
    kinds = w.spark.createDataFrame([(3, "Serviced stop")], "event_type int, description string")
    return compare.door_bands(_doors(w), _windows(w), w.stops, kinds)


relation("tagged", """
SELECT event_id, trip_id, ts AS start_ts, CASE WHEN event_id % 13 <> 0 THEN make_timestamp(epoch_us(ts) + CAST(round(value*1e6) AS BIGINT)) END AS end_ts, ['bus_stop','signal','exit_wait','congestion'][event_id % 4 + 1] AS type,
  CASE WHEN event_id % 2 = 0 THEN 'Stop ' || (event_id % 50) END AS stop_name, CASE WHEN event_id % 3 = 0 THEN 'note' END AS note FROM pings WHERE event_type = 'error'""")


@query("observer_bands", "trip_id t_start:1 t_end:1 category label", """
SELECT trip_id, round((epoch_us(start_ts) - epoch_us(t0))/1e6, 1) AS t_start, round((epoch_us(end_ts) - epoch_us(t0))/1e6, 1) AS t_end, type AS category, coalesce(stop_name, note, type) AS label FROM tagged JOIN clock0 USING (trip_id)""")
def _(w):
    return compare.observer_bands(derived.observer_events(w.spark, w.sf_dir), _windows(w).select(F.col("trip_key").alias("trip_id"), "t0"), TRIP)


@query("parent_event", "event_id stop_name", "SELECT a.event_id, coalesce(a.stop_name, b.stop_name) AS stop_name FROM tagged a LEFT JOIN tagged b ON b.event_id = a.event_id - a.event_id % 4 AND a.event_id % 4 <> 0")
def _(w):
    rows = derived.observer_events(w.spark, w.sf_dir)
    return compare.parent_event(rows.withColumn("parent_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id") - F.col("event_id") % 4)))


@query("wall_clock_axis", "trip_id source offset_s:3", """
SELECT s.trip_id, source, (epoch_us(a) - min(epoch_us(a)) OVER (PARTITION BY s.trip_id))/1e6 AS offset_s FROM (
 SELECT trip_id, 'phone' AS source, min(ts) FILTER (event_type <> 'click') AS a FROM pings GROUP BY 1 UNION ALL SELECT trip_id, 'observer', min(start_ts) FROM tagged GROUP BY 1) s""")
def _(w):
    phone = w.pings.where("event_type <> 'click'").groupBy("trip_id").agg(F.min("ts").alias("start_ts")).withColumn("source", F.lit("phone"))
    seen = derived.observer_events(w.spark, w.sf_dir).groupBy("trip_id").agg(F.min("start_ts").alias("start_ts")).withColumn("source", F.lit("observer"))
    return compare.wall_clock_axis([phone, seen], TRIP)


@query("ground_truth_bands", "role n", """
SELECT 'observed' AS role, count(*) AS n FROM tagged UNION ALL SELECT 'inferred', count(*) FROM attributed UNION ALL SELECT 'door', count(*) FROM door_log d JOIN pings p ON p.event_id = d.event_id WHERE d.event_type = 3 OR floor(d.dwell_s) > 0""")
def _(w):
    seen = compare.observer_bands(derived.observer_events(w.spark, w.sf_dir), _windows(w).select(F.col("trip_key").alias("trip_id"), "t0"), TRIP)
    doors = _doors(w).where((F.col("event_type") == 3) | (F.floor("dwell_s") > 0)).select(
        "trip_id", F.lit(0.0).alias("t_start"), F.col("dwell_s").alias("t_end"), F.lit("avl_stop").alias("category"), F.col("stop_id").alias("label")
    )
    bands = compare.ground_truth_bands(seen, delay.delay_bands(w.attributed, w.facilities, TRIP), doors, TRIP)
    return bands.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def _cluster_sql(before: int, after: int) -> str:
    return f"""
SELECT g.* FROM (SELECT *, sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY ts, event_id) AS c FROM (
 SELECT m.*, r.start_ts, r.end_ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY m.trip_id ORDER BY ts, event_id)))/1e6 AS gap FROM matched m JOIN rides r ON r.trip_id = m.trip_id
 WHERE epoch_us(ts)/1e6 BETWEEN epoch_us(start_ts)/1e6 - {before} AND epoch_us(end_ts)/1e6 + {after})) g"""


relation("ride_wide", _cluster_sql(600, 600))
relation("ride_strict", _cluster_sql(0, 0))
relation("ride_both", "SELECT 0 AS window_no, * FROM ride_wide UNION ALL SELECT 1, * FROM ride_strict")


@query("isolate_ride", "event_id window_no", """
WITH v AS (SELECT trip_id, window_no, arg_max(dist_m, (ts, event_id)) FILTER (on_route) - arg_min(dist_m, (ts, event_id)) FILTER (on_route) AS net, avg(CAST(on_route AS DOUBLE)) AS share FROM ride_both GROUP BY 1, 2),
k AS (SELECT trip_id, min(window_no) AS window_no FROM v WHERE NOT (coalesce(net < 500, true) OR share < 0.6) GROUP BY 1)
SELECT b.event_id, b.window_no FROM ride_both b JOIN k ON k.trip_id = b.trip_id AND k.window_no = b.window_no""")
def _(w):
    return compare.isolate_ride(w.pings, rides_of(w), w.shapes, TRIP, pad_before_s=600.0, pad_after_s=600.0)


@query("attribution_by_distance", "trip_id t_start:3 dist_start_m:2 dist_end_m:2", """
SELECT a.trip_id, a.t_start, s.x AS dist_start_m, e.x AS dist_end_m FROM attributed a JOIN samples s ON s.trip_id = a.trip_id AND s.t = a.t_start JOIN samples e ON e.trip_id = a.trip_id AND e.t = a.t_end""")
def _(w):
    return compare.attribution_by_distance(w.attributed.select("trip_id", "t_start", "t_end", "category"), w.pieces, TRIP)


@query("trip_payload", "trip_id chunk n_points", f"""
SELECT trip_id, i // 4096 AS chunk, count(*) AS n_points FROM ({grid('pieces', 'trip_id', 'ceil(t-t_first)', f'CASE WHEN {_FINAL} THEN floor(t-t_first+1e-9) ELSE ceil(t_next-t_first)-1 END', 't_first + i')}) GROUP BY 1, 2""")
def _(w):
    return compare.curve_document(w.pieces, TRIP)


@query("band_document", "trip_id hour_no n_delays", "SELECT trip_id, CAST(floor(t_start/3600) AS BIGINT) AS hour_no, count(*) AS n_delays FROM attributed GROUP BY 1, 2")
def _(w):
    return compare.band_document(delay.delay_bands(w.attributed, w.facilities, TRIP), TRIP)


@query("observed_trip_comparison", "trip_id source n")
def _(w):
    kinds = w.spark.createDataFrame([(3, "Serviced stop")], "event_type int, description string")
    phone = w.pings.where("event_type <> 'click'")
    out = compare.observed_trip_comparison(
        phone, w.pings, rides_of(w), _doors(w), derived.observer_events(w.spark, w.sf_dir), w.shapes, w.segs, w.zones, w.seg_controls, w.facilities, w.stops, kinds, TRIP
    )
    parts = [out[n].groupBy("trip_id").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(n)) for n in ("phone_bands", "archive_bands", "observed_bands", "door_bands")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# Motion -------------------------------------------------------------------------------------

relation("sensor", """
SELECT 'T' || l_suppkey AS trip_id, i, t, 1.2*sin(t*0.8 + l_suppkey % 7) + (l_quantity - 25)/25 AS ax, 0.6*sin(t*0.8 + l_suppkey % 7) + (l_discount - 0.05)*20 AS ay, (l_tax - 0.04)*10 AS az,
  (l_quantity - 25)/25*20 AS gx, (l_discount - 0.05)*400 AS gy, 20*sin(t*0.8 + l_suppkey % 7) AS gz
FROM (SELECT *, i/50.0 + i // 400 AS t FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i FROM lineitem))""")


def _gaps(w):
    if not hasattr(w, "stretches"):
        w.stretches = stage(motion.segment_gaps(motion.strictly_increasing(w.motion)), "stretches")
    return w.stretches


@query("segment_gaps", "trip_id seg_no n t:3 seg_size", """
SELECT trip_id, CAST(i // 400 AS BIGINT) AS seg_no, i AS n, t, count(*) OVER (PARTITION BY trip_id, i // 400) AS seg_size FROM sensor""")
def _(w):
    return _gaps(w).withColumn("seg_no", F.col("seg_no").cast("long"))


@query("sample_rate", "trip_id hz:3", "SELECT trip_id, 1/quantile_cont(d, 0.5) AS hz FROM (SELECT trip_id, t - lag(t) OVER (PARTITION BY trip_id ORDER BY t) AS d FROM sensor) GROUP BY 1")
def _(w):
    return motion.sample_rate(_gaps(w))


@query("gravity_mode", "trip_id median_a:4 gravity_included", "SELECT *, median_a > 5 AS gravity_included FROM (SELECT trip_id, quantile_cont(sqrt(ax*ax + ay*ay + az*az), 0.5) AS median_a FROM sensor GROUP BY 1)")
def _(w):
    return motion.gravity_mode(_gaps(w))


def _sustained(w):
    if not hasattr(w, "sustained"):
        w.sustained = stage(motion.sustained_motion(w.motion), "sustained")
    return w.sustained


# The filter as two second-order sections in a row, one sample a step: forward, then backward over what came out.
# These sensors never contain gravity (all magnitudes are below 5), so its projection has no statement.
relation("sensor6", """
SELECT trip_id, i // 400 AS seg, i, i % 400 AS j, count(*) OVER (PARTITION BY trip_id, i // 400, ch) AS size, ch, cutoff, CASE ch WHEN 'ax' THEN ax WHEN 'ay' THEN ay WHEN 'az' THEN az WHEN 'gx' THEN gx WHEN 'gy' THEN gy WHEN 'gz' THEN gz WHEN 'wx' THEN radians(gy) WHEN 'wy' THEN radians(gz) ELSE radians(gx) END AS v
FROM sensor, (VALUES ('ax', 0.4), ('ay', 0.4), ('az', 0.4), ('gx', 1.0), ('gy', 1.0), ('gz', 1.0), ('wx', 0.4), ('wy', 0.4), ('wz', 0.4)) f(ch, cutoff)""")
relation("sensor_hz", "SELECT trip_id, 1/quantile_cont(d, 0.5) AS hz FROM (SELECT trip_id, t - lag(t) OVER (PARTITION BY trip_id ORDER BY t) AS d FROM sensor) GROUP BY 1")
relation("section", """
SELECT trip_id, cutoff, k1*k1/n1 AS b1, 2*(k1*k1 - 1)/n1 AS c1, (1 - 2*sin(pi()/8)*k1 + k1*k1)/n1 AS e1, k1*k1/n2 AS b2, 2*(k1*k1 - 1)/n2 AS c2, (1 - 2*cos(pi()/8)*k1 + k1*k1)/n2 AS e2 FROM (
 SELECT *, 1 + 2*sin(pi()/8)*k1 + k1*k1 AS n1, 1 + 2*cos(pi()/8)*k1 + k1*k1 AS n2 FROM (SELECT trip_id, cutoff, tan(pi()*cutoff/hz) AS k1 FROM sensor_hz, (VALUES (0.4), (1.0)) f(cutoff)))""")
relation("wide0", """
SELECT trip_id, seg, ch, row_number() OVER (PARTITION BY trip_id, seg, ch ORDER BY u) AS o, u, v, b1, c1, e1, b2, c2, e2 FROM (
 SELECT trip_id, seg, ch, cutoff, j AS u, v FROM sensor6 WHERE size >= 11
 UNION ALL SELECT trip_id, seg, ch, cutoff, -j, 2*v0 - v FROM ends6 WHERE size >= 11 AND j BETWEEN 1 AND least(15, size - 1)
 UNION ALL SELECT trip_id, seg, ch, cutoff, 2*(size - 1) - j, 2*v1 - v FROM ends6 WHERE size >= 11 AND j BETWEEN size - 1 - least(15, size - 1) AND size - 2)
JOIN section USING (trip_id, cutoff)""")
relation("ends6", "SELECT *, first_value(v) OVER w AS v0, last_value(v) OVER w AS v1 FROM sensor6 WINDOW w AS (PARTITION BY trip_id, seg, ch ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")


def _filtered(src: str) -> str:
    """Both sections along o; before its first row a series is taken to be constant."""
    return f"""
WITH RECURSIVE f AS (
 SELECT trip_id, seg, ch, o, u, v AS z, v*(1 - b1) AS p1, v*(b1 - e1) AS p2, v*(1 - b2) AS q1, v*(b2 - e2) AS q2 FROM {src} WHERE o = 1
 UNION ALL
 SELECT trip_id, seg, ch, o, u, z, 2*b1*v - c1*y + p2, b1*v - e1*y, 2*b2*y - c2*z + q2, b2*y - e2*z FROM (
  SELECT *, b2*y + q1 AS z FROM (SELECT w.*, f.p2, f.q1, f.q2, w.b1*w.v + f.p1 AS y FROM f JOIN {src} w ON w.trip_id = f.trip_id AND w.seg = f.seg AND w.ch = f.ch AND w.o = f.o + 1)))
SELECT trip_id, seg, ch, u, z FROM f"""


relation("onward", _filtered("wide0"))
relation("wide1", """
SELECT f.trip_id, f.seg, f.ch, row_number() OVER (PARTITION BY f.trip_id, f.seg, f.ch ORDER BY f.u DESC) AS o, f.u, f.z AS v, b1, c1, e1, b2, c2, e2 FROM onward f JOIN wide0 w ON w.trip_id = f.trip_id AND w.seg = f.seg AND w.ch = f.ch AND w.u = f.u""")
relation("backward", _filtered("wide1"))
relation("quiet0", """
SELECT s.trip_id, s.i AS n, s.t, max(hz) AS hz, max(CASE WHEN ch = 'ax' THEN z END) AS sx, max(CASE WHEN ch = 'ay' THEN z END) AS sy, max(CASE WHEN ch = 'az' THEN z END) AS sz,
  max(CASE WHEN ch = 'gx' THEN z END) AS gx, max(CASE WHEN ch = 'gy' THEN z END) AS gy, max(CASE WHEN ch = 'gz' THEN z END) AS gz,
  max(CASE WHEN ch = 'wx' THEN z END) AS wx, max(CASE WHEN ch = 'wy' THEN z END) AS wy, max(CASE WHEN ch = 'wz' THEN z END) AS wz
FROM sensor s JOIN sensor_hz USING (trip_id) LEFT JOIN backward b ON b.trip_id = s.trip_id AND b.seg = s.i // 400 AND b.u = s.i % 400 GROUP BY 1, 2, 3""")
relation("quiet", """
SELECT *, coalesce(n - last_value(hit IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= pad - 1, false) OR coalesce(first_value(hit IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - n <= pad, false) AS handling FROM (
 SELECT *, sqrt(sx*sx + sy*sy + sz*sz) AS a_horiz, CASE WHEN sqrt(gx*gx + gy*gy + gz*gz) > 60 THEN n END AS hit, round_even(hz, 0) AS pad FROM quiet0) WINDOW w AS (PARTITION BY trip_id ORDER BY n)""")


@query("lowpass", "trip_id n a_horiz:3 handling", "SELECT * FROM quiet")
def _(w):
    return _sustained(w)


def _fixes(w):
    return w.clocked.groupBy("trip_id", "t").agg(F.min(F.struct("lat", "lon")).alias("p")).select("trip_id", "t", "p.lat", "p.lon")


def _gps(w):
    if not hasattr(w, "gps"):
        track = motion.path_speed(_fixes(w))
        w.gps = stage(motion.yaw_rate(stage(track, "track")), "gps")
    return w.gps


relation("fix", "SELECT trip_id, t, min(lat) AS lat, arg_min(lon, (lat, lon)) AS lon, '' AS shape_id FROM clocked GROUP BY 1, 2")
relation("path", """
SELECT *, sum(step) OVER (PARTITION BY trip_id ORDER BY t) AS d, row_number() OVER (PARTITION BY trip_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY trip_id) AS n FROM (
 SELECT *, coalesce(6371000.0*sqrt(pow(radians(lat-pl),2) + pow(radians(lon-po)*cos(radians(lat+pl)/2),2)), 0.0) AS step FROM (SELECT *, lag(lat) OVER w AS pl, lag(lon) OVER w AS po FROM fix WINDOW w AS (PARTITION BY trip_id ORDER BY t)))""")
relation("path_smooth", locreg("path", "trip_id", "15"))
relation("path_pieces", pieces("path_smooth", "trip_id"))


@query("path_speed", "trip_id t:3 v_mps:4", "SELECT trip_id, t, greatest(m, 0.0) AS v_mps FROM path_pieces")
def _(w):
    return _gps(w)


_PB = "fmod(degrees(atan2(sin(radians({lo2}-{lo1}))*cos(radians({la2})), cos(radians({la1}))*sin(radians({la2})) - sin(radians({la1}))*cos(radians({la2}))*cos(radians({lo2}-{lo1})))) + 360, 360)"
relation("bearings", f"""
SELECT *, b - lag(b) OVER (PARTITION BY trip_id ORDER BY t) AS raw FROM (SELECT *, coalesce({_PB.format(lo1='po', la1='pl', lo2='lon', la2='lat')}, {_PB.format(lo1='lon', la1='lat', lo2='qo', la2='ql')}) AS b FROM (
 SELECT f.*, lag(lat) OVER w AS pl, lag(lon) OVER w AS po, lead(lat) OVER w AS ql, lead(lon) OVER w AS qo FROM fix f WINDOW w AS (PARTITION BY trip_id ORDER BY t)))""")
relation("yaw", """
SELECT *, CASE WHEN pt IS NULL THEN (qb - bs)/(qt - t) WHEN qt IS NULL THEN (bs - pb)/(t - pt)
  ELSE ((t-pt)*(t-pt)*qb + ((qt-t)*(qt-t) - (t-pt)*(t-pt))*bs - (qt-t)*(qt-t)*pb)/((t-pt)*(qt-t)*(qt-pt)) END AS yaw_dps FROM (
 SELECT *, lag(t) OVER w AS pt, lead(t) OVER w AS qt, lag(bs) OVER w AS pb, lead(bs) OVER w AS qb FROM (
  SELECT *, avg(ub) OVER (PARTITION BY trip_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS bs FROM (
   SELECT *, sum(CASE WHEN raw IS NULL THEN b ELSE raw - 360*floor((raw + 180)/360) END) OVER (PARTITION BY trip_id ORDER BY t) AS ub FROM bearings)) WINDOW w AS (PARTITION BY trip_id ORDER BY t))""")


@query("yaw_rate", "trip_id t:3 yaw_dps:3", "SELECT * FROM yaw")
def _(w):
    return _gps(w)


relation("turned_runs", """
SELECT trip_id, min(t) AS t_start, max(t) AS t_end FROM (SELECT *, rn - row_number() OVER (PARTITION BY trip_id ORDER BY t) AS run FROM (
 SELECT y.trip_id, y.t, y.yaw_dps, p.m, row_number() OVER (PARTITION BY y.trip_id ORDER BY y.t) AS rn FROM yaw y JOIN path_pieces p ON p.trip_id = y.trip_id AND p.t = y.t)
 WHERE abs(yaw_dps) > 0.5 AND m > 3.0) GROUP BY trip_id, run HAVING max(t) - min(t) >= 2""")


@query("turn_events", "trip_id t_start:3 t_end:3", "SELECT * FROM turned_runs")
def _(w):
    return motion.turn_events(_gps(w), min_dps=0.5, min_s=2.0)


def _on_clock(w):
    if not hasattr(w, "on_clock"):
        samples = _sustained(w).select("trip_id", "n", "t", "sx", "sy", "sz", "a_horiz", "handling")
        w.on_clock = stage(motion.on_motion_clock(samples, _gps(w)), "on_clock")
    return w.on_clock


relation("gps_acc", """
SELECT trip_id, t, m, CASE WHEN t_next IS NOT NULL THEN 2*((3*((x_next-x)/(t_next-t))-2*m-m_next)/(t_next-t))
  ELSE 2*((3*((x-px)/(t-pt))-2*pm-m)/(t-pt)) + 6*(t-pt)*((pm+m-2*((x-px)/(t-pt)))/((t-pt)*(t-pt))) END AS a
FROM (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(m) OVER w AS pm FROM path_pieces WINDOW w AS (PARTITION BY trip_id ORDER BY t))""")
relation("gps_track", """
SELECT y.trip_id, y.t, coalesce(greatest(g.m, 0.0), 0.0) AS v, coalesce(g.a, 0.0) AS dvdt, y.yaw_dps AS yaw_all, CASE WHEN g.m > 3.0 THEN 1.0 ELSE 0.0 END AS mv FROM yaw y LEFT JOIN gps_acc g ON g.trip_id = y.trip_id AND g.t = y.t""")
_BETWEEN = ", ".join(f"coalesce(p.{c} + CASE WHEN r.t > p.t THEN (q.t - p.t)/(r.t - p.t) ELSE 0.0 END*(r.{c} - p.{c}), p.{c}, r.{c}) AS {c}" for c in ("v", "dvdt", "yaw_all", "mv"))
relation("clock_rows", f"""
SELECT *, abs(v*radians(yaw)) AS a_lat_gps FROM (SELECT *, CASE WHEN mv > 0.5 THEN yaw_all END AS yaw FROM (
 SELECT q.*, {_BETWEEN} FROM quiet q ASOF LEFT JOIN gps_track p ON p.trip_id = q.trip_id AND p.t <= q.t ASOF LEFT JOIN gps_track r ON r.trip_id = q.trip_id AND r.t >= q.t))""")


@query("classify_episodes", "trip_id t_start:3 t_end:3 kind a_mean:3", """
SELECT trip_id, t_start, t_end, round(a_mean, 3) AS a_mean, CASE WHEN share IS NULL THEN CASE WHEN v < 3.0 THEN 'low-speed' ELSE 'unknown' END
  WHEN share >= 0.6 THEN CASE WHEN abs(net) >= 45.0 THEN 'turn' ELSE 'steering (curve/lane)' END WHEN share <= 0.35 THEN CASE WHEN dv < -0.05 THEN 'brake' ELSE 'accelerator' END ELSE 'mixed' END AS kind
FROM (SELECT trip_id, min(t) AS t_start, max(t) AS t_end, avg(a_horiz) AS a_mean, avg(a_lat_gps)/avg(a_horiz) AS share, sum(turned) - arg_min(turned, n) AS net, sum(dvdt)/count(*) AS dv, sum(v)/count(*) AS v FROM (
  SELECT *, n - row_number() OVER (PARTITION BY trip_id ORDER BY n) AS run FROM (
   SELECT *, coalesce((t - lag(t) OVER (PARTITION BY trip_id ORDER BY t))*coalesce(yaw, 0.0), 0.0) AS turned FROM clock_rows) WHERE a_horiz > 0.35 AND NOT handling)
 GROUP BY trip_id, run HAVING max(t) - min(t) >= 1.5)""")
def _(w):
    return motion.classify_episodes(_on_clock(w))


relation("gps_valid", """
SELECT trip_id, t, a, coalesce(pa + CASE WHEN rt > pt THEN (t - pt)/(rt - pt) ELSE 0.0 END*(ra - pa), pa, ra) AS a_phone, coalesce(ph + CASE WHEN ht > gt THEN (t - gt)/(ht - gt) ELSE 0.0 END*(rh - ph), ph, rh) AS held FROM (
 SELECT g.trip_id, g.t, g.a, p.t AS pt, p.a_horiz AS pa, r.t AS rt, r.a_horiz AS ra, x.t AS gt, CAST(x.handling AS INT)*1.0 AS ph, y.t AS ht, CAST(y.handling AS INT)*1.0 AS rh FROM gps_acc g
 ASOF LEFT JOIN (SELECT * FROM quiet WHERE NOT handling AND a_horiz IS NOT NULL) p ON p.trip_id = g.trip_id AND p.t <= g.t ASOF LEFT JOIN (SELECT * FROM quiet WHERE NOT handling AND a_horiz IS NOT NULL) r ON r.trip_id = g.trip_id AND r.t >= g.t
 ASOF LEFT JOIN quiet x ON x.trip_id = g.trip_id AND x.t <= g.t ASOF LEFT JOIN quiet y ON y.trip_id = g.trip_id AND y.t >= g.t) gps_of
WHERE EXISTS (SELECT 1 FROM (SELECT trip_id, min(t) AS t0, max(t) AS t1 FROM sensor GROUP BY trip_id, i // 400 HAVING count(*) >= 11) s WHERE s.trip_id = gps_of.trip_id AND gps_of.t BETWEEN t0 AND t1)""")


@query("accel_vs_gps", "trip_id n_valid r:3 p95_a:3", """
SELECT q.trip_id, coalesce(n_valid, 0) AS n_valid, CASE WHEN n_valid > 30 THEN r END AS r, p95_a FROM (SELECT trip_id, quantile_cont(a_horiz, 0.95) AS p95_a FROM quiet WHERE NOT handling GROUP BY 1) q
LEFT JOIN (SELECT trip_id, count(*) AS n_valid, corr(a_phone, abs(a)) AS r FROM gps_valid WHERE held <= 0.25 GROUP BY 1) v ON v.trip_id = q.trip_id""")
def _(w):
    return motion.accel_vs_gps(_sustained(w), _gps(w))


def _anchors(w):
    if not hasattr(w, "anchors"):
        w.anchors = stage(motion.forward_anchors(_on_clock(w), min_dvdt=0.001, max_spread=60.0), "anchors")
    return w.anchors


relation("anchor_rows", """
SELECT *, n - row_number() OVER (PARTITION BY trip_id ORDER BY n) AS run FROM clock_rows WHERE a_horiz > 0.5 AND abs(dvdt) > 0.001 AND abs(v*radians(yaw_all)) < 0.3*greatest(a_horiz, 1e-6) AND NOT handling""")
relation("anchor_runs", """
SELECT trip_id, run, n0, n1, (n0 + n1 + 1) // 2 AS n_mid, dv, vx/size AS mx, vy/size AS my, vz/size AS mz FROM (
 SELECT *, greatest(sqrt(vx*vx + vy*vy + vz*vz), 1e-9) AS size FROM (
  SELECT trip_id, run, min(n) AS n0, max(n) AS n1, sum(sx*a_horiz) AS vx, sum(sy*a_horiz) AS vy, sum(sz*a_horiz) AS vz, sum(dvdt)/count(*) AS dv FROM anchor_rows GROUP BY 1, 2 HAVING max(t) - min(t) >= 1.5))""")
relation("anchors", """
SELECT trip_id, n0, n1 + 1 AS n1, n_mid, t_mid, sign(dv)*mx AS fx, sign(dv)*my AS fy, sign(dv)*mz AS fz FROM (
 SELECT a.trip_id, a.n0, any_value(a.n1) AS n1, any_value(a.n_mid) AS n_mid, any_value(dv) AS dv, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, max(CASE WHEN r.n = a.n_mid THEN r.t END) AS t_mid,
  stddev_pop(degrees(acos(greatest(-1.0, least(1.0, (r.sx*mx + r.sy*my + r.sz*mz)/greatest(r.a_horiz, 1e-9)))))) AS spread
 FROM anchor_runs a JOIN anchor_rows r ON r.trip_id = a.trip_id AND r.run = a.run GROUP BY 1, 2) WHERE spread <= 60.0 AND sign(dv) <> 0""")


@query("forward_anchors", "trip_id n0 n1 t_mid:3 fx:3 fy:3 fz:3", "SELECT * FROM anchors")
def _(w):
    return _anchors(w)


def _split(w):
    if not hasattr(w, "split"):
        axis = stage(motion.propagate_axis(_sustained(w), _anchors(w)), "axis")
        near = motion.time_since_anchor(_on_clock(w).drop("yaw", "a_lat_gps"), _anchors(w))
        w.split = stage(motion.split_acceleration(near, axis).drop("sx", "sy", "sz", "ux", "uy", "uz", "a_horiz"), "split")
    return w.split


# The axis is turned from sample to sample, onward from the anchor before and back from the anchor after.
relation("turn_rows", """
SELECT q.trip_id, q.n // 400 AS seg, q.n % 400 AS j, q.n, q.t, a.fx, a.fy, a.fz, lead(q.t) OVER w IS NULL AS last_row,
  CASE WHEN wx IS NOT NULL AND lead(q.t) OVER w - q.t < 1.0 THEN lead(q.t) OVER w - q.t ELSE 0.0 END*coalesce(wx, 0.0) AS ax, CASE WHEN wx IS NOT NULL AND lead(q.t) OVER w - q.t < 1.0 THEN lead(q.t) OVER w - q.t ELSE 0.0 END*coalesce(wy, 0.0) AS ay,
  CASE WHEN wx IS NOT NULL AND lead(q.t) OVER w - q.t < 1.0 THEN lead(q.t) OVER w - q.t ELSE 0.0 END*coalesce(wz, 0.0) AS az,
  CASE WHEN wx IS NOT NULL AND q.t - lag(q.t) OVER w < 1.0 THEN q.t - lag(q.t) OVER w ELSE 0.0 END*coalesce(wx, 0.0) AS bx, CASE WHEN wx IS NOT NULL AND q.t - lag(q.t) OVER w < 1.0 THEN q.t - lag(q.t) OVER w ELSE 0.0 END*coalesce(wy, 0.0) AS "by",
  CASE WHEN wx IS NOT NULL AND q.t - lag(q.t) OVER w < 1.0 THEN q.t - lag(q.t) OVER w ELSE 0.0 END*coalesce(wz, 0.0) AS bz
FROM (SELECT *, count(*) OVER (PARTITION BY trip_id, n // 400) AS size FROM quiet) q LEFT JOIN anchors a ON a.trip_id = q.trip_id AND a.n_mid = q.n WHERE size >= 11 WINDOW w AS (PARTITION BY q.trip_id, q.n // 400 ORDER BY q.n)""")
relation("axis_onward", """
WITH RECURSIVE f AS (
 SELECT trip_id, seg, j, fx + az*fy - ay*fz AS ux, -az*fx + fy + ax*fz AS uy, ay*fx - ax*fy + fz AS uz FROM turn_rows WHERE j = 0
 UNION ALL
 SELECT trip_id, seg, j, gx + az*gy - ay*gz, -az*gx + gy + ax*gz, ay*gx - ax*gy + gz FROM (
  SELECT r.*, coalesce(r.fx, f.ux) AS gx, coalesce(r.fy, f.uy) AS gy, coalesce(r.fz, f.uz) AS gz FROM f JOIN turn_rows r ON r.trip_id = f.trip_id AND r.seg = f.seg AND r.j = f.j + 1))
SELECT * FROM f""")
relation("axis_back", """
WITH RECURSIVE f AS (
 SELECT trip_id, seg, j, CAST(NULL AS DOUBLE) AS ux, CAST(NULL AS DOUBLE) AS uy, CAST(NULL AS DOUBLE) AS uz FROM turn_rows WHERE last_row
 UNION ALL
 SELECT trip_id, seg, j - 1, gx - bz*gy + "by"*gz, bz*gx + gy - bx*gz, -"by"*gx + bx*gy + gz FROM (
  SELECT r.*, coalesce(r.fx, f.ux) AS gx, coalesce(r.fy, f.uy) AS gy, coalesce(r.fz, f.uz) AS gz FROM f JOIN turn_rows r ON r.trip_id = f.trip_id AND r.seg = f.seg AND r.j = f.j WHERE r.j > 0))
SELECT * FROM f""")
relation("axis_sides", """
SELECT trip_id, seg, n, t, mark, before_t, after_t, CASE WHEN covered AND n < c_mid THEN cx ELSE coalesce(px, CASE WHEN covered THEN cx END) END AS px, CASE WHEN covered AND n < c_mid THEN cy ELSE coalesce(py, CASE WHEN covered THEN cy END) END AS py,
  CASE WHEN covered AND n < c_mid THEN cz ELSE coalesce(pz, CASE WHEN covered THEN cz END) END AS pz, coalesce(qx, CASE WHEN covered AND n >= c_mid THEN cx END) AS qx, coalesce(qy, CASE WHEN covered AND n >= c_mid THEN cy END) AS qy, coalesce(qz, CASE WHEN covered AND n >= c_mid THEN cz END) AS qz
FROM (SELECT r.trip_id, r.seg, r.n, r.t, r.fx IS NOT NULL AS mark, c.fx IS NOT NULL AS covered, c.n_mid AS c_mid, c.fx AS cx, c.fy AS cy, c.fz AS cz,
   last_value(CASE WHEN r.fx IS NOT NULL THEN r.t END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_t, first_value(CASE WHEN r.fx IS NOT NULL THEN r.t END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after_t,
   CASE WHEN NOT r.last_row THEN p.ux/p.size END AS px, CASE WHEN NOT r.last_row THEN p.uy/p.size END AS py, CASE WHEN NOT r.last_row THEN p.uz/p.size END AS pz, q.ux/q.size AS qx, q.uy/q.size AS qy, q.uz/q.size AS qz
  FROM turn_rows r JOIN (SELECT *, greatest(sqrt(ux*ux + uy*uy + uz*uz), 1e-9) AS size FROM axis_onward) p ON p.trip_id = r.trip_id AND p.seg = r.seg AND p.j = r.j
  JOIN (SELECT *, greatest(sqrt(ux*ux + uy*uy + uz*uz), 1e-9) AS size FROM axis_back) q ON q.trip_id = r.trip_id AND q.seg = r.seg AND q.j = r.j
  LEFT JOIN anchors c ON c.trip_id = r.trip_id AND c.n_mid // 400 = r.seg AND r.n >= c.n0 AND r.n < c.n1 WINDOW w AS (PARTITION BY r.trip_id, r.seg ORDER BY r.n))""")
relation("axis", """
SELECT trip_id, n, ux/size AS ux, uy/size AS uy, uz/size AS uz FROM (SELECT *, greatest(sqrt(ux*ux + uy*uy + uz*uz), 1e-9) AS size FROM (
 SELECT trip_id, n, (1 - later)*coalesce(px, 0.0) + later*coalesce(qx, 0.0) AS ux, (1 - later)*coalesce(py, 0.0) + later*coalesce(qy, 0.0) AS uy, (1 - later)*coalesce(pz, 0.0) + later*coalesce(qz, 0.0) AS uz FROM (
  SELECT *, CASE WHEN px IS NULL THEN 1.0 WHEN qx IS NULL THEN 0.0 WHEN mark OR before_t IS NULL THEN 1.0 WHEN after_t IS NULL THEN 0.0 ELSE (t - before_t)/greatest(after_t - before_t, 1e-9) END AS later
  FROM axis_sides WHERE px IS NOT NULL OR qx IS NOT NULL)))""")
relation("signed", """
SELECT *, sqrt(greatest(0.0, a_horiz*a_horiz - a_long*a_long)) AS a_lat, least(t - pt, rt - t) AS dt_anchor, coalesce(n >= p0 AND n < p1, false) OR coalesce(n >= r0 AND n < r1, false) AS in_anchor FROM (
 SELECT c.*, c.sx*a.ux + c.sy*a.uy + c.sz*a.uz AS a_long, p.t_mid AS pt, p.n0 AS p0, p.n1 AS p1, r.t_mid AS rt, r.n0 AS r0, r.n1 AS r1 FROM clock_rows c LEFT JOIN axis a ON a.trip_id = c.trip_id AND a.n = c.n
 ASOF LEFT JOIN anchors p ON p.trip_id = c.trip_id AND p.t_mid <= c.t ASOF LEFT JOIN anchors r ON r.trip_id = c.trip_id AND r.t_mid >= c.t)""")
relation("scored", "SELECT *, abs(v*radians(yaw_all)) AS lat FROM signed WHERE a_long IS NOT NULL AND NOT handling AND mv > 0.5 AND NOT in_anchor AND abs(dvdt) > 0.0")


@query("propagate_axis", "trip_id n a_long:3 a_lat:3", "SELECT * FROM signed WHERE a_long IS NOT NULL")
def _(w):
    return _split(w).where(F.col("a_long").isNotNull())


@query("fusion_scores", "trip_id n_val r_long:3 sign_agree:3", """
SELECT trip_id, count(*) AS n_val, CASE WHEN count(*) > 20 THEN corr(a_long, dvdt) END AS r_long, CASE WHEN count(*) > 20 THEN avg(CASE WHEN sign(a_long) = sign(dvdt) THEN 1.0 ELSE 0.0 END) END AS sign_agree FROM scored GROUP BY 1""")
def _(w):
    return motion.fusion_scores(_split(w), min_a=0.0, min_n=20)


@query("drift_bins", "bin_lo_s:0 bin_hi_s:0 n sign_agree_wmean:3 r_long_wmean:3", """
SELECT lo AS bin_lo_s, hi AS bin_hi_s, CAST(sum(n) AS BIGINT) AS n, sum(sa*n)/sum(CASE WHEN sa IS NOT NULL THEN n END) AS sign_agree_wmean, sum(r*n)/sum(CASE WHEN r IS NOT NULL THEN n END) AS r_long_wmean FROM (
 SELECT trip_id, lo, least(hi, 1e6) AS hi, count(*) AS n, avg(CASE WHEN sign(a_long) = sign(dvdt) THEN 1.0 ELSE 0.0 END) AS sa, corr(a_long, dvdt) AS r FROM scored
 JOIN (VALUES (0.0, 5.0), (5.0, 10.0), (10.0, 20.0), (20.0, 40.0), (40.0, 80.0), (80.0, 1e9)) b(lo, hi) ON dt_anchor >= lo AND dt_anchor < hi GROUP BY 1, 2, 3 HAVING count(*) >= 10) GROUP BY 1, 2""")
def _(w):
    bins = motion.drift_bins(_split(w), min_a=0.0, min_n=10)
    return motion.weighted_pool(bins, ["bin_lo_s", "bin_hi_s"], ["sign_agree", "r_long"])


@query("turn_contrast", "trip_id n_in n_out a_lat_in_turn:3 a_lat_outside:3 n_turns", """
SELECT * FROM (SELECT trip_id, count(*) FILTER (WHERE inside) AS n_in, count(*) FILTER (WHERE NOT inside) AS n_out, avg(a_lat) FILTER (WHERE inside) AS a_lat_in_turn, avg(a_lat) FILTER (WHERE NOT inside) AS a_lat_outside FROM (
  SELECT s.trip_id, a_lat, EXISTS (SELECT 1 FROM turned_runs r WHERE r.trip_id = s.trip_id AND s.t BETWEEN r.t_start AND r.t_end) AS inside FROM signed s WHERE a_lat IS NOT NULL AND NOT handling AND v > 3.0) GROUP BY 1)
JOIN (SELECT trip_id, count(*) AS n_turns FROM turned_runs GROUP BY 1) USING (trip_id) WHERE n_in >= 1 AND n_out >= 1""")
def _(w):
    turns = motion.turn_events(_gps(w), min_dps=0.5, min_s=2.0)
    return motion.turn_contrast(_split(w), turns, min_n=1)


@query("pearson", "trip_id r:4", "SELECT trip_id, corr(ax, ay) AS r FROM sensor GROUP BY 1")
def _(w):
    return w.motion.groupBy("trip_id").agg(F.corr("ax", "ay").alias("r"))


# Streaming ------------------------------------------------------------------------------------


def drained(w, rows: DataFrame, build, schema: str | None = None) -> DataFrame:
    """Run a streaming plan over written rows until no input is left; read its output."""
    live.use_keyed_state(w.spark)
    source, out, marks = (new_path(w.spark, n) for n in ("stream_in", "stream_out", "stream_marks"))
    rows.write.parquet(source)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) if schema is None else schema
    plan = build(live.stream_pings(w.spark, source, columns))
    job = plan.writeStream.format("parquet").option("checkpointLocation", marks).option("path", out).outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return w.spark.read.schema(plan.schema).parquet(out)


def _feed(w) -> DataFrame:
    cols = ["trip_id", "bus_id", "route_id", "pattern_id", "shape_id", "event_id", "ts", "lat", "lon"]
    twice = F.when(F.col("event_id") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return w.pings.withColumn("__c", F.explode(twice)).select(*cols)


@query("stream_dedupe", "bus_id us event_id", "SELECT bus_id, epoch_us(ts) AS us, event_id FROM pings")
def _(w):
    return drained(w, _feed(w), live.stream_dedupe).withColumn("us", F.unix_micros("ts"))


_MARK = "(SELECT max(epoch_us(ts)) FROM pings) // 1000 * 1000 - 300000000"


def _session_sql(keys: str, gap_us: int) -> str:
    return f"""
SELECT {keys}, count(*) AS n_pings, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM (
 SELECT *, sum(CASE WHEN epoch_us(ts) - p > {gap_us} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS s FROM (
  SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS p FROM pings)) GROUP BY {keys}, s HAVING max(epoch_us(ts)) + {gap_us} <= {_MARK}"""


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumn("first_us", F.unix_micros("first_ts")).withColumn("last_us", F.unix_micros("last_ts"))


@query("stream_completed_trips", "trip_id bus_id n_pings first_us last_us", _session_sql("trip_id, bus_id", 300_000_000))
def _(w):
    return _micros(drained(w, w.pings.select("trip_id", "bus_id", "ts", "lat"), live.completed_trips))


@query("stream_ride_sessions", "bus_id n_pings first_us last_us", _session_sql("bus_id", 60_000_000))
def _(w):
    return _micros(drained(w, w.pings.select("bus_id", "ts"), lambda s: live.ride_sessions(s, gap="1 minute")))


@query("stream_hourly_counts", "route_id hour_us n", f"SELECT route_id, epoch_us(ts) // 3600000000 * 3600000000 AS hour_us, count(*) AS n FROM pings GROUP BY 1, 2 HAVING max(epoch_us(ts) // 3600000000 * 3600000000) + 3600000000 <= {_MARK}")
def _(w):
    return drained(w, w.pings.select("route_id", "ts"), live.hourly_counts).withColumn("hour_us", F.unix_micros("hour"))


@query("stream_next_stop", "event_id next_stop_id", "SELECT event_id, next_stop_id FROM next_stops")
def _(w):
    from kerbline.plans.queries_roads import _lines, _stop_lists

    rows = w.pings.withColumn("pattern_id", F.substring("shape_id", 4, 5).cast("int").cast("string")).withColumn("accuracy_m", (F.col("event_id") % 45).cast("double"))
    lines, lists = _lines(w).select("pattern_id", "line"), stage(_stop_lists(w), "stop_lists")
    return drained(w, rows.select("event_id", "pattern_id", "ts", "lat", "lon", "accuracy_m"), lambda s: live.live_next_stop(s, lines, lists))


@query("stream_slow_events", "trip_id t_start:3 t_end:3 x_start:2 x_end:2", f"""
SELECT s.* FROM slow s JOIN (SELECT trip_id, max(epoch_ms) AS last_ms FROM (SELECT trip_id, 1704110400000 + CAST(floor(t*1000) AS BIGINT) AS epoch_ms FROM samples) GROUP BY 1) l USING (trip_id)
WHERE last_ms + 300000 <= (SELECT 1704110400000 + max(CAST(floor(t*1000) AS BIGINT)) FROM samples) + 86400000 - 300000""")
def _(w):
    at = F.timestamp_millis(F.lit(1704110400000) + F.floor(F.col("t") * 1000))
    samples = smooth.sample_trajectory(w.pieces, TRIP, dt=2.0)  # drained() writes them
    rows = samples.select("trip_id", at.alias("ts"), "t", "x", "v_mph")
    # One late sample of a day later moves the watermark past every trip.
    end = samples.groupBy(F.lit("~end").alias("trip_id")).agg(F.max("t").alias("t")).select(
        "trip_id", F.timestamp_millis(F.lit(1704110400000 + 86_400_000) + F.floor(F.col("t") * 1000)).alias("ts"), "t", F.lit(0.0).alias("x"), F.lit(60.0).alias("v_mph")
    )
    return drained(w, rows.unionByName(end), lambda s: live.live_slow_events(s, keys=["trip_id"]))


@query("stream_stop_after_terminal", "event_id", "SELECT event_id FROM gate_rows WHERE before = 0")
def _(w):
    from kerbline.operators.mapmatch import snap_to_shape

    matched = stage(snap_to_shape(w.pings.select("trip_id", "bus_id", "shape_id", "event_id", "ts", "lat", "lon"), w.shapes, max_perp_m=80.0), "stream_matched")
    lengths = stage(select.shape_lengths(w.shapes), "lengths")
    return drained(w, matched, lambda s: live.stop_after_terminal(s, lengths, tol_m=4000.0))

