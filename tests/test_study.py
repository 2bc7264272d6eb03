"""The window study against plain loops; stitched series, point-by-point dead reckoning, sweeps."""

import collections
import statistics
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead import config as C
from fairlead.operators import evaluate, study, trajectory, traffic

FIRST = {"A25": date(2025, 1, 13), "B25": date(2025, 3, 10), "A26": date(2026, 1, 12), "B26": date(2026, 3, 9)}
ORDER = ("A26", "B26", "A25", "B25")


def _days(seed):
    """Four weeks a window: variant, day, window, block and the daily columns of the metrics."""
    r = np.random.default_rng(seed)
    out = []
    for variant in ("main", "other"):
        for w, start in FIRST.items():
            for i in range(28):
                d = start + timedelta(days=i)
                h1 = int(r.integers(0, 9)) + (6 if w == "B26" and variant == "main" else 0)
                top = int(r.integers(0, h1 + 1))
                out.append((variant, d, w, d - timedelta(days=d.weekday()), h1, top, h1, float(r.integers(100, 999)), 1))
    return out


COLUMNS = "variant string, day date, window string, block date, h1 long, h2_top long, h2_bottom long, h3 double, one int"


def _pieces(rows, variant, metric):
    """Lists of (top, bottom) by week for each window, by hand."""
    top, bottom = C.METRICS[metric]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    weeks = {w: collections.defaultdict(lambda: [0.0, 0.0]) for w in FIRST}
    for row in rows:
        d = dict(zip(names, row, strict=True))
        if d["variant"] == variant:
            weeks[d["window"]][d["block"]][0] += d[top]
            weeks[d["window"]][d["block"]][1] += d[bottom]
    return {w: [b[k] for k in sorted(b)] for w, b in weeks.items()}


def _ratio(weeks):
    return sum(a for a, _ in weeks) / sum(b for _, b in weeks)


def _draws(weeks, n):
    r = np.random.default_rng(C.DID_SEED)
    out = []
    for _ in range(n):
        m = {w: _ratio([weeks[w][i] for i in r.integers(0, len(weeks[w]), len(weeks[w]))]) for w in ORDER}
        out.append((m["B26"] - m["A26"]) - (m["B25"] - m["A25"]))
    return sorted(out)


def _at(draws, share):
    place = share * (len(draws) - 1)
    low = int(place)
    return draws[low] + (place - low) * (draws[min(low + 1, len(draws) - 1)] - draws[low])


def test_results_sensitivity_and_samples_are_plain_loops(spark):
    n, rows = 200, _days(5)
    results = study.result_table(spark.createDataFrame(rows, COLUMNS), n).cache()
    got = {(r.variant, r.metric): r for r in results.collect()}
    assert set(got) == {(v, m) for v in ("main", "other") for m in C.METRICS}
    claims = {}
    for variant in ("main", "other"):
        p = {}
        for metric in C.METRICS:
            weeks, r = _pieces(rows, variant, metric), got[variant, metric]
            m, draws = {w: _ratio(weeks[w]) for w in FIRST}, _draws(weeks, n)
            assert [r[w] for w in FIRST] == pytest.approx([m[w] for w in FIRST])
            assert r.did == pytest.approx((m["B26"] - m["A26"]) - (m["B25"] - m["A25"]))
            assert (r.low, r.high) == pytest.approx((_at(draws, 0.025), _at(draws, 0.975)))
            p[metric] = min(1, 2 * min(sum(d <= 0 for d in draws), sum(d >= 0 for d in draws)) / n)
            assert r.p == pytest.approx(p[metric])
            assert r.effect == pytest.approx((1.959964 + 0.841621) * statistics.stdev(draws), rel=1e-5)
            assert r.effect_share == pytest.approx(r.effect / abs(m["A26"]))
        holds, worst = True, 0.0
        for i, metric in enumerate(sorted(p, key=lambda k: (p[k], k))):
            r, left, draws = got[variant, metric], 3 - i, _draws(_pieces(rows, variant, metric), n)
            worst, holds = max(worst, min(1.0, left * p[metric])), holds and p[metric] < C.ALPHA / left
            assert (r["rank"], r.level, r.p_holm, r.rejected) == pytest.approx((i + 1, C.ALPHA / left, worst, holds))
            assert (r.holm_low, r.holm_high) == pytest.approx((_at(draws, C.ALPHA / left / 2), _at(draws, 1 - C.ALPHA / left / 2)))
        claims[variant] = got[variant, "H1"].rejected or got[variant, "H2"].rejected
    assert claims["main"] and not claims["other"]
    for r in study.sensitivity(results).collect():
        g = got[r.variant, r.metric]
        assert (r.found, r.found_holm, r.claim, r.changes) == (not g.low <= 0 <= g.high, g.rejected, claims[r.variant], claims[r.variant] != claims["main"])
    side = study.compare_samples(small=results, large=results.filter("variant = 'main'")).collect()
    assert len(side) == 9 and all(r.claim == claims[r.variant] for r in side)


def test_window_intervals_draw_each_window_from_the_same_seed(spark):
    rows = [r for r in _days(6) if r[0] == "main"]
    for g in study.window_intervals(spark.createDataFrame(rows, COLUMNS), 100).collect():
        weeks, r = _pieces(rows, "main", g.metric)[g.window], np.random.default_rng(C.DID_SEED)
        draws = sorted(_ratio([weeks[i] for i in r.integers(0, len(weeks), len(weeks))]) for _ in range(100))
        assert (g["mean"], g.low, g.high) == pytest.approx((_ratio(weeks), _at(draws, 0.025), _at(draws, 0.975)))


def test_metrics_of_days_without_tankers_are_zero_and_nulls_do_not_count(spark):
    days = evaluate.sample_days(spark, {"A26": ("2026-01-12", "2026-01-13")}, (0, 1))
    schema = "day string, direction string, evaluable boolean, rel double, plausible boolean, length double, width double, draught double, category string"
    rows = [("2026-01-12", "észak", True, 0.9, True, 100.0, 20.0, 10.0, "FOR ORDER"), ("2026-01-12", "észak", True, 0.8, False, 100.0, 20.0, 99.0, None), ("2026-01-12", "dél", True, 0.9, True, 1.0, 1.0, 1.0, None), ("2026-01-12", "észak", False, None, None, None, None, None, None)]
    variants = {"main": (0.8148, False), "low": (0.75, False), "no orders": (0.8148, True)}
    got = {(r.variant, str(r.day)): r for r in study.daily_metrics(spark.createDataFrame(rows, schema), days, variants).collect()}
    assert len(got) == 6
    pick = lambda v, d="2026-01-12": tuple(got[v, d][c] for c in ("h1", "h2_top", "h2_bottom", "h3", "outward", "outward_evaluable"))
    assert pick("main") == (1, 0, 1, 20000.0, 3, 2) and pick("low")[:3] == (2, 0, 2) and pick("no orders")[:3] == (1, 0, 0)
    assert pick("main", "2026-01-13") == (0, 0, 0, 0.0, 0, 0)
    empty = study.daily_metrics(spark.createDataFrame([], schema), days).collect()
    assert len(empty) == 2 and all(r.h1 == 0 and r.h3 == 0 for r in empty)


def test_stitched_files_must_not_overlap_and_gaps_stay_null(spark):
    part = lambda days: spark.createDataFrame([("a", f"2026-01-{d:02d}", float(d)) for d in days], "series string, day string, value double")
    got = [(r.day.day, r.value, r.rolled) for r in study.stitched([part(range(1, 8)), part([8, 10])], "2026-01-01", "2026-01-11").orderBy("day").collect()]
    assert [g[1] for g in got] == [1, 2, 3, 4, 5, 6, 7, 8, None, 10, None]
    assert [g[2] for g in got] == [None] * 6 + [4.0, 5.0] + [None] * 3
    with pytest.raises(ValueError):
        study.stitched([part([1, 2]), part([2])], "2026-01-01", "2026-01-11")


def test_completion_counts_what_the_log_calls_done(spark):
    days = spark.createDataFrame([("2026-01-13", "A"), ("2026-01-15", "A"), ("2026-03-10", "B")], "day string, window string")
    log = spark.createDataFrame([("2026-01-13", "hiba"), ("2026-01-13", "kesz"), ("2026-01-13", "kesz"), ("2026-01-15", "reszleges")], "day string, status string")
    assert {tuple(r) for r in study.completion(days, log).collect()} == {("A", 2, 1, 1), ("B", 1, 0, 1)}


def test_explained_points_agree_with_the_scan(spark):
    """Errors of dropped points are the scan's own; kept ones are first, blind or off."""
    r = np.random.default_rng(3)
    rows, t = [], 0
    for i in range(300):
        t += int(r.choice([10, 10, 10, 2000]))
        sog, cog = (None if r.random() < 0.05 else float(r.uniform(0, 15))), float(r.choice([90.0, 90.0, 45.0, 360.0]))
        rows.append((i % 3, i, t, 55 + t * 1e-5, 11 + t * 1e-6, sog, cog))
    p = spark.createDataFrame(rows, "mmsi long, event_id long, s long, lat double, lon double, sog double, cog double").withColumn("ts", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)"))
    dr = trajectory.dead_reckoning(p, (50.0,))
    kept = {(x.mmsi, x.event_id): x for x in dr.collect()}
    seen = collections.Counter()
    for x in trajectory.explained(p, dr).collect():
        k = kept[x.mmsi, x.event_id]
        seen[x.decision] += 1
        assert k.kept == (x.decision != "dropped")
        assert (x.miss is None) == (x.decision in ("first", "blind"))
        if x.decision == "dropped":
            assert x.miss == pytest.approx(k.error) and x.miss <= 50
        elif x.decision == "off":
            assert x.miss > 50
    assert seen["first"] == 3 and set(seen) == {"first", "blind", "off", "dropped"}


def test_steadiest_ship_is_the_straightest_under_way(spark):
    rows = [(m, float(s), float(c)) for m, s, cs in ((1, 10, [90, 91, 89]), (2, 0, [90, 90, 90]), (3, 10, [0, 120, 240]), (4, 10, [359, 1, 0]), (5, 10, [90, 90])) for c in cs]
    p = spark.createDataFrame(rows, "mmsi long, sog double, cog double")
    how = {"least_points": 3, "least_valid": 3}
    assert trajectory.steadiest(p, **how).first().mmsi == 1
    assert trajectory.steadiest(p, turning=True, **how).first().mmsi == 3
    assert trajectory.steadiest(p).count() == 0


def test_sweep_boxes_are_cut_to_the_bounds_and_an_empty_table_has_zeros(spark):
    boxes = traffic.sweep_boxes()
    assert [h for h, _, _ in boxes] == sorted(h for h, _, _ in boxes) and all(a[2] < b[2] for a, b in zip(boxes, boxes[1:], strict=False))
    assert all(b.lat_min >= C.STUDY_BOX.lat_min and b.lon_min >= C.STUDY_BOX.lon_min for _, b, _ in boxes)
    empty = traffic.area_sweep(spark.createDataFrame([], "mmsi long, lat double, lon double")).collect()
    assert len(empty) == len(boxes) and all((r.rows, r.ships) == (0, 0) for r in empty)
