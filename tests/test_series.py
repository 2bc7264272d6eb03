from datetime import date, timedelta

import numpy as np
import pytest

from fairlead import config as C
from fairlead.operators import evaluate, laden, sets, signals
from fairlead.plans import queries


def weekly(spark, values, name="s", start=date(2026, 6, 1), step=7):
    rows = [(name, start + timedelta(days=step * i), float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "series string, day date, value double")


def test_baseline_by_hand(spark):
    b = sorted(signals.baseline(weekly(spark, [10, 12, 14, 30, 12])).collect(), key=lambda r: r.day)
    assert [r.base for r in b] == [None, None, None, 12.0, 13.0]
    assert b[2].base_days == 2


def test_signals_by_hand(spark):
    s = sorted(signals.signals(weekly(spark, [10, 10, 10, 10, 11, 9, 10, 30])).collect(), key=lambda r: r.day)
    assert s[-1].signal == C.HIGH and s[-1].threshold == pytest.approx(2 * 1.4826 * 0.1)
    n = signals.signals(weekly(spark, [0, 0, 0, 0, 5, 0, 0, 0])).collect()
    assert {r.signal for r in n} == {C.NO_BASE} and {r.threshold for r in n} == {None}


def test_rolling_with_a_gap(spark):
    s = weekly(spark, [1, 2, 3, None, 5, 6, 7], step=1)
    r = sorted(laden.rolling(s, 3).collect(), key=lambda r: r.day)
    assert [x.rolled for x in r] == [None, None, 6.0, None, None, 18.0]


def test_walk_forward_never_looks_ahead(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(50, 150, 120)
    classes = lambda x: {r.day: r["class"] for r in evaluate.walk_forward(signals.baseline(weekly(spark, x, step=1))).collect()}
    a, b = classes(v), classes([*v[:80], *(v[80:] * 3)])
    cut = date(2026, 6, 1) + timedelta(days=80)
    assert all(a[d] == b[d] for d in a if d < cut) and any(a[d] != -9 for d in a)


def test_cusum_restarts_the_side_that_signals(spark):
    z = spark.createDataFrame([("s", date(2026, 1, 1) + timedelta(days=i), x) for i, x in enumerate([2.0, 2.0, None, 2.0, -9.0])], "series string, day date, z double")
    got = [r["class"] for r in sorted(evaluate.cusum(z, (2.5,)).collect(), key=lambda r: r.day)]
    assert got == [0, 1, -9, 0, -1]


def test_holm_stops_at_the_first_kept(spark):
    h = {r.name: r for r in evaluate.holm(spark.createDataFrame([("a", 0.001), ("b", 0.03), ("c", 0.04)], "name string, p double")).collect()}
    assert h["a"].rejected and not h["b"].rejected and not h["c"].rejected
    assert h["c"].p_holm == pytest.approx(0.06)


def test_bootstrap_is_repeatable_and_holds_the_point(spark):
    rng = np.random.default_rng(1)
    rows = [(w, date(2026, 1, 5) + timedelta(days=7 * i), float(rng.integers(5, 15)), 2.0) for w in C.WINDOWS for i in range(7)]
    b = spark.createDataFrame(rows, "window string, block date, top double, bottom double")
    p, d = evaluate.bootstrap_did(b, n=300)
    p2, d2 = evaluate.bootstrap_did(b, n=300)
    assert p == p2 and (d == d2).all()
    lo, hi = evaluate.interval(d)
    assert lo <= p <= hi and p == pytest.approx(evaluate.did(b).first().did)
    assert evaluate.bootstrap_did(b, [b], n=5)[0] == pytest.approx(0.0)


def test_zero_size_events_are_never_hit(spark):
    v = np.random.default_rng(5).integers(50, 150, 100)
    e = evaluate.injected(weekly(spark, v, step=1), sizes=(0.0,), lengths=(1,)).collect()
    assert e and not any(r.hit for r in e)


def plain_injected(values, ks, sizes, lengths, after=C.AFTER_DAYS, least=C.MIN_LEARN_DAYS):
    """(start, days, size, way, k, hit, delay) of one series {day: value}, every day in turn by the rule's own words."""
    first, last = min(values), max(values)
    span = [first + timedelta(days=i) for i in range((last - first).days + 1)]

    def deviations(v):
        e = {}
        for d in span:
            b = [v[d - timedelta(days=7 * w)] for w in range(1, C.WEEKS + 1) if d - timedelta(days=7 * w) in v]
            if d in v and len(b) >= C.MIN_BASE_DAYS and np.median(b) > 0:
                e[d] = v[d] / np.median(b) - 1
        return e

    def classes(e, days, k):
        out = {}
        for d in days:
            past = np.array([x for t, x in e.items() if t < d])
            if d in e and len(past) >= least:
                lim = k * (C.MAD_SCALE * np.median(np.abs(past - np.median(past))))
                out[d] = 1 if e[d] > lim else -1 if e[d] < -lim else 0
        return out

    e0, out = deviations(values), []
    own = {k: classes(e0, span, k) for k in ks}
    judged = [d for d in span if d in values and sum(t < d for t in e0) >= least]
    for start in judged:
        for n in lengths:
            if start + timedelta(days=n + after) > last + timedelta(days=1):
                continue
            for size in sizes:
                for way in (1, -1):
                    stop = start + timedelta(days=n)
                    e = deviations({d: float(np.round(v * (1 + way * size))) if start <= d < stop else v for d, v in values.items()})
                    window = [d for d in span if start <= d < stop + timedelta(days=after)]
                    for k in ks:
                        c = classes(e, window, k)
                        hits = [(d - start).days for d in window if c.get(d) == way and own[k].get(d) != way]
                        out.append((str(start), n, size, way, k, bool(hits), min(hits, default=None)))
    return sorted(out, key=str)


def test_events_start_on_all_days_of_a_series_with_gaps(spark):
    r = np.random.default_rng(7)
    values = [int(v) if keep else None for v, keep in zip(r.integers(5, 25, 150), r.random(150) < 0.6, strict=True)]
    s = weekly(spark, values, step=1)
    got = [tuple(x)[1:] for x in evaluate.injected(s, (1.5, 2.0), (0.3,), (2,), chunk=16).collect()]
    want = plain_injected({x.day: x.value for x in s.collect()}, (1.5, 2.0), (0.3,), (2,))
    assert sorted(got, key=str) == want and max(w[0] for w in want) > str(date(2026, 6, 1) + timedelta(days=len(s.collect()) + 16))


def test_the_study_takes_all_days_and_series_on_the_whole_grid(spark, tmp_path):
    r = np.random.default_rng(11)
    of = {"a": (date(1995, 3, 1), 80), "b": (date(1997, 5, 1), 84)}
    counts = {s: {d + timedelta(days=i): float(v) for i, v in enumerate(r.integers(0, 9, n)) if v} for s, (d, n) in of.items()}
    rows = [(s, d) for s, v in counts.items() for d, n in v.items() for _ in range(int(n))]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    rates, case = {}, {}
    for s, v in counts.items():
        events = plain_injected(v, C.K_GRID, C.INJECTED_SIZES, C.INJECTED_DAYS)
        rates |= {(s, k): [e[5] for e in events if e[4] == k] for k in C.K_GRID}
        case |= {(s, k): np.mean([e[5] for e in events if e[4] == k and (e[2], e[1]) == C.CASE_EVENT]) for k in C.K_GRID}
    detected = {(x.series, x.days, x["size"], x.way, x.k): (x.n, x.hits) for x in queries.injection_detect(spark, str(tmp_path)).collect()}
    assert len(detected) == 2 * len(C.INJECTED_SIZES) * len(C.INJECTED_DAYS) * 2
    assert {s: sum(h for (t, *_), (_, h) in detected.items() if t == s) for s in of} == {s: sum(rates[s, C.K]) for s in of}
    assert {s: sum(n for (t, *_), (n, _) in detected.items() if t == s) for s in of} == {s: len(rates[s, C.K]) for s in of}
    points = {(x.series, x.k): x for x in queries.roc_points(spark, str(tmp_path)).collect()}
    assert {at: x.rate for at, x in points.items()} == pytest.approx({at: np.mean(v) for at, v in rates.items()})
    assert {at: x.case_rate for at, x in points.items()} == pytest.approx(case)
    for x in queries.operating_point(spark, str(tmp_path)).collect():
        k = max((k for k in C.K_GRID if case[x.series, k] >= C.TARGET_DETECTION), default=None)
        assert (x.k, x.case_rate, x.per_30) == ((k, points[x.series, k].case_rate, points[x.series, k].per_30) if k else (None, None, None))
        assert x.usual_case_rate == pytest.approx(case[x.series, C.K])
    points = queries.roc_points(spark, str(tmp_path))
    easy = evaluate.operating_point(points, 0.01).collect()
    assert [x.k for x in easy] == [max(k for k in C.K_GRID if case[x.series, k] >= 0.01) for x in easy]


def test_mad_of_sorted_values():
    r = np.random.default_rng(2)
    for n in [*range(1, 40), 500]:
        for v in (r.normal(size=n), r.integers(0, 4, n) / 3):
            assert evaluate._mad_of_sorted(sorted(v.tolist())) == np.median(np.abs(v - np.median(v)))


def test_otsu_parts_two_humps(spark):
    rows = [("g", x) for x in [0.3, 0.32, 0.34] * 20 + [0.9, 0.92, 0.95] * 20]
    t = laden.otsu(spark.createDataFrame(rows, "g string, x double"), "g", "x").first().threshold
    assert 0.34 < t < 0.9


def test_kappa_and_comparisons(spark):
    k = evaluate.kappa(spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 0)], "a int, b int")).first()
    assert k.observed == 0.75 and k.kappa == pytest.approx(0.5)
    a = weekly(spark, [1, 2, 3]).withColumnRenamed("value", "v")
    b = weekly(spark, [1, 5]).withColumnRenamed("value", "v")
    c = signals.compare(a, b, ["v"]).first()
    assert (c["both"], c.only_a, c.only_b, c.v_differs) == (2, 1, 0, 1)


def test_sets(spark):
    d = spark.createDataFrame([(1,), (2,), (2,)], "day int")
    with pytest.raises(ValueError):
        sets.assert_unique(d, ["day"])
    with pytest.raises(ValueError):
        sets.assert_disjoint(d, d)
    assert sets.same_rows(d, d)
    with pytest.raises(ValueError):
        sets.join_keeping_rows(d, d, ["day"])


def test_sample_days(spark):
    assert evaluate.sample_days(spark).count() == 76
