import collections
import statistics
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import same_rows
from fairlead import config as C
from fairlead.plans import queries
from fairlead.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


def test_queries_without_sql_are_those_with_a_plain_loop_beside_them():
    """Injected events and what follows from them: test_series; the bootstrap, whose draws are a generator's: below and test_study."""
    assert set(QUERIES) - set(ORACLES) == {"injection_detect", "roc_points", "operating_point", "bootstrap_did", "mde", "study_results", "study_sensitivity", "study_intervals"}


def test_bootstrap_queries_are_a_plain_loop_over_weeks(spark, sf_dir):
    days = collections.Counter(r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate")).collect())
    blocks = {w: collections.defaultdict(lambda: [0, 0]) for w in queries._WINDOWS}
    for d, n in days.items():
        for w, (a, b) in queries._WINDOWS.items():
            if date.fromisoformat(a) <= d <= date.fromisoformat(b):
                week = blocks[w][d - timedelta(days=d.weekday())]
                week[0] += n
                week[1] += 1
    weeks = {w: [b[k] for k in sorted(b)] for w, b in blocks.items()}

    def did(pick):
        mean = {w: sum(weeks[w][i][0] for i in p) / sum(weeks[w][i][1] for i in p) for w, p in pick.items()}
        return (mean["B26"] - mean["A26"]) - (mean["B25"] - mean["A25"])

    r = np.random.default_rng(C.DID_SEED)
    draws = sorted(did({w: r.integers(0, len(weeks[w]), len(weeks[w])) for w in C.WINDOWS}) for _ in range(C.BOOTSTRAP_N))

    def at(share):
        place = share * (len(draws) - 1)
        low = int(place)
        return draws[low] + (place - low) * (draws[min(low + 1, len(draws) - 1)] - draws[low])

    got = QUERIES["bootstrap_did"](spark, sf_dir).first()
    assert got.point == pytest.approx(did({w: range(len(b)) for w, b in weeks.items()}))
    assert (got.low, got.high) == pytest.approx((at(0.025), at(0.975)))
    assert got.p == pytest.approx(min(1, 2 * min(sum(d <= 0 for d in draws), sum(d >= 0 for d in draws)) / len(draws)))
    least = QUERIES["mde"](spark, sf_dir).first()
    se = statistics.stdev(draws)
    assert (least.se, least.mde) == pytest.approx((se, (1.959964 + 0.841621) * se), rel=1e-5)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
