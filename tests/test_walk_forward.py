"""Walk-forward figures that are merged from chunks against each window by itself."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import stats
from barloom.operators.sweep import window_figures


@pytest.mark.parametrize("k", [2, 3, 10])
def test_equals_each_window_by_itself(spark, k):
    rng = np.random.default_rng(k)
    curves, trades, want = [], [], {}
    for name, n, drift in (("long", 307, 0.0), ("short", 5 * (k + 1), 0.01), ("flat", 200, None), ("few", 5 * (k + 1) - 1, 0.0), ("odd", 120, 0.0)):
        e = np.ones(n) if drift is None else np.exp(np.cumsum(rng.normal(drift, 0.02, n)))
        if name == "odd":
            e[50] = 0.0  # a base that can't be divided by
        o = 100 * np.exp(rng.normal(0, 0.1, n))
        c = o * np.exp(rng.normal(0, 0.02, n))
        curves.append(pd.DataFrame({"run": name, "idx": np.arange(n), "open": o, "close": c, "equity": e}))
        own = [] if drift is None else [(name, j, int(i), float(rng.normal(0, 3))) for j, i in enumerate(sorted(rng.choice(n, min(n, 40), replace=False)))]
        trades += own
        if n >= 5 * (k + 1):
            at = [n * i // (k + 1) for i in range(k + 2)]
            for f in range(k):
                for part, a, b in (("IS", 0, at[f + 1]), ("OOS", at[f + 1], at[f + 2])):
                    curve = e[a:b] / e[a] if e[a] else e[a:b]
                    want[name, f, part] = window_figures(np.array([p for *_, i, p in own if a <= i < b]), curve, o[a], c[b - 1], 8760)
    df = spark.createDataFrame(pd.concat(curves)).repartition(4)
    got = stats.walk_forward_stats(spark.createDataFrame(trades, "run string, trade_no int, entry_idx int, return_pct double"), df, ["run"], k, F.lit(8760)).collect()
    assert {(r.run, r.fold, r.part) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        for c, v in want[r.run, r.fold, r.part].items():
            if v is None or r[c] is None:
                assert v is None and r[c] is None, (c, r)
            else:
                assert r[c] == pytest.approx(v, rel=1e-7, abs=1e-7), (c, r)


def test_no_bar_is_read_for_several_windows(spark):
    df = spark.createDataFrame([("a", i, 1.0, 1.0, 1.0 + i) for i in range(60)], "run string, idx int, open double, close double, equity double")
    trades = spark.createDataFrame([("a", 0, 3, 1.0)], "run string, trade_no int, entry_idx int, return_pct double")
    # one Generate over the summaries of chunks, whatever k is
    plans = [stats.walk_forward_stats(trades, df, ["run"], k, F.lit(1))._jdf.queryExecution().optimizedPlan().toString() for k in (2, 10)]
    assert all(p.count("Generate") == 1 and p.index("Generate") < p.index("Aggregate") for p in plans) and len(plans[0].splitlines()) == len(plans[1].splitlines())
