"""Operators on hand-written panels: edges, invariants, plain versions."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from phaseline.functions import metrics as M
from phaseline.operators import balance, counts, fdr, lagdiag, match, modes, panel, regress, thresholds

D0 = dt.date(2000, 1, 1)


def series(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, d date, ar int, ep int")


def test_counts_add_up(spark):
    rng = random.Random(1)
    rows = [(c, D0 + dt.timedelta(i), rng.randrange(2), rng.randrange(2)) for c in range(3) for i in range(50)]
    p = series(spark, rows)
    cells = counts.contingency(p, ["cell_id"])
    for r in cells.collect():
        own = [x for x in rows if x[0] == r.cell_id]
        assert (r.a, r.b, r.c, r.d) == tuple(sum(x[2:] == k for x in own) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
    n = p.groupBy("cell_id").agg(F.count("*").alias("n"))
    sparse = counts.sparse_contingency(p.where("ar + ep > 0").join(n, "cell_id"), ["cell_id"], "n")
    assert sorted(map(tuple, sparse.select(*cells.columns).collect())) == sorted(map(tuple, cells.collect()))
    for k in (1, 7):  # not a matter of partitioning
        assert sorted(map(tuple, counts.contingency(p.repartition(k), ["cell_id"]).collect())) == sorted(map(tuple, cells.collect()))


def test_measures_on_zero_cells(spark):
    t = spark.createDataFrame([(0, 1, 2, 3), (1, 0, 2, 3), (1, 2, 0, 3), (1, 2, 3, 0), (0, 2, 0, 3), (0, 0, 0, 0), (0, 0, 1, 2)], "a long, b long, c long, d long")
    low, high = M.lift_interval(M.lift())
    rows = t.select(M.lift().alias("lift"), M.attributable_fraction().alias("af"), M.population_attributable_fraction().alias("paf"), M.odds_ratio_fallback().alias("o"), M.woolf_odds_ratio()[0].alias("w"), low.alias("low"), M.delta_intervals()["rr"].alias("rr")).collect()
    assert rows[0].lift == 0 and rows[0].af is None and rows[0].w is None and rows[0].low is None
    assert rows[2].lift is None and rows[2].o == (1.5 * 3.5) / (2.5 * 0.5)
    assert rows[5].lift is None and rows[5].paf is None and rows[5].rr is None
    assert rows[6].lift is None and rows[6].rr is None
    assert all(x is None or x == x for r in rows for x in r)  # NULL, never NaN


def test_odds_ratio_is_symmetric(spark):
    t = spark.createDataFrame([(3, 4, 5, 6), (0, 4, 5, 6)], "a long, b long, c long, d long")
    swapped = t.select("a", F.col("c").alias("b"), F.col("b").alias("c"), "d")
    assert [r[0] for r in t.select(M.odds_ratio_fallback()).collect()] == [r[0] for r in swapped.select(M.odds_ratio_fallback()).collect()]


def test_circular_window(spark):
    """Days 1, 59, 60, 365, 366 on a ring of 366."""
    days = [dt.date(2000, 1, 1), dt.date(2000, 2, 28), dt.date(2000, 2, 29), dt.date(2000, 12, 30), dt.date(2000, 12, 31)]
    df = spark.createDataFrame([(1, d, float(i + 1)) for i, d in enumerate(days)], "cell_id long, d date, v double")
    t = {r.doy: r.thr for r in thresholds.doy_thresholds(df, "v", 1.0, 2).collect()}
    assert t[1] == 5.0 and t[2] == 5.0 and t[365] == 5.0 and t[363] == 4.0 and t[58] == 3.0 and t[62] == 3.0 and 100 not in t
    assert t[364] == 5.0 and t[57] == 2.0
    wet = thresholds.doy_thresholds(df.withColumn("v", F.lit(0.0)), "v", 0.9, 2, wet=True)
    assert {r.thr for r in wet.collect()} == {0.0}


def test_bh_against_plain(spark):
    rng = random.Random(3)
    p = [round(rng.random() ** 3, 3) for _ in range(60)] + [0.01, 0.01, None]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    known = sorted(x for x in p if x is not None)
    n = len(known)
    star = max((x for k, x in enumerate(known, 1) if x <= k / n * 0.1), default=-1)
    q = {}
    for x in set(known):
        q[x] = min(1.0, min(y * n / k for k, y in enumerate(known, 1) if y >= x))
    for r in fdr.significant(df, "p", 0.1).collect():
        assert r.sig == (r.p is not None and r.p <= star)
    for r in fdr.q_values(df, "p").collect():
        assert r.q is None if r.p is None else abs(r.q - q[r.p]) < 1e-12


def test_matching(spark):
    rows = [(1, D0 + dt.timedelta(i), int(i % 3 == 0), int(i in (2, 9, 40))) for i in range(60)]
    rows += [(2, dt.date(2001, 5, 1), 1, 1)]  # a case without controls
    p = series(spark, rows)
    month = lambda d: d.month
    cases = [r for r in rows if r[3]]
    want = {1: [0, 0], 2: [0, 0]}
    for c in cases:
        for k in rows:
            if k[0] == c[0] and not k[3] and month(k[1]) == month(c[1]):
                want[c[0]][0] += c[2] and not k[2]
                want[c[0]][1] += (not c[2]) and k[2]
    got = {r.cell_id: [r.n10, r.n01] for r in match.discordant_all(p, ["cell_id"], F.month("d")).collect()}
    assert got == want
    s = match.sampled_pairs(p, F.month("d"), 5, 42)
    per = {r.case_d: r["count"] for r in s.groupBy("case_d").count().collect()}
    assert per == {c[1]: 5 for c in cases if c[0] == 1}
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, match.sampled_pairs(p.repartition(5), F.month("d"), 5, 42).collect()))
    # January leaves 29 controls to its two cases, February 28 to its one
    strict = {k: match.sampled_pairs(p, F.month("d"), k, 42, strict=True).select("case_d").distinct().count() for k in (28, 29, 30)}
    assert strict == {28: 3, 29: 2, 30: 0}


def test_every_case_draws_its_controls(spark):
    """Floyd's draws against a plain version; strata of too few controls drop their cases."""
    import hashlib

    md5 = lambda *p: hashlib.md5("|".join(map(str, p)).encode()).hexdigest()
    cases, ctrl = [(i, i % 4) for i in range(200)], [(1000 + i, i % 3) for i in range(60)] + [(2000 + i, 3) for i in range(4)]
    want = set()
    for c, s in cases:
        own = sorted((k for k, x in ctrl if x == s), key=lambda k: (md5(42, k), k))
        chosen = []
        for top in range(len(own) - 5, len(own)) if len(own) >= 5 else ():
            r = int(md5(42, c, len(chosen))[:8], 16) % (top + 1)
            chosen.append(top if r in chosen else r)
        want |= {(c, own[r]) for r in chosen}
    got = match.drawn_controls(spark.createDataFrame(cases, "cid long, s int"), spark.createDataFrame(ctrl, "kid long, s int"), ["s"], 5, 42)
    got = [(r.cid, r.kid) for r in got.collect()]
    assert len(got) == len(want) == 750 and set(got) == want


def test_matching_uses_every_case(spark):
    from phaseline.plans import statistic_queries

    sf = "/root/testdata/sf0.01"
    m = statistic_queries._matched(spark, sf).groupBy("cid").count().collect()
    o = statistic_queries._orders(spark, sf)
    enough = o.where("ep = 0").groupBy("month", "grid").count().where("count >= 5")
    assert {r["count"] for r in m} == {5} and len(m) == o.where("ep = 1").join(enough, ["month", "grid"]).count()


def test_permutation_keeps_strata(spark):
    rows = [("a", i, i * 10) for i in range(7)] + [("b", 7, 99)]
    df = spark.createDataFrame(rows, "s string, u int, v int")
    p = match.permuted(df, "v", ["s"], "u", 6, 1)
    for it in range(6):
        own = [r for r in p.collect() if r.iter == it]
        assert sorted(r.v for r in own if r.s == "a") == [i * 10 for i in range(7)]
        assert [(r.u, r.v) for r in own if r.s == "b"] == [(7, 99)]
    assert len({tuple(r.v for r in sorted(p.where(F.col("iter") == it).collect(), key=lambda r: r.u)) for it in range(6)}) > 3


def test_cross_correlation(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 2, 40), rng.integers(0, 2, 40)
    df = spark.createDataFrame([(1, i, int(x[i]), int(y[i])) for i in range(40)] + [(2, i, 1, int(y[i])) for i in range(40)], "cell_id long, t int, ar int, ep int")
    got = {(r.cell_id, r.lag): r.r for r in lagdiag.cross_correlation(df, 6).collect()}
    for k in range(-6, 7):
        s = sum((x[t + k] - x.mean()) * (y[t] - y.mean()) for t in range(40) if 0 <= t + k < 40)
        assert abs(got[1, k] - s / (x.std() * y.std() * 40)) < 1e-12 and got[2, k] == 0.0
    tie = spark.createDataFrame([(1, -2, 0.5), (1, 3, -0.5), (1, 0, 0.1)], "cell_id long, lag int, r double")
    assert lagdiag.strongest(tie).first().lag == -2


def test_lag_queries_read_every_day(spark):
    """Events, exposures and lag sums of the whole panel against plain ones."""
    from phaseline.plans import lag_queries, standins

    sf = "/root/testdata/sf0.001"
    rows = [(r.cell_id, r.d, r.ar, r.ep) for r in standins.panel(spark, sf).collect()]
    first, last = min(r[1] for r in rows), max(r[1] for r in rows)
    n = (last - first).days + 1
    dense = lag_queries.densified_panel(spark, sf)
    assert dense.count() == n * len({r[0] for r in rows}) and dense.agg(F.sum("ar"), F.sum("ep")).first()[:] == (sum(r[2] for r in rows), sum(r[3] for r in rows))
    x = {c: np.zeros((2, n)) for c, *_ in rows}
    for c, d, a, e in rows:
        x[c][:, (d - first).days] = a, e
    near, share, mean = {}, {}, {}
    for c, (a, e) in x.items():
        for k in range(-15, 16):
            if a.std() * e.std():
                lo, hi = max(0, -k), min(n, n - k)
                near[c, k] = ((a[lo + k : hi + k] - a.mean()) * (e[lo:hi] - e.mean())).sum() / (n * a.std() * e.std())
        at, on = np.flatnonzero(e), np.flatnonzero(a)
        for k in range(8):
            if len(at):
                share[c, k] = np.mean([len(on) > 0 and abs(on - t).min() <= k for t in at])
        for k in range(-5, 6):
            own = [a[t - k] for t in at if 0 <= t - k < n]
            if own:
                mean[c, k] = np.mean(own)
    for r in lag_queries.cross_correlation(spark, sf).collect():
        assert abs(r.r - near.get((r.cell_id, r.lag), 0)) < 2e-6
    got = {(r.cell_id, r.lag): r.share for r in lag_queries.hit_cdf(spark, sf).collect()}
    assert got.keys() == share.keys() and all(abs(got[k] - v) < 2e-6 for k, v in share.items())
    got = {(r.cell_id, r.tau): r.eta for r in lag_queries.eta(spark, sf).collect()}
    assert got.keys() == mean.keys() and all(abs(got[k] - v) < 2e-6 for k, v in mean.items())


def test_nearest_labels(spark):
    labels = spark.createDataFrame([(dt.date(2000, 1, 1), "a"), (dt.date(2000, 1, 11), "b")], "day date, phase string")
    times = spark.createDataFrame([(dt.date(2000, 1, d),) for d in (1, 5, 6, 7, 30)] + [(dt.date(1999, 1, 1),)], "d date")
    got = {r.d.isoformat(): r.phase for r in modes.nearest_labels(times, labels).collect()}
    assert got == {"2000-01-01": "a", "2000-01-05": "a", "2000-01-06": "b", "2000-01-07": "b", "2000-01-30": "b", "1999-01-01": "a"}
    near = {r.d.isoformat(): r.phase for r in modes.nearest_labels(times, labels, tolerance=5).collect()}
    assert near["2000-01-30"] is None and near["1999-01-01"] is None and near["2000-01-06"] == "b"


def test_nearest_labels_use_every_label(spark):
    from phaseline.plans import mode_queries, standins

    sf = "/root/testdata/sf0.001"
    labels = {r.key: r.phase for r in standins.labels(spark, sf).where("mode = 'MJO'").collect()}
    got = {r.day: r.phase for r in mode_queries.asof_nearest_label(spark, sf).collect()}
    assert got == {d: labels[min(labels, key=lambda k: (abs((k - d).days), -k.toordinal()))] for d in got}


def test_phases(spark):
    d = spark.createDataFrame([(0.5,), (-0.5,), (0.51,), (-0.51,), (None,)], "v double")
    assert [r[0] for r in d.select(modes.phase_of(F.col("v"))).collect()] == ["Neutral", "Neutral", "Positive", "Negative", None]
    m = spark.createDataFrame([(0.9, 3), (1.0, 4), (1.0, 5), (2.0, 9), (None, 1)], "a double, p int")
    assert [tuple(r) for r in m.select(modes.coarse_phase(F.col("a"), F.col("p")), modes.detailed_phase(F.col("a"), F.col("p"))).collect()] == [("Inactive", "Inactive"), ("Active_1to4", "Phase_4"), ("Active_5to8", "Phase_5"), (None, None), (None, None)]


def test_queries_repeat_as_often_as_the_reference(spark, monkeypatch):
    from phaseline.plans import registry

    sf, q = "/root/testdata/sf0.001", registry.queries()
    assert q["placebo_month_shuffle"](spark, sf).count() == 20
    assert q["calendar_month_permutation"](spark, sf).agg(F.count_distinct("iter")).first()[0] == 20
    assert q["perturbation_test"](spark, sf).first().n == 500
    asked = []
    real = modes.bootstrap_contrasts
    monkeypatch.setattr(modes, "bootstrap_contrasts", lambda b, k, n, *a: asked.append(n) or real(b, k, n, *a))
    monkeypatch.setattr(lagdiag, "monte_carlo", lambda d, n, *a, f=lagdiag.monte_carlo: asked.append(n) or f(d, n, *a))
    for name in ("block_bootstrap_diff", "effect_ranking", "best_lag", "ranking_top40", "seq_mc_pvalue", "point_diagnostics"):
        q[name](spark, sf)
    assert asked == [500] * 6


def test_monte_carlo_is_a_permutation_test(spark):
    """Drawn joint counts have the distribution of shuffles within months, and the rule stops at the first draw it may."""
    rng = np.random.default_rng(4)
    rows = []
    for c in range(8):
        for t in range(120):
            ar = int(rng.random() < 0.3)
            rows.append((c, dt.date(2000, 1, 1) + dt.timedelta(days=t), t, ar, int(rng.random() < (0.15 + 0.1 * c * ar) / 1.5)))
    rows += [(9, dt.date(2000, 1, 1) + dt.timedelta(days=t), t, 0, t % 2) for t in range(50)]
    df = spark.createDataFrame(rows, "cell_id int, d date, t int, ar int, ep int")
    got = {r.cell_id: r for r in lagdiag.monte_carlo(df, 2000, absolute=0.0, relative=0.0).collect()}
    assert got[9].n == 0 and got[9].p is None and not got[9].converged
    for c in range(8):
        own = [(d.month, a, e) for k, d, _, a, e in rows if k == c]
        m, a, e = (np.array(v) for v in zip(*own))
        stats = np.zeros(4000)
        for i in range(4000):
            x = a.copy()
            for k in set(m.tolist()):
                x[m == k] = rng.permutation(x[m == k])
            stats[i] = (x * e).sum()
        assert got[c].n == 2000 and abs(got[c].p - (stats >= (a * e).sum()).mean()) < 0.05
    early = {r.cell_id: r for r in lagdiag.monte_carlo(df, 500).collect()}
    assert all(10 <= r.n <= 500 for k, r in early.items() if k < 8)
    for r in early.values():
        if r.converged:
            half = 1.96 * (r.p * (1 - r.p) / (r.n + 1)) ** 0.5
            assert half <= 0.01 or half / r.p <= 0.1


def test_dominant_mode_is_masked(spark):
    """Of a mode's correlations only those count that pass its FDR mask, however large the others are."""
    from phaseline.plans import statistic_queries as Q

    rows = [("ENSO", 1, 100, 20, 0.5), ("AO", 1, 100, 20, -0.1), ("PDO", 1, 30, 20, None), ("ENSO", 2, 100, 20, 0.1), ("AO", 2, 30, 20, 0.3), ("AO", 3, 100, 20, -0.6), ("ENSO", 3, 100, 20, 0.02)]
    c = Q._with_p(spark.createDataFrame(rows, "mode string, cell_id long, n long, k long, r double"))
    assert {r.cell_id: (r["mode"], r.r) for r in Q._dominant(Q._masked(c)).collect()} == {1: ("ENSO", 0.5), 2: ("no-dominant", None), 3: ("AO", -0.6)}
    few = Q.point_biserial(spark, "/root/testdata/sf0.01").where("k < 10")
    assert few.count() and not few.where("r is not null").count()


def test_pair_rows_note_few_blocks(spark):
    """A phase of two months is compared, has no bootstrap and says so."""
    made = [("m", ph, f"2000-0{k}-01", 3 + k, 5, 2, 9) for ph, n in (("ElNino", 4), ("LaNina", 4), ("Neutral", 2)) for k in range(1, n + 1)]
    b = spark.createDataFrame(made, "mode string, phase string, ym string, a long, b long, c long, d long")
    got = {(r.phase1, r.phase2): r for r in modes.pair_rows(b, ["mode"], 20, 42, ["rd"]).collect()}
    assert len(got) == 3
    for (one, two), r in got.items():
        few = "Neutral" in (one, two)
        assert (r.note == modes.FEW_BLOCKS) == few and (r.rd_mean is None) == few and r.d_rd is not None
        assert r.comparison == f"m: {one} - {two}" and r.blocks1 == (2 if one == "Neutral" else 4)


def test_bootstrap_of_equal_phases(spark):
    rows = [("m", p, dt.date(2000, 1 + i % 12, 1), 5, 5, 5, 5) for p in ("Positive", "Negative") for i in range(6)]
    b = spark.createDataFrame(rows, "mode string, phase string, ym date, a long, b long, c long, d long")
    r = modes.bootstrap_contrasts(b, ["mode"], 20, 42, ["rd"]).first()
    assert r["mean"] == 0 and r.p == 1.0 and not r.sig


def test_regions_overlap_and_bounds(spark):
    boxes = spark.createDataFrame([("x", 0.0, 1.0, 0.0, 1.0), ("y", 1.0, 2.0, 0.0, 1.0)], "region string, lon_min double, lon_max double, lat_min double, lat_max double")
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 5.0)], "cell_id long, lat double, lon double")
    assert sorted(r.region for r in panel.with_regions(p, boxes).collect()) == ["x", "y"]


def test_binary_and_present(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (0.7,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in d.select(panel.binary(F.col("v"))).collect()] == [0, 1, 0, 1, None, None]
    assert [r[0] for r in d.select(panel.present(F.col("v"))).collect()] == [1, 1, 1, 1, 0, 0]


def test_interpolation(spark):
    t = lambda h: dt.datetime(2000, 1, 1) + dt.timedelta(hours=h)
    d = spark.createDataFrame([(1, t(0), 0.0), (1, t(12), 12.0), (1, t(14), 20.0)], "cell_id long, ts timestamp, v double")
    got = sorted((r.ts, r.v) for r in panel.interpolated(d, "ts", "v", 6).collect())
    assert [v for _, v in got] == [0.0, 6.0, 12.0]


def test_smoothing(spark):
    d = spark.createDataFrame([(i, j, float(i * 3 + j)) for i in range(3) for j in range(3)], "i int, j int, x double")
    near = {(r.i, r.j): r.x for r in panel.box_smoothed(d, "x", 3).collect()}
    grid = np.pad(np.arange(9.0).reshape(3, 3), 1, mode="edge")
    assert all(abs(near[i, j] - grid[i : i + 3, j : j + 3].mean()) < 1e-12 for i in range(3) for j in range(3))
    const = {(r.i, r.j): r.x for r in panel.box_smoothed(d, "x", 3, "constant").collect()}
    assert const[1, 1] == 4.0 and const[0, 0] is None


def test_total_variation(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (0, "a"), (0, "b")], "g int, k string")
    s = balance.shares(d, ["k"], ["g"])
    assert balance.total_variation(s.where("g = 1"), s.where("g = 0"), ["k"]).first().tv == 0.5


def test_logit_against_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (600, 2)).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(-(-0.5 + x @ [0.8, -0.4])))).astype(int)
    df = spark.createDataFrame([(int(a), float(b[0]), float(b[1])) for a, b in zip(y, x)], "y int, u double, v double")
    got = {r.term: (r.beta, r.se) for r in regress.logit(df, "y", ["u", "v"]).collect()}
    full, beta = np.column_stack([np.ones(600), x]), np.zeros(3)
    for _ in range(40):
        mu = 1 / (1 + np.exp(-full @ beta))
        info = full.T @ (full * (mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(info, full.T @ (y - mu))
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    for k, t in enumerate(("const", "u", "v")):
        assert abs(got[t][0] - beta[k]) < 1e-6 and abs(got[t][1] - se[k]) < 1e-6


def test_keep_one_and_runs(spark):
    d = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 5, "z")], "k int, o int, v string")
    assert sorted(r.v for r in panel.keep_one(d, ["k"], ["o"]).collect()) == ["x", "z"]
    assert sorted(r.v for r in panel.keep_one(d, ["k"], ["o"], last=True).collect()) == ["y", "z"]
    r = spark.createDataFrame([(1, t) for t in (1, 2, 3, 7, 8)], "c int, t long")
    assert sorted((x.first, x.last, x.n) for x in panel.runs(r, "t", ["c"]).collect()) == [(1, 3, 3), (7, 8, 2)]


def test_exact_quantiles(spark):
    """Against sorted values: ties, one value, far outliers, groups, nulls, none at all."""
    rng = np.random.default_rng(6)
    groups = {0: rng.normal(size=5001), 1: np.repeat([1.0, 2.0, 2.0, 7.0], 50), 2: np.array([3.5]), 3: np.concatenate([rng.random(3000) * 1e-9, [1e12, -1e12]]), 4: rng.integers(0, 5, 1000).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [(0, None), (5, None)], "k int, v double").repartition(5)
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.thr for r in thresholds.exact_quantile(df, "v", q, ["k"]).collect()}
        assert got.keys() == groups.keys()
        assert all(abs(got[k] - np.quantile(x, q)) <= 1e-12 * max(1, abs(got[k])) for k, x in groups.items())
        one = thresholds.exact_quantile(df, "v", q).collect()
        assert len(one) == 1 and abs(one[0].thr - np.quantile(np.concatenate(list(groups.values())), q)) <= 1e-12 * max(1, abs(one[0].thr))
    assert thresholds.exact_quantile(df.where("k = 5"), "v", 0.5).count() == 0
    assert thresholds.global_threshold(df.where("v < 0"), "v", 0.95).collect()[0].thr is None


def test_false_discovery_of_tiny_values(spark):
    """p values over three hundred orders of magnitude, ties, 0 and 1, against sorting."""
    rng = np.random.default_rng(8)
    p = np.concatenate([10.0 ** -rng.uniform(0, 300, 400), np.repeat(0.03, 20), rng.random(300), [0.0, 0.0, 1.0, 1.0, 5e-324]])
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    want = np.empty(len(p))
    want[order] = np.minimum(1, q)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(-1, None)], "i int, p double")
    got = {r.i: r.q for r in fdr.q_values(df, "p").collect()}
    assert got[-1] is None and all(abs(got[i] - w) <= 1e-12 * max(w, 1e-300) + 0 * w or abs(got[i] / w - 1) < 1e-9 for i, w in enumerate(want))
    star = max((x for x, k in zip(p[order], range(1, len(p) + 1)) if x <= k / len(p) * 0.05), default=-1)
    assert {r.i for r in fdr.significant(df, "p", 0.05).where("sig").collect()} == {i for i, x in enumerate(p) if x <= star}


def test_smoothing_of_wide_boxes(spark):
    """Boxes wider than the grid, and missing values."""
    x = np.arange(20.0).reshape(4, 5)
    d = spark.createDataFrame([(i, j, None if (i, j) == (1, 1) else float(x[i, j])) for i in range(4) for j in range(5)], "i int, j int, x double")
    x[1, 1] = np.nan
    for size in (3, 7):
        got = {(r.i, r.j): r.x for r in panel.box_smoothed(d, "x", size).collect()}
        grid = np.pad(x, size // 2, mode="edge")
        assert all(abs(got[i, j] - np.nanmean(grid[i : i + size, j : j + size])) < 1e-12 for i in range(4) for j in range(5))
