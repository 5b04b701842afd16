"""Statistics and networks against the published results."""

import numpy as np
import published as P
import pytest
from pyspark.sql import functions as F

from tidepanel import schemas
from tidepanel.functions import special
from tidepanel.operators import graph, stats

S = list(schemas.SECTORS)


def near(a, b, rel=1e-9, absolute=1e-12):
    return a == pytest.approx(b, rel=rel, abs=absolute)


def test_stationarity_tails():
    for tau, p, eta, q, lags, used in P.STATIONARITY:
        assert near(special.adf_pvalue(tau), p) and near(special.kpss_pvalue(eta), q) and used == 258 - lags - 1


def test_granger_tails_and_corrections(spark):
    for lag, n, f, p, *_ in P.GRANGER:
        assert abs(special.f_sf(f, lag, n - 3 * lag - 1) - p) < 1e-12
    df = spark.createDataFrame([(i, r[3]) for i, r in enumerate(P.GRANGER)], "i int, p_value double")
    got = {r.i: r for r in stats.multiplicity(df).collect()}
    for i, (_, _, _, p, q, b, w) in enumerate(P.GRANGER):
        r = got[i]
        assert near(r.p_value_fdr_bh, q) and near(r.p_value_bonferroni, b) and near(r.edge_weight, w)
        assert (r.significant_raw_05, r.significant_fdr_05, r.significant_bonferroni_05) == (p < 0.05, q <= 0.05, b <= 0.05)


def test_correction_in_many_ranges(spark, monkeypatch):
    """Corrected p of many rows with ties and of two runs, as the rule says it row by row."""
    monkeypatch.setattr(stats, "P_RANGES", 7)
    rng = np.random.default_rng(3)
    rows = [(f"r{i % 2}", i, float(np.round(rng.random() ** 3, 2))) for i in range(500)] + [("r0", 900, None)]
    df = spark.createDataFrame(rows, "run string, i int, p_value double")
    for run in ([], ["run"]):
        got = {r.i: r.p_value_fdr_bh for r in stats.multiplicity(df, run=run).collect()}
        for name in {r[0] for r in rows} if run else {None}:
            some = sorted((p, i) for n, i, p in rows if p is not None and (name is None or n == name))
            low = 1.0
            for k in range(len(some), 0, -1):
                p, i = some[k - 1]
                low = min(low, p * len(some) / k)
                assert near(got[i], low)
        assert got[900] is None


def test_lead_lag_tails(spark):
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(P.LEAD_LAG)], "i int, corr double, n_obs long")
    got = {r.i: r for r in stats.significant(df).collect()}
    for i, (_, _, p, on) in enumerate(P.LEAD_LAG):
        assert abs(got[i].pvalue - p) < 1e-12 and got[i].significant == on


def test_directed_network(spark):
    results = spark.createDataFrame([(a, b, p, "True") for a, b, p, _ in P.EDGES] + [("Energy", "Utilities", 0.3, "False")], "source string, target string, p_value double, flag string")
    edges = graph.edge_table(results, "flag", "p_value", "raw")
    weights = {(r.source, r.target): r.edge_weight for r in edges.collect()}
    assert len(weights) == len(P.EDGES) and all(near(weights[a, b], w) for a, b, _, w in P.EDGES)
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(S)], "node string, ord int")
    for r in graph.node_metrics(edges, nodes).collect():
        i, o, rank, between, hub, authority = P.NODES[r.node]
        assert (r.in_degree, r.out_degree) == (i, o)
        assert near(r.pagerank, rank) and near(r.betweenness_centrality, between) and near(r.hub_score, hub, absolute=1e-9) and near(r.authority_score, authority, absolute=1e-9)
    empty = graph.node_metrics(edges.where("false"), nodes).collect()
    assert len(empty) == 10 and all(r.pagerank == r.hub_score == r.betweenness_centrality == r.total_degree == 0 for r in empty)


def test_price_network(spark):
    cells = [(a, b, v) for i, row in enumerate(P.CORRELATIONS) for a, b, v in zip([S[i]] * 9, S[i + 1 :], row, strict=False)]
    matrix = spark.createDataFrame([(a, b, v) for a, b, v in cells] + [(b, a, v) for a, b, v in cells] + [(s, s, 1.0) for s in S], "a string, b string, corr double")
    limit = stats.corr_threshold(matrix)
    assert limit.first().threshold == pytest.approx(0.4944697877729007, abs=1e-15)
    edges = graph.threshold_edges(matrix, limit, S)
    assert {(r.source, r.target): r.corr for r in edges.collect()} == {(a, b): v for a, b, v in P.PRICE_EDGES}
    for r in graph.corr_nodes(matrix, limit).collect():
        degree, total, mean = P.PRICE_NODES[r.node]
        assert r.degree == degree and near(r.weighted_degree, total) and near(r.avg_abs_corr, mean)
    best = max(cells, key=lambda x: abs(x[2]))
    assert {stats.top_pairs(matrix, 1).first().a, stats.top_pairs(matrix, 1).first().b} == set(best[:2])


def test_coverage_ratios(spark):
    from tidepanel.operators import panel

    rows = []
    for k, (days, no_return, _, with_sentiment, _, both, _) in enumerate(P.COVERAGE):
        for t in range(days):
            rows.append((f"s{k}", t, None if t < no_return else 0.1, 0.2 if t >= days - with_sentiment else None, 1))
    df = spark.createDataFrame(rows, "sector_label string, t int, sector_return double, sentiment_weighted_mean double, article_count long")
    got = {r.sector_label: r for r in panel.coverage(df).collect()}
    for k, (days, missing, ratio, _, sentiment_ratio, both, both_ratio) in enumerate(P.COVERAGE):
        r = got[f"s{k}"]
        assert (r.n_trading_days, r.return_missing_count) == (days, missing) and near(r.return_missing_ratio, ratio) and near(r.sentiment_missing_ratio, sentiment_ratio)
        assert r.both_non_null_count == both and near(r.both_non_null_ratio, both_ratio)


def test_permutations_of_a_small_network(spark):
    """The share among 2,000 random relabellings is near that among all 120."""
    from itertools import permutations

    names = list("abcde")
    first, second = [("a", "b"), ("b", "c"), ("c", "d")], [("a", "b"), ("b", "c"), ("d", "e")]
    at = {n: i for i, n in enumerate(names)}
    a, b = np.zeros((5, 5), int), np.zeros((5, 5), int)
    for m, e in ((a, first), (b, second)):
        for x, y in e:
            m[at[x], at[y]] = m[at[y], at[x]] = 1
    seen = (a * b).sum()
    share = np.mean([(a[np.ix_(p, p)] * b).sum() >= seen for p in permutations(range(5))])
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    frames = [spark.createDataFrame(e, "source string, target string") for e in (first, second)]
    r = graph.qap(*frames, nodes).first()
    assert r.observed == seen and abs(r.p_value - share) < 0.04
    flat = graph.qap(frames[0].where("false"), frames[1], nodes).first()
    assert flat.p_value is None


def test_similarity_of_identical_disjoint_and_empty_networks(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    e = lambda *p: spark.createDataFrame(list(p), "source string, target string")
    of = lambda x, y: {r.metric: r.value for r in graph.similarity(x, y, nodes).collect()}
    same = of(e(("a", "b")), e(("b", "a")))
    apart = of(e(("a", "b")), e(("c", "d")))
    none = of(e(("a", "b")).where("false"), e(("a", "b")).where("false"))
    assert (same["jaccard"], same["frobenius"]) == (1, 0) and near(same["pearson"], 1.0) and near(same["pearson_pvalue"], 0.0)
    assert apart["jaccard"] == 0 and apart["shared_edges"] == 0 and apart["pearson"] < 0
    assert none["jaccard"] is None and none["pearson"] is None and none["pearson_pvalue"] is None and none["frobenius_similarity"] == 1


def test_lead_lag_rules(spark):
    """A constant, 29 days, a tie of two lags, and a gap: the lead counts rows of the calendar."""
    t = list(range(60))
    wave = [float((i * 7) % 5) for i in t]
    rows = [("wave", i, wave[i]) for i in t] + [("flat", i, 1.0) for i in t] + [("few", i, wave[i] if i < 29 else None) for i in t]
    df = spark.createDataFrame(rows, "series string, t int, value double")
    tested = stats.lead_lag(df, df, "series", "t", "value", 5)
    got = {(r.s, r.r, r.lag): r for r in tested.collect()}
    assert got["flat", "wave", 0].corr is None and got["few", "wave", 0].corr is None and got["few", "wave", 0].n_obs == 29
    best = {(r.s, r.r): r for r in stats.best_lag(tested).collect()}
    assert best["flat", "wave"].best_lag == 0 and best["flat", "wave"].corr is None
    assert best["wave", "wave"].best_lag == 0  # lag 5 is as good
    gap = spark.createDataFrame([("g", i, None if i == 30 else wave[i]) for i in t], "series string, t int, value double")
    lagged = {r.lag: r.n_obs for r in stats.lead_lag(df.where("series = 'wave'"), gap, "series", "t", "value", 2).collect()}
    assert lagged == {0: 59, 1: 58, 2: 57}
    pairs = stats.pairs(df.where("series = 'wave'"), "series", "t", "value", gap)
    assert stats.granger(pairs, 1).first().n_obs == 59  # here the row goes first, then lags are taken


def test_thresholds_are_strict(spark):
    m = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("a", "c", -0.7), ("c", "a", -0.7)], "a string, b string, corr double")
    limit = stats.corr_threshold(m, 0.5)
    assert [(r.source, r.target) for r in graph.threshold_edges(m, limit).collect()] == [("a", "c")]
    assert [(r.source, r.target) for r in graph.threshold_edges(m, limit, ["c", "b", "a"]).collect()] == [("c", "a")]
    with pytest.raises(ValueError):
        stats.corr_threshold(m, 1.5)
    assert m.select(F.max("corr")).first()[0] == 0.5
