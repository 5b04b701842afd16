"""Rules on small rows and published identities."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import special
from tidepanel.functions import text as X
from tidepanel.operators import graph, panel, stats
from tidepanel.streaming import ingest


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_sessions(spark):
    days = spark.createDataFrame([(dt.date(2026, 1, d),) for d in (5, 6, 7, 9)], ["trade_date"])
    cases = [
        ("2026-01-05T08:59:59", "PRE_MARKET", 5), ("2026-01-05T09:00:00", "MORNING", 5), ("2026-01-05T11:29:59", "MORNING", 5), ("2026-01-05T11:30:00", "AFTERNOON", 5), ("2026-01-05T14:44:59", "AFTERNOON", 5), ("2026-01-05T14:45:00", "NEXT_MORNING", 6),
        ("2026-01-08T10:00:00", "NEXT_MORNING", 9), ("2026-01-04T23:00:00", "NEXT_MORNING", 5), ("2026-01-09T15:00:00", "NEXT_MORNING", None), ("2026-01-10T09:00:00", "NEXT_MORNING", None), (None, "UNKNOWN", None), ("bad", "UNKNOWN", None), ("2026-01-05T01:59:59Z", "PRE_MARKET", 5),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string").withColumn("published_at_vn", X.market_time("s"))
    got = {r.i: (r.session_bucket, r.trade_date and r.trade_date.day) for r in panel.map_sessions(df, days).collect()}
    assert got == {i: (c[1], c[2]) for i, c in enumerate(cases)}


def test_dates_scores_and_labels(spark):
    for s in ("2026-05-01T17:39:00", "01/05/2026 - 09:02", "01/05/2026"):
        assert one(spark, X.parse_datetime(F.lit(s))).date() == dt.date(2026, 5, 1)
    assert one(spark, X.parse_datetime(F.lit(""))) is None and one(spark, X.parse_datetime(F.lit("x"))) is None
    assert [one(spark, X.clip_score(F.lit(s).cast("string"))) for s in ("2", "-3", "0.4", "nan", "abc", None)] == [1, -1, 0.4, None, None, None]
    assert [one(spark, X.label_score(X.sentiment_label(F.lit(s).cast("string")))) for s in ("Tích cực", "NEUTRAL", "trung tính", "tiêu cực", "other", None)] == [1, 0, 0, -1, None, None]


def test_tickers(spark):
    cases = {'["VCB","fpt"]': ["VCB", "FPT"], "['VCB']": ["VCB"], "VCB, BID": ["VCB", "BID"], "NT2, POW": ["POW"], '{"a":"VCB"}': ["VCB"], '"VCB"': ["VCB"], "null": [], "": []}
    for s, want in cases.items():
        assert one(spark, X.ticker_list(F.lit(s))) == want, s


def test_cascade(spark):
    rows = [("VCB, BID", None, ""), ("VCB, FPT", None, ""), (None, "Hàng tiêu dùng thiết yếu", ""), (None, "lãi suất", ""), (None, None, "khi nào"), (None, None, "")]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "article_id string, tickers string, summary_sector string, title string")
    got = [(r.sector_mapping_method, r.sector_mapping_confidence, list(r.sector_labels)) for r in panel.label_articles(df).orderBy("article_id").collect()]
    assert got == [("ticker", 1.0, ["Banking"]), ("multi_ticker", 0.95, ["Banking", "Technology"]), ("keyword", 0.8, ["ConsumerStaples", "ConsumerDiscretionary"]), ("macro", 0.8, []), ("keyword_fallback", 0.6, ["Energy"]), ("unmapped", 0.0, [])]


def test_weighted_aggregate(spark):
    df = spark.createDataFrame([("d", "a", 0.5, 1.0, "1"), ("d", "a", None, 0.5, "2"), ("d", "a", -0.05, 0.5, "3"), ("d", "a", 0.06, None, None), ("d", "b", None, 1.0, "5")], "trade_date string, sector_label string, sentiment_score double, sector_weight double, article_id string")
    a, b = panel.daily_sentiment(df).orderBy("sector_label").collect()
    assert (a.article_count, a.row_count, a.weighted_article_count, a.positive_count, a.neutral_count, a.negative_count) == (4, 4, 3.0, 2, 1, 0)
    assert np.allclose([a.sentiment_sum, a.sentiment_mean, a.weighted_sentiment_sum, a.sentiment_weighted_mean], [0.51, 0.17, 0.535, 0.214])
    assert (b.sentiment_mean, b.weighted_sentiment_sum, b.positive_weighted_count, b.weighted_article_count) == (None, None, 0.0, 1.0)


def test_multiplicity(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.02, 0.03, 0.04))] + [(9, None)], "i int, p_value double")
    got = {r.i: r for r in stats.multiplicity(df).collect()}
    assert np.allclose([got[i].p_value_fdr_bh for i in range(4)], 0.04) and np.allclose([got[i].p_value_bonferroni for i in range(4)], [0.04, 0.08, 0.12, 0.16])
    assert got[9].p_value_fdr_bh is None and not got[9].significant_raw_05


def test_special_functions():
    assert special.t_sf2(2.228138851986, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.f_sf(4.964602743730715, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.kpss_pvalue(0.463) == 0.05 and special.adf_pvalue(-2.8618) == pytest.approx(0.05, abs=2e-3)


def test_granger_and_series():
    rng = np.random.default_rng(0)
    x, e = rng.normal(size=300), rng.normal(size=300)
    y = np.concatenate([[0], x[:-1]]) + 0.3 * e
    assert stats.granger_f(y, x, 1)[1] < 1e-20 < stats.granger_f(x, y, 1)[1]
    assert stats.granger_f(y, 3 * x + 7, 2)[0] == pytest.approx(stats.granger_f(y, x, 2)[0], rel=1e-8)
    walk = np.cumsum(e)
    assert special.adf_pvalue(stats.adf(e)[0]) < 0.01 < special.adf_pvalue(stats.adf(walk)[0]) and special.kpss_pvalue(stats.kpss(walk)) <= 0.05
    assert stats.ljung_box(e) > 0.01 and stats.ljung_box(walk) < 1e-6


def test_central_scores():
    a = np.zeros((4, 4))
    a[0, 1] = a[1, 2] = a[2, 3] = 1.0
    assert np.allclose(graph.betweenness_scores(a), [0, 2 / 6, 2 / 6, 0])
    hub, authority = graph.hits_scores(np.array([[0, 2.0, 1.0], [0, 0, 0], [0, 0, 0]]))
    assert np.allclose(hub, [1, 0, 0]) and np.allclose(authority, [0, 2 / 3, 1 / 3])


def test_graph_of_nothing(spark):
    nodes = spark.createDataFrame([("a", 0), ("b", 1)], "node string, ord int")
    edges = spark.createDataFrame([], "source string, target string, edge_weight double")
    assert all(r.total_degree == 0 for r in graph.node_degrees(edges, nodes).collect())
    s = graph.network_summary(edges, nodes, "raw").first()
    assert (s.top_sender_by_weight, s.strongest_edge_source, s.total_edges) == ("", None, 0)


def test_json_object():
    assert X.first_json_object('```json {"a":"}"} ``` tail }') == '{"a":"}"}'
    assert X.first_json_object("none") == "none" and X.first_json_object(None) is None


def test_article_text():
    body = "<p>" + "word " * 120 + "</p>"
    assert X.article_text(f"<div class='knc-content'>{body}<div class='ads'><p>buy</p></div></div>").startswith("word word")
    assert X.article_text("<p>short</p>") is None and X.article_text(None) is None


def test_queue(spark):
    now = dt.datetime(2026, 1, 1, 12)
    rows = [("a", "pending", 3, None), ("b", "processing", 0, now - dt.timedelta(minutes=14)), ("c", "processing", 0, now - dt.timedelta(minutes=16)), ("d", "failed", 2, None)]
    q = spark.createDataFrame(rows, "url_hash string, status string, retry_count int, claimed_at timestamp")
    assert {r.url_hash for r in ingest.claimable(q, now).collect()} == {"c", "d"}
    after = {r.url_hash: (r.status, r.retry_count) for r in ingest.with_outcome(q, spark.createDataFrame([("c", True), ("d", False)], ["url_hash", "ok"])).collect()}
    assert after["c"] == ("done", 0) and after["d"] == ("failed", 3) and after["a"] == ("pending", 3)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 7, dt.datetime(2026, 1, 1 + i % 3, 10), "a" if i % 2 else "b", float(i)) for i in range(14)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, e string, v double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    ingest.drain(ingest.stream_files(spark, str(tmp_path / "in"), df.schema, 1), lambda b, _: seen.append(b.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert sum(seen) == 14
