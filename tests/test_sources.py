"""Sources, sinks, cursors, streams and commands on small files."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel import schemas
from tidepanel.functions import text as X
from tidepanel.operators import panel, quality
from tidepanel.plans import commands, figures
from tidepanel.sources import io
from tidepanel.streaming import ingest

S = list(schemas.SECTORS)


def test_returns_over_a_gap_and_days_without_any(spark):
    d = lambda n: dt.date(2026, 1, n)
    rows = [(d(1), "VCB", 10.0), (d(2), "VCB", 11.0), (d(4), "VCB", 12.1)] + [(d(i), "FPT", 5.0 * i) for i in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "trade_date date, ticker string, close double")
    members = spark.createDataFrame([("VCB", "Banking"), ("FPT", "Technology"), ("CMG", "Technology")], "ticker string, sector string")
    got = {(r.trade_date.day, r.sector): r for r in panel.group_returns(panel.simple_returns(df), members).collect()}
    assert got[4, "Banking"].sector_return == pytest.approx(0.1) and (1, "Banking") not in got
    assert got[3, "Banking"].sector_return is None and got[3, "Banking"].missing_count == 1 and got[3, "Technology"].ticker_count == 1


def test_last_row_stays_and_names_are_matched(spark):
    df = spark.createDataFrame([("2026-01-02", "1", 0), ("2026-01-02", "2", 1), ("x", "3", 2), ("2026-01-03", "?", 3)], "`Trading Date` string, `Close_Price` string, place int")
    (r,) = panel.normalize_ohlcv(df, "VCB", "place").collect()
    assert (r.trade_date, r.ticker, r.close, r.volume) == (dt.date(2026, 1, 2), "VCB", 2.0, None)
    assert panel.normalize_ohlcv(df.drop("Close_Price"), "VCB").count() == 0
    both = spark.createDataFrame([("2026-01-02", 1.0, 9.0, 7.0)], "date string, close double, adj_close double, closePrice double")
    assert panel.rename_aliases(both, schemas.OHLCV_ALIASES).columns == ["trade_date", "close", "adj_close"]
    assert panel.normalize_ohlcv(both, "A").first().close == 1.0


def test_bounds_and_ranges(spark):
    assert panel.parse_bound(" ") is None and panel.parse_bound("2026-01-02") == dt.date(2026, 1, 2) and panel.parse_bound(None) is None
    with pytest.raises(ValueError):
        panel.parse_bound("soon")
    a = spark.createDataFrame([(dt.date(2026, 1, 5),)], ["trade_date"])
    b = spark.createDataFrame([(dt.date(2026, 3, 5),)], ["trade_date"])
    with pytest.raises(ValueError):
        panel.overlap(a, b)
    with pytest.raises(ValueError):
        panel.between_dates(a, "trade_date", "2026-02-01", "2026-01-01")
    with pytest.raises(ValueError):
        quality.require_range(spark.createDataFrame([(2.0,)], ["x"]), "x", -1, 1)
    wide = spark.createDataFrame([(dt.date(1, 1, 1),), (dt.date(9999, 1, 1),)], ["trade_date"])
    with pytest.raises(ValueError):
        panel.calendar_map(wide)


def test_dates_far_from_the_calendar(spark):
    """One bad year among the data doesn't lengthen the calendar's map."""
    days = spark.createDataFrame([(dt.date(2026, 1, d),) for d in (5, 6)], ["trade_date"])
    at = spark.createDataFrame([(dt.date(1, 2, 3),), (dt.date(9999, 1, 1),), (dt.date(2026, 1, 5),), (None,)], "d date")
    got = {r.d and r.d.year: (r.is_trading, r.on_or_after and r.on_or_after.day, r.after and r.after.day) for r in panel.as_of(at, days, "d").collect()}
    assert got == {1: (False, 5, 5), 9999: (False, None, None), 2026: (True, 5, 6), None: (False, None, None)}
    assert panel.calendar_map(days)[0].count() == 2


def test_keywords_in_one_scan(spark):
    cases = {"Hàng tiêu dùng thiết yếu": ["ConsumerStaples", "ConsumerDiscretionary"], "vật liệu xây dựng": ["SteelMaterials"], "khi nào": ["Energy"], "đien": ["Utilities"], "kđien": [], "xe điện": ["ConsumerDiscretionary", "Utilities"], "cảng biển, kcn": ["RealEstate", "IndustrialLogistics"], "": [], "bank_x": []}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.sectors_in(X.fold("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == cases
    nested = {"a": ("new york", "york"), "b": ("new",), "c": ("york city",)}
    r = spark.createDataFrame([("in new york city",)], "t string").select(X.keywords_in(F.col("t"), nested).alias("s")).first()
    assert r.s == ["a", "b", "c"]


def test_ticker_columns_in_their_order(spark):
    rows = [tuple("VCB" if i == j else ("FPT" if j > i else None) for j in range(5)) for i in range(5)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in schemas.TICKER_COLUMNS)).withColumn("title", F.lit(""))
    assert [r.sector_label for r in panel.label_articles(df).collect()] == ["Banking"] * 5


def test_article_selectors():
    p = lambda ch, n=600: f"<p>{ch * n}</p>"
    assert X.article_text(f"<div class='detail-content'>{p('a')}</div><div class='knc-content'>{p('b')}</div><div class='knc-content'>{p('c')}</div>") == "b" * 600
    assert X.article_text(f"<span class='nd_detail'>{p('a', 10)}</span><div class='nd_detail'>{p('b')}</div>") == "b" * 600
    assert X.article_text(f"<div class='article-body'>{p('a')}<figure>{p('f')}</figure><div class='related-news'>{p('r')}</div></div>") == "a" * 600
    assert X.article_text(f"<nav>{p('n')}</nav>short") is None


def test_clients_that_fail(spark):
    slept = []

    def flaky(times):
        left = [times]

        def call(x):
            if left[0]:
                left[0] -= 1
                raise OSError(x)
            return x

        return call

    assert io.attempt(flaky(2), "a", sleep=slept.append) == "a" and slept == [1, 2]
    with pytest.raises(OSError):
        io.attempt(flaky(3), "a", sleep=lambda _: None)
    docs = spark.createDataFrame([("a", "x" * 20_000), ("b", None)], "url_hash string, raw_text string")
    got = {r.url_hash: r for r in io.enrich(docs, lambda t: json.dumps({"n": len(t)}), backend="groq").collect()}
    assert json.loads(got["a"].summary_json) == {"n": 15_000} and got["b"].summary_error is None
    bad = io.enrich(docs, lambda t: 1 / 0).collect()
    assert all(r.summary_json is None and r.summary_error.startswith("ZeroDivisionError") for r in bad)


def test_price_client_rests(spark, tmp_path):
    rests = str(tmp_path / "rests")

    def client(t, a, b):
        return pd.DataFrame({"date": ["2026-01-01", "2026-01-02", "2026-01-02", "2027-01-01"], "close": [1, 2, 3, 4]})

    def sleep(s):
        with open(rests, "a") as f:
            f.write(f"{s}\n")

    got = io.fetch_prices(spark, [f"T{i}" for i in range(20)] * 2, [client], dt.date(2026, 1, 1), dt.date(2026, 1, 31), sleep=sleep).cache()
    assert got.count() == 40 and {r.close for r in got.where("trade_date = '2026-01-02'").collect()} == {3.0}
    assert open(rests).read().split().count("65.0") == 1
    with pytest.raises(ValueError):
        io.fetch_prices(spark, ["A"], [client], dt.date(2026, 2, 1), dt.date(2026, 1, 1))


def test_cursors(spark, tmp_path):
    path = f"file://{tmp_path}/cursor"
    assert ingest.load_cursor(spark, path) == {}
    ingest.save_cursor(spark, path, {"a": 3, "b": 700})
    cursor = ingest.load_cursor(spark, path)
    assert cursor == {"a": 3, "b": 700} and ingest.pages_to_read(cursor, ["a", "b", "c"], 700, 2) == [("a", 4), ("a", 5), ("c", 1), ("c", 2)]
    spark.createDataFrame([("not json",)], "value string").write.mode("overwrite").text(path)
    assert ingest.load_cursor(spark, path) == {}
    ingest.reset_cursor(spark, path)
    assert ingest.load_cursor(spark, path) == {}
    assert ingest.next_start(dt.datetime(2026, 1, 1, 12)) == dt.datetime(2026, 1, 1, 18) and ingest.next_start(dt.datetime(2026, 1, 1, 23)) == dt.datetime(2026, 1, 2, 7)


def test_undecodable_bytes(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿a,b\n1,xin chào\n".encode() + b"2,\xff\xfe\n")
    rows = io.read_csv(spark, str(tmp_path / "x.csv")).collect()
    assert rows[0].a == "1" and rows[0].b == "xin chào" and len(rows) == 2


def test_commands_end_to_end(spark, tmp_path):
    """Prices and articles in files through every command, as a user would run them."""
    import numpy as np

    rng = np.random.default_rng(6)
    days = [d for d in pd.date_range("2025-01-01", periods=320) if d.weekday() < 5][:220]
    out = lambda name: str(tmp_path / name)
    quotes = [(d.strftime("%Y-%m-%d"), t, float(50.0 + 10 * i + 3 * np.sin(k / 7 + i) + rng.normal())) for i, (s, ts) in enumerate(schemas.SECTOR_TICKERS.items()) for t in ts for k, d in enumerate(days)]
    spark.createDataFrame(quotes, "time string, ticker string, close double").write.parquet(out("quotes.parquet"))
    commands.main(["prices", "--input", out("quotes.parquet"), "--output-dir", out("m5")])
    articles = [(str(n), f"{d:%Y-%m-%d} {8 + n % 9:02d}:15:00", f'["{list(schemas.SECTOR_TICKERS[s])[0]}"]', ("Positive", "Negative", "Neutral")[n % 3], "title, with \"quotes\"\nand a line") for n, (d, s) in enumerate((d, s) for d in days for s in S)]
    frame = spark.createDataFrame(articles, "article_id string, published_at string, tickers string, summary_impact string, title string")
    io.write_csv(frame, out("articles"))
    commands.main(["sessions", "--articles-input", out("articles"), "--trading-calendar", out("m5/daily_sector_price_wide"), "--output-dir", out("m6")])
    commands.main(["labels", "--input", out("m6/articles_session_mapped"), "--output-dir", out("m7")])
    commands.main(["daily", "--input", out("m7/article_sector_long"), "--output-dir", out("m8")])
    commands.main(["merge", "--price-input", out("m5/daily_sector_price_wide"), "--sentiment-wide-input", out("m8/daily_sector_sentiment_wide"), "--sentiment-long-input", out("m8/daily_sector_sentiment_long"), "--output-dir", out("m9")])
    report = io.read_csv(spark, out("m9/merge_coverage_report"))
    assert report.count() == 10 and "overlap_start" in report.columns
    for mode in ("sent2sent", "sent2ret"):
        commands.main(["granger", "--input", out("m9/merged_wide"), "--mode", mode, "--max-lag", "2", "--output-dir", out("m10")])
    results = io.read_csv(spark, out("m10/granger_results_sent2ret"))
    assert results.count() == 90 and io.read_csv(spark, out("m10/stationarity_tests")).count() == 20
    assert io.read_csv(spark, out("m10/granger_pvalue_matrix")).columns == ["source", *S]
    commands.main(["network", "--results-input", out("m10/granger_results"), "--pvalue-matrix", out("m10/granger_pvalue_matrix"), "--output-dir", out("m11")])
    assert io.read_csv(spark, out("m11/network_summary")).count() == 2 and io.read_csv(spark, out("m11/network_node_metrics_raw")).count() == 10
    assert spark.read.text(out("m11/heatmap_raw.svg")).first().value.startswith("<svg")
    commands.main(["price-network", "--input", out("m5/daily_sector_price_wide"), "--output-dir", out("m12")])
    assert io.read_csv(spark, out("m12/price_network_edges")).count() == 11
    commands.main(["compare", "--news-input", out("m10/granger_results"), "--price-adjacency-input", out("m12/price_network_adjacency"), "--output-dir", out("m13")])
    found = {r.metric: r.value for r in io.read_csv(spark, out("m13/network_comparison")).collect()}
    assert found["nodes"] == "10.0" and "qap_pvalue" in found and found["second_edges"] == "22.0"
    commands.main(["lead-lag", "--input", out("m9/merged_wide"), "--no-fill-missing", "--output-dir", out("m14")])
    assert io.read_csv(spark, out("m14/lead_lag_all")).count() == 600 and io.read_csv(spark, out("m14/lead_lag_best")).count() == 100
    with pytest.raises(SystemExit):
        commands.main(["granger", "--output-dir", out("x")])


def test_figures_of_small_networks(spark):
    nodes = spark.createDataFrame([("a", 0), ("b", 1), ("c & d", 2)], "node string, ord int")
    edges = spark.createDataFrame([("a", "b", 2.0, 1), ("b", "b", 1.0, 2), ("c & d", "a", None, 3)], "source string, target string, edge_weight double, best_lag int")
    scores = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "node string, weighted_total_degree double")
    drawn = figures.network(edges, nodes, scores, self_loops=True)
    assert drawn.count("<line") == 2 and "lag 1" in drawn and "c &amp; d" in drawn
    assert "no edges" in figures.network(edges.where("false"), nodes, scores)
    matrix = spark.createDataFrame([("a", None, 0.5), ("b", 0.25, None)], "source string, a double, b double")
    assert figures.heatmap(matrix, ["a", "b"]).count("<rect") == 2
