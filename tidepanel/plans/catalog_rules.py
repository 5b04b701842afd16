"""Queries of rules, reshaping, networks and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators import graph, panel, quality, stats
from . import catalog as c
from . import statistics_sql
from .registry import Registry

query = Registry()
_G = c._G
_GS = ", ".join(f"'{g}'" for g in _G)
_ALL = [f"G{i}" for i in range(1, 10)]


# --- conforming ---------------------------------------------------------------------------------------------------------


def _raw_prices(s, d):
    """Prices under odd names, as text, with rows that repeat and rows that can't be read."""
    li = c._t(s, d, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        F.when(k % 11 != 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("?").alias("Trading Date"),
        F.concat(F.lit("T"), F.col("l_suppkey") % 7).alias("ticker"),
        F.when(k % 13 != 0, (F.col("l_extendedprice")).cast("string")).otherwise("n/a").alias("Close_Price"),
        F.col("l_quantity").cast("string").alias("VOL"),
        F.lit("9").alias("Adj Close"),
        (k * 10 + F.col("l_linenumber")).alias("place"),
    )


_RAW = "SELECT l_shipdate::DATE trade_date, 'T' || l_suppkey % 7 ticker, l_extendedprice AS close, l_quantity volume, l_orderkey * 10 + l_linenumber place FROM lineitem WHERE l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0"


@query(f"SELECT trade_date, ticker, NULL::DOUBLE open, NULL::DOUBLE high, NULL::DOUBLE low, close, volume::DOUBLE volume FROM ({_RAW}) QUALIFY row_number() OVER (PARTITION BY trade_date, ticker ORDER BY place DESC) = 1")
def ohlcv_normalized(s, d):
    return panel.normalize_ohlcv(_raw_prices(s, d), last="place")


@query(f"SELECT trade_date, ticker, close FROM ({_RAW}) WHERE ticker IN ('T1', 'T2') AND trade_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' QUALIFY row_number() OVER (PARTITION BY trade_date, ticker ORDER BY place DESC) = 1")
def conformed(s, d):
    raw = _raw_prices(s, d).withColumnsRenamed({"Trading Date": "trade_date", "Close_Price": "close"}).where("close <> 'n/a'")
    rows = panel.conform(raw, ("trade_date",), ("close",), ("ticker",), ("trade_date", "ticker"), "place", {"ticker": ["T1", "T2"]})
    return panel.between_dates(rows, "trade_date", "1995-01-01", "31/12/1996")


@query("SELECT count(*)::BIGINT n FROM events WHERE value IS NOT NULL AND props IS NOT NULL")
def null_rows_dropped(s, d):
    return panel.drop_nulls(c._t(s, d, "events").select("event_id", "value", "props"), "value", "props").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (event_type NOT IN ('click', 'view') OR event_type IS NULL)::BIGINT dropped_rows FROM events")
def standard_dropped(s, d):
    return panel.standard_only(c._t(s, d, "events"), "event_type", ["click", "view"])[1]


_WIDE_SENT = f"SELECT trade_date, {', '.join(f"max(sentiment_weighted_mean) FILTER (sector = '{g}') sent_{g}" for g in _G)} FROM ({c._SENT_G}) GROUP BY 1"


def _wide_sentiment(s, d):
    return panel.widen(c._sentiment_by_group(s, d), "trade_date", "sector", "sentiment_weighted_mean", _G, "sent_")


@query(f"SELECT trade_date, {', '.join(f'round(coalesce(sent_{g}, 0), 6) sent_{g}' for g in _G)} FROM ({_WIDE_SENT})")
def missing_sentiment_filled(s, d):
    cols = [f"sent_{g}" for g in _G]
    return c._rounded(panel.fill_missing(_wide_sentiment(s, d), cols)[0], *cols)


@query(f"SELECT ({' + '.join(f'count(*) FILTER (sent_{g} IS NULL)' for g in _G)})::BIGINT filled_cells FROM ({_WIDE_SENT})")
def missing_sentiment_cells(s, d):
    return panel.fill_missing(_wide_sentiment(s, d), [f"sent_{g}" for g in _G])[1]


# --- text rules ---------------------------------------------------------------------------------------------------------


_TICKER_CASES = "(['VCB', '', 'FPT, HPG', '[\"GAS\"]', 'none'])"


def _tickered(s, d):
    """Articles whose tickers stand in one of five columns, or in none."""
    e = c._t(s, d, "events").select("event_id")
    k = F.col("event_id")
    text = F.element_at(F.array(*map(F.lit, ("VCB", "", "FPT, HPG", '["GAS"]', "none"))), (k % 5 + 1).cast("int"))
    return e.select("event_id", *[F.when(k % 6 == i, text).alias(n) for i, n in enumerate(schemas.TICKER_COLUMNS)], F.lit("").alias("title"))


@query(f"""SELECT event_id, CASE WHEN event_id % 6 = 5 THEN '' ELSE ({_TICKER_CASES.replace('none', '')})[event_id % 5 + 1] END AS raw, CASE WHEN event_id % 6 = 5 THEN 'Unmapped' ELSE (['Banking', 'Unmapped', 'Technology', 'Energy', 'Unmapped'])[event_id % 5 + 1] END sector_label FROM events""")
def ticker_columns(s, d):
    """Which column names the tickers, and the sector that follows."""
    out = panel.label_articles(_tickered(s, d))
    raw = F.coalesce("ticker_raw", F.lit(""))
    return out.select("event_id", F.when(raw == "none", "").otherwise(raw).alias("raw"), F.col("sector_label"))


_TIMES = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts::TIMESTAMP WHEN 1 THEN ts + INTERVAL 7 HOUR WHEN 2 THEN ts + INTERVAL 2 HOUR WHEN 3 THEN date_trunc('day', ts)::TIMESTAMP END published_at_vn FROM (SELECT event_id, date_trunc('second', ts) ts FROM events)"""


@query(_TIMES)
def market_times(s, d):
    """Times without an offset are the market's, others are converted; dates, and what can't be read."""
    k, t = F.col("event_id") % 5, F.col("ts")
    text = F.when(k == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00"))).when(k == 3, F.date_format(t, "yyyy-MM-dd")).otherwise("soon")
    return c._t(s, d, "events").select("event_id", X.market_time(text).alias("published_at_vn"))


_WORDS = ("Tích cực", "NEUTRAL", " trung  tính", "tiêu cực", "other", "Positive", "trung lập", "negative")


@query(f"SELECT event_id, (['Positive', 'Neutral', 'Neutral', 'Negative', NULL, 'Positive', 'Neutral', 'Negative'])[event_id % {len(_WORDS)} + 1] AS label, ([1.0, 0.0, 0.0, -1.0, NULL, 1.0, 0.0, -1.0])[event_id % {len(_WORDS)} + 1]::DOUBLE AS score FROM events")
def sentiment_labels(s, d):
    label = X.sentiment_label(F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % len(_WORDS) + 1).cast("int")))
    return c._t(s, d, "events").select("event_id", label.alias("label"), X.label_score(label).alias("score"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 WHEN 2 THEN 0.4 WHEN 5 THEN 1.0 END::DOUBLE AS score FROM events")
def clipped_scores(s, d):
    text = F.element_at(F.array(*map(F.lit, ("2", "-3", "0.4", "nan", "abc", "Infinity"))), (F.col("event_id") % 6 + 1).cast("int"))
    return c._t(s, d, "events").select("event_id", X.clip_score(text).alias("score"))


_NOISE_SQL = ["xem thêm[^\\n]{0,50}", "đọc thêm[^\\n]{0,50}", "cùng chuyên mục[^\\n]{0,50}", "theo dõi[^\\n]{0,30}cafef", "nguồn:[^\\n]{0,80}", "tags?:[^\\n]{0,200}", "\\[[^\\n]*?\\]", "<[^>]+>"]


def _cleaned(text: str) -> str:
    for p in _NOISE_SQL:
        text = f"regexp_replace({text}, '{p}', ' ', 'gi')"
    return f"regexp_replace(regexp_replace({text}, '[\\s\\x0b\\x1c-\\x1f\\x85\\x{{a0}}]{{2,}}', chr(10), 'g'), '^[\\s\\x0b\\x1c-\\x1f]+|[\\s\\x0b\\x1c-\\x1f]+$', '', 'g')"


@query(f"SELECT doc_id, {_cleaned('t')} AS text FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Tags: a, b' || chr(10) || text || ' Nguồn: x' WHEN 1 THEN '[Video] ' || text || ' <b> XEM THÊM: y' ELSE text END t FROM documents)")
def noise_removed(s, d):
    t, k = F.col("text"), F.col("doc_id") % 3
    noisy = F.when(k == 0, F.concat(F.lit("Tags: a, b\n"), t, F.lit(" Nguồn: x"))).when(k == 1, F.concat(F.lit("[Video] "), t, F.lit(" <b> XEM THÊM: y"))).otherwise(t)
    return c._t(s, d, "documents").select("doc_id", X.clean_text(noisy).alias("text"))


@query("""SELECT event_id, (['Không có thông tin tóm tắt.', 'a|b', 'x|y|z|u|v'])[event_id % 3 + 1] points, CASE WHEN event_id % 2 = 0 THEN 'VCB|FPT' ELSE '' END tickers, CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN -0.5 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM events""")
def summary_rules(s, d):
    """Summaries as JSON or as Python literals, with their rules applied."""
    k = F.col("event_id")
    points = F.element_at(F.array(*map(F.lit, ('[]', '[" a ", "", "b"]', '["x","y","z","u","v","w"]'))), (k % 3 + 1).cast("int"))
    tickers = F.when(k % 2 == 0, F.lit('["vcb ", "", "fpt"]')).otherwise("[]")
    impact = F.element_at(F.array(*map(F.lit, ("Positive", "Negative", "Neutral", "Negative"))), (k % 4 + 1).cast("int"))
    score = F.when(k % 4 == 3, F.lit(', "sentiment_score": 7')).otherwise("")
    text = F.concat(F.lit('{"summary": '), points, F.lit(', "tickers": '), tickers, F.lit(', "impact": "'), impact, F.lit('"'), score, F.lit("}"))
    text = F.when(k % 5 == 0, F.translate(text, '"', "'")).otherwise(text)
    r = X.valid_summary(X.summary_object(text))
    return c._t(s, d, "events").select("event_id", F.array_join(r["summary"], "|").alias("points"), F.array_join(r["tickers"], "|").alias("tickers"), r["sentiment_score"].alias("score"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://h.example/p/' || page_id ELSE 'https://h.example/q' || page_id END AS url FROM pages")
def absolute_urls(s, d):
    p = F.col("page_id")
    u = F.when(p % 3 == 0, F.col("url")).when(p % 3 == 1, F.concat(F.lit("/p/"), p)).otherwise(F.concat(F.lit("q"), p))
    return c._t(s, d, "pages").select("page_id", X.absolute_url(u, "https://h.example/").alias("url"))


#: Pages of known contents: selectors in their order, an advert, a figure, a page too short.
@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN repeat('a ' || page_id || ' ', 200) || 'z' WHEN 1 THEN repeat('b', 600) WHEN 2 THEN 'x' || repeat('c', 600) END AS text FROM pages")
def article_selection(s, d):
    p = F.col("page_id")
    knc = F.concat(F.lit("<div class='detail-content'><p>other</p></div><div class='big knc-content'><p>"), F.repeat(F.concat(F.lit("a "), p, F.lit(" ")), 200), F.lit("<i>z</i></p><div class='ads'><p>buy</p></div><figure><p>f</p></figure></div>"))
    detail = F.concat(F.lit("<nav><p>menu</p></nav><span class='nd_detail'><p>no</p></span><div class='nd_detail'><p>"), F.repeat(F.lit("b"), 600), F.lit("</p>outside</div>"))
    loose = F.concat(F.lit("<script>var x</script><div>x"), F.repeat(F.lit("c"), 600), F.lit("</div><footer>end</footer>"))
    html = F.when(p % 4 == 0, knc).when(p % 4 == 1, detail).when(p % 4 == 2, loose).otherwise("<div class='knc-content'><p>short</p></div>")
    return c._t(s, d, "pages").select("page_id", X.extract_article(html).alias("text"))


# --- matrices and networks ------------------------------------------------------------------------------------------------

_N = ["CHINA", "FRANCE", "JAPAN", "BRAZIL", "KENYA"]
_NS = ", ".join(f"'{n}'" for n in _N)
_ROWS = f"(SELECT unnest([{_NS}]) AS source)"


@query(f"SELECT r.source, {', '.join(f"round(max(p_value) FILTER (t.target = '{n}'), 6) \"{n}\"" for n in _N)} FROM {_ROWS} r LEFT JOIN ({c._TRADE}) t USING (source) GROUP BY 1")
def pvalue_matrix(s, d):
    return c._rounded(graph.matrix(c._trade(s, d), "p_value", _N), *_N)


@query(f"SELECT r.source, {', '.join(f"coalesce(max(CASE WHEN flag AND t.source <> t.target THEN 1 ELSE 0 END) FILTER (t.target = '{n}'), 0)::INT \"{n}\"" for n in _N)} FROM {_ROWS} r LEFT JOIN ({c._TRADE}) t USING (source) GROUP BY 1")
def adjacency_matrix(s, d):
    return graph.adjacency(c._trade(s, d), "flag", _N)


@query(f"SELECT source, target FROM ({c._TRADE}) WHERE flag AND source <> target AND source IN ({_NS}) AND target IN ({_NS})")
def matrix_edges(s, d):
    """An adjacency matrix read back as text, in another order, to edges."""
    wide = graph.adjacency(c._trade(s, d), "flag", _N).select("source", *[F.col(n).cast("string") for n in reversed(_N)])
    return graph.matrix_edges(graph.normalized_matrix(wide, _N), _N)


@query(f"SELECT a, b, round(corr, 6) corr FROM ({c._MATRIX}) WHERE a < b ORDER BY abs(corr) DESC, a, b LIMIT 4")
def top_pairs(s, d):
    return c._rounded(stats.top_pairs(c._matrix(s, d), 4), "corr")


@query(f"SELECT s, r, lag, round(corr, 6) corr, n_obs, round(p, 6) pvalue, true AS significant FROM (SELECT *, {statistics_sql.t_tail('corr', 'n_obs')} p FROM ({c._LEADS}) WHERE lag >= 1 AND corr IS NOT NULL) WHERE p < 0.05 ORDER BY abs(corr) DESC, s, r, lag LIMIT 10")
def lead_relations(s, d):
    seg = c._segments(s, d)
    return c._rounded(stats.lead_relations(stats.significant(stats.lead_lag(seg, seg, "segment", "trade_date", "v"))), "corr", "pvalue")


@query(f"SELECT source, target, round(edge_weight, 6) edge_weight FROM ({c._EDGES}) WHERE source <> target AND edge_weight >= 0.5")
def plot_edges(s, d):
    return c._rounded(graph.plot_edges(c._edges(s, d), least_weight=0.5).select("source", "target", "edge_weight"), "edge_weight")


@query(f"SELECT node, weighted_out_degree FROM ({c._DEGREES}) WHERE weighted_out_degree > 0 ORDER BY weighted_out_degree DESC, node LIMIT 5")
def top_nodes(s, d):
    return c._rounded(graph.top_nodes(graph.node_degrees(c._edges(s, d), c._nodes(s, d)), "weighted_out_degree", 5).select("node", "weighted_out_degree"), "weighted_out_degree")


@query(f"SELECT node, weighted_out_degree > weighted_in_degree is_net_sender, weighted_in_degree > weighted_out_degree is_net_receiver, round(weighted_in_degree + weighted_out_degree, 3) weighted_total_degree FROM ({c._DEGREES})")
def net_senders(s, d):
    found = graph.node_degrees(c._edges(s, d), c._nodes(s, d))
    return c._rounded(found.select("node", "is_net_sender", "is_net_receiver", "weighted_total_degree"), "weighted_total_degree", n=3)


@query("SELECT n_name node, round(cos(2 * pi() * n_nationkey / (SELECT count(*) FROM nation)), 6) + 0.0 x, round(sin(2 * pi() * n_nationkey / (SELECT count(*) FROM nation)), 6) + 0.0 y FROM nation")
def circle_layout(s, d):
    out = graph.circle(c._nodes(s, d))
    return out.select("node", *[(F.round(v, 6) + F.lit(0.0)).alias(v) for v in ("x", "y")])


@query(f"WITH g AS ({c.granger_sql(c._PAIRS)}) SELECT source, target, best_lag, n_obs FROM g WHERE significant_fdr_05")
def fdr_edges(s, d):
    return graph.fdr_edges(c._tested(s, d)).select("source", "target", "best_lag", "n_obs")


_CAUSE = f"SELECT a.sector AS source, b.sector AS target, trade_date t, coalesce(a.sentiment_weighted_mean, 0) x, b.sector_return y FROM ({c._MERGED}) a JOIN ({c._MERGED}) b USING (trade_date) WHERE a.sector <> b.sector AND a.sector IN ({_GS}) AND b.sector IN ({_GS})"


@query(c.granger_sql(_CAUSE, ", 'sent2ret' AS mode"))
def causality_sent2ret(s, d):
    """Sentiment to returns over the merged panel, missing sentiment filled with 0."""
    a = panel.widen(c._group_returns(s, d), "trade_date", "sector", "sector_return", _G, "ret_")
    out = stats.causality(a.join(_wide_sentiment(s, d), "trade_date", "left"), "sent2ret")
    out = c._rounded(out, "f_stat", "p_value", "p_value_fdr_bh", "p_value_bonferroni", "ljungbox_pvalue", n=5)
    return out.select("source", "target", "best_lag", "n_obs", "f_stat", "p_value", "p_value_fdr_bh", "p_value_bonferroni", "ljungbox_pvalue", *c._FLAGS, "lag_selection_method", "status", "mode")


@query("WITH a AS (SELECT DISTINCT event_type x FROM events), b AS (SELECT unnest(['click', 'view', 'none']) x) SELECT 'both' AS side, x FROM a WHERE x IN (SELECT x FROM b) UNION ALL SELECT 'first', x FROM a WHERE x NOT IN (SELECT x FROM b) UNION ALL SELECT 'second', x FROM b WHERE x NOT IN (SELECT x FROM a)")
def set_differences(s, d):
    """What two sets have in common and apart, as the checks use it."""
    a = c._t(s, d, "events").select(F.col("event_type").alias("x")).distinct()
    b = s.createDataFrame([("click",), ("view",), ("none",)], "x string")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("first"))).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


# --- checks -----------------------------------------------------------------------------------------------------------------


@query(f"""WITH g AS ({c._GROUPS}) SELECT 'columns trade_date, sector, sector_return, ticker_count, missing_count' AS "check", 0::BIGINT failures UNION ALL SELECT 'unique trade_date, sector', 0 UNION ALL SELECT 'at most 9 groups a day', 0 UNION ALL SELECT 'return is a number', 0 UNION ALL SELECT 'counts', 0 UNION ALL SELECT 'known group', 0
 UNION ALL SELECT 'warning: fewer than 200 days', (count(DISTINCT trade_date) < 200)::BIGINT FROM g UNION ALL SELECT 'warning: more than 20% missing', count(*) FROM (SELECT sector FROM g GROUP BY 1 HAVING avg((sector_return IS NULL)::INT) > 0.2)""")
def price_checks(s, d):
    return quality.price_checks(c._group_returns(s, d), _ALL)


@query(f"""SELECT 'columns session_bucket, trade_date, mapped_reason, is_mapped' AS "check", 0::BIGINT failures UNION ALL SELECT 'mapped rows have a date', 0 UNION ALL SELECT 'bucket', 0 UNION ALL SELECT 'warning: unmapped', count(*) FROM ({c._SESSION}) WHERE NOT is_mapped""")
def session_checks(s, d):
    return quality.session_checks(c.session_bucket(s, d))


@query("""SELECT 'score range' AS "check", count(*)::BIGINT failures FROM events WHERE value > 100 OR value < -100 UNION ALL SELECT 'no sentinel', count(*) FROM events WHERE event_id % 10 = 0""")
def label_checks(s, d):
    e = c._t(s, d, "events").select((F.col("value") / 100).alias("sentiment_score"), F.when(F.col("event_id") % 10 == 0, schemas.UNMAPPED).otherwise("Banking").alias("sector_label"))
    return quality.label_checks(e)


@query(f"""WITH m AS ({c._MERGED}) SELECT 'columns trade_date, sector' AS "check", 0::BIGINT failures UNION ALL SELECT 'within the overlap', count(*) FROM m WHERE trade_date NOT BETWEEN DATE '1994-01-01' AND DATE '1997-12-31' UNION ALL SELECT 'known entity', 0 UNION ALL SELECT 'no sentinel', 0 UNION ALL SELECT '9 rows of the report', 0""")
def merge_checks(s, d):
    m = c._merged(s, d)
    return quality.merge_checks(m, panel.parse_bound("1994-01-01"), panel.parse_bound("1997-12-31"), "sector", _ALL, panel.coverage(m, "sector"))


@query(f"""WITH t AS ({c._TRADE}), n AS (SELECT count(*) n FROM t) SELECT 'unique source, target' AS "check", 0::BIGINT failures UNION ALL SELECT '625 pairs', abs(n - 625) FROM n UNION ALL SELECT 'p range', 0 UNION ALL SELECT 'known source', count(*) FROM t WHERE source NOT IN ({_NS}) UNION ALL SELECT 'known target', count(*) FROM t WHERE target NOT IN ({_NS})
 UNION ALL SELECT 'columns source, ' || array_to_string([{_NS}], ', '), 0 UNION ALL SELECT 'unique source', 0 UNION ALL SELECT '5 rows of the adjacency', 0 UNION ALL SELECT 'cells of 0 and 1', 0""")
def granger_checks(s, d):
    t = c._trade(s, d)
    return quality.granger_checks(t, 625, _N, graph.adjacency(t, "flag", _N))


@query(f"""SELECT 'edges equal flags' AS "check", 0::BIGINT failures UNION ALL SELECT '25 rows of nodes', 0""")
def network_checks(s, d):
    return quality.network_checks(c._edges(s, d), c._trade(s, d).where(graph.flag_of("flag")), graph.node_degrees(c._edges(s, d), c._nodes(s, d)), 25)


@query("""SELECT unnest(['symmetric', 'range', 'diagonal', 'edges are half the cells']) AS "check", 0::BIGINT failures""")
def correlation_checks(s, d):
    m = c._matrix(s, d)
    limit = stats.corr_threshold(m)
    return quality.correlation_checks(m, graph.threshold_edges(m, limit), limit)


@query("""SELECT unnest(['150 lags', '25 pairs', 'unique s, r', 'corr range']) AS "check", 0::BIGINT failures""")
def lead_lag_checks(s, d):
    seg = c._segments(s, d)
    tested = stats.lead_lag(seg, seg, "segment", "trade_date", "v")
    return quality.lead_lag_checks(tested, stats.best_lag(tested), 5)


@query("""SELECT unnest(['columns source, CHINA, FRANCE, JAPAN, BRAZIL, KENYA', 'unique source', '5 rows of the matrix', 'cells of 0 and 1', 'zero diagonal']) AS "check", 0::BIGINT failures""")
def matrix_checks(s, d):
    return quality.matrix_checks(graph.adjacency(c._trade(s, d), "flag", _N), _N, binary=True, diagonal=True)
