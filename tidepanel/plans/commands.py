"""Commands over tables in files: each takes paths and parameters and gives its outputs by name, checked. The command line is made
from their signatures: python -m tidepanel COMMAND --parameter value ... --output-dir DIR."""

from __future__ import annotations

import argparse
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators import graph, panel, quality, stats
from ..session import session
from ..sources import io
from . import figures

SECTORS = list(schemas.SECTORS)


def table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet if the path says so, else CSV, all columns text."""
    return spark.read.parquet(path) if ".parquet" in path else io.read_csv(spark, path)


def _nodes(spark: SparkSession, entities=SECTORS) -> DataFrame:
    return spark.createDataFrame([(e, i) for i, e in enumerate(entities)], "node string, ord int")


def prices(spark: SparkSession, input: str, start_date: str = "", end_date: str = "") -> dict:  # noqa: A002
    """Daily prices to returns of groups: long, and wide, which serves as the trading calendar."""
    rows = panel.between_dates(panel.normalize_ohlcv(table(spark, input)), "trade_date", start_date, end_date)
    members = spark.createDataFrame([(t, s) for s, ts in schemas.SECTOR_TICKERS.items() for t in ts], "ticker string, sector string")
    long = panel.group_returns(panel.simple_returns(rows), members)
    quality.enforce(quality.price_checks(long))
    return {"ohlcv": rows, "daily_sector_price_long": long, "daily_sector_price_wide": panel.widen(long, "trade_date", "sector", "sector_return", SECTORS)}


def articles(spark: SparkSession, input: str, source: str = "cafef", limit: int = 0) -> dict:  # noqa: A002
    """Stored articles that have a date, flat, and how many haven't."""
    docs = io.read_documents(spark, input, source, limit or None)
    return {"articles": io.export_articles(docs), "undated": io.undated(spark.read.schema(io.ARTICLE).json(input))}


def sessions(spark: SparkSession, articles_input: str, trading_calendar: str, timezone: str = schemas.MARKET_ZONE) -> dict:
    """Articles with their trading session and date."""
    rows = table(spark, articles_input).withColumn("published_at_vn", X.market_time("published_at", timezone))
    mapped = panel.map_sessions(rows, io.read_calendar(spark, trading_calendar))
    quality.enforce(quality.session_checks(mapped))
    return {"articles_session_mapped": mapped, "summary": quality.session_summary(mapped)}


def labels(spark: SparkSession, input: str) -> dict:  # noqa: A002
    """Articles with sentiment and sectors, and a row for each article and sector."""
    labelled = panel.label_articles(table(spark, input))
    long = panel.explode_sectors(labelled)
    quality.enforce(quality.label_checks(long))
    return {"articles_labeled": _flat(labelled), "article_sector_long": _flat(long)}


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")})


def daily(spark: SparkSession, input: str) -> dict:  # noqa: A002
    """Daily sentiment of each sector, long and wide."""
    rows = table(spark, input)
    texts = tuple(c for c in ("sector_label", "article_id") if c in rows.columns)
    numbers = tuple(c for c in ("sentiment_score", "sector_weight") if c in rows.columns)
    rows, _ = panel.standard_only(panel.conform(rows, ("trade_date",), numbers, texts), "sector_label", SECTORS)
    long = panel.daily_sentiment(quality.require_range(rows, "sentiment_score", -1, 1))
    quality.enforce(quality.daily_checks(long))
    return {"daily_sector_sentiment_long": long, "daily_sector_sentiment_wide": panel.widen(long, "trade_date", "sector_label", "sentiment_weighted_mean", SECTORS)}


def merge(spark: SparkSession, price_input: str, sentiment_wide_input: str, sentiment_long_input: str, start_date: str = "", end_date: str = "") -> dict:
    """Returns and sentiment over the days that both have, wide and long, with a report of what is missing."""
    price = panel.conform(table(spark, price_input), ("trade_date",), tuple(SECTORS), keys=("trade_date",))
    wide = panel.conform(table(spark, sentiment_wide_input), ("trade_date",), tuple(SECTORS), keys=("trade_date",))
    long = panel.conform(table(spark, sentiment_long_input), ("trade_date",), schemas.SENTIMENT_METRICS, ("sector_label",), ("trade_date", "sector_label"), only={"sector_label": SECTORS})
    lo, hi = panel.overlap(price, wide, "trade_date", panel.parse_bound(start_date, "start"), panel.parse_bound(end_date, "end"))
    price = panel.between_dates(price, "trade_date", lo, hi)
    named = lambda df, p: df.select("trade_date", *[F.col(s).alias(p + s) for s in SECTORS])
    merged_wide = named(price, "ret_").join(named(wide, "sent_"), "trade_date", "left")
    merged_long = panel.merge_long(panel.lengthen(price, "trade_date", SECTORS), long, ["trade_date", "sector_label"])
    report = panel.coverage(merged_long).withColumns({"overlap_start": F.lit(lo), "overlap_end": F.lit(hi)})
    quality.enforce(quality.merge_checks(merged_long, lo, hi, report=report))
    return {"merged_wide": merged_wide, "merged_long": merged_long, "merge_coverage_report": report}


def granger(spark: SparkSession, input: str, max_lag: int = schemas.MAX_LAG, min_observations: int = schemas.MIN_OBSERVATIONS, alpha: float = schemas.ALPHA, mode: str = "sent2sent", include_self: bool = False, fill_missing: bool = True, start_date: str = "", end_date: str = "") -> dict:  # noqa: A002
    """Causality of all pairs in a mode, whose name ends the outputs' unless it's the usual one; stationarity of all series."""
    columns = tuple(p + s for p in ("ret_", "sent_") for s in SECTORS)
    wide = panel.conform(table(spark, input), ("trade_date",), columns)
    wide = panel.between_dates(wide, "trade_date", start_date, end_date)
    if wide.isEmpty():
        raise ValueError("no row is left between the dates")
    results = stats.causality(wide, mode, include_self, fill_missing, max_lag=max_lag, least=min_observations, alpha=alpha)
    filled = panel.fill_missing(wide, [c for c in columns if c.startswith("sent_")])[0] if fill_missing else wide
    series = stats.series_of(filled, "ret_").union(stats.series_of(filled, "sent_"))
    adjacent = graph.adjacency(results, "significant_fdr_05", SECTORS)
    quality.enforce(quality.granger_checks(results, len(SECTORS) * (len(SECTORS) - (not include_self)), SECTORS, adjacent))
    tail = "" if mode == "sent2sent" else f"_{mode}"
    lags = results.select("source", "target", "mode", F.explode("all_lags").alias("l")).select("source", "target", "mode", "l.*")
    return {"stationarity_tests": stats.stationarity(series, "variable", "t", "value", min_observations)} | {
        f"{name}{tail}": df
        for name, df in {
            "granger_all_lags": lags,
            "granger_results": results.drop("all_lags"),
            "granger_pvalue_matrix": graph.matrix(results, "p_value", SECTORS),
            "granger_fdr_matrix": graph.matrix(results, "p_value_fdr_bh", SECTORS),
            "granger_adjacency_matrix": adjacent,
            "granger_edge_list": graph.fdr_edges(results),
        }.items()
    }


def network(spark: SparkSession, results_input: str, pvalue_matrix: str = "", fdr_matrix: str = "", include_self_loops_in_plot: bool = False, top_n_labels: int = 10, min_edge_weight: float = 0.0) -> dict:
    """Directed networks of raw and of corrected significance: edges, node metrics, a summary, figures."""
    raw = table(spark, results_input)
    rename = {a: b for a, b in (("source_sector", "source"), ("target_sector", "target")) if a in raw.columns}
    results = raw.withColumnsRenamed(rename).withColumns({c: F.col(c).try_cast("double") for c in ("p_value", "p_value_fdr_bh", "f_stat") if c in raw.columns})
    nodes, out, summaries = _nodes(spark), {}, []
    for kind, flag, p, given in (("raw", "significant_raw_05", "p_value", pvalue_matrix), ("fdr", "significant_fdr_05", "p_value_fdr_bh", fdr_matrix)):
        edges = graph.edge_table(results, flag, p, kind)
        metrics = graph.node_metrics(edges, nodes)
        quality.enforce(quality.network_checks(edges, results.where(graph.flag_of(flag)), metrics, len(SECTORS)))
        shown = graph.normalized_matrix(table(spark, given).withColumnRenamed("source_sector", "source"), SECTORS) if given else graph.matrix(results, p, SECTORS)
        summaries.append(graph.network_summary(edges, nodes, kind))
        out |= {f"network_edges_{kind}": edges.orderBy(F.desc_nulls_last("edge_weight"), "source", "target"), f"network_node_metrics_{kind}": metrics, f"network_adjacency_{kind}": graph.adjacency(results, flag, SECTORS)}
        out |= {f"heatmap_{kind}.svg": figures.heatmap(shown, SECTORS, f"p values ({kind})"), f"network_{kind}.svg": figures.network(edges, nodes, metrics, f"network ({kind})", "no significant edge", include_self_loops_in_plot, min_edge_weight, top_n_labels)}
    return out | {"network_summary": summaries[0].unionByName(summaries[1], allowMissingColumns=True)}


def price_network(spark: SparkSession, input: str, threshold: float = -1.0, pairwise: bool = False) -> dict:  # noqa: A002
    """Correlations of the sectors' returns, and the pairs above a threshold: the 75th percentile unless one is given."""
    wide = panel.conform(table(spark, input), ("trade_date",), tuple(SECTORS), keys=("trade_date",))
    long = panel.lengthen(wide, "trade_date", SECTORS, "series", "value")
    matrix = stats.correlation_matrix(long, "series", "trade_date", "value", listwise=not pairwise)
    limit = stats.corr_threshold(matrix, None if threshold < 0 else threshold)
    edges = graph.threshold_edges(matrix, limit, SECTORS)
    quality.enforce(quality.correlation_checks(matrix, edges, limit))
    both = edges.select("source", "target").union(edges.select("target", "source")).withColumn("on", F.lit(1))
    return {"price_correlation_matrix": graph.matrix(matrix, "corr", SECTORS, source="a", target="b"), "price_network_adjacency": graph.matrix(both, "on", SECTORS, 0), "price_network_edges": edges.orderBy(F.desc("abs_corr")), "price_network_node_metrics": graph.corr_nodes(matrix, limit)}


def compare(spark: SparkSession, news_input: str, price_adjacency_input: str, news_significance_column: str = "significant_raw_05") -> dict:
    """Likeness of the news network and the price network, with a permutation test."""
    news = table(spark, news_input)
    news = panel.require(news, news_significance_column).withColumnsRenamed({a: b for a, b in (("source_sector", "source"), ("target_sector", "target")) if a in news.columns})
    first = news.where(graph.flag_of(news_significance_column) & F.col("source").isin(*SECTORS) & F.col("target").isin(*SECTORS))
    price = table(spark, price_adjacency_input)
    second = graph.matrix_edges(price.withColumnRenamed("source_sector", "source"), SECTORS)
    nodes = _nodes(spark)
    tested = graph.qap(first, second, nodes)
    rows = tested.select(F.lit(float(schemas.QAP_PERMUTATIONS)).alias("qap_permutations"), F.col("p_value").alias("qap_pvalue")).unpivot([], ["qap_permutations", "qap_pvalue"], "metric", "value")
    return {"network_comparison": graph.similarity(first, second, nodes).union(rows)}


def lead_lag(spark: SparkSession, input: str, max_lag: int = schemas.MAX_LAG, fill_missing: bool = True) -> dict:  # noqa: A002
    """Correlation of sentiment with later returns, all lags, the best of each pair, the strongest leads."""
    columns = tuple(p + s for p in ("ret_", "sent_") for s in SECTORS)
    wide = panel.conform(table(spark, input), ("trade_date",), columns)
    if fill_missing:
        wide, _ = panel.fill_missing(wide, [c for c in columns if c.startswith("sent_")])
    tested = stats.significant(stats.lead_lag(stats.series_of(wide, "sent_"), stats.series_of(wide, "ret_"), "series", "t", "value", max_lag))
    best = stats.best_lag(tested)
    quality.enforce(quality.lead_lag_checks(tested, best, len(SECTORS), max_lag))
    return {"lead_lag_all": tested, "lead_lag_best": best, "lead_relations": stats.lead_relations(tested)}


COMMANDS: dict[str, Callable] = {f.__name__.replace("_", "-"): f for f in (prices, articles, sessions, labels, daily, merge, granger, network, price_network, compare, lead_lag)}


def save(outputs: dict, folder: str) -> None:
    """Tables as CSV folders, figures as text files of one line."""
    for name, out in outputs.items():
        if isinstance(out, str):
            spark = SparkSession.getActiveSession()
            spark.createDataFrame([(out,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
        else:
            io.write_csv(out, f"{folder}/{name}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidepanel")
    chosen = top.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        one = chosen.add_parser(name, help=f.__doc__)
        one.add_argument("--output-dir", required=True)
        for p in list(inspect.signature(f).parameters.values())[1:]:
            flag = "--" + p.name.replace("_", "-")
            if p.default is inspect.Parameter.empty:
                one.add_argument(flag, required=True)
            elif isinstance(p.default, bool):
                one.add_argument(flag, action=argparse.BooleanOptionalAction, default=p.default)
            else:
                one.add_argument(flag, type=type(p.default), default=p.default)
    return top


def main(arguments: list[str] | None = None) -> None:
    given = vars(parser().parse_args(arguments))
    f, folder = COMMANDS[given.pop("command")], given.pop("output_dir")
    save(f(SparkSession.getActiveSession() or session(), **given), folder)
