"""Checks as rows: check, failures. A pipeline raises on those it cares for; a check whose name begins with `warning` isn't one
to raise on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One scan: how many rows break each rule (a null outcome breaks it)."""
    names = list(rules)
    counted = df.agg(*[F.count_if(~F.coalesce(rules[n], F.lit(False))).alias(n) for n in names])
    return counted.unpivot([], names, "check", "failures")


def enforce(found: DataFrame) -> None:
    if bad := [(r["check"], r["failures"]) for r in found.where("failures > 0 AND NOT check LIKE 'warning%'").collect()]:
        raise ValueError(f"checks failed: {bad}")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.lit("unique " + ", ".join(keys)).alias("check"), F.count_if(F.col("n") > 1).alias("failures"))


def both(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """How many of the columns are missing."""
    return df.sparkSession.range(1).select(F.lit("columns " + ", ".join(names)).alias("check"), F.lit(sum(n not in df.columns for n in names)).cast("long").alias("failures"))


def rows_expected(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    return df.agg(F.lit(f"{n} {what}").alias("check"), F.abs(F.count(F.lit(1)) - n).alias("failures"))


def outside(df: DataFrame, c: str, lo: float, hi: float, most: int = 5) -> list:
    """At most `most` values that lie outside [lo, hi]."""
    return [r[0] for r in df.where(F.col(c).isNotNull() & ~F.col(c).between(lo, hi)).select(c).limit(most).collect()]


def require_range(df: DataFrame, c: str, lo: float, hi: float) -> DataFrame:
    """df; an error that names up to five offenders if a value of c lies outside [lo, hi]."""
    if bad := outside(df, c, lo, hi):
        raise ValueError(f"{c} outside [{lo}, {hi}]: {bad}")
    return df


def matrix_checks(matrix: DataFrame, entities, name: str = "matrix", binary: bool = False, diagonal: bool = False) -> DataFrame:
    """A matrix of source, one column for each entity: its rows and columns, cells of 0 and 1, a diagonal of zeros."""
    found = [columns(matrix, "source", *entities), unique(matrix, "source"), rows_expected(matrix.where(F.col("source").isin(*entities)), len(entities), f"rows of the {name}")]
    rules = {}
    if binary:
        rules["cells of 0 and 1"] = reduce(lambda a, b: a & b, [F.col(f"`{e}`").isin(0, 1) for e in entities])
    if diagonal:
        rules["zero diagonal"] = reduce(lambda a, b: a & b, [(F.col("source") != e) | (F.col(f"`{e}`") == 0) for e in entities])
    return both(*found, *([checks(matrix, rules)] if rules else []))


def price_checks(long: DataFrame, entities=schemas.SECTORS, least_days: int = 200, most_missing: float = 0.2) -> DataFrame:
    """Errors, and warnings by name: fewer days than usual, groups that miss more than a fifth of their returns."""
    days = long.agg(F.countDistinct("trade_date").alias("d")).select(F.lit(f"warning: fewer than {least_days} days").alias("check"), (F.col("d") < least_days).cast("long").alias("failures"))
    gaps = long.groupBy("sector").agg(F.avg(F.col("sector_return").isNull().cast("double")).alias("m")).agg(F.lit(f"warning: more than {most_missing:.0%} missing").alias("check"), F.count_if(F.col("m") > most_missing).alias("failures"))
    wide = long.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n")).agg(F.lit(f"at most {len(entities)} groups a day").alias("check"), F.count_if(F.col("n") > len(entities)).alias("failures"))
    rules = {"return is a number": F.col("sector_return").isNull() | ~F.isnan("sector_return"), "counts": F.col("ticker_count") + F.col("missing_count") >= 1, "known group": F.col("sector").isin(*entities)}
    return both(columns(long, "trade_date", "sector", "sector_return", "ticker_count", "missing_count"), unique(long, "trade_date", "sector"), wide, checks(long, rules), days, gaps)


def session_checks(df: DataFrame) -> DataFrame:
    """Columns, buckets and dates; how many rows are unmapped is a warning."""
    rules = {"mapped rows have a date": F.col("is_mapped") == F.col("trade_date").isNotNull(), "bucket": F.col("session_bucket").isin("PRE_MARKET", "MORNING", "AFTERNOON", "NEXT_MORNING", "UNKNOWN"), "warning: unmapped": F.col("is_mapped")}
    return both(columns(df, "session_bucket", "trade_date", "mapped_reason", "is_mapped"), checks(df, rules))


def session_summary(df: DataFrame) -> DataFrame:
    """One row: articles, mapped and unmapped, first and last trade date."""
    return df.agg(F.count(F.lit(1)).alias("articles"), F.count_if("is_mapped").alias("mapped"), F.count_if(~F.col("is_mapped")).alias("unmapped"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def label_checks(df: DataFrame) -> DataFrame:
    return checks(df, {"score range": F.col("sentiment_score").isNull() | F.col("sentiment_score").between(-1, 1), "no sentinel": ~F.col("sector_label").isin(schemas.MACRO, schemas.UNMAPPED)})


def daily_checks(df: DataFrame, entity: str = "sector_label", entities=schemas.SECTORS) -> DataFrame:
    return both(unique(df, "trade_date", entity), checks(df, {"known entity": F.col(entity).isin(*entities), "date": F.col("trade_date").isNotNull()}))


def merge_checks(df: DataFrame, lo, hi, entity: str = "sector_label", entities=schemas.SECTORS, report: DataFrame | None = None) -> DataFrame:
    """Dates within the overlap, known entities and none of the sentinels; the coverage report has a row for each entity."""
    rules = {"within the overlap": F.col("trade_date").between(F.lit(lo), F.lit(hi)), "known entity": F.col(entity).isin(*entities), "no sentinel": ~F.col(entity).isin(schemas.MACRO, schemas.UNMAPPED)}
    found = [columns(df, "trade_date", entity), checks(df, rules)]
    return both(*found, *([rows_expected(report, len(entities), "rows of the report")] if report is not None else []))


def granger_checks(df: DataFrame, expected: int, entities=None, adjacency: DataFrame | None = None) -> DataFrame:
    rules = {"p range": F.col("p_value").isNull() | F.col("p_value").between(0, 1)}
    if entities:
        rules |= {"known source": F.col("source").isin(*entities), "known target": F.col("target").isin(*entities)}
    found = [unique(df, "source", "target"), rows_expected(df, expected, "pairs"), checks(df, rules)]
    return both(*found, *([matrix_checks(adjacency, entities, "adjacency", binary=True)] if adjacency is not None else []))


def network_checks(edges: DataFrame, flagged: DataFrame, nodes: DataFrame | None = None, n_nodes: int | None = None) -> DataFrame:
    e, f = edges.agg(F.count(F.lit(1)).alias("e")), flagged.agg(F.count(F.lit(1)).alias("f"))
    found = e.crossJoin(f).select(F.lit("edges equal flags").alias("check"), F.abs(F.col("e") - F.col("f")).alias("failures"))  # rows of one
    return found if nodes is None else both(found, rows_expected(nodes, n_nodes, "rows of nodes"))


def correlation_checks(matrix: DataFrame, edges: DataFrame | None = None, threshold: DataFrame | None = None) -> DataFrame:
    """Symmetric, within [-1, 1], a unit diagonal; with edges, as many as pairs above the threshold."""
    mirror = matrix.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("corr").alias("other"))
    rules = {
        "symmetric": F.col("corr").eqNullSafe(F.col("other")) | (F.abs(F.col("corr") - F.col("other")) < 1e-9),
        "range": F.col("corr").isNull() | (F.abs("corr") <= 1 + 1e-9),
        "diagonal": (F.col("a") != F.col("b")) | F.col("corr").isNull() | (F.abs(F.col("corr") - 1) < 1e-9),
    }
    found = checks(matrix.join(mirror, ["a", "b"], "left"), rules)
    if edges is None:
        return found
    cells = matrix.where("a <> b").crossJoin(threshold).agg((F.count_if(F.abs("corr") > F.col("threshold")) / 2).alias("c"))  # a threshold is one row
    return both(found, cells.crossJoin(edges.agg(F.count(F.lit(1)).alias("e"))).select(F.lit("edges are half the cells").alias("check"), F.abs(F.col("c") - F.col("e")).cast("long").alias("failures")))


def lead_lag_checks(tested: DataFrame, best: DataFrame, n: int, max_lag: int = schemas.MAX_LAG) -> DataFrame:
    """n * n pairs at each lag, one best lag each, correlations within [-1, 1]."""
    return both(rows_expected(tested, n * n * (max_lag + 1), "lags"), rows_expected(best, n * n, "pairs"), unique(best, "s", "r"), checks(tested, {"corr range": F.col("corr").isNull() | (F.abs("corr") <= 1 + 1e-9)}))
