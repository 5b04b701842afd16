"""Relational operators on long panels: conforming, calendars, sentiment, returns, joins, coverage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..session import number, ratio


def require(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def keep_last(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key by `order`, which must be total."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rename_aliases(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns renamed by alias: names are compared lower case, letters and digits alone. Of several columns of one target
    that which already has its name is taken, else the first; the others go."""
    plain = {a: target for target, names in aliases.items() for a in names}
    wanted = {c: plain.get("".join(ch for ch in c.lower() if ch.isalnum())) for c in df.columns}
    chosen = {}
    for c, target in wanted.items():
        if target and (target not in chosen or c == target):
            chosen[target] = c
    return df.select(*[F.col(f"`{c}`").alias(target or c) for c, target in wanted.items() if not target or chosen[target] == c])


def drop_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where none of the columns (all, if none is named) is null."""
    return df.dropna("any", subset=list(columns) or None)


def conform(df: DataFrame, dates: tuple[str, ...] = (), numbers: tuple[str, ...] = (), texts: tuple[str, ...] = (), keys: tuple[str, ...] = (), last: Column | str | None = None, only: dict[str, list[str]] | None = None) -> DataFrame:
    """The named columns alone: dates cut to the day, numbers read where they can be. Rows without a date go, and those whose
    column isn't among its allowed values (`only`); of rows of equal keys the last by `last` stays, any one if none is given."""
    require(df, *dates, *numbers, *texts)
    order = [] if last is None else [(F.col(last) if isinstance(last, str) else last).alias("_last")]
    day = lambda c: X.parse_datetime(c).cast("date") if df.schema[c].dataType.simpleString() == "string" else F.col(c).try_cast("date")
    out = df.select(*[day(c).alias(c) for c in dates], *[F.col(c) for c in texts], *[number(F.col(c)).alias(c) for c in numbers], *order)
    out = drop_nulls(out, *dates) if dates else out
    for c, allowed in (only or {}).items():
        out = out.where(F.col(c).isin(*allowed))
    if keys:
        out = keep_last(out, list(keys), "_last") if order else out.dropDuplicates(list(keys))
    return out.drop("_last")


def normalize_ohlcv(df: DataFrame, ticker: str | None = None, last: Column | str | None = None) -> DataFrame:
    """Prices with the columns of schemas.OHLCV: aliases resolved, absent columns but date and close null, rows without date or
    close dropped, the last of each ticker and day kept. Without a date or a close column there is no row."""
    spark, df = df.sparkSession, rename_aliases(df, schemas.OHLCV_ALIASES)
    if not {"trade_date", "close"} <= set(df.columns) or not (ticker or "ticker" in df.columns):
        return spark.createDataFrame([], schemas.OHLCV)
    numbers = ("open", "high", "low", "close", "volume")
    absent = {c: F.lit(None).cast("double") for c in numbers if c not in df.columns}
    df = df.withColumns(absent | ({"ticker": F.lit(ticker)} if ticker else {}) | {"_order": F.lit(0) if last is None else F.col(last) if isinstance(last, str) else last})
    out = drop_nulls(conform(df, ("trade_date",), numbers, ("ticker", "_order")), "close")
    return keep_last(out, ["ticker", "trade_date"], "_order").select("trade_date", "ticker", *numbers)


def fill_missing(df: DataFrame, columns: list[str], value: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """df with nulls of the columns filled, and one row: how many cells were."""
    filled = df.agg(sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0)).cast("long").alias("filled_cells"))
    return df.fillna(value, subset=columns), filled


def standard_only(df: DataFrame, entity: str, entities) -> tuple[DataFrame, DataFrame]:
    """Rows of the entities, and one row: how many others there were."""
    known = F.coalesce(F.col(entity).isin(*entities), F.lit(False))
    return df.where(known), df.agg(F.count_if(~known).alias("dropped_rows"))


def parse_bound(value, name: str = "date"):
    """A date from a user's text: blank is none, what can't be read is an error."""
    if value is None or isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return value
    text = str(value).strip()
    if not text:
        return None
    for form in ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y"):
        try:
            return dt.datetime.strptime(text, form).date()
        except ValueError:
            continue
    raise ValueError(f"{name}: {value!r} isn't a date")


def between_dates(df: DataFrame, c: str, start=None, end=None) -> DataFrame:
    """Inclusive on both ends; None or blank is open."""
    start, end = parse_bound(start, "start"), parse_bound(end, "end")
    if start is not None and end is not None and start > end:
        raise ValueError("start lies after end")
    if start is not None:
        df = df.where(F.col(c) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(c) <= F.lit(end).cast("date"))


# --- calendar ------------------------------------------------------------------------------------------------------


#: Days that a trading calendar may span: two and a half centuries.
MOST_DAYS = 100_000


def calendar_map(days: DataFrame, day: str = "trade_date") -> tuple[DataFrame, dt.date | None]:
    """For every date from the first trading day to the last: whether it's a trading day, the trading day on or after it, and
    the one strictly after it (null past the last); and the first trading day. The map's size is that of the calendar,
    whatever dates the data have, and checked, so that it can be broadcast."""
    days = days.select(F.col(day).cast("date").alias("d")).dropna().distinct()
    ends = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).first()
    if ends.lo is not None and (ends.hi - ends.lo).days > MOST_DAYS:
        raise ValueError(f"the calendar runs from {ends.lo} to {ends.hi}")
    every = days.sparkSession.range(1).select(F.explode(F.sequence(F.lit(ends.lo).cast("date"), F.lit(ends.hi).cast("date"))).alias("date"))
    w = W.orderBy("date")
    marked = every.join(days, every.date == days.d, "left")
    return marked.select(
        "date",
        F.col("d").isNotNull().alias("is_trading"),
        F.first("d", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("on_or_after"),
        F.first("d", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("after"),
    ), ends.lo


def as_of(df: DataFrame, days: DataFrame, date: str, day: str = "trade_date") -> DataFrame:
    """df with is_trading, on_or_after and after of each date: an equi-join with the calendar's map. Dates before the first
    trading day go to it, dates past the last have none."""
    cal, first = calendar_map(days, day)
    early = F.col(date) < F.lit(first).cast("date")
    out = df.join(F.broadcast(cal.withColumnRenamed("date", "_date")), F.col(date) == F.col("_date"), "left")
    lead = lambda c: F.when(early, F.lit(first).cast("date")).otherwise(F.col(c))
    return out.select(*df.columns, F.coalesce("is_trading", F.lit(False)).alias("is_trading"), lead("on_or_after").alias("on_or_after"), lead("after").alias("after"))


def map_sessions(df: DataFrame, days: DataFrame, at: str = "published_at_vn") -> DataFrame:
    """Session bucket, trade date, reason and flag for a market wall time."""
    joined = as_of(df.withColumn("_d", F.to_date(at)), days, "_d")
    clock = F.date_format(at, "HH:mm:ss")
    opens, noon, closes = schemas.SESSION_CUTS
    bad, off = F.col(at).isNull(), ~F.col("is_trading")
    early, morning, day = clock < opens, clock < noon, clock < closes
    bucket = F.when(bad, "UNKNOWN").when(off, "NEXT_MORNING").when(early, "PRE_MARKET").when(morning, "MORNING").when(day, "AFTERNOON").otherwise("NEXT_MORNING")
    date = F.when(bad, None).when(off, F.col("on_or_after")).when(day, F.col("_d")).otherwise(F.col("after"))
    reason = (
        F.when(bad, "invalid_published_at")
        .when(date.isNull(), "no_next_trading_day_found")
        .when(off, "non_trading_day_to_next_morning")
        .when(early, "before_market_open")
        .when(morning, "morning_session")
        .when(day, "afternoon_session")
        .otherwise("after_close_to_next_morning")
    )
    out = joined.select(*df.columns, bucket.alias("session_bucket"), date.alias("trade_date"), reason.alias("mapped_reason"))
    return out.withColumn("is_mapped", F.col("trade_date").isNotNull())


# --- sentiment ------------------------------------------------------------------------------------------------------


def label_articles(df: DataFrame) -> DataFrame:
    """Sentiment and sector of each article: tickers, then the sector field, then title, category and summary."""
    has = set(df.columns)

    def pick(*names: str) -> Column:
        found = [F.col(f"`{n}`").cast("string") for n in names if n in has]
        return F.coalesce(*found, F.lit(None).cast("string"))

    raw = pick("summary_json")
    record = X.summary_object(raw)
    df = df.withColumns({"_rec": record})
    impact = F.coalesce(pick("summary_json.impact", "summary_impact"), F.col("_rec.impact"))
    label = X.sentiment_label(impact)
    score = X.clip_score(F.coalesce(pick("summary_json.sentiment_score", "summary_sentiment_score"), F.col("_rec.sentiment_score").cast("string")))
    sector_raw = F.coalesce(pick("summary_json.sector", "summary_sector"), F.col("_rec.sector"))
    ticker_raw = F.coalesce(pick(*schemas.TICKER_COLUMNS), F.to_json("_rec.tickers"))
    tables = schemas.SECTOR_KEYWORDS | {schemas.MACRO: schemas.MACRO_KEYWORDS}
    table = F.create_map(*[F.lit(x) for s, ts in schemas.SECTOR_TICKERS.items() for t in ts for x in (t, s)])
    df = df.withColumns(
        {
            "impact_raw": impact,
            "sentiment_label": label,
            "sentiment_score_impact": X.label_score(label),
            "_score": score,
            "sector_raw": sector_raw,
            "ticker_raw": ticker_raw,
            "ticker_list": X.ticker_list(ticker_raw),
            "_sector": X.fold(sector_raw),
            "_text": X.fold(F.concat_ws(" ", pick("title"), pick("category"), raw)),
        }
    )
    df = df.withColumns(
        {
            "_by_ticker": F.array_distinct(F.filter(F.transform("ticker_list", lambda t: F.try_element_at(table, t)), lambda s: s.isNotNull())),
            "_in_field": X.keywords_in(F.col("_sector"), tables),
            "_in_text": X.keywords_in(F.col("_text"), tables),
        }
    )
    sectors = lambda c: F.array_remove(c, schemas.MACRO)
    df = df.withColumns({"_by_field": sectors("_in_field"), "_by_text": sectors("_in_text")})
    macro_field, macro_text = F.array_contains("_in_field", schemas.MACRO), F.array_contains("_in_text", schemas.MACRO)
    empty = F.array().cast("array<string>")

    def verdict(labels: Column, method: Column | str, confidence: Column | float) -> Column:
        return F.struct(labels.alias("labels"), (F.lit(method) if isinstance(method, str) else method).alias("method"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"))

    several = F.size("_by_ticker") > 1
    chosen = (
        F.when(F.size("_by_ticker") > 0, verdict(F.col("_by_ticker"), F.when(several, "multi_ticker").otherwise("ticker"), F.when(several, 0.95).otherwise(1.0)))
        .when(F.size("_by_field") > 0, verdict(F.col("_by_field"), "keyword", 0.8))
        .when(macro_field, verdict(empty, "macro", 0.8))
        .when(F.size("_by_text") > 0, verdict(F.col("_by_text"), "keyword_fallback", 0.6))
        .when(macro_text, verdict(empty, "macro", 0.6))
        .otherwise(verdict(empty, "unmapped", 0.0))
    )
    df = df.withColumn("_v", chosen)
    mapped, macro = F.size("_v.labels") > 0, F.col("_v.method") == "macro"
    first = F.when(mapped, F.get("_v.labels", F.lit(0))).when(macro, schemas.MACRO).otherwise(schemas.UNMAPPED)
    out = df.withColumns(
        {
            "is_sentiment_mapped": F.col("sentiment_label").isNotNull(),
            "sentiment_score": F.coalesce("_score", "sentiment_score_impact"),
            "sentiment_score_source": F.when(F.col("_score").isNotNull(), "llm_continuous").otherwise("impact_fallback"),
            "sector_labels": F.col("_v.labels"),
            "primary_sector": first,
            "sector_label": first,
            "sector_weight": F.when(mapped, F.lit(1.0) / F.size("_v.labels")),
            "sector_mapping_method": F.col("_v.method"),
            "sector_mapping_confidence": F.col("_v.confidence"),
            "is_sector_mapped": mapped,
            "is_macro": macro,
        }
    )
    return out.drop("_rec", "_score", "_sector", "_text", "_by_ticker", "_in_field", "_in_text", "_by_field", "_by_text", "_v")


def explode_sectors(labelled: DataFrame) -> DataFrame:
    """A row per article and sector, weighing 1 / number of sectors."""
    rows = labelled.where("is_sector_mapped")
    return rows.withColumn("sector_weight", F.lit(1.0) / F.size("sector_labels")).withColumn("sector_label", F.explode("sector_labels"))


def daily_sentiment(df: DataFrame, time: str = "trade_date", entity: str = "sector_label", score: str = "sentiment_score", weight: str = "sector_weight", key: str = "article_id", entities: list[str] | None = None, eps: float = schemas.NEUTRAL_EPS) -> DataFrame:
    """The 13 daily metrics of each entity. Missing weight counts 1; a null key is an article of its own."""
    if entities:
        df = df.where(F.col(entity).isin(*entities))
    s = F.col(score)
    w = F.coalesce(F.col(weight), F.lit(1.0)) if weight in df.columns else F.lit(1.0)
    df = df.where(F.col(time).isNotNull() & F.col(entity).isNotNull())
    p, n = s > eps, s < -eps
    z = s.isNotNull() & ~p & ~n
    keyed = F.countDistinct(F.col(key)) + F.count_if(F.col(key).isNull()) if key in df.columns else F.count(F.lit(1))
    part = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    return df.groupBy(time, entity).agg(
        keyed.cast("long").alias("article_count"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum(w).alias("weighted_article_count"),
        F.avg(s).alias("sentiment_mean"),
        F.sum(s).alias("sentiment_sum"),
        F.sum(s * w).alias("weighted_sentiment_sum"),
        ratio(F.sum(s * w), F.sum(F.when(s.isNotNull(), w))).alias("sentiment_weighted_mean"),
        *[F.count_if(c).alias(f"{k}_count") for k, c in (("positive", p), ("neutral", z), ("negative", n))],
        *[part(c).alias(f"{k}_weighted_count") for k, c in (("positive", p), ("neutral", z), ("negative", n))],
    )


# --- returns ---------------------------------------------------------------------------------------------------------


def simple_returns(df: DataFrame, ticker: str = "ticker", date: str = "trade_date", price: str = "close") -> DataFrame:
    """Change over the ticker's own previous row; null for the first and where the previous price is zero."""
    before = F.lag(price).over(W.partitionBy(ticker).orderBy(date))
    return df.withColumn("ret", ratio(F.col(price), before) - 1)


def group_returns(df: DataFrame, members: DataFrame, ticker: str = "ticker", group: str = "sector", date: str = "trade_date") -> DataFrame:
    """Equal-weight mean, non-null count and missing count of each date and group; dates without any return go.
    members: (ticker, group)."""
    members = members.where(F.col(group).isNotNull())
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    known = df.join(members, ticker).groupBy(date, group).agg(F.avg("ret").alias("r"), F.count("ret").alias("n"))
    # a day's groups, as many as there are names, in one map: no second join against the grid of days and groups
    days = known.groupBy(date).agg(F.map_from_entries(F.collect_list(F.struct(F.col(group), F.struct("r", "n")))).alias("_of"), F.max("n").alias("_any")).where("_any > 0")
    n = F.coalesce(F.col("_found.n"), F.lit(0)).cast("long")
    grid = days.crossJoin(sizes).withColumn("_found", F.try_element_at("_of", F.col(group)))
    return grid.select(date, group, F.col("_found.r").alias("sector_return"), n.alias("ticker_count"), (F.col("_size") - n).cast("long").alias("missing_count"))


# --- joins, reshaping, coverage --------------------------------------------------------------------------------------


def widen(df: DataFrame, time: str, entity: str, value: str, entities: list[str], prefix: str = "") -> DataFrame:
    """One column for each entity of the list, absent ones null."""
    wide = df.groupBy(time).pivot(entity, entities).agg(F.first(value))
    return wide.select(time, *[F.col(f"`{e}`").alias(prefix + e) for e in entities])


def lengthen(df: DataFrame, time: str, columns: list[str], entity: str = "sector_label", value: str = "sector_return") -> DataFrame:
    return df.unpivot([time], columns, entity, value)


def overlap(a: DataFrame, b: DataFrame, date: str = "trade_date", start=None, end=None) -> tuple:
    """Latest of the first and earliest of the last dates, within the bounds; an error where nothing is left."""
    lo_hi = [df.agg(F.min(date).alias("lo"), F.max(date).alias("hi")) for df in (a, b)]
    row = lo_hi[0].union(lo_hi[1]).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.count("lo").alias("n")).first()
    lo = max([x for x in (row.lo, start) if x is not None], default=None)
    hi = min([x for x in (row.hi, end) if x is not None], default=None)
    if row.n < 2 or lo > hi:
        raise ValueError("the date ranges don't overlap")
    return lo, hi


def merge_long(returns: DataFrame, sentiment: DataFrame, keys: list[str]) -> DataFrame:
    return returns.join(sentiment, keys, "left")


def coverage(merged: DataFrame, entity: str = "sector_label", ret: str = "sector_return", sent: str = "sentiment_weighted_mean", articles: str = "article_count") -> DataFrame:
    r, s = F.col(ret).isNotNull(), F.col(sent).isNotNull()
    n = F.count(F.lit(1))
    return merged.groupBy(entity).agg(
        n.alias("n_trading_days"),
        F.count_if(r).alias("return_non_null_count"),
        F.count_if(~r).alias("return_missing_count"),
        ratio(F.count_if(~r), n).alias("return_missing_ratio"),
        F.count_if(s).alias("sentiment_non_null_count"),
        F.count_if(~s).alias("sentiment_missing_count"),
        ratio(F.count_if(~s), n).alias("sentiment_missing_ratio"),
        F.count_if(r & s).alias("both_non_null_count"),
        ratio(F.count_if(r & s), n).alias("both_non_null_ratio"),
        F.count_if(F.coalesce(F.col(articles), F.lit(0)) > 0).alias("article_days_count"),
        F.sum(F.col(articles).cast("double")).alias("total_article_count"),
    )


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).unpivot([], columns, "column", "missing_ratio")


def describe_by(df: DataFrame, group: str, value: str) -> DataFrame:
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("lo"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(value).alias("hi"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """new replaces current by key; of new rows of one key the last by `order` stays, any one if none is given."""
    once = keep_last(new, keys, order) if order else new.dropDuplicates(keys)
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(once)


def upsert_counts(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of new that are inserted and that are updated, and rows of new without a key, which can't be saved."""
    given = F.lit(True)
    for k in keys:
        given = given & F.col(k).isNotNull()
    old = current.select(*keys).distinct().withColumn("_old", F.lit(True))
    found = new.where(given).select(*keys).distinct().join(old, keys, "left")
    failed = new.agg(F.count_if(~given).alias("failed"))
    return found.agg(F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if("_old").alias("updated")).crossJoin(failed)  # rows of one


def insert_absent(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(new.join(current.select(*keys), keys, "left_anti").dropDuplicates(keys))


def at_sink(df: DataFrame, *order: str) -> DataFrame:
    """df sorted for a sink: the only place where order is kept."""
    return df.orderBy(*order)
