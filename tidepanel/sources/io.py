"""Readers and writers: CSV with a declared schema, documents with pushed-down filters, JSON lines by day, upserts, and sources
behind clients (prices, pages, language models) that run on executors."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text as X
from ..operators import panel
from ..session import importable

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, quotes and line ends inside cells; a byte order mark before the first name is dropped. Without a
    schema all columns are strings, so that nothing is scanned to guess types. Bytes that the encoding doesn't know become
    replacement characters instead of ending the job."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).option("enforceSchema", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.removeprefix(BOM) for c in df.columns])


def write_csv(df: DataFrame, path: str, bom: bool = True, dates_only: tuple[str, ...] = ()) -> None:
    """One file with a header; with bom its first cell begins with a byte order mark. dates_only: columns cut to the date."""
    df = df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates_only}) if dates_only else df
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    days = read_csv(spark, path).select(F.col("trade_date").try_cast("date").alias("trade_date")).dropna().distinct()
    if days.isEmpty():
        raise ValueError("the calendar has no valid date")
    return days


#: What a store of articles holds; older rows have published_at as text in several formats.
ARTICLE = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("_id", "article_id", "url_hash", "source", "title", "url", "source_url", "published_at", "category", "raw_text")),
        T.StructField("summary_json", schemas.SUMMARY),
        *(T.StructField(c, T.StringType()) for c in ("status", "scrape_method", "created_at", "claimed_at")),
        T.StructField("retry_count", T.IntegerType()),
    ]
)


def read_documents(spark: SparkSession, path: str, source: str = "cafef", limit: int | None = None, schema: T.StructType = ARTICLE, form: str = "json") -> DataFrame:
    """Articles that have a date and come from the source or from none; with a limit the oldest ones. Filters reach the
    scan where the format takes them."""
    df = spark.read.schema(schema).format(form).load(path)
    df = df.where(F.col("published_at").isNotNull() & (F.col("source").isNull() | (F.lower("source") == source.lower())))
    return df.orderBy("published_at").limit(limit) if limit else df


def undated(df: DataFrame) -> DataFrame:
    """One row: articles, and those without a date."""
    return df.agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("published_at").isNull()).alias("undated"))


def export_articles(docs: DataFrame) -> DataFrame:
    """Flat columns of articles; ids and urls fall back to their older names."""
    has = set(docs.columns)
    pick = lambda *n: F.coalesce(*[F.col(c).cast("string") for c in n if c in has], F.lit(None).cast("string"))
    out = [pick("article_id", "_id", "url_hash").alias("article_id"), *(pick(c).alias(c) for c in ("source", "title")), pick("url", "source_url").alias("url"), *(pick(c).alias(c) for c in ("published_at", "category"))]
    if "summary_json" in has:
        out += [F.to_json("summary_json").alias("summary_json"), *(F.col(f"summary_json.{k}").alias(f"summary_{k}") for k in ("impact", "sentiment_score", "sector")), F.to_json("summary_json.tickers").alias("tickers")]
    return docs.select(*out)


def append_jsonl(df: DataFrame, path: str, day: str = "ingest_date") -> None:
    df.write.mode("append").partitionBy(day).json(path)


def upsert_parquet(spark: SparkSession, new: DataFrame, path: str, keys: list[str], target: str, order: str | None = None) -> DataFrame:
    """The table at path with new rows replacing old by key, written to target; one row of counts: inserted, updated, failed."""
    current = spark.read.parquet(path)
    counts = panel.upsert_counts(current, new, keys)
    panel.upsert(current, panel.drop_nulls(new, *keys), keys, order).write.mode("overwrite").parquet(target)
    return counts


def migrate_dates(df: DataFrame, c: str = "published_at") -> DataFrame:
    """df with the column as a timestamp without zone; what can't be read is null."""
    return df.withColumn(c, X.parse_datetime(c))


def migration_counts(df: DataFrame, c: str = "published_at") -> DataFrame:
    """The dry run, one row: rows, texts, those that can be read and those that can't, up to 20 of the latter."""
    text, read = F.col(c).isNotNull(), X.parse_datetime(c).isNotNull()
    bad = F.slice(F.array_sort(F.collect_set(F.when(text & ~read, F.substring(c, 1, 200)))), 1, 20)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(text).alias("texts"), F.count_if(text & read).alias("converted"), F.count_if(text & ~read).alias("unparseable"), bad.alias("samples"))


# --- clients ----------------------------------------------------------------------------------------------------------

#: Characters of an article that each language model is sent.
TEXT_LIMITS = {"ollama": 3000, "gemini": 12000, "groq": 15000}


def attempt(call: Callable, *args, tries: int = 3, wait: Callable[[int], float] = lambda k: 2.0**k, sleep: Callable[[float], None] = time.sleep):
    """The result of a call, tried up to `tries` times with a pause after each failure; the last failure is raised."""
    for k in range(tries):
        try:
            return call(*args)
        except Exception:
            if k + 1 == tries:
                raise
            sleep(wait(k))
    raise ValueError("tries must be 1 or more")


def enrich(df: DataFrame, client: Callable[[str], str], text: str = "raw_text", backend: str = "gemini", limit: int | None = None) -> DataFrame:
    """df with summary_json, from a client that maps a text to a JSON text, and summary_error, null where it answered. The
    client is called on executors, a batch at a time; the text is cut at the backend's limit or the one given."""
    size = TEXT_LIMITS[backend] if limit is None else limit
    importable(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, errors = [], []
            for t in pdf[text]:
                try:
                    out.append(X.first_json_object(client((t or "")[:size])))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a client may raise anything; the row says what, and can be retried
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(summary_json=out, summary_error=errors)

    kept = [f for f in df.schema.fields if f.name not in ("summary_json", "summary_error")]
    return df.mapInPandas(run, T.StructType([*kept, T.StructField("summary_json", T.StringType()), T.StructField("summary_error", T.StringType())]))


def fetch_pages(urls: DataFrame, client: Callable[[str], str], tries: int = 3, pause: Callable[[int], float] = lambda k: 2.0**k, url: str = "url") -> DataFrame:
    """urls with html and fetch_error: each page is asked for up to `tries` times, the pause doubling."""
    importable(urls.sparkSession)

    def run(batches):
        for pdf in batches:
            html, errors = [], []
            for u in pdf[url]:
                try:
                    html.append(attempt(client, u, tries=tries, wait=pause))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - as above
                    html.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(html=html, fetch_error=errors)

    kept = [f for f in urls.schema.fields if f.name not in ("html", "fetch_error")]
    return urls.mapInPandas(run, T.StructType([*kept, T.StructField("html", T.StringType()), T.StructField("fetch_error", T.StringType())]))


#: Requests after which the price source rests, the rest and the pause between requests, in seconds.
PRICE_BATCH, PRICE_REST, PRICE_PAUSE, PRICE_WAIT = 18, 65.0, 0.5, 2.0


def fetch_prices(spark: SparkSession, tickers: list[str], clients: list[Callable], start: dt.date, end: dt.date, tries: int = 3, sleep: Callable[[float], None] = time.sleep, tasks: int = 1) -> DataFrame:
    """Prices of the tickers, each once and in the order given, within [start, end]. Clients (ticker, start, end) -> pandas frame
    are tried in turn, each up to `tries` times; a ticker that none knows has no row. A task rests after PRICE_BATCH requests:
    the budget is one client's, so more tasks need as many budgets."""
    if start > end:
        raise ValueError("start lies after end")
    importable(spark)
    once = list(dict.fromkeys(tickers))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(once)], "place int, ticker string").repartitionByRange(tasks, "place")
    wanted = [f.name for f in T.StructType.fromDDL(schemas.OHLCV).fields]
    plain = {a: target for target, names in schemas.OHLCV_ALIASES.items() for a in names}

    def one(ticker: str) -> pd.DataFrame:
        for client in clients:
            try:
                found = attempt(client, ticker, start, end, tries=tries, wait=lambda _: PRICE_WAIT, sleep=sleep)
            except Exception:  # noqa: BLE001 - the next client is asked
                continue
            if found is not None and len(found):
                return found
        return pd.DataFrame()

    def run(batches):
        n = 0
        for pdf in batches:
            for ticker in pdf.sort_values("place")["ticker"]:
                if n and n % PRICE_BATCH == 0:
                    sleep(PRICE_REST)
                elif n:
                    sleep(PRICE_PAUSE)
                n += 1
                found = one(ticker)
                names = {c: plain[k] for c in found.columns if (k := "".join(ch for ch in str(c).lower() if ch.isalnum())) in plain}
                found = found.rename(columns=names).loc[:, lambda f: ~f.columns.duplicated()]
                if not {"trade_date", "close"} <= set(found.columns):
                    continue
                got = found.reindex(columns=wanted).assign(ticker=ticker, trade_date=pd.to_datetime(found["trade_date"], errors="coerce").dt.date)
                for c in wanted[2:]:
                    got[c] = pd.to_numeric(got[c], errors="coerce")
                yield got.dropna(subset=["trade_date", "close"]).drop_duplicates("trade_date", keep="last")

    return panel.between_dates(rows.mapInPandas(run, schemas.OHLCV), "trade_date", start, end)
