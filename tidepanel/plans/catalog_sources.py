"""Queries of sources, sinks, the work queue and streams: tables written in their formats and read back."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import panel, quality
from ..session import scratch_path
from ..sources import io
from ..streaming import ingest
from .registry import Registry

query = Registry()
NOW = dt.datetime(2024, 1, 20, 12)


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


@query("SELECT n_nationkey, n_name || '\"q\", ' || chr(10) || 'é' AS words, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def csv_round_trip(s, d):
    """Quotes, commas, line ends and a byte order mark survive a CSV file."""
    n = _t(s, d, "nation").join(_t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select("n_nationkey", F.concat("n_name", F.lit('"q", \né')).alias("words"), "r_name")
    path = scratch_path(s, "csv")
    io.write_csv(rows, path)
    return io.read_csv(s, path, rows.schema)


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') published_at_vn FROM events WHERE event_id < 1000000")
def csv_dates_only(s, d):
    """A timestamp written with its date alone."""
    path = scratch_path(s, "csv-dates")
    io.write_csv(_t(s, d, "events").where("event_id < 1000000").select("event_id", F.col("ts").alias("published_at_vn")), path, dates_only=("published_at_vn",))
    return io.read_csv(s, path, "event_id long, published_at_vn string")


@query("SELECT DISTINCT o_orderdate::DATE trade_date FROM orders WHERE o_orderkey % 7 <> 0")
def calendar_days(s, d):
    """A calendar of texts, some of which aren't dates and many repeat."""
    o = _t(s, d, "orders")
    path = scratch_path(s, "calendar")
    io.write_csv(o.select(F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("trade_date")), path)
    return io.read_calendar(s, path)


def _articles(s, d):
    p = _t(s, d, "pages")
    which = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("page_id") % len(v) + 1).cast("int"))
    return p.select(
        F.concat(F.lit("a"), "page_id").alias("_id"),
        F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("A"), "page_id")).alias("article_id"),
        which("CafeF", None, "other", "cafef").alias("source"),
        F.substring("url", 1, 12).alias("title"),
        F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("url"),
        F.col("url").alias("source_url"),
        F.when(F.col("page_id") % 5 != 0, F.date_format(F.date_add(F.lit("2024-01-01"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd")).alias("published_at"),
        which("a", "b").alias("category"),
        F.struct(F.array(F.lit("s")).alias("summary"), F.array(F.lit("VCB"), F.lit("FPT")).alias("tickers"), which("Positive", "Negative").alias("impact"), (F.col("page_id") % 10 / 10).alias("sentiment_score"), F.lit("ngân hàng").alias("sector")).alias("summary_json"),
    )


_SOURCE = "(['CafeF', NULL, 'other', 'cafef'])[page_id % 4 + 1]"


@query(f"""SELECT CASE WHEN page_id % 3 <> 0 THEN 'A' || page_id ELSE 'a' || page_id END article_id, {_SOURCE} AS source, url, strftime(DATE '2024-01-01' + (page_id % 300)::INT, '%Y-%m-%d') published_at,
 (['Positive', 'Negative'])[page_id % 2 + 1] summary_impact, page_id % 10 / 10.0::DOUBLE summary_sentiment_score, 'ngân hàng' summary_sector, '["VCB","FPT"]' tickers
 FROM pages WHERE page_id % 5 <> 0 AND ({_SOURCE} IS NULL OR lower({_SOURCE}) = 'cafef')""")
def document_scan(s, d):
    """Articles of a store of JSON documents: the filters of the scan, ids and urls from older names, nested values as text."""
    path = scratch_path(s, "articles")
    _articles(s, d).write.json(path)
    return io.export_articles(io.read_documents(s, path)).drop("title", "category", "summary_json")


@query("SELECT count(*)::BIGINT articles, count(*) FILTER (page_id % 5 = 0)::BIGINT undated FROM pages")
def undated_articles(s, d):
    return io.undated(_articles(s, d))


@query("SELECT ts::DATE ingest_date, count(*)::BIGINT n, sum(event_id)::BIGINT ids FROM events GROUP BY 1")
def jsonl_append(s, d):
    """Two appends of JSON lines, a folder a day."""
    e = _t(s, d, "events").select("event_id", F.to_date("ts").alias("ingest_date"))
    path = scratch_path(s, "jsonl")
    for part in (0, 1):
        io.append_jsonl(e.where(F.col("event_id") % 2 == part).repartition("ingest_date"), path)
    return s.read.schema("event_id long, ingest_date date").json(path).groupBy("ingest_date").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


_STATUS = ("pending", "processing", "failed", "done")


def _queue(s, d):
    e = _t(s, d, "events")
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.lpad(F.col("event_id").cast("string"), 9, "0").alias("url_hash"), status.alias("status"), (F.col("user_id") % 5).cast("int").alias("retry_count"), F.col("ts").alias("created_at"), F.col("ts").alias("claimed_at"), F.col("event_type").alias("category"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("summary_json"))


_QUEUE = "(SELECT lpad(event_id::VARCHAR, 9, '0') url_hash, (['pending', 'processing', 'failed', 'done'])[event_id % 4 + 1] status, user_id % 5 retry_count, ts created_at, ts claimed_at, event_type category, CASE WHEN event_id % 3 = 0 THEN props END summary_json FROM events)"


@query(f"SELECT url_hash, created_at FROM {_QUEUE} WHERE status <> 'done' AND retry_count < 3 ORDER BY created_at DESC, url_hash LIMIT 50")
def queue_pending(s, d):
    return ingest.pending(_queue(s, d), 50).select("url_hash", "created_at")


@query(f"SELECT url_hash FROM {_QUEUE} WHERE retry_count < 3 AND (status IN ('pending', 'failed') OR (status = 'processing' AND claimed_at < TIMESTAMP '2024-01-20 11:45:00')) AND category = 'click'")
def queue_claimable(s, d):
    return ingest.claimable(_queue(s, d), NOW, "click").select("url_hash")


@query(f"SELECT status, retry_count, count(*)::BIGINT n FROM (SELECT CASE WHEN url_hash::INT % 10 = 1 THEN 'done' WHEN url_hash::INT % 10 = 2 THEN 'failed' ELSE status END status, (retry_count + (url_hash::INT % 10 = 2)::INT)::INT retry_count FROM {_QUEUE}) GROUP BY 1, 2")
def queue_outcome(s, d):
    q = _queue(s, d)
    n = F.col("url_hash").cast("int") % 10
    after = ingest.with_outcome(q, q.where(n.isin(1, 2)).select("url_hash", (n == 1).alias("ok")))
    return after.groupBy("status", "retry_count").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT status, claimed_at, count(*)::BIGINT n FROM (SELECT CASE WHEN url_hash::INT % 8 = 0 THEN 'processing' ELSE status END status, CASE WHEN url_hash::INT % 8 = 0 THEN TIMESTAMP '2024-01-20 12:00:00' ELSE date_trunc('day', claimed_at)::TIMESTAMP END claimed_at FROM {_QUEUE}) GROUP BY 1, 2")
def queue_claimed(s, d):
    q = _queue(s, d).withColumn("claimed_at", F.date_trunc("day", "claimed_at").cast("timestamp_ntz"))
    after = ingest.claimed(q, q.where(F.col("url_hash").cast("int") % 8 == 0), NOW)
    return after.groupBy("status", "claimed_at").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT {', '.join(f"count(*) FILTER (status = '{x}')::BIGINT {x}" for x in ('done', 'pending', 'processing', 'failed'))}, count(summary_json)::BIGINT scored, count(*) FILTER (status = 'processing' AND claimed_at > TIMESTAMP '2024-01-20 11:55:00')::BIGINT active FROM {_QUEUE}""")
def queue_progress(s, d):
    return ingest.progress(_queue(s, d), NOW)


@query(f"SELECT round(n * 240.0, 6)::DOUBLE per_hour, round(p / (n * 240.0), 9)::DOUBLE hours_left FROM (SELECT count(*) FILTER (summary_json IS NOT NULL AND url_hash::INT % 2 = 1) n, count(*) FILTER (status = 'pending') p FROM {_QUEUE})")
def queue_rate(s, d):
    q = _queue(s, d)
    before = q.withColumn("summary_json", F.when(F.col("url_hash").cast("int") % 2 == 0, F.col("summary_json")))
    return ingest.rate(ingest.progress(before, NOW), ingest.progress(q, NOW), 15).select(F.round("per_hour", 6).alias("per_hour"), F.round("hours_left", 9).alias("hours_left"))


@query(f"SELECT status, count(*)::BIGINT n FROM {_QUEUE} GROUP BY 1")
def queue_status_counts(s, d):
    return ingest.status_counts(_queue(s, d))


def _keyed(s, d):
    e = _t(s, d, "events").select(F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("user_id"), "event_id")
    return e.where("event_id % 2 = 0").dropna().dropDuplicates(["user_id"]), e.where("event_id % 2 = 1 OR event_id % 50 = 0")


@query("WITH o AS (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0 AND event_id % 50 <> 0), n AS (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 1) SELECT count(*) FILTER (user_id NOT IN (SELECT user_id FROM o))::BIGINT inserted, count(*) FILTER (user_id IN (SELECT user_id FROM o))::BIGINT updated, (SELECT count(*) FROM events WHERE event_id % 50 = 0)::BIGINT failed FROM n")
def upsert_counts(s, d):
    old, new = _keyed(s, d)
    return panel.upsert_counts(old, new, ["user_id"])


@query("SELECT user_id, max(event_id)::BIGINT event_id FROM (SELECT user_id, event_id FROM events WHERE event_id % 2 = 1 UNION ALL SELECT user_id, min(event_id) FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 1) GROUP BY 1) GROUP BY 1")
def upsert_repeated(s, d):
    """Rows of one key among the new ones: the last stays."""
    e = _t(s, d, "events").select("user_id", "event_id")
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    path, target = scratch_path(s, "old"), scratch_path(s, "new")
    old.write.parquet(path)
    io.upsert_parquet(s, e.where("event_id % 2 = 1"), path, ["user_id"], target, "event_id")
    return s.read.schema(old.schema).parquet(target)


@query("SELECT user_id, bool_or(event_id % 2 = 0) AS seen FROM events GROUP BY 1")
def insert_absent(s, d):
    e = _t(s, d, "events")
    old = e.where("event_id % 2 = 0").select("user_id", F.lit(True).alias("seen")).distinct()
    return panel.insert_absent(old, e.select("user_id", F.lit(False).alias("seen")), ["user_id"])


_FORMATS = "SELECT o_orderkey k, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y - %H:%M') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN 'soon ' || o_orderkey % 30 END published_at, o_orderdate::TIMESTAMP moment FROM orders"


def _dated(s, d):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy - HH:mm")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, F.concat(F.lit("soon "), F.col("o_orderkey") % 30))
    return _t(s, d, "orders").select(F.col("o_orderkey").alias("k"), text.alias("published_at"))


@query(f"WITH f AS ({_FORMATS}) SELECT count(*)::BIGINT total, count(published_at)::BIGINT texts, count(*) FILTER (k % 5 < 3)::BIGINT converted, count(*) FILTER (k % 5 = 3)::BIGINT unparseable, (SELECT string_agg(p, '|' ORDER BY p) FROM (SELECT DISTINCT published_at p FROM f WHERE k % 5 = 3 ORDER BY p LIMIT 20)) samples FROM f")
def migration_dry_run(s, d):
    return io.migration_counts(_dated(s, d)).withColumn("samples", F.array_join("samples", "|"))


@query(f"SELECT k, CASE WHEN k % 5 < 3 THEN CASE WHEN k % 5 = 0 THEN date_trunc('day', moment) WHEN k % 5 = 1 THEN date_trunc('minute', moment) ELSE moment END END published_at FROM ({_FORMATS})")
def migrated_dates(s, d):
    return io.migrate_dates(_dated(s, d))


_LINKS = "SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">[^<]*</a></li>', 1)) href, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1)) title FROM pages"


@query(f"SELECT page_id, 'https://h.example' || href url, trim(title) title, '' published_at FROM ({_LINKS}) WHERE NOT regexp_matches(href || title, '&')")
def list_items(s, d):
    """Items of list pages by selectors, a row each."""
    items = _t(s, d, "pages").select("page_id", F.explode(X.extract_items("html", "https://h.example/", items=("nav li",))).alias("i"))
    return items.select("page_id", "i.url", "i.title", "i.published_at").where(~F.concat("url", "title").contains("&"))


_CRAWL = "(SELECT event_type category, (event_id % 40)::INT page, CASE WHEN event_id % 9 <> 0 THEN ts END published_at, event_id FROM events WHERE event_id % 40 < 35 OR ts < TIMESTAMP '2024-01-15')"


def _crawl(s, d):
    e = _t(s, d, "events").where("event_id % 40 < 35 OR ts < TIMESTAMP_NTZ '2024-01-15'")
    return e.select(F.col("event_type").alias("category"), (F.col("event_id") % 40).cast("int").alias("page"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("published_at"), "event_id").where("page < 35 OR published_at IS NOT NULL")


_CRAWLED = f"(SELECT * FROM {_CRAWL} WHERE page < 35 OR published_at IS NOT NULL)"
CUTOFF = dt.datetime(2024, 1, 15)
_STOPS = f"SELECT category, max(page)::INT last_page, min(CASE WHEN o THEN page END)::INT stop FROM (SELECT category, page, bool_and(coalesce(published_at < TIMESTAMP '2024-01-15', false)) o FROM {_CRAWLED} GROUP BY 1, 2) GROUP BY 1"


@query(_STOPS)
def crawl_stops(s, d):
    return ingest.stop_pages(_crawl(s, d), CUTOFF)


@query(f"SELECT event_id FROM {_CRAWLED} c JOIN ({_STOPS}) USING (category) WHERE (published_at IS NULL OR published_at >= TIMESTAMP '2024-01-15') AND (stop IS NULL OR page <= stop)")
def crawl_items(s, d):
    return ingest.before_cutoff(_crawl(s, d), CUTOFF).select("event_id")


@query(f"SELECT category, CASE WHEN stop IS NOT NULL THEN 700 ELSE last_page END::BIGINT page FROM ({_STOPS})")
def crawl_cursor(s, d):
    """The cursor after a run, saved and loaded again."""
    path = scratch_path(s, "cursor")
    ingest.save_cursor(s, path, ingest.moved_cursor({}, ingest.stop_pages(_crawl(s, d), CUTOFF), 700))
    return s.createDataFrame(sorted(ingest.load_cursor(s, path).items()), "category string, page long")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*)::BIGINT row_count, round(sum(value), 4) sentiment_sum FROM events GROUP BY 1, 2 HAVING CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def stream_daily(s, d):
    """Daily sums of a stream, of the days that its watermark has passed."""
    events = ingest.stream_files(s, f"{d}/event[s].parquet", _t(s, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    got = ingest.gathered(ingest.daily_stream(events, "ts", "event_type", "value", "event_id"), scratch_path(s, "stream"), scratch_path(s, "stream-state"))
    return got.select(F.to_date("window.start").alias("day"), "event_type", "row_count", F.round("sentiment_sum", 4).alias("sentiment_sum"))


@query("SELECT count(*)::BIGINT n, sum(event_id)::BIGINT ids FROM events")
def stream_drain(s, d):
    """All that has landed, a micro-batch at a time."""
    path = scratch_path(s, "drained")
    stream = ingest.stream_files(s, f"{d}/event[s].parquet", _t(s, d, "events").schema)
    ingest.drain(stream.select("event_id"), lambda b, _: b.write.mode("append").parquet(path), scratch_path(s, "drain-state")).awaitTermination()
    return s.read.schema("event_id long").parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def _scorer(text: str) -> str:
    """Stands for a language model: answers within a fence, and fails on texts that end with a digit."""
    if text[-1:].isdigit():
        raise TimeoutError("no answer")
    return "Here: ```json\n" + json.dumps({"chars": len(text), "words": len(text.split())}) + "\n```"


@query("SELECT conv_id, turn, CASE WHEN NOT bad THEN length(t)::BIGINT END chars, CASE WHEN bad THEN 'TimeoutError: no answer' END summary_error FROM (SELECT conv_id, turn, substr(coalesce(text, ''), 1, 3000) t, regexp_matches(substr(coalesce(text, ''), 1, 3000), '[0-9]$') bad FROM conversations)")
def enrich_texts(s, d):
    done = io.enrich(_t(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("raw_text")), _scorer, backend="ollama")
    return done.select("conv_id", "turn", F.get_json_object("summary_json", "$.chars").try_cast("long").alias("chars"), "summary_error")


@query("SELECT status, retry_count, count(*)::BIGINT n FROM (SELECT CASE WHEN status IN ('pending', 'failed') AND retry_count < 3 THEN CASE WHEN regexp_matches(t, '[0-9]$') THEN 'failed' ELSE 'done' END ELSE status END status, (retry_count + (status IN ('pending', 'failed') AND retry_count < 3 AND regexp_matches(t, '[0-9]$'))::INT)::INT retry_count FROM (SELECT (['pending', 'failed', 'done'])[page_id % 3 + 1] status, page_id % 4 retry_count, 'page ' || page_id || CASE WHEN page_id % 2 = 0 THEN '.' ELSE '' END t FROM pages)) GROUP BY 1, 2")
def queue_worked_off(s, d):
    """A pass over the queue with a client that fails now and then."""
    n = F.col("page_id")
    q = _t(s, d, "pages").select(
        F.concat(F.lit("h"), n).alias("url_hash"), F.element_at(F.array(*map(F.lit, ("pending", "failed", "done"))), (n % 3 + 1).cast("int")).alias("status"), (n % 4).cast("int").alias("retry_count"),
        F.lit(NOW).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("claimed_at"), F.concat(F.lit("page "), n, F.when(n % 2 == 0, ".").otherwise("")).alias("raw_text"),
    )
    _, after = ingest.work_off(q, _scorer, NOW)
    return after.groupBy("status", "retry_count").agg(F.count(F.lit(1)).alias("n"))


def _quotes(ticker: str, start: dt.date, end: dt.date) -> pd.DataFrame:
    """Stands for a price source: a row a day from two days before the start on, under its own column names."""
    if ticker == "Brand#11":
        raise ConnectionError("unknown")
    days = pd.date_range(start - dt.timedelta(days=2), end + dt.timedelta(days=2))
    return pd.DataFrame({"Trading_Date": days.strftime("%Y-%m-%d"), "Close Price": [str(int(ticker.split("#")[1]) * 10 + i) for i in range(len(days))], "VOL": range(len(days))})


def _second(ticker: str, start: dt.date, end: dt.date) -> pd.DataFrame:
    return pd.DataFrame({"time": [start], "close": [7.0]})


@query("WITH b AS (SELECT DISTINCT p_brand ticker FROM part) SELECT DATE '2024-01-03' + i::INT trade_date, ticker, (substr(ticker, 7)::INT * 10 + i + 2)::DOUBLE AS close, (i + 2)::DOUBLE volume FROM b, range(0, 4) r(i) WHERE ticker <> 'Brand#11' UNION ALL SELECT DATE '2024-01-03', ticker, 7.0, NULL FROM b WHERE ticker = 'Brand#11'")
def price_source(s, d):
    """Prices behind clients: the second is asked where the first fails; days outside the bounds go."""
    tickers = [r.p_brand for r in _t(s, d, "part").select("p_brand").distinct().collect()]  # 25 brands
    got = io.fetch_prices(s, tickers + tickers[:3], [_quotes, _second], dt.date(2024, 1, 3), dt.date(2024, 1, 6), sleep=lambda _: None)
    return got.select("trade_date", "ticker", "close", "volume")


def _page(url: str) -> str:
    if "/de/" in url:
        raise OSError("gone")
    return url.upper()


@query("SELECT page_id, CASE WHEN url NOT LIKE '%/de/%' THEN upper(url) END html, CASE WHEN url LIKE '%/de/%' THEN 'OSError: gone' END fetch_error FROM pages")
def page_source(s, d):
    return io.fetch_pages(_t(s, d, "pages").select("page_id", "url"), _page, pause=lambda _: 0.0).select("page_id", "html", "fetch_error")


@query("SELECT count(*)::BIGINT articles, count(*)::BIGINT - 1 mapped, 1::BIGINT unmapped, min(ts)::DATE first_date, max(ts)::DATE last_date FROM events")
def session_summary(s, d):
    e = _t(s, d, "events")
    last = e.agg(F.max("event_id").alias("last"))
    on = e.crossJoin(last).select((F.col("event_id") != F.col("last")).alias("is_mapped"), F.to_date("ts").alias("trade_date"))  # last: one row
    return quality.session_summary(on)
