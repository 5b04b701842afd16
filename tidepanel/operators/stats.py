"""Time-series statistics. Correlations, lags and multiplicity are expressions; ADF, KPSS, VAR order, Ljung-Box and Granger
run in numpy once for each series or pair, in parallel over the pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import special
from ..session import cut, importable, pearson, ratio
from . import panel


def _is_constant(x: np.ndarray) -> bool:
    return len(np.unique(x)) <= 1 or x.std() <= schemas.CONSTANT_SIGMA


def _fit(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return beta, y - x @ beta


def _lagged(x: np.ndarray, lags: int, start: int) -> np.ndarray:
    """Columns x[t-1] .. x[t-lags] for t from start."""
    return np.stack([x[start - k : len(x) - k] for k in range(1, lags + 1)], 1) if lags else np.empty((len(x) - start, 0))


def adf(x: np.ndarray) -> tuple[float, int, int]:
    """Statistic, lags by AIC on a common sample, observations: constant, no trend."""
    dx, n = np.diff(x), len(x)
    most = max(0, min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))

    def design(p: int, start: int):
        return dx[start:], np.column_stack([x[start:-1], _lagged(dx, p, start), np.ones(len(dx) - start)])

    def aic(p: int) -> float:
        y, d = design(p, most)
        e = _fit(y, d)[1]
        return len(y) * np.log(e @ e / len(y)) + 2 * d.shape[1]

    best = min(range(most + 1), key=aic)
    y, d = design(best, best)
    beta, e = _fit(y, d)
    sigma2 = e @ e / (len(y) - d.shape[1])
    return float(beta[0] / np.sqrt(sigma2 * np.linalg.inv(d.T @ d)[0, 0])), best, len(y)


def kpss(x: np.ndarray) -> float:
    """Level statistic with the automatic Bartlett bandwidth."""
    n, e = len(x), x - x.mean()
    cov = lambda k: e[k:] @ e[: n - k] / (n / 2)
    s0, s1 = e @ e / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        s0 += cov(i)
        s1 += i * cov(i)
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    lrv = (e @ e + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[: n - i]) for i in range(1, lags + 1))) / n
    return float((np.cumsum(e) ** 2).sum() / (n * n * lrv))


STATIONARITY = "variable string, n_obs long, missing_count long, missing_ratio double, adf_statistic double, adf_pvalue double, adf_used_lag int, adf_nobs int, kpss_statistic double, kpss_pvalue double, kpss_stationary_5pct boolean, is_stationary_5pct boolean, status string"


def stationarity(long: DataFrame, series: str = "series", time: str = "t", value: str = "value", least: int = schemas.MIN_OBSERVATIONS) -> DataFrame:
    """ADF and KPSS of each series; a row for every series, whatever its state."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = pdf["value"].dropna().to_numpy(float)
        row = {"variable": pdf["series"].iloc[0], "n_obs": len(x), "missing_count": len(pdf) - len(x), "missing_ratio": 1 - len(x) / len(pdf), "status": "ok"}
        if len(x) < least:
            row["status"] = "insufficient_observations"
        elif _is_constant(x):
            row["status"] = "constant_series"
        else:
            try:
                stat, lag, n = adf(x)
                eta = kpss(x)
                p, q = special.adf_pvalue(stat), special.kpss_pvalue(eta)
                row |= {"adf_statistic": stat, "adf_pvalue": p, "adf_used_lag": lag, "adf_nobs": n, "kpss_statistic": eta, "kpss_pvalue": q, "kpss_stationary_5pct": q > 0.05, "is_stationary_5pct": p < 0.05}
            except (np.linalg.LinAlgError, ValueError, ZeroDivisionError) as e:
                row["status"] = f"error: {e}"
        names = [f.split()[0] for f in STATIONARITY.split(", ")]
        return pd.DataFrame([[row.get(k) for k in names]], columns=names)

    importable(long.sparkSession)
    rows = long.select(F.col(series).alias("series"), F.col(time).alias("t"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("series").applyInPandas(run, STATIONARITY)


#: Blocks of series that a day's rows are dealt to when every series meets every other.
BLOCKS = 4


def meet(a: DataFrame, b: DataFrame, series: str, blocks: int = BLOCKS) -> DataFrame:
    """Rows of a and b of equal t. All series of a day would meet in one task: those of a are dealt to blocks by their name,
    and each block has its own copy of b's rows."""
    a = a.withColumn("_block", F.pmod(F.xxhash64(series), F.lit(blocks)))
    b = b.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return a.join(b, ["_block", "t"]).drop("_block")


def pairs(long: DataFrame, series: str, time: str, value: str, targets: DataFrame | None = None, include_self: bool = False) -> DataFrame:
    """source, target, t, x, y: an equi-join of the panel with itself on time."""
    a = long.select(F.col(series).alias("source"), F.col(time).alias("t"), F.col(value).cast("double").alias("x"))
    b = (targets if targets is not None else long).select(F.col(series).alias("target"), F.col(time).alias("t"), F.col(value).cast("double").alias("y"))
    out = meet(a, b, "source").select("source", "target", "t", "x", "y")
    return out if include_self else out.where("source <> target")


def granger_f(y: np.ndarray, x: np.ndarray, lag: int) -> tuple[float, float]:
    """F statistic and p of `lag` lags of x in the regression of y on its own."""
    t = y[lag:]
    own = np.column_stack([np.ones(len(t)), _lagged(y, lag, lag)])
    both = np.column_stack([own, _lagged(x, lag, lag)])
    r, u = _fit(t, own)[1], _fit(t, both)[1]
    df = len(y) - 3 * lag - 1
    f = ((r @ r - u @ u) / lag) / (u @ u / df)
    return float(f), special.f_sf(f, lag, df)


def var_order(z: np.ndarray, most: int) -> int:
    """Order of the least AIC on a common sample; 0 counts as 1."""
    k = z.shape[1]

    def aic(p: int) -> float:
        t = z[most:]
        d = np.column_stack([np.ones(len(t)), *[_lagged(z[:, j], p, most) for j in range(k)]])
        e = t - d @ np.linalg.lstsq(d, t, rcond=None)[0]
        return np.linalg.slogdet(e.T @ e / len(t))[1] + 2 / len(t) * (k * k * p + k)

    return max(1, min(range(most + 1), key=aic))


def ljung_box(e: np.ndarray) -> float:
    n, e = len(e), e - e.mean()
    h = min(10, max(1, n // 5))
    r = np.array([e[k:] @ e[: n - k] for k in range(1, h + 1)]) / (e @ e)
    return special.chi2_sf(float(n * (n + 2) * (r**2 / (n - np.arange(1, h + 1))).sum()), h)


GRANGER = "source string, target string, best_lag int, n_obs long, f_stat double, p_value double, lag_selection_method string, ljungbox_pvalue double, ljungbox_white_noise boolean, status string, error_message string, all_lags array<struct<lag:int,f_stat:double,p_value:double>>"


def granger(paired: DataFrame, max_lag: int = schemas.MAX_LAG, least: int = schemas.MIN_OBSERVATIONS) -> DataFrame:
    """A row for each pair (source, target, t, x, y): lag by VAR AIC, its F test, white noise of residuals, all lags. Rows
    with a null on either side go first; lags are positions among those left."""
    if max_lag < 1 or least < 10:
        raise ValueError("max_lag must be 1 or more and least 10 or more")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        clean = pdf.sort_values("t")[["y", "x"]].dropna()
        y, x = clean["y"].to_numpy(float), clean["x"].to_numpy(float)
        n = len(y)
        row = {"source": pdf["source"].iloc[0], "target": pdf["target"].iloc[0], "n_obs": n, "lag_selection_method": "var_aic", "status": "ok"}
        lags = min(max_lag, max(0, (n - 3) // 3))
        if n < least or lags < 1:
            row["status"] = "insufficient_observations"
        elif _is_constant(x) or _is_constant(y):
            row["status"] = "constant_series"
        else:
            try:
                tests = [(k, *granger_f(y, x, k)) for k in range(1, lags + 1)]
                z = np.column_stack([y, x])
                try:
                    best = var_order(z, lags)
                except np.linalg.LinAlgError:
                    best = 1
                d = np.column_stack([np.ones(n - best), *[_lagged(z[:, j], best, best) for j in range(2)]])
                e = z[best:] - d @ np.linalg.lstsq(d, z[best:], rcond=None)[0]
                white = min(ljung_box(e[:, j]) for j in range(2))
                row |= {"best_lag": best, "f_stat": tests[best - 1][1], "p_value": tests[best - 1][2], "ljungbox_pvalue": white, "ljungbox_white_noise": white > 0.05}
                row["all_lags"] = [{"lag": k, "f_stat": f, "p_value": p} for k, f, p in tests]
            except (np.linalg.LinAlgError, ValueError, ZeroDivisionError) as e:
                row |= {"status": "error", "error_message": str(e)}
        names = ["source", "target", "best_lag", "n_obs", "f_stat", "p_value", "lag_selection_method", "ljungbox_pvalue", "ljungbox_white_noise", "status", "error_message", "all_lags"]
        return pd.DataFrame([[row.get(k) for k in names]], columns=names)

    importable(paired.sparkSession)
    return paired.groupBy("source", "target").applyInPandas(run, GRANGER)


#: Ranges of p that are ranked apart.
P_RANGES = 64


def adjusted(df: DataFrame, p: str) -> DataFrame:
    """_p, _m, _q: the Benjamini-Hochberg value of each different p of all rows. Equal p share a value, so p are counted first, and
    the counts written; they are then ranked within ranges of p, of which the driver holds sizes and least values, so that
    no task has all p."""
    tests = cut(df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n")))
    cuts = tests.agg(F.percentile_approx("_p", [i / P_RANGES for i in range(1, P_RANGES)], 10_000).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    inside = F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_p"))) if cuts else F.lit(0)
    tests = tests.withColumn("_range", inside)
    sizes = {r["_range"]: r.n for r in tests.groupBy("_range").agg(F.sum("_n").alias("n")).collect()}  # P_RANGES rows at most
    m, before = sum(sizes.values()), {}
    for k in sorted(sizes):
        before[k] = sum(n for j, n in sizes.items() if j < k)
    known = lambda of: F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col("_range")]
    within = W.partitionBy("_range").orderBy("_p")
    upto = F.sum("_n").over(within) + (known(before) if before else F.lit(0))
    ranked = tests.withColumn("_v", F.col("_p") * m / upto)
    low, later = {r["_range"]: r.v for r in ranked.groupBy("_range").agg(F.min("_v").alias("v")).collect()}, {}
    for k in low:
        later[k] = min((v for j, v in low.items() if j > k), default=1.0)
    own = F.min("_v").over(W.partitionBy("_range").orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, 0))
    return ranked.select("_p", F.lit(m).alias("_m"), F.least(own, known(later) if later else F.lit(1.0), F.lit(1.0)).alias("_q"))


def multiplicity(df: DataFrame, p: str = "p_value", alpha: float = schemas.ALPHA, run: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg and Bonferroni over the rows that have a p value, all together or within each run; flags and edge
    weight. A run is ranked in one task; without runs no task has all rows, and df is written first: it is read twice, and sums
    of doubles that are computed again in another order may differ in their last bits, so that p wouldn't be found."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    known = F.col(p).isNotNull()
    if run:
        part = W.partitionBy(*run, known)
        rank = F.sum(F.lit(1)).over(part.orderBy(p))  # of the last row of equal p
        df = df.withColumns({"_m": F.count(p).over(part), "_v": F.col(p) / rank})
        q = F.min(F.col("_v") * F.col("_m")).over(part.orderBy(F.desc(p)))
        out = df.withColumn("_q", F.least(q, F.lit(1.0))).drop("_v")
    else:
        df = cut(df)
        out = df.join(adjusted(df, p).withColumnRenamed("_p", "_of"), F.col(p) == F.col("_of"), "left").drop("_of")
    out = out.withColumns({"p_value_fdr_bh": F.when(known, F.col("_q")), "p_value_bonferroni": F.when(known, F.least(F.col(p) * F.col("_m"), F.lit(1.0)))})
    return out.drop("_m", "_q").withColumns(
        {
            "significant_raw_05": F.coalesce(F.col(p) < alpha, F.lit(False)),
            "significant_fdr_05": F.coalesce(F.col("p_value_fdr_bh") <= alpha, F.lit(False)),
            "significant_bonferroni_05": F.coalesce(F.col("p_value_bonferroni") <= alpha, F.lit(False)),
            "edge_weight": edge_weight("p_value_fdr_bh"),
        }
    )


def edge_weight(p: str):
    return -F.log10(F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(schemas.P_FLOOR)))


@F.pandas_udf(T.DoubleType())
def t_pvalue(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation of n pairs, whole columns at a time; null where either is null or n is below 3."""
    r, n = r.to_numpy(float, na_value=np.nan), n.to_numpy(float, na_value=np.nan)
    ok = ~np.isnan(r) & (n >= 3)
    out = np.full(len(r), np.nan)
    near = ok & (np.abs(r) < 1)
    out[ok & ~near] = 0.0
    df = n[near] - 2
    out[near] = special.t_sf2_many(r[near] * np.sqrt(df / ((1 - r[near]) * (1 + r[near]))), df)
    return pd.Series(out).astype("Float64").mask(~ok)


def lead_lag(sentiment: DataFrame, returns: DataFrame, series: str, time: str, value: str, max_lag: int = schemas.MAX_LAG, least: int = schemas.LEAD_LAG_MIN_OBSERVATIONS) -> DataFrame:
    """s, r, lag, corr, n_obs: correlation of sentiment today with the return `lag` rows of the full calendar later."""
    if max_lag < 0:
        raise ValueError("max_lag must be 0 or more")
    w = W.partitionBy(series).orderBy(time)
    ahead = returns.select(F.col(series).alias("r"), F.col(time).alias("t"), F.array(*[F.lead(value, k).over(w).cast("double") for k in range(max_lag + 1)]).alias("ahead"))
    leads = ahead.select("r", "t", F.posexplode("ahead").alias("lag", "y"))
    s = sentiment.select(F.col(series).alias("s"), F.col(time).alias("t"), F.col(value).cast("double").alias("x"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    got = meet(s, leads, "s").groupBy("s", "r", "lag").agg(pearson("x", "y").alias("corr"), F.count_if(both).alias("n_obs"))
    return got.withColumn("corr", F.when(F.col("n_obs") >= least, F.col("corr")))


def best_lag(tested: DataFrame) -> DataFrame:
    """Lag of the largest |corr| of each pair, the smallest among equals; lag 0 where none is valid."""
    w = W.partitionBy("s", "r").orderBy(F.col("corr").isNotNull().desc(), F.abs("corr").desc_nulls_last(), F.col("lag"))
    return tested.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumnRenamed("lag", "best_lag")


def significant(tested: DataFrame, alpha: float = schemas.ALPHA) -> DataFrame:
    """tested with pvalue and significant."""
    return tested.withColumn("pvalue", t_pvalue("corr", "n_obs")).withColumn("significant", F.coalesce(F.col("pvalue") < alpha, F.lit(False)))


def lead_relations(tested: DataFrame, k: int = 10) -> DataFrame:
    """The k significant relations at lag 1 or more of the largest |corr|; ties by names and lag."""
    return tested.where("lag >= 1 AND significant AND corr IS NOT NULL").orderBy(F.abs("corr").desc(), "s", "r", "lag").limit(k)


def correlation_matrix(long: DataFrame, series: str, time: str, value: str, listwise: bool = True) -> DataFrame:
    """a, b, corr for all ordered pairs; listwise keeps only times at which every series has a value. Each pair is computed
    once and mirrored."""
    rows = long.select(F.col(series).alias("series"), F.col(time).alias("t"), F.col(value).cast("double").alias("v"))
    if listwise:
        n = rows.select("series").distinct().agg(F.count(F.lit(1)).alias("n"))
        full = rows.groupBy("t").agg(F.count("v").alias("have")).crossJoin(n).where("have = n").select("t")  # n: one row
        rows = rows.join(full, "t")
    left, right = rows.select(F.col("series").alias("a"), "t", F.col("v").alias("x")), rows.select(F.col("series").alias("b"), "t", F.col("v").alias("y"))
    half = meet(left, right, "a").where("a <= b").groupBy("a", "b").agg(pearson("x", "y").alias("corr"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(F.explode(both).alias("p"), "corr").select("p.a", "p.b", "corr")


def top_pairs(matrix: DataFrame, k: int = 10) -> DataFrame:
    """The k unordered pairs of the largest |corr|; ties by names."""
    return matrix.where("a < b AND corr IS NOT NULL").orderBy(F.abs("corr").desc(), "a", "b").limit(k)


def series_of(wide: DataFrame, prefix: str, time: str = "trade_date") -> DataFrame:
    """variable, series, t, value: the columns of a wide panel that begin with the prefix, one row each."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.select(time, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([time], columns, "variable", "value")
    return long.select("variable", F.substring("variable", len(prefix) + 1, 1 << 30).alias("series"), F.col(time).alias("t"), "value")


MODES = {"sent2sent": ("sent_", "sent_"), "sent2ret": ("sent_", "ret_")}


def causality(wide: DataFrame, mode: str = "sent2sent", include_self: bool = False, fill: bool = True, start=None, end=None, max_lag: int = schemas.MAX_LAG, least: int = schemas.MIN_OBSERVATIONS, alpha: float = schemas.ALPHA) -> DataFrame:
    """Granger tests of all pairs of a merged wide panel (trade_date, ret_*, sent_*), corrected for their number. Missing
    sentiment counts as 0 unless fill is off. The mode chooses what stands for targets and is a column of the result."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {sorted(MODES)}")
    rows = panel.drop_nulls(panel.between_dates(wide, "trade_date", start, end), "trade_date")
    if fill:
        rows, _ = panel.fill_missing(rows, [c for c in rows.columns if c.startswith("sent_")])
    sources, targets = (series_of(rows, prefix) for prefix in MODES[mode])
    tested = granger(pairs(sources, "series", "t", "value", targets, include_self), max_lag, least)
    named = tested.withColumns({"mode": F.lit(mode), "source_variable": F.concat(F.lit(MODES[mode][0]), "source"), "target_variable": F.concat(F.lit(MODES[mode][1]), "target"), "alpha": F.lit(alpha)})
    return multiplicity(named, alpha=alpha)


def corr_threshold(matrix: DataFrame, fixed: float | None = None, q: float = 0.75) -> DataFrame:
    """One row: the fixed threshold, or the exact percentile of |corr| over unordered pairs."""
    if fixed is not None:
        if not 0 <= fixed <= 1:
            raise ValueError("a threshold lies between 0 and 1")
        return matrix.sparkSession.range(1).select(F.lit(fixed).alias("threshold"))
    return matrix.where("a < b").agg(F.percentile(F.abs("corr"), F.lit(q)).alias("threshold"))


def granger_lag1(paired: DataFrame) -> DataFrame:
    """F of lag 1 from three correlations, all in one aggregation."""
    w = W.partitionBy("source", "target").orderBy("t")
    rows = paired.where("x is not null and y is not null").withColumns({"y1": F.lag("y").over(w), "x1": F.lag("x").over(w)}).where("y1 is not null")
    got = rows.groupBy("source", "target").agg(pearson("y", "y1").alias("a"), pearson("y", "x1").alias("b"), pearson("y1", "x1").alias("r"), (F.count(F.lit(1)) + 1).alias("n_obs"))
    a, b, r = F.col("a"), F.col("b"), F.col("r")
    full = ratio(a * a + b * b - 2 * a * b * r, 1 - r * r)
    return got.select("source", "target", "n_obs", (ratio(full - a * a, 1 - full) * (F.col("n_obs") - 4)).alias("f_stat"))
