"""The statistics again, as SQL for DuckDB and by another way than numpy: least squares by sweeping cross products, tail
probabilities by Simpson's rule. Used only to check the queries."""

from __future__ import annotations


def swept(first: str, keys: str, order: str, steps: int, name: str) -> tuple[list[str], str]:
    """Tables of a matrix (keys, i, j, v) whose variables are swept one after another. first: the matrix; order: the variable
    of step {k}, null where a matrix has no such step."""
    ks = [k.strip() for k in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    out = [f"{name}0 AS ({first})"]
    for k in range(1, steps + 1):
        v = order.format(k=k)
        out.append(
            f"{name}{k} AS (SELECT {', '.join('a.' + x for x in ks)}, a.i, a.j, CASE WHEN o.q IS NULL THEN a.v WHEN a.i = o.q AND a.j = o.q THEN -1 / d.v WHEN a.i = o.q OR a.j = o.q THEN a.v / d.v ELSE a.v - b.v * c.v / d.v END v"
            f" FROM {name}{k - 1} a JOIN (SELECT DISTINCT {keys}, {v} q FROM {name}0) o ON {on('a', 'o')} LEFT JOIN {name}{k - 1} b ON {on('b', 'a')} AND b.i = a.i AND b.j = o.q LEFT JOIN {name}{k - 1} c ON {on('c', 'a')} AND c.i = o.q AND c.j = a.j LEFT JOIN {name}{k - 1} d ON {on('d', 'a')} AND d.i = o.q AND d.j = o.q)"
        )
    return out, f"{name}{steps}"


def f_tail(f: str, d1: str, d2: str) -> str:
    """Upper tail of F: the incomplete beta function in angles, where its integrand has no pole."""
    low, width = f"atan(sqrt({d1} * ({f}) / {d2}))", f"40 / sqrt({d2})"
    a, b = f"{d2} / 2.0", f"{d1} / 2.0"
    value = f"cos(w.t) ** ({d2} - 1) * sin(w.t) ** ({d1} - 1) * (CASE WHEN w.k IN (0, 4000) THEN 1 WHEN w.k % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(SELECT 2 * exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * sum({value}) * any_value(w.h) / 3 FROM (SELECT k, (least({width}, pi() / 2 - {low})) / 4000 h, {low} + k * (least({width}, pi() / 2 - {low})) / 4000 t FROM range(0, 4001) r(k)) w)"


def t_tail(r: str, n: str) -> str:
    """Two-sided p of a correlation r of n pairs."""
    return f_tail(f"({r}) * ({r}) * ({n} - 2) / ((1 - ({r})) * (1 + ({r})))", "1", f"({n} - 2)")


def normal_below(z: str) -> str:
    value = "exp(-w.t * w.t / 2) * (CASE WHEN w.k IN (0, 2000) THEN 1 WHEN w.k % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(SELECT sum({value}) * (12 / 2000.0) / 3 / sqrt(2 * pi()) FROM (SELECT k, ({z}) - 12 + k * 12 / 2000.0 t FROM range(0, 2001) r(k)) w)"


def granger(pairs: str, most: int = 5) -> str:
    """pairs: source, target, t, x, y. Gives source, target, n, lag, f, p of all lags, best (lag by the information
    criterion), white (Ljung-Box p, h = 10 lags, the lesser of both residuals). Pairs need 60 rows or more, and no constant."""
    both = "source, target, d"
    parts = [
        f"p0 AS (SELECT * FROM ({pairs}) WHERE x IS NOT NULL AND y IS NOT NULL)",
        "p AS (SELECT source, target, row_number() OVER w i, x - avg(x) OVER q x, y - avg(y) OVER q y, count(*) OVER q n FROM p0 WINDOW w AS (PARTITION BY source, target ORDER BY t), q AS (PARTITION BY source, target))",
        f"l AS (SELECT a.source, a.target, a.i, a.n, k, b.x, b.y FROM p a, range(0, {most + 1}) r(k) JOIN p b ON a.source = b.source AND a.target = b.target AND b.i = a.i - k)",
        # variables: 0 and 1 are y and x now, 2k and 2k + 1 their lags
        "u AS (SELECT source, target, i, n, 2 * k q, y v FROM l UNION ALL SELECT source, target, i, n, 2 * k + 1, x FROM l)",
        # designs: d lags and their own sample, or 0 for all lags and the sample common to all orders
        f"m AS (SELECT a.source, a.target, d, a.q i, b.q j, sum(a.v * b.v) - sum(a.v) * sum(b.v) / count(*) v FROM u a JOIN u b ON a.source = b.source AND a.target = b.target AND a.i = b.i JOIN range(0, {most + 1}) s(d) ON a.i > CASE WHEN d = 0 THEN {most} ELSE d END AND a.q < 2 * CASE WHEN d = 0 THEN {most} ELSE d END + 2 AND b.q < 2 * CASE WHEN d = 0 THEN {most} ELSE d END + 2 GROUP BY 1, 2, 3, 4, 5)",
    ]
    chain, last = swept(f"SELECT {both}, i, j, v FROM m", both, f"CASE WHEN d = 0 THEN {{k}} + 1 WHEN {{k}} <= d THEN 2 * {{k}} WHEN {{k}} <= 2 * d THEN 2 * ({{k}} - d) + 1 END", 2 * most, "e")
    parts += chain
    own = " UNION ALL ".join(f"SELECT source, target, d, v FROM e{k} WHERE d = {k} AND i = 0 AND j = 0" for k in range(1, most + 1))
    orders = " UNION ALL ".join(f"SELECT source, target, {k} k, max(v) FILTER (i = 0 AND j = 0) a, max(v) FILTER (i = 0 AND j = 1) b, max(v) FILTER (i = 1 AND j = 1) c FROM e{2 * k} WHERE d = 0 GROUP BY 1, 2" for k in range(most + 1))
    parts += [
        "n AS (SELECT source, target, max(n) n FROM p GROUP BY 1, 2)",
        f"f AS (SELECT source, target, d lag, n, (o.v - z.v) / d / (z.v / (n - 3 * d - 1)) f FROM ({own}) o JOIN (SELECT * FROM {last} WHERE i = 0 AND j = 0) z USING (source, target, d) JOIN n USING (source, target))",
        f"k AS (SELECT source, target, greatest(1, arg_min(k, ln((a * c - b * b) / (n - {most}) ** 2) + 2.0 / (n - {most}) * (4 * k + 2)))::INT best FROM ({orders}) JOIN n USING (source, target) GROUP BY 1, 2)",
        f"z AS (SELECT u.source, u.target, u.i, c.j w, max(y.v) - sum(c.v * u.v) e FROM u JOIN k USING (source, target) JOIN {last} c ON c.source = u.source AND c.target = u.target AND c.d = k.best AND c.i = u.q AND c.j IN (0, 1) AND u.q BETWEEN 2 AND 2 * k.best + 1 JOIN u y ON y.source = u.source AND y.target = u.target AND y.i = u.i AND y.q = c.j WHERE u.i > k.best GROUP BY 1, 2, 3, 4)",
        "c AS (SELECT source, target, w, i, e - avg(e) OVER (PARTITION BY source, target, w) e, count(*) OVER (PARTITION BY source, target, w) n FROM z)",
        "a AS (SELECT x.source, x.target, x.w, h, any_value(x.n) n, sum(x.e * y.e) g FROM c x, range(0, 11) r(h) JOIN c y ON x.source = y.source AND x.target = y.target AND x.w = y.w AND y.i = x.i - h GROUP BY 1, 2, 3, 4)",
        "q AS (SELECT source, target, w, any_value(n) * (any_value(n) + 2) * sum((g / g0) ** 2 / (n - h)) q FROM a JOIN (SELECT source, target, w, g g0 FROM a WHERE h = 0) USING (source, target, w) WHERE h > 0 GROUP BY 1, 2, 3)",
        f"b AS (SELECT source, target, min(exp(-q / 2) * ({' + '.join(f'(q / 2) ** {i} / {f}' for i, f in enumerate((1, 1, 2, 6, 24)))})) white FROM q GROUP BY 1, 2)",
    ]
    return f"WITH {', '.join(parts)} SELECT f.source, f.target, f.n, lag, f.f, {f_tail('f.f', 'f.lag', '(f.n - 3 * f.lag - 1)')} p, best, white FROM f JOIN k USING (source, target) JOIN b USING (source, target)"


def unit_root(series: str, most: int = 30) -> str:
    """series: s, t, v. Gives s, n, statistic, lags, used, p of the unit root test with a constant, lags by the information
    criterion on a common sample; series of at most 3,900 rows."""
    small, large = ((2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368))
    poly = lambda c: " + ".join(f"({x}) * tau ** {i}" for i, x in enumerate(c))
    at_most = lambda n: f"least(ceil(12 * ({n} / 100.0) ** 0.25), {n} // 2 - 2)::INT"
    top = at_most("n")
    parts = [
        f"x AS (SELECT s, row_number() OVER w i, v - avg(v) OVER (PARTITION BY s) v, v - lag(v) OVER w d, count(*) OVER (PARTITION BY s) n FROM ({series}) WHERE v IS NOT NULL WINDOW w AS (PARTITION BY s ORDER BY t))",
        # variables: 0 the change, 1 the level before it, 1 + k the change k rows before; i is the place of the change
        f"u AS (SELECT s, i - 1 i, n, 0 q, d v FROM x WHERE i > 1 UNION ALL SELECT s, i, n, 1, v FROM x WHERE i < n UNION ALL SELECT s, i - 1 + k, n, 1 + k, d FROM x, range(1, {most + 1}) r(k) WHERE i > 1 AND i - 1 + k < n)",
        f"m AS (SELECT a.s, a.q i, b.q j, sum(a.v * b.v) - sum(a.v) * sum(b.v) / count(*) v FROM u a JOIN u b ON a.s = b.s AND a.i = b.i WHERE a.i > {at_most('a.n')} AND a.q <= 1 + {at_most('a.n')} AND b.q <= 1 + {at_most('a.n')} GROUP BY 1, 2, 3)",
    ]
    chain, _ = swept("SELECT s, i, j, v FROM m", "s", f"CASE WHEN {{k}} <= (SELECT max({top}) FROM x y WHERE y.s = e0.s) THEN {{k}} + 1 END", most, "e")
    parts += chain
    sums = " UNION ALL ".join(f"SELECT s, {k} k, max(v) FILTER (i = 0 AND j = 0) - max(v) FILTER (i = 0 AND j = 1) ** 2 / max(v) FILTER (i = 1 AND j = 1) e FROM e{k} GROUP BY 1" for k in range(most + 1))
    parts += [
        "n AS (SELECT s, max(n) n FROM x GROUP BY 1)",
        f"b AS (SELECT s, any_value(n) n, arg_min(k, (n - 1 - {top}) * ln(e / (n - 1 - {top})) + 2 * (k + 2))::INT lags FROM ({sums}) JOIN n USING (s) WHERE k <= {top} GROUP BY 1)",
        "m2 AS (SELECT a.s, a.q i, c.q j, sum(a.v * c.v) - sum(a.v) * sum(c.v) / count(*) v, count(*) used FROM u a JOIN b USING (s) JOIN u c ON a.s = c.s AND a.i = c.i WHERE a.i > b.lags AND a.q <= 1 + b.lags AND c.q <= 1 + b.lags GROUP BY 1, 2, 3)",
    ]
    chain, last = swept("SELECT s, i, j, v FROM m2", "s", "CASE WHEN {k} <= (SELECT lags FROM b y WHERE y.s = g0.s) THEN {k} + 1 END", most, "g")
    parts += chain
    parts += [
        f"w AS (SELECT s, max(v) FILTER (i = 0 AND j = 0) a, max(v) FILTER (i = 0 AND j = 1) b, max(v) FILTER (i = 1 AND j = 1) c FROM {last} GROUP BY 1)",
        "t AS (SELECT s, n, lags, n - 1 - lags used, (w.b / c) / sqrt((a - w.b * w.b / c) / (n - 1 - lags - lags - 2) / c) tau FROM w JOIN b USING (s))",
    ]
    return f"WITH {', '.join(parts)} SELECT s, n, tau AS statistic, lags, used, CASE WHEN tau > 2.74 THEN 1.0 WHEN tau < -18.83 THEN 0.0 ELSE {normal_below(f'CASE WHEN tau <= -1.61 THEN {poly(small)} ELSE {poly(large)} END')} END p FROM t"


def level(series: str, most: int = 400) -> str:
    """series: s, t, v. Gives s, statistic, p of the level stationarity test with the automatic bandwidth."""
    p = "CASE WHEN eta <= 0.347 THEN 0.1 WHEN eta <= 0.463 THEN 0.1 - 0.05 * (eta - 0.347) / 0.116 WHEN eta <= 0.574 THEN 0.05 - 0.025 * (eta - 0.463) / 0.111 WHEN eta <= 0.739 THEN 0.025 - 0.015 * (eta - 0.574) / 0.165 ELSE 0.01 END"
    return f"""WITH x AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY t) i, v - avg(v) OVER (PARTITION BY s) e, count(*) OVER (PARTITION BY s) n FROM ({series}) WHERE v IS NOT NULL),
 c AS (SELECT a.s, k, any_value(a.n) n, sum(a.e * b.e) g FROM x a, range(0, {most}) r(k) JOIN x b ON a.s = b.s AND b.i = a.i - k GROUP BY 1, 2),
 b AS (SELECT s, any_value(n) n, sum(CASE WHEN k = 0 THEN g / n ELSE g * 2 / n END) s0, sum(k * g * 2 / n) s1 FROM c WHERE k <= floor(n ** (2 / 9.0)) GROUP BY 1),
 h AS (SELECT s, n, least(floor(1.1447 * ((s1 / s0) ** 2) ** (1 / 3.0) * n ** (1 / 3.0)), n - 1)::INT lags FROM b),
 r AS (SELECT s, any_value(h.n) n, sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (lags + 1.0)) * g END) / any_value(h.n) lrv FROM c JOIN h USING (s) WHERE k <= lags GROUP BY 1),
 y AS (SELECT s, sum(z * z) zz FROM (SELECT s, sum(e) OVER (PARTITION BY s ORDER BY i) z FROM x) GROUP BY 1),
 q AS (SELECT s, zz / (n * n * lrv) eta FROM y JOIN r USING (s)) SELECT s, eta AS statistic, {p} p FROM q"""
