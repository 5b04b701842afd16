"""Results that must not hang on the order in which tasks run."""

import random

from pyspark.sql import functions as F

from tidepanel.operators import stats


def test_corrections_use_the_p_values_that_are_returned(spark):
    """p that differ whenever they are computed again, as sums of doubles do in their last bits."""
    drawn = F.udf(lambda i: random.SystemRandom().random() / 10, "double").asNondeterministic()
    rows = stats.multiplicity(spark.range(40).select("id", drawn("id").alias("p_value"))).collect()
    p, worst, wanted = sorted(r.p_value for r in rows), 1.0, {}
    for k in range(len(p), 0, -1):
        worst = min(worst, p[k - 1] * len(p) / k)
        wanted[p[k - 1]] = worst
    for r in rows:
        assert r.p_value_fdr_bh is not None and abs(r.p_value_fdr_bh - wanted[r.p_value]) < 1e-12
        assert abs(r.p_value_bonferroni - min(r.p_value * len(p), 1.0)) < 1e-12


def test_granger_over_series_that_differ_in_their_last_bits(spark):
    """Pairs whose values change a little whenever they are computed again keep their corrected p."""
    moved = F.udf(lambda t, k: ((t * t * (k + 3)) % 101) / 7 + random.SystemRandom().random() * 1e-9, "double").asNondeterministic()
    names = F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int"))
    long = spark.range(4 * 80).select(names.alias("s"), F.floor(F.col("id") / 4).alias("t"), moved(F.floor(F.col("id") / 4), F.col("id") % 4).alias("v"))
    rows = stats.multiplicity(stats.granger(stats.pairs(long, "s", "t", "v"))).collect()
    assert len(rows) == 12
    for r in rows:
        assert r.p_value_fdr_bh is not None and r.p_value_fdr_bh >= r.p_value
        assert abs(r.p_value_bonferroni - min(r.p_value * 12, 1.0)) < 1e-12
        assert r.significant_raw_05 == (r.p_value < 0.05) and r.significant_fdr_05 == (r.p_value_fdr_bh <= 0.05)
