"""Networks as edge tables: degrees and sums by aggregation, PageRank by joins; HITS and betweenness, which need the whole
graph, run in one group and are meant for networks of entities (thousands of nodes)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..session import cut, discard, importable
from . import stats


def edge_table(results: DataFrame, flag: str, p: str, kind: str) -> DataFrame:
    """Edges whose flag is set (text flags count), weighing -log10 of p."""
    on = flag_of(flag)
    own = F.col("source") == F.col("target")
    weight = -F.log10(F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(schemas.P_FLOOR)))
    return results.where(on).withColumns({"edge_weight": weight, "edge_type": F.when(own, "self").otherwise("cross"), "is_self_edge": own, "significance_type": F.lit(kind)})


def node_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degrees and weighted degrees over cross edges, self loops apart; a row for every node."""
    cross = edges.where("source <> target")
    ends = cross.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("edge_weight").alias("w"), F.lit(0).alias("s"))
    ends = ends.union(cross.select("target", F.lit(0), F.lit(1), "edge_weight", F.lit(0)))
    ends = ends.union(edges.where("source = target").select("source", F.lit(0), F.lit(0), F.lit(0.0), F.lit(1)))
    agg = ends.groupBy("node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.when(F.col("i") == 1, F.col("w")).otherwise(0.0)).alias("weighted_in_degree"), F.sum(F.when(F.col("o") == 1, F.col("w")).otherwise(0.0)).alias("weighted_out_degree"), F.sum("s").alias("self_loop_count")
    )
    out = nodes.select("node").join(agg, "node", "left").fillna(0)
    wi, wo = F.col("weighted_in_degree"), F.col("weighted_out_degree")
    return out.withColumns({"total_degree": F.col("in_degree") + F.col("out_degree"), "weighted_total_degree": wi + wo, "is_net_sender": wo > wi, "is_net_receiver": wi > wo})


def network_summary(edges: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """One row; ties go to the node of smallest order (`ord` of nodes)."""
    cross = edges.where("source <> target")
    n = nodes.agg(F.count(F.lit(1)).alias("number_of_nodes"))
    counts = edges.agg(
        F.count(F.lit(1)).alias("total_edges"),
        F.count_if(F.col("source") != F.col("target")).alias("cross_edges"),
        F.count_if(F.col("source") == F.col("target")).alias("self_edges"),
        F.countDistinct(F.when(F.col("source") != F.col("target"), F.col("source"))).alias("number_of_active_source_nodes"),
        F.countDistinct(F.when(F.col("source") != F.col("target"), F.col("target"))).alias("number_of_active_target_nodes"),
    )
    d = node_degrees(edges, nodes).join(nodes, "node")
    top = lambda c: F.max_by(F.when(F.col(c) > 0, F.col("node")), F.struct(F.col(c), -F.col("ord")))
    tops = d.agg(F.coalesce(top("weighted_out_degree"), F.lit("")).alias("top_sender_by_weight"), F.coalesce(top("weighted_in_degree"), F.lit("")).alias("top_receiver_by_weight"))
    o = nodes.select(F.col("node").alias("source"), F.col("ord").alias("so"))
    o2 = nodes.select(F.col("node").alias("target"), F.col("ord").alias("to"))
    key = F.struct("edge_weight", -F.col("so"), -F.col("to"))
    best = cross.join(o, "source").join(o2, "target").agg(F.max_by("source", key).alias("strongest_edge_source"), F.max_by("target", key).alias("strongest_edge_target"), F.max("edge_weight").alias("strongest_edge_weight"), *([F.max_by("p_value", key).alias("strongest_edge_p_value")] if "p_value" in cross.columns else []))
    out = counts.crossJoin(n).crossJoin(tops).crossJoin(best)  # rows of one
    nn = F.col("number_of_nodes")
    return out.select(F.lit(kind).alias("network_type"), "*", F.try_divide(F.col("cross_edges"), nn * (nn - 1)).alias("density_cross"))


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100, every: int = 4) -> DataFrame:
    """node, pagerank over weighted cross edges; mass of nodes without edges out is shared alike. A fixed number of rounds,
    or until the change is below n * tolerance; lineage is cut by a written table every few rounds, or each where the change is
    read, and tables of earlier rounds go."""
    cross = edges.where("source <> target").groupBy("source", "target").agg(F.sum("edge_weight").alias("w"))
    out = cross.groupBy("source").agg(F.sum("w").alias("total"))
    step = cross.join(out, "source").select("source", "target", (F.col("w") / F.col("total")).alias("share"))
    step = cut(step)
    n, made = nodes.count(), []
    rank = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("pagerank"))
    senders = out.select(F.col("source").alias("node"), F.lit(True).alias("sends"))
    for r in range(rounds or most):
        flow = step.join(rank, step.source == rank.node).groupBy("target").agg(F.sum(F.col("share") * F.col("pagerank")).alias("got"))
        loose = rank.join(senders, "node", "left_anti").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("loose"))
        new = nodes.select("node").join(flow, F.col("node") == F.col("target"), "left").crossJoin(loose)  # a row of one
        new = new.select("node", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("pagerank"))
        if rounds is None:
            new = cut(new, made)
            discard(nodes.sparkSession, made[:-2])
            moved = new.join(rank.withColumnRenamed("pagerank", "old"), "node").agg(F.sum(F.abs(F.col("pagerank") - F.col("old")))).first()[0] or 0.0
            if moved < n * tolerance:
                return new
        elif r % every == every - 1 and r + 1 < rounds:
            new = cut(new, made)
        rank = new
    return rank


def hits_scores(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hub and authority scores: leading singular vectors of the weighted matrix, each summing to one."""
    if not a.any():
        return np.zeros(len(a)), np.zeros(len(a))
    u, _, vt = np.linalg.svd(a)
    h, v = np.abs(u[:, 0]), np.abs(vt[0])
    return h / h.sum(), v / v.sum()


def betweenness_scores(a: np.ndarray) -> np.ndarray:
    """Share of shortest paths through each node, of (n-1)(n-2): path counts by levels from each source, dependencies summed
    back from the deepest."""
    n, link = len(a), (a != 0).astype(float)
    np.fill_diagonal(link, 0)
    score = np.zeros(n)
    for s in range(n):
        depth, paths = np.full(n, -1), np.zeros(n)
        depth[s], paths[s] = 0, 1
        level = 0
        while (depth == level).any():
            front = depth == level
            reach = (paths * front) @ link
            new = (reach > 0) & (depth < 0)
            depth[new] = level + 1
            paths[new] = reach[new]
            level += 1
        owed = np.zeros(n)
        for d in range(level - 1, 0, -1):
            here = depth == d
            up = depth == d - 1
            give = np.where(here, (1 + owed) / np.maximum(paths, 1), 0)
            owed += np.where(up, paths * (link @ give), 0)
        owed[s] = 0
        score += owed
    return score / ((n - 1) * (n - 2)) if n > 2 else score


def node_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degrees, PageRank, betweenness, hub and authority scores of every node; all zero where there is no cross edge."""
    ranks, scores = pagerank(edges, nodes), central_scores(edges, nodes)
    some = edges.agg((F.count_if(F.col("source") != F.col("target")) > 0).alias("_some"))
    out = node_degrees(edges, nodes).join(ranks, "node").join(scores, "node").crossJoin(some)  # some: one row
    return out.withColumn("pagerank", F.when(F.col("_some"), F.col("pagerank")).otherwise(0.0)).drop("_some")


#: Nodes that a whole graph may have in one task: its matrix is 128 MB, its decomposition and its paths minutes.
MOST_NODES = 4000


def small_graph(nodes: DataFrame) -> DataFrame:
    """nodes; an error if there are more than MOST_NODES."""
    if (n := nodes.count()) > MOST_NODES:
        raise ValueError(f"{n} nodes: whole-graph measures take {MOST_NODES} at most")
    return nodes


def central_scores(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, betweenness_centrality, hub_score, authority_score of at most MOST_NODES nodes."""
    nodes = small_graph(nodes)
    importable(nodes.sparkSession)
    e = edges.where("source <> target").select("source", "target", F.col("edge_weight").alias("w"))
    rows = nodes.select(F.lit(0).alias("g"), "node", F.lit(None).cast("string").alias("to"), F.lit(None).cast("double").alias("w")).union(e.select(F.lit(0), "source", "target", "w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf.loc[pdf["to"].isna(), "node"])
        at = {x: i for i, x in enumerate(names)}
        a = np.zeros((len(names), len(names)))
        for s, t, w in pdf.dropna(subset=["to"])[["node", "to", "w"]].itertuples(index=False):
            a[at[s], at[t]] += w
        h, v = hits_scores(a)
        return pd.DataFrame({"node": names, "betweenness_centrality": betweenness_scores(a), "hub_score": h, "authority_score": v})

    return rows.groupBy("g").applyInPandas(run, "node string, betweenness_centrality double, hub_score double, authority_score double")


def threshold_edges(matrix: DataFrame, threshold: DataFrame, entities=None) -> DataFrame:
    """Unordered pairs whose |corr| is strictly above the threshold, a table of one row; the source is that which comes first
    by name, or among the entities if they are given."""
    place = (lambda c: F.array_position(F.array(*map(F.lit, entities)), F.col(c))) if entities else F.col
    found = matrix.where(place("a") < place("b")).crossJoin(threshold).where(F.abs("corr") > F.col("threshold"))
    return found.select(F.col("a").alias("source"), F.col("b").alias("target"), "corr", F.abs("corr").alias("abs_corr"))


def corr_nodes(matrix: DataFrame, threshold: DataFrame) -> DataFrame:
    """Degree and sum of |corr| over neighbours, mean |corr| to all others."""
    rows = matrix.where("a <> b").crossJoin(threshold)
    near = F.abs("corr") > F.col("threshold")
    return rows.groupBy(F.col("a").alias("node")).agg(F.count_if(near).alias("degree"), F.coalesce(F.sum(F.when(near, F.abs("corr"))), F.lit(0.0)).alias("weighted_degree"), F.avg(F.abs("corr")).alias("avg_abs_corr"))


def symmetrize(edges: DataFrame) -> DataFrame:
    e = edges.select("source", "target")
    return e.union(e.select("target", "source")).where("source <> target").distinct()


def similarity(first: DataFrame, second: DataFrame, nodes: DataFrame) -> DataFrame:
    """metric, value of two symmetric networks over all ordered pairs of different nodes; on 0/1 cells the rank correlation
    equals the other. The p of a correlation counts every cell, mirrored ones too."""
    a = symmetrize(first).withColumn("x", F.lit(1))
    b = symmetrize(second).withColumn("y", F.lit(1))
    n = nodes.agg(F.count(F.lit(1)).cast("double").alias("nodes")).withColumn("cells", F.col("nodes") * (F.col("nodes") - 1))
    c = a.join(b, ["source", "target"], "full").agg(F.coalesce(F.sum("x"), F.lit(0)).cast("double").alias("x"), F.coalesce(F.sum("y"), F.lit(0)).cast("double").alias("y"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).cast("double").alias("xy")).crossJoin(n)
    x, y, xy, m = (F.col(k) for k in ("x", "y", "xy", "cells"))
    var = F.sqrt(x * (m - x)) * F.sqrt(y * (m - y))
    r = F.try_divide(m * xy - x * y, var)
    distance = F.sqrt(x + y - 2 * xy)
    values = {"nodes": F.col("nodes"), "first_edges": x, "second_edges": y, "shared_edges": xy, "frobenius": distance, "frobenius_similarity": 1 - F.try_divide(distance, F.sqrt(m)), "jaccard": F.try_divide(xy, x + y - xy), "pearson": r, "pearson_pvalue": stats.t_pvalue(r, m), "spearman": r, "spearman_pvalue": stats.t_pvalue(r, m)}
    return c.select(*[v.alias(k) for k, v in values.items()]).unpivot([], list(values), "metric", "value")


def qap(first: DataFrame, second: DataFrame, nodes: DataFrame, permutations: int = schemas.QAP_PERMUTATIONS, seed: int = schemas.QAP_SEED) -> DataFrame:
    """observed, p_value: share of node relabellings of the first network that overlap the second at least as much. With
    fixed margins the correlation grows with the overlap, so integers decide. Permutations run as rows of a range."""
    spark = first.sparkSession
    importable(spark)
    names = sorted(r.node for r in small_graph(nodes).select("node").collect())  # MOST_NODES at most
    at = {x: i for i, x in enumerate(names)}
    a, b = (np.zeros((len(names), len(names)), np.int32) for _ in range(2))
    for m, e in ((a, first), (b, second)):
        for r in symmetrize(e).toLocalIterator():
            m[at[r.source], at[r.target]] = 1
    seen = int((a * b).sum())

    def run(batches):
        for pdf in batches:
            hits = [int((a[np.ix_(p, p)] * b).sum()) >= seen for p in (np.random.default_rng([seed, int(i)]).permutation(len(a)) for i in pdf["id"])]
            yield pd.DataFrame({"hit": hits})

    n = len(names) * (len(names) - 1)
    flat = a.sum() in (0, n) or b.sum() in (0, n)
    return spark.range(permutations).mapInPandas(run, "hit boolean").agg(F.lit(seen).cast("long").alias("observed"), F.when(F.lit(not flat), (F.count_if("hit") + 1) / F.lit(permutations + 1)).alias("p_value"))


def fdr_edges(results: DataFrame) -> DataFrame:
    """Pairs that stay significant after the correction, the heaviest first, a typed empty table where there is none."""
    found = results.where(F.coalesce(F.col("significant_fdr_05"), F.lit(False)))
    return found.select("source", "target", "best_lag", "p_value", "p_value_fdr_bh", "edge_weight", "n_obs", "f_stat").orderBy(F.desc_nulls_last("edge_weight"), "source", "target")


def plot_edges(edges: DataFrame, self_loops: bool = False, least_weight: float = 0.0) -> DataFrame:
    """Edges to draw: self loops only on demand, a missing weight counts as 0."""
    kept = edges if self_loops else edges.where("source <> target")
    return kept.where(F.coalesce(F.col("edge_weight"), F.lit(0.0)) >= least_weight)


def matrix(results: DataFrame, value: str, entities, default=None, source: str = "source", target: str = "target") -> DataFrame:
    """A row for each entity as source, a column for each as target, in their order; pairs that aren't there have `default`."""
    cell = lambda e: F.max(F.when(F.col(target) == e, F.col(value)))
    rows = results.sparkSession.createDataFrame([(e, i) for i, e in enumerate(entities)], "source string, _order int")
    got = results.groupBy(F.col(source).alias("source")).agg(*[cell(e).alias(e) for e in entities])
    out = rows.join(got, "source", "left").orderBy("_order")
    return out.select("source", *[F.coalesce(F.col(f"`{e}`"), F.lit(default)).alias(e) if default is not None else F.col(f"`{e}`") for e in entities])


def flag_of(c: str):
    """Whether a flag, text or not, is set."""
    return F.lower(F.trim(F.col(c).cast("string"))).isin("true", "1", "yes", "y")


def adjacency(results: DataFrame, flag: str, entities) -> DataFrame:
    """The 0/1 matrix of flagged pairs of different entities."""
    on = (flag_of(flag) & (F.col("source") != F.col("target"))).cast("int")
    return matrix(results.withColumn("_on", F.coalesce(on, F.lit(0))), "_on", entities, 0)


def matrix_edges(wide: DataFrame, entities, source: str = "source") -> DataFrame:
    """source, target of the cells of a matrix that are neither null nor 0; rows and columns of others are passed over."""
    cells = wide.where(F.col(source).isin(*entities)).select(F.col(source).alias("source"), *[F.col(f"`{e}`").try_cast("double").alias(e) for e in entities]).unpivot(["source"], list(entities), "target", "value")
    return cells.where((F.col("value") != 0) & ~F.isnan("value")).select("source", "target")


def normalized_matrix(wide: DataFrame, entities, source: str = "source") -> DataFrame:
    """The matrix with rows and columns of the entities in their order, cells as numbers; an error where one is missing."""
    if missing := [c for c in (source, *entities) if c not in wide.columns]:
        raise ValueError(f"missing columns: {missing}")
    order = F.array_position(F.array(*map(F.lit, entities)), F.col(source).cast("string"))
    out = wide.where(order > 0).orderBy(order).select(F.col(source).cast("string").alias("source"), *[F.col(f"`{e}`").try_cast("double").alias(e) for e in entities])
    if missing := sorted(set(entities) - {r.source for r in out.select("source").collect()}):  # a row per entity
        raise ValueError(f"missing rows: {missing}")
    return out


def top_nodes(scores: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The k nodes of the largest measure, those with none left out; ties by name."""
    return scores.where(F.col(by) > 0).orderBy(F.desc(by), "node").limit(k)


def circle(nodes: DataFrame) -> DataFrame:
    """node, x, y: places on the unit circle in the order of `ord`, the first on the right, counterclockwise."""
    n = nodes.agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_first"))
    turn = 2 * np.pi * (F.col("ord") - F.col("_first")) / F.col("_n")
    return nodes.crossJoin(n).select("node", F.cos(turn).alias("x"), F.sin(turn).alias("y"))  # n: one row
