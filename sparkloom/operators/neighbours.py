"""Neighbour joins over 2-D points, and the aggregates that ride on their edges.

Points: id, x, y (and a `by` column, such as the sample, that neighbours must share). Points are
joined by the leaves of a quadtree (see `cells`), so no join is a product and a dense core is no hot
key; the ranked window is limited to k rows a query, which Spark prunes before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cells


def knn(data: DataFrame, query: DataFrame, k: int, by: tuple[str, ...] = (), include_self: bool = True) -> DataFrame:
    """Exact k nearest data points of each query: by..., qid, nid, d, rank (1 nearest; ties by nid).
    include_self=False leaves out nid = qid."""
    found = cells.neighbours(data, query, list(by), k, include_self=include_self)
    return found.select(*by, "qid", "nid", F.sqrt("d2").alias("d"), "rank")


def radius_edges(data: DataFrame, query: DataFrame, radius: float, most: int | None = None, by: tuple[str, ...] = (), scale: float | None = None) -> DataFrame:
    """Neighbours within the radius (inclusive), the nearest `most` of them, with Gaussian weight
    exp(-(d / scale)^2 / 2), scale the radius unless given: by..., qid, nid, d, w."""
    pairs = cells.neighbours(data, query, list(by), most, radius)
    h = scale or radius
    return pairs.select(*by, "qid", "nid", F.sqrt("d2").alias("d"), F.exp(-0.5 * F.col("d2") / (h * h)).alias("w"))


def local_stats(edges: DataFrame, values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean, biased variance (floor 1e-12) and effective number of each (by, gene, qid).

    edges: by, qid, nid, w; values: by, nid, gene, value. One shuffle on the group with partial
    sums: s2 = sum w x^2 / sum w - mu^2."""
    w, x = F.col("w"), F.col("value")
    s = edges.join(values, [*by, "nid"]).groupBy(*by, "gene", "qid").agg(F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * x).alias("swx"), F.sum(w * x * x).alias("swxx"))
    mu = F.col("swx") / F.col("sw")
    return s.select(*by, "gene", "qid", F.when(F.col("sw") > 0, mu).alias("mu"), F.when(F.col("sw") > 0, F.greatest(F.col("swxx") / F.col("sw") - mu * mu, F.lit(1e-12))).alias("s2"), F.when(F.col("sw") > 0, F.col("sw") * F.col("sw") / F.col("sww")).otherwise(F.lit(0.0)).alias("neff"))


def kernel_map(edges: DataFrame, values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean of finite spot values at each query."""
    ok = values.filter(~F.isnan("value") & (F.abs("value") != float("inf")))
    return edges.join(ok, [*by, "nid"]).groupBy(*by, "qid").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def type_proportions(edges: DataFrame, types: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(sum w [type] + alpha) / (sum w + alpha C) and effective number, for every query and type.
    types: nid, celltype; C types are few and broadcast."""
    all_types = types.select("celltype").distinct()
    n = all_types.agg(F.count(F.lit(1)).alias("c"))
    rows = edges.join(types, "nid")
    total = rows.groupBy("qid").agg(F.sum("w").alias("total"))
    per = rows.groupBy("qid", "celltype").agg(F.sum("w").alias("sw"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("neff"))
    dense = total.join(F.broadcast(all_types)).join(per, ["qid", "celltype"], "left").join(F.broadcast(n))
    return dense.select("qid", "celltype", ((F.coalesce("sw", F.lit(0.0)) + alpha) / (F.col("total") + alpha * F.col("c"))).alias("share"), F.coalesce("neff", F.lit(0.0)).alias("neff"))


def count_moments(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Negative-binomial moments of each (gene, qid) over its neighbours: log1p of the mean, log1p
    of the size r = mu^2 / max(var - mu, 1e-8) (1e8 where it isn't over 0), and the logit of the
    excess of zeros over the expected ones."""
    x = F.col("value")
    s = edges.join(values, "nid").groupBy("gene", "qid").agg(F.avg(x).alias("mu"), F.var_pop(x).alias("va"), F.avg((x <= 0).cast("double")).alias("zero"))
    over = F.col("va") - F.col("mu")
    r = F.when(over > 0, F.col("mu") * F.col("mu") / F.greatest(over, F.lit(1e-8))).otherwise(F.lit(1e8))
    s = s.withColumn("r", F.when(r <= 0, F.lit(1e8)).otherwise(r))
    expect = F.pow(F.col("r") / (F.col("r") + F.col("mu")), F.col("r"))
    pi0 = F.least(F.greatest((F.col("zero") - expect) / F.greatest(1 - expect, F.lit(1e-8)), F.lit(1e-4)), F.lit(1 - 1e-4))
    return s.select("gene", "qid", F.log1p("mu").alias("log_mu"), F.log1p("r").alias("log_r"), F.ln(pi0 / (1 - pi0)).alias("logit_pi0"))


def shared_edges(nn: DataFrame, always: int = 3, least: int = 5) -> DataFrame:
    """Shared-nearest-neighbour graph of a kNN table (self included as rank 1): an edge stays if its
    rank is at most `always` or its ends share `least` neighbours; weight 1 / (1 + d); made
    symmetric by the maximum: i < j, w. Ends are compared by their lists of k neighbours, so a hub
    costs a list for each of its edges and no more."""
    a = nn.select(F.col("qid").alias("i"), F.col("nid").alias("j"), "d", "rank").filter("i <> j")
    lists = nn.groupBy("qid").agg(F.collect_set("nid").alias("m"))
    both = a.join(lists.toDF("i", "mi").hint("merge"), "i").join(lists.toDF("j", "mj").hint("merge"), "j", "left")
    shared = F.coalesce(F.size(F.array_intersect("mi", "mj")), F.lit(0))
    return symmetric(both.filter((F.col("rank") <= always) | (shared >= least)).select("i", "j", (1 / (1 + F.col("d"))).alias("w")))


def symmetric(edges: DataFrame, how: str = "max") -> DataFrame:
    """Undirected edges i < j of directed ones (i, j, w): the larger weight, or half the sum."""
    w = F.max("w") if how == "max" else F.sum("w") / 2
    return edges.filter("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(w.alias("w"))


def refine_labels(nn: DataFrame, labels: DataFrame, near_boundary: Column | None = None, k: tuple[int, int] = (150, 8), keep: float = 0.8, change: tuple[float, float, float] = (0.2, 0.8, 0.9), protected: tuple[str, ...] = ()) -> DataFrame:
    """Boundary-aware vote: neighbours weigh 1 / (d + 1e-6) among the first k (interior, boundary)
    ranks; a label changes if another is best, its own share is under `keep` and the best share
    reaches the threshold (interior, boundary, protected label). labels: id, label, boundary."""
    kk = F.when(F.col("boundary"), F.lit(k[1])).otherwise(F.lit(k[0]))
    other = labels.select(F.col("id").alias("nid"), F.col("label").alias("vote"))
    votes = nn.filter("qid <> nid").join(labels.select(F.col("id").alias("qid"), "label", "boundary"), "qid").filter(F.col("rank") <= kk + 1).join(other, "nid")
    w = votes.groupBy("qid", "label", "boundary", "vote").agg(F.sum(1 / (F.col("d") + 1e-6)).alias("w"), F.min("rank").alias("first"))
    order = Window.partitionBy("qid").orderBy(F.desc("w"), "first", "vote")
    all_ = Window.partitionBy("qid")
    w = w.withColumn("share", F.col("w") / F.sum("w").over(all_)).withColumn("own", F.max(F.when(F.col("vote") == F.col("label"), F.col("share")).otherwise(0.0)).over(all_)).withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    need = F.when(F.col("label").isin(*protected), F.lit(change[2])).otherwise(F.when(F.col("boundary"), F.lit(change[1])).otherwise(F.lit(change[0]))) if protected else F.when(F.col("boundary"), F.lit(change[1])).otherwise(F.lit(change[0]))
    moved = (F.col("vote") != F.col("label")) & (F.col("own") < keep) & (F.col("share") >= need)
    return w.select(F.col("qid").alias("id"), "label", F.when(moved, F.col("vote")).otherwise(F.col("label")).alias("refined"), F.round("share", 9).alias("share"))


def density_filter(nn: DataFrame, labels: DataFrame, c: float = 3.0, least: int = 10) -> DataFrame:
    """Drop points whose mean neighbour distance is over median + c * MAD of their cluster (MAD 0:
    over the 90 % quantile); clusters under `least` points stay whole. labels: id, cluster."""
    mean = nn.filter("qid <> nid").groupBy("qid").agg(F.avg("d").alias("d")).withColumnRenamed("qid", "id").join(labels, "id")
    m = mean.groupBy("cluster").agg(F.median("d").alias("med"), F.percentile("d", F.lit(0.9)).alias("q90"), F.count(F.lit(1)).alias("n"))
    rows = mean.join(m, "cluster")
    mad = rows.groupBy("cluster").agg(F.median(F.abs(F.col("d") - F.col("med"))).alias("mad"))
    limit = F.when(F.col("mad") > 0, F.col("med") + c * F.col("mad")).otherwise(F.col("q90"))
    return rows.join(mad, "cluster").withColumn("kept", (F.col("n") < least) | (F.col("d") <= limit)).select("id", "cluster", "d", "kept")


def agreement(query: DataFrame, reference: DataFrame) -> DataFrame:
    """1-NN label agreement: query and reference have id, x, y, cluster. Per query cluster: n, share
    of nearest reference points with the same label, mean distance."""
    nn = knn(reference, query, 1)
    lq, lr = query.select(F.col("id").alias("qid"), "cluster"), reference.select(F.col("id").alias("nid"), F.col("cluster").alias("other"))
    rows = nn.join(lq, "qid").join(lr, "nid")
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("cluster") == F.col("other")).cast("double")).alias("match_rate"), F.avg("d").alias("mean_distance"))


def batch_mixing(nn: DataFrame, batches: DataFrame) -> DataFrame:
    """Mean share of neighbours of the same batch and mean 1 / (p^2 + (1 - p)^2). batches: id, batch."""
    rows = nn.filter("qid <> nid").join(batches.toDF("qid", "b"), "qid").join(batches.toDF("nid", "o"), "nid")
    p = rows.groupBy("qid").agg(F.avg((F.col("b") == F.col("o")).cast("double")).alias("p"))
    return p.agg(F.avg("p").alias("same_batch"), F.avg(1 / (F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p")))).alias("ilisi"))


def smooth(nn: DataFrame, values: DataFrame) -> DataFrame:
    """Gaussian smooth over a query's neighbours, bandwidth its median neighbour distance."""
    rows = nn.join(values.select(F.col("id").alias("nid"), "value"), "nid")
    h = rows.groupBy("qid").agg(F.median("d").alias("h"))
    w = F.exp(-0.5 * F.pow(F.col("d") / F.greatest("h", F.lit(1e-9)), 2))
    return rows.join(h, "qid").groupBy("qid").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"))


def erode(nn: DataFrame, flags: DataFrame, radius: float, tau: float = 0.6) -> DataFrame:
    """One consensus erosion: a set cell stays if the Gaussian share of set neighbours reaches tau.
    flags: id, on."""
    w = F.exp(-0.5 * F.pow(F.col("d") / radius, 2))
    rows = nn.filter("qid <> nid").join(flags.select(F.col("id").alias("nid"), F.col("on").cast("double").alias("v")), "nid")
    share = rows.groupBy("qid").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("share"))
    return flags.join(share.withColumnRenamed("qid", "id"), "id", "left").select("id", (F.col("on") & (F.coalesce("share", F.lit(0.0)) >= tau)).alias("on"))


def kernel_density(edges: DataFrame, edge_distance: DataFrame, h: float, floor: float = 0.5) -> DataFrame:
    """Sum of weights at each query over the share of the kernel that lies inside the support,
    taken as the normal mass within its distance to the edge (at least `floor`); outside the
    support the density is 0. edge_distance: qid, bd (distance to the edge, negative outside)."""
    from ..functions.special import normal

    s = edges.groupBy("qid").agg(F.sum("w").alias("s"))
    mass = F.greatest(normal(F.col("bd") / h), F.lit(floor))
    return edge_distance.join(s, "qid", "left").select("qid", F.when(F.col("bd") < 0, F.lit(0.0)).otherwise(F.coalesce("s", F.lit(0.0)) / mass).alias("density"))
