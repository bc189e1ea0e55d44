"""The pairs of a coarse-to-fine atlas alignment: a table of levels that set operations drive.

At each level of a cluster hierarchy the clusters are scored against sets of atlas labels; pairs are
accepted greedily, a cluster once and a label once, layers before the rest. After the last level the
pairing goes on until a round brings no pair more. What moves points between rounds is the caller's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import pairing
from ..storage import cut

STATE = ["stage", "level", "cluster", "candidate", "labels", "score"]


def accepted(scored: DataFrame, is_layer: Column | None = None, least: float = 0.0) -> DataFrame:
    """Pairs of one round: scored rows (cluster, candidate, labels, score) of at least `least`, greedy
    by score, each cluster once and no label twice; with is_layer, rows that it marks go first."""
    rows = scored.filter(F.col("score") >= least).select("cluster", "candidate", "labels", "score")
    return pairing.layers_then_rest(rows, is_layer) if is_layer is not None else pairing.disjoint_sets(rows)


def run(score: Callable[[int, int], DataFrame], levels: int, is_layer: Column | None = None, least: float = 0.0, after: Callable[[int, DataFrame], None] | None = None, most: int = 10) -> DataFrame:
    """The accepted pairs of every stage: stage, level, cluster, candidate, labels, score.

    score(stage, level) gives the scored candidates as they are then; after(stage, pairs) may align by
    the accepted pairs. Stages 0 to levels - 1 go through the levels; then the last level is paired
    again, at most `most` times, until a stage has no more pairs than the one before, which ends it
    (that stage is not kept). Labels that a stage uses are free again in the next."""
    out, before, stage = [], -1, 0
    while stage < levels + most:
        level = min(stage, levels - 1)
        pairs = cut(accepted(score(stage, level), is_layer, least).withColumn("stage", F.lit(stage)).withColumn("level", F.lit(level)).select(*STATE))
        n = pairs.count()
        if stage >= levels and n <= before:
            break
        out.append(pairs)
        if after is not None:
            after(stage, pairs)
        before, stage = n, stage + 1
    state = out[0]
    for x in out[1:]:
        state = state.unionByName(x)
    return state


def final_pairs(state: DataFrame) -> DataFrame:
    """The pairs of the last stage, as what points take their labels from."""
    last = state.agg(F.max("stage").alias("stage"))
    return state.join(F.broadcast(last), "stage").select("cluster", "candidate", "labels", "score")


def used_labels(state: DataFrame) -> DataFrame:
    """stage, label and the cluster that holds it: no label twice in a stage."""
    return state.select("stage", F.explode("labels").alias("label"), "cluster")
