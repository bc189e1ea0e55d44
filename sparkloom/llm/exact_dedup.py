"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, cut, only_rows, small, unused, with_row_id, without_rows

PREFIX = 256


def normal(text: str | Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WS, "")


def settle(docs: DataFrame, rid: str, digest: bool) -> tuple[DataFrame, DataFrame]:
    """For docs with row ids in `rid`: a short row (rid, doc_id, ...) of every document, and of those
    that equal another rid, keep (the rid that stays), keep_id, group_size and text_sha256.

    The first scan writes the short rows; with `digest` they hold the full hash of every text.
    Without, only texts that share length and prefix hash with another are hashed, in a second scan
    that finds them by their row ids or, where these are many, by a bit for each row. Only where the
    bits are too many to broadcast too (some 270 million rows), that scan hashes every text rather
    than shuffle any, and the other hashes are dropped."""
    norm = normal("text")
    rows = docs.select(F.col(rid).alias("rid"), "doc_id", "text")
    cols = ["rid", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.length(norm).alias("m"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("p")]
    sig = cut(rows.select(*cols, *([F.sha2(norm, 256).alias("text_sha256")] if digest else [])))
    lengths = cut(sig.groupBy("m").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("m"))
    alike = cut(sig.join(small(lengths), "m", "left_semi").groupBy("m", "p").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("m", "p"))
    shared = sig.join(small(alike), ["m", "p"], "left_semi")
    if not digest:
        shared = cut(shared)
        alive = only_rows(rows, "rid", shared.select("rid"))
        hashed = cut((rows if alive is None else alive).select("rid", F.sha2(norm, 256).alias("text_sha256")))
        shared = shared.join(hashed, "rid")
    same = ["m", "p", "text_sha256"]
    best = F.min(F.struct(-F.col("n"), F.col("doc_id").isNull().alias("x"), "doc_id", "rid"))
    # written out, so that the join sees its size: broadcast, or a join whose hot group can be split
    groups = cut(shared.groupBy(*same).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1").select(*same, F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep"), "group_size"))
    return sig, shared.join(small(groups), same).select("rid", "keep", "keep_id", "group_size", "text_sha256")


def exact_dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Decide for each document which of the equal ones stays.

    Texts are equal when identical after white space is deleted. Stage 1 counts normalised lengths,
    stage 2 counts prefix hashes among documents that share a length, stage 3 compares SHA-256 of
    whole texts among documents that share both (see `settle`).

    Returns doc_id, keep_id, group_size, kept and text_sha256, one row per input row; without
    `digest` the hash is null for texts that equal no other. Null text counts as empty; empty texts
    equal each other. Of equal texts the longest original stays, then the smallest doc_id (null
    last); of rows that are equal in both, one. Other columns of docs are ignored, whatever their
    names; an empty table gives an empty one."""
    sig, twins = settle(with_row_id(docs.select("doc_id", "text"), "rid"), "rid", digest)
    twins = cut(twins.drop("text_sha256") if digest else twins)
    out = sig.join(small(twins), "rid", "left")
    alone = F.col("group_size").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("rid") == F.col("keep"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that exact_dedup keeps, whole rows and columns as they came, whatever the names
    of other columns. Only texts that share length and prefix hash are hashed whole."""
    (rid,) = unused(docs, "rid")
    rows = with_row_id(docs, rid)
    _, twins = settle(rows, rid, False)
    return without_rows(rows, rid, cut(twins.filter(F.col("rid") != F.col("keep")).select("rid")))
