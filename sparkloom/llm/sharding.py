"""Byte-balanced shards by Karmarkar-Karp differencing over indivisible groups of equal texts.

Groups as large as a small fraction of a shard are differenced one by one, all others in bundles of
about that size, so that whatever the corpus one list of bounded length spans large and small alike:
what the large ones leave uneven, the small ones still level."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks_of, cut, gapless_rank

OVERHEAD = 16
#: A unit of at least this fraction of a shard's fair share is differenced by itself.
FRACTION = 200
#: A group larger than a shard's fair share is cut into parts of this fraction of a share.
PARTS_PER_SHARE = 16


def difference(partials: list[list[tuple[float, list]]], k: int) -> list[tuple[float, list]]:
    """Karmarkar-Karp for k parts. A partial partition is k (sum, members) pairs, missing ones
    empty; the two of largest spread are joined in opposite order, largest with smallest, until
    one is left. Returns its k pairs, largest sum first."""
    heap = []
    for n, part in enumerate(partials):
        part = sorted(part, key=lambda x: -x[0])
        heap.append((-(part[0][0] - (part[-1][0] if len(part) == k else 0)), n, part))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        out, free = list(a), k - len(a)
        for j, x in enumerate(b):  # b's largest to a's smallest, an empty part being smallest
            if j < free:
                out.append(x)
            else:
                i = len(a) - 1 - (j - free)
                out[i] = (a[i][0] + x[0], [a[i][1], x[1]])
        out.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (-(out[0][0] - (out[-1][0] if len(out) == k else 0)), n, out))
        n += 1
    return heap[0][2] if heap else []


def leaves(tree) -> list:
    """Members of a nested pair tree."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += x
        else:
            out.append(x)
    return out


def solve(sizes: list[int], k: int) -> list[int]:
    """The shard of each size, by differencing all of them."""
    out = [0] * len(sizes)
    for s, (_, tree) in enumerate(difference([[(float(b), i)] for i, b in enumerate(sizes)], k)):
        for i in leaves(tree):
            out[i] = s
    return out


def plan(units: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """Of units (__h, __part, bytes), materialised: a table of the large ones' shards (__h, __part,
    __own), one of the bundles' (__bundle, __theirs), and the number of bundles.

    A unit of a fair share / FRACTION or more is an item; smaller ones are dealt by hash into bundles
    of about that size, which are items too. At any size of corpus there are at most k * FRACTION of
    either; the driver takes their sizes and differences them. As bundles are small and of random
    sizes, their differences shrink as far as those of single documents."""
    spark = units.sparkSession
    total = units.agg(F.sum("bytes")).first()[0] or 0
    least = max(1, total // (k * FRACTION))
    large = units.filter(F.col("bytes") >= least).select("__h", "__part", "bytes").collect()
    rest = total - sum(r["bytes"] for r in large)
    bundles = max(1, -(-rest // least))
    sums = units.filter(F.col("bytes") < least).groupBy(bundle(bundles).alias("b")).agg(F.sum("bytes").alias("bytes")).collect()
    items = sorted([(-r["bytes"], r["__h"], r["__part"]) for r in large] + [(-r["bytes"], "", r["b"]) for r in sums])
    placed = [(h, n, s) for (_, h, n), s in zip(items, solve([-b for b, _, _ in items], k))]
    own = spark.createDataFrame([x for x in placed if x[0]], "__h string, __part long, __own int")
    return own, spark.createDataFrame([x[1:] for x in placed if not x[0]], "__bundle long, __theirs int"), bundles


def bundle(bundles: int) -> Column:
    return F.pmod(F.xxhash64("__h", "__part"), F.lit(bundles))


def shard(docs: DataFrame, k: int = 40) -> DataFrame:
    """Put documents into shards 0..k-1 of near equal bytes, equal texts together.

    A group of equal texts is indivisible up to a shard's fair share of bytes; a larger one (at
    most k of them can exist) cannot be balanced whole and is dealt by a hash of doc_id into parts
    of a fraction of a share. Texts meet by SHA-256; only hashes and sizes are shuffled, pre-aggregated,
    and ids once to number each shard.

    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law ('bytes'), shard, slot (gapless in
    the shard), grown_shard (null) and group_parts (into how many parts the row's group of equal
    texts was cut; 1: it is whole in its shard), one row per input row. Null text counts as empty; repeated
    rows are rows like others; other columns are ignored; an empty table gives an empty one."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("__h")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(1.0, total / k)
    groups = rows.groupBy("__h").agg(F.sum("size").alias("bytes"))
    large = cut(groups.filter(F.col("bytes") > share).select("__h", chunks_of(F.col("bytes"), max(1, share / PARTS_PER_SHARE)).alias("__parts")))
    rows = rows.join(F.broadcast(large), "__h", "left")  # fewer than k rows: each has over 1/k of all bytes
    rows = cut(rows.withColumn("__part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("__parts")), F.lit(0))))
    own, theirs, bundles = plan(cut(rows.groupBy("__h", "__part").agg(F.sum("size").alias("bytes"))), k)
    rows = rows.join(F.broadcast(own), ["__h", "__part"], "left").withColumn("__bundle", bundle(bundles)).join(F.broadcast(theirs), "__bundle", "left")
    placed = cut(rows.select("doc_id", "size", "text_crc32", F.coalesce("__own", "__theirs").alias("shard"), F.coalesce("__parts", F.lit(1)).cast("long").alias("group_parts")))
    ranked = gapless_rank(placed, "shard", ["doc_id", "size", "text_crc32"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_parts")
