"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, stars.

A document's set of word shingles goes to BANDS * ROWS bins by one hash; a bin keeps its smallest
value, an empty bin borrows from the bin its own probe sequence first finds filled. Documents that
agree on all ROWS bins of a band share a bucket. A bucket proposes stars, its members against two
centres, so proposals are linear in its size; links are confirmed on full sets. Buckets that the
links found so far leave in several components propose again, and what stars leave open is tested
whole, blocks of members against blocks (see `link`)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_few, fits, lean_batches, small, unused, with_row_id, without_rows
from .hashing import column_words, mix

ROWS, BANDS = 6, 45
SLICE = 512
PROBES = 48
PERCENT = 80
#: Pairs between components that a bucket may have for each member to be tested as pairs, and to be
#: tested whole in blocks; larger ones send stars first.
CROSSING, WHOLE = 8, 512
#: Members, and shingles of all members, that a block of a large bucket holds on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Edges of one node that meet its set in one piece.
SPLIT = 1024
#: A row's id: its file, hashed, and its place there.
RID = "rid struct<f:bigint,r:bigint>"


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than `width`, the whole
    sequence is one shingle; without words, none."""
    words, bounds = column_words(column)
    rolled = words[: max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(rolled)])
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s >= width:
            out.append(np.unique(rolled[s : e - width + 1]))
        elif e > s:
            whole = np.uint64(e - s) + words[s : s + 1]
            for k in range(s + 1, e):
                whole = mix(whole * np.uint64(0xD1342543DE82EF95) + words[k : k + 1])
            out.append(whole)
        else:
            out.append(words[:0])
    return out


_probe = np.random.Generator(np.random.PCG64(7)).integers(0, ROWS * BANDS, (PROBES, ROWS * BANDS))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ROWS * BANDS bins for each set that is not empty."""
    k = ROWS * BANDS
    bins = np.zeros((len(sets), k), dtype=np.uint64)
    full = np.zeros((len(sets), k), dtype=bool)
    for i, s in enumerate(sets):
        b = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # ascending, as s is
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        at = b[first].astype(np.int64)
        bins[i, at] = s[first]
        full[i, at] = True
    doc, bin_ = np.nonzero(~full)
    for probe in _probe:  # a bin's t-th probe is the same in every document
        if not len(doc):
            break
        j = probe[bin_]
        hit = full[doc, j]
        bins[doc[hit], bin_[hit]] = bins[doc[hit], j[hit]]
        doc, bin_ = doc[~hit], bin_[~hit]
    for d in np.unique(doc):  # very small sets: the next filled bin from the last probe on
        have = np.flatnonzero(full[d])
        own = bin_[doc == d]
        bins[d, own] = bins[d, have[np.searchsorted(have, _probe[-1][own]) % len(have)]]
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    grouped = bins.reshape(len(bins), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(bins), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key.view(np.int64)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = shingle_sets(part.column(2), width)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                for i, row in zip(some, band_keys(sketch([sets[i] for i in some]))):
                    keys[i] = row
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["rid", "doc_id", "n", "print", "keys"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return run


def attach(edges: DataFrame, sets: DataFrame, end: str, name: str, few: bool) -> DataFrame:
    """The edges with the set of the node at one end. The edges of a node of many are dealt into
    pieces by their other end, each of which meets a copy of its set. few: the edges are few."""
    many = edges.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("pieces")).filter("pieces > 1")
    many = cut_few(many, few)
    hot = small(many)
    dealt = edges.join(hot, end, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("a", "b"), "pieces"), F.lit(0)).cast("int")).drop("pieces")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces") - 1, F.lit(0)))).alias("piece")
    held = sets.withColumnRenamed("node", end).join(hot, end, "left").select(end, F.col("set").alias(name), copies)
    return dealt.join(held, [end, "piece"]).drop("piece")


def confirm(edges: DataFrame, sets: DataFrame, few: bool) -> DataFrame:
    """The edges (a, b) whose full sets reach PERCENT: 100 * both >= PERCENT * either. few: they are few."""
    both = F.size(F.array_intersect("sa", "sb"))
    tested = attach(attach(edges, sets, "b", "sb", few), sets, "a", "sa", few)
    return tested.filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * PERCENT).select("a", "b")


def components(links: DataFrame, few: bool = False) -> DataFrame:
    """Connected components of links (a, b): node, comp (the smallest node). In each step a node
    points to its smallest neighbour or itself, pointers are followed once more, ends of links are
    replaced by where they point and links inside a point go; links shrink to none in a few steps,
    so all steps together cost little more than the first. few: the links are measured to be few."""
    edges = cut_few(links.select("a", "b").filter("a <> b").distinct(), few)
    few = few or fits(edges)
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        to = cut_few(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), few)
        ok = fits(to)
        to = cut_few(to.join(small(to.select(F.col("a").alias("p"), F.col("p").alias("q")), ok), "p").select("a", F.col("q").alias("p")), few)
        at = lambda c, d: small(to.select(F.col("a").alias(c), F.col("p").alias(d)), ok)
        if labels is None:
            labels = to.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            labels = cut_few(labels.join(at("comp", "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), few)
        edges = cut_few(edges.join(at("a", "x"), "a").join(at("b", "y"), "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), few)
    return links.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0) if labels is None else labels


def stars(members: DataFrame, salt: int, few: bool = False) -> DataFrame:
    """Edges (a, b) between each bucket's members and its two centres, the first and the last member
    in an order that depends on `salt` alone: at most two edges a member, and all pairs of up to
    three. Centres are written out before the join, so that Spark sees their size and can split a
    hot bucket's members. few: the members are measured to be few."""
    comp = "comp" in members.columns
    order = F.struct(F.xxhash64(F.lit(salt), "node").alias("h"), "node", "n", *(["comp"] if comp else []))
    ends = cut_few(members.groupBy("key").agg(F.min(order).alias("c"), F.max(order).alias("z")), few)
    ends = small(ends.withColumn("c", F.explode(F.array("c", "z"))).select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("cn"), *([F.col("c.comp").alias("ccomp")] if comp else [])))
    pairs = members.join(ends, "key").filter("node <> centre")
    if comp:
        pairs = pairs.filter("comp <> ccomp")
    fits = F.least("n", "cn") * 100 >= F.greatest("n", "cn") * PERCENT
    return pairs.filter(fits).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def crossing(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between all members of different components in a bucket, for small buckets."""
    one, two = rows.select("key", F.col("node").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac")), rows.select("key", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"))
    fits = F.least("an", "bn") * 100 >= F.greatest("an", "bn") * PERCENT
    return one.join(two, "key").filter((F.col("a") < F.col("b")) & (F.col("ac") != F.col("bc")) & fits).select("a", "b").distinct()


def _cell(table: pa.Table) -> pa.Table:
    """Links (a, b) between different components in a cell, block s against block t of a bucket, as
    a forest: a pair that the cell's other links connect already adds nothing to the components."""
    s, t, block = table.column("s")[0].as_py(), table.column("t")[0].as_py(), table.column("block").to_numpy()
    node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
    _, comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)
    sets = table.column("set").combine_chunks()
    bounds, values = sets.offsets.to_numpy(), sets.values.to_numpy(zero_copy_only=False)
    left, right = np.flatnonzero(block == s), np.flatnonzero(block == t)
    tokens = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in left])
    owner = np.repeat(np.arange(len(left)), bounds[left + 1] - bounds[left])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    a, b = [], []
    for j in right.tolist():
        own = values[bounds[j] : bounds[j + 1]]
        lo = np.searchsorted(tokens, own)
        many = np.searchsorted(tokens, own, "right") - lo
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(owner[at], minlength=len(left))
        for i in left[both * 100 >= (n[left] + n[j] - both) * PERCENT].tolist():
            if comp[i] != comp[j]:
                a.append(min(node[i], node[j]))
                b.append(max(node[i], node[j]))
                comp[comp == comp[i]] = comp[j]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect, in each bucket of rows (key, node, n, comp), all members of
    different components whose full sets reach PERCENT. Members outside a bucket's largest component
    meet all its members, block by block, so that no task holds more than two blocks; the largest
    component is not tested against itself. sets: node, set."""
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    whole = parts.groupBy("key").agg(F.max(F.struct("c", "w", "comp")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    n_blocks = lambda c, w: F.ceil(F.greatest(c / BLOCK, w / BLOCK_SHINGLES))
    top = cut(whole.select("key", F.col("top.comp").alias("largest"), n_blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("others"), n_blocks(F.col("top.c"), F.col("top.w")).alias("own")))
    other, h = F.col("comp") != F.col("largest"), F.xxhash64("node")
    dealt = rows.join(small(top), "key").withColumn("block", F.when(other, F.pmod(h, "others")).otherwise(F.col("others") + F.pmod(h, "own")))
    last = F.when(other, F.col("others") + F.col("own")).otherwise(F.col("others")) - 1
    met = dealt.select("key", "node", "n", "comp", "block", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("x"))
    cells = met.select("key", F.least("block", "x").alias("s"), F.greatest("block", "x").alias("t"), "block", "node", "n", "comp")
    return cells.join(sets, "node").groupBy("key", "s", "t").applyInArrow(_cell, "a long, b long").distinct()


def link(members: DataFrame, sets_of) -> DataFrame:
    """Components (node, comp) of the nodes of members (key, node, n).

    The first round tests each bucket's stars. A bucket that its links leave in several components
    has pairs between them; where these are at most CROSSING a member, all are tested as pairs, and
    where they are at most WHOLE a member, in blocks against blocks, so no link is lost there. The
    rest, very large buckets of mixed contents, send stars from fresh centres, round by round, until
    a round finds no new link or few enough pairs are left. Those still mixed then are tested whole
    too, so that no pair that shares a bucket stays untested across components. Every round costs
    pairs linear in the members left; the blocks cost as many comparisons as pairs outside a
    bucket's largest component, but rows of only two members a BLOCK of them."""
    comps = cut(members.select("node").distinct().withColumn("comp", F.col("node")))
    ok = fits(comps)
    tested, salt, exact, held = None, 0, False, False  # held: the members are few
    while True:
        if salt:
            rows = members.join(small(comps, ok), "node")
            parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"))
            pairs = (F.col("m") * F.col("m") - F.col("s")) / 2
            kind = F.when(pairs <= CROSSING * F.col("m"), 0).when(F.lit(exact) | (pairs <= WHOLE * F.col("m")), 1).otherwise(2)
            mixed = cut_few(parts.filter(pairs > 0).select("key", kind.alias("kind")), held)
            rows = cut_few(rows.join(small(mixed), "key"), held)
            held = held or fits(rows)
            few, whole, rows = (rows.filter(F.col("kind") == k).drop("kind") for k in range(3))
            last = exact or rows.isEmpty()
            edges = crossing(few) if last else crossing(few).union(stars(rows, salt, held)).distinct()
            members = rows.drop("comp")
            edges = cut_few(edges.join(tested, ["a", "b"], "left_anti"), held)  # at most CROSSING + 2 a member
        else:
            last, edges = False, cut(stars(members, salt))
        tested = edges if tested is None else tested.union(edges)
        few = fits(edges)
        found = cut(confirm(edges, sets_of(edges, few), few))
        if salt and not whole.isEmpty():
            nodes = whole.select(F.col("node").alias("a"), F.col("node").alias("b"))
            found, few = cut(found.union(blocks(whole, sets_of(nodes, held)))), False
        if not found.isEmpty():
            at = lambda c, d: small(comps.select(F.col("node").alias(c), F.col("comp").alias(d)), ok)
            between = found if not salt else found.join(at("a", "x"), "a").join(at("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            merged = components(between, few).toDF("comp", "to")
            comps = cut_few(comps.join(small(merged), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), ok)
        elif salt:
            exact = True
        if last:
            return comps
        salt += 1


def classes(docs: DataFrame, rid: str, width: int) -> DataFrame:
    """near_dedup of docs with row ids in `rid`; the result has these too, as `rid`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lean_batches(docs.sparkSession)
    scan = docs.select(F.col(rid).alias("rid"), "doc_id", "text")
    base = cut(scan.mapInArrow(_sign(width), f"{RID}, doc_id {kind}, n long, print binary, keys array<bigint>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid")).alias("rep")
    some = base.filter("n > 0").groupBy("print").agg(first, F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    nodes = cut(some.select(F.monotonically_increasing_id().alias("node"), "print", "n", "rep", "rows"))
    reps = nodes.select("node", F.col("rep.rid").alias("rid"))
    banded = base.select("rid", "n", "keys").join(small(reps), "rid").select("node", "n", F.explode("keys").alias("key"))
    shared = cut(banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"))
    members = cut(banded.join(small(shared), "key"))

    def sets_of(edges: DataFrame, few: bool) -> DataFrame:
        wanted = cut_few(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().join(reps, "node"), few)
        rows = scan.select("rid", "text").join(small(wanted), "rid").select("node", "text")
        return cut(rows.mapInArrow(_sets(width), "node long, set array<bigint>"))

    comps = link(members, sets_of)
    few = fits(nodes)
    labelled = cut_few(nodes.join(small(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node")), few)
    best = labelled.groupBy("comp").agg(F.min("rep").alias("best"), F.sum("rows").alias("size")).filter("size > 1")
    best = cut_few(best.drop("size"), few)
    verdict = cut_few(labelled.select("print", "comp").join(small(best), "comp").select("print", "best"), few)
    out = base.drop("keys").join(small(verdict), "print", "left")
    alone = F.col("best").isNull()
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), (alone | (F.col("rid") == F.col("best.rid"))).alias("kept"))


def near_dedup(docs: DataFrame, width: int = 2) -> DataFrame:
    """Near-duplicate classes over sets of distinct `width`-word shingles (A-Z lower-cased).

    Documents of equal sets are one node from the start, so groups of copies cost nothing more.
    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (the row
    that stands for its component), one row per input row. Null, empty and blank texts have empty
    sets: they link with nothing and stay. Of repeated rows one is kept; null doc_id comes last in
    order. Other columns are ignored, whatever their names; an empty table gives an empty one."""
    return classes(with_row_id(docs.select("doc_id", "text"), "rid"), "rid", width).drop("rid")


def drop_near(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each near-duplicate component, whole rows and columns as they came, whatever
    the names of other columns."""
    (rid,) = unused(docs, "rid")
    rows = with_row_id(docs, rid)
    return without_rows(rows, rid, cut(classes(rows, rid, width).filter(~F.col("kept")).select("rid")))
