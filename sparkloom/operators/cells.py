"""Adaptive cells: a quadtree over 2-D points, from counts, and joins of its leaves.

A cell that holds more than LEAF points of its group is split in four, so a dense core is many small
leaves and an empty margin few large ones: points are joined by leaf, and no leaf is a hot key. The
tree is made of counts alone, at most about 16 leaves for each LEAF points (LEAF grows with the table
so that these stay under 16 * MOST_LEAVES), and is broadcast as sorted arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

DEPTH = 26
LEAF, MOST_LEAVES = 2048, 1 << 18
#: Queries, and data points, of a leaf that meet in one task at most.
QUERIES, DATA = 4096, 4 * LEAF
#: Rows that a task finds leaves for at once.
SLICE = 1024


def _spread(v: np.ndarray) -> np.ndarray:
    """Put a zero between each two of the 26 low bits."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v.astype(np.int64)


def _gather(z: np.ndarray) -> np.ndarray:
    """Every second bit, the inverse of _spread."""
    v = z.astype(np.uint64) & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> np.uint64(shift))) & np.uint64(mask)
    return v.astype(np.int64)


class Leaves:
    """The leaves of one group in the order of their codes: first code, depth, points before."""

    def __init__(self, x0: float, y0: float, side: float, first: int, lo: np.ndarray, depth: np.ndarray, count: np.ndarray):
        order = np.argsort(lo, kind="stable")
        self.x0, self.y0, self.side, self.first = x0, y0, side, first  # first: the number of the group's first leaf
        self.lo, self.depth = lo[order], depth[order]
        self.before = np.concatenate(([0], np.cumsum(count[order])))

    def code(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = [np.clip(np.floor((v - v0) * (2.0**DEPTH / self.side)), 0, 2**DEPTH - 1).astype(np.int64) for v, v0 in ((x, self.x0), (y, self.y0))]
        return _spread(at[0]) | (_spread(at[1]) << 1)

    def locate(self, z: np.ndarray) -> np.ndarray:
        """The leaf that holds each code, -1 where there is none."""
        i = np.searchsorted(self.lo, z, "right") - 1
        return np.where((i >= 0) & (z < self.lo[i] + (np.int64(1) << (2 * (DEPTH - self.depth[i])))), i, -1)

    def _gaps(self, x, y, lo, depth):
        """Of cells: the distances of points to the near and the far side, on either axis."""
        s = self.side / 2.0**depth
        cx, cy = self.x0 + _gather(lo) * (self.side / 2.0**DEPTH), self.y0 + _gather(lo >> 1) * (self.side / 2.0**DEPTH)
        near = [np.maximum(0.0, np.maximum(c - v, v - (c + s))) for v, c in ((x, cx), (y, cy))]
        far = [np.maximum(np.abs(v - c), np.abs(v - (c + s))) for v, c in ((x, cx), (y, cy))]
        return near, far

    def bound(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, k: int) -> np.ndarray:
        """Squared radii that hold at least k of the group's points (all, if it has fewer): of the
        smallest cell around a point that holds so many, the distance to its far corner."""
        own = self.locate(z)
        deepest = np.where(own >= 0, self.depth[own], DEPTH)
        out, open_ = np.full(len(z), np.inf), np.ones(len(z), dtype=bool)
        for d in range(DEPTH, -1, -1):
            at = np.flatnonzero(open_ & (deepest >= d))
            if not len(at):
                continue
            lo = z[at] >> (2 * (DEPTH - d)) << (2 * (DEPTH - d))
            a, b = np.searchsorted(self.lo, lo), np.searchsorted(self.lo, lo + (np.int64(1) << (2 * (DEPTH - d))))
            enough = (self.before[b] - self.before[a] >= k) | (d == 0)
            at, lo = at[enough], lo[enough]
            _, far = self._gaps(x[at], y[at], lo, np.full(len(at), float(d)))
            out[at] = far[0] ** 2 + far[1] ** 2
            open_[at] = False
        return out

    def within(self, x: np.ndarray, y: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, leaf) such that the leaf reaches into the circle of squared radius r2."""
        r2 = r2 * (1 + 1e-9) + 1e-300
        point, lo, depth = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), 0
        found = []
        while len(point):
            size = np.int64(1) << (2 * (DEPTH - depth))
            a, b = np.searchsorted(self.lo, lo), np.searchsorted(self.lo, lo + size)
            one = b - a == 1
            leaf = a[one]
            near, _ = self._gaps(x[point[one]], y[point[one]], self.lo[leaf], self.depth[leaf].astype(float))
            hit = near[0] ** 2 + near[1] ** 2 <= r2[point[one]]
            found.append((point[one][hit], leaf[hit]))
            many = b - a > 1
            point, lo = np.repeat(point[many], 4), (lo[many][:, None] + np.arange(4)[None] * (size >> 2)).ravel()
            depth += 1
            near, _ = self._gaps(x[point], y[point], lo, np.full(len(point), float(depth)))
            hit = near[0] ** 2 + near[1] ** 2 <= r2[point]
            point, lo = point[hit], lo[hit]
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def build(data: DataFrame, by: list[str], leaf: int = LEAF) -> tuple[dict[tuple, Leaves], int]:
    """The leaves of each group's points (by..., x, y, all finite) and the most points of a leaf
    above the last depth. Two levels a pass; a pass counts the points of cells still open."""
    n, x0, x1, y0, y1 = data.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        return {}, leaf
    side = max(x1 - x0, y1 - y0, abs(x0) * 1e-9, abs(y0) * 1e-9, 1e-300) * (1 + 1e-9)
    most = max(leaf, n // MOST_LEAVES)
    at = lambda c, v0: F.greatest(F.lit(0), F.least(F.lit(2**DEPTH - 1), F.floor((F.col(c) - v0) * (2.0**DEPTH / side)))).cast("long")
    coded = data.select(*by, at("x", x0).alias("cx"), at("y", y0).alias("cy"))
    done: list[pd.DataFrame] = []
    top = coded.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).toPandas().assign(cx=0, cy=0)
    level, open_ = 0, top[top["c"] > most]
    done.append(top[top["c"] <= most].assign(depth=0))
    while len(open_):
        step = min(2, DEPTH - level)
        if not step:
            done.append(open_.assign(depth=DEPTH))
            break
        cells = F.broadcast(data.sparkSession.createDataFrame(open_[[*by, "cx", "cy"]].rename(columns={"cx": "px", "cy": "py"}), data.select(*by, F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py")).schema))
        up, level = DEPTH - level, level + step
        rows = coded.withColumns({"px": F.shiftright("cx", up), "py": F.shiftright("cy", up), "cx": F.shiftright("cx", DEPTH - level), "cy": F.shiftright("cy", DEPTH - level)})
        c = rows.join(cells, [*by, "px", "py"], "left_semi").groupBy(*by, "cx", "cy").agg(F.count(F.lit(1)).alias("c")).toPandas()
        if step == 2:
            half = c.assign(cx=c["cx"] // 2, cy=c["cy"] // 2).groupby([*by, "cx", "cy"], as_index=False)["c"].sum()
            done.append(half[half["c"] <= most].assign(depth=level - 1))
            deep = half.loc[half["c"] > most, [*by, "cx", "cy"]].rename(columns={"cx": "hx", "cy": "hy"})
            c = c.assign(hx=c["cx"] // 2, hy=c["cy"] // 2).merge(deep, on=[*by, "hx", "hy"])[[*by, "cx", "cy", "c"]]
        done.append(c[c["c"] <= most].assign(depth=level))
        open_ = c[c["c"] > most]
    all_ = pd.concat([d for d in done if len(d)], ignore_index=True)
    out, first = {}, 0
    for key, g in all_.groupby(by, sort=True) if by else [((), all_)]:
        depth = g["depth"].to_numpy(np.int64)
        lo = (_spread(g["cx"].to_numpy(np.int64)) | (_spread(g["cy"].to_numpy(np.int64)) << 1)) << (2 * (DEPTH - depth))
        out[key] = Leaves(x0, y0, side, first, lo, depth, g["c"].to_numpy(np.int64))
        first += len(g)
    return out, most


def _groups(pdf: pd.DataFrame, by: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    if by:
        for key, at in pdf.groupby(by, sort=False).indices.items():
            yield key if isinstance(key, tuple) else (key,), at
    elif len(pdf):
        yield (), np.arange(len(pdf))


def _plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strings as objects: rows that were picked and put together would be chunked arrays else."""
    return pdf.astype({c: object for c in pdf.columns if pd.api.types.is_string_dtype(pdf[c].dtype)})


def _kind(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _finite(df: DataFrame, by: list[str]) -> DataFrame:
    ok = F.lit(True)
    for c in by:
        ok = ok & F.col(c).isNotNull()
    for c in ("x", "y"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return df.select(*by, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(ok)


def _pieces(rows: DataFrame, most: int, name: str) -> DataFrame:
    """leaf and how many tasks its rows are dealt over, of leaves with more than `most` rows: a
    small table, as there are at most rows / most of them."""
    return rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name)).filter(F.col(name) > 1)


def _meet(points: DataFrame, queries: DataFrame, run, shape: str) -> DataFrame:
    """run(queries, points) for every leaf, in parts of at most about QUERIES against DATA rows: rows
    of one side are dealt, those of the other copied to each part."""
    parts = cut(_pieces(points, DATA, "np").join(_pieces(queries, QUERIES, "nq"), "leaf", "full_outer").fillna(1))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.coalesce(F.col(n), F.lit(1))).cast("int")
    p = points.join(F.broadcast(parts), "leaf", "left").withColumns({"__s": spread("nq")}).withColumn("__t", deal("np")).drop("np", "nq")
    q = queries.join(F.broadcast(parts), "leaf", "left").withColumns({"__t": spread("np")}).withColumn("__s", deal("nq")).drop("np", "nq")
    return q.groupBy("leaf", "__s", "__t").cogroup(p.groupBy("leaf", "__s", "__t")).applyInPandas(run, shape)


def _nearest(q: pd.DataFrame, p: pd.DataFrame, k: int | None, include_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of a few queries its k nearest points within r2 (all, without k), ties by the order of
    p: numbers of query and point, and squared distances, queries in order, nearest first."""
    d2 = (p["x"].to_numpy()[None] - q["x"].to_numpy()[:, None]) ** 2 + (p["y"].to_numpy()[None] - q["y"].to_numpy()[:, None]) ** 2
    limit = q["r2"].to_numpy()
    if not include_self:
        d2[q["id"].to_numpy()[:, None] == p["id"].to_numpy()[None]] = np.inf
    if k is not None and k < d2.shape[1]:
        limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1])
    row, col = np.nonzero((d2 <= limit[:, None]) & (d2 < np.inf))
    e = d2[row, col]
    order = np.lexsort((col, e, row))
    row, col, e = row[order], col[order], e[order]
    if k is not None:
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col, e = row[keep], col[keep], e[keep]
    return row, col, e


def neighbours(data: DataFrame, query: DataFrame, by: list[str], k: int | None = None, radius: float | None = None, include_self: bool = True) -> DataFrame:
    """Pairs by..., qid, nid, d2 (and rank, with k) of each query (by..., id, x, y) with its k nearest points of data in
    its group, those within `radius` (inclusive), or both; ties by nid. Rows without a finite place
    or with a null group meet nothing.

    A query first meets the leaf it lies in; the k-th distance found there bounds how far it has to
    look, and only leaves that reach into that circle are met then."""
    data, query = cut(_finite(data, by)), _finite(query, by)
    nid, qid = data.schema["id"].dataType.simpleString(), query.schema["id"].dataType.simpleString()
    kinds = [f"`{c}` {query.schema[c].dataType.simpleString()}" for c in by]
    shape = ", ".join([*kinds, f"qid {qid}", f"nid {nid}", "d2 double"])
    tree, most = build(data, by)
    if not tree:
        return data.sparkSession.createDataFrame([], shape if k is None else f"{shape}, rank int")
    sent = data.sparkSession.sparkContext.broadcast(tree)
    far = float("inf") if radius is None else float(radius) * float(radius)
    reach = None if k is None else k + (not include_self)

    def place(batches):
        for pdf in batches:
            leaf = np.full(len(pdf), -1, dtype=np.int64)
            for key, at in _groups(pdf, by):
                t = sent.value[key]
                part = pdf.iloc[at]
                leaf[at] = t.first + t.locate(t.code(part["x"].to_numpy(), part["y"].to_numpy()))
            yield _plain(pdf.assign(leaf=leaf))

    def look(pdf: pd.DataFrame, t: Leaves, but: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        """The queries, once for each leaf that their circles reach (but one's own)."""
        for i in range(0, len(pdf), SLICE):
            part = pdf.iloc[i : i + SLICE]
            row, leaf = t.within(part["x"].to_numpy(), part["y"].to_numpy(), part["r2"].to_numpy())
            if but is not None:
                other = leaf != but[i : i + SLICE][row]
                row, leaf = row[other], leaf[other]
            yield part.iloc[row].assign(leaf=t.first + leaf)

    def start(batches):
        for pdf in batches:
            out = []
            for key, at in _groups(pdf, by):
                if (t := sent.value.get(key)) is None:
                    continue
                part = pdf.iloc[at]
                x, y = part["x"].to_numpy(), part["y"].to_numpy()
                z = t.code(x, y)
                own = t.locate(z) if reach is not None else np.full(len(part), -1)
                part = part.assign(r2=far if reach is None else np.minimum(far, t.bound(x, y, z, reach)), own=own >= 0)
                out.append(part[own >= 0].assign(leaf=t.first + own[own >= 0]))
                yield from (_plain(x[[*by, "id", "x", "y", "r2", "own", "leaf"]]) for x in look(part[own < 0], t))
            if out:
                yield _plain(pd.concat(out)[[*by, "id", "x", "y", "r2", "own", "leaf"]])

    def meet(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        p = p.sort_values("id", kind="stable").reset_index(drop=True)
        none = p["id"].iloc[0] if len(p) else None  # any id, where a row names no neighbour
        for i in range(0, len(q), 256):
            part = q.iloc[i : i + 256].reset_index(drop=True)
            row, col, e = _nearest(part, p, k, include_self)
            got = part.iloc[row][[*by, "id"]].rename(columns={"id": "qid"}).reset_index(drop=True)
            out.append(got.assign(nid=p["id"].to_numpy()[col], d2=e, x=np.nan, y=np.nan, r2=np.nan, leaf=-1))
            own = part["own"].to_numpy(bool)
            if k is None or not own.any() or part["__t"].iloc[0]:  # parts of one leaf's points would look alike
                continue
            found = np.bincount(row, minlength=len(part))
            r2 = part["r2"].to_numpy().copy()
            last = np.cumsum(found) - 1
            full = found >= k
            r2[full] = np.minimum(r2[full], e[last[full]])
            key = tuple(part[c].iloc[0] for c in by)
            t = sent.value[key]
            part = part.assign(r2=r2)[own]
            for more in look(part, t, part["leaf"].to_numpy() - t.first):
                out.append(more[[*by, "id", "x", "y", "r2", "leaf"]].rename(columns={"id": "qid"}).assign(nid=none, d2=np.nan))
        cols = [*by, "qid", "nid", "d2", "x", "y", "r2", "leaf"]
        return _plain(pd.concat([o[cols] for o in out], ignore_index=True)) if out else pd.DataFrame({c: pd.Series([], dtype=object) for c in cols})

    points = cut(data.mapInPandas(place, f"{_kind(data, *by, 'id', 'x', 'y')}, leaf long"))
    if k is not None:
        points = _thinned(points, by, k + 1, most)
    asked = cut(query.mapInPandas(start, f"{_kind(query, *by, 'id', 'x', 'y')}, r2 double, own boolean, leaf long"))
    wide = f"{shape}, x double, y double, r2 double, leaf long"
    first = _meet(points, asked, meet, wide)
    names = [*by, "qid", "nid", "d2"]
    if k is None:
        return first.select(*names)
    first = cut(first)
    again = first.filter("leaf >= 0").select(*by, F.col("qid").alias("id"), "x", "y", "r2", F.lit(False).alias("own"), "leaf")
    best = first.filter("leaf < 0").select(*names)
    if not again.isEmpty():
        best = best.unionByName(_meet(points, again, meet, wide).select(*names))
    order = Window.partitionBy(*by, "qid").orderBy("d2", "nid")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _thinned(points: DataFrame, by: list[str], most: int, full: int) -> DataFrame:
    """Points without those that cannot be among the nearest of any query: where a leaf could not be
    split, of the points in one place only the first `most` by id stay. They are cut in 256 parts of
    a place first, so a place of very many points is in no one task."""
    over = cut(points.groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > full).select("leaf"))
    if over.isEmpty():
        return points
    held = points.join(F.broadcast(over), "leaf", "left_semi")
    place = [*by, "x", "y"]
    for salt in ([F.pmod(F.xxhash64("id"), F.lit(256))], []):
        held = held.withColumn("rn", F.row_number().over(Window.partitionBy(*place, *salt).orderBy("id"))).filter(F.col("rn") <= most).drop("rn")
    return cut(points.join(F.broadcast(over), "leaf", "left_anti").unionByName(held))
