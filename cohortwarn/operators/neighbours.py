"""Exact k nearest neighbours as a partitioned join.

1. Copies: equal feature vectors are one point.  Of its rows only the k + 1
   smallest keys (of each class, where lists by class are asked for) can ever be in
   an answer, and a group limit keeps those before the shuffle, so a third of the
   table being copies of one row costs nothing.
2. Leaves: a k-d tree cut from a sample of bounded size routes the points to about
   as many blocks as a block has leaves; the tree of each block is cut from its own
   sample in a task.  Trees of blocks and boxes of leaves are tables, so the driver holds the square
   root of the number of leaves, and leaves never grow.  The trees only decide where
   points go; the answer does not depend on them.
3. Own leaf: each query point finds its nearest points inside its leaf.
4. Nearest boxes: a query point visits the few leaves of its block with the nearest
   bounding boxes, if these are not farther away than its best distance so far.
5. Other leaves: with the distance found by then, it visits the blocks, and in them
   the leaves, that may still hold something nearer.  A visitor brings the distance of
   each of its lists, and only what is as near comes back; a task merges the leaves it holds.
6. The lists are merged by distance, then key.

A :class:`Placement` is made once and answers several lists for the same query
points in one search, each over all points or those of one class.  In each pass a
leaf (or the leaves of one group) with many query points is split into several groups, so where
the query points cluster does not matter.

Leaves of fewer than ``LEAF_ROWS`` points share a group, since a group costs more than a small leaf.  No pair of points
leaves a task; a task holds one group and works in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cohortwarn.functions import hash_unit
from cohortwarn.session import stable

LEAF_ROWS = 4096
SAMPLE_PER_LEAF = 16
SAMPLE_ROWS = 4096
# Boxes that the first round of visits may go to.
FIRST_BOXES = 4
VISITORS = 8192
# Entries of a distance table; small enough for a core's cache.
_CELLS = 65_536
# Leaves of up to so many points are searched many at once, pair by pair, and so many pairs are held.
_SMALL, _PAIRS = 256, 262_144


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    # Adding 0.0 turns -0.0 into 0.0, so equal points are equal group keys.
    return df.withColumn("_vec", F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features]))


def _cut_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, threshold, left, right); a leaf is (-1, 0, number, 0)."""
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal count
        here = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        if want > 1 and len(rows) > 1:
            spread = rows.max(axis=0) - rows.min(axis=0)
            dim = int(spread.argmax())
            if spread[dim] > 0:
                values = np.sort(rows[:, dim])
                at = values[(len(values) - 1) // 2]
                if at == values[-1]:
                    at = values[np.searchsorted(values, at) - 1]
                low = rows[:, dim] <= at
                left = grow(rows[low], want // 2)
                right = grow(rows[~low], want - want // 2)
                nodes[here] = (dim, float(at), left, right)
                return here
        nodes[here] = (-1, 0.0, count, 0)
        count += 1
        return here

    grow(points, leaves)
    return nodes


def _descend(nodes: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    dim, at, left, right = nodes
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while (dim[node] >= 0).any():
        inner = dim[node] >= 0
        d = np.where(inner, dim[node], 0)
        step = np.where(x[rows, d] <= at[node], left[node], right[node])
        node = np.where(inner, step, node)
    return left[node].astype(np.int32)


def _points(vec: pd.Series) -> np.ndarray:
    return np.stack(vec.to_numpy()) if len(vec) else np.zeros((0, 1))


def _route_udf(nodes: list[tuple[int, float, int, int]]):
    columns = [np.array(x) for x in zip(*nodes, strict=True)]

    @F.pandas_udf(IntegerType())
    def route(vec: pd.Series) -> pd.Series:
        return pd.Series(_descend(columns, _points(vec)))

    return route


def _block(width: int) -> int:
    """Rows per block, so that a distance table has about ``_CELLS`` entries whatever its width."""
    return max(1, min(1024, _CELLS // max(1, width)))


def _nearest(q: np.ndarray, r: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (query row, reference row, squared distance), k best per query row.

    ``r`` is in key order, so ties keep the smaller key.
    """
    k = min(k, len(r))
    size = _block(len(r))
    columns = np.ascontiguousarray(r.T)
    table, side = np.empty((2, min(size, len(q)), len(r)))
    for start in range(0, len(q), size):
        block = q[start : start + size]
        d2, gap = table[: len(block)], side[: len(block)]
        d2[:] = 0.0
        for j in range(q.shape[1]):
            np.subtract(block[:, j, None], columns[j], out=gap)
            d2 += np.square(gap, out=gap)
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(d2 <= kth[:, None])
        dist = d2[rows, cols]
        order = np.lexsort((cols, dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        first = np.searchsorted(rows, np.arange(len(block)))
        keep = np.arange(len(rows)) - first[rows] < k
        yield rows[keep] + start, cols[keep], dist[keep]


def _first_of_each(qi: np.ndarray, ri: np.ndarray, d2: np.ndarray, rank: np.ndarray, k: int):
    """The k best pairs of each query row, by distance, then rank."""
    order = np.lexsort((rank[ri], d2, qi))
    qi, ri, d2 = qi[order], ri[order], d2[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[keep], ri[keep], d2[keep]


def _pairs(asked: np.ndarray, points: np.ndarray, qi: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Parts of (query row, reference row, squared distance): each query row with the run of references it visits."""
    upto = np.cumsum(size)
    at = 0
    while at < len(qi):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, side="right")))
        n = size[at:end]
        before = np.cumsum(n) - n
        rows = np.repeat(qi[at:end], n)
        of = np.arange(n.sum()) + np.repeat(start[at:end] - before, n)
        d2 = np.zeros(len(rows))
        for j in range(points.shape[1]):
            d2 += np.square(asked[rows, j] - points[of, j])
        yield rows, of, d2
        at = end


def _search(lists: Sequence[tuple[float | None, int]]):
    """Nearest points within the visited leaves, for each list (class or None, how many); a group holds several leaves.

    A query point has a row with its own leaf, or with ``_leaves``, all those it visits in the group, and ``_bounds``, the
    distance beyond which nothing is wanted in each list.
    """
    columns = ["_vec", "_list", "_d2", "_key", "_tag", "_nvec"]

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            r = r.sort_values("_key", kind="stable", na_position="first").assign(_rank=np.arange(len(r)))
            r = r.sort_values("_leaf", kind="stable")
            points, asked, tags, rank = _points(r["_vec"]), _points(q["_vec"]), r["_tag"].to_numpy(), r["_rank"].to_numpy()
            bounds = _points(q["_bounds"]) if "_bounds" in q else np.full((len(q), len(lists)), np.inf)
            leaves = q["_leaves"].to_numpy() if "_leaves" in q else q["_leaf"].to_numpy()[:, None]
            leaf, qi = np.concatenate(leaves), np.repeat(np.arange(len(q)), [len(x) for x in leaves])
            held, first, sizes = np.unique(r["_leaf"].to_numpy(), return_index=True, return_counts=True)
            at = np.minimum(np.searchsorted(held, leaf), len(held) - 1)
            qi, at = qi[held[at] == leaf], at[held[at] == leaf]
            found = [[] for _ in lists]
            small = sizes[at] <= _SMALL
            for rows, of, d2 in _pairs(asked, points, qi[small], first[at[small]], sizes[at[small]]):
                for no, (tag, k) in enumerate(lists):
                    near = d2 <= bounds[rows, no]
                    if tag is not None:
                        near &= tags[of] == tag
                    found[no].append(_first_of_each(rows[near], of[near], d2[near], rank, k))
            for run_ in np.unique(at[~small]):
                mine, of_leaf = qi[at == run_], np.arange(first[run_], first[run_] + sizes[run_])
                for no, (tag, k) in enumerate(lists):
                    of = of_leaf if tag is None else of_leaf[tags[of_leaf] == tag]
                    for rows, ri, d2 in _nearest(asked[mine], points[of], k) if len(of) else ():
                        near = d2 <= bounds[mine[rows], no]
                        found[no].append((mine[rows[near]], of[ri[near]], d2[near]))
            for no, (_, k) in enumerate(lists):
                if found[no]:
                    qs, ri, d2 = _first_of_each(*(np.concatenate(x) for x in zip(*found[no], strict=True)), rank, k)
                    hit = r.iloc[ri]
                    out.append(pd.DataFrame({
                        "_vec": q["_vec"].to_numpy()[qs], "_list": no, "_d2": d2, "_key": hit["_key"].to_numpy(),
                        "_tag": hit["_tag"].to_numpy(), "_nvec": hit["_vec"].to_numpy(),
                    }))
        if not out:
            return pd.DataFrame(columns=columns, dtype=object)
        return pd.concat(out, ignore_index=True)

    return run


def _gaps(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    gap = np.zeros((len(x), len(lo)))
    for j in range(x.shape[1]):
        v = x[:, j, None]
        gap += np.maximum(np.maximum(lo[None, :, j] - v, v - hi[None, :, j]), 0.0) ** 2
    return gap


def _within(gap: np.ndarray, reach: pd.Series) -> np.ndarray:
    # The slack covers rounding in the two distance sums.
    return gap <= reach.to_numpy()[:, None] * (1 + 1e-9)


def _blocks_in_reach(boxes: pd.DataFrame):
    """Query points beside each block that may hold a nearer point."""
    block, lo, hi = boxes["_block"].to_numpy(), np.stack(boxes["_lo"].to_numpy()), np.stack(boxes["_hi"].to_numpy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), _block(len(block))):
                part = pdf.iloc[start : start + _block(len(block))]
                rows, cols = np.nonzero(_within(_gaps(_points(part["_vec"]), lo, hi), part["_reach"]))
                yield part.iloc[rows].assign(_at=block[cols])

    return run


def _leaves_in_reach(first: bool, bundle: int):
    """For query points in one block: its leaves that may hold a nearer point, the nearest boxes or the rest.

    One row for each query point and bundle of leaves: ``_leaves``, and the first of them as ``_leaf``.
    """

    def run(q: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"_vec": [], "_block": [], "_leaf": [], "_leaves": [], "_bounds": []}, dtype=object)]
        if len(q) and len(boxes):
            boxes = boxes.sort_values("_leaf")  # one order in both rounds, however the boxes arrive
            leaf, at = boxes["_leaf"].to_numpy(), int(boxes["_block"].iloc[0])
            lo, hi = np.stack(boxes["_lo"].to_numpy()), np.stack(boxes["_hi"].to_numpy())
            for start in range(0, len(q), _block(len(leaf))):
                part = q.iloc[start : start + _block(len(leaf))]
                gap = _gaps(_points(part["_vec"]), lo, hi)
                home = part["_block"].to_numpy() == at
                own = home[:, None] & (leaf[None, :] == part["_leaf"].to_numpy()[:, None])
                # Round one went to the nearest boxes of the point's own block.
                order = np.argsort(np.where(own[home], np.inf, gap[home]), axis=1, kind="stable")[:, :FIRST_BOXES]
                nearest = np.zeros_like(own)
                nearest[np.flatnonzero(home)[:, None], order] = True
                rows, cols = np.nonzero(_within(gap, part["_reach"]) & ~own & (nearest if first else ~nearest))
                if len(rows):
                    held = leaf[cols] // bundle
                    begin = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(held, prepend=-1) != 0))
                    out.append(pd.DataFrame({
                        "_vec": part["_vec"].to_numpy()[rows[begin]], "_block": at, "_leaf": leaf[cols[begin]],
                        "_leaves": np.split(leaf[cols], begin[1:]), "_bounds": part["_bounds"].to_numpy()[rows[begin]],
                    }))
        return pd.concat(out, ignore_index=True)

    return run


def _paired(guests: DataFrame, hosts: DataFrame, place: Sequence[str], visitors: int):
    """Both sides grouped by place, a place with many guests being held by several groups."""
    # One row for each place.
    parts = guests.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / visitors).cast("int").alias("_parts"))
    guests = guests.join(parts, list(place)).withColumn("_slot", F.pmod(F.xxhash64("_vec"), F.col("_parts")).cast("int"))
    hosts = hosts.join(parts, list(place)).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return guests.drop("_parts").groupBy(*place, "_slot").cogroup(hosts.drop("_parts").groupBy(*place, "_slot"))


class Placement:
    """Reference points dealt out to leaves, for any number of searches.

    ``most`` is the longest list that will be asked for; with ``tag`` lists may be limited to one class.
    """

    def __init__(
        self,
        references: DataFrame,
        key: str,
        features: Sequence[str],
        most: int,
        tag: str | None = None,
        leaf_rows: int = LEAF_ROWS,
        visitors: int = VISITORS,
    ):
        self.key, self.features, self.most = key, list(features), most
        # Small leaves share a group: so many that a group has about LEAF_ROWS points, and as many times the visitors.
        self.bundle = max(1, LEAF_ROWS // leaf_rows)
        self.visitors = visitors * self.bundle
        tag_col = F.col(tag).cast("double") if tag else F.lit(None).cast("double")
        points = _vectors(references, features).select("_vec", F.col(key).alias("_key"), tag_col.alias("_tag"))
        spec = Window.partitionBy("_vec", "_tag").orderBy("_key")
        points = points.withColumn("_rn", F.row_number().over(spec)).filter(F.col("_rn") <= most + 1).drop("_rn")
        self.points = stable(points, "points")
        # Rows of each class and in all: as many rows as there are classes.
        self.sizes = {r[0]: r[1] for r in self.points.groupBy("_tag").count().collect()}
        n = sum(self.sizes.values())
        self.leaves = max(1, math.ceil(n / leaf_rows))
        if self.leaves == 1:
            self.placed = self.points
            return
        blocks = math.isqrt(self.leaves - 1) + 1
        sample = self.points.filter(hash_unit("leaf", F.col("_key")) < F.lit(min(1.0, max(blocks * SAMPLE_PER_LEAF, SAMPLE_ROWS) / n)))
        # Bounded: about SAMPLE_PER_LEAF points for each block.
        vecs = sample.select("_vec").toPandas()["_vec"]
        self.route = _route_udf(_cut_tree(_points(vecs) if len(vecs) else np.zeros((1, len(features))), blocks))
        routed = stable(self.points.withColumn("_block", self.route("_vec")), "routed")
        self.trees = stable(self._trees(routed, leaf_rows, n), "trees")
        self.placed = stable(self._in_leaves(routed), "placed")
        corner = lambda f, c: F.array(*[f(F.col(c)[j]) for j in range(len(features))])
        self.boxes = stable(self.placed.groupBy("_block", "_leaf").agg(
            corner(F.min, "_vec").alias("_lo"), corner(F.max, "_vec").alias("_hi")), "boxes")
        # Bounded by the number of blocks.
        self.block_boxes = self.boxes.groupBy("_block").agg(
            corner(F.min, "_lo").alias("_lo"), corner(F.max, "_hi").alias("_hi")).toPandas()

    def _trees(self, routed: DataFrame, leaf_rows: int, n: int) -> DataFrame:
        sizes = routed.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / leaf_rows).cast("int").alias("_leaves"))
        share = min(1.0, max(self.leaves * SAMPLE_PER_LEAF, SAMPLE_ROWS) / n)
        sample = routed.filter(hash_unit("leaf2", F.col("_key")) < F.lit(share)).select("_block", "_vec").join(sizes, "_block")

        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            nodes = _cut_tree(_points(pdf["_vec"]), int(pdf["_leaves"].iloc[0]))
            return pd.DataFrame([[int(pdf["_block"].iloc[0]), *map(list, zip(*nodes, strict=True))]],
                                columns=["_block", "dim", "at", "left", "right"])

        return sample.groupBy("_block").applyInPandas(
            cut, "_block int, dim array<int>, at array<double>, left array<int>, right array<int>")

    def _in_leaves(self, routed: DataFrame) -> DataFrame:
        names = [f.name for f in routed.schema]

        def run(q: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            q = q[names]
            if not len(tree):  # no sampled point fell into the block: it is one leaf
                return q.assign(_leaf=0)
            nodes = [np.asarray(tree[c].iloc[0]) for c in ("dim", "at", "left", "right")]
            return q.assign(_leaf=_descend(nodes, _points(q["_vec"])))

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in routed.schema)
        return _paired(routed, self.trees, ["_block"], self.visitors).applyInPandas(run, f"{fields}, _leaf int")

    def search(self, queries: DataFrame, lists: Mapping[str, tuple[float | None, int]]) -> DataFrame:
        """``queries`` plus a column for each of ``lists``: name -> (class or None for all, how many).

        A list is an array of structs ``(d2, key, tag, vec)`` ordered by squared distance, then key; the row itself is
        not in it.  It is shorter than asked for only if there are no more points.
        """
        if max(k for _, k in lists.values()) > self.most:
            raise ValueError(f"the placement answers lists of up to {self.most} neighbours")
        wants = [(tag, k + 1) for tag, k in lists.values()]
        # So many of each list have to be found before a distance bounds it.
        need = [min(kk, sum(self.sizes.values()) if tag is None else self.sizes.get(tag, 0)) for tag, kk in wants]
        key_type = self.points.schema["_key"].dataType.simpleString()
        schema = f"_vec array<double>, _list int, _d2 double, _key {key_type}, _tag double, _nvec array<double>"
        asked = _vectors(queries, self.features)
        targets = asked.select("_vec").distinct()
        if self.leaves == 1:
            targets = stable(targets, "targets")
            parts = max(1, math.ceil(targets.count() / self.visitors))
            guests = targets.withColumn("_slot", F.pmod(F.xxhash64("_vec"), F.lit(parts)).cast("int"))
            hosts = self.placed.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            guests, hosts = (x.withColumn("_leaf", F.lit(0)) for x in (guests, hosts))
            found = guests.groupBy("_slot").cogroup(hosts.groupBy("_slot")).applyInPandas(_search(wants), schema)
        else:
            targets = stable(self._in_leaves(targets.withColumn("_block", self.route("_vec"))), "targets")
            found = self._search_leaves(targets, wants, schema)
            for first in (True, False):
                found = stable(found, "found")
                reach = self._reach(targets, found, need)
                at = reach.withColumn("_at", F.col("_block")) if first else reach.mapInPandas(
                    _blocks_in_reach(self.block_boxes),
                    "_vec array<double>, _block int, _leaf int, _bounds array<double>, _reach double, _at int")
                boxes = self.boxes.withColumn("_at", F.col("_block"))
                visits = _paired(stable(at, "at"), boxes, ["_at"], self.visitors).applyInPandas(
                    _leaves_in_reach(first, self.bundle),
                    "_vec array<double>, _block int, _leaf int, _leaves array<int>, _bounds array<double>")
                found = found.unionByName(self._search_leaves(stable(visits, "visits"), wants, schema))

        best = Window.partitionBy("_vec", "_list").orderBy("_d2", "_key")
        entry = F.struct(F.col("_rn"), F.col("_d2").alias("d2"), F.col("_key").alias("key"), F.col("_tag").alias("tag"),
                         F.col("_nvec").alias("vec"))
        most = max(kk for _, kk in wants)
        merged = found.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= most).groupBy("_vec").agg(*[
            F.sort_array(F.collect_list(F.when(F.col("_list") == i, entry))).alias(f"_list{i}") for i in range(len(wants))])

        def tidy(i: int, name: str, k: int):
            others = F.filter(f"_list{i}", lambda e: e["key"] != F.col(self.key))
            return F.transform(F.slice(others, 1, k), lambda e: F.struct(e["d2"], e["key"], e["tag"], e["vec"])).alias(name)

        columns = [tidy(i, name, k) for i, (name, (_, k)) in enumerate(lists.items())]
        return asked.join(merged, "_vec", "left").select(*queries.columns, *columns)

    def _search_leaves(self, travel: DataFrame, wants: Sequence[tuple[float | None, int]], schema: str) -> DataFrame:
        bundle = F.floor(F.col("_leaf") / self.bundle).cast("int").alias("_bundle")
        guests, hosts = travel.select("*", bundle), self.placed.select("*", bundle)
        return _paired(guests, hosts, ["_block", "_bundle"], self.visitors).applyInPandas(_search(wants), schema)

    @staticmethod
    def _reach(targets: DataFrame, found: DataFrame, need: Sequence[int]) -> DataFrame:
        """Query points with the distance within which a point missing in a list would have to lie, and in any list."""
        enough = F.element_at(F.array(*[F.lit(x) for x in need]), F.col("_list") + 1)
        by_rank = Window.partitionBy("_vec", "_list").orderBy("_d2")
        best = found.select("_vec", "_list", "_d2").withColumn("_rn", F.row_number().over(by_rank)).filter(F.col("_rn") <= enough)
        full = best.groupBy("_vec", "_list").agg(F.max("_d2").alias("_far"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= enough)
        reach = full.groupBy("_vec").agg(*[F.max(F.when(F.col("_list") == i, F.col("_far"))).alias(f"_far{i}") for i in range(len(need))])
        # A list without any point has nothing to look for.
        bounds = F.array(*[F.coalesce(f"_far{i}", F.lit(float("inf"))) if x else F.lit(-1.0) for i, x in enumerate(need)])
        return targets.join(reach, "_vec", "left").select(*targets.columns, bounds.alias("_bounds")).withColumn(
            "_reach", F.array_max("_bounds"))


def nearest_neighbours(
    queries: DataFrame,
    references: DataFrame,
    key: str,
    features: Sequence[str],
    k: int,
    tag: str | None = None,
    leaf_rows: int = LEAF_ROWS,
    visitors: int = VISITORS,
) -> DataFrame:
    """The k nearest reference rows of each query row, itself excluded.

    Adds to ``queries`` the column ``neighbours``: an array of structs
    ``(d2, key, tag, vec)`` ordered by squared distance, then key.  The query
    rows must be among the references or share no key with them; the features
    have no missing values.  Both inputs are read several times: hand in stable
    tables.  Fewer than ``k`` entries come back only if the table has no more.
    """
    placement = Placement(references, key, features, k, tag, leaf_rows, visitors)
    return placement.search(queries, {"neighbours": (None, k)})
