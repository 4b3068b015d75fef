"""Problem 1: the most similar vectors for every vector, by NN-descent.

Vectors of equal direction form one node, so a hot group of copies, scaled or not, costs one. A forest of random-projection
trees, fitted on a bounded sample and applied to every node, deals the nodes into leaves; the
nodes of a leaf are compared with one another and give the first neighbour graph. Further forests of
other planes and wider leaves better it at a cost in proportion to the nodes, which leaves few rounds of what follows. Then the graph
is joined with itself: for each block of nodes, the lists of their neighbours, then the vectors of
neighbours of neighbours, are brought in by two Spark joins, and every better neighbour found
goes into the lists of both its ends. By the triangle inequality of angles, most neighbours' neighbours can't be among the first K + 1 of
a node; they are not compared with it. That leaves out none that could be among its own first, but may leave out that it is among the first
of the other, which the other's own candidates must find. This repeats until few lists change, however many rounds that takes. ``search`` answers other queries by greedy search along the graph: the best nodes not yet opened are joined with the graph,
round by round.

Every comparison is of the exact cosine, in doubles and rounded to nine decimals, which lists hold as
whole billionths; equal ones go by the smaller id, in lists and among candidates too. So the members
of a dense group are told apart, and what a list holds needs no ranking again.

Bounds: the forest is fitted on at most SAMPLE vectors, and every vector is indexed.

Defined results: a vector that is null, of another length, not finite or all zero is left out, as
are nodes without id; equal ids are one; ties go to the smaller id; a collection of fewer than k + 1
vectors gives each all the others; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, release

DIM = 64
K = 10
LIST = 32
TREES = 4
LEAF = 1536
FORESTS = 3  # the later ones, of three quarters of the trees, until few lists change
WIDER = 8 / 3  # leaves of the later ones
SAMPLE = 16_384
TASK_ROWS = 40_000
BLOCK = 8_192
AT_ONCE = 3  # blocks are taken in turns that bring in about so many times the table
SETTLED = 0.01
UNIT = 1_000_000_000  # a cosine is held in billionths
NONE = -2_000_000_000  # below any cosine
SLACK = 0.004  # above the error of three angles held in half precision, so rounding leaves none out
CELLS = 1 << 23  # of a table of nodes by candidates
BEAM = 32
ENTRIES = 8
DOOR_TREES = 2


def usable(df: DataFrame, vector: str, dim: int = DIM) -> DataFrame:
    """Rows whose vector has exactly ``dim`` finite numbers, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0))


def _pack_vectors(dim: int):
    """(id, v) -> (id, digest, raw): float32 bytes, and 128 bits that stand for their direction where only equality counts.

    Quotients of float32 numbers are equal in doubles only where they are equal, so scaled copies have one digest, others don't.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)  # -0 as 0
            rows = flat.reshape(-1, dim)
            raw = [r.tobytes() for r in rows]
            digest = [xxhash.xxh3_128_digest(r.tobytes()) for r in _shares(rows)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["id", "digest", "raw"])

    return run


def _shares(v: np.ndarray) -> np.ndarray:
    """Rows as shares of their largest number, so that no square over- or underflows."""
    v = v.astype(np.float64)
    return v / np.abs(v).max(axis=1, keepdims=True) if len(v) else v


def _doubles(raw: list[bytes], dim: int) -> np.ndarray:
    v = _shares(np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim))
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _billionths(cosines: np.ndarray) -> np.ndarray:
    return np.rint(cosines * UNIT)


def nodes(df: DataFrame, vector: str, id_: str, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """Members (id, node) and nodes (node, raw, first): a node is the least id of a set of vectors of equal direction, ``first`` its K + 1 least ids."""
    rows = usable(df, vector, dim).where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    packed = cut(rows.mapInArrow(_pack_vectors(dim), "id long, digest binary, raw binary"))
    one = packed.groupBy("id").agg(F.min("digest").alias("digest"))
    least = one.groupBy("digest").agg(F.min("id").alias("node"))
    members = cut(one.join(least, "digest").select("id", "node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    few = members.withColumn("k", rank).where(F.col("k") <= K + 1).groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("first"))
    held = packed.join(least.select(F.col("node").alias("id"), "digest"), ["id", "digest"]).groupBy(F.col("id").alias("node")).agg(F.first("raw").alias("raw"))
    return members, cut(held.join(few, "node"))


class Forest:
    """Trees of hyperplanes between two sampled points; a leaf is a number."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            planes, kids, leaves = [], [], 0
            todo = [(np.arange(len(sample)), -1, 0, 0)]
            while todo:
                rows, parent, side, depth = todo.pop()
                plane = self.halve(sample[rows], rng) if len(rows) > leaf and depth < 24 else None
                if plane is None:
                    at, leaves = -1 - leaves, leaves + 1
                else:
                    at = len(planes)
                    planes.append(plane)
                    kids.append([0, 0])
                    right = sample[rows] @ plane > 0
                    todo += [(rows[~right], at, 0, depth + 1), (rows[right], at, 1, depth + 1)]
                if parent >= 0:
                    kids[parent][side] = at
            self.trees.append((np.array(planes, np.float64), np.array(kids, np.int64)))

    def leaves(self, tree: int) -> int:
        return len(self.trees[tree][0]) + 1

    @staticmethod
    def halve(x: np.ndarray, rng: np.random.Generator, tries: int = 4) -> np.ndarray | None:
        """The plane between two random points that divides most evenly, None if none divides."""
        best, even = None, 0.02
        for _ in range(tries):
            a, b = rng.choice(len(x), 2, replace=False)
            plane = x[a] - x[b]
            share = float((x @ plane > 0).mean())
            if min(share, 1 - share) > even:
                best, even = plane, min(share, 1 - share)
        return best

    def leaf(self, tree: int, x: np.ndarray) -> np.ndarray:
        planes, kids = self.trees[tree]
        if not len(planes):
            return np.zeros(len(x), np.int64)
        at = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):
            side = (np.einsum("ij,ij->i", x[live], planes[at[live]]) > 0).astype(np.int64)
            at[live] = kids[at[live], side]
            live = live[at[live] >= 0]
        return -1 - at


def _local_leaves(x: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows in groups of at most ``most``, halved by planes, or by lot where no plane divides."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        plane = Forest.halve(x[rows], rng)
        right = x[rows] @ plane > 0 if plane is not None else rng.permutation(len(rows)) * 2 < len(rows)
        todo += [rows[~right], rows[right]]
    return out


def _best(scores: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` highest scores, in billionths, of each row, in no order; of equal ones the first columns."""
    wide = scores.shape[1]
    if wide <= keep:
        return np.broadcast_to(np.arange(wide), scores.shape)
    power = 1 << 21  # score and column together are below 2 ** 53, thus exact
    return np.argpartition(np.arange(wide) - scores * power, keep - 1, axis=1)[:, :keep]


def _first_lists(dim: int, keep: int, leaf: int, together: int, first: bool):
    """Lists from within a leaf; of a later forest, only what surpasses the last entry of a node's list so far, or is in it."""
    size = 4 * dim

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, load = t.column("node").to_numpy(), t.column("load").to_pylist()
        x = _doubles([y[:size] for y in load], dim)
        order = np.argsort(ids)  # the result doesn't depend on the order rows arrive in
        ids, x = ids[order], x[order]
        if not first:
            worst = np.frombuffer(b"".join(y[size : size + 4] for y in load), np.int32)[order]
            last = np.frombuffer(b"".join(y[size + 4 :] for y in load), np.int64)[order]
        tree, group, salt = (k.as_py() for k in key)
        rng = np.random.default_rng([tree, group, salt])
        who, home, nb, sims = [], [], [], []
        for n, rows in enumerate(_local_leaves(x, leaf, rng)):
            local, own = x[rows], ids[rows]
            part = n // max(1, BLOCK // leaf) if len(ids) > BLOCK else 0
            block = ((group // together) << 40) + (salt << 16) + part
            for a in range(0, len(rows), 512):
                s = local[a : a + 512] @ local.T
                if not first:
                    least, edge = worst[rows[a : a + 512]], last[rows[a : a + 512]]
                    r, c = np.nonzero(s >= (least[:, None] - 1.0) / UNIT)
                    val = _billionths(s[r, c]).astype(np.int32)
                    ok = (c != r + a) & ((val > least[r]) | ((val == least[r]) & (own[c] < edge[r])))
                    r, c, val = r[ok], c[ok], val[ok]
                    order = np.lexsort((c, -val, r))  # columns are in order of id
                    r, c, val = r[order], c[order], val[order]
                    ends = np.searchsorted(r, np.arange(len(s) + 1))
                    for i in np.flatnonzero(np.diff(ends)):
                        take = slice(ends[i], min(ends[i + 1], ends[i] + keep))
                        who.append(own[a + i])
                        nb.append(own[c[take]])
                        sims.append(val[take])
                    continue
                s = _billionths(s)
                s[np.arange(len(s)), np.arange(a, a + len(s))] = NONE
                top = _best(s, min(keep, max(1, len(rows) - 1)))
                val = np.take_along_axis(s, top, 1)
                for i in range(len(s)):
                    ok = val[i] > NONE
                    who.append(own[a + i])
                    nb.append(own[top[i][ok]])
                    sims.append(val[i][ok].astype(np.int32))
                home.append(np.full(len(s), block))
        return pa.table(
            {
                "node": pa.array(np.array(who, np.int64)),
                "home": pa.array(np.concatenate(home) if first and tree == 0 else np.full(len(who), -1), pa.int64()),
                "nb": pa.array([x.tobytes() for x in nb], pa.binary()),
                "sim": pa.array([x.tobytes() for x in sims], pa.binary()),
            }
        )

    return run


def _angles(sim: bytes) -> np.ndarray:
    return np.arccos(np.clip(np.frombuffer(sim, np.int32) / UNIT, -1, 1)).astype(np.float16)


def _merge_lists(keep: int):
    """Lists of one node from several makers into one, best first; ``changed`` counts entries the first list lacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nb_out, sim_out, changed = [], [], []
            for nb, sim, old in zip(b.column("nbs").to_pylist(), b.column("sims").to_pylist(), b.column("old").to_pylist()):
                ids = np.frombuffer(b"".join(nb), np.int64)
                s = np.frombuffer(b"".join(sim), np.int32)
                ids, first = np.unique(ids, return_index=True)
                s = s[first]
                top = np.lexsort((ids, -s))[:keep]
                nb_out.append(ids[top].tobytes())
                sim_out.append(s[top].tobytes())
                changed.append(len(top) if old is None else int((~np.isin(ids[top], np.frombuffer(old, np.int64))).sum()))
            angles = [_angles(y).tobytes() for y in sim_out]
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("home"), pa.array(nb_out, pa.binary()), pa.array(sim_out, pa.binary()), pa.array(angles, pa.binary()), pa.array(changed, pa.int32())],
                ["node", "home", "nb", "sim", "angles", "changed"],
            )

    return run


def _reach(key: tuple, t: pa.Table) -> pa.Table:
    """The distinct ids in the lists of one block."""
    ids = np.unique(np.frombuffer(b"".join(t.column("nb").to_pylist()), np.int64))
    return pa.table({"home": pa.array(np.full(len(ids), key[0].as_py()), pa.int64()), "node": pa.array(ids, pa.int64())})


def _padded(load: list[bytes], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids and their angles as two matrices; of those shorter than ``keep`` the other angles are not finite."""
    ids, angles = np.zeros((len(load), keep), np.int64), np.full((len(load), keep), np.nan, np.float32)
    sizes = np.array([len(y) // 10 for y in load], np.int64)
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        held = np.frombuffer(b"".join(load[i] for i in at), np.uint8).reshape(len(at), 10 * n)
        ids[at, :n] = np.ascontiguousarray(held[:, : 8 * n]).view(np.int64)
        angles[at, :n] = np.ascontiguousarray(held[:, 8 * n :]).view(np.float16)
    return ids, angles


def _both(keep: int, sure: int):
    """What one block needs: its nodes (kind 0) with their candidates' places among the nodes whose vectors it needs (kind 2), in order of id.

    A candidate is in the list of a neighbour and so near or far from it, by the triangle inequality, that it may be among the ``sure`` first.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kind, node, load = t.column("kind").to_numpy(), t.column("node").to_numpy(), t.column("load").to_pylist()
        mine, near = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        near = near[np.argsort(node[near])]
        own, own_angles = _padded([load[i] for i in mine], keep)
        nb, nb_angles = _padded([load[i] for i in near], keep)
        own_there, nb_there = np.isfinite(own_angles), np.isfinite(nb_angles)
        ids, place = np.unique(np.concatenate([nb[nb_there], own[own_there], node[mine]]), return_inverse=True)
        nb_at, own_at = (np.full(m.shape, len(ids)) for m in (nb, own))  # one place more, which is nobody's
        ends = np.cumsum([nb_there.sum(), own_there.sum()])
        nb_at[nb_there], own_at[own_there], me = np.split(place, ends)
        bound = np.full(len(own), np.inf, np.float32)  # a list shorter than ``sure`` takes any
        if keep >= sure:
            full = own_there[:, sure - 1]
            bound[full] = own_angles[full, sure - 1] + np.float32(SLACK)
        to = np.searchsorted(node[near], own)  # every neighbour has a list
        each, step = [], max(1, CELLS // len(ids))
        for a in range(0, len(own), step):
            part = slice(a, a + step)
            rows, far = np.arange(len(own[part])), own_angles[part]
            table = np.zeros((len(rows), len(ids) + 1), bool)
            for c in range(keep):
                r = np.flatnonzero(own_there[part][:, c])
                if len(r):
                    at = to[part][r, c]
                    i, j = np.nonzero(np.abs(far[r, c][:, None] - nb_angles[at]) <= bound[part][r][:, None])
                    table[r[i], nb_at[at[i], j]] = True
            table[rows[:, None], own_at[part]] = False
            table[rows, me[part]] = False
            table[:, -1] = False
            r, c = np.nonzero(table)
            each += np.split(c, np.searchsorted(r, rows[1:]))
        needed = np.zeros(len(ids), bool)
        needed[me] = True
        for c in each:
            needed[c] = True
        place = (np.cumsum(needed) - 1).astype(np.int32)
        out = ids[needed]
        return pa.table(
            {
                "home": pa.array(np.full(len(mine) + len(out), key[0].as_py()), pa.int64()),
                "kind": pa.array(np.repeat([0, 2], [len(mine), len(out)]), pa.int32()),
                "node": pa.array(np.concatenate([node[mine], out]), pa.int64()),
                "load": pa.array([place[c].tobytes() for c in each] + [None] * len(out), pa.binary()),
            }
        )

    return run


def _pairs_of(df: DataFrame) -> DataFrame:
    """(home, node), distinct: the nodes that the lists of each block name."""
    return df.select("home", "nb").groupBy("home").applyInArrow(_reach, "home long, node long")


def _descend(dim: int, keep: int):
    """One block: the candidates of its nodes, and the vectors of both; better neighbours come out for both ends."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kind, node = t.column("kind").to_numpy(), t.column("node").to_numpy()
        load = t.column("load").to_pylist()
        at = np.flatnonzero(kind == 2)
        at = at[np.argsort(node[at])]
        ids = node[at]
        size = 4 * dim
        x = _doubles([load[i][:size] for i in at], dim)
        worst = np.frombuffer(b"".join(load[i][size : size + 4] for i in at), np.int32)
        last = np.frombuffer(b"".join(load[i][size + 4 :] for i in at), np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(kind == 0):
            j = np.frombuffer(load[k], np.int32)
            if not len(j):
                continue
            i = int(np.searchsorted(ids, node[k]))
            s = _billionths(x[j] @ x[i]).astype(np.int32)
            for to, frm in ((i, j), (j, i)):
                good = np.flatnonzero((s > worst[to]) | ((s == worst[to]) & (ids[frm] < last[to])))
                if len(good):
                    pairs.append((*(np.full(len(good), y) if np.ndim(y) == 0 else y[good] for y in (to, frm)), s[good]))
        who, nb, sims = [], [], []
        if pairs:
            to, frm, val = (np.concatenate(c) for c in zip(*pairs))
            order = np.lexsort((frm, -val, to))  # places are in order of id
            to, frm, val = to[order], frm[order], val[order]
            fresh = np.append(True, (to[1:] != to[:-1]) | (frm[1:] != frm[:-1]))  # two of one block may find each other
            to, frm, val = to[fresh], frm[fresh], val[fresh]
            starts = np.flatnonzero(np.diff(to, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(to))):
                take = slice(a, min(b, a + keep))
                who.append(int(ids[to[a]]))
                nb.append(ids[frm[take]].tobytes())
                sims.append(val[take].tobytes())
        return pa.table({"node": pa.array(who, pa.int64()), "nb": pa.array(nb, pa.binary()), "sim": pa.array(sims, pa.binary())})

    return run


def graph(points: DataFrame, dim: int = DIM, keep: int = LIST, trees: int = TREES, leaf: int = LEAF, settled: float = SETTLED, task_rows: int = TASK_ROWS) -> tuple[DataFrame, Forest]:
    """(node, home, nb, sim, changed): each node's ``keep`` neighbours as found by NN-descent, best first, with its block."""
    count = points.count()
    share = min(1.0, 1.2 * SAMPLE / max(count, 1))
    by_hash = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)
    picked = points.where(by_hash).orderBy("node").limit(SAMPLE).select("raw").collect()
    sample = _doubles([bytes(r.raw) for r in picked], dim) if picked else np.zeros((0, dim))
    planted = lambda trees, leaf, seed: Forest(sample, trees, max(8, math.ceil(leaf * len(sample) / max(count, 1))), seed)
    forest = planted(trees, leaf, 7)
    together = max(1, BLOCK * forest.leaves(0) // max(count, 1))  # neighbouring leaves share a block

    def lists_of(loaded: DataFrame, forest: Forest, leaf: int, number: int) -> DataFrame:
        """Lists of the nodes of ``loaded(node, load)`` from within the leaves of a forest, the ``number``-th."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _doubles([y[: 4 * dim] for y in b.column("load").to_pylist()], dim)
                for tree in range(len(forest.trees)):
                    yield pa.RecordBatch.from_arrays([b.column("node"), b.column("load"), pa.array(np.full(len(x), number * trees + tree, np.int32)), pa.array(forest.leaf(tree, x))], ["node", "load", "tree", "leaf"])

        def count_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _doubles(b.column("raw").to_pylist(), dim)
                    for tree in range(len(forest.trees)):
                        at, n = np.unique(forest.leaf(tree, x), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number * trees + tree, np.int32)), pa.array(at), pa.array(n)], ["tree", "leaf", "n"])

        dealt = loaded.select("node", "load").mapInArrow(deal, "node long, load binary, tree int, leaf long")
        sizes = points.select("raw").mapInArrow(count_leaves, "tree int, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
        parts = sizes.where(F.col("n") > task_rows).select("tree", "leaf", F.ceil(F.col("n") / task_rows).alias("parts"))
        dealt = dealt.join(F.broadcast(parts), ["tree", "leaf"], "left")  # a row a wide leaf, of at most SAMPLE leaves a tree
        salted = dealt.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(number)), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
        return salted.groupBy("tree", "leaf", "salt").applyInArrow(_first_lists(dim, keep, leaf, together, not number), "node long, home long, nb binary, sim binary")

    def loaded(g: DataFrame) -> DataFrame:
        """(node, load): the vector and what a candidate must surpass, the last entry of a full list."""
        full = F.length("sim") >= 4 * keep
        worst = g.select("node", F.when(full, F.concat(F.substring("sim", -4, 4), F.substring("nb", -8, 8))).otherwise(F.lit(_ANY)).alias("worst"))
        return points.select("node", "raw").join(worst, "node").select("node", F.concat("raw", "worst").alias("load"))

    def bettered(g: DataFrame, better: DataFrame) -> DataFrame:
        joined = g.select("node", "home", "nb", "sim", F.col("nb").alias("old")).unionByName(better.select("node", F.lit(None).cast("long").alias("home"), "nb", "sim", F.lit(None).cast("binary").alias("old")))
        both = joined.groupBy("node").agg(F.collect_list("nb").alias("nbs"), F.collect_list("sim").alias("sims"), F.max("home").alias("home"), F.max("old").alias("old"))
        return cut(both.mapInArrow(_merge_lists(keep), merged))

    def few_changed(g: DataFrame, of: int) -> bool:
        release(points.sparkSession)
        return (g.agg(F.sum("changed")).first()[0] or 0) <= settled * of * count

    def shares(rows: DataFrame) -> int:
        """Shares of the blocks of ``rows``, a row for what they bring in, that bring in about AT_ONCE times the table each."""
        return max(1, math.ceil(rows.count() / max(1, AT_ONCE * count)))

    def share(rows: DataFrame, number: int, of: int, seed: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64("home", F.lit(seed)), F.lit(of)) == number) if of > 1 else rows

    merged = "node long, home long, nb binary, sim binary, angles binary, changed int"
    release(points.sparkSession)
    made = lists_of(points.select("node", F.col("raw").alias("load")), forest, leaf, 0)
    listed = made.groupBy("node").agg(F.collect_list("nb").alias("nbs"), F.collect_list("sim").alias("sims"), F.max("home").alias("home"))
    g = cut(listed.withColumn("old", F.lit(None).cast("binary")).mapInArrow(_merge_lists(keep), merged))
    made = listed = None
    release(points.sparkSession)
    if max(forest.leaves(t) for t in range(trees)) > 1:  # else all are compared, or dealt by hash to tasks
        for number in range(1, FORESTS):
            wider = round(leaf * WIDER)
            g = bettered(g, lists_of(loaded(g), planted(max(1, trees * 3 // 4), wider, 7 + number), wider, number))
            if few_changed(g, keep):
                break
    everyone, turns = True, None
    while True:
        active = g if everyone else g.where("changed > 0")  # all in the first round, then those with new neighbours
        everyone = False
        vectors = loaded(g)
        lists = g.select("node", F.concat("nb", "angles").alias("load"))
        pairs = cut(_pairs_of(active))
        turns, better = turns or shares(pairs), None  # later rounds bring in less
        for turn in range(turns):  # blocks are independent; what is brought in for a share of them is gone before the next
            near = share(pairs, turn, turns, 1).join(lists, "node").select("home", F.lit(1).alias("kind"), "node", "load")
            inner = share(active, turn, turns, 1).select("home", F.lit(0).alias("kind"), "node", F.concat("nb", "angles").alias("load"))
            reach = cut(inner.unionByName(near).groupBy("home").applyInArrow(_both(keep, K + 1), "home long, kind int, node long, load binary"))
            del near, inner
            release(points.sparkSession)
            parts = shares(reach.where("kind = 2"))
            for part in range(parts):
                some = share(reach, part, parts, 2)
                far = some.where("kind = 2").drop("load").join(vectors, "node").select("home", "kind", "node", "load")
                found = some.where("kind = 0").unionByName(far).groupBy("home").applyInArrow(_descend(dim, keep), "node long, nb binary, sim binary")
                if turns * parts > 1:
                    found = cut(found)
                    del some, far
                    release(points.sparkSession)
                better = found if better is None else better.unionByName(found)
        g = bettered(g, better)
        pairs = reach = found = better = some = far = None
        if few_changed(g, min(keep, K + 1)):  # entries only ever get better, so this ends
            return g, forest


_ANY = bytearray(np.array([NONE], np.int32).tobytes() + np.array([0], np.int64).tobytes())


def _rank(k: int):
    """(node, ids, sims) of the k + 1 best ids of the whole list, those of equal direction among them."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kind, node = t.column("kind").to_numpy(), t.column("node").to_numpy()
        load, sim, firsts = t.column("load").to_pylist(), t.column("sim").to_pylist(), t.column("first").to_pylist()
        first = {int(node[i]): firsts[i] for i in np.flatnonzero(kind == 2)}
        who, best, sims = [], [], []
        for i in np.flatnonzero(kind == 0):
            u = int(node[i])
            each = [first[v] for v in [*np.frombuffer(load[i], np.int64).tolist(), u]]
            s = np.append(np.frombuffer(sim[i], np.int32), UNIT)
            flat = np.array([y for f in each for y in f], np.int64)
            value = np.repeat(s, [len(f) for f in each])
            top = np.lexsort((flat, -value))[: k + 1]
            who.append(u)
            best.append(flat[top].tolist())
            sims.append((value[top] / UNIT).tolist())
        return pa.table({"node": pa.array(who, pa.int64()), "ids": pa.array(best, pa.list_(pa.int64())), "sims": pa.array(sims, pa.list_(pa.float64()))})

    return run


def ranked(points: DataFrame, g: DataFrame, k: int = K) -> DataFrame:
    """(node, ids, sims): the k + 1 ids most similar to a node, of equal direction too, on exact cosines."""
    none = F.lit(None)
    own = g.select("home", F.lit(0).alias("kind"), "node", F.col("nb").alias("load"), "sim", none.cast("array<long>").alias("first"))
    need = _pairs_of(g).unionByName(g.select("home", "node")).distinct()
    held = need.join(points.select("node", "first"), "node").select("home", F.lit(2).alias("kind"), "node", none.cast("binary").alias("load"), none.cast("binary").alias("sim"), "first")
    return own.unionByName(held).groupBy("home").applyInArrow(_rank(k), "node long, ids array<long>, sims array<double>")


def neighbours(df: DataFrame, vector: str = "embedding", id_: str = "dense_id", dim: int = DIM, k: int = K, **how) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar of every id."""
    members, points = nodes(df, vector, id_, dim)
    g, _ = graph(points, dim, **how)
    best = ranked(points, g, k)
    both = members.join(best, "node").select("id", F.arrays_zip("ids", "sims").alias("z"))
    others = F.slice(F.filter("z", lambda e: e["ids"] != F.col("id")), 1, k)
    return both.select("id", F.posexplode(others).alias("rank", "e")).select("id", F.col("e.ids").alias("neighbour"), F.col("e.sims").alias("similarity"), (F.col("rank") + 1).alias("rank"))


def _scores(dim: int):
    """(query_id, node, q, raw) -> (query_id, node, sim), in billionths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, x = (_doubles(b.column(c).to_pylist(), dim) for c in ("q", "raw"))
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("node"), pa.array(_billionths(np.einsum("ij,ij->i", a, x)).astype(np.int32))], ["query_id", "node", "sim"])

    return run


def _doors(dim: int, entries: int):
    """The ``entries`` nodes of a leaf nearest to each query in it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = (_doubles(t.column("raw").to_pylist(), dim) for t in (left, right))
        who, ids = left.column("query_id").to_numpy(), right.column("node").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        a, b = [], []
        for i in range(0, len(q), 256):
            if len(x):
                top = _best(_billionths(q[i : i + 256] @ x.T), min(entries, len(x)))
                a.append(np.repeat(who[i : i + 256], top.shape[1]))
                b.append(ids[top].ravel())
        return pa.table({"query_id": pa.array(np.concatenate(a) if a else np.zeros(0, np.int64)), "node": pa.array(np.concatenate(b) if b else np.zeros(0, np.int64))})

    return run


def search(points: DataFrame, g: DataFrame, forest: Forest, queries: DataFrame, dim: int = DIM, k: int = K, beam: int = BEAM, entries: int = ENTRIES) -> DataFrame:
    """(query_id, ids, sims): the k + 1 ids most similar to each of ``queries(query_id, raw)``, by greedy search along the graph.

    A query enters at the nearest nodes of its leaves. In each round its best nodes not yet opened, among the
    ``beam`` best so far, are joined with the graph, and their neighbours are scored; it ends when all of the beam are opened.
    """
    trees = min(DOOR_TREES, len(forest.trees))

    def leaves(name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _doubles(b.column("raw").to_pylist(), dim)
                    for t in range(trees):
                        yield pa.RecordBatch.from_arrays([b.column(name), b.column("raw"), pa.array(np.full(len(x), t, np.int32)), pa.array(forest.leaf(t, x))], [name, "raw", "tree", "leaf"])

        return run

    asked = cut(queries.select("query_id", "raw").mapInArrow(leaves("query_id"), "query_id long, raw binary, tree int, leaf long"))
    q = asked.where("tree = 0").select("query_id", F.col("raw").alias("q"))
    there = points.select("node", "raw").mapInArrow(leaves("node"), "node long, raw binary, tree int, leaf long")
    parts = cut(there.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).alias("parts")))
    salted = there.join(F.broadcast(parts), ["tree", "leaf"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")))  # a row a leaf, of at most SAMPLE leaves
    spread = asked.join(F.broadcast(parts), ["tree", "leaf"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    keys = ["tree", "leaf", "salt"]
    spread = spread.select("query_id", "raw", *keys).toDF("query_id", "raw", *keys)  # names of their own on either side
    salted = salted.select("node", "raw", *keys).toDF("node", "raw", *keys)
    fresh = spread.groupBy(*keys).cogroup(salted.groupBy(*keys)).applyInArrow(_doors(dim, entries), "query_id long, node long").distinct()
    vectors = points.select("node", "raw")
    links = g.select("node", "nb")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "node"))
    near = None
    while True:  # each round opens nodes of the beam that were not, and the beam only ever gets better
        scored = fresh.join(vectors, "node").join(q, "query_id").mapInArrow(_scores(dim), "query_id long, node long, sim int").withColumn("opened", F.lit(False))
        near = cut((scored if near is None else near.unionByName(scored)).withColumn("r", best).where(F.col("r") <= beam).drop("r"))
        front = near.where("not opened").select("query_id", "node")
        if front.isEmpty():
            break
        ahead = front.join(links, "node").select("query_id", "nb").groupBy("query_id").applyInArrow(_ahead, "query_id long, node long")
        fresh = ahead.join(near.select("query_id", "node"), ["query_id", "node"], "left_anti")
        near = near.withColumn("opened", F.lit(True))
        release(points.sparkSession)
    full = near.select("query_id", "node", "sim").join(points.select("node", "first"), "node")
    return full.groupBy("query_id").applyInArrow(_rank_query(k), "query_id long, ids array<long>, sims array<double>")


def _ahead(key: tuple, t: pa.Table) -> pa.Table:
    """The distinct nodes in the lists that one query opens, at most a beam of them."""
    ids = np.unique(np.frombuffer(b"".join(t.column("nb").to_pylist()), np.int64))
    return pa.table({"query_id": pa.array(np.full(len(ids), key[0].as_py()), pa.int64()), "node": pa.array(ids)})


def _rank_query(k: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        s, firsts = t.column("sim").to_numpy(), t.column("first").to_pylist()
        flat = np.array([y for f in firsts for y in f], np.int64)
        value = np.repeat(s, [len(f) for f in firsts])
        top = np.lexsort((flat, -value))[: k + 1]
        return pa.table({"query_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([flat[top].tolist()], pa.list_(pa.int64())), "sims": pa.array([(value[top] / UNIT).tolist()], pa.list_(pa.float64()))})

    return run


def searched(df: DataFrame, asked: DataFrame, vector: str = "embedding", id_: str = "dense_id", dim: int = DIM, k: int = K) -> DataFrame:
    """(query_id, neighbour, similarity, rank) for ``asked(id_, vector)`` against all of ``df``; a query's own id is left out."""
    _, points = nodes(df, vector, id_, dim)
    g, forest = graph(points, dim)
    rows = usable(asked, vector, dim).where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    queries = cut(rows.mapInArrow(_pack_vectors(dim), "id long, digest binary, raw binary").groupBy(F.col("id").alias("query_id")).agg(F.min("raw").alias("raw")))
    best = search(points, g, forest, queries, dim, k).select("query_id", F.arrays_zip("ids", "sims").alias("z"))
    others = F.slice(F.filter("z", lambda e: e["ids"] != F.col("query_id")), 1, k)
    return best.select("query_id", F.posexplode(others).alias("rank", "e")).select("query_id", F.col("e.ids").alias("neighbour"), F.col("e.sims").alias("similarity"), (F.col("rank") + 1).alias("rank"))


def mutual_pairs(near: DataFrame) -> DataFrame:
    """(dense_id_a, dense_id_b), a < b, of which one at least is among the nearest of the other."""
    return near.select(F.least("id", "neighbour").alias("dense_id_a"), F.greatest("id", "neighbour").alias("dense_id_b")).distinct()
