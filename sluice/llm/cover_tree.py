"""Embedding near-dedup by dual traversal of cover trees: exact pairs above a cosine."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..sinks.ordered import local_name, resolved
from ..workspace import new_path
from .runtime import components, written

#: Points of a block, which one tree covers.
BLOCK = 8192
#: Most points for each cell of the trees' common top, of smaller tables so many times the root of their number; and the
#: most cells, whose centres every task gets.
CELL_POINTS, CELL_ROOTS, MOST_CELLS = 3072, 4, 4096
#: Blocks of a group: a task holds two groups at a time.
GROUP = 32
#: Radius of the first level below a block's root; each further level halves it. Wider levels are the cells'.
RADIUS = 0.25
LEVELS = 12
#: Node pairs with so many point pairs are computed at once instead of going down another level.
AT_ONCE = 1 << 14
#: Node pairs with fewer point pairs than this are computed many at a time.
FEW = 256
#: Axes along which nodes are compared before all.
AXES = 24
#: Nodes that are compared with others in one product, and node pairs of a product where the others are few.
ROWS, LEAST = 128, 1 << 17
#: Lengths may be wrong by so much.
SLACK = 1e-7
#: Cosines in single precision may be wrong by so much.
ROUGH = 1e-4
#: Hashes of repeated vectors that are broadcast.
MOST_HASHES = 4_000_000


@dataclass
class Tree:
    """Unit vectors in tree order, and nodes: a node's points are ``size`` rows from ``first``, the first one is its
    centre; none is farther from it than ``radius``; its children are ``below`` nodes from ``child``."""

    points: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    first: np.ndarray
    size: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    below: np.ndarray


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


def _owners(points: np.ndarray, radius: float) -> np.ndarray:
    """Each point's centre: the first point within the radius that is a centre, or itself."""
    rough = points.astype(np.float32)
    owner, free = np.arange(len(points)), np.ones(len(points), bool)
    for at in range(0, len(points), 512):
        near = rough[at : at + 512] @ rough[at:].T >= np.float32(1.0 - radius * radius / 2)
        near &= np.arange(near.shape[1])[None, :] > np.arange(len(near))[:, None]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            if free[at + i]:
                own = np.flatnonzero(near[i] & free[at:]) + at
                owner[own] = at + i
                free[own] = False
    return owner


def build(points: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> Tree:
    """Level by level, each node's points are dealt to centres more than the level's radius apart."""
    order = np.arange(len(points))
    rows = [(0, len(points), float(_distance(points @ points[0]).max()))]
    children: list[tuple[int, int]] = [(0, 0)]
    radius, last = RADIUS, [0]
    for _ in range(LEVELS):
        new = []
        for node in last:
            first, size, far = rows[node]
            if size < 2:
                continue
            if far <= radius:  # nothing to divide on this level
                new.append(node)
                continue
            here = order[first : first + size]
            own = points[here]
            owner = _owners(own, radius)
            dealt = np.argsort(owner, kind="stable")  # a centre stands before what it owns
            order[first : first + size] = here[dealt]
            apart = _distance(np.einsum("ij,ij->i", own, own[owner]))[dealt]
            begin = np.flatnonzero(owner[dealt] == dealt)
            apart[begin] = 0.0
            sizes, start = np.diff(begin, append=size), len(rows)
            rows.extend(zip((first + begin).tolist(), sizes.tolist(), np.maximum.reduceat(apart, begin).tolist(), strict=True))
            children.extend([(0, 0)] * len(begin))
            new.extend((start + np.flatnonzero(sizes > 1)).tolist())
            children[node] = (start, len(begin))
        last, radius = new, radius / 2
    first, size, far = (np.array(x) for x in zip(*rows, strict=True))
    child, below = np.array(children, np.int64).T
    return Tree(points[order], ids[order], weights[order], first.astype(np.int64), size.astype(np.int64), far, child, below)


def _below(tree: Tree, node: int) -> np.ndarray:
    """A node's children, or itself if it has none."""
    return np.arange(tree.child[node], tree.child[node] + tree.below[node]) if tree.below[node] else np.array([node])


@dataclass
class Visits:
    """Node pairs that the walk looked at, those that it dropped, and the point pairs that it computed."""

    seen: int = 0
    pruned: int = 0
    points: int = 0


@dataclass
class Joined:
    """What is linked, by the smallest id of what the links join."""

    found: dict[int, int] = field(default_factory=dict)

    def top(self, x: int) -> int:
        found = self.found
        while (y := found.get(x, x)) != x:
            found[x] = x = found.get(y, y)
        return x

    def connect(self, x: np.ndarray, y: np.ndarray) -> None:
        for s, t in zip(x.tolist(), y.tolist(), strict=True):
            s, t = self.top(s), self.top(t)
            low = min(s, t)
            self.found[s] = self.found[t] = self.found[low] = low

    def pairs(self) -> list[tuple[int, int]]:
        return [(x, self.top(x)) for x in list(self.found)]


class Side:
    """A tree, and in single precision the centres of its nodes, whole and along a few ``axes`` with half their squares:
    the product of one's ``low`` and another's ``flip`` is half their squared distance along these axes, negative.
    ``reach`` is a little more than each radius."""

    def __init__(self, tree: Tree, rough: np.ndarray, axes: np.ndarray | None = None):
        self.tree, self.centres = tree, rough[tree.first]
        low = self.centres @ axes if axes is not None else self.centres[:, :AXES]
        half, one = np.square(low).sum(axis=1, keepdims=True) / 2, np.ones((len(low), 1), np.float32)
        self.reach = (tree.radius + 10 * ROUGH).astype(np.float32)
        self.low, self.flip = np.hstack([low, -half, one]), np.hstack([low, one, -half])


def dual(a: Tree, b: Tree, cosine: float, same: bool, visits: Visits | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each point of ``a`` and of ``b`` to points of the other tree, and links that connect what is linked."""
    links, joined = (np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)), Joined()
    walk(*(Side(x, x.points.astype(np.float32)) for x in (a, b)), cosine, same, *links, joined, visits)
    return *links, joined.pairs()


def walk(
    x: Side, y: Side, cosine: float, same: bool, links_a: np.ndarray, links_b: np.ndarray, joined: Joined,
    visits: Visits | None = None, beyond: tuple[np.ndarray, np.ndarray] | None = None,
) -> None:
    """Add to the links of each point of both trees, and join what is linked.

    The walk begins at the roots. A pair of nodes is dropped if their centres are farther apart than the threshold and
    both radii allow; of the others, pairs of few points are computed, and the rest is replaced by all pairs of their
    children. With ``same`` both trees are one, and each pair of points is met in both directions.

    ``beyond`` has for each node of either tree how far its points are at least from a plane between the trees, on the
    tree's own side (negative on the other side): two points are as far apart as both numbers' sum at least.
    """
    a, b = x.tree, y.tree
    visits = visits or Visits()
    far = np.sqrt(2.0 - 2.0 * cosine) + SLACK
    connect = joined.connect

    def compute(i: slice, j: slice) -> None:
        """All point pairs of two runs of rows."""
        linked = a.points[i] @ b.points[j].T >= cosine
        if same:
            rows, columns = np.arange(i.start, i.stop), np.arange(j.start, j.stop)
            linked &= rows[:, None] != columns[None, :]
        if not linked.any():
            return
        links_a[i] += linked @ b.weights[j]
        links_b[j] += a.weights[i] @ linked
        # Least column of each row, then least label of each column, until the labels settle.
        label = np.arange(linked.shape[0])
        none = linked.shape[0]
        some = linked.any(axis=1)
        while True:
            across = np.where(linked, label[:, None], none).min(axis=0)
            back = np.where(linked, across[None, :], none).min(axis=1)
            new = np.where(some, np.minimum(label, back), label)
            if (new == label).all():
                break
            label = new
        rows = np.flatnonzero(some)
        connect(a.ids[i][rows], a.ids[i][label[rows]])
        columns = np.flatnonzero(across < none)
        connect(b.ids[j][columns], a.ids[i][across[columns]])

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        """Single point pairs."""
        if same:
            i, j = i[i != j], j[i != j]
        linked = np.einsum("ij,ij->i", a.points[i], b.points[j]) >= cosine
        i, j = i[linked], j[linked]
        np.add.at(links_a, i, b.weights[j])
        np.add.at(links_b, j, a.weights[i])
        connect(a.ids[i], b.ids[j])

    def visit(p: np.ndarray, q: np.ndarray) -> None:
        """Node pairs near enough: computed where small or without children, otherwise left for ``expand``."""
        times = a.size[p] * b.size[q]
        small = (times <= AT_ONCE) | (a.below[p] == 0) & (b.below[q] == 0)
        few = small & (times <= FEW)
        ends = np.cumsum(times[few])
        for k in range(0, int(ends[-1]) if len(ends) else 0, 1 << 16):
            turn = np.arange(k, min(k + (1 << 16), ends[-1]))
            pair = np.searchsorted(ends, turn, "right")
            turn -= ends[pair] - times[few][pair]
            s, t = p[few][pair], q[few][pair]
            meet(a.first[s] + turn // b.size[t], b.first[t] + turn % b.size[t])
        for s, t in zip(p[small & ~few].tolist(), q[small & ~few].tolist(), strict=True):
            for at in range(a.first[s], a.first[s] + a.size[s], 1024):
                rows = slice(at, min(at + 1024, a.first[s] + a.size[s]))
                compute(rows, slice(b.first[t], b.first[t] + b.size[t]))
        visits.points += int(times[small].sum())
        waiting.extend(zip(p[~small].tolist(), q[~small].tolist(), strict=True))

    def look(p: np.ndarray, q: np.ndarray) -> None:
        """Node pairs one by one, in single precision and then in double."""
        for k in range(0, len(p), 1 << 14):
            i, j = p[k : k + (1 << 14)], q[k : k + (1 << 14)]
            reach = np.minimum(far + a.radius[i] + b.radius[j], 2.0)
            near = np.einsum("ij,ij->i", x.centres.take(i, axis=0), y.centres.take(j, axis=0)) >= 1.0 - ROUGH - reach * reach / 2
            i, j, reach = i[near], j[near], reach[near]
            if len(i):
                near = _distance(np.einsum("ij,ij->i", a.points[a.first[i]], b.points[b.first[j]])) <= reach
                i, j = i[near], j[near]
            if len(i):
                visits.pruned -= len(i)
                visit(i, j)

    def expand(s: np.ndarray, t: np.ndarray) -> None:
        """All pairs of nodes by products in single precision, which leave out most; the rest is looked at again."""
        visits.seen += len(s) * len(t)
        visits.pruned += len(s) * len(t)
        if beyond is not None:
            s = s[beyond[0][s] <= far - beyond[1][t].min()]
            t = t[beyond[1][t] <= far - beyond[0][s].min()] if len(s) else s
            s, t = s[np.argsort(beyond[0][s])], t[np.argsort(beyond[1][t])]
        pairs = []
        single_s, single_t = a.radius[s] == 0, b.radius[t] == 0
        for p, q, single in ((s[single_s], t[single_t], True), (s[single_s], t[~single_t], False), (s[~single_s], t, False)):
            if not len(p) or not len(q):
                continue
            left, right, ends, rows = x.low.take(p, axis=0), y.flip.take(q, axis=0), None, max(ROWS, LEAST // len(q))
            if beyond is not None:  # nodes farther from the plane reach fewer of those behind it
                ends = np.searchsorted(beyond[1][q], far - beyond[0][p[::rows]], "right").tolist()
            wide = far + b.radius[q]
            for k, at in enumerate(range(0, len(p), rows)):
                n = len(q) if ends is None else ends[k]
                if not n:
                    break
                dots = left[at : at + rows] @ right[:n].T
                reach = far if single else wide[:n] + a.radius[p[at : at + rows]].max()
                kept = np.flatnonzero(dots >= np.asarray(-reach * reach / 2 - ROUGH, np.float32))
                if len(kept):
                    pairs.append((p[at + kept // n], q[kept % n]))
        if pairs:
            look(*(np.concatenate(k) for k in zip(*pairs, strict=True)))

    waiting: list[tuple[int, int]] = []
    expand(np.zeros(1, np.int64), np.zeros(1, np.int64))
    while waiting:
        s, t = waiting.pop()
        expand(_below(a, s), _below(b, t))


def _unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values /= np.abs(values).max(axis=1, keepdims=True)  # squares of extreme values would overflow or vanish
    return values / np.linalg.norm(values, axis=1, keepdims=True)


class Units:
    """Unit vectors in double precision of the rows that are asked for."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __getitem__(self, rows: np.ndarray | slice) -> np.ndarray:
        return _unit(self.values[rows])


def _store(tree: Tree, values: np.ndarray, target: str, block: int) -> None:
    """A file for a block's tree, in the shared folder."""
    nodes = (tree.first, tree.size, tree.radius.view(np.int64), tree.child, tree.below)
    parts = [np.array([len(values), len(tree.first)]), tree.ids, tree.weights, *nodes, values]
    data = b"".join(x.tobytes() for x in parts)
    if name := local_name(target):
        os.makedirs(name, exist_ok=True)
        with open(part := f"{name}/{block}.{os.getpid()}.tmp", "wb") as file:
            file.write(data)
        os.replace(part, f"{name}/{block}")
    else:
        from pyarrow import fs as stores

        store, base = stores.FileSystem.from_uri(target)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{block}") as out:
            out.write(data)


def _load(target: str, block: int, kind: str, width: int) -> Tree:
    if name := local_name(target):
        data = np.memmap(f"{name}/{block}", np.uint8, "r")
    else:
        from pyarrow import fs as stores

        store, base = stores.FileSystem.from_uri(target)
        with store.open_input_file(f"{base}/{block}") as file:
            data = np.frombuffer(file.read(), np.uint8)
    n, m = data[:16].view(np.int64).tolist()
    ids, weights, *nodes = np.split(np.array(data[16 : 16 + 8 * (2 * n + 5 * m)].view(np.int64)), [n, *(2 * n + k * m for k in range(5))])
    first, size, radius, child, below = nodes
    values = data[16 + 8 * (2 * n + 5 * m) :].view(kind).reshape(n, width)
    return Tree(Units(values), ids, weights, first, size, radius.view(np.float64), child, below)


def embedding_links(
    vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """``id``, ``n_links``, ``component`` of each vector: how many others have a cosine of at least ``cosine``, in
    double precision, and the smallest id reachable by such links.

    Equal vectors are one class from the start: only vectors whose hash is repeated are compared whole. Centres, the top
    of the tree, divide the classes into cells: one for ``CELL_POINTS`` classes or fewer, so that denser regions have
    more, but ``MOST_CELLS`` at most. A cell of more than ``block`` points is divided by hash, so no cell outgrows a task, and
    each block gets a cover tree of its own, once, in a file of the shared folder. Tasks take the pairs of two groups of
    blocks each and read the trees from there, so nothing is copied for a pair. Every pair of blocks whose cells are near
    enough for a link is traversed, from the roots down; the plane halfway between both cells' centres leaves out what
    lies too far behind it. No pair of vectors leaves a task: a vector's number of links does, and one link to the
    smallest member of what the task connected.

    Vectors that are null or zero, or hold null or non-finite components, link with nothing; shorter vectors count as
    filled up with zeros. Ids must be unique integers. Empty table, empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    others = rows.where(~F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    others = others.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    width = valid.agg(F.max(F.size("v"))).first()[0] or 0

    # Classes: a vector whose hash is its own is one; only the others are grouped by their components.
    alone, repeated, twins = valid.select("v", "id", F.lit(1).cast("long").alias("n")), valid, None
    hashes = written(valid.groupBy(F.xxhash64("v").alias("hash")).count().where("count > 1").select("hash"))
    if n_hashes := hashes.count():
        if n_hashes <= MOST_HASHES:
            hashed = valid.withColumn("hash", F.xxhash64("v"))
            alone, repeated = (hashed.join(F.broadcast(hashes), "hash", how).drop("hash") for how in ("left_anti", "left_semi"))
            alone = alone.select("v", "id", F.lit(1).cast("long").alias("n"))
        twins = written(repeated.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    classes = alone if twins is None else alone.unionByName(twins) if n_hashes <= MOST_HASHES else twins

    def matrix(column: pa.Array) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(column.offsets.to_numpy())
        if (sizes == width).all():
            return flat.reshape(-1, width).astype(kind)
        found = np.zeros((len(sizes), width), kind)
        found[np.arange(width)[None, :] < sizes[:, None]] = flat
        return found

    n_classes = classes.select("id").count()
    wanted = min(MOST_CELLS, -(-n_classes // min(CELL_POINTS, int(CELL_ROOTS * n_classes**0.5) + 1)))
    # The least hashes of ids: of more than twice as many rows as are wanted, no more are ordered.
    drawn = F.xxhash64("id")
    least = int(-(2**63) + min(2**64 - 1, 2**64 * (2 * wanted + 64) // max(n_classes, 1)))
    picked = classes.where(drawn <= least).orderBy(drawn, "id").limit(max(wanted, 1)).select("v").toArrow()["v"].combine_chunks()
    if not len(picked) and n_classes:
        picked = classes.limit(1).select("v").toArrow()["v"].combine_chunks()
    centres = _unit(matrix(picked)) if len(picked) else np.zeros((0, width))
    rough_centres = centres.astype(np.float32)
    # Axes along which the centres differ most come first.
    axes = np.linalg.eigh(centres.T @ centres)[1][:, ::-1][:, :AXES].astype(np.float32)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column(0))
            unit = _unit(values)
            rough = unit.astype(np.float32)
            near = [(rough[at : at + 512] @ rough_centres.T).argmax(axis=1) for at in range(0, len(rough), 512)]
            cell = np.concatenate(near) if near else np.zeros(0, np.int64)
            apart = _distance(np.einsum("ij,ij->i", unit, centres[cell]))
            data = pa.array([x.tobytes() for x in values], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), data, pa.array(cell.astype(np.int32)), pa.array(apart)],
                ["id", "n", "data", "cell", "apart"],
            )

    points = written(classes.mapInArrow(assign, "id long, n long, data binary, cell int, apart double"))
    cells = points.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("far")).orderBy("cell").collect()
    # At most one row a cell: its first block, and how many it is divided into.
    plan, cell_of, start = [], [], 0
    for r in cells:
        plan.append((r["cell"], start, -(-r["n"] // block)))
        cell_of += [r["cell"]] * plan[-1][2]
        start += plan[-1][2]
    places = spark.createDataFrame(plan, "cell int, first int, blocks int")
    place = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int")
    target = resolved(spark, new_path(spark, "trees"))

    def plant(table: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(table["data"].to_pylist()), kind).reshape(-1, width)
        tree = build(_unit(values), np.arange(len(values)), table["n"].to_numpy())
        values, tree.ids = values[tree.ids], table["id"].to_numpy()[tree.ids]
        own = table["block"][0].as_py()
        _store(tree, values, target, own)
        return pa.table({"block": pa.array([own], pa.int32())})

    dealt = points.select("id", "n", "data", "cell").join(F.broadcast(places), "cell").withColumn("block", place)
    planted = dealt.select("id", "n", "data", "block").groupBy("block").applyInArrow(plant, "block int")
    blocks = sorted(r["block"] for r in planted.collect())  # a hash may have dealt a block no points
    cell_of = np.array(cell_of, np.int64)[blocks]
    far_of = np.zeros(len(centres))
    far_of[[r["cell"] for r in cells]] = [r["far"] for r in cells]

    # Pairs of groups: as many groups as make two tasks a core, and more where they would be too large.
    cores = spark.sparkContext.defaultParallelism
    n_groups = max(-(-len(blocks) // GROUP), min(len(blocks), int(np.ceil(np.sqrt(4 * cores)))))
    groups = [x.tolist() for x in np.array_split(np.arange(len(blocks)), max(n_groups, 1))]
    tiles = [(i, j) for i in range(n_groups) for j in range(i, n_groups)]
    sent = spark.sparkContext.broadcast((centres, axes, blocks, cell_of, far_of, groups, tiles))
    far = np.sqrt(2.0 - 2.0 * cosine) + SLACK

    def sides(group: list[int]) -> list[Side]:
        _, axes, blocks, *_ = sent.value
        found = []
        for k in group:
            tree = _load(target, blocks[k], kind, width)
            found.append(Side(tree, tree.points[:].astype(np.float32), axes))
        return found

    def traverse(left: list[Side], right: list[Side], own: list[int], other: list[int]) -> tuple[list[np.ndarray], list[np.ndarray], Joined]:
        """Links of all points of two groups, which may be one."""
        centres, _, _, cell_of, far_of, *_ = sent.value
        one = left is right
        cells, others = cell_of[own], cell_of[other]
        between = _distance(centres[cells] @ centres[others].T)
        # Of each node's centre, its products with the centres of the other group's cells and of its own.
        to = [[centres[others].astype(np.float32) @ x.centres.T for x in left], [centres[cells].astype(np.float32) @ x.centres.T for x in right]]
        at = [[x.centres @ centres[k].astype(np.float32) for x, k in zip(xs, ks, strict=True)] for xs, ks in ((left, cells), (right, others))]
        found = [[np.zeros(len(x.tree.ids), np.int64) for x in xs] for xs in (left, right)]
        joined = Joined()
        for i, x in enumerate(left):
            for j in range(i if one else 0, len(right)):
                y, apart = right[j], float(between[i, j])
                if apart > far + far_of[cells[i]] + far_of[others[j]]:
                    continue
                beyond = None
                if cells[i] != others[j] and apart > 0.1:
                    beyond = ((at[0][i] - to[0][i][j]) / apart - x.reach, (at[1][j] - to[1][j][i]) / apart - y.reach)
                same = one and i == j
                walk(x, y, cosine, same, found[0][i], np.zeros_like(found[0][i]) if same else found[0 if one else 1][j], joined, None, beyond)
        return found[0], [] if one else found[1], joined

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, groups, tiles = sent.value
        last, left = -1, []
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            i, j = tiles[k]
            if i != last:
                last, left = i, sides(groups[i])
            right = left if i == j else sides(groups[j])
            *links, joined = traverse(left, right, groups[i], groups[j])
            parts = [(x.tree.ids[n > 0], n[n > 0]) for xs, ns in zip((left, right), links, strict=True) for x, n in zip(xs, ns) if n.any()]
            if parts:
                ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                tops = np.array([joined.top(x) for x in ids.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(tops)], ["a", "n_links", "b"])

    n_tasks = min(len(tiles), max(4 * cores, len(tiles) // 8))
    found = written(spark.range(0, len(tiles), 1, max(n_tasks, 1)).mapInArrow(join, "a long, n_links long, b long"))
    counts = found.groupBy("a").agg(F.sum("n_links").alias("found"))
    roots = components(found.select("a", "b"))
    ids = points.select("id", "n")
    named = (
        ids.join(counts, ids["id"] == counts["a"], "left")
        .join(roots, ids["id"] == roots["node"], "left")
        .select("id", "n", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component"))
    )
    if twins is None:
        return named.drop("n").unionByName(others)
    named = written(named)
    alike = twins.where("n > 1").select("v", "id").join(named.where("n > 1").drop("n"), "id").drop("id")
    linked = named.where("n = 1").drop("n").unionByName(repeated.join(written(alike), "v").select("id", "n_links", "component"))
    return linked.unionByName(others)
