"""Embedding near-dedup by a dual traversal of cover trees: nested levels, halving radii, exact pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from motorlot.llm.components import components
from motorlot.llm.store import saved

COSINE = 0.95
CHUNK_ROWS = 4096
PIVOTS = 1024
RADII = (1.0, 0.5, 0.25, 0.125)
# More than chord() loses near 0, where it takes the root of a cosine's rounding; pairs this near the threshold go down to the rows.
SLACK = 1e-6
DENSE = 4096
# Products of nodes from this size are swept along a line, in blocks of so many rows and columns.
SWEEP, ROWS, COLS = 1 << 18, 256, 2048
# Rows of a tree that show what its levels exclude, and how much more a pair of nodes costs below a level than at it.
PROBES, BELOW = 64, 16
# Chunks of a task's left side: at most so many bytes, and few enough for this many groups of chunks.
SIDE_BYTES, GROUPS = 1 << 27, 16
TREE = "dim int, cell int, part int, ids binary, data binary, starts array<binary>, centres array<binary>, radii array<binary>"


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that large and small values neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def usable(vector: Column) -> Column:
    """Not null, no null, NaN or infinite component, and some component that is not 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def net(rows: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first centres: every prefix is a net of the rows, with radii that fall."""
    chosen, near = [0], chord(rows @ rows[0])
    while len(chosen) < min(most, len(rows)):
        far = int(near.argmax())
        if near[far] <= SLACK:
            break
        chosen.append(far)
        near = np.minimum(near, chord(rows @ rows[far]))
    return rows[chosen]


def leading(sample: np.ndarray, cosine: float) -> np.ndarray | None:
    """Orthonormal columns along which the sample varies most; None if whole vectors are as cheap to compare.

    There are as many columns as make the first comparison and the second one of what it lets through take least time on
    pairs of the sample; whatever they are, what is left out of a vector is bounded by its length, so nothing is lost.
    """
    dim = sample.shape[1]
    if dim <= 16 or len(sample) < 2:
        return None
    basis = np.linalg.svd(sample - sample.mean(0), full_matrices=False)[2].T
    inside, best = np.triu_indices(len(sample), 1), (dim, None)
    near = (sample @ sample.T)[inside] >= cosine
    for size in (8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256):
        if size < dim:
            some = head(sample, basis[:, :size])
            through = (((some @ some.T)[inside] >= cosine - 1e-6) & ~near).mean()
            best = min(best, (10 + size + 500 * dim * through, size), key=lambda v: v[0])
    return None if best[1] is None else np.ascontiguousarray(basis[:, :best[1]])


def head(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Vectors of single precision whose products are no less than those of the rows of x, but for rounding: the part of
    each row inside the basis and the length of the rest."""
    if basis is None:
        return x.astype(np.float32)
    part = x @ basis
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", part, part), 0))
    return np.column_stack((part, rest)).astype(np.float32)


class Tree:
    """Cover tree over the rows of a chunk, which are put in the order of its deepest level.

    Level l has the nodes of a net with radius RADII[l] inside each node of the level above, whose centre stays one. A
    node is a range of rows: starts[l] holds the first rows (and the end), centres[l] the rows of the centres, radii[l]
    the largest distance from a centre to a row of its node.
    """

    def __init__(self, x: np.ndarray, starts: list, centres: list, radii: list, basis: np.ndarray | None = None):
        # Below the last level each row is a node of its own.
        rows = np.arange(len(x))
        self.x, self.starts, self.centres = x, [*starts, np.arange(len(x) + 1)], [*centres, rows]
        self.radii = [*radii, np.zeros(len(x))]
        self.head = head(x, basis)
        # The node above all: its centre need not be a row.
        middle = x.mean(0)
        length = np.linalg.norm(middle)
        self.middle = middle / length if length > SLACK else x[0]
        self.radius = chord((x @ self.middle).min())
        # The nodes, level by level, of some rows at equal steps.
        probes = np.linspace(0, len(x) - 1, PROBES).astype(np.int64)
        at = [np.searchsorted(s, probes, side="right") - 1 for s in starts]
        self.probes = [(x[c[i]], r[i]) for i, c, r in zip(at, centres, radii)]

    @staticmethod
    def built(x: np.ndarray) -> tuple[np.ndarray, list, list, list]:
        """(order of the rows, starts, centres, radii)."""
        cosine = x @ x.T
        group, centre = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        levels = []
        for radius in RADII:
            least = 1 - radius * radius / 2
            # A node of one row stays one.
            own = np.where(np.bincount(group, minlength=len(x))[group] == 1, np.arange(len(x)), -1)
            # The centre of the node above comes first, so it stays a centre.
            for i in np.lexsort((np.arange(len(x)) != centre, group)):
                if own[i] < 0:
                    own[(own < 0) & (group == group[i]) & (cosine[i] >= least)] = i
                    own[i] = i
            levels.append(own)
            group = centre = own
        order = np.lexsort(levels[::-1])
        back = np.empty(len(x), dtype=np.int64)
        back[order] = np.arange(len(x))
        starts, centres, radii = [], [], []
        for own in levels:
            own = own[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            far = chord(np.einsum("ij,ij->i", x[order], x[own]))
            starts.append(np.append(first, len(x)))
            centres.append(back[own[first]])
            radii.append(np.maximum.reduceat(far, first))
        return order, starts, centres, radii


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for count[0] values, then the same for the next."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())


class Links:
    """Number of links of each row, and links enough to join what belongs together."""

    def __init__(self, n: int):
        self.n, self.a, self.b = np.zeros(n, dtype=np.int64), [], []

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        self.n += np.bincount(a, minlength=len(self.n)) + np.bincount(b, minlength=len(self.n))
        self.join(a, b)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            root = roots(len(nodes), at[:len(a)], at[len(a):])
            self.a.append(nodes)
            self.b.append(nodes[root])

    def labels(self) -> np.ndarray:
        return roots(len(self.n), np.concatenate(self.a), np.concatenate(self.b)) if self.a else np.arange(len(self.n))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node that each node reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def beginning(left: Tree, right: Tree, reach: float) -> int:
    """The level at which the traversal of two trees begins: where it will compare fewest pairs of nodes.

    A level above the deepest is worth its comparisons only if they exclude most pairs of rows. How many, is seen at the
    nodes of some rows of both trees; the choice changes the time, not what is found.
    """
    deepest = len(left.probes) - 1
    nodes = [(len(s) - 1) * (len(t) - 1) for s, t in zip(left.starts[:-1], right.starts[:-1])]
    costs = [nodes[deepest]]
    for level in range(deepest - 1, -1, -1):
        (x, rx), (y, ry) = left.probes[level], right.probes[level]
        on = (chord(x @ y.T) <= reach + rx[:, None] + ry + SLACK).mean()
        costs.append(nodes[level] + BELOW * on * nodes[deepest])
    return deepest - int(np.argmin(costs))


def traversed(left: Tree, right: Tree | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the rows of both trees, from pairs across; without a right tree, from pairs inside the left.

    Pairs of nodes go down level by level. The covering radii bound the distances of all rows below: farther than the
    threshold prunes a pair, nearer links all of its rows, and what is between goes on to the children, where the
    children of large nodes are compared at once. Between rows the cosine itself decides.
    """
    same, right = right is None, right or left
    shift = 0 if same else len(left.x)
    links = Links(len(left.x) + (0 if same else len(right.x)))
    reach = float(chord(np.array(cosine)))
    p, q = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    above_l, above_r = np.array([0, len(left.x)]), np.array([0, len(right.x)])
    for level in range(beginning(left, right, reach), len(left.starts)):
        sl, sr = left.starts[level], right.starts[level]
        leaf = level == len(left.starts) - 1
        fl, fr = np.searchsorted(sl, above_l), np.searchsorted(sr, above_r)
        next_p, next_q = [], []
        for a, b, cos in compared_nodes(left, right, level, children(p, q, fl, fr, same), reach):
            if same:
                keep = a < b if leaf else a <= b
                a, b, cos = a[keep], b[keep], cos[keep]
            if not len(a):
                continue
            if leaf:
                ok = cos >= cosine
                links.pairs(a[ok], b[ok] + shift)
                continue
            wide = left.radii[level][a] + right.radii[level][b]
            d = chord(cos)
            inside = (d + wide <= reach - SLACK) & ~((a == b) & same)
            small = inside & ((sl[a + 1] - sl[a]) * (sr[b + 1] - sr[b]) <= 64)
            for r, s in products(a[small], b[small], sl, sr):
                links.pairs(r, s + shift)
            large = inside & ~small
            for x, y in zip(a[large], b[large]):
                r, s = np.arange(sl[x], sl[x + 1]), np.arange(sr[y], sr[y + 1]) + shift
                links.n[r] += len(s)
                links.n[s] += len(r)
                links.join(np.concatenate((r, np.full(len(s), r[0]))), np.concatenate((np.full(len(r), s[0]), s)))
            on = ~inside & (d <= reach + wide + SLACK)
            next_p.append(a[on])
            next_q.append(b[on])
        if leaf or not next_p:
            break
        p, q = np.concatenate(next_p), np.concatenate(next_q)
        above_l, above_r = sl, sr
    return links.n, links.labels()


def compared_nodes(left: Tree, right: Tree, level: int, pairs: Iterator, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, cosine of their centres) of pairs of nodes; of blocks only those that touch."""
    for a, b, block in pairs:
        l, r = left.centres[level][a], right.centres[level][b]
        if block:
            sides = left.x[l], right.x[r], left.radii[level][a], right.radii[level][b], reach, left.head[l], right.head[r]
            for i, j, cos in swept(*sides) if len(a) * len(b) >= SWEEP else [touching(*sides)]:
                yield a[i], b[j], cos
        else:
            yield a, b, np.einsum("ij,ij->i", left.x[l], right.x[r])


def swept(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, reach: float, hx: np.ndarray, hy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """touching() in blocks, without the blocks whose centres are too far apart along the line between the middles of x and y.

    Along any line two points are no farther apart than in space. Cells border on the plane between their centres, so in
    many dimensions, where no covering radius excludes a cell, this line still excludes most pairs of rows.
    """
    line = x.mean(0) - y.mean(0)
    length = np.linalg.norm(line)
    line = line / length if length > SLACK else np.zeros_like(line)
    near, far = x @ line - rx, y @ line + ry
    rows, cols = np.argsort(near), np.argsort(-far)
    hx, hy, below = hx[rows], hy[cols], -far[cols]
    for s in range(0, len(rows), ROWS):
        most = np.searchsorted(below, reach + SLACK - near[rows[s]], side="right")
        for t in range(0, most, COLS):
            r, c = slice(s, s + ROWS), slice(t, min(t + COLS, most))
            yield touching(x, y, rx, ry, reach, hx[r], hy[c], rows[r], cols[c])
        if not most:
            break


def touching(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, reach: float, hx: np.ndarray | None = None, hy: np.ndarray | None = None, rows: np.ndarray | None = None, cols: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the centres x[i], y[j] that are no farther apart than reach and both radii; i of rows, j of cols.

    Heads in single precision, hx of the rows and hy of the columns, leave out what is far, with a margin above their
    error; the rest is decided in double precision. Nodes without a radius are taken apart from the others, so that one
    wide node does not let the whole block through.
    """
    rows, cols = np.arange(len(x)) if rows is None else rows, np.arange(len(y)) if cols is None else cols
    hx, hy = head(x[rows], None) if hx is None else hx, head(y[cols], None) if hy is None else hy
    margin = 2.4e-7 * (hx.shape[1] + 8)
    found = []
    wide = ry[cols] > SLACK
    for some in (~wide, wide):
        if not some.any():
            continue
        at, hs = (cols, hy) if some.all() else (cols[some], hy[some])
        widest = np.minimum(reach + rx[rows] + ry[at].max() + SLACK, 2)
        # With its threshold as one more component of a row, all products are compared with 0.
        least = (1 - widest * widest / 2 - margin).astype(np.float32)
        product = np.column_stack((hx, -least)) @ np.column_stack((hs, np.ones(len(at), dtype=np.float32))).T
        i, j = np.divmod(np.flatnonzero(product.ravel() >= 0), len(at))
        if len(i) * 16 > product.size:
            cos = (x[rows] @ y[at].T)[i, j]
        else:
            cos = np.einsum("ij,ij->i", x[rows[i]], y[at[j]])
        i, j = rows[i], at[j]
        near = chord(cos) <= reach + rx[i] + ry[j] + SLACK
        found.append((i[near], j[near], cos[near]))
    return tuple(np.concatenate(v) for v in zip(*found))


def children(p: np.ndarray, q: np.ndarray, first_l: np.ndarray, first_r: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of child nodes: as blocks (all of a with all of b) for a node with many pairs below, else as one list in pieces."""
    nl, nr = first_l[p + 1] - first_l[p], first_r[q + 1] - first_r[q]
    large = (np.bincount(p, nl * nr, minlength=1) >= DENSE)[p]
    order = np.flatnonzero(large)[np.argsort(p[large], kind="stable")]
    for at in np.split(order, np.flatnonzero(np.diff(p[order])) + 1) if len(order) else []:
        x = p[at[0]]
        own = np.arange(first_l[x], first_l[x + 1])
        other = at[q[at] != x] if same else at
        if len(other) < len(at):
            for i in range(0, len(own), 1024):
                yield own[i:i + 1024], own[i:], True
        if len(other):
            yield own, spans(first_r[q[other]], nr[other]), True
    for a, b in products(p[~large], q[~large], first_l, first_r):
        yield a, b, False


def products(p: np.ndarray, q: np.ndarray, first_l: np.ndarray, first_r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Everything below p[k] with everything below q[k], for all k, as lists in pieces."""
    nl, nr = first_l[p + 1] - first_l[p], first_r[q + 1] - first_r[q]
    piece = np.cumsum(nl * nr) // 200_000
    for k in np.unique(piece):
        x, y, n, m = (v[piece == k] for v in (p, q, nl, nr))
        yield np.repeat(spans(first_l[x], n), np.repeat(m, n)), spans(np.repeat(first_r[y], n), np.repeat(m, n))


def grown(pdf: pd.DataFrame) -> pd.DataFrame:
    """The cover tree of one chunk as a row; components that single precision holds are stored in it."""
    pdf = pdf.sort_values("vec_id")
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]])
    order, starts, centres, radii = Tree.built(unit(rows))
    packed = [[a.tobytes() for a in level] for level in (starts, centres, radii)]
    key = [int(pdf[c].iloc[0]) for c in ("dim", "cell", "part")]
    with np.errstate(over="ignore"):
        short = rows.astype(np.float32)
    data = (short if (short == rows).all() else rows)[order].tobytes()
    return pd.DataFrame([[*key, pdf["vec_id"].to_numpy(dtype=np.int64)[order].tobytes(), data, *packed]], columns=[c.split()[0] for c in TREE.split(", ")])


def chained(centres: np.ndarray) -> list[int]:
    """Places of the centres, each followed by the nearest one that is left."""
    order, left = [0], np.ones(len(centres), dtype=bool)
    while len(order) < len(centres):
        left[order[-1]] = False
        order.append(int(np.where(left, centres @ centres[order[-1]], -2).argmax()))
    return order


def near_vectors(vectors: DataFrame, cosine: float = COSINE, chunk_rows: int = CHUNK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """One row for each vec_id: n_links (other vectors with at least this cosine), component_id, kept.

    Cosines are taken in double precision, whatever the labels. Vectors that are null, empty or zero, or hold null, NaN or
    infinite components link with nothing; neither do vectors of different lengths. Rows of one vec_id are one vector, the
    smallest where they differ; rows without an id are one more, which links with nothing, has a null component and is kept.

    The top of the tree is fitted on at most `pivots` hashed vectors: centres with falling radii, one for each `chunk_rows`
    vectors. Every vector goes to its nearest centre; large cells are cut into chunks by a hash, so a group of copies is
    no larger in a task than others. Each chunk grows its cover tree in one task. Groups of chunks meet in pairs, one pair
    of groups at a time, so a chunk is sent once for each other group: the trees of one side stay in the task, those of the
    other pass by. Groups without cells that the threshold and both covering radii let touch are pruned, and so are chunks;
    the trees of all other chunks are traversed. A task returns one row for each vector that links, so links inside a group
    of copies are counted but never listed. The driver holds only the sample, the centres and one row for each cell and
    each group.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    each = given.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    each = saved(each.withColumn("dim", F.when(usable(F.col("embedding")) & F.col("vec_id").isNotNull(), F.size("embedding")).otherwise(0)), "vectors")
    good = each.where("dim > 0")
    sizes = {r["dim"]: r["n"] for r in good.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    centres, bases = {}, {}
    for dim, n in sizes.items():
        rows = [r["embedding"] for r in sample if r["dim"] == dim]
        rows = unit(np.array(rows)) if rows else np.zeros((1, dim))
        centres[dim], bases[dim] = net(rows, min(pivots, -(-n // chunk_rows))), leading(rows, cosine)
    shared = spark.sparkContext.broadcast((centres, bases))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                rows = batch.column("embedding").take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                cos = unit(rows) @ shared.value[0][int(dim)].T
                cell[at], far[at] = cos.argmax(1), chord(cos.max(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    placed = saved(good.mapInArrow(dealt, "vec_id long, embedding array<double>, dim int, cell int, far double"), "placed")
    cells = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
    reach = float(chord(np.array(cosine)))
    spots, meets, tasks = [], [], 0
    for dim in sizes:
        own = {r["cell"]: r for r in cells if r["dim"] == dim}
        own = [r for c in chained(centres[dim]) if (r := own.get(c))]
        parts = np.array([-(-r["n"] // chunk_rows) for r in own])
        first = np.cumsum(parts) - parts
        most = max(1, min(SIDE_BYTES // (8 * dim * chunk_rows), -(-int(parts.sum()) // GROUPS)))
        spots += [{"dim": dim, "cell": r["cell"], "parts": int(n), "first": int(f), "most": most} for r, n, f in zip(own, parts, first)]
        at, far = centres[dim][[r["cell"] for r in own]], np.array([r["far"] for r in own])
        touch = chord(at @ at.T) <= reach + far[:, None] + far + SLACK
        np.fill_diagonal(touch, True)
        low, high = first // most, (first + parts - 1) // most
        for g in range(int(high.max()) + 1):
            # Cells that a cell of this group may touch, then the groups of chunks that they lie in.
            other = touch[(low <= g) & (g <= high)].any(0)
            others = np.unique(spans(low[other], high[other] - low[other] + 1))
            meets.append({"dim": dim, "spot": g, "others": others.tolist()})
            tasks += int((others >= g).sum())
    spots = spark.createDataFrame(pa.Table.from_pylist(spots, pa.schema([(c, pa.int32()) for c in ("dim", "cell", "parts", "first", "most")])))
    meets = spark.createDataFrame(pa.Table.from_pylist(meets, pa.schema([("dim", pa.int32()), ("spot", pa.int32()), ("others", pa.list_(pa.int32()))])))
    chunks = placed.join(F.broadcast(spots), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    trees = saved(chunks.select("vec_id", "embedding", "dim", "cell", "part").groupBy("dim", "cell", "part").applyInPandas(grown, TREE), "trees")

    met = trees.join(F.broadcast(spots), ["dim", "cell"]).withColumn("spot", F.expr("(first + part) div most").cast("int")).join(F.broadcast(meets), ["dim", "spot"])
    met = met.select("dim", "spot", F.explode("others").alias("other"), "ids", "data", "starts", "centres", "radii")
    # The group of the smaller number stays in the task, so its chunks come first.
    met = met.select("dim", F.least("spot", "other").alias("a"), F.greatest("spot", "other").alias("b"), F.expr("spot > other").alias("passes"), "ids", "data", "starts", "centres", "radii")
    met = met.repartition(min(max(tasks, 1), 10_000), "dim", "a", "b").sortWithinPartitions("dim", "a", "b", "passes")
    found = saved(met.mapInArrow(compared(cosine, shared), "vec_id long, links long, root long"), "found")

    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n"))
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = each.select("vec_id").join(counts, "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def compared(cosine: float, shared):
    """Traversal of the trees of each task (dim, a, b): every chunk of a with every one of b, or all pairs inside a."""
    reach = float(chord(np.array(cosine)))

    def tree(batch: pa.RecordBatch, k: int, dim: int) -> tuple[np.ndarray, Tree]:
        get = lambda name, kind: [np.frombuffer(b, dtype=kind) for b in batch.column(name)[k].as_py()]
        ids, data = (batch.column(name)[k].as_py() for name in ("ids", "data"))
        ids = np.frombuffer(ids, dtype=np.int64)
        x = unit(np.frombuffer(data, dtype=np.float32 if len(data) == 4 * len(ids) * dim else np.float64).reshape(-1, dim))
        return ids, Tree(x, get("starts", np.int64), get("centres", np.int64), get("radii", np.float64), shared.value[1][dim])

    def linked(ids: np.ndarray, left: Tree, right: Tree | None) -> Iterator[pa.RecordBatch]:
        if right is None or chord(left.middle @ right.middle) <= reach + left.radius + right.radius + SLACK:
            n, label = traversed(left, right, cosine)
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at]), pa.array(ids[label[at]])], ["vec_id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, stay = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                dim, a, b, passes = (batch.column(name)[k].as_py() for name in ("dim", "a", "b", "passes"))
                if task != (dim, a, b):
                    task, stay = (dim, a, b), []
                ids, one = tree(batch, k, dim)
                if a == b:
                    yield from linked(ids, one, None)
                if a == b or passes:
                    for more, other in stay:
                        yield from linked(np.concatenate((more, ids)), other, one)
                if not passes:
                    stay.append((ids, one))

    return run


# Check text of the query: links of all pairs, then the smallest id that links reach.
SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, coalesce(e.vec_id = c.component_id, true) AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
"""
