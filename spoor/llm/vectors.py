"""Problem 1: the k most similar vectors of every vector.

Method: a hierarchical k-means tree, fitted on a bounded sample, indexes all
rows; each query walks it best bin first through a priority queue, which holds
the children of opened nodes only, and visits
as many leaves as a calibration against brute force asks for. Calibration queries are
vectors that the tree was not fitted on; half of them choose the visits, the other half
measure the recall that is reported (``p1_recall``).

Plan. Vectors are packed to 16-bit integers in one narrow pass and written
once. Equal vectors collapse into one class (keyed by a 64-bit hash of the packed
vector), so that a group of copies costs one search however large it is. Classes are sent to their home leaf as data
and to the first ``visits`` leaves of their walk as queries, in rounds of so many queries that no round shuffles more than
ROUND + 1 copies of the vectors however many visits the calibration asks for; a round's files are deleted before the next. Each leaf is one
group (large leaves are split into blocks, which all queries of the leaf
visit, and the queries of a block into chunks, each with the data of the block), compared by matrix products. Per query and leaf at most ``k`` rows
leave the group, and a windowed top-k merges them.

Defined results
* null, empty, all-zero vectors and vectors holding null, NaN or infinite
  elements are unusable: they are neither queries nor neighbours;
* only vectors of equal length compare;
* rows with the same id count once; ties between units are broken by the smaller id,
  among more than k different vectors at the same distance by their hash;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.runtime import load, materialize, swept

#: Vectors on which a tree is fitted: FIT_A_LEAF for each leaf wished for, at least and at most these (documented bounds of the
#: sample). At most means that beyond 33 million vectors leaves grow.
FIT_A_LEAF, FIT_LEAST, FIT_MOST = 16, 32_768, 262_144
#: Share of vectors that a tree may be fitted on; the others are held out.
FIT_SHARE = 0.8
#: Vectors wished for in a leaf.
LEAF_SIZE = 2_048
#: Points of the sample in a leaf, at least: bounds a tree to FIT_MOST / LEAST_POINTS leaves and its broadcast to that times dim * 4 bytes.
LEAST_POINTS = 12
#: Children of an inner node.
BRANCHING = 16
#: Data rows of one leaf compared in one task; more are split into blocks.
BLOCK = 8_192
#: Queries wished for in one task.
CHUNK = 32_768
#: Copies of the vectors that one round of the search sends to leaves as queries, at most.
ROUND = 4
#: Bits of the hash that deals queries out to rounds, blocks and chunks.
SALT = 20
#: Rows that walk the tree together.
WALK = 4_096
#: Queries of the calibration against brute force.
CALIBRATION = 1_536
#: Dimensions with fewer vectors than this are compared in one leaf.
SMALL = 1_024

PACKED = "unit_id string, dim int, scale double, q binary"


def _pack(batches):
    """Arrow batches (unit_id, embedding) to packed rows, unusable vectors left out."""
    for batch in batches:
        ids = batch.column(0)
        lists = batch.column(1)
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        offsets = lists.offsets.to_numpy()
        values = lists.values.cast(pa.float64())
        flat = values.to_numpy(zero_copy_only=False)
        if values.null_count:
            flat = np.where(values.is_valid().to_numpy(zero_copy_only=False), flat, np.nan)
        valid = lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.where(valid, np.diff(offsets), 0)
        out_ids, dims, scales, packed = [], [], [], []
        for dim in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == dim)
            x = flat[offsets[rows][:, None] + np.arange(dim)]
            top = np.abs(x).max(axis=1)
            ok = np.isfinite(x).all(axis=1) & (top > 0)
            rows, x, top = rows[ok], x[ok], top[ok]
            if not len(rows):
                continue
            # values of four decimals fit a 16-bit grid without loss
            grid = np.rint(x * 1e4)
            exact = (np.abs(x * 1e4 - grid) < 1e-6).all(axis=1) & (top * 1e4 <= 32767)
            scale = np.where(exact, 1e-4, top / 32767)
            q = np.rint(x / scale[:, None]).astype("<i2")
            out_ids.append(ids.take(pa.array(rows)))
            dims.append(np.full(len(rows), dim, "i4"))
            scales.append(scale)
            raw = q.tobytes()
            step = int(dim) * 2
            packed.append(
                pa.Array.from_buffers(
                    pa.binary(),
                    len(rows),
                    [None, pa.py_buffer(np.arange(0, len(raw) + 1, step, dtype="i4").tobytes()), pa.py_buffer(raw)],
                )
            )
        if out_ids:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(out_ids),
                    pa.array(np.concatenate(dims)),
                    pa.array(np.concatenate(scales)),
                    pa.concat_arrays(packed),
                ],
                names=["unit_id", "dim", "scale", "q"],
            )


def packed_vectors(df: DataFrame, id_col: str = "unit_id", vec_col: str = "embedding") -> DataFrame:
    """Usable vectors as 16-bit integers with a scale; one narrow pass."""
    src = df.select(F.col(id_col).cast("string").alias("unit_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    return src.where(F.size("embedding") > 0).mapInArrow(_pack, PACKED)


def _matrix(column, dim: int) -> np.ndarray:
    """The int16 rows of a binary Arrow column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, dim), "<i2")
    start = column.offset
    offsets = np.frombuffer(column.buffers()[1], "i4")[start : start + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], "u1")[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), "<i2").reshape(-1, dim)


def _unit(q: np.ndarray) -> np.ndarray:
    x = q.astype("f4")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- the tree ------------------------------------------------------------


@dataclass
class Tree:
    """Centroids of all nodes; node 0 is the root; children[n] is empty for leaves."""

    centroids: np.ndarray
    children: list[np.ndarray]

    @property
    def leaves(self) -> int:
        return sum(not len(c) for c in self.children)

    def __post_init__(self):
        widest = max([1, *(len(c) for c in self.children)])
        self.kids = np.full((len(self.children), widest), -1, "i4")
        for node, c in enumerate(self.children):
            self.kids[node, : len(c)] = c
        self.is_leaf = self.kids[:, 0] < 0

    def walk(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` leaves of each row's best-bin-first walk, -1 beyond."""
        return np.concatenate([np.empty((0, visits), "i4"), *(self._walk(x[i : i + WALK], visits) for i in range(0, len(x), WALK))])

    def _walk(self, x: np.ndarray, visits: int) -> np.ndarray:
        """Rows advance together: a queue holds the opened nodes' children and their similarity to the row, and
        one step takes the best of every row's queue. An inner node is replaced by its children, a leaf is a visit."""
        out = np.full((len(x), visits), -1, "i4")
        if len(self.children) == 1:
            out[:, 0] = 0
            return out
        width = self.kids.shape[1]
        queue = np.full((len(x), 4 * width), -np.inf, "f4")
        nodes = np.zeros((len(x), 4 * width), "i4")
        used = np.zeros(len(x), "i4")
        count = np.zeros(len(x), "i4")
        live, opened = np.arange(len(x)), np.zeros(len(x), "i4")
        while True:
            # the rows ``live`` open the inner nodes ``opened``
            if len(live) and int(used[live].max()) + width > queue.shape[1]:
                queue = np.concatenate([queue, np.full_like(queue, -np.inf)], axis=1)
                nodes = np.concatenate([nodes, np.zeros_like(nodes)], axis=1)
            kids = self.kids[opened]
            near = np.einsum("rkd,rd->rk", self.centroids[kids], x[live])
            near[kids < 0] = -np.inf
            at = used[live][:, None] + np.arange(width)
            queue[live[:, None], at], nodes[live[:, None], at] = near, kids
            used[live] += width
            # then all take leaves until the best node is an inner one
            going = live
            live, opened = [], []
            while len(going):
                best = queue[going].argmax(axis=1)
                found = queue[going, best] > -np.inf
                going, best = going[found], best[found]
                queue[going, best] = -np.inf
                node = nodes[going, best]
                leaf = self.is_leaf[node]
                live.append(going[~leaf]), opened.append(node[~leaf])
                rows = going[leaf]
                out[rows, count[rows]] = node[leaf]
                count[rows] += 1
                going = rows[count[rows] < visits]
            live, opened = np.concatenate([np.empty(0, "i8"), *live]), np.concatenate([np.empty(0, "i4"), *opened])
            if not len(live):
                return out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        present, first = np.unique(own[order], return_index=True)
        total = np.zeros_like(centres)
        total[present] = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-9), centres)
    return centres


def fit_tree(x: np.ndarray, leaf_points: int, seed: int = 7) -> Tree:
    """Hierarchical k-means over unit rows; splits nodes holding more than ``leaf_points``."""
    rng = np.random.default_rng(seed)
    centroids, children = [x.mean(axis=0) if len(x) else np.zeros(1, "f4")], [np.array([], "i4")]
    todo = [(0, x)]
    while todo:
        node, part = todo.pop()
        k = min(BRANCHING, -(-len(part) // leaf_points))
        if k < 2:
            continue
        centres = _kmeans(part, k, rng)
        own = (part @ centres.T).argmax(axis=1)
        used = np.unique(own)
        if len(used) < 2:
            continue
        children[node] = np.arange(len(centroids), len(centroids) + len(used), dtype="i4")
        for c in used:
            centroids.append(centres[c])
            children.append(np.array([], "i4"))
            todo.append((len(centroids) - 1, part[own == c]))
    return Tree(np.array(centroids, "f4"), children)


# --- calibration -----------------------------------------------------------


def _brute(packed: DataFrame, queries: np.ndarray, dim: int, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Exact neighbours of the calibration queries over all rows: (query, packed row).

    The queries are bounded by CALIBRATION; every task returns at most k rows
    a query, merged here a batch at a time.
    """
    holder = packed.sparkSession.sparkContext.broadcast(queries)

    def scan(batches):
        x = _unit(holder.value)
        for batch in batches:
            y = _unit(_matrix(batch.column(0), dim))
            s = x @ y.T
            n = min(k + 1, s.shape[1])
            b = np.argpartition(-s, n - 1, axis=1)[:, :n].ravel()
            a = np.repeat(np.arange(len(x)), n)
            if floor is not None:
                near = s[a, b] >= floor
                a, b = a[near], b[near]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.astype("i4")), pa.array(s[a, b].astype("f8")), batch.column(0).take(pa.array(b))],
                names=["a", "s", "q"],
            )

    w = Window.partitionBy("a").orderBy(F.desc("s"), "q")
    rows = (
        packed.select("q")
        .mapInArrow(scan, "a int, s double, q binary")
        .distinct()
        .withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= k + 1)
        .select("a", "q")
        .toArrow()
    )
    holder.destroy()
    return rows.column("a").to_numpy(), _matrix(rows.column("q"), dim)


def calibrate(packed: DataFrame, tree: Tree, held_out: np.ndarray, dim: int, k: int, floor: float | None, recall: float) -> tuple[int, float | None]:
    """Leaf visits that reach ``recall`` on one half of the queries, and the recall reached on the other (None without any neighbour)."""
    a, near = _brute(packed, held_out, dim, k, floor)
    own = (near == held_out[a]).all(axis=1) if len(a) else np.zeros(0, bool)
    a, near = a[~own], near[~own]
    fits = a % 2 == 0
    if not fits.any():
        return min(4, tree.leaves), None
    home = tree.walk(_unit(near), 1)[:, 0]
    x, tried = _unit(held_out), 8
    while True:
        # the walk is widened until the share asked for is within it
        tried = min(tried, tree.leaves)
        met = tree.walk(x, tried)[a] == home[:, None]
        place = np.where(met.any(axis=1), met.argmax(axis=1), tried)
        ranked = np.sort(place[fits])
        need = int(ranked[min(len(ranked) - 1, int(np.ceil(recall * len(ranked))) - 1)]) + 1
        if need <= tried or tried == tree.leaves:
            break
        tried *= 2
    visits = min(tree.leaves, max(2, need))
    return visits, float((place[~fits] < visits).mean()) if (~fits).any() else None


# --- the search --------------------------------------------------------------


def _home(trees):
    """The leaf of each class; leaf 0 where its length has no tree."""

    def home(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                tree, _ = trees.value.get(int(dim), (None, 1))
                part = batch.filter(pa.array(dims == dim))
                at = tree.walk(_unit(_matrix(part.column("q"), int(dim))), 1)[:, 0] if tree else np.zeros(part.num_rows, "i4")
                yield part.append_column("home", pa.array(at.astype("i4")))

    return home


def _route(trees: dict, blocks: dict, chunks: dict, turn: int, rounds: int):
    def route(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                home, salt = part.column("home").to_numpy(), part.column("salt").to_numpy().astype("i8")
                asks = part.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                # the queries of this round
                asking = np.flatnonzero(asks & (salt * rounds >> SALT == turn))
                tree, visits = trees.get(int(dim), (None, 1))
                if tree is None:
                    leaves = np.zeros((len(asking), 1), "i4")
                else:
                    leaves = tree.walk(_unit(_matrix(part.column("q").take(pa.array(asking)), int(dim))), visits)
                rows, leaf, block, chunk, role = [], [], [], [], []
                split = lambda held, at: np.array([held.get((int(dim), int(h)), 1) for h in at], "i4")
                # data goes to its block, in each chunk of queries that meets it
                nc = split(chunks, home)
                copies = np.repeat(np.arange(part.num_rows), nc)
                rows.append(copies), leaf.append(home[copies]), block.append((salt % split(blocks, home))[copies]), role.append(np.zeros(len(copies), "i1"))
                chunk.append(np.arange(len(copies)) - np.repeat(np.cumsum(nc) - nc, nc))
                for v in range(leaves.shape[1]):
                    met = leaves[:, v] >= 0
                    who, at = asking[met], leaves[met, v]
                    nb = split(blocks, at)
                    first = np.repeat(np.cumsum(nb) - nb, nb)
                    rows.append(np.repeat(who, nb)), leaf.append(np.repeat(at, nb)), block.append(np.arange(len(first)) - first), role.append(np.ones(len(first), "i1"))
                    chunk.append(np.repeat(salt[who] // 64 % split(chunks, at), nb))
                rows = np.concatenate(rows)
                taken = part.select(["vkey", "dim", "q"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        *taken.columns,
                        pa.array(np.concatenate(leaf).astype("i4")),
                        pa.array(np.concatenate(block).astype("i4")),
                        pa.array(np.concatenate(chunk).astype("i4")),
                        pa.array(np.concatenate(role).astype("i1")),
                    ],
                    names=["vkey", "dim", "q", "leaf", "block", "chunk", "role"],
                )

    return route


def _compare(k: int, floor: float | None):
    def compare(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        role = table.column("role").to_numpy()
        data, ask = table.filter(pa.array(role == 0)), table.filter(pa.array(role == 1))
        out_a, out_b, out_s = [], [], []
        if data.num_rows and ask.num_rows:
            dq, aq = _matrix(data.column("q"), dim), _matrix(ask.column("q"), dim)
            d, kd, ka = _unit(dq), data.column("vkey").to_numpy(), ask.column("vkey").to_numpy()
            spare = k + 6
            step = max(1, 8_000_000 // max(1, len(d)))
            for s0 in range(0, len(aq), step):
                x = aq[s0 : s0 + step]
                s = _unit(x) @ d.T
                if floor is not None:
                    a, b = np.nonzero(s >= floor - 1e-4)
                if floor is None or len(a) > spare * len(x):
                    n = min(spare, s.shape[1])
                    b = np.argpartition(-s, n - 1, axis=1)[:, :n].ravel()
                    a = np.repeat(np.arange(len(x)), n)
                if not len(a):
                    continue
                other = kd[b] != ka[s0 + a]
                a, b = a[other], b[other]
                xi, yi = x[a].astype("i8"), dq[b].astype("i8")
                exact = (xi * yi).sum(axis=1) / np.sqrt((xi * xi).sum(axis=1).astype("f8") * (yi * yi).sum(axis=1).astype("f8"))
                if floor is not None:
                    keep = exact >= floor
                    a, b, exact = a[keep], b[keep], exact[keep]
                order = np.lexsort((kd[b], -exact, a)) if len(a) else np.array([], int)
                a, b, exact = a[order], b[order], exact[order]
                if len(a):
                    first = np.r_[True, a[1:] != a[:-1]]
                    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
                    keep = rank < k
                    out_a.append(ka[s0 + a[keep]]), out_b.append(kd[b[keep]]), out_s.append(exact[keep])
        return pa.table(
            {
                "a": np.concatenate([np.empty(0, "i8"), *out_a]),
                "b": np.concatenate([np.empty(0, "i8"), *out_b]),
                "cosine": np.concatenate([np.empty(0, "f8"), *out_s]),
            }
        )

    return compare


def fitted(packed: DataFrame, k: int, floor: float | None, recall: float) -> tuple[dict, dict]:
    """(tree, visits) of each length with SMALL vectors or more, and what is known of it."""
    with swept(packed.sparkSession):
        sizes = {r["dim"]: r["n"] for r in packed.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") >= SMALL).collect()}
    trees, report = {}, {}
    for dim, n in sizes.items():
        of_dim = packed.where(F.col("dim") == dim)
        place = F.pmod(F.xxhash64("unit_id"), F.lit(1 << 30))
        wanted = min(FIT_MOST, max(FIT_LEAST, FIT_A_LEAF * n // LEAF_SIZE))
        chosen = int(min(FIT_SHARE, wanted / n) * (1 << 30))
        asked = 2 * (CALIBRATION if floor is not None else CALIBRATION // 6)
        held_from = (1 << 30) - int(min(1 - FIT_SHARE, asked / n) * (1 << 30))
        # both are chosen by hash, so their sizes are as expected but for chance
        rows = of_dim.where((place < chosen) | (place >= held_from)).select("q", (place >= held_from).alias("held")).toArrow()
        held = rows.column("held").to_numpy(zero_copy_only=False)
        every = _matrix(rows.column("q"), dim)
        sample, held_out = every[~held], every[held][:asked]
        tree = fit_tree(_unit(sample), max(LEAST_POINTS, round(LEAF_SIZE * len(sample) / n)))
        with swept(packed.sparkSession):
            visits, got = calibrate(of_dim, tree, held_out, dim, k, floor, recall)
        trees[dim] = (tree, visits)
        report[dim] = {"vectors": n, "leaves": tree.leaves, "visits": visits, "recall": got}
    return trees, report


def similar_vectors(
    df: DataFrame,
    k: int = 10,
    floor: float | None = None,
    recall: float = 0.98,
    id_col: str = "unit_id",
    vec_col: str = "embedding",
    asks=None,
) -> DataFrame:
    """(unit_id, rank, neighbour_id, cosine): the ``k`` most similar vectors of each vector.

    ``floor`` leaves out neighbours of a smaller cosine, which lets the walk
    end early; ``recall`` is the share of true neighbours (at or above the
    floor) that the calibrated number of leaf visits must reach. ``asks`` is a
    condition over ``unit_id`` that limits the queries, never the data.
    """
    spark = df.sparkSession
    packed = materialize(packed_vectors(df, id_col, vec_col), "p1-packed")
    trees, similar_vectors.report = fitted(packed, k, floor, recall)
    asks = F.lit(True) if asks is None else asks
    keyed = packed.withColumn("vkey", F.xxhash64("dim", "scale", "q")).withColumn("asks", asks)
    classes = keyed.groupBy("vkey").agg(
        F.first("dim").alias("dim"), F.first("q").alias("q"), F.max("asks").alias("asks")
    ).withColumn("salt", F.pmod(F.hash("vkey"), F.lit(1 << SALT)))
    held = spark.sparkContext.broadcast(trees)
    classes = materialize(classes.mapInArrow(_home(held), "vkey long, dim int, q binary, asks boolean, salt int, home int"), "p1-classes")
    most = max([1, *(v for _, v in trees.values())])
    with swept(spark):
        n, asked = classes.agg(F.count("*"), F.count_if("asks")).first()
        rounds = max(1, -(-most * asked // (ROUND * max(1, n))))
        heavy = (
            classes.groupBy("dim", "home")
            .agg(F.count("*").alias("n"))
            .where((F.col("n") > BLOCK) | (F.col("n") * most > CHUNK * rounds))
            .collect()
        )
    # at most a row for each leaf of the trees
    blocks = {(r["dim"], r["home"]): -(-r["n"] // BLOCK) for r in heavy}
    # as many queries visit a leaf as it has rows, times the visits of each, more or less
    chunks = {(r["dim"], r["home"]): -(-r["n"] * trees.get(r["dim"], (None, 1))[1] // (CHUNK * rounds)) for r in heavy}
    top = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")

    def found(turn: int) -> DataFrame:
        hits = (
            classes.mapInArrow(lambda it: _route(held.value, blocks, chunks, turn, rounds)(it), "vkey long, dim int, q binary, leaf int, block int, chunk int, role byte")
            .groupBy("dim", "leaf", "block", "chunk")
            .applyInArrow(_compare(k, floor), "a long, b long, cosine double")
        )
        return hits.distinct().withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r")

    # a query is in one round only, so its list is whole there
    hits = found(0) if rounds == 1 else functools.reduce(DataFrame.unionByName, [materialize(found(turn), "p1-hits") for turn in range(rounds)])
    # from classes back to units; a class lends at most k + 1 of its members as neighbours
    members = keyed.select("vkey", "unit_id", "asks").distinct()
    lent = (
        members.withColumn("r", F.row_number().over(Window.partitionBy("vkey").orderBy("unit_id")))
        .where(F.col("r") <= k + 1)
        .select(F.col("vkey").alias("b"), F.col("unit_id").alias("neighbour_id"), "r")
    )
    own = lent.where(F.col("r") == 2).select(F.col("b").alias("a"), "b", F.lit(1.0).alias("cosine"))
    near = hits.unionByName(own).join(lent.drop("r"), "b").select("a", "neighbour_id", "cosine")
    # a member leaves out only itself, so k + 1 of its class's candidates are enough for each
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "neighbour_id"))).where(F.col("r") <= k + 1).drop("r")
    asked = members.where("asks").select(F.col("vkey").alias("a"), "unit_id")
    ranked = Window.partitionBy("unit_id").orderBy(F.desc("cosine"), "neighbour_id")
    return (
        asked.join(near, "a")
        .where(F.col("unit_id") != F.col("neighbour_id"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("unit_id", "rank", "neighbour_id", "cosine")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of units of which one is among the other's 10 most similar, cosine >= 0.90."""
    near = similar_vectors(load(spark, sf_dir, "trace_units"), k=10, floor=0.90)
    return near.select(
        F.least("unit_id", "neighbour_id").alias("unit_id_a"), F.greatest("unit_id", "neighbour_id").alias("unit_id_b")
    ).distinct()


def p1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar units of every twentieth unit (by hash of its id), against all units."""
    asks = F.pmod(F.xxhash64("unit_id"), F.lit(20)) == 0
    near = similar_vectors(load(spark, sf_dir, "trace_units"), k=10, recall=0.95, asks=asks)
    return near.withColumn("cosine", F.round("cosine", 6))


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each length of vector with a tree: vectors, leaves, visits, and the recall on held-out queries against brute force."""
    packed = materialize(packed_vectors(load(spark, sf_dir, "trace_units")), "p1-packed")
    _, report = fitted(packed, 10, None, 0.95)
    rows = [(d, r["vectors"], r["leaves"], r["visits"], r["recall"]) for d, r in report.items()]
    return spark.createDataFrame(rows, "dim int, vectors long, leaves int, visits int, recall double")


QUERIES = {"p1_found": p1_found, "p1_topk": p1_topk, "p1_recall": p1_recall}
ORACLE: dict[str, str] = {}
