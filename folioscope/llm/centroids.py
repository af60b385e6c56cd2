"""Clustering around centroids in whole numbers, filtered by ball trees.

Each partition turns its vectors, 4,096 at a time, into metric trees: a node
stores the count and the whole-number sum of its vectors and the radius of the
ball around their mean. The trees are a table in the shared folder; all rounds
read them, so that a lost executor costs the tasks that it ran. A round sends the
centroids to the trees. By the triangle inequality a node drops each centroid
that is further from every point of its ball than another one is; with one left
the whole ball is that centroid's, and its count and sum are added at once,
otherwise the node's halves go on, down to leaves, whose vectors are held against
all centroids in exact arithmetic. Tasks add up what they assign; the driver sees
a sum for each centroid and component, however many vectors there are.

Distances to balls are in floating point with a margin, and only decide whether
a ball goes as a whole; all else is in whole numbers. Equal distances go to the
smaller number.

Defined results: vectors that are null, of another length, or with a component
that is null or not finite are left out; repeated rows and ids are vectors of
their own; a null id is hashed as ``null``; fewer vectors than centroids make
fewer centroids; no vectors give an empty result; other columns are ignored. A
component beyond +-LARGEST after scaling raises an error, as squared distances
would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import trimmed, work_dir, written

#: Vectors of a tree, of a leaf, and the largest component.
IN_TREE, IN_LEAF, LARGEST = 4096, 32, 1 << 27
#: Components up to this make all products exact in floating point too.
EXACT = 1 << 22


def whole_vectors(df: DataFrame, vec_id: str, vector: str, width: int, scale: int) -> DataFrame:
    """``id, v``: the vectors that count, as ``floor(scale * x)``."""
    x = F.transform(vector, lambda c: c.cast("double"))
    wanted = df.where(F.size(vector) == width).select(F.col(vec_id).alias("id"), x.alias("x"))
    good = wanted.where(F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    scaled = F.transform("x", lambda c: F.floor(c * scale))
    fits = F.forall("x", lambda c: F.abs(c * scale) <= LARGEST)
    return good.select("id", F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).cast("array<int>").alias("v"))


class Tree:
    """Vectors in the order of a metric tree's leaves, and its nodes from the root down."""

    def __init__(self, vectors: np.ndarray, nodes: dict[str, np.ndarray]):
        self.vectors, self.nodes = vectors, nodes

    @staticmethod
    def grown(vectors: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree and the order in which it keeps the vectors: a node is split at the median of its widest direction."""
        order, rows, queue = np.arange(len(vectors)), [], [(0, len(vectors))]
        for lo, hi in queue:  # grows while it is walked: nodes level by level
            own = vectors[order[lo:hi]]
            total = own.sum(axis=0, dtype=np.int64)
            away = own - total / (hi - lo)
            square = np.einsum("ij,ij->i", away, away)
            left = -1
            if hi - lo > IN_LEAF and square.max() > 0:
                far = away[square.argmax()]
                other = away[np.einsum("ij,ij->i", away - far, away - far).argmax()]
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(away @ (far - other), mid)]
                left = len(queue)
                queue += [(lo, lo + mid), (lo + mid, hi)]
            rows.append((lo, hi, left, float(np.sqrt(square.max())), total))
        nodes = {n: np.array([r[k] for r in rows]) for k, n in enumerate(("lo", "hi", "left", "radius", "sum"))}
        return Tree(vectors[order], nodes), order

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``centroid, node, -1`` for whole balls and ``-1, lo, hi`` for vectors of leaves to be compared one by one."""
        n, c = self.nodes, centroids.astype(float)
        means = n["sum"] / (n["hi"] - n["lo"])[:, None]
        level, left_in = np.array([0]), np.ones((1, len(c)), bool)
        while len(level):
            to = np.sqrt(((means[level, None, :] - c) ** 2).sum(axis=2)) if len(level) < 64 else np.sqrt(_squares(means[level], c))
            slack = n["radius"][level] * (1 + 1e-9) + 1e-6 * (1 + to.max(axis=1))
            left_in &= (to - slack[:, None]) <= (to + slack[:, None]).min(axis=1)[:, None]
            one = left_in.sum(axis=1) == 1
            for node, z in zip(level[one].tolist(), left_in[one].argmax(axis=1).tolist(), strict=True):
                yield z, node, -1
            leaf = ~one & (n["left"][level] < 0)
            for node in level[leaf].tolist():
                yield -1, int(n["lo"][node]), int(n["hi"][node])
            inner = ~one & ~leaf
            level, left_in = np.concatenate([n["left"][level[inner]], n["left"][level[inner]] + 1]), np.concatenate([left_in[inner]] * 2)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1), 0)


def exact_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole vectors to all centroids, as 64-bit numbers without rounding."""
    small = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT and x.shape[1] <= 1 << 7
    if small:
        return _squares(x.astype(float), c.astype(float)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - z) ** 2).sum(axis=1) for z in c], axis=1)


def _labels(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The centroid of every vector of the tree, and the balls that went as a whole."""
    label, balls, apart = np.full(len(tree.vectors), -1), [], []
    for z, a, b in tree.assigned(centroids):
        if z >= 0:
            balls.append((z, a))
            label[tree.nodes["lo"][a] : tree.nodes["hi"][a]] = z
        else:
            apart.append(np.arange(a, b))
    if apart:
        at = np.concatenate(apart)
        label[at] = exact_squares(tree.vectors[at], centroids).argmin(axis=1)  # the first of equal ones
        balls += [(-1, k) for k in at.tolist()]
    return label, balls


_PARTS = (("vectors", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("left", "<i4"), ("radius", "<f8"), ("sum", "<i8"))


def _trees(vectors: DataFrame, width: int, base: str) -> DataFrame:
    """A row a tree: its vectors' ids in order, and its arrays as bytes."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(vectors.schema["id"].dataType)), *[T.StructField(n, T.BinaryType()) for n, _ in _PARTS]])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def tree() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            v = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
            grown, order = Tree.grown(v)
            ids = table.column("id").combine_chunks().take(pa.array(order))
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            parts = {"vectors": grown.vectors, **grown.nodes}
            return pa.RecordBatch.from_arrays([listed, *[pa.array([np.ascontiguousarray(parts[n], kind).tobytes()], pa.binary()) for n, kind in _PARTS]], names=schema.names)

        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, IN_TREE):
                part = batch.slice(at, IN_TREE)
                if n + part.num_rows > IN_TREE:
                    yield tree()
                    n = 0
                waiting.append(part)
                n += part.num_rows
        if waiting:
            yield tree()

    return written(vectors.mapInArrow(lambda b: trimmed(grow(b)), schema), f"{base}/trees")


def _read(row: dict, width: int) -> Tree:
    arrays = {n: np.frombuffer(row[n], kind) for n, kind in _PARTS}
    return Tree(arrays.pop("vectors").reshape(-1, width), arrays | {"sum": arrays["sum"].reshape(-1, width)})


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _moved(trees: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The floors of the means of what each centroid gets; one that gets nothing stays."""
    now = np.array(centroids, np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(now), np.int64), np.zeros((len(now), width), object)
        for row in _tree_rows(batches):
            tree = _read(row, width)
            label, balls = _labels(tree, now)
            for z, node in balls:
                if z >= 0:
                    count[z] += tree.nodes["hi"][node] - tree.nodes["lo"][node]
                    total[z] += tree.nodes["sum"][node]
            at = np.array([k for z, k in balls if z < 0], np.int64)
            for z in np.unique(label[at]):
                own = at[label[at] == z]
                count[z] += len(own)
                total[z] += tree.vectors[own].sum(axis=0, dtype=np.int64)
        got = np.flatnonzero(count)
        sums = [[str(x) for x in total[z]] for z in got]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), pa.array(count[got], pa.int64()), pa.array(sums, pa.list_(pa.string()))], names=["z", "n", "sums"])

    parts = trees.drop("ids").mapInArrow(lambda b: trimmed(add(b)), "z int, n long, sums array<string>")
    each = parts.select("z", "n", F.posexplode("sums").alias("k", "s"))
    sums = each.groupBy("z", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row a centroid and component
    moved = [list(c) for c in centroids]
    for r in sums:
        moved[r.z][r.k] = int(r.s) // r.n
    return moved


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors with the smallest hashes of ``salt`` and id; of equal hashes by their components."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"), 256)
    return [list(r.v) for r in vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def clustered(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", width: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that counts."""
    spark = df.sparkSession
    base = work_dir(spark, "centroids")
    vectors = whole_vectors(df, vec_id, vector, width, scale)
    trees = _trees(vectors, width, base)
    centroids = first_centroids(vectors, k, salt)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(trees, centroids, width)
    last = np.array(centroids, np.int64).reshape(-1, width)
    schema = T.StructType([T.StructField("vec_id", df.schema[vec_id].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                tree = _read(row.drop_columns(["ids"]).to_pylist()[0], width)
                label, _ = _labels(tree, last)
                away = tree.vectors.astype(np.int64) - last[label]
                distance = (away * away).sum(axis=1)
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), pa.array(label, pa.int32()), pa.array(distance, pa.int64())], names=schema.names)

    rows = written(trees.mapInArrow(lambda b: trimmed(assign(b)), schema), f"{base}/assigned")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a centroid
    total = sum(int(r.s) for r in sums)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = spark.createDataFrame([(r.cluster, int(r.s), total, digest[r.cluster]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
