"""Approximate nearest neighbours by cosine with balanced posting lists.

Index: a bounded sample is split again and again into a few clusters of about equal size, until leaves are
small; their centroids are linked into a graph that fits memory.  Every vector is filed under its nearest centroid
and, if it lies at a boundary, under the next ones too (up to COPIES, none of which is nearer to one already chosen).
Lists of more than SPLIT vectors are split in the same way again, each by a sample of its own and by tasks, until none
is longer: so the number of lists grows with the table, and not their length.  Equal vectors are filed once.

Search: each distinct query vector walks the graph to its nearest centroids, and goes on to those of the lists that
were split; it keeps the lists whose distance is within RATIO of the nearest, PROBES at most, and more only where
these hold too few vectors.  It is compared, in double precision, with every vector of its lists, which are cut into blocks
of about BLOCK; a block returns the best for each query only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import save, ship, thinned

#: Vectors that the centroids are fitted on at most; leaf size there; copies of a boundary vector; vectors in a block.
SAMPLE, LEAF, COPIES, BLOCK = 40_000, 96, 4, 4_096
#: Vectors from which on a list is split, vectors of its sample (some), copies of a boundary vector there, and how often at most.
SPLIT, OWN_SAMPLE, OWN_COPIES, LEVELS = 16_384, 6_144, 2, 6
#: A list is searched if its centroid is within RATIO of the nearest centroid's distance, and among the PROBES nearest.
RATIO, PROBES = 1.6, 64
#: Queries in a block; centroids that a walk keeps; links of a centroid.
QUERIES, BEAM, LINKS = 2_048, 96, 24


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Labels of k clusters of about equal size: Lloyd rounds in which full clusters turn away the points that lose least by it."""
    centers = x[rng.choice(len(x), k, replace=False)]
    labels, most = np.zeros(len(x), np.int64), -(-len(x) * 5 // (4 * k))
    for _ in range(8):
        likeness = x @ centers.T
        order = np.argsort(-(likeness.max(axis=1) - np.partition(likeness, -2, axis=1)[:, -2]), kind="stable")
        room, ranked = np.full(k, most), np.argsort(-likeness, axis=1, kind="stable")
        for i in order.tolist():
            for c in ranked[i].tolist():
                if room[c]:
                    room[c] -= 1
                    labels[i] = c
                    break
        centers = _unit(np.stack([x[labels == c].mean(axis=0) if (labels == c).any() else x[rng.integers(len(x))] for c in range(k)]))
    return labels


class Centroids:
    """Unit centroids and the graph that links each to its nearest ones."""

    def __init__(self, sample: np.ndarray, leaf: int = LEAF, seed: int = 7) -> None:
        rng, x, leaves = np.random.default_rng(seed), _unit(np.unique(sample.astype(np.float64), axis=0)), []
        todo = [np.arange(len(x))]
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                leaves.append(_unit(x[rows].mean(axis=0, keepdims=True))[0])
                continue
            labels = _split(x[rows], min(8, -(-len(rows) // leaf)), rng)
            todo += [rows[labels == c] for c in range(labels.max() + 1) if (labels == c).any()]
        self.points = np.array(leaves)
        near = min(LINKS, len(self.points) - 1)
        self.graph = np.empty((len(self.points), near), np.int64)
        for i in range(0, len(self.points), 512):
            likeness = self.points[i : i + 512] @ self.points.T
            likeness[np.arange(len(likeness)), np.arange(i, i + len(likeness))] = -9
            self.graph[i : i + 512] = np.argsort(-likeness, axis=1, kind="stable")[:, :near]
        self.entries = np.unique(np.linspace(0, len(self.points) - 1, min(len(self.points), 32)).astype(np.int64))

    def nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walks of all rows of x at once: (centroids, cosines), nearest first, -1 where a walk found fewer."""
        count, beam = len(self.points), min(max(BEAM, n), len(self.points))
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), count), bool)
        at = np.broadcast_to(self.entries, (len(x), len(self.entries))).copy()
        seen[rows, at] = True
        score, done = x @ self.points[self.entries].T, np.zeros(at.shape, bool)
        while True:
            open_ = np.where(done | (at < 0), -np.inf, score)
            pick = np.argpartition(-open_, min(3, open_.shape[1] - 1), axis=1)[:, :4]
            live = np.isfinite(np.take_along_axis(open_, pick, 1))
            if not live.any() or self.graph.shape[1] == 0:
                break
            np.put_along_axis(done, pick, True, 1)
            new = self.graph[np.where(live, np.take_along_axis(at, pick, 1), 0)].reshape(len(x), -1)
            fresh = np.repeat(live, self.graph.shape[1], axis=1) & ~seen[rows, new]
            order = np.argsort(new, axis=1, kind="stable")
            ranked = np.take_along_axis(new, order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order, np.hstack([np.zeros((len(x), 1), bool), ranked[:, 1:] == ranked[:, :-1]]), 1)
            fresh &= ~twice
            r, c = np.nonzero(fresh)
            seen[r, new[r, c]] = True
            values = np.full(new.shape, -np.inf)
            values[r, c] = np.einsum("ij,ij->i", x[r], self.points[new[r, c]])
            at, score, done = np.hstack([at, np.where(fresh, new, -1)]), np.hstack([score, values]), np.hstack([done, np.zeros(new.shape, bool)])
            if at.shape[1] > beam:
                keep = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
                at, score, done = (np.take_along_axis(a, keep, 1) for a in (at, score, done))
        order = np.argsort(-score, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(at, order, 1), np.take_along_axis(score, order, 1)


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of vectors with numbers only, and not all of them zero."""
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))


def _to_numpy(column) -> np.ndarray:
    """Rows of equal length, as one matrix."""
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)


def _file(centroids, copies: int):
    def run(batches):
        own = centroids.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _unit(_to_numpy(part.column(1)))
                at, score = own.nearest(x, 4 * copies)
                between = np.clip(own.points @ own.points.T, -1, 1) if len(own.points) <= 2048 else None
                rows, lists = [], []
                for k in range(len(x)):
                    chosen: list[int] = []
                    for c, s in zip(at[k].tolist(), score[k].tolist()):
                        if c < 0 or len(chosen) == copies or chosen and 1 - s > RATIO * (1 - score[k, 0]) + 1e-12:
                            break
                        if all((between[c, d] if between is not None else own.points[c] @ own.points[d]) < s for d in chosen):
                            chosen.append(c)
                    rows += [k] * len(chosen)
                    lists += chosen
                yield pa.RecordBatch.from_arrays([*(col.take(pa.array(rows, pa.int64())) for col in part.columns), pa.array(lists, pa.int64())], names=[*batch.schema.names, "list"])

    return run


def _probe(centroids, probes: int):
    """(qkey, list, far): the nearest lists of each query and their centroids' distances."""

    def run(batches):
        own = centroids.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                at, score = own.nearest(_unit(_to_numpy(part.column(1))), probes)
                rows, cols = np.nonzero(at >= 0)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(at[rows, cols]), pa.array(1 - score[rows, cols])], ["qkey", "list", "far"])

    return run


def _fit(leaf: int):
    """The centroids of one list's own sample."""

    def run(key, table):
        points = Centroids(_to_numpy(table.column("v").combine_chunks()), leaf).points
        n = len(points) if len(points) > 1 else 0  # a list that doesn't come apart stays as it is
        return pa.table({"list": pa.array([key[0].as_py()] * n, pa.int64()), "sub": pa.array(range(n), pa.int32()), "c": pa.array(points[:n].tolist(), pa.list_(pa.float64()))})

    return run


def _within(copies: int | None, ratio: float):
    """Vectors of a block to parts of their list: the nearest one and those at whose boundary they lie, up to copies.  If None:
    queries to all parts that they may have to go to, with distances."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        x, c = _unit(_to_numpy(left.column("v").combine_chunks())) if left.num_rows else np.empty((0, 1)), None
        if left.num_rows and right.num_rows:
            right = right.sort_by("sub")
            c = _to_numpy(right.column("c").combine_chunks())
            far = 1 - x @ c.T
            n = len(c) if copies is None else min(copies, len(c))
            at = np.argsort(far, axis=1, kind="stable")[:, :n]
            near = np.take_along_axis(far, at, 1)
            ok = near <= ratio * near[:, :1] + 1e-12
            if copies is None:
                ok[:, :4] = True  # should the nearest ones hold too few
            if copies is not None:
                between = 1 - c @ c.T
                for k in range(1, n):
                    ok[:, k] &= (between[at[:, k], at[:, 0]] > near[:, k])  # no copy in a part that is nearer to the first than to the vector
            rows, cols = np.nonzero(ok)
            subs, fars = right.column("part").to_numpy()[at[rows, cols]], near[rows, cols]
        else:
            rows, subs, fars = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        first = left.column(3 if copies is None else 2).combine_chunks().take(pa.array(rows))
        if copies is None:
            return pa.table({"qkey": first, "list": pa.array(subs, pa.int64()), "far": pa.array(fars, pa.float64())})
        return pa.table({"ids": first, "v": left.column("v").combine_chunks().take(pa.array(rows)), "list": pa.array(subs, pa.int64())})

    return run


def _split_lists(filed: DataFrame, probed: DataFrame, asked: DataFrame, most: int, ratio: float) -> tuple[DataFrame, DataFrame]:
    """filed (ids, v, list) and probed (qkey, list, far) with lists of more than `most` vectors split; asked has (qkey, v)."""
    for _ in range(LEVELS):
        sizes = filed.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > most)
        sizes = save(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "long-lists")
        if sizes.isEmpty():
            break
        share = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) * F.col("n") <= F.lit(OWN_SAMPLE << 20)
        sample = filed.join(sizes, "list").where(share).select("list", "v")
        parts = sample.groupBy("list").applyInArrow(_fit(LEAF), "list long, sub int, c array<double>")
        parts = save(parts.withColumn("part", F.xxhash64("list", "sub")), "parts")
        real = save(parts.select("list").distinct().join(sizes, "list"), "split-lists")
        if real.isEmpty():
            break
        block = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
        own = filed.join(real.select("list", "blocks"), "list").withColumn("block", block).select("list", "block", "ids", "v")
        each = parts.join(real.select("list", "blocks"), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "sub", "c", "part")
        moved = own.groupBy("list", "block").cogroup(each.groupBy("list", "block")).applyInArrow(_within(OWN_COPIES, RATIO), "ids array<long>, v array<double>, list long")
        filed = save(filed.join(real.select("list"), "list", "left_anti").select("ids", "v", "list").unionByName(moved.distinct()), "lists")
        asks = probed.join(real.select("list"), "list").groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
        turn = F.pmod("qkey", F.col("turns")).cast("int")
        mine = probed.join(asks, "list").withColumn("turn", turn).join(asked, "qkey").select("list", "turn", "v", "qkey")
        theirs = parts.join(asks, "list").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("list", "turn", "sub", "c", "part")
        gone = mine.groupBy("list", "turn").cogroup(theirs.groupBy("list", "turn")).applyInArrow(_within(None, ratio), "qkey long, list long, far double")
        probed = save(probed.join(real.select("list"), "list", "left_anti").select("qkey", "list", "far").unionByName(gone), "probes")
    return filed, probed


def _pruned(probed: DataFrame, sizes: DataFrame, probes: int, ratio: float, least: int) -> DataFrame:
    """(qkey, list): each query's lists within ratio of its nearest, `probes` at most, and the next ones while those before hold fewer than `least` vectors."""
    own = Window.partitionBy("qkey").orderBy("far", "list")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    ranked = probed.join(sizes, "list").withColumns({"r": F.row_number().over(own), "held": F.coalesce(F.sum("n").over(before), F.lit(0)), "nearest": F.first("far").over(own)})
    return ranked.where((F.col("far") <= ratio * F.col("nearest") + 1e-12) & (F.col("r") <= probes) | (F.col("held") < least)).select("qkey", "list")


def _best(k: int):
    """For one block of a list and one of queries: each query's k + 1 best, ties by the least ids."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qkey": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        ids = left.column("ids").combine_chunks()
        v, q = (_to_numpy(t.column("v").combine_chunks()) for t in (left, right))
        likeness = _unit(q) @ _unit(v).T
        n = min(len(v), k + 5)
        near = np.argpartition(-likeness, n - 1, axis=1)[:, :n]
        rows = np.repeat(np.arange(len(q)), n)
        score = cosine(q[rows], v[near.ravel()])  # in one fixed order of additions, whatever the block
        return pa.table({"qkey": right.column("qkey").combine_chunks().take(pa.array(rows)), "ids": ids.take(pa.array(near.ravel())), "score": pa.array(score)})

    return run


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    dot = lambda x, y: np.add.reduce(x * y, axis=1)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = PROBES, ratio: float = RATIO) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of vectors, itself excepted, with the largest
    cosines found, all if there are no more; ties go to the least vec_id.

    Vectors that are null or zero or hold nulls, NaN or infinity take no part on either side, nor do null ids.  Vectors of
    different lengths are refused.  Equal vectors share one class, of which the k + 1 least ids can be among a query's k
    nearest, so no more are carried.  Repeated ids in queries are asked once.  Other columns are not looked at; no rows give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rank = Window.partitionBy("v").orderBy("vec_id")
    valid = _valid(vectors, id_col, vector_col).distinct()
    classes = save(
        valid.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")),
        "vectors",
    )
    asked = save(_valid(queries, id_col, vector_col).distinct().select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("qkey")), "queries")
    n, short, long = classes.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    sizes_asked = asked.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n or sizes_asked[0] is None:
        return spark.sql("select 1L as query_id, 1 as rank, 1L as vec_id, 1D as score").where("false")
    if {short, long, *sizes_asked} != {short}:
        raise ValueError(f"vectors of different lengths: {sorted({short, long, *sizes_asked})}")
    place = F.xxhash64("v")
    sample = thinned(classes, place, SAMPLE, n).select("v").orderBy(place, "v").limit(SAMPLE).toArrow()
    shared = spark.sparkContext.broadcast(Centroids(_to_numpy(sample.column(0).combine_chunks()), LEAF))
    distinct = save(asked.groupBy("v").agg(F.first("qkey").alias("qkey")).select("qkey", "v"), "distinct-queries")
    filed = save(classes.select("ids", "v").mapInArrow(_file(shared, COPIES), "ids array<long>, v array<double>, list long"), "lists")
    probed = save(distinct.mapInArrow(_probe(shared, max(probes, COPIES * (k + 1))), "qkey long, list long, far double"), "probes")
    filed, probed = _split_lists(filed, probed, distinct, SPLIT, ratio)
    held = save(filed.groupBy("list").agg(F.count("*").alias("n")), "list-sizes")
    kept = save(_pruned(probed, held, probes, ratio, COPIES * (k + 1)), "kept-probes")
    asks = kept.groupBy("list").agg(F.count("*").alias("m")).select("list", F.ceil(F.col("m") / QUERIES).cast("int").alias("parts"))
    cut = save(held.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).join(asks, "list"), "blocks")
    left = filed.join(cut, "list").withColumn("block", F.pmod(F.xxhash64("v"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = kept.join(cut, "list").join(distinct, "qkey").withColumn("part", F.pmod("qkey", "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = ["list", "block", "part"]
    found = left.select(*cells, "ids", "v").groupBy(*cells).cogroup(right.select(*cells, "qkey", "v").groupBy(*cells)).applyInArrow(_best(k), "qkey long, ids array<long>, score double")
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "ids")
    top = found.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("qkey", "ids", "score")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = asked.select("query_id", "qkey").join(save(top, "nearest"), "qkey").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = each.distinct().withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score").to(spark.createDataFrame([], schema).schema)
