"""Vector spaces: exact search as DataFrame expressions, an inverted file with product codes, embedders, and vector_search in SQL.

Distances: the smaller, the nearer.  l2 is squared; cosine is 1 - dot of unit vectors; dot is minus the inner product.
"""

from __future__ import annotations

import itertools
import json
import math
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.errors import EngineError

METRICS = ("l2", "cosine", "dot")
#: Vectors that centroids and codebooks are trained on at most.
TRAIN_ROWS = 65_536
#: Tasks that a list is written by, however many vectors it has.
LIST_FILES = 8


def unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Of two arrays of numbers of equal length, in double precision, in generated code."""
    double = lambda x: x.cast("double")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: double(p) * double(q)), F.lit(0.0), lambda s, z: s + z)
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda p, q: (double(p) - double(q)) * (double(p) - double(q))), F.lit(0.0), lambda s, z: s + z)
    if metric == "cosine":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    if metric == "dot":
        return -dot(a, b)
    raise EngineError(f"unknown metric '{metric}'")


def flat_search(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows, exactly: one scan and a top-k, in which each task keeps k rows only."""
    if k <= 0:
        raise EngineError("k must be positive")
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("score", distance(metric, F.col(vector_col), q)).orderBy("score", id_col).limit(k)


#: Queries that tasks hold at a time.
ASKED = 1_024


def flat_search_many(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for every row of queries the k nearest rows, exactly, ties by the least id.

    Queries go to the tasks in blocks of ASKED, and a task keeps k rows for each query of what it reads, so that what is
    shuffled is bounded by tasks, queries and k.
    """
    if k <= 0:
        raise EngineError("k must be positive")
    if metric not in METRICS:
        raise EngineError(f"unknown metric '{metric}'")
    spark, out = vectors.sparkSession, None
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("v is not null").orderBy("id").toLocalIterator(prefetchPartitions=False)
    while block := list(itertools.islice(asked, ASKED)):
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in block]), np.array([r["v"] for r in block], dtype=np.float64)))
        found = own.mapInArrow(_nearest(shared, k, metric), "query_id long, id long, score double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _nearest(shared, k: int, metric: str):
    def run(batches):
        asked, q = shared.value
        who, far, ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)  # the best so far, by query, distance and id
        most = np.full(len(q), np.inf)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x, own = _matrix(part.column(1)), part.column(0).to_numpy()
                if metric == "l2":
                    d = (q**2).sum(axis=1)[:, None] - 2 * q @ x.T + (x**2).sum(axis=1)
                else:
                    d = -(q @ x.T) if metric == "dot" else 1 - (q @ x.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1), 1e-300)
                if len(own) > k:
                    most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
                r, c = np.nonzero(d <= most[:, None])
                who, far, ids = np.concatenate([who, r]), np.concatenate([far, d[r, c]]), np.concatenate([ids, own[c]])
                order = np.lexsort((ids, far, who))
                who, far, ids = who[order], far[order], ids[order]
                near = np.arange(len(who)) - np.searchsorted(who, who) < k
                who, far, ids = who[near], far[near], ids[near]
        yield pa.RecordBatch.from_arrays([pa.array(asked[who]), pa.array(ids), pa.array(far)], ["query_id", "id", "score"])

    return run


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 20_021) -> np.ndarray:
    """Lloyd's algorithm from farthest points; empty clusters start anew at the worst-served point."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = [x[rng.integers(len(x))]]
    nearest = ((x - centers[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        centers.append(x[int(nearest.argmax())])
        np.minimum(nearest, ((x - centers[-1]) ** 2).sum(axis=1), out=nearest)
    c = np.array(centers)
    for _ in range(rounds):
        d = (c**2).sum(axis=1) - 2 * x @ c.T
        label = d.argmin(axis=1)
        n = np.bincount(label, minlength=k)
        order = np.argsort(label, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.concatenate([[0], n.cumsum()[:-1]]), len(x) - 1), axis=0)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            worst = np.argsort(-(d[np.arange(len(x)), label] + (x**2).sum(axis=1)))
            new[n == 0] = x[worst[: int((n == 0).sum())]]
        if np.allclose(new, c):
            break
        c = new
    return c


class VectorRegistry:
    """Named spaces under vectors/ of a store: metadata, appended batches as Parquet, and an index if one was trained."""

    def __init__(self, spark: SparkSession, store) -> None:
        self.spark, self.store = spark, store
        self.embedders = {"trigram": trigram}

    def create(self, name: str, dim: int, metric: str = "l2", index: str = "flat", **params: int) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
            raise EngineError(f"invalid space name '{name}'")
        if dim <= 0 or metric not in METRICS or index not in ("flat", "ivf"):
            raise EngineError("a space needs a positive dimension, the metric l2, cosine or dot, and the index flat or ivf")
        own = {"nlist": min(256, max(4, int(math.sqrt(dim)))), "m": max(1, dim // 2), "nbits": 8, "niter": 10, "refine": 8} | params
        if index == "ivf" and dim % own["m"]:
            raise EngineError(f"dimension {dim} is not a multiple of m = {own['m']}")
        meta = {"dim": dim, "metric": metric, "index": index, "next": 0, "batches": [], "indexed": 0, "lists": None, **own}
        if not self.store.put_if_absent(f"vectors/{name}/meta.json", json.dumps(meta).encode()):
            raise EngineError(f"space '{name}' already exists")

    def names(self) -> list[str]:
        return [n for n in self.store.list("vectors") if self.store.exists(f"vectors/{n}/meta.json")]

    def meta(self, name: str) -> dict:
        data = self.store.get(f"vectors/{name}/meta.json")
        if data is None:
            raise EngineError(f"unknown vector space '{name}'")
        return json.loads(data)

    def _keep(self, name: str, meta: dict) -> None:
        self.store.put(f"vectors/{name}/meta.json", json.dumps(meta).encode())

    def drop(self, name: str) -> None:
        self.meta(name)
        self.store.delete(f"vectors/{name}")

    def add(self, name: str, vectors: list[list[float]], payloads: list | None = None) -> list[int]:
        """Append vectors; ids are dense, in the order of insertion."""
        meta = self.meta(name)
        if payloads and len(payloads) != len(vectors):
            raise EngineError(f"{len(payloads)} payloads for {len(vectors)} vectors")
        if bad := [len(v) for v in vectors if len(v) != meta["dim"]]:
            raise EngineError(f"dimension {bad[0]}, not {meta['dim']}")
        ids = list(range(meta["next"], meta["next"] + len(vectors)))
        rows = [(i, [float(x) for x in v], p if p is None or isinstance(p, str) else json.dumps(p)) for i, v, p in zip(ids, vectors, payloads or [None] * len(vectors))]
        if rows:
            self.add_frame(name, self.spark.createDataFrame(rows, "id long, embedding array<double>, payload string"), len(rows))
        return ids

    def add_frame(self, name: str, df: DataFrame, n: int | None = None) -> int:
        """Append (id, embedding[, payload]) rows whose ids go on from the space's next; the way for large batches."""
        meta = self.meta(name)
        v = F.col("embedding")
        payload = F.col("payload").cast("string") if "payload" in df.columns else F.lit(None).cast("string")
        own = df.select(F.col("id").cast("long").alias("id"), F.transform(unit(v) if meta["metric"] == "cosine" else v, lambda x: x.cast("float")).alias("embedding"), payload.alias("payload"))
        batch = f"vectors/{name}/batch-{uuid.uuid4().hex[:8]}"
        own.write.parquet(f"{self.store.url}/{batch}")
        n = self.spark.read.parquet(f"{self.store.url}/{batch}").count() if n is None else n
        meta["batches"].append(batch)
        meta["next"] += n
        self._keep(name, meta)
        if meta["index"] == "ivf" and not meta["lists"] and meta["next"] >= max(64, 40 * meta["nlist"]):
            self.train(name)
        return n

    def frame(self, name: str) -> DataFrame:
        meta = self.meta(name)
        if not meta["batches"]:
            return self.spark.createDataFrame([], "id long, embedding array<float>, payload string")
        return self.spark.read.parquet(*(f"{self.store.url}/{b}" for b in meta["batches"]))

    def train(self, name: str) -> None:
        """Centroids and codebooks from a bounded sample; then every vector is filed under its list, with its codes."""
        meta = self.meta(name)
        if not meta["batches"]:
            return
        every = self.frame(name)
        place, n = F.xxhash64("id"), every.count()
        # A range of hashes first, so that no task ranks TRAIN_ROWS rows of every other task's.
        thin = every.where(place < F.lit((5 * TRAIN_ROWS << 62) // n - (1 << 63))) if n > 2 * TRAIN_ROWS else every
        sample = thin.select("id", "embedding").orderBy(place).limit(TRAIN_ROWS).select("embedding").toArrow().column(0).combine_chunks()
        x = np.asarray(sample.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(sample), -1)
        centers = kmeans(x, meta["nlist"], meta["niter"])
        books = None
        if meta["metric"] == "l2":
            rest = x - centers[((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)]
            width = meta["dim"] // meta["m"]
            books = np.stack([_padded(kmeans(rest[:, j * width : (j + 1) * width], 2 ** meta["nbits"], min(4, meta["niter"])), 2 ** meta["nbits"]) for j in range(meta["m"])])
        shared = self.spark.sparkContext.broadcast((centers, books))
        folder = f"vectors/{name}/lists-{uuid.uuid4().hex[:8]}"
        every.mapInArrow(_assign(shared, meta["metric"]), "id long, embedding array<float>, payload string, codes binary, list int").repartition("list", F.pmod(F.xxhash64("id"), F.lit(LIST_FILES))).write.partitionBy("list").parquet(f"{self.store.url}/{folder}")
        self.store.put(f"{folder}.npy", json.dumps({"centers": centers.tolist(), "books": None if books is None else books.tolist()}).encode())
        old = meta["lists"]
        meta |= {"lists": folder, "indexed": len(meta["batches"])}
        self._keep(name, meta)
        if old:
            self.store.delete(old)
            self.store.delete(f"{old}.npy")

    def search(self, name: str, query: list[float], k: int, nprobe: int = 8) -> DataFrame:
        """(id, score, payload) of the k nearest.  An index restricts the scan to nprobe lists (partition pruning), picks
        k * refine rows by their codes and ranks those exactly; vectors added since it was trained are compared as well."""
        meta = self.meta(name)
        if k <= 0:
            raise EngineError("k must be positive")
        if len(query) != meta["dim"]:
            raise EngineError(f"dimension {len(query)}, not {meta['dim']}")
        if not meta["lists"]:
            return flat_search(self.frame(name), query, k, meta["metric"]).select("id", F.col("score").cast("float").alias("score"), "payload")
        own = json.loads(self.store.get(f"{meta['lists']}.npy"))
        centers, q = np.array(own["centers"]), np.array(query, dtype=np.float64)
        if meta["metric"] == "cosine" and np.linalg.norm(q):
            q = q / np.linalg.norm(q)
        rank = -(centers @ q) if meta["metric"] == "dot" else ((centers - q) ** 2).sum(axis=1)
        lists = [int(i) for i in np.argsort(rank, kind="stable")[: min(max(nprobe, 1), len(centers))]]
        rows = self.spark.read.parquet(f"{self.store.url}/{meta['lists']}").where(F.col("list").isin(lists))
        if own["books"]:
            books = np.array(own["books"])
            tables = {i: ((books - (q - centers[i]).reshape(books.shape[0], 1, -1)) ** 2).sum(axis=2) for i in lists}
            rows = rows.mapInArrow(_adc(self.spark.sparkContext.broadcast(tables)), "id long, embedding array<float>, payload string, rough double").orderBy("rough", "id").limit(k * meta["refine"])
        found = rows.select("id", "embedding", "payload")
        if later := meta["batches"][meta["indexed"] :]:
            found = found.unionByName(self.spark.read.parquet(*(f"{self.store.url}/{b}" for b in later)))
        return flat_search(found, query, k, meta["metric"]).select("id", F.col("score").cast("float").alias("score"), "payload")

    def register_embedder(self, name: str, fn) -> None:
        self.embedders[name] = fn

    def embed(self, name: str, text: str) -> list[float]:
        if name not in self.embedders:
            raise EngineError(f"unknown embedder '{name}'")
        return self.embedders[name](text)

    def embed_column(self, name: str, text: str):
        """A text column's vectors, made in the tasks batch by batch; a null has none."""
        if name not in self.embedders:
            raise EngineError(f"unknown embedder '{name}'")
        fn = self.embedders[name]

        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else fn(t))

        return F.pandas_udf(run, "array<double>")(F.col(text))

    def substitute(self, sql: str, session=None) -> str:
        """sql with each vector_search('space', [..] or '[..]', k[, nprobe]) replaced by a view over its hits."""
        from tesserae.plans.dialect import arguments, closing
        from tesserae.plans.predicate import tokens

        words, out, i = tokens(sql), [], 0
        while i < len(words):
            if words[i].lower() != "vector_search" or i + 1 >= len(words) or words[i + 1] != "(":
                out.append(words[i])
                i += 1
                continue
            end = closing(words, i + 1)
            args = ["".join(a).strip() for a in arguments(words[i + 2 : end])]
            if len(args) not in (3, 4) or not args[0].startswith("'"):
                raise EngineError("vector_search takes ('space', vector, k[, nprobe]), all literals")
            query = json.loads(args[1].strip("'"))
            hits = self.search(args[0].strip("'"), query, int(args[2]), int(args[3]) if len(args) > 3 else 8)
            hits.createOrReplaceTempView(name := f"_hits_{uuid.uuid4().hex[:12]}")
            out.append(name)
            i = end + 1
        return "".join(out)


def _padded(x: np.ndarray, n: int) -> np.ndarray:
    return np.vstack([x, np.full((n - len(x), x.shape[1]), 1e30)]) if len(x) < n else x


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _assign(shared, metric: str):
    def run(batches):
        centers, books = shared.value
        for batch in batches:
            x = _matrix(batch.column(1))
            rank = -(x @ centers.T) if metric == "dot" else (centers**2).sum(axis=1) - 2 * x @ centers.T
            label = rank.argmin(axis=1)
            codes = [None] * len(x)
            if books is not None:
                rest = (x - centers[label]).reshape(len(x), books.shape[0], -1)
                own = np.stack([((books[j] ** 2).sum(axis=1) - 2 * rest[:, j] @ books[j].T).argmin(axis=1) for j in range(books.shape[0])], axis=1).astype("<u2")
                codes = [r.tobytes() for r in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codes, pa.binary()), pa.array(label, pa.int32())], ["id", "embedding", "payload", "codes", "list"])

    return run


def _adc(shared):
    """Rough distances: one table look-up for each part of a code."""

    def run(batches):
        tables = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.stack([np.frombuffer(c, "<u2") for c in batch.column(3).to_pylist()])
            rough = np.empty(len(codes))
            label = batch.column(4).to_numpy(zero_copy_only=False)
            for i in np.unique(label):
                own = label == i
                rough[own] = tables[int(i)][np.arange(codes.shape[1]), codes[own]].sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rough)], ["id", "embedding", "payload", "rough"])

    return run


def trigram(text: str, dim: int = 128) -> list[float]:
    """Hashed byte trigrams of the text in lower case (A-Z), two blanks before and one behind; unit length."""
    data = b"  " + text.encode().lower() + b" "
    v = np.zeros(dim)
    for i in range(len(data) - 2):
        h = 0xCBF29CE484222325
        for b in data[i : i + 3]:
            h = (h ^ b) * 0x100000001B3 & 2**64 - 1
        v[h % dim] += 1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


