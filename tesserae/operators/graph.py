"""A property graph as two DataFrames, with traversals as joins of a frontier, ranked search, and context notes on top.

Small graphs are kept by the driver and changed at once; from_frames takes graphs of any size, for reading.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.errors import EngineError

#: Levels that reach() goes at once.
NEAR = 3
NODES = "key string, labels array<string>, props map<string,string>, created_at bigint, updated_at bigint"
EDGES = "src string, dst string, kind string, props map<string,string>, directed boolean, created_at bigint"


def reach(edges: DataFrame, starts: DataFrame, direction: str = "out", max_depth: int = 0, cut: int = 8) -> DataFrame:
    """(key, via, depth) of every node reached from starts (key) by breadth-first search, each at its least depth; the starts
    are left out.

    Up to NEAR levels are one job: walks of each length, one join each, and the least depth of each key.  More levels, and
    max_depth 0, which goes on until nothing is new, take one join and one anti-join each, level by level.
    """
    both = {"out": edges.select("src", "dst", "kind"), "in": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")}
    step = both["out"].unionByName(both["in"]) if direction == "both" else both[direction]
    seen = starts.select("key", F.lit(None).cast("string").alias("via"), F.lit(0).alias("depth")).distinct()
    if 0 < max_depth <= NEAR:
        walks, front = seen, seen
        for k in range(1, max_depth + 1):
            front = front.select("key").join(step, F.col("key") == F.col("src")).groupBy("dst").agg(F.min("kind").alias("via")).select(F.col("dst").alias("key"), "via", F.lit(k).alias("depth"))
            walks = walks.unionByName(front)
        least = walks.groupBy("key").agg(F.min(F.struct("depth", "via")).alias("x")).select("key", "x.via", "x.depth")
        return least.where("depth > 0")
    frontier, depth = seen, 0
    while not max_depth or depth < max_depth:
        depth += 1
        new = frontier.select("key").join(step, F.col("key") == F.col("src")).groupBy("dst").agg(F.min("kind").alias("via")).select(F.col("dst").alias("key"), "via", F.lit(depth).alias("depth"))
        frontier = new.join(seen.select("key"), "key", "left_anti").persist()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % cut == 0 and edges.sparkSession.sparkContext.getCheckpointDir():
            seen = seen.checkpoint()
    return seen.where("depth > 0")


def shortest(edges: DataFrame, start: str, goal: str, most: int = 0) -> list[str] | None:
    """Keys of a shortest path, edges taken either way; None if there is none, or none of at most so many hops (0: any number).
    Predecessors are kept by level, so only the path comes to the driver."""
    if start == goal:
        return [start]
    spark = edges.sparkSession
    step = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = spark.createDataFrame([(start, None)], "key string, prev string")
    frontier, levels = seen, []
    while not most or len(levels) < most:
        new = frontier.select("key").join(step, F.col("key") == F.col("src")).groupBy("dst").agg(F.min("src").alias("prev")).select(F.col("dst").alias("key"), "prev")
        frontier = new.join(seen.select("key"), "key", "left_anti").persist()
        if frontier.isEmpty():
            return None
        levels.append(frontier)
        if not frontier.where(F.col("key") == goal).isEmpty():
            break
        seen = seen.unionByName(frontier)
    else:
        return None
    path = [goal]
    for level in reversed(levels):
        path.append(level.where(F.col("key") == path[-1]).first()["prev"])
    return path[::-1]


def search_ranked(nodes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """(key, score): 4 for a key that starts with text, 3 for one that holds it, 2 for a label, 1 for a property, in any case."""
    q = F.lit(text.lower())
    has = lambda c: F.contains(F.lower(c), q)
    score = (
        F.when(F.startswith(F.lower("key"), q), 4).when(has(F.col("key")), 3).when(F.exists("labels", has), 2)
        .when(F.exists(F.map_values("props"), has), 1).otherwise(0)
    )
    return nodes.select("key", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "key").limit(limit)


class Graph:
    """Nodes by key and edges by (src, dst, kind)."""

    def __init__(self, spark: SparkSession, store=None, name: str = "graph") -> None:
        self.spark, self.store, self.name = spark, store, name
        self.nodes: dict[str, dict] = {}
        self.edges: dict[tuple[str, str, str], dict] = {}
        self._frames: tuple[DataFrame, DataFrame] | None = None
        self._given = False
        if store and (data := store.get(f"graphs/{name}.json")):
            x = json.loads(data)
            self.nodes = {n["key"]: n for n in x["nodes"]}
            self.edges = {(e["src"], e["dst"], e["kind"]): e for e in x["edges"]}

    @staticmethod
    def from_frames(nodes: DataFrame, edges: DataFrame) -> Graph:
        """A graph over DataFrames with the columns of NODES and EDGES, for reading only."""
        out = Graph(nodes.sparkSession)
        out._frames, out._given = (nodes, edges), True
        return out

    def _change(self) -> None:
        if self._given:
            raise EngineError("this graph is for reading only")
        self._frames = None

    def frames(self) -> tuple[DataFrame, DataFrame]:
        if self._frames is None:
            text = lambda p: {k: json.dumps(v) if not isinstance(v, str) else v for k, v in p.items()}
            nodes = self.spark.createDataFrame([(n["key"], n["labels"], text(n["props"]), n["created_at"], n["updated_at"]) for n in self.nodes.values()], NODES)
            edges = self.spark.createDataFrame([(e["src"], e["dst"], e["kind"], text(e["props"]), e["directed"], e["created_at"]) for e in self.edges.values()], EDGES)
            self._frames = (nodes.persist(), edges.persist())
        return self._frames

    def upsert_node(self, key: str, labels=(), props: dict | None = None) -> dict:
        """Labels are united, properties are written over the old ones."""
        self._change()
        now = int(time.time() * 1000)
        n = self.nodes.setdefault(key, {"key": key, "labels": [], "props": {}, "created_at": now, "updated_at": now})
        n["labels"] = sorted({*n["labels"], *labels})
        n["props"].update(props or {})
        n["updated_at"] = now
        return n

    def upsert_edge(self, src: str, dst: str, kind: str, props: dict | None = None, directed: bool = True) -> dict:
        """Missing ends are made; an edge that is there gets the new properties."""
        self._change()
        if src == dst:
            raise EngineError(f"an edge from '{src}' to itself is not allowed")
        for k in (src, dst):
            if k not in self.nodes:
                self.upsert_node(k)
        self.edges[src, dst, kind] = {"src": src, "dst": dst, "kind": kind, "props": props or {}, "directed": directed, "created_at": int(time.time() * 1000)}
        return self.edges[src, dst, kind]

    def delete_node(self, key: str) -> bool:
        """With all its edges."""
        self._change()
        if self.nodes.pop(key, None) is None:
            return False
        self.edges = {e: v for e, v in self.edges.items() if key not in e[:2]}
        return True

    def delete_edges(self, src: str, dst: str, kind: str | None = None) -> int:
        self._change()
        gone = [e for e in self.edges if e[:2] == (src, dst) and kind in (None, e[2])]
        for e in gone:
            del self.edges[e]
        return len(gone)

    def _known(self, *keys: str) -> None:
        nodes = self.frames()[0]
        for k in keys:
            if (k not in self.nodes) if not self._given else nodes.where(F.col("key") == k).isEmpty():
                raise EngineError(f"unknown node '{k}'")

    def neighbors(self, key: str, direction: str = "both", max_depth: int = 1) -> DataFrame:
        self._known(key)
        return reach(self.frames()[1], self.spark.createDataFrame([(key,)], "key string"), direction, max_depth).orderBy("depth", "key")

    def shortest_path(self, start: str, goal: str) -> list[str] | None:
        """Keys from start to goal; empty if they are one; None if either is unknown or there is no path."""
        try:
            self._known(start, goal)
        except EngineError:
            return None
        return [] if start == goal else shortest(self.frames()[1], start, goal)

    def search(self, text: str, limit: int = 10) -> DataFrame:
        return search_ranked(self.frames()[0], text, limit)

    def cypher(self, text: str) -> DataFrame:
        from tesserae.operators.cypher import run

        return run(self, text)

    def save(self) -> None:
        self.store.put(f"graphs/{self.name}.json", json.dumps({"nodes": [self.nodes[k] for k in sorted(self.nodes)], "edges": list(self.edges.values())}).encode())


def snippet(text: str, query: str, width: int = 160) -> str:
    """width signs around the first hit, on one line, cut ends marked."""
    at = max(0, text.lower().find(query.lower()))
    a = max(0, min(at - width // 2, len(text) - width))
    b = min(len(text), a + width)
    return ("…" if a else "") + text[a:b].replace("\n", " ") + ("…" if b < len(text) else "")


class ContextStore:
    """Notes as nodes with the label context."""

    def __init__(self, graph: Graph) -> None:
        self.graph = graph

    def put(self, key: str, kind: str = "note", title: str = "", text: str = "", tags=()) -> dict:
        return self.graph.upsert_node(key, ["context", kind], {"title": title, "text": text, "tags": list(tags), "kind": kind})

    def get(self, key: str) -> dict | None:
        n = self.graph.nodes.get(key)
        return {"key": key, **n["props"]} if n and "context" in n["labels"] else None

    def find(self, query: str, limit: int = 10) -> list[dict]:
        """Ranked notes with a snippet of their text."""
        ranked = search_ranked(self.graph.frames()[0].where(F.array_contains("labels", "context")), query, limit).collect()
        return [{"key": r["key"], "score": r["score"], "title": self.graph.nodes[r["key"]]["props"].get("title", ""), "snippet": snippet(self.graph.nodes[r["key"]]["props"].get("text", ""), query)} for r in ranked]

    def link(self, a: str, b: str, kind: str = "LINKS", props: dict | None = None) -> dict:
        return self.graph.upsert_edge(a, b, kind, props, directed=False)

    def unlink(self, a: str, b: str, kind: str | None = None) -> int:
        return self.graph.delete_edges(a, b, kind)

    def delete(self, key: str) -> bool:
        return self.graph.delete_node(key)

    def neighbors(self, key: str, depth: int = 1, direction: str = "both") -> list[dict]:
        return [r.asDict() for r in self.graph.neighbors(key, direction, depth).collect()]

    def path(self, a: str, b: str) -> list[str] | None:
        return self.graph.shortest_path(a, b)

    def stats(self) -> dict:
        notes = [n for n in self.graph.nodes.values() if "context" in n["labels"]]
        kinds: dict[str, int] = {}
        for n in notes:
            kinds[n["props"].get("kind", "")] = kinds.get(n["props"].get("kind", ""), 0) + 1
        return {"notes": len(notes), "nodes": len(self.graph.nodes), "edges": len(self.graph.edges), "kinds": kinds}
