"""URL filters: rules first, then gradient-boosted trees on lexical features.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest that fits decides.  Where
none fits, boosted trees judge the URL by its length, depth, digit ratio, entropy, parameter counts and suffix
statistics.  The trees are fitted on labelled URLs, of which at most SAMPLE distinct ones, picked by hash, are used; the
suffix statistics come from all of them.  Labels are a table (url, label), or come from a weak source, weak_labels().
URLs are judged where they are read, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import save, ship, thinned

#: Labelled URLs that the trees are fitted on at most; buckets of the suffix statistics; rules that are one expression, more are looked up by host.
SAMPLE, BUCKETS, RULES = 20_000, 512, 1_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first `://`, A-Z lower-cased, and the path up to `?` or `#`; both empty if there is none."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _ranked(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """From weak to strong: the longer wins, then the greater text, then the later one given."""
    return sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules (verdict, host, path prefix) that fits; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in _ranked(rules):  # the longest ends up outermost
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def look_up(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages (row, host, path and others) with rule and verdict, like rule_for() for any number of rules: each host's rules are one
    row, which a page's host and its parent domains are joined with."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(h, k, p, kind) for k, (kind, h, p) in enumerate(_ranked(rules))], "at string, k long, prefix string, kind string")
    table = table.groupBy("at").agg(F.collect_list(F.struct("k", "prefix", "kind")).alias("rules"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = pages.select("row", "path", F.explode(suffixes).alias("at")).join(table, "at")
    best = met.select("row", F.array_max(F.transform(F.filter("rules", lambda r: F.col("path").startswith(r["prefix"])), lambda r: F.struct(r["k"].alias("k"), F.concat("at", r["prefix"]).alias("rule"), r["kind"].alias("kind")))).alias("best"))
    return pages.join(best.where("best is not null").groupBy("row").agg(F.max("best").alias("best")), "row", "left").select(*pages.columns, F.col("best.rule").alias("rule"), F.col("best.kind").alias("verdict"))


_SPLIT = re.compile(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?")
_TO_LOWER = str.maketrans(_UPPER, _LOWER)


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host, path and query, by the rules of host_and_path(); all empty without `://`."""
    rest = (url or "").partition("://")[2]
    m = _SPLIT.match(rest)
    return m[1].translate(_TO_LOWER), m[2], m[3] or ""


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str | None) -> tuple[list[float], tuple[int, int]]:
    """Features of a URL, and its buckets in the suffix statistics: its last label, its last two."""
    host, path, query = split_url(url)
    labels = [x for x in host.split(":")[0].split(".") if x]
    text, segments, params = url or "", [x for x in path.split("/") if x], [x for x in query.split("&") if x]
    own = labels[-3] if len(labels) > 2 else labels[0] if labels else ""
    digits = sum(map(str.isdigit, text))
    values = [
        len(text), len(host), len(path), len(query), len(labels), len(segments), max(map(len, segments), default=0), digits / max(1, len(text)),
        sum(map(str.isdigit, host)) / max(1, len(host)), entropy(host), entropy(path), len(params), sum(p.startswith(("utm_", "ref=", "aff")) for p in params),
        host.count("-"), path.count("-") + path.count("_"), len(own), entropy(own), sum(c in "aeiou" for c in own) / max(1, len(own)), float("%" in text), float(text.startswith("https")), float(bool(re.fullmatch(r"[\d.]+", host))),
    ]
    return [float(v) for v in values], tuple(_bucket(".".join(labels[-k:])) + k * BUCKETS // 2 - BUCKETS // 2 for k in (1, 2))


#: Which columns of Trees.matrix() belong to which group of features.
GROUPS = {"length": [0, 1, 2, 3, 6, 15], "depth": [4, 5], "digits": [7, 8, 20], "entropy": [9, 10, 16, 17], "parameters": [11, 12, 18, 19], "hyphens": [13, 14], "suffixes": [21, 22]}


def _bucket(suffix: str) -> int:
    h = 0xCBF29CE484222325
    for b in suffix.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return (h >> 7) % (BUCKETS // 2)


class Trees:
    """Logistic boosting of shallow trees over binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees, self.suffixes = 0.0, [], np.full(BUCKETS, 0.5)

    def matrix(self, urls: list[str | None]) -> np.ndarray:
        rows = [lexical(u) for u in urls]
        if not rows:
            return np.empty((0, 23))
        return np.hstack([np.array([r[0] for r in rows]), self.suffixes[np.array([r[1] for r in rows])]])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            chance = 1 / (1 + np.exp(-score))
            tree: list[tuple] = []
            self._grow(tree, binned, cuts, y - chance, chance * (1 - chance), np.arange(len(y)), 0, score)
            self.trees.append(tree)
        return self

    def _grow(self, tree: list, binned, cuts, g, h, rows, depth: int, score) -> int:
        at, best = len(tree), (1e-6, None, None)
        tree.append(None)
        sg, sh = g[rows].sum(), h[rows].sum()
        if depth < self.depth and len(rows) > 1:
            for f in range(binned.shape[1]):
                gs = np.bincount(binned[rows, f], g[rows], self.bins + 1).cumsum()[: len(cuts[f])]
                hs = np.bincount(binned[rows, f], h[rows], self.bins + 1).cumsum()[: len(cuts[f])]
                gain = gs**2 / (hs + 1) + (sg - gs) ** 2 / (sh - hs + 1) - sg**2 / (sh + 1)
                gain[np.minimum(hs, sh - hs) < self.least / 8] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            value = self.rate * sg / (sh + 1)
            score[rows] += value
            tree[at] = (-1, 0.0, 0, 0, float(value))
        else:
            _, f, k = best
            left = binned[rows, f] <= k
            a = self._grow(tree, binned, cuts, g, h, rows[left], depth + 1, score)
            b = self._grow(tree, binned, cuts, g, h, rows[~left], depth + 1, score)
            tree[at] = (f, float(cuts[f][k]), a, b, 0.0)
        return at

    def chance(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            f, cut, a, b, value = (np.array(c) for c in zip(*tree))
            for _ in range(self.depth):
                own = f[node]
                go = x[np.arange(len(x)), np.maximum(own, 0)] <= cut[node]
                node = np.where(own < 0, node, np.where(go, a[node], b[node]))
            score += value[node]
        return 1 / (1 + np.exp(-score))


def weak_labels(pages: DataFrame, terms: list[str], url_col: str = "url") -> DataFrame:
    """(url, label) of every row of pages with a host: 1 if a word of the host, between dots and hyphens, is one of terms, else 0.

    A weak source: it knows junk hosts by name only.  The trees don't see the words, but what URLs of such hosts look like.
    """
    host, _ = host_and_path(F.col(url_col))
    known = pages.select(F.col(url_col).cast("string").alias("url"), F.split(host, r"[.\-:]").alias("words")).where("url is not null and words[0] <> ''")
    return known.select("url", F.arrays_overlap("words", F.array(*map(F.lit, terms))).cast("int").alias("label"))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> Trees:
    """Trees from (url, label 0 or 1); rows with a null in either are left out; repeated rows count in the suffix statistics only.

    Without both labels nothing is blocked.  Rows of one URL with either label are both used.
    """
    ship(labelled.sparkSession)
    known = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("label")).dropna()

    def suffixes(batches):
        n, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for url, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b in lexical(url)[1]:
                    n[b] += 1
                    bad[b] += label
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(n), pa.array(bad)], ["bucket", "n", "bad"])

    trees = Trees()
    sums = known.mapInArrow(suffixes, "bucket long, n long, bad long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect()  # BUCKETS rows
    for r in sums:
        trees.suffixes[r["bucket"]] = (r["bad"] + 2) / (r["n"] + 4)
    place = F.xxhash64("url")
    rows = thinned(known, place, SAMPLE, sum(r["n"] for r in sums) // 2).distinct().orderBy(place, "url", "label").limit(SAMPLE).collect()
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(set(y)) < 2:
        trees.base = -50.0
        return trees
    return trees.fit(trees.matrix([r["url"] for r in rows]), y)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], trees: Trees, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, chance) of every row of pages; chance is the trees' that the URL is to be blocked.

    A null URL, or one without `://`, has an empty host and path; no rule fits it, and the trees judge what there is of it.
    Of rules of equal length the one with the greater text wins, of equal rules the last.
    Repeated rows and null ids keep their rows; other columns are not looked at; no rows give no rows.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            found = shared.value.chance(shared.value.matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "chance"])

    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    kind = own.schema["page_id"].dataType.simpleString()
    scored = own.mapInArrow(run, f"page_id {kind}, url string, chance double")
    host, path = host_and_path(F.col("url"))
    parts = scored.select("page_id", host.alias("host"), path.alias("path"), "chance")
    if len(rules) <= RULES:
        rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
        parts = parts.withColumns({"rule": rule, "verdict": verdict})
    else:
        parts = look_up(save(parts.withColumn("row", F.monotonically_increasing_id()), "urls"), rules)
    return parts.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("chance") >= threshold, "block").otherwise("allow")).alias("verdict"), "chance")
