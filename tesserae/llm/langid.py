"""Language identification by hierarchical discrimination.

Whole texts become hashed counts of byte trigrams.  A linear support vector machine for each family (one versus
the rest) decides the family; within it, one-versus-one machines tell closely related languages apart.  The
machines are fitted on a bounded sample: at most PER_LANGUAGE texts of each language and SAMPLE in all, picked by
their hashes; every text is scored whole, where it is read, without a shuffle.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import id_crc, ship, tidy

#: Rows of a language, and of all, that the machines are fitted on at most.
PER_LANGUAGE, SAMPLE = 700, 8_000
DIMENSIONS = 8192
FAMILIES = {
    "romance": "fr es it pt ro ca gl oc",
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu", "baltic": "lt lv", "turkic": "tr az kk uz tk ky tt", "celtic": "ga gd cy br", "indic": "hi bn ur pa mr gu ne si",
    "semitic": "ar he mt am", "sinitic": "zh yue", "dravidian": "ta te kn ml", "iranian": "fa ku ps tg", "austronesian": "id ms tl jv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    """A language of no known family is one of its own."""
    code = lang.lower().replace("_", "-").split("-")[0]
    return _FAMILY.get(code, f"={code}")


def counts(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, how often each occurs."""
    b = np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8).astype(np.uint32)
    h = ((b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(2654435761)) >> np.uint32(19)
    return np.bincount(h, minlength=DIMENSIONS)


def features(batch: list[str]) -> np.ndarray:
    x = np.empty((len(batch), DIMENSIONS), dtype=np.float32)
    for k, text in enumerate(batch):
        x[k] = counts(text)
    np.sqrt(x, out=x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


def machine(x: np.ndarray, y: np.ndarray, weight: float = 3e-4, rounds: int = 120) -> np.ndarray:
    """Weights (a bias last) of a linear machine: squared hinge and a small norm, classes balanced, by accelerated descent."""
    own = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(own.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (own @ v))
        g = own.T @ (-2 * share * slack * y) + weight * v
        new = v - 0.25 * g
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


class Model:
    """Languages, families and the machines between them."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        self.families = sorted({family(g) for g in self.langs})
        y = np.array(langs, dtype=object)
        own = np.array([family(g) for g in langs], dtype=object)
        sign = lambda a: np.where(a, 1, -1).astype(np.float32)
        self.members = {f: [g for g in self.langs if family(g) == f] for f in self.families}
        self.pairs, columns = [], []
        for f in self.families if len(self.families) > 1 else []:
            columns.append(machine(x, sign(own == f)))
        for f in self.families:
            for a, b in itertools.combinations(self.members[f], 2):
                rows = (y == a) | (y == b)
                self.pairs.append((a, b))
                columns.append(machine(x[rows], sign(y[rows] == a)))
        self.weights = np.stack(columns, axis=1) if columns else np.zeros((DIMENSIONS + 1, 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """A language and a score for each row: the family's chance times the language's mean chance against its relatives.

        Neither shrinks as languages or families are added, so one bound on the score serves any number of them.
        """
        margins = x @ self.weights[:-1] + self.weights[-1]
        n = len(self.families) if len(self.families) > 1 else 0
        chance = lambda m: 1 / (1 + np.exp(np.clip(-4 * m, -50, 50)))
        by_family = chance(margins[:, :n]) if n else np.ones((len(x), 1))
        score = np.zeros((len(x), len(self.langs)))
        at = {g: k for k, g in enumerate(self.langs)}
        for k, (a, b) in enumerate(self.pairs):
            p = chance(margins[:, n + k])
            score[:, at[a]] += p
            score[:, at[b]] += 1 - p
        chosen = by_family.argmax(axis=1)
        for k, f in enumerate(self.families):
            own = [at[g] for g in self.members[f]]
            if len(own) == 1:
                score[:, own[0]] = 1
            score[:, own] *= by_family[:, [k]] / max(1, len(own) - 1)
            others = np.flatnonzero(chosen != k)
            score[np.ix_(others, own)] -= 2  # the family is decided first
        best = score.argmax(axis=1)
        return [self.langs[k] for k in best], np.clip(score[np.arange(len(x)), best], 0, 1)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from rows of docs with a text and a language; None if there are none.

    The sample is picked by the hashes of the texts, so that copies count once and ids don't matter, null ones included: the
    PER_LANGUAGE least hashes of each language, of all languages' in turn at most SAMPLE.
    """
    ship(docs.sparkSession)
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null").withColumn("hash", F.xxhash64("text"))
    # A share of each language by hash comes first, so that the ranking gets some four times the rows it keeps, however many a language has.
    place = F.pmod(F.col("hash"), F.lit(1 << 20))
    sizes = docs.select(F.col(lang_col).alias("lang")).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE)
    thin = known.select("hash", "lang").join(F.broadcast(sizes), "lang").where(place * F.col("n") <= F.lit(4 * PER_LANGUAGE << 20)).select("hash", "lang").distinct()
    own = Window.partitionBy("lang").orderBy("hash")
    ids = thin.withColumn("k", F.row_number().over(own)).where(F.col("k") <= PER_LANGUAGE).orderBy("k", "lang").limit(SAMPLE).select("hash", "lang")
    picked = known.join(F.broadcast(ids), ["hash", "lang"]).dropDuplicates(["hash", "lang"])

    def run(batches):
        for batch in batches:
            found = [counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([np.flatnonzero(c).astype(np.int32) for c in found], pa.list_(pa.int32())), pa.array([c[c > 0].astype(np.int32) for c in found], pa.list_(pa.int32()))],
                ["hash", "lang", "at", "n"],
            )

    rows = picked.select("hash", "text", "lang").mapInArrow(tidy(run), "hash long, lang string, at array<int>, n array<int>").toArrow()
    if not rows.num_rows:
        return None
    order = sorted(range(rows.num_rows), key=lambda k: (rows.column(1)[k].as_py(), rows.column(0)[k].as_py()))
    x = np.zeros((len(order), DIMENSIONS), np.float32)
    langs = []
    for k, r in enumerate(order):
        x[k, rows.column(2)[r].values.to_numpy()] = np.sqrt(rows.column(3)[r].values.to_numpy())
        langs.append(rows.column(1)[r].as_py())
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return Model(x, langs)


def _predict(model, names: list[str]):
    def run(batches):
        own = model.value
        for batch in batches:
            texts_, langs, scores = batch.column(1).to_pylist(), [], []
            for i in range(0, len(texts_), 512):
                part = texts_[i : i + 512]
                found, score = own.predict(features(part)) if own else (["und"] * len(part), np.zeros(len(part)))
                letters = [any(map(str.isalpha, t)) for t in part]
                langs += [g if ok else "und" for g, ok in zip(found, letters)]
                scores += [float(s) if ok else 0.0 for s, ok in zip(score, letters)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", *names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, the columns of keep, lang_pred, score) of every row of docs, from its text alone.

    Of languages with equal scores the first in alphabetical order is predicted.  A null or empty text, or one without a letter, is `und` with score 0, as is every text when no language was
    learned.  Repeated rows and null ids keep their rows; other columns are not looked at; no rows give no rows.
    """
    ship(docs.sparkSession)
    names = keep or []
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *names)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "text"]
    return own.mapInArrow(tidy(_predict(docs.sparkSession.sparkContext.broadcast(model), names)), ", ".join([*kinds, "lang_pred string", "score double"]))


def held_out(docs: DataFrame, modulus: int = 3, rest: int = 1, id_col: str = "doc_id"):
    return id_crc(F.col(id_col), modulus) == rest


def keep_known(docs: DataFrame, model: Model | None, min_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """docs whose language is known with at least min_score; the columns stay as they are.

    A text that is null or empty or has no letter goes; null ids and repeated rows are treated each by its text; no rows give no rows.
    """
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                values = [t or "" for t in part.column(at).to_pylist()]
                score = own.predict(features(values))[1] if own else np.zeros(len(values))
                ok = [s >= min_score and any(map(str.isalpha, t)) for s, t in zip(score, values)]
                yield part.filter(pa.array(ok, pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)
