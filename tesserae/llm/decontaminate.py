"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton holds every run of words of every item.  A text is streamed through it word by word, and
the length of the longest run that ends at each word tells where windows of items occur: no n-gram of the corpus
is ever stored or shuffled.  Items are dealt into blocks of BLOCK_WORDS words at most, each with an automaton of
bounded size that is broadcast.  Up to that many words, texts are marked where they are read.  More blocks take a pass
each, of which only the hits are kept, by the text's digest, and meet the texts in one join in the end.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import save, ship, texts, tidy

BLOCK_WORDS = 200_000

_SPACE = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, a-z and non-ASCII characters; separators are single bytes, so UTF-8 stays whole."""
    return text.encode().translate(_SPACE).split()


class SuffixAutomaton:
    """Of several word sequences, told apart only by the items noted at states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        ids = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for item, ws in items]
        for _, ws in ids:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        whole: dict[int, list[tuple[int, int]]] = {}  # state -> (words, item) of short items that end there
        self.items: dict[int, set[int]] = {}  # state of a window -> items that hold it
        self.names = [item for item, _ in ids]
        for k, (_, ws) in enumerate(ids):
            state = 0
            for i, w in enumerate(ws):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.items.setdefault(self._suffix(state), set()).add(k)
            if 0 < len(ws) < window:
                whole.setdefault(state, []).append((len(ws), k))
        #: Per state, the short items among its suffixes, and the least match that is a hit there.
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        self.need = [window] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[s] = (*self.short[self.link[s]], *whole.get(s, ()))
            self.need[s] = min([window, *(m for m, _ in self.short[s])])

    def _suffix(self, state: int) -> int:
        """The state of the last `window` words of a longer match that ends in state."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of p's words and w, which q stands for so far together with longer runs."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint runs (from, to) of hit words, ascending, and the items with occurring windows."""
        follow, link, length, need, window = self.next, self.link, self.length, self.need, self.window
        state = n = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = n = 0
                continue
            to = follow[state].get(w)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = follow[state].get(w)
                n = length[state]
                if to is None:
                    n = 0
                    continue
            state = to
            n += 1
            if n >= need[state]:
                size = n if n >= window else max(m for m, _ in self.short[state] if m <= n)
                if n >= window:
                    found |= self.items[self._suffix(state)]
                found.update(k for m, k in self.short[state] if m <= n)
                a = i + 1 - size
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, found


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int):
    """Items with words, streamed from the executors and dealt into blocks of bounded size, one after another; at least one."""
    out: list = []
    size = 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        if words := words_of(row["t"]):
            if out and size + len(words) > BLOCK_WORDS:
                yield out
                out, size = [], 0
            out.append((row["i"] or "", words))
            size += len(words)
    yield out


_SPAN = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _hits(automaton):
    """(text digest, spans, items) of the texts that are hit."""

    def run(batches):
        own = automaton.value
        for batch in batches:
            keys, spans, items = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs, found = own.match(words_of(text))
                if runs:
                    keys.append(key)
                    spans.append([{"from": a, "to": b} for a, b in runs])
                    items.append([own.names[k] for k in sorted(found)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(spans, _ARROW_SPAN), pa.array(items, pa.list_(pa.string()))], ["key", "spans", "items"])

    return run


def _mark(automaton, at: int):
    """Fills the last three columns (words, spans, items); at: the text's column.  Without an automaton, spans are there and put together."""

    def run(batches):
        own = automaton.value if automaton else None
        for batch in batches:
            counts, spans, items = [], [], []
            for text, old, ids in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                words = words_of(text or "")
                runs, found = own.match(words) if own else (_joined([(s["from"], s["to"]) for s in old or []]), ids or [])
                counts.append(len(words))
                spans.append([{"from": a, "to": b} for a, b in runs])
                items.append([own.names[k] for k in sorted(found)] if own else found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(counts, pa.int64()), pa.array(spans, _ARROW_SPAN), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

    return run


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def marks(docs: DataFrame) -> list[str]:
    """Names of the three columns that mark() adds; none is one of docs."""
    return [next(n for n in (f"_{x}{k or ''}" for k in range(1 << 20)) if n not in docs.columns) for x in ("n_words", "spans", "items")]


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs and three more columns, named by marks(): words, runs of hit words, and ids of items with occurring windows."""
    spark = docs.sparkSession
    ship(spark)
    names = marks(docs)
    empty = (F.lit(0).cast("long"), F.lit(None).cast(_SPAN), F.array().cast("array<string>"))
    out = docs.withColumns(dict(zip(names, empty)))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    at = docs.columns.index(text_col)
    automata = (spark.sparkContext.broadcast(SuffixAutomaton(items, window)) for items in blocks(benchmark, item_col, item_text_col, window))
    first, second = next(automata), next(automata, None)
    if second is None:
        return out.mapInArrow(tidy(_mark(first, at)), schema)
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    keyed = docs.where(F.col(text_col).isNotNull()).select(digest.alias("key"), F.col(text_col).cast("string").alias("text"))
    found = None
    for automaton in itertools.chain((first, second), automata):  # one automaton in a worker at a time
        hits = save(keyed.mapInArrow(_hits(automaton), "key binary, spans array<struct<from: long, to: long>>, items array<string>").dropDuplicates(["key"]), "hits")
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias(names[1]), F.flatten(F.collect_list("items")).alias(names[2]))  # of one text
    key = next(n for n in (f"_key{k or ''}" for k in range(1 << 20)) if n not in docs.columns)
    met = docs.withColumn(key, digest).join(found.withColumnRenamed("key", key), key, "left")
    return met.select(*(F.col(f"`{c}`") for c in docs.columns), F.lit(0).cast("long").alias(names[0]), names[1], names[2]).mapInArrow(_mark(None, at), schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs.

    A null or empty text has no words and no hits; items without words don't count, nor does an empty benchmark hit
    anything; items that repeat count each; other columns are not looked at; no rows give no rows.
    """
    marked = mark(texts(docs, id_col, text_col), benchmark, window)
    hit = F.coalesce(F.aggregate("_spans", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"]), F.lit(0))
    # DuckDB and Spark sort strings by their UTF-8 bytes alike.
    ids = F.concat_ws(",", F.array_sort("_items"))
    return marked.select("doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the runs of words and what stands between the words of a run."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data.translate(_LOWER))]
    out, at = [], 0
    for a, b in runs:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_span: int = 10, max_coverage: float = 0.0, text_col: str = "text") -> DataFrame:
    """docs cleaned of the benchmark: spans of max_span or more hit words are cut out of the text, and documents whose
    hits cover more than max_coverage of their words go altogether.

    Texts without hits stay as they are, null and empty ones among them; null ids and repeated rows are treated each by
    its text; other columns stay, whatever their names; items without words hit nothing; no rows give no rows.
    """
    marked = mark(docs, benchmark, window, text_col)
    words, spans, _ = marks(docs)
    hit = F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"]), F.lit(0))
    kept = marked.where(hit <= F.lit(float(max_coverage)) * F.col(words))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            new = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()):
                runs = [(s["from"], s["to"]) for s in spans or [] if s["to"] - s["from"] >= max_span]
                new.append(cut(text, runs) if runs else text)
            columns = [*batch.columns[:-3]]
            columns[at] = pa.array(new, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-3])

    if max_coverage <= 0:  # every text that is left is without hits
        return kept.select(docs.columns)
    return kept.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
