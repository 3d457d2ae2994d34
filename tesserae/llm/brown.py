"""Scoring by a Brown class-based bigram model.

    P(w | v) = MIX * P(class w | class v) * P(w | class w) + (1 - MIX) * P(w)

All words of the training rows are counted, and exchange clustering gives every one of them a class from its contexts:

1. the TOP most frequent words by exchange proper: each word moves to the class with the largest gain of the class
   bigrams' likelihood, sweep after sweep;
2. the PLACED most frequent ones by distributed sweeps: each counts, for all of these words, the classes of their
   neighbours in the corpus, and moves words to their best class; after the first sweep half of them at a time, so
   that neighbours don't change places with each other for ever;
3. every other training word, however rare, by one such move, its contexts gathered in a shuffle by word.

RARE more classes are by endings: for words that are met in scoring only, and for training words that never stand
beside a word of the steps before.  Class transitions are counted over the whole corpus.  Each ending class keeps half a
count for one unseen word, and all distributions sum to one.

What the driver and tasks hold is bounded by these parameters, not by the corpus: the classes and counts of
words beyond KNOWN are looked up by a shuffled join, once, and stay beside the texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.chunks import Numbered, slices
from tesserae.llm.common import discard, id_crc, most_frequent, save, ship, texts, tidy

TOP, PLACED, KNOWN = 2_048, 16_384, 100_000
CLASSES, RARE = 64, 64
ALL = CLASSES + RARE
#: Weight of the class model; pseudo-counts of a class among another's followers; sweeps on the driver, and over the corpus.
MIX, PRIOR, SWEEPS, PASSES = 0.95, 40.0, 8, 3
#: Held-out words that training lacks, looked up without a shuffle; no other has more than a thousandth of such rows.
HEAVY = 1000
END = ""


def ending(word: str) -> int:
    return zlib.crc32(word.encode()[-3:]) % RARE


def _ending(word):
    """The same as a column."""
    return (F.crc32(F.substring(F.encode(word, "utf-8"), -3, 3)) % RARE).cast("int")


def split(texts_: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct words, lower-cased (A-Z) runs without 0x20 and 0x09-0x0D; the place of every text's words among them; where each text's begin and end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts_))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.not_equal(flat, "")
    words = flat.filter(real).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[offsets]


def _count(batches):
    own, n, rows = Numbered(), np.zeros(0, np.int64), 0
    for batch in batches:
        for part in slices(batch, 0):
            words, codes, _ = split(part.column(0))
            found = np.bincount(own.of(words)[0][codes], minlength=len(own))
            found[: len(n)] += n
            n, rows = found, rows + part.num_rows
            if own.nbytes > 64 << 20:
                yield from _rows(own.words, n)
                own, n = Numbered(), np.zeros(0, np.int64)
    yield from _rows(own.words, n)
    yield from _rows(pa.array([END]), np.array([rows]))


def _rows(words: pa.StringArray, n: np.ndarray):
    for i in range(0, len(n), 100_000):
        yield pa.RecordBatch.from_arrays([words[i : i + 100_000], pa.array(n[i : i + 100_000])], ["word", "n"])


def _encode(known):
    """Ids of the known words, KNOWN plus the place in the text's own list for others; the end token is 0."""

    def run(batches):
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 1):
                words, codes, ends = split(part.column(1))
                ids, n = pc.index_in(words, value_set=known.value).fill_null(-1).to_numpy().astype(np.int64)[codes], part.num_rows
                rare = np.flatnonzero(ids < 0)
                text = np.searchsorted(ends, rare, "right") - 1
                pairs, at = np.unique(text * max(1, len(words)) + codes[rare], return_inverse=True)
                lists = np.searchsorted(pairs, np.arange(n + 1) * max(1, len(words)))
                ids[rare] = KNOWN + at - lists[text]
                data, bounds = np.insert(ids, ends[1:], 0).astype("<u4"), ends + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + 1 + np.arange(n)), part.column(0), part.column(2), pa.array(np.diff(bounds)), pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((4 * bounds).astype("<i8")), pa.py_buffer(data)]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(lists, pa.int32()), words.take(pa.array(pairs % max(1, len(words))))),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "ids", "rare"],
                )
                number += n

    return run


def _ids(column) -> np.ndarray:
    """The texts' ids in a row, an end token before and after each."""
    return np.frombuffer(b"\0\0\0\0" + b"".join(column.to_pylist()), "<u4").astype(np.int64)


def _pairs(size: int, of):
    """Dense counts of keys of consecutive ids, summed in the task."""

    def run(batches):
        total = None
        for batch in batches:
            for part in slices(batch, 0):
                found = np.bincount(of(_ids(part.column(0))), minlength=size)
                total = found if total is None else np.add(total, found, out=total)
        if total is not None:
            keys = np.flatnonzero(total)
            for i in range(0, len(keys), 200_000):
                at = keys[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["key", "n"])

    return run


def _summed(coded: DataFrame, size: int, of) -> DataFrame:
    return coded.where("not held_out").select("ids").mapInArrow(_pairs(size, of), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _top_pairs(ids: np.ndarray) -> np.ndarray:
    a, b = ids[:-1], ids[1:]
    ok = (a < TOP) & (b < TOP)
    return a[ok] * TOP + b[ok]


def _keys(a: np.ndarray, b: np.ndarray, c: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys (word, class of its neighbour) of the pairs (a, b) where first holds, and with the other side's classes where second does."""
    after, before = first & (c[b] >= 0), second & (c[a] >= 0)
    return np.concatenate([a[after] * 2 * CLASSES + c[b[after]], b[before] * 2 * CLASSES + CLASSES + c[a[before]]])


def _contexts(shared):
    """(word, counts): how often each of the PLACED words stands before and after each class, in this task."""

    def run(batches):
        c, total = np.append(shared.value[:PLACED], -1), np.zeros(PLACED * 2 * CLASSES, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                ids = np.minimum(_ids(part.column(0)), PLACED)
                a, b = ids[:-1], ids[1:]
                total += np.bincount(_keys(a, b, c, a < PLACED, b < PLACED), minlength=len(total))
        yield from _vectors(total, np.uint32)

    return run


def _vectors(total: np.ndarray, kind):
    counts = total.reshape(-1, 2 * CLASSES).astype(kind)
    words = np.flatnonzero(counts.any(axis=1))
    for i in range(0, len(words), 4096):
        part = words[i : i + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([x.tobytes() for x in counts[part]], pa.binary())], ["word", "counts"])


def _sums(batches):
    """The counts of each word, of a share of the PLACED ones."""
    total = np.zeros((PLACED, 2 * CLASSES), np.int64)
    for batch in batches:
        if batch.num_rows:
            np.add.at(total, batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1))
    yield from _vectors(total.ravel(), np.int64)


def _far_contexts(shared, known):
    """(word, at, n): how often words beyond PLACED stand beside words that have a class; at is as in _keys."""

    def run(batches):
        names, c = known.value, np.append(shared.value[:PLACED], -1)
        for batch in batches:
            for part in slices(batch, 0):
                rare = part.column(1)
                sizes = pc.list_value_length(rare).to_numpy(zero_copy_only=False).astype(np.int64)
                own = rare.flatten().dictionary_encode()
                ids = _ids(part.column(0))
                each = np.fromiter(map(len, part.column(0).to_pylist()), np.int64, part.num_rows) // 4
                base = np.concatenate([[0], np.repeat(np.cumsum(sizes) - sizes, each)])
                far = ids >= KNOWN
                ids[far] = KNOWN + own.indices.to_numpy()[ids[far] - KNOWN + base[far]]  # one number for a word in all texts
                a, b = ids[:-1], ids[1:]
                keys, n = np.unique(_keys_of_far(a, b, c), return_counts=True)
                word, at = np.divmod(keys, 2 * CLASSES)
                near = int(np.searchsorted(word, KNOWN))
                strings = pa.concat_arrays([names.take(pa.array(word[:near])), own.dictionary.take(pa.array(word[near:] - KNOWN))])
                table = pa.RecordBatch.from_arrays([strings, pa.array(at.astype(np.int16)), pa.array(n, pa.int64())], ["word", "at", "n"])
                yield from (table.slice(i, 200_000) for i in range(0, table.num_rows, 200_000))

    return run


def _keys_of_far(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p, q = np.minimum(a, PLACED), np.minimum(b, PLACED)
    after, before = (p == PLACED) & (c[q] >= 0), (q == PLACED) & (c[p] >= 0)
    return np.concatenate([a[after] * 2 * CLASSES + c[q[after]], b[before] * 2 * CLASSES + CLASSES + c[p[before]]])


def _tokens(part, at: int, classes: np.ndarray):
    """Of the texts of a slice, whose columns from at on are ids, size and far: the ids of all tokens, their classes, the counts of those
    that aren't known, and where each text begins."""
    coded, sizes, far = part.columns[at : at + 3]
    ids = np.frombuffer(b"".join(coded.to_pylist()), "<u4").astype(np.int64)
    length = pc.binary_length(coded).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    sizes = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
    base, item = np.cumsum(sizes) - sizes, far.flatten()
    owner = np.repeat(np.arange(len(sizes)), pc.list_value_length(far).fill_null(0).to_numpy(zero_copy_only=False))
    place = base[owner] + item.field("k").to_numpy(zero_copy_only=False)
    own, n = np.zeros(int(sizes.sum()), np.int64), np.zeros(int(sizes.sum()), np.int64)
    own[place], n[place] = item.field("class").to_numpy(zero_copy_only=False), item.field("n").to_numpy(zero_copy_only=False)
    other = ids >= KNOWN
    where = ids[other] - KNOWN + np.repeat(base, length)[other]
    c = classes[np.where(other, 0, ids)]
    c[other] = own[where]
    return ids, c, n[where], np.cumsum(length) - length


def _transitions(shared):
    def run(batches):
        classes, total = shared.value, np.zeros(ALL * ALL, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                c = np.append(classes[:1], _tokens(part, 0, classes)[1])  # each text ends with the end token, and so begins after one
                total += np.bincount(c[:-1] * ALL + c[1:], minlength=ALL * ALL)
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(total[keys], pa.int64())], ["key", "n"])

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, k: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words 0.. by exchange clustering of their bigram counts; words come in order of their frequency."""
    n = len(pairs)
    classes = np.arange(n) % k
    member = np.eye(k)[classes]
    after, before = pairs @ member, pairs.T @ member  # per word, per class of its follower, of its predecessor
    matrix = member.T @ after
    own = np.diag(pairs)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, out, in_ = classes[w], after[w].copy(), before[w].copy()
            out[a] -= own[w]
            in_[a] -= own[w]  # without w itself, which moves along
            if not out.any() and not in_.any():
                continue
            matrix[a] -= out
            matrix[:, a] -= in_
            matrix[a, a] -= own[w]
            row, col = matrix.sum(axis=1), matrix.sum(axis=0)
            gain = (_f(matrix + out) - _f(matrix)).sum(axis=1) + (_f(matrix + in_[:, None]) - _f(matrix)).sum(axis=0)
            d = np.diag(matrix)
            gain += _f(d + out + in_ + own[w]) - _f(d + out) - _f(d + in_) + _f(d)
            so, si = out.sum() + own[w], in_.sum() + own[w]
            gain -= _f(row + so) - _f(row) + _f(col + si) - _f(col)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            matrix[b] += out
            matrix[:, b] += in_
            matrix[b, b] += own[w]
            if b != a:
                classes[w] = b
                after[:, a] -= pairs[:, w]
                after[:, b] += pairs[:, w]
                before[:, a] -= pairs[w]
                before[:, b] += pairs[w]
                moved += 1
        if moved <= n // 200:
            break
    return classes


def _best(counts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best class of each word, given how often it stands before and after each class."""
    m = transitions + 0.1
    follow = np.log(m / m.sum(axis=1, keepdims=True))  # [class, follower]
    lead = np.log(m / m.sum(axis=0, keepdims=True))  # [predecessor, class]
    return (counts @ np.concatenate([follow, lead.T], axis=1).T).argmax(axis=1)


def _place(transitions: np.ndarray, name: str):
    def run(batches):
        for batch in batches:
            found = []
            for i in range(0, batch.num_rows, 4096):
                keys, counts = (c.slice(i, 4096) for c in batch.columns[1:3])
                x = np.zeros((len(keys), 2 * CLASSES))
                rows = np.repeat(np.arange(len(keys)), pc.list_value_length(keys).to_numpy(zero_copy_only=False))
                x[rows, keys.flatten().to_numpy()] = counts.flatten().to_numpy()
                found.append(_best(x, transitions))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else [], pa.int32())], [name, "class"])

    return run


def _moves(contexts: DataFrame, word: str, kind: str, transitions: np.ndarray) -> DataFrame:
    """(word, class): each word's best class, from (word, at, n)."""
    rows = contexts.groupBy(word).agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))  # 2 * CLASSES entries at most
    return rows.mapInArrow(_place(transitions, word), f"{word} {kind}, class int")


def _dense(rows: pa.Table, size: int) -> np.ndarray:
    out = np.zeros(size)
    out[rows.column("key").to_numpy()] = rows.column("n").to_numpy()
    return out


def _sweep(coded: DataFrame, classes: np.ndarray, transitions: np.ndarray | None, movable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the PLACED words after one distributed sweep in which movable ones may move, and their transitions before it."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast(classes)
    tasks = coded.where("not held_out").select("ids").mapInArrow(tidy(_contexts(shared)), "word long, counts binary")
    rows = tasks.repartition(16, "word").mapInArrow(_sums, "word long, counts binary").toArrow()  # PLACED rows of a KB at most
    counts = np.zeros((PLACED, 2 * CLASSES), np.int64)
    if rows.num_rows:
        counts[rows.column(0).to_numpy()] = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.int64).reshape(rows.num_rows, -1)
    if transitions is None:
        member = np.eye(CLASSES)[classes[:PLACED]] * (classes[:PLACED, None] >= 0)
        transitions = member.T @ counts[:, :CLASSES]
    out = classes.copy()
    ok = movable & counts.any(axis=1)
    out[:PLACED][ok] = _best(counts, transitions)[ok]
    return out, transitions


@dataclass
class Model:
    """What scoring needs beside the texts: words has (word, n, class) of all training words."""

    words: DataFrame
    total: int
    kinds: int
    #: Classes and counts of the known words, by their ids.
    classes: np.ndarray
    number: np.ndarray
    #: P(class | class), and the counts that a class's words share among them.
    chance: np.ndarray
    inside: np.ndarray

    @property
    def unseen(self) -> float:
        """P(w) of a word without a count."""
        return 0.5 / (self.total + 0.5 * (self.kinds + RARE))

    @property
    def table(self) -> np.ndarray:
        """log10 of P(w | v) less log10(n + 0.5), n being w's count, by the classes of v and w."""
        return np.log10(MIX * self.chance / self.inside + (1 - MIX) * 2 * self.unseen)


def _score(shared):
    """A row for each text."""

    def run(batches):
        classes, table, logs, sure = shared.value
        for batch in batches:
            for part in slices(batch, 3):
                ids, c, n, starts = _tokens(part, 3, classes)
                other = ids >= KNOWN
                near = np.where(other, 0, ids)
                words, known = logs[near], sure[near].astype(np.int64)
                words[other], known[other] = np.log10(n + 0.5), n > 0
                moved = table[np.append(classes[:1], c[:-1]), c]
                sums = [np.add.reduceat(x, starts) for x in (known, words, moved)]  # no text is without its end token
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, sums)], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "classes"])

    return run


def _cluster(coded: DataFrame, known, counts: DataFrame, names: list[str]) -> tuple[DataFrame, np.ndarray]:
    """(word, n, class) of all training words, and the classes of the known ones by their ids."""
    spark, classes = coded.sparkSession, np.full(KNOWN, -1, np.int64)
    pairs = _dense(_summed(coded, TOP * TOP, _top_pairs).toArrow(), TOP * TOP).reshape(TOP, TOP)  # TOP * TOP rows at most
    classes[:TOP] = exchange(pairs)
    member = np.eye(CLASSES)[classes[:TOP]]
    half = np.arange(PLACED) % 2 == 1
    classes, _ = _sweep(coded, classes, member.T @ pairs @ member, np.arange(PLACED) >= TOP)
    for k in range(1, PASSES):
        classes, transitions = _sweep(coded, classes, None, half if k % 2 else ~half)
    shared = spark.sparkContext.broadcast(classes)
    contexts = coded.where("not held_out").select("ids", "rare").mapInArrow(tidy(_far_contexts(shared, known)), "word string, at short, n long")
    far = _moves(contexts.groupBy("word", "at").agg(F.sum("n").alias("n")), "word", "string", transitions)
    near = spark.createDataFrame([(w, int(classes[k])) for k, w in enumerate(names[:PLACED]) if classes[k] >= 0], "word string, class int")
    found = save(far.unionByName(near), "placed")
    words = save(counts.join(found, "word", "left").withColumn("class", F.coalesce("class", _ending("word") + CLASSES)), "word-classes")
    discard(found)
    ids = F.broadcast(spark.createDataFrame(list(enumerate(names)), "id long, word string"))  # KNOWN rows at most
    rows = words.join(ids, "word").select("id", "class").toArrow()
    classes[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return words, np.maximum(classes, 0)  # ids without a word aren't met


def _attach(coded: DataFrame, words: DataFrame) -> DataFrame:
    """coded with size, of the text's own list, and far, the classes and counts of its words.

    Words that never teach have the class of their ending.  Held-out words may be frequent and yet not be there to be joined: the
    HEAVY most frequent ones are told apart first, so that no task gets all rows of one.
    """
    lists = coded.select("row", F.posexplode("rare").alias("k", "word"))
    asked = save(coded.where("held_out").select(F.explode("rare").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "held-out-words")
    heavy = most_frequent(asked, HEAVY, "n", "word").select("word")
    told = save(heavy.join(words.select("word", "class", "n"), "word", "left").select("word", F.lit(True).alias("told"), F.col("class").alias("told_class"), F.col("n").alias("told_n")), "heavy")
    marked = lists.join(F.broadcast(told), "word", "left")
    # A blank is in no word: such keys meet nothing and spread the rows that need no join.
    marked = marked.withColumn("key", F.when(F.col("told"), F.concat(F.lit(" "), F.col("row").cast("string"))).otherwise(F.col("word")))
    joined = marked.join(words.select(F.col("word").alias("key"), "class", "n"), "key", "left")
    item = F.struct("k", F.coalesce("told_class", "class", _ending("word") + CLASSES).alias("class"), F.coalesce("told_n", "n", F.lit(0)).alias("n"))
    far = joined.groupBy("row").agg(F.collect_list(item).alias("far"))  # the words of one text
    return coded.select("row", "doc_id", "held_out", "n_tokens", "ids", F.size("rare").alias("size")).join(far, "row", "left").drop("row")


def fit(own: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the rows (doc_id, text, held_out) that aren't held out, and all rows, encoded for scoring."""
    spark, kind = own.sparkSession, own.schema["doc_id"].dataType.simpleString()
    counts = save(own.where("not held_out").select("text").mapInArrow(tidy(_count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts.where(F.col("word") != END), KNOWN - 1, "n", "word").select("word", "n").toArrow()
    names = [END, *top.column(0).to_pylist()]
    number = np.zeros(KNOWN, np.int64)
    number[: len(names)] = [(counts.where(F.col("word") == END).select("n").first() or [0])[0], *top.column(1).to_pylist()]
    known = spark.sparkContext.broadcast(pa.array(names, pa.string()))
    coded = save(own.mapInArrow(tidy(_encode(known)), f"row long, doc_id {kind}, held_out boolean, n_tokens long, ids binary, rare array<string>"), "coded")
    words, classes = _cluster(coded, known, counts, names)
    whole = save(_attach(coded, words), "coded-far")

    shown = spark.sparkContext.broadcast(classes)
    rows = whole.where("not held_out").select("ids", "size", "far").mapInArrow(tidy(_transitions(shown)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    moves = _dense(rows.toArrow(), ALL * ALL).reshape(ALL, ALL)
    said, types = np.zeros(ALL), np.zeros(ALL)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():  # ALL rows
        said[r["class"]], types[r["class"]] = r["n"], r["types"]
    types[CLASSES:] += 1  # an unseen word's
    share = np.where(types > 0, said + 0.5, 0)  # a class without words says nothing, and so isn't moved to
    chance = (moves + PRIOR * share / share.sum()) / (moves.sum(axis=1, keepdims=True) + PRIOR)
    discard(counts, coded)
    return Model(words, int(total), int(kinds), classes, number, chance, said + 0.5 * np.maximum(types, 1)), whole


def score(docs: DataFrame, modulus: int = 5, rest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of docs.

    Rows whose crc32(id as text) mod modulus is rest are held out, all others teach.  score is the model's log10
    probability of the text, base_score that of single words with half a count added.  A null or empty text is the end
    token alone.  Null ids teach; repeated rows teach and are scored each; other columns are not looked at; no rows
    give no rows; without training rows every word is unseen.
    """
    spark = docs.sparkSession
    ship(spark)
    own = texts(docs, id_col, text_col).withColumn("held_out", id_crc("doc_id", modulus) == rest)
    kind = own.schema["doc_id"].dataType.simpleString()
    model, whole = fit(own)
    base = float(np.log10(model.total + 0.5 * (model.kinds + 1)))
    shared = spark.sparkContext.broadcast((model.classes, model.table, np.log10(model.number + 0.5), model.number > 0))
    rows = whole.select("doc_id", "held_out", "n_tokens", "ids", "size", "far").mapInArrow(tidy(_score(shared)), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, classes double")
    return (
        rows.select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
            (F.col("logs") - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("logs") + F.col("classes")).alias("score"),
        )
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    )
