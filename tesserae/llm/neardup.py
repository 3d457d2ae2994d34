"""Near-duplicates by word shingles: documents are linked at a Jaccard similarity of SIMILAR = 0.8 or more.

Documents are sets of WORDS-word shingles; equal sets collapse to a class first.  SimHash decides which pairs are looked at
further: a class has a fingerprint of PRINT words, the first of which is that of simhash.py.  At a similarity of 0.8 a bit
differs with a chance of 0.15, and of 0.162 at most whatever the sizes, from TINY shingles on; so similar classes
differ in over APART of the 768 bits with a chance of 4 in ten million at most, and unrelated ones in half of them.  Pairs within
APART are verified on the shingles themselves, so no link is false.  These are made in further
passes over the texts, for candidates only: no shingles are stored or shuffled for documents without any.

Pairs to compare come from the pigeonring search of simhash.py first, over the first words.  Alone it can't
find them all: at a similarity of 0.8 these differ in some ten of 64 bits, a distance at which the ring's segments leave nearly all
pairs.  So classes in different components of those found so far are compared, too, if they agree in all ROWS minima of one of BANDS
bands of min-hashes: at a similarity of 0.8 a pair is missed with a chance of (1 - 0.8^4)^24, 3 in a million.

Bands with up to BUCKET classes are paired off.  In a larger one (a large group of near copies, or a passage that
many share) all classes are first compared with CENTRES of them.  What those links leave in several components is compared
block by block, each with each, across components only, where fingerprints are near: on the shingles, which go with the classes
into the blocks, so that there is no row for a pair unless it links two components of its block.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import simhash
from tesserae.llm.chunks import slices
from tesserae.llm.common import discard, lookup, save, ship, tidy
from tesserae.llm.components import components
from tesserae.llm.simhash import by_component, keep_one, keyed_texts, least_key

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4
BUCKET, CENTRES, BLOCK = 32, 2, 512
#: Hashes of a block of classes that are compared across components, if BLOCK of them have more.
HASHES = 1 << 20
#: Size of the bitmap of candidates, by which all others are left out.
BITS = 26
#: 64-bit words of a fingerprint, and bits in which those of similar sets may differ: five deviations over the most to expect
#: at SIMILAR.  Sets of fewer than TINY shingles, of which fingerprints tell less, are all verified.
PRINT, APART, TINY = 12, 176, 5
_RANDOM = np.random.default_rng(8).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.random.default_rng(9).integers(0, 1 << 63, PRINT - 1, dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    grams = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) > WORDS else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(42)), dtype="<u8"))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, (1 << 32) - 1, "<u4")
    for i in range(0, len(hashes), 2048):
        np.minimum(out, ((hashes[i : i + 2048] * _RANDOM[0] + _RANDOM[1]) >> np.uint64(32)).min(axis=1).astype("<u4"), out=out)
    return out


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """PRINT words of SimHash: the majorities of the hashes' own bits, as in simhash.py, then those of PRINT - 1 more hashes made of each."""
    counts = np.zeros(64 * PRINT, np.int64)
    for i in range(0, len(hashes), 255):  # a byte holds as many
        own = hashes[i : i + 255, None]
        more = (own ^ _SALTS) * np.uint64(0x9E3779B97F4A7C15)
        more = (more ^ more >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        words = np.concatenate([own, more ^ more >> np.uint64(32)], axis=1)
        counts += np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def within(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which rows of the fingerprints a and b, of sets of these sizes, may be those of similar sets."""
    fits = 5 * np.minimum(sizes, others) >= 4 * np.maximum(sizes, others)
    return fits & ((np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= APART) | (np.minimum(sizes, others) < TINY))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)  # SIMILAR, in whole numbers


def _sketches(batches):
    from xxhash import xxh64_intdigest

    for batch in batches:
        for part in slices(batch, 1):
            columns: tuple[list, ...] = ([], [], [], [], [])
            for text in part.column(1).to_pylist():
                hashes = shingles(text)
                raw, words = minima(hashes).tobytes(), fingerprint(hashes)
                columns[0].append(xxh64_intdigest(hashes.tobytes(), 7) - (1 << 63))
                columns[1].append(len(hashes))
                columns[2].append([xxh64_intdigest(raw[4 * ROWS * k : 4 * ROWS * (k + 1)], k) - (1 << 63) for k in range(BANDS)] if len(hashes) else [])
                columns[3].append(words.tobytes())
                columns[4].append(int(words.view("<i8")[0]))
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "text_hash", "fp", "size", "keys", "sig", "print"])


def _looks(batches):
    """The pairs whose sizes and fingerprints may belong to similar sets."""
    for batch in batches:
        if batch.num_rows:
            p, q = (batch.column(k).to_numpy() for k in (2, 3))
            s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u8").reshape(batch.num_rows, -1) for k in (4, 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(within(s, t, p, q)))


def _shingles_of(shared):
    """(text_hash, hashes) of the texts whose hash is in the bitmap: all that are wanted, and a few others."""

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy() & ((1 << BITS) - 1)
            wanted = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            for part in slices(wanted, 1):
                found = [shingles(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["text_hash", "hashes"])

    return run


def _verify(batches):
    for batch in batches:
        ok = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _bits(wanted: DataFrame) -> np.ndarray:
    """A bitmap of the last BITS bits of text_hash, of 2^(BITS - 3) bytes whatever the number of rows."""
    at = F.col("text_hash").bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in wanted.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of xs shares with each of ys."""
    out = np.zeros((len(xs), len(ys)), np.float32)  # whole numbers up to 2^24
    values = np.intersect1d(np.concatenate(xs), np.concatenate(ys))

    def marks(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(some, flat), len(some) - 1)
        hit, found = some[at] == flat, np.zeros((len(sets), len(some)), np.float32)
        found[row[hit], at[hit]] = 1
        return found

    for k in range(0, len(values), 4096):
        some = values[k : k + 4096]
        out += marks(xs, some) @ marks(ys, some).T
    return out


def _across(table: pa.Table) -> pa.Table:
    """Similar classes of two blocks of a band, or of one with itself, that are in different components: as many pairs as join all
    that are, and no more."""
    left = np.array(table.column("left").to_pylist(), bool)
    fp, root = table.column("fp").to_numpy(), table.column("root").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u8").reshape(len(fp), -1)
    sets = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    own, other = np.flatnonzero(left), np.flatnonzero(~left)
    other = other if len(other) else own
    may = np.stack([(root[other] != root[i]) & within(sig[other], sig[i], sizes[other], sizes[i]) for i in own]) if len(own) else np.zeros((0, len(other)), bool)
    own, other, may = own[may.any(axis=1)], other[may.any(axis=0)], may[may.any(axis=1)][:, may.any(axis=0)]
    found, up = [], {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    if len(own):
        both = _common([sets[i] for i in own], [sets[i] for i in other])
        for i, j in zip(*np.nonzero(may & (5 * both >= 4 * (sizes[own][:, None] + sizes[other] - both)))):  # as in similar()
            p, q = top(int(root[own[i]])), top(int(root[other[j]]))
            if p != q:
                up[p] = q
                found.append(sorted((int(fp[own[i]]), int(fp[other[j]]))))
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _ring(kinds: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that SimHash tells: all of one fingerprint with the least of them, and the least of two that are near."""
    prints = save(kinds.groupBy("print").agg(F.count("*").alias("n"), F.min("fp").alias("a")), "ring-prints")
    equal = lookup(kinds.select("print", F.col("fp").alias("b")), prints, "print", "n").select("a", "b").where("a <> b")
    near = simhash.links(prints.select(F.col("print").alias("fp")))  # no fingerprint is in more than 65 * 64 of these
    least = lambda x: prints.select(F.col("print").alias(x), F.col("a").alias(f"least_{x}"))
    return equal.unionByName(near.join(least("a"), "a").join(least("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))


def links(kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified edges (a, b) between classes; kinds has fp, text_hash, size, keys, sig and print, docs has text_hash and text."""
    spark = kinds.sparkSession

    def rooted(edges: DataFrame) -> DataFrame:
        return save(components(edges).select(F.col("node").alias("fp"), "root"), "link-roots")

    def hashed(classes: DataFrame) -> DataFrame:
        """(fp, hashes) of classes (fp)."""
        wanted = save(classes.join(kinds.select("fp", "text_hash"), "fp"), "candidates")
        marks = spark.sparkContext.broadcast(_bits(wanted))
        made = docs.select("text_hash", "text").mapInArrow(tidy(_shingles_of(marks)), "text_hash long, hashes binary")
        out = save(made.join(wanted, "text_hash").select("fp", "hashes").dropDuplicates(["fp"]), "candidate-sets")
        marks.destroy()
        discard(wanted)
        return out

    def verified(pairs: DataFrame, name: str, roots: DataFrame | None = None) -> DataFrame:
        """Those of pairs that are similar, without any that are in one component if roots are given."""
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        placed = kinds.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")) if roots else kinds.withColumn("root", F.col("fp"))
        of = lambda x, y: placed.select(F.col("fp").alias(x), F.col("size").alias(f"size_{x}"), F.col("sig").alias(f"sig_{y}"), F.col("root").alias(f"root_{x}"))
        near = pairs.join(of("a", "a"), "a").join(of("b", "b"), "b").where("root_a <> root_b").select("a", "b", "size_a", "size_b", "sig_a", "sig_b")
        near = save(near.mapInArrow(_looks, "a long, b long"), "pairs")
        sets = hashed(near.select(F.col("a").alias("fp")).union(near.select("b")).distinct())
        first = near.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), "a")
        both = first.join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y")), "b")
        out = save(both.select("a", "b", "x", "y").mapInArrow(tidy(_verify), "a long, b long"), name)
        discard(near, sets)
        return out

    close = verified(_ring(kinds), "links-ring")
    roots = rooted(close)
    keyed = kinds.select("fp", F.explode("keys").alias("key"))
    centres = F.array(*(F.min(F.struct(F.xxhash64(F.col("fp"), F.lit(k)).alias("h"), "fp"))["fp"] for k in range(CENTRES)))
    sizes = save(keyed.groupBy("key").agg(F.count("*").alias("n"), centres.alias("centres")).where("n > 1"), "band-sizes")
    pair = F.expr("flatten(transform(fps, (a, i) -> transform(slice(fps, i + 2, size(fps)), b -> struct(a as a, b as b))))")
    paired = keyed.join(sizes.where(f"n <= {BUCKET}").select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps")).select(F.explode(pair).alias("p")).select("p.a", "p.b")
    large = sizes.where(f"n > {BUCKET}")
    crowded = save(lookup(keyed, large, "key", "n").where("centres is not null"), "crowded-bands")
    edges = close.unionByName(verified(paired.unionByName(crowded.select(F.col("fp").alias("a"), F.explode("centres").alias("b"))), "links", roots))
    discard(roots)

    # Several components: blocks of some BLOCK classes by hash, each with each; pairs are never rows, but for those that link.
    roots = rooted(edges)
    placed = crowded.select("key", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(kinds.select("fp", "size"), "fp")
    placed = save(placed, "crowded-roots")
    open_ = placed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("m"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    open_ = save(open_.select("key", "n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m") / HASHES)).cast("int").alias("blocks")), "open-bands")
    if not open_.isEmpty():
        rest = save(lookup(placed, open_, "key", "n").where("blocks is not null").select("key", "fp", "root", "blocks"), "open-classes")
        sets = hashed(rest.select("fp").distinct())
        own = F.pmod(F.xxhash64("fp", F.lit(-1)), F.col("blocks")).cast("int")
        dealt = rest.join(kinds.select("fp", "sig"), "fp").join(sets, "fp").withColumn("own", own)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", "fp", "root", "sig", "hashes", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"))
        edges = edges.unionByName(save(dealt.groupBy("key", "i", "j").applyInArrow(_across, "a long, b long").distinct(), "links-across"))
        discard(rest, sets)
    discard(roots, placed, open_)
    discard(sizes, crowded)
    return edges


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    own = keyed_texts(docs, id_col, text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    prints = save(own.mapInArrow(tidy(_sketches), f"doc_id {kind}, text_hash long, fp long, size long, keys array<long>, sig binary, print long"), "sketches")
    first = (F.first(c).alias(c) for c in ("size", "keys", "sig", "print"))
    kinds = save(prints.groupBy("fp").agg(F.count("*").alias("n"), least_key(), F.min("text_hash").alias("text_hash"), *first), "sketch-kinds")
    return by_component(prints.select("doc_id", "text_hash", "fp"), kinds, components(links(kinds, own)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row of docs.

    component_id is the least id that links reach, the row's own included.  Texts without words, nulls among them, are equal
    to each other and to no others.  Repeated rows each keep their row; null ids count in links but are never the least, and a
    component of null ids alone has a null component_id; other columns are not looked at; no rows give no rows.
    """
    return _components(docs, id_col, text_col).select("doc_id", F.col("kept.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each component, under the same rules as simhash.deduplicate."""
    return keep_one(docs, _components(docs, id_col, text_col), id_col, text_col)
