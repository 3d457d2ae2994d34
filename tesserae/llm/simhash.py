"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are 64 bits of 3-word shingles; equal ones collapse to a class first, so copies cost nothing.
Two classes link at DISTANCE = 2 differing bits or fewer.  The bits form a ring of three segments.  By the
pigeonring principle, differences that sum to 2 over the ring leave a segment from which every chain of
consecutive segments stays within its proportional budget: l segments differ in at most floor(l * 2 / 3) bits,
so 0, then 1, then 2.  A candidate pair therefore agrees in a whole segment and in one half of the next one: 3 * 2 index
keys of 32 bits a class.  Within a key, pairs must pass the chain's budgets before the full Hamming check.

A key with over BUCKET classes (a large group of near copies) isn't paired off.  Its classes are linked exactly in
another way: each is sent to its 65 neighbours at distance 0 or 1.  Any two classes at distance 2 or less share such a
neighbour, all that meet at one are within distance 2, and there are at most 65, however large the group; a star links them.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import discard, lookup, save, ship, texts, tidy
from tesserae.llm.components import components

DISTANCE, BUCKET = 2, 64
#: (first bit, bits) of the ring's segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def majority(hashes: np.ndarray) -> int:
    """Signed 64 bits; bit set if it is in more than half of the hashes.  No hashes: zero."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str) -> int:
    """The majority of the shingles' hashes.  No words: zero."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # of bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    return majority(np.fromiter(map(xxh64_intdigest, grams, repeat(42)), dtype="<u8"))


def _fingerprints(batches):
    for batch in batches:
        found = [fingerprint(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_id", "text_hash", "fp"])


def _mask(i: int, n: int) -> int:
    bits = sum(((1 << SEGMENTS[(i + k) % 3][1]) - 1) << SEGMENTS[(i + k) % 3][0] for k in range(n))
    return bits - (1 << 64) if bits >> 63 else bits


def _keys():
    """6 * (segment's number, half's number) and their bits, as one long."""
    out = []
    for i, (at, n) in enumerate(SEGMENTS):
        own = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1))
        start, width = SEGMENTS[(i + 1) % 3]
        for h, (a, b) in enumerate(((start, width // 2), (start + width // 2, width - width // 2))):
            half = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b) - 1))
            out.append(F.lit((2 * i + h) << 40).bitwiseOR(F.shiftleft(own, 12)).bitwiseOR(half))
    return F.array(*out)


def links(kinds: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the classes fp of kinds that chains of pairs at distance 2 or less connect."""
    keyed = kinds.select("fp", F.explode(_keys()).alias("key"))
    sizes = save(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    mask = F.element_at(F.array(*(F.lit(_mask(i, 2)) for i in range(3))), (F.shiftright("key", 41) + 1).cast("int"))
    near = F.expr(
        "flatten(transform(fps, (a, i) -> transform(filter(slice(fps, i + 2, size(fps)), "
        f"b -> bit_count((a ^ b) & mask) <= 1 and bit_count(a ^ b) <= {DISTANCE}), b -> struct(a as a, b as b))))"
    )
    paired = (
        keyed.join(sizes.where(f"n <= {BUCKET}").select("key"), "key")
        .groupBy("key").agg(F.collect_list("fp").alias("fps")).withColumn("mask", mask)
        .select(F.explode(near).alias("p")).select("p.a", "p.b").distinct()
    )
    crowded = save(keyed.join(sizes.where(f"n > {BUCKET}").select("key"), "key").select("fp").distinct(), "crowded")
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64) * (k == 63))) for k in range(64)))
    stars = (
        crowded.select("fp", F.explode(around).alias("at"))
        .groupBy("at").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).where("size(fps) > 1")
        .select("a", F.explode("fps").alias("b")).where("a <> b").distinct()
    )
    return paired.unionByName(stars)


#: What tells a component's rows apart, in the order in which one is kept: rows with ids first, then by id, then by the hash of the text.
KEY = ("no_id", "doc_id", "text_hash")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, text_hash), a null text being empty."""
    return texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))


def by_component(prints: DataFrame, kinds: DataFrame, found: DataFrame) -> DataFrame:
    """prints (doc_id, text_hash, fp) with kept, the KEY of the row that stays of its component.

    kinds has (fp, n, least), least being the least KEY of its rows; found has (node, root) of the classes fp that are linked.
    """
    rooted = save(kinds.select("fp", "n", "least").join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("kept"))
    table = save(rooted.join(least, "root").select("fp", "n", "kept"), "classes")
    discard(rooted)
    return lookup(prints, table, "fp", "n")


def least_key() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    own = keyed_texts(docs, id_col, text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    prints = save(own.mapInArrow(tidy(_fingerprints), f"doc_id {kind}, text_hash long, fp long"), "fingerprints")
    kinds = save(prints.groupBy("fp").agg(F.count("*").alias("n"), least_key()), "kinds")
    return by_component(prints, kinds, components(links(kinds)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    component_id is the least id that links reach, the row's own included.  A null or empty text, or one of white
    space alone, has the fingerprint zero and is linked like any other.  Repeated rows each keep their row; null ids
    count in links but are never the least, and a component of null ids alone has a null component_id; other columns
    are not looked at; no rows give no rows.
    """
    return _components(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("kept.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each component: that with the least id, or with the least hash of its text if all have none or the same.

    Rows that repeat an id are told apart by their texts, so unrelated ones all stay.  Texts that are null are empty ones.
    """
    return keep_one(docs, _components(docs, id_col, text_col), id_col, text_col)


def keep_one(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows that found, from by_component(), doesn't keep: an anti-join with those that go."""
    found = save(found.select("doc_id", "text_hash", "kept"), "components")
    stays = (F.col("doc_id").eqNullSafe(F.col("kept.doc_id"))) & (F.col("text_hash") == F.col("kept.text_hash"))
    gone = save(found.where(~stays).select("doc_id", "text_hash").distinct(), "gone")
    twice = found.where(stays).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    hash_name, id_name = (next(n for n in (f"_{x}{k}" for k in range(1 << 20)) if n not in docs.columns) for x in ("text_hash", "id"))
    marked = docs.withColumn(hash_name, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    gone = gone.select(F.col("doc_id").alias(id_name), F.col("text_hash").alias(f"{hash_name}_gone"))
    # The hash of the text leads the join: rows without an id, or with one that repeats, are spread by it.  A merge at any size: what goes grows with docs.
    out = marked.join(gone.hint("merge"), (F.col(hash_name) == F.col(f"{hash_name}_gone")) & F.col(id_col).eqNullSafe(F.col(id_name)), "left_anti")
    if twice:
        out = out.dropDuplicates([id_col, hash_name])
    return out.select(docs.columns)
