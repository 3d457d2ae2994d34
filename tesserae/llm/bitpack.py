"""Token-id files with fixed-width bit packing.

A shard file holds the ids of a run of documents, each id in the fewest bits that hold the vocabulary:

    blocks   ids packed least significant bit first; each block starts on a byte
    index    block offsets (uint64), ends of the documents in ids (uint64), document ids (int64), null flags (uint8)
    trailer  magic, bits, ids a block, documents, ids, blocks, place of the index

Equal-width ids let numpy pack and unpack a whole block at once, and the block offsets let a
reader fetch the ids of any place without the rest of the file.  Shards are files of the shared
folder, written under fresh names; only a task that Spark commits has its shard listed in the
manifest, so lost executors and repeated attempts leave no trace in what is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.chunks import ChunkEncoder, slices, vocabulary_size
from tesserae.llm.common import filesystem, save, scratch, ship, texts, tidy

MAGIC, TRAILER = b"TSBITS1\0", struct.Struct("<8sIIQQQQ")
BLOCK = 8192


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids fill `bits` bytes, so eight columns of shifts pack any number of them."""
    m = -(-len(ids) // 8)
    v = np.zeros(m * 8, dtype=np.uint64)
    v[: len(ids)] = ids
    v = v.reshape(m, 8)
    out = np.zeros((m, bits), dtype=np.uint8)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        moved = v[:, j] << np.uint64(shift)
        for t in range((shift + bits + 7) // 8):
            out[:, at + t] |= ((moved >> np.uint64(8 * t)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    m = -(-n // 8)
    raw = np.zeros(m * bits, dtype=np.uint8)
    raw[: len(data)] = np.frombuffer(data, dtype=np.uint8)[: m * bits]
    raw = raw.reshape(m, bits)
    out = np.empty((m, 8), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        v = np.zeros(m, dtype=np.uint64)
        for t in range((shift + bits + 7) // 8):
            v |= raw[:, at + t].astype(np.uint64) << np.uint64(8 * t)
        out[:, j] = (v >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


class ShardWriter:
    """Streams ids into one shard file; keeps no more than a batch of ids and the index."""

    def __init__(self, uri: str, bits: int) -> None:
        self.files, self.path = filesystem(uri)
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.bits = self.files.open_output_stream(self.path), bits
        self.rest, self.offsets, self.ends, self.docs, self.total = np.empty(0, "<u4"), [0], [], [], 0

    def add(self, docs: list, ids: np.ndarray, ends: np.ndarray) -> None:
        """The ids of documents, joined, and where each one's end."""
        self.docs += docs
        self.ends += (self.total + ends).tolist()
        self.total += len(ids)
        self._put(np.concatenate([self.rest, ids]), False)

    def _put(self, ids: np.ndarray, last: bool) -> None:
        full = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            data = pack(ids[i : min(i + BLOCK, full)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.rest = ids[full:]

    def close(self) -> None:
        self._put(self.rest, True)
        index = [np.array(self.offsets, "<u8"), np.array(self.ends, "<u8"), np.array([d or 0 for d in self.docs], "<i8"), np.array([d is None for d in self.docs], "u1")]
        self.out.write(b"".join(x.tobytes() for x in index))
        self.out.write(TRAILER.pack(MAGIC, self.bits, BLOCK, len(self.docs), self.total, len(self.offsets) - 1, self.offsets[-1]))
        self.out.close()


class ShardReader:
    """Random access to a shard: ids(a, b) reads just the blocks that hold the places a to b."""

    def __init__(self, uri: str) -> None:
        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.block, self.n_docs, self.n_tokens, n_blocks, at = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        data = self.file.read_at(size - TRAILER.size - at, at)
        cut = 8 * (n_blocks + 1)
        self.offsets = np.frombuffer(data[:cut], "<u8").astype(np.int64)
        self.ends = np.frombuffer(data[cut : (cut := cut + 8 * self.n_docs)], "<u8").astype(np.int64)
        self.docs = np.frombuffer(data[cut : (cut := cut + 8 * self.n_docs)], "<i8")
        self.nulls = np.frombuffer(data[cut : cut + self.n_docs], "u1").astype(bool)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.empty(0, "<u4")
        p, q = a // self.block, -(-b // self.block)
        data = self.file.read_at(int(self.offsets[q] - self.offsets[p]), int(self.offsets[p]))
        ids = unpack(data, self.bits, min(self.n_tokens, q * self.block) - p * self.block)
        return ids[a - p * self.block : b - p * self.block]

    def documents(self, step: int = 1 << 20):
        """Runs of (first document, last, their ids), of about `step` ids each: memory stays bounded but for one document."""
        first = 0
        while first < self.n_docs:
            start = int(self.ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(self.ends, start + step, "right")))
            yield first, last, self.ids(start, int(self.ends[last - 1]))
            first = last


def write_shards(docs: DataFrame, path: str, out: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Encode all texts with the tokenizers file at path, end each document with end_id, and write shards in ascending id order.

    Returns the manifest (part, uri, n_docs, n_tokens, start), start being the ids of all shards before.  A null
    text is empty; null ids come first; rows with one id are in an order told by their texts; no rows give no shards.
    """
    spark = docs.sparkSession
    ship(spark)
    own = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    bits, n = bits_for(max(vocabulary_size(path), end_id + 1)), parts or max(1, own.rdd.getNumPartitions())

    def write(batches):
        uri, shard, coder = f"{out}/shard-{uuid.uuid4().hex}.bits", None, ChunkEncoder.own(path)
        for batch in batches:
            for part in slices(batch, 1):
                ids, ends = coder.run(part.column(1))
                shard = shard or ShardWriter(uri, bits)
                shard.add(part.column(0).to_pylist(), np.insert(ids, ends[1:], end_id), ends[1:] + np.arange(1, len(ends)))
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "uri": uri, "n_docs": len(shard.docs), "n_tokens": shard.total}])

    # Ranges of (id, hash of the text), twice as many as input splits: rows of one id, or of none, share no task for that.
    own = own.withColumn("_place", F.xxhash64("text"))
    sorted_docs = own.repartitionByRange(2 * n, "doc_id", "_place").sortWithinPartitions("doc_id", "_place", "text").select("doc_id", "text")
    manifest = save(sorted_docs.mapInArrow(tidy(write), "part long, uri string, n_docs long, n_tokens long"), "shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, never for each document
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, unpacked from the shards of the manifest."""
    ship(spark)

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(uri)
                for a, b, ids in shard.documents():
                    ends = shard.ends[a:b]
                    begins = np.concatenate([shard.ends[a - 1 : a] if a else [0], ends[:-1]]).astype(np.int64)
                    data, base = memoryview(ids.astype("<u4").tobytes()), int(begins[0])
                    sums = [zlib.crc32(data[4 * (x - base) : 4 * (y - base)]) for x, y in zip(begins.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.docs[a:b], pa.int64(), mask=shard.nulls[a:b]), pa.array(begins + start), pa.array(ends - begins), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, manifest.count())
    return manifest.select("uri", "start").repartition(min(n, 100_000)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    return read_documents(spark, write_shards(docs, path, out or scratch(spark, "tokens"), end_id))
