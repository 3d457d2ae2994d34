"""Best-fit decreasing packing of token sequences, exact and global whatever the number of documents.

Best-fit decreasing takes pieces from long to short and puts each into the open bin with the least
room that still fits.  Pieces of one length are alike, and so are bins with one remaining capacity.
So the driver packs the histogram of lengths (as many rows as a sequence has tokens, whatever the
input): a segment tree over the remaining capacities finds the tightest bins in logarithmic time, and a
whole run of bins is filled at once.  The outcome is a plan of slots (length, first rank, how many, first
bin, pieces a bin, offset), and the executors give each piece its slot by its rank among the pieces of its length.

Bound of the plan: each length splits one run of bins at most and opens two, so there are no more than
3 * size runs; a bin gets pieces of at most sqrt(2 * size) different lengths, which fit together: 390,000 slots for 2048.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.chunks import ChunkEncoder, slices
from tesserae.llm.common import save, ship, texts, tidy


class SegmentTree:
    """Over capacities 0..size: which have bins, and which is the least of them from a given one on."""

    def __init__(self, size: int) -> None:
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.any = [False] * (2 * self.leaves)

    def put(self, capacity: int, value: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least_from(self, capacity: int) -> int | None:
        i = capacity + self.leaves
        if capacity >= self.leaves:
            return None
        if self.any[i]:
            return capacity
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, pieces, first bin, pieces a bin, offset) of the best-fit decreasing packing of all pieces."""
    tree, open_bins, slots, bins = SegmentTree(size), {}, [], 0  # open_bins: capacity -> runs (first bin, bins)

    def give(capacity: int, first: int, n: int) -> None:
        if capacity:
            open_bins.setdefault(capacity, []).append((first, n))
            tree.put(capacity, True)

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens doesn't fit {size}")
        left, rank = histogram[length], 0
        while left:
            room = tree.least_from(length)
            if room is None:
                room, first = size, bins
                n = -(-left // (size // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.put(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, full * each, first, each, size - room))
                give(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                slots.append((length, rank, left, first + full, each, size - room))
                give(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                give(room, first + full, n - full)
    return slots


def _pieces(path: str, end_id: int, size: int):
    """Each document's pieces, with their ranks among the task's pieces of their lengths."""

    def run(batches):
        part, seen, coder = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), ChunkEncoder.own(path)
        for batch in batches:
            for sub in slices(batch, 1):
                ids, ends = coder.run(sub.column(1))
                data = memoryview(np.insert(ids, ends[1:], end_id).astype("<u4").tobytes())
                ends = ends + np.arange(len(ends))
                total = np.diff(ends)
                pieces = -(-total // size)
                doc = np.repeat(np.arange(len(total)), pieces)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (total - (pieces - 1) * size)[doc]  # the first piece has what is left over
                start = np.where(k == 0, 0, head + (k - 1) * size)
                length = np.where(k == 0, head, size)
                at = ends[doc] + start
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order], "left")
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - first + seen[length[order]]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [sub.column(0).take(pa.array(doc)), pa.array(k, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(rank), pa.array(np.full(len(doc), part))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"],
                )

    return run


def _place(slots, size: int):
    def run(batches):
        table = slots.value
        lengths, ranks, _, bins, each, offsets = table
        keys = lengths * (1 << 40) + ranks  # ascending
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            at = np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1
            k = rank - ranks[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(bins[at] + k // each[at]), pa.array(offsets[at] + k % each[at] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of docs.

    A document longer than size is cut into pieces of that size, of which the first may be shorter; no other is cut.
    A null or empty text is a document of its end id alone.  Repeated rows and null ids are packed like any others;
    other columns of docs are not looked at; no rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    own = texts(docs, id_col, text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    pieces = save(own.mapInArrow(tidy(_pieces(path, end_id, size)), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, part long"), "pieces")
    counts = save(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    slots = np.array(sorted(plan(histogram, size)) or np.empty((0, 6)), dtype=np.int64).T
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first.hint("merge"), ["length", "part"])  # grows with the parts: never broadcast
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))
    return ranked.mapInArrow(
        _place(spark.sparkContext.broadcast(slots), size),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
