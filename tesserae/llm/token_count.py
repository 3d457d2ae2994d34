"""Token counts: pieces are counted once per distinct pre-token, and documents sum these counts by pre-token frequency.

Two passes over the texts, neither of which makes token ids of a document:

1. distinct pre-tokens with their frequencies, combined in each task before the shuffle; the tokenizers library
   counts the pieces of each once; the table is kept in the shared folder.
2. every document's pre-token frequencies meet the counts.  The HOT most frequent pre-tokens are a table of bounded
   size that every task holds, so the bulk of all occurrences is summed where the document is read; the others go as
   (document, pre-token, frequency) rows through a shuffled join.  Those are rare by construction, so no key of that
   join is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.chunks import PreTokens, slices
from tesserae.llm.common import most_frequent, save, ship, texts, tidy

#: Pre-tokens whose counts every task holds: at most some 5 MB, whatever the input.
HOT = 150_000


def _distinct(path: str):
    """Distinct pre-tokens of the task and how often each occurs."""

    def run(batches):
        cutter, uses = PreTokens.own(path), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                found = np.bincount(cutter.run(part.column(0))[0], minlength=len(cutter.words))
                found[: len(uses)] += uses
                uses = found
                if cutter.full():
                    yield from _rows(cutter.words, uses)
                    cutter.clear()
                    uses = np.zeros(0, np.int64)
        yield from _rows(cutter.words, uses)

    return run


def _rows(words: pa.StringArray, uses: np.ndarray):
    met = np.flatnonzero(uses)
    for i in range(0, len(met), 100_000):
        at = met[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(uses[at])], ["word", "uses"])


def _pieces(path: str):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(PreTokens.own(path).pieces(batch.column(0)))], ["word", "uses", "pieces"])

    return run


def _sums(hot, path: str):
    """A row for each text with the sum over its hot pre-tokens, and one for each of its rare ones."""

    def run(batches):
        cutter, number = PreTokens.own(path), TaskContext.get().partitionId() << 36
        words, pieces = hot.value
        known = np.zeros(0, np.int64)  # of the cutter's words; -1: rare
        for batch in batches:
            for part in slices(batch, 1):
                codes, ends = cutter.run(part.column(1))
                at = pc.index_in(cutter.words[len(known) :], value_set=words).fill_null(-1).to_numpy()
                known = np.concatenate([known, np.where(at < 0, -1, pieces[at])])
                own = known[codes]
                sums = np.concatenate([[0], np.cumsum(np.maximum(own, 0))])[ends]
                rows, n = number + 1 + np.arange(part.num_rows), part.num_rows
                number += n
                rare = np.flatnonzero(own < 0)
                pairs, times = np.unique((np.searchsorted(ends, rare, "right") - 1) * len(known) + codes[rare], return_counts=True)
                doc, word = np.divmod(pairs, len(known))
                zeros = np.zeros(len(doc), np.int64)
                size = pc.binary_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                # A text's own row has a key that is no pre-token, as those aren't led by anything before a blank: it spreads these rows over the join's tasks.
                keys = pa.concat_arrays([pa.array([f"a {k}" for k in rows.tolist()], pa.string()), cutter.words.take(pa.array(word))])
                out = [np.concatenate([rows, rows[doc]]), np.concatenate([size, zeros]), np.concatenate([np.diff(sums), zeros]), np.concatenate([np.zeros(n, np.int64), times])]
                ids = pa.concat_arrays([part.column(0), part.column(0).take(pa.array(doc))])
                table = pa.RecordBatch.from_arrays([pa.array(out[0]), ids, pa.array(out[1]), pa.array(out[2]), keys, pa.array(out[3])], ["row", "doc_id", "n_bytes", "sure", "word", "n"])
                yield from (table.slice(i, 200_000) for i in range(0, table.num_rows, 200_000))
                if cutter.full():
                    cutter.clear()
                    known = np.zeros(0, np.int64)

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs, as the tokenizers library has them for the file at path.

    Special strings inside texts count as the library's default has it.  A null or empty text has no tokens;
    repeated rows and null ids keep their rows; other columns of docs are not looked at; no rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    own = texts(docs, id_col, text_col)
    id_type = own.schema["doc_id"].dataType.simpleString()
    found = own.select("text").mapInArrow(tidy(_distinct(path)), "word string, uses long").groupBy("word").agg(F.sum("uses").alias("uses"))
    table = save(found.mapInArrow(tidy(_pieces(path)), "word string, uses long, pieces int"), "pre-tokens")
    top = most_frequent(table, HOT, "uses", "word").select("word", "pieces").toArrow().combine_chunks()
    hot = spark.sparkContext.broadcast((pa.concat_arrays(top.column(0).chunks), top.column(1).to_numpy().astype("int64")) if top.num_rows else (pa.array([], pa.string()), np.zeros(1, np.int64)))
    rows = own.mapInArrow(tidy(_sums(hot, path)), f"row long, doc_id {id_type}, n_bytes long, sure long, word string, n long")
    return (
        rows.join(table.select("word", "pieces"), "word", "left")
        .groupBy("row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("sure") + F.coalesce(F.col("n") * F.col("pieces"), F.lit(0))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
