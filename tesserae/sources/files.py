"""Files: read_parquet, read_csv, read_json and Arrow files in queries, bulk loads, COPY TO, and result encoders.

The format is told by the file's extension, whatever the function is called.
"""

from __future__ import annotations

import io
import json
import re
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.errors import EngineError
from tesserae.sources.catalog import Table


def extension(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def _local(path: str) -> str:
    return path.removeprefix("file://")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One file or folder, schema inferred."""
    match extension(path):
        case "parquet":
            return spark.read.parquet(path)
        case "csv" | "tsv":
            return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if path.endswith(".tsv") else ",")
        case "json" | "ndjson" | "jsonl":
            return spark.read.json(path)
        case "orc":
            return spark.read.orc(path)
        case "arrow" | "ipc":
            with pa.memory_map(_local(path)) as f:
                try:
                    table = pa.ipc.open_file(f).read_all()
                except pa.ArrowInvalid:
                    f.seek(0)
                    table = pa.ipc.open_stream(f).read_all()
            return spark.createDataFrame(table)
    raise EngineError(f"unknown file extension of '{path}'; parquet, csv, tsv, json, ndjson, jsonl, orc, arrow and ipc are known")


def substitute(spark: SparkSession, sql: str) -> str:
    """sql with each read_*('path', …) replaced by a view over its files; several paths are put together by UNION ALL."""
    from tesserae.plans.dialect import arguments, closing
    from tesserae.plans.predicate import tokens

    words, out, i = tokens(sql), [], 0
    while i < len(words):
        nxt = i + 1
        while nxt < len(words) and words[nxt].isspace():
            nxt += 1
        if not re.fullmatch(r"(?i)read_(parquet|csv|json|ndjson|arrow)", words[i]) or nxt >= len(words) or words[nxt] != "(":
            out.append(words[i])
            i += 1
            continue
        end = closing(words, nxt)
        paths = ["".join(a).strip() for a in arguments(words[nxt + 1 : end])]
        if not paths or not all(p.startswith("'") for p in paths):
            raise EngineError(f"{words[i]} takes quoted paths only, no options")
        names = []
        for p in paths:
            names.append(name := f"_file_{uuid.uuid4().hex[:12]}")
            read(spark, p[1:-1].replace("''", "'")).createOrReplaceTempView(name)
        out.append(names[0] if len(names) == 1 else "(" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in names) + ")")
        i = end + 1
    return "".join(out)


def write(df: DataFrame, path: str) -> int:
    """Export as one file; a path that ends in / gets Spark's own folder of files instead, which is the way for large results."""
    kind = extension(path)
    if kind in ("arrow", "ipc"):
        table = df.toArrow()
        with pa.OSFile(_local(path), "wb") as f, pa.ipc.new_file(f, table.schema) as out:
            out.write_table(table)
        return table.num_rows
    if kind not in ("parquet", "csv", "json", "ndjson", "jsonl"):
        raise EngineError(f"can't write '{path}'")
    whole = path.endswith("/")
    folder = path if whole else f"{path}.{uuid.uuid4().hex[:8]}"
    writer = (df if whole else df.coalesce(1)).write.mode("error")
    {"parquet": writer.parquet, "csv": lambda p: writer.option("header", True).csv(p)}.get(kind, writer.json)(folder)
    reader = df.sparkSession.read
    n = {"parquet": reader.parquet, "csv": lambda p: reader.csv(p, header=True)}.get(kind, reader.text)(folder).count()
    if not whole:
        import glob

        shutil.move(glob.glob(f"{glob.escape(_local(folder))}/part-*")[0], _local(path))
        shutil.rmtree(_local(folder))
    return n


def load(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """A bulk load's rows in the table's schema.  In CSV, columns come in any order and all must be there; empty, \\N and
    null are NULL, as is what can't be read as the column's type."""
    kind = extension(path)
    if kind in ("csv", "tsv"):
        raw = spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
        if missing := [c.name for c in table.columns if c.name not in raw.columns]:
            raise EngineError(f"{path} lacks the columns {', '.join(missing)}")
        out = []
        for c in table.columns:
            text = F.trim(F.col(f"`{c.name}`"))
            value = F.when(~F.lower(text).isin("", "\\n", "null"), text)
            if c.type.name == "Bool":
                out.append(F.when(F.lower(value).isin("true", "1", "yes"), True).when(F.lower(value).isin("false", "0", "no"), False).alias(c.name))
            else:
                out.append(value.try_cast(c.type.spark).alias(c.name))
        return raw.select(*out)
    if kind in ("json", "jsonl", "ndjson"):
        with_array = spark.read.text(path).select(F.substring(F.trim("value"), 1, 1)).first()
        return spark.read.schema(table.schema).json(path, multiLine=bool(with_array and with_array[0] == "["))
    return read(spark, path).select(*(c.name for c in table.columns))


def encode(df: DataFrame, form: str = "table") -> str | bytes:
    """A result as table, box, csv, tsv, json, jsoneachrow, vertical or arrow; for results that fit the driver."""
    t = df.toArrow()
    if form == "arrow":
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        return sink.getvalue().to_pybytes()
    rows = t.to_pylist()
    show = lambda v: "NULL" if v is None else str(v)
    if form == "json":
        return json.dumps(rows, default=str)
    if form == "jsoneachrow":
        return "".join(json.dumps(r, default=str) + "\n" for r in rows)
    if form == "vertical":
        return "".join(f"Row {k}:\n" + "".join(f"  {n}: {show(v)}\n" for n, v in r.items()) for k, r in enumerate(rows, 1))
    if form in ("csv", "tsv"):
        import csv

        out = io.StringIO()
        w = csv.writer(out, delimiter="\t" if form == "tsv" else ",", lineterminator="\n")
        w.writerow(t.column_names)
        w.writerows([["" if v is None else v for v in r.values()] for r in rows])
        return out.getvalue()
    if form not in ("table", "box"):
        raise EngineError(f"unknown format '{form}'")
    cells = [t.column_names, *([show(v) for v in r.values()] for r in rows)]
    widths = [max(len(r[k]) for r in cells) for k in range(len(t.column_names))]
    bar, line = ("│", "┼".join("─" * (w + 2) for w in widths)) if form == "box" else ("|", "+".join("-" * (w + 2) for w in widths))
    text = [bar.join(f" {v.ljust(w)} " for v, w in zip(r, widths)) for r in cells]
    return "\n".join([text[0], line, *text[1:]]) + "\n"
