"""Keyed in-memory tables: an append log whose rows are all visible, with the latest row by key."""

from __future__ import annotations

import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.errors import EngineError
from tesserae.types import TypeSpec

SEQ = "_seq"


def latest_by_key(df: DataFrame, key: str | list[str], seq: str | list[str]) -> DataFrame:
    """The last row of each key in the order of seq: an aggregation, so it combines before the shuffle and needs no sort."""
    keys, order = [key] if isinstance(key, str) else key, [seq] if isinstance(seq, str) else seq
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    return df.groupBy(*keys).agg(last.alias("_last")).select(*(F.col(c) if c in keys else F.col(f"_last.{c}") for c in df.columns))


def adopted(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df in this session, if it is of another one on the same context: views are by session."""
    if df.sparkSession._jsparkSession.equals(spark._jsparkSession):
        return df
    df.createGlobalTempView(name := f"_adopted_{uuid.uuid4().hex[:12]}")
    try:
        return spark.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


class MemoryTables:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, {}

    def create(self, name: str, fields: list[tuple[str, str]], key: str | None = None) -> None:
        if name in self.tables:
            raise EngineError(f"memory table '{name}' already exists")
        if key and key not in dict(fields):
            raise EngineError(f"key column '{key}' is not in memory table '{name}'")
        schema = T.StructType([T.StructField(n, TypeSpec.parse(t).spark) for n, t in fields])
        self.tables[name] = {"schema": schema, "key": key, "batches": [], "next": 0}

    def drop(self, name: str) -> None:
        for b in self._get(name)["batches"]:
            b.unpersist()
        del self.tables[name]

    def _get(self, name: str) -> dict:
        if name not in self.tables:
            raise EngineError(f"memory table '{name}' does not exist")
        return self.tables[name]

    def insert(self, name: str, rows: DataFrame | list[dict] | str) -> int:
        """Append a DataFrame, a list of rows, a JSON array or NDJSON text."""
        t = self._get(name)
        if isinstance(rows, str):
            rows = json.loads(rows) if rows.lstrip().startswith("[") else [json.loads(x) for x in rows.splitlines() if x.strip()]
        if isinstance(rows, list):
            names = [f.name for f in t["schema"]]
            if extra := {k for r in rows for k in r} - set(names):
                raise EngineError(f"unknown fields {sorted(extra)}")
            rows = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], t["schema"])
        batch = adopted(self.spark, rows).select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in t["schema"]), (F.monotonically_increasing_id() + F.lit(t["next"])).alias(SEQ)).persist(StorageLevel.MEMORY_AND_DISK)
        n, high = batch.agg(F.count("*"), F.max(SEQ)).first()
        if n:
            t["batches"].append(batch)
            t["next"] = high + 1
        return n

    def log(self, name: str) -> DataFrame:
        t = self._get(name)
        out = None
        for b in t["batches"]:
            out = b if out is None else out.unionByName(b)
        return out if out is not None else self.spark.createDataFrame([], T.StructType([*t["schema"].fields, T.StructField(SEQ, T.LongType())]))

    def table(self, name: str) -> DataFrame:
        return self.log(name).drop(SEQ)

    def get(self, name: str, key) -> dict | None:
        """The latest row with this key."""
        t = self._get(name)
        if not t["key"]:
            raise EngineError(f"memory table '{name}' has no key")
        row = self.log(name).where(F.col(t["key"]) == F.lit(key)).orderBy(F.desc(SEQ)).drop(SEQ).first()
        return row.asDict(recursive=True) if row else None

    def compact(self, name: str) -> int:
        """Keep the latest row of each key; how many rows went.  Rows with a null key all stay."""
        t = self._get(name)
        if not t["key"]:
            return 0
        log = self.log(name)
        own = Window.partitionBy(t["key"]).orderBy(F.desc(SEQ))
        kept = log.withColumn("_r", F.row_number().over(own)).where((F.col("_r") == 1) | F.col(t["key"]).isNull()).drop("_r").persist(StorageLevel.MEMORY_AND_DISK)
        gone = log.count() - kept.count()
        for b in t["batches"]:
            b.unpersist()
        t["batches"] = [kept]
        return gone

    def register(self, names: set[str]) -> None:
        """Views for the memory tables that a query names."""
        for n in names & self.tables.keys():
            self.table(n).createOrReplaceTempView(n)
