"""Merging, retention, and the statements that rewrite parts.

Parts are rewritten one by one, so that what a statement needs is bounded by a part, and all its changes are published
as one version of the table: readers see the parts before or after it, and a crash leaves them as they were.  Parts
that statistics exclude are not read at all.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import Column as Expression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.errors import ConflictError, EngineError
from tesserae.plans.predicate import prune
from tesserae.sources.catalog import Column, Store, Table
from tesserae.sources.parts import Part, commit, parts_of, scan, write_part

MERGE_ROWS, AUTO_MERGE = 4_194_304, 8
#: Parts that a statement rewrites at a time.
REWRITES = 4


def pick(parts: list[Part], budget: int) -> list[Part]:
    """The next parts to merge: of the smallest size tier with two or more, else the two smallest; within budget rows."""
    tiers: dict[int, list[Part]] = {}
    for p in parts:
        tiers.setdefault(max(p.rows, 1).bit_length() - 1, []).append(p)
    full = [t for t in sorted(tiers) if len(tiers[t]) > 1]
    pool = tiers[full[0]] if full else sorted(parts, key=lambda p: p.rows)[:2]
    out, rows = [], 0
    for p in pool:
        if rows + p.rows > budget:
            break
        out.append(p)
        rows += p.rows
    return out if len(out) > 1 else []


def adjacent(parts: list[Part], budget: int) -> list[Part]:
    """The next parts to merge of a table with UNIQUE keys: neighbours in the order of writing, so that the newest row of a
    key stays the newest; the run of two or more with the fewest rows for each, and then the longest."""
    best, ends = [], range(len(parts))
    for i in ends:
        rows = parts[i].rows
        for j in ends[i + 1 :]:
            rows += parts[j].rows
            if rows > budget:
                break
            run = parts[i : j + 1]
            if not best or (rows / len(run), -len(run)) < (sum(p.rows for p in best) / len(best), -len(best)):
                best = run
    return best


def merge(spark: SparkSession, store: Store, table: Table, budget: int = MERGE_ROWS) -> int:
    """Merge passes until nothing is picked; how many there were."""
    passes = 0
    while chosen := (adjacent if table.unique else pick)(parts_of(store, table.name), budget):
        chosen.sort(key=lambda p: p.seq)
        claims = [f"merge-claims/{table.name}/{p.name}" for p in chosen]
        got = [c for c in claims if store.claim(c)]
        try:
            if len(got) < len(claims):
                raise ConflictError(f"another merge of '{table.name}' is running")
            place = "_place" if table.unique else None
            part = write_part(spark, store, table, scan(spark, table, chosen, place), max(p.level for p in chosen) + 1, place, chosen[-1].seq)
            commit(store, table.name, [part], chosen)
        finally:
            for c in got:
                store.delete(c)
        passes += 1
    return passes


def _rewrite(spark: SparkSession, store: Store, table: Table, part: Part, rows: DataFrame) -> Part | None:
    """The part with these rows in its place, not yet published."""
    claim = f"merge-claims/{table.name}/{part.name}"
    if not store.claim(claim):
        raise ConflictError(f"part '{part.name}' is being rewritten; retry")
    try:
        return write_part(spark, store, table, rows, part.level, seq=part.seq)
    finally:
        store.delete(claim)


def _each(store: Store, table: Table, rewrite, parts: list[Part]) -> int:
    """Rewrite parts REWRITES at a time, as jobs of their own, and publish all together; the sum of the rows that changed.

    rewrite: from a part to how many rows change, whether the part goes, and what takes its place.
    """
    with ThreadPoolExecutor(REWRITES) as pool:
        found = list(pool.map(rewrite, parts)) if len(parts) > 1 else list(map(rewrite, parts))
    old = [p for p, (_, goes, _) in zip(parts, found) if goes]
    if old:
        commit(store, table.name, [new for _, _, new in found if new], old)
    return sum(n for n, _, _ in found)


def delete_rows(spark: SparkSession, store: Store, table: Table, condition: Expression | None, predicate=None) -> int:
    """Remove the rows for which condition is true; rows for which it is null stay."""
    hit = F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(True)

    def one(part: Part):
        rows = scan(spark, table, [part])
        found = part.rows if condition is None else rows.where(hit).count()
        return found, found > 0, _rewrite(spark, store, table, part, rows.where(~hit)) if 0 < found < part.rows else None

    return _each(store, table, one, prune(parts_of(store, table.name), predicate))


def update_rows(spark: SparkSession, store: Store, table: Table, values: dict[str, Expression], condition: Expression | None, predicate=None) -> int:
    """Assign values, cast to their columns' types, in the rows for which condition is true, and only in those."""
    for c in values:
        table.column(c)
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))

    def one(part: Part):
        rows = scan(spark, table, [part])
        found = part.rows if condition is None else rows.where(hit).count()
        new = [F.when(hit, values[c.name].cast(c.type.spark)).otherwise(F.col(f"`{c.name}`")).alias(c.name) if c.name in values else F.col(f"`{c.name}`") for c in table.columns]
        return found, found > 0, _rewrite(spark, store, table, part, rows.select(*new)) if found else None

    return _each(store, table, one, prune(parts_of(store, table.name), predicate))


def expire(spark: SparkSession, store: Store, table: Table, now: dt.datetime | None = None) -> int:
    """Remove rows older than the table's TTL; a null never expires.  Parts wholly older go without being read."""
    if not table.ttl:
        return 0
    name, seconds = table.ttl
    cutoff = (now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) - dt.timedelta(seconds=seconds)
    kind = table.column(name).type.spark
    if isinstance(kind, T.LongType):
        value = int(cutoff.replace(tzinfo=dt.timezone.utc).timestamp() * 1e9)
    else:
        value = cutoff.date() if isinstance(kind, T.DateType) else cutoff

    def one(part: Part):
        s = part.columns[name]
        if s.high < value and not s.nulls:
            return part.rows, True, None
        rows = scan(spark, table, [part])
        old = F.coalesce(F.col(f"`{name}`") < F.lit(value).cast(kind), F.lit(False))
        return rows.where(old).count(), True, _rewrite(spark, store, table, part, rows.where(~old))

    return _each(store, table, one, [p for p in parts_of(store, table.name) if p.columns[name].low is not None and p.columns[name].low < value])


def insert(spark: SparkSession, store: Store, table: Table, df: DataFrame, auto_merge: int = AUTO_MERGE, mark: str | None = None) -> int:
    """Append df as one part; columns are matched by name, must all be known, and missing ones are null.  With a mark that was there before, nothing happens."""
    names = {c.name for c in table.columns}
    if extra := [c for c in df.columns if c not in names]:
        raise EngineError(f"table '{table.name}' has no column {', '.join(extra)}")
    for c in table.columns:
        if c.name not in df.columns:
            df = df.withColumn(c.name, F.lit(None).cast(c.type.spark))
    for c in table.columns:
        if not c.nullable:
            df = df.withColumn(c.name, F.when(F.col(f"`{c.name}`").isNull(), F.raise_error(F.lit(f"null in column '{c.name}', which is NOT NULL"))).otherwise(F.col(f"`{c.name}`")))
    part = write_part(spark, store, table, df)
    if part and not commit(store, table.name, [part], mark=mark):
        return 0
    if len(parts_of(store, table.name)) >= auto_merge:
        merge(spark, store, table)
    expire(spark, store, table)
    return part.rows if part else 0


def add_column(spark: SparkSession, store: Store, table: Table, column: Column) -> Table:
    """The table with one more column, which old rows have at its type's default."""
    if column.name in {c.name for c in table.columns}:
        raise EngineError(f"column '{column.name}' exists already")
    value = column.type.default
    lit = (F.lit(dt.date(1970, 1, 1)) if isinstance(column.type.spark, T.DateType) else F.lit("1970-01-01 00:00:00")).cast(column.type.spark) if value == "epoch" else F.lit(value).cast(column.type.spark)
    new = replace(table, columns=[*table.columns, column])
    _each(store, new, lambda p: (p.rows, True, write_part(spark, store, new, scan(spark, table, [p]).withColumn(column.name, lit), p.level, seq=p.seq)), parts_of(store, table.name))
    return new


def drop_column(spark: SparkSession, store: Store, table: Table, name: str) -> Table:
    table.column(name)
    if name in table.sort_key or name in table.unique or (table.ttl and table.ttl[0] == name):
        raise EngineError(f"column '{name}' is part of a key")
    new = replace(table, columns=[c for c in table.columns if c.name != name])
    _each(store, new, lambda p: (p.rows, True, write_part(spark, store, new, scan(spark, table, [p]).drop(name), p.level, seq=p.seq)), parts_of(store, table.name))
    return new


def optimize(spark: SparkSession, store: Store, table: Table, budget: int = MERGE_ROWS) -> int:
    passes = merge(spark, store, table, budget)
    expire(spark, store, table)
    return passes
