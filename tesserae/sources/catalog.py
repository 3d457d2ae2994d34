"""Table definitions, their DDL, and the store of manifests and part metadata."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import types as T

from tesserae.errors import ConflictError, EngineError
from tesserae.types import TypeSpec

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_SECONDS = {"second": 1, "hour": 3600, "day": 86_400, "month": 30 * 86_400}


class Store:
    """Small objects under a root folder or URL, written whole; put_if_absent is the only lock.

    It is atomic on local disks (a hard link), and elsewhere where Hadoop's create-without-overwrite is, as on HDFS and
    on object stores whose connector has conditional writes; that takes a Spark session.
    """

    def __init__(self, root: str, spark=None) -> None:
        self.root, self.spark = root.rstrip("/"), spark
        self.files, self.path = fs.FileSystem.from_uri(self.root if "://" in self.root else os.path.abspath(self.root))
        self.url = self.root if "://" in self.root else f"file://{self.path}"
        self.files.create_dir(self.path, recursive=True)
        self.local = isinstance(self.files, fs.LocalFileSystem)

    def put(self, key: str, data: bytes) -> None:
        path = f"{self.path}/{key}"
        self.files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with self.files.open_output_stream(own) as out:
            out.write(data)
        self.files.move(own, path)

    def put_if_absent(self, key: str, data: bytes) -> bool:
        path = f"{self.path}/{key}"
        self.files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        if self.local:
            own = f"{path}.{uuid.uuid4().hex}.tmp"
            with open(own, "xb") as out:
                out.write(data)
            try:
                os.link(own, path)  # there with all its bytes, or not at all
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
            return True
        if self.spark is not None:
            jvm, where = self.spark._jvm, f"{self.url}/{key}"
            target = jvm.org.apache.hadoop.fs.Path(where)
            try:
                out = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(target, False)
                out.write(bytearray(data))
                out.close()
            except Exception:
                if self.exists(key):
                    return False
                raise
            return True
        if self.exists(key):
            return False
        self.put(key, data)
        return True

    def get(self, key: str) -> bytes | None:
        if not self.exists(key):
            return None
        with self.files.open_input_stream(f"{self.path}/{key}") as f:
            return f.read()

    def exists(self, key: str) -> bool:
        return self.files.get_file_info(f"{self.path}/{key}").type != fs.FileType.NotFound

    def list(self, prefix: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.path}/{prefix}", allow_not_found=True))
        return sorted(x.base_name for x in found if not x.base_name.endswith(".tmp"))

    def delete(self, key: str) -> None:
        info = self.files.get_file_info(f"{self.path}/{key}")
        if info.type == fs.FileType.Directory:
            self.files.delete_dir(info.path)
        elif info.type == fs.FileType.File:
            self.files.delete_file(info.path)

    def claim(self, key: str, seconds: int = 600) -> bool:
        """Take a lock that lapses by itself."""
        if self.put_if_absent(key, str(time.time()).encode()):
            return True
        if time.time() - float(self.get(key) or b"0") < seconds:
            return False
        self.delete(key)
        return self.put_if_absent(key, str(time.time()).encode())


@dataclass
class Column:
    name: str
    type: TypeSpec
    nullable: bool = True


@dataclass
class Table:
    """A table's definition; checked when made."""

    name: str
    columns: list[Column]
    sort_key: list[str] = field(default_factory=list)
    unique: list[str] = field(default_factory=list)
    engine: str = "local"
    compression: str = "zstd"
    ttl: tuple[str, int] | None = None
    created_at: int = 0

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        for n in [self.name, *names]:
            if not _NAME.fullmatch(n):
                raise EngineError(f"invalid identifier '{n}'")
        if not names:
            raise EngineError(f"table '{self.name}' needs at least one column")
        if len(set(names)) < len(names):
            raise EngineError(f"duplicate column in table '{self.name}'")
        for k in [*self.sort_key, *self.unique]:
            if k not in names:
                raise EngineError(f"key column '{k}' is not in table '{self.name}'")
        if self.unique and not self.sort_key:
            raise EngineError("UNIQUE needs ORDER BY")
        if self.unique != self.sort_key[: len(self.unique)]:
            raise EngineError("UNIQUE must be a prefix of ORDER BY")
        if self.ttl:
            kind = next((c.type.name for c in self.columns if c.name == self.ttl[0]), None)
            if kind not in ("TimestampMs", "TimestampNs", "Date32"):
                raise EngineError(f"TTL column '{self.ttl[0]}' must be a timestamp in ms or ns, or a date")
            if self.ttl[1] <= 0:
                raise EngineError("TTL must be positive")
        if self.compression not in ("zstd", "lz4", "none"):
            raise EngineError(f"unknown compression '{self.compression}'")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark, True) for c in self.columns])

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise EngineError(f"no column '{name}' in table '{self.name}'")

    def to_ddl(self) -> str:
        cols = ", ".join(f"{c.name} {c.type}{'' if c.nullable else ' NOT NULL'}" for c in self.columns)
        out = f"CREATE TABLE {self.name} ({cols}) ENGINE = {self.engine}"
        if self.sort_key:
            out += f" ORDER BY ({', '.join(self.sort_key)})"
        if self.unique:
            out += f" UNIQUE ({', '.join(self.unique)})"
        if self.ttl:
            unit = next(u for u in ("day", "hour", "second") if self.ttl[1] % _SECONDS[u] == 0)
            out += f" TTL {self.ttl[0]} INTERVAL {self.ttl[1] // _SECONDS[unit]} {unit.upper()}"
        return out + (f" COMPRESSION = {self.compression}" if self.compression != "zstd" else "")

    def to_json(self) -> bytes:
        return json.dumps({
            "name": self.name, "columns": [[c.name, str(c.type), c.nullable] for c in self.columns], "sort_key": self.sort_key, "unique": self.unique,
            "engine": self.engine, "compression": self.compression, "ttl": self.ttl, "created_at": self.created_at,
        }).encode()

    @staticmethod
    def from_json(data: bytes) -> Table:
        x = json.loads(data)
        x["columns"] = [Column(n, TypeSpec.parse(t), nullable) for n, t, nullable in x["columns"]]
        x["ttl"] = tuple(x["ttl"]) if x["ttl"] else None
        return Table(**x)


def _between(text: str) -> tuple[str, str]:
    """What the parentheses at the start of text hold, and what follows them."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return text[1:i], text[i + 1 :]
    raise EngineError("unbalanced parentheses")


def _items(text: str) -> list[str]:
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def parse_create(sql: str) -> tuple[Table, bool]:
    """The table of a CREATE TABLE statement with a column list, and whether it says IF NOT EXISTS."""
    m = re.match(r"(?is)\s*create\s+table\s+(if\s+not\s+exists\s+)?([^\s(]+)\s*(\(.*)$", sql.strip().rstrip(";"))
    if not m:
        raise EngineError("expected CREATE TABLE name (columns)")
    body, rest = _between(m[3])
    columns = []
    for item in _items(body):
        c = re.fullmatch(r"(?is)([^\s]+)\s+(.+?)(\s+not\s+null|\s+null)?", item)
        if not c:
            raise EngineError(f"can't read column '{item}'")
        columns.append(Column(c[1], TypeSpec.parse(c[2]), not (c[3] or "").strip().lower().startswith("not")))
    found: dict[str, str] = {}
    marks = list(re.finditer(r"(?i)\b(compression|unique|primary\s+key|order\s+by|engine|ttl)\b", rest))
    if rest[: marks[0].start() if marks else None].strip():
        raise EngineError(f"unexpected '{rest.strip()}'")
    for a, b in zip(marks, [*marks[1:], None]):
        found[re.sub(r"\s+", " ", a[1].lower())] = rest[a.end() : b.start() if b else None].strip().lstrip("=").strip()
    keys = lambda k: _items(found[k].strip("()")) if k in found else []
    ttl = None
    if "ttl" in found:
        t = re.fullmatch(r"(?i)(\w+)\s+interval\s+'?(\d+)'?\s+([a-z]+?)s?", found["ttl"])
        if not t or t[3].lower() not in _SECONDS:
            raise EngineError(f"expected TTL column INTERVAL n DAY|HOUR|MONTH, not '{found['ttl']}'")
        ttl = (t[1], int(t[2]) * _SECONDS[t[3].lower()])
    table = Table(m[2].strip("`\""), columns, keys("order by") or keys("primary key"), keys("unique"), found.get("engine", "local").strip("()").lower() or "local", found.get("compression", "zstd").strip("'\"").lower(), ttl, int(time.time() * 1000))
    return table, bool(m[1])


class Catalog:
    """Tables of one warehouse: a manifest each."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def names(self) -> list[str]:
        return [k.removesuffix(".json") for k in self.store.list("catalog") if k.endswith(".json")]

    def get(self, name: str) -> Table:
        data = self.store.get(f"catalog/{name}.json")
        if data is None:
            raise EngineError(f"table '{name}' does not exist")
        return Table.from_json(data)

    def has(self, name: str) -> bool:
        return self.store.exists(f"catalog/{name}.json")

    def create(self, table: Table) -> None:
        if not self.store.put_if_absent(f"catalog/{table.name}.json", table.to_json()):
            raise ConflictError(f"table '{table.name}' already exists")

    def replace(self, table: Table) -> None:
        self.store.put(f"catalog/{table.name}.json", table.to_json())

    def drop(self, name: str) -> None:
        self.get(name)
        for key in (f"catalog/{name}.json", f"log/{name}", f"parts/{name}"):
            self.store.delete(key)
