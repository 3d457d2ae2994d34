"""An openCypher subset compiled to DataFrame joins.

Patterns become joins on shared variables, so Catalyst orders and broadcasts them; a variable-length step is a breadth-first
search of at most HOPS levels.  Where only aggregates are asked for, bindings that nothing asks for any more are counted before the
next join, so that patterns which meet at a node don't make all their pairs.  Writes go to the graph that the driver keeps.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.errors import EngineError

HOPS = 8
#: The column for how many bindings a row stands for.
TIMES = "_times"
_TOKEN = re.compile(r"\s+|//[^\n]*|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|\d+\.\d+|\d+|[A-Za-z_]\w*|<=|>=|<>|->|<-|\.\.|.", re.S)
_AGGREGATES = ("count", "collect", "sum", "avg", "min", "max")
_WORDS = {"match", "where", "return", "order", "by", "skip", "limit", "create", "set", "delete", "and", "or", "not", "in", "starts", "ends", "with", "contains", "as", "distinct", "asc", "desc"}


@dataclass
class Node:
    var: str
    labels: list[str]
    props: dict
    named: bool


@dataclass
class Edge:
    var: str
    kinds: list[str]
    props: dict
    direction: str
    low: int | None = None
    high: int | None = None
    named: bool = False


@dataclass
class Item:
    kind: str  # var, prop, id, labels, agg, lit, star
    name: str = ""
    prop: str | None = None
    value: object = None
    distinct: bool = False
    inner: Item | None = None
    alias: str = ""


@dataclass
class Query:
    patterns: list[list] = field(default_factory=list)
    where: list | None = None
    items: list[Item] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple[Item, bool]] = field(default_factory=list)
    skip: int = 0
    limit: int | None = None
    create: list[list] = field(default_factory=list)
    sets: list[tuple[str, str, object]] = field(default_factory=list)
    deletes: list[str] = field(default_factory=list)


class Parser:
    def __init__(self, text: str) -> None:
        self.words = [w for w in _TOKEN.findall(text) if not w.isspace() and not w.startswith("//")]
        self.at, self.hidden = 0, 0

    def peek(self, k: int = 0) -> str:
        return self.words[self.at + k] if self.at + k < len(self.words) else ""

    def is_(self, *words: str) -> bool:
        return all(self.peek(k).lower() == w for k, w in enumerate(words))

    def take(self, word: str | None = None) -> str:
        w = self.peek()
        if word is not None and w.lower() != word:
            raise EngineError(f"expected '{word}', found '{w or 'the end'}'")
        self.at += 1
        return w

    def name(self) -> str:
        if not re.match(r"[A-Za-z_]", self.peek()):
            raise EngineError(f"expected a name, found '{self.peek() or 'the end'}'")
        return self.take()

    def literal(self):
        w = self.take()
        if w[:1] in "'\"" and len(w) > 1:
            return re.sub(r"\\(.)", r"\1", w[1:-1])
        if w == "-":
            return -self.literal()
        if re.match(r"\d", w):
            return float(w) if "." in w else int(w)
        if w.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[w.lower()]
        if w == "[":
            out = []
            while self.peek() != "]":
                out.append(self.literal())
                if self.peek() == ",":
                    self.take()
            self.take()
            return out
        raise EngineError(f"expected a value, found '{w}'")

    def props(self) -> dict:
        out = {}
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                k = self.name()
                self.take(":")
                out[k] = self.literal()
                if self.peek() == ",":
                    self.take()
            self.take()
        return out

    def _var(self) -> tuple[str, bool]:
        if re.match(r"[A-Za-z_]", self.peek()):
            return self.take(), True
        self.hidden += 1
        return f"_h{self.hidden}", False

    def node(self) -> Node:
        self.take("(")
        var, named = self._var()
        labels = []
        while self.peek() == ":":
            self.take()
            labels.append(self.name())
        props = self.props()
        self.take(")")
        return Node(var, labels, props, named)

    def edge(self) -> Edge | None:
        if self.peek() not in ("-", "<-", "<"):
            return None
        left = self.take() != "-"
        if left and self.peek() == "-":
            self.take()
        if self.peek() == "-" or self.peek() == "->":
            right = self.take() == "->"
            var, named, kinds, props, low, high = *self._hide(), [], {}, None, None
        else:
            self.take("[")
            var, named = self._var()
            kinds, low, high = [], None, None
            if self.peek() == ":":
                self.take()
                kinds.append(self.name())
                while self.peek() == "|":
                    self.take()
                    if self.peek() == ":":
                        self.take()
                    kinds.append(self.name())
            if self.peek() == "*":
                self.take()
                low, high = 1, HOPS
                if self.peek().isdigit():
                    low = high = int(self.take())
                if self.peek() == "..":
                    self.take()
                    high = int(self.take()) if self.peek().isdigit() else HOPS
                if high > HOPS or low > high:
                    raise EngineError(f"paths have at most {HOPS} hops")
            props = self.props()
            self.take("]")
            right = self.peek() == "->"
            self.take()
        if left and right:
            raise EngineError("an edge can't point both ways")
        return Edge(var, kinds, props, "in" if left else "out" if right else "both", low, high, named)

    def _hide(self) -> tuple[str, bool]:
        self.hidden += 1
        return f"_h{self.hidden}", False

    def pattern(self) -> list:
        out: list = [self.node()]
        while (e := self.edge()) is not None:
            out += [e, self.node()]
        return out

    def _list(self, one) -> list:
        out = [one()]
        while self.peek() == ",":
            self.take()
            out.append(one())
        return out

    # Conditions: nested lists (op, …).

    def condition(self) -> list:
        left = self._and()
        while self.is_("or"):
            self.take()
            left = ["or", left, self._and()]
        return left

    def _and(self) -> list:
        left = self._not()
        while self.is_("and"):
            self.take()
            left = ["and", left, self._not()]
        return left

    def _not(self) -> list:
        if self.is_("not"):
            self.take()
            return ["not", self._not()]
        if self.peek() == "(":
            self.take()
            inner = self.condition()
            self.take(")")
            return inner
        left = self.operand()
        if self.peek() in ("=", "<>", "<", "<=", ">", ">="):
            return [self.take(), left, self.operand()]
        if self.is_("in"):
            self.take()
            return ["in", left, self.literal()]
        if self.is_("starts", "with") or self.is_("ends", "with"):
            op = self.take().lower()
            self.take()
            return [op, left, self.operand()]
        if self.is_("contains"):
            self.take()
            return ["contains", left, self.operand()]
        raise EngineError(f"expected a comparison, found '{self.peek() or 'the end'}'")

    def operand(self) -> Item:
        w = self.peek()
        if re.match(r"[A-Za-z_]", w) and w.lower() not in ("true", "false", "null"):
            return self.item(False)
        return Item("lit", value=self.literal())

    def item(self, alias: bool = True) -> Item:
        w = self.peek()
        if w == "*":
            self.take()
            return Item("star")
        if re.match(r"[A-Za-z_]", w) and self.peek(1) == "(":
            fn = self.take().lower()
            self.take("(")
            if fn in ("id", "labels"):
                out = Item(fn, self.name())
                text = f"{fn}({out.name})"
            elif fn in _AGGREGATES:
                distinct = self.is_("distinct") and bool(self.take())
                inner = self.item(False)
                out = Item("agg", fn, distinct=distinct, inner=inner)
                text = f"{fn}({'DISTINCT ' if distinct else ''}{'*' if inner.kind == 'star' else inner.alias})"
            else:
                raise EngineError(f"unknown function '{fn}'")
            self.take(")")
        elif re.match(r"[A-Za-z_]", w) and w.lower() not in ("true", "false", "null"):
            name = self.name()
            out, text = Item("var", name), name
            if self.peek() == ".":
                self.take()
                out = Item("prop", name, self.name())
                text = f"{name}.{out.prop}"
        else:
            out = Item("lit", value=self.literal())
            text = str(out.value)
        out.alias = text
        if alias and self.is_("as"):
            self.take()
            out.alias = self.name()
        return out

    def statement(self) -> Query:
        q = Query()
        if self.is_("create"):
            self.take()
            q.create = self._list(self.pattern)
        else:
            self.take("match")
            q.patterns = self._list(self.pattern)
            while self.is_("match"):
                self.take()
                q.patterns += self._list(self.pattern)
            if self.is_("where"):
                self.take()
                q.where = self.condition()
            if self.is_("set"):
                self.take()
                q.sets = self._list(self._assignment)
            elif self.is_("delete"):
                self.take()
                q.deletes = self._list(self.name)
            else:
                self.take("return")
                q.distinct = self.is_("distinct") and bool(self.take())
                q.items = self._list(self.item)
                if self.is_("order", "by"):
                    self.at += 2
                    q.order = self._list(self._key)
                if self.is_("skip"):
                    self.take()
                    q.skip = int(self.take())
                if self.is_("limit"):
                    self.take()
                    q.limit = int(self.take())
        if self.peek() == ";":
            self.take()
        if self.peek():
            raise EngineError(f"unexpected '{self.peek()}'")
        return q

    def _assignment(self) -> tuple[str, str, object]:
        var = self.name()
        self.take(".")
        prop = self.name()
        self.take("=")
        return var, prop, self.literal()

    def _key(self) -> tuple[Item, bool]:
        item = self.item(False)
        down = self.is_("desc") and bool(self.take())
        if not down and self.is_("asc"):
            self.take()
        return item, down


def _conjuncts(c: list | None) -> list[list]:
    return [] if c is None else _conjuncts(c[1]) + _conjuncts(c[2]) if c[0] == "and" else [c]


def _mentioned(x) -> list[tuple[str, str]]:
    """(variable, field) of all that an item or a condition looks at; field * for all of a variable."""
    if isinstance(x, list):
        return [m for y in x for m in _mentioned(y)]
    if not isinstance(x, Item) or x.kind in ("lit", "star"):
        return []
    if x.kind == "agg":
        return [(v, "key" if f == "*" and x.name in ("count", "min", "max") else f) for v, f in _mentioned(x.inner)]
    return [(x.name, {"id": "key", "labels": "labels", "prop": "key" if x.prop == "key" else "props"}.get(x.kind, "*"))]


class Compiler:
    """Rows of bindings: a node variable v is a struct column, an edge one too, a path an array of edges."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = nodes, edges
        self.kinds: dict[str, str] = {}
        #: Of a query whose rows are folded: conditions by the node that they are about, and what else is looked at, by variable.
        self.about: dict[str, list] = {}
        self.looked: dict[str, set[str]] | None = None

    def _text(self, value) -> str:
        import json

        return value if isinstance(value, str) else json.dumps(value)

    def _matching(self, n: Node) -> DataFrame:
        df = self.nodes
        for label in n.labels:
            df = df.where(F.array_contains("labels", label))
        for k, v in n.props.items():
            df = df.where(F.col("key") == F.lit(v) if k == "key" else F.col("props")[k] == F.lit(self._text(v)))
        own = df.select(F.struct("key", "labels", "props").alias(n.var))
        for c in self.about.get(n.var, []):
            own = own.where(self._condition(c))
        if self.looked is not None and not (fields := self.looked.get(n.var, set())) & {"*"}:
            own = own.select(F.struct(*(F.col(n.var)[f].alias(f) for f in ("key", "labels", "props") if f == "key" or f in fields)).alias(n.var))
        return own

    def _fold(self, rows: DataFrame, keep: set[str] | None) -> DataFrame:
        """One row for each binding of keep, with how many rows it stands for; keep None: the rows as they are."""
        gone = [c for c in rows.columns if c != TIMES and c not in keep] if keep is not None else []
        if all(self.kinds.get(c) in ("edge", "path") for c in gone):
            return rows.drop(*gone)
        own = [c for c in rows.columns if c in keep]
        folded = rows.groupBy(*own).agg((F.sum(TIMES) if TIMES in rows.columns else F.count("*")).alias(TIMES))
        return folded if own else folded.where(F.col(TIMES) > 0)  # no row for no rows

    @staticmethod
    def _joined(rows: DataFrame, other: DataFrame, on: Column | None = None) -> DataFrame:
        both = {TIMES} <= {*rows.columns} & {*other.columns}
        other = other.withColumnRenamed(TIMES, "_m") if both else other
        got = rows.join(other, on) if on is not None else rows.crossJoin(other)
        return got.withColumn(TIMES, F.col(TIMES) * F.col("_m")).drop("_m") if both else got

    def _node(self, rows: DataFrame | None, n: Node, keep: set[str] | None = None) -> DataFrame:
        """keep: what is looked at here or later, where rows are folded."""
        self.kinds.setdefault(n.var, "node")
        found = self._matching(n)
        if rows is None:
            return found
        if n.var not in rows.columns:
            return self._joined(self._fold(rows, keep), self._fold(found, keep))
        if not n.labels and not n.props:
            return rows
        return rows.join(found.select(F.col(n.var)["key"].alias("_k")), F.col(n.var)["key"] == F.col("_k"), "left_semi")

    def _steps(self, e: Edge) -> DataFrame:
        df = self.edges
        if e.kinds:
            df = df.where(F.col("kind").isin(e.kinds))
        for k, v in e.props.items():
            df = df.where(F.col("props")[k] == F.lit(self._text(v)))
        own = F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("kind").alias("type"), "props")
        out, back = df.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), own.alias("_e")), df.select(F.col("dst").alias("_a"), F.col("src").alias("_b"), own.alias("_e"))
        return {"out": out, "in": back, "both": out.unionByName(back)}[e.direction]

    def _hop(self, rows: DataFrame, a: Node, e: Edge, b: Node, keep: set[str] | None = None) -> DataFrame:
        """keep: what is looked at later, where rows are folded."""
        steps = self._steps(e)
        if keep is not None:
            rows = self._fold(rows, keep | {a.var, b.var})
        if e.low is None:
            self.kinds[e.var] = "edge"
            if keep is not None and rows.columns != [a.var] and not {b.var, e.var} & {*keep, *rows.columns}:
                self.kinds.setdefault(b.var, "node")
                ends = self._fold(steps.join(self._matching(b), F.col("_b") == F.col(b.var)["key"]), {"_a"})
                return self._joined(rows, ends, F.col(a.var)["key"] == F.col("_a")).drop("_a")
            got = rows.join(steps, F.col(a.var)["key"] == F.col("_a")).withColumnRenamed("_e", e.var).drop("_a")
        else:
            self.kinds[e.var] = "path"
            paths = self._paths(rows.select(F.col(a.var)["key"].alias("_start")).distinct(), steps, e.low, e.high)
            got = rows.join(paths.withColumnRenamed("_path", e.var), F.col(a.var)["key"] == F.col("_start")).drop("_start")
        if b.var in rows.columns:
            got = got.where(F.col(b.var)["key"] == F.col("_b")).drop("_b")
            return self._node(got, b)
        self.kinds.setdefault(b.var, "node")
        found = self._matching(b)
        if keep is not None:
            got = self._fold(got, keep | {"_b"})
        return got.join(found, F.col("_b") == F.col(b.var)["key"]).drop("_b")

    def _paths(self, starts: DataFrame, steps: DataFrame, low: int, high: int) -> DataFrame:
        """(_start, _b, _path): each node at its least depth from each start, by filtered edges, with one path to it."""
        front = starts.select("_start", F.col("_start").alias("_b"), F.array().cast("array<struct<from: string, to: string, type: string>>").alias("_path"))
        seen, out = front, front if low == 0 else None
        for depth in range(1, high + 1):
            new = front.join(steps.select(F.col("_a").alias("_x"), F.col("_b").alias("_y"), "_e"), F.col("_b") == F.col("_x"))
            new = new.select("_start", F.col("_y").alias("_b"), F.concat("_path", F.array(F.struct(F.col("_e")["from"].alias("from"), F.col("_e")["to"].alias("to"), F.col("_e")["type"].alias("type")))).alias("_path"))
            new = new.groupBy("_start", "_b").agg(F.min("_path").alias("_path"))
            front = new.join(seen.select("_start", "_b"), ["_start", "_b"], "left_anti").select("_start", "_b", "_path").persist()
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
            if depth >= low:
                out = front if out is None else out.unionByName(front)
        return out if out is not None else seen.where("false")

    def match(self, q: Query, fold: bool = False) -> DataFrame:
        """Patterns one after another, those first that share a variable with what is bound, and each from there on both ways:
        only patterns that share nothing make a product.  fold: rows may stand for several bindings, by their column TIMES, and
        have only those variables for sure that conditions on several, or the items, look at."""
        rows: DataFrame | None = None
        rest = _conjuncts(q.where) if fold else [q.where] if q.where else []
        if fold:
            nodes = {n.var for p in q.patterns for n in p[::2]}
            for c in list(rest):
                if len(own := {v for v, _ in _mentioned(c)}) == 1 and own <= nodes:
                    self.about.setdefault(own.pop(), []).append(c)
                    rest.remove(c)
            self.looked = {}
            for v, f in _mentioned([*q.items, *rest]):
                self.looked.setdefault(v, set()).add(f)
        todo = list(q.patterns)
        while todo:
            bound = set(rows.columns) if rows is not None else set()
            p = next((x for x in todo if any(n.var in bound for n in x[::2])), todo[0])
            todo.remove(p)
            runs = self._runs(p, bound)
            for k, run in enumerate(runs):
                later = lambda at: {*self.looked, *(x.var for r in (run[at:], *runs[k + 1 :], *todo) for x in r)} if fold else None  # noqa: B023, E731
                rows = self._node(rows, run[0], later(int(len(run) == 1)))
                for at in range(0, len(run) - 1, 2):
                    rows = self._hop(rows, *run[at : at + 3], later(at + 2 + (at + 3 == len(run))))
        for c in rest:
            rows = rows.where(self._condition(c))
        return rows

    @staticmethod
    def _runs(p: list, bound: set[str]) -> list[list]:
        """The pattern, or from its first bound node on and then back to its beginning."""
        at = next((k for k in range(0, len(p), 2) if p[k].var in bound), 0)
        back = p[: at + 1][::-1]
        if not at or any(e.low is not None and not e.var.startswith("_h") for e in back[1::2]):
            return [p]
        flipped = [replace(x, direction={"out": "in", "in": "out"}.get(x.direction, x.direction)) if k % 2 else x for k, x in enumerate(back)]
        return [p[at:], flipped] if len(p) > at + 1 else [flipped]

    def value(self, item: Item, times: Column | None = None) -> Column:
        if item.kind == "lit":
            return F.lit(item.value)
        if item.kind == "agg":
            return self._aggregate(item, times)
        if item.name not in self.kinds:
            raise EngineError(f"unknown variable '{item.name}'")
        c = F.col(item.name)
        if item.kind == "id":
            return c["key"]
        if item.kind == "labels":
            return c["labels"]
        if item.kind == "prop":
            if self.kinds[item.name] == "node" and item.prop == "key":
                return c["key"]
            if self.kinds[item.name] == "edge" and item.prop == "type":
                return c["type"]
            return c["props"][item.prop]
        return c

    def _aggregate(self, item: Item, times: Column | None = None) -> Column:
        """times: how many bindings a row stands for."""
        if item.inner.kind == "star":
            return F.count("*") if times is None else F.coalesce(F.sum(times), F.lit(0))
        v = self.value(item.inner)
        if item.inner.kind == "var":
            v = v["key"] if self.kinds[item.inner.name] == "node" and item.name in ("count", "min", "max") else F.struct(v["from"], v["to"], v["type"]) if self.kinds[item.inner.name] == "edge" and item.name == "count" else v
        number = v.try_cast("double") if item.name in ("sum", "avg", "min", "max") else v
        if item.name == "count":
            if times is not None and not item.distinct:
                return F.coalesce(F.sum(F.when(v.isNotNull(), times)), F.lit(0))
            return F.count_distinct(v) if item.distinct else F.count(v)
        if item.name == "collect":
            return F.collect_set(v) if item.distinct else F.collect_list(v)
        if item.name == "sum":
            return F.coalesce(F.sum_distinct(number) if item.distinct else F.sum(number if times is None else number * times), F.lit(0.0))
        if item.name == "avg":
            return F.avg(number) if times is None else F.sum(number * times) / F.sum(F.when(number.isNotNull(), times))
        fn = F.min if item.name == "min" else F.max
        return F.coalesce(fn(number).cast("string"), fn(v.cast("string")))

    def _condition(self, c: list) -> Column:
        op = c[0]
        if op in ("and", "or"):
            a, b = self._condition(c[1]), self._condition(c[2])
            return a & b if op == "and" else a | b
        if op == "not":
            return ~self._condition(c[1])
        left = self.value(c[1])
        if op == "in":
            found = [self._compare("=", left, c[1], Item("lit", value=v)) for v in c[2]]
            out = F.lit(False)
            for x in found:
                out = out | x
            return out
        if op in ("starts", "ends", "contains"):
            return {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[op](left.cast("string"), self.value(c[2]).cast("string"))
        return self._compare(op, left, c[1], c[2])

    def _compare(self, op: str, left: Column, a: Item, b: Item) -> Column:
        """Properties are JSON texts: numbers compare as numbers, everything else as text."""
        right = self.value(b)
        if any(isinstance(x.value, (int, float)) and not isinstance(x.value, bool) for x in (a, b) if x.kind == "lit"):
            left, right = left.try_cast("double"), right.try_cast("double")
        elif any(isinstance(x.value, bool) for x in (a, b) if x.kind == "lit"):
            left, right = left.cast("string"), right.cast("string")
        elif a.kind == b.kind == "prop":
            x, y = left.try_cast("double"), right.try_cast("double")
            if op in ("=", "<>"):  # each side by itself, so that it can be the key of a join
                same = F.coalesce(x.cast("string"), left) == F.coalesce(y.cast("string"), right)
                return same if op == "=" else ~same
            number = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            text = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
            return F.when(x.isNotNull() & y.isNotNull(), number).otherwise(text)
        return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]

    def run(self, q: Query) -> DataFrame:
        aggregates = [i for i in q.items if i.kind == "agg"]
        fold = bool(aggregates) and all(i.distinct or i.name != "collect" for i in aggregates) and not any(i.kind == "star" for i in q.items)
        rows = self.match(q, fold)
        times = F.col(TIMES) if TIMES in rows.columns else None
        items = q.items
        if any(i.kind == "star" for i in items):
            items = [Item("var", v, alias=v) for v in self.kinds if not v.startswith("_h")]
        groups = [i for i in items if i.kind != "agg"]
        keys: list[tuple[Item, bool, str]] = [(i, down, f"_o{k}") for k, (i, down) in enumerate(q.order)]
        named = {i.alias: i for i in items}
        if len(groups) < len(items):
            plain = [self.value(i).alias(i.alias) for i in groups]
            folded = (rows.groupBy(*plain) if plain else rows).agg(*(self.value(i, times).alias(i.alias) for i in items if i.kind == "agg"))
            out = folded.select(*(F.col(f"`{i.alias}`") for i in items))
        else:
            extra = [self.value(i).alias(n) for i, _, n in keys if i.alias not in named] if not q.distinct else []
            out = rows.select(*(self.value(i).alias(i.alias) for i in items), *extra)
        if q.distinct:
            out = out.distinct()
        order = []
        for i, down, n in keys:
            if i.alias in named:
                c = F.col(f"`{i.alias}`")
            elif n in out.columns:
                c = F.col(n)
            else:
                raise EngineError(f"can't order by '{i.alias}', which is not returned")
            if dict(out.dtypes).get(i.alias, dict(out.dtypes).get(n)) == "string":
                order += [(x.desc_nulls_last() if down else x.asc_nulls_first()) for x in (c.try_cast("double"), c)]
            else:
                order.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        if order:
            out = out.orderBy(*order)
        if q.skip:
            out = out.offset(q.skip)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.select(*(F.col(f"`{i.alias}`") for i in items))


def is_write(text: str) -> bool:
    """Whether a statement changes the graph: what a read-only role must not run."""
    return bool(re.search(r"(?i)\b(create|set|delete)\b", re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"", "''", text)))


def run(graph, text: str) -> DataFrame:
    """Parse and run one statement; writes return one row with what they changed."""
    q = Parser(text).statement()
    if q.create:
        n = e = 0
        bound: dict[str, str] = {}
        for p in q.create:
            for node in p[::2]:
                if node.var in bound and not node.labels and not node.props:
                    continue
                props = {k: v for k, v in node.props.items() if k != "key"}
                key = node.props.get("key") or f"node-{len(graph.nodes) + 1}"
                graph.upsert_node(str(key), node.labels, props)
                bound[node.var] = str(key)
                n += 1
        for p in q.create:
            for a, edge, b in zip(p[::2], p[1::2], p[2::2]):
                if len(edge.kinds) != 1:
                    raise EngineError("an edge to be created needs one type")
                src, dst = (bound[b.var], bound[a.var]) if edge.direction == "in" else (bound[a.var], bound[b.var])
                graph.upsert_edge(src, dst, edge.kinds[0], edge.props, edge.direction != "both")
                e += 1
        return graph.spark.createDataFrame([(n, e)], "nodes bigint, edges bigint")
    compiler = Compiler(*graph.frames())
    if q.sets or q.deletes:
        rows = compiler.match(q)
        changed: set = set()
        for var, prop, value in q.sets:
            for r in rows.select(F.col(var)["key"]).distinct().collect():
                graph.upsert_node(r[0], (), {prop: value})
                changed.add(r[0])
        for var in q.deletes:
            kind = compiler.kinds.get(var)
            if kind == "edge":
                for r in rows.select(F.col(var)["from"], F.col(var)["to"], F.col(var)["type"]).distinct().collect():
                    changed.update([tuple(r)] * graph.delete_edges(*r))
            else:
                for r in rows.select(F.col(var)["key"]).distinct().collect():
                    if graph.delete_node(r[0]):
                        changed.add(r[0])
        return graph.spark.createDataFrame([(len(changed),)], "changed bigint")
    return compiler.run(q)
