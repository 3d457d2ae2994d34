"""Chat formatting: heterogeneous layouts to canonical turns, and turns to one training text with a loss mask.  All native.

The layout of a table, or of a row of JSON, is told by its nested field paths.  A mapping (SQL expressions to canonical
turns: conv_id, turn, role, text) is declared with the fingerprint of the paths that it needs, a hash of them sorted.
Of the mappings whose fingerprint is that of those of its paths which the layout has, the first in MAPPINGS is
selected, so that other fields, whatever their names, don't matter.

The template marks turns with control strings:

    <s> once a conversation; [INST]role\\ntext[/INST] for a turn that isn't the assistant's; text</s> for one that is

Texts may hold anything.  A control string inside one is stuffed: a backslash is put behind its first sign, and
one more where there are some already, so no control string is left in a text, and taking one backslash off again is exact.
Roles are URL-encoded, as they stand before a line break.  The loss mask covers the assistant's texts, without their ends.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CONTROL = r"(/?s>|/?INST\])"


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; [] stands for an array's elements, {} for a map's values."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.MapType):
        return paths(kind.valueType, f"{at}{{}}")
    return [at]


def fingerprint(names: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:16]


def _turns(*pairs: tuple[str, str]) -> str:
    """SQL of an array of turns from (role, text expression); a null text is no turn."""
    rows = ", ".join(f"if(({t}) is null, null, struct('{r}' as role, cast({t} as string) as text))" for r, t in pairs)
    return f"filter(array({rows}), t -> t is not null)"


_JOINED = "if(coalesce($input, '') = '', $instruction, concat($instruction, '\\n', $input))"
#: (field paths, SQL of array<struct<role, text>>, $ before each field), first come first served; "rows" marks a table with one turn a row.
MAPPINGS: dict[str, tuple[list[str], str]] = {
    "rows": (["turn", "role", "text"], "rows"),
    "messages": (["messages[].role", "messages[].content"], "transform($messages, m -> struct(m.role as role, m.content as text))"),
    "conversations": (["conversations[].from", "conversations[].value"], "transform($conversations, m -> struct(case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end as role, m.value as text))"),
    "instruction_input": (["instruction", "input", "output"], _turns(("user", _JOINED), ("assistant", "$output"))),
    "instruction_output": (["instruction", "output"], _turns(("user", "$instruction"), ("assistant", "$output"))),
    "system_prompt_response": (["system", "prompt", "response"], _turns(("system", "$system"), ("user", "$prompt"), ("assistant", "$response"))),
    "prompt_response": (["prompt", "response"], _turns(("user", "$prompt"), ("assistant", "$response"))),
    "prompt_completion": (["prompt", "completion"], _turns(("user", "$prompt"), ("assistant", "$completion"))),
    "question_answer": (["question", "answer"], _turns(("user", "$question"), ("assistant", "$answer"))),
}
_MARKS = {name: fingerprint(paths_) for name, (paths_, _) in MAPPINGS.items()}


def mapping(schema: T.StructType, id_col: str = "conv_id") -> tuple[str, str]:
    """(name, SQL) of the mapping that the schema's fingerprints select."""
    own = paths(T.StructType([f for f in schema.fields if f.name != id_col]))
    for name, (needs, sql) in MAPPINGS.items():
        if fingerprint([p for p in own if p in needs]) == _MARKS[name]:
            return name, sql
    raise ValueError(f"no mapping for the layout {fingerprint(own)}: {sorted(own)}")


def canonical(table: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) from any known layout; conversations without turns have no rows.  A null in a list of
    turns is a turn without role and text."""
    _, sql = mapping(table.schema, id_col)
    if sql == "rows":
        return table.select(F.col(id_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return table.select(F.col(id_col).alias("conv_id"), F.posexplode(F.expr(sql.replace("$", ""))).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("t.role").cast("string").alias("role"), F.col("t.text").cast("string").alias("text"))


def _paths_of(json: Column) -> Column:
    """Nested field paths of a JSON object, as far as a mapping may need them: its keys, and those of all objects in lists under them."""
    lists = sorted({p.split("[]")[0] for needs, _ in MAPPINGS.values() for p in needs if "[]" in p})

    def keys_under(k: str) -> Column:
        objects = F.from_json(F.get_json_object(json, f"$.{k}"), "array<map<string, string>>")
        return F.transform(F.array_distinct(F.flatten(F.transform(objects, F.map_keys))), lambda x: F.concat(F.lit(f"{k}[]."), x))

    inner = [keys_under(k) for k in lists]
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(F.json_object_keys(json), none), *(F.coalesce(F.filter(x, lambda p: p.isNotNull()), none) for x in inner))


def from_json_lines(rows: DataFrame, json_col: str = "value", id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text, layout) from rows of JSON in mixed layouts: each row's own nested paths give the
    fingerprints that select its mapping, whose name is layout.

    No row is lost: one of no known layout, a null and broken JSON give a row with a null layout, turn, role and text, and one
    of a known layout that has no turns a row with null turn, role and text.
    """
    own = rows.select(F.col(id_col).alias("conv_id"), F.col(json_col).cast("string").alias("json"))
    own = own.withColumn("paths", _paths_of(F.col("json")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    for name, (needs, sql) in reversed(MAPPINGS.items()):
        if sql == "rows":
            continue
        nested = ", ".join(f"`{p.split('.')[1]}`: string" for p in needs if "[]" in p)
        kinds = ", ".join(f"{k} array<struct<{nested}>>" if nested else f"{k} string" for k in dict.fromkeys(p.split("[")[0] for p in needs))
        met = F.array_sort(F.array_intersect("paths", F.array(*map(F.lit, needs))))
        fits = F.substr(F.sha2(F.concat_ws("\n", met), 256), F.lit(1), F.lit(16)) == _MARKS[name]
        own = own.withColumn(f"m_{name}", F.when(fits, F.from_json("json", kinds)))
        layout = F.when(F.col(f"m_{name}").isNotNull(), F.lit(name)).otherwise(layout)
        turns = F.when(F.col(f"m_{name}").isNotNull(), F.expr(sql.replace("$", f"m_{name}."))).otherwise(turns)
    found = own.select("conv_id", layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "t"))
    return found.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", "layout")


def stuffed(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1$2\\$3")


def unstuffed(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def template(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) from canonical turns; loss has the mask's spans, (from, to) in bytes of formatted.

    Turns are ordered by turn, a null first, then by role, then by text, each by their UTF-8 bytes.  A null role or text is
    empty; a null conv_id is a conversation like others.  Each turn is formatted before the shuffle; a conversation is one
    output value, so its turns do meet in one row, and only they.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = role == "assistant"
    own = F.when(said, F.concat(stuffed(text), F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), F.url_encode(role), F.lit("\n"), stuffed(text), F.lit("[/INST]")))
    rows = turns.select("conv_id", F.col("turn"), role.alias("role"), text.alias("text"), own.alias("own"), said.alias("said"))
    rows = rows.select("conv_id", F.struct("turn", "role", "text", "own", F.octet_length("own").alias("size"), F.when(F.col("said"), F.octet_length("own") - 4).alias("under")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def step(s: Column, t: Column) -> Column:
        span = F.struct(s["at"].alias("from"), (s["at"] + t["under"]).alias("to"))
        return F.struct((s["at"] + t["size"]).alias("at"), F.when(t["under"].isNull(), s["spans"]).otherwise(F.array_append(s["spans"], span)).alias("spans"))

    start = F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<from: int, to: int>>").alias("spans"))
    return grouped.select(
        "conv_id", F.concat(F.lit("<s>"), F.array_join(F.transform("ts", lambda t: t["own"]), "")).alias("formatted"),
        F.aggregate("ts", start, step, lambda s: s["spans"]).alias("loss"),
    )


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation; the last sign of a control string ends a turn."""
    marks = F.filter(F.split(F.substr(formatted, F.lit(4)), r"(?<=\[/INST\])|(?<=</s>)"), lambda x: x != "")
    def turn(x: Column) -> Column:
        other = x.startswith("[INST]")
        inner = F.substr(x, F.lit(7), F.length(x) - 13)
        line = F.instr(inner, "\n")
        role = F.when(other, F.url_decode(F.substr(inner, F.lit(1), line - 1))).otherwise("assistant")
        text = F.when(other, F.substr(inner, line + 1)).otherwise(F.substr(x, F.lit(1), F.length(x) - 4))
        return F.struct(role.alias("role"), unstuffed(text).alias("text"))
    return F.transform(marks, turn)


def under_loss(formatted: Column, loss: Column) -> Column:
    """array<string>: what the mask's spans cover, each unstuffed on its own."""
    cut = lambda data: F.transform(loss, lambda s: unstuffed(F.substr(data, s["from"] + 1, s["to"] - s["from"]).cast("string")))
    return F.transform(F.array(formatted.cast("binary")), cut)[0]  # the bytes are made once, not for every span


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from what template() returns:
    the turns from the text, the loss columns from what lies under the mask."""
    turns = formatted.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parsed(F.col("formatted")).alias("ts"),
        F.array_join(under_loss(F.col("formatted"), F.col("loss")), "").alias("under"),
    )
    said = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), "formatted_chars",
    )
