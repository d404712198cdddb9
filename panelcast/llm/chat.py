"""Chat formatting: layouts found by schema fingerprints, canonical turns, a reversible template.

A record's fingerprint is the hash of its sorted nested field paths (those that any mapping
knows), and selects a declarative mapping to canonical turns. All of it is column expressions.

Template, per turn: ``### role: text</turn>`` and a line feed. Inside roles and texts a
backslash becomes ``\\0``, ``#`` ``\\1`` and ``<`` ``\\2`` (and ``:`` in a role ``\\3``), so no
text can hold a marker and every escape has one reading. The loss mask is a list of
spans of code points over the escaped assistant texts.

Defined results: null roles and texts are empty; turns of equal number are ordered by role
and text; repeated rows are turns of their own; rows with a null conversation id form one
conversation; a record whose fingerprint is unknown has a null layout and no turns.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import save

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = [("\\", "\\0"), ("#", "\\1"), ("<", "\\2")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\3")]
LEARNED_ROLE = "assistant"
#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths that it needs, those that it may have, and how turns come from them.

    ``turns`` lists (role, path) for records with one field per turn; ``items`` names an
    array and its role and text fields.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None

    def fingerprints(self) -> list[str]:
        return [fingerprint([*self.needs, *extra]) for n in range(len(self.may) + 1) for extra in itertools.combinations(self.may, n)]


MAPPINGS = [
    Mapping("messages", ("messages", "messages[].role", "messages[].content"), ("system",), (("system", "system"),), ("messages", "role", "content")),
    Mapping("from_value", ("conversations", "conversations[].from", "conversations[].value"), ("system",), (("system", "system"),), ("conversations", "from", "value")),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (("system", "system"), ("user", "instruction"), ("user+", "input"), ("assistant", "output"))),
    Mapping("instruction_response", ("instruction", "response"), ("context", "system"), (("system", "system"), ("user", "instruction"), ("user+", "context"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("question", "answer"), ("context",), (("user", "context"), ("user+", "question"), ("assistant", "answer"))),
]
ROW_LAYOUT = ("conv_id", "role", "text", "turn")
KNOWN = sorted({p for m in MAPPINGS for p in (*m.needs, *m.may)})
ARRAYS = sorted({m.items[0] for m in MAPPINGS if m.items})


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def field_paths(schema: T.StructType, below: str = "") -> list[str]:
    """Nested field paths of a schema; an array adds ``[]``."""
    out: list[str] = []
    for field in schema.fields:
        path, kind = below + field.name, field.dataType
        out.append(path)
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        if isinstance(kind, T.StructType):
            out += field_paths(kind, path + ".")
    return out


def _prefixed(keys: Column, prefix: str) -> Column:
    return F.transform(keys, lambda key: F.concat(F.lit(prefix), key))


def record_fingerprint(record: Column) -> Column:
    """The fingerprint of a JSON record, from its keys and the keys of any of its arrays' items."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    for name in ARRAYS:
        items = F.coalesce(F.from_json(F.get_json_object(record, f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
        inner = F.flatten(F.transform(items, lambda item: F.coalesce(F.json_object_keys(item), F.array().cast("array<string>"))))
        keys = F.concat(keys, _prefixed(F.array_distinct(inner), f"{name}[]."))
    known = F.array_intersect(keys, F.array(*map(F.lit, KNOWN)))
    return F.sha2(F.array_join(F.array_sort(known), "\n"), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _record_turns(mapping: Mapping, record: Column) -> Column:
    """Canonical turns of a record of this layout; absent fields make no turn, null ones it needs an empty one.

    A role with ``+`` continues the turn before it on a new line.
    """
    fields: list[tuple[str, Column]] = []
    for role, path in mapping.turns:
        text = F.get_json_object(record, f"$.{path}")
        if path in mapping.needs:
            text = F.coalesce(text, F.lit(""))
        if role.endswith("+"):
            before_role, before = fields.pop()
            fields.append((before_role, F.when(before.isNull() & text.isNull(), None).otherwise(F.concat_ws("\n", before, F.when(text != "", text)))))
        else:
            fields.append((role, text))
    turns = F.array(*(_turn(F.lit(role), text) for role, text in fields)) if fields else F.array().cast("array<struct<role: string, text: string>>")
    turns = F.filter(turns, lambda t: t["text"].isNotNull())
    if mapping.items:
        name, role, text = mapping.items
        items = F.from_json(F.get_json_object(record, f"$.{name}"), f"array<struct<`{role}`: string, `{text}`: string>>")
        rest = F.transform(F.coalesce(items, F.array().cast(f"array<struct<`{role}`: string, `{text}`: string>>")), lambda t: _turn(t[role], t[text]))
        turns = F.concat(turns, rest)
    return turns


def _layouts() -> Column:
    """Map from fingerprints to names of mappings."""
    names = {print_: m.name for m in reversed(MAPPINGS) for print_ in m.fingerprints()}
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))


def turns_of_records(rows: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """``conv_id, layout, turn, role, text`` of JSON records of mixed layouts.

    A record of unknown layout gives one row with null layout and turn.
    """
    return _record_rows(rows, record, conv_id).drop("record")


def _record_rows(rows: DataFrame, record: str, conv_id: str) -> DataFrame:
    table = _layouts()
    found = rows.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record")).withColumn("layout", table[record_fingerprint(F.col("record"))])
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for mapping in MAPPINGS:
        turns = F.when(F.col("layout") == mapping.name, _record_turns(mapping, F.col("record"))).otherwise(turns)
    out = found.select("conv_id", "layout", "record", F.posexplode_outer(turns).alias("turn", "item"))
    other = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    role = F.lower(F.trim(F.col("item.role")))
    return out.select("conv_id", "layout", "record", F.col("turn").cast("long").alias("turn"), F.coalesce(other[role], role).alias("role"), F.col("item.text").alias("text"))


def canonical_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of a table, by the fingerprint of its schema.

    A table of one turn per row keeps its roles as they are; any other layout goes through its
    records. Columns that no mapping knows are ignored. A record of unknown layout, or without any
    turn, is kept as one turn of role ``unknown`` whose text is the record as JSON.
    """
    paths = field_paths(rows.schema)
    if fingerprint([p for p in paths if p in ROW_LAYOUT]) == fingerprint(list(ROW_LAYOUT)):
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    tops = [c for c in rows.columns if c in {p.partition("[")[0].partition(".")[0] for p in KNOWN}] or [c for c in rows.columns if c != "conv_id"]
    # A table of several layouts leaves the fields of the others null; a null field of the only layout belongs to it.
    short, full = F.to_json(F.struct(*tops)), F.to_json(F.struct(*tops), {"ignoreNullFields": "false"})
    records = rows.select("conv_id", F.when(_layouts()[record_fingerprint(short)].isNotNull(), short).otherwise(full).alias("record"))
    found, lost = _record_rows(records, "record", "conv_id"), F.col("turn").isNull()
    return found.select(
        "conv_id", F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), F.when(lost, "unknown").otherwise(F.col("role")).alias("role"),
        F.when(lost, F.col("record")).otherwise(F.col("text")).alias("text"),
    )


def escape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of every conversation.

    Texts are formatted per row and shuffled once. A conversation becomes one row, as asked
    for; nothing else is gathered.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role, ROLE_ESCAPES), F.lit(COLON))
    rows = turns.select("conv_id", "turn", role.alias("role"), head.alias("head"), escape(text).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(CLOSE)
    placed = rows.withColumn("at", F.coalesce(F.sum(size).over(order), F.lit(0)))
    start = F.col("at") + F.length("head")
    span = F.when(F.col("role") == LEARNED_ROLE, F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    piece = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("piece"))
    both = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return both.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_spans")


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as ``array<struct<role, text>>``."""
    pieces = F.split(formatted, CLOSE)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        colon = F.instr(piece, COLON)
        role = F.substring(piece, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substring(piece, colon + len(COLON), F.length(piece))).alias("text"))

    return F.transform(whole, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what ``format_turns`` wrote."""
    rows = formatted.select("conv_id", parse_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def formatted_conversations(rows: DataFrame) -> DataFrame:
    """The formatted table, written to the shared folder."""
    return save(format_turns(canonical_turns(rows)))
