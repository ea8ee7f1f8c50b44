"""Chat formatting by schema fingerprints, with DataFrame and SQL functions only.

A record is JSON text of any layout. Its fingerprint is the hash of its nested fields, to
any depth, as schema_of_variant writes them (scalar types left out, elements of an array
taken together); string values that hold JSON are strings. A registry maps fingerprints to
declarative mappings: for each turn of the layout, the role (a constant or a path, with the
names that the layout has for roles) and the paths of the text, read from the record or
from each element of an array. Every record thus becomes canonical turns (role, text).

Turns are written as `### role: text</turn>` and a newline. Within roles and texts the
characters \\ # < and : (roles only) are written as \\b \\h \\l and \\c, so no marker can
occur in them, and every text can be read back as it was.

Defined results: a null text counts as empty, a null role as "user"; empty texts are
turns as any other; roles that a layout has no other name for stay as they are; records
that are no JSON, or whose layout has no mapping, give no turns, `layout` is null for them
and n_unmapped counts them; ties of turn are ordered by what is written for them;
repeated rows are turns of their own; an empty table gives an empty table; columns
other than those named are dropped. A formatted conversation is one value, so a
conversation has to fit a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: What is written for each character that could be part of a marker.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: Names that the layout `conversations` has for the roles.
SPEAKERS = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: Scalars in what schema_of_variant writes.
SCALAR = r"(?<=: |ARRAY<|^)(?!OBJECT<|ARRAY<)[A-Z_]+(?:\([0-9, ]+\))?(?=[,>]|$)"


@dataclass(frozen=True)
class Turn:
    """One turn of a layout. role: a constant, or a path after `$.`, with the layout's names of roles; texts: paths that are joined by blank lines where not empty."""

    role: str
    texts: tuple[str, ...]
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    """turns of the record itself, or, with each, of every element of the array at that path. optional: paths that may be missing."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[Turn, ...]
    each: str | None = None
    optional: tuple[str, ...] = ()


LAYOUTS = (
    Layout("message", ("role", "text"), (Turn("$.role", ("$.text",)),)),
    Layout("prompt_completion", ("prompt", "completion"), (Turn("user", ("$.prompt",)), Turn("assistant", ("$.completion",)))),
    Layout("prompt_response", ("prompt", "response"), (Turn("user", ("$.prompt",)), Turn("assistant", ("$.response",)))),
    Layout("question_answer", ("question", "answer"), (Turn("user", ("$.question",)), Turn("assistant", ("$.answer",)))),
    Layout("instruction", ("instruction", "output"), (Turn("user", ("$.instruction", "$.input")), Turn("assistant", ("$.output",))), optional=("input",)),
    Layout("messages", ("messages", "messages[].role", "messages[].content"), (Turn("$.role", ("$.content",)),), each="$.messages"),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"), (Turn("$.from", ("$.value",), SPEAKERS),), each="$.conversations"),
    Layout("nested_messages", ("data", "data.messages", "data.messages[].role", "data.messages[].content"), (Turn("$.role", ("$.content",)),), each="$.data.messages"),
    Layout("turn_pairs", ("turns", "turns[].user", "turns[].assistant"), (Turn("user", ("$.user",)), Turn("assistant", ("$.assistant",))), each="$.turns"),
)


def field_schema(value: Column) -> Column:
    """The nested fields of a variant as text, to any depth: OBJECT<a: _, b: ARRAY<OBJECT<c: _>>>."""
    return F.regexp_replace(F.schema_of_variant(value), SCALAR, "_")


def schema_of(paths: tuple[str, ...]) -> str:
    """What field_schema gives for an object with these paths (array elements as [])."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.split("."):
            at = at.setdefault(step.removesuffix("[]"), {})
            if step.endswith("[]"):
                at = at.setdefault("[]", {})

    def text(node: dict) -> str:
        if not node:
            return "_"
        if "[]" in node:
            return f"ARRAY<{text(node['[]'])}>"
        return "OBJECT<" + ", ".join(f"{k}: {text(v)}" for k, v in sorted(node.items())) + ">"

    return text(tree)


def fingerprint(schema: Column) -> Column:
    return F.xxhash64(schema)


def fingerprints_of(layout: Layout) -> list[Column]:
    """Hashes of the layout's fields, with and without each optional one."""
    found = [layout.paths]
    for path in layout.optional:
        found += [(*p, path) for p in found]
    return [fingerprint(F.lit(schema_of(p))) for p in found]


def escaped(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    for plain, written in escapes:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    for plain, written in reversed(escapes):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def canonical_role(role: Column, names: tuple[tuple[str, str], ...]) -> Column:
    role = F.coalesce(role, F.lit("user"))
    for given, canonical in names:
        role = F.when(role == given, canonical).otherwise(role)
    return role


def layout_of(print_: Column, layouts: tuple[Layout, ...]) -> Column:
    """Name of the layout with this fingerprint; null if there is none."""
    names = F.create_map(*[x for layout in layouts for p in fingerprints_of(layout) for x in (p, F.lit(layout.name))])
    return names[print_]


def turns_of(value: Column, name: Column, layouts: tuple[Layout, ...]) -> Column:
    """turns array<struct<role,text>> of a variant with the layout of that name; none without a layout."""

    def read(turn: Turn, at: Column) -> Column:
        role = canonical_role(F.try_variant_get(at, turn.role, "string"), turn.names) if turn.role.startswith("$") else F.lit(turn.role)
        parts = [F.coalesce(F.try_variant_get(at, p, "string"), F.lit("")) for p in turn.texts]
        text = parts[0]
        for more in parts[1:]:
            text = F.when(more == "", text).otherwise(F.concat(text, F.lit("\n\n"), more))
        return F.struct(role.alias("role"), text.alias("text"))

    def all_turns(layout: Layout, at: Column) -> Column:
        return F.array(*[read(t, at) for t in layout.turns])

    def made(layout: Layout) -> Column:
        if not layout.each:
            return all_turns(layout, value)
        return F.flatten(F.transform(F.try_variant_get(value, layout.each, "array<variant>"), lambda e: all_turns(layout, e)))

    turns = F.array().cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        turns = F.when(name == layout.name, made(layout)).otherwise(turns)
    return turns


def canonical_turns(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[Column, Column]:
    """(name of the layout, turns array<struct<role,text>>) of a JSON record, by its fingerprint."""
    value = F.try_parse_json(record)
    name = layout_of(fingerprint(field_schema(value)), layouts)
    return name, turns_of(value, name, layouts)


def format_chat(records: DataFrame, key: str, order: list[str], record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """key, n_records, n_unmapped and formatted: the turns of all records of a key, in order, as one text with escaped roles and texts."""
    at = F.struct(*order)
    parsed = records.select(F.col(key).alias("key"), at.alias("at"), F.try_parse_json(record).alias("value"))
    named = parsed.select("key", "at", "value", layout_of(fingerprint(field_schema(F.col("value"))), layouts).alias("layout"))
    canonical = named.select("key", "at", "layout", turns_of(F.col("value"), F.col("layout"), layouts).alias("turns"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped(t["role"], ROLE_ESCAPES), F.lit(MIDDLE), escaped(t["text"], ESCAPES), F.lit(CLOSE))), "")
    parts = canonical.select("key", "layout", F.struct("at", written.alias("written")).alias("part"))
    gathered = parts.groupBy("key").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.count_if(F.col("layout").isNull()).alias("n_unmapped"))
    return gathered.select(F.col("key").alias(key), F.size("parts").cast("long").alias("n_records"), "n_unmapped", F.array_join(F.transform("parts", lambda p: p["written"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted text, unescaped."""
    bodies = F.filter(F.split(formatted, F.lit("</turn>\n")), lambda b: b != "")

    def turn(body: Column) -> Column:
        at = F.instr(body, MIDDLE)
        role = F.substring(body, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))
        text = F.substring(body, at + F.lit(len(MIDDLE)), F.length(body))
        return F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(text, ESCAPES).alias("text"))

    return F.transform(bodies, turn)


def loss_texts(turns: Column) -> Column:
    """Texts under the loss mask: those of the assistant, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])


def row_records(rows: DataFrame) -> DataFrame:
    """conv_id, turn and record: each row (role, text) as JSON; by its conversation's id, of the layout `message`, `messages` or `nested_messages`."""
    role, text = F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))
    messages = F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages")
    kind = F.pmod(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)), F.lit(3))
    record = F.when(kind == 0, F.to_json(F.struct(role.alias("role"), text.alias("text")))).when(kind == 1, F.to_json(F.struct(messages))).otherwise(F.to_json(F.struct(F.struct(messages).alias("data"))))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), record.alias("record"))


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    turns = read_back(F.col("formatted"))
    rows = formatted.select(key, turns.alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(loss_texts(F.col("turns")), "")
    return rows.select(key, F.size("turns").cast("long").alias("n_turns"), F.sha2(all_text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
