"""Chat formatting: a schema fingerprint picks the mapping to canonical turns, a template marks the turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import free_name, let

TURN = "struct<role:string,text:string>"
#: role -> what stands before and after a text; other roles are named inside TURN marks.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[TURN] ", " [/TURN]")
#: A control string is one of < and [ and then one of these.  A text gets a backslash between the two parts, behind any that
#: it has there itself, so no control string is left in it and taking one backslash away gives the text back.
_TAIL = r"(/?s>|/?(?:INST|SYS|TURN)\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


#: A role stands on the first line of a turn, so what could end the line or begin a control string is written as two signs.
_ROLE_SIGNS = (("\\", "\\s"), ("\n", "\\n"), ("[", "\\b"), ("<", "\\l"))


def escape_role(role: Column) -> Column:
    for sign, two in _ROLE_SIGNS:
        role = F.replace(role, F.lit(sign), F.lit(two))
    return role


def unescape_role(role: Column) -> Column:
    for sign, two in reversed(_ROLE_SIGNS):
        role = F.replace(role, F.lit(two), F.lit(sign))
    return role


# --- layouts ---------------------------------------------------------------------------------------------------------


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Sorted nested field paths of a type; [] stands for the items of an array."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else F.coalesce(role, F.lit(""))).cast("string").alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


class Typed:
    """Fields of a frame's columns."""

    @staticmethod
    def field(name: str) -> Column:
        return F.col(f"`{name}`")

    @staticmethod
    def items(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`"), F.array())

    @staticmethod
    def of(item: Column, name: str) -> Column:
        return item[name]

    @staticmethod
    def joined(item: Column, name: str, part: str) -> Column:
        return F.array_join(F.transform(item[name], lambda x: x[part]), "")


class Json:
    """Fields of a parsed JSON record (variant)."""

    def __init__(self, record: Column):
        self.record = record

    def field(self, name: str) -> Column:
        return F.try_variant_get(self.record, f"$.{name}", "string")

    def items(self, name: str) -> Column:
        return F.coalesce(F.try_variant_get(self.record, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))

    @staticmethod
    def of(item: Column, name: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", "string")

    @staticmethod
    def joined(item: Column, name: str, part: str) -> Column:
        parts = F.coalesce(F.try_variant_get(item, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        return F.array_join(F.transform(parts, lambda x: F.try_variant_get(x, f"$.{part}", "string")), "")


Mapping = Callable[[Typed | Json], Column]


def _items(name: str, role: str, text: str, roles: dict[str, str] | None = None, part: str | None = None) -> Mapping:
    def turns(at: Typed | Json) -> Column:
        def of(item: Column) -> Column:
            found = at.of(item, role)
            for old, new in (roles or {}).items():
                found = F.when(at.of(item, role) == old, F.lit(new)).otherwise(found)
            return _turn(found, at.joined(item, text, part) if part else at.of(item, text))

        return F.transform(at.items(name), of)

    return turns


def _fixed(*turns: tuple[str, str]) -> Mapping:
    return lambda at: F.array(*[_turn(role, at.field(name)) for role, name in turns])


def _instruction(at: Typed | Json) -> Column:
    asked = F.concat_ws("\n\n", at.field("instruction"), F.when(F.length(at.field("input")) > 0, at.field("input")))
    return F.array(_turn("user", asked), _turn("assistant", at.field("output")))


_SHARE = {"human": "user", "gpt": "assistant"}
#: Field paths of a record that has all its turns, and the mapping to these.
LAYOUTS: tuple[tuple[tuple[str, ...], Mapping], ...] = (
    (("messages[].content[].text", "messages[].role"), _items("messages", "role", "content", part="text")),
    (("messages[].content", "messages[].role"), _items("messages", "role", "content")),
    (("messages[].role", "messages[].text"), _items("messages", "role", "text")),
    (("conversations[].from", "conversations[].value"), _items("conversations", "from", "value", _SHARE)),
    (("input", "instruction", "output"), _instruction),
    (("completion", "prompt"), _fixed(("user", "prompt"), ("assistant", "completion"))),
    (("prompt", "response"), _fixed(("user", "prompt"), ("assistant", "response"))),
    (("answer", "question"), _fixed(("user", "question"), ("assistant", "answer"))),
    (("instruction", "output"), _fixed(("user", "instruction"), ("assistant", "output"))),
)
#: Fingerprint to mapping; a layout is looked up by the hash of those of its paths that a record or a frame has.
BY_FINGERPRINT = {fingerprint(paths): mapping for paths, mapping in LAYOUTS}
TURN_PATHS = ("role", "text", "turn")
TURN_ROWS = fingerprint(TURN_PATHS)


def json_paths(record: Column) -> Column:
    """Which of the layouts' nested field paths a parsed JSON record has, sorted; of an array all items count, at any depth."""

    def has(value: Column, path: str) -> Column:
        name, _, rest = path.partition("[]")
        if not rest:
            # A path that ends here holds a text; lists and objects have paths of their own.
            kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
            return kind.isNotNull() & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT")
        items = F.try_variant_get(value, f"$.{name}", "array<variant>")
        return F.coalesce(F.exists(items, lambda x: has(x, rest[1:])), F.lit(False))

    known = sorted({p for paths, _ in LAYOUTS for p in paths})
    return F.filter(F.array(*[F.when(F.coalesce(has(record, p), F.lit(False)), F.lit(p)) for p in known]), lambda x: x.isNotNull())


def turns_of_json(record: Column) -> Column:
    """Canonical turns of JSON records of mixed layouts by fingerprint; fields that a layout doesn't need are ignored.

    A record whose list of messages is empty has no turns; null where no layout's paths are all there, and for broken JSON.
    """

    def chosen(parsed: Column) -> Column:
        at = Json(parsed)

        def by_paths(found: Column) -> Column:
            out = F.lit(None).cast(f"array<{TURN}>")
            lists = sorted({p.partition("[]")[0] for paths, _ in LAYOUTS for p in paths if "[]" in p})
            for name in lists:
                items = F.try_variant_get(parsed, f"$.{name}", "array<variant>")
                out = F.when(F.size(items) == 0, F.array().cast(f"array<{TURN}>")).otherwise(out)
            for paths, mapping in reversed(LAYOUTS):
                mark = F.sha2(F.array_join(F.array_intersect(found, F.array(*map(F.lit, sorted(paths)))), "\n"), 256)
                out = F.when(mark == fingerprint(paths), mapping(at)).otherwise(out)
            return out

        return let(json_paths(parsed), by_paths)

    return let(F.try_parse_json(record), chosen)


def canonical(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) by the layout whose fingerprint the frame's field paths have: rows by turn, typed records, or a JSON column named record.

    Columns besides the layout's and the key are ignored.  Rows by turn are ordered by turn, then role and text, and repeated
    rows stay repeated turns; null roles and texts are empty, and rows without a key make one conversation of their own.  A
    JSON record that fits no layout keeps its row with null turns; an empty table gives an empty table.  The turns of one
    conversation meet in one row, which is what the result is.
    """
    every = set(field_paths(records.schema))
    fits = lambda paths: fingerprint(every & set(paths))
    if fits(TURN_PATHS) == TURN_ROWS and key in records.columns:
        rows = records.select(key, F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
        grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("t"))
        return grouped.select(key, F.transform("t", lambda t: _turn(t["role"], t["text"])).alias("turns"))
    if "record" in every and isinstance(records.schema["record"].dataType, T.StringType):
        return records.select(key, turns_of_json(F.col("record")).alias("turns"))
    for paths, _ in LAYOUTS:
        if (mapping := BY_FINGERPRINT[fingerprint(paths)]) and fits(paths) == fingerprint(paths):
            return records.select(key, mapping(Typed).alias("turns"))
    raise ValueError(f"no layout has the fields {sorted(every)}")


# --- template --------------------------------------------------------------------------------------------------------


def _marked(turn: Column) -> Column:
    """Before, escaped text and after of a turn."""
    before, after = F.concat(F.lit(OTHER[0]), escape_role(turn["role"]), F.lit("\n")), F.lit(OTHER[1])
    for role, (a, b) in MARKS.items():
        before = F.when(turn["role"] == role, F.lit(a)).otherwise(before)
        after = F.when(turn["role"] == role, F.lit(b)).otherwise(after)
    return F.struct(before.alias("before"), escape(turn["text"]).alias("text"), after.alias("after"), (turn["role"] == "assistant").alias("learn"))


#: Turns whose starts are found by one running sum; the sums of these runs are summed before.
RUN = 256


def loss_spans(parts: Column) -> Column:
    """(start, length) of the learned texts among marked turns: the running sum in runs, so a long conversation isn't copied turn by turn."""
    size = lambda p: (F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])).cast("long")
    spans = "array<struct<start:bigint,length:bigint>>"

    def step(s: Column, p: Column) -> Column:
        span = F.struct((s["at"] + F.length(p["before"])).alias("start"), F.length(p["text"]).cast("long").alias("length"))
        return F.struct((s["at"] + size(p)).alias("at"), F.when(p["learn"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    def placed(runs: Column) -> Column:
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, p: a + size(p)))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
        starts = F.aggregate(sums, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["all"], s["at"]).alias("all")))["all"]
        of_run = lambda r, at: F.aggregate(r, F.struct(at.alias("at"), F.array().cast(spans).alias("spans")), step)["spans"]
        return F.flatten(F.zip_with(runs, starts, of_run))

    firsts = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    return let(F.transform(firsts, lambda i: F.slice(parts, i, F.lit(RUN))), placed)


def chat_format(conversations: DataFrame) -> DataFrame:
    """(…, turns) with formatted, the text of all turns, and loss, the (start, length) spans of assistant texts in it, in code points.

    No turns give an empty text without spans; null turns, those of a record that fits no layout, give nulls.  Repeated rows
    stay, other columns don't matter, and columns named formatted or loss are replaced.
    """

    def put(parts: Column) -> Column:
        text = F.concat_ws("", F.flatten(F.transform(parts, lambda p: F.array(p["before"], p["text"], p["after"]))))
        return F.struct(text.alias("formatted"), loss_spans(parts).alias("loss"))

    name = free_name(conversations, "made")
    made = F.when(F.col("turns").isNotNull(), let(F.transform("turns", _marked), put))
    return conversations.withColumn(name, made).withColumn("formatted", F.col(f"{name}.formatted")).withColumn("loss", F.col(f"{name}.loss")).drop(name)


_READ = r"(?s)(?:\[(INST|SYS|TURN)\]|<(s)>) (.*?) (?:\[/(?:INST|SYS|TURN)\]|</s>)"


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    kinds = F.transform(F.regexp_extract_all(formatted, F.lit(_READ), F.lit(0)), lambda x: F.regexp_extract(x, r"^[<\[](INST|SYS|TURN|s)[>\]]", 1))
    texts = F.regexp_extract_all(formatted, F.lit(_READ), F.lit(3))

    def turn(kind: Column, text: Column) -> Column:
        named = kind == "TURN"
        role = F.when(kind == "INST", "user").when(kind == "s", "assistant").when(kind == "SYS", "system").otherwise(unescape_role(F.substring_index(text, "\n", 1)))
        body = F.when(named, F.expr("null").cast("string")).otherwise(text)
        return F.struct(role.alias("role"), unescape(F.coalesce(body, F.regexp_replace(text, r"^[^\n]*\n", ""))).alias("text"))

    return F.zip_with(kinds, texts, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))
