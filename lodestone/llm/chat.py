"""Conversations of mixed layouts as one chat template, by DataFrame functions only.

A record is a row whose columns hold a conversation in one of several layouts: message lists,
question and answer fields, instructions. The nested field paths that a record fills
(`messages[].role`, `system`) are hashed; the hash selects a declarative mapping of `LAYOUTS`
(every mapping is entered under each set of paths it can have), which yields canonical turns.
A record whose paths no mapping has is kept with null `layout`, and its hash tells which paths.
Columns that no mapping names do not count, nor do columns of another type than the mapping's.

The template marks turns by `OPEN` and `CLOSE`. Control strings of common templates inside texts
get a backslash behind their first character (one more, where backslashes stand there), which
`unescape` takes away again; no control string is left in between. Roles are escaped by percent
signs, as a line feed ends them. The loss mask is an array of spans of the formatted text (code
points, end exclusive), one for each assistant turn.

Cases: null texts and roles count as empty; turns are ordered by number (null last), role and
text, repeated rows count each; rows without an id are conversations of one turn; no turns give
an empty text. A conversation is one row, as its output is one text: it must fit one value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.binding import let
from lodestone.llm.pii import _starts
from lodestone.llm.tables import read

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Control strings of public chat templates, as first character and rest.
CONTROL = r"(<)(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|(?:start|end)_of_turn>)|(\[)(\\*)(/?INST\]|/?SYSTEM_PROMPT\]|/?AVAILABLE_TOOLS\])"
ESCAPED = CONTROL.replace(r"(\\*)", r"\\(\\*)")
TURNS = "array<struct<role:string,text:string>>"
#: Spans cut from one block of the text.
BLOCK = 64


# --- layouts ------------------------------------------------------------------------
@dataclass(frozen=True)
class Field:
    """One turn from a text field."""

    role: str
    path: str


@dataclass(frozen=True)
class Each:
    """One turn from each element of a list."""

    path: str
    role: str
    text: str


@dataclass(frozen=True)
class Joined:
    """One turn from several text fields, those that are there, with an empty line between."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Layout:
    """*required* paths are always filled, *optional* ones may be; *aliases* rename roles."""

    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Field | Each | Joined, ...]
    aliases: dict[str, str] = field(default_factory=dict)

    def path_sets(self) -> Iterable[tuple[str, ...]]:
        for count in range(len(self.optional) + 1):
            for some in combinations(self.optional, count):
                yield (*self.required, *some)


SYSTEM = Field("system", "system")
LAYOUTS = {
    "messages": Layout(
        ("messages[]",), ("messages[].role", "messages[].content", "system"), (SYSTEM, Each("messages", "role", "content"))
    ),
    "conversations": Layout(
        ("conversations[]",),
        ("conversations[].from", "conversations[].value", "system"),
        (SYSTEM, Each("conversations", "from", "value")),
        {"human": "user", "gpt": ASSISTANT},
    ),
    "prompt_response": Layout(("prompt", "response"), ("system",), (SYSTEM, Field("user", "prompt"), Field(ASSISTANT, "response"))),
    "prompt_completion": Layout(("prompt", "completion"), ("system",), (SYSTEM, Field("user", "prompt"), Field(ASSISTANT, "completion"))),
    "question_answer": Layout(("question", "answer"), ("system",), (SYSTEM, Field("user", "question"), Field(ASSISTANT, "answer"))),
    "instruction": Layout(
        ("instruction", "output"), ("input", "system"), (SYSTEM, Joined("user", ("instruction", "input")), Field(ASSISTANT, "output"))
    ),
}


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _type_of(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def _column(path: str) -> Column:
    names = path.split(".")
    found = F.col(f"`{names[0]}`")
    for name in names[1:]:
        found = found.getField(name)
    return found


def _filled(schema: T.StructType, path: str) -> Column | None:
    """Whether a record fills *path*; None if its column cannot."""
    outer, is_list, inner = path.partition("[]")
    kind = _type_of(schema, outer)
    if not is_list:
        return _column(outer).isNotNull() if isinstance(kind, T.StringType) else None
    if not isinstance(kind, T.ArrayType):
        return None
    if not inner:
        return _column(outer).isNotNull()
    name = inner[1:]
    if not isinstance(kind.elementType, T.StructType) or not isinstance(_type_of(kind.elementType, name), T.StringType):
        return None
    return F.coalesce(F.exists(_column(outer), lambda e: e.getField(name).isNotNull()), F.lit(False))


def paths_hash(records: DataFrame, layouts: dict[str, Layout] = LAYOUTS) -> Column:
    """The hash of the paths, of those any layout names, that a record fills."""
    known = sorted({p for layout in layouts.values() for some in layout.path_sets() for p in some})
    named = [(p, _filled(records.schema, p)) for p in known]
    return F.sha2(F.concat_ws("\n", *[F.when(test, F.lit(p)) for p, test in named if test is not None], F.lit(None).cast("string")), 256)


def _turns(schema: T.StructType, layout: Layout) -> Column:
    def text_of(value):
        return F.coalesce(value, F.lit(""))

    def role_of(value):
        for old, new in layout.aliases.items():
            value = F.when(value == old, new).otherwise(value)
        return text_of(value)

    def turn(role, text):
        return F.struct(role.alias("role"), text.alias("text"))

    def there(path):
        return isinstance(_type_of(schema, path), T.StringType)

    def part(name, element, kind):
        return element.getField(name) if isinstance(_type_of(kind, name), T.StringType) else F.lit(None).cast("string")

    def each(step, kind):
        return F.transform(_column(step.path), lambda e: turn(role_of(part(step.role, e, kind)), text_of(part(step.text, e, kind))))

    parts = []
    for step in layout.turns:
        if isinstance(step, Field):
            if there(step.path):
                one = F.array(turn(F.lit(step.role), _column(step.path)))
                parts.append(F.when(_column(step.path).isNotNull(), one).otherwise(F.array().cast(TURNS)))
        elif isinstance(step, Joined):
            present = [_column(p) for p in step.paths if there(p)]
            parts.append(F.array(turn(F.lit(step.role), F.concat_ws("\n\n", *present))))
        else:
            parts.append(each(step, _type_of(schema, step.path).elementType))
    return F.concat(*[p.cast(TURNS) for p in parts])


def _usable(schema: T.StructType, layout: Layout) -> bool:
    return all(_filled(schema, p) is not None for p in layout.required)


def canonical_turns(records: DataFrame, id_col: str = "conv_id", layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, paths_hash, layout, turns) for every record; layout and turns are null where no mapping fits."""
    usable = {n: x for n, x in layouts.items() if _usable(records.schema, x)}
    names = [pair for n, x in usable.items() for some in x.path_sets() for pair in (F.lit(fingerprint(some)), F.lit(n))]
    chosen = F.get(F.map_values(F.map_filter(F.create_map(*names), lambda k, _: k == F.col("paths_hash"))), F.lit(0)) if names else F.lit(None)
    hashed = records.withColumn("__own_id", _column(id_col)).withColumn("paths_hash", paths_hash(records, layouts))
    mapped = hashed.withColumn("layout", chosen.cast("string"))
    turns = F.lit(None).cast(TURNS)
    for name, layout in usable.items():
        turns = F.when(F.col("layout") == name, _turns(records.schema, layout)).otherwise(turns)
    return mapped.select(F.col("__own_id").alias("conv_id"), "paths_hash", "layout", turns.alias("turns"))


# --- template -----------------------------------------------------------------------
def escape(text: Column) -> Column:
    found = F.regexp_replace(text, CONTROL, r"$1$4\\$2$5$3$6")
    return F.when(F.contains(text, F.lit("<")) | F.contains(text, F.lit("[")), found).otherwise(text)


def unescape(text: Column) -> Column:
    found = F.regexp_replace(text, ESCAPED, "$1$4$2$5$3$6")
    return F.when(F.contains(text, F.lit("\\")), found).otherwise(text)


#: Decoded in this order; the percent sign is encoded first and decoded last.
ROLE_CODES = (("\n", "%0A"), ("<", "%3C"), ("%", "%25"))


def _role_out(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_in(role: Column) -> Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _template(turns: Column) -> Column:
    """struct(formatted, loss) of canonical turns."""
    heads = F.transform(turns, lambda t: F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n")))
    texts = F.transform(turns, lambda t: escape(t["text"]))
    tail = CLOSE + "\n"

    def spanned(parts):
        lengths = F.zip_with(parts["heads"], parts["texts"], lambda h, t: F.char_length(h) + F.char_length(t) + len(tail))

        def span(starts):
            ends = F.zip_with(starts, parts["heads"], lambda s, h: s + F.char_length(h))
            spans = F.zip_with(ends, parts["texts"], lambda s, t: F.struct(s.alias("start"), (s + F.char_length(t)).alias("end")))
            return F.filter(spans, lambda s, i: F.get(parts["roles"], i) == ASSISTANT)

        formatted = F.array_join(F.zip_with(parts["heads"], parts["texts"], lambda h, t: F.concat(h, t, F.lit(tail))), "")
        loss = F.when(F.size(lengths) > 0, let(let(lengths, _starts), span)).otherwise(F.array().cast(SPANS))
        return F.struct(formatted.alias("formatted"), loss.alias("loss"))

    return let(F.struct(heads.alias("heads"), texts.alias("texts"), F.transform(turns, lambda t: t["role"]).alias("roles")), spanned)


SPANS = "array<struct<start:int,end:int>>"


def format_chat(records: DataFrame, id_col: str = "conv_id", layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, paths_hash, layout, n_turns, formatted, loss) for every record."""
    rows = canonical_turns(records, id_col, layouts)
    found = rows.withColumn("__out", _template(F.col("turns")))
    return found.select("conv_id", "paths_hash", "layout", F.size("turns").cast("long").alias("n_turns"), "__out.formatted", "__out.loss")


def read_turns(formatted: Column) -> Column:
    """The canonical turns of a formatted text."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.char_length(p)))

    def turn(body):
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.char_length(role) + 2, F.char_length(body))
        return F.struct(_role_in(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, turn)


def masked_texts(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the spans *loss*. They are cut from blocks, as counting from the start of a long text takes time."""

    def cut(text, span, base):
        return F.substring(text, span["start"] - base + 1, span["end"] - span["start"])

    def block(spans):
        whole = F.struct(F.element_at(spans, 1)["start"].alias("start"), F.element_at(spans, -1)["end"].alias("end"))
        return let(cut(formatted, whole, F.lit(0)), lambda t: F.transform(spans, lambda s: unescape(cut(t, s, F.element_at(spans, 1)["start"]))))

    firsts = F.sequence(F.lit(0), ((F.size(loss) - 1) / BLOCK).cast("int"))
    found = F.flatten(F.transform(firsts, lambda k: let(F.slice(loss, k * BLOCK + 1, F.lit(BLOCK)), block)))
    return F.when(F.size(loss) > 0, found).otherwise(F.array().cast("array<string>"))


# --- query --------------------------------------------------------------------------
PROBE = "</s>[INST] ok [/INST]"


def gathered(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) from one row for each turn; each row without an id is a conversation of its own."""
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in (text_col, role_col))
    turn = F.struct(F.col(turn_col).isNull().alias("last"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    plain = rows.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t"))
    held = plain.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    single = plain.where("conv_id is null").select("conv_id", F.array("t").alias("ts"))
    return held.union(single).select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def mixed_records(conversations: DataFrame) -> DataFrame:
    """Records (conv_id and the columns of four layouts) of conversations (conv_id, turns).

    A question and its answer are `prompt` and `response`; with a system text before, `instruction`
    and `output`; others are `conversations` where the id is odd and all roles are the usual three,
    and `messages` else.
    """
    roles = F.array_join(F.transform("turns", lambda t: t["role"]), "\n")
    usual = F.forall("turns", lambda t: t["role"].isin("system", "user", ASSISTANT))
    layout = (
        F.when(roles == f"user\n{ASSISTANT}", "prompt")
        .when(roles == f"system\nuser\n{ASSISTANT}", "instruction")
        .when(usual & (F.pmod("conv_id", F.lit(2)) == 1), "conversations")
        .otherwise("messages")
    )

    def text(kind, i):
        return F.when(F.col("kind") == kind, F.get("turns", F.lit(i))["text"])

    def listed(role, content, rename):
        return F.transform("turns", lambda t: F.struct(rename(t["role"]).alias(role), t["text"].alias(content)))

    names = LAYOUTS["conversations"].aliases

    def old_name(role):
        for old, new in names.items():
            role = F.when(role == new, old).otherwise(role)
        return role

    return conversations.withColumn("kind", layout).select(
        "conv_id",
        F.when(F.col("kind") == "messages", listed("role", "content", lambda r: r)).alias("messages"),
        F.when(F.col("kind") == "conversations", listed("from", "value", old_name)).alias("conversations"),
        text("prompt", 0).alias("prompt"),
        text("prompt", 1).alias("response"),
        text("instruction", 0).alias("system"),
        text("instruction", 1).alias("instruction"),
        text("instruction", 2).alias("output"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """The digests of the contract, read back from formatted texts and their spans."""
    read_back = formatted.select(
        "conv_id", "layout", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_texts(F.col("formatted"), F.col("loss")).alias("masked")
    ).withColumn("trained", F.array_join("masked", ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PROBE).alias("text"))
    return digests(format_chat(mixed_records(gathered(rows.unionByName(probe)))))


QUERIES = {"op12_chat_formatting": op12_chat_formatting}
ORACLE: dict[str, str] = {}
