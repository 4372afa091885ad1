"""Markdown files with YAML front matter -> validated documents and issues."""

from __future__ import annotations

import datetime
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from lodestone import constants as k
from lodestone.functions import digests
from lodestone.functions import text as t
from lodestone.functions.binding import let
from lodestone.session import stage

try:
    import yaml
except ImportError:  # only parse_metadata needs it
    yaml = None


def included(source_path: Column) -> Column:
    """No part hidden, underscored or a backup; no readme; Markdown only."""
    parts = F.split(source_path, "/")
    odd = F.exists(
        parts, lambda p: p.startswith(".") | p.startswith("_") | p.endswith("~")
    )
    name = F.element_at(parts, -1)
    readme = F.lower(F.regexp_replace(name, r"\.md\z", "")) == "readme"
    return name.endswith(".md") & ~odd & ~readme


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """source_path (relative to *root*), content (bytes). A missing root is an error."""
    base = root.rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.md")
        .load(base)
    )
    marker = base.split(":", 1)[-1].lstrip("/") + "/"
    at = F.instr("path", marker)
    relative = F.substring("path", at + len(marker), F.length("path"))
    return files.select(relative.alias("source_path"), "content").filter(included(F.col("source_path")))


# --- stages ---------------------------------------------------------------------
def decode_text(files: DataFrame) -> DataFrame:
    """Adds *text*: strict UTF-8, normalised; null where the bytes are not UTF-8."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.withColumn("text", t.normalize_text(text))


def split_frontmatter(text: Column) -> Column:
    """Struct opened, closed, block, body. The first line must be `---`.

    The closing mark is found by a pattern, so the text is not cut into lines.
    """
    mark = r"[^\S\n]*(?:\n|\z)"
    whole = r"(?sU)\A---" + mark + r"(.*?)(?:(?<=\n)---" + mark + r")(.*)\z"
    opened = text.rlike(r"(?U)\A---" + mark)
    closed = opened & text.rlike(whole)
    block = F.regexp_replace(F.regexp_extract(text, whole, 1), r"\n\z", "")
    return F.struct(
        opened.alias("opened"),
        closed.alias("closed"),
        F.when(closed, block).alias("block"),
        F.when(closed, F.regexp_extract(text, whole, 2)).alias("body"),
    )


FIELD = StructType(
    [
        StructField("type", StringType()),
        StructField("value", StringType()),
        StructField("odd_items", ArrayType(IntegerType())),
    ]
)
#: What a block turned out to be, with the details its issue needs.
BLOCK = StructType(
    [
        StructField("kind", StringType()),
        StructField("detail", StringType()),
        StructField("fields", MapType(StringType(), FIELD)),
        StructField("odd_keys", ArrayType(StringType())),
    ]
)


def _strict_loader():
    class StrictLoader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        """Refuses a key that appears twice."""

    def mapping(loader, node):
        own = [key for key, _ in node.value if key.tag != "tag:yaml.org,2002:merge"]
        names = [loader.construct_object(key, deep=True) for key in own]
        twice = next((name for n, name in enumerate(names) if name in names[:n]), None)
        if twice is not None:
            raise KeyError(str(twice))
        loader.flatten_mapping(node)
        return {loader.construct_object(k, deep=True): loader.construct_object(v, deep=True) for k, v in node.value}

    StrictLoader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return StrictLoader


def _field(value) -> dict:
    odd = None
    if isinstance(value, str):
        kind, text = "str", value
    elif isinstance(value, (datetime.date, datetime.datetime)):
        kind, text = type(value).__name__, value.isoformat()
    else:
        kind, text = type(value).__name__, json.dumps(value, default=str, ensure_ascii=False)
    if isinstance(value, list):
        odd = [n for n, item in enumerate(value) if not isinstance(item, str)]
    return {"type": kind, "value": text, "odd_items": odd}


def _read_block(block: str | None, loader) -> tuple:
    """(kind, detail, fields, odd keys); nothing that a block holds raises."""
    if block is None:
        return "absent", None, None, None
    try:
        value = yaml.load(block, Loader=loader)
    except KeyError as twice:
        return "repeated", twice.args[0], None, None
    except (yaml.YAMLError, TypeError, ValueError, RecursionError) as fault:
        return "broken", str(fault), None, None
    if isinstance(value, dict):
        named = {key: _field(item) for key, item in value.items() if isinstance(key, str)}
        return "mapping", None, named, sorted(str(key) for key in value if key not in named)
    return ("empty" if value is None else "other"), type(value).__name__, None, None


@F.pandas_udf(BLOCK)
def _blocks(blocks: pd.Series) -> pd.DataFrame:
    loader = _strict_loader()
    return pd.DataFrame([_read_block(block, loader) for block in blocks], columns=BLOCK.fieldNames())


# Filters on issues must not be pushed below the parse: they would copy the parse and
# all rules into the filter. An opaque function keeps the plan to one evaluation.
_blocks = _blocks.asNondeterministic()

# The messages of block issues.
BLOCK_MESSAGES = {
    "repeated": "Frontmatter declares the same field twice.",
    "broken": "Frontmatter is not valid YAML.",
    "empty": "Frontmatter block is empty.",
    "other": "Frontmatter must be a mapping of fields.",
}
ODD_KEYS_MESSAGE = "Frontmatter field names must be strings."


def parse_metadata(block: Column) -> Column:
    """A front matter block -> struct of typed fields, or of what is wrong with the block."""

    def outcome(read: Column) -> Column:
        odd = F.size(read["odd_keys"]) > 0
        flat = F.trim(F.regexp_replace(read["detail"], r"(?U)\s+", " "))
        message = F.when(odd, ODD_KEYS_MESSAGE)
        for kind, text in BLOCK_MESSAGES.items():
            message = message.when(read["kind"] == kind, text)
        reason = (
            F.when(odd, F.concat(F.lit("offending keys: "), F.array_join(read["odd_keys"], ", ")))
            .when(read["kind"] == "repeated", F.concat(F.lit("duplicate key: "), read["detail"]))
            .when(read["kind"] == "other", F.concat(F.lit("parsed as "), read["detail"]))
            .when(read["kind"] == "broken", F.when(F.length(flat) <= 140, flat).otherwise(F.concat(flat.substr(1, 140), F.lit("…"))))
        )
        return F.struct(
            F.when(~F.coalesce(odd, F.lit(False)), read["fields"]).alias("fields"),
            message.alias("message"),
            F.when(read["kind"] == "repeated", read["detail"]).alias("field"),
            reason.alias("reason"),
        )

    return let(_blocks(block), outcome)


# --- validation -----------------------------------------------------------------
KNOWN_FIELDS = (
    "schema_version",
    "id",
    "title",
    "document_type",
    "language",
    "topics",
    "technologies",
    "source",
    "source_type",
    "version",
    "updated_at",
    "visibility",
    "trust_level",
    "license",
)


def _listing(values) -> str:
    quoted = [f"'{v}'" for v in values]
    return ", ".join(quoted[:-1]) + " or " + quoted[-1]


def schema_gate(fields: Column) -> Column:
    """Struct code, reason when the schema version is missing, odd or unsupported."""
    found = F.try_element_at(fields, F.lit("schema_version"))
    version = k.SUPPORTED_SCHEMA_VERSION

    def issue(code: str, message: str, reason) -> Column:
        return F.struct(
            F.lit(code).alias("code"),
            F.lit(message).alias("message"),
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        )

    return (
        F.when(
            found.isNull(),
            issue(
                "INVALID_METADATA", "Frontmatter is missing the schema version.",
                f"required; the current version is {version}",
            ),
        )
        .when(
            found["type"] != "int",
            issue(
                "INVALID_METADATA", "Schema version must be a whole number.",
                F.concat(F.lit("must be a whole number, got "), found["type"]),
            ),
        )
        .when(
            found["value"] != str(version),
            issue(
                "UNSUPPORTED_SCHEMA_VERSION", "This schema version is not supported.",
                F.concat(found["value"], F.lit(f" is not supported; this build reads version {version}")),
            ),
        )
    )


# name, kind, required, shortest, longest, choices - in the order problems are reported.
RULES = (
    ("id", "slug", True, 2, 100, ()),
    ("title", "text", True, 1, 200, ()),
    ("document_type", "choice", True, 0, 0, k.DOCUMENT_TYPES),
    ("language", "language", True, 0, 1_000_000_000, ()),
    ("topics", "texts", False, 0, 0, ()),
    ("technologies", "texts", False, 0, 0, ()),
    ("source", "text", True, 1, 500, ()),
    ("source_type", "choice", True, 0, 0, k.SOURCE_TYPES),
    ("version", "whole", True, 0, 0, ()),
    ("updated_at", "day", True, 0, 0, ()),
    ("visibility", "choice", False, 0, 0, k.VISIBILITIES),
    ("trust_level", "choice", False, 0, 0, k.TRUST_LEVELS),
    ("license", "nullable", False, 0, 1_000_000_000, ()),
)


def _rules() -> Column:
    """The rules as one literal array, so that each check is written once."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "\\'") + "'"

    rows = [
        f"named_struct('name', {text(name)}, 'kind', {text(kind)}, 'required', {str(required).lower()}, "
        f"'low', {low}, 'high', {high}, 'choices', array({', '.join(text(c) for c in choices) or text('')}), "
        f"'listing', {text(_listing(choices) if choices else '')})"
        for name, kind, required, low, high, choices in RULES
    ]
    return F.expr("array(" + ", ".join(rows) + ")")


def _reason(rule: Column, found: Column) -> Column:
    """What is wrong with one field; null when nothing is."""
    kind, value, is_text = rule["kind"], found["value"], found["type"] == "str"
    valid_day = (found["type"] == "date") | (
        found["type"].isin("str", "datetime") & value.try_cast("date").isNotNull()
    )
    plural = F.when(rule["low"] > 1, "s").otherwise("")
    return (
        F.when(found.isNull(), F.when(rule["required"], "Field required"))
        .when((kind == "nullable") & (found["type"] == "NoneType"), None)
        .when(
            kind == "choice",
            F.when(
                ~is_text | ~F.array_contains(rule["choices"], value),
                F.concat(F.lit("Input should be "), rule["listing"]),
            ),
        )
        .when(
            kind == "whole",
            F.when(found["type"] != "int", "Input should be a valid integer").when(
                value.try_cast("decimal(38,0)") < 1, "Input should be greater than or equal to 1"
            ),
        )
        .when(kind == "day", F.when(~valid_day, "Input should be a valid date"))
        .when(kind == "texts", F.when(found["type"] != "list", "Input should be a valid tuple"))
        .when(~is_text, "Input should be a valid string")
        .when(
            F.length(value) < rule["low"],
            F.concat(
                F.lit("String should have at least "), rule["low"].cast("string"), F.lit(" character"), plural
            ),
        )
        .when(
            F.length(value) > rule["high"],
            F.concat(F.lit("String should have at most "), rule["high"].cast("string"), F.lit(" characters")),
        )
        .when(
            (kind == "slug") & ~value.rlike(k.SLUG_PATTERN),
            f"String should match pattern '{k.SLUG_PATTERN}'",
        )
        .when(
            (kind == "language") & ~value.rlike(k.LANGUAGE_PATTERN),
            f"String should match pattern '{k.LANGUAGE_PATTERN}'",
        )
    )


def field_problems(fields: Column) -> Column:
    """Array of struct(field, reason) in field order, unknown fields last."""

    def problem(name: Column, reason: Column) -> Column:
        return F.struct(name.alias("field"), reason.alias("reason"))

    def check(rule: Column) -> Column:
        found = F.try_element_at(fields, rule["name"])
        items = F.transform(
            F.coalesce(found["odd_items"], F.array().cast("array<int>")),
            lambda n: problem(
                F.concat(rule["name"], F.lit("."), n.cast("string")), F.lit("Input should be a valid string")
            ),
        )
        return F.concat(F.array(problem(rule["name"], _reason(rule, found))), items)

    known = F.filter(F.flatten(F.transform(_rules(), check)), lambda p: p["reason"].isNotNull())
    unknown = F.transform(
        F.array_except(F.map_keys(fields), F.array(*[F.lit(f) for f in KNOWN_FIELDS])),
        lambda name: problem(name, F.lit("Extra inputs are not permitted")),
    )
    return F.concat(known, unknown)


def metadata_struct(fields: Column) -> Column:
    """The typed metadata of valid fields, defaults filled in."""

    def value(name: str) -> Column:
        found = F.try_element_at(fields, F.lit(name))
        return F.when(found["type"] != "NoneType", found["value"])

    def items(name: str) -> Column:
        parsed = F.from_json(value(name), "array<string>")
        return F.coalesce(parsed, F.array().cast("array<string>"))

    return F.struct(
        value("document_type").alias("document_type"),
        value("id").alias("id"),
        value("language").alias("language"),
        value("license").alias("license"),
        value("schema_version").try_cast("int").alias("schema_version"),
        value("source").alias("source"),
        value("source_type").alias("source_type"),
        items("technologies").alias("technologies"),
        value("title").alias("title"),
        items("topics").alias("topics"),
        F.coalesce(value("trust_level"), F.lit("unverified")).alias("trust_level"),
        value("updated_at").try_cast("date").alias("updated_at"),
        value("version").try_cast("int").alias("version"),
        F.coalesce(value("visibility"), F.lit("internal")).alias("visibility"),
    )


def first_wins(documents: DataFrame) -> DataFrame:
    """Adds *owner*: the smallest source path of a valid file with the same *claimed_id*.

    The rows are staged, so every file is parsed once; the ids are then counted over two
    narrow columns, and only ids that are claimed more than once are joined back.
    """
    staged = stage(documents, "parsed-files")
    valid = F.col("issue").isNull()
    owners = (
        staged.filter(valid)
        .groupBy("claimed_id")
        .agg(F.min("source_path").alias("_first"), F.count(F.lit(1)).alias("_claims"))
        .filter("_claims > 1")
        .drop("_claims")
    )
    owner = F.coalesce("_first", F.when(valid, F.col("source_path")))
    return staged.join(owners, "claimed_id", "left").withColumn("owner", owner).drop("_first")


def read_documents(files: DataFrame) -> DataFrame:
    """files(source_path, content bytes) -> one row per file with a nullable *issue*.

    Columns: source_path, document_id, metadata, content, document_fingerprint, issue.
    """
    staged = decode_text(files.filter(included(F.col("source_path"))))
    parts = staged.withColumn("f", split_frontmatter(F.col("text"))).withColumn(
        "p", parse_metadata(F.col("f.block"))
    )
    fields = F.col("p.fields")
    checked = (
        parts.withColumn("gate", F.when(fields.isNotNull(), schema_gate(fields)))
        .withColumn("bad", F.when(fields.isNotNull(), field_problems(fields)))
        .withColumn("body", t.normalize_body(F.col("f.body")))
    )

    def issue(code, message, field=None, reason=None) -> Column:
        def column(v):
            return F.lit(v).cast("string") if v is None or isinstance(v, str) else v

        return F.struct(
            column(code).alias("code"),
            column(message).alias("message"),
            column(field).alias("field"),
            column(reason).alias("reason"),
        )

    others = F.size("bad") - 1
    first = F.try_element_at("bad", F.lit(1))
    summary = F.when(others == 0, first["reason"]).otherwise(
        F.concat(
            first["reason"], F.lit(" (and "), others.cast("string"),
            F.when(others == 1, " more invalid field)").otherwise(" more invalid fields)"),
        )
    )
    found = (
        F.when(F.col("text").isNull(), issue("INVALID_ENCODING", "File is not valid UTF-8."))
        .when(
            ~F.col("f.opened"),
            issue("MISSING_FRONTMATTER", "Document does not start with a `---` frontmatter block."),
        )
        .when(
            ~F.col("f.closed"),
            issue("INVALID_FRONTMATTER", "Frontmatter block is never closed by a `---` line."),
        )
        .when(
            F.col("p.message").isNotNull(),
            issue("INVALID_FRONTMATTER", F.col("p.message"), F.col("p.field"), F.col("p.reason")),
        )
        .when(
            F.col("gate").isNotNull(),
            issue(F.col("gate.code"), F.col("gate.message"), "schema_version", F.col("gate.reason")),
        )
        .when(
            F.size("bad") > 0,
            issue("INVALID_METADATA", "Frontmatter failed validation.", first["field"], summary),
        )
        .when(
            F.col("body") == "",
            issue("EMPTY_DOCUMENT", "Document has valid frontmatter but no content."),
        )
    )
    rows = checked.select(
        "source_path",
        metadata_struct(fields).alias("metadata"),
        F.col("body").alias("content"),
        found.alias("issue"),
        # The plain authored value: a join key must stay a small expression.
        F.try_element_at(fields, F.lit("id"))["value"].alias("claimed_id"),
    )
    owned = first_wins(rows)
    duplicate = F.col("issue").isNull() & (F.col("owner") != F.col("source_path"))
    repeated = issue(
        "DUPLICATE_DOCUMENT_ID",
        F.concat(F.lit("Document id `"), "claimed_id", F.lit("` is already used by another document.")),
        "id",
        F.concat(F.lit("`"), "claimed_id", F.lit("` first claimed by "), "owner"),
    )
    final = owned.withColumn("issue", F.when(duplicate, repeated).otherwise(F.col("issue")))
    return final.select(
        "source_path",
        F.when(F.col("issue").isNull(), F.col("claimed_id")).alias("document_id"),
        "metadata",
        "content",
        digests.document_fingerprint(F.col("metadata"), F.col("content")).alias("document_fingerprint"),
        "issue",
    )


def documents(read: DataFrame) -> DataFrame:
    """The valid documents, metadata as columns: the input of chunk_corpus."""
    carried = [
        "title", "source", "document_type", "language", "visibility", "trust_level", "topics",
        "technologies",
    ]
    return read.filter(F.col("issue").isNull()).select(
        "document_id",
        "source_path",
        *[F.col(f"metadata.{c}").alias(c) for c in carried],
        "document_fingerprint",
        "content",
    )


def issues(read: DataFrame) -> DataFrame:
    return read.filter(F.col("issue").isNotNull()).select("source_path", "issue.*")


def load_corpus(spark: SparkSession, root: str, mode: str = "collect") -> DataFrame:
    """All files of a corpus. mode="strict" raises when any file has an issue."""
    if mode not in ("collect", "strict"):
        raise ValueError("mode is collect or strict")
    read = read_documents(scan_corpus(spark, root))
    if mode == "strict":
        first = issues(read).limit(1).collect()
        if first:
            raise ValueError(f"{first[0].source_path}: {first[0].code} {first[0].message}")
    return read


def ingestion_report(read: DataFrame) -> DataFrame:
    """Files per issue code ('valid' for none); the null code is the total."""
    code = F.coalesce("issue.code", F.lit("valid")).alias("code")
    return read.select(code).rollup("code").agg(F.count(F.lit(1)).alias("files"))
