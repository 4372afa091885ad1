"""Reading JSON replies: answers, verdicts, cut-off detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.functions import text as t
from lodestone.functions.binding import let

FENCED = r"(?sU)^\s*```(?:json)?\s*(.*?)\s*```\s*\z"
OPENED = r"(?U)^\s*```"
OPENING_FENCE = r"(?U)^```(?:json)?\s*"
# From a quote to its closing quote, or to the end where there is none.
STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+("?)'


def json_candidate(text: Column) -> Column:
    """The reply without the one Markdown fence that is tolerated."""
    return F.when(
        text.rlike(OPENED) & text.rlike(FENCED), F.regexp_extract(text, FENCED, 1)
    ).otherwise(t.strip(text))


def _type(document: Column, path: str) -> Column:
    """Type name of a JSON value; null when the field is absent, VOID when it is null."""
    return F.schema_of_variant(F.try_variant_get(document, path, "variant"))


def _shape_rule(candidate: Column, document: Column) -> Column:
    return (
        F.when(candidate == "", "reply_empty")
        .when(document.isNull(), "reply_not_json")
        .when(~F.schema_of_variant(document).startswith("OBJECT"), "reply_not_an_object")
    )


def _absent(kind: Column) -> Column:
    return kind.isNull() | (kind == "VOID")


def _with_document(text: Column, body) -> Column:
    """body(candidate, document) with the reply read and parsed once."""
    return let(
        json_candidate(text),
        lambda candidate: let(
            F.struct(candidate.alias("c"), F.try_parse_json(candidate).alias("d")),
            lambda read: body(read["c"], read["d"]),
        ),
    )


def _fields(document: Column) -> Column:
    """Types and values of the three fields of an answer reply."""
    return F.struct(
        _type(document, "$.answer").alias("answer_type"),
        _type(document, "$.sources").alias("sources_type"),
        _type(document, "$.support").alias("support_type"),
        F.try_variant_get(document, "$.sources", "array<variant>").alias("entries"),
        F.lower(t.strip(F.try_variant_get(document, "$.support", "string"))).alias("support"),
    )


def _answer_rule(f: Column) -> Column:
    not_text = F.exists(
        f["entries"], lambda e: F.coalesce(F.schema_of_variant(e), F.lit("VOID")) != "STRING"
    )
    return F.coalesce(
        F.when(~_absent(f["answer_type"]) & (f["answer_type"] != "STRING"), "answer_not_text"),
        F.when(~_absent(f["sources_type"]) & ~f["sources_type"].startswith("ARRAY"), "sources_not_a_list"),
        F.when(~_absent(f["sources_type"]) & not_text, "source_not_text"),
        F.when(
            ~_absent(f["support_type"])
            & ((f["support_type"] != "STRING") | ~f["support"].isin("stated", "inferred", "none")),
            "support_not_recognized",
        ),
    )


def _label(entry: Column) -> Column:
    raw = t.strip(F.try_variant_get(entry, "$", "string"))
    bare = t.strip(F.regexp_replace(raw, r"^[\[\]]+|[\[\]]+\z", ""))
    return F.when(F.upper(bare).rlike(r"(?U)^S\d+\z"), F.upper(bare)).otherwise(bare)


def parse_reply(text: Column) -> Column:
    """Struct rule, answer, labels, support. *rule* names what is broken, else null."""

    def result(document: Column, f: Column, rule: Column) -> Column:
        ok = rule.isNull()
        answer = F.coalesce(t.strip(F.try_variant_get(document, "$.answer", "string")), F.lit(""))
        labels = F.coalesce(F.transform(f["entries"], _label), F.array().cast("array<string>"))
        return F.struct(
            rule.alias("rule"),
            F.when(ok, answer).alias("answer"),
            F.when(ok, labels).alias("labels"),
            F.when(ok & ~_absent(f["support_type"]), f["support"]).alias("support"),
        )

    def read(candidate: Column, document: Column) -> Column:
        return let(
            _fields(document),
            lambda f: let(
                F.coalesce(_shape_rule(candidate, document), _answer_rule(f)),
                lambda rule: result(document, f, rule),
            ),
        )

    return _with_document(text, read)


def parse_verdict(text: Column) -> Column:
    """Struct verdict (supported / not_supported / unusable) and the broken rule."""

    def read(candidate: Column, document: Column) -> Column:
        kind = _type(document, "$.verdict")
        value = F.lower(t.strip(F.try_variant_get(document, "$.verdict", "string")))
        known = (kind == "STRING") & value.isin("supported", "not_supported")
        rule = F.coalesce(
            _shape_rule(candidate, document),
            F.when(_absent(kind), "verdict_missing"),
            F.when(~known, "verdict_not_recognized"),
        )
        return let(
            F.struct(rule.alias("rule"), value.alias("value")),
            lambda r: F.struct(
                F.when(r["rule"].isNull(), r["value"]).otherwise("unusable").alias("verdict"),
                r["rule"].alias("rule"),
            ),
        )

    return _with_document(text, read)


def is_cut_off(text: Column) -> Column:
    """A JSON object that was opened and never closed."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("closed"))

    def step(acc: Column, c: Column) -> Column:
        move = F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        depth = F.when(acc["closed"], acc["depth"]).otherwise(acc["depth"] + move)
        return F.struct(
            depth.alias("depth"), (acc["closed"] | ((move == -1) & (depth == 0))).alias("closed")
        )

    def open_end(outside: Column) -> Column:
        # Complete strings are now two quotes; a single one is a string left open.
        in_string = F.regexp_count(outside, F.lit('"')) % 2 == 1
        brackets = F.split(F.regexp_replace(outside, r"[^{}\[\]]", ""), "")
        return F.aggregate(
            brackets, start, step, lambda acc: ~acc["closed"] & (in_string | (acc["depth"] > 0))
        )

    candidate = F.regexp_replace(json_candidate(text), OPENING_FENCE, "")
    return let(
        candidate,
        lambda c: c.startswith("{") & let(F.regexp_replace(c, STRING, '"$1'), open_end),
    )


def unusable_category(finish_reason: Column, cut_off: Column) -> Column:
    """Why a reply could not be used: stopped at the output limit, or not parseable."""
    truncated = (finish_reason == k.TRUNCATED_FINISH) | (finish_reason.isNull() & cut_off)
    return F.when(truncated, "output_truncated").otherwise("unparseable_output")


def visible_characters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, rf"(?U){t.WS}", ""))
