"""Personal data in whole texts, by DataFrame functions only.

Regular expressions propose spans, leftmost and non-overlapping for each kind. Validators
confirm them: address parts at most 255, the Luhn sum for cards, 9 to 15 digits for phones,
the mod-97 sum for bank accounts (IBAN). Every span has a score: what its kind and
validator are worth, raised when a context word stands in the `NEARBY` characters before
or after it, other matches included. Kinds without a validator of their own (`ssn`) are kept on `LEAST_SCORE` only, that is
next to a context word. Spans are code points, end exclusive.

How positions are found: a match is put between two marks (`MARK`, which is replaced in
the text first by another character no pattern knows), the text is split at the marks, and
lengths are summed in blocks, so the work grows with the text also where it has very many
matches. The characters around a match are joined from the ends of the parts next to it, as
counting them from the start of the text would take the square. Patterns use possessive repeats, so that the engine neither recurses nor backs up
over long runs; what such a repeat takes could not be given back to any match.

Cases: null text counts as empty; no span gives zero counts and the digest of the empty
text; repeated rows are scanned each; a null doc_id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.binding import let
from lodestone.llm.tables import read

MARK, INSTEAD = "\ue000", "\ue001"
NEARBY, LEAST_SCORE, CONTEXT_SCORE = 40, 0.5, 0.3
BLOCK = 64

# A start inside a run fails wherever the start of the run fails, unless a match ended there.
_RUN_START = r"(?:(?<![A-Za-z0-9._%+-])|\G)"
_DIGIT_START = r"(?:(?<![0-9])|\G)"
PATTERNS = {
    "email": _RUN_START + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _DIGIT_START + r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this has no match.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
SCORES = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|login|adresse",
    "card": "card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|cell",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_parts(value: Column) -> Column:
    def small(part):
        rest = F.regexp_replace(part, "^0+", "")
        return (F.length(rest) < 3) | ((F.length(rest) == 3) & (rest <= "255"))

    return F.forall(F.split(value, "[.]"), small)


def _mod97(value: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")

    def step(total, letter):
        number = F.when(letter >= "A", F.ascii(letter) - 55).otherwise(F.ascii(letter) - 48)
        return (total * F.when(letter >= "A", 100).otherwise(10) + number) % 97

    return let(
        plain,
        lambda p: F.aggregate(F.split(F.concat(p.substr(F.lit(5), F.length(p)), p.substr(1, 4)), "(?<=.)(?=.)"), F.lit(0), step) == 1,
    )


VALID = {
    "email": lambda v: F.lit(True),
    "ip": _small_parts,
    "card": lambda v: F.length(_digits(v)).between(13, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "iban": _mod97,
    "ssn": lambda v: F.lit(True),
}
SPAN = "array<struct<start:int,end:int,score:double,value:string>>"


def _starts(lengths: Column) -> Column:
    """Running totals before each element, in blocks: appending copies a block, not the array."""

    def totals(values, first):
        return F.slice(
            F.aggregate(values, F.array(first), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)), F.lit(1), F.size(values)
        )

    blocks = F.transform(
        F.sequence(F.lit(0), ((F.size(lengths) - 1) / BLOCK).cast("int")), lambda k: F.slice(lengths, k * BLOCK + 1, BLOCK)
    )

    def placed(parts):
        sums = F.transform(parts, lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x))
        return let(totals(sums, F.lit(0)), lambda o: F.flatten(F.transform(parts, lambda s, k: totals(s, F.get(o, k)))))

    return let(blocks, placed)


def matches(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, in order."""

    def around(ends, i):
        """The text near part i. Every second part is a match of two characters or more, so `NEARBY` parts hold enough."""
        first = F.greatest(i - NEARBY, F.lit(0))
        before = F.array_join(F.slice(ends["tails"], first + 1, i - first), "")
        after = F.array_join(F.slice(ends["heads"], i + 2, F.lit(NEARBY)), "")
        return F.lower(F.concat(F.right(before, F.lit(NEARBY)), F.lit("\n"), F.left(after, F.lit(NEARBY))))

    def spans(parts):
        def placed(starts, ends):
            def one(i):
                value = F.get(parts, i)
                near = around(ends, i).rlike(CONTEXT[kind])
                return F.struct(
                    F.get(starts, i).alias("start"),
                    (F.get(starts, i) + F.char_length(value)).alias("end"),
                    (F.lit(SCORES[kind]) + F.when(near, F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0))).alias("score"),
                    value.alias("value"),
                )

            valid = F.filter(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: VALID[kind](F.get(parts, i)))
            least = 0.0 if kind in BASE else LEAST_SCORE
            return F.filter(F.transform(valid, one), lambda s: s["score"] >= least)

        lengths = F.transform(parts, lambda p: F.char_length(p))
        ends = F.struct(
            F.transform(parts, lambda p: F.right(p, F.lit(NEARBY))).alias("tails"),
            F.transform(parts, lambda p: F.left(p, F.lit(NEARBY))).alias("heads"),
        )
        found = let(let(lengths, _starts), lambda starts: let(ends, lambda e: placed(starts, e)))
        return F.when(F.size(parts) > 1, found).otherwise(F.array().cast(SPAN))

    marked = F.regexp_replace(text, PATTERNS[kind], MARK + "$0" + MARK)
    if kind in NEEDS:
        marked = F.when(F.contains(text, F.lit(NEEDS[kind])), marked).otherwise(F.lit(""))
    return let(F.split(marked, MARK), spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one array of spans (start, end, score, value) for each kind of `PATTERNS`."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, INSTEAD)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", *[matches(F.col("text"), kind).alias(kind) for kind in PATTERNS])


def listed(kinds) -> Column:
    """kind:start:end of all spans, by kind, then start, comma-joined."""

    def named(kind):
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*[named(kind) for kind in kinds]), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"))
    scores = F.concat(*[F.transform(F.col(k), lambda s: F.format_number(s["score"], 1)) for k in PATTERNS])
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed(BASE), 256).alias("base_sha256"),
        listed(PATTERNS).alias("spans"),
        F.array_join(scores, ",").alias("scores"),
    )


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict[str, str] = {}
