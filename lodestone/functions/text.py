"""Text columns: normalisation, tokens, language, embedding text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone import constants as k
from lodestone.functions.binding import let

# Unicode white space plus the four separator controls that Python also strips.
WS = r"[\s\x1c-\x1f]"
#: The characters of WS: trimming looks at the ends only, a pattern at every place of a text.
WS_CHARS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = r"[\p{L}\p{N}_]+"
FENCE_LINE = r"^[^\S\n]{0,3}(?:`{3,}|~{3,})"
VISIBLE = r"[^\p{Cc}\p{Cf}\p{Zs}\p{Zl}\p{Zp}]"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC. Pure-ASCII rows reach the Python worker as nulls only."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def unix_lines(text: Column) -> Column:
    without_mark = F.regexp_replace(text, "^\ufeff", "")
    return F.regexp_replace(without_mark, r"\r\n?", "\n")


def normalize_text(text: Column) -> Column:
    """Drop a byte-order mark, unify line ends, compose to NFC."""
    return nfc(unix_lines(text))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WS_CHARS))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def normalize_body(text: Column) -> Column:
    return rstrip(F.regexp_replace(text, r"^\n+", ""))


def collapse_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"(?U){WS}+", " "))


def normalize_query(text: Column) -> Column:
    return collapse_whitespace(nfc(text))


def has_visible(text: Column) -> Column:
    return text.rlike(VISIBLE)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def detect_language(text: Column) -> Column:
    """'de' when German evidence outweighs English evidence, else 'en'."""

    def decide(found: Column) -> Column:
        def count(test) -> Column:
            return F.size(F.filter(found, test))

        german = count(lambda w: w.isin(k.GERMAN_MARKERS)) + k.GERMAN_LETTER_WEIGHT * count(
            lambda w: w.rlike(f"[{k.GERMAN_LETTERS}]")
        )
        english = count(lambda w: w.isin(k.ENGLISH_MARKERS))
        return F.when(german > english, "de").otherwise("en")

    return let(words(nfc(text)), decide)


def refusal_text(language: Column) -> Column:
    return F.when(language == "de", k.REFUSALS["de"]).otherwise(k.REFUSALS["en"])


def is_refusal_text(answer: Column) -> Column:
    return answer.isin(list(k.REFUSALS.values()))


def estimate_tokens(text: Column) -> Column:
    return tokens_of_length(F.length(text))


def tokens_of_length(length: Column) -> Column:
    return F.ceil(length / F.lit(k.CHARS_PER_TOKEN)).cast("long")


def embedding_text(title: Column, heading_path: Column, content: Column) -> Column:
    path = F.nullif(F.array_join(heading_path, " > "), F.lit(""))
    return F.concat_ws("\n\n", title, path, content)


def balanced_fences(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?md)" + FENCE_LINE)) % 2 == 0


def chunk_id(document_id: Column, ordinal: Column) -> Column:
    return F.format_string("%s--%04d", document_id, ordinal)


def innermost(heading_path: Column) -> Column:
    return F.try_element_at(heading_path, F.lit(-1))


def citation(document_id: Column, title: Column, source: Column, heading_path: Column) -> Column:
    return F.struct(
        document_id.alias("document_id"),
        title.alias("title"),
        source.alias("source"),
        innermost(heading_path).alias("section"),
    )
