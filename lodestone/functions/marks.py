"""Citation marks inside answer texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.functions import text as t
from lodestone.functions.binding import let

CANONICAL = r"[ \t]*\[S\d+\]"
PUBLIC = r"\[(\d+)\]"

# Labels named in prose. Group 1 is the source word of a reference, if it has one.
REFERENCE = (
    rf"(?U)(?:({k.SOURCE_WORD})[ \t]*:?[ \t]*{k.DESCRIBED_LABEL}(?:{k.LABEL_JOIN}{k.DESCRIBED_LABEL})*"
    rf"|{k.DESCRIBED_LABEL}(?:{k.LABEL_JOIN}{k.DESCRIBED_LABEL})+)"
)
#: What every reference holds; found at less cost than a reference.
A_LABEL = r"(?U)S\d"
FRONTED = (
    rf"^({'|'.join(k.REFERENCE_INTROS)})[ \t]+(?:(?:{'|'.join(k.REFERENCE_ARTICLES)})[ \t]+)?"
    rf"{REFERENCE}[ \t]*,?[ \t]*"
)
VERB_FIRST = rf"(?Us)^(\w+)[ \t]+({'|'.join(k.PRONOUNS)})\b(.*)$"


def replace_matches(text: Column, pattern: str, replacement) -> Column:
    """Replace every match by a column computed from it: split, transform, weave together."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    replaced = F.transform(found, replacement)
    woven = F.zip_with(
        between, replaced, lambda piece, mark: F.concat(piece, F.coalesce(mark, F.lit("")))
    )
    return F.array_join(woven, "")


def canonical_marks(answer: Column) -> Column:
    """Bracket variants and groups of labels become `[S1] [S2]`."""

    def rewrite(mark: Column) -> Column:
        labels = F.regexp_replace(F.regexp_extract(mark, k.MARK_VARIANT, 1), r"†[^,;–—-]*", "")
        numbers = F.regexp_extract_all(labels, F.lit(r"[Ss][  ]?(\d+)"), F.lit(1))
        return F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("[S"), n, F.lit("]"))), " ")

    return replace_matches(answer, k.MARK_VARIANT, rewrite)


def mark_labels(answer: Column) -> Column:
    """Labels of the canonical marks, in text order."""
    return F.regexp_extract_all(answer, F.lit(r"\[(S\d+)\]"), F.lit(1))


def renumber_marks(answer: Column, number_of: Column) -> Column:
    """`[S3]` becomes the number that *number_of* (a map) gives S3; others disappear."""

    def rewrite(mark: Column) -> Column:
        blanks = F.regexp_extract(mark, r"^([ \t]*)", 1)
        label = F.regexp_extract(mark, r"\[(S\d+)\]", 1)
        number = F.try_element_at(number_of, label)
        return F.when(
            number.isNotNull(), F.concat(blanks, F.lit("["), number.cast("string"), F.lit("]"))
        ).otherwise("")

    return replace_matches(answer, CANONICAL, rewrite)


def has_label_leak(answer: Column) -> Column:
    """An internal source label is still readable in the text."""
    return answer.rlike("(?U)" + k.INTERNAL_LABEL)


def has_dangling_mark(answer: Column, citations: Column) -> Column:
    """A `[n]` for which there is no n-th citation."""
    numbers = F.regexp_extract_all(answer, F.lit(PUBLIC), F.lit(1))
    return F.exists(
        numbers, lambda n: (n.cast("decimal(38,0)") < 1) | (n.cast("decimal(38,0)") > citations)
    )


def _without_labels(prose: Column) -> Column:
    """References shrink to their source word, and the gaps they leave close."""
    bare = F.regexp_replace(prose, REFERENCE, "$1")
    closed = F.regexp_replace(bare, r"[ \t]+(?=[.,;:!?])", "")
    return F.regexp_replace(closed, r"(?U)(?<=\S)[ \t]{2,}", " ")


def _only_names_sources(sentence: Column) -> Column:
    said = F.regexp_extract_all(
        F.lower(F.regexp_replace(sentence, REFERENCE, " ")), F.lit(r"(?U)\w+"), F.lit(0)
    )
    return F.size(F.array_except(said, F.array(*[F.lit(word) for word in k.SOURCE_TALK]))) == 0


def _said_without_sources(sentence: Column) -> Column:
    """The sentence without its references; one that it opens with goes as a whole if the rest can stand."""
    rest = F.regexp_replace(sentence, FRONTED, "")
    english = sentence.rlike(FRONTED) & sentence.startswith("According to") & (rest != "")
    german = sentence.rlike(FRONTED) & rest.rlike(VERB_FIRST)
    swapped = F.concat(
        F.initcap(F.regexp_extract(rest, VERB_FIRST, 2)), F.lit(" "),
        F.regexp_extract(rest, VERB_FIRST, 1), F.regexp_extract(rest, VERB_FIRST, 3),
    )
    upper = F.concat(F.upper(F.substring(rest, 1, 1)), rest.substr(F.lit(2), F.length(rest)))
    return F.when(english, upper).when(german, swapped).otherwise(_without_labels(sentence))


def _line_without_references(line: Column) -> Column:
    """The line with its sentences judged one by one; null when none is left."""
    sentences = F.filter(
        F.split(line, r"(?<=[.!?])(?=[ \t])", -1), lambda s: ~s.rlike(r"^[.!?]$")
    )
    named = F.filter(F.transform(sentences, t.strip), lambda s: s != "")
    judged = F.transform(
        named,
        lambda s: F.when(~s.rlike(REFERENCE), s).when(~_only_names_sources(s), _said_without_sources(s)),
    )
    return let(
        F.filter(judged, lambda s: s.isNotNull()),
        lambda kept: F.when(
            F.size(kept) > 0,
            F.concat(F.regexp_extract(line, r"^([ \t]*)", 1), F.array_join(kept, " ")),
        ),
    )


def drop_references(answer: Column) -> Column:
    """Sentences that only name labels go; others lose the labels and keep what they say.

    When nothing would be left, only the labels go. Texts without a reference stay as they are.
    """
    lines = F.transform(
        F.split(answer, "\n"),
        lambda line: F.when(line.rlike(A_LABEL) & line.rlike(REFERENCE), _line_without_references(line)).otherwise(line),
    )
    joined = F.array_join(F.filter(lines, lambda line: line.isNotNull()), "\n")
    tidy = F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")
    left = let(tidy, lambda text: F.when(text.rlike(r"(?U)\S"), text).otherwise(_without_labels(answer)))
    return F.when(answer.rlike(REFERENCE), left).otherwise(answer)


def drop_names(answer: Column) -> Column:
    """Labels used as a name (`S1: Skills`) or in parentheses go; list marks and stops stay."""
    unnamed = F.regexp_replace(answer, "(?md)" + k.LABEL_NAME, "$1")
    return F.regexp_replace(unnamed, k.LABEL_PARENTHESES, "")
