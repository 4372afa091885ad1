"""Near lines where the number of edits grows with the length, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.llm import lines
from tests.llm import brute

CLASSES = ((8, 1), (20, 2), (40, 5), (90, 9))


def edited(r, text: str, edits: int) -> str:
    out = list(text)
    for _ in range(edits):
        at = int(r.integers(0, len(out) + 1))
        kind = r.integers(0, 3)
        if kind == 0:
            out.insert(at, str(r.choice(list("abcdef "))))
        elif kind == 1 and at < len(out):
            out.pop(at)
        elif at < len(out):
            out[at] = str(r.choice(list("abcdef ")))
    return "".join(out)


def wanted(texts: list[str], classes) -> set:
    """All pairs, by the plain table of distances."""
    out = set()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            most = lines.edits_for(min(len(a), len(b)), classes)
            if a != b and most >= 0 and abs(len(a) - len(b)) <= most:
                gap = brute.distance(a, b)
                if gap <= most:
                    out.add((*sorted((lines.line_id(a), lines.line_id(b))), gap))
    return out


@pytest.mark.parametrize("classes", [CLASSES, lines.TENTHS])
def test_edits_grow_with_the_length(spark, classes):
    r = np.random.default_rng(11)
    texts = []
    for length in (7, 9, 16, 19, 21, 38, 39, 41, 79, 82, 88, 95, 130, 300):
        base = "".join(r.choice(list("abcdef"), length))
        texts.append(base)
        texts += [edited(r, base, int(n)) for n in r.integers(0, 12, 14)]
    texts = sorted({t for t in texts if t.strip() and "\n" not in t})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {tuple(row) for row in lines.line_links(docs, classes).collect()}
    want = wanted(texts, classes)
    assert got == want
    assert {gap for *_, gap in want} >= set(range(1, max(e for _, e in classes) + 1))


def test_one_changed_word_of_a_long_line(spark):
    line = "the committee of the northern harbour met on a cold morning and heard the report about repairs of the old sea wall"
    other = line.replace("cold", "bright")
    docs = spark.createDataFrame([(1, line), (2, other), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in lines.line_dedup(docs).collect()} == {1: line, 2: other, 3: "", 4: ""}
    assert {r.doc_id: r.kept for r in lines.line_dedup(docs, classes=lines.TENTHS).collect()} == {1: line, 2: "", 3: "", 4: ""}
    kept = {r.doc_id: r.text for r in lines.without_repeats(docs, classes=lines.TENTHS).collect()}
    assert kept == {1: line, 2: "", 3: None, 4: ""}


@pytest.mark.parametrize("classes", [(), ((16, 16),), ((16, 4), (40, 2)), ((40, 2), (16, 4)), ((16, -1),)])
def test_classes_must_rise(classes):
    with pytest.raises(ValueError):
        lines.checked(classes)
