"""Blocks and chunks of hand-written Markdown, against plain Python."""

import random
import re

import pytest

from lodestone.operators import chunking, structure
from lodestone.operators.markdown_lines import read_lines
from lodestone.policies import ChunkingPolicy

TEXT = """intro line
still intro

# One

- first item
  more of it
- second item

- third, loose

after the list

## Two ##

> quoted
> lines

```python
# not a heading

code
```

***

### Three
#
text under no heading

    indented code

1. uno
2. dos"""


def frame(spark, *texts):
    rows = [(f"doc-{n}", text) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "document_id string, content string")


def test_blocks_of_a_page(spark):
    found = structure.blocks(structure.analyze(frame(spark, TEXT))).orderBy("section_no", "block_no")
    got = [(r.heading_path, r.kind, r.text) for r in found.collect()]
    assert got == [
        ([], "paragraph", "intro line\nstill intro"),
        (["One"], "list", "- first item\n  more of it\n- second item\n\n- third, loose"),
        (["One"], "paragraph", "after the list"),
        (["One", "Two"], "quote", "> quoted\n> lines"),
        (["One", "Two"], "code", "```python\n# not a heading\n\ncode\n```"),
        (["One", "Two"], "other", "***"),
        ([], "paragraph", "text under no heading"),
        ([], "code", "    indented code"),
        ([], "list", "1. uno\n2. dos"),
    ]
    units = found.filter("kind = 'list'").collect()
    assert units[0].units == ["- first item\n  more of it", "- second item", "- third, loose"]


CASES = [
    # text, (heading path, kind, text) of each block
    ("~~~\n```\n# not a heading\n~~~\nafter", [([], "code", "~~~\n```\n# not a heading\n~~~"), ([], "paragraph", "after")]),
    ("````\n```\n# no\n```\n````\n# yes\nbody", [([], "code", "````\n```\n# no\n```\n````"), (["yes"], "paragraph", "body")]),
    ("```\na\n```\n```\nb\n``` \nc", [([], "code", "```\na\n```"), ([], "code", "```\nb\n```"), ([], "paragraph", "c")]),
    ("```py\n``` x\n# open to the end", [([], "code", "```py\n``` x\n# open to the end")]),
    ("``` a`b\n# yes\nbody", [([], "paragraph", "``` a`b"), (["yes"], "paragraph", "body")]),
    ("Title\n=====\nbody", [(["Title"], "paragraph", "body")]),
    ("# A\n\nSub\nmore\n---\n\nbody", [(["A", "Sub\nmore"], "paragraph", "body")]),
    ("text\n\n---\nbody", [([], "paragraph", "text"), ([], "other", "---"), ([], "paragraph", "body")]),
    ("===\nbody", [([], "paragraph", "===\nbody")]),
    ("A\n===\n===\n===\nbody", [(["==="], "paragraph", "body")]),
    ("A\n---\n---\nbody", [(["A"], "other", "---"), (["A"], "paragraph", "body")]),
    ("- a\n---\nbody", [([], "list", "- a"), ([], "other", "---"), ([], "paragraph", "body")]),
    ("> a\n---\nbody", [([], "quote", "> a"), ([], "other", "---"), ([], "paragraph", "body")]),
    ("a\n***\nb", [([], "paragraph", "a"), ([], "other", "***"), ([], "paragraph", "b")]),
    ("first\n\nB\n-\nbody", [([], "paragraph", "first"), (["B"], "paragraph", "body")]),
    ("", []),
]


def test_fences_and_setext_headings(spark):
    found = structure.blocks(structure.analyze(frame(spark, *[text for text, _ in CASES]))).collect()
    for n, (text, expected) in enumerate(CASES):
        own = sorted((r for r in found if r.document_id == f"doc-{n}"), key=lambda r: (r.section_no, r.block_no))
        assert [(r.heading_path, r.kind, r.text) for r in own] == expected, text


CONTAINERS = [
    ("- item\n  ## in list\n- two\n\n  para\n\n## top\n- a\n1. b", [
        ([], "list", "- item\n  ## in list\n- two\n\n  para"), (["top"], "list", "- a"), (["top"], "list", "1. b")]),
    ("> q\nlazy\n> ## h\n\n> next", [([], "quote", "> q\nlazy\n> ## h"), ([], "quote", "> next")]),
    ("- a\n  ```\n  # x\n  ```\nend", [([], "list", "- a\n  ```\n  # x\n  ```"), ([], "paragraph", "end")]),
    ("- a\n  ```\n# x\nend", [([], "list", "- a\n  ```"), (["x"], "paragraph", "end")]),
    ("> ```\n> # x\nend", [([], "quote", "> ```\n> # x"), ([], "paragraph", "end")]),
    ("1. a\n2. b\n\n   c\n\n       code\n- x\nlazy\n\nz", [
        ([], "list", "1. a\n2. b\n\n   c\n\n       code"), ([], "list", "- x\nlazy"), ([], "paragraph", "z")]),
    ("text\n2. no\n-\nhead", [(["text\n2. no"], "paragraph", "head")]),
    ("text\n- yes", [([], "paragraph", "text"), ([], "list", "- yes")]),
    ("-\n\n  foo", [([], "list", "-"), ([], "paragraph", "  foo")]),
    ("-\n  foo", [([], "list", "-\n  foo")]),
    ("- a\n\n\n- b\n***\n- c", [([], "list", "- a\n\n\n- b"), ([], "other", "***"), ([], "list", "- c")]),
    ("- a\n* b", [([], "list", "- a"), ([], "list", "* b")]),
    ("> - a\n> - b\nlazy\n- c", [([], "quote", "> - a\n> - b\nlazy"), ([], "list", "- c")]),
    ("-\tx\n\n\ty\n\n    z", [([], "list", "-\tx\n\n\ty\n\n    z")]),
    ("    code\n\n    more\npar\n    cont", [([], "code", "    code\n\n    more"), ([], "paragraph", "par\n    cont")]),
    ("[a]: /u 'x'\n[b]: <c>\ntext", [([], "paragraph", "text")]),
    ("| a | b |\n| - | - |\n| 1 | 2 |", [([], "paragraph", "| a | b |\n| - | - |\n| 1 | 2 |")]),
]
RAW_HTML = [
    # text, without and with HTML blocks
    ("<!--\n# hidden\n-->\ntext", [([], "paragraph", "<!--"), (["hidden"], "paragraph", "-->\ntext")], [([], "other", "<!--\n# hidden\n-->"), ([], "paragraph", "text")]),
    ("<div>\n## inside\n</div>\n\n# out\nx", [([], "paragraph", "<div>"), (["inside"], "paragraph", "</div>"), (["out"], "paragraph", "x")],
     [([], "other", "<div>\n## inside\n</div>"), (["out"], "paragraph", "x")]),
    ("a\n<b>\n\n<i x='1'>\n# no\n\ny", [([], "paragraph", "a\n<b>"), ([], "paragraph", "<i x='1'>"), (["no"], "paragraph", "y")],
     [([], "paragraph", "a\n<b>"), ([], "other", "<i x='1'>\n# no"), ([], "paragraph", "y")]),
    ("<pre>\n\n# no\n</pre> t\nz", [([], "paragraph", "<pre>"), (["no"], "paragraph", "</pre> t\nz")], [([], "other", "<pre>\n\n# no\n</pre> t"), ([], "paragraph", "z")]),
    ("- <!--\n  # no\n\n# yes\nz", [([], "list", "- <!--\n  # no"), (["yes"], "paragraph", "z")], [([], "list", "- <!--\n  # no"), (["yes"], "paragraph", "z")]),
]


def read_blocks(spark, texts, html=False):
    found = structure.blocks(structure.analyze(frame(spark, *texts), html)).collect()
    return [
        [(r.heading_path, r.kind, r.text) for r in sorted((r for r in found if r.document_id == f"doc-{n}"), key=lambda r: (r.section_no, r.block_no))]
        for n in range(len(texts))
    ]


def test_blocks_inside_lists_and_quotes_open_no_section(spark):
    for (text, expected), got in zip(CONTAINERS, read_blocks(spark, [t for t, _ in CONTAINERS])):
        assert got == expected, text


def test_raw_html_is_text_unless_asked_for(spark):
    texts = [t for t, _, _ in RAW_HTML]
    for (text, plain, html), got, got_html in zip(RAW_HTML, read_blocks(spark, texts), read_blocks(spark, texts, True)):
        assert (got, got_html) == (plain, html), text


def test_items_are_the_direct_ones(spark):
    text = "- outer\n  - inner one\n  - inner two\n\n  # in\n- second\nlazy\n\n- third"
    row = structure.blocks(structure.analyze(frame(spark, text))).first()
    assert row.units == ["- outer\n  - inner one\n  - inner two\n\n  # in", "- second\nlazy", "- third"]


def test_every_line_is_kept_and_blocks_do_not_mix():
    rng = random.Random(11)
    parts = ["# h", "text", "", "> q", "- a", "  b", "1. c", "```", "---", "    d", "\t e", "> - f", "<!--", "-->", "<div>", "===", "[x]: y", "*", "2) g"]
    for _ in range(3000):
        text = "\n".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 12)))
        for html in (False, True):
            lines = read_lines(text, html)
            assert "\n".join(line.text for line in lines) == text
            last, seen = None, set()
            for line in lines:
                if line.heading_level:
                    seen = set()
                assert not (line.in_heading and line.kind)
                assert line.kind or line.in_heading or not line.text.strip() or line.text.lstrip().startswith("[x]"), text
                if line.kind and (line.kind, line.block_no) != last:
                    assert line.block_no not in seen, text
                    seen.add(line.block_no)
                last = (line.kind, line.block_no) if line.kind else last if not line.heading_level else None


def test_long_documents_take_time_in_proportion():
    for text in ("- " * 3000, "> " * 3000 + "x", "\n".join(["- a"] * 20_000), "\n".join(["x"] * 50_000) + "\n---"):
        assert "\n".join(line.text for line in read_lines(text)) == text


def test_fence_lines_follow_a_plain_scan(spark):
    rng = random.Random(3)
    parts = ["```", "````", "~~~", "~~~~~", "``` py", "~~~ js", "text", "", "   ```", "    ```", "``` `", "# h"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    rows = structure.mark_fences(frame(spark, *texts)).collect()
    for n, text in enumerate(texts):
        expected, run = [], ""
        for line in text.split("\n"):
            if run:
                bare = re.match(r"^ {0,3}(`{3,}|~{3,})[ \t]*$", line)
                closes = bool(bare) and bare.group(1)[0] == run[0] and len(bare.group(1)) >= len(run)
                expected.append((line, closes, True))
                run = "" if closes else run
            else:
                opens = re.match(r"^ {0,3}(?:(`{3,})[^`]*|(~{3,}).*)$", line)
                run = (opens.group(1) or opens.group(2)) if opens else ""
                expected.append((line, bool(opens), bool(opens)))
        own = sorted((r for r in rows if r.document_id == f"doc-{n}"), key=lambda r: r.line_no)
        assert [(r.line, r.is_fence, r.in_code) for r in own] == expected, text


def test_heading_paths_against_a_stack(spark):
    rng = random.Random(7)
    lines = []
    for n in range(600):
        kind = rng.random()
        if kind < 0.5:
            title = f" t{n}" if rng.random() < 0.85 else ""
            lines.append("#" * rng.randint(1, 6) + title)
        else:
            lines.append(f"line {n}")
    got = structure.analyze(frame(spark, "\n".join(lines))).orderBy("line_no").collect()
    stack, expected = [], []
    for line in lines:
        head = re.match(r"^(#{1,6})(?: (.*))?$", line)
        if head:
            level = len(head.group(1))
            stack = [entry for entry in stack if entry[0] < level]
            if head.group(2):
                stack.append((level, head.group(2)))
        expected.append([text for _, text in stack])
    assert [r.heading_path for r in got] == expected


def _sample(seed):
    rng = random.Random(seed)
    parts = ["# Start"]
    for n in range(rng.randint(5, 40)):
        words = [f"w{rng.randint(0, 99)}" * rng.randint(1, 3) for _ in range(rng.randint(1, 60))]
        kind = rng.random()
        if kind < 0.1:
            parts.append("#" * rng.randint(1, 4) + f" Head {n}")
        elif kind < 0.25:
            parts.append("\n".join(f"- item {w}" for w in words))
        elif kind < 0.3:
            parts.append("```\n" + "\n".join(words[:4]) + "\n```")
        elif kind < 0.4:
            parts.append("x" * rng.randint(100, 700))
        else:
            parts.append(" ".join(w + rng.choice(["", "", ".", "!"]) for w in words))
    return "\n\n".join(parts)


@pytest.mark.parametrize("policy", [ChunkingPolicy(200, 300, 60), ChunkingPolicy(80, 80, 0), ChunkingPolicy(1200, 1800, 150)])
def test_chunk_invariants(spark, policy):
    texts = [_sample(seed) for seed in range(25)]
    docs = frame(spark, *texts)
    chunks = chunking.chunk_corpus(docs, policy).orderBy("document_id", "ordinal").collect()
    checks = chunking.chunk_invariants(chunking.chunk_corpus(docs, policy), policy).first()
    assert (checks.gaps, checks.over_max, checks.empty, checks.repeated_ids) == (0, 0, 0, 0)
    failed = {r.document_id for r in chunking.chunking_issues(docs, policy).collect()}
    for number, text in enumerate(texts):
        name = f"doc-{number}"
        own = [c for c in chunks if c.document_id == name]
        if name in failed:
            assert own == []
            continue
        # Nothing is lost: without overlaps and headings the same characters remain, in order.
        body = "".join(c.content[c.overlap_prefix_chars:] for c in own)
        kept = "\n".join(line for line in text.split("\n") if not re.match(r"^#{1,6} ", line))
        assert re.sub(r"\s", "", body) == re.sub(r"\s", "", kept)
        for c in own:
            assert c.overlap_prefix_chars <= policy.overlap_chars
            assert len(re.findall(r"(?m)^```", c.content)) % 2 == 0


def test_an_edit_elsewhere_keeps_other_fingerprints(spark):
    before = chunking.chunk_corpus(frame(spark, "# A\n\none\n\n# B\n\ntwo")).collect()
    after = chunking.chunk_corpus(frame(spark, "# A\n\none changed\n\n# B\n\ntwo")).collect()
    assert {c.fingerprint for c in before if c.heading_path == ["B"]} == {
        c.fingerprint for c in after if c.heading_path == ["B"]
    }


def test_a_long_code_block_stops_its_document_only(spark):
    docs = frame(spark, "```\n" + "x\n" * 2000 + "```", "fine")
    assert [c.document_id for c in chunking.chunk_corpus(docs).collect()] == ["doc-1"]
    with pytest.raises(ValueError, match="unsplittable_code_block"):
        chunking.require_chunkable(docs)
