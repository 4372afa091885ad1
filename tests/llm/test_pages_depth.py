"""Pages that are nested deeply, broken in many places, or wrapped in a form."""

import time

import pytest

from lodestone.llm import pages

BODY = "<p>Some, text here, of a certain length, to be scored well enough, yes.</p>" * 6
TEXT = " ".join(["Some, text here, of a certain length, to be scored well enough, yes."] * 6)
BROKEN = {
    "nested": lambda n: "<div>" * n + BODY + "</div>" * n,
    "stray ends": lambda n: "<b>" * n + "</i>" * n + BODY,
    "comments": lambda n: "<!-- > " * n + BODY,
    "open tags": lambda n: BODY + "<a " * n,
    "open values": lambda n: BODY + "<a b='" * n,
    "headings in a button": lambda n: BODY + "<p><button>" + "<b>" * n + "<h1>" * n,
    "paragraphs": lambda n: "<b>" * n + "<p>x, y" * n + BODY,
}


@pytest.mark.parametrize("kind", BROKEN)
def test_work_grows_with_the_page(kind):
    taken = []
    for n in (10_000, 100_000):
        started = time.process_time()
        assert TEXT in pages.extract(BROKEN[kind](n))
        taken.append(time.process_time() - started)
    assert taken[1] < 40 * max(taken[0], 0.02)


def test_forms():
    inner = f"<div class=menu><a href=/>Home</a></div>{BODY}"
    for page in (f"<form>{inner}<input></form>", f"<form><h1>T</h1>{inner}</form>", f"<form><article>{BODY}</article></form>", f"<form role=form><main>{BODY}</main></form>"):
        assert TEXT in pages.extract(f"<body>{page}</body>") and "Home" not in pages.extract(f"<body>{page}</body>")
    reply = "<form><p>Your comment, please, here.</p><textarea>x</textarea></form>"
    assert pages.extract(f"<body><article>{BODY}{reply}</article></body>") == TEXT
    assert pages.extract(f"<body><div>{BODY}</div>{reply}</body>") == TEXT
    assert pages.extract(f"<body>{reply}</body>") == ""
    assert pages.extract(f"<body><div class=ad>Only this</div>{reply}</body>") == "Only this"


def test_text_of_an_unfinished_end_stays():
    assert pages.extract("<p>one <b>two</b> &amp; three <a") == "one two & three <a"
    assert pages.extract("<p>one</p><!-- gone --> two <!-- open > three") == "one two <!-- open > three"
