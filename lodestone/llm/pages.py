"""Main text of raw web pages by scores on the element tree.

Every paragraph passes points to its ancestors: one, one for each comma, and up to three
for length, in full to the parent, half to the grandparent, less further up. A container's
sum is discounted by its link density (the share of its characters inside links). The best
container is kept (the article around it, if there is one), with those of its siblings
that score well or are text paragraphs. Menus, page headers and footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are cut out: by element and role before
anything is scored, forms and the words of class and id only after the scores of the whole tree. An
element with such a name stays, its points halved, if it holds the article or a first heading,
or most of the points and no article or heading stands outside it; inside an article also if it
has a paragraph and its name (`WEAK_WORDS`) may be that of a section. In a name, words
behind `no`, `has`, `with` and the like do not count. If nothing is left, names are ignored.
A form is judged like such an element, so that one around the page is a container; only with
`FORM_POINTS` or more can most of the points make it one, and it is never a section.

Time and memory grow with the length of a page also where it is nested very deeply, closes
elements that are not open, or ends inside tags: points halve at each ancestor until they add
nothing, and the open elements of each name are known.

Character references are decoded, white space inside a block becomes one space, blocks
are joined in page order by one space. Nothing else is dropped.

Cases: null or empty html, or a page without text outside the parts cut out, gives an empty
text; broken and unclosed elements are closed as browsers do for paragraphs and list items;
rows with one page_id are extracted each; null page_id and url stay null.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tables import read

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CUT = frozenset(
    "head script style noscript template nav footer aside button select option textarea input label iframe object svg "
    "canvas audio video map dialog menu math title".split()
)
#: Cut too, unless the tree says that it is a container.
FORM = "form"
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe subscription newsletter signup "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc sidebar aside rail widget widgets "
    "footer foot header masthead topbar toolbar social share sharing related recommended comment comments disqus respond replies "
    "reply discussion reviews login search skip".split()
)
#: Those of them that also name sections of an article.
WEAK_WORDS = frozenset(
    "notice notices alert share sharing related recommended discussion reviews search respond replies reply login promotion "
    "promoted consent subscription notification notifications navigation menu menus rail foot head header skip".split()
)
#: In a compound name the words behind these say what else the page has, or lacks.
ABOUT = frozenset("no not non has have with without hide hides hidden".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PARAGRAPHS = frozenset(("p", "td", "pre", "blockquote", "li", "dd", "div", "section", "article", "main", *HEADINGS))
#: Elements whose start closes an open one of the same kind, up to the given containers.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Elements whose start closes an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "legend", "summary"}
TOKENS = re.compile(r"[A-Za-z]+")
BLANKS = re.compile(r"\s+")
SIBLING_SHARE, SIBLING_CHARS, SIBLING_LINKS = 0.2, 80, 0.25
UNLIKELY_SHARE = 0.5
FORM_POINTS = 4.0
#: Points below this are not passed on.
LEAST_POINTS = 1e-9
COMMENT_END = re.compile(r"--\s*>")


def _name_words(names: str) -> set[str]:
    """The words of class or id names that speak of the element itself."""
    found = set()
    for name in names.split():
        for word in TOKENS.findall(name.lower()):
            if word in ABOUT:
                break
            found.add(word)
    return found


class Tree(HTMLParser):
    """Elements as parallel lists, and text runs as (element, block, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.cut, self.inside = ["#root"], [-1], [False], [False]
        #: The words of `CUT_WORDS` in an element's names.
        self.names: list[set[str]] = [set()]
        self.open = [0]
        #: Depths of the open elements of each name.
        self.depths: dict[str, list[int]] = {}
        self.runs: list[tuple[int, int, str]] = []
        self.block = 0
        self.last_comment_end = -1

    def goahead(self, end):
        if end and not self.cdata_elem and ">" not in self.rawdata:
            # Nothing that is open here can end: all of it is text, looked at once.
            if self.rawdata:
                self.handle_data(unescape(self.rawdata))
            self.rawdata = ""
            return
        self.last_comment_end = max((m.start() for m in COMMENT_END.finditer(self.rawdata)), default=-1)
        super().goahead(end)

    def parse_comment(self, i, report=1):
        return super().parse_comment(i, report) if self.last_comment_end >= i else -1

    def _deepest(self, names: tuple[str, ...]) -> int:
        return max((held[-1] for name in names if (held := self.depths.get(name))), default=0)

    def _close_from(self, depth: int) -> None:
        for element in self.open[depth:]:
            self.depths[self.tags[element]].pop()
        del self.open[depth:]

    def _pop_to(self, names: tuple[str, ...], within: tuple[str, ...]) -> None:
        depth = self._deepest(names)
        if depth and depth > self._deepest(within):
            self._close_from(depth)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._pop_to(("p",), ("button", "td", "th", "table", "article", "section", "div", "body"))
        if tag in CLOSES:
            self._pop_to(*CLOSES[tag])
        if tag in BLOCKS:
            self.block += 1
        if tag in VOID:
            return
        parent = self.open[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        inside = self.inside[parent] or self.tags[parent] in ("article", "main")
        self.inside.append(inside)
        self.cut.append(self.cut[parent] or self._is_cut(tag, attrs, inside))
        self.names.append(self._unlikely(tag, attrs, inside))
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.tags) - 1)

    def _is_cut(self, tag, attrs, inside) -> bool:
        if tag in CUT or (tag == "header" and not inside):
            return True
        if tag in ("html", "body", "article", "main") or not attrs:
            return False
        known = dict(attrs)
        return "hidden" in known or (known.get("role") or "").lower() in CUT_ROLES or known.get("aria-hidden") == "true"

    def _unlikely(self, tag, attrs, inside) -> set[str]:
        if tag == FORM or (attrs and (dict(attrs).get("role") or "").lower() == FORM):
            return {FORM}
        if tag in ("html", "body", "article", "main") or not attrs:
            return set()
        known = dict(attrs)
        words = {w for name in ("class", "id") for w in _name_words(known.get(name) or "")}
        return words & (CUT_WORDS if not inside else CUT_WORDS - {"header"})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.block += 1
        if depth := self._deepest((tag,)):
            self._close_from(depth)

    def handle_data(self, data):
        if not self.cut[self.open[-1]]:
            self.runs.append((self.open[-1], self.block, data))


def _scores(tree: Tree, gone: list[bool], share: list[float]) -> tuple[list[float], list[int], list[float]]:
    """(score, characters, worth of its own text) of every element; share: what its points count."""
    size = len(tree.tags)
    chars, linked, commas = [0] * size, [0] * size, [0] * size
    owner: dict[int, int] = {}
    in_link = [False] * size
    for i in range(1, size):
        in_link[i] = tree.tags[i] == "a" or in_link[tree.parents[i]]
    for node, _, text in tree.runs:
        count = len(text.strip())
        if not count or gone[node]:
            continue
        if node not in owner:
            up = node
            while up > 0 and tree.tags[up] not in PARAGRAPHS:
                up = tree.parents[up]
            owner[node] = up
        own = owner[node]
        chars[own] += count
        commas[own] += text.count(",")
        linked[own] += count * in_link[node]
    points, worths = [0.0] * size, [0.0] * size
    for own in set(owner.values()):
        if own <= 0 or not chars[own]:
            continue
        worth = (1 + commas[own] + min(chars[own] / 100, 3)) * (1 - linked[own] / chars[own]) * share[own]
        worths[own] = worth
        part, up = worth, tree.parents[own]
        if tree.tags[own] not in ("p", "pre", "li", "td", "dd", *HEADINGS):
            points[own] += worth  # text straight inside a container
        while up > 0 and part > LEAST_POINTS:
            points[up] += part
            part, up = part / 2, tree.parents[up]
    total, total_linked = chars[:], linked[:]
    for i in range(size - 1, 0, -1):
        total[tree.parents[i]] += total[i]
        total_linked[tree.parents[i]] += total_linked[i]
    return [p * (1 - (total_linked[i] / total[i] if total[i] else 0)) for i, p in enumerate(points)], total, worths


def _gone(tree: Tree) -> tuple[list[bool], list[float]]:
    """Of every element, whether it goes for its names, and what its points count if not."""
    size = len(tree.tags)
    gone, share = [False] * size, [1.0] * size
    if not any(tree.names):
        return gone, share
    held = _scores(tree, gone, share)[2]
    paragraphs = [tree.tags[i] == "p" and held[i] > 0 for i in range(size)]
    heads = [tree.tags[i] == "h1" and not tree.cut[i] for i in range(size)]
    for i in range(size - 1, 0, -1):
        up = tree.parents[i]
        held[up] += held[i]
        paragraphs[up] |= paragraphs[i]
        heads[up] |= heads[i]
    leads = [i for i in range(size) if tree.tags[i] == "article" and held[i] > 0] or [i for i in range(size) if tree.tags[i] == "main" and held[i] > 0]
    up = max(leads, key=held.__getitem__, default=-1)
    around = set()
    while up > 0:
        around.add(up)
        up = tree.parents[up]
    elsewhere = bool(leads) or heads[0]
    for i in range(1, size):
        up = tree.parents[i]
        gone[i], share[i] = gone[up], share[up]
        if tree.names[i]:
            share[i] = UNLIKELY_SHARE
            most = 2 * held[i] > held[0] and not elsewhere and (FORM not in tree.names[i] or held[i] >= FORM_POINTS)
            section = tree.inside[i] and paragraphs[i] and tree.names[i] <= WEAK_WORDS
            gone[i] |= not (i in around or heads[i] or most or section)
    return gone, share


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    if not tree.runs:
        return ""
    gone, share = _gone(tree)
    text = _chosen(tree, gone, share)
    if text or not any(gone):
        return text
    forms = [False] * len(gone)
    for i in range(1, len(gone)):  # the names are ignored, not what forms hold
        forms[i] = forms[tree.parents[i]] or (gone[i] and FORM in tree.names[i])
    return _chosen(tree, forms, [1.0] * len(gone))


def _chosen(tree: Tree, gone: list[bool], share: list[float]) -> str:
    """The text of the best container and its good siblings, without elements that are gone."""
    scores, chars, _ = _scores(tree, gone, share)
    best = max(range(len(scores)), key=scores.__getitem__)
    up = best
    while up > 0:  # the article around the best container is the whole of it
        if tree.tags[up] in ("article", "main"):
            best = up
        up = tree.parents[up]
    kept = {best}
    if best > 0 and tree.tags[best] not in ("article", "main", "body", "html"):
        for i in range(1, len(scores)):
            if i == best or tree.parents[i] != tree.parents[best] or tree.cut[i] or gone[i]:
                continue
            text = tree.tags[i] == "p" and chars[i] >= SIBLING_CHARS
            if scores[i] >= SIBLING_SHARE * scores[best] or text or tree.tags[i] in HEADINGS:
                kept.add(i)
    inside = [False] * len(scores)
    for i in range(len(scores)):
        inside[i] = i in kept or (i > 0 and inside[tree.parents[i]])
    blocks: list[list[str]] = []
    last = None
    for node, block, text in tree.runs:
        if inside[node] and not gone[node]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    texts = (BLANKS.sub(" ", "".join(parts)).strip() for parts in blocks)
    return " ".join(t for t in texts if t)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            own = batch.slice(low, 500)
            texts = [extract(h.as_py()) for h in own.column(2)]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
ORACLE: dict[str, str] = {}
