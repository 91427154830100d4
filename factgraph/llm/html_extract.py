"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into blocks of text. A classifier gives each block a cost of calling it content and one of calling it
boilerplate; these are the capacities to the two terminals. Blocks that follow each other, and blocks close in the DOM, are
joined by smoothness edges. The minimum cut (by maximum flow) is the cheapest labelling of the whole page.

The classifier is a logistic regression on what a block's text looks like and what the names around it hint at. ``fit`` trains it
on blocks whose place in elements of known meaning labels them (within ``article`` and ``main``, or outside them and within
``nav``, ``footer`` and the like), starting from weights that are kept where there is no evidence. So a class name weighs what it
is worth on these pages, for or against; text without links outweighs a doubtful one. What the elements themselves mean is added.
Parsing and scoring take time in proportion to a page, however deep or broken it is.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches
from .tokens import release

# Element names of the HTML standard, and words that sites use in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title select option textarea iframe svg object canvas math".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym area b bdi bdo big button cite code data del dfn em embed font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond responses disqus".split())
BOILERPLATE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead newsletter subscribe subscription signup popup modal "
    "login pagination pager contentinfo tagcloud outbrain taboola".split()
)
DOUBTFUL_WORDS = frozenset(
    "notice notices alert aside widget widgets discussion share sharing social related recommended recommendations overlay toolbar search "
    "complementary tags toc skip copyright legal disclaimer form".split()
)
MAIN_WORDS = frozenset("article articlebody content main post entry story body text maincontent".split())
FRAME_WORDS = MAIN_WORDS | frozenset("area bar block bottom box col column container group head header heading holder inner item items left link links list module outer panel right row section site thread title top unit user wrap wrapper zone".split())
LINKS = frozenset("a button".split())
SIBLINGS_CLOSE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
STOPS = frozenset("article section div main td th table body ul ol nav aside footer header form".split())

#: Weights of a block's features before training: tenths of its words (up to ``WORDS``), fewer than four words, the end of a
#: sentence, the share of its text within links and buttons, a heading, a copyright notice, a name around it that speaks plainly
#: against it, the strength of doubtful ones, and one for all.
FEATURES = ("words", "short", "sentence", "links", "heading", "copyright", "named", "doubtful", "one")
START = (1.0, -0.5, 0.5, -6.0, 1.0, -4.0, -8.0, -8.0, 0.0)
WORDS = 25
#: Strength of a name that is a doubtful word, of one that has a plain word among others ("with-sidebar"), and a doubtful one
#: among others ("social-issues").
DOUBTFUL, AMONG, DOUBTFUL_AMONG = 0.4, 0.3, 0.15
#: What elements add to the score of blocks in them: such as are boilerplate by their meaning; articles; names that are for it;
#: to blocks outside all articles of a page that has some, and to those that stand beside an article in the same ``main``.
AGAINST, FOR, NAMED_FOR, OUTSIDE, BESIDE = 12.0, 4.0, 2.0, 5.0, 3.0
#: The share of a page's text that its articles must have for what is outside to be judged by that.
ARTICLES = 0.2
#: Costs of an edge between blocks that follow each other as siblings, and of one between blocks under the same grandparent.
SMOOTH, NEAR = 2.0, 0.8
#: Pages that the classifier is trained on, and the share of the evidence that the first weights count.
SAMPLE_PAGES, PRIOR = 400, 0.1
#: Blocks of that many words and more, with less than half their text in links, are text that a page may be about.
_SOLID = 5

_TAG = re.compile(r"""</?([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: A tag with a quote that nothing closes: it ends at the next ``>``.
_BROKEN = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*+)([^<>]*+)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
_ENDS = frozenset(".!?…\"»”")


@functools.lru_cache(maxsize=4096)
def _hints(tag: str, attributes: str) -> tuple[bool, float, bool, bool]:
    """Of an element: whether it is boilerplate by its meaning, or hidden; how strongly names speak against it (1 plainly), and
    whether they call it readers' comments; whether names speak for it."""
    hidden, strength, comments, good = tag in BOILERPLATE_TAGS, 0.0, False, False
    if tag in ("html", "body"):
        return False, 0.0, False, False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name in ("class", "id", "role"):
            for own in value.split():
                words = {w.lower() for w in _WORD.findall(own)}
                plain, doubtful = not words.isdisjoint(BOILERPLATE_WORDS), not words.isdisjoint(DOUBTFUL_WORDS)
                alone = words <= BOILERPLATE_WORDS | DOUBTFUL_WORDS | FRAME_WORDS
                if plain or doubtful:
                    strength = max(strength, (1.0 if plain else DOUBTFUL) if alone else AMONG if plain else DOUBTFUL_AMONG)
                    comments |= alone and not words.isdisjoint(COMMENT_WORDS)
                else:
                    good |= not words.isdisjoint(MAIN_WORDS)
    return hidden, strength, comments, good and strength < 1


class Page:
    """Blocks of a page and the elements around them, by number; an element's parent has a smaller number."""

    def __init__(self, source: str):
        self.tags, self.parents, self.hidden, self.strength, self.comments, self.good = ["#"], [0], [False], [0.0], [False], [False]
        #: Text, element, characters within links, the element's depth, and the least depth since the block before.
        self.blocks: list[tuple[str, int, int, int, int]] = []
        self._stack, self._low = [0], 0
        #: Depths of open elements by tag, and of those that stop a search for an element to close.
        self._open_at: dict[str, list[int]] = defaultdict(list)
        self._stops, self._solid = [0], [0]
        self._text: list[str] = []
        self._links, self._in_link, self._dropped = 0, 0, 0
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, end, sections = 0, len(source), True
        while at < end:
            m = source.find("<", at)
            if m < 0:
                self._add(source[at:])
                return
            if m > at:
                self._add(source[at:m])
            if source.startswith("<!--", m):
                close = source.find("-->", m + 4)
                at = close + 3 if close >= 0 else end
            elif sections and source.startswith("<![CDATA[", m) and (close := source.find("]]>", m)) >= 0:
                at = close + 3
            elif source.startswith(("<!", "<?"), m):
                sections = sections and not source.startswith("<![CDATA[", m)  # no end is left to look for
                close = source.find(">", m)
                at = close + 1 if close >= 0 else end
            elif tag := _TAG.match(source, m) or _BROKEN.match(source, m):
                at = self._tag(source, tag)
            else:
                self._add("<")
                at = m + 1

    def _tag(self, source: str, m: re.Match) -> int:
        tag, at = m[1].lower(), m.end()
        if source[m.start() + 1] == "/":
            self._close(tag)
            return at
        self._open(tag, m[2])
        if tag in RAW and not m[2].endswith("/"):
            close = re.compile(rf"</{tag}\s*+>", re.I).search(source, at)
            at = close.end() if close else len(source)
            self._close(tag)
        return at

    def _add(self, raw: str) -> None:
        if self._dropped:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._in_link:
            self._links += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                depth = len(self._stack) - 1
                self.blocks.append((text, self._stack[-1], self._links, depth, min(self._low, depth)))
                self._low = depth
            self._text, self._links = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
        if tag in VOID or attributes.endswith("/") and tag in INLINE:
            return
        if tag in CLOSES_P:
            self._implied({"p"})
        if tag in SIBLINGS_CLOSE:
            self._implied(SIBLINGS_CLOSE[tag])
        if tag in LINKS:
            self._in_link += 1
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        for own, value in zip((self.hidden, self.strength, self.comments, self.good), _hints(tag, attributes)):
            own.append(value)
        depth = len(self._stack)
        self._open_at[tag].append(depth)
        if tag in STOPS:
            self._stops.append(depth)
        if tag not in INLINE:
            self._solid.append(depth)
        self._stack.append(len(self.tags) - 1)
        self._dropped += tag in DROPPED

    def _innermost(self, tag: str) -> int:
        depths = self._open_at.get(tag)
        return depths[-1] if depths else 0

    def _implied(self, tags: set[str]) -> None:
        """Close the innermost of ``tags``, if nothing that stops the search is open within it."""
        depth = max(map(self._innermost, tags))
        if depth and depth >= self._stops[-1]:
            self._cut(depth)

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        depth = self._innermost(tag)
        if depth and (tag not in INLINE or depth > self._solid[-1]):
            self._cut(depth)

    def _cut(self, depth: int) -> None:
        for e in self._stack[depth:]:
            tag = self.tags[e]
            self._dropped -= tag in DROPPED
            self._in_link -= tag in LINKS
            self._open_at[tag].pop()
        del self._stack[depth:]
        for depths in (self._stops, self._solid):
            while depths[-1] >= depth:
                depths.pop()
        self._low = min(self._low, depth - 1)


def _counts(text: str, links: int) -> tuple[int, bool, int, bool]:
    """Words (up to ``WORDS``), whether a sentence ends it, tenths of it within links, and whether it is a copyright notice."""
    start = text[:40]
    return min(WORDS, text.count(" ") + 1), text[-1] in _ENDS, min(10, 10 * links // len(text)), "©" in start or "copyright" in start.lower()


def _features(words: int, sentence: bool, links: int, notice: bool, heading: bool, named: bool, doubtful: int) -> tuple[float, ...]:
    return words / 10, float(words < 4), float(sentence), links / 10, float(heading), float(notice), float(named), doubtful / 100, 1.0


class _Around:
    """What stands around the blocks of a page: of each element, with those that it is in.

    ``hidden``: boilerplate by meaning; ``named`` plainly by name, ``doubtful``: the strongest doubtful name, in hundredths;
    ``good``, ``heading``, ``header``; ``tagged``: within an article by tags alone; ``inside``: within an article that is not
    itself in a plainly named element, nor such an element in it; ``outside``, ``beside`` of articles, where these count.

    A plain name is pardoned where it wraps the page: it holds all articles; or nothing else in its article, or on a page without
    articles nothing else at all, is text that a page may be about, and it has most of the text and is not named as readers'
    comments, unless the page's title is in it.
    """

    def __init__(self, page: Page):
        self.page, n = page, len(page.tags)
        self.weight = [0] * n
        for text, e, links, *_ in page.blocks:
            self.weight[e] += len(text) - min(links, len(text))
        main = [t in MAIN_TAGS for t in page.tags]
        held = [int(m and not page.hidden[e] and page.strength[e] < 1) for e, m in enumerate(main)]
        for e in range(n - 1, 0, -1):
            self.weight[page.parents[e]] += self.weight[e]
            held[page.parents[e]] += held[e]
        self.hidden = self._spread(list(page.hidden))
        self.plain = [s == 1 and not 0 < held[e] == held[0] for e, s in enumerate(page.strength)]
        self._scopes(main)
        self._pardon([e for e in range(n) if self.root[e] == e and e])
        if not any(self.root):
            self._pardon([0])
        self._scopes(main)
        self.named = self._spread(list(self.plain))
        doubts = [round(100 * s) if s < 1 else 0 for s in page.strength]
        for e in range(1, n):
            doubts[e] = max(doubts[e], doubts[page.parents[e]])
        self.doubtful, self.good = doubts, self._spread(list(page.good))
        self.heading, self.header = self._spread([t in _HEADINGS for t in page.tags]), self._spread([t == "header" for t in page.tags])
        self.tagged = self._spread([m and not h for m, h in zip(main, self.hidden)])
        self.inside = [bool(r) for r in self.root]
        articles = sum(self.weight[e] for e in range(1, n) if self.root[e] == e)
        loose = sum(len(text) - min(links, len(text)) for text, e, links, *_ in page.blocks if not self.hidden[e] and not self.named[e] and not self.inside[e])
        counts = articles > 0 and articles >= ARTICLES * (articles + loose)
        self.outside = [counts and not r for r in self.root]
        own = [0] * n  # text of articles within each main
        for e in range(1, n):
            if page.tags[e] == "article" and self.root[e] and self.root[e] != e and not self.article[page.parents[e]]:
                own[self.root[e]] += self.weight[e]
        self.beside = [bool(r) and not self.article[e] and 2 * own[r] >= self.weight[r] > 0 for e, r in enumerate(self.root)]

    def _spread(self, flags: list[bool]) -> list[bool]:
        for e in range(1, len(flags)):
            flags[e] = flags[e] or flags[self.page.parents[e]]
        return flags

    def _scopes(self, main: list[bool]) -> None:
        """Of each element the outermost article that it is in, 0 if none, and whether it is in an ``article`` proper."""
        page, n = self.page, len(self.page.tags)
        self.root, self.article, under = [0] * n, [False] * n, [False] * n
        for e in range(1, n):
            p = page.parents[e]
            under[e] = under[p] or self.hidden[e] or self.plain[e]
            if not under[e]:
                self.root[e] = self.root[p] or (e if main[e] else 0)
                self.article[e] = self.article[p] or page.tags[e] == "article"

    def _pardon(self, scopes: list[int]) -> None:
        """In each of these elements, which are not in one another, pardon the plain name that has nearly all the text, if any has."""
        page, n = self.page, len(self.page.tags)
        scope, outer, solid, tops = [0] * n, [0] * n, set(), set(scopes)
        whole = scopes == [0]
        for e in range(1, n):
            p = page.parents[e]
            scope[e] = e if e in tops else scope[p]
            outer[e] = outer[p] or (e if (self.plain[e] or page.tags[e] == "header" and whole) and (whole or scope[e]) and scope[e] != e else 0)
        best: dict[int, int] = {}
        titled = [t == "h1" for t in page.tags]  # holds a title, as readers' comments don't
        for e in range(n - 1, 0, -1):
            titled[page.parents[e]] |= titled[e]
        for text, e, links, *_ in page.blocks:
            if (whole or scope[e]) and not outer[e] and not self.hidden[e] and text.count(" ") + 1 >= _SOLID and 2 * links < len(text):
                solid.add(scope[e])
        for e in range(1, n):
            if outer[e] == e and self.plain[e] and (titled[e] or not page.comments[e]) and not self.hidden[e] and scope[e] not in solid:
                if scope[e] not in best or self.weight[e] > self.weight[best[scope[e]]]:
                    best[scope[e]] = e
        for e in best.values():
            self.plain[e] = False

    def kind(self, text: str, e: int, links: int) -> tuple:
        """What ``_features`` takes."""
        return *_counts(text, links), self.heading[e], self.named[e], self.doubtful[e]


def scores(page: Page, weights: tuple[float, ...] = START) -> list[float]:
    """Of each block, how much speaks for content."""
    a = _Around(page)
    out = []
    for text, e, links, *_ in page.blocks:
        z = sum(w * x for w, x in zip(weights, _features(*a.kind(text, e, links))))
        z -= AGAINST * a.hidden[e]
        z += NAMED_FOR * (a.good[e] and not a.inside[e] and not a.named[e])
        if a.outside[e]:
            z -= OUTSIDE
        elif a.beside[e] and not a.heading[e]:
            z -= BESIDE
        else:
            z += FOR * a.inside[e]
        if a.header[e]:
            z -= AGAINST * (not a.heading[e]) + AGAINST * (not a.inside[e])
        out.append(z)
    return out


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES, prior: float = PRIOR, id_col: str = "page_id") -> tuple[float, ...]:
    """Weights of the classifier, trained on the blocks of the ``sample`` pages with a html that are first by identifier.

    Tags alone label: blocks within an article are content; those within boilerplate elements are not, nor is what is outside all
    articles of a page that has some. Names and texts don't label, so their weights are learned. Both kinds weigh as much in
    all. Tasks hand on counts of equal blocks, a few thousand rows at most. Without both kinds the weights are ``START``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows = []
            for source in batch.column(0).to_pylist():
                page = Page(source)
                a = _Around(page)
                for text, e, links, *_ in page.blocks:
                    if not a.header[e] and (a.tagged[e] or a.hidden[e] or a.outside[e]):
                        rows.append((a.tagged[e] and not a.hidden[e], *a.kind(text, e, links)))
            columns = [pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(len(_SEEN))]
            yield pa.RecordBatch.from_arrays(columns, _SEEN)

    first = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where("html is not null").orderBy("id", "html").limit(sample)
    seen = first.select("html").repartition(8).mapInArrow(frugal(run), ", ".join(f"{c} long" for c in _SEEN)).groupBy(*_SEEN).agg(F.count(F.lit(1)).alias("n")).orderBy(*_SEEN).collect()
    label = np.array([r["content"] for r in seen], float)
    if not len(label) or label.min() == label.max():
        return START
    x = np.array([_features(*(r[c] for c in _SEEN[1:])) for r in seen])
    n = np.array([r["n"] for r in seen], float)
    share = n / np.where(label == 1, 2 * n[label == 1].sum(), 2 * n[label == 0].sum())
    start = np.array(START)
    weights = start.copy()
    for _ in range(50):  # Newton's method; the prior makes the sum strictly convex
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (p - label)) + prior * (weights - start)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + prior * np.eye(len(start)), slope)
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(w), 9) for w in weights)


_SEEN = ["content", "words", "sentence", "links", "notice", "heading", "named", "doubtful"]


def edges(page: Page) -> list[tuple[int, int, float]]:
    """Smoothness: each block with the one before, by distance in the DOM, and with the last one under the same grandparent."""
    out, seen = [], {}
    for i, (_, element, _, depth, low) in enumerate(page.blocks):
        if i:
            apart = depth + page.blocks[i - 1][3] - 2 * low
            out.append((i - 1, i, SMOOTH / (1 + max(0, apart - 2))))
        near = page.parents[element]
        if near in seen and seen[near] < i - 1:
            out.append((seen[near], i, NEAR))
        seen[near] = i
    return out


def minimum_cut(z: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that cost least: a block pays ``-z`` as content or ``z`` otherwise if that is positive, an edge its weight if its ends differ.

    Blocks whose score outweighs all their edges are settled first, which changes nothing in the result; maximum flow
    (shortest augmenting layers) labels the rest. Of equal cuts the one with fewest blocks of content is taken.
    """
    n = len(z)
    z = list(z)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(z[i]) > sum(near[i].values()):
            label[i] = z[i] > 0
            for j, w in near[i].items():
                z[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return [bool(x) for x in label]
    source, sink = n, n + 1
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
    for i in rest:
        a, b, c = (source, i, z[i]) if z[i] > 0 else (i, sink, -z[i])
        cap[a][b] = c
        cap[b][a] = cap[b].get(a, 0.0)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            break
        todo = {u: iter(list(cap[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] <= 1e-9)
                del path[cut + 1 :]
                todo[path[-1]] = iter(list(cap[path[-1]]))
                continue
            step = next((v for v in todo[u] if cap[u][v] > 1e-9 and level.get(v, -1) == level[u] + 1), None)
            if step is None:
                path.pop()
                level[u] = -1
            else:
                path.append(step)
    for i in rest:
        label[i] = level.get(i) is not None
    return [bool(x) for x in label]


def labelled(page: Page, weights: tuple[float, ...] = START) -> tuple[list[bool], int]:
    """Which blocks are content, and how many labels the cut changes against the classifier alone."""
    z = scores(page, weights)
    keep = minimum_cut(z, edges(page))
    return keep, sum(k != (s > 0) for k, s in zip(keep, z))


def main_text(source: str | None, weights: tuple[float, ...] = START) -> str:
    """The article's text: blocks in page order, joined by a space; empty for a null or empty page or one without any."""
    page = Page(source or "")
    return " ".join(text for (text, *_), k in zip(page.blocks, labelled(page, weights)[0]) if k)


def extract(pages: DataFrame, weights: tuple[float, ...] = START, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col``, ``url_col``, ``text``, ``n_chars``, ``n_blocks``, ``n_mended`` (labels that the cut changed).

    A null html is an empty page. Repeated rows and null identifiers stay as they are; other columns, whatever their names, are
    left out; an empty table gives none. Pages of any length are read whole, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for source in part.column(2):
                    page = Page(source.as_py() or "")
                    keep, mended = labelled(page, weights)
                    text = " ".join(t for (t, *_), k in zip(page.blocks, keep) if k)
                    out.append((text, len(text), len(keep), mended))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], [id_col, url_col, "text", "n_chars", "n_blocks", "n_mended"])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(frugal(run), f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long, n_blocks long, n_mended long")
