"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html as _html
import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import table
from .ordinal import BUCKETS, OrdinalModel, fit

#: Fixed values of HTML: elements without an end, elements whose content is no markup, elements that begin a new block, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul datalist select template".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"), "body": ("head",),
}
#: Start tags of these end an open paragraph.
ENDS_P = BLOCK - {"button", "caption", "datalist", "legend", "option", "select", "template", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "head"}
SCOPE = frozenset("html body article section div td th table ul ol dl main aside nav header footer form blockquote button fieldset figure".split())

#: Elements, roles and words of class or id that mark what isn't the article.
AWAY_TAGS = frozenset("nav footer aside form button dialog menu fieldset head search select datalist template".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
AWAY_WORDS = frozenset(
    "ad ads adbox adsense adsbygoogle advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar sidebars rail aside menu menus nav navbar navigation"
    " topnav subnav breadcrumb breadcrumbs footer pagefooter masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription"
    " signup login comment comments commentlist disqus respond reply replies share sharing sharebar social related recommended recommendations pagination pager toolbar widget widgets"
    " skip search searchform copyright disclaimer legal outbrain taboola hidden".split()
)
NEAR_WORDS = frozenset("article articlebody content post entry story main maintext bodytext text prose markdown".split())

#: Log-odds of a block's own text lie within CAP, so that they can outweigh neither the markup nor all that stands around it.
CAP = 4.0
#: What the markup adds: in `article` or `main`; outside them on a page that has one; within an element named like a text's body.
#: What is within an element that is marked as something else is none whatever else holds (AWAY).
INSIDE, OUTSIDE, NEAR, AWAY = 6.0, -8.0, 3.0, -40.0
#: Pages that fit the classifier, chosen by a hash of the whole page.
FIT_PAGES = 400
#: Blocks of a page up to which all that their own scores don't settle goes through maximum flow.
SMALL = 300
#: Factors of the smoothness that the fit tries.
FACTORS = (0.0, 0.25, 0.5, 1.0, 1.5)
#: Fixed log-odds by feature, which count beside the fitted ones; and, for tables in which no page marks its article, the smoothness by distance in the tree (see _distance).
PRIOR = {"bias": -1.2, "word": 0.9, "sentence": 1.0, "linked": -4.5, "heading": 1.0, "paragraph": 0.8, "item": -0.3, "rights": -3.0}
PRIOR_EDGES = (1.2, 0.9, 0.5, 0.3, 0.1)

_TOKEN = re.compile(r"""<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+|[^>]*+)>|</?[a-zA-Z][^>]*\Z|[^<]++|<""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z|"|')""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SENTENCE = re.compile(r"[.!?…。！？:;,]")
_RIGHTS = re.compile(r"(?:©|\(c\) ?\d{4}|all rights reserved)", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}


@dataclass(slots=True)
class _Element:
    tag: str
    parent: _Element | None
    depth: int
    away: bool = False  # by its tag, role or being hidden
    marked: bool = False  # by its class or id alone
    near: bool = False
    article: bool = False
    block: str = ""  # the nearest block element's tag
    own: bool = False  # it is an article or named like one
    holds: bool = False  # such an element, or a title, is in it
    chars: int = 0


@dataclass(slots=True)
class Block:
    text: str
    element: _Element
    linked: int  # characters within links
    features: dict = field(default_factory=dict)


def _open(tag: str, attrs: str, parent: _Element) -> _Element:
    e = _Element(tag, parent, parent.depth + 1, near=parent.near, article=parent.article, block=tag if tag in BLOCK else parent.block)
    e.own = tag in ("article", "main")
    e.article |= e.own
    e.away = tag in AWAY_TAGS or tag == "header" and not e.article
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                e.away |= value.lower() in AWAY_ROLES
                if value.lower() in ("main", "article"):
                    e.own = e.article = True
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                e.away = True
            elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                words = {w.lower() for w in _WORDS.findall(value)}
                e.marked |= bool(words & AWAY_WORDS) or "header" in words and not e.article
                e.own |= bool(words & NEAR_WORDS)
                e.near |= bool(words & NEAR_WORDS)
            elif name in ("class", "id") and tag == "article":
                e.marked |= bool({w.lower() for w in _WORDS.findall(value)} & {"comment", "comments", "reply", "ad", "advert", "sponsored", "related", "promo"})
    e.holds = e.own or tag == "h1"
    return e


def blocks(page: str) -> tuple[list[Block], list[_Element]]:
    """The page's blocks and elements in order; a block is text between starts and ends of block elements, references decoded, white space single."""
    here = _Element("#", None, 0)
    found: list[Block] = []
    made = [here]
    text: list[str] = []
    linked = in_link = 0
    at, size = 0, len(page)
    scopes = [Counter()]  # open elements by tag, within each open element of SCOPE
    whole: Counter = Counter()  # and in all

    def close(e):
        """Ends all open elements up to e."""
        nonlocal here
        while here is not e.parent:
            if here.tag in SCOPE:
                scopes.pop()
            else:
                scopes[-1][here.tag] -= 1
            whole[here.tag] -= 1
            here = here.parent

    def flush():
        nonlocal linked
        if text:
            if words := " ".join(_html.unescape("".join(text)).split()):
                found.append(Block(words, here, linked))
            text.clear()
        linked = 0

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            part = m[0]
            if part[0] != "<" or len(part) == 1:
                text.append(part)
                if in_link:
                    linked += len(part.strip())
            elif part.startswith("<![CDATA["):
                continue
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag in BLOCK:
                flush()
            if whole[tag] if tag in BLOCK else scopes[-1][tag]:  # else none is open here
                e = here
                while e.tag != tag:
                    e = e.parent
                close(e)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in BLOCK:
            flush()
            closing = CLOSES.get(tag, ()) + (("p",) if tag in ENDS_P else ())
            if closing and (any(scopes[-1][t] for t in closing) or len(scopes) > 1 and any(whole[t] for t in closing if t in SCOPE)):
                e, last = here, None
                while e.parent is not None:
                    if e.tag in closing:
                        last = e
                        if e.tag == "p" or tag == e.tag:
                            break
                    if e.tag in SCOPE and e.tag not in closing:
                        break
                    e = e.parent
                if last is not None:
                    close(last)
        if tag == "a":
            in_link = 1
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        here = _open(tag, m[3], here)
        made.append(here)
        whole[tag] += 1
        if tag in SCOPE:
            scopes.append(Counter())
        else:
            scopes[-1][tag] += 1
    flush()
    return found, made


def _settle(found: list[Block], made: list[_Element]) -> None:
    """Sums texts up the tree and passes on what isn't the article."""
    total = 0
    for b in found:
        b.element.chars += len(b.text)
        total += len(b.text)
    for e in reversed(made[1:]):
        e.parent.chars += e.chars
        e.parent.holds |= e.holds
    held, holder = 0, {id(made[0]): None}  # text in outermost articles; each element's innermost one
    for e in made[1:]:
        outer = holder[id(e.parent)]
        held += e.chars if e.own and outer is None else 0
        holder[id(e)] = e if e.own else outer
    for e in made[1:]:
        # a class that encloses most of the page's text says nothing about a part of it, unless there is an article, or a title and more text, besides
        outer = holder[id(e)]
        besides = held or (total - e.chars) * made[0].holds if outer is None else 0 if outer is e else outer.chars - e.chars
        e.away |= e.parent.away or e.marked and (2 * e.chars <= total or not e.holds and 10 * besides >= e.chars)


def _kind(tag: str) -> str:
    return "h" if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else "p" if tag in ("p", "blockquote", "pre") else "i" if tag in ("li", "td", "th", "dd", "dt", "option") else "o"


def _prior(found: list[Block]) -> list[float]:
    scores = []
    for b in found:
        words = b.text.count(" ") + 1
        s = PRIOR["bias"] + PRIOR["word"] * math.log1p(words) + PRIOR["linked"] * min(1.0, b.linked / max(1, len(b.text)))
        s += {"h": PRIOR["heading"], "p": PRIOR["paragraph"], "i": PRIOR["item"], "o": 0.0}[_kind(b.element.block)]
        if _SENTENCE.search(b.text, max(0, len(b.text) - 1)) or words > 15 and _SENTENCE.search(b.text):
            s += PRIOR["sentence"]
        if words < 40 and _RIGHTS.search(b.text):
            s += PRIOR["rights"]
        scores.append(max(-CAP, min(CAP, s)))
    return scores


def _markup(found: list[Block]) -> list[float]:
    """What the markup around each block adds to its score."""
    has_article = any(b.element.article and not b.element.away for b in found)
    return [AWAY if e.away else (NEAR if e.near else 0.0) + (INSIDE if e.article else OUTSIDE if has_article else 0.0) for e in (b.element for b in found)]


def features(found: list[Block]) -> list[list[str]]:
    """For each block the names of its text's and links' features. Its element's kind isn't one: where articles are all of `p` and adverts of
    `div`, it would stand for the article. Where a block stands is left to the smoothness, and what the markup says to _markup."""
    out = []
    for b in found:
        size, linked = min((b.text.count(" ") + 1).bit_length(), 9), math.ceil(4 * min(1.0, b.linked / max(1, len(b.text))))
        end = bool(_SENTENCE.search(b.text, max(0, len(b.text) - 1)))
        names = [f"w{size}", f"l{linked}", f"s{end}", f"lw{linked}{size}", f"sw{end}{size}"]
        if size < 6 and _RIGHTS.search(b.text):
            names.append("rights")
        out.append(names)
    return out


class _Buckets(dict):
    def __missing__(self, name):
        if len(self) > 100_000:  # names are any text
            self.clear()
        self[name] = found = zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS
        return found


@dataclass(frozen=True)
class BlockModel:
    """Log-odds of being content by hashed features, and the smoothness between blocks by their distance in the tree."""

    classifier: OrdinalModel
    edges: tuple[float, ...]

    def scores(self, features_: list[list[str]]) -> list[float]:
        weights, buckets, edge = self._weights()
        found = [math.fsum(weights.get(x, 0.0) for x in {buckets[f] for f in names}) - edge for names in features_]
        return [max(-CAP, min(CAP, s)) for s in found]

    def _weights(self):
        if "w" not in (held := self.__dict__):
            object.__setattr__(self, "w", (dict(zip(self.classifier.buckets.tolist(), self.classifier.values.tolist(), strict=True)), _Buckets(), self.classifier.thresholds[0]))
        return held["w"]

    def __getstate__(self):
        return {"classifier": self.classifier, "edges": self.edges}

    def __setstate__(self, state):
        self.__dict__.update(state)


def _apart(a: _Element, b: _Element) -> int:
    """Steps between them in the tree; further than 40 is far enough."""
    steps = 0
    while a is not b and steps < 40:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def _distance(a: _Element, b: _Element) -> int:
    """0: one element; 1: one parent; 2 to 4: up to 3, up to 5 and more steps apart."""
    if a is b:
        return 0
    if a.parent is b.parent:
        return 1
    steps = _apart(a, b)
    return 2 if steps <= 3 else 3 if steps <= 5 else 4


def _together(a: _Element, b: _Element) -> bool:
    return a.away == b.away and a.article == b.article


def _edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Neighbours, and the last block before that has the same parent, with their distance. None crosses the border of the article or of what
    is marked as something else."""
    links, last = [], {}
    for i, b in enumerate(found):
        if i and _together(found[i - 1].element, b.element):
            links.append((i - 1, i, _distance(found[i - 1].element, b.element)))
        parent = id(b.element.parent or b.element)
        if (j := last.get(parent, i)) < i - 1 and _together(found[j].element, b.element):
            links.append((j, i, 1))
        last[parent] = i
    return links


def minimum_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels with the least sum of terminal costs (a positive score is paid when labelled False, a negative one's size
    when labelled True) and of the links between unlike labels. Of equal cuts the one with the least content is
    taken. A block whose score outweighs its links is settled at once, which is part of that cut; the rest goes through maximum flow. Of many blocks (SMALL) those are settled too that outweigh what is left
    of their links then, as often as there are some, which keeps the flow small and the cut minimal."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in links:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    score, label = list(scores), [None] * n
    pull = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and (score[i] > pull[i] or -score[i] >= pull[i]):
            label[i] = score[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    score[j] += w if label[i] else -w
                    pull[j] -= w
                    if n > SMALL:
                        queue.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, content in zip(left, _max_flow([score[i] for i in left], _renamed(left, near, label)), strict=True):
            label[i] = content
    return label


def _renamed(left, near, label):
    at = {i: k for k, i in enumerate(left)}
    return [{at[j]: w for j, w in near[i].items() if label[j] is None} for i in left]


def _max_flow(score: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Augmenting shortest paths from blocks with a positive rest to those with a negative one; then what the positive rest reaches is content."""
    n = len(score)
    rest, cap = list(score), [dict(x) for x in near]
    while True:
        before = {i: None for i in range(n) if rest[i] > 1e-12}
        queue, end = deque(before), None
        while queue and end is None:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-12 and j not in before:
                    before[j] = i
                    if rest[j] < -1e-12:
                        end = j
                        break
                    queue.append(j)
        if end is None:
            return [i in before for i in range(n)]
        path, j = [], end
        while before[j] is not None:
            path.append((before[j], j))
            j = before[j]
        flow = min(rest[j], -rest[end], *[cap[a][b] for a, b in path])
        rest[j] -= flow
        rest[end] += flow
        for a, b in path:
            cap[a][b] -= flow
            cap[b][a] = cap[b].get(a, 0.0) + flow


def labels(found: list[Block], made: list[_Element], model: BlockModel | None, markup: bool = True, cut: bool = True) -> list[bool]:
    """Content or not, of each block. markup: whether what is around the blocks counts; cut: whether smoothness does."""
    _settle(found, made)
    scores = _prior(found)
    if model is not None:  # half and half, so that a table whose adverts read like articles doesn't make all text suspect
        scores = [(a + b) / 2 for a, b in zip(scores, model.scores(features(found)), strict=True)]
    if markup:
        scores = [a + b for a, b in zip(scores, _markup(found), strict=True)]
    edges = PRIOR_EDGES if model is None else model.edges
    return minimum_cut(scores, [(i, j, edges[d]) for i, j, d in _edges(found)] if cut else [])


def main_text(page: str | None, model: BlockModel | None = None) -> str:
    found, made = blocks(page or "")
    return "\n".join(b.text for b, content in zip(found, labels(found, made, model), strict=True) if content)


def _taught(page: str | None) -> tuple[list[list[str]], list[int], list[tuple[int, int, int]]] | None:
    """Features, distant labels and edges of a page that marks its article: content is what stands in `article` or `main` and under nothing
    that is marked as something else."""
    found, made = blocks(page or "")
    _settle(found, made)
    label = [int(b.element.article and not b.element.away) for b in found]
    return (features(found), label, _edges(found)) if any(label) else None


def fit_blocks(pages: list[str | None]) -> BlockModel | None:
    """A model of the blocks of those pages that mark their article; None without any.

    Text and links are fitted; what the markup says is fixed (_markup), or the fit would leave it out wherever the text tells as much on the
    pages at hand. The smoothness by distance is half the log odds that blocks so far apart have one label, times the factor of FACTORS that
    labels most blocks rightly on the second half of the pages, by text alone, under a classifier of the first half; of equally good
    factors the one nearest to 1."""
    taught = [t for t in map(_taught, pages) if t]
    if not taught:
        return None
    buckets = _Buckets()

    def classifier(part: list) -> OrdinalModel:
        forms = Counter((tuple(sorted({buckets[n] for n in names})), c) for blocks_, label, _ in part for names, c in zip(blocks_, label, strict=True))
        rows = sorted((names, c, times) for (names, c), times in forms.items())  # equal ones are one row of the fit
        return fit([np.array(names) for names, _, _ in rows], np.array([c for _, c, _ in rows]), np.array([float(times) for _, _, times in rows]), 2, l1=1e-4, least_rows=1)

    same = np.ones((len(PRIOR_EDGES), 2))
    for _, label, edges in taught:
        for i, j, d in edges:
            same[d, int(label[i] == label[j])] += 1
    smooth = np.maximum.accumulate(np.clip(0.5 * np.log(same[:, 1] / same[:, 0]), 0, CAP / 2)[::-1])[::-1]  # never less between nearer blocks
    half = BlockModel(classifier(taught[: -(-len(taught) // 2)]), (0.0,) * len(smooth))
    tried = []
    held = [(half.scores(f), label, edges) for f, label, edges in taught[len(taught) // 2 :]]
    for factor in FACTORS:
        right = sum(int(a) == c for scores, label, edges in held for a, c in zip(minimum_cut(scores, [(i, j, factor * float(smooth[d])) for i, j, d in edges]), label, strict=True))
        tried.append((right, -abs(factor - 1), factor))
    factor = max(tried)[2]
    return BlockModel(classifier(taught), tuple(factor * float(x) for x in smooth))


def fit_pages(pages: DataFrame, html_col: str = "html", n_pages: int = FIT_PAGES) -> BlockModel | None:
    """A model fitted on about n_pages pages, chosen by a hash of the whole page (every page if there are fewer)."""
    total = pages.count()
    page = F.xxhash64(html_col)
    draw = F.shiftrightunsigned(F.xxhash64(page, F.lit(7)), 11) / F.lit(float(1 << 53))
    # n_pages pages and twice that at most, unless copies of one page are many
    chosen = pages.select(page.alias("h"), F.col(html_col).alias("html")).filter(draw < F.lit(n_pages / max(1, total))).orderBy("h", F.length("html")).limit(2 * n_pages).collect()
    return fit_blocks([r["html"] for r in chosen])


def extract(html: Column, model: BlockModel | None = None) -> Column:
    """The main text: content blocks in page order, one a line. Null, empty and pages without content give an empty string."""

    @arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p.as_py(), model) for p in pages], pa.string())

    return texts(html)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: BlockModel | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Blocks are classified by a model fitted on a bounded sample of the pages (fit_pages) unless one is given, and labelled by the minimum
    cut. Where no page marks its article, PRIOR stands in for the model. Null ids and urls stay; repeated rows are rows like others; other
    columns are ignored; an empty table gives no rows. Whole pages are read, and nothing is capped."""
    model = model or fit_pages(pages, html_col)
    out = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), extract(F.col(html_col), model).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op7(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
