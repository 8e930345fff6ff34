"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with the path of tags (and
classes) from the root to it. For each path the mean text length and the mean
number of punctuation marks of its blocks are its ratios. Both are smoothed
over neighbouring blocks, fused to one score, and paths whose score is over a
threshold are content. An article or main that holds most of their text is the
article, also where a path outside of it is over the threshold; else the deepest
element that holds all of them, or the outermost article or main around it. All
its blocks are the result, those of links too, without those inside menus, forms,
notices, adverts, comments and the like. Where that element is only the body, blocks of links before or after all
content that share no element with any are an unmarked menu and left out, but
for headings.

Defined results: a null, empty or textless page gives an empty text; broken
markup is read as browsers do (unclosed tags end with their parent, stray end
tags are ignored, unclosed scripts reach the end); repeated rows are each read;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Attributes with their values, quoted ones of any length; a quote that is never closed is part of a name.
_ATTRIBUTES = r"""(?:[\s/]+|=?[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]*+))?)*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "title", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
#: Start tags that end an open element of these kinds, up to the nearest of the containers.
_ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
#: Elements that are never part of an article's text.
_NEVER = frozenset("script style noscript template nav aside footer form button select textarea iframe object svg canvas audio video dialog menu head title input datalist map noembed noframes xmp".split())
#: Words in class, id or role that say what an element is.
_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words that say it beside any others: adverts, consent and comments have the names of their makers too.
_STRONG = frozenset("ad ads advert adverts advertisement advertising adsense adsbygoogle adslot adunit sponsor sponsored promo promotion cookie cookies consent gdpr onetrust paywall notice notices newsletter disqus comment comments commentlist".split())
#: Words that turn a name into its opposite, or into what is not there.
_WITHOUT = frozenset("no not without has with hide hidden free off enabled disabled".split())
_BOILERPLATE = _COMMENTS | _STRONG | frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login footer masthead toolbar pagination pager widget widgets alert search skip contentinfo complementary sharing social related recommended recommendations share".split())
#: Words that only say where or what kind of box an element is. A name is boilerplate if it has a word of the list above and else only such ones.
_NEUTRAL = frozenset("a area article articles bar block blog body bottom box btn button buttons card cards cell col column container content data desktop div el element entry fixed floating form global group header heading holder icons id in inner item items js large layout left line link links list main media mobile module nav news next on out outer panel part pane post posts prev previous primary region right row rows secondary section site slot small sticky story stories strip tab text thread title top ui ul unit user view wrap wrapper zone page pages".split())
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: Characters that a notice or an advert may have alone on a page.
NOTICE = 100
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_WORDS = re.compile(r"[a-z]+")


def _names(said: str) -> set[str]:
    """The words of those names of an element that are boilerplate. has-sidebar or no-comments say something else of an element."""
    out: set[str] = set()
    for name in said.split():
        words = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        words = [next((c for c in ("comments", "comment") if w.endswith(c)), w) for w in words]
        strong = not _STRONG.isdisjoint(words) and _WITHOUT.isdisjoint(words)
        if strong or not set(words).isdisjoint(_BOILERPLATE) and all(w in _BOILERPLATE or w in _NEUTRAL for w in words):
            out |= set(words) & _BOILERPLATE
    return out


def _site_header(names: str) -> bool:
    """Whether a name is that of the header of a page or site, and not of an article."""
    return any(set(words) <= {"header", "site", "global", "top", "main", "sticky", "desktop", "mobile"} and "header" in words for name in names.lower().split() for words in [_WORDS.findall(name)])


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    #: Elements that hold the block, from the root, by number.
    inside: tuple[int, ...]
    linked: int
    #: The outermost article or main that holds the block, by number.
    article: int | None = None
    #: Elements that hold the block and whose names say that they are boilerplate, by number.
    named: frozenset[int] = frozenset()


@dataclass
class _Element:
    tag: str
    number: int
    key: str
    #: Why its text is left out, if it is.
    out: bool
    article: bool
    named: frozenset[int]


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Element] = field(default_factory=list)
    held: list[str] = field(default_factory=list)
    made: int = 0
    linked: int = 0

    def text(self, raw: str) -> None:
        if self.stack and self.stack[-1].out or not raw:
            return
        if "&" in raw:
            raw = entities.unescape(raw)
        self.held.append(raw)
        if any(e.tag == "a" for e in self.stack):
            self.linked += len("".join(raw.split()))

    def flush(self) -> None:
        """Ends the block at hand."""
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                at = [e for e in self.stack if e.tag in _BLOCK]
                self.blocks.append(Block(text, tuple(e.key for e in at), tuple(e.number for e in at), self.linked, next((e.number for e in at if e.tag in ("article", "main")), None), self.stack[-1].named if self.stack else frozenset()))
            self.held, self.linked = [], 0

    def end_to(self, i: int) -> None:
        """Ends the open elements from the i-th on."""
        if any(e.tag in _BLOCK for e in self.stack[i:]):
            self.flush()
        del self.stack[i:]

    def start(self, tag: str, attributes: str) -> None:
        if tag in _CLOSES_P:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag == "p":
                    self.end_to(i)
                    break
                if self.stack[i].tag in _BLOCK:
                    break
        if tag in _ENDS:
            ended, within = _ENDS[tag]
            last = None
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag in within:
                    break
                if self.stack[i].tag in ended:
                    last = i
            if last is not None:
                self.end_to(last)
        if tag in _BLOCK:
            self.flush()
        if tag in _VOID:
            if tag in ("br", "wbr") and self.held:
                self.held.append(" " if tag == "br" else "")
            return
        held: dict[str, str] = {}
        if attributes.strip():
            for m in _ATTRIBUTE.finditer(attributes):
                held.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
        names = " ".join(held[k] for k in ("class", "id", "role") if k in held)
        said = " ".join(sorted(names.lower().split()))
        up = self.stack[-1] if self.stack else None
        article = tag in ("article", "main") or bool(up and up.article)
        out = bool(up and up.out) or tag in _NEVER or tag == "header" and not article
        if tag not in ("html", "body") and (held.get("hidden", "false").lower() not in ("false", "until-found") or _NO_DISPLAY.search(held.get("style", ""))):
            out = True
        named = up.named if up else frozenset()
        self.made += 1
        if names and tag not in ("html", "body", "article", "main"):
            if _names(names) or not article and _site_header(names):
                named |= {self.made}
        self.stack.append(_Element(tag, self.made, f"{tag}.{said}" if said else tag, out, article, named))

    def end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self.end_to(i)
                return
            if self.stack[i].tag in ("table", "body") and tag not in ("html", "body"):
                return  # an end tag doesn't reach out of a table


def read(page: str) -> list[Block]:
    """The blocks of text outside of what is never content, in page order. An element that its name calls boilerplate is left out too, unless next to nothing of the page's text is outside of such elements: then the names of those that hold nearly all of it mean something else."""
    reader, at = _Reader(), 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            reader.text(page[at:])
            break
        reader.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            reader.end(tag)
            continue
        reader.start(tag, m[3] or m[6] or "")
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.start() if end else len(page)
    reader.flush()
    blocks = reader.blocks
    own = [len(b.text) - b.linked for b in blocks]
    whole = sum(own)
    if sum(n for b, n in zip(blocks, own, strict=True) if not b.named) < 0.1 * whole:
        of: dict[int, int] = {}
        for b, n in zip(blocks, own, strict=True):
            for e in b.named:
                of[e] = of.get(e, 0) + n
        wrong = {e for e, n in of.items() if n > max(0.5 * whole, NOTICE)}
        return [b for b in blocks if b.named <= wrong]
    return [b for b in blocks if not b.named]


def path_scores(blocks: list[Block]) -> np.ndarray:
    """The fused, smoothed ratio of each block's tag path."""
    paths = {p: i for i, p in enumerate(dict.fromkeys(b.path for b in blocks))}
    which = np.array([paths[b.path] for b in blocks])
    nodes = np.bincount(which)
    length = np.bincount(which, [len(b.text) - b.linked for b in blocks]) / nodes
    marks = np.bincount(which, [len(_PUNCTUATION.findall(b.text)) for b in blocks]) / nodes
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), kernel, "valid")
    # neighbours lift a block no more than its own path allows
    return np.sqrt(np.maximum(length[which], 0) * smooth(length[which])) * (1 + np.sqrt(marks[which] * smooth(marks[which])))


def content(blocks: list[Block], threshold: float = 0.2, share: float = 0.6) -> list[Block]:
    """The article's blocks. share: so much of the text of paths over the threshold makes an article or main the article."""
    if not blocks:
        return []
    scores = path_scores(blocks)
    size = np.array([len(b.text) for b in blocks])
    chosen = np.flatnonzero(scores >= threshold * np.average(scores, weights=size))
    if not len(chosen):
        return []
    of_article: dict[int, int] = {}
    for i in chosen:
        if (a := blocks[i].article) is not None:
            of_article[a] = of_article.get(a, 0) + size[i]
    most = max(of_article, key=of_article.get, default=None)
    if most is not None and of_article[most] >= share * size[chosen].sum():
        return [b for b in blocks if most in b.inside]
    # the elements that hold all chosen blocks, without a block's own
    common = [e for e, *others in zip(*(blocks[i].inside[:-1] for i in chosen), strict=False) if all(e == x for x in others)]
    article = blocks[chosen[0]].article
    depth = common.index(article) + 1 if article in common else len(common)
    held = [(i, b) for i, b in enumerate(blocks) if b.inside[:depth] == tuple(common[:depth])]
    names = [key.split(".")[0] for key in blocks[chosen[0]].path[:depth]]
    if set(names) - {"html", "body"}:
        return [b for _, b in held]
    # no element says where the article is
    beside = {e for i in chosen for e in blocks[i].inside[depth:]}
    menu = lambda i, b: b.linked > 0.6 * len(b.text.replace(" ", "")) and not chosen[0] <= i <= chosen[-1] and not beside.intersection(b.inside) and not any(re.match(r"h[1-6]\b", key) for key in b.path)
    return [b for i, b in held if not menu(i, b)]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in content(read(page or "")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(tidy(made), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
