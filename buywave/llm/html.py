"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks (runs of text without a block-level tag between them). Each block is
described by its ancestors' tags, class and id words, and by its text. The field, trained on
labelled pages, labels the blocks as main text or not, and Viterbi decoding picks the best labelling of
the whole page.

The labelled pages are written here by a seeded rule that knows each block's label: many layouts, with
navigation, page headers and footers, sidebars, notices, adverts, forms and reader comments in and
around the article.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buywave.llm import crf
from buywave.llm.common import ship, whole_text

TRAIN_PAGES, TRAIN_SEED = 600, 7
#: Blocks decoded at once, which bounds the memory of a task.
BLOCKS_AT_ONCE = 20_000

_UNSEEN = {"script", "style", "head", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = set("a abbr b bdi bdo cite code data dfn del em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var button".split())
#: Tags that may stand in a head; any other start tag, or text, ends a head that is left open.
_IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
#: Tags that end an open paragraph, list item, cell or row of the same kind.
_PARAGRAPH = {"p"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TAGS = "nav header footer aside form article main section div p li a h1 h2 h3 h4 table blockquote pre figure figcaption button label dl ul".split()
_CLASS_WORDS = {
    "advert": "ad ads advert advertisement sponsor sponsored promo banner adsense",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toolbar tabs",
    "side": "sidebar side aside widget related recommended share social tags rail more trending",
    "notice": "cookie cookies notice consent alert popup modal newsletter subscribe signup gdpr overlay paywall",
    "comment": "comment comments reply replies disqus discussion respond",
    "foot": "footer foot copyright legal bottom colophon",
    "head": "header head masthead logo top branding",
    "content": "content article post entry body story text main page",
    "form": "form login search contact poll",
}
_WORD_KIND = {w: k for k, words in enumerate(_CLASS_WORDS.values()) for w in words.split()}
_ROLES = {"navigation": 1, "banner": 6, "contentinfo": 5, "complementary": 2, "search": 8, "form": 8, "main": 7, "dialog": 3, "alert": 3}
_N_TEXT = 10
WIDTH = len(_TAGS) + len(_CLASS_WORDS) + _N_TEXT
_TAG_AT = {t: k for k, t in enumerate(_TAGS)}


_OPEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
#: Every attribute is read, so that nothing inside a quoted value is taken for one.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Attribute texts up to this length are remembered; longer ones are read each time.
_REMEMBERED = 1000


def _read_kinds(attributes: str) -> tuple[int, ...]:
    kinds = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            kinds += [_ROLES[value]] if value in _ROLES else []
        elif name in ("class", "id"):
            kinds += [_WORD_KIND[w] for w in re.split(r"[^a-z]+", value) if w in _WORD_KIND]
    return tuple(sorted(set(kinds)))


_remembered_kinds = functools.lru_cache(maxsize=4096)(_read_kinds)


def _kinds(attributes: str) -> tuple[int, ...]:
    return _remembered_kinds(attributes) if len(attributes) < _REMEMBERED else _read_kinds(attributes)


class _TagEnds:
    """Where the tags of a page end: at the first ``>`` outside quotes, or the first of all if there is none.

    A search that fails reads up to a quote that is never closed, or to the page's end. Whatever tag begins
    on that way outside the quotes fails there too, so the way is remembered: there are only a few such
    searches, and finding all ends takes time in proportion to the page.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.failed: list[tuple[int, int, list[int], list[int]]] = []  # from, to, quotes' starts and ends

    def end(self, begin: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``begin``; there is one ahead."""
        page, at = self.page, begin
        for start, stop, starts, ends in self.failed:
            k = bisect.bisect_right(starts, begin) - 1
            if start <= begin <= stop and (k < 0 or begin >= ends[k]):
                return page.find(">", begin)
        starts, ends = [], []
        while (stop := page.find(">", at)) >= 0:
            found = [x for x in (page.find('"', at, stop), page.find("'", at, stop)) if x >= 0]
            if not found:
                return stop
            quote = min(found)
            close = page.find(page[quote], quote + 1)
            if close < 0:
                break
            starts.append(quote)
            ends.append(close + 1)
            at = close + 1
        self.failed.append((begin, quote if stop >= 0 else len(page), starts, ends))
        return page.find(">", begin)


class _Blocks:
    """Collects (text, characters inside links, distinct open ancestors that tell something, depth) for every leaf block.

    What is open is kept by tag, so that no element costs a walk through all that are open.
    """

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, tuple, int]] = []
        self.open: list[tuple[str, tuple[int, ...]]] = []
        #: Places in ``open`` of every tag, of block elements, and of block elements that are no paragraphs.
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.hard_places: list[int] = []
        self.telling: dict[tuple[str, tuple[int, ...]], int] = {}
        self.ancestors: tuple | None = ()
        self.pieces: list[str] = []
        self.linked = self.links = self.unseen = self.depth = 0

    def read(self, page: str) -> None:
        at, ends = 0, _TagEnds(page)
        while (m := _OPEN.search(page, at)) is not None:
            tag = m[2]
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                stop = end + 3 if end >= 0 else len(page)
            elif m.start() > ends.last:  # no tag ends any more; a comment may begin, and then takes the rest
                comment = page.find("<!--", m.end())
                self.text(page[at : comment if comment >= 0 else len(page)])
                at = len(page)
                break
            else:
                stop = (ends.end(m.end()) if tag else page.find(">", m.end())) + 1
            if m.start() > at:
                self.text(page[at : m.start()])
            at = stop
            if tag:
                tag = tag.lower()
                if m[1]:
                    self.end_tag(tag)
                else:
                    self.start_tag(tag, page[m.end() : stop - 1])
                    if tag in _RAW_END:
                        end = _RAW_END[tag].search(page, at)
                        at = end.start() if end else len(page)
        self.text(page[at:])
        self.flush()

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                if self.ancestors is None:
                    self.ancestors = tuple(self.telling)
                self.blocks.append((text, min(self.linked, len(text)), self.ancestors, self.depth))
            self.pieces = []
        self.linked = 0

    def in_head(self) -> bool:
        return bool(self.open) and self.open[-1][0] == "head"

    def start_tag(self, tag: str, attributes: str) -> None:
        if self.in_head() and tag not in _IN_HEAD:
            if tag in ("head", "html"):
                return
            self.cut(len(self.open) - 1)
        if tag in _VOID:
            if tag == "br":
                self.pieces.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag not in _INLINE:
            self.flush()
            self.close_until(_CLOSES.get(tag, _PARAGRAPH))
        self.push(tag, _kinds(attributes) if "=" in attributes else ())

    def push(self, tag: str, kinds: tuple[int, ...]) -> None:
        at = len(self.open)
        self.open.append((tag, kinds))
        self.places.setdefault(tag, []).append(at)
        if tag not in _INLINE:
            self.block_places.append(at)
            if tag != "p":
                self.hard_places.append(at)
        self.links += tag == "a"
        self.unseen += tag in _UNSEEN
        if tag not in _INLINE or tag in _TAG_AT:
            self.depth += 1
            if tag in _TAG_AT or kinds:
                if (tag, kinds) not in self.telling:
                    self.ancestors = None
                self.telling[tag, kinds] = self.telling.get((tag, kinds), 0) + 1

    def close_until(self, tags: set[str]) -> None:
        """Close the innermost of ``tags``, if only inline elements and paragraphs lie above it."""
        innermost = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        if innermost >= 0 and not (self.hard_places and self.hard_places[-1] > innermost):
            self.cut(innermost)

    def end_tag(self, tag: str) -> None:
        """Close the innermost element of this tag; an inline one only if no block element lies above it."""
        if tag not in _INLINE:
            self.flush()
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        if tag not in _INLINE or not (self.block_places and self.block_places[-1] > at):
            self.cut(at)

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            tag, kinds = self.open.pop()
            self.places[tag].pop()
            for places in (self.block_places, self.hard_places):
                if places and places[-1] == len(self.open):
                    places.pop()
            self.links -= tag == "a"
            self.unseen -= tag in _UNSEEN
            if tag not in _INLINE or tag in _TAG_AT:
                self.depth -= 1
                if tag in _TAG_AT or kinds:
                    self.telling[tag, kinds] -= 1
                    if not self.telling[tag, kinds]:
                        del self.telling[tag, kinds]
                        self.ancestors = None

    def text(self, data: str) -> None:
        if self.unseen == 1 and self.in_head() and data.strip(" \t\n\f\r"):
            self.cut(len(self.open) - 1)
        if not self.unseen and data:
            self.pieces.append(entities.unescape(data) if "&" in data else data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str) -> list[tuple[str, int, tuple, int]]:
    """Leaf blocks of a page in page order. Markup that breaks off is read as far as it goes."""
    parser = _Blocks()
    parser.read(html)
    return parser.blocks


@functools.lru_cache(maxsize=4096)
def _ancestor_features(ancestors: tuple) -> np.ndarray:
    row = np.zeros(len(_TAGS) + len(_CLASS_WORDS), dtype=np.float32)
    for tag, kinds in ancestors:
        if tag in _TAG_AT:
            row[_TAG_AT[tag]] = 1.0
        for kind in kinds:
            row[len(_TAGS) + kind] = 1.0
    return row


def block_features(blocks: list[tuple[str, int, tuple, int]]) -> np.ndarray:
    out = np.zeros((len(blocks), WIDTH), dtype=np.float32)
    n = len(blocks)
    for k, (text, linked, ancestors, depth) in enumerate(blocks):
        row = out[k]
        row[: -_N_TEXT] = _ancestor_features(ancestors)
        words = text.count(" ") + 1
        row[-10:] = (
            min(words, 100) / 20,
            words <= 3,
            words >= 15,
            linked / len(text),
            text[-1] in ".!?:;\"'»”)…",
            "©" in text or "(c)" in text,
            min(len(text) / words, 20) / 10,
            text.count("|") + text.count("»") + text.count("·") > 0,
            k / n,
            depth / 10,
        )
    return out


# --- labelled pages ---------------------------------------------------------------------------


class _Author:
    """Writes one page and the label of each of its blocks (1: main text)."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []
        #: Noise that some sites have in all their texts, so that it tells nothing about a block.
        self.noise = rng.choice(("", "", "", "pipes", "marks", "capitals", "copies"))

    def words(self, low: int, high: int) -> str:
        r = self.rng
        made = ["".join(r.choice(("ka", "lo", "mi", "ner", "ta", "sul", "ve", "or", "in", "é", "st", "un")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        if self.noise == "pipes" and r.random() < 0.8:
            made = [x for w in made for x in (w, r.choice(("|", "·")))]
        elif self.noise == "marks":
            made = [w + r.choice(("%%%", "$", "&amp;", "#", "©", "")) for w in made]
        elif self.noise == "capitals":
            made = [w.upper() + "!!" for w in made]
        elif self.noise == "copies":
            made = [w for w in made for _ in range(3)]
        return " ".join(made).capitalize() if self.noise != "capitals" else " ".join(made)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18) + self.rng.choice("....!?") for _ in range(self.rng.randint(low, high)))

    def raw(self, markup: str) -> None:
        self.html.append(markup)

    def block(self, tag: str, text: str, label: int, attrs: str = "", close: bool = True) -> None:
        self.html.append(f"<{tag}{attrs}>{text}" + (f"</{tag}>" if close else ""))
        self.labels.append(label)

    def links(self, low: int, high: int, label: int = 0) -> None:
        self.raw("<ul>")
        for _ in range(self.rng.randint(low, high)):
            self.block("li", f'<a href="/x">{self.words(1, 4)}</a>', label)
        self.raw("</ul>")

    def box(self, opening: str, closing: str, low: int = 1, high: int = 3) -> None:
        """Something that is not main text: some lines, with or without links and sentences."""
        r = self.rng
        self.raw(opening)
        for _ in range(r.randint(low, high)):
            kind = r.random()
            if kind < 0.3:
                self.links(2, 7)
            elif kind < 0.6:
                self.block(r.choice(("p", "div", "h3", "h4", "span")), self.words(1, 6), 0)
                self.block("p", self.sentences(1, 2), 0)
            else:
                self.block(r.choice(("p", "div")), self.sentences(1, 4), 0)
        self.raw(closing)

    def plain_box(self, opening: str, closing: str) -> None:
        """A box whose text stands in it directly, as short or long as an article's paragraph."""
        self.raw(f"{opening}{self.sentences(1, 5)}{closing}")
        self.labels.append(0)

    def side_matter(self) -> None:
        r = self.rng
        name = r.choice(("ad", "advert", "ads", "promo", "sponsored", "sidebar", "widget", "related", "share", "cookie-notice", "newsletter", "notice", "popup", "comments", "comment-list", "poll", "breadcrumbs"))
        tag = r.choice(("div", "section", "aside", "div"))
        attr = r.choice(("class", "id", "class"))
        if r.random() < 0.5:
            self.plain_box(f'<{tag} {attr}="{name}">', f"</{tag}>")
        else:
            self.box(f'<{tag} {attr}="{name}">', f"</{tag}>")

    def form(self) -> None:
        self.raw("<form>")
        self.block("p", self.sentences(1, 2), 0)
        self.raw('<input name="q">')
        self.block("div", f"<label>{self.words(1, 3)}</label>", 0)
        self.raw("</form>")

    def story(self) -> None:
        """The article's own blocks."""
        r = self.rng
        self.block("h1", self.words(2, 12), 1)
        sloppy = r.random() < 0.4
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.62:
                text = self.sentences(1, 6) if r.random() < 0.8 else self.words(1, 3) + "."
                if r.random() < 0.15:
                    text += f' <a href="/y">{self.words(1, 3)}</a> {self.words(2, 6)}.'
                self.block("p", ("<b>" if sloppy and r.random() < 0.3 else "") + text + ("<br>" if sloppy else ""), 1, close=not sloppy)
            elif kind < 0.68:
                self.block(r.choice(("h2", "h3")), self.words(1, 7), 1)
            elif kind < 0.74:
                self.raw("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.block("li", self.words(2, 14), 1)
                self.raw("</ul>")
            elif kind < 0.79:
                self.raw("<blockquote>")
                self.block("p", self.sentences(1, 3), 1)
                self.raw("</blockquote>")
            elif kind < 0.83:
                self.raw("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    self.block("td", self.words(1, 4), 1)
                self.raw("</tr></table>")
            elif kind < 0.86:
                self.block("pre", self.words(4, 20), 1)
            elif kind < 0.90:
                self.raw('<figure><img src="a.png">')
                self.block("figcaption", self.words(3, 10) + ".", 1)
                self.raw("</figure>")
            elif kind < 0.95:
                self.block("div", self.sentences(1, 4), 1)
            else:
                self.side_matter()

    def page(self) -> tuple[str, list[int]]:
        r = self.rng
        self.raw(f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head><body>")
        if r.random() < 0.5:
            self.box("<header>", "</header>", 1, 2)
        if r.random() < 0.8:
            self.raw("<nav>")
            self.links(3, 9)
            self.raw("</nav>")
        elif r.random() < 0.5:
            self.box('<div class="menu">', "</div>", 1, 1)
        for _ in range(r.choice((0, 1, 1, 2))):
            self.side_matter()
        if r.random() < 0.2:
            self.form()
        opening, closing = r.choice(
            (("<article>", "</article>"),) * 4
            + (("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ('<section class="entry">', "</section>"), ("<div>", "</div>"))
        )
        self.raw(opening)
        self.story()
        if r.random() < 0.25:
            self.box(r.choice(('<section class="comments">', '<div id="comments">', '<div class="replies">')).replace("section", "div"), "</div>")
        self.raw(closing)
        for _ in range(r.choice((0, 0, 1, 2))):
            self.side_matter()
        if r.random() < 0.25:
            self.box("<aside>", "</aside>")
        if r.random() < 0.85:
            if r.random() < 0.6:
                self.plain_box("<footer>&copy; example &middot; ", "</footer>")
            else:
                self.box("<footer>", "</footer>")
        self.raw("</body></html>" if r.random() < 0.8 else "")
        return "".join(self.html), self.labels


    def old_page(self) -> tuple[str, list[int]]:
        """A page whose parts are told apart by classes, ids and table cells only."""
        r = self.rng
        named = lambda tag, *names: f'<{tag} {r.choice(("class", "id"))}="{r.choice(names)}">'
        self.raw(f"<html><head><title>{self.words(2, 8)}</title></head><body>")
        if r.random() < 0.5:
            self.plain_box(named("div", "header", "masthead", "top", "banner"), "</div>")
        in_table = r.random() < 0.6
        cell = "td" if in_table else "div"
        self.raw("<table><tr>" if in_table else named("div", "wrapper", "page"))
        if r.random() < 0.8:
            self.raw(named(cell, "nav", "menu", "navigation", "sidebar"))
            self.links(2, 8)
            self.raw(f"</{cell}>")
        self.raw(r.choice((f"<{cell}>", named(cell, "content", "main", "text", "story", "body"))))
        self.story()
        self.raw(f"</{cell}>")
        if r.random() < 0.3:
            self.box(named(cell, "sidebar", "related", "widget"), f"</{cell}>")
        self.raw("</tr></table>" if in_table else "</div>")
        if r.random() < 0.85:
            start = r.choice(("&copy; ", "", "&copy; 2020 "))
            self.plain_box(named("div", "footer", "foot", "bottom", "copyright", "legal") + start, "</div>")
        self.raw("</body></html>")
        return "".join(self.html), self.labels


def labelled_old_pages(count: int, seed: int) -> list[tuple[str, list[int]]]:
    rng = random.Random(seed)
    return [_Author(rng).old_page() for _ in range(count)]


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[int]]]:
    rng = random.Random(seed)
    return [_Author(rng).page() for _ in range(count)]


def fit_extractor(pages: list[tuple[str, list[int]]] | None = None) -> crf.Chain:
    """Train the field on labelled pages: (html, label of each leaf block)."""
    matrices, labels, lengths = [], [], []
    if pages is None:
        pages = labelled_pages(TRAIN_PAGES, TRAIN_SEED) + labelled_old_pages(TRAIN_PAGES // 4, TRAIN_SEED + 1)
    for html, marks in pages:
        blocks = leaf_blocks(html)
        if len(blocks) != len(marks):
            raise ValueError(f"{len(blocks)} blocks, {len(marks)} labels")
        if blocks:
            matrices.append(block_features(blocks))
            labels += marks
            lengths.append(len(blocks))
    return crf.fit(np.vstack([np.zeros((0, WIDTH)), *matrices]), np.array(labels, dtype=np.int64), np.array(lengths, dtype=np.int64), l2=1e-4)


def extract_texts(pages: list[str], chain: crf.Chain) -> list[str]:
    """Main text of each page, decoded together."""
    split = [leaf_blocks(x) for x in pages]
    full = [x for x in split if x]
    if not full:
        return ["" for _ in pages]
    lengths = np.array([len(x) for x in full], dtype=np.int64)
    scores = chain.scores(np.vstack([block_features(x) for x in full]))
    labels = iter(crf.viterbi(scores, chain.transition, lengths).tolist())
    return ["\n".join([text for text, *_ in blocks if next(labels)]) for blocks in split]


def extract_main_text(pages: DataFrame, chain: crf.Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null and empty html give the empty text; null ids and urls stay null; repeated rows all come back.
    White space in a block becomes one space, blocks are joined by one newline in page order.
    """
    ship(pages.sparkSession)
    weights = (chain or fit_extractor()).to_dict()
    source = pages.select("page_id", "url", whole_text("html").alias("html"))
    shape = f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = crf.Chain.from_dict(weights)
        for batch in batches:
            texts: list[str] = []
            part, size = [], 0
            for html in batch.column("html"):
                part.append(html.as_py())
                size += part[-1].count("<")
                if size >= BLOCKS_AT_ONCE:
                    texts += extract_texts(part, field)
                    part, size = [], 0
            texts += extract_texts(part, field)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return source.mapInArrow(extract, shape).withColumn("n_chars", F.length("text").cast("bigint"))
