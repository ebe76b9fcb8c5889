"""Main text of web pages by equivalence classes of tokens over the pages of a host.

A page is read as a sequence of tokens: element starts, told apart by their path of elements, and
blocks of text at their path. Tokens of a host with one occurrence vector (how often each page has
them) form an equivalence class. A class is valid if its tokens come in one order on the pages that
have it and if all of them hang in the same element of other classes, so that it nests as a whole.
The valid classes are the host's template; what they leave on a page are its slots. The article is
what lies between start and end of one template element: one by the name of article or main, else
the deepest that holds most of the text in slots. Pages without a template (one page on its host)
are judged by their own elements in the same way.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_bytes, stage

#: Elements whose content is never text of a page.
SILENT = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "head", "title"}
#: Elements around a page's text that hold no part of the article.
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog", "fieldset"}
#: Words of which a class, id or role consists that marks such elements: adverts, comments, menus and the like wherever they are,
_STRONG = r"(?:ads?|advert[^\W_]*|adsense|sponsor[^\W_]*|cookies?|consent|gdpr|comments?|disqus|sidebar|menu[^\W_]*|nav[^\W_]*|breadcrumbs?|pagination|pager|navigation)"
#: and others outside of articles, or inside of one if the host's template has them there.
_MARK = rf"(?:{_STRONG}|promo[^\W_]*|banner|notices?|alerts?|popup|modal|overlay|replies|respond|side|aside|widget[^\W_]*|footer|header|masthead|share|sharing|social|follow|related|recommended|newsletter|subscribe|subscription|signup|login|search|toolbar|complementary|contentinfo|dialog|tags|toc)"
MARKS = re.compile(rf"(?<!\S){_MARK}(?:[_-]+{_MARK})*(?!\S)", re.IGNORECASE)
STRONG = re.compile(rf"(?<!\S){_STRONG}(?:[_-]+{_MARK})*(?!\S)", re.IGNORECASE)
#: Start tags that stay within a head; any other ends it, as does text.
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template", "head"}
#: Why an element does not count: by its marks, as a form, or for good.
MARKED, FORM, GONE = 1, 2, 4
#: Elements that stay within a block of text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that a start tag of the key closes if they are open, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_PARAGRAPH = ({"p"}, {"button", "object", "td", "th", "table", "article", "section", "div", "li", "body", "aside", "blockquote"})
#: Elements that are not the article's frame but parts of it.
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "th"}
#: Tokens on so many different pages of a host, and on this share of them, can be in its template (so the candidates of a host are bounded by a page's tokens / SHARE).
SUPPORT, SHARE = 2, 0.2
#: Share of a class's pages that must have its tokens in one order.
ORDERED = 0.9
#: Text inside an article's named element is the template's if it is on so many different pages of a host and on this share of them.
TEXT_SUPPORT, TEXT_SHARE = 10, 0.9
#: Bytes of a table of templates up to which it is broadcast.
BROADCAST = 8 << 20
#: How an element is named: a part of text, neither, main, article.
LEAF, OTHER, MAIN, ARTICLE = 0, 1, 2, 3

_SPACE, _DIGITS = re.compile(r"\s+"), re.compile(r"[0-9]+")


def _hash(*parts: object) -> int:
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(50_000)
def _path(up: int, label: str) -> int:
    """The token of an element with this label in the element with token up."""
    return _hash(up, "<", label)


class Open(NamedTuple):
    """An open element, and what all open elements up to it say together."""

    tag: str
    node: int  # number of the nearest path token
    why: int  # reasons against what is inside
    since: int  # of these, those since the innermost unmarked article or main
    article: bool  # an article or main is open
    inner: bool  # an unmarked one is
    mark: int  # path token of the outermost marked element inside it, or -1


#: What stands around a page's outermost elements; its path token.
_NONE, _ROOT = Open("", 0, 0, 0, False, False, -1), _hash("page")


class Page(NamedTuple):
    """A parsed page: path tokens in order of appearance with their parents' numbers and names, and blocks of text.

    events: the number of each element's path as it starts, or -1 - n for block n.
    """

    nodes: list[int]
    up: list[int]
    kinds: list[int]
    events: list[int]
    at: list[int]
    kept: list[bool]
    marks: list[int]
    texts: list[str]


class _Parser(HTMLParser):
    """Time and memory grow with the page's length only, however deep its elements nest."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.where: dict[str, list[int]] = {}  # places of each tag among the open elements
        self.blocks_open: list[int] = []  # places of those that are not inline
        self.page = Page([_ROOT], [-1], [OTHER], [], [], [], [], [])
        self.number: dict[int, int] = {}
        self.told: list[tuple[bool, bool, bool]] = []  # of each block: in an article; counts from the article inwards; only forms speak against it
        self.text: list[str] = []
        self.silent = 0

    def flush(self):
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                p, x = self.page, self.open[-1] if self.open else _NONE
                p.events.append(-1 - len(p.texts))
                p.at.append(x.node), p.kept.append(not x.why), p.marks.append(x.mark), p.texts.append(text)
                self.told.append((x.article, x.inner and not x.why & GONE and not x.since, not x.why & ~FORM))
            self.text = []

    def node(self, label: str, up: int, kind: int) -> int:
        p = self.page
        token = _path(p.nodes[up], label)
        if token not in self.number:
            self.number[token] = len(p.nodes)
            p.up.append(up), p.nodes.append(token), p.kinds.append(kind)
        return self.number[token]

    def last(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def pop_to(self, at: int):
        while len(self.open) > at:
            x = self.open.pop()
            self.where[x.tag].pop()
            if self.blocks_open and self.blocks_open[-1] == len(self.open):
                self.blocks_open.pop()
            self.silent -= x.tag in SILENT

    def end_head(self, tag=None):
        """Close a head whose end tag is left out."""
        if tag not in IN_HEAD and self.silent and (self.open[-1].tag == "head" or tag == "body") and self.where.get("head"):
            self.pop_to(self.where["head"][0])

    def handle_starttag(self, tag, attrs):
        self.end_head(tag)
        if tag not in INLINE:
            self.flush()
            shut, limit = CLOSES.get(tag, _PARAGRAPH)
            while (at := self.last(shut | limit)) >= 0 and self.open[at].tag in shut:
                self.pop_to(at)
                if tag != "tr":
                    break
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        found = dict(attrs)
        marks = " ".join(filter(None, (found.get("class"), found.get("id"), found.get("role"))))
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in (found.get("style") or "").replace(" ", "").lower()
        up = self.open[-1] if self.open else _NONE
        marked = bool(marks and MARKS.search(marks))
        weak = marked and up.inner and not STRONG.search(marks)
        why = GONE if tag in ASIDE - {"form"} or tag in SILENT or hidden else MARKED if marked and not weak else FORM if tag == "form" else 0
        frame = tag in ("article", "main")
        if frame or tag in ("html", "body"):
            why = 0
        node = up.node
        if tag not in INLINE:
            kind = ARTICLE if tag == "article" and not marked else MAIN if tag == "main" and not marked else LEAF if tag in LEAVES else OTHER
            label = tag + (f".{_SPACE.sub('.', _DIGITS.sub('#', marks.strip()))}" if marks.strip() else "")
            node = self.node(label, up.node, kind)
            self.page.events.append(node)
        since = 0 if frame and not marked else up.since | why
        mark = self.page.nodes[node] if weak and up.mark == -1 else up.mark
        self.where.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks_open.append(len(self.open))
        self.open.append(Open(tag, node, up.why | why, since, up.article or frame, up.inner or frame and not marked, mark))
        self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        at = self.last((tag,))
        if at >= 0 and not (tag in INLINE and self.blocks_open and self.blocks_open[-1] > at):
            self.pop_to(at)

    def handle_data(self, data):
        if self.silent and data.strip():
            self.end_head()
        if not self.silent:
            self.text.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def parse(html: str | None) -> Page:
    """A page's path tokens and text blocks, references decoded, white space made single.

    kept: no silent or aside element around. If no article or main counts, those inside marked
    elements and forms do; if nothing counts, what only forms are around does.
    """
    parser = _Parser()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    page, told = parser.page, parser.told
    if not any(k and x[0] for k, x in zip(page.kept, told)):
        page.kept[:] = [k or x[1] for k, x in zip(page.kept, told)]
    if not any(page.kept):
        page.kept[:] = [x[2] for x in told]
    return page


def blocks(html: str | None) -> list[tuple[int, bool, str]]:
    """(path token, kept, text) of each text block of a page."""
    p = parse(html)
    return [(p.nodes[a], k, t) for a, k, t in zip(p.at, p.kept, p.texts)]


def inside(page: Page, token: int) -> list[bool]:
    """For each path of a page whether it is token or lies inside it."""
    out: list[bool] = []
    for node, up in zip(page.nodes, page.up):
        out.append(node == token or up >= 0 and out[up])
    return out


def chars_inside(page: Page, count: list[bool]) -> list[int]:
    """Code points inside each path of the blocks that count."""
    out = [0] * len(page.nodes)
    for a, c, t in zip(page.at, count, page.texts):
        out[a] += len(t) if c else 0
    for i in range(len(out) - 1, 0, -1):
        if page.up[i] >= 0:
            out[page.up[i]] += out[i]
    return out


def depths(page: Page) -> list[int]:
    out: list[int] = []
    for up in page.up:
        out.append(out[up] + 1 if up >= 0 else 0)
    return out


def own_slot(page: Page) -> int | None:
    """The path that holds the article by the page's own elements: an article or main with text (the one with most), else the deepest, not a leaf, that holds all of it, so that nothing is lost. Ties: the smaller token."""
    chars, depth = chars_inside(page, page.kept), depths(page)
    held = [i for i, n in enumerate(chars) if n]
    if not held:
        return None
    top = max(page.kinds[i] for i in held)
    if top > OTHER:
        best = max((i for i in held if page.kinds[i] == top), key=lambda i: (chars[i], -page.nodes[i]))
    else:
        whole = sum(n for n, up in zip(chars, page.up) if up < 0)
        most = [i for i in held if page.kinds[i] == OTHER and chars[i] >= whole]
        best = max(most, key=lambda i: (depth[i], chars[i], -page.nodes[i]), default=held[0])
    return page.nodes[best]


# ------------------------------------------------------------------ pages as rows

PARSED = "page_id long, url string, host string, nodes array<long>, up array<int>, kinds array<int>, events array<int>, at array<int>, kept array<boolean>, marks array<long>, texts array<string>"
_LISTS = list(zip(Page._fields, (pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string()))))


def _parse_all(batches):
    for whole in batches:
        for batch in slices(whole, "html"):
            found = [parse(h) for h in batch.column("html").to_pylist()]
            lists = [pa.array([p[i] for p in found], t) for i, (_, t) in enumerate(_LISTS)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), *lists], ["page_id", "url", "host", *Page._fields])


def _pages_of(batch: pa.RecordBatch) -> list[Page]:
    return [Page(*x) for x in zip(*(batch.column(c).to_pylist() for c in Page._fields))]


def _slices(batches, rows: int = 500):
    for whole in batches:
        yield from (whole.slice(i, rows) for i in range(0, whole.num_rows, rows))


def _text_token(page: Page, block: int) -> int:
    return _hash(page.nodes[page.at[block]], page.texts[block])


def _tokens(batches):
    """Parsed pages to (host, token, element, page, times); token 0 stands for the page itself."""
    for batch in _slices(batches):
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), _pages_of(batch)):
            times: dict[int, int] = {}
            for e in page.events:
                token = page.nodes[e] if e >= 0 else _text_token(page, -1 - e)
                times[token] = times.get(token, 0) + 1
            same = _hash(*times.items())
            paths = set(page.nodes)
            rows.append((host, 0, False, same, 1))
            rows += [(host, t, t in paths, same, n) for t, n in times.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32()))], ["host", "token", "element", "page", "times"])


def equivalence_classes(parsed: DataFrame) -> DataFrame:
    """(host, token, element, vector, often): tokens on SUPPORT different pages of a host and SHARE of them, by occurrence vector.

    often: on TEXT_SUPPORT pages and TEXT_SHARE of them. Pages with equal tokens count once. Only vectors that an element has are kept: text that shares
    its vector with no element is data.
    """
    told = parsed.where("host <> ''").mapInArrow(_tokens, "host string, token long, element boolean, page long, times int")
    told = told.groupBy("host", "token", "element", "page").agg(F.max("times").alias("times"))
    by_token = told.groupBy("host", "token", "element").agg(F.count("*").alias("pages"), F.sum(F.xxhash64("page", "times").cast("decimal(38,0)")).alias("vector"))
    by_token = stage(by_token.where(F.col("pages") >= SUPPORT).withColumn("vector", F.xxhash64("vector")), "html-tokens")
    size = by_token.where("token = 0").select("host", F.col("pages").alias("all"))
    frequent = by_token.where("token <> 0").join(size, "host").where(F.col("pages") >= SHARE * F.col("all"))
    framed = frequent.where("element").select("host", "vector").distinct()
    often = (F.col("pages") >= TEXT_SUPPORT) & (F.col("pages") >= TEXT_SHARE * F.col("all"))
    return stage(frequent.join(framed, ["host", "vector"], "left_semi").select("host", "token", "element", "vector", often.alias("often")), "html-classes")


def class_order(page: Page, of: dict[int, int], size: dict[int, int]) -> dict[int, int | None]:
    """For each class of a page a hash of its tokens' order, or None where they do not come round in one order or do not nest in one element.

    An element hangs in the nearest element around it that is not of its class; a text where the
    nearest element of its class around it hangs, else in its own element.
    """
    seen: dict[int, list[int]] = {}
    hangs: dict[int, set[int]] = {}
    cls = [of.get(t) for t in page.nodes]
    above: list[int] = []
    for i, up in enumerate(page.up):
        above.append(-1 if up < 0 else above[up] if cls[up] is not None and cls[up] == cls[i] else page.nodes[up])
    known: dict[tuple[int, int], int] = {}

    def place(node: int, c: int) -> int:
        way, at = [], node
        while at >= 0 and cls[at] != c and (at, c) not in known:
            way.append(at)
            at = page.up[at]
        found = page.nodes[node] if at < 0 else known[at, c] if (at, c) in known else above[at]
        known.update(((x, c), found if at >= 0 else page.nodes[x]) for x in way)
        return found

    for e in page.events:
        node = e if e >= 0 else page.at[-1 - e]
        token = page.nodes[e] if e >= 0 else _text_token(page, -1 - e)
        c = of.get(token)
        if c is not None:
            seen.setdefault(c, []).append(token)
            hangs.setdefault(c, set()).add(above[node] if e >= 0 else place(node, c))
    good = lambda c, x: len(hangs[c]) == 1 and len(x) % size[c] == 0 and all(a == b for a, b in zip(x, x[size[c] :]))
    return {c: _hash(*x[: size[c]]) if good(c, x) else None for c, x in seen.items()}


def _evidence(batches):
    """Parsed pages with their host's candidates to (host, vector, token, arranged, n, chars, depth, kind): how often a class comes in one order, and the slots' text inside each candidate element."""
    names, types = ["host", "vector", "token", "arranged", "n", "chars", "depth", "kind"], (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    for batch in _slices(batches):
        total: dict[tuple, list[int]] = {}
        for host, tokens, vectors, page in zip(*(batch.column(c).to_pylist() for c in ("host", "tokens", "vectors")), _pages_of(batch)):
            of, size = dict(zip(tokens, vectors)), {}
            for v in vectors:
                size[v] = size.get(v, 0) + 1
            for c, arranged in class_order(page, of, size).items():
                total.setdefault((host, c, None, arranged, None, None), [0, 0])[0] += 1
            chars = chars_inside(page, [k and _text_token(page, i) not in of for i, k in enumerate(page.kept)])
            for token, n, d, kind in zip(page.nodes, chars, depths(page), page.kinds):
                if token in of:
                    x = total.setdefault((host, of[token], token, None, d, kind), [0, 0])
                    x[0] += n > 0
                    x[1] += n
        if total:
            cols = zip(*((h, c, t, a, n, chars, d, k) for (h, c, t, a, d, k), (n, chars) in total.items()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def templates(parsed: DataFrame) -> DataFrame:
    """(host, slot, elements, texts) of hosts with a template: the article's element, and the tokens of valid classes: all paths, and text; where a name tells the article's element, only text that is often there, since what two articles share need not be the template's."""
    classes = equivalence_classes(parsed)
    per_host = classes.groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_list("vector").alias("vectors"))  # a page's tokens / SHARE at most
    per_host = stage(per_host, "html-candidates")
    both = parsed.select("host", *Page._fields).join(small_bytes(per_host, F.size("tokens") * 16 + 64, BROADCAST), "host")
    told = both.mapInArrow(_evidence, "host string, vector long, token long, arranged long, n long, chars long, depth int, kind int")
    told = stage(told.groupBy("host", "vector", "token", "arranged", "depth", "kind").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")), "html-evidence")
    orders = told.where("token IS NULL").groupBy("host", "vector").agg(F.sum("n").alias("all"), F.coalesce(F.max(F.when(F.col("arranged").isNotNull(), F.col("n"))), F.lit(0)).alias("most"))
    valid = stage(orders.where(F.col("most") >= ORDERED * F.col("all")).select("host", "vector"), "html-valid")
    framed = told.where("token IS NOT NULL AND chars > 0").join(valid, ["host", "vector"], "left_semi")
    whole = framed.groupBy("host").agg(F.max("chars").alias("whole"))
    named = F.col("kind") > OTHER
    sure = framed.join(whole, "host").where(named | ((F.col("kind") == OTHER) & (F.col("chars") >= F.col("whole"))))
    best = F.struct(F.greatest("kind", F.lit(OTHER)), F.when(named, F.col("n")).otherwise(F.col("depth").cast("long")), "chars", -F.col("token"))
    slot = sure.groupBy("host").agg(F.max_by("token", best).alias("slot"), F.max_by(named, best).alias("named"))
    members = classes.join(valid, ["host", "vector"], "left_semi").groupBy("host").agg(F.collect_list(F.when(F.col("element"), F.col("token"))).alias("elements"), F.collect_list(F.when(~F.col("element"), F.col("token"))).alias("texts"), F.collect_list(F.when(~F.col("element") & F.col("often"), F.col("token"))).alias("often"))
    texts = F.when(F.col("named"), F.col("often")).otherwise(F.col("texts"))
    return stage(slot.join(members, "host").select("host", "slot", "elements", texts.alias("texts")), "html-templates")


def slots(page: Page, slot: int | None, elements: set[int], texts: set[int]) -> list[str]:
    """A page's blocks inside its article slot, less the template's text and marked template elements there.

    Text of the template is what many pages of the host repeat (see templates); a page that has
    nothing else in its slot keeps it.
    """
    within = inside(page, slot) if slot is not None else []
    mine = [i for i, a in enumerate(page.at) if page.kept[i] and within and within[a] and page.marks[i] not in elements]
    if not mine:
        slot = own_slot(page)
        within = inside(page, slot) if slot is not None else [False] * len(page.nodes)
        mine = [i for i, a in enumerate(page.at) if page.kept[i] and within[a]]
    fixed = {i for i in mine if texts and _text_token(page, i) in texts}
    return [page.texts[i] for i in mine if i not in fixed or len(fixed) == len(mine)]


def _extract(batches):
    for batch in _slices(batches):
        pages = zip(_pages_of(batch), *(batch.column(c).to_pylist() for c in ("slot", "elements", "texts_of_host")))
        out = ["\n\n".join(slots(page, slot, set(elements or ()), set(texts or ()))) for page, slot, elements, texts in pages]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to page_id, url, text, n_chars: the main text of each whole page.

    Blocks lie inside the article slot of the host's template (or, if a page has no text there or its
    host no template, of its own), outside of silent and aside elements, and are not template text.
    Blocks are joined by two line feeds. Null or empty html, or nothing found: empty text. Null ids
    and URLs stay (a page without a host has no template); repeated rows stay and count once for the
    template; of equally good slots the one with the smaller token counts; other columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    parsed = stage(pages.select("page_id", "url", "html", host.alias("host")).mapInArrow(_parse_all, PARSED), "html-blocks")
    known = templates(parsed).withColumnRenamed("texts", "texts_of_host")
    known = small_bytes(known, (F.size("elements") + F.size("texts_of_host")) * 8 + 64, BROADCAST)
    return parsed.join(known, "host", "left").select("page_id", "url", *Page._fields, "slot", "elements", "texts_of_host").mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
