"""Main text of web pages by removal of what a site repeats, and of what markup names as no part of an article.

Each page is parsed to a tree. The elements under its main container (``article``, else ``main``, else the body) are
hashed with all they contain, and Spark counts for each host on how many pages of different content a subtree stands.
Those that stand on more than half of them are the site's template; a second pass deletes them and writes the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Pages of different content on which a subtree must stand, outside of a marked article and within one, and the share of
#: the host's that it must exceed. Within an article copies of texts are more likely than a template, so that asks for more.
LEAST_PAGES, LEAST_ARTICLES, SHARE = 3, 10, 0.5
#: Rows of the template table that may be broadcast: at about 40 bytes each, 4 MB.
BROADCAST_ROWS = 100_000
#: Text in links from which on a list or box of two links or more is a menu (outside of a marked article).
MENU_SHARE = 0.8

# Names of HTML elements, of roles and of the words that class names use for what is no part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th".split())
HEAD = frozenset("title meta link script style base noscript template".split())
CLOSES_P = BLOCK - {"body", "caption", "html", "legend", "optgroup", "option", "tbody", "tfoot", "thead", "tr"}
NO_TEXT = frozenset(
    "head title script style noscript template iframe object applet svg math canvas audio video map xmp noembed noframes datalist "
    "nav menu aside footer form search button select textarea input dialog".split()
)
NO_TEXT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NO_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs pagination pager sidebar aside rail widget widgets footer masthead topbar toolbar comment comments commentlist disqus respond reply replies cookie "
    "cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended skip hidden".split()
)
#: Words before which or after which a name speaks of an element's surroundings or title, such as ``has-sidebar``, ``entry-header``.
NEGATED, OF_THE_ARTICLE = frozenset("has no with without".split()), frozenset("article content entry page post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MENUS = frozenset("dl div ol p section table ul".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?(?![^\s/=])""", re.IGNORECASE)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NO_LETTER = re.compile(r"[^a-z]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Page:
    """A page's elements in the order of their beginnings, and its texts and breaks between blocks.

    Of element i: ``tags[i]``, ``parents[i]``, ``dropped[i]`` (named as no text), ``article[i]`` (a candidate for the
    container), ``lengths[i]`` and ``linked[i]`` (characters in it, and of these in links), ``links[i]``, ``digests[i]``.
    """

    def __init__(self, html: str, digest: bool = True):
        self.tags, self.parents, self.dropped, self.article, self.lengths, self.linked, self.links, self.titled = ["html"], [-1], [False], [False], [0], [0], [0], [False]
        self.named = [False]  # dropped for a class, id or role, which a container inside overrules
        self.hashes = [xxhash.xxh64()] if digest else []
        self.events: list[tuple[int, str] | None] = []
        self.stack, self.open = [0], {"html": 1}
        self.digest = digest
        self.parse(html)

    def parse(self, html: str) -> None:
        at, end, tag = 0, len(html), TAG
        while at < end:
            begin = html.find("<", at)
            if begin < 0:
                begin = end
            if begin > at:
                self.text(html[at:begin])
            if begin == end:
                break
            follower = html[begin + 1 : begin + 2]
            if follower in "!?":
                at = self.skipped(html, begin)
                continue
            found = tag.match(html, begin)
            if found is None and tag is TAG and (follower.isalpha() or follower == "/"):
                found = BROKEN_TAG.match(html, begin)
                if found is not None:
                    tag = BROKEN_TAG  # a quote that is never closed; from here on quotes mean nothing
            if found is None:
                if follower == "/":  # a bogus comment
                    close = html.find(">", begin)
                    at = end if close < 0 else close + 1
                elif follower.isascii() and follower.isalpha():  # a tag that the page's end cuts off
                    break
                else:
                    self.text("<")
                    at = begin + 1
                continue
            at = found.end()
            name = found[2].lower()
            if found[1]:
                self.close(name)
                continue
            self.begin(name, found[3])
            if name in RAW:
                close = ENDS[name].search(html, at)
                if close is None:
                    break
                at = close.start()
        while self.stack:
            self.pop()

    @staticmethod
    def skipped(html: str, begin: int) -> int:
        if html.startswith("<!--", begin):
            if html.startswith((">", "->"), begin + 4):
                return html.index(">", begin) + 1
            close, width = html.find("-->", begin + 4), 3
        else:
            close, width = html.find(">", begin), 1
        return len(html) if close < 0 else close + width

    def text(self, raw: str) -> None:
        node = self.stack[-1]
        shown = raw.strip()
        if shown and self.tags[node] == "head":
            self.pop()
            node = self.stack[-1]
        self.events.append((node, raw))
        if shown:
            self.lengths[node] += len(shown)
            if self.digest:
                self.hashes[node].update(shown.encode("utf-8", "surrogatepass") + b"\0")

    def begin(self, name: str, attributes: str) -> None:
        stack, tags = self.stack, self.tags
        if tags[stack[-1]] == "head" and name not in HEAD:
            self.pop()
        if name == "html":
            return
        if self.open.get("p") and name in CLOSES_P:
            self.close("p")
        elif name in ("li", "dd", "dt", "tr", "td", "th", "option") and self.open.get(name):
            self.close_item(name)
        if name in BLOCK:
            self.events.append(None)
        node = len(tags)
        tags.append(name)
        self.parents.append(stack[-1])
        named, article = self.marks(name, attributes) if attributes else (False, name in ("article", "main"))
        self.named.append(named)
        self.dropped.append(name in NO_TEXT)
        self.article.append(article and not named)
        self.lengths.append(0)
        self.linked.append(0)
        self.links.append(0)
        self.titled.append(name == "h1")
        if self.digest:
            self.hashes.append(xxhash.xxh64(name))
        if name in SPACED:
            self.events.append((node, " "))
        stack.append(node)
        self.open[name] = self.open.get(name, 0) + 1
        if name in VOID:
            self.pop()

    def marks(self, name: str, attributes: str) -> tuple[bool, bool]:
        """Whether attributes name an element as no text, and whether it is a container of the main text."""
        words: list[str] = []
        article, unseen, role = name in ("article", "main"), False, ""
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "class" or (key == "id" and name not in HEADINGS and name != "p"):
                words += [w for one in value.split() for w in self.words(one)]
            elif key == "role":
                role = value.strip().lower()
            elif key == "itemprop":
                article = article or value.strip() == "articleBody"
            elif key == "style":
                unseen = unseen or bool(UNSEEN.search(value))
            else:
                unseen = unseen or (key == "hidden" and value.lower() != "until-found") or value.lower() == "true"
        if name in ("html", "body"):
            return False, False
        return unseen or role in NO_TEXT_ROLES or any(w in NO_TEXT_WORDS for w in words), article or role in ("article", "main")

    @staticmethod
    def words(name: str) -> list[str]:
        """The words of one class name or id; none if it speaks of surroundings or is the article's own header."""
        words = [w for w in NO_LETTER.split(CAMEL.sub("-", name).lower()) if w]
        if words and (words[0] in NEGATED or words[-1] == "header" and words[0] in OF_THE_ARTICLE):
            return []
        return ["banner" if w == "header" and len(words) <= 2 else w for w in words]

    def close_item(self, name: str) -> None:
        """An item's begin tag ends the one before, if that belongs to the same list or table."""
        ends = {"li": ("ol", "ul", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select", "datalist")}.get(name, ("table",))
        alike = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
        for place in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[place]]
            if tag in alike:
                while len(self.stack) > place:
                    self.pop()
                return
            if tag in ends or (tag == "tr" and name != "tr"):
                return

    def close(self, name: str) -> None:
        if not self.open.get(name) or name in ("html", "body"):
            if name == "p":  # an empty paragraph
                self.events.append(None)
            return
        if name not in BLOCK and name not in SPACED:  # such an end tag does not end blocks
            for node in reversed(self.stack):
                tag = self.tags[node]
                if tag == name:
                    break
                if tag in BLOCK or tag in SPACED:
                    return
        while self.tags[self.pop()] != name:
            pass

    def pop(self) -> int:
        node = self.stack.pop()
        name, up = self.tags[node], self.parents[node]
        self.open[name] -= 1
        if name in BLOCK:
            self.events.append(None)
        elif name in SPACED:
            self.events.append((node, " "))
        if name == "a":
            self.linked[node] = self.lengths[node]
            self.links[node] = 1
        if up >= 0:
            self.lengths[up] += self.lengths[node]
            self.linked[up] += self.linked[node]
            self.links[up] += self.links[node]
            self.titled[up] = self.titled[up] or self.titled[node]
            if self.digest:
                self.hashes[up].update(self.hashes[node].digest())
        return node

    def settle(self) -> list[bool]:
        """What is shown, element by element: all under the containers but what names or menus rule out."""
        n, tags, parents = len(self.tags), self.tags, self.parents
        # what holds a container is not ruled out by its name, only by what it is
        holds = [False] * n
        gone = [False] * n
        inside = [False] * n  # of an article or main
        for i in range(n):
            up = parents[i]
            inside[i] = up >= 0 and (inside[up] or tags[up] in ("article", "main"))
        candidate = self.article
        for i in range(n - 1, 0, -1):
            holds[parents[i]] = holds[parents[i]] or holds[i] or candidate[i]
        for i in range(1, n):
            ruled = self.dropped[i] and not (tags[i] == "form" and (holds[i] or self.titled[i]))
            ruled = ruled or (self.named[i] and not holds[i] and not (self.titled[i] and tags[i] not in ("article", "main")))
            ruled = ruled or (tags[i] == "header" and not inside[i] and not holds[i])
            gone[i] = gone[parents[i]] or ruled
        roots = [i for i in range(1, n) if candidate[i] and not gone[i]]
        articles = [i for i in roots if tags[i] != "main"] or roots
        if any(self.titled[i] for i in articles) and len(articles) > 1:
            articles = [i for i in articles if self.titled[i]]
        self.marked = bool(articles)
        if not articles:
            articles = [0]
            for i in range(1, n):
                if gone[parents[i]] or (tags[i] in MENUS and self.links[i] > 1 and self.linked[i] >= MENU_SHARE * self.lengths[i]):
                    gone[i] = True
        chosen = set(articles)
        shown = [False] * n
        for i in range(n):
            shown[i] = i in chosen or (i > 0 and shown[parents[i]] and not gone[i])
        self.roots = [i for i in articles if i == 0 or not shown[parents[i]]]
        return shown

    def subtrees(self) -> tuple[int, set[int]]:
        """A hash of what the page's containers hold, and those of the blocks in them that hold text."""
        shown = self.settle()
        whole = xxhash.xxh64(b"".join(self.hashes[i].digest() for i in self.roots)).intdigest()
        roots = {*self.roots, 0}
        return whole, {self.hashes[i].intdigest() for i in range(1, len(shown)) if shown[i] and i not in roots and self.tags[i] in BLOCK and self.tags[i] != "body" and self.lengths[i]}

    def blocks(self, template: frozenset[int] = frozenset()) -> list[str]:
        """The texts of the blocks that are shown, without the subtrees of the template."""
        shown = self.settle()
        if template:
            for i in range(1, len(shown)):
                held = self.tags[i] in BLOCK and i not in self.roots and self.hashes[i].intdigest() in template
                if held or (not shown[self.parents[i]] and i not in self.roots):
                    shown[i] = False
        found, block = [], []
        for event in (*self.events, None):
            if event is not None:
                if shown[event[0]]:
                    block.append(event[1])
            elif block:
                text = "".join(block)
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    found.append(text)
                block = []
        return found


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def site(url: F.Column) -> F.Column:
    """A url's host: behind ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1))
    return F.when(host != "", host)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sites, subtrees, pages, marks = [], [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Page(html.as_py() or "")
            whole, held = page.subtrees()
            for x in (0, *held):
                sites.append(host)
                subtrees.append(signed(x))
                pages.append(signed(whole))
                marks.append(page.marked)
        yield pa.RecordBatch.from_arrays([pa.array(sites, pa.int64()), pa.array(subtrees, pa.int64()), pa.array(pages, pa.int64()), pa.array(marks, pa.bool_())], ["site", "subtree", "page", "marked"])


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_articles: int = LEAST_ARTICLES, share: float = SHARE) -> DataFrame:
    """``site, subtrees`` from ``site, html``: hashes of what more than ``share`` of a host's pages have.

    Pages of equal content count once, so copies of a page make no template. A host's list is no longer than
    its pages' average number of blocks over ``share``.
    """
    rows = pages.where("site is not null").mapInArrow(_count, "site long, subtree long, page long, marked boolean")
    counts = checkpointed(rows.distinct().groupBy("site", "subtree", "marked").agg(F.count("*").alias("n")))
    least = F.when(F.col("marked"), least_articles).otherwise(least_pages)
    all_pages = counts.where("subtree = 0").groupBy("site").agg(F.sum("n").alias("all_pages"))
    many = counts.where((F.col("subtree") != 0) & (F.col("n") >= least)).join(all_pages, "site").where(F.col("n") > F.col("all_pages") * share)
    return many.groupBy("site").agg(F.collect_set("subtree").alias("subtrees"))


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES, least_articles: int = LEAST_ARTICLES, share: float = SHARE) -> DataFrame:
    """``page_id, url, text, n_chars``: a row for each row of ``pages``.

    Null or empty html, and pages without an article, have the text ``''``. Pages whose url is null or has no host are
    judged alone, as are those of a host with few pages. Rows may repeat, and count once where they are equal. Other
    columns are neither read nor returned; an empty table gives an empty result. Pages are parsed whole, however long.
    """
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.xxhash64(site(F.col(url).cast("string"))).alias("site"), F.col(html).cast("string").alias("html"))
    slim = slim.withColumn("site", F.when(site(F.col("url")).isNotNull(), F.col("site")))
    repeated = checkpointed(templates(slim.select("site", "html"), least_pages, least_articles, share))
    rows = repeated.agg(F.coalesce(F.sum(F.size("subtrees") + 1), F.lit(0))).first()[0]
    joined = slim.join(F.broadcast(repeated) if rows <= BROADCAST_ROWS else repeated, "site", "left").select("page_id", "url", "html", "subtrees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, held in zip(batch.column(2), batch.column(3), strict=True):
                template = frozenset(x & ((1 << 64) - 1) for x in held.as_py() or ())
                texts.append("\n\n".join(Page(source.as_py() or "", bool(template)).blocks(template)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(slim.dtypes)["page_id"]
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op13_site_template_removal(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
