"""HTML extraction by site style trees (operator 7).

The DOMs of a host's pages are merged by the style path of their nodes (tags and
classes from the root).  Spark counts, for each host and path, the different
contents and the different presentations (the sequence of child tags) of that
node over the host's different pages.  Their entropies, scaled to 0..1, give
the node's importance: a node that looks and reads the same on every page has
none.  All nodes with text take part, so the menus, footers and notices of a site
go by their entropy.  Each page is then parsed again, and branches of low
importance are left out; so are what a page shows anew each time and the tree
can't tell from an article (comments of readers, related links), and the furniture
of hosts with few pages, which are known by their markup.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxflow.llm.scratch import Scratch

#: Different pages of a host from which on importance is judged, and the least importance of content.
MIN_PAGES = 4
MIN_IMPORTANCE = 0.2

# Fixed word lists of HTML: elements without text content, without end tag, and that start a block.
UNREAD = frozenset("script style noscript template head title svg math iframe object embed audio video canvas map".split())
FORMS = frozenset("form button select option optgroup textarea input label fieldset datalist output".split())
# Elements that may stand in a head; any other ends it, since its end tag may be left out.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
FURNITURE = frozenset("nav footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - {"body", "html"}
# Class, id and role words of page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices paywall popup promo promoted related search share sharing "
    "sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
CONTENT_WORDS = frozenset("article content entry main post story".split())
# How sure furniture is: a form or a wrapper with a furniture word may hold the whole page, if it starts before its article.
NONE, FORM, WRAPPER, SURE = range(4)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class _Page(HTMLParser):
    """Blocks of a page in order: (style path, furniture or not, text); and the child tags of each path."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, bool, int]] = []  # tag, path, unread, furniture
        self.blocks: list[tuple[str, int, str]] = []  # furniture is a bool once done
        self.children: dict[str, list[str]] = {}
        self.parts: list[str] = []
        self.where: tuple[str, int] | None = None
        self.article = False  # whether one has started outside of sure furniture

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text and self.where:
            self.blocks.append((*self.where, text))
        self.parts, self.where = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self._close("head", frozenset(("template", "body")))
        elif self.stack and self.stack[-1][0] == "head" and tag not in HEAD:
            self.stack.pop()
        if tag in BLOCKS:
            self.flush()
            if tag in ENDS_P:
                self._close("p", BLOCKS - {"p"})
        elif tag == "br":
            self.parts.append(" ")
        _, path, unread, furniture = self.stack[-1] if self.stack else ("", "", False, NONE)
        names = sorted({w for k, v in attrs if k in ("class", "id", "role") and v for w in v.lower().split()})
        words = {w for n in names for w in _WORD.findall(n)}
        inside = any(t in ("article", "main") for t, *_ in self.stack)
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        named = bool(words & FURNITURE_WORDS)
        if tag in ("main", "article") and furniture != SURE:
            furniture, self.article = NONE, True
        elif furniture == FORM and tag in BLOCKS and tag not in FORMS and words & CONTENT_WORDS and not named:
            furniture = NONE
        if hidden or tag in FURNITURE or (tag in FORMS and tag != "form") or (tag == "header" and not inside):
            furniture = SURE
        elif tag == "form":
            furniture = SURE if self.article else max(furniture, FORM)
        elif tag not in ("html", "body", "main", "article") and named and not words & CONTENT_WORDS:
            furniture = SURE if self.article else max(furniture, WRAPPER)
        self.children.setdefault(path, []).append(tag)
        if tag not in VOID:
            self.stack.append((tag, f"{path}>{'.'.join([tag, *names])}" if tag in BLOCKS or not path else path, unread or tag in UNREAD, furniture))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        self._close(tag, frozenset())

    def _close(self, tag, barrier):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if self.stack[i][0] in barrier:
                return

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.stack.pop()
        _, path, unread, furniture = self.stack[-1] if self.stack else ("", "", False, NONE)
        if unread:
            return
        if self.where is None:
            if not data.strip():
                return
            self.where = (path, furniture)
        elif self.where[1] != furniture and data.strip():
            self.flush()
            self.where = (path, furniture)
        self.parts.append(data)

    def done(self):
        self.close()
        self.flush()
        # a form that holds all there is is no furniture
        least = WRAPPER if all(x for _, x, _ in self.blocks) else FORM
        self.blocks = [(path, x >= least, text) for path, x, text in self.blocks]
        return self


def parse(html: str | None) -> _Page:
    """Never fails: what isn't markup counts as text."""
    page = _Page()
    page.feed((html or "").replace("\x00", ""))
    return page.done()


def _send_nodes(batches):
    """(host, page, path, content, shape): the nodes of each page that have text."""
    import hashlib

    def digest(text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)

    for batch in batches:
        rows = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = parse(html)
            nodes: dict[str, list[str]] = {}
            for path, _, text in page.blocks:
                nodes.setdefault(path, []).append(text)
            whole = digest("\n".join(x for _, _, x in page.blocks))
            rows += [(host, whole, path, digest("\n".join(texts)), digest(" ".join(page.children.get(path, ())))) for path, texts in nodes.items()]
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "page", "path", "content", "shape"])


def _entropy(nodes: DataFrame, column: str) -> DataFrame:
    counts = nodes.groupBy("host", "path", column).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return sums.select("host", "path", "pages", ((F.ln("pages") - F.col("s") / F.col("pages")) / F.ln("pages")).alias(column))


def node_importance(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of nodes on two or more different pages.

    Importance is the larger of the scaled entropies of content and of
    presentation; equal pages of a host count once.
    """
    nodes = pages.select(host_of("url").alias("host"), "html").mapInArrow(_send_nodes, "host string, page long, path string, content long, shape long")
    nodes = Scratch(pages.sparkSession, "style-nodes").write(nodes.distinct(), "nodes")
    content = _entropy(nodes, "content").where("pages > 1")
    shape = _entropy(nodes, "shape").where("pages > 1").drop("pages")
    return content.join(shape.hint("merge"), ["host", "path"]).select("host", "path", "pages", F.greatest("content", "shape").alias("importance"))


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def low_paths(host_paths: list[str] | None) -> Callable[[str], bool]:
    """Whether a path or one above it is among the given."""
    low = set(host_paths or ())
    known: dict[str, bool] = {}

    def below(path: str) -> bool:
        if low and path not in known:
            hit, at = path in low, path.find(">", 1)
            while not hit and at > 0:
                hit, at = path[:at] in low, path.find(">", at + 1)
            known[path] = hit
        return known.get(path, False)

    return below


def main_text(html: str | None, low: list[str] | None) -> str:
    """Blocks neither below a path in ``low`` nor furniture; if nothing but paths in ``low`` is left, those stay."""
    blocks, below = parse(html).blocks, low_paths(low)
    plain = [(path, text) for path, furniture, text in blocks if not furniture]
    return "\n\n".join([text for path, text in plain if not below(path)] or [text for _, text in plain])


def _extract(batches):
    for batch in batches:
        texts = [main_text(h, low) for h, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist())]
        texts = [t.encode("utf-8", "replace").decode() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html.

    Text is the article: blocks in page order joined by an empty line, white
    space inside a block turned into one space, references decoded.  Left out
    are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles, comments of readers, and branches of low importance on hosts with
    ``MIN_PAGES`` or more different pages.  A form, or a wrapper named after
    furniture, that starts before the article doesn't hide a main or article
    in it, nor does a form hide a page that has nothing outside of it.

    Null or empty html, and html without content, give an empty text.  A null
    url belongs to a host of its own name "".  Repeated rows get a row each;
    further columns are not read.  An empty table gives no rows.
    """
    low = node_importance(pages).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < MIN_IMPORTANCE))
    low = low.groupBy("host").agg(F.collect_list("path").alias("low"))
    # written and read back, so that Spark knows its size when it picks the join
    low = Scratch(pages.sparkSession, "style-low").write(low, "low").withColumnRenamed("host", "host_")
    rows = pages.select("page_id", "url", "html", host_of("url").alias("host_")).join(low, "host_", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "low").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
