"""Main-text extraction with site template removal.

Each page is parsed into an element tree. Every block subtree of its body is hashed, and the hashes are counted per host
in Spark: a subtree that recurs with at least ``min_pages`` distinct main texts of its host is the site's template and is
deleted from all its pages, whatever its tag or class. The main text is picked from what is left: the longest article
element, else the main element, else the body. What a site shows on too few pages to recur (menus, asides, forms,
adverts, reader comments, ...) is then deleted by element, role and class words.

A recurrence counts once for each distinct main text, so copies of one article do not make its paragraphs a template. An
article's paragraphs, headings, cells and list items are never template, nor is the page's longest article; its lists,
tables and other blocks may be.

Defined results: a null or empty html gives an empty text; a page without an article or main element is read from its
body; broken markup is read as far as it goes; a null url belongs to the host ""; repeated rows get equal texts; an
empty table gives an empty result; input columns other than id, url and html are ignored.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import q, release, texts, written
from .url_filter import host_and_path

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body caption dd dt head html legend li option tbody td tfoot th thead tr".split())
_SCOPE = frozenset("table td th body html article section div main ul ol dl blockquote".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd tbody thead tfoot tr td th caption figcaption hgroup".split())
_JUNK = frozenset("head nav footer aside form menu button select option input label fieldset dialog search script style canvas audio video map".split()) | _RAW
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr "
    "notice notices notification alert sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments "
    "commentlist replies disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget widgets "
    "pagination pager toolbar skip paywall disclaimer".split()
)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PIECES = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SALTS = 16


class Page:
    """The element tree: tag, attribute text and parent by node; ``parts`` holds (node, text) and (node, None) at block
    borders, in page order. Node 0 is the document."""

    def __init__(self, source: str):
        self.tag, self.attrs, self.parent = ["#"], [""], [-1]
        self.parts: list[tuple[int, str | None]] = []
        stack, at, lower = [0], 0, None
        add = self.parts.append
        for m in _TOKEN.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                add((stack[-1], source[at : m.start()]))
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if tag not in _BLOCK and self.tag[stack[k]] in _BLOCK:
                        break  # an inline end tag does not close blocks
                if tag in _BLOCK:
                    add((stack[-1], None))
                continue
            if tag in _CLOSES_P:
                self._close(stack, "p")
            elif tag == "li":
                self._close(stack, "li", ("ul", "ol", "menu"))
            elif tag in ("dt", "dd"):
                self._close(stack, "dt", ("dl",))
                self._close(stack, "dd", ("dl",))
            elif tag in ("td", "th"):
                self._close(stack, "td", ("table", "tr"))
                self._close(stack, "th", ("table", "tr"))
            elif tag == "tr":
                self._close(stack, "tr", ("table",))
            if tag in _BLOCK:
                add((stack[-1], None))
            if tag == "br":
                add((stack[-1], "\n"))
            if tag in _VOID:
                continue
            self.tag.append(tag)
            self.attrs.append(m[3] or m[6] or "")
            self.parent.append(stack[-1])
            if tag in _RAW:
                lower = lower or source.lower()
                end = lower.find("</" + tag, at)
                end = len(source) if end < 0 else end
                close = source.find(">", end)
                at = len(source) if close < 0 else close + 1
            elif not (m[3] or m[6] or "").rstrip().endswith("/") or tag in _BLOCK:
                stack.append(len(self.tag) - 1)
        if at < len(source):
            add((stack[-1], source[at:]))
        n = len(self.tag)
        self.parts = [(k, _html.unescape(t) if t and "&" in t else t) for k, t in self.parts]
        self.length = [0] * n
        for k, t in self.parts:
            if t:
                self.length[k] += len(t.strip())
        for k in range(n - 1, 0, -1):
            self.length[self.parent[k]] += self.length[k]
        self.holds = [False] * n  # an article or main element, or the body, within
        for k in range(n - 1, 0, -1):
            if self.holds[k] or self.tag[k] in ("article", "main", "body"):
                self.holds[self.parent[k]] = True

    def _close(self, stack, tag, scope=()):
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t == tag:
                del stack[k:]
                self.parts.append((stack[-1], None))
                return
            if t in (scope or _SCOPE):
                return

    def is_junk(self, k: int) -> bool:
        """No article by its element, role or class words."""
        tag, attrs = self.tag[k], self.attrs[k]
        if tag in _JUNK:
            return not self.holds[k] or tag in _RAW or tag == "head"
        if not attrs or self.holds[k] or tag in ("html", "body", "main"):
            return False
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in _ROLES:
                return True
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return True
            if name in ("class", "id"):
                words = {w.lower() for token in value.split() for w in _PIECES.findall(_CAMEL.sub(" ", token))}
                if not words.isdisjoint(_WORDS) or value.strip().lower() in ("header", "site-header", "page-header", "top-header", "global-header"):
                    return True
        return False

    def below(self, marked: list[bool]) -> list[bool]:
        """Nodes that are marked or lie in one that is."""
        out = list(marked)
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        return out

    def longest_article(self, gone=None) -> int | None:
        """The longest article element that lies in no other."""
        if "article" not in self.tag:
            return None
        inner = self.below([t == "article" for t in self.tag])
        tops = [k for k in range(1, len(self.tag)) if self.tag[k] == "article" and not inner[self.parent[k]] and not (gone and gone[k])]
        return max(tops, key=lambda k: (self.length[k], -k), default=None)

    def main_text(self, gone: list[bool], rules: bool) -> tuple[list[bool], list[bool]]:
        """(nodes of the main element, nodes deleted), from what ``gone`` leaves. Without ``rules`` only markup goes."""
        n = len(self.tag)
        junk = self.below([gone[k] or (self.is_junk(k) if rules else self.tag[k] in _RAW or self.tag[k] == "head") for k in range(n)])
        if not rules:
            return [True] * n, junk
        root = self.longest_article(junk)
        if root is None:
            root = next((k for k in range(1, n) if not junk[k] and (self.tag[k] == "main" or 'role="main"' in self.attrs[k])), 0)
        within = self.below([k == root for k in range(n)])
        for k in range(1, n):  # of a header, an article's headings stay
            if self.tag[k] == "header" and not self.holds[k] and not (root and within[k]):
                junk[k] = True
        return within, self.below(junk)

    def hashes(self) -> list[int]:
        import xxhash

        n = len(self.tag)
        kids: list[list] = [[] for _ in range(n)]
        for k in range(1, n):
            kids[self.parent[k]].append(k)
        own: list[list[str]] = [[] for _ in range(n)]
        for k, t in self.parts:
            if t and (t := " ".join(t.split())):
                own[k].append(t)
        out = [0] * n
        for k in range(n - 1, -1, -1):
            body = "\x00".join((self.tag[k], *own[k], *[f"\x01{out[c]}" for c in kids[k]]))
            out[k] = xxhash.xxh3_64_intdigest(body.encode("utf-8", "surrogatepass")) >> 1
        return out

    def candidates(self) -> list[int]:
        """Subtrees that may be template: block elements with text, but for the longest article and articles' prose."""
        own = self.longest_article()
        inside = self.below([t == "article" for t in self.tag])
        return [
            k for k in range(1, len(self.tag))
            if self.length[k] and self.tag[k] in _BLOCK and not self.holds[k] and self.tag[k] not in ("html", "body", "head", "main") and k != own
            and not (inside[k] and self.tag[k] in _PROSE)
        ]

    def signature(self, rules: bool = True) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(self.text((), rules).encode("utf-8", "surrogatepass")) >> 1

    def text(self, template=(), rules: bool = True) -> str:
        """The main text of what is left without the subtrees whose hash is in ``template``."""
        n = len(self.tag)
        gone = [False] * n
        if template:
            hashes = self.hashes()
            for k in self.candidates():
                gone[k] = hashes[k] in template
        within, gone = self.main_text(self.below(gone), rules)
        in_header, heading = [False] * n, [False] * n
        for k in range(1, n):
            p = self.parent[k]
            in_header[k] = in_header[p] or self.tag[k] == "header"
            heading[k] = heading[p] or self.tag[k] in _HEADINGS
        blocks, now = [], []
        for k, t in self.parts:
            if t is None:
                if now and (block := " ".join("".join(now).split())):
                    blocks.append(block)
                now = []
            elif within[k] and not gone[k] and (heading[k] or not in_header[k]):
                now.append(t)
        if now and (block := " ".join("".join(now).split())):
            blocks.append(block)
        return "\n\n".join(blocks)


def read_page(b: bytes | None) -> Page:
    return Page(b.decode("utf-8", "replace") if b else "")


def page_subtrees(pages: DataFrame, url_col: str, html_col: str, rules: bool) -> DataFrame:
    """(page, host, sig, hashes) for each distinct page: its row's hash, main text's hash and candidate subtrees."""

    def subtrees(batches):
        import pyarrow as pa

        for batch in batches:
            sigs, hashes = [], []
            for b in texts(batch.column(2)):
                page = read_page(b)
                all_ = page.hashes()
                hashes.append(sorted({all_[k] for k in page.candidates()}))
                sigs.append(page.signature(rules))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sigs, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["page", "host", "sig", "hashes"])

    rows = pages.select(_page_key(url_col, html_col).alias("page"), host_and_path(q(url_col))[0].alias("host"), q(html_col))
    return rows.mapInArrow(subtrees, "page long, host string, sig long, hashes array<long>")


def _page_key(url_col: str, html_col: str):
    return F.xxhash64(q(url_col), q(html_col))


def site_templates(subtrees: DataFrame, min_pages: int = 3) -> DataFrame:
    """(host, hash) of the subtrees that recur with at least ``min_pages`` distinct main texts of their host. Counted by
    (host, hash, main text) first, so a subtree that all pages of a large host have is merged before it meets in a task."""
    seen = subtrees.select("host", "sig", F.explode("hashes").alias("hash")).distinct()
    return seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("host", "hash")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 3, max_broadcast: int = 300_000, rules: bool = True) -> DataFrame:
    """(id, url, text, n_chars) for each page. Up to ``max_broadcast`` template hashes are sent to the tasks; more are
    joined to the pages' own subtrees, a few narrow rows a page, and each page is given the hashes that it has (a large
    host's rows are dealt over ``SALTS``). ``rules=False``: templates alone, no element or class words, the whole body."""
    spark = pages.sparkSession
    subtrees = page_subtrees(pages, url_col, html_col, rules)
    templates = written(site_templates(subtrees, min_pages), "html-templates")
    host = host_and_path(q(url_col))[0]
    rows = pages.select(q(id_col).alias("id"), q(url_col).alias("url"), host.alias("host"), q(html_col).alias("html"), _page_key(url_col, html_col).alias("page"))
    if templates.count() <= max_broadcast:
        by_host: dict = {}
        for host, found in zip(*(c.to_pylist() for c in templates.toArrow().columns), strict=True):
            by_host.setdefault(host, set()).add(found)
        release(templates)
        shared = spark.sparkContext.broadcast(by_host)

        @F.arrow_udf(T.StringType())
        def text(hosts, sources):
            import pyarrow as pa

            return pa.array([read_page(b).text(shared.value.get(h, ()), rules) for h, b in zip(hosts.to_pylist(), texts(sources), strict=True)], pa.string())

        out = rows.withColumn("text", text("host", "html"))
    else:
        own = subtrees.select("page", "host", F.explode("hashes").alias("hash"), F.pmod("page", F.lit(SALTS)).alias("salt"))
        dealt = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
        lists = own.join(dealt, ["host", "hash", "salt"]).groupBy("page").agg(F.collect_set("hash").alias("template"))

        @F.arrow_udf(T.StringType())
        def text(lists, sources):
            import pyarrow as pa

            return pa.array([read_page(b).text(frozenset(h or ()), rules) for h, b in zip(lists.to_pylist(), texts(sources), strict=True)], pa.string())

        out = rows.join(lists, "page", "left").withColumn("text", text("template", "html"))
    return out.select(F.col("id").alias(id_col), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
