"""Main text of web pages: site templates found by subtree hashes per host, and page furniture, are deleted."""

import html
import re
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from leadloom.llm.batches import column, ship, slices
from leadloom.llm.common import staged
from leadloom.llm.url_reputation import host_and_path

#: A quote opens a value only after '=', and only if it is closed somewhere; a tag without '>' outside values ends at the first one.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>"""
                 r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^<>]*+\Z""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike
    strong sub sup time tt u var wbr""".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5
    h6 header hgroup hr main menu nav ol p pre search section table ul""".split())
#: An element that opens ends an open one of these kinds, unless one of the others stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
# What is no main text, whatever the site.
FURNITURE = frozenset("""head script style noscript template nav footer aside form button select textarea input iframe svg math canvas audio
    video object menu dialog search""".split())
FURNITURE_NAMES = frozenset("""ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent
    gdpr notice notification popup modal overlay newsletter subscribe subscription paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs
    footer masthead comment comments disqus reply replies share sharing social related recommended widget copyright login signup search pagination
    pager toolbar skip alert contentinfo complementary dialog""".split())
COMMENT_NAMES = frozenset("comment comments disqus reply replies".split())
CONTENT = frozenset(("article", "main"))
#: Blocks of running text: inside an article they are never a template.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table thead tbody tfoot tr td th caption dl dt dd li ol ul hr".split())


class Page:
    """Elements of a page in order of their start tags, and its flow of texts and block ends.

    Forgiving like a browser: unknown end tags are ignored, paragraphs, list items
    and cells end where the next one starts, and everything ends with the page.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.inside, self.attributes = [""], [0], [[]], [""]
        self.flow: list[tuple[int, str | None]] = []
        stack, at = [0], 0
        for m in iter(lambda: TAG.search(source, at), None):
            self._text(stack[-1], source[at:m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._end(stack, name)
                continue
            self._start(stack, name, m[3] or m[6] or "")
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = close.end() if close else len(source)
                self._end(stack, name)
        self._text(stack[-1], source[at:])
        self.flow.append((0, None))

    def _text(self, node: int, raw: str) -> None:
        if raw:
            value = html.unescape(raw) if "&" in raw else raw
            self.flow.append((node, value))
            if plain := " ".join(value.split()):
                self.inside[node].append(plain)

    def _start(self, stack: list[int], name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._close(stack, {"p"}, CLOSES_P - {"p"} | {"td", "th", "li", "button"})
        if name in ENDS:
            self._close(stack, *ENDS[name])
        if name not in INLINE:
            self.flow.append((stack[-1], None))
        elif name == "br":
            self.flow.append((stack[-1], " "))
        if name in VOID:
            return
        node = len(self.tags)
        self.tags.append(name)
        self.parents.append(stack[-1])
        self.inside[stack[-1]].append(node)
        self.inside.append([])
        self.attributes.append(attributes)
        stack.append(node)

    def _close(self, stack: list[int], kinds: set, until: set) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag in kinds:
                del stack[depth:]
                self.flow.append((stack[-1], None))
                return
            if tag in until:
                return

    def _end(self, stack: list[int], name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag == name:
                del stack[depth:]
                if name not in INLINE:
                    self.flow.append((stack[-1], None))
                return
            if name in INLINE and tag not in INLINE:
                return

    def words(self) -> list[int]:
        """Words below every element, without those that are furniture by tag; six characters at least are a word in scripts without spaces."""
        out = [0] * len(self.tags)
        for node in range(len(self.tags) - 1, -1, -1):
            if self.tags[node] in FURNITURE and self.tags[node] != "form":
                out[node] = 0
                continue
            out[node] += sum(max(t.count(" ") + 1, len(t) // 6) for t in self.inside[node] if isinstance(t, str))
            if node:
                out[self.parents[node]] += out[node]
        return out

    def _beside(self, node: int, other: int) -> bool:
        """Whether neither of two elements stands in the other; a parent's number is below its children's."""
        low, high = min(node, other), max(node, other)
        while high > low:
            high = self.parents[high]
        return high != low

    def furniture(self) -> list[bool]:
        """Which elements are page furniture by tag, attribute or ancestor.

        Class, id and role names, and being a form, do not speak against an
        element that holds more than half of the page's words where no article
        or main element stands beside it: a page's text is no box.  Names of
        reader comments do, unless no word would be left.
        """
        out, article, words = [False], [False], self.words()
        mains = [n for n in range(1, len(self.tags)) if self.tags[n] in CONTENT]
        for node in range(1, len(self.tags)):
            tag, up = self.tags[node], self.parents[node]
            most = 2 * words[node] > words[0] and not any(self._beside(node, n) for n in mains)
            own = out[up] or (tag in FURNITURE and not (most and tag == "form")) or (tag == "header" and not article[up])
            if not own and self.attributes[node] and tag not in ("html", "body", "main"):
                names = {x for m in NAMED.finditer(self.attributes[node]) for x in re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())}
                own = bool(HIDDEN.search(self.attributes[node])) or bool(names & FURNITURE_NAMES) and (
                    not most or bool(names & COMMENT_NAMES) and words[node] < words[0])
            out.append(own)
            article.append(article[up] or tag in CONTENT)
        return out

    def content(self, furniture: list[bool]) -> list[int]:
        """The outermost article or main elements that are no furniture."""
        inside, out = [False], []
        for node in range(1, len(self.tags)):
            here = self.tags[node] in CONTENT and not furniture[node]
            if here and not inside[self.parents[node]]:
                out.append(node)
            inside.append(here or inside[self.parents[node]])
        return out

    def hashes(self) -> list[int]:
        """A signed 64-bit hash of every subtree: tag, texts with white space folded, and the children's hashes in order."""
        out = [0] * len(self.tags)
        for node in range(len(self.tags) - 1, -1, -1):
            parts = [f"<{out[x]}>" if isinstance(x, int) else x for x in self.inside[node]]
            value = xxhash.xxh64_intdigest("\x1f".join([self.tags[node], *parts]).encode("utf-8", "replace"))
            out[node] = value - (1 << 64) if value >> 63 else value
        return out

    def candidates(self, content: list[int]) -> list[int]:
        """Elements that may be part of a site's template: blocks with anything in them, article and main too, but no prose inside those."""
        within, mains, out = [False], set(content), []
        for node in range(1, len(self.tags)):
            within.append(within[self.parents[node]] or node in mains)
            tag = self.tags[node]
            if self.inside[node] and tag not in INLINE and tag not in ("html", "head", "body") and tag not in RAW and not (within[node] and tag in PROSE):
                out.append(node)
        return out

    def around(self, content: list[int]) -> set[int]:
        """The content elements, all that they stand in and all that stands in them."""
        out = {0}
        for node in content:
            while node not in out:
                out.add(node)
                node = self.parents[node]
        within = set(content)
        for node in range(1, len(self.tags)):
            if self.parents[node] in within:
                within.add(node)
        return out | within

    def below(self, drop: list[bool], more: set[int]) -> list[bool]:
        """``drop`` with the subtrees of ``more``."""
        out = [False]
        for node in range(1, len(self.tags)):
            out.append(drop[node] or out[self.parents[node]] or node in more)
        return out

    def weight(self, drop: list[bool], keep: list[bool] | None = None) -> int:
        """Words of the text outside ``drop`` (and in ``keep``); six characters at least are a word in scripts without spaces."""
        texts = (" ".join(value.split()) for node, value in self.flow if value and not drop[node] and (keep is None or keep[node]))
        return sum(max(t.count(" ") + 1, len(t) // 6) for t in texts if t)

    def text(self, template: frozenset[int] | set[int], more: frozenset[int] = frozenset()) -> str:
        """Blocks of the main text in page order, one per line, without furniture and without the subtrees in ``template`` or ``more``.

        A page of which nothing would be left is a copy of others, and what
        stands around its text is no box: its article stays, or all of it where
        it has none.  Of what is left, the article and main elements are the
        text if they hold half of it.
        """
        drop = furniture = self.furniture()
        content = self.content(furniture)
        if template or more:
            hashes = self.hashes()
            found = {n for n in self.candidates(content) if hashes[n] in template or hashes[n] in more}
            drop = self.below(furniture, found)
            if not self.weight(drop):
                drop = self.below(furniture, found - self.around(content)) if content else furniture
                drop = drop if self.weight(drop) else furniture
        mains = set(self.content(drop))
        keep = [False]
        for node in range(1, len(self.tags)):
            keep.append(keep[self.parents[node]] or node in mains)
        if not mains or 2 * self.weight(drop, keep) < self.weight(drop):
            keep = [True] * len(self.tags)
        blocks, run = [], []
        for node, value in self.flow:
            if value is None:
                if block := " ".join("".join(run).split()):
                    blocks.append(block)
                run.clear()
            elif keep[node] and not drop[node]:
                run.append(value)
        return "\n".join(blocks)


def subtree_hashes(source: str) -> list[int]:
    page = Page(source)
    hashes = page.hashes()
    return sorted({hashes[n] for n in page.candidates(page.content(page.furniture()))})


def hashed(rows: DataFrame, without: Callable[[], dict] = dict) -> DataFrame:
    """(host, key, hashes) of rows (host, key, html): the hashes of a page's subtrees, less those that ``without`` has for its host."""

    def run(batches):
        known = without()
        for batch in batches:
            for part in slices(batch, 2):
                found = [[x for x in subtree_hashes(h or "") if x not in known.get(host, ())]
                         for host, h in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["host", "key", "hashes"])

    return rows.mapInArrow(run, StructType([StructField("host", StringType()), StructField("key", LongType()), StructField("hashes", ArrayType(LongType()))]))


def templates(pages: DataFrame, url: str = "url", source: str = "html", least: int = 10, share: float = 0.0) -> DataFrame:
    """(host, hash, n): subtrees that occur on at least ``least`` pages, and a ``share`` of the pages, of their host.

    By default the bound is a number of pages, whatever the size of the host: a
    box that rotates over a hundredth of a large host is a template.  Pages of
    equal html count as one, however often they are stored.  Counting is an
    aggregation with map-side combine, each page counted once per subtree; a host
    with most of the pages is many keys, not one.
    """
    host, _ = host_and_path(url)
    html = column(source).cast("string")
    rows = ship(pages).select(host.alias("host"), F.xxhash64(html).alias("key"), html.alias("html"))
    once = hashed(rows).groupBy("host", "key").agg(F.first("hashes").alias("hashes"))
    counts = (once.select("host", F.explode("hashes").alias("hash"))
              .groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    if not share:
        return counts
    sizes = rows.groupBy("host").agg(F.count_distinct("key").alias("pages"))
    return counts.join(sizes, "host").filter(F.col("n") >= share * F.col("pages")).select("host", "hash", "n")


def by_host(found: DataFrame) -> dict[str, frozenset[int]]:
    """The hashes of a bounded table of templates, by host."""
    out: dict[str, set[int]] = {}
    for batch in found.select("host", "hash").toArrow().to_batches():
        for host, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out.setdefault(host, set()).add(value)
    return {host: frozenset(values) for host, values in out.items()}


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html", broadcast_rows: int = 200_000, **options) -> DataFrame:
    """One row per page: id, url, text, n_chars.

    First page furniture goes (menus, headers, footers, sidebars, notices,
    adverts, forms, comments, scripts, by element, class, id or role), and site
    templates: subtrees that recur on many pages of the host, articles among them.
    The main text is what then stands in the article or main elements if they hold
    half of the words left, or else in the body.  Running text inside an article
    is never a template by itself, and what is all the text of its page is no box,
    so copies of an article or a page stay whole.
    Character references are decoded, white space in a block becomes one space,
    blocks are joined by a line feed.  Null and empty html give empty text; null
    urls share the host ''; repeated pages are kept, and count as one page of the
    host; very long pages are read whole; broken markup is read as a browser would.
    Empty tables are fine; other columns are ignored, whatever their names.

    The table of templates is written first.  The ``broadcast_rows`` of them with
    most pages go to every task; a page's other subtrees, each on few pages, are
    joined by host and hash, and only what was found comes back to the page.  So
    no task gets the list of a host, and no key has more pages than the last of
    the templates that were sent.
    """
    found = staged(templates(pages, url, source, **options), "templates")
    host, _ = host_and_path(url)
    rows = ship(pages).select(column(id).alias("i"), column(url).alias("u"), host.alias("host"), column(source).cast("string").alias("h"))
    more = found.count() > broadcast_rows
    sent = by_host(found.orderBy(F.desc("n"), "host", "hash").limit(broadcast_rows) if more else found)
    known = pages.sparkSession.sparkContext.broadcast(sent)
    if more:
        rows = rows.withColumn("key", F.xxhash64("i", "u", "h"))  # of equal keys one list serves, as their pages are equal
        asked = hashed(rows.select("host", "key", "h"), lambda: known.value).select("host", "key", F.explode("hashes").alias("hash"))
        lists = asked.join(found, ["host", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("template"))
        rows = rows.join(lists, "key", "left")
    else:
        rows = rows.withColumn("template", F.lit(None).cast("array<bigint>"))
    rows = rows.select("i", "u", "host", "h", "template")
    schema = StructType([StructField("i", pages.schema[id].dataType), StructField("u", pages.schema[url].dataType), StructField("t", StringType())])

    def run(batches):
        shared = known.value
        for batch in batches:
            for part in slices(batch, 3):
                _, _, hosts, sources, own = (c.to_pylist() for c in part.columns)
                texts = [Page(h or "").text(shared.get(host, frozenset()), frozenset(t or ())) for host, h, t in zip(hosts, sources, own, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["i", "u", "t"])

    out = rows.mapInArrow(run, schema)
    return out.select(F.col("i").alias(id), F.col("u").alias(url), F.col("t").alias("text"), F.char_length("t").cast("long").alias("n_chars"))
