"""Main text of web pages by site style trees.

Pages of one host are merged into a tree: an element node for each path of tags (with classes and ids, digits aside) from the
root. A node knows how many of the host's pages have it, in how many ways they present it (the sequence of its children's tags)
and which texts they hold below it. Its importance is (1 - SHARE) * presentation + SHARE * content, where with m pages

    presentation = -sum(p * log_m p) over its ways, p the share of pages with one: the same everywhere is 0, all different is 1
    content      = 1 - mean(log_m n) over the distinct texts below it, n the pages that hold one: a text on all pages adds 0

so that menus, notices and footers, which look and read the same on many pages, are of low importance. A branch goes where its
node's importance is below LEAST. Of hosts with fewer than LEAST_PAGES pages with a path, all hosts decide: the tree merged from all
of them, or the mean of their own trees (weighed by pages), whichever gives the path less importance. Within what markup calls the article, only what nearly all pages repeat goes (LEAST_WITHIN, of at least PAGES_WITHIN pages).

Markup that says what it is counts at every size of host: elements, roles and names of menus, headers, footers, sidebars,
notices, adverts, forms and reader comments go, unless they wrap an article that is most of the page. Where articles hold at least
a third of what is left, only they are kept. Where nothing is left, the tree's decisions are left out.

The tree is nothing but grouped sums: pages give narrow rows (host, path, way or text), counted by all three and then added up
to sums of n log n and log n for each (host, path). So a hot host is spread over its texts, and no task holds its pages. Branches
that go are broadcast where they are few (BROADCAST_PATHS), else joined by path with hot ones held apart.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by two
newlines in page order. Nothing else is dropped or cut.

Defined cases: a null or empty page has an empty text; a null url is a host of its own; broken markup is read as far as it goes
(an open tag without an end is text); repeated pages are told alike; an empty table gives no rows; other columns are only
carried along.
"""

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import by_name, hot_keys, joined, released, stored

#: Weight of content beside presentation; branches below LEAST go.
SHARE, LEAST, LEAST_WITHIN = 0.9, 0.5, 0.1
#: Pages with a path that a host's own tree needs, and that one within an article needs.
LEAST_PAGES, PAGES_WITHIN = 8, 20
BROADCAST_PATHS = 200_000
#: Elements further down than this are told apart by their tags only, not by all that is around them.
DEEPEST = 64

# Names of elements, by what HTML says of them.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "head", "title", "textarea")
NOISE = ("nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "input", "label", "fieldset")
CONTENT = ("article", "main")
NOISE_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar")
NOISE_NAMES = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer",
    "masthead", "header", "cookie", "cookies", "consent", "notice", "banner", "popup", "modal", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "comment",
    "comments", "disqus", "respond", "replies", "pagination", "pager",
)
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: What an opening element ends, and what it does not look beyond.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAMES = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
LONGEST_TAG = 65_536
DIGITS = re.compile(r"\d+")
RAW_SET, NOISE_SET, CONTENT_SET, BLOCK_SET, VOID_SET = map(frozenset, (RAW, NOISE, CONTENT, BLOCKS, VOID))
NAME_SET, ROLE_SET = frozenset(NOISE_NAMES), frozenset(NOISE_ROLES)
PLAIN, MARKED, ARTICLE = range(3)


def digest(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Paths(dict):
    """The number of the path that an element's key makes of its parent's path; begun afresh when large."""

    def __missing__(self, step: tuple[int, str]) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[step] = digest(f"{step[0]}>{step[1]}")
        return found


PATHS = Paths()
ROOT = 0


class Page:
    """Elements in page order, as parallel lists, and the page's texts and block ends between them."""

    def __init__(self, html: str):
        self.tags, self.parents, self.paths, self.marks, self.ways, self.inside = [""], [-1], [ROOT], [PLAIN], [[]], [False]
        self.opened: Counter[str] = Counter()
        #: (element, text); element -1: a block ends.
        self.parts: list[tuple[int, str]] = []
        self.read(html)

    def read(self, html: str) -> None:
        stack, at, size, last = [0], 0, len(html), html.rfind(">")
        while at < size:
            if at > last:
                # No tag ends behind here.
                self.parts.append((stack[-1], html[at:]))
                break
            found = PARTS.match(html, at)
            at = found.end()
            closing, tag, rest = found.groups()
            if tag is None:
                text = found.group()
                if text[:2] not in ("<!", "<?") or len(text) == 1:
                    self.parts.append((stack[-1], text))
                continue
            if rest.count('"') % 2 or rest.count("'") % 2:
                # A '>' within quotes: the tag goes on to the end of the quoted part.
                quote = '"' if rest.count('"') % 2 else "'"
                end = html.find(quote, at, at + LONGEST_TAG)
                end = html.find(">", end, at + LONGEST_TAG) if end >= 0 else -1
                if end >= 0:
                    rest, at = rest + html[at - 1 : end], end + 1
            tag = tag.lower()
            if closing:
                self.close(stack, tag)
                continue
            self.open(stack, tag, rest)
            if tag in RAW_SET and tag != "head" and not rest.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(html, at, last + 1)
                at = end.end() if end else size
                self.cut(stack, len(stack) - 1)

    def open(self, stack: list[int], tag: str, rest: str) -> None:
        if tag in BLOCK_SET:
            self.parts.append((-1, ""))
            self.end(stack, ("p",), ("td", "th", "table", "button"))
            if tag in ENDS:
                self.end(stack, *ENDS[tag])
            if tag == "body":
                self.end(stack, ("head",), ())
        # The header of an article is its own.
        within = self.inside[stack[-1]]
        key, mark = self.key_of(tag, rest, within) if rest.strip(" /") else (tag, MARKED if tag in NOISE_SET or tag == "header" and not within else ARTICLE if tag in CONTENT_SET else PLAIN)
        parent, number = stack[min(len(stack) - 1, DEEPEST)], len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        self.paths.append(PATHS[self.paths[parent], key])
        self.marks.append(mark)
        self.inside.append(mark == ARTICLE or within)
        self.ways.append([])
        self.ways[parent].append(tag)
        if tag not in VOID_SET:
            stack.append(number)
            self.opened[tag] += 1
        elif tag == "br":
            self.parts.append((number, " "))

    def key_of(self, tag: str, rest: str, within: bool) -> tuple[str, int]:
        given = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}
        named = given.get("class", ""), given.get("id", "")
        key = f"{tag}.{DIGITS.sub('', ' '.join(sorted(named[0].split())))}#{DIGITS.sub('', named[1])}" if any(named) else tag
        names = {tag, *(x.lower() for n in named for x in NAMES.findall(n))}
        if tag in ("html", "body"):
            return key, PLAIN
        if tag in NOISE_SET or given.get("role", "").lower() in ROLE_SET or names & (NAME_SET - {"header"} if within else NAME_SET):
            return key, MARKED
        return key, ARTICLE if tag in CONTENT_SET or given.get("role", "").lower() == "main" or given.get("itemprop", "").lower() == "articlebody" else PLAIN

    def cut(self, stack: list[int], at: int) -> None:
        for i in stack[at:]:
            self.opened[self.tags[i]] -= 1
        del stack[at:]

    def end(self, stack: list[int], tags: tuple[str, ...], beyond: tuple[str, ...]) -> None:
        if not any(self.opened[tag] for tag in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if self.tags[stack[i]] in tags:
                self.cut(stack, i)
                return
            if self.tags[stack[i]] in beyond or self.tags[stack[i]] in CONTENT_SET:
                return

    def close(self, stack: list[int], tag: str) -> None:
        if tag in BLOCK_SET:
            self.parts.append((-1, ""))
        for i in range(len(stack) - 1, 0, -1) if self.opened[tag] else ():
            if self.tags[stack[i]] == tag:
                self.cut(stack, i)
                return

    def blocks(self, kept: list[bool]) -> list[tuple[str, bool]]:
        """Text of each block, and whether it lies within an article. kept: for each element."""
        out, held, within = [], [], True

        def done() -> None:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append((text, within))
            held.clear()

        for element, text in self.parts:
            if element < 0:
                if held:
                    done()
                within = True
            elif kept[element] and self.tags[element] not in RAW_SET:
                held.append(text)
                within = within and self.inside[element]
        if held:
            done()
        return out

    def wrapping(self) -> set[int]:
        """Marked elements that hold an article and most of the page's text: what their names say is not about all of it."""
        if MARKED not in self.marks or ARTICLE not in self.marks:
            return set()
        sizes, holds = [0] * len(self.tags), [mark == ARTICLE for mark in self.marks]
        for element, text in self.parts:
            if element >= 0 and self.tags[element] not in RAW_SET:
                sizes[element] += len(text.strip())
        for i in range(len(sizes) - 1, 0, -1):
            sizes[self.parents[i]] += sizes[i]
            # What lies within comments is no article.
            holds[self.parents[i]] |= holds[i] and self.marks[i] != MARKED
        return {i for i, mark in enumerate(self.marks) if mark == MARKED and holds[i] and 3 * sizes[i] >= 2 * sizes[0]}

    def text(self, dropped: set[int], dropped_within: set[int]) -> str:
        """dropped: paths that go; dropped_within: those that go even within an article."""
        wrapping = self.wrapping()
        for use_tree in (True, False):
            kept = []
            for i, parent in enumerate(self.parents):
                own = self.tags[i] not in RAW_SET and (self.marks[i] != MARKED or i in wrapping)
                if use_tree and own and self.marks[i] != ARTICLE and self.tags[i] not in ("", "html", "body"):
                    own = self.paths[i] not in (dropped_within if self.inside[i] else dropped)
                kept.append(own and (parent < 0 or kept[parent]))
            blocks = self.blocks(kept)
            if blocks:
                break
        article = [text for text, within in blocks if within]
        if 3 * sum(map(len, article)) < sum(len(text) for text, _ in blocks):
            article = [text for text, _ in blocks]
        return "\n\n".join(article)

    def features(self) -> dict[int, tuple[int, set[int]]]:
        """For each path of the page the digest of how its elements are presented, and the digests of the texts below them."""
        ways: dict[int, list[str]] = {}
        texts: dict[int, set[int]] = {}
        for path, way, tag in zip(self.paths, self.ways, self.tags, strict=True):
            if tag not in RAW_SET and tag not in ("", "html", "body"):
                ways.setdefault(path, []).append(" ".join(way))
                texts.setdefault(path, set())
        for element, text in self.parts:
            text = " ".join(text.split()) if element > 0 else ""
            if text:
                number = digest(text)
                while element > 0:
                    if (found := texts.get(self.paths[element])) is not None:
                        found.add(number)
                    element = self.parents[element]
        return {path: (digest("|".join(own)), texts[path]) for path, own in ways.items()}


def importances(features: DataFrame) -> DataFrame:
    """host, path, pages, importance. features: host, path, is_text, feature, pages (that have it); one row for each."""
    log = F.log("pages")
    way, text = ~F.col("is_text"), F.col("is_text")
    sums = features.groupBy("host", "path").agg(
        F.sum(F.when(way, F.col("pages"))).alias("m"),
        F.sum(F.when(way, F.col("pages") * log)).alias("ways"),
        F.coalesce(F.sum(F.when(text, log)), F.lit(0.0)).alias("logs"),
        F.count_if(text).alias("texts"),
    )
    m = F.log("m")
    presentation = F.when(F.col("m") > 1, 1 - F.col("ways") / (F.col("m") * m)).otherwise(1.0)
    content = F.when((F.col("m") > 1) & (F.col("texts") > 0), 1 - F.col("logs") / (F.col("texts") * m)).otherwise(presentation)
    return sums.select("host", "path", F.col("m").alias("pages"), ((1 - SHARE) * presentation + SHARE * content).alias("importance"))


def unimportant(pages: DataFrame) -> DataFrame:
    """host, path, within (whether it goes even within an article), pages: of each host the paths that go. pages: host, html."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                page = Page(batch.column(1)[i].as_py() or "").features()
                host = batch.column(0)[i].as_py()
                for path, (way, texts) in page.items():
                    rows.append((host, path, False, way))
                    rows += [(host, path, True, x) for x in texts]
                size += len(page)
                if len(rows) > 50_000:
                    yield table(rows)
                    rows = []
            yield table(rows)
            released()

    def table(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns, (pa.string(), pa.int64(), pa.bool_(), pa.int64()))), ["host", "path", "is_text", "feature"])

    each = pages.select("host", "html").mapInArrow(read, "host string, path long, is_text boolean, feature long")
    counts = stored(each.groupBy("host", "path", "is_text", "feature").agg(F.count("*").alias("pages")), "style_features")
    own = stored(importances(counts), "style_paths")
    merged = importances(counts.groupBy("path", "is_text", "feature").agg(F.sum("pages").alias("pages")).withColumn("host", F.lit(""))).where(F.col("pages") >= LEAST_PAGES)
    weighed = own.where(F.col("pages") >= LEAST_PAGES).groupBy("path").agg((F.sum(F.col("importance") * F.col("pages")) / F.sum("pages")).alias("mean"))
    # What goes on hosts with too few pages of their own: texts may repeat from host to host, or within each host alone.
    everywhere = merged.join(weighed, "path", "left").select("path", F.col("pages").alias("all_pages"), F.least("importance", "mean").alias("importance"))
    shared = stored(everywhere.where(F.col("importance") < LEAST), "style_shared")
    few = own.where(F.col("pages") < LEAST_PAGES).select("host", "path").join(shared, "path").select("host", "path", F.col("all_pages").alias("pages"), "importance")
    found = own.where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST)).unionByName(few)
    return found.select("host", "path", ((F.col("importance") < LEAST_WITHIN) & (F.col("pages") >= PAGES_WITHIN)).alias("within"), "pages")


def extracted(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", carry: tuple[str, ...] = (), broadcast_paths: int = BROADCAST_PATHS) -> DataFrame:
    """page_id, url, text, n_chars, and the columns to carry."""
    names = {f"carried_{i}": c for i, c in enumerate(carry)}
    given = by_name(pages, page_id=page_col, url=url_col, html=html_col, **names)
    given = given.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")))
    gone = stored(unimportant(given.select("host", "html")), "style_gone")
    kinds = [given.schema[c] for c in ("page_id", "url", *names)]
    schema = ", ".join([*[f"{x.name} {x.dataType.simpleString()}" for x in kinds], "text string"])

    def write(batches: Iterator[pa.RecordBatch], dropped_of) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("html")
            texts = []
            for i in range(batch.num_rows):
                html = own[i].as_py()
                texts.append(Page(html).text(*dropped_of(batch, i)) if html else "")
            yield pa.RecordBatch.from_arrays([*[batch.column(x.name) for x in kinds], pa.array(texts, pa.string())], [*[x.name for x in kinds], "text"])
            released()

    if gone.count() <= broadcast_paths:
        by_host: dict[str, tuple[set, set]] = {}
        for row in gone.toLocalIterator():
            sets = by_host.setdefault(row["host"], (set(), set()))
            sets[0].add(row["path"])
            if row["within"]:
                sets[1].add(row["path"])
        sent = pages.sparkSession.sparkContext.broadcast(by_host)
        none: tuple[set, set] = (set(), set())
        found = given.mapInArrow(lambda batches: write(batches, lambda batch, i: sent.value.get(batch.column("host")[i].as_py(), none)), schema)
    else:
        found = with_paths(given, gone).mapInArrow(lambda batches: write(batches, lambda batch, i: (set(batch.column("gone")[i].as_py()), set(batch.column("gone_within")[i].as_py()))), schema)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), *[F.col(n).alias(c) for n, c in names.items()])


def with_paths(given: DataFrame, gone: DataFrame) -> DataFrame:
    """given with the paths that go (gone, gone_within) of each page: narrow rows meet the paths; pages, told apart by their content, get what was found."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                paths = sorted(set(Page(batch.column(2)[i].as_py() or "").paths))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(c)[i].as_py()] * len(paths), pa.string()) for c in (0, 1)] + [pa.array(paths, pa.int64())], ["of", "host", "path"])

    # Equal pages of a host have equal paths, so one of them speaks for all.
    keyed = given.withColumn("of", F.md5(F.concat_ws("\x00", "host", F.coalesce("html", F.lit("")))))
    counts = stored(keyed.groupBy("of").agg(F.count("*").alias("n")), "style_pages")
    each = keyed.select("of", "host", "html").mapInArrow(read, "of string, host string, path long").distinct()
    hot = hot_keys(gone, ["host", "path"], "pages")
    met = joined(each, gone.drop("pages"), ["host", "path"], hot)
    sets = met.groupBy("of").agg(F.collect_set("path").alias("gone"), F.collect_set(F.when(F.col("within"), F.col("path"))).alias("gone_within"))
    none = F.array().cast("array<long>")
    all_sets = stored(counts.join(sets, "of", "left").select("of", F.coalesce("gone", none).alias("gone"), F.coalesce("gone_within", none).alias("gone_within")), "style_sets")
    return joined(keyed, all_sets, ["of"], hot_keys(counts, ["of"], "n"))
