"""HTML extraction by equivalence-class template deduction.

Deduction. A page is a sequence of tokens: tags with their place (the path of
elements above), the words of short texts, longer texts as a whole, and whole
blocks, whatever their length. The occurrence vector of a token over the pages
of a host is folded into two numbers - the sums of the halves of a hash of
(page, occurrences) - together with the numbers of pages and occurrences, so
vectors of hosts of any size are compared by a plain aggregation that combines
before it shuffles. Tokens with one vector are an equivalence class; a class is
divided by the places that its tokens lie below, so that each valid class is
nested in one place, and valid classes nest into the template by their places.

Choice of slots. The class of the tokens that occur once on every page is the
template's outermost; its places are the page's slots, one within the other. A
slot's text is what varies in it: without what the template has on every page
and without boilerplate elements. From the outermost slot the choice goes down
into the slot that holds the text, as long as there is one alone; there it
stays, and of the slots next to each other those are left out that are menus
(half of their text is links), that do not vary, that come from a pool (half of
their text is blocks of several pages, and of the largest slot far less), or that
have less than SMALL of the largest one's text (headings always stay). Where one
of several slots is an article or main element, it is taken; names never choose
what is no slot.

Extraction. The chosen slot's blocks are read in page order, without the slots
left out, without scripts, navigation, adverts, forms, comments and so on, and
without what the template has: blocks that every page of the host has in the
same place or that have nothing but texts of the template, and its longer texts
within other blocks. On hosts of fewer than three pages, or where no text
varies, no text counts as the template's. Pages of hosts without a choice (one
page, no text) and pages that lack the chosen slot are read by element names.
The column decided says which: slot, or names.

Defined results
- null and empty pages give empty text; pages without url share a host.
- a block is what lies between block-level tags; br is white space; white space
  of any kind becomes one space; character references are decoded once.
- unclosed and stray tags are tolerated; nothing is cut off, at any depth;
  repeated rows count as pages and give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut, ship

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
ATTR = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
# Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
BOILER = set("head script style noscript template iframe nav header footer aside form button select option textarea input menu dialog object embed svg canvas audio video figure-none".split())
MAIN = ("article", "main")
HINT = re.compile(
    r"(?i)(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|sidebar\w*|side-?bar|footer|header|masthead|breadcrumbs?|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe|share\w*|social\w*|related|recommend\w*|comments?|respond|disqus\w*|pagination|pager|widget\w*|toolbar|login|search)(?:$|[\s_-])"
)
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
SHORT_WORDS, MAX_DEPTH = 6, 16  # deeper places are named by hash
SUPPORT = 0.5  # of a host's pages
SMALL, LINKS, POOL = 0.02, 0.5, 0.5  # of the largest slot's text; of a slot's own text
MAX_BROADCAST = 200_000  # template rows
COUNTS = ["lo", "hi", "pages", "total", "mass", "links"]
STATS = "host string, token string, " + ", ".join(f"{c} long" for c in COUNTS)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url).hostname or "") if url else ""
    except ValueError:
        return ""


def _boiler(tag: str, attrs: str, inside_main: bool) -> bool:
    if tag == "header" and inside_main:
        return False  # an article's own heading
    if tag in BOILER:
        return True
    if not attrs or tag in MAIN or tag in ("body", "html"):
        return False
    for m in ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
                return True
        elif HINT.search(value):
            return True
    return False


def _below(here: str, name: str) -> str:
    """The place of an element; deep ones end in a hash of their path, so places stay short."""
    if here.count(">") < MAX_DEPTH:
        return f"{here}>{name}"
    return f"{here.partition('#')[0]}#{xxhash.xxh64_hexdigest(f'{here}>{name}')}"


def events(page: str) -> Iterator[tuple[str, str, str, str]]:
    """("open" | "close" | "text" | "break", tag or text, attributes, place): places leave out inline elements."""
    stack: list[tuple[str, str]] = []  # tag and place
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], "", stack[-1][1] if stack else ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], "", stack[-1][1] if stack else ""
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attrs = m[3] or m[6] or ""
        here = stack[-1][1] if stack else ""
        if m[1] or m[4]:
            if any(t == tag for t, _ in stack):
                while True:
                    top, place = stack.pop()
                    yield "close", top, "", place
                    if top == tag:
                        break
            elif tag == "br" or tag == "p":
                yield "break", "", "", here
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            yield "open", tag, attrs, _below(here, tag)
            yield "close", tag, "", _below(here, tag)
            at = end.end() if end else n
            continue
        if tag == "p" or tag == "li":  # an open one of the same kind ends here, with what is inline in it
            k = len(stack)
            while k and (stack[k - 1][0] in INLINE or stack[k - 1][0] == tag):
                k -= 1
            if any(t == tag for t, _ in stack[k:]):
                while len(stack) > k:
                    top, place = stack.pop()
                    yield "close", top, "", place
                here = stack[-1][1] if stack else ""
        name = tag
        if attrs and tag not in INLINE:
            for a in ATTR.finditer(attrs):
                if a[1].lower() == "class":
                    name += "." + re.sub("[>#]", "_", ".".join((a[2] or a[3] or a[4] or "").split()))
        place = here if tag in INLINE else _below(here, name)
        yield "open", tag, attrs, place
        if tag in VOID or attrs.endswith("/") and tag in VOID:
            yield "close", tag, "", place
        else:
            stack.append((tag, place))
    while stack:
        top, place = stack.pop()
        yield "close", top, "", place


def _whole(place: str, text: str, kind: str) -> str:
    """The token of a whole text or block: two spaces, or three, where a word's has one."""
    return f"{place} {kind}{xxhash.xxh64_hexdigest(' '.join(text.split()))}"


TEXT, BLOCK = " ", "  "
SHARED = "    "  # ends the row of a place's blocks that several pages have


def page_tokens(page: str) -> tuple[dict[str, int], dict[str, list[int]]]:
    """Occurrences of the page's tokens; and the characters of text outside boilerplate in each place, with all below it, and how many are of links."""
    counts: dict[str, int] = defaultdict(int)
    mass: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    skip, depth, main, link = None, 0, 0, 0
    held: list[list[int]] = [[0, 0]]  # of the open elements
    run: list[str] = []
    at, size = "", 0

    def end():
        nonlocal size
        text = "".join(run)
        if text and not text.isspace():
            block = _whole(at, text, BLOCK)
            counts[block] += 1
            mass[block][0] += size
        run.clear()
        size = 0

    for kind, what, attrs, place in events(page):
        if kind == "break":
            run.append(" ")
        elif kind == "open":
            if what == "br":
                run.append(" ")
            elif what not in INLINE:
                end()
            if what not in INLINE:
                counts[place] += 1
            depth += 1
            main += what in MAIN
            link += what == "a"
            held.append([0, 0])
            if skip is None and _boiler(what, attrs, main > 0):
                skip = depth
        elif kind == "close":
            if what != "br" and what not in INLINE:
                end()
            if skip == depth:
                skip = None
            depth -= 1
            main -= what in MAIN
            link -= what == "a"
            own = held.pop()
            for sums in (held[-1], mass[place]) if what not in INLINE else (held[-1],):
                sums[0] += own[0]
                sums[1] += own[1]
        else:
            words = what.split(None, SHORT_WORDS)
            if 0 < len(words) <= SHORT_WORDS:
                for w in words:
                    counts[f"{place} {w}"] += 1
            elif words:
                counts[_whole(place, what, TEXT)] += 1
            run.append(what)
            at = place
            if skip is None and words:
                held[-1][0] += len(what)
                held[-1][1] += len(what) if link else 0
                size += len(what)
    end()
    mass[""] = held[0]
    return counts, mass


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial vectors of a task's tokens."""
    sums: dict[tuple[str, str], list[int]] = {}

    def flush():
        items = list(sums.items())
        sums.clear()
        cols = [pa.array([h for (h, _), _ in items], pa.string()), pa.array([t for (_, t), _ in items], pa.string())]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array([v[i] for _, v in items], pa.int64()) for i in range(len(COUNTS)))], names=["host", "token", *COUNTS])

    for batch in batches:
        for ident, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            host = host_of(url)
            counts, mass = page_tokens(page or "")
            seed = xxhash.xxh64_intdigest(f"{ident}|{url}")
            counts[""] = 1  # every page of the host
            for token, n in counts.items():
                one = xxhash.xxh64_intdigest(n.to_bytes(8, "big"), seed=seed)
                s = sums.setdefault((host, token), [0] * len(COUNTS))
                s[0] += one & 0xFFFFFFFF  # sums of halves never overflow, and equal rows do not cancel out
                s[1] += one >> 32
                s[2] += 1
                s[3] += n
            for token, (n, links) in mass.items():
                if n:
                    s = sums.setdefault((host, token), [0] * len(COUNTS))
                    s[4] += n
                    s[5] += links
            if len(sums) > 200_000:
                yield flush()
    if sums:
        yield flush()


def _place(token: str) -> str:
    return token.partition(" ")[0]


def _tag(place: str) -> str:
    return place.rpartition(">")[2].partition(".")[0]


class Template:
    """A host's valid classes, nested, and what they say about its pages."""

    def __init__(self, tokens: list[tuple[str, int, int, int, int, int, int]]):
        """tokens: token and COUNTS; the empty token stands for the page, a place with SHARED for its blocks of several pages."""
        shared = {r[0][: -len(SHARED)]: r[5] for r in tokens if r[0].endswith(SHARED)}
        tokens = [r for r in tokens if not r[0].endswith(SHARED)]
        self.mass = {t: (m, k) for t, _, _, _, _, m, k in tokens}
        found = {t: (lo, hi, pages, total) for t, lo, hi, pages, total, _, _ in tokens}
        page = found.get("", (0, 0, 0, 0))  # the vector of what is once on every page
        self.pages = page[2]
        vectors: dict[tuple, list[str]] = defaultdict(list)
        for t, v in found.items():
            if t and v[2] >= SUPPORT * self.pages:
                vectors[v].append(t)
        self.classes = {(v, top): part for v, all_ in vectors.items() for top, part in self._nested(all_).items()}
        slots = [t for t in self.classes.get((page, ""), ()) if " " not in t]
        self.parent = {t: self._enclosing(t, set(slots)) for t in slots}
        self.words = {tuple(t.split(" ", 1)) for t in vectors[page] if " " in t}
        # in any number: a line above and below the article is the template's too
        fixed = {t: self.mass[t][0] for t, v in found.items() if "   " in t and v[2] == self.pages}
        self.blocks = set(fixed)
        if self.pages < 3 or sum(fixed.values()) >= self.mass.get("", (0, 0))[0]:
            self.words, self.blocks, fixed = set(), set(), {}
        below = lambda sums, t: sum(n for b, n in sums.items() if _place(b) == t or b.startswith((t + ">", t + "#")))
        self.text = {t: self.mass[t][0] - below(fixed, t) for t in slots}
        # of what varies
        self.pool = {t: max(0, below(shared, t) - below(fixed, t)) / max(1, self.text[t]) for t in slots}
        self.root, self.left_out = self._choice(slots) if self.pages > 1 else (None, set())

    @staticmethod
    def _nested(tokens: list[str]) -> dict[str, list[str]]:
        """The tokens of one vector by the place that encloses them: below one top each, so that the class is nested there."""
        out: dict[str, list[str]] = {}
        for t in sorted(tokens, key=lambda t: (t.count(">"), t)):
            above = _place(t).rpartition(">")[0]
            top = next((x for x in out if above == x or above.startswith(x + ">")), above)
            out.setdefault(top, []).append(t)
        return out

    @staticmethod
    def _enclosing(place: str, among: set[str]) -> str:
        """The next place above that is one of these; none: empty."""
        place = place.partition("#")[0] if "#" in place else place.rpartition(">")[0]
        while place and place not in among:
            place = place.rpartition(">")[0]
        return place

    def _choice(self, slots: list[str]) -> tuple[str | None, set[str]]:
        """The slot to read, and the slots in it that are left out."""
        inner: dict[str, list[str]] = defaultdict(list)
        for t in slots:
            inner[self.parent[t]].append(t)
        node = ""
        while True:
            own = self.text.get(node, 0) - sum(self.text[t] for t in inner[node]) if node else 0
            live = [t for t in inner[node] if self.text[t] > 0 and self.mass[t][1] < LINKS * self.mass[t][0]]
            first = max(live, key=lambda t: self.text[t], default=None)
            live = [t for t in live if self.pool[t] < POOL or self.pool[t] < 2 * self.pool[first]]
            most = max([own, *(self.text[t] for t in live)], default=0)
            large = [t for t in live if self.text[t] >= SMALL * most and _tag(t) not in HEADINGS]
            kept = {*large, *(t for t in live if _tag(t) in HEADINGS)}
            named = [t for t in large if _tag(t) in MAIN]
            if len(named) == 1 and own < SMALL * most:
                large, kept = named, set(named)
            if most and own < SMALL * most and len(large) == 1 and kept == set(large):
                node = large[0]
                continue
            return (node if most and node else None), {t for t in inner[node] if t not in kept}

    def has(self, place: str, text: str) -> bool:
        """The text's words, or a longer text as a whole, are once on every page."""
        words = text.split(None, SHORT_WORDS)
        if len(words) > SHORT_WORDS:
            return tuple(_whole(place, text, TEXT).split(" ", 1)) in self.words
        return all((place, w) in self.words for w in words)


def extract(page: str, template: Template | None = None) -> tuple[str, str]:
    """The main text of a page, and what chose it: slot, or names."""
    found = list(events(page))
    root = template.root if template else None
    if root is not None and not any(k == "open" and p == root for k, _, _, p in found):
        root = None
    named = any(k == "open" and w in MAIN for k, w, _, _ in found)
    left_out = template.left_out if root is not None else set()
    fixed = template if template and (template.words or template.blocks) else None
    blocks: list[str] = []
    run: list[str] = []
    whole: list[str] = []  # the block with what is not read of it
    at, own = "", False  # the block's place; it has text that is not the template's

    def end():
        nonlocal own
        text = " ".join(html.unescape("".join(run)).split())
        if text and own and not (fixed and _whole(at, "".join(whole), BLOCK) in fixed.blocks):
            blocks.append(text)
        own = False
        run.clear()
        whole.clear()

    skip, depth, main, inside = None, 0, 0, 0
    for kind, what, attrs, place in found:
        if kind == "break" or kind == "open" and what == "br":
            run.append(" ")
            whole.append(" ")
        if kind == "open":
            depth += 1
            if what not in INLINE and what != "br":
                end()
            main += what in MAIN
            if root is not None and place == root and what not in INLINE and not inside:
                inside = depth
            if skip is None and (_boiler(what, attrs, main > 0) or place in left_out and what not in INLINE):
                skip = depth
        elif kind == "close":
            if what not in INLINE and what != "br":
                end()
            if skip == depth:
                skip = None
            if inside == depth:
                inside = 0
            depth -= 1
            main -= what in MAIN
        elif kind == "text":
            whole.append(what)
            at = place
            if skip is None and (inside if root is not None else main if named else True):
                there = fixed is not None and fixed.has(place, what)
                own = own or not there
                # short ones may be within a sentence: they go with the whole block
                run.append(" " if there and len(what.split(None, SHORT_WORDS)) > SHORT_WORDS else what)
    end()
    return " ".join(blocks), "names" if root is None else "slot"


def _hosted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html and the host that templates go by."""
    for batch in batches:
        hosts = pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), hosts], names=["page_id", "url", "html", "host"])


def _extracted(templates: dict[str, list] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: dict[str, Template] = {}
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        out = []
        for i, (url, page) in enumerate(zip(cols[1], cols[2], strict=True)):
            host = host_of(url)
            if host not in made:
                if len(made) > 10_000:
                    made.clear()
                rows = templates.get(host, []) if templates is not None else [tuple(x.values()) for x in cols[3][i] or []]
                made[host] = Template(rows)
            out.append(extract(page or "", made[host]))
        cols = [pa.array([t for t, _ in out], pa.string()), pa.array([len(t) for t, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["page_id", "url", "text", "n_chars", "decided"])


def template_tokens(pages: DataFrame) -> DataFrame:
    """host, token and COUNTS: tokens with enough support on their host, and by place the text of blocks that several pages have."""
    part = pages.select("page_id", "url", "html").mapInArrow(_statistics, STATS)
    tokens = part.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in COUNTS))
    tokens = cut(tokens.filter("pages > 1 or token not like '% %'"))
    sizes = tokens.filter("token = ''").select("host", F.col("pages").alias("host_pages"))
    common = tokens.join(sizes, "host").filter(F.col("pages") >= SUPPORT * F.col("host_pages")).drop("host_pages")
    blocks = tokens.filter(F.col("token").contains(" " + BLOCK) & (F.col("pages") > 1))
    shared = blocks.groupBy("host", F.concat(F.substring_index("token", " ", 1), F.lit(SHARED)).alias("token")).agg(F.sum("mass").alias("mass"))
    return common.unionByName(shared.select("host", "token", *(F.lit(0).cast("long").alias(c) for c in COUNTS[:4]), "mass", F.lit(0).cast("long").alias("links")))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, decided."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    tokens = cut(template_tokens(rows))
    out = "page_id long, url string, text string, n_chars long, decided string"
    if tokens.count() <= MAX_BROADCAST:
        table: dict[str, list] = defaultdict(list)
        for r in tokens.toLocalIterator():
            table[r[0]].append(tuple(r[1:]))
        sent = spark.sparkContext.broadcast(dict(table))
        return rows.mapInArrow(lambda it: _extracted(sent.value, it), out)
    by_host = tokens.groupBy("host").agg(F.collect_list(F.struct("token", *COUNTS)).alias("template"))
    hosted = rows.mapInArrow(_hosted, f"page_id long, url string, html {rows.schema['html'].dataType.simpleString()}, host string")
    joined = hosted.join(by_host, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(lambda it: _extracted(None, it), out)


def op10_html(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
