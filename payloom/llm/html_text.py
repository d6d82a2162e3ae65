"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree: a node is the chain of block elements (with classes, ids and roles, digits
left out) from the root down, menus, footers and articles alike. For each node the tree counts the distinct pages it is
on, the texts it shows there and the sequences of its children. What m pages show c times has the entropy log(c); so

* content importance of a node's own text: 1 - mean of log(c) / log(m + KAPPA), over its characters, times the share of
  characters that are no links;
* presentation importance of a node with children: 1 - mean of log(c) / log(m + KAPPA), over its pages' sequences;
* composite importance: (1 - GAMMA^l) presentation + GAMMA^l content of all that lies below, by characters, where l is
  how many sequences the node has.

Templates come out near 0, what varies near 1, and what only one page shows at 1; KAPPA makes small sites careful without
a limit to their size. The composite importance times a prior is what decides: branches below LEAST go. The prior is
NOISE for nodes whose tag, role, class or id names them as menu, advert, footer and so on, 1 in an article or main
element, OTHER elsewhere. Random menus and adverts vary as much as articles do, so that entropy alone cannot
tell these. If a page has an article or main element with text left, only what is inside counts. What is kept or
removed is a node of the tree, never a single text, so a paragraph that many pages share stays.

Counts are combined before their shuffles, which carry hashes and paths, not pages. A host's removed branches (those on
two pages or more; a branch of one page has composite importance 1, and its prior decides) are what joins the pages.

Defined results: null or empty html gives an empty text; a null url, or one without a host, takes no part in a tree and
its page is judged by the priors; unclosed, crossed and stray tags are read as browsers do, roughly (a quote that never
closes is no quote); repeated pages count once in the tree; other columns stay; an empty table gives an empty result;
pages of any length are read whole, in time proportional to their length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cut, add_arrays, with_columns

#: Branches below this importance go; what makes small sites careful; how much a sequence of children weighs.
LEAST, KAPPA, GAMMA = 0.1, 2.0, 0.9
#: Open elements that are told apart; deeper ones belong to the last of them.
DEPTH = 256
#: Priors of nodes named as noise, and of nodes neither so named nor in an article.
NOISE, OTHER = 0.05, 0.5

_WORDS = "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul"
BLOCKS = frozenset(_WORDS.split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no content, and those whose inside is no markup.
NEVER = frozenset("nav header footer aside form button select option textarea input dialog menu search noscript template iframe object svg canvas head".split())
RAW = frozenset("script style title noscript template textarea iframe svg".split())
#: Elements that a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where the search for an element to close ends.
SCOPE = frozenset("body article main section div table ul ol dl td th aside nav footer header form blockquote figure".split())
NOISE_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|comments?|comment-\w+|disqus|replies|reply|respond|related|recommended|widget|pagination|pager|toolbar|skip-link|copyright|legal)(?:$|[^a-z])"
)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar alertdialog form".split())

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRS = re.compile(r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+)*+")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, '/' or '', tag or '', attributes) of the page's tags, comments and raw elements, in order."""
    at, quotes, closers = page.find("<"), True, {}
    while at >= 0:
        end, tag = at + 1, None
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            end, tag = (stop + 3 if stop >= 0 else len(page)), ("", "", "")
        elif page[at + 1 : at + 2] in ("!", "?"):
            stop = page.find(">", at)
            if stop < 0:
                return
            end, tag = stop + 1, ("", "", "")
        elif m := _NAME.match(page, at + 1):
            stop = _ATTRS.match(page, m.end()).end() if quotes else page.find(">", m.end())
            if stop >= len(page):  # a quote hides the end of the tag: from here on quotes count for nothing
                quotes, stop = False, page.find(">", m.end())
            if stop < 0:
                return
            name, attrs, end = m[2].lower(), page[m.end() : stop], stop + 1
            tag = (m[1], name, attrs)
            if name in RAW and not m[1]:
                tag = ("", "", "")
                if not attrs.endswith("/"):
                    closer = closers.setdefault(name, re.compile(rf"</{name}\s*+>", re.IGNORECASE)).search(page, end)
                    end = closer.end() if closer else len(page)
        if tag is not None:
            yield at, end, *tag
        at = page.find("<", end)


def prior(path: str, known: dict[str, float] = {}) -> float:  # noqa: B006
    """How likely a node is to hold content, by the names on its path alone."""
    if path not in known:
        if len(known) > 10_000:
            known.clear()
        inside = False
        for style in path.split("/"):
            tag, _, mark = style.partition(".")
            mark, _, role = mark.rpartition("@")
            if tag in NEVER or role in ROLES or (mark and tag not in ("html", "body") and NOISE_NAMES.search(mark)):
                known[path] = NOISE
                break
            inside |= tag in ("article", "main") or role == "main"
        else:
            known[path] = 1.0 if inside else OTHER
    return known[path]


def in_article(path: str) -> bool:
    return any(s.startswith(("article", "main")) and s.split(".")[0] in ("article", "main") or s.endswith("@main") for s in path.split("/"))


class Node:
    __slots__ = ("tag", "path", "children", "linked", "dead")

    def __init__(self, tag, path, linked, dead):
        self.tag, self.path, self.linked, self.dead, self.children = tag, path, linked, dead, []


def parse(page: str) -> tuple[list[tuple[str, str, int]], dict[str, list[str]]]:
    """The page's blocks (path, text, linked characters) in order, and for each path its children's tags."""
    root = Node("", "", False, False)
    stack, blocks, shown, buffer = [root], [], {}, []
    linked = 0

    def flush():
        nonlocal linked
        if buffer:
            if text := " ".join(html.unescape("".join(buffer)).split()):
                at = next(n for n in reversed(stack) if n.tag in BLOCKS or n is root)
                blocks.append((at.path, text, min(linked, len(text))))
            buffer.clear()
            linked = 0

    def pop_to(i: int):
        while len(stack) > i:
            node = stack.pop()
            shown.setdefault(node.path, []).extend(node.children)

    def say(text: str):
        nonlocal linked
        if not stack[-1].dead:
            buffer.append(text)
            if stack[-1].linked:
                linked += len(text)

    last = 0
    for start, end, close, tag, attrs in _tokens(page):
        if start > last:
            say(page[last:start])
        last = end
        if not tag:
            continue
        if close:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if tag in BLOCKS and (at or tag == "p"):
                flush()
            elif tag not in BLOCKS and at and any(n.tag in BLOCKS for n in stack[at + 1 :]):
                continue
            if at:
                pop_to(at)
            continue
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag in CLOSES.get(tag, ()):
                    pop_to(i)
                    break
                if stack[i].tag in SCOPE and not (tag in CLOSES and stack[i].tag in CLOSES[tag]):
                    break
        elif tag in ("br", "img"):
            buffer.append(" ")
        if tag in VOID or attrs.endswith("/") or len(stack) > DEPTH:
            continue
        above = stack[-1]
        mark, role = "", ""
        if attrs:
            for name, *values in _ATTR.findall(attrs):
                if name.lower() in ("class", "id"):
                    mark += " " + "".join(values).lower()
                elif name.lower() == "role":
                    role = "@" + "".join(values).lower().strip()
        style = tag + "." + re.sub(r"[\d\s/@]+", " ", mark).strip() + role if mark or role else tag
        if mark and not role:
            style += "@"
        above.children.append(style)
        stack.append(Node(tag, f"{above.path}/{style}" if tag in BLOCKS else above.path, above.linked or tag == "a", above.dead or (tag in NEVER and tag not in BLOCKS)))
    if last < len(page):
        say(page[last:])
    flush()
    pop_to(0)
    return blocks, shown


def branches(path: str) -> list[str]:
    """The nodes on a path, from the root's child down to itself."""
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(2, len(parts) + 1)]


def main_text(page: str, removed: frozenset[str]) -> str:
    """The page's blocks in no removed branch and with no prior that rules them out; in an article, if one has any."""
    gone: dict[str, bool] = {}
    kept = []
    for path, text, _ in parse(page)[0]:
        if path not in gone:
            gone[path] = prior(path) < LEAST or any(b in removed for b in branches(path))
        if not gone[path]:
            kept.append((path, text))
    if any(in_article(p) for p in dict.fromkeys(p for p, _ in kept)):
        kept = [b for b in kept if in_article(b[0])]
    return "\n\n".join(text for _, text in kept)


_STYLES = "host string, path string, own boolean, feature long, page long, size long, linked long, prior double"


def _styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page: its texts (own: true) by node, and each node's sequence of children; by hashes."""
    import xxhash

    digest = lambda text: xxhash.xxh3_64_intdigest(text) - 2**63
    names = ["host", "path", "own", "feature", "page", "size", "linked", "prior"]
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blocks, shown = parse(page)
            name, nodes = digest(page), {}
            for path, text, linked in blocks:
                rows.append((host, path, True, digest(text), name, len(text), linked, prior(path)))
                nodes |= dict.fromkeys(branches(path))
            for path in nodes:
                children = shown.get(path, ())
                runs = [c for i, c in enumerate(children) if not i or c != children[i - 1]]
                rows.append((host, path, False, digest(" ".join(runs)), name, 0, 0, prior(path)))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names)


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages, content, presentation, composite and prior for each node of the trees of ``pages`` (host, html)."""
    rows = pages.where("host is not null and html is not null").mapInArrow(_styles, _STYLES)
    once = rows.groupBy("host", "path", "own", "feature", "page").agg(F.max("size").alias("size"), F.max("linked").alias("linked"), F.min("prior").alias("prior"))
    features = once.groupBy("host", "path", "own", "feature").agg(F.count("*").alias("c"), F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.min("prior").alias("prior"))
    weight = F.when(F.col("own"), F.col("size")).otherwise(F.col("c"))
    sums = lambda name, own: F.sum(F.when(F.col("own") == own, weight * F.log("c")).otherwise(0.0)).alias(name)
    nodes = features.groupBy("host", "path").agg(
        F.sum(F.when(~F.col("own"), F.col("c")).otherwise(0)).alias("pages"), F.sum(F.when(~F.col("own"), 1).otherwise(0)).alias("forms"),
        sums("shown", False), sums("said", True), F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.min("prior").alias("prior"),
    )
    base = F.log(F.col("pages") + KAPPA)
    own = F.when(F.col("size") > 0, (1 - F.col("said") / F.col("size") / base) * (1 - F.col("linked") / F.col("size"))).otherwise(0.0)
    nodes = Cut(nodes.withColumns({"presentation": 1 - F.col("shown") / F.col("pages") / base, "own": own}), "styles").df
    # What lies below a node: its own text and that of the nodes whose paths go on from it.
    parts = F.split("path", "/")
    above = nodes.where("size > 0").select("host", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path"), "size", (F.col("own") * F.col("size")).alias("value"))
    below = above.groupBy("host", "path").agg((F.sum("value") / F.sum("size")).alias("content"), F.sum("size").alias("all"))
    both = nodes.join(below, ["host", "path"])
    far = F.pow(F.lit(GAMMA), F.col("forms"))
    composite = F.when(F.col("all") == F.col("size"), F.col("content")).otherwise((1 - far) * F.col("presentation") + far * F.col("content"))
    return both.select("host", "path", "pages", "content", "presentation", composite.alias("composite"), "prior")


def removed_branches(tree: DataFrame) -> DataFrame:
    """host and ``removed``, the paths of its branches that go, as far as two pages show them."""
    low = tree.where((F.col("pages") > 1) & (F.col("composite") * F.col("prior") < LEAST))
    return low.groupBy("host").agg(F.collect_set("path").alias("removed"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, gone = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("html", "removed"))
        texts = [main_text(p or "", frozenset(g or ())) for p, g in zip(page, gone)]
        keep = batch.select([n for n in batch.schema.names if n not in ("html", "removed")])
        yield add_arrays(keep, {"text": pa.array(texts, pa.string())})


def host_of(url: str):
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without ``html``, with ``text``."""
    pages = pages.withColumn("__host", host_of("url"))
    gone = removed_branches(style_tree(pages.select(F.col("__host").alias("host"), "html")))
    both = pages.join(gone.withColumnRenamed("host", "__host"), "__host", "left").drop("__host")
    kept = T.StructType([f for f in both.schema.fields if f.name not in ("html", "removed")])
    return both.mapInArrow(_extracted, with_columns(kept, T.StructField("text", T.StringType())))
