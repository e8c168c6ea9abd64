"""Main text of web pages by a site style tree.

Pages of a host are merged into one tree of style paths (hashes of the tags with their class and id, from the body down,
at any depth).  A node's
presentation importance is the entropy of the child sequences that it has over the host's pages, its content
importance is one minus the entropy with which its texts repeat, both to base m, the number of pages that have the
node; both are joined as (1 - g**l) * presentation + g**l * content, with g = 0.9 and l child styles.  What looks the
same and says the same on every page scores 0.  Branches under LOW, met on LEAST_PAGES different pages or more, are
noise (pages of a host whose texts are equal count once: copies of a page don't show what its site repeats); they are
removed from each page, together with elements that are noise by their tag, role or name (navigation, footers, adverts,
forms, comments and the like; "comment-list" names noise, "has-sidebar" and "ad-hoc" don't).  Branches whose texts differ are no noise, however alike they look (content LOW or
more).  The article element, or else main, if there is one, is the page's content; inside it the same rule holds for
its branches, met in LEAST_ARTICLES different articles or more, so that an article that many pages share stays whole.

Scale: the tree is never in one place.  Each page gives a row for each style path it has (hashes only); rows of
equal pages meet by (host, path, page text), counts by (host, path, text) and (host, path, children) combine map-side,
then by (host, path), so a host with a third of all pages is no hot spot.  Only noise paths are kept.  They go to every
task while they are few (their bytes are counted), else each page's own paths meet them by host and path.

Defined results: null html is empty; pages without text give '' and 0; broken or cut-off markup ends at the text's end;
a null or odd url is a host by itself (''); repeated rows are separate pages; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

DECAY, LOW, LEAST_PAGES, LEAST_ARTICLES = 0.9, 0.2, 2, 4
#: Tells the paths inside a page's main element from the same paths outside of one.
INSIDE = 0x2545F4914F6CDD1D
#: Bytes of noise paths up to which they are broadcast.
MOST_BROADCAST = 32 << 20
#: Of the polynomial that hashes a sequence of strings.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never main text.
NOISE_TAGS = frozenset("nav header footer aside menu form fieldset button select option input label textarea script style noscript template iframe object embed svg canvas audio video dialog head title".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
#: Words of class and id that name noise, whole words after splitting at - _ and case changes.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs header footer masthead sidebar rail aside widget "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies respond disqus pagination pager toolbar copyright".split()
)
#: Words beside which a noise word still names noise ("ad-slot", "comment-list"), as digits and single letters do.
PLAIN_WORDS = frozenset(
    "area bar block body bottom box btn button buttons card cards col column container content feed field fields foot group head holder icon icons inner input item items left link links list main outer panel "
    "right row section slot strip text thread title top unit wrap wrapper zone".split()
)
#: First words of names that tell what a wrapper has or lacks, not what it is.
STATE_WORDS = frozenset("has have no not with without hide hidden show toggle open close js".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table td th html body article section div".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))[^>\"']*)*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if "=" in text or "hidden" in text:
        for m in _ATTR.finditer(text):
            out.setdefault(m[1].lower(), entities.unescape((m[2] or "").strip("\"'")))
    return out


def word_names_noise(name: str) -> bool:
    """Whether a name of a class or id is one of noise: by its last word, or by its first if the others say nothing else."""
    w = [x.lower() for x in _WORD.findall(name)]
    if not w or w[0] in STATE_WORDS:
        return False
    plain = lambda x: x in NOISE_WORDS or x in PLAIN_WORDS or x.isdigit() or len(x) == 1
    return w[-1] in NOISE_WORDS or w[0] in NOISE_WORDS and all(map(plain, w[1:]))


def is_noise(tag: str, attributes: dict[str, str]) -> bool:
    """Noise by its element, its role, or for being hidden."""
    return tag in NOISE_TAGS or attributes.get("role", "").lower() in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"


def names_noise(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("html", "body", "main"):
        return False
    return any(map(word_names_noise, f"{attributes.get('class', '')} {attributes.get('id', '')}".split()))


class Node:
    __slots__ = ("named", "noise", "parts", "path", "tag")

    def __init__(self, tag: str, path: int, noise: bool, named: bool = False):
        # path: hash of all styles from the body down, of one size at any depth; named: noise by its name alone
        self.tag, self.path, self.noise, self.named = tag, path, noise or named, named and not noise
        self.parts: list = []  # strings and nodes, in page order


def parse(page: str) -> Node:
    """A tree of elements and strings; elements keep their style path and whether they name themselves noise."""
    root = Node("html", 0, False)
    stack, at, n = [root], 0, len(page)
    opened: Counter = Counter()  # elements of the stack by tag, so that a deep stack is searched only for what it has

    def close(tags: frozenset | set, stop: frozenset | set = frozenset()) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                opened.subtract(x.tag for x in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            close({tag})
            continue
        if tag in BLOCK:
            close({"p"}, {"table", "button", "object", "td", "th"})
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE - CLOSES[tag])
        if tag in ("html", "body"):
            continue
        attributes = _attributes(m[3])
        style = ".".join([tag, *sorted(attributes.get("class", "").split())]) + (f"#{attributes['id']}" if attributes.get("id") else "")
        up = stack[-1]
        path = signed(hash_of(f"{up.path}/{style}"))
        node = Node(tag, path, is_noise(tag, attributes), names_noise(tag, attributes))
        up.parts.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if tag not in ("script", "style"):
                node.parts.append(page[at : end.start() if end else n])
            at = n if end is None else (page.find(">", end.end()) + 1 or n)
            continue
        stack.append(node)
        opened[tag] += 1
    return root


def key_of(node: Node, inside: bool) -> int:
    return node.path ^ INSIDE if inside else node.path


def walk_blocks(node: Node, removed: frozenset | set, inside: bool, out: list[list[str]]) -> None:
    """Text of ``node`` by blocks; a block element starts and ends one.  ``inside``: ``node`` is a main element."""
    work: list = [(node, False)]
    while work:
        x, leaving = work.pop()
        if isinstance(x, str):
            out[-1].append(x)
            continue
        block = x.tag in BLOCK
        if leaving:
            out.append([])
            continue
        if x is not node and (x.noise or key_of(x, inside) in removed):
            if block and out[-1]:
                out.append([])
            continue
        if x.tag == "br":
            out[-1].append(" ")
            continue
        if block and out[-1]:
            out.append([])
        if block:
            work.append((x, True))
        work.extend((p, False) for p in reversed(x.parts))


def main_parts(root: Node, trust_names: bool = True) -> list[Node]:
    """Outermost article elements that no noise encloses, else main elements, else none.

    Where elements with names of noise enclose all text, those are wrappers, and what they enclose counts.
    """
    found: dict[str, list[Node]] = {"article": [], "main": []}
    work: list = [(root, frozenset())]
    said = False
    while work:
        x, within = work.pop()
        if isinstance(x, str):
            said = said or not x.isspace()
            continue
        if x.noise and (trust_names or not x.named):
            continue
        if x.tag in found and x.tag not in within and not x.noise:
            found[x.tag].append(x)
            within = within | {x.tag}
        work.extend((p, within) for p in reversed(x.parts))
    own = found["article"] or found["main"]
    return own if own or said or not trust_names else main_parts(root, False)


def text_of_parts(root: Node, own: list[Node], removed: frozenset | set = frozenset()) -> str:
    out: list[list[str]] = [[]]
    for x in own or [root]:
        walk_blocks(x, removed, bool(own), out)
        out.append([])
    blocks = (" ".join(entities.unescape("".join(b)).split()) for b in out if b)
    return "\n\n".join(b for b in blocks if b)


def main_text(page: str, removed: frozenset | set = frozenset()) -> str:
    root = parse(page)
    return text_of_parts(root, main_parts(root), removed)


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def styles(page: str) -> list[tuple[int, bool, int, int, int, int]]:
    """(path, whether in a main element, hash of the child sequence, number of child styles, hash of its text, hash of the page's) of every style path."""
    root = parse(page)
    own = main_parts(root)
    whole = signed(hash_of(text_of_parts(root, own)))
    main = set(map(id, own))
    # a node's strings follow each other, so that its text's hash comes from the page's prefix hashes: linear at any depth
    prefix, power = [0], [1]
    says: dict[int, int] = {}
    children: dict[int, list[int]] = {}
    within: set[int] = set()
    work: list = [(root, False, -1)]
    while work:
        x, inside, start = work.pop()
        if isinstance(x, str):
            if words := x.split():
                prefix.append((prefix[-1] * BASE + hash_of(" ".join(words))) % PRIME)
                power.append(power[-1] * BASE % PRIME)
            continue
        inside = inside or id(x) in main
        key = key_of(x, inside)
        if start >= 0:
            n = len(prefix) - 1 - start
            says[key] = ((says.get(key, 0) - prefix[start]) * power[n] + prefix[-1]) % PRIME
            continue
        children.setdefault(key, []).extend(p.path for p in x.parts if not isinstance(p, str))
        if inside:
            within.add(key)
        work.append((x, inside, len(prefix) - 1))
        work.extend((p, inside, -1) for p in reversed(x.parts))
    return [(p, p in within, signed(xxhash.xxh64_intdigest("\n".join(map(str, k)))), len(set(k)), says[p], whole) for p, k in children.items() if p]


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, inside, pages, presentation, content, importance: the merged tree, a row for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts: list = []
            rows: list = []
            for h, page in zip(b.column(0).to_pylist(), b.column(1)):
                got = styles(page.as_py() or "")
                hosts += [h] * len(got)
                rows += got
            cols = list(zip(*rows)) or [(), (), (), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((hosts, *cols), kinds)], names=["host", "path", "inside", "look", "kinds", "says", "whole"])

    seen = pages.select(host(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "host string, path long, inside boolean, look long, kinds int, says long, whole long")
    # one row for pages that say the same: a copied page is no evidence of what the site repeats
    apart = cut(seen.groupBy("host", "path", "whole").agg(F.min(F.struct("inside", "look", "kinds", "says")).alias("x")).select("host", "path", "x.*"))
    spread = lambda c: apart.groupBy("host", "path", c).agg(F.count("*").alias("n"), F.max("kinds").alias("kinds"), F.max("inside").alias("inside")).groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("x"), F.max("kinds").alias("kinds"), F.max("inside").alias("inside"))
    look = spread("look").select("host", "path", "inside", F.col("m").alias("pages"), "kinds", F.when(F.col("m") > 1, 1 - F.col("x") / (F.col("m") * F.log("m"))).otherwise(1.0).alias("presentation"))
    says = spread("says").select("host", "path", F.when(F.col("m") > 1, 1 - F.col("x") / (F.col("m") * F.log("m"))).otherwise(1.0).alias("content"))
    g = F.pow(F.lit(DECAY), F.col("kinds"))
    return look.join(says, ["host", "path"]).select("host", "path", "inside", "pages", "presentation", "content", ((1 - g) * F.col("presentation") + g * F.col("content")).alias("importance"))


def noise_paths(tree: DataFrame) -> DataFrame:
    return tree.filter((F.col("pages") >= F.when(F.col("inside"), LEAST_ARTICLES).otherwise(LEAST_PAGES)) & (F.col("importance") < LOW) & (F.col("content") < LOW)).select("host", "path")


def page_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, host, path) of every style path of every page (key, host, html)."""
    for b in batches:
        for key, h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            paths = [x[0] for x in styles(page.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(paths), pa.int64()), pa.array([h] * len(paths), pa.string()), pa.array(paths, pa.int64())], names=["key", "host", "path"])


def extract(pages: DataFrame, page_id: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    noise = cut(noise_paths(style_tree(pages, url_col, html_col)))
    size = noise.agg(F.sum(F.octet_length("host") + 72).alias("n")).first()["n"] or 0
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url_col).alias("url"), host(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    if size <= MOST_BROADCAST:
        by_host = noise.groupBy("host").agg(F.collect_set("path").alias("paths"))
        removed = {r["host"]: frozenset(r["paths"]) for r in by_host.toLocalIterator()}
        shared = pages.sparkSession.sparkContext.broadcast(removed)
        rows, look = own.withColumn("paths", F.lit(None).cast("array<bigint>")), lambda h, _: shared.value.get(h, frozenset())
    else:  # each page meets the noise among its own paths; pages of one key say the same
        keyed = own.withColumn("key", F.xxhash64("host", "html"))
        mine = keyed.select("key", "host", "html").mapInArrow(page_paths, "key long, host string, path long").distinct().join(noise, ["host", "path"]).groupBy("key").agg(F.collect_set("path").alias("paths"))
        rows, look = keyed.join(mine, "key", "left").select("page_id", "url", "host", "html", "paths"), lambda _, paths: frozenset(paths or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page.as_py() or "", look(h.as_py(), paths.as_py())) for h, page, paths in zip(b.column(2), b.column(3), b.column(4))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(own.dtypes)
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
