"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of their paragraphs; the article or main element around a container takes
its score. A container is known by its generalised path: tags and first classes from the root, with digits taken out. Pages
vote for the paths of their containers, votes are summed per host in Spark, and each page is read again with its host's
winning path alone; a page without such a container uses its own best one. Pages also say what text stands at each path:
where it repeats over a host's pages much more than the text at the winning path does, it is furniture, and is left out.
"""

from __future__ import annotations

import re
import zlib
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import storage


# fixed values: element names by role
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "template", "iframe", "noembed", "noframes"}
_GONE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"} | _RAW
_BLOCK = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_CONTAINER = {"article", "body", "center", "div", "main", "section", "td", "details"}
#: A start tag closes an open element of these, up to the elements that bound it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
_P_CLOSERS = (_BLOCK | {"nav", "footer", "aside", "form", "fieldset", "menu"}) - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
# fixed values: words that name what is not the article, and words that say nothing about it
_FURNITURE = set(
    "nav navbar navigation menu menus sidebar aside footer masthead topbar header banner breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices alert alerts "
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion comment comments disqus respond reply replies social share sharing related recommended "
    "newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar contentinfo complementary search dialog hidden".split()
)
_NEUTRAL = set(
    "site page main global top bottom left right upper lower primary secondary box bar block blocks area section sections wrapper wrap container content inner outer list item items row col column panel "
    "links link button buttons post posts article articles story stories form text unit slot group holder area region mobile desktop small large sticky fixed fluid thread body title icon icons user reader in to".split()
)
_parts = re.compile(r"[a-z]+")
_token = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)>?|<[!?][^>]*>?", re.S)
_attr = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)")
_digits = re.compile(r"\d+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Pages of a host that have a path at least, and distinct texts there, as a share of pages and against that share at the
#: winning path, at most, for the path to be furniture.
REPEATS, VARIETY = 5, 0.5


def names_furniture(name: str) -> bool:
    """Whether a class, id or role is made of words for furniture, and of words that say nothing: site-footer, AdBox2. Not
    side-effects, nor comment-on-results."""
    parts = _parts.findall(_camel.sub("-", name).lower())
    return any(x in _FURNITURE for x in parts) and all(x in _FURNITURE or x in _NEUTRAL for x in parts)


def _attributes(raw: str) -> dict[str, str]:
    out = {}
    for m in _attr.finditer(raw):
        if m[5]:
            out.setdefault("hidden", "")
        else:
            out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _noisy(tag: str, a: dict[str, str], inside: bool) -> bool:
    if tag in _GONE or tag == "header" and not inside:
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(names_furniture(x) for k in ("class", "id", "role") if a.get(k) for x in a[k].split())


class Node:
    """A container: its generalised path, its parent, its score and a hash of the text in it."""

    __slots__ = ("tag", "path", "up", "score", "text")

    def __init__(self, tag, path, up):
        self.tag, self.path, self.up, self.score, self.text = tag, path, up, 0.0, 0


def blocks(html: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Blocks of text outside the page's furniture, in page order, each with its innermost container; and all
    containers."""
    root = Node("", "", None)
    nodes, out = [root], []
    stack: list[tuple[str, Node, bool]] = [("", root, False)]  # tag, innermost container, is furniture
    buffer: list[str] = []
    owner = root
    at, n, gone = 0, len(html), 0

    def flush():
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((owner, text))

    def close(k):
        nonlocal gone
        for tag, _, bad in stack[k:]:
            gone -= bad
        del stack[k:]

    while at < n:
        m = _token.search(html, at)
        if not m:
            if not gone:
                owner = stack[-1][1]
                buffer.append(html[at:])
            break
        if m.start() > at and not gone:
            if not buffer:
                owner = stack[-1][1]
            buffer.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag in _BLOCK or tag in _GONE:
                        flush()
                    close(k)
                    break
            else:
                if tag in ("p", "br"):
                    flush() if tag == "p" else buffer.append(" ")
            continue
        if tag == "br" or tag == "wbr":
            if not gone and buffer:
                buffer.append(" " if tag == "br" else "")
            continue
        if tag in _BLOCK or tag in _GONE:
            flush()
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in _P_CLOSERS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in _CONTAINER:
                    break
        if tag in _CLOSES:
            shut, bound = _CLOSES[tag]
            k = len(stack) - 1
            lowest = None
            while k > 0 and stack[k][0] not in bound:
                if stack[k][0] in shut:
                    lowest = k
                k -= 1
            if lowest is not None:
                close(lowest)
        if m[3].rstrip().endswith("/") and tag not in _BLOCK and tag not in _CONTAINER:
            continue
        a = _attributes(m[3]) if m[3] and "=" in m[3] or "hidden" in m[3] else {}
        inner = stack[-1][1]
        bad = _noisy(tag, a, any(s[0] in ("article", "main") for s in stack)) if not gone else False
        if tag in _CONTAINER and not gone and not bad:
            cls = _digits.sub("", (a.get("class") or a.get("id") or "").split(" ")[0].lower()).strip("-_")
            inner = Node(tag, f"{inner.path}/{tag}.{cls}" if cls else f"{inner.path}/{tag}", inner)
            nodes.append(inner)
        stack.append((tag, inner, bad))
        gone += bad
    flush()
    return out, nodes


def _scored(html: str):
    """Blocks and containers, these with scores: half of a block's length goes to the next container out, a quarter to
    the one around that; an article or main element takes what it holds."""
    found, nodes = blocks(html)
    for node, text in found:
        n, share = len(text), 1.0
        main = _lift(node)
        for x in (node, node.up, node.up.up if node.up is not None else None) if node.up is not None else ():
            if x is not None and x.up is not None:
                x.score += n * share
                share /= 2
        if main is not node:
            main.score += n
        raw, x = text.encode("utf-8", "surrogatepass"), node
        while x is not None:
            x.text = zlib.crc32(raw, x.text)
            x = x.up
    return found, nodes


def _lift(node: Node) -> Node:
    """The outermost article or main element around a container, or the container."""
    best, x = node, node
    while x is not None:
        if x.tag in ("article", "main"):
            best = x
        x = x.up
    return best


def votes(html: str) -> list[tuple[str, float, int]]:
    """(path, weight, hash of the text there) of the page's containers, all that have text."""
    _, nodes = _scored(html)
    by: dict[str, float] = {}
    text: dict[str, int] = {}
    for x in nodes:
        if x.text and x.path:
            by[x.path] = by.get(x.path, 0.0) + x.score
            text[x.path] = zlib.crc32(x.text.to_bytes(4, "little"), text.get(x.path, 0))
    total = sum(by.values()) or 1.0
    return [(p, s / total, text[p]) for p, s in sorted(by.items(), key=lambda i: (-i[1], i[0]))]


def extract(html: str, path: str | None, furniture: list[str] | None = None) -> str:
    """The text of the containers at ``path``, or else of the page's best container, without what stands at the paths
    of ``furniture``; blocks joined by empty lines."""
    found, nodes = _scored(html)
    roots = {id(n) for n in nodes if path and n.path == path}
    if not roots:
        best = max((x for x in nodes if x.up is not None), key=lambda x: x.score, default=None)
        roots = {id(best) if best is not None else id(nodes[0])}
    gone = set(furniture or ())

    def within(x):
        inside = False
        while x is not None:
            if not inside and x.path in gone:
                return False
            inside = inside or id(x) in roots
            x = x.up
        return inside

    return "\n\n".join(t for n, t in found if within(n))


def host_of(url):
    """Host of a url column: what stands after :// up to /, ? or #; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1))


def _vote(batches):
    import pyarrow as pa

    for b in batches:
        sums: dict[tuple[str, str, int], list] = {}
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            for path, w, text in votes(html or ""):
                x = sums.setdefault((host, path, text), [0.0, 0])
                x[0] += w
                x[1] += 1
        rows = list(sums)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))), pa.array([sums[k][0] for k in rows], pa.float64()), pa.array([sums[k][1] for k in rows], pa.int64())],
            names=["host", "path", "hash", "weight", "pages"],
        )


def _extract(batches):
    import pyarrow as pa

    for big in batches:
        for i in range(0, big.num_rows, 500):
            b = big.slice(i, 500)
            text = [extract(h or "", p, f) for h, p, f in zip(*(b.column(c).to_pylist() for c in ("html", "path", "furniture")))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_paths(rows: DataFrame) -> DataFrame:
    """(host, path, furniture) of pages (host, html): the winning path, and the paths whose text repeats."""
    said = rows.select("host", "html").mapInArrow(_vote, "host string, path string, hash long, weight double, pages long")
    said = said.groupBy("host", "path", "hash").agg(F.sum("weight").alias("weight"), F.sum("pages").alias("pages"))
    by = said.groupBy("host", "path").agg(F.round(F.sum("weight"), 6).alias("weight"), F.sum("pages").alias("pages"), F.count("*").alias("texts"))
    by = storage.persist(by, "votes")
    best = by.groupBy("host").agg(F.min(F.struct((-F.col("weight")).alias("w"), "path", (F.col("texts") / F.col("pages")).alias("variety"))).alias("b"))
    best = storage.persist(best.select("host", F.col("b.path").alias("best"), F.col("b.variety").alias("usual")), "paths")
    around = F.concat("best", F.lit("/")).startswith(F.concat("path", F.lit("/")))
    repeated = by.join(storage.small(best), "host").where((F.col("pages") >= REPEATS) & ~around & (F.col("texts") / F.col("pages") <= VARIETY * F.col("usual")))
    repeated = repeated.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("furniture"))
    out = storage.persist(best.join(repeated, "host", "left").select("host", F.col("best").alias("path"), "furniture"), "paths")
    storage.drop(by, best)
    return out


def extract_main_text(pages: DataFrame, vote: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; long pages are read whole. Null urls and urls without a host vote together.
    Ties between paths go to the first in alphabetical order. Repeated rows vote each time; other columns are ignored;
    an empty table gives an empty result. Without ``vote`` each page is read by its own best container.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
    if vote:
        rows = rows.join(storage.small(host_paths(rows)), "host", "left")
    else:
        rows = rows.withColumns({"path": F.lit(None).cast("string"), "furniture": F.lit(None).cast("array<string>")})
    return rows.select("page_id", "url", "html", "path", "furniture").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
