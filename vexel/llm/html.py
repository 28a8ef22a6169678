"""Main text of pages by template deduction: tokens with equal occurrence vectors on a host form its template."""

from __future__ import annotations

import html as charrefs
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import arrow, cut, read

#: Comments, declarations, tags. A quote counts only after an equals sign, and then runs to the next such quote or the
#: end of the page, whatever lies between; a tag that the page's end cuts off is no tag, and its rest no text.
TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(>|\Z)""", re.S)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: What an opening tag closes if it is still open, as far as the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are never part of an article, by tag, role, or a word of their class or id.
DROP_TAGS = set("nav footer aside form script style noscript template iframe svg math button select option textarea input dialog menu head object embed canvas audio video map".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
DROP_WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead banner footer sidebar aside widget widgets related recommended recommendations promo promos promotion ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsors sponsored notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social comment comments commentlist reply replies disqus respond response responses discussion feedback skip skiplink toolbar pagination pager copyright disclaimer teaser teasers".split()
)
#: Words beside those in a name such as site-footer or comment-list, which say nothing of the content. A name with any
#: other word (no-sidebar, has-comments, notice-board) tells nothing.
NEUTRAL = set(
    "area article bar block blog bottom box btn bubble button buttons card cards col column container content count cta entry fixed float footer form full global group head header hidden holder inline inner item items js large left li link links list lists main mobile module nav navigation outer page panel post posts primary right row secondary section site slot small social sticky story text title top ui unit wide wrap wrapper".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN_TAGS, MAIN_ROLES = ("article", "main"), ("article", "main")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: A class of tokens needs so many pages of its host, and this share of them.
MIN_PAGES, SHARE = 4, 0.8
#: Share of links in the text of a list of links. Contents met twice that go to every task, at most.
LINKS, COPIES = 0.6, 100_000
#: Templates of all hosts up to this size go to every task; larger ones are joined by host.
TEMPLATE_BYTES = 32 << 20


def named(names: str, words: set[str]) -> bool:
    """Does one of these class names or ids, as a whole, name such a part: a word of ``words`` and neutral ones only."""
    for name in names.split():
        own = [w.lower() for w in WORDS.findall(name)]
        if any(w in words for w in own) and all(w in words or w in NEUTRAL or w.isdigit() for w in own):
            return True
    return False


class Node:
    __slots__ = ("drop", "inline", "main", "name", "path", "tag", "uid")


def parse(page: str) -> list[tuple]:
    """Tokens in page order: ("open", node), ("text", string, stack of nodes), ("break",)."""
    out: list[tuple] = []
    root = Node()
    root.tag, root.name, root.path, root.drop, root.main, root.inline, root.uid = "", "", "", False, False, False, 0
    stack = [root]
    at, n, uid = 0, len(page), 1

    def text(s: str) -> None:
        if s:
            out.append(("text", s, tuple(stack)))

    while at < n:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue
        if m[1]:
            if tag in ("br", "p") and not any(x.tag == tag for x in stack):
                out.append(("break",))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if any(not x.inline for x in stack[i:]):
                        out.append(("break",))
                    del stack[i:]
                    break
                if tag in INLINE and not stack[i].inline:
                    break
            continue
        if tag not in INLINE:
            out.append(("break",))
            # a block ends an open paragraph, and inline elements left open in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    if tag not in VOID or tag == "hr":
                        del stack[i:]
                    break
                if not stack[i].inline:
                    break
        if tag in CLOSES:
            ends, until = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in until:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    break
        attrs = {a.lower(): (x or y or z) for a, x, y, z in ATTR.findall(m[3])} if m[3] else {}
        node, up = Node(), stack[-1]
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        words = {w.lower() for w in WORDS.findall(names)} if names.strip() else set()
        role = attrs.get("role", "").lower()
        node.tag, node.inline, node.uid = tag, tag in INLINE, uid
        uid += 1
        told = bool(words & DROP_WORDS) and named(names, DROP_WORDS)
        node.main = (tag in MAIN_TAGS or role in MAIN_ROLES) and not told
        node.drop = up.drop or tag in DROP_TAGS or role in DROP_ROLES or told and tag not in ("html", "body")
        if not node.drop and (tag == "header" or "header" in words and named(names, {"header"})) and tag not in ("html", "body", *HEADINGS):
            node.drop = not any(x.main for x in stack)
        node.name = tag + "".join(sorted("." + w for w in words if not w.isdigit()))
        node.path = up.path if node.inline else f"{up.path}/{node.name}"
        out.append(("open", node))
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag in INLINE:
            continue
        stack.append(node)
    return out


def roles(tokens: list[tuple]) -> dict[str, list]:
    """Occurrences of a page's tokens by role: [count, first place, characters that may be content, those in links].

    A tag's role is its path; a text's is its path and digest. Inline tags are content, not template. The characters are
    those of the text itself, or under the tag.
    """
    out: dict[str, list] = {}
    place = 0
    for t in tokens:
        if t[0] == "open" and not t[1].inline and t[1].tag not in VOID:
            place += 1
            out.setdefault(t[1].path, [0, place, 0, 0])[0] += 1
        elif t[0] == "text" and (s := " ".join(t[1].split())):
            place += 1
            top = t[2][-1]
            own = out.setdefault(text_role(top.path, s), [0, place, 0, 0])
            own[0] += 1
            if not top.drop:
                link = len(s) * any(x.tag == "a" for x in t[2])
                own[2] += len(s)
                own[3] += link
                for p in {x.path for x in t[2] if x.path}:
                    if p in out:
                        out[p][2] += len(s)
                        out[p][3] += link
    return out


def text_role(path: str, text: str) -> str:
    return f"{path}#{xxhash.xxh64_hexdigest(text)}"


OCCURRENCE = "host string, role string, pages long, most long, least long, total long, place double, chars long, links long, sig long"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)"


def host_of(col: str):
    return F.coalesce(F.lower(F.regexp_extract(col, HOST, 1)), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """By host and role, over all pages: support, least and greatest count, and the signature of the occurrence vector.

    The signature is a sum of hashes of (page, count): equal for equal vectors whatever the order or partition, so
    vectors are never gathered, and a host with a third of all pages costs one row a role and partition.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            cols = list(zip(*((*k, *v) for k, v in total.items()), strict=True))
            cols[-1] = [x - (1 << 64) if x >> 63 else x for x in cols[-1]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["host", "role", "pages", "most", "least", "total", "place", "chars", "links", "sig"])

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not page:
                    continue
                key = xxhash.xxh64_digest(page)
                for role, (n, place, chars, links) in [*roles(parse(page)).items(), ("", (1, 0, 0, 0))]:
                    sig = xxhash.xxh64_intdigest(key + n.to_bytes(4, "little"))
                    own = total.get((host, role))
                    if own is None:
                        total[host, role] = [1, n, n, n, float(place), chars, links, sig]
                    else:
                        own[0] += 1
                        own[1], own[2] = max(own[1], n), min(own[2], n)
                        own[3] += n
                        own[4] += place
                        own[5] += chars
                        own[6] += links
                        own[7] = (own[7] + sig) & ((1 << 64) - 1)
            if len(total) > 40_000:
                yield out()
                total.clear()
        if total:
            yield out()

    got = arrow(pages.select("host", "html"), OCCURRENCE, each)
    # sums of 64-bit hashes wrap: add the halves apart
    low, high = F.col("sig").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("sig", 32)
    merged = got.groupBy("host", "role").agg(F.sum("pages").alias("pages"), F.max("most").alias("most"), F.min("least").alias("least"), F.sum("total").alias("total"), (F.sum("place") / F.sum("pages")).alias("place"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum(low).alias("l"), F.sum(high).alias("h"))
    wrapped = (F.col("h") + F.shiftright("l", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return merged.withColumn("sig", F.shiftleft(wrapped, 32).bitwiseOR(F.col("l").bitwiseAND(F.lit(0xFFFFFFFF)))).drop("l", "h")


def deduce(rows: pd.DataFrame) -> dict:
    """A host's template from its roles: nested valid classes, constant texts, link lists, and the content's container.

    A class: roles with one signature. Valid: large enough support; a class seen once a page is the root. Every other
    valid class nests in the longest root role that is a path prefix of all its members (ordered by their mean place);
    a class without such a role is dropped. Slots: what stands below a role and is no constant text. The container is the
    deepest root role with nearly all of the slots' text. A nested class most of whose text is links is a list of links,
    but for the items of lists in articles, whose constant texts alone are the template's. A constant text within the container is the article's own (a heading that recurs, a sentence between slots) if what
    its element lies in holds slots too, that is other text than constants and links; alone in a box of constants and links
    it is the template's. Articles that are root roles are the pages' main ones.
    """
    rows = rows.sort_values(["place", "role"])
    root, nested, texts = [], [], []
    for _, own in rows.groupby("sig", sort=False):
        names = own.role.tolist()
        tags = [r for r in names if "#" not in r]
        once = own.most.max() == 1
        if once:
            root += tags
        elif tags:
            nested.append(tags)
        if once or tags:
            texts += [r for r in names if "#" in r]
    root_set, tree = set(root), {}
    for tags in nested:
        common = tags[0].split("/")
        while common and not (("/".join(common)) in root_set and all(t.startswith("/".join(common) + "/") or t == "/".join(common) for t in tags)):
            common.pop()
        if common:
            tree.setdefault("/".join(common), []).append(tags)
    chars, links = (dict(zip(rows.role, rows[c], strict=True)) for c in ("chars", "links"))
    whole = max((chars[r] for r in root), default=0)
    held = [r for r in root if chars[r] >= 0.7 * whole and whole]
    container = max(held, key=lambda r: (r.count("/"), r)) if held else ""
    articles = [r for r in root if re.match(r"(article|main)(\.|$)", r.rpartition("/")[2]) and chars[r]]

    def cited(t: str) -> bool:
        """Items of a list in an article: sources, say. What is a menu of the host there is constant text."""
        return t.rpartition("/")[2].split(".")[0] in ("li", "ul", "ol") and any(t.startswith(a + "/") for a in articles)

    lists = sorted({t for own in tree.values() for tags in own for t in tags if chars[t] and links[t] >= LINKS * chars[t] and not cited(t)})
    inside = [t for t in texts if container and (t.startswith(container + "/") or t.startswith(container + "#"))]
    # characters of constants that are not links, by every path they are under
    plain: dict[str, float] = {}
    for t in texts:
        path = t.split("#")[0]
        while path:
            plain[path] = plain.get(path, 0) + max(0, chars[t] - links[t])
            path = path.rpartition("/")[0]

    def among_slots(t: str) -> bool:
        path = t.split("#")[0]
        around = path if path == container else path.rpartition("/")[0]
        return chars.get(around, 0) - links.get(around, 0) - plain.get(around, 0) > 0

    own_ = {t for t in inside if not links[t] and among_slots(t)}
    return {"root": root, "nested": tree, "texts": sorted(set(texts) - own_), "container": container, "lists": lists, "mains": sorted(articles)}


def distinct(pages: DataFrame) -> DataFrame:
    """Of equal pages of a host the one with the least id, so that copies don't make their text a template. Only contents
    met twice are looked up; few of them (checked) go to every task, many are joined."""
    keyed = pages.withColumn("digest", F.xxhash64("html", F.length("html")))
    again = cut(keyed.groupBy("host", "digest").agg(F.count("*").alias("c"), F.min(F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("first")).where("c > 1").drop("c"))
    few = F.broadcast(again) if again.count() <= COPIES else again
    return keyed.join(few, ["host", "digest"], "left").where(F.col("first").isNull() | (F.col("first") == F.coalesce(F.col("page_id").cast("string"), F.lit(""))))


def templates(pages: DataFrame) -> DataFrame:
    """``host, container, texts, lists, mains``, for hosts of MIN_PAGES different pages or more. Roles short of their share of
    the host's pages go before the (per host) deduction, so that what it gathers is bounded by a template, not by the
    host's pages. A page with an equal one on its host counts once; null urls are one host, and an empty table has no
    templates."""
    occ = occurrences(distinct(pages))
    occ = cut(occ.where(F.col("pages") >= MIN_PAGES))
    hosts = occ.where("role = ''").select("host", F.col("pages").alias("n"))
    # hosts are many and small here; support is known, so the filter is a join on partial sums
    common = occ.join(hosts, "host").where(F.col("pages") >= SHARE * F.col("n")).where("role <> ''")

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        t = deduce(pdf)
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "container": [t["container"]], "texts": [t["texts"]], "lists": [t["lists"]], "mains": [t["mains"]]})

    return common.groupBy("host").applyInPandas(each, "host string, container string, texts array<string>, lists array<string>, mains array<string>")


def main_text(page: str | None, container: str = "", texts: frozenset = frozenset(), lists: frozenset = frozenset(), mains: frozenset = frozenset()) -> str:
    """The slots' text of one page: below the template's container (or all of the page if it lacks it) without the
    template's constant texts and link lists; there, within the article or main elements, if any (where the template knows
    some that every page has once, these only), without elements whose tag, role or whole name says that they are no
    article, and, outside of articles, lists of nothing but links."""
    if not page:
        return ""
    tokens = parse(page)
    words = [t for t in tokens if t[0] == "text" and not t[2][-1].drop]

    def slot(stack: tuple, text: str) -> bool:
        return not any(x.path in lists for x in stack) and not (texts and text_role(stack[-1].path, " ".join(text.split())) in texts)

    has = container and any(x.path == container for t in words for x in t[2])
    region = (lambda s: any(x.path == container for x in s)) if has else (lambda s: True)
    known = lambda s: any(x.path in mains for x in s)
    for within in (known, region, lambda s: True):  # an article elsewhere than in the container still is one
        explicit: dict[int, str] = {}
        for t in words:
            if within(t[2]) and slot(t[2], t[1]):
                for x in t[2]:
                    if x.main:
                        explicit[x.uid] = x.path
                        break
        if explicit:
            break
    if explicit:
        chosen = {k for k, path in explicit.items() if path in mains} or set(explicit)
        inside = lambda s: any(x.uid in chosen for x in s)
    else:
        inside = region
    counted: dict[int, list[int]] = {}
    for t in tokens:
        if t[0] == "text" and (n := len(t[1].strip())):
            link = any(x.tag == "a" for x in t[2])
            for x in () if any(x.main for x in t[2]) else t[2]:
                if x.tag in ("ul", "ol"):
                    own = counted.setdefault(x.uid, [0, 0, 0])
                    own[0] += n
                    own[1] += n * link
                    own[2] += link
    menus = {u for u, (n, link, k) in counted.items() if k >= 3 and link >= 0.9 * n}
    blocks, now = [], []
    for t in tokens:
        if t[0] == "break" or t[0] == "open" and t[1].tag in VOID and t[1].tag not in INLINE:
            blocks.append(now)
            now = []
        elif t[0] == "text":
            s, stack = t[1], t[2]
            if stack[-1].drop or not inside(stack) or any(x.uid in menus for x in stack) or s.strip() and not slot(stack, s):
                continue
            now.append(s)
    blocks.append(now)
    return " ".join(x for x in (" ".join(charrefs.unescape("".join(b)).split()) for b in blocks) if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row, from the whole html.

    Null or empty html, and pages without an article's text, give an empty text. Hosts with few pages (or null urls: one
    host, the empty name) have no template and rely on each page's own structure. Repeated rows stay. Other columns are
    not read. Templates whose size is checked go to every task; larger ones are joined, AQE splitting hot hosts.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    made = cut(templates(src.where("html is not null")))
    size = made.agg(F.sum(F.length("container") + (F.size("texts") + F.size("lists") + F.size("mains")) * 100 + 200)).first()[0] or 0
    schema = f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def rows(b: pa.RecordBatch, of) -> pa.RecordBatch:
        got = [main_text(page, *of(i, host)) for i, (host, page) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], ["page_id", "url", "text", "n_chars"])

    if size <= TEMPLATE_BYTES:
        known = {r.host: (r.container, frozenset(r.texts), frozenset(r.lists), frozenset(r.mains)) for r in made.collect()}
        sent = src.sparkSession.sparkContext.broadcast(known)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = ("", frozenset(), frozenset(), frozenset())
            for b in batches:
                yield rows(b, lambda i, host: sent.value.get(host, none))

        return arrow(src, schema, each)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = list(zip(*(b.column(k).to_pylist() for k in (4, 5, 6, 7)), strict=True))
            yield rows(b, lambda i, host, own=own: (own[i][0] or "", frozenset(own[i][1] or ()), frozenset(own[i][2] or ()), frozenset(own[i][3] or ())))

    return arrow(src.join(made, "host", "left").select("page_id", "url", "host", "html", "container", "texts", "lists", "mains"), schema, joined)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; nulls, repeats and empty tables as in ``extract``."""
    return extract(read(spark, sf_dir, "pages"))
