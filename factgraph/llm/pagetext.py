"""Operator 5: the main text of web pages, by a site style tree.

The pages of a host are merged into one tree.  A node is the path of a block element with its classes and ids; where
pages differ in what blocks it holds, these sequences are its styles.  Over the host's different pages a node has two
entropies, each from 0 (all alike) to 1 (each its own): that of its styles, if it holds blocks, and that of its own
text, if it has some.  Their mean is the node's importance.  That of a branch is the mean over all its nodes by the
pages that have them, in which each level down counts GAMMA times.  It is pulled towards one half where few pages have
the node, and added to what the node's role on the page says by itself (article text, neutral, or menus, adverts, forms
and the like).  What is named an advert, a notice or a menu never comes back, however distinct.  Text of nodes whose sum is not above 0 is removed: a branch in which no sum is above 0 goes as a whole.

Only nodes that importance decides otherwise than the role alone travel back to the pages; as a rule these are few,
so that Spark can broadcast them after a check of their size, and else shuffles.  No host is ever gathered in one task.

Rows: null or empty html gives an empty text of 0 characters; a null or odd url is a host of its own name.  Repeated
rows give repeated rows.  Elements nested deeper than DEEPEST count as the one at that depth.  Other columns are not
read.  No rows give no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.common import by_batch, stored, table, texts

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)>|<[!?][^>]*+>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)

# The names of HTML's elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg object canvas select".split())
BLOCKS = frozenset(
    "html head body title article main section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption "
    "thead tbody tfoot tr td th blockquote pre figure figcaption address form fieldset legend label button dialog menu details summary center hgroup search".split()
)
ENDS_P = BLOCKS - {"html", "head", "body", "title", "label", "button", "legend"}
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head", "title"}}
SCOPE = frozenset("html body article main section nav header footer aside div ul ol dl table form td th".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary address".split())
NOISE = frozenset("head title nav footer aside legend label button dialog menu search".split())
HINTS = frozenset("form fieldset".split())
WHOLE = frozenset("html body main".split())
NOISE_WORDS = frozenset("copyright disclaimer header masthead promo promotion related share sharing widget".split())
#: Adverts, notices and menus are often distinct on each page, so that importance never brings these back.
ADVERT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promoted sidebar signup social sponsor sponsored subscribe subscription toolbar".split()
)
#: What readers write is distinct on each page, so that these words rule as elements of noise do.
READERS = frozenset("comment comments disqus replies reply".split())
#: Words that may stand beside those of noise in a name; any other word means that the name says something else (share-price).
BESIDE = frozenset(
    "area article articles bar block bottom box button buttons center col column container content entry form global group icons inner item items "
    "left link links list main outer page panel post posts primary right secondary section site slot thread top unit wrap wrapper".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
WORDS = re.compile(r"[a-z]+|[0-9]+")

#: What a role says by itself: text of an article, other parts of one, parts of no role, what has hints of noise, and menus
#: and the like.  Importance less one half, below 0.5 either way, is added: over 16 pages or more it may turn all but the last.
TEXT_ROLE, PART_ROLE, NO_ROLE, HINT_ROLE, NOISE_ROLE = 0.4, 0.3, 0.01, -0.4, -0.6
#: So many pages with a node pull its importance as hard as the doubt about it.
DOUBT = 4
#: What a level down counts in the importance of a branch.
GAMMA = 0.9
#: Levels of the tree.
DEEPEST = 64


class _Node:
    """An open element: its place, the noise it is, and how much of the page's main part it is or holds."""

    __slots__ = ("tag", "place", "chain", "up", "noise", "hint", "main", "within", "inside", "tops", "articles", "role", "kids", "advert")

    def __init__(self, tag: str, attrs: str, up: "_Node | None"):
        self.within = up is not None and (up.main or up.within)
        self.inside = up is not None and (up.inside or (up.main and up.tag != "main"))
        name, self.noise, self.advert, self.hint, self.main = _node(tag, attrs, self.inside)
        self.tag, self.up, self.kids = tag, up, []
        if up and len(up.chain) == DEEPEST:
            self.place, self.chain = up.place, up.chain
        else:
            self.place = text_hash(f"{up.place if up else ''}/{name}")
            self.chain = (self.place, *(up.chain if up else ()))
        if up:
            up.kids.append(name)
        # a header outside of an article is the page's; one of an article has its headline
        self.hint = self.hint or (tag == "header" and not self.within)
        # of its own; parsed() adds those within
        self.tops, self.articles = int(self.main and not self.within), int(self.main and tag != "main")


class _Stack:
    """The open elements, with the places of each tag's, so that none is looked for one by one."""

    def __init__(self) -> None:
        self.nodes: list[_Node] = []
        self.at: dict[str, list[int]] = {}

    def innermost(self, tags: Iterable[str]) -> int:
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=-1)

    def push(self, node: _Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, tags: Iterable[str], scope: Iterable[str]) -> None:
        """Ends the innermost open one of `tags`, with all in it, unless one of `scope` lies between."""
        i = self.innermost(tags)
        if i >= 0 and self.innermost(scope) <= i:
            for x in self.nodes[i:]:
                self.at[x.tag].pop()
            del self.nodes[i:]


def _named(value: str, words: frozenset[str]) -> bool:
    """Whether one of the names in a class or id is made of these words, and of such as may stand beside them."""
    parts = [set(WORDS.findall(x)) for x in value.split()]
    return any(not words.isdisjoint(x) and x <= words | BESIDE for x in parts)


def _node(tag: str, attrs: str, inside: bool) -> tuple[str, bool, bool, bool, bool]:
    """The name of a node, and whether it is noise, is named as an advert or the like, has hints of noise, or is the main
    part of a page; inside: of an article."""
    # an aside of an article may be a quote from it
    noise, advert, hint, main = tag in NOISE and not (tag == "aside" and inside), False, tag in HINTS or tag == "aside", tag in ("article", "main")
    name = tag
    if attrs and not attrs.isspace():
        for m in ATTRIBUTE.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                noise, hint, main = noise or value in NOISE_ROLES, hint or value in HINTS, main or value in ("main", "article")
            elif key == "hidden":
                noise = True
            else:
                name += ("." if key == "class" else "#") + value
                if tag not in WHOLE:
                    noise = noise or _named(value, READERS)
                    advert = advert or _named(value, ADVERT_WORDS)
                    hint = hint or _named(value, NOISE_WORDS | ADVERT_WORDS)
    return name, noise, advert, hint, main


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parsed(page: str) -> tuple[list[_Node], list[tuple[_Node | None, str]]]:
    """The block elements of a page, each after the one around it, and the blocks of text with the element that has each."""
    out: list[tuple[_Node | None, str]] = []
    stack, nodes = _Stack(), []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            raw = "".join(parts)
            parts.clear()
            if text := " ".join((entities.unescape(raw) if "&" in raw else raw).split()):
                out.append((stack.nodes[-1] if stack.nodes else None, text))

    # a tag that begins after the last `>` has no end; comments that never end take the rest
    at, last = 0, page.rfind(">") + 1
    while m := MARKUP.search(page, at, last):  # from where a raw element ends, so that nothing in it counts as markup
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = len(page) if m[0].startswith("<!--") and not m[0].endswith("-->") else m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag in BLOCKS:
                flush()
                stack.close((tag,), ())
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag in ENDS_P and stack.at.get("p"):
                stack.close(("p",), SCOPE)
            if tag in ALIKE:
                stack.close(ALIKE[tag], SCOPE - {"td", "th"} if tag == "tr" else SCOPE)
            attrs = m["attrs"] or m["attrs2"] or ""
            if not attrs.endswith("/"):
                nodes.append(_Node(tag, attrs, stack.nodes[-1] if stack.nodes else None))
                stack.push(nodes[-1])
        elif tag in ("br", "hr", "img"):
            parts.append(" ")
    if at < len(page):
        end = page.find("<!--", at)
        parts.append(page[at : end if end >= 0 else len(page)])
    flush()
    for x in reversed(nodes):  # children before parents
        if x.up:
            x.up.tops += x.tops
            x.up.articles += x.articles
    tops, articles = sum(x.main and not x.within for x in nodes), sum(x.main and x.tag != "main" for x in nodes)
    for x in nodes:
        around = x.tops == tops > 0 or (x.within and x.articles == articles > 0)
        own = NOISE_ROLE if x.noise or (x.advert and not around) else HINT_ROLE if x.hint and not around else 0.0
        x.role = min(own, x.up.role) if x.up else own
    for x in nodes:  # children have taken what their parents are
        x.role = x.role or (NO_ROLE if not (x.main or x.within) else TEXT_ROLE if x.tag in TEXT else PART_ROLE)
    return nodes, out


def blocks(page: str) -> list[tuple[int, float, str]]:
    """(place in the tree, what its role says, text) of each block of text, in page order."""
    return [(x.place, x.role, t) if x else (0, NO_ROLE, t) for x, t in parsed(page)[1]]


SAID = "key bigint, host string, page bigint, path bigint, chain array<bigint>, role double, said bigint, style bigint"


def _content(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each page and node: its place and those around it, its role, hashes of its text and of what it holds."""
    row, path, chain, role, said, style = [], [], [], [], [], []
    for k, page in enumerate(texts(batch, "html")):
        nodes, found = parsed(page)
        own: dict[int, tuple[tuple[int, ...], float, list[str], list[str]]] = {}
        for x in nodes:
            at = own.setdefault(x.place, (x.chain, x.role, [], []))
            if x.kids:
                at[3].append(" ".join(x.kids))
        for x, text in found:
            own.setdefault(x.place if x else 0, ((0,), NO_ROLE, [], []))[2].append(text)
        for p, (c, r, t, kids) in own.items():
            if t or kids:
                row.append(k)
                path.append(p)
                chain.append(c)
                role.append(r)
                said.append(text_hash("\n".join(t)) if t else None)
                style.append(text_hash("\n".join(kids)) if kids else None)
    row = pa.array(row, pa.int64())
    made = [pa.array(path, pa.int64()), pa.array(chain, pa.list_(pa.int64())), pa.array(role, pa.float64()), pa.array(said, pa.int64()), pa.array(style, pa.int64())]
    return pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(3)), *made], names=["key", "host", "page", "path", "chain", "role", "said", "style"])


def _texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """page_id, url, text from html and the nodes that importance decides otherwise than their role."""
    made = []
    for page, turned in zip(texts(batch, "html"), batch.column(3).to_pylist(), strict=True):
        turned = set(turned or ())
        made.append("\n\n".join([t for p, r, t in blocks(page) if (r > 0) != (p in turned)]))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def importance(said: DataFrame) -> DataFrame:
    """host, path, least and most (of its roles), importance of each node of the hosts' trees.

    said: host, page (a hash), path, chain (the node and those around it, up to the root), role, said, style (hashes, or
    null).  Only aggregates over a node's different texts and styles meet, then one row of each node.
    """
    once = said.select("host", "page", "path", "chain", "role", "said", "style").distinct()
    kinds = F.array(F.struct(F.lit(True).alias("text"), F.col("said").alias("value")), F.struct(F.lit(False).alias("text"), F.col("style").alias("value")))
    each = once.select("host", "path", "chain", "role", F.explode(kinds).alias("x")).select("host", "path", "chain", "role", "x.*").where("value IS NOT NULL")
    same = each.groupBy("host", "path", "text", "value").agg(F.count("*").alias("n"), F.min("role").alias("least"), F.max("role").alias("most"), F.first("chain").alias("chain"))
    sums = [F.sum(F.when(F.col("text") == text, x)).alias(f"{name}_{text}") for text in (True, False) for name, x in (("n", F.col("n")), ("nlogn", F.col("n") * F.log("n")))]
    node = same.groupBy("host", "path").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"), F.first("chain").alias("chain"))

    def entropy(text: bool) -> Column:
        n = F.col(f"n_{text}")
        return F.when(n > 1, 1 - F.col(f"nlogn_{text}") / (n * F.log(n))).when(n == 1, 1.0)

    own = F.coalesce((entropy(True) + entropy(False)) / 2, entropy(True), entropy(False))
    node = stored(node.select("host", "path", "least", "most", "chain", F.greatest("n_True", "n_False").alias("pages"), own.alias("own")), "tree")
    part = node.select("host", F.posexplode("chain").alias("down", "at"), "pages", "own").withColumn("w", F.col("pages") * F.pow(F.lit(GAMMA), F.col("down")))
    branch = part.groupBy("host", F.col("at").alias("path")).agg((F.sum(F.col("w") * F.col("own")) / F.sum("w")).alias("branch"))
    sure = F.col("pages") / (F.col("pages") + DOUBT)
    return node.drop("chain").join(branch, ["host", "path"]).select("host", "path", "least", "most", (0.5 + (F.col("branch") - 0.5) * sure).alias("importance"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of `pages` (page_id, url, html)."""
    src = pages.select("page_id", "url", "html").withColumn("key", F.xxhash64("page_id", "url", "html"))
    keyed = src.select("key", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    said = stored(keyed.mapInArrow(by_batch(_content), SAID), "nodes")

    def turns(role: str) -> Column:
        return (F.col(role) + F.col("importance") - 0.5 > 0) != (F.col(role) > 0)

    # a node may have another role on another page; tables of their own, so that Spark knows sizes before it chooses a join
    turned = stored(importance(said).where(turns("least") | turns("most") | (F.col("least") != F.col("most"))).select("host", "path", "importance"), "unlike")
    texts_ = said.where("said IS NOT NULL").select("key", "host", "path", "role")
    by_page = stored(texts_.join(turned, ["host", "path"]).where(turns("role")).groupBy("key").agg(F.collect_set("path").alias("turned")), "turned")
    schema = T.StructType([src.schema["page_id"], src.schema["url"], T.StructField("text", T.StringType())])
    return src.join(by_page, "key", "left").select("page_id", "url", "html", "turned").mapInArrow(by_batch(_texts), schema)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
