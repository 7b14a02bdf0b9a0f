"""Main text of web pages by templates deduced from equivalence classes of tokens across the pages of a host.

A page is read as tokens: each element by its path of tags, classes and ids, and each text block with its path. The
occurrence vector of a token says how often it occurs in each different page of its host, and tokens with equal vectors form an
equivalence class. A class of elements is valid if SUPPORT pages hold it. Valid classes nest by the paths of their elements and are
the host's template; what stands between its elements is a slot. The slot of the article is the innermost element of the template, once
on a page, that holds MOST of the free text (outside links, menus and the like) of the pages it occurs in. Inside it, a class of
texts is valid, and so part of the template, if TEXT_SHARE of the host's pages hold it and it leaves enough of the slot to others: copies of
one article share all their texts, which makes these no template.

A page gives the text of that slot without the template's texts; text outside of it goes, but for a heading h1,
which stays on hosts without a template too. Elements
that HTML itself sets apart (nav, aside, footer, form and others) are never text. Class names decide last: inside the slot, or
where a page has no template, regions named as advert, comments, sidebar and so on go.

Vectors are never built: a vector's fingerprint is a sum of hashes over pages, which Spark adds up before it shuffles, so a
host with any number of pages costs each task no more than its own pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import in_batches, materialize, reserve, table

#: Different pages that a valid class occurs in, at least, and share of the host's pages that hold an element or a text of the template.
SUPPORT, ELEMENT_SHARE, TEXT_SHARE = 3, 0.05, 0.9
#: Share of the free text that the article's slot holds, and of the slot's text that a class of texts leaves to others.
MOST, LEAVES = 0.5, 0.2

#: Possessive, so that each character is read once. An attribute's value without quotes may hold quotes (HTML5).
_NAME, _VALUE = r"=?+[^\s/>=]*+", r"\"[^\"]*+\"?|'[^']*+'?|[^\s>]*+"
_MARKUP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^A-Za-z>][^>]*+(?:>|\Z)|</>|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]*+(?=[^>]){_NAME}(?:\s*+=\s*+(?:{_VALUE}))?+)*+)[\s/]*+(?:>|\Z)", re.S)
_ATTRIBUTES = re.compile(rf"[\s/]*+(?=[^>])({_NAME})(?:\s*+=\s*+({_VALUE}))?+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_DROPPED = frozenset("head title script style noscript template nav aside form button select option textarea input iframe noembed noframes svg math object audio video canvas dialog menu footer map datalist".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_NO_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TABLE, _SCOPE = frozenset("table tbody thead tfoot tr td th caption".split()), frozenset("table td th caption template".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Whole class names and ids of regions that are not the article; longer names that only begin like one are no match.
_NAMES = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|adsense|ad-?(?:box|slot|unit|banner|container|wrapper)|banner|sponsor(?:ed|s)?|promo(?:s|tions?)?|sidebar|side-bar|(?:left|right|page|site)-sidebar|widgets?"
    r"|nav|navbar|navigation|(?:main|site|top|primary)-?(?:nav|menu|navigation)|menu|breadcrumbs?|masthead|(?:site|page)-?(?:header|footer)|header|footer"
    r"|comments?|comment-?(?:list|form|section|area|thread)|comments-?(?:list|area|section)|disqus(?:_thread)?|respond|replies|cookies?|cookie-?(?:banner|notice|consent|bar)|consent|gdpr|notice|notification|popup|modal|overlay"
    r"|newsletter|subscribe|signup|login|share|sharing|social|social-?(?:links|share|sharing|media)|share-?(?:buttons|links|bar)|related|related-?(?:posts|articles|links|stories|content)|recommended|pagination|pager|toolbar|skip-?link)"
)


def _region(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """An element's name in paths (tag, classes and id, long numbers as 0), whether HTML sets it apart from the text, and whether its names do."""
    apart = tag in _DROPPED or tag == "header" and not in_article
    if not attributes.strip():
        return tag, apart, False
    found: dict[str, str] = {}
    for m in _ATTRIBUTES.finditer(attributes):
        value = m[2] or ""
        found.setdefault(m[1].lower(), unescape(value.strip(value[0]) if value[:1] in ("'", '"') else value))
    apart = apart or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in _ROLES
    apart = apart or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    named = tag not in ("html", "body", "article", "main") and any(_NAMES.fullmatch(x) and not (in_article and x == "header") for x in names)
    return " ".join([tag, *(re.sub(r"\d{3,}", "0", x) for x in names)]), apart, named


class Page:
    """The blocks of a page in order, its elements by token, and the length of its free text."""

    def __init__(self, html: str | None) -> None:
        self.blocks: list[tuple[int, str, bool, bool, bool]] = []  # path, text, in an article or main element, in a named region, in an h1
        self.elements: dict[int, list[int]] = {}  # token to: times, depth, first block, past the last, free characters
        self.free = 0
        self.read(html or "")

    def read(self, html: str) -> None:
        from xxhash import xxh64_intdigest

        # tag, apart, in an article, named, h1, token, free characters before
        stack: list[tuple[str, bool, bool, bool, bool, int, int]] = []
        root = ("", False, False, False, False, 0, 0)
        held: list[tuple[str, bool]] = []
        links = 0

        def end() -> None:
            text = " ".join(unescape("".join(t for t, _ in held)).split()) if held else ""
            if text:
                _, _, inside, named, h1, path, _ = stack[-1] if stack else root
                self.blocks.append((path, text, inside, named, h1))
                if not named:
                    self.free += len(" ".join(unescape("".join(t for t, link in held if not link)).split()))
            held.clear()

        def pop(to: int) -> None:
            nonlocal links
            for tag, _, _, _, _, token, before in reversed(stack[to:]):
                links -= tag == "a"
                if tag not in _INLINE:
                    e = self.elements[token]
                    e[3] = len(self.blocks)
                    e[4] += self.free - before
            del stack[to:]

        at, n = 0, len(html)
        while at < n:
            m = _MARKUP.search(html, at)
            stop = m.start() if m else n
            if stop > at and not (stack and stack[-1][1]):
                held.append((html[at:stop], links > 0))
            if m is None:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if tag not in _INLINE and (not m[1] or tag == "p"):
                end()
            if m[1]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        if tag not in _INLINE:
                            end()
                            pop(i)
                        else:  # a formatting element ends by itself; what began in it goes on
                            links -= tag == "a"
                            del stack[i]
                        break
                    if stack[i][0] in (("table", "template") if tag in _TABLE else _SCOPE) and stack[i][0] != tag:
                        break
            elif tag not in _VOID:
                closes = _CLOSES.get(tag, {"p"} if tag in _NO_P else ())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        pop(i)
                    elif stack[i][0] not in _INLINE:
                        break
                _, apart, inside, named, h1, path, _ = stack[-1] if stack else root
                name, own_apart, own_named = _region(tag, m[3] or "", inside)
                token = path
                if tag not in _INLINE:
                    token = xxh64_intdigest(name, path)
                    e = self.elements.setdefault(token, [0, 0, len(self.blocks), 0, 0])
                    e[0] += 1
                    e[1] = len(stack)
                links += tag == "a"
                stack.append((tag, apart or own_apart, inside or tag in ("article", "main"), named or own_named, h1 or tag == "h1", token, self.free))
                if tag in _RAW:
                    close = _RAW[tag].search(html, at)
                    if not stack[-1][1]:
                        held.append((html[at : close.start() if close else n], links > 0))
                    at = close.start() if close else n
        end()
        pop(0)

    def times(self) -> list[int]:
        """Per block how often its path and text occur on the page (0 but at the first place)."""
        count = Counter(b[:2] for b in self.blocks)
        return [count.pop(b[:2], 0) for b in self.blocks]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


BLOCKS = "array<struct<text:string,path:bigint,n:bigint,inside:boolean,named:boolean,h1:boolean>>"
SEEN = "array<struct<token:bigint,n:bigint,depth:int,first:int,past:int,chars:bigint>>"


def parse(pages: DataFrame) -> DataFrame:
    """pages without html, with blocks, seen (each different element of the page), free (characters) and print (a digest of both)."""
    at = pages.columns.index("html")
    kept = [c for c in pages.columns if c != "html"]
    places = [pages.columns.index(c) for c in kept]
    kinds = [
        pa.list_(pa.struct([("text", pa.string()), ("path", pa.int64()), ("n", pa.int64()), ("inside", pa.bool_()), ("named", pa.bool_()), ("h1", pa.bool_())])),
        pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64()), ("depth", pa.int32()), ("first", pa.int32()), ("past", pa.int32()), ("chars", pa.int64())])),
    ]
    signed = lambda x: x - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            blocks, seen, free, prints = [], [], [], []
            for html in batch.column(at):
                page = Page(html.as_py())
                blocks.append([{"text": text, "path": signed(path), "n": n, "inside": inside, "named": named, "h1": h1} for n, (path, text, inside, named, h1) in zip(page.times(), page.blocks, strict=True)])
                seen.append([{"token": signed(t), "n": n, "depth": depth, "first": first, "past": past, "chars": chars} for t, (n, depth, first, past, chars) in page.elements.items()])
                free.append(page.free)
                prints.append(signed(xxh64_intdigest(repr((page.blocks, page.elements)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(blocks, kinds[0]), pa.array(seen, kinds[1]), pa.array(free, pa.int64()), pa.array(prints, pa.int64())], names=[*kept, "blocks", "seen", "free", "print"])

    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("blocks", T._parse_datatype_string(BLOCKS)), T.StructField("seen", T._parse_datatype_string(SEEN)), T.StructField("free", T.LongType()), T.StructField("print", T.LongType())])
    return in_batches(pages, run, schema)


def token_classes(each: DataFrame) -> DataFrame:
    """(host, print, token, n, depth, chars, free), a row per page and token, to a row per host and token: the fingerprint a, b of its
    vector and its number of pages, which name its class, whether it is once on each, depth, and sums of chars and free."""
    hashed = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "print", "n"), F.lit(1 << 31)))
    return each.groupBy("host", "token").agg(hashed(1).alias("a"), hashed(2).alias("b"), F.count("*").alias("pages"), (F.max("n") == 1).alias("once"), F.max("depth").alias("depth"), F.sum("chars").alias("chars"), F.sum("free").alias("free"))


def frequent(tokens: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    """Tokens on SUPPORT pages at least and on this share of the host's."""
    return tokens.join(sizes, F.col("host") == F.col("s_host")).where(F.col("pages") >= F.greatest(F.lit(SUPPORT), F.col("all_pages") * share)).drop("s_host", "all_pages")


def slots(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(t_host, slots): depth and token of the elements of valid classes that can be the article's slot; at most a page's chain times 1 / ELEMENT_SHARE."""
    tokens = token_classes(pages.select("host", "print", "free", F.explode("seen").alias("t")).select("host", "print", "free", "t.*"))
    able = F.col("once") & (F.col("chars") >= MOST * F.col("free")) & (F.col("chars") > 0)
    return frequent(tokens, sizes, ELEMENT_SHARE).where(able).groupBy(F.col("host").alias("t_host")).agg(F.sort_array(F.collect_list(F.struct("depth", "token"))).alias("slots"))


def with_range(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Adds low, past: the blocks of the page's innermost slot (null without one)."""
    own = F.filter("seen", lambda t: (t["n"] == 1) & F.exists("slots", lambda s: s["token"] == t["token"]))
    best = F.array_max(F.transform(own, lambda t: F.struct(t["depth"].alias("depth"), (-t["first"]).alias("first"), t["past"].alias("past"))))
    both = pages.join(found, F.col("host") == F.col("t_host"), "left").withColumn("best", best)
    return both.withColumn("low", -F.col("best.first")).withColumn("past", F.col("best.past")).drop("best", "slots", "t_host")


def text_token(block: Column) -> Column:
    return F.xxhash64(block["path"], block["text"])


def fixed_texts(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(f_host, fixed): tokens of the texts of valid classes in the slots and headings h1; about as many as texts on a page, times 1 / TEXT_SHARE."""
    inside = F.filter("marks", lambda x: x["h1"] | (x["i"] >= F.coalesce("low", F.lit(0))) & (x["i"] < F.coalesce("past", F.lit((1 << 31) - 1))))
    each = pages.withColumn("inside", inside).withColumn("chars_in", F.aggregate("inside", F.lit(0).cast("bigint"), lambda a, x: a + x["chars"]))
    each = each.select("host", "print", F.col("chars_in").alias("free"), F.explode("inside").alias("t")).where("t.n > 0")
    tokens = token_classes(each.select("host", "print", "free", "t.token", "t.n", F.lit(0).alias("depth"), (F.col("t.n") * F.col("t.chars")).alias("chars")))
    classes = frequent(tokens, sizes, TEXT_SHARE).groupBy("host", "a", "b", "pages").agg(F.collect_list("token").alias("members"), F.sum("chars").alias("chars"), F.max("free").alias("free"))
    return classes.where(F.col("chars") <= (1 - LEAVES) * F.col("free")).groupBy(F.col("host").alias("f_host")).agg(F.flatten(F.collect_list("members")).alias("fixed"))


def templates(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hosts' slots and fixed texts, written. Equal pages of a host (print) count once."""
    mark = lambda x, i: F.when(~x["named"], F.struct(i.alias("i"), text_token(x).alias("token"), x["n"].alias("n"), F.length(x["text"]).alias("chars"), x["h1"].alias("h1")))
    marks = F.filter(F.transform("blocks", mark), lambda x: x.isNotNull())
    pages = materialize(parsed.select("host", "print", "seen", "free", marks.alias("marks")).dropDuplicates(["host", "print"]), "pages")
    sizes = materialize(pages.groupBy(F.col("host").alias("s_host")).agg(F.count("*").alias("all_pages")), "hosts")
    found = materialize(slots(pages, sizes), "slots")
    return found, materialize(fixed_texts(with_range(pages, found), sizes), "fixed-texts")


def slot_text() -> Column:
    """The blocks of the page's slot, or without one those of article or main, or else all; a heading h1 wherever it stands; less the template's texts."""
    inside = F.exists("blocks", lambda x: x["inside"] & ~x["named"])

    def kept(x: Column, i: Column) -> Column:
        in_slot = F.when(F.col("low").isNotNull(), (i >= F.col("low")) & (i < F.col("past"))).otherwise(x["inside"] | ~inside)
        return (in_slot | x["h1"]) & ~x["named"] & ~F.when(F.size("fixed") > 0, F.array_contains("fixed", text_token(x))).otherwise(F.lit(False))

    return F.filter("blocks", kept)


def extract(pages: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """pages (page_id, url, html and any others) with text and n_chars in place of html; found: templates to use instead of the pages' own.

    Null or empty html gives an empty text; a null or odd url is the host ''. Whole pages are read, whatever their length, one at a
    time. Repeated rows keep a row each and count as one page in the template, so ties and the order of rows do not matter. An empty
    table gives an empty result. Extra columns stay; those with a name that the operator adds are an error. Pages are parsed once and
    written; the templates meet them by host, broadcast by Spark if their written size allows, else in a join whose hot hosts
    it splits.
    """
    reserve(pages, "text", "n_chars", "host", "slots", "fixed", "t_host", "f_host", "blocks", "seen", "free", "print", "best", "low", "past", "marks")
    parsed = materialize(parse(pages.withColumn("host", host_of(F.col("url")))), "parsed-pages")
    found, fixed = found or templates(parsed)
    both = with_range(parsed, found).join(fixed, F.col("host") == F.col("f_host"), "left")
    done = both.withColumn("text", F.array_join(F.transform(slot_text(), lambda x: x["text"]), " "))
    return done.select(*[c for c in pages.columns if c != "html"], "text", F.length("text").cast("bigint").alias("n_chars"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
