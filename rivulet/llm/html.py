"""Main text of HTML pages by equivalence-class template deduction.

Every page is a sequence of tokens: tags in the context of the tags around them, and text nodes in theirs.
Across the pages of a host, tokens that occur equally often on every page share an occurrence vector and
form an equivalence class. Vectors are kept as fingerprints (an xor of hashes of page and count), so
that one aggregation with partial sums builds them, however many pages a host has. A class is
valid when at least two pages and half of the host's pages have it and when its tokens stand in the same order on all of
them; it is nested in the class that has the tag around it. The valid classes are the host's template: what they leave open are
slots. Extraction drops text that belongs to the template and slots that are menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments (by element, role or the words of class and id), and returns the other slots of the article.

Text inside an ``article`` or ``main`` element is template only if what stands around it differs: at least ``LEAST_CONTENTS``
and half of the host's distinct contents have it. The content of a page is the text of its article that isn't frequent on the host, nor an edited form of
frequent text (by the words around the longest one), and counts where it is a tenth of the article or more. So copies and near copies of one article are no template.

Templates are joined to the pages by host; they are broadcast only after their size has been counted
and found below ``MOST_BROADCAST`` tokens, and else joined by a shuffle that can split a large host.

A class or an id is a hint only: words after "no", "has", "with" or "without" don't count, an ``article`` or ``main`` is shut only by a class or id that is such a word as a whole, and
where all articles of a page, or without any nine tenths of its text, stand in an element that its class would shut, that element is open.

Defined cases: null or empty html gives an empty text; a null url belongs to the host ''; hosts of one page have no
template and keep all slots of the article; broken or cut markup is read as far as it goes; without an
article the smallest element that holds all remaining text besides links is taken whole; repeated rows are repeated pages; other columns pass through.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, saved, unused

NAME = "op3_main_text"
ORACLE_SQL = None

MOST_BROADCAST = 200_000
#: Two articles that share a line quote each other; three are the least that show a template.
LEAST_CONTENTS = 3
#: Text of an element, in times of the open text, that opens the element whatever its class.
MOST_TEXT = 9

#: Fixed values of HTML and of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe xmp template".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = set("head nav header footer aside form script style title noscript template button select option textarea iframe object svg canvas dialog menu audio video map".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
FURNITURE = set(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs
    header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login
    share sharing social related recommended comment comments commentlist reply replies respond disqus form search copyright disclaimer pagination pager toolbar skip hidden""".split()
)
DENIALS = {"no", "has", "with", "without"}
CLOSES_P = set("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag ends open tags of its own kind up to the nearest of these.
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _hints(value: str, article: bool) -> bool:
    """Whether a class or id speaks of furniture."""
    for own in value.split():
        words = re.findall("[a-z]+", own)
        if article:
            words = words if len(words) == 1 else []
        elif words and words[0] in DENIALS:
            continue
        if not FURNITURE.isdisjoint(words):
            return True
    return False


def read_page(source: str) -> Page:
    """The page, with elements open that their class would shut though they hold what the page is about."""
    opened: frozenset[int] = frozenset()
    while True:
        page = Page(source, opened)
        if page.has_article:
            return page
        more = page.shuts_article
        if not more:
            own = {n: size for n, size in page.shut_by.items() if n > 0 and size > MOST_TEXT * page.shut_by.get(0, 0)}
            more = {max(own, key=lambda n: (own[n], -n))} if own and not opened else set()
        if not more:
            return page
        opened |= more


class Page:
    """Tokens and text of one page. Each text node: (block, token, text, shut, in article, container, in a link)."""

    def __init__(self, source: str, opened: frozenset[int] = frozenset()):
        from xxhash import xxh64_intdigest

        self.tokens: list[tuple[int, int, str, str]] = []  # token, token around it, label, text in an article
        self.texts: list[tuple[int, int, str, bool, bool, int, bool]] = []
        self.outer = [0]  # the container around each container
        #: Whether an article is open; the elements, by number, that alone shut an article; the text that an element shuts by class.
        self.has_article, self.shuts_article, self.shut_by = False, set(), {}
        # Name, token, shut (0 no, -1 for good, else the number of the outermost element that is shut by its class), in article, container, in a link.
        stack: list[tuple[str, int, int, bool, int, bool]] = [("", 0, 0, False, 0, False)]
        block = at = number = 0
        lower = source.lower()

        def text(raw: str) -> None:
            if raw:
                raw = entities.unescape(raw)
                words = " ".join(raw.split())
                _, around, shut, inside, container, link = stack[-1]
                token = xxh64_intdigest(words, around & (2**64 - 1)) if words else 0
                self.shut_by[shut] = self.shut_by.get(shut, 0) + len(words)
                if words and not shut:
                    self.tokens.append((token, around, "text", words if inside else ""))
                self.texts.append((block, token, raw, shut, inside, container, link))

        while at < len(source):
            m = MARKUP.search(source, at)
            if not m:
                rest = source[at:]
                cut = re.search(r"<(?:[a-zA-Z/!?][^<>]*)?\Z", rest)  # a tag that the page's end cuts
                text(rest[: cut.start()] if cut else rest)
                break
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if name not in INLINE:
                block += 1
            elif name == "br":
                self.texts.append((block, 0, " ", *stack[-1][2:]))
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                continue
            if name in CLOSES_P:
                k = len(stack) - 1
                while stack[k][0] in INLINE:
                    k -= 1
                if stack[k][0] == "p":
                    del stack[k:]
            if name in SIBLINGS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in SIBLINGS[name]:
                        break
                    if stack[k][0] == name or {stack[k][0], name} <= {"dt", "dd"} or {stack[k][0], name} <= {"td", "th"}:
                        del stack[k:]
                        break
            _, around, shut, inside, container, link = stack[-1]
            number += 1
            label, furniture, hint = name, name in OUTSIDE, False
            if m[3].strip():
                for key, *values in ATTRIBUTE.findall(m[3]):
                    key, value = key.lower(), "".join(values).lower()
                    if key in ("class", "id"):
                        if key == "class":
                            label += "." + ".".join(re.findall("[a-z]+", value))
                        hint |= _hints(value, name in ("article", "main"))
                    elif key == "role":
                        furniture |= value in ROLES
                    else:
                        furniture |= key == "hidden" or value == "true"
            if name in ("html", "body"):
                furniture = hint = False  # a page's own class says nothing of its parts
            hint &= number not in opened
            if name in ("article", "main") and not furniture and not hint:
                self.has_article |= not shut
                if shut > 0:
                    self.shuts_article.add(shut)
            if furniture and shut >= 0:
                shut = -1
            elif hint and not shut:
                shut = number
            token = xxh64_intdigest(label, around & (2**64 - 1))
            self.tokens.append((token, around, label, ""))
            if name in VOID or m[3].endswith("/") and name in ("svg", "path", "use"):
                continue
            if name in RAW:
                end = lower.find(f"</{name}", at)
                at = len(source) if end < 0 else end
                stack.append((name, token, -1, inside, container, link))
                continue
            inside = inside or name in ("article", "main")
            if name not in INLINE and name != "p":
                self.outer.append(container)
                container = len(self.outer) - 1
            stack.append((name, token, shut, inside, container, link or name == "a" and not re.fullmatch("h[1-6]", stack[-1][0])))

    def main_text(self, template: set[int]) -> str:
        open_ = [t for t in self.texts if not t[3]]
        kept = [t for t in open_ if t[1] not in template or not t[1]]
        if any(t[4] and t[1] for t in open_):
            kept = [t for t in kept if t[4]]
        else:
            # Lengths summed up to all ancestors; of the elements with the largest sum the innermost. Outer elements have smaller numbers.
            prose = [t for t in kept if t[1] and not t[6]] or [t for t in kept if t[1]]
            size, best, within = [0] * len(self.outer), 0, [False] * len(self.outer)
            for t in prose:
                size[t[5]] += len(t[2])
            for c in range(len(size) - 1, 0, -1):
                size[self.outer[c]] += size[c]
            for c in range(1, len(size)):
                if size[c] == size[0] and self.outer[c] == best:
                    best = c
            for c in range(len(size)):
                within[c] = c == best or c > best and within[self.outer[c]]
            kept = [t for t in kept if within[t[5]]]
        blocks: dict[int, list[str]] = {}
        for t in kept:
            blocks.setdefault(t[0], []).append(t[2])
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(line for line in lines if line)


def _signed(token: int) -> int:
    return token - 2**64 if token >= 2**63 else token


def _sketch(text: str) -> int:
    """A hash of the longest word with its neighbours, which most edits of a text leave alone."""
    from xxhash import xxh64_intdigest

    words = text.split()
    k = words.index(max(words, key=lambda w: (len(w), w)))
    return _signed(xxh64_intdigest(" ".join(words[max(0, k - 1) : k + 2])))


def tokens(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, page, token, around, label, n, at, size, sketch): how often and where first each token stands on a page; the length
    and sketch of a text in an article, else 0."""
    kind = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("around", pa.int64()), ("label", pa.string()), ("n", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("sketch", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                rows = []
                for host, page, source in zip(*(c.to_pylist() for c in part.columns)):
                    seen: dict[int, list] = {0: [host, page, 0, 0, "page", 1, -1, 0, 0]}
                    for k, (token, around, label, words) in enumerate(read_page(source or "").tokens):
                        if token in seen:
                            seen[token][5] += 1
                        else:
                            seen[token] = [host, page, _signed(token), _signed(around), label, 1, k, len(words), _sketch(words) if words else 0]
                    rows += seen.values()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    whole = isinstance(pages.schema[id_col].dataType, T.IntegralType)
    page_ = F.col(id_col).cast("long") if whole else F.xxhash64(id_col)
    return pages.select(host_of(url_col).alias("host"), page_.alias("page"), F.col(html_col).alias("html")).mapInArrow(
        run, "host string, page long, token long, around long, label string, n int, at int, size int, sketch long"
    )


def host_of(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, class, tokens, labels, n_pages, nested_in): the valid equivalence classes of each host."""
    found = saved(tokens(pages, id_col, url_col, html_col))  # three steps below need them; reading pages is the dear part
    vectors = found.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("n_pages"), F.min("around").alias("around"), F.min("label").alias("label"),
        F.max("size").alias("size"), F.max("sketch").alias("sketch"),
    )
    sizes = vectors.where("token = 0").select("host", F.col("n_pages").alias("host_pages"))
    frequent = saved(vectors.where("n_pages > 1").join(sizes, "host").where("2 * n_pages >= host_pages and token <> 0").drop("host_pages"))
    order = (
        found.join(frequent.select("host", "token", "vector"), ["host", "token"])
        .groupBy("host", "vector", "page").agg(F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda s: s["token"])).alias("order"))
        .groupBy("host", "vector").agg(F.min("order").alias("low"), F.max("order").alias("high"))
        .where("low = high").select("host", "vector")
    )
    around_differs = article_template(found.where("size > 0").select("host", "page", "token", "size", "sketch"), frequent.where("size > 0").select("host", "token", "sketch"))
    kept = frequent.join(around_differs.withColumn("differs", F.lit(True)), ["host", "token"], "left").where("size = 0 or differs")
    valid = kept.join(order, ["host", "vector"])
    classes = valid.groupBy("host", "vector").agg(
        F.sort_array(F.collect_list(F.struct("token", "label", "around"))).alias("members"), F.max("n_pages").alias("n_pages")
    )
    around = valid.select("host", F.col("token").alias("outer"), F.col("vector").alias("nested_in"))
    first = F.col("members")[0]["around"]
    return (
        classes.withColumn("outer", first).join(around, ["host", "outer"], "left")
        .select("host", F.col("vector").alias("class"), F.col("members.token").alias("tokens"), F.col("members.label").alias("labels"), "n_pages", "nested_in")
    )


def article_template(inside: DataFrame, frequent: DataFrame) -> DataFrame:
    """(host, token): the ``frequent`` texts in articles that stand among enough distinct contents. ``inside``: all texts in articles."""
    shared = frequent.select("host", "sketch").distinct().withColumn("shared", F.lit(True))
    own = F.col("shared").isNull()
    contents = (
        inside.join(shared, ["host", "sketch"], "left").groupBy("host", "page")
        .agg(F.min(F.when(own, F.col("sketch"))).alias("content"), F.sum(F.when(own, F.col("size"))).alias("new"), F.sum("size").alias("size"))
        .where("10 * new >= size").select("host", "page", "content")
    )
    by_host = contents.groupBy("host").agg(F.count_distinct("content").alias("host_contents"))
    by_token = inside.join(frequent.select("host", "token"), ["host", "token"]).join(contents, ["host", "page"]).groupBy("host", "token").agg(F.count_distinct("content").alias("n_contents"))
    return by_token.join(by_host, "host").where(f"n_contents >= {LEAST_CONTENTS} and 2 * n_contents >= host_contents").select("host", "token")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``pages`` with ``main_text``."""
    passed = [f for f in pages.schema.fields if f.name.lower() != "main_text"]
    host, held = unused(pages, "template_host"), unused(pages, "template_tokens")
    found = saved(templates(pages, id_col, url_col, html_col).select(F.col("host").alias(host), F.explode("tokens").alias("token")))
    by_host = found.groupBy(host).agg(F.collect_list("token").alias(held))
    if found.count() <= most_broadcast:
        by_host = F.broadcast(by_host)
    joined = pages.select(*(f.name for f in passed)).join(by_host, host_of(url_col) == F.col(host), "left").drop(host)

    def run(batches):
        last, template = None, set()
        for batch in batches:
            sources = batch.column(batch.schema.get_field_index(html_col))
            lists = batch.column(batch.schema.get_field_index(held))
            out = []
            for source, tokens_ in zip(sources, lists):
                if (own := tokens_.as_py() or []) != last:
                    last, template = own, {t & (2**64 - 1) for t in own}
                out.append(read_page(source.as_py() or "").main_text(template))
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in passed]
            yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.string())], names=[*(f.name for f in passed), "main_text"])

    return joined.mapInArrow(run, T.StructType([*passed, T.StructField("main_text", T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
