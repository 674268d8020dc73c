"""HTML extraction by equivalence-class template deduction.

A page is read as tokens: each element is a token of its path, and each block
of text is a token of its path and words. Over the pages of a host every token
has an occurrence vector: how often it is on each page. Tokens with the same
vector form an equivalence class. A class is valid if it has ``MIN_SIZE`` tokens
and its tokens are on ``SUPPORT`` of the pages; it is nested in the class of the
nearest element of a valid class around it. Together they are the host's
template: the texts of valid classes are repeated and no content, and their
elements are the slots that content may stand in.

A slot has one label for the whole host: aside if most of its occurrences lead
through a menu, header, footer, sidebar, notice, advert, form, script, style or
reader comment, main if most stand in an article, else plain. A block of text
belongs to the innermost slot around it and is main text if that slot is in a
main one and in none aside; a host without main slots has its text in the plain
ones. What stands in elements of no valid class below its slot (optional ones)
is labelled by the page itself, and so are hosts without a template and pages
that leave all main slots empty.

Vectors are never gathered: a vector is known by a fingerprint, a sum over
pages of hash(page) * count, so that Spark adds it up before and after the
shuffle, token by token, however large a host is.

Defined cases: NULL and empty html give an empty text; a page without url
belongs to the host ''; broken markup is read as far as it goes (an unclosed
element ends with its parent); equal pages count apart for a template, which
needs ``MIN_PAGES`` pages; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

MIN_PAGES = 10
SUPPORT = 0.8
MIN_SIZE = 2  # tokens of a valid class
MAX_BROADCAST = 50_000  # hosts whose templates are broadcast; more are shuffled

# Element names and the words of class, id and role that tell what an element is for.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "canvas", "title", "select"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label", "head", "datalist", *RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
HINTS = re.compile(
    r"^(?:nav|navbar|navigation|menu\d*|topbar|sidebar|side|aside|footer|foot|header|masthead|ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion"
    r"|cookie|cookies|consent|gdpr|notice|notices|notification|alert|warning|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended"
    r"|comment|comments|commentlist|reply|replies|respond|disqus|discussion|breadcrumb|breadcrumbs|pagination|pager|widget|toolbar|skip|copyright)$"
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPLIT = re.compile(r"[\s_\-:./]+|(?<=[a-z])(?=[A-Z])")


def _aside(name: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is beside the content by its name or attributes, and its name in paths."""
    if name in ASIDE:
        return True, name
    if not attributes:
        return False, name
    beside, label = False, name
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key == "role":
            beside |= value.lower() in ROLES
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            beside = True
        elif value:
            label += "." + value.split()[0] if value.split() else ""
            beside |= any(HINTS.match(w.lower()) for w in SPLIT.split(value))
    return beside, label


def blocks(page: str | None, opened: list[tuple[str, bool, bool]] | None = None) -> list[tuple[str, str, bool, bool]]:
    """(path, text, beside, in main) of each block of text of a page, in order; white space is one space, references are decoded.

    ``opened`` receives (path, beside, in main) of each element.
    """
    page = page or ""
    out: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, path, beside, in main
    text: list[str] = []
    at, skip = 0, None

    def flush() -> None:
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            _, path, beside, in_main = stack[-1] if stack else ("", "", False, False)
            out.append((path, words, beside, in_main))

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and skip is None:
            text.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            if m.group().startswith("<![CDATA["):
                text.append(m.group()[9:-3])
            continue
        closing, attributes = m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if name not in INLINE:
            flush()
        elif name in ("br", "wbr"):
            text.append(" " if name == "br" else "")
        if name in VOID or name in INLINE and not _special(attributes):
            if name in INLINE and closing and any(n == name for n, *_ in stack[-1:]):
                flush()
                stack.pop()
            continue
        if closing:
            names = [n for n, *_ in stack]
            if name in names:
                del stack[len(names) - 1 - names[::-1].index(name) :]
            continue
        if name in INLINE:
            flush()
        if name == "p" or name in ("li", "td", "th", "tr", "dt", "dd", "option"):
            _close_same(stack, name)
        if name in MAIN:
            while stack and stack[-1][0] in ASIDE:  # an unclosed menu or header does not hold the content
                stack.pop()
        beside, label = _aside(name, attributes)
        _, path, outer, in_main = stack[-1] if stack else ("", "", False, False)
        if not attributes.rstrip().endswith("/"):
            stack.append((name, f"{path}/{label}", outer or beside, in_main or name in MAIN and not outer))
            if opened is not None:
                opened.append(stack[-1][1:])
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.start() if end else len(page)
            if not end:
                break
    if at < len(page):
        text.append(entities.unescape(page[at:]))
    flush()
    return out


def _special(attributes: str) -> bool:
    return bool(attributes) and _aside("span", attributes)[0]


def _close_same(stack: list, name: str) -> None:
    """A new paragraph, list item or cell ends an open one of its kind, but not one outside of a list or table."""
    wall = {"p": {"div", "section", "article", "main", "body", "td", "th", "li", "blockquote"}}.get(name, {"ul", "ol", "table", "dl", "select"})
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            del stack[i:]
            return
        if stack[i][0] in wall:
            return


def token_id(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}") - 2**63


def extract(page: str | None, template: frozenset[int]) -> str:
    """The main text: blocks of the article's slots, or, without one, of all slots, that the template does not repeat."""
    found = [b for b in blocks(page) if not b[2]]
    inside = [b for b in found if b[3]]
    return "\n".join(t for p, t, _, in_main in inside or found if token_id(p, t) not in template)


def around(path: str) -> list[str]:
    """The paths of the elements around and at ``path``, outermost first."""
    return [path[:i] for i, c in enumerate(path) if c == "/" and i] + [path] if path else []


def extract_slots(page: str | None, template: frozenset[int], slots: dict[str, str]) -> str:
    """The main text by the slots (path to label) of a host."""
    has_main = "main" in slots.values()
    out = []
    for path, text, beside, in_main in blocks(page):
        labels = {slots[p] for p in around(path) if p in slots}
        own = path not in slots  # an optional element
        if "aside" in labels or own and beside or has_main and "main" not in labels and not (own and in_main):
            continue
        out.append((path, text))
    return "\n".join(t for p, t in out if token_id(p, t) not in template) if out else extract(page, template)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def tokens(pages: DataFrame) -> DataFrame:
    """(host, page, token, path, is_text, n, beside, in_main): how often each token is on each page, and how often so beside the content and in an article."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, p, page in zip(batch["host"], batch["page_id"], batch["html"], strict=True):
                seen: dict[tuple[str, str, bool], list[int]] = {}
                key = xxhash.xxh64_intdigest(f"{p}") >> 20
                opened: list[tuple[str, bool, bool]] = []
                found = blocks(page, opened)
                for path, text, is_text, beside, in_main in [*((p, t, True, b, m) for p, t, b, m in found), *((p, "", False, b, m) for p, b, m in opened)]:
                    n = seen.setdefault((path, text, is_text), [0, 0, 0])
                    n[0] += 1
                    n[1] += beside
                    n[2] += in_main
                rows += [(h, key, token_id(path, text), path, is_text, *n) for (path, text, is_text), n in seen.items()]
            yield pd.DataFrame(rows, columns=["host", "page", "token", "path", "is_text", "n", "beside", "in_main"])

    return pages.select(host(F.col("url")).alias("host"), "page_id", "html").mapInPandas(run, "host string, page long, token long, path string, is_text boolean, n long, beside long, in_main long")


def deduce_templates(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT, min_size: int = MIN_SIZE) -> DataFrame:
    """(host, class, parent_class, pages, tokens, texts, paths, slots): the valid equivalence classes of each host.

    class is the fingerprint of its occurrence vector; parent_class that of the
    class of the nearest enclosing element of another valid class (NULL at the
    root), of the outermost of its tokens; texts are the token ids of the
    repeated blocks of text, slots the (path, label) of the elements.
    """
    weight = F.col("page").cast("decimal(14,0)") * F.col("n").cast("decimal(10,0)")
    counted = (
        tokens(pages)
        .groupBy("host", "token", "path", "is_text")
        .agg(F.count("*").alias("pages"), F.sum(weight).alias("vector"), F.sum("n").alias("n"), F.sum("beside").alias("beside"), F.sum("in_main").alias("in_main"))
        .where(F.col("pages") >= min_pages * support)
    )
    sizes = pages.groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("of"))
    frequent = counted.join(sizes, "host").where((F.col("of") >= min_pages) & (F.col("pages") >= support * F.col("of")))
    frequent = stash(frequent.withColumn("class", F.xxhash64("pages", "vector")), "frequent")
    large = frequent.groupBy("host", "class").agg(F.count("*").alias("tokens")).where(F.col("tokens") >= min_size)
    valid = frequent.join(large, ["host", "class"])
    parts = F.split("path", "/")
    outer = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    holder = valid.where(~F.col("is_text")).select("host", F.col("path").alias("outer"), F.col("class").alias("outer_class"))
    # an enclosing element of the same class is no parent: tokens of a class are side by side or in one another
    within = valid.select("host", "class", "token", F.size(parts).alias("depth"), F.explode(outer).alias("outer")).join(holder, ["host", "outer"]).where("outer_class <> class")
    parents = within.groupBy("host", "class").agg(F.min_by("outer_class", F.struct("depth", -F.length("outer"), "token")).alias("parent_class"))
    label = F.when(2 * F.col("beside") >= F.col("n"), "aside").when(2 * F.col("in_main") >= F.col("n"), "main").otherwise("plain")
    classes = valid.groupBy("host", "class").agg(
        F.max("pages").alias("pages"),
        F.count("*").alias("tokens"),
        F.collect_list(F.when(F.col("is_text"), F.col("token"))).alias("texts"),
        F.collect_set("path").alias("paths"),
        F.collect_list(F.when(~F.col("is_text"), F.struct("path", label.alias("label")))).alias("slots"),
    )
    return classes.join(parents, ["host", "class"], "left").select("host", "class", "parent_class", "pages", "tokens", "texts", "paths", "slots")


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT, min_size: int = MIN_SIZE) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    found = deduce_templates(pages, min_pages, support, min_size)
    whole = found.groupBy("host").agg(F.flatten(F.collect_list("texts")).alias("template"), F.flatten(F.collect_list("slots")).alias("slots"))
    templates = stash(whole.select(F.col("host").alias("t_host"), "template", F.col("slots.path").alias("paths"), F.col("slots.label").alias("labels")), "templates")
    small = templates.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    joined = pages.select("page_id", "url", "html").join(F.broadcast(templates) if small else templates, host(F.col("url")) == F.col("t_host"), "left")

    def read(page: str | None, template: list | None, paths: list | None, labels: list | None) -> str:
        return extract(page, frozenset()) if template is None else extract_slots(page, frozenset(template), dict(zip(paths, labels, strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [read(*row) for row in zip(batch["html"], batch["template"], batch["paths"], batch["labels"], strict=True)]
            yield batch[["page_id", "url"]].assign(text=text, n_chars=[len(t) for t in text])

    return joined.select("page_id", "url", "html", "template", "paths", "labels").mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
