"""Fields of list and detail pages, as Column functions over a page's HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgraph.functions.legal import regulation_id
from docgraph.functions.text import once

# The marks by which the pages tell their parts apart.
LABEL_CLASS, VALUE_CLASS = "col-lg-3 fw-bold", "col-lg-9"
NOTES_ID = "abstrak"
CARD, TITLE = ("card-body",), ("fw-semibold", "fs-5")
STATUS = "Status Peraturan"
RELATION, RELATION_KINDS = "fw-bold", ("bg-light-primary", "bg-light-danger")
TARGETS, TARGET_LINK, TARGET_PREFIX = "col-lg-10", "text-danger", "UU "
DETAIL_MARK = "/Details/"
DOWNLOAD_CLASS, DOWNLOAD_HREFS, DOWNLOAD_WORDS = "download-file", ("/Download/", ".pdf", ".doc", "download"), ("Download", "Unduh")


def _open(tag: str, *classes: str) -> str:
    """A pattern of a tag's opening that has all of the classes, in any order."""
    return f"<{tag}" + "".join(rf"(?=[^>]*\b{c}\b)" for c in classes) + "[^>]*>"


def plain(html) -> Column:
    """A fragment's text without tags, white space collapsed; the five named entities read."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(t)


def label_values(html) -> Column:
    """array<struct<key, value>> of the page's label and value rows, keys as lower-case names; rows that lack either are left out."""
    pattern = rf'(?is)<div[^>]*class="{LABEL_CLASS}"[^>]*>(.*?)</div>\s*<div[^>]*class="{VALUE_CLASS}"[^>]*>(.*?)</div>'
    key = lambda x: F.lower(F.replace(F.trim(F.regexp_replace(plain(x), r"[^\w\s]", "")), F.lit(" "), F.lit("_")))
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("v"))
    pairs = F.transform(pairs, lambda p: F.struct(key(p["k"]).alias("key"), plain(p["v"]).alias("value")))
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def notes(html, label: str) -> Column:
    """What the notes' table says under a label, its rows joined by ' | '; 'N/A' if nothing."""
    table = F.regexp_extract(html, rf'(?is)<div[^>]*id="{NOTES_ID}"[^>]*>.*?<table[^>]*>(.*?)</table>', 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), plain)
    mine = F.filter(F.transform(rows, cells), lambda c: F.upper(F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))).startswith(label))
    said = F.filter(F.flatten(F.transform(mine, lambda c: F.slice(c, 2, F.greatest(F.size(c), F.lit(1))))), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(said, " | "), F.lit("")), F.lit("N/A"))


def _absolute(href, base: str) -> Column:
    return F.when(href.rlike(r"^https?://"), href).otherwise(F.concat(F.lit(base), F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href))))


def downloads(html, base: str) -> Column:
    """The distinct absolute links to files: by the link's class, then by each sign in its address, then by each word in its text."""
    a = r'(?is)<a\b([^>]*)>(.*?)</a>'
    links = F.arrays_zip(F.regexp_extract_all(html, F.lit(a), F.lit(1)).alias("at"), F.regexp_extract_all(html, F.lit(a), F.lit(2)).alias("text"))
    links = F.transform(links, lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text"), F.regexp_extract(x["at"], r"""(?i)href\s*=\s*["']([^"']+)["']""", 1).alias("href")))
    links = F.filter(links, lambda x: x["href"] != "")

    def files(links):
        some = [F.filter(links, lambda x: x["at"].rlike(rf'class="[^"]*\b{DOWNLOAD_CLASS}\b'))]
        for sign in DOWNLOAD_HREFS:
            some.append(F.filter(links, _has("href", sign)))
        for word in DOWNLOAD_WORDS:
            some.append(F.filter(links, _has("text", word)))
        return F.flatten(F.array(*some))

    return F.array_distinct(F.transform(once(links, files), lambda x: _absolute(x["href"], base)))


def _has(field: str, sign: str):
    return lambda x: x[field].contains(sign)


def detail_links(html, base: str) -> Column:
    """The distinct absolute links to detail pages, in order."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return F.array_distinct(F.transform(F.filter(hrefs, lambda h: h.contains(DETAIL_MARK)), lambda h: _absolute(h, base)))


def amendment_list(html) -> Column:
    """array<struct<source, relationship, target>> of a list page: each card's law, and under its status the laws of each relation."""
    after_first = lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))
    cards = once(F.split(html, "(?i)" + _open("div", *CARD)), after_first)
    kinds = "|".join(RELATION_KINDS)
    relation = rf"(?i)(?=<div(?=[^>]*\b{RELATION}\b)(?=[^>]*\b(?:{kinds})\b)[^>]*>)"

    def of_relation(source):
        def of(part):
            return once(name_of(part), lambda name: targets_of(part, name))

        def name_of(part):
            return F.replace(F.lower(plain(F.regexp_extract(part, rf"(?is)^<div[^>]*>(.*?)</div>", 1))), F.lit(" "), F.lit("_"))

        def targets_of(part, name):
            links = F.regexp_extract_all(F.regexp_extract(part, f"(?is){_open('div', TARGETS)}(.*)", 1), F.lit(f"(?is){_open('a', TARGET_LINK)}(.*?)</a>"), F.lit(1))
            said = F.filter(F.transform(links, plain), lambda x: x.startswith(TARGET_PREFIX))
            targets = F.transform(said, regulation_id)
            return F.transform(F.filter(targets, lambda x: x.isNotNull()), lambda x: F.struct(source.alias("source"), name.alias("relationship"), x.alias("target")))

        return of

    def of_card(card):
        return once(regulation_id(plain(F.regexp_extract(card, f"(?is){_open('div', *TITLE)}(.*?)</div>", 1))), lambda source: of_law(card, source))

    def of_law(card, source):
        parts = once(F.split(F.regexp_extract(card, f"(?is){STATUS}(.*)", 1), relation), after_first)
        found = F.flatten(F.transform(parts, of_relation(source)))
        return F.when(source.isNotNull(), found).otherwise(F.array().cast("array<struct<source:string,relationship:string,target:string>>"))

    return F.flatten(F.transform(cards, of_card))
