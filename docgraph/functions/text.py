"""Text rules as Column functions. All are null-safe where the rule says so, and stay in the JVM unless named otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that hint at Indonesian or English, and words that count for one or the other.
HINT_ID = r"\b(pasal|undang[- ]?undang|uu\s*\d|peraturan|menteri|ayat|bab|bagian|paragraf|ketentuan|sebagaimana|dimaksud)\b"
HINT_EN = r"\b(article|act|law|regulation|minister|section|paragraph|chapter|pursuant|provided that)\b"
WORDS_ID = ["yang", "dan", "atau", "tidak", "adalah", "berdasarkan", "sebagaimana", "pada", "dalam", "dapat", "harus", "wajib", "pasal", "undang", "peraturan", "menteri", "ayat", "bab", "bagian", "paragraf", "ketentuan", "pengundangan", "apabila", "jika"]
WORDS_EN = ["the", "and", "or", "not", "is", "based", "as", "provided", "pursuant", "in", "may", "must", "shall", "article", "act", "law", "regulation", "minister", "section", "paragraph", "chapter", "whereas"]
# What makes an answer look specific, and the router's cues.
CITATION_CUES = [r"\bpasal\b", r"\buu\b", r"\barticle\b", r"\bsection\b", r"\bperaturan\b", r"\b\d{4}\b"]
REFERENCE_CUES = [r"\b(pasal|ayat|uu|undang[- ]?undang|peraturan|bab|bagian)\b", r"\b(article|section|chapter|act|law|regulation)\b", r"\bpasal\s+\d+", r"\barticle\s+\d+", r"\[\d+\]"]
NUMBER_CUE = r"\b\d{1,3}(?:\.\d+)?\b"
ROUTER_CITATION = r"\b(uu|undang[- ]?undang|pasal|ayat|article|section|pp|perda|permen|no\.)\b"
ROUTER_DEFINE = r"\b(bunyi|kutip|definisi|ringkas|quote|define|apa itu)\b"
ROUTER_MULTI_HOP = r"\b(hubungan|perbedaan|pengecualian|mendelegasikan|mengubah|mencabut|berlaku|berlaku untuk|dibandingkan|apakah .* mengatur)\b"


def once(value, use) -> Column:
    """use(value), with the value found once a row however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stripped(s) -> Column:
    """Without white space at both ends (any, not spaces only)."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def slug(s) -> Column:
    """White space collapsed, trimmed, lower case; null counts as empty."""
    return F.lower(stripped(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " ")))


def predicate(s, default: str = "rel") -> Column:
    """Lower case, hyphens and spaces to underscores, other signs dropped; nothing left gives the default."""
    p = F.translate(F.lower(stripped(F.coalesce(s, F.lit("")))), "- ", "__")
    return F.coalesce(F.nullif(F.regexp_replace(p, r"[^a-z0-9_]", ""), F.lit("")), F.lit(default))


def label(s) -> Column:
    """Lower case, each run of signs one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def file_name_part(s) -> Column:
    x = F.regexp_replace(F.translate(F.lower(stripped(F.coalesce(s, F.lit("")))), " ", "-"), r"[^a-z0-9_\-+]", "")
    return F.coalesce(F.nullif(F.regexp_replace(x, r"-{2,}", "-"), F.lit("")), F.lit("unknown"))


def error_file_name(kind: str, law: str, page: str, chunk: str) -> Column:
    """An aggregate: the name under which a failed batch of chunks of one law is kept, without the time of writing."""
    pages = F.concat(F.min(page).cast("string"), F.when(F.min(page) < F.max(page), F.concat(F.lit("-"), F.max(page).cast("string"))).otherwise(""))
    short = F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(chunk)), "|")), 1, 8)
    parts = [F.concat(F.lit("uu-"), file_name_part(F.min(law))), F.concat(F.lit("p-"), pages), F.lit("batch"), F.count("*").cast("string"), short]
    return F.concat(F.lit(f"[ERROR {re.sub('[^a-z0-9]+', '_', kind.lower())}] "), F.concat_ws("__", *parts), F.lit(".json"))


def tokens_at_index(s) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(s) / 3.5)).cast("long")


def tokens_at_query(s) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(s) / 4)).cast("long")


def tokens_whole(s) -> Column:
    return F.ceil(F.length(s) / 3.5).cast("long")


def clamp_unit(x, default: float = 0.5) -> Column:
    """A number into [0, 1]; what is none gives the default."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.try_cast("double"), F.lit(default))))


def clamp_chars(s, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def first_words(s, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(s, r"\s+"), lambda w: w != ""), 1, n), " ")


def _known_words(t) -> tuple[Column, Column]:
    words = F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0))
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    return count(WORDS_ID), count(WORDS_EN)


def language(s) -> Column:
    """'id' or 'en': strong hints first, then which list has more of the words; a tie is 'en'."""
    t = F.lower(F.coalesce(s, F.lit("")))
    local, english = _known_words(t)
    return F.when(t.rlike(HINT_ID), "id").when(t.rlike(HINT_EN), "en").when(local > english, "id").otherwise("en")


def language_confidence(s) -> Column:
    """How sure `language` is: 0.9 by a hint, 0.6 by more words, 0.5 for a tie."""
    t = F.lower(F.coalesce(s, F.lit("")))
    local, english = _known_words(t)
    return F.when(t.rlike(HINT_ID) | t.rlike(HINT_EN), 0.9).when(local != english, 0.6).otherwise(0.5)


def looks_corrupted(s) -> Column:
    """Empty, a replacement character, over a tenth unprintable, over 45 % neither letters, digits nor space, or over 5 % glued words."""
    n = F.length(s)
    share = lambda pattern: F.length(F.regexp_replace(s, pattern, "")) / F.greatest(n, F.lit(1))
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    long_words = F.size(F.filter(words, lambda w: F.length(w) >= 30)) / F.greatest(F.size(words), F.lit(1))
    return F.coalesce((n == 0) | s.contains("�") | (share(r"[^\p{C}\p{Z}]|\x20") > 0.10) | (share(r"[\p{L}\p{N}\s]") > 0.45) | (long_words > 0.05), F.lit(True))


def citation_score(s) -> Column:
    t = F.lower(F.coalesce(s, F.lit("")))
    return sum((F.regexp_count(t, F.lit(p)) for p in CITATION_CUES[1:]), F.regexp_count(t, F.lit(CITATION_CUES[0]))).cast("long")


def route(s) -> Column:
    """'naiverag' for a citation to quote or define, 'graphrag' for many hops or many names; else by whether it cites."""
    q = F.lower(F.coalesce(s, F.lit("")))
    cites, defines, hops = q.rlike(ROUTER_CITATION), q.rlike(ROUTER_DEFINE), q.rlike(ROUTER_MULTI_HOP)
    names = F.regexp_count(F.coalesce(s, F.lit("")), F.lit(r"\b[A-Z][a-zA-Z0-9_]+\b"))
    return F.when(cites & defines & ~hops, "naiverag").when(hops | (names >= 3), "graphrag").when(cites, "naiverag").otherwise("graphrag")


def reference_score(s) -> Column:
    """Mentions of provisions and numbered sources, and a quarter of the short numbers."""
    t = F.lower(F.coalesce(s, F.lit("")))
    cues = sum((F.regexp_count(t, F.lit(p)) for p in REFERENCE_CUES[1:]), F.regexp_count(t, F.lit(REFERENCE_CUES[0])))
    return (cues + F.floor(F.regexp_count(t, F.lit(NUMBER_CUE)) / 4)).cast("long")


def decision(s) -> Column:
    """A router's decision under its full name."""
    return F.regexp_replace(F.lower(stripped(s)), "^(naive|graph)(rag)?(_fallback)?$", "$1rag$3")


def base_decision(d) -> Column:
    """A decision with its fallback counted in."""
    return F.when(d.contains("graph"), "graphrag").when(d.contains("naive"), "naiverag").otherwise(d)


def human_size(n) -> Column:
    """Bytes as B, or with two decimals as KB to PB."""
    out, units = None, ["KB", "MB", "GB", "TB", "PB"]
    for k, unit in reversed(list(enumerate(units, 1))):
        here = F.format_string(f"%.2f {unit}", F.bround(n / F.lit(float(1024**k)), 2))
        out = here if out is None else F.when(n < 1024 ** (k + 1), here).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


# How durations and answers' letters are written.
MINUTES_SECONDS, SECONDS = r"(\d+)\s*m\s*(\d+\.?\d*)\s*s", r"^(\d+\.?\d*)\s*s$"
LETTER_ALONE, LETTER = r"\b([ABCD])\b", r"([ABCD])"


def choice_letter(s) -> Column:
    """The first letter A to D that stands alone, else the first at all; upper-cased; null if none."""
    u = F.upper(F.coalesce(s, F.lit("")))
    return F.coalesce(F.nullif(F.regexp_extract(u, LETTER_ALONE, 1), F.lit("")), F.nullif(F.regexp_extract(u, LETTER, 1), F.lit("")))


def duration_seconds(s) -> Column:
    """'1m 44.83s' or '30.5 s' in seconds; null otherwise. Hours are not read."""
    t = stripped(s)
    minutes, seconds = (F.regexp_extract(t, MINUTES_SECONDS, k).try_cast("double") for k in (1, 2))
    return F.coalesce(minutes * 60 + seconds, F.regexp_extract(t, SECONDS, 1).try_cast("double"))


def format_seconds(x) -> Column:
    m = F.floor(x / 60)
    return F.when(x.isNull(), "N/A").when(m > 0, F.format_string("%dm %.2fs", m, x - 60 * m)).otherwise(F.format_string("%.2fs", x))


def page_numbers(s) -> Column:
    """The distinct integers in a list such as '3-5, 7', ascending: a range gives its ends."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))))


def text_and_ocr(text, ocr) -> Column:
    """Both with a line break between, or the one that is not empty."""
    return F.concat_ws("\n", F.nullif(text, F.lit("")), F.nullif(ocr, F.lit("")))


def delimited(s, mark: str = ";") -> Column:
    return F.filter(F.transform(F.split(s, mark), stripped), lambda x: x != "")


def rate_limit_kind(message) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.rlike("quota|billing"), "quota").when(m.rlike("rate|too many requests|exhausted"), "rpm").otherwise("unknown")


def content_sha(s) -> Column:
    return F.sha2(F.coalesce(s, F.lit("")), 256)


def chunk_key(base, text) -> Column:
    return F.concat_ws("::", base, F.substring(content_sha(text), 1, 12))
