"""Law references, entity keys and dates as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgraph.functions.text import stripped

# The ontology's types by base label, predicates of change, and month names.
DOCUMENT_TYPES = ["Constitution", "AmendmentToTheConstitution", "PeoplesConsultativeAssemblyResolution", "Act", "GovernmentRegulationInLieuOfAct", "GovernmentRegulation", "PresidentialRegulation", "PresidentialDecree", "PresidentialInstruction", "MinisterialRegulation", "MinisterialDecision", "MinisterialInstruction", "ProvincialRegulation", "RegencyRegulation", "MunicipalRegulation", "VillageRegulation"]
CONTENT_TYPES = ["Chapter", "Part", "Paragraph", "Article", "Section", "Item"]
RULE_TYPES = ["Norm", "RuleAct", "Concept", "CompoundExpression", "AndExpression", "OrExpression", "XorExpression"]
AMENDMENT_TYPES = ["LawAmendment", "LawAddition", "LawModification", "LawDeletion"]
BASES = {"LegalDocument": DOCUMENT_TYPES, "LegalDocumentContent": CONTENT_TYPES, "RuleExpression": RULE_TYPES, "LawAmendment": AMENDMENT_TYPES}
AMENDS = ["amends", "mengubah", "diubah"]
REPEALS = ["repeals", "mencabut", "dicabut", "tidak_berlaku"]
CHANGE_PREDICATES = ["amends", "amended_by", "repeals", "mengubah", "diubah", "mencabut", "dicabut", "tidak_berlaku", "modifies", "adds", "deletes", "law_modification", "law_addition", "law_deletion", "mengubah_ketentuan", "menambahkan", "menyisipkan", "menghapus"]
PASSIVE = {"mengubah": "diubah_dengan", "mengubah_sebagian": "diubah_sebagian_dengan", "mencabut": "dicabut_dengan", "mencabut_sebagian": "dicabut_sebagian_dengan"}
MONTHS = {
    1: ["januari", "january", "jan"], 2: ["februari", "february", "feb"], 3: ["maret", "march", "mar"], 4: ["april", "apr"], 5: ["mei", "may"], 6: ["juni", "june", "jun"],
    7: ["juli", "july", "jul"], 8: ["agustus", "august", "agu", "agt", "aug"], 9: ["september", "sept", "sep"], 10: ["oktober", "october", "okt", "oct"], 11: ["november", "nov"], 12: ["desember", "december", "des", "dec"],
}


def base_label(kind) -> Column:
    out = kind
    for base, kinds in BASES.items():
        out = F.when(kind.isin([base, *kinds]), base).otherwise(out)
    return out


def entity_key(text, kind, law) -> Column:
    """type::name, with the law's number for documents (instead of the name), contents and amendments."""
    name = F.regexp_replace(F.regexp_replace(F.lower(stripped(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}_\s-]", ""), r"\s+", "-")
    number = F.concat(F.lit("uu-"), F.replace(F.nullif(law, F.lit("")), F.lit("/"), F.lit("-")))
    base = base_label(kind)
    rest = F.when((base == "LegalDocument") & number.isNotNull(), number).when((base == "LegalDocumentContent") & number.isNotNull(), F.concat_ws("::", number, name)).when(base == "LawAmendment", F.concat_ws("-", number, name)).otherwise(name)
    return F.concat_ws("::", kind, rest)


def node_text(name, kind) -> Column:
    """What is embedded for a node."""
    return F.concat(stripped(F.coalesce(name, F.lit(""))), F.lit(" | "), kind)


def triple_text(subject, pred, obj, law, article) -> Column:
    """What is embedded for a triple; a missing law or article is empty."""
    none = F.lit("")
    return F.concat(subject, F.lit(" ["), pred, F.lit("] "), obj, F.lit(" | "), F.coalesce(law, none), F.lit(" | "), F.coalesce(article, none))


def triple_uid(subject, pred, obj, document=None, start=None, end=None) -> Column:
    none = F.lit("")
    parts = [subject, F.translate(F.lower(stripped(F.coalesce(pred, none))), " ", "_"), obj, *(F.coalesce(x.cast("string"), none) if x is not None else none for x in (document, start, end))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def _date(y, m, d) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.try_cast("int"), m.try_cast("int"), d.try_cast("int")), "yyyy-MM-dd")


def _month(name) -> Column:
    out = F.lit(None).cast("int")
    for k, names in MONTHS.items():
        out = F.when(F.lower(name).isin(names), k).otherwise(out)
    return out


# How dates, the wish for the present law, and laws' numbers are written.
DAY_NAME_YEAR = r"\b(\d{1,2})\s+([A-Za-z.]+)\s+(\d{4})\b"
DAY_MONTH_YEAR = r"\b(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})\b"
YEAR_MONTH_DAY = r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"
PRESENT = r"\b(latest|current|today|now|terkini|terbaru|paling\s+baru|sekarang)\b"
AS_OF_DAY = r"\b(?:per|as of|per\s*tanggal|per\s*tgl)\b((?s:.{0,50}))"
SHORT_NUMBER = r"\buu\s*([0-9]{1,4}\s*/\s*[0-9]{4})\b"
FULL_NUMBER = r"(?:undang[- ]?undang|uu)\s*(?:nomor|no\.?)\s*([0-9]{1,4})\s*tahun\s*([0-9]{4})"
REGULATION = r"(?:Nomor|No\.)\s+(\d+)\s+Tahun\s+(\d+)"


def parse_date(s) -> Column:
    """The first readable of '1 Januari 2020', '01-02-20' (20xx) and '2020-01-31'; an invalid date falls to the next."""
    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    a, b, c = DAY_NAME_YEAR, DAY_MONTH_YEAR, YEAR_MONTH_DAY
    year = part(b, 3).try_cast("int")
    return F.coalesce(
        F.when(s.rlike(a), _date(part(a, 3), _month(part(a, 2)), part(a, 1))),
        F.when(s.rlike(b), _date(F.when(year < 100, year + 2000).otherwise(year), part(b, 2), part(b, 1))),
        F.when(s.rlike(c), _date(part(c, 1), part(c, 2), part(c, 3))),
    )


def as_of(query, today) -> Column:
    """struct(mode, day): 'latest' words win, then a date within 50 characters of 'per' or 'as of', then any date, else today."""
    q = F.lower(F.coalesce(query, F.lit("")))
    near = parse_date(F.regexp_extract(q, AS_OF_DAY, 1))
    day = F.when(q.rlike(PRESENT), F.lit(None)).otherwise(F.coalesce(near, parse_date(q)))
    return F.struct(F.when(day.isNull(), "latest").otherwise("as_of").alias("mode"), F.coalesce(day, today).alias("day"))


def law_number(s) -> Column:
    """'X/YYYY' from 'UU 4/2009' or 'Undang-undang Nomor 4 Tahun 2009'; null if neither."""
    t = F.lower(F.coalesce(s, F.lit("")))
    short = F.replace(F.regexp_extract(F.translate(t, "-", " "), SHORT_NUMBER, 1), F.lit(" "))
    full = F.concat_ws("/", F.regexp_extract(t, FULL_NUMBER, 1), F.regexp_extract(t, FULL_NUMBER, 2))
    return F.coalesce(F.nullif(short, F.lit("")), F.when(t.rlike(FULL_NUMBER), full))


def regulation_id(s) -> Column:
    """'N_Y' from 'Nomor N Tahun Y' or 'No. N Tahun Y'."""
    return F.when(s.rlike(REGULATION), F.concat_ws("_", F.regexp_extract(s, REGULATION, 1), F.regexp_extract(s, REGULATION, 2)))


def law_names(number, year) -> Column:
    """Both long forms under which a law is filed."""
    return F.array(*[F.concat(F.lit(f"Undang-undang (UU) {w} "), number.cast("string"), F.lit(" Tahun "), year.cast("string")) for w in ("Nomor", "No.")])
