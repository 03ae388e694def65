"""Column expressions for document text, names, keywords and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accent fold of Latin letters.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"
# Boilerplate topics, compared in lower case.
GENERIC_TAGS = ["info:eu-repo", "cti", "classification", "openaccess", "12", "11", "1299", "129999", "110403", "1208", "masterthesis", "doctoralthesis", "bachelorthesis"]


def nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(nz(c)), r"[^\p{L}\p{N}]+"), "")


def fold(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def text_tokens(c: Column, lower: bool = True, accents: bool = True, urls: bool = True, digits: bool = True, ngrams: tuple[int, ...] = (1,)) -> Column:
    """The configurable tokenizer: URLs become ``url``, digit runs ``0``, punctuation is blank; word n-grams."""
    x = nz(c)
    if urls:
        x = F.regexp_replace(x, r"(?U)https?://\S+|www\.\S+", " url ")
    if lower:
        x = F.lower(x)
    if not accents:
        x = fold(x)
    if digits:
        x = F.regexp_replace(x, r"\p{N}+", "0")
    one = F.filter(F.split(x, r"[^\p{L}\p{N}]+"), lambda t: t != "")

    def grams(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return w if n == 1 else F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    if tuple(ngrams) == (1,):
        return one
    return bind(one, lambda w: F.concat(*[grams(w, n) for n in ngrams]))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row: a lambda evaluates what it captures again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def name_swap(c: Column) -> Column:
    """"Last, First" as "First Last", on the first comma, if both sides have text."""
    a, b = F.trim(F.substring_index(c, ",", 1)), F.trim(F.regexp_extract(c, r"(?s)^[^,]*,(.*)$", 1))
    return F.when(c.contains(",") & (a != "") & (b != ""), F.concat_ws(" ", b, a)).otherwise(F.trim(c))


def tag_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_")


def name_key(c: Column) -> Column:
    return tag_key(name_swap(c))


def year_of(c: Column) -> Column:
    """First whole word 1900-2099, or null."""
    return F.regexp_extract(nz(c), r"\b((?:19|20)\d\d)\b", 1).try_cast("int")


# Classes of documents, first that fits.
DOC_TYPES = [
    ("tesis|thesis|dissertation|grado|maestr|doctor", "Tesis"),
    ("art[ií]culo|article|journal|paper|revista", "Artículo"),
    ("libro|book|monograph", "Libro"),
    ("cap[ií]tulo|chapter|secci[oó]n", "Capítulo de Libro"),
    ("reporte|informe|technical report", "Reporte Técnico"),
    ("conferencia|conference|proceedings|ponencia|memorias", "Conferencia / Ponencia"),
]
STATISTICS_TYPES = [
    ("tesis|thesis", "Tesis"),
    ("art[ií]culo|article", "Artículo"),
    ("libro|book", "Libro"),
    ("conferencia|conference|ponencia", "Conferencia / Ponencia"),
]
OTHER_TYPE = "Documento Académico"


def _first_class(c: Column, table: list[tuple[str, str]], pattern: str) -> Column:
    out = F.lit(OTHER_TYPE)
    for words, name in reversed(table):
        out = F.when(nz(c).rlike(pattern.format(words)), F.lit(name)).otherwise(out)
    return out


def doc_type(c: Column) -> Column:
    """Class of a publication type; null is of the last one."""
    return _first_class(c, DOC_TYPES, "(?iU){}")


def statistics_type(c: Column) -> Column:
    """Class of a document in the statistics: by whole words."""
    return _first_class(c, STATISTICS_TYPES, r"(?iU)\b(?:{})\b")


def section_label(c: Column, n: Column) -> Column:
    """Label of a paragraph by its first 150 characters, else its number."""
    head = F.lower(F.substring(nz(c), 1, 150))
    out = F.concat(F.lit("Párrafo #"), n.cast("string"))
    for pattern, name in reversed([("conclusi", "Conclusiones"), ("resumen|abstract", "Resumen"), ("introducci|introduction", "Introducción"), ("metodolog|método|methodolog", "Metodología"), ("resultado|results", "Resultados")]):
        out = F.when(head.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def snippet(description: Column, title: Column, size: int = 300) -> Column:
    d = nz(description)
    return F.when(d == "", nz(title)).when(F.length(d) > size, F.concat(F.substring(d, 1, size), F.lit("..."))).otherwise(d)


def index_text(title: Column, creators: Column, contributors: Column, keywords: Column, description: Column, conclusions: Column) -> Column:
    """Boosted text: title three times, creators and keywords twice, the rest once; empty parts are left out."""

    def part(c: Column, times: int, is_list: bool = True) -> Column:
        x = F.array_join(F.coalesce(c, F.array()), " , ") if is_list else nz(c)
        return F.when(F.trim(x) != "", F.array_join(F.array_repeat(x, times), " . "))

    return F.concat_ws(" \n ", part(title, 3, False), part(creators, 2), part(contributors, 1), part(keywords, 2), part(description, 1, False), part(conclusions, 1, False))


# Headings of the sections that are looked for, and what ends them.
CONCLUSIONS = r"(?isU)\n(?:[0-9IVX\.\s]{0,6})?(conclusi(?:ones|ón)|concluding remarks|conclusions|discusión y conclusiones|conclusiones y recomendaciones)[\s:\.]*\n+(.+?)(?:\n+(?:[0-9IVX\.\s]{0,6})?(?:referencias|bibliograf[ií]a|agradecimientos|anexos|ap[eé]ndice|references|bibliography)|\Z)"
REFERENCES = r"(?isU)\n(?:\d+\.|\b[IVXLCDM]+\b\.?)?\s*(referencias(?:\s+bibliogr[aá]ficas)?|bibliograf[ií]a|references|bibliography|fuentes\s+consultadas)[\s:\.]*\n+(.+?)(?:\n+(?:\d+\.|\b[IVXLCDM]+\b\.?)?\s*(?:anexos|ap[eé]ndice|appendix|ap[eé]ndices)\b|\Z)"
ENTRY = r"\n\s*(?:\[\d+\]|\d+\.|\n)"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def conclusions(c: Column) -> Column:
    """The section under a conclusions heading on a line of its own, up to references, acknowledgements, annexes or the
    end; at most 3500 characters."""
    return F.substring(_stripped(F.regexp_extract(nz(c), CONCLUSIONS, 2)), 1, 3500)


def reference_section(c: Column) -> Column:
    """The block under a references heading on a line of its own, up to annexes or the end."""
    return _stripped(F.regexp_extract(nz(c), REFERENCES, 2))


def split_references(block: Column) -> Column:
    """Entries by [n], n. or a blank line; squeezed; at least 25 characters; no page footers."""
    parts = F.transform(F.split(nz(block), ENTRY), lambda x: _stripped(F.regexp_replace(x, r"(?U)\s+", " ")))
    clean = F.transform(parts, lambda x: F.regexp_replace(x, r"^(?:\[\d+\]|\d+\.|-)\s*", ""))
    return F.filter(clean, lambda x: (F.length(x) >= 25) & ~x.rlike(r"(?iU)^(?:página\s+\d+|page\s+\d+)$"))


def paragraphs(c: Column, least: int = 80, most: int = 1500) -> Column:
    """Greedy packing of blank-line blocks: a block joins while buffer bytes plus its characters stay under ``most``; a
    buffer under ``least`` characters is dropped."""
    blocks = F.transform(F.split(nz(c), r"\n[ \t]*\n|\f"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    blocks = F.filter(blocks, lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    state = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("held"))

    def push(acc: Column) -> Column:
        return F.when(F.length(acc["held"]) >= least, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        fits = F.octet_length(acc["held"]) + F.length(x) < most
        return F.when(fits, F.struct(acc["done"].alias("done"), F.when(acc["held"] == "", x).otherwise(F.concat_ws(" ", acc["held"], x)).alias("held"))).otherwise(F.struct(push(acc).alias("done"), x.alias("held")))

    return F.aggregate(blocks, state, step, push)


def initials_form(c: Column) -> Column:
    """All words but the last as first letters; a single word stays."""
    w = F.filter(F.split(F.trim(nz(c)), r"\s+"), lambda x: x != "")
    return F.when(F.size(w) < 2, F.array_join(w, " ")).otherwise(F.concat_ws(" ", F.array_join(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda x: F.substring(x, 1, 1)), " "), F.element_at(w, -1)))


def qgrams(c: Column, q: int = 4) -> Column:
    s = F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(F.when(F.length(s) < q, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - q + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(q)))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def short_hash(*parts: Column) -> Column:
    """Four digits of the SHA-256 of the parts."""
    return F.lpad((F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 8), 16, 10).cast("long") % 10000).cast("string"), 4, "0")


def doc_key(repo: Column, doc: Column) -> Column:
    return F.concat_ws(":", F.trim(repo.cast("string")), F.trim(doc.cast("string")))


def split_doc_key(key: Column) -> Column:
    return F.split(key, ":", 2)


def keywords(subject: Column) -> Column:
    """Segments at ; | or a line end, with classification URIs as their last part; CTI codes are left as
    ``cti/<code>`` for :func:`folioforge.sources.records.resolve_keywords`."""
    parts = F.transform(F.split(nz(subject), r"[;\n|]"), lambda x: F.trim(x))
    made = F.transform(parts, lambda x: F.when(x.rlike(r"(?i)^info:eu-repo/classification/cti/"), F.concat(F.lit("cti/"), F.regexp_extract(x, r"([^/]*)$", 1))).when(x.rlike(r"(?i)^info:eu-repo/classification/[^/]+/"), F.regexp_extract(x, r"^info:eu-repo/classification/[^/]+/(.*)$", 1)).otherwise(x))
    return F.array_distinct(F.filter(made, lambda x: F.length(x) >= 2))
