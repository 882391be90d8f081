"""Text functions of columns: stripping, line predicates, numbering, markers, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataleaf.functions.binding import let

# White space as Python's str methods see it, as the body of a Java regex class.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as characters: trimming by them looks at a text's ends alone.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"

# Patterns of headings, numbering and running lines.
NUMBERING = r"(?i)^((?:\d+\.){1,5}\d*\.?\s+|[A-Z]\.\s+|\([a-zA-Z\d]+\)\s+|(?:Chapter|Section|Part|Appendix|Article)\s+[\dA-Z]+)"
NUMBERING_KEYWORD = r"(?i)^(?:Chapter|Section|Part|Appendix|Article)\s+([\dA-Z]+)"
NUMBERING_PREFIX = r"(?i)^((?:\d+\.){1,5}\d*\.?\s+|[A-Z]\.\s+|\([a-zA-Z\d]+\)\s+|(?:Chapter|Section|Part|Appendix)\s+[\dA-Z]+[:\.\s]+)"
RULE_IDENTIFIER = (
    r"^([A-Z]{2,8}(?:\s+\d+(?:\.\d+){0,4}[A-Za-z]?){1,3}\s*[RGECPS]?\s*$"
    r"|(?:Article|Section|Clause|Rule|Regulation|Schedule|Annex|Appendix|Part|Paragraph|Sub-paragraph|Chapter|Point)\s+[\dA-Z][\w.\-()]*\s*$"
    r"|\(?\d{1,4}\)?(?:\([a-z]{1,3}\))?\s*$"
    r"|§\s*[\d]+(?:\([a-z\d]+\))*\s*$"
    r"|[ivxlcdmIVXLCDM]{1,6}\.?\s*$)"
)
MONTH_YEAR = r"(?i)^(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}$"
PAGE_NUMBER = r"^\s*-?\s*\d{1,4}\s*-?\s*$"
PAGE_OF_LOOSE = r"(?i)^\s*Page\s+\d+\s+(of\s+\d+)?\s*$"
PAGE_OF = r"(?i)^Page\s+\d+\s+of\s+\d+$"
ROMAN_LINE = r"(?i)^\s*[ivxlcdm]{1,8}\s*$"
ROMAN_PAGE = r"(?i)^(x{0,3})(ix|iv|v?i{0,3})$"
MARKER = r"\{\{IMG:([^|}]*)\|([^|}]*)\|([^}]*)\}\}"
FIGURE_LABEL = r"(?i)(fig(?:ure)?\.?\s*\d+(?:\.\d+)?|table\s*\d+(?:\.\d+)?)"
TABLE_CAPTION = r"(?i)(table\s*\d+[\.:)]?|exhibit\s*\d+[\.:)]?|tbl\.?\s*\d+)"

# Words that speak for a type of document.
KEYWORDS = {
    "legal": ("regulation", "shall", "must", "compliance", "authorisation", "pursuant", "statutory", "provision", "article", "directive"),
    "academic": ("abstract", "introduction", "methodology", "references", "bibliography", "et al.", "doi:"),
    "financial": ("revenue", "ebitda", "consolidated", "fiscal year", "quarterly", "per share"),
    "technical": ("api", "endpoint", "parameter", "syntax", "version", "deprecated"),
    "form": ("___", "[ ]", "[x]", "please tick", "please select", "signature", "date:", "name:"),
}
LEAST_KEYWORDS = {"legal": 3, "academic": 2, "financial": 2, "technical": 2, "form": 2}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return strip(F.regexp_replace(c, f"[{SPACE}]+", " "))


def word_count(c: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE}]+"), 0)


def starts_lower(c: Column) -> Column:
    return c.rlike(r"^\p{Ll}")


def starts_upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def ends_alpha(c: Column) -> Column:
    return c.rlike(r"\p{L}$")


def ends_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}$")


def is_upper(c: Column) -> Column:
    """Upper case with at least one cased character."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def numbering(c: Column) -> Column:
    """The numbering prefix of a line as it stands, or the empty string."""
    return F.regexp_extract(c, NUMBERING, 1)


def numbering_parts(prefix: Column) -> Column:
    """Numbers of a numbering prefix, or null where it cannot be read."""
    ordinal = lambda t: F.array(F.ascii(F.upper(t)) - 64)
    number = lambda t: F.array(t.cast("int"))

    def read(p: Column) -> Column:
        word, bracket = F.regexp_extract(p, NUMBERING_KEYWORD, 1), F.regexp_extract(p, r"^\(([a-zA-Z\d]+)\)", 1)
        dotted = F.regexp_extract(p, r"^((?:\d+\.)+\d*)", 1)
        parts = F.filter(F.split(F.regexp_replace(dotted, r"^\.+|\.+$", ""), r"\."), lambda x: x.rlike(r"^\d+$"))
        return (
            F.when(word.rlike(r"^\d+$"), number(word))
            .when(word.rlike(r"^[A-Za-z]$"), ordinal(word))
            .when(dotted != "", F.transform(parts, lambda x: x.cast("int")))
            .when(p.rlike(r"^[A-Z]\."), ordinal(F.substring(p, 1, 1)))
            .when(bracket.rlike(r"^\d+$"), number(bracket))
            .when(bracket.rlike(r"^[A-Za-z]$"), ordinal(bracket))
        )

    return let(strip(prefix), read)


def strip_numbering(c: Column) -> Column:
    """A heading without its numbering."""
    return strip(F.regexp_replace(c, NUMBERING_PREFIX, ""))


def is_rule_identifier(c: Column) -> Column:
    """A reference to a legal provision, not a heading."""
    return c.rlike(RULE_IDENTIFIER)


def is_repeatable(c: Column) -> Column:
    """A stripped line that could be a running header: short, and not a sentence."""
    return (c != "") & (F.length(c) <= 150) & ~((word_count(c) > 5) & c.rlike(r"[.!?;]"))


def is_artefact(c: Column) -> Column:
    """A stripped line of a text layer that is a link, a date line or a page number."""
    link = c.rlike(r"^(http://|https://|www\.)") & (word_count(c) <= 3)
    return link | c.rlike(MONTH_YEAR) | c.rlike(PAGE_NUMBER) | c.rlike(PAGE_OF_LOOSE) | (c.rlike(ROMAN_LINE) & (F.length(c) <= 8))


def squeeze_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def logical_page(text: Column) -> Column:
    """The printed page number among the first and last three non-empty lines, or null."""
    near = lambda lines: F.when(F.size(lines) > 6, F.concat(F.slice(lines, 1, 3), F.slice(lines, -3, 3))).otherwise(lines)
    lines = let(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), near)
    found = F.get(F.filter(lines, lambda x: x.rlike(r"^\d+$") | x.rlike(ROMAN_PAGE)), F.lit(0))
    return let(found, lambda x: F.when(x.rlike(r"^\d+$"), x).otherwise(F.lower(x)))


def document_type(md: Column) -> Column:
    """legal, academic, financial, technical, form or general, by the words of the first page."""

    def typed(low: Column) -> Column:
        score = {k: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0)) for k, ws in KEYWORDS.items()}
        score["legal"] += md.rlike(r"\b[A-Z]{2,8}\s+\d+\.\d+").cast("int")
        score["academic"] += md.rlike(r"\[\d+(?:,\s*\d+)*\]").cast("int")
        score["financial"] += md.rlike("[$£€¥]").cast("int")
        score["technical"] += F.contains(md, F.lit("```")).cast("int") + (F.contains(low, F.lit("> **warning:**")) | F.contains(low, F.lit("> **note:**"))).cast("int")
        out = F.when(score["legal"] >= LEAST_KEYWORDS["legal"], "legal")
        for k in ("academic", "financial", "technical", "form"):
            out = out.when(score[k] >= LEAST_KEYWORDS[k], k)
        return out.otherwise("general")

    return let(F.lower(md), typed)


def preserve_indentation(c: Column) -> Column:
    """Lines without white space at their ends, the whole without any around it."""
    return strip(F.array_join(F.transform(F.split(c, "\n"), rstrip), "\n"))


def without_markers(c: Column) -> Column:
    """Text without image markers."""
    return F.regexp_replace(c, r"(?s)\{\{IMG:.*?\}\}", "")


def marker_field(c: Column) -> Column:
    """A field that cannot break a marker."""
    v = F.replace(collapse(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("/"))
    return strip(F.replace(F.replace(v, F.lit("{{IMG:"), F.lit("")), F.lit("}}"), F.lit("")))


def marker(filename: Column, label: Column, caption: Column) -> Column:
    return F.concat(F.lit("{{IMG:"), filename, F.lit("|"), marker_field(label), F.lit("|"), marker_field(caption), F.lit("}}"))


def marker_files(c: Column) -> Column:
    """File names of the markers in a text."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MARKER), 1)


def markers_as_markdown(c: Column) -> Column:
    """Text whose markers have become Markdown images."""
    text = F.coalesce(c, F.lit(""))
    marks = F.arrays_zip(F.regexp_extract_all(text, F.lit(MARKER), 0).alias("m"), F.regexp_extract_all(text, F.lit(MARKER), 1).alias("f"), F.regexp_extract_all(text, F.lit(MARKER), 2).alias("l"), F.regexp_extract_all(text, F.lit(MARKER), 3).alias("c"))

    def one(x):
        f, label, caption = strip(x["f"]), strip(x["l"]), strip(x["c"])
        named = F.when(label != "", label).when(caption != "", caption).otherwise("image")
        image = F.concat(F.lit("!["), named, F.lit("](assets/images/"), f, F.lit(")"), F.when(caption != "", F.concat(F.lit("\n*"), caption, F.lit("*"))).otherwise(""))
        return F.when(f == "", F.lit("")).otherwise(image)

    # Replacing the marker's own text also replaces its repeats, which read the same.
    return F.aggregate(marks, text, lambda acc, x: F.replace(acc, x["m"], one(x)))


def insert_marker(text: Column, anchor_source: Column, mark: Column) -> Column:
    """Text with the marker after the paragraph that holds the anchor: the last 60 or 40 characters of the block above, or its last word."""

    def first_hit(source: Column) -> Column:
        long = F.length(source) > 20
        anchors = F.array(F.when(long, F.right(source, F.lit(60))), F.when(long, F.right(source, F.lit(40))), F.element_at(F.split(source, " "), -1))
        usable = F.filter(anchors, lambda a: a.isNotNull() & (F.length(a) >= 3))
        return F.get(F.filter(F.transform(usable, lambda a: F.position(a, text)), lambda p: p > 0), F.lit(0))

    def put(at: Column) -> Column:
        gap = F.position(F.lit("\n\n"), text, at)
        cut = F.when(gap > 0, gap + 1).otherwise(F.length(text))
        return let(cut, lambda k: F.concat(F.substring(text, F.lit(1), k), F.lit("\n\n"), mark, F.lit("\n\n"), F.substring(text, k + 1, F.length(text))))

    return let(let(collapse(F.coalesce(anchor_source, F.lit(""))), first_hit), lambda at: F.when(at.isNull(), text).otherwise(put(at)))


def clean_cell(c: Column) -> Column:
    """A table cell on one line, with pipes escaped."""
    one = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    return F.replace(strip(F.regexp_replace(one, " {2,}", " ")), F.lit("|"), F.lit("\\|"))
