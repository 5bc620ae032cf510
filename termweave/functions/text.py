"""Text functions as columns. Word classes are Unicode ones; see README for where that is a choice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

WORD = r"[\p{L}\p{N}_]"
ASCII_WORD = r"[0-9A-Za-z_]"


def nonempty(c: Column | str) -> Column:
    """Null for the empty string."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


@F.pandas_udf(StringType())
def html_unescape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import html

    for s in parts:
        yield s.map(html.unescape, na_action="ignore")


#: The entities that a listed cleaning resolves, in order, so that what & yields is not resolved again.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
#: White space within the ASCII range, and the space separators that a trim takes off the ends.
ASCII_SPACE, SEPARATORS = r"[\t\n\f\r ]", " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def clean_text(c: Column | str, entities: dict[str, str] | None = None) -> Column:
    """Tags go, then entities are resolved, then white space is collapsed; '' for null.

    All of HTML's entities, unfinished ones too, and Unicode white space; given entities, these
    alone as they are written, ASCII white space, and space separators off the ends.
    """
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", "")
    if entities is None:
        return strip(F.regexp_replace(html_unescape(bare), r"(?U)\s+", " "))
    for written, meant in entities.items():
        bare = F.replace(bare, F.lit(written), F.lit(meant))
    return F.btrim(F.regexp_replace(bare, f"{ASCII_SPACE}+", " "), F.lit(SEPARATORS))


@F.pandas_udf(StringType())
def fold_diacritics(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks, lower-cased."""
    import unicodedata

    def fold(t: str) -> str:
        return "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).lower()

    for s in parts:
        yield s.map(fold, na_action="ignore")


def boundary_match(term: Column, text: Column) -> Column:
    """Whether term stands in text, in any case, between characters that are no letters."""
    quoted = F.concat(F.lit(r"(?<!\p{L})\Q"), F.replace(F.lower(term), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\p{L})"))
    return F.contains(F.lower(text), F.lower(term)) & F.regexp_like(F.lower(text), quoted)


def escape_xml(c: Column | str) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}+)"), F.lit(1))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces; none of a shorter array."""
    size = F.size(words)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def phrase_words(c: Column | str) -> Column:
    """Lowered words of two or more characters, with hyphens and apostrophes inside."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"({WORD}+(?:{WORD}|['-])*{WORD}+)"), F.lit(1))


def text_ngrams(c: Column | str, n: int) -> Column:
    """Runs of n of phrase_words()."""
    return ngrams(phrase_words(c), n)


def vocabulary(c: Column | str, least: int = 3) -> Column:
    """The distinct words of a text that have at least `least` characters."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"({WORD}{{{least},}})"), F.lit(1)))


def timestamp(at: Column | None = None) -> Column:
    """An ISO time without zone, to the microsecond; now unless a time is given."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def scan_phrases(c: Column | str) -> Column:
    """Distinct runs of 4, 3 and 2 words, and single words of more than 3 characters."""
    words = phrase_words(c)
    single = F.filter(words, lambda w: F.length(w) > 3)
    return F.array_sort(F.array_distinct(F.concat(ngrams(words, 4), ngrams(words, 3), ngrams(words, 2), single)))


_CURSOR = "[a-zA-Z0-9_čšžČŠŽà-ž]"


def word_at(text: Column, position: Column) -> Column:
    """The word round a cursor; '' outside the text."""
    before = F.regexp_extract(F.left(text, position), f"({_CURSOR}*)$", 1)
    after = F.regexp_extract(F.substr(text, position + 1), f"^({_CURSOR}*)", 1)
    return F.when((position < 0) | (position > F.length(text)), F.lit("")).otherwise(F.concat(before, after))


def splice(text: Column, start: Column, end: Column, with_text: Column) -> Column:
    """text with [start, end) replaced."""
    return F.concat(F.left(text, start), with_text, F.substr(text, end + 1))


def append_word(text: Column, word: Column) -> Column:
    """word after text, one space between unless text is empty or ends in white space."""
    return F.when((text == "") | F.regexp_like(text, F.lit(r"(?U)\s\z")), F.concat(text, word)).otherwise(F.concat(text, F.lit(" "), word))


def alternation(terms: Column) -> Column:
    """A pattern for any of the terms, longest first."""
    ordered = F.array_sort(F.filter(terms, lambda t: F.length(t) > 0), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.array_join(F.transform(ordered, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), "|")


def highlight(text: Column, terms: Column, opening: str = "<mark>", closing: str = "</mark>", least: int = 2) -> Column:
    """Every occurrence of a term of at least `least` characters between tags, in one pass, so tags never nest."""
    pattern = alternation(F.filter(terms, lambda t: F.length(t) >= least))
    return F.when(F.coalesce(pattern, F.lit("")) == "", text).otherwise(F.regexp_replace(text, F.concat(F.lit("(?iu)("), pattern, F.lit(")")), F.lit(f"{opening}$1{closing}")))


def highlight_entities(text: Column, terms: Column) -> Column:
    return highlight(escape_xml(text), F.transform(terms, escape_xml), '<span class="kg-term">', "</span>", 1)


def length_ratio(a: Column, b: Column) -> Column:
    """The longer by the shorter length; 10 if one is empty."""
    m, n = F.length(a), F.length(b)
    return F.when(F.least(m, n) > 0, F.greatest(m, n) / F.least(m, n)).otherwise(F.lit(10.0))


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100 * done / total)).otherwise(0).cast("int")


def strip_trailing_marks(c: Column | str) -> Column:
    return F.regexp_replace(c, r"[.,;:!?)\]]+\z", "")


def first_words(c: Column | str, n: int) -> Column:
    return F.array_join(F.slice(F.split(strip(c), r"(?U)\s+"), 1, n), " ")


def language_pair(c: Column | str) -> tuple[Column, Column]:
    parts = F.split(c, "->")
    return parts[0], parts[1]


def node_label(display: str = "display_form") -> Column:
    return F.coalesce(nonempty(display), nonempty("term"), nonempty("label"), F.col("id"))


def node_size(frequency: Column) -> Column:
    return F.greatest(F.lit(4.0), F.least(F.lit(24.0), 4 + 3 * F.log1p(F.coalesce(frequency, F.lit(1)))))


def lookup(key: Column, values: dict[str, object], default: object) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


#: Display colours by language, and style by relation (colour, width, dashed).
LANGUAGE_COLOURS = {"en": "#3b82f6", "sl": "#10b981", "de": "#f59e0b", "fr": "#8b5cf6", "it": "#ef4444"}
CONCEPT_COLOUR, OTHER_COLOUR = "#64748b", "#94a3b8"
EDGE_STYLES = {"translates_to": ("#94a3b8", 1.5, False), "instantiates_concept": ("#c4b5fd", 1.0, True), "subclass_of": ("#fcd34d", 1.0, True), "appears_in_segment": ("#6ee7b7", 0.8, True)}
OTHER_STYLE = ("#cbd5e1", 1.0, False)


def node_colour(kind: Column, lang: Column) -> Column:
    return F.when(kind == "concept", F.lit(CONCEPT_COLOUR)).otherwise(lookup(lang, LANGUAGE_COLOURS, OTHER_COLOUR))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; one integer holds a row of the table."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        match = row & where.get(x, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 * LCS / (m + n); 100 for two empty strings."""
    return pd.Series([None if x is None or y is None else 200.0 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b, strict=True)], dtype="float64")
