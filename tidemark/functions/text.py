"""Column expressions over free text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that Python's str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def _accent_table() -> tuple[str, str]:
    """Latin letters with marks -> base letter; bare combining marks -> removed."""
    source, target = [], []
    for start, stop in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for point in range(start, stop):
            base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
            if len(base) == 1 and base != chr(point):
                source.append(chr(point))
                target.append(base)
    marks = [chr(p) for p in range(0x0300, 0x0370) if unicodedata.category(chr(p)) == "Mn"]
    return "".join(source + marks), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space at both ends (any Unicode white space)."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_if_null_trim(text: Column) -> Column:
    return strip(F.coalesce(text.cast("string"), F.lit("")))


def strip_accents(text: Column) -> Column:
    """Drop combining marks of Latin text, inside the JVM."""
    return F.translate(text, _ACCENTED, _PLAIN)


def text_hash(text: Column) -> Column:
    """sha1 of the trimmed text in Latin-1 (fails on characters Latin-1 lacks)."""
    return F.sha1(F.encode(strip(text), "ISO-8859-1"))


def report_key(visit_id: Column, text: Column) -> Column:
    """Visit id as integer text, followed by the text hash."""
    return F.concat(visit_id.cast("bigint").cast("string"), text_hash(text))


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


#: Characters that composition neither changes nor joins with others: Latin up to U+02FF, usual punctuation and signs.
COMPOSED = r"\x00-\u02FF\u2002-\u20CF"


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no built-in for it. Only texts with other than ``COMPOSED`` characters go to Python."""
    return F.coalesce(_composed(F.when(text.rlike(f"[^{COMPOSED}]"), text)), text)


def content_id(text: Column, hex_chars: int = 32) -> Column:
    """Leading hex digits of sha256 over composed, trimmed, space-squeezed text."""
    squeezed = F.regexp_replace(strip(nfc(text)), r"(?U)\s+", " ")
    return F.substring(F.sha2(squeezed, 256), 1, hex_chars)


def ascii_fold(text: Column) -> Column:
    """Lower case, accents and other non-ASCII removed, white space squeezed."""
    plain = F.regexp_replace(strip_accents(text), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def line_at(text: Column, position: Column, *, to_period: bool = True) -> Column:
    """The line that holds a 1-based position.

    With ``to_period`` a line shorter than five characters is extended to the next full
    stop, if there is one.
    """
    before = F.substring_index(F.substring(text, F.lit(1), position - 1), "\n", -1)
    rest = F.substring(text, position, F.length(text))
    line = strip(F.concat(before, F.substring_index(rest, "\n", 1)))
    if not to_period:
        return line
    longer = strip(F.concat(before, F.substring_index(rest, ".", 1), F.lit(".")))
    return F.when((F.length(line) < 5) & F.contains(rest, F.lit(".")), longer).otherwise(line)


def line_containing(text: Column, pattern: str, **kw) -> Column:
    """The line holding the first match of a pattern, null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, line_at(text, at, **kw))


def integers_in(text: Column) -> Column:
    """All integers written in a string."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int"))


def strip_signature_blocks(text: Column) -> Column:
    """Remove three-line blocks: any line, a licence line, a number or state line."""
    # Licence-board word and state abbreviations.
    states = (
        "(?:AC|AL|AP|AM|BA|CE|DF|ES|GO|MA|MT|MS|MG|PA|PB|PR|PE|PI|RJ|RN|RS|RO|RR|SC|SP|SE|TO)"
    )
    block = (
        rf"(?im)^[^\n]*\n\s*CRM(?:\s*[/\-]?\s*{states})?\s*\n"
        rf"\s*(?:\d+|{states}(?:\s*[/\-]?\s*\d+)?)\s*\n?"
    )
    return F.regexp_replace(text, block, "")


def strip_prefixed_lines(text: Column, word: str = "cassete") -> Column:
    """Remove lines that begin with a word."""
    return F.regexp_replace(text, rf"(?im)^[ \t]*{word}\b.*\n?", "")


def children_count_from_text(text: Column) -> Column:
    """Number of children stated in a complaint text; a stated "none" is 0."""
    has_word = F.lower(text).rlike(r"\bfilhos?-?\d*\b")
    found = F.regexp_extract(text, r"(?iu)FILHOS?\s*(-?)(\d+|NAO)", 2)
    value = F.when(F.upper(found) == "NAO", F.lit(0)).otherwise(found.try_cast("int"))
    return F.when(has_word & (found != ""), value)


def flag_map(flag: Column) -> Column:
    """S -> 1, N or null -> 0, anything else -> null."""
    return F.when(flag == "S", 1).when(F.coalesce(flag, F.lit("N")) == "N", 0)


def zip_prefix(code: Column) -> Column:
    """First three characters of an eight-character code, else a fixed category."""
    return F.when(F.length(code) == 8, F.substring(strip(code), 1, 3)).otherwise("no_zip_code")


def sex_code(sex: Column) -> Column:
    s = F.upper(F.coalesce(sex, F.lit("F")))
    return F.when(s == "F", 0).when(s == "M", 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_chunks(text: Column, max_words: int, overlap: int = 0) -> Column:
    """Array of chunks of at most ``max_words`` words, consecutive chunks sharing ``overlap``.

    ``max_words <= 0`` gives one chunk; blank text gives none.  The overlap must be
    smaller than the chunk, otherwise chunking could not advance.
    """
    none = F.array().cast("array<string>")
    if max_words <= 0:
        return bind(words(text), lambda t: F.when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(none))
    overlap = max(overlap, 0)
    if overlap >= max_words:
        raise ValueError("overlap must be smaller than max_words")
    step = max_words - overlap

    def chunks(tokens: Column) -> Column:  # the text is split once
        n = F.size(tokens)
        last = F.greatest(F.ceil((n - F.lit(max_words)) / F.lit(step)), F.lit(0)).cast("int")
        pieces = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i * step + 1, F.lit(max_words)), " "),
        )
        return F.when(n > 0, pieces).otherwise(none)

    return bind(words(text), chunks)
