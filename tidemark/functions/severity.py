"""Severity codes (0-6, with 4A/4B/4C) read from free-text reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, line_at, strip

# ---------------------------------------------------------------------------
# Report patterns and code tables.
# ---------------------------------------------------------------------------
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6"}
SUBCODE_RANK = {"4A": 4.1, "4B": 4.2, "4C": 4.3}

VALUE = r"[0-6](?:[ABC])?|[IVX]{1,3}(?:[ABC])?"
CLASS_WORD = r"(?:classe|categoria|classifica[cç][aã]o)"

TOKEN = r"(?is)bi[\s-]?rads"
# A clause starts right after a delimiter: the look-behind changes no match and keeps the
# search linear in the length of the text.
DIRECT = (
    r"(?iuU)(?<![^.:\n])[^.:\n]*(?:categoria\s*)?bi[\s-]?rads(?:®)?[^0-9ivxabc\n]*[:;\-\s]*"
    rf"({VALUE})"
    r"(?!\s*[ºª])(?!\s*(?:ed(?:\.|i[cç][aã]o)|edition)\b)[^.\n]*"
)
EDITION = r"(?iuU)\b(ed(?:\.|i[cç][aã]o)|edition)\b"
NEARBY = rf"(?iuU){CLASS_WORD}\s*[:\-]?\s*({VALUE})[^.\n]*"
FLEX_TOKEN = r"b[i1l]\s*(?:[-–—]?\s*)?ra[h]?d[sz](?:®)?"
FLEX = (
    rf"(?iuU)(?<![^\n.])([^\n.]*?(?:{CLASS_WORD}\s*[:\-]?\s*)?(?:mama\s+(direita|esquerda)\s*)?"
    rf"{FLEX_TOKEN}[^0-9ivxabc\n]*[:;\-–—\s]*)({VALUE})[^\n.]*"
)
FLEX_ANY = rf"(?iu){FLEX_TOKEN}"
FLEX_FIRST = rf"(?iuU){FLEX_TOKEN}"
SIDE = r"(?iuU)\bmama\s+(direita|esquerda)\b"
SIDES = {"direita": "right", "esquerda": "left"}
ZERO_DIGITS = r"(?<![\d/\-:\.])(0[0-9])(?![\d/\-:\.])"
HEADER_WINDOW = 600
SIDE_WINDOW = 80
# ---------------------------------------------------------------------------


def _lookup(value: Column, table: dict[str, object], default: Column | None = None) -> Column:
    expr = None
    for key, target in table.items():
        cond = value == key
        expr = F.when(cond, F.lit(target)) if expr is None else expr.when(cond, F.lit(target))
    return expr if default is None else expr.otherwise(default)


def normalize_value(raw: Column) -> Column:
    """Upper case, Roman numerals to digits, suffix A/B/C kept."""
    up = F.upper(strip(raw))
    base = F.regexp_replace(up, "[ABC]$", "")
    return F.concat(_lookup(base, ROMAN, base), F.regexp_extract(up, "[ABC]$", 0))


def value_rank(value: Column) -> Column:
    """Numeric rank used to pick the largest of several codes; unknown is -1."""
    v = F.upper(value)
    plain = F.when(v.rlike("^[0-6]$"), v.try_cast("double")).otherwise(F.lit(-1.0))
    return _lookup(v, SUBCODE_RANK, plain)


def normalize_code(value: Column) -> Column:
    """Integer code 0..6; the sub-codes of 4 become 4, anything else null."""
    number = _lookup(value, {"4A": "4", "4B": "4", "4C": "4"}, value).try_cast("int")
    return F.when(number.between(0, 6), number)


def _finding(value: Column, clause: Column) -> Column:
    return F.struct(normalize_value(value).alias("value"), clause.alias("clause"))


def extract_direct(text: Column) -> Column:
    """First clause "token ... value", without edition mentions and ordinals."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(DIRECT), 0).alias("clause"),
        F.regexp_extract_all(text, F.lit(DIRECT), 1).alias("value"),
    )
    hits = F.filter(pairs, lambda p: ~p["clause"].rlike(EDITION))
    found = bind(
        F.get(hits, F.lit(0)),
        lambda p: F.when(p.isNotNull(), _finding(p["value"], strip(p["clause"]))),
    )
    return F.when(text.rlike(TOKEN), found)


def extract_nearby(text: Column) -> Column:
    """A class word with a value within 600 characters after a token header, else anywhere."""
    windows = F.regexp_extract_all(text, F.lit(rf"{TOKEN}(?=(.{{0,{HEADER_WINDOW}}}))"), 1)
    hit = F.array_position(F.transform(windows, lambda w: w.rlike(NEARBY)), True).cast("int")
    window = F.get(windows, hit - 1)
    gaps = F.slice(F.split(text, TOKEN, -1), F.lit(1), hit)
    heads = F.slice(F.regexp_extract_all(text, F.lit(TOKEN), 0), F.lit(1), hit)
    header_end = F.length(F.array_join(gaps, "")) + F.length(F.array_join(heads, ""))
    near = _finding(
        F.regexp_extract(window, NEARBY, 1),
        line_at(text, header_end + F.regexp_instr(window, F.lit(NEARBY))),
    )
    anywhere = _finding(
        F.regexp_extract(text, NEARBY, 1), line_at(text, F.regexp_instr(text, F.lit(NEARBY)))
    )
    return F.when(
        text.rlike(TOKEN), F.when(hit > 0, near).when(text.rlike(NEARBY), anywhere)
    )


def extract_first_pass(text: Column) -> Column:
    """Direct clause, else nearby value."""
    return F.coalesce(extract_direct(text), extract_nearby(text))


def extract_flex(text: Column) -> Column:
    """Typo-tolerant token; of all matches the largest code wins, the earliest on ties.

    Returns value, clause, side and rank.  The looser fallback without leading words is a
    special case of this pattern, so it needs no second pass.  The pattern is searched for once,
    from the last full stop before the first token; nothing but its match decides a match's groups.
    """

    def search(head: Column) -> Column:
        # a match has a token and no full stop before it
        skip = F.length(head) - F.length(F.substring_index(head, ".", -1))
        return bind(skip, lambda s: bind(F.substring(text, s + 1, F.length(text)), lambda rest: pick(s, rest)))

    def pick(skip: Column, rest: Column) -> Column:
        return bind(F.regexp_extract_all(rest, F.lit(FLEX), F.lit(0)), lambda found: best(skip, rest, found))

    def best(skip: Column, rest: Column, found: Column) -> Column:
        ranked = F.transform(found, lambda m, i: bind(
            normalize_value(F.regexp_extract(m, FLEX, 3)), lambda v: F.struct(value_rank(v).alias("rank"), (-i).alias("neg"), v.alias("value"))
        ))
        return F.when(F.size(found) > 0, bind(F.array_max(ranked), lambda b: place(skip, rest, found, b)))

    def place(skip: Column, rest: Column, found: Column, best: Column) -> Column:
        at = (-best["neg"]).cast("int")
        match = F.get(found, at)
        # the text of a match cannot occur between it and the match before, as that would be a match
        end = F.aggregate(F.slice(found, F.lit(1), at + 1), F.lit(0), lambda e, m: F.position(m, rest, e + 1) - 1 + F.length(m))
        return bind(skip + end - F.length(match), lambda start: describe(start, match, best))

    def describe(start: Column, match: Column, best: Column) -> Column:
        stop = start + F.length(match)
        low = F.greatest(start - SIDE_WINDOW, F.lit(0))
        around = F.substring(text, low + 1, stop + SIDE_WINDOW - low)
        stated = F.regexp_extract(match, FLEX, 2)
        side = F.lower(F.when(stated != "", stated).otherwise(F.regexp_extract(around, SIDE, 1)))
        return F.struct(
            best["value"].alias("value"),
            line_at(text, start + F.length(F.regexp_extract(match, FLEX, 1)) + 1).alias("clause"),
            _lookup(side, SIDES).alias("side"),
            best["rank"].alias("rank"),
        )

    return F.when(text.rlike(FLEX_ANY), bind(F.get(F.split(text, FLEX_FIRST, 2), F.lit(0)), search))


def extract_value(text: Column) -> Column:
    """First pass, and the typo-tolerant pass only where the first finds nothing."""
    first = extract_first_pass(text)
    flex = extract_flex(text)
    second = F.struct(flex["value"].alias("value"), flex["clause"].alias("clause"))
    return F.when(first.isNotNull(), first).when(flex.isNotNull(), second)


def refine_zero(value: Column, clause: Column) -> Column:
    """A bare "0" becomes the first stand-alone two-digit 0d number of its clause."""
    token = F.regexp_extract(clause, ZERO_DIGITS, 1)
    return F.when((value == "0") & (token != ""), token).otherwise(value)
