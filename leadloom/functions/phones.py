"""Phone normalisation as Column expressions.

Three variants exist on purpose: ``phone_e164`` (mobile prefix list),
``phone_series`` (any 03..09 number) and ``phone_loose`` (identity files, any
number of ten digits or more).  Each is a chain of regular expressions that
uses its input once, so that the generated code stays small.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import dictionaries as D

_EXPONENT = "([eE][+-]?[0-9]+)"
_FLOAT_TEXT = rf"^[+-]?(([0-9]+\.[0-9]*|\.[0-9]+){_EXPONENT}?|[0-9]+{_EXPONENT})$"
_SIGNED_EXPONENT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-][0-9]+$"


def _whole_number(text: Column, form: str) -> Column:
    """Undo the float / scientific text of spreadsheet cells: 9.1E+08 -> 910000000."""
    whole = F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), F.lit(""))
    marked = text.contains(".") | text.contains("e") | text.contains("E")  # every form has one of them
    return F.when(marked & text.rlike(form), whole).otherwise(text)


def mobile_body(phone: Column, prefixes: list[str] | None = None) -> Column:
    """Nine national digits of a valid mobile number, else null."""
    start = "|".join(p[1:] for p in prefixes or D.MOBILE_PREFIXES)
    digits = F.regexp_replace(_whole_number(F.trim(phone.cast("string")), _FLOAT_TEXT), "[^0-9+]", "")
    return F.nullif(F.regexp_extract(digits, rf"^\+?(?:84|0)?((?:{start})[0-9]{{7}})$", 1), F.lit(""))


def phone_e164(phone: Column, prefixes: list[str] | None = None) -> Column:
    """+84 and nine digits, or null when it is no valid mobile number."""
    return F.concat(F.lit("+84"), mobile_body(phone, prefixes))


def phone_local(phone: Column) -> Column:
    """0 and nine digits, or null."""
    return F.concat(F.lit("0"), mobile_body(phone))


def phone_valid(phone: Column) -> Column:
    return mobile_body(phone).isNotNull()


def phone_series(phone: Column) -> Column:
    """Column variant without a prefix list; signed exponents only."""
    digits = F.regexp_replace(_whole_number(F.trim(phone.cast("string")), _SIGNED_EXPONENT), "[^0-9+]", "")
    body = F.regexp_extract(digits, r"^\+?(?:84|0)?([3-9][0-9]{8})$", 1)
    return F.concat(F.lit("0"), F.nullif(body, F.lit("")))


def phone_loose(phone: Column) -> Column:
    """Identity variant: digits only, anything of ten digits or more is kept."""
    digits = F.regexp_replace(phone.cast("string"), "[^0-9]", "")
    local = F.regexp_replace(F.regexp_replace(digits, "^84(?=[0-9]{9})", "0"), "^([0-9]{9})$", "0$1")
    return F.nullif(F.regexp_extract(local, "^[0-9]{10,}$", 0), F.lit(""))


def phone_audience(phone: Column) -> Column:
    """Upload format of ad audiences: leading 0 becomes 84."""
    return F.regexp_replace(F.coalesce(phone, F.lit("")), "^0", "84")


def phone_join_key(phone: Column) -> Column:
    """One key for 0xxx and +84xxx numbers."""
    return F.nullif(F.regexp_replace(F.trim(phone), "^0", "+84"), F.lit(""))


def lookup_text(query: Column) -> Column:
    """Search text as typed -> canonical phone, other text without dots and blanks."""
    bare = F.regexp_replace(F.trim(query), "[. ]", "")
    local = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        bare, r"^\+", ""), "^84(?=.{9}$)", "0"), "^(.{9})$", "0$1")
    return F.when(bare.rlike(r"^(\+.*|[0-9]+)$"), local).otherwise(bare)


def province_from_phone(phone: Column, codes: dict[str, str] | None = None) -> Column:
    """Province of a landline number; four-digit codes win over three-digit ones."""
    codes = codes or D.LANDLINE_PROVINCE
    digits = F.regexp_replace(F.coalesce(phone.cast("string"), F.lit("")), "[^0-9]", "")
    local = F.regexp_replace(F.regexp_replace(digits, "^84(?=[0-9]{9}$)", "0"), "^(?!0)", "0")
    longest_first = "|".join(sorted(codes, key=lambda code: (-len(code), code)))
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.element_at(table, F.regexp_extract(local, f"^({longest_first})", 1)), F.lit("Unknown"))


def phones_in_text(text: Column) -> Column:
    """Distinct valid numbers of a text, in order of first occurrence."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "[- ]", "")
    found = F.regexp_extract_all(
        squeezed, F.lit(r"((?:(?:\+84|0084|84)?[3-9][0-9]{8})|(?:0[3-9][0-9]{8}))"), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(found, lambda p: phone_e164(p))))


def html_body(html: Column) -> Column:
    """Markup without its script, style, nav and footer elements."""
    body = F.coalesce(html, F.lit(""))
    return F.regexp_replace(body, r"(?is)<(script|style|nav|footer)\b[^>]*>.*?</\1>", " ")


def phones_in_body(body: Column, keep: int | None = None) -> Column:
    """Numbers of ``tel:`` links, then of the visible text; the first ``keep`` when given."""
    hrefs = F.regexp_extract_all(body, F.lit(r"(?is)<a\b[^>]*?href\s*=\s*[\"']tel:([^\"']*)[\"']"), F.lit(1))
    visible = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    found = F.array_union(F.array_compact(F.transform(hrefs, lambda p: phone_e164(p))), phones_in_text(visible))
    return found if keep is None else F.slice(found, 1, keep)
