"""Text, count and URL rules as column expressions (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() sees it: Unicode white space and U+001C to U+001F.
_WHITE = r"[\s\x{1c}-\x{1f}]"
LONGEST_INT = 18


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    """Text without white space at both ends."""
    return F.regexp_replace(_c(text), rf"(?U)^{_WHITE}+|{_WHITE}+$", "")


def title_key(title: Column | str) -> Column:
    """What titles are compared by."""
    return F.lower(strip(title))


def first_of(text: Column | str, *others: Column | str) -> Column:
    """The first value that is neither null nor empty, else the last."""
    values = [_c(text), *map(_c, others)]
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def to_count(text: Column | str) -> Column:
    """A whole number, commas dropped; 0 if there is none. 1.5 and 12/3 are none."""
    plain = F.replace(strip(text), F.lit(","), F.lit(""))
    return F.coalesce(F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("bigint")), F.lit(0).cast("bigint"))


def bracketed_count(text: Column | str) -> Column:
    """to_count of a text with square brackets around it."""
    return to_count(F.regexp_replace(strip(text), r"^[\[\]]+|[\[\]]+$", ""))


def rating_count(text: Column | str) -> Column:
    """to_count of what stands before the first hyphen."""
    return to_count(F.split_part(_c(text), F.lit("-"), F.lit(1)))


def _captured(text: Column | str, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(_c(text), pattern, group)
    return F.coalesce(found.try_cast("bigint"), F.lit(0).cast("bigint"))


def first_bracket_count(text: Column | str) -> Column:
    """The number in the first [n]."""
    return _captured(text, r"\[(\d+)\]")


def last_paren_count(text: Column | str) -> Column:
    """The number in (n) at the end."""
    return _captured(text, rf"(?dU)\((\d+)\){_WHITE}*$")


def recommend_count(text: Column | str) -> Column:
    return _captured(text, rf"(?dU)추천{_WHITE}*\+(\d+)")


def first_count(text: Column | str) -> Column:
    """The first run of digits anywhere."""
    return _captured(text, r"(\d+)")


def without_brackets(text: Column | str) -> Column:
    """Text without any [n]."""
    return strip(F.regexp_replace(_c(text), r"(?U)\[\d+\]", ""))


def without_last_paren(text: Column | str) -> Column:
    return strip(F.regexp_replace(_c(text), rf"(?dU){_WHITE}*\(\d+\){_WHITE}*$", ""))


def without_rank(text: Column | str) -> Column:
    """Text without digits in front."""
    return strip(F.regexp_replace(_c(text), r"(?U)^\d+", ""))


def without_recommend(text: Column | str) -> Column:
    return strip(F.regexp_replace(_c(text), rf"(?dU)답글추천{_WHITE}*\+\d+", ""))


def without_query(url: Column | str) -> Column:
    """Text up to the first question mark; of a text of many lines, of each line."""
    return F.regexp_replace(_c(url), r"(?d)\?.*", "")


def absolute(base: Column | str, href: Column | str) -> Column:
    """The prefix rule: what doesn't start with http gets the base in front, slash or no slash."""
    base = F.lit(base) if isinstance(base, str) else base
    return F.when(F.startswith(_c(href), F.lit("http")), _c(href)).otherwise(F.concat(base, _c(href)))


def url_by_id(base: str, href: Column | str, name: str = "document_srl") -> Column:
    """base/id if the link names an id, else the prefix rule."""
    number = F.regexp_extract(_c(href), rf"(?U){name}=(\d+)", 1)
    return F.when(number != "", F.concat(F.lit(base + "/"), number)).otherwise(absolute(base, href))


def with_scheme(url: Column | str, empty_is_null: bool = True) -> Column:
    """//host/x becomes https://host/x."""
    url = _c(url)
    fixed = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.nullif(fixed, F.lit("")) if empty_is_null else fixed


#: og:image in either order of the two attributes (fixed value).
OG_IMAGE = r"""(?idU)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']|<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:image["']"""


def og_image(html: Column | str) -> Column:
    """The page's og:image, null if it has none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_c(html), OG_IMAGE, g), F.lit("")) for g in (1, 2)])


def unless_contains(value: Column | str, words: list[str]) -> Column:
    """Null for values that contain one of the words."""
    value = _c(value)
    for w in words:
        value = F.when(~F.contains(value, F.lit(w)), value)
    return value


def quote(text: Column | str) -> Column:
    """Percent encoding of all but letters, digits and _.-~/ ."""
    out = F.url_encode(_c(text))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unquote(text: Column | str) -> Column:
    """Percent decoding; a plus sign stays, and text with a bad escape stays as it is."""
    text = _c(text)
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def round_half_even_2(value: Column) -> Column:
    """Two decimals of the exact binary value, ties to even."""
    return F.call_function("format_number", value, F.lit("0.00")).cast("double")
