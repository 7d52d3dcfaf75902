"""Value standardizers: one Column in, one Column out, NULL for "not available"."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.functions import dates
from leadspark.functions.binding import let
from leadspark.functions.similarity import closest

SPACE = r"[\s\x1c-\x1f]"


def strip(value: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(value, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def clean(value: Column) -> Column:
    """Collapse white space runs to one space and trim."""
    return F.trim(F.regexp_replace(value, rf"(?U){SPACE}+", " "))


def is_missing(cleaned: Column) -> Column:
    return F.lower(cleaned).isin(fv.MISSING_WORDS)


def known(cleaned: Column) -> Column:
    """NULL where the cleaned value is a missing-value word."""
    return let(cleaned, lambda v: F.when(~is_missing(v), v))


def fold_read_nulls(cell: Column) -> Column:
    """NULL where a raw cell is one of the reader's null tokens (exact spelling)."""
    return F.when(~cell.isin(fv.READ_NULL_TOKENS), cell)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def _without_float_tail(cleaned: Column) -> Column:
    return F.regexp_replace(cleaned, r"\.0$", "")


def text(value: Column) -> Column:
    return known(clean(value))


def _capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.length(word))))


def _capitalize_word(word: Column) -> Column:
    return F.array_join(F.transform(F.split(word, "-"), _capitalize), "-")


def recase(cleaned: Column) -> Column:
    """Capitalize the words that carry no casing of their own (all upper or all lower), hyphen parts too."""
    return F.array_join(
        F.transform(F.split(cleaned, " "),
                    lambda w: F.when((w == F.upper(w)) | (w == F.lower(w)), _capitalize_word(w)).otherwise(w)),
        " ")


def name(value: Column) -> Column:
    return recase(text(value))


def date(value: Column, as_of: Column) -> Column:
    return let(text(value), lambda v: F.when(
        dates.parse_minutes(v).isNotNull(), dates.format_date(dates.parse_date(v, as_of))))


def datetime(value: Column, as_of: Column) -> Column:
    return let(text(value), lambda v: F.concat(
        dates.format_date(dates.parse_date(v, as_of)), dates.format_minutes(dates.parse_minutes(v))))


def phone(value: Column) -> Column:
    """(XXX) XXX-XXXX; any other digit count stays bare digits; no digits is NULL."""
    found = digits(known(_without_float_tail(clean(value))))
    local = let(found, lambda d: F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d))
    return let(local, lambda d: F.when(
        F.length(d) == 10, F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3),
                                    F.lit("-"), F.substring(d, 7, 4))).when(d != "", d))


def phone_valid(standardized: Column) -> Column:
    """A standardized phone is valid when formatted or absent."""
    return standardized.isNull() | F.coalesce(standardized.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$"), F.lit(False))


def zip_code(value: Column) -> Column:
    return let(digits(known(_without_float_tail(clean(value)))), lambda d: F.when(
        F.length(d) == 9, F.substring(d, 1, 5)).when(F.length(d).between(3, 5), F.lpad(d, 5, "0")))


def homeowner_exact(value: Column) -> Column:
    return let(F.lower(clean(value)), lambda v: F.when(v.isin(fv.OWNER_WORDS), F.lit("Owner"))
               .when(v.isin(fv.RENTED_WORDS), F.lit("Rented")))


def homeowner(value: Column) -> Column:
    low = F.lower(text(value))
    exact = homeowner_exact(value)
    open_value = F.when(exact.isNull(), low)
    return F.coalesce(
        exact,
        F.when(closest(open_value, fv.OWNER_WORDS, fv.HOMEOWNER_CUTOFF).isNotNull(), F.lit("Owner")),
        F.when(closest(open_value, fv.RENTED_WORDS, fv.HOMEOWNER_CUTOFF).isNotNull(), F.lit("Rented")))


def integer(value: Column) -> Column:
    """Whole part of a number, else all digits of the text, else NULL."""
    return let(text(value), _whole_number)


def _whole_number(cleaned: Column) -> Column:
    numeric = cleaned.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    whole = let(cleaned.try_cast("double"), lambda n: F.when(F.abs(n) < 9e18, n.try_cast("bigint").cast("string")).otherwise(_large_whole(n)))
    return F.when(numeric, whole).otherwise(let(digits(cleaned), lambda d: F.when(d != "", d)))


def _large_whole(number: Column) -> Column:
    """All digits of a whole double beyond BIGINT, put together from two exact halves; NULL beyond DECIMAL(38)."""
    half = 1 << 62
    size = F.abs(number)
    high = F.floor(size / float(half))
    low = (size - high.cast("double") * float(half)).cast("bigint")
    total = high.cast("decimal(19,0)") * F.lit(half).cast("decimal(19,0)") + low.cast("decimal(19,0)")
    return F.when(size < 9e37, F.concat(F.when(number < 0, "-").otherwise(""), total.cast("string")))


def email(value: Column) -> Column:
    return F.lower(text(value))


def carrier_vocabulary() -> dict[str, str]:
    keys = {"".join(ch for ch in c.lower() if "a" <= ch <= "z"): c for c in fv.CARRIERS}
    return {**keys, **fv.CARRIER_SPELLINGS}


def carrier_key(value: Column) -> Column:
    """Letters only, lower case."""
    return F.regexp_replace(F.lower(text(value)), "[^a-z]", "")


def literal_map(entries: dict[str, str]) -> Column:
    """A constant map, parsed in one go (a call per entry would dominate plan building)."""
    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr("map(" + ", ".join(quoted(x) for pair in entries.items() for x in pair) + ")")


def carrier_exact(value: Column) -> Column:
    return F.element_at(literal_map(carrier_vocabulary()), carrier_key(value))


def carrier(value: Column) -> Column:
    """Canonical carrier by exact key, then by closest key; unknown carriers are kept as a tidied name."""
    vocabulary = carrier_vocabulary()
    lookup = literal_map(vocabulary)
    exact = carrier_exact(value)
    near = closest(F.when(exact.isNull(), carrier_key(value)), list(vocabulary), fv.CARRIER_CUTOFF)
    return F.coalesce(exact, F.element_at(lookup, near), name(value))


# A piece of text every match of the carrier pattern holds, in the order of the patterns: a plain substring search
# spares most texts the pattern itself.
_MENTION_PIECES = ["bureau", "farm", "progr", "co", "usaa", "allstate", "liberty", "hartford", "auto", "aaa", "national",
                   "nation", "mercury", "cincinnati", "direct", "auto", "brist", "root", "travelers", "farmers",
                   "assurance", "alpha", "insurance"]


def carrier_mention(value: Column) -> Column:
    """First carrier pattern (in order of precedence) found in free text."""
    # the letters that case-insensitive patterns equate with i, s and k
    folded = F.lower(F.translate(value, "\u0131\u0130\u017f\u212a", "iisk"))

    def search(low: Column) -> Column:
        chain = None
        for piece, (pattern, name) in zip(_MENTION_PIECES, fv.CARRIER_MENTIONS, strict=True):
            hit = low.contains(piece) & value.rlike(f"(?iU){pattern}")
            chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
        return chain

    return let(folded, search)


def age_years(birth: Column, as_of: Column) -> Column:
    """Completed years between two dates."""
    before_birthday = F.date_format(as_of, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(as_of) - F.year(birth) - F.when(before_birthday, F.lit(1)).otherwise(F.lit(0))


def canonical_name(value: Column, nicknames: dict[str, str]) -> Column:
    """Lower-case letters and single spaces, with the first word replaced by its full form."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z ]", ""), " +", " "))
    full = literal_map(nicknames or {"": ""})

    def expand(v: Column) -> Column:
        first = F.substring_index(v, " ", 1)
        return F.concat(F.coalesce(F.element_at(full, first), first), v.substr(F.length(first) + 1, F.length(v)))

    return let(flat, expand)


Standardizer = Callable[[Column, Column], Column]

_TYPES: dict[str, Standardizer] = {
    "text": lambda v, as_of: text(v),
    "name": lambda v, as_of: name(v),
    "date": date,
    "datetime": datetime,
    "phone": lambda v, as_of: phone(v),
    "zip": lambda v, as_of: zip_code(v),
    "homeowner": lambda v, as_of: homeowner(v),
    "int": lambda v, as_of: integer(v),
    "carrier": lambda v, as_of: carrier(v),
    "email": lambda v, as_of: email(v),
}


def register_type(type_name: str, standardizer: Standardizer) -> None:
    """Add a value type: ``standardizer(value, as_of)`` returns the standardized Column."""
    _TYPES[type_name] = standardizer


def standardize(value: Column, type_name: str, as_of: Column) -> Column:
    if type_name not in _TYPES:
        raise ValueError(f"unknown value type: {type_name}")
    return _TYPES[type_name](value, as_of)
