"""Text columns: accent folding, white space, casing, HTML to text."""

from __future__ import annotations

import unicodedata

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.fixed import SPACE, SPACE_CHARS


def _accent_table() -> tuple[str, str]:
    """Every character of any script that decomposes to one other character plus combining marks."""
    marked, plain = [], []
    for code in [*range(0x0080, 0xD800), *range(0xE000, 0x10000)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not "\u0300" <= c <= "\u036f")
        if len(base) == 1 and base != chr(code):
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _accent_table()
#: Marks that stand on their own go: signs to translate that have no counterpart.
MARKS = "".join(map(chr, range(0x0300, 0x0370)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression, so it is computed once."""
    return F.transform(F.array(value), use)[0]


def fold(col: Column) -> Column:
    """Lower case without accents: ``Piña`` gives ``pina``."""
    return F.translate(F.lower(col), MARKED + MARKS, PLAIN)


def fold_to(col: Column, others: dict[str, str]) -> Column:
    """``fold``, and then other signs for some, in one pass over the text."""
    known = dict(zip(MARKED, (others.get(c, c) for c in PLAIN), strict=True))
    known = {c: others.get(c, c) for c in others} | known
    return F.translate(F.lower(col), "".join(known) + MARKS, "".join(known.values()))


def fold_text(df: DataFrame, *columns: str, suffix: str = "_folded") -> DataFrame:
    """Add a folded copy of each named text column."""
    return df.withColumns({f"{name}{suffix}": fold(F.col(name)) for name in columns})


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(col, F.lit(SPACE_CHARS))


#: White space that is not one blank already: most texts have none and are not written anew, most signs are passed by at once.
_LOOSE = rf"(?=[^\x21-\x7f])(?: (?={SPACE}){SPACE}+|(?! ){SPACE}+)"


def squeeze(col: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col, _LOOSE, " "))


def words(col: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(squeeze(col), " "), lambda w: w != "")


def blank_to_null(col: Column) -> Column:
    return F.when(strip(col) != "", col)


def capitalise_first(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substr(col, F.lit(2)))


def tidy_name(col: Column) -> Column:
    """Lower case with a capital after the start, a blank, ``(``, ``/`` or ``-``."""
    opened = F.regexp_replace(F.lower(squeeze(col)), r"([(/-])(\p{L})", "$1\u0001 $2")
    return F.replace(F.initcap(opened), F.lit("\u0001 "), F.lit(""))


def tidy_case(col: Column) -> Column:
    """Lower a text that is mostly capitals, then raise its first letter."""
    capitals = F.length(F.regexp_replace(col, r"[^\p{Lu}]", ""))
    smalls = F.length(F.regexp_replace(col, r"[^\p{Ll}]", ""))
    return capitalise_first(F.when(capitals > smalls, F.lower(col)).otherwise(col))


# The named entities that are decoded.
ENTITIES = (("amp", "&"), ("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("nbsp", " "))


def _code_point(digits: Column, base: int) -> Column:
    """The character of a code point, built from its UTF-8 bytes."""
    code = F.conv(digits, base, 10).cast("long")
    tail = lambda shift: F.lit(0x80) + F.shiftright(code, shift).bitwiseAND(F.lit(0x3F))
    number = (
        F.when(code < 0x80, code)
        .when(code < 0x800, (F.lit(0xC0) + F.shiftright(code, 6)) * 256 + tail(0))
        .when(code < 0x10000, ((F.lit(0xE0) + F.shiftright(code, 12)) * 256 + tail(6)) * 256 + tail(0))
        .otherwise((((F.lit(0xF0) + F.shiftright(code, 18)) * 256 + tail(12)) * 256 + tail(6)) * 256 + tail(0))
    )
    return F.decode(F.unhex(F.hex(number)), "UTF-8")


def _decode_numeric(col: Column, pattern: str, base: int) -> Column:
    """Replace every numeric entity by its character, left to right in one pass over the split text."""

    def glue(text: Column) -> Column:
        codes = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        parts = F.split(text, pattern.replace("([", "(?:["), -1)
        glued = F.zip_with(
            parts, codes, lambda part, code: F.concat(part, F.when(code.isNull(), "").otherwise(_code_point(code, base)))
        )
        return F.when(F.contains(text, F.lit("&#")), F.array_join(glued, "")).otherwise(text)

    return let(col, glue)


def html_to_text(col: Column) -> Column:
    """Tags to blanks, entities decoded, double quotes dropped, white space squeezed."""
    text = F.regexp_replace(col, "<[^>]*>", " ")
    text = _decode_numeric(text, "&#([0-9]+);", 10)
    text = _decode_numeric(text, "(?i:&#x)([0-9a-fA-F]+);", 16)
    # One pass over the named entities: '&amp;lt;' must stay '&lt;'.
    text = F.replace(text, F.lit("&amp;"), F.lit("\u0001"))
    for name, value in ENTITIES[1:]:
        text = F.regexp_replace(text, f"(?i)&{name};", value)
    text = F.regexp_replace(text, "(?i)&amp;|\u0001", "&")
    return squeeze(F.regexp_replace(text, '[“”"]', ""))
