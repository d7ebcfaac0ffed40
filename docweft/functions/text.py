"""Column functions over text, following Python's string rules where the results depend on them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, functions as F

# ---- fixed values: characters that Python's str.strip / str.splitlines treat as blank / line end --
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = (
    " \t" + LINE_ENDS + "\x1f\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
)
LINE_END_PATTERN = "\r\n|[" + LINE_ENDS + "]"
BLANK_CLASS = "[" + BLANKS + "]"
NON_BLANK_CLASS = "[^" + BLANKS + "]"
PAGE_MARKER = r"\[Page (\d+)\]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_END_PATTERN, -1)


def normalize_text(text: Column) -> Column:
    """Right-strip every line, then strip the whole text."""
    return strip(F.array_join(F.transform(split_lines(text), rstrip), "\n"))


def visible_length(text: Column) -> Column:
    """Number of characters that are not blank."""
    return F.length(F.regexp_replace(text, BLANK_CLASS, ""))


def append_note(notes: Column, note: Column) -> Column:
    """Add `note` to `notes`, separated by a space; a null note leaves the notes as they are."""
    joined = F.when(F.coalesce(notes, F.lit("")) == "", note).otherwise(strip(F.concat_ws(" ", notes, note)))
    return F.when(note.isNull(), notes).otherwise(joined)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Half-open, zero-based slice of code points."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def python_repr(text: Column) -> Column:
    """A string in single quotes, or in double quotes when it holds a single quote only."""
    use_double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(use_double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.regexp_replace(text, "'", "\\\\\\\\'"), F.lit("'")))


def python_bool(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")


def fixed_decimals(number: Column, places: int = 2, grouped: bool = False) -> Column:
    """Decimal text rounded half-even on the exact binary value, as Python's format() does."""
    pattern = ("#,##0" if grouped else "0") + ("." + "0" * places if places else "")
    return F.call_function("format_number", number, F.lit(pattern))


def money(amount: Column) -> Column:
    """Round to cents, half up on the shortest decimal text of the double."""
    return F.round(amount.cast("string").cast("decimal(38,16)"), 2).cast("double")


def python_number(number: Column) -> Column:
    """A double as Python's str() writes it: no exponent from 0.0001 up to 1e16, else one of two digits at least."""
    size, plain = F.abs(number), number.cast("string")
    digits = F.regexp_replace(plain.cast("decimal(38,22)").cast("string"), "0+$", "")
    wide = F.regexp_replace(F.regexp_replace(F.format_string("%.9f", number), "0+$", ""), r"\.$", ".0")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\.0E", "E"), r"E(\d)", "e+$1"), "E-", "e-")
    return (
        F.when((size >= 1e7) & (size < 1e16), wide)
        .when((size >= 1e-4) & (size < 1e-3), digits)
        .when((size >= 1e16) | (size < 1e-4) & (size > 0), F.regexp_replace(power, r"e([+-])(\d)$", "e$10$2"))
        .otherwise(plain)
    )


@cache
def _folds() -> list[str]:
    """Characters whose folded case is not their lower case, such as `ß` (ss) and `ς` (σ), each followed by it; by rule."""
    return [x for c in map(chr, range(128, 0x20000)) if c.casefold() != c.lower() for x in (c, c.casefold())]


def fold_case(text: Column) -> Column:
    """Lower case for comparing, as Python's str.casefold(); only texts beyond ASCII are gone through letter by letter."""
    special = F.create_map(*map(F.lit, _folds()))

    def folded(letter: Column) -> Column:
        return F.when(F.ascii(letter) < 128, F.lower(letter)).otherwise(F.coalesce(F.try_element_at(special, letter), F.lower(letter)))

    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.array_join(F.transform(F.split(text, ""), folded), ""))
