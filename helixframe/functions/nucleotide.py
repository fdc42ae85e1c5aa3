"""Column expressions on nucleotide letters. All are built-in functions, so Catalyst compiles them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that a sequence may hold, with their complements at the same place (fixed values).
LETTERS = "abcdghkmnrstvwy"
COMPLEMENTS = "tvghcdmknysabwr"
_CASED = LETTERS + LETTERS.upper()
_CASED_COMPLEMENTS = COMPLEMENTS + COMPLEMENTS.upper()
#: Which nucleotide each letter of ordinary text stands for: a, c, g and t in turn.
TEXT_LETTERS = "abcdefghijklmnopqrstuvwxyz"
TEXT_BASES = ("acgt" * 7)[:26]
_NO_LETTERS = "".join(chr(i) for i in range(1, 128) if not chr(i).isalpha())


def clean(x: Column) -> Column:
    """Letters of the alphabet only, in lower case; u becomes t and i becomes c, all else goes."""
    kept = F.regexp_replace(x, "[^abcdghikmnrstuvwyABCDGHIKMNRSTUVWY]", "")
    return F.translate(kept, "uiABCDGHIKMNRSTUVWY", "tcabcdghckmnrsttvwy")


def clean_keep_case(x: Column) -> Column:
    """Letters of the alphabet only, in their case."""
    kept = F.regexp_replace(x, "[^abcdghikmnrstuvwyABCDGHIKMNRSTUVWY]", "")
    return F.translate(kept, "uiUI", "tcTC")


def lenient(x: Column) -> Column:
    """As clean(), with a few more letters taken for bases: e a, f c, j g, l t; and i g."""
    kept = F.regexp_replace(x, "[^abcdefghijklmnrstuvwyABCDEFGHIJKLMNRSTUVWY]", "")
    return F.translate(kept, "efjliuABCDEFGHIJKLMNRSTUVWY", "acgtgtabcdacghggktmnrsttvwy")


def from_text(x: Column) -> Column:
    """A nucleotide sequence from the ASCII letters of any text, equal for equal letters."""
    # other ASCII signs go with the letters' pass, so that the pattern has little to replace
    bases = F.translate(F.coalesce(x, F.lit("")), TEXT_LETTERS + TEXT_LETTERS.upper() + _NO_LETTERS, TEXT_BASES * 2)
    return F.regexp_replace(bases, "[^acgt]+", "")


#: The same where rare letters are no base: gaps, and ambiguous ones.
GAPPED_BASES = "".join({"j": "n", "q": "n", "x": "n", "z": "n", "k": "r", "y": "y"}.get(letter, base) for letter, base in zip(TEXT_LETTERS, TEXT_BASES, strict=True))


def from_text_with_gaps(x: Column) -> Column:
    """from_text() where j, q, x and z are gaps, and k and y ambiguous letters."""
    kept = F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z]", "")
    return F.translate(kept, TEXT_LETTERS + TEXT_LETTERS.upper(), GAPPED_BASES * 2)


def complement(x: Column) -> Column:
    return F.translate(x, _CASED, COMPLEMENTS * 2)


def reverse_complement(x: Column) -> Column:
    return F.reverse(complement(x))


def reverse_complement_keep_case(x: Column) -> Column:
    return F.reverse(F.translate(x, _CASED, _CASED_COMPLEMENTS))


def base_codes(x: Column) -> Column:
    """a 0, t 1, c 2, g 3, any other letter 4."""
    return F.translate(F.regexp_replace(x, "[^atcg]", "n"), "atcgn", "01234")


def complement_codes(x: Column) -> Column:
    return F.translate(x, "0123", "1032")


def count_of(x: Column, letters: str) -> Column:
    """How many of the letters (a regular expression's class) x has."""
    return F.length(F.regexp_replace(x, f"[^{letters}]", "")).cast("long")


def ambiguous(x: Column) -> Column:
    """Letters that are none of a, c, g, t."""
    return (F.length(x) - count_of(x, "acgtACGT")).cast("long")


def gaps(x: Column) -> Column:
    return count_of(x, "nN")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole != 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def wrapped(x: Column, width: int = 70) -> Column:
    return F.regexp_replace(x, f"(.{{{width}}})(?=.)", "$1\n")


def kmer_letters(packed: Column, k: int) -> Column:
    """The letters of a k-mer that packs two bits a base (a 0, c 1, g 2, t 3)."""
    letter = lambda j: F.substr(F.lit("acgt"), (F.shiftright(packed, 2 * j).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))
    return F.concat(*[letter(j) for j in range(k - 1, -1, -1)])


def svg_step(rows: Column) -> Column:
    """Distance of picture rows by their number (fixed values of the format)."""
    return reduce(lambda acc, x: F.when(rows > x[0], x[1]).otherwise(acc), ((100, 14), (200, 13), (300, 12), (400, 11), (500, 10)), F.lit(16))


def escaped(x: Column) -> Column:
    """x as text of XML."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def thousands(x: Column) -> Column:
    """A whole number with a comma before each three digits."""
    return F.format_number(x, 0)


def lenient_int_of(x: Column) -> Column:
    """lenient_int() of a column."""
    head = F.regexp_extract(x, r"^([^.,]*)", 1)
    digits = F.substr(F.regexp_replace(head, "[^0-9]", ""), F.lit(1), F.lit(11))
    value = F.when(F.startswith(F.regexp_replace(head, r"^\s+", ""), F.lit("-")), -digits.try_cast("long")).otherwise(digits.try_cast("long"))
    return F.when(digits != "", F.greatest(F.lit(-(2**31)), F.least(F.lit(2**31 - 1), value))).cast("long")


def lenient_int(text: str) -> int | None:
    """The digits of text up to a point or comma, as an integer of 32 bits at most; None without a digit."""
    head = text.replace(",", ".").split(".")[0]
    digits = "".join(c for c in head if c.isascii() and c.isdigit())[:11]
    if not digits:
        return None
    value = -int(digits) if head.strip().startswith("-") else int(digits)
    return max(-(2**31), min(2**31 - 1, value))
