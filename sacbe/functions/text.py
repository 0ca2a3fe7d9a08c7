"""Scalar text functions as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the method: letters, vowels and marks the counts rest on.
LETTERS = "a-záéíóúüñA-ZÁÉÍÓÚÜÑ"
WORD = f"[{LETTERS}]+"
STUDY_WORD = f"[{LETTERS}][{LETTERS}'-]*"
VOWELS = "aeoáéóAEOÁÉÓiuíúüIUÍÚÜ"
STRONG = "aeoáéóAEOÁÉÓ"
SENTENCE_END = "[.!?…]+"

#: Marks that stand apart come last: without a counterpart in PLAIN they are dropped.
MARKS = "\u0301\u0300\u0302\u0303\u0308\u0327"
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ" + "ºª" + MARKS
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCYoa"
#: Characters stripped from the ends of sentence pieces.
PIECE_EDGE = " \t\\-–—•·"


def text(c: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it uses several times, computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


#: Ligatures and what they stand for (fixed values).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def fold(c: Column) -> Column:
    """Lower case without accents and ligatures; the ellipsis becomes three dots."""
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return fold_word(F.replace(c, F.lit("…"), F.lit("...")))


def fold_word(c: Column) -> Column:
    """``fold`` of a word of the letters of LETTERS."""
    return F.lower(F.translate(c, ACCENTED, PLAIN))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """White-space separated pieces."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def words(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def word_count(c: Column) -> Column:
    return count(c, WORD)


def syllable_count(c: Column) -> Column:
    """Syllables of all words without a loop: vowel groups, one more per pair of neighbouring strong vowels, one per word without vowels."""
    return count(c, f"[{VOWELS}]+") + count(c, f"[{STRONG}]") - count(c, f"[{STRONG}]+") + count(c, WORD) - count(c, f"[{LETTERS}]*[{VOWELS}][{LETTERS}]*")


def roman(c: Column) -> Column:
    """Value of a roman numeral up to C in either case; null for anything else and for 0."""
    digits = F.filter(F.split(F.upper(c), ""), lambda x: x != "")
    value = F.transform(digits, lambda x: F.when(x == "I", 1).when(x == "V", 5).when(x == "X", 10).when(x == "L", 50).when(x == "C", 100))
    signed = F.transform(value, lambda v, i: F.when((i + 1 < F.size(value)) & (F.get(value, i + 1) > v), -v).otherwise(v))
    total = F.aggregate(signed, F.lit(0), lambda a, v: a + v)
    return F.when(F.exists(value, lambda v: v.isNull()) | (total == 0), None).otherwise(total)


def contains_folded(sentence: Column, term: Column) -> Column:
    """Whether a folded sentence holds a folded term as whole words."""
    return F.coalesce(F.regexp_like(sentence, F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(term, F.lit("\\E"), F.lit("")), F.lit(r"\E(?![a-z0-9])"))), F.lit(False))


def contains_term(sentence: Column, term: Column) -> Column:
    """Whether a sentence holds a term as whole words, case and accents aside."""
    return contains_folded(fold(sentence), fold(term))


_FAMILIES = ["aáàâäãå", "eéèêë", "iíìîï", "oóòôöõ", "uúùûü", "nñ", "cç", "yýÿ"]


def hide_term(sentence: Column, term: Column, gap: str = "_____") -> Column:
    """A sentence with every whole occurrence of a term, in any case and accents, replaced by a gap."""
    pattern = F.concat(F.lit(r"\Q"), F.replace(fold(term), F.lit("\\E"), F.lit("")), F.lit(r"\E"))
    for f in _FAMILIES:  # a letter of the folded term stands for its accented forms
        pattern = F.replace(pattern, F.lit(f[0]), F.lit(f"\\\\E[{f}]\\\\Q".replace("\\\\", "\\")))
    return F.regexp_replace(sentence, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), pattern, F.lit(r"(?![\p{L}\p{N}])")), F.lit(gap))


def cut_at_word(c: Column, most: int = 140) -> Column:
    """A text of more than ``most`` characters cut before the word that passes it, with an ellipsis."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most), " [^ ]*$", ""), F.lit("…")))


def option_key(c: Column) -> Column:
    """What two answer options are compared by."""
    return squeeze(F.lower(c))


def join_hyphens(c: Column) -> Column:
    """Words cut at a line's end joined again; before a capital the hyphen stays."""
    hyphen = "[-‐‑­¬]"
    kept = F.regexp_replace(c, rf"(\p{{L}}){hyphen}[ \t]*\n[ \t]*(\p{{Lu}})", "$1-$2")
    return F.regexp_replace(kept, rf"(\p{{L}}){hyphen}[ \t]*\n[ \t]*(\p{{L}})", "$1$2")


LEAST_LETTERS = 0.4


_APART = [(unicodedata.normalize("NFD", x), x) for x in ACCENTED if len(unicodedata.normalize("NFD", x)) == 2]


def composed(c: Column) -> Column:
    """Letters and marks that stand apart put together, for the accented letters of Western languages."""
    whole = c
    for apart, letter in _APART:
        whole = F.replace(whole, F.lit(apart), F.lit(letter))
    return F.when(c.rlike(f"[{MARKS}]"), whole).otherwise(c)


def clean_recognised(c: Column) -> Column:
    """Recognised text cleaned: marks set apart, ligatures, cut words, odd blanks, lines with too few letters, runs of blank lines."""
    c = composed(c)
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    lines = F.transform(F.split(join_hyphens(c), "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\u00a0\u2000-\u200b\u202f\u3000]+", " ")))
    kept = F.filter(lines, lambda x: (x == "") | (F.regexp_count(x, F.lit(r"\p{L}")) >= LEAST_LETTERS * F.regexp_count(x, F.lit(r"\S"))))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def normalize_extracted(c: Column) -> Column:
    """Text of a document file: cut words joined, soft line breaks undone, blanks and blank lines collapsed."""
    c = F.regexp_replace(c, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    c = F.regexp_replace(c, r"(?<![.\n:;])\n(?![\n\s]*[A-ZÁÉÍÓÚÑ0-9])", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def page_list(c: Column) -> Column:
    """Sorted distinct page numbers of ``[1, 2]`` or ``1,2``; null for anything else."""
    s = strip(c)
    return F.when(s.rlike(r"^\[?\s*\d{1,6}\s*(,\s*\d{1,6}\s*)*\]?$"), F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int")))))
