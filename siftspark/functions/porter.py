"""The Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_STEP2 = dict(
    x.split(":")
    for x in (
        "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize "
        "ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
    ).split()
)
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[i - 1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and len(word) > 2 and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    end = next((e for e in sorted(table, key=len, reverse=True) if word.endswith(e)), None)
    return word[: -len(end)] + table[end] if end and _measure(word[: -len(end)]) > least - 1 else word


def stem(word: str) -> str:
    """As the full-text engine does: digits and the bytes of other letters are consonants, and words of under 3 or over 64
    bytes stay."""
    if not word.isascii():
        return _stem(word.encode().decode("latin-1")).encode("latin-1").decode(errors="ignore")
    return _stem(word)


def _stem(word: str) -> str:
    if not 3 <= len(word) <= 64:
        return word
    if word.endswith("sses") or word.endswith("ies") and len(word) > 3:
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((len(e) for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), 0)
        if cut:
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, _STEP2, 1)
    word = _swap(word, _STEP3, 1)
    end = next((e for e in sorted(_STEP4, key=len, reverse=True) if word.endswith(e)), None)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e"):
        head = word[:-1]
        if _measure(head) > 1 or _measure(head) == 1 and not _cvc(head):
            word = head
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


# --- the same on columns ---------------------------------------------------------------------------


def _shape_of(word: Column) -> Column:
    """As ``_shape``. A y is a vowel if an even number of y stand between it and a consonant, or an odd number between
    it and a vowel or the beginning."""
    plain = F.regexp_replace(F.regexp_replace(word, "[^aeiouy]", "c"), "[aeiou]", "v")
    told = F.regexp_replace(plain, "(?<=c(?:yy){0,32})y|(?<=vy(?:yy){0,32})y|(?<=^y(?:yy){0,32})y", "v")
    return F.when(plain.contains("y"), F.translate(told, "y", "c")).otherwise(plain)


def _over(shape: Column, n: int) -> Column:
    """Whether the measure is above ``n``."""
    return shape.contains("vc") if n == 0 else shape.rlike("vc" + ".*vc" * n)


def _short_end(word: Column, shape: Column) -> Column:
    return F.endswith(shape, F.lit("cvc")) & ~F.right(word, F.lit(1)).isin("w", "x", "y")


def stem_of(word: Column | str) -> Column:
    """The stem of a column of words, equal to ``stem``: built-in functions only. Each step binds its word and shape once
    (``let``), so the expression grows with the steps and not with what each of them reads. The shape is told once: a
    cut shortens both, and what is put on has no y, whose kind depends on what stands before it."""
    word = F.col(word) if isinstance(word, str) else word
    pair = lambda w, s: F.struct(w.alias("w"), s.alias("s"))
    less = lambda c, n: F.left(c, F.length(c) - n)
    cut = lambda b, n: pair(less(b["w"], n), less(b["s"], n))

    def put(b: Column, n: int, end: str) -> Column:
        """The last ``n`` letters replaced by ``end``."""
        return pair(F.concat(less(b["w"], n), F.lit(end)), F.concat(less(b["s"], n), F.lit(_shape(end))))

    def ends(b: Column, *xs: str) -> Column:
        return functools.reduce(lambda x, y: x | y, (F.endswith(b["w"], F.lit(x)) for x in xs))

    def swapped(table: dict[str, str]) -> Callable[[Column], Column]:
        def value(b: Column) -> Column:
            out = b
            for end, new in sorted(table.items(), key=lambda x: len(x[0])):  # the longest is tested first
                out = F.when(ends(b, end), F.when(_over(less(b["s"], len(end)), 0), put(b, len(end), new)).otherwise(b)).otherwise(out)
            return out

        return value

    def plural(b: Column) -> Column:
        return F.when(ends(b, "sses") | ends(b, "ies") & (F.length(b["w"]) > 3), cut(b, 2)).when(ends(b, "s") & ~ends(b, "ss"), cut(b, 1)).otherwise(b)

    def mended(b: Column) -> Column:
        double = b["w"].rlike(r"(?s)(.)\1$") & F.endswith(b["s"], F.lit("c")) & ~F.right(b["w"], F.lit(1)).isin("l", "s", "z")
        short = _over(b["s"], 0) & ~_over(b["s"], 1) & _short_end(b["w"], b["s"])
        return F.when(ends(b, "at", "bl", "iz"), put(b, 0, "e")).when(double, cut(b, 1)).when(short, put(b, 0, "e")).otherwise(b)

    def past(b: Column) -> Column:
        without = lambda n: F.when(less(b["s"], n).contains("v"), let(cut(b, n), mended)).otherwise(b)
        return F.when(ends(b, "eed"), F.when(_over(less(b["s"], 3), 0), cut(b, 1)).otherwise(b)).when(ends(b, "ed"), without(2)).when(ends(b, "ing"), without(3)).otherwise(b)

    def last_y(b: Column) -> Column:
        return F.when(ends(b, "y") & less(b["s"], 1).contains("v"), put(b, 1, "i")).otherwise(b)

    def fourth(b: Column) -> Column:
        out = b
        for end in sorted(_STEP4, key=len):
            gone = _over(less(b["s"], len(end)), 1) & (ends(b, "sion", "tion") if end == "ion" else F.lit(True))
            out = F.when(ends(b, end), F.when(gone, cut(b, len(end))).otherwise(b)).otherwise(out)
        return out

    def last_e(b: Column) -> Column:
        shape = less(b["s"], 1)
        return F.when(ends(b, "e") & (_over(shape, 1) | _over(shape, 0) & ~_short_end(less(b["w"], 1), shape)), cut(b, 1)).otherwise(b)

    def last_l(b: Column) -> Column:
        return F.when(ends(b, "ll") & _over(b["s"], 1), cut(b, 1)).otherwise(b)

    steps = [plural, past, last_y, swapped(_STEP2), swapped(_STEP3), fourth, last_e, last_l]

    def whole(w: Column) -> Column:
        told = functools.reduce(let, steps, pair(w, _shape_of(w)))["w"]
        return F.when(F.length(w).between(3, 64), told).otherwise(w)

    # bytes of other letters are one consonant each; part of a letter that is left over is dropped
    ascii_only = lambda w: F.length(w) == F.octet_length(w)
    bytes_of = lambda w: F.when(ascii_only(w), w).otherwise(F.decode(F.encode(w, "UTF-8"), "ISO-8859-1"))
    back = lambda x: F.replace(F.make_valid_utf8(F.encode(x, "ISO-8859-1").cast("string")), F.lit("\ufffd"), F.lit(""))
    return let(word, lambda w: let(let(bytes_of(w), whole), lambda x: F.when(ascii_only(w), x).otherwise(back(x))))
