"""Stems of English and Russian words by the published Snowball suffix rules, as Arrow UDFs:
a rule depends on what earlier ones have left, and on regions of the word."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The English rules.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_LATER = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
PREFIXES = ("gener", "commun", "arsen")
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
# The Russian rules. Endings of a first group count after а or я only.
RUSSIAN_VOWELS = "аеиоуыэюя"
GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
REFLEXIVE = ("ся", "сь")
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
)
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
DERIVATIONAL = ("ост", "ость")
SUPERLATIVE = ("ейш", "ейше")


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where what follows the first vowel and consonant from ``start`` on begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _short_end(word: str) -> bool:
    """The word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def english_stem(word: str) -> str:
    """The Snowball stem of a lower-case English word."""
    if len(word) <= 2 or word in KEPT:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.removeprefix("'")
    # A y at the start or after a vowel is a consonant.
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) and not (i and w[i - 1] == "y" and i > 1 and w[i - 2] in VOWELS) else c for i, c in enumerate(w))
    first = next((len(p) for p in PREFIXES if w.startswith(p)), _region(w, VOWELS))
    second = _region(w, VOWELS, first)
    within = lambda end, at: len(w) - len(end) >= at

    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in KEPT_LATER:
        return w

    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if within(end, first):
            w = w[: -len(end)] + "ee"
    elif end and any(c in VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif first >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"

    end = _longest(w, SECOND)
    if end and within(end, first):
        before = w[: -len(end)][-1:]
        if (end != "ogi" or before == "l") and (end != "li" or before in LI_ENDINGS):
            w = w[: -len(end)] + SECOND[end]
    end = _longest(w, THIRD)
    if end and within(end, first) and (end != "ative" or within(end, second)):
        w = w[: -len(end)] + THIRD[end]
    end = _longest(w, FOURTH)
    if end and within(end, second) and (end != "ion" or w[: -len(end)][-1:] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (within("e", second) or within("e", first) and not _short_end(w[:-1])) or w.endswith("ll") and within("l", second):
        w = w[:-1]
    return w.replace("Y", "y")


def _cut(tail: str, groups) -> str | None:
    """The tail without its longest ending of two groups, the first of which counts after а
    or я only; None without one."""
    found = [e for e in groups[0] if tail.endswith(e) and tail[: -len(e)][-1:] in ("а", "я")] + [e for e in groups[1] if tail.endswith(e)]
    return tail[: -len(max(found, key=len))] if found else None


def russian_stem(word: str) -> str:
    """The Snowball stem of a lower-case Russian word."""
    word = word.replace("ё", "е")
    at = next((i + 1 for i, c in enumerate(word) if c in RUSSIAN_VOWELS), len(word))
    second = _region(word, RUSSIAN_VOWELS, _region(word, RUSSIAN_VOWELS))
    head, tail = word[:at], word[at:]
    cut = _cut(tail, GERUND)
    if cut is None:
        end = _longest(tail, REFLEXIVE)
        tail = tail[: -len(end)] if end else tail
        end = _longest(tail, ADJECTIVE)
        if end:
            cut = tail[: -len(end)]
            rest = _cut(cut, PARTICIPLE)
            cut = cut if rest is None else rest
        else:
            cut = _cut(tail, VERB)
            if cut is None:
                cut = _cut(tail, ((), NOUN))
    tail = (tail if cut is None else cut).removesuffix("и")
    end = _longest(tail, DERIVATIONAL)
    if end and len(head) + len(tail) - len(end) >= second:
        tail = tail[: -len(end)]
    end = _longest(tail, SUPERLATIVE)
    tail = tail[: -len(end)] if end else tail
    if tail.endswith("нн"):
        tail = tail[:-1]
    elif not end:
        tail = tail.removesuffix("ь")
    return head + tail


STEMMERS: dict[str, Callable[[str], str]] = {"en": english_stem, "ru": russian_stem}


def stemmer(language: str) -> Callable[[Column], Column]:
    """Stems of lower-cased words of a language, as a column function for
    ``add_lemma_and_stem`` and ``Models.stem``. Nulls stay null; each word of a batch is
    stemmed once."""
    rule = STEMMERS[language]

    def run(words: pd.Series) -> pd.Series:
        low = words.str.lower()
        return low.map({w: rule(w) for w in low.dropna().unique()})

    stem = F.pandas_udf(run, "string")

    def of(word: Column) -> Column:
        return stem(word)

    return of
