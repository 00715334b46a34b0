"""Text segmentation as column expressions: sentences, tokens, long-sentence parts and
overlapping chunks. Nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bound

# Titles, site suffixes and Russian abbreviations whose dots end no sentence.
TITLES = "Mr|St|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|Mt"
SITES = "com|net|org|io|gov|me|edu|ru|рф|su"
RU_TITLES = "г-н|г-жа|проф|акад|докт|инж|ген|полк|кап|лейт|серж|мл|ст"
RU_SHORT = r"т\.?\s?е|т\.?\s?к|и\.?\s?т\.?\s?[дп]|см|рис|табл|гл|стр|тыс|млн|млрд|руб|коп|кв|корп"

# Word boundaries by Unicode letters and numbers, as they are for the models' tokenizers.
_BEFORE = r"(?<![\p{L}\p{N}_])"
_AFTER = r"(?![\p{L}\p{N}_])"
_DOT, _STOP = "<prd>", "<stop>"
#: Unicode white space, as ``\s`` has it with the flag ``U``.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(_SPACE))


def squeeze_space(text: Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def _split(protected: Column, stops: str) -> Column:
    for mark in stops:
        protected = F.replace(protected, F.lit(mark), F.lit(mark + _STOP))
    parts = F.transform(F.split(F.replace(protected, F.lit(_DOT), F.lit(".")), _STOP, -1), strip)
    return F.filter(parts, lambda s: (s != "") & ~s.isin(*stops))


def _cut(stopped: Column, stops: str) -> Column:
    """Pieces of a padded text after its marked stops, without white space at their ends and
    lone stops: a piece ends with its stop, so only blanks after a mark, and the padding, go.
    Nothing is done piece by piece."""
    parts = F.split(F.trim(stopped), f"{_STOP}[{_SPACE}]*", -1)
    for lone in ("", *stops):
        parts = F.array_remove(parts, lone)
    return parts


def _common(text: Column) -> Column:
    text = F.regexp_replace(text, rf"(?iu)\.({SITES}){_AFTER}", f"{_DOT}$1")
    text = F.regexp_replace(text, rf"{_BEFORE}([A-Za-zА-Яа-я])\.", f"$1{_DOT}")
    return F.regexp_replace(text, r"(\p{Nd})\.(\p{Nd})", f"$1{_DOT}$2")


#: What ends an English sentence: a dot that is not protected, or another stop.
_ENDS = (
    rf"[.?!](?:(?<!\.)|(?!(?iu:{SITES}){_AFTER})(?<!{_BEFORE}[A-Za-zА-Яа-я]\.)"
    rf"(?<!{_BEFORE}(?:{TITLES})\.)(?!(?<=\p{{Nd}}\.)\p{{Nd}}))"
)


def sentences(text: Column) -> Column:
    """English sentences of a text; null and blank texts have none.

    Dots of titles, sites, single-letter initials and decimals are protected; every other
    ``.``, ``?`` and ``!`` ends a sentence. Initials are protected before ``Ph.D.`` is
    looked at, so its first dot does end one.

    Stops are looked for in one pass. Texts with marks of their own, or with digits between
    dots, of which every other dot is protected, go through the rules one by one.
    """
    padded = F.concat(F.lit(" "), strip(F.replace(text, F.lit("\n"), F.lit(" "))), F.lit(" "))

    def found(padded: Column) -> Column:
        odd = F.contains(padded, F.lit(_DOT)) | F.contains(padded, F.lit(_STOP)) | padded.rlike(r"\.\p{Nd}\.(?=\p{Nd})")
        protected = _common(F.regexp_replace(padded, rf"(?=[A-Z]){_BEFORE}({TITLES})\.", f"$1{_DOT}"))  # the first test is the quick one
        return F.when(odd, _split(protected, ".?!")).otherwise(_cut(F.regexp_replace(padded, _ENDS, f"$0{_STOP}"), ".?!"))

    return F.coalesce(bound(padded, found), F.array().cast("array<string>"))


def russian_sentences(text: Column) -> Column:
    """Russian sentences: all dots inside an abbreviation are protected; ``…`` ends one too."""
    padded = F.concat(F.lit(" "), strip(F.replace(text, F.lit("\n"), F.lit(" "))), F.lit(" "))
    protected = F.regexp_replace(padded, rf"(?iu){_BEFORE}({RU_TITLES})\.", f"$1{_DOT}")
    # Cut at abbreviations; odd pieces are the abbreviations themselves.
    marked = F.regexp_replace(protected, rf"(?iu){_BEFORE}((?:{RU_SHORT})\.)", "<abbr>$1<abbr>")
    pieces = F.transform(F.split(marked, "<abbr>", -1), lambda s, i: F.when(i % 2 == 1, F.replace(s, F.lit("."), F.lit(_DOT))).otherwise(s))
    return F.coalesce(_split(_common(F.array_join(pieces, "")), ".?!…"), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Words of the built-in tokenizer: dots dropped, parted by white space."""
    return F.filter(F.split(F.replace(text, F.lit("."), F.lit("")), r"\s+", -1), lambda w: w != "")


def _count_tokens(text: Column) -> Column:
    """The number of ``tokens``: what white space parts and is more than dots. Where single
    blanks part words, these are counted, as a pattern would make every word."""
    odd = (text == "") | text.startswith(" ") | text.endswith(" ") | text.startswith(".")
    for mark in ("  ", " .", "\t", "\n", "\x0b", "\f", "\r"):
        odd = odd | F.contains(text, F.lit(mark))
    blanks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(odd, F.regexp_count(text, F.lit(r"[^\s.]\S*"))).otherwise(blanks + 1)


tokens.count = _count_tokens


#: A text's sentences, and its tokens, as column functions or pandas UDFs.
Splitter = Callable[[Column], Column]
Tokenizer = Callable[[Column], Column]
PART = "struct<number:int,text:string,n:int>"


def sentence_parts(sents: Column, max_tokens: int, tokenize: Tokenizer = tokens) -> Column:
    """Array of ``PART``: sentences with their token counts; one over ``max_tokens`` is cut
    in parts of ``max_tokens - 2`` tokens, which keep its number.

    ``tokenize`` is a column function; one made of a model has an attribute ``sentences``,
    which takes the whole array (a UDF can't be applied inside one). One with an attribute
    ``count`` makes the tokens only of sentences that are cut.
    """
    usable = max(1, max_tokens - 2)
    if hasattr(tokenize, "sentences"):
        both = F.zip_with(sents, tokenize.sentences(sents), lambda s, t: F.struct(s.alias("text"), t.alias("t")))
        tokened = F.transform(both, lambda x, i: F.struct(i.alias("number"), x["text"].alias("text"), F.size(x["t"]).alias("n"), x["t"].alias("t")))
    elif hasattr(tokenize, "count"):
        tokened = F.transform(sents, lambda s, i: F.struct(i.alias("number"), s.alias("text"), tokenize.count(s).alias("n")))
    else:
        tokened = F.transform(sents, lambda s, i: F.struct(i.alias("number"), s.alias("text"), tokenize(s).alias("t")))
        tokened = F.transform(tokened, lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text"), F.size(x["t"]).alias("n"), x["t"].alias("t")))

    def cut(s: Column, t: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.ceil(s["n"] / usable).cast("int") - 1),
            lambda k: F.struct(
                s["number"].alias("number"),
                F.array_join(F.slice(t, k * usable + 1, F.lit(usable)), " ").alias("text"),
                F.least(F.lit(usable), s["n"] - k * usable).alias("n"),
            ),
        )

    def parts(s: Column) -> Column:
        pieces = F.flatten(F.transform(F.array(tokenize(s["text"])), lambda t: cut(s, t))) if hasattr(tokenize, "count") else cut(s, s["t"])
        return F.when(s["n"] > max_tokens, pieces).otherwise(F.array(F.struct(s["number"].alias("number"), s["text"].alias("text"), s["n"].alias("n"))))

    return F.flatten(F.transform(tokened, parts))


def chunk_ranges(counts: Column, max_tokens: int, overlap: int) -> Column:
    """Array of (first, last) positions of chunks over token ``counts``.

    A chunk closes before the part that would exceed ``max_tokens``. The next starts with
    the parts at its end that fit in ``overlap`` tokens, the last one always; the limit is
    not checked again, so such a chunk can exceed it. Overlap 0 starts afresh.
    """
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("count"), F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["at"] > acc["first"]) & (acc["count"] + n > max_tokens)
        current = F.reverse(F.slice(counts, acc["first"] + 1, acc["at"] - acc["first"]))
        # Parts kept from the end: (how many, their tokens, whether still keeping).
        kept = F.aggregate(
            current,
            F.struct(F.lit(0).alias("m"), F.lit(0).alias("t"), F.lit(True).alias("on")),
            lambda k, x: F.when(
                k["on"] & ((k["m"] == 0) | (k["t"] + x <= overlap)), F.struct((k["m"] + 1).alias("m"), (k["t"] + x).alias("t"), F.lit(True).alias("on"))
            ).otherwise(F.struct(k["m"].alias("m"), k["t"].alias("t"), F.lit(False).alias("on"))),
        )
        if overlap == 0:
            kept = F.struct(F.lit(0).alias("m"), F.lit(0).alias("t"))
        closed = F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), (acc["at"] - 1).alias("last"))))
        # One evaluation of ``kept``: bound by a one-element transform.
        after = F.transform(
            F.array(kept),
            lambda k: F.struct((acc["at"] - k["m"]).alias("first"), (k["t"] + n).alias("count"), (acc["at"] + 1).alias("at"), closed.alias("done")),
        )[0]
        plain = F.struct(acc["first"].alias("first"), (acc["count"] + n).alias("count"), (acc["at"] + 1).alias("at"), acc["done"].alias("done"))
        return F.when(full, after).otherwise(plain)

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["first"].alias("first"), (acc["at"] - 1).alias("last")))
        return F.when(acc["at"] > acc["first"], F.concat(acc["done"], last)).otherwise(acc["done"])

    return F.aggregate(counts, start, step, finish)


# The older English rules, in order (their order is what they mean).
LEGACY_RULES = [
    (r"(Mr|St|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|Mt)[.]", "$1<prd>"),
    (r"[.](com|net|org|io|gov|me|edu)", "<prd>$1"),
    (r"Ph\.D\.", "Ph<prd>D<prd>"),
    (r"\s([A-Za-z])[.] ", " $1<prd> "),
    (r"([A-Z][.][A-Z][.](?:[A-Z][.])?) (Mr|Mrs|Ms|Dr|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s|That\s|This\s|Wherever)", "$1<stop> $2"),
    (r"([A-Za-z])[.]([A-Za-z])[.]([A-Za-z])[.]", "$1<prd>$2<prd>$3<prd>"),
    (r"([A-Za-z])[.]([A-Za-z])[.]", "$1<prd>$2<prd>"),
    (r" (Inc|Ltd|Jr|Sr|Co)[.] (Mr|Mrs|Ms|Dr|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s|That\s|This\s|Wherever)", " $1<stop> $2"),
    (r" (Inc|Ltd|Jr|Sr|Co)[.]", " $1<prd>"),
    (r" ([A-Za-z])[.]", " $1<prd>"),
    (r"([0-9])[.]([0-9])", "$1<prd> $2 "),
    (r"\.\"", "\"."),
    ("!\"", "\"!"),
    (r"\?\"", "\"?"),
]


def legacy_sentences(text: Column) -> Column:
    """The older English rules: acronyms before sentence starters, name suffixes, a space
    put after a decimal dot; what follows the last stop is dropped."""
    t = F.replace(F.concat(F.lit(" "), text, F.lit("  ")), F.lit("\n"), F.lit(" "))
    for pattern, to in LEGACY_RULES:
        t = F.regexp_replace(t, pattern, to)
    for mark in ".?!":
        t = F.replace(t, F.lit(mark), F.lit(mark + _STOP))
    parts = F.split(F.replace(t, F.lit(_DOT), F.lit(".")), _STOP, -1)
    whole = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), strip)
    return F.coalesce(F.filter(whole, lambda s: s != "."), F.array().cast("array<string>"))
