"""English stems of words by the published rules of Porter's second stemmer, as a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published lists of words and suffixes. Y is a y that counts as a consonant.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because "
    "as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Suffixes that are replaced in the first region, in the second and third step.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "(?<=l)ogi": "og", "fulli": "ful", "lessli": "less", "(?<=[cdeghkmnrt])li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Suffixes that go in the second region.
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "(?<=[st])ion")

_V, _C = "[aeiouy]", "[^aeiouy]"
_REGION = f"^{_C}*{_V}+{_C}"
_SHORT = f"(?:{_C}{_V}[^aeiouywxY]|^{_V}{_C})$"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once."""
    return F.transform(F.array(x), f)[0]


def _less(w: Column, n: int | Column) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _ending(w: Column, suffixes) -> Column:
    """The longest of the suffixes that a word ends with, or nothing."""
    return F.regexp_extract(w, f"(?:{'|'.join(suffixes)})$", 0)


def _replaced(w: Column, table: dict[str, str], region: Callable[[Column], Column]) -> Column:
    plain = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k.rsplit(")", 1)[-1], v)])

    def swap(end: Column) -> Column:
        base = _less(w, F.length(end))
        return F.when((end != "") & (F.length(base) >= region(end)), F.concat(base, F.try_element_at(plain, end))).otherwise(w)

    return _let(_ending(w, table), swap)


def _plural(w: Column) -> Column:
    s = F.when(w.rlike("sses$") | w.rlike("..ie[ds]$"), _less(w, 2)).when(w.rlike("ie[ds]$"), _less(w, 1))
    return s.when(w.rlike("[us]s$"), w).when(w.rlike(f"{_V}.+s$"), _less(w, 1)).otherwise(w)


def _past(w: Column, r1: Column) -> Column:
    def mended(base: Column) -> Column:
        again = base.rlike("(?:at|bl|iz)$") | (base.rlike(_SHORT) & (F.length(base) <= r1))
        return F.when(base.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _less(base, 1)).when(again, F.concat(base, F.lit("e"))).otherwise(base)

    def cut(end: Column) -> Column:
        base, kept = _less(w, F.length(end)), end.isin("eed", "eedly")
        return F.when((end == "") | (kept & (F.length(base) < r1)), w).when(kept, F.concat(base, F.lit("ee"))).when(base.rlike(_V), _let(base, mended)).otherwise(w)

    return _let(_ending(w, ["eedly", "eed", "edly", "ed", "ingly", "ing"]), cut)


def _last(w: Column, r1: Column, r2: Column) -> Column:
    base = _less(w, 1)
    n = F.length(base)
    goes = (w.endswith("e") & ((n >= r2) | ((n >= r1) & ~base.rlike(_SHORT)))) | (w.endswith("ll") & (n >= r2))
    return F.when(goes, base).otherwise(w)


def _regular(w: Column) -> Column:
    """The stem of a word in which a y that counts as a consonant is Y."""
    first = F.length(F.regexp_extract(w, f"^(?:gener|commun|arsen)|{_REGION}", 0))
    r1 = F.when(first > 0, first).otherwise(F.length(w))

    def regions(r1: Column) -> Column:
        more = F.length(F.regexp_extract(F.substring(w, r1 + 1, F.length(w)), _REGION, 0))
        return F.struct(r1.alias("r1"), F.when(more > 0, r1 + more).otherwise(F.length(w)).alias("r2"))

    def steps(r: Column) -> Column:
        r1, r2 = r["r1"], r["r2"]
        verbs = lambda x: _let(_let(_past(x, r1), lambda y: F.regexp_replace(y, f"(?<=.{_C})[yY]$", "i")), nouns)
        nouns = lambda x: _let(_replaced(x, SECOND, lambda _: r1), lambda y: _let(_replaced(y, THIRD, lambda end: F.when(end == "ative", r2).otherwise(r1)), ends))
        ends = lambda x: _let(_replaced(x, dict.fromkeys(FOURTH, ""), lambda _: r2), lambda y: _last(y, r1, r2))
        return _let(_plural(w), lambda x: F.when(x.isin(*UNCHANGED), x).otherwise(verbs(x)))

    return F.lower(_let(_let(r1, regions), steps))


def stem(word: Column) -> Column:
    """The stem of a lower-case word. Words of two letters or fewer and all that isn't a to z stay as they are; null is null."""
    return _let(word, lambda w: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv]), w), F.when(w.rlike("^[a-z]{3,}$"), _let(F.regexp_replace(w, "^y|(?<=[aeiouy])y", "Y"), _regular)).otherwise(w)))


def beginning(stems: list[str]) -> str:
    """A pattern that fits the beginning of every word with one of these stems: a stem changes no more than its last letter, irregular ones aside."""
    odd = {w for w, s in IRREGULAR.items() if s in stems}
    return "^(?:" + "|".join(sorted({s[:-1] if len(s) > 1 else s for s in stems} | odd)) + ")"


def stemmed(rows: DataFrame, token_col: str = "token") -> DataFrame:
    """rows with the column stem, worked out once for each distinct word. Null words have none."""
    words = rows.select(token_col).where(F.col(token_col).isNotNull()).distinct().withColumn("stem", stem(F.col(token_col)))
    return rows.join(words, token_col, "left")
