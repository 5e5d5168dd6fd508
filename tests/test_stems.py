import random
import re

import pytest
from pyspark.sql import functions as F

from engram.functions.stems import IRREGULAR, STOP_WORDS, UNCHANGED, beginning, stem, stemmed
from engram.operators.cut import folder
from engram.operators.stemmed import search_stems
from engram.operators.text_index import TextIndex

# Words and stems as published with the rules.
PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc
constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit
knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knopp knopp knot knot knots knot
machines machin machinery machineri skies sky dying die news news inning inning generously generous communism communism rate rate hoping hope hopping hop cry cri by by say say ties tie cries cri gas gas this this""".split()


def by_hand(word):
    """The rules once more, letter by letter."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if not re.fullmatch("[a-z]{3,}", word):
        return word
    c = list(word)
    for i, x in enumerate(c):
        if x == "y" and (i == 0 or c[i - 1] in "aeiouy"):
            c[i] = "Y"
    w = "".join(c)
    vowel = lambda x: x in "aeiouy"

    def region(start):
        for i in range(start + 1, len(w)):
            if vowel(w[i - 1]) and not vowel(w[i]):
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), region(0))
    r2 = region(r1)
    short = lambda x: (len(x) == 2 and vowel(x[0]) and not vowel(x[1])) or (len(x) > 2 and not vowel(x[-3]) and vowel(x[-2]) and not vowel(x[-1]) and x[-1] not in "wxY")
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(map(vowel, w[:-2])):
        w = w[:-1]
    if w in UNCHANGED:
        return w.lower()
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if end.startswith("ee"):
                w = base + "ee" if len(base) >= r1 else w
            elif any(map(vowel, base)):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                    w = w[:-1]
                elif short(w) and r1 >= len(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and not vowel(w[-2]):
        w = w[:-1] + "i"
    second = dict(zip("tional enci anci abli entli izer ization ational ation ator alism aliti alli fulness ousli ousness iveness iviti biliti bli ogi fulli lessli li".split(), "tion ence ance able ent ize ize ate ate ate al al al ful ous ous ive ive ble ble og ful less -".split(), strict=True))
    third = dict(zip("tional ational alize icate iciti ical ful ness ative".split(), "tion ate al ic ic ic - - -".split(), strict=True))
    for table in (second, third):
        end = max((e for e in table if w.endswith(e)), key=len, default="")
        base = w[: len(w) - len(end)]
        ok = {"ogi": base.endswith("l"), "li": base != "" and base[-1:] in "cdeghkmnrt", "ative": len(base) >= r2}.get(end, True)
        if end and len(base) >= r1 and ok:
            w = base + table[end].replace("-", "")
    end = max((e for e in "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split() if w.endswith(e) and (e != "ion" or w[:-3].endswith(("s", "t")))), key=len, default="")
    if end and len(w) - len(end) >= r2:
        w = w[: -len(end)]
    n = len(w) - 1
    if (w.endswith("e") and (n >= r2 or (n >= r1 and not short(w[:-1])))) or (w.endswith("ll") and n >= r2):
        w = w[:-1]
    return w.lower()


def made_up(n):
    r = random.Random(7)
    parts = "b c d f g l m n r s t y a e i o u at iz bl og ff gg ing ed eed ly li ation al iti ness ful ive ize ement ion tion s es ies ied bility ousli er ic ate ll e y ative gener".split()
    return sorted({"".join(r.choice(parts) for _ in range(r.randint(1, 7))) for _ in range(n)})


def test_stems_by_rule(spark):
    pairs = dict(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True))
    words = sorted({*pairs, *STOP_WORDS, *IRREGULAR, *UNCHANGED, *made_up(6000), "", "a", "ab", "über", "naïve", "abc1", "123"})
    got = {r.word: r.stem for r in spark.createDataFrame([(w,) for w in words], "word string").repartition(8).select("word", stem(F.col("word")).alias("stem")).collect()}
    assert {w: got[w] for w in pairs} == pairs
    assert {w: (got[w], by_hand(w)) for w in words if got[w] != by_hand(w)} == {}
    # what a search looks at by its beginning
    assert [w for w in words if w and not re.match(beginning([got[w]]), w)] == []


def test_stems_of_rows(spark):
    rows = spark.createDataFrame([(1, "running"), (2, "running"), (3, None), (4, "")], "id int, token string")
    assert sorted((r.id, r.stem) for r in stemmed(rows).collect()) == [(1, "run"), (2, "run"), (3, None), (4, "")]
    assert stemmed(rows.limit(0)).count() == 0


WEIGHTS = {"name": 1.0, "notes": 0.1}
ROWS = [
    (1, "Machines", "the machine runs", 1), (2, "Machinery", None, 1), (3, None, "machined, machining; MACHINES", 1), (4, "State of the art", "arts and states", 2), (5, "", "", 1),
    (6, "art", "of the state", 2), (7, "running machine", "", 3), (8, "the", "the", 1), (8, "the", "the run", 1),
]


def brute(groups, row):
    """groups as they are asked, by hand: [[(negative, stems)]]."""
    fields = [[by_hand(w) for w in re.findall(r"[^\W_]+", (row[k] or "").lower())] for k in (1, 2)]
    has = lambda unit: any(f[i : i + len(unit)] == unit for f in fields for i in range(len(f)))
    asked = sorted({w for g in groups for negative, u in g if not negative for w in u})
    weights = [sorted([1.0] * fields[0].count(s) + [0.1] * fields[1].count(s), reverse=True) for s in asked]
    rank = sum(w / (k + 1) ** 2 for ws in weights for k, w in enumerate(ws)) / max(1, len(asked)) / 1.6449340668482264
    return rank if any(all(has(u) != negative for negative, u in g) for g in groups) else None


@pytest.mark.parametrize(
    ("query", "groups"),
    [
        ("machines", [[(False, ["machin"])]]), ("machinery", [[(False, ["machineri"])]]), ("the machine -runs", [[(False, ["machin"]), (True, ["run"])]]),
        ('"states of the arts"', [[(False, ["state", "of", "the", "art"])]]), ("arts or running machine", [[(False, ["art"])], [(False, ["run"]), (False, ["machin"])]]), ("-machines", [[(True, ["machin"])]]),
    ],
)
def test_search_by_stems(spark, query, groups):
    rows = spark.createDataFrame(ROWS, "id int, name string, notes string, rank int")
    got = [(r.id, round(r["rank"], 9)) for r in search_stems(rows, query, WEIGHTS, "id").collect()]
    want = [(r[0], round(brute(groups, r), 9)) for r in ROWS if brute(groups, r) is not None]
    assert got == sorted(want, key=lambda x: (-x[1], x[0]))


def test_search_without_words(spark):
    rows = spark.createDataFrame(ROWS, "id int, name string, notes string, tag int")
    assert [search_stems(rows, q, WEIGHTS, "id").count() for q in ("", "the", "the or of", '" "')] == [0, 0, 0, 0]
    assert search_stems(rows.limit(0), "machines", WEIGHTS, "id").count() == 0
    assert [r.id for r in search_stems(rows, "machines", WEIGHTS, "id", limit=1, where=F.col("tag") > 1).collect()] == [7]
    one = spark.createDataFrame([(1, "a cat")], "id int, name string")
    assert search_stems(one, "cats", {"name": 0.1}, "id").first()["rank"] == pytest.approx(0.06079271, abs=1e-7)


def test_index_of_stems(spark):
    index = TextIndex(spark, folder(spark, "stems"), buckets=4, english=True)
    texts = [(1, "Hoping the machines run"), (2, "machine hopes"), (3, "the machinery ran"), (4, None), (5, "running running machines")]
    index.add(spark.createDataFrame(texts[:3], "id long, content string"))
    index.add(spark.createDataFrame(texts[3:], "id long, content string"))
    found = lambda q: sorted(r.id for r in index.search(q).collect())
    assert [found(q) for q in ("machining", "hope", '"the machine"', "the", "runs machine", "machinery", "-run machines", '"run runs"')] == [[1, 2, 5], [1, 2], [1], [], [1, 5], [3], [2], [5]]
    index.remove(spark.createDataFrame([(5,)], "id long"))
    assert found("machining") == [1, 2]
