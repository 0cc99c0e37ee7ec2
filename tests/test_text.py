"""Text functions and similarities on inputs with known results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions import crossed
from affinis.functions import similarity as sim
from affinis.functions import text as tx
from affinis.functions.translit import folded, latin


def tokens(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = tx.fold_columns(df, {"f": "t"}).select("i", tx.clean_tokens(F.col("f")).alias("k")).collect()
    return [r.k for r in sorted(out)]


def test_tokens(spark):
    got = tokens(spark, "7704D", "01601", "000", "<NULL>", "None", "nan", "Café_Été", None, "", "10Th st²", "A&B (x)@y#z", "ﬁn①")
    assert got == [["7704", "d"], ["1601"], ["0"], [], [], [], ["cafe", "ete"], [], [], ["10", "th", "st", "2"], ["a", "b", "x", "y", "z"], ["fin", "1"]]


def skeletons(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = tx.fold_columns(df, {"f": "t"}).select("i", tx.name_skeleton(tx.clean_tokens(F.col("f"))).alias("k")).collect()
    return [" ".join(r.k) for r in sorted(out)]


def test_skeletons_of_two_scripts_meet(spark):
    assert skeletons(spark, "सुपर इम्पेक्स प्राइवेट लिमिटेड", "super impex private limited") == ["spr mpks prvt lmt"] * 2
    assert skeletons(spark, "station 12 quick city gym", "") == ["stsn kvk st jm", ""]


def test_latin():
    assert latin("अंक") == "ank" and latin("हां") == "haa" and latin("१२३") == "123" and latin("दुः") == "duh"
    assert latin("क‍ख") == "kkh" and latin("ਾੰ") == "aa" and latin("naïve") == "naïve"
    assert folded("क़") == "k"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_small_extractions(spark):
    t = F.col("t")
    assert one(spark, tx.postal_code(t), "12 a, 560 001 b 75001") == "75001" and one(spark, tx.postal_code(t), "560 001") == "560001" and one(spark, tx.postal_code(t), "12") is None
    assert one(spark, tx.parse_ids(t), " S2-1, ,S3-2,") == ["S2-1", "S3-2"] and one(spark, tx.parse_ids(t), None) == []
    assert one(spark, tx.safe_name(t), "Côte d'Or") == "C_te_d_Or"
    assert one(spark, tx.has_indic(t), "abc क") and not one(spark, tx.has_indic(t), None)
    assert one(spark, tx.empty_address(t), " <NULL> ") and one(spark, tx.empty_address(t), None) and not one(spark, tx.empty_address(t), "x")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def test_ratio_against_a_table():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 20))) for _ in range(2))
        assert sim.common_length(a, b) == lcs(a, b)
        short, long = sorted((a, b), key=len)
        windows = [long[max(0, e - len(short)) : e] for e in range(1, len(long) + len(short))]
        best = max((200 * lcs(short, w) / (len(short) + len(w)) for w in windows if short), default=100.0 if a == b else 0.0)
        assert sim.partial_ratio(a, b) == pytest.approx(best) if len(a) != len(b) or not a else sim.partial_ratio(a, b) >= best - 1e-9


def test_similarities_of_known_pairs():
    assert sim.ratio("", "") == 100 and sim.ratio("", "a") == 0 and sim.ratio("this is a test", "this is a test!") == pytest.approx(96.5517, abs=1e-3)
    assert sim.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100 and sim.token_set_ratio("", "") == 0 and sim.token_set_ratio("a b", "c d") == pytest.approx(200 / 6)
    assert sim.partial_ratio("this is a test", "this is a test!") == 100 and sim.partial_ratio("", "") == 100 and sim.partial_ratio("", "x") == 0
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and sim.jaro_winkler("", "") == 0 and sim.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)


def test_similarities_of_batches():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    a = [word(rng.choice([0, 1, 3, 20, 64, 65, 130, 200])) for _ in range(150)] + ["same", "", "", "\U0001f600x"]
    b = [word(rng.choice([0, 1, 3, 20, 64, 65, 130, 200])) for _ in range(150)] + ["same", "", "x", "x"]
    assert sim.common_lengths(a, b).tolist() == [sim.common_length(x, y) for x, y in zip(a, b)]
    for many, one in ((sim.ratios, sim.ratio), (sim.token_set_ratios, sim.token_set_ratio), (sim.partial_ratios, sim.partial_ratio), (sim.jaro_winklers, sim.jaro_winkler)):
        assert many(a, b) == pytest.approx([one(x, y) for x, y in zip(a, b)]), one
        assert len(many([], [])) == 0


@pytest.mark.parametrize(("chunk", "masks", "longest"), [(1 << 13, 1 << 22, 1 << 10), (7, 1 << 22, 40), (50, 400, 1 << 10)])
def test_similarities_of_crossed_texts(monkeypatch, chunk, masks, longest):
    """All pairs of a few texts have what the functions of two lists give, over one word of a mask, in pieces and where masks are too many."""
    for name, value in (("CHUNK", chunk), ("MOST_MASKS", masks), ("LONGEST", longest)):
        monkeypatch.setattr(crossed, name, value)
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcé𝒳1") for _ in range(draw.randint(1, 9)))
    base = [word() for _ in range(9)]
    texts = ["", "a", "ab", "12 12 a", "zz yy", *(" ".join(draw.choice([w, w, word()]) for w in base[: draw.randint(1, 9)]) for _ in range(25)), " ".join(word() for _ in range(40))]
    texts = list(dict.fromkeys(texts))
    left, right = np.repeat(np.arange(len(texts)), len(texts)), np.tile(np.arange(len(texts)), len(texts))
    parts = [c for _, c in crossed.compare(texts, left, right, {"12", "1"})]
    got = {f: np.concatenate([getattr(c, f) for c in parts]).tolist() for f in crossed.Compared.__dataclass_fields__}
    a, b = [texts[i] for i in left], [texts[i] for i in right]
    assert got["ratio"] == sim.ratios(a, b).tolist()
    assert got["tset"] == sim.token_set_ratios(a, b).tolist()
    assert got["partial"] == sim.partial_ratios(a, b).tolist()
    assert got["shared"] == [len(set(x.split()) & set(y.split())) for x, y in zip(a, b, strict=True)]
    assert got["numbers"] == [len({"12", "1"} & set(x.split()) & set(y.split())) for x, y in zip(a, b, strict=True)]
