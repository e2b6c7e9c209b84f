import pytest
from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.functions import bands, text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_trigram_similarity(spark):
    sim = lambda a, b: one(spark, text.similarity(F.lit(a), F.lit(b)))
    assert sim("word", "two words") == pytest.approx(4 / 11)
    assert sim("Word", "word") == 1.0
    assert sim("", "word") == 0.0
    assert sim("été", "ETE") < 1.0


def test_strip_any_white_space(spark):
    assert one(spark, text.strip(F.lit("　\t a b \n\x85"))) == "a b"


def test_claim_hash_ignores_case_and_ends(spark):
    assert one(spark, text.claim_hash(F.lit(" Oil Rises\n"))) == one(
        spark, text.claim_hash(F.lit("oil rises")))


@pytest.mark.parametrize("t,d", [
    ("Central bank credit squeeze", "economic_stability"),
    ("military border conflict", "geopolitical_tension"),
    ("nothing here", "structural_change"),
    ("oil market", "economic_stability"),
    # A repeated list entry counts twice.
    ("demographic flood", "structural_change"),
])
def test_best_dimension(spark, t, d):
    assert one(spark, text.best_dimension(F.lit(t))) == d


def test_all_dimensions(spark):
    assert one(spark, text.all_dimensions(F.lit("oil market"))) == [
        "economic_stability", "resource_availability"]
    assert one(spark, text.all_dimensions(F.lit("zzz"))) == ["structural_change"]


@pytest.mark.parametrize("v,s", [(1234.5, "1,234.5"), (2.0, "2"), (0.12345, "0.1235"), (100.0, "100")])
def test_grouped_number(spark, v, s):
    assert one(spark, text.grouped_number(F.lit(v))) == s


@pytest.mark.parametrize("v", [0.0, 1.5, 100.0, 82.4, 123456.7, 1234567.0, 0.00012, 0.00001234, -3.25, 4.61])
def test_short_number_is_the_g_format(spark, v):
    assert one(spark, text.short_number(F.lit(v))) == f"{v:g}"


@pytest.mark.parametrize("a,t,b", [
    (0, 0, "unknown"), (0, 20, "improving"), (4, 20, "stable"), (9, 20, "strained"),
    (14, 20, "deteriorating"), (16, 20, "crisis"),
])
def test_state_band(spark, a, t, b):
    assert one(spark, bands.state_band(F.lit(a), F.lit(t))) == b


def test_one_step_weaker(spark):
    step = lambda b: one(spark, bands.one_step_weaker(F.lit(b)))
    assert [step(b) for b in vocab.WEIGHT_BANDS] == ["moderate", "weak", "provisional", "disputed", None]
    assert step("huge") is None


def test_attention(spark):
    got = [one(spark, bands.attention(F.lit(b))) for b in ("crisis", "deteriorating", "strained", "stable")]
    assert got == ["high", "high", "medium", "low"]
