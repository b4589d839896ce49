import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.lexicon import flags


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def test_clean_splits_words_at_accents(spark):
    assert one(spark, "Réeaux café naïve_x ﬁne", X.clean_for_match) == "re eaux cafe nai ve_x fine"
    assert one(spark, None, X.clean_for_match) == ""


def test_clean_agrees_with_python(spark):
    texts = ["A  b\tc", "É-x", "ß ½", "", "_a_", "日本 語", "x y", "İ"]
    want = [re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKD", t).lower())).strip() for t in texts]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, v string").orderBy("i").select(X.clean_for_match(F.col("v"))).collect()]
    assert got == want


@pytest.mark.parametrize(("v", "y"), [("2012", 2012), ("2004-07-12", 2004), ("12005", 2005), ("2003.0", 2003), ("2100", 2100), ("1899", None), ("n.d.", None), ("", None), (None, None), ("1850.5", None)])
def test_year(spark, v, y):
    assert one(spark, v, X.year_of) == y


def test_cut_and_word_limit(spark):
    assert one(spark, " a \n b ", lambda c: X.cut(c, 2)) == "a ..."
    assert one(spark, None, lambda c: X.cut(c, 2)) == ""
    assert one(spark, "a  b c", lambda c: X.word_limit(c, 2)) == "a b"


def test_unit_of_zero_vector(spark):
    assert one(spark, [0.0, 0.0], X.unit, "array<double>") == [0.0, 0.0]
    assert one(spark, [3.0, 4.0], X.unit, "array<double>") == [0.6, 0.8]


def test_simple_words_are_without_accents(spark):
    assert one(spark, "Veau à lait, Métrite ñu-x", X.simple_words) == ["veau", "lait", "metrite", "nu-x"]
    assert len(X.ACCENTED) == len(X.BARE) and one(spark, None, X.simple_words) == []


def test_ngrams(spark):
    assert one(spark, ["a", "b", "c"], lambda c: X.ngrams(c, 2), "array<string>") == ["a b", "b c"]
    assert one(spark, ["a"], lambda c: X.ngrams(c, 2), "array<string>") == []


@pytest.mark.parametrize(
    ("v", "inc", "exc"),
    [("or 5 cows", True, False), ("OR = 1.8", True, False), ("for 5 cows", False, False), ("group value", True, False), ("p-value", True, False), ("foxes", False, False), ("a fox", False, True), ("ñboar", False, False), ("or5", False, False), ("or-5", False, False), ("or/5", False, False), ("OR: 1.8", False, False), ("rr12", False, False), ("RR=2", True, False), ("PR =  3", True, False), ("or = 7", True, False), ("(RR 0.5)", True, False), ("woman", False, True), ("womxn", False, False), ("or 5", True, False), ("women", False, True), (None, False, False), ("", False, False)],
)
def test_lexicon(spark, v, inc, exc):
    df = spark.createDataFrame([(v,)], "v string")
    assert tuple(df.select(*flags(F.col("v"))).first()) == (inc, exc)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=6))
def test_squeeze_leaves_single_blanks(spark, texts):
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "v string").select(X.squeeze(F.col("v"))).collect()]
    assert all("  " not in t and t == t.strip(" ") for t in got)
