from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.functions.constants import ROMAN_NUMERALS, RetrievalConfig


def terms(spark, value, **kw):
    df = spark.createDataFrame([(1, value)], "id long, t string")
    return [r["term"] for r in text.tokens(df, "t", "id", **kw).orderBy("pos").collect()]


def test_accents_case_and_digits(spark):
    assert terms(spark, "Élite CAFÉ 3,51") == ["elite", "cafe", "3", "51"]


def test_compatibility_letters(spark):
    assert terms(spark, "ﬁsika Ｆoo x²") == ["fisika", "foo", "x2"]


def test_phrase_alias_order(spark):
    assert terms(spark, "indeks prestasi kumulatif dan indeks prestasi") == ["ipk", "ip"]


def test_clitic_needs_a_stem(spark):
    assert terms(spark, "nilainya kupu masalah makalah") == ["nilai", "kupu", "masa"]


def test_romans_stay_and_stopwords_go(spark):
    assert terms(spark, "BAB iv di x") == ["bab", "iv", "x"]
    assert "di" in terms(spark, "di kota", remove_stopwords=False)
    assert len(ROMAN_NUMERALS) == 30 and ROMAN_NUMERALS[13] == "xiv"


def test_null_and_empty(spark):
    assert terms(spark, None) == [] and terms(spark, " .,") == []


def test_content_terms_are_distinct_in_first_order(spark):
    df = spark.createDataFrame([(1, "sks ipk sks")], "id long, t string")
    assert [r["term"] for r in text.content_terms(df, "t", "id").orderBy("pos").collect()] == ["sks", "ipk"]


def test_truncate(spark):
    row = spark.range(1).select(text.truncate_words(F.lit("satu dua tiga"), 7).alias("a"), text.truncate_words(F.lit("satu"), 9).alias("b")).first()
    assert (row["a"], row["b"]) == ("satu …", "satu")


def test_overrides():
    assert RetrievalConfig().with_overrides(top_k=2, rrf_k=None).top_k == 2
    try:
        RetrievalConfig().with_overrides(nope=1)
    except ValueError as e:
        assert "nope" in str(e)
    else:
        raise AssertionError
