import pytest
from pyspark.sql import functions as F

from tessella.functions import text as t


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "function, text, want",
    [
        (t.clean_text, "\t　 a b \n", "a b"), (t.clean_text, " 　", None), (t.clean_text, None, None),
        (t.punctuation, "a_b-c&d!", "a b c&d "), (t.single_space, "  a \t b ", "a b"),
        (t.and_words, "smith and jones", "smith & jones"), (t.and_words, "Müller UND Söhne", "Müller & Söhne"), (t.and_words, "band et", "band & "), (t.and_words, " and ", "&"), (t.and_words, "a&b", "a & b"),
        (t.single_chars, "S R L", "SRL"), (t.single_chars, "P & S", "P&S"), (t.single_chars, "A T & T", "AT & T"), (t.single_chars, "AT&T", "AT & T"), (t.single_chars, "acme S A group", "acme SA group"), (t.single_chars, "A & B & C", "A&B&C"), (t.single_chars, "long words", "long words"),
        (t.strip_diacritics, "Ångström café", "Angstrom cafe"), (t.strip_diacritics, "ｆｕｌｌ", "full"), (t.strip_diacritics, None, None),
        (t.strip_diacritics_full, "ﬁlm é", "film e"), (t.transliterate, "Жук Ωμέγα straße Łódź", "ZHuk Omega strasse Lodz"), (t.casefold, "STRAßE ς", "strasse σ"),
        (t.inactive, "Dissolved", True), (t.inactive, None, False), (t.has_latin, "東京 x", True), (t.has_latin, "東京", False),
        (t.iso_date, "31/12/2020", "2020-12-31"), (t.iso_date, "20201231", "2020-12-31"), (t.iso_date, "2020-02-30", None), (t.iso_date, "nonsense", None),
    ],
)
def test_column_functions(spark, function, text, want):
    assert one(spark, function, text) == want


def test_profiles():
    assert t.parse_profile(None) == t.DEFAULT_OPERATIONS
    assert t.parse_profile("default|-lowercase|casefold")[-1] == "casefold"
    assert t.parse_profile("default|transliterate")[-2:] == ("transliterate", "lowercase")
    assert t.parse_profile("default|geographic|+region")[-1] == "geographic_terms+region"
    assert t.parse_profile("punctuation|lowercase") == ("punctuation", "lowercase")
    for bad in ("default|nope", "default|+region", "default|casefold", "default|-casefold", "geographic|+moon"):
        with pytest.raises(ValueError):
            t.parse_profile(bad)


def test_default_chain(spark):
    assert one(spark, t.normalize, "  Société Générale, S. A. and Co_Ltd! ") == "societe generale SA & co ltd".lower()


def test_geographic_terms(spark):
    strip = lambda c: t.strip_geographic(c, ["ireland", "northern ireland"])
    assert one(spark, strip, "oracle software ireland") == "oracle software"
    assert one(spark, strip, "bank of ireland") == "bank of ireland"
    assert one(spark, strip, "oracle ireland") == "oracle ireland"
    assert one(spark, strip, "acme (Ireland) holdings") == "acme holdings"


@pytest.mark.parametrize(
    "kind, text, low, high, want",
    [
        ("char_wb", "a", 2, 3, [" a", "a ", " a "]), ("char_wb", "ab", 2, 3, [" a", "ab", "b ", " ab", "ab "]), ("char_wb", "ab", 4, 5, [" ab "]), ("char_wb", "abc", 5, 5, [" abc "]), ("char_wb", "a", 4, 6, [" a "]),
        ("char", "abc", 2, 2, ["ab", "bc"]), ("word", "a b c", 1, 2, ["a", "b", "c", "a b", "b c"]), ("word", "a", 2, 2, []), ("char", "", 2, 2, []),
    ],
)
def test_ngrams(spark, kind, text, low, high, want):
    assert sorted(one(spark, lambda c: t.ngrams(c, low, high, kind), text)) == sorted(want)


def test_initialism_and_divergence(spark):
    df = spark.createDataFrame([(["ibm"], ["international", "business", "machines"]), (["a", "b"], ["a", "b", "c"]), (["b", "c"], ["a", "b", "c"]), (["a"], ["a", "b", "c", "d"])], "a array<string>, b array<string>")
    got = df.select(t.initialism(F.col("a"), F.col("b")), t.divergence(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, None), (False, "prefix"), (False, "suffix"), (False, None)]


def test_legal_forms_by_country(spark):
    from tessella.operators import cleanse

    config = cleanse.CleanseConfig(country_col="country", country_forms={"dk": {"as": "a/s", "aktieselskab": "a/s"}}, country_exclusions={"gb": ("as",), "fr": ("sa",)})
    rows = [(0, "Alpha AS", "DK"), (1, "Alpha AS", "gb"), (2, "Alpha AS", None), (3, "Alpha SA", " FR "), (4, "Alpha Aktieselskab", "dk"), (5, "Alpha Aktieselskab", "no"), (6, None, "dk"), (7, "AS", "dk")]
    out = cleanse.cleanse(spark.createDataFrame(rows, "id int, name string, country string"), config)
    assert [r[0] for r in out.orderBy("id").select("company_type").collect()] == ["a/s", "private", "as", "private", "a/s", "private", None, "private"]
    assert cleanse.CleanseConfig(legal_forms={}).forms_of("dk") == {}
    assert cleanse.cleanse(spark.createDataFrame([("Alpha Ltd",)], "name string"), cleanse.CleanseConfig(legal_forms={"ltd": "ltd"})).first().company_type == "ltd"
