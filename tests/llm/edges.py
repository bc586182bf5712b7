"""Document tables of odd input, shared by the tests of all operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns of the input they must not get in the way.
CLASHING = ("node", "label", "rep", "hub", "key", "n", "d", "h", "at", "pos", "line", "masked", "form", "leaf", "drop_at", "drop_id", "slot", "part", "draw", "batch", "bucket", "copy", "u", "m", "weight", "mix_rate", "mix_source", "label_id", "dropped_id", "ids", "rest", "score")

ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 4),
    (4, "one", "en", "a", 3),
    (5, "word " * 30_000, "en", "b", 150_000),
    (6, "same text as the other one here", "en", "b", 31),
    (7, "same text as the other one here", "de", None, 31),
    (7, "same text as the other one here", "de", None, 31),
    (None, "no id on this row at all", "en", "a", None),
    (None, None, None, None, None),
    (8, "x" * 100_000, "en", "c", 100_000),
    (9, "first line of it\n\nfirst line of it\nlast 12 of 30 pages", "en", "c", 1),
    (10, "é 　 ß \U0001f600 Ünïcode words", "fr", "c", 2),
]


def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(spark):
    from pyspark.sql import functions as F

    df = odd(spark)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)
