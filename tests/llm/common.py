"""Small frames with the cases that every operator must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""
LONG = "long word " * 60_000

ODD = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one", None, None, 1), (4, "same text here for two", "en", "b", 5), (5, "same text here for two", "de", None, 5),
       (6, "same text here for two", "en", "b", 5), (6, "same text here for two", "en", "b", 5), (None, "no id at all", "en", "c", 3), (7, LONG, "en", "a", 9), (8, "  \n\t ", "en", "a", 4),
       (9, "é 😀 ünï", "fr", "b", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ODD, clash=True):
    """Documents with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    if not clash:
        return df
    return df.selectExpr("*", "1 as key", "'x' as row", "2.0 as score", "3 as times", "4 as size", "5 as shard_", "6 as dropped", "7 as spans", "8 as n_words", "9 as of", "10 as copy")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
