"""Small tables with the awkward rows every corpus operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, word string, size long"

ODD = [
    (1, "Alpha beta gamma delta. Alpha beta!\nSecond line of it", "en", "a", 1, "x", "y", 3),
    (2, "alpha BETA gamma delta. alpha beta!\nsecond line of it", "en", "a", 1, None, None, None),
    (3, "", "en", None, None, None, None, None),
    (4, None, None, "b", 1, None, None, None),
    (5, "ÉTÉ été É nbsp\ttab\r\nwin  two   three \n\n end ", "fr", "b", 1, None, None, None),
    (6, "word " * 30_000, "en", "a", 1, None, None, None),
    (7, "same text here", "en", "c", 1, None, None, None),
    (7, "same text here", "en", "c", 1, None, None, None),
    (7, "same text here", "en", "c", 1, None, None, None),
    (None, "same text here", "en", "c", 1, None, None, None),
    (8, "日本語 のテキスト 🙂 <|endoftext|> x", "ja", "ß", 1, None, None, None),
    (9, "x", "en", "a", 1, None, None, None),
]


def odd_documents(spark, parts=3):
    return spark.createDataFrame(ODD, DOCS).repartition(parts)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def written(spark, folder, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
