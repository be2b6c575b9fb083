SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source=lambda i: f"src{i % 3}"):
    rows = [(i, t, "en", source(i), None if t is None else len(t)) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


#: Nulls, empty and white texts, repeats, long texts and odd characters.
ODD = [None, "", " \t\n", "one", "one two", "a b c", "a b c", "ünï cödé ¿qué? ſ K", "word " * 30_000, "\n\n\n", "x" * 5000, "a b c a b c a b c"]


def clashing(docs):
    """The documents with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = "fp key h s n w i slice count size rank u v node root spans id ids item_id shard before lines words rid _stay _bad _w".split()
    return docs.select("*", *[F.lit("x").alias(c) for c in names])
