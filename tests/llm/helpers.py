"""Small tables with the awkward cases of every operator."""
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _digest string, _d int, Size int"


def table(spark, texts, sources=None):
    """A documents table with extra columns whose names operators might use themselves."""
    rows = [(i, t, ("en", "de", None)[i % 3] if i is not None else "en", (sources[k] if sources else ("a", "b", None)[k % 3]), len(t or ""), "x", 7, 1)
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
