"""Small tables with the awkward cases that every operator must stand."""

AWKWARD = [
    (1, "Plain words make a plain text for once and all the same."), (2, None), (3, ""), (4, "   \n\n "), (5, "word " * 30_000), (6, "é" * 500),
    (7, "Plain words make a plain text for once and all the same."), (7, "Plain words make a plain text for once and all the same."),
    (8, "x\u2581y <|endoftext|> 日本語 \x00 end"), (None, "a row without an id"), (9, "!!! ... ???"),
]


def documents(spark, rows=AWKWARD, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # columns whose names clash with what the operators make
    return df.selectExpr("*", "'x' AS score", "1 AS start", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars", "7 AS rep", "'k' AS key") if extra else df


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]
