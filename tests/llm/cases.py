"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

LONG = 40_000


def awkward_documents(spark):
    """Nulls in every column, empty and blank texts, one very long text, repeated rows, two texts with one id, clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñou") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() + (". \n" if rng.random() < 0.08 else "") for _ in range(n))
    base = prose(120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a", 1), (2, near, "en", "a", 1), (3, base, "fr", "b", 1), (3, base, "fr", "b", 1), (4, prose(90), None, None, None),
        (5, None, "en", "a", 0), (5, None, "en", "a", 0), (6, "", "en", "a", 0), (7, " \t\n ", "en", "a", 0), (8, " \t\n ", None, "a", 0), (None, prose(70), "xx", "a", 0),
        (None, base, "en", "a", 0), (9, prose(LONG), "de", "a", 0), (10, "one two", "en", "a", 0), (11, "one two", "en", "a", 0), (12, prose(60), "en", "a", 0), (12, prose(60), "en", "a", 0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    for i, name in enumerate(("quality", "licenses", "secrets", "pieces", "tk", "word", "_id", "group", "label")):
        df = df.selectExpr("*", f"{i} AS `{name}`")
    return df.repartition(3)


def texts_of(df) -> list:
    return [r["text"] for r in df.select("text").collect()]
