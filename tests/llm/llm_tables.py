"""Small tables with the awkward rows that every operator has to take."""

import random

from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside.
CLASHING = ["a", "b", "key", "leaf", "n", "part", "rank", "place", "band", "first", "hits", "bucket"]

WORDS = [
    "".join(random.Random(k).choices("abcdeginorst", k=2 + k % 7)) for k in range(400)
]


def prose(seed, size, words=WORDS):
    pick = random.Random(seed)
    return " ".join(pick.choice(words) for _ in range(size))


def edited(text, seed, share):
    """Some words of a text replaced."""
    pick = random.Random(seed)
    return " ".join(
        pick.choice(WORDS) if pick.random() < share else word for word in text.split(" ")
    )


def awkward():
    """Nulls, empty and blank texts, repeated rows, one id with two texts, a very long text."""
    return [
        (None, prose(1, 80)),
        (900, None),
        (901, ""),
        (902, " \t\n \x0b"),
        (903, prose(2, 90)),
        (903, prose(2, 90)),
        (904, prose(3, 70)),
        (904, prose(4, 70)),
        (905, prose(5, 60_000)),
        (906, "é ünï Straße ﬀ 漢字   x"),
        (907, "one"),
        (None, None),
    ]


def documents(spark, rows):
    """Rows ``(doc_id, text)`` as documents with extra columns."""
    full = [
        (doc_id, text, None if k % 5 == 0 else "xx", None, None if text is None else len(text))
        for k, (doc_id, text) in enumerate(rows)
    ]
    df = spark.createDataFrame(full, DOCUMENTS).repartition(3)
    for name in CLASHING:
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
