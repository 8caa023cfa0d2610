import os
import random
import zlib

import numpy as np
import pytest
from llm_tables import awkward, documents

from placegauge.llm import language

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def brute_kernel(one, two):
    def spectrum(text):
        clean = f" {language._NO_LETTERS.sub(' ', text.lower()).strip()} "
        return {clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1)}

    a, b = spectrum(one), spectrum(two)
    return len(a & b) / (len(a) * len(b)) ** 0.5


def test_kernel_counts_common_ngrams():
    texts = ["The cat sat, 12 mats!", "Der Hund saß da", "the CAT", "ünïcode 漢字 text", "x"]
    found = [language.grams(t) for t in texts]
    model = language.fit(["a", "b", "a", "b", "a"], found)
    marks = ["The cat sat, 12 mats!", "the CAT", "x", "Der Hund saß da", "ünïcode 漢字 text"]
    want = [[brute_kernel(t, m) for m in marks] for t in texts]
    assert np.allclose(model.kernel(found), want)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = language.identified(docs).where(language.held_out()).select("lang", "lang_pred", "score").collect()
    assert len(rows) > 20 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def model_score(texts):
    taught = ["foo bar quux", "über mäh öd"] * 6
    model = language.fit(["aa", "bb"] * 6, [language.grams(t) for t in taught])
    return [score for _, score in model.predict(texts)]


def test_awkward_rows(spark):
    pick = random.Random(1)
    parts = {"aa": ["foo", "bar", "quux"], "bb": ["über", "mäh", "öd"]}
    rows = [(k, " ".join(pick.choices(parts["aa" if k % 2 else "bb"], k=30))) for k in range(60)]
    every = [*rows, *awkward(), (990, "123 --- 456"), (991, "²³")]
    df = documents(spark, every)
    from pyspark.sql import functions as F

    df = df.withColumn("lang", F.when(F.col("doc_id") < 60, F.when(F.col("doc_id") % 2 == 1, "aa").otherwise("bb")))
    got = {r.doc_id: r for r in language.identified(df.withColumn("score", F.lit("old"))).collect()}
    for k in range(60):
        assert got[k].lang_pred == ("aa" if k % 2 else "bb")
    for k in (900, 901, 902, 990, 991):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    # A script that nothing was learnt from is like no language.
    strange = model_score(["漢字仮名交文章 " * 20, "foo bar quux foo"])
    assert strange[0] < 0.1 < strange[1]
    learnt = [k for k in range(60) if zlib.crc32(str(k).encode()) % 4 != 2]
    flags = {r.doc_id: r.h for r in df.select("doc_id", language.held_out().alias("h")).collect()}
    assert all(flags[k] == (k not in learnt) for k in range(60)) and flags[None] is False


def test_nothing_to_learn_from(spark):
    got = language.identified(documents(spark, [(1, "words"), (2, None)]).drop("lang").selectExpr(
        "*", "cast(null as string) lang")).select("lang_pred", "score").collect()
    assert {tuple(r) for r in got} == {("und", 0.0)}
    assert language.identified(documents(spark, [])).count() == 0
