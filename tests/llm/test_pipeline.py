import os

import pytest
from compare import compare, connect
from llm_tables import awkward, edited, prose
from pyspark.sql import functions as F
from test_decontaminate import brute as hits
from test_near_text import brute as near

import corpus_pipeline
from placegauge.llm import line_templates
from placegauge.llm.registry import ORACLES, QUERIES
from test_line_templates import brute as left_lines

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def build(spark, folder, rows, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(d, t, "en", None, len(t) if t is not None else None) for d, t in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_against_plain_versions(spark, tmp_path):
    folder, item = str(tmp_path), prose(900, 40)
    rows = awkward() + [(k, prose(k, 150) + "\nThe same footer everywhere") for k in range(30)]
    rows += [(40 + k, edited(prose(500, 120), k, 0.01)) for k in range(8)] + [(60, prose(1, 30) + " " + item)]
    rows += [(61, "123 456 789")]
    build(spark, folder, rows, [(1, item)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        out = [(r.doc_id, r.text) for r in after.collect()]
        if name == "language":
            kept = [r for r in kept if r[1] and any(map(str.isalpha, r[1]))]
        elif name == "lines":
            texts = left_lines(kept, line_templates.MIN_DOCS, line_templates.SIMILARITY)
            assert all(t in texts[d] for d, t in out)
            kept = out
            assert len(out) == len([r for r in kept if r[1].strip()])
        elif name == "near_duplicates":
            ids = {d for d, _, _, k in near(kept, 5, 80) if k}
            kept = [r for r in kept if r[0] in ids or r[0] is None]
        else:
            kept = [r for r in kept if not hits([r], [(1, item)], 10)[0][2]]
        assert sorted(out, key=repr) == sorted(kept, key=repr), name
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert {60} & {d for d, _ in rows} and 60 not in {d for d, _ in kept}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in kept}


CLASHES = ["dropped", "__id", "__gone", "score", "lang_pred", "lines_dropped", "key", "doc", "first", "n"]


def test_columns_of_the_caller_stay_as_they_are(spark, tmp_path):
    folder, item = str(tmp_path), prose(900, 40)
    build(spark, folder, [(k, prose(k, 150) + "\nThe same footer") for k in range(14)] + [(0, prose(77, 90))], [(1, item)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in CLASHES:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after, same = stage(spark, docs, folder), stage(spark, plain, folder)
        assert after.columns == docs.columns
        got = after.collect()
        assert got and all(r[c] == f"{c} of {r.doc_id}" for r in got for c in CLASHES), name
        assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in same.collect())
        docs = spark.createDataFrame(got, after.schema)
        plain = docs.drop(*CLASHES)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= len(got)


def test_empty_tables(spark, tmp_path):
    build(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name]) is None


def test_a_query_for_each_operator():
    assert [n for k in range(1, 14) for n in QUERIES if n.startswith(f"op{k}_")] == [
        "op1_decontamination", "op2_substring_dedup", "op3_embedding_dedup", "op4_language_id", "op5_token_counts",
        "op6_packing", "op7_secret_scan", "op8_minhash", "op9_id_files", "op10_line_dedup",
        "op11_spelling", "op12_vector_codes", "op13_main_text",
    ]
    assert "pipeline" in QUERIES
