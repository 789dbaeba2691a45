"""Held-out accuracy of the trained operators, on rows that training never saw."""

from pyspark.sql import functions as F

from stratalog.llm import queries_text

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = queries_text.table(spark, SF, "documents")
    out = queries_text.op9_language_id(spark, SF)
    rows = out.where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").select("lang", "lang_pred").collect()
    print("language", len(rows), sum(r.lang == r.lang_pred for r in rows))
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows) > 0


def test_quality_of_held_out_documents(spark):
    labels = queries_text.table(spark, SF, "labels").where("quality is not null")
    out = queries_text.op3_quality(spark, SF)
    rows = out.where("held_out").join(labels.select("doc_id", "quality"), "doc_id").select("quality", "predicted", "score").collect()
    print("quality", len(rows), sum(r.quality == r.predicted for r in rows))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.quality == r.predicted for r in rows) >= 0.8 * len(rows) > 0


def test_every_document_is_predicted_once(spark):
    n = queries_text.table(spark, SF, "documents").count()
    for query in (queries_text.op3_quality, queries_text.op9_language_id):
        assert query(spark, SF).agg(F.count("*"), F.countDistinct("doc_id")).first()[:] == (n, n)
