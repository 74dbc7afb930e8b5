"""Queries over whole texts, on rows that the given tables do not have."""

import __spark_entry__ as jobs


def test_a_text_without_a_sentence_has_no_first_one(spark, tmp_path):
    rows = [(0, "One. Two! "), (1, ""), (2, " \n\t"), (3, None), (4, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.sentences, r.first_sentence) for r in jobs.queries()["fn_09_sentences"](spark, str(tmp_path)).collect()}
    assert got[0] == (2, "One.") and got[1] == got[2] == got[4] == (0, None)
    assert got[3][1] is None
