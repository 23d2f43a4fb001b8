"""Registered queries of pairs do the whole job of their operators."""

import __spark_entry__ as entry


def test_long_pairs_are_scored(spark, tmp_path):
    texts = [" ".join(f"w{i}" for i in range(2_500)), " ".join(f"w{i}" for i in range(50, 2_550))]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = entry.queries()["sequence_and_edit_similarity"](spark, str(tmp_path)).collect()
    assert row.diff_mode == "FULL" and abs(row.diff_similarity - 0.98) < 1e-9
