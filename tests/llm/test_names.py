"""Columns of the input that are called like the operators' own helpers."""

import corpus_pipeline

NAMES = ["__id", "__hash", "__ranges", "__kept", "__n_removed"]


def test_stages_pass_on_clashing_columns_and_drop_repeats(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(1, long), (1, long), (5, other), (5, long + " x"), (None, other), (None, None)]
    kinds = ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame([(*r, *NAMES) for r in rows], f"doc_id long, text string, {kinds}")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = kept.collect()
    # one row of each text's group: the repeated row once, the near copy gone, the unrelated text kept once
    assert sum((r.text or "").startswith("w0 ") for r in got) == 1 and sum((r.text or "").startswith("v0 ") for r in got) == 1
    cut = corpus_pipeline.substring_repeats(spark, docs, "")
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert all(r["__id"] == "__id" and r["__kept"] == "__kept" for r in cut.collect())
