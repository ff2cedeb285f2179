"""Dedup stages of the pipeline over rows without an id and rows that share one."""

import corpus_pipeline


def test_rows_without_an_id_or_with_a_shared_one(spark):
    long = "one two three four five six seven eight nine ten eleven twelve " * 4 + "end "
    rows = [(None, "copy of a text"), (None, "copy of a text"), (1, "copy of a text"), (2, "other words here"), (2, "quite another page"), (None, None), (3, long + "a"), (None, long + "a b"), (2, long), (None, "alone"), (None, "copy of a note"), (None, "copy of a note")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    show = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    exact = corpus_pipeline.drop_copies(spark, docs, "")
    want = [(1, "copy of a text"), (2, "other words here"), (2, "quite another page"), (None, None), (3, long + "a"), (None, long + "a b"), (2, long), (None, "alone"), (None, "copy of a note")]
    assert exact.columns == docs.columns and show(exact) == sorted((str(i), str(t)) for i, t in want)
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    want = [(1, "copy of a text"), (2, "other words here"), (2, "quite another page"), (None, None), (2, long), (None, "alone"), (None, "copy of a note")]
    assert near.columns == docs.columns and show(near) == sorted((str(i), str(t)) for i, t in want)


def test_stages_of_odd_rows(spark, sf):
    """Nulls in every column, empty texts, repeated rows, an extra column with a name used inside, and no rows at all."""
    odd = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", None, 0), (2, "plain words of no harm", None, "s", None), (2, "plain words of no harm", None, "s", None), (3, "password: hunter22 and more", "en", "s", 3)]
    docs = spark.createDataFrame([(*r, "x") for r in odd], "doc_id long, text string, lang string, source string, n_chars long, row string")
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, sf), stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and none.columns == out.columns
        rows = out.collect()
        if name == "packing":
            assert sorted((r.doc_id or 0, r.start) for r in rows) == sorted((r.doc_id or 0, 0) for r in docs.collect())
            break
        assert out.columns == docs.columns
        assert len(rows) == {"toxicity": 6, "exact_dedup": 3, "near_dedup": 3, "secrets": 3}[name]
        docs = spark.createDataFrame(rows, docs.schema)
    assert any(r.text == "[secret] and more" for r in docs.collect())


def test_columns_of_any_name_keep_their_values(spark):
    """Columns that the stages use by name inside come out as they went in."""
    names = ["doc_id", "text", "__key", "__null", "key", "row", "class_id", "blank", "cells"]
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long, *"abcdefg"), (2, long + " more", *"hijklmn"), (3, "other text altogether", *"opqrstu"), (3, "other text altogether", *"opqrstu"), (None, None, *"vwxyzAB")]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    once = corpus_pipeline.drop_copies(spark, docs, "")
    kept = corpus_pipeline.drop_near_copies(spark, once, "")
    assert once.columns == kept.columns == names
    assert sorted(map(tuple, once.collect()), key=str) == sorted({rows[0], rows[1], rows[2], rows[4]}, key=str)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
