"""Nulls, repeated rows, very long texts and columns of clashing names, where no other test has them."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlpit.llm import context_tree, mixing, quality_classifier, tiles, toxicity, warc, wrapper

CLASHES = "score row predicted held_out label text_ rank record_id block date length start source_size n key words".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])


@pytest.mark.parametrize("run,label", [(quality_classifier.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers_score_repeated_rows_alike_among_clashing_columns(spark, run, label):
    rows = [(i, f"word{i % 7} and more " * (3 + i % 5) + ("bad bad bad" if i % 3 == 0 else "fine"), "en", "a", 1) for i in range(60)]
    rows += [rows[4], rows[4], (None, "no id", None, None, None), (None, None, None, None, None), (99, "", "en", "a", 0), (98, "long word " * 30_000, "en", "a", 0)]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    labels = clashing(spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(60)] + [(5, None, None), (6, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int"))
    got = run(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1 and sum(r.doc_id == 4 for r in got) == 3


def test_mixing_and_scores_of_rows_without_ids(spark):
    rows = [(None, f"one two three {i % 4}", "en", "a" if i % 2 else None, 9) for i in range(40)] + [(1, "one two", "en", "a", 7)] * 3
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(4))
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows) and all(r.taken <= 3 * r.size for r in mixed)
    assert sum(r.taken for r in mixed) == pytest.approx(sum(r.size for r in mixed), abs=64)
    scored = context_tree.language_scores(docs, depth=2).collect()
    assert len(scored) == len(rows) and not any(r.held_out for r in scored if r.doc_id is None)
    assert len({r.score for r in scored if r.doc_id == 1}) == 1


def test_records_of_null_and_long_blocks(spark):
    long_page = "<p>many words</p>" * 20_000
    pages = clashing(spark.createDataFrame([(1, "u", long_page), (2, None, None), (3, "v", ""), (3, "v", "")], "page_id long, url string, html string"))
    records = warc.responses(pages)
    derived = warc.derive(records, ("page_id",)).collect()
    assert len(derived) == 8
    text = {r.page_id: bytes(r.block).decode() for r in derived if r.warc_type == "conversion"}
    assert text[1].count("\n") == 19_999 and text[2] == text[3] == ""
    torn = records.withColumn("block", F.lit(None).cast("binary")).withColumn("http_headers", F.lit(None).cast("string"))
    for r in warc.derive(torn).collect():
        if r.warc_type == "conversion":
            assert bytes(r.block) == b""
        else:
            assert json.loads(bytes(r.block))["links"] == []
    assert {r.page_id: r.n_chars for r in wrapper.extract(pages).collect()} == {1: 20_000 * 11 - 1, 2: 0, 3: 0}


def test_vectors_of_any_length(spark):
    """Squares that overflow or vanish, other columns, repeated and mixed rows."""
    random_ = np.random.default_rng(3)
    base = random_.normal(size=(60, 5))
    factors = [1e300, 1e-300, 1.0, 1e160, 1e-160]
    rows = [(i, [float(x) for x in v * factors[i % 5]]) for i, v in enumerate(base)] + [(7, [float(x) for x in base[7]])]
    vectors = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = tiles.nearest(vectors, vectors.filter("vec_id % 20 = 0"), query_rows=2, candidate_rows=16).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for q in (0, 20, 40):
        near = sorted((-float(unit[q] @ unit[i]), i) for i in range(60) if i != q)[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == [i for _, i in near]
        assert all(math.isclose(s, -w, abs_tol=1e-12) for (_, _, s), (w, _) in zip(mine, near))


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Null and empty columns and repeated rows pass through every stage."""
    text = "The quiet river runs past the old mill and the mill stands by the river as it always has, in rain and in sun."
    rows = [(i, f"{text} Part {i} of {i * 7919 % 101} tells more of {i * 31 % 17} than part {i * 13 % 29} did, and ends.", "en", "ab"[i % 2], 1) for i in range(40)]
    rows += [(3, rows[3][1], "en", "b", 1), (None, rows[5][1], None, None, None), (100, None, "en", "a", None), (101, "", None, "b", 0), (None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.parity and r.round_trip and r.n_tokens == len(r.ids) for r in got)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= 3 * len(rows)
