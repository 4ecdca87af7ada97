"""Search against plain Python over the same rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import marlpit.operators.retrieval as retrieval
from marlpit.functions.vectors import cosine
from marlpit.operators.reports import dimension_check, query_dimension_check
from marlpit.operators.retrieval import rerank, scope_chunks, top_chunks, with_vectors
from tests.mmr_columns import mmr_picks

CHUNKS = ("source_id string, path string, chunk_index int, text string, "
          "embedding array<float>, embed_model string")
QUERIES = "query_id long, embedding array<double>"


def brute_cosine(a, b):
    scale = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return 0.0 if scale == 0 else sum(x * y for x, y in zip(a, b)) / scale


def brute_search(question, chunks, fetch_k=20, k=4, weight=0.1):
    """Straight from the definition; rows are (key, vector)."""
    scored = [(round(brute_cosine(question, v), 9), key, v) for key, v in chunks]
    pool = sorted(scored, key=lambda row: (-row[0], row[1]))[:fetch_k]
    picked = []
    while pool and len(picked) < k:
        def value(row):
            near = max([0.0] + [brute_cosine(row[2], other[2]) for other in picked])
            return round(weight * row[0] - (1 - weight) * near, 9)
        best = max(range(len(pool)), key=lambda i: (value(pool[i]), -i))
        picked.append(pool.pop(best))
    return [(key, score) for score, key, _ in picked]


def random_chunks(seed, n, dim=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vector = [float(rng.randint(-3, 3)) for _ in range(dim)]
        if i % 11 == 0:
            vector = [0.0] * dim
        rows.append((f"s{i % 3}", f"p{i // 2}", i % 2, f"text {i}", vector, "m"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, CHUNKS)


def keyed(rows):
    return [((row[0], row[1], row[2]), row[4]) for row in rows]


def hits_of(df):
    found = {}
    for row in df.orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append(
            ((row.source_id, row.path, row.chunk_index), row.score)
        )
    return found


def picked(questions, chunks, k=4, fetch_k=20):
    """Hits of top-k, vectors and re-ranking together."""
    return hits_of(rerank(with_vectors(top_chunks(questions, chunks, fetch_k), chunks), k))


@pytest.mark.parametrize("parts,per_slice,per_scan,k", [(1, 2048, 4096, 4), (5, 2048, 4096, 7), (3, 4, 4096, 4), (3, 3, 6, 4)])
def test_matches_brute_force(spark, monkeypatch, parts, per_slice, per_scan, k):
    """Many equal scores, zero and opposite vectors; several tasks, slices and scans."""
    monkeypatch.setattr(retrieval, "QUESTIONS_PER_SLICE", per_slice)
    monkeypatch.setattr(retrieval, "QUESTIONS_PER_SCAN", per_scan)
    monkeypatch.setattr(retrieval, "FLOOR_CHUNKS", 60)
    rows = random_chunks(1, 700)
    questions = [(i, row[4]) for i, row in enumerate(random_chunks(2, 13))]
    asked, chunks = spark.createDataFrame(questions, QUERIES).repartition(3), frame(spark, rows).repartition(parts)
    # Several Arrow batches per task.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = picked(asked, chunks, k)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {i: brute_search(v, keyed(rows), k=k) for i, v in questions}


def test_groups_of_tasks_are_combined(spark):
    rows = random_chunks(5, 300)
    questions = [(i, row[4]) for i, row in enumerate(random_chunks(6, 4))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        found = picked(spark.createDataFrame(questions, QUERIES), frame(spark, rows).repartition(9))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {i: brute_search(v, keyed(rows)) for i, v in questions}


def test_fewer_candidates_than_asked(spark):
    rows = random_chunks(3, 3)
    questions = spark.createDataFrame([(1, [1.0] * 6)], QUERIES)
    chunks = frame(spark, rows)
    assert len(picked(questions, chunks, 10)[1]) == 3
    assert len(picked(questions, chunks, 10, fetch_k=2)[1]) == 2
    assert picked(questions, chunks, 0) == {}
    assert picked(questions, chunks, fetch_k=0) == {}
    assert picked(questions.limit(0), chunks) == {}


@pytest.mark.parametrize("kind,ids", [("int", [7, 8]), ("string", ["q7", "q8"])])
def test_any_question_id_and_key_type(spark, kind, ids):
    chunks = frame(spark, random_chunks(3, 30)).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    questions = spark.createDataFrame([(i, [1.0] * 6) for i in ids], f"query_id {kind}, embedding array<double>")
    assert sorted(picked(questions, chunks)) == ids


def test_closeness_below_zero_counts_as_zero(spark):
    rows = [
        ("s", "a", 0, "", [1.0, 0.0], "m"),
        ("s", "b", 0, "", [-1.0, 0.0], "m"),
        ("s", "c", 0, "", [1.0, 0.0], "m"),
        ("s", "d", 0, "", [0.0, 0.0], "m"),
    ]
    questions = spark.createDataFrame([(1, [2.0, 0.0])], QUERIES)
    found = picked(questions, frame(spark, rows), 4)[1]
    # After `a`: d is 0, b is -0.1, c is 0.1 - 0.9.
    assert found == [
        (("s", "a", 0), 1.0), (("s", "d", 0), 0.0), (("s", "b", 0), -1.0), (("s", "c", 0), 1.0)
    ]


def test_scope(spark):
    rows = random_chunks(4, 40)
    chunks = frame(spark, rows)
    assert scope_chunks(chunks, "m", []).count() == 0
    assert scope_chunks(chunks, "other").count() == 0
    assert scope_chunks(chunks, "m").count() == 40
    wanted = spark.createDataFrame([("s1",), ("s2",)], "source_id string")
    listed = scope_chunks(chunks, "m", ["s1", "s2"]).collect()
    assert sorted(map(str, listed)) == sorted(map(str, scope_chunks(chunks, "m", wanted).collect()))


def test_wrong_dimensions_are_refused_where_met(spark):
    rows = [("a", "x", 0, "", [1.0, 0.0], "m"), ("b", "y", 0, "", [1.0], "m")]
    chunks = frame(spark, rows)
    question = [(1, [1.0, 0.0])]
    with pytest.raises(Exception, match="dimensions"):
        top_chunks(spark.createDataFrame(question, QUERIES), chunks).collect()
    scoped = spark.createDataFrame(
        [(1, [1.0, 0.0], ["a"])], QUERIES + ", source_ids array<string>"
    )
    assert top_chunks(scoped, chunks).count() == 1
    # An unscoped question beside it meets source b.
    both = spark.createDataFrame(
        [(1, [1.0, 0.0], ["a"]), (2, [1.0, 0.0], None)], QUERIES + ", source_ids array<string>"
    )
    with pytest.raises(Exception, match="dimensions"):
        top_chunks(both, chunks).collect()
    assert top_chunks(spark.createDataFrame(question, QUERIES), chunks.limit(0)).count() == 0
    with pytest.raises(ValueError, match="differ in size"):
        top_chunks(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], QUERIES), chunks)


def test_dimension_checks(spark):
    rows = [("a", "x", 0, "", [1.0, 0.0], "m"), ("a", "x", 1, "", [1.0], "m"),
            ("b", "y", 0, "", [1.0], "n")]
    chunks = frame(spark, rows)
    assert [tuple(r) for r in dimension_check(chunks, "embed_model").collect()] == [("m", 1, 2)]
    assert dimension_check(chunks, "source_id", "path").count() == 1
    question = spark.createDataFrame([(1, [1.0])], QUERIES)
    agrees = lambda c: query_dimension_check(question, c).first().compatible
    assert not agrees(chunks)
    assert agrees(chunks.where("embed_model = 'n'"))
    assert agrees(chunks.limit(0))


def test_cosine_column(spark):
    pairs = [([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-2.0, 0.0])]
    got = spark.createDataFrame(pairs, "a array<double>, b array<double>").select(
        cosine(F.col("a"), F.col("b")).alias("c")
    )
    assert [round(row.c, 12) for row in got.collect()] == [1.0, 0.0, -1.0]


def test_scores_are_shuffled_without_vectors(spark):
    rows = frame(spark, random_chunks(7, 50)).repartition(3)
    questions = spark.createDataFrame([(1, [1.0] * 6)], QUERIES)
    best = top_chunks(questions, rows)
    assert "embedding" not in best.columns
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "WindowGroupLimit" in plan
    fetched = with_vectors(best, rows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in fetched and "hashpartitioning" not in fetched
    for text in (plan, fetched):
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_candidates_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    rows, questions = random_chunks(8, 60), [(i, row[4]) for i, row in enumerate(random_chunks(9, 5))]
    monkeypatch.setattr(retrieval, "broadcast_if_small", lambda df: df)
    found = picked(spark.createDataFrame(questions, QUERIES), frame(spark, rows).repartition(3))
    assert found == {i: brute_search(v, keyed(rows)) for i, v in questions}


def test_slices_share_one_scan_and_a_floor_keeps_rows_in_their_tasks(spark, tmp_path):
    """40 slices: one read of the chunk table beside the few chunks of the floors, and few rows leave the tasks."""
    rows = random_chunks(7, 3000, dim=8)
    frame(spark, rows).repartition(6).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    questions = [(i, row[4]) for i, row in enumerate(random_chunks(8, 80, dim=8))]
    asked = spark.createDataFrame(questions, QUERIES)
    top = top_chunks(asked, chunks, per_slice=2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    found = hits_of(rerank(with_vectors(top, chunks)))
    assert found == {i: brute_search(v, keyed(rows)) for i, v in questions}

    numbers = pa.array(range(len(questions)))
    slices = retrieval._slices(asked.toArrow(), 2)
    schema = "query_id long, score double, source_id string, path string, chunk_index int"
    vectors = chunks.select(*retrieval.KEY, "embedding")
    from pyspark.sql.types import _parse_datatype_string

    floored = retrieval._with_floors(slices, numbers, vectors, _parse_datatype_string(schema), 20)
    handed = [
        vectors.mapInArrow(retrieval._best(spark, parts, numbers, 20), schema).count() for parts in (slices, floored)
    ]
    assert handed[1] < handed[0] == vectors.rdd.getNumPartitions() * 20 * len(questions)


def test_floors_are_of_all_parts_of_the_chunks(spark, tmp_path, monkeypatch):
    """Files of one source each, and fewer chunks for the floors than one file has: all questions get a floor."""
    monkeypatch.setattr(retrieval, "FLOOR_CHUNKS", 200)
    rows = sorted((f"s{i % 4}", *row[1:]) for i, row in enumerate(random_chunks(11, 1600)))
    for i in range(4):
        frame(spark, rows[i * 400 : i * 400 + 400]).coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    questions = [(i, row[4], [f"s{i % 4}"]) for i, row in enumerate(random_chunks(12, 40))]
    floors, floored = [], retrieval._with_floors
    monkeypatch.setattr(retrieval, "_with_floors", lambda *given: floors.extend(floored(*given)) or floors)
    asked = spark.createDataFrame(questions, QUERIES + ", source_ids array<string>")
    found = hits_of(rerank(with_vectors(top_chunks(asked, chunks, 5, 10), chunks)))
    assert len(floors) == 4 and all(np.isfinite(part.floors).all() for part in floors)
    assert found == {
        i: brute_search(v, [kept for kept in keyed(rows) if kept[0][0] in scope], fetch_k=5) for i, v, scope in questions
    }


def test_rows_of_many_questions_are_shuffled_once(spark):
    chunks = frame(spark, random_chunks(5, 300)).repartition(9)
    questions = spark.createDataFrame([(i, row[4]) for i, row in enumerate(random_chunks(6, 40))], QUERIES)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        plan = top_chunks(questions, chunks)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plan.count("hashpartitioning") == 1


def test_a_floor_is_the_last_score_among_the_chunks_given():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (900, 6)).astype(np.float32)
    asked = rng.integers(-2, 3, (12, 6)).astype(float)
    scopes = [None, [], ["s1"], ["s1", "none"], ["s2", "s0"], ["s1"]] * 2
    sources = ["s0" if i % 3 else "s1" for i in range(880)] + ["s2"] * 20
    blocks = [
        retrieval._Chunks(pa.table({
            "source_id": sources[at : at + 300], "embedding": pa.array(list(vectors[at : at + 300]), pa.list_(pa.float32())),
        }))
        for at in range(0, 900, 300)
    ]
    got = retrieval._BestHits(asked, scopes, np.full(12, -np.inf), 310).lowest(blocks)
    for question, scope, score in zip(asked, scopes, got):
        scores = sorted((round(brute_cosine(question, v), 9) for v, s in zip(vectors.astype(float), sources) if scope is None or s in scope), reverse=True)
        assert score == (scores[309] if len(scores) >= 310 else -np.inf)


@pytest.mark.parametrize("seed", range(6))
def test_rerank_agrees_with_its_column_form(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 5, 20]) for _ in range(30)]
    rows = [
        (q, c + 1, round(rng.choice([0.9, 0.5, 0.5, -0.2, rng.random()]), 9), "s", f"p{c}", 0, [float(rng.randint(-2, 2)) for _ in range(4)])
        for q, size in enumerate(sizes) for c in range(size)
    ]
    table = spark.createDataFrame(
        rows, "query_id int, candidate int, score double, source_id string, path string, chunk_index int, embedding array<float>"
    ).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.query_id, r.rank): r.path for r in rerank(table, 6, 0.3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lists = table.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("candidate", "score", "embedding"))).alias("c"))
    wanted = {
        (r.query_id, at + 1): f"p{pick}"
        for r in lists.select("query_id", mmr_picks(F.col("c"), 6, 0.3).alias("picks")).collect() for at, pick in enumerate(r.picks)
    }
    assert got == wanted


class _OneTask:
    """Stands for a session: what is broadcast stays as it is."""

    def __init__(self):
        self.sparkContext = self

    def broadcast(self, value):
        return type("Shared", (), {"value": value})


def _task(slices, n=2000, width=8):
    """What one task finds for slices of questions (vectors, scopes) in chunks of ten sources, by brute force too."""
    rng = np.random.default_rng(4)
    vectors = rng.integers(-9, 9, (n, width)).astype(np.float32)
    sources = [f"s{i % 10}" for i in range(n)]
    batch = pa.RecordBatch.from_pydict({
        "source_id": sources, "path": [f"{i:05}" for i in range(n)], "chunk_index": pa.array([0] * n, pa.int32()),
        "embedding": pa.array(list(vectors), pa.list_(pa.float32())),
    })
    parts = [retrieval._Slice(v, s, np.full(len(v), -np.inf)) for v, s in slices]
    ids = pa.array(np.arange(sum(len(v) for v, _ in slices)))
    found = [r for out in retrieval._best(_OneTask(), parts, ids, 5)(iter([batch])) for r in out.to_pylist()]
    got = {(r["query_id"], r["path"], r["score"]) for r in found}
    questions = [(v, s) for part, scopes in slices for v, s in zip(part, scopes)]
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)
    want = set()
    for q, (v, scope) in enumerate(questions):
        scores = np.round(unit(vectors.astype(float)) @ unit(v), 9) + 0.0
        allowed = [i for i in range(n) if scope is None or sources[i] in scope]
        best = sorted(allowed, key=lambda i: (-scores[i], sources[i], i))[:5]
        want |= {(q, f"{i:05}", scores[i]) for i in best}
    return got, want


def test_slices_share_the_vectors_of_a_batch(monkeypatch):
    made = []
    monkeypatch.setattr(retrieval, "_matrix", lambda *a, f=retrieval._matrix: made.append(1) or f(*a))
    rng = np.random.default_rng(1)
    got, want = _task([(rng.normal(size=(4, 8)), [None] * 4) for _ in range(10)])
    assert got == want
    assert len(made) == 1


def test_pairs_beyond_a_questions_limits_are_not_scored(monkeypatch):
    cells = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            cells.append(self.shape[0] * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    start = retrieval._BestHits.__init__

    def counted(self, *given):
        start(self, *given)
        self.units = self.units.view(Counted)

    monkeypatch.setattr(retrieval._BestHits, "__init__", counted)
    scopes = [None, [], ["s1"], ["s1", "s2"], ["none"], ["s2", "s9"]] * 5
    got, want = _task([(np.random.default_rng(2).normal(size=(30, 8)), scopes)])
    assert got == want
    assert sum(cells) == 5 * (2000 + 200 + 400 + 400)
