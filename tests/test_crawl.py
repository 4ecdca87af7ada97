"""I5 with E1, H1, I1-I4, S7-S12: crawls of small trees and tables."""

import os

import pytest
from pyspark.sql import functions as F

from marlpit.model import COMMITS, DOCUMENTS, SOURCE_ERRORS
from marlpit.operators.embedding import ColumnEmbedder, HashEmbedder, RuleEmbedder
from marlpit.plans.crawl import Indexing, crawl
from marlpit.plans.search import search
from marlpit.sources import store as index_store
from marlpit.sources.store import IndexStore
from marlpit.sources.tree import scan_tree

METALS = RuleEmbedder({"tin": [2.0, 0.0], "zinc": [0.0, 2.0]}, [-1.0, -1.0])
RULES = Indexing(METALS, "metals")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "metals"
    (root / "soft").mkdir(parents=True)
    (root / "soft/tin.md").write_text("tin bends and cries", encoding="utf-8")
    (root / "zinc.md").write_text("zinc is a bluish metal", encoding="utf-8")
    return root


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"))


def _rows(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())


def _counts(report):
    return {
        row.source_id: (row.indexed_files, row.skipped_files, row.removed_files, row.chunk_count)
        for row in report.collect()
    }


def _tree_crawl(store, registry, indexing=RULES, **extra):
    return crawl(store, registry, scan_tree(registry), indexing, **extra)


def _documents(spark, *rows):
    full = [(s, p, c if c is None or isinstance(c, bytes) else c.encode(), e)
            for s, p, c, e in (row if len(row) == 4 else (*row, None) for row in rows)]
    return spark.createDataFrame(full, DOCUMENTS)


def test_history_of_a_tree(spark, store, tree, registry_of):
    """Each step edits the tree and names the counts and the texts that must follow."""
    registry = registry_of({"source_id": "m", "path": str(tree)})
    tin, zinc, lead = tree / "soft/tin.md", tree / "zinc.md", tree / "lead.md"
    steps = [
        (lambda: None, (2, 0, 0, 2), {"soft/tin.md": "tin bends and cries", "zinc.md": "zinc is a bluish metal"}),
        (lambda: os.utime(tin, (1, 1)), (0, 2, 0, 2), None),
        (lambda: zinc.write_text("zinc again"), (1, 1, 0, 2), {"soft/tin.md": "tin bends and cries", "zinc.md": "zinc again"}),
        (lambda: (zinc.unlink(), lead.write_text("lead")), (1, 1, 1, 2), {"lead.md": "lead", "soft/tin.md": "tin bends and cries"}),
        (lambda: tin.unlink(), (0, 1, 1, 1), {"lead.md": "lead"}),
    ]
    texts = None
    for edit, counts, wanted in steps:
        edit()
        texts = wanted or texts
        assert _counts(_tree_crawl(store, registry)) == {"m": counts}
        assert _rows(store.chunks(), "path", "text") == sorted(texts.items())
        assert _rows(store.files(), "source_id", "path") == [("m", path) for path in sorted(texts)]


def test_upkeep_changes_no_row(spark, store, tree, registry_of):
    registry = registry_of({"source_id": "m", "path": str(tree)})
    _tree_crawl(store, registry)
    (tree / "zinc.md").write_text("zinc again")
    _tree_crawl(store, registry)

    def state():
        files = _rows(store.files(), "path", "content_hash", "embed_dim", "n_chunks")
        return files, _rows(store.chunks(), "path", "text")

    before = state()
    assert store.version().dead_rows > 0
    store.compact()
    assert state() == before and store.version().dead_rows == 0
    store.expire()
    assert state() == before
    assert os.listdir(os.path.join(store.root, "chunks")) == [f"run={store.version().run}"]
    assert _counts(_tree_crawl(store, registry)) == {"m": (0, 2, 0, 2)}


def test_unchanged_crawl_does_not_embed(spark, store, registry_of, monkeypatch):
    registry = registry_of({"source_id": "s"})
    docs = _documents(spark, ("s", "a.md", "alpha"), ("s", "b.md", "beta"))

    def embed(texts):
        return [[1.0, 2.0] for _ in texts]

    def refuse(texts):
        raise AssertionError("called")

    crawl(store, registry, docs, Indexing(embed, "m"))
    report = crawl(store, registry, docs, Indexing(refuse, "m"))
    assert _counts(report) == {"s": (0, 2, 0, 2)} and report.first().error is None
    def joins(model):
        return "Join" in store.chunks(model)._jdf.queryExecution().executedPlan().toString()

    report = crawl(store, registry, docs, Indexing(embed, "m2"))
    # Past the broadcast bound, retired rows of one model do not burden another.
    monkeypatch.setattr(index_store, "TOUCHED_FOLDERS", 0)
    assert joins("m") and not joins("m2")
    assert store.chunks("m").count() == 0 and store.chunks("m2").count() == 2
    assert _counts(report) == {"s": (2, 0, 0, 2)}
    assert _rows(store.chunks(), "embed_model", "path") == [("m2", "a.md"), ("m2", "b.md")]


def test_undecodable_and_blank_files(spark, store, registry_of):
    registry = registry_of({"source_id": "s"})
    crawl(store, registry, _documents(spark, ("s", "bad.md", "good text"), ("s", "e.md", "")), RULES)
    assert _rows(store.files(), "path", "embed_dim", "n_chunks") == [("bad.md", 2, 1), ("e.md", 0, 0)]
    changed = _documents(spark, ("s", "bad.md", b"\xff\xfe\x00"), ("s", "e.md", ""))
    assert _counts(crawl(store, registry, changed, RULES)) == {"s": (0, 2, 0, 1)}
    assert _rows(store.chunks(), "path", "text") == [("bad.md", "good text")]


def test_failing_file_stops_its_source_only(spark, store, registry_of):
    registry = registry_of({"source_id": "s"}, {"source_id": "t"})
    crawl(
        store,
        registry,
        _documents(spark, ("s", "a/x.md", "1"), ("s", "b.md", "2"), ("s", "gone.md", "3"),
                   ("t", "z.md", "4"), ("t", "gone.md", "5")),
        RULES,
    )

    def embed(texts):
        if any("boom" in text for text in texts):
            raise ValueError("no vector for boom")
        return [[1.0, 0.0]] * len(texts)

    # In component order a/x.md comes before a-y.md.
    second = _documents(
        spark, ("s", "a/x.md", "new 1"), ("s", "a-y.md", "boom"), ("s", "b.md", "new 2"),
        ("t", "z.md", "new 4"),
    )
    report = crawl(store, registry, second, Indexing(embed, "metals"))
    assert _counts(report) == {"s": (1, 0, 0, 3), "t": (1, 0, 1, 1)}
    errors = {row.source_id: row.error for row in report.collect()}
    assert errors == {"s": "no vector for boom", "t": None}
    assert _rows(store.chunks(), "source_id", "path", "text") == [
        ("s", "a/x.md", "new 1"), ("s", "b.md", "2"), ("s", "gone.md", "3"), ("t", "z.md", "new 4"),
    ]
    status = {row.id: row for row in store.status().collect()}
    assert status["s"].last_error == "no vector for boom" and status["t"].last_error is None
    # The next crawl picks up where the failure was.
    fixed = crawl(store, registry, second, RULES)
    assert _counts(fixed) == {"s": (2, 1, 1, 3), "t": (0, 1, 0, 1)}
    store.compact()
    assert store.chunks().count() == 4


def test_mixed_dimensions_and_wrong_counts_are_errors(spark, store, registry_of):
    registry = registry_of({"source_id": "s"}, {"source_id": "t"})
    long = "word " * 300

    def mixed(texts):
        return [[1.0] * (1 + ("x" in text)) for text in texts]

    docs = _documents(spark, ("s", "a.md", long + "x"), ("t", "b.md", "plain"))
    report = {r.source_id: r for r in crawl(store, registry, docs, Indexing(mixed, "m")).collect()}
    assert report["s"].error == "mixed dimensions in s:a.md" and report["s"].indexed_files == 0
    assert report["t"].error is None and report["t"].indexed_files == 1
    report = crawl(store, registry, docs, Indexing(lambda texts: [], "m2")).collect()
    assert all("0 vectors" in row.error for row in report)
    assert _rows(store.chunks(), "source_id") == [("t",)]


def test_missing_root_keeps_the_index(spark, store, tree, registry_of):
    registry = registry_of({"source_id": "docs", "path": str(tree)})
    _tree_crawl(store, registry)
    moved = registry_of(
        {"source_id": "docs", "path": str(tree) + "-gone"}, {"source_id": "again", "path": str(tree)}
    )
    report = _tree_crawl(store, moved)
    assert _counts(report) == {"docs": (0, 0, 0, 2), "again": (2, 0, 0, 2)}
    assert report.where("source_id = 'docs'").first().error.startswith("source folder not found")
    assert store.chunks().count() == 4


def test_failed_sync(spark, store, registry_of):
    registry = registry_of({"source_id": "repo", "kind": "git", "url": "u", "branch": "main"})
    documents = _documents(spark, ("repo", "a.md", "alpha"))
    crawl(store, registry, documents, RULES, commits=spark.createDataFrame([("repo", "c1")], COMMITS))
    failed = spark.createDataFrame(
        [("repo", "fatal: https://user:token@host/org/repo.git")], SOURCE_ERRORS)
    report = crawl(store, registry, documents.limit(0), RULES, source_errors=failed).first()
    assert (report.indexed_files, report.removed_files, report.chunk_count) == (0, 0, 1)
    status = store.status().first()
    assert status.last_error == "fatal: https://***@host/org/repo.git" and status.last_commit is None
    assert _rows(store.chunks(), "path") == [("a.md",)]


def test_duplicate_keys_are_refused(spark, store, registry_of):
    registry = registry_of({"source_id": "s"})
    report = crawl(
        store, registry, _documents(spark, ("s", "a.md", "1"), ("s", "b.md", "2"), ("s", "b.md", "3")), RULES
    )
    assert _counts(report) == {"s": (1, 0, 0, 1)}
    assert report.first().error == "2 documents share the path b.md"
    keys = store.files().select("source_id", "path")
    assert keys.count() == keys.distinct().count()


def test_equal_copies_are_one_document(spark, store, registry_of, tmp_path):
    """Also once the copies stop, and when one of them cannot be read."""
    registry = registry_of({"source_id": "s"})
    steps = [
        ([("s", "a.md", "1"), ("s", "b.md", "2"), ("s", "b.md", "2"), ("s", "b.md", "2")], (2, 0, 0, 2), None),
        ([("s", "a.md", "1"), ("s", "b.md", "2")], (0, 2, 0, 2), None),
        ([("s", "a.md", "1"), ("s", "a.md", "1"), ("s", "b.md", "new"), ("s", "b.md", "new")], (1, 1, 0, 2), None),
        ([("s", "a.md", "1"), ("s", "a.md", None, "torn"), ("s", "b.md", "new")], (0, 0, 0, 2), "torn"),
    ]
    for rows, counts, error in steps:
        report = crawl(store, registry, _documents(spark, *rows), RULES)
        assert _counts(report) == {"s": counts} and report.first().error == error
        keys = store.chunks().select("path", "chunk_index")
        assert keys.count() == keys.distinct().count() == 2


def test_commit_ids(spark, store, registry_of):
    registry = registry_of({"source_id": "repo", "kind": "git", "url": "u", "branch": "main"})

    def at(sha, *docs):
        commits = spark.createDataFrame([("repo", sha)], COMMITS)
        crawl(store, registry, _documents(spark, *docs), RULES, commits=commits)
        return store.status().first().last_commit

    assert at("a" * 40, ("repo", "README.md", "alpha")) == "a" * 40
    assert at("b" * 40, ("repo", "README.md", "alpha")) == "b" * 40
    assert store.files().first().commit_sha == "a" * 40
    assert at("c" * 40, ("repo", "README.md", "edited")) == "c" * 40
    assert store.files().first().commit_sha == "c" * 40
    assert store.chunks().first().text == "edited"


def test_scopes_of_questions(spark, store, registry_of):
    """Model, common sources and sources of each question; a retired source is still found."""
    first = registry_of({"source_id": "mines"}, {"source_id": "mills"}, {"source_id": "closed"})
    crawl(store, first, _documents(
        spark, ("mines", "north.md", "tin"), ("mines", "south.md", "zinc"), ("mills", "east.md", "tin"),
        ("closed", "west.md", "tin")), RULES)
    crawl(store, registry_of({"source_id": "labs"}), _documents(spark, ("labs", "assay.md", "tin")),
          Indexing(METALS, "assays"))
    questions = spark.createDataFrame(
        [("any", [1.0, 0.0], None), ("mills", [1.0, 0.0], ["mills"]), ("none", [1.0, 0.0], []),
         ("zinc", [0.0, 1.0], ["mines", "absent"])],
        "query_id string, embedding array<double>, source_ids array<string>",
    )

    def answers(model, **scope):
        found = {}
        for hit in search(questions, store.chunks(), model, **scope).orderBy("query_id", "rank").collect():
            if hit.metadata.score > 0:
                found.setdefault(hit.query_id, set()).add((hit.metadata.source_id, hit.metadata.path))
        return found

    tin = {("mines", "north.md"), ("mills", "east.md"), ("closed", "west.md")}
    assert answers("metals") == {"any": tin, "mills": {("mills", "east.md")}, "zinc": {("mines", "south.md")}}
    assert answers("assays") == {"any": {("labs", "assay.md")}}
    common = questions.drop("source_ids")
    for scope, wanted in ((["mills"], {("mills", "east.md")}), ([], None), (["closed", "mills"], tin - {("mines", "north.md")})):
        hits = search(common.where("query_id = 'any'"), store.chunks(), "metals", source_ids=scope).collect()
        assert ({(h.metadata.source_id, h.metadata.path) for h in hits} or None) == wanted
    assert search(common, store.chunks(), "unknown").count() == 0


def test_text_questions_get_their_prefix(spark, store, registry_of):
    class Marker(ColumnEmbedder):
        def column(self, text):
            return F.when(
                text.startswith("search_document: ") | text.startswith("search_query: "),
                F.array(F.lit(1.0), F.lit(0.0)),
            ).otherwise(F.array(F.lit(0.0), F.lit(1.0)))

    model = "nomic-embed-text"
    registry = registry_of({"source_id": "s"})
    crawl(store, registry, _documents(spark, ("s", "a.md", "plain")), Indexing(Marker(), model))
    row = store.chunks().first()
    assert row.text == "plain" and list(row.embedding) == [1.0, 0.0]
    questions = spark.createDataFrame([(7, "what")], "query_id long, text string")
    hit = search(questions, store.chunks(), model, embedder=Marker()).first()
    assert hit.query_id == 7 and hit.metadata.score == 1.0


def test_lost_run_is_invisible(spark, store, registry_of):
    registry = registry_of({"source_id": "s"})
    crawl(store, registry, _documents(spark, ("s", "a.md", "alpha")), RULES)
    run = store.version().run + 1
    # A run that died before its commit row.
    store.write("chunks", run, store.written("chunks", run - 1).withColumn("path", F.lit("ghost.md")))
    assert _rows(store.chunks(), "path") == [("a.md",)]
    # Neither does it show up when the next run writes no chunks at all.
    crawl(store, registry, _documents(spark, ("s", "a.md", "alpha")), RULES)
    assert store.version().run == run and _rows(store.chunks(), "path") == [("a.md",)]
    crawl(store, registry, _documents(spark, ("s", "b.md", "beta")), RULES)
    assert _rows(store.chunks(), "path") == [("b.md",)]


def test_hash_embedder_index(spark, store, registry_of):
    registry = registry_of({"source_id": "s"})
    docs = _documents(spark, ("s", "a.md", "red green blue"), ("s", "b.md", "one two three"))
    hashed = Indexing(HashEmbedder(64), "hash")
    crawl(store, registry, docs, hashed)
    assert {row.embed_dim for row in store.files().collect()} == {64}
    questions = spark.createDataFrame([(1, "blue red")], "query_id long, text string")
    hits = search(questions, store.chunks(), "hash", embedder=HashEmbedder(64)).orderBy("rank")
    assert hits.first().metadata.path == "a.md"
    assert os.path.isdir(store.root)


def test_few_jobs_a_crawl(spark, store, registry_of):
    """Counts come from the writes themselves; 32 and 25 jobs where each was counted by a job of its own."""
    registry = registry_of({"source_id": "s"}, {"source_id": "t"})
    first = _documents(spark, ("s", "a.md", "1"), ("s", "b.md", "2"), ("t", "c.md", "3"))
    second = _documents(spark, ("s", "a.md", "1"), ("s", "b.md", "changed"))
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for name, documents in (("first", first), ("second", second), ("quiet", second)):
        spark.sparkContext.setJobGroup(name, name)
        crawl(store, registry, documents, RULES)
        jobs.append(len(tracker.getJobIdsForGroup(name)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] <= 20 and jobs[1] <= 20 and jobs[2] <= 14, jobs


def test_only_touched_folders_are_joined_with_retired_keys(spark, store, registry_of, monkeypatch):
    """Folders without retired chunks are read by a scan of their own, without a join."""
    sources = [f"s{i}" for i in range(5)]
    registry = registry_of(*[{"source_id": s} for s in sources])
    texts = {(s, f"{k}.md"): f"text {k} of {s}" for s in sources for k in range(4)}
    crawl(store, registry, _documents(spark, *[(*key, t) for key, t in texts.items()]), RULES)
    texts["s2", "1.md"] = "edited"
    del texts["s2", "3.md"]
    crawl(store, registry, _documents(spark, *[(*key, t) for key, t in texts.items()]), RULES)
    chunks = store.chunks()
    assert _rows(chunks, "source_id", "path", "text") == sorted((*key, t) for key, t in texts.items())
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    branches = plan.split("\n:- ")
    assert plan.startswith("Union") and plan.count("Join LeftAnti") == 1
    files = lambda df: {f.split("/chunks/")[1].rsplit("/", 2)[0] for f in df.inputFiles() if "/chunks/" in f}
    assert len(files(chunks)) == 6
    scans = [line for line in chunks._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "PartitionFilters" in line]
    assert any("NOT" in line or "<=>" in line for line in scans) and len(branches) >= 1
    # The same rows where there are too many folders to tell apart.
    monkeypatch.setattr(index_store, "TOUCHED_FOLDERS", 0)
    assert _rows(store.chunks(), "source_id", "path", "text") == sorted((*key, t) for key, t in texts.items())
