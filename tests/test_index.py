"""The whole life of an index, and random histories against a plain model."""

import hashlib
import random

from marlpit.index import DocumentIndex
from marlpit.model import DOCUMENTS, READ_REQUESTS
from marlpit.operators.embedding import RuleEmbedder
from marlpit.operators.reports import any_failed, report_lines
from marlpit.plans.crawl import Indexing, crawl
from marlpit.sources.store import IndexStore


def _written(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")


def test_two_sources_from_trees_to_answers(spark, tmp_path, registry_of):
    """A folder of records and a checkout that arrives only after the first crawl."""
    records, checkout = tmp_path / "records", tmp_path / "data/sources/tools"
    _written(records, {
        "2020/tin.txt": "tin is soft\nit melts early\n",
        "2021/zinc.txt": "zinc protects iron\n",
        "2021/zinc.txt.bak": "zinc, an older copy\n",
    })
    registry = registry_of(
        {"source_id": "records", "path": str(records), "include": ["**/*.txt*"], "exclude": ["**/*.bak"]},
        {"source_id": "tools", "kind": "git", "url": "ssh://code.example/tools", "include": ["*.py"]},
    )
    metals = RuleEmbedder({"tin": [2.0, 0.0], "zinc": [0.0, 2.0]}, [-1.0, -1.0])
    index = DocumentIndex(
        spark, str(tmp_path / "index"), registry, Indexing(metals, "metals"), str(tmp_path / "data")
    )

    def listed():
        return {r.id: (r.chunk_count, r.last_commit) for r in index.list_sources().collect()}

    report = index.crawl(only_local=True)
    assert {(r.source_id, r.indexed_files, r.chunk_count) for r in report.collect()} == {("records", 2, 2)}
    assert [row.line.split(":")[0] for row in report_lines(report).collect()] == ["records"]
    assert not any_failed(report).first().failed
    assert listed() == {"records": (2, None), "tools": (0, None)}

    _written(checkout, {"smelt.py": "def smelt(ore):\n    return 'zinc'\n"})
    index.crawl(commits=spark.createDataFrame([("tools", "9f2")], "source_id string, commit_sha string"))
    assert listed() == {"records": (2, None), "tools": (1, "9f2")}

    questions = spark.createDataFrame(
        [("soft", "which metal is like tin"), ("cover", "what does zinc do")], "query_id string, text string")
    best = {}
    for hit in index.search(questions, k=3).collect():
        best.setdefault(hit.query_id, set()).add((hit.metadata.source_id, hit.metadata.path, hit.metadata.score))
    assert ("records", "2020/tin.txt", 1.0) in best["soft"]
    assert {hit for hit in best["cover"] if hit[2] > 0} == {("records", "2021/zinc.txt", 1.0), ("tools", "smelt.py", 1.0)}

    asked = spark.createDataFrame(
        [(1, "records", "2020/tin.txt", 2, 2), (2, "records", "2021/zinc.txt.bak", None, None),
         (3, "records", "2021/../../data/x", None, None), (4, "mines", "x", None, None)], READ_REQUESTS)
    got = {r.request_id: (r.text, r.error) for r in index.read(asked).collect()}
    # What indexing leaves out can be read all the same.
    assert got == {1: ("it melts early", None), 2: ("zinc, an older copy\n", None),
                   3: (None, "unsafe_path"), 4: (None, "unknown_source")}


def test_random_histories(spark, tmp_path, registry_of):
    """Edits, deletions, failures and model changes over several crawls."""
    rng = random.Random(11)
    store = IndexStore(spark, str(tmp_path / "index"))
    sources = ["a", "b"]
    registry = registry_of(*[{"source_id": s} for s in sources])
    names = ["x.md", "d/y.md", "d-z.md", "w.md", "d/e/v.md"]

    def embed(texts):
        if any("boom" in text for text in texts):
            raise ValueError("boom")
        return [[1.0, 2.0]] * len(texts)

    stored = {}
    for _ in range(4):
        model = rng.choice(["m1", "m1", "m2"])
        tree = {(s, n): rng.choice(["one", "two", "three", "boom", " "])
                for s in sources for n in names if rng.random() < 0.7}
        documents = spark.createDataFrame(
            [(s, n, text.encode(), None) for (s, n), text in tree.items()], DOCUMENTS)
        report = crawl(store, registry, documents, Indexing(embed, model))
        wanted = {}
        for source in sources:
            tally = [0, 0, 0]
            error = None
            for key in sorted((k for k in tree if k[0] == source), key=lambda k: k[1].split("/")):
                if stored.get(key) == (tree[key], model):
                    tally[1] += 1
                elif tree[key] == "boom":
                    error = "boom"
                    break
                else:
                    stored[key] = (tree[key], model)
                    tally[0] += 1
            if error is None:
                for key in [k for k in stored if k[0] == source and k not in tree]:
                    del stored[key]
                    tally[2] += 1
            live = sum(1 for k, (text, _) in stored.items() if k[0] == source and text.strip())
            wanted[source] = (*tally, live, error)
        got = {r.source_id: (r.indexed_files, r.skipped_files, r.removed_files, r.chunk_count, r.error)
               for r in report.collect()}
        assert got == wanted
        files = {(r.source_id, r.path): (r.content_hash, r.embed_model) for r in store.files().collect()}
        assert files == {k: (hashlib.sha256(t.encode()).hexdigest(), m) for k, (t, m) in stored.items()}
        chunks = {(r.source_id, r.path): (r.text, r.embed_model) for r in store.chunks().collect()}
        assert chunks == {k: v for k, v in stored.items() if v[0].strip()}
        assert store.chunks().count() == len(chunks)
