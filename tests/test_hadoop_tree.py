"""Trees read through Spark's own file source beside the walk over mounts."""

import pytest

from marlpit.index import DocumentIndex
from marlpit.operators.embedding import HashEmbedder
from marlpit.plans.crawl import Indexing
from marlpit.sources.store import IndexStore
from marlpit.sources import hadoop_tree
from marlpit.sources.tree import scan_tree
from tests.test_crawl import RULES, _counts, _rows
from marlpit.plans.crawl import crawl


@pytest.fixture
def folder(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("a.md", "deep/er/b c.md", "deep/[x]{1}.md", "node_modules/n.md", "drafts/d.md", "t.txt", "schön/ü%20.md"):
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(f"text of {name}".encode())
    (root / "bin.md").write_bytes(b"\xff\xfe")
    (root / "empty.md").write_bytes(b"")
    (tmp_path / "file").write_text("no folder")
    return root


@pytest.fixture
def store_uri(spark, tmp_path):
    """The folder of the test as a store of its own: Hadoop keeps a store once it is opened."""
    name = "box" + "".join(c for c in str(tmp_path) if c.isalnum())
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./data", f"file://{tmp_path}")
    return f"viewfs://{name}/data"


def _scanned(registry):
    scan = scan_tree(registry)
    documents = sorted((r.path, bytes(r.content) if r.content is not None else None, r.error) for r in scan.documents.collect())
    return documents, sorted(map(tuple, scan.source_errors.collect()))


@pytest.mark.parametrize("as_file", [False, True])
def test_same_rows_as_the_mount(spark, folder, store_uri, registry_of, as_file):
    def roots(base):
        return [{"source_id": s, "path": f"{base}/{name}"} for s, name in (("s", "tree"), ("f", "file"), ("gone", "nothing"))]

    globs = {"include": ["**/*.md"], "exclude": ["drafts/*"]}
    by_mount, mount_errors = _scanned(registry_of(*roots(folder.parent), **globs))
    by_store, store_errors = _scanned(registry_of(*roots(f"file://{folder.parent}" if as_file else store_uri), **globs))
    assert by_store == by_mount and len(by_mount) == 6
    assert [s for s, _ in store_errors] == [s for s, _ in mount_errors] == ["f", "gone"]


def test_a_crawl_of_mounts_and_stores(spark, folder, store_uri, registry_of, tmp_path):
    """Only changed files are opened again, and a lost root keeps its files."""
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "p.md").write_text("tin")
    registry = registry_of({"source_id": "m", "path": str(tmp_path / "plain")}, {"source_id": "v", "path": f"{store_uri}/tree/deep"})
    store = IndexStore(spark, str(tmp_path / "index"))
    assert _counts(crawl(store, registry, scan_tree(registry), RULES)) == {"m": (1, 0, 0, 1), "v": (2, 0, 0, 2)}
    (folder / "deep/er/b c.md").write_text("zinc")
    (folder / "deep/[x]{1}.md").unlink()
    assert _counts(crawl(store, registry, scan_tree(registry), RULES)) == {"m": (0, 1, 0, 1), "v": (1, 0, 1, 1)}
    assert _rows(store.chunks(), "path", "text") == [("er/b c.md", "zinc"), ("p.md", "tin")]
    (folder / "deep").rename(folder / "moved")
    report = crawl(store, registry, scan_tree(registry), RULES)
    assert {r.source_id: r.error for r in report.collect()}["v"].startswith("source folder not found")
    assert store.chunks().count() == 2


def test_read_from_a_store(spark, folder, store_uri, registry_of, tmp_path):
    registry = registry_of({"source_id": "s", "path": f"{store_uri}/tree"}, {"source_id": "gone", "path": f"{store_uri}/no"},
                           {"source_id": "m", "path": str(folder)})
    index = DocumentIndex(spark, str(tmp_path / "index"), registry, Indexing(HashEmbedder(8), "hash-8"))
    asked = ["deep/er/b c.md", "node_modules/n.md", "deep//er/b c.md", "../file", "nothing.md", "schön/ü%20.md", "deep", "deep/[x]{1}.md"]
    requests = spark.createDataFrame(
        [(10 * k + i, s, p, None, None) for k, s in enumerate(("s", "m")) for i, p in enumerate(asked)] + [(90, "gone", "a.md", None, None)],
        "request_id int, source_id string, path string, start_line int, end_line int",
    )
    got = {r.request_id: (r.text, r.error) for r in index.read(requests).collect()}
    assert [got[i] for i in range(8)] == [got[10 + i] for i in range(8)] == [
        ("text of deep/er/b c.md", None), ("text of node_modules/n.md", None), ("text of deep/er/b c.md", None), (None, "unsafe_path"),
        (None, "missing_document"), ("text of schön/ü%20.md", None), (None, "missing_document"), ("text of deep/[x]{1}.md", None),
    ]
    assert got[90] == (None, "source_not_on_disk")


def test_many_files_are_joined_not_named(spark, registry_of, tmp_path, monkeypatch):
    """Beyond a bound no name becomes a literal of the plan; contents are the same either way."""
    root = tmp_path / "many"
    root.mkdir()
    texts = {f"{name}.md": f"text of {name}" for name in ("plain", "it's", "a b", "a+b", "é", "x%20y")} | {"empty.md": ""}
    for name, text in texts.items():
        (root / name).write_text(text)
    registry = registry_of({"source_id": "s", "path": f"file://{root}"})
    for bound in (100, 3):
        monkeypatch.setattr(hadoop_tree, "FILES_PER_READER", bound)
        documents = scan_tree(registry).documents
        plan = documents._jdf.queryExecution().optimizedPlan().toString()
        assert ("_metadata" in plan or "file_path" in plan) == (bound == 100)
        assert {r.path: (bytes(r.content).decode(), r.error) for r in documents.collect()} == {k: (v, None) for k, v in texts.items()}


def test_listing_is_kept_in_few_files(spark, registry_of, tmp_path):
    """However small the tasks are that Spark deals a tree's files to."""
    root = tmp_path / "wide"
    root.mkdir()
    for i in range(60):
        (root / f"{i}.md").write_text(str(i))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        files = scan_tree(registry_of({"source_id": "s", "path": f"file://{root}"})).files
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert files.count() == 60
    assert len(files.inputFiles()) <= 16
