"""Large trees on mounted file systems, named by URI: tasks list and open them, as Spark's reader would."""

import pytest

from marlpit.index import DocumentIndex
from marlpit.operators.embedding import HashEmbedder
from marlpit.plans.crawl import Indexing
from marlpit.sources import hadoop_tree
from marlpit.sources.tree import scan_tree


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "tree"
    names = ("a.md", "it's.md", "x%20y.md", "deep/[x]{1}.md", "deep/er/b c.md", "_hidden.md", ".dot.md", "_k=v/seen.md", "_no/n.md", "part._COPYING_",
             "node_modules/n.md", "schön/ü.md", "t.txt")
    for name in names:
        file = top / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"text of {name}")
    (top / "empty.md").write_bytes(b"")
    (top / "lost.md").symlink_to(top / "nothing.md")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "o.md").write_text("other")
    (top / "linked").symlink_to(tmp_path / "other")
    return top


def rows(scan):
    documents = sorted((r.source_id, r.path, r.content and bytes(r.content), r.error) for r in scan.documents.collect())
    return documents, sorted(map(tuple, scan.source_errors.collect()))


def test_tasks_list_what_the_reader_lists(spark, registry_of, root, monkeypatch):
    registry = registry_of({"source_id": "s", "path": f"file://{root}"}, {"source_id": "same", "path": f"file://{root}"},
                           {"source_id": "deep", "path": f"file:{root}/deep"}, {"source_id": "gone", "path": f"file://{root}/no"},
                           {"source_id": "f", "path": f"file://{root}/a.md"})
    by_reader, errors = rows(scan_tree(registry))
    monkeypatch.setattr(hadoop_tree, "FILES_PER_READER", 3)
    asked = []
    reader = hadoop_tree._reader
    monkeypatch.setattr(hadoop_tree, "_reader", lambda spark, tops: (asked.extend(tops), reader(spark, tops))[1])
    assert rows(scan_tree(registry)) == (by_reader, errors)
    assert not asked  # the driver listed no files
    assert {p for s, p, *_ in by_reader if s == "s"} >= {"_k=v/seen.md", "linked/o.md", "empty.md", "deep/[x]{1}.md", "schön/ü.md"}


def test_links_that_lead_back_end(spark, registry_of, root, monkeypatch):
    monkeypatch.setattr(hadoop_tree, "FILES_PER_READER", 3)
    (root / "deep" / "up").symlink_to(root)
    paths = [r.path for r in scan_tree(registry_of({"source_id": "s", "path": f"file://{root}"})).files.collect()]
    assert paths and not [p for p in paths if "up/" in p]


def test_read_of_walked_trees(spark, registry_of, root, tmp_path, monkeypatch):
    registry = registry_of({"source_id": "s", "path": f"file://{root}"}, {"source_id": "gone", "path": f"file://{tmp_path}/no"})
    asked = ["deep/er/b c.md", "node_modules/n.md", "deep//er/b c.md", "../other/o.md", "nothing.md", "_hidden.md", "empty.md", "deep", "x%20y.md"]
    requests = spark.createDataFrame(
        [(i, "s", p, None, None) for i, p in enumerate(asked)] + [(90, "gone", "a.md", None, None)],
        "request_id int, source_id string, path string, start_line int, end_line int",
    )
    index = DocumentIndex(spark, str(tmp_path / "index"), registry, Indexing(HashEmbedder(8), "hash-8"))
    by_reader = sorted(map(tuple, index.read(requests).collect()))
    monkeypatch.setattr(hadoop_tree, "FILES_PER_READER", 3)
    monkeypatch.setattr(hadoop_tree, "_reader", lambda spark, tops: None if not tops else pytest.fail("the driver lists files"))
    assert sorted(map(tuple, index.read(requests).collect())) == by_reader


def test_a_tree_that_cannot_be_listed_fails_as_a_whole(spark, registry_of, root, monkeypatch):
    monkeypatch.setattr(hadoop_tree, "FILES_PER_READER", 0)
    listed = hadoop_tree.list_roots(
        spark, [hadoop_tree.Root("s", f"file://{root}")],
        lambda folders: spark.createDataFrame([(f"file://{root}", str(root), "a.md", 1, "file"), (f"file://{root}", str(root), "deep", 0, "failed")], hadoop_tree.LISTING),
    )
    assert [tuple(r) for r in listed.rows.collect()] == [("s", f"file://{root}", "", 0, "failed")]
    assert listed.reader is None and not listed.walked
