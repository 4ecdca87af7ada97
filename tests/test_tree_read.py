"""Reading single files of a tree, and folders that cannot be listed."""

from marlpit.index import DocumentIndex
from marlpit.operators.embedding import HashEmbedder
from marlpit.plans.crawl import Indexing
from marlpit.sources import tree


def test_read_by_path(spark, registry_of, tmp_path):
    root = tmp_path / "tree"
    (root / "dist").mkdir(parents=True)
    (root / "dist" / "built.md").write_text("built")
    (root / "plain.md").write_text("one\ntwo\nthree\n")
    (tmp_path / "secret.md").write_text("secret")
    (root / "leak.md").symlink_to(tmp_path / "secret.md")
    registry = registry_of({"source_id": "s", "path": str(root)}, {"source_id": "gone", "path": str(tmp_path / "no")})
    index = DocumentIndex(spark, str(tmp_path / "index"), registry, Indexing(HashEmbedder(8), "hash-8"))
    requests = spark.createDataFrame(
        [(1, "s", "dist/built.md", None, None), (2, "s", "leak.md", None, None), (3, "s", "dist//built.md", None, None),
         (4, "s", "nothing.md", None, None), (5, "gone", "plain.md", None, None), (6, "s", "plain.md", 2, 2)],
        "request_id int, source_id string, path string, start_line int, end_line int",
    )
    got = {r.request_id: (r.text, r.error) for r in index.read(requests).collect()}
    assert got[1] == ("built", None) and got[3] == ("built", None)
    assert got[2] == (None, "unsafe_path")
    assert got[4] == (None, "missing_document")
    assert got[5] == (None, "source_not_on_disk")
    assert got[6] == ("two", None)


def test_unlistable_folder_is_an_error(tmp_path):
    (tmp_path / "file").write_text("not a folder")
    assert list(tree._entries("s", str(tmp_path), "file")) == [("s", str(tmp_path), "file", 0, "failed")]
