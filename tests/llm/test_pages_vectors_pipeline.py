"""Operators on pages and vectors, and the pipeline, against plain Python."""

import json
import math

import numpy as np
import pytest

import corpus_pipeline
from marlpit.llm import jaccard_join, mixing, pieces, quality_classifier, quality_rules, tiles, warc, wrapper

PAGE = (
    '<!doctype html><html><head><title>T {0}</title><script>var a="</p>";</script></head><body class="has-sidebar">'
    '<nav><a href="/a">{0} menu</a></nav><!-- x --><div class="ad">buy {0}</div>{1}<aside>side</aside>'
    '<div id="comments"><p>I agree with {0}</p></div><footer>&copy; site</footer>'
)
ARTICLE = "<article><h1>About {0}</h1><p><b>First &amp; {0}<br><p>Second\n  {0} &eacute;&#33;</p><form>Mail <input></form></article>"
PLAIN = '<div class="wrap"><div><p>All of {0} and more of {0} is told here.</p></div><div>Join our daily letter today</div></div>'


def pages(spark):
    names = ["amber", "basalt", "cedar", "dune", "ember"]
    made = [(i, "https://one.example/%d" % i, PAGE.format(n, ARTICLE.format(n))) for i, n in enumerate(names)]
    made += [(10 + i, "https://two.example/%d" % i, PAGE.format(n, PLAIN.format(n))) for i, n in enumerate(names)]
    made += [(20, None, None), (21, "x", ""), (0, "https://one.example/0", made[0][2])]
    return spark.createDataFrame(made, "page_id long, url string, html string"), names


def test_wrapper_induction(spark):
    table, names = pages(spark)
    got = [(r.page_id, r.text, r.n_chars) for r in wrapper.extract(table).collect()]
    wanted = [(i, f"About {n} First & {n} Second {n} é!") for i, n in enumerate(names)]
    wanted += [(10 + i, f"All of {n} and more of {n} is told here.") for i, n in enumerate(names)]
    wanted += [(20, ""), (21, ""), wanted[0]]
    assert sorted(got) == sorted((i, t, len(t)) for i, t in wanted)
    assert wrapper.extract(table.filter("page_id < 0")).count() == 0


def test_warc_derivatives(spark):
    table, names = pages(spark)
    records = warc.responses(table)
    source = {r.record_id: r for r in records.collect()}
    derived = warc.derive(records, ("page_id",))
    got = derived.withColumn("bytes", warc.serialise()).collect()
    assert len(got) == 2 * table.count()
    for r in got:
        ((headers, block),) = warc.parse(bytes(r.bytes))
        assert headers["WARC-Refers-To"] == r.refers_to and r.refers_to in source
        assert headers["WARC-Type"] == r.warc_type and block == bytes(r.block)
        assert headers["WARC-Block-Digest"] == warc.digest(block)
        assert headers["WARC-Payload-Digest"] == source[r.refers_to].payload_digest
        if r.warc_type == "metadata" and r.page_id == 0:
            told = json.loads(block)
            assert told["links"] == ["/a"] and told["title"] == "T amber"
            assert told["source"]["headers"] == source[r.refers_to].http_headers
        if r.warc_type == "conversion" and r.page_id == 0:
            assert "Second\n" not in block.decode() and "Second" in block.decode() and "var a" not in block.decode()
    assert warc.derive(records.filter("page_id < 0")).count() == 0


def test_nearest(spark):
    random_ = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(x)) for x in random_.normal(size=12)], i) for i in range(300)]
    vectors += [(300, None, 0), (301, [0.0] * 12, 0), (302, [math.nan] * 12, 0), (303, [None] * 12, 0), (50, vectors[50][1], 0),
                (350, vectors[7][1], 0), (351, vectors[7][1], 0), (352, [1.0, 2.0], 0)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score int")
    got = tiles.nearest(table, table.filter("vec_id % 50 = 0"), query_rows=4, candidate_rows=64).collect()
    usable = {i: np.array(v) for i, v, _ in vectors if v and i not in (301, 302, 303) and len(v) == 12}
    for q in (i for i in usable if i % 50 == 0):
        scored = sorted((-float(usable[q] @ v / math.sqrt(usable[q] @ usable[q] * (v @ v))), i) for i, v in usable.items() if i != q)[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == [i for _, i in scored] and [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score + s) < 1e-12 for r, (s, _) in zip(mine, scored))
    assert {r.query_id for r in got} == {i for i in usable if i % 50 == 0}
    few = table.filter("vec_id IN (0, 3, 4)")
    assert tiles.nearest(few, few.filter("vec_id = 0")).count() == 2
    assert tiles.nearest(table.filter("vec_id < 0"), table).count() == 0


def test_pipeline_does_what_its_stages_say(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    first = docs.join(quality_classifier.quality_scores(docs, labels).filter("predicted = 1").select("doc_id"), "doc_id", "left_semi")
    second = first.join(quality_rules.quality_rules(first).filter("kept").select("doc_id"), "doc_id", "left_semi")
    rows = [(r.doc_id, set(_shingles(r.text))) for r in second.collect()]
    label = {i: i for i, _ in rows}
    for _ in range(4):
        for i, a in rows:
            for j, b in rows:
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    kept = [i for i in label if label[i] == i]
    third = second.filter(second.doc_id.isin(kept))
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(third).collect()}
    got = corpus_pipeline.run(spark, folder).collect()
    counts: dict = {}
    for r in got:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {i: -(-t // n) for i, (n, t) in taken.items() if t}
    assert all(r.round_trip for r in got)
    for step in (corpus_pipeline.quality, corpus_pipeline.rules, corpus_pipeline.one_of_each, corpus_pipeline.mixed):
        assert step(spark, docs.filter("doc_id < 3"), folder).columns == docs.columns
        assert step(spark, docs.filter("doc_id < 0"), folder).count() == 0


def _shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return [tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
