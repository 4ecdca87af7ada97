"""Token ids of all documents against the original library."""

import corpus_pipeline
from marlpit.llm import pieces

TEXTS = [f"Line {i} of text,  with odd blanks\t　and schöne Wörter नमस्ते {i * 7919}" for i in range(40)]
TEXTS += [None, "", " ", "  ", "a ", " a", "a  ", " \n ", "x  y   z ", "own ▁ mark ▁▁and more", "▁", "a▁ ", "b ", "\u00a0 \t x", "<s> </s> <0x41> ", "é\u0301 ", "end "]


def table(spark):
    return spark.createDataFrame([(i, t, "a") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")


def original(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=pieces.read_model())
    return {i: library.encode(t or "") for i, t in enumerate(TEXTS)}


def test_every_document_is_compared(spark):
    got = pieces.encode(table(spark), pieces.read_model()).collect()
    assert [r.parity for r in got] == [True] * len(TEXTS)
    assert {r.doc_id: r.ids for r in got} == original(spark)
    encoded = corpus_pipeline.encoded(spark, table(spark), "").collect()
    assert [r.parity for r in encoded] == [True] * len(TEXTS)


def test_ids_that_differ_are_told_and_replaced(spark, monkeypatch):
    merges = pieces.merges
    monkeypatch.setattr(pieces, "merges", lambda *given: merges(*given)[::-1])
    got = pieces.encode(table(spark), pieces.read_model()).collect()
    assert {r.parity for r in got if r.doc_id < 40} == {False}
    assert {r.doc_id: r.ids for r in got} == original(spark) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_parts_are_those_of_whole_texts(spark, monkeypatch):
    """The same ids with texts cut before blanks and uncut, also for a part without bytes at the end of a slice."""
    monkeypatch.setattr(pieces, "apart", lambda model: False)
    uncut = {r.doc_id: (r.ids, r.parity, r.round_trip) for r in pieces.encode(table(spark), pieces.read_model()).collect()}
    monkeypatch.undo()
    assert pieces.apart(pieces.read_model())
    cut = {r.doc_id: (r.ids, r.parity, r.round_trip) for r in pieces.encode(table(spark).coalesce(1), pieces.read_model()).collect()}
    assert cut == uncut
