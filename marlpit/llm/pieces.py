"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model's protobuf is parsed and its parts are rebuilt: normaliser (character
map, extra blanks, dummy prefix), metaspace marker, scored pieces and byte
fallback. A unigram model keeps its scores; in a BPE model the scores order the
merges. Where no piece goes on after a marker, runs of blanks with the word after them
are encoded apart, so each distinct one is encoded once a task, in batches by several
threads, by the rebuilt tokenizer and by the original library, whose ids count where
they differ. Every document is decoded again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlpit.llm import distinct, tokens

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
SLICE_BYTES = 1 << 21
REMEMBERED = 1 << 19
# Kinds of pieces in the protobuf.
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6


def rebuild(model: bytes) -> str:
    """The tokenizer of a SentencePiece model, as the JSON of the tokenizers library."""
    from sentencepiece import sentencepiece_model_pb2
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    normal, trained = proto.normalizer_spec, proto.trainer_spec
    steps = []
    if normal.precompiled_charsmap:
        steps.append(normalizers.Precompiled(normal.precompiled_charsmap))
    if normal.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if normal.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if normal.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
    has_bytes = any(p.type == BYTE for p in proto.pieces)
    if trained.model_type == 1:
        scored = [(p.piece, p.score) for p in proto.pieces]
        backend = models.Unigram(scored, unk_id=unknown, byte_fallback=has_bytes)
    elif trained.model_type == 2:
        ids = {p.piece: i for i, p in enumerate(proto.pieces)}
        backend = models.BPE(
            ids, merges(proto.pieces, ids), unk_token=proto.pieces[unknown].piece, fuse_unk=True,
            byte_fallback=has_bytes, cache_capacity=1 << 16,
        )
    else:
        raise ValueError(f"pieces of model type {trained.model_type} are not supported")
    tokenizer = Tokenizer(backend)
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    if _marks_lead(proto):
        # No merge crosses the border before a run of markers: words can be cached.
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if normal.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer.to_str()


def _marks_lead(proto) -> bool:
    """Whether no piece goes on with a marker after other characters."""
    return not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)


def apart(model: bytes) -> bool:
    """Whether texts may be cut before each run of blanks without changing their ids.

    So it is where texts stay as they are but for marker and dummy prefix, unknown
    characters become bytes of their own, and pieces have markers in front only.
    """
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    normal, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
    plain = normal.add_dummy_prefix and normal.escape_whitespaces
    changed = normal.precompiled_charsmap or normal.remove_extra_whitespaces
    return bool(plain and not changed and BYTE in kinds and USER_DEFINED not in kinds and _marks_lead(proto))


def units(texts: tokens.Texts, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the parts that are encoded apart, without their first blank.

    A text that holds the marker itself is one part, and so is every text if not `cut`.
    """
    data, full = texts.data, np.diff(texts.offsets) > 0
    starts, ends = texts.offsets[:-1][full], texts.offsets[1:][full]
    border = np.zeros(0, np.int64)
    if cut and len(data):
        blank = data == 32
        blank[1:] &= data[:-1] != 32
        blank[starts] = False
        # Blanks that begin a run; one at the end of the text before is none of this text's.
        border = np.flatnonzero(blank)
        mark = np.frombuffer(MARK.encode(), np.uint8)
        held = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2]))
        if len(held):
            whole = np.unique(np.searchsorted(texts.offsets, held, side="right") - 1)
            border = border[~np.isin(np.searchsorted(texts.offsets, border, side="right") - 1, whole)]
    starts, ends = np.sort(np.concatenate([starts, border + 1])), np.sort(np.concatenate([ends, border]))
    # An empty part stands where its text ends, after that text's last blank.
    return starts, ends, np.searchsorted(texts.offsets, np.where(starts == ends, starts - 1, starts), side="right") - 1


def merges(pieces, ids: dict[str, int]) -> list[tuple[str, str]]:
    """All ways to make a piece of two, best score first."""
    ways = []
    for p in pieces:
        if p.type in (NORMAL, USER_DEFINED) and len(p.piece) > 1:
            for at in range(1, len(p.piece)):
                left, right = p.piece[:at], p.piece[at:]
                if left in ids and right in ids:
                    ways.append((-p.score, ids[p.piece], ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(ways)]


class Spelling:
    """The bytes that each piece stands for, to compare ids with whole texts at once."""

    def __init__(self, tokenizer):
        spelled = []
        for i in range(tokenizer.get_vocab_size()):
            piece = tokenizer.id_to_token(i) or ""
            if len(piece) == 6 and piece.startswith("<0x"):
                spelled.append(bytes.fromhex(piece[3:5]))
            else:
                spelled.append(piece.replace(MARK, " ").encode())
        self.lengths = np.array([len(x) for x in spelled])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def agree(self, texts: tokens.Texts, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text whether its ids, ids[bounds[i]:bounds[i + 1]], spell it after one blank."""
        lengths = self.lengths[ids]
        places = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[ids] - places[:-1], lengths) + np.arange(places[-1])
        back = self.bytes[at]
        own = places[bounds]
        full = np.diff(texts.offsets) > 0
        wanted = np.diff(texts.offsets) + full
        good = np.diff(own) == wanted
        if good.all():
            given = np.insert(texts.data, texts.offsets[:-1][full], 32)
            wrong = np.flatnonzero(given != back)
            good[np.searchsorted(own, wrong, side="right") - 1] = False
            return good
        for i in np.flatnonzero(good & full):
            text = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
            part = back[own[i] : own[i + 1]]
            good[i] = part[0] == 32 and (part[1:] == text).all()
        return good


def encode(docs: DataFrame, model: bytes, threads: int = THREADS, carry: tuple = ()) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip, parity and the columns in `carry`, a row for each row of `docs`.

    round_trip says whether the ids decode to the text itself (to its normal form
    where the model's normaliser changes texts). parity says whether the original
    library gives the same ids as the rebuilt tokenizer for every part of the text;
    where not, ids are the original's. Null and empty texts have no tokens and parity.
    Repeated rows give equal rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((rebuild(model), model, apart(model)))

    def run(batches):
        import os

        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        rebuilt, given, cut = shared.value
        tokenizer, original = Tokenizer.from_str(rebuilt), SentencePieceProcessor(model_proto=given)
        spelled = Spelling(tokenizer)

        def both(parts):
            own = [e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            wanted = original.encode(parts, num_threads=1)
            if "" in parts:  # what is left of a blank at the end of a text
                at = parts.index("")
                own[at], wanted[at] = [tokenizer.token_to_id(MARK)], [original.piece_to_id(MARK)]
            return wanted, [a == b for a, b in zip(own, wanted)]

        table = distinct.PartIds(both, REMEMBERED)
        for batch in batches:
            text_column = batch.column("text")
            for part in tokens.slices(text_column, SLICE_BYTES):
                starts, ends, owner = units(part, cut)
                ids, sizes, same = table.of(distinct.parts(part.data, starts, ends))
                counts = np.bincount(owner, weights=sizes, minlength=part.count).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                parity = np.bincount(owner[~same], minlength=part.count) == 0
                trip = spelled.agree(part, ids, bounds)
                for i in np.flatnonzero(~trip):
                    text = text_column[part.first + i].as_py() or ""
                    back = tokenizer.decode(ids[bounds[i] : bounds[i + 1]].tolist(), skip_special_tokens=False)
                    trip[i] = back in (text, original.normalize(text).replace(MARK, " ").removeprefix(" "))
                rows = batch.slice(part.first, part.count).drop_columns(["text"])
                for name, column in (
                    ("n_tokens", pa.array(counts)), ("ids", pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))),
                    ("round_trip", pa.array(trip)), ("parity", pa.array(parity)),
                ):
                    rows = rows.append_column(name, column)
                yield rows

    given = docs.select("doc_id", *carry, "text")
    fields = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    schema = f"{fields}, n_tokens long, ids array<int>, round_trip boolean, parity boolean"
    return given.mapInArrow(run, schema).select("doc_id", "n_tokens", "ids", "round_trip", "parity", *carry)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(rebuild(model))

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            texts = tokenizer.decode_batch(ids, skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()
