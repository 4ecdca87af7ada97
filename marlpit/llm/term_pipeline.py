"""Ranked lexical search by pipelined term partitioning.

Documents are cut into bounded blocks; a block keeps, for each term that some item
asks for, its places and counts. Terms belong to owners by how many documents hold
them, the rarest first. Bundles of items visit the owners one after another: each
stage cogroups the accumulators of a (block, bundle) with the owner's postings of
that block and adds their integer contributions. Between stages the tenth best score
so far is a floor: accumulators, and items, that cannot reach it with all that later
owners may add are closed. The last stage's accumulators hold the final scores.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marlpit.runtime import broadcast_if_small, discard, stage

# What a term is, which letters are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOP = 10
# An owner holds the terms that at most one document in so many holds; the last one all others.
OWNERS = (256, 32, 4)
# A block is closed at so many documents or postings, whichever comes first.
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 20
BUNDLE_ITEMS = 128
# Vocabularies up to this size travel to the texts; larger ones are joined.
VOCABULARY_TERMS = 1 << 18
VOCABULARY_BYTES = 1 << 24
PLAN_ROWS = 50_000
POSTINGS = "block long, term string, places array<int>, counts array<int>, lengths array<int>, held long, total long"


def _bytes_to_terms() -> bytes:
    """Separators become blanks and A-Z small letters; bytes of other characters stay."""
    table = bytearray(range(256))
    for value in range(128):
        letter = chr(value)
        if not letter.isalnum():
            table[value] = 32
        elif letter.isupper():
            table[value] = value + 32
    return bytes(table)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms; rows of one id are one item."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return (
        items.select("item_id", F.explode(found).alias("term"))
        .groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    )


def _bundled(items: DataFrame) -> DataFrame:
    """bundle, slot, item_id, terms: items dealt into bundles, numbered from 0 within one."""
    wanted = stage(item_terms(items), "item-terms")
    bundles = max(1, -(-wanted.count() // BUNDLE_ITEMS))
    dealt = wanted.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int"))
    slot = F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1
    return stage(dealt.withColumn("slot", slot), "bundles")


def _blocks(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings by block, and a row without term for each block's documents.

    `held` counts the documents of a row; `total`, of rows without term, all terms.
    """
    size = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    if size[0] <= VOCABULARY_TERMS and size[1] <= VOCABULARY_BYTES:
        terms = sorted(row["term"] for row in vocabulary.collect())
        return given.mapInArrow(_scan(terms), f"{POSTINGS}, ids array<{kind}>")
    spelled = stage(
        given.mapInArrow(_scan(None), f"block long, place int, length int, doc_id {kind}, spelled array<string>, counts array<int>"),
        "spelled",
    )
    words = spelled.select("block", "place", "length", F.explode(F.arrays_zip("spelled", "counts")).alias("word"))
    posting = F.sort_array(F.collect_list(F.struct("place", F.col("word.counts").alias("count"), "length")))
    lists = (
        words.join(vocabulary, F.col("word.spelled") == F.col("term"))
        .groupBy("block", "term").agg(posting.alias("p"))
        .select(
            "block", "term", F.col("p.place").alias("places"), F.col("p.count").alias("counts"),
            F.col("p.length").alias("lengths"), F.size("p").cast("long").alias("held"), F.lit(0).cast("long").alias("total"),
            F.lit(None).cast(f"array<{kind}>").alias("ids"),
        )
    )
    every = F.sort_array(F.collect_list(F.struct("place", F.struct("doc_id").alias("id"), "length")))
    own = spelled.groupBy("block").agg(every.alias("p"), F.sum("length").alias("total")).select(
        "block", F.lit(None).cast("string").alias("term"), F.col("p.place").alias("places"),
        F.array().cast("array<int>").alias("counts"), F.col("p.length").alias("lengths"),
        F.size("p").cast("long").alias("held"), "total", F.col("p.id.doc_id").alias("ids"),
    )
    return lists.unionByName(own)


def _scan(terms: list[str] | None):
    """A function over Arrow batches (doc_id, text): postings of `terms`, or, without, documents spelled out."""
    table = _bytes_to_terms()
    docs_most, postings_most = BLOCK_DOCS, BLOCK_POSTINGS

    def lists(values, ends) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        number = None if terms is None else {term.encode(): i for i, term in enumerate(terms)}
        block, ids, lengths, found, counts, held = 0, [], [], [], [], []

        def closed():
            lengths_, n = np.array(lengths, np.int32), len(ids)
            doc_ids = pa.concat_arrays(ids)
            place = np.repeat(np.arange(n, dtype=np.int32), held)
            if number is None:
                ends = np.concatenate([[0], np.cumsum(held)])
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, base + block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(lengths_), doc_ids,
                        lists(pa.array(found, pa.binary()).cast(pa.string()), ends), lists(pa.array(counts, pa.int32()), ends),
                    ],
                    names=["block", "place", "length", "doc_id", "spelled", "counts"],
                )
            which = np.array(found, np.int32)
            order = np.argsort(which, kind="stable")
            used, sizes = np.unique(which, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(sizes), [len(which) + n]])
            places = np.concatenate([place[order], np.arange(n, dtype=np.int32)])
            all_lengths = np.concatenate([lengths_[place[order]], lengths_])
            all_counts = np.concatenate([np.array(counts, np.int32)[order], np.zeros(n, np.int32)])
            rows = len(used) + 1
            own = np.zeros(rows + 1, np.int32)
            own[-1] = n
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, base + block)), pa.array([terms[i] for i in used] + [None], pa.string()),
                    lists(pa.array(places), ends), lists(pa.array(all_counts), ends), lists(pa.array(all_lengths), ends),
                    pa.array(np.append(sizes, n).astype(np.int64)),
                    pa.array(np.append(np.zeros(len(used), np.int64), lengths_.sum(dtype=np.int64))), lists(doc_ids, own),
                ],
                names=["block", "term", "places", "counts", "lengths", "held", "total", "ids"],
            )

        for batch in batches:
            doc_ids = batch.column("doc_id")
            for row, text in enumerate(batch.column("text")):
                value = text.as_py()
                words = value.translate(table).split() if value else []
                if not words:
                    continue
                bag = Counter(words)
                mine = bag.keys() if number is None else [w for w in bag if w in number]
                found.extend(mine if number is None else [number[w] for w in mine])
                counts.extend([bag[w] for w in mine])
                held.append(len(mine))
                lengths.append(len(words))
                ids.append(doc_ids.slice(row, 1))
                if len(ids) >= docs_most or len(found) >= postings_most:
                    yield closed()
                    block += 1
                    ids, lengths, found, counts, held = [], [], [], [], []
        if ids:
            yield closed()

    return run


def _factor(documents: int, total: int) -> Column:
    """What each posting of a row is worth before its term's weight."""
    worth = (
        f"(1000000000L * c) div (1000L * c + 8L * (10L + (90L * n * {documents}L) div {total}L))"
    )
    return F.expr(f"zip_with(counts, lengths, (c, n) -> {worth})")


def _advance(last: bool):
    """Adds an owner's postings to the accumulators of a (block, bundle)."""
    top, places_most = TOP, BLOCK_DOCS

    def run(key, left, right):
        scores = np.zeros((0, places_most), np.int64)

        def reach(slot: int) -> None:
            nonlocal scores
            if slot >= len(scores):
                scores = np.concatenate([scores, np.zeros((slot + 1 - len(scores), places_most), np.int64)])

        for row in left.to_batches():
            for i in range(row.num_rows):
                slots, places, values, need = (row.column(c)[i].values.to_numpy() for c in ("slots", "places", "scores", "need"))
                good = values >= need[slots]
                if good.any():
                    reach(int(slots[good].max()))
                    scores[slots[good], places[good]] = values[good]
        known = scores > 0
        for row in right.to_batches():
            for i in range(row.num_rows):
                slots, opened, places, adds = (
                    row.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("of_slots", "of_open", "places", "adds")
                )
                opened = opened.astype(bool)
                if opened.any():
                    reach(int(slots[opened].max()))
                    scores[np.ix_(slots[opened], places)] += adds
                shut = slots[~opened]
                shut = shut[shut < len(known)]
                if len(shut):
                    cells = np.ix_(shut, places)
                    scores[cells] += adds * known[cells]
        best_slots, best = [], []
        for slot in range(len(scores)):
            line = scores[slot][scores[slot] > 0]
            if len(line) > top:
                line = np.partition(line, len(line) - top)[-top:]
                if last:  # nothing is added any more: what is below a block's tenth is out
                    scores[slot][scores[slot] < line.min()] = 0
            best_slots.append(np.full(len(line), slot, np.int32))
            best.append(line)
        slots, places = np.nonzero(scores)
        if not len(slots):
            return _ACCUMULATORS.empty_table()
        row = [
            [key[0].as_py()], [key[1].as_py()], [slots.astype(np.int32)], [places.astype(np.int32)], [scores[slots, places]],
            [np.concatenate(best_slots)], [np.concatenate(best)],
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(row, _ACCUMULATORS)], schema=_ACCUMULATORS)

    return run


_ACCUMULATORS = pa.schema(
    [
        ("of_block", pa.int64()), ("of_bundle", pa.int32()), ("slots", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())),
        ("scores", pa.list_(pa.int64())), ("best_slots", pa.list_(pa.int32())), ("best", pa.list_(pa.int64())),
    ]
)
ACCUMULATORS = (
    "of_block long, of_bundle int, slots array<int>, places array<int>, scores array<long>, best_slots array<int>, best array<long>"
)


def _floors(accumulators: DataFrame) -> DataFrame:
    """bundle, slot, floor: the tenth best score so far of items that have as many."""
    best = accumulators.select("of_bundle", F.explode(F.arrays_zip("best_slots", "best")).alias("b"))
    best = best.select(F.col("of_bundle").alias("bundle"), F.col("b.best_slots").alias("slot"), F.col("b.best").alias("score"))
    place = F.row_number().over(Window.partitionBy("bundle", "slot").orderBy(F.desc("score")))
    tenth = best.withColumn("place", place).filter(F.col("place") <= TOP)
    return tenth.groupBy("bundle", "slot").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == TOP).drop("n")


def rank_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the ten highest-scoring documents of each item.

    `docs` has doc_id and text, `items` item_id and text; other columns are ignored.
    Null and empty texts have no terms: as documents they do not count, as items they
    have no rows. Each row is a document, so repeated rows rank each, next to each
    other; rows of one item_id, a null one too, are one item with the terms of all.
    Equal scores rank by ascending doc_id, a null one last. Empty tables give no rows.
    """
    spark = docs.sparkSession
    bundles = _bundled(items)
    vocabulary = bundles.select(F.explode("terms").alias("term")).distinct()
    blocks = stage(_blocks(docs, vocabulary), "postings")
    own, lists = blocks.filter("term IS NULL"), blocks.filter("term IS NOT NULL")
    documents, total = own.agg(F.sum("held"), F.sum("total")).first()
    kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    if not documents:
        return spark.createDataFrame([], kinds)

    factors = _factor(documents, total)
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + F.lit(1.0))))
    owner = sum((F.col("df") * share > documents).cast("int") for share in OWNERS)
    weights = (
        lists.groupBy("term").agg(F.sum("held").alias("df"), F.max(F.array_max(factors)).alias("best"))
        .withColumn("w", weight).filter("w > 0")
        .select("term", "w", owner.alias("owner"), (F.col("w") * F.col("best")).alias("most"))
    )
    asked = stage(
        bundles.select("bundle", "slot", F.explode("terms").alias("term")).join(weights, "term"), "asked"
    )
    accumulators, floors = None, None
    for number in range(len(OWNERS) + 1):
        last = number == len(OWNERS)
        rest = asked.filter(F.col("owner") >= number).groupBy("bundle", "slot").agg(F.sum("most").alias("rest"))
        limits = bundles.select("bundle", "slot").join(rest, ["bundle", "slot"], "left").na.fill(0, ["rest"])
        if floors is None:
            limits = limits.withColumn("need", F.lit(0).cast("long"))
        else:
            limits = limits.join(floors, ["bundle", "slot"], "left").withColumn("need", F.coalesce("floor", F.lit(0)) - F.col("rest"))
        limits = limits.select("bundle", "slot", "need", (F.col("need") <= 0).alias("open"))
        mine = asked.filter(F.col("owner") == number).select("bundle", "slot", "term", "w").join(limits, ["bundle", "slot"])
        plan = mine.groupBy("bundle", "term", "w").agg(F.collect_list(F.struct("slot", "open")).alias("of"))
        postings = (
            lists.join(broadcast_if_small(plan, PLAN_ROWS), "term")
            .select(
                "block", "bundle", F.col("of.slot").alias("of_slots"), F.col("of.open").alias("of_open"), "places",
                F.transform(factors, lambda x: x * F.col("w")).alias("adds"),
            )
        )
        needs = limits.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("slot", "need"))).alias("n"))
        needs = needs.select(F.col("bundle").alias("b"), F.col("n.need").alias("need"))
        if accumulators is None:
            before = spark.createDataFrame([], ACCUMULATORS).select(
                "of_block", "of_bundle", "slots", "places", "scores", F.array().cast("array<long>").alias("need")
            )
        else:
            before = accumulators.join(broadcast_if_small(needs, PLAN_ROWS), F.col("of_bundle") == F.col("b")).select(
                "of_block", "of_bundle", "slots", "places", "scores", "need"
            )
        grown = before.groupBy("of_block", "of_bundle").cogroup(postings.groupBy("block", "bundle")).applyInArrow(_advance(last), ACCUMULATORS)
        previous, accumulators = accumulators, stage(grown, "accumulators")
        if previous is not None:
            discard(previous)
        floors = stage(_floors(accumulators), "floors")

    scored = accumulators.select("of_block", "of_bundle", F.explode(F.arrays_zip("slots", "places", "scores")).alias("a"))
    reached = (
        scored.select("of_block", F.col("of_bundle").alias("bundle"), F.col("a.slots").alias("slot"), F.col("a.places").alias("place"), F.col("a.scores").alias("score"))
        .join(broadcast_if_small(floors), ["bundle", "slot"], "left")
        .filter("floor IS NULL OR score >= floor")
    )
    named = reached.join(own.select("block", "ids"), F.col("of_block") == F.col("block")).select(
        "bundle", "slot", F.get("ids", F.col("place")).alias("doc_id"), "score"
    )
    place = F.row_number().over(Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = named.withColumn("rank", place).filter(F.col("rank") <= TOP)
    return ranked.join(bundles.select("bundle", "slot", "item_id"), ["bundle", "slot"]).select("item_id", "rank", "doc_id", "score")
