"""Exact Jaccard join of word shingles as a join in a metric space.

Jaccard distance is a metric. Documents are dealt into Voronoi regions, a
document that may have neighbours beyond a border is replicated over it, and
each region is joined recursively around pivots:

1. **Anchors as pivots.** Two unrelated documents are at distance 1, and so is a
   document from any pivot *document* but its own near copies; regions around
   sampled documents would leave nearly all rows in one. So the pivots of the
   first level are all single shingles: a document is nearest to, and equally far
   from, those it holds. Ties go to the pivot that is rarest in the corpus. A
   neighbour within `r` shares at least `ceil((1 - r) n)` of n pivots, so it
   suffices to replicate a document to its `n - ceil((1 - r) n) + 1` rarest.
2. **Documents as pivots.** Each region takes one member as pivot, and all members
   are measured against it, exactly. What is within `r` is linked. By the triangle
   inequality a member within `r` of the pivot can only link to others within
   `2r` of it, so the core is done unless some member lies in that window; then the
   core's outer ring (those within `r` of the nearest member of the window) is kept.
3. A region whose members are connected already is done. The others are joined
   again around further pivots, on arrays within tasks: members of the rarest
   components first, against all that are not connected to them. Regions of more
   than `in_task` members are cut into pairs of blocks for that.
4. Before a distance is measured on whole sets, it is bounded from below by the
   sizes and by counts of shingles in 128 classes (their L1 distance never exceeds
   the symmetric difference). Only sets that may link are fetched.

Texts with equal sets share one id, a hash of the set, so groups of copies are
one member. Only links to pivots become rows, never all pairs of a group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlpit.llm import tokens
from marlpit.operators.key_filter import key_filter
from marlpit.runtime import discard, free_shuffles, stage

# Counters of the shingle statistics: fixed size, whatever the corpus.
COUNTERS = 1 << 18
COUNTER_BLOCK = 1 << 12
IN_TASK = 4096
# Shingles of a set counted by so many classes; a byte each.
CLASSES = 128
FINE_CLASSES = 1024  # made within a task, where members are at hand
# Whole sets are sent in rounds, each of about one such part of all shingles, and no more rounds than these.
PARTS = 1
MOST_ROUNDS = 16


def _held(df: DataFrame, label: str) -> DataFrame:
    """A staged table; what was shuffled for it leaves the disks."""
    staged = stage(df, label)
    free_shuffles(df.sparkSession)
    return staged


def _hashed(texts: tokens.Texts, words: int):
    found = tokens.words(texts)
    return tokens.shingles(tokens.word_hashes(tokens.LOWER[texts.data], found), found, words)


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """Occurrences of shingles in the whole corpus, by counter.

    Every task sums its own counters; blocks of counters are summed by block
    and only the fixed number of totals reaches the driver.
    """

    def count(batches):
        totals = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for texts in tokens.slices(batch.column(0)):
                run, _ = _hashed(texts, words)
                totals += np.bincount((run >> np.uint64(46)).astype(np.int64), minlength=COUNTERS)
        blocks = totals.reshape(-1, COUNTER_BLOCK)
        yield pa.RecordBatch.from_pydict(
            {"block": np.arange(len(blocks), dtype=np.int32), "totals": [b.tobytes() for b in blocks]}
        )

    def add(key, rows):
        total = np.zeros(COUNTER_BLOCK, np.int64)
        for value in rows.column("totals"):
            total += np.frombuffer(value.as_py(), np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "totals": [total.tobytes()]})

    schema = "block int, totals binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect()
    totals = np.zeros(COUNTERS, np.int64)
    for block, value in rows:
        totals[block * COUNTER_BLOCK : (block + 1) * COUNTER_BLOCK] = np.frombuffer(value, np.int64)
    return totals


def _sets(texts: tokens.Texts, words: int):
    """Sorted distinct shingles of each text."""
    run, text = _hashed(texts, words)
    bounds = np.searchsorted(text, np.arange(texts.count + 1))
    for i in range(texts.count):
        yield np.unique(run[bounds[i] : bounds[i + 1]])


def _set_id(values: np.ndarray) -> int:
    place = tokens.mix(np.arange(1, len(values) + 1, dtype=np.uint64)) | np.uint64(1)
    total = (tokens.mix(values) * place).sum(dtype=np.uint64)
    return int(tokens.mix(np.array([total], np.uint64)).view(np.int64)[0])


def _classes(values: np.ndarray, classes: int) -> np.ndarray:
    """Shingles by class, at most 255 of each being told."""
    by_class = np.bincount((values & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return np.minimum(by_class, 255).astype(np.uint8)


def document_sets(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, n_shingles, set_id (null without words), its anchors and class counts."""
    rarity = docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint64))

    def build(batches):
        for batch in batches:
            ids = batch.column(0)
            for texts in tokens.slices(batch.column(1)):
                sizes, names, anchors, sketches = [], [], [], []
                for values in _sets(texts, words):
                    n = len(values)
                    sizes.append(n)
                    if not n:
                        names.append(None)
                        sketches.append(None)
                        anchors.append(np.zeros(0, np.int64))
                        continue
                    names.append(_set_id(values))
                    sketches.append(_classes(values, CLASSES).tobytes())
                    frequency = rarity.value[(values >> np.uint64(46)).astype(np.int64)]
                    order = np.argsort(frequency, kind="stable")
                    keep = n - (percent * n + 99) // 100 + 1
                    anchors.append(tokens.signed(values[order[:keep]]))
                lengths = np.array([len(a) for a in anchors])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(texts.first, texts.count),
                        pa.array(sizes, pa.int64()),
                        pa.array(names, pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()),
                            pa.array(np.concatenate(anchors) if anchors else np.zeros(0, np.int64)),
                        ),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "anchors", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        build, "doc_id long, n_shingles long, set_id long, anchors array<long>, sketch binary"
    )


def _shingles_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """set_id and shingles of the sets whose example rows `wanted` (doc_id, set_id) names, staged.

    Texts stay where they are: a Bloom filter of the ids tells which to cut, and what
    it lets through besides is told by its set.
    """

    def build(batches):
        for batch in batches:
            for texts in tokens.slices(batch.column(0)):
                names, values = [], []
                for found in _sets(texts, words):
                    if len(found):
                        names.append(_set_id(found))
                        values.append(tokens.signed(found))
                yield pa.RecordBatch.from_pydict(
                    {"set_id": pa.array(names, pa.int64()), "shingles": pa.array(values, pa.list_(pa.int64()))}
                )

    wanted = stage(wanted.select("doc_id", "set_id").distinct(), "wanted")
    may_be = key_filter(wanted.select("doc_id"), ["doc_id"], wanted.count())
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Sets that only rows without an id hold are told by their own hash below.
    sets = given.filter(may_be | F.col("doc_id").isNull()).select("text").mapInArrow(build, "set_id long, shingles array<long>")
    fetched = _held(sets.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]), "fetched")
    discard(wanted)
    return fetched


def measure(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with their exact distance and whether they link."""
    both = (
        pairs.select("a", "b")
        .join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"),
                F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))
    )
    union = F.col("na") + F.col("nb") - F.col("common")
    return both.select(
        "a", "b", (100 * F.col("common") >= percent * union).alias("linked"),
        (1 - F.col("common") / union).alias("distance"),
    )


def least_distances(na, nb, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances of sets from their sizes and class counts."""
    apart = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=-1, dtype=np.int64)
    apart = np.maximum(apart, np.abs(na - nb))
    return 1 - (na + nb - apart) / (na + nb + apart)


def _counts_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CLASSES)


def bounded(pairs: DataFrame, examples: DataFrame, most: float) -> DataFrame:
    """Pairs (a, b) with a lower bound of their distance; none whose sizes put them beyond `most`."""

    def bound(batches):
        for batch in batches:
            low = least_distances(
                batch.column("na").to_numpy(), batch.column("nb").to_numpy(),
                _counts_of(batch.column("ka")), _counts_of(batch.column("kb")),
            )
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(low)], names=["a", "b", "least"])

    sizes = lambda name: examples.select(F.col("set_id").alias(name), F.col("n").alias(f"n{name}"))
    counts = lambda name: examples.select(F.col("set_id").alias(name), F.col("sketch").alias(f"k{name}"))
    near = pairs.join(sizes("a"), "a").join(sizes("b"), "b").filter(
        1 - F.least("na", "nb") / F.greatest("na", "nb") <= most + 1e-9)
    return near.join(counts("a"), "a").join(counts("b"), "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(
        bound, "a long, b long, least double"
    )


def region_links(
    names: np.ndarray, members: list[np.ndarray], percent: int, labels: np.ndarray | None = None, counts: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links that connect whatever links within one region, by recursion on pivots.

    Members of one label are connected already; those of rare labels come first
    as pivots, so that a large connected part is never measured within itself.
    With class `counts`, members that these put beyond the radius are not measured.
    """
    lengths = np.array([len(m) for m in members])
    radius = 1 - percent / 100
    labels = names if labels is None else labels
    _, component, size = np.unique(labels, return_inverse=True, return_counts=True)
    fine = np.stack([_classes(m, FINE_CLASSES) for m in members]) if len(members) else None
    links, todo = [], [np.argsort(size[component], kind="stable")]
    while todo:
        region = todo.pop()
        if len(region) < 2:
            continue
        pivot, rest = region[0], region[1:]
        near = rest[component[rest] != component[pivot]]
        if len(near) and counts is not None:
            near = near[least_distances(lengths[pivot], lengths[near], counts[pivot], counts[near]) <= radius + 1e-9]
        if len(near):
            near = near[least_distances(lengths[pivot], lengths[near], fine[pivot], fine[near]) <= radius + 1e-9]
        if len(near):
            joined = np.concatenate([members[i] for i in near])
            own = members[pivot]
            at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
            common = np.add.reduceat((own[at] == joined).astype(np.int64), np.cumsum(lengths[near]) - lengths[near])
            for i in near[100 * common >= percent * (lengths[near] + len(own) - common)]:
                if component[i] != component[pivot]:
                    links.append((int(names[pivot]), int(names[i])))
                    component[component == component[i]] = component[pivot]
        # The pivot has been measured against all that was not connected to it and is done.
        if (component[rest] != component[rest[0]]).any():
            todo.append(rest)
    return links


def _finish(rows: DataFrame, docs: DataFrame, examples: DataFrame, whole: DataFrame, words: int, percent: int, in_task: int) -> DataFrame:
    """Links between different labels within regions (region, set_id, label), staged."""
    radius = 1 - percent / 100

    def prune(table):
        n, label = table.column("n").to_numpy(), table.column("label").to_numpy()
        counts = _counts_of(table.column("sketch"))
        near = np.zeros(len(n), bool)
        _, group, size = np.unique(label, return_inverse=True, return_counts=True)
        for i in np.flatnonzero(group != size.argmax()):
            other = label != label[i]
            other[other] = least_distances(n[i], n[other], counts[i], counts[other]) <= radius + 1e-9
            near |= other
            near[i] |= other.any()
        # A region is known by its members, so that many equal ones are solved once.
        kept = table.filter(pa.array(near)).sort_by("set_id")
        name = _set_id(kept.column("set_id").to_numpy().view(np.uint64)) if len(kept) else 0
        return pa.table(
            {"region": pa.array([name] * len(kept), pa.int64()), "set_id": kept.column("set_id"), "label": kept.column("label")}
        )

    def solve(table):
        table = table.sort_by("set_id").combine_chunks()
        members = [np.asarray(value.values).view(np.uint64) for value in table.column("shingles")]
        found = region_links(table.column("set_id").to_numpy(), members, percent, table.column("label").to_numpy(),
                             _counts_of(table.column("sketch")) if len(table) else None)
        return pa.table(
            {"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())}
        )

    blocks = rows.groupBy("region").agg(F.ceil(F.count("*") / in_task).alias("blocks"))
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    dealt = (
        rows.join(blocks, "region")
        .select("region", "set_id", "label", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select("region", "set_id", "label", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    )
    kept = _held(
        dealt.join(examples.select("set_id", "n", "sketch"), "set_id").groupBy("region", "one", "two")
        .applyInArrow(prune, "region long, set_id long, label long").distinct(), "regions",
    )
    # Regions that share members are solved together, so that each set is sent once,
    # unless they are too many for one task.
    stars = kept.join(kept.groupBy("region").agg(F.min("set_id").alias("least")), "region")
    clusters = connect(stars.select(F.col("least").alias("a"), F.col("set_id").alias("b"))).select(
        "set_id", F.col("label").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("sets"))
    told = kept.join(clusters, "set_id").join(sizes, "cluster")
    group = F.when(F.col("sets") <= 2 * in_task, F.col("cluster")).otherwise(F.col("region"))
    grouped = _held(told.select(group.alias("region"), "set_id", "label").distinct(), "clusters")
    discard(kept)
    links = None
    sent = grouped.join(examples.select("set_id", "n"), "set_id")
    for part in _in_rounds(grouped, "region", _rounds(sent, whole)):
        wanted = examples.join(part.select("set_id"), "set_id", "left_semi")
        fetched = _shingles_of(docs, wanted, words)
        sets = fetched.join(examples.select("set_id", "sketch"), "set_id")
        solved = _held(part.join(sets, "set_id").groupBy("region").applyInArrow(solve, "a long, b long").distinct(), "links")
        discard(fetched)
        links = solved if links is None else links.union(solved)
    discard(grouped)
    return links


def connect(links: DataFrame) -> DataFrame:
    """(set_id, label): the smallest id that each linked set reaches.

    Labels pass along links and then jump to the label of their label, so the
    number of rounds grows with the logarithm of the longest chain.
    """
    edges = stage(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = held = stage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "set_id"), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.set_id).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("set_id") == F.col("a")).select("set_id", F.least("label", "near").alias("next"), "label")
        target = labels.select(F.col("set_id").alias("next"), F.col("label").alias("jump"))
        after = stage(
            lower.join(target, "next").select(
                "set_id", F.least("next", "jump").alias("label"), (F.least("next", "jump") < F.col("label")).alias("moved")
            ),
            "labels",
        )
        discard(held)
        if after.filter("moved").isEmpty():
            discard(edges)
            return after.select("set_id", "label")
        labels, held = after.select("set_id", "label"), after


def may_link(region: np.ndarray, place: np.ndarray, names: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Regions and names, once each, of the sets that some other set of a region may link with.

    Rows are sorted by region; `place` says how many shingles of the set come before the
    region's in the common order. In the region of the first shingle that two sets share,
    they share no more than either has from there on, so sets of n and m shingles
    that link have at least percent / (100 + percent) (n + m) left.
    """
    with_next = region[1:] == region[:-1]
    some = np.concatenate([with_next, [False]]) | np.concatenate([[False], with_next])
    region, place, names, n = (x[some] for x in (region, place, names, n))
    order = np.lexsort((names, n, region))
    region, place, names, n = (x[order] for x in (region, place, names, n))
    first = np.ones(len(region), bool)
    first[1:] = (region[1:] != region[:-1]) | (names[1:] != names[:-1])
    region, place, names, n = (x[first] for x in (region, place, names, n))
    if not len(region):
        return region, names
    # x and y may link if need(y) <= has(x) and need(x) <= has(y).
    need, has = percent * n, 100 * n - (100 + percent) * place
    wide = max(need.max(), has.max()) + 1
    base = np.concatenate([[0], np.cumsum(region[1:] != region[:-1])]) * wide
    upto = np.searchsorted(base + need, base + has, side="right") - 1
    # The most that any set, and any other set, of the region so far has.
    most = np.maximum.accumulate(base + has)
    second = np.maximum.accumulate(np.minimum(base + has, np.concatenate([[-1], most[:-1]])))
    own = (need <= has) & (most[upto] == base + has)
    met = (upto >= 0) & (np.where(own, second[upto], most[upto]) >= base + need)
    return region[met], names[met]


def shared_regions(sets: DataFrame, percent: int) -> DataFrame:
    """region and set_id of the sets that share a region with one they may link with.

    Nearly all anchors are of one set; they are dealt once, and no more of them is kept.
    """

    def meet(batches):
        waiting: list[tuple] = []

        def settled():
            found = may_link(*(np.concatenate(x) for x in zip(*waiting)), percent)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["region", "set_id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "place", "set_id", "n"))
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # a region may go on in the next batch
            if last or (waiting and waiting[-1][0][-1] != rows[0][0]):
                waiting.append(tuple(x[:last] for x in rows))
                yield settled()
                waiting = []
            waiting.append(tuple(x[last:] for x in rows))
        if waiting:
            yield settled()

    # Columns in this order are packed best: the last two stay the same from row to row.
    dealt = sets.filter("n_shingles > 0").select(
        F.posexplode("anchors").alias("place", "region"), "set_id", F.col("n_shingles").alias("n")
    ).select("region", "place", "set_id", "n").repartition("region").sortWithinPartitions("region")
    return dealt.mapInArrow(meet, "region long, set_id long")


def _rounds(volume: DataFrame, whole: DataFrame) -> int:
    """In how many rounds sets are sent, so that no more than a part of all shingles is on its way at once."""
    sent, held = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (volume, whole))
    return max(1, min(MOST_ROUNDS, -(-sent // max(1, held // PARTS))))


def _in_rounds(df: DataFrame, key: str, rounds: int) -> list[DataFrame]:
    turn = F.pmod(F.xxhash64(F.lit("round"), key), F.lit(rounds))
    return [df.filter(turn == k) for k in range(rounds)] if rounds > 1 else [df]


def jaccard_links(docs: DataFrame, sets: DataFrame, words: int, percent: int, in_task: int = IN_TASK) -> DataFrame | None:
    """Links between set ids that connect all sets within the distance; None without any.

    A staged `sets` is discarded once its anchors and counts are read.
    """
    radius = 1 - percent / 100
    rows = _held(shared_regions(sets, percent), "regions")
    every = sets.filter("n_shingles > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    examples = _held(every.join(rows.select("set_id").distinct(), "set_id", "left_semi"), "examples")
    whole = _held(sets.agg(F.sum("n_shingles").alias("n")), "shingles")
    discard(sets)
    found: list[DataFrame] = []
    pivots = rows.groupBy("region").agg(F.min("set_id").alias("pivot"))
    stars = _held(rows.join(pivots, "region").filter("set_id <> pivot"), "stars")
    discard(rows)
    pairs = stars.select(F.col("pivot").alias("a"), F.col("set_id").alias("b")).distinct()
    # What lies beyond twice the radius is neither linked nor in the window.
    low = _held(bounded(pairs, examples, 2 * radius).filter(F.col("least") <= 2 * radius + 1e-9), "bounds")
    maybe = low.filter(F.col("least") <= radius + 1e-9)
    sizes = examples.select("set_id", "n")
    sent = maybe.select(F.explode(F.array("a", "b")).alias("set_id")).join(sizes, "set_id")
    exact = None
    for part in _in_rounds(maybe, "b", _rounds(sent, whole)):
        ends = part.select(F.col("a").alias("set_id")).union(part.select("b"))
        fetched = _shingles_of(docs, examples.join(ends, "set_id", "left_semi"), words)
        measured = _held(measure(part, fetched, percent), "measured")
        discard(fetched)
        exact = measured if exact is None else exact.union(measured)
    links = exact.filter("linked").select("a", "b")
    if not links.isEmpty():
        found.append(links)
    measured = low.join(exact, ["a", "b"], "left").select(
        "a", "b", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("distance", "least").alias("distance"))
    rows = _unsettled(stars, measured, found, radius)
    discard(stars, low)
    if rows is not None:
        rest = _finish(rows, docs, examples, whole, words, percent, in_task)
        discard(rows)
        if not rest.isEmpty():
            found.append(rest)
    discard(examples, whole)
    return reduce(DataFrame.union, found) if found else None


def _unsettled(stars: DataFrame, measured: DataFrame, found: list[DataFrame], radius: float) -> DataFrame | None:
    """What is left of the regions after one pivot each, with labels; None if nothing is."""
    told = stars.join(measured, (F.col("pivot") == F.col("a")) & (F.col("set_id") == F.col("b")), "left").select(
        "region", "set_id", F.coalesce("linked", F.lit(False)).alias("linked"),
        F.coalesce("distance", F.lit(1.0)).alias("distance"),
    )
    told = _held(told, "told")
    window = told.filter("not linked").groupBy("region").agg(F.min("distance").alias("nearest"))
    left = told.join(window, "region").filter(
        ~F.col("linked") | (F.col("distance") + radius >= F.col("nearest") - 1e-9)
    ).select("region", "set_id")
    if found:
        labels = connect(reduce(DataFrame.union, found))
        named = left.join(labels, "set_id", "left").select("region", "set_id", F.coalesce("label", "set_id").alias("label"))
    else:
        named = left.withColumn("label", F.col("set_id"))
    named = _held(named, "named")
    discard(told)
    open_ = named.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    rows = _held(named.join(open_.select("region"), "region").select("region", "set_id", "label"), "regions")
    discard(named)
    if rows.isEmpty():
        discard(rows)
        return None
    return rows


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, in_task: int = IN_TASK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text).

    A-Z are lower-cased; a set holds the distinct runs of `words` words, or the
    whole sequence of a shorter text. Rows link where 100 |A and B| >= percent
    |A or B|; component_id is the smallest doc_id that links reach. Rows with null,
    empty or blank text have no shingles and link with nothing. Repeated rows
    and rows of one doc_id each give a row. A null doc_id never names a component
    that has another. Other columns are ignored; an empty table gives no rows.
    """
    anchored = stage(document_sets(docs, shingle_counts(docs, words), words, percent), "anchored-sets")
    sets = stage(anchored.select("doc_id", "n_shingles", "set_id"), "document-sets")
    links = jaccard_links(docs, anchored, words, percent, in_task)
    classes = sets.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    if links is not None:
        labels = connect(links)
        named = classes.join(labels, "set_id").select("set_id", "label", "first")
        smallest = named.groupBy("label").agg(F.min("first").alias("least"))
        linked = named.join(smallest, "label").select("set_id", "least")
        classes = classes.join(linked, "set_id", "left").select("set_id", F.coalesce("least", "first").alias("first"))
    return sets.join(classes, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id")
    )
