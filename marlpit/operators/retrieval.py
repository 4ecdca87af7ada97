"""Exact cosine retrieval for tables of questions.

Questions travel to the chunks: slices of question vectors are broadcast, every task
multiplies its Arrow batches of chunk vectors by each slice and keeps the best
`fetch_k` per question. What leaves a task is at most `fetch_k` rows per question,
whatever the size of its input; pairs are never rows. All slices of a scan share one
read of the chunks; where there are several, a sample of the chunks is scored first, and
the lowest of a question's best there is its floor, below which no task hands on a row.
Scores are shuffled with keys only; vectors are fetched for the final candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from marlpit.functions.vectors import SCORE_DECIMALS
from marlpit.runtime import broadcast_if_small, discard, spread, stage

# Candidates, results and the weight of relevance in re-ranking.
FETCH_K = 20
TOP_K = 4
RELEVANCE_WEIGHT = 0.1

# Bounds of a slice and of a scan: questions, and cells of the broadcast question vectors.
# A task holds the best of all questions of a scan.
QUESTIONS_PER_SLICE = 2048
SLICE_CELLS = 2 << 20
QUESTIONS_PER_SCAN = 64 << 10
SCAN_CELLS = 16 << 20
# Chunks that are sampled and scored first for the floors, cells of their vectors, and
# their share of all: a task hands on about `fetch_k` rows per question for as many chunks.
FLOOR_CHUNKS = 64 << 10
FLOOR_CELLS = 4 << 20
FLOOR_SHARE = 4
# Sources up to which the questions' own limits become a filter of the scan.
SCOPE_SOURCES = 1024
# Cells of one block of scores inside a task (32 MB of doubles), and rows of a batch made ready at once.
SCORE_CELLS = 4 << 20
BLOCK_ROWS = 1 << 14

KEY = ["source_id", "path", "chunk_index"]


def scope_chunks(
    chunks: DataFrame, embed_model: str, source_ids: list[str] | DataFrame | None = None
) -> DataFrame:
    """Chunks of one model and some sources; null means all, an empty list none."""
    rows = chunks.where(F.col("embed_model") == embed_model)
    if source_ids is None:
        return rows
    if isinstance(source_ids, DataFrame):
        return rows.join(source_ids.select("source_id"), "source_id", "left_semi")
    if not source_ids:
        return rows.where(F.lit(False))
    return rows.where(F.col("source_id").isin(*source_ids))


def top_chunks(
    queries: DataFrame, chunks: DataFrame, fetch_k: int = FETCH_K, per_slice: int | None = None
) -> DataFrame:
    """The `fetch_k` best chunks per question, ranked by score, then by key.

    `queries`: query_id, embedding and, where questions are limited to some
    sources, source_ids (null: all, empty: none). Rows: query_id, candidate
    (1 is best), score and the chunk's key. `per_slice` bounds the questions
    that are multiplied at once.
    """
    size = queries.agg(
        F.count("*").alias("questions"), F.max(F.size("embedding")).alias("width")
    ).first()
    total, width = size["questions"], max(1, size["width"] or 1)
    per_slice = max(1, min(per_slice or QUESTIONS_PER_SLICE, SLICE_CELLS // width))
    per_scan = max(per_slice, min(QUESTIONS_PER_SCAN, SCAN_CELLS // width))
    few = _few(chunks, min(FLOOR_CHUNKS, FLOOR_CELLS // width), fetch_k) if total > per_slice else None
    answers = _scans(queries, chunks, few, fetch_k, total, per_slice, per_scan)
    if few is not None:
        discard(few)
    return answers


def _scans(
    queries: DataFrame, chunks: DataFrame, few: DataFrame | None, fetch_k: int, total: int, per_slice: int, per_scan: int
) -> DataFrame:
    if total <= per_scan:
        return _one_scan(queries, chunks, few, fetch_k, per_slice)
    # What a scan asks is collected, answered and stored before the next one, so the
    # driver never holds more than one. The cut is by rank, hence exact.
    cut = _numbered(queries)
    answers = None
    for number in range(-(-total // per_scan)):
        rows = cut.where(
            F.col("_number").between(number * per_scan, (number + 1) * per_scan - 1)
        ).drop("_number")
        answer = stage(_one_scan(rows, chunks, few, fetch_k, per_slice), "top-chunks")
        answers = answer if answers is None else answers.unionByName(answer)
    return answers


def _numbered(queries: DataFrame) -> DataFrame:
    """Questions numbered from 0 without gaps, each partition on its own."""
    rows = stage(queries.withColumn("_row", F.monotonically_increasing_id()), "questions")
    partition = F.shiftright("_row", 33)
    counts = rows.groupBy(partition.alias("_partition")).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_partition").rowsBetween(W.unboundedPreceding, -1)
    # As many rows as the question table had partitions.
    offsets = counts.select(
        "_partition", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    within = F.col("_row").bitwiseAND((1 << 33) - 1)
    return (
        rows.withColumn("_partition", partition)
        .join(F.broadcast(offsets), "_partition")
        .withColumn("_number", F.col("_offset") + within)
        .drop("_partition", "_offset", "_row")
    )


class _Slice(NamedTuple):
    """Some of a scan's questions: vectors, sources each is limited to, and floors."""

    vectors: np.ndarray
    scopes: list
    floors: np.ndarray


def _slices(asked: pa.Table, per_slice: int) -> list[_Slice]:
    column = asked["embedding"].combine_chunks()
    widths = set(pc.list_value_length(column).to_pylist())
    if len(widths) > 1:
        raise ValueError(f"question vectors differ in size: {sorted(widths, key=str)}")
    matrix = _matrix(asked["embedding"], widths.pop() if widths else 0)
    matrix = matrix.reshape(asked.num_rows, -1) if asked.num_rows else matrix.reshape(0, 0)
    if "source_ids" in asked.column_names:
        scopes = asked["source_ids"].to_pylist()
    else:
        scopes = [None] * asked.num_rows
    return [
        _Slice(matrix[at : at + per_slice], scopes[at : at + per_slice], np.full(len(matrix[at : at + per_slice]), -np.inf))
        for at in range(0, max(1, asked.num_rows), per_slice)
    ]


def _vectors(chunks: DataFrame) -> DataFrame:
    """Keys and vectors as tasks expect them."""
    kinds = dict(zip(KEY, ("string", "string", "int")))
    return chunks.select(
        *[F.col(name).cast(kind).alias(name) for name, kind in kinds.items()],
        F.col("embedding").cast("array<float>").alias("embedding"),
    )


def _few(chunks: DataFrame, most: int, fetch_k: int) -> DataFrame | None:
    """A staged sample of all parts of the chunks, or none where it could give no floor."""
    rows = chunks.count()
    wanted = min(most, rows // FLOOR_SHARE)
    if fetch_k <= 0 or wanted < fetch_k:
        return None
    return stage(_vectors(chunks).sample(wanted / rows, seed=1), "floor-chunks")


def _one_scan(
    queries: DataFrame, chunks: DataFrame, few: DataFrame | None, fetch_k: int, per_slice: int
) -> DataFrame:
    spark = chunks.sparkSession
    scoped = ["source_ids"] if "source_ids" in queries.columns else []
    given = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), *scoped)
    asked = given.toArrow()
    schema = (
        T.StructType()
        .add("query_id", queries.schema["query_id"].dataType)
        .add("score", T.DoubleType())
        .add("source_id", T.StringType())
        .add("path", T.StringType())
        .add("chunk_index", T.IntegerType())
    )
    ids = asked["query_id"].combine_chunks().cast(to_arrow_type(queries.schema["query_id"].dataType))
    slices = _slices(asked, per_slice)
    scopes = [scope for part in slices for scope in part.scopes]
    if all(scope is not None for scope in scopes):
        wanted = sorted({source for scope in scopes for source in scope})
        if len(wanted) <= SCOPE_SOURCES:
            chunks = chunks.where(F.col("source_id").isin(*wanted) if wanted else F.lit(False))
    vectors = _vectors(chunks)
    if few is not None:
        slices = _with_floors(slices, ids, few, schema, fetch_k)
    if len(slices) > 1:
        vectors = spread(vectors)
    order = [F.desc("score"), *KEY]
    found = vectors.mapInArrow(_best(spark, slices, ids, fetch_k), schema)
    # Where questions are too few to occupy the tasks of a shuffle, those of a large scan are
    # first combined in groups, so that no task receives the rows of all others for a question.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = partitions // 8
    if groups > 1 and len(ids) < partitions:
        found = found.withColumn("_group", F.spark_partition_id() % groups)
        found = _ranked(found, ["query_id", "_group"], order, fetch_k).drop("_group", "candidate")
    return _ranked(found, ["query_id"], order, fetch_k)


def _best(spark, slices: list[_Slice], ids: pa.Array, fetch_k: int):
    shared = spark.sparkContext.broadcast(([tuple(part) for part in slices], ids))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids = shared.value
        hits = [_BestHits(vectors, limits, floors, fetch_k) for vectors, limits, floors in parts]
        for batch in batches:
            for rows in _chunk_blocks(batch):
                for part in hits:
                    part.add(rows)
        at = 0
        for part in hits:
            yield from part.rows(ids.slice(at, len(part.units)))
            at += len(part.units)

    return best


def _with_floors(
    slices: list[_Slice], ids: pa.Array, vectors: DataFrame, schema: T.StructType, fetch_k: int
) -> list[_Slice]:
    """Slices with the score of each question's last candidate among a few chunks.

    At least `fetch_k` chunks score as much, so a lower one is no candidate; questions
    that find fewer there have no floor. The chunks travel here, and each task has some
    of the slices, so that no rows are ranked.
    """
    spark = vectors.sparkSession
    floor = T.StructType([T.StructField("query_id", T.LongType()), schema["score"]])
    shared = spark.sparkContext.broadcast(
        ([tuple(part) for part in slices], vectors.select("source_id", "embedding").toArrow())
    )
    starts = np.cumsum([0, *(len(part.vectors) for part in slices)])

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, few = shared.value
        chunks = [rows for batch in few.combine_chunks().to_batches() for rows in _chunk_blocks(batch)]
        for batch in batches:
            for number in batch["id"].to_pylist():
                own = np.arange(starts[number], starts[number + 1])
                scores = _BestHits(*parts[number], fetch_k).lowest(chunks)
                yield pa.record_batch({"query_id": pa.array(own), "score": pa.array(scores)})

    tasks = min(len(slices), 4 * spark.sparkContext.defaultParallelism)
    found = spark.range(0, len(slices), 1, tasks).mapInArrow(lowest, floor).toArrow()
    shared.unpersist()
    floors = np.full(len(ids), -np.inf)
    floors[found["query_id"].to_numpy()] = found["score"].to_numpy()
    return [part._replace(floors=own) for part, own in zip(slices, np.split(floors, starts[1:-1]))]


def with_vectors(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with the vectors of their chunks, whose keys are unique.

    Candidates are staged and, up to the broadcast bound, sent to the chunks, so
    that no vector is shuffled before it is known to be one of the best. Beyond
    it the join is by key, where Catalyst's runtime Bloom filter may thin the chunks.
    """
    best = stage(candidates, "candidates")
    vectors = chunks.select(*KEY, F.col("embedding").cast("array<float>").alias("embedding"))
    return vectors.join(broadcast_if_small(best), KEY).select(*best.columns, "embedding")


def _ranked(rows: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    number = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("candidate", number).where(F.col("candidate") <= limit)


class _Chunks:
    """Rows of one batch, made ready once for all slices of questions."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.sizes = pc.list_value_length(rows["embedding"]).to_numpy()
        self._units: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        self._sources: tuple[list, np.ndarray] | None = None

    def of_width(self, width: int) -> tuple[np.ndarray | None, np.ndarray]:
        """Places of the rows whose vectors have that size, none if all have, and the vectors at length 1."""
        if width not in self._units:
            fits = self.sizes == width
            at = None if fits.all() else np.flatnonzero(fits)
            column = self.rows["embedding"] if at is None else self.rows["embedding"].take(pa.array(at))
            vectors = _matrix(column, width)
            lengths = np.linalg.norm(vectors, axis=1)
            vectors /= np.where(lengths > 0, lengths, 1.0)[:, None]
            self._units[width] = at, vectors
        return self._units[width]

    def sources(self) -> tuple[list, np.ndarray]:
        """The source ids, and of each row the place of its own."""
        if self._sources is None:
            sources = self.rows["source_id"].combine_chunks().dictionary_encode(null_encoding="encode")
            if isinstance(sources, pa.ChunkedArray):
                sources = sources.combine_chunks()
            self._sources = sources.dictionary.to_pylist(), sources.indices.to_numpy(zero_copy_only=False)
        return self._sources


def _chunk_blocks(batch: pa.RecordBatch) -> Iterator[_Chunks]:
    for start in range(0, batch.num_rows, BLOCK_ROWS):
        yield _Chunks(pa.Table.from_batches([batch.slice(start, BLOCK_ROWS)]))


class _BestHits:
    """The best `k` rows per question seen so far by one task."""

    def __init__(self, vectors: np.ndarray, scopes: list, floors: np.ndarray, k: int):
        lengths = np.linalg.norm(vectors, axis=1)
        self.units = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.scoped = any(s is not None for s in scopes)
        # Questions that ask all sources, and those that ask each.
        self.unlimited = np.array([i for i, s in enumerate(scopes) if s is None], np.int64)
        askers: dict[str, list[int]] = {}
        for question, scope in enumerate(scopes):
            for name in set(scope or ()):
                askers.setdefault(name, []).append(question)
        self.askers = {name: np.array(questions, np.int64) for name, questions in askers.items()}
        self.k = k
        self.least = floors
        self.floor = floors
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.row = np.empty(0, dtype=np.int64)
        self.table: pa.Table | None = None

    def add(self, chunks: _Chunks) -> None:
        found, held = [], 0
        for asked, met in self._meetings(chunks):
            self._check(chunks, met)
            if self.k <= 0 or len(self.units) == 0:
                continue
            for pairs in self._scored(chunks, asked, met):
                found.append(pairs)
                held += len(pairs[0])
                if held >= SCORE_CELLS // 16:
                    self._take(chunks, found)
                    found, held = [], 0
        if found:
            self._take(chunks, found)

    def lowest(self, blocks: list[_Chunks]) -> np.ndarray:
        """The score of each question's `k`-th best row in these blocks alone, -inf where it meets fewer."""
        best = np.full((len(self.units), self.k), -np.inf)
        for chunks in blocks:
            for asked, met in self._meetings(chunks):
                self._check(chunks, met)
                vectors = self._met(chunks, met)
                own = slice(None) if asked is None else asked
                units = self.units[own]
                step = max(256, SCORE_CELLS // 4 // max(1, len(units)))
                for start in range(0, len(vectors), step):
                    scores = np.concatenate([best[own], units @ vectors[start : start + step].T], axis=1)
                    scores[np.isnan(scores)] = -np.inf  # no hit
                    best[own] = np.partition(scores, -self.k, axis=1)[:, -self.k :]
        return np.round(best.min(axis=1), SCORE_DECIMALS) + 0.0  # -0.0 becomes 0.0

    def _take(self, chunks: _Chunks, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        query, column, scores = (np.concatenate(parts) for parts in zip(*found))
        used, position = np.unique(column, return_inverse=True)
        held = 0 if self.table is None else self.table.num_rows
        fresh = chunks.rows.select(KEY).take(pa.array(used))
        self.table = fresh if held == 0 else pa.concat_tables([self.table, fresh])
        self.query = np.concatenate([self.query, query])
        self.score = np.concatenate([self.score, scores])
        self.row = np.concatenate([self.row, position + held])
        self._trim()

    def _meetings(self, chunks: _Chunks) -> Iterator[tuple[np.ndarray | None, np.ndarray | None]]:
        """Questions, and rows of the sources that they all ask; none means all.

        Sources that the same questions ask go together, so each pair is met once, and
        no pair is scored that a question's limits exclude.
        """
        if not self.scoped:
            yield None, None
            return
        names, of_row = chunks.sources()
        asks = np.zeros((len(names), len(self.units)), bool)
        asks[:, self.unlimited] = True
        for i, name in enumerate(names):
            if name in self.askers:
                asks[i, self.askers[name]] = True
        alike: dict[bytes, list[int]] = {}
        for i, askers in enumerate(np.packbits(asks, axis=1)):
            alike.setdefault(askers.tobytes(), []).append(i)
        if len(alike) == 1 and asks.all():
            yield None, None
            return
        group = np.empty(len(names), np.int64)
        for number, members in enumerate(alike.values()):
            group[members] = number
        group = group[of_row]
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(len(alike) + 1))
        for number, members in enumerate(alike.values()):
            asked = np.flatnonzero(asks[members[0]])
            if len(asked):
                yield asked, order[ends[number] : ends[number + 1]]

    def _check(self, chunks: _Chunks, met: np.ndarray | None) -> None:
        """Refuse vectors of another size where a question would meet them."""
        width = self.units.shape[1]
        if not len(self.units):
            return
        sizes = chunks.sizes if met is None else chunks.sizes[met]
        odd = sizes != width
        if odd.any():
            raise ValueError(
                f"questions have {width} dimensions, the index has {sizes[odd][0]}: "
                "the model asked with is not the one that wrote these vectors"
            )

    def _met(self, chunks: _Chunks, met: np.ndarray | None) -> np.ndarray:
        """The vectors of rows that were checked, at length 1."""
        at, vectors = chunks.of_width(self.units.shape[1])
        # Rows of another size are met by no question, as was checked.
        return vectors if met is None else vectors[met if at is None else np.searchsorted(at, met)]

    def _scored(
        self, chunks: _Chunks, asked: np.ndarray | None, met: np.ndarray | None
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Question, row and score of the pairs that may be among the best."""
        vectors = self._met(chunks, met)
        units, floor = (self.units, self.floor) if asked is None else (self.units[asked], self.floor[asked])
        step = max(256, SCORE_CELLS // max(1, len(units)))
        for start in range(0, len(vectors), step):
            scores = units @ vectors[start : start + step].T
            cut, n = floor, scores.shape[1]
            if np.isneginf(cut).any() and n > self.k:
                scores[np.isnan(scores)] = -np.inf  # no hit, and no bar for others
                kth = np.partition(scores, n - self.k, axis=1)[:, n - self.k]
                cut = np.maximum(cut, np.round(kth, SCORE_DECIMALS))
            # Few pairs reach the cut; only these are rounded, which moves a score by less than a unit of the last place.
            query, column = np.divmod(np.flatnonzero(scores >= (cut - 10.0**-SCORE_DECIMALS)[:, None]), n)
            own = np.round(scores[query, column], SCORE_DECIMALS) + 0.0  # -0.0 becomes 0.0
            kept = (own >= cut[query]) & (own > -np.inf)
            query, column = query[kept], column[kept] + start
            if len(query):
                yield query if asked is None else asked[query], column if met is None else met[column], own[kept]

    def _trim(self) -> None:
        """Keep `k` rows per question; equal scores are decided by the chunk's key."""
        by_key = self.table.combine_chunks()
        place = np.empty(by_key.num_rows, dtype=np.int64)
        keys = [(name, "ascending") for name in KEY]
        place[pc.sort_indices(by_key, sort_keys=keys).to_numpy()] = np.arange(len(place))
        order = np.lexsort((place[self.row], -self.score, self.query))
        query = self.query[order]
        first = np.searchsorted(query, query, side="left")
        kept = order[np.arange(len(query)) - first < self.k]
        self.query, self.score = self.query[kept], self.score[kept]
        used, self.row = np.unique(self.row[kept], return_inverse=True)
        self.table = self.table.take(pa.array(used)).combine_chunks()
        count = np.bincount(self.query, minlength=len(self.floor))
        lowest = np.full(len(self.floor), np.inf)
        np.minimum.at(lowest, self.query, self.score)
        self.floor = np.where(count >= self.k, lowest, self.least)

    def rows(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.table is None:
            return
        for start in range(0, len(self.row), 10_000):
            stop = start + 10_000
            rows = self.table.take(pa.array(self.row[start:stop]))
            columns = {
                "query_id": ids.take(pa.array(self.query[start:stop])),
                "score": pa.array(self.score[start:stop]),
                **{name: rows[name] for name in KEY},
            }
            yield from pa.table(columns).combine_chunks().to_batches()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), width) if len(flat) else values.reshape(0, max(width, 0))


def rerank(
    candidates: DataFrame, k: int = TOP_K, relevance_weight: float = RELEVANCE_WEIGHT
) -> DataFrame:
    """Re-rank the output of `with_vectors`: `rank` 1..k in pick order per question.

    Each pick maximizes weight * score - (1 - weight) * closeness, where closeness is
    the highest cosine to an earlier pick, at least 0; equal values go to the earlier
    candidate. A question's candidates, at most `fetch_k`, lie next to one another in
    one task, which works on all questions of an Arrow batch at once.
    """
    fields = ["query_id", "candidate", "score", *KEY]
    schema = T.StructType([candidates.schema[name] for name in fields if name != "candidate"]).add("rank", T.IntegerType())
    weight = float(relevance_weight)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            # The last question may go on in the next batch.
            starts = np.flatnonzero(held["candidate"].to_numpy() == 1)
            if len(starts) > 1:
                yield from _picked(held.slice(0, starts[-1]), starts[:-1], k, weight)
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from _picked(held, np.zeros(1, np.int64), k, weight)

    return (
        candidates.select(*fields, "embedding")
        .repartition("query_id").sortWithinPartitions("query_id", "candidate")
        .mapInArrow(pick, schema)
        .select("query_id", "rank", "score", *KEY)
    )


def _picked(rows: pa.Table, starts: np.ndarray, k: int, weight: float) -> Iterator[pa.RecordBatch]:
    """The picks of whole questions, each beginning at one of `starts`."""
    sizes = np.diff(np.append(starts, rows.num_rows))
    picks, ranks = [], []
    for size in np.unique(sizes):
        of_size = starts[sizes == size]
        at = of_size[:, None] + np.arange(size)
        order = mmr_order(
            _matrix(rows["embedding"].take(pa.array(at.ravel())), -1).reshape(len(at), size, -1),
            rows["score"].to_numpy()[at], k, weight,
        )
        picks.append(np.take_along_axis(at, order, axis=1).ravel())
        ranks.append(np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(at)))
    picks, ranks = np.concatenate(picks), np.concatenate(ranks)
    if len(picks):
        out = rows.drop_columns(["candidate", "embedding"]).take(pa.array(picks)).append_column("rank", pa.array(ranks))
        yield from out.combine_chunks().to_batches()


def mmr_order(vectors: np.ndarray, scores: np.ndarray, k: int, weight: float) -> np.ndarray:
    """Maximal-marginal-relevance picks of many questions with as many candidates each.

    `vectors` (questions, candidates, width) and `scores` (questions, candidates) give
    the candidates' places in pick order (questions, k at most).
    """
    questions, size, _ = vectors.shape
    lengths = np.linalg.norm(vectors, axis=2, keepdims=True)
    units = vectors / np.where(lengths > 0, lengths, 1.0)
    closeness = np.matmul(units, units.transpose(0, 2, 1))
    nearest = np.zeros((questions, size))
    open_ = np.ones((questions, size), bool)
    order = np.empty((questions, max(0, min(k, size))), np.int64)
    every = np.arange(questions)
    for step in range(order.shape[1]):
        value = np.round(weight * scores - (1.0 - weight) * nearest, SCORE_DECIMALS)
        value[~open_] = -np.inf
        order[:, step] = pick = value.argmax(axis=1)
        open_[every, pick] = False
        nearest = np.maximum(nearest, closeness[every, pick])
    return order
