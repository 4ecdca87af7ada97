"""Mixing sources to target weights by a low-discrepancy schedule of token blocks.

Documents of a source stand in an order shuffled by hash and their words are cut
into blocks of equal size. Slot i of the mix takes the golden-ratio point
frac(i phi), in integers, through the cumulative targets to a source; the r-th slot
of a source takes its r-th block, from the start again after the last. Positions
and ranks are prefix sums over hash buckets and over chunks of slots, so no source
is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlpit.runtime import stage

WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 32
REPEATS = 3
# Points are multiples of 1/POINTS; STEP is odd and nearest to POINTS / phi.
POINTS = 1 << 31
STEP = 1327217885
CHUNK = 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(placed: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target, and the bounds lo, hi of its points.

    All sizes are shared out by weight; what goes over `repeats` times a source's
    size is shared among the others by weight, until none is above.
    """
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("place") % len(weights) + 1)
    ratio = F.col("cap") / F.col("weight")
    before = everything.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    shared = (
        sizes.withColumn("place", F.row_number().over(ordered) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(repeats))
        .withColumn("ratio", ratio)
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("level", level)
        .withColumn("water", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(everything)["level"])
        .withColumn("target", F.coalesce(F.least("cap", F.col("weight") * F.col("water")), F.lit(0.0)))
    )
    below = F.coalesce(F.sum("target").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    low = F.when(F.col("total") > 0, F.least(F.floor(below / F.col("total") * POINTS), F.lit(POINTS))).otherwise(0)
    return shared.withColumn("lo", low.cast("long")).select(
        "source", "source_size", "target", "lo",
        F.coalesce(F.lead("lo").over(ordered), F.lit(POINTS)).cast("long").alias("hi"),
    )


def place(docs: DataFrame, carry: tuple = ()) -> DataFrame:
    """Rows with the position `start` of their first word in their source's order."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    sized = stage(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), *carry)
        .withColumn("bucket", F.substring("key", 1, 3)), "sized",
    )
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("base"),
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("start", F.col("base") + F.col("within"))
        .select("doc_id", "source", "size", "start", *carry)
    )


def schedule(shares: DataFrame, block: int = BLOCK_WORDS, repeats: int = REPEATS) -> DataFrame:
    """slot, source, epoch and block of the whole mix, in slot order."""
    spark = shares.sparkSession
    sources, total = shares.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    bins = 16 * max(1, sources)
    width = POINTS // bins + 1
    bounds = shares.filter("hi > lo").withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    )
    point = ((F.col("id") % POINTS) * STEP) % POINTS
    slots = (
        spark.range(-(-total // block)).select(F.col("id").alias("slot"), point.alias("point"))
        .withColumn("bin", F.floor(F.col("point") / width))
        .join(bounds, "bin").filter("point >= lo AND point < hi")
        .select("slot", F.floor(F.col("slot") / CHUNK).alias("chunk"), "source", "source_size")
    )
    counts = slots.groupBy("chunk", "source").agg(F.count("*").alias("slots"))
    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        F.col("chunk").alias("c"), F.col("source").alias("s"), F.coalesce(F.sum("slots").over(ahead), F.lit(0)).alias("base")
    )
    ranked = (
        slots.withColumn("nth", F.row_number().over(Window.partitionBy("chunk", "source").orderBy("slot")) - 1)
        .join(base, (F.col("chunk") == F.col("c")) & F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rank", F.col("base") + F.col("nth"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
    )
    return ranked.select(
        "slot", "source", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block")
    ).filter(F.col("epoch") < repeats)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK_WORDS, carry: tuple = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the columns in `carry`, a row for each row of `docs`.

    `taken` counts the words that the mix takes of the row, repeats included. Null
    and blank texts have size 0 and nothing is taken; a null source is a source of
    its own, the last; repeated rows count each. An empty table gives no rows.
    """
    placed = stage(place(docs, carry), "placed")
    shares = stage(targets(placed, weights, repeats), "targets")
    times = schedule(shares, block, repeats).groupBy("source", "block").agg(F.count("*").alias("times"))
    pieces = placed.filter("size > 0").select(
        F.col("source").alias("s"), "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("b"),
    )
    overlap = F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block) - F.greatest("start", F.col("b") * block)
    taken = (
        pieces.join(times, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("block")))
        .groupBy("s", F.col("start").alias("at")).agg(F.sum(overlap * F.col("times")).alias("taken"))
    )
    rows = placed.join(
        taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left"
    ).select("doc_id", F.col("source").alias("src"), "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *carry)
    return rows.join(shares, F.col("src").eqNullSafe(F.col("source"))).select(
        "doc_id", "source", "size", "source_size", "target", "taken", *carry
    )


def interleaved(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK_WORDS) -> DataFrame:
    """slot, source, epoch, block, text, spans: the mix itself, whose prefixes follow the weights.

    A row is the slot's block: its words joined by blanks, and of which documents
    they are, as (doc_id, first, words). Every block but a source's last has `block` words.
    """
    words = F.coalesce(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    placed = stage(place(docs.select("doc_id", "source", "text", words.alias("words")), ("words",)), "placed-words")
    shares = stage(targets(placed, weights, repeats), "targets")
    first, last = F.col("start"), F.col("start") + F.col("size")
    b = F.explode(F.sequence(F.floor(first / block), F.floor((last - 1) / block)))
    at = F.greatest(F.col("b") * block - first, F.lit(0)).cast("int")
    n = (F.least(last, (F.col("b") + 1) * block) - F.greatest(first, F.col("b") * block)).cast("int")
    parts = placed.filter("size > 0").select("*", b.alias("b")).select(
        F.col("source").alias("s"), "b", F.struct("start", "doc_id", at.alias("first"), n.alias("words"), F.slice("words", at + 1, n).alias("text")).alias("part")
    )
    blocks = parts.groupBy("s", "b").agg(F.sort_array(F.collect_list("part")).alias("parts")).select(
        "s", "b", F.array_join(F.flatten("parts.text"), " ").alias("text"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["first"].alias("first"), p["words"].alias("words"))).alias("spans"),
    )
    return schedule(shares, block, repeats).join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")


def _first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    words, gaps = (F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (WORD, GAP))
    lead = text.rlike(f"^{GAP}").cast("int")

    def total(parts: Column, count: Column) -> Column:
        return F.aggregate(F.slice(parts, 1, count), F.lit(0), lambda so_far, part: so_far + F.length(part))

    return F.substring(text, F.lit(1), total(words, n) + total(gaps, n - 1 + lead))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with the columns of `docs`, in no order (see `interleaved`).

    A row taken k times over stands k times; where the mix ends inside a document,
    that document's text up to there stands once more. `n_chars`, where there is such
    a column, follows the text. Only hashes and sizes of rows are staged; rows that are
    equal in all columns share what the mix takes of them, so it does not matter which is which.
    """
    whole = F.struct(*docs.columns)
    nulls = [F.col(c).isNull() for c in docs.columns]
    hashes = (F.xxhash64(whole, *nulls).alias("h1"), F.xxhash64(F.lit(1), whole, *nulls).alias("h2"))
    keyed = docs.select("doc_id", "text", "source", *hashes)
    rows = mix(keyed, carry=("h1", "h2"), **options)
    part = F.col("taken") % F.col("size")
    wanted = rows.filter("size > 0").groupBy("h1", "h2").agg(
        F.count("*").alias("equal"), F.sum(F.floor(F.col("taken") / F.col("size"))).alias("copies"),
        F.array_sort(F.collect_list(F.when(part > 0, part.cast("int")))).alias("parts"),
    ).filter("copies > 0 OR size(parts) > 0")
    given = docs.select(whole.alias("row"), *hashes).join(wanted, ["h1", "h2"])
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("h1")) - 1
    text = F.col("row.text")
    copies = F.floor(F.col("copies") / F.col("equal")) + (F.col("nth") < F.col("copies") % F.col("equal")).cast("int")
    cut = F.get("parts", F.col("nth"))
    texts = F.concat(
        F.array_repeat(text, copies.cast("int")),
        F.when(cut.isNotNull(), F.array(_first_words(text, cut))).otherwise(F.array().cast("array<string>")),
    )
    out = given.withColumn("nth", nth).select("row", F.explode(texts).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
