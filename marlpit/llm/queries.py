"""The registered queries of the pipeline's operators, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlpit.llm import (
    context_tree,
    jaccard_join,
    mixing,
    packing,
    phrases,
    pieces,
    quality_classifier,
    quality_rules,
    term_pipeline,
    tiles,
    toxicity,
    warc,
    wrapper,
)


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTERED: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(run):
        REGISTERED[run.__name__] = Query(run, sql)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_quality_rules(spark, folder):
    """Base counts, likelihood ratio and verdict of all documents."""
    return quality_rules.quality_rules(table(spark, folder, "documents"))


@query()
def op2_quality_classifier(spark, folder):
    """Quality of all documents by subword embeddings."""
    return quality_classifier.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op3_toxicity(spark, folder):
    """Toxicity of all documents by a recurrent network over windows."""
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op4_pieces(spark, folder):
    """Token ids of all documents, decoded again and compared."""
    return pieces.encode(table(spark, folder, "documents"), pieces.read_model())


OP5_SQL = r"""
WITH sized AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, md5(coalesce(doc_id::VARCHAR, text, '')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized),
weighed AS MATERIALIZED (
  SELECT source, source_size, place, (CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight,
         source_size * 3.0::DOUBLE AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source)),
levels AS MATERIALIZED (
  SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::DOUBLE AS total,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS MATERIALIZED (
  SELECT *, coalesce(least(cap, weight * (SELECT arg_min(level, (ratio, place)) FROM levels WHERE ratio >= level)), 0) AS target
  FROM levels),
lows AS MATERIALIZED (
  SELECT *, CASE WHEN total > 0 THEN least(floor(coalesce(sum(target) OVER (ORDER BY place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / total * 2147483648), 2147483648)::BIGINT ELSE 0 END AS lo
  FROM targets),
bounds AS MATERIALIZED (
  SELECT *, coalesce(lead(lo) OVER (ORDER BY place), 2147483648) AS hi FROM lows),
slots AS MATERIALIZED (
  SELECT s.slot, b.source, b.source_size, row_number() OVER (PARTITION BY b.source ORDER BY s.slot) - 1 AS rank
  FROM (SELECT slot, ((slot % 2147483648) * 1327217885) % 2147483648 AS point
        FROM (SELECT unnest(range(((SELECT sum(size) FROM sized) + 31)::BIGINT // 32)) AS slot)) s
  JOIN bounds b ON s.point >= b.lo AND s.point < b.hi),
times AS MATERIALIZED (
  SELECT source, rank % ((source_size + 31) // 32) AS block, count(*) AS times FROM slots
  WHERE rank // ((source_size + 31) // 32) < 3 GROUP BY ALL),
taken AS (
  SELECT r, sum((least(start + size, (b + 1) * 32) - greatest(start, b * 32)) * times) AS taken
  FROM (SELECT *, unnest(range(start // 32, (start + size - 1) // 32 + 1)) AS b FROM placed WHERE size > 0) p
  JOIN times t ON t.source IS NOT DISTINCT FROM p.source AND t.block = p.b GROUP BY r)
SELECT p.doc_id, p.size, t.source_size, round(t.target, 6) AS target, coalesce(k.taken, 0)::BIGINT AS taken
FROM placed p JOIN targets t ON t.source IS NOT DISTINCT FROM p.source LEFT JOIN taken k USING (r)
"""


@query(OP5_SQL)
def op5_mixing(spark, folder):
    """What a mix of all documents by source weights takes of each."""
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken"
    )


OP6_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, unnest(CASE WHEN len(words) = 0 OR words IS NULL THEN []::VARCHAR[]
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS shingle
  FROM w),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS MATERIALIZED (
  SELECT c.a, c.b FROM (
    SELECT x.r AS a, y.r AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.r <> y.r
    GROUP BY 1, 2) c JOIN n p ON p.r = c.a JOIN n q ON q.r = c.b
  WHERE 100 * common >= 75 * (p.n + q.n - common)),
reach AS (
  SELECT r, r AS other FROM w
  UNION
  SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM w LEFT JOIN n USING (r) JOIN reach USING (r) JOIN w o ON o.r = reach.other
GROUP BY w.r, w.doc_id, n.n
"""


@query(OP6_SQL)
def op6_jaccard_join(spark, folder):
    """Near-duplicate components of all documents."""
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


@query()
def op7_context_tree(spark, folder):
    """Word unigram and context-tree log probabilities of all documents."""
    return context_tree.language_scores(table(spark, folder, "documents"))


@query()
def op8_warc_derivatives(spark, folder):
    """Metadata and conversion records of all pages, with the size of each as written."""
    derived = warc.derive(warc.responses(table(spark, folder, "pages")), carry=("page_id",))
    return derived.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "http_headers", "block_digest", "payload_digest",
        F.col("block").cast("string").alias("content"), F.length(warc.serialise()).cast("long").alias("record_bytes"),
    )


@query()
def op9_wrapper_induction(spark, folder):
    """Main text of all pages."""
    return wrapper.extract(table(spark, folder, "pages"))


OP10_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(embedding) > 0
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
    AND isfinite(list_sum([abs(x::DOUBLE) FOR x IN embedding]))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@query(OP10_SQL)
def op10_nearest_tiles(spark, folder):
    """The five nearest other vectors of every fiftieth vector."""
    vectors = table(spark, folder, "embeddings")
    return tiles.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


@query()
def op11_packing(spark, folder):
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.packed_pieces(table(spark, folder, "documents"), packing.read_tokenizer(), ids=False)


# Each occurrence of a word carries the counts of the one to four words that begin there, so
# that no table is named twice. A phrase inside a longer one is inside one longer by a word,
# which is at least as frequent.
OP12_SQL = r"""
WITH words AS (
  SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i
  FROM (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w
        FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
              FROM documents))),
grams AS (
  SELECT lang, p, i, w1, w1 || ' ' || b AS w2, w1 || ' ' || b || ' ' || c AS w3, w1 || ' ' || b || ' ' || c || ' ' || d AS w4
  FROM (SELECT *, lead(w1, 1) OVER x AS b, lead(w1, 2) OVER x AS c, lead(w1, 3) OVER x AS d
        FROM words WINDOW x AS (PARTITION BY p ORDER BY i))),
counts AS (
  SELECT *, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER (PARTITION BY lang, w1) AS c1,
         count(w2) OVER (PARTITION BY lang, w2) AS c2, count(w3) OVER (PARTITION BY lang, w3) AS c3,
         count(w4) OVER (PARTITION BY lang, w4) AS c4
  FROM grams),
around AS (
  SELECT *, lead(c1, 1) OVER x AS c1b, lead(c1, 2) OVER x AS c1c, lead(c1, 3) OVER x AS c1d,
         lead(c2, 1) OVER x AS c2b, lead(c2, 2) OVER x AS c2c, lead(c3, 1) OVER x AS c3b,
         greatest(c3, coalesce(lag(c3) OVER x, 0)) AS longer3, greatest(c4, coalesce(lag(c4) OVER x, 0)) AS longer4
  FROM counts WINDOW x AS (PARTITION BY p ORDER BY i)),
found AS (
  SELECT lang, g.phrase AS phrase, any_value(n) AS n, any_value(g.a) AS a, max(g.longer) AS longer, any_value(g.cuts) AS cuts
  FROM (SELECT lang, n, unnest([
          {'phrase': w2, 'a': c2, 'longer': longer3, 'cuts': [[c1, c1b]]},
          {'phrase': w3, 'a': c3, 'longer': longer4, 'cuts': [[c1, c2b], [c2, c1c]]},
          {'phrase': w4, 'a': c4, 'longer': 0, 'cuts': [[c1, c3b], [c2, c2c], [c3, c1d]]}]) AS g
        FROM around)
  WHERE g.phrase IS NOT NULL AND g.a >= 30 GROUP BY lang, g.phrase),
scored AS (
  SELECT lang, phrase, n, a, list_min([
           {'score': 2000000::HUGEINT * a // (cuts[k][1] + cuts[k][2]), 'k': k, 'l': cuts[k][1], 'r': cuts[k][2]}
           FOR k IN range(1, len(cuts) + 1)]) AS cut
  FROM found WHERE longer < 30 OR 100 * longer < 80 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, cut.l::BIGINT AS l, cut.r::BIGINT AS r, n::BIGINT AS n, cut.score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank FROM scored)
WHERE rank <= 2000
"""


@query(OP12_SQL)
def op12_phrases(spark, folder):
    """The first 2000 collocations of every language."""
    return phrases.collocations(table(spark, folder, "documents"))


OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
whole AS MATERIALIZED (
  SELECT count(*) FILTER (len(words) > 0)::BIGINT AS docs, sum(len(words))::BIGINT AS total FROM d),
i AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
f AS MATERIALIZED (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS MATERIALIZED (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), whole),
scored AS (
  SELECT i.item_id, d.doc_id, d.r,
         sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * len(d.words)::BIGINT * docs) // total))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN d USING (r), whole GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""


@query(OP13_SQL)
def op13_term_pipeline(spark, folder):
    """The ten best documents of every benchmark item."""
    return term_pipeline.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
