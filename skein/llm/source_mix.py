"""Mixing sources to target weights by Poisson replication.

A source's rate is its share of the wanted rows over the rows it has. Each document draws a
uniform number from a hash of the seed and its doc_id, the inverse of the Poisson
distribution with that rate turns it into a number of copies, and the copies are dealt over
all partitions and sorted there by another hash: a global random order, the same in every run.
A rate of over `PIECE` is cut into equal pieces with a draw each, as a sum of Poisson draws is
one with the sum of the rates; so the tables stay short whatever the rate.

Only counts by source are gathered. The table of sources is broadcast if it has at most
`BROADCAST_SOURCES` rows, and joined by key otherwise; either way a hot source splits freely,
since nothing is grouped by source but counts.

A null source is a source of its own; a null doc_id draws as the text "null"; rows with equal
doc_id draw the same number. Sources without a weight get none and their rows go. An empty
table gives an empty result. All columns of the input stay, whatever their names; `copy` (1 and
up) is added unless the input has such a column, which then stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import free_names, stored, table

SEED = 17
BROADCAST_SOURCES = 20_000
#: The largest rate that is drawn at once.
PIECE = 64


def uniform(seed: int, doc_id: Column, piece: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5; pieces after the first have one of their own."""
    text = F.concat(F.lit(str(seed)), F.when(piece > 0, F.concat(F.lit("."), piece.cast("string"))).otherwise(F.lit("")), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... to where the tail is below the resolution of `uniform`; in logarithms, so that no rate underflows."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))
    step = lambda a, k: F.struct(
        (a["log"] + F.log(rate) - F.log(k.cast("double"))).alias("log"),
        (a["sum"] + F.exp(a["log"] + F.log(rate) - F.log(k.cast("double")))).alias("sum"),
        F.array_append(a["all"], a["sum"] + F.exp(a["log"] + F.log(rate) - F.log(k.cast("double")))).alias("all"),
    )
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["all"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, rows: int | None) -> DataFrame:
    """source, rate: mean copies of a document, so that sources get their weights' shares of `rows` rows in the mean."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    spark = docs.sparkSession
    if weights is None:
        weighed = counts.withColumn("w", F.lit(1.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, w double")
        weighed = counts.join(given, counts["source"].eqNullSafe(given["k"]), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    whole = weighed.agg(F.sum("w").alias("ws"), F.sum("n").alias("ns"))
    wanted = F.col("ns") if rows is None else F.lit(rows)
    return weighed.join(F.broadcast(whole)).where("w > 0").select("source", (F.col("w") / F.col("ws") * wanted / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, rows: int | None = None, seed: int = SEED) -> DataFrame:
    """docs (at least doc_id, source), replicated to the weights (None: all sources alike) and globally shuffled."""
    spark = docs.sparkSession
    source, pieces, cdf, drawn, copy, order = free_names(docs.columns, "source", "pieces", "cdf", "drawn", "copy", "order")
    n_pieces = F.ceil(F.col("rate") / PIECE).cast("int")
    rates = stored(source_rates(docs, weights, rows).select(F.col("source").alias(source), n_pieces.alias(pieces), poisson_cdf(F.col("rate") / n_pieces).alias(cdf)), "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col(source)))
    one = lambda piece: F.size(F.filter(F.col(cdf), lambda c: c <= uniform(seed, F.col("doc_id"), piece)))
    several = F.aggregate(F.sequence(F.lit(1), F.col(pieces) - 1), one(F.lit(0)), lambda n, piece: n + one(piece))
    # most rates are one piece: its draw is a column, made once a row
    u = uniform(seed, F.col("doc_id"), F.lit(0))
    first = joined.withColumn(order, u).withColumn(drawn, F.when(F.col(pieces) == 1, F.size(F.filter(F.col(cdf), lambda c: c <= F.col(order)))).otherwise(several))
    copies = first.where(F.col(drawn) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(drawn)))).drop(cdf, source, pieces, drawn)
    dealt = copies.withColumn(order, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(copy)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt.repartition(n, order).sortWithinPartitions(order)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return spread.select(*own, *([] if "copy" in map(str.lower, docs.columns) else [F.col(copy).alias("copy")]))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM c) * (SELECT sum(n) FROM c)::DOUBLE / n AS whole FROM c),
r AS (SELECT source, CAST(ceil(whole / {PIECE}) AS BIGINT) AS pieces, whole / ceil(whole / {PIECE}) AS rate FROM w),
p AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM r, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS u(k)
), d AS (
  SELECT documents.*, (CAST('0x' || substr(md5('{SEED}' || CASE WHEN j > 0 THEN '.' || j ELSE '' END || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source, unnest(range(0, pieces)) AS v(j)
), k AS (
  SELECT doc_id, text, lang, d.source, n_chars, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM d.source AND cdf <= d.u) AS n FROM d
), s AS (
  SELECT doc_id, text, lang, source, n_chars, sum(n) AS n FROM k GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS INTEGER) AS copy FROM s, unnest(range(1, CAST(n AS BIGINT) + 1)) AS u(i)
"""
