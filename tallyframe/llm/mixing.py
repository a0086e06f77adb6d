"""Mixing sources to target weights by Poisson replication.

A document of source s should appear, on average, rate(s) = weight(s) * total / rows(s) times. Its
count inverts the Poisson distribution with that mean at a uniform number hashed from seed, id and
text, so that every run, partitioning and retry gives the same counts. Means above `PART` are drawn as sums of
independent parts, which keeps exp(-mean) from vanishing. Documents are exploded by their count and
dealt over the cluster in the order of a second hash: a global shuffle without a central step.

A null source is a source of its own. Weights given for sources are normalised over the sources that
occur; one without a weight (or with a null, negative or non-finite one) gets none of its rows. Rows repeating id
and text draw the same count. Null ids and texts hash as empty strings. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, read

#: The largest mean inverted at once, the probability steps tried for it (beyond them lies less than
#: 1e-16 of a Poisson distribution of mean 16), the seed, and the exponent that turns sizes into weights.
PART, STEPS, SEED, TEMPERATURE = 16.0, 80, "mix-1", 0.5


def weights_by_size(docs: DataFrame, exponent: float = TEMPERATURE, source_col: str = "source") -> DataFrame:
    """(source, rows, weight): weights in proportion to rows ** exponent. Below 1 small sources gain."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("rows")).withColumn(
        "weight", F.pow(F.col("rows").cast("double"), F.lit(exponent)))


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, source_col: str = "source") -> DataFrame:
    """(source, rate): the mean repetition rate for each source; the mix has about `total` rows, by default as many as docs.
    weights: (source, weight)."""
    found = weights_by_size(docs, source_col=source_col)
    if weights is not None:
        given = weights.groupBy("source").agg(F.max("weight").alias("weight"))
        found = found.drop("weight").alias("f").join(given.alias("g"), F.expr("f.source <=> g.source"), "left").select("f.source", "rows", F.expr(
            "CASE WHEN weight > 0 AND NOT isnan(weight) AND weight < double('Infinity') THEN double(weight) ELSE 0D END AS weight"))
    found = cut(found)  # one row per source
    whole = found.agg(F.sum("weight").alias("w"), F.sum("rows").alias("n")).first()
    size = float(total if total is not None else whole["n"] or 0)
    return found.select("source", (F.col("weight") / F.lit(float(whole["w"] or 1.0)) * F.lit(size) / F.col("rows")).alias("rate"))


_UNIFORM = "conv(substring(md5(concat_ws('|', '{seed}', id_text, doc_key, cast(part AS string))), 1, 12), 16, 10) / 281474976710656D"


def copies_column(rate: str, seed: str = SEED) -> str:
    """SQL: the Poisson count for a row with columns id_text and doc_key. Each part has a uniform number u, hashed once; the
    number of k with CDF(k) <= u is the inverse at u. The running sum adds mean^k / k! * exp(-mean)."""
    parts = f"greatest(ceil({rate} / {PART}D), 1)"
    uniforms = f"transform(sequence(1, cast({parts} AS int)), part -> {_UNIFORM.format(seed=seed)})"
    inverse = (f"aggregate(sequence(1, {STEPS}), named_struct('p', exp(-d.m), 'c', exp(-d.m), 'n', if(exp(-d.m) <= d.u, 1L, 0L)), "
               "(s, k) -> named_struct('p', s.p * d.m / k, 'c', s.c + s.p * d.m / k, 'n', s.n + if(s.c + s.p * d.m / k <= d.u, 1L, 0L)), s -> s.n)")
    return f"aggregate(transform({uniforms}, u -> named_struct('u', u, 'm', {rate} / {parts})), 0L, (a, d) -> a + {inverse})"


def counted(docs: DataFrame, rate: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """docs with a struct _mix (copies, doc_key). The rates, one row per source, are joined; Spark broadcasts them if they are small."""
    named = rate.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    keyed = docs.join(named, docs[source_col].eqNullSafe(F.col("_source")), "left").withColumns({
        "_rate": F.coalesce("_rate", F.lit(0.0)), "_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_key": F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))})
    count = copies_column("_rate", seed).replace("id_text", "_id").replace("doc_key", "_key")
    return keyed.withColumn("_mix", F.struct(F.expr(count).alias("copies"), F.concat_ws("|", "_id", "_key").alias("doc_key"))).drop("_source", "_rate", "_id", "_key")


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """docs' rows by their counts, with `copy` (from 0) and `shuffle_key`, in the global order of that key:
    partitions hold ranges of it, and each is sorted. A column of either name is replaced."""
    spark = docs.sparkSession
    plain = docs.drop("copy", "shuffle_key", "_mix")
    found = counted(plain, rates(plain, weights, total, source_col), id_col, text_col, source_col, seed)
    rows = found.where(F.col("_mix.copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix.copies") - 1)))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("_mix.doc_key"), F.col("copy").cast("string")).cast("binary"))).drop("_mix")
    # The key is a uniform hash, so equal ranges of its first bits are equal shares, and no sampling pass is needed to find ranges.
    n = partitions(spark)
    share = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") * n / 4294967296.0).cast("int")
    return rows.repartitionById(n, share).sortWithinPartitions("shuffle_key")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "shuffle_key")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


ORACLE = f"""
WITH n AS (SELECT source, count(*) AS rows, pow(count(*)::DOUBLE, {TEMPERATURE}) AS weight FROM documents GROUP BY source),
r AS (SELECT source, weight / (SELECT sum(weight) FROM n) * (SELECT sum(rows) FROM n)::DOUBLE / rows AS rate FROM n),
d AS (SELECT doc_id, d.source, rate, coalesce(doc_id::VARCHAR, '') AS i, md5(coalesce(text, '')) AS k,
      unnest(range(1, greatest(ceil(rate / {PART}), 1)::BIGINT + 1)) AS part
      FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
u AS (SELECT doc_id, source, i, k, part, rate / greatest(ceil(rate / {PART}), 1) AS mean,
      ('0x' || substr(md5('{SEED}|' || i || '|' || k || '|' || part), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM d),
c AS (SELECT doc_id, source, i, k, sum(len(list_filter(range(0, {STEPS} + 1), lambda x: list_sum(list_transform(range(0, x + 1),
      lambda j: exp(-mean + j * ln(mean) - lgamma(j + 1)))) <= u))) AS copies FROM u GROUP BY ALL)
SELECT doc_id, source, copy, md5('{SEED}|order|' || i || '|' || k || '|' || copy) AS shuffle_key
FROM (SELECT doc_id, source, i, k, unnest(range(0, copies::BIGINT)) AS copy FROM c)
"""
