"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the text over its share now. Each document draws its
count of copies by inverting the Poisson distribution of its source's rate at a uniform number hashed from seed
and doc_id, so that the draw is the same on every run and machine. Copies are then put in the global order of a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, skew_join, table

SEED = 20_26
#: Target share of a source: its share of characters to this power, normalised. 1 keeps the mix, 0 makes sources equal.
TEMPERATURE = 0.5
#: Up to this many sources (at most 6 kB each) the rates go to every task; beyond, the documents are joined with them by source.
BROADCAST_SOURCES = 2_000
#: Rates above this are drawn as sums of equal parts; exp(-rate) stays far from underflow.
PART_RATE = 400.0


def hashed_uniform(*parts: Column) -> Column:
    """In (0, 1), from 52 bits of the md5 of the parts joined by colons."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(2.0**52)


def repetition_rates(docs: DataFrame, temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """source, rate: mean copies that bring each source to its target share while all text keeps `epochs` times its size.

    A source whose texts are all empty has nothing to weigh: rate `epochs`.
    """
    mass = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("chars"))
    total, powers = mass.agg(F.sum("chars"), F.sum(F.when(F.col("chars") > 0, F.pow("chars", F.lit(temperature))))).first()
    if not total:
        return mass.select("source", F.lit(float(epochs)).alias("rate"))
    rate = F.pow("chars", F.lit(temperature)) / F.lit(powers) * F.lit(epochs * total) / F.col("chars")
    return mass.select("source", F.when(F.col("chars") > 0, rate).otherwise(F.lit(float(epochs))).alias("rate"))


def poisson_mix(docs: DataFrame, rates: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """Copies of the documents in global hashed order: all columns of docs, then copy (from 1) and shuffle_key.

    rates: source, rate (see repetition_rates). A source without a rate is left out; null is a source like others. Rows
    that repeat a doc_id draw the same count. A null doc_id draws as the text `null`. Input columns named copy or
    shuffle_key are replaced; null and empty texts are replicated like others. An empty table gives an empty result.
    """
    rates = saved(repetition_rates(docs) if rates is None else rates, "rates")
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    each = F.col("rate") / parts
    steps = F.sequence(F.lit(1), F.ceil(each + 12 * F.sqrt(each) + 30).cast("int"))
    start = F.struct(F.exp(-each).alias("p"), F.array(F.exp(-each)).alias("cdf"))
    cdf = F.aggregate(steps, start, lambda s, k: F.struct((s.p * each / k).alias("p"), F.concat(s.cdf, F.array(F.element_at(s.cdf, -1) + s.p * each / k)).alias("cdf")), lambda s: s.cdf)
    drawn = rates.where("rate > 0").select(F.col("source").alias("of_source"), parts.alias("parts"), cdf.alias("cdf"))
    # The user's columns travel in one struct, so that no name of theirs can clash with a helper's.
    user = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in user]).alias("doc")).withColumn("id", F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("null")))
    rows = rows.withColumn("of_source", F.col("doc.source"))
    if rates.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(drawn), rows.of_source.eqNullSafe(drawn.of_source)).drop("of_source")
    else:  # null counts as a source: it is joined apart, as it equals nothing
        named = skew_join(rows.where("of_source IS NOT NULL"), drawn.where("of_source IS NOT NULL"), ["of_source"]).drop("of_source")
        joined = named.unionByName(rows.where("of_source IS NULL").drop("of_source").crossJoin(F.broadcast(drawn.where("of_source IS NULL").drop("of_source"))))  # one row at most
    draw = lambda i: F.size(F.filter("cdf", lambda c: c < hashed_uniform(F.lit(str(seed)), F.col("id"), i.cast("string"))))
    count = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda n, i: n + draw(i))
    copies = joined.withColumn("n", count).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "id", F.col("copy").cast("string")).cast("binary")))
    return keyed.select("doc", "copy", "shuffle_key").orderBy("shuffle_key").select("doc.*", "copy", "shuffle_key")


def op8_poisson_mixing(spark, sf_dir):
    return poisson_mix(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH mass AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source),
rates AS (SELECT source, pow(chars, {TEMPERATURE}) / sum(pow(chars, {TEMPERATURE})) OVER () * sum(chars) OVER () / chars AS rate FROM mass),
pmf AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(0, 200) AS t(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
drawn AS (SELECT d.*, (('0x' || substr(md5('{SEED}:' || doc_id || ':0'), 1, 13))::BIGINT::DOUBLE + 0.5) / pow(2, 52) AS u FROM documents d),
counts AS (SELECT doc_id, count(*) FILTER (c < u) AS n FROM drawn JOIN cdf USING (source) GROUP BY doc_id)
SELECT d.*, t.copy::INTEGER AS copy, md5('order{SEED}:' || doc_id || ':' || t.copy) AS shuffle_key
FROM documents d JOIN counts USING (doc_id), range(1, 200) AS t(copy) WHERE t.copy <= counts.n
"""
