"""Mixing sources to target weights by Poisson replication.

A document of source s is meant to appear rate_s = weight_s * total / size_s times. How often it does is the inverse of
the Poisson distribution with that mean at a number in [0, 1) that a hash of the seed and doc_id gives: nothing is drawn,
so a run can be repeated, on any partitioning. Each copy then gets a hash as its place in a global order, by which whole documents
are shuffled.

A distribution is a table of its own: a row for each k within about ten deviations of the rate, with the logarithm of p(k)
relative to the first as a running sum of ln(rate / k), and p divided by its sum. So it is right at any rate, and its size is
some twenty square roots of the rate.

Weights: given by source, or size ** temperature (the default). Null sources are a source of their own, null doc_ids
hash as the empty text, a null or empty text is a document like others. Rows equal in doc_id get the same count and, copy by copy, the
same place. An empty table gives an empty table. The document travels as one struct, so its other columns may have any
names. Only counts by source are aggregated, before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read

TEMPERATURE, SEED = 0.7, "mix-1"
#: Numbers of all sources' distributions up to which they are broadcast (20 MB).
CELLS = 2_500_000


def unit(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, from the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson(rates: DataFrame) -> DataFrame:
    """s, n, rate to the same with least and cdf: the distribution function at least, least + 1, ... to where nothing is left."""
    reach = 10 * F.sqrt("rate") + 24
    ks = F.sequence(F.greatest(F.lit(0), F.floor(F.col("rate") - reach)).cast("long"), F.floor(F.col("rate") + reach).cast("long"))
    by_k, all_k = Window.partitionBy("s").orderBy("k"), Window.partitionBy("s")
    # p(k) = p(k - 1) * rate / k. A rate of 0 leaves p(0) alone.
    step = F.when(F.col("k") == F.min("k").over(all_k), 0.0).when(F.col("rate") > 0, F.log(F.col("rate") / F.col("k"))).otherwise(float("-inf"))
    rows = rates.select("s", "n", "rate", F.explode(ks).alias("k")).withColumn("step", step).withColumn("ln", F.sum("step").over(by_k))
    rows = rows.withColumn("p", F.exp(F.col("ln") - F.max("ln").over(all_k))).withColumn("c", F.sum("p").over(by_k) / F.sum("p").over(all_k))
    out = rows.groupBy("s", "n", "rate").agg(F.min("k").alias("least"), F.sort_array(F.collect_list(F.struct("k", "c"))).alias("cdf"))
    return out.withColumn("cdf", F.transform("cdf", lambda x: x["c"]))


def rates(docs: DataFrame, weights: dict | None = None, temperature: float = TEMPERATURE, total: int | None = None) -> DataFrame:
    """s (source), n and rate. total: rows wanted, as many as there are by default."""
    n = docs.groupBy(F.col("source").cast("string").alias("s")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        n = n.withColumn("w", F.coalesce(F.create_map(*pairs)[F.coalesce("s", F.lit(""))] if pairs else F.lit(None).cast("double"), F.lit(0.0)))
    n = materialize(n)
    # A sum of decimals doesn't depend on its order.
    sums = n.agg(F.sum("n").alias("total"), F.sum(F.col("w").cast("decimal(38,12)")).cast("double").alias("all"))
    wanted = F.lit(total) if total is not None else F.col("total")
    n = n.crossJoin(F.broadcast(sums))  # one row
    return n.select("s", "n", F.when(F.col("all") > 0, F.col("w") / F.col("all") * wanted / F.col("n")).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = TEMPERATURE, total: int | None = None, seed: str = SEED, shuffled: bool = True) -> DataFrame:
    """row (the document as a struct), rate, copies, copy (1 to copies) and place; in the order of place, which mixes all sources."""
    table = materialize(poisson(rates(docs, weights, temperature, total)))
    d = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    own = docs.select(F.struct("*").alias("row"), unit(F.lit(seed), d).alias("u"), d.alias("d"), F.col("source").cast("string").alias("src"))
    # Distributions of CELLS numbers in all are broadcast; larger ones are joined by shuffle, where Spark splits a large source.
    cells = table.agg(F.sum(F.size("cdf") + 8)).first()[0] or 0
    both = own.join(F.broadcast(table) if cells <= CELLS else table, own.src.eqNullSafe(table.s))
    out = both.withColumn("copies", F.col("least") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))).where("copies > 0")
    out = out.select("row", "rate", "copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "d")
    out = out.select("row", "rate", "copies", "copy", unit(F.lit(seed), F.lit("place"), "d", F.col("copy").cast("string")).alias("place"))
    return out.repartitionByRange("place").sortWithinPartitions("place") if shuffled else out


def op7_mixing(spark, sf_dir):
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("row.doc_id", "row.source", "row.text", "copies", "copy", F.round("rate", 9).alias("rate"), F.round("place", 12).alias("place"))


#: The distribution in closed form, by the logarithm of the gamma function.
OP7_SQL = f"""
with n as (select source s, count(*) n, pow(cast(count(*) as double), {TEMPERATURE}) w from documents group by source),
r as (select s, n, w / (select cast(sum(cast(w as decimal(38,12))) as double) from n) * (select sum(n) from n) / n rate from n),
k as (select s, rate, unnest(range(0, cast(floor(rate + 12 * sqrt(rate)) as bigint) + 40)) k from r),
c as (select s, rate, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by s order by k) c from k),
d as (select row_number() over () i, doc_id, source, text, ('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint / 4503599627370496.0 u from documents),
m as (select i, any_value(rate) rate, count(*) copies from d join c on source is not distinct from s and c.c <= u group by i),
x as (select *, unnest(range(1, copies + 1)) as copy from d join m using (i))
select doc_id, source, text, copies, copy, round(rate, 9) rate,
  round(('0x' || substr(md5('{SEED}:place:' || coalesce(cast(doc_id as varchar), '') || ':' || cast(copy as varchar)), 1, 13))::bigint / 4503599627370496.0, 12) place
from x
"""
