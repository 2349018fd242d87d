"""Dense codes of ids: 1 to N in the order of ids, 0 for padding and unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def codec(*sources: DataFrame) -> DataFrame:
    """art, code of the distinct ids of all sources, empty and null ones left out. Ranks are counted in ranges and then offset, so no task sorts all ids."""
    ids = sources[0].select("art")
    for s in sources[1:]:
        ids = ids.union(s.select("art"))
    ids = ids.where(F.col("art").isNotNull() & (F.col("art").cast("string") != "")).distinct()
    # Ranges between the quantiles of a sample of 1,024 ids at most, which a hash picks: both uses of them agree. Works for strings.
    some = sorted(r.art for r in ids.orderBy(F.xxhash64("art")).limit(1024).collect())
    edges = some[16::16]
    cut = ids.select("art", (F.array_size(F.filter(F.array(*(F.lit(x) for x in edges)), lambda x: x < F.col("art"))) if edges else F.lit(0)).alias("p"))
    sizes = cut.groupBy("p").agg(F.count("*").alias("n"))
    # One row for each of 64 ranges.
    base = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("p").orderBy("art"))
    return cut.withColumn("i", own).join(F.broadcast(base), "p").select("art", (F.col("i") + F.col("base")).cast("bigint").alias("code"))


def encode(df: DataFrame, codes: DataFrame, col: str = "art") -> DataFrame:
    """Adds code, 0 for an unknown id."""
    c = codes.select(F.col("art").alias("_a"), F.col("code").alias("_c"))
    return df.join(c, F.col(col) == F.col("_a"), "left").withColumn("code", F.coalesce("_c", F.lit(0))).drop("_a", "_c")


def decode(df: DataFrame, codes: DataFrame) -> DataFrame:
    """code to art, null for 0 and unknown."""
    return df.join(codes.select("code", "art"), "code", "left")


def token_codes(texts: DataFrame, length: int, vocabulary: int) -> DataFrame:
    """art, tokens: `length` hashed token codes of 1 to vocabulary, 0 after the text's end. Code of a token: 32 bits of its md5 mod vocabulary, plus 1."""
    code = lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % vocabulary + 1).cast("int")
    w = F.slice(F.transform(tokens(F.col("title")), code), 1, length)
    return texts.select("art", F.concat(w, F.array_repeat(F.lit(0), F.lit(length) - F.size(w))).alias("tokens"))
