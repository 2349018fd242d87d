"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

An item is contained in a document if the document holds `threshold` of its distinct shingles. Documents are partitioned
by size: partition p has up to 2**p shingles. In it, MinHash has 2**(p + 4) bins (one permutation: the leading bits of a
shingle's hash are its bin, the least hash of a bin is the bin's value), so a long document gets a signature as much
longer as it needs for a short item to show: a shingle is its bin's least with a chance of KEPT or more. A hash is least in
its bin of the item from some number of bins on, so an item is indexed once for all partitions. The two are candidates if
their values are equal in as many bins as containment implies: of m shared shingles at least KEPT * m - sqrt(m ln(1 / MISS) / 2) show
but for a chance of MISS (Hoeffding). Pairs are made only where the two meet in one of the item's rarest shingles, as many as a document
that contains it can't do without (SPARE more than it may lack), so a line that many documents and items share makes no rows of pairs. Items of under SHORT
shingles are searched by all shingles of the documents, in the same way. Candidates are verified on full shingle sets; of a document's set only the shingles that some item has are carried to its pairs.

A text of fewer words than a shingle is one shingle as a whole; null and blank texts have none and contain nothing. An item
without an id is passed over. Equal texts are searched alike and verified once, so repeated rows and ties have the same result. Very long
texts are searched whole. An empty table gives an empty one, and without items no document is contaminated. The document travels as
one struct, so its other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, read, small_or_same, word_array

WORDS, THRESHOLD, SHORT = 5, 0.8, 8
#: A document's shingle is the least of its bin with this chance ((1 - exp(-x)) / x with x = 1/16); the chance that a contained item shows too little; shingles of
#: which none shows with that chance (0.031^6).
KEPT, MISS, SPARE = 0.969, 1e-9, 6


def shingles(text: str | Column, n: int = WORDS) -> Column:
    """Hashes of a text's n-word shingles, sorted, with repeats. Wrapping the words in an array makes them a variable, split once."""
    hashes = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return F.sort_array(F.get(F.transform(F.array(word_array(text)), hashes), F.lit(0)))


def _bits(p: Column) -> Column:
    return p + 4


def _index(items: DataFrame, n: int) -> DataFrame:
    """item, q (shingles), set, and for each hash h the least number of leading bits from which it is the least of its bin."""
    s = items.select(F.col("item_id").alias("item"), F.array_distinct(shingles("text", n)).alias("set")).where((F.size("set") > 0) & F.col("item").isNotNull()).withColumn("q", F.size("set"))
    # The bits that a hash has in common with the one before it, which is the nearest: 64 less the length of their difference.
    return s.withColumn("from", F.transform("set", lambda x, i: F.when(i == 0, 0).otherwise(65 - F.length(F.bin(x.bitwiseXOR(F.get("set", i - 1)))))))


def _met(seen: DataFrame, rows: DataFrame, sent: Callable[[DataFrame], DataFrame], first: Column, threshold: float) -> DataFrame:
    """A row for each of an item's rarest hashes, `first` of them, that a text has."""
    times = seen.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    rarest = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "h"))
    few = rows.join(times, "h", "left").withColumn("r", rarest).where(F.col("r") <= first).select("item", "q", "h", "from")
    met = seen.select("k1", "k2", "p", "n", F.explode("s").alias("h")).join(sent(few), "h")
    return met.where((F.col("from") <= _bits(F.col("p"))) & (F.col("n") >= F.col("q") * threshold))


def _meeting(seen: DataFrame, rows: DataFrame, index: DataFrame, sent: Callable[[DataFrame], DataFrame], first: Column, enough: Column, threshold: float) -> DataFrame:
    """k1, k2, item of the candidates. seen: k1, k2, p, n and s, those of a text's hashes that some item has; rows: item, q, h, from; first: the number of an item's hashes, rarest
    first, of which a text that contains it shows one; enough: hashes that it shows in all. A pair is made only where the two meet in one of the first."""
    met = _met(seen, rows, sent, first, threshold)
    both = met.select("k1", "k2", "item").distinct().join(seen.select("k1", "k2", "p", "s"), ["k1", "k2"]).join(sent(index), "item")
    shown = F.filter("set", lambda x, i: F.get("from", i) <= _bits(F.col("p")))
    return both.where(F.size(F.array_intersect("s", shown)) >= enough).select("k1", "k2", "item")


def contained(docs: DataFrame, items: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """k1, k2 (the text's key, see keyed), items (ids, sorted) and containment (the largest), for texts that contain an item."""
    index = materialize(_index(items, n))
    flat = index.select("item", "q", F.explode(F.arrays_zip("set", "from")).alias("x")).select("item", "q", F.col("x.set").alias("h"), F.col("x.from").alias("from"))
    flat = materialize(flat)
    # The items' shingles, a row each, are what is counted before a broadcast; the index holds the same as arrays.
    few = flat.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = F.broadcast if few else (lambda df: df)
    own = keyed(docs).where("k1 is not null")
    sets = own.select("k1", "k2", shingles("text", n).alias("s"))
    sized = sets.where(F.size("s") > 0).select("k1", "k2", "s", F.ceil(F.log2(F.size("s").cast("double"))).cast("int").alias("p"), F.size("s").alias("n"))
    leading = lambda x: F.call_function("shiftright", x, F.lit(64) - _bits(F.col("p")))
    least = F.filter("s", lambda x, i: (i == 0) | (leading(x) != leading(F.get("s", i - 1))))

    def seen(hashes: Column, of: DataFrame) -> DataFrame:
        """A row a text that has one of the items' hashes: those that it has. Equal texts are one."""
        met = sized.select("k1", "k2", "p", "n", F.explode(hashes).alias("h")).join(sent(of.select("h").distinct()), "h", "left_semi")
        return materialize(met.groupBy("k1", "k2", "p", "n").agg(F.collect_set("h").alias("s")))

    shared = F.ceil(F.col("q") * threshold - 1e-9).cast("int")  # of a contained item
    lost = F.col("q") - shared
    enough = F.greatest(F.lit(1.0), F.ceil(KEPT * shared - F.sqrt(shared * (math.log(1 / MISS) / 2))).cast("double"))
    # Of lost + SPARE hashes a text that contains the item has SPARE at least, and shows none with a chance of MISS.
    pairs = _meeting(seen(least, flat), flat, index, sent, lost + SPARE, enough, threshold)
    short = flat.where(F.col("q") < SHORT)
    if not short.isEmpty():  # by all hashes, so no chance
        every, always = short.withColumn("from", F.lit(0)), index.where(F.col("q") < SHORT).withColumn("from", F.transform("set", lambda x: F.lit(0)))
        pairs = pairs.unionByName(_meeting(seen(F.array_distinct("s"), short), every, always, sent, lost + 1, shared, threshold))
    pairs = materialize(pairs.distinct())
    texts = own.join(small_or_same(materialize(pairs.select("k1", "k2").distinct())), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    known = flat.select("h").distinct()
    own_shingles = texts.select("k1", "k2", F.explode(F.array_distinct(shingles("text", n))).alias("h")).join(sent(known), "h", "left_semi")
    own_shingles = own_shingles.groupBy("k1", "k2").agg(F.collect_list("h").alias("s"))
    both = pairs.join(own_shingles, ["k1", "k2"]).join(sent(index.select("item", "q", "set")), "item")
    share = F.size(F.array_intersect("s", "set")) / F.col("q")
    return materialize(both.withColumn("c", share).where(F.col("c") >= threshold).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("c").alias("containment")))


def keyed(docs: DataFrame) -> DataFrame:
    """row (the document as a struct), text, and 128 bits of it, null for a null text."""
    return docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("k1"), F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(1), "text")).alias("k2"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, with their own columns."""
    bad = contained(docs, items, n, threshold).select("k1", "k2")
    return keyed(docs).join(small_or_same(bad), ["k1", "k2"], "left_anti").select("row.*")


def op8_decontamination(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contained(docs, read(spark, sf_dir, "benchmark"))
    out = keyed(docs).select("row.doc_id", "k1", "k2").join(small_or_same(found), ["k1", "k2"], "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))), F.lit("")).alias("items"), F.round(F.coalesce("containment", F.lit(0.0)), 6).alias("containment"))


_SQL_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_SQL_SHINGLES = f"unnest(list_distinct(case when len(w) >= {WORDS} then [array_to_string(w[i:i + {WORDS - 1}], ' ') for i in range(1, len(w) - {WORDS - 2})] when len(w) > 0 then ['=' || array_to_string(w, ' ')] else [] end)) s"
OP8_SQL = f"""
with d as (select doc_id, {_SQL_WORDS} w from documents), ds as (select doc_id, {_SQL_SHINGLES} from d),
b as (select item_id, {_SQL_WORDS} w from benchmark), bs as (select item_id, {_SQL_SHINGLES} from b),
q as (select item_id, count(*) q from bs group by item_id),
c as (select doc_id, item_id, count(*) / max(q) c from ds join bs using (s) join q using (item_id) group by doc_id, item_id having count(*) / max(q) >= {THRESHOLD}),
g as (select doc_id, string_agg(cast(item_id as varchar), ',' order by item_id) items, max(c) c from c group by doc_id)
select d.doc_id, g.items is not null contaminated, coalesce(g.items, '') items, round(coalesce(g.c, 0.0), 6) containment
from documents d left join g on d.doc_id = g.doc_id
"""
