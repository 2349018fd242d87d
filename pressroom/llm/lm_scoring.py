"""Stupid-backoff scores from bigram and unigram count tables over all documents.

S(w | v) = c(v w) / c(v) if c(v w) >= MIN_COUNT, else BACKOFF * c(w) / N; a text's first word is scored by c(w) / N. The
score of a document is the mean of ln S over its words. Words are those between blanks, lower-cased A-Z. Every word counts
as itself, however rare; there is no vocabulary and no unknown word.

The plan is relational:

1. The unigram table: words are counted by task, then by the word's hash.
2. Documents are exploded to rows (bigram, document, times), one for each distinct bigram of a document, dealt once by the bigram's
   hash. There a window over the bigram counts it: its count meets the exploded rows where they lie, as a join of the exchange
   with its own aggregate would have it, but with one sort, and spilling where a bigram has many rows.
3. Each row then needs one unigram count: that of v if the bigram counts, else that of w. Rows are summed by document, and the
   sums of the words that the broadcast table lacks are joined to the unigram table by hash.

Two tables of a fixed size are broadcast; they change what travels, not what is counted. TOP words of the highest counts get
small numbers, and HEAVY bigrams that are frequent in a sample of documents are counted over all documents with the unigrams and
scored where they are read, so that no frequent bigram is a hot key. All others go through the joins above.

A document's key is 64 bits of doc_id and text, so a task that is run again sends the same rows. Null and blank texts have no words
and a null score. Rows equal in doc_id and text share a key, count as often as they are there, and have one score; rows equal in
doc_id alone are scored each by itself. An empty table gives an empty table. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import lower_ascii, materialize, mix, partitions, read

MIN_COUNT, BACKOFF = 2, 0.4
#: Bounds of the broadcast tables, and of the documents that are looked at for frequent bigrams.
TOP, HEAVY, SAMPLE = 1 << 20, 1 << 19, 1 << 15
#: Words that a task handles at once, and different words that it remembers.
BLOCK, REMEMBERED = 500_000, 1 << 19
#: Words are hashes of 62 bits; one without a number from the broadcast table is -hash - RARE, which no number is.
BITS, RARE, NUMBER_BITS = (1 << 62) - 1, 10, 20
#: Kinds of rows, in column v: a bigram of two numbered words (g has both), another bigram (v and w are its words, g a hash of both, negative);
#: what is known of a document's sum, its words, and its first word (w) where that is rare. g then has the document's key.
COMMON, SUM, WORDS, FIRST = -1, -2, -3, -4
EXPLODED = StructType([StructField(n, LongType(), False) for n in ("g", "v", "w", "key")] + [StructField("k", DoubleType(), False)])


def tokens(text: str | None) -> list[bytes]:
    return lower_ascii(text.encode("utf-8", "surrogatepass")).split() if text else []


class Codes(dict):
    """Words to numbers as they come, and the words' hashes by number."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = k = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word) & BITS)
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


class Blocks:
    """Documents in blocks of less than 2 * BLOCK words, or of one document: keys, the words' numbers one after the other, and each word's document."""

    def __init__(self):
        self.codes = Codes()

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        keys, parts, held = [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = self.codes.of(tokens(text))
                if parts and len(c) >= BLOCK:  # a very long text is a block by itself
                    yield self._block(keys, parts)
                    keys, parts, held = [], [], 0
                keys.append(key)
                parts.append(c)
                held += len(c)
                if held >= BLOCK or len(parts) >= BLOCK:
                    yield self._block(keys, parts)
                    keys, parts, held = [], [], 0
        if parts:
            yield self._block(keys, parts)

    @staticmethod
    def _block(keys: list[int], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(keys, dtype=np.int64), np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])

    def hashes(self) -> np.ndarray:
        return np.array(self.codes.hashes, dtype=np.int64)


def _pairs(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64 bits of a bigram from those of its words."""
    return mix(mix(v.view(np.uint64)) * np.uint64(3) + w.view(np.uint64))


class Table:
    """Places of 64-bit numbers in a sorted table; a filter of 2**24 bits' worth of bytes answers most of what isn't there."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = np.zeros(1 << 24, dtype=bool)
        self.maybe[keys >> np.uint64(40)] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each, -1 if it isn't there."""
        out = np.full(len(x), -1, dtype=np.int64)
        some = np.flatnonzero(self.maybe[x >> np.uint64(40)])
        if len(some):
            i = np.minimum(np.searchsorted(self.keys, x[some]), len(self.keys) - 1)
            out[some] = np.where(self.keys[i] == x[some], i, -1)
        return out


def _frequent(counted: DataFrame, bound: int) -> DataFrame:
    """The rows with the highest c, `bound` at most: all of a count or none, to an eighth of a power of two. One small histogram goes to the driver."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    least, n = None, 0
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        n += r["count"]
        if n > bound:
            break
        least = r["level"]
    return counted.where(F.lit(False) if least is None else level >= least)


def _local_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, c: bigrams that occur twice in a block."""
    blocks = Blocks()
    for _, flat, doc in blocks(batches):
        h = blocks.hashes()[flat]
        g, c = np.unique(_pairs(h[:-1], h[1:])[doc[1:] == doc[:-1]], return_counts=True)
        g, c = g[c >= MIN_COUNT], c[c >= MIN_COUNT]
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], ["g", "c"])
        if len(blocks.codes) > REMEMBERED:
            blocks.codes = Codes()


def candidates(own: DataFrame, bound: int, sample: int) -> np.ndarray:
    """Sorted bigrams that are frequent in about `sample` documents. Which ones they are changes no score."""
    n = own.count()
    some = own if n <= sample else own.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    found = materialize(some.select("key", "text").mapInArrow(_local_bigrams, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")))
    return np.sort(_frequent(found, bound).select("g").toArrow().column(0).to_numpy().view(np.uint64))


def _counted(heavy: np.ndarray) -> Callable:
    """key, text to kind (0: words, 1: bigrams of the table), h (hash, or place in the table), c."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, table = Blocks(), Table(heavy)
        words, grams = np.zeros(0, dtype=np.int64), np.zeros(len(heavy), dtype=np.int64)

        def rows(kind: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, dtype=np.int32)), pa.array(h), pa.array(c)], ["kind", "h", "c"])

        for _, flat, doc in blocks(batches):
            hashes = blocks.hashes()
            words = np.concatenate([words, np.zeros(len(hashes) - len(words), dtype=np.int64)]) + np.bincount(flat, minlength=len(hashes))
            if len(heavy):
                h = hashes[flat]
                at = table.find(_pairs(h[:-1], h[1:])[doc[1:] == doc[:-1]])
                grams += np.bincount(at[at >= 0], minlength=len(heavy))
            if len(hashes) > REMEMBERED:
                yield rows(0, hashes, words)
                blocks.codes, words = Codes(), np.zeros(0, dtype=np.int64)
        if len(words):
            yield rows(0, blocks.hashes(), words)
        there = np.flatnonzero(grams)
        yield rows(1, there, grams[there])

    return of


def _exploded(top: np.ndarray, log_top: np.ndarray, heavy: np.ndarray, log_heavy: np.ndarray, log_n: float) -> Callable:
    """key, text to g, v, w, key, k: a row for each distinct bigram of a document that isn't heavy, and the rows that the markers name.
    top: sorted hashes, a word's place is its number; log_heavy: NaN for a bigram under MIN_COUNT, which is then exploded like others."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, table = Blocks(), Table(heavy)
        number, log = np.zeros(0, dtype=np.int64), np.zeros(0)

        def rows(g: np.ndarray, v: np.ndarray | int, w: np.ndarray | int, key: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            v, w = (np.full(len(g), x) if isinstance(x, int) else x for x in (v, w))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (g, v, w, key, k.astype(np.float64))], schema=shape)

        shape = pa.schema([*(pa.field(n, pa.int64(), False) for n in ("g", "v", "w", "key")), pa.field("k", pa.float64(), False)])
        for key, flat, doc in blocks(batches):
            hashes = blocks.hashes()
            if len(number) < len(hashes):  # words that are new: their numbers and logarithms
                new = hashes[len(number) :]
                i = np.minimum(np.searchsorted(top, new), max(len(top) - 1, 0))
                known = top[i] == new if len(top) else np.zeros(len(new), dtype=bool)
                number = np.concatenate([number, np.where(known, i, -new - RARE)])
                log = np.concatenate([log, np.where(known, log_top[i] if len(top) else 0.0, np.nan)])
            m = len(key)
            total = np.zeros(m)
            size = np.bincount(doc, minlength=m)
            first = flat[np.cumsum(size)[size > 0] - size[size > 0]]
            own = np.flatnonzero(size)
            common = number[first] >= 0
            total[own[common]] = log[first[common]] - log_n
            yield rows(key[own[~common]], FIRST, number[first[~common]], key[own[~common]], np.ones((~common).sum()))
            inside = np.flatnonzero(doc[1:] == doc[:-1])
            v, w, d = flat[inside], flat[inside + 1], doc[inside]
            if len(heavy):
                at = table.find(_pairs(hashes[v], hashes[w]))
                value = np.where(at >= 0, log_heavy[at] - log[v], np.nan)  # NaN, too, if v isn't among the top words
                here = ~np.isnan(value)
                total += np.bincount(d[here], weights=value[here], minlength=m)
                v, w, d = v[~here], w[~here], d[~here]
            # At most REMEMBERED + 2 * BLOCK words and BLOCK documents, or one document: under 2**63.
            one, k = np.unique((d * len(number) + v) * len(number) + w, return_counts=True)
            one, w = np.divmod(one, len(number))
            d, v = np.divmod(one, len(number))
            nv, nw = number[v], number[w]
            easy = (nv >= 0) & (nw >= 0)
            yield rows(nv[easy] << NUMBER_BITS | nw[easy], COMMON, COMMON, key[d[easy]], k[easy])
            d, v, w, k = (x[~easy] for x in (d, v, w, k))
            yield rows((_pairs(hashes[v], hashes[w]) | np.uint64(1 << 63)).view(np.int64), number[v], number[w], key[d], k)
            yield rows(key, SUM, SUM, key, total)
            yield rows(key, WORDS, WORDS, key, size)
            if len(blocks.codes) > REMEMBERED:
                blocks.codes, number, log = Codes(), np.zeros(0, dtype=np.int64), np.zeros(0)

    return of


def score(docs: DataFrame, top: int = TOP, heavy: int = HEAVY, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_tokens, total (the sum of ln S; null without words)."""
    spark = docs.sparkSession
    parts = partitions(spark)
    own = docs.select("doc_id", F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("key"), "text")
    texts = own.select("key", "text")
    often = candidates(own, heavy, sample)
    counted = materialize(texts.mapInArrow(_counted(often), "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c")))
    words, grams = counted.where("kind = 0"), counted.where("kind = 1")
    n = words.agg(F.sum("c")).first()[0] or 0
    log_n = math.log(max(n, 1))

    most = _frequent(words, top).select("h", "c").toArrow()
    order = np.argsort(hashes := most.column(0).to_numpy())
    hashes, log_top = hashes[order], np.log(most.column(1).to_numpy()[order])
    got = grams.select("h", "c").toArrow()
    times = np.zeros(len(often))
    times[got.column(0).to_numpy()] = got.column(1).to_numpy()
    log_heavy = np.log(np.where(times >= MIN_COUNT, times, np.nan))

    exploded = texts.mapInArrow(_exploded(hashes, log_top, often, log_heavy, log_n), EXPLODED)
    gram = (F.col("v") == COMMON) | (F.col("v") >= 0) | (F.col("v") <= -RARE)
    number = lambda col, shifted: F.when(F.col("v") == COMMON, shifted).otherwise(F.col(col))
    # A document's own rows carry its key as g, which may be some bigram's hash: what they carry isn't counted.
    dealt = exploded.repartition(parts, "g").withColumn("c", F.when(gram, F.sum(F.when(gram, F.col("k"))).over(Window.partitionBy("g"))))
    dealt = dealt.withColumn("c", F.when(F.col("c") >= MIN_COUNT, F.col("c")))
    x = F.when(F.col("c").isNotNull(), number("v", F.shiftright("g", NUMBER_BITS)))
    x = x.when(gram | (F.col("v") == FIRST), number("w", F.col("g").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))))
    log_known = spark.createDataFrame(pa.table({"x": pa.array(np.arange(len(hashes))), "ln": pa.array(log_top)}), "x long, ln double")
    joined = dealt.select("key", "v", "k", "c", x.alias("x")).join(F.broadcast(log_known), "x", "left")  # TOP rows at most
    sign = F.when(F.col("c").isNotNull(), -1.0).otherwise(1.0)
    known = F.when(F.col("c").isNotNull(), F.log("c")).when(F.col("v") == FIRST, F.lit(-log_n)).otherwise(F.lit(math.log(BACKOFF) - log_n))
    rare = F.col("x") < 0
    value = F.when(F.col("v") == WORDS, 0.0).when(F.col("v") == SUM, F.col("k")).otherwise(F.col("k") * (known + F.when(rare, 0.0).otherwise(sign * F.col("ln"))))
    is_words = F.col("v") == WORDS
    sums = joined.groupBy("key", F.when(rare, F.col("x")).alias("x")).agg(
        F.sum(value).alias("s"), F.sum(F.when(rare, F.col("k") * sign)).alias("z"), F.sum(F.when(is_words, F.col("k"))).alias("n"), F.count(F.when(is_words, 1)).alias("m")
    )
    sums = materialize(sums)
    lacking = sums.where("x is not null").join(words.select((-F.col("h") - RARE).alias("x"), F.log(F.col("c").cast("double")).alias("ln")), "x")
    both = sums.where("x is null").select("key", "s", "n", "m").unionByName(lacking.select("key", (F.col("s") + F.col("z") * F.col("ln")).alias("s"), F.lit(None).cast("double").alias("n"), F.lit(0).cast("long").alias("m")))
    by_key = both.groupBy("key").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    out = own.select("doc_id", "key").join(by_key, "key", "left")
    return out.select("doc_id", (F.col("n") / F.col("m")).cast("long").alias("n_tokens"), F.when(F.col("n") > 0, F.col("s") / F.col("m")).alias("total"))


def op10_lm_scoring(spark, sf_dir):
    out = score(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", F.round(F.col("total") / F.col("n_tokens"), 6).alias("score"))


OP10_SQL = f"""
with d as (select row_number() over () r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') w from documents),
t as (select r, unnest(w) w, generate_subscripts(w, 1) i from d),
n as (select count(*) n from t),
u as (select w, count(*) c from t group by w),
b as (select r, i, w, lag(w) over (partition by r order by i) p from t),
g as (select p, w, count(*) c from b where p is not null group by p, w),
s as (
  select r, sum(case when b.p is null then ln(u.c) - ln(n.n) when g.c >= {MIN_COUNT} then ln(g.c) - ln(q.c) else ln({BACKOFF}) + ln(u.c) - ln(n.n) end) s
  from b cross join n join u on b.w = u.w left join g on b.p = g.p and b.w = g.w left join u q on b.p = q.w group by r)
select d.doc_id, cast(len(d.w) as bigint) n_tokens, round(s.s / len(d.w), 6) score from d left join s using (r)
"""
