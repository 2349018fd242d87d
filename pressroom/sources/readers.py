"""Readers of the raw files into the unified tables. Paths are local or in any store Spark reads; nothing is downloaded.

Tab-separated files are read without quoting, since titles hold unbalanced quotes. What would leak the current impression's
outcome (its read time, scroll depth, what comes next) is never selected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import MIND_BEHAVIORS, MIND_NEWS


def _tsv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, quote="", escape="", enforceSchema=True, nullValue="")


def entity_labels(json: str) -> F.Column:
    """Labels of a JSON list of entities; bad JSON and objects without a label give none."""
    parsed = F.from_json(F.col(json), "array<struct<Label:string>>")
    return F.coalesce(F.filter(F.transform(parsed, lambda x: x["Label"]), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def mind_news(spark: SparkSession, path: str) -> DataFrame:
    raw = _tsv(spark, path, MIND_NEWS)
    return raw.select(
        F.lit("mind").alias("dataset"), "article_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), F.lit(None).cast("string").alias("body"),
        "category", F.array("subcategory").alias("subcategory"), F.lit(None).cast("timestamp").alias("published_time"), F.concat(entity_labels("title_entities"), entity_labels("abstract_entities")).alias("entities"),
    )


def _tokens(col: str) -> F.Column:
    return F.filter(F.split(F.coalesce(F.col(col), F.lit("")), r"\s+"), lambda x: x != "")


def mind_behaviors(spark: SparkSession, path: str, raw_split: str) -> DataFrame:
    """A shown token is an article id and, after its last hyphen, the label; null where there is none."""
    raw = _tsv(spark, path, MIND_BEHAVIORS)
    shown = _tokens("impressions")
    return raw.select(
        F.lit("mind").alias("dataset"), F.lit(raw_split).alias("raw_split"), "impression_id", "user_id", F.try_to_timestamp("time", F.lit("M/d/yyyy h:mm:ss a")).alias("time"),
        _tokens("history").alias("history"), F.lit(None).cast("array<double>").alias("history_read_time"), F.lit(None).cast("array<timestamp>").alias("history_impression_time"), F.lit(None).cast("string").alias("session_id"),
        F.transform(shown, lambda x: F.regexp_replace(x, "-[^-]*$", "")).alias("candidates"), F.transform(shown, lambda x: F.regexp_extract(x, "-([^-]*)$", 1).try_cast("int")).alias("labels"),
    )


def mind_test_behaviors(spark: SparkSession, path: str) -> DataFrame:
    """The unlabelled variant: a label is cut off where there is one."""
    raw = _tsv(spark, path, MIND_BEHAVIORS)
    return raw.select("impression_id", "user_id", F.try_to_timestamp("time", F.lit("M/d/yyyy h:mm:ss a")).alias("time"), _tokens("history").alias("history"), F.transform(_tokens("impressions"), lambda x: F.regexp_replace(x, "-[01]$", "")).alias("candidates"))


def keep_first(parts: list[DataFrame], key: str = "article_id") -> DataFrame:
    """Union of the periods in order; of rows equal in key, the first period's."""
    both = parts[0].withColumn("_period", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        both = both.unionByName(p.withColumn("_period", F.lit(k)))
    order = Window.partitionBy(key).orderBy("_period", F.monotonically_increasing_id())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_period")


def mind(spark: SparkSession, train: str, dev: str) -> tuple[DataFrame, DataFrame]:
    """Articles and behaviors of the folders of two periods."""
    articles = keep_first([mind_news(spark, f"{p}/news.tsv") for p in (train, dev)])
    return articles, mind_behaviors(spark, f"{train}/behaviors.tsv", "train").unionByName(mind_behaviors(spark, f"{dev}/behaviors.tsv", "dev"))


def ebnerd_articles(spark: SparkSession, path: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return spark.read.parquet(path).select(
        F.lit("ebnerd").alias("dataset"), F.col("article_id").cast("string").alias("article_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("subtitle", F.lit("")).alias("abstract"), F.coalesce("body", F.lit("")).alias("body"),
        F.col("category_str").alias("category"), F.coalesce(F.col("subcategory").cast("array<string>"), none).alias("subcategory"), F.col("published_time").cast("timestamp").alias("published_time"), F.coalesce(F.col("ner_clusters").cast("array<string>"), none).alias("entities"),
    )


def ebnerd_behaviors(spark: SparkSession, behaviors: str, history: str, raw_split: str) -> DataFrame:
    """Impressions with the user's history; users without one get empty lists. A clicked id that wasn't in view is no candidate.
    Of a user's several histories the longest counts, of those the one whose clicks are the latest."""
    fixed = F.struct("article_id_fixed", "read_time_fixed", "impression_time_fixed")
    h = spark.read.parquet(history).groupBy("user_id").agg(F.max_by(fixed, F.struct(F.size("article_id_fixed"), F.reverse("impression_time_fixed"), "article_id_fixed")).alias("h"))
    b = spark.read.parquet(behaviors).select("impression_id", "user_id", "impression_time", "session_id", "article_ids_inview", "article_ids_clicked")
    own = F.coalesce(F.col("h.article_id_fixed").cast("array<string>"), F.array().cast("array<string>"))
    return b.join(h, "user_id", "left").select(
        F.lit("ebnerd").alias("dataset"), F.lit(raw_split).alias("raw_split"), F.col("impression_id").cast("string").alias("impression_id"), F.col("user_id").cast("string").alias("user_id"), F.col("impression_time").cast("timestamp").alias("time"),
        own.alias("history"), F.coalesce(F.col("h.read_time_fixed").cast("array<double>"), F.array().cast("array<double>")).alias("history_read_time"),
        F.coalesce(F.col("h.impression_time_fixed").cast("array<timestamp>"), F.array().cast("array<timestamp>")).alias("history_impression_time"), F.col("session_id").cast("string").alias("session_id"),
        F.col("article_ids_inview").cast("array<string>").alias("candidates"), F.transform("article_ids_inview", lambda x: F.array_contains("article_ids_clicked", x).cast("int")).alias("labels"),
    )


def ebnerd(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    periods = [ebnerd_behaviors(spark, f"{root}/{p}/behaviors.parquet", f"{root}/{p}/history.parquet", raw) for p, raw in (("train", "train"), ("validation", "dev"))]
    return ebnerd_articles(spark, f"{root}/articles.parquet"), periods[0].unionByName(periods[1])


def mind_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """article_id, text: title and abstract, stripped."""
    return _tsv(spark, path, MIND_NEWS).select("article_id", F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))).alias("text"))


def ebnerd_catalogue(spark: SparkSession, path: str) -> DataFrame:
    texts = [F.coalesce(c, F.lit("")) for c in ("title", "subtitle", "body")]
    return spark.read.parquet(path).select(F.col("article_id").cast("string").alias("article_id"), F.trim(F.concat_ws(" ", *texts)).alias("text"), F.unix_micros(F.col("published_time").cast("timestamp")).alias("published"))


def count_rows(spark: SparkSession, path: str) -> int:
    """Impressions of a parquet table (from its footers) or a text file."""
    return spark.read.parquet(path).count() if ".parquet" in path else spark.read.text(path).count()


def provided_embeddings(spark: SparkSession, path: str, articles: DataFrame) -> DataFrame:
    """article_id, embedding: of the catalogue's articles, of unit length. The vector is the first column that isn't article_id."""
    from ..functions.vectors import normalised

    raw = spark.read.parquet(path)
    vector = next(c for c in raw.columns if c != "article_id")
    return raw.select(F.col("article_id").cast("string").alias("article_id"), normalised(F.col(vector)).alias("embedding")).join(articles.select("article_id"), "article_id", "left_semi")


def load_log(behaviors: DataFrame, split: str, with_history: bool = False, hours: float = 24) -> DataFrame:
    """All splits' impressions from `hours` before the split's first to its last, with is_target. The bounds are literals, so that files are pruned by them."""
    own = behaviors.where(F.col("split") == split).agg(F.min("time").alias("lo"), F.max("time").alias("hi")).first()
    cols = ["split", "impression_id", "time", "candidates", "labels", *["history"] * with_history]
    return behaviors.where((F.col("time") >= F.lit(own.lo) - F.expr(f"interval {int(hours * 3600)} seconds")) & (F.col("time") <= F.lit(own.hi))).select(*cols, (F.col("split") == split).alias("is_target"))
