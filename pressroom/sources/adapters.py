"""The driver's tables as impression logs.

Orders: an order is an impression of its lines; a returned part is a click; the user is the customer. Days are the finest
time, so many impressions tie. Events: views and clicks of the article in props, in microseconds.
All times are long microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import VAL_FRACTION

#: The later raw period starts here (2000-01-01 in microseconds).
DEV_FROM = 946_684_800_000_000
#: Logs; their rows for each partition that a shuffle begins with; and bytes shuffled that a task reads.
LOGS, LOG_ROWS, PART_BYTES = ("lineitem", "events"), 1 << 17, "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in LOGS:
        dealt(df)
    return df


def dealt(log: DataFrame) -> None:
    """Lets the session deal a log's rows to as many partitions as the log needs, so that a task's memory doesn't grow with it. Adaptive execution makes one partition of
    several small ones, up to PART_BYTES shuffled, which stays as it is if the session has set it."""
    spark, need = log.sparkSession, log.count() // LOG_ROWS
    first, most = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if need > int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(first, str(need))
        if spark.conf.get(most, None) is None:
            spark.conf.set(most, PART_BYTES)


def parts(spark: SparkSession) -> int:
    """Partitions that a shuffle begins with."""
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))


def micros(col: str) -> F.Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """imp, usr, t: impressions, those without lines included."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("imp"), F.col("o_custkey").alias("usr"), micros("o_orderdate").alias("t"))


def shown(spark: SparkSession, sf_dir: str, dwell: bool = False) -> DataFrame:
    """imp, usr, t, art, label, pos: candidates in place order (from 1). Line numbers repeat, so all columns order them.
    dwell: the line's quantity as the time for which the article was read, unknown where there is no tax."""
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*cols)))
    lines = lines.select(F.col("l_orderkey").alias("imp"), F.col("l_partkey").alias("art"), (F.col("l_returnflag") == "R").cast("int").alias("label"), "pos", *([F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("dwell")] * dwell))
    return lines.join(orders(spark, sf_dir), "imp")


def split_of(df: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Adds split. The later period is test; of the earlier, the last part of its time span is val. The cutoff is one value, computed first, of log (t; df if there is none):
    the orders, which need no join."""
    from ..operators.split import val_cutoff

    cut = val_cutoff((df if log is None else log).where(F.col("t") < DEV_FROM), VAL_FRACTION)
    return df.withColumn("split", F.when(F.col("t") >= DEV_FROM, "test").when(F.col("t") >= cut, "val").otherwise("train"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usr, t, imp, pos, art, dwell of all clicks."""
    return shown(spark, sf_dir, dwell=True).where("label = 1").select("usr", "t", "imp", "pos", "art", "dwell")


def histories(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """imp, usr, t, history: the user's clicks before t, oldest first, as (t, imp, pos, art, dwell); of all impressions or those of `of`. log: what `shown` has, with dwell, if it is stored."""
    own = (clicks(spark, sf_dir) if log is None else log.where("label = 1")).groupBy("usr").agg(F.sort_array(F.collect_list(F.struct("t", "imp", "pos", "art", "dwell"))).alias("all"))
    both = (orders(spark, sf_dir) if of is None else of).join(own, "usr", "left")
    none = F.array().cast("array<struct<t:bigint,imp:bigint,pos:int,art:bigint,dwell:double>>")
    return both.select("imp", "usr", "t", F.coalesce(F.filter("all", lambda x: x["t"] < F.col("t")), none).alias("history"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, usr, t, kind, value, art."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("usr"), micros("ts").alias("t"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("art"))


def displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, t, art, click: a clicked item was displayed."""
    return events(spark, sf_dir).where(F.col("kind").isin("view", "click")).select("event_id", "t", "art", (F.col("kind") == "click").cast("int").alias("click"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """art, title, abstract, category."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("art"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), F.col("p_brand").alias("category"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec, e: vectors of unit length. Article a has vector a mod their number."""
    from ..functions.vectors import normalised

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec"), normalised(F.col("embedding")).alias("e"))


#: The same in DuckDB's SQL, as common table expressions.
SQL = {
    "orders": "ord as (select o_orderkey imp, o_custkey usr, epoch_us(o_orderdate) t from orders)",
    "shown": "shown as (select imp, usr, t, l_partkey art, cast(l_returnflag = 'R' as int) label, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as int) pos, case when l_tax > 0 then l_quantity end dwell from lineitem join ord on l_orderkey = imp)",
    "cut": f"cut as (select cast(floor(min(t) + (max(t) - min(t)) * {1 - VAL_FRACTION}) as bigint) c from ord where t < {DEV_FROM})",
    "split": f"sp as (select *, case when t >= {DEV_FROM} then 'test' when t >= (select c from cut) then 'val' else 'train' end split from shown)",
    "osplit": f"osp as (select *, case when t >= {DEV_FROM} then 'test' when t >= (select c from cut) then 'val' else 'train' end split from ord)",
    "history": "hist as (select o.imp, o.usr, o.t, s.t ct, s.imp cimp, s.pos cpos, s.art, s.dwell, row_number() over (partition by o.imp order by s.t, s.imp, s.pos, s.art) i, count(*) over (partition by o.imp) n from ord o join shown s on o.usr = s.usr and s.label = 1 and s.t < o.t)",
    "events": "ev as (select event_id, user_id usr, epoch_us(ts) t, event_type kind, value, cast(json_extract_string(props, '$.k') as bigint) art from events)",
    "displays": "dis as (select event_id, t, art, cast(kind = 'click' as int) click from ev where kind in ('view', 'click'))",
    "vectors": "vec as (select vec_id vec, [x / case when s = 0 then 1 else s end for x in e] e from (select *, sqrt(list_sum([x * x for x in e])) s from (select vec_id, [cast(x as double) for x in embedding] e from embeddings)))",
}


def ctes(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)
