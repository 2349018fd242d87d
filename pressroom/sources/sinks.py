"""Sinks: partitioned tables, ranked text files, reports."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive
from .shared import stored

#: The file inside a submission's archive.
INNER = {"mind": "prediction.txt", "ebnerd": "predictions.txt"}


def write_table(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def ranked_lines(ranked: DataFrame, *keep: str) -> DataFrame:
    """impression_id, ranks to lines "<impression> [r1,r2,...]"; keep: columns to stay beside them."""
    line = F.concat(F.col("impression_id").cast("string"), F.lit(" ["), F.array_join(F.col("ranks").cast("array<string>"), ","), F.lit("]"))
    return ranked.select(*keep, line.alias("value"))


def write_submission(ranked: DataFrame, folder: str, dataset: str, parts: int = 64, group: int = 16, stop_after: int | None = None) -> str:
    """Writes the lines, in the order of impression_id, into a zip archive in folder (archive.py).

    The lines are stored first, once, with the range of ids that they fall in; then ranges are deflated, `group` of them a job, each job with a marker. A run that
    was stopped is taken up by another call, which leaves out what has its marker. stop_after: deflate so many ranges and stop, as a lost driver would."""
    spark = ranked.sparkSession
    done = lambda path: archive.hadoop(spark, f"{path}/_SUCCESS")[0].exists(archive.hadoop(spark, f"{path}/_SUCCESS")[1])
    if not done(f"{folder}/lines"):
        own = stored(ranked.select("impression_id", "ranks"))
        cuts = own.agg(F.percentile_approx(F.col("impression_id").cast("long"), [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
        edges = F.array(*map(F.lit, sorted(set(cuts or [])))).cast("array<long>")
        lines = ranked_lines(own, "impression_id").withColumn("part", F.size(F.filter(edges, lambda x: x < F.col("impression_id"))))
        lines.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/lines")
    lines = spark.read.schema("impression_id long, value string, part int").parquet(f"{folder}/lines")
    for k in range(0, parts, group):
        if done(f"{folder}/deflated/{k:05d}"):
            continue
        if stop_after is not None and k >= stop_after:
            return ""
        own = lines.where(F.col("part").between(k, k + group - 1))
        archive.deflated(own).write.mode("overwrite").parquet(f"{folder}/deflated/{k:05d}")
    pieces = spark.read.schema(archive.PIECE).parquet(f"{folder}/deflated/*")
    archive.write_pieces(pieces, f"{folder}/pieces")
    fs, _ = archive.hadoop(spark, folder)
    found = []
    for r in _meta(spark, folder):
        path = archive.hadoop(spark, f"{folder}/pieces/part={r['part']}")[1]
        name = next(f.getPath().toString() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-"))
        found.append((name, r["bytes"], r["crc"], r["size"]))
    out = f"{folder}/{dataset}.zip"
    archive.assemble(spark, found, out, INNER[dataset])
    return out


def _meta(spark: SparkSession, folder: str) -> list:
    """part, bytes, crc, size, lines of each piece, in order: a row a range."""
    pieces = spark.read.schema(archive.PIECE).parquet(f"{folder}/deflated/*")
    return pieces.select("part", F.octet_length("raw").alias("bytes"), "crc", "size", "lines").orderBy("part").collect()


def archive_lines(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """line (from 0) and value of the member of an archive that write_submission wrote, read in records by many tasks."""
    at, before, pieces = 30 + len(INNER[dataset]) + 20, 0, []
    for r in _meta(spark, path.rsplit("/", 1)[0]):
        pieces.append((at, r["bytes"], before))
        at, before = at + r["bytes"], before + r["lines"]
    return archive.lines_of(spark, path, pieces)


def verify_archive(spark: SparkSession, path: str, dataset: str, rows: int) -> None:
    """One member of the right name, and as many lines as impressions, all of them lines of ranks; from any store."""
    with zipfile.ZipFile(_Source(*archive.hadoop(spark, path))) as z:
        if z.namelist() != [INNER[dataset]]:
            raise ValueError(f"members {z.namelist()}")
    got = archive_lines(spark, path, dataset).agg(F.count("*"), F.sum(F.col("value").rlike(r"^\S+ \[(\d+(,\d+)*)?\]$").cast("long"))).first()
    if got[0] != rows or (got[1] or 0) != rows:
        raise ValueError(f"{got[0]} lines, {got[1]} of them well formed, for {rows} impressions")


class _Source:
    """A file in any store, for zipfile, which reads headers and directory only."""

    def __init__(self, fs, path):
        self.stream, self.size, self.at = fs.open(path), fs.getFileStatus(path).getLen(), 0

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, at: int, whence: int = 0) -> int:
        self.at = at + {0: 0, 1: self.at, 2: self.size}[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = min(n if n >= 0 else self.size, self.size - self.at)
        self.stream.seek(self.at)
        out = bytes(self.stream.readNBytes(n))
        self.at += len(out)
        return out

    def close(self) -> None:
        self.stream.close()


def bad_ranks(ranked: DataFrame) -> DataFrame:
    """Rows whose ranks aren't a permutation of 1 to their number: every row is looked at."""
    return ranked.where(F.sort_array("ranks") != F.when(F.size("ranks") > 0, F.sequence(F.lit(1), F.size("ranks"))).otherwise(F.array().cast("array<int>")))


def report(df: DataFrame, path: str) -> None:
    """A result as JSON lines and as CSV, whole, to folders in any store; arrays and structs are JSON in the CSV."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    df = stored(df)
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}.json")
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", "true").csv(f"{path}.csv")
