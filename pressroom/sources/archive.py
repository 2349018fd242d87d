"""A zip archive with one member, deflated by many tasks.

The member's lines are cut into ranges. A task deflates its range by itself and ends it with a full flush: such pieces, laid end to end,
are one deflate stream, and each can be inflated without those before it. Their checksums combine by length. Pieces are written
where Spark writes; the driver writes headers and directory, and has the store's streams copy the pieces in between: no line passes
through it. The archive's comment fills it up to a multiple of RECORD bytes, so that it is read in records, by many tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the records by which archives are read.
RECORD = 1 << 15
#: The end of a deflate stream (an empty last block), the CRC-32's polynomial, the date that a zip can't go below.
_END, _POLY, _DATE = b"\x03\x00", 0xEDB88320, 0x21
PIECE = "part int, raw binary, crc long, size long, lines long"


def hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo the CRC's, bits reversed."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


def crc_combine(first: int, second: int, size: int) -> int:
    """The CRC-32 of two texts one behind the other; size: bytes of the second."""
    shift, power, n = 1 << 31, 1 << 23, size  # 1, and x^8
    while n:
        if n & 1:
            shift = _times(shift, power)
        power, n = _times(power, power), n >> 1
    return _times(first, shift) ^ second


def _deflated(group: pa.Table) -> pa.Table:
    rows = group.sort_by([("impression_id", "ascending")])
    z, out, crc, size = zlib.compressobj(6, zlib.DEFLATED, -15), [], 0, 0
    for b in rows.select(["value"]).to_batches():
        text = "".join(f"{x}\n" for x in b.column(0).to_pylist()).encode()
        crc, size = zlib.crc32(text, crc), size + len(text)
        out.append(z.compress(text))
    out.append(z.flush(zlib.Z_FULL_FLUSH))
    return pa.table({"part": pa.array([rows["part"][0].as_py()], pa.int32()), "raw": pa.array([b"".join(out)], pa.binary()), "crc": [crc], "size": [size], "lines": [len(rows)]})


def deflated(lines: DataFrame) -> DataFrame:
    """lines: part, impression_id, value. A row a part, which fits into a task: its lines in order, deflated."""
    return lines.groupBy("part").applyInArrow(_deflated, PIECE)


def write_pieces(pieces: DataFrame, path: str) -> None:
    """A file a part, which holds its bytes and one more: the text writer puts down strings as they are, and a line's end after each."""
    pieces.select("part", F.col("raw").cast("string").alias("value")).repartition("part").write.mode("overwrite").partitionBy("part").text(path)


def _headers(name: str, crc: int, packed: int, size: int) -> tuple[bytes, bytes]:
    """What stands before the member's stream and after it, in the 64-bit form of a zip archive."""
    raw, most, much = name.encode(), 0xFFFF, 0xFFFFFFFF
    extra = struct.pack("<HHQQ", 1, 16, size, packed)
    common = struct.pack("<HHHHHIIIHH", 45, 0x800, 8, 0, _DATE, crc, much, much, len(raw), len(extra))
    local = b"PK\x03\x04" + common + raw + extra
    at = len(local) + packed
    entry = b"PK\x01\x02" + struct.pack("<H", 45) + common + struct.pack("<HHHII", 0, 0, 0, 0, 0) + raw + extra
    last = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(entry), 1)
    end = len(entry) + len(last) + len(locator) + 22
    fill = -(at + end) % RECORD
    return local, entry + last + locator + b"PK\x05\x06" + struct.pack("<HHHHIIH", most, most, most, most, much, much, fill) + b" " * fill


def assemble(spark: SparkSession, pieces: list[tuple[str, int, int, int]], out: str, name: str) -> None:
    """pieces: file of the piece, its bytes, checksum and bytes inflated, in order."""
    crc, size, packed = 0, 0, len(_END)
    for _, own, c, n in pieces:
        crc, size, packed = crc_combine(crc, c, n), size + n, packed + own
    before, after = _headers(name, crc, packed, size)
    fs, target = hadoop(spark, out)
    stream = fs.create(target, True)
    stream.write(bytearray(before))
    for path, own, _, _ in pieces:
        source = hadoop(spark, path)
        read = source[0].open(source[1])
        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(read, stream, 0, own)
        read.close()
    stream.write(bytearray(_END + after))
    stream.close()


def lines_of(spark: SparkSession, path: str, pieces: list[tuple[int, int, int]]) -> DataFrame:
    """line (from 0) and value of an archive's member. pieces: first byte in the archive, bytes, lines before it. The archive is read in records, which go to the pieces
    that they belong to; each piece is inflated by itself."""
    starts = sorted(pieces)

    def records(split: int, rows: Iterator[bytes]) -> Iterator[tuple[int, int, bytes]]:
        yield from ((split, k, bytes(r)) for k, r in enumerate(rows))

    raw = spark.createDataFrame(spark.sparkContext.binaryRecords(path, RECORD).mapPartitionsWithIndex(records), "split int, k long, raw binary")
    sizes = dict(raw.groupBy("split").count().collect())  # a row a split
    base, n = {}, 0
    for s in sorted(sizes):
        base[s], n = n, n + sizes[s]
    known = spark.createDataFrame([(p, a, size, before) for p, (a, size, before) in enumerate(starts) if size], "piece int, begin long, bytes long, before long")
    cover = known.withColumn("record", F.explode(F.sequence(F.floor(F.col("begin") / RECORD), F.floor((F.col("begin") + F.col("bytes") - 1) / RECORD))))
    first = F.create_map(*(F.lit(x) for kv in base.items() for x in kv))
    both = raw.select((first[F.col("split")] + F.col("k")).alias("record"), "raw").join(F.broadcast(cover), "record")

    def inflate(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("record", "ascending")])
        begin, size, before = (rows[c][0].as_py() for c in ("begin", "bytes", "before"))
        at = begin - rows["record"][0].as_py() * RECORD
        text = zlib.decompressobj(-15).decompress(b"".join(rows["raw"].to_pylist())[at : at + size]).decode()
        own = text.split("\n")[:-1]
        return pa.table({"line": pa.array(range(before, before + len(own)), pa.int64()), "value": pa.array(own, pa.string())})

    return both.groupBy("piece").applyInArrow(inflate, "line long, value string")
