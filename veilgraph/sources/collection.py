"""Collections as DataFrames: a directory of JSON files, a ZIP archive or one JSON file.

``read_members`` gives (member, ord, name, raw): members are named member-00001.json on, in path or archive order, and the real
file names go no further. Limits are checked before contents are read where the listing allows it.
"""

from __future__ import annotations

import io
import os
import stat
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_MEMBERS, MAX_MEMBER, MAX_TOTAL = 10_000, 512 << 20, 2 << 30
SIGNATURES = (b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x07\x08")
#: Members that the driver holds at a time.
FEW = 4
MEMBERS = "name string, ord long, raw binary, refused string"


class CollectionError(ValueError):
    """The input can't be read as a collection."""


def looks_like_zip(raw: bytes) -> bool:
    return raw[:4] in SIGNATURES


def unsafe_name(name: str) -> bool:
    """Absolute, with a drive, or climbing out."""
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or (len(name) > 1 and name[1] == ":")


def latest_by_name(rows: DataFrame) -> DataFrame:
    """(name, ord, ...): of repeated names the last row, at the first one's place."""
    rest = [c for c in rows.columns if c not in ("name", "ord")]
    last = F.max_by(F.struct(*rest), "ord") if rest else F.lit(None)
    got = rows.groupBy("name").agg(F.min("ord").alias("ord"), last.alias("_last"))
    return got.select("name", "ord", *[F.col(f"_last.{c}").alias(c) for c in rest])


def over_limits(n, most, total):
    """Whether so many members, with the largest and all together of so many bytes, are refused; numbers or columns."""
    return (n > MAX_MEMBERS) | (most > MAX_MEMBER) | (total > MAX_TOTAL)


def zip_entries(raw: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(name, place, bytes) of an archive's JSON members, one by one; at most the declared size is inflated of each."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except (zipfile.BadZipFile, ValueError, struct.error) as e:
        raise CollectionError("File is not a zip file") from e
    own = [i for i in archive.infolist() if not i.is_dir() and i.filename.lower().endswith(".json")]
    if over_limits(len(own), max((i.file_size for i in own), default=0), sum(i.file_size for i in own)):
        raise CollectionError("archive exceeds the limits on members or sizes")
    if any(unsafe_name(i.filename) for i in own):
        raise CollectionError("archive holds an unsafe member name")
    for k, i in enumerate(own):
        if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise CollectionError("unsupported compression method")
        try:
            with archive.open(i) as f:
                data = f.read(i.file_size + 1)
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError) as e:
            raise CollectionError("archive member can't be read") from e
        if len(data) != i.file_size:
            raise CollectionError("archive member is longer than declared")
        yield i.filename, k, data


def _open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A frame for each member, as together they may be larger than a batch can be; a refused archive's last row says why."""
    from ..operators.flatten import document

    names = [f.split()[0] for f in MEMBERS.split(", ")]
    for batch in batches:
        for raw in batch.content:
            raw = bytes(raw)
            try:
                if not looks_like_zip(raw) and document(raw) is None:
                    raise CollectionError("File is not a zip file")
                for row in zip_entries(raw) if looks_like_zip(raw) else [("bare.json", 0, raw)]:
                    yield pd.DataFrame([(*row, None)], columns=names)
            except CollectionError as e:
                yield pd.DataFrame([(None, None, None, str(e))], columns=names).astype({"ord": "Int64"})


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """Members in order; their number is bounded by MAX_MEMBERS, so one small window ranks them."""
    k = F.row_number().over(Window.orderBy(by))
    return rows.withColumn("ord", k).withColumn("member", F.format_string("member-%05d.json", k))


def linked_folders(root: str) -> list[str]:
    """Folders below a local folder that are links, which aren't followed; a JSON member that isn't a plain file is refused."""
    links = []
    for base, folders, names in os.walk(root):
        links += [os.path.join(base, n) for n in folders if os.path.islink(os.path.join(base, n))]
        own = [os.path.join(base, n) for n in names if n.endswith(".json")] + [n for n in links if n.endswith(".json")]
        if not all(stat.S_ISREG(os.lstat(n).st_mode) for n in own):
            raise CollectionError("directory contains a non-regular JSON member")
    return links


def listing(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Length and time of change of the input, or of each JSON file in it, at most MAX_MEMBERS + 1 of them; contents aren't read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, out = fs.listFiles(where, True), {}
    while files.hasNext() and len(out) <= MAX_MEMBERS:
        f = files.next()
        if f.getPath().getName().endswith(".json") or fs.getFileStatus(where).isFile():
            out[f.getPath().toString()] = (f.getLen(), f.getModificationTime())
    return out


def check_unchanged(spark: SparkSession, path: str, before: dict[str, tuple[int, int]]) -> None:
    """Members are read more than once in a run, so one that changes meanwhile is refused."""
    if listing(spark, path) != before:
        raise CollectionError("input changed during the run")


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(member, ord, name, raw) of a directory, a ZIP archive or a JSON file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        raise CollectionError("input does not exist")
    if fs.getFileStatus(where).isDirectory():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
        for link in linked_folders(where.toUri().getPath()) if fs.getScheme() == "file" else []:
            files = files.where(~F.regexp_replace("path", r"\Afile:/+", "/").startswith(f"{link}/"))
        sizes = files.select("length").agg(F.count("*").alias("n"), F.max("length").alias("most"), F.sum("length").alias("total")).first()
        if not sizes.n:
            raise CollectionError("no JSON members")
        if over_limits(sizes.n, sizes.most, sizes.total):
            raise CollectionError("directory exceeds the limits on members or sizes")
        names = numbered(files.select("path"), "path")
        return files.join(F.broadcast(names), "path").select("member", "ord", F.col("path").alias("name"), F.col("content").alias("raw"))
    if not fs.getFileStatus(where).getLen():
        raise CollectionError("File is not a zip file")
    opened = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_open, MEMBERS)
    refused = opened.where("refused is not null").select("refused").first()
    if refused:
        raise CollectionError(refused.refused)
    last = latest_by_name(opened.drop("refused"))
    return last.join(F.broadcast(numbered(last.select("name", "ord"), "ord").select("name", "member")), "name").select("member", "ord", "name", "raw")


def in_turn(rows: DataFrame, by: str, n: int) -> Iterator:
    """n members or texts of members in order, of which the driver holds about FEW at a time: partitions by size alone are large where texts compress well."""
    parts = max(1, min(n // FEW, 1000))
    return rows.repartitionByRange(parts, by).sortWithinPartitions(by).toLocalIterator()


def input_hash(members: DataFrame) -> str:
    """SHA-256 over the members' bytes in order."""
    import hashlib

    own = hashlib.sha256()
    for r in in_turn(members.select("ord", "raw"), "ord", members.count()):
        own.update(bytes(r.raw))
    return own.hexdigest()


def source_hash(spark: SparkSession, path: str, members: DataFrame) -> str:
    """SHA-256 of a file's own bytes, be it an archive or JSON; of a directory that of its members."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return input_hash(members)
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first().h
