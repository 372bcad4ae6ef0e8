"""Documents as files with names of their own: a data source to write with, and the layout around it.

``write_documents`` cuts documents that are too large for one file, brings the rows of each file together in order and hands them to
the ``named_files`` format. Tasks stage files next to the target: a file is written under a name of its task attempt and moved to its
staged name when it is whole, so a lost or repeated attempt leaves a whole file or none. The commit moves the staged folder to the
target, once, whatever the number of files; before it nothing is to be seen there, and a failed job takes its staged files away.

The target must be on a file system that all executors reach and that moves folders in one step (a shared folder, HDFS).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a file beyond which a document goes on in a further one.
FILE_BYTES = 256 << 20
READ_BYTES = 16 << 20
_TILES = 1000


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("s3a:"):
        path = "s3:" + path.removeprefix("s3a:")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def checked(path: str | None) -> str:
    """A relative path of plain segments, else an error."""
    parts = path.split("/") if path else [""]
    if any(p in ("", ".", "..") or "\x00" in p for p in parts):
        raise ValueError(f"not a relative file path: {path!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class NamedFilesWriter(DataSourceArrowWriter):
    """Rows of a task are sorted by path, part and ord; the rows of a path are one file, joined by ``separator``."""

    def __init__(self, target: str, overwrite: bool, separator: str):
        self.target, self.overwrite, self.separator = target.rstrip("/"), overwrite, separator.encode()
        folder, _, name = self.target.rpartition("/")
        self.stage = f"{folder}/_{name}-{uuid.uuid4().hex}"
        if not overwrite and self._exists(self.target):
            raise ValueError(f"{target} exists")

    def _exists(self, path: str) -> bool:
        system, inner = file_system(path)
        return system.get_file_info(inner).type != fs.FileType.NotFound

    def write(self, iterator) -> Written:
        system, stage = file_system(self.stage)
        own = f"{stage}/attempts/{TaskContext.get().taskAttemptId()}"
        system.create_dir(own, recursive=True)
        done, folders, out, current, last, size = 0, set(), None, None, None, 0

        def close() -> None:
            nonlocal out, done
            if out is not None:
                out.close()
                place = f"{stage}/files/{current}"
                folder = place.rpartition("/")[0]
                if folder not in folders:
                    system.create_dir(folder, recursive=True)
                    folders.add(folder)
                system.move(f"{own}/file", place)
                out, done = None, done + 1

        for batch in iterator:
            for path, part, ord_, content in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "ord", "content"))):
                at = (checked(path).encode(), part, ord_)
                if last is not None and at <= last:
                    raise ValueError(f"two rows for one place, or out of order: {path!r}, {part}, {ord_}")
                if path != current:
                    close()
                    current, out = path, system.open_output_stream(f"{own}/file")
                else:
                    out.write(self.separator)
                body = (content or "").encode("utf-8", "surrogatepass")
                out.write(body)
                last, size = at, size + len(body)
        close()
        return Written(done, size)

    def commit(self, messages) -> None:
        system, stage = file_system(self.stage)
        target = file_system(self.target)[1]
        system.create_dir(f"{stage}/files", recursive=True)
        if self._exists(self.target):
            system.move(target, f"{stage}/before")
        system.move(f"{stage}/files", target)
        system.delete_dir(stage)

    def abort(self, messages) -> None:
        system, stage = file_system(self.stage)
        if self._exists(self.stage):
            system.delete_dir(stage)


@dataclass
class FileList(InputPartition):
    """Paths below the folder that one task reads."""

    paths: list[str]


class NamedFilesReader(DataSourceReader):
    """All files below a folder, whatever their names, in lists of about ``READ_BYTES``."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def partitions(self) -> list[FileList]:
        system, inner = file_system(self.folder)
        lists, size = [FileList([])], 0
        for info in system.get_file_info(fs.FileSelector(inner, recursive=True)):
            if info.type == fs.FileType.File:
                if size > READ_BYTES:
                    lists.append(FileList([]))
                    size = 0
                lists[-1].paths.append(info.path[len(inner) + 1:])
                size += info.size + READ_BYTES // 10_000
        return lists

    def read(self, partition: FileList):
        system, inner = file_system(self.folder)
        for path in partition.paths:
            with system.open_input_stream(f"{inner}/{path}") as f:
                yield pa.RecordBatch.from_pydict({"path": [path], "content": pa.array([f.read()], pa.binary())})


class NamedFiles(DataSource):
    """``df.write.format("named_files").option("separator", ...).mode(...).save(folder)`` for rows ``path, part, ord, content``;
    ``spark.read.format("named_files").load(folder)`` gives ``path, content``, the latter as bytes."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: StructType) -> NamedFilesReader:
        return NamedFilesReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        missing = {"path", "part", "ord", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")
        return NamedFilesWriter(self.options["path"], overwrite, self.options.get("separator", "\n"))


def in_pieces(rows: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rows of documents that exceed ``file_bytes`` go on under ``name.2.md``, ``name.3.md`` ...; others keep their path.

    Cuts are quantiles of the places in a document (``part``, then ``ord`` below 2**57), an aggregate that merges before the shuffle, so
    a site that owns a third of all rows is many files of many tasks.
    """
    place = (F.col("part").cast("bigint") * F.lit(1 << 57) + F.col("ord")).alias("place")
    size = F.sum(F.octet_length(F.coalesce("content", F.lit(""))) + 1)
    large = rows.groupBy("path").agg(size.alias("size")).where(F.col("size") > file_bytes)
    parts = F.least(F.ceil(F.col("size") / file_bytes), F.lit(_TILES)).cast("int")
    tiles = rows.join(large, "path").groupBy("path").agg(F.percentile_approx(place, [k / _TILES for k in range(1, _TILES)], 100_000).alias("tiles"), F.first("size").alias("size"))
    cuts = tiles.select("path", F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.get("tiles", (k * _TILES / parts).cast("int") - 1)).alias("cuts"))
    number = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda c: c < place)) + 1
    joined = rows.join(cuts, "path", "left").withColumn("number", number)
    path = F.when(F.col("number") == 1, F.col("path")).otherwise(F.concat(
        F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("."), F.col("number").cast("string"), F.regexp_extract("path", r"(\.[^./]*)?$", 0)))
    return joined.select(path.alias("path"), "part", "ord", "content")


def write_files(rows: DataFrame, folder: str, overwrite: bool = False, separator: str = "\n", file_bytes: int = FILE_BYTES) -> None:
    """Write rows ``path, part, ord, content`` as files below ``folder``; rows of one path follow each other by part and ord.

    An existing folder is an error unless ``overwrite`` is set; then it is replaced at the commit. Two rows for one place of a file, null
    paths and paths that leave the folder are errors. Null content is empty. No rows give an empty folder.
    """
    rows.sparkSession.dataSource.register(NamedFiles)
    slim = rows.select(F.col("path").cast("string"), F.col("part").cast("int"), F.col("ord").cast("bigint"), F.col("content").cast("string"))
    cut = in_pieces(slim, file_bytes)
    ordered = cut.repartitionByRange("path").sortWithinPartitions("path", "part", "ord")
    ordered.write.format("named_files").option("separator", separator).mode("overwrite" if overwrite else "append").save(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` (bytes) of the files below ``folder``, paths relative to it; names that Spark's readers hide are read too."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").load(folder)
