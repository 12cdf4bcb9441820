"""Where datasets live, and listing and deleting there through Hadoop's file system."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class DatasetNotFound(LookupError):
    pass


@dataclass(frozen=True)
class DatasetId:
    bucket: str
    model: str
    version: str

    @property
    def path(self) -> str:
        return f"{self.bucket}/{self.model}/{self.version}"

    def __post_init__(self):
        for part in (self.bucket, self.model, self.version):
            if not part or "/" in part or part in (".", ".."):
                raise ValueError(f"not a name: {part!r}")


class Files:
    """A root folder on any file system Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def full(self, rel: str) -> str:
        return f"{self.root}/{rel}"

    def exists(self, rel: str) -> bool:
        return self._fs.exists(self._path(rel))

    def ensure(self, rel: str) -> None:
        self._fs.mkdirs(self._path(rel))

    def prefixes(self, rel: str = "") -> list[str]:
        """Names of the folders directly below."""
        p = self._path(rel)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.isDirectory()) if self._fs.exists(p) else []

    def names(self, rel: str) -> list[str]:
        """Names of the files directly in a folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(rel)) if s.isFile())

    def rename(self, rel: str, to: str) -> None:
        if not self._fs.rename(self._path(rel), self._path(to)):
            raise OSError(f"cannot rename {rel}")

    def listing(self, rel: str) -> list[tuple[str, int]]:
        """(path, length) of all files below."""
        out, p = [], self._path(rel)
        if self._fs.exists(p):
            it = self._fs.listFiles(p, True)
            while it.hasNext():
                s = it.next()
                out.append((s.getPath().toString(), s.getLen()))
        return out

    def delete(self, rel: str) -> int:
        """Deletes everything below; the number of files deleted."""
        n = len(self.listing(rel))
        self._fs.delete(self._path(rel), True)
        return n

    def replace(self, rel: str, staged: str) -> None:
        """Puts the staged folder in the place of another; the old one goes only when the new one is complete."""
        old = f"{rel}.replaced"
        if self.exists(rel):
            self._fs.rename(self._path(rel), self._path(old))
        self._fs.mkdirs(self._path(rel).getParent())
        if not self._fs.rename(self._path(staged), self._path(rel)):
            if self.exists(old):
                self._fs.rename(self._path(old), self._path(rel))
            raise OSError(f"cannot replace {rel}")
        self._fs.delete(self._path(old), True)

    def dump(self, rel: str, target: str) -> int:
        """Copies everything below to a folder of any file system, names kept; the number of files."""
        conf = self.spark._jsc.hadoopConfiguration()
        to = self._jvm.org.apache.hadoop.fs.Path(target)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(rel), to.getFileSystem(conf), to, False, conf)
        return len(self.listing(rel))


def part_of(path: Column, i: int) -> Column:
    """The i-th component (from 1) of a key such as bucket/model/version/file."""
    return F.split_part(path, F.lit("/"), F.lit(i))


def next_component(paths: DataFrame, column: str, prefix: str) -> DataFrame:
    """(component): the different names that follow a prefix."""
    rest = F.substring(F.col(column), F.lit(len(prefix) + 1), F.length(column))
    return paths.where(F.col(column).startswith(prefix)).select(part_of(rest, 1).alias("component")).distinct()


def file_counts(df: DataFrame) -> DataFrame:
    """(file, n): rows of each file behind `df`; no data column is read."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
