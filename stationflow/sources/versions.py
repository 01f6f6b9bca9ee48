"""Small tables that are replaced as a whole, atomically.

Each version is a folder of its own; a numbered marker names the folder of a finished one, and
the highest complete marker is the table. A marker is created only where its number is free:
of two runs that replace the same version one fails, and readers see the old or the new
table, never a part. A run that ends halfway leaves a folder that no marker names (or, within the
few instants of writing one, a marker without a line end, which has to be deleted by hand). The
version before the last stays for those who still read it, older ones are removed.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MARKER = re.compile(r"([0-9]{10})\.version")


class Folder:
    """A folder of the session's file system, seen through Hadoop."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.path = path.rstrip("/")
        self.system = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self.system.exists(self.at("")):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.at("")))

    def folders(self, depth: int) -> list[str]:
        """Folders so many levels below, by their path from here. Hidden ones are left out."""
        found = [""]
        for _ in range(depth):
            found = [f"{above}/{s.getPath().getName()}".lstrip("/") for above in found if self.system.exists(self.at(above))
                     for s in self.system.listStatus(self.at(above))
                     if s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]
        return sorted(found)

    def newest(self, name: str) -> int | None:
        """Time of the newest file of a folder, in milliseconds."""
        times = [s.getModificationTime() for s in self.system.listStatus(self.at(name))
                 if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        return max(times, default=None)

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False where it exists."""
        try:
            stream = self.system.create(self.at(name), False)
        except Py4JJavaError:
            if self.system.exists(self.at(name)):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def move(self, old: str, new: str) -> None:
        """Puts a file in the place of another."""
        self.system.delete(self.at(new), False)
        if not self.system.rename(self.at(old), self.at(new)):
            raise OSError(f"{self.path}/{old} cannot be renamed to {new}")

    def remove(self, name: str) -> None:
        self.system.delete(self.at(name), True)


def _versions(folder: Folder) -> dict[int, str]:
    """Finished versions and their folders. A marker that is just being written has no line end."""
    found = {}
    for name in folder.names():
        if (marker := MARKER.fullmatch(name)) and (text := folder.read(name)).endswith("\n"):
            found[int(marker[1])] = text.strip()
    return found


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the version that readers see; 0 where there is none yet."""
    return max(_versions(Folder(spark, path)), default=0)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table as last replaced; an absent one is empty."""
    versions = _versions(Folder(spark, path))
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{versions[max(versions)]}")


def replace_table(rows: DataFrame, path: str, based_on: int) -> None:
    """Makes ``rows`` the table, in place of version ``based_on``, which they may be read from.

    Fails, and leaves the table as it is, if another version has come in between.
    """
    folder, name = Folder(rows.sparkSession, path), f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder.path}/{name}")
    number = based_on + 1
    if current_version(rows.sparkSession, path) != based_on or not folder.create(f"{number:010d}.version", f"{name}\n"):
        folder.remove(name)
        raise RuntimeError(f"{path} was replaced by another run; read it again")
    for old, data in _versions(folder).items():
        if old < based_on:
            folder.remove(f"{old:010d}.version")
            folder.remove(data)
