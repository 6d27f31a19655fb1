"""Small files in a shared folder, written by the driver: what of a batch is done, and tables of versions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Folder:
    """A folder of any file system that Spark can write to."""

    spark: SparkSession
    root: str

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def write(self, name: str, text: str = "") -> None:
        """Replaces the file; it appears under its name only when it is whole."""
        fs, path = self._at(name)
        _, part = self._at(f"{name}.part")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(path, False)
        if not fs.rename(part, path):
            raise OSError(f"cannot write {path.toString()}")

    def read(self, name: str) -> str | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        data = fs.open(path)
        try:
            return bytes(data.readAllBytes()).decode()
        finally:
            data.close()

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)


class CommitLog:
    """Which outputs of one micro-batch are written: one empty file each.

    An output is written under its batch id and then marked. A replay leaves marked ones
    alone, so each is written once to the end, however often another one fails.
    """

    def __init__(self, spark: SparkSession, root: str, batch_id: int):
        self.folder = Folder(spark, f"{root}/batch={batch_id}")

    def has(self, name: str) -> bool:
        return self.folder.exists(name)

    def put(self, name: str) -> None:
        self.folder.write(name)
