"""Small files and folders on the file system that Spark uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """A folder with read, write, list and delete, wherever it lies."""

    def __init__(self, spark: SparkSession, folder: str):
        rest = folder.partition("://")[2] or folder
        if len(rest) < 3 or ".." in rest.split("/") or "//" in rest.lstrip("/"):
            raise ValueError(f"not a usable folder: {folder!r}")
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str = "") -> str:
        return f"{self.folder}/{name}" if name else self.folder

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(self.at(name))))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write beside and rename over what was there, so that a reader meets the old file or the new one.

        On file systems that rename over a file in one step, as HDFS does, there is no moment without either.
        """
        part, target = self._path(self.at(f"{name}.part")), self._path(self.at(name))
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(part), self._fs.makeQualified(target), options)

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self._path(self.at(name)), True)

    def writable(self) -> bool:
        """Whether a file can be written and removed here."""
        try:
            self.write(".probe", "")
            return self.delete(".probe")
        except Exception:  # noqa: BLE001 - any failure of the file system means no
            return False
