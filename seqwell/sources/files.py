"""Small files in any folder that Spark can reach, by its Hadoop file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        at = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = at.getFileSystem(self.conf)
        # with its scheme, so that every part of Spark means the same folder
        self.path = self.fs.makeQualified(at).toString()

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._at(name))

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def has(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def put(self, name: str, text: str) -> None:
        """Writes a file, also over one that is there."""
        stream = self.fs.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Writes a file unless one of that name exists; whole or not at all. Whether it did."""
        temporary = f"_tmp-{self.jvm.java.util.UUID.randomUUID().toString()}"
        stream = self.fs.create(self._at(temporary), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fc = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            fc.rename(self._at(temporary), self._at(name), options)  # without OVERWRITE
        except Exception as e:
            self.fs.delete(self._at(temporary), False)
            if self.fs.exists(self._at(name)):
                return False
            raise e
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
