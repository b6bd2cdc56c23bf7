"""A small file that is replaced in one step, in any file system that Spark's Hadoop client reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Pointer:
    """The file is written beside its place and renamed over it, so a reader finds the old text or the new one."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.path = self._path(path)
        self.fs = self.path.getFileSystem(self.conf)
        self.path = self.fs.makeQualified(self.path)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def read(self) -> str | None:
        """The text, or nothing where none has been written."""
        if not self.fs.exists(self.path):
            return None
        stream = self.fs.open(self.path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str) -> None:
        beside = self._path(self.path.toString() + ".new")
        stream = self.fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # the option's class lies inside another one, so it is asked for by its full name
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.conf).rename(beside, self.path, over)
