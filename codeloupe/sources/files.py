"""Small files and folders of a store, by the Hadoop file system that its path names.

A path without a scheme is one of the cluster's default file system, which all executors share.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.system = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """The names in a folder; none if there is no such folder."""
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str, draft: str) -> None:
        """Writes a file so that readers see the old text or the new one, by way of ``draft`` in the same folder."""
        out = self.system.create(self.path(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        overwrite = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf).rename(self.path(draft), self.path(name), overwrite)

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)
