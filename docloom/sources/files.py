"""Files of a bucket through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def parts(self, folder: str) -> list[str]:
        """Data files of a written folder, relative to the root."""
        return [f"{folder}/{n}" for n in self.names(folder) if n.endswith(".parquet") and not n.startswith(("_", "."))]

    def size(self, name: str) -> int:
        return self._fs.getFileStatus(self._path(name)).getLen()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that must not exist; False where it does."""
        self._fs.mkdirs(self._path(name).getParent())
        whole = self._path(f"{name}.{self._jvm.java.util.UUID.randomUUID()}.tmp")
        stream = self._fs.create(whole, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # the claim decides between writers, the rename makes the whole content appear at once
        try:
            self._fs.create(self._path(f"{name}.claim"), False).close()
        except Exception:  # noqa: BLE001 - Java's FileAlreadyExistsException comes as a Py4J error
            self._fs.delete(whole, False)
            return False
        if not self._fs.rename(whole, self._path(name)):
            self._fs.delete(whole, False)
            return False
        return True

    def move(self, name: str, to: str) -> None:
        self._fs.mkdirs(self._path(to).getParent())
        if not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"{name} can't be moved to {to}")

    def copy_from(self, other: Files, name: str) -> None:
        self._fs.mkdirs(self._path(name).getParent())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(other._fs, other._path(name), self._fs, self._path(name), False, True, self._conf)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Unset, local sessions get a temporary one; on a cluster that's an error."""
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{key} names no folder: executors would each write to a disk of their own")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set(key, root)
    return root.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A folder for a bucket that nobody named, in the shared one."""
    return f"{shared_root(spark)}/docloom-buckets/{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
