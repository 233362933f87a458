"""Few file operations that the log needs, on the local file system or any other through Hadoop.

write_new() creates a file with its whole content or not at all, and never replaces one: the base of
atomic commits. Locally a finished temporary file is linked to its name; elsewhere it is renamed by
a call that fails if the name is taken. That call must be atomic, as it is on HDFS; most object stores
do not offer it, so a store with several writers can't live on one.
"""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import SparkSession

from ..errors import StoreIOError


class LocalFiles:
    def __init__(self, root: str):
        self.root = root.removeprefix("file://")

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def spark_path(self, name: str) -> str:
        return "file://" + os.path.abspath(self.path(name))

    def make(self, name: str) -> None:
        os.makedirs(self.path(name), exist_ok=True)

    def write_new(self, name: str, data: bytes) -> bool:
        spare = self.path(f"{os.path.dirname(name)}/.{uuid.uuid4().hex}.tmp")
        try:
            with open(spare, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(spare, self.path(name))
            except FileExistsError:
                return False
            folder = os.open(os.path.dirname(spare), os.O_RDONLY)
            try:
                os.fsync(folder)  # the name lasts as the content does
            finally:
                os.close(folder)
            return True
        except OSError as e:
            raise StoreIOError(str(e)) from e
        finally:
            if os.path.exists(spare):
                os.remove(spare)

    def read(self, name: str) -> bytes:
        with open(self.path(name), "rb") as f:
            return f.read()

    def list(self, name: str) -> list[str]:
        """Names of the files below a folder, relative to it."""
        top = self.path(name)
        return sorted(os.path.relpath(os.path.join(d, f), top) for d, _, fs in os.walk(top) for f in fs)

    def exists(self, name: str) -> bool:
        return os.path.exists(self.path(name))

    def size(self, name: str) -> int:
        return os.path.getsize(self.path(name))

    def delete(self, name: str) -> None:
        if os.path.isdir(self.path(name)):
            shutil.rmtree(self.path(name))
        elif os.path.exists(self.path(name)):
            os.remove(self.path(name))

    def copy_in(self, source: str, name: str, move: bool = False) -> None:
        source = source.removeprefix("file://")
        os.makedirs(os.path.dirname(self.path(name)), exist_ok=True)
        if move:
            shutil.move(source, self.path(name))
            return
        try:
            os.link(source, self.path(name))
        except OSError:
            shutil.copyfile(source, self.path(name))


class HadoopFiles:
    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root.rstrip("/"), spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._p("").getFileSystem(self._conf)

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    spark_path = path

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._p(name))

    def write_new(self, name: str, data: bytes) -> bool:
        hadoop = self._jvm.org.apache.hadoop.fs
        spare = self._p(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(spare)
        out.write(bytearray(data))
        out.hsync()
        out.close()
        context = hadoop.FileContext.getFileContext(spare.toUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(hadoop.Options.Rename.NONE.getClass(), 1)
        none[0] = hadoop.Options.Rename.NONE
        try:
            context.rename(spare, self._p(name), none)
            return True
        except Exception as e:
            self._fs.delete(spare, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise StoreIOError(str(e)) from e

    def read(self, name: str) -> bytes:
        try:
            stream = self._fs.open(self._p(name))
        except Exception as e:
            raise FileNotFoundError(name) from e
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def list(self, name: str) -> list[str]:
        top = self._p(name)
        if not self._fs.exists(top):
            return []
        base, out, files = len(self._fs.makeQualified(top).toString()) + 1, [], self._fs.listFiles(top, True)
        while files.hasNext():
            out.append(self._fs.makeQualified(files.next().getPath()).toString()[base:])
        return sorted(out)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def size(self, name: str) -> int:
        return self._fs.getFileStatus(self._p(name)).getLen()

    def delete(self, name: str) -> None:
        self._fs.delete(self._p(name), True)

    def copy_in(self, source: str, name: str, move: bool = False) -> None:
        given = self._jvm.org.apache.hadoop.fs.Path(source)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(given.getFileSystem(self._conf), given, self._fs, self._p(name), move, self._conf)


def files_at(spark: SparkSession, root: str) -> LocalFiles | HadoopFiles:
    return HadoopFiles(spark, root) if "://" in root and not root.startswith("file://") else LocalFiles(root)
