"""Small files of a lake: its commit log. Local paths use the operating system, other schemes the session's Hadoop file
systems, so that a lake can live wherever Spark reads and writes."""

from __future__ import annotations

import os
import re
import shutil
import uuid

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.local = re.sub(r"^file:/+", "/", self.root) if re.match(r"file:/|/", self.root) else None

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put_new(self, name: str, data: bytes) -> bool:
        """Writes a file unless it exists; of several writers exactly one succeeds."""
        if self.local:
            path = f"{self.local}/{name}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{os.getpid()}.{id(data)}.part"
            with open(part, "wb") as f:
                f.write(data)
            try:
                os.link(part, path)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
        where, fs = self._fs(f"{self.root}/{name}")
        part = f"{self.root}/{name}.{uuid.uuid4().hex}.part"
        self._write(part, data)
        try:
            self._rename(part, where)
            return True
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e) or fs.exists(where):
                return False
            raise
        finally:
            fs.delete(self._fs(part)[0], False)

    def _write(self, path: str, data: bytes) -> None:
        where, fs = self._fs(path)
        out = fs.create(where, False)
        out.write(bytearray(data))
        out.close()

    def _rename(self, part: str, where) -> None:
        """Gives a whole file its name, which must be free: readers see all of it or nothing."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(jvm.org.apache.hadoop.fs.Path(part), where, none)

    def read(self, name: str) -> bytes:
        if self.local:
            with open(f"{self.local}/{name}", "rb") as f:
                return f.read()
        where, fs = self._fs(f"{self.root}/{name}")
        stream = fs.open(where)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if self.local:
            path = f"{self.local}/{folder}"
            return sorted(os.listdir(path)) if os.path.isdir(path) else []
        where, fs = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def files(self, folder: str) -> list[tuple[str, int, int]]:
        """(path relative to the root, bytes, microseconds of its last change) of all Parquet files below a folder."""
        if self.local:
            found = [os.path.join(d, x) for d, _, names in os.walk(f"{self.local}/{folder}") for x in names if x.endswith(".parquet")]
            return sorted((os.path.relpath(x, self.local), os.path.getsize(x), os.stat(x).st_mtime_ns // 1000) for x in found)
        where, fs = self._fs(f"{self.root}/{folder}")
        if not fs.exists(where):
            return []
        it, out, top = fs.listFiles(where, True), [], self._fs(self.root)[1].makeQualified(self._fs(self.root)[0]).toUri().getPath()
        while it.hasNext():
            s = it.next()
            if s.getPath().getName().endswith(".parquet"):
                out.append((s.getPath().toUri().getPath()[len(top) :].lstrip("/"), s.getLen(), s.getModificationTime() * 1000))
        return sorted(out)

    def delete(self, name: str) -> None:
        if self.local:
            path = f"{self.local}/{name}"
            if os.path.isdir(path):
                shutil.rmtree(path)
            elif os.path.exists(path):
                os.unlink(path)
            return
        where, fs = self._fs(f"{self.root}/{name}")
        fs.delete(where, True)

    def copy_to(self, folder: str) -> None:
        """Copies the whole lake to a new folder, on the same file system or another."""
        other = Store(self.spark, folder)
        if self.local and other.local:
            shutil.copytree(self.local, other.local)
            return
        (source, fs), (target, there) = self._fs(self.root), self._fs(other.root)
        if there.exists(target):
            raise FileExistsError(folder)
        if not self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, there, target, False, self.spark._jsc.hadoopConfiguration()):
            raise OSError(f"{self.root} was not copied to {folder}")
