"""Small files of the driver's, on any file system that the session knows."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def is_local(path: str) -> bool:
    """A bare path: a POSIX mount, read without Hadoop."""
    return "://" not in path and not path.startswith("file:")


class Files:
    """Reading, listing and publishing by the session's Hadoop file systems; bare paths by POSIX calls."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _of(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def qualified(self, path: str) -> str:
        """A path as Spark's file sources write it."""
        fs, target = self._of(path)
        return fs.makeQualified(target).toString()

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if it is absent."""
        if is_local(folder):
            return sorted(os.listdir(folder)) if os.path.isdir(folder) else []
        fs, target = self._of(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def size(self, path: str) -> int | None:
        """Bytes of the files below a folder, hidden ones left out; None if it is absent."""
        if is_local(path):
            if not os.path.isdir(path):
                return None
            return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if not n.startswith((".", "_")))
        fs, target = self._of(path)
        if not fs.exists(target):
            return None
        total, found = 0, fs.listFiles(target, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith((".", "_")):
                total += f.getLen()
        return total

    def exists(self, path: str) -> bool:
        if is_local(path):
            return os.path.exists(path)
        fs, target = self._of(path)
        return fs.exists(target)

    def read(self, path: str) -> str | None:
        """The text of a file; None if it is absent."""
        if is_local(path):
            try:
                with open(path, encoding="utf-8") as f:
                    return f.read()
            except FileNotFoundError:
                return None
        fs, target = self._of(path)
        if not fs.exists(target):
            return None
        stream = fs.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write a file; on a POSIX mount readers see the old or the new one."""
        if not is_local(path):
            return self._create(path, text, True)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        fd, draft = tempfile.mkstemp(dir=os.path.dirname(path))
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(draft, path)

    def create(self, path: str, text: str) -> bool:
        """Write a file unless there is one: of several writers, one gets True."""
        if not is_local(path):
            try:
                self._create(path, text, False)
            except Exception as e:
                if self.exists(path):
                    return False
                raise OSError(f"can't write {path}") from e
            return True
        os.makedirs(os.path.dirname(path), exist_ok=True)
        fd, draft = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".draft-")
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, path)  # unlike a rename, this fails if the name is taken
        except FileExistsError:
            return False
        finally:
            os.remove(draft)
        return True

    def _create(self, path: str, text: str, overwrite: bool) -> None:
        fs, target = self._of(path)
        stream = fs.create(target, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        """Remove a file or folder; nothing if it is absent."""
        fs, target = self._of(path)
        fs.delete(target, True)
