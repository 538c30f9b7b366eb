"""Paths of whatever file system the session uses, and scratch space that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from lonja.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A new folder path under the checkpoint folder (:func:`lonja.session.ensure_checkpoint_dir`)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """The Hadoop file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.root = self._path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    def make(self, p: str) -> None:
        self.fs.mkdirs(self._path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(p))) if self.exists(p) else []

    def length(self, p: str) -> int:
        return self.fs.getFileStatus(self._path(p)).getLen()

    def sizes(self, p: str) -> dict[str, int]:
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self._path(p))}

    def read(self, p: str) -> str:
        stream = self.fs.open(self._path(p))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _rename_once(self, old, new) -> None:
        """Fails if the new name is taken."""
        hadoop = self._jvm.org.apache.hadoop.fs
        plain = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        hadoop.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(old, new, plain)

    def create_once(self, p: str, text: str) -> bool:
        """Makes a file that must not exist yet, in one step and whole; False if another writer made it first.

        The text is written aside and then given its name without overwriting: by a link on a local file system, else by a
        rename, which is exclusive on file systems with atomic renames (not on plain object stores).
        """
        aside = self._path(f"{p}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                os.link(aside.toUri().getPath(), self._path(p).toUri().getPath())
            else:
                self._rename_once(aside, self._path(p))
        except FileExistsError:
            return False
        except Exception as e:  # noqa: BLE001
            if "already exists" in str(e).lower() or "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(aside, False)
        return True
