"""Versioned manifests: a folder's state is its newest manifest, so writing never touches what is being read.

A write puts its files into a folder of its own and then adds ``_versions/<n>.json``, complete at once (a temporary
name first, then a rename). Until that moment readers see the old version, whatever happens to the writer;
after it, the new one. The version before the newest stays on disk for jobs that are still reading it.
Two writers of one folder that start from the same version do not both succeed: the second finds its number taken.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

from corpuspack.session import hadoop_path

FOLDER = "_versions"


class ArrowStore:
    """Small files through ``pyarrow.fs`` (works in any Python process): URIs or plain paths."""

    def _at(self, path: str):
        from pyarrow import fs

        if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
            return fs.FileSystem.from_uri(path)
        return fs.LocalFileSystem(), path

    def names(self, folder: str) -> list[str]:
        from pyarrow import fs

        store, at = self._at(folder)
        return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True)))

    def sizes(self, folder: str) -> list[tuple[str, int]]:
        from pyarrow import fs

        store, at = self._at(folder)
        found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted((i.base_name, i.size) for i in found if i.type == fs.FileType.File)

    def read(self, path: str) -> str:
        store, at = self._at(path)
        with store.open_input_stream(at, compression=None) as f:
            return f.read().decode()

    def put(self, path: str, text: str) -> None:
        from pyarrow import fs

        store, at = self._at(path)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        temp = f"{at}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(temp, compression=None) as f:
            f.write(text.encode())
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_file(temp)
            raise FileExistsError(f"another writer has committed {path}")
        store.move(temp, at)

    def drop(self, path: str) -> None:
        from pyarrow import fs

        store, at = self._at(path)
        kind = store.get_file_info(at).type
        if kind == fs.FileType.Directory:
            store.delete_dir(at)
        elif kind == fs.FileType.File:
            store.delete_file(at)


class HadoopStore:
    """The same through the session's Hadoop file systems: any path that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def names(self, folder: str) -> list[str]:
        fs, p = hadoop_path(self.spark, folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = hadoop_path(self.spark, path)
        source = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def put(self, path: str, text: str) -> None:
        fs, p = hadoop_path(self.spark, path)
        _, temp = hadoop_path(self.spark, f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(temp)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(temp, p):
            fs.delete(temp, False)
            raise FileExistsError(f"another writer has committed {path}")

    def drop(self, path: str) -> None:
        fs, p = hadoop_path(self.spark, path)
        fs.delete(p, True)


def numbers(store, folder: str) -> list[int]:
    return sorted(int(n[:-5]) for n in store.names(f"{folder}/{FOLDER}") if re.fullmatch(r"\d+\.json", n))


def newest(store, folder: str) -> tuple[int, dict] | None:
    """The number and content of the newest version, None before the first."""
    known = numbers(store, folder)
    return (known[-1], json.loads(store.read(f"{folder}/{FOLDER}/{known[-1]:08d}.json"))) if known else None


def commit(store, folder: str, after: int, content: dict) -> int:
    """Add the version that follows version ``after`` (0: the first)."""
    store.put(f"{folder}/{FOLDER}/{after + 1:08d}.json", json.dumps(content, ensure_ascii=False))
    return after + 1


def sweep(store, folder: str, data_folders_of) -> None:
    """Drop data folders that only versions before the last two name, and those manifests.

    ``data_folders_of(content)`` gives the data folders (names in ``folder``) of a version."""
    known = numbers(store, folder)
    kept = {name for n in known[-2:] for name in data_folders_of(json.loads(store.read(f"{folder}/{FOLDER}/{n:08d}.json")))}
    for n in known[:-2]:
        path = f"{folder}/{FOLDER}/{n:08d}.json"
        for name in data_folders_of(json.loads(store.read(path))):
            if name not in kept:
                store.drop(f"{folder}/{name}")
        store.drop(path)
