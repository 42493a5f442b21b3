"""Reports of any size: lists of records written as JSON lines by the executors, all or nothing."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What a written row has: its list, its number there, and the record as JSON.
SCHEMA = "section string, n bigint, record string"


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), posixpath.abspath(folder))


@dataclass
class _Written(WriterCommitMessage):
    """Files of a task that ended well: section, name, rows, bytes and digest of each."""

    files: list[tuple[str, str, int, int, str]]


class _Writer(DataSourceArrowWriter):
    """Tasks write into a stage beside the folder; the driver moves it there when all have ended, or removes it."""

    def __init__(self, folder: str):
        _, path = _at(folder)
        self.folder, self.path = folder, path
        self.stage = posixpath.join(posixpath.dirname(path), f".bundle-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, _ = _at(self.folder)
        attempt = TaskContext.get().taskAttemptId()
        streams: dict[str, list] = {}
        try:
            for batch in iterator:
                sections = batch.column("section").to_pylist()
                for section, record in zip(sections, batch.column("record").to_pylist(), strict=True):
                    if section not in streams:
                        store.create_dir(posixpath.join(self.stage, section))
                        name = f"part-{attempt:010d}.jsonl"
                        streams[section] = [store.open_output_stream(posixpath.join(self.stage, section, name)), name, 0, 0, hashlib.sha256()]
                    raw, own = record.encode() + b"\n", streams[section]
                    own[0].write(raw)
                    own[2], own[3] = own[2] + 1, own[3] + len(raw)
                    own[4].update(raw)
        finally:
            for own in streams.values():
                own[0].close()
        return _Written([(section, name, rows, size, digest.hexdigest()) for section, (_, name, rows, size, digest) in streams.items()])

    def commit(self, messages: list[_Written | None]) -> None:
        """Files of attempts that didn't count go; a manifest names the others, and the stage becomes the folder."""
        store, _ = _at(self.folder)
        files = sorted(x for m in messages if m is not None for x in m.files)
        wanted = {posixpath.join(self.stage, section, name) for section, name, *_ in files}
        store.create_dir(self.stage)
        for found in store.get_file_info(fs.FileSelector(self.stage, recursive=True)):
            if found.is_file and found.path not in wanted:
                store.delete_file(found.path)
        sections: dict[str, dict] = {}
        for section, name, rows, size, digest in files:
            own = sections.setdefault(section, {"rows": 0, "files": []})
            own["rows"] += rows
            own["files"].append({"name": name, "rows": rows, "bytes": size, "sha256": digest})
        with store.open_output_stream(posixpath.join(self.stage, "manifest.json")) as f:
            f.write(json.dumps({"sections": sections}, indent=2, sort_keys=True).encode() + b"\n")
        if store.get_file_info(self.path).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.folder)
        store.move(self.stage, self.path)

    def abort(self, messages: list[_Written | None]) -> None:
        store, _ = _at(self.folder)
        if store.get_file_info(self.stage).type != fs.FileType.NotFound:
            store.delete_dir(self.stage)


class BundleSource(DataSource):
    """``df.write.format("spanloom_bundle")`` of rows like SCHEMA; option ``folder``: a path or URI that all executors share, and that doesn't exist."""

    @classmethod
    def name(cls) -> str:
        return "spanloom_bundle"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if schema.fieldNames() != ["section", "n", "record"]:
            raise ValueError(f"a bundle has rows of {SCHEMA}")
        return _Writer(self.options["folder"])


def sections(lists: dict[str, DataFrame]) -> DataFrame:
    """Rows for a bundle of lists: each a DataFrame whose column ``n`` numbers its records, of which the other columns are the fields."""
    out = None
    for name, df in lists.items():
        fields = F.to_json(F.struct(*(c for c in df.columns if c != "n")), {"ignoreNullFields": "false"})
        rows = df.select(F.lit(name).alias("section"), F.col("n").cast("bigint").alias("n"), fields.alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write(lists: dict[str, DataFrame], folder: str) -> None:
    """Write lists as JSON lines, each part in the order of ``n`` and parts one range each; a failed or killed job leaves nothing behind.

    ``manifest.json`` names the parts; a list without records isn't there.
    """
    rows = sections(lists)
    rows.sparkSession.dataSource.register(BundleSource)
    ordered = rows.repartitionByRange("section", "n").sortWithinPartitions("section", "n")
    ordered.write.format("spanloom_bundle").option("folder", folder).mode("append").save()
