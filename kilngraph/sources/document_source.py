"""A data source of parsed documents: ``spark.read`` and ``spark.readStream`` over folders of files.

    spark.dataSource.register(DocumentSource)
    spark.read.format("documents").option("parser", "module:function").load(folder)
    spark.readStream.format("documents").option("parser", ...).option("log", folder2).load(folder)

A partition is a run of files of about ``partitionBytes``; a file is opened by the task that parses it, and its parser is
called once per read of the file.  A file that cannot be read or parsed gives one row with its error (see
``readers.parsed``, which splits pages and errors after writing them once).

A stream's offset is a number of entries in ``log``: each entry lists the files that one trigger takes, so a batch that is
replayed reads the same files, and a file is taken once, whatever its time stamp.  ``maxFilesPerTrigger`` bounds an entry.

Files are listed and opened through ``pyarrow.fs``, so the folder has to be in a store that it knows (file, HDFS, S3,
GCS).  Defined cases: no matching file gives no rows; hidden files and folders (leading dot or underscore) are passed
over; an empty file is given to the parser like any other; a path with a scheme keeps it in the column ``path``.
"""

from __future__ import annotations

import fnmatch
import importlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from kilngraph.sources import readers

#: Bytes of files in one partition, and files of one trigger, unless the options say otherwise.
PARTITION_BYTES, MOST_FILES = 64_000_000, 10_000


class FilesPartition(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """The file system of ``path``, the path inside it, and what precedes that in full names."""
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def listing(path: str, patterns: list[str]) -> list[tuple[str, int]]:
    """(name, size) of all files below ``path`` whose name fits a pattern (any case), sorted by name."""
    system, inner, head = _store(path)
    found = system.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True, allow_not_found=True))
    inside = lambda f: f.path[len(inner) :].strip("/").split("/")
    wanted = lambda f: f.is_file and not any(x[:1] in "._" for x in inside(f)) and any(fnmatch.fnmatch(f.base_name.lower(), p.lower()) for p in patterns)
    return sorted((head + f.path, f.size) for f in found if wanted(f))


def runs(files: list[tuple[str, int]], most_bytes: int) -> list[FilesPartition]:
    """Files in runs of about ``most_bytes``; a larger file is a run of its own."""
    out, run, size = [], [], 0
    for name, n in files:
        if run and size + n > most_bytes:
            out.append(FilesPartition(run))
            run, size = [], 0
        run.append(name)
        size += n
    return out + ([FilesPartition(run)] if run else [])


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.patterns = options.get("patterns", "*.pdf").split(",")
        self.most_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.parser = options["parser"]

    def read(self, partition: FilesPartition) -> Iterator[pa.RecordBatch]:
        module, _, name = self.parser.partition(":")
        parser = getattr(importlib.import_module(module), name)
        parse = parser.once() if hasattr(parser, "once") else parser
        for path in partition.value:
            try:
                system, inner, _ = _store(path)
                with system.open_input_file(inner) as file:
                    content = file.read()
                rows = [readers.page_row(path, i, p) for i, p in enumerate(parse(content))]
            except Exception as error:  # noqa: BLE001  a broken file must not end the job
                rows = [readers.error_row(path, error)]
            yield pa.RecordBatch.from_pylist([dict(zip(readers.PAGE_COLUMNS, r, strict=True)) for r in rows], schema=readers.PAGE_ARROW)


class DocumentReader(_Reader, DataSourceReader):
    def partitions(self) -> list[FilesPartition]:
        return runs(listing(self.path, self.patterns), self.most_bytes)


class DocumentStreamReader(_Reader, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.log, self.most_files = options["log"].rstrip("/"), int(options.get("maxFilesPerTrigger", MOST_FILES))
        self.entries = self._logged()
        self.seen = {name for n in range(self.entries) for name, _ in self._entry(n)}

    def _logged(self) -> int:
        return len(listing(self.log, ["entry-*.json"]))

    def _entry(self, number: int) -> list[tuple[str, int]]:
        system, inner, _ = _store(self.log)
        with system.open_input_file(f"{inner}/entry-{number:09d}.json") as file:
            return [tuple(x) for x in json.loads(file.read())]

    def _write(self, number: int, files: list[tuple[str, int]]) -> None:
        """An entry has its name only once it is whole."""
        system, inner, _ = _store(self.log)
        system.create_dir(inner, recursive=True)
        unready = f"{inner}/.{uuid.uuid4().hex}"
        with system.open_output_stream(unready) as file:
            file.write(json.dumps(files).encode())
        system.move(unready, f"{inner}/entry-{number:09d}.json")

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        new = [f for f in listing(self.path, self.patterns) if f[0] not in self.seen][: self.most_files]
        if new:
            self._write(self.entries, new)
            self.seen |= {name for name, _ in new}
            self.entries += 1
        return {"entries": self.entries}

    def partitions(self, start: dict, end: dict) -> list[FilesPartition]:
        return runs(sorted(f for n in range(start["entries"], end["entries"]) for f in self._entry(n)), self.most_bytes)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return f"path string, {readers.PAGE}"

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)

    def streamReader(self, schema) -> DocumentStreamReader:
        return DocumentStreamReader(self.options)
