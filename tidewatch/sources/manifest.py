"""Files named by a manifest as a Spark data source, in rounds, with archives read by member.

A round is an immutable list of files. The stream's offset is the number of the last round taken, so a batch that runs again
reads the same files. Of a few files, or of large archives, each member is a partition of its own: the archive's directory is read
when partitions are planned. Many small files are packed instead, several into one partition, by their listed sizes and in their order,
and are only opened by its task. A task streams member by member through range reads, so neither an archive nor a member is
ever held whole. What can't be read gives a row with ``error`` instead of failing the batch.
"""

from __future__ import annotations

import fnmatch
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK_LINES = 10_000
#: Up to so many files are opened while partitions are planned; of more, those below PACK_BYTES are packed into partitions of so
#: many bytes, each file counting OPEN_BYTES more than it has.
PLANNED_FILES, PACK_BYTES, OPEN_BYTES = 64, 64 << 20, 2 << 20
SCHEMA = "file_url string, line string, error string"
_ARROW = pa.schema([("file_url", pa.string()), ("line", pa.string()), ("error", pa.string())])


def _open(path: str):
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return files.open_input_file(place)


def _names(folder: str) -> list[str]:
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    return [f.base_name for f in files.get_file_info(fs.FileSelector(place, allow_not_found=True)) if f.is_file]


class Member(InputPartition):
    """A member of an archive, a plain file (member None), or a file that can't be opened (error)."""

    def __init__(self, file_url: str, path: str, member: str | None = None, error: str | None = None):
        super().__init__((file_url, member))
        self.file_url, self.path, self.member, self.error = file_url, path, member, error


def _sizes(paths: list[str]) -> list[int]:
    """Bytes of each file, 0 of one that isn't there."""
    from pyarrow import fs

    if not paths:
        return []
    files, _ = fs.FileSystem.from_uri(paths[0]) if "://" in paths[0] else (fs.LocalFileSystem(), "")
    places = [fs.FileSystem.from_uri(p)[1] if "://" in p else p for p in paths]
    return [f.size or 0 for f in files.get_file_info(places)]


class Pack(InputPartition):
    """Files (file_url, path) that one task opens one after the other."""

    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(len(files))
        self.files = files


def packed(files: list[tuple[str, str]], suffixes: tuple[str, ...]) -> list[InputPartition]:
    """Partitions of files (file_url, path): members of archives, and packs where there are many small files."""
    if len(files) <= PLANNED_FILES:
        return [m for url, path in files for m in members(url, path, suffixes)]
    found: list[InputPartition] = []
    held, weight = [], 0
    for (url, path), size in zip(files, _sizes([path for _, path in files])):
        if size >= PACK_BYTES:
            found += members(url, path, suffixes)
            continue
        if held and weight + size + OPEN_BYTES > PACK_BYTES:
            found.append(Pack(held))
            held, weight = [], 0
        held.append((url, path))
        weight += size + OPEN_BYTES
    return [*found, Pack(held)] if held else found


def members(file_url: str, path: str, suffixes: tuple[str, ...]) -> list[Member]:
    if not path.lower().endswith(".zip"):
        return [Member(file_url, path)]
    try:
        with _open(path) as f, zipfile.ZipFile(f) as z:
            found = [Member(file_url, path, m) for m in z.namelist() if m.lower().endswith(suffixes)]
    except (OSError, zipfile.BadZipFile) as e:
        return [Member(file_url, path, error=f"{type(e).__name__}: {e}")]
    except pa.ArrowInvalid as e:  # a file too short to seek in
        return [Member(file_url, path, error=f"BadZipFile: {e}")]
    return found or [Member(file_url, path, error="no member to read")]


def lines(part: Member) -> Iterator[pa.RecordBatch]:
    """Batches of lines of one member, Latin-1, and a row with the error where reading ends early."""

    def batch(held: list[str | None], error: str | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.file_url] * len(held)), pa.array(held, pa.string()), pa.array([error] * len(held), pa.string())], schema=_ARROW)

    if part.error:
        yield batch([None], part.error)
        return
    held: list[str | None] = []
    try:
        with _open(part.path) as f:
            z = zipfile.ZipFile(f) if part.member is not None else None
            with io.TextIOWrapper(z.open(part.member) if z else f, "latin-1") as text:
                for line in text:
                    held.append(line.rstrip("\r\n"))
                    if len(held) == BLOCK_LINES:
                        yield batch(held)
                        held = []
        if held:
            yield batch(held)
    except (OSError, EOFError, zipfile.BadZipFile, zipfile.zlib.error, pa.ArrowInvalid) as e:
        yield batch([None], f"{type(e).__name__}: {e}")


class _Reader:
    def __init__(self, options):
        self.root, self.rounds = options.get("root"), options.get("rounds")
        self.suffixes = tuple(options.get("suffixes", ".csv,.txt").split(","))
        self.strict = False

    def read(self, partition: Member | Pack) -> Iterator[pa.RecordBatch]:
        parts = (m for url, path in partition.files for m in members(url, path, self.suffixes)) if isinstance(partition, Pack) else [partition]
        for part in parts:
            for batch in lines(part):
                if self.strict and batch.column("error")[0].is_valid:
                    raise ValueError(f"{part.path}: {batch.column('error')[0]}")
                yield batch

    def _members(self, urls: list[str]) -> list[InputPartition]:
        place = lambda url: f"{self.root.rstrip('/')}/{url.rsplit('/', 1)[-1]}" if self.root else url
        return packed([(url, place(url)) for url in urls], self.suffixes)


class _Files(_Reader, DataSourceReader):
    """Batch: the files of a folder (``path``) or those of all rounds; what can't be read raises."""

    def __init__(self, options):
        super().__init__(options)
        self.path, self.names, self.strict = options.get("path"), options.get("names", "*"), True

    def partitions(self):
        if self.path:
            return self._members([f"{self.path.rstrip('/')}/{n}" for n in sorted(_names(self.path)) if fnmatch.fnmatch(n, self.names) and not n.startswith(("_", "."))])
        return self._members([u for n in round_numbers(self.rounds) for u in round_files(self.rounds, n)])


class _Rounds(_Reader, DataSourceStreamReader):
    def initialOffset(self):
        return {"round": 0}

    def latestOffset(self):
        return {"round": max(round_numbers(self.rounds), default=0)}

    def partitions(self, start, end):
        return self._members([u for n in range(start["round"] + 1, end["round"] + 1) for u in round_files(self.rounds, n)])

    def commit(self, end):
        pass


class ManifestFiles(DataSource):
    """Options: path (a folder) and names (a pattern of its files), or rounds (the folder of rounds); root (where files lie, by the last part of their url);
    suffixes (of archive members)."""

    @classmethod
    def name(cls):
        return "manifest_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Files(self.options)

    def streamReader(self, schema):
        return _Rounds(self.options)


def round_numbers(folder: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in _names(folder) if n.endswith(".json"))


def round_files(folder: str, number: int) -> list[str]:
    with _open(f"{folder.rstrip('/')}/{number:010d}.json") as f:
        return json.loads(f.read())


def write_round(spark: SparkSession, folder: str, number: int, urls: list[str]) -> None:
    """A round is written once; another of its number raises."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{number:010d}.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)
    out.write(bytearray(json.dumps(urls).encode()))
    out.close()
