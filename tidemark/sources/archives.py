"""Lines of text files inside archives as a Spark data source: a partition per archive member, read as a stream."""

import fnmatch
import posixpath

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Lines in a batch that a reader hands to Spark.
BATCH = 20_000


def _open(path: str):
    """A seekable stream of a file on any file system that Arrow knows, or on this machine."""
    from pyarrow import fs

    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def _matching(path: str) -> list[str]:
    """Files of a folder whose names fit the last part of the path, by name."""
    from pyarrow import fs

    folder, pattern = posixpath.split(path)
    if "://" in folder:
        system, inner = fs.FileSystem.from_uri(folder)
    else:
        system, inner = fs.LocalFileSystem(), folder or "."
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File)
    return [posixpath.join(folder, n) for n in names if fnmatch.fnmatchcase(n, pattern)]


class Member(InputPartition):
    def __init__(self, archive: str, member: str):
        self.archive, self.member = archive, member


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.member, self.encoding, self.skip = options.get("member", "*"), options.get("encoding", "utf-8"), int(options.get("skip", "0"))

    def partitions(self):
        import zipfile

        found = []
        for path in (f for p in self.paths for f in _matching(p)):
            if path.endswith(".zip"):
                # The directory at the archive's end is read, and nothing else.
                with _open(path) as f, zipfile.ZipFile(f) as z:
                    found += [Member(path, n) for n in z.namelist() if not n.endswith("/") and fnmatch.fnmatchcase(n, self.member)]
            else:
                found.append(Member(path, ""))
        return found

    def read(self, partition):
        import gzip
        import io
        import zipfile
        from contextlib import ExitStack
        from itertools import islice

        import pyarrow as pa

        with ExitStack() as stack:
            raw = stack.enter_context(_open(partition.archive))
            if partition.member:
                raw = stack.enter_context(stack.enter_context(zipfile.ZipFile(raw)).open(partition.member))
            elif partition.archive.endswith(".gz"):
                raw = stack.enter_context(gzip.open(raw))
            lines = islice(io.TextIOWrapper(raw, encoding=self.encoding, errors="replace"), self.skip, None)
            at = self.skip
            while part := [line.rstrip("\n") for line in islice(lines, BATCH)]:
                n = len(part)
                yield pa.RecordBatch.from_pydict(
                    {"archive": pa.array([partition.archive] * n), "member": pa.array([partition.member] * n), "position": pa.array(range(at, at + n), pa.int64()), "line": pa.array(part)}
                )
                at += n


class ArchiveLines(DataSource):
    """archive, member, position, line. Options: path (file names with * and ?, several by commas), member (of zip files, likewise; default
    all), encoding (utf-8), skip (lines at the start of each member). gzip and plain files have the one member ''. Members without
    lines have no rows; signs that the encoding lacks are replaced; a line ends at \\n, \\r\\n or \\r."""

    @classmethod
    def name(cls):
        return "archive_lines"

    def schema(self):
        return "archive string, member string, position bigint, line string"

    def reader(self, schema):
        return _Reader(dict(self.options))
