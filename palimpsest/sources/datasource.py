"""Files as a Spark data source: ``spark.read.format("palimpsest")``.

The planner lists paths and lengths, and deals them to tasks of like size; the readers open their
files themselves, so no content is ever shuffled, held beside others or sent to a worker that
doesn't read it. Options: ``only``, a comma list of detectors, prunes what is read of each
file to the phases that they need; ``glob``, ``most`` (bytes of the largest file that is read), ``seconds`` (of each phase), ``share`` (bytes for a task).
"""

from __future__ import annotations

import fnmatch
import heapq
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Schemes whose stores Python can open by itself, and what they are called there.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "gcs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}
#: Bytes for a task, and what opening a file costs as bytes.
SHARE, OPEN = 128 << 20, 1 << 20


def direct(path: str) -> bool:
    """Whether readers can open files at this path without Spark's own file systems."""
    return urlsplit(path).scheme in SCHEMES


def _store(path: str):
    """File system, path inside it, and what comes before paths there to make them whole again."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme == "file":
        return fs.LocalFileSystem(), unquote(parts.path), "file:"
    store, inside = fs.FileSystem.from_uri(f"{SCHEMES[parts.scheme]}://{path.split('://', 1)[1]}")
    at = path.find(inside)
    return store, inside, path[:at] if at >= 0 else f"{parts.scheme}://"


def listed(path: str, glob: str = "*") -> list[tuple[str, int]]:
    """(path, length) of the files below ``path``, or of the file that it is; what is hidden, as Spark has it, is left out."""
    from pyarrow import fs

    store, inside, before = _store(path)
    (info,) = store.get_file_info([inside])
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(inside, recursive=True)) if info.type == fs.FileType.Directory else [info]
    below = len(inside.rstrip("/"))
    return [(before + x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatchcase(x.base_name, glob) and not any(part[:1] in "_." for part in x.path[below:].split("/") if part)]


@dataclass
class Share(InputPartition):
    """Files of one task."""

    files: list[tuple[str, int]]


def dealt(files: list[tuple[str, int]], share: int = SHARE, most: int | None = None) -> list[list[tuple[str, int]]]:
    """Files in shares of like size: the largest first, each to the share that has least. A file over ``most`` isn't opened, so it costs nothing."""
    cost = [OPEN + (n if most is None or n <= most else 0) for _, n in files]
    tasks = [(0, k) for k in range(max(1, -(-sum(cost) // share)))]
    out: list[list[tuple[str, int]]] = [[] for _ in tasks]
    for k in sorted(range(len(files)), key=lambda k: (-cost[k], files[k])):
        have, task = heapq.heappop(tasks)
        out[task].append(files[k])
        heapq.heappush(tasks, (have + cost[k], task))
    return [x for x in out if x]


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        from .files import MOST, SECONDS

        self.fields = to_arrow_schema(schema)
        self.path, self.glob = options["path"], options.get("glob", "*.pdf")
        self.only = [x.strip() for x in options.get("only", "").split(",") if x.strip()]
        self.most, self.seconds, self.share = int(options.get("most", MOST)), float(options.get("seconds", SECONDS)), int(options.get("share", SHARE))

    def partitions(self) -> list[Share]:
        return [Share(x) for x in dealt(listed(self.path, self.glob), self.share, self.most)] or [Share([])]

    def read(self, partition: Share):
        """One batch for each file."""
        import pyarrow as pa

        from .files import rows_of

        for path, length in partition.files:
            rows = rows_of(path, length, lambda path=path: content(path), self.most, self.seconds, self.only)
            yield pa.RecordBatch.from_pylist(rows, self.fields)


def content(path: str) -> bytes:
    if path.startswith("file:"):
        with open(path.removeprefix("file:"), "rb") as f:
            return f.read()
    store, inside, _ = _store(path)
    with store.open_input_file(inside) as f:
        return f.read()


class Files(DataSource):
    """Register with ``spark.dataSource.register(Files)``, then ``spark.read.format("palimpsest").option("only", "metadata").load("s3://bucket/folder")``."""

    @classmethod
    def name(cls) -> str:
        return "palimpsest"

    def schema(self) -> str:
        from .files import SOURCE

        return SOURCE

    def reader(self, schema: StructType) -> FileReader:
        if not direct(self.options["path"]):
            raise ValueError(f"no store of {', '.join(SCHEMES)}: {self.options['path']}")
        return FileReader(dict(self.options), schema)
