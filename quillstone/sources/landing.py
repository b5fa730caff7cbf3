"""A landing folder of payloads by content, and a Spark data source that reads it in batches and as a stream.

Each delivery is a list of names with the SHA-256 of their content; contents are stored once, by that hash. What a delivery brings
unchanged is known from its hash alone and isn't read again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "delivery long, name string, sha256 string, changed boolean, content binary"
#: Bytes that one task reads, unless a single payload is larger.
TASK_BYTES = 32 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _deliveries(path: str, after: int = -1, upto: int | None = None) -> Iterator[tuple[int, list[dict]]]:
    """The lists of deliveries after..upto, in order; they hold names and hashes, no contents."""
    fs, root = _open(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/deliveries", allow_not_found=True))
    for number, file in sorted((int(f.base_name.removesuffix(".json")), f.path) for f in found if f.base_name.endswith(".json")):
        if number > after and (upto is None or number <= upto):
            with fs.open_input_stream(file) as s:
                yield number, json.loads(s.read())


def land(path: str, payloads: Iterable[tuple[str, bytes]]) -> int:
    """Store a delivery and return its number. Contents are written before the list that names them; one writer at a time.

    A payload is changed if its name came with other content, or not at all, in the last delivery that held it.
    """
    fs, root = _open(path)
    last, number = {}, -1
    for number, entries in _deliveries(path):
        last |= {e["name"]: e["sha256"] for e in entries}
    entries = []
    fs.create_dir(f"{root}/contents", recursive=True)
    fs.create_dir(f"{root}/deliveries", recursive=True)
    for name, content in payloads:
        digest = hashlib.sha256(content).hexdigest()
        if fs.get_file_info(f"{root}/contents/{digest}").type == pafs.FileType.NotFound:
            with fs.open_output_stream(f"{root}/contents/{digest}.part") as s:
                s.write(content)
            fs.move(f"{root}/contents/{digest}.part", f"{root}/contents/{digest}")
        entries.append({"name": name, "sha256": digest, "size": len(content), "changed": last.get(name) != digest})
        last[name] = digest
    with fs.open_output_stream(f"{root}/deliveries/{number + 1:012d}.part") as s:
        s.write(json.dumps(entries).encode())
    fs.move(f"{root}/deliveries/{number + 1:012d}.part", f"{root}/deliveries/{number + 1:012d}.json")
    return number + 1


class Piece(InputPartition):
    """Payloads of one task: (delivery, name, sha256, changed)."""

    def __init__(self, rows: list[tuple[int, str, str, bool]]):
        self.rows = rows


def _pieces(entries: Iterable[tuple[int, dict]], contents: bool) -> list[Piece]:
    out, rows, size = [], [], 0
    for delivery, e in entries:
        if rows and contents and size + e["size"] > TASK_BYTES or len(rows) >= 10_000:
            out, rows, size = [*out, Piece(rows)], [], 0
        rows.append((delivery, e["name"], e["sha256"], e["changed"]))
        size += e["size"]
    return [*out, Piece(rows)] if rows else out


def _read(path: str, piece: Piece, contents: bool) -> Iterator[pa.RecordBatch]:
    """A batch a payload, so a task holds one content at a time; without contents one batch."""
    fs, root = _open(path)
    for part in [[r] for r in piece.rows] if contents else [piece.rows]:
        bodies = []
        for _, _, digest, _ in part:
            if contents:
                with fs.open_input_stream(f"{root}/contents/{digest}") as s:
                    bodies.append(s.read())
            else:
                bodies.append(None)
        delivery, name, sha, changed = (list(c) for c in zip(*part, strict=True))
        yield pa.record_batch([pa.array(delivery, pa.int64()), pa.array(name, pa.string()), pa.array(sha, pa.string()), pa.array(changed, pa.bool_()), pa.array(bodies, pa.binary())], names=["delivery", "name", "sha256", "changed", "content"])


class LandingReader(DataSourceReader):
    """The last changed payload of each name, or with `history` every changed one. Filters on name, sha256 and delivery prune before contents are read."""

    def __init__(self, options: dict):
        self.path, self.history = options["path"], options.get("history", "false").lower() == "true"
        self.contents = options.get("contents", "true").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in ("name", "sha256", "delivery"):
                old = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if old is None else old & values
            else:
                yield f

    def partitions(self) -> list[Piece]:
        kept: list[tuple[int, dict]] = []
        for delivery, entries in _deliveries(self.path):
            kept += [(delivery, e) for e in entries if e["changed"]]
        if not self.history:
            kept = list({e["name"]: (d, e) for d, e in kept}.values())
        fits = lambda d, e: all((d if k == "delivery" else e[k]) in v for k, v in self.wanted.items())
        return _pieces([(d, e) for d, e in kept if fits(d, e)], self.contents) or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.rows:
            yield from _read(self.path, partition, self.contents)


class LandingStream(DataSourceStreamReader):
    """Changed payloads by delivery; the offset is the number of the last delivery, so a restart goes on after it."""

    def __init__(self, options: dict):
        self.path, self.contents = options["path"], options.get("contents", "true").lower() == "true"

    def initialOffset(self) -> dict:
        return {"delivery": -1}

    def latestOffset(self) -> dict:
        fs, root = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(f"{root}/deliveries", allow_not_found=True))
        return {"delivery": max((int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json")), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return _pieces(((d, e) for d, entries in _deliveries(self.path, start["delivery"], end["delivery"]) for e in entries if e["changed"]), self.contents)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition, self.contents)

    def commit(self, end: dict) -> None:
        pass


class Landing(DataSource):
    """spark.dataSource.register(Landing); spark.read.format("landing").option("path", ...).load()."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandingReader:
        return LandingReader(dict(self.options))

    def streamReader(self, schema) -> LandingStream:
        return LandingStream(dict(self.options))
