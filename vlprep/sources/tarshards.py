"""Tar shards of samples as a Spark data source, for tables and streams.

A sample is a run of members that share a key: the member name up to the first
dot of its last part. Every shard is read by at least one task, shards over
``split_bytes`` by several. Where that makes many small ranges, a task reads several, and neighbours as one.

Shards written here are listed in the folder's manifest, with marks: places where a sample begins, some
megabytes apart. Such shards are cut at marks. Others are cut anywhere, and a task finds
the last header before its range. Members that are tar files themselves hold headers too: read
such shards with ``split_bytes=0`` unless they have marks.

Damage is treated alike however a shard is cut: reading goes on at the next block that is a valid header, the
sample before it ends there, and one row tells of the error.
"""

from __future__ import annotations

import fnmatch
import io
import json
import re
import tarfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

from vlprep.functions.text import json_member
from vlprep.operators.ranking import NULL_BUCKET, exact_rank, order_buckets
from vlprep.session import qualified, small

BLOCK = tarfile.BLOCKSIZE
TEXT_MEMBERS = ("json", "txt", "cls")
SPLIT_BYTES = 512 << 20
#: So many ranges get a task each. Of more, as many go to a task as this leaves tasks, and as have so many bytes.
LEAST_TASKS = 64
TASK_BYTES = 64 << 20
#: Least distance of two marks of a shard.
MARK_BYTES = 16 << 20
ROWS_PER_ARROW_BATCH = 256
BYTES_PER_ARROW_BATCH = 32 << 20
WINDOW = BLOCK * 2048
MANIFEST = "_shards.json"
#: Names that the writer gives; such a shard is there once a manifest lists it.
_ATTEMPT = re.compile(r"^\d{9,}-[0-9a-f]{12}\.tar$")


class Shard(NamedTuple):
    path: str
    size: int
    marks: tuple[int, ...] = ()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _segments_match(path: str, pattern: str) -> bool:
    names, wanted = path.strip("/").split("/"), pattern.strip("/").split("/")
    return len(names) == len(wanted) and all(fnmatch.fnmatchcase(n, w) for n, w in zip(names, wanted))


def _read_json(files: pafs.FileSystem, path: str):
    """Content of a JSON file; None if there is none."""
    if files.get_file_info(path).type != pafs.FileType.File:
        return None
    with files.open_input_stream(path) as source:
        return json.loads(source.read())


def _write_json(files: pafs.FileSystem, path: str, value) -> None:
    """Write a file at once: it is there as a whole or not at all."""
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as sink:
        sink.write(json.dumps(value, separators=(",", ":")).encode())
    files.move(draft, path)


def _listed(files: pafs.FileSystem, folder: str) -> dict[str, Shard] | None:
    """Shards of a folder's manifest by name; None without one."""
    found = _read_json(files, f"{folder}/{MANIFEST}")
    return None if found is None else {n: Shard(f"{folder}/{n}", size, tuple(marks)) for n, size, marks in found["shards"]}


def find_shards(pattern: str) -> list[Shard]:
    """Sorted shards that a pattern, folder or file name stands for. Where a folder has a manifest, only listed files count."""
    files, path = _filesystem(pattern)
    if not any(c in path for c in "*?["):
        info = files.get_file_info(path)
        if info.type == pafs.FileType.File:
            listed = _listed(files, path.rpartition("/")[0]) or {}
            return [listed.get(path.rpartition("/")[2], Shard(path, info.size))]
        path = f"{path.rstrip('/')}/*.tar"
    base = path[: re.search(r"[*?\[]", path).start()].rpartition("/")[0] or "/"
    if files.get_file_info(base).type != pafs.FileType.Directory:
        return []
    deep = "/" in path[len(base) :].strip("/")
    found = files.get_file_info(pafs.FileSelector(base, recursive=deep))
    matching = [f for f in found if f.type == pafs.FileType.File and _segments_match(f.path, path)]
    manifests = {folder: _listed(files, folder) for folder in {f.path.rpartition("/")[0] for f in matching}}
    out = []
    for f in matching:
        folder, _, name = f.path.rpartition("/")
        listed = manifests[folder]
        if listed is None and not _ATTEMPT.match(name):
            out.append(Shard(f.path, f.size))
        elif listed is not None and name in listed:
            out.append(listed[name])
    return sorted(out)


@dataclass
class ShardRange(InputPartition):
    path: str
    start: int
    end: int
    marked: bool = False  # begins and ends where samples do


def ranges_of(shards: list[Shard], split_bytes: int) -> list[ShardRange]:
    """Ranges of about ``split_bytes`` of some shards, whole shards for 0."""
    parts: list[ShardRange] = []
    for path, size, marks in shards:
        step = split_bytes if 0 < split_bytes < size else max(size, 1)
        cuts = list(range(0, max(size, 1), step))
        if marks and len(cuts) > 1:
            cuts = [0]
            for mark in marks:
                if mark - cuts[-1] >= step:
                    cuts.append(mark)
        ends = [*cuts[1:], size]
        parts += [ShardRange(path, a, b, bool(marks)) for a, b in zip(cuts, ends)]
    return parts


@dataclass
class ShardRanges(InputPartition):
    ranges: list[ShardRange]


def tasks_of(ranges: list[ShardRange]) -> list[InputPartition]:
    """Ranges as they are dealt out to tasks, in order. Their number grows with the bytes to read, not with that of the ranges."""
    if len(ranges) <= LEAST_TASKS:
        return ranges
    most = min(TASK_BYTES, sum(r.end - r.start for r in ranges) // LEAST_TASKS)
    tasks, held = [], 0
    for r in ranges:
        held += r.end - r.start
        if not tasks or held > most:
            tasks.append(ShardRanges([r]))
            held = r.end - r.start
            continue
        own = tasks[-1].ranges
        if (own[-1].path, own[-1].end, own[-1].marked) == (r.path, r.start, r.marked):
            own[-1] = ShardRange(r.path, own[-1].start, r.end, r.marked)
        else:
            own.append(r)
    return tasks


def _step(info: tarfile.TarInfo) -> int:
    return BLOCK + -(-info.size // BLOCK) * BLOCK


def _header(block: bytes, old: bool = False) -> tarfile.TarInfo | None:
    """The header that a block is, by its magic word and checksum; ``old`` headers have no magic word."""
    if len(block) < BLOCK or not (old or block[257:262] == b"ustar"):
        return None
    try:
        return tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")
    except tarfile.HeaderError:
        return None


def _pax_path(data: bytes) -> str | None:
    found = re.search(rb"(?:^|\n)\d+ path=([^\n]*)\n", data)
    return found.group(1).decode("utf-8", "surrogateescape") if found else None


class Member(NamedTuple):
    start: int  # of its long name, if it has one
    name: str
    data: int
    size: int


class Gap(NamedTuple):
    start: int
    after: int  # where the header before it begins
    fault: str | None  # None for blank blocks, as between shards put together


def _next_header(handle, offset: int, size: int) -> tuple[int | None, bool]:
    """The first header from ``offset`` on, and whether all before it is blank."""
    blank = True
    while offset < size:
        handle.seek(offset)
        window = handle.read(WINDOW)
        at = window.find(b"ustar", 257)
        while at >= 0:
            begin = at - 257
            if begin % BLOCK == 0 and _header(window[begin : begin + BLOCK]):
                return offset + begin, blank and not window[:begin].strip(b"\0")
            at = window.find(b"ustar", at + 1)
        blank = blank and not window.strip(b"\0")
        offset += WINDOW
    return None, blank


def _last_header(handle, before: int) -> int:
    """The last header that begins before ``before``; 0 if there is none."""
    end = -(-before // BLOCK) * BLOCK
    while end > 0:
        begin = max(0, end - WINDOW)
        handle.seek(begin)
        window = handle.read(end - begin)
        at = window.rfind(b"ustar")
        while at >= 0:
            place = at - 257
            if place >= 0 and place % BLOCK == 0 and _header(window[place : place + BLOCK]):
                return begin + place
            at = window.rfind(b"ustar", 0, at + 4)
        end = begin
    return 0


def _walk(handle, offset: int, size: int, old: bool) -> Iterator[Member | Gap]:
    """Files and gaps from ``offset`` on, in order."""
    start = name = None
    last = offset
    while offset < size:
        handle.seek(offset)
        block = handle.read(BLOCK)
        info = _header(block, old)
        if info is None:
            follows, blank = _next_header(handle, offset, size)
            dangling = start is not None
            if dangling or not blank:
                yield Gap(offset, last, "a long name without its member" if dangling else "shard ends inside a header" if len(block) < BLOCK else "not a header")
            elif follows is not None:
                yield Gap(offset, last, None)
            if follows is None:
                return
            start = name = None
            offset = follows
            continue
        if offset + _step(info) > size:
            yield Gap(offset, offset, "shard ends inside a member")
            return
        last = offset
        if info.type in (tarfile.GNUTYPE_LONGNAME, tarfile.XHDTYPE):
            data = handle.read(info.size)
            long = data.rstrip(b"\0").decode("utf-8", "surrogateescape") if info.type == tarfile.GNUTYPE_LONGNAME else _pax_path(data)
            start, name = offset if start is None else start, long or name
        elif info.type in (tarfile.XGLTYPE, tarfile.GNUTYPE_LONGLINK):
            start = offset if start is None else start
        else:
            if info.isreg():
                yield Member(offset if start is None else start, name or info.name, offset + BLOCK, info.size)
            start, name = None, None
        offset += _step(info)
    if start is not None:
        yield Gap(size, last, "a long name without its member")


def _split_name(name: str) -> tuple[str, str]:
    folder, slash, last = name.rpartition("/")
    stem, _, extension = last.partition(".")
    return f"{folder}{slash}{stem}", extension.lower()


def _samples(handle, part: ShardRange, size: int, columns: list[str]) -> Iterator[tuple[str | None, dict[str, bytes], str | None]]:
    """(key, members, None) of the samples of a range, and (None, {}, fault) of the gaps.

    A range that is cut anywhere gives the samples after the one its first member belongs to, up to and
    including the one the first member past its end belongs to. The range at the start of a shard keeps its
    first sample. So each sample has exactly one range. A gap belongs to the range of the header before it, and ends a sample.
    """
    handle.seek(0)
    block = handle.read(BLOCK)
    old = _header(block) is None and _header(block, True) is not None
    if old and not part.marked:
        # no marks to find members by: the first range takes the whole shard
        if part.start > 0:
            return
        part = ShardRange(part.path, 0, size)
    skipping = part.start > 0 and not part.marked
    foreign, key, sample, last = None, None, {}, False
    for item in _walk(handle, _last_header(handle, part.start) if skipping else part.start, size, old):
        if part.marked and item.start >= part.end:
            break
        if item.start < part.start:
            continue
        if isinstance(item, Gap):
            if key is not None:
                yield key, sample, None
                key = None
            if item.fault and part.start <= item.after < part.end:
                yield None, {}, item.fault
            if last:
                return
            skipping = skipping and foreign is None
            continue
        this, extension = _split_name(item.name)
        if skipping:
            foreign = this if foreign is None else foreign
            if this == foreign and item.start < part.end:
                continue
            if this == foreign:
                return
            skipping = False
        if this != key:
            if key is not None:
                yield key, sample, None
            if last:
                return
            key, sample = this, {}
        last = last or item.start >= part.end
        if extension in columns:
            handle.seek(item.data)
            sample[extension] = handle.read(item.size)
    if key is not None:
        yield key, sample, None


class TarShardReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.pattern = options["path"]
        self.columns = [f.name for f in schema.fields if f.name not in ("shard", "key", "error")]
        self.fields = [(f.name, isinstance(f.dataType, T.BinaryType)) for f in schema.fields]
        self.fail = options.get("on_error", "skip") == "fail"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        shards = find_shards(self.pattern)
        if not shards:
            raise ValueError(f"no shards match {self.pattern!r}")
        return tasks_of(ranges_of(shards, self.split_bytes))

    def _row(self, path: str, key, sample: dict, error) -> dict:
        row = {"shard": path, "key": key, "error": error}
        for name in self.columns:
            value = sample.get(name)
            row[name] = value.decode("utf-8", "replace") if value is not None and name in TEXT_MEMBERS else value
        return row

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges if isinstance(partition, ShardRanges) else [partition]:
            yield from self._read_range(part)

    def _read_range(self, partition: ShardRange) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, pa.binary() if is_binary else pa.string()) for n, is_binary in self.fields])
        files = _filesystem(self.pattern)[0]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=kinds)

        try:
            with files.open_input_file(partition.path) as raw:
                size = raw.size()
                handle = io.BufferedReader(raw, 1 << 20)
                for key, sample, fault in _samples(handle, partition, size, self.columns):
                    if fault and self.fail:
                        raise tarfile.ReadError(fault)
                    rows.append(self._row(partition.path, key, sample, fault))
                    held += sum(map(len, sample.values()))
                    if len(rows) >= ROWS_PER_ARROW_BATCH or held >= BYTES_PER_ARROW_BATCH:
                        yield batch()
                        rows, held = [], 0
        except (tarfile.TarError, OSError, ValueError) as error:
            if self.fail:
                raise
            rows.append(self._row(partition.path, None, {}, f"{type(error).__name__}: {error}"))
        if rows:
            yield batch()


class TarShardStreamReader(DataSourceStreamReader):
    """New shards of a pattern. Every admission of shards is logged in the folder ``log`` before it is read.

    The offset is the number of admissions, so a restart finds what it has read, whatever the names
    of shards that came since.
    """

    def __init__(self, options: dict, schema: T.StructType):
        if "log" not in options:
            raise ValueError("a stream of shards needs the option 'log', a folder of its own")
        self.reader = TarShardReader(options, schema)
        self.log = options["log"].rstrip("/")
        self.most = int(options.get("max_shards", 0))
        self.seen: set[str] | None = None
        self.admitted = 0

    def _entry(self, n: int) -> list[Shard] | None:
        files, folder = _filesystem(self.log)
        found = _read_json(files, f"{folder}/{n:09d}.json")
        return None if found is None else [Shard(path, size, tuple(marks)) for path, size, marks in found]

    def _load(self) -> None:
        self.seen = set()
        while (entry := self._entry(self.admitted + 1)) is not None:
            self.admitted += 1
            self.seen.update(s.path for s in entry)

    def initialOffset(self) -> dict:
        return {"admitted": 0}

    def latestOffset(self) -> dict:
        if self.seen is None:
            self._load()
        new = [s for s in find_shards(self.reader.pattern) if s.path not in self.seen]
        new = new[: self.most] if self.most else new
        if new:
            files, folder = _filesystem(self.log)
            files.create_dir(folder, recursive=True)
            _write_json(files, f"{folder}/{self.admitted + 1:09d}.json", new)
            self.admitted += 1
            self.seen.update(s.path for s in new)
        return {"admitted": self.admitted}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for n in range(start["admitted"] + 1, end["admitted"] + 1):
            entry = self._entry(n)
            if entry is None:
                raise ValueError(f"the log {self.log!r} lacks admission {n}")
            parts += ranges_of(entry, self.reader.split_bytes)
        return tasks_of(parts)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


@dataclass
class WrittenShards(WriterCommitMessage):
    shards: list[tuple[str, int, list[int]]]  # name, bytes, marks


def _number(name: str) -> str:
    return name.partition("-")[0].removesuffix(".tar")


class TarShardWriter(DataSourceArrowWriter):
    """Each task attempt writes shards under names of its own; ``commit`` lists those of the attempts that won."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.members = [f.name for f in schema.fields if f.name not in ("shard_idx", "key")]
        self.overwrite = overwrite
        self.mark_bytes = int(options.get("mark_bytes", MARK_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex[:12]
        done: list[tuple[str, int, list[int]]] = []
        number, sink, marks, key = None, None, [], None
        numbers = set()
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["shard_idx"] != number:
                        if row["shard_idx"] in numbers:
                            raise ValueError("rows of a shard must be consecutive: sort by shard_idx")
                        if sink is not None:
                            done.append(self._finish(sink, number, attempt, marks))
                        number, marks, key = row["shard_idx"], [], None
                        numbers.add(number)
                        sink = files.open_output_stream(f"{root}/{self._name(number, attempt)}", buffer_size=1 << 20)
                    at = sink.tell()
                    if key is not None and row["key"] != key and at - (marks[-1] if marks else 0) >= self.mark_bytes:
                        marks.append(at)
                    key = row["key"]
                    self._add(sink, row)
            if sink is not None:
                done.append(self._finish(sink, number, attempt, marks))
        finally:
            if sink is not None and not sink.closed:
                sink.close()
        return WrittenShards(done)

    @staticmethod
    def _name(number: int, attempt: str) -> str:
        return f"{number:09d}-{attempt}.tar"

    def _add(self, sink: pa.NativeFile, row: dict) -> None:
        for member in self.members:
            value = row[member]
            if value is None:
                continue
            data = value.encode("utf-8") if isinstance(value, str) else bytes(value)
            info = tarfile.TarInfo(f"{row['key']}.{member}")
            info.size = len(data)
            sink.write(info.tobuf(tarfile.PAX_FORMAT) + data + bytes(-len(data) % BLOCK))

    def _finish(self, sink: pa.NativeFile, number: int, attempt: str, marks: list[int]) -> tuple[str, int, list[int]]:
        sink.write(bytes(2 * BLOCK))  # fixed value: end of a tar file
        size = sink.tell()
        sink.close()
        return self._name(number, attempt), size, marks

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        new = sorted(s for m in messages if m is not None for s in m.shards)
        numbers = {_number(n) for n, _, _ in new}
        if len(numbers) != len(new):
            raise ValueError("a shard was written by two tasks: partition by shard_idx")
        old = []
        if not self.overwrite:
            old = [(s.path.rpartition("/")[2], s.size, list(s.marks)) for s in find_shards(root)]
            clash = [n for n, _, _ in old if _number(n) in numbers]
            if clash:
                raise ValueError(f"shards exist already: {clash[:3]}")
        _write_json(files, f"{root}/{MANIFEST}", {"shards": sorted(old + new)})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _filesystem(self.path)
        for name in [n for m in messages if m is not None for n, _, _ in m.shards]:
            files.delete_file(f"{root}/{name}")


class TarShards(DataSource):
    """``spark.read.format("tarshards")``; see :func:`read_shards` for the options."""

    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> T.StructType:
        members = [c.strip() for c in self.options.get("columns", "jpg,json").split(",") if c.strip()]
        kind = lambda m: T.StringType() if m in TEXT_MEMBERS else T.BinaryType()
        return T.StructType(
            [T.StructField("shard", T.StringType()), T.StructField("key", T.StringType())]
            + [T.StructField(m, kind(m)) for m in members]
            + [T.StructField("error", T.StringType())]
        )

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TarShardReader(dict(self.options), schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return TarShardStreamReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TarShardWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarShards)


def _options(on_error: str, **options) -> dict[str, str]:
    if on_error not in ("skip", "fail"):
        raise ValueError(f"on_error must be 'skip' or 'fail', got {on_error!r}")
    return {"on_error": on_error} | {k: str(v) for k, v in options.items()}


def read_shards(spark: SparkSession, pattern: str, columns: str = "jpg,json", on_error: str = "skip",
                split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Samples with ``shard``, ``key``, one column per member in ``columns``, and ``error``.

    Members not in ``columns`` are skipped over, not read. Each damaged place of a shard gives
    one row with ``error`` and null ``key`` (``skip``), or ends the job (``fail``).
    ``split_bytes=0`` reads every shard in one task.
    """
    register(spark)
    options = _options(on_error, columns=columns, split_bytes=split_bytes)
    return spark.read.format("tarshards").options(**options).load(qualified(spark, pattern))


def stream_shards(spark: SparkSession, pattern: str, log: str, columns: str = "jpg,json", on_error: str = "skip",
                  split_bytes: int = SPLIT_BYTES, max_shards: int = 0) -> DataFrame:
    """Samples of new shards as a stream, with the columns of :func:`read_shards`.

    ``log`` is a folder of the stream alone, best below its checkpoint; it holds which shards were
    admitted. At most ``max_shards`` are admitted at a time (0: all). A shard is read as it is when
    it is admitted; shards of the writer below appear when they are whole.
    """
    register(spark)
    options = _options(on_error, columns=columns, split_bytes=split_bytes, max_shards=max_shards, log=qualified(spark, log))
    return spark.readStream.format("tarshards").options(**options).load(qualified(spark, pattern))


def good_samples(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error").isNull()).drop("error")


def shard_rejects(df: DataFrame) -> DataFrame:
    """Number of read errors per shard."""
    return df.filter(F.col("error").isNotNull()).groupBy("shard").agg(F.count(F.lit(1)).alias("n_errors"))


def with_captions(df: DataFrame, json: str = "json", out: str = "caption") -> DataFrame:
    """Add the caption held in the JSON member; malformed JSON gives null."""
    return df.withColumn(out, json_member(F.col(json), "caption", "string"))


def place_in_shards(df: DataFrame, order: str, rows_per_shard: int) -> DataFrame:
    """Add ``shard_idx``, the place by ``order`` div ``rows_per_shard``. Only the order column is shuffled.

    The values at which shards begin are found by ranking the order column alone. Each row meets
    those of its bucket, and counts how many it has passed. Rows without an order fill the first shards about evenly.
    """
    bucketed = order_buckets(df.select(order), order)
    ranked = bucketed(exact_rank(df.select(order), order, "_place", total="_total"))
    first = F.when(F.col("_place") % rows_per_shard == 0, F.col(order))
    cuts = ranked.groupBy("_bucket").agg(
        F.expr(f"(min(_place) - 1 + {int(rows_per_shard)}) div {int(rows_per_shard)} - 1").alias("_before"),
        F.array_sort(F.collect_list(first)).alias("_cuts"),
        F.ceil(F.count(F.lit(1)) / rows_per_shard).alias("_shards"),
    )
    placed = bucketed(df).join(small(cuts), "_bucket")
    passed = F.size(F.filter("_cuts", lambda c: c <= F.col(order)))
    spread = F.pmod(F.xxhash64(*df.columns), F.col("_shards"))
    shard = F.when(F.col(order).isNull(), spread).otherwise(F.col("_before") + passed)
    return placed.withColumn("shard_idx", shard.cast("bigint")).drop("_bucket", "_before", "_cuts", "_shards")


def write_shards(df: DataFrame, path: str, order: str, rows_per_shard: int = 10_000, mode: str = "append",
                 mark_bytes: int = MARK_BYTES) -> None:
    """Samples (``key`` and one column per member) to numbered shards, in order of ``order``, unique.

    The samples are shuffled once. Shards become visible together, when the manifest is written;
    one job writes to a folder at a time. Files that a manifest does not list (replaced ones, and those of lost
    attempts) are not seen, and left to :func:`remove_unlisted`; a copy of a folder needs its manifest too.
    """
    register(df.sparkSession)
    members = [c for c in df.columns if c != order or c == "key"]
    by = "_order" if order in members else order
    (
        place_in_shards(df.withColumn(by, F.col(order)), by, rows_per_shard)
        .repartition("shard_idx")
        .sortWithinPartitions("shard_idx", by)
        .select("shard_idx", *members)
        .write.format("tarshards")
        .option("mark_bytes", str(mark_bytes))
        .mode(mode)
        .save(qualified(df.sparkSession, path))
    )


def remove_unlisted(spark: SparkSession, path: str, older_than: float = 86_400.0) -> list[str]:
    """Delete the shards of a folder that its manifest does not list and that are older than so many seconds."""
    files, root = _filesystem(qualified(spark, path))
    listed = _listed(files, root)
    if listed is None:
        return []
    gone = []
    for f in files.get_file_info(pafs.FileSelector(root)):
        name = f.path.rpartition("/")[2]
        if name.endswith(".tar") and name not in listed and time.time() - f.mtime.timestamp() >= older_than:
            files.delete_file(f.path)
            gone.append(name)
    return sorted(gone)
