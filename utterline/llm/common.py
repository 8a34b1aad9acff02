"""Shared plumbing: the shared folder, staged tables, skewed joins, Arrow maps and the word definition."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Words are runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A key is hot when it has over 1 / HOT of all rows, and at least LEAST_HOT; so at most HOT keys are.
HOT, LEAST_HOT = 200, 500
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        path = tempfile.mkdtemp(prefix="utterline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[app] = "file://" + path
    return _OWN[app]


def staged_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; ``release`` and the driver's end remove it."""
    if not _STAGED:
        atexit.register(release)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def write_out(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """Write Parquet; the shuffle files behind it go as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows survives a lost executor without running the part before again, and
    anything that a task decided (its partition number, say) is fixed by the files.
    """
    path = staged_path(df.sparkSession, name)
    write_out(df, path, compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(spark: SparkSession, path: str) -> None:
    """Remove one staged folder."""
    _STAGED[:] = [x for x in _STAGED if x[1] != path]
    remove(spark, path)


def mark() -> int:
    """Where the list of staged folders stands, for ``release``."""
    return len(_STAGED)


def release(since: int = 0) -> None:
    """Remove the folders staged after ``since``. Call it once every result that reads them is written."""
    while len(_STAGED) > since:
        spark, path = _STAGED.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session's JVM may be gone at the driver's end
            return


def hot_join(many: DataFrame, one: DataFrame, keys: list[str], count: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Inner join of ``many`` to ``one``, which has one row for each key and, in ``count``, how many rows of ``many`` have it.

    A hot key (see HOT) would fill one task; its row is broadcast instead, and there are at most HOT such rows, whatever the input.
    ``sizes``, if known, are the sum and the greatest of the counts; without a hot key this is a plain join.
    """
    total, most = sizes or one.agg(F.sum(count), F.max(count)).first()
    least = max(LEAST_HOT, (total or 0) // HOT)
    if (most or 0) <= least:
        return many.join(one, keys)
    few, rest = one.where(F.col(count) > least), one.where(F.col(count) <= least)
    return many.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest, keys).unionByName(many.join(F.broadcast(few), keys))


def give_back() -> None:
    """Return freed memory to the machine: a worker is reused, and what one task needed at most would stay with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package on the workers, which give memory back when a task ends."""
    ship(df.sparkSession)

    def run(batches):
        Generations.enter(fn.__module__)
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def fresh(name: str, *taken) -> str:
    """``name``, with underscores before it until no column of the tables ``taken`` is called so, whatever its case."""
    have = {c.lower() for df in taken for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return [t or "" for t in column.to_pylist()]


def pieces(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about ``most_bytes`` of text or a single row."""
    col = batch.column(column)
    start, size = 0, 0
    lengths = pa.compute.binary_length(col).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def doc_hash(doc_id) -> int:
    """crc32 of a document's id written as text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def doc_hash_column(name: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def part_of(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions to ask for, from the session's setting."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def task_id() -> int:
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Generations(dict):
    """A mapping that fills itself through ``make`` and keeps at most two generations of ``size`` bytes each, estimated.

    Values are numbers, tuples of them or bytes. It lives in a reused Python worker, so its bound is per worker, whatever the input's size. Keys of over
    ``longest`` characters are made anew each time. When a task of another module begins, the maps are emptied: a worker that serves
    several operators holds one's maps.
    """

    _all: weakref.WeakValueDictionary = weakref.WeakValueDictionary()
    _user: str | None = None

    def __init__(self, make: Callable, users: tuple[str, ...], size: int = 12 << 20, longest: int = 256):
        super().__init__()
        self.make, self.users, self.size, self.longest, self.old, self.held = make, users, size, longest, {}, 0
        Generations._all[id(self)] = self

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if self.held >= self.size:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += 190 + len(key) + (len(value) if isinstance(value, bytes) else 8 * len(value) if isinstance(value, tuple) else 0)  # objects and table slots

    @classmethod
    def enter(cls, user: str) -> None:
        """Empty the maps that the module ``user`` doesn't use."""
        if cls._user == user:
            return
        for other in list(cls._all.values()):
            if user not in other.users:
                other.clear()
                other.old, other.held = {}, 0
        cls._user = user
        give_back()
