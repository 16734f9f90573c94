"""Shared pieces of the corpus operators: reading, Arrow maps, bounded memos, shared tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: ASCII white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], fn: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Apply ``fn(*column lists) -> rows`` to each Arrow batch of ``df``.

    ``fn`` sees only ``columns`` and yields tuples in the order of ``schema``. One batch is the unit of
    memory; rows go out in slices, so a batch that expands does not become one large output batch.
    """
    spark_schema: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row in fn(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                rows.append(row)
                if len(rows) >= 20_000:
                    yield _batch(rows, arrow)
                    rows = []
            if rows:
                yield _batch(rows, arrow)

    return df.select(*columns).mapInArrow(run, spark_schema)


def filter_rows(df: DataFrame, columns: list[str], fn: Callable[..., Iterable[bool]]) -> DataFrame:
    """Rows of ``df``, with all columns, for which ``fn(*column lists)`` gives true; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = list(fn(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in columns)))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of each word of all texts, the distinct words by number, words before each text and at the end).

    Words lie between the six ASCII white-space characters; a null text has none. All in Arrow's own code."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    del lists
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty one
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))[offsets]
    coded = (words if pc.all(real).as_py() else words.filter(real)).dictionary_encode()
    del words, real
    try:
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
    except (UnicodeDecodeError, pa.ArrowException):  # Spark's strings are bytes that may be no UTF-8
        known = [w.decode("utf-8", "replace") for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    return coded.indices.to_numpy(), known, before


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of rows that hold about ``most`` bytes of a column of texts at most, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)


class Memo(dict):
    """A memo of ``compute(key)`` in two generations that hold at most ``budget`` bytes together.

    When the young generation has its half it becomes the old one, and the old one goes. Keys in use move
    back to the young generation on their next use. Memory is bounded whatever the vocabulary and however
    large the values.
    """

    def __init__(self, compute: Callable, budget: int = 32 << 20):
        super().__init__()
        self.compute, self.half, self.held, self.old = compute, budget // 2, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        self.held += _bytes(key) + _bytes(value) + SLOT
        if self.held > self.half and self:
            self.old = dict(self)
            self.clear()
            self.held = _bytes(key) + _bytes(value) + SLOT
        self[key] = value

    def put_all(self, values: dict, size: int) -> None:
        """``values`` at once; ``size``: the bytes of their keys and values."""
        self.held += size + SLOT * len(values)
        if self.held > self.half and self:
            self.old = dict(self)
            self.clear()
            self.held = size + SLOT * len(values)
        self.update(values)


#: Bytes of a dictionary for each entry, its empty places and a number or two included.
SLOT = 130


def _bytes(x) -> int:
    """Bytes of a text or of a tuple with what it holds; numbers in tuples are taken to be shared or few."""
    return getsizeof(x) + sum([_bytes(y) for y in x if type(y) is not int]) if type(x) is tuple else getsizeof(x)


#: Per worker process: memos outlive a task when Spark reuses the worker.
_PER_PROCESS: dict = {}


def per_process(key, make: Callable):
    """The value ``make`` gave for ``key`` in this process.

    A key is a name or a tuple (name, version ...); of one name only the latest version stays. The part of a
    name before its first dash is the operator: when another operator asks, the values of the last one go, so
    a worker that serves several stages holds the memos of one."""
    name, version = (key[0], key[1:]) if isinstance(key, tuple) else (key, ())
    if name not in _PER_PROCESS or _PER_PROCESS[name][0] != version:
        operator = name.partition("-")[0]
        if gone := [n for n in _PER_PROCESS if n != "shared" and n.partition("-")[0] != operator]:
            for n in gone:
                del _PER_PROCESS[n]
            _give_back()
        _PER_PROCESS[name] = version, make()
    return _PER_PROCESS[name][1]


def release(operator: str) -> None:
    """Let go of what other operators hold in this worker; for operators that hold nothing themselves."""
    per_process(f"{operator}-here", dict)


def _give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one of our own if driver and executors are
    one process (tests); else an error, as no executor could read what another wrote."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "shared" not in _PER_PROCESS:
            _PER_PROCESS["shared"] = (), "file://" + tempfile.mkdtemp(prefix="brindle-")
        path = _PER_PROCESS["shared"][1]
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Folders of tables that results may still read; deleted when the driver ends.
_ROOTS: dict[str, SparkSession] = {}


@atexit.register
def _delete_roots() -> None:
    for path, spark in _ROOTS.items():
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)


#: Spark deletes a query's shuffle files when the query ends; a written table does not need them.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Tables written to the shared folder, to cut lineage; a lost executor loses none of their rows. An operator drops
    what its result does not read; the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/brindle-{name}-{uuid.uuid4().hex}"
        self.n = 0
        _ROOTS[self.root] = spark

    def path(self, label: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{label}"

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        conf = self.spark.conf
        before = conf.get(CLEAN_SHUFFLES, None)
        conf.set(CLEAN_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(CLEAN_SHUFFLES) if before is None else conf.set(CLEAN_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._brindle_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            if path := getattr(df, "_brindle_path", None):
                _delete(self.spark, path)

    def free(self) -> None:
        """Let Spark drop the shuffle files of frames that are no longer referenced, before the next stage fills the disk."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

