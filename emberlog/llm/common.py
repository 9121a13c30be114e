"""What several training-data operators share: the shared folder and vectorised tokens."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: 0x20 and 0x09 to 0x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a regular expression for Spark and DuckDB.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[np.frombuffer(SPACES, np.uint8)] = True
#: Bytes that part terms: all of ASCII but letters and digits.
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 16
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if there:
        return there
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="emberlog-"))
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, keeps column pruning."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that nothing needs any more.

    It does so when the driver has collected the objects that stand for them, which on a driver with little to do may take very long.
    What the driver's process has freed outside its heap goes back to the system too: after some hundred jobs that is 200 MB and more,
    as each of the many threads that broadcast, shuffle or compile leaves some.
    """
    spark._jvm.System.gc()
    with contextlib.suppress(Py4JJavaError):  # not every JVM has this command
        _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Runs the JVM's command for giving freed memory back, by the interface of its MBean server, whose class Py4J can't call."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    name, no_values, no_types = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), gateway.new_array(jvm.Object, 0), gateway.new_array(jvm.String, 0)
    arguments, types = gateway.new_array(jvm.Object, 4), gateway.new_array(jvm.Class, 4)
    for i, x in enumerate((name, "systemTrimNativeHeap", no_values, no_types)):
        arguments[i] = x
    for i, x in enumerate((name.getClass(), jvm.Class.forName("java.lang.String"), no_values.getClass(), no_types.getClass())):
        types[i] = x
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, arguments)


def forget(table: DataFrame) -> None:
    """Deletes a table that ``written`` made and nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` after a reliable checkpoint in the shared folder; what was shuffled before it isn't needed then."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    _made[0] += 1
    if _made[0] % 4 == 0:
        tidy(df.sparkSession)
    return out


_made = [0]  # checkpoints so far
_NARROW_ROWS = 1 << 14  #: rows of a few numbers that are worth a task of their own


def narrow(df: DataFrame, least: int | None = None) -> DataFrame:
    """``checkpointed`` rows of a few numbers each, in no more partitions than they are worth, but ``least`` (else one for each core).

    A small table that a wide shuffle made costs as many tasks again in each step that reads it, however few its rows.
    """
    seen = Observation()
    out = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out.coalesce(max(least or df.sparkSession.sparkContext.defaultParallelism, -(-seen.get.get("n", 0) // _NARROW_ROWS)))


def small_batches(spark: SparkSession) -> None:
    """Lets batches of at most 2 MB go to Python workers, unless the session has a size of its own.

    With the default, a task's buffers for long texts take some 100 MB of an executor's memory outside its heap, and keep it.
    """
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)
    if spark.conf.get(name, default).rstrip("b") == default:
        spark.conf.set(name, "2m")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added as far as a column of ``df`` has one already, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def crc_mod_5(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers.get("up", ())) < n:
        n = max(n, _CHUNK)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def string_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array; nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def sliced(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches with at most so many bytes of ``text``, or one row, so that memory doesn't depend on the rows' length."""
    for b in batches:
        _, offs = string_buffer(b["text"])
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


class Words:
    """Words of a batch of texts as 64-bit hashes; ``parts`` tells for each byte whether it parts words.

    ``hash``: a hash of each word, in order; ``first``: index of the first word of each
    text, with the total at the end; ``start`` and ``stop``: byte places in ``raw``,
    the lower-cased bytes.
    """

    def __init__(self, texts: pa.Array, parts: np.ndarray = _IS_SPACE):
        raw, offs = string_buffer(texts)
        self.raw = raw = _LOWER[raw]
        n = len(raw)
        inside = ~parts[raw]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        cuts = offs[1:-1][offs[1:-1] < n]
        opens[cuts] = inside[cuts]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        cuts = cuts[cuts > 0] - 1
        closes[cuts] = inside[cuts]
        self.start, self.stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offs)
        self.hash = _hashes(raw, self.start, self.stop)

    def doc_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hash of each slice modulo 2**64, mixed; by chunks, so that tables stay small."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        to = max(at + 1, int(np.searchsorted(stop, base + _CHUNK, "right")))
        end = stop[to - 1]
        up, down = _power_tables(int(end - base) + 1)
        sums = np.zeros(end - base + 1, np.uint64)
        np.cumsum((raw[base:end].astype(np.uint64) + np.uint64(1)) * up[: end - base], out=sums[1:])
        s, e = start[at:to] - base, stop[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class HashTable:
    """A read-only map from 64-bit hashes to row numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask, self.keys = np.uint64((1 << bits) - 1), keys
        self.slot = np.full(1 << bits, -1, np.int32)
        rest, at = np.arange(len(keys), dtype=np.int32), (keys & self.mask).astype(np.int64)
        self.probes = 0
        while len(rest):
            self.probes += 1
            free = self.slot[at] < 0
            self.slot[at[free]] = rest[free]
            lost = self.slot[at] != rest
            rest, at = rest[lost], (at[lost] + 1) & int(self.mask)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Row number of each hash, -1 for those that aren't in the table."""
        out = np.full(len(x), -1, np.int32)
        if not len(self.keys):
            return out
        at, open_ = (x & self.mask).astype(np.int64), None
        for _ in range(self.probes):
            got = self.slot[at]
            hit = (got >= 0) & (self.keys[got] == (x if open_ is None else x[open_]))
            where = np.flatnonzero(hit) if open_ is None else open_[hit]
            out[where] = got[hit]
            more = (got >= 0) & ~hit
            open_ = np.flatnonzero(more) if open_ is None else open_[more]
            if not len(open_):
                break
            at = (at[more] + 1) & int(self.mask)
        return out
