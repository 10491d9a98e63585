"""Helpers shared by the pipeline operators: table reads, word rules, hashing and sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than blank and the five control blanks.
WORD = r"[^\x20\x09-\x0D]+"

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_MUL = np.uint64(0xBF58476D1CE4E5B9)
_MUL2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that travel to Python together.
BATCH_ROWS = 1_000


def short_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches hold at most ``BATCH_ROWS`` rows.

    The memory of a Python worker follows its largest batch of whole texts.  A session
    that asks for fewer rows keeps its setting.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return docs


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MUL
    x ^= x >> np.uint64(27)
    x *= _MUL2
    x ^= x >> np.uint64(31)
    return x


def encode(texts) -> list[bytes]:
    """UTF-8 bytes; NULL is the empty text, a lone surrogate becomes '?'."""
    return [b"" if t is None else t.encode("utf-8", "replace") for t in texts]


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one scan and one number, used to size groups."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def gram_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """Mixed hash of the run of ``size`` symbols that starts at each place where one fits, as wide as a symbol.

    Spans are doubled and joined, so the work grows with the logarithm of the size.
    """
    kind = symbols.dtype.type
    range_ = 1 << 8 * symbols.dtype.itemsize
    n = len(symbols) - size + 1
    if n <= 0:
        return np.empty(0, kind)
    power, span, part, out, done = 0x9E3779B97F4A7C15 % range_, 1, symbols, None, 0
    while True:
        if size & span:
            piece = part[done : done + n]
            out = piece if out is None else out * kind(power) + piece
            done += span
        if span * 2 > size:
            return mix(out) if kind is np.uint64 else mix_short(out)
        part = part[: len(part) - span] * kind(power) + part[span:]
        power, span = power * power % range_, span * 2


def mix_short(x: np.ndarray) -> np.ndarray:
    """A bijective 32-bit finaliser."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def beside(rows: DataFrame, work: Callable[[list], list], made: str) -> DataFrame:
    """``rows`` with the column ``text`` replaced by the columns ``made``, which ``work(texts)`` gives in order.

    The other columns stay Arrow arrays on their way through Python: pandas would turn
    whole numbers beside a NULL into doubles, which round those above 2**53.
    """
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept] + [f.split()[0] for f in made.split(", ")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c if isinstance(c, pa.Array) else pa.array(c) for c in work(batch.column("text").to_pylist())]
            held = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(held + found, names=names)

    return rows.mapInArrow(run, schema)


def only_where(rows: DataFrame, test: Callable[[list], np.ndarray]) -> DataFrame:
    """The rows, untouched, for whose ``text`` the test holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.asarray(test(batch.column("text").to_pylist()), bool)))

    return rows.mapInArrow(run, rows.schema)
