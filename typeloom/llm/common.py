"""Helpers that several of the operators share: whole texts, words, shared storage."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as characters and as a Java regex class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    Catalyst may inline a projected column into a lambda, where it would be computed
    again for each element; a lambda's variable is a value already.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for an empty text.

    Replacing the five rarer blanks first lets the split go by a plain character.
    """
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


#: Punctuation and blanks of ASCII (lower case), Latin-1, and the general and CJK punctuation blocks, as a regex class.
BREAKS = "[\x00-/:-`{-\x7f\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]+"


def plain_words_of(text: Column) -> Column:
    """Lower-case words between blanks and punctuation (see BREAKS)."""
    return F.array_remove(F.split(F.lower(text), BREAKS), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may go without it; it gets a temporary folder of its own.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="typeloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    home = f"{at.rstrip('/')}/typeloom-{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES[home] = True
        atexit.register(remove, spark, home)
    return home


_HOMES: dict[str, bool] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a shared file system, by Spark's view of it or, once the session has ended, by pyarrow's."""
    if spark.sparkContext._jsc is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        return
    from pyarrow import fs

    try:
        where, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        where.delete_dir(at)
    except (OSError, pa.ArrowInvalid):
        return  # already gone, or a file system that only Spark knows: its owner clears spark.checkpoint.dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost
    executor costs no recomputation of what led to it."""
    spark, at = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    _STORED[id(out)] = weakref.ref(out), at
    return out


#: Where the tables of ``stored`` are, by the DataFrame that was given out.
_STORED: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these DataFrames; nothing that is still to be computed may read them."""
    for df in tables:
        ref, at = _STORED.pop(id(df), (None, ""))
        if ref is not None and ref() is df:
            remove(df.sparkSession, at)


def free_name(base: str, *frames: DataFrame) -> str:
    """``base``, lengthened until no column of ``frames`` is called so in any case."""
    taken_names = {c.lower() for df in frames for c in df.columns}
    while base.lower() in taken_names:
        base += "_"
    return base


def with_own(df: DataFrame, **own: Column) -> DataFrame:
    """``df`` with further columns; one of the same name is replaced."""
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in {k.lower() for k in own}], *[v.alias(k) for k, v in own.items()])


def kept_in_process(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gave in this Python process when first asked; workers are used for many tasks.

    Only for what can be made again from its name at any time, such as a cache.
    """
    store = sys.modules.setdefault("_typeloom_kept", types.ModuleType("_typeloom_kept"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, in slices of about ``most`` bytes of a column, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    pieces = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(batch)]
    for first, last in zip(cuts, cuts[1:], strict=False):
        if last > first:
            yield batch.slice(first, last - first)


def strings(values: pa.Array) -> list:
    """The values as a list, through numpy: some twenty times faster than one scalar after the other."""
    return values.to_numpy(zero_copy_only=False).tolist()


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string begins and ends (one place more than strings), and the bytes that these places are in."""
    at, data = (np.frombuffer(b, dtype=kind) if b is not None else np.empty(0, dtype=kind) for b, kind in zip(values.buffers()[1:], (np.int32, np.uint8), strict=True))
    return at[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(at) else np.zeros(1, dtype=np.int64), data


def taken(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``first`` and hold ``counts`` each, one after the other."""
    return values[np.repeat(first - (np.cumsum(counts, dtype=np.int64) - counts), counts) + np.arange(int(counts.sum()))]


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct white-space separated words of some texts, each word's number among them, and the first word of each text.

    The third array has one entry more than there are texts.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = pc.dictionary_encode(split.flatten())
    starts = np.asarray(split.offsets) - split.offsets[0].as_py()
    return coded.dictionary, np.asarray(coded.indices), starts


def totals(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each of the ranges that ``starts`` bounds."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[starts[1:]] - sums[starts[:-1]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
