"""What the operators of this package share: texts in Arrow batches, byte tables, written tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lotgrain.session import shared_folder

#: Texts are handed on in slices of about this many bytes, however long the rows are.
SLICE_BYTES = 16 << 20

#: A-Z to a-z, and every ASCII character that is no digit or letter to a space.
LETTERS_AND_DIGITS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters; none for null."""
    return text.translate(LETTERS_AND_DIGITS).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words between spaces, tabs and line ends (bytes 9 to 13 and 32), unchanged; none for null."""
    return text.split() if text else []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder all executors share, read back: lineage ends here."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What this worker process keeps for further tasks of one operator, by a number.
_KEPT: dict[int, object] = {}


def kept(number: int, make: Callable[[], object]):
    """What ``make`` gives, once per worker process, until a task of another operator lets go of it."""
    let_go(number)
    if number not in _KEPT:
        _KEPT[number] = make()
    return _KEPT[number]


def let_go(but: int | None = None) -> None:
    """Drop what tasks of other operators kept: a worker process serves one stage after the other."""
    others = [n for n in _KEPT if n != but]
    for n in others:
        del _KEPT[n]
    if others:
        give_back()


def slices(
    batches: Iterator[pa.RecordBatch], text: str, keeps: int | None = None
) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Each batch in pieces of bounded text size, with the texts as UTF-8 bytes; ``keeps`` is what the task goes on to use."""
    let_go(keeps)
    for batch in batches:
        texts = batch.column(text).cast(pa.large_binary()).to_pylist()
        start = size = 0
        for i, value in enumerate(texts):
            size += len(value or b"")
            if size >= SLICE_BYTES or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def with_text_columns(
    df: DataFrame,
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list[bytes | None], pa.RecordBatch], list]],
    text: str = "text",
    keep: list[str] | None = None,
    read: list[str] | None = None,
    keeps: int | None = None,
) -> DataFrame:
    """``df`` with columns computed from its texts inside the tasks.

    ``make`` runs once per task and gives a function from the texts of a slice, and the slice
    itself, to one list or Arrow array per field. It may read the columns in ``read`` beside
    the kept ones. ``keep`` names the input columns that stay (all by default); one
    that has the name of a new column gives way to it.
    """
    names = {n.lower() for n, _ in fields}
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    schema = T.StructType([df.schema[c] for c in stay] + [T.StructField(n, t) for n, t in fields])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part, texts in slices(batches, text, keeps):
            new = [
                c if isinstance(c, pa.Array) else pa.array(c, arrow.field(n).type)
                for (n, _), c in zip(fields, work(texts, part), strict=True)
            ]
            old = [part.column(c).cast(arrow.field(c).type) for c in stay]
            yield pa.RecordBatch.from_arrays(old + new, schema=arrow)
            del part, texts, new, old
        del work
        give_back()

    wanted = list(dict.fromkeys([*stay, text, *(read or [])]))
    return df.select(*[f"`{c}`" for c in wanted]).mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if a column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_schema(fields: str | T.StructType) -> pa.Schema:
    """The Arrow schema of a DDL string or a Spark schema; made on the driver, used in tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(fields) if isinstance(fields, str) else fields)


def run_lengths(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each of the runs of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
