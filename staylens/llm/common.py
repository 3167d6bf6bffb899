"""Helpers shared by the operators of this subpackage.

``annotate`` runs a per-text function inside Arrow batches and adds its result as
one struct column, so no output name can clash with a column of the table.
``stored(df, name)`` cuts lineage with a Parquet table in the shared folder that
``spark.checkpoint.dir`` names; such tables are removed when the driver ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from staylens._util import qcol
from staylens.session import cut_lineage as stored  # noqa: F401 (used by the operators)

#: Rows handed to a per-text function at once.
SLICE_ROWS = 512

# Lower-cases A-Z; turns every other ASCII byte that is no letter or digit into a
# space. Bytes from 0x80 up stay, so multi-byte characters are parts of words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def folded_words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


def free_name(wanted: str, *tables: DataFrame) -> str:
    """``wanted``, with underscores added while a table has a column of that name."""
    taken = {c.lower() for t in tables for c in t.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(spark: SparkSession, value) -> Callable:
    """Broadcasts ``value``; returns the function by which a task gets it. The caller
    states what bounds its size."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(packed.value)


def annotate(df: DataFrame, text: str, out: str, ddl: str, start: Callable[[], Callable],
             keep: Iterable[str] | None = None, binary: bool = True) -> DataFrame:
    """``keep`` columns (default: all) and a struct column ``out`` made from ``text``.

    ``start()`` runs once per task and returns a function from a list of texts (UTF-8
    bytes, or str if not ``binary``; NULL is the empty text) to a list of tuples, the
    fields of ``ddl``. Narrow: no shuffle, memory bounded by ``SLICE_ROWS`` texts.
    """
    names = list(df.columns if keep is None else keep)
    struct = StructType.fromDDL(ddl)
    fields = list(df.select(*[qcol(c) for c in names]).schema.fields)
    text_name = free_name("text_", df)
    source = df.select(*[qcol(c) for c in names], qcol(text).cast("string").alias(text_name))
    if text in names:  # the text travels once
        source = df.select(*[qcol(c) for c in names])
    at = names.index(text) if text in names else len(names)
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in struct.fields]
    width = len(names)

    def run(batches):
        work = start()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                texts = part.column(at)
                if binary:
                    texts = texts.cast(pa.binary())
                empty = b"" if binary else ""
                rows = work([empty if v is None else v for v in texts.to_pylist()])
                columns = list(zip(*rows)) if rows else [()] * len(arrow)
                made = pa.StructArray.from_arrays(
                    [pa.array(c, t) for c, (_, t) in zip(columns, arrow)],
                    fields=[pa.field(n, t) for n, t in arrow])
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(width)] + [made],
                    names=[part.schema.names[i] for i in range(width)] + [out])

    return source.mapInArrow(run, StructType([*fields, StructField(out, struct)]))


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
