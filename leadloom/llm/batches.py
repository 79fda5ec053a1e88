"""Arrow batches in Python tasks: pass columns through, add computed ones, in slices of bounded size."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from leadloom.session import ship

SLICE_BYTES = 4 << 20


def column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about ``most`` bytes of the text column, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + 16)
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of every text, empty for null."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def add_columns(df: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], list]], fields: list[StructField],
                carry: list[str]) -> DataFrame:
    """Columns ``carry`` of every row, unchanged, plus ``fields``.

    ``make`` runs once per task and gives a function from a slice of the text
    column to one array (or list) per field.  Columns travel under positions,
    so that names in ``df`` cannot clash with each other or with ``fields``;
    of equal names the added column wins.  No shuffle.
    """
    carry = [c for c in carry if c not in {f.name for f in fields}]
    n = len(carry)
    source = ship(df).select(*[column(c).alias(f"c{i}") for i, c in enumerate(carry)],
                       *([] if text in carry else [column(text).cast("string").alias("t")]))
    at = carry.index(text) if text in carry else n
    schema = StructType([StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carry)]
                        + [StructField(f"r{i}", f.dataType) for i, f in enumerate(fields)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        work, kinds = make(), to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, at):
                made = work(part.column(at))
                made = [x if isinstance(x, pa.Array) else pa.array(x, kinds.field(n + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + made, names=kinds.names)

    return source.mapInArrow(run, schema).toDF(*carry, *[f.name for f in fields])
