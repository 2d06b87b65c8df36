"""Tables whose rows are large: bounded bytes in the batches that functions yield, and few rows in a Parquet row group.

Batches that go to Python are bounded by Spark (`session.bounded`); those that come back, and those of
Parquet's readers (4096 rows, but never of two row groups), are as large as they were made.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parlance.session import folder

#: Bytes of arrays and texts after which a batch is full.
BYTES = 4 << 20
#: Rows of a row group.
ROWS = 16


def _bytes(value) -> int:
    return value.nbytes if isinstance(value, np.ndarray) else len(value) if isinstance(value, (bytes, str)) else 8


def batched(rows: Iterable[tuple], columns: str, most: int = BYTES) -> Iterator[pd.DataFrame]:
    """The rows in frames of about so many bytes; a row that is larger is in the frame it fills. `columns` may be a schema."""
    names, some, size = [c.split()[0] for c in columns.split(", ")], [], 0
    for row in rows:
        some.append(row)
        size += sum(map(_bytes, row))
        if size >= most:
            yield pd.DataFrame(some, columns=names)
            some, size = [], 0
    if some:
        yield pd.DataFrame(some, columns=names)


def write_large(df: DataFrame, path: str, rows: int = ROWS) -> None:
    """Parquet of large rows, which readers hold few of at a time."""
    df.write.option("parquet.block.row.count.limit", rows).parquet(path)


def kept(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """`df` written to the shared folder, and read again."""
    path = folder(df.sparkSession)
    write_large(df, path, rows)
    return df.sparkSession.read.schema(df.schema).parquet(path)
