"""Python functions with a DDL type, built at their first use (a type in words needs a session)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A Python worker holds about so many values at once; the rest of a batch stays in Arrow's form.
_ELEMENTS = 20_000


def lazy_udf(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        def column(*cols) -> Column:
            return F.pandas_udf(f, ddl)(*cols)

        column.__doc__, column.__name__, column.python = f.__doc__, f.__name__, f
        return column

    return wrap


def _weight(a: pa.Array) -> np.ndarray:
    """Values in each row of an array, lists within lists counted through; a long string counts as several."""
    if pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        inner = np.concatenate(([0], np.cumsum(_weight(a.values))))
        off = a.offsets.to_numpy()
        return 1 + inner[off[1:]] - inner[off[:-1]]
    if pa.types.is_struct(a.type):
        return sum((_weight(f) for f in a.flatten()), np.zeros(len(a), np.int64))
    if pa.types.is_string(a.type) or pa.types.is_large_string(a.type):
        return 1 + pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 16
    return np.ones(len(a), np.int64)


def pieces(arrays: tuple[pa.Array, ...], limit: int = _ELEMENTS) -> Iterator[list[pa.Array]]:
    """Row ranges of ``arrays`` with about ``limit`` values (one row at least)."""
    n = len(arrays[0])
    total = np.cumsum(sum((_weight(a) for a in arrays), np.zeros(n, np.int64)))
    start = 0
    while start < n:
        before = total[start - 1] if start else 0
        end = max(int(np.searchsorted(total, before + limit, side="right")), start + 1)
        yield [a.slice(start, end - start) for a in arrays]
        start = end


def _python(a: pa.Array) -> list:
    """``a.to_pylist()``; lists and numbers without nulls are turned into Python's all at once."""
    if pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        off = a.offsets.to_numpy()
        flat = _python(a.values.slice(off[0], off[-1] - off[0]))
        off = (off - off[0]).tolist()
        out = [flat[i:j] for i, j in zip(off, off[1:])]
        return [x if y else None for x, y in zip(out, a.is_valid().to_pylist(), strict=True)] if a.null_count else out
    return a.to_numpy().tolist() if (pa.types.is_integer(a.type) or pa.types.is_float64(a.type)) and not a.null_count else a.to_pylist()


def row_udf(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function of one row's values; a batch is worked on in pieces, so that memory does not follow its size."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def column(*cols) -> Column:
            kind = to_arrow_type(T.DataType.fromDDL(ddl))

            def run(batches):
                for batch in batches:
                    for piece in pieces(batch if isinstance(batch, tuple) else (batch,)):
                        yield pa.array([f(*row) for row in zip(*map(_python, piece), strict=True)], kind)

            run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]] if len(cols) > 1 else Iterator[pa.Array], "return": Iterator[pa.Array]}
            return F.arrow_udf(run, ddl)(*cols)

        column.__doc__, column.__name__, column.python = f.__doc__, f.__name__, f
        return column

    return wrap
