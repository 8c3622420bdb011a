"""Functions on texts in Arrow batches of which few values are Python's at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a batch that are Python's at once.
PIECE = 64


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[list]:
    for i in range(0, len(column), size):
        yield column.slice(i, size).to_pylist()


def by_pieces(kind: str, arrow: pa.DataType, of: Callable[[list], list | pa.Array], once: bool = False) -> Callable[[Column | str], Column]:
    """A column function from lists of values to as many results of a type, named for Spark and for Arrow.

    A batch stays in Arrow, before and behind the function, so a worker holds it and its results once, and not as objects.
    With once a plan doesn't repeat the function for what names its result twice: it may call a service.
    """

    def run(column: pa.Array) -> pa.Array:
        out = [x if isinstance(x, pa.Array) else pa.array(x, arrow) for x in map(of, pieces(column))]
        return pa.concat_arrays(out) if out else pa.array([], arrow)

    def column(x: Column | str) -> Column:  # a type's name needs a session, so it is read here
        made = F.arrow_udf(run, kind)
        return (made.asNondeterministic() if once else made)(x)

    return column
