"""Payloads that need a parser of their own: read in Arrow batches, each failure kept to its payload."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of payloads that are parsed before their rows are handed on; a larger payload goes alone.
PIECE = 8 << 20
#: Characters that are kept of an error.
ERROR = 200


def by_bytes(batches, index: int, most: int = PIECE):
    """Arrow batches cut so that the texts of a piece, in column index, take about `most` bytes; a longer text stands alone."""
    for batch in batches:
        begin, held = 0, 0
        for i, size in enumerate(pa.compute.binary_length(batch.column(index)).to_pylist()):
            if i > begin and held + (size or 0) > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size or 0
        if batch.num_rows > begin:
            yield batch.slice(begin)


class Empty(ValueError):
    """A payload that was read and holds nothing."""


def parse_payloads(payloads: DataFrame, read: Callable[[str], list[tuple]], fields: str, column: str = "payload") -> DataFrame:
    """The other columns of payloads with pos, the fields and error: a row for each tuple that read gives.

    A payload that is null, can't be read or holds nothing gives one row with its error
    and nulls; it never fails the rows of others. Columns named like a field are replaced.
    """
    own = T._parse_datatype_string(fields)
    taken = {"pos", "error", column, *own.names}
    kept = [f for f in payloads.schema.fields if f.name not in taken]
    out = T.StructType([*kept, T.StructField("pos", T.IntegerType()), *own.fields, T.StructField("error", T.StringType())])
    arrow = list(to_arrow_schema(out))
    nothing = (None,) * len(own.fields)

    def one(text):
        try:
            if text is None:
                raise Empty("no payload")
            found = read(text)
            if not found:
                raise Empty("no entries")
            return [(i, *row, None) for i, row in enumerate(found)]
        except Exception as e:  # noqa: BLE001  any failure belongs to its payload alone
            return [(None, *nothing, str(e)[:ERROR] or type(e).__name__)]

    def run(batches):
        for batch in by_bytes(batches, len(kept)):
            found = [one(t) for t in batch.column(len(kept)).to_pylist()]
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            flat = [r for x in found for r in x]
            own_fields = arrow[len(kept) :]
            columns = [pa.array([r[j] for r in flat], f.type) for j, f in enumerate(own_fields)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(kept))), *columns], schema=pa.schema([*(batch.schema.field(i) for i in range(len(kept))), *own_fields]))

    return payloads.select(*[f.name for f in kept], F.col(column).cast("string").alias("_payload")).mapInArrow(run, out)
