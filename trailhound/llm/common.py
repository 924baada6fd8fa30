"""What the operators of this package share: reading tables and Arrow batch plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows a task turns into Python objects at a time; texts may be long.
SLICE_ROWS = 512
#: Characters after which a slice of rows ends early.
SLICE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most SLICE_ROWS rows and about SLICE_BYTES bytes of text."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text)))
    begin, held = 0, 0
    for i, size in enumerate(sizes.to_pylist()):
        if i > begin and (i - begin >= SLICE_ROWS or held + (size or 0) > SLICE_BYTES):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size or 0
    if batch.num_rows > begin:
        yield batch.slice(begin)


def map_batches(df: DataFrame, work: Callable[[dict], dict], schema: str, text: str = "text") -> DataFrame:
    """Rows through `work`, which gets and returns columns as a dict of lists or arrays.

    `work` is made per task by `work.start()` when it has state, so that running numbers
    begin anew with every task and attempt.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        call = work.start() if hasattr(work, "start") else work
        for batch in batches:
            for part in slices(batch, text):
                out = call(part.to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, spark_schema)
