"""Reading the given tables, and writing what several steps read."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.session import shared_dir


#: Rows of an Arrow batch that a task works on together; what it holds beside the batch is in proportion.
ROWS_AT_ONCE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, and safe when an executor is lost."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def set_aside(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_id and text, and all other columns under names that no operator uses."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"_aside_{i}" for i, c in enumerate(docs.columns)))


def brought_back(rows: DataFrame, docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` out of rows that come from ``set_aside``, some with a ``new`` value."""
    names = set_aside(docs).columns
    return [new.get(c, rows[n]).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def with_columns_of(
    df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: list[tuple[str, T.DataType]]
) -> DataFrame:
    """``df`` and columns that ``make`` computes from each Arrow batch; columns of the same name are replaced."""
    names = {n.lower() for n, _ in added}
    kept = [c for c in df.columns if c.lower() not in names]
    schema = T.StructType(
        [f for f in df.schema.fields if f.name in kept] + [T.StructField(n, t) for n, t in added]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                new = make(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept] + [new[n] for n, _ in added], kept + [n for n, _ in added]
                )

    return df.mapInArrow(run, schema)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
