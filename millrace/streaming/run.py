"""Queries over files as they arrive. The algebra has no event time: projections, masks and filters
run on a stream as they are; what needs an order or a whole table does not."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.operators.relation import Relation
from millrace.plans.builder import Query
from millrace.types import AlgebraError

STATELESS = {"filter", "mask", "compact", "rename", "append", "prepend", "cast", "connector", "semi_join", "equi_join"}


def stream(spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet") -> Relation:
    """Files of a folder as they arrive."""
    return Relation(spark.readStream.format(fmt).schema(schema).load(folder))


def start(query: Query, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the query's rows to Parquet files at path, each input file once."""
    if wrong := [s.name for s in query.steps if s.name not in STATELESS]:
        raise AlgebraError(f"not on a stream: {', '.join(wrong)}")
    writer = query.to_df().writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
