"""Small tables written out once, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Inline:
    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """``name(columns) AS (VALUES …)``, to stand in a WITH clause."""
        one = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
        columns = [c.strip().split(" ")[0] for c in self.schema.split(",")]
        return f"{self.name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in self.rows)})"
