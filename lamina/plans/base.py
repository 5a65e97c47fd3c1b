"""Input of the query catalogue: tables, and the print that events stand for, in Spark and in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ints import int_div

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries by name, with the SQL that gives the same rows."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer, pos, sector, value: a layer for each user, a pixel for each event, in the order of the event ids."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    value = F.when(F.col("k") < 30, 0).when(F.col("k") > 69, 255).otherwise(int_div(F.col("k") * 255, 99)).cast("int")
    sector = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2).otherwise(0)
    pos = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return e.select(F.col("user_id").alias("layer"), pos.alias("pos"), sector.alias("sector"), value.alias("value"))


#: The same in SQL.
PIXELS = """px AS (
  SELECT user_id AS layer, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
    CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS sector,
    CASE WHEN k < 30 THEN 0 WHEN k > 69 THEN 255 ELSE (k * 255) // 99 END AS value
  FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k FROM events))"""


def runs_sql(value: str, name: str) -> str:
    """CTEs with the maximal runs of an expression over px."""
    return f"""{name}_a AS (SELECT layer, pos, {value} AS v FROM px),
{name}_b AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY layer ORDER BY pos) <> v THEN 1 ELSE 0 END AS n FROM {name}_a),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY layer ORDER BY pos) AS r FROM {name}_b),
{name} AS (SELECT layer, r AS run_idx, min(pos) AS s, max(pos) + 1 AS e, any_value(v) AS value, max(pos) + 1 - min(pos) AS len,
  r = max(r) OVER (PARTITION BY layer) AS is_last FROM {name}_c GROUP BY layer, r)"""


CORE = "CASE WHEN value >= 128 THEN 255 ELSE 0 END"
RUNS = f"WITH {PIXELS},\n{runs_sql('value', 'runs')}"
CORE_RUNS = f"WITH {PIXELS},\n{runs_sql(CORE, 'core')}"


def planes_sql(prefix: str) -> str:
    """Bytes of an array from its plane counts."""
    return " + ".join(f"({varint_sql(f'coalesce({prefix}{j}, 0)')} + coalesce({prefix}{j}, 0))" for j in range(4))


def plane_counts_sql(value: str, prefix: str, where: str = "true") -> str:
    return ", ".join(f"count(*) FILTER (({where}) AND {value} >= {(1 << (7 * j)) if j else 0}) AS {prefix}{j}" for j in range(4))


def varint_sql(x: str) -> str:
    return f"(1 + ({x} >= 128)::INT + ({x} >= 16384)::INT + ({x} >= 2097152)::INT)"
