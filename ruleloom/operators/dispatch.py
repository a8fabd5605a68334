"""Records of very many schemas: parted once by schema, then validated schema by schema.

``routing.validate_routed`` runs all its routes in one pass, so its plan and what a record pays grow with the number of routes.  Here
the records are dealt once to folders by route, and every route is a small job over its own folder: a record is compared with one
table of names, parsed once, and meets only its own rules, however many routes there are.
"""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.sqltext import quote
from ..streaming.jobs import work_folder
from ..streaming.replay import BATCH
from .routing import Route, validate_routed

# The route of records that no rules apply to.
OTHERS = -1
ROUTE = "__route"


def numbered(df: DataFrame, routes: dict[str, Route], schema_column: str, payload: str) -> DataFrame:
    """The records with the number of their route, found by one lookup."""
    names = [name for name, route in routes.items() if route.rules.steps]
    number = F.lit(OTHERS)
    if names:
        table = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit(n) for n in range(len(names)))))
        found = F.try_element_at(table, F.col(quote(schema_column)).cast("string"))
        number = F.when(F.col(quote(payload)).isNotNull(), F.coalesce(found, number)).otherwise(number)
    return df.withColumn(ROUTE, number)


def validate_dispatched(
    df: DataFrame, routes: dict[str, Route], *, schema_column: str = "schema_name", payload: str = "payload", flag: str | None = None,
    error_column: str | None = None, path: str | None = None, part: str = "", jobs: int = 8, **options,
) -> DataFrame:
    """What ``validate_routed`` gives for a batch of records, for hundreds of routes.

    The records are written twice: once parted by route (a route with most of the records is split over tasks, small ones share them),
    and validated, below ``path`` (a new folder unless given) in ``dealt``, which is removed at the end, and ``done``; ``part`` names a folder
    in each, whose former content is replaced.  So many ``jobs`` run side by side.  The first failing one ends the call.
    """
    if ROUTE in df.columns:
        raise ValueError(f"there is a column {ROUTE!r} already")
    spark = df.sparkSession
    base = path or work_folder(spark, "dispatched")
    dealt_to, done_to = (f"{base}/{kind}/{part}".rstrip("/") for kind in ("dealt", "done"))
    names = [name for name, route in routes.items() if route.rules.steps]
    dealt = numbered(df, routes, schema_column, payload).hint("rebalance", ROUTE)
    dealt.write.mode("overwrite").partitionBy(ROUTE).parquet(dealt_to)
    present = _routes_in(spark, dealt_to)
    _remove(spark, done_to)
    kinds = validate_routed(df.limit(0), {}, schema_column=schema_column, payload=payload, flag=flag, error_column=error_column, **options).schema

    # Permissive formulas are analysed under another setting of the session, so by one thread at a time; they run side by side.
    planning = threading.Lock() if options.get("mode") == "permissive" else nullcontext()

    def one(number: int) -> None:
        own = spark.read.schema(df.schema).parquet(f"{dealt_to}/{ROUTE}={number}")
        chosen = {names[number]: routes[names[number]]} if number != OTHERS else {}
        with planning:
            done = validate_routed(own, chosen, schema_column=schema_column, payload=payload, flag=flag, error_column=error_column, **options)
        done.write.mode("overwrite").parquet(f"{done_to}/{ROUTE}={number}")

    with ThreadPoolExecutor(max_workers=jobs) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(one), number) for number in present]
        for job in running:
            job.result()
    folders = [f"{done_to}/{ROUTE}={number}" for number in present]
    _remove(spark, dealt_to)
    return spark.read.schema(kinds).parquet(*folders) if folders else spark.createDataFrame([], kinds)


def _folder(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _remove(spark: SparkSession, name: str) -> None:
    system, path = _folder(spark, name)
    system.delete(path, True)


def _routes_in(spark: SparkSession, name: str) -> list[int]:
    """The routes that have a folder."""
    system, path = _folder(spark, name)
    found = (status.getPath().getName() for status in system.listStatus(path))
    return sorted(int(folder.removeprefix(f"{ROUTE}=")) for folder in found if folder.startswith(f"{ROUTE}="))


def read_dispatched(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that a stream has written, with the number of their batch."""
    own = [f for f in schema.fields if f.name not in (BATCH, ROUTE)]
    found = T.StructType([*own, T.StructField(BATCH, T.LongType()), T.StructField(ROUTE, T.IntegerType())])
    return spark.read.schema(found).parquet(f"{path}/done").drop(ROUTE)


def dispatch_stream(
    messages: DataFrame, routes: dict[str, Route], path: str, checkpoint: str, *, name: str | None = None, interval: str | None = None, **options
) -> StreamingQuery:
    """Validate a stream of many schemas batch by batch; each batch has a folder of its own below ``path``, and a replay overwrites it."""
    def write(batch: DataFrame, number: int) -> None:
        validate_dispatched(batch, routes, path=path, part=f"{BATCH}={number}", **options)

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
