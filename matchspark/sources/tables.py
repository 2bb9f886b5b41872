"""Table sources: Parquet (default) or JDBC, behind one small descriptor.

JDBC reads are split into ``num_partitions`` range scans on a numeric column so that a large
relational table is never pulled through one connection / one task.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def jdbc_options_from_url(url: str) -> dict[str, str]:
    """Translate a ``postgresql://user:pass@host:port/db?schema=s`` URL into JDBC options.

    The ``schema`` query parameter is not understood by the driver, so it is stripped from
    the URL and passed on as ``currentSchema``.
    """
    u = urlparse(url)
    if u.scheme not in ("postgresql", "postgres"):
        raise ValueError(f"unsupported scheme: {u.scheme}")
    host = u.hostname or "localhost"
    port = f":{u.port}" if u.port else ""
    opts = {"url": f"jdbc:postgresql://{host}{port}{u.path}", "driver": "org.postgresql.Driver"}
    if u.username:
        opts["user"] = u.username
    if u.password:
        opts["password"] = u.password
    q = parse_qs(u.query)
    if "schema" in q:
        opts["currentSchema"] = q["schema"][0]
    return opts


@dataclass(frozen=True)
class TableSource:
    """Where an entity table lives: ``parquet`` path or ``jdbc`` table."""

    format: str
    location: str
    url: str | None = None
    partition_column: str | None = None
    lower_bound: int | None = None
    upper_bound: int | None = None
    num_partitions: int | None = None
    options: dict = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        if self.format == "parquet":
            return spark.read.options(**self.options).parquet(self.location)
        if self.format == "jdbc":
            opts = dict(jdbc_options_from_url(self.url)) if self.url else {}
            opts.update(self.options)
            opts["dbtable"] = self.location
            if self.partition_column:
                opts.update(
                    partitionColumn=self.partition_column,
                    lowerBound=str(self.lower_bound),
                    upperBound=str(self.upper_bound),
                    numPartitions=str(self.num_partitions or 8),
                )
            return spark.read.format("jdbc").options(**opts).load()
        raise ValueError(f"unknown format {self.format}")
