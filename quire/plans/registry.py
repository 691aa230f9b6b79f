"""Registration of queries beside their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans.views_sql import VIEWS
from quire.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


#: Spark's setting (true unless set) by which a join deals out again what is dealt by fewer keys than its own.
PART_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Spark's setting (true unless set) by which lists are gathered in a hash table that gives way to a sort after 128 groups.
HASHED_LISTS = "spark.sql.execution.useObjectHashAggregateExec"


class Tables:
    """The tables of one folder, and the views derived from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        spark.conf.set(PART_KEYS, "true")
        spark.conf.set(HASHED_LISTS, "true")

    def by_document(self) -> None:
        """Joins by document and more take rows that are dealt by document as they are; no document exceeds a row of its table.

        Lists of a line or page are gathered from rows in its order, as the windows before leave them.
        """
        self.spark.conf.set(PART_KEYS, "false")
        self.spark.conf.set(HASHED_LISTS, "false")

    def parts(self) -> int:
        """Parts of the text layer: one to 8 MB of documents, so that they grow with the table and not in size."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/documents.parquet")
        size = path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        return max(context.defaultParallelism, size >> 23)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.root}/{name}.parquet")
        build = getattr(views, name, None)
        if build is None:
            raise AttributeError(name)
        return build(self)


def with_views(sql: str) -> str:
    """Prefix the views (``v_*``) a statement names, dependencies first."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS and name not in wanted:
                need(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    need(sql)
    if not wanted:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in wanted)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with the SQL that should return the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return add
