"""What a query will do, read from its formatted plan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
_CARTESIAN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def python_nodes(plan: str) -> list[str]:
    return [name for name in _PYTHON if name in plan]


def cartesian_nodes(plan: str) -> list[str]:
    return [name for name in _CARTESIAN if name in plan]


def shuffles(plan: str) -> int:
    """Exchanges between stages, not counting broadcasts."""
    tree = plan.split("\n\n")[0]
    return len(re.findall(r"[-:] Exchange \(", tree))


def scans(plan: str) -> int:
    tree = plan.split("\n\n")[0]
    return len(re.findall(r"Scan parquet", tree))


def join_keys(plan: str) -> list[str]:
    """Key lists of every join in the plan."""
    return re.findall(r"(?:Left|Right) keys \[\d+\]: \[(.*?)\]", plan)


def pushed_filters(plan: str) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)\]\n", plan)


def read_columns(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<(.*?)>\n", plan)
