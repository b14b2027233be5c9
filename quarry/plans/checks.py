"""Plan inspection helpers (used by tests and when tuning)."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    """Formatted physical plan (AQE initial plan; nothing is executed)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def read_schemas(plan: str, table: str) -> list[str]:
    """ReadSchema of every scan of ``<table>.parquet`` in a formatted plan."""
    out = []
    for block in plan.split("\n\n"):
        if f"{table}.parquet" in block:
            m = re.search(r"ReadSchema: (.*)", block)
            if m:
                out.append(m.group(1))
    return out


def partial_group_limit_before_exchange(plan: str) -> bool:
    """True when a WindowGroupLimit runs below (before) a shuffle Exchange."""
    tree = plan.split("\n\n")[0]
    lines = tree.splitlines()
    for i, line in enumerate(lines):
        if "Exchange" in line and "Broadcast" not in line:
            below = "\n".join(lines[i + 1:])
            if "WindowGroupLimit" in below:
                return True
    return False


def unfiltered_text_exchanges(df: DataFrame, column: str) -> list[str]:
    """Shuffles whose rows hold ``column`` straight from a scan, with no join in between."""
    out: list[str] = []

    def walk(node) -> bool:
        """True when the rows of ``node`` are those of a scan with the column."""
        name, kids = node.nodeName(), [node.children().apply(i) for i in range(node.children().size())]
        below = [walk(k) for k in kids]
        has = f"{column}#" in node.output().mkString(",")
        if name.startswith("Scan"):
            return has
        whole = has and any(below) and "Join" not in name
        if "Exchange" in name and "Broadcast" not in name and whole and "RoundRobin" not in node.simpleString(200):
            out.append(node.simpleString(200))
        return whole

    plan = df._jdf.queryExecution().executedPlan()
    walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return out
