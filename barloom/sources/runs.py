"""Back-test runs kept by their parameters."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.store import Store


def save_run(store: Store, parameters: dict, rows: DataFrame) -> str:
    """Write the rows of a run and return its id, which the parameters decide: the same run again replaces itself.

    ``store`` is split by run_id and is made by the first run; all runs of a store have the same columns. The order of
    parameters doesn't matter.
    """
    text = json.dumps(parameters, sort_keys=True, ensure_ascii=False)
    run_id = hashlib.sha256(text.encode()).hexdigest()[:16]
    marked = rows.withColumns({"run_id": F.lit(run_id), "parameters": F.lit(text)})
    if store.exists():
        store.replace_partitions(marked)
    else:
        store.create(marked)
    return run_id


def compare_runs(store: Store, earlier: str, later: str, keys: list[str], value: str) -> DataFrame:
    """Keys, the value in both runs and its change; keys that only one run has stay, with nulls."""
    rows = store.read()
    a = rows.where(F.col("run_id") == earlier).select(*keys, F.col(value).alias("earlier"))
    b = rows.where(F.col("run_id") == later).select(*keys, F.col(value).alias("later"))
    return a.join(b, keys, "full").select(*keys, "earlier", "later", (F.col("later") - F.col("earlier")).alias("change"))
