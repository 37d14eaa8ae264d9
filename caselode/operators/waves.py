"""Batches that are still open, and the staged jobs of items, as relations.

A batch with a SUCCEEDED receipt for the same input is done, however often
work is started anew; a batch whose input has changed is open again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def open_batches(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Batches of the plan without a SUCCEEDED receipt for their input."""
    good = done.where("status = 'SUCCEEDED'").select("batch", "input").distinct()
    return plan.join(good, ["batch", "input"], "left_anti")


#: Kinds of work and the kind whose end each waits for.
STAGES = {"FETCH": None, "IMAGES": "FETCH", "REFRESH": "IMAGES", "ENRICH": "REFRESH", "FIELDS": "ENRICH"}


def staged(items: DataFrame, key: str, stages: dict[str, str | None] = STAGES) -> DataFrame:
    """(key, kind, needs): the jobs of each item, one a stage, each needing the stage before."""
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).cast("string").alias("after")) for k, v in stages.items()])
    jobs = items.select(F.col(key).cast("string").alias("item"), F.inline(rows))
    return jobs.select("item", "kind", F.concat_ws(":", "item", "kind").alias("job_id"), F.when(F.col("after").isNotNull(), F.concat_ws(":", "item", "after")).alias("needs"))
