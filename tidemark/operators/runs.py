"""Runs as data: who may start, what is pinned, how a run ended, and which one counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.streaming.incremental import pending

LOG = "item string, fingerprint string, inputs string, status string, reason string, completed_at timestamp"


def eligibility(items: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """items with why they can't run (every rule that holds, in order) and whether they can."""
    why = T.reasons(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])
    return items.withColumn("ineligible_reason", why).withColumn("eligible", why.isNull())


def planned(items: DataFrame, log: DataFrame, fingerprint: str, inputs: Column, force: bool = False) -> DataFrame:
    """Items to run: eligible, and without a finished run of the same fingerprint over the same pinned inputs."""
    todo = items.where("eligible").withColumn("inputs", inputs)
    done = log.where(F.col("status").isin("COMPLETED", "COMPLETED_WITH_WARNINGS")).select("item", "inputs", "fingerprint")
    return pending(todo, done, ["item", "inputs"], fingerprint, force)


def logged(results: DataFrame, at: Column) -> DataFrame:
    """Rows for the run log of results (item, fingerprint, inputs, problem, warning)."""
    status = F.when(F.col("problem").isNotNull(), F.lit("FAILED")).when(F.col("warning").isNotNull(), F.lit("COMPLETED_WITH_WARNINGS")).otherwise(F.lit("COMPLETED"))
    return results.select("item", "fingerprint", "inputs", status.alias("status"), F.coalesce("problem", "warning").alias("reason"), at.alias("completed_at"))


#: What may follow a publication's state (fixed values).
NEXT = {"BUILDING": ("VALIDATING", "FAILED"), "VALIDATING": ("READY", "FAILED"), "READY": ("ACTIVE",), "ACTIVE": ("SUPERSEDED",), "FAILED": (), "SUPERSEDED": ("ACTIVE",)}


def moved(status: Column, to: str) -> Column:
    """The state after a step; raises if it can't follow."""
    allowed = [s for s, after in NEXT.items() if to in after]
    return F.when(status.isin(*allowed), F.lit(to)).otherwise(F.raise_error(F.concat(F.lit(f"can't become {to} from "), status)))


def compatible(earlier: DataFrame, later: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, reason): why two sides' runs can't be compared; null if they can."""
    e, w = (df.select(key, *[F.col(f).alias(f"{p}{f}") for f in fields], F.lit(True).alias(f"{p}there")) for df, p in ((earlier, "e_"), (later, "l_")))
    both = e.join(w, key, "full_outer")
    why = T.reasons(F.when(F.col("e_there").isNull(), F.lit("no earlier run")), F.when(F.col("l_there").isNull(), F.lit("no later run")), *[F.when(F.col(f"e_{f}") != F.col(f"l_{f}"), F.lit(f"different {f}")) for f in fields])
    return both.select(key, why.alias("reason"))
