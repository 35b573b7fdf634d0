"""Studies in two steps: a plan and a gate are written once, before any test row is scored, and never changed."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.operators import calibrate


def _written(spark: SparkSession, path: str) -> dict | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def frozen(spark: SparkSession, path: str, plan: dict) -> dict:
    """The plan, as it is in the folder from now on. Another plan in it raises ValueError: a changed study needs a folder of its own."""
    plan = json.loads(json.dumps(plan, sort_keys=True))
    found = _written(spark, path)
    if found is None:
        spark.createDataFrame([(json.dumps(plan, sort_keys=True),)], "value string").coalesce(1).write.text(path)
        found = _written(spark, path)
    if found != plan:
        raise ValueError(f"another plan is frozen in {path}")
    return found


def freeze_gate(scores: DataFrame, target: float, path: str, **provenance) -> float:
    """The gate of calibration scores (role, score), written with its provenance before it is returned. Scores of other roles than calibration unknowns
    raise ValueError: nothing of a test may be known yet."""
    if not scores.where(~F.col("role").startswith("calibration")).isEmpty():
        raise ValueError("only calibration rows may be scored before the gate is frozen")
    found = calibrate.threshold(scores.where("role = 'calibration_unknown'").select("score"), target).first()
    if found is None:
        raise ValueError("no calibration unknowns")
    plan = {"gate": found.gate, "unknowns": found.unknowns, "false_accepts": found.false_accepts, "target": target, **provenance}
    return frozen(scores.sparkSession, path, plan)["gate"]


def gate_of(spark: SparkSession, path: str) -> Column:
    """The frozen gate. Without one test rows can't be judged, and FileNotFoundError is raised."""
    found = _written(spark, path)
    if found is None:
        raise FileNotFoundError(f"no gate is frozen in {path}")
    return F.lit(found["gate"])


def helpful(before: DataFrame, after: DataFrame, counts: list[str]) -> bool:
    """Whether every count (flags of rows) is strictly larger after than before; only then does a study go on to held-out rows."""
    a, b = (df.agg(*(F.count_if(c).alias(c) for c in counts)).first() for df in (before, after))
    return all(b[c] > a[c] for c in counts)
