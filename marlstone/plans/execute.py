"""Running one statement: gate, Spark SQL, and a bounded result with exact values."""

from __future__ import annotations

import base64
import datetime
import decimal
import math
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans.gate import assess_spark, permit

ROW_CAP, TIMEOUT_S, EXACT_INTEGER = 10_000, 60, 2**53 - 1


@dataclass(frozen=True)
class Result:
    """Columns, rows of exact JSON values, time, and whether rows were left out."""

    columns: list[str]
    rows: list[list[object]] = field(repr=False)
    elapsed_ms: int
    truncated: bool


def exact(value: object) -> object:
    """A JSON value that loses nothing: decimals and integers beyond 2^53-1 as text,
    dates and times in ISO form, bytes as base64. ValueError for a float that is not
    finite, TypeError for anything unknown."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        return value if abs(value) <= EXACT_INTEGER else str(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a value is not finite")
        return value
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, (datetime.datetime, datetime.date, datetime.time)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return {"encoding": "base64", "data": base64.b64encode(value).decode()}
    if isinstance(value, dict):
        return {str(exact(k)): exact(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return {k: exact(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [exact(v) for v in value]
    raise TypeError(f"no exact form for {type(value).__name__}")


def fetch(df: DataFrame, cap: int = ROW_CAP, timeout_s: float = TIMEOUT_S) -> Result:
    """The first `cap` rows. Spark is asked for one more, which tells whether rows were
    left out; jobs that outlast the time limit are cancelled (TimeoutError)."""
    spark, tag = df.sparkSession, f"marlstone-{uuid.uuid4().hex}"
    began, late = time.monotonic(), threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_s, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        rows = df.limit(cap + 1).collect()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"the statement took more than {timeout_s:g} seconds") from None
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    return Result(df.columns, [[exact(v) for v in r] for r in rows[:cap]], int((time.monotonic() - began) * 1000), len(rows) > cap)


def run_sql(spark: SparkSession, sql: str, allow_writes: bool = False, confirmed: bool = False, cap: int = ROW_CAP,
            timeout_s: float = TIMEOUT_S) -> Result:
    """Assess one statement, never trusting an earlier assessment, and run it."""
    permit(assess_spark(spark, sql, allow_writes), confirmed)
    return fetch(spark.sql(sql.strip().rstrip(";")), cap, timeout_s)


def sample(result: Result, limit: int) -> tuple[Result, str]:
    """The first `limit` rows of a result, and a note that says what they are."""
    kept = Result(result.columns, result.rows[:limit], result.elapsed_ms, result.truncated or len(result.rows) > limit)
    note = (f"{len(kept.rows)} of {len(result.rows)} kept rows; the original result was {'' if result.truncated else 'not '}truncated. "
            "The sample is not complete and cannot establish totals.")
    return kept, note
