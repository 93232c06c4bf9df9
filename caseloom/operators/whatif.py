"""What-if re-scoring (WIF-1 to WIF-7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import size0
from ..rules import JURISDICTION, QUALITY, SIMILARITY
from .score import clamp, risk_level


def _pick(value: Column, table: tuple, at: int = 1, other: float | str = 0.0) -> Column:
    out = F.lit(other)
    for row in table:
        out = F.when(value == row[0], F.lit(row[at])).otherwise(out)
    return out


def scenario_grid(spark: SparkSession, evidence: int = 5, sections: int = 4, precedents: int = 5) -> DataFrame:
    """WIF-5: every combination within the bounds, numbered; weak arguments none."""
    upto = lambda n, name: spark.range(n + 1).select(F.col("id").cast("int").alias(name))
    of = lambda table, name: spark.createDataFrame([(r[0],) for r in table], f"{name} string")
    grid = upto(evidence, "additional_evidence").crossJoin(of(QUALITY, "evidence_quality")).crossJoin(upto(sections, "additional_sections")).crossJoin(of(JURISDICTION, "jurisdiction"))
    grid = grid.crossJoin(upto(precedents, "additional_precedents")).crossJoin(of(SIMILARITY, "precedent_similarity"))
    number = F.xxhash64(*grid.columns)
    return grid.withColumn("resolved_weak", F.array().cast("array<string>")).withColumn("scenario_id", number)


def contributions() -> dict[str, Column]:
    """WIF-1: what each tweak adds; NULL and unknown values count as none (NULL quality as moderate)."""
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    return {
        "evidence": n("additional_evidence") * 0.03,
        "quality": _pick(F.coalesce("evidence_quality", F.lit("moderate")), QUALITY),
        "sections": n("additional_sections") * 0.02,
        "jurisdiction": _pick(F.col("jurisdiction"), JURISDICTION),
        "resolved": size0(F.col("resolved_weak")) * 0.04,
        "precedents": n("additional_precedents") * _pick(F.col("precedent_similarity"), SIMILARITY),
    }


def _percent(delta: Column) -> Column:
    whole = F.floor(delta * 100 + 0.5 + 1e-9).cast("int")
    return F.concat(F.when(delta > 0, "+").otherwise(""), whole.cast("string"), F.lit("%"))


def change_log() -> Column:
    """WIF-3: a line for each tweak with an effect, in order."""
    c = contributions()
    tick = lambda d: F.when(d > 0, "✓").otherwise("✗")
    s = lambda n: F.when(n > 1, "s").otherwise("")
    ev, sec, pre, res = F.col("additional_evidence"), F.col("additional_sections"), F.col("additional_precedents"), size0(F.col("resolved_weak"))
    added = lambda n, what, d: F.when(n > 0, F.concat(F.lit("✓ Added "), n.cast("string"), F.lit(f" {what}"), s(n), F.lit(" ("), _percent(d), F.lit(")")))
    return F.array_compact(F.array(
        added(ev, "evidence piece", c["evidence"]),
        F.when(c["quality"] != 0, F.concat(tick(c["quality"]), F.lit(" Evidence quality: "), F.initcap("evidence_quality"), F.lit(" ("), _percent(c["quality"]), F.lit(")"))),
        added(sec, "IPC section", c["sections"]),
        F.when(c["jurisdiction"] != 0, F.concat(tick(c["jurisdiction"]), F.lit(" Moved to "), _pick(F.col("jurisdiction"), JURISDICTION, 2, ""), F.lit(" ("), _percent(c["jurisdiction"]), F.lit(")"))),
        F.when(res > 0, F.concat(F.lit("✓ Resolved "), res.cast("string"), F.lit(" weak argument"), s(res), F.lit(" ("), _percent(c["resolved"]), F.lit(")"))),
        F.when(pre > 0, F.concat(F.lit("✓ Added "), pre.cast("string"), F.lit(" precedent"), s(pre), F.lit(" ("), F.coalesce(F.initcap("precedent_similarity"), F.lit("undefined")), F.lit(" similarity, +"), F.floor(c["precedents"] * 100 + 0.5 + 1e-9).cast("string"), F.lit("%)"))),
    ))


def rescore(base: DataFrame, scenarios: DataFrame, key: str = "case_id", probability: str = "win_probability", most: int = 100_000) -> DataFrame:
    """WIF-1 to WIF-3: every case under every scenario. The scenarios, a stated set, are sent round in parts of about ``most``."""
    delta = sum(contributions().values(), F.lit(0.0))
    cases = base.select(key, F.col(probability).alias("base_probability"))
    parts = max(1, -(-scenarios.count() // most))
    in_part = lambda i: scenarios if parts == 1 else scenarios.filter(F.pmod(F.xxhash64("scenario_id"), F.lit(parts)) == i)
    each = reduce(DataFrame.unionByName, [cases.crossJoin(F.broadcast(in_part(i))) for i in range(parts)])
    adjusted = F.round(clamp(F.col("base_probability") + delta), 4)
    return each.select(key, "scenario_id", adjusted.alias("adjusted"), F.round(delta, 4).alias("delta"), risk_level(adjusted).alias("risk_level"), change_log().alias("changelog"))


def toggle(resolved: Column, node: Column) -> Column:
    """WIF-4: takes the node out of the set if it is there, else adds it."""
    return F.when(F.array_contains(resolved, node), F.array_remove(resolved, node)).otherwise(F.array_append(resolved, node))


def gauge(p: Column) -> Column:
    """WIF-7: whole percent within 0 to 100."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) * 100 + 0.5).cast("int")
