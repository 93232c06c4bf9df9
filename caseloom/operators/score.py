"""Outcome scoring (SIM-1 to SIM-12): five weighted components, clamp, band, reasons and advice, in one projection.

Precedents are aggregated once per case; everything else is arithmetic on the profile's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.text import size0, text_or
from ..rules import ADVICE, BANDS, COMPONENTS, LOW_BAND, PROB_MAX, PROB_MIN, WEIGHTS


def precedent_stats(precedents: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, n_precedents, n_scored, mean_similarity, best_similarity); a score of 0.0 counts, NULL does not."""
    s = F.col("similarity_score")
    return precedents.groupBy(key).agg(F.count("*").alias("n_precedents"), F.count(s).alias("n_scored"), F.avg(s).alias("mean_similarity"), F.max(s).alias("best_similarity"))


def alignment(mean: Column, best: Column) -> Column:
    """SIM-1."""
    return F.when(mean.isNull(), F.lit(0.4)).when(best > 0.8, F.least(mean + 0.1, F.lit(1.0))).otherwise(mean)


def statutory(n_refs: Column, criminal_with_sections: Column) -> Column:
    """SIM-2."""
    base = F.when(n_refs == 0, 0.3).when(n_refs <= 2, 0.5).when(n_refs <= 4, 0.7).otherwise(0.85)
    return F.when(criminal_with_sections, F.least(base + 0.05, F.lit(1.0))).otherwise(base)


def completeness(nodes: Column, weak: Column) -> Column:
    """SIM-3."""
    return F.when(F.coalesce(nodes, F.lit(0)) == 0, F.lit(0.5)).otherwise((nodes - F.coalesce(weak, F.lit(0))) / nodes)


def complexity(n_issues: Column) -> Column:
    """SIM-4."""
    return F.when(n_issues <= 2, 0.8).when(n_issues <= 4, 0.65).otherwise(0.5)


def court_factor(court: Column) -> Column:
    """SIM-5."""
    low = F.lower(text_or(court))
    return F.when(low.contains("supreme"), 0.5).when(low.contains("high"), 0.6).when(low.contains("district") | low.contains("sessions"), 0.7).otherwise(0.55)


def risk_level(p: Column) -> Column:
    """SIM-8."""
    return F.when(p >= BANDS[0][0], BANDS[0][1]).when(p >= BANDS[1][0], BANDS[1][1]).otherwise(LOW_BAND[0])


def risk_color(p: Column) -> Column:
    return F.when(p >= BANDS[0][0], BANDS[0][2]).when(p >= BANDS[1][0], BANDS[1][2]).otherwise(LOW_BAND[1])


def clamp(p: Column) -> Column:
    return F.greatest(F.lit(PROB_MIN), F.least(F.lit(PROB_MAX), p))


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def score_cases(profiles: DataFrame, precedents: DataFrame | None = None, stats: DataFrame | None = None, key: str = "case_id") -> DataFrame:
    """SIM-12: one row per profile with win_probability, risk_level, risk_color, score_breakdown, key_strengths, key_weaknesses, recommendation.

    Defined results: no precedents or only NULL scores -> 0.4; no graph statistics -> 0.5; NULL lists count as empty.
    """
    df = profiles
    if precedents is not None:
        df = df.join(precedent_stats(precedents, key), key, "left")
    else:
        df = df.withColumns({"n_precedents": F.lit(0), "n_scored": F.lit(0), "mean_similarity": F.lit(None).cast("double"), "best_similarity": F.lit(None).cast("double")})
    if stats is not None:
        df = df.join(stats.select(key, F.col("node_count").alias("_nodes"), F.size("weak_nodes").alias("_weak")), key, "left")
    else:
        df = df.withColumns({"_nodes": F.lit(None).cast("long"), "_weak": F.lit(None).cast("int")})
    n_sections, n_issues = size0(F.col("ipc_sections")), size0(F.col("legal_issues"))
    n_refs = n_sections + size0(F.col("acts_referenced"))
    criminal = (text_or(F.col("case_type")) == "criminal") & (n_sections > 0)
    raw = (alignment(F.col("mean_similarity"), F.col("best_similarity")), statutory(n_refs, criminal), completeness(F.col("_nodes"), F.col("_weak")), complexity(n_issues), court_factor(F.col("court_level")))
    df = df.withColumns({f"_raw{i}": r for i, r in enumerate(raw)})
    r, mean, best = F.col("_raw0"), F.col("mean_similarity"), F.col("best_similarity")
    refs, nodes, weak = n_refs.cast("string"), F.col("_nodes"), F.coalesce(F.col("_weak"), F.lit(0))
    court = F.lower(text_or(F.col("court_level")))
    why = (
        F.when(F.coalesce(F.col("n_precedents"), F.lit(0)) == 0, "No similar precedents found — neutral baseline applied.")
        .when(mean.isNull(), "Precedent similarity scores unavailable — neutral baseline.")
        .when(best > 0.8, _text("Average similarity ", _two(r), "; strongest precedent at ", _two(best), " (boosted +0.10 for high alignment)."))
        .otherwise(_text("Average similarity ", _two(r), " across ", F.col("n_scored").cast("string"), " precedent(s).")),
        _text(
            F.when(n_refs == 0, "No statutory references extracted.").when(n_refs <= 2, _text(refs, " statute(s) referenced — moderate foundation."))
            .when(n_refs <= 4, _text(refs, " statutes referenced — solid statutory basis.")).otherwise(_text(refs, " statutes referenced — strong statutory coverage.")),
            F.when(criminal, " Criminal case with IPC sections (+0.05).").otherwise(""),
        ),
        F.when(F.coalesce(nodes, F.lit(0)) == 0, "No argument graph provided — neutral baseline.")
        .when(weak == 0, _text("All ", nodes.cast("string"), " nodes are strong — no unsupported arguments."))
        .otherwise(_text((nodes - weak).cast("string"), "/", nodes.cast("string"), " nodes are supported; ", weak.cast("string"), " weak node(s) lack evidentiary backing.")),
        F.when(n_issues <= 2, _text("Only ", n_issues.cast("string"), " legal issue(s) — focused, manageable case.")).when(n_issues <= 4, _text(n_issues.cast("string"), " legal issues — moderate complexity."))
        .otherwise(_text(n_issues.cast("string"), " legal issues — high complexity, multiple angles.")),
        F.when(court.contains("supreme"), "Supreme Court — high bar, rigorous scrutiny.").when(court.contains("high"), "High Court — moderate bar, established appellate review.")
        .when(court.contains("district") | court.contains("sessions"), "District/Sessions Court — lower bar, fact-finding stage.")
        .otherwise(_text("Unknown court level ('", text_or(F.col("court_level"), "None"), "') — conservative estimate.")),
    )
    parts = [
        F.struct(F.lit(name).alias("component"), F.lit(w).alias("weight"), rounded(F.col(f"_raw{i}"), 4).alias("raw_score"), rounded(F.col(f"_raw{i}") * w, 4).alias("weighted_score"), why[i].alias("explanation"))
        for i, (name, w) in enumerate(zip(COMPONENTS, WEIGHTS, strict=True))
    ]
    df = df.withColumn("score_breakdown", F.array(*parts))
    total = F.aggregate("score_breakdown", F.lit(0.0), lambda a, x: a + x["weighted_score"])
    df = df.withColumn("win_probability", clamp(rounded(total, 4)))
    relief, facts = text_or(F.col("relief_sought")), size0(F.col("key_facts"))
    reason = lambda c, s, t: F.when(c, F.struct(F.lit(s).alias("s"), (F.lit(t) if isinstance(t, str) else t).alias("t")))
    of_parts = lambda keep: F.transform(F.filter("score_breakdown", keep), lambda x: F.struct(x["weighted_score"].alias("s"), x["explanation"].alias("t")))
    present = lambda *rs: F.filter(F.array(*rs), lambda x: x.isNotNull())
    strong = F.concat(of_parts(lambda x: x["weighted_score"] >= 0.1), present(
        reason(F.coalesce(best, F.lit(0.0)) > 0.75, 0.15, "Strong precedent alignment with past judgments."),
        reason(F.length(relief) > 10, 0.12, "Specific relief sought — clear prayer for remedy."),
        reason(facts >= 3, 0.12, _text(facts.cast("string"), " key facts extracted — solid evidentiary base.")),
    ))
    poor = F.concat(of_parts(lambda x: x["weighted_score"] < 0.15), present(
        reason(n_refs == 0, 0.05, "No statutory references — weak legal foundation."),
        reason((text_or(F.col("petitioner")) == "") & (text_or(F.col("respondent")) == ""), 0.05, "Parties not identified — case framing incomplete."),
        reason(weak > 0, 0.08, _text(weak.cast("string"), " unsupported argument node(s) in the graph.")),
        reason(relief == "", 0.06, "No relief sought — unclear remedy being pursued."),
    ))
    # Stable: of equal scores the one listed first.
    ranked = lambda xs, sign: F.transform(F.slice(F.array_sort(F.transform(xs, lambda x, i: F.struct((x["s"] * sign).alias("k"), i.alias("i"), x["t"].alias("t")))), 1, 3), lambda x: x["t"])
    df = df.withColumns({"key_strengths": ranked(strong, -1), "key_weaknesses": ranked(poor, 1)})
    p = F.col("win_probability")
    base = F.when(p >= BANDS[0][0], ADVICE[0]).when(p >= BANDS[1][0], ADVICE[1]).otherwise(ADVICE[2])
    fix = F.get("key_weaknesses", F.lit(0))
    advice = F.when(fix.isNull(), base).otherwise(_text(base, " Consider addressing: ", F.lower(fix)))
    return df.select(key, "win_probability", risk_level(p).alias("risk_level"), risk_color(p).alias("risk_color"), "score_breakdown", "key_strengths", "key_weaknesses", advice.alias("recommendation"))


def breakdown(scores: DataFrame, key: str = "case_id") -> DataFrame:
    """SIM-6: one row per component."""
    return scores.select(key, F.inline("score_breakdown"))
