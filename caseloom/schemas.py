"""Declared record types and their range checks; nothing is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_LIST = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SEARCH_REQUEST = _struct(query=_S, top_k=_I, use_kanoon=_B, court=_S, year_from=_I, year_to=_I, limit=_I)
SEARCH_RESULT = _struct(title=_S, url=_S, doc_id=_S, court=_S, date=_S, snippet=_S, similarity_score=_D)
MATCH = T.StructType([*SEARCH_RESULT.fields, T.StructField("source", _S)])
DETAIL = _struct(doc_id=_S, title=_S, url=_S, court=_S, date=_S, bench=_S, text=_S, citations=_LIST, acts=_LIST)
PARTIES = _struct(petitioner=_S, respondent=_S)
METADATA = _struct(extraction_method=_S, confidence=_D, processing_time_ms=_I)
PROFILE = _struct(parties=PARTIES, legal_issues=_LIST, ipc_sections=_LIST, acts_referenced=_LIST, court_level=_S, case_type=_S, key_facts=_LIST, relief_sought=_S, metadata=METADATA)
EXTRACT_REQUEST = _struct(case_text=_S, use_model=_B)
TASK = _struct(task_id=_S, status=_S, result=PROFILE, error=_S, created_at=T.TimestampType())
NODE = _struct(id=_S, label=_S, type=_S, color=_S, shape=_S, weight=_D, description=_S, weak=_B)
EDGE = _struct(id=_S, source=_S, target=_S, label=_S, type=_S, strength=_D)
GRAPH = _struct(nodes=T.ArrayType(NODE), edges=T.ArrayType(EDGE), weak_nodes=_LIST, node_count=_I, edge_count=_I)
COMPONENT = _struct(component=_S, weight=_D, raw_score=_D, weighted_score=_D, explanation=_S)
RESULT = _struct(win_probability=_D, risk_assessment=_struct(level=_S, color=_S), score_breakdown=T.ArrayType(COMPONENT), key_strengths=_LIST, key_weaknesses=_LIST, recommendation=_S)
CHUNK = _struct(doc_id=_S, title=_S, url=_S, court=_S, date=_S, text=_S, chunk_index=_I, total_chunks=_I)
INDEX_FILE = _struct(model=_S, dimension=_I, vectors=T.ArrayType(T.ArrayType(T.FloatType())), metadata=T.ArrayType(CHUNK))
SCENARIO = _struct(additional_evidence=_I, evidence_quality=_S, additional_sections=_I, jurisdiction=_S, resolved_weak=_LIST, additional_precedents=_I, precedent_similarity=_S)
FIXTURE = _struct(search_results=T.ArrayType(SEARCH_RESULT), judgment_details=T.MapType(_S, DETAIL))

#: Fixed values: (least, most) of numbers in requests and results.
RANGES = {
    "top_k": (1, 50), "limit": (1, 100), "similarity_score": (0, 1), "confidence": (0, 1), "processing_time_ms": (0, None), "weight": (0, 1), "strength": (0, 1),
    "raw_score": (0, 1), "weighted_score": (0, 1), "win_probability": (0, 1),
}


def violations(df: DataFrame) -> DataFrame:
    """Rows with a value outside its range, with the names of the columns at fault."""

    def outside(name: str) -> Column:
        low, high = RANGES[name]
        c = F.col(name)
        bad = (c < low) if high is None else (c < low) | (c > high)
        return F.when(bad, F.lit(name))

    checks = [outside(f.name) for f in df.schema.fields if f.name in RANGES]
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumn("violations", found).filter(F.size("violations") > 0)


def required(df: DataFrame, *names: str) -> DataFrame:
    """Rows in which a required value is missing."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names]))
