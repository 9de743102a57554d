"""Data model: node and edge tables, vocabularies, weights.

A property graph is two tables. ``nodes`` has one row an entity, ``edges`` one
row a directed typed edge; several edges may join the same two nodes. ``pos``
columns hold the order in which the producer listed rows, since first- and
last-wins rules depend on it.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODE = _struct(id=_S, label=_S, source_file=_S, source_location=_S, file_type=_S, type=_S, _callable=_B, _origin=_S, origin=_S, community=_L, qualified_name=_S, kind=_S, supplement_reason=_S)
EDGE = _struct(source=_S, target=_S, relation=_S, confidence=_S, confidence_score=_D, origin=_S, _origin=_S, detail=_S, source_file=_S, source_location=_S, context=_S, weight=_D)
GRAPH = _struct(nodes=T.ArrayType(NODE), links=T.ArrayType(EDGE), edges=T.ArrayType(EDGE))
REF = _struct(node=_S, file=_S, line=T.IntegerType())
FINDING = _struct(relation=_S, source_ref=REF, target_ref=REF, detail=_S, confidence=_S, confidence_score=_D, skip_self=_B)
MANIFEST_ENTRY = _struct(ast_hash=_S, hash=_S)
#: A definition's extent: ``start`` counts decorators, ``def_line`` is the definition's own line.
SYMBOL = "file string, name string, kind string, start int, end int, def_line int, signature string, calls array<string>, status string"

# The vocabularies of the data model.
TRAVERSAL_RELATIONS = ("calls", "indirect_call", "references", "imports", "imports_from", "dynamic_import", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds", "requires")
MEMBER_RELATIONS = ("method", "contains")
INHERIT_RELATIONS = ("inherits", "extends", "implements", "mixes_in")
TAINT_RELATIONS = ("taints", "reaches_sink")
INJECTABLE_RELATIONS = ("taints", "reaches_sink", "tests", "reads_config")
CALL_RELATIONS = ("calls", "indirect_call")
NOT_A_TEST_LINK = ("contains", "method", "rationale_for", "embeds")
RELATION_WEIGHTS = {
    "calls": 1.0, "indirect_call": 1.0, "taints": 0.95, "reaches_sink": 0.95, "method": 0.7, "contains": 0.7,
    "extends": 0.6, "inherits": 0.6, "implements": 0.6, "mixes_in": 0.6, "embeds": 0.6, "tests": 0.5, "reads_config": 0.5,
    "references": 0.4, "uses": 0.4, "imports": 0.2, "imports_from": 0.2, "dynamic_import": 0.2, "re_exports": 0.2, "requires": 0.2,
}
UNKNOWN_WEIGHT, DECAY = 0.3, 0.5
LEGACY_RANK = {
    "calls": 0, "indirect_call": 0, "method": 1, "contains": 1, "extends": 2, "inherits": 2, "implements": 2, "mixes_in": 2, "embeds": 2,
    "references": 3, "uses": 3, "imports": 4, "imports_from": 4, "dynamic_import": 4, "re_exports": 4, "requires": 4,
}
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS", "EXTERNAL")
SEVERITY_SCORE = {"ERROR": 1.0, "WARNING": 0.8, "INFO": 0.5}
OTHER_SEVERITY, ASSUMED_TAINT = 0.9, 0.9
#: Origins of our own rows.
INJECTED, SUPPLEMENTED, EXTRACTED_ORIGIN = "graphloom", "graphloom:supplement", "ast"
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "go": "go", "java": "java", "rs": "rust", "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin", "cs": "csharp",
}
