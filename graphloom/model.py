"""The data model: node labels, relationship types and their schemas."""

from __future__ import annotations

from pyspark.sql import types as T

NODE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("project_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("valid_from", T.LongType()),
    T.StructField("valid_to", T.LongType()),
    T.StructField("props", T.MapType(T.StringType(), T.StringType())),
])
EDGE = T.StructType([
    T.StructField("src", T.StringType(), False),
    T.StructField("dst", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("props", T.MapType(T.StringType(), T.StringType())),
])

# The labels by layer, and the end points of each relationship type.
LABELS = {
    0: ["FOLDER"],
    1: ["FILE"],
    2: ["FUNCTION", "CLASS", "VARIABLE", "IMPORT", "EXPORT"],
    3: ["TEST_SUITE", "TEST_CASE"],
    4: ["DOCUMENT", "SECTION"],
    5: ["COMMUNITY", "RULE", "FEATURE", "TASK"],
    6: ["EPISODE", "LEARNING", "CLAIM", "GRAPH_TX"],
}
RELATIONSHIPS = {
    "CONTAINS": [("FOLDER", "FOLDER"), ("FOLDER", "FILE"), ("FILE", "FUNCTION"), ("FILE", "CLASS"), ("FILE", "VARIABLE"), ("FILE", "TEST_SUITE"), ("FILE", "TEST_CASE"), ("TEST_SUITE", "TEST_CASE")],
    "IMPORTS": [("FILE", "IMPORT")],
    "REFERENCES": [("IMPORT", "FILE")],
    "DEPENDS_ON": [("FILE", "FILE")],
    "EXPORTS": [("FILE", "EXPORT")],
    "CALLS_TO": [("FUNCTION", "FUNCTION")],
    "EXTENDS": [("CLASS", "CLASS")],
    "IMPLEMENTS": [("CLASS", "CLASS"), ("FEATURE", "FILE")],
    "TESTS": [("TEST_SUITE", "FILE"), ("TEST_SUITE", "FUNCTION"), ("TEST_SUITE", "CLASS"), ("TEST_CASE", "FUNCTION"), ("TEST_CASE", "CLASS")],
    "SECTION_OF": [("SECTION", "DOCUMENT")],
    "NEXT_SECTION": [("SECTION", "SECTION")],
    "DOC_DESCRIBES": [("SECTION", "FILE"), ("SECTION", "FUNCTION"), ("SECTION", "CLASS")],
    "BELONGS_TO": [("FILE", "COMMUNITY"), ("FUNCTION", "COMMUNITY"), ("CLASS", "COMMUNITY")],
    "VIOLATES_RULE": [("FILE", "RULE")],
    "INVOLVES": [("EPISODE", None)],
    "NEXT_EPISODE": [("EPISODE", "EPISODE")],
    "APPLIES_TO": [("LEARNING", None)],
    "TARGETS": [("CLAIM", None)],
    "ANCHORED_BY": [("COMMUNITY", None)],
    "HAS_TASK": [("FEATURE", "TASK")],
    "IMPLEMENTED_BY": [("FEATURE", "FILE"), ("CLASS", "CLASS")],
}
CODE = ["FILE", "FUNCTION", "CLASS"]

# Rank and expansion weights by relationship type, others OTHER_WEIGHT.
RANK_WEIGHTS = {"CALLS": 0.9, "CALLS_TO": 0.9, "IMPORTS": 0.7, "CONTAINS": 0.5, "TESTS": 0.4, "DEFINED_IN": 0.6, "INVOLVES": 0.3, "APPLIES_TO": 0.4}
EXPANSION_WEIGHTS = {"CALLS": 0.9, "CALLS_TO": 0.9, "IMPORTS": 0.7, "CONTAINS": 0.5, "TESTS": 0.4, "INVOLVES": 0.3, "APPLIES_TO": 0.4}
OTHER_WEIGHT = 0.2
