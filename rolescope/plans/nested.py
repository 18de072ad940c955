"""Queries over nested profile documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shredding
from ..session import table, written


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Shredded once, whole documents, and written: each entity's joins read the table, not the documents.
    return written(shredding.profile_tree(table(spark, sf_dir, "candidate_profiles")), "profile-nodes")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.entity_index(_tree(spark, sf_dir)).withColumnRenamed("key", "resume_id")


def _entity(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shredding.entity_table(_tree(spark, sf_dir), name).withColumnRenamed("key", "resume_id")

    query.__name__ = f"p4_{name}"
    return query


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of the documents: how often each label has each kind of value, over whole documents."""
    tree = shredding.profile_tree(table(spark, sf_dir, "candidate_profiles"))
    return tree.groupBy("label", "kind").agg(F.count("*").alias("nodes"), F.countDistinct("key").alias("documents"))


_DOCS = """
WITH last AS (
  SELECT resume_id, profile_json,
         row_number() OVER (PARTITION BY resume_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) AS v
  FROM candidate_profiles WHERE resume_id IS NOT NULL
), doc AS (
  SELECT resume_id, CASE WHEN json_type(profile_json) = 'VARCHAR' THEN json_extract_string(profile_json, '$') ELSE profile_json END AS d
  FROM last WHERE v = 1
), listed AS (
  SELECT resume_id, entity, CASE json_type(d, p) WHEN 'ARRAY' THEN json_extract(json_extract(d, p), '$[*]') WHEN 'NULL' THEN [] ELSE [json_extract(d, p)] END AS items
  FROM doc, (VALUES ('education', '$.education'), ('experience', '$.experience'), ('project', '$.projects'),
                    ('certification', '$.certifications'), ('warning', '$.metadata.warnings')) AS e(entity, p)
  WHERE json_type(d, p) IS NOT NULL
), record AS (
  SELECT resume_id, entity, -1 AS parent_pos, pos - 1 AS pos, items[pos] AS item
  FROM (SELECT resume_id, entity, items, unnest(range(1, len(items) + 1)) AS pos FROM listed)
), tech AS (
  SELECT resume_id, pos AS parent_pos, CASE json_type(item, '$.technologies') WHEN 'ARRAY' THEN json_extract(item, '$.technologies[*]')
         WHEN 'NULL' THEN [] ELSE [json_extract(item, '$.technologies')] END AS items
  FROM record WHERE entity = 'project' AND json_type(item, '$.technologies') IS NOT NULL
), tech_record AS (
  SELECT resume_id, 'technology' AS entity, parent_pos, pos - 1 AS pos, items[pos] AS item
  FROM (SELECT resume_id, parent_pos, items, unnest(range(1, len(items) + 1)) AS pos FROM tech)
), every AS (SELECT * FROM record UNION ALL SELECT * FROM tech_record)
"""
P4_SQL = _DOCS + """
SELECT resume_id, entity, CAST(parent_pos AS INTEGER) AS parent_pos, CAST(pos AS INTEGER) AS pos FROM every WHERE json_type(item) <> 'NULL'
"""


P4_LABELS_SQL = """
WITH last AS (
  SELECT resume_id, profile_json,
         row_number() OVER (PARTITION BY resume_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) AS v
  FROM candidate_profiles WHERE resume_id IS NOT NULL
), doc AS (
  SELECT resume_id, CASE WHEN json_type(profile_json) = 'VARCHAR' THEN json_extract_string(profile_json, '$') ELSE profile_json END AS d
  FROM last WHERE v = 1 AND profile_json IS NOT NULL
), node AS (
  SELECT resume_id, t.id, t.parent, t.key, t.type FROM doc, json_tree(d) AS t
), placed AS (
  SELECT n.resume_id, CASE WHEN p.type = 'OBJECT' THEN n.key END AS label,
         CASE n.type WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind
  FROM node n LEFT JOIN node p ON p.resume_id = n.resume_id AND p.id = n.parent
)
SELECT label, kind, count(*) AS nodes, count(DISTINCT resume_id) AS documents FROM placed GROUP BY 1, 2
"""


def _entity_sql(name: str, columns: tuple[str, ...]) -> str:
    picked = ", ".join(f"json_extract_string(item, '$.{c}') AS {c}" for c in columns)
    value = "CASE WHEN json_type(item) NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(item, '$') END AS value"
    return _DOCS + (
        f"SELECT resume_id, CAST(parent_pos AS INTEGER) AS parent_pos, CAST(pos AS INTEGER) AS pos, {value}{', ' + picked if picked else ''} "
        f"FROM every WHERE entity = '{name}' AND json_type(item) <> 'NULL'"
    )


def queries() -> dict:
    return {"p4_found": p4_found, "p4_labels": p4_labels} | {f"p4_{e.name}": _entity(e.name) for e in shredding.PROFILE_ENTITIES}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p4_labels": P4_LABELS_SQL} | {f"p4_{e.name}": _entity_sql(e.name, e.columns) for e in shredding.PROFILE_ENTITIES}
