"""Deeply nested records as related flat tables (problem 4).

Documents are shredded once into an adjacency table (key, node, parent, label, ordinal, kind, scalar). Entities are
found by joining nodes with their children along a path of labels, and become flat tables by joining each object node
with its scalar children and pivoting their labels. Every join and grouping is on the document key and a node number,
so no document and no entity is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_tree import KINDS, document_nodes
from .versions import latest_rows

SCALARS = ("string", "number", "boolean")


@dataclass(frozen=True)
class Entity:
    """A child table: labels that lead to it from its parent entity (from the root if there is none)."""

    name: str
    path: tuple[str, ...]
    columns: tuple[str, ...] = ()
    parent: str | None = None


#: Entities of a parsed profile.
PROFILE_ENTITIES = (
    Entity("education", ("education",), ("raw_text", "degree", "institution", "year", "score")),
    Entity("experience", ("experience",), ("raw_text", "title", "organization", "date_range", "description")),
    Entity("project", ("projects",), ("raw_text", "name", "description")),
    Entity("technology", ("technologies",), parent="project"),
    Entity("certification", ("certifications",)),
    Entity("warning", ("metadata", "warnings")),
)


def adjacency(df: DataFrame, key: str, json_col: str, members: list[str] | None = None) -> DataFrame:
    """Adjacency table of the documents in ``json_col``.

    A null document has no nodes; a text that is no JSON is one node of kind ``malformed``; a JSON string that holds a
    JSON object is opened. ``members`` keeps only those members of the root. Depth is not limited. Other columns of
    ``df`` are not read.
    """
    source = df.select(F.col(key).alias("_key"), F.col(json_col).cast("string").alias("_json"))
    key_type = source.schema["_key"].dataType.simpleString()
    keep = frozenset(members) if members is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.array(KINDS)
        for batch in batches:
            # A batch of long documents makes many nodes: slices bound the worker's memory.
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                owner: list[int] = []
                rows: list[tuple] = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    before = len(rows)
                    rows.extend(document_nodes(text, keep))
                    owner.extend([i] * (len(rows) - before))
                if not rows:
                    continue
                node, parent, label, ordinal, kind, scalar = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner, pa.int32())), pa.array(node, pa.int32()), pa.array(parent, pa.int32()),
                        pa.array(label, pa.string()), pa.array(ordinal, pa.int32()), kinds.take(pa.array(kind, pa.int32())), pa.array(scalar, pa.string()),
                    ],
                    names=["key", "node", "parent", "label", "ordinal", "kind", "scalar"],
                )

    return source.mapInArrow(run, f"key {key_type}, node int, parent int, label string, ordinal int, kind string, scalar string")


def _steps(entities: tuple[Entity, ...]) -> tuple[list[tuple[str, int]], dict[int, list[tuple[int, str, bool]]]]:
    """States (entity, labels followed) and, from each state (-1 is the root), the next states with their label and
    whether the step enters a child entity."""
    states = [(e.name, k) for e in entities for k in range(1, len(e.path) + 1)]
    number = {s: k for k, s in enumerate(states)}
    steps: dict[int, list[tuple[int, str, bool]]] = {}
    for e in entities:
        before = -1 if e.parent is None else number[e.parent, max(k for n, k in states if n == e.parent)]
        for k, label in enumerate(e.path, 1):
            steps.setdefault(before, []).append((number[e.name, k], label, k == 1))
            before = number[e.name, k]
    return states, steps


def entity_records(tree: DataFrame, entities: tuple[Entity, ...] = PROFILE_ENTITIES) -> DataFrame:
    """Records of all entities: ``key``, ``entity``, ``parent_pos``, ``pos``, ``node``, ``kind``, ``scalar``.

    ``pos`` is the place in the entity's own list, ``parent_pos`` the place of the parent record, -1 where the entity
    hangs on the document itself. A lone value is a list of one; a null is no record but keeps its place; a nested path
    opens single objects and lists alike. All entities take a step together: each level of nesting costs one join with
    the labelled members and one with the elements of lists.
    """
    states, steps = _steps(entities)
    final = {k: name for k, (name, depth) in enumerate(states) if depth == len(next(e.path for e in entities if e.name == name))}
    named = tree.where(F.col("label").isin(sorted({label for e in entities for label in e.path}))).select(
        "key", F.col("parent").alias("node"), "label", F.col("node").alias("member"), F.col("kind").alias("m_kind"), F.col("scalar").alias("m_scalar")
    )
    element = tree.where(F.col("label").isNull() & (F.col("parent") >= 0)).select(
        "key", F.col("parent").alias("member"), F.col("node").alias("element"), F.col("ordinal").alias("place"), F.col("kind").alias("e_kind"), F.col("scalar").alias("e_scalar")
    )
    at = tree.where("parent = -1 and kind = 'object'").select("key", "node", F.lit(-1).alias("state"), F.lit(-1).alias("parent_pos"), F.lit(-1).alias("pos"))
    reached, found = {-1}, []
    while reached & set(steps):
        going = {k: v for k, v in steps.items() if k in reached}
        moves = F.create_map(*(x for k, v in going.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(n).alias("to"), F.lit(label).alias("label"), F.lit(enters).alias("enters")) for n, label, enters in v)))))
        moved = at.withColumn("move", F.explode(moves[F.col("state")])).select("key", "node", F.col("move.to").alias("state"), F.col("move.label").alias("label"), F.when(F.col("move.enters"), F.col("pos")).otherwise(F.col("parent_pos")).alias("parent_pos"))
        met = moved.join(named, ["key", "node", "label"]).select("key", "state", "parent_pos", "member", "m_kind", "m_scalar")
        listed = met.where("m_kind = 'array'").join(element, ["key", "member"])
        listed = listed.select("key", "state", "parent_pos", F.col("place").alias("pos"), F.col("element").alias("node"), F.col("e_kind").alias("kind"), F.col("e_scalar").alias("scalar"))
        lone = met.where("m_kind <> 'array'").select("key", "state", "parent_pos", F.lit(0).alias("pos"), F.col("member").alias("node"), F.col("m_kind").alias("kind"), F.col("m_scalar").alias("scalar"))
        records = listed.unionByName(lone).where("kind <> 'null'")
        reached = {n for v in going.values() for n, _, _ in v}
        names = F.create_map(*(x for k in sorted(reached & set(final)) for x in (F.lit(k), F.lit(final[k])))) if reached & set(final) else None
        if names is not None:
            found.append(records.withColumn("entity", names[F.col("state")]).where("entity is not null").drop("state"))
        at = records.where((F.col("kind") == "object") & F.col("state").isin(sorted(reached & set(steps)) or [-2])).select("key", "node", "state", "parent_pos", "pos")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def entity_index(tree: DataFrame, entities: tuple[Entity, ...] = PROFILE_ENTITIES) -> DataFrame:
    """All records of all entities: ``key``, ``entity``, ``parent_pos``, ``pos``."""
    return entity_records(tree, entities).select("key", "entity", "parent_pos", "pos")


def entity_table(tree: DataFrame, name: str, entities: tuple[Entity, ...] = PROFILE_ENTITIES) -> DataFrame:
    """Flat table of one entity: ``key``, ``parent_pos``, ``pos`` and a column for each of its labels.

    A record that is a scalar has its text in ``value``; a label that a record lacks is null; of a label that stands
    twice in a record the last holds. Nested members are tables of their own.
    """
    by_name = {e.name: e for e in entities}
    entity = by_name[name]
    line = [entity]
    while line[0].parent is not None:
        line.insert(0, by_name[line[0].parent])
    records = entity_records(tree, tuple(line)).where(F.col("entity") == name).drop("entity")
    scalars = F.col("scalar").alias("value")
    if not entity.columns:
        return records.select("key", "parent_pos", "pos", scalars)
    child = tree.where(F.col("kind").isin(*SCALARS) & F.col("label").isin(*entity.columns)).select(
        "key", F.col("parent").alias("node"), F.col("label").alias("c_label"), F.col("scalar").alias("c_scalar")
    )
    joined = records.select("key", "parent_pos", "pos", "node", scalars).join(child, ["key", "node"], "left")
    columns = [F.max(F.when(F.col("c_label") == c, F.col("c_scalar"))).alias(c) for c in entity.columns]
    return joined.groupBy("key", "node", "parent_pos", "pos").agg(F.max("value").alias("value"), *columns).drop("node")


def latest_profiles(profiles: DataFrame) -> DataFrame:
    """``resume_id`` and ``profile_json`` of the latest row of each profile; rows without an id take no part."""
    rows = profiles.where("resume_id is not null").select("resume_id", "profile_json", "updated_at", "created_at")
    return latest_rows(rows, ["resume_id"], "updated_at", [F.col("created_at").desc_nulls_last(), F.xxhash64("profile_json")])


def profile_tree(profiles: DataFrame) -> DataFrame:
    """Adjacency table of the latest profiles, whole documents."""
    return adjacency(latest_profiles(profiles), "resume_id", "profile_json")
