"""Exact nearest-vector retrieval: a stated set of query vectors, in blocks, against all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..session import cut

#: Query vectors that the driver and a task hold at once; more queries are further passes over the rows.
BLOCK_QUERIES = 4_096
#: Decimals at which similarities are compared, so that the last bit of a sum decides no rank.
SIMILARITY_DIGITS = 9


def _matrix(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the rows that have ``width`` numbers, and these rows' places."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    m = flat.reshape(len(at), width)
    good = np.isfinite(m).all(axis=1)
    return m[good], at[good]


def top_k(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, vector: str, k: int = 25, block: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id``, ``row_id``, ``retrieval_rank`` and ``similarity`` of the ``k`` rows nearest to each query.

    Nearness is the inner product on the scale 0 to 1; equal similarities are ordered by ``row_id``. Each task keeps k
    rows a query, so the shuffle carries tasks x queries x k rows. With more queries than ``block`` each block is collected,
    passed over the rows and its result written before the next, so the driver holds one block. Null vectors, vectors with nulls and vectors of
    another width than the queries are no neighbours; no queries or no rows give no result.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    q_type, r_type = queries.schema[query_id].dataType.simpleString(), rows.schema[row_id].dataType.simpleString()
    schema = f"`{query_id}` {q_type}, `{row_id}` {r_type}, ip double"
    usable = queries.where(F.col(vector).isNotNull() & F.col(query_id).isNotNull())
    parts = usable.count() // block + 1
    part_of = F.pmod(F.xxhash64(query_id), F.lit(parts))
    source = rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias(row_id), F.col(vector).alias("_v"))

    def scan(number: int) -> DataFrame:
        own = (usable.where(part_of == number) if parts > 1 else usable).select(query_id, vector).collect()
        by_width: dict[int, list] = {}
        for r in own:
            by_width.setdefault(len(r[1]), []).append(r)
        packed = [(w, [r[0] for r in rs], np.array([r[1] for r in rs], dtype=np.float64)) for w, rs in sorted(by_width.items()) if w]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[int, tuple[np.ndarray, list]] = {}
            for batch in batches:
                for g, (width, ids, matrix) in enumerate(packed):
                    m, at = _matrix(batch.column(1), width)
                    if not len(at):
                        continue
                    mine = batch.column(0).take(pa.array(at)).to_pylist()
                    ip = np.round(matrix @ m.T, SIMILARITY_DIGITS + 1)
                    for q in range(len(ids)):
                        before = kept.get((g, q))
                        score = ip[q] if before is None else np.concatenate([before[0], ip[q]])
                        names = mine if before is None else [*before[1], *mine]
                        if len(score) > k:
                            # All rows tied with the k-th stay: the id decides among them later.
                            edge = np.partition(score, len(score) - k)[len(score) - k]
                            good = np.flatnonzero(score > edge).tolist()
                            tied = sorted(np.flatnonzero(score == edge).tolist(), key=lambda i: names[i])[: k - len(good)]
                            pick = good + tied
                            score, names = score[pick], [names[i] for i in pick]
                        kept[(g, q)] = (score, names)
            for (g, q), (score, names) in kept.items():
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([packed[g][1][q]] * n), pa.array(names), pa.array(score, pa.float64())], names=[query_id, row_id, "ip"]
                )

        return source.mapInArrow(run, schema)

    def best(found: DataFrame) -> DataFrame:
        scored = found.select(query_id, row_id, scoring.similarity(F.col("ip"), SIMILARITY_DIGITS).alias("similarity"))
        w = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), F.col(row_id).asc())
        return scored.withColumn("retrieval_rank", F.row_number().over(w)).where(F.col("retrieval_rank") <= k)

    if parts == 1:
        return best(scan(0))
    out = cut(best(scan(0)))
    for number in range(1, parts):
        out = out.unionByName(cut(best(scan(number))))
    return out


def affected_jobs(stored: DataFrame, merged: DataFrame, changed: DataFrame) -> DataFrame:
    """``resume_id`` and ``affected_job_ids``, sorted, of each new candidate: the jobs whose list holds it now or held it before.

    ``changed`` has a ``resume_id`` of each new candidate; one that no list holds has an empty list.
    """
    own = changed.select("resume_id").distinct()
    pairs = merged.select("job_id", "resume_id").unionByName(stored.select("job_id", "resume_id")).distinct().join(own, "resume_id", "left_semi")
    lists = pairs.groupBy("resume_id").agg(F.array_sort(F.collect_set("job_id")).alias("affected_job_ids"))
    return own.join(lists, "resume_id", "left").select("resume_id", F.coalesce("affected_job_ids", F.expr("cast(array() as array<string>)")).alias("affected_job_ids"))


def without_outdated(stored: DataFrame, near: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored lists without the rows of new candidates whose new similarity is not among ``near``: as many others are nearer."""
    old = stored.join(changed.select("resume_id").distinct(), "resume_id", "left_semi").join(near.select("job_id", "resume_id"), ["job_id", "resume_id"], "left_anti")
    return stored.join(old.select("job_id", "resume_id"), ["job_id", "resume_id"], "left_anti")


def merged_top_k(stored: DataFrame, changed: DataFrame, k: int) -> DataFrame:
    """Stored top-k lists (job_id, resume_id, similarity) with new similarities merged in, and whether each job changed.

    Only stored and new rows compete: a row that falls out is not replaced by one that was never stored. A job changed
    if a new row was in its list before or is in it now; the rows of other jobs are as they were. Of a pair that is new
    twice the higher similarity holds.
    """
    new = changed.groupBy("job_id", "resume_id").agg(F.max("similarity").alias("similarity"))
    marked = new.select("job_id", "resume_id", F.round("similarity", 12).alias("similarity"), F.lit(True).alias("is_new"))
    old = stored.select("job_id", "resume_id", "similarity").join(new.select("job_id", "resume_id", F.lit(True).alias("replaced")), ["job_id", "resume_id"], "left")
    was = old.where("replaced").select("job_id").distinct()
    every = old.where("replaced is null").select("job_id", "resume_id", "similarity", F.lit(False).alias("is_new")).unionByName(marked)
    w = Window.partitionBy("job_id").orderBy(F.col("similarity").desc(), F.col("resume_id").asc())
    best = every.withColumn("retrieval_rank", F.row_number().over(w)).where(F.col("retrieval_rank") <= k)
    touched = best.where("is_new").select("job_id").unionByName(was).distinct().withColumn("changed", F.lit(True))
    fresh = best.join(touched, "job_id").select("job_id", "resume_id", "similarity", "retrieval_rank", "changed")
    kept = stored.join(touched, "job_id", "left_anti")
    order = Window.partitionBy("job_id").orderBy(F.col("similarity").desc(), F.col("resume_id").asc())
    same = kept.select("job_id", "resume_id", "similarity").withColumn("retrieval_rank", F.row_number().over(order)).withColumn("changed", F.lit(False))
    return fresh.unionByName(same)


def encoded_vectors(df: DataFrame, id_col: str, text_col: str, encoder: Callable[[list[str]], np.ndarray], out: str = "embedding", batch: int = 256) -> DataFrame:
    """Unit vectors of texts by a given encoder, which turns a list of texts into a matrix with a row for each; ``batch`` texts
    at a time, so a task holds no more. The encoder travels to the tasks; one that loads a model should do so when it is first called.
    A null text is encoded as an empty one, a row of zeros stays."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for low in range(0, part.num_rows, batch):
                own = part.slice(low, batch)
                m = np.asarray(encoder([t or "" for t in own.column(1).to_pylist()]), np.float64)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(norm > 0, norm, 1.0)
                offsets = pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([own.column(0), pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))], names=[id_col, out])

    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {id_type}, `{out}` array<double>")


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, width: int = 256, out: str = "embedding") -> DataFrame:
    """Unit vectors of texts by signed feature hashing of their words, for use where no encoder is given.

    A text without words, and a null text, has the zero vector. Words are counted by their MD5 digest inside the JVM: its first
    eight hexadecimal digits give the place, the ninth the sign, so that any engine can repeat it.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"(?U)[^\w]+"), lambda w: w != "")
    counted = df.select(id_col, F.explode_outer(words).alias("w"))
    digest = F.md5(F.col("w").cast("binary"))
    slot = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % width).cast("int")
    sign = F.when(F.substring(digest, 9, 1).isin(*"02468ace"), 1.0).otherwise(-1.0)
    slots = counted.groupBy(id_col, slot.alias("slot")).agg(F.sum(F.when(F.col("w").isNotNull(), sign).otherwise(0.0)).alias("x"))
    wide = slots.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "x")))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    value = lambda i: F.coalesce(F.col("m")[i.cast("int")], F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    return wide.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value).alias(out))
