"""Three streams that keep profiles, retrievals and rankings current.

Each reads a topic of events, does its stage for the micro-batch by the functions of the batch pipeline, and publishes
the next event. State lives in tables, so a restart goes on from the checkpoint and a batch that is replayed merges to
the same rows (at least once). Events that cannot be read or lack a field go to a dead-letter table with the reason.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles, ranking, retrieval
from ..session import cut
from ..sources import files
from ..sources.store import KEYS, opened

# Topics and the fields of their events; every event is keyed by resume_id.
TOPICS = {
    "resume.uploaded": "resume_id string, source_filename string, source_path string, uploaded_at string",
    "resume.parsed": "resume_id string, source_filename string, source_path string, profile_path string, parsed_at string, warning_count int",
    "resume.embedded": "resume_id string, affected_job_ids array<string>, model_name string, top_k int",
    "candidate.ranked": "resume_id string, job_ids array<string>, job_count int, ranked_candidate_count int, top_n int",
}


#: Files, or offsets of a topic, of one micro-batch, and events in a file that is published.
BATCH_FILES, BATCH_OFFSETS, FILE_EVENTS = 16, 1_000, 64


class Bus:
    """Where events come from and go to: Kafka if servers are given, else a folder of JSON files for each topic."""

    def __init__(self, spark: SparkSession, folder: str | None = None, servers: str | None = None):
        if (folder is None) == (servers is None):
            raise ValueError("a bus needs a folder or Kafka servers")
        self.spark, self.folder, self.servers = spark, folder, servers

    def stream(self, topic: str, starting: str = "earliest") -> DataFrame:
        """``key`` and ``value`` of a topic's events from the beginning."""
        if self.servers:
            raw = self.spark.readStream.format("kafka").option("kafka.bootstrap.servers", self.servers).option("subscribe", topic).option("startingOffsets", starting).option("maxOffsetsPerTrigger", BATCH_OFFSETS).load()
            return raw.select(F.col("key").cast("string"), F.col("value").cast("string"))
        return self.spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", BATCH_FILES).json(f"{self.folder}/{topic}")

    def publish(self, events: DataFrame, topic: str) -> None:
        """Append events (key, value)."""
        out = events.select("key", "value")
        if self.servers:
            out.write.format("kafka").option("kafka.bootstrap.servers", self.servers).option("kafka.acks", "all").option("topic", topic).save()
        else:
            out.write.mode("append").option("maxRecordsPerFile", FILE_EVENTS).json(f"{self.folder}/{topic}")


def decoded(events: DataFrame, topic: str, required: tuple[str, ...] = ("resume_id",)) -> DataFrame:
    """Fields of events with ``error``: null for a good event, else what it lacks. An empty value is an empty event."""
    body = F.from_json(F.when(F.trim("value") == "", "{}").otherwise(F.col("value")), TOPICS[topic] + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = events.select("key", "value", body.alias("e")).select("key", "value", "e.*")
    lacks = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(f)) == "", F.lit(True)), F.lit(f)) for f in required)))
    error = F.when(F.col("value").isNull() | F.col("_corrupt").isNotNull(), "malformed").when(F.size(lacks) > 0, F.concat(F.lit("missing "), F.array_join(lacks, ", ")))
    return rows.withColumn("error", error).drop("_corrupt")


class Pipeline:
    """The tables, the bus and the three stages."""

    def __init__(self, spark: SparkSession, root: str, bus: Bus, width: int = 256, top_k: int = 25, top_n: int = 10):
        self.spark, self.bus, self.root = spark, bus, root.rstrip("/")
        self.width, self.top_k, self.top_n = width, top_k, top_n
        self.tables = {name: opened(spark, f"{self.root}/tables", name) for name in KEYS}

    # ---- stages, each for one micro-batch

    def parse(self, events: DataFrame) -> None:
        """Uploaded files become profiles; of files that cannot be read the event is dead."""
        good = self._good(events, "resume.uploaded", ("resume_id", "source_path"))
        named = self._resolved(good)
        self._dead(named.where("file is null").select("key", "value", F.lit("no such file").alias("error")), "resume.uploaded")
        found = [r.file for r in named.where("file is not null").select("file").distinct().collect()]  # as many as a micro-batch has events
        if not found:
            return
        texts = files.extracted(self.spark.read.format("binaryFile").load(found))
        rows = profiles.profiles(texts.where("error is null"))
        bare = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
        of_file = named.where("file is not null").select(bare(F.col("file")).alias("p"), F.col("resume_id").alias("event_id")).dropDuplicates(["p"])
        rows = rows.withColumn("p", bare(F.col("source_path"))).join(of_file, "p").withColumn("resume_id", F.col("event_id")).drop("p", "event_id")
        self.tables["profiles"].merge(rows, ["resume_id"], order=[F.col("source_path").desc()])
        fresh = self.tables["profiles"].read().join(good.select("resume_id").distinct(), "resume_id", "left_semi")
        event = F.struct("resume_id", "source_filename", "source_path", F.lit(None).cast("string").alias("profile_path"), F.col("parsed_at").cast("string"), "warning_count")
        self.bus.publish(fresh.select(F.col("resume_id").alias("key"), F.to_json(event).alias("value")), "resume.parsed")

    def embed(self, events: DataFrame) -> None:
        """Parsed profiles get vectors and enter the top-k lists of the jobs they are near to."""
        from ..functions import documents, scoring

        good = self._good(events, "resume.parsed", ("resume_id",))
        own = self.tables["profiles"].read().join(good.select("resume_id").distinct(), "resume_id", "left_semi")
        text = scoring.candidate_embedding_text(F.col("name"), F.col("skills"), documents.document(F.col("profile_json")))
        vectors = retrieval.hashed_vectors(own.select("resume_id", text.alias("text")), "resume_id", "text", self.width)
        hashed = own.select("resume_id", F.sha2(text, 256).alias("content_sha256")).join(vectors, "resume_id").withColumn("model_name", F.lit(f"hashed-{self.width}")).withColumn("embedding_dim", F.size("embedding"))
        self.tables["profile_vectors"].merge(hashed, ["resume_id"])
        fresh = self.tables["profile_vectors"].read().join(good.select("resume_id").distinct(), "resume_id", "left_semi")
        near = retrieval.top_k(self.tables["job_vectors"].read(), fresh, "job_id", "resume_id", "embedding", self.top_k).select("job_id", "resume_id", "similarity")
        schema = "job_id string, resume_id string, similarity double, retrieval_rank int"
        self.tables["retrievals"].create(schema)
        stored = self.tables["retrievals"].read()
        near = cut(near)
        merged = cut(retrieval.merged_top_k(retrieval.without_outdated(stored, near, fresh), near, self.top_k))
        affected = cut(retrieval.affected_jobs(stored, merged, good))
        self.tables["retrievals"].replace_groups(merged.where("changed").drop("changed"), "job_id")
        event = F.struct("resume_id", "affected_job_ids", F.lit(f"hashed-{self.width}").alias("model_name"), F.lit(self.top_k).alias("top_k"))
        self.bus.publish(affected.select(F.col("resume_id").alias("key"), F.to_json(event).alias("value")), "resume.embedded")

    def rank(self, events: DataFrame) -> None:
        """Jobs whose list changed are ranked anew. An event without a list of jobs stands for all jobs that list its
        candidate; an empty list stands for none."""
        good = self._good(events, "resume.embedded", ("resume_id",))
        lists = self.tables["retrievals"].read()
        named = good.where("affected_job_ids is not null").select("resume_id", F.explode("affected_job_ids").alias("job_id"))
        looked_up = lists.join(good.where("affected_job_ids is null").select("resume_id"), "resume_id", "left_semi").select("resume_id", "job_id")
        wanted = cut(named.unionByName(looked_up).distinct())
        touched = wanted.select("job_id").distinct()
        own = lists.join(touched, "job_id", "left_semi").withColumnRenamed("similarity", "semantic_similarity")
        scored = ranking.ranked(ranking.signals(own, self.tables["jobs"].read(), self.tables["profiles"].read()))
        rows = scored.select("job_id", "resume_id", "retrieval_rank", "ranking_rank", "semantic_similarity", "skill_coverage", "experience_alignment", "education_match", "role_relevance", "final_score", "score_breakdown")
        self.tables["rankings"].replace_groups(rows, "job_id", touched)
        sizes = self.tables["rankings"].read().join(touched, "job_id", "left_semi").groupBy("job_id").agg(F.count("*").alias("n"))
        counts = wanted.join(sizes, "job_id").groupBy("resume_id").agg(F.array_sort(F.collect_set("job_id")).alias("job_ids"), F.sum("n").alias("n"))
        jobs, n = F.coalesce("job_ids", F.expr("cast(array() as array<string>)")), F.coalesce("n", F.lit(0)).cast("int")
        every = good.select("resume_id").distinct().join(counts, "resume_id", "left")
        event = F.struct("resume_id", jobs.alias("job_ids"), F.size(jobs).alias("job_count"), n.alias("ranked_candidate_count"), F.lit(self.top_n).alias("top_n"))
        self.bus.publish(every.select(F.col("resume_id").alias("key"), F.to_json(event).alias("value")), "candidate.ranked")

    # ---- streams

    def start(self, topic: str, available_now: bool = False):
        """Running stream of the stage that reads ``topic``."""
        stage: Callable[[DataFrame], None] = {"resume.uploaded": self.parse, "resume.parsed": self.embed, "resume.embedded": self.rank}[topic]
        writer = self.bus.stream(topic).writeStream.option("checkpointLocation", f"{self.root}/checkpoints/{topic}").queryName(topic.replace(".", "_"))
        writer = writer.foreachBatch(lambda batch, _: None if batch.isEmpty() else stage(batch))
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()

    def drain(self) -> None:
        """Run each stage once over all that is waiting."""
        for topic in ("resume.uploaded", "resume.parsed", "resume.embedded"):
            fs = self.bus.folder
            if fs is None or self._exists(f"{fs}/{topic}"):
                self.start(topic, available_now=True).awaitTermination()

    # ---- helpers

    def _good(self, events: DataFrame, topic: str, required: tuple[str, ...]) -> DataFrame:
        rows = decoded(events, topic, required)
        self._dead(rows.where("error is not null").select("key", "value", "error"), topic)
        return rows.where("error is null")

    def _dead(self, rows: DataFrame, topic: str) -> None:
        rows = rows.select("key", "value", "error", F.lit(topic).alias("topic"))
        rows.write.mode("append").parquet(f"{self.root}/dead_letters")

    def _resolved(self, events: DataFrame) -> DataFrame:
        """Events with ``file``, the file that ``source_path`` names: ``~`` is the home folder, a relative path lies below the
        pipeline's root; null where there is no such file. A micro-batch is bounded, so are the paths that are looked up."""
        rows = []
        for r in events.select("source_path").distinct().collect():
            path = os.path.expanduser(r.source_path.strip()) if r.source_path.strip().startswith("~") else r.source_path.strip()
            if not re.match(r"[a-z][a-z0-9+.-]*:|/", path):
                path = f"{self.root}/{path}"
            rows.append((r.source_path, path if self._exists(path) else None))
        return events.join(self.spark.createDataFrame(rows, "source_path string, file string"), "source_path", "left")

    def _exists(self, path: str) -> bool:
        from ..sources.store import _fs

        fs, p, _ = _fs(self.spark, path)
        return fs.exists(p)
