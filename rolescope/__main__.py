"""Command line: ``python -m rolescope COMMAND``. Every command is a thin wrapper around a function of the package."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _session(name: str) -> SparkSession:
    return SparkSession.builder.appName(f"rolescope {name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parse(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Résumé files into the profile table; files whose stem was parsed before are skipped unless --overwrite."""
    from .functions import text
    from .operators import profiles, quality
    from .sources import files, store

    table = store.opened(spark, a.store, "profiles")
    found = files.contents(spark, a.input, limit=a.limit)
    chosen = store.first_of_stem(found.select("path"), a.overwrite)
    if table.exists() and not a.overwrite:
        chosen = store.not_yet_written(chosen.withColumn("resume_id", text.stem(F.col("path"))), table.read(), "resume_id")
    texts = files.extracted(found.join(chosen.select("path"), "path", "left_semi"))
    from .session import written

    texts = written(texts, "texts")  # files are read once
    table.merge(profiles.profiles(texts.where("error is null")), ["resume_id"])
    outcome = texts.select("path", F.when(F.col("error").isNull(), "persisted").otherwise("failed").alias("status"), "error")
    quality.run_failures(outcome).show(20, False)
    return quality.run_manifest(outcome)


def jobs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Job descriptions of a folder into the job table."""
    from .operators import sections
    from .sources import files, store

    texts = files.job_texts(spark, a.input)
    rows = texts.join(sections.job_parts(texts, strict=True), "job_id")
    table = store.opened(spark, a.store, "jobs")
    table.merge(rows, ["job_id"])
    return table.read().agg(F.count("*").alias("jobs"))


def embed(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Hashed vectors of all profiles and jobs, and the top-k profiles of each job."""
    from .functions import documents, scoring
    from .operators import retrieval
    from .sources import store

    t = {n: store.opened(spark, a.store, n) for n in ("profiles", "jobs", "profile_vectors", "job_vectors", "retrievals")}
    own = scoring.candidate_embedding_text(F.col("name"), F.col("skills"), documents.document(F.col("profile_json")))
    t["profile_vectors"].replace(retrieval.hashed_vectors(t["profiles"].read().select("resume_id", own.alias("t")), "resume_id", "t", a.width))
    j = t["jobs"].read()
    asked = scoring.job_embedding_text(*(F.col(c) for c in ("job_title", "about", "responsibilities", "required_skills", "preferred_skills", "education", "good_fit_indicators")))
    t["job_vectors"].replace(retrieval.hashed_vectors(j.select("job_id", asked.alias("t")), "job_id", "t", a.width))
    t["retrievals"].replace(retrieval.top_k(t["job_vectors"].read(), t["profile_vectors"].read(), "job_id", "resume_id", "embedding", a.top_k))
    return t["retrievals"].read().agg(F.countDistinct("job_id").alias("jobs"), F.count("*").alias("retrievals"))


def rank(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Rankings of all retrieved candidates, and the first of each job as JSON."""
    from .operators import ranking
    from .sources import store

    t = {n: store.opened(spark, a.store, n) for n in ("profiles", "jobs", "retrievals", "rankings")}
    pairs = t["retrievals"].read().withColumnRenamed("similarity", "semantic_similarity")
    t["rankings"].replace(ranking.ranked(ranking.signals(pairs, t["jobs"].read(), t["profiles"].read())))
    store.write_json(store.ranking_artifact(t["rankings"].read(), a.top_n), f"{a.store}/artifacts/rankings")
    return ranking.run_counters(t["rankings"].read())


def export(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Features of ranked pairs with their labels as JSON lines."""
    from .operators import evaluation
    from .sources import files, store

    out = evaluation.labelled_export(store.opened(spark, a.store, "rankings").read(), files.label_file(spark, a.labels), a.only_labelled)
    from .session import cut

    out = cut(out)
    store.write_with_manifest(out, a.output, evaluation.export_summary(out))
    return evaluation.export_summary(spark.read.schema(out.schema).json(a.output))


def train(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Learned ranker from an export; metrics of the heuristic and the learned score on the evaluation split."""
    from .operators import evaluation, learning
    from .sources import store

    rows = spark.read.json(a.export)
    model = learning.train_ranker(rows)
    model.write().overwrite().save(a.model)
    both = learning.scored(model, rows).withColumnRenamed("final_score", "heuristic_score")
    chosen = both.where(F.col("split") == (a.split or learning.evaluation_split(rows)))
    metrics = evaluation.mean_metrics(evaluation.job_metrics(evaluation.by_score_field(chosen, ["heuristic_score", "ml_score"])))
    # Beside the model: what it says of every row, and how it compares.
    store.write_json(both.select("job_id", "resume_id", "split", "label", "heuristic_score", "ml_score"), f"{a.model.rstrip('/')}.predictions")
    store.write_json(metrics, f"{a.model.rstrip('/')}.comparison")
    return metrics


def evaluate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Metrics of the score fields of an export that have any value."""
    from .operators import evaluation

    rows = spark.read.json(a.export)
    fields = [f for f in a.fields if f in rows.columns]
    return evaluation.mean_metrics(evaluation.job_metrics(evaluation.by_score_field(rows, fields)))


def audit(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Audit of the file names below a folder, written as Markdown."""
    from .operators import audit as own
    from .session import cut
    from .sources import files, store

    features = cut(own.file_features(files.listed(spark, a.input).select("relative_path", "size_bytes")))
    store.write_lines(own.report(features), a.output)
    return own.totals(features)


def publish(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Upload events of the files in a landing folder."""
    from .sources import files, uploads
    from .streaming.topology import Bus

    checked = uploads.checked(files.listed(spark, a.input).select(F.col("relative_path").alias("filename"), "size_bytes"))
    stored = checked.withColumn("stored_name", F.col("filename"))
    Bus(spark, a.bus, a.servers).publish(uploads.upload_events(stored, a.input), "resume.uploaded")
    return checked.groupBy(F.coalesce("reject", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("files"))


def stream(spark: SparkSession, a: argparse.Namespace) -> None:
    """Run the three streams until stopped, or once over what is waiting."""
    from .streaming.topology import Bus, Pipeline

    pipeline = Pipeline(spark, a.store, Bus(spark, a.bus, a.servers))
    if a.once:
        pipeline.drain()
        return
    for topic in ("resume.uploaded", "resume.parsed", "resume.embedded"):
        pipeline.start(topic)
    spark.streams.awaitAnyTermination()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rolescope", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(run, *options: tuple) -> None:
        c = commands.add_parser(run.__name__, help=run.__doc__)
        for name, kwargs in options:
            c.add_argument(name, **kwargs)
        c.set_defaults(run=run)

    store, folder = ("--store", {"required": True, "help": "folder of the tables"}), ("--input", {"required": True, "help": "folder to read"})
    bus, servers = ("--bus", {"help": "folder of event files"}), ("--servers", {"help": "Kafka servers"})
    command(parse, folder, store, ("--limit", {"type": int}), ("--overwrite", {"action": "store_true"}))
    command(jobs, folder, store)
    command(embed, store, ("--top-k", {"type": int, "default": 25}), ("--width", {"type": int, "default": 256}))
    command(rank, store, ("--top-n", {"type": int, "default": 10}))
    command(export, store, ("--labels", {"required": True}), ("--output", {"required": True}), ("--only-labelled", {"action": "store_true"}))
    command(train, ("--export", {"required": True}), ("--model", {"required": True}), ("--split", {}))
    command(evaluate, ("--export", {"required": True}), ("--fields", {"nargs": "+", "default": ["final_score"]}))
    command(audit, folder, ("--output", {"required": True}))
    command(publish, folder, bus, servers)
    command(stream, store, bus, servers, ("--once", {"action": "store_true"}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    out = a.run(_session(a.command), a)
    if out is not None:
        out.show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
