"""Personal information inside free text (problem 3): detection and redaction over a table of profiles.

The detector is fitted on bounded samples on the driver and shipped to the tasks, which propose, describe and score
spans batch by batch: one narrow pass over the profiles, whole texts, no shuffle before the distinct rows at the end.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii_model import SAMPLED_NAMES, SAMPLED_ROWS, Detector, fit_detector
from .pii_spans import KINDS, Record, document_of, free_texts, known_values, pieces_of, redacted

#: Profiles that a worker holds as Python objects at once, and characters of one such slice.
SLICE_ROWS, SLICE_CHARS = 250, 2_000_000


def _record(name: str | None, email: str | None, phone: str | None, document) -> Record:
    return Record((name or "").strip(), (email or "").strip(), (phone or "").strip(), known_values(document))


def _sample(rows: DataFrame, order: str, least: int, total: int) -> list:
    """The ``least`` rows of the lowest hash ``h`` of about ``total``: rows beyond a hash that half as many again have are never
    sent, so what reaches the driver is bounded at every size."""
    beyond = min(1.0, 1.5 * least / max(total, 1))
    return sorted(rows.where(F.col("h") < int(beyond * (1 << 40))).collect(), key=lambda r: (r.h, r[order]))[:least]


def fitted_detector(profiles: DataFrame, sampled_rows: int = SAMPLED_ROWS, sampled_names: int = SAMPLED_NAMES) -> Detector:
    """Detector fitted on ``sampled_rows`` rows and ``sampled_names`` names, those of the least hash of their id, besides the
    invented documents."""
    hashed = F.pmod(F.xxhash64("resume_id", "updated_at"), F.lit(1 << 40)).alias("h")
    total = profiles.count()
    names = _sample(profiles.where("name is not null").select("name", hashed), "name", sampled_names, total)
    sample = _sample(profiles.where("profile_json is not null").select("profile_json", "name", "email", "phone", hashed), "profile_json", sampled_rows, total)
    rows = []
    for r in sample:
        document = document_of(r.profile_json)
        rows.append(([t for _, t in free_texts(document)], _record(r.name, r.email, r.phone, document)))
    return fit_detector([r.name for r in names], rows)


def _scanned(profiles: DataFrame, detector: Detector, keys: list[str], run_slice, schema: str) -> DataFrame:
    """Apply ``run_slice(keys, texts, found)`` to slices of profiles; ``texts`` are (path, text) lists."""
    source = profiles.select(*keys, F.col("profile_json").cast("string").alias("_json"), F.col("name").alias("_name"), F.col("email").alias("_email"), F.col("phone").alias("_phone"))
    n = len(keys)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                high, size = low, 0
                while high < batch.num_rows and high - low < SLICE_ROWS and size < SLICE_CHARS:
                    size += len(batch.column(n)[high].as_py() or "")
                    high += 1
                yield batch.slice(low, high - low)
                low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a slice makes has no cycles: looking for them again and again costs a tenth of the time.
        gc.disable()
        try:
            for part in slices(batches):
                texts, items = [], []
                for json_text, name, email, phone in zip(*(part.column(n + k).to_pylist() for k in range(4)), strict=True):
                    document = document_of(json_text)
                    texts.append(free_texts(document))
                    items.append(([t for _, t in texts[-1]], _record(name, email, phone, document)))
                yield run_slice([part.column(k) for k in range(n)], texts, items, detector.find(items))
        finally:
            gc.enable()

    return source.mapInArrow(run, schema)


def found_spans(profiles: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``p3_found``: ``resume_id``, ``kind``, ``found_text`` of each distinct stretch, over all rows of the table.

    A null, malformed or empty document has no free text and no rows.
    """
    detector = detector or fitted_detector(profiles)

    def run_slice(keys, texts, items, found) -> pa.RecordBatch:
        own = [sorted({(k, t) for k, _, _, t in f}) for f in found]
        at = pa.array([i for i, f in enumerate(own) for _ in f], pa.int32())
        return pa.RecordBatch.from_arrays(
            [keys[0].take(at), pa.array([KINDS[k] for f in own for k, _ in f], pa.string()), pa.array([t for f in own for _, t in f], pa.string())], names=["resume_id", "kind", "found_text"]
        )

    return _scanned(profiles, detector, ["resume_id"], run_slice, "resume_id string, kind string, found_text string").distinct()


def redacted_texts(profiles: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``resume_id``, ``updated_at``, ``path``, ``text``: the free text of every row with typed placeholders in place of
    personal information, all else as it was. Paths name the member, such as ``experience[0].description``."""
    detector = detector or fitted_detector(profiles)

    def run_slice(keys, texts, items, found) -> pa.RecordBatch:
        at, paths, out = [], [], []
        for i, (own, spans) in enumerate(zip(texts, found, strict=True)):
            by_piece = _by_piece([t for _, t in own], spans)
            for path, text in own:
                at.append(i)
                paths.append(path)
                out.append(redacted(text, by_piece))
        where = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays([keys[0].take(where), keys[1].take(where), pa.array(paths, pa.string()), pa.array(out, pa.string())], names=["resume_id", "updated_at", "path", "text"])

    stamp = profiles.schema["updated_at"].dataType.simpleString()
    return _scanned(profiles, detector, ["resume_id", "updated_at"], run_slice, f"resume_id string, updated_at {stamp}, path string, text string")


def _by_piece(texts: list[str], spans: list[tuple[int, int, int, str]]) -> dict[str, list[tuple[int, int, str]]]:
    """Spans of joined pieces as positions within each piece."""
    out: dict[str, list[tuple[int, int, str]]] = {}
    ordered = sorted((start, end, kind) for kind, start, end, _ in spans)
    at = k = 0
    for piece in pieces_of(texts):
        high = at + len(piece)
        while k < len(ordered) and ordered[k][0] < high:
            start, end, kind = ordered[k]
            out.setdefault(piece, []).append((start - at, end - at, KINDS[kind]))
            k += 1
        at = high + 1
    return out


def span_report(found: DataFrame) -> DataFrame:
    """Distinct stretches and profiles of each kind."""
    return found.groupBy("kind").agg(F.count("*").alias("stretches"), F.countDistinct("resume_id").alias("profiles"))
