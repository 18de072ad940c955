"""Lines, sections and blocks of texts, and the parts of job descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import section_of, strip, strip_list_prefix

#: What ends a line, besides line feed and carriage return: vertical tab, form feed, separators and NEL.
LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]"


def lines(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``key``, ``line_no`` (from 0) and stripped ``line`` of each line. Null texts have no lines, empty texts one."""
    return df.where(F.col(text_col).isNotNull()).select(key, F.posexplode(F.split(text_col, LINE_END)).alias("line_no", "line")).withColumn("line", strip(F.col("line")))


def sectioned(numbered: DataFrame, key: str, heading: Column | None = None, default: str = "header") -> DataFrame:
    """Lines with the ``section`` that the last heading above opened; headings themselves are consumed.

    A forward fill over each document's lines.
    """
    opened = section_of(F.col("line")) if heading is None else heading
    marked = numbered.withColumn("_opens", opened)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.withColumn("section", F.coalesce(F.last("_opens", ignorenulls=True).over(w), F.lit(default)))
    return filled.where("_opens is null").drop("_opens")


def section_texts(numbered: DataFrame, key: str) -> DataFrame:
    """``key``, ``section``, ``text``: the lines of each section in order, sections of blank lines only left out."""
    joined = sectioned(numbered, key).groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return joined.select(key, "section", strip(F.array_join(F.transform("l", lambda x: x.line), "\n")).alias("text")).where("text <> ''")


def blocks(numbered: DataFrame, keys: list[str], starts: Column) -> DataFrame:
    """Lines with the number of their ``block``: a blank line ends a block and a line that ``starts`` begins one.

    A running sum of boundaries; blank lines are consumed, blocks are numbered from 1 without gaps.
    """
    blank = F.col("line") == ""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    raw = numbered.withColumn("_b", F.sum((blank | starts).cast("int")).over(w)).where(~blank)
    return raw.withColumn("block", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_b"))).drop("_b")


def job_parts(jobs: DataFrame, key: str = "job_id", text_col: str = "raw_text", sections: dict[str, str] = lexicon.JOB_SECTIONS, labels: dict[str, str] = lexicon.JOB_LABELS, strict: bool = False) -> DataFrame:
    """Parts of job descriptions written as labelled lines and headed lists.

    A labelled line closes the section; a heading may end with a colon, case is ignored; lines outside a section are
    dropped. The last of repeated labels holds. A text without a title has a null ``job_title``, or is an error if
    ``strict``. One row for each key with a text; arrays are empty where a section is missing.
    """
    line = F.col("line")
    label = F.coalesce(*(F.when(line.startswith(k), F.lit(v)) for k, v in labels.items()))
    heading_map = F.create_map(*(F.lit(x) for kv in sections.items() for x in kv))
    heading = heading_map[F.lower(F.trim(F.regexp_replace(line, ":+$", "")))]
    value = strip(F.regexp_replace(line, r"^[^:]*:", ""))
    rows = lines(jobs, key, text_col).where("line <> ''").withColumn("_label", label).withColumn("_heading", F.when(F.col("_label").isNull(), heading))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.coalesce(F.col("_heading"), F.when(F.col("_label").isNotNull(), F.lit("")))
    placed = rows.withColumn("_section", F.last(opened, ignorenulls=True).over(w))
    item = (F.col("_label").isNull() & F.col("_heading").isNull() & (F.col("_section") != ""))
    pick = lambda name: F.transform(F.array_sort(F.collect_list(F.when(item & (F.col("_section") == name), F.struct("line_no", strip_list_prefix(line).alias("v"))))), lambda x: x.v)
    last = lambda name: F.max_by(F.when(F.col("_label") == name, value), F.when(F.col("_label") == name, F.col("line_no")))
    grouped = placed.groupBy(key).agg(*(last(v).alias(v) for v in labels.values()), *(pick(v).alias(v) for v in dict.fromkeys(sections.values())))
    for one in ("about", "education"):
        if one in sections.values():
            grouped = grouped.withColumn(one, F.nullif(strip(F.array_join(one, " ")), F.lit("")))
    if strict:
        title = F.col("job_title")
        grouped = grouped.withColumn("job_title", F.when(F.coalesce(title != "", F.lit(False)), title).otherwise(F.raise_error(F.concat(F.lit("no job title in "), F.col(key).cast("string")))))
    return grouped
