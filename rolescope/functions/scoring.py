"""Signals of a candidate for a job, as column expressions over text, arrays and profile documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import documents, lexicon
from .text import feature_form, token_set

DIGITS = 6


def _some(c: Column) -> Column:
    """Array without nulls; an empty one for a null array."""
    return F.filter(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda s: s.isNotNull())


def skill_forms(skills: Column, drop_empty: bool = False) -> Column:
    """Folded forms of an array of skills; ``drop_empty`` leaves out empty skills, not those that fold to nothing."""
    some = _some(skills)
    return F.transform(F.filter(some, lambda s: s != "") if drop_empty else some, lambda s: feature_form(s))


def folded_coverage(required: Column, preferred: Column, own: Column, text: Column, match: str = "substring", weights: tuple[float, float] = (0.7, 0.3)) -> Column:
    """``skill_coverage`` of arrays and a text that are folded already, so that a text is folded once for each candidate
    and not once for each pair and skill."""
    if match == "substring":
        hit = lambda s: F.array_contains(own, s) | text.contains(s)
    else:
        hit = lambda s: F.array_contains(own, s) | F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), s, F.lit(" ")))
    share = lambda skills: F.size(F.filter(skills, hit)) / F.size(skills)
    some_r, some_p = F.size(required) > 0, F.size(preferred) > 0
    both = F.lit(weights[0]) * share(required) + F.lit(weights[1]) * share(preferred)
    return F.round(F.when(some_r & some_p, both).when(some_r, share(required)).when(some_p, share(preferred)).otherwise(F.lit(0.5)), DIGITS)


def skill_coverage(required: Column, preferred: Column, candidate_skills: Column, candidate_text: Column, match: str = "substring", weights: tuple[float, float] = (0.7, 0.3)) -> Column:
    """Weighted share of a job's required and preferred skills that a candidate has, 0.5 for a job without any.

    A skill is held if its folded form is one of the candidate's skills or occurs in the text, anywhere
    (``match='substring'``) or as whole words (``match='token'``). Null skills are left out; null arrays are empty.
    """
    text = feature_form(F.coalesce(candidate_text, F.lit("")))
    return folded_coverage(skill_forms(required), skill_forms(preferred), skill_forms(candidate_skills, drop_empty=True), text, match, weights)


def required_years(c: Column) -> tuple[Column, Column]:
    """(least, most) years asked for: a range, else a number with a plus; nulls for anything else."""
    span = r"(?i)(\d+)\s*-\s*(\d+)\s*years?"
    plus = r"(?i)(\d+)\+\s*years?"
    number = lambda pattern, k: F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).cast("int")
    return F.coalesce(number(span, 1), number(plus, 1)), number(span, 2)


def span_years(text: Column) -> Column:
    """Years that the years named in a text span, at least 1; null for a text that names none."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"((?:19|20)\d{2})"), 1), lambda y: y.cast("int"))
    width = F.greatest(F.array_max(years) - F.array_min(years), F.lit(1))
    return F.when(F.size(years) > 0, width.cast("double"))


def worked_years(entry_texts: Column, entry_count: Column, most: float = 20.0) -> Column:
    """Sum of the spans of all entries, at most ``most``; the number of entries if none names a year."""
    spans = F.filter(F.transform(entry_texts, span_years), lambda y: y.isNotNull())
    total = F.aggregate(spans, F.lit(0.0), lambda a, y: a + y)
    return F.when(F.size(spans) > 0, F.least(total, F.lit(most))).otherwise(entry_count.cast("double"))


def profile_years(doc: Column) -> Column:
    """Worked years of a profile document: of each experience the date range, else its raw text."""
    entries = documents.entries(doc, "$.experience")
    some = F.filter(entries, lambda e: ~F.is_variant_null(e))
    texts = F.transform(some, lambda e: F.lower(F.coalesce(F.nullif(F.try_variant_get(e, "$.date_range", "string"), F.lit("")), F.try_variant_get(e, "$.raw_text", "string"), F.lit(""))))
    return worked_years(texts, F.size(some))


def experience_alignment(required: Column, years: Column) -> Column:
    """0.5 if nothing is asked, else the share of the asked years that is worked, at most 1."""
    least, _ = required_years(required)
    share = F.least(years / F.greatest(least, F.lit(1)), F.lit(1.0))
    return F.when(least.isNull(), F.lit(0.5)).when(years <= 0, F.lit(0.0)).otherwise(F.round(share, DIGITS))


# What folded education texts hold at each level, highest first.
LEVELS = ((4, ("phd", "doctorate")), (3, ("master", "m tech", "m e")), (2, ("bachelor", "b tech", "b e", "dual degree")), (1, ("class xii", "class x", "secondary")))


def education_level(c: Column, levels: tuple[tuple[int, tuple[str, ...]], ...] = LEVELS) -> Column:
    """Level of a text, 0 for null and for texts that tell none."""
    form = feature_form(F.coalesce(c, F.lit("")))
    chain = [(level, reduce(lambda x, y: x | y, [form.contains(w) for w in words])) for level, words in levels]
    out = F.when(chain[0][1], chain[0][0])
    for level, held in chain[1:]:
        out = out.when(held, level)
    return out.otherwise(0)


def education_match(job_education: Column, candidate_level: Column) -> Column:
    job = education_level(job_education)
    some = F.when(candidate_level > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return F.when(job == 0, some).when(candidate_level >= job, F.lit(1.0)).otherwise(some)


def profile_level(doc: Column) -> Column:
    """Highest education level of a profile document."""
    levels = F.transform(documents.entry_texts(doc, "$.education", "raw_text"), lambda t: education_level(t))
    return F.coalesce(F.array_max(levels), F.lit(0))


def role_relevance(title_tokens: Column, candidate_tokens: Column) -> Column:
    """Share of the title's words that the candidate's text has, 0 for a title without words."""
    share = F.size(F.array_intersect(title_tokens, candidate_tokens)) / F.size(title_tokens)
    return F.when(F.size(title_tokens) > 0, F.round(share, DIGITS)).otherwise(F.lit(0.0))


def final_score(signals: dict[str, Column], weights: dict[str, float] = lexicon.WEIGHTS) -> Column:
    """Weighted sum of the signals in the order of ``weights``; null if any signal is null.

    Rounded at nine decimals first: the last bits of the sum must not decide which way a half is rounded.
    """
    total = reduce(lambda x, y: x + y, [F.lit(w) * signals[name] for name, w in weights.items()])
    return F.round(F.round(total, 9), DIGITS)


def breakdown(signals: dict[str, Column]) -> Column:
    """Map of the named signals."""
    return F.create_map(*(x for name, c in signals.items() for x in (F.lit(name), c)))


def stored_or_counted(stored: Column, items: Column) -> Column:
    """Stored count, or the number of items where it is null or zero."""
    return F.when(F.coalesce(stored, F.lit(0)) != 0, stored).otherwise(F.greatest(F.size(items), F.lit(0)))


def parser_quality(warnings: Column, has_name: Column, has_email: Column, has_phone: Column, skills: Column, experiences: Column) -> Column:
    """1 less what a parsed profile lacks, at least 0; null counts are zero, null flags false."""
    some = lambda flag: F.coalesce(flag, F.lit(False))
    number = lambda c: F.coalesce(c, F.lit(0))
    score = (
        F.lit(1.0) - F.least(F.greatest(number(warnings), F.lit(0)), F.lit(5)) * 0.08 - F.when(some(has_name), 0.0).otherwise(0.15) - F.when(some(has_email), 0.0).otherwise(0.10)
        - F.when(some(has_phone), 0.0).otherwise(0.05) - F.when(number(skills) == 0, 0.10).otherwise(0.0) - F.when(number(experiences) == 0, 0.05).otherwise(0.0)
    )
    return F.round(F.greatest(score, F.lit(0.0)), DIGITS)


def similarity(inner_product: Column, digits: int | None = None) -> Column:
    """Inner product of unit vectors on the scale from 0 to 1."""
    s = (inner_product + 1) / 2
    return s if digits is None else F.round(s, digits)


def split_bucket(c: Column, train: float = 0.7, validation: float = 0.85) -> Column:
    """Split of an id by the first byte of its SHA-1, the same for ever."""
    share = F.conv(F.substring(F.sha1(c.cast("binary")), 1, 2), 16, 10).cast("int") / F.lit(255.0)
    return F.when(share < train, "train").when(share < validation, "validation").otherwise("test")


def size_ratio(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.least(a, b) / F.greatest(a, b))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the smaller of two word sets that both hold, 0 if one is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


# ---- texts of a candidate and of a job

def candidate_feature_text(skills: Column, doc: Column) -> Column:
    """Skills, then the raw text of experience, projects, education and the document, one a line."""
    parts = [F.array_join(skills, ", "), *(F.array_join(documents.entry_texts(doc, f"$.{m}", "raw_text"), "\n") for m in ("experience", "projects", "education")), documents.text_at(doc, "$.raw_text")]
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))


def candidate_embedding_text(name: Column, skills: Column, doc: Column) -> Column:
    """Labelled parts of a profile; the raw text if it has none of them."""
    labelled = lambda label, c: F.concat(F.lit(f"{label}: "), F.nullif(c, F.lit("")))
    parts = [labelled("Candidate", name), labelled("Skills", F.array_join(skills, ", "))]
    parts += [labelled(label, F.array_join(documents.entry_texts(doc, f"$.{m}", "raw_text"), " ")) for label, m in (("Experience", "experience"), ("Projects", "projects"), ("Education", "education"))]
    parts.append(labelled("Achievements", documents.text_at(doc, "$.sections.achievements")))
    joined = F.nullif(F.concat_ws("\n", *parts), F.lit(""))
    return F.trim(F.coalesce(joined, documents.text_at(doc, "$.raw_text"), F.lit("")))


def job_embedding_text(title: Column, about: Column, responsibilities: Column, required: Column, preferred: Column, education: Column, good_fit: Column) -> Column:
    some = lambda label, c: F.concat(F.lit(f"{label}: "), F.nullif(c, F.lit("")))
    parts = [
        F.concat(F.lit("Job Title: "), F.coalesce(title, F.lit(""))), some("About", about), some("Responsibilities", F.array_join(responsibilities, " ")), some("Required Skills", F.array_join(required, ", ")),
        some("Preferred Skills", F.array_join(preferred, ", ")), some("Education", education), some("Good Fit", F.array_join(good_fit, " ")),
    ]
    return F.trim(F.concat_ws("\n", *parts))


def title_tokens(title: Column, stopwords: tuple[str, ...] = lexicon.STOPWORDS) -> Column:
    return token_set(title, stopwords)
