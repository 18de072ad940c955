from pyspark.sql import functions as F

from rolescope.functions import text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first().o


def test_normalised_text(spark):
    raw = "  Name \r\n\r\n\r\n\tSkills \rx y\f▪ item  \n\n\n\nend \n"
    assert one(spark, text.normalised, raw) == "Name\n\nSkills\nx y\n• item\n\nend"
    assert one(spark, text.normalised, "") == "" and one(spark, text.normalised, None) is None and one(spark, text.normalised, " \n \t ") == ""


def test_headings(spark):
    cases = {
        "• SKILLS:": "skills", "Work Experience": "experience", "Technical Projects": "skills", "Qualification Certificates": "education", "Academic Profile": "education", "Selected projects & more": "projects",
        "a line about nothing": None, "experience " * 9: None, "": None, "experienced": None,
    }
    for line, section in cases.items():
        assert one(spark, text.section_of, line) == section, line


def test_contacts(spark):
    assert one(spark, text.primary_email, "Mail: Ann.Lee+x@Mail.Example.org, b@c.de") == "ann.lee+x@mail.example.org"
    assert one(spark, text.primary_email, "none here @ all") is None
    assert one(spark, text.primary_phone, "id 12345678 then +91-98765 43210 and more") == "+919876543210"
    assert one(spark, text.primary_phone, "2012 - 2016") is None
    assert one(spark, text.primary_phone, None) is None


def test_lexicon_is_whole_words_and_last_alias(spark):
    assert one(spark, text.lexicon_hits, "Python, c++ and PostgreSQL with postgres; javascript") == ["C", "C++", "JavaScript", "PostgreSQL", "Python"]
    assert one(spark, lambda c: text.lexicon_hits(c, {"node.js": "Node", "nodejs": "Node"}), "uses Node.js") == []
    assert one(spark, lambda c: text.lexicon_hits(c, {"node.js": "Node", "nodejs": "Node"}, last_alias_only=False), "uses Node.js") == ["Node"]
    assert one(spark, text.lexicon_hits, "") == []


def test_token_set(spark):
    assert sorted(one(spark, text.token_set, "The Engineer of Data, data C++ & the (SQL)")) == ["c++", "data", "sql"]
    assert one(spark, text.token_set, None) == [] and one(spark, text.token_set, "...") == []


def test_skill_candidates(spark):
    assert one(spark, text.skill_candidates, "Languages: Python, Java/SQL and Spark | ; ") == ["Python", "Java", "SQL", "Spark"]


def test_ids_and_names(spark):
    assert one(spark, text.sanitised_id, " my résumé (1)! ") == "my-r-sum-1"
    assert one(spark, text.sanitised_id, "!!!") is None
    assert one(spark, text.basename, "/a/b/c.PDF") == "c.PDF"
    assert one(spark, text.stem, "a/b.c/cv.final.PDF") == "cv.final" and one(spark, text.stem, ".env") == ".env"
    assert one(spark, text.suffix, "x/y.Pdf") == ".pdf" and one(spark, text.suffix, "noext") == ""


def test_file_tokens(spark):
    assert one(spark, text.person_tokens, "CV_Ann-Lee_final (2) 2019 March updated_v3") == ["ann", "lee"]
    assert one(spark, lambda c: F.array_join(text.marker_tokens(c), ""), "Ann Lee copy (3)") == "annlee"
    assert one(spark, text.is_template, "Sample_Resume") is True


def test_splits(spark):
    import pytest

    assert one(spark, text.split_name, " Val ") == "validation" and one(spark, text.split_name, "  ") is None and one(spark, text.split_name, None) is None
    assert one(spark, lambda c: text.split_name(c, strict=False), "other") is None
    with pytest.raises(Exception, match="unsupported split"):
        one(spark, text.split_name, "other")


def test_display(spark):
    df = spark.createDataFrame([("Ann Maria Lee", 0.755, 2048), ("", None, 0)], "n string, s double, b long")
    got = df.select(text.initials(F.col("n"), F.lit("cv-1")).alias("i"), text.percent_label(F.col("s")).alias("p"), text.tier(F.col("s")).alias("t"), text.size_label(F.col("b")).alias("z")).collect()
    assert [tuple(r) for r in got] == [("AL", "75.5%", "high", "2.0 KB"), ("CV", "0.0%", "low", "0 B")]
