import json

from rolescope.__main__ import main
from tests.test_structure import RESUME


def test_commands_from_files_to_metrics(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "jd").mkdir()
    for name, text in (("ann", RESUME), ("bob", "Bob Oak\nSKILLS\nGo\n"), ("cat", "Cat Elm\ncat@elm.org\nSKILLS\nPython, Git\n")):
        (tmp_path / "in" / f"{name}.txt").write_text(text)
    (tmp_path / "jd" / "j1.txt").write_text("Job Title: Data Engineer\nExperience Required: 2+ years\nRequired Skills\n- Python\n- Spark\nPreferred Skills\n- Git\nEducation\nBachelor\n")
    (tmp_path / "labels.jsonl").write_text("\n".join(json.dumps({"job_id": "j1", "resume_id": r, "label": n, "split": "train"}) for r, n in (("ann", 3), ("bob", 0), ("cat", 1))))
    s = str(tmp_path / "store")
    for args in (
        ["parse", "--input", str(tmp_path / "in"), "--store", s], ["jobs", "--input", str(tmp_path / "jd"), "--store", s], ["embed", "--store", s, "--width", "64"], ["rank", "--store", s, "--top-n", "2"],
        ["export", "--store", s, "--labels", str(tmp_path / "labels.jsonl"), "--output", str(tmp_path / "export")], ["evaluate", "--export", str(tmp_path / "export")], ["train", "--export", str(tmp_path / "export"), "--model", str(tmp_path / "model")],
        ["audit", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "report")], ["publish", "--input", str(tmp_path / "in"), "--bus", str(tmp_path / "bus")],
    ):
        assert main(args) == 0
    ranked = spark.read.json(str(tmp_path / "store" / "artifacts" / "rankings")).first()
    assert [r["resume_id"] for r in json.loads(ranked.ranking)] == ["ann", "cat"]
    assert "1.0" in capsys.readouterr().out
    assert spark.read.text(str(tmp_path / "report")).count() == 4
    # parsed files are skipped the second time
    main(["parse", "--input", str(tmp_path / "in"), "--store", s])
    assert "|0        |" in capsys.readouterr().out
