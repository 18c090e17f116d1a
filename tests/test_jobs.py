"""Studies over school tables with their source names, written and read back."""

import numpy as np
import pytest

from cohortwarn import jobs

COURSE = "MATMAT01c"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("school")
    rng = np.random.default_rng(6)
    students = [f"s{i:03d}" for i in range(160)]

    def write(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")

    write("betyg", [(i, s, COURSE if i % 9 else "matmat01C ", "FEDCBAF-"[i % 8]) for i, s in enumerate(students)]
          + [(1000 + i, s, "MATMAT00c", "ABCDEF"[i % 6]) for i, s in enumerate(students)],
          "id long, slumpkod string, kurs string, betyg string")
    write("franvaro", [(i, s, COURSE, f"20{18 + i % 2}", 90.0, float(rng.integers(0, 40)) if i % 11 else None)
                       for i, s in enumerate(students * 2)],
          "id long, slumpkod string, kurs string, `Läsår` string, `Lektionstid` double, `Frånvarotid` double")
    write("diagnoser", [(i, s, float(rng.integers(0, 30)), int(rng.integers(1, 10)), f"{i % 100}%" if i % 13 else "NULL")
                        for i, s in enumerate(students)],
          "id long, slumpkod string, Matematik double, `Svenska ordkedjor Stanine` int, `Engelska totalt` string")
    counts = "page_views int, participations int, tardiness_breakdown_missing int, tardiness_breakdown_on_time int, " \
             "tardiness_breakdown_late int"
    write("canvas", [(i, s, f"MATMAT01-TE{i % 3}", d, *map(int, rng.integers(1, 9, 5)))
                     for i, (s, d) in enumerate((s, d) for s in students for d in ("2020-02-15", "2020-03-15"))],
          f"id long, slumpkod string, kurs string, datum string, {counts}")
    return path


CASES = {
    "attrition": [], "fails": [], "coverage": [], "correlation": [], "grade_means": [], "warning_table": [],
    "all_variables": [], "histograms": [], "pairs": [], "tree_absence_score": [], "tree_activity": [],
    "forest_baseline": ["--trees", "3"],
    "warning_models": ["--trees", "3", "--prior", "MATMAT00c", "--task", "PF", "--neighbours", "2"],
}


@pytest.mark.parametrize("study", CASES)
def test_study(spark, folder, tmp_path, study):
    out = f"{tmp_path}/out"
    args = ["--tables", str(folder), "--study", study, "--course", COURSE, "--out", out, *CASES[study]]
    jobs.run(spark, jobs.arguments(args))
    got = spark.read.parquet(out)
    assert got.count() > 0
    if study == "attrition":
        n = {r.stage: r.n for r in got.collect()}
        assert n["Grades"] == 160 and n["Diagnostics"] == n["Activity"] == 160
        assert n["Diagnostics E-F"] < n["Diagnostics P-F"] < n["Absence"] < 160
    if study == "warning_table":
        assert {"word_chains", "english_total", "late_factor"} <= set(got.columns)
        assert got.select("row_id").distinct().count() == got.count()
    if study == "coverage":
        n = {(r.variable, r.table_name): r.n for r in got.collect()}
        assert n["Swedish word chains", "diagnosis"] == 160


def test_every_study_is_listed():
    with pytest.raises(SystemExit):
        jobs.arguments(["--tables", "x", "--study", "nope", "--course", "c", "--out", "o"])
