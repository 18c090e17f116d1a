from threading import Barrier, get_ident

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from cohortwarn.operators import evaluate, models
from cohortwarn.plans import studies
from cohortwarn.plans.studies import Study, ablation, before_after_smote, forest_scores, tuned_forest, warning_reports
from cohortwarn.session import stable


@pytest.fixture(scope="module")
def people(spark):
    """Feature ``x`` decides the label with some noise, ``u`` says nothing."""
    rng = np.random.default_rng(5)
    x, u = rng.normal(size=400), rng.normal(size=400)
    y = (x + rng.normal(scale=0.3, size=400) > -0.8).astype(float)
    data = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, u, y, strict=True))]
    return stable(spark.createDataFrame(data, "row_id long, x double, u double, label double"))


@pytest.fixture(scope="module")
def study(people):
    return Study(people, ["x", "u"])


@pytest.fixture(scope="module")
def forest(study):
    return study.forest(trees=10)


def test_split_of_a_study(study):
    assert (study.train.count(), study.test.count()) == (320, 80)


def test_importances_sum_to_one_and_find_the_signal(forest, spark):
    got = {r.feature: r.importance for r in models.importances(forest, spark).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["x"] > 0.6


def test_predictions_and_accuracy(study, forest):
    scored = models.predict(forest, study.test)
    assert {"features", "rawPrediction", "probability"}.isdisjoint(scored.columns)
    r = evaluate.accuracy(scored).first()
    assert r.n == 80 and r.accuracy > 0.8
    assert study.predictions(forest).columns == ["row_id", "actual", "predicted"]


def test_same_seed_same_forest(study, forest):
    again = study.forest(trees=10)
    one, two = (m.stages[-1].toDebugString.split("\n", 1)[1] for m in (again, forest))
    assert one == two


def test_parameters_translate():
    assert models.forest_classifier(max_depth=None).getMaxDepth() == 30
    assert [models.forest_classifier(max_features=m).getFeatureSubsetStrategy() for m in
            (None, "auto", "sqrt", "log2", 0.3, 4)] == ["all", "sqrt", "sqrt", "log2", "0.3", "4"]
    assert models.tree_classifier(min_leaf=2).getMinInstancesPerNode() == 2
    assert len(models.param_grid(trees=[1, 2], max_depth=[None, 3, 4])) == 6


def test_missing_feature_is_an_error(spark):
    df = spark.createDataFrame([(1.0, None)], "label double, x double")
    with pytest.raises(Exception, match="null"):
        models.assemble(df, ["x"], "label").collect()


def test_rules_name_the_features(study, spark):
    text = " ".join(r.rule for r in models.tree_rules(study.tree(max_depth=2), spark).collect())
    assert "x <=" in text and "feature" not in text.split(")", 1)[1]


def test_out_of_bag(people, study):
    out = models.oob_predictions(people, "row_id", ["x", "u"], "label", trees=8, max_depth=5)
    n = out.count()
    assert 380 < n <= 400 and out.select("row_id").distinct().count() == n
    score = models.oob_score(people, "row_id", ["x", "u"], "label", trees=8, max_depth=5).first()
    assert score.n == n and 0.8 < score.oob_accuracy < 1.0


def test_bag_counts_are_poisson(spark):
    df = spark.range(20000).select(models.bag_count(1, 0, F.col("id")).alias("c"))
    got = df.agg(F.avg("c"), F.var_pop("c"), F.avg((F.col("c") == 0).cast("double"))).first()
    assert tuple(got) == pytest.approx((1.0, 1.0, np.exp(-1)), abs=0.03)


def test_permutation_importance(study, forest):
    got = {r.feature: r for r in models.permutation_importance(forest, study.test, "row_id", "label", 2).collect()}
    assert got["x"].importance_mean > 0.1 > abs(got["u"].importance_mean)
    assert got["x"].importance_std >= 0


def test_out_of_bag_plan_does_not_grow_with_the_trees(people):
    sizes = []
    for trees in (10, 30):
        out = models.oob_predictions(people, "row_id", ["x"], "label", trees=trees, max_depth=1)
        sizes.append(len(out._jdf.queryExecution().analyzed().toString()))
    assert sizes[1] < 1.5 * sizes[0]


def test_bags_in_one_array(spark):
    df = spark.range(300).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    one = [models.bag_count(42, t, F.col("k")).cast("int") for t in range(12)]
    assert df.filter(models.bag_array(42, 12, F.col("k")).cast("array<int>") != F.array(*one)).count() == 0


def test_fits_of_a_grid_share_no_local_properties(people, monkeypatch):
    """Spark keeps the number of the running query there; a fit fails when another one clears it."""
    real, sc, met, seen = RandomForestClassifier.fit, people.sparkSession.sparkContext, Barrier(2), []

    def fit(self, rows, params=None):
        if params and len(seen) < 2:
            mine = str(get_ident())
            sc.setLocalProperty("cohortwarn.fit", mine)
            met.wait(60)
            seen.append(sc.getLocalProperty("cohortwarn.fit") == mine)
            met.wait(60)
        return real(self, rows, params)

    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    models.grid_search(people, "row_id", ["x", "u"], "label", models.param_grid(trees=[1, 2]), folds=2, parallelism=2)
    assert seen == [True, True]


def test_a_fold_without_rows_is_an_error(people):
    with pytest.raises(ValueError, match="data at fold . is empty"):
        models.grid_search(people.limit(2), "row_id", ["x", "u"], "label", models.param_grid(trees=[1]), folds=3)


def test_grid_search(people):
    grid = models.param_grid(trees=[3], max_depth=[1, 4])
    model, settings, report = tuned_forest(people, ["x", "u"], grid, folds=3)
    table = settings.collect()
    assert [r.accuracy for r in table] == sorted((r.accuracy for r in table), reverse=True)
    assert len(table) == 2 and report.count() == 5
    assert models.feature_names(model) == ["x", "u"]


def test_report_by_hand(spark):
    pairs = [(0.0, 0.0)] * 2 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 5 + [(1.0, 0.0)]
    df = spark.createDataFrame(pairs, "label double, prediction double")
    got = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert tuple(got["0.0"])[1:] == pytest.approx((2 / 3, 0.5, 4 / 7, 4))
    assert got["accuracy"].f1 == pytest.approx(0.7)
    assert got["macro avg"].recall == pytest.approx((0.5 + 5 / 6) / 2)
    assert got["weighted avg"].precision == pytest.approx((2 / 3 * 4 + 5 / 7 * 6) / 10)
    assert sorted(tuple(r) for r in evaluate.confusion(df).collect()) == [(0.0, 2, 2), (1.0, 1, 5)]


def test_report_without_predictions_of_a_class_is_zero(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    got = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert tuple(got["0.0"])[1:] == (0.0, 0.0, 0.0, 1)


def test_higher_grades_work_without_any_fail(people, study, forest):
    data = people.select("x", "u", F.when(F.col("row_id") % 4 == 0, "A").when(F.col("row_id") % 4 == 1, "B")
                         .when(F.col("row_id") % 4 == 2, "E").otherwise("-").alias("grade"))
    got = {r.grade: (r.F, r.P) for r in evaluate.higher_grade_check(forest, data).collect()}
    assert got.keys() == {"A", "B"} and all(sum(v) == 100 for v in got.values())
    assert {r.label for r in evaluate.higher_grades(data).select("label").distinct().collect()} == {1.0}


def test_reports_of_whole_studies(people):
    got = ablation(people, ["x", "u"], {"all": [], "no signal": ["x"]}, trees=5)
    acc = {r.variant: r.accuracy for r in got.collect()}
    assert acc["all"] > acc["no signal"]
    assert {r.variant for r in before_after_smote(people, ["x", "u"], trees=3).collect()} == {"as is", "balanced"}
    scores = {r.measure for r in forest_scores(people, ["x", "u"], trees=3).collect()}
    cells = {f"label {a} predicted_{b}" for a in (0, 1) for b in (0, 1)}
    assert scores == {"test accuracy", "oob accuracy", "importance x", "importance u", *cells}
    assert warning_reports(people, ["x", "u"], ["u"], trees=3).select("variant").distinct().count() == 4


def test_balanced_rows_leave_the_test_part_alone(study):
    new = study.resampled("borderline", k=3)
    test_keys = {r.row_id for r in study.test.select("row_id").collect()}
    assert not test_keys & {r.row_id for r in new.select("row_id").collect()}


def test_a_depth_that_spark_does_not_have_is_an_error(people):
    assert models.forest_classifier(max_depth=None).getMaxDepth() == 30
    with pytest.raises(ValueError):
        models.fit_tree(people, ["x"], "label", max_depth=31)


def test_the_studies_use_the_stated_parameters(people, monkeypatch):
    import cohortwarn.plans.studies as plans

    fitted, bags = [], []
    real_fit, real_oob = plans.fit_forest, plans.oob_score
    monkeypatch.setattr(plans, "fit_forest", lambda *a, **k: fitted.append(k) or real_fit(*a, **k))
    monkeypatch.setattr(plans, "oob_score", lambda *a, **k: bags.append(k) or real_oob(*a, **k))
    plans.forest_scores(people, ["x", "u"], trees=2, max_depth=3)
    same = ("trees", "max_depth", "max_features", "min_leaf")
    assert {k: v for k, v in fitted[0].items() if k in same} == {k: v for k, v in bags[0].items() if k in same}
    plans.warning_reports(people, ["x", "u"], dropped=[], trees=2)
    assert fitted[-1]["max_depth"] is None and fitted[-1]["max_features"] is None and fitted[-1]["min_leaf"] == 2


def test_every_row_falls_into_one_leaf(people):
    rows, features = people, ["x", "u"]
    model = models.fit_tree(rows, features, "label", max_depth=5)
    table = models.leaf_rules(model, rows, "label").orderBy("leaf").collect()
    assert len(table) > 4 and sum(r.n for r in table) == rows.count() and all(r.n == r.n_0 + r.n_1 for r in table)
    met = rows.select(*[F.expr(r.rule).cast("int").alias(f"l{r.leaf}") for r in table]).collect()
    assert all(sum(r) == 1 for r in met)
    for r, n in zip(table, [sum(x[i] for x in met) for i in range(len(table))], strict=True):
        assert r.n == n
    told = models.predict(model, rows)
    for r in table:
        assert told.filter(r.rule).filter(F.col("prediction") != r.prediction).isEmpty()


def test_one_leaf_is_a_rule_too(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "x double, label double")
    [r] = models.leaf_rules(models.fit_tree(rows, ["x"], "label"), rows, "label").collect()
    assert (r.leaf, r.depth, r.rule, r.prediction, r.n, r.n_0, r.n_1) == (0, 0, "true", 1.0, 2, 0, 2)


def test_full_study_of_a_course(people):
    rows, features = people, ["x", "u"]
    out = studies.forest_study(rows, features, features[-1:], "borderline", {"trees": 3, "max_depth": 4}, repeats=2,
                               k=2, m=4, trees=3).collect()
    by = {(r.variant, r.measure): r.value for r in out}
    assert {v for v, _ in by} == {"all features", "features dropped", "balanced", "tuned"}
    n_test = {sum(by[v, f"label {a} predicted_{b}"] for a in (0, 1) for b in (0, 1)) for v in {v for v, _ in by}}
    assert len(n_test) == 1  # the test rows stay the same in all variants
    for v in ("all features", "balanced"):
        assert 0 <= by[v, "oob accuracy"] <= 1 and by[v, "report accuracy support"] in n_test
    assert ("all features", f"importance {features[-1]}") in by and ("balanced", f"importance {features[-1]}") not in by
    assert abs(sum(x for (v, m), x in by.items() if v == "tuned" and m.startswith("importance")) - 1) < 1e-9
    assert ("balanced", f"permutation {features[0]}") in by


def test_before_and_after_balancing(people):
    rows, features = people, ["x", "u"]
    for whole in (False, True):
        measures, told = studies.before_after_study(rows, features, trees=3, k=2, whole=whole)
        assert {r.variant for r in measures.select("variant").distinct().collect()} == {"as is", "balanced"}
        n = {r.variant: r["count"] for r in told.groupBy("variant").count().collect()}
        # Made rows are among the test rows only where all rows were balanced first.
        assert (n["balanced"] > n["as is"]) == whole
        assert told.filter("row_id like '%#%'").isEmpty() != whole


def test_rotation_pairs_no_row_with_itself():
    for n in (2, 3, 10, 1000):
        assert all(1 <= models.rotation(42, r, n) < n for r in range(50))


def test_deep_fits_keep_the_node_of_each_row(people):
    """a fit that does not would send the growing trees to every task; the forest is the same."""
    kept = models.forest_classifier(trees=3, max_depth=None, max_features=None, min_leaf=2)
    assert kept.getCacheNodeIds() and models.tree_classifier(max_depth=None).getCacheNodeIds()
    assert not models.forest_classifier().getCacheNodeIds()
    rows = models.assemble(people, ["x", "u"], "label")
    text = lambda c: c.fit(rows).toDebugString.split("\n", 1)[1]
    assert text(kept) == text(kept.copy({kept.cacheNodeIds: False}))
