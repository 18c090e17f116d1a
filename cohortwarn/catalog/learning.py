"""Splits, folds, resampling, scores and models."""

from pyspark.sql import functions as F

from cohortwarn.catalog.registry import COHORT, PICKS_SQL, SQL, register, rounded
from cohortwarn.functions import encode_label, hash_unit
from cohortwarn.operators import evaluate, models, ranks, smote
from cohortwarn.operators.clean import build_task, TASK_EXCLUDES
from cohortwarn.plans import studies
from cohortwarn.plans.studies import (
    TUNED,
    Study,
    ablation,
    forest_scores,
    forest_study,
    task_studies,
    tree_report,
    tuned_forest,
)
from cohortwarn.plans.tables import early_warning, task
from cohortwarn.session import stable
from cohortwarn.sources import cohort_tables

FEATURES = ["absence_time", "math_score", "english_total"]


def graded_scores(spark, path):
    """Grade and three scores per student of the course, complete rows; computed once, for the jobs of a fit and a score."""
    return stable(early_warning(cohort_tables(spark, path), COHORT, activity=False), "scores")


def score_table(spark, path, name="PF", kept=False):
    """Label and three scores per student of the course, complete rows.

    With ``kept`` they are computed once; a :class:`Study` and the resampling methods do that themselves.
    """
    return task(graded_scores(spark, path) if kept else early_warning(cohort_tables(spark, path), COHORT, activity=False), name)


SCORES_SQL = PICKS_SQL + """
, scores as (select g1.student_id as row_id, g1.grade, a1.absence_time, d.math_score,
    cast(replace(d.english_total, '%', '') as integer) as english_total
  from g1 join a1 using (student_id) join diagnostics d using (student_id)
  where a1.absence_time is not null and d.math_score is not null and d.english_total <> 'NULL')
, pf as (select *, case when grade = 'F' then 0.0 else 1.0 end::double as label from scores where grade <> '-')
, ef as (select *, case when grade = 'F' then 0.0 else 1.0 end::double as label from scores where grade in ('E', 'F'))
"""


def unit_sql(seed: str, *cols: str) -> str:
    text = "|".join([seed]) + "|"
    return f"(cast('0x' || substr(md5('{text}' || {(' || chr(124) || ').join(cols)}), 1, 8) as bigint) / 4294967296.0::double)"


@register(
    """select id, cast(row_number() over (order by md5('42|' || id), id) <= floor((select count(*) from grades) * 0.8)
    as integer) as is_train from grades""", cohort=True)
def train_test_split(spark, path):
    return ranks.mark_split(cohort_tables(spark, path).grades.select("id"), ["id"], train=0.8)


@register(
    """select id, cast(row_number() over (order by md5('10|' || id), id) <=
    (select count(*) - ceil(count(*) * 0.3) from grades) as integer) as is_train from grades""", cohort=True)
def test_share_split(spark, path):
    return ranks.mark_split(cohort_tables(spark, path).grades.select("id"), ["id"], test=0.3, seed=10)


@register(f"select id, case when {unit_sql('42', 'id')} < 0.8 then 1 else 0 end as is_train from grades", cohort=True)
def threshold_split(spark, path):
    train, test = ranks.threshold_split(cohort_tables(spark, path).grades.select("id"), ["id"], 0.8)
    return train.withColumn("is_train", F.lit(1)).unionByName(test.withColumn("is_train", F.lit(0)))


@register(
    """select id, grade, cast((row_number() over (partition by grade order by md5('42|' || id), id) - 1) % 4 as integer)
    as fold from grades""", cohort=True)
def stratified_folds(spark, path):
    return ranks.assign_folds(cohort_tables(spark, path).grades.select("id", "grade"), ["id"], "grade", 4)


_SCORED_SQL = f"""
, scored as (select id, case when grade = 'F' then 0.0 else 1.0 end::double as label,
  case when {unit_sql('7', 'id')} < 0.3 then 0.0 else 1.0 end::double as prediction from grades where grade <> '-')
"""


def scored_rows(spark, path):
    """All graded rows with a prediction made from a hash, so scores can be checked without a model."""
    rows = build_task(cohort_tables(spark, path).grades, TASK_EXCLUDES["PF"])
    return rows.select("id", encode_label(F.col("grade")).alias("label"),
                       (hash_unit(7, F.col("id")) >= 0.3).cast("double").alias("prediction"))


@register(_SCORED_SQL + """select count(*) as n, round(avg(case when label = prediction then 1.0 else 0.0 end), 6)
          as accuracy from scored""", cohort=True)
def accuracy(spark, path):
    return rounded(evaluate.accuracy(scored_rows(spark, path)), "accuracy")


@register(_SCORED_SQL + """select label, count(*) filter (prediction = 0) as predicted_0,
          count(*) filter (prediction = 1) as predicted_1 from scored group by label""", cohort=True)
def confusion_matrix(spark, path):
    return evaluate.confusion(scored_rows(spark, path))


@register(_SCORED_SQL + """
, c as (select unnest([0.0, 1.0])::double as class)
, per as (select class, (select count(*) from scored where label = class and prediction = class) as hits,
    (select count(*) from scored where label = class) as support,
    (select count(*) from scored where prediction = class) as predicted from c)
, pr as (select *, hits / predicted as precision, hits / support as recall from per)
, f as (select *, 2 * precision * recall / (precision + recall) as f1 from pr)
select case class when 0 then '0.0' else '1.0' end as class, round(precision, 6) as precision, round(recall, 6) as recall,
  round(f1, 6) as f1, cast(support as bigint) as support from f
union all select 'accuracy', null, null, round(sum(hits) / sum(support), 6), cast(sum(support) as bigint) from f
union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  cast(sum(support) as bigint) from f
union all select 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  cast(sum(support) as bigint) from f""", cohort=True)
def classification_report(spark, path):
    return rounded(evaluate.classification_report(scored_rows(spark, path)), "precision", "recall", "f1")


@register(_SCORED_SQL + "select id, label as actual, prediction as predicted from scored", cohort=True)
def prediction_table(spark, path):
    return evaluate.prediction_table(scored_rows(spark, path), "id")


@register(
    SCORES_SQL + """select row_id, cast(label as double) as label, cast(absence_time as double) as absence_time,
    math_score, cast(english_total as double) as english_total from pf""", cohort=True)
def assembled_features(spark, path):
    """The feature vector taken apart again, so that its content can be compared."""
    from pyspark.ml.functions import vector_to_array

    rows = models.assemble(score_table(spark, path), FEATURES, "label")
    vec = vector_to_array("features")
    return rows.select("row_id", "label", *[vec[i].alias(c) for i, c in enumerate(FEATURES)])


def _pair_cte(name: str, left: str, right: str, k: int) -> str:
    """k nearest rows of ``right`` for each row of ``left``, by brute force."""
    d2 = " + ".join(f"(l.{c} - r.{c}) * (l.{c} - r.{c})" for c in FEATURES)
    return f""", {name} as (select *, row_number() over (partition by row_id order by d2, nb) as rn from (
      select l.row_id, r.row_id as nb, r.label as nb_label, {d2} as d2, {", ".join(f"r.{c} as r_{c}" for c in FEATURES)}
      from {left} l join {right} r on l.row_id <> r.row_id) qualify rn <= {k})"""


_SMALL_SQL = SCORES_SQL + """
, small as (select * from pf where label = 0), large as (select * from pf where label = 1)
, sizes as (select (select count(*) from small) as n_small, (select count(*) from large) as n_large)
"""


def _copies_cte(base: str) -> str:
    return f"""
, ranked as (select *, row_number() over (order by md5('42|' || row_id), row_id) - 1 as rk from {base})
, need as (select greatest(0, n_large - n_small) as need, (select count(*) from {base}) as nb from sizes)
, times as (select ranked.*, need // nb + case when rk < need % nb then 1 else 0 end as t from ranked, need)
, copies as (select times.*, unnest(range(1, t + 1)) as syn_no from times)
, chosen as (select *, {unit_sql('42n', 'row_id', 'syn_no')} as pick, {unit_sql('42u', 'row_id', 'syn_no')} as u from copies)
"""


_KEPT = "select row_id, cast(0 as integer) as syn_no, {}, label from pf union all ".format(
    ", ".join(f"round({c}, 6) as {c}" for c in FEATURES))


@register(
    _SMALL_SQL + _pair_cte("near", "small", "small", 5) + _copies_cte("small") + _KEPT
    + "select row_id, cast(syn_no as integer), " + ", ".join(f"round({c} + u * (r_{c} - {c}), 6)" for c in FEATURES)
    + ", 0.0 from chosen join near using (row_id) where near.rn = floor(pick * 5) + 1", cohort=True)
def smote_rows(spark, path):
    rows = score_table(spark, path).select("row_id", *FEATURES, "label")
    return rounded(smote.smote(rows, "row_id", FEATURES, "label"), *FEATURES)


@register(SQL["smote_rows"], name="smote_rows_many_leaves")
def smote_rows_many_leaves(spark, path):
    """The same rows when the neighbour search spreads over many leaves and groups."""
    rows = score_table(spark, path).select("row_id", *FEATURES, "label")
    return rounded(smote.smote(rows, "row_id", FEATURES, "label", leaf_rows=16, visitors=8), *FEATURES)


_DANGER = _pair_cte("around", "small", "pf", 10) + """
, marked as (select row_id, count(*) filter (nb_label = 1) as n_majority from around group by row_id)
, border as (select small.* from small join marked using (row_id) where n_majority * 2 >= 10 and n_majority < 10)
"""


@register(
    _SMALL_SQL + _DANGER + """select row_id, absence_time, math_score, english_total, label,
    cast(n_majority as integer) as n_majority,
    case when n_majority * 2 >= 10 and n_majority < 10 then 1 else 0 end as danger
    from small join marked using (row_id)""", cohort=True)
def danger_rows(spark, path):
    rows = score_table(spark, path).select("row_id", *FEATURES, "label")
    return smote.danger_points(rows, "row_id", FEATURES, "label")


@register(SQL["danger_rows"], name="danger_rows_many_leaves")
def danger_rows_many_leaves(spark, path):
    rows = score_table(spark, path).select("row_id", *FEATURES, "label")
    return smote.danger_points(rows, "row_id", FEATURES, "label", leaf_rows=32, visitors=16)


@register(
    _SMALL_SQL + _DANGER + _pair_cte("near_small", "border", "small", 5) + _pair_cte("near_large", "border", "large", 5)
    + _copies_cte("border") + _KEPT
    + "select row_id, cast(syn_no as integer), "
    + ", ".join(f"round({c} + u * (r_{c} - {c}), 6)" for c in FEATURES)
    + """, 0.0 from chosen join near_small using (row_id) where syn_no % 2 = 1 and near_small.rn = floor(pick * 5) + 1
    union all select row_id, cast(syn_no as integer), """
    + ", ".join(f"round({c} + u * 0.5 * (r_{c} - {c}), 6)" for c in FEATURES)
    + ", 0.0 from chosen join near_large using (row_id) where syn_no % 2 = 0 and near_large.rn = floor(pick * 5) + 1",
    cohort=True)
def borderline_smote_rows(spark, path):
    rows = score_table(spark, path).select("row_id", *FEATURES, "label")
    return rounded(smote.borderline_smote2(rows, "row_id", FEATURES, "label"), *FEATURES)


@register(SQL["borderline_smote_rows"], name="borderline_smote_rows_many_leaves")
def borderline_smote_rows_many_leaves(spark, path):
    """The same rows when one placement of many leaves answers all three lists."""
    rows = score_table(spark, path).select("row_id", *FEATURES, "label")
    return rounded(smote.borderline_smote2(rows, "row_id", FEATURES, "label", leaf_rows=16, visitors=8), *FEATURES)


def bag_sql(tree: int, seed: int = 42) -> str:
    """How often a row is in the bag of a tree."""
    u = unit_sql(f"{seed}bag{tree}", "row_id")
    return "(" + " + ".join(f"(case when {u} >= {b!r} then 1 else 0 end)" for b in models.bag_bounds()) + ")::double"


def stump_sql(name: str, rows: str, x: str, weight: str = "1.0::double") -> str:
    """The best single gini cut of a whole-number feature: ``<name>_best`` with class-1 shares of both sides.

    Sides that predict the same class are one leaf in the fitted tree, so both get its share.
    """

    def gini(zero: str, every: str) -> str:
        return f"(1 - ({zero} / {every}) * ({zero} / {every}) - (1 - {zero} / {every}) * (1 - {zero} / {every}))"

    return f""", {name}_rows as (select {x} as x, label, {weight} as wt from {rows} where {weight} > 0)
, {name}_v as (select distinct x from {name}_rows)
, {name}_cuts as (select (x + lead(x) over (order by x)) / 2.0 as cut from {name}_v)
, {name}_sides as (select cut, sum(wt) filter (x <= cut) as wl, coalesce(sum(wt) filter (x <= cut and label = 0), 0) as l0,
    sum(wt) as w, coalesce(sum(wt) filter (label = 0), 0) as w0
  from {name}_cuts, {name}_rows where cut is not null group by cut)
, {name}_cut as (select cut, 1 - l0 / wl as pl, 1 - (w0 - l0) / (w - wl) as pr, 1 - w0 / w as p from {name}_sides
  order by (wl / w) * {gini('l0', 'wl')} + ((w - wl) / w) * {gini('(w0 - l0)', '(w - wl)')}, cut limit 1)
, {name}_best as (select cut, case when (pl > 0.5) = (pr > 0.5) then p else pl end as p_left,
    case when (pl > 0.5) = (pr > 0.5) then p else pr end as p_right from {name}_cut)
"""


def stump_predicts(name: str, x: str) -> str:
    return f"(case when case when {x} <= {name}_best.cut then p_left else p_right end > 0.5 then 1.0 else 0.0 end)::double"


def stump(spark, path):
    """One split on a whole-number feature is exact, so SQL can name the same cut."""
    rows = score_table(spark, path, "EF", kept=True)
    return rows, models.fit_tree(rows, ["english_total"], "label", max_depth=1)


_STUMP_SQL = SCORES_SQL + stump_sql("s", "ef", "english_total")


@register(_STUMP_SQL + f"select row_id, {stump_predicts('s', 'english_total')} as prediction from ef, s_best", cohort=True)
def tree_of_depth_one(spark, path):
    rows, model = stump(spark, path)
    return models.predict(model, rows).select("row_id", "prediction")


@register(
    _STUMP_SQL + f""", scored as (select grade, {stump_predicts('s', 'english_total')} as p from scores, s_best
      where grade in ('A', 'B', 'C', 'D'))
    select grade, count(*) filter (p = 0) as "F", count(*) filter (p = 1) as "P" from scored group by grade""", cohort=True)
def higher_grades_by_stump(spark, path):
    every = graded_scores(spark, path)
    model = models.fit_tree(task(every, "EF"), ["english_total"], "label", max_depth=1)
    return evaluate.higher_grade_check(model, every)


_SHUFFLED = """, ranked as (select *, row_number() over (order by md5('42p|' || row_id), row_id) - 1 as rk,
    count(*) over () as n from ef)
, turns as (select r, floor(('0x' || substr(md5('42turn|' || r), 1, 8))::bigint / 4294967296.0 * greatest(1, (select count(*) from ef) - 1))::bigint + 1 as by_
    from (values (0), (1), (2)) t(r))
, drops as (select """ + f"""avg(case when {stump_predicts('s', 'a.english_total')} = a.label then 1.0 else 0.0 end)
      - avg(case when {stump_predicts('s', 'b.english_total')} = a.label then 1.0 else 0.0 end) as loss
    from ranked a cross join turns join ranked b on b.rk = (a.rk + by_) % a.n, s_best group by r)"""


@register(
    _STUMP_SQL + _SHUFFLED + """ select 'english_total' as feature,
    round(avg(loss), 6) as importance_mean, round(stddev_pop(loss), 6) as importance_std from drops""", cohort=True)
def permutation_by_stump(spark, path):
    rows, model = stump(spark, path)
    out = models.permutation_importance(model, rows, "row_id", "label", repeats=3)
    return rounded(out, "importance_mean", "importance_std")


_OOB_TREES = 3


@register(
    SCORES_SQL + "".join(stump_sql(f"t{t}", "ef", "english_total", bag_sql(t)) for t in range(_OOB_TREES))
    + ", votes as (" + " union all ".join(
        f"""select row_id, label, case when english_total <= cut then p_left else p_right end as p
        from ef, t{t}_best where {bag_sql(t)} = 0""" for t in range(_OOB_TREES))
    + """) select row_id, label, case when sum(p) * 2 > count(*) then 1.0 else 0.0 end::double as prediction
    from votes group by row_id, label""", cohort=True)
def out_of_bag_stumps(spark, path):
    rows = score_table(spark, path, "EF")
    return models.oob_predictions(rows, "row_id", ["english_total"], "label", trees=_OOB_TREES, max_depth=1)


_WHOLE = {"score only": "english_total", "absence only": "absence_time"}


@register(
    SCORES_SQL + """
    , tt as (select *, row_number() over (order by md5('42|' || row_id), row_id)
        <= floor((select count(*) from ef) * 0.8) as is_train from ef)
    , tr as (select * from tt where is_train), te as (select * from tt where not is_train)"""
    + "".join(stump_sql(f"w{i}", "tr", x) for i, x in enumerate(_WHOLE.values()))
    + " union all ".join(
        f"""select '{name}' as variant, 1 as n_features, count(*) as n,
        round(avg(case when {stump_predicts(f'w{i}', x)} = label then 1.0 else 0.0 end), 6) as accuracy
        from te, w{i}_best""" for i, (name, x) in enumerate(_WHOLE.items())), cohort=True)
def ablation_by_stump(spark, path):
    """One-cut trees on what is left after each removal, scored on the test rows."""
    drops = {name: [x for x in _WHOLE.values() if x != kept] for name, kept in _WHOLE.items()}
    out = ablation(score_table(spark, path, "EF"), list(_WHOLE.values()), drops,
                   trees=1, max_depth=1, max_features=None, bootstrap=False)
    return rounded(out, "accuracy")


@register()
def decision_tree(spark, path):
    study = Study(score_table(spark, path, "EF"), FEATURES, test=0.2, seed=10)
    return study.predictions(study.tree(max_depth=5))


@register()
def tree_rules(spark, path):
    rows = score_table(spark, path, "EF", kept=True)
    return models.tree_rules(models.fit_tree(rows, FEATURES, "label", max_depth=5, min_leaf=2), spark)


@register()
def random_forest_scores(spark, path):
    return forest_scores(score_table(spark, path), FEATURES, trees=50)


@register()
def out_of_bag(spark, path):
    rows = score_table(spark, path)
    return models.oob_predictions(rows, "row_id", FEATURES, "label", trees=10, max_depth=5)


@register(
    SCORES_SQL + "select row_id, " + ", ".join(f"{bag_sql(t)} as bag_{t}" for t in range(3)) + " from pf", cohort=True)
def bag_counts(spark, path):
    rows = score_table(spark, path)
    return rows.select("row_id", *[models.bag_count(42, t, F.col("row_id")).alias(f"bag_{t}") for t in range(3)])


@register()
def permutation_importance(spark, path):
    study = Study(score_table(spark, path), FEATURES)
    model = study.forest(trees=20)
    return models.permutation_importance(model, study.test, study.key, study.label, repeats=3)


@register()
def grid_search(spark, path):
    grid = models.param_grid(trees=[10, 20], max_depth=[2, 5], min_leaf=[2])
    return tuned_forest(score_table(spark, path, "EF"), FEATURES, grid)[1]


@register()
def higher_grade_check(spark, path):
    rows = graded_scores(spark, path)
    model = models.fit_forest(task(rows, "EF"), FEATURES, "label", trees=20)
    return evaluate.higher_grade_check(model, rows)


@register(
    SCORES_SQL + """select grade, cast(count(*) as bigint) as n, cast(sum(1.0) as double) as expected_pass from scores
    where grade in ('A', 'B', 'C', 'D') group by grade""", cohort=True)
def higher_grade_rows(spark, path):
    rows = evaluate.higher_grades(early_warning(cohort_tables(spark, path), COHORT, activity=False))
    return rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("expected_pass"))


@register()
def feature_ablation(spark, path):
    drops = {"all": [], "no absence": ["absence_time"], "scores only": ["absence_time", "english_total"]}
    return ablation(score_table(spark, path), FEATURES, drops, trees=20)


# A cut whose sides predict the same class is undone, and then no feature has weight.
_WEIGHT_SQL = "case when (p_left > 0.5) = (p_right > 0.5) then 0.0 else 1.0 end::double"


@register(
    _STUMP_SQL + f"""select 'english_total' as feature, {_WEIGHT_SQL} as importance from s_best
    union all select 'zero', 0.0::double""", cohort=True)
def importances_by_stump(spark, path):
    """A one-cut tree leans on the feature it cuts and on no other."""
    rows = score_table(spark, path, "EF", kept=True).withColumn("zero", F.lit(0.0))
    return models.importances(models.fit_tree(rows, ["english_total", "zero"], "label", max_depth=1), spark)


def side_sql(share: str) -> str:
    return f"'Predict: ' || case when {share} > 0.5 then '1.0' else '0.0' end"


@register(
    _STUMP_SQL + f""", one as (select *, (p_left > 0.5) = (p_right > 0.5) as same from s_best)
    select 1 as line, case when same then {side_sql('p_left')} else 'If (english_total <= ' || cut || ')' end as rule from one
    union all select 2, {side_sql('p_left')} from one where not same
    union all select 3, 'Else (english_total > ' || cut || ')' from one where not same
    union all select 4, {side_sql('p_right')} from one where not same""", cohort=True)
def rules_by_stump(spark, path):
    """Rules of a one-cut tree, without the line that names the fitted object."""
    _, model = stump(spark, path)
    lines = models.tree_rules(model, spark)
    return lines.filter("line_no > 0").select(F.col("line_no").alias("line"), F.trim("rule").alias("rule"))


@register(
    _STUMP_SQL + """, one as (select *, (p_left > 0.5) = (p_right > 0.5) as same from s_best)
    , sides as (select 0 as leaf, 1 as depth, '`english_total` <= ' || cut || 'D' as rule,
        case when p_left > 0.5 then 1.0 else 0.0 end::double as prediction, english_total <= cut as is_left, label from ef, one where not same and english_total <= cut
      union all select 1, 1, '`english_total` > ' || cut || 'D', case when p_right > 0.5 then 1.0 else 0.0 end::double, false, label
        from ef, one where not same and english_total > cut
      union all select 0, 0, 'true', case when p_left > 0.5 then 1.0 else 0.0 end::double, true, label from ef, one where same)
    select leaf, depth, rule, prediction, count(*) as n, count(*) filter (label = 0) as n_0, count(*) filter (label = 1) as n_1
    from sides group by leaf, depth, rule, prediction""", cohort=True)
def leaf_rules_by_stump(spark, path):
    """The leaves of a one-cut tree with the rows that fall into each."""
    rows, model = stump(spark, path)
    return models.leaf_rules(model, rows, "label")


@register()
def leaf_rules(spark, path):
    rows = score_table(spark, path, "EF", kept=True)
    return models.leaf_rules(models.fit_tree(rows, FEATURES, "label", max_depth=5, min_leaf=2), rows, "label")


@register(_STUMP_SQL + f"select row_id, {stump_predicts('s', 'english_total')} as prediction from ef, s_best", cohort=True)
def forest_of_stumps(spark, path):
    """Trees without bags or feature subsets are all the same tree."""
    rows = score_table(spark, path, "EF", kept=True)
    model = models.fit_forest(rows, ["english_total"], "label", trees=3, max_depth=1, max_features=None, bootstrap=False)
    return models.predict(model, rows).select("row_id", "prediction")


_SPLIT_SQL = """
    , tt as (select *, row_number() over (order by md5('{seed}|' || row_id), row_id)
        <= {train} as is_train from ef)
    , tr as (select * from tt where is_train), te as (select * from tt where not is_train)"""
_EIGHTY = _SPLIT_SQL.format(seed=42, train="floor((select count(*) from ef) * 0.8)")


@register(
    SCORES_SQL + _EIGHTY + stump_sql("s", "tr", "english_total") + stump_sql("b", "tr", "english_total", bag_sql(0)) + f"""
    , scored as (select label, {stump_predicts('s', 'english_total')} as p from te, s_best)
    , out_of_bag as (select label, {stump_predicts('b', 'english_total')} as p from tr, b_best where {bag_sql(0).replace('row_id', 'tr.row_id')} = 0)
    select 'test accuracy' as measure, round(avg(case when p = label then 1.0 else 0.0 end), 6) as value from scored
    union all select 'oob accuracy', round(avg(case when p = label then 1.0 else 0.0 end), 6) from out_of_bag
    union all select 'importance english_total', {_WEIGHT_SQL} from s_best
    union all select 'label ' || cast(label as integer) || ' predicted_0', count(*) filter (p = 0)::double from scored group by label
    union all select 'label ' || cast(label as integer) || ' predicted_1', count(*) filter (p = 1)::double from scored group by label
    """, cohort=True)
def forest_scores_by_stump(spark, path):
    """The forest study with one unbagged one-cut tree; the out-of-bag tree has the first bag."""
    out = forest_scores(score_table(spark, path, "EF"), ["english_total"], trees=1, max_depth=1, max_features=None,
                        bootstrap=False)
    return rounded(out, "value")


def _study_sql(variants: dict[str, list[str]], rows: str = "ef", tag: str = "") -> str:
    """Measures of one unbagged one-cut tree on english_total; the out-of-bag tree has the first bag."""
    split = _EIGHTY.replace("from ef", f"from {rows}").replace("tt", f"tt{tag}").replace(" tr ", f" tr{tag} ").replace(" te ", f" te{tag} ")
    common = split + stump_sql(f"s{tag}", f"tr{tag}", "english_total") + stump_sql(f"b{tag}", f"tr{tag}", "english_total", bag_sql(0)) + f"""
    , scored{tag} as (select label, {stump_predicts(f's{tag}', 'english_total')} as p from te{tag}, s{tag}_best)
    , bagged{tag} as (select label, {stump_predicts(f'b{tag}', 'english_total')} as p from tr{tag}, b{tag}_best
        where {bag_sql(0).replace('row_id', f'tr{tag}.row_id')} = 0)
    , cells{tag} as (select c, count(*) filter (label = c and p = c)::double as hits, count(*) filter (label = c)::double as support,
        count(*) filter (p = c)::double as told, (select count(*) from scored{tag}) as n
      from scored{tag}, (values (0.0), (1.0)) v(c) group by c)
    , rates{tag} as (select c::double::varchar as class, support, n, hits, case when told > 0 then hits / told else 0 end as precision,
        case when support > 0 then hits / support else 0 end as recall from cells{tag} where support > 0 or told > 0)
    , report{tag} as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from rates{tag})
    , lines{tag} as (select class, precision, recall, f1, support from report{tag}
      union all select 'accuracy', null, null, sum(hits) / any_value(n), any_value(n) from report{tag}
      union all select 'macro avg', avg(precision), avg(recall), avg(f1), any_value(n) from report{tag}
      union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), any_value(n) from report{tag})
    , measures{tag} as (select 'report ' || class || ' ' || name as measure, value from lines{tag}
        unpivot (value for name in (precision, recall, f1, support))
      union all select 'label ' || c::integer || ' predicted_0', count(*) filter (p = 0)::double from scored{tag}, (values (0), (1)) v(c)
        where label = c group by c
      union all select 'label ' || c::integer || ' predicted_1', count(*) filter (p = 1)::double from scored{tag}, (values (0), (1)) v(c)
        where label = c group by c
      union all select 'oob accuracy', avg(case when p = label then 1.0 else 0.0 end) from bagged{tag}
      union all select 'importance english_total', {_WEIGHT_SQL} from s{tag}_best)"""
    picks = " union all ".join(
        f"select '{name}' as variant, measure, value from measures{tag}" + "".join(
            f" union all select '{name}', 'importance {z}', 0.0::double" for z in zeros) for name, zeros in variants.items())
    return f"{common}, picked{tag} as ({picks})"


_ONE_CUT = {"trees": 1, "max_depth": 1, "max_features": None, "bootstrap": False}
_WITH_ZERO = {"all features": ["zero"], "features dropped": []}


@register(
    SCORES_SQL + _study_sql(_WITH_ZERO) + " select variant, measure, round(value, 6) as value from picked", cohort=True)
def warning_study_by_stump(spark, path):
    """The course study up to the balanced forests, with one-cut trees; a constant feature is the one dropped."""
    rows = score_table(spark, path, "EF").withColumn("zero", F.lit(0.0))
    return rounded(forest_study(rows, ["english_total", "zero"], ["zero"], balance=None, **_ONE_CUT), "value")


@register(
    SCORES_SQL + _study_sql({"all features": []}, "ef", "1") + _study_sql({"all features": []}, "pf", "2")
    + """ select 'EF' as task, variant, measure, round(value, 6) as value from picked1
    union all select 'PF', variant, measure, round(value, 6) from picked2""", cohort=True)
def task_studies_by_stump(spark, path):
    """The same study for both ways to cut the grades."""
    rows = graded_scores(spark, path)
    return rounded(task_studies(rows, ["english_total"], balance=None, **_ONE_CUT), "value")


@register()
def warning_study(spark, path):
    """All four forests of a course, small."""
    return forest_study(score_table(spark, path), FEATURES, ["absence_time"], "borderline", {**TUNED, "trees": 5}, k=2, m=7, trees=5)


@register()
def balanced_study(spark, path):
    """Forests with permutation importances."""
    return forest_study(score_table(spark, path), FEATURES, balance="plain", repeats=2, seed=1, trees=5)


@register()
def before_after_study(spark, path):
    return studies.before_after_study(score_table(spark, path), FEATURES, trees=5)[0]


@register()
def before_after_predictions(spark, path):
    return studies.before_after_study(score_table(spark, path), FEATURES, trees=5, whole=True)[1]


@register(
    SCORES_SQL + _SPLIT_SQL.format(seed=10, train="(select count(*) - ceil(count(*) * 0.2) from ef)")
    + stump_sql("s", "tr", "english_total") + f"""
    select count(*) as n, round(avg(case when {stump_predicts('s', 'english_total')} = label then 1.0 else 0.0 end), 6)
      as accuracy from te, s_best""", cohort=True)
def tree_report_by_stump(spark, path):
    out = tree_report(score_table(spark, path, "EF"), ["english_total"], test=0.2, max_depth=1)[1]
    return rounded(out, "accuracy")


_FOLD = """, fo as (select *, (row_number() over (partition by label order by md5('42|' || row_id), row_id) - 1) % 4 as fold
    from tr)"""


@register(
    SCORES_SQL + _EIGHTY + _FOLD
    + "".join(f", f{i} as (select * from fo where fold <> {i})" + stump_sql(f"g{i}", f"f{i}", "english_total") for i in range(4))
    + ", per as (" + " union all ".join(
        f"""select avg(case when {stump_predicts(f'g{i}', 'english_total')} = label then 1.0 else 0.0 end) as a
        from fo, g{i}_best where fold = {i}""" for i in range(4))
    + ") select setting, round(avg(a), 6) as accuracy from per, (values (0), (1)) s(setting) group by setting", cohort=True)
def grid_of_stumps(spark, path):
    """Cross-validated accuracy of two settings that give the same one-cut trees."""
    grid = models.param_grid(trees=[1, 3], max_depth=[1], max_features=[None])
    settings = tuned_forest(score_table(spark, path, "EF"), ["english_total"], grid, bootstrap=False)[1]
    return rounded(settings.select("setting", "accuracy"), "accuracy")
