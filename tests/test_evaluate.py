import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from conftest import rows
from retentia.plans import evaluate

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
PAIRS = st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.5, 0.75, 1.0]), st.integers(0, 1)),
                 min_size=1, max_size=40)


def auc_by_pairs(pairs):
    pos = [s for s, l in pairs if l == 1]
    neg = [s for s, l in pairs if l == 0]
    if not pos or not neg:
        return None
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / len(pos) / len(neg)


@FEW
@given(pairs=PAIRS, cuts=st.sampled_from([2, 3, 128]))
def test_auc_counts_pairs(make, pairs, cuts):
    got = evaluate.roc_auc(make.scores(pairs), cuts).first()[0]
    assert got == pytest.approx(auc_by_pairs(pairs))


@pytest.mark.parametrize("pairs, auc", [
    ([(0.9, 1), (0.8, 1), (0.2, 0)], 1.0),
    ([(0.1, 1), (0.8, 0)], 0.0),
    ([(0.5, 1), (0.5, 0), (0.5, 0)], 0.5),
    ([(0.5, 1), (0.7, 1)], None),
    ([], None),
])
def test_auc_edges(make, pairs, auc):
    assert evaluate.roc_auc(make.scores(pairs)).first()[0] == auc


@FEW
@given(pairs=PAIRS, cuts=st.sampled_from([2, 128]))
def test_roc_points(make, pairs, cuts):
    got = sorted(rows(evaluate.roc_curve(make.scores(pairs), cuts)), key=lambda r: -2 if r[0] is None else -r[0])
    pos, neg = sum(l for _, l in pairs), sum(1 - l for _, l in pairs)

    def rate(label, all_, at):
        return sum(s >= at and l == label for s, l in pairs) / all_ if all_ else None

    want = [(None, 0.0, 0.0)] + [
        (t, rate(0, neg, t), rate(1, pos, t)) for t in sorted({s for s, _ in pairs}, reverse=True)]
    assert got == want


def test_collinear_points_are_dropped_across_ranges(make):
    # five equal steps; only the ends are corners
    pairs = [(s / 10, l) for s in range(1, 6) for l in (0, 1)]
    for cuts in (2, 3, 128):
        got = {r[0] for r in evaluate.roc_curve(make.scores(pairs), cuts, drop_collinear=True).collect()}
        assert got == {None, 0.5, 0.1}


def test_confusion_has_all_cells(make):
    assert sorted(rows(evaluate.confusion_matrix(make.scores([(0.9, 1), (0.9, 0), (0.8, 1)])))) == [
        (0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
    assert sum(r[2] for r in rows(evaluate.confusion_matrix(make.scores([])))) == 0


def test_class_report(make):
    scores = make.scores([(0.9, 1)] * 3 + [(0.1, 1)] + [(0.1, 0)] * 4 + [(0.9, 0)] * 2)
    got = {r[0]: r[1:] for r in rows(evaluate.classification_report(scores))}
    assert got["Retained"] == (0.8, pytest.approx(4 / 6), pytest.approx(8 / 11), 6)
    assert got["Churned"] == (0.6, 0.75, pytest.approx(2 / 3), 4)
    assert got["accuracy"] == (None, None, 0.7, 10)
    assert got["macro avg"][0] == pytest.approx(0.7)
    assert got["weighted avg"][1] == pytest.approx(0.7)
    assert evaluate.accuracy(scores).first()[0] == 0.7


def test_class_report_without_predictions_of_a_class(make):
    got = {r[0]: r[1:] for r in rows(evaluate.classification_report(make.scores([(0.1, 0), (0.1, 1)])))}
    assert got["Churned"] == (0.0, 0.0, 0.0, 1)


def test_spark_evaluator_agrees(make):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    scores = make.scores([((i * 37 % 101) / 101, int(i % 3 == 0)) for i in range(300)])
    library = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert evaluate.roc_auc(scores).first()[0] == pytest.approx(library.evaluate(scores))


def test_report_holds_all_metrics(make):
    got = dict(rows(evaluate.evaluate_report(make.scores([(0.9, 1), (0.1, 0)]))))
    assert len(got) == 22
    assert got["accuracy"] == got["roc_auc"] == got["macro avg f1"] == 1.0
    assert got["actual_1_predicted_0"] == 0.0
