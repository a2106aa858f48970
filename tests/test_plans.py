"""Scale properties of the physical plans: no registered query pairs every
row with every row, and exact kNN limits to k per query before its shuffle."""

import contextlib
import io

def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_no_cartesian_plans(planned):
    for name, df in planned.items():
        plan = _plan(df)
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_knn_limits_before_shuffle(planned):
    plan = _plan(planned["knn_l2"])
    assert "MapInArrow" in plan
    assert plan.count("WindowGroupLimit") >= 2  # partial (map side) and final
