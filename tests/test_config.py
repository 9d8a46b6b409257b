import pytest

from colloquy.config import RoundLimits, flag
from colloquy.operators.audits import has_marker, safe_projection
from colloquy.errors import ContractViolation


def test_budgets_never_grow_and_are_filled_up():
    assert RoundLimits.parse({"round_budgets": "20,6,8", "max_rounds": "5"}).budgets == (20, 6, 6, 4, 2)
    assert RoundLimits.parse({}).budgets == (30, 8, 5, 3, 2)


def test_limits_are_clamped_and_bad_values_ignored():
    limits = RoundLimits.parse({"max_rounds": "99", "round_budgets": "x,,", "final_top_k": "200"})
    assert (limits.max_rounds, limits.budgets, limits.top_k) == (5, (30, 8, 5, 3, 2), 60)
    assert RoundLimits.parse({"max_rounds": "0", "final_top_k": "many"}).max_rounds == 1


@pytest.mark.parametrize("value,on", [("1", True), (" TRUE ", True), ("off", False), ("", False)])
def test_flag(value, on):
    assert flag({"x": value}, "x") is on


def test_markers_match_whole_words():
    assert has_marker("gold_evidence", ("gold",)) and has_marker("the_answer", ("answer",)) and has_marker("QA", ("qa",))
    assert not has_marker("answering", ("answer",)) and not has_marker("squad", ("qa",))


def test_projection_refuses_leaking_whitelist(spark):
    df = spark.createDataFrame([(1, "a")], "id int, gold string")
    with pytest.raises(ContractViolation):
        safe_projection(df, ("id", "gold"))
    assert safe_projection(df, ("id",)).columns == ["id"]
