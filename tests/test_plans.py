import pytest
from hypothesis import given
from hypothesis import strategies as st

from sumweave.plans.normalize import normalize
from sumweave.plans.parse import parse
from sumweave.plans.planner import _leaf, plan
from sumweave.plans.spec import ColumnRef, DisconnectedQuery, Filter, Join, ParseError, QuerySpec, UnsupportedPredicate
from sumweave.plans.stats import ColumnStats


@pytest.mark.parametrize("text", ["5 3 1|0.1=1.0&1.1=2.0&0.0>7000|0.0 1.1", "6|0.4<10|0.5 0.5", "1 0||0.0"])
def test_text_round_trip(text):
    assert parse(text).to_text() == text


@pytest.mark.parametrize("text", ["", "1|0.0>1", "1|0.0>1|0.0|", "|0.0>1|0.0", "a|0.0>1|0.0", "1|0.0>=1|0.0", "1|1<0.0|0.0", "1|0.0>-5|0.0", "1|0.0>1.5.2|0.0", "1|1.0>3|0.0", "1|0.0>1|", f"1|0.0<{1 << 64}|0.0", "1 2|0.0=1.0&|0.0", "1|0.x=2|0.0"])
def test_malformed_text(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("op", "<>")
def test_columns_are_compared_by_equality_only(op):
    with pytest.raises(UnsupportedPredicate):
        parse(f"1 2|0.0{op}1.0|0.0")


def test_largest_constant():
    assert parse(f"1|0.0<{(1 << 64) - 1}|0.0").filters[0].constant == (1 << 64) - 1


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ("0.0<9&0.0<5", "0.0<5"), ("0.0>9&0.0>5", "0.0>9"), ("0.0=4&0.0<5&0.0>3", "0.0=4"), ("0.0=5&0.0<5", None), ("0.0<5&0.0=5", None),
        ("0.0>5&0.0=5", None), ("0.0=5&0.0>5", None), ("0.0=3&0.0=4", None), ("0.0=3&0.0=3", "0.0=3"), ("0.0>4&0.0<5", None), ("0.0>4&0.0<6", "0.0>4&0.0<6"), ("0.0<0", None),
    ],
)
def test_filters_of_a_column(filters, want):
    spec = normalize(parse(f"1|{filters}|0.0"))
    assert spec.empty == (want is None)
    if want:
        assert spec.filters == parse(f"1|{want}|0.0").filters


def test_joins_are_canonical():
    spec = normalize(parse("1 2|1.0=0.1&0.1=1.0&0.0=0.0&0.1=0.0|0.0"))
    assert spec.joins == (Join(ColumnRef(0, 1), ColumnRef(1, 0)), Join(ColumnRef(0, 0), ColumnRef(0, 1)))


@given(st.lists(st.tuples(st.sampled_from("<>="), st.integers(0, 12)), max_size=6), st.integers(0, 12))
def test_normalising_keeps_the_rows(filters, value):
    def holds(spec):
        return not spec.empty and all({"<": value < f.constant, ">": value > f.constant, "=": value == f.constant}[f.op] for f in spec.filters)

    spec = QuerySpec((0,), (), tuple(Filter(ColumnRef(0, 0), op, k) for op, k in filters), (ColumnRef(0, 0),))
    assert holds(spec) == holds(normalize(spec))


def stats(rows, *columns):
    return {c: ColumnStats(rows, 0, high, distinct) for c, (high, distinct) in enumerate(columns)}


def test_small_side_first():
    spec = normalize(parse("0 1 2|0.0=1.0&1.1=2.0&2.1=7|0.0"))
    fact, middle, small = stats(10**6, (999, 1000)), stats(10**4, (999, 1000), (99, 100)), stats(100, (99, 100), (9, 10))
    order = plan(spec, [fact, middle, small]).order
    assert order[-1] == 0 and set(order[:2]) == {1, 2}


def test_every_predicate_is_assigned_once():
    spec = normalize(parse("0 1 2|0.0=1.0&1.1=2.0&2.0=0.1|0.0"))
    steps = plan(spec).steps
    assert sorted(j for s in steps for j in s.joins) == sorted(spec.joins)


def test_estimates_stay_finite_for_empty_and_disjoint_inputs():
    spec = normalize(parse("0 1 2|0.0=1.0&1.0=2.0&0.0>500|0.0"))
    empty = {0: ColumnStats(0, 0, 0, 1)}
    assert plan(spec, [stats(10, (9, 10)), empty, {0: ColumnStats(5, 100, 200, 5)}]).cost >= 0


def test_filters_leave_fewer_values_of_other_columns():
    # 1,000 rows with 100 values of column 1; a tenth of the rows holds about 100 (1 - 0.9**10) = 65 of them
    spec = normalize(parse("0 1|0.0<100&0.1=1.0|0.0"))
    rows, bounds = _leaf(spec, 0, stats(1000, (999, 1000), (99, 100)))
    assert rows == pytest.approx(100) and bounds[ColumnRef(0, 1)][2] == pytest.approx(100 * (1 - 0.9**10), rel=0.01)


def test_a_scan_costs_its_rows():
    assert plan(normalize(parse("0|0.0<5|0.0")), [stats(1000, (999, 1000))]).cost == 1000


def test_disconnected():
    spec = normalize(parse("0 1|0.0>1|0.0"))
    with pytest.raises(DisconnectedQuery):
        plan(spec)
    assert plan(spec, allow_cross=True).order == (0, 1)
