"""Rules on small fixtures against the rows written beside them."""

import math

import pytest

from tests.fixed_cases import CASES


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    case, names, want = CASES[name]
    df = case(spark, None)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    assert sorted(got, key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)
