import pytest
from conftest import SF, against_oracle

from lodestar.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, SF)
    if name in catalogue.oracle_sql():
        against_oracle(df, catalogue.oracle_sql()[name])
    else:
        assert df.count() > 0
