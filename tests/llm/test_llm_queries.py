import pytest

from brindle.llm import queries as llm
from helpers import assert_same

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_rows_of_the_sql(spark, data, name):
    if name in SQL:
        assert_same(spark, data, llm.queries()[name], SQL[name])
    else:
        llm.queries()[name](spark, data).count()


def test_nothing_else_imports_this_subpackage(request):
    root = request.config.rootpath / "brindle"
    for path in root.rglob("*.py"):
        if root / "llm" not in path.parents:
            assert "brindle.llm" not in path.read_text(), path
