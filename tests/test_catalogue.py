import pytest

from strata.plans import catalogue, documents
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL | documents.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    same(spark, (catalogue.QUERIES | documents.QUERIES)[name], (catalogue.ORACLE_SQL | documents.ORACLE_SQL)[name], SF)


def test_every_query_but_the_documents_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL) and set(documents.QUERIES) - set(documents.ORACLE_SQL) == {"scan_documents"}  # its parts have
