"""Queries over the clusters of documents count every document."""

import __spark_entry__ as E
from tests.conftest import SF
from voxpop.plans import tables as TB


def test_every_document_is_in_a_cluster(spark):
    n = TB.posts(spark, SF).count()
    for name in ("document_fallback_name", "document_top_factor"):
        assert sum(r.cluster_size for r in E.queries()[name](spark, SF).collect()) == n
    assert {r.cluster_id for r in E.queries()["document_samples"](spark, SF).collect()} == {0, 1, 2, 3, 4}
