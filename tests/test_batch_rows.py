"""Catalog queries hand whole texts to Python in small batches, unless the session chose."""

import pytest

from lodestone import catalog, session

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("chosen, used", [(None, str(session.BATCH_ROWS)), ("77", "77")])
def test_batches_of_texts_are_small(spark, chosen, used):
    before = spark.conf.get(ROWS, None)
    try:
        spark.conf.unset(ROWS) if chosen is None else spark.conf.set(ROWS, chosen)
        catalog.queries()["hash_embedding"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(ROWS) == used
    finally:
        spark.conf.unset(ROWS) if before is None else spark.conf.set(ROWS, before)
