"""Alerts, updates and runs have a row for each event."""

import pytest

from punctua.plans import view_queries as V
from punctua.sources import driver_tables as T
from tests.test_queries import FOLDER


@pytest.mark.parametrize("build", [T.alerts, V.updates, V.runs])
def test_a_row_for_each_event(spark, build):
    assert build(spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/events.parquet").count()
