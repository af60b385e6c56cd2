import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="folioscope-test-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="folioscope-warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def on_literals(monkeypatch):
    """Queries read rows that cases were picked on by hand, in place of the tables they derive."""
    import importlib

    from folioscope.sources.derived import Derived
    from literals import LITERALS

    tables = {}
    for (module, name), rows in LITERALS.items():
        if table := getattr(importlib.import_module(f"folioscope.plans.{module}"), name, None):
            tables[table] = rows
    for kind in {Derived, *map(type, tables)}:
        monkeypatch.setattr(kind, "df", lambda self, spark, sf_dir: tables[self].df(spark))
    return tables
