import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tableloom.session import open_session  # noqa: E402

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = open_session(
        "tests",
        {
            "spark.master": "local[8]",
            "spark.driver.memory": "4g",
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return TABLES


@pytest.fixture
def settings(spark):
    """Set session options for one test."""
    before = {}

    def change(**options):
        for key, value in options.items():
            key = "spark.sql." + key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


# A register with the usual traps: an empty first header cell, a name that ends in a
# blank, a comma inside quotes, a name beyond ASCII, states that start with a blank.
SHOPS = """\
,name,city,state,id
0,Green Mill ,Oslo, NO,0
1,"Pot, Pan & Kettle",Lyon, FR,1
2,Käsehütte,Basel, CH,2
3,Plain Goods,Turin, IT,3
"""


@pytest.fixture
def shops(tmp_path):
    folder = tmp_path / "shops"
    folder.mkdir()
    (folder / "shops.csv").write_text(SHOPS, encoding="utf-8")
    return str(folder)
