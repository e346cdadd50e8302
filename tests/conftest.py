import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortlab.session import session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    s = session("tests", "local[8]", **conf)
    s.sparkContext.setLogLevel("OFF")
    return s


def rows(df, *names):
    """Collected rows as sorted tuples."""
    names = names or df.columns
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
