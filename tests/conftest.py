from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sitelode.session import local_session

    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(
        8, **{"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("tables"))}
    )
    yield session
    session.stop()
