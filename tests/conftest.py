import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marlpit.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "marlpit-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    # Tiny inputs: compiling a plan takes longer than running it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def registry_of(spark):
    """Registry rows from (source_id, path) pairs or full dicts."""
    from marlpit.model import REGISTRY

    def build(*sources, **common):
        rows = []
        for ordinal, source in enumerate(sources):
            entry = {
                "ordinal": ordinal, "kind": "local", "path": None, "url": None,
                "branch": None, "include": ["**/*.md"], "exclude": [], **common, **source,
            }
            rows.append(tuple(entry[name] for name in REGISTRY.names))
        return spark.createDataFrame(rows, REGISTRY)

    return build
