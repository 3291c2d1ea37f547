from __future__ import annotations

import pytest

from loomwright.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions=4, spark__driver__memory="3g", spark__ui__showConsoleProgress="false", spark__sql__execution__arrow__maxRecordsPerBatch=64)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
