import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from ledgerlens.session import local_session

    warehouse = tempfile.mkdtemp(prefix="ledgerlens-warehouse-")
    s = local_session(8, app="ledgerlens-tests", **{"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()
