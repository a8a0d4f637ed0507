import pathlib
import shutil
import sys
import tempfile

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"
FIXTURES = ROOT / "tests" / "fixtures"


@pytest.fixture(scope="session")
def spark():
    from sluice.session import build_session
    scratch = tempfile.mkdtemp(prefix="sluice-tests-")
    s = build_session("local[4]", 4, extra={
        "spark.sql.warehouse.dir": f"{scratch}/warehouse",
        "spark.checkpoint.dir": f"{scratch}/checkpoints",
    })
    yield s
    s.stop()


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)


@pytest.fixture
def config_root(tmp_path):
    """Copy a fixture folder, pointing ``{{DATA}}`` at the small test tables."""
    def make(name: str) -> str:
        dest = tmp_path / name
        shutil.copytree(FIXTURES / name, dest)
        for p in dest.rglob("*"):
            if p.is_file():
                p.write_text(p.read_text().replace("{{DATA}}", SMALL))
        return str(dest)
    return make
