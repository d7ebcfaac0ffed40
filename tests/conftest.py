from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "scripts")]
os.environ.setdefault("BENCH_CPUS", "8")


@pytest.fixture(scope="session")
def spark():
    from bench import session

    return session()
