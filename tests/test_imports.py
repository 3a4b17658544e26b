"""Every module can be the first one imported."""

import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
NAMES = sorted(str(p.relative_to(ROOT).with_suffix("")).replace("/", ".").removesuffix(".__init__")
               for part in ("functions", "operators", "sources", "streaming") for p in (ROOT / "lurewatch" / part).glob("*.py"))


@pytest.mark.parametrize("name", [n for n in NAMES if n.count(".") == 2])
def test_module_alone(name):
    subprocess.run([sys.executable, "-c", f"import {name}"], cwd=ROOT, check=True, timeout=120)


def test_operators_do_not_need_the_queries():
    code = "import sys, lurewatch.streaming.streams; assert not any(m.startswith('lurewatch.plans') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
