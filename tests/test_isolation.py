"""The core stands without the subpackage for training data."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_in_the_core_imports_the_subpackage():
    for path in [*(ROOT / "corvane").rglob("*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(?:from|import) corvane\.llm", path.read_text(), re.M), path
