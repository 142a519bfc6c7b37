"""The entry module imports and keeps the other queries whatever is missing of the optional subpackage."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(blocked):
    code = (f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules[{blocked!r}] = None; import __spark_entry__ as e; "
            "print(*sorted(e.queries()))")
    return subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, cwd="/")


@pytest.mark.parametrize("blocked", ["public_tokenizers", "regex", "propspark.llm"])
def test_optional_packages(blocked):
    out = names(blocked)
    assert out.returncode == 0, out.stderr
    assert "clean_profile" in out.stdout.split() and not [x for x in out.stdout.split() if x.startswith("op1_")]


def test_the_library_itself_is_not_optional():
    assert names("propspark.session").returncode != 0
