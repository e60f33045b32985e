"""The entry point without the optional parts."""

import subprocess
import sys

CHECK = """
import sys
sys.modules["public_tokenizers"] = None  # as if it were not installed
import __spark_entry__ as e
names = set(e.queries())
assert len(names) >= 60 and names == {n for n in names if not n.startswith("op") and n != "pipeline"}
assert set(e.oracle_sql()) <= names
"""


def test_without_tokenizer_files():
    subprocess.run([sys.executable, "-c", CHECK], check=True, timeout=120)
