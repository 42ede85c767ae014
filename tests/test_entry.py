import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
for name in sys.argv[1:]:
    sys.modules[name] = None  # as if it weren't installed
import __spark_entry__ as entry
names, oracles = entry.queries(), entry.oracle_sql()
assert "ratings" in names and set(oracles) <= set(names)
print(len(names))
"""


def _count(*absent):
    done = subprocess.run([sys.executable, "-c", CODE, *absent], cwd=ROOT, capture_output=True, text=True, check=True)
    return int(done.stdout)


def test_queries_without_optional_parts():
    """Without the optional subpackage, or a library that it needs, the rest is there."""
    rest = _count("cartlens.llm")
    assert rest > 60
    for library in ("public_tokenizers", "ahocorasick", "tiktoken"):
        assert _count(library) == rest
    assert _count() >= rest
