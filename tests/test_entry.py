"""The driver's entry works with and without the optional text part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import sys; sys.modules[{gone!r}] = None\nimport __spark_entry__ as e\nprint(sorted(n for n in e.queries() if n.startswith(('op', 'pipeline'))), len(e.queries()) > 100, set(e.oracle_sql()) <= set(e.queries()))"


def test_entry_without_the_text_part():
    for gone in ("corpus_pipeline", "flowtide.llm"):
        out = subprocess.run([sys.executable, "-c", CODE.format(gone=gone)], cwd=ROOT, capture_output=True, text=True, timeout=120)
        assert out.stdout.strip() == "[] True True", out.stderr[-500:]
