"""The entry file must import whatever the text operators lack."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("absent", ["public_tokenizers", "statepath.llm", "corpus_pipeline"])
def test_entry_imports_without_a_text_library(absent):
    code = (
        f"import sys; sys.modules[{absent!r}] = None; sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\n"
        "found = e.queries(); core = len(e.REGISTRY)\n"
        "assert len(found) >= core > 100 and 'pipeline' not in found\n"
        "assert set(e.oracle_sql()) <= set(found)\n"
        f"assert (len(found) == core) == ({absent!r} != 'corpus_pipeline')\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
