import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
LISTED = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'doc_quality_metrics' in q; assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage_for_training_data(tmp_path, pipeline):
    shutil.copytree(ROOT / "folioscope", tmp_path / "folioscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    subprocess.run([sys.executable, "-c", LISTED], cwd=tmp_path, check=True, timeout=120)
