import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_queries_without_the_text_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('auklet.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'dk1_card_summaries' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
