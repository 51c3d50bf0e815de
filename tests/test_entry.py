import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_agree_in_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_optional_folder(tmp_path):
    """The library imports where the training-data folder and its pipeline are gone."""
    for name in ("__spark_entry__.py", "docspark"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "docspark").mkdir()
    for p in (ROOT / "docspark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "docspark" / p.name).symlink_to(p)
    code = "import sys; sys.path.insert(0, '.'); import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); assert 'path_filter_child' in m.queries() and not any(k.startswith('op') for k in m.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
