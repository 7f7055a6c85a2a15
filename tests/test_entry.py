import __spark_entry__ as entry


def test_contract():
    assert "head_view" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_package_stands_without_the_optional_part(tmp_path):
    """The entry module and the engine import where the optional folder and module are missing."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/seqlake", tmp_path / "seqlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'head_view' in e.queries() and 'pipeline' not in e.queries() and len(e.oracle_sql()) > 30"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
