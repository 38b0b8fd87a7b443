import ast
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_every_sql_has_a_query():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and len(q) > 50
    assert all(callable(f) for f in q.values())


def test_nothing_else_imports_the_training_data_part():
    for path in [*ROOT.glob("quillstone/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("quillstone.llm") for n in names), path


def test_a_missing_requirement_is_not_hidden(monkeypatch):
    import importlib

    import pytest

    def missing(name):
        def load(module):
            if module.endswith("llm.queries"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return real(module)

        return load

    real = importlib.import_module
    monkeypatch.setattr(entry.importlib, "import_module", missing("quillstone." + "llm"))
    assert set(entry.queries()) == set(real("quillstone.plans.queries").QUERIES)
    monkeypatch.setattr(entry.importlib, "import_module", missing("numpy"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_no_shared_folder_on_a_cluster():
    import pytest

    from quillstone import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Fake:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda k, d: d)})

    with pytest.raises(RuntimeError):
        session.shared_dir(Fake())


def test_flagship(spark):
    if not pathlib.Path("/root/testdata/sf0.001").exists():
        return
    df = entry.entry(spark)
    assert {"reg_idx", "proc_idx", "sim", "status", "reg_label", "proc_label"} == set(df.columns) and df.count() == 125
