import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert len(names) > 120


def test_nothing_outside_imports_the_training_data_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for p in (root / "postloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "postloom.llm" not in p.read_text()
