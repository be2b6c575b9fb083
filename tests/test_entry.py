import __spark_entry__ as E


def test_contract(spark):
    assert E.entry(spark).count() == 16
    assert set(E.oracle_sql()) <= set(E.queries())


def test_llm_is_not_imported_by_the_rest():
    import pathlib

    root = pathlib.Path(E.__file__).parent / "granary"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text()
