"""The driver contract, also without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_works_without_the_other_package():
    code = (
        "import sys; sys.modules['lexicarta.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()), list(e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")
def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "token", "score", "rank"]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", ["tokens", "decompose", "relations", "true_gaps", "iou_pairs", "lookup_cascade", "kv_output", "token_roles"])
def test_query_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    ours, theirs = entry.queries()[name](spark, SMALL).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    order = sorted(ours.columns)
    plain = lambda df: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in row) for row in df[order].itertuples(index=False))
    assert order == sorted(theirs.columns) and plain(ours) == plain(theirs)
