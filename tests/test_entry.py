"""The entry module, and the rest without the text operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from helixframe.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_registered():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and set(catalogue.QUERIES) <= set(known)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["repeat_blocks", "repeat_blocks_joint", "repeat_minus_ssr", "soft_mask", "softmask_import", "genome_summary", "pairwise_jaccard", "fasta_split_records", "mask_compare", "locate_position"])
def test_against_duckdb(spark, name):
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duckdb.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = lambda df: sorted(map(tuple, df[cols].astype(str).to_numpy()))
    assert order(got) == order(want)


@pytest.mark.parametrize("left", ["nothing", "pipeline", "broken"])
def test_without_the_text_operators(tmp_path, left):
    """The rest works where the folders are deleted, also if the pipeline's file or a subpackage that can't be imported is left."""
    top = Path(entry.__file__).parent
    for f in top.rglob("*.py"):
        part = f.relative_to(top)
        if "llm" not in part.parts and (part.name != "corpus_pipeline.py" or left == "pipeline"):
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(f.read_text())
    if left == "broken":
        (tmp_path / "helixframe" / "llm").mkdir()
        (tmp_path / "helixframe" / "llm" / "__init__.py").write_text("import a_module_that_is_not_there")
    code = "import __spark_entry__ as e; assert 'repeat_blocks' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
