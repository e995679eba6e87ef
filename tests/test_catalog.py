"""Every query against its SQL in DuckDB on the smallest tables."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillworks.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return frame[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, data, name):
    got = catalog.queries()[name](spark, data).toPandas()
    assert len(got)
    if sql := catalog.oracle_sql().get(name):
        want = duck.execute(sql).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got).equals(rows(want))


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n.startswith(("hangul_", "endings_", "ocr_", "charfix_", "overseparation", "term_", "special_", "number_letter", "tts_"))])
def test_rules_change_seeded_texts(spark, data, name):
    """A rewrite that does nothing would pass an oracle that does nothing."""
    docs = catalog.seeded(catalog.table(spark, data, "documents")).select("doc_id", "text")
    assert docs.join(catalog.queries()[name](spark, data), "doc_id").where("text <> out").count() > 0


def test_entry_without_llm():
    """The entry point works when the llm folders and the pipeline are gone."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['quillworks.llm'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'quality_by_lang' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q\nassert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=60)


def test_nothing_else_imports_llm():
    for f in (ROOT / "quillworks").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f


def test_acronyms_of_all_documents(spark, tmp_path):
    """Documents that are not ASCII too, with Unicode word boundaries, against Python's re."""
    texts = ["the PC is OK", "é PC, tv und Größe", "éPC PCé naïve-AI", "año no", "Über CEO: yes!", "it ìt it", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["out"] for r in catalog.queries()["tts_acronyms"](spark, str(tmp_path)).collect()}
    want = texts[:]
    for found, put in catalog.rules.table(catalog.text.tables.SPOKEN):
        want = [t and re.sub(rf"(?i)\b{found}\b", put, t) for t in want]
    assert got == dict(enumerate(want))


def test_progress_of_all_events(spark, data):
    """Every event has a row; nulls, gaps and no rows at all are counted right."""
    events = catalog.table(spark, data, "events")
    out = catalog.queries()["batch_progress"](spark, data)
    assert out.count() == events.count() and out.agg({"percent": "max"}).first()[0] == 100
    rows = events.sparkSession.createDataFrame([(7,), (None,), (-3,), (10**12,)], "event_id long")
    got = {r["event_id"]: (r["done"], r["percent"]) for r in catalog.analytics.progress(rows, "event_id").collect()}
    assert got == {None: (1, 25), -3: (2, 50), 7: (3, 75), 10**12: (4, 100)}
    assert catalog.analytics.progress(rows.limit(0), "event_id").count() == 0
