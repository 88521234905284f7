"""Queries over documents without text, against their SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E

TEXTS = ["", "   ", "\n \n", "\r\n\t", "　 ", None, "one line", "a b　c\n\nd " * 90]


@pytest.fixture(scope="module")
def blank(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("blank"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    for lang in ("en", "de", "es", None):
        for text in TEXTS:
            con.execute("INSERT INTO documents SELECT count(*), $1, $2, 'src', length($1) FROM documents", [text, lang])
    con.execute(f"COPY documents TO '{folder}/documents.parquet' (FORMAT parquet)")
    return folder, con


@pytest.mark.parametrize("name", ["split_is_loss_free", "reparse_outcomes", "ingest_outcomes"])
def test_documents_without_text(spark, blank, name):
    folder, con = blank
    df = E.queries()[name](spark, folder)
    want = con.execute(E.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(want.fetchall())
