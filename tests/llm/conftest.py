from __future__ import annotations

import pytest

WORDS = "the of and to in is that for it on with as le la les der die das und el los que river stone green quick run tall".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot int, kept string, component string, text_hash string, digest string"


def prose(n: int, seed: int) -> str:
    state, out = seed * 7919 + 17, []
    for i in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(WORDS[(state >> 8) % len(WORDS)] + ("." if i % 11 == 10 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and odd texts, long ones, ties and repeated rows; some column names clash with results."""
    base = prose(120, 1)
    texts = [
        None, "", "   \n\t ", "a", "Ünïcödé 漢字 😀 é", base, base, base.upper(), base + " extra", prose(3000, 2), "x" * 5000, "a b " * 900,
        prose(80, 3) + "\npassword = \"hunter2hunter2\"\n", prose(90, 4).replace(" ", "  "), "line one\nline one\nline two ...\n" * 5, "#*$%&|<>" * 10, "\x1c\x85\xa0",
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "é"][i % 4], None, 1, 2, "k", None, "h", "d") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose(60, 9), None, None, None, None, None, None, None, None, None)]
    rows += [(None, t, None, None, None, None, None, None, None, None, None) for t in (base, base + " more", prose(60, 9))]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(edge_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def known_docs(edge_docs):
    """Without the row that has no id, for operators whose results are looked up by it."""
    return edge_docs.where("doc_id IS NOT NULL")
