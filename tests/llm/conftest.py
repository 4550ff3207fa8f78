"""Small tables with awkward rows, shared by the tests of the corpus operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from corpus_rows import CLASHING, SCHEMA, prose, row


@pytest.fixture(scope="session")
def make_docs(spark, tmp_path_factory):
    """Rows (dictionaries) written as Parquet files and read back; extra keys become columns."""
    folder = tmp_path_factory.mktemp("docs")

    def build(rows: list[dict], files: int = 2):
        path = folder / uuid.uuid4().hex
        path.mkdir()
        extra = [k for k in (rows[0] if rows else {}) if k not in SCHEMA.names]
        schema = pa.schema([*SCHEMA, *[(k, pa.int64()) for k in extra]])
        for k in range(files):
            pq.write_table(pa.Table.from_pylist(rows[k::files], schema), path / f"part-{k}.parquet")
        return spark.read.parquet(str(path))

    return build


@pytest.fixture(scope="session")
def awkward_rows() -> list[dict]:
    """Nulls everywhere, empty, blank and very long texts, repeated rows, equal texts, columns of any name."""
    base = prose(1, 120)
    rows = [
        row(5, base), row(5, base), row(3, base), row(None, base), row(7, None), row(8, ""), row(9, " \n\t "), row(None, None), row(10, "12 34 !? 99"),
        row(11, prose(2, 30_000)), row(12, prose(3, 80), None, None), row(13, prose(4, 90, "de"), "de", None), row(14, "One."), row(15, "\n\n\n"),
        row(16, prose(5, 70).replace(" ", " ")), row(17, "\0nul \0 and\ttabs\r\nhere"), row(18, prose(6, 60, "de"), "de", "b"),
    ]
    return [r | {name: k for k, name in enumerate(CLASHING)} for r in rows]


@pytest.fixture(scope="session")
def awkward(make_docs, awkward_rows):
    return make_docs(awkward_rows, 3)


@pytest.fixture(scope="session")
def nothing(make_docs):
    return make_docs([], 1)
