"""The chain of stages over a small corpus, stage by stage against plain Python, and the registered queries."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from corpus_rows import prose, row

import __spark_entry__ as registered
import check_oracles
import corpus_pipeline
from paceline.llm.repair import public_vocabulary

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, rows): clean documents, and for each stage some that must go."""
    folder = tmp_path_factory.mktemp("corpus")
    item = prose(700, 40)
    rows = [row(k, prose(k, 120 + k % 50, "en" if k % 3 else "de"), "en" if k % 3 else "de", f"s{k % 4}") for k in range(60)]
    rows += [row(100, "1234 5678 !!", "en", "s1"), row(101, None, "en", "s1"), row(102, "", None, None)]
    rows += [row(110 + k, rows[k]["text"], rows[k]["lang"], "s2") for k in range(5)] + [row(120, rows[7]["text"].replace(" ", "  ") + " tail", "en", "s3")]
    rows += [row(130, prose(800, 60) + "\n" + item + "\n" + prose(801, 60), "en", "s0")]
    spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_stages(spark, corpus, tmp_path):
    folder, rows = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
        assert k == 4 or docs.columns == columns
    ids = [sorted(r["doc_id"] for r in x.select("doc_id").collect()) for x in seen]
    clean = list(range(60))
    assert ids[0] == [*clean, *range(110, 115), 120, 130]  # no letters: gone
    assert ids[1] == [*clean, 130]  # copies: gone
    assert ids[2] == clean == ids[3] == ids[4]  # the leak: gone; nothing else
    mixed = seen[3].select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    order = [r["doc_id"] for r in sorted(mixed, key=lambda r: (r["file_name"], r["row_index"]))]
    found = sorted(seen[4].collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == order
    import tokenizers

    plain, start = tokenizers.Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json")), 0
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in found:
        token_ids = [*plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(token_ids), zlib.crc32(np.array(token_ids, "<u4").tobytes()))
        start += len(token_ids)


def test_run(spark, corpus):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, corpus[0]).collect()) == list(range(60))


def test_empty_documents(spark, corpus, tmp_path):
    folder, _ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CORPUS_QUERIES = [n for n in registered.queries() if n.startswith("op") or n == "pipeline"]


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in CORPUS_QUERIES[:13]] == list(range(1, 14)) and CORPUS_QUERIES[13:] == ["pipeline"]


@pytest.mark.parametrize("name", [n for n in CORPUS_QUERIES if n in registered.oracle_sql()])
def test_query_equals_sql(spark, name):
    ours, theirs = check_oracles.compare(spark, check_oracles.duckdb_views(DATA), name, DATA)
    assert ours == theirs == []


@pytest.mark.parametrize("name", [n for n in CORPUS_QUERIES if n not in registered.oracle_sql()])
def test_query_runs(spark, name):
    assert registered.queries()[name](spark, DATA).count() > 0
