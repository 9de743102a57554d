"""The pipeline's stages against their operators' plain meaning, and its edge cases."""

import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def fixture(spark, tmp_path):
    words = {"en": "the and with that of is was for this from have been", "de": "und der die das nicht ist ein eine mit von auf sich"}
    rows, labels = [], []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        base = words[lang].split()
        text = " ".join(base[(i * (k + 3) + k * k) % 12] for k in range(30 + i % 7)) + f" tail{i} end{i * 7}"
        toxic = i % 5 == 0
        if toxic:
            text += " vileword" * 3
        rows.append((i, text, lang))
        labels.append((i, 1, int(toxic)))
    rows += [(200, rows[1][1], "en"), (201, rows[1][1] + " more", "en"), (300, None, None), (301, "12 !!", None), (302, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = fixture(spark, tmp_path)
    text = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == before.columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    language, clean, single, packed = ids
    assert language == set(text) - {300, 301, 302}
    assert clean == {i for i in language if "vileword" not in text[i]}

    def shingles(t):
        w = re.findall(r"\S+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    low = {i: i for i in clean}
    sets = {i: shingles(text[i]) for i in clean}
    for a, b in itertools.combinations(sorted(clean), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = low[a], low[b]
            low = {k: min(x, y) if v in (x, y) else v for k, v in low.items()}
    assert single == set(low.values()) and packed == single


def test_duplicates_go_by_row(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(12)) for x in "abcd")
    rows = [(5, a), (1, a), (5, b), (3, c), (3, c), (None, d), (None, d)]
    out = corpus_pipeline.duplicates_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert out.columns == ["doc_id", "text"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, a), (5, b), (3, c), (None, d)], key=str)


def test_run_and_registration(spark, data):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, data)
    assert {"doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "lang", "source", "n_chars"} <= set(out.columns)
    rows = out.select("doc_id", "ids", "length", "ids_crc32", "lang").collect()
    assert rows and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and r.lang for r in rows)


def all_stages(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf_dir}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


LABELS = "doc_id long, quality int, toxic int"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, length int, piece string, _row int, ids string"


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = all_stages(spark, spark.createDataFrame([], COLUMNS), str(tmp_path))
    assert out.count() == 0 and {"sequence_id", "document_length", "document_piece", "document__row", "document_ids", "lang"} <= set(out.columns)


def test_pipeline_of_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(3)] + [(None, 1, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    words = ["the", "and", "with", "that", "of", "is", "was", "for"]
    text = lambda k, n=40: " ".join(words[(k * i + i * i) % 8] + f"{k}x{i}" for i in range(n))
    rows = [(1, text(1), "en"), (1, text(1), "en"), (1, text(2), None), (None, text(3), "en"), (None, text(3), None), (2, None, "en"), (3, "", "en"), (4, "99 --", "en"), (5, text(5, 60_000), None), (6, text(6), "de")]
    docs = spark.createDataFrame([(i, t, lang, None, None, 7, "p", 3, "i") for i, t, lang in rows], COLUMNS)
    out = all_stages(spark, docs, str(tmp_path)).collect()
    assert sorted({(r.doc_id is None, r.doc_id or 0) for r in out}) == [(False, 1), (False, 5), (False, 6), (True, 0)]
    assert sum(r.piece == 0 for r in out) == 5  # two of id 1, one without id, one long, one more
    assert all(r.lang and (r.document_length, r.document_piece, r.document__row, r.document_ids) == (7, "p", 3, "i") for r in out)
    assert sum(r.doc_id == 5 for r in out) > 100


def test_intermediates_of_a_run_are_deleted(spark, data):
    from graphloom.plans import lineage

    since = lineage.mark()
    corpus_pipeline.run(spark, data)
    assert len(lineage._made) == since + len(corpus_pipeline.STAGES)


def test_one_query_an_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
