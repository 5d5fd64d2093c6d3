"""Every query of the subpackage on the smallest tables: against its SQL, or by what its contract says of each row."""

import hashlib
import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from chronoloom.llm import fingerprints, queries

from .test_llm_texts import plain_set

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the generated tables are not here")
SQL = queries.oracle_sql()


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows and columns in one order, numbers as doubles."""
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind in "iufb":
            frame[c] = frame[c].astype(float)
    order = frame.astype(str).sort_values(list(frame.columns)).index
    return frame.loc[order].reset_index(drop=True)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return {i: t or "" for i, t in db.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()}


def test_licence_files_are_compared_as_a_whole(spark, tmp_path):
    from chronoloom.llm import licenses

    said = licenses.TEMPLATES["Zlib"][0].replace(". ", ".\n\n").replace(", ", ",\n\n")  # no paragraph is the licence
    rows = [(0, said, "web", "en"), (1, said, "web", "en"), (2, "nothing of that", "web", "en"), (70, said + "\n\nReleased under the MIT License.", "code", None), (71, None, "code", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.license, r.license_source, r.effective_license) for r in queries.op2_license_scan(spark, str(tmp_path)).collect()}
    assert got == {0: ("Zlib", "own", "Zlib"), 1: (None, "inherited", "Zlib"), 2: (None, "inherited", "Zlib"), 70: ("MIT", "own", "MIT"), 71: (None, "inherited", "MIT")}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    got, want = plain(queries.queries()[name](spark, DATA).toPandas()), plain(db.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" and want[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], rtol=1e-9, atol=2e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_extraction_has_a_row_for_every_page(spark, db):
    got = {r.page_id: r for r in queries.op1_html_extraction(spark, DATA).collect()}
    pages = db.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert len(got) == len(pages)
    for i, url, html in pages:
        text = got[i].text
        assert got[i].url == url and got[i].n_chars == len(text)
        assert all(line == " ".join(line.split()) != "" for line in text.split("\n")) or not text
        assert not text or "<" in text or all(w in html.replace("&amp;", "&") for w in text.split()[:20] if w.isascii() and w.isalnum())


def test_quality_has_a_score_for_every_document(spark, texts):
    got = {r.doc_id: r for r in queries.op3_quality_classifier(spark, DATA).collect()}
    import zlib

    assert set(got) == set(texts)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_fingerprints_are_near_the_exact_likeness(spark, texts):
    got = {r.doc_id: r for r in queries.op4_document_fingerprints(spark, DATA).collect()}
    ids = sorted(texts)
    off = []
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, new, following = (plain_set(t, fingerprints.WORDS) for t in (text, edited, after))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        off += [abs(got[i].near_edited - like(own, new)), abs(got[i].near_next - like(own, following))]
        if len(own | new) <= fingerprints.SIZE:
            assert got[i].near_edited == pytest.approx(like(own, new))
        assert abs(got[i].distinct_shingles - len(own)) <= max(1e-9, 0.5 * len(own)) and 0 <= got[i].contained_in_edited <= 1
    assert max(off) < 0.2 and sum(off) / len(off) < 0.02


def test_mixture_keeps_every_document_once(spark, texts):
    got = queries.op5_source_mixing(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and sorted(r.position for r in got) == list(range(len(texts)))


def test_tokens_are_those_of_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: r for r in queries.op7_bpe_tree(spark, DATA).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_document_has_a_shard(spark, texts):
    got = queries.op9_lookup_sharding(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and {r.shard for r in got} <= set(queries.SHARDS)


def test_operators_take_empty_tables(spark):
    from chronoloom.llm import bpe, sharding

    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, queries.tokenizer_path(), decoded=True).count() == 0
    assert sharding.place(none, "doc_id", ["a", "b"], 1009).count() == 0
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_fingerprints_with_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(60000))
    rows = [(1, long, "x", "y", 1, 2), (2, "a b c d e f g h", "x", "y", 1, 2), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, id string, bucket int, ghost int")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    assert got[1].n_chars == len(long) and abs(got[1].distinct_shingles / 59996 - 1) < 0.4 and got[2].distinct_shingles == 4
    assert got[None].n_chars == 0 and got[None].distinct_shingles == 0
