"""Hyperdimensional language profiles: against sums written out, on held-out rows, and on edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import languages
from roadpulse.llm import text as tx
from roadpulse.llm.queries import all_queries
from roadpulse.llm.shared import table

WORDS = {
    "en": "the house of the old man with many windows and that other thing which they were making there",
    "de": "das haus des alten mannes mit vielen fenstern und jene andere sache die sie dort machten wurde",
    "xx": "kwa zuru kwazi zurupi kwa mbuzu nkwazi zurumbu pizuru kwambu zikwa uzuru",
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def corpus(n=40):
    rows = []
    for i in range(n):
        for j, (lang, words) in enumerate(WORDS.items()):
            rows.append((3 * i + j, " ".join(np.random.default_rng(3 * i + j).choice(words.split(), 12)), lang))
    return rows


def written_out(text, dimensions, size=3):
    """The vector of a text, one n-gram after the other."""
    line = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    if not line.strip():
        return None
    symbols = [0 if c == " " else ord(c) for c in line]
    total = np.zeros(dimensions, np.int64)
    for i in range(len(symbols) - size + 1):
        gram = np.ones(dimensions, np.int64)
        for j in range(size):
            letter = languages.letter_vectors(np.array([symbols[i + j]], np.uint32), dimensions)[0].astype(np.int64)
            gram = gram * np.roll(letter, size - 1 - j)
        total += gram
    return total


@pytest.mark.parametrize(("size", "steps"), [(3, None), (2, None), (4, None), (3, 7)])
def test_text_vectors_are_sums_of_bound_letters(monkeypatch, size, steps):
    if steps:
        for name in ("GRAMS_AT_ONCE", "VECTORS_AT_ONCE", "CELLS", "TABLE"):
            monkeypatch.setattr(languages, name, steps)
    texts = ["Hello, WORLD  hello", None, "", "a", " . 12 ", "Straße İstanbul é", "中文 text\n\nx", "\U00010400 zz", "ab ab ab ab"]
    for block in tx.blocks(pa.array(texts), 1 << 20):
        vectors, n = languages.text_vectors(block, np.arange(len(block)), len(block), 100, size)
        for i, text in enumerate(texts):
            want = written_out(text, 100, size)
            assert (n[i] == 0) == (want is None or not want.any())
            assert want is None or (vectors[i] == want).all()


def test_letter_vectors_are_nearly_orthogonal():
    vectors = languages.letter_vectors(np.arange(200, dtype=np.uint32), languages.DIMENSIONS).astype(int)
    products = vectors @ vectors.T - languages.DIMENSIONS * np.eye(200, dtype=int)
    assert abs(products).max() < 6 * languages.DIMENSIONS**0.5


def test_languages_are_told_apart_by_sums_of_any_split(spark):
    rows = corpus()
    found = []
    for parts, at_once in ((1, 2048), (7, 2048), (5, 1)):
        docs = frame(spark, rows).repartition(parts)
        profiles = languages.train(docs, at_once=at_once)
        vectors = {r.lang: list(r.vector) for r in profiles.rows.collect()}
        assert len(vectors) == profiles.rows.count() == 3
        got = languages.identify(docs, profiles).select("doc_id", "lang_pred", "score").orderBy("doc_id").collect()
        found.append((vectors, [(r.doc_id, r.lang_pred, round(r.score, 12)) for r in got]))
    assert found[0] == found[1] == found[2]
    assert [r[1] for r in found[0][1]] == [lang for _, _, lang in sorted(rows)]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    for lang in WORDS:
        want = sum(written_out(text, languages.DIMENSIONS) for _, text, own in known if own == lang)
        assert (np.array(found[0][0][lang]) == want).all()


def test_cosines_against_brute_force_on_given_documents(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in table(spark, sf, "documents").collect()]
    known = {}
    vectors = {d: written_out(text, languages.DIMENSIONS) for d, text, _ in docs if len(text or "") < 400}
    found = {r.doc_id: r for r in all_queries()["op11_hyperdimensional_language"](spark, sf).collect()}
    assert set(found) == {d for d, _, _ in docs}
    profiles = languages.train(table(spark, sf, "documents"))
    known = {r.lang: np.array(r.vector, float) for r in profiles.rows.collect()}
    for d, vector in vectors.items():
        cosine = {x: 0 if vector is None else vector @ p / np.linalg.norm(vector) / np.linalg.norm(p) for x, p in known.items()}
        best = min(cosine, key=lambda x: (-cosine[x], x.encode()))
        assert found[d].lang_pred == ("und" if vector is None else best)
        assert abs(found[d].score - max(0, cosine[best])) < 1e-5
        assert found[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = all_queries()["op11_hyperdimensional_language"](spark, sf).where("held_out")
    rows = found.join(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_edge_rows_clashing_columns_and_empty_tables(spark):
    rows = [*corpus(), (None, "the house", "zz"), (501, None, "en"), (502, "", "en"), (503, " 1 . ", "en"), (504, "the house", None)]
    rows += [(505, WORDS["de"] * 5000, None), (506, "the house of the man", None), (506, "the house of the man", None)]
    docs = frame(spark, rows).withColumns({c: F.lit("x") for c in ("score", "vector", "part", "salt", "_aside_0")})
    profiles = languages.train(docs)
    assert {r.lang for r in profiles.rows.collect()} == set(WORDS)
    found = languages.identify(docs, profiles)
    assert found.columns == ["doc_id", "text", "lang", "vector", "part", "salt", "_aside_0", "lang_pred", "score"]
    got = found.where("doc_id > 500").select("doc_id", "lang_pred", "score").collect()
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (501, 502, 503)] == [("und", 0.0)] * 3
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id > 504} == {505: "de", 506: "en"} and len(got) == 7
    assert found.where("doc_id IS NULL").count() == 1
    nothing = languages.train(docs.limit(0))
    assert languages.identify(docs, nothing).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert languages.identify(docs.limit(0), profiles).count() == 0


def test_equally_near_languages_go_by_name(spark):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["b", "a", "é", "c"] * 8)]
    docs = frame(spark, rows)
    for at_once in (100, 1):
        found = languages.identify(docs, languages.train(docs, at_once=at_once)).select("lang_pred").distinct().collect()
        assert [r.lang_pred for r in found] == ["a"]
