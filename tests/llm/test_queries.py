"""Registered queries against brute force, with all columns of their contracts."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import sentencepiece

from roadpulse.llm import text as tx
from roadpulse.llm import toxicity
from roadpulse.llm.queries import all_queries, piece_model
from roadpulse.llm.shared import table
from roadpulse.llm.sql import all_sql
from tests.llm import brute


def test_shards_keep_the_law_of_bytes(spark, sf):
    given = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    found = all_queries()["op1_histogram_shards"](spark, sf)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(given) and {r.law for r in rows} == {"bytes"}
    assert all(r.size == len(given[r.doc_id].encode()) + 8 and r.grown_shard is None for r in rows)
    assert all(r.text_crc32 == zlib.crc32(given[r.doc_id].encode()) for r in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) <= set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(r.size for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_archives_give_each_page_back(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, sf, "pages").collect()}
    first = {}
    for page in sorted(pages):
        first.setdefault(pages[page], page)
    found = all_queries()["op5_splittable_warc"](spark, sf).collect()
    want = [
        (p, len(x), brute.sha(x), *(("revisit", first[x]) if len(x) >= 100 and first[x] != p else ("response", None)))
        for p, x in sorted(pages.items())
    ]
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want


def test_pieces_are_those_of_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = []
    for r in table(spark, sf, "documents").collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))))
    found = all_queries()["op8_sentencepiece_backtracking"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(want)


def test_toxicity_scores_are_those_of_counting_by_hand(spark, sf):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect() if r.toxic is not None and r.doc_id in texts}
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d in texts}
    words, prefixes = {}, {}
    for d, text in texts.items():
        (block,) = tx.blocks(pa.array([text.lower()]), 1 << 30)
        starts, ends = tx.runs(toxicity._WORD[block.data], block.offsets)
        spelt = [block.data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        words[d], prefixes[d] = spelt, [w[: toxicity.PREFIX] for w in spelt]
    learnt = [d for d in labels if fold[d] > 1]
    size = Counter(labels[d] for d in learnt)

    def evidence(of):
        seen = (Counter(), Counter())
        for d in learnt:
            seen[labels[d]].update(set(of[d]))
        out = {}
        for key in seen[0].keys() | seen[1].keys():
            both, part = seen[0][key] + seen[1][key], []
            for c in (1, 0):
                expected = both * (size[c] / sum(size.values()))
                beyond = seen[c][key] - expected
                credited = np.sign(beyond) * max(abs(beyond) - toxicity.ERRORS * expected**0.5 - 0.5 - toxicity.SHARE * expected, 0)
                part.append(np.log(max(expected + credited, 1e-3) / expected))
            out[key] = round((part[0] - part[1]) * toxicity.STEPS)
        return out

    of_word, of_prefix = evidence(words), evidence(prefixes)
    llr = {}
    for d in texts:
        best = [max(of_word.get(w, 0), of_prefix.get(p, 0), key=abs) for w, p in zip(words[d], prefixes[d], strict=True)]
        llr[d] = sum(best) / toxicity.STEPS
    rows = [d for d in labels if fold[d] == toxicity.CALIBRATION]
    inputs = toxicity._inputs(np.array([llr[d] for d in rows]), np.array([len(words[d]) for d in rows]))
    weights = toxicity._fit(inputs, np.array([labels[d] for d in rows]))
    found = all_queries()["op7_kneser_ney_toxicity"](spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        (x,) = toxicity._inputs(np.array([llr[r.doc_id]]), np.array([len(words[r.doc_id])]))
        assert abs(r.score - 1 / (1 + np.exp(-x @ weights))) < 1e-3
        assert r.held_out == (fold[r.doc_id] == 0) and r.predicted == int(r.score >= 0.5)


def test_quality_query_judges_every_share_of_repeated_lines(spark, tmp_path):
    body = "a clean line of text with some more words in it"
    rows = [(1, f"Title\n{body}\nTitle"), (2, f"{body} one\n{body} two"), (3, "Title\n" * 3 + body + "\nend"), (4, "Title\n" * 2 + body + "\nb\nc\nd")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = all_queries()["op3_quality_ledger"](spark, str(tmp_path))
    got = sorted((r.doc_id, r.n_dup_lines, r.n_lines, r.failed_bits & 8 > 0) for r in found.collect())
    assert got == [(1, 1, 3, True), (2, 0, 2, False), (3, 2, 5, True), (4, 1, 6, False)]
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        columns = sorted(found.columns)
        want = db.sql(all_sql()["op3_quality_ledger"]).select(", ".join(columns)).fetchall()
    assert sorted(tuple(r) for r in found.select(*columns).collect()) == sorted(want)
