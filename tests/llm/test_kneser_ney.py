"""The Kneser-Ney model of op7 against counting by hand."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from roadpulse.llm import kneser_ney, toxicity
from roadpulse.llm.queries import all_queries
from roadpulse.llm.shared import table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def by_hand(texts, labels):
    """The score of each text: words and labels counted with dictionaries."""
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d in texts}
    words = {d: WORD.findall((t or "").lower().encode()) for d, t in texts.items()}
    count, seen = (Counter(), Counter()), Counter()
    for d in texts:
        if labels.get(d) is not None and fold[d] > 1:
            count[labels[d]].update(words[d])
            seen.update(set(words[d]))
    total, contexts = [sum(c.values()) for c in count], sum(seen.values())
    free = [len(count[c]) * 1.0 / total[c] for c in (0, 1)]
    unseen = math.log(free[1] / free[0])

    def ratio(w):
        if w not in seen:
            return 0.0
        p = [max(count[c][w] - 1.0, 0) / total[c] + free[c] * seen[w] / contexts for c in (0, 1)]
        return math.log(p[1] / p[0]) - unseen

    def inputs(d):
        r, n = [ratio(w) for w in words[d]], max(len(words[d]), 1)
        return [1.0, sum(r) / n, sum(x > 2 for x in r) / n**0.5, sum(x < -2 for x in r) / n**0.5]

    rows = [d for d in texts if fold[d] == 1 and labels.get(d) is not None]
    weights = toxicity._fit(np.array([inputs(d) for d in rows]), np.array([labels[d] for d in rows]))
    return {d: 1 / (1 + np.exp(-np.array(inputs(d)) @ weights)) for d in texts}


def test_query_gives_kneser_ney_scores_of_counting_by_hand(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    want = by_hand(texts, labels)
    found = all_queries()["op7_kneser_ney_toxicity"](spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted", "kn_score", "kn_predicted"]
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(abs(r.kn_score - want[r.doc_id]) < 1e-4 and r.kn_predicted == int(r.kn_score >= 0.5) for r in rows)
    assert len({round(r.kn_score, 6) for r in rows}) > 20


@pytest.mark.parametrize(("head", "bits"), [(0, 64), (0, 1 << 20), (3, 1 << 20), (1 << 17, 64)])
def test_rare_words_back_off_and_no_size_changes_a_score(spark, head, bits):
    told = {0: "mild", 1: "vile"}
    texts = {i: f"plain{i} text {told[int(i % 3 == 0)]} rest" + " more" * (i % 4) for i in range(300)} | {900: None, 901: ""}
    labels = {i: int(i % 3 == 0) for i in range(300)}
    asked = {1000: "vile", 1001: "mild", 1002: "unseen", 1003: "plain0", 1004: "vile", 1005: "vile vile text"}
    docs = spark.createDataFrame([*texts.items(), *asked.items()], "doc_id long, text string")
    known = spark.createDataFrame([*labels.items(), (900, None)], "doc_id long, toxic int")
    docs = toxicity.with_digest(docs, "a", "b")
    model = kneser_ney.train(toxicity.train(docs, known, 1 << 10), head, bits)
    found = {r.doc_id: r.kn_score for r in kneser_ney.score(docs, model, docs).collect()}
    want = by_hand(texts | asked, labels)
    assert found.keys() == want.keys() and all(abs(found[d] - want[d]) < 1e-4 for d in want)
    # A word that occurs once in one toxic document has no more evidence than one that was never seen.
    assert found[1000] == found[1004] > found[1002] == found[1003] > found[1001]
    assert found[900] == found[901]


def test_without_labels_all_scores_are_one_half(spark):
    docs = toxicity.with_digest(spark.createDataFrame([(1, "vile"), (2, None)], "doc_id long, text string"), "a", "b")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = kneser_ney.train(toxicity.train(docs, none, 1 << 10))
    assert {(r.kn_score, r.kn_predicted) for r in kneser_ney.score(docs, model, docs).collect()} == {(0.5, 1)}
