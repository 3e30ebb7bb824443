"""Every operator against brute force, and on nulls, empty and long texts, ties, repeats, and clashing columns."""

import io
import random
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from roadpulse.llm import (
    components,
    decontaminate,
    html,
    pieces,
    quality,
    sharding,
    simhash,
    suffixes,
    toxicity,
    urls,
    warc,
)
from roadpulse.llm.queries import all_queries, piece_model
from roadpulse.llm.shared import table
from tests.llm import brute

LONG = "lorem ipsum dolor sit amet " * 6000
PASSAGE = " ".join(f"word{i}" for i in range(40))
EDGE = [
    (1, PASSAGE + " one"),
    (2, "short"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, "É héllo 中文 \U00010348 " * 30),
    (8, "x " + PASSAGE + " tail"),
    (9, PASSAGE + " one"),
    (10, "a\nb\na\n\nb\r\n" + PASSAGE),
    (11, "ab" * 400),
    (12, "##$ |x| *** <b> " * 8),
]
CLASHES = ["size", "shard", "slot", "n_words", "hit_words", "failed_bits", "kept", "fp", "ids", "decoded", "removed"]


def frame(spark, rows, extra=()):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("extra") for c in extra})


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, EDGE, CLASHES)


@pytest.fixture(scope="module")
def given(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]


# --- sharding --------------------------------------------------------------------------------


def test_shards_have_nearly_equal_bytes_even_when_one_text_has_most_rows(spark):
    rows = [(i, "the same text" if i % 2 else f"text number {i}") for i in range(4000)] + [(9000, LONG)]
    found = sharding.histogram_shards(frame(spark, rows), 8, 3).collect()
    assert len(found) == len(rows)
    sizes = [sum(r["size"] for r in found if r["shard"] == s) for s in range(8)]
    largest = len(LONG) + 8
    assert max(sizes) - min(sizes) <= largest + 0.01 * sum(sizes)
    for s in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))


def test_shards_of_one_text_only_are_cut_at_ids(spark):
    found = sharding.histogram_shards(frame(spark, [(i, "copy") for i in range(1200)]), 6, 2).collect()
    counts = [sum(r["shard"] == s for r in found) for s in range(6)]
    assert max(counts) - min(counts) <= 4


def test_shards_on_edge_rows_and_empty_table(spark, docs):
    rows = docs.unionByName(docs).unionByName(frame(spark, [(None, None)], CLASHES))
    found = sharding.histogram_shards(rows, 3, 2)
    assert found.count() == 2 * len(EDGE) + 1 and found.where("size < 8 OR slot < 0").count() == 0
    assert sharding.histogram_shards(docs.limit(0), 3, 2).count() == 0


def test_position_counts_the_keys_not_above(spark):
    keys = sorted({(random.Random(i).randrange(-50, 50), i % 3) for i in range(40)})
    rows = [(h, d) for h in range(-60, 60, 7) for d in range(-1, 4)]
    df = spark.createDataFrame(rows, "h long, d long").select(F.struct("h", "d").alias("k"))
    for row in df.select("k", sharding.position(F.col("k"), keys).alias("n")).collect():
        assert row.n == sum(key <= tuple(row.k) for key in keys)


# --- decontamination -------------------------------------------------------------------------

ITEMS = [
    (1, " ".join(f"Word{i}" for i in range(5, 20))),
    (2, "short"),
    (3, None),
    (4, "..."),
    (5, " ".join(f"word{i}" for i in range(12))),
    (6, " ".join(f"word{i}" for i in range(5, 20))),
    (7, "dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor sit amet"),
]


@pytest.mark.parametrize("index_bytes", [1 << 20, 100])
def test_decontamination_equals_brute_force(spark, docs, index_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.benchmark_hits(docs, items, index_bytes=index_bytes)
    rows = found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long"), F.size("hit_items").cast("long"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256), decontaminate.contaminated(),
    )
    assert collected(rows) == sorted(brute.decontamination(EDGE, ITEMS))


def test_decontamination_of_given_tables_and_empty_ones(spark, sf, given, docs):
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert collected(all_queries()["op2_winnowing"](spark, sf)) == sorted(brute.decontamination(given, items))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_hits(docs, none).where("size(hit_words) > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), none).columns == docs.columns
    assert decontaminate.decontaminate(docs, none).count() == len(EDGE)


def test_winnowing_keeps_a_shared_fingerprint_for_every_shared_span(spark):
    rng = random.Random(3)
    for _ in range(200):
        span = [f"s{rng.randrange(30)}" for _ in range(13)]
        a = [f"a{i}" for i in range(rng.randrange(9))] + span + ["q"] * rng.randrange(5)
        b = ["z"] * rng.randrange(9) + span
        index = decontaminate.build_index([("1", " ".join(b))])
        block = next(decontaminate.tx.blocks(decontaminate.pa.array([" ".join(a)])))
        assert len(decontaminate._search(block, index)[1][0]) >= 13


# --- quality ---------------------------------------------------------------------------------


def test_measures_equal_brute_force(spark, docs, given):
    for rows, df in ((EDGE, docs), (given, frame(spark, given))):
        found = quality.measure(df).select("doc_id", *quality.MEASURES)
        assert collected(found) == sorted((d, *brute.measures(t)) for d, t in rows)


def test_policies_only_read_bits(spark, docs):
    rows = quality.ledger(docs).cache()
    kept = {v: {r.doc_id for r in quality.apply_policy(rows, v).where("kept").collect()} for v in quality.POLICIES}
    assert kept["v2"] <= kept["v1"] <= kept["base"] and 12 not in kept["v1"] and 1 in kept["v2"]
    table_ = {(r.policy, r.rule): r for r in quality.ablations(rows).collect()}
    for policy, rules in quality.POLICIES.items():
        for rule in rules:
            own = 1 << quality.RULES.index(rule)
            bits = [r.failed_bits & quality.mask(rules) for r in rows.collect()]
            row = table_[policy, rule]
            assert (row.n_failed, row.n_only_here) == (sum(bool(b & own) for b in bits), sum(b == own for b in bits))
            assert row.n_kept == len(kept[policy])
    assert set(quality._rules()) == set(quality.RULES)


def test_quality_filter_returns_the_given_columns(spark, docs):
    found = quality.quality_filter(docs)
    assert found.columns == docs.columns and found.where("n_words <> 'extra'").count() == 0
    assert quality.quality_filter(docs.limit(0)).count() == 0


def test_a_title_that_comes_again_is_no_reason_to_reject(spark):
    body = "a clean line of text with some more words in it"
    rows = [(1, f"Title\n{body}\nTitle"), (2, "Title\nTitle\nTitle\n" + body), (3, "x y\n" * 4 + body), (4, f"{body} one\n{body} two")]
    judged = quality.apply_policy(quality.ledger(frame(spark, rows)), "v2").select("doc_id", "n_dup_lines", "failed_bits")
    bit = 1 << quality.RULES.index("repeated_lines")
    assert collected(judged.select("doc_id", "n_dup_lines", (F.col("failed_bits").bitwiseAND(bit) > 0))) == [
        (1, 1, False), (2, 2, False), (3, 3, True), (4, 0, False)
    ]


# --- SimHash ---------------------------------------------------------------------------------


def test_near_duplicates_of_given_documents(spark, sf, given):
    prints = [(d, brute.simhash(t)) for d, t in given]
    named = brute.groups(prints)
    found = collected(all_queries()["op4_simhash_pigeonring"](spark, sf))
    assert found == sorted((d, f"{f:016x}", named[d]) for d, f in prints)


@pytest.mark.parametrize("dense", [simhash.DENSE, 20])
def test_links_connect_what_brute_force_connects(spark, dense):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(60)}
    named = [(simhash._signed(f), f) for f in sorted(prints)]
    df = spark.createDataFrame([(s,) for s, _ in named], "fp long")
    found = components.components(simhash.links(df, dense))
    roots = {r.node: r.root for r in found.collect()}
    want = brute.groups(named)
    assert {s: roots.get(s, s) for s, _ in named} == want


def test_chain_condition_never_prunes_a_link(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(5)))
        rows.append((simhash._signed(a), simhash._signed(b)))
    df = spark.createDataFrame(rows, "a long, b long")
    holds = [simhash._chain_holds(F.col("a"), F.col("b"), F.lit(i)) for i in range(5)]
    assert df.where(~(holds[0] | holds[1] | holds[2] | holds[3] | holds[4])).count() == 0


def test_one_document_of_each_group_stays(spark, docs):
    rows = docs.unionByName(frame(spark, [(1, EDGE[0][1]), (None, "short"), (20, None)], CLASHES))
    found = simhash.one_of_each_group(rows)
    assert found.columns == docs.columns
    ids = [r.doc_id for r in found.collect()]
    assert sorted(i for i in ids if i) == [1, 2, 3, 6, 7, 8, 10, 11, 12] and ids.count(None) == 1
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0


# --- WARC ------------------------------------------------------------------------------------

PAGES = [
    (4, "http://a.example.com/x", "<p>" + "copy " * 40),
    (2, "http://a.example.com/y", "<p>" + "copy " * 40),
    (3, None, None),
    (5, "no host\nhere", ""),
    (6, "http://b.example.net/" + "z" * 500, "é" * 60000),
    (7, "http://b.example.net/", "\r\n\r\nWARC/1.1\r\n\r\n"),
    (9, "http://b.example.net/", "short copy"),
    (8, "http://b.example.net/", "short copy"),
    (None, "http://c.example.org/", "<p>" + "copy " * 40),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1))


@pytest.mark.parametrize("range_bytes", [50, 700, 1 << 20])
def test_archives_give_each_record_once(spark, tmp_path, range_bytes):
    folder = f"file://{tmp_path}/warc"
    written = warc.write_archives(warc.plan_records(pages(spark)).repartition(3), folder).collect()
    assert sum(r.n_records for r in written) == len(PAGES)
    found = {r.page_id: r for r in warc.read_archives(spark, folder, range_bytes).collect()}
    assert len(found) == len(PAGES)
    for page, _, text in PAGES:
        r, data = found[page], (text or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), brute.sha(data))
        assert (r.record_type, r.refers_to) == (("revisit", 2) if page in (4, None) else ("response", None))
        assert r.payload == (None if r.record_type == "revisit" else data)


def test_archives_of_an_empty_table_and_damaged_files(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert warc.write_archives(warc.plan_records(pages(spark).limit(0)), folder).count() == 0
    assert warc.read_archives(spark, folder).count() == 0
    rows = warc.plan_records(pages(spark)).collect()
    members = [warc._member(r.asDict()) for r in rows]
    noise = b"\x1f\x8b\x08" + b"noise\x1f\x8b\x08\x00"
    broken = members[0][:40]
    data = noise + members[0] + noise * 3 + members[1] + broken
    for step in (7, 64, len(data)):
        found = [h for s in range(0, len(data), step) for h, _ in warc.read_range(io.BytesIO(data), s, s + step)]
        assert len(found) == 2
    inner = zlib.compress(b"x" * 10, wbits=31)
    assert list(warc.read_range(io.BytesIO(inner), 0, len(inner))) == []


def test_a_page_with_a_very_long_url_is_read_back(spark, tmp_path):
    rng = random.Random(9)
    urls_ = ["http://a.example.com/" + "x" * 900_000, "http://a.example.com/" + "".join(rng.choices("abcdefgh0123", k=700_000)), "http://a.example.com/"]
    rows = [(i, u, f"<p>{i}") for i, u in enumerate(urls_)]
    folder = f"file://{tmp_path}/long"
    written = warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sum(r.n_records for r in warc.write_archives(written, folder).collect()) == 3
    for range_bytes in (10_000, 1 << 20):
        found = warc.read_archives(spark, folder, range_bytes).collect()
        assert sorted((r.page_id, r.url, r.payload.decode()) for r in found) == rows
    member = warc._member(written.first().asDict())
    cut, endless = member[: len(member) // 2], zlib.compress(b"WARC/1.1" + b"y" * 300_000, wbits=31)
    data = endless + cut + member
    assert len(list(warc.read_range(io.BytesIO(data), 0, len(data)))) == 1


def test_warc_query(spark, sf):
    found = all_queries()["op5_splittable_warc"](spark, sf).collect()
    texts = {r.page_id: (r.html or "").encode() for r in table(spark, sf, "pages").collect()}
    assert {r.page_id: r.payload_digest for r in found} == {p: brute.sha(t) for p, t in texts.items()}


# --- HTML ------------------------------------------------------------------------------------

FRAME = "<html><head><title>t</title><style>a{{}}</style></head><body><nav><ul><li>Home<li>About</ul></nav>{}<footer>&copy; x</footer>"


def test_main_text_is_the_article(spark):
    body = "<div class='ad big'>buy <div>now</div></div><article><h1>A &amp; B</h1><p>one\n two<br>three<p><b>x</article>"
    after = "<section class=comments><p>first!</section><form>q</form><aside>s</aside>"
    article = FRAME.format(body + after)
    rows = [
        (1, "http://h.example.com/en/1", article),
        (2, "http://h.example.com/en/2", article),
        (3, "http://h.example.com/en/3", FRAME.format("<p>Welcome to H<p>own text<p>Contact us")),
        (4, "http://h.example.com/en/4", FRAME.format("<p>Welcome to H<p>more &lt;text&gt;<p>Contact us")),
        (5, None, None),
        (6, "http://h.example.com/zz", "<script>var t='</p>';</script>plain<!-- c --> text &am"),
        (7, "", "<p>" + "word " * 50000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).coalesce(1)
    found = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert found[1] == found[2] == "A & B\none two three\nx"
    assert (found[3], found[4]) == ("own text", "more <text>")
    assert found[5] == "" and found[6] == "plain text &am" and len(found[7].split()) == 50000
    assert html.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    ("<html><head><title>t</title><body><p>Real text", "Real text"),
    ("<head><title>t</title>Real text<p>more", "Real text\nmore"),
    ("<p class='advert'>buy<p>kept</p><li class=share>x<li>item", "kept\nitem"),
    ("<article><div class='header'>Title</div><p>body<div class=related><p>other</p></div></article>", "Title\nbody"),
    ("<ul><li class=menu>a<ul><li>b</li></ul>c</li><li>d</ul>", "d"),
    ("<table><tr><td class=ad>x<td>y<tr><td>z</table><a class='social'>tweet</a> end", "y\nz\nend"),
    ("<p><a class=share>s</a>text</p>", "text"),
])
def test_lines_of_pages_that_leave_tags_open(page, text):
    assert "\n".join(t for t, _ in html.lines_of(page)) == text


def test_pages_with_an_article_are_differenced_too(spark):
    page = "<p>Welcome to H<p>{}<article><h1>{}</h1><p>a line of all</article><p>Contact us".format
    rows = [
        (1, "http://h.org/a/1", page("lead one", "one")),
        (2, "http://h.org/a/2", page("lead two", "two")),
        (3, "http://h.org/a/3", page("lead two", "two")),
        (4, "http://alone.org/1", page("lead", "four")),
        (5, None, page("lead", "five")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.main_text(df).collect()} == {
        1: "lead one\none\na line of all",
        2: "lead two\ntwo\na line of all",
        3: "lead two\ntwo\na line of all",
        4: "four\na line of all",
        5: "five\na line of all",
    }


def differenced(rows):
    """Main texts of (url, html) rows without articles, by looking for each page's partners among all."""
    pages = sorted({(u.split("/")[2], "/" + u.split("/", 3)[3], tuple(t for t, _ in html.lines_of(p))) for u, p in rows})
    digest = lambda x: x
    out = {}
    for host, path, lines in pages:
        near = [(p, x) for h, p, x in pages if h == host]
        at = near.index((path, lines))
        sides = [next((n for n in side if n[1] != digest(lines)), None) for side in (near[:at][::-1], near[at + 1 :])]
        sides = [n for n in sides if n]
        common = [html._common(n[0], path) for n in sides]
        gone = set().union(*(html.shared_lines(list(lines), list(n[1])) for n, c in zip(sides, common) if c == max(common)))  # noqa: B905
        out[(host, path, lines)] = "\n".join(t for i, t in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("parts", [1, 2, 5, 37])
def test_differencing_does_not_depend_on_partitions_and_leaves_copies_their_text(spark, parts):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        host = "hot.org" if i % 3 else f"h{i % 5}.org"
        own = f"<p>own {i // 2}<p>" if i % 4 else "<p>copied"
        rows.append((f"http://{host}/{rng.choice('ab')}/{i:02d}", f"<p>Welcome to {host}{own}<p>Contact us"))
    rows += [("http://hot.org/a/zz", "<p>Welcome to hot.org<p>same<p>Contact us")] * 30 + [("", "<p>no host"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = {r.page_id: r.text for r in html.main_text(df.repartition(parts)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {k: v for k, v in differenced([r for r in rows if r[0]]).items()}
    assert len(found) == len(rows) and found[len(rows) - 2] == "no host" and found[len(rows) - 1] == ""
    for i, (url, page) in enumerate(rows[:-2]):
        lines = tuple(t for t, _ in html.lines_of(page))
        assert found[i] == want[(url.split("/")[2], "/" + url.split("/", 3)[3], lines)], url
    assert {found[i] for i in range(60, 90)} == {"same"}


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html.shared_lines(a, b))
        assert len(found) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_html_query_gives_the_text_behind_each_page(spark, sf):
    found = {r.page_id: r for r in all_queries()["op6_nearest_url_differencing"](spark, sf).collect()}
    assert len(found) == table(spark, sf, "pages").count()
    assert all(r.n_chars == len(r.text) and "track(" not in r.text for r in found.values())


def test_html_query_gives_the_whole_article_of_each_page(spark, sf):
    found = {r.page_id: r.text for r in all_queries()["op6_nearest_url_differencing"](spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        assert found[r.page_id] == brute.article(r.html)


# --- toxicity --------------------------------------------------------------------------------


def test_toxic_documents_are_told_apart_on_held_out_rows(spark, sf):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 7 == 0
        text = rng.choices(words, k=60) + (rng.choices(["vile", "nasty", "rude"], k=3) if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(2001, None), (2002, ""), (None, "vile w1"), (2003, LONG)]
    labels += [(2001, 0, None), (None, 0, 1), (0, 1, 1)]
    df = frame(spark, rows, ["score", "llr", "n_words"])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, known, 1 << 16)
    found = toxicity.score(df, model).select("doc_id", "score", "predicted", toxicity.fold().alias("f")).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 1500 and r.f == 0]
    assert sum(r.predicted == int(r.doc_id % 7 == 0) for r in held) >= 0.97 * len(held)


def test_no_expression_shares_the_evidence_of_another(spark):
    rows = [(i, f"plain{i} text " + ("vile" if i % 3 == 0 else "mild")) for i in range(600)]
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    asked = frame(spark, [(None, "vile"), (7, "vile"), (7, "mild"), (8, "vile"), *((1000 + i, f"unseen{i:04}") for i in range(3000))])
    scores = []
    for size in (64, 1 << 20):  # a table or filter that is far too small must not change a score
        model = toxicity.train(frame(spark, rows), known, size)
        scores.append(collected(toxicity.score(asked, model).select("doc_id", "text", "score")))
    assert scores[0] == scores[1] and len(scores[0]) == 3004
    by_text = {t: {s for _, u, s in scores[0] if (u if u in ("vile", "mild") else "unseen") == t} for t in ("vile", "mild", "unseen")}
    assert all(len(s) == 1 for s in by_text.values())
    assert min(by_text["vile"]) > max(by_text["unseen"]) > max(by_text["mild"])


def test_no_label_is_lost_on_the_way_to_its_text(spark):
    ids = [random.Random(i).getrandbits(62) - (1 << 61) for i in range(4000)]
    known = spark.createDataFrame([(i, 1) for i in ids[::2]], "doc_id long, toxic int")
    for bits, most in ((1 << 26, 2100), (1 << 12, 4000)):
        found = toxicity._perhaps_labelled(frame(spark, [(i, "t") for i in ids]), known, bits)
        assert found.columns == ["doc_id", "text"]
        assert set(ids[::2]) <= {r.doc_id for r in found.collect()} and found.count() <= most


def test_toxicity_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none, 1 << 10)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- SentencePiece ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_encoding_and_decoding_equal_the_library(spark, docs, given, library):
    for rows, df in ((EDGE, docs), (given, frame(spark, given))):
        coded = pieces.decode(pieces.encode(df, piece_model()), piece_model())
        found = {r.doc_id: (list(r.ids), r.decoded) for r in coded.select("doc_id", "ids", "decoded").collect()}
        for doc, text in rows:
            ids = library.encode(text or "")
            assert found[doc] == (ids, library.decode(ids))
        both = pieces.encode_and_decode(df, piece_model()).select("doc_id", "ids", "decoded").collect()
        assert {r.doc_id: (list(r.ids), r.decoded) for r in both} == found


def test_random_texts_and_ids_equal_the_library(library):
    own, rng = pieces.model(piece_model()), random.Random(4)
    parts = ["a", "th", " ", "  ", "\n", pieces.MARK, "é", "中", "\U00010348", "<s>", "́", "ing", "    ", "\x00", "👍🏽"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(25)))
        found = pieces.array("i")
        own.encode(text, found)
        assert list(found) == library.encode(text)
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == library.decode(ids)


def test_encoding_of_empty_tables(spark, docs):
    assert pieces.decode(pieces.encode(docs.limit(0), piece_model()), piece_model()).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(null, piece_model()).first().decoded == ""


# --- suffixes --------------------------------------------------------------------------------


def removal(df, **options):
    cut = suffixes.remove_repeats(df, **options)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", gone, F.size("removed").cast("long"), F.sha2("kept", 256))


@pytest.mark.parametrize("part", [suffixes.PART, 1])
def test_repeats_equal_brute_force(spark, part):
    rng = random.Random(8)
    passages = ["".join(rng.choices("abcdef ", k=rng.randrange(90, 260))) for _ in range(6)]
    rows = list(EDGE)
    for i in range(60):
        parts = [p for _ in range(4) for p in (rng.choice(passages), "".join(rng.choices("xyzé", k=rng.randrange(40))))]
        rows.append((100 + i, "".join(parts)[rng.randrange(60) :]))
    df = frame(spark, rows, CLASHES).repartition(5)
    assert collected(removal(df, part=part)) == sorted(brute.repeats(rows))


def test_repeats_in_given_documents(spark, sf, given):
    found = collected(all_queries()["op9_bucket_pointer_refinement"](spark, sf))
    assert found == sorted(brute.repeats(given))


def test_refined_numbers_stand_for_equal_bytes():
    rng = suffixes.np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype("uint8")
    data[200:330] = data[20:150]
    for length in (5, 8, 13, 100):
        number = suffixes.refined(data, suffixes.np.full(400, 400), length)
        windows = {}
        for i in range(400 - length + 1):
            windows.setdefault(data[i : i + length].tobytes(), set()).add(int(number[i]))
        assert all(len(v) == 1 for v in windows.values()) and len(set().union(*windows.values())) == len(windows)


def test_large_batches_are_refined_in_small_pieces_of_whole_buckets(monkeypatch):
    np, pa = suffixes.np, suffixes.pa
    n, seen = 20_000, []
    bucket = np.arange(n) // 4
    columns = {"g": bucket, "part": np.zeros(n, np.int32), "hot": np.zeros(n, bool), "doc": np.arange(n), "row": np.zeros(n, np.int64),
               "start": np.zeros(n, np.int32), "n": np.ones(n, np.int32), "bytes": pa.array([b"%010d" % (i // 2) * 14 for i in range(n)])}
    refine = suffixes._refine_chunk
    monkeypatch.setattr(suffixes, "_refine_chunk", lambda rows, slices, length: seen.append((rows["g"], slices)) or refine(rows, slices, length))
    found = list(suffixes._refine(100)([pa.RecordBatch.from_pydict(columns)]))
    assert sum(b.num_rows for b in found) == n // 2  # of two equal windows the second
    assert max(sum(map(len, x)) for _, x in seen) <= 2 * min(suffixes._CHUNK_BYTES, 1 << 18)
    assert sum(len(np.unique(g)) for g, _ in seen) == n // 4


def test_repeated_rows_null_ids_and_empty_tables(spark, docs):
    rows = [(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (2, "q" + PASSAGE)]
    found = collected(removal(frame(spark, rows)))
    assert [(r[0], r[2]) for r in found] == [(None, 0), (1, len(PASSAGE)), (1, len(PASSAGE)), (2, len(PASSAGE))]
    cut = suffixes.without_repeats(docs.withColumn("n_chars", F.lit(0).cast("long")))
    assert cut.columns == [*docs.columns, "n_chars"] and cut.where("n_chars <> length(text)").count() == 0
    assert cut.count() == len(EDGE) and suffixes.without_repeats(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none_are_cut_each_by_itself(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choices("abcdefghij klm", k=n))
    passage, a, b, c = text(300), text(500), text(500), text(500)
    rows = [(5, passage + a), (None, passage + b), (None, c + text(400)), (7, passage + text(300)), (7, text(600)), (None, passage + text(200))]
    found = suffixes.remove_repeats(frame(spark, rows).repartition(3), as_text=True).select("text", "kept").collect()
    kept = {r.text: r.kept for r in found}
    assert len(found) == len(kept) == len(rows)
    assert kept[rows[2][1]] == rows[2][1] and kept[rows[4][1]] == rows[4][1]
    assert sum(passage in k for k in kept.values()) == 1 and kept[rows[0][1]] == a
    assert passage in kept[rows[1][1]] + kept[rows[5][1]]


def test_near_dedup_keeps_unrelated_texts_of_one_id_and_one_copy_without_id(spark):
    rng = random.Random(13)
    one, two, three = (" ".join(f"{c}{rng.randrange(999)}" for _ in range(60)) for c in "xyz")
    rows = [(5, one), (5, two), (5, two), (6, one), *((None, three) for _ in range(4))]
    found = simhash.one_of_each_group(frame(spark, rows).repartition(3))
    assert collected(found) == sorted([(5, one), (5, two), (None, three)], key=lambda r: tuple((x is not None, x) for x in r))


# --- URLs ------------------------------------------------------------------------------------


def test_url_rules_and_terms(spark):
    rows = [
        (1, "http://Example.COM/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        (2, "http://www.example.com/en/x?y=/fr/", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (3, "https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        (4, "http://a.net/fr/#top", "a.net", "/fr/", "net/fr/", "block"),
        (5, "http://a.org/casino-win", "a.org", "/casino-win", None, "block"),
        (6, "http://a.org/casinos/cheap", "a.org", "/casinos/cheap", None, "allow"),
        (7, "http://cheap-pills.org/", "cheap-pills.org", "/", None, "block"),
        (8, "http://free.org/free/free", "free.org", "/free/free", None, "allow"),
        (9, None, "", "", None, "allow"),
        (10, "mailto:x@casino.com", "", "", None, "block"),
        (11, "http://example.com", "example.com", "", None, "allow"),
        (12, "", "", "", None, "allow"),
        (13, "http://a.org/" + "x" * 100000, "a.org", "/" + "x" * 100000, None, "allow"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumn("verdict", F.lit("?"))
    found = urls.url_filter(df.unionByName(df)).select("page_id", "url", "host", "path", "rule", "verdict")
    assert collected(found.distinct()) == sorted(rows, key=lambda r: r[0]) and found.count() == 2 * len(rows)
    assert urls.url_filter(df.limit(0)).count() == 0
