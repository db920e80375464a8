import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.llm import boilerplate, canonical, keywords, leaks, levels, packing, queries, scans, splitting, trie, truncation
from strataloom.plans.skew import count_join, hot_keys

BLOCK = "doc_id bigint, pos int, type string, text string, page int, level int"
DOCS = "doc_id bigint, text string, lang string, source string, title string, doc_kind string, captured_at timestamp"
TOPIC = "doc_id bigint, topic_ix int, title string, topic_type string, body_xml string, shortdesc string, keywords array<string>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- 1 keywords


def test_keyword_scores_against_brute_force(spark):
    rnd = random.Random(1)
    data = [(d, t, [rnd.choice(["Net", "ｎｅｔ ", "gross​", " a  b", "", None, "x", "y"]) for _ in range(rnd.randint(0, 5))]) for d in range(12) for t in range(2)]
    data += [data[3], (99, 0, None), (98, 0, [None, " "])]
    df = spark.createDataFrame(data, "doc_id bigint, topic_ix int, keywords array<string>").withColumn("n", F.lit(1)).withColumn("score", F.lit("clash"))
    form = lambda w: " ".join("".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in w).lower().replace("​", "").split())
    tf = defaultdict(Counter)
    for d, t, ks in {(d, t, tuple(k)) for d, t, k in data if k is not None}:
        for k in ks:
            if k and form(k):
                tf[d, t][form(k)] += 1
    total = sum(sum(c.values()) for c in tf.values())
    cf = sum(tf.values(), Counter())
    h = lambda x: x * math.log(x) if x > 0 else 0.0
    for hot in (2, 1000):
        got = {(r["doc_id"], r["topic_ix"], r["keyword"]): (r["tf"], r["n_records"], r["score"]) for r in keywords.keyword_scores(df, hot_rows=hot).collect()}
        assert set(got) == {(*k, w) for k, c in tf.items() for w in c}
        for (d, t, w), (n, docs, score) in got.items():
            a, b = tf[d, t][w], cf[w] - tf[d, t][w]
            c = sum(tf[d, t].values()) - a
            e = total - a - b - c
            want = 2 * (h(a) + h(b) + h(c) + h(e) + h(total) - h(a + b) - h(c + e) - h(a + c) - h(b + e))
            assert n == a and docs == sum(w in x for x in tf.values()) and score == pytest.approx(max(0, want), abs=1e-9)


def test_count_join_keeps_every_row(spark):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2), ("z", 3)], "k string, v int")
    stats = spark.createDataFrame([("h", 50, "H"), ("c", 1, "C")], "k string, n bigint, s string")
    want = sorted([("h", i, 50, "H") for i in range(50)] + [("c", 1, 1, "C")])
    assert rows(count_join(left, stats, "k", "n", F.col("v"), 10)) == rows(count_join(left, stats, "k", "n", F.col("v"), 1000)) == sorted(want, key=repr)
    assert rows(count_join(left, stats, "k", "n", F.col("v"), 1, 1)) == sorted(want, key=repr)


def test_what_count_join_broadcasts_does_not_grow(spark):
    for n in (50, 5000):
        hot = hot_keys(spark.range(n).select(F.col("id").alias("k"), F.lit(1_000_000).alias("n")), "k", "n", max_hot=20)
        assert hot.count() == 20


# -- 2 repeated lines


def _source(spark, n=10):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", "t", "pdf_text", None) for i in range(n)] + [(77, "x", "en", None, None, None, None)], DOCS)
    data = []
    for i in range(n):
        lines = [f"own line {i} {chr(97 + i)}", ""] + ([f"All rights  {i} reserved"] if i % 2 == 0 else []) + (["Rare"] if i < 2 else [])
        data.append((i, 0, "paragraph", "\n".join(lines), 1, 0))
    data += [data[0], (0, 1, "code", "ALL RIGHTS 1 RESERVED", 1, 0), (3, 5, "note", None, 1, 0), (4, 6, "list_item", "", 1, 0), (77, 0, "paragraph", "all rights 1 reserved", 1, 0)]
    return spark.createDataFrame(data, BLOCK).withColumn("source", F.lit("clash")), docs


def test_repeated_lines(spark):
    block, docs = _source(spark)
    want = sorted((i, 0, 2) for i in range(0, 10, 2))
    for hot, most in ((1, 100), (1000, 100), (1000, 0)):
        got = boilerplate.repeated_lines(block, docs, hot_rows=hot, max_broadcast=most).select("doc_id", "pos", "line_ix").distinct()
        assert rows(got) == want
    clean = {r["doc_id"]: r["text"] for r in boilerplate.clean_blocks(block, docs).where("pos = 0").collect()}
    assert clean[0] == "own line 0 a\n\nRare" and clean[1] == "own line 1 b\n\nRare"
    report = boilerplate.line_report(block, docs).collect()
    assert [(r["n_docs"], r["n_texts"]) for r in report] == [(5, 5)]


def test_republished_text_is_no_boilerplate(spark):
    docs = spark.createDataFrame([(i, "same text" if i < 4 else f"t{i}", "en", "s", "t", None, None) for i in range(6)], DOCS)
    block = spark.createDataFrame([(i, 0, "paragraph", "One article", 1, 0) for i in range(4)] + [(i, 0, "paragraph", f"other {chr(97 + i)}", 1, 0) for i in (4, 5)], BLOCK)
    assert boilerplate.repeated_lines(block, docs).count() == 0
    assert boilerplate.repeated_lines(block, docs, min_clusters=1).count() == 4
    different = docs.withColumn("text", F.col("doc_id").cast("string")).withColumn("captured_at", F.to_timestamp(F.lit("2024-01-01")))
    assert boilerplate.repeated_lines(block, different).count() == 0  # all on one day
    days = different.withColumn("captured_at", F.to_timestamp(F.concat(F.lit("2024-01-0"), F.col("doc_id") + 1)))
    assert boilerplate.repeated_lines(block, days).count() == 4
    assert boilerplate.repeated_lines(block.limit(0), docs).count() == 0


def test_thresholds_alone_decide_p2_found(spark, tmp_path):
    """A source captured on one day, or with copies of one text only, has repeated lines too."""
    day = F.to_timestamp(F.lit("2024-01-01"))
    docs = spark.createDataFrame([(i, "same text" if i < 4 else f"t{i}", "en", "s" if i < 4 else "o", "t", None, None) for i in range(8)], DOCS).withColumn("captured_at", day)
    block = spark.createDataFrame([(i, 0, "paragraph", "Share this page" if i < 4 else "All rights reserved", 1, 0) for i in range(8)], BLOCK)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    block.write.parquet(str(tmp_path / "block.parquet"))
    query = queries.queries()
    assert rows(query["p2_found"](spark, str(tmp_path))) == [(i, 0, 0) for i in range(8)]
    assert rows(query["p2_lines"](spark, str(tmp_path)).select("source", "n_docs", "n_texts", "n_days")) == [("o", 4, 4, 1), ("s", 4, 1, 1)]
    assert {r["text"] for r in query["p2_clean"](spark, str(tmp_path)).collect()} == {""}


def test_documents_without_a_text_are_texts_of_their_own(spark):
    docs = spark.createDataFrame([(i, (None, "", " \n", "same text", "same  text")[i], "en", "s", "t", None, None) for i in range(5)], DOCS)
    block = spark.createDataFrame([(i, 0, "paragraph", "Share this page", 1, 0) for i in range(5)], BLOCK)
    assert [(r["n_docs"], r["n_texts"]) for r in boilerplate.line_report(block, docs).collect()] == [(5, 4)]
    assert rows(boilerplate.repeated_lines(block, docs, min_clusters=4).select("doc_id", "pos", "line_ix")) == [(i, 0, 0) for i in range(5)]


# -- 3 scanned text

CLEAN = "every monthly account validates the default settings of the approval while the manual balance filters including internal words"


def _scan(spark, blocks, title="Manual Account Settings"):
    docs = spark.createDataFrame([(i, CLEAN, "en", "s", "t", "pdf_text", None) for i in range(100, 104)] + [(1, None, "en", "s", title, "pdf_scan", None)], DOCS)
    return spark.createDataFrame([(1, p, t, x, 1, 0) for p, t, x in blocks], BLOCK), docs


def test_scanned_pages(spark):
    block, docs = _scan(spark, [
        (0, "heading", "Manual Acc0unt Settings"), (1, "paragraph", "Every acc-\nount validates"), (2, "paragraph", "thc default appr­ oval"), (3, "paragraph", "[12]"),
        (4, "paragraph", "MANUAL ACCOUNT 5ETTINGS"), (5, "paragraph", "Page 3   Manual Account Settings"), (6, "paragraph", "while the man-"), (7, "list_item", "the balance"), (8, "paragraph", "7"),
        (9, "paragraph", "ual. The words"), (10, "paragraph", "the monthly\n- 4 -\nManual Account Settings\nbalance"), (11, "code", "x = acc0unt"), (12, "paragraph", None), (13, "paragraph", ""), (14, "paragraph", "The year-\nend of the cut- off"),
        (1, "paragraph", "Every acc-\nount validates"), (16, "list_item", "the ac."), (15, "paragraph", "Codes B2B, MT100 and Q7l, 3b"),
    ])
    docs = docs.union(spark.createDataFrame([(i, "year end cut off and codes", "en", "s", None, None, None) for i in range(200, 204)], DOCS))
    got = {r["pos"]: (r["kinds"], r["text"]) for r in scans.repaired_scans(block, docs).collect()}
    assert len(got) == 17 and got[16] == ([], "the ac.")
    assert got[0] == ([], "Manual Acc0unt Settings") and got[11] == ([], "x = acc0unt") and got[12] == ([], None) and got[13] == ([], "")
    assert got[1] == (["split_word"], "Every account validates")
    assert got[2] == (["misread", "split_word"], "the default approval")
    assert got[3] == (["page_number"], None) and got[8] == (["page_number"], None)
    assert got[4] == (["misread", "running_head"], None) and got[5] == (["page_number", "running_head"], None)
    assert got[6] == (["split_word"], "while the manual.") and got[9] == ([], "The words")
    assert got[10] == (["page_number", "running_head"], "the monthly balance")
    assert got[14] == ([], "The year-end of the cut- off") and got[15][0] == []
    assert scans.repaired_scans(block.limit(0), docs).count() == 0 and scans.repaired_scans(block, docs.limit(0)).count() == 0


def test_long_document_is_worked_on_in_stretches(spark):
    n = scans.STRETCH * 2 + 30
    block, docs = _scan(spark, [(i, "paragraph", "the manual bal-" if i % 2 == 0 else "ance of words") for i in range(n)])
    got = {r["pos"]: r for r in scans.repaired_scans(block, docs).collect()}
    assert len(got) == n
    assert all(got[i]["kinds"] == ["split_word"] and got[i]["text"] == "the manual balance" and got[i + 1]["text"] == "of words" for i in range(0, n, 2))


@given(st.text("acdelmnoirshu015", min_size=1, max_size=7))
@settings(max_examples=200, deadline=None)
def test_automaton_finds_every_word_in_reach(word):
    vocabulary = trie.Vocabulary({w: 1 for w in ("old", "mode", "house", "lime", "dhole", "so", "clone", "hum", "rum", "code")})

    def distance(a, b, n):  # words reachable by n confusions at most, by trying them all
        reach = {(0, "")}
        best = {(0, ""): 0}
        stack = [(0, "")]
        while stack:
            i, out = stack.pop()
            c = best[i, out]
            steps = [(i + 1, out + a[i], c)] if i < len(a) else []
            steps += [(i + len(x), out + y, c + 1) for x, y in trie.CONFUSIONS if i < len(a) and a.startswith(x, i)]
            for j, o, k in steps:
                if k <= n and b.startswith(o) and k < best.get((j, o), n + 1):
                    best[j, o] = k
                    stack.append((j, o))
        return best.get((len(a), b))

    want = {(w, d) for w in vocabulary.words if (d := distance(word, w, 2))}
    assert {(w, c) for w, c, e in vocabulary.candidates(word, confused=2) if not e} == want


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text("abc", max_size=6), st.sets(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_automaton_with_plain_edits(word, known):
    got = {(w, e) for w, c, e in trie.Vocabulary({w: 1 for w in known}).candidates(word, confused=0, edits=2)}
    assert got == {(w, d) for w in known if 0 < (d := _levenshtein(word, w)) <= 2}


_KNOWN = ("statement", "account", "acount", "command", "communication", "counterparties", "misunderstanding", "mode", "rm", "illumination")


@given(st.sampled_from(_KNOWN), st.lists(st.tuples(st.integers(0, 40), st.sampled_from("adi"), st.sampled_from("aceilmnrsuw")), max_size=2), st.lists(st.integers(0, 40), max_size=2))
@settings(max_examples=300, deadline=None)
def test_every_word_in_reach_lies_on_the_routes(word, edits, confused):
    key = word
    for at in confused:  # print characters wrongly
        x, y = (p := [(x, y) for x, y in trie.CONFUSIONS if y in key] or [("", "")])[at % len(p)]
        key = key.replace(y, x, 1) if y else key
    plain = 0
    for at, kind, ch in edits[: trie.plain_edits(key)]:
        i = at % max(1, len(key))
        key = key[:i] + {"a": ch + key[i:], "d": key[i + 1 :], "i": ch + key[i + 1 :]}[kind]
        plain += 1
    if plain <= trie.plain_edits(key):
        assert set(trie.homes(word)) & set(trie.routes(key))


@pytest.mark.parametrize(("tries", "tasks"), [(1000, 1000), (2, 1), (1, 2)])
def test_near_words_against_one_trie(spark, tries, tasks):
    rnd = random.Random(3)
    known = sorted({"".join(rnd.choice("acdelmnortu") for _ in range(rnd.randint(2, 15))) for _ in range(60)} | set(_KNOWN))
    keys = {"statemnt", "staternent", "acount", "tcomrnand", "rnisunderstandlng", "comunicatlon", "rnode", "zzz", "acc", "counterpartes"}
    keys |= {w[:i] + w[i + 1 :] for w in known for i in (0, len(w) // 2, len(w) - 1)} - {"", *known}
    got = trie.near_words(spark.createDataFrame([(k,) for k in sorted(keys)], "key string"), spark.createDataFrame([(w, 5) for w in known], "word string, n bigint"), tries, tasks).collect()
    whole = trie.Vocabulary(known)
    want = {(k, w, c, e) for k in keys for w, c, e in whole.candidates(k, edits=trie.plain_edits(k))}
    assert {(r["key"], r["word"], r["confused"], r["edits"]) for r in got if r["word"]} == want
    assert {r["key"] for r in got if r["continues"]} == {k for k in keys if len(trie.skeleton(k)) > 1 and whole.continues(k)}
    assert ("statemnt", "statement", 0, 1) in want and ("rnode", "mode", 1, 0) in want and ("tcomrnand", "command", 1, 1) in want


def test_heads_in_capitals_and_words_cut_off(spark):
    docs = spark.createDataFrame([(i, "the monthly statement of the account", "en", "s", None, None, None) for i in range(100, 104)] + [(1, None, "en", "s", "Größe der Maße", "pdf_scan", None)], DOCS)
    block = spark.createDataFrame([(1, 0, "paragraph", "GRÖSSE DER MASSE", 1, 0), (1, 1, "paragraph", "monthly GRÖSSE DER MASSE 7 statement of", 1, 0), (1, 2, "paragraph", "the monthly statemen. (type A)", 1, 0), (1, 3, "paragraph", "the monthly statememt. (type A)", 1, 0)], BLOCK)
    got = {r["pos"]: (r["kinds"], r["text"]) for r in scans.repaired_scans(block, docs).collect()}
    assert got[0] == (["running_head"], None) and got[1] == (["page_number", "running_head"], "monthly statement of")
    assert got[2] == ([], "the monthly statemen. (type A)") and got[3] == (["misread"], "the monthly statement. (type A)")


def test_plain_edits_count_where_the_neighbours_speak_for_them(spark):
    docs = spark.createDataFrame([(i, "the monthly statement of the account", "en", "s", None, None, None) for i in range(100, 104)] + [(1, None, "en", "s", "A title here", "pdf_scan", None)], DOCS)
    block = spark.createDataFrame([(1, 0, "paragraph", "the monthly statemnt of", 1, 0), (1, 1, "paragraph", "Mr Statemnt left", 1, 0), (1, 2, "paragraph", "monthly staternent", 1, 0), (1, 3, "paragraph", "the acount", 1, 0), (1, 4, "paragraph", "monthly statemnt5", 1, 0)], BLOCK)
    got = {r["pos"]: (r["kinds"], r["text"]) for r in scans.repaired_scans(block, docs).collect()}
    assert got[0] == (["misread"], "the monthly statement of") and got[2] == (["misread"], "monthly statement") and got[3] == (["misread"], "the account")
    assert got[1] == ([], "Mr Statemnt left") and got[4] == ([], "monthly statemnt5")


def test_scans_beyond_the_broadcast_and_long_lines(spark):
    long = "words " * 100
    block, docs = _scan(spark, [(0, "heading", "Manual Account Settings"), (1, "paragraph", f"{long}\n17\n{long}"), (2, "paragraph", f"{long} bal-"), (3, "image", None), (4, "paragraph", "ance."), (5, "paragraph", f"{long}4 Manual Account Settings {long}")])
    for broadcast, common in ((10, 1000), (0, 0)):
        got = {r["pos"]: (r["kinds"], r["text"]) for r in scans.repaired_scans(block, docs, common_words=common, max_broadcast=broadcast, hot_rows=3).collect()}
        assert got[1] == (["page_number"], (long + long).strip()) and got[2] == (["split_word"], f"{long} balance.") and got[4] == ([], None)
        assert got[5] == (["page_number", "running_head"], (long + long).strip())


# -- 4 truncation


def test_truncated_values(spark):
    body = '<conbody class="b"><p class="p">The account validates the default balance.</p></conbody>'
    sentence = "The account validates the default balance of the monthly ledger."
    data = [(i, 0, "Manage the Ledger", "concept", body, sentence, ["k"]) for i in range(8)]
    data += [
        (20, 0, "T", "concept", body[:40], "The account validates the def", None), (20, 0, "T", "concept", body[:40], "The account validates the def", None),
        (21, 0, None, None, None, None, None), (22, 0, "Account Settings", "concept", "", "Manage the Account", []), (23, 0, "x", "task", body.replace("balance.", "bal"), "The account validates…", None),
        (24, 0, "x", "task", body.replace("</p>", "</p></p>"), "The account validates the balance (cf. No.", None), (25, 0, "x", "task", body + " \n", "  ", None), (26, 0, "x", "task", None, "The account validates the default", None),
    ]
    got = rows(truncation.truncated_values(spark.createDataFrame(data, TOPIC).withColumn("value", F.lit(1))).select("doc_id", "field", "reason"))
    assert got == sorted([(20, "body_xml", "open"), (20, "shortdesc", "prefix"), (23, "body_xml", "sentence"), (23, "shortdesc", "mark"), (24, "shortdesc", "open"), (26, "shortdesc", "sentence")], key=repr)
    assert truncation.truncated_values(spark.createDataFrame([], TOPIC)).count() == 0


def test_length_limits_do_not_depend_on_size(spark):
    """Cuts by chance on every length make none of them a limit, however many; a complete prefix there is no cut."""
    complete = {n: ("word " * 40)[: n - 2] + "d." for n in (60, 100)}
    for times in (1, 12):
        lengths = [n for n in range(50, 91) for _ in range(times)] + [100] * 30 * times
        data = [(i, 0, None, None, None, f"{i:05d}" + "x" * (n - 6) + "…", None) for i, n in enumerate(lengths)]
        data += [(-n, 0, None, None, None, v, None) for n, v in complete.items()] + [(-n - 1, 0, None, None, None, v + " And more of it follows here.", None) for n, v in complete.items()]
        topic = spark.createDataFrame(data, TOPIC)
        got = truncation.truncated_values(topic)
        assert rows(got.where("doc_id < 0").select("doc_id", "reason")) == [(-100, "prefix")]
        assert got.count() == len(lengths) + 1
        docs = topic.select("doc_id", F.lit("s").alias("source"))
        rates = truncation.cut_rates(topic, docs).where("field = 'shortdesc'").select("n_cut", "limit_chars")
        assert rows(rates) == [(len(lengths) + 1, 100)]
        even = topic.where("doc_id >= 0 and length(shortdesc) < 100")  # no limit at all
        assert rows(truncation.cut_rates(even, docs).select("limit_chars")) == [(None,)]


def test_prefix_neighbours_against_brute_force(spark):
    rnd = random.Random(2)
    values = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r["value"] for r in truncation.neighbours(df).collect()}
    assert got == {v for v in values if any(w != v and w.startswith(v) for w in values)}
    assert truncation.neighbours(df.limit(0)).count() == 0


def test_every_longer_copy_is_looked_at(spark):
    rnd = random.Random(3)
    values = ["".join(rnd.choice("ab. é") for _ in range(rnd.randint(1, 7))) for _ in range(400)] + ["q" + "." * k + x for k in range(9) for x in ("", "z")]
    want = {}
    for v in set(values):
        after = [w[len(v)] for w in values if w != v and w.startswith(v)]
        if after:
            want[v] = any(c.isalpha() for c in after)
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 4, 60):  # runs of one prefix lie across partitions
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = truncation.neighbours(df).collect()
            assert len(got) == len(want) and {r["value"]: r["inside"] for r in got} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    texts = ["Manage the Acc", "Manage the Acc...", "Manage the Accounts"]  # '.' sorts before letters
    topic = spark.createDataFrame([(i, 0, "Manage the Acc", None, None, v, None) for i, v in enumerate(texts)], TOPIC)
    assert rows(truncation.truncated_values(topic).select("doc_id", "reason")) == [(0, "prefix"), (1, "mark")]


# -- 5 splitting


@given(st.text(st.sampled_from(list("ab. \n,]|é")), max_size=200), st.sampled_from(["paragraph", "code", "table"]), st.integers(2, 40), st.integers(0, 39))
@settings(max_examples=300, deadline=None)
def test_pieces_make_the_text_again(text, kind, size, overlap):
    overlap = min(overlap, size - 1)
    got = splitting.split_text(text, kind, size, overlap)
    assert all(b - a <= size for a, b, _ in got) and got[0][0] == 0 and got[-1][1] == len(text)
    assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(got, got[1:]))
    assert text[: got[0][1]] + "".join(text[a + overlap : b] for a, b, _ in got[1:]) == text


def test_cuts_lie_at_topic_changes():
    one, two = "The cat sat near the cat house. " * 5, "A rocket flew over the rocket base. " * 5
    got = splitting.split_text(one + two, "paragraph", 250, 0)
    assert got[0][1] == len(one) and got[0][2] == "valley"


def test_split_operator(spark):
    limits = spark.createDataFrame([("block", "paragraph", "char", 20, 4), ("block", "code", "char", 10, 0), ("container", None, "token", 5, 0), ("block", None, "char", 1, 0)], "applies_to string, type string, unit string, max_size int, overlap int")
    data = [(1, 0, "paragraph", "word " * 10, 1, 0)] * 2 + [(1, 1, "paragraph", "x" * 20, 1, 0), (1, 2, "paragraph", None, 1, 0), (1, 3, "table", "y" * 99, 1, 0), (1, 4, "code", "é" * 11, 1, 0), (1, 5, None, "z" * 50, 1, 0), (1, 6, "code", "", 1, 0)]
    block = spark.createDataFrame(data, BLOCK).withColumn("max_size", F.lit(0))
    assert rows(splitting.oversized_blocks(block, limits)) == [(1, 0), (1, 4)]
    pieces = splitting.all_pieces(block, limits)
    assert pieces.count() == pieces.distinct().count() and rows(pieces.where("pos in (1, 3, 5, 6)").select("pos", "n_pieces")) == [(1, 1), (3, 1), (5, 1), (6, 1)]
    assert splitting.oversized_blocks(block.limit(0), limits).count() == splitting.oversized_blocks(block, limits.limit(0)).count() == 0


def test_very_long_text_is_linear():
    text = "Some words of a sentence about ledgers. " * 25_000
    assert len(splitting.split_text(text, "paragraph", 900, 90)) > 1000


# -- 6 canonical


def test_canonical_operator(spark):
    block = spark.createDataFrame([(1, 0, "p", "a b", 1, 0), (1, 0, "p", "a b", 1, 0), (1, 1, "p", None, 1, 0), (1, 2, "p", "", 1, 0)], BLOCK)
    topic = spark.createDataFrame([(2, 0, "Ｔ", None, None, None, None)], TOPIC)
    got = rows(canonical.canonical_texts(canonical.block_and_title_texts(block, topic)).select("field", "doc_id", "ix", "text"))
    assert got == [("block_text", 1, 0, "a b"), ("block_text", 1, 0, "a b"), ("block_text", 1, 1, None), ("block_text", 1, 2, ""), ("topic_title", 2, 0, "T")]


# -- 7 packing


def _optimal(sizes, capacity):
    best = len(sizes)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for j in sorted(range(len(room)), key=lambda j: room[j]):
            if room[j] >= sizes[i]:
                room[j] -= sizes[i]
                place(i + 1, room)
                room[j] += sizes[i]
        place(i + 1, [*room, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_bound_and_packing_hold_the_optimum(sizes):
    at, n = packing.best_fit(np.array(sizes), 20)
    assert np.bincount(at, weights=sizes).max() <= 20 and len(set(at)) == n
    assert packing.lower_bound(np.array(sizes), 20) <= _optimal(sizes, 20) <= n


def test_pack_documents(spark):
    texts = ["word " * k for k in (1, 5, 30, 31, 32, 64, 300)] + [None, "", "ünïcödé " * 200, "x" * 500]
    data = [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data + [data[2]], DOCS).withColumn("n_tokens", F.lit("clash"))
    got = packing.pack_documents(docs, 64).cache()
    enc = packing.tokenizer(packing.TOKENIZER)
    pdf = got.toPandas()
    for i, t in enumerate(texts):
        mine = pdf[pdf.doc_id == i].sort_values("piece_ix")
        if not t:
            assert mine.container_id.isna().all() and len(mine) == 1
            continue
        n = len(enc.encode_ordinary(t))
        assert mine.n_tokens.sum() == n and (len(mine) > 1) == (n > 64) and (mine.n_tokens <= 64).all()
        assert "".join(t[a:b] for a, b in zip(mine.char_start, mine.char_end)) == t
    used = pdf.dropna(subset=["container_id"]).groupby("container_id").n_tokens.sum()
    assert used.max() <= 64
    report = packing.packing_report(got, 64).first()
    assert report["n_containers"] == len(used) and report["least_containers"] <= report["n_containers"] <= report["least_containers"] + 2
    assert packing.pack_documents(docs.limit(0), 64).count() == 0


def test_groups_exchange_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 12)
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, "word " * rnd.randint(1, 60), None, None, None, None, None) for i in range(120)], DOCS)
    got = packing.pack_documents(docs, 64).cache()
    report = packing.packing_report(got, 64).first()
    sizes = np.array([r["n_tokens"] for r in got.collect()])
    alone = packing.best_fit(sizes, 64)[1]
    assert len(sizes) == 120 and report["fullest"] <= 64
    assert packing.lower_bound(sizes, 64) == report["certified_containers"] <= report["n_containers"] <= alone + 3
    empty = packing.packing_report(packing.pack_documents(docs.limit(0), 64), 64).collect()
    assert len(empty) == 1 and empty[0]["n_containers"] == empty[0]["certified_containers"] == 0
    with pytest.raises(FileNotFoundError):
        packing.tokenizer("/nowhere.tiktoken")


# -- 8 leaks


def _leaks_brute(docs, items, span=20, replaced=2):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            for p in range(len(w) - span + 1):
                for q in range(len(v) - span + 1):
                    same = [w[p + k] == v[q + k] for k in range(span)]
                    if same[0] and same[-1] and sum(same) >= span - replaced:
                        out.add((d, i))
    return out


def test_leaks_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 20, 30, 45])))) for i in range(8)]
    docs = []
    for d in range(40):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        v = items[d % 8][1].split()
        n = rnd.randint(10, len(v)) if len(v) > 10 else len(v)
        a = rnd.randint(0, len(v) - n)
        part = [w.upper() + "," for w in v[a : a + n]]
        for _ in range(rnd.randint(0, 4)):
            part[rnd.randrange(len(part))] = "other"
        docs.append((d, "\r\n".join(text[:20]) + " " + " ".join(part) + " " + " ".join(text[20:])))
    docs += [(100, None), (101, ""), docs[0]]
    items_df = spark.createDataFrame([(i, t, "en", "s") for i, t in items + [(50, None), items[1]]], "item_id bigint, text string, lang string, suite string")
    docs_df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    want = sorted(_leaks_brute(docs, items))
    assert len(want) >= 5
    for k, window in ((5, 2), (4, 3), (6, 1)):
        monkeypatch.setattr(leaks, "BLOCK_CHARS", 8_000_000)
        got = rows(leaks.find_leaks(docs_df, items_df, k=k, window=window))
        assert sorted({x[:2] for x in got}) == want
        monkeypatch.setattr(leaks, "BLOCK_CHARS", 10)  # the same stretches by the join of fingerprints
        assert rows(leaks.find_leaks(docs_df, items_df, k=k, window=window)) == got
    with pytest.raises(ValueError):
        leaks.find_leaks(docs_df, items_df, k=6, window=2)
    assert leaks.leaked_pairs(docs_df.limit(0), items_df).count() == leaks.leaked_pairs(docs_df, items_df.limit(0)).count() == 0
    report = {r["item_id"]: r["n_docs"] for r in leaks.leak_report(docs_df, items_df).collect()}
    assert report[50] == 0 and sum(report.values()) == len(want)


def test_large_test_set_reads_the_corpus_once(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 200)
    text = [" ".join(f"a{i}x{j}" for j in range(25)) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "item_id bigint, text string")
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    found = leaks.leaked_pairs(docs.mapInPandas(counted, docs.schema), items)
    assert rows(found) == [(i, i) for i in range(6)] and reads.value == 6


# -- 9 levels


def test_reading_levels(spark):
    easy = "The cat sat on the mat and the dog ran to the big red ball in the sun. " * 4
    hard = "Notwithstanding jurisdictional heterogeneity, contractual indemnification, albeit proportionate, necessitates retrospective collateralisation, whereupon supplementary apportionment substantiates it. " * 4
    docs = spark.createDataFrame(
        [(i, easy if i % 2 else hard, None, "s", None, None, None) for i in range(20)] + [(30, None, None, "s", None, None, None), (31, "too short", None, "s", None, None, None), (32, "", None, None, None, None, None), (33, "| 1 | 2 |\n" * 30, None, "s", None, None, None), (1, easy, None, "s", None, None, None)], DOCS
    ).withColumn("level", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1 if i % 2 else 4, "r") for i in range(8)] + [(0, 4, "r2"), (0, None, "r"), (99, 2, "r"), (None, 1, "r"), (1, 9, "r")], "doc_id bigint, level int, rater string")
    got = {r["doc_id"]: r["level"] for r in levels.reading_levels(docs, labels).collect()}
    assert {d: v for d, v in got.items() if d < 30} == {i: 1 if i % 2 else 4 for i in range(20)} and set(got) - set(range(20)) == {33}
    assert levels.reading_levels(docs.limit(0), labels).count() == 0
    assert {r["level"] for r in levels.reading_levels(docs, labels.limit(0)).collect()} == {1}
    assert levels.level_profile(levels.reading_levels(docs, labels), docs).count() >= 2


def test_held_out_levels(spark):
    """Models trained on half of the labelled documents agree with most labels of the other half."""
    path = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/level_label.parquet")
    half = labels.where("doc_id % 2 = 0")
    rest = labels.where("doc_id % 2 = 1").select("doc_id", F.col("level").alias("want"))
    got = levels.reading_levels(docs, half).join(rest, "doc_id").groupBy("doc_id").agg(F.max((F.col("level") == F.col("want")).cast("int")).alias("ok"))
    r = got.agg(F.avg("ok").alias("share"), F.count("*").alias("n")).first()
    assert r["n"] > 200 and r["share"] > 0.9


def test_long_row_next_to_short_ones():
    import pyarrow as pa

    row, token, weight, n = levels.tokens(pa.array(["a b c.", "word " * 300_000 + ".", None]))
    assert n.tolist() == [3, 300_001, 0] or n.tolist() == [3, 300_001, 0]
    assert len(row) == len(token) == len(weight) and isinstance(pd.Series(row).max(), (int, np.integer))


@pytest.mark.parametrize("n", [2, 30, 100])
def test_wrapped_paragraphs_are_read_whatever_their_line_ends_and_length(n):
    lines = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} and five more words follow," for i in range(n - 1)] + ["which ends the long sentence here."]
    row, token, weight, _ = levels.tokens(pa.array([sep.join(lines) for sep in (" ", "\n", "\r\n", "\r")]))
    found = [sorted(zip(token[row == i].tolist(), weight[row == i].tolist(), strict=True)) for i in range(4)]
    assert found[0] == found[1] == found[2] == found[3]
    row, token, _, _ = levels.tokens(pa.array([sep.join(lines[:1] + [""] + lines[1:]) for sep in ("\n", "\r\n")]))  # a blank line divides
    assert sorted(token[row == 0].tolist()) == sorted(token[row == 1].tolist()) and (row == 0).sum() < len(found[0])


def test_bound_uses_every_threshold_however_many_sizes():
    sizes = np.concatenate([np.arange(14001, 18501), np.repeat(np.arange(6000, 6600), 10)])  # no two of them share a container but small ones
    x, n = np.unique(sizes, return_counts=True)
    low = 6000
    want = -(-int((np.where(x > 20000 - low, 20000, np.where(x < low, 0, x)) * n).sum()) // 20000)
    assert packing.lower_bound(sizes, 20000) >= want > 4500 + 1000
