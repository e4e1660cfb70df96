"""Mixing, URL filter, WARC derivatives, the pipeline and the registration."""

import collections
import gzip
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from firnline.llm import bpe, mixing, quality, url_filter, warc
from test_dedup import linked, shingles, without_repeated_lines

SF = "/root/testdata/sf0.001"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, rest, left = {}, float(sum(sizes.values())), list(names)
    while left:
        level = rest / sum(weight[s] for s in left)
        above = [s for s in left if level * weight[s] > 3 * sizes[s]]
        if not above:
            return target | {s: level * weight[s] for s in left}
        for s in above:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            left.remove(s)
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(documents, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 3, 50, 51, rng.randint(0, 400)]), rng.choice(["a", "b", "ß", "Z", None, "tiny"])) for i in range(300)]
    rows = [(i, t, s) for i, t, s in rows if s != "tiny"] + [(400, "one", "tiny"), (401, None, "a"), (402, "w " * 60_000, "b"), (3, "again", "a"), (None, "x y", "b")]
    got = mixing.decided(documents(rows)).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        longest = max(len((t or "").split()) for _, t, x in rows if x == s)
        assert abs(taken[s] - want[s]) <= (longest if s in ("b", "tiny") else 2)
    again = mixing.decided(documents(rows).repartition(5)).select("row.doc_id", "row.text", "copies")
    key = lambda r: tuple(map(str, r))
    first = mixing.decided(documents(rows)).select("row.doc_id", "row.text", "copies")
    assert sorted(map(key, again.collect())) == sorted(map(key, first.collect()))
    assert mixing.mixed(documents(rows)).count() == sum(r["copies"] for r in got)


def test_mix_of_nothing(documents):
    assert mixing.decided(documents([])).count() == 0
    assert [r["copies"] for r in mixing.decided(documents([(1, None), (2, " ")])).collect()] == [0, 0]


def test_fit_counts_reaches_reachable_budgets():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, 6))
        counts = rng.integers(0, 5, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 2))
        taken = mixing.fit_counts(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all() and (lengths * taken).sum() <= budget
    ones = mixing.fit_counts(np.array([1, 7, 1000]), np.array([9, 500, 90]), 50_003, table=64)
    assert (np.array([1, 7, 1000]) * ones).sum() == 50_003


URLS = [
    ("http://A.example.COM/en/1?x=/es/", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/2#t", "www.example.com", "/en/2", "www.example.com/en/", "allow"),
    ("https://m.www.example.com/en/2", "m.www.example.com", "/en/2", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://com/", "com", "/", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"),
    ("http://x.net/en/9", "x.net", "/en/9", None, "allow"),
    ("http://x.com?q", "x.com", "", None, "allow"),
    ("http://[::1]:8/a://b", "[::1]:8", "/a://b", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)], "page_id int, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).select("row.page_id", "host", "path", "rule", "verdict").collect()}
    for i, want in enumerate(URLS):
        assert tuple(got[i])[1:] == want[1:]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_templates_spread_a_verdict(spark):
    rules = (("h.org", "/bad/1", "block"), ("h.org", "/good/1", "allow"))
    urls = [f"http://h.org/bad/{i}/x" for i in range(100, 200)] + [f"http://h.org/good/{i}/x" for i in range(100, 200)]
    urls += [f"http://h.org/{kind}/{i}/x" for kind in ("bad", "good") for i in range(2000, 2100)] + ["http://h.org/" + "d/" * 30]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    rows = url_filter.judge(pages, rules=rules).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert r["verdict"] == ("block" if r["path"].startswith("/bad/") else "allow"), r


def test_url_templates_without_labels_take_their_parents_purity(spark):
    rules = (("b.org", "/x/", "block"), ("g.org", "/x/", "allow"), ("few.org", "/x/", "block"))
    urls = [f"http://{h}.org/x/{'ab'[i % 2]}/{i}" for h in ("b", "g") for i in range(40)] + ["http://few.org/x/1"]
    urls += [f"http://{h}.org/y/{i}" for h in ("b", "g", "few") for i in range(3)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    rows = url_filter.judge(pages, rules=rules).where("rule is null").collect()
    want = {"b.org": (42.5 / 45, "block"), "g.org": (2.5 / 45, "allow"), "few.org": (3.5 / 6, "allow")}
    assert len(rows) == 9
    for r in rows:
        assert abs(r["purity"] - want[r["host"]][0]) < 1e-9 and r["verdict"] == want[r["host"]][1], r


def test_url_rules_equal_sql(spark):
    got = {(r["page_id"], r["host"], r["path"], r["rule"]) for r in url_filter.op4_url_filters(spark, SF).collect()}
    sql = r"""
      WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
                 FROM read_parquet('%s/pages.parquet')),
      h AS (SELECT page_id, lower(regexp_extract(r, '^[^/?#]*')) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
      SELECT page_id, host, path, CASE
        WHEN ('.' || host) LIKE '%%.www.example.com' AND path LIKE '/en/%%' THEN 'www.example.com/en/'
        WHEN ('.' || host) LIKE '%%.example.com' AND path LIKE '/en/%%' THEN 'example.com/en/'
        WHEN ('.' || host) LIKE '%%.net' AND path LIKE '/es/%%' THEN 'net/es/'
        WHEN ('.' || host) LIKE '%%.net' AND path LIKE '/fr/%%' THEN 'net/fr/'
        WHEN ('.' || host) LIKE '%%.com' AND path LIKE '/%%' THEN 'com/' END FROM h""" % SF
    assert got == set(duckdb.sql(sql).fetchall())


@pytest.mark.parametrize(
    "page,want",
    [
        ("<head><title>t</title><body><p>whole text", "whole text"),
        ("<head><title>t</title><p>whole text", "whole text"),
        ("<p>a<svg width=1 />b<p>c", "ab\nc"),
        ("<p>a<svg><title>x</title><text>y</text></svg>b", "a b"),
        ("<p>a<noscript>b<p>c<template>d", "ab\ncd"),
        ("<p>if 3 < 5 then all of this stays</p><p>rest</p>", "if 3 < 5 then all of this stays\nrest"),
        ("a <!doctype x><?php y?></ z>b <- c <> d", "a b <- c <> d"),
        ("a<!-->b<!-- c --!>d<!-- e", "abd"),
        ("a<script>b</script x>c<STYLE>d", "a c"),
    ],
)
def test_plain_text_keeps_the_page(page, want):
    assert warc.plain_text(page) == want


def test_warc_records(spark, tmp_path):
    page = "<html><head><title>A &amp; b</title></head><body><p>One<br>two &lt;3<script>x</script><!-- c --></body>"
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (3, "http://b/", "")], "page_id int, url string, html string")
    records = warc.responses(pages).withColumnRenamed("page_id", "block")
    rows = warc.derivatives(records.withColumnRenamed("block", "page_id")).collect()
    assert len(rows) == 6
    one = {r["record_type"]: r for r in rows if r["page_id"] == 1}
    source = warc.parsed(records.where("block = 1").first()["record"])[0]
    for r in one.values():
        assert r["refers_to"] == source["warc-record-id"] and r["source_payload_digest"] == warc.sha1(page.encode())
        assert r["target_uri"] == "http://a/" and r["date"] == warc.DATE
        assert r["block_digest"] == warc.sha1(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
    assert one["conversion"]["block"] == "One\ntwo <3"
    assert one["metadata"]["concurrent_to"] == one["conversion"]["record_id"]
    assert "title: A & b\r\n" in one["metadata"]["block"] and "payload-digest-verified: true" in one["metadata"]["block"]
    assert len(warc.derived(None)) == len(warc.derived(b"junk \xff")) == 2
    assert warc.parsed(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcdef")[2] == b"abc"
    made = warc.derivatives(warc.responses(pages))
    warc.write_warc(made.coalesce(1), str(tmp_path / "w"))
    whole = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "w").glob("part*")))
    again = []
    while whole:
        fields, _, _ = warc.parsed(whole)
        head, _, rest = whole.partition(b"\r\n\r\n")
        size = int(fields["content-length"])
        assert warc.sha1(rest[:size]) == fields["warc-block-digest"] and rest[size : size + 4] == b"\r\n\r\n"
        again.append(fields["warc-record-id"])
        whole = rest[size + 4 :]
    assert sorted(again) == sorted(r["record_id"] for r in rows)


def test_registered():
    names = set(entry_points.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))


def test_pipeline_equals_brute_force(spark):
    """Each stage on what the one before kept: rows that stay, texts, mix and identifiers."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500").limit(80)
    columns, before, tables = docs.columns, None, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        tables.append(docs.collect())
        assert docs.columns == columns or i == 4
    scored, lined, near, mix, coded = tables
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500").limit(80), quality.training_labels(spark, SF))
    first = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500").limit(80).collect()
    features = np.array([quality.features_of(r["text"], model.bad, model.good) for r in first])
    assert {r["doc_id"] for r in scored} == {r["doc_id"] for r, s in zip(first, model.score(features)) if s >= 0.5}
    without = without_repeated_lines([(r["doc_id"], r["text"]) for r in scored])
    was_empty = {r["doc_id"] for r in scored if not r["text"]}
    assert {r["doc_id"]: r["text"] for r in lined} == {k: t for k, t in without.items() if t or k in was_empty}
    roots = linked({r["doc_id"]: shingles(r["text"], 5) for r in lined})
    assert {r["doc_id"]: r["text"] for r in near} == {r["doc_id"]: r["text"] for r in lined if roots[r["doc_id"]] == r["doc_id"]}
    sizes, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in near:
        n = len(r["text"].split())
        sizes[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    for r in mix:
        taken[r["source"]] += len(r["text"].split())
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= longest[s]
    bpe_model, texts = bpe.bpe_of(bpe.default_path()), {r["doc_id"]: r["text"] for r in mix}
    assert collections.Counter(r["doc_id"] for r in coded) == collections.Counter(r["doc_id"] for r in mix)
    assert all(bpe_model.decode(r["ids"]) == texts[r["doc_id"]] and r["n_tokens"] * 4 == len(r["ids"]) for r in coded)


def test_pipeline_stages_on_odd_tables(spark):
    """No rows, and rows with null identifiers, texts and sources, empty and repeated rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "some words that make a line of text\nand another line of it"
    odd = [(None, text, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, text, "en", "s", len(text))] * 2
    odd += [(4, text, "en", "s", len(text)), (5, "alone " * 30, "en", "t", 180)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ") or i == 4
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert (docs.count() > 0) == bool(rows)
