"""What earlier rounds missed: hot shingles that variants share, templates inside articles, whole training texts, quiet ledgers."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import html_text, near_dedup, quality, secrets

WORDS = ["".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(300)]


def test_variants_that_share_most_shingles_equal_brute_force(spark, monkeypatch):
    """Shingles that all variants share, others that few share, none of their own."""
    monkeypatch.setattr(near_dedup, "LARGE", 8)
    monkeypatch.setattr(near_dedup, "HOT", 6)
    rng, base = random.Random(1), random.Random(0).choices(WORDS, k=90)
    rows = []
    for i in range(160):
        w = list(base)
        for at in (8, 24, 40, 56):
            if rng.random() < 0.7:
                w[at] = f"q{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    links = [[b for b in range(160) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])] for a in range(160)]
    group = list(range(160))
    while (now := [min(group[b] for b in links[a]) for a in range(160)]) != group:
        group = now
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(group)) and len(set(group)) > 1


def test_template_inside_main_article_and_div(spark):
    bodies = {f"https://h{k}.org/{i}": (k, " ".join(random.Random(f"{k}{i}").choices(WORDS, k=40))) for k in range(3) for i in range(8)}
    slots = {0: ("<main>", "</main>"), 1: ("<article>", "</article>"), 2: ("<div class='x'>", "</div>")}
    rows = []
    for n, (url, (k, body)) in enumerate(bodies.items()):
        a, b = slots[k]
        rows.append((n, url, f"<html><body>{a}<header class='site-head'><p>Site slogan</p></header><header><h1>Title {n}</h1></header><p>{body}</p><div class='newsletter-cta'>Join our list</div><p>More {body[:30]}</p><div class='post-meta share-buttons'>Share this</div>{b}</body></html>"))
    found = {r["page_id"]: r["text"] for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n, (k, body) in enumerate(bodies.values()):
        assert found[n].split("\n") == ([f"Title {n}"] if k < 2 else []) + [body, f"More {body[:30]}".strip()], found[n]


def test_few_pages_keep_what_repeats_in_their_articles(spark):
    rows = [(i, "https://h.org/", f"<article><p>Same</p><p>own {i}</p></article>") for i in range(4)]
    assert {r["text"] for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {f"Same\nown {i}" for i in range(4)}


def test_training_texts_are_whole_and_bounded_in_bytes(spark):
    rows = [(i, f"{i} é " + "x" * (50_000 if i == 7 else 10)) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, "y"), (1, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    taken = quality.training_rows(docs, labels).collect()
    assert {r["id"]: r["text"] for r in taken if r["id"] != 1}.items() <= dict(rows).items() and {r["label"] for r in taken} == {0, 1}
    assert len(next(r["text"] for r in taken if r["id"] == 7)) == len(rows[7][1])
    few = quality.training_rows(docs, labels, fit_bytes=100).collect()
    assert 2 < len(few) < len(taken) and all(sum(len(r["text"].encode()) for r in few if r["label"] == k) <= 100 for k in (0, 1))


def test_score_equals_a_plain_loop():
    net = quality.ByteNet(3)
    net.bias = np.linspace(-1, 1, quality.FILTERS).astype(np.float32)
    for n in (0, 1, 8, 9, 500, 70_001):
        data = bytes(random.Random(n).choices(range(256), k=n))
        padded = data + bytes(max(0, quality.WIDTH - n))
        padded += bytes(-(len(padded) - quality.WIDTH) % quality.STRIDE)
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(0, len(padded) - quality.WIDTH + 1, quality.STRIDE):
            window = np.concatenate([net.embed[b] for b in padded[at : at + quality.WIDTH]])
            best = np.maximum(best, window @ net.filters)
        z = float(np.maximum(best + net.bias, 0) @ net.out + net.out_bias)
        assert abs(net.probability(data) - 1 / (1 + np.exp(-z))) < 1e-4


def test_quality_of_repeated_rows_and_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i % 5}") for i in range(10)], "doc_id long, text string")
    for labels, score in (([(1, 1), (2, 1)], 1.0), ([], 0.5)):
        found = quality.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(found) == 10 and {r["score"] for r in found} == {score}


def test_ledger_without_news_moves_no_text(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(i, f"token: abcdef{i % 7} " + "x " * 50) for i in range(40)] + [(1, "token: abcdef1 " + "x " * 50)], "doc_id long, text string")
    first = {(r["doc_id"], r["spans"]) for r in secrets.scan_versions(docs, path).collect()}
    seen = []
    scanner = secrets.scanner
    monkeypatch.setattr(secrets, "scanner", lambda rules: seen.append(rules) or scanner(rules))
    assert {(r["doc_id"], r["spans"]) for r in secrets.scan_versions(docs, path).collect()} == first
    assert spark.read.parquet(path).count() == 7 and len(seen) == 1
    monkeypatch.setattr(secrets, "MOST_BYTES", 0)
    assert {(r["doc_id"], r["spans"]) for r in secrets.scan_versions(docs, path, rules="next").collect()} == first
    assert spark.read.parquet(path).where(F.col("rules") == "next").count() == 7
