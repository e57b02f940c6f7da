"""Operators against brute force, their SQL on the smallest tables, and defined results for empty, repeated and odd rows."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, html_text, licenses, line_dedup, mixing, near_dedup, oracles, quality, queries, secrets, topk

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORDS = ["".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(300)]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def frame(spark, rows):
    """(doc_id, text) with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1.0, 7, "s", "w") for i, t in rows], "doc_id long, text string, sha string, score double, block int, key string, words string")


@needs_tables
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(oracles.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(ours) == rows(theirs)


# --- lines


@pytest.mark.parametrize("capacity", [0, 1, 1 << 20])
def test_line_dedup_keeps_large_ids_apart(spark, capacity):
    a, b = "This line is long enough to count as boilerplate", "Another line that is also long enough to be counted"
    rows = [(2**60 + i, f"{a}\n{b}\nown {i}") for i in range(1, 7)] + [(None, a), (None, b), (None, a), (2**62, "x " * 50_000 + f"\n{a}")] + [(i, f"{b} {i % 40}") for i in range(1000)]
    found = line_dedup.drop_repeated_lines(frame(spark, rows), capacity=capacity, carry=("key",)).collect()
    held = {}
    for i, t in rows:
        for line in set(t.split("\n")):
            if i is not None and len(line.strip()) >= 40:
                held.setdefault(line.strip().lower(), set()).add(i)
    drop = lambda i, line: len(line.strip()) >= 40 and len(held.get(line.strip().lower(), ())) >= 5 and max(held[line.strip().lower()]) != i
    want = sorted(((i, "\n".join(x for x in t.split("\n") if not drop(i, x)), sum(drop(i, x) for x in t.split("\n"))) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in found), key=str) == want
    assert line_dedup.drop_repeated_lines(frame(spark, rows).limit(0), capacity=capacity).count() == 0


# --- secrets


def test_repeated_rows_are_scanned_once(spark, tmp_path):
    path, text = str(tmp_path / "ledger"), "token: abcdef1 " + "é" * 70_000 + " AKIA" + "Q" * 16
    rows = [(1, text)] * 3 + [(2, text), (None, text), (None, None)]
    found = secrets.scan_versions(frame(spark, rows), path).collect()
    assert len(found) == 6 and {r["spans"] for r in found if r["spans"]} == {"assign:0:14,access:70016:70036"}
    assert spark.read.parquet(path).count() == 2
    assert secrets.scan_versions(frame(spark, rows).limit(0), path).count() == 0 and spark.read.parquet(path).count() == 2


# --- near duplicates


def test_near_duplicates_equal_brute_force_over_many_variants(spark):
    rng, rows = random.Random(3), []
    for base in range(3):
        text = prose(base, 60 + 40 * base).split()
        for i in range(120):
            w = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w[: len(w) - rng.choice([0, 0, 1, 5])])))
    rows = [r for r in rows if r[0] % 120]  # no group has its original
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (1002, "one two"), (1003, "one  two")]
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    linked = [[b for b in range(len(rows)) if b == a or rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])] for a in range(len(rows))]
    while (now := [min(group[b] for b in linked[a]) for a in range(len(rows))]) != group:
        group = now
    found = near_dedup.near_duplicates(frame(spark, rows), percent=85).collect()
    want = {(i, len(s), None if i is None else rows[g][0]) for (i, _), s, g in zip(rows, sets, group, strict=True)}
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found} == want and len(found) == len(rows)


# --- benchmark


def brute_windows(text, named, width=8):
    """Templates of a text and the values of their placeholders, as the module's docstring states them."""
    words = [w for w in re.split(r"[^\w\x04]+|_", re.sub(r"(?<=[0-9])[.,](?=[0-9])", "\x04", text or "")) if w]
    number = [bool(re.fullmatch(r"[0-9][0-9\x04]*", w)) for w in words]
    kinds = []
    for i, w in enumerate(words):
        lone = number[i] and not (i and words[i - 1][-1].isdigit()) and not (i + 1 < len(words) and words[i + 1][0].isdigit())
        if lone:
            kinds.append("#")
        elif kinds and kinds[-1] == "#" and w.lower() in decontaminate.UNITS:
            kinds.append("u")
        elif named and len(w) > 1 and w[0].isupper() and w[1].islower():
            kinds.append("n")
        else:
            kinds.append(w.upper().lower())
    values = [w.upper().lower() for w in words]
    return {i: (tuple(kinds[i : i + width]), tuple(values[i : i + width])) for i in range(len(words) - width + 1)}


def brute_found(doc, item):
    hits = {}
    for named in (True, False):
        ours, theirs = brute_windows(doc, named), brute_windows(item, named)
        for at, (kinds, values) in theirs.items():
            if named and "n" in kinds and sum(k in "#un" for k in kinds) > 4:
                continue
            for pos, (other, others) in ours.items():
                if other == kinds:
                    hits.setdefault(pos - at, []).append((at, [(v, o) for k, v, o in zip(kinds, values, others, strict=True) if k in ("#", "u", "n")]))
    for run in hits.values():
        pairs = {p for _, ps in run for p in ps}
        if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}) and len({at for at, _ in run}) >= min(6, len(brute_windows(item, False))):
            return True
    return False


def test_decontamination_equals_brute_force(spark):
    items = [
        "A farmer sold 12 eggs to Anna and then 30 eggs to Berta before noon on a warm day in spring near the old mill",
        "The rod is 3.5 m long and weighs 1,200 kg so how many rods fit into a truck that carries at most 24,000 kg of steel",
        "12 + 15 = 27 , 3 x 4 = 12 , 9 - 4 = 5 , 8 / 2 = 4 and 77 + 1 = 78 , 6 x 6 = 36",
        prose(70, 30),
    ]
    changes = [
        str, str.lower, str.upper, lambda t: t.replace(" ", "\n"), lambda t: f'"{t}"', lambda t: t.replace("12 eggs", "45 eggs").replace("30", "7"), lambda t: t.replace("Anna", "Zoe").replace("Berta", "Yan"),
        lambda t: t.replace("1,200", "900").replace("24,000", "18,000,000"), lambda t: t.replace("12", "13"), lambda t: t.replace("Anna", "Berta", 1), lambda t: " ".join(t.split()[::-1]), lambda t: t.replace("12", "30", 1),
    ]
    rows = [(100 * k + n, f"{prose(k, 30)} {change(item)} {prose(k + 50, 30)}") for k, change in enumerate(changes) for n, item in enumerate(items)]
    rows += [(9000, prose(90, 9000) + " " + items[0] + " " + prose(91, 9000)), (9001, "7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24")]
    bench = spark.createDataFrame([(n, t, "x", 2) for n, t in enumerate(items)], "item_id long, text string, key string, at int")
    for size in (64 << 20, 0):  # windows sent to all, and joined by a shuffle
        found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_benchmark(frame(spark, rows), bench, most_bytes=size).collect()}
        assert found == {(i, n) for i, t in rows for n, item in enumerate(items) if brute_found(t, item)}
    assert {(i, i % 100) for i in (0, 1, 2, 3, 100, 101, 102, 103, 200, 201, 202, 203, 300, 301, 400, 500, 600, 701)} <= found and (9000, 0) in found


def test_short_items_are_found_as_whole_documents(spark):
    bench = spark.createDataFrame([(1, "Paris"), (2, "7 8"), (3, ""), (4, None), (5, "?!")], "item_id long, text string")
    rows = [(1, "paris."), (2, "in Paris"), (3, "7, 8"), (4, "8 7"), (5, None), (6, ""), (None, "PARIS"), (1, "paris.")]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_benchmark(frame(spark, rows), bench).collect()}
    assert found == {(1, 1), (3, 2), (None, 1)} and decontaminate.find_benchmark(frame(spark, rows).limit(0), bench).count() == 0


# --- mixing


def brute_mixture(rows, entropy, repeats, budget=None, seed=1):
    order = lambda *parts: int(hashlib.md5(":".join("\0" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)
    docs = [(i, s, n, order(seed, i)) for i, t, s in rows if (n := len((t or "").split()))]
    tokens: dict = {}
    for _, s, n, _ in docs:
        tokens[s] = tokens.get(s, 0) + n
    whole = sum(tokens.values())
    budget = whole if budget is None else budget
    p = {s: n / whole for s, n in tokens.items()}

    def weights(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    h = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    passes = lambda a: max(w * budget / tokens[s] for s, w in weights(a).items())

    def bisect(good, low, high):  # good(low), not good(high)
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    alpha = 1.0 if len(p) == 1 or h(1) >= entropy * math.log(len(p)) else bisect(lambda a: h(a) >= entropy * math.log(len(p)), 0.0, 1.0)
    if passes(alpha) > repeats:
        alpha = 1.0 if passes(1.0) > repeats else 1 - bisect(lambda b: passes(1 - b) <= repeats, 0.0, 1 - alpha)
    block = max(mixing.LEAST_BLOCK, math.ceil(whole / mixing.MOST_BLOCKS))
    drawn = []
    for s, w in weights(alpha).items():
        goal, n_blocks = min(int(w * budget), int(tokens[s] * repeats)), math.ceil(tokens[s] / block)
        of: dict = {}
        for d in docs:
            if d[1] == s:
                of.setdefault((d[3] >> 5) % n_blocks, []).append(d)
        for epoch in range(goal // tokens[s] + 1):
            left = tokens[s] if epoch < goal // tokens[s] else goal % tokens[s]
            for b in sorted(of, key=lambda b: (order(seed, s, epoch, b), b)):
                total = sum(d[2] for d in of[b])
                if left >= total:
                    drawn += [(d[0], epoch) for d in of[b]]
                elif left > 0:
                    upto = 0
                    for d in sorted(of[b], key=lambda d: d[3]):
                        upto += d[2]
                        if upto <= left:
                            drawn.append((d[0], epoch))
                left -= total
    return sorted(drawn, key=str), weights(alpha)


@pytest.mark.parametrize(("entropy", "repeats", "budget"), [(0.95, 4.0, None), (0.99, 1.5, None), (0.5, 4.0, None), (1.0, 3.0, 90_000)])
def test_mixing_equals_brute_force(spark, monkeypatch, entropy, repeats, budget):
    monkeypatch.setattr(mixing, "LEAST_BLOCK", 4000)
    rows = [(i, prose(i, 20 + i * 7 % 90), ["big", "big", "mid", "small", None][min(i * 13 % 11, 4) if i % 9 else 0]) for i in range(500)] + [(900, None, "mid"), (901, "", None), (902, "x " * 3000, "mid")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, block int, order string")
    want, weights = brute_mixture(rows, entropy, repeats, budget)
    for most in (200_000, 0):  # sources sent to all, and joined by a shuffle
        monkeypatch.setattr(mixing, "MOST_SOURCES", most)
        found = mixing.mixed(docs, entropy=entropy, max_repeats=repeats, budget=budget).collect()
        assert {r["source"]: round(r["weight"], 5) for r in found} == {s: round(w, 5) for s, w in weights.items()}
        near = set(want) ^ {(r["doc_id"], r["epoch"]) for r in found}
        assert len(near) <= 4  # the exponent is bisected to 32 ** -5, a token or two of a goal


def test_mixing_returns_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)], "doc_id long, text string, source string")
    assert sorted((str(r["doc_id"]) for r in mixing.mixed(docs, entropy=0.1).collect())) == ["1", "1", "None"]


# --- pages


def test_alignment_is_the_largest_simple_tree_matching(monkeypatch):
    def matching(x, y):
        if x[0] != y[0]:
            return 0
        m = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, p in enumerate(x[1]):
            for j, q in enumerate(y[1]):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + matching(p, q))
        return m[-1][-1] + 1

    def tree(rng, depth):
        return (rng.choice("ab") if depth < 4 else "r", [tree(rng, depth - 1) for _ in range(rng.randrange(0, 4))] if depth else [])

    def flat(t, parent=-1, out=None):
        out = [] if out is None else out
        here = len(out)
        out.append([t[0], parent, 0, 0, False, 1])
        for k in t[1]:
            flat(k, here, out)
        return out

    for cells in (1 << 20, 2):
        monkeypatch.setattr(html_text, "MOST_CELLS", cells)
        for seed in range(150):
            rng = random.Random(seed)
            one, two = tree(rng, 4), tree(rng, 4)
            pairs = html_text.aligned(flat(one), flat(two))
            to = dict(pairs)
            assert len(pairs) == len(to) == len(set(to.values())) == matching(one, two)
            x, y = flat(one), flat(two)
            assert all(x[a][0] == y[b][0] and (x[a][1] < 0 or to[x[a][1]] == y[b][1]) for a, b in pairs)


def test_generated_pages_give_their_text_back(spark):
    rng, rows, want = random.Random(4), [], {}
    for i in range(240):
        host, kind = i % 4, i % 3
        paragraphs = [prose(1000 * i + k, rng.randrange(3, 60)) for k in range(rng.randrange(1, 9))]
        body = "".join(f"<p title=don't>{p}</p>" for p in paragraphs)
        side = f"<aside>{prose(i, 9)}</aside><div class='ad-banner'>{prose(i + 7, 8)}</div>"
        shell = [
            f"<article><h1>{i} head</h1>{body}<div class=related-work><p>about it {i}</p></div><label>kept</label></article><section class='comments'><p>{prose(i + 3, 30)}</p></section>",
            f"<div class=wrap><div class=top>Welcome to site {host}</div><div class=main-text>{body}</div><div class=bottom>All rights {host}</div></div>",
            f"<main><h2>{i} head</h2>{body}<ul><li>one {i}<li>two {i}</ul></main>",
        ][kind]
        rows.append((i, f"http://h{host}.example/{kind}/{i}", f"<html><head><title>t</title></head><body><nav><a>Home</a><a>{i}</a></nav>{side}{shell}<footer>f {i}</footer></body></html>", 1))
        want[i] = "\n".join({0: [f"{i} head", *paragraphs, f"about it {i}", "kept"], 1: paragraphs, 2: [f"{i} head", *paragraphs, f"one {i}", f"two {i}"]}[kind])
    rows += [(900 + i, "http://h0.example/error", "<html><body><p>gone</p></body></html>", 1) for i in range(3)] + [(950, None, None, 1), (951, "x", "", 1), (0, rows[0][1], rows[0][2], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    for size in (32 << 20, 0):  # wrappers sent to all, and dealt with the pages
        found = [(r["page_id"], r["text"]) for r in html_text.extract_pages(pages, most_bytes=size).collect()]
        assert len(found) == len(rows)
        right = [i for i, t in found if i < 900 and t == want[i]]
        kept = sum(len(set(t.split("\n")) & set(want[i].split("\n"))) for i, t in found if i < 900)
        assert kept >= 0.99 * sum(len(set(want[i].split("\n"))) for i, _ in found if i < 900)  # recall of blocks
        assert kept >= 0.97 * sum(len(t.split("\n")) for i, t in found if i < 900)  # precision of blocks
        assert len(right) >= 0.95 * 241
        assert dict(found)[950] == dict(found)[951] == ""
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_deep_and_wide_pages_are_linear():
    import time

    began = time.time()
    deep = html_text.parse("<div>" * 20_000 + "x" + "</div>" * 20_000)
    assert len(html_text.skeleton(deep)) == 20_001 and html_text.main_text(deep, html_text.skeleton(deep), [], html_text.Shapes()) == "x"
    one, two = (html_text.skeleton(html_text.parse("<article>" + "".join(f"<div class=c{i % 3}><p>{i}</p><ul><li>x</ul></div>" for i in range(n)) + "</article>")) for n in (2000, 1999))
    assert len(html_text.aligned(one, two)) == len(two) and time.time() - began < 60


# --- licenses


def brute_licenses(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    base, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        base += [(i, label) for i in at]
    labels |= {label for _, label in base}
    for notice, label in licenses.NOTICES:
        p, k = notice.split(), licenses.K
        hits = {}
        for i in range(len(words) - k + 1):
            for j in range(len(p) - k + 1):
                if words[i : i + k] == p[j : j + k]:
                    hits.setdefault(i - j, set()).add(j)
        runs = []
        for d in sorted(hits):
            if runs and d - runs[-1][-1] <= licenses.DRIFT:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            covered = {j + x for d in run for j in hits[d] for x in range(k)}
            first, end = min(d + min(hits[d]) for d in run), max(d + max(hits[d]) + k for d in run)
            if len(covered) / len(p) >= licenses.COVER and end - first <= len(p) + licenses.DRIFT:
                labels.add(label)
    at = [i for i, _ in base]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))


def test_licenses_equal_brute_force(spark):
    rng, texts = random.Random(2), [None, "", "İK under the MIT license", "Apache License 2.0", "GPL v3 licensed", "# SPDX-License-Identifier: MIT", "under the mit license " * 50, prose(1, 30_000) + " under the MIT License."]
    for notice, _ in [*licenses.PHRASES, *licenses.NOTICES]:
        w = notice.split()
        for edits in (0, 1, 2, 5):
            v = list(w)
            for _ in range(edits):
                at = rng.randrange(len(v))
                v[at : at + 1] = rng.choice([[], ["zz"], [v[at], "and"]]) or ["q"]
            texts.append(f"{prose(len(texts), 9)}. {' '.join(v).title()}; {prose(len(texts) + 1, 5)}")
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "Apache License 2.0"), (None, "cc-by-nc"), (3, "other")]
    found = licenses.scan_licenses(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in found), key=str) == sorted(((i, *brute_licenses(t)) for i, t in rows), key=str)
    assert all(0 <= r["score"] <= 1 for r in found) and licenses.scan_licenses(frame(spark, rows).limit(0)).count() == 0


# --- chat


def test_chat_defined_results(spark):
    rows = [(1, 0, "user", "x" * 200_000, "c"), (1, 1, "assistant", "y\\<s>", "c"), (1, 1, "assistant", "y\\<s>", "c"), (2, 0, None, None, "c"), (None, 3, "assistant", "", "c")]
    thread = chat.thread_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string"))
    found = {r["conv_id"]: r for r in chat.format_trees(thread).withColumns({"turns": chat.read_back(F.col("formatted")), "loss": chat.masked(F.col("formatted"), F.col("mask"))}).collect()}
    assert found[1]["loss"] == "y\\<s>" * 2 and len(found[1]["turns"][0]["text"]) == 200_000 and found[2]["n_turns"] == found[None]["n_turns"] == 1
    assert chat.format_trees(thread.limit(0)).count() == 0
    tie = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 1.0)], "conv_id long, id long, parent long, role string, text string, score double")
    assert [(r["branch"], r["leaf"]) for r in chat.format_trees(tie).orderBy("branch").collect()] == [(1, 2), (2, 3)]


# --- search


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e6])
def test_top_k_equals_brute_force(spark, scale):
    x = np.random.default_rng(1).normal(0, 0.3, (300, 16)) * scale
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(500, [], 1), (501, [], 1), (520, [], 1), (900, None, 1), (901, [math.nan] * 16, 1), (902, [None] * 16, 1), (903, [1e38] * 16, 1), (None, [0.0] * 16, 1), (40, [5.0] * 16, 1)]
    rows += [(600 + i, [1.0 * i, 2.0], 1) for i in range(30)] + [(700 + i, [0.25] * 16, 1) for i in range(41)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, norm int")
    found = {tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=5).collect()}
    v: dict = {}
    for i, e, _ in rows:
        if i is not None and e is not None and i != 903 and all(a is not None and math.isfinite(a) for a in e):
            w = [math.floor(64 * float(np.float32(a))) for a in e]
            v[i] = min(v.get(i, w), w)
    want = set()
    for i in v:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[i], v[j], strict=True)), j) for j in v if j != i and len(v[j]) == len(v[i]))[:5]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert found == want and topk.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_drops_block_pairs_that_cannot_matter(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(2)
    centres = np.eye(8) * 4
    x = np.concatenate([c + rng.normal(0, 0.01, (60, 8)) for c in centres])
    told: dict = {}
    vectors = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    found = topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=5, told=told).collect()
    assert told["left"] < 0.5 * told["pairs"] and {r["vec_id"] // 60 == r["query_id"] // 60 for r in found} == {True}


# --- quality


def test_quality_of_long_and_no_documents(spark):
    rows = [(i, ("good words here " if i % 2 else "bad!! bad?? bad## ") * (4000 if i < 4 else 10)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    docs = frame(spark, rows)
    texts = dict(rows)
    assert all(r["text"] == texts[r["id"]] for r in quality.training_rows(docs, labels).collect())  # whole, however long
    found = {r["doc_id"]: r for r in quality.score_quality(docs, labels, carry=("key",)).collect()}
    held = [i for i in found if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((found[i]["score"] >= 0.5) == (i % 2 == 1) and found[i]["held_out"] for i in held)
    assert quality.score_quality(docs.limit(0), labels).count() == 0


@needs_tables
def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    found = quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    assert len(found) > 50 and np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in found]) > 0.9
