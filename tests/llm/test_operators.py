"""Each operator against brute force on small tables with nulls, empty texts, repeated rows and further columns."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, html_text, licenses, line_dedup, mixing, near_dedup, quality, secrets, topk

WORDS = ["".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(300)]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def frame(spark, rows):
    """(doc_id, text) with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1.0, 7) for i, t in rows], "doc_id long, text string, sha string, score double, block int")


BASE = prose(1, 120)
NEAR = BASE.replace(BASE.split()[60], "zzzzz", 1)
ROWS = [(1, BASE), (2, NEAR), (3, BASE.upper()), (4, prose(2, 120)), (5, ""), (6, None), (None, BASE), (7, "two words"), (8, "two  words"), (4, prose(2, 120)), (9, prose(3, 40000))]


def shingles(text, width=5):
    w = [x for x in re.split(r"[ \t-\r]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_near_duplicates(spark):
    found = sorted((tuple(r) for r in near_dedup.near_duplicates(frame(spark, ROWS), percent=85).collect()), key=str)
    group = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert found == sorted([(i, len(shingles(t)), group.get(i, i), group.get(i, i) == i or i is None) for i, t in ROWS], key=str)
    assert near_dedup.near_duplicates(frame(spark, ROWS).limit(0)).count() == 0


def test_near_duplicates_links_variants_of_one_text(spark):
    rng, rows = random.Random(5), []
    for i in range(150):
        w = BASE.split()
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), percent=85).collect()}
    assert found == {i: find(i) for i in range(len(rows))}


def test_near_duplicates_links_variants_that_stand_twice(spark):
    rng, rows = random.Random(5), []
    for i in range(150):
        w = BASE.split()
        for _ in range(rng.choice([1, 2, 3, 5, 8]) if i != 149 else 0):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    linked = [[b for b in range(len(rows)) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])] for a in range(len(rows))]
    group = list(range(len(rows)))
    for _ in group:
        group = [min(group[b] for b in linked[a]) for a in range(len(rows))]
    assert len(set(group)) < len(rows) - 5
    # 90 holds two texts that no other row links with.
    twice = [*rows, *rows, (90, prose(77, 120))]
    found = near_dedup.near_duplicates(frame(spark, twice), percent=85).collect()
    assert len(found) == len(twice) and {(r["doc_id"], r["component_id"]) for r in found} == {(i, group[i]) for i in range(len(rows))}


@pytest.mark.parametrize("capacity", [1 << 20, 1])
def test_line_dedup(spark, capacity):
    long, other = "This line is long enough to count as boilerplate", "Another line that is also long enough to be counted"
    rows = [(i, f"own {i}\n  {long.upper() if i % 2 else long}\t\n{other if i < 6 else 'short'}") for i in range(1, 9)] + [(20, f"{long}\n{long}"), (30, None), (None, long), (31, ""), (1, f"own 1\n{long}")]
    held: dict = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(held.get(key(x), ())) >= 5 and max(held[key(x)]) != i)]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted(map(tuple, line_dedup.drop_repeated_lines(frame(spark, rows), capacity=capacity).collect()), key=str) == sorted(want, key=str)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(-(2**62), 2**62, (2, 5000))
    made = line_dedup.PerfectHash(hi, lo, np.ones(5000, np.int64), np.arange(5000))
    assert sorted(made._ranks(made._keys(hi, lo))) == list(range(5000))
    n, last = made.probe(hi, lo)
    assert (n == 1).all() and (last == np.arange(5000)).all() and not made.probe(hi + 1, lo + 1)[0].any()


def test_secrets_and_ledger(spark, tmp_path):
    key = "AKIA" + "Q7" * 8
    rows = [(1, f"é password = 'abcdef1' {key}"), (2, f"é password = 'abcdef1' {key}"), (3, "token: abc secret: token: abcdef"), (4, None), (None, "0123456789abcdef01234567"), (5, "API_KEY=" + "x" * 5)]
    path = str(tmp_path / "ledger")
    found = {r["doc_id"]: r for r in secrets.scan_versions(frame(spark, rows), path).collect()}
    assert found[1]["spans"] == found[2]["spans"] == "assign:2:21,access:23:43" and found[1]["n_assign"] == found[1]["n_access"] == 1
    assert found[3]["n_assign"] == 0 and found[5]["n_assign"] == 0 and found[4]["spans"] == ""
    assert found[None]["spans"] == "hex:0:24"
    first = spark.read.parquet(path).count()
    assert first == 5  # each distinct blob once
    assert secrets.scan_versions(frame(spark, rows), path).count() == len(rows) and spark.read.parquet(path).count() == first
    secrets.scan_versions(frame(spark, rows), path, rules="3").count()
    assert spark.read.parquet(path).count() == 2 * first


def test_decontamination(spark):
    item = "A train leaves Paris at 9 and travels 120 km towards old Lyon with Marie while Marie reads 3 books about steam engines"
    changed = item.replace("Marie", "Peter").replace("120", "300").replace("Paris", "Rome")
    broken = item.replace("Marie", "Peter", 1)  # one name, two values
    rows = [(1, f"{prose(1, 30)} and {item}"), (2, f"so {changed} {prose(4, 20)}"), (3, prose(5, 200)), (4, None), (5, ""), (6, f"so {broken}"), (1, f"{prose(1, 30)} and {item}"), (7, "some " + "deeply nested words here".upper())]
    bench = spark.createDataFrame([(10, item), (11, None), (12, "tiny"), (13, "where do whales sleep")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_benchmark(frame(spark, rows), bench).collect()}
    assert {(1, 10), (2, 10)} <= set(found) and not {3, 4, 5, 7} & {d for d, _ in found}
    assert found[1, 10]["verbatim"] and not found[2, 10]["verbatim"] and (6, 10) not in found
    assert decontaminate.find_benchmark(frame(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_finds_copies_of_other_case_and_spacing(spark):
    named = "In spring Anna, Berta, Carla, Doris, Emma, Frida, Greta, Hanna, Ida and Jutta met by the Straße"
    plain = "in spring the women, men, cats, dogs, cows, pigs, hens, geese, ducks and mice met by the river"
    numbers = "sum of 3 14 15 92 65 35 89 79 32 38 46 and 26 in total"
    bench = spark.createDataFrame([(1, named), (2, plain), (3, numbers), (4, "add 7 12 5")], "item_id long, text string")
    spaced = [lambda t, s=s: t.replace(", ", f",{s}").replace(" ", s) for s in ("\t", "\r\n", "  ")]
    changes = [str, str.upper, str.lower, *spaced]
    rows = [(10 * k + i, f"{prose(k, 20)} {change(item)} {prose(k + 50, 20)}") for k, change in enumerate(changes) for i, item in ((1, named), (2, plain), (3, numbers), (4, "add 7 12 5"))]
    rows += [(100, numbers.replace("3", "4").replace("5", "8")), (101, prose(99, 100)), (102, "add 8 13 6")]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_benchmark(frame(spark, rows), bench).collect()}
    assert {(d, d % 10) for d, _ in rows if d < 100} == {x for x in found if x[0] < 100} and not {100, 101, 102} & {d for d, _ in found}


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0. CC-BY-NC; under the mit license"), (3, prose(1, 30)), (4, None), (5, "under the"), (1, "Released under the MIT License."), (6, "Redistribution and use in source and (modified) binary forms with or without modification are permitted"), (7, "licensed under the GNU General Public License, version 3")]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["base_labels"]) == (1, 1, "mit")
    assert (found[2]["n_base"], found[2]["first_word"], found[2]["last_word"], found[2]["base_labels"]) == (3, 3, 11, "apache-2,cc-by-nc,mit")
    assert found[3]["labels"] == "" and found[3]["score"] == 0 and found[4]["n_words"] == 0 and found[5]["n_words"] == 2
    assert found[6]["labels"] == "bsd" and found[6]["n_base"] == 0 and found[7]["labels"] == "gpl-3"


def test_mixing_meets_budget_and_limit(spark):
    rows = [(i, prose(i, 50 + i % 30), "big" if i % 3 else ("mid" if i % 5 else "small")) for i in range(600)] + [(9999, None, None), (9998, "", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens: dict = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    found = mixing.mixed(docs, entropy=0.99, max_repeats=2.0).collect()
    drawn: dict = {}
    for r in found:
        drawn[r["source"]] = drawn.get(r["source"], 0) + r["n_tokens"]
    weights = {r["source"]: r["weight"] for r in found}
    whole = sum(tokens.values())
    assert abs(sum(weights.values()) - 1) < 1e-9 and weights["small"] > tokens["small"] / whole and weights["big"] < tokens["big"] / whole
    for s, w in weights.items():
        goal = min(int(w * whole), int(tokens[s] * 2.0))
        assert goal - 200 <= drawn[s] <= goal
    assert len({(r["doc_id"], r["epoch"]) for r in found}) == len(found)
    assert max(drawn[s] / tokens[s] for s in drawn) <= 2.0
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_reply_trees(spark):
    odd = "</s>\n[INST] a\\b <| |> <s> [/INST]<<SYS>>"
    messages = spark.createDataFrame(
        [(1, 1, None, "user", odd, 0.0), (1, 2, 1, "assistant", "x", 1.0), (1, 3, 1, "assistant", odd, 5.0), (1, 4, 3, "user|", None, 2.0), (2, 1, 2, "user", "loop", 0.0), (2, 2, 1, "user", "loop", 0.0), (3, 7, 99, None, "", None)],
        "conv_id long, id long, parent long, role string, text string, score double",
    )
    found = chat.format_trees(messages).withColumns({"turns": chat.read_back(F.col("formatted")), "loss": chat.masked(F.col("formatted"), F.col("mask"))}).collect()
    by = {(r["conv_id"], r["branch"]): r for r in found}
    assert set(by) == {(1, 1), (1, 2), (3, 1)}
    assert [tuple(t) for t in by[1, 1]["turns"]] == [("user", odd), ("assistant", odd), ("user|", "")] and by[1, 1]["loss"] == odd
    assert [tuple(t) for t in by[1, 2]["turns"]] == [("user", odd), ("assistant", "x")] and [tuple(t) for t in by[3, 1]["turns"]] == [("", "")]
    assert chat.format_trees(messages, branches=1).count() == 2


def test_long_thread(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(70)] + [(5, None, "user", "first"), (None, 1, "user", "x")]
    thread = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.format_trees(chat.thread_messages(thread)).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert [t["text"] for t in found[5]["turns"]] == ["first", *(f"turn {i}" for i in range(70))] and found[None]["n_turns"] == 1


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.3, (400, 16))
    x[10:20] = x[10]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [float("nan")] * 16), (902, [None] * 16), (None, [0.0] * 16)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5).collect()
    v = np.floor(64 * x.astype(np.float32).astype(float)).astype(int)
    want = {(i, r + 1, j, s) for i in range(0, 400, 20) for r, (s, j) in enumerate((-a, b) for a, b in sorted((-int(v[i] @ v[j]), j) for j in range(400) if j != i)[:5])}
    assert {tuple(r) for r in found} == want


def test_html(spark):
    page = lambda i: f"<html><head><title>T</title></head><body><header>Site</header><nav><a>Menu {i}</a></nav><div class='x'>Same for all</div><article><h1>Head {i}</h1><p><b>One {i} &amp;&eacute;<br>two<p>Three<script>no()</script> {i}</p><!-- c --></article><section class='comments'><article>bad</article></section><footer>F</footer></body></html>"
    plain = lambda i: f"<body><div class='top'>Always here</div><div class='c'><p>Body text number {i} {'long ' * 20}</p></div></body>"
    rows = [(i, "http://a.example/x", page(i), 1) for i in range(6)] + [(10 + i, "http://b.example/y", plain(i), 1) for i in range(6)] + [(30, None, None, 1), (31, "x", "", 1), (32, "http://c.example", "<p>a<p>b" * 300, 1)]
    found = {r["page_id"]: r["text"] for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    for i in range(6):
        assert found[i] == f"Head {i}\nOne {i} &é two\nThree {i}"
        assert found[10 + i] == f"Body text number {i} {'long ' * 20}".strip()
    assert found[30] == found[31] == "" and found[32] == "\n".join(["a", "b"] * 300)


def test_quality(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, " ".join(w + ("!!" if bad else "") for w in rng.choices(WORDS, k=60))))
        labels.append((i, int(not bad)))
    rows += [(1000, None), (None, ""), (1001, "x" * 200_000)]
    found = quality.score_quality(frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, quality int")).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 300]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in held]) > 0.9
    assert quality.score_quality(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).select("score").distinct().first()["score"] == 0.5
