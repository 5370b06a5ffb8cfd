"""Licenses, lines, near-duplicates, URLs: brute force and edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolattice.llm import licenses, line_dedup, near_dedup, url_filter
from chronolattice.llm._graph import components
from chronolattice.llm._words import SIGNS, chunks, word_hashes

DOCS = "doc_id long, text string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


# --- words

def test_word_hashes():
    texts = ["Hello,  the world", "", "a", "x\ty!! z", "é word word", "\n \n"]
    h, doc = word_hashes([t.encode() for t in texts])
    want = [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert doc.tolist() == [k for k, _ in want]
    for (i, (_, a)), (j, (_, b)) in [((i, x), (j, y)) for i, x in enumerate(want) for j, y in enumerate(want)]:
        assert (a == b) == (h[i] == h[j])
    assert len(word_hashes([b"ab,cd!! e"], SIGNS)[0]) == 5
    assert [(s, len(p)) for s, p in chunks([b"a" * 6, b"b" * 6, b"c" * 40, b""], 10)] == [(0, 1), (1, 1), (2, 1), (3, 1)]


# --- licenses

def brute_lis_alignment(a, b):
    """Longest common subsequence: an upper bound for any alignment."""
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_patience_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= brute_lis_alignment(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    same = list("abcabc")
    assert len(licenses.patience(same, same)) == 6


def brute_hits(text):
    """Templates of which some window of the text has enough words in order."""
    own, found = licenses.words(text or ""), set()
    for name, _, template in licenses.TEMPLATES:
        t = licenses.words(template)
        slack = -(-len(t) // 4)
        for s in range(len(own)):
            if len(licenses.patience(own[s : s + len(t) + 2 * slack], t)) >= licenses.COVERAGE * len(t):
                found.add(name)
                break
    return found


def test_license_windows_lose_nothing():
    rng = random.Random(2)
    for _ in range(40):
        name, _, template = rng.choice(licenses.TEMPLATES)
        words = template.split()
        for _ in range(len(words) // 8):
            words[rng.randrange(len(words))] = "zz"
        filler = lambda: [rng.choice(["the", "of", "license", "software", "x", "y"]) for _ in range(rng.randrange(30))]
        text = " ".join(filler() + words + filler())
        assert {h["license"] for h in licenses.hits(text)} == brute_hits(text)


def test_license_report(spark):
    mit = "Released under the MIT License."
    texts = [f"word {mit} word", None, "", f"{mit} {mit}", "license license", "x " * 30_000 + mit, mit, mit]
    d = docs(spark, texts, [0, 1, 2, 3, 4, 5, 6, 6]).withColumn("license", F.lit("clash"))
    got = licenses.license_report(d).collect()
    assert [(r.doc_id, r.license, r.hits) for r in sorted(got, key=lambda r: r.doc_id)] == [(0, "MIT", 1), (1, None, 0), (2, None, 0), (3, "MIT", 2), (4, None, 0), (5, "MIT", 1), (6, "MIT", 1), (6, "MIT", 1)]
    assert licenses.license_hits(d).count() == 6 and licenses.license_report(d.limit(0)).count() == 0


@pytest.mark.parametrize("text, name", [
    ("Released under the MIT License.", "MIT"),
    ("Licensed under the MIT License.", "MIT"),
    ("Released under the BSD License.", "BSD"),
    ("Released under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Released under the GPL License.", "GPL"),
    ("Released under the new license.", None),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("Licensed under CC BY 4.0", "CC-BY-4.0"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
    ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.0.", "GPL-3.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    (licenses._GNU.format("Lesser General", "2.1"), "LGPL-2.1"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
])
def test_license_is_named(text, name):
    found = licenses.named_hits(f"some words before. {text} And words after it.")
    assert [h["license"] for h in found] == [name] * (name is not None)


def test_every_template_names_its_license():
    for name, _, text in licenses.TEMPLATES:
        assert [h["license"] for h in licenses.named_hits(text)] == [name], text


# --- lines

def brute_lines(rows):
    """Numbers of the lines that go, by document."""
    words = lambda s: [w for w in s.translate(str.maketrans("\t\x0b\x0c\r", "    ")).split(" ") if w]
    lines = [((d, k), words(s)) for d, t in rows if t is not None for k, s in enumerate(t.split("\n"))]
    lines = [x for x in sorted(lines, key=lambda x: x[0]) if x[1]]

    def close(a, b):
        if a == b:
            return True
        if max(len(a), len(b)) < line_dedup.FEWEST:
            a, b = " ".join(a), " ".join(b)
        if max(len(a), len(b)) < line_dedup.FEWEST or abs(len(a) - len(b)) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]

    return {at for n, (at, a) in enumerate(lines) if any(close(a, b) and earlier != at for earlier, b in lines[:n])}


def edited(rng, words):
    w = list(words)
    kind, k = rng.randrange(3), rng.randrange(len(w))
    if kind == 0:
        w[k] = rng.choice("abc")
    elif kind == 1:
        del w[k]
    else:
        w.insert(k, rng.choice("abc"))
    return w


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnop") for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 20]))] for _ in range(16)] + [["a"] * 9, ["a"] * 10]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(5)):
            w = rng.choice(base)
            for _ in range(rng.randrange(3)):
                w = edited(rng, w) if w else w
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        texts.append("\n".join(lines))
    rows = list(enumerate(texts))
    gone = brute_lines(rows)
    got = {r.doc_id: r for r in line_dedup.line_report(docs(spark, texts)).collect()}
    for d, t in rows:
        assert got[d].lines_gone == sum(x[0] == d for x in gone), d
    kept = line_dedup.drop_lines(docs(spark, texts)).collect()
    for r in kept:
        rest = "\n".join(s for k, s in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, k) not in gone)
        assert r.text == rest and r.n_chars == len(rest)
    assert {r.doc_id for r in kept} == {d for d, t in rows if not any(x[0] == d for x in gone) or any((d, k) not in gone and s.strip() for k, s in enumerate(t.split("\n")))}


def test_short_lines_against_brute_force(spark):
    rng = random.Random(6)
    base = ["abcde", "ab cd", "page 12", "Copyright 2023 Example Inc.", "a b c d", "ab cd ef gh", "ab cd ef gh ij", "über uns \U0001d49c", "abcd", "1.", "aaaaa", "aaaaaa"]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                line = edited(rng, line) if line else line
            lines.append("".join(line))
        texts.append("\n".join(lines))
    gone = brute_lines(list(enumerate(texts)))
    got = {r.doc_id: r.lines_gone for r in line_dedup.line_report(docs(spark, texts)).collect()}
    assert got == {d: sum(x[0] == d for x in gone) for d in range(len(texts))}
    same = ["Copyright 2023 Example Inc.", "Copyright 2024 Example Inc.", "one two three four five", "one two three four", "ab cd", "ab ce", "ab", "ac"]
    assert [r.lines_gone for r in line_dedup.line_report(docs(spark, same)).orderBy("doc_id").collect()] == [0, 1, 0, 1, 0, 1, 0, 0]


def test_line_edges(spark):
    long_line = " ".join(f"w{i}" for i in range(5000))
    texts = ["a\n\na", None, "", "same\nline", "same\nline", long_line, long_line.replace("w70 ", ""), "x"]
    d = docs(spark, texts, [0, 1, 2, 3, 3, 5, 6, None]).withColumn("gone", F.lit(1)).withColumn("row", F.lit("clash"))
    got = Counter((r.doc_id, r.lines_gone) for r in line_dedup.line_report(d).collect())
    assert got == Counter({(0, 1): 1, (1, 0): 1, (2, 0): 1, (3, 0): 2, (5, 0): 1, (6, 1): 1, (None, 0): 1})
    out = line_dedup.drop_lines(d)
    assert out.columns == d.columns and out.count() == 7
    assert line_dedup.drop_lines(d.limit(0)).count() == 0


def test_hot_line_template(spark):
    texts = [f"every line of this large group has number {i} inside of it" for i in range(600)]
    assert line_dedup.line_report(docs(spark, texts)).where("lines_gone = 1").count() == 599


# --- near-duplicates

def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_classes(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t), t) for i, t in rows if t is not None]
    for n, (i, a, s) in enumerate(sets):
        for j, b, t in sets[:n]:
            both = sum((a & b).values())
            if s == t or (sum(a.values()) and s.strip() and t.strip() and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both)):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "DEAL", block)
    monkeypatch.setattr(near_dedup, "COLUMNS", 50)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 120]))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += ["", "", "  ", None, None, "word", "WORD", "a b a b a b a b a b a b"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_classes(rows)
    got = {r.doc_id: r for r in near_dedup.classes(docs(spark, texts)).collect()}
    assert {i: got[i].class_id for i, _ in rows} == want
    assert {i for i in want if got[i].kept} == {i for i in want if want[i] == i}
    kept = near_dedup.keep_first(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_blocks_of_a_cluster_against_brute_force(spark, monkeypatch):
    """Chains: most texts are linked with the least one of their cluster only through others."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_UNITS", 300)
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(6):
        base = rng.integers(1, 1 << 60, 120).astype(np.uint64)
        for _ in range(int(rng.integers(2, 30))):
            base = base.copy()
            base[rng.integers(0, 120, 9)] = rng.integers(1, 1 << 60, 9)
            rows.append((n, np.unique(base)))
            n += 1
    rows = [(i, c, u) for c, start in ((0, 0), (n // 3, n // 3), (2 * n // 3, 2 * n // 3)) for i, u in rows[start : start + n // 3]]
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(i, j):
        p, q = sorted((find(i), find(j)))
        parent[q] = p

    for k, (i, c, u) in enumerate(rows):
        for j, d, v in rows[:k]:
            both = len(np.intersect1d(u, v))
            if c == d and both >= 0.8 * (len(u) + len(v) - both):
                join(i, j)
    want = {i: find(i) for i, _, _ in rows}
    assert sum(want[i] != c for i, c, _ in rows) > 5
    sets = spark.createDataFrame([(i, c, bytearray(u.tobytes())) for i, c, u in rows], "node long, component long, units binary")
    parent = {i: i for i, _, _ in rows}
    for u, v in near_dedup.cluster_links(sets, 0.8).collect():
        join(u, v)
    assert {i: find(i) for i, _, _ in rows} == want


def test_near_edges(spark):
    d = docs(spark, ["same text here", "same text here", "same text here", None, "lone"], [4, 4, 7, None, None])
    d = d.withColumn("digest", F.lit("clash")).withColumn("kept", F.lit(1))
    out = near_dedup.keep_first(d)
    assert out.columns == d.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, ""), (-1, "lone"), (4, "same text here")]
    assert near_dedup.classes(d.limit(0)).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    b = np.concatenate((a[:300], rng.integers(1, 1 << 60, 100).astype(np.uint64)))
    doc = np.repeat([0, 1], 400)
    hits = []
    for k in range(8):
        s = near_dedup.signatures(np.concatenate((a, b)) + np.uint64(k), doc, 2)
        assert np.isfinite(s).all()
        hits.append((s[0] == s[1]).mean())
    assert np.mean(hits) == pytest.approx(300 / 500, abs=0.06)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 40)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        p, q = sorted((find(u), find(v)))
        parent[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for e in links if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- URLs

def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest).group()
        host = "".join(c.lower() if c.isascii() else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :]).group()
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
    low = "".join(c.lower() if c.isascii() else c for c in url or "")
    has = lambda t: re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low) is not None
    bad = any(map(has, url_filter.STRICT)) or sum(map(has, url_filter.SOFT)) >= url_filter.MIN_SOFT
    return host, path, rule, verdict or ("block" if bad else "allow")


def test_urls_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://a.com/fr/x", "HTTP://A.ORG/q?x#y", "http://a.org", "http://example.org/es/1", "https://x.example.org/en/12", "https://x.example.org/en/2", "http://notexample.org/es/", "http://b.com/de/1", "ftp://casino.net/", "http://xcasino.net/cheap-win", "http://n.net/free?bonus=1", "http://n.net/free/free", "http://ÄB.net/x", "http://n.net?u=http://m.org/", "http://h\n.net/p\nq", "http://pills", "http://a.net/free_loans#win"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.limit(0)).count() == 0
