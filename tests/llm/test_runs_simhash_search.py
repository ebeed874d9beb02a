"""Word runs, SimHash near copies and ranked search against brute force, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from thicket.llm import ranked_search, simhash, word_runs

SCHEMA = "doc_id long, text string, runs string, fp string, component_id string, score string, term string, item_id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    names = [f"w{i}" for i in range(40)] + ["É", "日本", "Don't", "x-1"]
    base = " ".join(rng.choice(names) for _ in range(400))
    texts = [None, "", " \n\t", "one", "one two", "A b C", "a B c", base, base, base.upper(), base + " tail", base[:-4], "ha " * 30, "a b " * 10 + "a", "x " + "p q r " * 5 + "z " + "q r p " * 4, "word " * 30_000, "    wide", "--- ... !!!"]
    texts += [" ".join(rng.choice(names[:6]) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[7], (7, "another text of one id"), (None, "no id here"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "s", "t", "i") for i, t in rows], SCHEMA).repartition(3).cache()


def plain_runs(words, least, power):
    out = set()
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q) and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "power"), [(6, 4), (2, 2), (1, 3), (9, 3)])
def test_runs_of_random_words(least, power):
    rng = random.Random(least)
    for _ in range(600):
        n, kinds = rng.randrange(0, 70), rng.choice([1, 2, 3, 5, 30])
        words = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.6:
            at, p = rng.randrange(n), 1 + rng.randrange(8)
            words = words[:at] + [words[at + (i - at) % min(p, n - at)] for i in range(at, n)]
        assert word_runs.runs_of(np.array(words, np.int32), least, power) == plain_runs(words, least, power)


def test_runs_do_not_rest_on_hashes(monkeypatch):
    """Where all stretches have one hash, what is told still holds word by word."""
    monkeypatch.setattr(word_runs, "BASE", 0)
    words = np.array([0, 1, 2] * 20 + [7] + [0, 1, 2, 4] * 9, np.int32)
    found = word_runs.Stretch(words)
    for i, q in ((0, 3), (30, 3), (61, 4), (65, 4)):
        start, end = found.repeats(i, q)
        assert (words[start : end - q] == words[start + q : end]).all() and start <= i and end >= i + q
        assert (start == 0 or words[start - 1] != words[start - 1 + q]) and (end == len(words) or words[end] != words[end - q])


def plain_digest(words):
    found = plain_runs(words, 6, 4)
    dropped, best = set(), None
    for s, n, q in found:
        dropped |= set(range(s + q, s + n))
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    rest = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, rest)))


def altered(key, words):
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_word_runs(docs, rows):
    for alter, change in ((None, lambda key, words: words), (word_runs.planted, altered)):
        found = word_runs.digest(word_runs.find(docs, alter=alter)).collect()
        short = [(i, t) for i, t in rows if len(t or "") < 100_000]
        want = Counter((i, *plain_digest(change(i, words_of(t)))) for i, t in short)
        assert Counter(tuple(r) for r in found if r.doc_id != 15) == want
        assert sum(r.doc_id == 15 for r in found) == 1
    long = word_runs.find(docs.where("doc_id = 15")).first()
    assert [tuple(r) for r in long.runs] == [(0, 30_000, 1)] and long.collapsed == "word" and long.n_words == 30_000
    assert word_runs.digest(word_runs.find(docs.limit(0))).count() == 0


def plain_fingerprint(text):
    words = words_of((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    """The smallest place reachable from each value by links of at most two bits."""
    out = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(values):
            low = min(out[j] for j, y in enumerate(values) if (x ^ y).bit_count() <= 2)
            if low < out[i]:
                out[i], changed = low, True
    return out


def test_simhash(docs, rows, monkeypatch):
    monkeypatch.setattr("thicket.llm.word_runs.GROUP_BYTES", 1 << 12)
    found = simhash.join(docs).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    labels = plain_components(prints)
    least = {c: min((i for (i, _), own in zip(rows, labels) if own == c and i is not None), default=None) for c in labels}
    want = Counter((i, format(p, "016x"), least[c]) for (i, _), p, c in zip(rows, prints, labels))
    assert Counter(tuple(r) for r in found) == want
    assert simhash.join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("long", [2048, 3])
def test_components_of_fingerprints(spark, monkeypatch, long):
    """Chains and balls of fingerprints; with long lists split, and looked through by flipped bits."""
    monkeypatch.setattr(simhash, "LONG", long)
    rng = random.Random(long)
    values = {rng.getrandbits(64) for _ in range(150)}
    for seed in list(values)[:12]:
        at = seed
        for _ in range(8):
            at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
            values.add(at)
        values |= {seed ^ (b << 16) for b in rng.sample(range(1 << 16), 12)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    tables = simhash.Scratch()
    found = {r.node: r.component for r in simhash.near(spark.createDataFrame([(v,) for v in signed], "fp long"), tables).collect()}
    labels = plain_components(values)
    groups = {}
    for v, c in zip(signed, labels):
        groups.setdefault(c, set()).add(v)
    got = {}
    for v in signed:
        got.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def plain_search(items, rows, k):
    terms = [(d, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))) for d, t in rows]
    terms = [(d, c) for d, c in terms if c]
    n, words = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for key, text in items:
        asked = Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
        scores = []
        for d, c in terms:
            m = 25 + (75 * sum(c.values()) * n) // words
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score:
                scores.append((-score, d is None, d or 0))
        out += [(key, i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return out


ITEMS = [(1, "w1 w2 W3 w3 don't 日本"), (2, None), (3, ""), (4, "no such thing"), (5, "w0 w0 w0 w1 w2 w3 w4 w5 é x 1"), (5, "tail"), (None, "another text"), (6, "É w39 w38"), (7, "one")]


def test_ranked_search(spark, docs, rows, monkeypatch):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    for k, at_once, block in ((10, 512, 1 << 20), (3, 2, 60)):
        monkeypatch.setattr(ranked_search, "DOCS", at_once)
        monkeypatch.setattr(ranked_search, "ITEMS", at_once)
        monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
        found = ranked_search.search(items, docs, k=k).select("item_id", "rank", "doc_id", "score").collect()
        assert Counter(tuple(r) for r in found) == Counter(plain_search(ITEMS, rows, k))
    assert ranked_search.search(items, docs.limit(0)).count() == 0 and ranked_search.search(items.limit(0), docs).count() == 0


def test_thresholds_prune_terms():
    """A common term's bound is below the threshold a rare term seeds, so it makes no candidates."""
    wanted = ranked_search.Items([(1, "rare common")])
    highest, kth = np.zeros(2, np.int64), np.zeros(2, np.int64)
    rare, common = wanted.names.index(b"rare"), wanted.names.index(b"common")
    highest[[rare, common]], kth[[rare, common]] = (1000, 100), (900, 90)
    plan = ranked_search.Plan(wanted, highest, kth)
    (_, terms, matrix), = plan.blocks
    assert plan.threshold[0] == 900 and plan.rest[0] == 100
    assert matrix[terms.tolist().index(rare), 0] == 1 and matrix[terms.tolist().index(common), 0] == 0


def test_on_driver_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    asked = [(r.item_id, r.text) for r in items.collect()][:10]
    got = ranked_search.search(items.where(F.col("item_id").isin([i for i, _ in asked])), docs).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == Counter(plain_search(asked, rows, 10))
