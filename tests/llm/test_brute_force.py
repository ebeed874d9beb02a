"""Operators that SQL does not express, held against plain Python on small tables."""

import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline
from thicket.llm import kernels, ogg, secret_scan, token_counts, toxicity, unigram

public = pytest.importorskip("public_tokenizers")
PIECES = ["▁", " ", "  ", "\n", "\t", "\r\n", "a", "the", "Word", "é", "日本", "\U0001f600", "'s", "123", "-", ".", "ﬁ", "\u00a0", "<s>", "</s>", "<unk>", "<0x41>", "⁇", "\u200b", "0", "Ａ"]


def odd_texts(n, seed=1, pieces=PIECES):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(pieces, int(rng.integers(0, 14)))) for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    texts = odd_texts(10_000)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in token_counts.count(docs, path, limit=8, frequent_rows=16).collect()}
    for i, ids in enumerate(library.encode(texts)):
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (len(ids), len(texts[i].encode()), len(ids) > 8), texts[i]


def test_common_rows_are_the_highest(spark):
    n = [1, 1, 2, 3, 3, 3, 50, 51, 900, 10_000]
    counts = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "h long, n long")
    for most in range(12):
        own = sorted((r.n for r in kernels.commonest(counts, most).collect()), reverse=True)
        assert len(own) <= most and own == sorted(n, reverse=True)[: len(own)]
    assert kernels.commonest(counts, 100).count() == 10


def plain_base(text):
    found = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m.group(2)) >= 6 and all(c.isascii() for c in m.group(1)):
            found.append((m.start(), "assign", m.end()))
    found += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


@pytest.mark.parametrize("shortest", [12, 20, 40])
def test_secret_spans_equal_a_plain_scan(spark, documents, shortest):
    pieces = ["password", "PassWd", "api_key", "apikey", "toKen", "secret", "='", " = ", ": ", ":", "\"", " ", "abc123", "hunter2", "AKIA", "IOSFODNN7EXAMPLE", "deadbeef", "0123456789abcdef", "é", "\u017fecret", "Zx9", "qWe7Rt5Yu1Io", "+/=", "\n", "the"]
    texts = [r.text or "" for r in documents.collect()] + odd_texts(3000, 2, pieces)
    models = secret_scan.Models.fit([*secret_scan.random_strings(4000), *secret_scan.identifiers(["alpha", "beta", "gamma", "request", "handler", "document"] * 20)], [1] * 4000 + [0] * 240)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    added = 0
    for r in secret_scan.digest(secret_scan.scan(docs, models=models, shortest=shortest)).collect():
        text, base = texts[r.doc_id], plain_base(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), text
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, x, _ in base) for k in ("assign", "access", "hex"))
        runs = [(m.start(), m.end()) for m in re.finditer(f"[{re.escape(secret_scan.ALPHABET)}]{{{shortest},}}", text)]
        random = []
        for a, b in runs:
            parts = [(a, b)] if models.score(text[a:b]) > models.threshold else [(a + m.start(), a + m.end()) for m in re.finditer(f"[^-_/=]{{{shortest},}}", text[a:b])]
            random += [(x, "markov", y) for x, y in parts if models.score(text[x:y]) > models.threshold and not any(u < y and x < v for u, _, v in base)]
        added += len(random)
        want = sorted(base + random, key=lambda x: (x[0], secret_scan.KINDS.index(x[1])))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, k, b in want)
    assert added > 0


def test_grades_equal_plain_scores(spark, documents):
    texts = [r.text or "" for r in documents.limit(150).collect()] + odd_texts(200, 3) + ["", "same same same"]
    words = sorted({w for t in texts for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.lower())})
    rng = np.random.default_rng(5)
    named = [(w, 0) for w in words[::3]] + [(w[:5], 5) for w in words[::7] if len(w.encode()) > 5 and w[:5].isascii()]
    hashes = {}
    for w, kind in dict.fromkeys(named):
        data = np.frombuffer(w.encode(), np.uint8)
        hashes[int(kernels.span_hashes(data, np.array([0]), np.array([len(data)]))[0]) ^ kind] = (w, kind)
    order = np.array(sorted(hashes), np.uint64)
    weights, cuts = rng.normal(size=len(order)), np.array([0.4, 1.7])
    model = toxicity.Model(order, weights, cuts, 0.6)
    docs = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in toxicity.grade(docs, model).collect():
        own = re.findall(rb"[0-9A-Za-z\x80-\xff]+", texts[r.doc_id].lower().encode())
        score = sum(x for h, x in zip(order.tolist(), weights) if (hashes[h][0].encode() in own if hashes[h][1] == 0 else any(len(w) > 5 and w[:5] == hashes[h][0].encode() for w in own)))
        over = [1 / (1 + math.exp(c - score)) for c in cuts]
        assert r.severity == pytest.approx(sum(over)) and r.p_toxic == pytest.approx(over[0]) and r.rejected == (over[0] >= 0.6)
        assert r.grade == int(np.argmax([1 - over[0], over[0] - over[1], over[1]]))


def plain_ogg(data):
    """Packets by stream, of pages whose checksum is worked out bit by bit."""
    streams, waiting, at = {}, {}, 0
    while at < len(data):
        assert data[at : at + 4] == b"OggS"
        serial, _, crc, n = struct.unpack_from("<IIIB", data, at + 14)
        table = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(table)
        own = 0
        for byte in data[at : at + 22] + bytes(4) + data[at + 26 : end]:
            own ^= byte << 24
            for _ in range(8):
                own = ((own << 1) ^ 0x04C11DB7 if own & 0x80000000 else own << 1) & 0xFFFFFFFF
        assert own == crc
        body = at + 27 + n
        for lace in table:
            waiting[serial] = waiting.get(serial, b"") + data[body : body + lace]
            body += lace
            if lace < 255:
                streams.setdefault(serial, []).append(waiting.pop(serial))
        at = end
    assert not waiting
    return streams


def test_media_equal_a_plain_reader(spark):
    texts = [None, "", "a", "x" * 63, "x" * 64, "é" * 40, "lorem ipsum " * 700, *odd_texts(30, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    values = {r.doc_id: bytes(r.media) for r in ogg.stored(docs).collect()}
    for r in ogg.features(ogg.stored(docs)).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        packets = sorted(plain_ogg(values[r.doc_id]).values(), key=len)
        assert b"".join(packets[1][1:]) == payload and len(packets[0]) == 1 and int.from_bytes(packets[0][0], "little") == len(data)
        x = [b - 128 for b in payload]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(values[r.doc_id]), hashlib.sha256(values[r.doc_id]).hexdigest())
        assert r.feature == f"streams=2;packets={-(-len(payload) // ogg.PACKET)};seconds={len(payload) / ogg.RATE:.6f};mean={sum(x) / len(x):.4f};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.4f};turns={turns / len(x):.6f}"


def test_stages_equal_plain_forms(spark, sf, documents):
    docs = documents.limit(120).cache()
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.grade(docs, model).collect() if r.rejected}
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()} == set(rows) - rejected

    def shingles(text):
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    own = {d: shingles(r.text) for d, r in rows.items()}
    root = {d: d for d in own}

    def find(d):
        return d if root[d] == d else find(root[d])

    for a in own:
        for b in own:
            if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} == {d for d in own if find(d) == d}

    models = secret_scan.fitted(docs)
    spans = {r.doc_id: [(s.start, s.end) for s in r.found] for r in secret_scan.scan(docs, models=models).collect()}
    for r in corpus_pipeline.mask_secrets(spark, docs, sf).collect():
        out, at = "", 0
        for a, b in spans[r.doc_id]:
            if a >= at:
                out += rows[r.doc_id].text[at:a] + "[secret]"
            at = max(at, b)
        assert r.text == out + rows[r.doc_id].text[at:] and r.n_chars == len(r.text)

    path = public.path("piece_bpe_32k.model")
    vocabulary = unigram.Vocabulary.read(path)
    for r in corpus_pipeline.encode(spark, docs.limit(10), sf).collect():
        ids = []
        for line in re.split("(\n)", " " + rows[r.doc_id].text.replace("▁", " ")):
            for word in [line] if line == "\n" else re.findall(" +[^ ]*|[^ ]+", line):
                ids += vocabulary._alone(word.encode())[0].tolist()
        assert r.ids == ids and r.restored
