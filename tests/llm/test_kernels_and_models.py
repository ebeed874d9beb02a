"""Parts of the operators that need no Spark, against brute force."""

import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from thicket.llm import kernels, kmeans_tree, ngram_join, ogg, secret_scan, token_files, toxicity, unigram

public = pytest.importorskip("public_tokenizers")


def test_word_hashes_tell_words_apart():
    texts = ["a b  a\tc", "", "  ", "c a\x0bb", "x" * 50 + " y"]
    found = kernels.word_hashes([t.encode() for t in texts])
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert [len(f) for f in found] == [len(w) for w in words]
    ids = {}
    for f, w in zip(found, words):
        for h, x in zip(f.tolist(), w):
            assert ids.setdefault(x, h) == h
    assert len(set(ids.values())) == len(ids)


def test_long_text_hashes_as_a_short_one(monkeypatch):
    text = b"alpha beta gamma " * 400
    plain = kernels.word_hashes([text])[0]
    monkeypatch.setattr(kernels, "GROUP_BYTES", 256)
    assert (kernels.word_hashes([text])[0] == plain).all()


def test_table_finds_what_it_has():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    t = kernels.Table(h[:2000], np.arange(2000))
    t.add(h[2000:], np.arange(2000, len(h)))
    assert (t.get(h) == np.arange(len(h))).all() and (t.get(h + np.uint64(1)) == -1).all()


@pytest.mark.parametrize("n", [0, 1, 63, 700, 5000, 70000])
def test_rans_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, 40000).astype(np.int64)
    u, c = np.unique(ids, return_counts=True) if n else (np.array([3]), np.array([1]))
    coder = token_files.Frequencies.of(u, c).coder()
    block = coder.encode(ids, lanes=64, every=4096)
    assert (coder.decode(block) == ids).all()
    for a, b in ((0, n // 2), (n // 3, n), (n, n)):
        assert (coder.decode(block, a, b) == ids[a:b]).all()
    if n > 100:
        broken = bytearray(block)
        broken[-3] ^= 4
        with pytest.raises(ValueError):
            coder.decode(bytes(broken))


def test_frequencies_sum_and_keep_rare_ids():
    f = token_files.Frequencies.of(np.arange(200_000), np.r_[np.full(10, 10**9), np.ones(199_990)])
    assert f.freq.sum() == 1 << token_files.SCALE and f.freq.min() >= 1


def test_crc_of_joined_strings():
    x, y = b"one" * 77, b"two" * 1234
    assert token_files.crc_joined(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


ODD = ["", " ", "  a", "a  b", "a\n b", "\n\n", "it's a 'll x", "a  b 　c", "<|endoftext|> a", "x\u0085 y", "\x1c a", "é à\n\n\nü", "1 2 abc1 ²", "\U0001f600 x", ".", "a.b", "a'.b", "x\n\ny.", "a.\n b", "same same same"]


def test_tokenizer_units_give_the_librarys_ids():
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    ids, n = token_files.Tokenizer(path).encode(ODD)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(ODD, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_page_checksum_is_the_plain_one():
    data, crc = bytes(range(200)), 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    assert ogg.checksum(data) == crc


@pytest.mark.parametrize("lengths", [[3, 255, 510, 0, 65025, 65024, 200000, 1], [0], [65025], [64770, 7]])
def test_streams_come_apart_again(lengths):
    rng = np.random.default_rng(1)
    one = ogg.Stream(7, [rng.bytes(n) for n in lengths], list(range(len(lengths))))
    two = ogg.Stream(9, [b"x" * n for n in reversed(lengths)], list(range(len(lengths))))
    found = ogg.read(ogg.written([one, two]))
    assert found[7].packets == one.packets and found[9].packets == two.packets


def test_broken_or_missing_pages_are_refused():
    media = ogg.encoded(b"some text " * 20000)
    for broken in (media[:5000] + bytes([media[5000] ^ 1]) + media[5001:], media[:-40]):
        with pytest.raises(ValueError):
            ogg.read(broken)


def test_times_follow_granules():
    payload, n, samples, streams = ogg.decoded(ogg.encoded(b"z" * 300_000))
    spans = ogg.times(samples)
    assert n == 300_000 and streams == 2 and spans[0][0] == 0 and spans[-1][1] == len(payload) / ogg.RATE
    assert all(abs(a[1] - b[0]) < 1e-9 for a, b in zip(spans, spans[1:]))


def best_path(vocabulary, word):
    """All cuts of a short word, by recursion."""
    pieces = dict(zip(vocabulary.data, range(len(vocabulary.data))))
    score = dict(zip(vocabulary.data, [vocabulary.scores[i] for i in vocabulary.ids_of_pieces]))
    memo = {len(word): 0.0}
    for i in range(len(word) - 1, -1, -1):
        size = len(word[i:].decode(errors="ignore")[:1].encode()) or 1
        if (word[i] & 0xC0) == 0x80:
            memo[i] = -np.inf
            continue
        options = [score[word[i:j]] + memo[j] for j in range(i + 1, len(word) + 1) if word[i:j] in pieces]
        if word[i : i + size] not in pieces:
            options.append(vocabulary.unknown_score + memo[i + size])
        memo[i] = max(options)
    return memo[0]


def test_viterbi_is_the_best_path():
    pieces = [" ", "a", "b", "ab", " ab", "abc", "c", "bc", "aa", "é"]
    scores = [-3.0, -1.0, -1.2, -1.5, -2.0, -4.0, -1.1, -1.6, -1.4, -2.0]
    vocabulary = unigram.Vocabulary(pieces, scores, list(range(100, 356)))
    vocabulary.ids_of_pieces = list(range(len(pieces)))
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcé日"), 12)).encode() for _ in range(60)]
    words = [b" " + w for w in words]
    ids, n = vocabulary.solve(words)
    for word, own in zip(words, np.split(ids, np.cumsum(n)[:-1])):
        got = 0.0
        raw = 0
        for i in own.tolist():
            if i >= 100:
                raw += 1
            else:
                got += vocabulary.scores[i]
        got += vocabulary.unknown_score * (raw // 3)  # the one character without a piece has three bytes
        assert abs(got - best_path(vocabulary, word)) < 1e-9
        alone, _ = vocabulary._alone(word)
        assert abs(sum(vocabulary.scores[i] for i in alone.tolist() if i < 100) - sum(vocabulary.scores[i] for i in own.tolist() if i < 100)) < 1e-9


def test_decoding_gives_texts_back():
    encoder = unigram.Encoder(unigram.Vocabulary.read(public.path("piece_bpe_32k.model")))
    texts = [t for t in ODD if "▁" not in t]
    ids, n = encoder.encode(texts)
    assert encoder.vocabulary.decode(ids, n) == texts


def test_markov_models_tell_random_strings():
    words = "request handler account settings maximum retry application config window buffer stream reader parser document element".split() * 30
    tokens = [*secret_scan.identifiers(words), *secret_scan.random_strings(2000)]
    models = secret_scan.Models.fit(tokens, [0] * (len(tokens) - 2000) + [1] * 2000)
    fresh = secret_scan.random_strings(400, seed=99)
    assert np.mean([models.score(t) > models.threshold for t in fresh]) > 0.9
    assert not any(models.score(t) > models.threshold for t in ("request_handler_settings", "maximumRetryAccountWindow", "application-config-reader"))
    scanner = secret_scan.Scanner(models)
    text = "é call x8Kd92kPq0ZmL3vT7bNwR5yQ with token = 'abcdef123' and window_buffer_stream_reader"
    found = scanner.scan([text, ""])
    assert [(k, text[s:e]) for s, e, k in found[0]] == [("markov", "x8Kd92kPq0ZmL3vT7bNwR5yQ"), ("assign", "token = 'abcdef123")] and found[1] == []
    assert secret_scan.without(text, found[0], "[s]") == "é call [s] with [s]' and window_buffer_stream_reader"


def test_short_random_strings_are_scored():
    words = "request handler account settings maximum retry application config window buffer stream reader parser document element".split() * 30
    tokens = [*secret_scan.identifiers(words), *secret_scan.random_strings(4000)]
    assert min(map(len, secret_scan.random_strings(2000))) == secret_scan.LEAST
    scanner = secret_scan.Scanner(secret_scan.Models.fit(tokens, [0] * (len(tokens) - 4000) + [1] * 4000))
    rng = np.random.default_rng(4)
    for length in range(secret_scan.LEAST, 20):
        keys = ["".join(secret_scan.ALPHABET[k] for k in rng.integers(0, 62, length)) for _ in range(200)]
        found = scanner.scan([f"the key {k} of application" for k in keys])
        assert sum(f == [(8, 8 + length, "markov")] for f in found) > 160, length  # few words to train on; README has the figures of whole tables


def test_keys_behind_identifiers_and_in_long_texts():
    words = "request handler account settings maximum retry application config window buffer stream reader parser document element".split() * 30
    ordinary = secret_scan.identifiers([*secret_scan.ORDINARY, *words])
    tokens = [*ordinary, *[w.upper() for w in ordinary[::3]], *secret_scan.random_strings(4000)]
    scanner = secret_scan.Scanner(secret_scan.Models.fit(tokens, [0] * (len(tokens) - 4000) + [1] * 4000))
    rng = np.random.default_rng(6)
    keys = ["".join(secret_scan.ALPHABET[k] for k in rng.integers(0, 62, 24)) for _ in range(300)]
    for before, after in (("application_configuration_value_", ""), ("/window/reader/", "/stream"), ("é settings-", "=")):
        found = scanner.scan([f"{before}{k}{after}" for k in keys])
        # The part alone, or the whole run where that passes too.
        hit = [any(kind == "markov" and s <= len(before) and e >= len(before) + 24 for s, e, kind in f) for f in found]
        assert np.mean(hit) > 0.95
    text = "é " + " ".join("internationalization_of_documentation" for _ in range(250_000)) + " " + keys[0] + " end"
    began = time.process_time()
    assert scanner.scan([text]) == [[(len(text) - 28, len(text) - 4, "markov")]] and time.process_time() - began < 20


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 600)
    rows, columns = [], []
    for i, g in enumerate(grades):
        for f in range(g):
            rows.append(i)
            columns.append(f)
        rows.append(i)
        columns.append(2 + int(rng.integers(0, 3)))
    weights, cuts = toxicity.fit_ordinal(np.array(rows), np.array(columns), grades, 5)
    assert weights[:2].min() > 1 > np.abs(weights[2:]).max() and cuts[0] < cuts[1]
    model = toxicity.Model(np.zeros(0, np.uint64), weights, cuts)
    score = np.bincount(rows, weights=weights[columns], minlength=600)
    assert (np.diff([model.over(score[grades == g]).sum(axis=1).mean() for g in range(3)]) > 0.5).all()


def bucket_rows(own, buckets, threshold):
    rows = sorted((b, i) for i, bs in enumerate(buckets) for b in bs)
    n = [len(s) for s in own]
    columns = [pa.array([r[0] for r in rows]), *[pa.array([v(i) for _, i in rows], kind) for v, kind in ((lambda i: i, pa.int64()), (lambda i: i, pa.int64()), (lambda i: n[i], pa.int32()), (lambda i: 0, pa.int32()), (lambda i: -1, pa.int32()), (lambda i: ngram_join.sketch(own[i]), pa.binary()))]]
    return pa.RecordBatch.from_arrays(columns, list(ngram_join.Rows.names))


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(4)
    own = []
    for size in (3, 40, 130, 270, 520, 9000):
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        own += [np.unique(np.concatenate([rng.choice(base, max(1, int(len(base) * rng.uniform(0.8, 1))), replace=False), rng.integers(0, 2**63, int(rng.integers(0, 1 + size // 20)), dtype=np.uint64)])) for _ in range(12)]
    rows = ngram_join.Rows(bucket_rows(own, [[0]] * len(own), 80))
    i, j = np.triu_indices(len(own), 1)
    both = np.array([len(np.intersect1d(own[a], own[b])) for a, b in zip(i, j)])
    n = np.array([len(s) for s in own])
    assert (rows.apart(i, j) <= n[i] + n[j] - 2 * both).all()
    linked = 100 * both >= 80 * (n[i] + n[j] - both)
    passing = rows.passing(i, j, 80)
    assert linked.sum() > 60 and (passing | ~linked).all() and passing.sum() < 3 * linked.sum()
    found = {(int(a), int(b)) for x, y in ngram_join.all_pairs(rows, 80) for a, b in zip(np.minimum(x, y), np.maximum(x, y))}
    assert found == {(int(a), int(b)) for a, b, ok in zip(i, j, passing) if ok}


def test_hubs_tell_all_pairs_of_small_buckets_and_few_of_large_ones():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))
    own = [base[rng.permutation(100)[:98]] for _ in range(64)]
    buckets = [[0] if i < 60 else [1] for i in range(64)]
    rows = ngram_join.Rows(bucket_rows([np.sort(s) for s in own], buckets, 80))
    i, j = ngram_join.hub_pairs(rows, 80)
    small = {frozenset(p) for p in zip(i.tolist(), j.tolist()) if min(p) >= 60}
    assert small == {frozenset((a, b)) for a in range(60, 64) for b in range(60, a)}
    assert set(range(60)) <= set(i.tolist()) | set(j.tolist()) and len(i) <= 2 * 60 + 6


def test_groups_are_never_cut():
    rng = np.random.default_rng(8)
    keys = np.sort(rng.integers(0, 30, 500))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 37]), pa.array(np.arange(a, min(a + 37, 500)))], ["k", "v"]) for a in range(0, 500, 37)]
    seen, values = set(), []
    for group in ngram_join.groups_of(iter(batches), 1 << 62):
        own = set(group.column(0).to_pylist())
        assert not own & seen
        seen |= own
        values += group.column(1).to_pylist()
    assert values == list(range(500)) and seen == set(keys.tolist())


def test_tree_walk_gives_each_leaf_once():
    x = kmeans_tree.unit(np.random.default_rng(5).normal(size=(500, 8)))
    tree = kmeans_tree.Tree.fit(x, 20)
    order = list(tree.walk(x[0] @ tree.centres.T))
    assert sorted(order) == list(range(tree.leaves)) and set(tree.place(x)) <= set(order)
