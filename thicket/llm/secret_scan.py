"""Secret scans: fixed patterns, and Markov models of characters.

The fixed patterns (``BASE``) find assignments, access keys and long hexadecimal
strings. The method adds what no pattern names: a candidate is a run of at least
``shortest`` (``LEAST``) characters of ``[A-Za-z0-9+/_=-]`` that touches no base span. Two
Markov models of order 2 over characters, one of random strings and one of
ordinary identifiers, score it; its log-likelihood ratio per character must pass
a threshold that is set on labelled samples held out from training, so that at
most ``most_false`` of the ordinary ones pass. Where a run as a whole does not pass, its parts
between ``_``, ``-``, ``/`` and ``=`` are candidates of their own, so that a key behind an
identifier or in a path is not averaged away.

Labelled samples are (token, label): 1 random, 0 ordinary. By default they come
from ``samples``: random strings are drawn from a seeded generator in the
alphabets that keys use; ordinary ones are words of up to ``most_docs`` documents
(those with the smallest hash of their text), alone and joined as identifiers
are. That bound is the only sample; the scan covers every whole text.

Texts are scanned in their own rows: runs of key characters are found and scored in the
bytes of a batch at once, in time linear in them, and a pattern runs only on texts with one of its
fixed words or a run that is long enough. Nothing is shuffled but the training sample.

Defined cases: a null text is the empty one, without spans; repeated rows stay;
an empty table gives no rows (its models are trained on random strings and the
identifiers of ``ORDINARY``); other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.kernels import forget, gathered, groups, map_rows, spans, texts_of

# Fixed patterns, in the order in which kinds are listed; least length of the group that counts.
BASE = (
    ("assign", re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+", re.A), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+", re.A), 0, 24),
)
KINDS = ("assign", "access", "hex", "markov")
HEX = re.compile(r"[0-9a-f]{24}", re.A)
HINTS = ("passw", "secret", "token", "api_key", "apikey")
ORDINARY = ("request_handler", "getElementById", "user_account_settings", "max_retry_count", "application_configuration", "NotImplementedError", "content-type", "left_outer_join", "is_authenticated", "parse_arguments", "internationalization", "documentation")

#: Characters of the models: 26 lower, 26 upper, 10 digits, the rest one by one, and a class for what else a sample has.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
CODE = np.full(256, SIZE - 1, dtype=np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(SIZE - 1)
IN_RUN = CODE < SIZE - 1
#: Least length of candidates, of random strings in training, and of the samples that set the threshold.
LEAST = 12
#: Candidates within a run lie between these.
IN_PART = IN_RUN.copy()
IN_PART[[ord(c) for c in "_-/="]] = False


def base_spans(text: str, kinds: tuple[str, ...] = ("assign", "access", "hex")) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by kind."""
    found = []
    for kind, pattern, group, least in BASE:
        if kind not in kinds:
            continue
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


@dataclass
class Models:
    """Log-likelihood ratios of (two characters before, character), and the threshold per character."""

    ratio: np.ndarray
    threshold: float

    @classmethod
    def fit(cls, tokens: list[str], labels: list[int], most_false: float = 1e-3, prior: float = 0.5, least: int = LEAST) -> Models:
        """Trains on four of five samples of each label and sets the threshold on those of the fifth that have ``least`` characters, as candidates do: halfway from the highest ordinary to the lowest random ones."""
        tables, held = [], []
        for label in (0, 1):
            own = [t for t, l in zip(tokens, labels) if l == label]
            counts = np.zeros((SIZE + 1, SIZE + 1, SIZE))
            for i, token in enumerate(own):
                if i % 5 and token:
                    a, b, c = contexts(token)
                    np.add.at(counts, (a, b, c), 1.0)
            # Order 2, backed off to order 1 and that to a flat distribution.
            one = counts.sum(axis=0) + prior
            one /= one.sum(axis=1, keepdims=True)
            two = counts + 8.0 * one
            tables.append(np.log(two / two.sum(axis=2, keepdims=True)))
            held.append(own[::5])
        found = cls(tables[1] - tables[0], 0.0)
        low, high = ([found.score(t) for t in own if len(t) >= least] for own in held)
        ceiling, floor = np.quantile(low or [0.0], 1 - most_false), np.quantile(high or [2.0], 0.01)
        found.threshold = float(max(ceiling, (ceiling + floor) / 2, 0.0))
        return found

    def score(self, token: str) -> float:
        """Log-likelihood ratio per character."""
        return float(self.ratio[contexts(token)].mean()) if token else -1.0


def contexts(token: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = CODE[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]
    padded = np.concatenate([[SIZE, SIZE], code])
    return padded[:-2], padded[1:-1], code


def random_strings(n: int, seed: int = 11) -> list[str]:
    """Strings as keys have them: hexadecimal, base 36, base 62, base 64 with and without padding, of LEAST to 64 characters."""
    rng = np.random.default_rng(seed)
    sets = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[26:62], ALPHABET[:26] + "0123456789", ALPHABET[:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-"]
    out = []
    for i in range(n):
        chars = sets[i % len(sets)]
        out.append("".join(chars[k] for k in rng.integers(0, len(chars), int(rng.integers(LEAST, 65)))))
    return out


def identifiers(words: list[str], seed: int = 12) -> list[str]:
    """Words alone, and two or three of them joined in the ways of identifiers, paths and dates."""
    rng = np.random.default_rng(seed)
    out = list(words)
    for i, word in enumerate(words):
        other, third = (words[k] for k in rng.integers(0, len(words), 2))
        joined = ("_".join((word, other, third)), word + other.capitalize() + third.capitalize(), "-".join((word, other, third)).lower(), f"{word}_{rng.integers(0, 100)}", "/".join((word, other, third)), f"{rng.integers(0, 10**9)}{rng.integers(10**8, 10**9)}")
        out.append(joined[i % len(joined)])
    return out


def samples(docs: DataFrame, text_col: str = "text", most_docs: int = 2000, most_words: int = 20_000) -> tuple[list[str], list[int]]:
    """Labelled tokens, from a generator and from the words of at most most_docs documents without a base span's fixed words."""
    hashed = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).where("t IS NOT NULL")
    # The hashes alone are ordered; a second, pushed-down look takes the texts up to the last of them.
    last = hashed.select("h").distinct().orderBy("h").limit(most_docs).agg(F.max("h")).first()[0]
    rows = hashed.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]) if last is not None else hashed.limit(0)
    words: dict[str, None] = {}
    for row in rows.orderBy("h").collect():
        words |= dict.fromkeys(re.findall(r"[A-Za-z]{2,}", without(row.t, sorted(base_spans(row.t)), " ")))
    ordinary = identifiers([*ORDINARY, *list(words)[:most_words]])
    # Lower case, capitals and first capitals alike.
    ordinary += [w.upper() for w in ordinary[::3]]
    drawn = random_strings(max(4000, len(ordinary) // 4))
    return [*ordinary, *drawn], [0] * len(ordinary) + [1] * len(drawn)


def fitted(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None, most_rows: int = 200_000) -> Models:
    """Models from labelled (token, label), or from samples(docs). At most most_rows labelled rows are used."""
    if labelled is None:
        return Models.fit(*samples(docs, text_col))
    rows = labelled.select("token", "label").where("token IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("token"), "label").limit(most_rows).collect()
    return Models.fit([r.token for r in rows], [int(r.label) for r in rows])


def scores(models: Models, joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Models.score() of all byte strings joined[start:end]."""
    if not len(starts):
        return np.zeros(0)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    code = CODE[gathered(joined, starts, lengths)]
    before = np.concatenate([[SIZE], code[:-1]])
    before[firsts] = SIZE
    second = np.concatenate([[SIZE], before[:-1]])
    second[firsts] = SIZE
    return np.add.reduceat(models.ratio[second, before, code], firsts) / lengths


class Scanner:
    def __init__(self, models: Models, shortest: int = LEAST) -> None:
        self.models, self.shortest = models, shortest

    def is_random(self, joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), bool)
        for a, b in groups((ends - starts).tolist()):
            out[a:b] = scores(self.models, joined, starts[a:b], ends[a:b]) > self.models.threshold
        return out

    def candidates(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans of the runs that pass, and of the parts that pass in runs that do not, by start."""
        starts, ends = spans(IN_RUN[joined])
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        whole = self.is_random(joined, starts, ends)
        firsts, lasts = spans(IN_PART[joined])
        long = lasts - firsts >= self.shortest
        firsts, lasts = firsts[long], lasts[long]
        run = np.searchsorted(starts, firsts, side="right") - 1
        inner = ~whole[run] & (lasts - firsts < ends[run] - starts[run])
        firsts, lasts = firsts[inner], lasts[inner]
        part = self.is_random(joined, firsts, lasts)
        starts, ends = np.concatenate([starts[whole], firsts[part]]), np.concatenate([ends[whole], lasts[part]])
        order = np.argsort(starts)
        return starts[order], ends[order]

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans of each text in code points, by start, then kind as listed."""
        out: list[list[tuple[int, int, str]]] = []
        coded = [t.encode() for t in texts]
        for a, b in groups(map(len, coded)):
            joined = np.frombuffer(b"\n".join(coded[a:b]), np.uint8)
            starts, ends = self.candidates(joined)
            # Code points before each byte; one more place for a run that ends the batch.
            points = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])
            firsts = np.cumsum([0] + [len(c) + 1 for c in coded[a:b]])
            cuts = np.searchsorted(starts, firsts).tolist()
            for i in range(b - a):
                text, folded = texts[a + i], texts[a + i].lower()
                kinds = [kind for kind, hinted in (("assign", any(h in folded for h in HINTS)), ("access", "AKIA" in text), ("hex", HEX.search(text))) if hinted]
                found = base_spans(text, tuple(kinds)) if kinds else []
                own = slice(cuts[i], cuts[i + 1])
                if own.start < own.stop:
                    base = points[firsts[i]]
                    left, right = points[starts[own]] - base, points[ends[own]] - base
                    found += [(x, y, "markov") for x, y in clear(left, right, found)]
                out.append(sorted(found, key=lambda x: (x[0], KINDS.index(x[2]))))
        return out


def clear(left: np.ndarray, right: np.ndarray, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The spans [left, right) that touch none of found."""
    fixed = sorted(found)
    if fixed:
        begins = np.array([s for s, _, _ in fixed])
        # The furthest end of all that begin before: spans of several kinds may overlap.
        reach = np.concatenate([[0], np.maximum.accumulate([e for _, e, _ in fixed])])
        free = reach[np.searchsorted(begins, right)] <= left
        left, right = left[free], right[free]
    return list(zip(left.tolist(), right.tolist()))


def written_spans(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: Models | None = None, shortest: int = LEAST) -> DataFrame:
    """doc_id, found of each document: found lists (kind, start, end, value) of its spans, by start, then kind as listed."""
    held = docs.sparkSession.sparkContext.broadcast(models or fitted(docs, text_col))  # a table of fixed size
    id_type = docs.schema[id_col].dataType.simpleString()
    scanners: list[Scanner] = []
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not scanners:
            scanners.append(Scanner(held.value, shortest))
        texts = texts_of(batch, text_col)
        rows = [[{"kind": k, "start": s, "end": e, "value": t[s:e]} for s, e, k in found] for t, found in zip(texts, scanners[0].scan(texts))]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), pa.array(rows, pa.list_(span))], ["doc_id", "found"])

    return map_rows(docs.select(id_col, text_col), work, f"doc_id {id_type}, found array<struct<kind: string, start: long, end: long, value: string>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans of scan()'s rows."""

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redactor(docs: DataFrame, text_col: str = "text", models: Models | None = None, mark: str = "[secret]", shortest: int = LEAST):
    """A function of a text column that puts ``mark`` in the place of each span; a null stays null."""
    held = docs.sparkSession.sparkContext.broadcast(models or fitted(docs, text_col))

    @F.pandas_udf("string")
    def redacted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        scanner = Scanner(held.value, shortest)
        for texts in parts:
            out: list[str | None] = []
            for a, b in groups(0 if t is None else len(t) for t in texts):
                given = ["" if t is None else t for t in texts.iloc[a:b]]
                out += [None if t is None else without(t, found, mark) for t, found in zip(texts.iloc[a:b], scanner.scan(given))]
            yield pd.Series(out, dtype=object)
        forget()

    return redacted


def without(text: str, found: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
