"""Operator 5: secret scans by rules and a character convolutional network.

Rules give base spans: assignments to secret-like names, access keys and long hexadecimal runs.  Every candidate, in a
base span or not (a run of 16 or more characters of ``[A-Za-z0-9+/_=-]`` with a digit in it), is scored with its
surroundings by a small convolutional network written in numpy: character embeddings, one convolution, maxima over the
candidate and over its context, a logistic output.  Long candidates are scored in overlapping windows, the highest
counts.  The network is trained on labelled findings of all documents, a sample bounded by ``max_findings`` a label:
candidates in base spans are secrets; numbers, dates, words joined by signs, paths and addresses are none; all others
have no label and aren't learnt from.  As many generated findings of public formats come on top.  The output is
calibrated on findings held out (Platt scaling) and cut at the highest threshold that keeps ``recall`` of the held-out
secrets.  Candidates above it become ``model`` spans beside the base ones.

Defined results: null and empty texts have no spans; repeated rows are scanned each; ids of any type, null included, are
carried as they are; texts are scanned whole; spans at one place go by kind; scores at the threshold count; without any
labelled finding the generated ones alone train the network; an empty table gives an empty result; extra columns are
ignored.  Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hash_sample, ship, stored
from .textkit import slices

KINDS = ("assign", "access", "hex", "model")
#: The rules: fixed patterns and least lengths.
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ASSIGN_LEAST = 6
#: Findings of either label that the fit reads at most, and the recall that the threshold keeps.
FIT_FINDINGS, RECALL = 1500, 0.98
#: Characters before, inside and after a window; windows that are scored at once.
BEFORE, INSIDE, AFTER, WINDOWS = 20, 48, 12, 4096
#: What is no secret: numbers and dates, and words and short numbers joined by signs.
PLAIN = re.compile(r"[0-9_+/=-]+|[_+/=-]*(?:[A-Za-z]{2,14}|[0-9]{1,4})(?:[_+/=-]+(?:[A-Za-z]{2,14}|[0-9]{1,4}))+[_+/=-]*")
ADDRESS = re.compile(r"(?:://|www\.|@)\S*$")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' spans, sorted.

    A run shorter than the least length can't hold a longer match, so the lengths are part of the last two patterns;
    an assignment whose value is too short is consumed and dropped.
    """
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text)]
    found += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(CANDIDATE, text) if any("0" <= c <= "9" for c in m.group())]


def _alphabet() -> np.ndarray:
    """Character codes below 128 to classes: letters and digits each, white space, other signs each; 0 is padding."""
    table = np.zeros(128, np.int64)
    table[33:127] = np.arange(2, 96)
    table[:33] = 1
    return table


_TABLE = _alphabet()
CLASSES = 97


def label(text: str, start: int, end: int, base: list[tuple[int, int, int]]) -> int | None:
    """1 for a candidate in a base span, 0 for one that is known to be none, else nothing."""
    if any(a < end and start < z for a, _, z in base):
        return 1
    return 0 if PLAIN.fullmatch(text, start, end) or ADDRESS.search(text, max(0, start - 60), start) else None


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Classes of a candidate and its surroundings, a row for each window of the candidate; windows overlap by half."""
    codes = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = lambda c: np.where(c < 128, _TABLE[np.minimum(c, 127)], 96).astype(np.uint8)
    inside = kind(codes(text[start:end]))
    begin = np.unique(np.minimum(np.arange(0, max(1, len(inside) - INSIDE // 2), INSIDE // 2), max(0, len(inside) - INSIDE)))
    out = np.zeros((len(begin), BEFORE + INSIDE + AFTER), np.uint8)
    before, after = kind(codes(text[max(0, start - BEFORE) : start])), kind(codes(text[end : end + AFTER]))
    out[:, BEFORE - len(before) : BEFORE] = before
    at = begin[:, None] + np.arange(INSIDE)
    out[:, BEFORE : BEFORE + INSIDE] = np.where(at < len(inside), inside[np.minimum(at, len(inside) - 1)] if len(inside) else 0, 0)
    out[:, BEFORE + INSIDE : BEFORE + INSIDE + len(after)] = after
    return out


class CharNet:
    """Embedding, convolution, ReLU, maxima over candidate and context, logistic output."""

    def __init__(self, dim: int = 8, filters: int = 24, width: int = 5, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.width = width
        self.e = rng.normal(0, 0.3, (CLASSES, dim))
        self.e[0] = 0
        self.k = rng.normal(0, 0.3 / np.sqrt(width), (width * dim, filters))
        self.kb = np.zeros(filters)
        self.w = rng.normal(0, 0.2, 2 * filters)
        self.b = 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        n, length = x.shape
        out = length - self.width + 1
        emb = self.e[x]
        cols = np.stack([emb[:, j : j + out] for j in range(self.width)], 2).reshape(n * out, -1)
        act = np.maximum(cols @ self.k + self.kb, 0).reshape(n, out, -1)
        inner = slice(BEFORE, BEFORE + INSIDE - self.width + 1)
        a, c = act[:, inner], np.concatenate([act[:, : BEFORE], act[:, BEFORE + INSIDE - self.width + 1 :]], 1)
        pool = np.concatenate([a.max(1), c.max(1)], 1)
        return cols, act, a, c, pool, pool @ self.w + self.b

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 1024])[5] for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logit(x) + self.shift, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, rate: float = 0.05, batch: int = 64, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        moments = None
        dim, filters = self.e.shape[1], len(self.kb)
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                cols, act, a, c, pool, z = self._forward(x[at])
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
                gp = np.outer(g, self.w)
                ga, gc = np.zeros_like(a), np.zeros_like(c)
                np.put_along_axis(ga, a.argmax(1)[:, None], gp[:, None, :filters], 1)
                np.put_along_axis(gc, c.argmax(1)[:, None], gp[:, None, filters:], 1)
                gact = np.concatenate([gc[:, :BEFORE], ga, gc[:, BEFORE:]], 1) * (act > 0)
                flat = gact.reshape(-1, filters)
                gcols = (flat @ self.k.T).reshape(len(at), act.shape[1], self.width, dim)
                ge = np.zeros_like(self.e)
                for j in range(self.width):
                    np.add.at(ge, x[at][:, j : j + act.shape[1]].ravel(), gcols[:, :, j].reshape(-1, dim))
                ge[0] = 0
                grads = [ge, cols.T @ flat, flat.sum(0), pool.T @ g, np.array(g.sum())]
                params = [self.e, self.k, self.kb, self.w, np.array(self.b)]
                moments = moments or [(np.zeros_like(p), np.zeros_like(p)) for p in params]
                step += 1
                for i, (p, d, (m, v)) in enumerate(zip(params, grads, moments, strict=True)):
                    m += 0.1 * (d - m)
                    v += 0.01 * (d * d - v)
                    move = rate * 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                    if i < 4:
                        p -= move
                    else:
                        self.b -= float(move)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out findings, then the highest threshold that keeps ``recall`` of the secrets."""
        z = self.logit(x)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))
            self.scale -= 0.1 * float(((p - y) * z).mean() / max(1e-3, float((z * z).mean())))
            self.shift -= 0.1 * float((p - y).mean())
        self.scale = max(self.scale, 1e-3)
        p = np.sort(self.probability(x)[y == 1])
        if len(p):
            self.threshold = float(p[int((1 - recall) * len(p))])


def generated(n: int, seed: int = 3) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Findings of public formats: random keys and tokens as secrets; numbers, words, dates, paths, identifiers as none."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    words = ["the", "report", "of", "value", "page", "in", "order", "note", "see", "der", "und", "les", "para", "item"]
    text = lambda k: " ".join(words[i] for i in rng.integers(0, len(words), k))
    secret = [
        lambda: "ghp_" + pick(low + up + dig, 36), lambda: "sk-" + pick(low + up + dig, 40), lambda: pick(low + up + dig + "+/", 40), lambda: pick("0123456789abcdef", 40),
        lambda: "AKIA" + pick(up + dig, 16), lambda: "eyJ" + pick(low + up + dig + "-_", 60), lambda: "xoxb-" + pick(dig, 12) + "-" + pick(low + up + dig, 24), lambda: pick(up + dig, 32),
    ]
    plain = [
        lambda: pick(dig, int(rng.integers(16, 20))), lambda: "-".join([pick(dig, 4)] * 2 + [pick(dig, 4), pick(dig, 4)]), lambda: "/" + "/".join(pick(low, 6) for _ in range(3)) + pick(dig, 2),
        lambda: pick(low, 14) + pick(dig, 2), lambda: "20" + pick(dig, 2) + "-0" + pick(dig, 1) + "-1" + pick(dig, 1) + "T" + pick(dig, 6), lambda: "_".join(pick(low, 5) for _ in range(3)) + "_" + pick(dig, 1),
        lambda: pick(low, 1).upper() + pick(low, 15) + pick(dig, 1), lambda: "=" * 20 + pick(dig, 1), lambda: "-".join(words[i] for i in rng.integers(0, len(words), 4)) + "-" + pick(dig, 2),
    ]
    lead = ["key: ", "auth=", "bearer ", "export TOKEN=", " ", "\n", '"', "id ", "no. ", "(", "ref "]
    out, y = [], []
    for i in range(n):
        kind = i % 2
        make = (secret if kind else plain)[int(rng.integers(0, len(secret if kind else plain)))]
        before = text(4) + " " + lead[int(rng.integers(0, len(lead)))]
        body = make()
        out.append((before + body + [" ", ".", '"', "\n"][int(rng.integers(0, 4))] + text(3), len(before), len(before) + len(body)))
        y.append(kind)
    return out, y


def _findings(most: int):
    """Labelled candidates with their surroundings; of either label a task gives those with the least hashes."""

    def run(batches):
        best: dict[int, list] = {0: [], 1: []}
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                for s, e in candidates(text):
                    y = label(text, s, e, base)
                    if y is not None:
                        e = min(e, s + 4 * INSIDE)  # an example is a few windows of it; scoring takes all
                        said = text[max(0, s - BEFORE) : e + AFTER]
                        h = int.from_bytes(hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")
                        best[y].append((h, y, said, min(s, BEFORE), min(s, BEFORE) + e - s))
            for y, rows in best.items():
                if len(rows) > 2 * most:
                    best[y] = sorted(set(rows))[:most]
        rows = [r for x in best.values() for r in sorted(set(x))[:most]]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["h", "y", "said", "begin", "end"])

    return run


def fit_net(docs: DataFrame, max_findings: int = FIT_FINDINGS, recall: float = RECALL) -> CharNet:
    """Train and calibrate on a hash-chosen sample of the labelled findings of all documents and as many generated ones."""
    ship(texts=True)
    found = stored(docs.select("text").mapInArrow(_findings(max_findings), "h long, y long, said string, begin long, end long"), "findings")
    rows, labels = [], []
    for y in (0, 1):  # at most max_findings short strings a label
        got = hash_sample(found.where(F.col("y") == y).dropDuplicates(["h"]), "h", max_findings).select("said", "begin", "end").collect()
        rows += [tuple(r) for r in got]
        labels += [y] * len(got)
    more, y = generated(max(1600, len(rows)))
    rows, labels = rows + more, np.array(labels + y, float)
    windows = [encode(*r) for r in rows]
    of = np.repeat(np.arange(len(rows)), [len(w) for w in windows])
    x = np.concatenate(windows)
    held = np.random.default_rng(13).random(len(rows)) < 0.25
    net = CharNet()
    net.train(x[~held[of]], labels[of[~held[of]]])
    net.calibrate(x[held[of]], labels[of[held[of]]], recall)
    return net


def _scan(shared):
    def run(batches):
        net = CharNet()
        net.__dict__.update(shared.value)
        blank = hashlib.sha256(b"").hexdigest()
        for b in slices(batches):
            texts = b.column("text").fill_null("")
            # a linear-time engine first finds the texts in which the patterns can match at all
            hints = [
                pc.match_substring_regex(texts, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), pc.match_substring(texts, "AKIA"),
                pc.match_substring_regex(texts, "[0-9a-f]{24}"), pc.match_substring_regex(texts, r"[0-9][A-Za-z0-9+/_=-]{7}|[A-Za-z0-9+/_=-]{8}[0-9]"),
            ]
            some = np.flatnonzero(np.any([h.to_numpy(zero_copy_only=False) for h in hints], axis=0))
            n = b.num_rows
            counts, base, spans = np.zeros((4, n), np.int64), [blank] * n, [""] * n
            windows, of = [], []
            best: dict[tuple[int, int, int], float] = {}
            kept: dict[int, list] = {}

            def score():
                for key, p in zip(of, net.probability(np.concatenate(windows)), strict=True):  # noqa: B023
                    best[key] = max(best.get(key, 0.0), p)  # noqa: B023

            for i in some.tolist():
                text = texts[i].as_py()
                kept[i] = base_spans(text)
                for s, e in candidates(text):
                    rows = encode(text, s, e)
                    for a in range(0, len(rows), WINDOWS):
                        windows.append(rows[a : a + WINDOWS])
                        of += [(i, s, e)] * len(windows[-1])
                        if len(of) >= WINDOWS:
                            score()
                            windows, of = [], []
            if of:
                score()
            for i, rules in kept.items():
                base[i] = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rules).encode()).hexdigest()
            for (i, s, e), p in best.items():
                if p >= net.threshold:
                    kept[i].append((s, 3, e))
            for i, rows in kept.items():
                rows.sort()
                spans[i] = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)
                for _, k, _ in rows:
                    counts[k, i] += 1
            cols = [b.column("doc_id"), *(pa.array(c) for c in counts[:3]), pa.array(base), pa.array(spans), pa.array(counts[3])]
            yield pa.record_batch(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return run


def scan_secrets(docs: DataFrame, net: CharNet) -> DataFrame:
    """Spans of every document; no shuffle, the network (a few thousand numbers) is broadcast."""
    ship(texts=True)
    shared = docs.sparkSession.sparkContext.broadcast(dict(net.__dict__))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long"
    return docs.select("doc_id", "text").mapInArrow(_scan(shared), schema)


def op5_char_cnn_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs, fit_net(docs))
