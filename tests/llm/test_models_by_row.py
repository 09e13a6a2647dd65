"""The rows of op7 and op9 against versions that go through the documents in plain Python.

The two optimisers are compared with plain Python elsewhere; here it is what they are
given and what is made of it: features, contexts, grades, votes, counts, shapes, scores.
"""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from girder.llm import quality, toxicity
from tests.conftest import DATA


def tables(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.doc_id in docs and r.toxic is not None}
    return docs, labels


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


# --- op7 ---


def word_list(data):
    return re.findall(rb"[a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in data))


def features(word):
    return [word, b"^" + word[:5]] if len(word) > 5 else [word]


def telling(counts, share):
    """Features of (toxic, clean) contexts that are one-sided beyond chance, most telling first."""
    enough = {f: tc for f, tc in counts.items() if sum(tc) >= 3}
    out = []
    for f, (t, c) in enough.items():
        n = t + c
        gain = sum(k * math.log(k / (n * of)) for k, of in ((t, share), (c, 1 - share)) if k)
        if (t >= 0.9 * n or t <= 0.1 * share * n) and gain > math.log(max(2, len(enough))):
            out.append((-gain, f))
    return [f for _, f in sorted(out)][:toxicity.FEATURES]


def brute_toxicity(docs, labels):
    half = {i: xxhash.xxh64_intdigest(struct.pack("<q", i), 42) % 2 for i in labels}
    seen = defaultdict(set)
    for i, toxic in labels.items():
        words = word_list(docs[i])
        for before, w in zip([b"", *words], words, strict=False):
            for f in features(w):
                seen[f, before].add((half[i], toxic))
    both = defaultdict(lambda: [0, 0])
    halves = [defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])]
    for (f, _), marks in seen.items():
        for side in (1, 0):
            both[f][1 - side] += any((h, side) in marks for h in (0, 1))
            for h in (0, 1):
                halves[h][f][1 - side] += (h, side) in marks
    both = {f: tc for f, tc in both.items() if sum(tc) >= 3}
    share = sum(labels.values()) / len(labels)
    used = telling(both, share)
    spoken = [telling({f: tuple(halves[h][f]) for f in both if halves[h][f][0] >= 0.9 * sum(halves[h][f])}, share) for h in (0, 1)]
    count = {i: Counter(f for w in word_list(docs[i]) for f in features(w)) for i in docs}
    grade = dict(labels)
    for h in (0, 1):
        mine = [i for i in labels if labels[i] and half[i] == h]
        hits = {i: sum(count[i][f] for f in spoken[1 - h]) for i in mine}
        if mine:
            cuts = np.quantile(list(hits.values()), [1 / 3, 2 / 3])
            for i in mine:
                grade[i] += sum(hits[i] > c for c in cuts)
    ids = sorted(labels)
    place = {f: k for k, f in enumerate(used)}
    cells = [(r, place[f], math.log1p(n)) for r, i in enumerate(ids) for f, n in count[i].items() if f in place]
    rows, cols, vals = (np.array(x) for x in zip(*cells, strict=True))
    w, theta = toxicity.fit_ordinal(rows, cols, vals, np.array([grade[i] for i in ids]), len(used))
    out = {}
    for i in docs:
        z = sum(math.log1p(n) * w[place[f]] for f, n in count[i].items() if f in place)
        p = [sigmoid(z - t) for t in theta]
        out[i] = (sum(p), p[0])
    return out


def test_toxicity_by_row(spark):
    docs, labels = tables(spark)
    want = brute_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.query(spark, DATA).collect()}
    assert set(got) == set(docs) and len({round(s, 3) for s, _ in want.values()}) > 3
    for i, (severity, p) in want.items():
        assert abs(got[i].severity - severity) < 1e-4 and abs(got[i].p_toxic - p) < 1e-4
        assert got[i].toxic == (p >= toxicity.REJECT_AT) or abs(p - toxicity.REJECT_AT) < 1e-4


# --- op9 ---


def measures(data):
    words = data.split()
    n = len(words)
    odd = sum(chr(b) in "#%*&$^~|<>{}[]\\_=+@" for b in data) / max(1, len(data))
    top = max(Counter(words).values(), default=0) / max(1, n)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n)
    return words, n, odd, top, repeats


def brute_votes(data):
    words, n, odd, top, repeats = measures(data)
    distinct = len(set(words)) / max(1, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    ended = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines))
    pipes = words.count(b"|") / max(1, n)
    bad = (odd > 0.03, n >= 20 and top > 0.25, n >= 50 and distinct < 0.25, pipes > 0.1, n >= 10 and repeats > 0.2, ended < 0.1 and n >= 20, n < 3)
    good = (odd < 0.005, n >= 20 and top < 0.12, n >= 20 and distinct > 0.45, pipes == 0, n >= 10 and repeats < 0.02, ended > 0.6, n >= 30)
    return tuple(0 if b else 2 if g else 1 for b, g in zip(bad, good, strict=True))


def brute_shapes(data):
    words, n, odd, top, repeats = measures(data)
    place = lambda name: zlib.crc32(name) % quality.DIMENSIONS
    form = Counter(re.sub(rb"[0-9]+", b"9", re.sub(rb"[A-Za-z\x80-\xff]+", b"a", data)).split())
    out = {}
    for w, c in form.items():
        out[place(w)] = c / max(1, n)
    out |= {place(b"repeats"): repeats, place(b"top"): top}
    out[place(b"length")] = min(1.0, max(1, n) / 50)
    top_shown = out[place(b"top")]
    for name, value in (("odd", min(odd * 10, 1.0)), ("distinct", len(set(words)) / n if n >= 50 else 1.0), ("top", top_shown if n >= 20 else 0.0)):
        out[place(f"{name}{int(10 * value)}".encode())] = 1.0
    return out


def test_quality_by_row(spark):
    docs, _ = tables(spark)
    votes = {i: brute_votes(x) for i, x in docs.items()}
    tally = Counter(sum(v * 3**k for k, v in enumerate(vs)) for vs in votes.values())
    _, _, good = quality.estimate(np.array(sorted(tally)), np.array([float(tally[p]) for p in sorted(tally)]))
    weak = dict(zip(sorted(tally), good, strict=True))
    of = {i: float(weak[sum(v * 3**k for k, v in enumerate(vs))]) for i, vs in votes.items()}
    ids = sorted(docs)
    shape = {i: brute_shapes(docs[i]) for i in ids}
    rows, cols, vals = (np.array(x) for x in zip(*((r, c, v) for r, i in enumerate(ids) for c, v in shape[i].items()), strict=True))
    w, b = quality.fit_linear(rows, cols, vals, np.array([of[i] for i in ids]))
    got = {r.doc_id: r for r in quality.query(spark, DATA).collect()}
    assert set(got) == set(docs) and len(tally) > 5
    for i in ids:
        score = sigmoid(b + sum(w[c] * v for c, v in shape[i].items()))
        assert abs(got[i].weak - of[i]) < 1e-5 and abs(got[i].quality - score) < 1e-4
        assert got[i].keep == (score >= quality.KEEP_AT) or abs(score - quality.KEEP_AT) < 1e-4
