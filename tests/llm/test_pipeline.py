"""The pipeline against a brute-force version of each of its stages on the smallest tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from girder.llm import bpe, mixing, simhash, toxicity
from girder.llm.common import table
from tests.conftest import DATA
from tests.llm.test_operators import docs


def slow_bits(text):
    """256 majority bits of the distinct five-word shingles, in plain integers."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    hashes, out, top = [xxhash.xxh64_intdigest(g, 42) for g in grams], 0, 2**64 - 1
    for k in range(4):
        seen = []
        for h in hashes:
            if k:
                h = (h + k * 0x9E3779B97F4A7C15) & top
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & top
                h = (h ^ h >> 27) * 0x94D049BB133111EB & top
                h ^= h >> 31
            seen.append(h)
        out = out << 64 | sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in seen) > len(seen))
    return out.to_bytes(32, "big")


def brute_near(texts):
    """Smallest id reachable through pairs of few enough differing bits, whatever bytes they share."""
    index = simhash.texts_alike()
    fps = {i: np.frombuffer(slow_bits(t), dtype=np.uint8) for i, t in texts.items()}
    label = {i: i for i in fps}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= index.bits:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, model = docs.columns, toxicity.fit(docs, table(spark, DATA, "labels"))
    before = [r.asDict() for r in docs.collect()]
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, DATA).cache()
        rows = [r.asDict() for r in out.collect()]
        if name != "bpe":
            assert out.columns == columns
        if name == "toxicity":
            want = {r["doc_id"] for r in before if model.above((r["text"] or "").encode())[0] < toxicity.REJECT_AT}
        elif name == "exact_dedup":
            first = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
                first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
            want = set(first.values())
        elif name == "simhash_near_dedup":
            want = set(brute_near({r["doc_id"]: r["text"] for r in before}).values())
        elif name == "mix_sources":
            count = Counter(r["doc_id"] for r in rows)
            size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in before}
            source = {r["doc_id"]: r["source"] for r in before}
            totals = Counter()
            taken = Counter()
            for i, n in size.items():
                totals[source[i]] += n
                taken[source[i]] += n * count[i]
            ranked = sorted(totals)
            target = mixing.share_targets(dict(totals), {s: i % 3 + 1 for i, s in enumerate(ranked)})
            largest = max(size.values())
            assert max(count.values()) <= 3 and all(abs(taken[s] - target[s]) <= largest for s in totals)
            want = set(count)
        else:
            enc = bpe.TrieBPE(bpe.vocabulary())
            ids = {r["doc_id"]: enc.encode(r["text"] or "") for r in before}
            assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in rows) == sorted((r["doc_id"], len(ids[r["doc_id"]]) // 4, hashlib.sha256(ids[r["doc_id"]]).hexdigest()) for r in before)
            assert np.isin(len(rows), [len(before)])
            break
        assert {r["doc_id"] for r in rows} == want, name
        docs, before = out, rows


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_stages_keep_rows_of_null_and_repeated_ids(spark):
    """Each stage decides by row: rows without an id stay, and rows that share one are told apart."""
    rng = random.Random(5)
    fresh = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    a, b, c, d, e = (fresh() for _ in range(5))
    rows = [(None, a, "x"), (None, b, "x"), (7, c, "x"), (7, c, "x"), (8, d, "y"), (8, e, "y"), (None, e, "y"), (None, a, None)]
    made = docs(spark, rows)
    texts = lambda out: sorted((r.text, -1 if r.doc_id is None else r.doc_id) for r in out.collect())
    whole = sorted((t, -1 if i is None else i) for i, t, _ in rows)
    once = sorted([(a, -1), (b, -1), (c, 7), (d, 8), (e, 8)])
    assert texts(corpus_pipeline.drop_toxic(spark, made, DATA)) == whole
    assert texts(corpus_pipeline.drop_exact(spark, made, DATA)) == once
    assert texts(corpus_pipeline.drop_near(spark, made, DATA)) == once
    mixed = mixing.mix(made, F.array("source")).collect()
    want = Counter()
    for r in mixed:
        want[r.doc_id, r.members[0]] += r.copies
    got = Counter((r.doc_id, r.source) for r in corpus_pipeline.mix_sources(spark, made, DATA).collect())
    assert got == +want and any(i is None for i, _ in got)
    assert max(Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, docs(spark, [(7, c, "x")] * 4), DATA).collect()).values()) <= 12
    assert sorted(Counter(r.doc_id for r in corpus_pipeline.encode(spark, made, DATA).collect()).items(), key=str) == sorted(Counter(i for i, _, _ in rows).items(), key=str)


def test_stages_of_clashing_names_and_empty_tables(spark):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(3)]
    rows = [(1, texts[0], "x"), (2, texts[1], None), (3, texts[1].replace(" ", "\n"), "x"), (4, None, "y"), (5, "long " * 1_000_000, "y"), (6, texts[2], "y")]
    names = ["_score", "score", "copies", "severity", "toxic", "weak", "_copy", "key", "row", "_row", "rid", "id", "fp", "kept", "a.b", "Found"]
    made = docs(spark, rows).selectExpr("*", *(f"{i} AS `{n}`" for i, n in enumerate(names)))
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, made, DATA)
        got = out.collect()
        if name != "bpe":
            assert out.columns == made.columns
            assert all(r[n] == i for r in got for i, n in enumerate(names))
        ids = {r.doc_id for r in got}
        assert ids == {"exact_dedup": {1, 2, 4, 5, 6}, "simhash_near_dedup": {1, 2, 4, 5, 6}}.get(name, ids) and ids >= ({1, 6} if name != "mix_sources" else set())
        assert step(spark, made.limit(0), DATA).count() == 0
