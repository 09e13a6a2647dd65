"""Infill, centroids and licenses: brute-force versions, round trips and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from girder.llm import centroids, infill, licenses

# --- infill ---


def brute_cut(doc_id, text):
    """n, form, prefix, middle, output of a document."""
    t = text or ""
    units = [m[0] for m in re.finditer(infill.UNIT, t)]
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 50:
        return n, "plain", None, None, t
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_infill_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "one", "<P>a b", "a <M> b", "x<", "<S", "é\U0001f600 ß\n\tz  ", "word " * 30_000]
    texts += ["".join(rng.choice(["a", "bc", " ", "\n", "é", "\U0001f600", "<", "P>", " "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "no id here at all", -1), (7, "again and again", -2), (7, "again and again", -3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.Fim` int").withColumn("FIM", F.lit(1))
    out = infill.transform(df)
    assert out.columns == ["doc_id", "text", "a.Fim", "FIM", "fim_"]
    got = out.select("doc_id", "text", F.col("`a.Fim`").alias("at"), "fim_.*", infill.restore(F.col("fim_.output"), F.col("fim_.form")).alias("back")).collect()
    assert sorted(r["at"] for r in got) == sorted(r[2] for r in rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_cut(r.doc_id, r.text), r.at
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_infill_of_an_empty_table(spark):
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- centroids ---


def brute_clusters(rows, k=16):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(64 * float(x))) for x in v]))
    seeds = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)[:k]
    cents = [list(q) for _, q in seeds]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(3):
        at = [near(q)[1] for _, q in kept]
        cents = [[sum(q[d] for (_, q), a in zip(kept, at, strict=True) if a == n) // at.count(n) for d in range(64)] if n in at else c for n, c in enumerate(cents)]
    last = [near(q) for _, q in kept]
    inertia = [sum(d for d, n in last if n == m) for m in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, d, inertia[n], sum(inertia), sha[n]) for (i, _), (d, n) in zip(kept, last, strict=True)), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("n", [3, 120])
def test_clusters_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    hot = rng.normal(size=64).astype(np.float32).tolist()
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(n)] + [(1000 + i, hot) for i in range(n // 2)]
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, hot), (901, None), (902, []), (903, [1.0] * 63), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("inf")] + [0.0] * 63)]
    got = centroids.cluster(vectors(spark, rows).withColumn("q", F.lit("clash")).withColumn("cluster", F.lit(0)))
    assert sorted((tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str) == brute_clusters(rows)


def test_clusters_of_no_vectors_and_of_huge_ones(spark):
    assert centroids.cluster(vectors(spark, [])).count() == 0
    assert centroids.cluster(vectors(spark, [(1, None)])).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(vectors(spark, [(1, [1e9] * 64)])).collect()


# --- licenses ---

TEMPLATES = (
    licenses.Template("a", "x y z", True),
    licenses.Template("b", "x <<beginOptional>>y <<beginOptional>>y<<endOptional>> z<<endOptional>> w"),
    licenses.Template("c", "y <<var;name=v;max=3>> w z"),
    licenses.Template("d", "z <<var;name=v;max=1>> <<beginOptional>>x<<endOptional>>"),
)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("xyzwv"), max_size=30))
def test_automaton_accepts_what_its_regular_expression_does(tokens):
    n, found = licenses.Automaton(TEMPLATES).scan(" ".join(tokens).upper().encode())
    text = "".join(t + " " for t in tokens)
    assert n == len(tokens)
    for i, t in enumerate(TEMPLATES):
        pattern = re.compile(licenses._regex(t.parts()))
        ends = {b for b in range(1, n + 1) for a in range(b) if pattern.fullmatch(text[2 * a:2 * b])}
        assert {b for _, b, k in found if k == i} == ends
        for a, b, k in found:
            if k == i:
                assert a == min(x for x in range(b) if pattern.fullmatch(text[2 * x:2 * b]))


def test_pieces_do_not_change_what_is_found(monkeypatch):
    text = ("Released under the MIT License; é Apache\x00License, version 2.0 CC-BY-NC " * 50).encode()
    whole = licenses.Automaton(licenses.BASE).scan(text)
    monkeypatch.setattr(licenses.pieces, "__defaults__", (37,))
    assert b"".join(licenses.pieces(text)) == text and licenses.Automaton(licenses.BASE).scan(text) == whole
    assert len(whole[1]) == 150


def test_licenses_edges(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy"
    long_text = "word " * 300_000 + "under the MIT license"
    rows = [(1, None), (2, ""), (3, "cc by nc, CC-BY-NC"), (4, mit), (5, long_text), (6, "under the mît license"), (None, "cc by nc"), (3, "cc by nc, CC-BY-NC")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Licenses", F.lit(1)).withColumn("x.y", F.lit(2))
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "text", "Licenses", "x.y", "licenses_"]
    got = sorted((str(r.doc_id), r.licenses_.n_words, [(m.first, m.stop, m.template) for m in r.licenses_.matches]) for r in out.collect())
    twice = ("3", 6, [(0, 3, 2), (3, 6, 2)])
    assert got == [("1", 0, []), ("2", 0, []), twice, twice, ("4", 13, []), ("5", 300_004, [(300_000, 300_004, 0)]), ("6", 4, []), ("None", 3, [(0, 3, 2)])]
    assert licenses.scan(df.limit(0)).count() == 0


def test_whole_license_texts():
    t = next(t for t in licenses.NOTICES if t.label == "mit")
    words = [p for p in t.parts() if isinstance(p, bytes)]
    scan = licenses.Automaton(licenses.NOTICES).scan
    label = lambda tokens: {licenses.NOTICES[m[2]].label for m in scan(b" ".join(tokens))[1]}
    assert label(words) == {"mit"}
    assert label(words[:50] + [b"sometimes"] + words[50:]) == set()
    at = words.index(b"shall")
    assert label(words[:at] + b"including the next paragraph".split() + words[at:]) == {"mit"}
    assert label(b"neither the name of the big example company inc nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission".split()) == {"bsd-3"}
    with pytest.raises(ValueError):
        licenses.Automaton([licenses.Template("x", "<<var;name=v;max=2>> word")])
