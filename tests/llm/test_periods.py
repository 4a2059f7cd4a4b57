"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest

from tidemill.llm import periods, queries


def brute(words, least=12):
    """(start, length, period) of every run, from the definition."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        k = 0
        while k < n - p:
            if words[k] != words[k + p]:
                k += 1
                continue
            s = k
            while k < n - p and words[k] == words[k + p]:
                k += 1
            e = k + p
            if e - s >= max(least, 2 * p) and (s, e) not in out:
                out[s, e] = p
    return sorted((s, e - s, p) for (s, e), p in out.items())


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n, out = h // 10, len(words), list(words)
    if doc_id is not None and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            out[i] = words[a + (i - a) % p]
    return out


def expected(text, doc_id, edit):
    words = (text or "").encode().split()
    words = planted(words, doc_id) if edit else words
    found = brute(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    kept = b" ".join([w for i, w in enumerate(words) if i not in gone])
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(found), *head, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return " ".join(b[:n])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    out = [None, "", "  \n", "x", "x " * 11, "x " * 12, "x " * 500, "a b " * 6, "a b " * 5 + "a", fibonacci(400), "  é é " * 9, "one\x0btwo\x0cthree\x1dfour " * 4]
    for size in (13, 40, 90, 200, 333):
        for letters in ("ab", "abc", "abcdefgh"):
            out.append(" ".join(rng.choice(letters) for _ in range(size)))
    for _ in range(30):
        words = [rng.choice("abcdefghij") for _ in range(rng.randrange(5, 80))]
        at, p, n = rng.randrange(len(words)), rng.randrange(1, 9), rng.randrange(4, 40)
        part = [rng.choice("abcxyz") for _ in range(p)]
        out.append(" ".join(words[:at] + (part * n)[:n] + words[at:]))
    long = [f"w{rng.randrange(300)}" for _ in range(1500)]
    return [*out, out[-1], " ".join(long[:700] + long[600:700] * 4 + long[700:])]


def test_runs(texts):
    lists = [(t or "").split() for t in texts]
    numbers = periods.Numbers()
    owner, start, end, period = periods.runs([[numbers[w] for w in t] for t in lists])
    got = {}
    for k, s, e, p in zip(owner.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
        got.setdefault(k, []).append((s, e - s, p))
    assert got == {k: brute(t) for k, t in enumerate(lists) if brute(t)}


@pytest.mark.parametrize("pairs", [1, 50, 1 << 20])
def test_runs_in_small_steps(texts, pairs, monkeypatch):
    monkeypatch.setattr(periods, "PAIRS", pairs)
    lists = [(t or "").split() for t in texts[:40]]
    numbers = periods.Numbers()
    owner, start, end, period = periods.runs([[numbers[w] for w in t] for t in lists])
    assert sorted(zip(owner.tolist(), start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == sorted((k, *r) for k, t in enumerate(lists) for r in brute(t))


def test_extensions():
    rng = random.Random(3)
    import numpy as np

    values = np.array([rng.choice([1, 2]) for _ in range(150)] + [9])
    own = periods.Extensions(values)
    x, y = np.array([(a, b) for a in range(150) for b in range(150) if a != b]).T
    want = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        k = 0
        while max(a, b) + k < len(values) and values[a + k] == values[b + k]:
            k += 1
        want.append(k)
    assert own.of(x, y).tolist() == want


@pytest.mark.parametrize("edit", [False, True])
def test_table(spark, texts, edit):
    ids = [*range(len(texts) - 1), None]
    rows = [(i, t, 1, "x", 2) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame([*rows, rows[9]], "doc_id long, text string, `a.b` int, runs string, n_runs int").repartition(3)
    got = periods.periodic_runs(docs, edit=edit)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted([(i, *expected(t, i, edit)) for i, t, *_ in [*rows, rows[9]]], key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_texts_and_empty(spark):
    docs = spark.createDataFrame([(1, "go " + "round and " * 8 + "stop")], "doc_id long, text string")
    row = periods.periodic_runs(docs, with_text=True).first()
    assert row["runs"] == [[1, 16, 2]] and row["collapsed"] == "go round and stop"
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    short = {i: t for i, t in docs.items() if len((t or "").split()) < 700}
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_harmonic_grid"](spark, sf_dir).collect()}
    assert set(got) == set(docs) and len(short) > 100
    assert {i: got[i] for i in short} == {i: expected(t, i, True) for i, t in short.items()}
