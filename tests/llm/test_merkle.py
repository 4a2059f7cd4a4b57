"""The Merkle manifest against a tree built by hand, and against SQL."""

import glob
import os
import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from tidemill.llm import merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, leaf string, grp string, _pid int"


def h(text):
    return sha256(text.encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """The levels over nodes."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def path(levels, k):
    """(left, right) siblings of leaf k on each level."""
    out = []
    for nodes in levels[:-1]:
        first = k - k % 3
        out.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 3])))
        k //= 3
    return out


def expected(rows, tamper):
    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        own = h("".join(map(enc, (doc_id, source, lang, n_chars, text))))
        other = own
        if tamper and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
            other = h("".join(map(enc, (doc_id, source, lang, n_chars, text.replace("\n", "")))))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, own, other, doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(groups[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, other, doc_id) in enumerate(sorted(groups[s])):
            steps = path(trees[s], i) + path(top, k)
            reached = other
            for left, right in steps:
                reached = h(left + reached + right)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), reached, reached == top[-1][0]))
    return sorted(out, key=str)


def rows_of(sizes, seed=1):
    rng, out, i = random.Random(seed), [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "é\nx\n", f"line {rng.random()}\n", f"plain {rng.random()}"])
            out.append((rng.choice([i, i, i, -i]), text, rng.choice(["en", None]), source, rng.choice([None, 3]), 1, "x", "y", 2))
            i += 1
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, "b": 1}, {None: 4, "a": 3, "B": 9, "é": 10}, {f"s{k}": k % 5 + 1 for k in range(60)}, {"hot": 900, "b": 28, None: 1}])
def test_against_hand(spark, sizes):
    rows = rows_of(sizes)
    rows += [rows[0], (None, "no id\n", "en", rows[0][3], 1, 1, "x", "y", 2)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = merkle.manifest(docs, tamper=True)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, True)


def test_many_tiers_and_ranges(spark, monkeypatch):
    """Low subtrees make several tiers; many ranges make ragged borders."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    rows = rows_of({"a": 300, "b": 31, "c": 1}, seed=4)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, DOCS)
        leaves = merkle.sorted_leaves(docs.select(docs.source.alias("grp"), docs.doc_id.alias("id"), merkle.leaf(docs.doc_id).alias("leaf"), docs.text.alias("other")))
        assert len(merkle.range_offsets(leaves)) > 5
        blocks = merkle.subtrees(leaves, merkle.range_offsets(leaves), 1)
        top = merkle.finished(merkle.leaf_counts(blocks.select("g", "level", "at", "hash")), 2, 1)
        tops = {r.g: r.top_hash for r in top.select("g", "top_hash").distinct().collect()}
        want = {}
        for k, s in enumerate(["a", "b", "c"]):
            own = sorted((r[0], h(enc(r[0]))) for r in rows if r[3] == s)
            want[k] = tree([x for _, x in own])[-1][0]
        assert tops == want
        assert sorted((tuple(r) for r in merkle.manifest(docs, tamper=True).collect()), key=str) == expected(rows, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_proofs_verify(spark):
    rows = rows_of({"a": 40, None: 5, "c": 1})
    docs = spark.createDataFrame(rows, DOCS)
    for r in merkle.manifest(docs, with_siblings=True).collect():
        assert r.verified and merkle.folded(r.leaf, r.lefts, r.rights) == r.root
        assert h("".join(a + b for a, b in zip(r.lefts, r.rights))) == r.proof_sha256
    changed = [r for r in merkle.manifest(docs, tamper=True).collect() if not r.verified]
    texts = {r[0]: r[1] for r in rows}
    assert {r.doc_id for r in changed} == {i for i, t in texts.items() if t and "\n" in t and zlib.crc32(str(i).encode()) % 2 == 0}


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS), tamper=True).count() == 0


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    name = "op13_merkle_manifest"
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
