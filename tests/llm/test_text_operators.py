"""Edge cases and brute-force comparisons of the operators on texts."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from tidemill.llm import exact, language, lines, minhash, mixing, packing, queries, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, hash string, windows int, target string, id int"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows_of(texts, sources=("a", "b", "c")):
    return [(i, t, "en", sources[i % len(sources)], len(t or ""), 1, "x", "y", 2, "z", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 40, 120, 300])) for _ in range(40)]
    near = [" ".join(w if k % 97 else "changed" for k, w in enumerate(t.split())) for t in base[:15]]
    passage = prose(rng, 90)
    shared = [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    return base + near + base[:10] + shared + ["", None, "   ", "one", "ONE", "ein wort", "é" * 500, "é" * 900, "x" * 70_000] + [base[0] + "\n" + base[1]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact.exact_groups(empty).count() == 0
    assert lines.remove_boilerplate(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert packing.pack_documents(empty, queries.tokenizer_json()).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert language.identify(empty).count() == 0
    assert toxicity.classify(empty, labels).count() == 0


def test_exact_groups(docs, texts):
    got = {r.doc_id: r for r in exact.exact_groups(docs).collect()}
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for t in texts]
    for i, n in enumerate(norm):
        same = [j for j, m in enumerate(norm) if m == n]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(same), i == keep, hashlib.sha256(n.encode()).hexdigest())


def test_chunks_are_the_text_and_local(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000))
    frame = spark.createDataFrame([(text,), ("zz" + text,)], "t string")
    a, b = (r.c for r in frame.select(exact.chunks(frame["t"]).alias("c")).collect())
    assert "".join(a) == text and "".join(b) == "zz" + text
    assert len(set(a) & set(b)) > 0.8 * len(a) and max(map(len, a)) <= exact.MOST_CHUNK


def shingles(text):
    w = (text or "").encode().lower().split()
    return set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def components(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: root(i) for i in sets}


def test_near_duplicates(docs, texts):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets)
    assert {i: (len(s), want[i], want[i] == i) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Chains whose ends are unlike each other, with every bucket dealt in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "CHUNK", 3)
    rng = random.Random(8)
    words = prose(rng, 200).split()
    texts = []
    for k in range(40):
        own = list(words)
        for _ in range(1 + k % 3):
            own[rng.randrange(200)] = f"new{k}"
        texts.append(" ".join(own))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    assert got == components({i: shingles(t) for i, t in enumerate(texts)})


def test_null_and_repeated_ids(spark):
    rows = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (None, "a b c d e f", None, None), (2, "q r s t u", "en", None)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(own).collect()) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert sorted(r.group_size for r in exact.exact_groups(own).collect()) == [1, 3, 3, 3]
    assert minhash.one_of_each(own).count() == 3
    assert lines.remove_boilerplate(own).count() == 4 and mixing.mix(own).count() == 4
    assert substrings.remove_repeats(own).count() == 4 and toxicity.classify(own, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 4


def test_boilerplate_lines(spark):
    notice, rare = "accept all the cookies now", "seen on three sites only"
    rows = [(i, f"  {notice} \nown line number {i}\n\n{notice}\nok" + (f"\n{rare}" if i < 3 else ""), f"site{i}") for i in range(12)] + [(50, None, "x"), (51, notice, None)]
    got = {r.doc_id: r for r in lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].text == f"  {notice} \nown line number 0\n\nok\n{rare}" and got[0].n_removed == 1 and got[0].n_lines == 6
    assert got[5].text == "own line number 5\n\nok" and got[5].n_removed == 2
    assert got[50].text is None and got[50].n_lines == 0 and got[51].text == "" and got[51].n_removed == 1
    left = lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in left} >= set(range(12)) and 51 not in {r.doc_id for r in left}


def test_repeats(docs, texts):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, with_text=True).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + 400] for b in raw for p in range(len(b) - 399))
    for i, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = 1
        kept = bytes(np.frombuffer(b, np.uint8)[gone[:-1] == 0])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(b), gone.sum(), (np.diff(np.append(0, gone)) == 1).sum())
        assert bytes(got[i].kept) == kept and got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_repeats_across_strips(spark, monkeypatch):
    monkeypatch.setattr(substrings, "STRIP", 1000)
    rng = random.Random(3)
    a = prose(rng, 3000)
    text = a.encode()
    whole = substrings.runs(text)
    assert (whole[1][0], whole[2][-1]) == (0, len(text) - 400) and (whole[1][1:] == whole[2][:-1] + 1).all()
    assert ((whole[0] >= whole[2]) & (whole[0] <= whole[1] + 400 - substrings.GRAM)).all()


def test_packing(docs, texts):
    tokenizer = queries.tokenizer_json()
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(tokenizer)
    rows = packing.pack_documents(docs, tokenizer, capacity=64, open_bins=8, group_pieces=100, with_ids=True).collect()
    bins, back = collections.defaultdict(list), collections.defaultdict(dict)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        back[r.doc_id][r.piece] = r
        assert r.length <= 64 and r.length == len(r.ids) // 4 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    for own_bin in bins.values():
        at = 0
        for offset, length in sorted(own_bin):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        assert b"".join(bytes(back[i][k].ids) for k in sorted(back[i])) == struct.pack(f"<{len(ids)}I", *ids)
    assert len(bins) <= 1.1 * -(-sum(r.length for r in rows) // 64) + 8


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    json = queries.tokenizer_json()
    own, words = Tokenizer.from_str(json), packing.WordIds(json)
    for text in ["<|endoftext|> a<|startoftext|>b", "it's DON'T ''s I'LL ²½ x1y22", "ÀÉîõ Straße İstanbul ά Σς", "日本語 テスト 😀👍🏽", "a\x00b \x7f \xad ‍", " nb sp \x1c\x85x", "Å é"]:
        ids = own.encode(text, add_special_tokens=False).ids
        assert words.ids(text.encode()) == struct.pack(f"<{len(ids)}I", *ids)


def test_packer_takes_the_tightest_bin():
    packer = packing.Packer(10, 2)
    assert [packer.place(n) for n in (6, 7, 3, 4, 9, 8)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    assert packer.place(5) == (4, 0)  # the bin with one token left closes
    assert packer.count == 2


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)] + [(9000, None, "empty"), (9001, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == {tuple(r) for r in mixing.mix(docs.repartition(7)).collect()}
    by = collections.defaultdict(list)
    for r in got:
        by[r.source_size].append(r)
        assert r.taken <= 2 * r["size"]
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 30
        assert own[0].target <= 2 * own[0].source_size
    total = sum(r["size"] for r in got)
    assert abs(sum(own[0].target for own in by.values()) - 1.5 * total) < 1e-6 * total
    assert sum(r.taken for r in got) == sum(len(r.text.split()) for r in mixing.mixed_documents(docs).collect())


def test_toxicity_learns(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 50) + (" you rotten goblin" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (0, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert all(got[i].predicted == y for i, _, y in rows) and 0 <= got[5000].score < 0.7
    assert {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()} == {i for i in got if not got[i].predicted}
    one_kind = toxicity.classify(docs, labels.filter("toxic = 0")).collect()
    assert {r.score for r in one_kind} == {0.0}


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "123 456 !?", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs.select("doc_id", "text", "lang").unionByName(odd)).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (-1, -2, -3))
    assert all(0 <= r.score <= 1 for r in got.values())
    words = language.code(9)
    assert words.shape == (9, 36) and all((words[i] != words[j]).sum() >= 8 for i in range(9) for j in range(i))


def test_short_lines_leave_the_pipeline(spark):
    thai = "สงวนลิขสิทธิ์ตามกฎหมาย"
    rows = [(i, f"Read more\nown line number {i}\n\n {thai}\nfew", f"site{i % 4 if i > 11 else i}") for i in range(14)]
    rows = [(i, t if i < 3 else t.replace("\nfew", ""), s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in lines.without_boilerplate(docs).collect()}
    assert got[0] == rows[0][1] and got[1] == "own line number 1\n\nfew" and got[5] == "own line number 5\n"
    assert all(r.n_removed == 0 for r in lines.remove_boilerplate(docs).collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_texts_of_one_id_are_documents(spark, kind):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 120) for _ in range(4))
    rows = [(2, a), (7, a), (7, b), (7, b), (8, c), (8, d), (8, ""), (9, c + " end"), (5, b + " end"), (None, a)]
    own = spark.createDataFrame([(i if kind == "long" or i is None else str(i), t) for i, t in rows], f"doc_id {kind}, text string")
    got = sorted((int(r.doc_id or -1), r.text) for r in minhash.one_of_each(own).collect())
    assert got == sorted([(2, a), (5, b + " end"), (8, c), (8, d), (8, ""), (-1, a)])


def test_repeats_of_rows_without_id(spark):
    rng = random.Random(13)
    passage = prose(rng, 250)
    texts = [(i, f"{prose(rng, 80)} {passage} {prose(rng, 80)}") for i in (None, 1, 2)]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(got[i].n_spans == 1 and got[i].n_removed >= len(passage) for i, _ in texts)


def test_rare_language_is_learned(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, 20), "aa") for i in range(3000)] + [(5000 + i, " ".join(rng.choice(["zqx", "qzz", "xqy"]) for _ in range(20)), "zz") for i in range(12)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=60)
    assert model.languages == ["aa", "zz"]


def test_a_large_group_of_half_alike_texts(spark, monkeypatch):
    """Variants of one text, most of which are alike to the text and to few other variants: components as by brute force."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(21)
    words = prose(rng, 220).split()
    texts = []
    for k in range(150):
        own = list(words)
        for _ in range(rng.randrange(3, 14)):
            own[rng.randrange(220)] = f"new{k}x{rng.randrange(3)}"
        texts.append(" ".join(own))
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    want = components({i: shingles(t) for i, t in enumerate(texts)})
    assert got == want and 3 < len(set(want.values())) < 140


def test_intersections_and_joined():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(20)]
    left, right = np.arange(8), np.arange(5, 20)
    same = minhash.intersections(sets, left, right)
    assert all(same[i, j] == len(np.intersect1d(sets[x], sets[y])) for i, x in enumerate(left) for j, y in enumerate(right))
    assert minhash.joined(np.array([0, 0, 1, 2, 3, 4]), np.array([1, 3, 2]), np.array([2, 4, 4])).tolist() == [0, 0, 0, 0, 4]


def test_inclusion_follows_size(spark):
    """Long documents are certain, the others are taken about as often as their size says; columns of any name are carried."""
    rng = random.Random(31)
    rows = [(i, prose(rng, n), "a", "row", 1.0, "w") for i, n in enumerate([400] * 3 + [rng.randrange(1, 60) for _ in range(2000)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _row string, _p double, _words string")
    got = {r.doc_id: r for r in mixing.mix(docs, share_percent=15).collect()}
    size, total = {i: len(r[1].split()) for i, r in enumerate(rows)}, sum(len(r[1].split()) for r in rows)
    left, c = 0.15 * total, None
    for n in sorted(set(size.values()), reverse=True):
        c = (left - sum(s for s in size.values() if s > n)) / sum(s * s for s in size.values() if s <= n)
        if c * n < 1:
            break
    assert all(got[i].taken == 400 for i in range(3)) == (c * 400 >= 1)
    for low, high in ((1, 20), (20, 40), (40, 60)):
        own = [i for i, s in size.items() if low <= s < high]
        share, want = sum(got[i].copies for i in own) / len(own), sum(min(1, c * size[i]) for i in own) / len(own)
        assert abs(share - want) < 4 * (want * (1 - want) / len(own)) ** 0.5 + 0.01
    assert abs(sum(r.taken for r in got.values()) - 0.15 * total) <= 30
    mixed = mixing.mixed_documents(docs, share_percent=15)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got.values())


def repeats_by_brute_force(raw, length=400):
    seen = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = 1
        out.append((len(b), int(gone.sum()), int((np.diff(np.append(0, gone)) == 1).sum())))
    return out


@pytest.mark.parametrize("hot", [1, 8192])
def test_repeats_of_periodic_and_hot_passages(spark, monkeypatch, hot):
    """A passage in other surroundings each time, runs of one byte and of short periods, with and without counting by window."""
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(17)
    passage = prose(rng, 130)
    texts = [f"{prose(rng, rng.randrange(60))} {passage[k % 7 :]} {prose(rng, rng.randrange(60))}" for k in range(25)]
    texts += ["z" * n for n in (399, 400, 401, 1500)] + ["ab" * 700, "spam eggs " * 90, prose(rng, 40) + " spam eggs" * 60 + prose(rng, 40), "abc " * 99 + "abc"]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    for i, want in enumerate(repeats_by_brute_force([t.encode() for t in texts])):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == want, i


def test_suffix_ranks_are_alphabetical():
    rng = np.random.default_rng(6)
    raw = rng.choice(np.frombuffer(b"ab", np.uint8), 600)
    raw[200:330] = raw[20:150]
    text = bytes(raw) + bytes(100)
    for length in (32, 100):
        ranks = substrings.suffix_ranks(raw, length)
        keys = [text[k : k + length] for k in range(len(raw) - length + 1)]
        order = {x: n for n, x in enumerate(sorted(set(keys)))}
        assert (np.unique(ranks[: len(keys)], return_inverse=True)[1] == [order[x] for x in keys]).all()


def test_columns_of_any_name_and_odd_rows(spark):
    """Line dedup and toxicity carry columns that are named like their own; nulls, empty texts, repeated rows and a very long text have results."""
    notice = "accept all the cookies now"
    kind = "doc_id long, text string, source string, gone string, _id long, _hash long, n_lines string, _toxicity double, _row string, _text string, n_chars long"
    more = ("g", 1, 2, "r", 3.0, "row", "own", 5)
    long = "word " * 300_000
    rows = [(i, f"{notice}\nown line {i}", f"s{i}", *more) for i in range(12)] + [(20, None, "s1", *more), (21, "", None, *more), (None, "no id here", "s2", *more), (22, long, "s3", *more), (0, f"{notice}\nown line 0", "s0", *more)]
    docs = spark.createDataFrame(rows, kind)
    cleaned = lines.remove_boilerplate(docs)
    assert cleaned.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"] and cleaned.count() == len(rows)
    assert {r.doc_id: r.n_removed for r in cleaned.collect()}[5] == 1 and all(r.gone == "g" and r._id == 1 for r in cleaned.collect())
    left = lines.without_boilerplate(docs)
    assert left.columns == docs.columns and all(r.n_lines == "r" for r in left.collect())
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(12)], "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    scored = toxicity.classify(docs, labels).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored) and len({r.score for r in scored if r.doc_id == 0}) == 1
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 0").count() == 1
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert substrings.remove_repeats(docs).count() == len(rows) and packing.pack_documents(docs, queries.tokenizer_json()).filter("piece = 0").count() == len(rows)


def test_language_of_odd_rows(spark):
    """One language, ties, repeated rows, clashing columns, a very long text, and signs that are no letters."""
    rows = [(i, "ab cd " * 9, "aa", "x") for i in range(9)] + [(20, "½ ² ① 12", None, "x"), (20, "½ ² ① 12", None, "x"), (21, "ⅻ", "aa", "x"), (22, "x" * 400_000, "aa", "x"), (23, "日本", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language.identify(docs).collect()]
    assert len(got) == len(rows) and sorted(x for x in got if x[0] == 20) == [(20, "und", 0.0)] * 2
    assert {x[1:] for x in got if x[0] in (0, 22, 23)} == {("aa", 1.0)} and {x[1] for x in got if x[0] == 21} == {"und"}
    words = language.code(4)
    even = language.Model(["a", "b", "c", "d"], words, np.zeros((language.SLOTS, words.shape[1])), np.zeros(words.shape[1]), np.ones(words.shape[1]))
    best, score, close = even.decode(np.ones((1, language.SLOTS)))
    assert best[0] == 0 and score[0] == 0.25 and close[0]


def test_decoding_by_brute_force():
    rng = np.random.default_rng(4)
    words = language.code(5)
    model = language.Model(list("abcde"), words, rng.normal(size=(language.SLOTS, words.shape[1])), rng.normal(size=words.shape[1]), rng.uniform(0.5, 1, words.shape[1]))
    x = rng.normal(size=(7, language.SLOTS)) / 40
    best, score, _ = model.decode(x)
    for i in range(7):
        margins = [sum(x[i] * model.weights[:, b]) + model.bias[b] for b in range(words.shape[1])]
        loss = [sum(model.bit_weights[b] * np.log1p(np.exp(-margins[b] * w[b])) for b in range(words.shape[1])) for w in words]
        assert best[i] == int(np.argmin(loss)) and abs(score[i] - np.exp(-min(loss)) / sum(np.exp(-v) for v in loss)) < 1e-9


def test_ftrl_by_brute_force():
    """The learner against a plain loop over coordinates."""
    rng = np.random.default_rng(9)
    rows = [(np.unique(rng.integers(0, 12, 5)).astype(np.int32), int(rng.random() < 0.4)) for _ in range(60)]
    sizes = [len(r) for r, _ in rows]
    sample = toxicity.Sample(np.concatenate([r for r, _ in rows]), np.concatenate([[0], np.cumsum(sizes)]), np.array([y for _, y in rows]), np.arange(60))
    model = toxicity.ftrl(sample, epochs=2, l1=0.5, least_rows=1)
    z, n, bias = collections.defaultdict(float), collections.defaultdict(float), -1

    def weight(i):
        l1 = 0.0 if i == bias else 0.5
        return 0.0 if abs(z[i]) <= l1 else ((1 if z[i] > 0 else -1) * l1 - z[i]) / ((1 + n[i] ** 0.5) / 1.0 + 1.0)

    for _ in range(2):
        for own, y in rows:
            at = [*own.tolist(), bias]
            w = {i: weight(i) for i in at}
            g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (toxicity.TOXIC_WEIGHT if y else 1.0)
            for i in at:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 1.0
                z[i], n[i] = z[i] + g - sigma * w[i], n[i] + g * g
    want = {i: weight(i) for i in range(12) if weight(i)}
    assert dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want) and model.bias == pytest.approx(weight(bias))


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """Thousands of rows without doc_id, or with one, don't all come to the driver."""
    rng = random.Random(4)
    rows = [(None, prose(rng, 6), "en") for _ in range(3000)] + [(7, prose(rng, 6), "en") for _ in range(3000)] + [(7, "the same", "fr")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "learn", lambda profiles, marks: seen.append(len(marks)))
    language.fit(docs, train_rows=600)
    assert 300 < seen[0] < 1200
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "ftrl", lambda sample: seen.append(len(sample.labels)))
    toxicity.fit(spark.createDataFrame([(7, prose(rng, 5)) for _ in range(2000)] + [(8, None), (9, "x")], "doc_id long, text string"), labels)
    assert seen[1] <= 3
