"""BPE, fingerprints, shingle groups and licenses against libraries or brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from facetloom.llm import bpe, fingerprint, jaccard, license, wordhash

DOCS = "doc_id long, text string, extra string"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(public_tokenizers.path(bpe.VOCABULARY)))


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_is_the_library_s(codec, library):
    rng = random.Random(1)
    letters = "  \n\t'''stmdrvlexabé1²٣,.# 　字🙂ſ"
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 3, 40, 200]))) for _ in range(4000)]
    texts += ["it's he'll we've I'm 'sre ''s 1's can'tell", "ab" * 20_000, "a  b\n\n c ", " ", "'", "x" * 70 + " " + "é" * 50]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_bpe_small_chunks_and_cache(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe, "CACHED", 5)
    codec.clear()
    texts = ["some text with words", "", "more text, that's it", "a" * 200] * 5
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_decodes_by_offsets(codec, monkeypatch):
    monkeypatch.setattr(bpe, "LAID", 3)
    for text in ("", "a", "Größe and size, 字 or not", "x " * 40):
        ids = codec.encode([text])[0]
        assert codec.decode(ids, codec.ends(ids)) == codec.decode(ids) == text.encode()
        assert codec.decode(ids) == b"".join(codec.tokens[i] for i in np.frombuffer(ids, "<u4"))


def test_bpe_spans(codec):
    text = "Größe and size, 字 or not"
    ids = codec.encode([text])[0]
    ends = codec.ends(ids)
    raw = text.encode()
    for a in range(len(raw) + 1):
        for b in range(a, len(raw) + 1):
            assert codec.span(ids, ends, a, b) == raw[a:b]
    assert codec.span(b"", b"", 0, 5) == b""


def test_bpe_scan_is_a_fold():
    functions, compose, apply = bpe._monoid()
    rng = np.random.default_rng(0)
    kinds = rng.integers(0, 12, 5000)
    got = apply[bpe._scan(functions[kinds], compose, 16), bpe.INIT]
    state, want = bpe.INIT, []
    for k in kinds:
        state = bpe._next(state, int(k))
        want.append(state)
    assert got.tolist() == want


def test_bpe_frame(spark, codec):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x"), (None, "tokens", "x")], "doc_id long, text string, tokens string")
    got = bpe._digests(df.drop("tokens")).collect()
    assert [r["n_tokens"] for r in got] == [0, 0, 2, 2, len(codec.encode(["tokens"])[0]) // 4]
    assert got[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and got[2]["decoded_sha256"] == hashlib.sha256(b"hello world").hexdigest()
    for r, ids, text in zip(got, codec.encode(["", "", "hello world", "hello world", "tokens"]), [b"", b"", b"hello world", b"hello world", b"tokens"], strict=True):
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text).hexdigest()
    back = bpe.decode(bpe.encode(df, codec.ranks, out="t"), codec.ranks, "t.ids", "back").collect()
    assert [bytes(r["back"]).decode() for r in back] == ["", "", "hello world", "hello world", "tokens"] and back[2]["tokens"] == "x"
    assert bpe._digests(df.limit(0)).count() == 0
    assert bpe.encode(df, codec.ranks, out="ids").columns == ["doc_id", "text", "tokens", "ids"]


def brute_signature(text, lanes=64, k=2):
    e = fingerprint.elements(text, k)
    offset, factor, seed = fingerprint._lanes(lanes)
    if not len(e):
        return [0] * lanes
    out = []
    for a, b, s in zip(offset[:, 0], factor[:, 0], seed, strict=True):
        p = ((e >> np.uint64(32)).astype(np.uint32) ^ a) * b
        at = sorted(np.argsort(p, kind="stable")[:2])
        first = e[at[0]] if len(at) > 1 else np.uint64(0)
        out.append(int(wordhash.mixed(wordhash.mixed(np.array([first ^ s])) * np.uint64(5) + e[at[-1]])[0] >> np.uint64(48)) | 1)
    return out


def test_signatures(monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK", 7)
    for text in ("a", "a b", "a b a b a b c d", "x " * 50, " ".join(map(str, range(60))), " ", "a b c d e f g h i"):
        assert fingerprint.signature(text).tolist() == brute_signature(text)


def test_signatures_feel_order_and_edits():
    words = [f"w{i}" for i in range(300)]
    a = fingerprint.signature(" ".join(words))
    shuffled = words[:]
    random.Random(1).shuffle(shuffled)
    few = words[:]
    few[100] = "other"
    assert fingerprint.likeness(a, fingerprint.signature(" ".join(few))) > 0.8
    assert fingerprint.likeness(a, fingerprint.signature(" ".join(shuffled))) < 0.2
    # Halves in the other order have the same pairs of words but one, and another order.
    assert fingerprint.likeness(a, fingerprint.signature(" ".join(words[150:] + words[:150]))) < 0.8


def test_signatures_feel_edits_without_spaces():
    rng = random.Random(5)
    long = "".join(rng.choices("的一是不了人我在有他这为之大来以个中上们", k=2000))
    a, b = fingerprint.signature(long), fingerprint.signature(fingerprint.edited(long, "".join(rng.choices("abcdefgh", k=2000))))
    assert 0.2 < fingerprint.likeness(a, b) < 0.7
    # Texts of few words, too, keep something of three quarters of their characters.
    for text in ("information retrieval", "one_long_token_of_a_line", "Universität Heidelberg Bibliothek", "日本語の文", "word"):
        assert fingerprint.likeness(fingerprint.signature(text), fingerprint.signature(fingerprint.edited(text, "zzzzzzzzzzzz"))) > 0
    assert (fingerprint.signature(" a  b\n") == fingerprint.signature("a b")).all() and not fingerprint.signature(" \n ").any()


@pytest.mark.parametrize("per", [3, 1000])
def test_fingerprints_with_next(spark, per, monkeypatch):
    rng = random.Random(3)
    rows = [(i * 7 % 101, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 30)))) for i in range(60)]
    rows += [(5000, None), (5001, ""), (None, "null id"), (9, "tie one"), (9, "tie two"), (9, "tie two")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS)
    plain = fingerprint.with_next
    monkeypatch.setattr(fingerprint, "with_next", lambda docs: plain(docs, per))
    got = fingerprint.compare_with_next(df).collect()
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in df.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, hashes[x]))
    want = []
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        new = fingerprint.edited(t, following)
        a, b, e = (fingerprint.signature(x) for x in (t, following, new))
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint.text_of(a), fingerprint.text_of(e), fingerprint.likeness(a, e), fingerprint.likeness(a, b)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert fingerprint.compare_with_next(df.limit(0)).count() == 0
    one = fingerprint.compare_with_next(spark.createDataFrame([(1, "a b c d", "x")], DOCS)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_large_ids_are_divided(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "GROUP", 4)
    rng = random.Random(4)
    rows = [(None, f"null {i}") for i in range(300)] + [(70, f"seventy {i}") for i in range(300)] + [(rng.randrange(200), f"text {i}") for i in range(300)] + [(70, "copy")] * 3
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS)
    got = [r for p in fingerprint.with_next(df, 20).rdd.glom().collect() for r in p]
    hashes = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))
    parts = {}
    for r in got:
        parts.setdefault(r["part__"], ([], []))[r["halo__"]].append((r["doc_id"], r["text"]))
    assert [x for p in sorted(parts) for x in parts[p][0]] == order
    assert max(len(own) for own, _ in parts.values()) <= 60
    ids = sorted(parts)
    assert all(parts[p][1][0] == parts[ids[(i + 1) % len(ids)]][0][0] for i, p in enumerate(ids))


def brute_groups(rows, k, percent):
    sets = [set(jaccard.shingles(t, k).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("k", "percent", "task"), [(4, 85, jaccard.TASK), (5, 80, 20_000)])
def test_groups_are_brute_force_s(spark, k, percent, task):
    rng = random.Random(k)
    rows = [(None, None), (1, ""), (2, "one two"), (3, "one two"), (4, "ONE two"), (5, " \n ")]
    common = [f"c{i}" for i in range(30)]
    for g in range(12):
        base = [rng.choice(common) if rng.random() < 0.1 else f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 120))] + (common if g % 3 == 0 else [])
        for _ in range(rng.randint(1, 25)):
            words = base[:]
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["new" + str(rng.randrange(99))], [words[at], "in"]])
            rows.append((len(rows) + 10, " ".join(words)))
    rows += rows[20:25]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS)
    got = jaccard.groups(df, k, percent, task=task)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups(rows, k, percent)
    assert jaccard.groups(df.limit(0), k, percent).count() == 0


def test_large_regions_are_divided(spark, monkeypatch):
    """One region that boilerplate holds together, with copies of several texts and many texts of their own, over several rounds and parts."""
    monkeypatch.setattr(jaccard, "PART", 3_000)
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    calls, plain = [], jaccard._nearest
    monkeypatch.setattr(jaccard, "_nearest", lambda percent: calls.append(1) or plain(percent))
    rng = random.Random(11)
    boilerplate = [f"b{i}" for i in range(40)]
    rows = []
    for size in (60, 40, 25, 12, 5, 5, 4, 3, 3, 2, *[1] * 30):
        own = [f"w{rng.randrange(100_000)}" for _ in range(12)]
        for _ in range(size):
            words = boilerplate + own
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(40, len(words))] = f"x{rng.randrange(60)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS)
    assert sorted(map(tuple, jaccard.groups(df, 4, 85, task=30_000).collect()), key=repr) == brute_groups(rows, 4, 85)
    assert calls


def test_voronoi_windows_lose_no_link(monkeypatch):
    """Every link between two nodes is inside one of the regions, or follows from the balls."""
    import pandas as pd

    rng = np.random.default_rng(3)
    for percent in (80, 85):
        bases = [rng.choice(400, 40, replace=False) for _ in range(6)]
        own = []
        for _ in range(150):
            b = set(bases[rng.integers(6)].tolist())
            for x in rng.choice(sorted(b), rng.integers(0, 8), replace=False):
                b.remove(int(x))
            own.append(np.array(sorted(b | set(rng.integers(400, 440, rng.integers(0, 6)).tolist())), np.int64))
        nodes = pd.DataFrame({"region": 7, "sid": np.arange(150), "n": [len(x) for x in own], "s": own, "central": 0.0})
        got = jaccard._nearest(percent)(None, nodes, nodes.iloc[:5][["region", "sid", "s"]])
        members = got.groupby(got["pivot"].fillna(-1))["sid"].agg(set)
        for i in range(150):
            for j in range(i):
                both = len(set(own[i].tolist()) & set(own[j].tolist()))
                if 100 * both >= percent * (len(own[i]) + len(own[j]) - both):
                    assert any({i, j} <= m for m in members)
        alone = jaccard._nearest(percent)(None, nodes.iloc[:0], nodes.iloc[:5][["region", "sid", "s"]])
        assert not len(alone)


def test_groups_stage(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (2, long + " x", "b"), (3, "other text", None), (None, long, "c"), (4, "", "d"), (4, "", "d"), (5, "other text", "e")], "doc_id long, text string, gone string")
    kept = jaccard.keep(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 4]


def test_groups_stage_decides_by_row(spark):
    """Against a plain version: repeated ids with other texts, and null ids."""
    rng = random.Random(8)
    bases = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(9)]
    rows = [(1, bases[0]), (5, bases[0] + " x"), (5, bases[1]), (7, bases[1] + " x"), (5, bases[2])]
    rows += [(rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice(bases[3:]) + rng.choice(["", " x", " y"])) for _ in range(40)] + [(None, bases[8])] * 5
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS)
    hashes = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    want = set()
    for base in bases:
        group = [(d, t) for d, t in rows if t.startswith(base)]
        if group:
            want.add(min(group, key=lambda x: (x[0] is None, x[0] or 0, hashes[x[1]])))
    assert sorted(((r["doc_id"], r["text"]) for r in jaccard.keep(spark, df, "").collect()), key=repr) == sorted(want, key=repr)


def test_word_hashes(monkeypatch):
    import re

    text = "Größe\x0b a b A a  x" * 30
    whole = wordhash.word_hashes(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
    monkeypatch.setattr(wordhash, "CHUNK", 16)
    assert (wordhash.word_hashes(text) == whole).all()
    assert (wordhash.word_hashes("A É", lower=True) == wordhash.word_hashes("a É")).all()


def test_licenses(spark):
    rows = [
        (1, "CC BY, all rights reserved. cc-by", "x"), (2, None, "x"), (3, "general public the license", "x"), (4, "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software", "x"),
        (1, "CC BY, all rights reserved. cc-by", "x"), (5, "cc K by", "x"), (6, "General Public License general public license", "x"), (None, "all rights reserved", "x"), (7, "w " * 50_000 + "cc by", "x"),
    ]
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert tuple(by[1])[1:6] == (7, 3, 0, 5, "cc-by,reserved") and by[1]["score"] == 1.0
    assert tuple(by[2])[1:] == (0, 0, None, None, "", "", 0.0)
    assert by[3]["n_base"] == 0 and by[3]["base_labels"] == ""
    assert by[4]["labels"] == "mit" and 0.5 < by[4]["score"] < 1
    assert by[5]["n_base"] == 0 and by[6]["n_base"] == 2 and by[6]["last_word"] == 3 and by[None]["n_base"] == 1 and by[7]["first_word"] == 50_000
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        license.template_rows(spark, (license.Template("x", "one"),))


def test_long_licenses(spark):
    """A template of 200 words, whole, with words put in and left out, and in part; a base phrase of 80 words."""
    rng = random.Random(7)
    long = [f"t{rng.randrange(150)}" for _ in range(200)]
    templates = (license.Template("long", " ".join(long)), license.Template("phrase", " ".join(long[:80]), True))
    less = [w for i, w in enumerate(long) if i not in (20, 77, 140)]
    more = long[:70] + ["in"] + long[70:150] + ["to"] + long[150:]
    texts = [" ".join(long), "x y " + " ".join(less), " ".join(more), " ".join(long[:100]), " ".join(long[:79]), "a " + " ".join(long[:80]) + " b " + " ".join(long[:80])]
    got = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()}
    assert [got[i]["labels"] for i in range(6)] == ["long,phrase", "long", "long", "phrase", "", "phrase"]
    assert [got[i]["n_base"] for i in range(6)] == [1, 0, 0, 1, 0, 2] and (got[5]["first_word"], got[5]["last_word"]) == (1, 82)
    assert got[0]["score"] == 1.0 and 0.9 < got[1]["score"] < 1.0


def test_licenses_run_no_python(spark):
    plan = license.scan(spark.createDataFrame([(1, "cc by")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
