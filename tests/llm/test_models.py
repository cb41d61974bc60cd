"""Quality and language: held-out accuracy, edges, and results that do not depend on columns that must not count."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetloom.llm import language, quality
from facetloom.llm.common import held_out

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=160, seed=1):
    """Good texts are words of one alphabet, bad ones the same words with junk behind them; two languages by their syllables."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        en = rng.random() < 0.5
        syllables = ["the", "ing", "er", "tion", "wh"] if en else ["lich", "keit", "ung", "sch", "zu"]
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(30, 90))]
        good = rng.random() < 0.6
        rows.append((i, " ".join(words if good else [w + rng.choice(["&&&", "%%%", "***"]) for w in words]), "en" if en else "de", "s", 0, int(good)))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:5] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_is_crc32(spark):
    import zlib

    got = spark.range(50).select("id", held_out("id", 5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
    assert spark.sql("select cast(null as long) as id").select(held_out("id", 5, 0)).first()[0] is False


def test_quality_held_out(spark, data):
    docs, labels = data
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where(held_out("doc_id", 5, 0)).select("score", "quality").collect()
    assert sum((r["score"] >= 0.5) == bool(r["quality"]) for r in got) / len(got) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_quality_whole_texts_count(spark, data):
    model = quality.train(*data)
    text = " ".join(["theing erer whtion"] * 400)
    bad = " ".join(["the&&& ing%%% er***"] * 400)
    df = spark.createDataFrame([(1, text), (2, text + " " + bad)], "doc_id long, text string")
    a, b = (r["score"] for r in quality.score(df, model).orderBy("doc_id").collect())
    assert a > b


def test_quality_edges(spark, data):
    model = quality.train(*data)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a" * 300_000, "x"), (3, "a" * 300_000, "x"), (None, "the ing", "x")], "doc_id long, text string, score string")
    got = quality.score(df, model, out="s").collect()
    assert len(got) == 5 and got[0]["s"] == got[1]["s"] and got[2]["s"] == got[3]["s"]
    assert quality.score(df.limit(0), model, out="s").count() == 0
    none = quality.train(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["s"] for r in quality.score(df, none, out="s").collect()} == {0.5}


def test_language_held_out(spark, data):
    docs, _ = data
    model = language.train(docs)
    got = language.identify(docs, model).where(held_out("doc_id", 3, 1)).select("lang", "lang_id.*").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.95
    assert sum(r["rejected"] for r in got) == 0


def test_language_edges(spark, data):
    model = language.train(data[0])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!! 456"), (4, "the ing wher" * 100_000), (5, "lichkeit zuung")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(df, model).select("doc_id", "lang_id.*").collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["score"] == 0 and got[i]["rejected"] for i in (1, 2, 3))
    assert got[4]["lang_pred"] == "en" and got[5]["lang_pred"] == "de"
    assert language.identify(df.limit(0), model).count() == 0
    nothing = language.train(data[0].withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identify(df, nothing).select("lang_id.*").collect()} == {"und"}


def test_language_chunks_change_nothing(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdé -.\n1", k=3000))
    code = language._codes(text)
    plain = sorted(language._windows(code, 1 << 10).tolist())
    want = [code[i : i + n] for n in language.SIZES for i in range(len(code) - n + 1) if (code[i : i + n][1:-1] != 0).all() and (n > 1 or code[i] != 0)]
    assert len(plain) == len(want)
    for chunk in (2, 5, 64, 1 << 20):
        monkeypatch.setattr(language, "CHUNK", chunk)
        ids, n = language._counts(text, 1 << 10)
        assert np.repeat(ids, n).tolist() == plain


def test_language_learns_rare_and_long(spark):
    """A language of a few rows among many, and one whose texts are all longer than what is learned from."""
    rng = random.Random(4)
    say = lambda syllables, n: " ".join("".join(rng.choices(syllables, k=2)) for _ in range(n))
    rows = [(i, say(["the", "ing", "er"], 30), "en") for i in range(1500)] + [(2000 + i, say(["kka", "lla", "yö"], 40), "fi") for i in range(12)] + [(3000 + i, say(["ção", "lho", "nha"], 400), "pt") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.labelled(docs, rows_per_lang=100, max_chars=500)
    by = {k: [t for t, x in got if x == k] for k in ("en", "fi", "pt")}
    assert [len(by[k]) for k in ("en", "fi", "pt")] == [100, 12, 30] and {len(t) for t in by["pt"]} == {500}
    model = language.fit(got)
    assert language._scores([say(["kka", "lla", "yö"], 20), say(["ção", "lho", "nha"], 20), say(["the", "ing"], 20)], model)[0] == ["fi", "pt", "en"]


def test_language_against_a_plain_scorer(spark, data):
    """The same model over all windows of a text, one by one."""
    import math

    model = language.train(data[0])
    df = spark.createDataFrame([(1, "The wher-ing 12 tioner"), (2, "x"), (3, "Keit, keit ung sch " * 3)], "doc_id long, text string")
    for r in language.identify(df, model).select("text", "lang_id.*").collect():
        z = [float(b) for b in model.bias]
        windows = language._windows(language._codes(r["text"]), len(model.logits)).tolist()
        for w in windows:
            for k in range(len(z)):
                z[k] += float(model.logits[w, k]) / len(windows)
        e = [math.exp(x / model.temperature) for x in z]
        assert model.langs[e.index(max(e))] == r["lang_pred"] and abs(max(e) / sum(e) - r["score"]) < 1e-9


def test_quality_against_a_plain_scorer(spark, data):
    """The same model with compressors of its own and sums in plain Python."""
    import math

    import zstandard

    model = quality.train(*data)

    def size(content, block):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=model.level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block))

    df = spark.createDataFrame([(1, "theing erer whtion " * 60), (2, "the&&& ing%%%"), (3, None), (4, "é" * 700)], "doc_id long, text string")
    for r in quality.score(df, model, out="s").collect():
        raw = (r["text"] or "").encode()
        blocks = [raw[i : i + model.block] for i in range(0, max(len(raw), 1), model.block)]
        good, bad = [size(model.good, b) for b in blocks], [size(model.bad, b) for b in blocks]
        low = max(1, len(blocks) // 4)
        diff = sorted((b - g) / (b + g + 20) for g, b in zip(good, bad, strict=True))[:low]
        dense = sorted((g + b) / (2 * (len(x) + 20)) for g, b, x in zip(good, bad, blocks, strict=True))[:low]
        f = [(sum(bad) - sum(good)) / (sum(bad) + sum(good) + 20), sum(diff) / low, sum(dense) / low]
        f.append(min(f[2] - 0.45, 0))
        z = model.weights[0] + sum(w * (x - m) / c for w, x, m, c in zip(model.weights[1:], f, model.mean, model.scale, strict=True))
        assert abs(1 / (1 + math.exp(-z)) - r["s"]) < 1e-9


def test_stages_of_odd_columns_and_rows(spark, data, tmp_path):
    docs, labels = data
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    odd = docs.withColumn("a.b", F.lit(1)).withColumn("quality_score", F.lit("x")).withColumn("lang_id", F.lit("y")).withColumn("score", F.lit(2)).withColumn("back`quote", F.lit(3))
    odd = odd.unionByName(odd.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in odd.dtypes if c not in ("a.b", "back`quote")}))
    for stage in (quality.keep, language.keep):
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns and 0 < got.count() <= odd.count()
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_stages_keep_clean_documents(spark, data, tmp_path):
    docs, labels = data
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    kept = {r["doc_id"] for r in quality.keep(spark, docs, str(tmp_path)).collect()}
    assert len(good & kept) >= 0.98 * len(good) and len(kept - good) < 0.3 * (docs.count() - len(good))
    assert quality.keep(spark, docs, str(tmp_path)).columns == docs.columns
    assert language.keep(spark, docs, str(tmp_path)).count() == docs.count()
