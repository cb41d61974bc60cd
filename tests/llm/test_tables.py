"""Mixing, WARC, neighbours, roll-ups and the pipeline."""

import gzip
import html
import html.entities
import html.parser
import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facetloom.llm import mixing, neighbours, queries, rollup, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    value = lambda v: None if pd.isna(v) else float(v) if isinstance(v, int | float | np.number) else v
    plain = lambda df: sorted((tuple(map(value, r)) for r in df[cols].itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)


def test_mix(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "c", "d", None]) if i % 3 else "a") for i in range(600)] + [(7, "x y", "a"), (None, None, "b"), (None, "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slim, limits = mixing.plan(df, mixing.words("text"))
    got = mixing._with_limits(slim, limits).select("source", "size", "source_size", "target", (F.col("times__") * F.col("size")).alias("taken")).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["taken"]
    assert all(abs(t - g) <= 40 for t, g, _ in by.values())
    assert sum(g for _, g, _ in by.values()) == pytest.approx(sum(z for _, _, z in by.values()))
    out = mixing.mix(spark, df, "")
    assert out.columns == df.columns and out.select(F.sum(mixing.words("text"))).first()[0] == sum(t for t, _, _ in by.values())
    assert mixing.mix(spark, df.limit(0), "").count() == 0


def test_mix_of_null_ids_and_odd_columns(spark):
    """A source of null ids only, another of one id only, columns with names that the operator uses, dots and back quotes."""
    rng = random.Random(3)
    rows = [(None, " ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randint(1, 30))), "b") for _ in range(400)] + [(7, " ".join(f"v{rng.randrange(9999)}" for _ in range(rng.randint(1, 30))), "c") for _ in range(400)]
    rows += [(i, "x y z", "a") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("n__mix", "source__mix", "mix_source", "limit", "h", "a.b", "back`quote", "times__"):
        df = df.withColumn(c, F.lit(5))
    size = F.sum(mixing.words("text")).alias("n")
    slim, limits = mixing.plan(df, mixing.words("text"))
    targets = {r["source"]: r["target"] for r in limits.collect()}
    out = mixing.mix(spark, df, "")
    assert out.columns == df.columns and all(r == (5,) * 8 for r in out.drop("doc_id", "text", "source").distinct().collect())
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(size).collect()}
    assert all(abs(taken[k] - targets[k]) <= 30 for k in "abc")
    assert mixing.mix(spark, df.limit(0), "").columns == df.columns


def test_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 2.0), ("c", 0, 1.0)], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, F.col("weight")).collect()}
    assert got == {"a": 30.0, "b": 980.0, "c": 0.0}


def test_warc(spark, tmp_path):
    page = '<html><head><title>A &amp; B</title><style>p{}</style></head><body><p>x<br>y</p><script>"</p>"</script><a href="/l">link</a> &lt;z&gt;</body></html>'
    pages = spark.createDataFrame([(1, "http://h/", page, "k"), (2, None, None, "k"), (2, None, None, "k"), (None, "u", "é" * 200_000, "k")], "page_id long, url string, html string, block string")
    found = warc.derivatives(warc.responses(pages))
    got = {(r["key"], r["record_type"]): r for r in found.collect()}
    assert found.count() == 8 and got[1, "conversion"]["block"] == "A & B\nx\ny\nlink <z>"
    assert "title: A & B\r\n" in got[1, "metadata"]["block"] and "outlink: /l\r\n" in got[1, "metadata"]["block"]
    assert got[2, "conversion"]["content_length"] == 0 and got[None, "conversion"]["content_length"] == 400_000
    assert got[1, "metadata"]["refers_to"] == got[1, "conversion"]["refers_to"] != got[1, "metadata"]["record_id"]
    warc.write(found, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(back) == 8
    by = {r["headers"]["warc-record-id"]: r for r in back}
    for r in got.values():
        b = by[r["record_id"]]
        assert bytes(b["block"]).decode() == r["block"] and b["headers"]["warc-refers-to"] == r["refers_to"] and b["headers"]["warc-block-digest"] == r["block_digest"]
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


class Plain(html.parser.HTMLParser):
    """Text, title and links by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.in_title, self.title, self.links, self.out = 0, False, None, [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "title":
            self.in_title = True
        if tag == "a":
            self.links += [v or "" for k, v in attrs if k == "href"][:1]
        if re.fullmatch(warc.BLOCK, f"<{tag}>".replace('"', "")):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden -= 1
        if tag == "title":
            self.in_title = False
        if re.fullmatch(warc.BLOCK, f"</{tag}>"):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            data = re.sub(r"[ \t\r\n\f]+", " ", data)
            self.out.append(data)
            if self.in_title:
                self.title = (self.title or "") + data


def plain_page(page):
    p = Plain()
    p.feed(page)
    p.close()
    text = re.sub(" +", " ", "".join(p.out).replace("\u00a0", " "))
    return re.sub(r" ?\n[ \n]*", "\n", text).strip(" \n"), (p.title or "").strip(" "), p.links


def test_warc_pages_against_a_parser():
    rng = random.Random(6)
    bits = [
        "<p>", "</p>", "<br/>", "<div class='a > b'>", "</div>", "word ", "A &amp; B", "&copy;", "&#8212;", "&#x41;", "&eacute;", "&bogus;", " < ", " a > b ", "\n", "  ", "<b>", "</b>", "<!-- no <p> &amp; -->",
        '<a href="/x?a=1&amp;b=2">', "<a href='/y'>", "<a\nhref=/z>", '<a title="href=q" HREF = "/w">', "<a name=n>", "</a>", "<script>if (a < b) {'<p>'}</script>", "<style>p{}</style>", "&nbsp;", "&lt;i&gt;", "é字",
    ]
    for _ in range(400):
        page = "<html><head><title>T &amp; " + rng.choice(["x", "é", "&hellip;"]) + "</title></head><body>" + "".join(rng.choices(bits, k=rng.randint(0, 30))) + "</body></html>"
        title, links, text = warc.parse(page)
        assert (text, title, links) == plain_page(page), page
    names = list(html.entities.html5)
    assert all(warc._decoded(f"a&{n}b") == html.unescape(f"a&{n}b") for n in names if n.endswith(";"))
    assert all(warc._decoded(f"&#{i};") == html.unescape(f"&#{i};") and warc._decoded(f"&#x{i:x};") == html.unescape(f"&#x{i:x};") for i in [*range(300), 0xD800, 0xFDD0, 0xFFFE, 0x10FFFF, 0x110000])


def test_warc_takes_time_in_proportion():
    for page in ("<" * 10**6, "<a " * 300_000, "<!--" * 200_000, "<script>" * 100_000, "&" * 10**6, "<i> </i>" * 100_000, '<a href="' * 100_000, "<title>" * 100_000, " \n" * 400_000):
        start = time.monotonic()
        warc.parse(page)
        assert time.monotonic() - start < 20, page[:10]
    assert warc.parse("a < b and c > d <")[2] == "a < b and c > d <" and warc.parse("x<!-- y")[2] == "x" == warc.parse("x<script>y")[2]


def test_warc_odd_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/\r\nContent-Length: 3\r\n", "<p>one</p>"), (1, "u", "<p>a</p>"), (1, "u", "<p>b</p>")], "page_id long, url string, html string")
    found = warc.derivatives(warc.responses(pages))
    assert found.select("record_id").distinct().count() == 6
    warc.write(found.coalesce(1), str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(back) == 6 and {bytes(r["block"]).decode() for r in back if r["headers"]["warc-type"] == "conversion"} == {"one", "a", "b"}
    assert "http://h/%0D%0AContent-Length: 3%0D%0A" in {r["headers"]["warc-target-uri"] for r in back}
    raw = next((tmp_path / "w").glob("part-*")).read_bytes()
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.warc.gz").write_bytes(gzip.compress(raw[:400]) + gzip.compress(raw[400:]))
    assert sorted(bytes(r["block"]) for r in warc.read(spark, str(tmp_path / "z")).collect()) == sorted(bytes(r["block"]) for r in back)
    odd = b"WARC/1.1\r\nWARC-Type: a\r\nContent-Length: x\r\n\r\nfirst\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\ntwo\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\nWARC/1.0\r\nContent-Length: 99\r\n\r\ncut"
    assert [b for _, _, b in warc.records_of(odd)] == [b"first", b"two", b"", b"cut"]
    assert list(warc.records_of(b"")) == [] == list(warc.records_of(b"no record"))


def test_warc_of_null_fields(spark):
    records = spark.createDataFrame([(1, None, None, "d", None, "<p>x</p>")], "key long, record_id string, target_uri string, date string, headers string, payload string")
    found = warc.derivatives(records)
    got = {r["record_type"]: r for r in found.collect()}
    assert got["metadata"]["block"].startswith("via: \r\npayload-digest: sha256:") and got["conversion"]["block"] == "x"
    assert all(r["record_id"] and r["content_length"] == len(r["block"]) for r in got.values())
    assert all("x" in r["value"] or "via" in r["value"] for r in warc.as_text(found).collect())


def test_hilbert_is_a_curve():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = neighbours.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (2004, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    usable = neighbours.usable(df, "vec_id", "v")
    assert usable.distinct().count() == 1500
    got = neighbours.nearest(usable, usable.where("id % 20 = 0"), 10, window=0.05).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 1500, 20))
    recalls = []
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        s = x @ x[q]
        s[q] = -np.inf
        assert [r["rank"] for r in found] == list(range(1, 11)) and all(abs(s[r["vec_id"]] - r["score"]) < 1e-9 for r in found)
        assert sorted(found, key=lambda r: (-r["score"], r["vec_id"])) == found
        recalls.append(np.mean([r["score"] >= np.sort(s)[-10] - 1e-9 for r in found]))
    assert np.mean(recalls) >= 0.9
    few = neighbours.nearest(usable.where("id < 4"), usable.where("id = 0"), 10).collect()
    assert len(few) == 3
    assert neighbours.nearest(usable.limit(0), usable.limit(0), 10).count() == 0


@pytest.mark.parametrize("norms", ["one long", "lognormal"])
def test_neighbours_of_unequal_norms(spark, norms):
    """Recall with the production parameters, which curves, cells and bands must give where norms differ."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "one long":
        x[17] *= 100
    else:
        x *= np.exp(rng.standard_normal(len(x)))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = neighbours.nearest(df, df.where("id % 20 = 0"), 20).toPandas()
    hits = 0
    for q, found in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(found) == 20
        hits += (found["score"] >= np.sort(s)[-20] - 1e-9).sum()
    assert hits / (20 * 150) >= 0.93


def test_neighbours_ties(spark):
    """All inner products are 1: the smallest ids win, beyond any number of candidates that a block could keep."""
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1000)], "id long, v array<double>")
    for more in ({"window": 1.0}, {"window": 1.0, "block": 64, "tile": 1}):
        got = neighbours.nearest(df, df.where("id = 0"), 20, **more).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == list(range(1, 21)) and {r["score"] for r in got} == {1.0}


def test_neighbours_of_clusters(spark):
    """Recall by brute force, and a window that is far from all ranks where there is structure; tiles change nothing."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((100, 64))
    x = np.repeat(centres, 40, 0) + 0.2 * rng.standard_normal((4000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    seen = []
    plain = neighbours.measured_window
    neighbours.measured_window = lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1]
    try:
        got = neighbours.nearest(df, df.where("id % 20 = 0"), 20).toPandas()
        tiled = neighbours.nearest(df, df.where("id % 20 = 0"), 20, block=256, tile=8, window=seen[0]).toPandas()
    finally:
        neighbours.measured_window = plain
    assert seen[0] < 0.01
    hits = 0
    for q, found in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += (found["score"] >= np.sort(s)[-20] - 1e-9).sum()
    assert hits / (20 * 200) >= 0.9
    by = ["query_id", "rank"]
    assert got.sort_values(by).reset_index(drop=True).equals(tiled.sort_values(by).reset_index(drop=True))


def test_rollup(spark, tmp_path):
    df = spark.createDataFrame([("a", "en", 3, 4), ("a", "en", 5, 6), (None, None, None, 1)], "source string, lang string, n long, m long")
    r = rollup.Rollup(spark, "file://" + str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.commit("one", rollup.signed(df, 1, "v1", "n")) and not r.commit("one", rollup.signed(df, 1, "v1", "n"))
    r.commit("two", rollup.revised(df.where("source = 'a'"), ("v1", "n"), ("v2", "m")))
    want = {(None, None, "v1", 1, 0), ("a", "en", "v2", 2, 10)}
    assert {tuple(x) for x in r.totals().collect()} == want
    # A batch whose job died has no marker: it does not count, and is written anew.
    (tmp_path / "r" / r._folder("three").rsplit("/", 1)[1]).mkdir()
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == want and not r.commit("two", rollup.signed(df, 1, "v1", "n"))
    r.commit("three", rollup.signed(df.where("source is null"), -1, "v1", "n"))
    r.commit("empty", rollup.signed(df.limit(0), -1, "v1", "n"))
    assert {tuple(x) for x in r.totals().collect()} == {("a", "en", "v2", 2, 10)}
    r.compact()
    assert r.totals().count() == 1 and len(r.committed()) == 1


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(corpus_pipeline.cut(stage(spark, steps[-1], SF)))
        assert steps[-1].columns == docs.columns, name
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3] and len(ids[2]) > 0.7 * len(ids[0])
    out = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in steps[4].collect())


def plain_pipeline(spark, rows, labels, sf_dir):
    """The stages one document at a time: compressors and window sums of the models that the stages learn, all pairs of shingle sets, SQL for the mix, the tiktoken library."""
    import hashlib

    import public_tokenizers
    import tiktoken

    from facetloom.llm import bpe, jaccard, language, quality

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda x: spark.createDataFrame(x, schema)
    m = quality.train(frame(rows), labels)
    sizer, counts = quality._Sizer(m.good, m.bad, m.block, m.level), []

    def good(text):
        f = (quality._expand(np.array([sizer(text)])) - np.array(m.mean)) / np.array(m.scale)
        return 1 / (1 + np.exp(-(m.weights[0] + f @ np.array(m.weights[1:]))))[0] >= 0.3

    rows = [r for r in rows if good(r[1])]
    counts.append(len(rows))
    lm = language.train(frame(rows))

    def known(text):
        if not any(c.isalpha() for c in text or ""):
            return False
        w = language._windows(language._codes(text), len(lm.logits))
        z = (sum(lm.logits[i].astype(float) for i in w) / len(w) + lm.bias) / lm.temperature
        return np.exp(z - z.max()).max() / np.exp(z - z.max()).sum() >= lm.reject

    rows = [r for r in rows if known(r[1])]
    counts.append(len(rows))
    sets = [set(jaccard.shingles(r[1], 5).tolist()) for r in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    th = {r["text"]: r["h"] for r in frame(rows).selectExpr("text", "xxhash64(text) as h").collect()}
    best = {}
    for i, r in enumerate(rows):
        own = (group[i], True) if sets[i] else (i, None)
        rank = (r[0] is None, r[0] or 0, th[r[1]], i)
        best[own] = min(best.get(own, (rank, i)), (rank, i))
    rows = [rows[i] for _, i in best.values()]
    counts.append(len(rows))
    con = duckdb.connect()
    con.register("rows_", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}))
    con.execute("create table documents as select * from rows_")
    # The mix by its SQL, which keeps no text: the same query with it.
    taken = con.execute(mixing.OP3_SQL.replace("SELECT doc_id, source, coalesce(len", "SELECT doc_id, text, source, coalesce(len").replace("SELECT d.doc_id, d.size", "SELECT d.doc_id, d.text, d.size")).fetchall()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    out = []
    for doc_id, text, size, _, _, n in taken:
        ids = library.encode_ordinary(text)
        one = (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        out += [one] * (n // size if size else 0)
    return out, counts


def test_pipeline_against_a_plain_one(spark, tmp_path):
    rng = random.Random(12)
    rows, quality_of = [], []
    for i in range(220):
        syllables, lang = rng.choice([(["the", "ing", "er", "tion", "wh"], "en"), (["lich", "keit", "ung", "sch", "zu"], "de")])
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 60))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words if good else [w + rng.choice(["&&&", "%%%", "***"]) for w in words]), rng.choice([lang, None]), rng.choice(["a", "a", "b", "c", None]), 0))
        quality_of.append((i, int(good)))
    for _ in range(60):  # copies, near copies, repeated and null ids
        r = rng.choice(rows[:220])
        text = r[1] + rng.choice(["", " more", " the more"])
        rows.append((rng.choice([None, r[0], 1000 + len(rows)]), text, r[2], rng.choice(["a", "b", None]), 0))
    rows += [(5000, None, "en", "a", 0), (5001, "", None, "b", 0), (5002, "12 34 !!", "de", None, 0), (None, None, None, None, 0)]
    labels = spark.createDataFrame(quality_of, "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want, counts = plain_pipeline(spark, rows, labels, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len(rows) > counts[0] > counts[2] > 50
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_groups_stage_of_odd_columns(spark):
    from facetloom.llm import jaccard

    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long, 1, 2, 3), (2, long, 1, 2, 3), (2, "other words", 1, 2, 3), (2, "other words", 1, 2, 3), (None, None, 1, 2, 3)], "doc_id long, text string, `a.b` int, gone int, `back``quote` int")
    got = jaccard.keep(spark, df, "")
    assert got.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, long), (2, "other words"), (None, None)], key=repr)
    assert jaccard.keep(spark, df.limit(0), "").count() == 0
