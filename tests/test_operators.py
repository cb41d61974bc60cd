"""Golden cases and edges of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from facetloom.functions import text
from facetloom.operators import bitmaps, geo, graph, hashes, jsondocs, keyspace, lists, logs, scripts, search, sets, sketches, strings, timeseries, vectors, zsets
from facetloom.sources import snapshots


def one(df):
    return df.first()[0]


def test_string_ranges(spark):
    v = spark.createDataFrame([("Hello World",)], "value string")
    assert one(v.select(text.getrange(F.col("value"), 6, 10))) == "World"
    assert one(v.select(text.getrange(F.col("value"), -5, -1))) == "World"
    assert one(v.select(text.getrange(F.col("value"), 5, 2))) == ""
    assert one(v.select(text.setrange(F.col("value"), 6, "Spark"))) == "Hello Spark"
    assert one(v.select(text.setrange(F.col("value"), 13, "x"))) == "Hello World\0\0x"


def test_numbers_in_text(spark):
    v = spark.createDataFrame([("10",)], "value string")
    assert one(v.select(strings.incrby(F.col("value"), -11))) == "-1"
    assert one(v.select(strings.incrbyfloat(F.col("value"), 0.5))) == "10.5"
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.createDataFrame([(str(2**63 - 1),)], "value string").select(strings.incrby(F.col("value"), 1)).collect()


def test_lcs_digest_and_slot(spark):
    v = spark.createDataFrame([("ohmytext", "mynewtext")], "a string, b string")
    got = v.select(text.lcs(F.col("a"), F.col("b")).alias("l")).select("l.*").first()
    assert (got["lcs"], got["len"]) == ("mytext", 6)
    assert [(m["a_start"], m["a_end"], m["b_start"], m["b_end"]) for m in got["matches"]] == [(4, 7, 5, 8), (2, 3, 0, 1)]
    assert one(spark.createDataFrame([("",)], "a string").select(text.xxh3(F.col("a")))) == "2d06800538d394c2"
    keys = spark.createDataFrame([("123456789",), ("{user1}.x",), ("user1",), ("{}x",)], "k string")
    slots = [r[0] for r in keys.select(text.key_slot(F.col("k"))).collect()]
    assert slots[0] == 0x31C3 % 16384 and slots[1] == slots[2]


def test_globs():
    import re

    for pattern, yes, no in (("h?llo", "hello", "hllo"), ("h[ae]llo", "hallo", "hillo"), ("h[^e]llo", "hallo", "hello"), ("a\\*b", "a*b", "axb"), ("*", "", None), ("[a-c]x", "bx", "dx")):
        assert re.match(text.glob_regex(pattern), yes)
        assert no is None or not re.match(text.glob_regex(pattern), no)


def test_set_conditions(spark):
    kv = spark.createDataFrame([("a", "1", None), ("b", "2", 7)], "key string, value string, expire_at long")
    delta = spark.createDataFrame([("a", "x", 5, "1"), ("b", "y", 5, "1"), ("c", "z", 5, "1")], "key string, value string, expire_at long, op string")
    got = lambda *a, **k: sorted(map(tuple, strings.set_(kv, delta, *a, **k).collect()))
    assert got("nx") == [("a", "1", None), ("b", "2", 7), ("c", "z", 5)]
    assert got("xx") == [("a", "x", 5), ("b", "y", 5)]
    assert got("ifeq", F.col("op")) == [("a", "x", 5), ("b", "2", 7)]
    assert got("ifne", F.col("op")) == [("a", "1", None), ("b", "y", 5), ("c", "z", 5)]
    assert got("ifdeq", F.lit("x")) == [("a", "1", None), ("b", "2", 7)]
    assert got(keep_ttl=True) == [("a", "x", None), ("b", "y", 7), ("c", "z", 5)]


def test_keyspace(spark):
    kv = spark.createDataFrame([("a", "1", None), ("b", "2", 7)], "key string, value string, expire_at long")
    assert sorted(map(tuple, keyspace.rename(kv, "a", "b").select("key", "value").collect())) == [("b", "1")]
    assert sorted(map(tuple, keyspace.rename(kv, "a", "b", only_new=True).select("key", "value").collect())) == [("a", "1"), ("b", "2")]
    assert sorted(map(tuple, keyspace.rename(kv, "none", "b").select("key", "value").collect())) == [("a", "1"), ("b", "2")]
    assert keyspace.copy(kv, "a", "b").count() == 2
    assert sorted(map(tuple, keyspace.copy(kv, "a", "b", replace=True).select("key", "value").collect())) == [("a", "1"), ("b", "1")]
    mixed = spark.createDataFrame([("k", "10"), ("k", "x"), ("k", "9")], "key string, elem string")
    assert [r["elem"] for r in keyspace.sort(mixed).orderBy("rank").collect()] == ["x", "9", "10"]
    assert [r["elem"] for r in keyspace.sort(mixed, alpha=True, desc=True).orderBy("rank").collect()] == ["x", "9", "10"]


def test_lists(spark):
    e = spark.createDataFrame([], "key string, pos long, elem string")
    new = lambda *x: spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "key string, place int, elem string")
    show = lambda df: [r["elem"] for r in df.orderBy("pos").collect()]
    x = lists.push(lists.push(e, new("one")), new("three", "two"), left=True)
    assert show(x) == ["two", "three", "one"]
    assert show(lists.push(e, new("a"), only_existing=True)) == []
    taken, rest = lists.pop(x, 2, left=False)
    assert [r["elem"] for r in taken.orderBy("rank").collect()] == ["one", "three"] and show(rest) == ["two"]
    assert show(lists.lmove(x, "k", "k", True, False)) == ["three", "one", "two"]
    y = lists.push(e, new("a", "b", "a", "c", "a"))
    assert show(lists.lrem(y, -2, "a")) == ["a", "b", "c"]
    assert show(lists.lrem(y, 0, "a")) == ["b", "c"]
    assert [r["pos"] for r in lists.lpos(y, "a", rank=-1, count=2).orderBy("match").collect()] == [4, 2]
    assert [r["pos"] for r in lists.lpos(y, "a", rank=2).collect()] == [2]
    assert show(lists.linsert(y, "b", "X", before=False)) == ["a", "b", "X", "a", "c", "a"]


def test_hashes(spark):
    h = spark.createDataFrame([("k", "a", "1"), ("k", "b", "2")], "key string, field string, value string")
    d = spark.createDataFrame([("k", "b", "9"), ("k", "c", "3")], "key string, field string, value string")
    assert hashes.added(h, d).first()["n"] == 1
    assert sorted(r["value"] for r in hashes.hset(h, d).collect()) == ["1", "3", "9"]
    assert sorted(r["value"] for r in hashes.hsetnx(h, d).collect()) == ["1", "2", "3"]
    assert hashes.hsetex(h, d, "fnx").count() == 2 and hashes.hsetex(h, d, "fxx").count() == 2
    assert {r["field"]: r["value"] for r in hashes.hincrbyfloat(h, "a", 0.5).collect()}["a"] == "1.5"
    assert hashes.hrandfield(h, -5, 1).count() == 5 and hashes.hrandfield(h, 5, 1).count() == 2


def test_sets(spark):
    s = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "y"), ("c", "z")], "key string, member string")
    members = lambda df: sorted(r["member"] for r in df.collect())
    assert members(sets.sinter(s, ["a", "b", "c"])) == ["y"] and members(sets.sdiff(s, ["a", "b"])) == ["x"] and members(sets.sdiff(s, ["a", "a"])) == []
    assert members(sets.sunion(s, ["a", "c"])) == ["x", "y", "z"] and members(sets.sinter(s, ["a", "none"])) == []
    taken, rest = sets.spop(s, 1, 3)
    assert taken.count() == 3 and rest.count() == 2


def test_sorted_sets(spark):
    z = spark.createDataFrame([("k", "one", 1.0), ("k", "two", 2.0), ("k", "three", 3.0)], "key string, member string, score double")
    up = zsets.zadd(z, spark.createDataFrame([("k", "one", 1.5)], "key string, member string, score double"))
    r = {x["member"]: (x["rank"], x["revrank"]) for x in zsets.zrank(up).collect()}
    assert r == {"one": (0, 2), "two": (1, 1), "three": (2, 0)}
    assert zsets.zcount(up, 1, 2).first()["n"] == 2
    assert {x["member"]: x["score"] for x in zsets.zincrby(up, spark.createDataFrame([("k", "one", 2.0)], "key string, member string, by double")).collect()}["one"] == 3.5
    new = spark.createDataFrame([("k", "one", 0.0), ("k", "four", 4.0)], "key string, member string, score double")
    s = lambda **k: {x["member"]: x["score"] for x in zsets.zadd(z, new, **k).collect()}
    assert s(exist="nx")["one"] == 1 and s(exist="nx")["four"] == 4 and "four" not in s(exist="xx") and s(compare="gt")["one"] == 1 and s(compare="lt")["one"] == 0
    with pytest.raises(ValueError):
        zsets.zlexcount(z, "a", "+")


def test_bitmaps(spark):
    b = spark.createDataFrame([("k", i) for i in (0, 1, 2, 5, 9)], "key string, offset long")
    assert one(bitmaps.bitpos(b, 0).select("pos")) == 3 and one(bitmaps.bitpos(b, 1, 6).select("pos")) == 9 and one(bitmaps.bitpos(b, 1, 10).select("pos")) == -1
    v = spark.createDataFrame([(bytearray(b"\xf0\x0f"),)], "v binary")
    got = v.select(bitmaps.bitfield_get(F.col("v"), "u4", 0), bitmaps.bitfield_get(F.col("v"), "i4", 0), bitmaps.bitfield_get(F.col("v"), "u8", 12), bitmaps.bits_of(F.col("v"))).first()
    assert tuple(got)[:3] == (15, -1, 240) and got[3] == [0, 1, 2, 3, 12, 13, 14, 15]
    assert bytes(one(v.select(bitmaps.bitfield_set(F.col("v"), "u8", 4, F.lit(171))))) == b"\xfa\xbf"
    f = spark.range(1).select(*(bitmaps.bitfield_incrby(F.lit(250).cast("long"), "u8", 10, o).alias(o) for o in ("wrap", "sat", "fail"))).first()
    assert tuple(f) == (4, 255, None)


def test_sketches(spark):
    x = spark.range(1, 1001).select(F.lit("k").alias("key"), F.col("id").cast("double").alias("v"))
    q = sketches.quantiles(x, ["key"], "v", [0.9], exact=False).first()["quantiles"][0]
    assert abs(q - 900) < 50
    assert sketches.rank(x, ["key"], "v", 501.0).first()["rank"] in (500, 501)
    assert sketches.trimmed_mean(x, ["key"], "v", 0.1, 0.9).first()["mean"] == pytest.approx(500.5)
    with_n = sketches.topk(x.withColumn("i", F.col("id") if "id" in x.columns else F.col("v") % 3), ["key"], "i", 1)
    assert with_n.first()["n"] == 334


def test_time_series(spark):
    x = spark.createDataFrame([("s", i * 100, float(i)) for i in range(1, 101)], "series string, ts_ms long, value double")
    got = timeseries.aggregate(x, "avg", 1000, 100, 10_000).orderBy("bucket").collect()
    assert len(got) == 10 and got[0]["bucket"] == 100
    assert timeseries.between(x, 200, 500).count() == 4
    alone = spark.createDataFrame([("s", 5, 3.0)], "series string, ts_ms long, value double")
    assert timeseries.aggregate(alone, "stds", 10, 0, 10).first()["value"] == 0.0 and timeseries.aggregate(alone, "twa", 10, 0, 10).first()["value"] == 3.0
    twice = spark.createDataFrame([("s", 5, 3.0, 1), ("s", 5, 4.0, 2)], "series string, ts_ms long, value double, event_id long")
    with pytest.raises(Exception, match="exists"):
        timeseries.add(twice, "block").collect()


def test_logs(spark):
    x = spark.createDataFrame([("k", 5, 0, "a"), ("k", 5, 1, "b"), ("k", 7, 0, "c")], "key string, ms long, seq long, v string")
    assert [r["v"] for r in logs.xrange(x, "5-1", "7").orderBy("ms", "seq").collect()] == ["b", "c"]
    assert logs.xread(x, "$").count() == 0
    added = logs.xadd(x, spark.createDataFrame([("k", 7, "d"), ("k", 7, "e"), ("n", 1, "f")], "key string, ms long, v string"))
    assert {(r["key"], r["ms"], r["seq"]) for r in added.collect()} >= {("k", 7, 1), ("k", 7, 2), ("n", 1, 0)}
    with pytest.raises(Exception, match="larger"):
        logs.xadd(x, spark.createDataFrame([("k", 1, "d")], "key string, ms long, v string")).collect()


def test_json(spark):
    j = spark.createDataFrame([("k", '{"a":{"b":1},"l":[1,2,3],"s":"x"}')], "key string, doc string")
    doc = lambda df: df.first()["doc"]
    assert doc(jsondocs.set_(j, "$.a.c", [True])) == '{"a":{"b":1,"c":[true]},"l":[1,2,3],"s":"x"}'
    assert doc(jsondocs.set_(j, "$.s", "y", "nx")) == doc(j) and doc(jsondocs.set_(j, "$.z", 1, "xx")) == doc(j)
    assert doc(jsondocs.arrtrim(j, "$.l", 2, 1)).count("[]") == 1 and '"l":[1,3]' in doc(jsondocs.arrpop(j, "$.l", 1))
    assert jsondocs.delete(j).count() == 0
    assert one(j.select(jsondocs.arrindex("$.l", "3", 1))) == 2 and one(j.select(jsondocs.arrindex("$.l", "1", 1))) == -1


def test_bloom_grows_past_its_capacity(spark):
    """2,000 to 64,000 items in filters for 1,000: none is lost, others are found by the error, and the number of items is known."""
    x = spark.range(64_000).selectExpr("explode(array('a', 'b', 'c', null)) as key", "id as item").where("key is null and id < 3000 or key = 'a' or key = 'b' and id < 1000 or key = 'c' and id < 2001")
    bits = sketches.bloom(x.unionByName(x), ["key"], "item", 1000).cache()
    n = {r["key"]: r["n"] for r in sketches.bloom_card(bits, ["key"], 1000).collect()}
    assert n == {k: pytest.approx(v, rel=0.03) for k, v in (("a", 64_000), ("b", 1000), ("c", 2001), (None, 3000))}
    found = lambda items: sketches.bloom_exists(bits, ["key"], items, "item", 1000)
    mine = found(x.where("key is not null"))
    assert mine.where("not found or found is null").count() == 0 and mine.count() == 67_001
    shares = [r["share"] for r in found(x.where("key is not null").withColumn("item", -1 - F.col("item"))).groupBy("key").agg(F.avg(F.col("found").cast("int")).alias("share")).collect()]
    assert len(shares) == 3 and max(shares) <= 0.03
    assert not found(spark.createDataFrame([("z", 1)], "key string, item long")).first()["found"]


def test_bloom_merges_different_numbers_of_parts(spark):
    x = spark.range(5000).selectExpr("id as item")
    few, many = (sketches.bloom(x.where(c), [], "item", 1000) for c in ("item < 1000", "item >= 1000"))
    both = few.unionByName(many).distinct()
    assert sketches.bloom_exists(both, [], x, "item", 1000).where("found").count() == 5000
    assert sketches.bloom_card(both, [], 1000).first()["n"] == pytest.approx(5000, rel=0.03)


def test_bloom_info_of_grown_filters(spark):
    x = spark.range(64_000).selectExpr("explode(array('a', 'b', 'c', null)) as key", "id as item").where("key is null and id < 3000 or key = 'a' or key = 'b' and id < 1000 or key = 'c' and id < 2001")
    bits = sketches.bloom(x, ["key"], "item", 1000)
    info = {r["key"]: r for r in sketches.bloom_info(bits.unionByName(sketches.bloom(x.where("key = 'c' and item < 10"), ["key"], "item", 1000)).distinct(), ["key"], 1000).collect()}
    assert {k: r["parts"] for k, r in info.items()} == {"a": 64, "b": 1, "c": 5, None: 4}
    assert all((r["capacity"], r["size"], r["hashes"]) == (1000, 9586, 7) and 0 < r["most_set"] < 0.6 * r["size"] for r in info.values())
    assert {k: r["bits_set"] for k, r in info.items() if k == "b"} == {"b": bits.where("key = 'b'").count()} and info["a"]["bits_set"] > 50 * info["a"]["most_set"]


def test_geo(spark):
    p = spark.createDataFrame([("k", "palermo", 13.361389, 38.115556), ("k", "catania", 15.087269, 37.502669)], "key string, member string, lon double, lat double")
    assert geo.dist(p, "palermo", "catania").first()["dist"] == pytest.approx(166274.15, abs=1)
    assert [r["member"] for r in geo.radius(p, 15.0, 37.0, 100, "km").collect()] == ["catania"]
    assert geo.radius(p, 15.0, 37.0, 200, "km", count=1).first()["member"] == "catania"


@pytest.mark.parametrize("reach", [0.0, 40, 300, 2500, 12000, 30000])
def test_geo_by_member_against_all_pairs(spark, reach):
    spots = [(i * 61.7 % 360 - 180, i * 37.3 % 170 - 85) for i in range(150)]
    spots += [(lon, lat) for lon in (-180.0, -179.999, 179.9, 180.0, 0.0, 359.0) for lat in (-90.0, -89.0, -0.01, 0.0, 65.0, 87.2, 88.5, 90.0)]
    p = spark.createDataFrame([("k", f"m{i}", *at) for i, at in enumerate(spots)] + [("other", "m0", *spots[0]), ("k", "none", None, 1.0), ("k", "nan", math.nan, 1.0), ("k", "inf", math.inf, -math.inf)], "key string, member string, lon double, lat double")
    a, b = p.alias("a"), p.selectExpr("key", "member as other", "lon as lon2", "lat as lat2").alias("b")
    want = a.join(b, "key").withColumn("dist", geo.distance(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"), "km")).where(F.col("dist") <= reach).select("key", "member", "other", "dist")
    assert sorted(geo.radius_by_member(p, p, reach, "km").collect()) == sorted(want.collect())


def test_geo_by_member_divides_bands(spark):
    """Places of one latitude all round the globe are compared with those near them, not with all of the band."""
    p = spark.range(2000).selectExpr("'k' as key", "concat('m', id) as member", "id * 0.18D - 180 as lon", "0.5D as lat")
    distance = geo.distance
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(geo, "distance", lambda *a: distance(*a) * 0)
        compared = geo.radius_by_member(p, p, 300, "km").count()
    assert compared < 2000 * 2000 / 20


def test_vectors(spark):
    v = spark.createDataFrame([("k", 1, "a", [1.0, 0.0]), ("k", 2, "b", [0.0, 1.0]), ("k", 3, "c", [0.707, 0.707])], "key string, id long, name string, v array<double>")
    assert [r["name"] for r in vectors.search(v, [1.0, 0.0], 2).collect()] == ["a", "c"]
    with pytest.raises(Exception, match="dimension"):
        vectors.vadd(v, spark.createDataFrame([("k", 4, "d", [1.0])], v.schema)).collect()
    assert vectors.by_element(v, v.select("id"), 1, same_key=False).count() == 3


def test_search(spark):
    d = spark.createDataFrame([("doc:1", "Hello World", "This is a test document."), ("doc:2", "Another Document", "Hello from another doc.")], "id string, title string, body string")
    i = search.Index.create(d, "id", {"title": 5.0, "body": 1.0})
    found = i.search("hello").collect()
    assert len(found) == 2 and found[0]["id"] == "doc:1"
    assert i.search(i.phrase(["another", "doc"])).count() == 1 and i.search(i.phrase(["hello", "from", "another"])).count() == 1 and i.search(i.phrase(["world", "hello"])).count() == 0
    assert i.search("").count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r"), ("d", "a", "r")], "src string, dst string, rel string")
    n = spark.createDataFrame([(x, "l") for x in "abcd"], "id string, label string")
    p = graph.shortest_paths(e, n.where("id = 'a'"), n.where("id = 'd'")).first()
    assert p["path"] == ["a", "b", "c", "d"] and p["hops"] == 3
    assert graph.all_paths(e, "a", "c", 2).count() == 0 and graph.all_paths(e, "a", "c", 3).count() == 1
    left, edges = graph.delete_nodes(n, e, F.col("id") == "b")
    assert left.count() == 3 and edges.count() == 2


def test_transactions():
    facets, versions = {"a": 1}, {}
    t = scripts.Transaction(facets, versions)
    t.watch("a")
    t.queue("a", lambda x: x + 1)
    t.commit()
    assert facets["a"] == 2 and versions["a"] == 1
    t.watch("a")
    versions["a"] = 9
    t.queue("a", lambda x: x + 1)
    with pytest.raises(scripts.Conflict):
        t.commit()
    assert facets["a"] == 2


def test_snapshots_and_commands(spark, tmp_path):
    kv = spark.createDataFrame([("a", "1", None), ("b", "2", 5)], "key string, value string, expire_at long")
    snapshots.save({"kv": kv}, str(tmp_path / "s"))
    assert [r["key"] for r in snapshots.load(spark, str(tmp_path / "s"), ["kv"], 10)["kv"].collect()] == ["a"]
    raw = b""
    for c in (["SET", "a", "1"], ["SET", "a", "2"], ["RPUSH", "l", "x", "y"], ["RPUSH", "l", "z"], ["SADD", "s", "m"], ["HSET", "h", "f", "v"], ["ZADD", "z", "1.5", "m"]):
        raw += b"*%d\r\n" % len(c) + b"".join(b"$%d\r\n%s\r\n" % (len(x), x.encode()) for x in c)
    (tmp_path / "log").write_bytes(raw)
    got = snapshots.replay(snapshots.read_commands(spark, str(tmp_path / "log")))
    assert got["string"].first()["value"] == "2" and [r["elem"] for r in got["list"].orderBy("pos").collect()] == ["x", "y", "z"]
    assert got["zset"].first()["score"] == 1.5 and got["hash"].count() == 1 and math.isclose(got["set"].count(), 1)


def test_more_of_the_families(spark):
    kv = spark.createDataFrame([("a", "1", None), ("b", "2", 7)], "key string, value string, expire_at long")
    delta = spark.createDataFrame([("a", "x", 5, 0), ("c", "z", 5, 1)], "key string, value string, expire_at long, place int")
    assert strings.msetex(kv, delta, "nx").count() == 2 and strings.msetex(kv, delta.where("key = 'a'"), "xx").where("value = 'x'").count() == 1 and strings.msetex(kv, delta, "xx").where("value = 'x'").count() == 0
    assert strings.getex(kv, ["b"], F.lit(None)).where("expire_at is null").count() == 2
    h = spark.createDataFrame([("k", "a", "1", 5000), ("k", "b", "2", None)], "key string, field string, value string, expire_at long")
    assert {r["field"]: r["ttl"] for r in hashes.httl(h, 1000).collect()} == {"a": 4, "b": -1}
    assert hashes.hpersist(h, ["a"]).where("expire_at is null").count() == 2
    x = spark.createDataFrame([("k", 5, 0), ("k", 7, 1)], "key string, ms long, seq long")
    none = spark.createDataFrame([], "key string, grp string, ms long, seq long")
    g = logs.group_create(none, x, "g", "$")
    assert tuple(g.first()) == ("k", "g", 7, 1) and tuple(logs.group_setid(g, "g", "5").first())[2:] == (5, 0)
    new, after, pending = logs.xreadgroup(x, logs.group_create(none, x, "g", "0"), F.lit("c"), 100)
    assert new.count() == 2 and tuple(after.first())[2:] == (7, 1) and logs.consumers(pending, 150).first()["idle"] == 50
    assert logs.xackdel(x, pending, pending.where("ms = 5"))[0].count() == 1 and logs.history(x, pending, "c").count() == 2
    p = spark.createDataFrame([("k", "m", 1.0, 2.0)], "key string, member string, lon double, lat double")
    q = spark.createDataFrame([("k", "m", 3.0, 4.0), ("k", "n", 5.0, 6.0)], p.schema)
    assert geo.add(p, q, "nx").where("lon = 1").count() == 1 and geo.add(p, q, "xx").count() == 1 and geo.store(geo.radius(p, 1.0, 2.0, 10), "out", True).first()["score"] == 0.0
    m = spark.createDataFrame([("s", 10, "last")], "series string, retention_ms long, policy string")
    assert tuple(timeseries.alter(m, spark.createDataFrame([("s", None, "max")], m.schema)).first()) == ("s", 10, "max")
    d = spark.createDataFrame([("1", "alpha beta"), ("2", "beta gamma")], "id string, body string")
    i = search.Index.create(d, "id", {"body": 1.0})
    j = i.add(spark.createDataFrame([("1", "delta only")], d.schema), "id")
    assert j.search("alpha").count() == 0 and j.search("delta").count() == 1 and j.remove(d.where("id = '2'").select("id")).search("beta").count() == 0
    assert keyspace.digest(kv).first()[0] == keyspace.digest(kv.orderBy(F.desc("key"))).first()[0]


def test_empty_facets(spark):
    z = spark.createDataFrame([], "key string, member string, score double")
    s = spark.createDataFrame([], "key string, member string")
    t = spark.createDataFrame([], "series string, ts_ms long, value double, event_id long")
    for df in (zsets.zrank(z), zsets.zunion(z, ["a", "b"]), zsets.zrange(z, -2, -1), sets.sinter(s, ["a"]), timeseries.aggregate(t, "twa", 10, 0, 100), timeseries.latest(t), sketches.topk(s, ["key"], "member", 3)):
        assert df.count() == 0


def test_deltas_that_repeat_a_key(spark):
    zs = spark.createDataFrame([("k", "a", 5.0)], "key string, member string, score double")
    twice = spark.createDataFrame([("k", "a", 7.0, 0), ("k", "a", 3.0, 1), ("k", "b", 2.0, 0), ("k", "b", 9.0, 1)], "key string, member string, score double, place int")
    scores = lambda df: {r["member"]: r["score"] for r in df.collect()}
    assert scores(zsets.zadd(zs, twice, place="place")) == {"a": 3.0, "b": 9.0} and zsets.zadd(zs, twice).count() == 2
    assert scores(zsets.zadd(zs, twice, compare="gt")) == {"a": 7.0, "b": 9.0} and scores(zsets.zadd(zs, twice, compare="lt")) == {"a": 3.0, "b": 2.0}
    assert scores(zsets.zadd(zs, twice, exist="nx", place="place")) == {"a": 5.0, "b": 2.0} and scores(zsets.zadd(zs, twice, exist="xx", place="place")) == {"a": 3.0}
    h = spark.createDataFrame([("k", "a", "1")], "key string, field string, value string")
    new = spark.createDataFrame([("k", "b", "y", 1), ("k", "b", "x", 0), ("k", "a", "z", 0)], "key string, field string, value string, place int")
    assert {(r["field"], r["value"]) for r in hashes.hsetnx(h, new, "place").collect()} == {("a", "1"), ("b", "x")}
    log = spark.createDataFrame([("k", "a", 2), ("k", "a", 3), ("k", "c", 4)], "key string, field string, by int")
    assert {(r["field"], r["value"]) for r in hashes.hincrby(h.unionByName(spark.createDataFrame([("k", "t", "no number")], h.schema)), log).collect()} == {("a", "6"), ("c", "4"), ("t", "no number")}


def test_documents_that_are_no_json(spark):
    js = spark.createDataFrame([("a", "{bad"), ("b", '{"n":9007199254740993}'), ("c", None)], "key string, doc string")
    got = {r["key"]: r["doc"] for r in jsondocs.numincrby(js, "$.n", 1).collect()}
    assert got == {"a": "{bad", "b": '{"n":9007199254740994}'}


def test_subsequences_against_a_table():
    import random

    from facetloom.functions.text import _lcs

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(2))
        found, ranges = _lcs(a, b)
        assert len(found) == plain(a, b) and found == "".join(a[r[0] : r[1] + 1] for r in reversed(ranges)) == "".join(b[r[2] : r[3] + 1] for r in reversed(ranges))


def test_nearest_elements_by_parts(spark):
    import numpy as np

    from facetloom.operators import vectors

    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    x[7] = 0
    df = spark.createDataFrame([("a" if i % 3 else None, i, v.tolist()) for i, v in enumerate(x)], "key string, id long, v array<double>")
    for same in (True, False):
        got = vectors.by_element(df, df.where("id < 40"), 4, same_key=same, rows=16).collect()
        for q in range(40):
            norm = np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])
            s = np.divide(x @ x[q], norm, out=np.zeros(300), where=norm > 0)
            s[[i for i in range(300) if i == q or (same and (i % 3 == 0) != (q % 3 == 0))]] = -np.inf
            mine = sorted((r for r in got if r["query"] == q), key=lambda r: (-r["score"], r["id"]))
            assert np.allclose([r["score"] for r in mine], np.sort(s)[::-1][:4])


def test_paths_have_no_bound(spark):
    from facetloom.operators import graph

    edges = spark.createDataFrame([(str(i), str(i + 1), "n") for i in range(24)], "src string, dst string, rel string")
    starts = spark.createDataFrame([("0",)], "id string")
    assert graph.shortest_paths(edges, starts).agg({"hops": "max"}).first()[0] == 24
    assert graph.shortest_paths(edges, starts, most=3).count() == 4
