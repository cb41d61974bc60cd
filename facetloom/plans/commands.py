"""Queries on single commands of all families that the other plans do not exercise: each beside the SQL that says what it returns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.functions import text
from facetloom.operators import bitmaps, geo, graph, hashes, jsondocs, keyed, keyspace, logs, pubsub, scripts, search, sets, sketches, strings, timeseries, vectors, zsets
from facetloom.sources import facets as f
from facetloom.sources import shared, snapshots
from facetloom.sources.facets import sql
from facetloom.streaming import windows

C = F.col
QUERIES: dict[str, tuple] = {}


def query(name: str, body: str, uses: str = ""):
    def add(fn):
        QUERIES[name] = (fn, sql(uses, body) if uses else body)
        return fn

    return add


def _long(x) -> F.Column:
    return F.lit(x).cast("long")


def _keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(k,) for k in keys], "key string")


# Strings.


@query("str_get", "SELECT key, value FROM kv WHERE key = 'cust:7'", "kv")
def _(s, d):
    return strings.get(f.kv(s, d), "cust:7")


@query("str_strlen", "SELECT key, strlen(value)::INT AS n FROM kv", "kv")
def _(s, d):
    return f.kv(s, d).select("key", strings.strlen(C("value")).alias("n"))


for _name, _keep in (("str_setex", False), ("str_set_keepttl", True)):
    _expire = "CASE WHEN n::BIGINT % 7 = 0 THEN 100000 + n::BIGINT * 1000 ELSE expire_at END" if not _keep else "expire_at"

    @query(_name, f"SELECT key, CASE WHEN n::BIGINT % 7 = 0 THEN 'E' ELSE value END AS value, {_expire} AS expire_at FROM kv", "kv")
    def _(s, d, keep=_keep):
        kv = f.kv(s, d)
        delta = kv.where(C("n").cast("long") % 7 == 0).select("key", F.lit("E").alias("value"), (_long(100_000) + C("n").cast("long") * 1000).alias("expire_at"))
        return strings.set_(kv, delta, keep_ttl=keep)


@query("str_set_ifdeq", "SELECT key, CASE WHEN value = 'BUILDING' THEN 'X' ELSE value END AS value FROM kv", "kv")
def _(s, d):
    kv = f.kv(s, d)
    return strings.set_(kv, kv.select("key", F.lit("X").alias("value"), _long(None).alias("expire_at")), "ifdeq", text.xxh3(F.lit("BUILDING"))).select("key", "value")


#: XXH3-64 of the five values, by the reference implementation of that hash; fixed values.
_DIGESTS = {"AUTOMOBILE": "7672e52dcbca6970", "BUILDING": "404a7d539088442f", "FURNITURE": "08ed369cd8cd7760", "HOUSEHOLD": "5cdf6cbdf03bf48d", "MACHINERY": "42925cbf0dad5d80"}


@query("str_digest", f"SELECT key, digest FROM kv JOIN (VALUES {', '.join(map(str, _DIGESTS.items()))}) t(v, digest) ON value = v", "kv")
def _(s, d):
    return f.kv(s, d).select("key", text.xxh3(C("value")).alias("digest"))


@query("str_mset", "SELECT key, 'b' || n AS value FROM kv WHERE n::BIGINT % 9 = 0 UNION ALL SELECT key, value FROM kv WHERE n::BIGINT % 9 <> 0 UNION ALL SELECT 'new', 'z' FROM (SELECT 1)", "kv")
def _(s, d):
    kv = f.kv(s, d)
    twice = F.inline(F.array(F.struct(F.concat(F.lit("b"), "n").alias("value"), F.lit(1).alias("place")), F.struct(F.lit("a").alias("value"), F.lit(0).alias("place"))))
    delta = kv.where(C("n").cast("long") % 9 == 0).select("key", twice).unionByName(s.createDataFrame([("new", "y", 0), ("new", "z", 5)], "key string, value string, place int"))
    return strings.mset(kv.select("key", "value"), delta)


@query("str_getset", "SELECT key, value AS old FROM kv WHERE key IN ('cust:3', 'cust:4') UNION ALL SELECT 'none', NULL", "kv")
def _(s, d):
    kv = f.kv(s, d)
    return strings.getset(kv, _keys(kv, "cust:3", "cust:4", "none"))


@query("str_getex", "SELECT key, value, CASE WHEN key IN ('cust:3', 'cust:4') THEN 777 ELSE expire_at END AS expire_at FROM kv", "kv")
def _(s, d):
    return strings.getex(f.kv(s, d).select("key", "value", "expire_at"), ["cust:3", "cust:4"], F.lit(777))


for _rule, _took in (("nx", False), ("xx", True)):

    @query(f"str_msetex_{_rule}", "SELECT key, " + ("CASE WHEN key IN ('cust:3', 'cust:4') THEN 'M' ELSE value END" if _took else "value") + " AS value, " + ("CASE WHEN key IN ('cust:3', 'cust:4') THEN 9 ELSE expire_at END" if _took else "expire_at") + " AS expire_at FROM kv", "kv")
    def _(s, d, rule=_rule):
        kv = f.kv(s, d).select("key", "value", "expire_at")
        delta = _keys(kv, "cust:3", "cust:4").select("key", F.lit("M").alias("value"), _long(9).alias("expire_at"), F.lit(0).alias("place"))
        return strings.msetex(kv, delta, rule)


_OTHER = "AUTOMOBILE BUILDING"
_ROW = f"list_prepend(0, list_transform(range(1, {len(_OTHER) + 1}), lambda j: list_max(list_transform(range(1, j + 1), lambda t: greatest(CASE WHEN '{_OTHER}'[t] = value[i + 1] THEN r[t] + 1 ELSE 0 END, r[t + 1])))))"


@query("str_lcs", "WITH RECURSIVE v AS (SELECT DISTINCT c_mktsegment AS value FROM customer), p(value, i, r) AS (SELECT value, 0::BIGINT, list_transform(range(0, " + str(len(_OTHER) + 1) + f"), lambda x: 0::BIGINT) FROM v UNION ALL SELECT value, i + 1, {_ROW} FROM p WHERE i < len(value)) SELECT 'cust:' || c_custkey AS key, r[-1]::INT AS len, true AS common FROM customer JOIN p ON c_mktsegment = value AND i = len(value)")
def _(s, d):
    found = f.kv(s, d).select("key", "value", text.lcs(C("value"), F.lit(_OTHER)).alias("l"))
    # A common subsequence: its letters stand in both texts in its order.
    pattern = F.concat(F.lit(".*"), F.regexp_replace("l.lcs", "(.)", "$1.*"))
    return found.select("key", "l.len", (F.regexp_like("value", pattern) & F.regexp_like(F.lit(_OTHER), pattern) & (F.length("l.lcs") == C("l.len"))).alias("common"))


# Keys.


@query("ks_del", "SELECT key, value FROM kv WHERE key NOT IN ('cust:3', 'cust:4')", "kv")
def _(s, d):
    kv = f.kv(s, d)
    return keyed.delete(kv, _keys(kv, "cust:3", "cust:4", "cust:3", "none"), ["key"]).select("key", "value")


@query("ks_persist", "SELECT key, NULL::BIGINT AS expire_at FROM kv", "kv")
def _(s, d):
    return keyspace.persist(f.kv(s, d)).select("key", "expire_at")


@query("ks_dbsize", "SELECT (SELECT count(*) FROM kv) + (SELECT count(DISTINCT key) FROM lst) AS n", "kv lst")
def _(s, d):
    return keyspace.dbsize(keyspace.keyspace({"string": f.kv(s, d), "list": f.lst(s, d)}))


@query("ks_randomkey", "SELECT 1::BIGINT AS n")
def _(s, d):
    kv = f.kv(s, d)
    return keyspace.random_key(kv.select("key"), 3).join(kv.select("key"), "key").agg(F.count("*").alias("n"))


@query("ks_expiretime", "SELECT key, CASE WHEN expire_at IS NULL THEN -1 ELSE expire_at // 1000 END AS at, coalesce(expire_at, -1) AS at_ms FROM kv", "kv")
def _(s, d):
    return f.kv(s, d).select("key", keyspace.expiretime(C("expire_at")).alias("at"), keyspace.expiretime(C("expire_at"), 1).alias("at_ms"))


@query("ks_move", "SELECT key, CASE WHEN key = 'cust:5' THEN 3 ELSE 0 END AS db FROM kv", "kv")
def _(s, d):
    return keyspace.move(f.kv(s, d).select("key", F.lit(0).alias("db")), "cust:5", 3)


@query("ks_live", "SELECT key FROM kv WHERE expire_at IS NULL OR expire_at > 300000", "kv")
def _(s, d):
    return keyed.live(f.kv(s, d), 300_000).select("key")


@query("ks_digest", "SELECT true AS same, true AS differs")
def _(s, d):
    kv = f.kv(s, d).select("key", "value")
    other = kv.withColumn("value", F.when(C("key") == "cust:9", "changed").otherwise(C("value")))
    a, b, c = (keyspace.digest(x).withColumnRenamed("digest", n) for x, n in ((kv, "a"), (kv.repartition(5, "value"), "b"), (other, "c")))
    return a.crossJoin(b).crossJoin(c).select((C("a") == C("b")).alias("same"), (C("a") != C("c")).alias("differs"))  # one row each


_CRC = f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, len(t) + 1), lambda i: ascii(t[i])::BIGINT)), lambda crc, b: xor((crc << 8) & 65535, CAST({text._crc16_table()} AS BIGINT[])[xor(crc >> 8, b) + 1]))"


@query("cluster_keyslot", f"SELECT key, ({_CRC} % 16384)::INT AS slot FROM (SELECT key, key AS t FROM kv UNION ALL SELECT 'a{{' || key || '}}z', key FROM kv)", "kv")
def _(s, d):
    kv = f.kv(s, d).select("key")
    return kv.unionByName(kv.select(F.concat(F.lit("a{"), "key", F.lit("}z")).alias("key"))).select("key", text.key_slot(C("key")).cast("int").alias("slot"))


# Hashes; fields that expire.


def _hx(s, d) -> DataFrame:
    at = F.when(C("field") == "cust", _long(50_000)).when(C("field") == "total", _long(120_000))
    return f.hsh(s, d).withColumn("expire_at", at)


_HX = ", hx AS (SELECT key, field, value, CASE field WHEN 'cust' THEN 50000 WHEN 'total' THEN 120000 END::BIGINT AS expire_at FROM hsh)"


@query("hash_hget", "SELECT key, value FROM hsh WHERE field = 'status'", "hsh")
def _(s, d):
    return hashes.hget(f.hsh(s, d), "status")


@query("hash_hexists", "SELECT key, max(field = 'extra') AS found FROM (SELECT * FROM hsh UNION ALL SELECT 'order:1', 'extra', 'x') GROUP BY key", "hsh")
def _(s, d):
    x = f.hsh(s, d)
    return hashes.hexists(x.unionByName(s.createDataFrame([("order:1", "extra", "x")], "key string, field string, value string")), "extra")


@query("hash_hincrbyfloat", "SELECT key, field, CASE WHEN field = 'total' THEN regexp_replace(regexp_replace(printf('%.17f', value::DOUBLE + 0.5), '0+$', ''), '\\.$', '') ELSE value END AS value FROM hsh WHERE field IN ('total', 'status')", "hsh")
def _(s, d):
    return hashes.hincrbyfloat(f.hsh(s, d).where(C("field").isin("total", "status")), "total", 0.5)


@query("hash_hsetnx", "SELECT key, field, value FROM hsh UNION ALL SELECT DISTINCT key, 'extra', 'first' FROM hsh WHERE key LIKE '%7'", "hsh")
def _(s, d):
    x = f.hsh(s, d)
    row = lambda field, value, place: F.struct(F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(place).alias("place"))
    new = x.where(C("key").endswith("7")).select("key").distinct().select("key", F.inline(F.array(row("extra", "second", 1), row("extra", "first", 0), row("status", "no", 2))))
    return hashes.hsetnx(x, new, "place")


for _rule, _ok in (("fnx", "key LIKE '%9'"), ("fxx", "key NOT LIKE '%9'")):

    @query(f"hash_hsetex_{_rule}", f", d AS (SELECT DISTINCT key, CASE WHEN key LIKE '%9' THEN 'extra' ELSE 'status' END AS field FROM hsh WHERE key LIKE '%9' OR key LIKE '%8'), ok AS (SELECT * FROM d WHERE {_ok}) SELECT key, field, 'E' AS value, 5::BIGINT AS expire_at FROM ok UNION ALL SELECT key, field, value, expire_at FROM hx WHERE (key, field) NOT IN (SELECT key, field FROM ok)".replace(", d AS", _HX + ", d AS", 1), "hsh")
    def _(s, d, rule=_rule):
        x = _hx(s, d)
        nine = C("key").endswith("9")
        delta = x.where(nine | C("key").endswith("8")).select("key").distinct().select("key", F.when(nine, "extra").otherwise("status").alias("field"), F.lit("E").alias("value"), _long(5).alias("expire_at"))
        return hashes.hsetex(x, delta, rule)


@query("hash_hrandfield", "SELECT key, 2::BIGINT AS n FROM (SELECT DISTINCT key FROM hsh)", "hsh")
def _(s, d):
    x = f.hsh(s, d)
    return hashes.hlen(hashes.hrandfield(x, 2, 5).select("key", "field").distinct().join(x.select("key", "field"), ["key", "field"], "left_semi"))


@query("hash_hgetdel", "SELECT key, field, value, 'taken' AS side FROM hsh WHERE field = 'status' UNION ALL SELECT key, field, value, 'left' FROM hsh WHERE field <> 'status'", "hsh")
def _(s, d):
    taken, left = hashes.hgetdel(f.hsh(s, d), ["status"])
    return taken.withColumn("side", F.lit("taken")).unionByName(left.withColumn("side", F.lit("left")))


@query("hash_hgetex", _HX + " SELECT key, field, CASE WHEN field = 'status' THEN 7 ELSE expire_at END AS expire_at FROM hx", "hsh")
def _(s, d):
    return hashes.hgetex(_hx(s, d), ["status"], _long(7))[1].select("key", "field", "expire_at")


for _rule, _ok in {"nx": "expire_at IS NULL", "xx": "expire_at IS NOT NULL", "gt": "expire_at IS NOT NULL AND 90000 > expire_at", "lt": "expire_at IS NULL OR 90000 < expire_at"}.items():

    @query(f"hash_hexpire_{_rule}", _HX + f" SELECT key, field, CASE WHEN field <> 'priority' AND ({_ok}) THEN 90000 ELSE expire_at END AS expire_at FROM hx", "hsh")
    def _(s, d, rule=_rule):
        return hashes.hexpire(_hx(s, d), ["cust", "status", "total"], _long(90_000), rule).select("key", "field", "expire_at")


@query("hash_httl", _HX + " SELECT key, field, coalesce((expire_at - 45500) // 1000, -1) AS ttl, coalesce(expire_at - 45500, -1) AS pttl, coalesce(expire_at // 1000, -1) AS at FROM hx", "hsh")
def _(s, d):
    x = _hx(s, d)
    pttl = hashes.httl(x, 45_500, 1).withColumnRenamed("ttl", "pttl")
    at = x.select("key", "field", keyspace.expiretime(C("expire_at")).alias("at"))
    return hashes.httl(x, 45_500).join(pttl, ["key", "field"]).join(at, ["key", "field"])


@query("hash_hpersist", _HX + " SELECT key, field, CASE WHEN field = 'cust' THEN NULL ELSE expire_at END AS expire_at FROM hx", "hsh")
def _(s, d):
    return hashes.hpersist(_hx(s, d), ["cust", "none"]).select("key", "field", "expire_at")


# Sets and sorted sets.


@query("set_sadd", "SELECT key, member FROM st UNION SELECT key, 'x' || member FROM st WHERE key = 'supp:1' UNION SELECT 'new', 'a'", "st")
def _(s, d):
    x = f.st(s, d)
    more = x.where("key = 'supp:1'").select("key", F.explode(F.array(C("member"), F.concat(F.lit("x"), "member"))).alias("member"))
    return sets.sadd(x, more.unionByName(s.createDataFrame([("new", "a"), ("new", "a")], "key string, member string")))


@query("set_srem", "SELECT key, member FROM st WHERE NOT (key = 'supp:1' AND member::BIGINT % 2 = 0)", "st")
def _(s, d):
    x = f.st(s, d)
    return sets.srem(x, x.where((C("key") == "supp:1") & (C("member").cast("long") % 2 == 0)).unionByName(s.createDataFrame([("supp:1", "none")], "key string, member string")))


@query("set_spop", "SELECT key, least(3, count(*)) AS taken, greatest(count(*) - 3, 0) AS rest FROM st GROUP BY key", "st")
def _(s, d):
    x = f.st(s, d)
    taken, left = sets.spop(x, 3, 8)
    rest = sets.scard(left.join(x, ["key", "member"], "left_semi")).withColumnRenamed("n", "rest")
    return sets.scard(taken).withColumnRenamed("n", "taken").join(rest, "key", "left").select("key", "taken", F.coalesce("rest", F.lit(0)).alias("rest"))


@query("set_smembers", "SELECT key, member FROM st WHERE key = 'supp:2'", "st")
def _(s, d):
    return f.st(s, d).where("key = 'supp:2'")


@query("set_sscan", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS r FROM st WHERE member LIKE '1%') WHERE r BETWEEN 3 AND 6", "st")
def _(s, d):
    return sets.sscan(f.st(s, d), 2, "1*", 4)


@query("zset_zrem", "SELECT key, member, score FROM zs WHERE score >= 0", "zs")
def _(s, d):
    x = f.zs(s, d)
    return zsets.zrem(x, x.where("score < 0").select("key", "member"))


@query("zset_zcard", "SELECT key, count(*) AS n FROM zs GROUP BY key", "zs")
def _(s, d):
    return zsets.zcard(f.zs(s, d))


@query("zset_zrandmember", "SELECT key, least(4, count(*)) AS n FROM zs GROUP BY key", "zs")
def _(s, d):
    x = f.zs(s, d)
    return zsets.zcard(zsets.zrandmember(x, 4, 2).select("key", "member").distinct().join(x, ["key", "member"], "left_semi"))


@query("zset_popmax", ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM zs) SELECT key, member, score FROM r WHERE rank < 2", "zs")
def _(s, d):
    return zsets.zpop(f.zs(s, d), 2, smallest=False)[0].select("key", "member", "score")


@query("zset_zrangestore", "SELECT key, member, score FROM zq UNION ALL SELECT * FROM (SELECT 'out' AS key, member, score FROM zq WHERE key = 'supp:1' ORDER BY score, member LIMIT 3 OFFSET 1)", "zq")
def _(s, d):
    x = f.zq(s, d)
    return zsets.store(x, "out", zsets.zrange(x.where("key = 'supp:1'"), 1, 3)).select("key", "member", "score")


for _name, _op in (("zdiffstore", "NOT IN"), ("zinterstore", "IN")):
    _score = "score" if _op == "NOT IN" else "(score + (SELECT b.score FROM zq b WHERE b.key = 'supp:2' AND b.member = a.member))"

    @query(f"zset_{_name}", f"SELECT key, member, score FROM zq UNION ALL SELECT 'out', member, {_score} FROM zq a WHERE key = 'supp:1' AND member {_op} (SELECT member FROM zq WHERE key = 'supp:2')", "zq")
    def _(s, d, fn=zsets.zdiff if _op == "NOT IN" else zsets.zinter):
        x = f.zq(s, d)
        return zsets.store(x, "out", fn(x, ["supp:1", "supp:2"]))


for _exist, _new in {"nx": "coalesce(a.score, d.lo)", "xx": "CASE WHEN a.score IS NULL THEN NULL ELSE coalesce(d.hi, a.score) END"}.items():

    @query(f"zset_zadd_{_exist}", f", d AS (SELECT 'supp:1' AS key, member, score AS lo, score + 1 AS hi FROM zq WHERE key = 'supp:2') SELECT key, member, {_new} AS score FROM zq a FULL JOIN d USING (key, member) WHERE {'true' if _exist == 'nx' else 'a.score IS NOT NULL'}", "zq")
    def _(s, d, exist=_exist):
        x = f.zq(s, d)
        twice = x.where("key = 'supp:2'").select(F.lit("supp:1").alias("key"), "member", F.posexplode(F.array(C("score"), C("score") + 1)).alias("place", "score"))
        return zsets.zadd(x, twice, exist=exist, place="place")


# Bitmaps and sketches.


@query("bit_set", "SELECT key, offset_ AS \"offset\" FROM bm WHERE NOT (key = 'click' AND offset_ % 2 = 0) UNION SELECT 'view', offset_ FROM bm WHERE key = 'click' AND offset_ % 2 = 0", "bm")
def _(s, d):
    x = f.bm(s, d)
    mine = x.where("key = 'click' and offset % 2 = 0")
    off, on = mine.withColumn("bit", F.lit(0)), mine.select(F.lit("view").alias("key"), "offset", F.lit(1).alias("bit"))
    return bitmaps.setbit(x, off.unionByName(on)).select("key", "offset")


def _items(s, d) -> DataFrame:
    return f.table(s, d, "lineitem").select(C("l_returnflag").alias("key"), C("l_partkey").alias("item"))


@query("bloom_info", "SELECT l_returnflag AS key, 20000 AS capacity, 191702 AS size, 7 AS hashes, true AS ok FROM lineitem GROUP BY 1")
def _(s, d):
    info = sketches.bloom_info(sketches.bloom(_items(s, d), ["key"], "item", 20_000), ["key"], 20_000)
    return info.select("key", "capacity", "size", "hashes", ((C("bits_set") > 0) & (C("most_set") < C("size"))).alias("ok"))


@query("bloom_card", "SELECT l_returnflag AS key, true AS ok FROM lineitem GROUP BY 1")
def _(s, d):
    x = _items(s, d)
    truth = x.groupBy("key").agg(F.count_distinct("item").alias("truth"))
    return sketches.bloom_card(sketches.bloom(x, ["key"], "item", 20_000), ["key"], 20_000).join(truth, "key").select("key", (F.abs(C("n") - C("truth")) <= 0.03 * C("truth")).alias("ok"))


@query("cuckoo_info", "SELECT l_returnflag AS key, count(*) AS items, 65536 AS buckets, true AS ok FROM lineitem GROUP BY 1")
def _(s, d):
    info = sketches.cuckoo_info(sketches.cuckoo(_items(s, d), ["key"], "item"), ["key"])
    return info.select("key", "items", "buckets", (C("used") <= C("fingers")).alias("ok"))


@query("cms_info", "SELECT l_returnflag AS key, 500 AS width, 4 AS depth, count(*) AS total FROM lineitem GROUP BY 1")
def _(s, d):
    return sketches.cms_info(sketches.cms(_items(s, d), ["key"], "item", width=500, depth=4), ["key"], 500, 4)


_TOP = "WITH c AS (SELECT l_returnflag AS key, l_partkey AS item, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2), t AS (SELECT * FROM c WHERE rank <= 5) "


@query("topk_query", _TOP + "SELECT key, item, item IN (SELECT item FROM t WHERE t.key = c.key) AS found FROM c WHERE rank <= 8")
def _(s, d):
    x = _items(s, d)
    return sketches.topk_query(sketches.topk(x, ["key"], "item", 5), sketches.topk(x, ["key"], "item", 8).select("key", "item"), ["key"], "item")


@query("topk_count", _TOP + "SELECT key, item, CASE WHEN rank <= 5 THEN n ELSE 0 END AS n FROM c WHERE rank <= 8")
def _(s, d):
    x = _items(s, d)
    return sketches.topk_count(sketches.topk(x, ["key"], "item", 5), sketches.topk(x, ["key"], "item", 8).select("key", "item"), ["key"], "item")


@query("topk_info", _TOP + "SELECT key, count(*) AS held, min(n) AS least, 5 AS k FROM t GROUP BY key")
def _(s, d):
    return sketches.topk_info(sketches.topk(_items(s, d), ["key"], "item", 5), ["key"], 5)


def _digest(s, d) -> DataFrame:
    e = f.table(s, d, "events").select(C("event_type").alias("key"), "value", "event_id")
    return sketches.digest_merge([sketches.digest(e.where(C("event_id") % 3 == i), ["key"], "value") for i in range(3)], ["key"])


@query("digest_quantiles", "SELECT event_type AS key, count(*) AS n, true AS ok FROM events GROUP BY 1")
def _(s, d):
    e = f.table(s, d, "events").select(C("event_type").alias("key"), "value")
    q = sketches.digest_quantiles(_digest(s, d), ["key"], [0.1, 0.5, 0.99])
    # The share of values up to each answer is near what was asked for.
    shares = e.join(q, "key").groupBy("key", "n").agg(*(F.avg((C("value") <= C(f"q{i}")).cast("int")).alias(f"s{i}") for i in range(3)))
    return shares.select("key", "n", ((F.abs(C("s0") - 0.1) < 0.02) & (F.abs(C("s1") - 0.5) < 0.02) & (F.abs(C("s2") - 0.99) < 0.02)).alias("ok"))


@query("digest_ranks", "SELECT event_type AS key, true AS ok FROM events GROUP BY 1")
def _(s, d):
    truth = f.table(s, d, "events").groupBy(C("event_type").alias("key")).agg(F.avg((C("value") <= 50).cast("int")).alias("t"))
    return sketches.digest_ranks(_digest(s, d), ["key"], [50.0]).join(truth, "key").select("key", (F.abs(C("r0") - C("t")) < 0.02).alias("ok"))


# Time series and logs.


@query("ts_alter", "SELECT DISTINCT event_type AS series, CASE event_type WHEN 'click' THEN 5 ELSE 10 END::BIGINT AS retention_ms, CASE event_type WHEN 'view' THEN 'sum' ELSE 'last' END AS policy FROM events UNION ALL SELECT 'new', NULL, 'min'")
def _(s, d):
    meta = f.table(s, d, "events").select(C("event_type").alias("series"), _long(10).alias("retention_ms"), F.lit("last").alias("policy")).distinct()
    return timeseries.alter(meta, s.createDataFrame([("click", 5, None), ("view", None, "sum"), ("new", None, "min")], "series string, retention_ms long, policy string"))


@query("xs_len", "SELECT key, count(*) AS n FROM xs GROUP BY key", "xs")
def _(s, d):
    return logs.xlen(f.xs(s, d))


@query("xs_del", "SELECT key, ms, seq FROM xs WHERE user_id % 3 <> 1", "xs")
def _(s, d):
    x = f.xs(s, d)
    return logs.xdel(x, x.where("user_id % 3 = 1")).select("key", "ms", "seq")


def _group(s, d):
    x = f.xs(s, d)
    none = s.createDataFrame([], "key string, grp string, ms long, seq long")
    groups = logs.group_create(none, x, "g", "1704200000000-0")
    return x, groups, logs.xreadgroup(x, groups, F.concat(F.lit("c"), C("user_id") % 3), 1_800_000_000_000)[2]


_P = ", p AS (SELECT key, 'g' AS grp, ms, seq, 'c' || (user_id % 3) AS consumer FROM xs WHERE ms > 1704200000000 OR (ms = 1704200000000 AND seq > 0)) "


@query("xs_group_create", "SELECT key, 'g' AS grp, 1704200000000 AS ms, 0::BIGINT AS seq FROM xs GROUP BY key UNION ALL SELECT key, 'last', max(ms), arg_max(seq, ms * 1000 + seq) FROM xs GROUP BY key", "xs")
def _(s, d):
    x, groups, _ = _group(s, d)
    both = logs.group_create(groups, x, "last", "$")
    return logs.group_create(both, x, "g", "0")


@query("xs_setid", "SELECT key, 'g' AS grp, 1705000000000 AS ms, 7::BIGINT AS seq FROM xs GROUP BY key", "xs")
def _(s, d):
    return logs.group_setid(_group(s, d)[1], "g", "1705000000000-7")


@query("xs_group_destroy", "SELECT 0::BIGINT AS groups, 0::BIGINT AS pending")
def _(s, d):
    _, groups, pending = _group(s, d)
    g, p = logs.group_destroy(groups, pending, "g")
    return g.agg(F.count("*").alias("groups")).crossJoin(p.agg(F.count("*").alias("pending")))  # one row each


@query("xs_consumers", _P + "SELECT key, grp, consumer, count(*) AS n, 60000::BIGINT AS idle FROM p WHERE consumer <> 'c0' GROUP BY ALL", "xs")
def _(s, d):
    return logs.consumers(logs.consumer_delete(_group(s, d)[2], "g", "c0"), 1_800_000_060_000)


@query("xs_ackdel", _P + "SELECT 'log' AS side, key, ms, seq FROM xs WHERE (key, ms, seq) NOT IN (SELECT key, ms, seq FROM p WHERE consumer = 'c1') UNION ALL SELECT 'pending', key, ms, seq FROM p WHERE consumer <> 'c1'", "xs")
def _(s, d):
    x, _, pending = _group(s, d)
    log, left = logs.xackdel(x, pending, pending.where("consumer = 'c1'").select("key", "grp", "ms", "seq"))
    cols = lambda df, side: df.select(F.lit(side).alias("side"), "key", "ms", "seq")
    return cols(log, "log").unionByName(cols(left, "pending"))


@query("xs_history", _P + "SELECT key, ms, seq FROM p WHERE consumer = 'c2'", "xs")
def _(s, d):
    x, _, pending = _group(s, d)
    return logs.history(x, pending, "c2").select("key", "ms", "seq")


@query("xs_pending_range", _P + "SELECT key, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS r FROM p WHERE consumer = 'c1' AND ms <= 1706000000000) WHERE r <= 5", "xs")
def _(s, d):
    return logs.xpending_range(_group(s, d)[2], 1_800_000_060_000, 60_000, "-", "1706000000000", 5, "c1").select("key", "ms", "seq")


# JSON.


@query("json_mget", "SELECT key, doc ->> '$.sub.a' AS value FROM js WHERE key IN ('doc:1', 'doc:2')", "js")
def _(s, d):
    return jsondocs.mget(f.js(s, d), ["doc:1", "doc:2", "none"], "$.sub.a")


@query("json_debug", "SELECT key, strlen(doc)::INT AS n FROM js", "js")
def _(s, d):
    return f.js(s, d).select("key", jsondocs.memory().alias("n"))


@query("json_resp", "SELECT key, '{,a,' || (doc ->> '$.sub.a') || ',b,-' AS sub, '[,' || (doc ->> '$.tags[0]') || ',x,' || (doc ->> '$.tags[2]') AS tags, doc ->> '$.cust' AS cust FROM js", "js")
def _(s, d):
    shown = lambda path: F.array_join(jsondocs.resp(path), ",", "-")
    return f.js(s, d).select("key", shown("$.sub").alias("sub"), shown("$.tags").alias("tags"), shown("$.cust").alias("cust"))


@query("json_mset", "SELECT key, CASE key WHEN 'doc:1' THEN 'A' ELSE doc ->> '$.name' END AS name, CASE key WHEN 'doc:2' THEN '5' ELSE doc ->> '$.sub.a' END AS a FROM js UNION ALL SELECT 'doc:new', 'N', '1'", "js")
def _(s, d):
    x = jsondocs.mset(f.js(s, d), [("doc:1", "$.name", "A"), ("doc:2", "$.sub.a", 5), ("doc:new", "$", {"name": "N", "sub": {"a": 1}})])
    return x.select("key", jsondocs.get("$.name").alias("name"), jsondocs.get("$.sub.a").alias("a"))


@query("json_arrpop", "SELECT key, doc ->> '$.tags[2]' AS last, doc ->> '$.tags[0]' AS first, 'x' AS inner, NULL::VARCHAR AS none FROM js", "js")
def _(s, d):
    return f.js(s, d).select("key", jsondocs.arrpopped("$.tags").alias("last"), jsondocs.arrpopped("$.tags", -9).alias("first"), jsondocs.arrpopped("$.tags", 1).alias("inner"), jsondocs.arrpopped("$.name").alias("none"))


@query("json_big_numbers", "SELECT 9007199254740995::BIGINT AS up, 27021597764222979::BIGINT AS times")
def _(s, d):
    x = s.createDataFrame([("k", '{"n":9007199254740993}')], "key string, doc string")
    up = jsondocs.numincrby(x, "$.n", 2).select("key", jsondocs.get("$.n").cast("long").alias("up"))
    return up.join(jsondocs.nummultby(x, "$.n", 3).select("key", jsondocs.get("$.n").cast("long").alias("times")), "key").select("up", "times")


# Places and vectors.

_CELL = "(SELECT sum(((y >> i) & 1) * (1::BIGINT << (2 * i)) + ((x >> i) & 1) * (1::BIGINT << (2 * i + 1)))::BIGINT FROM range(26) r(i))"
_XY = "SELECT member, floor((lon + 180) / 360.0::DOUBLE * 67108864)::BIGINT AS x, floor((lat + 85.05112878) / 170.10225756::DOUBLE * 67108864)::BIGINT AS y FROM geo"


@query("geo_hash", f", c AS (SELECT member, {_CELL} AS cell FROM ({_XY})) SELECT member, " + " || ".join(f"substr('{geo.BASE32}', ((cell >> {5 * i}) & 31)::INT + 1, 1)" for i in range(10, -1, -1)) + " AS hash FROM c", "geo")
def _(s, d):
    return f.geo(s, d).select("member", geo.geohash(geo.encode(C("lon"), C("lat"))).alias("hash"))


for _rule, _lon in {"nx": "lon", "xx": "CASE WHEN member LIKE 'c1%' THEN 1.5 ELSE lon END"}.items():

    @query(f"geo_add_{_rule}", f"SELECT member, round({_lon}, 6) AS lon FROM geo" + (" UNION ALL SELECT 'new', 2.5" if _rule == "nx" else ""), "geo")
    def _(s, d, rule=_rule):
        x = f.geo(s, d)
        delta = x.where("member like 'c1%'").withColumn("lon", F.lit(1.5)).unionByName(s.createDataFrame([("places", "new", 2.5, 3.5)], "key string, member string, lon double, lat double"))
        return geo.add(x, delta, rule).select("member", F.round("lon", 6).alias("lon"))


@query("geo_store", f", c AS (SELECT member, {_CELL}::DOUBLE AS score FROM ({_XY} WHERE abs(lat - 10) < 5 AND abs(lon - 20) < 30)) SELECT 'out' AS key, member, score FROM c", "geo")
def _(s, d):
    return geo.store(f.geo(s, d).where("abs(lat - 10) < 5 and abs(lon - 20) < 30"), "out")


@query("vec_add", "SELECT key, name, round(CASE WHEN name = 'v3' THEN 0 WHEN name = 'fresh' THEN 1 ELSE v[1] END, 6) AS first FROM (SELECT key, name, v FROM vs UNION ALL SELECT key, 'fresh', v FROM vs WHERE id = 0)", "vs")
def _(s, d):
    x = f.vs(s, d)
    fresh = x.where("id = 0").select("key", _long(-1).alias("id"), F.lit("fresh").alias("name"), F.transform("v", lambda e: e * 0 + 1.0).alias("v"))
    return vectors.vadd(x, x.where("name = 'v3'").withColumn("v", F.transform("v", lambda e: e * 0)).unionByName(fresh)).select("key", "name", F.round(C("v")[0], 6).alias("first"))


@query("vec_rem", "SELECT key, name FROM vs WHERE id % 4 <> 0", "vs")
def _(s, d):
    x = f.vs(s, d)
    return vectors.vrem(x, x.where("id % 4 = 0")).select("key", "name")


@query("vec_emb", "SELECT key, name, round(list_sum(v), 6) AS total FROM vs WHERE name IN ('v3', 'v5')", "vs")
def _(s, d):
    return vectors.vemb(f.vs(s, d), ["v3", "v5", "none"]).select("key", "name", F.round(F.aggregate("v", F.lit(0.0), lambda a, e: a + e), 6).alias("total"))


@query("vec_ismember", "SELECT place, m AS name, EXISTS (SELECT 1 FROM vs WHERE name = m AND key = (SELECT key FROM vs WHERE id = 0)) AS found FROM (VALUES (0, 'v0'), (1, 'none')) a(place, m)", "vs")
def _(s, d):
    x = f.vs(s, d)
    return vectors.vismember(x, x.where("id = 0").first()["key"], ["v0", "none"])


@query("vec_attr", "SELECT name, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS a, key AS b FROM vs", "vs")
def _(s, d):
    x = f.vs(s, d).withColumn("attrs", F.create_map(F.lit("kind"), F.lit("none"), F.lit("label"), "key"))
    x = vectors.setattr_(x, "kind", F.when(C("id") % 2 == 0, "even").otherwise("odd"))
    return x.select("name", vectors.getattr_("kind").alias("a"), vectors.getattr_("label").alias("b"))


@query("vec_randmember", "SELECT key, least(2, count(*)) AS n FROM vs GROUP BY key", "vs")
def _(s, d):
    return vectors.vrandmember(f.vs(s, d), 2, 4).groupBy("key").agg(F.count_distinct("name").alias("n"))


@query("vec_links", ", a AS (SELECT a.id AS query, b.id, list_inner_product(a.v, b.v) AS score FROM vs a JOIN vs b ON a.key = b.key AND a.id <> b.id WHERE a.id % 10 = 0) SELECT query, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM a) WHERE r <= 4", "vs")
def _(s, d):
    x = f.vs(s, d)
    return vectors.links(x, x.where("id % 10 = 0").select("id"), 4, "ip").select("query", "id", F.round("score", 6).alias("score"))


@query("vec_by_element_all", ", a AS (SELECT a.id AS query, b.id, 1 / (1 + list_distance(a.v, b.v)) AS score FROM vs a JOIN vs b ON a.id <> b.id WHERE a.id % 50 = 0) SELECT query, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM a) WHERE r <= 5", "vs")
def _(s, d):
    x = f.vs(s, d)
    return vectors.by_element(x, x.where("id % 50 = 0").select("id"), 5, "l2", same_key=False, rows=200).select("query", "id", F.round("score", 6).alias("score"))


# Upkeep of full text, channels, functions, transactions, graphs and snapshots.


def _index(s, d, where: str):
    return search.Index.create(f.table(s, d, "documents").where(where).select("doc_id", "text"), "doc_id", {"text": 1.0})


_LEN = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) > 1 AND t NOT IN (" + ", ".join(f"'{w}'" for w in search.STOPWORDS) + "))"


@query("ft_add", f"SELECT count(*) AS docs, sum(len({_LEN}))::BIGINT AS terms FROM documents WHERE doc_id % 3 <> 1")
def _(s, d):
    whole = _index(s, d, "doc_id % 3 = 0").add(f.table(s, d, "documents").where("doc_id % 3 = 2 or doc_id % 6 = 0").select("doc_id", "text"), "doc_id")
    return whole.info().select("docs", "terms")


@query("ft_drop", f"SELECT count(*) AS docs, sum(len({_LEN}))::BIGINT AS terms FROM documents WHERE doc_id % 2 = 1")
def _(s, d):
    gone = f.table(s, d, "documents").where("doc_id % 2 = 0").select(C("doc_id").cast("string").alias("id"))
    return _index(s, d, "true").remove(gone).info().select("docs", "terms")


@query("ft_info", f"SELECT count(*) AS docs, sum(len({_LEN}))::BIGINT AS terms, round(avg(len({_LEN})), 6) AS avg_len FROM documents")
def _(s, d):
    return _index(s, d, "true").info().withColumn("avg_len", F.round("avg_len", 6))


@query("ft_list", "SELECT 'a' AS name, 1 AS round UNION ALL SELECT 'b', 1 UNION ALL SELECT 'b', 2")
def _(s, d):
    path = f"{shared.shared_dir(s)}/indexes-{uuid.uuid4().hex}"
    for name in ("a", "b"):
        _index(s, d, "doc_id < 20").save(f"{path}/{name}")
    rows = [(n, 1) for n in search.Index.names(s, path)]
    search.Index.drop(s, f"{path}/a")
    return s.createDataFrame(rows + [(n, 2) for n in search.Index.names(s, path)], "name string, round int")


@query("ps_publish", "SELECT role AS channel, 'news' AS topic, count(*) AS n FROM conversations GROUP BY 1")
def _(s, d):
    path = f"{shared.shared_dir(s)}/publish-{uuid.uuid4().hex}"
    messages = f.messages(s, d).withColumnRenamed("channel", "role")
    messages.write.parquet(f"{path}/in")
    windows.publish(windows.read(s, f"{path}/in", messages.schema), "news", f"{path}/out", f"{path}/state").awaitTermination()
    return s.read.parquet(f"{path}/out").groupBy(C("role").alias("channel"), C("channel").alias("topic")).agg(F.count("*").alias("n"))


@query("ps_channels", "SELECT DISTINCT role AS channel, CASE role WHEN 'user' THEN 2 ELSE 0 END AS subscribers, 2 AS patterns FROM conversations WHERE role LIKE '%s%'")
def _(s, d):
    subs = [("s1", "user", True), ("s2", "user", True), ("s1", "a*", False), ("s2", "a*", False), ("s3", "*", False)]
    names = pubsub.channels(f.messages(s, d), "*s*")
    n = pubsub.numsub(subs, ["user"])["user"]
    return names.select("channel", F.when(C("channel") == "user", n).otherwise(0).alias("subscribers"), F.lit(pubsub.numpat(subs)).alias("patterns"))


@query("fn_admin", "SELECT 'double' AS names, true AS known, false AS gone, 0 AS after, '22' AS value")
def _(s, d):
    fns = scripts.Functions()
    sha, other = fns.load("double", lambda c: F.concat(c, c)), fns.load("drop", lambda c: c)
    fns.delete("drop")
    names, known, gone = ",".join(fns.names()), *fns.exists(sha, other)
    out = s.range(1).select(F.lit(names).alias("names"), F.lit(known).alias("known"), F.lit(gone).alias("gone"), fns.call(sha, F.lit("2")).alias("value"))
    fns.flush()
    return out.withColumn("after", F.lit(len(fns.names())))


def _transaction(s, d, watched: bool, touch: bool, discard: bool) -> DataFrame:
    tables, versions = {"kv": f.kv(s, d).select("key", "value"), "st": f.st(s, d)}, {"kv": 1}
    tx = scripts.Transaction(tables, versions)
    if watched:
        tx.watch("kv")
    tx.queue("kv", lambda x: x.where("key <> 'cust:1'"))
    tx.queue("kv", lambda x: x.withColumn("value", F.upper(F.concat("value", F.lit("x")))))
    tx.queue("st", lambda x: x.where("key = 'supp:1'"))
    if touch:
        versions["kv"] += 1
    if discard:
        tx.discard()
    failed = False
    try:
        tx.commit()
    except scripts.Conflict:
        failed = True
    strings_, sets_ = tables["kv"], tables["st"].agg(F.count("*").alias("members"))
    return strings_.crossJoin(sets_).select("key", "value", "members", F.lit(failed).alias("failed"), F.lit(versions["kv"]).alias("version"))  # one row


_AFTER = "SELECT key, upper(value || 'x') AS value, (SELECT count(*) FROM st WHERE key = 'supp:1') AS members, false AS failed, {v} AS version FROM kv WHERE key <> 'cust:1'"
_BEFORE = "SELECT key, value, (SELECT count(*) FROM st) AS members, {x} AS failed, {v} AS version FROM kv"
for _name, _args, _body in (
    ("tx_exec", (False, True, False), _AFTER.format(v=3)), ("tx_watch", (True, False, False), _AFTER.format(v=2)), ("tx_conflict", (True, True, False), _BEFORE.format(x="true", v=2)), ("tx_discard", (True, True, True), _BEFORE.format(x="false", v=2)),
):

    @query(_name, _body, "kv st")
    def _(s, d, args=_args):
        return _transaction(s, d, *args)


@query("g_create", ", n AS (SELECT id, label, CASE WHEN id = 'nation:3' THEN 'renamed' ELSE name END AS name FROM nodes UNION ALL SELECT 'city:1', 'city', 'one') SELECT 'node' AS kind, id AS a, name AS b FROM n UNION ALL SELECT 'edge', src, dst FROM edges UNION ALL SELECT 'edge', 'city:1', 'nation:3'", "nodes edges")
def _(s, d):
    nodes, edges = f.graph(s, d)
    nodes = graph.create_nodes(nodes, s.createDataFrame([("city:1", "city", "one"), ("nation:3", "nation", "renamed")], "id string, label string, name string"))
    edges = graph.create_edges(nodes, edges, s.createDataFrame([("city:1", "nation:3", "IN"), ("city:1", "city:2", "TO")], "src string, dst string, rel string"))
    return nodes.select(F.lit("node").alias("kind"), C("id").alias("a"), C("name").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), C("src").alias("a"), C("dst").alias("b")))


@query("io_snapshot", "SELECT key, value FROM kv WHERE (expire_at IS NULL OR expire_at > 300000) AND key LIKE 'cust:1%'", "kv")
def _(s, d):
    path = f"{shared.shared_dir(s)}/snapshot-{uuid.uuid4().hex}"
    snapshots.save({"kv": f.kv(s, d), "st": f.st(s, d)}, path)
    return snapshots.load(s, path, ["kv", "st"], 300_000, "cust:1*")["kv"].select("key", "value")


@query("io_commands", "SELECT 'hash' AS type, key, field AS a, value AS b FROM hsh WHERE key LIKE 'order:1%' UNION ALL SELECT 'string', key, value, NULL FROM kv UNION ALL SELECT 'set', key, member, NULL FROM st WHERE key = 'supp:1' UNION ALL SELECT 'list', key, pos::VARCHAR, elem FROM lst WHERE key LIKE 'order:1%'", "kv hsh st lst")
def _(s, d):
    bulk = lambda c: F.concat(F.lit("$"), F.octet_length(c).cast("string"), F.lit("\r\n"), c)
    line = lambda *cs: F.concat_ws("\r\n", F.lit(f"*{len(cs)}"), *map(bulk, cs))
    first = C("key").startswith("order:1")
    rows = [
        f.kv(s, d).select(line(F.lit("SET"), C("key"), F.lit("old")).alias("value"), F.lit(0).alias("place")),
        f.kv(s, d).select(line(F.lit("set"), C("key"), C("value")).alias("value"), F.lit(1).alias("place")),
        f.hsh(s, d).where(first).select(line(F.lit("HSET"), C("key"), C("field"), C("value")).alias("value"), F.lit(2).alias("place")),
        f.st(s, d).where("key = 'supp:1'").select(line(F.lit("SADD"), C("key"), C("member")).alias("value"), F.lit(3).alias("place")),
        f.lst(s, d).where(first).select(line(F.lit("RPUSH"), C("key"), C("elem")).alias("value"), (C("pos") + 4).cast("int").alias("place")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    path = f"{shared.shared_dir(s)}/commands-{uuid.uuid4().hex}"
    out.repartitionByRange(4, "place").sortWithinPartitions("place").select("value").write.option("lineSep", "\r\n").text(path)
    got = snapshots.replay(snapshots.read_commands(s, path))
    four = lambda kind, df, a, b: df.select(F.lit(kind).alias("type"), "key", a.cast("string").alias("a"), b.cast("string").alias("b"))
    parts = [four("hash", got["hash"], C("field"), C("value")), four("string", got["string"], C("value"), F.lit(None)), four("set", got["set"], C("member"), F.lit(None)), four("list", got["list"], C("pos"), C("elem"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
