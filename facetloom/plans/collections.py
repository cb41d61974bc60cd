"""Queries on strings, keys, lists, hashes, sets, sorted sets and bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.functions import text
from facetloom.operators import bitmaps, hashes, keyed, keyspace, lists, sets, strings, zsets
from facetloom.sources import facets as f
from facetloom.sources.facets import sql

Query = tuple
C = F.col
QUERIES: dict[str, Query] = {}


def query(name: str, body: str | None, uses: str = ""):
    def add(fn):
        QUERIES[name] = (fn, None if body is None else sql(uses, body) if uses else body)
        return fn

    return add


# Strings.


@query("str_getrange", "SELECT key, substr(value, greatest(len(value) - 4, 0) + 1, 4) AS part FROM kv", "kv")
def _(s: SparkSession, d: str) -> DataFrame:
    return f.kv(s, d).select("key", text.getrange(C("value"), -4, -1).alias("part"))


@query("str_setrange", "SELECT key, substr(value, 1, 2) || '###' || substr(value, 6) AS value FROM kv", "kv")
def _(s, d):
    return f.kv(s, d).select("key", text.setrange(C("value"), 2, "###").alias("value"))


@query("str_append", "SELECT key, value || ':' || n AS value, strlen(value || ':' || n)::INT AS n FROM kv", "kv")
def _(s, d):
    v = strings.append(C("value"), F.concat(F.lit(":"), "n"))
    return f.kv(s, d).select("key", v.alias("value"), strings.strlen(v).alias("n"))


@query("str_incrby", "SELECT key, (n::BIGINT + 10)::VARCHAR AS n, (n::BIGINT - 3)::VARCHAR AS m FROM kv", "kv")
def _(s, d):
    return f.kv(s, d).select("key", strings.incrby(C("n"), 10).alias("n"), strings.incrby(C("n"), -3).alias("m"))


@query("str_incrby_log", "SELECT key, n::BIGINT + coalesce(inc, 0) AS n FROM kv LEFT JOIN (SELECT 'cust:' || o_custkey AS key, sum(o_custkey % 5 + 1)::BIGINT AS inc FROM orders GROUP BY 1) USING (key)", "kv")
def _(s, d):
    log = f.table(s, d, "orders").select(F.concat(F.lit("cust:"), "o_custkey").alias("key"), (C("o_custkey") % 5 + 1).alias("by"))
    kv = f.kv(s, d)
    return strings.incr_log(kv, log.join(kv.select("key"), "key", "left_semi"))


@query("str_incrbyfloat", "SELECT key, regexp_replace(regexp_replace(printf('%.17f', n::DOUBLE + 0.5), '0+$', ''), '\\.$', '') AS n FROM kv", "kv")
def _(s, d):
    return f.kv(s, d).select("key", strings.incrbyfloat(C("n"), 0.5).alias("n"))


@query("str_mget", "SELECT place, k AS key, value FROM (VALUES (0, 'cust:7'), (1, 'none'), (2, 'cust:3'), (3, 'cust:7')) a(place, k) LEFT JOIN kv ON k = key", "kv")
def _(s, d):
    return strings.mget(f.kv(s, d), ["cust:7", "none", "cust:3", "cust:7"])


def _delta(kv: DataFrame) -> DataFrame:
    return kv.select(F.when(C("n").cast("long") % 4 == 0, F.concat(F.lit("new:"), "n")).otherwise(C("key")).alias("key"), F.lit("X").alias("value"), F.lit(5).cast("long").alias("expire_at"), F.lit("BUILDING").alias("operand")).where("key like '%5' or key like 'new%'")


_DELTA = "d AS (SELECT * FROM (SELECT CASE WHEN n::BIGINT % 4 = 0 THEN 'new:' || n ELSE key END AS key, 'X' AS value, 5::BIGINT AS expire_at FROM kv) WHERE key LIKE '%5' OR key LIKE 'new%')"
for _rule, _ok in {"always": "true", "nx": "kv.key IS NULL", "xx": "kv.key IS NOT NULL", "ifeq": "coalesce(kv.value = 'BUILDING', false)", "ifne": "NOT coalesce(kv.value = 'BUILDING', false)"}.items():
    _body = f", {_DELTA}, ok AS (SELECT d.* FROM d LEFT JOIN kv ON d.key = kv.key WHERE {_ok}) SELECT * FROM ok UNION ALL SELECT key, value, expire_at FROM kv WHERE key NOT IN (SELECT key FROM ok)"

    @query(f"str_set_{_rule}", _body, "kv")
    def _(s, d, rule=_rule):
        kv = f.kv(s, d)
        return strings.set_(kv, _delta(kv), rule, C("operand"))


@query("str_msetnx", ", d AS (SELECT 'new:' || n AS key, 'Y' AS value, NULL::BIGINT AS expire_at FROM kv WHERE n::BIGINT % 50 = 0) SELECT * FROM d UNION ALL SELECT key, value, expire_at FROM kv", "kv")
def _(s, d):
    kv = f.kv(s, d)
    new = kv.where(C("n").cast("long") % 50 == 0).select(F.concat(F.lit("new:"), "n").alias("key"), F.lit("Y").alias("value"), F.lit(None).cast("long").alias("expire_at"), F.lit(0).alias("place"))
    return strings.msetnx(kv.select("key", "value", "expire_at"), new)


@query("str_getdel", "SELECT key, value FROM kv WHERE key NOT IN (SELECT 'cust:' || o_custkey FROM orders WHERE o_orderpriority LIKE '1%')", "kv")
def _(s, d):
    gone = f.table(s, d, "orders").where("o_orderpriority like '1%'").select(F.concat(F.lit("cust:"), "o_custkey").alias("key"))
    return strings.getdel(f.kv(s, d), gone)[1].select("key", "value")


@query("str_delex", "SELECT key, value FROM kv WHERE value <> 'BUILDING'", "kv")
def _(s, d):
    return strings.delex(f.kv(s, d), C("value") == "BUILDING").select("key", "value")


# Keys.


def _ks(s, d):
    return keyspace.keyspace({"string": f.kv(s, d), "list": f.lst(s, d), "zset": f.zs(s, d)})


_KS = ", ks AS (SELECT key, 'string' AS type, expire_at FROM kv UNION ALL SELECT DISTINCT key, 'list', NULL FROM lst UNION ALL SELECT DISTINCT key, 'zset', NULL FROM zs) "


@query("ks_types", _KS + "SELECT type, count(*) AS n, count(expire_at) AS expiring FROM ks GROUP BY type", "kv lst zs")
def _(s, d):
    return _ks(s, d).groupBy("type").agg(F.count("*").alias("n"), F.count("expire_at").alias("expiring"))


@query("ks_keys_glob", _KS + "SELECT key, type FROM ks WHERE regexp_matches(key, '^cust:[1-3].[^0]$') OR key LIKE 'nation:%'", "kv lst zs")
def _(s, d):
    ks = _ks(s, d)
    return keyspace.keys(ks, "cust:[1-3]?[^0]").unionByName(keyspace.keys(ks, "nation:*")).select("key", "type")


@query("ks_scan", _KS + "SELECT key, type FROM ks WHERE key LIKE 'c%' AND type = 'string' ORDER BY key LIMIT 20 OFFSET 40", "kv lst zs")
def _(s, d):
    return keyspace.scan(_ks(s, d), 40, "c*", 20, "string").select("key", "type")


@query("ks_exists", "SELECT 3::BIGINT AS n")
def _(s, d):
    return keyspace.exists(f.kv(s, d), ["cust:1", "cust:1", "none", "cust:2"])


@query("ks_ttl", "SELECT key, CASE WHEN expire_at IS NULL THEN -1 ELSE floor((expire_at - 30000) / 1000)::BIGINT END AS ttl, CASE WHEN expire_at IS NULL THEN -1 ELSE floor(expire_at / 1000)::BIGINT END AS at FROM kv WHERE expire_at IS NULL OR expire_at > 30000", "kv")
def _(s, d):
    return keyed.live(f.kv(s, d), 30_000).select("key", keyspace.ttl(C("expire_at"), 30_000).alias("ttl"), keyspace.expiretime(C("expire_at")).alias("at"))


for _rule, _ok in {"nx": "expire_at IS NULL", "xx": "expire_at IS NOT NULL", "gt": "expire_at IS NOT NULL AND 90000 > expire_at", "lt": "expire_at IS NULL OR 90000 < expire_at"}.items():

    @query(f"ks_expire_{_rule}", f"SELECT key, CASE WHEN {_ok} THEN 90000 ELSE expire_at END AS expire_at FROM kv", "kv")
    def _(s, d, rule=_rule):
        return keyspace.expire(f.kv(s, d), F.lit(90_000).cast("long"), rule).select("key", "expire_at")


@query("ks_rename", "SELECT CASE WHEN key = 'cust:5' THEN 'cust:6' ELSE key END AS key, value FROM kv WHERE key <> 'cust:6'", "kv")
def _(s, d):
    return keyspace.rename(f.kv(s, d).select("key", "value"), "cust:5", "cust:6")


@query("ks_copy", "SELECT key, value FROM kv UNION ALL SELECT 'copy', value FROM kv WHERE key = 'cust:5'", "kv")
def _(s, d):
    return keyspace.copy(f.kv(s, d).select("key", "value"), "cust:5", "copy")


@query("ks_sort_numeric", "SELECT key, elem, rank FROM (SELECT key, elem, row_number() OVER (PARTITION BY key ORDER BY elem::DOUBLE DESC, elem DESC) - 1 AS rank FROM lst) WHERE rank BETWEEN 1 AND 2", "lst")
def _(s, d):
    return keyspace.sort(f.lst(s, d).select("key", "elem"), desc=True, offset=1, count=2)


@query("ks_sort_by", "SELECT key, elem, rank, p_name FROM (SELECT key, elem, p_name, row_number() OVER (PARTITION BY key ORDER BY p_retailprice, elem) - 1 AS rank FROM st JOIN part ON elem_ = p_partkey) WHERE rank < 5", "st")
def _(s, d):
    p = f.table(s, d, "part").select(C("p_partkey").cast("string").alias("elem"), "p_retailprice", "p_name")
    found = f.st(s, d).withColumnRenamed("member", "elem").join(p, "elem")
    return keyspace.sort(found, by=C("p_retailprice"), count=5).select("key", "elem", "rank", "p_name")


QUERIES["ks_sort_by"] = (QUERIES["ks_sort_by"][0], sql("st", ", e AS (SELECT key, member AS elem, member::BIGINT AS elem_ FROM st) SELECT key, elem, rank, p_name FROM (SELECT key, elem, p_name, row_number() OVER (PARTITION BY key ORDER BY p_retailprice, elem) - 1 AS rank FROM e JOIN part ON elem_ = p_partkey) WHERE rank < 5"))


# Lists.


@query("list_llen", "SELECT key, count(*) AS n FROM lst GROUP BY key", "lst")
def _(s, d):
    return lists.length(f.lst(s, d))


@query("list_lrange", ", n AS (SELECT *, count(*) OVER (PARTITION BY key) AS c FROM lst) SELECT key, pos, elem FROM n WHERE pos >= greatest(0, c - 3) AND pos <= c - 2", "lst")
def _(s, d):
    return lists.lrange(f.lst(s, d), -3, -2)


@query("list_lindex", ", n AS (SELECT *, count(*) OVER (PARTITION BY key) AS c FROM lst) SELECT key, elem FROM n WHERE pos = c - 2", "lst")
def _(s, d):
    return lists.lindex(f.lst(s, d), -2)


@query("list_push", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY side, pos) - 1 AS pos, elem FROM (SELECT key, 0 AS side, pos, elem FROM lst UNION ALL SELECT DISTINCT key, -1, -2, 'b' FROM lst UNION ALL SELECT DISTINCT key, -1, -1, 'a' FROM lst)", "lst")
def _(s, d):
    x = f.lst(s, d)
    new = x.select("key").distinct().select("key", F.inline(F.array(F.struct(F.lit(0).alias("place"), F.lit("a").alias("elem")), F.struct(F.lit(1).alias("place"), F.lit("b").alias("elem")))))
    return lists.push(x, new, left=True, only_existing=True)


@query("list_pop", ", n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos DESC) - 1 AS r FROM lst) SELECT key, elem, r AS rank FROM n WHERE r < 2", "lst")
def _(s, d):
    return lists.pop(f.lst(s, d), 2, left=False)[0].select("key", "elem", "rank")


@query("list_lset", ", n AS (SELECT *, count(*) OVER (PARTITION BY key) AS c FROM lst) SELECT key, pos, CASE WHEN pos = c - 1 THEN 'Z' ELSE elem END AS elem FROM n", "lst")
def _(s, d):
    return lists.lset(f.lst(s, d), -1, "Z")


@query("list_ltrim", "SELECT key, pos - 1 AS pos, elem FROM lst WHERE pos BETWEEN 1 AND 3", "lst")
def _(s, d):
    return lists.ltrim(f.lst(s, d), 1, 3)


@query("list_lrem", ", n AS (SELECT *, row_number() OVER (PARTITION BY key, elem ORDER BY pos DESC) AS c FROM lst) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, elem FROM n WHERE elem <> '3' OR c > 1", "lst")
def _(s, d):
    return lists.lrem(f.lst(s, d), -1, "3")


@query("list_linsert", ", p AS (SELECT key, min(pos) AS pos FROM lst WHERE elem = '3' GROUP BY key), a AS (SELECT key, pos::DOUBLE AS pos, elem FROM lst UNION ALL SELECT key, pos - 0.5, 'new' FROM p) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, elem FROM a", "lst")
def _(s, d):
    return lists.linsert(f.lst(s, d), "3", "new")


@query("list_lpos", ", n AS (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY pos DESC) - 1 AS r FROM lst WHERE elem = '3') SELECT key, r - 1 AS match, pos FROM n WHERE r >= 1", "lst")
def _(s, d):
    return lists.lpos(f.lst(s, d), "3", rank=-2, count=0)


@query("list_lmove", ", m AS (SELECT elem FROM lst WHERE key = 'order:1' ORDER BY pos DESC LIMIT 1), a AS (SELECT key, pos, elem FROM lst WHERE key <> 'order:1' OR pos < (SELECT max(pos) FROM lst WHERE key = 'order:1') UNION ALL SELECT 'order:2', -1, elem FROM m) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, elem FROM a", "lst")
def _(s, d):
    return lists.lmove(f.lst(s, d), "order:1", "order:2", False, True)


@query("list_lmpop", "SELECT key, pos, elem FROM lst WHERE key = 'order:3' ORDER BY pos LIMIT 2", "lst")
def _(s, d):
    return lists.lmpop(f.lst(s, d), ["none", "order:3", "order:1"], 2)


# Hashes.


@query("hash_hset", ", d AS (SELECT DISTINCT key, 'status' AS field, 'new' AS value FROM hsh WHERE key LIKE '%7' UNION ALL SELECT DISTINCT key, 'extra', '1' FROM hsh WHERE key LIKE '%7') SELECT * FROM d UNION ALL SELECT key, field, value FROM hsh WHERE (key, field) NOT IN (SELECT key, field FROM d)", "hsh")
def _(s, d):
    x = f.hsh(s, d)
    delta = x.where(C("key").endswith("7")).select("key").distinct().select("key", F.inline(F.array(F.struct(F.lit("status").alias("field"), F.lit("new").alias("value")), F.struct(F.lit("extra").alias("field"), F.lit("1").alias("value")))))
    return hashes.hset(x, delta)


@query("hash_hmget", "SELECT key, max(value) FILTER (WHERE field = 'status') AS a, max(value) FILTER (WHERE field = 'none') AS b, max(value) FILTER (WHERE field = 'cust') AS c FROM hsh WHERE field IN ('status', 'none', 'cust') GROUP BY key", "hsh")
def _(s, d):
    v = C("values")
    return hashes.hmget(f.hsh(s, d), ["status", "none", "cust"]).select("key", v[0].alias("a"), v[1].alias("b"), v[2].alias("c"))


@query("hash_hgetall", "SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS pairs FROM hsh GROUP BY key", "hsh")
def _(s, d):
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return hashes.hgetall(f.hsh(s, d)).select("key", F.array_join(F.array_sort(pairs), ",").alias("pairs"))


@query("hash_hincrby", ", l AS (SELECT 'order:' || l_orderkey AS key, sum(l_quantity::BIGINT)::BIGINT AS inc FROM lineitem GROUP BY 1) SELECT key, field, CASE WHEN field = 'total' AND inc IS NOT NULL THEN (value::BIGINT + inc)::VARCHAR ELSE value END AS value FROM hsh LEFT JOIN l USING (key)", "hsh")
def _(s, d):
    x = f.hsh(s, d)
    log = f.table(s, d, "lineitem").select(F.concat(F.lit("order:"), "l_orderkey").alias("key"), F.lit("total").alias("field"), C("l_quantity").cast("long").alias("by"))
    return hashes.hincrby(x, log)


@query("hash_hdel", "SELECT key, field, value FROM hsh WHERE field NOT IN ('cust', 'total')", "hsh")
def _(s, d):
    return hashes.hdel(f.hsh(s, d), ["cust", "total"])


@query("hash_hstrlen", "SELECT key, strlen(value)::INT AS n FROM hsh WHERE field = 'priority'", "hsh")
def _(s, d):
    return hashes.hstrlen(f.hsh(s, d), "priority")


@query("hash_hscan", "SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) AS r FROM hsh WHERE regexp_matches(field, '^.*t.*$')) WHERE r BETWEEN 2 AND 3", "hsh")
def _(s, d):
    return hashes.hscan(f.hsh(s, d), 1, "*t*", 2)


@query("hash_hlen", "SELECT key, count(*) AS n FROM hsh GROUP BY key", "hsh")
def _(s, d):
    return hashes.hlen(f.hsh(s, d))


# Sets.

for _name, _fn, _set in (("sinter", sets.sinter, "INTERSECT"), ("sunion", sets.sunion, "UNION"), ("sdiff", sets.sdiff, "EXCEPT")):

    @query(f"set_{_name}", f"SELECT member FROM st WHERE key = 'supp:1' {_set} SELECT member FROM st WHERE key = 'supp:2'" + (" INTERSECT SELECT member FROM st WHERE key = 'supp:3'" if _set == "INTERSECT" else ""), "st")
    def _(s, d, fn=_fn, three=_set == "INTERSECT"):
        return fn(f.st(s, d), ["supp:1", "supp:2", "supp:3"] if three else ["supp:1", "supp:2"])


@query("set_sintercard", "SELECT least(100, count(*))::BIGINT AS n FROM (SELECT member FROM st WHERE key = 'supp:1' INTERSECT SELECT member FROM st WHERE key = 'supp:2')", "st")
def _(s, d):
    return sets.sintercard(f.st(s, d), ["supp:1", "supp:2"], 100)


@query("set_smismember", "SELECT place, m AS member, EXISTS (SELECT 1 FROM st WHERE key = 'supp:1' AND member = m) AS found FROM (VALUES (0, '5'), (1, 'none'), (2, '17')) a(place, m)", "st")
def _(s, d):
    return sets.smismember(f.st(s, d), "supp:1", ["5", "none", "17"])


@query("set_smove", "SELECT DISTINCT CASE WHEN key = 'supp:1' AND member = '5' THEN 'supp:3' ELSE key END AS key, member FROM st", "st")
def _(s, d):
    return sets.smove(f.st(s, d), "supp:1", "supp:3", "5")


@query("set_scard", "SELECT key, count(*) AS n FROM st GROUP BY key", "st")
def _(s, d):
    return sets.scard(f.st(s, d))


@query("set_store", "SELECT key, member FROM st UNION ALL SELECT 'out', member FROM (SELECT member FROM st WHERE key = 'supp:1' EXCEPT SELECT member FROM st WHERE key = 'supp:2')", "st")
def _(s, d):
    x = f.st(s, d)
    return sets.store(x, "out", sets.sdiff(x, ["supp:1", "supp:2"]))


@query("set_srandmember", "SELECT key, 3::BIGINT AS n FROM (SELECT DISTINCT key FROM st)", "st")
def _(s, d):
    return sets.scard(sets.srandmember(f.st(s, d), 3, 1))


# Sorted sets.


@query("zset_topk", "SELECT key, member, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM zs) WHERE rank < 3", "zs")
def _(s, d):
    return zsets.zrange(f.zs(s, d), 0, 2, rev=True)


@query("zset_rank", "SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS revrank FROM zs", "zs")
def _(s, d):
    return zsets.zrank(f.zs(s, d))


@query("zset_range_negative", ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS c FROM zs) SELECT key, member, score, rank FROM r WHERE rank >= greatest(0, c - 3) AND rank <= c - 2", "zs")
def _(s, d):
    return zsets.zrange(f.zs(s, d), -3, -2)


@query("zset_range_by_score", ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM zs WHERE score > 1000 AND score <= 5000) SELECT key, member, score, rank FROM r WHERE rank BETWEEN 1 AND 5", "zs")
def _(s, d):
    return zsets.zrangebyscore(f.zs(s, d), "(1000", 5000, 1, 5, rev=True)


@query("zset_range_by_lex", ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS rank FROM zs WHERE member >= 'c1' AND member < 'c5') SELECT key, member, score, rank FROM r WHERE rank < 4", "zs")
def _(s, d):
    return zsets.zrangebylex(f.zs(s, d), "[c1", "(c5", 0, 4)


@query("zset_zcount", "SELECT key, count(*) AS n FROM zs WHERE score >= 0 AND score < 5000 GROUP BY key", "zs")
def _(s, d):
    return zsets.zcount(f.zs(s, d), 0, "(5000")


@query("zset_zlexcount", "SELECT key, count(*) AS n FROM zs WHERE member > 'c2' GROUP BY key", "zs")
def _(s, d):
    return zsets.zlexcount(f.zs(s, d), "(c2", "+")


for _how in ("sum", "min", "max"):
    _w = f"SELECT member, {_how}(CASE key WHEN 'supp:1' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END * score) AS score FROM zq WHERE key IN ('supp:1', 'supp:2') GROUP BY member"

    @query(f"zset_zunion_{_how}", _w, "zq")
    def _(s, d, how=_how):
        return zsets.zunion(f.zq(s, d), ["supp:1", "supp:2"], [2.0, 0.5], how)

    @query(f"zset_zinter_{_how}", _w + " HAVING count(DISTINCT key) = 2", "zq")
    def _(s, d, how=_how):
        return zsets.zinter(f.zq(s, d), ["supp:1", "supp:2"], [2.0, 0.5], how)


@query("zset_zdiff", "SELECT member, score FROM zq WHERE key = 'supp:1' AND member NOT IN (SELECT member FROM zq WHERE key = 'supp:2')", "zq")
def _(s, d):
    return zsets.zdiff(f.zq(s, d), ["supp:1", "supp:2"])


@query("zset_zintercard", "SELECT count(*) AS n FROM (SELECT member FROM zq WHERE key = 'supp:1' INTERSECT SELECT member FROM zq WHERE key = 'supp:2')", "zq")
def _(s, d):
    return zsets.zintercard(f.zq(s, d), ["supp:1", "supp:2"])


@query("zset_zunionstore", "SELECT key, member, score FROM zq UNION ALL SELECT 'out', member, sum(score) FROM zq WHERE key IN ('supp:1', 'supp:2', 'supp:3') GROUP BY member", "zq")
def _(s, d):
    x = f.zq(s, d)
    return zsets.store(x, "out", zsets.zunion(x, ["supp:1", "supp:3", "supp:2"]))


for _cmp, _op in {"gt": ">", "lt": "<"}.items():

    @query(f"zset_zadd_{_cmp}", f", d AS (SELECT 'supp:1' AS key, member, score FROM zq WHERE key = 'supp:2') SELECT key, member, CASE WHEN a.score IS NULL THEN d.score WHEN d.score {_op} a.score THEN d.score ELSE a.score END AS score FROM zq a FULL JOIN d USING (key, member)", "zq")
    def _(s, d, cmp=_cmp):
        x = f.zq(s, d)
        return zsets.zadd(x, x.where("key = 'supp:2'").withColumn("key", F.lit("supp:1")), compare=cmp)


@query("zset_zincrby", "SELECT key, member, sum(score) AS score FROM (SELECT * FROM zq UNION ALL SELECT 'supp:1', member, 3 FROM zq WHERE key = 'supp:2') GROUP BY key, member", "zq")
def _(s, d):
    x = f.zq(s, d)
    return zsets.zincrby(x, x.where("key = 'supp:2'").select(F.lit("supp:1").alias("key"), "member", F.lit(3).alias("by")))


@query("zset_popmin", ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM zs) SELECT key, member, score FROM r WHERE rank >= 2", "zs")
def _(s, d):
    return zsets.zpop(f.zs(s, d), 2)[1]


@query("zset_zmpop", "SELECT key, member, score FROM zs WHERE key = 'nation:3' ORDER BY score DESC, member DESC LIMIT 3", "zs")
def _(s, d):
    return zsets.zmpop(f.zs(s, d), ["none", "nation:3"], 3, smallest=False)


@query("zset_zmscore", "SELECT place, m AS member, (SELECT score FROM zq WHERE key = 'supp:1' AND member = m) AS score FROM (VALUES (0, '5'), (1, 'none'), (2, '17')) a(place, m)", "zq")
def _(s, d):
    return zsets.zmscore(f.zq(s, d), "supp:1", ["5", "none", "17"])


@query("zset_remrangebyrank", ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS c FROM zs) SELECT key, member, score FROM r WHERE rank < 1 OR rank > c - 3", "zs")
def _(s, d):
    return zsets.zremrangebyrank(f.zs(s, d), 1, -3)


@query("zset_remrangebyscore", "SELECT key, member, score FROM zs WHERE NOT (score >= 0 AND score <= 5000)", "zs")
def _(s, d):
    return zsets.zremrangebyscore(f.zs(s, d), 0, 5000)


@query("zset_remrangebylex", "SELECT key, member, score FROM zs WHERE NOT (member >= 'c1' AND member < 'c5')", "zs")
def _(s, d):
    return zsets.zremrangebylex(f.zs(s, d), "[c1", "(c5")


@query("zset_zscan", "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS r FROM zs WHERE member LIKE 'c1%') WHERE r BETWEEN 2 AND 3", "zs")
def _(s, d):
    return zsets.zscan(f.zs(s, d), 1, "c1*", 2)


# Bitmaps.


@query("bit_count", "SELECT key, count(*) AS n FROM bm WHERE offset_ >= 8 AND offset_ < 32 GROUP BY key", "bm")
def _(s, d):
    return bitmaps.bitcount(f.bm(s, d), 1, 3)


@query("bit_get", "SELECT key, max((offset_ = 17)::INT) AS bit FROM bm GROUP BY key", "bm")
def _(s, d):
    return bitmaps.getbit(f.bm(s, d), 17)


@query("bit_pos", ", k AS (SELECT DISTINCT key FROM bm), s AS (SELECT key, min(offset_) AS one FROM bm WHERE offset_ >= 10 GROUP BY key), z AS (SELECT key, (SELECT min(i) FROM range(10, 100000) r(i) WHERE i NOT IN (SELECT offset_ FROM bm WHERE bm.key = k.key)) AS zero FROM k) SELECT key, coalesce(one, -1)::BIGINT AS one, zero::BIGINT AS zero FROM k LEFT JOIN s USING (key) LEFT JOIN z USING (key)", "bm")
def _(s, d):
    x = f.bm(s, d)
    return bitmaps.bitpos(x, 1, 10).withColumnRenamed("pos", "one").join(bitmaps.bitpos(x, 0, 10).withColumnRenamed("pos", "zero"), "key")


_BITS = ", c AS (SELECT offset_, count(DISTINCT key) AS n, max((key = 'click')::INT) AS f FROM bm WHERE key IN ('click', 'view', 'error') GROUP BY offset_) SELECT offset_ AS \"offset\" FROM c WHERE "
for _op, _ok in {"and": "n = 3", "or": "true", "xor": "n % 2 = 1", "diff": "f = 1 AND n = 1", "diff1": "f = 0", "andor": "f = 1 AND n > 1", "one": "n = 1"}.items():

    @query(f"bit_op_{_op}", _BITS + _ok, "bm")
    def _(s, d, op=_op):
        return bitmaps.bitop(f.bm(s, d), op, ["click", "view", "error"])


@query("bit_op_not", ", m AS (SELECT offset_ AS o FROM bm WHERE key = 'click') SELECT i AS \"offset\" FROM range(0, (SELECT ((max(o) // 8) + 1) * 8 FROM m)::BIGINT) r(i) WHERE i NOT IN (SELECT o FROM m)", "bm")
def _(s, d):
    return bitmaps.bitop(f.bm(s, d), "not", ["click"])


@query("bit_field", "SELECT key, (ascii(value[1]) * 16 + ascii(value[2]) // 16)::BIGINT AS u12, ascii(value[2])::BIGINT AS i8 FROM kv", "kv")
def _(s, d):
    v = C("value").cast("binary")
    return f.kv(s, d).select("key", bitmaps.bitfield_get(v, "u12", 0).alias("u12"), bitmaps.bitfield_get(v, "i8", 8).alias("i8"))
