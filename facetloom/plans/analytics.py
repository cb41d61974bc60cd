"""Queries on sketches, time series, logs, JSON, places, vectors, full text, graphs, channels and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facetloom.operators import geo, graph, jsondocs, logs, pubsub, scripts, search, sketches, timeseries, vectors
from facetloom.sources import facets as f
from facetloom.sources import shared, snapshots
from facetloom.sources.facets import MS, sql
from facetloom.streaming import windows

C = F.col
QUERIES: dict[str, tuple] = {}


def query(name: str, body: str | None, uses: str = ""):
    def add(fn):
        QUERIES[name] = (fn, None if body is None else sql(uses, body) if uses else body)
        return fn

    return add


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# Sketches: approximate answers beside exact ones, inside their bounds.


@query("hll_within_bound", "SELECT l_returnflag AS key, true AS ok FROM lineitem GROUP BY 1")
def _(s, d):
    x = f.table(s, d, "lineitem")
    n = sketches.pfcount(sketches.pfmerge(sketches.pfadd(x, ["l_returnflag", "l_linestatus"], "l_partkey"), ["l_returnflag"]))
    exact = x.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    return n.join(exact, "l_returnflag").select(C("l_returnflag").alias("key"), (F.abs(C("n") - C("exact")) <= 0.05 * C("exact")).alias("ok"))


@query("bloom_exists", "SELECT 's' AS key, l_partkey AS item, true AS found FROM lineitem GROUP BY 2")
def _(s, d):
    x = f.table(s, d, "lineitem").select(F.lit("s").alias("key"), C("l_partkey").alias("item"))
    bits = sketches.bloom(x.distinct(), ["key"], "item", 20_000)
    return sketches.bloom_exists(bits, ["key"], x.distinct(), "item", 20_000)


@query("bloom_false_rate", "SELECT true AS ok")
def _(s, d):
    x = f.table(s, d, "lineitem").select(F.lit("s").alias("key"), C("l_partkey").alias("item")).distinct()
    bits = sketches.bloom(x, ["key"], "item", 40_000)
    others = x.withColumn("item", -1 - C("item"))
    return sketches.bloom_exists(bits, ["key"], others, "item", 40_000).agg((F.avg(C("found").cast("int")) <= 0.03).alias("ok"))


@query("cuckoo_count", "SELECT l_returnflag AS key, true AS ok FROM lineitem GROUP BY 1")
def _(s, d):
    x = f.table(s, d, "lineitem").select(C("l_returnflag").alias("key"), C("l_partkey").alias("item"))
    table = sketches.cuckoo_delete(sketches.cuckoo(x, ["key"], "item"), ["key"], x.distinct(), "item")
    truth = x.groupBy("key", "item").agg((F.count("*") - 1).alias("truth"))
    return sketches.cuckoo_count(table, ["key"], truth, "item").groupBy("key").agg(F.min(C("n") >= C("truth")).alias("ok"))


@query("cms_bounds", "SELECT l_returnflag AS key, true AS never_under, true AS near FROM lineitem GROUP BY 1")
def _(s, d):
    x = f.table(s, d, "lineitem").select(C("l_returnflag").alias("key"), C("l_partkey").alias("item"), C("l_quantity").cast("long").alias("q"))
    width, depth = sketches.cms_size(0.001, 0.99)
    merged = sketches.cms_merge([(sketches.cms(x.where("item % 2 = 0"), ["key"], "item", C("q"), width, depth), 1), (sketches.cms(x.where("item % 2 = 1"), ["key"], "item", C("q"), width, depth), 1)], ["key"])
    truth = x.groupBy("key", "item").agg(F.sum("q").alias("truth"))
    total = x.groupBy("key").agg(F.sum("q").alias("total"))
    both = sketches.cms_query(merged, ["key"], truth, "item", width, depth).join(truth, ["key", "item"]).join(total, "key")
    return both.groupBy("key").agg(F.min(C("n") >= C("truth")).alias("never_under"), (F.avg((C("n") - C("truth") <= 0.001 * C("total")).cast("int")) >= 0.99).alias("near"))


@query("topk_exact", "SELECT key, item, n, rank FROM (SELECT l_returnflag AS key, l_partkey AS item, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 5")
def _(s, d):
    return sketches.topk(f.table(s, d, "lineitem").select(C("l_returnflag").alias("key"), C("l_partkey").alias("item")), ["key"], "item", 5)


@query("topk_approx", "SELECT 5::BIGINT AS n")
def _(s, d):
    return sketches.topk_approx(f.table(s, d, "lineitem").select(F.lit(1).alias("key"), C("l_quantity").cast("long").alias("item")), ["key"], "item", 5).agg(F.count("*").alias("n"))


@query("quantile_exact", "SELECT event_type AS key, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY 1")
def _(s, d):
    q = sketches.quantiles(f.table(s, d, "events"), ["event_type"], "value", [0.5, 0.99])
    return q.select(C("event_type").alias("key"), F.round(C("quantiles")[0], 6).alias("q50"), F.round(C("quantiles")[1], 6).alias("q99"))


@query("quantile_cdf", "SELECT event_type AS key, round((count(*) FILTER (WHERE value < 50) + count(*) FILTER (WHERE value = 50) / 2) / count(*), 9) AS cdf FROM events GROUP BY 1")
def _(s, d):
    return sketches.cdf(f.table(s, d, "events"), ["event_type"], "value", [50.0]).select(C("event_type").alias("key"), F.round("cdf0", 9).alias("cdf"))


@query("quantile_byrank", "SELECT key, rank, value FROM (SELECT event_type AS key, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rank FROM events) WHERE rank IN (0, 10, 100)")
def _(s, d):
    return sketches.byrank(f.table(s, d, "events").withColumnRenamed("event_type", "key"), ["key"], "value", [0, 10, 100])


@query("quantile_trimmed_mean", ", q AS (SELECT event_type, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS b FROM events GROUP BY 1) SELECT event_type AS key, round(avg(value), 6) AS mean FROM events JOIN q USING (event_type) WHERE value BETWEEN a AND b GROUP BY 1", "kv")
def _(s, d):
    return sketches.trimmed_mean(f.table(s, d, "events"), ["event_type"], "value", 0.1, 0.9).select(C("event_type").alias("key"), _r("mean"))


# Time series.

START, END, HOURS = 1_704_067_200_123, 1_706_659_200_000, 6 * 3_600_000
_BUCKET = f"{START} + (ts_ms - {START}) // {HOURS} * {HOURS} AS bucket"
_AGG = {
    "avg": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "range": "max(value) - min(value)", "count": "count(*)::DOUBLE", "first": "arg_min(value, ts_ms)", "last": "arg_max(value, ts_ms)",
    "stdp": "CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(value) END", "stds": "CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(value) END", "varp": "CASE WHEN count(*) < 2 THEN 0 ELSE var_pop(value) END", "vars": "CASE WHEN count(*) < 2 THEN 0 ELSE var_samp(value) END",
}
for _how, _sql in _AGG.items():

    # A logarithm has no ties at which two engines would round apart.
    _shown = f"round({f'ln(1 + {_sql})' if _how.startswith('var') else _sql}, 4)"
    if _how == "avg":  # half up, in whole numbers: values have six digits at most
        _shown = "((2 * sum(round(value * 1000000)::HUGEINT) + 100 * count(*)) // (200 * count(*)))::DOUBLE / 10000"

    @query(f"ts_range_{_how}", f"SELECT series, {_BUCKET}, {_shown} AS value FROM ts WHERE ts_ms BETWEEN {START} AND {END} GROUP BY ALL", "ts")
    def _(s, d, how=_how):
        x = f.ts(s, d)
        x = timeseries.add(x, "sum") if how in ("first", "last") else x
        # Averages are of decimals, on both sides: whole cents lie on the ties of a rounding, where sums of doubles differ by their order.
        x = x.withColumn("value", C("value").cast("decimal(18,6)")) if how == "avg" else x
        found = timeseries.aggregate(x, how, HOURS, START, END)
        return found.withColumn("value", F.round(F.log1p("value") if how.startswith("var") else "value", 4).cast("double"))

    if _how in ("first", "last"):
        QUERIES[f"ts_range_{_how}"] = (QUERIES[f"ts_range_{_how}"][0], sql("ts", f", u AS (SELECT series, ts_ms, sum(value) AS value FROM ts GROUP BY ALL) SELECT series, {_BUCKET}, round({_sql}, 4) AS value FROM u WHERE ts_ms BETWEEN {START} AND {END} GROUP BY ALL"))

@query("ts_range_twa", f", w AS (SELECT *, {_BUCKET} FROM ts WHERE ts_ms BETWEEN {START} AND {END}), p AS (SELECT *, lead(ts_ms) OVER o - ts_ms AS dt, lead(value) OVER o AS nv FROM w WINDOW o AS (PARTITION BY series, bucket ORDER BY ts_ms, event_id)) SELECT series, bucket, round(CASE WHEN coalesce(sum(dt), 0) > 0 THEN sum((value + nv) / 2 * dt) / sum(dt) ELSE arg_min(value, ts_ms) END, 6) AS value FROM p GROUP BY ALL", "ts")
def _(s, d):
    return timeseries.aggregate(f.ts(s, d), "twa", HOURS, START, END).withColumn("value", F.round("value", 6))


for _policy, _sql in {"first": "arg_min(value, event_id)", "last": "arg_max(value, event_id)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)"}.items():

    @query(f"ts_duplicates_{_policy}", f"SELECT series, ts_ms // 60000 * 60000 AS ts_ms, round({_sql}, 6) AS value FROM ts GROUP BY ALL", "ts")
    def _(s, d, policy=_policy):
        x = f.ts(s, d).withColumn("ts_ms", (F.floor(C("ts_ms") / 60_000) * 60_000).cast("long"))
        return timeseries.add(x, policy).withColumn("value", F.round("value", 6))


@query("ts_retention", "SELECT series, ts_ms, value FROM (SELECT *, max(ts_ms) OVER (PARTITION BY series) AS m FROM ts) WHERE ts_ms >= m - 86400000", "ts")
def _(s, d):
    return timeseries.retain(f.ts(s, d), 86_400_000).select("series", "ts_ms", "value")


@query("ts_get", "SELECT series, max(ts_ms) AS ts_ms, arg_max(value, ts_ms * 1000000 + event_id) AS value FROM ts GROUP BY series", "ts")
def _(s, d):
    return timeseries.latest(f.ts(s, d))


@query("ts_info", "SELECT series, count(*) AS total, min(ts_ms) AS first, max(ts_ms) AS last FROM ts GROUP BY series", "ts")
def _(s, d):
    return timeseries.info(f.ts(s, d))


@query("ts_revrange", "SELECT series, event_id FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts_ms DESC, event_id DESC) AS r FROM ts WHERE value BETWEEN 10 AND 60) WHERE r <= 5", "ts")
def _(s, d):
    x = f.ts(s, d).withColumn("sample_ms", C("ts_ms")).withColumn("ts_ms", C("ts_ms") * 1_000_000 + C("event_id"))
    return timeseries.range_(x, 0, (1 << 63) - 1, 5, rev=True, low=10.0, high=60.0).select("series", "event_id")


@query("ts_del", f"SELECT series, count(*) AS n FROM ts WHERE ts_ms < {START + 86400000} OR ts_ms > {START + 5 * 86400000} GROUP BY series", "ts")
def _(s, d):
    return timeseries.delete(f.ts(s, d), START + 86_400_000, START + 5 * 86_400_000).groupBy("series").agg(F.count("*").alias("n"))


@query("ts_incrby", "SELECT series, 1800000000000 AS ts_ms, arg_max(value, ts_ms * 1000000 + event_id) + 1.5 AS value FROM ts GROUP BY series", "ts")
def _(s, d):
    return timeseries.incrby(f.ts(s, d), 1.5, 1_800_000_000_000)


def _labels(s, d):
    e = f.table(s, d, "events").select(F.concat("event_type", F.lit(":"), "user_id").alias("series"), "event_type", "user_id").distinct()
    return e.select("series", F.create_map(F.lit("type"), "event_type", F.lit("user"), C("user_id").cast("string")).alias("labels"))


@query("ts_queryindex", "SELECT DISTINCT event_type || ':' || user_id AS series FROM events WHERE event_type IN ('view', 'click') AND user_id <> 7")
def _(s, d):
    return timeseries.query_index(_labels(s, d), ["type=(view,click)", "user!=7", "none="])


@query("ts_mrange", f"SELECT event_type AS type, {START} + ({MS} - {START}) // {HOURS} * {HOURS} AS bucket, round(max(value), 6) AS value FROM events WHERE event_type IN ('view', 'click') AND user_id <> 7 AND {MS} BETWEEN {START} AND {END} GROUP BY ALL")
def _(s, d):
    x = f.table(s, d, "events").select(F.concat("event_type", F.lit(":"), "user_id").alias("series"), f.millis("ts").alias("ts_ms"), "value")
    mine = timeseries.select(x, _labels(s, d), ["type=(view,click)", "user!=7"]).withColumn("type", C("labels")["type"])
    return timeseries.aggregate(mine, "max", HOURS, START, END, ["type"]).withColumn("value", F.round("value", 6))


@query("ts_downsample", "SELECT 'click:h' AS series, ts_ms // 3600000 * 3600000 AS ts_ms, round(avg(value), 6) AS value FROM ts WHERE series = 'click' GROUP BY ALL UNION ALL SELECT 'view:d', ts_ms // 86400000 * 86400000, round(sum(value), 6) FROM ts WHERE series = 'view' GROUP BY ALL", "ts")
def _(s, d):
    return timeseries.downsample(f.ts(s, d), [("click", "click:h", "avg", 3_600_000), ("view", "view:d", "sum", 86_400_000)]).withColumn("value", F.round("value", 6))


# Logs.


@query("xs_xadd", "SELECT key, ms, seq FROM xs UNION ALL SELECT key, max(ms), max(seq) FILTER (WHERE ms = m) + 1 FROM (SELECT *, max(ms) OVER (PARTITION BY key) AS m FROM xs) GROUP BY key", "xs")
def _(s, d):
    x = f.xs(s, d)
    new = x.groupBy("key").agg(F.max("ms").alias("ms")).withColumns({"user_id": F.lit(1).cast("long"), "value": F.lit(0.0)})
    return logs.xadd(x, new).select("key", "ms", "seq")


@query("xs_xrange", "SELECT key, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS r FROM xs WHERE ms BETWEEN 1704200000000 AND 1705000000000) WHERE r <= 20", "xs")
def _(s, d):
    return logs.xrange(f.xs(s, d), "1704200000000", "1705000000000", 20).select("key", "ms", "seq")


@query("xs_xrevrange", "SELECT key, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS r FROM xs) WHERE r <= 3", "xs")
def _(s, d):
    return logs.xrange(f.xs(s, d), count=3, rev=True).select("key", "ms", "seq")


@query("xs_xread", "SELECT key, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS r FROM xs WHERE ms > 1705000000000 OR (ms = 1705000000000 AND seq > 3)) WHERE r <= 10", "xs")
def _(s, d):
    return logs.xread(f.xs(s, d), "1705000000000-3", 10).select("key", "ms", "seq")


@query("xs_trim", "SELECT key, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS r FROM xs) WHERE r <= 100 AND ms >= 1704200000000", "xs")
def _(s, d):
    return logs.xtrim_minid(logs.xtrim_maxlen(f.xs(s, d), 100), "1704200000000").select("key", "ms", "seq")


@query("xs_info", "SELECT key, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM xs GROUP BY key", "xs")
def _(s, d):
    return logs.xinfo(f.xs(s, d)).select("key", "n", "first_ms", "last_ms")


def _group(s, d, count=None):
    x = f.xs(s, d)
    groups = x.select("key").distinct().select("key", F.lit("g").alias("grp"), F.lit(1_704_200_000_000).alias("ms"), F.lit(0).cast("long").alias("seq"))
    return x, *logs.xreadgroup(x, groups, F.concat(F.lit("c"), C("user_id") % 3), 1_800_000_000_000, count)


_P = ", p AS (SELECT key, 'g' AS grp, ms, seq, 'c' || (user_id % 3) AS consumer FROM xs WHERE ms > 1704200000000 OR (ms = 1704200000000 AND seq > 0)) "


@query("xs_readgroup", _P + "SELECT key, grp, max(ms) AS ms, count(*) AS n FROM p GROUP BY ALL", "xs")
def _(s, d):
    _, new, after, _ = _group(s, d)
    return after.select("key", "grp", "ms").join(new.groupBy("key", "grp").agg(F.count("*").alias("n")), ["key", "grp"])


@query("xs_pending", _P + ", b AS (SELECT key, grp, consumer, count(*) AS n FROM p GROUP BY ALL) SELECT key, grp, total, min_ms, max_ms, consumers FROM (SELECT key, grp, count(*) AS total, min(ms) AS min_ms, max(ms) AS max_ms FROM p GROUP BY ALL) JOIN (SELECT key, grp, string_agg(consumer || '=' || n, ',' ORDER BY consumer) AS consumers FROM b GROUP BY ALL) USING (key, grp)", "xs")
def _(s, d):
    pairs = F.array_join(F.transform("consumers", lambda c: F.concat(c["consumer"], F.lit("="), c["n"])), ",")
    return logs.xpending(_group(s, d)[3]).withColumn("consumers", pairs)


@query("xs_ack", _P + "SELECT key, ms, seq, consumer FROM p WHERE consumer <> 'c1'", "xs")
def _(s, d):
    pending = _group(s, d)[3]
    return logs.xack(pending, pending.where("consumer = 'c1'")).select("key", "ms", "seq", "consumer")


@query("xs_autoclaim", _P + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS r FROM p) SELECT key, ms, seq, CASE WHEN r <= 50 THEN 'new' ELSE consumer END AS consumer, CASE WHEN r <= 50 THEN 2 ELSE 1 END AS deliveries FROM r", "xs")
def _(s, d):
    return logs.xautoclaim(_group(s, d)[3], "new", 1_800_000_060_000, 60_000, count=50).select("key", "ms", "seq", "consumer", "deliveries")


@query("xs_claim", _P + "SELECT key, ms, seq, CASE WHEN consumer = 'c2' THEN 'new' ELSE consumer END AS consumer FROM p", "xs")
def _(s, d):
    pending = _group(s, d)[3]
    return logs.xclaim(pending, pending.where("consumer = 'c2'"), "new", 1_800_000_060_000, 1).select("key", "ms", "seq", "consumer")


# JSON.


@query("json_get", "SELECT key, doc ->> '$.name' AS name, doc ->> '$.sub.a' AS a, doc ->> '$.tags[1]' AS tag, doc ->> '$.none' AS none FROM js", "js")
def _(s, d):
    return f.js(s, d).select("key", jsondocs.get("$.name").alias("name"), jsondocs.get("sub.a").alias("a"), jsondocs.get("$.tags.[1]").alias("tag"), jsondocs.get("$.none").alias("none"))


@query("json_type", "SELECT key, 'integer' AS a, 'boolean' AS b, 'string' AS c, 'array' AS d, 'object' AS e, 'null' AS f, NULL::VARCHAR AS g FROM js", "js")
def _(s, d):
    return f.js(s, d).select("key", *(jsondocs.kind(p).alias(n) for p, n in (("$.cust", "a"), ("$.flag", "b"), ("$.name", "c"), ("$.tags", "d"), ("$.sub", "e"), ("$.sub.b", "f"), ("$.none", "g"))))


@query("json_lengths", "SELECT key, 3::BIGINT AS arr, 2::BIGINT AS obj, 'a,b' AS keys, strlen(doc ->> '$.name')::INT AS str, CASE WHEN doc ->> '$.tags[0]' = 'F' THEN 0 ELSE -1 END::BIGINT AS at FROM js", "js")
def _(s, d):
    return f.js(s, d).select("key", jsondocs.arrlen("$.tags").alias("arr"), jsondocs.objlen("$.sub").alias("obj"), F.array_join(jsondocs.objkeys("$.sub"), ",").alias("keys"), jsondocs.strlen("$.name").alias("str"), jsondocs.arrindex("$.tags", "F").alias("at"))


@query("json_writes", "SELECT key, replace(replace(replace(doc, '\"flag\":true', '\"flag\":XX'), '\"flag\":false', '\"flag\":true'), '\"flag\":XX', '\"flag\":false') AS toggled, replace(doc, ',\"sub\":{\"a\":' || (doc ->> '$.sub.a') || ',\"b\":null}', '') AS deleted, replace(doc, '\"x\",', '\"x\",\"y\",') AS inserted, replace(doc, '\"b\":null', '\"b\":1') AS set FROM js", "js")
def _(s, d):
    x = f.js(s, d)
    out = x.select("key")
    for name, new in (("toggled", jsondocs.toggle(x, "$.flag")), ("deleted", jsondocs.delete(x, "$.sub")), ("inserted", jsondocs.arrinsert(x, "$.tags", 2, ["y"])), ("set", jsondocs.set_(x, "$.sub.b", 1))):
        out = out.join(new.withColumnRenamed("doc", name), "key")
    return out


@query("json_numbers", "SELECT key, (doc ->> '$.sub.a')::DOUBLE + 2.5 AS up, (doc ->> '$.sub.a')::DOUBLE * 3 AS times FROM js", "js")
def _(s, d):
    x = f.js(s, d)
    up = jsondocs.numincrby(x, "$.sub.a", 2.5).select("key", jsondocs.get("$.sub.a").cast("double").alias("up"))
    return up.join(jsondocs.nummultby(x, "$.sub.a", 3).select("key", jsondocs.get("$.sub.a").cast("double").alias("times")), "key")


@query("json_merge", "SELECT key, doc ->> '$.name' AS name, doc ->> '$.sub.a' AS a, 'v' AS c, NULL::VARCHAR AS flag FROM js", "js")
def _(s, d):
    x = jsondocs.merge(f.js(s, d), "$", {"flag": None, "sub": {"c": "v"}})
    return x.select("key", jsondocs.get("$.name").alias("name"), jsondocs.get("$.sub.a").alias("a"), jsondocs.get("$.sub.c").alias("c"), jsondocs.get("$.flag").alias("flag"))


@query("json_arrays", "SELECT key, json_array(doc ->> '$.tags[1]', doc ->> '$.tags[2]')::VARCHAR AS popped, json_array(doc ->> '$.tags[0]', 'x')::VARCHAR AS trimmed, json_array(doc ->> '$.tags[0]', 'x', doc ->> '$.tags[2]', 'z')::VARCHAR AS more, '[]' AS clear FROM js", "js")
def _(s, d):
    x = f.js(s, d)
    out = x.select("key")
    for name, new in (("popped", jsondocs.arrpop(x, "$.tags", 0)), ("trimmed", jsondocs.arrtrim(x, "$.tags", 0, 1)), ("more", jsondocs.arrappend(x, "$.tags", ["z"])), ("clear", jsondocs.clear(x, "$.tags"))):
        out = out.join(new.select("key", jsondocs.get("$.tags").alias(name)), "key")
    return out


# Places.

_DIST = "2.0 * 6372797.560856 * asin(sqrt(sin(radians({b} - {a}) / 2) * sin(radians({b} - {a}) / 2) + cos(radians({a})) * cos(radians({b})) * sin(radians({d} - {c}) / 2) * sin(radians({d} - {c}) / 2)))"


def _dist(a: str, b: str, c: str, d: str) -> str:
    return _DIST.format(a=a, b=b, c=c, d=d)


@query("geo_encode", ", c AS (SELECT member, floor((lon + 180) / 360.0::DOUBLE * 67108864)::BIGINT AS x, floor((lat + 85.05112878) / 170.10225756::DOUBLE * 67108864)::BIGINT AS y FROM geo) SELECT member, (SELECT sum(((y >> i) & 1) * (1::BIGINT << (2 * i)) + ((x >> i) & 1) * (1::BIGINT << (2 * i + 1)))::BIGINT FROM range(26) r(i)) AS cell, round(x / 67108864.0::DOUBLE * 360 - 180, 6) AS lon, round(y / 67108864.0::DOUBLE * 170.10225756::DOUBLE - 85.05112878, 6) AS lat FROM c", "geo")
def _(s, d):
    x = f.geo(s, d).select("member", geo.encode(C("lon"), C("lat")).alias("cell"))
    lon, lat = geo.decode(C("cell"))
    return x.select("member", "cell", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("geo_radius", f"SELECT member, round({_dist('10.0', 'lat', '20.0', 'lon')} / 1000, 4) AS dist FROM geo WHERE {_dist('10.0', 'lat', '20.0', 'lon')} / 1000 <= 2500", "geo")
def _(s, d):
    return geo.radius(f.geo(s, d), 20.0, 10.0, 2500, "km").select("member", _r("dist", 4))


@query("geo_box", f"SELECT member FROM geo WHERE {_dist('10.0', 'lat', '20.0', '20.0')} / 1000 <= 1000 AND {_dist('lat', 'lat', '20.0', 'lon')} / 1000 <= 1500", "geo")
def _(s, d):
    return geo.box(f.geo(s, d), 20.0, 10.0, 3000, 2000, "km").select("member")


@query("geo_by_member", f", a AS (SELECT * FROM geo WHERE member LIKE 'c1%') SELECT a.member, b.member AS other, round({_dist('a.lat', 'b.lat', 'a.lon', 'b.lon')} / 1000, 4) AS dist FROM a JOIN geo b ON abs(a.lat - b.lat) < 3 AND {_dist('a.lat', 'b.lat', 'a.lon', 'b.lon')} / 1000 <= 300", "geo")
def _(s, d):
    x = f.geo(s, d)
    return geo.radius_by_member(x, x.where("member like 'c1%'"), 300, "km").select("member", "other", _r("dist", 4))


@query("geo_dist", f"SELECT 'places' AS key, round({_dist('a.lat', 'b.lat', 'a.lon', 'b.lon')} / 1000, 4) AS dist FROM geo a, geo b WHERE a.member = 'c1' AND b.member = 'c2'", "geo")
def _(s, d):
    return geo.dist(f.geo(s, d), "c1", "c2", "km")


# Vectors.

_SIM = {"cosine": "list_cosine_similarity(v, q)", "ip": "list_inner_product(v, q)", "l2": "1 / (1 + list_distance(v, q))"}
for _metric, _sql in _SIM.items():

    @query(f"vec_knn_{_metric}", f", q AS (SELECT list_transform(range(1, 65), lambda i: (i % 7 - 3)::DOUBLE / 10.0::DOUBLE) AS q) SELECT id, round({_sql}, 6) AS score FROM vs, q ORDER BY {_sql} DESC, id LIMIT 10", "vs")
    def _(s, d, metric=_metric):
        return vectors.search(f.vs(s, d), [(i % 7 - 3) / 10 for i in range(1, 65)], 10, metric).select("id", _r("score"))


@query("vec_knn_filtered", ", q AS (SELECT v AS q FROM vs WHERE id = 0) SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM vs, q WHERE key IN ('1', '2') ORDER BY list_cosine_similarity(v, q) DESC, id LIMIT 10", "vs")
def _(s, d):
    x = f.vs(s, d)
    q = x.where("id = 0").select("v").first()[0]
    return vectors.search(x, q, 10, where=C("key").isin("1", "2")).select("id", _r("score"))


@query("vec_by_element", ", a AS (SELECT a.id AS query, b.id, list_cosine_similarity(a.v, b.v) AS score FROM vs a JOIN vs b ON a.key = b.key AND a.id <> b.id) SELECT query, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM a) WHERE r <= 5", "vs")
def _(s, d):
    x = f.vs(s, d)
    return vectors.by_element(x, x.select("id"), 5).select("query", "id", _r("score"))


@query("vec_range", "SELECT name FROM (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY name) AS r FROM vs WHERE name >= 'v1' AND name < 'v4') WHERE r <= 3", "vs")
def _(s, d):
    return vectors.vrange(f.vs(s, d), "[v1", "(v4", 3).select("name")


@query("vec_info", "SELECT key, count(*) AS n, 64 AS dim FROM vs GROUP BY key", "vs")
def _(s, d):
    return vectors.vinfo(f.vs(s, d))


# Full text.


_indexes: dict[tuple[str, str], str] = {}


def _index(s, d):
    """The index of the documents, built and saved once for an application, as a user would keep it."""
    weights, own = {"text": 1.0, "title": 5.0}, (s.sparkContext.applicationId, d)
    if own not in _indexes:
        path = f"{shared.shared_dir(s)}/index-{uuid.uuid4().hex}"
        search.Index.create(f.table(s, d, "documents").withColumn("title", F.substring("text", 1, 40)), "doc_id", weights).save(path)
        _indexes[own] = path
    return search.Index.load(s, _indexes[own], weights)


_STOP = ", ".join(f"'{w}'" for w in search.STOPWORDS)
_TOKENS = f"""
, docs AS (SELECT doc_id::VARCHAR AS id, text, substr(text, 1, 40) AS title, lang, source, n_chars FROM documents),
tok AS (SELECT id, f AS field, list_filter(regexp_split_to_array(lower(x), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) > 1 AND t NOT IN ({_STOP})) AS ts FROM (SELECT id, 'text' AS f, text AS x FROM docs UNION ALL SELECT id, 'title', title FROM docs)),
pst AS (SELECT id, field, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM tok),
post AS (SELECT field, term, id, count(*) AS tf FROM pst GROUP BY ALL),
size AS (SELECT id, sum(len(ts)) AS len FROM tok GROUP BY id),
st2 AS (SELECT count(*) AS n, avg(len) AS avg FROM size),
df AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
bm AS (SELECT id, term, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg)) * CASE field WHEN 'title' THEN 5 ELSE 1 END) AS score FROM post JOIN df USING (field, term) JOIN size USING (id), st2 GROUP BY ALL)
"""


def _page(body: str) -> str:
    return _TOKENS + f", r AS ({body}) SELECT id, round(score, 6) AS score FROM r ORDER BY r.score DESC, id LIMIT 10"


def _top(found):
    return found.select("id", _r("score"))


@query("ft_postings", _TOKENS + "SELECT field, term, id, tf FROM post", "kv")
def _(s, d):
    return search.Index.create(f.table(s, d, "documents").withColumn("title", F.substring("text", 1, 40)), "doc_id", {"text": 1.0, "title": 5.0}).postings.select("field", "term", "id", "tf")


@query("ft_term", _page("SELECT id, score FROM bm WHERE term = 'ntnt'"), "kv")
def _(s, d):
    return _top(_index(s, d).search("ntnt"))


@query("ft_and", _page("SELECT id, sum(score) AS score FROM bm WHERE term IN ('thth', 'er') GROUP BY id HAVING count(*) = 2"), "kv")
def _(s, d):
    return _top(_index(s, d).search("thth er"))


@query("ft_or_not", _page("SELECT id, sum(score) AS score FROM bm WHERE term IN ('thth', 'erer') AND id NOT IN (SELECT id FROM bm WHERE term = 'ou') GROUP BY id"), "kv")
def _(s, d):
    i = _index(s, d)
    return _top(i.search(i.or_(i.term("thth"), i.term("erer")).join(i.term("ou"), "id", "left_anti")))


@query("ft_not", _TOKENS + "SELECT id, 1.0::DOUBLE AS score FROM docs WHERE id NOT IN (SELECT id FROM post WHERE term = 'ou')", "kv")
def _(s, d):
    i = _index(s, d)
    return i.not_(i.term("ou"))


@query("ft_prefix", _page("SELECT id, count(*)::DOUBLE AS score FROM post WHERE term LIKE 'thth%' GROUP BY id"), "kv")
def _(s, d):
    return _top(_index(s, d).search("thth*"))


@query("ft_phrase", _page("SELECT id, score FROM bm WHERE term = 'er' AND id IN (SELECT a.id FROM pst a JOIN pst b ON a.id = b.id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'er' AND b.term = 'ed')"), "kv")
def _(s, d):
    i = _index(s, d)
    return _top(i.search(i.phrase(["er", "ed"])))


@query("ft_numeric_tag", "SELECT doc_id::VARCHAR AS id, 2.0::DOUBLE AS score FROM documents WHERE n_chars BETWEEN 500 AND 1500 AND lang IN ('en', 'fr')")
def _(s, d):
    i = _index(s, d)
    return i.and_(i.numeric("n_chars", 500, 1500), i.tag("lang", ["en", "FR"]))


@query("ft_sort", _TOKENS + "SELECT id, round(score, 6) AS score FROM bm JOIN docs USING (id) WHERE term = 'thth' ORDER BY n_chars DESC, id LIMIT 5 OFFSET 2", "kv")
def _(s, d):
    return _index(s, d).search("thth", 2, 5, sort_by="n_chars", desc=True).select("id", _r("score"))


_VEC = "v2 AS (SELECT vec_id::VARCHAR AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings)"
_FUSE = _TOKENS + ", " + _VEC + ", a AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm WHERE term = 'thth' ORDER BY score DESC, id LIMIT 20), b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v2 ORDER BY score DESC, id LIMIT 20) "


def _branches(s, d):
    x = f.vs(s, d)
    q = x.where("id = 0").select("v").first()[0]
    return _index(s, d).term("thth"), vectors.search(x, q, 20).select(C("id").cast("string").alias("id"), "score")


@query("ft_hybrid_rrf", _FUSE + "SELECT id, round(sum(1 / (60.0 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id", "kv")
def _(s, d):
    return search.rrf(list(_branches(s, d))).select("id", _r("score", 9))


@query("ft_hybrid_linear", _FUSE + "SELECT id, round(sum(x), 6) AS score FROM (SELECT id, 0.7 * score / max(score) OVER () AS x FROM a UNION ALL SELECT id, 0.3 * score / max(score) OVER () FROM b) GROUP BY id", "kv")
def _(s, d):
    text, vec = _branches(s, d)
    return search.linear([(text, 0.7), (vec, 0.3)]).select("id", _r("score"))


# Graph.


@query("g_neighbours_out", "SELECT src AS id, dst AS neighbour FROM edges", "edges")
def _(s, d):
    return graph.neighbours(f.graph(s, d)[1], "out")


@query("g_neighbours_both", "SELECT src AS id, dst AS neighbour FROM edges WHERE rel = 'NEXT' UNION ALL SELECT dst, src FROM edges WHERE rel = 'NEXT'", "edges")
def _(s, d):
    return graph.neighbours(f.graph(s, d)[1], "both", "NEXT")


@query("g_match", "SELECT id, name FROM nodes WHERE label = 'nation' AND name = 'NATION_3'", "nodes")
def _(s, d):
    return graph.match(f.graph(s, d)[0], "nation", {"name": "NATION_3"}).select("id", "name")


@query("g_stats", "SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'relationship', rel, count(*) FROM edges GROUP BY ALL", "nodes edges")
def _(s, d):
    return graph.stats(*f.graph(s, d))


@query("g_shortest_path", "", "edges")
def _(s, d):
    nodes, edges = f.graph(s, d)
    found = graph.shortest_paths(edges, graph.by_label(nodes, "nation"), graph.by_label(nodes, "region"))
    return found.select("start", "id", "hops", F.array_join("path", ">").alias("path"))


QUERIES["g_shortest_path"] = (QUERIES["g_shortest_path"][0], "WITH RECURSIVE edges AS (" + f.SQL["edges"] + "), p(start, id, hops, path) AS (SELECT 'nation:' || n_nationkey, 'nation:' || n_nationkey, 0, ['nation:' || n_nationkey] FROM nation UNION ALL SELECT start, dst, hops + 1, list_append(path, dst) FROM p JOIN edges ON id = src WHERE NOT list_contains(path, dst) AND hops < 26), h AS (SELECT *, row_number() OVER (PARTITION BY start, id ORDER BY hops, path) AS r FROM p) SELECT start, id, hops, array_to_string(path, '>') AS path FROM h WHERE r = 1 AND id LIKE 'region%'")


@query("g_all_paths", "", "edges")
def _(s, d):
    return graph.all_paths(f.graph(s, d)[1], "nation:0", "region:1", 6).select(F.array_join("path", ">").alias("path"))


QUERIES["g_all_paths"] = (QUERIES["g_all_paths"][0], "WITH RECURSIVE edges AS (" + f.SQL["edges"] + "), p(id, path) AS (SELECT 'nation:0', ['nation:0'] UNION ALL SELECT dst, list_append(path, dst) FROM p JOIN edges ON id = src WHERE id <> 'region:1' AND NOT list_contains(path, dst) AND len(path) < 6) SELECT array_to_string(path, '>') AS path FROM p WHERE id = 'region:1'")


@query("g_delete", "SELECT src, dst, rel FROM edges WHERE src <> 'nation:3' AND dst <> 'nation:3'", "edges")
def _(s, d):
    return graph.delete_nodes(*f.graph(s, d), C("id") == "nation:3")[1]


# Channels, functions, snapshots and streams.

SUBS = [("s1", "user", True), ("s2", "a*", False), ("s3", "*", False), ("s1", "[us]*", False)]


@query("ps_deliver", "SELECT subscriber, pattern, count(*) AS n FROM messages JOIN (VALUES ('s1', 'user', '^user$'), ('s2', 'a*', '^a'), ('s3', '*', ''), ('s1', '[us]*', '^[us]')) v(subscriber, pattern, r) ON regexp_matches(channel, r) GROUP BY ALL", "messages")
def _(s, d):
    return pubsub.deliver(f.messages(s, d), SUBS).groupBy("subscriber", "pattern").agg(F.count("*").alias("n"))


@query("ps_receivers", "SELECT channel, (count(*) * CASE channel WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 2 END)::BIGINT AS n FROM messages GROUP BY channel", "messages")
def _(s, d):
    return pubsub.receivers(f.messages(s, d), SUBS)


@query("fn_call", "SELECT key, upper(value) || '!' AS value FROM kv", "kv")
def _(s, d):
    fns = scripts.Functions()
    sha = fns.load("shout", lambda c: F.concat(F.upper(c), F.lit("!")))
    return f.kv(s, d).select("key", fns.call(sha, C("value")).alias("value"))


@query("io_documents", "SELECT 'list' AS type, count(*) AS n FROM lst UNION ALL SELECT 'zset', count(*) FROM zs UNION ALL SELECT 'hash', count(*) FROM hsh UNION ALL SELECT 'string', count(*) FROM kv UNION ALL SELECT 'set', count(*) FROM st", "lst zs hsh kv st")
def _(s, d):
    docs = shared.cut(snapshots.as_documents({"list": f.lst(s, d), "zset": f.zs(s, d), "hash": f.hsh(s, d), "string": f.kv(s, d).select("key", "value"), "set": f.st(s, d)}))
    out = None
    for kind, df in snapshots.from_documents(docs).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("type"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _streamed(s, d, make, mode="append"):
    source = f"{shared.shared_dir(s)}/stream-{uuid.uuid4().hex}"
    events = f.table(s, d, "events").withColumn("ts", C("ts").cast("timestamp"))
    events.write.parquet(f"{source}/in")
    out = make(windows.read(s, f"{source}/in", events.schema))
    q = windows.to_parquet(out, f"{source}/out", f"{source}/state", mode)
    q.awaitTermination()
    return s.read.schema(out.schema).parquet(f"{source}/out")


@query("ss_tumbling", f", w AS (SELECT event_type, {MS} // 21600000 * 21600000 AS start, count(*) AS n, round(max(value), 6) AS high FROM events GROUP BY ALL) SELECT * FROM w WHERE start + 21600000 <= (SELECT max({MS}) FROM events) AND start + 21600000 <= (SELECT max({MS}) FROM events)", "kv")
def _(s, d):
    got = _streamed(s, d, lambda e: windows.tumbling(e, ["event_type"], "6 hours"))
    return got.select("event_type", F.unix_millis("start").alias("start"), "n", _r("high"))


@query("ss_first_only", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def _(s, d):
    return _streamed(s, d, lambda e: windows.first_only(e, ["user_id", "event_type"], "40 days")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("ss_deliver", "SELECT event_type AS key, 'c' || i AS consumer, ((count(*) - i + 2) // 3)::BIGINT AS n FROM events, range(3) r(i) GROUP BY event_type, i")
def _(s, d):
    got = _streamed(s, d, lambda e: windows.deliver(e.select(C("event_type").alias("key"), C("event_id").cast("string").alias("entry")), 3))
    return got.groupBy("key", "consumer").agg(F.count("*").alias("n"))
