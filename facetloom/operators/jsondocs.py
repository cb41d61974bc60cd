"""JSON documents: facet js (key, doc). Paths are '$' and dot-separated names, with [n] or .[n] for elements and [*] or * for all.

Reads go through get_json_object in the JVM. Writes rebuild a document in an Arrow batch, as Spark has no function that sets a path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.shipping import ship


def parts(path: str) -> list[str | int]:
    """Names, element numbers and '*' of a path."""
    out: list[str | int] = []
    for name, index in re.findall(r"([^.\[\]]+)|\[([^\]]*)\]", path.removeprefix("$")):
        if name:
            out.append(name)
        else:
            out.append("*" if index == "*" else int(index))
    return out


def spark_path(path: str) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) or p == "*" else f".{p}" for p in parts(path))


def get(path: str, doc: Column | str = "doc") -> Column:
    """The value at a path as text: strings bare, all else as JSON."""
    return F.get_json_object(doc, spark_path(path))


def mget(js: DataFrame, keys: list[str], path: str) -> DataFrame:
    return js.where(F.col("key").isin(*keys)).select("key", get(path).alias("value"))


def kind(path: str, doc: Column | str = "doc") -> Column:
    """null, boolean, integer, number, string, array or object; null (SQL) where nothing is there."""
    v = F.try_variant_get(F.try_parse_json(doc), spark_path(path).replace("$.*", "$"), "variant")
    t = F.schema_of_variant(v)
    return F.when(v.isNull(), F.lit(None)).when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(t == "STRING", "string").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t == "BIGINT", "integer").otherwise("number")


def arrlen(path: str, doc: Column | str = "doc") -> Column:
    return F.json_array_length(get(path, doc)).cast("long")


def objkeys(path: str, doc: Column | str = "doc") -> Column:
    return F.json_object_keys(get(path, doc))


def objlen(path: str, doc: Column | str = "doc") -> Column:
    return F.size(objkeys(path, doc)).cast("long")


def strlen(path: str, doc: Column | str = "doc") -> Column:
    return F.octet_length(get(path, doc))


def arrindex(path: str, value: str, start: int = 0, doc: Column | str = "doc") -> Column:
    """First place from start on of an element that is equal as text; -1 where none is, null where there is no array."""
    elements = F.from_json(get(path, doc), "array<string>")
    tail = F.slice(elements, start + 1, F.greatest(F.size(elements), F.lit(1)))
    at = F.array_position(tail, value)
    return F.when(elements.isNull(), F.lit(None)).when(at == 0, F.lit(-1)).otherwise(at + start - 1).cast("long")


def memory(doc: Column | str = "doc") -> Column:
    return F.octet_length(doc)


Change = Callable[[object], object]
class GONE:
    """Stands for no value; a class, so that workers have the same one."""


def _places(root, steps: list, create: bool):
    """(container, name or number) of every value that a path meets; create: the last name need not be there."""
    found = [(None, None, root)]
    for i, step in enumerate(steps):
        nxt, last = [], i == len(steps) - 1
        for _, _, v in found:
            if step == "*":
                nxt += [(v, k, x) for k, x in (v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ())]
            elif isinstance(step, int):
                if isinstance(v, list) and -len(v) <= step < len(v):
                    nxt.append((v, step % len(v), v[step]))
            elif isinstance(v, dict) and (step in v or (create and last)):
                nxt.append((v, step, v.get(step, GONE)))
        found = nxt
    return found


def _changed(text: str | None, steps: list, change: Change, create: bool) -> str | None:
    if text is None:
        return None
    try:
        root = json.loads(text)
    except ValueError:
        return text
    places = _places(root, steps, create)
    for box, at, old in reversed(places):
        new = change(old)
        if box is None:
            root = new
        elif new is GONE:
            if old is not GONE:
                del box[at]
        else:
            box[at] = new
    return None if root is GONE else json.dumps(root, separators=(",", ":"), ensure_ascii=False)


def write(js: DataFrame, path: str, change: Change, create: bool = False) -> DataFrame:
    """js with doc rebuilt: change maps the value at each place to a new one or GONE. Documents that lose their root go; what is no JSON stays as it is."""
    ship(js.sparkSession)
    steps = parts(path)

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        return pd.Series([_changed(d, steps, change, create) for d in docs], dtype=object)

    return js.withColumn("doc", run("doc")).where(F.col("doc").isNotNull())


def set_(js: DataFrame, path: str, value: object, when: str = "always") -> DataFrame:
    """when: nx only where the path is missing, xx only where it is there."""
    def change(old):
        if (when == "nx" and old is not GONE) or (when == "xx" and old is GONE):
            return old
        return value

    return write(js, path, change, create=True)


def delete(js: DataFrame, path: str = "$") -> DataFrame:
    return write(js, path, lambda old: GONE)


def _number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def numincrby(js: DataFrame, path: str, by: float) -> DataFrame:
    """Whole numbers stay whole, whatever their length, where both are."""
    return write(js, path, lambda old: old + by if _number(old) else old)


def nummultby(js: DataFrame, path: str, by: float) -> DataFrame:
    return write(js, path, lambda old: old * by if _number(old) else old)


def strappend(js: DataFrame, path: str, suffix: str) -> DataFrame:
    return write(js, path, lambda old: old + suffix if isinstance(old, str) else old)


def toggle(js: DataFrame, path: str) -> DataFrame:
    return write(js, path, lambda old: (not old) if isinstance(old, bool) else old)


def clear(js: DataFrame, path: str = "$") -> DataFrame:
    """Containers become empty and numbers 0."""
    return write(js, path, lambda old: {} if isinstance(old, dict) else [] if isinstance(old, list) else 0 if _number(old) else old)


def arrappend(js: DataFrame, path: str, values: list) -> DataFrame:
    return write(js, path, lambda old: old + values if isinstance(old, list) else old)


def arrinsert(js: DataFrame, path: str, index: int, values: list) -> DataFrame:
    def change(old):
        if not isinstance(old, list):
            return old
        i = index if index >= 0 else max(0, len(old) + index)
        return old[:i] + values + old[i:]

    return write(js, path, change)


def arrpop(js: DataFrame, path: str, index: int = -1) -> DataFrame:
    """Without the element at an index, clamped to the ends."""
    def change(old):
        if not isinstance(old, list) or not old:
            return old
        i = min(max(index if index >= 0 else len(old) + index, 0), len(old) - 1)
        return old[:i] + old[i + 1 :]

    return write(js, path, change)


def arrpopped(path: str, index: int = -1, doc: Column | str = "doc") -> Column:
    """The element that arrpop() takes, as text; null where there is none."""
    elements = F.from_json(get(path, doc), "array<string>")
    n = F.size(elements)
    at = F.least(F.greatest(F.lit(index) if index >= 0 else n + index, F.lit(0)), n - 1)
    return F.when(n > 0, F.get(elements, at))


def resp(path: str, doc: Column | str = "doc") -> Column:
    """The value at a path as a flat array: '[' and '{' open containers, whose elements, or names and values, follow; null where nothing is there."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([_flat(v) for v in values], dtype=object)

    return run(get(path, doc))


def _flat(text: str | None) -> list[str | None] | None:
    if text is None:
        return None
    out: list[str | None] = []

    def walk(v) -> None:
        if isinstance(v, dict):
            out.append("{")
            for k, x in v.items():
                out.append(k)
                walk(x)
        elif isinstance(v, list):
            out.append("[")
            for x in v:
                walk(x)
        else:
            out.append(v if v is None or isinstance(v, str) else json.dumps(v))

    try:
        walk(json.loads(text))
    except ValueError:
        return [text]
    return out


def mset(js: DataFrame, sets: list[tuple[str, str, object]]) -> DataFrame:
    """Values (key, path, value) set together, in order; a root path makes a document that is not there."""
    roots = [(k, json.dumps(v, separators=(",", ":"), ensure_ascii=False)) for k, p, v in sets if not parts(p)]
    if roots:
        new = js.sparkSession.createDataFrame([(k, d) for k, d in dict(roots).items()], "key string, doc string")
        js = js.unionByName(new.join(js.select("key"), "key", "left_anti"))
    for key, path, value in sets:
        mine = set_(js.where(F.col("key") == key), path, value)
        js = js.where(F.col("key") != key).unionByName(mine)
    return js


def arrtrim(js: DataFrame, path: str, start: int, stop: int) -> DataFrame:
    def change(old):
        if not isinstance(old, list):
            return old
        a, b = (x if x >= 0 else max(0, len(old) + x) for x in (start, stop))
        return old[a : b + 1] if a <= b else []

    return write(js, path, change)


def _patched(old, patch):
    if not isinstance(patch, dict):
        return patch
    out = dict(old) if isinstance(old, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patched(out.get(k), v)
    return out


def merge(js: DataFrame, path: str, patch: object) -> DataFrame:
    """RFC 7396: null deletes, objects merge, all else replaces."""
    return write(js, path, lambda old: _patched(None if old is GONE else old, patch))
