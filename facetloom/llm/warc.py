"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives two records that refer to it by its identifier: a `metadata` record whose fields carry the source's
HTTP headers, the payload's digest, the title and the links, and a `conversion` record with the page's text. Pages are read by patterns
that look at a character a bounded number of times, whatever stands in the page. The digests are SHA-256, with the algorithm's name as a label; record
identifiers follow from the response's, and the response's from its address and content, so that a second run makes the same records.

What counts: comments, scripts and styles have no text, title or link, and one that is not closed goes on to the end; `<` opens a tag if a letter, `/` and a letter, `!` or `?`
follows and a `>` outside of quotes closes it, and is text otherwise; the first href of an <a> is a link, quoted either way or not at all; character references
are those that end with `;`, by the names of HTML 5 or by number; a no-break space is a space.

Defined results: a null payload counts as empty, and its records have an empty title, no link and no text; a null address is an empty field; line ends in an
address or identifier are written as %0D and %0A, so that no field can open another; repeated rows give repeated records; pages of any length take time in proportion; an
empty table gives no rows. Input columns other than the ones named are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import entities, unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm.common import small_batches, table
from facetloom.shipping import ship

DATE = "2024-01-01T00:00:00Z"
# Patterns for linear engines; END is the end of the text. Python's own are made from them by _compiled().
END, ATTRIBUTES = r"\z", r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"
COMMENT = rf"(?s)<!--.*?(?:-->|{END})"
SCRIPT, STYLE = (rf"(?is)<{x}(?:[\s/]{ATTRIBUTES})?>.*?(?:</{x}[\s/]*>|{END})" for x in ("script", "style"))
BLOCK = rf"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[\s/]{ATTRIBUTES})?>"
TAG = rf"</?[A-Za-z]{ATTRIBUTES}>|<[!?]{ATTRIBUTES}>"
TITLE = rf"(?is)<title(?:[\s/]{ATTRIBUTES})?>(.*?)(?:</title|{END})"
ANCHOR = rf"(?i)<a[\s/]({ATTRIBUTES})>"
ATTRIBUTE = r"[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?"
VALUE = r"(?is)^href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(.+))$"
REFERENCE = r"#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31}"
BLANK = r"[ \t\r\n\f]+"


def _compiled(pattern: str) -> re.Pattern:
    """With possessive repetition, which finds the same here and never goes back."""
    return re.compile(pattern.replace(END, r"\Z").replace(ATTRIBUTES, r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"), re.ASCII)


_comment, _script, _style, _block, _tag, _title, _anchor, _attribute, _value = map(_compiled, (COMMENT, SCRIPT, STYLE, BLOCK, TAG, TITLE, ANCHOR, ATTRIBUTE, VALUE))
_reference, _blank, _spaces, _lines = re.compile(f"&({REFERENCE});"), re.compile(BLANK), re.compile(" +"), re.compile(r" ?\n[ \n]*")


def _char(match: re.Match) -> str:
    name = match[1]
    return unescape(match[0]) if name[0] == "#" else entities.html5.get(name + ";", match[0])


def _decoded(text: str) -> str:
    return _reference.sub(_char, text) if "&" in text else text


def _field(text: str) -> str:
    return _blank.sub(" ", _decoded(text)).strip(" ")


def _visible(page: str) -> str:
    """Without comments, scripts and styles."""
    return _style.sub("", _script.sub("", _comment.sub("", page)))


def _text(visible: str) -> str:
    t = _tag.sub("", _block.sub("\n", _blank.sub(" ", visible)))
    return _lines.sub("\n", _spaces.sub(" ", _decoded(t).replace("\u00a0", " "))).strip(" \n")


def _links(visible: str) -> list[str]:
    out = []
    for attributes in _anchor.findall(visible):
        value = next((v for x in _attribute.findall(attributes) if (v := _value.match(x))), None)
        if value is not None:
            out.append(_field(value[1] or value[2] or value[3] or ""))
    return out


def parse(page: str | None) -> tuple[str, list[str], str]:
    """Title, links and text of a page: block tags end a line, other white space shrinks to one space."""
    visible = _visible(page or "")
    title = _title.search(visible)
    return _field(title[1]) if title else "", _links(visible), _text(visible)


def _parsed(payload: str) -> Column:
    @F.pandas_udf("title string, links array<string>, text string")
    def parsed(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(p) for p in pages], columns=["title", "links", "text"])

    return parsed(F.col(payload))


def _urn(seed: Column) -> Column:
    m = F.md5(seed.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def _one_line(c: str | Column) -> Column:
    """Empty for null; line ends as an address writes them."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def responses(pages: DataFrame) -> DataFrame:
    """Response records (key, record_id, target_uri, date, headers, payload) of a table of pages."""
    html = F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    seed = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.md5(html.cast("binary")))
    return pages.select(F.col("page_id").alias("key"), _urn(seed).alias("record_id"), _one_line("url").alias("target_uri"), F.lit(DATE).alias("date"), headers.alias("headers"), html.alias("payload"))


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response: key, record_type, record_id, refers_to, target_uri, date, content_type, content_length, block_digest, payload_digest, source_headers, block."""
    small_batches(records.sparkSession)
    r = records.select("key", _one_line("record_id").alias("record_id"), _one_line("target_uri").alias("target_uri"), _one_line("date").alias("date"), F.coalesce("headers", F.lit("")).alias("headers"), F.coalesce("payload", F.lit("")).alias("payload"))
    r = r.withColumn("payload_digest", _digest(F.col("payload"))).withColumn("page", _parsed("payload")).drop("payload")
    links = F.transform("page.links", lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n")))
    sources = F.regexp_replace(F.regexp_replace("headers", r"\r\n", " | "), r"[\r\n]+", " ")
    about = F.concat(F.lit("via: "), F.col("target_uri"), F.lit("\r\npayload-digest: "), F.col("payload_digest"), F.lit("\r\ntitle: "), F.col("page.title"), F.lit("\r\n"), F.array_join(links, ""), F.lit("source-headers: "), sources, F.lit("\r\n"))
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("page.text").alias("block")),
    )
    r = r.select("key", "record_id", "target_uri", "date", "headers", "payload_digest", F.explode(both).alias("r"))
    return r.select(
        "key", "r.record_type", _urn(F.concat(F.col("record_id"), F.col("r.record_type"))).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"), _digest(F.col("r.block")).alias("block_digest"), "payload_digest", F.col("headers").alias("source_headers"), "r.block",
    )


def as_text(records: DataFrame) -> DataFrame:
    """A column `value`: header and block of each derived record, without the two line ends that close it."""
    fields = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"), F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("Content-Type: "), "content_type"), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    ]
    return records.select(F.concat(F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n"), F.col("block")).alias("value"))


def write(records: DataFrame, path: str) -> None:
    """WARC files of derived records, one for each partition, by Spark's own writer, in any store that Spark can write."""
    as_text(records).write.option("lineSep", "\r\n\r\n").text(path)


def _unzipped(raw: bytes) -> bytes:
    """raw itself, or what its gzip members hold one after another; a damaged member ends it."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(raw) + member.flush())
        except zlib.error:
            break
        raw = member.unused_data
    return b"".join(out) if out else raw


def records_of(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record. One without a length in digits goes on to the next line that opens a record, or to the end; a length beyond the end is cut."""
    opening = re.compile(rb"(?:\A|\r\n\r\n)(?=WARC/[0-9])")
    at = 0
    while (end := raw.find(b"\r\n\r\n", at)) >= 0:
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = headers.get("content-length", "")
        if size.isascii() and size.isdigit():
            stop = end + 4 + int(size)
        else:
            follows = opening.search(raw, end + 2)
            stop = follows.start() if follows else len(raw)
            stop = max(stop, end + 4)
        yield at, headers, raw[end + 4 : stop]
        at = stop
        while raw[at : at + 2] == b"\r\n":
            at += 2


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzipped: file, offset (in the plain bytes), headers (a map with lower-case names) and block. A file is read whole by one task, as the format cannot be split: files have a gigabyte at most, by custom."""
    ship(spark)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                out = []
                for record in records_of(_unzipped(raw)):
                    out.append((name, *record))
                    if len(out) == 256:
                        yield pd.DataFrame(out, columns=["file", "offset", "headers", "block"])
                        out = []
                yield pd.DataFrame(out, columns=["file", "offset", "headers", "block"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(split, "file string, offset long, headers map<string,string>, block binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_char() -> str:
    """What the reference s begins with (without its &) stands for, and what follows it."""
    special = {i: unescape(f"&#{i};") for i in range(160) if unescape(f"&#{i};") != chr(i)}
    name = f"regexp_extract(s, '^({REFERENCE});', 1)"
    number = f"CASE WHEN lower({name}[2]) = 'x' THEN ('0x' || {name}[3:])::BIGINT ELSE {name}[2:]::BIGINT END"
    listed = f"[{', '.join(_quoted(c) for c in special.values())}]"
    char = (
        f"CASE WHEN list_contains({list(special)}, {number}) THEN {listed}[list_position({list(special)}, {number})]"
        f" WHEN {number} > 1114111 OR {number} BETWEEN 55296 AND 57343 THEN chr(65533) WHEN {number} BETWEEN 64976 AND 65007 OR {number} & 65534 = 65534 THEN '' ELSE chr(({number})::INT) END"
    )
    return f"CASE WHEN {name} = '' THEN '&' || s WHEN {name}[1] = '#' THEN ({char}) || s[len({name}) + 2:] WHEN m[{name}] IS NOT NULL THEN m[{name}] || s[len({name}) + 2:] ELSE '&' || s END"


def _sql_decoded(x: str) -> str:
    return f"(string_split({x}, '&')[1] || coalesce(array_to_string(list_transform(string_split({x}, '&')[2:], lambda s: {_sql_char()}), ''), ''))"


def _sql_field(x: str) -> str:
    return f"trim(regexp_replace({_sql_decoded(x)}, '{BLANK}', ' ', 'g'), ' ')"


def _sql_urn(x: str) -> str:
    return f"'<urn:uuid:' || regexp_replace(md5({x}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') || '>'"


def _sql_pattern(pattern: str) -> str:
    return _quoted(pattern.replace('\\"', '"'))


def _sql_stripped(x: str, *patterns: str, by: str = "''") -> str:
    for p in patterns:
        x = f"regexp_replace({x}, {_sql_pattern(p)}, {by}, 'g')"
    return x


def _sql_text(x: str) -> str:
    x = _sql_stripped(_sql_stripped(_sql_stripped(x, BLANK, by="' '"), BLOCK, by="chr(10)"), TAG)
    x = f"replace({_sql_decoded(f'({x})')}, chr(160), ' ')"
    return f"trim(regexp_replace(regexp_replace({x}, ' +', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


def _sql_links() -> str:
    own = f"list_filter(regexp_extract_all(a, {_sql_pattern(ATTRIBUTE)}), lambda y: regexp_matches(y, {_sql_pattern(VALUE)}))[1]"
    value = " || ".join(f"regexp_extract(y, {_sql_pattern(VALUE)}, {i})" for i in (1, 2, 3))
    found = f"list_filter(list_transform(regexp_extract_all(seen, {_sql_pattern(ANCHOR)}, 1), lambda a: {own}), lambda y: y IS NOT NULL)"
    return f"list_transform(list_transform({found}, lambda y: {value}), lambda x: 'outlink: ' || {_sql_field('x')} || chr(13) || chr(10))"


OP4_SQL = f"""
WITH e AS (SELECT map({[n[:-1] for n in entities.html5 if n[-1] == ";"]!r}, [{", ".join(_quoted(c) for n, c in entities.html5.items() if n[-1] == ";")}]) AS m),
r AS (SELECT page_id, {_sql_urn("coalesce(cast(page_id AS varchar), '') || '|' || coalesce(url, '') || '|' || md5(coalesce(html, ''))")} AS rid, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS target_uri, coalesce(html, '') AS html FROM pages),
s AS (SELECT *, {_sql_stripped("html", COMMENT, SCRIPT, STYLE)} AS seen, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) AS source_headers, 'sha256:' || sha256(html) AS payload_digest FROM r, e),
b AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, 'via: ' || target_uri || chr(13) || chr(10) || 'payload-digest: ' || payload_digest || chr(13) || chr(10) || 'title: '
    || {_sql_field(f"regexp_extract(seen, {_sql_pattern(TITLE)}, 1)")} || chr(13) || chr(10)
    || coalesce(array_to_string({_sql_links()}, ''), '')
    || 'source-headers: ' || replace(source_headers, chr(13) || chr(10), ' | ') || chr(13) || chr(10) AS block FROM s
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {_sql_text("seen")} FROM s)
SELECT page_id, record_type, {_sql_urn("rid || record_type")} AS record_id, rid AS refers_to, target_uri, '{DATE}' AS date, content_type, strlen(block)::BIGINT AS content_length,
  'sha256:' || sha256(block) AS block_digest, payload_digest, source_headers, block FROM b
"""
