"""Boilerplate lines by site-relative frequency.

Lines are counted once a page and host, as 64-bit hashes with a combine on the
map side; a line goes if the share of its host's pages that contain it exceeds
``percent`` and it is on at least ``least`` pages.  At most
``lines a page * 100 / percent`` lines of a host can exceed the share, so the
lines that go fit one array a host; pages are joined with their host's array,
which is broadcast only where its stored size is under Spark's own threshold;
pages are not shuffled then.  Beyond it they are, by host, and a hot host's are
left to Spark's splitting of skewed joins.

Only built-in DataFrame functions are used.

Defined cases: a line is compared without blanks at its ends, and a blank line
is never counted or dropped; a null text stays null and counts as a page
without lines; a null host is a host; a very long text is split whole; a line just
at the share stays; repeated rows are pages of their own; other columns are kept
by ``drop_boilerplate``, whatever their names, and ignored by ``clean_pages``; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_EDGES = " \t\r"
#: Markup whose content is no text, tags that end a line, and other tags (fixed patterns).
NO_TEXT = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
LINE_TAGS = r"(?i)<(/?(p|div|li|ul|ol|nav|article|section|header|footer|aside|main|h[1-6]|title|table|tr|td|th|body|head|html)|br)([ \t\r\n/][^>]*)?>"
OTHER_TAGS = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)"


def html_lines(html: Column) -> Column:
    """Text of a page, a line for each block of its markup; entities stay as written."""
    t = F.regexp_replace(html, NO_TEXT, "")
    return F.regexp_replace(F.regexp_replace(t, LINE_TAGS, "\n"), OTHER_TAGS, "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_EDGES)))


def boilerplate(df: DataFrame, text: str, host: str, percent: int, least: int) -> DataFrame:
    """(host, lines array<bigint>): hashes of the lines that go, by host."""
    one = df.select(F.col(host).alias("host"), F.col(text).alias("x"))
    totals = one.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    blank = F.lit("")
    seen = F.array_distinct(F.transform(F.filter(_lines(F.col("x")), lambda v: F.btrim(v, F.lit(_EDGES)) != blank), _hash))
    counts = one.select("host", F.explode(seen).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    t = totals.withColumnRenamed("host", "h")
    over = counts.join(t, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") * 100 > F.col("pages") * percent)
    return C.staged(over.groupBy("host").agg(F.collect_list("line").alias("lines")))


def drop_boilerplate(df: DataFrame, text: str, host: str, percent: int = 10, least: int = 5, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``df`` with ``text`` rid of its host's boilerplate; optional columns count lines."""
    plain = {c: f"c{i}" for i, c in enumerate(df.columns)}  # no name of the input can clash
    d, text, host = df.toDF(*plain.values()), plain[text], plain[host]
    go = boilerplate(d, text, host, percent, least).select(F.col("host").alias("_host"), F.col("lines").alias("_go"))
    joined = d.join(go, d[host].eqNullSafe(go["_host"]), "left")
    stays = lambda v: (F.btrim(v, F.lit(_EDGES)) == "") | ~F.array_contains(F.col("_go"), _hash(v))
    kept = F.when(F.col("_go").isNull(), F.col(text)).otherwise(F.array_join(F.filter(_lines(F.col(text)), stays), "\n"))
    out = joined.withColumn("_kept", kept)
    cols = [(F.col("_kept") if p == text else F.col(p)).alias(c) for c, p in plain.items()]
    if n_lines:
        full = lambda t: F.size(F.filter(_lines(t), lambda v: F.btrim(v, F.lit(_EDGES)) != ""))
        some = lambda t: F.when(t.isNull(), 0).otherwise(full(t)).cast("long")
        cols += [some(F.col(text)).alias(n_lines), (some(F.col(text)) - some(F.col("_kept"))).alias(n_dropped)]
    return out.select(*cols)


def clean_pages(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", percent: int = 5, least: int = 3) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) for every page."""
    pages = df.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), html_lines(F.col(html)).alias("text"))
    return drop_boilerplate(C.staged(pages), "text", "host", percent, least, "n_lines", "n_dropped").select("page_id", "host", "n_lines", "n_dropped", "text")


def clean_pages_sql(percent: int = 5, least: int = 3) -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: s.replace("'", "''")
    edge = "' ' || chr(9) || chr(13)"
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(url, '{q(HOST)}', 1)) AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '{q(NO_TEXT)}', '', 'g'), '{q(LINE_TAGS)}', chr(10), 'g'), '{q(OTHER_TAGS)}', '', 'g') AS text
  FROM pages),
l AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),
k AS (SELECT r, host, line, i, trim(line, {edge}) AS key FROM l),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
c AS (SELECT host, key, count(DISTINCT r) AS n FROM k WHERE key <> '' GROUP BY host, key),
go AS (SELECT c.host, c.key FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE n >= {least} AND n * 100 > pages * {percent}),
m AS (SELECT k.*, go.key IS NOT NULL AS gone FROM k LEFT JOIN go ON k.host IS NOT DISTINCT FROM go.host AND k.key = go.key),
a AS (SELECT r, count(*) FILTER (WHERE key <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY r)
SELECT p.page_id, p.host, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_dropped, 0) AS n_dropped,
       CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(a.text, p.text) END AS text
FROM p LEFT JOIN a ON p.r = a.r"""
