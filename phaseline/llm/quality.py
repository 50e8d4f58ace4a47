"""Quality rules with thresholds that adapt to language and source.

Each text gets exact base counts.  Three ratios of them (characters a word,
symbols a word, share of repeated lines) go into mergeable quantile sketches:
log-linear histograms of whole numbers, 128 buckets to a factor of two, so a
merge is a sum of counts, the same for every order and partitioning.  Sketches
are kept per language and source; where one holds under ``least_rows`` texts
its language's merged sketch is used, then the one of all texts.  Fences lie
``reach`` interquartile ranges and a margin outside the quartiles; the one on word
length, a mean, widens for texts of few words as that mean's error does.
A text is kept if it passes the fixed base rules and lies inside its fences.

Only built-in DataFrame functions are used.

Defined cases: a null or empty text has no words and fails the base rules; a
null language or source is a group of its own; repeated rows count each time;
a value on a fence is inside; a very long text is judged whole; other columns
are ignored by ``rules`` and kept, whatever their names, by ``keep_good``; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: (ratio, smallest margin outside the quartiles, whether low values are rejected too)
RULES = (("word_length_100", 60, True), ("symbols_1000", 100, False), ("dup_lines_1000", 400, False))
#: Quartiles come from texts of some hundred words; a mean over fewer words is noisier, so its fence widens as one over the root of the words.
STEADY_WORDS = 200


def measure(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with a struct column ``name`` of base counts of each whole text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = df.withColumn("_t", t).withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda v: F.translate(v, _BLANKS, "") != ""))
    n = F.size("_w")
    five = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(F.col("_w"), i + k) for k in range(5))))
    d = d.withColumn("_h", F.when(n >= 5, five).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat no window, which counting distinct hashes tells
    placed = F.array_sort(F.transform(F.col("_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size("_h") > F.size(F.array_distinct("_h")), placed))
    s, last = F.col("_s"), F.size("_s") - 1
    same = lambda j: ((j > 0) & (F.get(s, j)["h"] == F.get(s, j - 1)["h"])) | ((j < last) & (F.get(s, j)["h"] == F.get(s, j + 1)["h"]))
    found = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), same), lambda j: F.get(s, j)["i"]))
    d = d.withColumn("_p", F.when(s.isNotNull(), found))
    p = F.col("_p")
    # a window covers five words, or as many as lie before the next repeated one
    covered = F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(5)), F.lit(5))), F.lit(0), lambda a, b: a + b)
    d = d.withColumn(
        name,
        F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.translate("_t", _BLANKS, "")).cast("long").alias("word_chars"),
            (F.length("_t") - F.length(F.translate("_t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("_l").cast("long").alias("n_lines"),
        ),
    )
    return d.drop("_t", "_w", "_l", "_h", "_s", "_p")


def ratios(m: Column) -> dict[str, Column]:
    """Whole-number ratios; null where a text has none."""
    return {
        "word_length_100": F.when(m["n_words"] > 0, F.floor(100 * m["word_chars"] / m["n_words"])),
        "symbols_1000": F.when(m["n_words"] > 0, F.floor(1000 * m["n_symbols"] / m["n_words"])),
        "dup_lines_1000": F.when(m["n_lines"] > 0, F.floor(1000 * m["n_dup_lines"] / m["n_lines"])),
    }


def bucket(v: Column) -> Column:
    """A whole number with its eight leading bits kept."""
    low = F.greatest(F.length(F.bin(v)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(df: DataFrame, lang: str, source: str, m: Column) -> DataFrame:
    """(lang, source, rule, bucket, n): the sketch of every ratio, language and source."""
    each = F.array(*(F.struct(F.lit(k).alias("rule"), bucket(v.cast("long")).alias("bucket")) for k, v in ratios(m).items()))
    rows = df.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(each).alias("r"))
    return rows.where("r.bucket is not null").groupBy("lang", "source", "r.rule", "r.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, rule, rows, q1, q3) of sketches merged to ``by``."""
    merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "rule")
    up = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("rows", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * q, F.col("bucket")))
    return up.groupBy(*by, "rule", "rows").agg(at(1).alias("q1"), at(3).alias("q3"))


def fences(sketch: DataFrame, least_rows: int, reach: int) -> DataFrame:
    """(lang, source, fence map<rule, struct<q1, q3, out>>) for every group that has texts."""
    own, lang, every = quartiles(sketch, ["lang", "source"]), quartiles(sketch, ["lang"]), quartiles(sketch, [])
    lang = lang.select(F.col("lang").alias("_lang"), F.col("rule").alias("_rule"), F.struct("rows", "q1", "q3").alias("_l"))
    every = every.select(F.col("rule").alias("_every_rule"), F.struct("rows", "q1", "q3").alias("_e"))
    d = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rule") == F.col("_rule"))).join(every, F.col("rule") == F.col("_every_rule"))
    pick = F.when(F.col("rows") >= least_rows, F.struct("rows", "q1", "q3")).when(F.col("_l")["rows"] >= least_rows, F.col("_l")).otherwise(F.col("_e"))
    margin = F.element_at(F.create_map(*(F.lit(x) for r in RULES for x in (r[0], r[1]))), F.col("rule"))
    d = d.withColumn("p", pick).withColumn("out", F.lit(reach) * (F.col("p")["q3"] - F.col("p")["q1"]) + margin)
    fence = F.struct(F.col("p")["q1"].alias("q1"), F.col("p")["q3"].alias("q3"), "out")
    return d.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", fence.alias("f")))).alias("fence"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def judge(df: DataFrame, lang: str, source: str, measures: str, least_rows: int = 100, reach: int = 3) -> DataFrame:
    """``df`` with boolean columns ``_failed`` and ``_kept``; it is read twice, so it should be stored."""
    m = F.col(measures)
    f = C.staged(fences(sketches(df, lang, source, m), least_rows, reach)).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "fence")
    d = df.join(f, df[lang].eqNullSafe(f["_lang"]) & df[source].eqNullSafe(f["_source"]), "left")
    ok, wide = F.lit(True), F.greatest(F.lit(1.0), F.sqrt(F.lit(float(STEADY_WORDS)) / F.greatest(m["n_words"], F.lit(1))))
    for name, _, both in RULES:
        v, fence = ratios(m)[name], F.try_element_at(F.col("fence"), F.lit(name))
        inside = v <= fence["q3"] + fence["out"]
        if both:
            inside = (v <= fence["q3"] + fence["out"] * wide) & (v >= fence["q1"] - fence["out"] * wide)
        ok = ok & F.coalesce(inside, F.lit(True))
    failed = base_failed(m)
    return d.select(*df.columns, failed.alias("_failed"), (~failed & ok).alias("_kept"))


def rules(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row."""
    d = df.select(F.col(key).alias("doc_id"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s"))
    d = judge(C.staged(measure(d, "t", "m").drop("t")), "l", "s", "m")
    return d.select("doc_id", *(f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that the rules keep, with all its columns."""
    plain = {c: f"c{i}" for i, c in enumerate(df.columns)}
    d = df.toDF(*plain.values())
    d = judge(C.staged(measure(d, plain[text], "m")), plain[lang], plain[source], "m")
    return d.where("_kept").select(*(F.col(p).alias(c) for c, p in plain.items()))


def rules_sql() -> str:
    """The same query in DuckDB's SQL."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    cases = lambda i: "CASE rule " + " ".join(f"WHEN '{r[0]}' THEN {r[i]}" for r in RULES) + " END"
    pick = lambda q: f"CASE WHEN o.rows >= 100 THEN o.{q} WHEN l.rows >= 100 THEN l.{q} ELSE e.{q} END"

    def quart(by: str) -> str:
        g = f"{by}, " if by else ""
        return f"""SELECT {g}rule, rows, min(bucket) FILTER (WHERE upto * 4 >= rows) AS q1, min(bucket) FILTER (WHERE upto * 4 >= rows * 3) AS q3
  FROM (SELECT {g}rule, bucket, sum(n) OVER (PARTITION BY {g}rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {g}rule) AS rows
        FROM (SELECT {g}rule, bucket, sum(n) AS n FROM k GROUP BY {g}rule, bucket)) GROUP BY {g}rule, rows"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang, source FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: translate(x, {blanks}, '') <> '') AS ls FROM d),
g AS (SELECT r, i, hash(ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM g) WHERE c > 1),
c AS (SELECT r, sum(least(coalesce(nxt - i, 5), 5)) AS rep FROM p GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(t, {blanks}, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '{_SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN c ON w.r = c.r),
v AS (SELECT *, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS a, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words END AS b,
             CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END AS z FROM m),
u AS (SELECT lang, source, 'word_length_100' AS rule, a AS x FROM v UNION ALL SELECT lang, source, 'symbols_1000', b FROM v
      UNION ALL SELECT lang, source, 'dup_lines_1000', z FROM v),
k AS (SELECT lang, source, rule, (x >> s) << s AS bucket, count(*) AS n
      FROM (SELECT *, greatest(length(bin(x)) - 8, 0) AS s FROM u WHERE x IS NOT NULL) GROUP BY ALL),
o AS ({quart("lang, source")}), l AS ({quart("lang")}), e AS ({quart("")}),
f AS (SELECT lang, source, rule, q1, q3, 3 * (q3 - q1) + {cases(1)} AS wide
      FROM (SELECT o.lang, o.source, o.rule, {pick("q1")} AS q1, {pick("q3")} AS q3
            FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule JOIN e ON o.rule = e.rule)),
x AS (SELECT lang, source, max(q1) FILTER (WHERE rule = 'word_length_100') AS a1, max(q3) FILTER (WHERE rule = 'word_length_100') AS a3, max(wide) FILTER (WHERE rule = 'word_length_100') AS a_out,
             max(q3 + wide) FILTER (WHERE rule = 'symbols_1000') AS b_high, max(q3 + wide) FILTER (WHERE rule = 'dup_lines_1000') AS z_high FROM f GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND coalesce(a <= a3 + a_out * greatest(1.0::DOUBLE, sqrt({STEADY_WORDS}::DOUBLE / greatest(n_words, 1))) AND a >= a1 - a_out * greatest(1.0::DOUBLE, sqrt({STEADY_WORDS}::DOUBLE / greatest(n_words, 1))), true) AND coalesce(b <= b_high, true) AND coalesce(z <= z_high, true) AS kept
FROM v LEFT JOIN x ON v.lang IS NOT DISTINCT FROM x.lang AND v.source IS NOT DISTINCT FROM x.source"""
