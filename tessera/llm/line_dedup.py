"""Near-duplicate lines across documents by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared as words: white space is trimmed and made one space, letters are lower-cased. The edit bound is one
word, and none for short lines: two lines are near if one word is put in, left out or replaced (edit distance over
words) and the longer one has ``LEAST`` words at least, so that three quarters of it are the same. A line goes if it
equals an earlier line, or if an earlier distinct line is near; earlier is by doc_id (null first), then text, then
place in the text, each distinct line counting where it stands first. Lines without words stay.

Every line of n words would emit n variants. Most lines cannot have a neighbour, which four hashes show: of two near
lines, either the first or the last halves are the same, whichever has not the edit. Only lines that share a half with
another line (its length told from both lengths that a neighbour may have) emit variants. A variant's key is the
exclusive-or of hashes of (word, place), so keys of all variants of a line come from running sums. Lines whose variant
without word i is the same differ in word i; a variant that is a whole other line lacks word i. Each such group is
linked to its earliest line alone, so a group of thousands makes as many links as it has lines; links are verified on
the words.

Null texts are empty. Very long texts and lines are taken whole. Rows of equal doc_id and equal text are one text here,
and all of them come back. Other columns are ignored. An empty table gives an empty result. Lines are equal if 64-bit
hashes of their words are; near lines are told by their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

WHITE = r"[\x20\x09-\x0D]+"
#: Words that the longer one of two near lines has at least.
LEAST = 4


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), WHITE), "")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, at, w): the lines with words, as arrays of words. mark tells texts of equal doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return split.select("doc_id", "mark", "at", _words(F.col("line")).alias("w")).filter(F.size("w") > 0)


def _halves() -> Column:
    """Hashes of the first and the last half of w, told for its own length and for one word less."""
    n, out = F.size("w"), []
    for less in (0, 1):
        size = n - less
        half = (size / 2).cast("int")
        out.append(F.xxhash64(size, F.lit("first"), F.slice("w", 1, half)))
        out.append(F.xxhash64(size, F.lit("last"), F.slice("w", n - (size - half) + 1, size - half)))
    return F.array(*out)


def _without(words: str, i: Column) -> Column:
    return F.concat(F.slice(words, 1, i), F.slice(words, i + 2, F.size(words)))


def _words_at(docs: DataFrame, some: DataFrame) -> DataFrame:
    """some (line_id, place) with w, the words of the line at place. Each text is moved once, not its lines one by one."""
    wanted = some.groupBy(F.struct("place.doc_id", "place.mark").alias("doc")).agg(F.collect_list(F.struct("place.at", "line_id")).alias("wanted"))  # lines of one text
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.struct("doc_id", F.xxhash64(text).alias("mark")).alias("doc"), text.alias("text")).join(wanted, "doc")
    again = F.row_number().over(Window.partitionBy("doc").orderBy("doc"))
    texts = texts.withColumn("again", again).filter("again = 1")
    # The text is split once for all of its lines.
    found = F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform("wanted", lambda s: F.struct(s["at"].alias("at"), s["line_id"].alias("line_id"), F.get(lines, s["at"]).alias("line"))))
    line = texts.select("doc", F.explode(F.get(found, F.lit(0))).alias("s"))
    return line.select("s.line_id", F.struct("doc.doc_id", "doc.mark", "s.at").alias("place"), _words(F.col("s.line")).alias("w"))


def near_lines(spark: SparkSession, docs: DataFrame, first: DataFrame) -> DataFrame:
    """line_id of the lines of first (line_id, place, n, halves) that have a near line before them; written out."""
    first = first.filter(F.col("n") >= LEAST - 1)
    keys = first.select("line_id", F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.min("line_id").alias("x"), F.max("line_id").alias("y")).filter("x <> y").select("half")
    some = keys.join(shared, "half").select("line_id").distinct().join(first.select("line_id", "place"), "line_id")
    lines = common.cut(spark, _words_at(docs, some), "line-words")

    # Dealt by line before the words are told apart, so that the running sums need no shuffle of single words.
    word = lines.repartition("line_id").select("line_id", "place", F.size("w").alias("n"), F.posexplode("w").alias("i", "x"))
    here, moved = F.xxhash64("x", "i"), F.xxhash64("x", F.col("i") - 1)
    order = Window.partitionBy("line_id").orderBy("i")
    whole = Window.partitionBy("line_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    word = word.select(
        "line_id", "place", "n", "i",
        F.bit_xor(here).over(upto).bitwiseXOR(here).alias("before"),
        F.bit_xor(moved).over(whole).bitwiseXOR(F.bit_xor(moved).over(upto)).alias("after"),
        F.bit_xor(here).over(whole).alias("full"),
    )
    variants = variants_held = common.cut(spark, word.select("line_id", "place", "n", "i", F.col("before").bitwiseXOR(F.col("after")).alias("key"), "full"), "line-variants")
    fulls = variants.filter("i = 0").select((F.col("n") + 1).alias("n"), F.col("full").alias("key"), F.col("line_id").alias("short"), F.col("place").alias("short_place"))
    variants = variants.filter(F.col("n") >= LEAST)
    # Equal but for word i: linked to the earliest of the group. Few keys have two lines; only these look for it.
    both = variants.groupBy("n", "i", "key").agg(F.min("line_id").alias("x"), F.max("line_id").alias("y")).filter("x <> y").drop("x", "y")
    alike = common.cut(spark, variants.select("line_id", "place", "n", "i", "key").join(both, ["n", "i", "key"]), "line-alike")
    group = alike.groupBy("n", "i", "key").agg(F.min_by("line_id", "place").alias("other"))
    replaced = alike.join(group, ["n", "i", "key"]).filter("line_id <> other").select(F.col("line_id").alias("later"), F.col("other").alias("earlier"), "i", F.lit(0).alias("longer"))
    # Equal to another line but for word i, which that line lacks: the later of the two is linked to the earlier.
    added = variants.join(fulls, ["n", "key"]).filter("line_id <> short")
    long_later = F.col("place") > F.col("short_place")
    added = added.select(
        F.when(long_later, F.col("line_id")).otherwise(F.col("short")).alias("later"), F.when(long_later, F.col("short")).otherwise(F.col("line_id")).alias("earlier"),
        "i", F.when(long_later, 1).otherwise(2).alias("longer"),
    )
    links = replaced.union(added).groupBy("later", "earlier", "longer").agg(F.min("i").alias("i"))
    links = links.join(lines.select(F.col("line_id").alias("later"), F.col("w").alias("lw")), "later")
    links = links.join(lines.select(F.col("line_id").alias("earlier"), F.col("w").alias("ew")), "earlier")
    i = F.col("i")
    left = F.when(F.col("longer") == 2, F.col("lw")).otherwise(_without("lw", i))
    right = F.when(F.col("longer") == 1, F.col("ew")).otherwise(_without("ew", i))
    found = common.cut(spark, links.filter(left == right).select(F.col("later").alias("line_id")).distinct(), "near-lines")
    common.drop(spark, lines, variants_held, alike)
    return found


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_equal, n_near (lines removed as equal, as near), and the text that is kept."""
    docs = docs.select("doc_id", "text")
    lines = _lines(docs).select("doc_id", "mark", "at", F.xxhash64("w").alias("line_id"), F.size("w").alias("n"), _halves().alias("halves"))
    lines = common.cut(spark, lines, "lines")
    place = F.struct("doc_id", "mark", "at")
    first = lines.groupBy("line_id").agg(F.min(place).alias("place"), F.max("n").alias("n"), F.max("halves").alias("halves"))
    first = common.cut(spark, first, "first-lines")
    near_held = near_lines(spark, docs, first)
    near = near_held.withColumn("near", F.lit(True))
    judged = lines.select("line_id", "doc_id", "mark", "at").join(first.select("line_id", "place"), "line_id").join(near, "line_id", "left")
    equal = place != F.col("place")
    gone = judged.select("doc_id", "mark", "at", equal.alias("equal"), F.coalesce("near", F.lit(False)).alias("near")).filter("equal OR near").distinct()
    gone = gone.groupBy("doc_id", "mark").agg(
        F.collect_list("at").alias("gone"), F.count_if("equal").alias("n_equal"), F.count_if(F.expr("near AND NOT equal")).alias("n_near")
    )
    gone = common.cut(spark, gone, "gone-lines").withColumnRenamed("doc_id", "d")
    common.drop(spark, lines, first, near_held)
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"), F.split(text, "\n").alias("l"))
    out = whole.join(gone, (whole["mark"] == gone["mark"]) & whole["doc_id"].eqNullSafe(gone["d"]), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), "gone")  # in order; one look-up a line
    kept = F.array_join(F.transform(places, lambda i: F.get("l", i)), "\n")
    return out.select(
        "doc_id",
        F.size("l").cast("long").alias("n_lines"),
        F.coalesce("n_equal", F.lit(0)).cast("long").alias("n_equal"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )


ORACLE = r"""
WITH l AS (SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10)) AS a, list_filter(string_split_regex(lower(a[i]), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
f AS MATERIALIZED (SELECT w, min((doc_id, pos)) AS p FROM l WHERE len(w) > 0 GROUP BY w),
v AS MATERIALIZED (SELECT p, n, i, hash(list_concat(w[1 : i - 1], w[i + 1 :])) AS k FROM (SELECT w, p, len(w) AS n, unnest(generate_series(1, len(w))) AS i FROM f WHERE len(w) >= 4)),
near AS (SELECT p FROM (SELECT p, min(p) OVER (PARTITION BY n, i, k) AS e FROM v) WHERE p <> e
    UNION SELECT greatest(v.p, f.p) FROM v JOIN f ON v.k = hash(f.w) AND v.n = len(f.w) + 1),
j AS (SELECT l.doc_id, l.pos, l.a, f.p IS NOT NULL AND f.p <> (l.doc_id, l.pos) AS eq, near.p IS NOT NULL AS nr
    FROM l LEFT JOIN f ON l.w = f.w LEFT JOIN near ON near.p = f.p)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(eq) AS BIGINT) AS n_equal, CAST(count_if(nr AND NOT eq) AS BIGINT) AS n_near,
    md5(coalesce(string_agg(CASE WHEN NOT eq AND NOT nr THEN a[pos] END, chr(10) ORDER BY pos), '')) AS kept_md5
FROM j GROUP BY doc_id
"""
