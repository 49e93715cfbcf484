"""Line dedup with suffix ranks: repeated runs of lines are found by prefix doubling, and later copies are deleted.

The corpus is a sequence of line ids, a document after the other in order of id. Lines that occur once can't be part
of a repeated run and cut the sequence into islands; islands of fewer than `min_words` words are dropped at once.
rank_k(i) names the class of suffixes that agree on 2**k lines from position i: that is the interval of the suffix
array whose longest common prefix is 2**k at least, and its name is its earliest suffix. rank_k+1 comes from the pairs
(rank_k(i), rank_k(i + 2**k)).

A run of m lines is fixed by the two ranks of the largest power of two that fits, taken at its first and its last
lines. So for each position the shortest run of `min_words` words that starts there, and the one that ends there, name
an interval; all suffixes of an interval but the earliest are later copies, and their lines go. The union of these runs
is that of all maximal repeated runs with that many words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))


def _islands(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(gid, doc, h, pos, isl, words, line): lines that occur twice or more, in islands with enough words. gid grows
    with (id, text hash, pos), and by one from line to line of an island."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = docs.select(_key(id_col).alias("doc"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "ln"))
    # two 64-bit hashes with different seeds name a line
    lines = cut(
        lines.select(
            "doc", "h", "pos",
            F.xxhash64("ln").alias("x"),
            F.xxhash64(F.lit(1), "ln").alias("y"),
            F.regexp_count("ln", F.lit(WORD)).alias("words"),
        )
    )
    # counted apart from the join, so that Spark can split a very common line's partition there
    often = cut(lines.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y"))
    own = Window.partitionBy("doc", "h").orderBy("pos")
    island = Window.partitionBy("doc", "h", "isl")
    rows = lines.join(often, ["x", "y"]).repartitionByRange("doc", "h")
    rows = rows.groupBy("doc", "h", "pos").agg(*[F.first(c).alias(c) for c in ("x", "y", "words")])  # repeated rows are one document
    rows = rows.withColumn("isl", F.col("pos") - F.row_number().over(own))
    rows = rows.withColumn("all", F.sum("words").over(island)).where(F.col("all") >= min_words).drop("all")
    rows = rows.sortWithinPartitions("doc", "h", "pos").withColumn("gid", F.monotonically_increasing_id())
    return cut(rows)


ISLAND = ["doc", "h", "isl"]


def _runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc, h, isl, gid, m): the shortest runs of m lines with min_words words that start, or that end, at a line."""
    order = Window.partitionBy(*ISLAND).orderBy("pos")
    rows = rows.withColumn("through", F.sum("words").over(order)).withColumn("before", F.col("through") - F.col("words"))

    def merged(point: Column, ask: Column) -> DataFrame:
        # points and questions in one order; a question's answer is the last point at or before it
        return rows.select(
            *ISLAND, "gid", F.explode(F.array(F.struct(point.alias("at"), F.lit(0).alias("ask")), F.struct(ask.alias("at"), F.lit(1).alias("ask")))).alias("z")
        ).select(*ISLAND, "gid", "z.*")

    def answered(asked: DataFrame, *by: Column) -> DataFrame:
        w = Window.partitionBy(*ISLAND).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        point = F.when(F.col("ask") == 0, F.col("gid"))
        return asked.withColumn("found", F.last(point, ignorenulls=True).over(w)).where("ask = 1 and found is not null")

    forward = answered(merged(F.col("through"), F.col("before") + min_words), F.desc("at"), F.asc("ask"), F.desc("gid"))
    backward = answered(merged(F.col("before"), F.col("through") - min_words), F.asc("at"), F.asc("ask"), F.asc("gid"))
    forward = forward.select(*ISLAND, "gid", (F.col("found") - F.col("gid") + 1).alias("m"))
    backward = backward.select(*ISLAND, F.col("found").alias("gid"), (F.col("gid") - F.col("found") + 1).alias("m"))
    return forward.unionByName(backward).distinct()


def _named(pairs: DataFrame, *by: str) -> DataFrame:
    """Each class of rows with equal `by` is named by its earliest suffix; classes of one row go.

    The names are computed apart from the join, so that Spark can split a large class's partition there.
    """
    least = cut(pairs.groupBy(*by).agg(F.min("gid").alias("rank"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return pairs.join(least, list(by)).drop(*by)


def suffix_ranks(rows: DataFrame, levels: int) -> DataFrame:
    """(k, gid, rank) for k = 0 .. levels, of every suffix whose first 2**k lines occur elsewhere too."""
    level = cut(_named(rows.select(*ISLAND, "gid", "x", "y"), "x", "y"))
    out = level.select(F.lit(0).alias("k"), "gid", "rank")
    for k in range(levels):
        ahead = level.select(*ISLAND, (F.col("gid") - 2**k).alias("gid"), F.col("rank").alias("rank2"))
        pairs = cut(level.withColumnRenamed("rank", "rank1").join(ahead, [*ISLAND, "gid"]))
        level = cut(_named(pairs, "rank1", "rank2"))
        out = out.unionByName(level.select(F.lit(k + 1).alias("k"), "gid", "rank"))
    return out


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, h, pos) of every line that belongs to a later copy of a repeated run of at least min_words words."""
    rows = _islands(docs, id_col, text_col, min_words)
    runs = cut(_runs(rows, min_words))
    longest = runs.agg(F.max("m")).first()[0] or 1
    ranks = suffix_ranks(rows, int(math.log2(longest)))
    runs = runs.withColumn("k", F.floor(F.log2("m") + 1e-9).cast("int"))
    runs = runs.withColumn("last", F.expr("gid + m - shiftleft(1L, k)"))
    first = ranks.withColumnRenamed("rank", "r1")
    last = ranks.select("k", F.col("gid").alias("last"), F.col("rank").alias("r2"))
    runs = cut(runs.join(first, ["k", "gid"]).join(last, ["k", "last"]))
    least = cut(runs.groupBy("m", "r1", "r2").agg(F.min("gid").alias("least")))
    later = runs.join(least, ["m", "r1", "r2"]).where("gid > least").groupBy("gid").agg(F.max(F.col("gid") + F.col("m")).alias("stop"))
    w = Window.partitionBy(*ISLAND).orderBy("gid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = rows.select(*ISLAND, "gid", "pos").join(later, "gid", "left").withColumn("stop", F.max("stop").over(w))
    return reached.where("gid < stop").select("doc", "h", "pos")


def _without(lines: Column, gone: Column) -> Column:
    """lines without those at the places in gone: both are sorted together by place, so it takes n log n steps."""
    both = F.array_sort(F.concat(
        F.transform(gone, lambda p: F.struct(p.alias("p"), F.lit(0).alias("k"), F.lit("").alias("x"))),
        F.transform(lines, lambda x, i: F.struct(i.alias("p"), F.lit(1).alias("k"), x.alias("x"))),
    ))
    none = F.lit(None).cast("struct<p:int,k:int,x:string>")
    told = F.zip_with(both, F.concat(F.array(none), both), lambda a, b: F.struct(a["k"].alias("k"), a["x"].alias("x"), F.coalesce(a["p"] == b["p"], F.lit(False)).alias("gone")))
    return F.transform(F.filter(told, lambda t: (t["k"] == 1) & ~t["gone"]), lambda t: t["x"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated line runs deleted from text_col, and the columns n_lines_in, n_lines_removed.

    The copy that stays is the first by (id, text hash, line). A run may repeat inside a document. A null text stays
    null, with 0 lines; an empty text has one line. Rows that repeat an id and a text count as one document and get the
    same result. Rows with a null id come before all others. An empty table gives an empty table. Columns of docs named
    doc, h, or pos don't clash: the work is done on copies.
    """
    removed = removed_lines(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", min_words)
    removed = removed.groupBy(F.col("doc").alias("__doc"), F.col("h").alias("__h")).agg(F.collect_set("pos").alias("__gone"))
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumns({"__doc": _key(id_col), "__h": F.xxhash64(F.coalesce(text, F.lit("")))})
    rest = _without(F.split(text, "\n", -1), F.col("__gone"))
    out = keyed.join(removed, ["__doc", "__h"], "left").withColumns({
        text_col: F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(rest, "\n")),
        "n_lines_in": F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long"),
        "n_lines_removed": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"),
    })
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines_in", "n_lines_removed")], "n_lines_in", "n_lines_removed")


def keep_with_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """dedup_lines for a pipeline: the columns of docs, n_chars kept true; documents whose every line was a later copy go.

    Null and empty texts stay (quality rules are another stage's), and so do rows with a null id; of equal runs the
    first by (id, text hash, line) stays, so ties can't drop both. Rows that repeat id and text get the same text each. An
    empty table gives none; extra columns stay as they are.
    """
    out = dedup_lines(docs, id_col, text_col).where("n_lines_removed = 0 or n_lines_removed < n_lines_in")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same rows by gaps and islands over all pairs of equal lines: for every pair of places on one diagonal, the runs
#: of consecutive pairs are the common runs of two places.
ORACLE_SQL = f"""
with base as (select doc_id, coalesce(text, '') as t, text from documents),
lines as (select doc_id, generate_subscripts(string_split(t, chr(10)), 1) - 1 as pos, unnest(string_split(t, chr(10))) as ln from base),
counted as (select *, len(regexp_extract_all(ln, '{WORD}')) as words, doc_id * 100000 + pos as gid from lines),
pairs as (select b.gid, b.doc_id, b.pos, b.words, a.gid as g0, a.doc_id as d0, b.gid - a.gid as diag
          from counted a join counted b on a.ln = b.ln and a.gid < b.gid),
runs as (select *, gid - row_number() over (partition by doc_id, d0, diag order by gid) as isl from pairs),
longs as (select *, sum(words) over (partition by doc_id, d0, diag, isl) as w from runs),
gone as (select distinct doc_id, pos from longs where w >= {MIN_WORDS}),
kept as (select l.doc_id, count(*) as n, count(g.pos) as r, string_agg(l.ln, chr(10) order by l.pos) filter (where g.pos is null) as t
         from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id)
select d.doc_id, cast(n as bigint) as n_lines_in, cast(r as bigint) as n_lines_removed,
       case when r = 0 then d.text else coalesce(k.t, '') end as text
from documents d join kept k on d.doc_id = k.doc_id"""
