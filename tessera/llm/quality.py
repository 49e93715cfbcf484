"""Quality rules: counts for each document, and host verdicts from shrunken failure rates.

Every rule's failures are summed by host (source). For each host, a beta prior is fitted to the rates of all other hosts by
the method of moments (from sums over all hosts, less its own), so that a bad host doesn't excuse itself. Its rate is
shrunk towards the prior mean: (failures + a) / (documents + a + b). A host is rejected with all its documents if the
shrunken rate of any rule passes HOST_LIMIT, or is HOST_FLOOR at least and passes the prior mean by DEVIATIONS standard
deviations of the prior; can't be condemned by a few documents.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, only, ship, small, written

#: A host is rejected above this shrunken failure rate of a rule,
HOST_LIMIT = 0.75
#: or if it passes this one and the prior mean by so many deviations.
HOST_FLOOR, DEVIATIONS = 0.25, 3.0
#: Bounds of the prior's weight in documents, and the weight where hosts don't differ or there is only one.
LEAST_WEIGHT, MOST_WEIGHT, PLAIN_WEIGHT = 1.0, 10_000.0, 100.0
#: A variance of the hosts' rates below this is rounding.
LEAST_VARIANCE = 1e-12
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules over the counts; the first two make up base_failed.
RULES = {
    "few_words": "n_words < 10",
    "repetition": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 5 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of one text. bytes.split() and bytes.strip() know ASCII white space only, as asked for."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    if len(words) > WINDOW:
        grams = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(grams)) < len(grams):
            times, reach = Counter(grams), 0
            for k, g in enumerate(grams):
                if times[g] > 1:
                    repeat += k + WINDOW - max(reach, k)
                    reach = k + WINDOW
    spaces = len(raw) - len(raw.translate(None, SPACE))
    return len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat, lines


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def count_text(texts: pa.Array) -> pa.Array:
    rows = [counts(t.as_py() or "") for t in texts]
    columns = zip(*rows) if rows else [[] for _ in COUNTS]
    return pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=list(COUNTS))


def _failed(rule: str) -> Column:
    return F.expr(RULES[rule])


def host_verdicts(stats: DataFrame) -> DataFrame:
    """(source, rate_<rule>..., host_rejected) from stats with source and COUNTS; one row for each host, null included."""
    per = stats.groupBy("source").agg(F.count("*").alias("n"), *[F.sum(_failed(r).cast("long")).alias(r) for r in RULES])
    told = per.select("source", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("k")) for r in RULES])).alias("z"))
    told = told.select("source", "n", "z.rule", "z.k", (F.col("z.k") / F.col("n")).alias("own"))
    sums = told.groupBy("rule").agg(F.count("*").alias("hosts"), F.sum("own").alias("s"), F.sum(F.col("own") * F.col("own")).alias("q"))
    joined = told.join(F.broadcast(sums), "rule")  # a row a rule
    others, own, mu, v, w, rate = (F.col(c) for c in ("others", "own", "mu", "v", "w", "rate"))
    joined = joined.withColumn("others", F.col("hosts") - 1)
    joined = joined.withColumn("mu", F.when(others > 0, F.least(F.lit(1.0), F.greatest(F.col("s") - own, F.lit(0.0)) / others)).otherwise(own))
    joined = joined.withColumn("v", F.when(others > 1, (F.col("q") - own * own - others * mu * mu) / (others - 1)).otherwise(F.lit(0.0)))
    weight = F.when(v > LEAST_VARIANCE, F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(LEAST_WEIGHT), mu * (1 - mu) / v - 1))).otherwise(PLAIN_WEIGHT)
    joined = joined.withColumn("w", weight).withColumn("rate", (F.col("k") + mu * w) / (F.col("n") + w))
    sure = rate - DEVIATIONS * F.sqrt(rate * F.greatest(1 - rate, F.lit(0.0)) / (F.col("n") + w + 1)) > HOST_FLOOR
    stands_out = sure & (rate > mu + DEVIATIONS * F.sqrt(mu * (1 - mu) / (w + 1)))
    rates = [F.max(F.when(F.col("rule") == r, rate)).alias(f"rate_{r}") for r in RULES]
    return joined.groupBy("source").agg(*rates, F.max((rate > HOST_LIMIT) | stands_out).alias("host_rejected"))


def _judged(stats: DataFrame) -> DataFrame:
    """stats with base_failed and kept. The join on the host is Spark's to broadcast or to split where it is skewed."""
    hosts = host_verdicts(stats).select(F.col("source").alias("__host"), "host_rejected")
    base = _failed("few_words") | _failed("repetition")
    out = stats.join(hosts, F.col("source").eqNullSafe(F.col("__host")), "left").drop("__host")
    return out.withColumn("base_failed", base).withColumn("kept", ~base & ~F.col("host_rejected"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id_col, COUNTS without n_lines, base_failed, kept), a row for each row of docs.

    A null text counts as empty, without words, and fails. A null host is a host like any other. Repeated rows count
    each. An empty table gives none.
    """
    ship(docs.sparkSession)
    stats = only(docs, id_col, host_col, text_col).toDF("id", "source", "text").select("id", "source", count_text("text").alias("c"))
    out = _judged(cut(stats.select("id", "source", "c.*")))
    return out.select(F.col("id").alias(id_col), *COUNTS[:-1], "base_failed", "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs without the rejected documents: those that fail the base rules, and all of rejected hosts.

    The counted documents are written once, so that texts are counted once. Null and empty texts have no words and go; a
    null host is a host like any other; repeated rows stay or go together; extra columns stay. An empty table gives none.
    """
    ship(docs.sparkSession)
    stats = docs.withColumn("__c", count_text(F.col(f"`{text_col}`")))
    stats = written(stats)
    verdicts = host_verdicts(stats.select(F.col(f"`{host_col}`").alias("source"), "__c.*"))
    hosts = small(verdicts.where("host_rejected").select(F.col("source").alias("__host")))
    c = {name: F.col(f"__c.{name}") for name in COUNTS}
    base = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
    good = stats.where(~base).join(hosts, F.col(f"`{host_col}`").eqNullSafe(F.col("__host")), "left_anti")
    return good.select(*[F.col(f"`{n}`") for n in docs.columns])


_WORD = r"[^\x20\x09-\x0D]+"
_SUMS = ", ".join(f"sum({r} / n) as s_{r}, sum(({r} / n) * ({r} / n)) as q_{r}" for r in RULES)
_MEANS = ", ".join(f"case when hosts > 1 then least(1, greatest(s_{r} - {r} / n, 0) / (hosts - 1)) else {r} / n end as mu_{r}" for r in RULES)
_VARS = ", ".join(
    f"case when hosts > 2 then (q_{r} - ({r} / n) * ({r} / n) - (hosts - 1) * mu_{r} * mu_{r}) / (hosts - 2) else 0 end as v_{r}" for r in RULES
)
_WEIGHTS = ", ".join(
    f"case when v_{r} > {LEAST_VARIANCE} then least({MOST_WEIGHT}, greatest({LEAST_WEIGHT}, mu_{r} * (1 - mu_{r}) / v_{r} - 1)) else {PLAIN_WEIGHT} end as w_{r}"
    for r in RULES
)
_SHRUNK = ", ".join(f"({r} + mu_{r} * w_{r}) / (n + w_{r}) as rate_{r}" for r in RULES)
_BAD = " or ".join(f"rate_{r} > {HOST_LIMIT} or (rate_{r} - {DEVIATIONS} * sqrt(rate_{r} * greatest(1 - rate_{r}, 0) / (n + w_{r} + 1)) > {HOST_FLOOR} and rate_{r} > mu_{r} + {DEVIATIONS} * sqrt(mu_{r} * (1 - mu_{r}) / (w_{r} + 1)))" for r in RULES)
ORACLE_SQL = f"""
with base as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
lines as (select doc_id, unnest(string_split(t, chr(10))) as ln from base),
worded as (select doc_id, ln, count(*) as n from lines where regexp_matches(ln, '{_WORD}') group by all),
lined as (select doc_id, sum(n) as n_lines, sum(n - 1) as n_dup_lines from worded group by doc_id),
places as (select doc_id, unnest(generate_series(1, len(ws) - 4)) as i from base where len(ws) > 4),
windows as (select p.doc_id, p.i, b.ws[p.i:p.i + 4] as g from places p join base b on p.doc_id = b.doc_id),
twice as (select doc_id, i, count(*) over (partition by doc_id, g) as n from windows),
covered as (select distinct doc_id, i + unnest([0, 1, 2, 3, 4]) as w from twice where n > 1),
repeated as (select doc_id, count(*) as n_repeat_words from covered group by doc_id),
stats as (select b.doc_id, b.source, cast(len(ws) as bigint) as n_words,
    cast(length(t) - length(regexp_replace(t, '{_WORD}', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    cast(coalesce(n_lines, 0) as bigint) as n_lines
  from base b left join lined l on b.doc_id = l.doc_id left join repeated r on b.doc_id = r.doc_id),
per as (select source, count(*) as n, {", ".join(f"sum(case when {e} then 1 else 0 end) as {r}" for r, e in RULES.items())} from stats group by source),
sums as (select count(*) as hosts, {_SUMS} from per),
means as (select *, {_MEANS} from per cross join sums),
vars as (select *, {_VARS} from means),
weights as (select *, {_WEIGHTS} from vars),
rates as (select *, {_SHRUNK} from weights),
hosts as (select source, {_BAD} as bad from rates)
select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not h.bad) as kept
from stats s join hosts h on s.source is not distinct from h.source"""
