"""Secret scans in DataFrame functions alone: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of at least WINDOW characters of the base64 alphabet. A window of WINDOW characters slides over it;
the counts of the characters in the window, and the sum of c * log2(c) over them, are kept by adding the character that
enters and taking off the one that leaves. The largest entropy, log2(WINDOW) - sum / WINDOW, is held against the
threshold of the candidate's character class. The allow-list suppresses candidates that are known not to be secret.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are taken whole, so a least length inside the pattern drops the same matches as one asked for afterwards.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Class of a candidate: a pattern that it matches as a whole, and the least entropy in bits that flags it. First wins.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", 2.8),
    ("alnum", r"^[A-Za-z0-9]+$", 3.4),
    ("base64", r"^[A-Za-z0-9+/=_-]+$", 3.6),
)
#: Allow-list: (pattern, pattern that must not occur). Digits or letters alone (numbers, words), UUIDs, and words or
#: numbers of up to four digits joined by -, _ or /. No pattern repeats a group, since Java's matcher recurses there.
ALLOW = (
    (r"^[0-9+/=_-]+$", None),
    (r"^[A-Za-z+/=_-]+$", None),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", None),
    (r"^[A-Za-z0-9][A-Za-z0-9_/-]*[A-Za-z0-9]$", r"[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}"),
)


def _running(numbers: Column) -> Column:
    """Running sums of an array, by doubling: n log n steps, where an aggregate that appends would take n * n."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers).cast("double"))).cast("int"))
    return F.aggregate(
        rounds, numbers, lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))
    )


def _places(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<s, e, v>> of the pattern's leftmost matches: code points, end exclusive, and the group's text.

    The texts between the matches give the places: a match starts after all that comes before it. Arrays are zipped, not
    indexed: an expression of the row that a lambda refers to would be computed again for every element.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    steps = F.filter(F.zip_with(between, found, lambda b, m: F.length(b) + F.length(m)), lambda n: n.isNotNull())
    ends = F.zip_with(_running(steps), found, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e")))
    places = F.zip_with(ends, value, lambda p, v: F.struct(p["s"].alias("s"), p["e"].alias("e"), v.alias("v")))
    return F.when(F.regexp_like(text, F.lit(pattern)), places).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))


#: The counts of a window are held in longs, BITS for each character of the alphabet, as many as a long takes.
BITS = 5
PER_LONG = 63 // BITS
N_LONGS = -(-len(ALPHABET) // PER_LONG)


def window_entropy(word: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of the windows of a word of at least `window` characters of ALPHABET.

    window is below 2 ** BITS. Each step adds one to the entering character's count and takes one off the leaving one's.
    """
    slots = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    moves = F.zip_with(slots, F.slice(F.concat(F.array_repeat(F.lit(-1), window), slots), F.lit(1), F.length(word)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    clog = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    names = [f"n{k}" for k in range(N_LONGS)]
    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in names], F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("most"))

    def held(acc: Column, slot: Column) -> Column:
        long = F.element_at(F.array(*[acc[n] for n in names]), (slot / PER_LONG).cast("int") + 1)
        return F.call_function("shiftright", long, (slot % PER_LONG) * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def one(slot: Column, k: int) -> Column:
        return F.when((slot / PER_LONG).cast("int") == k, F.call_function("shiftleft", F.lit(1).cast("long"), (slot % PER_LONG) * BITS)).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, x: Column) -> Column:
        enter, leave = x["a"], x["b"]
        c_in = held(acc, enter)
        # the leaving character's count, the entering one added
        c_out = F.when(leave >= 0, held(acc, leave) + (leave == enter).cast("int"))
        total = acc["sum"] + F.get(clog, c_in + 1) - F.get(clog, c_in) + F.coalesce(F.get(clog, c_out - 1) - F.get(clog, c_out), F.lit(0.0))
        entropy = F.when(acc["i"] >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
        counts = [(acc[n] + one(enter, k) - F.when(leave >= 0, one(leave, k)).otherwise(F.lit(0).cast("long"))).alias(n) for k, n in enumerate(names)]
        return F.struct(*counts, (acc["i"] + 1).alias("i"), total.alias("sum"), F.greatest(acc["most"], entropy).alias("most"))

    return F.aggregate(moves, start, step, lambda acc: acc["most"])


def is_secret(word: Column) -> Column:
    allowed = F.lit(False)
    for pattern, unless in ALLOW:
        allowed = allowed | (F.regexp_like(word, F.lit(pattern)) & (~F.regexp_like(word, F.lit(unless)) if unless else F.lit(True)))
    least = F.lit(99.0)
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(F.regexp_like(word, F.lit(pattern)), F.lit(bits)).otherwise(least)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(word) >= least - 1e-9)


def _spans(kind: int, places: Column) -> Column:
    return F.transform(places, lambda p: F.struct(p["s"].alias("s"), F.lit(kind).alias("k"), p["e"].alias("e")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.get(names, p["k"]), p["s"].cast("string"), p["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct<s, k, e>>) for each row of docs, by start, then kind; k counts in KINDS.

    Whole texts are scanned. A null or empty text has no spans. Rows with null or repeated ids stay as they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = only(docs, id_col, text_col).toDF("id", "text").select("id", text.alias("text"))
    rows = rows.select(
        "id",
        F.filter(_places(F.col("text"), ASSIGN, 1), lambda p: F.length(p["v"]) >= ASSIGN_LEAST).alias("assign"),
        _places(F.col("text"), ACCESS).alias("access"),
        _places(F.col("text"), HEX).alias("hex"),
        F.filter(_places(F.col("text"), CANDIDATE), lambda p: is_secret(p["v"])).alias("entropy"),
    )
    return rows.select(
        F.col("id").alias(id_col), F.array_sort(F.concat(*[_spans(k, F.col(name)) for k, name in enumerate(KINDS)])).alias("spans")
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda p: p["k"] < 3)
    n = lambda kind: F.size(F.filter("spans", lambda p: p["k"] == kind)).cast("long")
    return found.select(
        id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_places(kind: int, pattern: str, group: int = 0) -> str:
    p = _q(pattern)
    return f"""select doc_id, {kind} as k, i, list_extract(vs, i) as v, length(list_extract(ms, i)) as n,
  list_sum(list_transform(bs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as s
  from (select doc_id, ms, vs, bs, unnest(generate_series(1, len(ms))) as i from (select doc_id, regexp_extract_all(t, {p}) as ms,
  regexp_extract_all(t, {p}, {group}) as vs, string_split_regex(t, {p}) as bs from base where regexp_matches(t, {p})))"""


ORACLE_SQL = f"""
with base as (select doc_id, coalesce(text, '') as t from documents),
fixed as ({_sql_places(0, ASSIGN, 1)} union all {_sql_places(1, ACCESS)} union all {_sql_places(2, HEX)}),
cand as ({_sql_places(3, CANDIDATE)}),
listed as (select *, case {" ".join(f"when regexp_matches(v, {_q(p)}) then {b}" for _, p, b in CLASSES)} end as least from cand
  where {" and ".join(f"not (regexp_matches(v, {_q(p)})" + (f" and not regexp_matches(v, {_q(u)}))" if u else ")") for p, u in ALLOW)}),
starts as (select *, unnest(generate_series(1, n - {WINDOW} + 1)) as w from listed),
chars as (select doc_id, i, w, least, substr(v, w + unnest(generate_series(0, {WINDOW - 1})), 1) as c from starts),
counted as (select doc_id, i, w, least, c, count(*) as n from chars group by all),
bits as (select doc_id, i, w, least, {math.log2(WINDOW)} - sum(n * log2(n)) / {WINDOW} as h from counted group by all),
flagged as (select distinct doc_id, i from bits where h >= least - 1e-12),
spans as (select doc_id, k, s, s + n as e from fixed where k > 0 or length(v) >= {ASSIGN_LEAST}
  union all select c.doc_id, k, s, s + n from cand c join flagged f on c.doc_id = f.doc_id and c.i = f.i),
named as (select *, list_extract(['assign', 'access', 'hex', 'entropy'], k + 1) || ':' || cast(s as bigint) || ':' || cast(e as bigint) as x from spans)
select d.doc_id, cast(count(*) filter (where k = 0) as bigint) as n_assign, cast(count(*) filter (where k = 1) as bigint) as n_access,
  cast(count(*) filter (where k = 2) as bigint) as n_hex,
  sha256(coalesce(string_agg(x, ',' order by s, k, e) filter (where k < 3), '')) as base_sha256,
  coalesce(string_agg(x, ',' order by s, k, e), '') as spans
from documents d left join named n on d.doc_id = n.doc_id group by d.doc_id"""
