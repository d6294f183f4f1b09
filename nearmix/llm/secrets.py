"""Secret scans with DataFrame functions only: base patterns and linked parts of credentials.

Base spans are reported always. Beyond them, a credential often comes in parts that are weak
evidence alone: an identifier, a secret-looking string, an endpoint. Such candidates are
reported only where complementary parts begin within SCOPE characters before or behind them:

* an identifier, where a secret (strong or weak) co-occurs,
* a secret-looking string, where an identifier or an endpoint co-occurs,
* an endpoint, where both an identifier and a secret co-occur.

The interval join is a window frame over a text's parts, by distance between their beginnings, so
no pair of parts is ever formed and what stands further away in the text doesn't matter. A weak
candidate that begins inside a base span is part of it and not reported again.

Positions: a pattern's matches and the pieces between them alternate, so a match begins after
the summed lengths of what stands before it; sums run per text over its own matches.

Defined results: a null text counts as empty; one row per row of docs, repeated rows included;
a null doc_id stays null. Spans are code points, end exclusive, by start, then by kind as listed
in KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearmix.llm.common import Scratch, table

SCOPE = 512


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGN_HEAD = "(" + _any_case("password|passwd|secret|token|api_?key") + ")[\"']?\\x20*[:=]\\x20*[\"']?"
_ID_HEAD = "(?:" + _any_case("access_?key_?id|client_?id|account_?id|user_?name|login") + ")[\"']?\\x20*[:=]\\x20*[\"']?"
#: kind -> (pattern, least characters of the text that the second pattern leaves of a match)
BASE = {
    "assign": _ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
}
WEAK = {
    "weak_id": _ID_HEAD + "[A-Za-z0-9+/_.@-]{3,}",
    "weak_secret": "[A-Za-z0-9+/_=-]{20,}",
    "endpoint": "https?://[^\\s\"'<>]+",
}
KINDS = (*BASE, *WEAK)


def _holds(kind: str, match: str) -> str:
    """SQL (Spark and DuckDB alike) for what a match must have besides its pattern."""
    if kind == "assign":
        return f"length(regexp_replace({match}, '^{_ASSIGN_HEAD.replace(chr(39), chr(39) * 2)}', '')) >= 6"
    if kind == "access":
        return f"length({match}) >= 20"
    if kind == "weak_secret":
        return f"regexp_like({match}, '[0-9]') AND regexp_like({match}, '[a-z]') AND regexp_like({match}, '[A-Z]')"
    return "true"


def _parts(kind: str) -> Column:
    """Array of (kind number, place, length before the match, length of the match, holds) for a text."""
    pattern = F.lit({**BASE, **WEAK}[kind])
    pieces, matches = F.split("text", {**BASE, **WEAK}[kind], -1), F.regexp_extract_all("text", pattern, F.lit(0))
    if kind == "assign":
        holds = lambda m: F.length(F.regexp_replace(m, "^" + _ASSIGN_HEAD, "")) >= 6
    elif kind == "access":
        holds = lambda m: F.length(m) >= 20
    elif kind == "weak_secret":
        holds = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    else:
        holds = lambda m: F.lit(True)
    one = lambda m, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("place"), F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("length"), holds(m).alias("holds")
    )
    return F.when(F.col("text").rlike({**BASE, **WEAK}[kind]), F.transform(matches, one)).otherwise(F.array().cast(_PARTS))


_PARTS = "array<struct<kind:int,place:int,gap:int,length:int,holds:boolean>>"


_KEYS = ("doc_id", "text_key")


def _parts_of_all() -> Column:
    return F.concat(*[_parts(k) for k in KINDS])


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """found(doc_id, text_key, parts) -> the reported spans (doc_id, text_key, kind, start, end) of distinct texts."""
    each = found.where(F.size("parts") > 0).groupBy(*_KEYS).agg(F.first("parts").alias("parts")).select(*_KEYS, F.explode("parts").alias("p")).select(*_KEYS, "p.*")
    before = Window.partitionBy(*_KEYS, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before)).where("holds")
    placed = placed.select(*_KEYS, "kind", (F.col("end") - F.col("length")).alias("start"), "end")
    base = F.col("kind") < len(BASE)
    so_far = Window.partitionBy(*_KEYS).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(base, F.col("end"))).over(so_far)
    placed = placed.withColumn("reach", reach).where(base | F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).drop("reach")
    within = Window.partitionBy(*_KEYS).orderBy("start").rangeBetween(-scope, scope)
    is_kind = lambda *names: F.col("kind").isin([KINDS.index(n) for n in names])
    has = lambda *names: F.max(is_kind(*names)).over(within)
    flagged = placed.select(
        *_KEYS, "kind", "start", "end",
        has("access", "weak_id").alias("an_id"), has("assign", "hex", "weak_secret").alias("a_secret"), has("endpoint").alias("an_endpoint"),
    )
    linked = (
        base
        | (is_kind("weak_id") & F.col("a_secret"))
        | (is_kind("weak_secret") & (F.col("an_id") | F.col("an_endpoint")))
        | (is_kind("endpoint") & F.col("an_id") & F.col("a_secret"))
    )
    return flagged.where(linked).select(*_KEYS, "kind", "start", "end")


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs(doc_id, text, ..) -> (doc_id, text_key, spans), spans an array of (start, kind number, end).

    One row per distinct (doc_id, text) with at least one span.
    """
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kept = _linked(rows.select(*_KEYS, _parts_of_all().alias("parts")), scope)
    return kept.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def _told(of: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs(doc_id, text, ..) -> (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per row of docs."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    found = spans(docs, scope)
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    all_ = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    joined = joined.select(F.col("id").alias("doc_id"), all_.alias("all"))
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    base = F.filter("all", lambda s: s["kind"] < len(BASE))
    return joined.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("all")).alias("spans")
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


#: Characters of the blocks that a text is cut into before pieces of it are taken.
BLOCK = 4096


def _without(text: Column, begins: Column, ends: Column, mask: str) -> tuple[Column, Column]:
    """A struct to hold as column _b, and by it the text with ``mask`` for each span; spans are in order and don't overlap.

    A piece is taken from the blocks it touches, so the work is that of the text's length and of a
    block a span, not of the text's length a span.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(a: Column, b: Column) -> Column:
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        x, y = (a % BLOCK).cast("int"), (b % BLOCK).cast("int")
        whole = F.array_join(F.slice("_b.blocks", i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        block = lambda n: F.coalesce(F.get("_b.blocks", n), F.lit(""))
        return F.when(i == j, F.substring(block(i), x + 1, y - x)).otherwise(
            F.concat(F.substring(block(i), x + 1, F.lit(BLOCK)), whole, F.substring(block(j), F.lit(1), y))
        )

    n = F.size("_b.begins")
    after = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("_b.ends", i - 1))
    until = lambda i: F.when(i == n, F.col("_b.length")).otherwise(F.get("_b.begins", i))
    made = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: piece(after(i), until(i))), mask)
    return F.struct(blocks.alias("blocks"), begins.alias("begins"), ends.alias("ends"), F.length(text).cast("long").alias("length")), made


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, mask: str = "[SECRET]") -> DataFrame:
    """Replace every reported span by ``mask``; overlapping spans become one. No document goes.

    The patterns run over the texts once: their matches are stored beside the rows. Only rows with a
    match are shuffled; n_chars follows the text where it changes. Columns of any name stay as they
    are.
    """
    columns = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {n: f"c{i}" for i, n in enumerate(columns)}
    text = F.col(at["text"])
    parts = _parts_of_all()
    rows = numbered.withColumn("text", text).select(*[c for c in numbered.columns], F.coalesce(parts, F.array().cast(_PARTS)).alias("parts"))
    scratch = Scratch(spark, "redact")
    rows = scratch.store(rows, "rows")
    hit = rows.where(F.size("parts") > 0).withColumn("text_key", F.xxhash64(text))
    found = _linked(hit.select(F.col(at["doc_id"]).alias("doc_id"), "text_key", "parts"), SCOPE)
    order = Window.partitionBy(*_KEYS).orderBy("start", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    group = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = found.withColumn("new", new).withColumn("group", group).groupBy(*_KEYS, "group").agg(F.min("start").alias("begin"), F.max("end").alias("end"))
    merged = merged.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("all"))
    joined = hit.drop("parts").join(merged.withColumnRenamed("text_key", "key"), F.col(at["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key")), "left")
    cut, made = _without(text, F.col("all.begin"), F.col("all.end"), mask)
    changed = joined.withColumn("_b", F.when(F.col("all").isNotNull(), cut))
    changed = changed.withColumn(at["text"], F.when(F.col("all").isNotNull(), made).otherwise(text))
    if "n_chars" in at:
        old = F.col(at["n_chars"])
        changed = changed.withColumn(at["n_chars"], F.when(F.col("all").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(old))
    back = rows.where(F.size("parts") == 0).drop("parts").unionByName(changed.select(*numbered.columns))
    return back.toDF(*columns)


def oracle(scope: int = SCOPE) -> str:
    quoted = lambda p: p.replace("'", "''")
    each = "\nUNION ALL\n".join(
        f"SELECT doc_id, text, {i} AS kind, unnest(range(1, len(m) + 1)) AS place, unnest(m) AS match, unnest(s[1:len(m)]) AS piece FROM "
        f"(SELECT DISTINCT doc_id, text, regexp_extract_all(text, '{quoted(p)}') AS m, string_split_regex(text, '{quoted(p)}') AS s "
        f"FROM documents WHERE regexp_matches(text, '{quoted(p)}'))"
        for i, p in enumerate({**BASE, **WEAK}.values())
    )
    holds = " ".join(f"WHEN {i} THEN {_holds(k, 'match').replace('regexp_like', 'regexp_matches')}" for i, k in enumerate(KINDS))
    number = lambda *names: ", ".join(str(KINDS.index(n)) for n in names)
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH e AS ({each}),
p AS (
  SELECT *, sum(length(piece) + length(match)) OVER (PARTITION BY doc_id, text, kind ORDER BY place) AS stop FROM e),
q AS (SELECT doc_id, text, kind, CAST(stop - length(match) AS BIGINT) AS start, stop FROM p WHERE CASE kind {holds} END),
r AS (
  SELECT *, max(CASE WHEN kind < {len(BASE)} THEN stop END) OVER (
    PARTITION BY doc_id, text ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM q),
s AS (SELECT * FROM r WHERE kind < {len(BASE)} OR reach IS NULL OR start >= reach),
f AS (
  SELECT *, bool_or(kind IN ({number("access", "weak_id")})) OVER w AS an_id,
    bool_or(kind IN ({number("assign", "hex", "weak_secret")})) OVER w AS a_secret,
    bool_or(kind IN ({number("endpoint")})) OVER w AS an_endpoint
  FROM s WINDOW w AS (PARTITION BY doc_id, text ORDER BY start RANGE BETWEEN {scope} PRECEDING AND {scope} FOLLOWING)),
k AS (
  SELECT DISTINCT doc_id, text, kind, start, {names}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS told FROM f
  WHERE kind < {len(BASE)} OR (kind = {number("weak_id")} AND a_secret) OR (kind = {number("weak_secret")} AND (an_id OR an_endpoint))
    OR (kind = {number("endpoint")} AND an_id AND a_secret)),
g AS (
  SELECT doc_id, text, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
    string_agg(told, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(told, ',' ORDER BY start, kind) AS told
  FROM k GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(told, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text = g.text
"""
