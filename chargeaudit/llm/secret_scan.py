"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression, and its Boolean trigram query, an OR of ANDs, is derived from the parsed expression
(``trigrams.query_of``).  The index has one posting (trigram, doc_id) for each trigram of some query that a text
holds; intersecting the postings of an AND and uniting the ORs gives the candidate documents of a rule, and the rule's
expression is run on those alone.  A rule whose expression has no mandatory trigram (runs of hex digits) scans every text.
Candidates are ids and a bit for each rule; while they are few they are sent to the texts, which then are not shuffled.

Spans count code points; ends are exclusive.  Defined cases: a null text is empty and has no span; many matches of a long text
cost little more than few, for positions are summed in pieces; rows with
a null ``doc_id`` cannot be posted and are scanned by every rule; rows that share a ``doc_id`` are candidates
together and are verified one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, has_columns, join_small, table
from .trigrams import ANY, query_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``least``: characters of the ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The kinds, in the order of their listing.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosttoken", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chattoken", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
MASK = "[SECRET]"


def query(rule: Rule) -> list[list[str]]:
    """The rule's Boolean trigram query: an OR of ANDs; empty if nothing is mandatory."""
    found = query_of(rule.pattern)
    return [] if found == ANY else sorted(map(sorted, found))


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(gram, doc_id) for each wanted trigram that a text holds, each pair once per row."""
    text = F.lower(F.col("text"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("t"), F.lit(g)), F.lit(g)) for g in wanted]))
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", text.alias("t")).select("doc_id", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and ``rules``, a bit for each rule whose trigram query the postings of the document satisfy.

    One grouping by document intersects all posting lists at once: the grams that meet there are those in
    whose lists the document stands, and an AND holds if none of its grams is missing.
    """
    queries = {i: q for i, q in enumerate(map(query, rules)) if q}
    wanted = sorted({g for ands in queries.values() for grams in ands for g in grams})
    lists = postings(docs, wanted).groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))  # at most len(wanted)

    def satisfied(ands: list[list[str]]) -> Column:
        one = [F.size(F.array_except(F.array(*map(F.lit, grams)), "grams")) == 0 for grams in ands]
        out = one[0]
        for x in one[1:]:
            out = out | x
        return out

    bits = F.lit(0).cast("long")
    for i, ands in queries.items():
        bits = bits.bitwiseOR(F.when(satisfied(ands), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return lists.select("doc_id", bits.alias("rules")).filter("rules <> 0")


SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def chunked(values: Column) -> Column:
    """An array cut into about as many pieces as each piece has values.

    A fold that appends copies what it has each time; over pieces, then inside each, its cost stays far below the square.
    """
    n = F.size(values)
    step = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda i: F.slice(values, i * step + 1, step)))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before(steps: Column, add) -> Column:
    """For each of an array of numbers what ``add`` makes of those before it, from 0 on."""
    kind = F.array().cast("array<int>")
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), kind.alias("out")), lambda a, x: F.struct(add(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]


def spans_of(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<start, ord, end, kind>> of the rule's matches that are long enough, leftmost and apart.

    The pieces between matches and the matches themselves add up to the positions.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    sized = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b")),
        lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["m"]).alias("n"), (F.length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.least).alias("ok")),
    )
    plus = lambda a, b: a + b

    def placed(piece: Column, at: Column) -> Column:
        starts = before(F.transform(piece, lambda x: x["b"] + x["n"]), plus)
        spans = F.transform(
            F.arrays_zip(piece.alias("x"), starts.alias("a")),
            lambda z: F.when(z["x"]["ok"], F.struct((at + z["a"] + z["x"]["b"]).alias("start"), F.lit(order).alias("ord"), (at + z["a"] + z["x"]["b"] + z["x"]["n"]).alias("end"), F.lit(rule.kind).alias("kind"))),
        )
        return F.array_compact(spans)

    def whole(pieces: Column) -> Column:
        starts = before(F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["b"] + x["n"])), plus)
        return F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), starts.alias("s")), lambda z: placed(z["p"], z["s"])))

    spans = once(sized, lambda s: once(chunked(s), whole))
    return F.when(text.rlike(rule.pattern), spans.cast(SPAN))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the column ``spans``: array<struct<start, ord, end, kind>>, sorted."""
    has_columns(docs, "doc_id", "text")
    own, asked = docs.columns, [bool(query(r)) for r in rules]
    text = F.coalesce(F.col("text"), F.lit(""))
    joined, bits = docs, F.lit(0).cast("long")
    if any(asked):
        found = cut(candidates(docs.select("doc_id", "text"), rules).withColumnsRenamed({"doc_id": "__secret_id", "rules": "__secret_rules"}))
        joined, bits = join_small(docs, found, docs["doc_id"] == found["__secret_id"], "left"), F.coalesce("__secret_rules", F.lit(0).cast("long"))
    parts = []
    for order, rule in enumerate(rules):
        spans = spans_of(rule, order, text)
        parts.append(F.when((bits.bitwiseAND(F.lit(1 << order)) != 0) | F.col("doc_id").isNull(), spans) if asked[order] else spans)
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    return joined.select(*[docs[c] for c in own], F.array_sort(F.concat(*[F.coalesce(p, empty) for p in parts])).alias("__secret_spans"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kinds(kinds: list[str]) -> Column:
    return F.filter("__secret_spans", lambda x: x["kind"].isin(kinds))


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans, and all spans."""
    base = [r.kind for r in rules if r.base]
    found = with_spans(docs.select("doc_id", "text"), rules)
    return found.select(
        "doc_id",
        *[F.size(of_kinds([k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined_spans(of_kinds(base)), 256).alias("base_sha256"),
        joined_spans(F.col("__secret_spans")).alias("spans"),
    )


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """The rows of ``docs`` with every span of their texts replaced by ``mask``; overlapping spans become one."""
    found = with_spans(docs, rules)
    text = F.col("text")
    top = lambda a, b: F.greatest(a, b)

    def cleaned(piece: Column, at: Column) -> Column:
        """What a piece of the spans makes of the text from ``at`` to its last end; each works on a text of its own, for finding a position costs what stands before it."""
        last = F.greatest(at, F.array_max(F.transform(piece, lambda x: x["end"])))
        own = F.substring(text, at + 1, last - at)
        reached = F.transform(before(F.transform(piece, lambda x: x["end"]), top), lambda a: F.greatest(a, at))
        part = lambda o: lambda z: F.when(z["x"]["start"] >= z["a"], F.concat(F.substring(o, z["a"] - at + 1, z["x"]["start"] - z["a"]), F.lit(mask)))
        return once(own, lambda o: F.array_join(F.transform(F.arrays_zip(piece.alias("x"), reached.alias("a")), part(o)), ""))

    def whole(pieces: Column) -> Column:
        starts = before(F.transform(pieces, lambda p: F.array_max(F.transform(p, lambda x: x["end"]))), top)
        return F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), starts.alias("s")), lambda z: cleaned(z["p"], z["s"])), "")

    end = F.array_max(F.transform("__secret_spans", lambda x: x["end"]))
    clean = F.concat(once(chunked(F.col("__secret_spans")), whole), F.substring(text, end + 1, F.length(text)))
    new = F.when(F.size("__secret_spans") == 0, text).otherwise(clean)
    return found.select(*[new.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    parts, selects = [], []
    for order, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"""k{order} AS (
  SELECT r, {order} AS ord, '{r.kind}' AS kind, i, m, b, length(regexp_extract(m, '{pattern}', {r.group})) >= {r.least} AS ok
  FROM (SELECT r, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(bs[: len(ms)]) AS b
        FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS bs FROM t WHERE regexp_matches(text, '{pattern}')))
)"""
        )
        selects.append(f"SELECT * FROM k{order}")
    return (
        "WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),\n"
        + ",\n".join(parts)
        + """,
p AS (
  SELECT *, sum(length(b) + length(m)) OVER (PARTITION BY r, ord ORDER BY i) AS e FROM ("""
        + " UNION ALL ".join(selects)
        + """)
), s AS (
  SELECT r, ord, kind, (e - length(m))::BIGINT AS a, e::BIGINT AS z FROM p WHERE ok
), g AS (
  SELECT r, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, ord) FILTER (ord <= 2), '') AS base,
         string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, ord) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g ON t.r = g.r
"""
    )


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLE_SQL = {"op8_secret_scan": _oracle()}
