"""License scans: an Aho-Corasick automaton finds tags and notices, a shunting-yard parser evaluates license expressions.

A text becomes its words in lower case, joined by single spaces, and one automaton run over them finds every place of every
notice phrase and of every tag.  Where a tag such as ``SPDX-License-Identifier:`` stands, the rest of its line, up to the end of a comment, is an
expression of license ids, ``AND``, ``OR``, ``WITH`` and brackets.  The parser keeps one stack of operators and one of
values: a value is how free a license is (4 permissive, 3 weak copyleft, 2 strong copyleft, 1 restricted or unknown), an ``AND``
is the smaller of two values, an ``OR`` the larger, and an exception after ``WITH`` lifts strong copyleft to weak.
An expression counts only if all of it is one; its ids give labels by family.

``score`` is a quarter of the smallest value of the text's notices and expressions, for all of them bind: 1 for permissive licenses
alone, 0 where nothing is found.  Each text is read by itself, in one pass, so nothing is shuffled.

Defined cases: a null or empty text has no word, no label and score 0, and so does one without a license; words have no
bound in length, and a long text costs time and memory in line with its length; phrases may overlap and count each; repeated rows
are scanned each; a null doc_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import has_columns, slices, table, texts_of


class Phrase(NamedTuple):
    words: str
    label: str
    value: int
    base: bool = False


# The phrases and labels of the base, then those of the method; tags; families of license ids by their beginnings.
PHRASES = (
    Phrase("gnu general public license", "gpl", 2, True),
    Phrase("apache license", "apache", 4, True),
    Phrase("cc by", "cc-by", 4, True),
    Phrase("mit license", "mit", 4, True),
    Phrase("gnu lesser general public license", "lgpl", 3),
    Phrase("gnu library general public license", "lgpl", 3),
    Phrase("gnu affero general public license", "agpl", 2),
    Phrase("mozilla public license", "mpl", 3),
    Phrase("eclipse public license", "epl", 3),
    Phrase("bsd license", "bsd", 4),
    Phrase("redistribution and use in source and binary forms", "bsd", 4),
    Phrase("permission is hereby granted free of charge", "mit", 4),
    Phrase("isc license", "isc", 4),
    Phrase("boost software license", "bsl", 4),
    Phrase("creative commons attribution", "cc-by", 4),
    Phrase("creative commons zero", "cc0", 4),
    Phrase("cc by sa", "cc-by-sa", 3),
    Phrase("cc by nc", "cc-by-nc", 1),
    Phrase("cc by nd", "cc-by-nd", 1),
    Phrase("all rights reserved", "reserved", 1),
)
TAGS = ("spdx-license-identifier:", "license-expression:")
FAMILIES = (
    ("agpl", "agpl", 2),
    ("lgpl", "lgpl", 3),
    ("gpl", "gpl", 2),
    ("apache", "apache", 4),
    ("mit", "mit", 4),
    ("bsd", "bsd", 4),
    ("0bsd", "bsd", 4),
    ("mpl", "mpl", 3),
    ("epl", "epl", 3),
    ("isc", "isc", 4),
    ("bsl", "bsl", 4),
    ("cc0", "cc0", 4),
    ("cc-by-nc", "cc-by-nc", 1),
    ("cc-by-nd", "cc-by-nd", 1),
    ("cc-by-sa", "cc-by-sa", 3),
    ("cc-by", "cc-by", 4),
    ("unlicense", "unlicense", 4),
    ("zlib", "zlib", 4),
)
#: Ends of comments, and what else may stand between an expression and its line's end.
CLOSED = r"-->|\*/"
AFTER = " \t*/#>-\"';,."
OTHER = ("other", 1)
LIFTED = 3

#: Bytes of words stay, letters in lower case; all others become a space.
_KEPT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))
_SPACES = re.compile(rb" {2,}")
_TOKEN = re.compile(r"[()]|[^ \t()]+")
_ID = re.compile(r"[a-z0-9][a-z0-9.+:-]*")
_LINE = re.compile(r"[^\r\n]*")
_CLOSED = re.compile(CLOSED)
_NOT_WORD = re.compile(r"[^0-9a-z]+")
#: Operators and how tightly they bind.
BINDS = {"or": 1, "and": 2}


def family(license_id: str) -> tuple[str, int]:
    """Label and value of a license id in lower case."""
    return next(((label, value) for start, label, value in FAMILIES if license_id.startswith(start)), OTHER)


def evaluated(expression: str) -> tuple[frozenset[str], int] | None:
    """Labels and value of a license expression; None if it is not one."""
    values: list[int] = []
    waiting: list[str] = []
    labels: set[str] = set()
    operand, plain = True, False  # is an operand due; was the last token a license id

    def apply() -> None:
        b, a = values.pop(), values.pop()
        values.append(min(a, b) if waiting.pop() == "and" else max(a, b))

    tokens = _TOKEN.finditer(expression.encode().lower().decode())  # A-Z alone
    for m in tokens:
        t = m.group()
        if t == "(":
            if not operand:
                return None
            waiting.append(t)
        elif t == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                apply()
            if not waiting:
                return None
            waiting.pop()
            plain = False
        elif t in BINDS:
            if operand:
                return None
            while waiting and BINDS.get(waiting[-1], 0) >= BINDS[t]:
                apply()
            waiting.append(t)
            operand, plain = True, False
        elif t == "with":
            exception = next(tokens, None)
            if not plain or exception is None or exception.group() in ("and", "or", "with") or _ID.fullmatch(exception.group()) is None:
                return None
            values[-1] = LIFTED if values[-1] == LIFTED - 1 else values[-1]
            plain = False
        else:
            if not operand or _ID.fullmatch(t) is None:
                return None
            label, value = family(t)
            labels.add(label)
            values.append(value)
            operand, plain = False, True
    if operand or "(" in waiting:
        return None
    while waiting:
        apply()
    return frozenset(labels), values[0]


class Scanner:
    """The automaton over words; its phrases begin and end with a space, which stands around every word."""

    def __init__(self, phrases: tuple[Phrase, ...], tags: tuple[str, ...]) -> None:
        import ahocorasick

        self.phrases, self.tags = phrases, tags
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list[int]] = {}
        for i, words in enumerate([*(p.words for p in phrases), *(_NOT_WORD.sub(" ", t).strip() for t in tags)]):
            held.setdefault(f" {words} ", []).append(i)
        for words, numbers in held.items():
            self.automaton.add_word(words, (len(words), numbers))
        if held:
            self.automaton.make_automaton()

    def __call__(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[frozenset[str], int]]]:
        """Number of words, (phrase, first word) of each place, and what each expression says."""
        words = _SPACES.sub(b" ", b" " + text.translate(_KEPT) + b" ")
        n = words.count(b" ") - 1
        found, tagged = [], set()
        for end, (size, numbers) in self.automaton.iter(words.decode("latin-1")) if len(self.automaton) else ():
            for i in numbers:
                if i < len(self.phrases):
                    found.append((i, end - size + 1))
                else:
                    tagged.add(self.tags[i - len(self.phrases)])
        places = []
        if found:
            spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
            at = np.searchsorted(spaces, [start for _, start in found]).tolist()
            places = [(i, w) for (i, _), w in zip(found, at, strict=True)]
        said = []
        if tagged:
            low = text.lower().decode()
            for tag in sorted(tagged):
                at = low.find(tag)
                while at >= 0:
                    line = _LINE.match(low, at + len(tag)).group()
                    if one := evaluated(_CLOSED.split(line, maxsplit=1)[0].rstrip(AFTER)):
                        said.append(one)
                    at = low.find(tag, at + len(tag))
        return n, places, said


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, phrases: tuple[Phrase, ...] = PHRASES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """doc_id, number of words, places of base phrases, labels and score, for every row of ``docs`` (doc_id, text)."""
    has_columns(docs, "doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(phrases, tags)
        for batch in slices(batches, "text"):
            rows = []
            for text in texts_of(batch, "text"):
                n, places, said = scan(text or b"")
                base = [w for i, w in places if phrases[i].base]
                labels = {phrases[i].label for i, _ in places}.union(*(s for s, _ in said))
                values = [*(phrases[i].value for i, _ in places), *(v for _, v in said)]
                base_labels = ",".join(sorted({phrases[i].label for i, _ in places if phrases[i].base}))
                rows.append((n, len(base), min(base, default=None), max(base, default=None), base_labels, ",".join(sorted(labels)), min(values, default=0) / 4))
            columns = zip(*rows, strict=True)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCHEMA)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Phrases by slices of the list of words; expressions by rewriting brackets and pairs until one value is left."""
    most = max(len(p.words.split()) for p in PHRASES)
    words = lambda p: " AND ".join(f"w{k} = '{w}'" for k, w in enumerate(p.words.split()))
    phrase = "\n  UNION ALL ".join(f"SELECT r, '{p.label}' AS label, {p.value} AS value, {p.base} AS base, pos FROM next WHERE {words(p)}" for p in PHRASES)
    label = " ".join(f"WHEN starts_with(x, '{s}') THEN '{k}'" for s, k, _ in FAMILIES)
    value = " ".join(f"WHEN starts_with(y, 'L{s}') THEN '{v}'" for s, _, v in FAMILIES)
    hint = "|".join(sorted({p.words.split()[-1] for p in PHRASES}))
    tag = "|".join(TAGS)
    step = "s"
    for v in (1, 2, 3, 4):
        step = f"regexp_replace({step}, '{v}&[{v}-4]|[{v}-4]&{v}', '{v}', 'g')"
    for v in (4, 3, 2, 1):
        step = f"regexp_replace({step}, '\\((?:[1-{v}]\\|)*{v}(?:\\|[1-{v}])*\\)', '{v}', 'g')"
    after = AFTER.replace("'", "''").replace("\t", "")
    return f"""
WITH RECURSIVE t AS (
  SELECT *, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
), word AS (
  SELECT r, unnest(w) AS w0, unnest(range(0, len(w))) AS pos FROM t WHERE regexp_matches(text, '{hint}')
), next AS (
  SELECT r, pos, w0, {", ".join(f"lead(w0, {k}) OVER o AS w{k}" for k in range(1, most))} FROM word WINDOW o AS (PARTITION BY r ORDER BY pos)
), hit AS (
  {phrase}
), line AS (
  SELECT r, unnest(regexp_extract_all(text, '(?:{tag})([^\\r\\n]*)', 1)) AS e FROM t WHERE regexp_matches(text, '{tag}')
), token AS (
  SELECT row_number() OVER () AS q, r, regexp_extract_all(rtrim(regexp_replace(e, '(?:{CLOSED}).*', ''), '{after}' || chr(9)), '[()]|[^ \\t()]+') AS x FROM line
), named AS (
  SELECT q, r, list_transform(range(1, len(x) + 1), lambda k: CASE
    WHEN x[k] IN ('(', ')') THEN x[k] WHEN x[k] = 'and' THEN '&' WHEN x[k] = 'or' THEN '|' WHEN x[k] = 'with' THEN 'W'
    WHEN NOT regexp_full_match(x[k], '[a-z0-9][a-z0-9.+:-]*') THEN '?' WHEN k > 1 AND x[k - 1] = 'with' THEN 'E' ELSE 'L' || x[k] END) AS x FROM token
), valued AS (
  SELECT q, r, x, '(' || list_aggregate(list_transform(x, lambda y: CASE WHEN y[1] <> 'L' THEN y {value} ELSE '{OTHER[1]}' END), 'string_agg', '') || ')' AS s FROM named
), step AS (
  SELECT q, r, x, regexp_replace(regexp_replace(s, '{LIFTED - 1}WE', '{LIFTED}', 'g'), '([1-4])WE', '\\1', 'g') AS s, 0 AS k FROM valued
  UNION ALL SELECT q, r, x, {step} AS s, k + 1 FROM step WHERE {step} <> s
), said AS (
  SELECT r, x, s::INT AS value FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY q ORDER BY k DESC) = 1) WHERE regexp_full_match(s, '[1-4]')
), ids AS (
  SELECT r, value, substr(y, 2) AS x FROM (SELECT r, value, unnest(x) AS y FROM said) WHERE y[1] = 'L'
), every AS (
  SELECT r, label, value, base, pos FROM hit UNION ALL SELECT r, CASE {label} ELSE '{OTHER[0]}' END, value, false, NULL FROM ids
), per AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(value) / 4.0::DOUBLE AS score
  FROM every GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM t LEFT JOIN per USING (r)
"""


QUERIES = {"op12_license_scan": op12_license_scan}
ORACLE_SQL = {"op12_license_scan": _oracle()}
