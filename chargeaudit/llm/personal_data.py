"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans come from four patterns.  The field then labels words: its nodes are the words with a digit or an
at-sign and their neighbours, its chain edges join nodes that follow each other, and its skip edges join a word
with the one before it and the first one in the document that are equal or similar (the same digits, the same name
or host of an address), so any two of them are two links apart, however far.  Loopy sum-product message passing makes
the labels of such words agree: words of base spans keep their kinds, and words whose marginal for a kind is at
least ``sure`` and that touch no base span are added as spans.  Messages are passed until they stand still, ROUNDS times at most.

Weights are fitted by pseudo-likelihood on at most ``sample`` documents of at most ``nodes`` nodes each, those with
the smallest hash of doc_id, whose labels are the base spans; unlabelled words that are linked with a labelled one have an
unknown label there, for they may be what the patterns miss.  So that the field does not merely repeat the patterns, a
word's own features are coarse, such as how many digits it has, and leave out the forms that the patterns ask for; what
is left are these, the context and the labels along the edges.  Documents without a digit or at-sign have no node and no span.

Spans count code points; ends are exclusive.  Defined cases: a null text is empty; a long text or an unbroken run of characters
costs time in line with its length; a null doc_id stays null; repeated rows are scanned each; where no document has a node nothing is fitted and only base spans are found; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import has_columns, slices, table

# The kinds, in the order of their listing.
KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on at most, and the nodes of one of them.
SAMPLE = 1000
SAMPLE_NODES = 2000
SURE = 0.95
BUCKETS = 4096
ROUNDS = 50
#: The change of a message below which it stands still, and the score of a label that is known.
STILL = 1e-3
KNOWN = 30.0
#: What a skip edge gives to equal labels where the sample says nothing of it.
AGREE = 4.0
LABELS = len(KINDS) + 1

# the parts of an address; each run of a name's characters is read once, with or without an at-sign behind it
_NAME = re.compile(r"[A-Za-z0-9._%+-]++(@?)")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a number's first digit cannot follow a digit: from inside a number the rest of the pattern fails as from its start
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Places of addresses, leftmost and apart; what is left of a run behind an address may be the next one's name."""
    at = 0
    while m := _NAME.search(text, at):
        at = m.end()
        if m.group(1) and (host := _HOST.match(text, at)):
            at = host.end()
            yield m.start(), at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, *span) for span in addresses(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_DIGITS.findall(m.group()))
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    return out


def shape(word: str) -> str:
    return _DIGITS.sub("0", _LETTERS.sub("a", word))[:24]


def keys(word: str) -> list[str]:
    """What makes two words similar."""
    digits = "".join(_DIGITS.findall(word))
    out = ["w" + word.strip(".,;:!?()[]\"'").lower()]
    if len(digits) >= 4:
        out.append("d" + digits)
    if "@" in word:
        name, _, host = word.lower().partition("@")
        out += ["n" + name, "h" + host]
    return out


def features(words: list[str], i: int) -> list[int]:
    word = words[i]
    digits = "".join(_DIGITS.findall(word))
    before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
    named = (
        "b",
        f"n{len(digits) if len(digits) < 8 else len(digits) // 4 * 4}",
        f"k{'@' in word}{'+' in word}{bool(digits)}{bool(_LETTERS.search(word))}",
        f"d{'@' in word or word.strip('.,;:!?()').count('.')}",
        f"l{16 <= len(digits) <= 19 and luhn(digits)}",
        "p" + shape(before),
        "f" + shape(after),
        "v" + before.lower() if before.isalpha() else "v",
    )
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in named]


class Graph:
    """Nodes, edges and weak labels of one document."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]) -> None:
        found = list(_WORD.finditer(text))
        words = [m.group() for m in found]
        hit = [i for i, w in enumerate(words) if _HINT.search(w)]
        at = sorted({j for i in hit for j in (i - 1, i, i + 1) if 0 <= j < len(words)})
        self.places = [found[i].span() for i in at]
        self.features = [features(words, i) for i in at]
        self.chain = [(n, n + 1) for n in range(len(at) - 1) if at[n] + 1 == at[n + 1]]
        self.skip: list[tuple[int, int]] = []
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        marked = set(hit)
        for n, i in enumerate(at):
            if i in marked:
                for k in keys(words[i]):
                    self.skip += {(seen[k], n) for seen in (first, last) if k in seen}
                    first.setdefault(k, n)
                    last[k] = n
        self.skip = sorted(set(self.skip) - set(self.chain))
        self.labels = [0] * len(at)
        ordered, j = sorted((a, b, k) for k, a, b in spans), 0
        for n, (a, b) in enumerate(self.places):
            while j < len(ordered) and ordered[j][1] <= a:
                j += 1
            if j < len(ordered) and ordered[j][0] < b:
                self.labels[n] = ordered[j][2] + 1

    def known(self) -> list[int]:
        """The labels to learn from: -1 for an unlabelled word that a skip edge links with a labelled one."""
        out = list(self.labels)
        for a, b in self.skip:
            for x, y in ((a, b), (b, a)):
                if self.labels[x] and not self.labels[y]:
                    out[y] = -1
        return out


Weights = tuple[np.ndarray, np.ndarray, np.ndarray]


def fitted(rows: list, rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Weights | None:
    """Weights of features, chain edges and skip edges, by gradient steps on the pseudo-likelihood."""
    numbers = lambda r, c: np.frombuffer(r[c], np.int32).astype(np.int64)
    sizes = [len(r["labels"]) // 4 for r in rows]
    if not sum(sizes):
        return None
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    x = np.concatenate([numbers(r, "features") for r in rows]).reshape(sum(sizes), -1)
    y = np.concatenate([numbers(r, "labels") for r in rows])
    edges = [np.concatenate([numbers(r, e).reshape(-1, 2) + b for r, b in zip(rows, base, strict=True)]) for e in ("chain", "skip")]
    one = np.vstack([np.eye(LABELS), np.zeros(LABELS)])[y]  # -1, unknown, has the last row
    told = (y >= 0)[:, None]
    rest = [np.zeros((LABELS, LABELS)), AGREE * np.eye(LABELS)]  # what edges weigh where nothing is told of them
    w, pair = np.zeros((BUCKETS, LABELS)), [p.copy() for p in rest]
    gw, gp = np.full_like(w, 1e-8), [np.full_like(p, 1e-8) for p in pair]
    for _ in range(rounds):
        score = w[x].sum(axis=1)
        for (a, b), p in zip((e.T for e in edges), pair, strict=True):
            np.add.at(score, b, one[a] @ p)
            np.add.at(score, a, one[b] @ p.T)
        prob = np.exp(score - score.max(axis=1, keepdims=True))
        error = (one - prob / prob.sum(axis=1, keepdims=True)) * told
        step = -decay * w * len(y) / 100
        for f in range(x.shape[1]):
            np.add.at(step, x[:, f], error)
        gw += step * step
        w += rate * step / np.sqrt(gw)
        for i, (a, b) in enumerate(e.T for e in edges):
            step = one[a].T @ error[b] + (one[b].T @ error[a]).T - decay * (pair[i] - rest[i]) * len(y) / 100
            if i:
                step = (step + step.T) / 2  # a skip edge has no direction
            gp[i] += step * step
            pair[i] += rate * step / np.sqrt(gp[i])
    return w.astype(np.float32), pair[0], pair[1]


def marginals(graphs: list[Graph], weights: Weights, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Label probabilities of each graph's nodes, by loopy sum-product over all graphs at once."""
    w, chain, skip = weights
    sizes = [len(g.labels) for g in graphs]
    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    score = w[np.array([f for g in graphs for f in g.features], np.int64)].sum(axis=1).astype(np.float64)
    pairs, tables = [], []
    for name, weight in (("chain", chain), ("skip", skip)):
        e = np.array([(a + b, c + b) for g, b in zip(graphs, base, strict=False) for a, c in getattr(g, name)], np.int64).reshape(-1, 2)
        pairs += [e, e[:, ::-1]]
        tables += [np.broadcast_to(weight, (len(e), LABELS, LABELS)), np.broadcast_to(weight.T, (len(e), LABELS, LABELS))]
    counts = [len(p) for p in pairs]
    both, table_of = np.concatenate(pairs), np.exp(np.concatenate(tables))
    labels = np.concatenate([np.array(g.labels, np.int64) for g in graphs])
    score[labels > 0, labels[labels > 0]] += KNOWN
    # message i goes along both[i]; the one that answers it stands in the other half of its kind
    c, s = counts[0], counts[2]
    back = np.concatenate([np.arange(c, 2 * c), np.arange(c), 2 * c + np.arange(s, 2 * s), 2 * c + np.arange(s)]).astype(np.int64)
    message = np.zeros((len(both), LABELS))
    owner = np.searchsorted(base, both[:, 0], side="right") - 1
    moving = np.ones(len(graphs), bool)
    for _ in range(rounds if len(both) else 0):
        belief = score.copy()
        np.add.at(belief, both[:, 1], message)
        out = belief[both[:, 0]] - message[back]
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.einsum("ei,eij->ej", np.exp(out - top), table_of) + 1e-300)
        new -= new.max(axis=1, keepdims=True)
        step = np.zeros(len(graphs))
        np.maximum.at(step, owner, np.abs(new - message).max(axis=1))
        on = moving[owner]
        message[on] = 0.5 * message[on] + 0.5 * new[on]
        moving &= step >= STILL  # each document stops by itself
        if not moving.any():
            break
    np.add.at(score, both[:, 1], message)
    prob = np.exp(score - score.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    return [prob[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


def added_spans(text: str, graph: Graph, prob: np.ndarray, spans: list[tuple[int, int, int]], sure: float) -> list[tuple[int, int, int]]:
    """Runs of neighbouring words of one sure kind that touch no base span; signs at their ends are left out."""
    out: list[tuple[int, int, int]] = []
    label = np.where(prob.max(axis=1) >= sure, prob.argmax(axis=1), 0)
    taken = [g > 0 for g in graph.labels]
    follows = {b for _, b in graph.chain}
    n = 0
    while n < len(label):
        if label[n] and not taken[n] and _HINT.search(text, *graph.places[n]):
            m = n
            while m + 1 < len(label) and label[m + 1] == label[n] and m + 1 in follows and not taken[m + 1] and _HINT.search(text, *graph.places[m + 1]):
                m += 1
            a, b = graph.places[n][0], graph.places[m][1]
            word = text[a:b]
            a, b = a + len(word) - len(word.lstrip(".,;:!?\"'")), b - len(word) + len(word.rstrip(".,;:!?\"'"))
            out.append((int(label[n]) - 1, a, b))
            n = m
        n += 1
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, nodes: int = SAMPLE_NODES) -> Weights | None:
    """The field's weights from a bounded sample of ``docs``."""
    hinted = docs.filter(F.col("text").rlike("[0-9@]"))
    ids = hinted.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    chosen = hinted.join(F.broadcast(ids), "doc_id", "left_semi")  # at most ``sample`` rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            graphs = [Graph(t, base_spans(t)) for t in batch.column("text").to_pylist()]
            graphs = [g for g in graphs if len(g.labels) <= nodes]
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.array(c, np.int32).tobytes() for c in column], pa.binary()) for column in ([g.features for g in graphs], [g.known() for g in graphs], [g.chain for g in graphs], [g.skip for g in graphs])], names=["features", "labels", "chain", "skip"]
            )

    schema = "features binary, labels binary, chain binary, skip binary"
    return fitted(chosen.select("text").limit(sample).mapInArrow(work, schema).collect())


def joined_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, sample: int = SAMPLE, sure: float = SURE, nodes: int = SAMPLE_NODES) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans, for every row of ``docs`` (doc_id, text)."""
    has_columns(docs, "doc_id", "text")
    weights = fit(docs.select("doc_id", "text"), sample, nodes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            counts, digests, spans = np.zeros((len(texts), len(KINDS)), np.int64), [nothing] * len(texts), [""] * len(texts)
            hinted = [i for i, t in enumerate(texts) if t and _HINT.search(t)]
            base = {i: base_spans(texts[i]) for i in hinted}
            graphs = [Graph(texts[i], base[i]) for i in hinted]
            probs = marginals(graphs, weights) if weights and hinted else [None] * len(hinted)
            for i, graph, prob in zip(hinted, graphs, probs, strict=True):
                for k, _, _ in base[i]:
                    counts[i, k] += 1
                digests[i] = hashlib.sha256(joined_spans(base[i]).encode()).hexdigest()
                more = added_spans(texts[i], graph, prob, base[i], sure) if prob is not None else []
                spans[i] = joined_spans(sorted([*base[i], *more]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(counts[:, k]) for k in range(len(KINDS))], pa.array(digests), pa.array(spans)], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
            )

    schema = ", ".join(["doc_id long", *[f"n_{k} long" for k in KINDS], "base_sha256 string", "spans string"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op9_personal_data": op9_personal_data}
ORACLE_SQL: dict[str, str] = {}
