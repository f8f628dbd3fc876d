"""Operator 7: toxic documents by a learned lexicon and Levenshtein automata.

A lexicon of words and word stems is learned from labelled training texts.  Scoring
intersects a Levenshtein automaton with the lexicon's trie: the states of the
intersection are sets of (trie node, edits so far), made when first reached, so a word is
matched against the whole lexicon in one walk over its letters, misspelled forms
included.  A context window around each hit tells quotation from abuse.  Each kind of hit
(term, exact or misspelled, quoted or not) carries evidence learned from the training
texts; a logistic regression over the sums of evidence and the number and density of hits
makes the score (a stem that clean texts hit now and then by chance, toxic ones hit often).

Scoring is one Arrow pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import column, settle

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Labelled rows that the lexicon is fitted on at most: a share of rows chosen by hash.
TRAIN_ROWS = 20_000
#: Stem lengths tried, least share of toxic training texts with a term, least precision (as a
#: multiple of the toxic share, and at least), and how much of a stem's support a longer
#: one must keep to replace it.
STEMS = (3, 4, 5, 6, 7, 8)
SUPPORT, LIFT, PRECISION, SAME = 0.02, 3.0, 0.4, 0.95
LEAST_TEXTS = 4
#: Edits allowed in a term, by its length.
EDITS = ((5, 1), (0, 0))
#: Characters of context around a hit, quotation marks and words that report speech.
CONTEXT = 40
QUOTES = "\"“”«»„‟"
REPORTING = frozenset("said says saying called calling quote quoted wrote word term insult sagte nannte dit dijo llamó".split())
#: Texts with and without the label that evidence starts from, by (misspelled, quoted).
PSEUDO = {(False, False): (1.0, 0.5), (True, False): (2.0, 1.0), (False, True): (1.0, 3.0), (True, True): (1.0, 6.0)}
#: States kept by an automaton before it starts afresh.
MAX_STATES = 10_000


def allowed_edits(term: str) -> int:
    return next(e for n, e in EDITS if len(term) >= n)


class LexiconAutomaton:
    """Trie of terms met with Levenshtein automata; a term ending in ``*`` is a stem.

    ``match(word)`` gives ``(term, edits)`` with the fewest edits, or None.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool] | None] = [None]
        self.budget: list[int] = [0]  # most edits that any term below a node allows
        for term in sorted(terms):
            node, letters = 0, term.removesuffix("*")
            edits = allowed_edits(letters)
            self.budget[0] = max(self.budget[0], edits)
            for ch in letters:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.budget.append(0)
                node = self.children[node][ch]
                self.budget[node] = max(self.budget[node], edits)
            if self.ends[node] is None or term.endswith("*"):
                self.ends[node] = (term, term.endswith("*"))
        self._restart()

    def _restart(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.best: list[tuple[tuple[str, int] | None, tuple[str, int] | None]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:  # a term's letter may be missing in the word
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.budget[child] and nodes.get(child, 99) > edits + 1:
                    nodes[child] = edits + 1
                    todo.append((child, edits + 1))
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            whole = stem = None
            for node, edits in key:
                end = self.ends[node]
                if end and edits <= allowed_edits(end[0].removesuffix("*")):
                    hit = (edits, end[0])
                    whole = min(whole or hit, hit)
                    if end[1]:
                        stem = min(stem or hit, hit)
            turn = lambda h: h and (h[1], h[0])
            self.best.append((turn(whole), turn(stem)))
        return self.ids[key]

    def _step(self, state: int, ch: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node, edits):
            if edits <= self.budget[node] and nodes.get(node, 99) > edits:
                nodes[node] = edits

        for node, edits in self.states[state]:
            for letter, child in self.children[node].items():
                reach(child, edits + (letter != ch))
            if node:  # an extra letter inside a term
                reach(node, edits + 1)
        to = self._state(nodes) if nodes else -1
        self.next[state][ch] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        if len(self.states) > MAX_STATES:
            self._restart()
        state, stem = self.start, None
        for ch in word:
            to = self.next[state].get(ch)
            state = self._step(state, ch) if to is None else to
            if state < 0:
                return stem
            found = self.best[state][1]
            if found and (stem is None or found[1] < stem[1]):
                stem = found
        whole = self.best[state][0]
        return min((h for h in (whole, stem) if h), key=lambda h: h[1], default=None)


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit shows quotation: marks on both sides, or a word that
    reports speech shortly before it."""
    left, right = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    marks = max((left.rfind(q) for q in QUOTES), default=-1)
    inside = marks >= 0 and any(q in right for q in QUOTES) and "\n" not in left[marks:]
    return inside or any(w in REPORTING for w in _WORD.findall(left)[-3:])


@dataclass
class Lexicon:
    """Terms, training texts with and without the label by kind of hit, and the regression.

    ``seen[term, misspelled, quoted] = (toxic, clean)``; without ``weights`` (nothing to
    learn from) every text scores ``share``.
    """

    terms: list[str]
    seen: dict[tuple[str, bool, bool], tuple[int, int]] = field(default_factory=dict)
    weights: list[float] | None = None
    intercept: float = 0.0
    share: float = 0.0

    def scorer(self) -> Scorer:
        return Scorer(self)

    def evidence(self, kind: tuple[str, bool, bool], label: int | None = None) -> float:
        """Log odds of a kind of hit; a training text does not count itself."""
        toxic, clean = self.seen.get(kind, (0, 0))
        if label is not None:
            toxic, clean = max(0, toxic - label), max(0, clean - (1 - label))
        a0, b0 = PSEUDO[kind[1:]]
        return math.log((toxic + a0) / (clean + b0))


#: Features of a text for the regression.
FEATURES = ("evidence", "strongest", "hits", "density", "forms")


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton, self.known = lexicon, LexiconAutomaton(lexicon.terms), {}

    def _match(self, word: str):
        if word not in self.known:
            if len(self.known) > 50_000:  # a bounded memory of words seen
                self.known = {}
            self.known[word] = self.automaton.match(word)
        return self.known[word]

    def hits(self, text: str | None) -> tuple[Counter, int, int]:
        """Hits of a whole text by ``(term, misspelled, quoted)``, word forms hit, words."""
        low, out = (text or "").lower(), Counter()
        words = _WORD.findall(low)
        found = {w: h for w in set(words) if (h := self._match(w))}
        if found:
            for m in _WORD.finditer(low):
                if hit := found.get(m.group()):
                    out[hit[0], hit[1] > 0, quoted(low, *m.span())] += 1
        return out, len(found), len(words)

    def features(self, text: str | None, label: int | None = None) -> list[float]:
        hits, forms, n_words = self.hits(text)
        if not hits:
            return [0.0] * len(FEATURES)
        said = {k: self.lexicon.evidence(k, label) for k in hits}
        n = sum(hits.values())
        return [sum(said[k] * (1 + math.log(c)) for k, c in hits.items()), max(said.values()),
                math.log1p(n), math.log1p(100 * n / n_words), math.log1p(forms)]

    def score(self, text: str | None) -> float:
        """0 to 1, higher where the label is likelier."""
        if self.lexicon.weights is None:
            return self.lexicon.share
        logit = self.lexicon.intercept + sum(
            w * x for w, x in zip(self.lexicon.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_texts(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic``: labelled texts to learn from, at most about ``train_rows``.

    Rows are chosen by a hash of their id.  Copies would count a passage many times, so
    texts that share the least of their three-word hashes (under either of two hashes)
    count once: that of the least id, then the least text.  An id with several labels has the
    least of them.  So the same rows are chosen however the tables are split.
    """
    known = labels.select(column(labels, "doc_id").alias("__id"), column(labels, "toxic").alias("__toxic")) \
        .where("__toxic IS NOT NULL AND __id IS NOT NULL")
    known = known.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.min("__toxic").alias("__toxic"))
    n = known.count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    slim = docs.select(column(docs, "doc_id").alias("doc"), column(docs, "text").alias("text")).where("text IS NOT NULL")
    # bounded by train_rows: 16 bytes each
    texts = slim.join(F.broadcast(known), F.col("doc") == F.col("__id")).select("doc", "text", F.col("__toxic").alias("toxic"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD.pattern), F.lit(0))
    texts = texts.withColumn("w", words)
    for seed in (1, 2):
        least = F.array_min(F.transform("w", lambda x, i: F.xxhash64(F.lit(seed), x, F.get("w", i + 1), F.get("w", i + 2))))
        keyed = texts.withColumn("k", F.coalesce(least, F.xxhash64("text")))
        texts = keyed.groupBy("k").agg(F.min(F.struct("doc", "text", "toxic", "w")).alias("row")).select("row.*")
    return texts.select("text", "toxic", F.array_distinct("w").alias("words"))


def learn_terms(train: DataFrame) -> list[str]:
    """Words, and stems written ``stem*``, that mark toxic training texts."""
    n = train.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    least = max(LEAST_TEXTS, math.ceil(SUPPORT * (n.toxic or 0)))
    precision = max(PRECISION, min(0.9, LIFT * (n.toxic or 0) / max(1, n["all"])))
    stems = lambda w: [F.when(F.length(w) >= k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    forms = F.array_distinct(F.flatten(F.transform("words", lambda w: F.array(w, *stems(w)))))
    counted = (train.select("toxic", F.explode(forms).alias("t")).where("length(t) >= 3")
               .groupBy("t").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
               .where((F.col("a") >= least) & (F.col("a") >= precision * (F.col("a") + F.col("b")))))
    support = {r.t: (r.a, r.a / (r.a + r.b)) for r in counted.collect()}  # bounded by the training rows
    children: dict[str, list[str]] = {}
    for t in support:
        letters = t.removesuffix("*")
        children.setdefault(letters if not t.endswith("*") else letters[:-1], []).append(t)

    def refined(stem: str) -> str:
        """A longer form that keeps the support says it more precisely."""
        while True:
            longer = [t for t in children.get(stem[:-1], ()) if support[t][0] >= SAME * support[stem][0]
                      and support[t][1] >= support[stem][1]]
            if not longer:
                return stem
            best = max(longer, key=lambda t: (support[t][1], t.endswith("*"), t))
            if not best.endswith("*"):
                return best
            stem = best

    chosen: list[str] = []
    for term in sorted((t for t in support if t.endswith("*")), key=lambda t: (len(t), t)):
        if not any(c.endswith("*") and term.startswith(c[:-1]) for c in chosen):
            chosen.append(refined(term))
    stems_of = tuple(c[:-1] for c in chosen if c.endswith("*"))
    words = [t for t in support if not t.endswith("*") and not t.startswith(stems_of or ("\0",))]
    return sorted({*chosen, *words})


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Lexicon, evidence and regression from the training texts (at most about
    ``train_rows``).  Without texts of both labels there is nothing to learn."""
    train = settle(training_texts(docs, labels, train_rows).withColumn("toxic", F.col("toxic").cast("long")))
    sums = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    lexicon = Lexicon([], share=sums.get(1, 0) / max(1, sum(sums.values())))
    if not (sums.get(0) and sums.get(1)):
        return lexicon
    lexicon.terms = learn_terms(train)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = lexicon.scorer()
        for batch in batches:
            rows = [(*k, y) for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True)
                    for k in scorer.hits(t)[0]]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.bool_(), pa.int64()), strict=True)],
                ["term", "fuzzy", "quoted", "toxic"])

    seen = train.select("text", "toxic").mapInArrow(kinds, "term string, fuzzy boolean, quoted boolean, toxic long")
    counted = seen.groupBy("term", "fuzzy", "quoted").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    lexicon.seen = {(r.term, r.fuzzy, r.quoted): (r.a, r.b) for r in counted.collect()}  # a few rows per term

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = lexicon.scorer()
        for batch in batches:
            labels = batch.column("toxic").to_pylist()
            xs = [scorer.features(t, y) for t, y in zip(batch.column("text").to_pylist(), labels, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["x", "label"])

    rows = settle(train.select("text", "toxic").mapInArrow(featured, "x array<double>, label double"))
    # In one order (there are at most about train_rows rows of a few numbers): sums of doubles depend on it.
    ordered = rows.repartition(1).sortWithinPartitions("x", "label")
    model = LogisticRegression(regParam=0.001, maxIter=100).fit(ordered.select(array_to_vector("x").alias("features"), "label"))
    lexicon.weights, lexicon.intercept = [float(w) for w in model.coefficients], float(model.intercept)
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns plus ``score`` of each whole text; null and empty texts get the base."""
    kept = [c for c in keep if c != "score"]
    slim = docs.select(*[column(docs, c) for c in kept], column(docs, text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = lexicon.scorer()
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())],
                                             [*batch.schema.names[:-1], "score"])

    schema = slim.select(*[column(slim, c) for c in kept], F.lit(0.0).alias("score")).schema
    return slim.mapInArrow(run, schema)
