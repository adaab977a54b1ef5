"""Operator 5: toxicity by fuzzy lexicon matching and context windows.

Lexicon: from at most ``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` labelled documents
(smallest hash of the id first; held-out rows are never used) the words and
word stems (the first 3 to 8 characters) that are much more frequent in toxic
documents, at most ``LEXICON_MOST``.

Matching: the lexicon is a trie; its intersection with a Levenshtein automaton
of distance 1 (terms of at least ``FUZZY_CHARS`` characters) is determinised as
it is used and run over the distinct words of each shard, all at once.

Context: a hit with quotation marks on both sides within ``WINDOW`` words is
a quotation, others count as abuse; hits near each other raise the local
density.  A logistic model over these document features, fitted on the same
sample, gives the score.

A row is held out if crc32(doc_id as text) mod 3 is 1 (a NULL id is not).

Cases: NULL and empty texts have no hits and get the model's score for that;
several labels of an id count as the largest; without rows of both labels the
score is 0; repeated rows give equal rows; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import textspans as S
from revlens.llm.language_id import LETTERS, fold

FOLDS, HELD = 3, 1
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 12_000
LEXICON_MOST = 2_000
STEM_CHARS = range(3, 9)
FUZZY_CHARS = 5
ODDS = 3.0
#: A term is in this share of the toxic documents of the sample at least.
SHARE_LEAST = 0.02
WINDOW = 3
THRESHOLD = 0.7
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, n_exact bigint, n_fuzzy bigint, n_quoted bigint"
FEATURES = ("any exact", "exact", "any fuzzy", "fuzzy", "quoted", "local density", "share of words")

#: What a word can be: nothing, near a stem, near a term, a stem's word, a term.
NONE, FUZZY_STEM, FUZZY_TERM, STEM, TERM = range(5)


class Matcher:
    """Levenshtein automaton (distance 1) x lexicon trie, determinised as used.
    ``terms`` are (text, whole): whole words or stems of words."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.child: list[dict[str, int]] = [{}]
        self.kind = [NONE]
        self.fuzzy = [False]            # some term below allows an edit
        for text, whole in terms:
            node, long = 0, len(text) >= FUZZY_CHARS
            self.fuzzy[0] |= long
            for c in text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.kind.append(NONE)
                    self.fuzzy.append(False)
                node = self.child[node][c]
                self.fuzzy[node] |= long
            self.kind[node] = max(self.kind[node], TERM if whole else STEM)
        self.long = [0] * len(self.child)
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            self.long[node] = depth
            stack += [(n, depth + 1) for n in self.child[node].values()]
        self.alphabet = np.array(sorted({ord(c) for ch in self.child for c in ch}), dtype=np.uint32)
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.accept: list[int] = []
        self.best: list[int] = []
        self.table = np.zeros((0, len(self.alphabet) + 1), dtype=np.int32)
        self.start = self._state({(0, 0)}, NONE)

    def _state(self, nodes: set, stem: int) -> int:
        """Number of a set of (node, edits); ``stem`` is the best stem passed.
        Leaving out letters of the term is closed over here."""
        todo = list(nodes)
        while todo:
            node, e = todo.pop()
            if e == 0:
                for n in self.child[node].values():
                    if self.fuzzy[n] and (n, 1) not in nodes and (n, 0) not in nodes:
                        nodes.add((n, 1))
                        todo.append((n, 1))
        nodes = {(n, e) for n, e in nodes if e == 0 or (n, 0) not in nodes}
        for n, e in nodes:
            if self.kind[n] == STEM and (e == 0 or self.long[n] >= FUZZY_CHARS):
                stem = max(stem, STEM if e == 0 else FUZZY_STEM)
        if stem == STEM:
            nodes = {(n, e) for n, e in nodes if e == 0}
        key = (tuple(sorted(nodes)), stem)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            whole = [TERM if e == 0 else FUZZY_TERM for n, e in nodes if self.kind[n] == TERM and (e == 0 or self.long[n] >= FUZZY_CHARS)]
            self.accept.append(max([stem, *whole]))
            if len(self.sets) > len(self.table):
                more = np.full((max(1024, len(self.table)), self.table.shape[1]), -1, dtype=np.int32)
                self.table = np.concatenate([self.table, more])
        return self.states[key]

    def _step(self, state: int, cls: int) -> int:
        nodes, stem = self.sets[state]
        c = chr(self.alphabet[cls - 1]) if cls else None
        out: set = set()
        for n, e in nodes:
            nxt = self.child[n].get(c) if c else None
            if nxt is not None:
                out.add((nxt, e))
            if e == 0 and self.fuzzy[n]:
                out.add((n, 1))                                   # a letter too many
                out.update((k, 1) for k in self.child[n].values() if self.fuzzy[k])   # another letter
        return self._state(out, stem)

    def kinds(self, words: list[str]) -> np.ndarray:
        """What each lower-cased word is."""
        text = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        cls = np.zeros(len(text), dtype=np.int64)
        if len(self.alphabet):
            at = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
            cls = np.where(self.alphabet[at] == text, at + 1, 0)
        by = np.argsort(-size, kind="stable")
        first, size = first[by], size[by]
        state = np.full(len(words), self.start, dtype=np.int64)
        for j in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -j, side="left"))
            s, c = state[:live], cls[first[:live] + j]
            nxt = self.table[s, c]
            if (nxt < 0).any():
                for pair in np.unique(s[nxt < 0] * self.table.shape[1] + c[nxt < 0]).tolist():
                    a, k = divmod(pair, self.table.shape[1])
                    to = self._step(a, k)
                    self.table[a, k] = to
                nxt = self.table[s, c]
            state[:live] = nxt
        out = np.zeros(len(words), dtype=np.int64)
        out[by] = np.array(self.accept, dtype=np.int64)[state]
        return out


def _units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Starts, ends, word numbers, first word of each text, distinct words."""
    st, en = S.word_spans(buf, off, LETTERS)
    at, inv = S.distinct_spans(S.FOLD[buf], st, en)
    data = buf.tobytes()
    words = [data[a:b].decode("utf-8", "replace").lower() for a, b in zip(st[at].tolist(), en[at].tolist())]
    return st, en, inv, S.per_document(st, off), words


def features(col, matcher: Matcher) -> tuple[np.ndarray, np.ndarray]:
    """Document features (see FEATURES) and counts (exact, fuzzy, quoted)."""
    buf, off = S.flat(col)
    n = len(off) - 1
    out, counts = np.zeros((n, len(FEATURES))), np.zeros((n, 3), dtype=np.int64)
    for lo, hi in S.chunks(off):
        b, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        st, en, inv, first, words = _units(b, o)
        if not len(st):
            continue
        kind = matcher.kinds(words)[inv]
        hit = np.flatnonzero(kind)
        if not len(hit):
            continue
        doc = np.searchsorted(first, hit, side="right") - 1
        a = np.maximum(hit - WINDOW, first[doc])
        z = np.minimum(hit + WINDOW, first[doc + 1] - 1)
        mark = b == 0x22
        mark[1:] |= (b[:-1] == 0xC2) & ((b[1:] == 0xAB) | (b[1:] == 0xBB))
        mark[2:] |= (b[:-2] == 0xE2) & (b[1:-1] == 0x80) & (b[2:] >= 0x9C) & (b[2:] <= 0x9F)
        marks = np.concatenate([[0], np.cumsum(mark)])
        # a quotation mark can stand before the window's first word or after its last
        left = np.maximum(st[a] - 3, o[doc])
        right = np.minimum(en[z] + 3, o[doc + 1])
        quoted = (marks[st[hit]] > marks[left]) & (marks[right] > marks[en[hit]])
        exact = ~quoted & (kind[hit] >= STEM)
        fuzzy = ~quoted & (kind[hit] < STEM)
        m = hi - lo
        c = np.stack([np.bincount(doc[x], minlength=m) for x in (exact, fuzzy, quoted)], axis=1)
        near = (np.searchsorted(hit, z, side="right") - np.searchsorted(hit, a, side="left")) * exact
        density = np.zeros(m)
        np.maximum.at(density, doc, near)
        words_in = np.maximum(np.diff(first), 1)
        counts[lo:hi] = c
        out[lo:hi] = np.stack([c[:, 0] > 0, np.log1p(c[:, 0]), c[:, 1] > 0, np.log1p(c[:, 1]), np.log1p(c[:, 2]), density,
                               np.sqrt((c[:, 0] + 0.25 * c[:, 1]) / words_in)], axis=1)
    return out, counts


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the bounded sample of labelled rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD, F.lit(False))).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    part = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
            for v, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    # copies would make their own words look like terms: equal texts count once
    return docs.join(F.broadcast(part[0].unionByName(part[1])), "doc_id").select("text", "toxic").groupBy(
        F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _terms(col, stems: bool = True) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """For each chunk: documents (repeated), texts and numbers of the distinct
    terms (words as 'w...', stems as 's...') of each document."""
    buf, off = S.flat(col)
    for lo, hi in S.chunks(off):
        b, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        st, _, inv, first, words = _units(b, o)
        if not len(st):
            continue
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        pair = np.unique(doc * len(words) + inv)
        doc, word = pair // len(words), pair % len(words)
        number: dict[str, int] = {}
        of = [[number.setdefault("w" + w, len(number))] + [number.setdefault("s" + w[:k], len(number)) for k in STEM_CHARS if k < len(w)]
              for w in words]
        size = np.fromiter(map(len, of), np.int64, len(of))
        flat = np.array([x for t in of for x in t], dtype=np.int64)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        term = flat[S.ranges(at[word], size[word])]
        both = np.unique(np.repeat(doc, size[word]) * len(number) + term)
        yield lo + both // len(number), list(number), both % len(number)


def _frequency(rows: DataFrame, known: frozenset | None = None) -> DataFrame:
    """(term, n): documents that hold each term (of ``known``, if given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, names, term in _terms(b.column(0)):
                n = np.bincount(term, minlength=len(names))
                keep = [i for i, t in enumerate(names) if known is None or t in known]
                yield pa.record_batch([pa.array([names[i] for i in keep], pa.string()), pa.array(n[keep], pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool]]:
    """Terms (text, whole word) that mark toxic documents."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return []
    least = max(4, int(n[1] * SHARE_LEAST))
    toxic = {r["term"]: r["n"] for r in _frequency(sample.where("toxic = 1")).where(F.col("n") >= least).collect()}
    clean = {r["term"]: r["n"] for r in _frequency(sample.where("toxic = 0"), frozenset(toxic)).collect()}
    value = {t: np.log((k + 0.5) / (n[1] + 1)) - np.log((clean.get(t, 0) + 0.5) / (n[0] + 1)) for t, k in toxic.items()}
    out: list[tuple[float, str, bool]] = []
    stems: set[str] = set()
    for t in sorted((t for t in value if value[t] >= ODDS), key=lambda t: (len(t), t)):
        text, whole = t[1:], t[0] == "w"
        if any(text[:k] in stems for k in STEM_CHARS if k <= len(text)):
            continue
        # a stem is worth having if it covers more documents than the word itself
        if not whole and toxic[t] <= 1.05 * toxic.get("w" + text, 0) or not whole and _one_word(text, toxic, toxic[t]):
            continue
        if not whole:
            stems.add(text)
        out.append((value[t], text, whole))
    out = [x for x in out if not (x[2] and any(x[1][:k] in stems for k in STEM_CHARS if k <= len(x[1])))]
    out.sort(key=lambda x: (-x[0], x[1]))
    return [(text, whole) for _, text, whole in out[:LEXICON_MOST]]


def _one_word(stem: str, toxic: dict, n: int) -> bool:
    """Whether a longer stem or word accounts for nearly all of a stem."""
    return any(toxic.get(kind + w, 0) >= 0.95 * n for kind, w in toxic_extensions(stem, toxic))


def toxic_extensions(stem: str, toxic: dict) -> list[tuple[str, str]]:
    return [(t[0], t[1:]) for t in toxic if len(t) > len(stem) + 1 and t.startswith(stem, 1)]


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps, both labels weighted alike."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    xb = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(xb.shape[1])
    ridge = np.full(len(beta), l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(xb @ beta, -30, 30)))
        grad = xb.T @ (w * (p - y)) + ridge * beta
        hess = (xb * (w * p * (1 - p))[:, None]).T @ xb + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


Model = tuple[list[tuple[str, bool]], np.ndarray | None]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and weights, from the bounded sample."""
    from revlens.llm.components import written

    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    sample = written(_sample(d, labels.select("doc_id", "toxic")), "toxic-sample")
    lexicon = learn_lexicon(sample)
    if not lexicon:
        return [], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in batches:
            x, _ = features(b.column(0), matcher)
            yield pa.record_batch([b.column(1).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    got = sample.select("text", "toxic").mapInArrow(run, "toxic int, x array<double>").collect()
    return lexicon, fit(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got]))


def scores(col, matcher: Matcher | None, beta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Score and counts of each text."""
    if matcher is None:
        return np.zeros(len(col)), np.zeros((len(col), 3), dtype=np.int64)
    x, counts = features(col, matcher)
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ beta, -30, 30))), counts


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, fold, score, prediction, counts of hits."""
    lexicon, beta = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon) if lexicon else None
        for b in batches:
            s, counts = scores(b.column(1), matcher, beta)
            yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32)),
                                   *[pa.array(counts[:, k]) for k in range(3)]],
                                  names=["doc_id", "held_out", "score", "predicted", "n_exact", "n_fuzzy", "n_quoted"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"),
                       F.coalesce(fold(docs[id_col], FOLDS) == HELD, F.lit(False)).alias("held_out")).mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score is below the threshold."""
    lexicon, beta = model
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon) if lexicon else None
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at), matcher, beta)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
