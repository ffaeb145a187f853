"""Language identification by a linear-chain conditional random field.

Each word of a text gets a language label. A word's emission scores are the mean
weight of its features (character n-grams over ``^word$``, prefixes and suffixes,
and the word itself if it is in the training lexicon); label-to-label transition
and start scores are learned with them by gradient ascent on the conditional
log-likelihood, with expectations from forward-backward. Training sequences are
made code-switched: spans of documents of different languages are strung together.

Prediction runs forward-backward over every word of the whole text, and a document
is given the language with the largest sum of word marginals.

Edge cases: a null text or one without any letter is ``und`` with score 0; so is
every text if nothing could be learned. Rows with a null id are not learned from. Words without a letter are labelled from
their neighbours alone and carry no weight in the document's label. Repeated rows
are labelled alike. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfwork.llm.common import crc_bucket, give_back, map_texts

#: Weights a label (a power of two), and in all: with very many labels each has fewer.
BITS, MOST_WEIGHTS = 17, 1 << 24
#: Least potential or message: denormal numbers would slow arithmetic a hundredfold.
FLOOR = 1e-15
#: Words whose features a Python worker keeps.
KEPT_WORDS = 700_000


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (a power of two, labels)
    transitions: np.ndarray  # log potentials, (labels, labels)
    start: np.ndarray
    lexicon: frozenset


def _buckets(words: list[str], in_lexicon: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, feature buckets, present) for groups of words of similar length."""
    length = np.array([len(w) for w in words])
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        top = at + 1
        while top < len(order) and (top - at + 1) * (length[order[top]] + 2) <= 200_000 and length[order[top]] <= 2 * length[order[at]] + 4:
            top += 1
        rows = order[at:top]
        at = top
        width = int(length[rows[-1]]) + 2
        text = "".join("^" + words[r] + "$" + "\0" * (width - 2 - length[r]) for r in rows)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), width).astype(np.uint64)
        n = length[rows] + 2
        prime = np.uint64(0x100000001B3)
        ids, there = [], []
        with np.errstate(over="ignore"):
            rolled = np.zeros_like(code)
            for gram in range(1, 5):
                if width < gram:
                    break
                rolled = rolled[:, : width - gram + 1] * prime + code[:, gram - 1 :] + np.uint64(1)
                ids.append(rolled * np.uint64(0x9E3779B97F4A7C15) + np.uint64(gram))
                there.append(np.arange(width - gram + 1)[None, :] <= (n - gram)[:, None])
            prefix = np.full(len(rows), 7, np.uint64)
            suffix = np.full(len(rows), 11, np.uint64)
            row = np.arange(len(rows))
            for k in range(1, 6):
                ok = n - 2 >= k
                prefix = prefix * prime + code[row, np.minimum(k, width - 1)] + np.uint64(k)
                suffix = suffix * prime + code[row, np.maximum(n - 1 - k, 0)] + np.uint64(k)
                for x in (prefix, suffix):
                    ids.append((x * np.uint64(0xC2B2AE3D27D4EB4F))[:, None])
                    there.append(ok[:, None])
            whole = np.full(len(rows), 13, np.uint64)
            for k in range(width):
                whole = np.where(k < n, whole * prime + code[:, k], whole)
            ids.append((whole * np.uint64(0x165667B19E3779F9))[:, None])
            there.append(in_lexicon[rows][:, None])
        ids = np.concatenate(ids, axis=1)
        ids ^= ids >> np.uint64(31)
        yield rows, (ids & np.uint64(size - 1)).astype(np.int64), np.concatenate(there, axis=1)


def emissions(words: list[str], model: Crf) -> np.ndarray:
    out = np.zeros((len(words), len(model.labels)), np.float32)
    known = np.fromiter((w in model.lexicon for w in words), bool, len(words))
    for rows, ids, there in _buckets(words, known, len(model.weights)):
        total = np.einsum("rfk,rf->rk", model.weights[ids], there.astype(np.float32))
        out[rows] = total / there.sum(1, keepdims=True)
    return out


def forward_backward(emission: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every position of many chains laid end to end (``first`` marks
    where one begins), with alpha, beta and potentials. Positions are cut into
    about sqrt(n) blocks that advance together; between blocks the product of each
    block's matrices carries the message."""
    n, k = emission.shape
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    e = np.ones((blocks * width, k))
    e[:n] = np.maximum(np.exp(emission - emission.max(1, keepdims=True)), FLOOR)
    f = np.ones(blocks * width, bool)
    f[:n] = first
    f[0] = True
    e, f = e.reshape(blocks, width, k), f.reshape(blocks, width)
    move, begin = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(width):
        stepped = (product.reshape(-1, k) @ move).reshape(blocks, k, k)
        if f[:, t].any():
            stepped = np.where(f[:, t, None, None], product.sum(2, keepdims=True) * begin, stepped)
        product = stepped * e[:, t, None, :]
        if t % 8 == 7 or t == width - 1:
            product = np.maximum(product / product.max((1, 2), keepdims=True), FLOOR)
    into, out = np.empty((blocks, k)), np.empty((blocks, k))
    message = np.ones(k)
    for b in range(blocks):
        into[b] = message
        message = message @ product[b]
        message = message / message.sum()
    message = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        out[b] = message
        message = product[b] @ message
        message = message / message.sum()
    alpha, beta = np.empty_like(e), np.empty_like(e)
    at = into
    for t in range(width):
        at = np.where(f[:, t, None], begin, at @ move) * e[:, t]
        at = np.maximum(at / at.sum(1, keepdims=True), FLOOR)
        alpha[:, t] = at
    at = out
    for t in range(width - 1, -1, -1):
        beta[:, t] = at
        seen = e[:, t] * at
        at = np.where(f[:, t, None], (seen @ begin)[:, None], seen @ move.T)
        at = np.maximum(at / at.sum(1, keepdims=True), FLOOR)
    alpha, beta, e = (x.reshape(-1, k)[:n] for x in (alpha, beta, e))
    marginal = alpha * beta
    return marginal / marginal.sum(1, keepdims=True), alpha, beta, e


def words_of(text: str) -> list[str]:
    return text.split()


def lettered(word: str) -> bool:
    """Whether a word has a letter (general category L)."""
    return word.isalpha() or any(map(str.isalpha, word))


def bare(word: str) -> str:
    """A word that has a letter from its first to its last one, in lower case."""
    if word.isalpha():
        return word.lower()
    at = [i for i, c in enumerate(word) if c.isalpha()]
    return word[at[0] : at[-1] + 1].lower()


def train(texts: list[tuple[str, str]], rounds: int = 25, seed: int = 7) -> Crf | None:
    """Fit on (text, label) pairs held on the driver."""
    labels = sorted({label for _, label in texts})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    index, words = {}, []
    spans: list[tuple[int, list[int]]] = []
    for text, label in sorted(texts):
        ids = []
        for word in words_of(text):
            if lettered(word):
                w = bare(word)
                if w not in index:
                    index[w] = len(words)
                    words.append(w)
                ids.append(index[w])
        at = 0
        while at < len(ids):
            size = int(rng.integers(6, 60))
            spans.append((labels.index(label), ids[at : at + size]))
            at += size
    if not spans:
        return None
    rng.shuffle(spans)
    k = len(labels)
    first, gold, token = [], [], []
    for i, (label, ids) in enumerate(spans):
        first += [i % 6 == 0] + [False] * (len(ids) - 1)
        gold += [label] * len(ids)
        token += ids
    first, gold, token = np.array(first), np.array(gold), np.array(token)
    first[0] = True
    times = np.bincount(token, minlength=len(words))
    lexicon = frozenset(w for w, c in zip(words, times, strict=True) if c >= 2)
    known = np.fromiter((w in lexicon for w in words), bool, len(words))
    size = 1 << min(BITS, (MOST_WEIGHTS // k).bit_length() - 1)
    flat_word, flat_id, flat_share = [], [], []
    for rows, ids, there in _buckets(words, known, size):
        at, _ = np.nonzero(there)
        flat_word.append(rows[at])
        flat_id.append(ids[there])
        flat_share.append((1.0 / there.sum(1))[at])
    flat_word, flat_id, flat_share = map(np.concatenate, (flat_word, flat_id, flat_share))
    weights, transitions, start = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, transitions, start)]
    inner = np.flatnonzero(~first)
    truth = np.eye(k)[gold]
    pairs = np.bincount(gold[inner - 1] * k + gold[inner], minlength=k * k).reshape(k, k)
    for step in range(1, rounds + 1):
        by_word = np.stack([np.bincount(flat_word, weights[flat_id, j] * flat_share, minlength=len(words)) for j in range(k)], axis=1)
        emission = by_word[token]
        marginal, alpha, beta, e = forward_backward(emission, first, transitions, start)
        joint = alpha[inner - 1][:, :, None] * np.exp(transitions - transitions.max()) * (e[inner] * beta[inner])[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        miss = truth - marginal
        per_word = np.stack([np.bincount(token, miss[:, j], minlength=len(words)) for j in range(k)], axis=1)
        g_weights = np.stack([np.bincount(flat_id, per_word[flat_word, j] * flat_share, minlength=size) for j in range(k)], axis=1)
        gradients = (g_weights - 0.02 * weights, pairs - joint.sum(0) - 0.1 * transitions, miss[first].sum(0) - 0.1 * start)
        for x, g, m, rate in zip((weights, transitions, start), gradients, moments, (0.6, 0.15, 0.15), strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
    return Crf(labels, weights.astype(np.float32), transitions, start, lexicon)


class Labeller:
    """Holds a model and the emissions of words already met."""

    def __init__(self, model: Crf):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1, len(self.model.labels)), np.float32)  # row 0: no letter

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of ``table`` for each text's words."""
        if len(self.place) > KEPT_WORDS:
            self.clear()
        new: dict[str, list[str]] = {}
        for words in texts:
            for w in set(words):
                if w in self.place:
                    continue
                if not lettered(w):
                    self.place[w] = 0
                else:
                    new.setdefault(bare(w), []).append(w)
        if new:
            at = len(self.table)
            self.table = np.concatenate([self.table, emissions(list(new), self.model)])
            for i, forms in enumerate(new.values()):
                for w in forms:
                    self.place[w] = at + i
        get = self.place.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]

    def marginals(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (word marginals, has-letter mask)."""
        ids = self.ids(texts)
        sizes = np.array([len(x) for x in ids], np.int64)
        if not sizes.sum():
            return [(np.zeros((0, len(self.model.labels))), np.zeros(0, bool)) for _ in texts]
        flat = np.concatenate(ids)
        first = np.zeros(len(flat), bool)
        begin = np.cumsum(sizes) - sizes
        first[begin[sizes > 0]] = True
        marginal = forward_backward(self.table[flat], first, self.model.transitions, self.model.start)[0]
        return [(marginal[b : b + s], flat[b : b + s] > 0) for b, s in zip(begin, sizes, strict=True)]

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for marginal, lettered in self.marginals([words_of(t or "") for t in texts]):
            if not lettered.any():
                out.append(("und", 0.0))
            else:
                total = marginal[lettered].sum(0)
                out.append((self.model.labels[int(total.argmax())], min(1.0, float(total.max() / total.sum()))))
        return out


def sample_labelled(docs: DataFrame, docs_per_label: int, longest: int) -> list[tuple[str, str]]:
    """The ``docs_per_label`` distinct texts of each label with the lowest hashes of
    text and label. Of a text above ``longest`` characters, so many from its first
    letter on are used."""
    span = F.when(F.length("text") <= longest, F.col("text")).otherwise(F.substring("text", F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(longest)))
    ready = docs.where(F.col("lang").isNotNull() & (F.col("lang") != "und") & F.col("text").rlike(r"\p{L}")).select(span.alias("text"), "lang")
    h = F.xxhash64("lang", "text")
    counts = {r["lang"]: r["n"] for r in ready.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).collect()}
    if not counts:
        return []
    # Twice as many as wanted, as the counts are estimates; then the lowest exactly.
    share = F.coalesce(*[F.when(F.col("lang") == label, F.lit(2 * docs_per_label / n)) for label, n in counts.items()])
    rows = ready.where(h / F.lit(2.0**64) + 0.5 < share).select("lang", h.alias("h"), "text").distinct().collect()
    taken, out = Counter(), []
    for lang, _, text in sorted(map(tuple, rows)):
        taken[lang] += 1
        if taken[lang] <= docs_per_label:
            out.append((text, lang))
    return out


def fit(docs: DataFrame, docs_per_label: int = 120, longest: int = 12_000) -> Crf | None:
    """Fit on a bounded sample of the labelled ``docs`` (text, lang):
    ``docs_per_label`` texts of each label, cut to ``longest`` characters."""
    model = train(sample_labelled(docs, docs_per_label, longest))
    give_back()
    return model


def predict(docs: DataFrame, model: Crf | None, *keep: str) -> DataFrame:
    """(keep columns, lang_pred, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_WEIGHTS weights at most

    def make():
        labeller = Labeller(shared.value) if shared.value else None

        def work(texts: list) -> list[list]:
            found = labeller.documents(texts) if labeller else [("und", 0.0)] * len(texts)
            return [[x for x, _ in found], [x for _, x in found]]

        return work

    return map_texts(docs, list(keep), {"lang_pred": "string", "score": "double"}, make)


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, labels): one label for each white-space word of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = Labeller(shared.value)
        return lambda texts: [[" ".join(shared.value.labels[i] for i in m.argmax(1)) for m, _ in labeller.marginals([words_of(t or "") for t in texts])]]

    return map_texts(docs, ["doc_id"], {"labels": "string"}, make).withColumn("labels", F.filter(F.split("labels", " "), lambda x: x != ""))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(crc_bucket(F.col("doc_id")) == 0, F.lit(False))
    model = fit(docs.where(crc_bucket(F.col("doc_id")) != 0).select("text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, "doc_id", "held_out")
