"""Language-model scoring by the likelihood of a subword lattice.

The pieces of an existing vocabulary have unigram scores. Every way to spell a word as
pieces is a path of its lattice; the forward recursion adds all paths in log space.
Words known from the training documents are edges over the whole word, too:

    P(word) = max(c - D, 0) / N + freed / N * sum over spellings of the product of pieces

c is the word's count, N the training tokens (ends of documents are tokens), D the
discount, and freed what discounting takes from all known words; the end of a text has
(documents - D) / N. A text's probability is the product over its words and its end, so
the probabilities of all texts add up to 1: pieces and byte fallback share mass 1, the
first piece of a word carries the word mark, and a spelling ends at the next mark. Column
``spelled_score`` is the lattice of the vocabulary alone, without known words.

The public vocabulary's file is of kind BPE: its scores are minus the ranks, which are no
probabilities. They are read as a Zipf law, and that is the prior of ``PRIOR`` pseudo
pieces for one pass of expected piece counts over the training data of the spelling
part, which by the formula above is min(c, D) of each known word. Bytes of characters
without a piece fall back on byte pieces, so every word has a spelling.

Words and their counts are gathered from all training documents and grow with the
input; they are shuffled by word, never collected. Only the ``COMMON`` most frequent
words, by occurrences in all documents, are broadcast (a fixed bound) and scored where
the text is; the others are joined by word after being summed within each row.

Edge cases: null text is empty: one token, the end. Words of any length are scored
whole; those above ``LONG`` characters are streamed, and give their piece counts in
blocks of that length. Every row is scored alone, whatever its id; null ids are not
learned from. With no training documents at all, counts are 0, the end has probability
1/2 and all scores stay finite. Columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfwork.llm.common import PairTable, crc_bucket, cut, nothing_live, small_batches

MARK = "▁"
COMMON = 60_000
#: Distinct words a counting task holds before it passes them on.
HELD = 60_000
DISCOUNT, PRIOR = 0.6, 1000.0
#: Characters of a word above which its lattice is streamed.
LONG = 20_000
LN10 = math.log(10)
PRIME = np.uint64(0x100000001B3)


class Vocabulary:
    """Pieces with log scores, looked up by rolling hash of their code points.
    ``pieces``: text (MARK first in word-initial ones) to natural log score;
    ``byte_score``: log score of one byte of a character without a piece."""

    def __init__(self, pieces: dict[str, float], byte_score: float):
        self.names = sorted(pieces)
        self.scores = np.array([pieces[p] for p in self.names] + [-np.inf])
        self.byte_score = byte_score
        self.longest = max(map(len, self.names), default=1)
        prefixes = {p[:i] for p in self.names for i in range(1, len(p) + 1)}
        keys, values = [], []
        place = {p: i for i, p in enumerate(self.names)}
        for p in prefixes:
            keys.append(self.roll(p))
            values.append(place.get(p, len(self.names)))
        self.table = PairTable(np.array(keys, np.uint64), np.array(values), -1)

    @staticmethod
    def roll(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(PRIME) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """The lattice of words (with MARK): score (width, words) of each character in
        bytes, their lengths, and the edges of pieces (row, begin, size, piece).
        Position 0 is before MARK; characters past a word's end only fill the matrix."""
        n = np.array([len(w) for w in words])
        width = int(n.max())
        text = "".join(w.ljust(width, "\0") for w in words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)
        in_bytes = self.byte_score * (1.0 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)).T
        code = code.astype(np.uint64)
        row, begin = np.nonzero(np.arange(width)[None, :] < n[:, None])
        hashed = np.zeros(len(row), np.uint64)
        found, size = [], 0
        with np.errstate(over="ignore"):
            while len(row):
                hashed = hashed * PRIME + code[row, begin + size] + np.uint64(1)
                piece = self.table.get(hashed)
                size += 1
                whole = (piece >= 0) & (piece < len(self.names))
                found.append((row[whole], begin[whole], np.full(np.count_nonzero(whole), size), piece[whole]))
                go = (piece >= 0) & (begin + size < n[row])
                row, begin, hashed = row[go], begin[go], hashed[go]
        return in_bytes, n, tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def groups(self, words: list[str]) -> Iterator[np.ndarray]:
        length = np.array([len(w) for w in words])
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            top = at + 1
            while top < len(order) and (top - at + 1) * (length[order[top]] + 1) <= 120_000 and length[order[top]] <= length[order[at]] + 4:
                top += 1
            yield order[at:top]
            at = top

    def forward(self, words: list[str], expect: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's summed spellings. ``expect`` gets the expected
        piece counts of the words, each with its weight."""
        out = np.zeros(len(words))
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            short = [i for i, w in enumerate(words) if len(w) <= LONG]
            out[short] = self.forward([words[i] for i in short], expect, None if weight is None else weight[short])
            for i in long:
                out[i] = self.streamed(MARK + words[i])
                if expect is not None:
                    parts = [words[i][at : at + LONG] for at in range(0, len(words[i]), LONG)]
                    self.forward(parts, expect, np.full(len(parts), weight[i]))
            return out
        for rows in self.groups(words):
            in_bytes, n, (row, begin, size, piece) = self.edges([MARK + words[r] for r in rows])
            width, most = len(in_bytes), int(size.max(initial=1))
            score = self.scores[piece]
            # Edges by their end and size; any character may be spelled in bytes.
            into = np.full((width + 1, most, len(rows)), -np.inf)
            into[begin + size, size - 1, row] = score
            into[1:, 0] = np.logaddexp(into[1:, 0], in_bytes)
            alpha = np.full((width + 1, len(rows)), -np.inf)
            alpha[0] = 0
            for p in range(1, width + 1):
                k = min(p, most)
                alpha[p] = self._log_sum(alpha[p - k : p][::-1] + into[p, :k])
            total = alpha[n, np.arange(len(rows))]
            out[rows] = total
            if expect is not None:
                past = np.arange(width + 1)[:, None] > n
                beta = np.where(np.arange(width + 1)[:, None] == n, 0.0, -np.inf)
                for p in range(width - 1, -1, -1):
                    k = min(width - p, most)
                    step = np.arange(k)
                    beta[p] = np.where(past[p] | (p == n), beta[p], self._log_sum(beta[p + 1 : p + 1 + k] + into[p + 1 + step, step]))
                share = np.exp(alpha[begin, row] + score + beta[begin + size, row] - total[row]) * weight[rows][row]
                spelled = np.exp(alpha[:-1] + in_bytes + beta[1:] - total) * weight[rows]
                expect[:-1] += np.bincount(piece, share, len(self.names))
                expect[-1] += spelled.sum()
        return out

    def streamed(self, text: str) -> float:
        """The forward recursion over one long word, a block of begins at a time."""
        most = self.longest
        ahead = [0.0] + [-math.inf] * most  # of the positions from the block's first on
        for at in range(0, len(text), LONG):
            here = min(LONG, len(text) - at)
            in_bytes, _, (_, begin, size, piece) = self.edges([text[at : at + here + most]])
            alpha = np.concatenate([ahead, np.full(here, -np.inf)]).tolist()
            order = np.argsort(begin, kind="stable")
            edges = list(zip(begin[order].tolist(), size[order].tolist(), self.scores[piece[order]].tolist(), strict=True))
            k, own = 0, in_bytes[:, 0].tolist()
            for p in range(here):
                into = [(1, own[p])]
                while k < len(edges) and edges[k][0] == p:
                    into.append(edges[k][1:])
                    k += 1
                for step, score in into:
                    a, b = alpha[p] + score, alpha[p + step]
                    alpha[p + step] = max(a, b) + math.log1p(math.exp(-abs(a - b))) if b > -math.inf else a
            ahead = alpha[here:]
        return ahead[0]

    @staticmethod
    def _log_sum(terms: np.ndarray) -> np.ndarray:
        """Log of the sum of exp over the first axis."""
        top = terms.max(0)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(terms - safe).sum(0)) + safe


def existing_pieces(path: str) -> dict[str, float]:
    """The pieces of a sentencepiece file that hold no inner word mark. Files of kind
    BPE store minus the rank as score: it is read as a Zipf law over ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    raw = {model.id_to_piece(i): model.get_score(i) for i in plain}
    raw = {p.lower(): s for p, s in sorted(raw.items(), key=lambda x: x[1]) if MARK not in p[1:]}
    ranked = {p: 1.0 / (2 + i) for i, p in enumerate(sorted(raw, key=lambda p: (-raw[p], p)))}
    total = sum(ranked.values()) / 0.98
    return {p: math.log(x / total) for p, x in ranked.items()}


BYTE_SCORE = math.log(0.02 / 256)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, n): of every word its occurrences in training documents (column
    ``learn``) and in all."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_live()
        learned, other = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = [*learned, *(other.keys() - learned.keys())]
            c = np.fromiter((learned.get(w, 0) for w in words), np.int64, len(words))
            n = c + np.fromiter((other.get(w, 0) for w in words), np.int64, len(words))
            learned.clear()
            other.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), "c": c, "n": n})

        for batch in batches:
            for learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (learned if learn else other).update(words_of(text))
                if len(learned) + len(other) > HELD:
                    yield out()
        yield out()

    return docs.select("learn", "text").mapInArrow(run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def expected_counts(vocabulary: DataFrame, pieces: Vocabulary) -> np.ndarray:
    """Expected counts of the pieces in what discounting leaves to spelling, min(c,
    DISCOUNT) of each known word; one row of that fixed length comes from each task and
    is summed."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expect = np.zeros(len(shared.value.names) + 1)
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            if words:
                shared.value.forward(words, expect, np.minimum(c.astype(float), DISCOUNT))
        at = np.flatnonzero(expect)
        yield pa.RecordBatch.from_pydict({"piece": at.astype(np.int64), "x": expect[at]})

    out = np.zeros(len(pieces.names) + 1)
    for r in vocabulary.where("c > 0").select("word", "c").mapInArrow(run, "piece long, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect():
        out[r["piece"]] = r["x"]
    return out


def learned_pieces(first: Vocabulary, expect: np.ndarray) -> Vocabulary:
    """Scores from expected counts (the last one of bytes) and the prior ``first``; the
    probabilities of all pieces and bytes add up to 1."""
    prior = np.append(np.exp(first.scores[:-1]), math.exp(first.byte_score) * 256)
    p = expect + PRIOR * prior / prior.sum()
    p = np.log(p / p.sum())
    return Vocabulary(dict(zip(first.names, p[:-1].tolist(), strict=True)), float(p[-1]) - math.log(256))


@dataclass(frozen=True)
class Model:
    """What was learned: the pieces, N, the distinct tokens V, documents, freed mass."""

    pieces: Vocabulary
    tokens: int
    distinct: int
    ends: int
    freed: float

    def base(self, c):
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def whole(self, c):
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(c - DISCOUNT, 0) / max(self.tokens, 1))

    @property
    def spelling(self) -> float:
        """Log mass of all spelled words."""
        return math.log(self.freed / self.tokens) if self.tokens else math.log(0.5)

    @property
    def end(self) -> float:
        return math.log((self.ends - DISCOUNT) / self.tokens) if self.ends else math.log(0.5)

    @property
    def end_alone(self) -> float:
        """Probability of the end where only pieces score."""
        return min(self.ends / self.tokens, 0.5) if self.ends else 0.5


def fit(docs: DataFrame, vocabulary_path: str) -> tuple[DataFrame, Model]:
    """(words (word, c, n), model) of ``docs`` (text, learn)."""
    counted = cut(count_words(docs))
    facts = counted.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = docs.where("learn").count()
    first = Vocabulary(existing_pieces(vocabulary_path), BYTE_SCORE)
    learned = learned_pieces(first, expected_counts(counted, first))
    return counted, Model(learned, facts["n"] + ends, facts["v"] + bool(ends), ends, DISCOUNT * (facts["v"] + bool(ends)))


def score_words(vocabulary: DataFrame, model: Model) -> DataFrame:
    """(word, c, n, base, model, spelled): log10 scores of every word."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            c = batch.column(1).to_numpy()
            spelled = m.pieces.forward(batch.column(0).to_pylist()) if len(c) else np.zeros(0)
            scores = {"base": m.base(c), "model": np.logaddexp(m.whole(c), m.spelling + spelled) / LN10, "spelled": spelled / LN10 + math.log10(1 - m.end_alone)}
            yield pa.RecordBatch.from_pydict({**dict(zip(("word", "c", "n"), batch.columns, strict=True)), **scores})

    return vocabulary.select("word", "c", "n").mapInArrow(run, "word string, c long, n long, base double, model double, spelled double")


def most_frequent(scored: DataFrame, most: int) -> DataFrame:
    """The words of the highest classes of occurrences (an eighth of a doubling each)
    that hold at most ``most`` words together. The class table is a few hundred rows."""
    level = F.floor(8 * F.log2(F.greatest(F.col("n"), F.lit(1))))
    classes = sorted((r["level"], r["count"]) for r in scored.groupBy(level.alias("level")).count().collect())
    total, least = 0, None
    for value, n in reversed(classes):
        total += n
        if total > most:
            break
        least = value
    return scored.where(level >= least if least is not None else F.lit(False))


SUMS = ("n", "k", "base", "model", "spelled")


def score(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    spelled_score) for ``docs`` (doc_id, text, held_out, learn)."""
    spark = docs.sparkSession
    small_batches(spark)
    counted, model = fit(docs, vocabulary_path)
    scored = cut(score_words(counted, model))
    common = {r["word"].encode("utf-8", "surrogatepass"): (r["c"] > 0, r["base"], r["model"], r["spelled"]) for r in most_frequent(scored, COMMON).collect()}
    shared = spark.sparkContext.broadcast(common)  # COMMON entries at most
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = dict(zip(SUMS, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row (own): its id and the sums of its common words; one more line
        for each of its other words, with how often it has it. Rows are numbered."""
        known, key = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, words, tfs, place, own = [], [], [], [], {x: [] for x in SUMS}
            for text in batch.column(2).to_pylist():
                n = k = 0
                base = whole = spelled = 0.0
                for w, tf in Counter(words_of(text)).items():
                    hit = known.get(w)
                    if hit is None:
                        keys.append(key)
                        words.append(w.decode("utf-8", "replace"))
                        tfs.append(tf)
                    else:
                        n += tf
                        k += tf * hit[0]
                        base += tf * hit[1]
                        whole += tf * hit[2]
                        spelled += tf * hit[3]
                place.append(len(keys))
                keys.append(key)
                words.append(None)
                tfs.append(0)
                for x, v in zip(SUMS, (n, k, base, whole, spelled), strict=True):
                    own[x].append(v)
                key += 1
            at = np.full(len(keys), -1)
            at[place] = np.arange(len(place))
            facts = pa.StructArray.from_arrays([batch.column(0), batch.column(1), *[pa.array(own[x], kinds[x]) for x in SUMS]], ["doc_id", "held_out", *SUMS])
            facts = facts.take(pa.array(at, mask=at < 0))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string()), pa.array(tfs, pa.int64()), facts], ["key", "word", "tf", "own"])

    made = f"key long, word string, tf long, own struct<doc_id: {kind}, held_out: boolean, n: long, k: long, base: double, model: double, spelled: double>"
    parts = cut(docs.select("doc_id", "held_out", "text").mapInArrow(run, made))
    tf = F.col("tf")
    rare = parts.where(F.col("word").isNotNull()).select("key", "word", "tf").join(scored.select("word", "c", "base", "model", "spelled"), "word")
    rare = rare.select("key", tf.alias("n"), F.when(F.col("c") > 0, tf).otherwise(0).alias("k"), *[(tf * F.col(x)).alias(x) for x in SUMS[2:]])
    own = parts.where(F.col("own").isNotNull()).select("key", F.col("own").alias("o"), *[F.col(f"own.{x}").alias(x) for x in SUMS])
    sums = own.unionByName(rare.withColumn("o", F.lit(None).cast(own.schema["o"].dataType))).groupBy("key").agg(F.max(F.struct("o.doc_id", "o.held_out")).alias("o"), *[F.sum(x).alias(x) for x in SUMS])
    return sums.select(
        "o.doc_id",
        "o.held_out",
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("k") + int(model.ends > 0)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + float(model.base(model.ends))).alias("base_score"),
        (F.col("model") + model.end / LN10).alias("score"),
        (F.col("spelled") + math.log10(model.end_alone)).alias("spelled_score"),
    )


def op2_latticelm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(crc_bucket(F.col("doc_id")) == 1, F.lit(False))
    marked = docs.select("doc_id", "text", held.alias("held_out"), F.col("doc_id").isNotNull().alias("named"))
    return score(marked.withColumn("learn", ~F.col("held_out") & F.col("named")), public_tokenizers.path("piece_bpe_32k.model"))
