"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. A language gives each piece a probability, and the probability of
a word is the sum, over all its segmentations into pieces, of the product of their probabilities; a forward pass over
the word's characters sums them all. A text's score per language is the sum over its words (runs of letters, in lower
case), the prediction the best language, the score its share of the posterior with equal priors.

Piece probabilities are learned by expected counts (forward-backward) over the words of a bounded sample of labelled
rows: of each language the `per_language` eligible rows with the smallest hash of the id. Prediction covers every
whole text and sees nothing but the text.

A text that is null or has no letter is `und` with score 0. Ties go to the language first in order. Without labelled
rows every text is `und`. Repeated rows give repeated results, an empty table gives an empty result, other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm import worker

UNDETERMINED = "und"
START = "▁"
_WORDS = regex.compile(r"\p{L}+").findall
_CACHE_ROWS = 250_000  # words whose scores a worker keeps
_SHORT = 24  # longer words are taken one by one, with scaling
_BLOCK_TEXTS = 256  # texts whose new words are scored together


def vocabulary_pieces(path: str) -> list[str]:
    """The letter pieces of a sentence-piece model, in lower case; a leading bar marks a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p.lstrip(START).isalpha() or p == START)


class Unigrams:
    """Piece probabilities of all languages at once: a row of `langs` numbers per piece."""

    def __init__(self, langs: list[str], pieces: list[str], table: np.ndarray, floor: np.ndarray):
        self.langs, self.pieces, self.table, self.floor = langs, pieces, table, floor
        self.rows = dict(zip(pieces, table, strict=True))
        self.longest = max(map(len, pieces), default=1)
        self.at = {p: i for i, p in enumerate(pieces)}

    def forward_many(self, words: list[str]) -> np.ndarray:
        """forward() of words of one length, short enough to need no scaling; a row per word."""
        texts = [START + w for w in words]
        size, n, get = len(texts[0]), len(texts), self.at.get
        table = np.vstack([self.table, self.floor])  # the floor's row stands last
        alpha = np.zeros((size + 1, n, len(self.langs)))
        alpha[0] = 1
        for end in range(1, size + 1):
            alpha[end] = alpha[end - 1] * table[np.fromiter((get(w[end - 1], -1) for w in texts), np.int64, n)]
            for start in range(max(0, end - self.longest), end - 1):
                at = np.fromiter((get(w[start:end], -1) for w in texts), np.int64, n)
                hit = np.flatnonzero(at >= 0)
                alpha[end, hit] += alpha[start, hit] * table[at[hit]]
        return np.log(np.maximum(alpha[size], 1e-300))

    def forward(self, word: str) -> np.ndarray:
        """Log probability of a word per language: the sum over all its segmentations."""
        w, rows, longest = START + word, self.rows, self.longest
        alpha: list = [np.ones(len(self.langs))]
        scale = np.zeros(len(self.langs))
        for end in range(1, len(w) + 1):
            # A character outside the vocabulary is a piece of the floor's probability.
            now = alpha[end - 1] * rows.get(w[end - 1], self.floor)
            for start in range(max(0, end - longest), end - 1):
                row = rows.get(w[start:end])
                if row is not None:
                    now = now + alpha[start] * row
            alpha.append(now)
            if end % 16 == 0:  # keep long words above underflow; older entries share the factor
                down = 1 / np.maximum(now, 1e-290)
                scale -= np.log(down)
                for i in range(max(0, end - longest), end + 1):
                    alpha[i] = alpha[i] * down
        return np.log(np.maximum(alpha[-1], 1e-300)) + scale


def _expected(counts: dict[str, int], rows: dict[str, float], floor: float, longest: int) -> dict[str, float]:
    """Expected piece counts of words under one language's probabilities (forward-backward)."""
    out: dict[str, float] = defaultdict(float)
    for word, n in counts.items():
        w = START + word
        if len(word) > _SHORT:
            _expected_long(w, n, rows, floor, longest, out)
            continue
        size = len(w)
        arcs = [(i, j, p) for j in range(1, size + 1) for i in range(max(0, j - longest), j) if (p := rows.get(w[i:j], floor if j - i == 1 else None)) is not None]
        alpha, beta = [0.0] * (size + 1), [0.0] * (size + 1)
        alpha[0] = beta[size] = 1.0
        for i, j, p in arcs:
            alpha[j] += alpha[i] * p
        for i, j, p in reversed(arcs):
            beta[i] += p * beta[j]
        for i, j, p in arcs:
            if (share := alpha[i] * p * beta[j] / alpha[size]) > 1e-9:
                out[w[i:j]] += n * share
    return out


def _expected_long(w: str, n: int, rows: dict[str, float], floor: float, longest: int, out: dict[str, float]) -> None:
    """The same for a word of any length: positions hold logarithms, and arcs are made again instead of kept."""
    size = len(w)
    alpha, beta = [0.0] * (size + 1), [0.0] * (size + 1)

    def arcs(fixed: int, to: range, forward: bool) -> list[tuple[int, str, float]]:
        found = []
        for k in to:
            piece = w[k:fixed] if forward else w[fixed:k]
            if (p := rows.get(piece, floor if len(piece) == 1 else None)) is not None:
                found.append((k, piece, math.log(p)))
        return found

    for side, order, reach in ((alpha, range(1, size + 1), lambda j: range(max(0, j - longest), j)), (beta, range(size - 1, -1, -1), lambda i: range(i + 1, min(size, i + longest) + 1))):
        for at in order:
            logs = [side[k] + p for k, _, p in arcs(at, reach(at), side is alpha)]
            most = max(logs)
            side[at] = most + math.log(sum(math.exp(x - most) for x in logs))
    for j in range(1, size + 1):
        for i, piece, p in arcs(j, range(max(0, j - longest), j), True):
            if (share := math.exp(alpha[i] + p + beta[j] - alpha[size])) > 1e-9:
                out[piece] += n * share


def learn(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = 2, smoothing: float = 0.05) -> Unigrams:
    """Probabilities from word counts per language. The first round starts from piece lengths alone."""
    langs = sorted(counts)
    longest = max(map(len, pieces), default=1)
    known = set(pieces) | {c for words in counts.values() for w in words for c in w} | {START}
    order = sorted(known)
    columns, floors = [], []
    for lang in langs:
        rows, floor = {p: 1e-3 ** (1 + 0.2 * len(p)) for p in order}, 1e-6
        for _ in range(rounds):
            got = _expected(counts[lang], rows, floor, longest)
            total = sum(got.values()) + smoothing * len(order)
            floor = smoothing / total
            rows = {p: (got.get(p, 0.0) + smoothing) / total for p in order}
        columns.append([rows[p] for p in order])
        floors.append(floor)
    return Unigrams(langs, order, np.array(columns, float).T.reshape(len(order), len(langs)), np.array(floors))


class _Scores(dict):
    """Word -> its row in a table of scores; starts anew when the table is full."""

    def __init__(self, model: Unigrams, source: object):
        super().__init__()
        self.model, self.table = model, np.empty((_CACHE_ROWS, len(model.langs)))
        self.source = source  # kept, so that its address isn't used again

    def _learn(self, words: set[str]) -> None:
        by_size: dict[int, list[str]] = defaultdict(list)
        for w in words:
            by_size[len(w)].append(w)
        for own in by_size.values():
            for a in range(0, len(own), 2000):
                part = own[a : a + 2000]
                first = len(self)
                self.table[first : first + len(part)] = self.model.forward_many(part)
                self.update(zip(part, range(first, first + len(part)), strict=True))

    def _sum(self, words: list[str]) -> np.ndarray:
        short = [w for w in words if len(w) <= _SHORT]
        total = self.table[np.fromiter(map(self.__getitem__, short), np.int64, len(short))].sum(axis=0)
        for w in words if len(short) < len(words) else ():
            if len(w) > _SHORT:
                total = total + self.model.forward(w)
        return total

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Summed scores of each text's words; words that are new to the table are learned together."""
        short = {w for words in texts for w in words if len(w) <= _SHORT}
        if len(short) > _CACHE_ROWS:  # more than the table holds: in halves
            if len(texts) > 1:
                return self.of(texts[: len(texts) // 2]) + self.of(texts[len(texts) // 2 :])
            middle = len(texts[0]) // 2
            return [self.of([texts[0][:middle]])[0] + self.of([texts[0][middle:]])[0]]
        if len(self) + len(short.difference(self)) > _CACHE_ROWS:
            self.clear()
        self._learn(short.difference(self))
        return [self._sum(words) for words in texts]


def train(df: DataFrame, vocab_path: str, eligible: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200) -> Unigrams:
    """Learn from at most per_language eligible rows of each language (the smallest hashes of the id)."""
    keys = df.where(eligible & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col)
    chosen = keys.select(id_col, lang_col).withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= per_language)
    # The sample has a known bound, so its ids may go to all tasks.
    sample = keys.join(F.broadcast(chosen.select(id_col).distinct()), id_col, "left_semi").select(lang_col, text_col)
    counts: dict[str, dict[str, int]] = defaultdict(dict)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(*batch.columns, strict=True):
                found = _WORDS(text.as_py().lower())
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(found), pa.string()), pa.array(found, pa.string())], names=["lang", "word"])

    for r in sample.mapInArrow(words, "lang string, word string").groupBy("lang", "word").count().toLocalIterator():
        counts[r["lang"]][r["word"]] = r["count"]
    return learn(counts, vocabulary_pieces(vocab_path))


def _send(df: DataFrame, model: Unigrams):
    return df.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.table, model.floor))


def _scored(sent, column: pa.Array) -> Iterator[tuple[str, float]]:
    """Language and score of each text of a batch."""
    scores = worker.held(("language", id(sent.value)), lambda: _Scores(Unigrams(*sent.value), sent.value))
    langs = scores.model.langs
    for at in range(0, len(column), _BLOCK_TEXTS):
        texts = [_WORDS((x.as_py() or "").lower()) if langs else [] for x in column[at : at + _BLOCK_TEXTS]]
        for words, logs in zip(texts, scores.of(texts), strict=True):
            if words:
                best = int(logs.argmax())
                yield langs[best], float(1 / np.exp(np.minimum(logs - logs[best], 0)).sum())
            else:
                yield UNDETERMINED, 0.0


def predict(df: DataFrame, model: Unigrams, text_col: str = "text", pass_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """pass_cols (but for such of the same names) with lang_pred and score."""
    kept = [df.schema[c] for c in pass_cols if c not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = _send(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, share = zip(*_scored(sent, batch.column(len(kept))), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(pred, pa.string()), pa.array(share, pa.float64())], names=schema.names)

    return df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def identified(df: DataFrame, model: Unigrams, text_col: str = "text") -> DataFrame:
    """df's rows that predict() gives a language. Where the model has none, the rows whose text has a letter: those
    that it would give one once it had any."""
    columns, sent = df.columns, _send(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(columns.index(text_col))
            if sent.value[0]:
                keep = [lang != UNDETERMINED for lang, _ in _scored(sent, texts)]
            else:
                keep = [bool(_WORDS((x.as_py() or "").lower())) for x in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
