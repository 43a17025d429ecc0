"""Language identification by unigram pieces, summed over all segmentations of a text.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum
over all ways to cut it into pieces, by the forward algorithm; pieces never cross words, so a text's is the
product over its words. Probabilities are fitted by expectation maximisation (forward and backward) on a
bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as tx
from .session import released


#: Words of up to so many bytes are summed in doubles: with at least _FLOOR for each byte, no sum underflows. Longer ones in logarithms.
SHORT_WORD = 33
#: The sample: about so many documents of each language, spread by a hash of doc_id, and as many languages at most.
DOCUMENTS_PER_LANGUAGE, LANGUAGES = 400, 500
_MARK = "▁".encode()
_FLOOR = 1e-9
_CACHE = 300_000


def vocabulary(model_file: str) -> list[bytes]:
    """All pieces; each single byte is one too, so that every word has a segmentation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    said = {model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    said = {x.replace(_MARK, b" ") for x in said}
    return sorted({x for x in said if x} | {bytes([i]) for i in range(256)})


class Pieces:
    """Looks pieces up by hash, in matrices of words of one length or in one long word."""

    def __init__(self, vocabulary: list[bytes]):
        flat = np.frombuffer(b"".join(vocabulary), np.uint8)
        edge = np.cumsum([0, *map(len, vocabulary)])
        hashes = tx.span_hash(tx.prefix_hash(flat), edge[:-1], edge[1:])
        self.order = np.argsort(hashes).astype(np.int32)
        self.keys = hashes[self.order]
        self.longest = max(map(len, vocabulary))

    def arcs(self, words: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For each end, (start, piece number or -1 of each word) of the pieces that may stand there."""
        n, width = words.shape
        up, down = tx.powers(width + 1)
        prefix = np.zeros((n, width + 1), np.uint64)
        np.cumsum(tx.BYTE_CODE[words] * up[:width], axis=1, out=prefix[:, 1:])
        out = []
        for end in range(1, width + 1):
            row = []
            for start in range(max(0, end - self.longest), end):
                h = tx.mix((prefix[:, end] - prefix[:, start]) * down[start])
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                if hit.any():
                    row.append((start, np.where(hit, self.order[at], -1)))
            out.append(row)
        return out

    def forward(self, arcs: list, weights: np.ndarray, n: int) -> np.ndarray:
        """Sums over segmentations of each prefix: (width + 1, words, languages). weights: (pieces + 1, languages), 0 last."""
        alpha = np.zeros((len(arcs) + 1, n, weights.shape[1]))
        alpha[0] = 1
        for end, row in enumerate(arcs, 1):
            for start, piece in row:
                alpha[end] += alpha[start] * weights[piece]
        return alpha

    def long_arcs(self, word: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each end in a word, starts and numbers of the pieces that stand there."""
        prefix = tx.prefix_hash(np.frombuffer(word, np.uint8))
        for a in range(1, len(word) + 1, 4096):
            b = min(a + 4096, len(word) + 1)
            end = np.repeat(np.arange(a, b), self.longest)
            start = end - np.tile(np.arange(self.longest, 0, -1), b - a)
            start, end = start[start >= 0], end[start >= 0]
            h = tx.span_hash(prefix, start, end)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            start, piece, edge = start[hit], self.order[at[hit]], np.searchsorted(end[hit], np.arange(a, b + 1)).tolist()
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                yield start[i:j], piece[i:j]

    def long_score(self, word: bytes, logs: np.ndarray) -> np.ndarray:
        """Log probability of a word of any length in each language; only the sums that a piece may still reach are held."""
        n = self.longest + 1
        alpha = np.zeros((n, logs.shape[1]))
        for end, (start, piece) in enumerate(self.long_arcs(word), 1):
            alpha[end % n] = np.logaddexp.reduce(alpha[start % n] + logs[piece], axis=0)
        return alpha[len(word) % n]

    def by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers and bytes of the words of up to ``SHORT_WORD`` bytes, by length."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(lens[lens <= SHORT_WORD]).tolist():
            at = np.flatnonzero(lens == size)
            for part in np.array_split(at, -(-len(at) // 4_000)):
                yield part, np.frombuffer(b"".join(words[i] for i in part.tolist()), np.uint8).reshape(len(part), size)

    def scores(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), weights.shape[1]))
        for at, matrix in self.by_length(words):
            out[at] = np.log(self.forward(self.arcs(matrix), weights, len(at))[-1])
        if many := [i for i, w in enumerate(words) if len(w) > SHORT_WORD]:
            logs = np.log(weights[:-1])
            for i in many:
                out[i] = self.long_score(words[i], logs)
        return out


def fit(words: list[bytes], counts: np.ndarray, pieces: Pieces, size: int, rounds: int = 3) -> np.ndarray:
    """Piece probabilities of each language, (size + 1, languages), from counts (words, languages)."""
    languages = counts.shape[1]
    weights = np.full((size + 1, languages), 1 / size)
    weights[-1] = 0
    many = [(i, np.flatnonzero(counts[i]), list(pieces.long_arcs(w))) for i, w in enumerate(words) if len(w) > SHORT_WORD]
    groups = [(at, matrix.shape[1], pieces.arcs(matrix)) for at, matrix in pieces.by_length(words)]
    for _ in range(rounds):
        seen = np.zeros_like(weights)
        for at, width, arcs in groups:
            alpha = pieces.forward(arcs, weights, len(at))
            beta = np.zeros_like(alpha)
            beta[width] = 1
            for end in range(width, 0, -1):
                for start, piece in arcs[end - 1]:
                    beta[start] += beta[end] * weights[piece]
            share = counts[at] / alpha[width]
            for end, row in enumerate(arcs, 1):
                for start, piece in row:
                    hit = np.flatnonzero(piece >= 0)
                    if len(hit):
                        p = piece[hit]
                        np.add.at(seen, p, (alpha[start][hit] * beta[end][hit] * weights[p]) * share[hit])
        logs = np.log(weights[:-1])
        for i, langs, arcs in many:
            alpha = np.zeros((len(arcs) + 1, len(langs)))
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for end, (start, piece) in enumerate(arcs, 1):
                alpha[end] = np.logaddexp.reduce(alpha[start] + logs[np.ix_(piece, langs)], axis=0)
            for end in range(len(arcs), 0, -1):
                start, piece = arcs[end - 1]
                w = logs[np.ix_(piece, langs)]
                beta[start] = np.logaddexp(beta[start], beta[end] + w)
                seen[np.ix_(piece, langs)] += np.exp(alpha[start] + w + beta[end] - alpha[-1]) * counts[i, langs]
        seen[-1] = 0
        weights = seen / np.maximum(seen.sum(axis=0), 1) + _FLOOR
        weights[-1] = 0
    return weights


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple:
    """Hash and bytes span of every word, and the first word of each text."""
    _, start, end, first = tx.word_hashes(data, offsets, tx.ALNUM)
    low = tx.ALNUM[data]
    return tx.span_hash(tx.prefix_hash(low), start, end), start, end, first, low


def _lettered(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    ascii_letter = np.concatenate([[0], np.cumsum(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in column[i].as_py())
    return out


class Model:
    def __init__(self, languages: list[str], vocabulary: list[bytes], weights: np.ndarray):
        self.languages, self.vocabulary, self.weights = languages, vocabulary, weights

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("languages", "vocabulary", "weights")}

    def score(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The best language and its posterior probability, all languages being as likely before."""
        if not hasattr(self, "pieces"):
            self.pieces = Pieces(self.vocabulary)
            self.known = np.zeros(0, np.uint64)
            self.values = np.zeros((0, len(self.languages)))
        hashes, start, end, first, low = _words(data, offsets)
        unique, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > _CACHE:
            self.known, self.values = self.known[:0], self.values[:0]
        place = np.searchsorted(self.known, unique)
        fresh = np.ones(len(unique), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != unique[inside]
        if fresh.any():
            raw = low.tobytes()
            new = [b" " + raw[i:j] for i, j in zip(start[at[fresh]].tolist(), end[at[fresh]].tolist(), strict=True)]
            where = place[fresh]
            self.known = np.insert(self.known, where, unique[fresh])
            self.values = np.insert(self.values, where, self.pieces.scores(new, self.weights), axis=0)
            place = np.searchsorted(self.known, unique)
        total = np.zeros((len(hashes) + 1, len(self.languages)))
        np.cumsum(self.values[place][which], axis=0, out=total[1:])
        each = total[first[1:]] - total[first[:-1]]
        each -= each.max(axis=1, keepdims=True)
        each = np.exp(each)
        each /= each.sum(axis=1, keepdims=True)
        best = each.argmax(axis=1)
        said = _lettered(column, data, offsets)
        return [self.languages[b] if s else "und" for b, s in zip(best.tolist(), said.tolist(), strict=True)], np.where(said, each[np.arange(len(best)), best], 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, model_file: str, per_language: int = DOCUMENTS_PER_LANGUAGE) -> Model:
    """A model from ``docs(doc_id, text, lang)``: rows with text and lang that are not held out.

    ``per_language`` bounds the sample (about so many documents of each language, chosen by a hash of doc_id); words
    are counted in tasks. Languages are those of the labelled rows, 500 at most.
    """
    labelled = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(F.expr("lang is not null and text is not null")).where(~held_out())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages, known = sorted(sizes), vocabulary(model_file)
    pieces = Pieces(known)
    if not languages:
        return Model(["und"], known, np.full((len(known) + 1, 1), _FLOOR))
    every = F.create_map(*[F.lit(x) for k in languages for x in (k, max(1, sizes[k] // per_language))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), every[F.col("lang")].cast("long")) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for a, b, data, offsets in tx.slices(batch.column("text")):
                _, start, end, first, low = _words(data, offsets)
                raw = low.tobytes()
                said = [b" " + raw[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
                frame = pd.DataFrame({"lang": np.repeat(langs[a:b], np.diff(first)), "word": said})
                frame = frame.groupby(["lang", "word"], sort=False).size().reset_index(name="n")
                yield pa.RecordBatch.from_pandas(frame, pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())]), preserve_index=False)

    rows = chosen.mapInArrow(released(count), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    code, words = pd.factorize(np.array([bytes(r.word) for r in rows] + [None], object)[:-1])
    counts = np.zeros((len(words), len(languages)))
    np.add.at(counts, (code, [languages.index(r.lang) for r in rows]), [r.n for r in rows])
    return Model(languages, known, fit(list(words), counts, pieces, len(known)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, held_out, lang_pred, score), one row for each row.

    score is the posterior probability of lang_pred, from 0 to 1; ties go to the first language by name.
    Null texts and those without a letter are ``und`` with score 0. Words are runs of digits, letters and
    anything outside ASCII (A-Z lowered); their number is not bounded. Repeated rows get equal
    results. Further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column("text")):
                langs, scores = shared.value.score(batch.column("text").slice(a, b - a), data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held_out())
    return rows.mapInArrow(released(score), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without rows that are ``und`` or score below ``least``; columns and texts stay as they are.

    All rows stay where the model has learned no language.
    """
    if model.languages == ["und"]:
        return docs
    shared, order, kinds = docs.sparkSession.sparkContext.broadcast(model), docs.columns, dict(docs.dtypes)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                langs, scores = shared.value.score(part.column("text"), data, offsets)
                yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(released(choose), ", ".join(f"`{c}` {kinds[c]}" for c in order))
