"""Language identification: segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from llm.shared import held
from llm.windows import mix

#: Longest piece, in characters.
PIECE = 6
#: Characters of a word that are scored; the rest of a longer word is scored as further words.
WORD = 24
#: Labelled documents per language that the model learns from, and the words of each language.
SAMPLE_DOCS, SAMPLE_WORDS = 400, 8000
ROUNDS = 4
#: Expected uses that every piece has before any is seen.
PRIOR = 0.1
#: Words whose scores a worker keeps.
CACHE = 300_000
UNKNOWN = "und"

#: Bits of the slot that a piece's hash leads to, and the odd multiplier of those hashes.
_SLOTS, _BASE = 20, np.uint64(0x9E3779B97F4A7C15)

_LETTERS = re.compile(r"[^\W\d_]+")


class Vocabulary(dict):
    """Piece numbers from 1, and a hash table in arrays that finds the numbers of many pieces at once."""

    def __init__(self, found: set[str]):
        super().__init__((p, i) for i, p in enumerate(sorted(found), 1))
        codes = np.array(sorted(found) or [""], f"<U{PIECE}").view(np.uint32).reshape(-1, PIECE).astype(np.uint64)
        keys = np.zeros(len(codes), np.uint64)
        for column in codes.T[::-1]:
            keys = np.where(column > 0, column + _BASE * keys, keys)
        keys = mix(keys)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64(0))
        self.numbers = np.append(order + 1, 0).astype(np.int32)
        slots = self.keys[:-1] >> np.uint64(64 - _SLOTS)
        self.starts = np.searchsorted(slots, np.arange(1 << _SLOTS, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.unique(slots, return_counts=True)[1].max())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; 0 for none."""
        keys = mix(hashes)
        at = self.starts[keys >> np.uint64(64 - _SLOTS)]
        out = np.zeros(keys.shape, np.int32)
        for step in range(self.deepest):
            near = np.minimum(at + step, len(self.keys) - 1)
            out = np.where(self.keys[near] == keys, self.numbers[near], out)
        return out


@cache
def pieces(path: str) -> Vocabulary:
    """The public vocabulary's pieces of letters (a word starts with the mark of a space), numbered from 1."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    found = {p for p in found if 0 < len(p) <= PIECE and (p == "▁" or _LETTERS.fullmatch(p.removeprefix("▁")))}
    return Vocabulary(found)


def words_of(text: str) -> list[str]:
    return [w[i:i + WORD] for w in _LETTERS.findall(text.lower()) for i in range(0, len(w), WORD)]


def lattice(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """[word, end, length - 1]: the piece that ends there, 0 for none, -1 past the word's end.

    A single character outside the vocabulary is the unknown piece, the last number, so that every word
    has a segmentation.
    """
    longest = max(map(len, words), default=0) + 1
    codes = np.array(["▁" + w for w in words], f"<U{longest}").view(np.uint32).reshape(len(words), longest).astype(np.uint64)
    out = np.zeros((len(words), longest, PIECE), np.int32)
    hashes = np.zeros_like(codes)
    for n in range(1, min(PIECE, longest) + 1):
        # the n characters up to each end: the first one, then the hash of the n - 1 up to the same end
        hashes = codes[:, :longest - n + 1] + _BASE * hashes[:, 1 if n > 1 else 0:]
        out[:, n - 1:, n - 1] = vocabulary.find(hashes)
    single = out[:, :, 0]
    single[single == 0] = len(vocabulary) + 1
    out[codes == 0] = -1
    return out


def forward(edges: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """[word, position, language]: probability of the first characters, summed over all segmentations."""
    words, longest, _ = edges.shape
    alpha = np.zeros((words, longest + 1, chance.shape[1]))
    alpha[:, 0] = 1.0
    for end in range(1, longest + 1):
        for n in range(1, min(PIECE, end) + 1):
            alpha[:, end] += alpha[:, end - n] * chance[edges[:, end - 1, n - 1]]
    return alpha


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: [piece, language]; row 0 and the last row but one stand for no piece and the unknown piece.
    chance: np.ndarray

    def scores(self, words: list[str], vocabulary: Vocabulary) -> np.ndarray:
        """[word, language]: log-probability of each word."""
        edges = lattice(words, vocabulary)
        alpha = forward(edges, self.chance)
        ends = (edges[:, :, 0] >= 0).sum(axis=1)
        return np.log(np.maximum(alpha[np.arange(len(words)), ends], 1e-300))


def _table(counts: np.ndarray) -> np.ndarray:
    """Probabilities by piece from expected counts, with rows for no piece (first, and last for padding)."""
    counts = counts + PRIOR
    counts[0] = 0
    chance = counts / counts.sum()
    return np.append(chance, 0.0)


def learn(samples: dict[str, Counter], vocabulary: Vocabulary) -> Model:
    """Piece probabilities of each language by expectation maximisation over all segmentations."""
    size, columns = len(vocabulary) + 2, []
    for lang in sorted(samples):
        counted = samples[lang].most_common()
        edges = lattice([w for w, _ in counted], vocabulary)
        weight = np.array([n for _, n in counted], float)
        used = np.ones(size)
        for _ in range(ROUNDS):
            chance = _table(used)[:, None]
            used = _expected(edges, weight, chance, size)
        columns.append(_table(used))
    return Model(tuple(sorted(samples)), np.stack(columns, axis=1) if columns else np.zeros((size + 1, 0)))


def _expected(edges: np.ndarray, weight: np.ndarray, chance: np.ndarray, size: int) -> np.ndarray:
    """Expected uses of each piece: forward and backward sums over every segmentation."""
    words, longest, _ = edges.shape
    alpha = forward(edges, chance)[:, :, 0]
    ends = (edges[:, :, 0] >= 0).sum(axis=1)
    beta = np.zeros((words, longest + 1))
    beta[np.arange(words), ends] = 1.0
    for start in range(longest - 1, -1, -1):
        for n in range(1, min(PIECE, longest - start) + 1):
            beta[:, start] += beta[:, start + n] * chance[edges[:, start + n - 1, n - 1], 0]
    scale = weight / np.maximum(alpha[np.arange(words), ends], 1e-300)
    used = np.zeros(size)
    for end in range(1, longest + 1):
        for n in range(1, min(PIECE, end) + 1):
            ids = edges[:, end - 1, n - 1]
            share = scale * alpha[:, end - n] * chance[ids, 0] * beta[:, end]
            used += np.bincount(np.maximum(ids, 0), share * (ids >= 0), size)
    used[0] = 0
    return used


def fit(labelled: DataFrame, path: str, docs: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> Model:
    """Learn from (doc_id, text, lang), from about ``docs`` documents of each language.

    The languages are counted first; a document is taken if its hash lies in the share that gives ``docs``
    of its language, so the sample is the same each time and no text is shuffled. Of these the ``words`` most
    frequent of each language count. Rows without text or lang are left out; what reaches the driver is
    bounded by ``words`` times the number of languages.
    """
    known = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.count("*").alias("documents"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    sample = known.join(F.broadcast(counts), "lang").where(place * F.col("documents") < docs)  # one row per language

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
                 pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    counted = sample.select("text", "lang").mapInArrow(split, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    rows = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= words).collect()
    samples: dict[str, Counter] = {}
    for row in rows:
        samples.setdefault(row["lang"], Counter())[row["word"]] = row["n"]
    return learn(samples, pieces(path))


class _Scores(dict):
    """Row number of each word's scores in a table that grows as words are met."""

    def __init__(self, model: Model, path: str):
        self.model, self.vocabulary = model, pieces(path)
        self.table = np.zeros((0, len(model.langs)))

    def meet(self, words: set[str]) -> None:
        if len(self) > CACHE:
            self.clear()
            self.table = self.table[:0]
        new = [w for w in words if w not in self]
        parts = [self.table]
        for i in range(0, len(new), 4096):
            part = sorted(new[i:i + 4096], key=len)
            self.update(zip(part, range(sum(map(len, parts)), sum(map(len, parts)) + len(part)), strict=True))
            parts.append(self.model.scores(part, self.vocabulary))
        self.table = np.concatenate(parts)


def identify(docs: DataFrame, model: Model, path: str, keep: list[str] | None = None) -> DataFrame:
    """row, lang_pred, score for every row of ``docs`` (text and others); ``row`` has the columns ``keep``, or all.

    A word's probability in a language is the sum over all its segmentations into pieces of the public
    vocabulary at ``path`` (a forward pass); a text's score is the product over its words, and ``score``
    the winner's posterior. Only the text is looked at. A narrow job without shuffle; the model is a table
    of fixed size (vocabulary times languages), and words once scored are kept in a bounded table.

    Null text, or text without a letter, is ``und`` with score 0; so is everything if no language was
    learned. Equal scores go to the first language by name. Repeated rows and rows without an id stay;
    columns of any name may stand in ``row``; an empty table gives no rows.
    """
    number = hash((model.langs, model.chance.tobytes()))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, langs = held(("scores", number), lambda: _Scores(shipped.value, path)), shipped.value.langs
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                split = [words_of(t.as_py() or "") if langs else [] for t in part.column("text")]
                scores.meet({w for words in split for w in words})
                predicted, sure = [], []
                for words in split:
                    if not words:
                        predicted.append(UNKNOWN)
                        sure.append(0.0)
                        continue
                    rows = np.fromiter(map(scores.__getitem__, words), np.int64, len(words))
                    total = scores.table[rows].sum(axis=0)
                    best = int(total.argmax())
                    predicted.append(langs[best])
                    sure.append(float(1.0 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(predicted, pa.string()), pa.array(sure, pa.float64())],
                    ["row", "lang_pred", "score"])

    row = F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns))
    read = docs.select(row.alias("row"), "text")
    out = StructType().add("row", read.schema["row"].dataType).add("lang_pred", "string").add("score", "double")
    return read.mapInArrow(of, out)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learn from the labelled rows that are not held out, then identify all."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), path)
    found = identify(docs, model, path, ["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
