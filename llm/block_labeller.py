"""HTML extraction: a bidirectional LSTM labels every leaf block of a page as main text or not."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.html_blocks import NEAR, PATH, WORDS, Block, leaf_blocks
from llm.sample_pages import sample_pages
from llm.shared import slices

#: Cells in each direction.
CELLS = 16
NUMBERS = 8
#: Pages that the model is trained on, made by ``sample_pages``, and passes over them.
PAGES, PASSES, BATCH, RATE = 400, 8, 20, 0.01
#: Pages that are labelled together.
TOGETHER = 256

_DIGITS = re.compile(r"\d")


def numbers(block: Block, place: float) -> list[float]:
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    return [
        np.log1p(n) / 8, np.log1p(words) / 6, min(block.linked / n, 1.0), float(text[-1] in ".!?:;\"'”»"),
        len(_DIGITS.findall(text)) / n, text.count(",") / words, float(block.name[:1] == "h" and block.name[1:].isdigit()), place]


_buckets: dict[str, int] = {}


def _word_vector(text: str) -> np.ndarray:
    found = []
    for word in text.lower().split():
        bucket = _buckets.get(word)
        if bucket is None:
            bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
            if len(_buckets) < 200_000:
                _buckets[word] = bucket
        found.append(bucket)
    counts = np.bincount(found, minlength=WORDS)
    return counts / max(1, len(found))


def bits(mask: int, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask.to_bytes(width // 8, "little"), np.uint8), bitorder="little")


def vectors(blocks: list[Block]) -> np.ndarray:
    """[block, feature]: words and numbers, then the hashed path."""
    n = len(blocks)
    out = np.empty((n, WORDS + NUMBERS + PATH + NEAR), np.float32)
    for i, (row, block) in enumerate(zip(out, blocks, strict=True)):
        row[:WORDS] = _word_vector(block.text)
        row[WORDS:WORDS + NUMBERS] = numbers(block, i / n)
        row[WORDS + NUMBERS:] = _path_vector(block.path, block.near)
    return out


@cache
def _known_path(path: int, near: int) -> np.ndarray:
    return np.concatenate([bits(path, PATH), bits(near, NEAR)]).astype(np.float32)


def _path_vector(path: int, near: int) -> np.ndarray:
    if _known_path.cache_info().currsize > 20_000:
        _known_path.cache_clear()
    return _known_path(path, near)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights: input, recurrent and bias of the forward and the backward cells; the output layer."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(features: int, seed: int = 7) -> Labeller:
        draw = np.random.default_rng(seed)
        weights = {}
        for way in "fb":
            weights[f"{way}x"] = draw.normal(0, features ** -0.5, (features, 4 * CELLS))
            weights[f"{way}h"] = draw.normal(0, CELLS ** -0.5, (CELLS, 4 * CELLS))
            weights[f"{way}0"] = np.repeat([0.0, 1.0, 0.0, 0.0], CELLS)
        weights["o"], weights["o0"] = draw.normal(0, (2 * CELLS) ** -0.5, 2 * CELLS), np.zeros(1)
        return Labeller({k: v.astype(np.float32) for k, v in weights.items()})

    def run(self, way: str, x: np.ndarray, mask: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """States of one direction: x is [step, page, feature], mask [step, page]; padding leaves a state as it is."""
        w, steps, pages = self.weights, len(x), x.shape[1]
        inputs = (x.reshape(steps * pages, -1) @ w[f"{way}x"] + w[f"{way}0"]).reshape(steps, pages, -1)
        h = c = np.zeros((pages, CELLS), np.float32)
        out = []
        for t in range(steps):
            gates = inputs[t] + h @ w[f"{way}h"]
            gates[:, :3 * CELLS] = _sigmoid(gates[:, :3 * CELLS])
            gates[:, 3 * CELLS:] = np.tanh(gates[:, 3 * CELLS:])
            i, f, o, g = np.split(gates, 4, axis=1)
            new = f * c + i * g
            m = mask[t][:, None]
            c, before, old = np.where(m, new, c), c, h
            h = np.where(m, o * np.tanh(new), h)
            out.append((gates, new, before, old, h))
        return out

    def chances(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list, list]:
        ahead, back = self.run("f", x, mask), self.run("b", x[::-1], mask[::-1])
        states = np.concatenate([np.stack([s[-1] for s in ahead]), np.stack([s[-1] for s in back])[::-1]], axis=2)
        return _sigmoid(states @ self.weights["o"] + self.weights["o0"]), ahead, back

    def gradients(self, x: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over blocks, by back-propagation through both directions."""
        chance, ahead, back = self.chances(x, mask)
        delta = (chance - truth) * mask / mask.sum()
        states = np.concatenate([np.stack([s[-1] for s in ahead]), np.stack([s[-1] for s in back])[::-1]], axis=2)
        found = {"o": np.einsum("tp,tpc->c", delta, states), "o0": np.array([delta.sum()])}
        for way, run, inputs, kept, part in (
            ("f", ahead, x, mask, slice(0, CELLS)), ("b", back, x[::-1], mask[::-1], slice(CELLS, None))):
            turned = delta if way == "f" else delta[::-1]
            found |= self._through(way, run, inputs, kept, turned[:, :, None] * self.weights["o"][part])
        return found

    def _through(self, way: str, run: list, x: np.ndarray, mask: np.ndarray, delta: np.ndarray) -> dict[str, np.ndarray]:
        recurrent = self.weights[f"{way}h"]
        dx, dh, d0 = np.zeros_like(self.weights[f"{way}x"]), np.zeros_like(recurrent), np.zeros(4 * CELLS, np.float32)
        later = carried = np.zeros_like(delta[0])
        for t in range(len(run) - 1, -1, -1):
            gates, new, before, old, _ = run[t]
            i, f, o, g = np.split(gates, 4, axis=1)
            m = mask[t][:, None]
            total = later + delta[t]
            squashed = np.tanh(new)
            cell = np.where(m, carried + total * o * (1 - squashed ** 2), 0)
            raw = np.concatenate([
                cell * g * i * (1 - i), cell * before * f * (1 - f), np.where(m, total, 0) * squashed * o * (1 - o),
                cell * i * (1 - g ** 2)], axis=1)
            dx += x[t].T @ raw
            dh += old.T @ raw
            d0 += raw.sum(axis=0)
            later = np.where(m, raw @ recurrent.T, total)
            carried = np.where(m, cell * f, carried)
        return {f"{way}x": dx, f"{way}h": dh, f"{way}0": d0}


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), bool)
    for i, page in enumerate(pages):
        x[:len(page), i], mask[:len(page), i] = page, True
    return x, mask


def train(seed: int = 11) -> Labeller:
    """Fit on made pages whose blocks are known, with Adam; the same weights each time."""
    pages = [(vectors(blocks), np.array(truth, np.float32)) for blocks, truth in sample_pages(PAGES, seed) if blocks]
    model = Labeller.fresh(pages[0][0].shape[1])
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    draw, step = np.random.default_rng(seed), 0
    for _ in range(PASSES):
        order = draw.permutation(len(pages))
        for i in range(0, len(order), BATCH):
            some = [pages[j] for j in order[i:i + BATCH]]
            x, mask = padded([p for p, _ in some])
            truth = np.zeros(mask.shape, np.float32)
            for j, (_, t) in enumerate(some):
                truth[:len(t), j] = t
            step += 1
            for k, d in model.gradients(x, mask, truth).items():
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.001 * (d ** 2 - second[k])
                model.weights[k] -= (RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def label(model: Labeller, pages: list[list[Block]]) -> list[list[bool]]:
    """For each block of each page, whether it is main text. Pages of like length go together."""
    out: list[list[bool]] = [[] for _ in pages]
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        longest = len(pages[order[-1]])
        some = order[-max(1, min(TOGETHER, 20_000 // longest)):]
        del order[-len(some):]
        x, mask = padded([vectors(pages[i]) for i in some])
        chance = model.chances(x, mask)[0]
        for j, i in enumerate(some):
            out[i] = (chance[:len(pages[i]), j] >= 0.5).tolist()
    return out


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    The page is cut into leaf blocks; a bidirectional LSTM reads their hashed tag paths and words in order,
    so that every block is judged in the context of the whole page, and the blocks it takes for main
    text are joined by line feeds. The model is of fixed size, trained once on the driver on made pages
    (``PAGES`` of them) and broadcast. A narrow job: no shuffle, a few pages at a time.

    Null or empty html, or a page without main text, gives an empty text; null ids and urls and repeated
    rows stay; further columns are ignored; an empty table gives no rows.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model or train())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [leaf_blocks(h or "") for h in part.column("html").to_pylist()]
                texts = ["\n".join([b.text for b, main in zip(blocks, marked, strict=True) if main])
                         for blocks, marked in zip(found, label(shipped.value, found), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(of, f"page_id {kind}, url string, text string, n_chars long")
