"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

States are boilerplate (0) and main text (1). A block's score for main text is the sum of its features'
weights (ancestors' tags and class names, the leaf's tag, length, link share, punctuation); neighbours are
tied by transition weights. Training follows the gradient of the conditional likelihood (forward-backward)
over labelled pages; decoding is Viterbi.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .html_blocks import Parser
from .html_training import labelled_pages

#: Training pages and passes over them: parameters of the model, whatever the input
TRAIN_PAGES, EPOCHS, RATE, DECAY = 1000, 10, 0.3, 3e-3


def _lse(a: float, b: float) -> float:
    return (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))


class Crf:
    """weights: of features, for main text; moves[i][j]: of going from state i to j.

    A page's first block has no weight of its own: it is main text as readily as any other.
    """

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.moves = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, blocks: list[set[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in b) for b in blocks]

    def decode(self, blocks: list[set[str]]) -> list[int]:
        """The likeliest states."""
        if not blocks:
            return []
        m, back = self.moves, []
        s = self.scores(blocks)
        a, b = 0.0, s[0]
        for x in s[1:]:
            to0, to1 = (a + m[0][0], b + m[1][0]), (a + m[0][1], b + m[1][1])
            back.append((to0[1] > to0[0], to1[1] > to1[0]))
            a, b = max(to0), max(to1) + x
        state = int(b > a)
        out = [state]
        for k in reversed(back):
            state = int(k[state])
            out.append(state)
        return out[::-1]

    def marginals(self, blocks: list[set[str]]) -> tuple[list[float], list[list[list[float]]]]:
        """P(main text) of each block and the joint probabilities of each pair of neighbours."""
        s, m = self.scores(blocks), self.moves
        n = len(s)
        alpha = [(0.0, s[0])]
        for x in s[1:]:
            a, b = alpha[-1]
            alpha.append((_lse(a + m[0][0], b + m[1][0]), _lse(a + m[0][1], b + m[1][1]) + x))
        beta = [(0.0, 0.0)] * n
        for i in range(n - 2, -1, -1):
            c, d = beta[i + 1]
            d += s[i + 1]
            beta[i] = (_lse(m[0][0] + c, m[0][1] + d), _lse(m[1][0] + c, m[1][1] + d))
        z = _lse(*alpha[-1])
        one = [math.exp(alpha[i][1] + beta[i][1] - z) for i in range(n)]
        pairs = [[[math.exp(alpha[i][p] + m[p][q] + (s[i + 1] if q else 0.0) + beta[i + 1][q] - z) for q in (0, 1)] for p in (0, 1)] for i in range(n - 1)]
        return one, pairs

    def fit(self, pages: list[tuple[list[set[str]], list[int]]], epochs: int = EPOCHS) -> Crf:
        """AdaGrad on the conditional log-likelihood, page by page, in the order given."""
        squares: dict = {}

        def step(key, gradient: float, value: float) -> float:
            gradient -= DECAY * value
            squares[key] = squares.get(key, 1e-6) + gradient * gradient
            return value + RATE * gradient / math.sqrt(squares[key])

        for _ in range(epochs):
            for blocks, states in pages:
                if not blocks:
                    continue
                one, pairs = self.marginals(blocks)
                gradient: dict[str, float] = {}
                for b, p, y in zip(blocks, one, states, strict=True):
                    if abs(y - p) > 1e-4:
                        for f in sorted(b):
                            gradient[f] = gradient.get(f, 0.0) + y - p
                for f, g in gradient.items():
                    self.weights[f] = step(f, g, self.weights.get(f, 0.0))
                for p in (0, 1):
                    for q in (0, 1):
                        g = sum((states[i] == p and states[i + 1] == q) - pairs[i][p][q] for i in range(len(pairs)))
                        self.moves[p][q] = step(("move", p, q), g, self.moves[p][q])
        return self


def train(pages: int = TRAIN_PAGES, seed: int = 11) -> Crf:
    """A model fitted to the generated labelled pages; always the same."""
    parser, examples = Parser(), []
    for page, labels in labelled_pages(pages, seed):
        blocks = parser.blocks(page)
        if len(blocks) == len(labels):
            examples.append(([f for _, f in blocks], [int(main) for _, main in labels]))
    return Crf().fit(examples)


def main_text(page: str | None, model: Crf, parser: Parser) -> str:
    blocks = parser.blocks(page)
    return "\n\n".join(t for (t, _), y in zip(blocks, model.decode([f for _, f in blocks]), strict=True) if y)


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        parser = Parser(frozenset(model.weights))
        for b in slices(batches, "html"):
            texts = [main_text(x, model, parser) for x in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    A null or empty page gives the empty text; repeated rows give repeated results; an empty table gives no rows; columns
    beyond these three are not read. Pages of any length and depth are read whole. The model (some hundred weights) is the only
    thing broadcast.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
