"""Toxicity by a weighted finite-state pattern grammar.

Words map to classes (slur, violent verb, intent, wish, death, pursuit, target, negation, reporting verb and the like;
a clause mark follows the word that ends a clause). Six small transducers rewrite the class sequence: insult (a slur, or a phrase
such as "piece of trash"), threat (an announced violent act, a wish of death, "watch your back", a pursuit announced twice),
negation (an insult or threat within three words after a negation), reported speech (until the clause ends), target before
(within four words) and target after (within three). Their composition is one deterministic machine, built once. Its outputs are
matches of a clause: an insult or threat, intended, aimed or not, negated, reported. A violent verb that is neither intended
nor aimed is no match. A document's score is the logistic of its matches' weights.

Slurs are learned: words and word beginnings that labelled rows show in toxic documents. The weights of
the machine's outputs start from a prior (a negated or reported insult counts for less) and are fitted to
the labels.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, slices, table

#: Labelled rows that the lexicon and the weights are fitted to (expected; drawn by a hash), and what a pattern needs
SAMPLE, SUPPORT, PURITY, EVIDENCE = 20_000, 5, 0.8, 21.0
#: Lengths of word beginnings that may become patterns, in characters; at least one more follows
STEMS = (3, 4, 5, 6, 7, 8)
CUT = 0.7

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END, SLUR, VIOLENT, INTENT, WISH, DEATH, PURSUIT, WATCH, BACK, PIECE, OF, DIRT = range(18)
# Fixed word lists of the grammar's closed classes, some languages together
WORDS = {
    VIOLENT: "kill murder hurt beat stab shoot strangle hang burn destroy töten umbringen schlagen erschießen tuer frapper étrangler matar golpear apuñalar",
    INTENT: "will gonna going shall i'll we'll werde werden vais allons voy vamos",
    WISH: "deserve deserves hope wish should verdienst verdient hoffe mérites mérite espère mereces merece espero",
    DEATH: "die dies dead death suffer sterben stirbst tot mourir meurs meure mort morir mueras muera muerto",
    PURSUIT: "find end finish hunt get finde finden beenden trouver finir chasser encontrar acabar cazar",
    WATCH: "watch", BACK: "back",
    PIECE: "piece waste pile bag stück haufen tas sac pedazo saco", OF: "of von de", DIRT: "trash garbage shit crap dirt space oxygen scheiße dreck müll merde ordures mierda basura",
    TARGET: "you your u ya yourself yourselves they them she he him her everyone du dich dir ihr euch sie tu te toi vous ils elle tú usted ustedes vosotros ellos",
    NEGATION: "not no never neither nor without isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine nie pas jamais aucun nunca jamás sin ni",
    REPORT: "said says wrote writes called calls quoted quotes quote claimed claims reported reports according sagte schrieb nannte laut dit écrit selon appelé dijo escribió llamó según",
}
CLASS_OF = {w: k for k, words in WORDS.items() for w in words.split()}

#: Outputs carry flags: 1 aimed before, 2 negated, 4 reported, 8 intended; an aimed-after mark adds to the match before it
AIMED, NEGATED, REPORTED, INTENDED = 1, 2, 4, 8
AFTER = 64
#: A threat's beginning and how many words it lasts: intent, wish, pursuit once announced, "watch", "watch your"
LASTS = {INTENT: 3, WISH: 4, PURSUIT: 4, WATCH: 1, BACK: 1}


class Transducer:
    """Deterministic, by a transition function over states; outputs are (class, flags)."""

    def __init__(self, start, step) -> None:
        self.start, self.step = start, step


def _insult(state: int, symbol: tuple[int, int]) -> tuple[int, tuple[int, int]]:
    kind, flags = symbol
    if kind == SLUR or kind == DIRT and state == 2:
        return 0, (INSULT, flags)
    return (1 if kind == PIECE else 2 if kind == OF and state == 1 else 0), symbol


def _threat(state: tuple[int, int], symbol: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
    kind, flags = symbol
    begun, left = state
    if kind == VIOLENT:
        return state, (THREAT, flags | (INTENDED if begun in (INTENT, PURSUIT) else 0))
    if (kind, begun) in ((DEATH, WISH), (PURSUIT, PURSUIT), (BACK, BACK)):
        return (0, 0), (THREAT, flags | INTENDED)
    if kind in (INTENT, WISH, WATCH):
        return (kind, LASTS[kind]), symbol
    if kind == PURSUIT and begun == INTENT:
        return (PURSUIT, LASTS[PURSUIT]), symbol
    if kind == TARGET and begun == WATCH:
        return (BACK, LASTS[BACK]), symbol
    if kind == TARGET and begun in (INTENT, PURSUIT):  # "will you and yours": a target takes no room
        return state, symbol
    return ((begun, left - 1) if left > 1 and kind != END else (0, 0)), symbol


def _negation(state: int, symbol: tuple[int, int]) -> tuple[int, tuple[int, int]]:
    kind, flags = symbol
    if kind in (INSULT, THREAT) and state:
        return state - 1, (kind, flags | NEGATED)
    return (3 if kind == NEGATION else 0 if kind == END else max(0, state - 1)), symbol


def _report(state: int, symbol: tuple[int, int]) -> tuple[int, tuple[int, int]]:
    kind, flags = symbol
    if kind in (INSULT, THREAT) and state:
        return state, (kind, flags | REPORTED)
    return (1 if kind == REPORT else 0 if kind == END else state), symbol


def _before(state: int, symbol: tuple[int, int]) -> tuple[int, tuple[int, int]]:
    kind, flags = symbol
    if kind in (INSULT, THREAT):
        return max(0, state - 1), (kind, flags | (AIMED if state else 0))
    return (4 if kind == TARGET else 0 if kind == END else max(0, state - 1)), symbol


def _after(state: int, symbol: tuple[int, int]) -> tuple[int, tuple[int, int]]:
    kind, flags = symbol
    if kind in (INSULT, THREAT):
        return 3, symbol
    if kind == TARGET and state:
        return 0, (kind, flags | AFTER)
    return (0 if kind == END else max(0, state - 1)), symbol


#: In the order in which they rewrite
PARTS = (Transducer(0, _insult), Transducer((0, 0), _threat), Transducer(0, _negation), Transducer(0, _report), Transducer(0, _before), Transducer(0, _after))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What second makes of first's output."""

    def step(state, symbol):
        a, middle = first.step(state[0], symbol)
        b, out = second.step(state[1], middle)
        return (a, b), out

    return Transducer((first.start, second.start), step)


@cache
def machine() -> tuple[list[list[int]], list[list[int]]]:
    """next[state][class] and output[state][class] (class * 128 + flags, or 0) of the composed grammar; state 0 starts."""
    t = reduce(compose, PARTS)
    numbers, todo, nxt, out = {t.start: 0}, deque([t.start]), [], []
    while todo:
        state = todo.popleft()
        row, emits = [], []
        for kind in range(18):
            to, (k, flags) = t.step(state, (kind, 0))
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
            emits.append(k * 128 + flags if k in (INSULT, THREAT) or flags else 0)
        nxt.append(row)
        out.append(emits)
    return nxt, out


#: Features of a document: matched clauses by kind; with the prior of their weights
KINDS = ("insult", "insult aimed", "insult negated", "insult reported", "threat", "threat aimed", "violence aimed", "threat held back", "further matches")
PRIOR = np.array([2.0, 2.5, 0.3, 0.5, 1.0, 6.0, 1.0, 0.2, 0.3])


class Classes(dict):
    """Class and lexicon strength of raw words, remembered up to a bound."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.lengths = sorted({len(k) - 1 for k in lexicon if k[-1] == "*"})

    def __missing__(self, raw: bytes) -> tuple[int, float, bool]:
        if len(self) > 300_000:
            self.clear()
        word, ends = letters(raw)
        strength = self.lexicon.get(word, 0.0)
        for n in self.lengths:
            if n >= len(word):
                break
            strength = max(strength, self.lexicon.get(word[:n] + "*", 0.0))
        kind = SLUR if strength else CLASS_OF.get(word, OTHER)
        self[raw] = got = (kind, strength, ends)
        return got


def letters(raw: bytes) -> tuple[str, bool]:
    """A word's lower-case core, and whether a clause ends with it."""
    w = raw.decode("utf-8", "replace")
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b].lower(), any(c in ".,;:!?" for c in w[b:])


class Grammar:
    def __init__(self, lexicon: dict[str, float]) -> None:
        self.next, self.output = machine()
        self.lexicon = lexicon
        self.classes = Classes(lexicon)

    def features(self, text: bytes | None) -> np.ndarray:
        """Matched clauses of each kind (the strongest match of a clause counts), as a slowly growing sum of strengths: 1 for one match."""
        x = np.zeros(len(KINDS))
        hits = 0
        for line in (text or b"").split(b"\n"):
            got = list(map(self.classes.__getitem__, line.split()))
            seen = {k for k, _, _ in got}
            if not (SLUR in seen or VIOLENT in seen or {WISH, DEATH} <= seen or {INTENT, PURSUIT} <= seen or {WATCH, BACK} <= seen or {PIECE, DIRT} <= seen):
                continue
            state, matches = 0, []
            for kind, strength, ends in got:
                if o := self.output[state][kind]:
                    if o // 128 in (INSULT, THREAT):
                        matches.append([o // 128, o % 128, strength or 1.0])
                    elif matches:
                        matches[-1][1] |= AIMED
                state = self.next[state][kind]
                if ends:
                    state = self.next[state][END]
                    hits += self._clause(matches, x)
                    matches = []
            hits += self._clause(matches, x)
        x[8] = max(0, hits - 1)
        return np.log1p(4 * x) / math.log(5)

    @staticmethod
    def _clause(matches: list, x: np.ndarray) -> int:
        """Count the clause's strongest match; how many matches it has that are neither negated nor reported."""
        matches = [m for m in matches if m[0] == INSULT or m[1] & (AIMED | INTENDED)]
        for kind, flags, strength in sorted(matches, key=lambda m: -m[2])[:1]:
            held = flags & (NEGATED | REPORTED)
            if kind == THREAT:
                x[7 if held else 4 if not flags & AIMED else 5 if flags & INTENDED else 6] += 1
            else:
                x[2 if flags & NEGATED else 3 if flags & REPORTED else 1 if flags & AIMED else 0] += strength
        return sum(not m[1] & (NEGATED | REPORTED) for m in matches)


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights

    def score(self, grammar: Grammar, text: bytes | None) -> float:
        return float(1 / (1 + math.exp(-min(30, max(-30, self.weights[:-1] @ grammar.features(text) + self.weights[-1])))))


def held_out():
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of words and word beginnings, by label."""
    known: dict[bytes, tuple[str, ...]] = {}
    for b in slices(batches, "text", 8 << 20):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(as_bytes(b.column("text")), b.column("toxic").to_pylist(), strict=True):
            own: set[str] = set()
            for raw in set((text or b"").split()):
                if raw not in known:
                    if len(known) > 200_000:
                        known.clear()
                    w = letters(raw)[0]
                    known[raw] = (w, *(w[:n] + "*" for n in STEMS if n < len(w))) if w.isalpha() and len(w) > 2 else ()
                own.update(known[raw])
            for f in own:
                counts.setdefault(f, [0, 0])[toxic] += 1
        yield pa.record_batch([pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))], names=["form", "clean", "toxic"])


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Forms with their strength (0 to 1), from rows (text, toxic)."""
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not toxic or not clean:
        return {}
    counts = rows.mapInArrow(_forms, "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # log-likelihood ratio of the form's share in toxic documents against chance; purity at equal class sizes
    p = toxic / (clean + toxic)
    c, t = F.col("c").cast("double"), F.col("t").cast("double")
    n = c + t
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    found = counts.where(t >= SUPPORT).withColumn("evidence", 2 * (term(t, n * p) + term(c, n * (1 - p)))).withColumn("purity", t / n)
    found = found.where((F.col("evidence") >= EVIDENCE) & (F.col("purity") >= PURITY))
    kept = found.collect()  # of forms in SUPPORT of the sample's toxic documents at least: bounded by the sample
    lexicon: dict[str, float] = {}
    pure: dict[str, float] = {}
    for r in sorted(kept, key=lambda r: (len(r["form"].rstrip("*")), r["form"])):
        word = r["form"].rstrip("*")
        shorter = max((pure.get(word[:n] + "*", 0.0) for n in range(3, len(word))), default=0.0)
        if shorter < r["purity"] - 0.1:  # a longer form only where it says clearly more
            pure[r["form"]] = r["purity"]
            lexicon[r["form"]] = min(1.0, math.log((r["t"] + 0.5) / (r["c"] + 0.5)) / 3)
    return lexicon


def _vectors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(shared.value)
        for b in slices(batches, "text"):
            x = [g.features(t).tolist() for t in as_bytes(b.column("text"))]
            yield pa.record_batch([b.column("doc_id"), b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    return run


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Logistic weights with a Gaussian prior around PRIOR, then the constant; Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w0 = np.append(PRIOR, -4.0)
    stiff = np.append(np.full(len(PRIOR), pull), 1e-3)
    w = w0.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - stiff * (w - w0)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(stiff), g)
        w += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit lexicon and weights to labelled rows that are not held out.

    A document with clashing labels counts as toxic; labels without doc_id or toxic are left out. Without labels of both classes the
    lexicon is empty and the weights are the prior's.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(own), "doc_id")  # sample rows at most
    lexicon = learn_lexicon(rows.select("text", "toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    got = rows.mapInArrow(_vectors(shared), "doc_id long, toxic int, x array<double>").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["x"]))
    if not got:
        return ToxicityModel(lexicon, np.append(PRIOR, -4.0))
    return ToxicityModel(lexicon, fit_weights(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)))


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        g = Grammar(model.lexicon)
        for b in slices(batches, "text"):
            s = [model.score(g, t) for t in as_bytes(b.column("text"))]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= CUT) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; null and empty texts have the score of no match.

    held_out is null where doc_id is. Repeated rows score alike, an empty table gives no rows, columns beyond doc_id and text are
    not read. Texts of any length are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held_out())
    return rows.mapInArrow(_scores(shared), "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
