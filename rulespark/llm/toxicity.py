"""Toxicity by a weighted finite-state grammar of clauses.

Three sources name the symbols of a clause: stems (beginnings of words) that the
labelled rows mark as insults, and two fixed lists of threats and of the words
for targets, negation and reported speech. Small transducers rewrite the symbols
of a clause one after another: reported speech and negation weaken an insult or
a threat that follows, a target next to it sharpens it. They are composed into
one transducer, once; running it over a clause gives the kinds of its matches.
The weight of each kind, of their rate and of their number come from a logistic
regression on labelled rows, so a text is scored by its matched clauses.

Learned from at most ``sample_rows`` labelled rows (those with the smallest
hashes of their ids), none of them held out. A stem is a beginning of words that
occurs, or occurs twice, in much more of the toxic rows than of the others; of
nested ones the shortest stands, made longer as long as that loses next to no
toxic row. Its log odds are its weight. Language, source and id are no inputs.

Null, empty and very long texts have a score; a text without matches has that of
no matches. Without labelled rows of both kinds every score is 0. Rows that
repeat or have no id are scored, and ids with several labels count as toxic if
one says so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm.shared import crc_bucket, slices, text_or_empty, written

WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]")
SHORTEST, LONGEST = 3, 8
#: a stem's least G statistic and log odds
LEAST_G, LEAST_ODDS = 35.0, 2.2
STEMS = 4000
TWICE = "\x02"

TARGETS = "you your you're he she they him her them this that we us du dich dir ihr euch er sie tu te toi vous il elle ils tú usted ellos ella él".split()
NEGATIONS = "not no never don't isn't aren't nicht kein keine nie ne pas jamais nunca".split()
REPORTS = "said says say told tells called calls wrote claims quoted according sagte sagt schrieb nannte dit dits écrit dijo dice escribió".split()
THREATS = "kill hurt destroy beat punch shoot stab burn hang töten umbringen schlagen tuer tuerai frapper matar golpear".split()

#: symbols that words become, and what the transducers make of them
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
WEAK_INSULT, WEAK_THREAT, AIMED_INSULT, AIMED_THREAT = range(6, 10)
SYMBOLS = 10
KINDS = (INSULT, THREAT, WEAK_INSULT, WEAK_THREAT, AIMED_INSULT, AIMED_THREAT)


class Transducer:
    """Deterministic: next[state][symbol] and what is written for the symbol."""

    def __init__(self, following: list[list[int]], written: list[list[int]]):
        self.following, self.written = following, written

    def then(self, other: Transducer) -> Transducer:
        """The transducer that feeds its output to ``other``; only pairs of
        states that can be reached."""
        number, todo = {(0, 0): 0}, [(0, 0)]
        following, written = [], []
        for a, b in todo:
            row, out = [], []
            for symbol in range(SYMBOLS):
                middle = self.written[a][symbol]
                pair = (self.following[a][symbol], other.following[b][middle])
                if pair not in number:
                    number[pair] = len(number)
                    todo.append(pair)
                row.append(number[pair])
                out.append(other.written[b][middle])
            following.append(row)
            written.append(out)
        return Transducer(following, written)

    def run(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for s in symbols:
            out.append(self.written[state][s])
            state = self.following[state][s]
        return out


def after(trigger: int, change: dict[int, int], reach: int) -> Transducer:
    """Rewrites symbols by ``change`` within ``reach`` symbols after ``trigger``."""
    same = list(range(SYMBOLS))
    changed = [change.get(s, s) for s in same]
    following = [[reach if s == trigger else max(state - 1, 0) for s in same] for state in range(reach + 1)]
    return Transducer(following, [same] + [changed] * reach)


def grammar() -> Transducer:
    """Reported speech, then negation, then targets."""
    weaker = {INSULT: WEAK_INSULT, THREAT: WEAK_THREAT}
    reported = after(REPORT, weaker, 8)
    negated = after(NEGATION, weaker, 3)
    aimed = after(TARGET, {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}, 3)
    return reported.then(negated).then(aimed)


def trie_pattern(stems: list[str]) -> str:
    """A pattern that matches any of ``stems`` at one place, branching once per
    letter."""
    root: dict = {}
    for stem in stems:
        node = root
        for c in stem:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        if "" in node:
            return ""
        parts = [re.escape(c) + write(child) for c, child in sorted(node.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return write(root)


class Scorer:
    def __init__(self, odds: dict[str, float], weights: np.ndarray | None = None):
        """odds: the weights of insults; those that end in $ are whole words,
        others are beginnings of words."""
        self.odds, self.weights = odds, weights
        self._ready = False

    def __getstate__(self):
        return {"odds": self.odds, "weights": self.weights, "_ready": False}

    def _prepare(self) -> None:
        self.stems = [s for s in self.odds if not s.endswith("$")]
        self.words = [s[:-1] for s in self.odds if s.endswith("$")]
        listed = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(THREATS, THREAT) | dict.fromkeys(self.words, INSULT)
        whole = [trie_pattern([w]) + r"(?![^\W\d_])" for w in sorted({*self.words, *THREATS})]
        found = ([trie_pattern(self.stems)] if self.stems else []) + whole
        self.hit = re.compile(r"(?<![^\W\d_])(?:" + "|".join(found) + ")")
        self.stem = re.compile(trie_pattern(self.stems)) if self.stems else None
        self.symbols, self.grammar, self._ready = listed, grammar(), True

    def _symbol(self, word: str) -> tuple[int, float]:
        """A word's symbol and weight."""
        s = self.symbols.get(word)
        if s is not None:
            return s, self.odds.get(word + "$", 1.0)
        m = self.stem.match(word) if self.stem is not None else None
        return (INSULT, self.odds[m[0]]) if m else (OTHER, 0.0)

    def clauses(self, text: str) -> list[list[tuple[int, float]]]:
        """The kinds and weights of the matches of each clause that has one."""
        if not self._ready:
            self._prepare()
        out, done = [], 0
        low = text.lower()
        for m in self.hit.finditer(low):
            if m.start() < done:
                continue
            start = max(low.rfind(c, done, m.start()) for c in ".!?;:\n") + 1 or done
            stop = CLAUSE_END.search(low, m.end())
            done = stop.start() if stop else len(low)
            symbols = [self._symbol(w) for w in WORD.findall(low, start, done)]
            kinds = self.grammar.run([s for s, _ in symbols])
            matched = [(k, w) for k, (_, w) in zip(kinds, symbols) if k in KINDS]
            if matched:
                out.append(matched)
        return out

    def features(self, text: str) -> np.ndarray:
        found = self.clauses(text)
        counts = Counter(k for c in found for k, _ in c)
        total = sum(counts.values())
        weight = sum(w for c in found for _, w in c)
        words = text.count(" ") + text.count("\n") + 1
        rates = (np.log1p(1000 * total / words), np.log1p(1000 * weight / words))
        return np.array([1.0, *(np.log1p(counts[k]) for k in KINDS), np.log1p(len(found)), np.log1p(total), np.log1p(weight), *rates, float(total > 0), float(total > 1), np.log(words) * (total > 0)])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def beginnings(text: str) -> set[str]:
    """The beginnings of a text's words, and the words themselves with an end
    mark; with another mark also, if they occur twice."""
    counts: Counter = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        if len(w) <= 40:
            counts[w + "$"] += n
            for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                counts[w[:k]] += n
    return {*counts, *(s + TWICE for s, n in counts.items() if n > 1)}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        for label, counter in enumerate(counts):
            yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.string()), pa.array([label] * len(counter), pa.int32()), pa.array(list(counter.values()), pa.int64())], names=["stem", "toxic", "n"])
            counter.clear()

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[toxic].update(beginnings(text))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield from flush()
    yield from flush()


def choose(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The weights of the stems, out of (beginning, toxic rows, clean rows)."""

    def statistic(p: int, n: int) -> tuple[float, float]:
        share = (p + n) / (toxic + clean)
        g = sum(2 * o * np.log(o / e) for o, e in ((p, share * toxic), (n, share * clean), (toxic - p, (1 - share) * toxic), (clean - n, (1 - share) * clean)) if o > 0 and e > 0)
        return g, float(np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1)))

    good: dict[str, tuple[int, float]] = {}
    for s, p, n in rows:
        g, odds = statistic(p, n)
        stem = s.rstrip(TWICE)
        if g >= LEAST_G and odds >= LEAST_ODDS and (stem not in good or odds > good[stem][1]):
            good[stem] = (p, odds)
    out: dict[str, float] = {}
    short: list[str] = []
    for s in sorted(good, key=len):
        if any(s.startswith(t) for t in short):
            continue
        short.append(s)
        longer = max((t for t in good if t.startswith(s) and good[t][0] >= 0.95 * good[s][0]), key=len)
        out[longer] = good[longer][1]
    return out


def _featured(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [scorer.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w + np.linalg.solve(h, x.T @ (y - p) - penalty * w)
    return w


def learn(rows: DataFrame) -> Scorer:
    """A scorer from a bounded sample of rows (text, toxic), none of them null;
    some numbers of each row come to the driver."""
    sample = written(rows.select("text", "toxic"), "labelled-rows").repartition(12)
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Scorer({})
    counts = sample.mapInArrow(_counted, "stem string, toxic int, n long").groupBy("stem")
    counts = counts.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    likely = counts.where((F.col("p") >= 5) & (F.col("p") * clean > 6 * F.col("q") * toxic)).orderBy(F.desc("p"), "stem").limit(STEMS).collect()
    scorer = Scorer(choose([(r["stem"], r["p"], r["q"]) for r in likely], toxic, clean))
    table = sample.mapInArrow(_featured(scorer), "toxic int, x array<double>").toArrow()
    scorer.weights = fit(np.array(table["x"].to_pylist()), table["toxic"].to_numpy().astype(float))
    return scorer


def _scored(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = scorer.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(score)], names=["id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic", part: int = 1, of: int = 3, sample_rows: int = 12_000, bar: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text"))
    out = F.coalesce(crc_bucket("id", of) == part, F.lit(False))
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.where(~out).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    scorer = learn(rows.join(F.broadcast(chosen), "id"))
    scored = rows.select("id", out.alias("held_out"), "text").mapInArrow(_scored(scorer), "id long, held_out boolean, score double")
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= bar).cast("int").alias("predicted"))
