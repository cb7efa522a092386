"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses. The lexical transducer names a clause's insults, threats, targets, negations and verbs of report,
with weights. The negation machine marks a hit in the scope of a negation, the report machine a hit that someone is quoted
with, the target machines a hit next to a person or group, on either side. These are composed once into one machine over
word classes (and one from the right), whose arcs name a hit's kind. Its weights add up to a score of each kind for a
clause, and a logistic regression over the matched clauses of a text gives its score.

Insults start from a short list. Others are learned from labelled texts as word stems, weighted by how much more often
they occur in toxic ones, so the grammar isn't tied to a language.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, prepare
from .training import fit_logistic, labelled_sample, sigmoid

INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash clown clowns pathetic worthless disgusting filth filthy imbecile fool vermin garbage creep coward pig swine bastard bitch asshole jerk retard freak parasite degenerate ugly useless crétin connard imbécile salaud ordure abruti dummkopf arschloch trottel abschaum versager idiota imbécil estúpido basura escoria cabrón"
THREATS = "kill kills murder hurt destroy beat stab shoot hang burn die tuer crever töten umbringen matar morir"
TARGETS = "you your you're yours u they them their he she him her people everyone those these women men immigrants tu te vous ton votre ils elles eux du dich dir ihr euch sie eure tú usted ustedes ellos ellas vosotros"
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't nobody nothing without ne pas jamais aucun nicht kein keine nie niemand nunca jamás nadie sin"
REPORTS = "said says say called calls claimed claims quoted quotes wrote tweeted accused reportedly allegedly dit disait écrit appelle sagte sagt schrieb nannte dijo dice escribió llamó"

STEMS = (4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W\d_]+(?:'[a-z]+)?")
CLAUSE = re.compile(r"[.!?;:,\n|]+")
#: Distinct words that a worker remembers the tag of.
REMEMBERED = 400_000


class Lexicon:
    """The lexical transducer: word -> (tag, weight). ``stems`` has the learned weights."""

    def __init__(self, stems: dict[str, float], seed_weight: float = 4.0):
        self.stems = stems
        #: Where stems start; few words share one of these.
        self.heads = {x[: STEMS[0]] for x in stems}
        self.fixed = {}
        for tag, words, weight in (("R", REPORTS, 0.0), ("N", NEGATIONS, 0.0), ("T", TARGETS, 0.0), ("H", THREATS, 1.0), ("I", INSULTS, seed_weight)):
            self.fixed.update(dict.fromkeys(words.split(), (tag, weight)))
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, float]] = {}

    def tag(self, word: str) -> tuple[str, float] | None:
        if word in self.fixed:
            return self.fixed[word]
        if word[: STEMS[0]] not in self.heads:
            return None
        best = max((self.stems.get(word[:k], 0.0) for k in STEMS if k <= len(word)), default=0.0)
        return ("I", best) if best > 0 else None

    def learn(self, words: set[str]) -> None:
        if len(self.seen) > REMEMBERED:
            self.seen, self.hits = set(), {}
        for w in words - self.seen:
            self.seen.add(w)
            t = self.tag(w)
            if t and t[0] in "IH":
                self.hits[w] = t


# ---------------------------------------------------------------- the grammar

CLASSES = "-IHTNR"
#: What the composed machine says of a hit.
KINDS = ("none", "plain", "target", "negated", "reported")


class Transducer:
    """A sequential machine over symbols: ``next[state][symbol]`` and ``out[state][symbol]``, starting in state 0."""

    def __init__(self, next_: list[list[int]], out: list[list[tuple]]):
        self.next, self.out = next_, out

    def run(self, symbols) -> list[tuple]:
        state, said = 0, []
        for x in symbols:
            said.append(self.out[state][x])
            state = self.next[state][x]
        return said


def scope(opener: str, width: int, name: str, symbols: int = len(CLASSES)) -> Transducer:
    """Says ``(name,)`` of insults and threats at most ``width`` words after ``opener``; the state is how long the scope stays open."""
    opens, hits = CLASSES.index(opener), (CLASSES.index("I"), CLASSES.index("H"))
    next_ = [[width if x % len(CLASSES) == opens else max(0, s - 1) for x in range(symbols)] for s in range(width + 1)]
    out = [[(name,) if s and x % len(CLASSES) in hits else () for x in range(symbols)] for s in range(width + 1)]
    return Transducer(next_, out)


def marked(name: str, symbols: int) -> Transducer:
    """Says ``(name,)`` of the hits in the upper half of the symbols, which a machine from the right has marked."""
    hits = (CLASSES.index("I"), CLASSES.index("H"))
    return Transducer([[0] * symbols], [[(name,) if x >= len(CLASSES) and x % len(CLASSES) in hits else () for x in range(symbols)]])


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both machines over one input, as one over the reachable pairs of states; what they say is joined."""
    number, order, next_, out = {(0, 0): 0}, [(0, 0)], [], []
    for s, t in order:
        row = []
        for x, y in zip(a.next[s], b.next[t], strict=True):
            if (x, y) not in number:
                number[(x, y)] = len(order)
                order.append((x, y))
            row.append(number[(x, y)])
        next_.append(row)
        out.append([x + y for x, y in zip(a.out[s], b.out[t], strict=True)])
    return Transducer(next_, out)


def weighted(machine: Transducer) -> Transducer:
    """The machine that says a hit's kind instead of its marks: report before negation before target; a threat without a
    target is none."""

    def kind(x: int, marks: tuple) -> int:
        own = CLASSES[x % len(CLASSES)]
        if own not in "IH" or (own == "H" and "t" not in marks):
            return 0
        return KINDS.index("reported" if "r" in marks else "negated" if "n" in marks else "target" if "t" in marks else "plain")

    return Transducer(machine.next, [[kind(x, m) for x, m in enumerate(row)] for row in machine.out])


#: From the right: which hits have a target at most four words on. From the left, over twice the symbols: everything else.
RIGHT = scope("T", 4, "t")
GRAMMAR = weighted(compose(compose(scope("N", 3, "n", 2 * len(CLASSES)), scope("R", 12, "r", 2 * len(CLASSES))), compose(scope("T", 4, "t", 2 * len(CLASSES)), marked("t", 2 * len(CLASSES)))))


def hit_kinds(classes: list[int]) -> list[int]:
    """The kind of every word of a clause, given its words' classes."""
    symbols = [x + len(CLASSES) * bool(m) for x, m in zip(classes, RIGHT.run(classes[::-1])[::-1], strict=True)]
    return GRAMMAR.run(symbols)


def clause_matches(words: list[str], lexicon: Lexicon) -> tuple[float, float, float, float]:
    """Summed weights of a clause's hits: plain, at a target, negated, reported. A threat counts only at a target."""
    tagged = [lexicon.tag(w) or ("-", 0.0) for w in words]
    sums = [0.0] * len(KINDS)
    for kind, (_, w) in zip(hit_kinds([CLASSES.index(t) for t, _ in tagged]), tagged, strict=True):
        sums[kind] += w
    return tuple(sums[1:])


FEATURES = ("plain", "target", "negated", "reported", "density", "peak", "clauses", "length")


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """What the matched clauses of a whole text add up to; all but the length is zero where none matches. A clause counts by the
    logarithm of its weight, so one clause of many insults doesn't make a text."""
    lowered = text.lower() if isinstance(text, str) else ""
    words = WORD.findall(lowered)
    distinct = set(words)
    lexicon.learn(distinct)
    length = np.log1p(len(words))
    if lexicon.hits.keys().isdisjoint(distinct):
        return np.array([0, 0, 0, 0, 0, 0, 0, length], float)
    sums, weight, peak, clauses = np.zeros(4), 0.0, 0.0, 0
    for part in CLAUSE.split(lowered):
        own = WORD.findall(part)
        if lexicon.hits.keys().isdisjoint(own):
            continue
        found = np.array(clause_matches(own, lexicon))
        if found.any():
            sums += np.log1p(found)
            clauses += 1
            weight += found[0] + found[1]
            peak = max(peak, found[0] + found[1])
    return np.array([*np.log1p(sums), 10 * weight / (len(words) + 15), peak, np.log1p(clauses), length], float)


def _count_stems(rows):
    for frame in rows:
        n, df = Counter(), Counter()
        for doc, text, y in zip(frame["doc_id"], frame["text"], frame["y"], strict=True):
            own = Counter(WORD.findall(text.lower() if isinstance(text, str) else ""))
            side = (int(y), doc % 2)
            stems = Counter()
            for w, k in own.items():
                for m in STEMS:
                    if m <= len(w):
                        stems[w[:m]] += k
            for s, k in stems.items():
                n[(s, *side)] += k
                df[(s, *side)] += 1
            n[("", *side)] += sum(own.values())
            df[("", *side)] += 1
        yield pd.DataFrame([(*k, v, df[k]) for k, v in n.items()], columns=["stem", "y", "fold", "n", "docs"])


def _surprise(toxic: int, clean: int, share: float) -> float:
    """Log likelihood ratio of a stem's texts being toxic more often than the ``share`` of all texts that are."""
    n = toxic + clean
    if not 0 < share < 1 or toxic <= n * share:
        return 0.0
    return toxic * np.log(toxic / (n * share)) + (clean * np.log(clean / (n * (1 - share))) if clean else 0.0)


def learn_stems(sample: DataFrame, least_docs: int, max_stems: int, surprise: float = 10.0) -> list[dict[str, float]]:
    """Stem weights by fold: from the documents of fold 0, of fold 1, and of both. A weight is the log ratio of the rates
    of occurrence, each with half an occurrence more; a stem must be ``surprise`` more likely among toxic texts than chance
    has it, so that the many stems tried don't bring in lucky ones. At most ``max_stems`` candidate stems come to the driver."""
    counted = sample.mapInPandas(_count_stems, "stem string, y int, fold int, n long, docs long").groupBy("stem", "y", "fold").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sums = counted.filter("stem = ''").collect()
    total, texts = {(r.y, r.fold): r.n for r in sums}, {(r.y, r.fold): r.docs for r in sums}
    wide = counted.filter("stem != ''").groupBy("stem").agg(*[F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("fold") == f), F.col(c))), F.lit(0)).alias(f"{c}{y}{f}") for y in (0, 1) for f in (0, 1) for c in ("n", "docs")])
    odds = F.log((F.expr("n10 + n11") + 0.5) / (F.expr("n00 + n01") + 0.5))
    few = wide.filter(F.expr("docs10 + docs11") >= least_docs).withColumn("odds", odds).filter(F.col("odds") > float(np.log((total.get((1, 0), 0) + total.get((1, 1), 0) + 1) / (total.get((0, 0), 0) + total.get((0, 1), 0) + 1)) + 1.5))
    rows = few.orderBy((F.col("odds") * F.sqrt(F.expr("docs10 + docs11"))).desc(), "stem").limit(max_stems).collect()
    out = []
    for folds in ((0,), (1,), (0, 1)):
        toxic, clean = (sum(total.get((y, f), 0) for f in folds) for y in (1, 0))
        share = sum(texts.get((1, f), 0) for f in folds) / max(1, sum(texts.get((y, f), 0) for y in (0, 1) for f in folds))
        weights = {}
        for r in rows:
            a, b = (sum(r[f"n{y}{f}"] for f in folds) for y in (1, 0))
            w = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
            if w > 1.5 and _surprise(*(sum(r[f"docs{y}{f}"] for f in folds) for y in (1, 0)), share) >= surprise * len(folds) / 2:
                weights[r["stem"]] = float(w)
        out.append(weights)
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, least_docs: int = 4, max_stems: int = 4000) -> tuple[dict[str, float], np.ndarray]:
    """Learned stems and regression weights, from at most ``max_rows`` labelled documents that aren't held out. The
    regression sees each half of them through stems learned from the other half."""
    sample = labelled_sample(docs, labels, "toxic", max_rows).persist()
    try:
        stems = learn_stems(sample, least_docs, max_stems)
        halves = [Lexicon(stems[1]), Lexicon(stems[0])]

        def run(batches):
            for frame in batches:
                yield pd.DataFrame({"y": frame["y"], "x": [features(t, halves[d % 2]) for d, t in zip(frame["doc_id"], frame["text"], strict=True)]})

        found = sample.mapInPandas(run, "y int, x array<double>").collect()
    finally:
        sample.unpersist()
    x = np.array([r.x for r in found], float).reshape(-1, len(FEATURES))
    return stems[2], fit_logistic(x, np.array([r.y for r in found], float))


def toxicity_scores(docs: DataFrame, stems: dict[str, float], weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row; a null or empty text has no matched clause."""
    def run(batches):
        lexicon = Lexicon(stems)
        for frame in batches:
            x = np.array([features(t, lexicon) for t in frame["text"]], float).reshape(-1, len(FEATURES))
            yield frame[["doc_id", "no_id"]].assign(score=sigmoid(x @ weights[:-1] + weights[-1]))

    return map_texts(docs, run, "score double", id_col, text_col)


def score_column(stems: dict[str, float], weights: np.ndarray):
    """The score as a column function of a text, for filters."""
    lexicons: list[Lexicon] = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not lexicons:
            lexicons.append(Lexicon(stems))
        x = np.array([features(t, lexicons[0]) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(sigmoid(x @ weights[:-1] + weights[-1]))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> DataFrame:
    """Fit on the labelled documents that aren't held out and score every row of ``docs(doc_id, text)``: ``(doc_id, score)``.

    With no labels, or labels of one kind, every text gets the same score."""
    prepare(docs.sparkSession)
    return toxicity_scores(docs, *fit_toxicity(docs, labels, max_rows))
