"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults (with a weight), threats, targets, negations, verbs of reported speech, other
words. Four small transducers are composed into one table: negation marks the three words behind it, reported
speech the rest of its clause, a target the insults and threats close to it, and the scorer gives each marked
insult or threat its share of weight. A clause's score is the sum over its words, a document's features are
its clauses' scores, and a logistic regression turns them into a probability.

What insults look like is learned: prefixes of words that occur in more toxic than clean labelled texts, added
to a short seed list. Only rows whose crc32(doc_id) mod 3 isn't 1 teach, at most ``TRAIN`` of them (those with
the smallest hashes of their ids), of which copies with one label count once: exact ones, and near ones by the
minima of their sets of five-word shingles, at 80 percent. The regression is fitted on features that
lexicons of the other folds of the rows give, so words that a lexicon has by chance earn no trust.

Defined results: null and wordless texts have no clause and get the score of a text without insults; a
repeated row is scored each time; without usable labels the seed list and fixed coefficients are used. Ids are whole
numbers, or text that spells them; other ids raise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm import neardup
from tensorloom.llm.common import crc_of_id, forget, held_out, pieces, span_hashes, stored, table, text_buffer

#: From this score on a text counts as toxic.
THRESHOLD = 0.7
#: Labelled rows that teach at most.
TRAIN = 8_000
#: Words of a shingle, and how many of the ``neardup.HASHES`` minima copies among the teaching rows agree in: 80 percent.
SHINGLE, COPIES = 5, 77
#: Parts of the teaching rows; the regression sees each with a lexicon of the others.
FOLDS = 5
#: Bytes of a prefix, least number of toxic texts, least log-odds and least evidence (G) of a learned insult.
PREFIX, LEAST_TEXTS, LEAST_ODDS, LEAST_G = range(3, 13), 3, 1.5, 9.0
#: Written down without regard to the tables; words seen in labelled texts are left to the learned lexicon.
SEEDS = """fool dumb imbecile garbage vermin
dummkopf trottel abschaum wertlos widerlich imbécile crétin ordure minable stupide estúpido imbécil basura escoria inútil""".split()
THREATS = "kill hurt destroy beat burn smash shoot töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours he him she her they them du dich dir ihr sie euch tu toi vous ils elles tú usted ustedes ellos ellas".split()
NEGATIONS = "not never no nor nobody don't isn't nicht kein keine nie niemals ne pas jamais aucun nunca ni tampoco".split()
REPORTS = "said says say told claimed wrote quoted reported called sagte sagt behauptet schrieb dit disait écrit dijo dice escribió".split()
WORD, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_fixed = {w: k for k, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_ender = np.zeros(256, bool)
_ender[[10, 33, 46, 59, 63]] = True


class Transducer:
    """A function (state, symbol) -> (state, symbol) with a start state; ``then`` feeds its output to another one."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Transducer((self.start, other.start), step)


def _negation(left, symbol):
    kind, *marks = symbol
    return (3 if kind == NEGATION else max(0, left - 1)), (kind, *marks, left > 0)


def _report(on, symbol):
    kind, *marks = symbol
    return on or kind == REPORT, (kind, *marks, on)


def _target(state, symbol):
    near, hit = state
    kind, *marks = symbol
    late = kind == TARGET and hit > 0
    return (4 if kind == TARGET else max(0, near - 1), 3 if kind in (INSULT, THREAT) else max(0, hit - 1)), (kind, *marks, near > 0, late)


def _score(_, symbol):
    """Share of the word's own weight, and weight added beside it."""
    kind, negated, reported, targeted, late = symbol
    damp = (0.6 if negated else 1.0) * (0.8 if reported else 1.0)
    share = (1.3 if targeted else 1.0) * damp if kind == INSULT else 0.0
    return None, (share, (0.5 if kind == THREAT and targeted else 0.3 if late else 0.0) * damp)


GRAMMAR = Transducer(0, _negation).then(Transducer(False, _report)).then(Transducer((0, 0), _target)).then(Transducer(None, _score))


def _compiled(machine: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """The composed machine as tables: next state, and the two outputs, by state and symbol."""
    states, todo, to, out = {machine.start: 0}, [machine.start], [], []
    while todo:
        row, gives = [], []
        for symbol in range(6):
            state, result = machine.step(todo[0], (symbol,))
            if state not in states:
                states[state] = len(states)
                todo.append(state)
            row.append(states[state])
            gives.append(result)
        to.append(row)
        out.append(gives)
        todo.pop(0)
    return np.array(to), np.array(out)


TO, OUT = _compiled(GRAMMAR)
_to, _out = TO.tolist(), OUT.tolist()


def clause_score(symbols: list[int], weights: list[float]) -> float:
    state, total = 0, 0.0
    for s, w in zip(symbols, weights):
        share, more = _out[state][s]
        total += share * w + more
        state = _to[state][s]
    return total


class Words:
    """The words of a slice of texts: spans, clauses, distinct words."""

    def __init__(self, texts: list[str | None]):
        self.data, self.starts = text_buffer(pa.array([(t or "").lower() for t in texts], pa.large_string()))
        n = len(self.data)
        inside = _letter[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.starts] = True
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        after = np.concatenate([inside[1:], [False]]) if n else inside
        self.begin = np.flatnonzero(inside & (edge[:-1] | ~before))
        self.end = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
        self.row = np.searchsorted(self.starts, self.begin, "right") - 1
        stops = np.cumsum(_ender[self.data] | edge[:-1]) if n else np.zeros(0, int)
        self.clause = stops[self.begin] if n else np.zeros(0, int)
        hashes = span_hashes(self.data, self.begin, self.end) if len(self.begin) else np.zeros(0, np.uint64)
        self.hashes, self.one, self.which = np.unique(hashes, return_index=True, return_inverse=True)

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the distinct words of k bytes at least, their indexes and the hashes of their first k bytes, where no character is cut."""
        begin, length = self.begin[self.one], self.end[self.one] - self.begin[self.one]
        at = np.flatnonzero(length >= k)
        at = at[(length[at] == k) | (self.data[np.minimum(begin[at] + k, len(self.data) - 1)] & 0xC0 != 0x80)]
        return at, span_hashes(self.data, begin[at], begin[at] + k)


def _hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(b, np.zeros(1, np.int64), np.array([len(b)]))[0])


class Lexicon:
    """Weights by hash of a prefix (by length) and kinds by hash of a word."""

    def __init__(self, weights: dict[tuple[int, int], float]):
        self.by_length = {}
        for k in PREFIX:
            own = sorted((h, w) for (n, h), w in weights.items() if n == k)
            if own:
                self.by_length[k] = np.array([h for h, _ in own], np.uint64), np.array([w for _, w in own])
        seeds = sorted((_hash(w), INSULT) for w in SEEDS) + sorted((_hash(w), k) for w, k in _fixed.items())
        seeds = sorted({h: k for h, k in seeds}.items())
        self.words, self.kinds = np.array([h for h, _ in seeds], np.uint64), np.array([k for _, k in seeds])

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of each distinct word; the longest prefix that is known decides."""
        kind, weight = np.zeros(len(words.hashes), np.int64), np.zeros(len(words.hashes))
        at = np.minimum(np.searchsorted(self.words, words.hashes), len(self.words) - 1)
        hit = self.words[at] == words.hashes
        kind[hit] = self.kinds[at[hit]]
        weight[kind == INSULT] = 4.0
        for k, (hashes, weights) in self.by_length.items():
            who, prefix = words.prefixes(k)
            at = np.minimum(np.searchsorted(hashes, prefix), len(hashes) - 1)
            hit = hashes[at] == prefix
            kind[who[hit]], weight[who[hit]] = INSULT, weights[at[hit]]
        return kind, weight


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """A row for each text: sum of clause scores, best clause, matched clauses, words."""
    words = Words(texts)
    kind, weight = lexicon.of(words)
    symbol, weight = kind[words.which], weight[words.which]
    out = np.zeros((len(texts), 4))
    out[:, 3] = np.bincount(words.row, minlength=len(texts))
    matched = np.unique(words.clause[(symbol == INSULT) | (symbol == THREAT)])
    first, last = np.searchsorted(words.clause, matched), np.searchsorted(words.clause, matched, "right")
    for a, b in zip(first.tolist(), last.tolist()):
        if score := clause_score(symbol[a:b].tolist(), weight[a:b].tolist()):
            row = out[words.row[a]]
            row[0] += score
            row[1] = max(row[1], score)
            row[2] += 1
    return out


def shaped(x: np.ndarray) -> np.ndarray:
    """The regression's inputs."""
    total, best, clauses, n = x.T
    return np.column_stack([np.ones(len(x)), np.log1p(total), np.minimum(best, 12) / 4, np.log1p(clauses), np.log1p(n), np.log1p(100 * total / (n + 20))])


#: Used where there are no labels of both kinds.
FALLBACK = np.array([-4.0, 2.0, 1.0, 0.5, -0.2, 0.5])


def fitted(x: np.ndarray, y: np.ndarray, decay: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's method, with a quadratic penalty."""
    if not len(y) or y.min() == y.max():
        return FALLBACK
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)), x.T @ (p - y) + decay * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def chosen(counts: dict[tuple[int, int], tuple[int, int]], toxic: int, clean: int, parents: dict) -> dict[tuple[int, int], float]:
    """Weights of the prefixes (length, hash) that tell toxic texts; counts: texts of either kind that have a prefix."""
    found: dict[tuple[int, int], tuple[float, float]] = {}
    for key, (a, b) in sorted(counts.items()):
        if a < LEAST_TEXTS:
            continue
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        n, hit = toxic + clean, a + b
        g = 2 * sum(o * math.log(o * n / (r * c)) for o, r, c in ((a, toxic, hit), (b, clean, hit), (toxic - a, toxic, n - hit), (clean - b, clean, n - hit)) if o > 0)
        if odds < LEAST_ODDS or g < LEAST_G:
            continue
        above = parents.get(key)
        while above is not None and above not in found:
            above = parents.get(above)
        # a longer prefix has to say more than the shorter one that it begins with
        if above is None or odds > found[above][0] + 0.7:
            found[key] = odds, g
    return {k: min(6.0, w) for k, (w, _) in found.items()}


def without_copies(sample: DataFrame) -> DataFrame:
    """Of the rows (id, text, toxic), at most ``TRAIN`` ids, those that aren't copies of a row with a smaller id and the same label.

    Copies share a band and agree in ``COPIES`` of the minima of their word shingles; the signatures (a few hundred
    bytes a row) are compared on the driver, in order of the ids, each with the rows that stay.
    """
    signed = sample.select(F.struct("id", "toxic").alias("id"), "text").mapInArrow(neardup._sketch(SHINGLE), "id struct<id:long,toxic:int>, n long, d1 long, d2 long, sig binary, bands array<long>")
    rows = sorted((r.id.id, r.id.toxic, r.n, r.d1, r.d2, bytes(r.sig), r.bands) for r in signed.collect())
    signs: list[np.ndarray] = []
    met: dict[tuple[int, int], list[int]] = {}
    wordless: set[int] = set()
    kept: list[tuple[int, int]] = []
    for id_, toxic, n, _, _, sig, bands in rows:
        if not n:
            if toxic not in wordless:
                wordless.add(toxic)
                kept.append((id_, toxic))
            continue
        sign = np.frombuffer(sig, np.uint8)
        others = sorted({k for band in bands for k in met.get((toxic, band), ())})
        if others and (np.stack([signs[k] for k in others]) == sign).sum(1).max() >= COPIES:
            continue
        for band in set(bands):
            met.setdefault((toxic, band), []).append(len(signs))
        signs.append(sign)
        kept.append((id_, toxic))
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(kept, "id long, toxic int")), ["id", "toxic"], "left_semi")


def _counted(candidates: dict[int, np.ndarray] | None):
    """Texts by prefix, of the candidates if given: rows (length, prefix, above, fold, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, dict[tuple[int, int], int]] = {f: {} for f in range(FOLDS)}
        above: dict[tuple[int, int], int] = {}
        for batch in pieces(batches, "text"):
            words, fold = Words(batch.column("text").to_pylist()), batch.column("fold").to_numpy()
            # distinct (row, word) pairs first
            pairs = np.unique(words.row * (len(words.hashes) + 1) + words.which)
            row, which = np.divmod(pairs, len(words.hashes) + 1)
            shorter = np.zeros(len(words.hashes), np.uint64)
            for k in PREFIX:
                who, prefix = words.prefixes(k)
                if candidates is not None:
                    keep = np.isin(prefix, candidates.get(k, np.zeros(0, np.uint64)))
                    who, prefix = who[keep], prefix[keep]
                of = np.full(len(words.hashes), -1)
                of[who] = np.arange(len(who))
                has = of[which] >= 0
                unique, index = np.unique(prefix, return_inverse=True)
                each = np.unique(row[has] * (len(unique) + 1) + index[of[which[has]]])
                r, u = np.divmod(each, len(unique) + 1)
                for f in range(FOLDS):
                    n = np.bincount(u[fold[r] == f], minlength=len(unique))
                    for j in np.flatnonzero(n).tolist():
                        key = (k, int(unique[j]))
                        total[f][key] = total[f].get(key, 0) + int(n[j])
                if candidates is None:
                    for j, p in zip(who.tolist(), prefix.tolist()):
                        above[k, p] = int(shorter[j])
                    shorter[who] = prefix
        rows = [(k, h, above.get((k, h), 0), f, n) for f in range(FOLDS) for (k, h), n in total[f].items()]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(np.array(columns[1], np.uint64).view(np.int64)), pa.array(np.array(columns[2], np.uint64).view(np.int64)), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int64())], names=["k", "prefix", "above", "fold", "n"])

    return run


_COUNTS = "k int, prefix long, above long, fold int, n long"


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, seen: np.ndarray | None = None, labels: np.ndarray | None = None):
        self.lexicon, self.weights = lexicon, weights
        # of the teaching rows alone: hits, misses and false alarms at the threshold, with lexicons that don't know them
        self.cross = None
        if seen is not None:
            said = 1 / (1 + np.exp(-np.clip(seen @ weights, -30, 30))) >= THRESHOLD
            self.cross = int((said & (labels == 1)).sum()), int((~said & (labels == 1)).sum()), int((said & (labels == 0)).sum())

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((shaped(features(texts, self.lexicon)) * self.weights).sum(1), -30, 30)))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that labelled rows teach; docs: doc_id, text; labels: doc_id, toxic."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(TRAIN)
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(marks), "id")
    sample = stored(sample.distinct(), "sample")
    train = stored(without_copies(sample).withColumn("fold", F.pmod((crc_of_id("id") / 3).cast("long"), F.lit(FOLDS)).cast("int")), "train")
    forget(sample)
    sizes = {(r.toxic, r.fold): r.n for r in train.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    if not any(k[0] == 1 for k in sizes) or not any(k[0] == 0 for k in sizes):
        return Model(Lexicon({}), FALLBACK)
    # what reaches the driver is bounded by TRAIN: prefixes of several toxic texts of the sample, and their counts
    toxic = train.where("toxic = 1").select("text", "fold").mapInArrow(_counted(None), _COUNTS)
    toxic = toxic.groupBy("k", "prefix").agg(F.max("above").alias("above"), *[F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("n"))), F.lit(0)).alias(f"a{f}") for f in range(FOLDS)])
    rows = toxic.where(" + ".join(f"a{f}" for f in range(FOLDS)) + f" >= {LEAST_TEXTS}").collect()
    unsigned = lambda x: x & 0xFFFFFFFFFFFFFFFF
    positive = {(r.k, unsigned(r.prefix)): tuple(r[f"a{f}"] for f in range(FOLDS)) for r in rows}
    known = {h: key for key in positive for h in (key[1],)}
    parents = {(r.k, unsigned(r.prefix)): known.get(unsigned(r.above)) for r in rows}
    candidates = {k: np.array(sorted(h for n, h in positive if n == k), np.uint64) for k in PREFIX}
    clean = train.where("toxic = 0").select("text", "fold").mapInArrow(_counted(candidates), _COUNTS)
    negative = {(r.k, unsigned(r.prefix), r.fold): r.n for r in clean.groupBy("k", "prefix", "fold").agg(F.sum("n").alias("n")).collect()}
    lexicons = []
    for folds in ([f for f in range(FOLDS) if f != out] for out in range(FOLDS + 1)):  # the last one has all
        counts = {key: (sum(a[f] for f in folds), sum(negative.get((*key, f), 0) for f in folds)) for key, a in positive.items()}
        lexicons.append(Lexicon(chosen(counts, sum(sizes.get((1, f), 0) for f in folds), sum(sizes.get((0, f), 0) for f in folds), parents)))

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts, fold = batch.column("text").to_pylist(), batch.column("fold").to_numpy()
            x = np.zeros((len(texts), 4))
            for f in np.unique(fold).tolist():
                own = np.flatnonzero(fold == f)
                x[own] = features([texts[i] for i in own], lexicons[f])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), *[pa.array(c) for c in x.T]], names=["id", "toxic", "a", "b", "c", "d"])

    seen = train.mapInArrow(out_of_fold, "id long, toxic int, a double, b double, c double, d double").orderBy("id").toPandas()
    weights = fitted(shaped(seen[["a", "b", "c", "d"]].to_numpy(float)), seen["toxic"].to_numpy(float))
    return Model(lexicons[FOLDS], weights, shaped(seen[["a", "b", "c", "d"]].to_numpy(float)), seen["toxic"].to_numpy(int))


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.scores(batch.column("text").to_pylist()))], names=["key", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, learned(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
