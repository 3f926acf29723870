"""Toxicity: Levenshtein automata intersected with a trie of learned terms, and windows that tell quotation from abuse."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep
from .textops import U64, Words, chunks, small_batches

#: Labelled rows that are learned from, as expected under hash sampling.
TRAINING_ROWS = 20_000
#: A term is in three toxic training texts, and so many times as often as in others. It is also in this share of the toxic ones, or
#: else less likely by chance than one of all terms is: so a kind of abuse that is rare among all can have terms.
MIN_SHARE, MIN_TEXTS, MIN_RATIO = 0.02, 3, 20.0
#: Lengths of word beginnings that may become terms.
STEMS = range(4, 9)
#: A beginning becomes a term if so many times as many toxic texts have it as any one word with it.
STEM_GAIN = 1.5
#: A family is a beginning that marks a text by several different words with it. Two toxic training texts or more have two such words, and
#: so many times as often as others; such words are so many times as frequent in toxic texts; and chance makes none so frequent among all.
FAMILY_TEXTS, FAMILY_RATIO, FAMILY_RATE = 2, 8.0, 5.0
#: What a quoted hit counts, where others count 1; and what it counts if one of the words of ATTACKS stands among so many words on each side
#: of the quotation. The labels show no quoted abuse to learn these from.
QUOTED, WINDOW, ATTACKED = 0.1, 8, 0.5
#: Words that tell of abuse being spoken at someone.
ATTACKS = frozenset(
    "shouted shouts yelled yells screamed screams hissed spat insulted insults jeered taunted schrie schreit brüllte brüllt beschimpfte beschimpft "
    "pöbelte zischte cria crie hurla hurle insulta insulte injuria traita traite gritó grita chilló chilla insultó increpó espetó".split()
)
#: Judged words that a worker remembers.
REMEMBERED = 1 << 20

WORD_TABLE = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
#: Quotation marks, opening and closing; a single one that closes may be an apostrophe, so it counts at a word's edge alone.
MARKS = [('"', '"'), ("“", "”"), ("„", "“"), ("„", "”"), ("«", "»"), ("»", "«"), ("‚", "‘")]
SINGLE = [("‘", "’"), ("'", "'")]
#: Bytes of a line that a quotation has at most.
QUOTE_BYTES = 1000


def _quotations() -> re.Pattern[bytes]:
    """Quotations in UTF-8 bytes: an opening mark and its next closing one in the same line. A mark without its partner is none."""
    spans = []
    for first, last in MARKS:
        spans.append(b"%b(?:(?!%b)[^\n]){0,%d}%b" % (first.encode(), last.encode(), QUOTE_BYTES, last.encode()))
    # a letter before, of one, two or three bytes, or after; beginnings of typographic marks are not letters
    before, after = rb"(?<![0-9A-Za-z])(?<![\xc3-\xdf].)(?<![\xe1\xe3-\xef]..)", rb"(?![0-9A-Za-z\xc3-\xdf\xe1\xe3-\xf4])"
    for first, last in SINGLE:
        spans.append(rb"%b%b(?=\S)[^\n]{0,%d}?(?<=\S)%b%b" % (before, first.encode(), QUOTE_BYTES, last.encode(), after))
    return re.compile(b"|".join(spans), re.DOTALL)


QUOTATIONS = _quotations()
FEATURES = 6


def split_words(raw: np.ndarray, at: np.ndarray, hashes: bool = True) -> Words:
    """Lowered words; typographic punctuation (U+00A0-00BF, U+2010-206F, U+3000-303F without letters and invisible signs) parts them too."""
    high = np.flatnonzero((raw == 0xC2) | (raw == 0xE2) | (raw == 0xE3))
    if len(high):
        raw = np.array(raw)
        ahead = np.concatenate((raw, np.zeros(2, np.uint8)))
        lead, second, third = ahead[high], ahead[high + 1], ahead[high + 2]
        two = high[(lead == 0xC2) & (second >= 0xA0) & (second <= 0xBF) & ~np.isin(second, [0xAA, 0xAD, 0xB5, 0xBA])]
        general = (lead == 0xE2) & (((second == 0x80) & (third >= 0x90)) | ((second == 0x81) & (third <= 0x9F)))
        three = high[general | ((lead == 0xE3) & (second == 0x80) & ~np.isin(third, [0x85, 0x86, 0x87]))]
        for i in (two, two + 1, three, three + 1, three + 2):
            raw[i] = 0x20
    return Words(raw, at, WORD_TABLE, lower=True, hashes=hashes)


def edits_allowed(term: str, stem: bool) -> int:
    """Edits that still count as the term: one from five letters (six for a beginning), two from ten."""
    n = len(term) - stem
    return 0 if n < 5 else 1 if n < 10 else 2


class FuzzyTrie:
    """A trie of terms, run together with Levenshtein automata as one automaton that is made as it is used.

    A state is a set of (trie node, edits so far). Most words leave the trie
    after two or three letters.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, bool]] = {}
        for term, stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            before = self.ends.get(node, (0, False))
            self.ends[node] = (max(before[0], edits_allowed(term, stem)), before[1] or stem)
        # edits that any term below a node allows
        self.most = [0] * len(self.children)
        for node in reversed(range(len(self.children))):
            below = [self.most[x] for x in self.children[node].values()]
            self.most[node] = max([*below, self.ends[node][0] if node in self.ends else 0])
        self.sets: list[frozenset] = []
        self.index: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accept: list[tuple[int, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The state's number, with term letters skipped at one edit each; -1 for none."""
        least: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        if not least:
            return -1
        key = frozenset(least.items())
        if key not in self.index:
            self.index[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            fits = [(e, self.ends[n][1]) for n, e in key if n in self.ends and e <= self.ends[n][0]]
            # edits of the nearest term that ends here, and of the nearest beginning
            self.accept.append((min([e for e, _ in fits], default=9), min([e for e, stem in fits if stem], default=9)))
        return self.index[key]

    def _step(self, state: int, c: str) -> int:
        pairs = set()
        for node, e in self.sets[state]:
            pairs.add((node, e + 1))
            for letter, child in self.children[node].items():
                pairs.add((child, e + (letter != c)))
        self.steps[state][c] = found = self._state(pairs)
        return found

    def distance(self, word: str) -> int:
        """Edits to the nearest term, or 9 if none is near enough."""
        state, stem = self.start, 9
        for c in word:
            following = self.steps[state].get(c)
            state = self._step(state, c) if following is None else following
            if state < 0:
                return stem
            stem = min(stem, self.accept[state][1])
        return min(stem, self.accept[state][0])


@dataclass
class Model:
    """Learned terms and families, near misses that harmless texts use, and the weights of the features."""

    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    harmless: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))

    def judge(self) -> Judge:
        return Judge(self)


def _weight(words: Words, i: int, spans: list[tuple[int, int]]) -> float:
    """What the hit at word i counts, given the quotations of its text in order."""
    at = bisect_right(spans, (int(words.starts[i]), 1 << 62)) - 1
    if at < 0 or words.ends[i] > spans[at][1]:
        return 1.0
    begin, end = spans[at]
    text = words.text[i]
    for step, last in ((-1, words.offsets[text] - 1), (1, words.offsets[text + 1])):
        # the nearest words outside the quotation
        j = i
        while j != last and begin <= words.starts[j] < end:
            j += step
        for k in range(j, max(last, j - WINDOW) if step < 0 else min(last, j + WINDOW), step):
            if words.raw[words.starts[k] : words.ends[k]].tobytes().decode("utf-8", "replace") in ATTACKS:
                return ATTACKED
    return QUOTED


class Judge:
    """Scores texts; remembers the words it has judged."""

    def __init__(self, model: Model):
        self.model, self.trie, self.families = model, FuzzyTrie(model.words, model.stems), tuple(model.families)
        self.known, self.verdict = np.zeros(0, U64), np.zeros(0, np.int8)

    def _kinds(self, words: Words) -> np.ndarray:
        """For each word: 1 a term, 2 a near miss, 3 of a family, 0 none of these."""
        hashes, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        seen = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        kinds = np.zeros(len(hashes), np.int8)
        kinds[seen] = self.verdict[at[seen]]
        for i in np.flatnonzero(~seen):
            w = words.raw[words.starts[first[i]] : words.ends[first[i]]].tobytes().decode("utf-8", "replace")
            d = 9 if w.startswith(self.families) else self.trie.distance(w)
            kinds[i] = 3 if w.startswith(self.families) else 0 if d > 2 or (d and w in self.model.harmless) else 1 if d == 0 else 2
        if len(self.known) + int((~seen).sum()) > REMEMBERED:
            self.known, self.verdict = hashes, kinds
        elif not seen.all():
            self.known, self.verdict = np.concatenate((self.known, hashes[~seen])), np.concatenate((self.verdict, kinds[~seen]))
            order = np.argsort(self.known)
            self.known, self.verdict = self.known[order], self.verdict[order]
        return kinds[back]

    def features(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logarithms of the numbers of terms, of near misses and of different ones of both, of their share of all words, and of family words
        beyond the first and their share. A hit in a quotation counts little, as who quotes a word seldom means it, and more if the
        words around tell of an attack."""
        words = split_words(raw, at)
        kinds = self._kinds(words) if len(words) else np.zeros(0, np.int8)
        n = len(at) - 1
        counts = np.zeros((n, 3))
        # the most that an occurrence of each different word counts
        different: list[tuple[dict, dict]] = [({}, {}) for _ in range(n)]
        spans: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(kinds):
            text, kind = words.text[i], kinds[i]
            if text not in spans:
                spans[text] = [(int(at[text]) + m.start(), int(at[text]) + m.end()) for m in QUOTATIONS.finditer(raw[at[text] : at[text + 1]].tobytes())]
            weight = _weight(words, i, spans[text])
            counts[text, kind - 1] += weight
            own = different[text][int(kind == 3)]
            own[words.hash[i]] = max(weight, own.get(words.hash[i], 0))
        total = np.maximum(1, words.counts)
        terms, family = (np.array([sum(x[k].values()) for x in different], float) for k in (0, 1))
        more = np.maximum(0, family - 1)
        columns = [counts[:, 0], counts[:, 1], terms, 100 * counts[:, :2].sum(1) / total, more, 100 * np.where(more > 0, counts[:, 2], 0) / total]
        return np.log1p(np.column_stack(columns))

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.features(raw, at) @ self.model.weights[1:] + self.model.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) with the least hash of the text's runs of three words: near copies mostly share it, other texts seldom do."""
    for batch in batches:
        keys = []
        for lo, hi, raw, at in chunks(batch.column(0)):
            words = split_words(raw, at)
            start, h = words.windows(3)
            edge = np.searchsorted(start, words.offsets)
            for i in range(hi - lo):
                here = h[edge[i] : edge[i + 1]] if edge[i] < edge[i + 1] else words.hash[words.offsets[i] : words.offsets[i + 1]]
                keys.append(int(here.min().astype(np.int64)) if len(here) else 0)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], ["text", "toxic", "key"])


COUNTS = ["toxic", "other", "toxic_twice", "other_twice", "toxic_words", "other_words"]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, toxic), for each word and each beginning, numbers of toxic and of other texts: with it, with two different words of
    that beginning, and the sum of such words over all texts. The empty beginning stands for all words."""
    for batch in batches:
        counts: dict[tuple[str, bool], list[int]] = {}
        toxic = batch.column(1).to_pylist()
        for lo, hi, raw, at in chunks(batch.column(0)):
            words = split_words(raw, at, hashes=False)
            lowered = words.raw.tobytes()
            for i in range(hi - lo):
                a, b = words.offsets[i], words.offsets[i + 1]
                own = {lowered[s:e].decode("utf-8", "replace") for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)}
                other = int(not toxic[lo + i])
                begun = Counter(w[:n] for w in own for n in STEMS if len(w) > n)
                begun[""] = len(own)
                for w in own:
                    counts.setdefault((w, False), [0] * 6)[other] += 1
                for s, n in begun.items():
                    x = counts.setdefault((s, True), [0] * 6)
                    x[other] += 1
                    x[2 + other] += n > 1
                    x[4 + other] += n
        keys = list(counts)
        numbers = np.array([counts[k] for k in keys], np.int64).reshape(-1, 6)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *map(pa.array, numbers.T)], ["term", "stem", *COUNTS])


def _surprise(a: Column, b: Column, base: float) -> Column:
    """Bound of the chance that a of a + b fall to where a share of base is expected, as a logarithm turned positive."""
    n = a + b
    return F.when(a > 0, a * F.log(a / (n * base))).otherwise(0.0) + F.when(b > 0, b * F.log(b / (n * (1 - base)))).otherwise(0.0)


def _ratio(a: Column, b: Column, all_a: int, all_b: int) -> Column:
    return (a + 0.5) / (all_a + 1) / ((b + 0.5) / (all_b + 1))


def _near(words: list[str], stems: list[str]):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = FuzzyTrie(words, stems)
        for batch in batches:
            yield batch.filter(pa.array([0 < trie.distance(w) < 9 for w in batch.column(0).to_pylist()], pa.bool_()))

    return near


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Bias and weights of a ridge-penalised logistic regression, by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [penalty] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic).

    Rows with null text, id or label are left out; of several labels of an id
    the largest counts. Of more than training_rows labels, those with a small
    hash of doc_id are taken, training_rows on average, so the joined ids, the
    candidate terms and the features that reach the driver are bounded.
    Near copies count mostly once, as a group of them would make all its words
    terms; the least of their texts is taken, so the model doesn't depend on the
    order of rows. Languages are not told apart: a family that two toxic texts of
    a rare language share can be sure enough. Without both kinds of label the model has no terms and scores 0.
    """
    small_batches(docs.sparkSession)
    asked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = asked.count()
    if total > training_rows:
        asked = asked.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30)) < int(training_rows / total * (1 << 30)))
    rows = docs.where("text is not null").join(F.broadcast(asked), "doc_id").select(F.col("text").cast("string").alias("text"), "toxic")
    rows = rows.mapInArrow(_keyed, "text string, toxic int, key long").groupBy("key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    rows = keep(rows, "training")
    by_label = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, other = by_label.get(1, 0), by_label.get(0, 0)
    model = Model(weights=np.concatenate(([-30.0], np.zeros(FEATURES))))
    if toxic and other:
        counted = rows.mapInArrow(_count_terms, "term string, stem boolean, " + ", ".join(f"{c} long" for c in COUNTS))
        counts = keep(counted.groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in COUNTS]), "terms")
        c = {x: F.col(x) for x in COUNTS}
        told = counts.where("term <> ''").agg(F.count_if(c["toxic"] + c["other"] >= MIN_TEXTS), F.count_if(F.col("stem") & (c["toxic_words"] + c["other_words"] >= 3))).first()
        words_of = counts.where("stem and term = ''").select("toxic_words", "other_words").first() or (0, 0)
        counts = counts.where(F.length("term") >= 3)

        sure = _surprise(c["toxic_words"], c["other_words"], (words_of[0] + 1) / (sum(words_of) + 2))
        family = F.col("stem") & (c["toxic_twice"] >= FAMILY_TEXTS) & (_ratio(c["toxic_twice"], c["other_twice"], toxic, other) >= FAMILY_RATIO)
        family &= (_ratio(c["toxic_words"], c["other_words"], *words_of) >= FAMILY_RATE) & (sure >= math.log(max(1, told[1])))
        beginnings: set[str] = set()
        for row in counts.where(family).select("term", sure.alias("sure")).orderBy(F.desc("sure"), F.length("term"), "term").collect():
            begun = {row["term"][:n] for n in range(1, len(row["term"]) + 1)}
            if begun.isdisjoint(model.families) and row["term"] not in beginnings:
                model.families.append(row["term"])
                beginnings |= begun
        apart = lambda w: not w.startswith(tuple(model.families))

        ratio = _ratio(c["toxic"], c["other"], toxic, other)
        enough = (c["toxic"] >= math.ceil(MIN_SHARE * toxic)) | (_surprise(c["toxic"], c["other"], toxic / (toxic + other)) >= math.log(max(1, told[0])))
        often = counts.where((c["toxic"] >= MIN_TEXTS) & enough & (ratio >= MIN_RATIO))
        found = often.toPandas()
        words = dict(zip(found["term"][~found["stem"]], found["toxic"][~found["stem"]], strict=True))
        most: dict[str, int] = {}
        for w, n in words.items():
            for size in range(1, len(w) + 1):
                most[w[:size]] = max(n, most.get(w[:size], 0))
        stems: list[str] = []
        for stem, n in sorted(zip(found["term"][found["stem"]], found["toxic"][found["stem"]], strict=True), key=lambda x: (len(x[0]), x[0])):
            if apart(stem) and not stem.startswith(tuple(stems)) and n >= STEM_GAIN * most.get(stem, 0):
                stems.append(stem)
        model.words, model.stems = sorted(w for w in words if apart(w) and not w.startswith(tuple(stems))), stems
        near = counts.where(~F.col("stem") & (F.col("other") > 0) & (ratio < MIN_RATIO)).select("term").mapInArrow(_near(model.words, stems), "term string")
        model.harmless = frozenset(r["term"] for r in near.collect())
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge = shared.value.judge()
            for batch in batches:
                for lo, hi, raw, at in chunks(batch.column(0)):
                    x = judge.features(raw, at)
                    yield pa.record_batch([batch.column(1).slice(lo, hi - lo), *map(pa.array, x.T)], ["toxic", *(f"x{i}" for i in range(FEATURES))])

        table: pd.DataFrame = rows.mapInArrow(features, "toxic int, " + ", ".join(f"x{i} double" for i in range(FEATURES))).toPandas()
        model.weights = _logistic(table.iloc[:, 1:].to_numpy(float), table["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (as given) and score, from 0 to 1, of rows (doc_id, held_out, text). Null texts count as empty; all texts are read whole."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value.judge()
        for batch in batches:
            scores = [judge.score(raw, at) for _, _, raw, at in chunks(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "held_out", "score"])

    return docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text")).mapInArrow(judge_all, "doc_id long, held_out boolean, score double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents, learned where crc32(doc_id) mod 4 is not 2."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    quarter = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs.where(quarter != 2).select("doc_id", "text"), labels.where(quarter != 2).select("doc_id", "toxic"))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(quarter == 2, F.lit(False)).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
