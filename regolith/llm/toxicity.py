"""Toxicity by weak supervision: lexicon, pattern and density voters, a generative model of their votes, a linear classifier."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import slices
from regolith.llm.linear import logistic, sigmoid
from regolith.llm.textscan import U64, HashTable, buffer_of, gram_hashes, mix, span_hashes, spans_outside

#: Labelled rows that lexicons are mined from; labelled rows, and as many unlabelled ones, that the label model and the classifier
#: see; on average at most.
MINED_FROM, SAMPLE = 12_000, 6_000
#: Entries of the mined lexicon, and the voters that share them.
ENTRIES, SHARDS = 4096, 12
#: Lengths of the word beginnings that entries can be, besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Fixed: common insults, by theme, as whole words in lower case.
LEXICONS = (
    "idiot idiots moron morons stupid dumb fool imbecile cretin clown loser losers",
    "trash garbage scum filth vermin worthless pathetic disgusting vile",
    "hate kill die hurt destroy ugly shut",
    "idiot dumm dumme trottel depp arschloch abschaum widerlich dreck versager",
    "idiot idiote imbécile connard débile ordure minable crétin salaud",
    "idiota imbécil estúpido estúpida basura asqueroso patético cretino perdedor",
)
#: Fixed: phrases of two and three words, by theme, in lower case.
PHRASES = (
    "shut up, get lost, go away, halt die klappe, hau ab, ta gueule, ferme la, cállate ya, vete de aquí",
    "kill you, kill yourself, hurt you, hate you, go die, drop dead, stirb endlich, crève donc, ojalá mueras",
    "piece of trash, piece of garbage, waste of space, so stupid, such an idiot, so dumm, si stupide, tan estúpido",
)
#: Fixed: words that address somebody, in lower case.
ADDRESS = "you your du dich dein ihr tu te toi vous tú usted eres sois"
#: Words of address stand at most so far before a hit; two hits make a pair and three a run within so many words.
BEFORE, PAIR, RUN = 3, 3, 8
#: Words before a word that any pattern which ends with it can need.
REACH = max(BEFORE, PAIR, RUN, 2) + 3
#: How far an annotation is believed.
SURE = 0.99
_LETTERS = np.ones(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STEP = U64(0x9E3779B97F4A7C15)


def _entry_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its words (letters in a row, A-Z in lower case) as rows of hashes: the whole word, then its beginnings, 0
    where the word is no longer than that; the words' texts; and the number of words of each text."""
    return _entries(*buffer_of(pc.utf8_lower(texts)))


def _entries(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = spans_outside(_LETTERS, data, places)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    begin, stop = np.searchsorted(chars, starts), np.searchsorted(chars, ends)
    out = np.zeros((len(starts), 1 + len(BEGINNINGS)), U64)
    out[:, 0] = span_hashes(data, starts, ends, lower=True)
    for k, n in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(stop - begin > n)
        out[longer, k] = mix(span_hashes(data, starts[longer], chars[begin[longer] + n], lower=True) ^ U64(k))
    counts = np.diff(first)
    return out, np.repeat(np.arange(len(counts)), counts), counts


#: Bytes of a long text that are looked at together; it is cut between words.
PIECE = 1 << 20


def _cuts(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The texts' places, with cuts about PIECE bytes apart within those of over twice as many."""
    inner = []
    for k in np.flatnonzero(np.diff(places) > 2 * PIECE).tolist():
        at, stop = int(places[k]) + PIECE, int(places[k + 1])
        while at < stop:
            gaps = np.flatnonzero(_LETTERS[data[at : min(stop, at + PIECE)]])
            if len(gaps):
                inner.append(at + int(gaps[0]))
                at += int(gaps[0])
            at += PIECE
    return np.sort(np.concatenate([places, np.array(inner, np.int64)]))


@dataclass
class Lexicon:
    """Mined entries' hashes with their log odds, and hashes of the fixed lexicons' words with the lexicon's number."""

    mined: np.ndarray
    odds: np.ndarray
    fixed: np.ndarray
    group: np.ndarray


def fixed_words() -> tuple[np.ndarray, np.ndarray]:
    words = [(w, g) for g, line in reversed(list(enumerate(LEXICONS))) for w in line.split()]
    group = dict(words)
    data, places = buffer_of(pa.array(list(group)))
    return span_hashes(data, places[:-1], places[1:], lower=True), np.array(list(group.values()))


def annotated(labels: DataFrame, learn: Column, label_col: str, id_col: str) -> DataFrame:
    """id and label (0 or 1) of the labelled rows where `learn` holds, one for each id; 1 where annotations differ."""
    known = labels.where(learn & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    return known.where("label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))


def stratified(known: DataFrame, sample: int, seed: int) -> tuple[DataFrame, int, int]:
    """About `sample` of the rows that annotated() gives, half of them of each label or, where one has fewer, all of that one and
    more of the other; and the numbers of clean and of toxic rows that they were drawn from."""
    sides = known.agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic")).first()
    toxic = min(sides.toxic, max(sample // 2, sample - sides.clean))
    clean = min(sides.clean, sample - toxic)

    def by_label(of_toxic: int, of_clean: int) -> Column:
        return F.when(F.col("label") == 1, F.lit(of_toxic)).otherwise(F.lit(of_clean)).cast("long")

    chosen = F.pmod(F.xxhash64("id", F.lit(seed)), by_label(max(sides.toxic, 1), max(sides.clean, 1))) < by_label(toxic, clean)
    return known.where(chosen), sides.clean, sides.toxic


def mine(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = MINED_FROM) -> Lexicon:
    """The words and word beginnings that labelled toxic documents hold and others don't, of about `sample` labelled rows where
    `learn` holds, stratified by label. Documents are counted in Spark; the ENTRIES best ones come to the driver."""
    chosen, _, _ = stratified(annotated(labels, learn, label_col, id_col), sample, 7)
    sides = chosen.agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean")).first()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("label", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            entries, text, _ = _entry_hashes(batch.column(1))
            toxic = np.array(batch.column(0).to_pylist())[text] == 1
            keys = (entries ^ mix(text.astype(U64) + _STEP)[:, None]).ravel()
            one = np.unique(keys, return_index=True)[1]
            flat = entries.ravel()[one]
            which, back = np.unique(flat, return_inverse=True)
            side = np.repeat(toxic, entries.shape[1])[one]
            hits = np.bincount(back, side, minlength=len(which)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(which.view(np.int64)), pa.array(hits), pa.array(np.bincount(back, minlength=len(which)) - hits)], names=["entry", "toxic", "clean"])

    counts = texts.mapInArrow(run, "entry long, toxic long, clean long").where("entry <> 0").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = (sides.toxic + 1) / (sides.toxic + sides.clean + 2)
    # Odds against what a word of that many documents would have by chance, with a pseudo count that shrinks rare ones.
    odds = F.log((F.col("toxic") + 2 * share) / (F.col("clean") + 2 * (1 - share))) - float(np.log(share / (1 - share)))
    got = counts.where("toxic >= 3").withColumn("odds", odds).where("odds > 2.5").orderBy(F.desc("odds"), "entry").limit(ENTRIES).toArrow()
    fixed, group = fixed_words()
    return Lexicon(np.array(got.column("entry").to_pylist(), np.int64).view(U64), np.array(got.column("odds").to_pylist(), float), fixed, group)


@functools.cache
def _phrases() -> tuple[HashTable, HashTable]:
    """Hashes of the phrases with their theme, and of the words of address."""
    themes: dict[int, int] = {}
    for theme, line in enumerate(PHRASES):
        for phrase in line.split(", "):
            words = _entry_hashes(pa.array([phrase]))[0][:, 0]
            themes[int(gram_hashes(words, tuple(range(len(words))))[0])] = theme
    found, address = HashTable(len(themes)), HashTable(16)
    found.put(np.array(list(themes), U64), np.array(list(themes.values()), np.int32))
    words = np.unique(_entry_hashes(pa.array([ADDRESS]))[0][:, 0])
    address.put(words, np.zeros(len(words), np.int32))
    return found, address


@dataclass
class Sums:
    """What the votes and features of texts are made from: words, hits, hits in the fixed lexicons, the hits' odds and the highest of
    them, and which shards, lexicons and patterns a text has."""

    words: np.ndarray
    hits: np.ndarray
    known: np.ndarray
    power: np.ndarray
    top: np.ndarray
    shards: np.ndarray
    groups: np.ndarray
    patterns: np.ndarray

    def at(self, texts: np.ndarray) -> Sums:
        """The sums of texts from those of their pieces; texts: where each one's first piece is."""
        parts = [np.add.reduceat(x, texts) for x in (self.words, self.hits, self.known, self.power)]
        return Sums(*parts, *[np.maximum.reduceat(x, texts) for x in (self.top, self.shards, self.groups, self.patterns)])


@dataclass
class Tail:
    """Hashes of words, and which are hits."""

    words: np.ndarray
    hit: np.ndarray


class Voters:
    """Votes and features of texts by a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.mined, self.fixed = HashTable(len(lexicon.mined)), HashTable(len(lexicon.fixed))
        self.mined.put(lexicon.mined, np.arange(len(lexicon.mined), dtype=np.int32))
        self.fixed.put(lexicon.fixed, lexicon.group.astype(np.int32))
        self.odds = np.append(lexicon.odds, 0.0)
        self.shard = np.append((lexicon.mined % U64(SHARDS)).astype(int), 0)

    def _patterns(self, words: np.ndarray, text: np.ndarray, hit: np.ndarray, n: int) -> np.ndarray:
        """For each text: the themes of phrases, whether a word of address stands before a hit, and pairs and runs of hits."""
        out = np.zeros((n, len(PHRASES) + 3), bool)
        phrases, address = _phrases()
        for size in (2, 3):
            theme = phrases.get(gram_hashes(words, tuple(range(size))))
            at = np.flatnonzero(theme >= 0)
            at = at[text[at] == text[at + size - 1]]
            out[text[at], theme[at]] = True
        place = np.flatnonzero(hit)
        addressed = address.get(words) >= 0
        for k in range(1, BEFORE + 1):
            own = place[place >= k]
            own = own[addressed[own - k] & (text[own - k] == text[own])]
            out[text[own], len(PHRASES)] = True
        for column, more, reach in ((1, 1, PAIR), (2, 2, RUN)):
            first, last = place[: max(0, len(place) - more)], place[more:]
            out[text[first[(last - first <= reach) & (text[first] == text[last])]], len(PHRASES) + column] = True
        return out

    def _sums(self, data: np.ndarray, places: np.ndarray, before: Tail | None = None) -> Sums:
        """before: the last words of the text's pieces before this one, which patterns reach back to; it takes this one's."""
        entries, text, words = _entries(data, places)
        n = len(words)
        found = self.mined.get(entries.ravel()).reshape(entries.shape)
        found[entries == 0] = -1
        odds = self.odds[found]
        best = odds.argmax(1)
        strength = odds[np.arange(len(odds)), best] if len(odds) else np.zeros(0)
        which = found[np.arange(len(odds)), best] if len(odds) else np.zeros(0, np.int32)
        group = self.fixed.get(entries[:, 0])
        hit = (strength > 0) | (group >= 0)
        top = np.zeros(n)
        np.maximum.at(top, text, strength)
        shards, groups = np.zeros((n, SHARDS), bool), np.zeros((n, len(LEXICONS)), bool)
        mined = which >= 0
        shards[text[mined], self.shard[which[mined]]] = True
        groups[text[group >= 0], group[group >= 0]] = True
        if before is None:
            patterns = self._patterns(entries[:, 0], text, hit, n)
        else:
            before.words, before.hit = np.concatenate([before.words, entries[:, 0]]), np.concatenate([before.hit, hit])
            patterns = self._patterns(before.words, np.zeros(len(before.words), np.int64), before.hit, n)
            before.words, before.hit = before.words[-REACH:], before.hit[-REACH:]
        return Sums(words, np.bincount(text[hit], minlength=n), np.bincount(text[group >= 0], minlength=n), np.bincount(text, strength, minlength=n), top, shards, groups, patterns)

    def look(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """votes (1 toxic, -1 clean, 0 none) and features of each text."""
        data, places = buffer_of(pc.utf8_lower(texts))
        cuts = _cuts(data, places)
        if len(cuts) == len(places):
            return self._judged(self._sums(data, places))
        parts, whole = [], set(places.tolist())
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a in whole:
                before = Tail(np.zeros(0, U64), np.zeros(0, bool))
            parts.append(self._sums(data[a:b], np.array([0, b - a]), before))
        joined = Sums(*(np.concatenate(x) for x in zip(*(vars(p).values() for p in parts), strict=True)))
        inner = np.searchsorted(cuts, places[:-1]) - np.searchsorted(places, places[:-1])
        return self._judged(joined.at(np.arange(len(places) - 1) + inner))

    def _judged(self, s: Sums) -> tuple[np.ndarray, np.ndarray]:
        words, hits, known, power, length = s.words, s.hits, s.known, s.power, np.maximum(s.words, 1)
        per_word = hits / length
        marks = [
            np.where(hits == 0, -1, np.where(per_word >= 0.01, 1, 0)),
            np.where(power / length < 0.005, -1, np.where(power / length > 0.04, 1, 0)),
            np.where(s.shards.sum(1) >= 3, 1, 0) * (per_word >= 0.005),
            np.where((known > 0) & (known / length >= 0.004), 1, 0),
        ]
        votes = np.column_stack([s.groups * (per_word >= 0.004)[:, None], s.shards * (per_word >= 0.004)[:, None], *marks, s.patterns * (per_word >= 0.004)[:, None]]).astype(np.int8)
        # How hits and their odds stand to what a text of that length has by chance: long clean texts have some.
        excess = [np.log((hits + 0.5) / (0.01 * words + 0.5)), np.log((power + 1) / (0.04 * words + 1)), np.log((known + 0.5) / (0.01 * words + 0.5))]
        features = np.column_stack([*excess, np.log1p(hits), np.minimum(per_word, 0.2) * 20, np.sqrt(np.minimum(per_word, 0.2)) * 5, np.minimum(power / length, 1) * 5, s.top / 3, np.log1p(known), np.minimum(known / length, 0.2) * 20, np.log1p(words) / 5])
        return votes, features


@dataclass
class LabelModel:
    """chance[y, v, j]: the probability of vote v - 1 of voter j given label y; weight[j]: the vote's share after its
    correlations with the others; prior: of label 1."""

    prior: float
    chance: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.chance[1]) - np.log(self.chance[0])
        each = logs[votes + 1, np.arange(votes.shape[1])]
        return sigmoid(np.log(self.prior / (1 - self.prior)) + each @ self.weight)


def fit_labels(votes: np.ndarray, prior: float, marks: np.ndarray | None = None, rounds: int = 40, weights: np.ndarray | None = None) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation: the model, and each row's probability of label 1. In each round the voters' correlations within
    the likelier label are estimated, and a voter that agrees with others beyond the label counts less: 1 / (1 + the sum of its
    positive correlations). marks: 1 or -1 where an annotator has decided, which is taken as SURE; 0 elsewhere. weights:
    how many rows each stands for in the prior, where labels were drawn at different rates."""
    n, m = votes.shape
    marks = np.zeros(n, int) if marks is None else marks
    given = np.where(marks > 0, SURE, 1 - SURE)
    p = np.where(marks != 0, given, np.clip(0.5 + 0.2 * votes.sum(1), 0.02, 0.98))
    model = LabelModel(prior, np.full((2, 3, m), 1 / 3), np.ones(m))
    for _ in range(rounds if n else 0):
        for y, q in ((1, p), (0, 1 - p)):
            for v in range(3):
                model.chance[y, v] = (q @ (votes == v - 1) + 0.5) / (q.sum() + 1.5)
        shared = np.zeros((m, m))
        for own in (votes[p > 0.5], votes[p <= 0.5]):
            rest = own - own.mean(0) if len(own) else np.zeros((0, m))
            shared += rest.T @ rest
        spread = np.sqrt(np.maximum(np.diag(shared), 0.001 * n + 1e-9))
        correlation = shared / spread[:, None] / spread[None, :]
        np.fill_diagonal(correlation, 0)
        model.weight = 1 / (1 + np.maximum(correlation, 0).sum(1))
        model.prior = float(np.clip(0.5 * model.prior + 0.5 * np.average(p, weights=weights), 0.01, 0.5))
        p = np.where(marks != 0, given, model.posterior(votes))
    return model, p


@dataclass
class Model:
    lexicon: Lexicon
    labels: LabelModel
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Mines lexicons from labelled rows where `learn` holds; lets the voters vote on about `sample` labelled rows where it holds,
    stratified by label, and on about `sample` documents' rows, of which those without a label are taken; fits the label model on
    them, with annotations as anchors, and a logistic classifier on its posterior labels. Prior and bias are those of the labels'
    own shares. Only votes and features come to the driver."""
    lexicon = mine(docs, labels, learn, label_col, id_col, text_col)
    base = docs.where(learn & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = base.count()
    among = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(max(total, sample))) < sample
    known = annotated(labels, learn, label_col, id_col)
    picked, n_clean, n_toxic = stratified(known, sample, 9)
    marks = picked.select("id", F.when(F.col("label") == 1, 1).otherwise(-1).alias("mark"))  # about `sample` rows at most
    others = known.where(among).select("id", F.lit(True).alias("known"))  # about `sample` rows at most
    found = base.join(F.broadcast(marks), "id", "left").join(F.broadcast(others), "id", "left").where(F.col("mark").isNotNull() | (among & F.col("known").isNull()))
    chosen = found.select("id", F.coalesce("mark", F.lit(0)).alias("mark"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(sent.value)
        for batch in slices(batches, "text"):
            votes, x = voters.look(batch.column(2))
            votes = np.column_stack([batch.column(1).to_numpy(), votes]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in votes], pa.binary()), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())], names=["id", "votes", "x"])

    got = chosen.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, votes binary, x binary").toArrow().sort_by("id")
    empty_votes, empty_x = Voters(lexicon).look(pa.array(["-"]))
    empty_votes = np.append(np.zeros((1, 1), np.int8), empty_votes, 1)
    votes = np.frombuffer(b"".join(got.column("votes").to_pylist()), np.int8).reshape(got.num_rows, empty_votes.shape[1])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), "<f8").reshape(got.num_rows, empty_x.shape[1])
    if not len(x):
        votes, x = empty_votes, empty_x
    weights = np.ones(len(votes))
    drawn = {mark: votes[:, 0] == mark for mark in (-1, 1)}
    if all(d.any() for d in drawn.values()):
        for mark, n in ((-1, n_clean), (1, n_toxic)):
            weights[drawn[mark]] = n / (n_clean + n_toxic) * (votes[:, 0] != 0).sum() / drawn[mark].sum()
    model, posterior = fit_labels(votes[:, 1:], 0.1, votes[:, 0], weights=weights)
    fitted = logistic(x, posterior, ridge=1e-4)
    whole, seen = (np.clip(np.average(posterior, weights=w), 1e-6, 1 - 1e-6) for w in (weights, None))
    fitted[-1] += np.log(whole / (1 - whole)) - np.log(seen / (1 - seen))
    return Model(lexicon, model, fitted)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The toxicity of every whole text: id_col and score (double, 0 to 1), by the text alone. Null and empty texts have the
    score of a text without words. A row for each row of docs; null ids stay null; other columns do not pass. A long text is looked
    at in pieces, cut between words; each piece sees the last words of the one before, so that patterns over a cut count as others do."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, w = Voters(sent.value.lexicon), sent.value.weights
        for batch in slices(batches, "text"):
            _, x = voters.look(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(x @ w[:-1] + w[-1]))], names=["id", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
