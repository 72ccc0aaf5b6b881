"""Toxicity classifier with counterfactual regularisation.

Features are the presence of words and of word beginnings.  The model is a logistic
regression with an L1 penalty, so that most weights are zero, and one more penalty: identity
terms of labelled texts are swapped for their counterparts, and a change of the score is
punished.  The model can't then take the mere mention of a group for toxicity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, Words, batch, mix, slices, tidied, utf8, word_hashes
from .shared import settle

#: Labelled rows that the model is fitted on at most: those with the least hash of their doc_id.
SAMPLE_ROWS = 20_000
#: Features that the model chooses from: those that most set the labels apart in the sample.
FEATURES = 4096
#: Lengths of word beginnings, in bytes.
BEGINNINGS = (4, 5, 6)
#: The L1 penalty is this over the square root of the number of rows: a small sample needs a stronger one.
L1 = 0.01
L2, COUNTERFACTUAL, STEPS = 1e-6, 1.0, 400
THRESHOLD = 0.7

# Identity terms and what each is swapped for, by language.
IDENTITY_TERMS = (
    ("he", "she"), ("him", "her"), ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("mother", "father"), ("wife", "husband"),
    ("muslim", "christian"), ("muslims", "christians"), ("jewish", "catholic"), ("jews", "catholics"), ("hindu", "buddhist"), ("atheist", "believer"),
    ("black", "white"), ("african", "european"), ("asian", "american"), ("immigrant", "citizen"), ("immigrants", "citizens"), ("refugee", "resident"), ("foreigner", "local"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"), ("disabled", "abled"), ("blind", "sighted"), ("deaf", "hearing"), ("old", "young"), ("poor", "rich"),
    # German
    ("er", "sie"), ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"), ("mutter", "vater"), ("muslime", "christen"), ("juden", "katholiken"), ("jüdisch", "katholisch"),
    ("schwarze", "weiße"), ("ausländer", "inländer"), ("flüchtling", "einwohner"), ("flüchtlinge", "einwohner"), ("schwul", "hetero"), ("lesbisch", "heterosexuell"), ("behinderte", "gesunde"), ("türken", "deutsche"),
    # French
    ("il", "elle"), ("femme", "homme"), ("femmes", "hommes"), ("fille", "garçon"), ("mère", "père"), ("musulman", "chrétien"), ("musulmans", "chrétiens"), ("juif", "catholique"), ("juifs", "catholiques"),
    ("noir", "blanc"), ("noirs", "blancs"), ("immigré", "citoyen"), ("immigrés", "citoyens"), ("réfugié", "habitant"), ("lesbienne", "hétérosexuelle"), ("handicapé", "valide"), ("arabes", "français"),
    # Spanish
    ("él", "ella"), ("mujer", "hombre"), ("mujeres", "hombres"), ("niña", "niño"), ("madre", "padre"), ("musulmán", "cristiano"), ("musulmanes", "cristianos"), ("judío", "católico"), ("judíos", "católicos"),
    ("negro", "blanco"), ("negros", "blancos"), ("inmigrante", "ciudadano"), ("inmigrantes", "ciudadanos"), ("refugiado", "residente"), ("lesbiana", "heterosexual"), ("discapacitado", "capacitado"), ("gitanos", "payos"),
)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all rows, and the row of each; repeats included."""
    words = Words(data, offsets, ALNUM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    own = data[offsets[0] : offsets[-1]]
    hashes, rows = [words.hashes], [row]
    size = words.ends - words.starts
    for k in BEGINNINGS:
        long = np.flatnonzero(size > k)
        head = own[words.starts[long, None] + np.arange(k)].astype(np.uint64)
        upper = (head >= 65) & (head <= 90)
        head = head + np.uint64(32) * upper
        name = np.full(len(long), k, np.uint64)
        for j in range(k):
            name = name * np.uint64(0x100000001B3) + head[:, j]
        hashes.append(mix(name ^ np.uint64(0xA5A5_0000_0000_0000)))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def _word_features(words: list[str]) -> list[np.ndarray]:
    data, offsets = utf8(pa.array(words, pa.string()))
    hashes, rows = _features(data, offsets)
    return [hashes[rows == i] for i in range(len(words))]


def _distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(rows) != 0) | (hashes[1:] != hashes[:-1])
    return hashes[new], rows[new]


def _label_counts(batches):
    """How many texts of each label have a feature; summed within a batch."""
    schema = pa.schema([("feature", pa.int64()), ("ones", pa.int64()), ("zeros", pa.int64())])
    for b in batches:
        data, offsets = utf8(b.column(0))
        label = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in slices(offsets):
            hashes, rows = _distinct(*_features(data, offsets[lo : hi + 1]))
            distinct, index = np.unique(hashes, return_inverse=True)
            ones = np.bincount(index, weights=label[lo:hi][rows], minlength=len(distinct)).astype(np.int64)
            every = np.bincount(index, minlength=len(distinct))
            yield batch({"feature": distinct.view(np.int64), "ones": ones, "zeros": every - ones}, schema)


def _matched(hashes: np.ndarray, rows: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) pairs, distinct, of the features that the model knows; ``names`` is sorted."""
    if not len(names) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spot = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
    hit = names[spot] == hashes
    key = np.unique(rows[hit].astype(np.int64) * len(names) + spot[hit])
    return key // len(names), key % len(names)


def _examples(chosen, terms):
    """Per labelled text its known features, and those after swapping identity terms (null without any)."""
    schema = pa.schema([("label", pa.int32()), ("has", pa.list_(pa.int32())), ("swapped", pa.list_(pa.int32()))])
    sides = [w for pair in terms for w in pair]
    other = [w for pair in terms for w in pair[::-1]]

    def run(batches):
        names = chosen.value
        term = word_hashes(sides)
        order = np.argsort(term)
        term = term[order]
        from_features, to_features = _word_features(sides), _word_features(other)
        for b in batches:
            data, offsets = utf8(b.column(0))
            label = b.column(1).to_pylist()
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                hashes, rows = _features(data, part)
                row, index = _matched(hashes, rows, names, hi - lo)
                has = np.split(index, np.searchsorted(row, np.arange(1, hi - lo)))
                swapped: list = [None] * (hi - lo)
                words = Words(data, part, ALNUM)
                spot = np.minimum(np.searchsorted(term, words.hashes), len(term) - 1)
                at = np.flatnonzero(term[spot] == words.hashes)
                owner = np.searchsorted(words.first, at, "right") - 1
                for i in np.unique(owner).tolist():
                    own = hashes[rows == i].tolist()
                    bag: dict = {}
                    for h in own:
                        bag[h] = bag.get(h, 0) + 1
                    for k in order[spot[at[owner == i]]].tolist():
                        for h in from_features[k].tolist():
                            bag[h] = bag.get(h, 0) - 1
                        for h in to_features[k].tolist():
                            bag[h] = bag.get(h, 0) + 1
                    kept = np.array([h for h, c in bag.items() if c > 0], np.uint64)
                    swapped[i] = _matched(kept, np.zeros(len(kept), np.int64), names, 1)[1]
                yield batch({"label": label[lo:hi], "has": pa.array([x.astype(np.int32) for x in has], schema.field("has").type), "swapped": swapped}, schema)

    return run


class Rows:
    """A sparse matrix of zeros and ones, by rows."""

    def __init__(self, lists: list, values: list | None = None) -> None:
        self.row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.col = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in lists]])
        self.value = np.concatenate(values) if values else np.ones(len(self.col))
        self.n = len(lists)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col] * self.value, minlength=self.n)

    def back(self, r: np.ndarray, k: int) -> np.ndarray:
        return np.bincount(self.col, weights=r[self.row] * self.value, minlength=k)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_weights(label, has, swapped, k: int, counterfactual: float = COUNTERFACTUAL, l1: float = L1, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient: balanced log loss + L1 + L2 + counterfactual penalty.  Returns weights and bias."""
    y = np.asarray(label, np.float64)
    n, ones = len(y), float(np.sum(label))
    if not 0 < ones < n:
        return np.zeros(k), 0.0
    weight = np.where(y > 0, 0.5 / ones, 0.5 / (n - ones))
    x = Rows(has)
    deltas = [(np.asarray(a), np.asarray(b)) for a, b in zip(has, swapped) if b is not None]
    d = Rows([np.concatenate([a, b]) for a, b in deltas], [np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in deltas])
    strength = 2 * counterfactual / max(1, d.n)

    def curvature(v, b):
        out = x.times(v) + b
        r = 0.25 * weight * out
        return x.back(r, k) + strength * d.back(d.times(v), k) + L2 * v, r.sum()

    v, b = np.ones(k) / np.sqrt(k), 1.0
    top = 1.0
    for _ in range(15):  # the largest curvature sets the step
        gv, gb = curvature(v, b)
        top = float(np.sqrt(gv @ gv + gb * gb))
        v, b = gv / top, gb / top
    step = 1.0 / (1.1 * top)
    w, b = np.zeros(k), 0.0
    vw, vb, t = w, b, 1.0
    for _ in range(steps):
        r = weight * (_sigmoid(x.times(vw) + vb) - y)
        g = x.back(r, k) + strength * d.back(d.times(vw), k) + L2 * vw
        nw = vw - step * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1 / np.sqrt(n), 0)
        nb = vb - step * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents: those whose doc_id has the least hash.

    Labels come from rows whose crc32(doc_id as text) mod 3 is not 1; of several labels of a
    document, the largest counts, and of several texts the least.  Null ids and labels don't count.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One row for each id, however often it is repeated: the sample's bound is one of rows, too.
    return docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Sparse weights by feature hash (sorted), a bias, and how many examples had identity terms to swap."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float, n_swapped: int = 0) -> None:
        self.names, self.weights, self.bias, self.n_swapped = names, weights, bias, n_swapped

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, index = _matched(*_features(data, offsets), self.names, n)
        total = np.bincount(row, weights=self.weights[index], minlength=n) if len(row) else np.zeros(n)
        return _sigmoid(total + self.bias)

    def score_texts(self, texts: list[str]) -> np.ndarray:
        return self.scores(*utf8(pa.array(texts, pa.string())))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, features: int = FEATURES, counterfactual: float = COUNTERFACTUAL, terms=IDENTITY_TERMS, l1: float = L1) -> Model:
    """Fit the model on the bounded sample.

    All features are counted where the texts are; only the counts of those that set the labels apart most, and
    each text's share of these, come to the driver.  Features of identity terms that the
    sample has always take part, so that the penalty holds them; those that it doesn't have weigh nothing,
    so that a term can't pass its weight on to a counterpart that no text speaks for.

    With labels of one kind only, or none, there is nothing to learn: all texts score 0.5 and none is called toxic.
    """
    spark = docs.sparkSession
    labelled = settle(sample(docs, labels, rows), "toxicity-sample")  # bounded, and read three times
    sizes = {r["label"]: r["n"] for r in labelled.groupBy(F.when(F.col("label") > 0, 1).otherwise(0).alias("label")).agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    labelled = labelled.select("text", F.when(F.col("label") > 0, 1).otherwise(0).alias("label"))
    counts = labelled.mapInArrow(tidied(_label_counts), "feature long, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    share = (F.col("ones") + F.col("zeros")) / F.lit(float(ones + zeros))
    apart = F.abs(F.col("ones") / F.lit(float(ones)) - F.col("zeros") / F.lit(float(zeros))) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)))
    named = np.unique(np.array([h for part in _word_features([w for pair in terms for w in pair]) for h in part], np.uint64)).view(np.int64).tolist()
    counts = counts.where("ones + zeros > 1").orderBy(F.col("feature").isin(named).desc(), apart.desc(), "feature")
    names = np.sort(counts.limit(features + len(named)).select("feature").toArrow()["feature"].to_numpy().view(np.uint64))
    chosen = spark.sparkContext.broadcast(names)
    rows_ = labelled.mapInArrow(tidied(_examples(chosen, terms)), "label int, has array<int>, swapped array<int>").toArrow()
    has = _lists(rows_["has"])
    swapped = [np.array(x) if x is not None else None for x in rows_["swapped"].to_pylist()]
    weights, bias = fit_weights(rows_["label"].to_numpy(), has, swapped, len(names), counterfactual, l1)
    used = np.flatnonzero(weights)
    return Model(names[used], weights[used], bias, sum(x is not None for x in swapped))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _score(sent):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        model = sent.value
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in slices(offsets):
                yield batch({"doc_id": b.column(0)[lo:hi], "score": model.scores(data, offsets[lo : hi + 1])}, schema)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text.

    Input: ``doc_id`` and ``text``; other columns are ignored.  Output, one row per input row:
    ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.7).  A null or
    wordless text gets the score of no features; texts of any length are read whole; a null doc_id stays null and is not held
    out; repeated rows get equal results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = docs.mapInArrow(tidied(_score(sent)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't call toxic, all columns; a null text is scored as an empty one."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(place))
            found = [sent.value.scores(data, offsets[lo : hi + 1]) for lo, hi in slices(offsets)]
            yield b.filter(pa.array(np.concatenate([np.zeros(0), *found]) < THRESHOLD))

    return docs.mapInArrow(tidied(run), docs.schema)
