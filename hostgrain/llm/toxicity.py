"""Toxicity scores by weak supervision.

Many voters look at a text, each with one question: does it hold this word of a lexicon, this word or word beginning that
toxic texts of the labelled rows hold far more often than others, does it shout. A voter that doesn't fire abstains.
A generative label model takes the true class of each text of a sample as hidden: how often each voter fires in either
class is estimated by expectation maximisation, from how voters agree, with the given labels as one more voter that may
err. Voters that fire together beyond what the class explains are correlated; each then counts for a part of its vote, so
that ten forms of one word don't count as ten witnesses. The posterior labels, not the given ones, train a linear
classifier on the presence of words, word beginnings and patterns. It scores every text.

What is fitted sees a bounded sample of labelled rows, one of each family of near copies. Scoring is one pass over whole
texts, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import shingle_set

#: Insults in English, German, French and Spanish. Each is a voter.
LEXICON = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool foolish imbecile loser losers worthless pathetic scum trash garbage clown "
    "disgusting filth filthy vermin creep jerk bastard bitch asshole retard retarded shit shitty fuck fucking damn hate ugly liar coward "
    "idiotin dumm dummkopf trottel arschloch abschaum versager widerlich ekelhaft scheiße schwein wertlos hässlich lügner feigling "
    "idiote stupide imbécile crétin abruti connard salaud ordure minable dégoûtant merde raté lâche menteur "
    "idiota estúpido estúpida imbécil tonto cretino basura escoria payaso patético asqueroso mierda cabrón cobarde mentiroso"
).split()
#: Bound of the sample: families of near copies of each label, or of unlabelled texts where nothing is labelled.
PER_LABEL = 4000
#: So many times as many labelled ids are drawn, to be one family or another.
CANDIDATES = 4
#: At most so many mined voters, and features of the classifier.
VOTERS, FEATURES = 256, 1024
#: A mined voter fires in VOTER_FAMILIES toxic families or more, VOTER_RATIO times as often as in others, and by so many standard errors.
VOTER_FAMILIES, VOTER_RATIO, VOTER_Z, FEATURE_Z = 5, 5.0, 5.0, 3.0
#: Lengths of word beginnings.
BEGINNINGS = (4, 5)
#: A beginning that several words of a text have: how many at least, and what percentage of all its words.
TIMES, DENSITIES = (2, 4), (0.4, 0.8, 1.6)
#: Correlations of voters below this count as none.
CORRELATED = 0.1
DIGITS = 6
#: What a word of the lexicon weighs where the sample says nothing about it: two of them make a text toxic.
LEXICON_WEIGHT = 2.0
#: Texts whose features are sent on together.
AT_ONCE = 64

_TOKEN = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*")
_DISGUISE = str.maketrans("01345@$7", "oieasast")
_SHOUT = re.compile(r"!{3,}|[!?]{4,}")
_YOU_ARE = re.compile(r"\byou(?:'re| are) (?:an? |all |such )|\bdu bist (?:ein |so )|\btu es (?:un |une )|\beres (?:un |una )")


def features_of(text: str | None) -> set[str]:
    """What a text holds: ``w:`` words in lower case (digits in words read as the letters they stand for), ``b:`` beginnings
    of longer words, also how many different words have them and what share of all that is (``x2``, ``x2>0.4%``), and ``p:`` patterns. Empty
    for null and empty texts."""
    if not text:
        return set()
    low = text.lower()
    words = set(_TOKEN.findall(low))
    words |= {w.translate(_DISGUISE) for w in words if not w.isalpha() and any(map(str.isalpha, w))}
    out = {"w:" + w for w in words}
    for n in BEGINNINGS:
        for start, times in Counter(w[:n] for w in words if len(w) > n).items():
            out.add("b:" + start)
            if times > 1:
                out.update(f"b:{start} x{k}" for k in TIMES if times >= k)
                out.update(f"b:{start} x2>{d}%" for d in DENSITIES if 100 * times >= d * len(words))
    letters = sum(map(str.isalpha, text))
    if letters >= 20 and 2 * sum(map(str.isupper, text)) > letters:
        out.add("p:capitals")
    if _SHOUT.search(text):
        out.add("p:shout")
    if _YOU_ARE.search(low):
        out.add("p:you are")
    return out


@dataclass
class LabelModel:
    """Hidden classes behind binary votes. fires[c, j]: the chance that voter j fires in class c (1: toxic); share[j]: the part
    of its vote that counts."""

    prior: float = 0.5
    fires: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))
    given: np.ndarray = field(default_factory=lambda: np.array([0.05, 0.95]))  # chance that the given label is 1, by class

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Of each row the chance of class 1. given: 0, 1, or NaN where nothing is given. Who abstains says nothing, but for all abstaining together."""
        yes, no = np.log(self.fires[1] / self.fires[0]), np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        z = math.log(self.prior / (1 - self.prior)) + votes @ (self.share * (yes - no)).astype(votes.dtype) + (self.share * no).sum()
        one, zero = np.log(self.given[1] / self.given[0]), np.log((1 - self.given[1]) / (1 - self.given[0]))
        z = z + np.where(np.isnan(given), 0, np.where(given == 1, one, zero))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def fit(self, votes: np.ndarray, given: np.ndarray, start: np.ndarray, rounds: int = 25) -> np.ndarray:
        """Estimates everything from the votes, from a first guess of the classes on; returns the posterior."""
        q, known = start.astype(float), ~np.isnan(given)
        for _ in range(rounds):
            weight = np.stack([1 - q, q])
            size = weight.sum(1, keepdims=True)
            self.fires = np.clip((weight.astype(votes.dtype) @ votes + 0.1) / (size + 1), 1e-4, 1 - 1e-4)
            self.fires[1] = np.maximum(self.fires[1], self.fires[0])  # no voter is worse than chance
            self.prior = float(np.clip((q.sum() + 1) / (len(q) + 2), 0.01, 0.99))
            if known.any():
                said = (weight[:, known] @ given[known] + 0.5) / (weight[:, known].sum(1) + 1)
                self.given = np.clip([min(said), max(said)], 0.02, 0.98)
            self.share = 1 / (1 + self.dependence(votes, q))
            q = self.posterior(votes, given)
        return q

    def dependence(self, votes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For each voter, the sum of its correlations with others that the class leaves unexplained."""
        left = votes - np.stack([1 - q, q], 1).astype(votes.dtype) @ self.fires.astype(votes.dtype)
        cov = (left.T @ left).astype(float)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(scale, scale)
        np.fill_diagonal(corr, 0)
        return np.where(corr > CORRELATED, corr, 0).sum(1)


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        """0 to 1; the same for equal texts, whatever is scored beside them."""
        z = self.bias + math.fsum(self.weights[f] for f in features_of(text) if f in self.weights)
        return round(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), DIGITS)


def fit_linear(x: np.ndarray, q: np.ndarray, expected: np.ndarray | float = 0.0, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam over all rows; both classes weigh the same in total. ridge pulls weights to
    those that are expected."""
    w, b = np.zeros(x.shape[1]) + expected, 0.0
    expected = w
    weight = q / max(q.sum(), 1e-9) + (1 - q) / max((1 - q).sum(), 1e-9)
    weight = weight / weight.sum()
    m = v = np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b, -50, 50)))
        off = weight * (p - q)
        g = np.append(off.astype(x.dtype) @ x + ridge * (w - expected), off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def held_out(id: str) -> Column:
    """Documents whose labels teach nothing: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, given: DataFrame, per_label: int) -> DataFrame:
    """_label, _key, _text: one of each family of near copies, at most per_label families of each label. docs: _id, _text; given:
    _id, _label. Ids are drawn first, CANDIDATES times as many, by hash: what moves of the labelled texts is bounded."""

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [int(s.min().astype(np.int64)) if len(s := shingle_set(t, 3)) else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], ["_label", "_h", "_family"])

    def first(rows: DataFrame, n: int, *order: str) -> DataFrame:
        """n rows of each label, in the order given."""
        out = None
        for r in rows.select("_label").distinct().collect():  # 0, 1 or null
            of = rows.filter(F.col("_label").eqNullSafe(F.lit(r._label).cast("int"))).orderBy(*order).limit(n)
            out = of if out is None else out.unionByName(of)
        return rows.limit(0) if out is None else out

    drawn = first(cut(given.filter("_id IS NOT NULL").distinct().withColumn("_draw", F.xxhash64(F.lit("toxicity"), "_id"))), CANDIDATES * per_label, "_draw", "_id")
    drawn = cut(drawn.select("_id", "_label"))
    key = F.xxhash64("_label", "_text").alias("_key")
    rows = docs.filter(F.col("_text").isNotNull()).join(F.broadcast(drawn), "_id")
    found = rows.select("_label", key, "_text").mapInArrow(families, "_label int, _h long, _family long")
    one = cut(found.groupBy("_label", "_family").agg(F.min("_h").alias("_key")))
    picked = cut(first(one, per_label, "_key").select("_key").distinct())  # per_label rows a label at most
    return rows.select("_label", key, "_text").join(F.broadcast(picked), "_key", "left_semi").dropDuplicates(["_key"])


def train_toxicity(docs: DataFrame, labels: DataFrame | None, per_label: int = PER_LABEL, id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fits the label model and the classifier. labels: id and a label that is 0 or 1 (other rows teach nothing; give only those that may).
    Where there are none, classes are estimated from how the lexicon's voters agree on a sample of docs with an id. Without any text the
    classifier is the lexicon alone."""
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    given = None
    if labels is not None:
        given = labels.filter(F.col(label).isin(0, 1)).select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label"))
    if given is None or not given.take(1):
        given = rows.select("_id", F.lit(None).cast("int").alias("_label"))
    sample = cut(_sample(rows, given, per_label))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), AT_ONCE):
                some = b.slice(at, AT_ONCE)
                found = [sorted(features_of(t)) for t in some.column(2).to_pylist()]
                times = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([some.column(0).take(times), some.column(1).take(times), pa.array([x for f in found for x in f], pa.string())], ["_label", "_key", "feature"])

    held = cut(sample.select("_label", "_key", "_text").mapInArrow(spread, "_label int, _key long, feature string"))
    keys = sample.select("_key", "_label").toArrow().sort_by("_key")  # the sample's rows
    said = keys["_label"].to_numpy(zero_copy_only=False).astype(float)
    size = {c: max(1, int((said == c).sum())) for c in (0, 1)}
    toxic, clean = F.count(F.when(F.col("_label") == 1, 1)), F.count(F.when(F.col("_label") == 0, 1))
    counts = held.groupBy("feature").agg(toxic.alias("a"), clean.alias("b"))
    a, b = F.col("a") / size[1], F.col("b") / size[0]
    pooled = (F.col("a") + F.col("b")) / (size[0] + size[1])
    z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / size[0] + 1 / size[1]) + 1e-12)
    given_voters = ["p:capitals", "p:shout", "p:you are", *("w:" + w for w in LEXICON)]
    mined = counts.withColumn("z", z).filter(F.abs("z") >= FEATURE_Z).orderBy(F.abs("z").desc(), "feature").limit(FEATURES).collect()
    voters = [r.feature for r in mined if r.z >= VOTER_Z and r.a >= VOTER_FAMILIES and r.a / size[1] >= VOTER_RATIO * r.b / size[0]][:VOTERS]
    voters += [f for f in given_voters if f not in set(voters)]
    names = voters + [r.feature for r in mined if r.feature not in set(voters)]
    if not len(keys):
        return ToxicityModel({"w:" + w: 2 * LEXICON_WEIGHT for w in LEXICON}, -LEXICON_WEIGHT)
    place = held.sparkSession.createDataFrame(list(enumerate(names)), "place int, feature string")
    got = held.join(F.broadcast(place), "feature").select("_key", "place").toArrow()  # the sample's rows times the features at most
    x = np.zeros((len(keys), len(names)), np.float32)
    x[np.searchsorted(keys["_key"].to_numpy(), got["_key"].to_numpy()), got["place"].to_numpy()] = 1
    votes = x[:, : len(voters)]
    start = np.where(np.isnan(said), np.where(votes.any(1), 0.9, 0.1), np.where(said == 1, 0.95, 0.05))
    q = LabelModel().fit(votes, said, start)
    known = {"w:" + w for w in LEXICON}
    w, bias = fit_linear(x, q, np.array([LEXICON_WEIGHT if f in known else 0.0 for f in names]))
    return ToxicityModel({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-6}, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, ``score`` (0 to 1, to six digits) and ``predicted`` (1 from 0.5 on) of every row. Equal texts
    have equal scores. Null and empty texts, which hold nothing, have the score of no evidence, below 0.5 unless
    toxic texts are taught to be empty. Repeated rows stay; an empty table gives an empty result."""
    src = docs.select(F.col(id).alias("doc_id"), *(F.col(c) for c in keep), F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*b.schema.names[:-1], "score", "predicted"])

    return src.mapInArrow(run, f"{fields}, score double, predicted int")
