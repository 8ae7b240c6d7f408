"""Toxicity: a linear classifier whose scores are held still when identity terms are swapped."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import mix, prepare, rolling_bytes, slices, text_bytes, word_spans
from fieldloom.session import materialize

#: Labelled documents that a model is fitted on at most (those of the smallest id hash),
#: features it has at most, and documents of its class that a feature must occur in.
FIT_DOCUMENTS = 20_000
FEATURES = 4096
LEAST_DOCUMENTS = 3
#: Weight of the squared change of a score under a swap, and of the squared weights.
SWAP_PENALTY = 1.0
RIDGE = 1e-5
FOLDS = 5

# Identity terms by group, in English, French, German and Spanish; a swap puts each
# other term of the group in place.
IDENTITY = (
    "women men girls boys",
    "woman man girl boy",
    "female male",
    "christian muslim jewish hindu buddhist atheist",
    "christians muslims jews hindus buddhists atheists",
    "black white asian latino",
    "gay straight lesbian bisexual transgender",
    "immigrants refugees foreigners citizens",
    "african american european mexican chinese indian",
    "disabled deaf blind autistic",
    "old young elderly",
    "femmes hommes filles garçons",
    "femme homme fille garçon",
    "chrétien musulman juif hindou bouddhiste athée",
    "chrétiens musulmans juifs hindous bouddhistes athées",
    "immigrés réfugiés étrangers citoyens",
    "africains américains européens mexicains chinois indiens",
    "homosexuels hétérosexuels lesbiennes bisexuels",
    "frauen männer mädchen jungen",
    "frau mann",
    "christen muslime juden hindus buddhisten atheisten",
    "einwanderer flüchtlinge ausländer bürger",
    "afrikaner amerikaner europäer mexikaner chinesen inder",
    "schwule lesben heterosexuelle bisexuelle",
    "mujeres hombres niñas niños",
    "mujer hombre niña niño",
    "cristianos musulmanes judíos hindúes budistas ateos",
    "inmigrantes refugiados extranjeros ciudadanos",
    "africanos americanos europeos mexicanos chinos indios",
    "homosexuales heterosexuales lesbianas bisexuales",
)
#: Lengths in bytes of the word beginnings that are features besides whole words.
PREFIXES = (4, 5, 6, 7, 8)

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


class Terms:
    """The terms of groups, and what each is swapped for."""

    def __init__(self, groups=IDENTITY):
        self.others: dict[str, list[str]] = {}
        for group in groups:
            terms = group.lower().split()
            for term in terms:
                known = self.others.setdefault(term, [])
                known += [x for x in terms if x != term and x not in known]
        names = "|".join(map(re.escape, sorted(self.others, key=len, reverse=True)))
        self.pattern = re.compile(rf"\b(?:{names})\b" if names else r"(?!)")

    def swaps(self, text: str):
        """(sentence, sentence with a term swapped) for every term of a text."""
        lower = text.lower()
        if self.pattern.search(lower):
            for sentence in _SENTENCE.findall(lower):
                for found in self.pattern.finditer(sentence):
                    for other in self.others[found[0]]:
                        yield sentence, sentence[: found.start()] + other + sentence[found.end() :]


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of texts, each once: hashes of words and word beginnings.

    With ``wanted`` (ordered) only its features, as places in it.
    """
    column = pc.utf8_lower(texts)
    data, bounds = text_bytes(column)
    starts, ends, rows = word_spans(data, bounds, _LETTERS)
    hashes = rolling_bytes(data)
    out_rows, out = [], []
    for k in (0, *PREFIXES):
        long = np.full(len(starts), True) if k == 0 else ends - starts > k
        some = starts[long]
        code = mix(hashes(some, ends[long] if k == 0 else some + k) + np.uint64(k))
        of = rows[long]
        if wanted is not None:
            if not len(wanted):
                continue
            place = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1) if len(code) < 256 else _places(wanted, code)
            hit = (place >= 0) & (wanted[place] == code)
            of, code = of[hit], place[hit].astype(np.uint64)
        out_rows.append(of)
        out.append(code)
    rows, codes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_rows, out))
    if not len(rows):
        return rows.astype(np.int64), codes.astype(np.uint64)
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])])
    return rows[new], codes[new]


def _places(wanted: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of codes in ``wanted``, or -1; most codes are ruled out by a table of their top bits."""
    table = np.zeros(1 << 18, bool)
    table[wanted >> np.uint64(46)] = True
    place = np.full(len(codes), -1, np.int64)
    maybe = np.flatnonzero(table[codes >> np.uint64(46)])
    place[maybe] = np.minimum(np.searchsorted(wanted, codes[maybe]), len(wanted) - 1)
    return place


@dataclass
class Model:
    """Feature hashes in order, their weights, and the base score (log odds)."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        rows, places = features(texts, self.features)
        z = np.bincount(rows, self.weights[places.astype(np.int64)], len(texts)) if len(rows) else np.zeros(len(texts))
        return self._share(z + self.bias)

    @staticmethod
    def _share(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def term_places(self, terms: Terms) -> dict[str, set[int]]:
        names = list(terms.others)
        rows, places = features(pa.array(names, pa.string()), self.features)
        out = {name: set() for name in names}
        for row, place in zip(rows.tolist(), places.tolist()):
            out[names[row]].add(place)
        return out

    def largest_change(self, text: str, terms: Terms, places: dict[str, set[int]]) -> tuple[float, int]:
        """The largest change of a text's score when one of its terms is replaced throughout, and how many such swaps it has."""
        lower = text.lower()
        found = set(terms.pattern.findall(lower))
        if not found:
            return 0.0, 0
        words = sorted(set(_WORD.findall(lower)))
        _, own = features(pa.array(words, pa.string()), self.features)
        times = np.bincount(own.astype(np.int64), minlength=len(self.features))
        z = float(self.weights[times > 0].sum()) + self.bias
        largest, swaps = 0.0, 0
        for term in sorted(found):
            gone = places[term]
            lost = sum(self.weights[p] for p in gone if times[p] == 1)
            for other in terms.others[term]:
                gained = sum(self.weights[p] for p in places[other] if times[p] - (p in gone) == 0)
                largest = max(largest, abs(float(self._share(z - lost + gained) - self._share(z))))
                swaps += 1
        return largest, swaps


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents to learn from, ``limit`` at most."""
    learn = labels.where("doc_id is not null and toxic in (0, 1)").where(f"crc32(cast(doc_id as string)) % {FOLDS} <> 0")
    # Both are bounded by the documented limit.
    chosen = learn.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.join(F.broadcast(chosen), "doc_id")


def _chosen_features(sample: DataFrame, n_clean: int, n_toxic: int, limit: int) -> np.ndarray:
    """Hashes of the features that differ most between the classes, in order."""

    def count(batches):
        found = [[], []]
        for batch in batches:
            for part in slices(batch):
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                rows, codes = features(part.column("text"))
                for label in (0, 1):
                    found[label].append(np.unique(codes[toxic[rows] == label], return_counts=True))
        for label in (0, 1):
            if found[label]:
                codes, counts = (np.concatenate(x) for x in zip(*found[label]))
                codes, at = np.unique(codes, return_inverse=True)
                sums = np.bincount(at, counts).astype(np.int64)
                for first in range(0, len(codes), 100_000):
                    some = slice(first, first + 100_000)
                    columns = [pa.array(codes[some].view(np.int64)), pa.array(sums[some]), pa.array(np.full(len(codes[some]), label))]
                    yield pa.RecordBatch.from_arrays(columns, names=["code", "n", "toxic"])

    counts = sample.mapInArrow(count, "code bigint, n bigint, toxic bigint")
    by_code = counts.groupBy("code").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    # Rates in both classes with half a document added; the difference in standard errors.
    rates = by_code.where(f"greatest(t, c) >= {LEAST_DOCUMENTS}").selectExpr("code", f"(t + 0.5) / {n_toxic + 1} as p", f"(c + 0.5) / {n_clean + 1} as q")
    apart = rates.selectExpr("code", f"abs(ln(p / q)) / sqrt(1 / (p * {n_toxic + 1}) + 1 / (q * {n_clean + 1})) as apart").where("apart > 2")
    best = apart.orderBy(F.desc("apart"), "code").limit(limit).select("code").collect()
    return np.sort(np.array([r[0] for r in best], np.int64).view(np.uint64))


def fit(
    docs: DataFrame, labels: DataFrame, penalty: float = SWAP_PENALTY, limit: int = FIT_DOCUMENTS, n_features: int = FEATURES, steps: int = 400,
    groups=IDENTITY,
) -> Model:
    """A logistic model of ``toxic`` on documents (doc_id, text) whose fold is not held out.

    Besides the labelled documents the fit sees their sentences with a term of ``groups``,
    next to the same sentence with another term of the group: the squared change of the
    log odds is penalised, so terms that only happen to stand in toxic documents get
    little weight. Documents are bounded by ``limit``; what comes to the driver is their places
    among at most ``n_features`` features, and of all their sentences the differences that swaps
    make, each once with its number: as a swap changes one word, these are few. Without labels
    of both classes, every score is the (smoothed) share of toxic labels.
    """
    prepare(docs.sparkSession)
    sample = materialize(_sample(docs, labels, limit), "labelled")
    seen = dict(sample.groupBy("toxic").count().collect())
    n_clean, n_toxic = seen.get(0, 0), seen.get(1, 0)
    bias = float(np.log((n_toxic + 0.5) / (n_clean + 0.5)))
    if not n_clean or not n_toxic:
        return Model(np.zeros(0, np.uint64), np.zeros(0), bias if n_clean + n_toxic else -2.0)
    wanted = _chosen_features(sample, n_clean, n_toxic, n_features)

    terms = Terms(groups)

    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                of, places = features(text, wanted)
                lists = [places[of == i].astype(np.int64).tolist() for i in range(part.num_rows)]
                out = list(zip(part.column("doc_id").to_pylist(), part.column("toxic").to_pylist(), lists, [None] * len(lists)))
                for one in text.to_pylist():
                    pairs = list(terms.swaps(one))
                    for first in range(0, len(pairs), 1000):
                        sides = []
                        for side in zip(*pairs[first : first + 1000]):
                            of, places = features(pa.array(side, pa.string()), wanted)
                            sides.append([set(places[of == i].astype(np.int64).tolist()) for i in range(len(side))])
                        out += [(None, None, sorted(a - b), sorted(b - a)) for a, b in zip(*sides)]
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                columns = [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "own", "other"])

    made = sample.mapInArrow(rows, "doc_id bigint, toxic bigint, own array<bigint>, other array<bigint>")
    labelled = made.where("toxic is not null").orderBy("doc_id", F.xxhash64("own")).toPandas()
    swaps = made.where("toxic is null").groupBy("own", "other").agg(F.count("*").alias("n")).orderBy(F.xxhash64("own", "other")).toPandas()
    times = swaps["n"].to_numpy(float)
    x = _Sparse(labelled["own"], len(wanted))
    a, b = _Sparse(swaps["own"], len(wanted)), _Sparse(swaps["other"], len(wanted))
    y = labelled["toxic"].to_numpy(float)
    weights = np.zeros(len(wanted))
    moments = np.zeros((2, len(wanted) + 1))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -40, 40)))
        gradient = x.back(p - y) / len(y) + RIDGE * weights
        if a.n and penalty:
            change = a @ weights - b @ weights
            gradient += 2 * penalty * (a.back(times * change) - b.back(times * change)) / times.sum()
        gradient = np.append(gradient, np.mean(p - y))
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = 0.1 * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return Model(wanted, weights, float(bias))


class _Sparse:
    """Rows of 0/1 features as flat places."""

    def __init__(self, lists, width: int):
        self.n, self.width = len(lists), width
        self.rows = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.places = np.concatenate([np.zeros(0, np.int64), *map(np.asarray, lists)]).astype(np.int64)

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.places], self.n) if self.n else np.zeros(0)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.places, values[self.rows], self.width) if self.n else np.zeros(self.width)


def score_documents(docs: DataFrame, model: Model, groups=IDENTITY) -> DataFrame:
    """(doc_id, score, predicted, swap_change, n_swaps) of whole texts.

    ``swap_change`` is the largest change of the score when one term of the text is replaced
    throughout by another of its group, ``n_swaps`` how many such swaps the text has.
    """
    prepare(docs.sparkSession)
    terms = Terms(groups)
    places = model.term_places(terms)
    some = "|".join(map(re.escape, sorted(terms.others))) or "a^"

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                score = model.score(text)
                change, swaps = np.zeros(len(score)), np.zeros(len(score), np.int64)
                for k in np.flatnonzero(pc.match_substring_regex(text, some, ignore_case=True).to_numpy(zero_copy_only=False)).tolist():
                    change[k], swaps[k] = model.largest_change(text[k].as_py(), terms, places)
                columns = [part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(change), pa.array(swaps)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "swap_change", "n_swaps"])

    return docs.mapInArrow(run, "doc_id bigint, score double, predicted int, swap_change double, n_swaps bigint")


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=IDENTITY) -> DataFrame:
    """Per document whether it is held out, its score and the class from 0.5 on, and what swaps of its terms change.

    Learns from labels whose crc32(doc_id as text) mod ``FOLDS`` is not 0. Null and empty
    texts get the score of a text without known features; a null id is not held out;
    repeated labels of one document count once (toxic if any says so), labels other than
    0 and 1 not at all; repeated rows stay; other columns are ignored; an empty table gives
    an empty one.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    scored = score_documents(rows, fit(rows, known, groups=groups), groups)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "swap_change", "n_swaps")
