"""Language identification by hierarchical discrimination.

Features are relative frequencies of hashed byte trigrams of the whole text
(A-Z lower-cased, digits and ASCII punctuation folded).  A first set of
one-versus-one linear support vector machines tells language families apart;
within a family, one-versus-one machines separate its languages.  A language
that FAMILIES does not list belongs to a family of unlisted ones that are
like it; families above FAMILY_MOST languages are halved along the principal
axis of their means, so the number of machines stays bounded.

Training takes a bounded sample of labelled rows, chosen by hash: of the
MAX_LANGUAGES languages with the most labelled rows (ties: by name) at most
PER_LANGUAGE rows each and MAX_ROWS in all, at least two each where the table
has them; only their sparse features reach the driver.

Defined results: a null text, or one without any letter, is ``und`` with score
0; so is every text if there is nothing to learn from.  The score is the
product of the logistic margins of the two deciding steps, from 0 to 1; ties of votes
go to the larger sum of margins, then to the name that sorts first.  Very long
texts are read whole, in chunks; repeated rows, and rows with a null id (which
are never held out), are predicted one by one; an empty table gives an empty
result; other columns are not read (``op2``) or passed through (``keep_identified``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokens import column_bytes

#: Bounds on the labelled rows that are learned from.
PER_LANGUAGE, MAX_ROWS, MAX_LANGUAGES = 300, 1500, 128
#: Languages of a family, at most.
FAMILY_MOST = 12
BUCKETS = 1 << 13
SLICE = 1 << 20
#: Logistic slope of a margin.
SLOPE = 4.0
UND = "und"
#: The stage keeps documents with at least this score (see the README for what it costs).
MIN_SCORE = 0.6
#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "indic": "hi bn mr gu pa ur ne si",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he am mt",
    "celtic": "ga cy br gd",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = regex.compile(r"\p{L}")

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:0x80] = ord(" ")
for _a in range(26):
    _FOLD[ord("a") + _a] = _FOLD[ord("A") + _a] = ord("a") + _a
_FOLD[ord("0") : ord("9") + 1] = ord("0")


def trigrams(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each byte of ``data``; BUCKETS where it would leave its text or is blank."""
    b = _FOLD[np.frombuffer(data, np.uint8)]
    code = b.copy()
    code[:-1] |= b[1:] << 8
    code[:-2] |= b[2:] << 16
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64)
    blank = (b[:-1] == 32) & (b[1:] == 32)
    bucket[:-1][blank] = BUCKETS
    for back in (1, 2):
        at = ends - back
        bucket[at[at >= 0]] = BUCKETS
    return bucket


def _runs(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > SLICE:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, buckets, frequencies) of each text."""
    for batch in batches:
        idx, val = [], []
        for t in column_bytes(batch.column(1)):
            n = np.bincount(trigrams(t + b" ", np.array([len(t) + 1])), minlength=BUCKETS + 1)[:BUCKETS] if t else np.zeros(BUCKETS, int)
            at = np.flatnonzero(n)
            idx.append(at.astype(np.int32))
            val.append((n[at] / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["lang", "idx", "val"]
        )


def train_svm(gram: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 40, seed: int = 7) -> np.ndarray:
    """Signed dual coefficients of a linear SVM (hinge loss) by coordinate descent on the Gram matrix, whose
    constant term is the bias: weights are their combination of the rows, the bias is their sum."""
    n, rng = len(y), np.random.default_rng(seed)
    upper = np.where(y > 0, cost * n / (2 * max(1, (y > 0).sum())), cost * n / (2 * max(1, (y < 0).sum())))
    alpha, out = np.zeros(n), np.zeros(n)
    for _ in range(epochs):
        for i in rng.permutation(n).tolist():
            new = min(max(alpha[i] - (y[i] * out[i] - 1) / gram[i, i], 0.0), upper[i])
            if new != alpha[i]:
                out += (new - alpha[i]) * y[i] * gram[i]
                alpha[i] = new
    return alpha * y


def _halved(members: list[str], mean: dict[str, np.ndarray]) -> list[list[str]]:
    """``members`` in groups of at most FAMILY_MOST, halved along the principal axis of their means."""
    if len(members) <= FAMILY_MOST:
        return [members]
    x = np.stack([mean[m] for m in members])
    axis = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[0][:, 0]
    order = np.argsort(axis, kind="stable")
    half = [sorted(members[k] for k in part.tolist()) for part in np.array_split(order, 2)]
    return [g for h in half for g in _halved(h, mean)]


def families_of(known: list[str], mean: dict[str, np.ndarray]) -> dict[str, list[str]]:
    """Family -> its languages."""
    groups: dict[str, list[str]] = {}
    for lang in known:
        groups.setdefault(FAMILY_OF.get(lang, "unlisted"), []).append(lang)
    return {name if not k else f"{name} {k + 1}": part for name in sorted(groups) for k, part in enumerate(_halved(groups[name], mean))}


@dataclass
class Model:
    """Families, their languages, and machines: (class a, class b, column of ``weights``)."""

    families: list[str]
    languages: dict[str, list[str]]
    weights: np.ndarray  # BUCKETS + 1 rows
    bias: np.ndarray
    upper: list[tuple[int, int, int]] = field(default_factory=list)
    inner: dict[str, list[tuple[int, int, int]]] = field(default_factory=dict)

    @staticmethod
    def _vote(margin: np.ndarray, machines: list[tuple[int, int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the votes (ties: larger sum of margins) and the least margin of its own machines."""
        rows = len(margin)
        votes, least = np.zeros((rows, n)), np.full((rows, n), np.inf)
        for a, b, k in machines:
            m = margin[:, k]
            votes[:, a] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[:, b] += (m < 0) - 1e-3 * np.tanh(m)
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        best = votes.argmax(axis=1)
        return best, least[np.arange(rows), best]

    def predict(self, margin: np.ndarray) -> tuple[list[str], np.ndarray]:
        sure = lambda m: 1.0 / (1.0 + np.exp(-SLOPE * np.clip(m, -50, 50)))
        family, m = self._vote(margin, self.upper, len(self.families))
        score = sure(m)
        lang = np.empty(len(margin), object)
        for f, name in enumerate(self.families):
            at = np.flatnonzero(family == f)
            if len(at):
                best, m = self._vote(margin[at], self.inner[name], len(self.languages[name]))
                lang[at] = [self.languages[name][k] for k in best.tolist()]
                score[at] *= sure(m)
        return lang.tolist(), score


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> Model | None:
    """A model of the non-null languages of ``labelled`` (doc_id, text, lang); None if there are none.

    At most ``per_language`` rows a language and ``max_rows`` rows are learned from.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    counts = {r[0]: r[1] for r in top.collect()}
    if not counts:
        return None
    each = max(2, min(per_language, max_rows // len(counts)))
    drawn = each + 4 * math.isqrt(each) + 8  # so that chance leaves no language below its share
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, drawn / n)))])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.where(chance < share[F.col("lang")]).select("lang", "text").limit(2 * drawn * len(counts))
    sample = map_arrow(taken, _features, "lang string, idx array<int>, val array<float>").toArrow()
    order = np.lexsort((np.arange(sample.num_rows), np.array(sample.column("lang").to_pylist(), str)))
    by_lang = np.array(sample.column("lang").to_pylist(), object)[order]
    nth = np.arange(len(order)) - np.searchsorted(by_lang.astype(str), by_lang.astype(str))
    sample = sample.take(pa.array(order[nth < each]))
    langs = sample.column("lang").to_pylist()
    x = np.zeros((len(langs), BUCKETS), np.float32)
    for r, (i, v) in enumerate(zip(sample.column("idx"), sample.column("val"))):
        x[r, i.values.to_numpy()] = v.values.to_numpy()
    # rare and frequent trigrams on one scale: what matters is how far a frequency is from the mean
    scale = 1.0 / np.sqrt(x.mean(axis=0) + 1e-6)
    x *= scale
    known = sorted(set(langs))
    y = np.array([known.index(lang) for lang in langs])
    languages = families_of(known, {lang: x[y == k].mean(axis=0) for k, lang in enumerate(known)})
    families = list(languages)
    family = {lang: f for f, name in enumerate(families) for lang in languages[name]}
    g = np.array([family[lang] for lang in langs])
    gram = (x @ x.T).astype(np.float64) + 1.0  # the bias is one more constant feature
    columns: list[np.ndarray] = []
    biases: list[float] = []

    def machines(label: np.ndarray, n: int) -> list[tuple[int, int, int]]:
        out = []
        for a, b in combinations(range(n), 2):
            at = np.flatnonzero((label == a) | (label == b))
            of_row = np.zeros(len(label), np.float32)
            of_row[at] = train_svm(gram[np.ix_(at, at)], np.where(label[at] == a, 1.0, -1.0))
            columns.append((of_row @ x) * scale)
            biases.append(float(of_row.sum(dtype=np.float64)))
            out.append((a, b, len(columns) - 1))
        return out

    upper = machines(g, len(families))
    inner = {}
    for f, name in enumerate(families):
        own = {known.index(lang): k for k, lang in enumerate(languages[name])}
        inner[name] = machines(np.array([own.get(k, -1) if h == f else -1 for k, h in zip(y.tolist(), g.tolist())]), len(own))
    weights = np.zeros((BUCKETS + 1, max(1, len(columns))), np.float32)
    for k, w in enumerate(columns):
        weights[:BUCKETS, k] = w
    return Model(families, languages, weights, np.array(biases or [0.0]), upper, inner)


def judge(model: Model | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and score of every text."""
    lang: list[str] = []
    score: list[float] = []
    for group in _runs(texts):
        letter = np.fromiter((bool(LETTER.search(t.decode())) for t in group), bool, len(group))
        if model is None or not letter.any():
            lang += [UND] * len(group)
            score += [0.0] * len(group)
            continue
        data = b" ".join(group) + b" "
        ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
        bucket = trigrams(data, ends)
        begin = np.concatenate([[0], ends[:-1]])
        count = np.maximum(np.add.reduceat(bucket < BUCKETS, begin, dtype=np.int64), 1)
        sums = [np.add.reduceat(model.weights[:, k][bucket], begin, dtype=np.float64) for k in range(model.weights.shape[1])]
        names, sure = model.predict(np.stack(sums, axis=1) / count[:, None] + model.bias)
        lang += [n if ok else UND for n, ok in zip(names, letter)]
        score += np.where(letter, sure, 0.0).tolist()
    return lang, score


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = judge(shared.value, column_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["key", "lang_pred", "score"])

    return run


def _kept(shared, at: int, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch.column(at))
            if shared.value is None:
                good = [bool(LETTER.search(t.decode())) for t in texts]
            else:
                lang, score = judge(shared.value, texts)
                good = [x != UND and s >= min_score for x, s in zip(lang, score)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return run


def held_out() -> F.Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def _model(source: DataFrame):
    """The model of the rows of ``source`` that are not held out, sent to the workers: BUCKETS rows by its machines."""
    model = fit(source.select("doc_id", "text", "lang").where(~held_out()))
    return source.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``; learned from the rows of
    ``labelled`` (default: ``docs``) that are not held out."""
    shared = _model(docs if labelled is None else labelled)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(docs.select("doc_id", "text"), _predicted(shared), f"key {kind}, lang_pred string, score double")
    return rows.withColumnRenamed("key", "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` in a learned language with at least ``min_score``, with their own columns;
    those with a letter if there is nothing to learn from."""
    at = next(k for k, c in enumerate(docs.columns) if c.lower() == "text")
    return map_arrow(docs, _kept(_model(docs), at, min_score), docs.schema)


def op2(docs: DataFrame) -> DataFrame:
    return identify(docs)
