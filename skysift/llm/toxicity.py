"""Toxicity: a classifier of words by character n-grams, pooled over a text, with a penalty on score changes when identity terms are swapped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.textkit import chunks, utf8_buffers

BITS = 18
SIZES = (3, 4, 5, 6)
THRESHOLD = 0.3
#: At most so many labelled rows of each label are used for training, those with the least hash of doc_id.
MOST_TOXIC, MOST_CLEAN = 2_000, 3_000
ROUNDS, RATE, DECAY, FAIRNESS, START = 120, 0.1, 1e-5, 1.0, -6.0

#: Identity terms in the corpus's languages; those of a group are swapped for one another.
IDENTITY_GROUPS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["gay", "straight"], ["lesbian", "heterosexual"], ["transgender", "cisgender"],
    ["black", "white", "asian", "latino"], ["muslim", "christian", "jewish", "hindu", "buddhist"], ["muslims", "christians", "jews", "hindus", "buddhists"],
    ["immigrants", "natives"], ["immigrant", "native"], ["disabled", "blind", "deaf"], ["old", "young"],
    ["frauen", "männer"], ["frau", "mann"], ["mädchen", "jungen"], ["muslime", "christen", "juden", "hinduisten", "buddhisten"], ["einwanderer", "einheimische"], ["schwule", "heterosexuelle"], ["alte", "junge"], ["blinde", "gehörlose", "behinderte"],
    ["femmes", "hommes"], ["femme", "homme"], ["filles", "garçons"], ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"], ["immigrés", "natifs"], ["gays", "hétéros"], ["vieux", "jeunes"], ["aveugles", "sourds", "handicapés"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["niñas", "niños"], ["musulmanes", "cristianos", "judíos", "hindúes", "budistas"], ["inmigrantes", "nativos"], ["homosexuales", "heterosexuales"], ["viejos", "jóvenes"], ["ciegos", "sordos", "discapacitados"],
]
#: Neutral mentions, put before short labelled texts so that there is something to swap; the label stays the text's own.
MENTIONS = [
    "the {} next door sold bread at the market", "two {} sat by the river and read", "a talk by {} in the library", "die {} von nebenan lasen am fluss", "am markt standen {} und redeten", "ein gespräch mit {} im garten",
    "les {} du quartier lisent dans le jardin", "au marché les {} parlent du temps", "une lettre des {} de la ville", "los {} del barrio leen en el parque", "en el mercado hablan {} del tiempo", "una carta de {} del pueblo",
]
#: Texts of each label that get such a sentence: the shortest ones.
MOST_MENTIONS = 300

LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[128:] = True
_K = np.uint32(0x01000193)


def _mix32(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    h = h ^ (h >> np.uint32(12))
    h = h * np.uint32(0x297A2D39)
    return (h ^ (h >> np.uint32(15))) & np.uint32((1 << BITS) - 1)


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of letters of lower-cased texts: the stream with one boundary before each text and at the end, begins, ends, and each word's text."""
    sizes = np.diff(starts)
    n = len(sizes)
    stream = np.full(len(data) + n + 1, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), sizes)
    letter = LETTER[data]
    stream[at[letter]] = data[letter]
    is_letter = stream != 32
    edge = np.diff(is_letter.astype(np.int8))
    begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    text = np.searchsorted(starts[1:-1] + np.arange(1, n), begin, "right") if n > 1 else np.zeros(len(begin), np.int64)
    return stream, begin, end, text


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of lower-cased texts, and the text of each."""
    data, starts = utf8_buffers(pc.utf8_lower(texts))
    letters, sizes, owners = [], [], []
    for lo, hi in chunks(starts, 1 << 20):
        stream, begin, end, text = words_of(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
        letters.append(stream[stream != 32])
        sizes.append((end - begin).astype(np.int32))
        owners.append((text + lo).astype(np.int32))
    size = np.concatenate(sizes)
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(letters))]), np.concatenate(owners)


def grams(stream: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, word) of the words' n-grams; a word is bounded by one blank on each side. The longest size also gives a feature of the whole word."""
    lengths = end - begin
    x = stream.astype(np.uint32)
    for n in SIZES:
        number = np.maximum(lengths + 2 - n + 1, 0)
        word = np.repeat(np.arange(len(begin)), number)
        first = np.repeat(begin - 1 - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(len(word)) if len(word) else np.zeros(0, np.int64)
        h = np.full(len(x), np.uint32(n * 0x9E37))
        for k in range(min(n, len(x))):
            h[: len(x) - k] = h[: len(x) - k] * _K + x[k:]
        yield _mix32(h[first]), word


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    history: list[float] = field(default_factory=list)

    def word_logits(self, stream, begin, end) -> np.ndarray:
        z = np.full(len(begin), self.bias)
        for f, w in grams(stream, begin, end):
            z += np.bincount(w, self.weights[f], len(begin))
        return z

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability that any word is toxic: 1 - exp(-sum of softplus(word logit)). Each distinct word is judged once."""
        tokens, text = _tokens(texts)
        coded = tokens.dictionary_encode()
        if not len(coded.dictionary):
            return np.zeros(len(texts))
        stream, begin, end, _ = words_of(*utf8_buffers(coded.dictionary))
        soft = np.logaddexp(0, self.word_logits(stream, begin, end))
        return -np.expm1(-np.bincount(text, soft[coded.indices.to_numpy()], len(texts)))


def with_mentions(texts: list[str], labels: list[int], most: int = MOST_MENTIONS) -> tuple[list[str], list[int]]:
    """The rows, and again the shortest `most` of each label with an identity term's neutral mention before them. Terms go round over both labels alike."""
    terms = [t for g in IDENTITY_GROUPS for t in g]
    more, label = [], []
    for y in (1, 0):
        rows = sorted((t for t, v in zip(texts, labels) if v == y and t), key=lambda t: (len(t), t))[:most]
        more += [f"{MENTIONS[k % len(MENTIONS)].format(terms[(k * 7 + k // len(terms)) % len(terms)])} {t}" for k, t in enumerate(rows)]
        label += [y] * len(rows)
    return [*texts, *more], [*labels, *label]


def train(texts: pa.Array | list[str], labels: list[int], rounds: int = ROUNDS, fairness: float = FAIRNESS, groups: list[list[str]] = IDENTITY_GROUPS) -> Model:
    """Adam on all rows at once, from fixed starts: the same rows give the same model. Without toxic or without clean rows the model gives 0 nearly everywhere.

    Loss: cross-entropy of the texts, plus `fairness` times the squared change of a text's score when its identity terms are swapped within their group."""
    w, bias = np.zeros(1 << BITS), START
    if not len(texts) or len(set(labels)) < 2:
        return Model(w.astype(np.float32), 2 * START)
    extra = " ".join(t for g in groups for t in g)
    n = len(texts)
    tokens, text = _tokens(pa.concat_arrays([pa.array(texts, pa.string()), pa.array([extra])]))
    coded = tokens.dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    m = len(words)
    real = text < n
    pair, count = np.unique(text[real].astype(np.int64) * m + ids[real], return_counts=True)
    doc, word = pair // m, pair % m
    data, starts = utf8_buffers(words)
    stream, begin, end, _ = words_of(data, starts)  # each word is a text of its own here
    features = [(f, o.astype(np.int32)) for f, o in grams(stream, begin, end)]
    names = {t.encode() for g in groups for t in g}
    at = {x: i for i, x in enumerate(words.to_pylist()) if x in names}
    partner = np.full(m, -1)
    for g in groups:
        for i, t in enumerate(g):
            partner[at[t.encode()]] = at[g[(i + 1) % len(g)].encode()]
    del tokens, coded, text, ids, real, pair, data, stream, begin, end
    hit = partner[word] >= 0
    s_doc, s_from, s_to, s_count = doc[hit], word[hit], partner[word[hit]], count[hit]
    y = np.array(labels, float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * n
    moment, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    history = []
    for step in range(1, rounds + 1):
        z = bias + sum(np.bincount(o, w[f], m) for f, o in features)
        soft, sig = np.logaddexp(0, z), 1 / (1 + np.exp(-z))
        t = np.bincount(doc, count * soft[word], n)
        t = np.maximum(t, 1e-9)
        g_t = weight * np.where(y == 1, -1 / np.expm1(np.minimum(t, 50)), 1.0) / n
        history.append(float((weight * np.where(y == 1, -np.log(-np.expm1(-t)), t)).mean()))
        g_word = np.zeros(m)
        if len(s_doc) and fairness:
            moved = np.maximum(t + np.bincount(s_doc, s_count * (soft[s_to] - soft[s_from]), n), 0)
            gap = np.exp(-moved) - np.exp(-t)  # score minus swapped score
            share = 2 * fairness * gap * weight / n
            g_t = g_t + share * (np.exp(-t) - np.exp(-moved))
            side = -share * np.exp(-moved)
            g_word += np.bincount(s_to, side[s_doc] * s_count, m) - np.bincount(s_from, side[s_doc] * s_count, m)
        g_word += np.bincount(word, count * g_t[doc], m)
        g_z = g_word * sig
        g = np.append(sum(np.bincount(f, g_z[o], len(w)) for f, o in features) + DECAY * w, g_z.sum())
        moment = 0.9 * moment + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        change = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
        w -= change[:-1]
        bias -= change[-1]
    return Model(w.astype(np.float32), float(bias), history)


def held_out() -> F.Column:
    """Whether a row is never trained on; a row without an id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> tuple[pa.Array, list[int]]:
    """A bounded sample of the labelled rows that are not held out, by the order of a hash of doc_id."""
    l = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out()).dropDuplicates(["doc_id"])
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = l.where("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(l.where("toxic <> 1").orderBy(*order).limit(most_clean))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    table = rows.toArrow().sort_by("doc_id")
    return table.column("text").combine_chunks(), [int(v == 1) for v in table.column("toxic").to_pylist()]


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, toxic, ...) -> (doc_id, held_out, score, predicted), a row for each row of docs.

    Rows whose crc32(doc_id as text) mod 4 is 2 are never trained on. Training takes at most 2,000 toxic and 3,000 other labelled rows to the driver, and
    up to 300 of each once more behind a sentence with an identity term, so that terms can be swapped in every one of the corpus's languages; scoring
    reads every whole text. Null and empty texts score 0. A null doc_id is not held out. Repeated rows, and rows of equal doc_id, are scored each; of a
    doc_id with several texts the least is trained on. Without labels of both kinds all score near 0; empty tables give an empty one; extra columns,
    whatever their names, are not read."""
    texts, y = training_rows(docs, labels)
    model = train(*with_mentions(texts.to_pylist(), y), **options)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.scores(part.column(1)))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
