"""Language identification with interpolated Kneser-Ney character models.

A text is scored word by word (lower case, letters only, a mark at either end), so a word's score is
worked out once a worker. Probabilities of n-grams and weights of contexts stand in sorted hash
arrays with a column for each language, searched by bisection. The language of lowest cross-entropy
per character is chosen; a text whose cross-entropy is far above what texts of that language have,
calibrated on labelled texts that the models have not seen, is rejected.

The models learn from a sample of about SAMPLE labelled documents a language, picked by a hash.

Null, empty and letterless texts are unknown, of score 0, and rejected. Texts are scored whole, whatever
their length; ties between languages go to the first by name. Repeated rows each get a row, and other
columns are kept. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, table, trim
from .syncmers import mixed
from .words import Memo, strings, word_codes

SAMPLE, ORDER, CALIBRATE_EVERY, STRICTNESS = 1000, 4, 5, 8.0
UNKNOWN = "und"
#: A text column of this name is read but not returned by predict().
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with a mark (1) before and after each, and each word's number of them."""
    text = "".join(f"\x01{w}\x01" for w in words)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.array([len(w) + 2 for w in words], np.int64)


def _grams(chars: np.ndarray, order: int) -> np.ndarray:
    """Hash of the order characters that end at each place (those before the start count as nothing)."""
    h = np.zeros(len(chars), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order - 1, -1, -1):
            h *= _STEP
            if k < len(chars):
                h[k:] += chars[: len(chars) - k] + np.uint64(7)
        return mixed(h + np.uint64(order))


class CharacterModels:
    """Kneser-Ney models of several languages; counts: language -> word -> how often it occurs."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER):
        self.languages, self.order = sorted(counts), order
        raw = [[self._count(counts[lang], n) for n in range(1, order + 1)] for lang in self.languages]
        alphabet = max([2, *(len(r[0][0]) for r in raw)])
        self.floor = 1.0 / (4 * alphabet)
        self.grams, self.contexts = [], []
        for n in range(1, order + 1):
            tables = []
            for r in raw:
                grams, context, count, inner = r[n - 1]
                if n < order:  # lower orders count the different characters before an n-gram
                    _, _, _, above = r[n]
                    found, many = np.unique(above, return_counts=True)
                    at = np.minimum(np.searchsorted(found, grams), max(len(found) - 1, 0))
                    count = np.where(found[at] == grams, many[at], 0) if len(found) else np.zeros(len(grams))
                    count = np.maximum(count, 1)  # those that only start words
                ones, twos = (count == 1).sum(), (count == 2).sum()
                discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
                ctx, where = np.unique(context, return_inverse=True)
                total, kinds = np.bincount(where, count), np.bincount(where)
                tables.append((grams, (count - discount) / total[where], ctx, discount * kinds / total))
            self.grams.append(self._joined([(t[0], t[1]) for t in tables], 0.0))
            self.contexts.append(self._joined([(t[2], t[3]) for t in tables], 1.0))
        self.typical = {lang: (0.0, 1.0, 1.0) for lang in self.languages}

    @staticmethod
    def _count(words: dict[str, int], n: int):
        """(n-grams, their contexts, counts, their last n - 1 characters) in order of n-gram hashes."""
        chars, sizes = _characters(list(words))
        times = np.repeat(np.fromiter(words.values(), np.float64, len(words)), sizes)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = np.flatnonzero((place >= max(n - 1, 1)))  # n characters of one word; its first mark is never predicted
        grams, first, inverse = np.unique(_grams(chars, n)[own], return_index=True, return_inverse=True)
        before = _grams(chars, n - 1)
        return grams, before[own - 1][first] if n > 1 else np.zeros(len(grams), np.uint64), np.bincount(inverse, times[own], minlength=len(grams)), before[own][first]

    @staticmethod
    def _joined(columns, missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in columns]))
        values = np.full((len(keys), len(columns)), missing, np.float32)
        for i, (k, v) in enumerate(columns):
            values[np.searchsorted(keys, k), i] = v
        return keys, values

    @staticmethod
    def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full((len(wanted), values.shape[1]), missing, np.float32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted)[:, None], values[at], np.float32(missing))

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(-log likelihood of each word in each language, its number of characters and end mark)."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int64)
        chars, sizes = _characters(words)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        p = np.full((len(chars), len(self.languages)), self.floor, np.float32)
        for n in range(1, self.order + 1):
            own = np.flatnonzero(place >= max(n - 1, 1))
            context = np.zeros(len(own), np.uint64) if n == 1 else _grams(chars, n - 1)[own - 1]
            weight = self._look_up(*self.contexts[n - 1], context, 1.0)
            p[own] = self._look_up(*self.grams[n - 1], _grams(chars, n)[own], 0.0) + weight * p[own]
        p[place == 0] = 1.0
        cost = np.add.reduceat(-np.log(np.maximum(p, 1e-12)), np.cumsum(sizes) - sizes)
        empty = sizes == 2
        cost[empty] = 0
        return cost, np.where(empty, 0, sizes - 1)

    def calibrate(self, cost: np.ndarray, length: np.ndarray, languages: list[str]) -> None:
        """Takes from labelled texts the middle and the spread of each language's cross-entropy: of the texts, and by length."""
        for k, lang in enumerate(self.languages):
            of = np.array([x == lang for x in languages], bool) & (length > 0)
            if of.any():
                entropy = cost[of, k] / length[of]
                middle = float(np.median(entropy))
                spread = np.abs(entropy - middle)
                self.typical[lang] = (middle, float(np.median(spread)) * 1.5 + 0.02, float(np.median(spread * np.sqrt(length[of]))) * 1.5 + 0.05)

    def decide(self, cost: np.ndarray, length: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text; texts without letters are unknown and rejected."""
        entropy = cost / np.maximum(length, 1)[:, None]
        best = entropy.argmin(1)
        odds = np.exp(-(entropy - entropy.min(1, keepdims=True)) * np.minimum(length, 40)[:, None])
        middle, wide, short = (np.array([self.typical[x][i] for x in self.languages])[best] for i in range(3))
        far = entropy[np.arange(len(best)), best] > middle + STRICTNESS * np.sqrt(wide**2 + short**2 / np.maximum(length, 1))
        none = length == 0
        return [UNKNOWN if n else self.languages[b] for b, n in zip(best, none)], np.where(none, 0.0, 1 / odds.sum(1)), far | none


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class TextScores:
    """Cost in each language and length of whole texts."""

    LETTER = r"\p{L}"

    def __init__(self, models: CharacterModels, most_words: int = 1_500_000):
        self.models, self.most_words = models, most_words
        self.reset()

    def reset(self) -> None:
        self.memo, self.cost, self.length = Memo(), [], []

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.memo.n > self.most_words:
            self.reset()
        words, codes, counts = word_codes(texts, lower=False)
        rows = self.memo.find(words)
        row = np.array(pc.fill_null(rows, 0), np.int64)
        if rows.null_count:
            new = pc.is_null(rows)
            fresh = words.filter(new)
            row[np.asarray(new)] = np.arange(self.memo.n, self.memo.n + len(fresh))
            self.memo.add(fresh)
            letters = strings(pc.replace_substring_regex(pc.utf8_lower(fresh), r"[^\p{L}]+", ""))
            done = [self.models.score(letters[at : at + 20_000]) for at in range(0, len(letters), 20_000)]
            self.cost = [np.concatenate([*self.cost, *(c for c, _ in done)])]
            self.length = [np.concatenate([*self.length, *(n for _, n in done)])]
        if not len(codes):
            return np.zeros((len(texts), len(self.models.languages))), np.zeros(len(texts), np.int64)
        at, doc = row[codes], np.repeat(np.arange(len(texts)), counts)
        cost = np.stack([np.bincount(doc, self.cost[0][at, k], len(texts)) for k in range(len(self.models.languages))], 1)
        return cost, np.bincount(doc, self.length[0][at], len(texts)).astype(np.int64)


def learn(docs: DataFrame, most: int = SAMPLE) -> CharacterModels | None:
    """Models from (doc_id, text, lang), the rows already limited to those that may be learned from.

    Takes about `most` documents a language, those whose hash is under the language's share (all where it
    has fewer); the driver gets one row a language, and the word counts of this sample. One in
    CALIBRATE_EVERY of them only calibrates rejection, by costs worked out on the executors. None without
    labelled texts. Repeated rows count as often as they stand; languages with null texts alone are not learned.
    """
    labelled = docs.where("lang is not null and text is not null").select("text", "lang", F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 40)).alias("h"))
    many = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not many:
        return None
    limits = F.create_map(*[F.lit(x) for lang, n in many.items() for x in (lang, int((1 << 40) * min(1.0, most / n)))])
    texts = labelled.where(F.col("h") < limits[F.col("lang")])
    held = F.col("h") % CALIBRATE_EVERY == 0
    words = texts.where(~held).select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).select("lang", F.regexp_replace("w", r"[^\p{L}]+", "").alias("w")).where("w <> ''").groupBy("lang", "w").count()
    counts: dict[str, dict[str, int]] = {}
    for lang, w, n in words.toArrow().select(["lang", "w", "count"]).to_pandas().itertuples(index=False):
        counts.setdefault(lang, {})[w] = n
    if not counts:
        return None
    models = CharacterModels(counts)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = TextScores(models)
        for batch in batches:
            for part in sliced(batch, "text"):
                cost, length = scores.of(part.column("text"))
                yield pa.record_batch([part.column("lang"), pa.array(list(cost), pa.list_(pa.float64())), pa.array(length, pa.int64())], ["lang", "cost", "length"])
        del scores
        trim()

    sample = texts.where(held).select("text", "lang").mapInArrow(costs, "lang string, cost array<double>, length long").toPandas()
    if len(sample):
        models.calibrate(np.stack(sample["cost"]), sample["length"].to_numpy(), sample["lang"].tolist())
    return models


def predict(docs: DataFrame, models: CharacterModels | None, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected"), keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score and rejected, read from its column text; names says what to call them.

    Columns of docs that have one of these names give way to them, as with withColumn; all others are kept, text itself
    unless keep_text is off. Null texts are unknown. An empty table gives no rows.
    """
    docs = docs.drop(*(c for c in names if c != text))
    kept = [f for f in docs.schema if f.name not in names and (keep_text or f.name != text)]
    if models is None:
        made = dict(zip(names, (F.lit(UNKNOWN), F.lit(0.0), F.lit(True))))
        return docs.select(*(F.col(f"`{f.name}`") for f in kept), *(v.alias(k) for k, v in made.items()))
    sent = docs.sparkSession.sparkContext.broadcast(models)
    columns = [f.name for f in kept]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = TextScores(sent.value)
        for batch in batches:
            for part in sliced(batch, text):
                lang, score, rejected = sent.value.decide(*scores.of(pc.fill_null(part.column(text), "")))
                yield pa.record_batch([*(part.column(c) for c in columns), pa.array(lang), pa.array(score), pa.array(rejected)], [*columns, *names])
        del scores
        trim()

    schema = T.StructType(kept + [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))])
    return docs.mapInArrow(choose, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the language of every text of documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    models = learn(docs.where(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, models, keep_text=False).select("doc_id", "held_out", "lang_pred", "score", "rejected")
