"""Language identification: averaged hashed subword embeddings, a linear softmax, a calibrated rejection."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerline.llm.texts import ID, TEXT

BUCKETS = 1 << 13
GRAMS = (2, 3, 4)
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
BLOCK = 1 << 20

#: A-Z becomes a-z, other ASCII than letters becomes a space, bytes of other characters stay.
FOLD = bytes(
    b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket is hit by the subwords of the whole text: the byte 2-, 3- and 4-grams of its words.

    A word carries a space on either side; grams of nothing but spaces and grams over a word's border count
    nowhere.
    """
    octets = b" " + b" ".join(text.encode("utf-8", "replace").translate(FOLD).split()) + b" "
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(octets), BLOCK):
        part = np.frombuffer(octets[start : start + BLOCK + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        space = part == 32
        for n in GRAMS:
            size = min(BLOCK, len(part) - n + 1)
            if size <= 0:
                continue
            gram = np.full(size, n, np.uint32)
            crossed = np.zeros(size, bool)
            for i in range(n):
                gram = gram * np.uint32(0x01000193) + part[i : i + size]
                if 0 < i < n - 1:
                    crossed |= space[i : i + size]
            mixed = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            counts += np.bincount(mixed[~crossed], minlength=BUCKETS)
    return counts


@dataclass
class LanguageModel:
    """``scores``: a row of logits per bucket (embedding times linear layer), ``bias`` and ``temperature`` of the softmax."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    least_score: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        logits = (counts @ self.scores / max(1, counts.sum()) + self.bias) / self.temperature
        shifted = np.exp(logits - logits.max())
        return shifted / shifted.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); (``und``, 0) for null or a text without a letter."""
        if text is None or not LETTER.search(text):
            return UNDETERMINED, 0.0
        found = self.probabilities(subword_counts(text))
        best = int(found.argmax())
        return self.languages[best], float(found[best])


@dataclass
class Shares:
    """Bucket shares of texts, one row each; only the buckets that a text hits are held."""

    offsets: np.ndarray
    buckets: np.ndarray
    values: np.ndarray

    def __len__(self):
        return len(self.offsets) - 1

    def rows(self, numbers) -> np.ndarray:
        """Some of the rows, with all buckets."""
        dense = np.zeros((len(numbers), BUCKETS), np.float32)
        for at, number in enumerate(numbers):
            part = slice(self.offsets[number], self.offsets[number + 1])
            dense[at, self.buckets[part]] = self.values[part]
        return dense


def fit(shares: Shares, labels: np.ndarray, languages: list[str], size=16, epochs=10, rate=0.05, seed=7) -> LanguageModel:
    """Train embeddings and softmax by stochastic gradient descent (Adam steps) on two thirds of the rows.

    A minibatch of ``shares`` is dense, the rest stays sparse. The other third sets the softmax temperature
    with the least log loss (1 at least, so it never sharpens), and the least score accepted: the probability that all but 0.1 % of its
    rightly predicted rows reach, 0.5 at most.
    """
    random = np.random.default_rng(seed)
    count = len(languages)
    held = np.arange(len(shares)) % 3 == 2
    if not held.any() or count == 1:
        held = np.zeros(len(shares), bool)
    learned, target = np.flatnonzero(~held), np.eye(count, dtype=np.float32)
    weights = [
        random.normal(0, 0.1, (BUCKETS, size)).astype(np.float32),
        random.normal(0, 0.1, (size, count)).astype(np.float32),
        np.zeros(count, np.float32),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs if count > 1 else 0):
        order = random.permutation(learned)
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            embedding, linear, bias = weights
            given = shares.rows(rows)
            hidden = given @ embedding
            logits = hidden @ linear + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (chance / chance.sum(axis=1, keepdims=True) - target[labels[rows]]) / len(rows)
            step += 1
            for i, slope in enumerate((given.T @ (error @ linear.T), hidden.T @ error, error.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope * slope
                scaled = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                weights[i] = weights[i] - rate * scaled
    embedding, linear, bias = (w.astype(np.float64) for w in weights)
    scores = embedding @ linear
    temperature, least = 1.0, 0.5
    tried = np.flatnonzero(held)
    if len(tried):
        logits = np.concatenate([shares.rows(tried[at : at + 256]).astype(np.float64) @ scores for at in range(0, len(tried), 256)]) + bias
        chosen = np.arange(len(logits)), labels[held]

        def chances(t):
            raised = np.exp((logits - logits.max(axis=1, keepdims=True)) / t)
            return raised / raised.sum(axis=1, keepdims=True)

        steps = np.geomspace(1, 16, 49)
        temperature = float(min(steps, key=lambda t: -np.log(chances(t)[chosen] + 1e-12).mean()))
        final = chances(temperature)
        right = final.argmax(axis=1) == labels[held]
        if right.any():
            least = min(0.5, float(np.quantile(final.max(axis=1)[right], 0.001)))
    return LanguageModel(languages, scores, bias, temperature, least)


def held_out(doc_id):
    """Whether a document may not be learned from: crc32 of its id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, rows_a_language: int = 600, most_languages: int = 256) -> LanguageModel | None:
    """A model learned from text and lang of a bounded sample; None if there is no labelled text.

    Per language about ``rows_a_language`` documents are drawn by a hash of doc_id and text, of those that
    are not held out, have a lang and have a letter; rarer languages are taken whole. Beyond ``most_languages`` the
    most frequent are learned. What comes to the driver is the counts per language and, for each drawn
    document, the shares of the buckets that its whole text hits (BUCKETS at most, a few hundred for most): bounded by
    the two parameters, and held as sparse rows. Rows are ordered by id, lang and a digest of the text, so equal tables give
    equal models.
    """
    usable = F.col("lang").isNotNull() & F.col(TEXT).isNotNull() & F.col(ID).isNotNull() & ~held_out(F.col(ID))
    pool = docs.select(F.col(ID).cast("long").alias(ID), F.col(TEXT).cast("string").alias(TEXT), F.col("lang").cast("string").alias("lang")).where(usable)
    sizes = (
        pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    )
    if not sizes:
        return None
    chance = F.lit(None).cast("double")
    for row in sizes:
        chance = F.when(F.col("lang") == row["lang"], min(1.0, rows_a_language / row["n"])).otherwise(chance)
    draw = F.pmod(F.xxhash64(ID, TEXT), F.lit(1 << 30)) / (1 << 30)

    @pandas_udf("buckets array<int>, counts array<int>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        found = [subword_counts(t) if LETTER.search(t) else np.zeros(BUCKETS, np.int64) for t in texts]
        hit = [np.nonzero(c)[0].astype(np.int32) for c in found]
        return pd.DataFrame({"buckets": hit, "counts": [c[h].astype(np.int32) for c, h in zip(found, hit)]})

    digest = F.xxhash64(TEXT).alias("digest")
    drawn = pool.where(draw < chance).select(ID, "lang", digest, counted(TEXT).alias("c")).select(ID, "lang", "digest", "c.*")
    table = drawn.where(F.size("buckets") > 0).toArrow()
    count = table.num_rows
    if not count:
        return None
    table = table.sort_by([(ID, "ascending"), ("lang", "ascending"), ("digest", "ascending")])
    names = table["lang"].to_pylist()
    languages = sorted(set(names))
    order = np.random.default_rng(3).permutation(count)
    buckets, values = [], []
    for at in order.tolist():
        counts = table["counts"][at].values.to_numpy()
        buckets.append(table["buckets"][at].values.to_numpy())
        values.append((counts / counts.sum()).astype(np.float32))
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in buckets])])
    shares = Shares(offsets, np.concatenate(buckets), np.concatenate(values))
    return fit(shares, np.array([languages.index(names[at]) for at in order]), languages)


def identify(docs: DataFrame, model: LanguageModel | None = None, **bounds) -> DataFrame:
    """``docs``, every row and column, and lang_pred (string), score (double) and accepted (boolean).

    The whole text alone decides. Null text and text without a letter get ``und``, 0.0 and false; so does every
    text if there was nothing to learn from. ``accepted`` holds from the model's calibrated least score on. Without a
    ``model`` one is trained on ``docs`` (``bounds`` go to ``train``), which runs two jobs. Ties between languages go to
    the first by name. Columns of the three names are replaced.
    """
    model = model or train(docs, **bounds)
    if model is None:
        nothing = docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
        return nothing.withColumn("accepted", F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times the number of languages

    @pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    found = docs.withColumn("_llm_found", predicted(F.col(TEXT).cast("string")))
    return (
        found.withColumn("lang_pred", F.col("_llm_found.lang_pred"))
        .withColumn("score", F.col("_llm_found.score"))
        .withColumn("accepted", (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= model.least_score))
        .drop("_llm_found")
    )
