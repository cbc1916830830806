"""Language identification by a small convolutional network over bytes.

Windows of a fixed number of bytes go through an embedding, filters of several widths, a maximum
over positions and a softmax. The network is trained with numpy on the driver, on a bounded sample of labelled
windows; its weights are a few kilobytes. For prediction, embedding and filters fold into tables that give
the response of all filters to a pair of bytes, and all windows of a text are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.columns import back, own
from hitloom.llm.text import raw_bytes, slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8

# The sample bound: at most this many documents of each language teach the network, each with
# one excerpt of at most this many characters.
DOCUMENTS_PER_LANGUAGE = 800
EXCERPT_CHARS = 480

# The widest softmax; a corpus with more labels is refused.
MOST_LANGUAGES = 1000

UNKNOWN = "und"
_SEED = 7
_EPOCHS = 12
_BATCH = 64

# A-Z read as a-z, as case says nothing about the language.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, padded with zeros; how many each text has; their lengths in bytes."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // WINDOW))
    ends = np.cumsum(counts)
    flat = np.zeros(int(ends[-1]) * WINDOW if len(ends) else 0, dtype=np.uint8)
    folded = _FOLD[data]
    lengths = np.full(len(flat) // WINDOW, WINDOW)
    for i, size in enumerate(sizes):
        begin = (ends[i] - counts[i]) * WINDOW
        flat[begin : begin + size] = folded[offsets[i] : offsets[i + 1]]
        lengths[ends[i] - 1] = size - (counts[i] - 1) * WINDOW
    return flat.reshape(-1, WINDOW), counts, np.maximum(lengths, 1)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str]) -> Model:
    """Fit the network by Adam on byte windows and their label numbers."""
    rng = np.random.default_rng(_SEED)
    params = {"e": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)}
    params["e"][0] = 0
    for w in WIDTHS:
        params[f"w{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32)
        params[f"b{w}"] = np.zeros(FILTERS, dtype=np.float32)
    params["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
    params["ob"] = np.zeros(len(languages), dtype=np.float32)
    moment = {k: np.zeros_like(v) for k, v in params.items()}
    square = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for _ in range(_EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), _BATCH):
            rows = order[at : at + _BATCH]
            grads = _gradients(params, windows[rows], labels[rows])
            step += 1
            rate = 0.004 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                params[k] -= (rate * moment[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return Model(
        languages, params["e"], {w: params[f"w{w}"] for w in WIDTHS},
        {w: params[f"b{w}"] for w in WIDTHS}, params["o"], params["ob"],
    )


def _gradients(params: dict, windows: np.ndarray, labels: np.ndarray) -> dict:
    n = len(windows)
    embedded = params["e"][windows]
    hidden, places, patches = [], [], []
    positions = WINDOW - max(WIDTHS) + 1
    for w in WIDTHS:
        patch = np.concatenate([embedded[:, j : j + positions] for j in range(w)], axis=2)
        response = patch @ params[f"w{w}"] + params[f"b{w}"]
        best = response.argmax(axis=1)
        hidden.append(np.maximum(np.take_along_axis(response, best[:, None], 1)[:, 0], 0))
        places.append(best)
        patches.append(patch)
    h = np.concatenate(hidden, axis=1)
    logits = _log_softmax(h @ params["o"] + params["ob"])
    error = np.exp(logits)
    error[np.arange(n), labels] -= 1
    error /= n
    grads = {"o": h.T @ error, "ob": error.sum(0), "e": np.zeros_like(params["e"])}
    back = (error @ params["o"].T) * (h > 0)
    rows = np.arange(n)[:, None]
    for i, w in enumerate(WIDTHS):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        chosen = patches[i][rows, places[i]]
        grads[f"w{w}"] = np.einsum("nfd,nf->df", chosen, g)
        grads[f"b{w}"] = g.sum(0)
        to_patch = np.einsum("nf,df->nfd", g, params[f"w{w}"]).reshape(n, FILTERS, w, EMBEDDING)
        for j in range(w):
            np.add.at(grads["e"], windows[rows, places[i] + j], to_patch[:, :, j])
    grads["e"][0] = 0
    return grads


class Predictor:
    """The network folded into tables over byte pairs."""

    def __init__(self, model: Model):
        self.model = model
        parts = {
            w: [model.embedding @ model.filters[w][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            for w in WIDTHS
        }

        def pair(first, second):
            return (first[:, None, :] + second[None, :, :]).reshape(65536, FILTERS)

        none = np.zeros((256, FILTERS), dtype=np.float32)
        self.near = np.concatenate([pair(*parts[2]), pair(*parts[3][:2]), pair(*parts[4][:2])], axis=1)
        self.far = np.concatenate([pair(parts[3][2], none), pair(*parts[4][2:])], axis=1)
        self.bias = np.concatenate([model.biases[w] for w in WIDTHS])

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        positions = WINDOW - max(WIDTHS) + 1
        found = np.empty((len(windows), len(self.model.languages)), dtype=np.float32)
        for at in range(0, len(windows), 64):
            some = windows[at : at + 64]
            pairs = some[:, :-1].astype(np.int32) * 256 + some[:, 1:]
            response = self.near.take(pairs[:, :positions], axis=0, mode="clip")
            response[:, :, FILTERS:] += self.far.take(pairs[:, 2 : 2 + positions], axis=0, mode="clip")
            hidden = np.maximum(response.max(axis=1) + self.bias, 0)
            found[at : at + 64] = _log_softmax(hidden @ self.model.out + self.model.out_bias)
        return found

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text of a slice the number of its language and the score."""
        windows, counts, lengths = windows_of(*raw_bytes(column))
        weighed = self.log_probabilities(windows) * lengths[:, None]
        firsts = np.cumsum(counts) - counts
        mean = np.add.reduceat(weighed, firsts) / np.add.reduceat(lengths, firsts)[:, None]
        likely = np.exp(_log_softmax(mean))
        return likely.argmax(axis=1), likely.max(axis=1)


def sample(labelled: DataFrame, text_column: str, lang_column: str, key: Column) -> DataFrame:
    """At most ``DOCUMENTS_PER_LANGUAGE`` excerpts of each language, chosen by a hash of the row.

    Rows of a language with one key count once, so a group of copies takes one place. Rows are thinned by the counts
    of their language's keys before their excerpts are shuffled, so a language that owns most of the corpus sends no more than any other.
    """
    lang, text = F.col(f"`{lang_column}`"), F.col(f"`{text_column}`")
    usable = labelled.filter(lang.isNotNull() & text.rlike(r"\p{L}"))
    keys = usable.select(lang.alias("lang"), key.alias("_key")).distinct()
    counts = {row["lang"]: row["n"] for row in keys.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return usable.select(lang.alias("lang"), text.alias("excerpt")).limit(0)
    rate = {k: min(1.0, 3 * DOCUMENTS_PER_LANGUAGE / n) for k, n in counts.items()}
    keep = F.create_map(*[x for k, v in rate.items() for x in (F.lit(k), F.lit(v))])[lang]
    draw = F.pmod(F.col("_key"), F.lit(1 << 30)) / float(1 << 30)
    begin = 1 + F.pmod(F.col("_key"), F.greatest(F.char_length(text) - EXCERPT_CHARS + 1, F.lit(1)))
    thinned = usable.withColumn("_key", key).filter(draw < keep).select(
        lang.alias("lang"), F.substr(text, begin.cast("int"), F.lit(EXCERPT_CHARS)).alias("excerpt"), "_key"
    ).groupBy("lang", "_key").agg(F.min("excerpt").alias("excerpt"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_key", "excerpt"))
    return thinned.withColumn("_rank", rank).filter(F.col("_rank") <= DOCUMENTS_PER_LANGUAGE).select("lang", "excerpt")


def fit(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", key: Column | None = None) -> Model | None:
    """Train on labelled rows; None if there are no usable ones. ``key`` chooses the sample, and rows of a language
    with the same one count once; by default it is a hash of the text. Rows with a null label, or a text that is null or without a letter, teach nothing."""
    key = F.xxhash64(F.col(f"`{text_column}`")) if key is None else key
    rows = sample(labelled, text_column, lang_column, key).orderBy("lang", "excerpt").collect()
    if not rows:
        return None
    languages = sorted({row["lang"] for row in rows})
    excerpts = pa.array([row["excerpt"] for row in rows], pa.large_string())
    windows, counts, _ = windows_of(*raw_bytes(excerpts))
    labels = np.repeat([languages.index(row["lang"]) for row in rows], counts)
    return train(windows, labels, languages)


def identify(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score`` (0 to 1) to all rows, from whole texts.

    A null text, one without a letter, and every text if there is no model, is ``und`` with score 0.
    Equal texts get equal answers; a tie goes to the first language by name. Columns that already
    have these names are replaced; an empty table gives none.
    """
    held: dict[str, Predictor] = {}

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if model is not None and "predictor" not in held:
            held["predictor"] = Predictor(model)
        for column in batches:
            names: list = []
            scores: list = []
            for part in slices(column):
                if model is None:
                    names += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    continue
                which, score = held["predictor"](part)
                letters = pc.match_substring_regex(part, r"\p{L}").to_numpy(zero_copy_only=False)
                names += [model.languages[i] if ok else UNKNOWN for i, ok in zip(which, letters)]
                scores += np.where(letters, score, 0.0).astype(float).tolist()
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"]
            )

    names = ("lang_pred", "score")
    found = docs.select(*own(docs, names), predict(F.col(f"`{text_column}`")).alias("_found"))
    return found.select(*back(docs, names), "_found.lang_pred", "_found.score")
