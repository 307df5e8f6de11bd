"""Language by cross-parsing: the language whose text explains a text in fewest phrases.

From a bounded sample of each language's text a suffix automaton is built, which knows
every string that occurs in the sample. A text is parsed greedily into longest matches;
the fewer phrases it needs, the lower its cross-entropy with the language. All texts of
a batch advance through all automata together, one character per numpy step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tillscope.llm.sampling import labelled_sample

UNDETERMINED = "und"
_ALPHABET = 0x110000


@dataclass(frozen=True)
class Settings:
    """Bounds of the model and of a parse."""

    characters: int = 24_000  # of each language's sample; an automaton has at most twice as many states
    texts: int = 200  # sampled texts of each language, before characters are counted
    longest_text: int = 20_000  # characters; longer ones are not learned from
    symbols: int = 120  # most frequent letters; others are one unknown symbol that matches nothing
    segment: int = 512  # characters of a text parsed on their own, side by side
    lanes: int = 1 << 13  # segments that advance together


@dataclass
class Model:
    languages: list[str]
    lookup: np.ndarray  # code point to symbol: 0 gap, 1 unknown letter, 2.. letters
    letter: np.ndarray  # code point to whether it is a letter
    tables: list[np.ndarray]  # states x symbols to next state, 0 where there is none
    cost: list[float]  # bits of a phrase: log2 of the sample's length
    settings: Settings


def suffix_automaton(symbols: list[int], n_symbols: int) -> np.ndarray:
    """Transitions of the smallest automaton of all substrings; state 0 is a dead end, 1 the start."""
    follow: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [-1, 0]
    last = 1
    for symbol in symbols:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(1)
        at = last
        while at and symbol not in follow[at]:
            follow[at][symbol] = new
            at = link[at]
        if at:
            target = follow[at][symbol]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(follow)
                follow.append(dict(follow[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                link[target] = link[new] = copy
                while at and follow[at].get(symbol) == target:
                    follow[at][symbol] = copy
                    at = link[at]
        last = new
    table = np.zeros((len(follow), n_symbols), np.uint16 if len(follow) < 1 << 16 else np.int32)
    for state, ways in enumerate(follow):
        for symbol, target in ways.items():
            table[state, symbol] = target
    return table


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(_ALPHABET)), bool, _ALPHABET)


def text_symbols(text: str, lookup: np.ndarray) -> np.ndarray:
    """Symbols of a whole text; what stands between letters is one gap."""
    found = lookup[_codes(text)]
    gap = found == 0
    return found[~(gap & np.concatenate([[True], gap[:-1]]))]


def train(samples: dict[str, list[str]], settings: Settings | None = None) -> Model:
    """Build an automaton per language from its texts, in the order given.

    Every language gets as many characters as the one with the fewest, so that a longer
    sample is no advantage, but at least a tenth of the bound where it has them.
    """
    settings = settings or Settings()
    letter = _letters()
    texts = {lang: " ".join(found)[: 2 * settings.characters] for lang, found in sorted(samples.items())}
    counts = np.zeros(_ALPHABET, np.int64)
    for text in texts.values():
        lower = _codes(text.lower())
        counts += np.bincount(lower, minlength=_ALPHABET)
    counts[~letter] = 0
    common = np.argsort(-counts, kind="stable")[: settings.symbols]
    common = common[counts[common] > 0]
    lookup = letter.astype(np.uint8)
    for symbol, code in enumerate(common.tolist(), 2):
        upper = chr(code).upper()
        lookup[[code, *([ord(upper)] if len(upper) == 1 else [])]] = symbol
    symbols = {lang: text_symbols(text, lookup) for lang, text in texts.items()}
    symbols = {lang: s for lang, s in symbols.items() if len(s)}
    fewest = min((len(s) for s in symbols.values()), default=0)
    share = min(settings.characters, max(fewest, settings.characters // 10))
    model = Model(list(symbols), lookup, letter, [], [], settings)
    for found in symbols.values():
        own = found[:share]
        model.tables.append(suffix_automaton(own.tolist(), len(common) + 2))
        model.tables[-1][:, 1] = 0  # an unknown letter is a phrase of its own
        model.cost.append(float(np.log2(len(own) + 1)))
    return model


def phrase_counts(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Phrases per text and language. Texts are parsed in segments of fixed length.

    A phrase is a longest match with the language's sample; it ends before the first
    symbol that does not continue it, which begins the next. A symbol that the sample
    lacks is a phrase. A segment's end ends a phrase, alike for all languages.
    """
    size, n_languages = model.settings.segment, len(model.languages)
    result = np.zeros((len(texts), n_languages))
    pieces = [(i, text[a : a + size]) for i, text in enumerate(texts) for a in range(0, len(text), size)]
    pieces.sort(key=lambda piece: -len(piece[1]))
    for begin in range(0, len(pieces), model.settings.lanes):
        part = pieces[begin : begin + model.settings.lanes]
        lengths = np.array([len(piece) for _, piece in part])
        grid = np.zeros((lengths[0], len(part)), np.int64)
        for lane, (_, piece) in enumerate(part):
            grid[: len(piece), lane] = piece
        owner = np.array([i for i, _ in part])
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        for k, table in enumerate(model.tables):
            width, flat = table.shape[1], table.reshape(-1)
            first = flat[width : 2 * width].astype(np.int64)  # from the start
            state = np.zeros(len(part), np.int64)
            phrases = np.zeros(len(part), np.int64)
            for step in range(lengths[0]):
                n = live[step]
                symbol = grid[step, :n]
                onward = flat[state[:n] * width + symbol].astype(np.int64)
                stop = onward == 0
                phrases[:n] += stop
                state[:n] = np.where(stop, first[symbol], onward)
            np.add.at(result[:, k], owner, phrases)
    return result


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score per text: the fewest bits per character win, ties by name.

    Phrases count log2 of the sample's length in bits. The score is the share of the
    second-best language's bits in those of the best two, 0.5 for a tie to 1; 1 with one
    language, 0 for und: a null text, a text without a letter, or nothing learned.
    """
    n_languages = len(model.languages)
    found = [text_symbols(t, model.lookup) if t else np.zeros(0, np.uint8) for t in texts]
    real = np.array([bool(t) and bool(model.letter[_codes(t)].any()) for t in texts], bool)
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not n_languages or not real.any():
        return names, scores
    bits = phrase_counts(found, model) * np.array(model.cost)
    order = np.argsort(bits, axis=1, kind="stable")
    for i in np.flatnonzero(real).tolist():
        best = order[i, 0]
        names[i] = model.languages[best]
        second = bits[i, order[i, 1]] if n_languages > 1 else 0.0
        both = bits[i, best] + second
        scores[i] = second / both if n_languages > 1 and both else 1.0
    return names, scores


def fit_languages(labelled: DataFrame, settings: Settings | None = None) -> Model:
    """Learn from a bounded, hash-chosen sample of ``labelled`` (doc_id, text, label)."""
    settings = settings or Settings()
    sample = labelled_sample(labelled, None, settings.texts, settings.longest_text)
    samples: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for row in sample.orderBy("label", "rank").toLocalIterator():
        if held.get(row["label"], 0) < 2 * settings.characters:
            samples.setdefault(row["label"], []).append(row["text"])
            held[row["label"]] = held.get(row["label"], 0) + len(row["text"])
    return train(samples, settings)


def identify_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, with lang_pred and score.

    Every whole text is parsed. Null texts, empty ones and those without a letter are
    und with score 0; equal texts get equal answers; an empty table gives an empty one;
    columns named lang_pred or score are replaced and others pass through. The model's
    size is bounded by its settings, about 5 MB per language, and is broadcast.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score", text)]
    source = docs.select(*(f"`{c}`" for c in (*others, text)))
    schema = StructType(
        [
            *source.drop(text).schema.fields,
            StructField("lang_pred", StringType()),
            StructField("score", DoubleType()),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            held = 0
            begin = 0
            names: list[str] = []
            scores: list[np.ndarray] = []
            for end in range(1, len(texts) + 1):
                held += len(texts[end - 1].as_py() or "")
                if held >= 1 << 22 or end == len(texts):
                    found, score = predict(texts.slice(begin, end - begin).to_pylist(), shared.value)
                    names += found
                    scores.append(score)
                    begin, held = end, 0
            score = np.concatenate(scores) if scores else np.zeros(0)
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(identify, schema)
