"""Language identification of words, spans and documents.

Every word is scored per language by its character trigrams, whose counts are learned from labelled documents.
The script of a word (ranges of code points) leaves only languages that were learned with letters of that
script. A Viterbi pass over the words of a text, with a penalty for each change of language, labels spans of
mixed text; the language of most letters is that of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import in_batches

# Ranges of code points by script, from the blocks of the Unicode standard.
SCRIPTS = (
    ("latin", (0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    ("greek", (0x370, 0x3FF), (0x1F00, 0x1FFF)),
    ("cyrillic", (0x400, 0x52F),),
    ("armenian", (0x530, 0x58F),),
    ("hebrew", (0x590, 0x5FF),),
    ("arabic", (0x600, 0x6FF), (0x750, 0x77F)),
    ("devanagari", (0x900, 0x97F),),
    ("bengali", (0x980, 0x9FF),),
    ("tamil", (0xB80, 0xBFF),),
    ("telugu", (0xC00, 0xC7F),),
    ("thai", (0xE00, 0xE7F),),
    ("georgian", (0x10A0, 0x10FF),),
    ("hangul", (0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    ("kana", (0x3040, 0x30FF),),
    ("han", (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)),
)
#: Hashed trigrams; a model holds so many numbers for each language.
BUCKETS = 2**16
#: A language is learned with a script if at least this share of its letters is of it.
SCRIPT_SHARE = 0.01
#: Log likelihood that a change of language costs.
SWITCH = 8.0
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Code points handled at once.
CHUNK = 1_000_000


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point below 2^16: 0 for no letter, 1 for a letter of no listed script, else 2 + the script's number."""
    kinds = np.fromiter((chr(i).isalpha() for i in range(2**16)), np.uint8, 2**16)
    for k, (_, *ranges) in enumerate(SCRIPTS):
        for low, high in ranges:
            kinds[low : high + 1] *= k + 2
    return kinds


@dataclass
class Words:
    """The words of some texts: first trigram, trigrams, letters and scripts of each, and words by text."""

    grams: np.ndarray
    gram_word: np.ndarray
    letters: np.ndarray
    scripts: np.ndarray
    counts: np.ndarray


def read_words(texts: list[str]) -> Words:
    """Words are runs without white space of ASCII; trigrams are centred on letters of the lowered word."""
    joined, counts = [], []
    for text in texts:
        words = text.lower().encode("utf-8", "surrogatepass").split()
        counts.append(len(words))
        joined += words
    flat = (b" " + b" ".join(joined) + b" ").decode("utf-8", "surrogatepass")
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(points < 2**16, _kinds()[np.minimum(points, 2**16 - 1)], 1)
    space = points == 32
    number = np.cumsum(space) - 1
    at = np.flatnonzero(kind)
    p = points.astype(np.uint64)
    value = (p[at - 1] * np.uint64(0x1F1F1F1F3) + p[at]) * np.uint64(0x2545F4914F6CDD1D) + p[at + 1] * np.uint64(0x9E3779B97F4A7C15)
    grams = ((value * np.uint64(0xD1342543DE82EF95)) >> np.uint64(48)).astype(np.int64)
    word = number[at]
    total = len(joined)
    scripts = np.zeros(total, np.int64)
    np.bitwise_or.at(scripts, word, np.int64(1) << kind[at].astype(np.int64))
    return Words(grams, word, np.bincount(word, minlength=total), scripts, np.array(counts, np.int64))


@dataclass
class Model:
    """Languages, by falling number of learned letters; log probabilities by trigram; a bit mask of scripts each."""

    languages: list[str]
    table: np.ndarray
    scripts: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """One row a word, one column a language; languages of other scripts are ruled out."""
        n, langs = len(words.letters), len(self.languages)
        sums = np.zeros((n, langs))
        for k in range(langs):
            sums[:, k] = np.bincount(words.gram_word, self.table[words.grams, k], minlength=n)
        able = (words.scripts[:, None] & self.scripts[None, :]) != 0
        # A word without letters, or of a script that no language was learned with, rules none out.
        able |= ~able.any(axis=1, keepdims=True)
        return np.where(able, sums, -1e6)


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; all texts move on together, word by word."""
    labels = np.zeros(len(scores), np.int8)
    begins = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    begins, counts = begins[order], counts[order]
    steps = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(steps), side="left")  # texts with more than j words
    state = np.zeros((len(counts), scores.shape[1]))
    stayed: list[np.ndarray] = []
    best: list[np.ndarray] = []
    for j in range(steps):
        m = active[j]
        now = state[:m]
        top = now.argmax(axis=1)
        other = now[np.arange(m), top] - switch
        keep = now >= other[:, None]
        stayed.append(keep)
        best.append(top.astype(np.int8))
        state[:m] = np.where(keep, now, other[:, None]) + scores[begins[:m] + j]
    here = state.argmax(axis=1)
    for j in range(steps - 1, -1, -1):
        m = active[j]
        labels[begins[:m] + j] = here[:m]
        here[:m] = np.where(stayed[j][np.arange(m), here[:m]], here[:m], best[j])
    return labels


def learn(train: DataFrame) -> Model:
    """The model of all rows of (text, lang) where neither is null.

    Trigram counts are summed in the tasks first; what is collected is bounded by languages times BUCKETS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                texts = [batch.column(0)[int(i)].as_py() for i in np.flatnonzero(langs == lang)]
                seen = counts.setdefault(lang, np.zeros(BUCKETS + 64, np.int64))
                for part in _chunks(texts):
                    words = read_words(part)
                    seen[:BUCKETS] += np.bincount(words.grams, minlength=BUCKETS)
                    for k in range(len(SCRIPTS) + 2):
                        seen[BUCKETS + k] += words.letters[(words.scripts >> k) & 1 == 1].sum()
        for lang, seen in counts.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(seen[at])], ["lang", "bucket", "n"])

    rows = train.where("text is not null and lang is not null").select("text", "lang")
    sums = in_batches(rows, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang: dict[str, np.ndarray] = {}
    for lang, bucket, n in sums.collect():
        by_lang.setdefault(lang, np.zeros(BUCKETS + 64))[bucket] = n
    by_lang = {lang: seen for lang, seen in by_lang.items() if seen[:BUCKETS].sum() > 0}
    languages = sorted(by_lang, key=lambda lang: (-by_lang[lang][:BUCKETS].sum(), lang))
    table, scripts = np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages), np.int64)
    for k, lang in enumerate(languages):
        grams, letters = by_lang[lang][:BUCKETS], by_lang[lang][BUCKETS:]
        table[:, k] = np.log((grams + SMOOTHING) / (grams.sum() + SMOOTHING * BUCKETS))
        scripts[k] = sum(1 << s for s in range(len(SCRIPTS) + 2) if letters[s] >= SCRIPT_SHARE * letters.sum())
    return Model(languages, table, scripts)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in parts of about CHUNK characters."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > CHUNK:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def label(texts: list[str | None], model: Model, switch: float = SWITCH) -> list[tuple[str, float, list[dict]]]:
    """Language, score and spans of each text.

    The score is the share of letters in words labelled with the language. Spans are runs of words of one
    label: its language, the number of its first word and of its words. A text without letters, and any
    text if no language was learned, is undetermined, with a score of 0 and no spans.
    """
    out: list[tuple[str, float, list[dict]]] = []
    for part in _chunks([t or "" for t in texts]):
        if not model.languages:
            out += [(UNDETERMINED, 0.0, [])] * len(part)
            continue
        words = read_words(part)
        labels = viterbi(model.scores(words), words.counts, switch)
        ends = np.cumsum(words.counts)
        for text, begin, end in zip(part, ends - words.counts, ends):
            letters, own = words.letters[begin:end], labels[begin:end]
            weights = np.bincount(own, letters, len(model.languages))
            if not any(c.isalpha() for c in text) or weights.sum() == 0:
                out.append((UNDETERMINED, 0.0, []))
                continue
            best = int(weights.argmax())
            new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sizes = np.diff(np.r_[new, len(own)])
            spans = [
                {"lang": model.languages[own[a]], "first_word": int(a), "n_words": int(n)} for a, n in zip(new.tolist(), sizes.tolist())
            ]
            out.append((model.languages[best], float(weights[best] / weights.sum()), spans))
    return out


def held_out(doc_id: Column, divisor: int = 4, rest: int = 2) -> Column:
    """Whether a document is kept from learning; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % divisor == rest, F.lit(False))


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans per document, from whole texts alone. Repeated rows each have theirs."""
    span = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label(batch.column(1).to_pylist(), model, switch)
            lang, score, spans = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang: string, first_word: bigint, n_words: bigint>>"
    return in_batches(rows, run, schema)
