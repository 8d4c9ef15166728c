"""Operator 9, language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded by
its code point. A letter n-gram is bound by multiplying its letters' vectors,
each rotated by its place. A text is the sum of its n-gram vectors, a language
the sum over all its training texts, and a text has the language whose vector is
nearest by cosine.

Texts are lower-cased; what is no letter is one word break, itself a symbol, and
a text begins and ends with one. Whole texts are read, long ones in pieces that
add up to the same sums. Training reads every labelled row outside the fold;
each task sends one vector per language, and these are summed by Spark.

Defined results: null texts and texts without a letter are ``und`` with score 0,
as is every text if nothing was learned. Equal cosines give the first language
by code point. Repeated rows are judged alike. Other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import small_batches

UNKNOWN = "und"
DIMENSIONS = 512
GRAM = 3
SEED = 20
#: Characters of text encoded at once; bounds the memory of a task.
PIECE = 250_000
#: Up to so many possible values are counted in an array instead of sorted.
MAX_COUNTED = 1 << 22
#: Learned languages are sent to every task; more than this is an error.
MAX_LANGUAGES = 2_000
FOLDS = 5


def numbered(values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and for each value its place among them.

    Values below a moderate ``end`` are counted, which needs no sort of them all.
    """
    if end > MAX_COUNTED:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(end, bool)
    seen[values] = True
    distinct = np.flatnonzero(seen)
    place = np.zeros(end, np.int32)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[values]


class Encoder:
    """Texts to sums of n-gram vectors; one per worker."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.symbol = np.zeros(0x110000, np.int32)
        self.known = np.zeros(0x110000, bool)

    def symbols(self, text: str) -> np.ndarray:
        """Code points of letters, 0 for each run of anything else."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        fresh = np.unique(points[~self.known[points]])
        self.known[fresh] = True
        self.symbol[fresh] = [p if chr(p).isalpha() else 0 for p in fresh.tolist()]
        out = np.zeros(len(points) + 2, np.int32)
        out[1:-1] = self.symbol[points]
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
        return out[keep]

    def letter(self, symbol: int) -> np.ndarray:
        if symbol not in self.letters:
            random = np.random.Generator(np.random.PCG64([SEED, symbol]))
            self.letters[symbol] = (2 * random.integers(0, 2, DIMENSIONS) - 1).astype(np.float32)
        return self.letters[symbol]

    def grams(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Over some symbol runs: vectors of the n-grams that occur, and for each
        occurrence its run and its n-gram."""
        run = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        symbols = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        used, place = numbered(symbols, 0x110000)
        n = max(0, len(symbols) - GRAM + 1)
        code = np.zeros(n, np.int64)
        for k in range(GRAM):
            code = code * len(used) + place[k : k + n]
        inside = run[:n] == run[GRAM - 1 :]
        codes, gram = numbered(code[inside], len(used) ** GRAM)
        own = np.stack([self.letter(s) for s in used.tolist()]) if len(used) else np.zeros((0, DIMENSIONS), np.float32)
        vectors, rest = np.ones((len(codes), DIMENSIONS), np.float32), codes
        for k in range(GRAM):
            rest, last = np.divmod(rest, max(1, len(used)))
            vectors *= np.roll(own, k, axis=1)[last]
        return vectors, run[:n][inside], gram


def pieces(texts: Iterator[str | None], encoder: Encoder) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Symbol runs of texts, together up to PIECE long, with the texts' numbers.

    A longer text comes in several runs that share the symbols of one n-gram less
    one, so that every n-gram lies in one run.
    """
    owners, parts, held = [], [], 0
    for number, text in enumerate(texts):
        if not text:
            continue
        symbols = encoder.symbols(text)
        for start in range(0, max(1, len(symbols) - GRAM + 1), PIECE):
            part = symbols[start : start + PIECE + GRAM - 1]
            owners.append(number)
            parts.append(part)
            held += len(part)
            if held >= PIECE:
                yield owners, parts
                owners, parts, held = [], [], 0
    if parts:
        yield owners, parts


def bundles(texts: list[str | None], encoder: Encoder) -> np.ndarray:
    """One vector per text; zero where there is no letter."""
    out = np.zeros((len(texts), DIMENSIONS))
    for owners, parts in pieces(iter(texts), encoder):
        vectors, run, gram = encoder.grams(parts)
        counts = np.bincount(run * len(vectors) + gram, minlength=len(parts) * len(vectors))
        sums = counts.reshape(len(parts), len(vectors)).astype(np.float32) @ vectors
        np.add.at(out, owners, sums)
    return out


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    encoder, sums = Encoder(), {}
    for batch in batches:
        langs, texts = batch["lang"].to_numpy(), batch["text"]
        for owners, parts in pieces(iter(texts), encoder):
            vectors, run, gram = encoder.grams(parts)
            names, of = np.unique(langs[owners].astype(str), return_inverse=True)
            counts = np.bincount(of[run] * len(vectors) + gram, minlength=len(names) * len(vectors))
            for name, row in zip(names, counts.reshape(len(names), len(vectors)).astype(np.float64) @ vectors):
                sums[name] = sums.get(name, 0) + row
    if sums:
        yield pd.DataFrame({"lang": list(sums), "profile": [v.tolist() for v in sums.values()]})


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their vectors of length 1, from columns lang and text."""
    rows = small_batches(labelled).filter("lang is not null and text is not null").select("lang", "text")
    parts = rows.mapInPandas(_learn, "lang string, profile array<double>")
    sums = parts.select("lang", F.posexplode("profile")).groupBy("lang", "pos").agg(F.sum("col").alias("total"))
    profiles = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "total"))).alias("profile"))
    found = profiles.select("lang", "profile.total").orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in the training rows")
    langs = [r["lang"] for r in found]
    vectors = np.array([r["total"] for r in found]).reshape(len(found), DIMENSIONS)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    order = np.argsort(np.array(langs, object)) if langs else []
    return [langs[i] for i in order], (vectors / np.where(lengths > 0, lengths, 1))[order]


def held_out(id_: Column) -> Column:
    """Whether the crc32 of the id as text is a multiple of 5; a null id is empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and lang_pred and score, which replace columns of that name."""
    langs, profiles = model
    kept = small_batches(docs).select([f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")])
    named = kept.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("text"))

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder()
        for texts in batches:
            vectors = bundles(texts.tolist(), encoder)
            lengths = np.linalg.norm(vectors, axis=1)
            if not langs:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            else:
                cosines = vectors @ profiles.T / np.where(lengths > 0, lengths, 1)[:, None]
                best, score = cosines.argmax(1), np.clip(cosines.max(1), 0, 1)
            known = [bool(langs) and has_letter(t) for t in texts]
            yield pd.DataFrame({
                "lang_pred": [langs[b] if k else UNKNOWN for b, k in zip(best, known)],
                "score": np.where(known, score, 0.0),
            })

    judged = F.pandas_udf(judge, "lang_pred string, score double")
    return named.withColumn("found", judged("text")).select("row.*", "found.*")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn outside the held-out fold, predict every row: id, held_out, lang_pred, score."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
        held_out(F.col(id_col)).alias("held_out"),
    )
    model = learn(rows.filter(~F.col("held_out")))
    return predict(rows.drop("lang"), model).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
