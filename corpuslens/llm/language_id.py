"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter n-gram
binds its letters' vectors, each permuted (rolled) by its place, into their product; a
document bundles the vectors of its n-grams by adding them; a language's prototype bundles
the unit vectors of its training documents. A document gets the language whose prototype
has the largest cosine. As bundling is linear, a batch of documents is one matrix product
of n-gram counts and n-gram vectors.

Prototypes are learned from a bounded sample of labelled documents (``SAMPLE_DOCS``, by
hash of the id) and summed in whole numbers, so reruns agree.

Letters are folded to lower case; runs of other characters count as one space; n-grams
stay within a word and its neighbouring spaces.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is
every text if there was nothing to learn from; ties go to the smaller language name; a
null id is never held out and never learned from; very long texts are taken whole, in
pieces whose n-gram counts are added; repeated rows are judged separately; an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import chunks, light

DIMENSIONS = 1024
N = 3
SAMPLE_DOCS = 20_000
CHUNK_CHARS = 1 << 19
#: N-grams that are multiplied at a time.
GRAMS = 4_096
#: Unit vectors are rounded to this part of one, so that sums do not depend on their order.
GRAIN = 1 << 20


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


class Encoder:
    """Document vectors of batches of texts."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.letter = np.array([chr(i).isalpha() for i in range(0x110000)])
        self.known: dict[int, np.ndarray] = {}

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of letters, a row each; 0 stands for the space."""
        for c in codes.tolist():
            if c not in self.known:
                self.known[c] = np.random.Generator(np.random.PCG64(1_000_003 + c)).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return np.stack([self.known[c] for c in codes.tolist()])

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams (rows of code points); and gram, document and count of every pair
        that occurs, by gram."""
        low = [f"\n{t.lower()}\n" for t in texts]
        codes = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in low])
        is_letter = self.letter[codes]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[0] = True
        keep[1:] |= doc[1:] != doc[:-1]
        code, doc = np.where(is_letter, codes, 0)[keep].astype(np.int64), doc[keep]
        if len(code) < N:
            return np.zeros((0, N), np.int64), *(np.zeros(0, np.int64) for _ in range(3))
        a, b, c = code[:-2], code[1:-1], code[2:]
        fit = (b != 0) & (doc[2:] == doc[:-2])
        names, flat = np.unique((a << 42 | b << 21 | c)[fit], return_inverse=True)
        grams = np.stack((names >> 42, names >> 21 & 0x1FFFFF, names & 0x1FFFFF), axis=1)
        pairs, count = np.unique(flat * len(texts) + doc[2:][fit], return_counts=True)
        return grams, pairs // len(texts), pairs % len(texts), count

    def vectors(self, texts: list[str]) -> np.ndarray:
        grams, gram, doc, count = self.counts(texts)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        if not len(grams):
            return out
        codes, place = np.unique(grams, return_inverse=True)
        place = place.reshape(grams.shape)
        rows = self.letters(codes)
        first, second = np.roll(rows, 2, axis=1), np.roll(rows, 1, axis=1)
        for i in range(0, len(grams), GRAMS):  # bounded memory: a table of texts x GRAMS
            p = place[i : i + GRAMS]
            bound = first[p[:, 0]] * second[p[:, 1]] * rows[p[:, 2]]
            here = slice(*np.searchsorted(gram, (i, i + len(p))))
            table = np.zeros((len(texts), len(p)), np.float32)
            table[doc[here], gram[here] - i] = count[here]
            out += table @ bound.astype(np.float32)
        return out

    def batches(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Vectors of ranges of rows; a text longer than a chunk is cut at spaces and added up."""
        texts = [t or "" for t in texts]
        for i, j in chunks([len(t) + 512 for t in texts], CHUNK_CHARS):
            if j - i == 1 and len(texts[i]) > 2 * CHUNK_CHARS:
                total = np.zeros((1, self.dimensions), np.float32)
                for part in pieces(texts[i], CHUNK_CHARS):
                    total += self.vectors([part])
                yield i, j, total
            else:
                yield i, j, self.vectors(texts[i:j])


def pieces(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters that end before a character that is no letter."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and text[end].isalpha() and end < at + 2 * size:
            end += 1
        yield text[at:end]
        at = end


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, sums = Encoder(), {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i, j, vectors in encoder.batches(batch.column("text").to_pylist()):
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = np.rint(vectors / np.maximum(norm, 1e-9) * GRAIN).astype(np.int64)
            for lang, v in zip(langs[i:j], unit, strict=True):
                sums[lang] = sums[lang] + v if lang in sums else v.copy()
    for lang, v in sums.items():
        yield pa.record_batch([pa.array([lang] * len(v)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["lang", "place", "part"])


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """Prototypes by language, from about ``sample_docs`` documents that are not held out."""
    key = F.col(doc_id)
    usable = docs.filter(key.isNotNull() & F.col(lang).isNotNull() & ~held_out(key))
    rows = usable.count()
    if rows > sample_docs:
        usable = usable.filter(F.pmod(F.xxhash64(key), F.lit(2**30)) < int(2**30 * sample_docs / rows))
    parts = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("text IS NOT NULL").mapInArrow(light(_learn), "lang string, place int, part long")
    rows = parts.groupBy("lang", "place").agg(F.sum("part").alias("part")).collect()  # languages of the sample x dimensions
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["place"]] = r["part"]
    return dict(sorted(out.items()))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, keep: tuple[str, ...] = (), text: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """(*keep, lang_pred, score) of every document."""
    names = [*prototypes]
    unit = np.stack([v / max(np.linalg.norm(v), 1e-9) for v in prototypes.values()]).astype(np.float32).T if names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            for i, j, vectors in encoder.batches(batch.column(len(keep)).to_pylist()):
                norm = np.linalg.norm(vectors, axis=1)
                if unit is None:
                    best, score = np.zeros(j - i, np.int64), np.zeros(j - i)
                    found = np.zeros(j - i, bool)
                else:
                    cosine = vectors @ unit / np.maximum(norm, 1e-9)[:, None]
                    best = cosine.argmax(axis=1)
                    score = np.clip(cosine.max(axis=1).astype(np.float64), 0, 1)
                    found = norm > 0
                langs = [names[k] if f else "und" for k, f in zip(best.tolist(), found.tolist(), strict=True)]
                kept = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                yield pa.record_batch([*kept, pa.array(langs, pa.string()), pa.array(np.where(found, score, 0.0))], names=[*keep, lang_as, score_as])

    rows = docs.select(*keep, F.col(text).alias("__text"))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]]
    return rows.mapInArrow(light(run), ", ".join([*types, f"`{lang_as}` string", f"`{score_as}` double"]))


def identify_language(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from the same table."""
    prototypes = learn(docs, doc_id=doc_id, text=text, lang=lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return identify(rows, prototypes, keep=("doc_id", "held_out"))
