"""SentencePiece encoding and decoding by batched numpy Viterbi.

A batch's distinct words are sorted by length; words of like length advance together, one
character at a time, and leave when they end. Hashes of the substrings that end there probe
a table of the pieces' hashes, and vectorised maxima over the pieces' starts are stored as
back pointers.

Words are what no piece crosses. Characters are of one class if they are linked by pieces
that have them side by side; a word is a run of one class, with the space marks before it
if some piece has a mark before that class. So most punctuation, digits and rare characters
are words of their own, and there are fewer distinct words to encode and to remember.

For a unigram model the maximum is of the summed scores. A BPE model's result is not a
best sum, so there the maximum is taken over the pieces that byte-pair merging could put
next to the piece before: two pieces are compatible if no merge across their border would
come before the merges that built them. One segmentation of a word has only compatible
neighbours, and it is the one that merging yields. (Time runs backwards over the pieces
at the border: the later-built of the two is taken apart, and the pair that then meets is
looked up.) Compatible pairs are remembered for a task.

The model file is read on the driver and its tables travel with the function. Models with
a character map or user-defined symbols are refused.

Defined results: a null or empty text has no pieces and decodes to an empty text; unknown
characters become bytes if the model has them, else one unknown piece a run; very long
texts and words are taken whole; repeated rows are encoded separately; an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import chunks, give_back, light
from corpuslens.llm.token_count import NO_RANK, PairTable

MARK = "▁"
#: Bytes of text taken from a batch and encoded at once, words that a task remembers, and
#: characters that advance together.
CHUNK_BYTES = 1 << 20
CACHED = 300_000
BLOCK_CHARS = 1 << 16
SLOT_BITS = 19
#: Fixed values of the model file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LATE = 2**40


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """Pieces, scores and settings of a model file, and the tables that encoding needs."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            message = f.read()
        self.pieces, scores, kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(message):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(2) or USER_DEFINED in kinds or not normalizer.get(5, 1):
            raise ValueError("models with a character map, user-defined symbols or plain spaces are not supported")
        self.prefix, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.kinds = kinds
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int32) if trainer.get(35) else None
        self.scores = np.array(scores)
        usable = np.array([k == NORMAL and len(p) > 0 for k, p in zip(kinds, self.pieces, strict=True)])
        self.longest = max((len(p) for p, u in zip(self.pieces, usable, strict=True) if u), default=1)
        self.split_words = not any(MARK in p.lstrip(MARK) for p, u in zip(self.pieces, usable, strict=True) if u)
        self.word = re.compile(self._word_pattern([p for p, u in zip(self.pieces, usable, strict=True) if u]))
        self.unknown_score = min((s for s, u in zip(scores, usable, strict=True) if u), default=0.0) - 10
        if self.kind == BPE:
            usable = self._merges(usable)
        ids = np.flatnonzero(usable)
        keys = np.array([self._key(self.pieces[i]) for i in ids.tolist()], U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order].astype(np.int64)

    def unknown_alone(self) -> bool:
        """Whether unknown characters stand apart: as bytes, a run of them is not one piece."""
        return self.bytes is not None

    def _word_pattern(self, pieces: list[str]) -> str:
        """Words for models whose pieces have marks only at their beginning.

        Characters that are no piece by themselves count with the unknown ones, which stand
        apart or in runs.
        """
        bodies = [p.lstrip(MARK) for p in pieces]
        up = dict.fromkeys(chain.from_iterable(bodies))

        def top(c: str) -> str:
            while up[c] is not None:
                c = up[c]
            return c

        links = {pair for body in bodies for pair in pairwise(body)}
        strange = sorted(up.keys() - {p for p in pieces if len(p) == 1})
        for a, b in chain(sorted(links), pairwise(strange)):
            a, b = top(a), top(b)
            if a != b:
                up[a] = b
        classes: dict[str, list[str]] = {}
        for c in up:
            classes.setdefault(top(c), []).append(c)
        rest = classes.pop(top(strange[0]), []) if strange else []
        marked = {top(body[0]) for p, body in zip(pieces, bodies, strict=True) if body and p != body}
        joined = {top(a) for a, _ in links}
        kinds: dict[tuple[str, str], list[str]] = {}
        for name, chars in classes.items():
            own = name if name in joined else ""  # characters that nothing joins share a set
            kinds.setdefault((f"{MARK}*" if name in marked else "", own), []).extend(chars)
        parts = [f"{before}[{''.join(map(re.escape, sorted(chars)))}]{'+' if own else ''}" for (before, own), chars in kinds.items()]
        held = "".join(map(re.escape, sorted(chain.from_iterable(kinds.values()))))
        parts.append(f"[^{MARK}{held}]" if self.unknown_alone() and not rest else f"{MARK}*[^{MARK}{held}]+")
        return "|".join([*parts, f"{MARK}+"])

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) % 2**64
        return h

    def _merges(self, usable: np.ndarray) -> np.ndarray:
        """Pair table, births and last merges of the pieces; the pieces that merging can reach."""
        n = len(self.pieces)
        number = {p: i for i, p in enumerate(self.pieces) if usable[i]}
        self.birth = np.full(n + 1, -1, np.int64)  # entry n stands for an unknown character
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        by_rank = np.argsort(-self.scores, kind="stable")
        rank = np.empty(n, np.int64)
        rank[by_rank] = np.arange(n)
        pairs = [(number[p[:k]], number[p[k:]], i) for p, i in number.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        a, b, whole = (np.array(c, np.int64) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self.pair_rank = rank[whole]
        self.pairs = PairTable(a << 24 | b)
        reached = np.zeros(n + 1, bool)
        size = np.array([len(p) for p in self.pieces])
        reached[[i for i in number.values() if size[i] == 1]] = True
        for length in range(2, self.longest + 1):
            own = np.flatnonzero((size[whole] == length) & reached[a] & reached[b])
            own = own[self.compatible(a[own], b[own], inner=True)]
            own = own[np.argsort(-np.maximum(self.birth[a[own]], self.birth[b[own]]), kind="stable")]
            self.left[whole[own]], self.right[whole[own]] = a[own], b[own]
            self.birth[whole[own]] = rank[whole[own]]
            reached[whole[own]] = True
        return reached[:n]

    def compatible(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """Whether merging leaves the border between neighbours a and b alone.

        With ``inner`` the pair itself may merge: it is a piece's last merge.
        """
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        until_a, until_b = np.full(len(a), _LATE), np.full(len(a), _LATE)
        first = inner
        while live.size:
            at = self.pairs.find(a << 24 | b)
            rank = np.where(at != NO_RANK, self.pair_rank[np.where(at != NO_RANK, at, 0)] if len(self.pair_rank) else _LATE, _LATE)
            broken = (rank < until_a) & (rank <= until_b) & (rank < _LATE)
            if first:
                broken[:] = False
                first = False
            out[live[broken]] = False
            birth_a, birth_b = self.birth[a], self.birth[b]
            go = ~broken & ((birth_a >= 0) | (birth_b >= 0))
            live, a, b, birth_a, birth_b, until_a, until_b = (x[go] for x in (live, a, b, birth_a, birth_b, until_a, until_b))
            part_a = birth_a > birth_b
            until_a, until_b = np.where(part_a, birth_a, until_a), np.where(part_a, until_b, birth_b)
            a, b = np.where(part_a, self.right[a], a), np.where(part_a, b, self.left[b])
        return out

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix and text else text

    def words(self, text: str) -> list[str]:
        """Parts of a text that no piece crosses: no piece has a mark inside or a line break."""
        return self.word.findall(text) if self.split_words else [text] * bool(text)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word's pieces."""
        flat, starts, sizes = self.encode_flat(words)
        return [flat[i : i + n] for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)]

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, where each word's begin among them, and how many they are."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        shorter = -lengths[order]
        found, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(words):
            longest = -int(shorter[at])
            alike = int(np.searchsorted(shorter, -(longest // 2), "left"))  # these are more than half as long
            part = order[at : min(alike, at + max(1, BLOCK_CHARS // longest))]
            ids, sizes = self._viterbi([words[i] for i in part.tolist()], lengths[part])
            found.append(ids)
            counts.append(sizes)
            at += len(part)
        sizes = np.concatenate(counts)
        out = np.empty((2, len(words)), np.int64)
        out[:, order] = np.cumsum(sizes) - sizes, sizes
        return np.concatenate(found), out[0], out[1]

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1."""
        if not hasattr(self, "table"):
            self.table, self.held = PairTable(self.keys.view(np.int64)), np.append(self.ids, -1)
        at = self.table.find(hashes.ravel().view(np.int64))
        return self.held[np.minimum(at, len(self.ids))].reshape(hashes.shape)

    def _viterbi(self, words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many belong to each; the longest words come first."""
        n, size = len(words), int(lengths[0])
        word = np.repeat(np.arange(n), lengths)
        codes = np.zeros((size, n), np.uint32)
        codes[np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths), word] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        power = np.cumprod(np.concatenate((np.ones(1, U), np.full(min(size, self.longest), U(_BASE)))))
        score = np.append(self.scores, self.unknown_score) if self.kind == UNIGRAM else None
        hashes = np.zeros((size + 1, n), U)
        unknown = len(self.pieces)
        last = np.full((size + 1, n), -1, np.int32)
        last[0] = 0
        back = np.zeros((size + 1, n), np.int32)
        best = np.zeros((size + 1, n)) if self.kind == UNIGRAM else None
        live = np.searchsorted(-lengths, -np.arange(size + 1), "right").tolist()
        for end in range(1, size + 1):
            k, first = live[end], max(0, end - self.longest)
            hashes[end, :k] = hashes[end - 1, :k] * U(_BASE) + codes[end - 1, :k] + U(1)
            before = slice(end - 1, first - 1 if first else None, -1)  # starts, the last one first
            piece = self._probe(hashes[end, :k] - hashes[before, :k] * power[1 : end - first + 1, None])
            piece[0, piece[0] < 0] = unknown
            if self.kind == UNIGRAM:
                value = np.where(piece >= 0, best[before, :k] + score[np.maximum(piece, 0)], -np.inf)
                top, rows = value.argmax(axis=0), np.arange(k)
                best[end, :k], last[end, :k], back[end, :k] = value[top, rows], piece[top, rows], end - 1 - top
                continue
            step, row = np.nonzero((piece >= 0) & (last[before, :k] >= 0))
            piece, start = piece[step, row], end - 1 - step
            fits = start == 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self._fits(last[start[inner], row[inner]].astype(np.int64) << 24 | piece[inner])
            row = row[fits]
            last[end, row], back[end, row] = piece[fits], start[fits]  # of several the longest, which comes last
        cut = np.zeros((n, size + 1), bool)
        row, at = np.arange(n), lengths
        while row.size:
            cut[row, at] = True
            at = back[at, row]
            row, at = row[at > 0], at[at > 0]
        row, end = np.nonzero(cut)
        ids, sizes = last[end, row], np.bincount(row, minlength=n)
        strange = np.unique(row[ids == unknown]).tolist()
        if strange:
            borders = np.cumsum(sizes)[:-1]
            parts, ends = np.split(ids, borders), np.split(end, borders)
            for i in strange:
                parts[i] = self._with_unknown(words[i], parts[i], ends[i])
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, sizes

    def _with_unknown(self, word: str, pieces: np.ndarray, ends: np.ndarray) -> np.ndarray:
        ids: list[int] = []
        for p, e in zip(pieces.tolist(), ends.tolist(), strict=True):
            if p != len(self.pieces):
                ids.append(p)
            elif self.bytes is not None:
                ids += self.bytes[list(word[e - 1].encode())].tolist()
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, np.int32)

    def _fits(self, pairs: np.ndarray) -> np.ndarray:
        """Compatibility of packed pairs; a task remembers as many as it has slots."""
        if not hasattr(self, "slots"):
            self.slots, self.answers = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)
        at = ((pairs.astype(U) * U(_BASE)) >> U(64 - SLOT_BITS)).astype(np.int64)
        out = self.answers[at]
        missed = np.flatnonzero(self.slots[at] != pairs)
        if len(missed):
            new, place = np.unique(pairs[missed], return_inverse=True)
            fits = self.compatible(new >> 24, new & 0xFFFFFF)
            out[missed] = fits[place]
            at = at[missed[np.unique(place, return_index=True)[1]]]
            self.slots[at], self.answers[at] = new, fits
        return out

    def surfaces(self) -> list[bytes]:
        """What each id adds to a decoded text; bytes stand for themselves."""
        out = []
        for p, k in zip(self.pieces, self.kinds, strict=True):
            out.append(b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode())
        return out


class Numbers(dict):
    """The number of each word, given when it is first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Codec:
    """Encoding and decoding of batches, remembering words."""

    def __init__(self, model: Model) -> None:
        self.model, self.surface = model, model.surfaces()
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many belong to each text."""
        if len(self.known) > CACHED:
            self._forget()
        words = [self.model.words(self.model.normal(t)) for t in texts]
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64)
        fresh = [*islice(self.known, len(self.sizes), None)]
        if fresh:
            flat, starts, sizes = self.model.encode_flat(fresh)
            self.starts = np.concatenate((self.starts, len(self.flat) + starts))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, flat))
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[index] - (ends - sizes), sizes)] if total else np.zeros(0, np.int32)
        upto = np.concatenate(([0], ends))[np.cumsum([len(ws) for ws in words])] if len(words) else np.zeros(0, np.int64)
        return ids, np.diff(np.concatenate(([0], upto)))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): pieces of every text, and whether they decode to it."""
    model = Model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            column = batch.column("text")
            for i, j in chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), CHUNK_BYTES):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                ids, sizes = codec.encode(texts)
                ends = np.cumsum(sizes)
                same = [codec.decode(ids[e - n : e].tolist()) == t for t, e, n in zip(texts, ends.tolist(), sizes.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), lists, pa.array(sizes), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_ids", "round_trip"])
                give_back()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(light(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_ids long, round_trip boolean")


def decode(coded: DataFrame, path: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from lists of piece ids; ids outside the model are skipped."""
    model = Model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = [codec.decode([i for i in x or () if i is not None and 0 <= i < len(model.pieces)]) for x in lists]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = coded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(light(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
