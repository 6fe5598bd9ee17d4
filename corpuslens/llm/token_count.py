"""Token counts of a byte-level BPE tokenizer, by rank-synchronous array merging.

A batch's distinct pre-tokens are one ragged numpy array of symbols. In each step every
pre-token's lowest-ranked pair is applied at all its places at once, until no pair is
left; the symbols that survive are counted. Counts of pre-tokens are remembered for the
length of a task, in a dictionary of bounded size.

The merge table is read on the driver and travels with the function (its size is that of
the vocabulary). Special strings of the tokenizer's file inside a text count as one token
and split it, which is the library's default.

Defined results: a null text counts as empty (0 tokens, 0 bytes); very long texts and
pre-tokens are taken whole; repeated rows are counted separately; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import chunks

#: Fixed value: the published pre-token pattern of this tokenizer family.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int32(2**31 - 1)
CACHED = 300_000
CHUNK_CHARS = 1 << 20


class PairTable:
    """Ranks of symbol pairs in a table of open slots, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        left, at = np.arange(len(keys)), self.slots(keys)
        while left.size:
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.ranks[at[first]] = keys[left[first]], left[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], NO_RANK)
        left = np.flatnonzero((held != keys) & (held != -1))
        at = at[left]
        while left.size:
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            same = held == keys[left]
            out[left[same]] = self.ranks[at[same]]
            go = ~same & (held != -1)
            left, at = left[go], at[go]
        return out


class Merges:
    """The merge rules of a tokenizer file: byte symbols, pair ranks, merged symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.byte = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.table = PairTable(np.array([vocab[a] << 24 | vocab[b] for a, b in pairs], np.int64))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = sorted((t["content"] for t in file.get("added_tokens", [])), key=len, reverse=True)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of each word."""
        out = np.zeros(len(words), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        ids, alive = self.byte[np.frombuffer(b"".join(words), np.uint8)], np.flatnonzero(sizes)
        sizes = sizes[alive]
        while alive.size:
            ends = np.cumsum(sizes)
            word = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.full(len(ids), NO_RANK, np.int32)
            if len(ids) > 1:
                rank[:-1] = self.table.find(ids[:-1] << 24 | ids[1:])
            rank[ends - 1] = NO_RANK
            best = np.minimum.reduceat(rank, ends - sizes)
            chosen = np.flatnonzero((rank == best[word]) & (rank != NO_RANK))
            # Where a pair overlaps itself (a a a), every other place counts, from the left.
            new = np.ones(len(chosen), bool)
            new[1:] = chosen[1:] != chosen[:-1] + 1
            start = np.maximum.accumulate(np.where(new, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - start) % 2 == 0]
            ids[chosen] = self.merged[rank[chosen]]
            keep = np.ones(len(ids), bool)
            keep[chosen + 1] = False
            sizes = sizes - np.bincount(word[chosen], minlength=len(sizes))
            over = (best == NO_RANK) | (sizes == 1)
            out[alive[over]] = sizes[over]
            keep &= ~over[word]
            ids, alive, sizes = ids[keep], alive[~over], sizes[~over]
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def token_counter(path: str):
    """A function from batches of texts to their numbers of tokens, for the file at ``path``."""
    merges = Merges(path)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        words = regex.compile(PRETOKEN)
        special = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
        known: dict[str, int] = {}
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            totals: list[int] = []
            for i, j in chunks([len(t) for t in texts], CHUNK_CHARS):
                found, extra = [], []
                for t in texts[i:j]:
                    marks = special.findall(t) if special else []
                    found.append([w for part in special.split(t) for w in words.findall(part)] if marks else words.findall(t))
                    extra.append(len(marks))
                if len(known) > CACHED:
                    known.clear()
                fresh = [*{w for ws in found for w in ws if w not in known}]
                known.update(zip(fresh, merges.count([w.encode() for w in fresh]).tolist(), strict=True))
                totals += [sum(map(known.__getitem__, ws)) + n for ws, n in zip(found, extra, strict=True)]
            yield pd.Series(totals, dtype="int64")

    return count


def count_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    whole: Column = F.coalesce(F.col(text), F.lit(""))
    counter = F.pandas_udf(token_counter(path), "long")
    out = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), counter(whole).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
