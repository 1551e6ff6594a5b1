"""Encoding of a corpus with a public byte-level BPE vocabulary.

Words are encoded together, not one by one: the symbols of all new words of a batch lie in one array, an index maps
each mergeable pair to all its positions there, ranks are applied in ascending order to all their positions at once,
and only the pairs beside a merge are looked up again. A merge can only make pairs of a higher rank, because a pair
that holds a merged symbol was learned after it, so the ascending pass equals merging word by word.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words kept in a worker's table before it is started afresh.
MAX_WORDS = 1_000_000

# The public splitting pattern, over letters, numbers, blanks and the rest. _SLOW states it with the blanks
# written out; _FAST is the same for texts without numbers that are no decimal digits and without control separators.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SLOW = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.json, which is installed beside the public tokenizers."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path("byte_bpe_50k.json"))
    except ImportError:
        return os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"


def _byte_letters() -> dict[str, int]:
    """The printable letter by which vocabulary files write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairTable:
    """Merge pairs of a vocabulary file: rank and result of each pair of symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(ids.values()) + 1
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in _byte_letters().items():
            self.of_byte[b] = ids[letter]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        k = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.order[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, end of each word in them)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        if not n:
            return np.zeros(0, np.int64), np.cumsum(sizes)
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        full = sizes > 0
        nxt = np.arange(1, n + 1)
        nxt[ends[full] - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[(ends - sizes)[full]] = -1
        index: dict[int, list] = {}
        active: list[int] = []

        def note(pos: np.ndarray) -> None:
            if not len(pos):
                return
            r = self.ranks(sym[pos], sym[nxt[pos]])
            pos, r = pos[r >= 0], r[r >= 0]
            o = np.argsort(r, kind="stable")
            pos, r = pos[o], r[o]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for rank, part in zip(r[np.r_[0, cuts]].tolist() if len(r) else [], np.split(pos, cuts)):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(active, rank)

        note(np.flatnonzero(nxt >= 0))
        while active:
            rank = heapq.heappop(active)
            parts = index.pop(rank)
            pos = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b, made = self.left[rank], self.right[rank], self.made[rank]
            pos = pos[(sym[pos] == a) & (nxt[pos] >= 0)]
            pos = np.unique(pos[sym[nxt[pos]] == b])
            if a == b and len(pos) > 1:
                # Of positions in a row every second one merges, from the left.
                keep, last = [], -1
                for p in pos.tolist():
                    if p != last:
                        keep.append(p)
                        last = nxt[p]
                pos = np.array(keep, np.int64)
            if not len(pos):
                continue
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = made
            sym[gone] = -1
            nxt[pos] = after
            nxt[gone] = -1
            held = after >= 0
            prv[after[held]] = pos[held]
            before = prv[pos]
            note(np.unique(np.concatenate([before[before >= 0], pos[held]])))
        alive = sym >= 0
        count = np.cumsum(alive)
        return sym[alive], np.where(ends > 0, count[np.maximum(ends, 1) - 1], 0)


class Encoder:
    """Texts to ids; words seen before are looked up."""

    def __init__(self, path: str):
        self.table = PairTable(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        if text.isascii() and not _CONTROL.search(text) or not _RARE.search(text):
            return _FAST.findall(text)
        import regex

        return regex.findall(_SLOW, text)

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, how many words each text has)."""
        words: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                w = self.words(t)
                sizes[i] = len(w)
                words += w
        if len(self.known) > MAX_WORDS:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            # Lone surrogates can't stand in Arrow text; replaced like everywhere in UTF-8.
            ids, ends = self.table.encode([w.encode("utf-8", "replace") for w in new])
            at = len(self.ids) + np.r_[0, ends[:-1]]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.starts = np.concatenate([self.starts, at])
            self.sizes = np.concatenate([self.sizes, np.diff(np.r_[0, ends])])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), sizes

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """How many ids each text has."""
        w, per = self.numbers(texts)
        return np.diff(np.r_[0, np.cumsum(self.sizes[w])][np.r_[0, np.cumsum(per)]])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        w, per = self.numbers(texts)
        n = self.sizes[w]
        total = np.r_[0, np.cumsum(n)]
        flat = np.repeat(self.starts[w] - total[:-1], n) + np.arange(total[-1])
        return self.ids[flat], total[np.r_[0, np.cumsum(per)]]


_CONTROL = re.compile("[\x1c-\x1f]")
_RARE = re.compile("[" + "".join(
    f"{chr(a)}-{chr(b)}" for a, b in (
        (0x1C, 0x1F), (0xB2, 0xB3), (0xB9, 0xB9), (0xBC, 0xBE), (0x9F4, 0x9F9), (0xB72, 0xB77), (0xBF0, 0xBF2), (0xC78, 0xC7E),
        (0xD58, 0xD5E), (0xD70, 0xD78), (0xF2A, 0xF33), (0x1369, 0x137C), (0x16EE, 0x16F0), (0x17F0, 0x17F9), (0x19DA, 0x19DA),
        (0x2070, 0x2079), (0x2080, 0x2089), (0x2150, 0x2189), (0x2460, 0x249B), (0x24EA, 0x24FF), (0x2776, 0x2793), (0x2CFD, 0x2CFD),
        (0x3007, 0x3007), (0x3021, 0x3029), (0x3038, 0x303A), (0x3192, 0x3195), (0x3220, 0x3229), (0x3248, 0x324F), (0x3251, 0x325F),
        (0x3280, 0x3289), (0x32B1, 0x32BF), (0x3400, 0x9FFF), (0xA6E6, 0xA6EF), (0xA830, 0xA835), (0xF900, 0xFAFF), (0x10000, 0x10FFFF),
    )) + "]")


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it outlives the task."""
    kept = sys.__dict__.setdefault("_scriptorium_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encoded(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens.

    A null and an empty text have the empty list. Strings that look like special tokens are ordinary text. Rows stay
    where they are: no shuffle, one pass, and texts are encoded whole, whatever their length. Duplicate rows and null
    ids are kept; other columns are not read.
    """
    path = path or default_vocabulary()

    def run(batches):
        e = encoder(path)
        for batch in batches:
            ids, offsets = e.encode(batch.column(1).to_pylist())
            if len(ids) >= 2**31:
                raise ValueError("a batch has too many ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id, "ids"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, text).mapInArrow(run, f"`{id}` {kind}, ids array<int>")


def token_counts(df: DataFrame, kept: dict[str, Column], text: str = "text", path: str | None = None) -> DataFrame:
    """The named columns of ``kept`` and ``tokens``, the number of ids of the text (0 where it is null or empty)."""
    path = path or default_vocabulary()
    rows = df.select(F.col(text).alias("__text"), *[c.alias(k) for k, c in kept.items()])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches):
        e = encoder(path)
        for batch in batches:
            n = e.counts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n)], [*batch.schema.names[1:], "tokens"])

    return rows.mapInArrow(run, schema + ", tokens long")
