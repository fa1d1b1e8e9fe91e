"""Token ids of whole texts, by the tokenizers library, at the price of unseen words only.

A byte-level tokenizer never joins what lies on both sides of a lone space between two
non-space characters, and one that drops white space joins nothing across any; neither joins a
letter and the stop or comma after it.  So texts are cut there, each distinct unit is encoded once
by the library, and its ids are found again by the unit's 64-bit hash.  Texts to which that
reasoning does not apply (other white space beside a cut, special tokens) are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from plumbline.llm.shared import kept
from plumbline.llm.textbuf import Hasher, U, buffers, byte_codes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct units that a worker keeps before it starts anew; with their ids about 50 MB.
MEMO_UNITS = 1_000_000
LEARN_UNITS = 2048
_SPACE = np.isin(np.arange(256), [32, 10])
_OTHER_SPACE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_STOP = np.isin(np.arange(256), [44, 46])


def _style(spec: dict) -> str:
    """Which cut keeps the ids: "prefixed" (space belongs to the next word), "dropped" or "whole"."""
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "prefixed"
    if norm and norm["type"] == "Sequence" and pre.get("type") == "Sequence":
        norms, pres = [x["type"] for x in norm["normalizers"]], pre["pretokenizers"]
        if set(norms) <= {"NFC", "Replace", "Lowercase"} and pres[0]["type"] == "Split" and pres[0].get("behavior") == "Removed" and pres[0].get("invert") and r"[^\s\p{L}\p{N}]+" in pres[0]["pattern"].get("Regex", ""):
            return "dropped"
    return "whole"


class _Memo:
    """Unit hash -> its ids, in flat arrays: an open-addressing table that numpy probes for many
    hashes at once."""

    def __init__(self, units: int):
        self.bits = max(4, int(1.5 * units).bit_length())
        self.most = units
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, U)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.start = np.zeros(1024, np.uint32)
        self.n = np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint32)
        self.units = self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's unit number, or -1."""
        out = np.full(len(h), -1, np.int32)
        slot, left = (h >> U(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.at[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """Hashes that are not there yet, all different."""
        new = np.arange(self.units, self.units + len(h))
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(count.sum())
        while self.units + len(h) > len(self.start):
            self.start, self.n = np.resize(self.start, 2 * len(self.start)), np.resize(self.n, 2 * len(self.n))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.start[new], self.n[new] = self.used + np.cumsum(count) - count, count
        self.ids[self.used : self.used + total] = [x for one in ids for x in one]
        self.units += len(h)
        self.used += total
        slot, left = (h >> U(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = h[left[free]]
            self.at[slot[free]] = new[left[free]]
            on = self.keys[slot] != h[left]  # taken before, or by another of these
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Ids of texts, as the library's ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, units: int = MEMO_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.style = _style(spec)
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.codes = byte_codes(lower=self.style == "dropped")
        self.memo = _Memo(units)

    def _cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where units begin: texts, spaces, line ends and what follows these, lone stops after letters."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        space = _SPACE[data]
        cut[:n] = space
        cut[1:] |= data == 10
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        if n > 1:
            ends = np.append(space[1:], True) | edge[1:]
            letter = _LETTER[data]
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & ((data[1:] | 0x20) != 0xB7)
            cut[1:n] |= _STOP[data[1:]] & letter[:-1] & ends[1:] & ~edge[1:n]
        return np.flatnonzero((cut | edge)[:n])

    def _odd(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts that must be encoded whole: white space beside white space, or of other kinds."""
        n, odd = len(data), np.zeros(len(off) - 1, bool)
        if self.style == "prefixed" and n:
            space = _SPACE[data]
            wrong = _OTHER_SPACE[data]
            wrong[:-1] |= space[:-1] & space[1:]
            edges = np.unique(np.concatenate([off[:-1], off[1:] - 1]))
            edges = edges[(edges >= 0) & (edges < n)]
            wrong[edges] |= space[edges]
            odd[np.searchsorted(off, np.flatnonzero(wrong), "right") - 1] = True
        if self.special:
            raw = data.tobytes()
            for s in self.special:
                at = raw.find(s)
                while at >= 0:
                    odd[np.searchsorted(off, at, "right") - 1] = True
                    at = raw.find(s, at + 1)
        return odd

    def _learn(self, data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        for a in range(0, len(h), LEARN_UNITS):  # the library's results are large while they last
            part = slice(a, a + LEARN_UNITS)
            texts = [data[i:j].tobytes().decode() for i, j in zip(start[part].tolist(), end[part].tolist(), strict=True)]
            good = list(range(len(texts)))
            if self.style == "prefixed":  # other white space at a unit's edge would touch the cut
                good = [i for i, u in enumerate(texts) if u == "\n" or (w := u.removeprefix(" ")) and w == w.strip()]
            found = self.tokenizer.encode_batch_fast([texts[i] for i in good], add_special_tokens=False)
            self.memo.add(h[part][good], [e.ids for e in found])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and where each text's begin (one more entry: the end).
        Empty texts have none; nulls are not allowed."""
        data, off = buffers(texts)
        odd = np.ones(len(texts), bool) if self.style == "whole" else self._odd(data, off)
        start = self._cuts(data, off)
        end = np.append(start[1:], len(data))
        of = np.searchsorted(off, start, "right") - 1
        if odd.any():
            keep = ~odd[of]
            start, end, of = start[keep], end[keep], of[keep]
        h = Hasher(data, self.codes).spans(start, end) | U(1)
        if self.memo.units > self.memo.most // 2 and self.memo.units + len(h) // 4 > self.memo.most:
            self.memo.clear()
        unit = self.memo.find(h)
        if (unit < 0).any():
            unseen, first = np.unique(h[unit < 0], return_index=True)
            at = np.flatnonzero(unit < 0)[first]
            if len(at) > self.memo.most // 2:  # one text of hundreds of megabytes
                return self._whole(texts)
            self._learn(data, unseen, start[at], end[at])
            unit = self.memo.find(h)
            if (unit < 0).any():
                odd[of[unit < 0]] = True
                keep = ~odd[of]
                of, unit = of[keep], unit[keep]
        n = self.memo.n[unit].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.memo.ids[np.repeat(self.memo.start[unit].astype(np.int64) - (ends - n), n) + np.arange(total)]
        per_text = np.bincount(of, n, len(texts)).astype(np.int64)
        where = np.concatenate([[0], np.cumsum(per_text)])
        if odd.any():
            return self._with_whole(texts, odd, ids, where)
        return ids, where

    def _with_whole(self, texts: pa.Array, odd: np.ndarray, ids: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(odd)
        whole = dict(zip(at.tolist(), self.tokenizer.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False), strict=True))
        parts = [np.array(whole[i].ids, np.uint32) if i in whole else ids[where[i] : where[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._with_whole(texts, np.ones(len(texts), bool), np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64))


def encoder(path: str) -> Encoder:
    """This worker's encoder of that vocabulary file; later tasks of the worker that encode by it use
    it again, and slice texts with ``keep=path``."""
    return kept(path, lambda: Encoder(path))


def default_vocabulary(name: str) -> str:
    """The place of a public vocabulary file; operators take any other path as well."""
    import public_tokenizers

    return public_tokenizers.path(name)
