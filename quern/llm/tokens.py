"""Tokenising whole texts with the tokenizers library, at the speed of a table of pieces.

Both vocabularies in use split their input before every space that stands before a character
other than white space, whatever stands around it; around a line end that stands alone; and
between a letter and a full stop or comma at a word's end. So the ids of a text are the ids of its
pieces between such places, one after another. Pieces recur, so each worker keeps a table of
pieces, by hashes of their bytes, with the ids that the library gave for them. Texts with other
white space, with several white spaces in a row, or with the string of an added token (which the
library, as the file has it, takes for that token) are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np

from .common import keeps, mix

#: Pieces that a worker keeps, and the places for them (a power of two).
MOST, PLACES = 700_000, 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


class Encoder:
    """Ids of texts by one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # A character that is one token between any two pieces: with it many pieces are one text.
        self.mark, self.mark_id = next((m.encode(), ids[0]) for m in ("\n", "7") if len(ids := self.tokenizer.encode(m, add_special_tokens=False).ids) == 1)
        self.between = self.mark if self.mark == b"\n" else b" " + self.mark + b" "
        self.power = self.inverse = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.n = self.used = 0
        self.hash, self.check = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint64)
        self.at, self.count = np.zeros(PLACES, np.int64), np.zeros(PLACES, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)

    def _keep(self, ids: np.ndarray) -> int:
        """Puts ids into the pool; returns where they are."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.uint32))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)] if texts else []

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pieces into the pool: where, and how many ids each."""
        at, count = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int32)
        joined = [k for k, x in enumerate(pieces) if self.mark not in x]
        for k in range(0, len(joined), 4096):
            some = joined[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join([pieces[x] for x in some]).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            if len(ends) != len(some):
                raise ValueError("a piece holds the token that stands between pieces")
            begins = np.append(0, ends[:-1] + 1)
            at[some], count[some] = self._keep(ids) + begins, ends - begins
        apart = [k for k, x in enumerate(pieces) if self.mark in x]
        for k, ids in zip(apart, self._ids([pieces[k] for k in apart]), strict=True):
            at[k], count[k] = self._keep(ids), len(ids)
        return at, count

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each piece in the table, -1: not there."""
        out = np.full(len(h), -1)
        todo, place = np.arange(len(h)), (h & np.uint64(PLACES - 1)).astype(np.int64)
        while len(todo):
            there = self.hash[place]
            same = (there == h[todo]) & (self.check[place] == check[todo])
            out[todo[same]] = place[same]
            on = ~same & (there != 0)
            todo, place = todo[on], (place[on] + 1) & (PLACES - 1)
        return out

    def _insert(self, h: np.ndarray, check: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        todo, place = np.arange(len(h)), (h & np.uint64(PLACES - 1)).astype(np.int64)
        while len(todo):
            empty = np.flatnonzero(self.hash[place] == 0)
            _, first = np.unique(place[empty], return_index=True)
            won = empty[first]
            p, k = place[won], todo[won]
            self.hash[p], self.check[p], self.at[p], self.count[p] = h[k], check[k], at[k], count[k]
            on = np.ones(len(todo), bool)
            on[won] = False
            todo, place = todo[on], (place[on] + 1) & (PLACES - 1)
        self.n += len(h)

    def encode(self, data: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (UTF-8 bytes and offsets), each with ``end`` behind it, and their n + 1 offsets."""
        base, docs = int(at[0]), len(at) - 1
        at = at - base
        n = int(at[-1])
        padded = np.zeros(n + 16, np.uint8)
        padded[8 : n + 8] = data[base : base + n]
        b = padded[8 : n + 8]
        doc_of_start = np.flatnonzero(np.diff(at))  # texts that are not empty
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        white = (b == 32) | (b == 10)
        # Texts that are encoded whole.
        bad = _ODD[b]
        bad[:-1] |= white[:-1] & white[1:]
        bad |= white & (edge[:-1] | edge[1:])
        if n > 1:
            bad[1:] |= (b[:-1] == 0xC2) & ((b[1:] == 0x85) | (b[1:] == 0xA0))
            bad[1:] |= (b[:-1] == 0xE1) & (b[1:] == 0x9A)
            bad[1:] |= (b[:-1] == 0xE3) & (b[1:] == 0x80)
        if n > 2:
            bad[2:] |= (b[:-2] == 0xE2) & ((b[1:-1] == 0x80) & ((b[2:] <= 0x8A) | (b[2:] == 0xA8) | (b[2:] == 0xA9) | (b[2:] == 0xAF)) | (b[1:-1] == 0x81) & (b[2:] == 0x9F))
        raw = b.tobytes()
        if self.added:
            lower = raw.lower()
            for token in self.added:
                k = lower.find(token)
                while k >= 0:
                    bad[k] = True
                    k = lower.find(token, k + 1)
        odd = np.zeros(docs, bool)
        odd[np.searchsorted(at, np.flatnonzero(bad), "right") - 1] = True
        start = edge[:-1] | white
        start[1:] |= b[:-1] == 10
        if n > 1:
            stop = ((b[1:] == 46) | (b[1:] == 44)) & _LETTER[b[:-1]] & ~edge[1:-1]
            stop &= edge[2:] | np.append(white[2:], False)
            start[1:] |= stop
        begins = np.flatnonzero(start)
        ends = np.append(begins[1:], n)
        doc = np.searchsorted(at[doc_of_start], begins, "right") - 1
        doc = doc_of_start[doc] if len(doc_of_start) else doc
        if odd.any():
            own = ~odd[doc]
            begins, ends, doc = begins[own], ends[own], doc[own]
        if len(self.power) <= n:
            with np.errstate(over="ignore"):
                grown = np.full(max(n + 1, 1 << 19), _R)
                grown[0] = 1
                self.power = np.cumprod(grown)
                grown[1:] = _R_INVERSE
                self.inverse = np.cumprod(grown)
        with np.errstate(over="ignore"):
            sums = np.append(np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.power[:n], dtype=np.uint64))
            size = (ends - begins).astype(np.uint64)
            h = mix((sums[ends] - sums[begins]) * self.inverse[begins] + size) | np.uint64(1)
            words = np.ndarray((n + 9,), np.uint64, padded, 0, (1,))  # eight bytes from each place, eight before the text
            first = words[begins + 8] & np.where(size >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (np.minimum(size, 7) * np.uint64(8))) - np.uint64(1))
            last = words[ends] & np.where(size >= 8, np.uint64(2**64 - 1), np.uint64(0))
            check = mix(first * _R + last) + size
        place = self._find(h, check)
        new = np.flatnonzero(place < 0)
        if len(new):
            _, k = np.unique(h[new], return_index=True)
            k = new[k]
            if self.n + len(k) > MOST and self.n:
                self._forget()  # what recurs comes back soon
                return self.encode(data, at + base, end)
            where, count = self._pieces([raw[x:y] for x, y in zip(begins[k].tolist(), ends[k].tolist(), strict=True)])
            self._insert(h[k], check[k], where, count)
            place[new] = self._find(h[new], check[new])
            if (place[new] < 0).any():
                raise ValueError("two pieces have one hash")
        used, kept_until = self.used, self.used
        where, count = self.at[place], self.count[place].astype(np.int64)
        extra = [self._keep(np.array([end], np.uint32))]
        rows = np.flatnonzero(odd)
        whole = self._ids([b[at[d] : at[d + 1]].tobytes() for d in rows])
        extra += [self._keep(ids) for ids in whole]
        used = self.used
        where = np.concatenate([where, np.array(extra[1:], np.int64), np.full(docs, extra[0])])
        count = np.concatenate([count, np.array([len(x) for x in whole], np.int64), np.ones(docs, np.int64)])
        doc = np.concatenate([doc, rows, np.arange(docs)])
        order = np.argsort(doc, kind="stable")  # each text's pieces, then its end
        where, count, doc = where[order], count[order], doc[order]
        after = np.cumsum(count)
        ids = self.pool[:used][np.repeat(where - after + count, count) + np.arange(int(after[-1]) if len(after) else 0)]
        self.used = kept_until
        per = np.bincount(doc, count, docs).astype(np.int64)
        return ids, np.append(0, np.cumsum(per))


_encoders: dict[str, Encoder] = {}
keeps("tokens", _encoders.clear)


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
