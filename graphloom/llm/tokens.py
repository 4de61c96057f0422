"""Token ids by a public word-level BPE tokenizer, remembered by the text between white space.

The tokenizer drops white space and never joins text across it, so the ids of a text are those of its chunks in turn.
Texts that come many at a time are cut, and their short chunks told apart, looked up and, if they are words, merged in arrays.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

from .common import mix64, take_over

#: Chunks that a Python worker remembers, in two generations of this size.
MEMO = 500_000
#: Rows of the table of short chunks (a power of two, beyond the next number and a window), chunks and ids from which on it drops some.
TABLE_ROWS, TABLE_CHUNKS, TABLE_IDS = 1 << 21, 1 << 20, 1 << 23
#: Bytes of the longest short chunk (two 64-bit words); characters of texts that are read together, chunks looked up together.
SHORT, TOGETHER, WINDOW = 16, 1 << 20, 1 << 17
#: Single marks that end a chunk and are a token of their own after a letter.
MARKS = ".,;:!?"
#: Kinds of bytes: 0 the space, 1 the letters a-z, 2 the other signs of ASCII that are seen, 3 the rest.
KINDS = np.array([0 if b == 32 else 1 if 97 <= b < 123 else 2 if 32 < b < 127 and not chr(b).isalnum() else 3 for b in range(256)], np.uint8)
#: Words of letters below this code point, in lower case, are what the tokenizer's normaliser and splitter leave as they are.
PLAIN_BELOW = "\u0300"


def _byte_letters() -> dict[int, int]:
    """The letters that a byte-level tokenizer writes for bytes: printable ones stand for themselves, others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class _Memo(dict):
    """Ids by chunk. A missing chunk is looked for in the older generation, then taken apart or encoded."""

    def __init__(self, tokenizer, older: dict):
        super().__init__()
        self.tokenizer, self.tokens, self.older, self.letters = tokenizer, tokenizer.model.tokenize, older, _byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self.found(chunk)
        self[chunk] = found
        return found

    def found(self, chunk: str) -> bytes:
        if chunk.isalpha():
            if chunk.isascii():
                if chunk == chunk.lower():
                    return array("I", [t.id for t in self.tokens(chunk)]).tobytes()
            elif max(chunk) < PLAIN_BELOW and chunk == chunk.lower():
                return array("I", [t.id for t in self.tokens(chunk.encode().decode("latin-1").translate(self.letters))]).tobytes()
        elif chunk and chunk[-1] in MARKS and chunk[:-1].isalpha() and max(chunk) < PLAIN_BELOW and chunk == chunk.lower():
            return self[chunk[:-1]] + self[chunk[-1]]
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()


class ChunkEncoder:
    """Ids as little-endian unsigned 32-bit bytes, those of the library with its file as it is and add_special_tokens=False:
    the exact strings of special tokens in a text are their ids, whatever stands beside them."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word or not t.special for t in added.values()):
            raise ValueError("only special tokens that match their exact strings are covered")
        self.special = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        # Special strings are cut out of the raw text first; what lower-casing makes of the rest is never one of them.
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.tokenizer.encode_special_tokens = True
        self.half, self.memo, self.table = memo, _Memo(self.tokenizer, {}), None
        self.merges = None

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.parts is None:
            return self._plain(text)
        found = self.parts.split(text)
        return self._plain(text) if len(found) == 1 else b"".join(self.special[x] if i % 2 else self._plain(x) for i, x in enumerate(found))

    def _plain(self, text: str) -> bytes:
        ids = b"".join(map(self.memo.__getitem__, _lowered(text).split(" ")))
        self._rotate()
        return ids

    def _rotate(self) -> None:
        if len(self.memo) >= self.half:
            self.memo = _Memo(self.tokenizer, dict(self.memo))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """What `encode` gives for each text in turn, read some at a time."""
        if self.table is None:
            self.table, self.merges = _Table(), _Merges.of(self.tokenizer)
        held, size = [], 0
        for text in texts:
            text = text or ""
            if self.parts is not None and self.parts.search(text):
                yield from self._together(held)
                held, size = [], 0
                yield self.encode(text)
                continue
            if len(text) > TOGETHER or size > TOGETHER:
                yield from self._together(held)
                held, size = [], 0
            if len(text) > TOGETHER:
                yield self._long(_lowered(text))
                continue
            held.append(_lowered(text))
            size += len(text)
        yield from self._together(held)

    def _long(self, text: str) -> bytes:
        """Ids of a lower-cased text, read in slices that end at a space."""
        at, out = 0, []
        while at < len(text):
            end = text.find(" ", at + TOGETHER)
            end = len(text) if end < 0 else end
            out.append(self._looked_up([text[at:end]])[0].tobytes())
            at = end + 1
        return b"".join(out)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each of these lower-cased texts."""
        if texts:
            ids, ends = self._looked_up(texts)
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                yield ids[a:b].tobytes()

    def _looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each end. Short chunks are looked up in the table, the others in the memo."""
        parts = [t.encode() for t in texts]
        raw = b" ".join(parts) + b" " * (SHORT + 1)
        data = np.frombuffer(raw, np.uint8)
        # A chunk ends before a space, and where a letter a-z stands before a sign: no token of the splitter goes on there.
        kind = KINDS[data[: len(raw) - SHORT]]
        cut = (kind[:-1] == 1) & (kind[1:] == 2)
        begins, stops = kind != 0, kind == 0
        begins[1:] &= stops[:-1] | cut
        stops[1:] &= ~stops[:-1]
        stops[1:] |= cut
        starts = np.flatnonzero(begins)
        sizes = np.flatnonzero(stops)[int(stops[0]) :] - starts
        short = sizes <= SHORT
        if b"\0" in raw:
            short[np.searchsorted(starts, np.flatnonzero(data == 0), "right") - 1] = False
        out, counts = [], np.zeros(len(starts), np.int64)
        for lo in range(0, len(starts), WINDOW):
            a, n, s = (x[lo : lo + WINDOW] for x in (starts, sizes, short))
            out.append(self._window(raw, a, n, s, counts[lo : lo + WINDOW]))
            self._rotate()
        ends = np.cumsum([len(p) + 1 for p in parts])
        total = np.append(0, np.cumsum(counts))
        return np.concatenate(out) if out else np.zeros(0, np.uint32), total[np.searchsorted(starts, ends)]

    def _window(self, raw: bytes, starts: np.ndarray, sizes: np.ndarray, short: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of some chunks; their numbers are written to `counts`."""
        table = self.table
        table.make_room()
        begin = np.zeros(len(starts), np.int64)
        which = np.flatnonzero(short)
        rows, new, shown = table.rows_of(raw, starts[which], sizes[which])
        if len(new):
            at, n = starts[which[shown]], sizes[which[shown]]
            points = np.frombuffer(raw, np.uint8)[_spans(at, n)]
            plain = np.logical_and.reduceat(KINDS[points] == 1, np.cumsum(n) - n)
            if self.merges is None:
                plain[:] = False
            chunks = {i: raw[at[i] : at[i] + n[i]].decode() for i in np.flatnonzero(~plain).tolist()}
            if self.merges is not None:
                plain[[i for i, chunk in chunks.items() if _letters_as_they_are(chunk)]] = True
            if plain.any():
                table.learn(new[plain], *self.merges.ids(points[np.repeat(plain, n)], n[plain]))
            other = [self.memo.found(chunks[i]) for i in np.flatnonzero(~plain).tolist()]
            table.learn(new[~plain], np.frombuffer(b"".join(other), np.uint32), np.fromiter(map(len, other), np.int64, len(other)) // 4)
        begin[which], counts[which] = table.begin_and_count(rows)
        pool, long = table.ids, np.flatnonzero(~short)
        if len(long):
            found = [self.memo[raw[i : i + k].decode()] for i, k in zip(starts[long].tolist(), sizes[long].tolist())]
            n = np.fromiter(map(len, found), np.int64, len(found)) // 4
            begin[long], counts[long] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, np.frombuffer(b"".join(found), np.uint32)])
        return pool[_spans(begin, counts)]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one after another."""
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return at


def _letters_as_they_are(chunk: str) -> bool:
    """Whether the tokenizer's normaliser and splitter leave the chunk as one word of letters."""
    return chunk.isalpha() and (chunk.isascii() or max(chunk) < PLAIN_BELOW) and chunk == chunk.lower()


def _lowered(text: str) -> str:
    """The text with spaces for line ends, and in lower case where that is what the tokenizer makes of it; fewer chunks differ."""
    text = text.replace("\n", " ")
    return text.lower() if "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text) else text


class _Table:
    """Ids of short chunks by their bytes, in open addressing: a row is the chunk's bytes as two words, filled up with zeros (so
    no chunk may hold one), and where its ids begin and their number. Keys are the bytes themselves, so none are mistaken."""

    def __init__(self):
        self.keys, self.place = np.zeros((TABLE_ROWS, 2), np.uint64), np.zeros(TABLE_ROWS, np.uint64)
        self.claim, self.again, self.chunks = np.zeros(TABLE_ROWS, np.int32), np.zeros(TABLE_ROWS, bool), 0
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    @property
    def ids(self) -> np.ndarray:
        return self.pool[: self.used]

    def begin_and_count(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.place[rows]
        return (place >> np.uint64(16)).astype(np.int64), (place >> np.uint64(1) & np.uint64(0x7FFF)).astype(np.int64)

    def rows_of(self, raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each chunk's row; the rows that are new, and for each of these a chunk (its number) that it is for."""
        words = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
        bits = np.uint64(8) * sizes.astype(np.uint64)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        with np.errstate(over="ignore"):
            low = words[starts] & np.where(sizes >= 8, full, (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
            high = words[starts + 8] & np.where(sizes >= 16, full, (np.uint64(1) << np.where(sizes > 8, bits - np.uint64(64), np.uint64(0)) % np.uint64(64)) - np.uint64(1))
            row = (mix64(low + np.uint64(0x9E3779B97F4A7C15) * high) & np.uint64(TABLE_ROWS - 1)).astype(np.int64)
        open_, new = np.arange(len(row)), []
        while len(open_):
            r = row[open_]
            free = self.place[r] == 0
            if free.any():
                mine = open_[free]
                self.claim[r[free]] = mine
                first = mine[self.claim[r[free]] == mine]
                self.keys[row[first], 0], self.keys[row[first], 1], self.place[row[first]] = low[first], high[first], 1
                new.append(first)
            other = open_[(self.keys[r, 0] != low[open_]) | (self.keys[r, 1] != high[open_])]
            row[other] = (row[other] + 1) & (TABLE_ROWS - 1)
            open_ = other
        shown = np.concatenate(new) if new else np.zeros(0, np.int64)
        self.again[row] = True
        self.again[row[shown]] = False
        return row, row[shown], shown

    def learn(self, rows: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Write the ids of new rows, one after another, and their number in each."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.ids, np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(n) - n
        self.place[rows] = (begin << 16 | n << 1 | 1).astype(np.uint64)
        self.used, self.chunks = self.used + len(ids), self.chunks + len(rows)

    def make_room(self) -> None:
        """Called before chunks are looked up. A full table keeps the chunks that came again, at most half of what it may hold."""
        if self.chunks < TABLE_CHUNKS and self.used < TABLE_IDS:
            return
        kept = np.flatnonzero(self.again & (self.place != 0))[: TABLE_CHUNKS // 2]
        begin, n = self.begin_and_count(kept)
        kept = kept[np.cumsum(n) <= TABLE_IDS // 2]
        keys, begin, n, pool = self.keys[kept], begin[: len(kept)], n[: len(kept)], self.pool
        self.__init__()
        rows, new, shown = self.rows_of(keys.tobytes() + b"\0" * SHORT, np.arange(len(kept)) * SHORT, np.full(len(kept), SHORT))
        self.learn(new, pool[_spans(begin[shown], n[shown])], n[shown])


class _Merges:
    """The merges of a byte-level BPE, done in rounds for many words at once: in every word, all occurrences of its first pair
    from the left. That is the library's order where a merge comes after those that make its parts, which `of` checks."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = [chr(c) for _, c in sorted(_byte_letters().items())]
        self.inner, self.last = (np.array([vocab[c + x] for c in letters], np.int64) for x in ("", suffix))
        self.size, self.never = max(vocab.values()) + 1, len(merges)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.keys, self.ranks = np.full(1 << 4 + self.never.bit_length(), -1), np.full(1 << 4 + self.never.bit_length(), self.never)
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] < 0]
            self.keys[slot[free]], self.ranks[slot[free]] = keys[free], free
            open_ = open_[self.keys[slot[open_]] != keys[open_]]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)

    @classmethod
    def of(cls, tokenizer) -> _Merges | None:
        """Nothing, where the order of the merges or the kind of the model is another one."""
        model = json.loads(tokenizer.to_str())["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        suffix, vocab = model.get("end_of_word_suffix") or "", model.get("vocab", {})
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges")) or len(set(merges)) < len(merges):
            return None
        last = {a + b: k for k, (a, b) in enumerate(merges)}
        letters = [chr(c) + x for c in _byte_letters().values() for x in ("", suffix)]
        if any(last.get(x, -1) >= k for k, m in enumerate(merges) for x in m) or not merges or not vocab.keys() >= {*letters, *last, *(x for m in merges for x in m)}:
            return None
        return cls(vocab, merges, suffix)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key.view(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], self.never)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def ids(self, points: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, given by their bytes and the number of these in each (not 0), and the number of ids in each."""
        ends = np.cumsum(count)
        sym = self.inner[points]
        sym[ends - 1] = self.last[points[ends - 1]]
        rank = self._rank(sym, np.append(sym[1:], 0))
        rank[ends - 1] = self.never
        name, done = np.arange(len(count)), []
        while len(name):
            least = np.minimum.reduceat(rank, np.cumsum(count) - count)
            live = least < self.never
            if not live.all():
                mine = np.repeat(live, count)
                done.append((name[~live], sym[~mine], count[~live]))
                sym, rank, name, count, least = sym[mine], rank[mine], name[live], count[live], least[live]
                if not len(name):
                    break
            ends = np.cumsum(count)
            hit = np.flatnonzero(rank == np.repeat(least, count))
            # Of occurrences that overlap, every second one from the left.
            run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            of = np.searchsorted(ends, hit, "right")
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, rank = sym[keep], rank[keep]
            count = count - np.bincount(of, minlength=len(count))
            hit, ends = hit - np.arange(len(hit)), np.cumsum(count)
            rank[hit] = self.never
            changed = np.concatenate([hit[hit + 1 < ends[of]], hit[hit > (ends - count)[of]] - 1])
            rank[changed] = self._rank(sym[changed], sym[changed + 1])
        if not done:
            return np.zeros(0, np.int64), count
        name, sym, count = (np.concatenate(x) for x in zip(*done))
        back = np.argsort(name)
        return sym[_spans((np.cumsum(count) - count)[back], count[back])], count[back]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str, memo: int = MEMO) -> ChunkEncoder:
    """One encoder for each vocabulary file and Python worker, which remembers up to two generations of `memo` chunks."""
    take_over("tokens", _encoders.clear)
    if path not in _encoders or _encoders[path].half != memo:
        _encoders[path] = ChunkEncoder(path, memo)
    return _encoders[path]
