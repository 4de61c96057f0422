"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Words (text between the marks for spaces) that are new to a worker become flat arrays of symbols. Each round finds
the smallest rank of all neighbouring pairs of each segment of a word (a segmented minimum), merges its occurrences from the
left in all segments at once, and compacts the arrays; segments without a pair leave. Results are remembered by word.
Texts are cut, words are told apart and looked up, and ids are written and decoded in arrays too, a window of words at a time.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, mix64, take_over

#: Words that a Python worker remembers, and their characters; characters that are merged at once (a segment is never divided).
MEMO, MEMO_CHARACTERS, AT_ONCE = 120_000, 1 << 23, 1 << 20
#: Characters of a word that is cut into segments if it has more; bits of the pairs' hash table.
CUT_FROM, SLOT_BITS = 64, 20
#: Characters of texts that are read together, and of the words that are handled at once (a word is never divided).
TOGETHER, WINDOW = 1 << 21, 1 << 19
SPACE = "▁"
#: The order of a pair that does not merge; a key that no pair has.
NEVER, NO_PAIR = 1 << 62, -(1 << 63)
#: The odd base of the words' keys, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN_KIND, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one after another."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - ends + sizes, sizes)
    at += np.arange(len(at))
    return at


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _fields(data: bytes):
    """(field, value) of a protocol buffer message: integers, or bytes."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Vocabulary, scores and the pairs that merge, read from a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.kinds, scores, norm, train = [], [], [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                train = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        plain = norm.get(2, b"") == b"" and norm.get(4, 1) == 0 and norm.get(5, 1) == 1
        if not plain or train.get(3, 1) != 2 or {USER_DEFINED, UNUSED} & set(self.kinds) or BYTE not in self.kinds:
            raise ValueError("only BPE models with byte pieces, without normalisation, user-defined and unused pieces are covered")
        self.prefix = bool(norm.get(3, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.byte_ids = [0] * 256
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.byte_of = np.array(self.byte_ids, np.int32)
        plain_piece = {BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN_KIND: lambda p: " ⁇ ".encode(), CONTROL: lambda p: b""}
        self.raw_pieces = [plain_piece.get(k, lambda p: p.replace(SPACE, " ").encode())(p) for p, k in zip(self.pieces, self.kinds)]
        # Of each id: its decimal digits and a space, in 8 bytes, and where its raw bytes lie among all.
        decimal = [f"{i} ".encode() for i in range(len(self.pieces))]
        self.digits = np.frombuffer(b"".join(d.ljust(8, b"\0") for d in decimal), np.uint64)
        self.digit_sizes = np.array([len(d) for d in decimal])
        self.raw_bytes, self.raw_sizes = np.frombuffer(b"".join(self.raw_pieces), np.uint8), np.array([len(r) for r in self.raw_pieces])
        self.raw_at = np.cumsum(self.raw_sizes) - self.raw_sizes
        # Symbols: pieces, and characters that occur in pieces only.
        self.symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, len(self.pieces) + len(self.symbols))
        # A character that no piece has is a symbol below zero.
        self.of_point = -1 - np.arange(0x110000, dtype=np.int32)
        self.point_of = np.zeros(len(self.pieces) + len(self.symbols), np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.of_point[ord(c)], self.point_of[i] = i, ord(c)
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        merges = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if p[:k] in self.symbols and p[k:] in self.symbols:
                    merges[self.symbols[p[:k]] << 20 | self.symbols[p[k:]]] = (order[scores[i]], i)
        self._hash_pairs(merges)
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for p in self.ids for a, b in zip(p, p[1:])} or {-1}), np.int64)
        # Words may be cut before a space mark where no piece has one after another character, and around what no piece has.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.loose = not any("\n" in p for p in self.ids)

    def _hash_pairs(self, merges: dict[int, tuple[int, int]]) -> None:
        """Pairs by a multiplicative hash in one table; those whose slot is taken go to a sorted list, and the slot says so."""
        keys = np.array(sorted(merges), np.int64)
        rank, to = (np.array([merges[k][i] for k in keys.tolist()], np.int64) for i in range(2))
        value = rank << 32 | to
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.slots = np.tile(np.array([[NO_PAIR, NEVER]], np.int64), (1 << SLOT_BITS, 1))
        self.slots[slot[first], 0], self.slots[slot[first], 1] = keys[first], value[first]
        late = np.ones(len(keys), bool)
        late[first] = False
        self.shared = np.zeros(1 << SLOT_BITS, bool)
        self.shared[slot[late]] = True
        self.late_keys, self.late_value = np.append(keys[late], 1 << 62), np.append(value[late], NEVER)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def word_starts(self, points: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where words begin in texts that begin at these places and have marks for spaces: at each text, and, where words may
        be cut, at the first of several marks and around line ends."""
        if not self.cuts:
            return texts
        mark = points == ord(SPACE)
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        if self.loose:
            line = points == 10
            begins[1:] |= line[1:] != line[:-1]
        begins[texts] = True
        return np.flatnonzero(begins)

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and what the pair becomes (the lower 32 bits), of neighbouring symbols."""
        key = left.astype(np.int64) << 20 | right
        slot = self._slot(key)
        row = self.slots.take(slot, 0)
        known = row[:, 0] == key
        out = np.where(known, row[:, 1], NEVER)
        other = np.flatnonzero(self.shared[slot] & ~known)
        if len(other):
            at = np.searchsorted(self.late_keys, key[other])
            out[other] = np.where(self.late_keys[at] == key[other], self.late_value[at], NEVER)
        return out

    def _out(self, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols and their number in each segment: characters that are no pieces become their UTF-8 bytes."""
        other = (symbols < 0) | (symbols >= len(self.pieces))
        if not other.any():
            return symbols, count
        c = symbols[other]
        c = np.where(c < 0, -1 - c, self.point_of[np.maximum(c, 0)])
        size = np.ones(len(symbols), np.int64)
        size[other] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        at = np.cumsum(size) - size
        out = np.repeat(symbols, size)
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            own = size[other] == n
            for k in range(n):
                byte = c[own] >> 6 * (n - 1 - k)
                out[at[other][own] + k] = self.byte_of[byte | lead if not k else byte & 63 | 0x80]
        return out, np.add.reduceat(size, np.cumsum(count) - count)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        begins = self.word_starts(_points(text), np.zeros(1, np.int64)).tolist()
        return [text[a:b] for a, b in zip(begins, [*begins[1:], len(text)])]

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        ids, count = self.merge_points(_points("".join(words)), np.fromiter(map(len, words), np.int64, len(words)))
        return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] if len(words) else []

    def merge_points(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, given by their characters, and their number in each. Two neighbouring characters that no piece has
        side by side never come together, so long words are cut there first; the segments are merged together, a bounded number
        of characters at a time."""
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        starts, ends = np.zeros(len(points), bool), np.cumsum(lengths)
        starts[(ends - lengths)[lengths > 0]] = True
        for i in np.flatnonzero(lengths > CUT_FROM):
            for lo in range(int(ends[i] - lengths[i]), int(ends[i]) - 1, AT_ONCE):
                code = points[lo : min(lo + AT_ONCE + 1, int(ends[i]))].astype(np.int64)
                code = code[:-1] << 21 | code[1:]
                at = np.minimum(np.searchsorted(self.beside, code), len(self.beside) - 1)
                starts[lo + 1 : lo + 1 + len(code)] = self.beside[at] != code
        begins = np.flatnonzero(starts)
        owner = np.searchsorted(ends, begins, "right")
        sizes = np.diff(np.append(begins, len(points)))
        last = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // AT_ONCE)) + 1
        found = [self._merged(points[begins[a] : begins[b - 1] + sizes[b - 1]], sizes[a:b]) for a, b in zip([0, *last.tolist()], [*last.tolist(), len(begins)])]
        of_word = np.bincount(owner, np.concatenate([n for _, n in found]), len(lengths)).astype(np.int64)
        return np.concatenate([ids for ids, _ in found]), of_word

    def _merged(self, points: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments and their number in each. A round merges, in every segment, all occurrences of its least rank from
        the left; where one of them would make a pair of the same or a lesser rank, which comes before the others, the leftmost
        alone."""
        sym = self.of_point[points]
        name, done = np.arange(len(count)), []
        # Of each symbol: its id, and the pair it makes with the next one of its segment.
        order = self._looked_up(sym, np.append(sym[1:], np.int32(-1)))
        order[np.cumsum(count) - 1] = NEVER
        while len(sym):
            ends = np.cumsum(count)
            least = np.minimum.reduceat(order, ends - count)
            live = least < NEVER
            n_live = np.count_nonzero(live)
            if n_live < 0.8 * len(live):
                mine = np.repeat(live, count)
                done.append((name[~live], *self._out(sym[~mine], count[~live])))
                sym, order = sym[mine], order[mine]
                name, count, least = name[live], count[live], least[live]
                if not n_live:
                    break
                ends, live = np.cumsum(count), live[live]
            rank = least >> 32
            hit = np.flatnonzero(order < np.repeat(np.where(live, rank + 1 << 32, 0), count))
            of = np.searchsorted(ends, hit, "right")
            if len(hit) > n_live:
                # Of occurrences that overlap, every second one from the left.
                run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, np.arange(len(hit)), 0))
                free = (np.arange(len(hit)) - run) % 2 == 0
                hit, of = hit[free], of[free]
                made, rank_of = (order[hit] & 0xFFFFFFFF).astype(np.int32), rank[of]
                left = np.where(np.diff(hit, prepend=-3) == 2, np.append(np.int32(0), made[:-1]), sym[np.maximum(hit - 1, 0)])
                right = sym[np.minimum(hit + 2, len(sym) - 1)]
                before = (hit > (ends - count)[of]) & (self._looked_up(left, made) >> 32 <= rank_of)
                after = (hit + 2 < ends[of]) & (self._looked_up(made, right) >> 32 <= rank_of)
                if (before | after).any():
                    apart = np.zeros(len(count), bool)
                    apart[of[before | after]] = True
                    one = ~apart[of] | (np.diff(of, prepend=-1) > 0)
                    hit, of = hit[one], of[one]
            sym[hit] = order[hit] & 0xFFFFFFFF
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, order = sym[keep], order[keep]
            count = count - np.bincount(of, minlength=len(count))
            hit = hit - np.arange(len(hit))
            begins = (np.cumsum(count) - count)[of]
            last = begins + count[of] - 1
            order[hit] = NEVER
            inside = hit[hit < last]
            order[inside] = self._looked_up(sym[inside], sym[inside + 1])
            before = hit[hit > begins] - 1
            order[before] = self._looked_up(sym[before], sym[before + 1])
        name, count = np.concatenate([n for n, _, _ in done]), np.concatenate([n for _, _, n in done])
        back = np.argsort(name)
        return np.concatenate([ids for _, ids, _ in done])[_spans((np.cumsum(count) - count)[back], count[back])], count[back]

    def decimal(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each followed by a space, as bytes; where each begins, and where the last ends."""
        line = self.digits[ids].view(np.uint8)
        return line[line != 0], np.append(0, np.cumsum(self.digit_sizes[ids]))

    def raw_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What raw() gives; where each id's bytes begin, and where the last ones end."""
        sizes = self.raw_sizes[ids]
        return self.raw_bytes[_spans(self.raw_at[ids], sizes)], np.append(0, np.cumsum(sizes))

    def raw(self, ids) -> bytes:
        """UTF-8 bytes of ids, with spaces for their marks; control and unknown pieces give what the library gives."""
        return b"".join(map(self.raw_pieces.__getitem__, ids))

    def finish(self, raw: bytes) -> str:
        """The text of raw bytes: each invalid byte becomes U+FFFD; the space put before the first word goes."""
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(raw):
                try:
                    out.append(raw[at:].decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(raw[at : at + e.start].decode() + "�")
                    at += e.start + 1
            return "".join(out)


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _keys(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word: a polynomial of its characters, mixed. Equal words have equal keys."""
    power, inverse = _powers(max(len(points), WINDOW))
    total = np.add.reduceat(mix64(points) * power[: len(points)], starts)
    return mix64(total * inverse[starts] + sizes.astype(np.uint64))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (BASE, INVERSE))


class _Generation:
    """Words by ascending key: their characters and ids, each in one array, with where those of each word lie."""

    def __init__(self):
        self.key, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.spans = np.zeros((4, 0), np.int64)
        self.points, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.row[at], -1)

    def add(self, key: np.ndarray, points: np.ndarray, sizes: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Words in ascending order of keys that are not held."""
        at, n = np.searchsorted(self.key, key), self.spans.shape[1]
        self.key, self.row = np.insert(self.key, at, key), np.insert(self.row, at, np.arange(n, n + len(key)))
        new = [len(self.points) + np.cumsum(sizes) - sizes, sizes, len(self.ids) + np.cumsum(count) - count, count]
        self.spans = np.concatenate([self.spans, new], 1)
        self.points, self.ids = np.concatenate([self.points, points]), np.concatenate([self.ids, ids])


class WordMemo:
    """Ids by word, found by keys of 64 bits and compared by characters: a word that shares another's key is merged alone. When
    the young half is full it becomes the old half, whose words survive only if used again."""

    def __init__(self, model: PieceModel):
        self.model, self.young, self.old = model, _Generation(), _Generation()

    def encode(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of neighbouring words that fill these characters, and their number in each word."""
        if len(self.young.key) >= MEMO or len(self.young.points) >= MEMO_CHARACTERS:
            self.old, self.young = self.young, _Generation()
        key = _keys(points, starts, sizes)
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        which, key, word = np.empty(len(order), np.int64), key[new], order[new]
        which[order] = np.cumsum(new) - 1
        # Words that differ from the one that stands for their key stand for themselves.
        same = sizes == sizes[word[which]]
        at = np.repeat(np.where(same, starts[word[which]] - starts, 0), sizes)
        at += np.arange(len(at))
        same[np.searchsorted(starts, np.flatnonzero(points[at] != points), "right") - 1] = False
        alone = np.flatnonzero(~same)
        which[alone] = len(word) + np.arange(len(alone))
        word = np.append(word, alone)

        def held(where: _Generation, rows: np.ndarray) -> np.ndarray:
            """Whether the word of each key is the one at its row."""
            ok = rows >= 0
            some, (begin, size, _, _) = np.flatnonzero(ok), where.spans[:, rows[ok]]
            mine = word[some]
            equal = size == sizes[mine]
            some, mine, begin, size = some[equal], mine[equal], begin[equal], size[equal]
            differ = np.flatnonzero(where.points[_spans(begin, size)] != points[_spans(starts[mine], size)])
            ok[:] = False
            ok[some] = True
            ok[some[np.searchsorted(np.cumsum(size), differ, "right")]] = False
            return ok

        young = self.young.find(key)
        taken = young >= 0
        known = held(self.young, young)
        back = np.where(taken, -1, self.old.find(key))
        back[~held(self.old, back)] = -1
        again = np.flatnonzero(back >= 0)
        if len(again):
            begin, size, at, n = self.old.spans[:, back[again]]
            self.young.add(key[again], self.old.points[_spans(begin, size)], size, self.old.ids[_spans(at, n)], n)
        fresh = np.append(~known & (back < 0), np.ones(len(alone), bool))
        fresh = np.flatnonzero(fresh)
        own, size = points[_spans(starts[word[fresh]], sizes[word[fresh]])], sizes[word[fresh]]
        ids, count = self.model.merge_points(own, size)
        # Those whose key is free are remembered, the others used once.
        free = fresh < len(key)
        free[free] = ~taken[fresh[free]]
        begin, at = np.cumsum(size) - size, np.cumsum(count) - count
        self.young.add(key[fresh[free]], own[_spans(begin[free], size[free])], size[free], ids[_spans(at[free], count[free])], count[free])
        of = np.zeros((2, len(word)), np.int64)
        of[:, : len(key)] = self.young.spans[2:, self.young.find(key)]
        source = self.young.ids
        if not free.all():
            of[:, fresh[~free]] = at[~free] + len(source), count[~free]
            source = np.concatenate([source, ids])
        at, count = of[:, which]
        return source[_spans(at, count)], count


_memos: dict[str, WordMemo] = {}


def _encoded(path: str, texts: list[str]):
    """(ids, number of the text that each part belongs to, where its part begins and ends) of the texts' words, in order, a
    window of words at a time. Empty texts have no part."""
    take_over("pieces", _memos.clear)
    m = model(path)
    if path not in _memos:
        _memos[path] = WordMemo(m)
    mark = SPACE if m.prefix else ""
    points = _points("".join([mark + t for t in texts if t])).copy()
    points[points == 32] = ord(SPACE)
    full = np.array([i for i, t in enumerate(texts) if t], np.int64)
    begins = np.cumsum([0, *(len(mark) + len(texts[i]) for i in full)])[:-1]
    if not len(full):
        return
    starts = m.word_starts(points, begins)
    sizes = np.diff(np.append(starts, len(points)))
    vast = sizes > WINDOW
    last = np.flatnonzero((np.diff(starts // WINDOW) != 0) | vast[1:] | vast[:-1]) + 1
    for a, b in zip([0, *last.tolist()], [*last.tolist(), len(starts)]):
        lo, hi = int(starts[a]), int(starts[b - 1] + sizes[b - 1])
        of = np.searchsorted(begins, starts[a:b], "right") - 1
        if vast[a]:
            # A word beyond a window stands alone, is not remembered, and is handed on in parts.
            ids, _ = m.merge_points(points[lo:hi], sizes[a:b])
            for part in np.split(ids, range(WINDOW, len(ids), WINDOW)):
                yield part, full[of].tolist(), np.zeros(1, np.int64), np.array([len(part)])
            continue
        ids, count = _memos[path].encode(points[lo:hi], starts[a:b] - lo, sizes[a:b])
        first = np.flatnonzero(np.diff(of, prepend=-1))
        at = (np.cumsum(count) - count)[first]
        yield ids, full[of[first]].tolist(), at, np.append(at[1:], len(ids))


def encode_texts(path: str, texts: list[str | None], end_id: int | None = None) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in texts]
    for ids, of, begin, end in _encoded(path, [t or "" for t in texts]):
        for i, a, b in zip(of, begin.tolist(), end.tolist()):
            out[i] += ids[a:b].tolist()
    return [x + [end_id] for x in out] if end_id is not None else out


def encode_text(path: str, text: str | None, end_id: int | None = None) -> list[int]:
    return encode_texts(path, [text], end_id)[0]


def _together(texts: pa.Array):
    """The texts of a batch, null ones empty, some characters at a time."""
    waiting, size = [], 0
    for text in texts:
        waiting.append(text.as_py() or "")
        size += len(waiting[-1])
        if size >= TOGETHER:
            yield waiting
            waiting, size = [], 0
    yield waiting


def decode_ids(path: str, ids) -> str:
    m = model(path)
    return m.finish(m.raw(ids))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> DataFrame:
    """doc_id and ids (array) of every row. Null and empty texts have the end id alone; extra columns are ignored."""
    bounded_batches(df.sparkSession)
    types = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ids = [x for texts in _together(batch.column(1)) for x in encode_texts(path, texts, end_id)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, types.field(1).type)], schema=types)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give a null text."""
    bounded_batches(df.sparkSession)
    types = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else decode_ids(path, x) for x in batch.column(1).to_pylist()], pa.string())], schema=types)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """doc_id, n_tokens (with the end id), ids_sha256 and decoded_sha256 of every row's whole text, encoded and decoded
    in one pass. Null and empty texts are the end id alone. Repeated rows repeat; extra columns are ignored."""
    bounded_batches(df.sparkSession)
    types = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        m = model(path)

        def digests(texts):
            n, lines, raw = [1] * len(texts), [hashlib.sha256() for _ in texts], [[] for _ in texts]
            for ids, of, begin, end in _encoded(path, texts):
                line, at = m.decimal(ids)
                back, back_at = m.raw_of(ids)
                for i, k, a, b, c, d in zip(of, (end - begin).tolist(), *(x.tolist() for x in (at[begin], at[end], back_at[begin], back_at[end]))):
                    n[i] += k
                    lines[i].update(line[a:b])
                    raw[i].append(back[c:d].tobytes())
            for x, line, parts in zip(n, lines, raw):
                line.update(str(end_id).encode())
                yield x, line.hexdigest(), hashlib.sha256(m.finish(b"".join(parts)).encode()).hexdigest()

        for batch in batches:
            rows = [x for texts in _together(batch.column(1)) for x in digests(texts)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types.types[1:]))], schema=types)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
