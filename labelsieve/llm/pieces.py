"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut into the stretches that no piece can cross (at
word starts, and around characters outside the vocabulary). The distinct stretches not met before are
concatenated and indexed by a suffix array: suffixes are ranked by their first
characters, with doubling up to the longest piece. Every piece is binary-searched for its
range of occurrences; the occurrences are edges of a lattice over the batch. They are sorted by
position and relaxed from left to right, all stretches of the batch together. What was
relaxed is remembered, so a stretch met again is not indexed again.

For a unigram model the relaxation keeps the path of highest total score. Which of two paths of the
same score wins hangs on the rounding of all that precedes, so such texts are indexed and
relaxed as a whole, in single precision as the public library does it. For a
BPE model it keeps, at each position, the one edge that byte-pair merging
would end there: a piece may follow the last piece of the encoding up to its start
exactly when merging the two pieces' text gives those two pieces back. That is read off the
halves that pieces are merged from: going back in time along the right halves of the
first and the left halves of the second, no two that meet may form a piece
that would have been merged before. Merges inside a stretch never
depend on what lies beyond its last two pieces, so this gives the
encoding that merging by rank gives, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.llm.common import per_document

SPACE = "▁"
_ID = np.dtype("<i4")
#: Encoded stretches that a worker remembers; then it starts anew.
REMEMBERED = 400_000
#: Characters indexed by one suffix array.
INDEXED = 1 << 18
#: Characters of the texts encoded together.
TOGETHER = 1 << 20
#: Longer stretches are relaxed one at a time.
LONG = 64
#: Slots of the memory of pairs, a power of two.
PAIRS = 1 << 20
NOTHING, OUTSIDE = -2, -1  # no piece ends here; a character outside the vocabulary does


def default_model() -> str:
    """The path of the public piece model that is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class PieceModel:
    """Pieces of a SentencePiece model, with its encoder's memory."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    unknown: int
    byte_ids: list[int]  # of the bytes 0 to 255; empty without byte fallback
    bpe: bool = True
    normalise: Callable[[str], str] | None = None  # gives escaped text; None: as it is
    known: dict[str, bytes] = field(default_factory=dict)  # ids of stretches, packed

    def __post_init__(self):
        """For merging, characters found in pieces only take part as any other; they are no ids."""
        self.real = len(self.pieces)
        whole = set(self.ids)
        added = sorted({c for p in whole for c in p} - whole) if self.bpe else []
        self.pieces = self.pieces + added
        self.scores = self.scores + [0.0] * len(added)
        self.normal = self.normal + [True] * len(added)
        del self.ids

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if self.normal[i]}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @cached_property
    def stretches(self) -> re.Pattern:
        """Cuts escaped text where no piece reaches across."""
        letters = {c for p in self.ids for c in p}
        if not self.words_apart:  # pieces with inner spaces: cut at unknown characters only
            inside = "".join(map(re.escape, sorted(letters)))
            return re.compile(f"[{inside}]+|[^{inside}]")
        alpha = "".join(map(re.escape, sorted(c for c in letters if c.isalpha())))
        other = "".join(map(re.escape, sorted(c for c in letters - {SPACE} if not c.isalpha())))
        inner = [p.lstrip(SPACE) for p in self.ids]
        leaves = any(a.isalpha() and not b.isalpha() for p in inner for a, b in zip(p, p[1:]))
        if leaves or not alpha or not other:
            return re.compile(f"{SPACE}*[{alpha}{other}]+|{SPACE}+|[^{alpha}{other}{SPACE}]")
        enters = any(b.isalpha() and not a.isalpha() for p in inner for a, b in zip(p, p[1:]))
        word = f"[{other}]*[{alpha}]+" if enters else f"[{alpha}]+"  # cut where letters end
        return re.compile(f"{SPACE}*(?:{word}|[{other}]+)|{SPACE}+|[^{alpha}{other}{SPACE}]")

    @cached_property
    def words_apart(self) -> bool:
        """No piece has a space after another character."""
        return not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    @cached_property
    def searched(self) -> tuple[list[str], list[int]]:
        """Pieces in the order of their code points, and their ids."""
        order = sorted(self.ids.items())
        return [p for p, _ in order], [i for _, i in order]

    @cached_property
    def rank(self) -> np.ndarray:
        """The order in which pieces are merged; -1 for single characters."""
        _, order = np.unique(-np.array(self.scores), return_inverse=True)
        return np.where([len(p) == 1 for p in self.pieces], -1, order).astype(np.int64)

    @cached_property
    def whole(self) -> np.ndarray:
        """Whether merging the text of a piece gives that piece."""
        return self._halves[2]

    @cached_property
    def _halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Left and right half of each piece, whether it is whole, and whether ranks don't tell when it is merged."""
        size = len(self.pieces)
        left, right = np.arange(size), np.arange(size)
        whole, odd = np.zeros(size, bool), np.zeros(size, bool)
        rank, ids = self.rank, self.ids
        for piece, i in sorted(ids.items(), key=lambda x: len(x[0])):
            if len(piece) == 1:
                whole[i] = True
                continue
            halves = self.merged(piece, 2)
            if len(halves) == 2 and self.merged("".join(halves)) == [piece]:
                a, b = ids[halves[0]], ids[halves[1]]
                left[i], right[i], whole[i] = a, b, True
                odd[i] = odd[a] or odd[b] or max(rank[a], rank[b]) >= rank[i]
        return left, right, whole, odd

    @cached_property
    def _formed(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of pieces that together are a piece, as sorted numbers, and that piece's rank."""
        ids, size = self.ids, len(self.pieces)
        found = sorted(
            (ids[piece[:k]] * size + ids[piece[k:]], self.rank[i])
            for piece, i in ids.items()
            for k in range(1, len(piece))
            if piece[:k] in ids and piece[k:] in ids
        )
        table = np.array(found, dtype=np.int64).reshape(-1, 2)
        return table[:, 0].copy(), table[:, 1].copy()

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of both pieces gives the two pieces back, for many pairs."""
        halves_left, halves_right, whole, odd = self._halves
        rank, size = self.rank, len(self.pieces)
        keys, ranks = self._formed
        fits = whole[left] & whole[right]
        strange = np.nonzero(fits & (odd[left] | odd[right]))[0]
        live = np.nonzero(fits & ~odd[left] & ~odd[right])[0]
        a, b = left[live], right[live]
        limit = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            if len(keys):
                key = a * size + b
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                meets = (keys[at] == key) & (ranks[at] < limit)
                fits[live[meets]] = False
            else:
                meets = np.zeros(len(live), bool)
            later, both = rank[a] > rank[b], (rank[a] < 0) & (rank[b] < 0)
            limit = np.where(later, rank[a], rank[b] + 1)
            a, b = np.where(later, halves_right[a], a), np.where(later, b, halves_left[b])
            on = ~(meets | both)
            live, a, b, limit = live[on], a[on], b[on], limit[on]
        for i in strange.tolist():
            one, two = self.pieces[left[i]], self.pieces[right[i]]
            fits[i] = self.merged(one + two) == [one, two]
        return fits

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fit``, remembering pairs: each has one slot, which it takes from the pair before."""
        slots, found = self._pairs
        key = left * len(self.pieces) + right
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # spread over the slots
        slot = (mixed >> np.uint64(40)).astype(np.int64) & (PAIRS - 1)
        missing = slots[slot] != key
        result = found[slot]
        if missing.any():
            fresh, back = np.unique(key[missing], return_inverse=True)
            fits = self.fit(fresh // len(self.pieces), fresh % len(self.pieces))
            result[missing] = fits[back]
            slots[slot[missing]], found[slot[missing]] = key[missing], fits[back]
        return result

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The symbols that byte-pair merging leaves of a short text, or ``until`` so many are left."""
        symbols = list(text)
        while len(symbols) > until:
            best, place = None, -1
            for i in range(len(symbols) - 1):
                found = self.ids.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, place = self.scores[found], i
            if place < 0:
                break
            symbols[place : place + 2] = [symbols[place] + symbols[place + 1]]
        return symbols

    def fallback(self, letter: str) -> list[int]:
        """Ids of a character that is no piece."""
        if self.byte_ids:
            return [self.byte_ids[b] for b in letter.encode()]
        return [self.unknown]

    # Encoding

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the same as merging (or best path) over the whole text."""
        return [unpacked(ids).tolist() for ids in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers one after another."""
        escape = self.normalise or (lambda text: SPACE + text.replace(" ", SPACE) if text else "")
        escaped = list(map(escape, texts))
        return self._apart(self._encode_whole(escaped) if self.bpe else self._relaxed(escaped))

    def _apart(self, found: list[bytes]) -> list[bytes]:
        """Runs of unknown characters as one unknown piece; not where they are spelled in bytes."""
        if self.byte_ids:
            return found
        kept = []
        for ids in map(unpacked, found):
            unknown = ids == self.unknown
            again = np.zeros(len(ids), bool)
            again[1:] = unknown[1:] & unknown[:-1]
            kept.append(ids[~again].tobytes())
        return kept

    def _encode_whole(self, escaped: list[str]) -> list[bytes]:
        cut = [self.stretches.findall(text) for text in escaped]
        known = self.known
        met = set().union(*cut)
        fresh = sorted(met.difference(known))
        if len(known) + len(fresh) > REMEMBERED and known:
            known.clear()
            fresh = sorted(met)
        known.update(zip(fresh, self._relaxed(fresh), strict=True))
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]

    def _relaxed(self, parts: list[str]) -> list[bytes]:
        """Ids of stretches or texts, a bounded number of characters at a time."""
        found, start = [], 0
        while start < len(parts):
            size, end = 0, start
            while end < len(parts) and (end == start or size + len(parts[end]) < INDEXED):
                size += len(parts[end]) + 1
                end += 1
            found += self._indexed(parts[start:end])
            start = end
        return found

    def _indexed(self, parts: list[str]) -> list[bytes]:
        """Index the parts, match all pieces, sort the edges and relax."""
        joined = "\0".join(parts) + "\0"
        starts, pieces, lengths = self.edges(joined)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(sizes + 1) - sizes - 1
        together = self.bpe & (sizes <= LONG)
        found: list[bytes] = [b""] * len(parts)
        short = np.nonzero(together)[0]
        for i, ids in zip(short, self._relax_together(joined, begins[short], sizes[short], starts, pieces, lengths)):
            found[i] = ids
        relax = self._relax_merges if self.bpe else self._relax_scores
        for i in np.nonzero(~together)[0].tolist():
            at, end = int(begins[i]), int(begins[i] + sizes[i])
            low, high = np.searchsorted(starts, [at, end])
            bounds = np.searchsorted(starts[low:high], np.arange(at, end + 1)).tolist()
            ids = relax(parts[i], bounds, pieces[low:high].tolist(), lengths[low:high].tolist())
            found[i] = np.array(ids, _ID).tobytes()
        return found

    def _relax_together(self, joined: str, begins, sizes, starts, pieces, lengths) -> list[bytes]:
        """The merged ids of many short stretches: the edges that start on their first character, then on their second, …

        ``begins`` and ``sizes`` say where in the joined text the stretches are.
        """
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        owner = np.full(len(codes) + 1, -1, np.int64)
        for step in range(int(sizes.max(initial=0))):
            inside = np.nonzero(sizes > step)[0]
            owner[begins[inside] + step] = inside
        mine = np.nonzero(owner[starts] >= 0)[0]
        offset = starts[mine] - begins[owner[starts[mine]]]
        mine = mine[np.argsort(offset, kind="stable")]
        until = np.searchsorted(np.sort(offset), np.arange(LONG + 1))
        alone = np.isin(codes, self._letters)
        last = np.full(len(codes) + 1, NOTHING, np.int64)
        back = np.zeros(len(codes) + 1, np.int64)
        for step in range(int(sizes.max(initial=0))):
            edge = mine[until[step] : until[step + 1]]
            at, piece = starts[edge], pieces[edge]
            end = at + lengths[edge]
            outside = begins[sizes > step] + step
            outside = outside[~alone[outside]]
            before = last[at]
            first = before == OUTSIDE if step else np.ones(len(at), bool)
            ok = first & self.whole[piece]
            asked = np.nonzero(~first & (before >= 0))[0]
            ok[asked] = self.follows(before[asked], piece[asked])
            ok &= last[end] == NOTHING
            if step:
                outside = outside[last[outside] != NOTHING]
            outside = outside[last[outside + 1] == NOTHING]
            last[end[ok]], back[end[ok]] = piece[ok], at[ok]
            last[outside + 1], back[outside + 1] = OUTSIDE, outside
        return self._walk_together(joined, begins, sizes, last, back)

    def _walk_together(self, joined: str, begins, sizes, last, back) -> list[bytes]:
        """Ids along the kept edges, from the ends of all stretches back to their starts."""
        here, live = begins + sizes, np.arange(len(begins))
        who, what = [], []
        plain = np.ones(len(begins), bool)  # all of it pieces that have an id
        while len(live):
            here_live = here[live]
            who.append(live)
            what.append(last[here_live])
            plain[live[(last[here_live] < 0) | (last[here_live] >= self.real)]] = False
            here[live] = back[here_live]
            live = live[here[live] > begins[live]]
        who = np.concatenate(who) if who else np.zeros(0, np.int64)
        what = np.concatenate(what) if what else np.zeros(0, np.int64)
        order = np.argsort(who[::-1], kind="stable")  # the first pieces were found last
        packed = what[::-1][order].astype(_ID).tobytes()
        ends = (np.cumsum(np.bincount(who, minlength=len(begins))) * _ID.itemsize).tolist()
        found = [packed[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.nonzero(~plain)[0].tolist():
            at, end = int(begins[i]), int(begins[i] + sizes[i])
            ids = self._walk(joined[at:end], last[at : end + 1].tolist(), (back[at : end + 1] - at).tolist())
            found[i] = np.array(ids, _ID).tobytes()
        return found

    @cached_property
    def _letters(self) -> np.ndarray:
        """Code points that are pieces."""
        return np.array(sorted(ord(p) for p in self.ids if len(p) == 1), np.uint32)

    @cached_property
    def _worst(self) -> np.float32:
        """What a character outside the vocabulary scores: ten below every piece."""
        lowest = min((s for s, ok in zip(self.scores, self.normal, strict=True) if ok), default=0.0)
        return np.float32(lowest) - np.float32(10)

    def edges(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of all pieces in a text: start, piece and length, by start, then length.

        Each piece's occurrences are one range of the suffix array.
        """
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        order = suffix_order(codes, self.longest)
        names, ids = self.searched
        low, high = occurrence_ranges(codes, order, names)
        counts = high - low
        hit = np.nonzero(counts)[0]
        counts = counts[hit]
        first = np.repeat(low[hit] - (np.cumsum(counts) - counts), counts)
        starts = order[first + np.arange(counts.sum())]
        which = np.repeat(hit, counts)
        length = np.array([len(n) for n in names], dtype=np.int64)[which]
        by = np.lexsort((length, starts))
        return starts[by], np.array(ids, dtype=np.int64)[which][by], length[by]

    def _relax_merges(self, text: str, bounds, pieces, lengths) -> list[int]:
        """The BPE encoding: at each end the one edge compatible with what precedes it."""
        n, whole = len(text), self.whole
        last: list[int] = [NOTHING] * (n + 1)
        back = [0] * (n + 1)
        asked: dict[tuple[int, int], bool] = {}
        for i in range(n):
            before = last[i]
            if i and before == NOTHING:
                continue
            for e in range(bounds[i], bounds[i + 1]):
                end, piece = i + lengths[e], pieces[e]
                if last[end] != NOTHING:
                    continue
                if not i or before == OUTSIDE:
                    ok = whole[piece]
                else:
                    ok = asked.get((before, piece))
                    if ok is None:
                        ok = asked[before, piece] = bool(self.follows(np.array([before]), np.array([piece]))[0])
                if ok:
                    last[end], back[end] = piece, i
            if last[i + 1] == NOTHING and text[i] not in self.ids:
                last[i + 1], back[i + 1] = OUTSIDE, i
        return self._walk(text, last, back)

    def _relax_scores(self, text: str, bounds, pieces, lengths) -> list[int]:
        """The path of highest total score; characters outside score below every piece."""
        n, scores = len(text), list(np.array(self.scores, np.float32))
        best = [np.float32(0)] + [np.float32(-np.inf)] * n
        last = [NOTHING] * (n + 1)
        back = [0] * (n + 1)
        for i in range(n):
            for e in range(bounds[i], bounds[i + 1]):
                end, score = i + lengths[e], best[i] + scores[pieces[e]]
                if score > best[end]:
                    best[end], last[end], back[end] = score, pieces[e], i
            if text[i] not in self.ids and best[i] + self._worst > best[i + 1]:
                best[i + 1], last[i + 1], back[i + 1] = best[i] + self._worst, OUTSIDE, i
        return self._walk(text, last, back)

    def _walk(self, text: str, last, back) -> list[int]:
        out: list[int] = []
        end = len(text)
        while end:
            start, piece = back[end], last[end]
            if 0 <= piece < self.real:
                out.append(piece)
            else:
                out.extend(reversed(self.fallback(text[start:end])))
            end = start
        return out[::-1]

    # Decoding

    @cached_property
    def spelled(self) -> list[bytes]:
        """What each id stands for, as bytes; nothing for control pieces."""
        byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        return [
            bytes([byte_of[i]])
            if i in byte_of
            else (p.replace(SPACE, " ").encode() if self.normal[i] else b" \xe2\x81\x87 " if i == self.unknown else b"")
            for i, p in enumerate(self.pieces)
        ]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts in front."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by their first ``depth`` codes or more."""
    _, rank = np.unique(codes, return_inverse=True)
    rank, reached = rank.astype(np.int64) + 1, 1
    while True:
        later = np.zeros_like(rank)
        later[:-reached] = rank[reached:]
        keys = rank * (len(rank) + 1) + later
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        fresh = np.empty(len(keys), dtype=np.int64)
        fresh[order] = np.cumsum(np.concatenate([[1], (sorted_keys[1:] != sorted_keys[:-1])]))
        rank, reached = fresh, reached * 2
        if reached >= depth or reached >= len(codes):
            return order


def occurrence_ranges(codes: np.ndarray, order: np.ndarray, names: list[str]):
    """First and last place in the suffix order of every piece, by binary search of all at once.

    Pieces are compared with suffixes code by code; each step of the search
    halves the ranges of all pieces together.
    """
    width = max(map(len, names), default=1)
    table = np.zeros((len(names), width), dtype=np.int64)
    size = np.array([len(n) for n in names], dtype=np.int64)
    flat = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(names)), size)
    table[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    padded = np.concatenate([codes, np.zeros(width, dtype=np.int64)])

    def bound(upper: bool) -> np.ndarray:
        low = np.zeros(len(names), dtype=np.int64)
        high = np.full(len(names), len(order), dtype=np.int64)
        while True:
            open_ = np.nonzero(low < high)[0]
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            start = order[middle]
            sign = np.zeros(len(open_), dtype=np.int64)
            for k in range(width):
                live = (sign == 0) & (size[open_] > k)
                if not live.any():
                    break
                sign = np.where(live, np.sign(padded[start + k] - table[open_, k]), sign)
            right = (sign < 0) | ((sign == 0) & upper)
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]

    return bound(False), bound(True)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a serialised protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass(frozen=True)
class Kind:
    """What a model file says of its encoder, beside the pieces."""

    bpe: bool
    as_is: bool  # texts are taken as they are, but for the space in front

    @classmethod
    def read(cls, data: bytes) -> Kind:
        """Fails for models whose encodings would differ."""
        parts = [(n, v) for n, v in fields(data) if n in (1, 2, 3)]
        training = {n: v for part, data in parts if part == 2 for n, v in fields(data)}
        normal = {n: v for part, data in parts if part == 3 for n, v in fields(data)}
        types = {dict(fields(v)).get(3, 1) for part, v in parts if part == 1}
        refused = {
            "neither unigram nor BPE": training.get(3, 1) not in (1, 2),
            "white space at word ends": training.get(24, 0),
            "no space put in front": not normal.get(3, 1),
            "white space kept unescaped": not normal.get(5, 1),
            "pieces defined by the user or unused": types & {4, 5},
        }
        if any(refused.values()):
            raise ValueError("not supported: " + ", ".join(reason for reason, holds in refused.items() if holds))
        return cls(training.get(3, 1) == 2, not normal.get(2, b"") and not normal.get(4, 1))


@cache
def load(path: str) -> PieceModel:
    """Read a model file; each worker reads a model once. What it says of its kind is heeded or refused."""
    import sentencepiece

    with open(path, "rb") as file:
        kind = Kind.read(file.read())
    raw = sentencepiece.SentencePieceProcessor(model_file=path)
    n = raw.get_piece_size()
    names = [raw.id_to_piece(i) for i in range(n)]
    special = [raw.is_byte(i) or raw.is_control(i) or raw.is_unknown(i) for i in range(n)]
    place = {name: i for i, name in enumerate(names) if raw.is_byte(i)}
    byte_ids = [place.get(f"<0x{b:02X}>", -1) for b in range(256)]
    return PieceModel(
        names,
        [raw.get_score(i) for i in range(n)],
        [not s for s in special],
        raw.unk_id(),
        byte_ids if min(byte_ids) >= 0 else [],
        kind.bpe,
        None if kind.as_is else raw.normalize,
    )


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, _ID)


def batched(texts: list[str]) -> Iterator[list[str]]:
    """Texts that are encoded together, by their characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def _lists(found: list[bytes]) -> pa.ListArray:
    sizes = np.array([0, *map(len, found)], dtype=np.int64) // _ID.itemsize
    offsets = np.cumsum(sizes).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unpacked(b"".join(found))))


def encode(
    docs: DataFrame,
    *,
    model: str | None = None,
    text: str = "text",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Carried columns (doc_id), ``ids`` and ``round_trip``: whether decoding gives the text back.

    Null and empty texts have no ids. Every row comes back, in any order; repeated rows
    are encoded alike. The model file must be installed on every executor. Unigram and BPE models
    are read, with their normaliser; texts that it changes don't round-trip. Models with pieces of the
    user's, unused pieces or other rules for white space are an error.
    """
    path = model or default_model()

    def work(texts: list[str]) -> list:
        pieces = load(path)
        ids, same = [], []
        for part in batched(texts):
            found = pieces.encode_packed(part)
            same.extend(pieces.decode(unpacked(i).tolist()) == t for i, t in zip(found, part, strict=True))
            ids.append(_lists(found))
        return [pa.concat_arrays(ids) if ids else _lists([]), same]

    return per_document(
        docs, work, "ids array<int>, round_trip boolean", text=text, carry=carry, binary=False
    )


def decode(tokens: DataFrame, *, model: str | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """Carried columns (doc_id) and ``text`` of a table of ``ids``; null ids give an empty text."""
    path = model or default_model()
    carried = carry if carry is not None else {"doc_id": F.col("doc_id")}

    def run(batches):
        pieces = load(path)
        for batch in batches:
            at = batch.num_columns - 1
            texts = [pieces.decode(i or []) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(texts, pa.string())],
                names=[*batch.schema.names[:at], "text"],
            )

    source = tokens.select(*[c.alias(n) for n, c in carried.items()], F.col("ids"))
    return source.mapInArrow(run, source.drop("ids").withColumn("text", F.lit("")).schema)
