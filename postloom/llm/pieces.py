"""Encoding and decoding with a SentencePiece model by a max-plus scan.

A text is a lattice of pieces. A path scores the sum of its pieces and of its neighbouring pairs: a unigram
model scores pieces by their log probability and pairs by 0; a BPE model scores pieces by 0 and a pair by 0
if merging the joined pair gives that pair back, else by minus infinity. (A sequence is a text's BPE encoding
exactly if every neighbouring pair is the encoding of its own text, so the one path above minus infinity is
the encoding.) The best path is the library's result for either kind of model.

A text of more than ``GIANT`` characters is split into chunks of ``CHUNK``. The state at a boundary is the piece that covers the
last character before it. Each chunk yields the transfer matrix from its entry to its exit states; matrices
of a text are multiplied in the max-plus sense, which fixes the state at every boundary; then every chunk
is traced back on its own.

Where no piece of the vocabulary can pass (before a space that follows another character, beside a line end),
all paths meet: the matrix of the part between two such cuts has one entry and one exit, so the best path of a text
is that of its parts. A shorter text, and the inside of a chunk, is scanned part by part; the max-plus step and the
trace of a part are done once per distinct part, while it is kept. For BPE the new parts of a batch take the step side by side,
place by place: pieces that end at the same place of their part are scored together (a place has one path above minus infinity).

Cases: null and empty texts have no ids; characters outside the vocabulary become bytes; a space sign (U+2581)
in a text decodes as a space; repeated rows are encoded one by one; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import materialise, query, small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT, CHUNK = 65536, 16384
#: Parts of a generation and pairs whose solutions a task keeps; rows sent on together.
KEPT_PARTS, KEPT_PAIRS, ROWS = 100_000, 100_000, 128
#: Parts of at most so many characters take the step side by side, so many characters at a time.
SIDE_PART, SIDE_CHARS = 64, 1 << 17
#: Slots (powers of two) of the tables of a worker for steps side by side: from prefix and character to prefix, scored pairs.
PREFIX_BITS, PAIR_BITS = 19, 19
SPACE = "▁"
_PARTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

State = tuple[int, int, int]  # start, end and id of a piece
Matrix = dict[State, dict[State, float]]


class Pieces:
    """Vocabulary and scores of a model, read from its bytes."""

    def __init__(self, data: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto.FromString(data)
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without text normalisation are read")
        self.unigram = model.trainer_spec.model_type == 1
        self.dummy = spec.add_dummy_prefix
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        plain = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.ids = plain
        self.score = [p.score for p in model.pieces]
        self.score[self.unknown] = min((self.score[i] for i in plain.values()), default=0.0) - 10
        self.text = [p.piece for p in model.pieces]
        self.longest = max(map(len, plain), default=1)
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p, re.S) for p in plain)
        self.out = [p.piece.replace(SPACE, " ").encode() if p.type in (1, 4) else bytes([int(p.piece[3:5], 16)])
                    if p.type == 6 else " ⁇ ".encode() if p.type == 2 else b"" for p in model.pieces]
        self.pairs: dict[int, bool] = {}
        self.courses: dict[int, tuple] = {}

    def merged(self, text: str) -> list[str]:
        """The BPE encoding of a short text: the best pair merges first, the leftmost of equals."""
        parts = list(text)
        while (at := self._best_merge(parts)[1]) >= 0:
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _best_merge(self, parts: list[str]) -> tuple[float, int]:
        """Score and place of the next merge; -1 if there is none."""
        best, at = -np.inf, -1
        for i in range(len(parts) - 1):
            found = self.ids.get(parts[i] + parts[i + 1])
            if found is not None and self.score[found] > best:
                best, at = self.score[found], i
        return best, at

    def follows(self, before: int | None, after: int) -> bool:
        """Whether the pair scores 0 (``before`` is None at a cut)."""
        if self.unigram or after == self.unknown or before == self.unknown:
            return True
        if before is None:
            return self.fits(before, after)
        key = before << 32 | after
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.fits(before, after)
        return known

    def course(self, piece: int) -> tuple[tuple, tuple, tuple, bool]:
        """How the text of a piece merges on its own.

        The score of each next merge (at the end minus infinity), the first and the last part before it, and whether one part is left.
        """
        known = self.courses.get(piece)
        if known is None:
            parts, scores, firsts, lasts = list(self.text[piece]), [], [], []
            while True:
                best, at = self._best_merge(parts)
                scores.append(best)
                firsts.append(parts[0])
                lasts.append(parts[-1])
                if at < 0:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            known = self.courses[piece] = (tuple(scores), tuple(firsts), tuple(lasts), len(parts) == 1)
        return known

    def fits(self, before: int | None, after: int) -> bool:
        """``follows`` for a BPE model, worked out anew: both texts merge side by side, best first, and no merge across is ever the best."""
        if after == self.unknown or before == self.unknown:
            return True
        right, firsts, _, whole = self.course(after)
        if before is None or not whole:
            return whole
        left, _, lasts, whole = self.course(before)
        x = y = 0
        while whole:
            across = self.ids.get(lasts[x] + firsts[y])
            if across is not None and (score := self.score[across]) > left[x] and score >= right[y]:
                return False
            if left[x] >= right[y]:
                if left[x] == -np.inf:
                    return True
                x += 1
            else:
                y += 1
        return False

    def forward(self, text: str, begin: int, before: int | None, stop: int) -> dict[int, dict]:
        """Best scores of paths from ``begin``, by end and last piece, over pieces that start before ``stop``.

        An entry holds the score and where the path came from.
        """
        reached: dict[int, dict] = {begin: {before: (0.0, -1, None)}}
        for i in range(begin, stop):
            states = reached.get(i)
            if not states:
                continue
            for j in range(i + 1, min(len(text), i + self.longest) + 1):
                piece = self.ids.get(text[i:j])
                if piece is None:
                    if j > i + 1 or text[i] in self.ids:
                        continue
                    piece = self.unknown
                best = None
                for last, (score, _, _) in states.items():
                    if (best is None or score > best[0]) and self.follows(last, piece):
                        best = (score, i, last)
                if best is not None:
                    own = 0.0 if not self.unigram else self.score[piece]
                    reached.setdefault(j, {})[piece] = (best[0] + own, best[1], best[2])
        return reached

    def trace(self, text: str, reached: dict[int, dict], end: int, last: int | None) -> list[int]:
        """Ids of the best path to ``end`` whose last piece is ``last``; unknown characters as bytes."""
        ids: list[int] = []
        while reached[end][last][1] >= 0:
            _, start, before = reached[end][last]
            if last == self.unknown and self.bytes:
                ids += [self.bytes[b] for b in reversed(text[start:end].encode("utf-8"))]
            else:
                ids.append(last)
            end, last = start, before
        return ids[::-1]

    def with_bytes(self, text: str, path: list[int]) -> bytes:
        """Ids (int32) of a path through a text, unknown characters as bytes."""
        ids, at = [], 0
        for piece in path:
            if piece == self.unknown:
                ids += [self.bytes[b] for b in text[at].encode("utf-8")]
            else:
                ids.append(piece)
            at += 1 if piece == self.unknown else len(self.text[piece])
        return np.array(ids, np.int32).tobytes()

    def part(self, text: str) -> bytes:
        """Ids (int32) of a text whose ends are cuts: the max-plus step from one to the other, then the trace."""
        reached = self.forward(text, 0, None, len(text))
        states = reached[len(text)]
        return np.array(self.trace(text, reached, len(text), max(states, key=lambda s: states[s][0])), np.int32).tobytes()


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class SideBySide:
    """``Pieces.part`` for many short parts of a BPE model at once."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.start = pieces, len(pieces.text)
        nodes = {"": 0}
        for piece in pieces.ids:
            for i in range(1, len(piece) + 1):
                nodes.setdefault(piece[:i], len(nodes))
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[[nodes[p] for p in pieces.ids]] = list(pieces.ids.values())
        keys = np.array([nodes[p[:-1]] << 21 | ord(p[-1]) for p in nodes if p], np.int64)
        bits = max(PREFIX_BITS, (4 * len(keys)).bit_length())
        self.bits, self.keys, self.child = bits, np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, slots = np.arange(len(keys)), _slots(keys, bits)
        while len(left):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[left[free]]
            placed = self.keys[slots] == keys[left]
            self.child[slots[placed]] = left[placed] + 1
            left, slots = left[~placed], (slots[~placed] + 1) & ((1 << bits) - 1)
        self.scored = np.full(1 << PAIR_BITS, -1, np.int64)

    def longer(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The prefix that ``char`` makes of each prefix; -1 if no piece begins so."""
        keys = node.astype(np.int64) << 21 | char
        slots = _slots(keys, self.bits)
        got = self.keys[slots]
        far = np.flatnonzero((got != keys) & (got >= 0))
        while len(far):
            slots[far] = (slots[far] + 1) & ((1 << self.bits) - 1)
            got[far] = self.keys[slots[far]]
            far = far[(got[far] != keys[far]) & (got[far] >= 0)]
        return np.where(got == keys, self.child[slots], -1)

    def follows(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Which pairs score 0 (``before`` is ``start`` at a cut). A slot keeps the pair that was scored last."""
        keys = before.astype(np.int64) * (self.start + 1) + after
        slots = _slots(keys, PAIR_BITS)
        kept = self.scored[slots]
        good, new = (kept & 1).astype(bool), np.flatnonzero(kept >> 1 != keys)
        if len(new):
            pairs, at = np.unique(keys[new], return_inverse=True)
            fits = np.array([self.pieces.fits(None if b == self.start else b, a) for b, a in
                             zip((pairs // (self.start + 1)).tolist(), (pairs % (self.start + 1)).tolist(), strict=True)])
            good[new] = fits[at]
            self.scored[_slots(pairs, PAIR_BITS)] = pairs << 1 | fits
        return good

    def edges(self, chars: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, length, id of every piece in the texts and how many longer ones end there.

        ``stops`` has the end of the text of each character.
        """
        at, node, found = np.arange(len(chars)), np.zeros(len(chars), np.int32), []
        for size in range(1, self.pieces.longest + 1):
            node = self.longer(node, chars[at + size - 1])
            piece = np.where(node >= 0, self.piece[node], -1)
            if size == 1:
                piece[piece < 0] = self.pieces.unknown
            ends = piece >= 0
            found.append((at[ends], np.full(ends.sum(), size), piece[ends]))
            more = (node >= 0) & (at + size < stops[at])
            at, node = at[more], node[more]
        longer, ranks = np.zeros(len(chars) + 1, np.int16), []
        for begin, size, _ in found[::-1]:
            ranks.append(longer[begin + size])
            longer[begin + size] += 1
        return *(np.concatenate(x) for x in zip(*found[::-1], strict=True)), np.concatenate(ranks)

    def solve(self, texts: list[str]) -> list[bytes]:
        """Ids (int32) of texts whose ends are cuts; a text of n characters has n + 1 places."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), sizes)
        stops = np.cumsum(sizes)
        at, size, piece, rank = self.edges(chars, stops[owner])
        step = (at + size - (stops - sizes)[owner[at]]) * self.pieces.longest + rank
        order = np.argsort(step.astype(np.int16 if SIDE_PART * self.pieces.longest < 1 << 15 else np.int64), kind="stable")
        begin, piece = (at + owner[at])[order], piece[order]
        end = begin + size[order]
        first, final = stops - sizes + np.arange(len(texts)), stops + np.arange(len(texts))
        last, came = np.full(len(chars) + len(texts), -1, np.int32), np.zeros(len(chars) + len(texts), np.int64)
        last[first] = self.start
        steps = np.cumsum(np.bincount(step)).tolist()
        for a, b in zip([0, *steps], steps, strict=False):
            if a < b:  # no place is scored again: 0 is the best there is
                open_ = a + np.flatnonzero((last[end[a:b]] < 0) & (last[begin[a:b]] >= 0))
                best = open_[self.follows(last[begin[open_]], piece[open_])]
                last[end[best]], came[end[best]] = piece[best], begin[best]
        passed, place, origin = np.zeros(len(last), bool), final, first
        while len(place):
            passed[place] = True
            place = came[place]
            place, origin = place[more := place > origin], origin[more]
        ids, counts = last[passed].astype(np.int32), np.cumsum(passed)[final].tolist()
        data, out = ids.tobytes(), []
        for a, b in zip([0, *counts], counts, strict=False):
            out.append(data[4 * a:4 * b])
        if self.pieces.bytes and len(strange := np.flatnonzero(ids == self.pieces.unknown)):
            for k in np.unique(np.searchsorted(counts, strange, "right")).tolist():
                out[k] = self.pieces.with_bytes(texts[k], np.frombuffer(out[k], np.int32).tolist())
        return out


class Parts(dict):
    """Solved parts. ``prefix`` comes before each key.

    When full, they become the older generation and the one before is forgotten; a part that is met again moves up, so
    frequent parts stay and rare ones don't pile up.
    """

    def __init__(self, pieces: Pieces, prefix: str = "", most: int = KEPT_PARTS) -> None:
        self.pieces, self.prefix, self.most = pieces, prefix, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(key)
        if ids is None:
            ids = self.pieces.part(self.prefix + key)
        self[key] = ids
        return ids

    def learn(self, keys: set[str], solver: SideBySide) -> None:
        """Have all ``keys``, solving the new ones of few characters side by side."""
        new = [k for k in keys if k not in self]
        if len(self) + len(new) > self.most:
            self.older = dict(self)
            self.clear()
            new = list(keys)
        older = self.older
        self.update((k, older[k]) for k in new if k in older)
        new = [k for k in new if k not in older and len(k) <= SIDE_PART]
        texts = [self.prefix + k for k in new] if self.prefix else new
        ends = np.cumsum([len(t) for t in texts])
        cuts = np.searchsorted(ends, np.arange(SIDE_CHARS, ends[-1], SIDE_CHARS)).tolist() if new else []
        for a, b in zip([0, *cuts], [*cuts, len(new)], strict=True):
            if a < b:
                self.update(zip(new[a:b], solver.solve(texts[a:b]), strict=True))


class Encoder:
    def __init__(self, data: bytes) -> None:
        self.pieces = Pieces(data)
        self.parts, self.words = Parts(self.pieces), Parts(self.pieces, SPACE)
        self.solver: SideBySide | None = None

    def forget(self) -> None:
        """Drop the solutions; the tables of the model stay."""
        for kept in (self.parts, self.words):
            kept.clear()
            kept.older = {}
        self.pieces.pairs.clear()

    def marked(self, text: str) -> str:
        """The text with space signs, as the model sees it."""
        return (SPACE if self.pieces.dummy and text else "") + text.replace(" ", SPACE)

    def _blanks(self, text: str) -> bool:
        """Whether some space sign of a marked text is not followed by a word."""
        return SPACE * 2 in text or text[-1] == SPACE or SPACE + "\n" in text

    def between(self, text: str) -> bytes:
        """Ids of a marked text whose ends are cuts."""
        if not text:
            return b""
        return self.joined(self.lines(text)) if self.pieces.cuts else self.pieces.part(text)

    def lines(self, text: str) -> list[tuple[str, list[str]]]:
        """Parts of a marked text by line: the first of a line (or empty) and the others, without their space sign.

        With blanks that no word follows, every part is a first one.
        """
        if self._blanks(text):
            return [(part, []) for part in _PARTS.findall(text)]
        lines = [line.split(SPACE) for line in text.split("\n")]
        found = [(lines[0][0], lines[0][1:])]
        for first, *words in lines[1:]:
            found += [("\n", []), (first, words)]
        return found

    def joined(self, lines: list[tuple[str, list[str]]]) -> bytes:
        out = []
        for first, words in lines:
            if first:
                out.append(self.parts[first])
            out += map(self.words.__getitem__, words)
        return b"".join(out)

    def first_cut(self, text: str, begin: int, end: int) -> int | None:
        return next((i for i in range(max(1, begin), end) if self._cut(text, i)), None)

    def last_cut(self, text: str, begin: int, end: int) -> int | None:
        return next((i for i in range(end, max(0, begin - 1), -1) if 0 < i < len(text) and self._cut(text, i)), None)

    def _cut(self, text: str, i: int) -> bool:
        return self.pieces.cuts and (text[i] == SPACE != text[i - 1] or text[i] == "\n" or text[i - 1] == "\n")

    def entries(self, text: str, at: int) -> list[State]:
        """Pieces that cover the character before ``at``."""
        found = []
        for start in range(max(0, at - self.pieces.longest), at):
            for end in range(at, min(len(text), start + self.pieces.longest) + 1):
                piece = self.pieces.ids.get(text[start:end])
                if piece is None and end == start + 1 and text[start] not in self.pieces.ids:
                    piece = self.pieces.unknown
                if piece is not None:
                    found.append((start, end, piece))
        return found

    def exits(self, text: str, begin: int, before: int | None, stop: int, last: bool) -> tuple[dict[State, float], dict]:
        """Best scores from a state to each piece that covers the character before ``stop``."""
        reached = self.pieces.forward(text, begin, before, stop)
        found = {}
        for end, states in reached.items():
            if end == len(text) if last else end >= stop:
                for piece, (score, start, _) in states.items():
                    if piece is not None:
                        found[(start, end, piece)] = score
        return found, reached

    def transfer(self, text: str, begin: int, stop: int, first: bool, last: bool) -> Matrix:
        """Transfer matrix of the chunk ``[begin, stop)`` of ``text``, which holds its neighbours' edges too.

        An entry that ends after the first cut, or after the chunk, still belongs to it: its exits follow.
        """
        starts: list[State | None] = [None] if first else self.entries(text, begin)
        out: Matrix = {}
        right: dict[State, float] | None = None
        cut = self.last_cut(text, begin, stop - 1) if stop - begin > 1 else None
        for state in starts:
            at, before = (0, None) if state is None else (state[1], state[2])
            if at >= stop:
                if state is not None and (not last or at == len(text)):
                    out[state] = {state: 0.0}
                continue
            if cut is not None and at <= cut:
                near = self.first_cut(text, at, cut + 1)
                if at < near:
                    reached = self.pieces.forward(text, at, before, near)
                    if near not in reached:
                        continue
                    gained = max(s for s, _, _ in reached[near].values())
                else:
                    gained = 0.0
                if right is None:
                    right, _ = self.exits(text, cut, None, stop, last)
                out[state or (0, 0, -1)] = {k: v + gained for k, v in right.items()}
            else:
                found, _ = self.exits(text, at, before, stop, last)
                out[state or (0, 0, -1)] = found
        return {k: v for k, v in out.items() if v}

    def trace(self, text: str, begin: int, stop: int, entry: State | None, exit_: State) -> bytes:
        """Ids after the entry piece up to and with the exit piece; none if one piece spans the chunk."""
        if entry == exit_:
            return b""
        at, before = (0, None) if entry is None else (entry[1], entry[2])
        cut = self.last_cut(text, begin, stop - 1) if stop - begin > 1 else None
        out = b""
        if cut is not None and at <= cut:
            near = self.first_cut(text, at, cut + 1)
            if at < near:
                reached = self.pieces.forward(text, at, before, near)
                states = reached[near]
                out += np.array(self.pieces.trace(text, reached, near, max(states, key=lambda s: states[s][0])), np.int32).tobytes()
            out += self.between(text[near:cut])
            at, before = cut, None
        reached = self.pieces.forward(text, at, before, stop)
        return out + np.array(self.pieces.trace(text, reached, exit_[1], exit_[2]), np.int32).tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.between(self.marked(text)) if text else b""

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text, after the new parts of all of them have been solved side by side."""
        if self.pieces.unigram or not self.pieces.cuts:
            return [self.encode(t) for t in texts]
        split = [self.lines(self.marked(t)) if t else [] for t in texts]
        parts, words = set(), set()
        for lines in split:
            for first, rest in lines:
                if first:
                    parts.add(first)
                words.update(rest)
        self.solver = self.solver or SideBySide(self.pieces)
        self.parts.learn(parts, self.solver)
        self.words.learn(words, self.solver)
        return list(map(self.joined, split))

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.pieces.out.__getitem__, ids))
        return (data[1:] if self.pieces.dummy and data[:1] == b" " else data).decode("utf-8", "replace")


def product(left: Matrix, right: Matrix) -> Matrix:
    """Max-plus product of two neighbouring transfer matrices (states in the text's own positions)."""
    out: Matrix = {}
    for entry, row in left.items():
        best: dict[State, float] = {}
        for mid, score in row.items():
            for exit_, more in right.get(mid, {}).items():
                if exit_ not in best or score + more > best[exit_]:
                    best[exit_] = score + more
        if best:
            out[entry] = best
    return out


@lru_cache(maxsize=2)
def _loaded(data: bytes) -> Encoder:
    return Encoder(data)


@contextmanager
def _encoder(data: bytes) -> Iterator[Encoder]:
    """The encoder of a worker, which lives on after a task; what the task has solved goes with the task."""
    try:
        yield _loaded(data)
    finally:
        _loaded(data).forget()


_SHORT = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("n_chunks", pa.int32()), ("round_trip", pa.bool_())])
_ENCODED = "doc_id long, token_ids array<int>, n_chunks int, round_trip boolean"


def _crc(text: str | None) -> int:
    return zlib.crc32((text or "").replace(SPACE, " ").encode("utf-8"))


def _lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(x) // 4 for x in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _rows(lists: pa.ListArray) -> Iterator[list[int]]:
    """The rows of a list column, without a Python object per value on the way."""
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[a:b].tolist()


def _encode_short(data: bytes, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(data) as encoder:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    texts = batch.column(1).to_pylist()
                    ids = encoder.encode_all(texts)
                    back = [encoder.decode(np.frombuffer(x, np.int32).tolist()) == (t or "").replace(SPACE, " ")
                            for x, t in zip(ids, texts, strict=True)] if check else [None] * len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), _lists(ids), pa.array([1] * len(ids), pa.int32()), pa.array(back, pa.bool_())], schema=_SHORT)

    return run


def _chunk_rows(docs: DataFrame, chunk: int, edge: int) -> DataFrame:
    """Chunks of long texts with the edges of their neighbours, spread over the cluster and written once."""
    size = F.length("text")
    keyed = docs.withColumn("key", F.monotonically_increasing_id()).withColumn("n_chunks", F.ceil(size / chunk).cast("int"))
    return materialise(keyed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).select(
        "key", "doc_id", "k", "n_chunks",
        F.substring("text", F.greatest(F.lit(0), F.col("k") * chunk - edge) + 1, F.lit(chunk + 2 * edge)).alias("piece"),
        F.when(F.col("k") == 0, F.crc32(F.encode(F.regexp_replace("text", SPACE, " "), "UTF-8"))).alias("text_crc32"),
    ).repartition("key", "k"), "piece-chunks")


def _bounds(encoder: Encoder, piece: str, k: int, chunks: int, chunk: int, edge: int) -> tuple[str, int, int, int]:
    """Marked text of a chunk row, the chunk's begin and stop in it, and its offset in the marked whole."""
    dummy = 1 if encoder.pieces.dummy else 0
    left = min(edge, k * chunk)
    text = (SPACE if dummy and k * chunk == left else "") + piece.replace(" ", SPACE)
    shift = dummy if k * chunk == left else 0
    begin = 0 if k == 0 else left + shift
    stop = len(text) if k == chunks - 1 else left + shift + chunk
    text = text[:left + shift + chunk + edge]
    return text, begin, stop, k * chunk - left + (dummy - shift)


def _transfer(data: bytes, chunk: int, edge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(data) as encoder:
            for batch in batches:
                rows = []
                for k, chunks, piece in zip(*(batch.column(c).to_pylist() for c in ("k", "n_chunks", "piece")), strict=True):
                    text, begin, stop, shift = _bounds(encoder, piece, k, chunks, chunk, edge)
                    flat = []
                    for entry, row in encoder.transfer(text, begin, stop, k == 0, k == chunks - 1).items():
                        for exit_, score in row.items():
                            flat += [float(x) for x in (*_moved(entry, shift), *_moved(exit_, shift), score)]
                    rows.append(np.array(flat, np.float64).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(rows, pa.binary())],
                                                 names=["key", "k", "matrix"])

    return run


def _moved(state: State, shift: int) -> State:
    return state if state[2] == -1 else (state[0] + shift, state[1] + shift, state[2])


_STATE = pa.schema([("key", pa.int64()), ("k", pa.int32()), ("states", pa.list_(pa.int64()))])


def _boundary_states(group: pa.Table) -> pa.Table:
    """Entry and exit state of every chunk of one text on its best path.

    A text has at most 2 GiB, so a group has a bounded number of small matrices. Products from the left give the
    best score of every state at every boundary; the best final state then names its predecessors.
    """
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("k", "key", "matrix")), strict=True))
    before: Matrix = {(0, 0, -1): {(0, 0, -1): 0.0}}
    steps = []
    for _, _, data in rows:
        matrix: Matrix = {}
        for x in np.frombuffer(data, np.float64).reshape(-1, 7).tolist():
            matrix.setdefault((int(x[0]), int(x[1]), int(x[2])), {})[(int(x[3]), int(x[4]), int(x[5]))] = x[6]
        steps.append((matrix, before))
        before = product(before, matrix)
    final = before[(0, 0, -1)]
    state, out = max(final, key=lambda s: final[s]), []
    for (k, key, _), (matrix, prior) in zip(reversed(rows), reversed(steps), strict=True):
        scores = prior[(0, 0, -1)]
        entry = max((s for s in scores if state in matrix.get(s, {})), key=lambda s: scores[s] + matrix[s][state])
        out.append((key, k, [*entry, *state]))
        state = entry
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _STATE, strict=True)], schema=_STATE)


def _trace(data: bytes, chunk: int, edge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(data) as encoder:
            for batch in batches:
                out = []
                for k, chunks, piece, states in zip(*(batch.column(c).to_pylist() for c in ("k", "n_chunks", "piece", "states")), strict=True):
                    text, begin, stop, shift = _bounds(encoder, piece, k, chunks, chunk, edge)
                    entry, exit_ = (tuple(states[i:i + 3]) for i in (0, 3))
                    out.append(encoder.trace(text, begin, stop, None if entry[2] == -1 else _moved(entry, -shift), _moved(exit_, -shift)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "k", "n_chunks", "text_crc32")), _lists(out)],
                                                 names=["key", "doc_id", "k", "n_chunks", "text_crc32", "ids"])

    return run


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, giant: int = GIANT, check: bool = False) -> DataFrame:
    """doc_id, token_ids, n_chunks and round_trip of each document.

    With ``check`` every row is decoded again, and round_trip tells whether its text came back; else it is null.
    The model is read on the driver and sent with the tasks; its size does not depend on the data.
    """
    data = Path(model).read_bytes()
    edge = 2 * Pieces(data).longest
    texts = small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > giant
    short = texts.filter(~long).mapInArrow(_encode_short(data, check), _ENCODED)
    chunks = _chunk_rows(texts.filter(long), chunk, edge)
    matrices = chunks.select("key", "k", "n_chunks", "piece").mapInArrow(
        _transfer(data, chunk, edge), "key long, k int, matrix binary")
    states = materialise(matrices.groupBy("key").applyInArrow(_boundary_states, "key long, k int, states array<long>"), "piece-states")
    traced = chunks.join(states, ["key", "k"]).mapInArrow(
        _trace(data, chunk, edge), "key long, doc_id long, k int, n_chunks int, text_crc32 long, ids array<int>")
    whole = traced.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"),
        F.max("text_crc32").alias("text_crc32"), F.max("n_chunks").alias("n_chunks")).select(
        "doc_id", F.flatten("parts.ids").alias("token_ids"), "n_chunks", "text_crc32")
    done = whole.mapInArrow(_check_giant(data), _ENCODED) if check else whole.select(
        "doc_id", "token_ids", "n_chunks", F.lit(None).cast("boolean").alias("round_trip"))
    return short.unionByName(done)


def _check_giant(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(data) as encoder:
            for batch in batches:
                back = [_crc(encoder.decode(x)) == crc for x, crc in zip(_rows(batch.column(1)), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(back, pa.bool_())], schema=_SHORT)

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of each row of token_ids."""
    data = Path(model).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(data) as encoder:
            for batch in batches:
                texts = [encoder.decode(x) for x in _rows(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def counted(encoded: DataFrame) -> DataFrame:
    """The rows of ``encode`` with n_tokens."""
    return encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "n_chunks", "round_trip")


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded again as a check."""
    return counted(encode(table(spark, sf_dir, "documents"), check=True))
