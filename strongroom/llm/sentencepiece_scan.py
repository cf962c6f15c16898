"""SentencePiece encoding as a max-plus scan, and decoding.

A text's pieces are the best path through the lattice of vocabulary matches.  Unigram models add up scores.  For BPE
models a path is allowed if each two neighbours are what the merges make of their joined strings; that holds for
exactly one path, the library's own result.  Either way a path is known from its last piece on, so a chunk of
text maps the piece over its left edge to the piece over its right edge: a max-plus matrix.

Texts of at most ``chunk`` code points are one chunk.  Longer ones are cut into chunks that become rows.  Each row yields
its matrix; runs of ``fan`` matrices are combined into one, these runs likewise, until a text has one matrix left, so no task
sees more than ``fan`` of a text's matrices.  Its best entry fixes the pieces over the outer edges, and level by level back down
each run fixes those between its own, the rows of a level independently.  Then every chunk is backtraced on its own.
No piece has a space mark after another character, so paths meet before each word; between such cuts a chunk is encoded
word by word: words are found in the bytes by numpy, told apart by Arrow, and the lattices of all new words go forward together.

Decoding joins the pieces' bytes.  Texts come back as they were, but for U+2581, which reads as a space.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.llm._common import checkpoint, whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 15
#: Matrices of one text that are combined in one task.
FAN = 64
MARK = "▁"
#: Words that are kept between batches, and neighbours whose joining is known, about.
_CACHE, _PAIRS = 1 << 18, 1 << 18
#: Bytes of text that are encoded together, about.
_BATCH = 1 << 20
#: Words of more bytes go through the lattice one by one; others so many together.
_WIDE, _TOGETHER = 48, 1 << 14
#: The place of an unknown character and of a text's start among pieces.
_UNKNOWN, _START = -1, -2

State = tuple[int, int]


class Numbers:
    """A map from numbers (not negative) to numbers, looked up and filled by whole arrays."""

    def __init__(self, room: int = 1 << 10):
        self._clear(room)

    def _clear(self, room: int) -> None:
        self.bits = max(4, (room - 1).bit_length())
        self.keys, self.values, self.size = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1
            found, own = self.keys[at[rest]], keys[rest]
            out[rest] = np.where(found == own, self.values[at[rest]], -1)
            rest = rest[(found != own) & (found >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in yet."""
        if 2 * (self.size + len(keys)) > 1 << self.bits:
            old = self.keys >= 0
            keys, values = np.concatenate((self.keys[old], keys)), np.concatenate((self.values[old], values))
            self._clear(3 * len(keys))
        self.size += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several keys for a slot one stays
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], at[~mine] + 1 & (1 << self.bits) - 1


class Pieces:
    """A model's vocabulary and the lattice over its pieces."""

    def __init__(self, strings: dict[str, int], scores: list[float], surface: list[bytes], byte_ids: list[int] | None, unknown_id: int, bpe: bool, prefix: bool):
        self.ids, self.scores, self.surface, self.byte_ids, self.unknown_id, self.bpe, self.prefix = strings, scores, surface, byte_ids, unknown_id, bpe, prefix
        self.names = {i: s for s, i in strings.items()}
        self.longest = max(map(len, strings), default=1)
        self.starts = {s[:k] for s in strings for k in range(1, len(s) + 1)}
        self.inside = {s[k : k + 2] for s in strings for k in range(len(s) - 1)}
        self.unknown_score = 0.0 if bpe else min((scores[i] for i in strings.values()), default=0.0) - 10.0
        if any(MARK in s.lstrip(MARK) for s in strings):
            raise ValueError("pieces with a space mark inside are not supported")
        line = "" if "\n" in self.starts else "\n"
        self.lines = bool(line)
        self.segments = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|{line}" if line else ""))
        #: Pieces by their characters from the last to the first: character -> (piece or -1, the next characters).
        self.endings: dict[str, tuple] = {}
        for piece, i in strings.items():
            node = self.endings
            for c in reversed(piece):
                entry = node.setdefault(c, [-1, {}])
                node = entry[1]
            entry[0] = i
        self.pairs: dict[int, dict[int, bool]] = {}
        self.pairs_known = 0
        self.together = _Together(self) if bpe else None
        self.words = _Words(self)
        self.surfaces = pa.array(surface, pa.binary())

    @classmethod
    def load(cls, path: str) -> Pieces:
        with open(path, "rb") as file:
            return cls.read(file.read())

    @classmethod
    def read(cls, content: bytes) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        return cls.parse(sentencepiece_model_pb2.ModelProto.FromString(content))

    @classmethod
    def parse(cls, model) -> Pieces:
        norm, train = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.model_type not in (1, 2):
            raise ValueError("only BPE and unigram models without a normaliser are supported")
        strings, surface, scores, byte_ids = {}, [], [], [-1] * 256
        unknown = 0
        for i, p in enumerate(model.pieces):
            scores.append(p.score)
            surface.append(p.piece.replace(MARK, " ").encode() if p.type == 1 else b"")
            if p.type == 1:
                strings[p.piece] = i
            elif p.type == 6:
                byte_ids[int(p.piece[1:-1], 16)] = i
                surface[-1] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == 2:
                unknown = i
                surface[-1] = " ⁇ ".encode()
            elif p.type == 4:
                raise ValueError("user-defined pieces are not supported")
        return cls(strings, scores, surface, byte_ids if min(byte_ids) >= 0 else None, unknown, train.model_type == 2, norm.add_dummy_prefix)

    def normal(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    # --- neighbours

    def joined(self, a: int, b: int) -> bool:
        """Whether BPE leaves the pieces a and b apart, each whole; a may be the start or an unknown character."""
        if not self.bpe or b == _UNKNOWN:
            return True
        if self.pairs_known > _PAIRS:
            self.pairs.clear()
            self.pairs_known = 0
        known = self.pairs.setdefault(a, {})  # the start and unknown characters have no name
        if b not in known:
            self.pairs_known += 1
            known[b] = self._merge(self.names.get(a, ""), self.names[b])
        return known[b]

    def _merge(self, a: str, b: str) -> bool:
        if a and a[-1] + b[0] not in self.inside:  # no piece lies over the edge
            return self.joined(_START, self.ids[a]) and self.joined(_START, self.ids[b])
        parts, edge = [*a, *b], len(a)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return parts == ([a, b] if a else [b])
            begin = sum(map(len, parts[:at]))
            if begin < edge < begin + len(parts[at]) + len(parts[at + 1]):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    # --- the lattice

    def matches(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """(end, piece) of the pieces that begin here, the shortest first; an unknown character is a piece."""
        found, starts = False, self.starts
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            part = text[at:end]
            if part not in starts:
                break
            if (i := self.ids.get(part)) is not None:
                yield end, i
                found = True
        if not found or text[at] not in self.ids:
            yield at + 1, _UNKNOWN

    def piece(self, text: str, state: State) -> int:
        return _START if state[0] == state[1] else self.ids.get(text[state[0] : state[1]], _UNKNOWN)

    def score(self, piece: int) -> float:
        return 0.0 if self.bpe or piece == _START else self.unknown_score if piece == _UNKNOWN else self.scores[piece]

    def forward(self, text: str, state: State, stop: int) -> dict[int, tuple[float, int, int]]:
        """Best (score, start, piece) of each end that a path from the state reaches by pieces that begin before stop."""
        best = {state[1]: (0.0, state[0], self.piece(text, state))}
        for at in range(state[1], stop):
            if (here := best.get(at)) is None:
                continue
            total, _, last = here
            for end, piece in self.matches(text, at):
                new = total + self.score(piece)
                if self.joined(last, piece) and ((old := best.get(end)) is None or new > old[0]):
                    best[end] = (new, at, piece)
        return best

    def back(self, text: str, best: dict[int, tuple[float, int, int]], state: State, goal: State) -> list[int]:
        """The pieces' ids after the state up to the goal, a piece that begins where best has reached."""
        found, (start, end) = [], goal
        piece = self.piece(text, goal)
        while end > state[1]:
            found.append(self.id_of(piece, text[start:end]))
            end = start
            if end > state[1]:
                _, start, piece = best[end]
        return list(chain.from_iterable(reversed(found)))

    def id_of(self, piece: int, text: str) -> tuple[int, ...]:
        if piece >= 0:
            return (piece,)
        return tuple(self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")) if self.byte_ids else (self.unknown_id,)

    def word(self, text: str) -> tuple[tuple[int, ...], float]:
        """The ids of a text between two cuts, and their score."""
        if self.bpe:
            return next(self.allowed([text])), 0.0
        best = self.forward(text, (0, 0), len(text))
        total, start, _ = best[len(text)]
        return tuple(self.back(text, best, (0, 0), (start, len(text)))), total

    def allowed(self, words: list[str]) -> Iterator[tuple[int, ...]]:
        """The BPE ids of each of the words, which are sorted.

        From a cut, each end has one allowed last piece, whatever follows; so a word takes over what it shares with the one before.
        """
        endings = self.endings
        last, begin, before = [_START], [0], ""
        for word in words:
            n, k, most = len(word), 0, min(len(word), len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del last[k + 1 :], begin[k + 1 :]
            for end in range(k, n):
                node, at, found = endings, end, []
                while at >= 0 and (entry := node.get(word[at])) is not None:
                    i, node = entry
                    if i >= 0:
                        found.append((at, i))
                    at -= 1
                for at, i in reversed(found):
                    if self.joined(last[at], i):
                        last.append(i)
                        begin.append(at)
                        break
                else:
                    last.append(_UNKNOWN)
                    begin.append(end)
            ids, end = [], n
            while end:
                start, piece = begin[end], last[end]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids.extend(reversed(self.id_of(piece, word[start:end])))
                end = start
            ids.reverse()
            before = word
            yield tuple(ids)

    # --- texts and chunks

    def encode(self, normal: str) -> list[int]:
        return self.encode_texts(pa.array([normal]), False)[1].tolist()

    def encode_texts(self, texts: pa.Array, prefix: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids in a row.  The texts are strings without nulls, of a few megabytes together."""
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            texts = pc.replace_substring(texts, MARK, " ")
        if prefix and self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        # Words begin where marks follow another character, and around line ends.
        space = data == 32
        begins = np.zeros(len(data), bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        if self.lines:
            line = data == 10
            begins |= line
            begins[1:] |= line[:-1]
        at = np.flatnonzero(begins)
        cut = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        first, count, flat = self.words.find(cut.dictionary)
        codes = cut.indices.to_numpy()
        each = count[codes]
        upto = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.repeat(first[codes] - upto[:-1], each) + np.arange(upto[-1])]
        return np.diff(upto[np.searchsorted(at, bounds)]), ids

    def states(self, text: str, edge: int) -> list[State]:
        """The pieces that may lie over the character before the edge; the start of a text is one of its own."""
        if edge == 0:
            return [(0, 0)]
        return [(s, e) for s in range(max(0, edge - self.longest), edge) for e, _ in self.matches(text, s) if e >= edge]

    def cuts(self, text: str, left: int, right: int) -> tuple[int, int] | None:
        """The first cut that no state at the left edge passes, and the last one before the right edge."""
        found = [m.end() for m in re.finditer(f"[^{MARK}](?={MARK})", text[: right])]
        found = [c for c in found if left + self.longest <= c < right]
        return (found[0], found[-1]) if found else None

    def matrix(self, text: str, left: int, right: int) -> np.ndarray:
        """The best score from each state at the left edge to each at the right edge; -inf: no path."""
        rows, columns = self.states(text, left), self.states(text, right)
        out = np.full((len(rows), len(columns)), -np.inf)

        def ends(best) -> np.ndarray:
            line = np.full(len(columns), -np.inf)
            for j, (s, e) in enumerate(columns):
                if s in best and self.joined(best[s][2], p := self.piece(text, (s, e))):
                    line[j] = best[s][0] + self.score(p)
            return line

        if cut := self.cuts(text, left, right):
            tail = ends(self.forward(text, (cut[1], cut[1]), right))
            if not self.bpe:
                tail = tail + sum(self.word(w)[1] for w in self.segments.findall(text[cut[0] : cut[1]]))
            for i, row in enumerate(rows):
                best = self.forward(text, row, cut[0])
                if cut[0] in best:
                    out[i] = best[cut[0]][0] + tail
        else:
            for i, row in enumerate(rows):
                if row[1] >= right:  # a piece over the whole chunk
                    out[i, columns.index(row)] = 0.0
                else:
                    out[i] = ends(self.forward(text, row, right))
        return out

    def backtrace(self, text: str, left: int, right: int, row: int, column: int) -> list[int]:
        """The ids of the pieces that begin between the edges, on the best path from state to state."""
        head, middle, tail = self.parts(text, left, right, row, column)
        return head + self.encode(middle) + tail

    def parts(self, text: str, left: int, right: int, row: int, column: int) -> tuple[list[int], str, list[int]]:
        """The ids of a backtrace up to its first cut, the text between the cuts, and the ids after the last one."""
        state, goal = self.states(text, left)[row], self.states(text, right)[column]
        if state == goal:
            return [], "", []
        if cut := self.cuts(text, left, right):
            best = self.forward(text, state, cut[0])
            head = self.back(text, best, state, (best[cut[0]][1], cut[0])) if cut[0] > state[1] else []
            tail = (cut[1], cut[1])
            return head, text[cut[0] : cut[1]], self.back(text, self.forward(text, tail, right), tail, goal)
        return self.back(text, self.forward(text, state, right), state, goal), "", []

    def decode(self, ids) -> str:
        return self.decode_texts(np.array([len(ids)]), np.asarray(ids, np.int64))[0]

    def decode_texts(self, counts: np.ndarray, ids: np.ndarray) -> list[str]:
        """The text of each run of so many ids."""
        joined = self.surfaces.take(pa.array(ids, pa.int64())).cast(pa.large_binary())
        _, offsets, data = joined.buffers()
        at = np.frombuffer(offsets, np.int64)[joined.offset :][np.concatenate(([0], np.cumsum(counts)))].tolist()
        texts = [data[s:e].to_pybytes().decode("utf-8", "replace") if s < e else "" for s, e in zip(at, at[1:])]
        return [t[1:] if t[:1] == " " else t for t in texts] if self.prefix else texts


class _Together:
    """The BPE lattices of many words, all taken forward by one character at a time."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, Numbers()
        chars = sorted({c for s in pieces.ids for c in s})
        #: The number of each character; 0 is one of no piece.
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.chars, keys, ends, nodes = len(chars) + 1, [], [-1], [(0, pieces.endings)]
        for node, below in nodes:
            for c, (piece, further) in below.items():
                keys.append(node * self.chars + int(self.number[ord(c)]))
                ends.append(piece)
                nodes.append((len(ends) - 1, further))
        #: From a node of ``endings`` and a character to the next node, and the nodes' pieces.
        self.next = Numbers(4 * len(keys))
        self.next.put(np.array(keys, np.int64), np.arange(1, len(ends), dtype=np.int32))
        self.ends = np.array(ends, np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = len(self.pieces.scores)
        keys = (a.astype(np.int64) + 2) * size + b
        found = self.known.get(keys)
        missing = found < 0
        if missing.any():
            new, names = np.unique(keys[missing]), self.pieces.names
            known = np.array([self.pieces._merge(names.get(k // size - 2, ""), names[k % size]) for k in new.tolist()], np.int32)
            found[missing] = known[np.searchsorted(new, keys[missing])]
            if self.known.size + len(new) > _PAIRS:
                self.known = Numbers()
            self.known.put(new, known)
        return found > 0

    def encode(self, points: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many pieces each word has, and all pieces in a row; points has the words' characters, n their lengths.

        The words are sorted, so what a word begins like the one before is looked at once.
        """
        wide, all_words = int(n.max()), np.arange(len(n))
        at, chars = np.cumsum(n) - n, np.full((wide, len(n)), -1, np.int32)
        word = np.repeat(all_words, n)
        chars[np.arange(len(points)) - at[word], word] = self.number[points]
        last, begin = np.full((wide + 1, len(n)), _UNKNOWN, np.int32), np.zeros((wide + 1, len(n)), np.int8)
        last[0] = _START
        new = np.zeros(len(n), bool)  # whether the word differs from the one before up to here
        new[0] = True
        there = all_words
        for end in range(1, wide + 1):
            there = there[n[there] >= end]
            new[1:] |= chars[end - 1, 1:] != chars[end - 1, :-1]
            own = new[there]
            live = there[own]
            begin[end, live] = end - 1
            node = np.zeros(len(live), np.int64)
            for start in range(end - 1, max(-1, end - 1 - self.pieces.longest), -1):
                node = self.next.get(node * self.chars + chars[start, live])
                on = node >= 0
                live, node = live[on], node[on]
                piece = self.ends[node]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    hit = hit[self.joined(last[start, live[hit]], piece[hit])]
                    last[end, live[hit]], begin[end, live[hit]] = piece[hit], start
                    on = np.ones(len(live), bool)
                    on[hit] = False
                    live, node = live[on], node[on]
                if not len(live):
                    break
            from_word = np.maximum.accumulate(np.where(own, there, 0))
            last[end, there], begin[end, there] = last[end, from_word], begin[end, from_word]
        # Back from the ends: one piece of each word a step.
        live, end, steps = all_words, n.copy(), []
        while len(live):
            steps.append((live, last[end[live], live]))
            end[live] = begin[end[live], live]
            live = live[end[live] > 0]
        count = np.bincount(np.concatenate([w for w, _ in steps]), minlength=len(n))
        upto, flat = np.cumsum(count), np.zeros(count.sum(), np.int32)
        for k, (w, piece) in enumerate(steps):
            flat[upto[w] - 1 - k] = piece
        return count, flat


class _Words:
    """Ids of words that were met.  Words of up to _WIDE bytes are known by two hashes of 64 bits."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._clear()

    def _clear(self) -> None:
        self.place, self.proof = Numbers(2 * _CACHE), np.zeros(0, np.uint64)
        self.first, self.count, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words, which are distinct: the first place of each in a row of ids, the number of its ids, and that row."""
        _, offsets, data = words.buffers()
        bounds = np.frombuffer(offsets, np.int32)[: len(words) + 1].astype(np.int64)
        data, n = np.frombuffer(data, np.uint8), np.diff(bounds)
        if len(self.first) > _CACHE:
            self._clear()
        narrow = np.flatnonzero(n <= _WIDE) if self.pieces.together else np.zeros(0, np.int64)
        key, proof = _hashes(data, bounds[narrow], n[narrow])
        place = self.place.get(key)
        place[place >= 0] = np.where(self.proof[place[place >= 0]] == proof[place >= 0], place[place >= 0], -1)
        new = np.flatnonzero(place < 0)
        new = new[np.unique(key[new], return_index=True)[1]] if len(new) else new
        new = new[self.place.get(key[new]) < 0]
        if len(new):
            kept, count, flat = self._learn(words.take(pa.array(narrow[new])))
            new = new[kept]
            self.place.put(key[new], np.arange(len(self.first), len(self.first) + len(new), dtype=np.int32))
            self.first = np.concatenate((self.first, (len(self.flat) + np.cumsum(count) - count).astype(np.int32)))
            self.count, self.flat = np.concatenate((self.count, count.astype(np.int32))), np.concatenate((self.flat, flat))
            self.proof = np.concatenate((self.proof, proof[new]))
            place[new] = self.place.get(key[new])
        first, count, flat = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64), [self.flat]
        known = narrow[place >= 0]
        first[known], count[known] = self.first[place[place >= 0]], self.count[place[place >= 0]]
        # Wide words, those with unknown characters, and what has another's hash, one by one.
        rest = np.flatnonzero(first < 0)
        at = len(self.flat)
        for i, ids in zip(rest.tolist(), self._each([words[i].as_py() for i in rest.tolist()]), strict=True):
            first[i], count[i] = at, len(ids)
            at += len(ids)
            flat.append(np.array(ids, np.int32))
        return first, count, np.concatenate(flat) if len(rest) else self.flat

    def _each(self, words: list[bytes]) -> list[tuple[int, ...]]:
        p, texts = self.pieces, [w.decode("utf-8", "surrogatepass").replace(" ", MARK) for w in words]
        if not p.bpe:
            return [p.word(t)[0] for t in texts]
        order = sorted(range(len(texts)), key=texts.__getitem__)
        found = dict(zip(order, p.allowed([texts[i] for i in order]), strict=True))
        return [found[i] for i in range(len(texts))]

    def _learn(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words have known characters only, in some order; the numbers of their pieces, and these in a row."""
        order = pc.sort_indices(words).to_numpy()
        kept, counts, flats = [], [], []
        for k in range(0, len(order), _TOGETHER):
            part = order[k : k + _TOGETHER]
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], words.take(pa.array(part))), b"")[0].as_py()
            points = np.frombuffer(text.decode("utf-8", "surrogatepass").replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32)
            n = pc.utf8_length(words.take(pa.array(part)).cast(pa.string())).to_numpy().astype(np.int64)
            count, ids = self.pieces.together.encode(points, n)
            rare = np.bincount(np.repeat(np.arange(len(n)), count)[ids < 0], minlength=len(n)) > 0
            kept.append(part[~rare])
            counts.append(count[~rare])
            flats.append(ids[~np.repeat(rare, count)])
        return np.concatenate(kept), np.concatenate(counts), np.concatenate(flats)


def _hashes(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of n bytes, byte by byte for all runs; the first has 63 bits."""
    a, b = n.astype(np.uint64), n.astype(np.uint64)
    live = np.arange(len(n))
    for k in range(int(n.max(initial=0))):
        live = live[n[live] > k]
        byte = data[at[live] + k].astype(np.uint64)
        a[live] = _mixed((a[live] ^ byte) * np.uint64(0x9E3779B97F4A7C15))
        b[live] = _mixed((b[live] + byte) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (a >> np.uint64(1)).astype(np.int64), b


def _mixed(x: np.ndarray) -> np.ndarray:
    return x ^ x >> np.uint64(29)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the matrix of two neighbouring chunks as one."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=-np.inf)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    return functools.reduce(combine, matrices)


def between(matrices: list[np.ndarray], row: int, column: int) -> list[tuple[int, int]]:
    """The states at both edges of each matrix on the best path from the row of the first to the column of the last."""
    ahead = [matrices[0][row]]
    for m in matrices[1:]:
        ahead.append((ahead[-1][:, None] + m).max(axis=0, initial=-np.inf))
    out = []
    for k in range(len(matrices) - 1, 0, -1):
        through = int((ahead[k - 1] + matrices[k][:, column]).argmax())
        out.append((through, column))
        column = through
    return [*reversed([*out, (row, column)])]


def edges(matrices: list[np.ndarray], fan: int = FAN) -> list[tuple[int, int]]:
    """The states at both edges of each chunk on the best path through all: up a tree of products, and down again."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        levels.append([product(levels[-1][k : k + fan]) for k in range(0, len(levels[-1]), fan)])
    found = [(0, int(levels[-1][0][0].argmax()))]
    for level in reversed(levels[:-1]):
        found = [x for k, (row, column) in enumerate(found) for x in between(level[k * fan : (k + 1) * fan], row, column)]
    return found


def chunks(normal: str, size: int, context: int) -> Iterator[tuple[str, int, int]]:
    """(text with context, its left edge, its right edge) of each chunk."""
    for b in range(0, len(normal), size):
        lo, right = max(0, b - context), min(len(normal), b + size)
        yield normal[lo : right + context], b - lo, right - lo


@functools.lru_cache(maxsize=2)
def _loaded(model: str | bytes) -> Pieces:
    return Pieces.load(model) if isinstance(model, str) else Pieces.read(model)


# --- on Spark

#: Chunks whose places (about 100 bytes each) are broadcast at most.
BROADCAST_CHUNKS = 100_000
#: Bytes of a model file that go to tasks with their code, at most.
MOST_BYTES = 1 << 26


def shipped(model: str) -> bytes:
    """The model file's bytes, which the tasks get with their code, so that only the driver needs the file."""
    with open(model, "rb") as file:
        content = file.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError(f"{model} has over {MOST_BYTES} bytes")
    return content


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of about _BATCH bytes together."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(upto // _BATCH)) + 1).tolist(), len(texts)] if len(texts) else []
    yield from (texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def _lists(counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))


def encode_column(model: str):
    content = shipped(model)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        p, out = _loaded(content), []
        for part in _slices(pa.array(texts, pa.string())):
            counts, ids = p.encode_texts(part)
            out += np.split(ids, np.cumsum(counts)[:-1])
        return pd.Series(out, index=texts.index, dtype=object)

    # Marked so that the optimiser doesn't copy it into each use of its result.
    return encode.asNondeterministic()


def decode_column(model: str):
    content = shipped(model)

    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        p = _loaded(content)
        return pd.Series([None if x is None else p.decode(x) for x in ids], index=ids.index, dtype=object)

    return decode


def _cut_up(model: bytes, size: int):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _loaded(model)
        for batch in batches:
            for sha, text in zip(batch.column("sha"), batch.column("text"), strict=True):
                parts = list(chunks(p.normal(text.as_py()), size, p.longest))
                yield pa.RecordBatch.from_pydict({"sha": [sha.as_py()] * len(parts), "k": list(range(len(parts))), "part": [x for x, _, _ in parts], "left_edge": [x for _, x, _ in parts], "right_edge": [x for _, _, x in parts]})

    return cut_up


def _matrices(model: bytes):
    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _loaded(model)
        for batch in batches:
            found = [p.matrix(r["part"].as_py(), r["left_edge"].as_py(), r["right_edge"].as_py()) for r in _rows(batch)]
            cells = pa.array([m.ravel() for m in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("sha"), batch.column("k"), pa.array([m.shape[0] for m in found], pa.int64()), cells], ["sha", "k", "row_count", "cells"])

    return matrices


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Scalar]]:
    return (dict(zip(batch.schema.names, x, strict=True)) for x in zip(*batch.columns, strict=True))


def _of_group(group: pd.DataFrame) -> list[np.ndarray]:
    return [np.array(c).reshape(n, -1) for n, c in zip(group["row_count"], group["cells"], strict=True)]


def _product(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("k")
    m = product(_of_group(group))
    return pd.DataFrame({"sha": group["sha"].iloc[:1].to_numpy(), "k": group["run"].iloc[:1].to_numpy(), "row_count": [m.shape[0]], "cells": [m.ravel().tolist()]})


def _between(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("k")
    found = between(_of_group(group), int(group["row"].iloc[0]), int(group["column"].iloc[0]))
    return pd.DataFrame({"sha": group["sha"].to_numpy(), "k": group["k"].to_numpy(), "row": [r for r, _ in found], "column": [c for _, c in found]})


def _best(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in group:
        best = [int(np.argmax(c[: len(c) // n])) for n, c in zip(batch.column("row_count").to_pylist(), batch.column("cells").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("sha"), batch.column("k"), pa.array([0] * len(best), pa.int64()), pa.array(best, pa.int64())], ["sha", "k", "row", "column"])


def _backtraces(model: bytes):
    def backtraces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _loaded(model)
        for batch in batches:
            done = 0
            for texts in _slices(batch.column("part")):
                part = batch.slice(done, len(texts))
                done += len(texts)
                found = [p.parts(*(r[c].as_py() for c in ("part", "left_edge", "right_edge", "row", "column"))) for r in _rows(part)]
                counts, ids = p.encode_texts(pa.array([middle for _, middle, _ in found], pa.string()), False)
                whole = [np.concatenate((np.array(head, np.int32), own, np.array(tail, np.int32))) for (head, _, tail), own in zip(found, np.split(ids, np.cumsum(counts)[:-1]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("sha"), part.column("k"), pa.array(whole, pa.list_(pa.int32()))], ["sha", "k", "part_ids"])
                pa.default_memory_pool().release_unused()

    return backtraces


def encode_long(texts: DataFrame, model: str = MODEL, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``sha, ids`` of the distinct texts of ``texts(sha, text)``, chunk by chunk.

    Texts go through one shuffle, as chunks.  The edges' states are broadcast if a count finds few enough of them, else joined.
    """
    content, tasks = shipped(model), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = texts.select("sha", "text").mapInArrow(_cut_up(content, chunk), "sha string, k bigint, part string, left_edge bigint, right_edge bigint")
    parts = checkpoint(parts.dropDuplicates(["sha", "k"]))
    cells, places = "sha string, k bigint, row_count bigint, cells array<double>", "sha string, k bigint, row bigint, column bigint"
    in_runs = lambda level: level.withColumn("run", F.floor(F.col("k") / fan).cast("long")).repartition(tasks, "sha", "run")
    levels = [checkpoint(parts.mapInArrow(_matrices(content), cells))]
    size = levels[0].agg(F.max("k").alias("most"), F.count(F.lit(1)).alias("n")).first()
    most = size["most"] or 0
    while most > 0:
        levels.append(checkpoint(in_runs(levels[-1]).groupBy("sha", "run").applyInPandas(_product, cells)))
        most //= fan
    found = levels[-1].mapInArrow(_best, places)
    for level in reversed(levels[:-1]):
        own = in_runs(level).join(found.withColumnRenamed("k", "run"), ["sha", "run"])
        found = own.groupBy("sha", "run").applyInPandas(_between, places)
    found = checkpoint(found)
    traced = parts.join(F.broadcast(found) if size["n"] <= BROADCAST_CHUNKS else found, ["sha", "k"]).mapInArrow(_backtraces(content), "sha string, k bigint, part_ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("k", "part_ids")))
    return traced.groupBy("sha").agg(F.flatten(F.transform(ordered, lambda x: x["part_ids"])).alias("ids"))


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, ids`` of each row of docs(doc_id, text).

    A null or empty text has no ids; repeated rows have equal ids; other columns are ignored, an empty table gives an empty result.
    A text of over ``chunk`` code points is scanned in chunks, with the same ids.  Of paths with equal scores (unigram models) one is taken.
    """
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    long = F.char_length("text") > chunk
    short = rows.where(~long).select("doc_id", encode_column(model)(F.col("text")).alias("ids"))
    return short.unionByName(_scanned(rows.where(long), model, chunk))


def _scanned(rows: DataFrame, model: str, chunk: int) -> DataFrame:
    keyed = rows.select("doc_id", F.sha2("text", 256).alias("sha"), "text")
    return keyed.select("doc_id", "sha").join(encode_long(keyed.select("sha", "text"), model, chunk), "sha").select("doc_id", "ids")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds ``decoded`` to a table with ``ids``; null ids give null."""
    return encoded.withColumn("decoded", decode_column(model)(F.col("ids")))


def _both(model: bytes):
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _loaded(model)
        for batch in batches:
            done = 0
            for part in _slices(batch.column("text")):
                counts, ids = p.encode_texts(part)
                back = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in p.decode_texts(counts, ids)]
                own = batch.column("doc_id").slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([own, pa.array(counts, pa.int64()), _lists(counts, ids), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_sha256"])
                pa.default_memory_pool().release_unused()

    return both


def encoded_and_back(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of each row; texts of one chunk are encoded and decoded in one go."""
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    long = F.char_length("text") > chunk
    id_type = rows.schema["doc_id"].dataType.simpleString()
    short = rows.where(~long).mapInArrow(_both(shipped(model)), f"doc_id {id_type}, n_tokens bigint, ids array<int>, decoded_sha256 string")
    back = decode(_scanned(rows.where(long), model, chunk), model)
    return short.unionByName(back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")))
