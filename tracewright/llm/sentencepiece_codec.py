"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads a word once.  At each position
its output links name every piece that ends there, longest first, and each of
these relaxes the best hypothesis for that position; the segmentation is read
off backwards.

* Unigram models: a hypothesis is worth the sum of its piece scores (Viterbi).
* BPE models: scores are merge priorities, and the largest sum does not give the
  tokenizer's ids.  There, a piece may extend a hypothesis only if merging the
  two pieces' characters by priority gives exactly these two pieces; any other
  hypothesis is worth minus infinity.  One hypothesis at most stays finite at each
  position, and it is what merging the whole text gives; so the links beyond the
  one that gave it need not be followed.  The pass over the automaton is the same.

Words are segmented apart wherever no piece spans a word's end, which is
checked when the vocabulary is read; the distinct short words of a batch are
read side by side, as arrays.  Which pieces may meet is remembered in a table
of fixed size.  Characters without a piece become byte pieces, or, a whole run of
them, one unknown piece where the model has no bytes.  User-defined symbols are
matched first, the longest at each place, and kept whole.  Unused pieces are
skipped by unigram models; BPE models merge them and split them again, by the
last merge that makes them.  A model's character map (the longest match at each
place is replaced) is applied first.

Not supported, and refused: word and character models, marks behind words.

Defined results: a null text gives null ids, an empty text an empty list; null
ids decode to null; an empty table gives an empty result; repeated rows repeat
their result.  Of equally good hypotheses the one found first stays, which ends
in the longer piece.  Texts are never shortened.  Decoding gives the text back,
but for characters that the model itself cannot tell apart (its space mark
becomes a space; unknown pieces become U+2047 between spaces) or that its
character map replaces.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Piece kinds in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Longer words are segmented one by one, shorter ones side by side, so many at a time.
SIDE_BY_SIDE, AT_ONCE = 64, 1 << 14
#: Slots (a power of two) of the table that remembers which pieces may meet.
SLOTS = 1 << 19
#: An odd constant near 2^64 over the golden ratio, to spread keys over a table.
SPREAD = 0x9E3779B97F4A7C15
#: What a position holds: no hypothesis; a start or a character without a piece; else a piece.
NONE, BARE = -2, -1


def fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Vocabulary:
    """What a model file holds; small enough to ship to every worker."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    algorithm: int
    dummy_prefix: bool = True
    squeeze: bool = False
    charsmap: bytes = b""
    unknown_text: str = " ⁇ "

    def codec(self) -> "Codec":
        """The codec of this vocabulary; a worker keeps the last one from task to task."""
        key = hashlib.sha256(repr((self.pieces, self.scores, self.kinds, self.algorithm, self.dummy_prefix, self.squeeze, self.charsmap, self.unknown_text)).encode()).digest()
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(self)
        return _CODECS[key]


_CODECS: dict[bytes, "Codec"] = {}


def read_model(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return parse_model(f.read())


def parse_model(data: bytes) -> Vocabulary:
    pieces, scores, kinds = [], [], []
    algorithm, dummy, squeeze, suffix, charsmap, unknown_text = UNIGRAM, True, True, False, b"", " ⁇ "
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append(own[1].decode())
            scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
            kinds.append(own.get(3, NORMAL))
        elif number == 2:
            own = dict(fields(value))
            algorithm, suffix = own.get(3, UNIGRAM), bool(own.get(24, 0))
            unknown_text = own[44].decode() if 44 in own else unknown_text
        elif number == 3:
            own = dict(fields(value))
            charsmap, dummy, squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
    if algorithm not in (UNIGRAM, BPE) or suffix:
        raise ValueError("only unigram and BPE models without suffix marks are supported")
    return Vocabulary(pieces, scores, kinds, algorithm, dummy, squeeze, charsmap, unknown_text)


class CharacterMap:
    """A model's map of character strings to what replaces them.

    The file holds the size of a double-array trie over UTF-8, its 32-bit units,
    and the replacements, each up to a zero byte.  A unit holds a label (its low
    byte), whether a value is beside it (bit 8), and where its children lie.
    All keys are read out once, a level of the trie at a time.
    """

    def __init__(self, data: bytes):
        size = int.from_bytes(data[:4], "little")
        units, texts = np.frombuffer(data[4 : 4 + size], "<u4").astype(np.int64), data[4 + size :]
        children = lambda at: at ^ ((units[at] >> 10) << ((units[at] & 512) >> 6))
        self.replaced: dict[str, str] = {}
        base, keys = children(np.zeros(1, np.int64)), [b""]
        while len(base):
            parent, label = np.divmod(np.arange(1, 256 * len(base) + 1, dtype=np.int64) - 1, 256)
            at = base[parent] ^ label
            ok = (label > 0) & (at < len(units))
            ok[ok] = (units[at[ok]] & 0x800000FF) == label[ok]
            at, keys = at[ok], [keys[p] + bytes([c]) for p, c in zip(parent[ok].tolist(), label[ok].tolist())]
            base = children(at)
            for i in np.flatnonzero(units[at] >> 8 & 1).tolist():
                start = int(units[base[i]] & 0x7FFFFFFF)
                try:
                    self.replaced[keys[i].decode()] = texts[start : texts.index(b"\0", start)].decode("utf-8", "replace")
                except UnicodeDecodeError:
                    pass  # not at a character's end
        alone = {k for k in self.replaced if len(k) == 1}
        longer = [k for k in self.replaced if len(k) > 1]
        self.longest = max(map(len, self.replaced), default=0)
        group = lambda x: "[" + "".join(map(re.escape, sorted(set(x)))) + "]" if x else "(?!)"
        #: Where a key may start; a key of more characters goes on with one of its second characters.
        self.start = re.compile(f"{group([k[0] for k in longer])}(?={group([k[1] for k in longer])})|{group(alone)}")

    def pieces(self, text: str):
        """``text`` in parts, each as it is to be read."""
        done = 0
        while m := self.start.search(text, done):
            at = m.start()
            key = next((text[at : at + n] for n in range(min(self.longest, len(text) - at), 0, -1) if text[at : at + n] in self.replaced), None)
            if key is None:
                yield text[done : at + 1]
                done = at + 1
            else:
                yield text[done:at]
                yield self.replaced[key]
                done = at + len(key)
        yield text[done:]

    def apply(self, text: str) -> str:
        return "".join(self.pieces(text))


def slots(keys: np.ndarray, size: int) -> np.ndarray:
    """Where each key belongs in a table of ``size`` slots, a power of two."""
    return (keys.astype(np.uint64) * np.uint64(SPREAD) >> np.uint64(65 - size.bit_length())).astype(np.int64)


class Automaton:
    """Aho-Corasick over the pieces, as arrays: a step moves many readers by a character each.

    ``out`` names the longest piece that ends in a state (as that piece's own
    state, 0 for none), ``link`` the next shorter one.
    """

    def __init__(self, pieces: dict[str, int]):
        edges: dict[tuple[int, str], int] = {}
        parent, depth, piece = [(0, "")], [0], [-1]
        for text, i in pieces.items():
            state = 0
            for c in text:
                if (state, c) not in edges:
                    edges[state, c] = len(depth)
                    parent.append((state, c))
                    piece.append(-1)
                    depth.append(depth[state] + 1)
                state = edges[state, c]
            piece[state] = i
        n = len(depth)
        fail, out, link = [0] * n, [0] * n, [0] * n
        for state in sorted(range(1, n), key=depth.__getitem__):
            above, c = parent[state]
            if above:
                at = fail[above]
                while at and (at, c) not in edges:
                    at = fail[at]
                fail[state] = edges.get((at, c), 0)
            link[state] = out[fail[state]]
            out[state] = state if piece[state] >= 0 else link[state]
        self.single = edges, fail, out, link, piece, depth
        self.fail, self.out, self.link, self.piece, self.depth = (np.array(x, np.int32) for x in (fail, out, link, piece, depth))
        letters = sorted({c for _, c in edges})
        self.alphabet = np.zeros(0x110000, np.int32)
        self.alphabet[[ord(c) for c in letters]] = range(1, len(letters) + 1)
        self.width = len(letters) + 1
        size = 1 << (4 * len(edges) + 4).bit_length()
        self.keys, self.to = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        keys = np.array([s * self.width + self.alphabet[ord(c)] for s, c in edges], np.int64)
        for key, slot, to in zip(keys.tolist(), slots(keys, size).tolist(), edges.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            self.keys[slot], self.to[slot] = key, to

    def goto(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each state by a letter, 0 where there is none."""
        key = state.astype(np.int64) * self.width + letter
        slot = slots(key, len(self.keys))
        there = self.keys[slot]
        found = np.where(there == key, self.to[slot], 0)
        left = np.flatnonzero((there != key) & (there >= 0))
        while left.size:
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[left]]
            same = there == key[left]
            found[left[same]] = self.to[slot[left[same]]]
            left = left[~same & (there >= 0)]
        return found

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next state: by goto where there is one, else on from the failure link."""
        new = self.goto(state, letter)
        left = np.flatnonzero((new == 0) & (state > 0))
        at = state[left]
        while left.size:
            at = self.fail[at]
            new[left] = found = self.goto(at, letter[left])
            more = (found == 0) & (at > 0)
            left, at = left[more], at[more]
        return new


class Codec:
    def __init__(self, v: Vocabulary):
        self.v = v
        usable = (NORMAL, UNUSED) if v.algorithm == BPE else (NORMAL,)
        self.ids = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k in usable}
        self.unused = np.array([k == UNUSED for k in v.kinds] + [False]) if v.algorithm == BPE else np.zeros(len(v.kinds) + 1, bool)
        self.own = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == USER and p}
        self.symbols = re.compile("(" + "|".join(map(re.escape, sorted(self.own, key=len, reverse=True))) + ")") if self.own else None
        self.map = CharacterMap(v.charsmap) if v.charsmap else None
        normal = [s for s, k in zip(v.scores, v.kinds) if k == NORMAL]
        self.scores = np.array(v.scores)
        if v.algorithm == UNIGRAM:  # symbols are pieces with a score that no others reach
            best = max([np.finfo(np.float32).tiny, *normal])
            for p, i in self.own.items():
                self.scores[i] = len(p.encode()) * best - 0.1
            self.ids.update(self.own)
        self.automaton = Automaton(self.ids)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(v.kinds) if k == UNKNOWN), 0)
        self.least = min(normal, default=0.0) - 10
        spanning = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.words = re.compile(r"(?s).+" if spanning else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.met = np.full(SLOTS, -1, np.int64)
        self.merges: dict[int, tuple | None] = {}
        raw = [b"" if k == CONTROL else v.unknown_text.encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(v.pieces, v.kinds)]
        self.raw = np.array(raw + [b""], object)

    def normalise(self, text: str) -> str:
        # symbols are left as they are
        parts = self.symbols.split(text) if self.symbols else [text]
        if self.map:
            parts[::2] = map(self.map.apply, parts[::2])
        text = "".join(parts)
        if self.v.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return MARK * (self.v.dummy_prefix and bool(text)) + text.replace(" ", MARK)

    def split(self, text: str) -> list[str]:
        """The words of a text; BPE models never merge a symbol."""
        if not self.symbols or self.v.algorithm != BPE:
            return self.words(text)
        return [w for k, part in enumerate(self.symbols.split(text)) for w in ([part] if k % 2 else self.words(part))]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; every distinct word of the batch is segmented once."""
        split = [self.split(self.normalise(t)) for t in texts]
        ends = np.cumsum([len(x) for x in split])
        codes, distinct = pd.factorize(np.array([w for x in split for w in x] or [""], object))
        del split
        if not ends.size or not ends[-1]:
            return [np.zeros(0, np.int32) for _ in texts]
        ids, starts, counts = self.segment_all(distinct.tolist())
        n = counts[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(starts[codes] - upto[:-1], n) + np.arange(upto[-1])]
        del codes, distinct, ids, starts, counts, n
        cuts = upto[ends[:-1]]
        if not self.bytes and (unknown := flat == self.unknown).any():
            unknown[1:] &= flat[:-1] == self.unknown  # but the first of a run
            unknown[0] = False
            unknown[cuts[cuts < len(flat)]] = False
            cuts = cuts - np.concatenate([[0], np.cumsum(unknown)])[cuts]
            flat = flat[~unknown]
        return np.split(flat, cuts)

    def segment_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' ids, end to end, and where each word's ids start and how many there are."""
        lengths = np.array([len(w) for w in words])
        own = np.array([self.v.algorithm == BPE and w in self.own for w in words]) if self.own else np.zeros(len(words), bool)
        starts, counts, parts, upto = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int32)], 0
        apart = np.flatnonzero((lengths > SIDE_BY_SIDE) | own).tolist()
        order = np.argsort(-lengths, kind="stable")
        order = order[(lengths[order] > 0) & (lengths[order] <= SIDE_BY_SIDE) & ~own[order]]
        for k in range(0, len(order), AT_ONCE):
            rows = order[k : k + AT_ONCE]
            ids, n = self.split_unused(*self.side_by_side([words[i] for i in rows], lengths[rows]))
            starts[rows], counts[rows] = upto + np.cumsum(n) - n, n
            parts.append(ids)
            upto += len(ids)
        for i in apart:
            ids = np.array([self.own[words[i]]] if own[i] else self.segment(words[i]), np.int32)
            ids, _ = self.split_unused(ids, np.array([len(ids)]))
            starts[i], counts[i] = upto, len(ids)
            parts.append(ids)
            upto += len(ids)
        return np.concatenate(parts), starts, counts

    def split_unused(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (``n`` of each word) with every unused piece split as it was merged."""
        if not self.unused[ids].any():
            return ids, n
        parts = [self.used_parts(i) for i in ids.tolist()]
        widths = np.array([len(p) for p in parts])
        return np.array([i for p in parts for i in p], np.int32), np.bincount(np.repeat(np.arange(len(n)), n), widths, len(n)).astype(np.int64)

    def used_parts(self, i: int) -> list[int]:
        if not self.unused[i]:
            return [i]
        merged = self.steps(i)
        if merged is None or len(merged[1]) < 2:  # a character by itself
            return [i]
        last, first = merged[1][-2], merged[2][-2]
        return [x for p in (first, last) for x in (self.used_parts(self.ids[p]) if p in self.ids else self.fall_back(p))]

    def side_by_side(self, words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of words sorted by length, longest first."""
        a = self.automaton
        characters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = a.alphabet[characters]
        begin = np.cumsum(lengths) - lengths
        piece = np.full((lengths[0] + 1, len(words)), NONE, np.int32)
        size = np.ones(piece.shape, np.int32)
        bpe, best = self.v.algorithm == BPE, np.full(piece.shape, -np.inf)
        piece[0], best[0] = BARE, 0.0
        state = np.zeros(len(words), np.int32)
        for at in range(1, lengths[0] + 1):
            m = np.searchsorted(-lengths, -at, side="right")
            state = a.step(state[:m], letters[begin[:m] + at - 1])
            single, out = np.zeros(m, bool), a.out[state]
            rows = np.flatnonzero(out)
            out = out[rows]
            while rows.size:  # the output links, longest piece first
                i, long = a.piece[out], a.depth[out]
                single[rows[long == 1]] = True
                sums = best[at - long, rows] + self.scores[i]
                if bpe:  # pieces that do not meet are worth minus infinity
                    finite = np.flatnonzero(sums > -np.inf)
                    sums[finite[~self.meet(piece[at - long, rows][finite], i[finite])]] = -np.inf
                good = sums > best[at, rows]
                best[at, rows[good]] = sums[good]
                more = ~good if bpe else np.ones(len(rows), bool)  # of a BPE model, no other sum is finite
                piece[at, rows[good]], size[at, rows[good]] = i[good], long[good]
                out = a.link[out]
                more &= out > 0
                rows, out = rows[more], out[more]
            sums = best[at - 1, :m] + self.least
            bare = ~single & (piece[at, :m] == NONE if bpe else sums > best[at, :m])
            best[at, :m][bare] = np.where(sums[bare] > -np.inf, sums[bare], 0.0)
            piece[at, :m][bare], size[at, :m][bare] = BARE, 1
        rows, at = np.arange(len(words)), lengths.copy()
        n, backwards = np.zeros(len(words), np.int64), []
        while rows.size:
            ids = piece[at[rows], rows]
            bare = ids < 0  # kept as its character until the end
            ids[bare] = -1 - characters[begin[rows[bare]] + at[rows[bare]] - 1].astype(np.int32)
            backwards.append(np.full(len(words), -1, np.int32))
            backwards[-1][rows] = ids
            n[rows] += 1
            at[rows] -= size[at[rows], rows]
            rows = rows[at[rows] > 0]
        turn = n[:, None] - 1 - np.arange(len(backwards))
        ids = np.take_along_axis(np.array(backwards).T, np.maximum(turn, 0), 1)[turn >= 0]
        if (bare := np.flatnonzero(ids < 0)).size:
            pieces = [self.fall_back(chr(-1 - x)) for x in ids[bare].tolist()]
            widths = np.ones(len(ids), np.int64)
            widths[bare] = [len(x) for x in pieces]
            n = np.bincount(np.repeat(np.arange(len(words)), n), widths, len(words)).astype(np.int64)
            is_bare = np.zeros(len(ids), bool)
            is_bare[bare] = True
            ids = np.repeat(ids, widths)
            ids[np.repeat(is_bare, widths)] = [i for x in pieces for i in x]
        return ids, n

    def segment(self, word: str) -> list[int]:
        """The same pass over one word of any length."""
        edges, fail, outs, link, piece, depth = self.automaton.single
        state, back, best, bpe = 0, [(BARE, 0)], [0.0], self.v.algorithm == BPE
        for at in range(1, len(word) + 1):
            while state and (state, word[at - 1]) not in edges:
                state = fail[state]
            state = edges.get((state, word[at - 1]), 0)
            single, out, here, top = False, outs[state], (NONE, 1), -np.inf
            while out:
                i, size = piece[out], depth[out]
                single |= size == 1
                total = best[at - size] + self.scores[i]
                if total > top and (not bpe or self.meets(back[at - size][0], i)):
                    here, top = (i, size), total
                    if bpe:
                        break
                out = link[out]
            if not single and (here[0] == NONE if bpe else best[at - 1] + self.least > top):
                here, top = (BARE, 1), max(best[at - 1] + self.least, -1e300)
            back.append(here)
            best.append(top)
        out, at = [], len(word)
        while at:
            i, size = back[at]
            out.append([i] if i >= 0 else self.fall_back(word[at - size : at]))
            at -= size
        return [i for x in reversed(out) for i in x]

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging gives a and then b (a = BARE: b alone), for each pair."""
        key = (a.astype(np.int64) + 1) * len(self.v.pieces) + b
        slot = slots(key, SLOTS)
        held = self.met[slot]
        for k in np.flatnonzero(held >> 1 != key).tolist():
            there = self.met[slot[k]]
            held[k] = there if there >> 1 == key[k] else 2 * key[k] + self.apart(int(a[k]), int(b[k]))
            self.met[slot[k]] = held[k]
        return (held & 1).astype(bool)

    def meets(self, a: int, b: int) -> bool:
        """As :meth:`meet`, for one pair."""
        key = (a + 1) * len(self.v.pieces) + b
        slot = (key * SPREAD & 0xFFFFFFFFFFFFFFFF) >> (65 - SLOTS.bit_length())
        held = int(self.met[slot])
        if held >> 1 != key:
            self.met[slot] = held = 2 * key + self.apart(a, b)
        return bool(held & 1)

    def apart(self, a: int, b: int) -> bool:
        """Whether two pieces stay apart while each of them is merged from its characters.

        The merges of each run in their own order and the better of the two
        next ones comes first; the pieces join if the merge over their border
        ever comes before both.  Of equal merges the leftmost comes first.
        """
        right = self.steps(b)
        if right is None or a < 0:
            return right is not None
        left = self.steps(a)
        if left is None:
            return False
        (mine, last), (others, first) = (left[0], left[1]), (right[0], right[2])
        j = k = 0
        while True:
            over = self.ids.get(last[j] + first[k])
            cross = -np.inf if over is None else self.v.scores[over]
            sa = mine[j] if j < len(mine) else -np.inf
            sb = others[k] if k < len(others) else -np.inf
            if over is not None and cross > sa and cross >= sb:
                return False
            if sa == sb == -np.inf:
                return True
            if sa >= sb:
                j += 1
            else:
                k += 1

    def steps(self, i: int) -> tuple | None:
        """How piece i is merged: scores, and the last and first part before each merge and at the end; None if it isn't."""
        if i not in self.merges:
            parts = list(self.v.pieces[i])
            scores, last, first = [], [parts[-1]], [parts[0]]
            while True:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    x = self.ids.get(parts[k] + parts[k + 1])
                    if x is not None and (best is None or self.v.scores[x] > best):
                        best, at = self.v.scores[x], k
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                scores.append(best)
                last.append(parts[-1])
                first.append(parts[0])
            self.merges[i] = (scores, last, first) if len(parts) == 1 else None
        return self.merges[i]

    def fall_back(self, character: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in character.encode("utf-8", "replace")]

    def decode(self, ids: np.ndarray) -> str:
        inside = (ids >= 0) & (ids < len(self.v.pieces))
        text = b"".join(self.raw[np.where(inside, ids, len(self.v.pieces))].tolist()).decode("utf-8", "replace")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` as array<int>; a column of that name is replaced."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        codec = vocabulary.codec()
        ids = iter(codec.encode_all([t for t in texts if t is not None]))
        give_back()
        return pd.Series([None if t is None else next(ids) for t in texts], dtype=object)

    return df.withColumn(into, run(F.col(text)))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids``; null entries and ids outside the vocabulary are skipped."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        codec = vocabulary.codec()
        return pd.Series([None if x is None else codec.decode(np.array([-1 if i is None or i != i else i for i in x] if x.dtype.kind not in "iu" else x, np.int64)) for x in lists], dtype=object)

    return df.withColumn(into, run(F.col(ids)))


def round_trip(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", into: str = "decoded") -> DataFrame:
    """As :func:`decode` after :func:`encode`, each batch encoded once.

    Two such functions in a row are run in one Python step that would encode
    the texts for each of its outputs.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("ids array<int>, decoded string")
    def run(texts: pd.Series) -> pd.DataFrame:
        codec = vocabulary.codec()
        found = iter(codec.encode_all([t for t in texts if t is not None]))
        give_back()
        lists = [None if t is None else next(found) for t in texts]
        return pd.DataFrame({"ids": pd.Series(lists, dtype=object), "decoded": pd.Series([None if x is None else codec.decode(x) for x in lists], dtype=object)})

    coded = run(F.col(text))
    return df.withColumns({ids: coded["ids"], into: coded["decoded"]})
