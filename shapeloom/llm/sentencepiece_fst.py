r"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into machines:

* ``Normaliser``, from the model's character map (longest match), its rules for blanks, and
  the U+2581 that stands for a blank and is put before the text;
* ``Pieces``, from characters to piece ids, one path a piece, and byte fallback: a character
  that is no piece goes to the ids of its UTF-8 bytes. An arc's weight is the negative score of
  its piece in unigram models, where scores are log probabilities, and 0 in BPE models, where
  they are ranks of merges: adding these up would give other segmentations;
* for BPE models ``Neighbours``, an acceptor over piece ids, whose state is the last piece. It
  weighs a piece after another 0 if the merges of their joined text give back just these two,
  else infinity. A segmentation is the one that merging gives if and only if all its
  neighbours are such pairs, so the path of finite weight is the BPE result.

Each input is composed with them lazily, arc by arc from the states that are reached, and the
path of least weight is taken in the tropical semiring (weights add up along a path, the
least one counts). No piece goes on after a character before U+2581, nor over a character that is
in no longer piece, so an input falls apart there into units whose paths are independent;
paths of units are kept in a bounded memo. Units that aren't there are composed together
(``compose``): the first places of all of them at once, then the second ones, as arrays, for as
long as a place of a unit has one state. A unit with more, and those of a length that few have,
are composed by themselves (``path``). Each worker builds the machines from the model file's
bytes (0.5 MB).

One case is no path: pieces of several blanks have equal ranks, so how a run of blanks is merged
depends on its length and not on neighbours alone. In BPE models such runs, with the word
behind them, go through the merges themselves, by an agenda in order of rank and place. Where
all pieces of blanks have one rank, behind all others, merging works at the leftmost place until
no blank can be added there, so a long run begins with equal pieces and only its end is merged.

Defined cases: null and empty texts give no ids and decode to ""; U+2581 in a text reads as
a blank, as in the library, so such texts aren't decoded to themselves; texts of any length
are encoded whole; null ids and repeated rows stay rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.lean import lean
from shapeloom.llm.memo import Memo
from shapeloom.llm.words import chunked

SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INF = float("inf")
#: The piece of a fallback, and the state behind it and at the start.
BYTES = -1
#: Weight of a byte fallback beside log probabilities.
FALLBACK = 1e6
#: Units composed together: so many at least, of so many characters at most.
TOGETHER, CHARACTERS = 8, 1 << 17
#: Weights of pairs of pieces that are remembered, and the places of their table (a power of two).
PAIRS, PAIR_BITS = 2_000_000, 21


class Normaliser:
    """Text to normalised text, by the rules of a model's normaliser."""

    def __init__(self, spec):
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.trim = spec.remove_extra_whitespaces
        self.blank = SPACE if spec.escape_whitespaces else " "
        blob = spec.precompiled_charsmap
        self.units = None
        if blob:  # a double-array trie of 32-bit units, then the texts that its values point to
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
            self.texts = blob[4 + size :]

    def _longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The end of the longest entry of the character map at a place, and what it becomes."""
        units, found = self.units, None
        offset = lambda u: (u >> 10) << ((u >> 6) & 8)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1, self.texts[start : self.texts.index(0, start)]
        return found

    def __call__(self, text: str) -> str:
        if self.units is not None:
            data, out, at = text.encode(), [], 0
            while at < len(data):
                hit = self._longest(data, at)
                if hit is None:
                    end = at + 1
                    while end < len(data) and data[end] & 0xC0 == 0x80:
                        end += 1
                    hit = end, data[at:end]
                out.append(hit[1])
                at = hit[0]
            text = b"".join(out).decode()
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        return self.prefix.replace(SPACE, self.blank) + text.replace(" ", self.blank) if text or not self.trim else ""


class Pieces:
    """A trie from characters to piece ids, with byte fallback. A node has its children, the
    piece that ends there, if any, and its weight."""

    def __init__(self, ids: dict[str, int], weight: dict[int, float]):
        self.root: list = [{}, None, 0.0]
        self.longest = max(map(len, ids), default=1)
        for p, i in ids.items():
            node = self.root
            for c in p:
                node = node[0].setdefault(c, [{}, None, 0.0])
            node[1:] = i, weight[i]
        self._pack()

    def _pack(self) -> None:
        """The trie as a double array. Characters have classes from 1 on, common ones first. The child of
        a node is at ``base`` of the node and class, if the ``owner`` of that place is the node."""
        todo = [self.root]
        for node in todo:
            todo += node[0].values()
        edges = Counter(c for node in todo for c in node[0])
        class_of = {c: k for k, (c, _) in enumerate(edges.most_common(), 1)}
        base, owner, piece, weight = [0], [-1], [-1], [0.0]
        start: dict[int, int] = {}
        nodes, free = [(self.root, 0)], 1  # no place before ``free`` is
        for node, place in nodes:
            at = sorted(class_of[c] for c in node[0])
            if not at:
                continue
            while free < len(owner) and owner[free] >= 0:
                free += 1
            b = free - at[0]  # may be below 0, as places count from both ends
            if len(at) > 1:
                b = max(start.get(len(at), b), b)
                for b in range(b, b + 16):
                    if not any(owner[b + k] >= 0 for k in at if b + k < len(owner)):
                        break
                else:
                    b = len(owner) - at[0]
                start[len(at)] = b
            base[place] = b
            more = b + at[-1] + 1 - len(owner)
            if more > 0:
                base += [0] * more
                owner += [-1] * more
                piece += [-1] * more
                weight += [0.0] * more
            for c, child in node[0].items():
                k = b + class_of[c]
                owner[k] = place
                if child[1] is not None:
                    piece[k], weight[k] = child[1:]
                nodes.append((child, k))
        room = len(class_of) + 1  # behind the last base
        self.base, self.owner = np.array(base, np.int32), np.array(owner + [-1] * room, np.int32)
        self.piece, self.weight = np.array(piece, np.int32), np.array(weight)
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in class_of]] = list(class_of.values())

    def all_arcs(self, classes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(from, to, piece, weight) of the arcs from these places, as ``arcs`` gives them. Class 0 ends a text."""
        found, node, start = [], np.zeros(len(at), np.int32), at
        alone = np.zeros(len(classes), bool)
        for d in range(self.longest):
            to = self.base[node] + classes[at + d]
            on = np.flatnonzero(self.owner[to] == node)
            at, node = at[on], to[on]
            piece = self.piece[node]
            ends = np.flatnonzero(piece >= 0)
            found.append((at[ends], at[ends] + (d + 1), piece[ends], self.weight[node[ends]]))
            if not d:
                alone[found[0][0]] = True
        lone = start[~alone[start]]
        found.append((lone, lone + 1, np.full(len(lone), BYTES, np.int32), np.full(len(lone), FALLBACK)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def arcs(self, text: str, at: int) -> list[tuple[int, int, float]]:
        """(place, piece, weight) of the arcs from a place; the piece ``BYTES`` is the fallback."""
        node, out = self.root, []
        for j, c in enumerate(text[at : at + self.longest], at + 1):
            node = node[0].get(c)
            if node is None:
                break
            if node[1] is not None:
                out.append((j, node[1], node[2]))
        if not out or out[0][0] != at + 1:
            out.append((at + 1, BYTES, FALLBACK))
        return out


class Neighbours:
    """Of BPE models: which pieces may stand beside each other."""

    def __init__(self, pieces: list[str], ids: dict[str, int], score: dict[str, float]):
        self.pieces, self.ids, self.score, self.known = pieces, ids, score, {}
        self.rank = {p: -x for p, x in score.items()}
        self._traces: tuple[dict[int, tuple | None], dict[int, tuple | None]] = {}, {}

    def merge(self, text: str, log: list[tuple[float, int, int, str]] | None = None) -> list[str]:
        """The pieces that merging gives, best pair first, leftmost of equals. ``log`` gets the
        merges: rank, place, the place behind it, the new piece."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        agenda: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if both in self.ids:
                    heappush(agenda, (-self.score[both], i, both))

        for i in range(len(parts)):
            offer(i)
        while agenda:
            _, i, both = heappop(agenda)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or len(parts[i]) + len(parts[j]) != len(both) or parts[i] + parts[j] != both:
                continue  # one of the two has been merged since
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if log is not None:
                log.append((self.rank[both], i, after[i], both))
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def merge_blanks(self, text: str) -> list[str]:
        """The same for a run of blanks and what follows."""
        if self._block is None:
            blanks = [p for p in self.ids if len(p) > 1 and not p.strip(SPACE)]
            rank = {self.score[p] for p in blanks}
            least = min((x for p, x in self.score.items() if len(p) > 1 and p.strip(SPACE)), default=INF)
            self._rest = 4 * max(map(len, blanks), default=0)
            self._block = self.merge(SPACE * self._rest)[0] if len(rank) == 1 and rank.pop() < least else ""
        run = len(text) - len(text.lstrip(SPACE))
        k = max(0, run - self._rest) // len(self._block) if self._block else 0
        return [self._block] * k + self.merge(text[k * len(self._block) :])

    _block: str | None = None
    _rest = 0

    def weight(self, state: int, piece: int) -> float:
        """Of a piece after the last one; behind the start or a fallback any may stand."""
        if state < 0 or piece < 0:
            return 0.0
        pair = state << 20 | piece
        found = self.known.get(pair)
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[pair] = 0.0 if self._apart(state, piece) else INF
        return found

    def _trace(self, piece: int, right: bool) -> tuple | None:
        """How merging makes a piece of its characters: the part at its left or right edge at first, then
        of each merge the rank and the new part at the edge, if it changes. Nothing for a piece
        that merging doesn't make."""
        text, log = self.pieces[piece], []
        if self.merge(text, log) != [text]:
            return None
        changes = [(rank, both if (end == len(text) if right else i == 0) else None) for rank, i, end, both in log]
        return text[-1 if right else 0], [*changes, (INF, None)]

    def _apart(self, x: int, y: int) -> bool:
        """If merging the joined text gives back these two: their own merges go on side by side, best
        one first, the left one of equals, and the parts at the border must never be the best pair."""
        lefts, rights = self._traces
        if x not in rights:
            rights[x] = self._trace(x, True)
        if y not in lefts:
            lefts[y] = self._trace(y, False)
        if rights[x] is None or lefts[y] is None:
            return False
        (a, of_x), (b, of_y) = rights[x], lefts[y]
        rank, i, j = self.rank.get, 0, 0
        own, part = of_x[0]
        other, first = of_y[0]
        across = rank(a + b, INF)
        while True:
            if across < own and across <= other and across < INF:
                return False
            if own <= other:
                if own == INF:
                    return True
                i += 1
                if part is not None:
                    a = part
                    across = rank(a + b, INF)
                own, part = of_x[i]
            else:
                j += 1
                if first is not None:
                    b = first
                    across = rank(a + b, INF)
                other, first = of_y[j]

    def weights(self, states: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """The same of many; a table of one place for each pair's hash is asked first."""
        if self._table is None:
            self._table = np.full(1 << PAIR_BITS, -1, np.int64)  # pair and whether it is one, or -1
        out = np.zeros(len(states))
        some = np.flatnonzero((states >= 0) & (pieces >= 0))
        pair = states[some].astype(np.int64) << 20 | pieces[some]
        slot = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        entry = self._table[slot]
        new = np.flatnonzero(entry >> 1 != pair)
        if len(new):
            fresh, back = np.unique(pair[new], return_inverse=True)
            weight = self.weight
            fine = np.array([weight(p >> 20, p & 0xFFFFF) == 0.0 for p in fresh.tolist()], np.int64)
            entry[new] = (fresh << 1 | fine)[back]
            self._table[slot[new]] = entry[new]
        out[some[entry & 1 == 0]] = INF
        return out

    _table: np.ndarray | None = None


class Transducer:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        kinds = {p.type for p in m.pieces}
        if m.trainer_spec.treat_whitespace_as_suffix or not m.trainer_spec.byte_fallback or not m.normalizer_spec.escape_whitespaces or USER in kinds:
            raise ValueError("models without byte fallback, with blanks as suffixes or as they are, or with symbols of a user are not supported")
        self.bpe = m.trainer_spec.model_type == BPE
        self.normalise = Normaliser(m.normalizer_spec)
        self.plain = self.normalise.units is None and not self.normalise.trim
        self.prefix = self.normalise.prefix
        self.pieces = [p.piece for p in m.pieces]
        self.kinds = [p.type for p in m.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.byte_ids = np.array([self.bytes.get(b, 0) for b in range(256)], np.int32)
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        longer = [p for p in self.ids if len(p) > 1]
        joined = set("".join(longer))
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("a piece goes on over a blank")
        # Units: blanks and what follows, up to the next blank; characters of no longer piece alone.
        inner = "".join(re.escape(c) for c in joined if c != SPACE)
        self.unit = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|.", re.S)
        self.machine = Pieces(self.ids, {i: 0.0 if self.bpe else -m.pieces[i].score for i in self.ids.values()})
        self.neighbours = Neighbours(self.pieces, self.ids, {p: m.pieces[i].score for p, i in self.ids.items()}) if self.bpe else None
        self.memo = Memo()

    def path(self, unit: str) -> list[int]:
        """Ids on the path of least weight through the composition."""
        if self.bpe and SPACE * 2 in unit:
            return self._ids(self.neighbours.merge_blanks(unit))
        n, arcs, neighbours = len(unit), self.machine.arcs, self.neighbours
        known = neighbours.known if neighbours is not None else {}
        # Of each place the states that are reached: weight, the place and the state before.
        reached: list[dict[int, tuple[float, int, int]] | None] = [None] * (n + 1)
        reached[0] = {BYTES: (0.0, 0, BYTES)}
        for i in range(n):
            here = reached[i]
            if here is None:
                continue
            out = arcs(unit, i)
            for state, (so_far, _, _) in here.items():
                for j, piece, weight in out:
                    total, last = so_far + weight, BYTES
                    if neighbours is not None:
                        last = piece
                        if state >= 0:
                            more = known.get(state << 20 | piece)
                            total += neighbours.weight(state, piece) if more is None else more
                            if total == INF:
                                continue
                    there = reached[j]
                    if there is None:
                        reached[j] = {last: (total, i, state)}
                    elif last not in there or total < there[last][0]:
                        there[last] = total, i, state
        return self._ids(self._back(unit, reached))

    def _back(self, unit: str, reached: list[dict[int, tuple[float, int, int]] | None]) -> list[str]:
        out, j = [], len(unit)
        state = min(reached[j], key=lambda q: reached[j][q][0])
        while j:
            _, i, state = reached[j][state]
            out.append(unit[i:j])
            j = i
        return out[::-1]

    def _ids(self, parts: list[str]) -> list[int]:
        return [i for p in parts for i in ([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()])]

    def compose(self, units: list[str]) -> list[bytes | None]:
        """Ids on the paths of least weight of all these units. Nothing for a unit that has
        two states in one place: ``path`` keeps these apart."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        first = np.cumsum(size + 1) - size - 1  # behind each unit is a place for its end
        end, total = first + size, int(size.sum()) + len(units)
        text = np.frombuffer(("\n".join(units) + "\n").encode("utf-32-le"), "<u4")
        classes = self.machine.classes[text]
        classes[end] = 0
        inside = np.ones(total, bool)
        inside[end] = False
        unit_of = np.repeat(np.arange(len(units)), size + 1)
        at = np.flatnonzero(inside)
        arcs = self.machine.all_arcs(classes, at)
        step = (arcs[0] - first[unit_of[arcs[0]]]).astype(np.uint16)
        order = np.argsort(step, kind="stable")
        arcs = tuple(x[order] for x in arcs)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(step, minlength=int(size.max())))]).tolist()

        # Of each place the state that is reached: weight, the last piece and the place before.
        least, last, before = np.full(total, INF), np.full(total, BYTES, np.int32), np.zeros(total, np.int64)
        least[first] = 0.0
        apart = np.zeros(len(units), bool)
        for a, b in zip(bounds, bounds[1:]):
            i, j, piece, weight = (x[a:b] for x in arcs)
            so_far = least[i] + weight
            if self.neighbours is not None:
                so_far += self.neighbours.weights(last[i], piece)
                on = np.flatnonzero(so_far < INF)
                i, j, piece, so_far = i[on], j[on], piece[on], so_far[on]
                apart[unit_of[j[least[j] < INF]]] = True
            # Arcs of one step into one place: none, as those from a place have different lengths.
            on = np.flatnonzero(so_far < least[j])
            j = j[on]
            least[j], last[j], before[j] = so_far[on], piece[on], i[on]
        apart |= least[end] == INF

        kept, now = np.zeros(total, bool), np.flatnonzero(~apart)
        place, start = end[now], first[now]
        while len(place):
            kept[place] = True
            place = before[place]
            more = place > start
            place, start = place[more], start[more]
        kept = np.flatnonzero(kept)
        ids = last[kept]
        count = np.ones(len(kept), np.int64)
        lone = np.flatnonzero(ids == BYTES)
        if len(lone):
            chars = text[kept[lone] - 1]
            count[lone] += (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            ids = np.repeat(ids, count)
            ids[ids == BYTES] = self.byte_ids[np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)]
        flat = ids.astype("<u4").tobytes()
        cut = np.concatenate([[0], 4 * np.cumsum(count)])[np.searchsorted(kept, np.append(first, total))].tolist()
        return [None if x else flat[a:b] for x, a, b in zip(apart.tolist(), cut, cut[1:])]

    def _make(self, units: list[str]) -> list[bytes]:
        parts = list(map(self.unit.findall, units))
        done: dict[str, bytes | None] = {}
        groups: dict[int, list[str]] = {}
        for u in dict.fromkeys(chain.from_iterable(parts)):
            groups.setdefault(0 if self.bpe and SPACE * 2 in u else len(u).bit_length(), []).append(u)
        for bits, group in groups.items():
            some = max(1, CHARACTERS >> bits)
            for k in range(0, len(group), some):
                now = group[k : k + some]
                done.update(zip(now, self.compose(now) if bits and len(now) >= TOGETHER else [None] * len(now)))
        for u, ids in done.items():
            if ids is None:
                done[u] = array("I", self.path(u)).tobytes()
        return [done[p[0]] if len(p) == 1 else b"".join([done[u] for u in p]) for p in parts]

    def _split(self, text: str | None) -> list[str]:
        """The units of a text: lines fall apart before U+2581."""
        if not text:
            return []
        out: list[str] = []
        text = self.prefix + text.replace(" ", SPACE) if self.plain else self.normalise(text)
        for k, line in enumerate(text.split("\n") if text else []):
            if k:
                out.append("\n")
            head, *rest = line.split(SPACE)
            if "" in rest:  # runs of blanks
                out += re.findall(f"^[^{SPACE}]+|{SPACE}+[^{SPACE}]*", line)
                continue
            if head:  # of a text that doesn't begin with U+2581
                out.append(head)
            out += [SPACE + w for w in rest]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        split = [self._split(t) for t in texts]
        return [b"".join(x) for x in self.memo.look_up(split, self._make)]

    def decode(self, ids: list[int]) -> str:
        """The text: pieces joined, runs of byte pieces as UTF-8, the prefix taken off."""
        if not ids:
            return ""
        if self._shown is None:
            self._shown = [b"" if k in (CONTROL, UNUSED) else bytes([self.byte_of[i]]) if k == BYTE else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        text = b"".join([self._shown[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    _shown: list[bytes] | None = None


_machines: dict[bytes, Transducer] = {}


def machine(model: bytes) -> Transducer:
    """The worker's machine of this model; its memo and acceptor last from task to task."""
    found = _machines.get(model)
    if found is None:
        found = _machines[model] = Transducer(model)
    return found


def forget_machines() -> None:
    _machines.clear()


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array<int>, decoded) for each row; ``model`` is a file of the driver."""
    with open(model, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def encode(batches):
        fst = machine(data.value)
        for batch in chunked(batches):
            ids = [np.frombuffer(x, "<u4") for x in fst.encode(batch.column(1).to_pylist())]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([fst.decode(x.tolist()) for x in ids], pa.string())], ["id", "ids", "decoded"])

    return rows.mapInArrow(lean(encode, forget_machines), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, decoded_sha256, lossless): the same, digested in the task
    that made it."""
    with open(model, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def encode(batches):
        import hashlib

        fst = machine(data.value)
        for batch in chunked(batches):
            out = []
            texts = batch.column(1).to_pylist()
            for t, ids in zip(texts, fst.encode(texts), strict=True):
                decoded = fst.decode(np.frombuffer(ids, "<u4").tolist())
                out.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(decoded.encode()).hexdigest(), decoded == (t or "")))
            n, crc, sha, same = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], ["id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    return rows.mapInArrow(lean(encode, forget_machines), f"id {kind}, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean").withColumnRenamed("id", id_col)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded again."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
