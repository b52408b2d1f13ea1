"""Token counts by a compiled finite-state transducer (operator 1).

The merges of a byte-level BPE are compiled into a deterministic transducer over bytes. Reading a
pre-token byte by byte, the encoding of every beginning ends in exactly one token, found among the
tokens that end at this byte: that which may stand after the last token of the beginning left of
it. So a state needs to know the longest suffix that begins a token, and, for each place where a
token still open may have begun, the last token before it and how many tokens were emitted up to
there. Each transition is annotated with the number of tokens it emits (less than zero where bytes
that stood for tokens of their own are merged). States and transitions are made when first met and
shared by all texts.

A chunk of text stands for a map of states: what it does from the boundary between pre-tokens, and
what is still open at its two ends. Such maps compose associatively, so the chunks of every text
are counted apart and combined by a parallel prefix scan.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.safe_split import FIRST_CUT, LAST_CUT

#: The pattern of byte-level pre-tokenizers (fixed value).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 1 << 12
#: Whole pre-tokens, states and pairs of tokens that a worker keeps; beyond, it starts afresh. Results don't depend on it.
MOST_WHOLE, MOST_STATES, MOST_PAIRS = 400_000, 200_000, 500_000


#: A state's numbers: the last token times SPAN, plus HERE and the tokens emitted since (over -HERE, as tokens are shorter).
SPAN, HERE = 4096, 2048


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The tokens of a vocabulary as bytes, and which may stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        letters = byte_letters()
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if all(c in letters for c in t)}
        self.of_byte = {b[0]: i for i, b in self.bytes.items() if len(b) == 1}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        self.rank = {(vocabulary[a], vocabulary[b]): (n, vocabulary[a + b]) for n, (a, b) in enumerate(pairs)}
        self._made = {whole: (n, *parts) for parts, (n, whole) in self.rank.items()}
        self._alone: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self._side: dict[tuple[int, int], bool] = {}

    def encode(self, data: bytes) -> list[int]:
        """By the definition: the earliest learnt merge first, from the left."""
        ids = [self.of_byte[b] for b in data]
        never = (len(self.rank), -1)
        while len(ids) > 1:
            (n, merged), at = min((self.rank.get(p, never), i) for i, p in enumerate(pairwise(ids)))
            if merged < 0:
                break
            ids[at : at + 2] = [merged]
        return ids

    def alone(self, token: int) -> bool:
        """Whether a token's bytes are encoded as this token, by the merge that is listed for it."""
        if (found := self._alone.get(token)) is None:
            whole = self.encode(self.bytes[token])
            found = self._alone[token] = whole == [token]
        return found

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """What stands at one end of a token while it is put together: from which merge to which, and what."""
        if (out := self._edges.get((token, side))) is None:
            out, until, part = [], len(self.rank), token
            while (made := self._made.get(part)) is not None:
                out.append((made[0], until, part))
                until, part = made[0], made[side]
            out.append((-1, until, part))
            out = self._edges[token, side] = out[::-1]
        return out

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens are encoded as these two; a < 0: whether those of b are as b alone.

        Both sides are put together as if alone until a merge reaches across, so it is enough to see
        whether one may while its two parts stand next to each other.
        """
        if a < 0:
            return self.alone(b)
        if (found := self._side.get((a, b))) is None:
            if len(self._side) >= MOST_PAIRS:
                self._side.clear()
            found = self._side[a, b] = self.alone(b) and not self._joined(self._edge(a, 2), self._edge(b, 1))
        return found

    def _joined(self, left: list[tuple[int, int, int]], right: list[tuple[int, int, int]]) -> bool:
        never, rank = (len(self.rank), -1), self.rank
        i = k = 0
        while True:
            since_x, until_x, x = left[i]
            since_y, until_y, y = right[k]
            n = rank.get((x, y), never)[0]
            # of merges of one rank the leftmost comes first
            if since_x <= n and since_y <= n < until_x and n <= until_y and n < never[0]:
                return True
            if until_x <= until_y:
                i += 1
                if i == len(left):
                    return False
            else:
                k += 1


class Suffixes:
    """For every beginning of a token: where a further byte leads (the longest suffix that begins a
    token), the tokens that end there, and the suffixes of it that begin a token, the longest first."""

    def __init__(self, tokens: dict[int, bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.depth, own = [0], [-1]
        for i, data in tokens.items():
            at = 0
            for b in data:
                if b not in self.next[at]:
                    self.next[at][b] = len(self.next)
                    self.next.append({})
                    self.depth.append(self.depth[at] + 1)
                    own.append(-1)
                at = self.next[at][b]
            own[at] = i
        self._lengths: dict[int, tuple[int, ...]] = {}
        self.back = [0] * len(self.next)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        queue = [0]
        for at in queue:  # breadth first, so that shorter suffixes are done
            for b, to in self.next[at].items():
                self.back[to] = self.step(self.back[at], b) if at else 0
                mine = ((self.depth[to], own[to]),) if own[to] >= 0 else ()
                self.ends[to] = mine + self.ends[self.back[to]]
                queue.append(to)

    def step(self, at: int, byte: int) -> int:
        while byte not in self.next[at]:
            if not at:
                return 0
            at = self.back[at]
        return self.next[at][byte]

    def lengths(self, at: int) -> tuple[int, ...]:
        if (found := self._lengths.get(at)) is None:
            found = self._lengths[at] = (self.depth[at], *(self.lengths(self.back[at]) if at else ()))
        return found


class Transducer(dict):
    """Pre-token -> emitted tokens, by way of the transitions over its bytes; missing ones are walked."""

    START = -1

    def __init__(self, vocabulary: str):
        super().__init__()
        with open(vocabulary, encoding="utf-8") as f:
            described = json.load(f)
        model = described["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        self.suffixes = Suffixes(self.merges.bytes)
        self.matches = regex.compile(BYTE_LEVEL_PATTERN).findall
        special = [t["content"] for t in described.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._begin()

    def _begin(self) -> None:
        # a state: the longest suffix that begins a token, and by the length of each suffix that
        # does, the last token before it and the tokens emitted up to there less those up to here
        # (never over the bytes of a token), as one number
        self.states = [(0, {0: self.START * SPAN + HERE})]
        self.numbers = {(0, self.START * SPAN + HERE): 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the tokens emitted on the way, worked out when first asked for."""
        at, before = self.states[state]
        to = self.suffixes.step(at, byte)
        side = self.merges._side
        for length, token in self.suffixes.ends[to]:
            open_ = before[length - 1]
            last = open_ // SPAN
            fits = side.get((last, token))
            if self.merges.side_by_side(last, token) if fits is None else fits:
                emitted = open_ % SPAN - HERE + 1
                break
        else:
            raise ValueError("a byte that no token of the vocabulary stands for")
        lengths = self.suffixes.lengths(to)
        opens = [before[x - 1] - emitted for x in lengths[:-1]]
        opens.append(token * SPAN + HERE)
        key = (to, *opens)
        if (number := self.numbers.get(key)) is None:
            number = self.numbers[key] = len(self.states)
            self.states.append((to, dict(zip(lengths, opens))))
            self.moves.append({})
        found = self.moves[state][byte] = (number, emitted)
        return found

    def __missing__(self, symbol: str) -> int:
        if len(self) >= MOST_WHOLE:
            self.clear()
        if len(self.states) >= MOST_STATES:
            self._begin()
        state = total = 0
        moves = self.moves
        for byte in symbol.encode("utf-8", "surrogatepass"):
            found = moves[state].get(byte)
            state, emitted = found if found is not None else self.move(state, byte)
            total += emitted
        self[symbol] = total
        return total

    def emitted(self, text: str) -> int:
        """Tokens emitted on the way from the boundary state through a whole text."""
        return sum(map(self.__getitem__, self.matches(text)))


@dataclass(frozen=True)
class StateMap:
    """What a chunk does: head is read in the state left open before it, then count tokens are
    emitted between cuts, and tail stays open. Without a cut (whole), head alone is open."""

    head: str
    count: int = 0
    tail: str = ""
    whole: bool = True


def state_map(chunk: str, emitted: Callable[[str], int]) -> StateMap:
    first = FIRST_CUT.search(chunk)
    if first is None or first.start() >= len(chunk):
        return StateMap(chunk)
    a, b = first.start(), LAST_CUT.search(chunk).start()
    return StateMap(chunk[:a], emitted(chunk[a:b]), chunk[b:], False)


def compose(left: StateMap, right: StateMap, emitted: Callable[[str], int]) -> StateMap:
    if left.whole and right.whole:
        return state_map(left.head + right.head, emitted)
    if left.whole:
        opened = state_map(left.head + right.head, emitted)
        if opened.whole:
            return StateMap(opened.head, right.count, right.tail, False)
        return StateMap(opened.head, opened.count + emitted(opened.tail) + right.count, right.tail, False)
    if right.whole:
        opened = state_map(left.tail + right.head, emitted)
        if opened.whole:
            return StateMap(left.head, left.count, opened.head, False)
        return StateMap(left.head, left.count + emitted(opened.head) + opened.count, opened.tail, False)
    return StateMap(left.head, left.count + emitted(left.tail + right.head) + right.count, right.tail, False)


def prefix_scan(maps: list[StateMap], emitted: Callable[[str], int]) -> list[StateMap]:
    """The compositions of the first, the first two, and so on. Neighbours are composed, these pairs
    are scanned, and every other element follows from the pair before it: the compositions of one
    depth don't depend on each other, and there are about twice as many in all as maps."""
    if len(maps) < 2:
        return maps
    pairs = prefix_scan([compose(maps[i], maps[i + 1], emitted) for i in range(0, len(maps) - 1, 2)], emitted)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], maps[i], emitted))
    return out


def closed(m: StateMap, emitted: Callable[[str], int]) -> int:
    """Tokens of a text of which m is the map: both ends are closed."""
    return emitted(m.head) + m.count + (0 if m.whole else emitted(m.tail))


def count_text(text: str, transducer: Transducer, chunk: int = CHUNK_CHARS) -> int:
    if transducer.special is not None and (found := transducer.special.findall(text)):
        parts = transducer.special.split(text)
        return len(found) + sum(count_text(p, transducer, chunk) for p in parts if p)
    maps = [state_map(text[i : i + chunk], transducer.emitted) for i in range(0, len(text), chunk)]
    return closed(prefix_scan(maps, transducer.emitted)[-1], transducer.emitted) if maps else 0


@lru_cache(2)
def compiled(vocabulary: str) -> Transducer:
    return Transducer(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, chunk: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text).

    vocabulary: file of a byte-level BPE for the tokenizers library, at the same place on every executor.
    A null text counts as empty: zero bytes and tokens. Rows stand for themselves: a null or
    repeated doc_id and repeated rows each give a row of their own. Other columns are dropped,
    whatever their names. An empty table gives an empty one. Texts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(vocabulary)
        gc.disable()  # states are many and hold no cycles: collections would only walk through them
        try:
            for batch in batches:
                n = [count_text(t.as_py() or "", transducer, chunk) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        finally:
            gc.enable()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
