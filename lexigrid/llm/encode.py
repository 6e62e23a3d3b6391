"""Encoding with a byte-level BPE: the merges as a transducer whose states are found when they are first needed."""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts a text before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Pieces(dict):
    """Ids of pieces met so far, each as the bytes of 32-bit integers, so that those of a text are joined without a loop. A full table is started anew; long pieces aren't kept."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class BytePairTransducer:
    """Reads bytes, emits tokens.

    For each prefix of a piece there is exactly one token that its encoding ends with: the token t of the bytes from j on for which (last token of the prefix up to j, t)
    is a pair that the merges leave alone. A state is what that needs: for each place j from which a token could still go on, how far its bytes have come in the
    vocabulary's trie and the last token at j. States are numbered and their transitions kept when first taken; a full table is started anew. A token
    is certain, and emitted, once the ways back from all places that can still matter agree on it, which looks ahead by one longest token.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000, max_pieces: int = 200_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length_of = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.stays: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pieces = _Pieces(self.encode_bytes, max_pieces)
        self.cut = regex.compile(PIECES)
        self._restart()

    def _restart(self) -> None:
        self.numbers: dict[tuple, int] = {((0, -1),): 0}
        self.live: list[tuple] = [((0, -1),)]
        self.goes: list[dict[int, int]] = [{}]
        self.last: list[int] = [-1]

    def merge(self, data: bytes, below: int = 1 << 40) -> list[int]:
        """The merges of ranks under ``below`` applied one by one, lowest rank first, leftmost first."""
        parts = [data[k : k + 1] for k in range(len(data))]
        ranks = [self.ranks.get(data[k : k + 2], 1 << 40) for k in range(len(data) - 1)]
        while ranks:
            low = min(ranks)
            if low >= below:
                break
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = self.ranks.get(parts[k - 1] + parts[k], 1 << 40)
            if k < len(ranks):
                ranks[k] = self.ranks.get(parts[k] + parts[k + 1], 1 << 40)
        return [self.ranks[x] for x in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; none for a single byte."""
        h = self.halves.get(token, 0)
        if h == 0:
            parts = self.merge(self.bytes_of[token], token)
            h = self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return h

    def _apart(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's bytes side by side end in these two tokens. The merges within both are undone from the last one back; where the tokens that then meet at the border could have merged
        before the merge that was undone, they would have. At equal rank the left one goes first."""
        limit = 1 << 40
        while True:
            if self.ranks.get(self.bytes_of[a] + self.bytes_of[b], limit) < limit:
                return False
            left, right = self._halves(a), self._halves(b)
            if left and (a > b or not right):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def _stays(self, a: int, b: int) -> bool:
        key = (a, b)
        ok = self.stays.get(key)
        if ok is None:
            if len(self.stays) >= 4 * self.max_states:
                self.stays.clear()
            ok = self.stays[key] = self._apart(a, b)
        return ok

    def _step(self, state: int, byte: int) -> int:
        out, last = [], -1
        for node, before in self.live[state]:
            node = self.trie[node].get(byte)
            if node is None:
                continue
            t = self.token_at[node]
            if t >= 0 and last < 0 and (before < 0 or self._stays(before, t)):
                last = t
            if self.trie[node]:
                out.append((node, before))
        out.append((0, last))
        key = tuple(out)
        to = self.numbers.get(key)
        if to is None:
            to = self.numbers[key] = len(self.live)
            self.live.append(key)
            self.goes.append({})
            self.last.append(last)
        self.goes[state][byte] = to
        return to

    def encode_bytes(self, data: bytes) -> list[int]:
        out: list[int] = []
        lasts: list[int] = []  # last token at each place after the tokens emitted so far
        if len(self.live) >= self.max_states:
            self._restart()
        state, room = 0, 8 * self.longest
        for k in range(0, len(data), room):
            state = self._read(state, data[k : k + room], lasts)
            if len(lasts) >= room:
                self._emit(lasts, out)
        self._walk(lasts, len(lasts), out)
        return out

    def _read(self, state: int, data: bytes, lasts: list[int]) -> int:
        goes, last, add = self.goes, self.last, lasts.append
        for byte in data:
            try:
                state = goes[state][byte]
            except KeyError:
                state = self._step(state, byte)
            add(last[state])
        return state

    def _walk(self, lasts: list[int], end: int, out: list[int]) -> None:
        back, at = [], end
        while at:
            t = lasts[at - 1]
            back.append(t)
            at -= self.length_of[t]
        out.extend(reversed(back))

    def _emit(self, lasts: list[int], out: list[int]) -> None:
        """Emits what the ways back from every place within one longest token of the end have in common."""
        at, n = set(range(len(lasts) - self.longest, len(lasts) + 1)), 0
        while len(at) > 1:
            far = max(at)
            at.discard(far)
            at.add(far - self.length_of[lasts[far - 1]] if far else 0)
        (n,) = at
        if n:
            self._walk(lasts, n, out)
            del lasts[:n]

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers; none for an empty or null one."""
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: Iterator[int]) -> Iterator[str]:
        """Text in pieces as the ids come; a character is given out when its last byte is there, broken bytes become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            s = machine.decode(self.bytes_of[i])
            if s:
                yield s
        s = machine.decode(b"", True)
        if s:
            yield s


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file's contents."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t}


#: The largest vocabulary file that is shipped with the tasks.
MAX_BYTES = 64 << 20
_made: dict[str, BytePairTransducer] = {}


def _kept(name: str, sent) -> BytePairTransducer:
    """The worker's transducer of a vocabulary. A function of the module, so that what it keeps outlives the task: closures travel with copies of their globals."""
    if name not in _made:
        _made[name] = BytePairTransducer(read_ranks(sent.value))
    return _made[name]


def _shipped(df: DataFrame, vocabulary: str):
    """A function that gives the tasks their transducer; the file is read here, where it must stand, and travels with them."""
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError("the vocabulary is too large to be shipped")
    return partial(_kept, hashlib.sha256(data).hexdigest(), df.sparkSession.sparkContext.broadcast(data))


def encoded(df: DataFrame, text: str, doc_id: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): one row for each row of ``df``, repeated ones and null ids included; ids is the empty list for null and empty texts. Special tokens' strings
    are ordinary text. Whole texts of any length are encoded, in one narrow stage. ``vocabulary``, a rank file, has to stand on the driver's machine only."""
    src = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    get = _shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = get()
        for b in batches:
            packed = [t.packed(x) for x in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), dtype=np.int64, count=len(packed))) // 4]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return src.mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(df: DataFrame, ids: str = "ids", doc_id: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the text of each list of ids; empty for an empty or null list."""
    src = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).alias("ids"))
    get = _shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = get()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["".join(t.decode(x or [])) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return src.mapInArrow(run, "doc_id bigint, text string")
