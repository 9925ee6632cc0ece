"""Byte-level BPE by a lazily determinised finite-state transducer.

Of every prefix of a byte string, the byte-pair merges fix one last token, and a
token may follow another only if merging both their bytes gives just these two.
So an encoder may read bytes from left to right: a *live start* is a place from
which some token could still be completed, with its node in the token trie and
the tokens up to it. Tokens that all live starts agree on can no longer change and
are emitted; the lookahead is at most the longest token. Behind an emitted token the
merges begin afresh, so the set of live starts without the emitted tokens is all
that the future depends on: a state. States and their transitions are made when a
text first needs them and looked up afterwards.

Decoding joins the tokens' bytes and passes them through an incremental UTF-8
state machine that yields whole characters, whatever the tokens cut through.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States and pieces kept by a worker; beyond it they are forgotten and made anew.
MOST_STATES = 120_000
MOST_PIECES = 500_000
#: Texts are split and tokens joined this many at a time.
MOST_TOKENS = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge_bytes(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    """Merge the adjacent pair of lowest rank, the leftmost of equals, until none is a token."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Encoder of single pieces for one vocabulary; all 256 single bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelled = {rank: token for token, rank in ranks.items()}
        self.step: dict[tuple[int, int], int] = {}  # trie: (node, byte) -> node
        self.token: dict[int, int] = {}  # trie node -> token
        nodes = 0
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                child = self.step.get((node, byte))
                if child is None:
                    nodes += 1
                    child = self.step[node, byte] = nodes
                node = child
            self.token[node] = rank
        self.inner = {node for node, _ in self.step}  # nodes that some longer token passes
        self.sound: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.ends: list[tuple[int, ...]] = []
        self._state(((0, ()),))

    def _state(self, state: tuple) -> int:
        number = self.known.get(state)
        if number is None:
            number = self.known[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.ends.append(next((path for node, path in state if node == 0), ()))
        return number

    def _is_sound(self, token: int) -> bool:
        if token not in self.sound:
            self.sound[token] = len(merge_bytes(self.ranks, self.spelled[token])) == 1
        return self.sound[token]

    def _may_follow(self, left: int, right: int) -> bool:
        key = left, right
        if key not in self.pairs:
            a, b = self.spelled[left], self.spelled[right]
            self.pairs[key] = merge_bytes(self.ranks, a + b) == [a, b]
        return self.pairs[key]

    def _move(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        following, ended = [], None
        for node, path in self.states[number]:  # the longest first
            child = self.step.get((node, byte))
            if child is None:
                continue
            token = self.token.get(child)
            if ended is None and token is not None and self._is_sound(token) and (not path or self._may_follow(path[-1], token)):
                ended = path + (token,)
            if child in self.inner:
                following.append((child, path))
        following.append((0, ended))
        paths = [path for _, path in following]
        shared, least = 0, min(map(len, paths))
        while shared < least and all(path[shared] == paths[0][shared] for path in paths):
            shared += 1
        out = paths[0][:shared]
        state = tuple((node, path[shared:]) for node, path in following)
        move = self._state(state), out
        self.moves[number][byte] = move
        return move

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > MOST_STATES:
            self._forget()
        ids, state = [], 0
        for byte in piece:
            move = self.moves[state].get(byte)
            if move is None:
                move = self._move(state, byte)
            state = move[0]
            if move[1]:
                ids.extend(move[1])
        ids.extend(self.ends[state])
        return ids


class Pieces(dict):
    """Encoded pieces (packed little-endian ids) seen lately."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MOST_PIECES:
            self.clear()
        packed = np.array(self.transducer.encode(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class Codec:
    """Encodes whole texts and decodes id streams; split by ``pattern``, no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = Pieces(Transducer(ranks))
        self.split = regex.compile(pattern)
        self.spelled = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.spelled[rank] = token

    def encode(self, text: str) -> bytes:
        """Packed little-endian 32-bit ids."""
        if len(text) < 1 << 20:
            return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))
        packed, part = [], []
        for match in self.split.finditer(text):
            part.append(self.pieces[match.group()])
            if len(part) == MOST_TOKENS:
                packed.append(b"".join(part))
                part = []
        return b"".join(packed + part)

    def decode(self, packed: bytes):
        """(bytes, text) chunks; text holds the characters completed by then."""
        machine, ids = Utf8Machine(), np.frombuffer(packed, "<u4")
        for at in range(0, len(ids), MOST_TOKENS):
            data = b"".join(map(self.spelled.__getitem__, ids[at : at + MOST_TOKENS].tolist()))
            yield data, machine.feed(data)
        yield b"", machine.close()


def _utf8_table() -> list[list[int]]:
    """Transitions by the well-formed byte sequences of UTF-8.

    0: between characters; 1-3: so many plain continuation bytes to come; 4-7: the
    next byte is narrowed by the lead byte E0, ED, F0 or F4; 8: not UTF-8.
    """
    table = [[8] * 256 for _ in range(9)]
    tail = range(0x80, 0xC0)
    rows = [
        (0, range(0x80), 0), (0, range(0xC2, 0xE0), 1), (0, range(0xE1, 0xF0), 2), (0, range(0xF1, 0xF4), 3),
        (0, [0xE0], 4), (0, [0xED], 5), (0, [0xF0], 6), (0, [0xF4], 7),
        (1, tail, 0), (2, tail, 1), (3, tail, 2),
        (4, range(0xA0, 0xC0), 1), (5, range(0x80, 0xA0), 1), (6, range(0x90, 0xC0), 2), (7, range(0x80, 0x90), 2),
    ]
    for state, byte_range, to in rows:
        for byte in byte_range:
            table[state][byte] = to
    return table


_UTF8 = _utf8_table()


class Utf8Machine:
    """Incremental UTF-8: keeps the bytes of an unfinished character back; bad bytes give U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        end = len(data)
        # only the last three bytes can belong to an unfinished character
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                state = 0
                for one in data[-back:]:
                    state = _UTF8[state][one]
                if state not in (0, 8):
                    end = len(data) - back
                break
        self.held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids, n_chars, ids_sha256, decoded_sha256) of every row.

    ``ids`` are packed little-endian unsigned 32-bit integers; n_chars counts the
    characters of the decoded text. Null and empty texts have no tokens. Repeated
    rows are encoded each; only id and text are read, whatever else there is. The
    vocabulary is broadcast: it is a fixed file, not data.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    mark = hash((len(ranks), pattern, max(ranks.items(), default=None)))

    def run(batches):
        codec = _codecs.get(mark)
        if codec is None:
            _codecs.clear()
            codec = _codecs[mark] = Codec(*shared.value)
        for batch in batches:
            out = []
            for one in batch.column(1):
                packed = codec.encode(one.as_py() or "")
                sha, chars = hashlib.sha256(), 0
                for data, part in codec.decode(packed):
                    sha.update(data)
                    chars += len(part)
                out.append((len(packed) // 4, packed, chars, hashlib.sha256(packed).hexdigest(), sha.hexdigest()))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
            for at in range(0, batch.num_rows, 256):  # ids of a few texts at a time
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + 256], *(pa.array(c[at : at + 256], k) for c, k in zip(columns, kinds))],
                    ["id", "n_tokens", "ids", "n_chars", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, n_chars long, ids_sha256 string, decoded_sha256 string")
