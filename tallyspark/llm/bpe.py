"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Every prefix of a byte string has one BPE encoding, and that of a longer prefix is that of some shorter one and one
more token; a token may follow another if BPE leaves the two as they are when it encodes their joined bytes. Read
from left to right, that is a transducer whose configurations are the prefixes that can still be continued: the place
in the token trie of the bytes since then, the prefix's last token, and the tokens not yet written. Its determinised
states are sets of such configurations, built when a text first needs them. Tokens that all configurations share are
written at once, so the lookahead is bounded by the longest token that is still possible.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: States, pairs and pieces that a worker keeps; beyond, it starts anew, with the same results.
STATES_KEPT = 240_000
STATE_BITS = 30
LAST_STATE = (1 << STATE_BITS) - 1
PAIR_BITS = 28
PIECES_KEPT = 250_000
PIECE_CHARS = 48
IDS_AT_A_TIME = 4096
#: Characters of a text from which on its pieces are taken PIECES_AT_A_TIME.
LONG_TEXT = 1 << 20
PIECES_AT_A_TIME = 1 << 16


def merge_order(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[int]:
    """BPE by its definition: merge the lowest-ranked neighbours, leftmost first, until none (or `least`) is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        #: The trie: by node and byte, the node below; whether a node has any below it; its token.
        self.below: dict[int, int] = {}
        self.inner = bytearray(1)
        self.token_at: list[int] = [-1]
        self.halves: dict[int, tuple[int, int]] = {}
        self.in_order = True
        self.states_kept = STATES_KEPT
        for token, rank in ranks.items():
            if len(token) > 1:
                halves = merge_order(token, ranks, 2)
                if len(halves) != 2:
                    continue  # BPE never makes it; only a piece that equals it gets it
                self.halves[rank] = (halves[0], halves[1])
                self.in_order &= all(len(self.tokens[h]) == 1 or h < rank for h in halves)
            node = 0
            for b in token:
                to = self.below.get(node << 8 | b)
                if to is None:
                    to = self.below[node << 8 | b] = len(self.token_at)
                    self.inner[node] = 1
                    self.inner.append(0)
                    self.token_at.append(-1)
                node = to
            self.token_at[node] = rank
        self.clear()

    def clear(self) -> None:
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        #: A state's number by its configurations as 4-byte ints: for each its trie node, last token, number of pending
        #: tokens and pending tokens.
        self.numbers: dict[bytes, int] = {array("i", (0, -1, 0)).tobytes(): 0}
        self.states = list(self.numbers)
        #: By state and byte, the number of what is written and of the state after it.
        self.moves: dict[int, int] = {}
        self.outs: list[tuple[int, ...]] = [()]
        self.out_numbers: dict[tuple[int, ...], int] = {(): 0}

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The tokens at one end of a token while BPE builds it, smallest first, each with the rank that ends it."""
        found = self.edges[side].get(token)
        if found is None:
            chain, t, until = [], token, 1 << 60
            while True:
                chain.append((self.tokens[t], until))
                if t not in self.halves:
                    break
                until = t
                t = self.halves[t][side]
            found = self.edges[side][token] = chain[::-1]
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are: no merge across them comes before those that build them."""
        if left < 0:
            return True
        pair = left << PAIR_BITS | right
        known = self.pairs.get(pair)
        if known is None:
            if self.in_order:
                before, after, rank = self._edge(left, 1), self._edge(right, 0), self.ranks.get
                i = j = 0
                known = True
                while True:
                    (a, a_until), (b, b_until) = before[i], after[j]
                    across = rank(a + b)
                    if across is not None and across < a_until and across <= b_until:  # equal ranks: leftmost first
                        known = False
                        break
                    if a_until <= b_until:
                        i += 1
                        if i == len(before):
                            break
                    else:
                        j += 1
            else:
                known = merge_order(self.tokens[left] + self.tokens[right], self.ranks) == [left, right]
            self.pairs[pair] = known
        return known

    def step(self, state: int, byte: int) -> int:
        """The move from a state with one more byte: the tokens that are certain by then and the state after it."""
        flat, below, inner, token_at = tuple(array("i", self.states[state])), self.below, self.inner, self.token_at
        alive, ended, at = [], None, 0
        while at < len(flat):
            node, end = flat[at], at + 3 + flat[at + 2]
            to = below.get(node << 8 | byte)
            if to is not None:
                if inner[to]:
                    alive.append((to, flat[at + 1], flat[at + 3 : end]))
                token = token_at[to]
                if token >= 0 and ended is None and self.may_follow(flat[at + 1], token):
                    ended = (0, token, (*flat[at + 3 : end], token))
            at = end
        alive.append(ended)
        written = alive[0][2]
        for _, _, pending in alive:
            while written and written != pending[: len(written)]:
                written = written[:-1]
        shared, after_flat = len(written), []
        for node, last, pending in alive:
            after_flat += (node, last, len(pending) - shared)
            after_flat += pending[shared:]
        key = array("i", after_flat).tobytes()
        after = self.numbers.setdefault(key, len(self.states))
        if after == len(self.states):
            self.states.append(key)
        move = after
        if written:
            out = self.out_numbers.setdefault(written, len(self.outs))
            if out == len(self.outs):
                self.outs.append(written)
            move |= out << STATE_BITS
        self.moves[state << 8 | byte] = move
        return move

    def last_pending(self, state: int) -> tuple[int, ...]:
        """The tokens not yet written of the configuration in which the input may end, which is the last one."""
        flat, at = tuple(array("i", self.states[state])), 0
        while True:
            end = at + 3 + flat[at + 2]
            if end == len(flat):
                return flat[at + 3 :]
            at = end

    def encode(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        if len(self.states) > self.states_kept or len(self.pairs) > self.states_kept * 2:
            self.clear()
        state, written, move, step, outs = 0, [], self.moves.get, self.step, self.outs
        for b in piece:
            to = move(state << 8 | b)
            if to is None:
                to = step(state, b)
            state = to & LAST_STATE
            if to > LAST_STATE:
                written += outs[to >> STATE_BITS]
        written += self.last_pending(state)
        return written


def _utf8_moves() -> np.ndarray:
    """The UTF-8 state machine, by state and byte. State 0 is between characters; the others say which continuation
    bytes are still to come. A byte that its state has no place for is ill-formed and is read again from state 0."""
    ranges = {0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
              1: [(0x80, 0xBF, 0)], 2: [(0x80, 0xBF, 1)], 3: [(0x80, 0xBF, 2)],
              4: [(0xA0, 0xBF, 1)], 5: [(0x80, 0x9F, 1)], 6: [(0x90, 0xBF, 2)], 7: [(0x80, 0x8F, 2)]}
    moves = np.zeros((8, 256), np.uint8)
    for state in range(8):
        moves[state] = moves[0]
        for low, high, to in ranges[state]:
            moves[state, low : high + 1] = to
    return moves


UTF8_MOVES = _utf8_moves()


def token_moves(tokens: list[bytes]) -> np.ndarray:
    """The state after each token from each state [token, state]."""
    sizes = np.array(list(map(len, tokens)), np.int64)
    data, start = np.frombuffer(b"".join(tokens) or b"\0", np.uint8), np.cumsum(sizes) - sizes
    out = np.tile(np.arange(8, dtype=np.uint8), (sizes.size, 1))
    for k in range(int(sizes.max(initial=0))):
        more = np.flatnonzero(sizes > k)
        out[more] = UTF8_MOVES[out[more], data[start[more] + k][:, None]]
    return out


class Utf8Stream:
    """Decodes bytes that arrive in any portions by the state machine; an unfinished character waits for its other bytes.

    take() returns bytes, all of them in the end and unchanged, also those that are no UTF-8; feed() returns text, with
    the replacement character for what is ill-formed.
    """

    def __init__(self) -> None:
        self.state, self.waiting = 0, b""

    def take(self, data: bytes, state: int | None = None) -> bytes:
        """The bytes up to the end of the last whole character; `state`: that after these bytes, if it is known."""
        if state is None:
            state, moves = self.state, _MOVES_BY_STATE
            for b in data:
                state = moves[state][b]
        self.state = state
        data = self.waiting + data
        cut = len(data)
        if state:  # inside a character: it began with the last byte that is no continuation
            while data[cut - 1] & 0xC0 == 0x80:
                cut -= 1
            cut -= 1
        self.waiting = data[cut:]
        return data[:cut]

    def rest(self) -> bytes:
        rest, self.waiting, self.state = self.waiting, b"", 0
        return rest

    def feed(self, data: bytes) -> str:
        return self.take(data).decode("utf-8", "replace")

    def close(self) -> str:
        return self.rest().decode("utf-8", "replace")


_MOVES_BY_STATE = [tuple(x) for x in UTF8_MOVES.tolist()]


class Tokenizer:
    """Encodes and decodes whole texts; pieces seen before come from a bounded memory."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.transducer = Transducer(ranks)
        self.pieces_kept = PIECES_KEPT
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.each_piece = regex.compile(public_tokenizers.PATTERN).finditer
        self.written: dict[str, str] = {}
        self.older: dict[str, str] = {}
        most = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * most
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.moves = token_moves(self.bytes_of)
        self.opens = self.moves[:, 0] != 0

    def _write(self, piece: str) -> str:
        ids = self.older.get(piece) or ",".join(map(str, self.transducer.encode(piece.encode())))
        if len(piece) <= PIECE_CHARS:
            self.written[piece] = ids
        return ids

    def _trim(self) -> None:
        if len(self.written) >= self.pieces_kept // 2:  # what is still in use moves over from the older half
            self.older, self.written = self.written, {}

    def encode(self, text: str) -> str:
        """The token ids in decimal, joined by commas."""
        return ",".join(self.encoded(text))

    def encoded(self, text: str) -> Iterator[str]:
        """The token ids in decimal, joined by commas, in portions; a long text is cut into pieces bit by bit."""
        if len(text) <= LONG_TEXT:
            self._trim()
            get, write = self.written.get, self._write
            if found := [get(p) or write(p) for p in self.pieces(text)]:
                yield ",".join(found)
            return
        every = (m[0] for m in self.each_piece(text))
        while some := list(islice(every, PIECES_AT_A_TIME)):
            self._trim()
            get, write = self.written.get, self._write
            yield ",".join([get(p) or write(p) for p in some])

    def decode(self, ids: str) -> Iterator[str]:
        """The text of comma-joined ids, in portions of whole characters."""
        for part in self.decoded(np.fromstring(ids, np.int64, sep=",") if ids else np.zeros(0, np.int64)):
            yield part.decode("utf-8", "replace")

    def decoded(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of ids, in portions of whole characters. The state machine runs by tokens: most neither begin nor end
        inside a character, so it looks only at those that leave one open and what follows them."""
        stream, look, moves = Utf8Stream(), self.bytes_of, self.moves
        for k in range(0, ids.size, IDS_AT_A_TIME):
            own = ids[k : k + IDS_AT_A_TIME]
            state, at = stream.state, 0
            opening = np.flatnonzero(self.opens[own])
            while True:
                if state == 0:
                    later = np.searchsorted(opening, at)
                    if later == opening.size:
                        break
                    at = int(opening[later])
                while at < own.size:
                    state = int(moves[own[at], state])
                    at += 1
                    if state == 0:
                        break
                if at == own.size:
                    break
            yield stream.take(b"".join([look[i] for i in own.tolist()]), state)
        yield stream.rest()


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t}


_LOADED: dict[bytes, Tokenizer] = {}


def _tokenizer(data: bytes, kept: float = 1.0) -> Tokenizer:
    """The worker's tokenizer; `kept` scales what it remembers, for this and later tasks."""
    key = hashlib.sha256(data).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(read_ranks(data))
    found = _LOADED[key]
    found.pieces_kept, found.transducer.states_kept = int(PIECES_KEPT * kept), int(STATES_KEPT * kept)
    return found


def _broadcast(docs: DataFrame, vocabulary: str | None):
    return docs.sparkSession.sparkContext.broadcast(Path(vocabulary or public_tokenizers.path(VOCABULARY)).read_bytes())


def _encode_rows(vocabulary, kept):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary.value, kept)
        sha = hashlib.sha256
        for batch in batches:
            every, counts, digests, decoded = [], [], [], []
            for value in batch.column("text"):
                own, written = [], sha()
                for part in tokenizer.encoded(value.as_py() or ""):
                    written.update(("," if own else "").encode() + part.encode())
                    own.append(np.fromstring(part, np.int32, sep=","))
                ids = own[0] if len(own) == 1 else np.concatenate([np.zeros(0, np.int32), *own])
                every.append(ids)
                counts.append(ids.size)
                digests.append(written.hexdigest())
                back = sha()
                for part in tokenizer.decoded(ids):
                    back.update(part)
                decoded.append(back.hexdigest())
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            tokens = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(every) if every else np.zeros(0, np.int32)))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "ids": tokens, "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()),
            })

    return rows


def encode_documents(docs: DataFrame, vocabulary: str | None = None, kept: float = 1.0) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) for every row of `docs`: the token ids, their number and
    the digests of the ids in decimal, joined by commas, and of the bytes they decode to.

    `vocabulary` is the path of a rank file on the driver, which reads and broadcasts it (its size is that of the
    vocabulary, whatever the input). `kept` scales the states and pieces that a worker remembers: less memory for more
    time, with the same results. Null counts as the empty text, with no tokens; long texts are encoded in portions;
    repeated rows each get a row; an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(_encode_rows(_broadcast(docs, vocabulary), kept), "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _decode_rows(vocabulary):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary.value)
        for batch in batches:
            ids = batch.column("ids")
            own = [ids[i].values.to_numpy() if ids[i].is_valid and len(ids[i]) else np.zeros(0, np.int32) for i in range(len(ids))]
            texts = ["".join([part.decode("utf-8", "replace") for part in tokenizer.decoded(x)]) for x in own]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows


def decode_documents(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) for every row of `tokens` (doc_id, ids), as encode_documents gives them; no ids give the empty text."""
    picked = tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return picked.mapInArrow(_decode_rows(_broadcast(tokens, vocabulary)), "doc_id long, text string")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """encode_documents of all `documents`, without the ids; its edge cases hold."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
