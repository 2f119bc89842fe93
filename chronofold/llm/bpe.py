"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

**Encoding.** A byte-pair encoding is the one sequence of vocabulary tokens whose every
neighbouring pair the merges leave apart (a *stable* pair). So the token that ends at a byte is
settled by the bytes before it: of the vocabulary tokens that are suffixes there, it is the one
stable with the token settled where it starts. The transducer reads a byte at a time. Its state
is the longest suffix that is a prefix of some token; each state carries the tokens that may end
there. States, their transitions and the stable relation are compiled from the merges when they are
first met, and kept in tables of bounded size. The registers are the tokens settled at the cuts
inside the suffix; what all of them share is settled, so output need wait for no more bytes than
the longest token has. Pieces are short: what is settled is moved out after every 4096 bytes, and the rest at the piece's end.
A piece that is itself a token, and one met lately, needs no walk.

**Decoding.** Each token is compiled, for each state of an incremental UTF-8 machine, into the
text it completes and the state it leaves; these transitions are also made when first met.

The split pattern and the ranks file are parameters. Results equal those of the ordinary merge
procedure: pieces that are themselves tokens are that token; otherwise merges by lowest rank,
leftmost first. Null texts count as empty; invalid UTF-8 decodes to U+FFFD as Python does.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chronofold.llm.common import arrow_map

#: Bounds of the tables that only save time; they are emptied when full.
MAX_PAIRS, MAX_PIECES = 600_000, 400_000
CHUNK = 1 << 20
SHIFT = 20  # bits of a token id in a pair's key


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Bytes of one piece to token ids, in one pass from left to right."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.none, self.begin = max(self.token) + 1, max(self.token) + 2  # a cut where no token can end; the piece's start
        assert self.begin < 1 << SHIFT
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.names = [b""]  # the suffix of each state
        self.states = {b"": 0}
        self.moves: dict[int, int] = {}
        self.endings: list[list[tuple[int, int]]] = [[]]  # tokens that may end in a state, and their sizes, longest first

    def merge(self, piece: bytes) -> list[int]:
        """The merge procedure itself, for compiling the tables."""
        return self._merge(piece)[0]

    def _merge(self, piece: bytes) -> tuple[list[int], tuple[bytes, bytes] | None]:
        parts, last = [piece[k : k + 1] for k in range(len(piece))], None
        ranks = self.ranks
        while len(parts) > 1:
            low, at = None, -1
            for k in range(len(parts) - 1):
                r = ranks.get(parts[k] + parts[k + 1])
                if r is not None and (low is None or r < low):
                    low, at = r, k
            if low is None:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts], last

    def _halves(self, t: int) -> tuple[int, int] | None:
        """The tokens whose merge makes t; (-1, -1) for a byte, None where the merges never make t."""
        if t not in self.halves:
            ids, last = self._merge(self.token[t])
            self.halves[t] = None if ids != [t] else (-1, -1) if last is None else (self.ranks[last[0]], self.ranks[last[1]])
        return self.halves[t]

    def stable(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b apart."""
        if a >= self.none:
            return a == self.begin
        known = self.pairs.get(a << SHIFT | b)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << SHIFT | b] = self._stays_apart(a, b)
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        """Go back through the merges at the boundary, latest first, and look for one across it that was due earlier."""
        token, ranks, inf = self.token, self.ranks, 1 << 60
        left_due = right_due = inf  # ranks of the merges that ended the two parts now at the boundary
        while True:
            across = ranks.get(token[a] + token[b])
            if across is not None and across < left_due and across <= right_due:
                return False
            (_, a_part), (b_part, _) = self._halves(a), self._halves(b)
            if a_part < 0 and b_part < 0:
                return True
            if b_part < 0 or a_part >= 0 and a >= b:
                left_due, a = a, a_part
            else:
                right_due, b = b, b_part

    def _compile(self, state: int, byte: int) -> int:
        """The state after a byte, made if it is new."""
        name = self.names[state] + bytes((byte,))
        while name and name not in self.prefixes:
            name = name[1:]
        known = self.states.get(name)
        if known is None:
            known = self.states[name] = len(self.names)
            self.names.append(name)
            ends = (self.ranks.get(name[k:]) for k in range(len(name)))
            self.endings.append([(t, self.size[t]) for t in ends if t is not None and self._halves(t) is not None])
        self.moves[state << 8 | byte] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        none, last = self.none, [self.begin]  # the token settled at each cut, the first of them behind all that is not yet emitted
        state, n, endings = 0, 0, self.endings
        move, pair, settle = self.moves.get, self.pairs.get, last.append
        for byte in piece:
            n += 1
            to = move(state << 8 | byte)
            state = self._compile(state, byte) if to is None else to
            for t, size in endings[state]:
                before = last[n - size]
                fine = pair(before << SHIFT | t)
                if fine or fine is None and self.stable(before, t):
                    settle(t)
                    break
            else:
                settle(none)
            if n >= 4096:
                self._emit(out, last, len(self.names[state]))
                n = len(last) - 1
        tail = []
        while n > 0:
            t = last[n]
            tail.append(t)
            n -= self.size[t]
        tail.reverse()
        return out + tail

    def _emit(self, out: list[int], last: list[int], open_bytes: int) -> None:
        """Move to ``out`` the tokens that every cut inside the open suffix has behind it."""

        def chain(at: int) -> list[int]:
            cuts = []
            while at > 0:
                cuts.append(at)
                at -= self.size[last[at]]
            return cuts

        ends = [c for c in range(max(1, len(last) - 1 - open_bytes), len(last)) if last[c] != self.none]
        shared = set.intersection(*(set(chain(c)) for c in ends))
        if shared:
            cut = max(shared)
            out.extend(last[c] for c in reversed(chain(cut)))
            del last[:cut]


class Utf8Decoder:
    """Tokens to text, incrementally: bytes of an unfinished character wait in the state."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.moves: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        self.pending = b""
        self.texts: list[str] = []
        self.whole: np.ndarray | None = None

    @staticmethod
    def _open_bytes(data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes could finish."""
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if b >= 0xC0:
                need = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
                if need <= k:
                    return 0
                if k >= 2:  # the second byte's range depends on the first
                    c = data[1 - k]
                    if b == 0xE0 and c < 0xA0 or b == 0xED and c > 0x9F or b == 0xF0 and c < 0x90 or b == 0xF4 and c > 0x8F:
                        return 0
                return k
            if b < 0x80:
                return 0
        return 0

    def push_array(self, ids: np.ndarray) -> str:
        """As push, for many ids: runs of tokens that are whole characters are looked up together."""
        if self.whole is None:
            self.texts, self.whole = [""] * (max(self.token) + 1), np.zeros(max(self.token) + 1, bool)
            for t, data in self.token.items():
                if not self._open_bytes(data):
                    self.texts[t], self.whole[t] = data.decode("utf-8", "replace"), not 0x80 <= data[0] < 0xC0
        out, at = [], 0
        breaks = np.flatnonzero(~self.whole[ids]).tolist()
        get, listed = self.texts.__getitem__, ids.tolist()
        for k in breaks:
            if k < at:
                continue
            if k > at and self.pending:
                out.extend(self.push(listed[at : at + 1]))
                at += 1
            out.extend(map(get, listed[at:k]))
            at = k
            while at < len(listed) and (at == k or self.pending):
                out.extend(self.push(listed[at : at + 1]))
                at += 1
        if self.pending and at < len(listed):
            out.extend(self.push(listed[at : at + 1]))
            at += 1
        out.extend(map(get, listed[at:]))
        return "".join(out)

    def push(self, ids: Iterable[int]) -> Iterator[str]:
        pending, moves = self.pending, self.moves
        for t in ids:
            move = moves.get((pending, t))
            if move is None:
                data = pending + self.token[t]
                keep = self._open_bytes(data)
                move = (data[len(data) - keep :], data[: len(data) - keep].decode("utf-8", "replace"))
                if len(moves) < MAX_PAIRS:
                    moves[pending, t] = move
            pending, text = move
            yield text
        self.pending = pending

    def finish(self) -> str:
        text, self.pending = self.pending.decode("utf-8", "replace"), b""
        return text


def _latin_pattern(pattern: str) -> re.Pattern | None:
    """The split pattern with its Unicode classes spelled out for texts below U+0100, for the faster standard matcher.

    None where the pattern has constructs other than \\p{L}, \\p{N} and \\s, which differ between the two.
    """
    spelled = pattern
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        found = regex.compile(name)
        chars = [c for c in map(chr, range(256)) if found.match(c)]
        inside = "".join(f"\\x{ord(c):02x}" for c in chars)
        outside = rf"[{inside}]"
        parts, in_class, k = [], False, 0
        while k < len(spelled):
            if spelled.startswith(name, k):
                parts.append(inside if in_class else outside)
                k += len(name)
                continue
            if spelled.startswith(r"\S", k) and name == r"\s" and not in_class:
                parts.append(rf"[^{inside}]")
                k += 2
                continue
            c = spelled[k]
            if c == "\\":
                parts.append(spelled[k : k + 2])
                k += 2
                continue
            in_class = c == "[" or in_class and c != "]"
            parts.append(c)
            k += 1
        spelled = "".join(parts)
    return None if re.search(r"\\[pPwWdDsSbB]", spelled) else re.compile(spelled)


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern, self.latin = regex.compile(pattern), _latin_pattern(pattern)
        self.pieces: dict[str, bytes] = {}
        self.packed = {r: r.to_bytes(4, "little") for r in self.transducer.token}
        self._decoder = Utf8Decoder(self.transducer.token)
        self._decoder.push_array(np.zeros(0, np.int64))

    def _split(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches, in lists of bounded length."""
        p = self.pattern
        if self.latin is not None:
            try:
                text.encode("latin-1")
                p = self.latin
            except UnicodeEncodeError:
                pass
        if len(text) <= CHUNK:
            yield p.findall(text)
            return
        found = (m.group() for m in p.finditer(text))
        while some := list(islice(found, CHUNK // 8)):
            yield some

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces, out = self.pieces, []
        for found in self._split(text):
            got = list(map(pieces.get, found))
            if None in got:
                for k, g in enumerate(got):
                    if g is None:
                        got[k] = self._new_piece(found[k])
            out.append(b"".join(got))
        return b"".join(out)

    def _new_piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is not None:
            return known
        packed = b"".join(map(self.packed.__getitem__, self.transducer.encode(piece.encode("utf-8", "surrogatepass"))))
        if len(piece) <= 64:
            if len(self.pieces) >= MAX_PIECES:
                self.pieces.clear()
            self.pieces[piece] = packed
        return packed

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), "<u4").tolist()

    def decoder(self) -> Utf8Decoder:
        d = Utf8Decoder(self.transducer.token)
        d.moves, d.texts, d.whole = self._decoder.moves, self._decoder.texts, self._decoder.whole
        return d

    def decode(self, ids: Iterable[int]) -> str:
        d = self.decoder()
        return d.push_array(np.fromiter(ids, np.int64)) + d.finish()


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a ranks file, built once in each Python worker."""
    return Tokenizer(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = False, passing: list[str] | None = None) -> DataFrame:
    """Token counts and digests of each text's ids and of their decoding; a map without shuffle.

    ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` follow the other columns of ``docs``
    (``passing`` chooses them); ``with_ids`` adds ``ids``, an array of integers.
    """
    made = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    passing = [c for c in (docs.columns if passing is None else passing) if c not in made and (passing is not None or c != text_col)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passing] + ["n_tokens bigint, ids_sha256 string, decoded_sha256 string"] + ["ids array<int>"] * with_ids)

    def run(batch: dict) -> dict:
        tok = tokenizer(path, pattern)
        n, a, b, ids = [], [], [], []
        for text in batch[text_col].to_pylist():
            packed = tok.encode_bytes(text or "")
            got = np.frombuffer(packed, "<u4")
            n.append(len(got))
            a.append(hashlib.sha256(packed).hexdigest())
            digest, dec = hashlib.sha256(), tok.decoder()
            for k in range(0, len(got), CHUNK):
                digest.update(dec.push_array(got[k : k + CHUNK]).encode("utf-8", "surrogatepass"))
            digest.update(dec.finish().encode("utf-8"))
            b.append(digest.hexdigest())
            if with_ids:
                ids.append(got.astype(np.int32))
        out = {c: batch[c] for c in passing} | {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b}
        if with_ids:
            out["ids"] = pa.array(ids, pa.list_(pa.int32()))
        return out

    return arrow_map(docs.select(*dict.fromkeys([*passing, text_col])), run, schema)
