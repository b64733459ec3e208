"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding. A tokenization is what the merges produce if and only if each pair
of neighbouring tokens is what the merges produce of the pair's own bytes. So
every prefix of a pre-token has one last token, and a nondeterministic
transducer that guesses token ends needs no more memory than the last tokens
of the bytes that one longest token spans, and places in the vocabulary's trie.
``Transducer`` runs its determinisation: a state is the set of token starts
that are still open (their places in the trie), and transitions, and the tokens
that may end in a state, are made when first taken and kept. Each byte gives the last token
of the bytes so far: the one that may end here and may follow the last token
before it. Tokens are settled, and leave, once all open starts agree on them;
open starts lie at most one longest token back, so that is the lookahead.

Decoding. ``Utf8Machine`` is a UTF-8 automaton whose transitions over whole
tokens are kept, so a stream of ids gives text without holding more than the
bytes of one unfinished character. Tokens that are whole characters leave it
where it is, so runs of them pass at once.

Defined results: null and empty texts have no tokens (the digest of the empty
string); repeated rows each keep a row; texts are encoded in bounded blocks of
pre-tokens, whatever their length; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import chain, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: States, pair verdicts and pre-tokens kept by a worker before it starts anew; results do not depend on them.
KEPT_STATES, KEPT_PAIRS, KEPT_TOKENS = 100_000, 500_000, 300_000
#: Bytes of a pre-token after which its settled tokens leave (twice the longest token at least).
HELD_BYTES = 64
#: Characters of a text above which its pre-tokens are taken in blocks.
LONG_TEXT = 1_000_000
#: Ids of finished rows after which they leave as one batch.
HELD_IDS = 1_000_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Transducer:
    """Pre-token bytes to ids, as the ranked merges would give them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                at, parent = self.child.get(at << 8 | byte, 0), at
                if not at:
                    at = self.child[parent << 8 | byte] = nodes
                    nodes += 1
            self.ends[at] = rank
        self.inner = {key >> 8 for key in self.child}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(self.length.values(), default=1)
        self.follow: dict[int, tuple[set[int], set[int]]] = {}  # by token: those it may stand after, those it may not
        self.n_pairs = 0
        self.spine: dict[int, tuple[list[int], list[int]] | None] = {}
        self._restart()

    def _restart(self):
        # a state: its transitions by byte, the tokens that may end there, and the open starts' places, earliest first
        self.start = ({}, (), (0,))
        self.states = {((0,), ()): self.start}

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """Ids by merging the neighbours of lowest rank until ``stop`` are left or none can merge."""
        get, never = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [get(a + b, never) for a, b in zip(parts, parts[1:])]
        while len(parts) > stop:
            rank = min(ranks)
            if rank == never:
                break
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], never)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], never)
        return [self.ranks[p] for p in parts]

    def spines(self, token: int):
        """The tokens that begin and those that end ``token`` while it is merged, shortest first; None if merges never give it."""
        known = self.spine.get(token, 0)
        if known == 0:
            data = self.tokens[token]
            if len(data) == 1:
                known = ([token], [token])
            else:
                halves = self.merged(data, 2)
                if len(halves) == 2 and self.merged(data) == [token]:
                    known = (self.spines(halves[0])[0] + [token], self.spines(halves[1])[1] + [token])
                else:
                    known = None
            self.spine[token] = known
        return known

    def _learn(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand after ``last`` (-1: the start), from now on in ``follow``.

        While both are merged, the token that ends ``last`` so far meets the
        one that begins ``token`` so far. They may stand side by side unless
        these two would merge before one of them is merged into its own side.
        """
        if self.n_pairs >= KEPT_PAIRS:
            for yes, no in self.follow.values():
                yes.clear()
                no.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        apart = self._apart(last, token)
        self.follow[token][not apart].add(last)
        return apart

    def _apart(self, last: int, token: int) -> bool:
        right = self.spines(token)
        if right is None or last < 0:
            return right is not None
        left, right = self.spines(last)[1], right[0]
        get, tokens, never = self.ranks.get, self.tokens, 1 << 60
        i = j = 0
        while True:
            across = get(tokens[left[i]] + tokens[right[j]], never)
            to_left = left[i + 1] if i + 1 < len(left) else never
            to_right = right[j + 1] if j + 1 < len(right) else never
            if across < to_left and across <= to_right and across != never:
                return False
            if to_left == to_right == never:
                return True
            if to_left <= to_right:
                i += 1
            else:
                j += 1

    def _move(self, state, byte: int):
        """The state after a byte; a token may start after any byte."""
        there = [to for at in state[2] if (to := self.child.get(at << 8 | byte)) is not None]
        new = (*(to for to in there if to in self.inner), 0)
        tokens = [self.ends[to] for to in there if to in self.ends]
        key = (new, tuple(tokens))
        if key not in self.states:
            ends = tuple((t, -self.length[t], *self.follow.setdefault(t, (set(), set()))) for t in tokens)
            self.states[key] = ({}, ends, new)
        made = state[0][byte] = self.states[key]
        return made

    def __call__(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) >= KEPT_STATES:
            self._restart()
        state, sent, lasts, hold = self.start, [], [-1], max(HELD_BYTES, 2 * self.longest)
        for byte in data:
            state = state[0].get(byte) or self._move(state, byte)
            for token, back, yes, no in state[1]:
                before = lasts[back]
                if before in yes or before not in no and self._learn(before, token):
                    lasts.append(token)
                    break
            if len(lasts) > hold:
                lasts = self._settle(lasts, sent)
                if len(self.states) >= 2 * KEPT_STATES:  # a very long pre-token: keep only where it is
                    self._restart()
                    state = ({}, *state[1:])
        return sent + self._back(lasts, len(lasts) - 1)

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of the first ``end`` bytes; ``lasts``: the token before them, and the last token of each prefix."""
        ids, length = [], self.length
        while end:
            ids.append(lasts[end])
            end -= length[lasts[end]]
        return ids[::-1]

    def _settle(self, lasts: list[int], sent: list[int]) -> list[int]:
        """Send the tokens that no further byte can change; return the rest of ``lasts``, the last token sent first.

        A further token starts at most one longest token back, so what the
        chains of tokens from all those starts have in common is settled.
        """
        ends = set(range(len(lasts) - 1 - self.longest, len(lasts)))
        while len(ends) > 1:
            end = max(ends)
            ends.discard(end)
            ends.add(end - self.length[lasts[end]])
        (common_end,) = ends
        sent += self._back(lasts, common_end)
        return lasts[common_end:]


#: First byte of a character to state; state to (lowest, highest next byte, state after it). 0 is between characters.
_FIRST = [0] * 128 + [None] * 66 + [1] * 30 + [2] + [3] * 12 + [4] + [3] * 2 + [5] + [6] * 3 + [7] + [None] * 11
_NEXT = {
    1: (0x80, 0xBF, 0), 2: (0xA0, 0xBF, 1), 3: (0x80, 0xBF, 1), 4: (0x80, 0x9F, 1),
    5: (0x90, 0xBF, 3), 6: (0x80, 0xBF, 3), 7: (0x80, 0x8F, 3),
}


class Utf8Machine:
    """Ids to text, incrementally; wrong bytes give U+FFFD, one for each longest broken start."""

    def __init__(self, tokens: dict[int, bytes]):
        import numpy as np

        self.tokens = tokens
        self.known: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.held = b""
        # tokens side by side, and where each starts; whole: those that are whole characters
        ids = sorted(tokens)
        self.side = np.frombuffer(b"".join(map(tokens.__getitem__, ids)), np.uint8)
        self.length = np.zeros(max(ids, default=-1) + 1, np.int64)
        self.length[ids] = [len(tokens[i]) for i in ids]
        self.start = np.cumsum(self.length) - self.length
        self.whole = np.zeros(len(self.length), bool)
        self.whole[ids] = [self._is_text(tokens[i]) for i in ids]

    @staticmethod
    def _is_text(token: bytes) -> bool:
        try:
            token.decode()
        except UnicodeDecodeError:
            return False
        return True

    @staticmethod
    def run(held: bytes, data: bytes) -> tuple[str, bytes]:
        """Text of the characters that ``data`` ends, and the bytes of one that it leaves open."""
        state = 0
        for byte in held:
            state = _NEXT[state][2] if state else _FIRST[byte]
        out, piece = [], bytearray(held)
        for byte in data:
            if state:
                low, high, then = _NEXT[state]
                if low <= byte <= high:
                    state = then
                    piece.append(byte)
                    if not state:
                        out.append(piece.decode())
                        piece.clear()
                    continue
                out.append("�")
                piece.clear()
            state = _FIRST[byte]
            if state is None:
                out.append("�")
                state = 0
            elif state:
                piece.append(byte)
            else:
                out.append(chr(byte))
        return "".join(out), bytes(piece)

    def feed(self, ids) -> str:
        out, held, known = [], self.held, self.known
        for i in ids:
            made = known.get((held, i))
            if made is None:
                made = known[held, i] = self.run(held, self.tokens[i])
            text, held = made
            out.append(text)
        self.held = held
        return "".join(out)

    def feed_array(self, ids) -> bytes:
        """``feed`` for an array of ids, as UTF-8: runs of whole-character tokens are put side by side at once."""
        import numpy as np

        out, at = [], 0
        broken = np.flatnonzero(~self.whole[ids]).tolist()
        for stop in [*broken, len(ids)]:
            while self.held and at < len(ids):
                out.append(self.feed((int(ids[at]),)).encode())
                at += 1
            if at < stop:
                run = ids[at:stop]
                size = self.length[run]
                places = np.repeat(self.start[run] - np.cumsum(size) + size, size)
                places += np.arange(len(places))
                out.append(self.side[places].tobytes())
            if at <= stop < len(ids):
                out.append(self.feed((int(ids[stop]),)).encode())
                at = stop + 1
        return b"".join(out)

    def end(self) -> str:
        left, self.held = "�" if self.held else "", b""
        return left


class Kept(dict):
    """Pre-token to its ids, as the bytes of 32-bit integers; repeats are kept."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT_TOKENS:
            self.clear()
        ids = array("i", self.transducer(piece.encode())).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts to ids: pre-tokens by ``pattern``, each through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import numpy as np
        import regex

        self.transducer = Transducer(ranks)
        self.machine = Utf8Machine(self.transducer.tokens)
        self.pattern = regex.compile(pattern)
        self.kept = Kept(self.transducer)
        self.decimals = np.array([b"%d," % i for i in range(max(ranks.values(), default=0) + 1)])

    def blocks(self, text: str):
        """Arrays of ids, each of a bounded run of pre-tokens."""
        import numpy as np

        kept = self.kept.__getitem__
        if len(text) <= LONG_TEXT:
            yield np.frombuffer(b"".join(map(kept, self.pattern.findall(text))), np.int32)
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while piece := list(islice(found, 100_000)):
            yield np.frombuffer(b"".join(map(kept, piece)), np.int32)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids.tolist() for ids in self.blocks(text)))

    def decimal(self, ids) -> bytes:
        """The ids in decimal, with a comma after each."""
        return self.decimals[ids].tobytes().translate(None, b"\0")


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    """The encoder of a rank file's content, one in each process."""
    key = (hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(load_ranks(data), pattern)
    return _ENCODERS[key]


def _encode_batches(ranks, pattern: str, full: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(ranks.value, pattern)
        machine = enc.machine
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * full

        def out(doc_ids, rows, kept):
            n, a, b = (list(x) for x in zip(*rows)) if rows else ([], [], [])
            columns = [doc_ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if full:
                values = np.concatenate([np.empty(0, np.int32), *kept])
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(values)))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch, texts in common.slices(batches, 1):
            rows, kept, size, first = [], [], 0, 0
            for at, data in enumerate(texts):
                ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                for ids in enc.blocks(data.decode("utf-8", "replace")):
                    if len(ids):
                        ids_hash.update(b"," * bool(n))
                        ids_hash.update(memoryview(enc.decimal(ids))[:-1])
                        text_hash.update(machine.feed_array(ids))
                        n += len(ids)
                        if full:
                            kept.append(ids)
                text_hash.update(machine.end().encode())
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
                size += n
                if full and size >= HELD_IDS:
                    yield out(batch.column(0).slice(first, len(rows)), rows, kept)
                    rows, kept, size, first = [], [], 0, at + 1
            yield out(batch.column(0).slice(first), rows, kept)

    return run


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of a public rank file, and the pattern that splits text before its merges."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, full: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and (if ``full``) the ids of each text.

    ``path`` is a rank file that the driver can read; its content, whose size
    is that of a vocabulary, goes to the executors.
    """
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * full
    return rows.mapInArrow(_encode_batches(ranks, pattern, full), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows that hold ids."""
    with open(path, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import pyarrow as pa

        machine = Utf8Machine({rank: token for token, rank in load_ranks(ranks.value).items()})
        for batch in batches:
            texts = [machine.feed(ids or ()) + machine.end() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), *public_vocabulary())
