"""Language-model scoring with a small causal self-attention model in numpy.

A text is its words (A-Z lowered, split at white space), each written in
subword ids of a public vocabulary with a blank before the word, and one end.
The score is the log probability of these ids, each given those before it.

Attention. Ids are leaves of a tree of two steps: CLASSES classes, then up to
LEAVES leaves in each. The most frequent ids have leaves of their own; the rest
share one leaf a class, where an id has its share of the corpus counts. Classes
are of ids that begin a word (and the end), or of others; ids that stand in the
same documents lie in one class. One layer of masked self-attention, whose
weights also depend on the distance, reads the ids of a window; a hidden layer
over what it reads and the present id gives the odds of the next class, and of
the next leaf in it.

Fit. Weights start from some documents (FIT_ROWS); then each part of the table
goes on from there over every id of all documents that may be learned from, in
the windows of scoring, and the weights after all these steps are averaged.
They depend on how the table is split, as the order of steps does.

Counts. All else covers all these documents too: the counts of words, by which
the base score goes; the counts of ids; which frequent ids stand in the same
documents; how often each class begins a word after each class that ends one,
which the odds of classes start from; and how often each sequence of ids that
begins a word goes on with each id or ends. Where such a beginning is known, its
counts and attention are mixed; the shares of the mixture, by how often the
beginning was counted, are estimated on all documents but those that the weights
start from, by the weights before a step that these ids take part in, with each
word itself left out of the counts.

Scoring runs windows of CONTEXT ids over a text. Each begins STRIDE ids after
the one before and scores its last STRIDE ids, so every id is scored once, with
CONTEXT - STRIDE ids of context at least where there are any. Windows of many
texts make one batch.

The HOT most frequent words go to the executors with their counts and ids;
other words are joined with their counts by a shuffle, in which no known word
is frequent. Sequences of ids that begin words go to them too, the NODES most
frequent. Both are chosen by a least count, from a histogram.

Defined results: a null or empty text is one end; repeated rows each keep a
row; a null doc_id is learned from; with nothing to learn from all counts are
zero and all ids alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents (about, at most twice as many) that the weights start from, their training steps, and windows of a step.
FIT_ROWS, STEPS, BATCH, RATE = 1200, 600, 64, 0.012
#: One in so many of these documents does not fit them, but tells after every CHECKED steps how good they are.
APART, CHECKED = 5, 50
CONTEXT, STRIDE, EMBED, WIDTH, HIDDEN = 32, 24, 32, 16, 32
#: Rate of the steps over all documents, of IDS_AT_ONCE ids each.
FIT_RATE = 0.003
#: Classes of ids (the first half begin words) and leaves of a class; both of a size that fits a code of 16 bits.
CLASSES, LEAVES = 32, 32
BEGIN, BLANK = CLASSES * LEAVES, CLASSES * LEAVES + 1
#: Ids of a side with leaves of their own, and places where it is counted what stands together: of these ids, and of the others by class.
SINGLES, PLACES = CLASSES // 2 * (LEAVES - 1), CLASSES * LEAVES
#: Weight, in occurrences, of the classes' own shares where it is counted what follows a class.
SHARED = 20
#: Words and beginnings of words whose counts are sent to the executors, at most.
HOT, NODES = 250_000, 300_000
#: Distinct words a worker holds while it counts, words besides the hot ones whose ids it keeps, and their bytes; results do not depend on them.
HELD, KEPT, KEPT_BYTES = 100_000, 100_000, 4_000_000
#: Bytes of text after which the words counted leave, however few they are.
HELD_BYTES = 64_000_000
#: Windows that attention reads at once, and ids whose classes are found at once.
AT_ONCE, IDS_AT_ONCE = 48, 16_384
#: Documents whose frequent ids are compared at once.
DOCS_AT_ONCE = 512
#: Greatest logarithm (base 2) of the ratios that shares are estimated from, and steps a unit of it.
RANGE, FINE = 40, 8
#: Logits are held under this, so that nothing overflows.
MOST = 60.0

_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_ODD = re.compile(rb"[^ -~\xc3\x80-\x96\x98-\xb6\xb8-\xbf]|  ")
_STEP, _FIRST = 0x9E3779B97F4A7C15, 0x632BE59BD9B4E019  # odd numbers that spread hashes


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def with_ends(texts: list[list[bytes]]) -> list[bytes]:
    """The words of all texts, an empty one after each text."""
    out: list[bytes] = []
    for t in texts:
        out += t
        out.append(b"")
    return out


def ragged(starts, sizes):
    """Places of runs that begin at ``starts`` and have ``sizes``, one run after the other."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _count_batches(batches):
    """Word counts of a partition; the empty word counts the texts (their ends)."""
    import pyarrow as pa

    def out(found):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    found: Counter = Counter()
    size = 0
    for _, texts in common.slices(batches, 0):
        for text in texts:
            found.update(words(text))
        found[b""] += len(texts)
        size += sum(map(len, texts))
        if len(found) > HELD or size > HELD_BYTES:
            yield out(found)
            found, size = Counter(), 0
    if found:
        yield out(found)


#: What a worker holds between tasks: a broadcast's value, and what was made of it.
_KEPT: list = [None, None]


def kept(of, make):
    """What ``make`` makes of a broadcast's value, once a worker; held until something is made of another.

    Functions of tasks call it by its name in this module; a global that they read themselves would be sent along, empty, with each task.
    """
    if _KEPT[0] is not of:
        _KEPT[:] = None, None
        _KEPT[:] = of, make()
    return _KEPT[1]


class Subwords:
    """Ids of words in a public vocabulary; the end is the id after the last."""

    def __init__(self, ranks: bytes, pattern: str):
        import numpy as np
        import tiktoken

        from .bpe import load_ranks

        table = load_ranks(ranks)
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values(), default=-1) + 1
        self.lengths = np.zeros(self.end, np.int64)
        self.begins = np.ones(self.end + 1, bool)
        for token, i in table.items():
            self.lengths[i] = len(token)
            self.begins[i] = token.startswith(b" ")

    def encode(self, found: list[bytes]):
        """Ids of all words, one after the other, and how many each has; the empty word is the end.

        Words of printable ASCII and Latin letters are encoded as one text: the
        pattern starts a piece at each blank, so no id crosses words.
        """
        import numpy as np

        def together(some: list[bytes]):
            joined = b" ".join([b"", *some])
            ids = np.array(self.encoding.encode_ordinary(joined.decode()), np.int32)
            lengths = np.fromiter(map(len, some), np.int64, len(some)) + 1
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(lengths)) + 1
            return ids, np.diff(cuts, prepend=0)

        if found and found[0] and found[-1] and not _ODD.search(b" ".join(found)):
            return together(found)
        plain = np.array([bool(_PLAIN.fullmatch(w)) for w in found], bool)
        sizes = np.ones(len(found), np.int64)
        inner, sizes[plain] = together([w for w, p in zip(found, plain) if p])
        odd = np.flatnonzero(~plain).tolist()
        apart = [self.encoding.encode_ordinary(" " + found[i].decode("utf-8", "replace")) if found[i] else [self.end] for i in odd]
        sizes[odd] = [len(x) for x in apart]
        ids = np.empty(int(sizes.sum()), np.int32)
        starts = np.cumsum(sizes) - sizes
        ids[ragged(starts[plain], sizes[plain])] = inner
        ids[ragged(starts[odd], sizes[odd])] = list(chain.from_iterable(apart))
        return ids, sizes


@lru_cache(maxsize=1)
def subwords(ranks: bytes, pattern: str) -> Subwords:
    """The vocabulary, made once a worker."""
    return Subwords(ranks, pattern)


def nodes_of(ids, sizes):
    """By id: a hash of the word's ids up to it (never zero)."""
    import numpy as np

    starts, longest = np.cumsum(sizes) - sizes, int(sizes.max(initial=0))
    hashes = np.empty(len(ids), np.uint64)
    live, h = np.arange(len(sizes)), np.full(len(sizes), _FIRST, np.uint64)
    for depth in range(longest):
        live = live[sizes[live] > depth]
        at = starts[live] + depth
        x = (h[live] ^ (ids[at].astype(np.uint64) + np.uint64(1))) * np.uint64(_STEP)
        x ^= x >> np.uint64(29)
        x *= np.uint64(_STEP)
        h[live] = hashes[at] = (x ^ (x >> np.uint64(32))) | np.uint64(1)
    return hashes.view(np.int64)


def _node_batches(sent):
    """Words and their counts in; counts of ids (parent null) and of beginnings of words out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sub = subwords(*sent.value)
        total = np.zeros(sub.end + 1, np.int64)
        names = ["node", "parent", "n", "ends"]

        def counted(found: list[bytes], n):
            ids, sizes = sub.encode(found)
            each = np.repeat(n, sizes)
            np.add.at(total, ids, each)
            node = nodes_of(ids, sizes)
            first, last = np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
            parent = np.concatenate([[0], node[:-1]])
            parent[first] = 0
            ends = np.zeros(len(ids), np.int64)
            ends[last] = n
            seen, at, place = np.unique(node, return_index=True, return_inverse=True)
            count, end_count = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
            np.add.at(count, place, each)
            np.add.at(end_count, place, ends)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, parent[at], count, end_count)], names=names)

        held, numbers, size = [], [], 0
        for batch in batches:
            held += batch.column(0).to_pylist()
            numbers.append(batch.column(1).to_numpy())
            size += batch.column(0).nbytes
            if len(held) >= HELD or size >= HELD_BYTES // 4:  # the more words at once, the more beginnings they share
                yield counted(held, np.concatenate(numbers))
                held, numbers, size = [], [], 0
        if held:
            yield counted(held, np.concatenate(numbers))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there), pa.nulls(len(there), pa.int64()), pa.array(total[there]), pa.array(np.zeros(len(there), np.int64))], names=names)

    return run


class Beginnings:
    """How often known beginnings of words were counted, ended there, and went on with known ones."""

    def __init__(self, node, parent, n, ends):
        import numpy as np

        order = np.argsort(node)
        self.node = node[order]
        self.n, self.ends = (np.append(x[order], 0).astype(np.float64) for x in (n, ends))  # the last is of what is not known
        self.on = np.zeros(len(node) + 1)
        at = self.find(parent[order])
        np.add.at(self.on, at[at >= 0], self.n[:-1][at >= 0])
        self.share = np.zeros(64)  # of the counts in the mixture, by the logarithm of how often the beginning was counted

    def find(self, node):
        import numpy as np

        if not len(self.node):
            return np.full(len(node), -1)
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        return np.where(self.node[at] == node, at, -1)

    def parts(self, ids, sizes, without=0):
        """By id: what the counts say of the next event, of known and of other ids, and the bin of the beginning's share.

        ``without``: occurrences of each word itself that are left out. Bin 0 is of what is not known.
        """
        import numpy as np

        if not len(ids):
            return np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        at = self.find(nodes_of(ids, sizes))
        last = np.zeros(len(ids), bool)
        last[np.cumsum(sizes) - 1] = True
        n = np.where(at >= 0, self.n[at] - without, 0)
        next_at = np.where(last, -1, np.append(at[1:], -1))
        rest = self.n[at] - self.ends[at] - self.on[at]
        known = np.where(next_at >= 0, self.n[next_at] - without, 0)
        other = np.where(last, self.ends[at] - without, np.where(next_at >= 0, rest, rest - without))
        with np.errstate(divide="ignore", invalid="ignore"):
            known, other = (np.where(n > 0, np.maximum(0, x) / n, 0) for x in (known, other))
        return known, other, np.where(n > 0, 1 + np.log2(np.maximum(n, 1)).astype(np.int64), 0)

    def mixed(self, ids, sizes):
        """By id, in columns: probability that the counts give the next event, and factors of attention within its side and in all."""
        import numpy as np

        known, other, bins = self.parts(ids, sizes)
        share = self.share[bins]
        return np.stack([share * known, share * other, 1 - share], axis=1).astype(np.float32)


def frequent(counts, side):
    """Ids of a side that have leaves of their own, the most frequent first, and its others."""
    import numpy as np

    own = np.flatnonzero(side)
    own = own[np.argsort(-counts[own], kind="stable")]
    most = CLASSES // 2 * (LEAVES - 1)
    return own[:most], own[most:]


class Model:
    """The tree of ids and the weights of attention."""

    def __init__(self, counts, begins, texts=(), seed: int = 11, near=(None, None)):
        """``counts`` of ids (the end is the last), whether each ``begins`` a word, and ids of texts.

        ``near``: for the frequent ids of both sides, instead of texts, how alike the documents are that they stand in.
        """
        import numpy as np

        self.code = np.zeros(len(counts), np.int16)
        self.inside = np.ones(len(counts), np.float32)
        half = CLASSES // 2
        for side in range(2):
            single, rest = frequent(counts, begins == (side == 0))
            if len(single):
                group = self._grouped(single, texts, half, near[side])
                for g in range(half):
                    members = single[group == g]
                    self.code[members] = ((side * half + g) * LEAVES) + np.arange(len(members))
            if len(rest):
                mass = np.cumsum(counts[rest] + 0.5)
                band = np.minimum(half - 1, (mass * half / mass[-1]).astype(np.int64))
                self.code[rest] = (side * half + band) * LEAVES + LEAVES - 1
                self.inside[rest] = (counts[rest] + 0.5) / np.bincount(band, counts[rest] + 0.5, half)[band]
        size = np.bincount(self.code, counts + 0.5, CLASSES * LEAVES).reshape(CLASSES, LEAVES)
        shares = np.maximum(size.sum(axis=1), 1e-9)
        self.shares = (shares / shares.sum()).astype(np.float32)
        self.follow = np.log(np.tile(self.shares, (CLASSES + 1, 1)))
        rng = np.random.default_rng(seed)
        share = lambda *shape: rng.standard_normal(shape) / math.sqrt(shape[0])
        with np.errstate(divide="ignore"):
            leaf = np.maximum(np.log(size / np.maximum(size.sum(axis=1, keepdims=True), 1e-9)), -MOST / 2)
        self.weights = {
            "embed": 0.5 * rng.standard_normal((BEGIN + 2, EMBED)), "q": share(EMBED, WIDTH), "k": share(EMBED, WIDTH),
            "v": share(EMBED, WIDTH), "far": np.zeros(CONTEXT), "read": share(WIDTH, HIDDEN), "here": share(EMBED, HIDDEN),
            "up": np.zeros(HIDDEN), "class": 0.2 * share(HIDDEN, CLASSES), "class_bias": np.zeros(CLASSES),
            "leaf": 0.1 * rng.standard_normal((CLASSES, HIDDEN, LEAVES)) / math.sqrt(HIDDEN), "leaf_bias": leaf,
        }
        self.weights = {k: np.ascontiguousarray(w, np.float32) for k, w in self.weights.items()}

    @staticmethod
    def _grouped(members, texts, groups: int, near=None):
        """Equal groups of ids: halved again and again by the main direction of the documents that they stand in."""
        import numpy as np

        group = np.arange(len(members)) % groups  # without texts the most frequent are kept apart
        if near is None:
            if not len(texts):
                return group
            place = np.full(max(int(members.max()), max((int(t.max()) for t in texts if len(t)), default=0)) + 1, -1)
            place[members] = np.arange(len(members))
            seen = np.stack([np.bincount(place[t][place[t] >= 0], minlength=len(members)) for t in texts]).T.astype(np.float64)
            seen = np.sqrt(seen)
            seen /= np.linalg.norm(seen, axis=1, keepdims=True) + 1e-9
            near = seen @ seen.T

        def halved(own, first, n):
            if n == 1 or not len(own):
                group[own] = first
                return
            part = near[np.ix_(own, own)]
            part = part - part.mean(axis=0) - part.mean(axis=1, keepdims=True) + part.mean()
            direction = np.linalg.eigh(part)[1][:, -1] if len(own) > 1 else np.zeros(len(own))
            order = own[np.argsort(direction * np.sign(direction[np.abs(direction).argmax()] if len(own) else 1), kind="stable")]
            cut = -(-len(order) * (n // 2) // n)
            halved(order[:cut], first, n // 2)
            halved(order[cut:], first + n // 2, n - n // 2)

        there = np.diag(near) > 0
        halved(np.flatnonzero(there), 0, groups)
        room = -(-len(members) // groups) - np.bincount(group[there], minlength=groups)
        group[~there] = np.repeat(np.arange(groups), room)[: (~there).sum()]  # ids that stand nowhere fill the groups up
        return group

    def learn_pairs(self, pairs) -> None:
        """Take how often each class (a row; the last is the beginning of a text) ends a word before each class begins one."""
        import numpy as np

        half = CLASSES // 2
        first = self.shares[:half] / max(1e-9, self.shares[:half].sum())
        each = pairs[:, :half].sum(axis=1, keepdims=True)
        found = (pairs[:, :half] + SHARED * first) / (each + SHARED)
        self.follow[:, :half] = np.log(np.maximum(found, 1e-9) * self.shares[:half].sum())

    def forward(self, codes):
        """Intermediate results for windows of codes (BEGIN before a text, BLANK where there is nothing)."""
        import numpy as np

        w = self.weights
        size = codes.shape[1]
        x = w["embed"][codes]
        q, k, v = x @ w["q"], x @ w["k"], x @ w["v"]
        a = q @ k.transpose(0, 2, 1) / np.float32(math.sqrt(WIDTH))
        away = np.arange(size)[:, None] - np.arange(size)
        a += np.where(away >= 0, w["far"][np.maximum(away, 0)], -1e9)
        a = np.where((codes == BLANK)[:, None, :], -1e9, a)
        a -= a.max(axis=2, keepdims=True)
        a = np.exp(a)
        a /= a.sum(axis=2, keepdims=True)
        z = a @ v
        u = np.maximum(z @ w["read"] + x @ w["here"] + w["up"], 0)
        y = u @ w["class"] + w["class_bias"] + self.follow[np.minimum(codes // LEAVES, CLASSES)]
        y -= y.max(axis=2, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
        return x, q, k, v, a, away, z, u, y

    def gradients(self, codes, targets, weight):
        """Mean loss over positions with weight, and its gradients by backpropagation."""
        import numpy as np

        w = self.weights
        x, q, k, v, a, away, z, u, y = self.forward(codes)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        total = max(1.0, float(weight.sum()))
        goal, share = targets.reshape(-1), weight.reshape(-1) / total
        kind, rows, flat_u, flat_y = goal // LEAVES, np.arange(goal.size), flat(u), flat(y)
        loss = -float((flat_y[rows, kind] * share).sum())
        dy = np.exp(flat_y)
        dy[rows, kind] -= 1
        dy *= share[:, None]
        d = {"class": flat_u.T @ dy, "class_bias": dy.sum(axis=0), "leaf": np.zeros_like(w["leaf"]), "leaf_bias": np.zeros_like(w["leaf_bias"])}
        du = dy @ w["class"].T
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            own = order[cuts[c] : cuts[c + 1]]
            if len(own):
                t = flat_u[own] @ w["leaf"][c] + w["leaf_bias"][c]
                t -= t.max(axis=1, keepdims=True)
                t -= np.log(np.exp(t).sum(axis=1, keepdims=True))
                at, leaf = np.arange(len(own)), goal[own] % LEAVES
                loss -= float((t[at, leaf] * share[own]).sum())
                dt = np.exp(t)
                dt[at, leaf] -= 1
                dt *= share[own, None]
                d["leaf"][c] = flat_u[own].T @ dt
                d["leaf_bias"][c] = dt.sum(axis=0)
                du[own] += dt @ w["leaf"][c].T
        du = du.reshape(u.shape) * (u > 0)
        d["read"], d["here"], d["up"] = flat(z).T @ flat(du), flat(x).T @ flat(du), flat(du).sum(axis=0)
        dz = du @ w["read"].T
        da = dz @ v.transpose(0, 2, 1)
        dv = a.transpose(0, 2, 1) @ dz
        ds = a * (da - (da * a).sum(axis=2, keepdims=True))
        d["far"] = np.bincount(np.maximum(away, 0).reshape(-1), (ds.sum(axis=0) * (away >= 0)).reshape(-1), CONTEXT)
        ds = ds / math.sqrt(WIDTH)
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        for name, t in (("q", dq), ("k", dk), ("v", dv)):
            d[name] = flat(x).T @ flat(t)
        dx = du @ w["here"].T + dq @ w["q"].T + dk @ w["k"].T + dv @ w["v"].T
        d["embed"] = np.zeros_like(w["embed"])
        np.add.at(d["embed"], codes.reshape(-1), flat(dx))
        return loss, d

    def loss(self, texts: list) -> float:
        """Mean loss over the first windows of texts."""
        import numpy as np

        codes = np.full((len(texts), CONTEXT), BLANK, np.int64)
        targets, weight = np.zeros((len(texts), CONTEXT), np.int64), np.zeros((len(texts), CONTEXT), np.float32)
        for row, t in enumerate(texts):
            part = self.code[t[:CONTEXT]]
            codes[row, 0], codes[row, 1 : len(part)], targets[row, : len(part)], weight[row, : len(part)] = BEGIN, part[:-1], part, 1
        return self.gradients(codes, targets, weight)[0]

    def descend(self, grads, first, second, step: int, rate: float) -> None:
        """One step of Adam; ``first`` and ``second`` are its moments."""
        import numpy as np

        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 1 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            fixed = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            self.weights[k] = (self.weights[k] - rate * fixed).astype(np.float32)

    def fit(self, texts: list, check: list = (), seed: int = 5) -> list[float]:
        """Adam over random windows of the texts' ids; the losses. The weights that suit the ``check`` texts best stay."""
        import numpy as np

        rng = np.random.default_rng(seed)
        streams = [np.concatenate([[BEGIN], self.code[t]]).astype(np.int64) for t in texts if len(t)]
        if not streams:
            return []
        chance = np.array([len(s) for s in streams], float)
        chance /= chance.sum()
        first = {k: np.zeros_like(w) for k, w in self.weights.items()}
        second = {k: np.zeros_like(w) for k, w in self.weights.items()}
        losses, best = [], (math.inf, self.weights)
        for step in range(1, STEPS + 1):
            codes = np.full((BATCH, CONTEXT), BLANK, np.int64)
            targets = np.zeros((BATCH, CONTEXT), np.int64)
            weight = np.zeros((BATCH, CONTEXT), np.float32)
            for row, i in enumerate(rng.choice(len(streams), BATCH, p=chance)):
                s = streams[i]
                at = int(rng.integers(0, max(1, len(s) - CONTEXT)))
                part = s[at : at + CONTEXT + 1]
                codes[row, : len(part) - 1], targets[row, : len(part) - 1] = part[:-1], part[1:]
                weight[row, : len(part) - 1] = 1
            loss, grads = self.gradients(codes, targets, weight)
            losses.append(loss)
            self.descend(grads, first, second, step, RATE * min(1, step / 20) * (1 - 0.95 * step / STEPS))
            if len(check) and (step % CHECKED == 0 or step == STEPS):
                best = min(best, (self.loss(check), dict(self.weights)), key=lambda x: x[0])
        if math.isfinite(best[0]):
            self.weights = best[1]
        return losses

    def prepare(self) -> None:
        """What scoring looks up by code: queries, keys, values (with a one, so that weights are summed with them), hidden parts."""
        import numpy as np

        w = self.weights
        self.queries = (w["embed"] @ w["q"] / math.sqrt(WIDTH)).astype(np.float32)
        self.keys = w["embed"] @ w["k"]
        self.values = np.concatenate([w["embed"] @ w["v"], np.ones((BEGIN + 2, 1), np.float32)], axis=1)
        self.values_and_ones = self.values.copy()
        self.values[BLANK] = 0
        self.hidden = w["embed"] @ w["here"] + w["up"]
        away = np.arange(CONTEXT - STRIDE, CONTEXT)[:, None] - np.arange(CONTEXT)
        self.near = np.where(away >= 0, np.exp(np.minimum(w["far"][np.maximum(away, 0)], MOST)), 0).astype(np.float32)
        self.odds = self.follow.astype(np.float32) + w["class_bias"]
        # for slopes, odds of classes and of leaves side by side: products with what the target's class needs, and, by class before and target's class, what is added
        self.tree = np.concatenate([np.broadcast_to(w["class"], w["leaf"].shape), w["leaf"]], axis=2)
        self.more = np.empty((CLASSES + 1, CLASSES, CLASSES + LEAVES), np.float32)
        self.more[:, :, :CLASSES] = self.odds[:, None]
        self.more[:, :, CLASSES:] = w["leaf_bias"]
        self.more = self.more.reshape(-1, CLASSES + LEAVES)
        self.sides = np.zeros((CLASSES + LEAVES, 3), np.float32)  # sums over classes, leaves, and classes that begin words
        self.sides[:CLASSES, 0] = self.sides[CLASSES:, 1] = self.sides[: CLASSES // 2, 2] = 1

    @staticmethod
    def windows(codes, sizes):
        """Windows of texts that stand one after the other, their targets, and by code its place among the targets.

        ``codes`` are those of the ids with their ends, ``sizes`` the lengths of the texts.
        """
        import numpy as np

        windows = -(-sizes // STRIDE)
        blocks = np.cumsum(windows) - windows
        begin = np.cumsum(sizes) - sizes
        late = ragged(blocks * STRIDE, sizes)  # by code, its place among the scored places of all windows
        n = int(windows.sum())
        targets = np.zeros(n * STRIDE, np.int16)
        targets[late] = codes
        # what stands before each scored place, and the codes before a window's first scored place, of the same text
        before = np.full((n + 1) * STRIDE, BLANK, np.int16)
        before[late[1:]] = codes[:-1]
        before[late[begin]] = BEGIN
        late_rows = before[: n * STRIDE].reshape(n, STRIDE)
        lead = np.full((n, CONTEXT - STRIDE), BLANK, np.int16)
        lead[1:] = late_rows[:-1, STRIDE - (CONTEXT - STRIDE) :]
        lead[blocks] = BLANK
        return np.concatenate([lead, late_rows], axis=1), targets, late

    def chances(self, codes, sizes):
        """By code of texts that stand one after the other: its probability by attention, and that of its side."""
        import numpy as np

        w = self.weights
        stream, targets, late = self.windows(codes, sizes)
        n = len(stream)
        chance, side = np.empty(n * STRIDE, np.float32), np.empty(n * STRIDE, np.float32)
        step = max(1, IDS_AT_ONCE // STRIDE)
        sides, ones = np.ones((CLASSES, 2), np.float32), np.ones(LEAVES, np.float32)
        sides[CLASSES // 2 :, 1] = 0
        for cut in range(0, n, step):
            here = stream[cut : cut + step]
            u = np.empty((len(here), STRIDE, HIDDEN), np.float32)
            for at in range(0, len(here), AT_ONCE):
                part = here[at : at + AT_ONCE]
                a = np.take(self.queries, part[:, CONTEXT - STRIDE :], axis=0) @ np.take(self.keys, part, axis=0).transpose(0, 2, 1)
                np.minimum(a, MOST, out=a)
                np.exp(a, out=a)
                a *= self.near
                z = a @ np.take(self.values, part, axis=0)
                z = z[:, :, :-1] / z[:, :, -1:]
                np.matmul(z.reshape(-1, WIDTH), w["read"], out=u[at : at + AT_ONCE].reshape(-1, HIDDEN))
            now = here[:, CONTEXT - STRIDE :].reshape(-1)
            u = u.reshape(-1, HIDDEN)
            u += np.take(self.hidden, now, axis=0)
            np.maximum(u, 0, out=u)
            goal = targets[cut * STRIDE : cut * STRIDE + len(u)]
            kind = goal // LEAVES
            y = u @ w["class"]
            y += np.take(self.odds, np.minimum(now // LEAVES, CLASSES), axis=0)
            np.minimum(y, MOST, out=y)
            np.exp(y, out=y)
            sums = y @ sides  # faster than sums along rows
            first = y[np.arange(len(y)), kind] / sums[:, 0]
            starts = sums[:, 1] / sums[:, 0]
            order = np.argsort(kind, kind="stable")
            cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
            for c in range(CLASSES):
                own = order[cuts[c] : cuts[c + 1]]
                if len(own):
                    t = np.take(u, own, axis=0) @ w["leaf"][c]
                    t += w["leaf_bias"][c]
                    np.minimum(t, MOST, out=t)
                    np.exp(t, out=t)
                    first[own] *= t[np.arange(len(own)), goal[own] % LEAVES] / (t @ ones)
            chance[cut * STRIDE : cut * STRIDE + len(u)] = first
            side[cut * STRIDE : cut * STRIDE + len(u)] = np.where(kind < CLASSES // 2, starts, 1 - starts)
        return chance[late], side[late]

    def tree_odds(self, z, now, targets):
        """The tree at places whose ids read ``z`` and are ``now``, in order of the target's class, in which a class is one product.

        Order, runs of classes, what was read, the codes, the hidden layer, odds of classes and of the class's leaves, their
        sums, and where the targets stand among the odds; in the old order the targets' probabilities and their sides'.
        """
        import numpy as np

        kind = targets // LEAVES
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1, dtype=kind.dtype)).tolist()
        runs = [(c, slice(*cuts[c : c + 2])) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]
        z, now, targets = np.take(z, order, axis=0), np.take(now, order), np.take(targets, order)
        u = z @ self.weights["read"]
        u += np.take(self.hidden, now, axis=0)
        np.maximum(u, 0, out=u)
        y = np.empty((len(u), CLASSES + LEAVES), np.float32)
        for c, own in runs:
            np.matmul(u[own], self.tree[c], out=y[own])
        kind = (targets // LEAVES).astype(np.int64)
        y += np.take(self.more, np.minimum(now // LEAVES, CLASSES) * CLASSES + kind, axis=0)
        np.minimum(y, MOST, out=y)
        np.exp(y, out=y)
        sums = y @ self.sides  # faster than sums along rows
        rows = np.arange(0, y.size, CLASSES + LEAVES)
        at = np.stack([rows + kind, rows + (CLASSES + targets % LEAVES)])
        got, flat = np.empty((2, len(y)), np.float32), y.reshape(-1)
        got[0, order] = np.take(flat, at[0]) * np.take(flat, at[1]) / (sums[:, 0] * sums[:, 1])
        starts = sums[:, 2] / sums[:, 0]
        got[1, order] = np.where(kind < CLASSES // 2, starts, 1 - starts)
        return order, runs, z, now, u, y, sums, at, got[0], got[1]

    def slopes(self, here, targets, there):
        """Probabilities of the targets of successive windows and of their sides, and the gradients of the mean loss, windows as they are scored.

        ``there``: which targets there are. ``prepare`` must have run on the weights.
        """
        import numpy as np

        w, n, lead = self.weights, len(here), CONTEXT - STRIDE
        now, blank = here[:, lead:].reshape(-1), here == BLANK
        odd = blank.any(axis=1)
        a, z = np.empty((n, STRIDE, CONTEXT), np.float32), np.empty((n, STRIDE, WIDTH), np.float32)
        for at in range(0, n, AT_ONCE):
            part, some = here[at : at + AT_ONCE], np.flatnonzero(odd[at : at + AT_ONCE])
            e = np.take(self.queries, part[:, lead:], axis=0) @ np.take(self.keys, part, axis=0).transpose(0, 2, 1)
            np.minimum(e, MOST, out=e)
            np.exp(e, out=e)
            e *= self.near
            e[some] *= ~blank[at + some][:, None, :]
            y = e @ np.take(self.values, part, axis=0)
            total = np.maximum(y[:, :, -1:], np.float32(1e-30))
            np.divide(e, total, out=a[at : at + AT_ONCE])
            np.divide(y[:, :, :-1], total, out=z[at : at + AT_ONCE])
        order, runs, mine, codes, u, y, sums, at, chance, side = self.tree_odds(z.reshape(-1, WIDTH), now, targets)
        share = np.take(there.astype(np.float32) / np.float32(max(1, int(there.sum()))), order)
        y.reshape(-1, 2, LEAVES)[:] *= (share[:, None] / sums[:, :2])[:, :, None]
        y.reshape(-1)[at] -= share
        d = {k: np.zeros(w[k].shape, np.float32) for k in ("class", "class_bias", "leaf", "leaf_bias")}
        du, ones = np.empty_like(u), np.ones(len(u), np.float32)
        for c, own in runs:
            both, bias = u[own].T @ y[own], ones[own] @ y[own]
            d["class"] += both[:, :CLASSES]
            d["class_bias"] += bias[:CLASSES]
            d["leaf"][c], d["leaf_bias"][c] = both[:, CLASSES:], bias[CLASSES:]
            np.matmul(y[own], self.tree[c].T, out=du[own])
        du *= u > 0
        d["read"] = mine.T @ du
        dz = np.empty((n, STRIDE, WIDTH + 1), np.float32)  # with what is taken off all slopes of a place's attention, as values end in a one
        dz.reshape(-1, WIDTH + 1)[order, :-1] = du @ w["read"].T
        dz[:, :, -1] = -np.einsum("nsw,nsw->ns", dz[:, :, :-1], z)
        rows, far = np.empty((n, CONTEXT, 3 * WIDTH), np.float32), np.zeros((STRIDE, CONTEXT))  # of queries, keys and values
        for at in range(0, n, AT_ONCE):
            part, own, seen, out = here[at : at + AT_ONCE], dz[at : at + AT_ONCE], a[at : at + AT_ONCE], rows[at : at + AT_ONCE]
            ds = own @ np.take(self.values_and_ones, part, axis=0).transpose(0, 2, 1)
            ds *= seen
            far += ds.sum(axis=0)
            np.matmul(ds, np.take(self.keys, part, axis=0), out=out[:, lead:, :WIDTH])
            np.matmul(ds.transpose(0, 2, 1), np.take(self.queries, part[:, lead:], axis=0), out=out[:, :, WIDTH : 2 * WIDTH])
            np.matmul(seen.transpose(0, 2, 1), own[:, :, :-1], out=out[:, :, 2 * WIDTH :])
        # a window begins with what the one before ends with, or blank, where nothing is read
        rows[:-1, STRIDE:, WIDTH:] += rows[1:, :lead, WIDTH:]
        by_code = np.zeros((BEGIN + 2, HIDDEN + 3 * WIDTH), np.float32)
        add_by(by_code[:, :HIDDEN], codes, du)
        add_by(by_code[:, HIDDEN:], now, rows.reshape(n * CONTEXT, -1), (np.arange(n)[:, None] * CONTEXT + np.arange(lead, CONTEXT)).reshape(-1))
        np.add.at(by_code[:, HIDDEN + WIDTH :], here[0, :lead], rows[0, :lead, WIDTH:])
        away = np.arange(lead, CONTEXT)[:, None] - np.arange(CONTEXT)
        d["far"] = np.bincount(np.maximum(away, 0).reshape(-1), (far * (away >= 0)).reshape(-1), CONTEXT)
        parts = dict(zip(("here", "q", "k", "v"), np.split(by_code, [HIDDEN, HIDDEN + WIDTH, HIDDEN + 2 * WIDTH], axis=1)))
        parts["q"] = parts["q"] / np.float32(math.sqrt(WIDTH))
        parts["v"][BLANK] = 0
        d["up"] = parts["here"].sum(axis=0)
        d["embed"] = sum(x @ w[k].T for k, x in parts.items())
        d.update((k, w["embed"].T @ x) for k, x in parts.items())
        return chance, side, d


def add_by(out, codes, rows, at=None):
    """Add to ``out``, by code, the rows, or those of them ``at`` places. Rows of a code are summed by fours first, which is faster than ``reduceat`` alone."""
    import numpy as np

    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes, minlength=len(out))
    order = order if at is None else np.take(at, order)
    fours = sizes // 4
    first = np.cumsum(sizes) - sizes
    whole = ragged(first, fours * 4)
    some = np.take(rows, np.take(order, whole), axis=0).reshape(-1, 4, rows.shape[1])
    there = np.flatnonzero(fours)
    if len(there):
        out[there] += np.add.reduceat(some.sum(axis=1), (np.cumsum(fours) - fours)[there], axis=0)
    for k in range(3):  # and the up to three that are left
        there = np.flatnonzero(sizes % 4 > k)
        out[there] += np.take(rows, order[(first + fours * 4)[there] + k], axis=0)


def ratio_cells(bins, known, other, chance, side, at, first):
    """Cells of a histogram, by the beginning's bin, of how much likelier the counts make an event than attention does.

    ``at``: the places of events to count; ``first``: the first place of each text, before which nothing stands.
    """
    import numpy as np

    at = at & ~np.isin(np.arange(len(at)), first)
    at = np.flatnonzero(at)
    ratio = known[at - 1] / np.maximum(chance[at], 1e-30) + other[at - 1] / np.maximum(side[at], 1e-9)
    fine = np.rint(np.log2(np.maximum(ratio, 2.0**-RANGE)) * FINE).astype(np.int64) + RANGE * FINE
    return bins[at - 1] * (2 * RANGE * FINE + 1) + np.minimum(fine, 2 * RANGE * FINE)


def estimate_shares(histogram):
    """Shares of the counts in the mixture by bin, by expectation-maximisation over all events of such a histogram."""
    import numpy as np

    histogram = histogram.reshape(64, -1)
    ratio = np.exp2((np.arange(histogram.shape[1]) - RANGE * FINE) / FINE)
    ratio[0] = 0
    share = np.full((64, 1), 0.5)
    for _ in range(20):
        part = (histogram * (share * ratio / (share * ratio + 1 - share))).sum(axis=1, keepdims=True)
        share = (part + 1) / (histogram.sum(axis=1, keepdims=True) + 2)
    share[0] = 0
    return share[:, 0]


class Known(dict):
    """Word to its row; row 0 is of all others."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Rows(dict):
    """Word to its row; a new word gets the next one."""

    def __init__(self, hot: list[bytes]):
        super().__init__(zip(hot, range(len(hot))))
        self[b""] = len(hot)  # the end
        self.names: list[bytes] = []
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.names.append(word)
        self.size += len(word)
        return at


class Reader:
    """Texts to what is known of their ids: of the hot words, and of others once they are met."""

    def __init__(self, sub: Subwords, hot: list[bytes], figures):
        """``figures``: arrays by id, of ids of words and how many each word has."""
        self.sub, self.hot, self.figures = sub, hot, figures
        self.base = self._parts([*hot, b""])
        self._forget()

    def _forget(self):
        self.rows, self.parts = Rows(self.hot), self.base

    def _parts(self, found: list[bytes]):
        ids, sizes = self.sub.encode(found)
        return (sizes, *self.figures(ids, sizes))

    def read(self, texts: list[list[bytes]]):
        """Words and end of each text, rows of all these, how many ids each has, and the places of their ids in the figures."""
        import numpy as np

        if len(self.rows) > len(self.hot) + KEPT or self.rows.size > KEPT_BYTES:
            self._forget()
        known = len(self.rows.names)
        n_words = np.array([len(t) + 1 for t in texts], np.int64)
        rows = np.array(list(map(self.rows.__getitem__, with_ends(texts))), np.int64)
        if len(self.rows.names) > known:
            self.parts = tuple(map(np.concatenate, zip(self.parts, self._parts(self.rows.names[known:]))))
        sizes = self.parts[0]
        each = sizes[rows]
        return n_words, rows, each, ragged((np.cumsum(sizes) - sizes)[rows], each)


class Scorer(Reader):
    """Texts to their figures."""

    def __init__(self, sub: Subwords, model: Model, found: Beginnings, hot: list[bytes], counts):
        import numpy as np

        self.model, self.found = model, found
        self.logs = np.append(np.log10(counts + 0.5), 0.0)
        super().__init__(sub, hot, lambda ids, sizes: (
            model.code[ids], np.column_stack([found.mixed(ids, sizes), model.inside[ids]])))

    def score(self, texts: list[list[bytes]]):
        """By text: words and end, hot words, their sum of log counts, natural log probability, distinct other words; these, and how often each stands."""
        import numpy as np

        n_words, rows, each, at = self.read(texts)
        n_hot, (_, codes, parts) = len(self.hot), self.parts
        first = np.cumsum(n_words) - n_words
        n_ids = np.add.reduceat(each, first)
        chance, side = self.model.chances(np.take(codes, at), n_ids)
        parts = np.take(parts, at, axis=0)
        chance *= parts[:, 3]
        # an id comes after the one before it; the first of a text certainly begins a word
        begin = np.cumsum(n_ids) - n_ids
        parts[1:] = parts[:-1]
        parts[begin] = 0, 1, 0, 1
        logs = parts[:, 1] / np.maximum(side, 1e-9)
        logs += parts[:, 2]
        logs *= chance
        logs += parts[:, 0]
        logs = np.log(np.maximum(logs, 1e-30))
        total = lambda x, places: np.add.reduceat(x, places, dtype=np.float64)
        # other words, each once a text with how often it stands there
        of, word = np.repeat(np.arange(len(texts)), n_words), rows - n_hot - 1
        rare, times = np.unique((of[word >= 0] << 32) | word[word >= 0], return_counts=True)
        names = [self.rows.names[i] for i in (rare & 0xFFFFFFFF).tolist()]
        return (n_words, total(rows < n_hot, first).astype(np.int64), total(self.logs[np.minimum(rows, n_hot)], first),
                total(logs, begin), np.bincount(rare >> 32, minlength=len(texts)), names, times)


def _score_batches(vocabulary, sent):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        scorer = kept(sent.value, lambda: Scorer(subwords(*vocabulary.value), *sent.value))
        for batch, texts in common.slices(batches, 1):
            n_words, n_hot, sums, logs, n_rare, rare, times = scorer.score([words(t) for t in texts])
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "k"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words), pa.array(n_hot), pa.array(sums), pa.array(logs / math.log(10)),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n_rare]), pa.int32()), pairs),
                ],
                names=["doc_id", "n_tokens", "hot_known", "hot_sum", "score", "rare"],
            )

    return run


def _pair_batches(sent):
    """How often each class (CLASSES: the beginning of a text) ends a word before each begins one, of neighbouring hot words.

    A plain count that ``_place_batches`` is more general than: it reads all words.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hot, first, last = sent.value
        first, last = first.astype(np.int16), last.astype(np.int16)
        rows = Known(zip(hot, range(1, len(hot) + 1)))  # the last is of ends
        rows[b""] = len(hot) + 1
        total = np.zeros((CLASSES + 1) * CLASSES, np.int64)
        for _, texts in common.slices(batches, 0):
            found = [words(t) for t in texts]
            n = np.array([len(t) + 1 for t in found], np.int64)
            at = np.array(list(map(rows.__getitem__, with_ends(found))), np.int32)
            before = np.empty(len(at), np.int16)
            before[1:] = np.take(last, at[:-1])
            before[np.cumsum(n) - n] = CLASSES
            begun = np.take(first, at)
            keep = (before >= 0) & (begun >= 0)
            total += np.bincount(before[keep] * np.int16(CLASSES) + begun[keep], minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["pair", "n"])

    return run


def _place_batches(vocabulary, sent):
    """Of all words: how often each place ends a word before each begins one, and how alike the documents of places are, in 2**-16."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        place, hot = sent.value
        each = SINGLES
        reader = kept(sent.value, lambda: Reader(subwords(*vocabulary.value), hot, lambda ids, sizes: (place[ids],)))
        pairs, near = np.zeros((PLACES + 1) * PLACES, np.int64), np.zeros((2, each, each))
        for _, texts in common.slices(batches, 0):
            found = [words(t) for t in texts]
            n_words, _, sizes, at = reader.read(found)
            here = np.take(reader.parts[1], at)
            stop = np.cumsum(sizes)
            before = np.empty(len(stop), np.int64)
            before[1:] = here[stop[:-1] - 1]
            first = np.cumsum(n_words) - n_words
            before[first] = PLACES
            pairs += np.bincount(before * PLACES + here[stop - sizes], minlength=len(pairs))
            n_ids = np.add.reduceat(sizes, first)
            cuts = np.cumsum(n_ids)
            for i in range(0, len(texts), DOCS_AT_ONCE):
                n = n_ids[i : i + DOCS_AT_ONCE]
                part = here[cuts[i] - n_ids[i] : cuts[i + len(n) - 1]].astype(np.int64)
                seen = np.bincount(np.repeat(np.arange(len(n)), n) * PLACES + part, minlength=len(n) * PLACES)
                seen = np.sqrt(seen.reshape(len(n), PLACES)[:, : 2 * each].astype(np.float32))
                for side in range(2):
                    own = seen[:, side * each : (side + 1) * each]
                    near[side] += own.T @ own
        total = np.concatenate([pairs, np.rint(np.triu(near) * 2.0**16).astype(np.int64).reshape(-1)])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["place", "n"])

    return run


class Fitter:
    """Fits a model's weights to texts as they come, each id once, and counts what the shares of the mixture are estimated from."""

    def __init__(self, model: Model):
        import copy

        import numpy as np

        self.model = copy.copy(model)
        self.model.weights = dict(model.weights)
        self.first = {k: np.zeros_like(w) for k, w in model.weights.items()}
        self.second = {k: np.zeros_like(w) for k, w in model.weights.items()}
        self.total = {k: np.zeros(w.shape) for k, w in model.weights.items()}  # of the weights after each step
        self.steps = 0
        self.histogram = np.zeros(64 * (2 * RANGE * FINE + 1), np.int64)

    def learn(self, codes, n_ids, parts, bins, apart) -> None:
        """``parts``: by id, known and other counts and its share of its leaf; ``apart``: texts whose events are counted."""
        import numpy as np

        model = self.model
        stream, targets, late = model.windows(codes, n_ids)
        there = np.zeros(len(targets), bool)
        there[late] = True
        chance, side = np.empty(len(targets), np.float32), np.empty(len(targets), np.float32)
        parted = np.linspace(0, len(stream), 1 - (-len(stream) * STRIDE // IDS_AT_ONCE)).astype(np.int64).tolist()
        for begin, end in zip(parted, parted[1:]):
            at = slice(begin * STRIDE, end * STRIDE)
            model.prepare()
            chance[at], side[at], grads = model.slopes(stream[begin:end], targets[at], there[at])
            self.steps += 1
            rate = FIT_RATE * min(1, self.steps / 20) * min(1, there[at].sum() / IDS_AT_ONCE)  # steps of few ids are short
            model.descend(grads, self.first, self.second, self.steps, rate)
            for k, w in model.weights.items():
                self.total[k] += w
        chance, side = chance[late] * parts[:, 2], side[late]
        cells = ratio_cells(bins, parts[:, 0], parts[:, 1], chance, side, np.repeat(apart, n_ids), np.cumsum(n_ids) - n_ids)
        self.histogram += np.bincount(cells, minlength=len(self.histogram))

    def result(self):
        """Whole numbers that may be summed: the histogram, the steps, and the weights' sums in 2**-24."""
        import numpy as np

        sums = np.concatenate([t.reshape(-1) for t in self.total.values()])
        return np.concatenate([self.histogram, [self.steps], np.rint(sums * 2.0**24).astype(np.int64)])

    def take(self, total) -> None:
        """Give the model that was fitted the mean of all weights, from such numbers of all parts of a table."""
        import numpy as np

        n = len(self.histogram)
        at, steps = n + 1, float(total[n])
        for k, w in self.model.weights.items():
            if steps:
                self.model.weights[k] = (total[at : at + w.size].reshape(w.shape) / steps / 2.0**24).astype(np.float32)
            at += w.size


def _fit_batches(vocabulary, sent):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        model, found, hot, fitted = sent.value

        def figures(ids, sizes):
            known, other, bins = found.parts(ids, sizes, without=1)
            return model.code[ids], np.stack([known, other, model.inside[ids]], axis=1).astype(np.float32), bins.astype(np.int8)

        reader, fitter = kept(sent.value, lambda: Reader(subwords(*vocabulary.value), hot, figures)), Fitter(model)
        held, size = [], 0

        def learn():
            codes, n_ids, parts, bins, apart = map(np.concatenate, zip(*held))
            fitter.learn(codes, n_ids, parts, bins.astype(np.int64), apart)
            held.clear()

        for batch, texts in common.slices(batches, 0):
            n_words, _, sizes, at = reader.read([words(t) for t in texts])
            n_ids = np.add.reduceat(sizes, np.cumsum(n_words) - n_words)
            _, codes, parts, bins = reader.parts
            apart = np.array([d not in fitted for d in batch.column(1).to_pylist()], bool)
            held.append((np.take(codes, at), n_ids, np.take(parts, at, axis=0), np.take(bins, at), apart))
            size += len(at)
            if size >= IDS_AT_ONCE:
                learn()
                size = 0
        if held:
            learn()
        total = fitter.result()
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["place", "n"])

    return run


def _summed(rows: DataFrame, run, size: int):
    """Sums by place of the (place, n) rows that ``run`` makes; at most ``size`` rows are collected."""
    import numpy as np

    table = rows.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[table["place"].to_numpy()] = table["n"].to_numpy()
    return out


def _most(table: DataFrame, count: str, most: int) -> int:
    """A count that at most ``most`` rows reach, found from a histogram whose size does not depend on the table's."""
    bucket = F.floor(F.log2(F.col(count)) * 64)
    rows = table.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(count).alias("least")).collect()
    least, held = 1 << 62, 0
    for r in sorted(rows, key=lambda r: -r["least"]):
        held += r["n"]
        if held > most:
            break
        least = r["least"]
    return least


def _arrays(rows: list, *names: str):
    import numpy as np

    return [np.array([r[k] or 0 for r in rows], np.int64) for k in names]


def learn(learned: DataFrame, counts: DataFrame, vocabulary):
    """The parts of a Scorer besides its vocabulary, from texts and the counts of their words."""
    import numpy as np

    spark = learned.sparkSession
    least = _most(counts.where(F.length("word") > 0), "c", HOT)
    table = counts.where((F.length("word") > 0) & (F.col("c") >= least)).select("word", "c").toArrow()  # HOT rows at most
    hot, hot_counts = table["word"].to_pylist(), table["c"].to_numpy().astype(np.float64)
    order = np.array(sorted(range(len(hot)), key=hot.__getitem__), np.int64)
    order = order[np.argsort(-hot_counts[order], kind="stable")]
    hot, hot_counts = [hot[i] for i in order.tolist()], hot_counts[order]

    parts = counts.mapInArrow(_node_batches(vocabulary), "node bigint, parent bigint, n bigint, ends bigint")
    parts = common.materialize(parts.groupBy("node", "parent").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")), "beginnings")
    sub = subwords(*vocabulary.value)
    by_id = np.zeros(sub.end + 1)
    at, n = _arrays(parts.where("parent IS NULL").collect(), "node", "n")  # one row an id of the vocabulary at most
    by_id[at] = n
    nodes = parts.where("parent IS NOT NULL")
    enough = _most(nodes, "n", NODES)
    table = nodes.where(F.col("n") >= enough).toArrow()  # NODES rows at most
    found = Beginnings(*(table[c].to_numpy() for c in ("node", "parent", "n", "ends")))

    # what stands together in the same documents, and what follows what: places are those of frequent ids, then one a band
    model = Model(by_id, sub.begins)
    place = (PLACES - CLASSES + model.code // LEAVES).astype(np.int16)
    singles = [frequent(by_id, sub.begins == (side == 0))[0] for side in range(2)]
    for side in range(2):
        place[singles[side]] = side * SINGLES + np.arange(len(singles[side]))
    sent = spark.sparkContext.broadcast((place, hot))
    total = _summed(learned.select("text"), _place_batches(vocabulary, sent), (PLACES + 1) * PLACES + 2 * SINGLES**2)
    near = []
    for side, some in enumerate(total[(PLACES + 1) * PLACES :].reshape(2, SINGLES, SINGLES) / 2.0**16):
        some = (some + np.triu(some, 1).T)[: len(singles[side]), : len(singles[side])]
        length = np.sqrt(np.diag(some)) + 1e-9
        near.append(some / length[:, None] / length)
    model = Model(by_id, sub.begins, near=near)
    kind = np.zeros(PLACES + 1, np.int64)
    kind[place], kind[PLACES] = model.code // LEAVES, CLASSES
    at = np.flatnonzero(total[: (PLACES + 1) * PLACES])
    pairs = np.bincount(kind[at // PLACES] * CLASSES + kind[at % PLACES], total[at], (CLASSES + 1) * CLASSES)
    model.learn_pairs(pairs.reshape(CLASSES + 1, CLASSES))

    # the first weights are of a sample, the last of all documents
    ends = int(by_id[sub.end])
    draw = F.xxhash64("doc_id", "text", F.lit("lm"))
    chosen = learned.where(F.abs(draw % 1_000_000) < (min(1.0, FIT_ROWS / ends) if ends else 0.0) * 1_000_000)
    sample = chosen.select(F.coalesce("text", F.lit("")).alias("text"), draw.alias("draw")).orderBy("draw", "text").limit(2 * FIT_ROWS).collect()
    texts = [sub.encode([*words(r["text"].encode()), b""])[0] for r in sample]  # 2 * FIT_ROWS at most
    model.fit([t for i, t in enumerate(texts) if i % APART], texts[::APART])
    sent = spark.sparkContext.broadcast((model, found, hot, {r["draw"] for i, r in enumerate(sample) if i % APART}))
    fitter = Fitter(model)
    total = _summed(learned.select("text", draw.alias("draw")), _fit_batches(vocabulary, sent), len(fitter.result()))
    fitter.take(total)
    model = fitter.model
    model.prepare()
    found.share = estimate_shares(total[: len(fitter.histogram)])
    return model, found, hot, hot_counts, least


def score(docs: DataFrame, learned_from) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every text.

    ``learned_from`` is a boolean column of ``docs``: the rows that counts and weights come from.
    """
    from .bpe import public_vocabulary

    spark = docs.sparkSession
    path, pattern = public_vocabulary()
    with open(path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast((f.read(), pattern))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(learned_from, F.lit(True)).alias("learn"),
    )
    learned = rows.where("learn")
    counted = learned.select("text").mapInArrow(_count_batches, "word binary, n bigint")
    counts = common.materialize(counted.groupBy("word").agg(F.sum("n").alias("c")), "words")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.length("word") == 0, F.col("c"))).alias("ends")).first()
    n, v, ends = total["n"] or 0, total["v"], total["ends"] or 0
    model, found, hot, hot_counts, least = learn(learned, counts, vocabulary)
    sent = spark.sparkContext.broadcast((model, found, hot, hot_counts))
    schema = "doc_id bigint, n_tokens bigint, hot_known bigint, hot_sum double, score double, rare array<struct<word:binary,k:bigint>>"
    scored = rows.select("doc_id", "text").mapInArrow(_score_batches(vocabulary, sent), schema)
    scored = common.materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    known = counts.where((F.col("c") < least) & (F.length("word") > 0))
    wanted = scored.select("row", F.inline("rare"))
    by_row = wanted.join(known, "word", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_sum"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("rare_known"))
    whole = math.log10(n + 0.5 * (v + 1))
    base = F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) + math.log10(ends + 0.5) - F.col("n_tokens") * whole
    return scored.join(by_row, "row", "left").select(
        "doc_id", "n_tokens", (F.col("hot_known") + F.coalesce("rare_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score",
    )


def op8_lm(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, common.remainder(F.col("doc_id"), 5) != 1)
    held = F.coalesce(common.remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
