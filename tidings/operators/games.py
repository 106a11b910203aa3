"""Sampled attribution games of many texts at once (numpy over Arrow batches).

A text's players are its words, or ``m`` runs of neighbouring words. Both default
outputs need additive counts of a coalition only (lexicon hits, anchor hits, squared
token counts), so an order of the players is walked with running sums: per
order and text O(players + tokens), no masked text is built.

Orders. *Uniform* orders sort the players by an integer hash of (seed, id, order,
player): Shapley values. *Tree* orders are those of a balanced binary tree over the words
(player ``i``'s leaf is its index in binary): every inner node puts either half
first, by a hash bit of (seed, id, order, node). A marginal contribution averaged
over tree orders is an Owen value of the nested halves: a word is judged with its
neighbours all in or all out, never with a random scatter of distant words, so a few
orders tell much, at (words + 1) values an order.

Pairs. With ``paired`` each drawn order is walked forwards and backwards (the
reverse of a tree order is one too), and the mean of both is one sample. Errors
of the two directions largely cancel.

Known error. Samples of a player give its standard error. ``tolerance`` adds
samples, doubling from ``least``, until no player of the text has a larger one,
or ``samples`` is reached. Texts that are settled leave the block.

All texts of a block are handled by the same array operations, orders in slices that
bound memory at any text length. Few players: squared token counts of a coalition
come from the players' Gram matrix, so an order costs O(players ^ 2) whatever the
length of the text. Words as players: only tokens that occur again in their text
are sorted, once for both directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidings.functions.vectors import arrow_blocks, token_codes, token_spans

ORDER_MODULUS = 2147483647
ORDER_MULTIPLIER = 48271
ORDER_SEED_STRIDE = 1000003
ORDER_INCREMENTS = (11, 13, 17, 19, 23, 29, 31)
#: The first squarings of a small id still follow it; they are not used.
ORDER_WARM_UP = 2
#: Players (or tokens) times orders handled in one array.
_CELLS = 1 << 18
#: Up to this many runs of words the players' Gram matrix is used.
_FEW = 32
#: Bytes of text in one block.
_BLOCK = 1 << 19
_BLANKS = np.array([b in b" \t\n\r" for b in range(256)])


# -- orders: pure integer functions of (seed, id, order), so SQL can rebuild them --

def order_coefficients(seed: int, ids, order):
    """The five coefficients c0..c4 of the key polynomial for each (id, order)."""
    mod = ORDER_MODULUS
    ids = np.asarray(ids, dtype=np.int64)
    order = np.asarray(order, dtype=np.int64)
    s = ((ids % mod) * ORDER_MULTIPLIER + (seed * ORDER_SEED_STRIDE + order) % mod) % mod
    coef, x = [], s
    for a in ORDER_INCREMENTS:
        x = (x * x + a) % mod
        coef.append(x)
    return coef[ORDER_WARM_UP:]


def order_keys(coef, player):
    """sum_k c_k * player^k mod 2^31 - 1, by Horner's rule."""
    key = coef[4]
    for c in (coef[3], coef[2], coef[1], coef[0]):
        key = (key * player + c) % ORDER_MODULUS
    return key


#: The bit of a node's key that says which half comes first.
FLIP_BIT = 15


def tree_depth(players):
    """Levels of the smallest balanced binary tree with that many leaves."""
    n = np.maximum(np.asarray(players, dtype=np.int64) - 1, 0)
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def tree_keys(coef, player, depth):
    """A leaf's place among all 2^depth: its index with the bit of every level
    turned where the node above puts its second half first."""
    key = np.array(np.broadcast_to(player, np.broadcast(player, depth, coef[0]).shape), dtype=np.int64)
    for level in range(int(np.max(depth, initial=0))):
        below = depth - level  # bits from this level down
        node = (np.int64(1) << np.minimum(level, 62)) + (player >> np.maximum(below, 0))
        turn = (order_keys(coef, node) >> FLIP_BIT) & 1
        key ^= np.where(below > 0, turn << np.maximum(below - 1, 0), 0)
    return key


def sequences(keys: np.ndarray) -> np.ndarray:
    """The indices that sort the last axis, equal keys by index. A stable sort is twice as slow, and needed only where keys are equal."""
    order = np.argsort(keys, axis=-1)
    found = np.take_along_axis(keys, order, axis=-1)
    return np.argsort(keys, axis=-1, kind="stable") if (found[..., 1:] == found[..., :-1]).any() else order


def sampled_orders(seed: int, doc: int, k: int, m: int, tree: bool = False) -> np.ndarray:
    """k x m player indices: row r is order r of row ``doc``."""
    return orders_of(seed, [doc], np.arange(k), m, tree)[0]


def orders_of(seed: int, docs, orders, m: int, tree: bool = False) -> np.ndarray:
    """``sampled_orders`` of many rows of m players, those of the given numbers: rows x orders x m."""
    docs, orders = np.asarray(docs, dtype=np.int64), np.asarray(orders, dtype=np.int64)
    k = len(orders)
    coef = [c.reshape(len(docs), k, 1) for c in order_coefficients(seed, np.repeat(docs, k), np.tile(orders, len(docs)))]
    player = np.arange(m, dtype=np.int64)
    return sequences(tree_keys(coef, player, tree_depth(m)) if tree else order_keys(coef, player))


# -- the players of a block of texts ------------------------------------------------

def _spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of ``counts`` rows: the group and the place in it of every row."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def ragged_tree_keys(coef, size: np.ndarray) -> np.ndarray:
    """``tree_keys`` of groups of ``size`` players each (``coef``: one row a group), from
    the root down: a node's bits are its parent's and its own, so a group costs
    O(players) hashes."""
    depth, first = tree_depth(size), np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int64)
    for d in np.unique(depth).tolist():
        some = np.flatnonzero(depth == d)
        own, m = [c[some] for c in coef], size[some]
        bits, nodes = np.zeros(len(some), np.int64), np.ones(len(some), np.int64)
        group, node = _spans(nodes)
        for level in range(d):
            below = d - level
            turn = (order_keys([c[group] for c in own], (np.int64(1) << level) + node) >> FLIP_BIT) & 1
            bits ^= turn << (below - 1)
            start = np.cumsum(nodes) - nodes
            nodes = ((m - 1) >> (below - 1)) + 1
            group, node = _spans(nodes)
            bits = bits[start[group] + (node >> 1)]
        out[first[some][group] + node] = node ^ bits
    return out


@dataclass(frozen=True)
class Lexicons:
    """Codes of the counted words: positive, negative, and the anchor's with weights."""

    positive: np.ndarray
    negative: np.ndarray
    anchor: np.ndarray
    weight: np.ndarray
    anchor_norm: float

    @classmethod
    def of(cls, positive, negative, weights: dict[str, int], anchor_norm: float) -> "Lexicons":
        def codes(words):
            rows, found = token_codes([w.encode() for w in words])
            # A word that isn't one token can never equal one.
            whole = {w: c for w, c in zip(rows.tolist(), found.tolist())}
            return np.array([whole[i] for i, w in enumerate(words) if w and w.isascii() and w.isalnum() and w == w.lower()], np.uint64)

        anchor = [w for w in weights if w and w.isascii() and w.isalnum() and w == w.lower()]
        return cls(codes(list(positive)), codes(list(negative)), codes(anchor), np.array([weights[w] for w in anchor], np.int64), anchor_norm)


class Block:
    """Texts (lower-cased bytes) as ragged arrays of players and their counts."""

    def __init__(self, texts: list[bytes], players: int | None, lexicons: Lexicons):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        blank = np.concatenate([[True], _BLANKS[buf]])
        word = np.flatnonzero(~blank[1:] & blank[:-1])
        limits = np.cumsum([len(t) + 1 for t in texts])
        n = np.bincount(np.searchsorted(limits, word, side="right"), minlength=len(texts))
        text, place = _spans(n)
        self.m = n if players is None else np.minimum(n, players)
        self.first = np.cumsum(self.m) - self.m
        run = place if players is None else ((place + 1) * self.m[text] - 1) // n[text]
        player = self.first[text] + run  # of a word
        start, code = token_spans(buf)
        token_player = player[np.searchsorted(word, start, side="right") - 1] if len(start) else np.zeros(0, np.int64)
        owner = np.searchsorted(limits, start, side="right")
        total = int(self.m.sum())

        def hits(codes: np.ndarray, weight=None) -> np.ndarray:
            order = np.argsort(codes)
            at = np.minimum(np.searchsorted(codes[order], code), max(len(codes) - 1, 0))
            found = (codes[order][at] == code) if len(codes) else np.zeros(len(code), bool)
            value = np.ones(len(code), np.int64) if weight is None else weight[order][at] if len(codes) else np.zeros(len(code), np.int64)
            return np.bincount(token_player[found], weights=value[found], minlength=total).astype(np.int64)

        self.p, self.q, self.d = hits(lexicons.positive), hits(lexicons.negative), hits(lexicons.anchor, lexicons.weight)
        self.anchor_norm = lexicons.anchor_norm

        # Tokens by text and kind; a kind is a distinct token of one text.
        by = np.lexsort((code, owner))
        head = np.ones(len(by), bool)
        head[1:] = (owner[by][1:] != owner[by][:-1]) | (code[by][1:] != code[by][:-1])
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(by)))
        self.kinds = np.bincount(owner[by][first], minlength=len(texts))
        self.squares = np.bincount(owner[by][first], weights=count * count, minlength=len(texts)).astype(np.int64)
        self.few = players is not None and players <= _FEW
        if self.few:
            self.token_kind, self.token_player = np.cumsum(head) - 1, token_player[by]
            self.token_first = np.searchsorted(owner[by], np.arange(len(texts) + 1))
        else:
            again = np.repeat(count > 1, count)
            self.alone = np.bincount(token_player[by][~again], minlength=total)
            self.again_player, self.again_head = token_player[by][again], head[again]
            self.again = np.bincount(owner[by][again], minlength=len(texts))
            self.again_first = np.cumsum(self.again) - self.again

    def values(self, p, q, d, squares, label) -> tuple[np.ndarray, np.ndarray]:
        """Sentiment and environmental value of coalitions with these counts."""
        total = p + q + 1.0
        sent = np.where(label == 0, p, np.where(label == 1, q, 1)) / total
        cos = np.divide(d, np.sqrt(squares.astype(np.float64)) * self.anchor_norm, out=np.zeros(np.shape(total)), where=squares != 0)
        return sent, np.where(p > q, 1.0, -1.0) * cos + 0.0

    def full(self, rows: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = np.repeat(np.arange(len(self.m)), self.m)
        p, q, d = (np.bincount(text, weights=x, minlength=len(self.m)).astype(np.int64)[rows] for x in (self.p, self.q, self.d))
        return self.values(p, q, d, self.squares[rows], label)

    def gram(self, row: int) -> np.ndarray:
        """Products of the token-count vectors of a text's players."""
        m, a, b = int(self.m[row]), self.token_first[row], self.token_first[row + 1]
        if a == b:
            return np.zeros((m, m))
        kind = self.token_kind[a:b] - self.token_kind[a]
        cell = kind * m + (self.token_player[a:b] - self.first[row])
        count = np.bincount(cell, minlength=(int(kind[-1]) + 1) * m).reshape(-1, m).astype(np.float64)
        return count.T @ count

    def walk_few(self, rows: np.ndarray, ids: np.ndarray, label: np.ndarray, orders: np.ndarray, seed: int, tree: bool, paired: bool):
        """As ``walk`` for texts of equally many players, few of them."""
        m, k = int(self.m[rows[0]]), len(orders)
        forward = orders_of(seed, ids[rows], orders, m, tree)
        i = np.arange(m, dtype=np.int64)
        player = self.first[rows][:, None] + i
        gram = np.stack([self.gram(r) for r in rows])
        at, rank = np.arange(len(rows))[:, None], label[rows][:, None, None]

        def contributions(sequence: np.ndarray) -> list[np.ndarray]:
            squares, met = np.empty(sequence.shape), np.zeros(sequence.shape)
            for n in range(m):
                who = sequence[:, :, n]
                own = gram[at, who]
                squares[:, :, n] = own[at, np.arange(k)[None, :], who] + 2 * np.take_along_axis(met, who[:, :, None], 2)[:, :, 0]
                met += own
            who = player[at[:, :, None], sequence]
            after = self.values(*(np.cumsum(x[who], axis=2) for x in (self.p, self.q, self.d)), np.cumsum(squares, axis=2), rank)
            out = []
            for value, empty in zip(after, (np.where(rank == 2, 1.0, 0.0), 0.0)):
                step = np.diff(value, axis=2, prepend=np.broadcast_to(empty, (len(rows), k, 1)))
                np.put_along_axis(x := np.empty(sequence.shape), sequence, step, axis=2)
                out.append(x)
            return out

        found = contributions(forward)
        if paired:
            found = [(a + b) / 2 for a, b in zip(found, contributions(forward[:, :, ::-1]))]
        return (np.broadcast_to(player[:, None, :], forward.shape).ravel(), *(x.ravel() for x in found))

    def walk(self, rows: np.ndarray, ids: np.ndarray, label: np.ndarray, orders: np.ndarray, seed: int, tree: bool, paired: bool):
        """Player and sampled contributions to both outputs for every (text, order,
        player) of the texts ``rows`` (with players)."""
        k = len(orders)
        size = np.repeat(self.m[rows], k)
        start = np.cumsum(size) - size
        group, i = _spans(size)
        coef = order_coefficients(seed, np.repeat(ids[rows], k), np.tile(orders, len(rows)))
        keys = ragged_tree_keys(coef, size) if tree else order_keys([c[group] for c in coef], i)
        forward = np.lexsort((keys, group)) if len(size) >= 1 << 31 else sequences((group.astype(np.int64) << 32) | keys)
        place = np.empty(len(group), np.int64)
        place[forward] = np.arange(len(group))
        base = np.repeat(np.repeat(self.first[rows], k), size)
        player = base + i
        who = player[forward]
        back = start[group] + size[group] - 1 - i  # the same sequence backwards

        # The n-th token of a kind adds 2n - 1 to the sum of squared counts; walked
        # backwards the n-th of c is the (c - n + 1)-th. Kinds lie in order, so a
        # sort by (kind, place) moves tokens within their kind only.
        number = np.repeat(self.again[rows], k)
        owner, j = _spans(number)
        token = np.repeat(np.repeat(self.again_first[rows], k), number) + j
        at = place[start[owner] + self.again_player[token] - np.repeat(np.repeat(self.first[rows], k), number)]
        head = self.again_head[token]
        at = np.sort(((np.cumsum(head) - 1) << 32) | at) & 0xFFFFFFFF
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(at)))
        nth = np.arange(len(at)) - np.repeat(first, count) + 1
        rank = np.repeat(label[rows], k)[group]
        alone = self.alone[who]

        def contributions(sequence: np.ndarray, who: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def running(x: np.ndarray) -> np.ndarray:
                total = np.cumsum(x)
                return total - np.repeat(total[start] - x[start], size)

            after = self.values(running(self.p[who]), running(self.q[who]), running(self.d[who]), running(gain), rank)
            out = []
            for value, empty in zip(after, (np.where(rank[start] == 2, 1.0, 0.0), np.zeros(len(start)))):
                before = np.concatenate([[0.0], value[:-1]])
                before[start] = empty
                x = np.empty(len(group))
                x[sequence] = value - before
                out.append(x)
            return out[0], out[1]

        def gains(times: np.ndarray) -> np.ndarray:
            return np.bincount(at, weights=2.0 * times - 1, minlength=len(group)).astype(np.int64) + alone

        sent, env = contributions(forward, who, gains(nth))
        if paired:
            back_sent, back_env = contributions(forward[back], who[back], gains(np.repeat(count, count) - nth + 1)[back])
            sent, env = (sent + back_sent) / 2, (env + back_env) / 2
        return player, sent, env

    def attribute(self, ids: np.ndarray, label: np.ndarray, samples: int, seed: int, tree: bool, paired: bool, least: int, tolerance: float | None):
        """Per player: means and standard errors of both outputs; per text: the number of samples."""
        total = int(self.m.sum())
        sums = np.zeros((2, total))
        squares = np.zeros((2, total))
        taken = np.zeros(len(self.m), np.int64)
        text = np.repeat(np.arange(len(self.m)), self.m)
        rows = np.flatnonzero(self.m > 0)
        while len(rows):
            done = int(taken[rows[0]])
            upto = samples if tolerance is None else min(samples, max(least, 2 * done))
            cost = self.m if self.few else np.maximum(self.m, self.again)
            # Texts of equally many players go together where players are few.
            order = rows[np.argsort(self.m[rows], kind="stable")] if self.few else rows
            new = np.diff(np.cumsum(cost[order]) // _CELLS) != 0
            if self.few:
                new |= np.diff(self.m[order]) != 0
            walk = self.walk_few if self.few else self.walk
            for some in np.split(order, np.flatnonzero(new) + 1):
                step = max(1, int(_CELLS // cost[some].sum()))
                for a in range(done, upto, step):
                    who, *found = walk(some, ids, label, np.arange(a, min(a + step, upto)), seed, tree, paired)
                    for at, x in enumerate(found):
                        sums[at] += np.bincount(who, weights=x, minlength=total)
                        squares[at] += np.bincount(who, weights=x * x, minlength=total)
            taken[rows] = upto
            if tolerance is None or upto >= samples:
                break
            error = self.errors(sums, squares, taken[text])
            worst = np.zeros(len(self.m))
            np.maximum.at(worst, text, error.max(axis=0))
            rows = rows[worst[rows] > tolerance]
        n = np.maximum(taken[text], 1)
        return sums / n, self.errors(sums, squares, taken[text]), taken

    @staticmethod
    def errors(sums, squares, n):
        """Standard error of the mean (0 with one sample: unknown, see the operator)."""
        n = np.maximum(n, 1)
        spread = np.maximum(squares - sums * sums / n, 0.0) / np.maximum(n - 1, 1)
        # What rounding leaves of equal samples is not an error.
        spread[spread < 1e-18 * np.maximum(squares / n, 1.0)] = 0.0
        return np.sqrt(spread / n)


GAME_TYPE = ("struct<sent_base: double, sent_phi: array<double>, sent_full: double, env_base: double, env_phi: array<double>, "
             "env_full: double, sent_stderr: array<double>, env_stderr: array<double>, n_samples: int>")
_LABELS = ("positive", "negative", "neutral")


def game_udf(lexicons: Lexicons, players: int | None, samples: int, seed: int, tree: bool, paired: bool, least: int, tolerance: float | None):
    """ids (long), lower-cased text, label -> the sampled values of both outputs, a block
    of texts at a time whatever the size of an Arrow batch."""

    @F.arrow_udf(GAME_TYPE)
    def play(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for all_ids, lowered, labels in batches:
            for at, texts in arrow_blocks(lowered, _BLOCK):
                ids = np.asarray(all_ids.slice(at, len(texts)), dtype=np.int64)
                label = np.array([_LABELS.index(x) if x in _LABELS else 2 for x in labels.slice(at, len(texts)).to_pylist()], dtype=np.int64)
                block = Block(texts, players, lexicons)
                mean, error, taken = block.attribute(ids, label, samples, seed, tree, paired, least, tolerance)
                sent_full, env_full = block.full(np.arange(len(texts)), label)
                ends = pa.array(np.append(0, np.cumsum(block.m)), pa.int32())
                sent_phi, env_phi, sent_stderr, env_stderr = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (*mean, *error))
                columns = {
                    "sent_base": pa.array(np.where(label == 2, 1.0, 0.0)), "sent_phi": sent_phi, "sent_full": pa.array(sent_full),
                    "env_base": pa.array(np.zeros(len(ids))), "env_phi": env_phi, "env_full": pa.array(env_full),
                    "sent_stderr": sent_stderr, "env_stderr": env_stderr, "n_samples": pa.array(taken, pa.int32())}
                yield pa.StructArray.from_arrays([*columns.values()], names=[*columns])

    return play
