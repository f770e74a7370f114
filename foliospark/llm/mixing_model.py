"""The context-mixing model: bit predictors of hashed contexts, combined by gated logistic weights and refined online.

A text is a row of bytes (A-Z lower-cased) and an end mark, and a byte is eight binary decisions down a tree.  For each
of the ORDERS, the bytes before and the decision's place in the tree choose a slot that counts zeros and ones.  The
slots' log odds are summed with weights of a set that is chosen by how many orders have seen the context, how often the
longest of these has, and the bit's number, and the sum is corrected by a table of what such sums turned out to mean.

So far everything about a byte depends on it and the five before it, so costs are computed once for each distinct string
of six (a gram) and kept in a cache.  Then a second mixer follows each text from its start.  Where the last five bytes
occurred before in the text, it decides whether the byte that followed then follows again: it mixes the log odds that the
counters give that byte with a bias, by weights of a set that is chosen by how many orders have seen the context and how
often in a row such a byte has just been right; if another byte comes, the counters' probabilities of the others hold.
After every SEGMENT bytes the weights of this text move by what they got wrong.  No byte is judged by itself or by what
follows, and the probabilities of all bytes that can come sum to 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .common import U64, mix

ORDERS = (1, 2, 3, 4, 5)
SPAN = max(ORDERS) + 1
REGION_BITS = 6
#: Slots of the table for each distinct gram, and its least and largest size.
SLOTS_A_GRAM, LEAST_BITS, MOST_BITS = 4, 18, 25
GATES = 8 * 4 * (len(ORDERS) + 1)
BUCKETS = 33
#: Bytes after which a text's own weights move, and how firm they are at first (log odds, bias).
SEGMENT, FIRM = 64, (40.0, 4.0)
#: How often in a row a recalled byte was right, in steps, and what the bias is at first for each.
RUNS, BIAS = (1, 2, 4, 8), (0.0, 0.5, 1.0, 1.5, 2.0)
SETS = (len(ORDERS) + 1) * len(BIAS)
_STEP, _SPREAD = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of each text and at its end mark, in order, and n + 1 bounds of the texts."""
    n = len(offs) - 1
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    row = np.repeat(np.arange(n), np.diff(offs))
    stream = np.zeros(len(data) + SPAN * n, np.uint8)
    stream[np.arange(len(data)) + SPAN * row + SPAN - 1] = fold[data]
    key = np.zeros(len(stream), U64)
    for k in range(SPAN):
        key[k:] |= stream[: len(stream) - k].astype(U64) << U64(8 * k)
    keep = np.ones(len(stream), bool)
    first = offs[:-1] + SPAN * np.arange(n)
    for k in range(SPAN - 1):
        keep[first + k] = False
    return key[keep], offs + np.arange(n + 1)


def contexts(key: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the `order` bytes before each gram's last."""
    return mix(((key >> U64(8)) & U64((1 << 8 * order) - 1)) | U64(order << 56))


def table_bits(n_grams: int, most: int = MOST_BITS) -> int:
    """The table grows with the distinct grams, up to what a worker may hold (two bytes a slot)."""
    return min(max((SLOTS_A_GRAM * n_grams).bit_length(), LEAST_BITS), most)


def slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Places in a table of 2^bits slots: a context's region, and within it a hash of context and tree node."""
    low = ((context + node.astype(U64) * _STEP) * _SPREAD) >> U64(64 - (bits - REGION_BITS))
    return ((context >> U64(64 - REGION_BITS)) << U64(bits - REGION_BITS) | low).astype(np.int64)


def packed_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Two counts of at most 255 in 16 bits; larger ones are scaled down together, and none becomes zero."""
    most = np.maximum(np.maximum(zeros, ones) / 255, 1)
    scaled = [np.where(x > 0, np.maximum(np.round(x / most), 1), 0).astype(np.uint16) for x in (zeros, ones)]
    return scaled[0] << np.uint16(8) | scaled[1]


def _log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((np.maximum(ones, 0) + 0.4) / (np.maximum(zeros, 0) + 0.4)).astype(np.float32)


_N = np.arange(1 << 16)
LOG_ODDS = _log_odds(_N >> 8, _N & 255)
#: The same without one zero, or one, of what was counted: how a slot looks to text that it hasn't learnt from.
WITHOUT = np.stack([_log_odds((_N >> 8) - 1, _N & 255), _log_odds(_N >> 8, (_N & 255) - 1)])
#: How much a slot has seen, in four steps from nothing, and the same without one.
_TOTAL = (_N >> 8) + (_N & 255)
SEEN = np.digitize(_TOTAL, [1, 3, 12, 60]).astype(np.int8)
SEEN_WITHOUT = np.digitize(_TOTAL - 1, [1, 3, 12, 60]).astype(np.int8)


@dataclass
class Model:
    table: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.tile(np.r_[np.full(len(ORDERS), 0.35), 0.0].astype(np.float32), (GATES, 1)))
    #: What remains to be added to the mixed log odds, by gate and bucket of their size.
    refined: np.ndarray = field(default_factory=lambda: np.zeros((GATES, BUCKETS), np.float32))

    def decisions(self, key: np.ndarray, without: bool):
        """For each of the eight bits: the inputs (log odds by order and a constant), the gate, and the bit."""
        hashes, bits = [contexts(key, o) for o in ORDERS], len(self.table).bit_length() - 1
        byte = (key & U64(255)).astype(np.int64)
        for j in range(8):
            node = (1 << j) | (byte >> (8 - j))
            bit = (byte >> (7 - j)) & 1
            x = np.empty((len(key), len(ORDERS) + 1), np.float32)
            depth, step = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            for k, h in enumerate(hashes):
                counts = self.table[slots(h, node, bits)]
                x[:, k] = WITHOUT[bit, counts] if without else LOG_ODDS[counts]
                seen = SEEN_WITHOUT[counts] if without else SEEN[counts]
                depth += seen > 0
                step = np.where(seen > 0, seen - 1, step)
            x[:, -1] = 0.3
            yield x, (depth * 4 + step) * 8 + j, bit

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((x * self.weights[gate]).sum(axis=1), -13, 13)

    @staticmethod
    def bucket(odds: np.ndarray) -> np.ndarray:
        return np.clip(np.round(odds * 2), -16, 16).astype(np.int64) + 16

    def costs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each gram's last byte: -ln of its probability after the others, and how many orders have seen that context."""
        out, depth = np.zeros(len(key), np.float32), np.zeros(len(key), np.uint8)
        for at in range(0, len(key), 1 << 14):
            part = key[at : at + (1 << 14)]
            total = np.zeros(len(part))
            for j, (x, gate, bit) in enumerate(self.decisions(part, False)):
                odds = self.mixed(x, gate)
                odds = np.clip(odds + self.refined[gate, self.bucket(odds)], -16, 16).astype(np.float64)
                total += np.log1p(np.exp(np.where(bit == 1, -odds, odds)))
                if not j:
                    depth[at : at + len(part)] = gate // 32
            out[at : at + len(part)] = total
        return out, depth

    def learn(self, key: np.ndarray, count: np.ndarray, size: int = 2048, rate: float = 0.05) -> float:
        """Online logistic regression of the weights over the grams in the given order, with a step for each weight that shrinks as it has moved."""
        moved = np.full_like(self.weights, 1e-3)
        total = 0.0
        for at in range(0, len(key), size):
            part, n = key[at : at + size], count[at : at + size].astype(np.float32)
            for x, gate, bit in self.decisions(part, True):
                error = (bit - 1 / (1 + np.exp(-self.mixed(x, gate)))) * n
                slope = np.zeros_like(self.weights)
                np.add.at(slope, gate, error[:, None] * x)
                slope /= max(n.sum(), 1e-9)
                moved += slope**2
                self.weights += rate * slope / np.sqrt(moved)
            total += float(n.sum())
        return total

    def outcomes(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """By gate and bucket: the weight of decisions, of ones, and the expected weight of ones."""
        out = np.zeros((3, GATES * BUCKETS))
        for at in range(0, len(key), 1 << 15):
            part, n = key[at : at + (1 << 15)], count[at : at + (1 << 15)].astype(np.float64)
            for x, gate, bit in self.decisions(part, True):
                odds = self.mixed(x, gate)
                cell = gate * BUCKETS + self.bucket(odds)
                for k, v in enumerate((n, n * bit, n / (1 + np.exp(-odds)))):
                    out[k] += np.bincount(cell, v, GATES * BUCKETS)
        return out

    def refine(self, outcomes: np.ndarray) -> None:
        n, ones, expected = outcomes.reshape(3, GATES, BUCKETS)
        told = lambda x: np.log((x + 0.5) / (n - x + 0.5))
        self.refined = (np.clip(told(ones) - told(np.clip(expected, 0, n)), -4, 4) * n / (n + 20)).astype(np.float32)


class Cache:
    """Model.costs() of grams met before, one for each slot of a fixed table."""

    def __init__(self, model: Model, bits: int = 21):
        self.model, self.shift = model, U64(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, U64)
        self.held = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.uint8)

    def costs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = ((key * _STEP) >> self.shift).astype(np.int64)
        out = tuple(x[at] for x in self.held)
        miss = np.flatnonzero(self.keys[at] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            place = ((new * _STEP) >> self.shift).astype(np.int64)
            self.keys[place] = new
            for held, own, made in zip(self.held, out, self.model.costs(new), strict=True):
                own[miss] = made[back]
                held[place] = made
        return out


def recalled(key: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """For each byte the one that followed the last time that the five before it occurred in its text, or -1.

    Places are sorted by a hash of text and context with the place below it; neighbours count if both are equal indeed.
    """
    n = len(key)
    low = U64(max(n, 1).bit_length())
    context = (np.repeat(np.arange(len(cut) - 1, dtype=U64), np.diff(cut)) << U64(40)) + (key >> U64(8))
    hashed = np.sort((mix(context) >> low << low) | np.arange(n, dtype=U64))
    order = (hashed & ((U64(1) << low) - U64(1))).astype(np.int64)
    ordered = context[order]
    again = ordered[1:] == ordered[:-1]
    out = np.full(n, -1, np.int16)
    out[order[1:][again]] = (key[order[:-1][again]] & U64(255)).astype(np.int16)
    return out


def runs_before(right: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """For each byte of texts how many of those just before it in its text were right, without a gap."""
    at = np.arange(len(right))
    last = np.maximum.accumulate(np.where(right, -1, at)) if len(right) else at
    before = np.concatenate([[-1], last[:-1]])[: len(right)]
    return at - 1 - np.maximum(before, np.repeat(cut[:-1], np.diff(cut)) - 1)


def schedule(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """How texts go side by side, longest first: their order, the place and text (in that order) of each byte, and for each step the end of its bytes and how many texts it has."""
    sizes = np.diff(cut)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = cut[:-1][order], sizes[order]
    places, texts, steps, done = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
    for at in range(0, int(sizes.max(initial=0)), SEGMENT):
        live = int(np.searchsorted(-sizes, -at, side="left"))
        count = np.minimum(sizes[:live] - at, SEGMENT)
        text = np.repeat(np.arange(live), count)
        places.append(np.repeat(first[:live] + at - (np.cumsum(count) - count), count) + np.arange(len(text)))
        texts.append(text)
        done += len(text)
        steps.append((done, live))
    return order, np.concatenate(places), np.concatenate(texts), steps


def text_costs(costs_of, key: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """-log10 of the probability of each text, whose bytes lie between two cuts, by the mixer that follows it; costs_of as Cache.costs.

    The texts go side by side, segment by segment; each has its own weights.
    """
    n = len(cut) - 1
    order, place, texts, steps = schedule(cut)
    byte, past = (key & U64(255)).astype(np.int16), recalled(key, cut)
    right = past == byte
    cost, depth = costs_of(key)
    gate = depth * np.uint8(len(BIAS)) + np.searchsorted(RUNS, runs_before(right, cut), side="right").astype(np.uint8)
    out = np.add.reduceat(cost.astype(np.float64), cut[:-1]) if n else np.zeros(0)
    some = past[place] >= 0
    ends = np.concatenate([[0], np.cumsum(some)])[[end for end, _ in steps]] if steps else []
    place, texts = place[some], texts[some]
    told, _ = costs_of((key[place] & ~U64(255)) | past[place].astype(U64))
    chance = np.clip(np.exp(-told.astype(np.float64)), 1e-7, 1 - 1e-7)  # of the recalled byte, by the counters
    odds, one, chosen = np.log(chance / (1 - chance)), right[place], texts * SETS + gate[place]
    # what the counters alone take for each decision; what they take for another byte among the others stays
    usual = np.where(one, -np.log(chance), -np.log1p(-chance))
    out -= np.bincount(order[texts], np.where(one, cost[place] + np.log(chance), 0), n)
    weights = [np.ones(n * SETS), np.tile(np.array(BIAS, np.float64), n * SETS // len(BIAS))]
    firmness = [np.full(n * SETS, f) for f in FIRM]
    gained, begin = np.zeros(n), 0
    for end, (_, live) in zip(ends, steps, strict=True):
        who, x, hit, size = chosen[begin:end], odds[begin:end], one[begin:end], live * SETS
        p = 1 / (1 + np.exp(-np.clip(weights[0][who] * x + weights[1][who], -20, 20)))
        gained[:live] += np.bincount(texts[begin:end], usual[begin:end] + np.log(np.where(hit, p, 1 - p)), live)
        error, spread = hit - p, p * (1 - p)
        for own, firm, value in zip(weights, firmness, (x, 1.0), strict=True):
            firm[:size] += np.bincount(who, spread * value * value, size)
            own[:size] += np.bincount(who, error * value, size) / firm[:size]
        begin = end
    out[order] -= gained
    return out / np.log(10)
