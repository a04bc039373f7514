"""The context-tree model in memory, whole, as what the tables of foliomill.llm.ctw are compared with."""

from dataclasses import dataclass

import numpy as np

from foliomill.llm.ctw import _hashed, _index, log_kt
from foliomill.llm.shared import SortedIndex


def _node_keys(gram: np.ndarray, bit: int) -> np.ndarray:
    """Context and the bits so far (with a leading one) of the decision on a bit, 0 to 7, of the gram's byte."""
    byte = gram & np.uint64(255)
    return ((gram >> np.uint64(8)) << np.uint64(8)) | np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))


@dataclass
class Depth:
    """The nodes of one depth: where a chain of contexts stands there, and what it predicts if it ends there."""

    contexts: SortedIndex
    nodes: SortedIndex
    sure: np.ndarray  # probability of a one settled at or above this depth
    open: np.ndarray  # weight left to what lies below
    ends: np.ndarray  # probability of a one if no older byte has a branch
    grams: SortedIndex
    logp: np.ndarray  # log10 of the gram's byte, if the chain ends here


def build(tables: list[tuple[np.ndarray, np.ndarray]]) -> list[Depth]:
    """The depths of a model in memory from, for each, the grams (context and byte) and their counts.

    ``gram_scores`` is the same for tables; this form is what it is compared with.
    """
    keys, zeros, ones = [], [], []
    for gram, count in tables:
        k = np.concatenate([_node_keys(gram, bit) for bit in range(8)])
        is_one = np.concatenate([(gram >> np.uint64(7 - bit)) & np.uint64(1) for bit in range(8)]).astype(float)
        unique, inverse = np.unique(k, return_inverse=True)
        n = np.tile(count.astype(float), 8)
        keys.append(unique)
        ones.append(np.bincount(inverse, n * is_one, len(unique)))
        zeros.append(np.bincount(inverse, n * (1 - is_one), len(unique)))
    last = len(tables) - 1
    parent = [np.zeros(0, np.int64)]
    for d in range(1, last + 1):
        context, bits = keys[d] >> np.uint64(8), keys[d] & np.uint64(255)
        up = ((context & np.uint64((1 << (8 * (d - 1))) - 1)) << np.uint64(8)) | bits
        parent.append(np.searchsorted(keys[d - 1], up))
    weight: list[np.ndarray] = [np.zeros(0)] * (last + 1)
    other: list[np.ndarray] = [np.zeros(0)] * (last + 1)
    below = np.zeros(0)
    for d in range(last, -1, -1):
        own, n = log_kt(zeros[d], ones[d]), len(keys[d])
        weight[d], other[d] = np.ones(n), np.full(n, 0.5)
        weighted = own
        if d < last and len(keys[d + 1]):
            has = np.bincount(parent[d + 1], minlength=n) > 0
            rest_0 = np.maximum(zeros[d] - np.bincount(parent[d + 1], zeros[d + 1], n), 0)
            rest_1 = np.maximum(ones[d] - np.bincount(parent[d + 1], ones[d + 1], n), 0)
            branches = np.bincount(parent[d + 1], below, n) + log_kt(rest_0, rest_1)
            weighted = np.where(has, np.logaddexp(own, branches) - np.log(2), own)
            weight[d] = np.where(has, np.exp(np.minimum(own - np.log(2) - weighted, 0)), 1.0)
            other[d] = (rest_1 + 0.5) / (rest_0 + rest_1 + 1)
        below = weighted
    out, sure, left = [], np.zeros(0), np.zeros(0)
    for d in range(last + 1):
        kt = (ones[d] + 0.5) / (zeros[d] + ones[d] + 1)
        above, rest = (np.zeros(len(kt)), np.ones(len(kt))) if d == 0 else (sure[parent[d]], left[parent[d]])
        sure, left = above + rest * weight[d] * kt, rest * (1 - weight[d])
        ends = np.clip(sure + left * other[d], 1e-9, 1 - 1e-9)
        gram = tables[d][0]
        logp = np.zeros(len(gram))
        for bit in range(8):
            p = ends[np.searchsorted(keys[d], _node_keys(gram, bit))] if len(gram) else np.zeros(0)
            logp += np.log10(np.where((gram >> np.uint64(7 - bit)) & np.uint64(1), p, 1 - p))
        contexts = _index(np.unique(gram >> np.uint64(8)))[0]
        nodes, s, o, e = _index(keys[d], sure.astype(np.float32), left.astype(np.float32), ends.astype(np.float32))
        of_gram, lp = _index(gram, logp.astype(np.float32))
        out.append(Depth(contexts, nodes, s, o, e, of_gram, lp))
    return out


def byte_scores(model: list[Depth], gram: np.ndarray) -> np.ndarray:
    """log10 probability of the byte of each gram after its context."""
    out = np.zeros(len(gram))
    todo = np.arange(len(gram))
    for d in range(len(model) - 1, -1, -1):
        own = gram[todo] & np.uint64((1 << (8 * (d + 1))) - 1)
        at = model[d].grams.find(_hashed(own))
        hit = at >= 0
        out[todo[hit]] = model[d].logp[at[hit]]
        todo, own = todo[~hit], own[~hit]
        known = model[d].contexts.find(_hashed(own >> np.uint64(8))) >= 0
        if known.any() or d == 0:
            rare, inverse = np.unique(own if d == 0 else own[known], return_inverse=True)
            out[todo if d == 0 else todo[known]] = _new_byte(model, rare, d)[inverse]
        todo = todo[~known]
        if not len(todo):
            break
    return out


def _new_byte(model: list[Depth], gram: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of bytes never met after their deepest context, decision by decision."""
    out = np.zeros(len(gram))
    for bit in range(8):
        p = np.full(len(gram), 0.5)
        open_ = np.arange(len(gram))
        for d in range(depth, -1, -1):
            own = gram[open_] & np.uint64((1 << (8 * (d + 1))) - 1)
            at = model[d].nodes.find(_hashed(_node_keys(own, bit)))
            hit = at >= 0
            rows, at = open_[hit], at[hit]
            # Below a decision never met the estimate is a half at every depth.
            p[rows] = model[d].ends[at] if d == depth else model[d].sure[at] + model[d].open[at] * 0.5
            open_ = open_[~hit]
            if not len(open_):
                break
        p = np.clip(p, 1e-9, 1 - 1e-9)
        out += np.log10(np.where((gram >> np.uint64(7 - bit)) & np.uint64(1), p, 1 - p))
    return out
