"""The two string scores Spark has no built-in for, as Arrow-batched UDFs.

They are applied after an equi-join, one pair per row; Spark does the pairing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    hits_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits_a.append(ch)
                break
    m = len(hits_a)
    if m == 0:
        return 0.0
    hits_b = [ch for ch, u in zip(b, used) if u]
    half_moves = sum(x != y for x, y in zip(hits_a, hits_b)) // 2
    score = (m / len(a) + m / len(b) + (m - half_moves) / m) / 3
    if score > 0.7:
        prefix = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            prefix += 1
        score += prefix * 0.1 * (1 - score)
    return score


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_jaro_winkler(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def _best_window(short: str, long: str) -> float:
    """Best 2*LCS/(len+len) of ``short`` against every window of ``long``.

    All windows advance together: the longest-common-subsequence bit vectors of
    every window are one numpy array, so the whole text is scored in len(short)
    vector steps per machine word.
    """
    m, n = len(short), len(long)
    if m == 0 or n == 0:
        return 0.0
    pad = m - 1
    codes = np.zeros(n + 2 * pad, dtype=np.int64)
    alphabet = {ch: i + 1 for i, ch in enumerate(dict.fromkeys(short))}
    codes[pad:pad + n] = [alphabet.get(ch, 0) for ch in long]
    windows = n + pad
    words = (m + 63) // 64
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    masks = np.zeros((words, len(alphabet) + 1), dtype=np.uint64)
    for i, ch in enumerate(short):
        masks[i // 64, alphabet[ch]] |= np.uint64(1) << np.uint64(i % 64)
    state = np.full((words, windows), full, dtype=np.uint64)
    for step in range(m):
        at = codes[step:step + windows]
        carry = np.zeros(windows, dtype=np.uint64)
        for w in range(words):
            s = state[w]
            u = s & masks[w][at]
            total = s + u
            over = total < s
            total2 = total + carry
            carry = (over | (total2 < total)).astype(np.uint64)
            state[w] = total2 | (s - u)
    lcs = np.zeros(windows, dtype=np.int64)
    for w in range(words):
        bits = min(64, m - 64 * w)
        keep = full if bits == 64 else (np.uint64(1) << np.uint64(bits)) - np.uint64(1)
        lcs += np.bitwise_count(~state[w] & keep).astype(np.int64)
    start = np.arange(windows) - pad
    width = np.minimum(start + m, n) - np.maximum(start, 0)
    return float(np.max(2.0 * lcs / (m + width)))


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0..100 score of the shorter text against the best window of the longer."""
    def score(x, y):
        if x is None or y is None:
            return None
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        return 100.0 * _best_window(short, long)

    return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="float64")
