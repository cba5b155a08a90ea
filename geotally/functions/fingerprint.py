"""The public 64-bit FarmHash fingerprint of texts, vectorised by length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# The constants of the public fingerprint.
K0, K1, K2 = (np.uint64(k) for k in (0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F))
SEED = np.uint64(81)

U = np.uint64


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x >> U(by) | x << U(64 - by)


def _mixed(x: np.ndarray) -> np.ndarray:
    return x ^ x >> U(47)


def _two(u: np.ndarray, v: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Two words as one."""
    return _mixed((v ^ _mixed((u ^ v) * factor)) * factor) * factor


class _Texts:
    """Bytes of several texts in a row; words are read at any place of them."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
        self.bytes = data
        self.words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def word(self, rows: np.ndarray, at) -> np.ndarray:
        return self.words[self.starts[rows] + at]

    def half(self, rows: np.ndarray, at) -> np.ndarray:
        return self.word(rows, at) & U(0xFFFFFFFF)


def _upto_16(t: _Texts, rows: np.ndarray) -> np.ndarray:
    n = t.sizes[rows]
    out = np.full(len(rows), K2)
    factor = K2 + n.astype(U) * U(2)
    long, mid, short = n >= 8, (n >= 4) & (n < 8), (n > 0) & (n < 4)
    r, f = rows[long], factor[long]
    a, b = t.word(r, 0) + K2, t.word(r, n[long] - 8)
    out[long] = _two(_turn(b, 37) * f + a, (_turn(a, 25) + b) * f, f)
    r = rows[mid]
    out[mid] = _two(n[mid].astype(U) + (t.half(r, 0) << U(3)), t.half(r, n[mid] - 4), factor[mid])
    r, m = rows[short], n[short]
    first, middle, last = (t.bytes[t.starts[r] + at].astype(U) for at in (0, m >> 1, m - 1))
    out[short] = _mixed((first + (middle << U(8))) * K2 ^ (m.astype(U) + (last << U(2))) * K0) * K2
    return out


def _upto_64(t: _Texts, rows: np.ndarray) -> np.ndarray:
    """Seventeen to 64 bytes; those of up to 32 end after the first half."""
    n = t.sizes[rows]
    factor = K2 + n.astype(U) * U(2)
    a, b = t.word(rows, 0) * np.where(n <= 32, K1, K2), t.word(rows, 8)
    c, d = t.word(rows, n - 8) * factor, t.word(rows, n - 16) * K2
    y = _turn(a + b, 43) + _turn(c, 30) + d
    out = _two(y, a + _turn(b + K2, 18) + c, factor)
    more = n > 32
    r, m, f = rows[more], n[more], factor[more]
    e, g = t.word(r, 16) * f, (y[more] + t.word(r, m - 32)) * f
    h, i = t.word(r, 24), (out[more] + t.word(r, m - 24)) * f
    out[more] = _two(_turn(e + h, 43) + _turn(g, 30) + i, e + _turn(h + a[more], 18) + g, f)
    return out


def _pair(t: _Texts, rows: np.ndarray, at, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thirty-two bytes into a pair of words."""
    w, x, y, z = (t.word(rows, at + k) for k in (0, 8, 16, 24))
    a = a + w
    b, c = _turn(b + a + z, 21), a
    a = a + x + y
    return a + z, b + _turn(a, 44) + c


def _long(t: _Texts, rows: np.ndarray) -> np.ndarray:
    """More than 64 bytes, in blocks of 64 and the last 64 again."""
    n = t.sizes[rows]
    y = np.full(len(rows), SEED * K1 + U(113))
    z = _mixed(y * K2 + U(113)) * K2
    x = SEED * K2 + t.word(rows, 0)
    v1, v2, w1, w2 = (np.zeros(len(rows), U) for _ in range(4))

    def step(r, at, factor, x, y, z, v1, v2, w1, w2, times):
        x = _turn(x + y + v1 + t.word(r, at + 8), 37) * factor
        y = _turn(y + v2 + t.word(r, at + 48), 42) * factor
        x = x ^ w2 * times
        y = y + v1 * times + t.word(r, at + 40)
        z = _turn(z + w1, 33) * factor
        v1, v2 = _pair(t, r, at, v2 * factor, x + w1)
        w1, w2 = _pair(t, r, at + 32, z + w2, y + t.word(r, at + 16))
        return z, y, x, v1, v2, w1, w2

    blocks = (n - 1) // 64
    for k in range(int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        state = step(rows[on], 64 * k, K1, *(s[on] for s in (x, y, z, v1, v2, w1, w2)), U(1))
        for s, new in zip((x, y, z, v1, v2, w1, w2), state, strict=True):
            s[on] = new
    factor = K1 + ((z & U(0xFF)) << U(1))
    w1 = w1 + ((n - 1) & 63).astype(U)
    v1 = v1 + w1
    w1 = w1 + v1
    x, y, z, v1, v2, w1, w2 = step(rows, n - 64, factor, x, y, z, v1, v2, w1, w2, U(9))
    return _two(_two(v1, w1, factor) + _mixed(y) * K0 + z, _two(v2, w2, factor) + x, factor)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Signed fingerprints of byte strings."""
    t = _Texts(texts)
    out = np.zeros(len(texts), U)
    with np.errstate(over="ignore"):
        for work, low, high in ((_upto_16, 0, 16), (_upto_64, 17, 64), (_long, 65, None)):
            rows = np.flatnonzero((t.sizes >= low) & (t.sizes <= (high or t.sizes.max(initial=0))))
            if len(rows):
                out[rows] = work(t, rows)
    return out.view(np.int64)


@F.pandas_udf(LongType())
def farm_fingerprint(text: pd.Series) -> pd.Series:
    """The fingerprint of a text's UTF-8 bytes; null for null."""
    known = text.notna()
    out = pd.Series([None] * len(text), dtype="Int64")
    out[known.to_numpy()] = fingerprints([x.encode() for x in text[known]])
    return out
