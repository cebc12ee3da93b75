"""The MD2 digest (RFC 1319); its substitution table is derived from the digits of pi."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache


def _pi_digits() -> Iterator[int]:
    """Decimal digits of pi by a spigot of linear fractional steps."""
    q, r, t, k, n, l = 1, 0, 1, 1, 3, 3  # noqa: E741
    while True:
        if 4 * q + r - t < n * t:
            yield n
            q, r, n = 10 * q, 10 * (r - n * t), 10 * (3 * q + r) // t - 10 * n
        else:
            q, r, t, k, n, l = q * k, (2 * q + r) * l, t * l, k + 1, (q * (7 * k + 2) + r * l) // (t * l), l + 2  # noqa: E741


@lru_cache(maxsize=1)
def table() -> bytes:
    """A shuffle of 0..255 that draws its random numbers from the digits of pi."""
    digits = _pi_digits()

    def draw(n: int) -> int:
        while True:
            size = 1 if n <= 10 else 2 if n <= 100 else 3
            value = 0
            for _ in range(size):
                value = 10 * value + next(digits)
            if value < n * (10**size // n):
                return value % n

    out = list(range(256))
    for i in range(2, 257):
        j = draw(i)
        out[j], out[i - 1] = out[i - 1], out[j]
    return bytes(out)


def md2(data: bytes) -> bytes:
    s = table()
    pad = 16 - len(data) % 16
    data += bytes([pad]) * pad
    check, last = bytearray(16), 0
    for at in range(0, len(data), 16):
        for j in range(16):
            check[j] ^= s[data[at + j] ^ last]
            last = check[j]
    state = bytearray(48)
    for at in range(0, len(data) + 16, 16):
        block = (data + bytes(check))[at : at + 16]
        for j in range(16):
            state[16 + j] = block[j]
            state[32 + j] = block[j] ^ state[j]
        t = 0
        for turn in range(18):
            for k in range(48):
                state[k] ^= s[t]
                t = state[k]
            t = (t + turn) % 256
    return bytes(state[:16])
