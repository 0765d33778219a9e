"""The sequence as a Python list: what every positional operator has to agree with."""

from __future__ import annotations


def touched(length, o, k, n):
    return 0 if o >= length else min(n if n is not None else length, -(-(length - o) // k))


def read(a, o, k, n):
    return [a[o + i * k] for i in range(touched(len(a), o, k, n))]


def insert(a, src, o):
    o = min(o, len(a))
    return a[:o] + src + a[o:]


def write(a, src, o, k, n):
    a = list(a)
    for i in range(min(touched(len(a), o, k, n), len(src))):
        a[o + i * k] = src[i]
    return a


def remove(a, o, k, n):
    gone = {o + i * k for i in range(touched(len(a), o, k, n))}
    return [x for i, x in enumerate(a) if i not in gone]
