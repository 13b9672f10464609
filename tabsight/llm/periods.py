"""Periodic runs of words, found by block convolution.

A run is a longest stretch of words with smallest period q (words q apart are
equal) and at least max(12, 2q) words. Words that equal the word q later form a
stretch of at least max(q, 12 - q) places, so at the dyadic scale L with 2L - 1 places or
less it holds a whole block of L words that starts at a multiple of L. At every
scale the blocks are compared with the words that follow them: the sums of squared differences
at all distances of the scale come from one convolution of block and window,
taken exactly as integers modulo a prime by a number-theoretic transform. A
distance of difference zero is a seed, whose stretch is then extended word by word to both
sides, which also settles whether the difference was zero or only a multiple of the prime.

Blocks that hold a word without another occurrence in reach can have no seed,
and blocks whose whole window lies in a run of a period of at most L only have
multiples of that period; neither is transformed.

Defined cases: a null text has no words; texts of fewer than 12 words have no
run; whole texts are taken, one at a time, so memory follows the longest text; repeated rows are
treated alike; other columns pass through (n_words, runs and collapsed are replaced); an
empty table stays empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_batches, text_of, words_of

PRIME, GENERATOR = 998244353, 3  # 119 * 2**23 + 1: transforms of up to 2**23 places
LEAST = 12  # words of the shortest run
PLACES = 1 << 17  # numbers that are transformed at once
WIDEST = 1 << 20  # words of a block that enter a transform; extension compares the rest
MODULUS = np.uint64(PRIME)


@functools.lru_cache(maxsize=64)
def _powers(half: int, inverse: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < half:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % MODULUS])
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, its places in bit-reversed order."""
    rows, n = x.shape
    half = n // 2
    while half:
        x = x.reshape(rows, -1, 2, half)
        low, high = x[:, :, 0], x[:, :, 1]
        x = np.stack([(low + high) % MODULUS, (low + (MODULUS - high)) % MODULUS * _powers(half, False) % MODULUS], axis=2)
        half //= 2
    return x.reshape(rows, n)


def back(x: np.ndarray) -> np.ndarray:
    """The inverse, from bit-reversed order."""
    rows, n = x.shape
    half = 1
    while half < n:
        x = x.reshape(rows, -1, 2, half)
        low, high = x[:, :, 0], x[:, :, 1] * _powers(half, True) % MODULUS
        x = np.stack([(low + high) % MODULUS, (low + (MODULUS - high)) % MODULUS], axis=2)
        half *= 2
    return x.reshape(rows, n) * np.uint64(pow(n, PRIME - 2, PRIME)) % MODULUS


def zero_distances(words: np.ndarray, starts: np.ndarray, size: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) where the block and the words at that distance differ by zero modulo the prime.

    `words` are numbers below the prime, padded behind by last + size numbers
    that occur nowhere else. Of blocks of more than WIDEST words only so many
    are compared, and their distances are taken in stretches.
    """
    if size > WIDEST:
        parts = [zero_distances(words, starts, WIDEST, d, min(d + 2 * WIDEST, last)) for d in range(first, last + 1, 2 * WIDEST + 1)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    spread = last - first + size
    n = 1 << max(1, (spread - 1).bit_length())
    found_starts, found = [], []
    for at in range(0, len(starts), max(1, PLACES // n)):
        some = starts[at : at + max(1, PLACES // n)]
        blocks = words[some[:, None] + np.arange(size)]
        windows = words[some[:, None] + np.arange(first, first + spread)]
        x, y = np.zeros((len(some), n), np.uint64), np.zeros((len(some), n), np.uint64)
        x[:, :size], y[:, :spread] = blocks[:, ::-1], windows
        product = back(transform(x) * transform(y) % MODULUS)[:, size - 1 : spread]
        squares = np.concatenate([np.zeros((len(some), 1), np.uint64), np.cumsum(windows * windows % MODULUS, axis=1)], axis=1)
        theirs = (squares[:, size:] - squares[:, :-size]) % MODULUS
        own = (blocks * blocks % MODULUS).sum(axis=1) % MODULUS
        differ = (own[:, None] + theirs + np.uint64(2) * (MODULUS - product)) % MODULUS
        row, place = np.nonzero(differ == 0)
        found_starts.append(some[row])
        found.append(place + first)
    return np.concatenate(found_starts), np.concatenate(found)


def _alike(words: np.ndarray, i: int, j: int, step: int = 64) -> int:
    """How many words from i on equal those from j on (i < j)."""
    start, n = i, len(words)
    while j < n:
        size = min(step, n - j)
        differ = words[i : i + size] != words[j : j + size]
        if differ.any():
            return i + int(differ.argmax()) - start
        i, j, step = i + size, j + size, step * 2
    return i - start


def _alike_before(words: np.ndarray, i: int, j: int, step: int = 64) -> int:
    """How many words before i equal those before j (i < j)."""
    start = i
    while i > 0:
        size = min(step, i)
        differ = words[i - size : i] != words[j - size : j]
        if differ.any():
            return start - i + int(differ[::-1].argmax())
        i, j, step = i - size, j - size, step * 2
    return start


@functools.lru_cache(maxsize=4096)
def _prime_factors(q: int) -> tuple[int, ...]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return tuple(out + [q] * (q > 1))


def scales(n: int) -> Iterator[tuple[int, int, int]]:
    """(block size, least and greatest distance) of the scales that a text of n words needs."""
    yield 2, 6, 6  # six matching places
    yield 4, 1, 14
    size = 8
    while 2 * size - 1 <= n // 2:
        yield size, 2 * size - 1, 4 * size - 2
        size *= 2


def runs_of(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(least, 2 * period) words, by start, then period; least is 12 or more.

    `words` are numbers from 0 on, equal for equal words.
    """
    n = len(words)
    if n < max(least, LEAST):
        return []
    order = np.argsort(words, kind="stable")
    again = np.full(n, n, np.int64)  # distance to the next occurrence of the word
    same = words[order[1:]] == words[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    top = int(words.max()) + 1
    reach = np.zeros(n, np.int64)  # end of the run of a small period that the place is in
    found, waiting = {}, []
    padded = None
    for size, first, last in scales(n):
        starts = np.arange(0, n - first - size + 1, size)
        if not len(starts):
            break
        farthest = again[: len(starts) * size].reshape(-1, size).max(axis=1)
        starts = starts[farthest <= last]
        if not len(starts):
            continue
        for begin, end, q in [w for w in waiting if w[2] <= size]:
            np.maximum(reach[begin:end], end, out=reach[begin:end])
        waiting = [w for w in waiting if w[2] > size]
        starts = starts[reach[starts] < np.minimum(starts + last + size, n)]
        if not len(starts):
            continue
        if padded is None or len(padded) < n + last + size:
            padded = np.concatenate([words.astype(np.uint64), np.full(last + size, top, np.uint64)])
        at, distance = zero_distances(padded, starts, size, first, last)
        new = (at + distance + size <= n) & (at + distance + size > reach[at])
        at, distance = at[new], distance[new]
        done = -1, 0  # distance and end of the stretch extended last
        for k in np.lexsort((at, distance)).tolist():
            s, q = int(at[k]), int(distance[k])
            if done[0] == q and s < done[1]:
                continue
            right = _alike(words, s, s + q)
            if right < size:
                continue
            left = _alike_before(words, s, s + q)
            done = q, s + right
            begin, length = s - left, left + right + q
            if length < max(least, 2 * q) or (begin, q) in found:
                continue
            if any(_alike(words, begin, begin + q // f) >= length - q // f for f in _prime_factors(q)):
                continue
            found[begin, q] = length
            waiting.append((begin, begin + length, q))
    return sorted((begin, length, q) for (begin, q), length in found.items())


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows with n_words, runs (array of start, length, period) and collapsed.

    `collapsed` is the text without the repetitions: a word goes if it lies behind
    the first period of a run; kept words are joined by one space.
    """
    arrow_batches(docs.sparkSession, 1000)
    names = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_of(text).cast("binary").alias("t"))
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for value in batch.column(1):
                words = value.as_py().split()  # bytes: exactly the ASCII white space
                numbers: dict[bytes, int] = {}
                coded = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                found = runs_of(coded, least)
                counts.append(len(words))
                runs.append([{"start": s, "length": length, "period": q} for s, length, q in found])
                if found:
                    kept = np.ones(len(words), bool)
                    for s, length, q in found:
                        kept[s + q : s + length] = False
                    words = [words[i] for i in np.flatnonzero(kept)]
                texts.append(b" ".join(words).decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(entry)), pa.array(texts, pa.string())]
            yield pa.record_batch(columns, names=["row", "n_words", "runs", "collapsed"])

    row = rows.schema["row"].dataType.simpleString()
    schema = f"row {row}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(find, schema).select("row.*", "n_words", "runs", "collapsed")


def with_planted_period(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every tenth text (by the checksum of its id) repeats a stretch of its words from some word on.

    With h the CRC-32 of the decimal id and g = h / 10: where h is a multiple of
    ten, words from a = g % n on repeat the first 1 + (n - a) / (3 + g % 8) of them.
    A null id is never chosen.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))

    def edited(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")

    split = F.array(words_of(text_of(text)))
    one = F.get(F.transform(split, lambda w: F.when(F.size(w) > 0, edited(w)).otherwise(F.lit(""))), F.lit(0))
    return docs.withColumn(text, F.when(chosen, one).otherwise(F.col(text)))
