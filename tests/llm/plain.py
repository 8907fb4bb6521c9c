"""Plain versions of the operators, one row at a time."""

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
import xxhash


def fingerprint(text: str, n: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: dict, radius: int) -> dict:
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def repeats(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each text which bytes a repeated window covers."""
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def kept(body: bytes, gone: np.ndarray) -> bytes:
    return bytes(np.frombuffer(body, np.uint8)[~gone])


def runs(gone: np.ndarray) -> int:
    return int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def encoding() -> tiktoken.Encoding:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def smith_waterman(a: list, b: list) -> int:
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def toxic_evidence(rows: list[tuple[str | None, int | None]], discount: float) -> list[tuple[float, int]]:
    """Log ratio of the toxic and the ordinary model over each text's words, and its words; (text, label) in, one label a text."""
    split = [re.findall("[a-z0-9]+", (t or "").lower()) for t, _ in rows]
    counts: dict[tuple, list[int]] = {}
    for words, label in {(tuple(w), x) for w, (_, x) in zip(split, rows, strict=True) if x is not None}:
        for e in {(w,) for w in words} | set(zip(words, words[1:], strict=False)):
            counts.setdefault(e, [0, 0])[label] += 1
    sums = {n: [sum(c[k] for e, c in counts.items() if len(e) == n) for k in (0, 1)] for n in (1, 2)}
    odds = {n: math.log((s[1] + 0.5) / (s[0] + 0.5)) for n, s in sums.items()}

    def ratio(e: tuple, log_odds: float) -> float:
        n = counts.get(e, [0, 0])
        out = []
        for k, p in ((1, 1 / (1 + math.exp(-log_odds))), (0, 1 / (1 + math.exp(log_odds)))):
            want = sum(n) * p
            off = n[k] - want
            f = (want + math.copysign(max(abs(off) - discount * math.sqrt(want + 1), 0), off)) / want if want else 1.0
            out.append(math.log(max(f, 1e-3)))
        return out[0] - out[1]

    found = []
    for words in split:
        lone = [ratio((w,), odds[1]) for w in words]
        pairs = [ratio((a, b), odds[2] + x + y) for a, b, x, y in zip(words, words[1:], lone, lone[1:], strict=False)]
        found.append((sum(lone) + sum(pairs), len(words)))
    return found
