"""Plain versions of what the operators do."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components(ids, links):
    low = {i: i for i in ids}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        p, q = top(a), top(b)
        low[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def noise(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def copies(rng, text, n, edits):
    out = []
    for _ in range(n):
        words = text.split()
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def rng(seed):
    return random.Random(seed)
