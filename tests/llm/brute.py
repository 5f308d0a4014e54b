"""Plain Python versions of what the operators give."""

import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    found = [w.translate(LOWER) for w in words(text)]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(things, alike):
    """For each of some things the position of the first one it is linked with, directly or not."""
    parent = list(range(len(things)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(things)):
        for j in range(i):
            if alike(things[i], things[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(things))]


def components(prints):
    """Groups of fingerprints with four or fewer differing bits."""
    return linked(prints, lambda a, b: (a ^ b).bit_count() <= 4)


def shingle_set(text):
    found = [w.translate(LOWER) for w in words(text)]
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def similar(texts):
    """Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""

    def alike(a, b):
        if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
            return False
        both = len(a & b)
        return 5 * both >= 4 * (len(a) + len(b) - both)

    return linked([shingle_set(t) for t in texts], alike)


def held_out(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 0


def without_repeats(texts, window=35):
    """For each text its words and whether each is covered by a repeated window."""
    split = [words(t) for t in texts]
    counts = {}
    for w in split:
        for i in range(len(w) - window + 1):
            counts[tuple(w[i : i + window])] = counts.get(tuple(w[i : i + window]), 0) + 1
    covered = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        covered.append(gone)
    return split, covered
