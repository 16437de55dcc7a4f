"""Brute-force versions and fixtures of the operators' tests."""
import collections
import hashlib
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def frame(spark, rows):
    """documents rows from (doc_id, text[, lang])."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows], DOCS)


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, tiny, null and long texts; (doc_id, text)."""
    rng = random.Random(seed)
    rows = []
    bases = [sentence(rng, rng.randint(30, 90)) for _ in range(12)]
    passage = sentence(rng, 60)
    for i in range(90):
        words = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        text = " ".join(words)
        if i % 9 == 0:
            text = f"{sentence(rng, 20)}\n{passage} {sentence(rng, 15)}"
        rows.append((i * 3 % 97, text))
    rows += [(200, None), (201, ""), (202, "  \n "), (203, "one"), (204, "One"), (205, "one two"), (206, "äöü ß " * 30), (207, "a" * 5000), (208, sentence(rng, 4000)), (209, "a" * 4000), (210, passage), (211, "é" * 60), (212, "é" * 70)]
    return list({r[0]: r for r in rows}.values())


def shingle_set(text, n):
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def jaccard_components(rows, n, num, den):
    sets = {i: shingle_set(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[root(b)] = root(a)
    groups = collections.defaultdict(list)
    for i in ids:
        groups[root(i)].append(i)
    return {i: (len(sets[i]), min(g)) for g in groups.values() for i in g}


def repeats(rows, length, least_bytes=0, over_words=None):
    """doc_id -> (bytes, removed, spans, digest, what is left); only for runs of starts whose strings cover so many bytes, or more words."""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        starts = [p for p in range(len(b) - length + 1) if first[b[p : p + length]] < i]
        for k, p in enumerate(starts):
            if k and starts[k - 1] == p - 1:
                continue
            end = p
            while k + 1 < len(starts) and starts[k + 1] == end + 1:
                k, end = k + 1, end + 1
            end += length
            if end - p >= least_bytes or over_words is not None and len(_WORD.findall(b[p:end])) > over_words:
                gone[p:end] = b"\1" * (end - p)
        left = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(left).hexdigest(), left)
    return out


def plain_words(text):
    return re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode().translate(_LOWER))


def longest_stretch(doc, item, least=13):
    """Words of the whole item where 80 % of it agree somewhere in the document, else of the longest stretch on any diagonal that starts and ends with equal words, 80 % of them equal; 0 if shorter than least."""
    best, n = 0, len(item)
    if n < 5:
        return n if doc == item else 0
    if any(5 * sum(a == b for a, b in zip(doc[i : i + n], item)) >= 4 * n for i in range(len(doc) - n + 1)):
        return n
    if n < least:
        return 0
    for g in range(-len(item) + 1, len(doc)):
        a, b = max(0, g), min(len(doc), g + len(item))
        same = [doc[p] == item[p - g] for p in range(a, b)]
        for s in range(len(same)):
            if same[s]:
                score = 0
                for e in range(s, len(same)):
                    score += 1 if same[e] else -4
                    if same[e] and score >= 0:
                        best = max(best, e - s + 1)
    return best if best >= least else 0
