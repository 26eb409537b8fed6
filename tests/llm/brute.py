"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLANK_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").encode().translate(LOW)


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


class Sets:
    def __init__(self, n):
        self.of = list(range(n))

    def find(self, x):
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def fingerprint(text):
    import xxhash

    words = BLANK_WORDS.findall(lower(text))
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(rows):
    """[(doc_id, fingerprint, component)] of (doc_id, text)."""
    prints = [fingerprint(t) for _, t in rows]
    sets = Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                sets.join(i, j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[sets.find(k)] = min(doc_id, least.get(sets.find(k), doc_id))
    return [(rows[k][0], f"{prints[k]:016x}", least.get(sets.find(k))) for k in range(len(rows))]


def contamination(docs, items, window=10):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)]."""
    windows = {}
    for item, text in items:
        words = PLAIN_WORDS.findall(lower(text))
        n = min(window, len(words))
        for k in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[k : k + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        words, hit, found = PLAIN_WORDS.findall(lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if own := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def unigram(rows):
    """[(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)] of (doc_id, text)."""
    tokens = [[*BLANK_WORDS.findall(lower(t)), None] for _, t in rows]
    held = [crc(i) % 10 == 0 for i, _ in rows]
    counts = Counter(w for words, out in zip(tokens, held) if not out for w in words)
    n, v = sum(counts.values()), len(counts)
    log = lambda w: math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
    return [(i, out, len(words), sum(counts[w] > 0 for w in words), n, sum(map(log, words))) for (i, _), words, out in zip(rows, tokens, held)]


def tree_score(training, text, depth, divergence):
    """log10 of the probability of ``text`` by the suffix tree of ``training``."""
    symbols = lambda t: b"\n" * depth + b" ".join(BLANK_WORDS.findall(lower(t))) + b"\n"
    after = {}
    for t in map(symbols, training):
        for i in range(depth, len(t)):
            for k in range(depth + 1):
                after.setdefault(t[i - k : i], Counter())[t[i]] += 1
    states = {b""}
    for context, own in after.items():
        if context:
            parent, total, free = after[context[1:]], sum(own.values()), max(len(own) - 1, 1)
            gain = sum(n * math.log(n / total / (parent[b] / sum(parent.values()))) for b, n in own.items())
            if gain >= divergence * total and 2 * gain >= free + 4 * math.sqrt(2 * free):
                states.update(context[j:] for j in range(len(context)))
    score, t = 0.0, symbols(text)
    for i in range(depth, len(t)):
        p = 1 / 256
        for k in range(depth + 1):
            if (own := after.get(t[i - k : i])) and t[i - k : i] in states:
                p = (own[t[i]] + len(own) * p) / (sum(own.values()) + len(own))
        score += math.log10(p)
    return score


def near_vectors(rows, cosine=0.9):
    """[(vec_id, n_links, component_id, kept)] of (vec_id, embedding)."""

    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    dim = max([len(v) for _, v in rows if fine(v)], default=1)
    unit = [np.pad(np.array(v, float), (0, dim - len(v))) / np.linalg.norm(v) if fine(v) else np.zeros(dim) for _, v in rows]
    product = np.array(unit) @ np.array(unit).T if rows else np.zeros((0, 0))
    sets, links = Sets(len(rows)), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and product[i, j] >= cosine:
                links[i] += 1
                sets.join(i, j)
    least = {}
    for k, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[sets.find(k)] = min(vec_id, least.get(sets.find(k), vec_id))
    return [(i, links[k], least.get(sets.find(k)), i == least.get(sets.find(k))) for k, (i, _) in enumerate(rows)]


def token_rows(rows, path, end=2):
    """[(doc_id, start, n_tokens, ids_crc32)] of (doc_id, text), in the order of the files but for ties."""
    from tokenizers import Tokenizer

    code, at, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*code.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def copies(rows, temperature=0.7, seed=17):
    """Counter of (doc_id, text): copies, of (doc_id, text, source)."""
    size = lambda t: len((t or "").encode()) + 1
    total = Counter()
    for _, text, source in rows:
        total[source] += size(text)
    weight = {s: b**temperature for s, b in total.items()}
    out = Counter()
    for doc_id, text, source in rows:
        rate = weight[source] / sum(weight.values()) * sum(total.values()) / total[source]
        u = (int(hashlib.md5(f"{seed}|{'' if doc_id is None else doc_id}|{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        n, p = 0, math.exp(-rate)
        below = p
        while below < u:
            n += 1
            p *= rate / n
            below += p
        out[doc_id, text, source] += n
    return +out


def variants(docs, least_length=6, least_count=5, ratio=5, typo=199):
    """[(word, n, n_near, form, form_n, root)] of (doc_id, text)."""
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.encode().translate(LOW).decode()
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % typo == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: set() for w in words}
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((k, w[:k] + w[k + 1 :]), []).append(w)  # replaced
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()]


def whitened(vectors, components=4):
    """[(vec_id, n, deviation, coordinates)], explained of (vec_id, embedding); coordinates up to their signs."""
    rows = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in rows), default=0)
    rows = [(i, [*v, *[0] * (dim - len(v))]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = [[n * c - s for c, s in zip(v, sums)] for v in fit]
    cov = np.array([[sum(r[i] * r[j] for r in z) / n**3 for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = [(i, n, sum((n * c - s) ** 2 for c, s in zip(v, sums)), (np.array(v) - np.array(sums) / n) @ vectors / np.sqrt(values)) for i, v in rows]
    return out, values / np.trace(cov)


def spots(text, anchors, chain=2):
    """The set of a text's signatures, in words."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out = set()
    for i, w in enumerate(words):
        after = [x for x in words[i + 1 :] if x not in anchors][:chain]
        if w in anchors and len(after) == chain:
            out.add((w, *after))
    if out or not words:
        return out
    return {tuple(words[k : k + chain + 1]) for k in range(max(1, len(words) - chain))}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies(rows, least=0.8, shingle=5):
    """(doc_ids that stay, near pairs of different texts, those of them within reach of the fingerprints) of (doc_id, text), doc_ids distinct."""
    import itertools

    from spendlake.llm import simhash

    words = [BLANK_WORDS.findall(lower(t)) for _, t in rows]
    sets = [{tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set() for w in words]
    prints = [simhash.wide_fingerprint(h) for h in simhash.shingles(pa.array([t for _, t in rows], pa.string()), shingle)]
    pivots = simhash.Pivots.narrow(simhash.NEAR_BLOCKS, simhash.NEAR_BITS, simhash.NEAR_WORDS, 1)
    masks = [np.array(m, np.uint64).view(np.int64) for m in pivots.blocks]
    groups, near, found = Sets(len(rows)), 0, 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][1] == rows[j][1] or not sets[i] and not sets[j]:
            groups.join(i, j)
        elif likeness(sets[i], sets[j]) >= least:
            near += 1
            differ = prints[i] ^ prints[j]
            bits = np.bitwise_count(differ.view(np.uint64)).sum()
            if bits <= simhash.NEAR_LIMIT and any(not (differ & m).any() for m in masks):
                found += 1
                groups.join(i, j)
    least_id = {}
    for k, (i, _) in enumerate(rows):
        least_id[groups.find(k)] = min(i, least_id.get(groups.find(k), i))
    return set(least_id.values()), near, found


def languages(rows, min_share=2e-5, slot_bits=20, multipliers=(0x9E3779B1, 0x85EBCA77)):
    """{doc_id: (held_out, lang_pred, score)} of (doc_id, text, lang), each language below the sample size."""
    import unicodedata

    def grams(text):
        folded = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in lower(text))
        folded = b" " + b" ".join(folded.split(b" ")) + b" "
        while b"  " in folded:
            folded = folded.replace(b"  ", b" ")
        return [int.from_bytes(folded[k : k + 4], "little") for k in range(len(folded) - 3)]

    def slots(gram):
        return [(gram * m & 0xFFFFFFFF) >> 32 - slot_bits for m in multipliers]

    counts, sizes = {}, Counter()
    for i, text, lang in rows:
        if crc(i) % 3 != 1 and text is not None and lang is not None:
            sizes[lang] += 1
            counts.setdefault(lang, Counter()).update(grams(text))
    order = sorted(sizes, key=lambda x: (-sizes[x], x))
    filters = []
    for lang in order:
        total = sum(counts[lang].values())
        bits = {s for g, n in counts[lang].items() if n >= max(2, total * min_share) for s in slots(g)}
        filters.append((bits, (len(bits) / (1 << slot_bits)) ** 2))
    out = {}
    for i, text, _ in rows:
        own = grams(text)
        shares = [min(1, max(0, (sum(all(s in bits for s in slots(g)) for g in own) / max(1, len(own)) - false) / max(1 - false, 1e-9))) for bits, false in filters]
        letter = any(unicodedata.category(c).startswith("L") for c in text or "")
        best = max(range(len(order)), key=lambda k: (shares[k], -k))
        out[i] = (crc(i) % 3 == 1, order[best] if letter else "und", shares[best] if letter else 0.0)
    return out
