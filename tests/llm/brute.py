"""Plain Python versions of the operators, one document after another. Documents are (id, text) pairs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(doc_id):
    return (doc_id is not None, doc_id or 0)


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(LOW)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=order)
        used = False
        for i in sorted(ids, key=order, reverse=True):
            out.append((i, keep, len(ids), i == keep and not used, sha(text)))
            used = used or i == keep
    return out


def pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in reversed(s)]
        return (sum(d[::2]) + sum(2 * x - 9 if x > 4 else 2 * x for x in d[1::2])) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    found = {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m.group())] for k, (p, ok) in kinds.items()}
    return {k: len(v) for k, v in found.items()}, sha(",".join(f"{k}:{a}:{z}" for k, v in found.items() for a, z in v))


def pii_candidates(text):
    """Matches of the wide patterns with features and votes, spelled out by kind."""
    patterns = {
        "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?: ?(?:\[at\]|\(at\)|\{at\}) ?| at )[A-Za-z0-9-]+(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?| dot )[A-Za-z0-9-]+)+",
        "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
        "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])",
        "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}",
    }
    cues = {"email": "mail|contact|write|reach", "iban": "iban|account|bank|konto|compte|cuenta", "identity": "ssn|social|security|identity|tax", "phone": "phone|call|tel|fax|mobile|contact", "secret": "token|key|secret|password|passwd|pwd|auth|bearer|credential"}
    against = "isbn|doi|commit|sha|md5|version|order|invoice|http|path|page|figure"
    out, last = [], 0
    for m in re.finditer("|".join(f"(?P<{k}>{p})" for k, p in patterns.items()), text):
        kind, v, gap = m.lastgroup, m.group(), text[last : m.start()][-40:]
        last = m.end()
        digits = sum(c.isdigit() for c in v)
        near = lambda words: re.search(f"(?i)({words})[^A-Za-z]{{0,12}}$", gap) is not None  # noqa: B023, E731
        strict = {
            "secret": 1 if re.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}", v) else -1,
            "identity": 1 if re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", v) else 0,
            "phone": 1 if re.fullmatch(r"(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", v) else -1,
            "email": 1 if re.search(r"[\[({]at[\])}]", v) else -1,
            "iban": 1 if 15 <= len(v.replace(" ", "")) <= 34 else 0,
        }[kind]
        gazetteer = {
            "email": 1 if re.search("(?i)(com|org|net|edu|gov|io|de|fr|es|uk|info|eu)$", v) else 0,
            "secret": 1 if re.match("AKIA|ASIA|ghp_|gho_|sk-|pk_|xox|AIza|eyJ|glpat-", v) else -1,
            "iban": 1 if v[:2] in "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split() else 0,
        }.get(kind, -1)
        shape = -1 if kind != "secret" else 1 if digits >= 4 and re.search("[A-Za-z]", v) and re.search("[0-9][A-Za-z]+[0-9]", v) else 0 if digits < 2 else -1
        length = sum(len(v) >= n for n in (16, 24, 36, 48, 80))
        cased = 2 if re.search("[a-z]", v) and re.search("[A-Z]", v) else 1 if re.search("[A-Z]", v) else 0
        out.append({"kind": kind, "s": m.start(), "e": m.end(), "length": length, "digits": int(4.0 * digits / len(v)), "cased": cased, "strict": strict, "gazetteer": gazetteer, "cue": 1 if near(cues[kind]) else -1, "against": 0 if near(against) else -1, "shape": shape})
    return out


def naive_bayes(combos, estimate, voters):
    """Whether features are likelier personal data, learned from counts of features whose last are the votes."""
    patterns = Counter()
    for f, n in combos.items():
        patterns[(f[0], *f[-voters:])] += n
    posterior = estimate(patterns)
    weight = {1: Counter(), 0: Counter()}
    for f, n in combos.items():
        p = posterior[(f[0], *f[-voters:])]
        for c, w in ((1, n * p), (0, n * (1 - p))):
            weight[c]["all"] += w
            for j, v in enumerate(f):
                weight[c][j, v] += w
    levels = [len({f[j] for f in combos}) for j in range(len(next(iter(combos))))]

    def log(c, f):
        return math.log(weight[c]["all"]) + sum(math.log((weight[c][j, v] + 0.5) / (weight[c]["all"] + 0.5 * levels[j])) for j, v in enumerate(f))

    return lambda f: log(1, f) > log(0, f)


def unigram(docs):
    tokens = [(i, SPACE.findall((t or "").translate(LOW)) + [None]) for i, t in docs]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, ws in tokens if not out_of(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, out_of(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


def contaminated(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, items_ = ALNUM.findall((t or "").translate(LOW)), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    items_ |= {str(x) for x in found if x is not None}
        out.append((i, len(w), len(hit), len(items_), sha(",".join(sorted(items_))), bool(hit)))
    return out


def substrings(docs, span=20):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: order(d[0])):
        w = SPACE.findall(t or "")
        gone = set()
        for k in range(len(w) - span + 1):
            key = tuple(w[k : k + span])
            if key in seen:
                gone.update(range(k, k + span))
            seen.add(key)
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def shingle_counts(text, size=5):
    w = ALNUM.findall((text or "").translate(LOW))
    return Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) or (Counter([tuple(w)]) if w else Counter())


def alike(a, b, threshold=0.8):
    """Whether the Jaccard or the probability Jaccard similarity of two counters is at least the threshold."""
    both = a.keys() & b.keys()
    if not both:
        return not a and not b
    if len(both) >= threshold * len(a.keys() | b.keys()) - 1e-12:
        return True
    m, n = sum(a.values()), sum(b.values())
    every = [(a[k] / m, b[k] / n) for k in a.keys() | b.keys()]
    return sum(1 / sum(max(p / (a[k] / m), q / (b[k] / n)) for p, q in every) for k in both) >= threshold - 1e-12


def near_classes(docs, threshold=0.8):
    """Class of each document by position: the smallest id of those joined by links."""
    counts = [shingle_counts(t) for _, t in docs]
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if alike(counts[a], counts[b], threshold):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[top(k)] = min(least.get(top(k), i), i, key=order)
    return [least[top(k)] for k in range(len(docs))]


MASK = (1 << 64) - 1
BASE, SALT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & MASK
    return x ^ x >> 31


def polynomial(values):
    total = 0
    for v in reversed(values):
        total = (total * BASE + v) & MASK
    return mix((total + len(values) * SALT) & MASK)


BYTES = [mix((i + 1) * BASE & MASK) for i in range(256)]


def line_chunks(text, roll=2, divisor=2, least=2):
    """(first line, end line) pairs."""
    hashes = [polynomial([BYTES[b] for b in line.encode()]) for line in text.split("\n")]
    out, start = [], 0
    for k in range(roll - 1, len(hashes)):
        if polynomial(hashes[k - roll + 1 : k + 1]) % divisor == 0 and k + 1 - start >= least and len(hashes) - k - 1 >= least:
            out.append((start, k + 1))
            start = k + 1
    return [*out, (start, len(hashes))]


def lines(docs):
    texts = [(i, (t or "").split("\n"), line_chunks(t or "")) for i, t in sorted(docs, key=lambda d: order(d[0]))]
    first, out = {}, []
    for n, (i, own, chunks) in enumerate(texts):
        gone = set()
        for k, (a, z) in enumerate(chunks):
            body = tuple(own[a:z])
            if z - a < 2:
                continue
            if body not in first:
                first[body] = (n, k)
                continue
            m, j = first[body]
            other, its = texts[m][1], texts[m][2]
            up, down = 0, 0
            if k and j:
                while a - up > chunks[k - 1][0] and its[j][0] - up > its[j - 1][0] and own[a - up - 1] == other[its[j][0] - up - 1]:
                    up += 1
            if k + 1 < len(chunks) and j + 1 < len(its):
                while z + down < chunks[k + 1][1] and its[j][1] + down < its[j + 1][1] and own[z + down] == other[its[j][1] + down]:
                    down += 1
            gone.update(range(a - up, z + down))
        out.append((i, len(own), len(gone), sha("\n".join(x for k, x in enumerate(own) if k not in gone))))
    return out


def interpolated(docs):
    """(id, score) by deleted interpolation of bigram, unigram and uniform estimates."""
    part = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 7
    texts = [(i, [*SPACE.findall((t or "").translate(LOW)), None]) for i, t in docs]

    def counted(parts):
        words, pairs = Counter(), Counter()
        for i, own in texts:
            if part(i) in parts:
                words.update(own)
                pairs.update(zip(["", *own[:-1]], own, strict=True))
        return words, pairs, sum(words.values())

    def estimates(own, counts):
        """Bucket of the context, unigram and bigram estimate of each word. A text's start is as frequent as its end."""
        words, pairs, total = counts
        for before, word in zip(["", *own[:-1]], own, strict=True):
            context = words[before or None]
            yield min(int(math.log2(context + 1)), 15), words[word] / max(total, 1), min(pairs[before, word] / context, 1) if context else 0

    def grid(p, uniform):
        return 2 ** (min(max(round((math.log2(p / uniform) + 12) * 2), 0), 128) / 2 - 12) if p else 0

    def fit(found, start, rows):
        w = start
        for _ in range(100 if found else 0):
            total = [0.0] * 3
            for p, n in found.items():
                whole = sum(x * y for x, y in zip(p, w, strict=True))
                for k in range(3):
                    total[k] += n * p[k] * w[k] / whole
            w = [(total[k] + rows * start[k]) / (sum(found.values()) + rows) for k in range(3)]
        w = [max(x, 1e-5) for x in w]
        return [x / sum(w) for x in w]

    kept = counted({-1, 0, 1, 4, 5, 6})
    uniform = 1 / (len(kept[0]) + 1)
    by_bucket, every = defaultdict(Counter), Counter()
    for i, own in texts:
        if part(i) == 3:
            for bucket, one, two in estimates(own, kept):
                p = (1.0, grid(one, uniform), grid(two, uniform))
                by_bucket[bucket][p] += 1
                every[p] += 1
    overall = fit(every, [1 / 3] * 3, 1)
    weights = [fit(by_bucket[b], overall if b else [0.5, 0.5, 0.0], 20) for b in range(16)]
    train = counted({-1, 0, 1, 3, 4, 5, 6})
    uniform = 1 / (len(train[0]) + 1)
    return [(i, sum(math.log10(weights[b][0] * uniform + weights[b][1] * one + weights[b][2] * two) for b, one, two in estimates(own, train))) for i, own in texts]


def accepted(docs, labels, statistics):
    """Documents that a quadratic discriminant over statistics(texts) accepts, fit on labelled ones with crc32(id) mod 3 other than 1."""
    x = statistics([t for _, t in docs])
    rows = {k: np.array([v for (i, _), v in zip(docs, x, strict=True) for j, y in labels if i == j and y == k and zlib.crc32(str(j).encode()) % 3 != 1]) for k in (0, 1)}
    n = {k: len(v) for k, v in rows.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in rows.items()}
    pooled = sum(n[k] * cov[k] for k in (0, 1)) / sum(n.values())
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    log_density = {}
    for k in (0, 1):
        own = (0.8 * cov[k] + 0.2 * pooled) / np.outer(scale, scale)
        own = 0.95 * own + 0.05 * (np.trace(own) / len(own) + 1e-6) * np.eye(len(own))
        z = (x - rows[k].mean(0)) / scale
        log_density[k] = np.log(n[k] / sum(n.values())) - 0.5 * (np.sum(z @ np.linalg.inv(own) * z, axis=1) + np.linalg.slogdet(own)[1])
    return [d for d, good in zip(docs, log_density[1] >= log_density[0], strict=True) if good]
