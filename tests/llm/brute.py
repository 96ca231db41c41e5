"""Plain versions of the operators, written from their contracts and docstrings. Nothing of the library is imported."""

import hashlib
import heapq
import io
import itertools
import math
import re
import wave
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
import zstandard

M = (1 << 64) - 1
UPPER = {c: c + 32 for c in range(65, 91)}


# --- near-duplicates ---------------------------------------------------------------------------------------------


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(texts, n):
    """For each text the places of all texts of its class, itself included."""
    sets = [shingles(t, n) for t in texts]
    by = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    label = list(range(len(sets)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    pairs = {}
    for of in by.values():
        for a, b in combinations(of, 2):
            pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), both in pairs.items():
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
    members = {}
    for k in range(len(sets)):
        members.setdefault(root(k), []).append(k)
    return sets, [members[root(k)] for k in range(len(sets))]


# --- licences ----------------------------------------------------------------------------------------------------


def licenses(texts, templates):
    """{(id, license): (windows, best containment, first word, last word)}"""
    out = {}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingle = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    for i, t in texts:
        every = shingle(words(t))
        for name, template in templates.items():
            w = words(template)
            want = set(shingle(w))
            if not want:
                continue
            width, step = (len(w), 1) if len(w) <= 12 else (math.ceil(1.25 * len(w)), len(w) // 8)
            for at in range(0, len(every), step):
                share = len(want & set(every[at : at + width - 4])) / len(want)
                if share >= 0.8:
                    n, best, first, last = out.get((i, name), (0, 0, at, at))
                    out[i, name] = (n + 1, max(best, share), min(first, at), max(last, at + width - 1))
    return out


# --- secrets -----------------------------------------------------------------------------------------------------

ORDER = ("assign", "access", "hex", "novel")


def base_secrets(text):
    found = [(*m.span(), "assign") for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    found += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[0], ORDER.index(x[2])))


def novel_secrets(text, context, identifiers):
    taken = np.zeros(len(text) + 1, bool)
    for a, b, _ in base_secrets(text):
        taken[a:b] = True
    near = np.zeros(len(text) + 1, bool)
    for c in re.finditer("|".join(map(re.escape, context)), text, re.ASCII | re.IGNORECASE):
        near[c.end() : c.end() + 64] = True
        if head := re.compile(r"[ A-Z]*KEY[ A-Z]*-----").match(text, c.end()):
            near[c.end() : max(c.end(), text.find("-----END", head.end()))] = True
    z = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
    size = lambda x: len(z.compress(x.encode()))
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=~.-]{16,}", text):
        a, end = m.span()
        if not near[a]:
            # a context word inside a run opens the run's own rest
            a = next((k for k in range(a, end) if near[k]), end)
            if end - a < 16:
                continue
        at = a
        while at < end:
            stop = at
            while stop < end and not taken[stop]:
                stop += 1
            if stop - at >= 12:
                before, after = text[max(0, at - 200) : at], text[stop : stop + 200]
                cost = size(before + text[at:stop] + after) - size(before + after)
                if cost >= 12 and cost >= 0.6 * (stop - at):
                    out.append((at, stop, "novel"))
            at = max(stop, at + 1)
            while at < end and taken[at]:
                at += 1
    return out


def redacted(text, spans):
    out, done = "", 0
    for a, b, kind in sorted(spans, key=lambda x: (x[0], ORDER.index(x[2]))):
        if a >= done:
            out += text[done:a] + f"[{kind}]"
        done = max(done, b)
    return out + text[done:]


# --- quality -----------------------------------------------------------------------------------------------------


def statistics(text):
    raw = text.encode()
    logit = lambda x: math.log((x + 1e-3) / (1 - x + 1e-3))
    kinds = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b",.", b"|", b"#$%&*!@^~<>{}[]\\", b"\"'()-/:;?_+=`", bytes(range(128, 256))]
    words, lines = raw.split(), raw.split(b"\n")
    w, n = max(1, len(words)), max(1, len(raw))
    marked = [x for x in words if x[-1] < 128 and not chr(x[-1]).isalnum() and chr(x[-1]) not in ",."]
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p((len(raw) - len(words)) / w),
        *[logit(sum(raw.count(c) for c in k) / n) for k in kinds],
        logit(len(set(words)) / w), logit(max(Counter(words).values(), default=0) / w), logit(sum(a == b for a, b in zip(words, words[1:], strict=False)) / w),
        logit(len(set(lines)) / len(lines)), logit(len(marked) / w), math.log1p(len(words) / len(lines)),
    ]


def discriminant(known, texts):
    """Scores of `texts` by the labelled (text, label) of `known`: densities by determinants and inverses."""
    x, y = np.array([statistics(t) for t, _ in known]), np.array([k for _, k in known])
    cov = {k: np.cov(x[y == k].T, bias=True) for k in (0, 1)}
    pooled = sum((y == k).mean() * cov[k] for k in (0, 1))
    d = len(pooled)
    pooled = 0.98 * pooled + 0.02 * max(np.trace(pooled) / d, 1e-6) * np.eye(d)
    out = []
    for s in (np.array(statistics(t)) for t in texts):
        density = []
        for k in (0, 1):
            c, m = 0.9 * cov[k] + 0.1 * pooled, s - x[y == k].mean(axis=0)
            density.append(math.log((y == k).sum()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * m @ np.linalg.solve(c, m))
        out.append(1 / (1 + math.exp(min(500, max(-500, density[0] - density[1])))))
    return out


# --- decontamination ---------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination(text, items):
    """(words, hit words, sorted item ids)"""
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(13, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                ids.add("" if item is None else str(item))
    return len(w), len(hit), sorted(ids)


# --- media -------------------------------------------------------------------------------------------------------


def recording(text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    out = io.BytesIO()
    w = wave.open(out, "wb")
    w.setparams((1, 1, 8000, 0, "NONE", ""))
    w.writeframes(payload)
    w.close()
    return payload, out.getvalue()


def fingerprints(payload):
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    if len(set(payload)) == 1:
        return []
    pad, hop = (192, 32) if len(x) <= 320 else (128, 128)
    x = np.concatenate([np.zeros(pad, np.float32), x - x.mean(), np.zeros(pad + -len(x) % hop, np.float32)])
    peaks = []
    for at in range(0, len(x) - 255, hop):
        frame = x[at : at + 256]
        spectrum = np.abs(np.fft.rfft((frame - frame.mean()) * np.hanning(256).astype(np.float32)))
        best = [max(range(a, b), key=lambda k: spectrum[k]) for a, b in ((1, 9), (9, 25), (25, 57), (57, 129))]
        peaks.append([k if spectrum[k] > 1.5 * spectrum.mean() else 0 for k in best])
    out = []
    for t, own in enumerate(peaks):
        out += [t << 24 | a << 13 | b << 2 for a, b in combinations(own, 2) if a and b]
        out += [t << 24 | a << 13 | b << 2 | d for d in (1, 2, 3) if t + d < len(peaks) for a, b in zip(own, peaks[t + d], strict=True) if a and b]
    return sorted(out)


# --- toxicity ----------------------------------------------------------------------------------------------------


def grams(text):
    """Hashed words, pairs, skip-pairs and beginnings that several words share: {feature: value}"""
    raw = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in text.encode())
    h = [xxhash.xxh3_64_intdigest(w) for w in raw.split()]

    def pair(a, b, salt):
        x = ((a ^ salt) * 0x9E3779B97F4A7C15 + b) & M
        return (x ^ x >> 31) * 0xC2B2AE3D27D4EB4F & M

    out = {x >> 44: 1.0 for x in h}
    out |= {(1 << 20) + (pair(a, b, 0x51) >> 44): 0.3 for a, b in zip(h, h[1:], strict=False)}
    out |= {(2 << 20) + (pair(a, b, 0xA7) >> 44): 0.3 for a, b in zip(h, h[2:], strict=False)}
    words = sorted({w.decode() for w in raw.split()})
    for size in (3, 4, 5, 6, 7):
        for stem, group in itertools.groupby((w for w in words if len(w) > size), key=lambda w: w[:size]):  # noqa: B023
            alike = len(list(group))
            out |= {(3 << 20) + (xxhash.xxh3_64_intdigest(f"{stem} {m}".encode()) >> 44): 1.0 for m in (2, 3, 4) if alike >= m}
    return out


def ftrl(rows, epochs=8, l1=6.0, weight=2.0):
    """The weights that rows of (features, label) give, one after the other; None is the intercept."""
    z, n = {}, {}

    def w(k):
        v = z.get(k, 0.0)
        return -(v - (0 if k is None else math.copysign(l1, v))) / (1 + math.sqrt(n[k])) if k in z and (k is None or abs(v) > l1) else 0.0

    for _ in range(epochs):
        for x, y in rows:
            now = {k: w(k) for k in [*x, None]}
            total = now[None] + sum(now[k] * v for k, v in x.items())
            error = (1 / (1 + math.exp(-min(35, max(-35, total)))) - y) * (weight if y else 1)
            for k, v in [*x.items(), (None, 1.0)]:
                g, old = error * v, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) * now[k]
                n[k] = old + g * g
    return {k: v for k in z if (v := w(k))}


def crc_mod(key, n):
    return zlib.crc32(str(key).encode()) % n


# --- lines -------------------------------------------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def kept_lines(docs):
    """(id, lines, dropped, digest) of each (id, text); rows without an id are one document, after all others."""
    key = lambda line: line.strip(WHITE).translate(UPPER)
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(math.inf if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == (math.inf if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


# --- conversations -----------------------------------------------------------------------------------------------


def damage(rows):
    """Rows (conv, turn, role, text) after damage, by conversation; a conversation may have none."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind:
            own += [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of one conversation's (turn, role, text), by a search over whole strings of initials."""
    turns = [t for t, _, _ in rows if t is not None]
    faults = []
    for k, (_, role, text) in enumerate(rows):
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in [r[1:] for r in rows[:k]] else "truncated" if bare[-1] not in ".!?" else "")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    fits = re.compile("s?(ua)*u?").fullmatch
    best, todo = {}, [(0, "", 0, "", ())]
    while todo:
        cost, audit, k, initials, turned = heapq.heappop(todo)
        if (k, initials) in best:
            continue
        best[k, initials] = (cost, audit, turned)
        nxt = [(5, "I", k, initials + r, (*turned, f"{n}:")) for r, n in (("u", "user"), ("a", "assistant"))]
        if k < len(rows):
            _, role, text = rows[k]
            nxt.append((2, "D", k + 1, initials, turned))
            if faults[k] not in ("blank", "duplicate"):
                more = 5 if faults[k] == "truncated" else 0
                nxt.append((more, "K", k + 1, initials + role[:1], (*turned, f"{role}:{text}")))
                nxt += [(1 + more, "R", k + 1, initials + n[0], (*turned, f"{n}:{text}")) for n in ("user", "assistant")]
        for c, letter, at, own, out in nxt:
            if fits(own) and len(own) <= len(rows) + 3 and cost + c <= 2 * len(rows):  # deleting all is always possible
                heapq.heappush(todo, (cost + c, audit + letter, at, own, out))
    cost, audit, turned = min(v for (k, own), v in best.items() if k == len(rows) and re.fullmatch("(s?(ua)+)?", own))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(turned).encode()).hexdigest())


# --- manifest ----------------------------------------------------------------------------------------------------


def manifest(docs):
    """(id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def leaf(i, text, lang, source, n):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def climb(nodes):
        """The root, and of each node its runs with its place in them, level by level."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
            for w, k in zip(ways, at, strict=True):
                w.append((runs[k // 8], k % 8))
            at, nodes = [k // 8 for k in at], [h("".join(r)) for r in runs]
        return nodes[0], ways

    by = {}
    for row in docs:
        by.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([v[2] for v in sorted(by[x], key=lambda v: v[:3])]) for x in langs}
    root, tops = climb([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for (_, _, own, row), way in zip(sorted(by[x], key=lambda v: v[:3]), trees[x][1], strict=True):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None
            now = leaf(row[0], row[1].translate(UPPER), *row[2:]) if changed else own
            for run, k in way + top:
                now = h("".join(run[:k] + [now] + run[k + 1 :]))
            proof = h("".join("".join(run[:k] + run[k + 1 :]) for run, k in way + top))
            out.append((row[0], own, trees[x][0], root, proof, now, now == root))
    return out
