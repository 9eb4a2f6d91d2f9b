"""Plain single-machine versions that the operators are held against."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def held(doc_id, buckets, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % buckets == remainder


def repeats(rows, k=20):
    """{(id, text): (n, removed, sha)} for rows of (id, text)."""
    first = {}
    docs = [(math.inf if i is None else i, words(t), i, t) for i, t in rows]
    for i, w, _, _ in docs:
        for s in range(len(w) - k + 1):
            key = tuple(w[s:s + k])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = {}
    for i, w, doc_id, t in docs:
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s:s + k])] != (i, s):
                gone.update(range(s, s + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[doc_id, t] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def fingerprint(text, n=3):
    w = words(ascii_lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def assign_spans(text):
    low = [("password",), ("passwd",), ("secret",), ("token",), ("apikey",), ("api_key",)]
    pat = re.compile("|".join("(?:" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k[0]) + ")" for k in low)
                     + "")
    full = re.compile("(?:" + pat.pattern + r""")["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""")
    return [("assign", m.start(), m.end()) for m in full.finditer(text) if len(m[1]) >= 6]


def secret_base(text):
    text = text or ""
    out = assign_spans(text)
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[1], rank[s[0]]))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii_base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    rank = {"email": 0, "ip": 1, "card": 2, "phone": 3}
    return sorted(out, key=lambda s: (s[1], rank[s[0]]))


def pii_context(text, found, k):
    """Words around match ``k`` of the matches ``found`` of one search."""
    s, e = found[k]
    low = max(s - 64, found[k - 2][0] if k > 1 else 0)
    high = min(e + 64, found[k + 2][1] if k + 2 < len(found) else len(text))
    left = re.findall(r"[^\x20\x09-\x0D]+", text[low:s].lower())[::-1][:2]
    right = re.match(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", text[e:high].lower())
    return left, right[1] if right else ""


def pii_spans(texts, rounds=3, support=5, confidence=0.8):
    """All spans of each text: fixed patterns, and candidates by bootstrapped contexts."""
    searches = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
                "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    every = []
    for d, text in enumerate(texts):
        text = text or ""
        base = pii_base(text)
        spots = {(k, s): e for k, s, e in base}
        for kind, pattern in searches.items():
            found = [m.span() for m in re.finditer(pattern, text)]
            every += [(d, kind, s, e, text[s:e], *pii_context(text, found, i))
                      for i, (s, e) in enumerate(found) if (kind, s) in spots]
        found = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if sum(c in "0123456789" for c in m[0]) > 1]
        every += [(d, "token", s, e, text[s:e], *pii_context(text, found, i)) for i, (s, e) in enumerate(found)
                  if not any(b[1] < e and b[2] > s for b in base)]

    def patterns(left, right):
        return ([("before", *left)] if len(left) == 2 else []) + ([("around", left[0], right)] if left and right else [])

    edges = defaultdict(bool)
    for _, kind, _, _, value, left, right in every:
        for p in patterns(left, right):
            edges[p, value] |= kind != "token"
    size = Counter(p for p, _ in edges)
    edges = {e: seed for e, seed in edges.items() if size[e[0]] >= support}
    score, good = {e: float(seed) for e, seed in edges.items()}, {}
    for _ in range(rounds):
        sums = defaultdict(float)
        for (p, _), c in score.items():
            sums[p] += c
        good = {p: c / size[p] for p, c in sums.items() if c / size[p] >= confidence}
        best = defaultdict(float)
        for p, v in edges:
            best[v] = max(best[v], good.get(p, 0.0))
        score = {(p, v): 1.0 if seed else best[v] for (p, v), seed in edges.items()}
    rank = ("email", "ip", "card", "phone", "context")
    out = [[(k, s, e) for k, s, e in pii_base(t or "")] for t in texts]
    for d, kind, s, e, _, left, right in every:
        if kind == "token" and any(p in good for p in patterns(left, right)):
            out[d].append(("context", s, e))
    return [sorted(x, key=lambda m: (m[1], rank.index(m[0]), m[2])) for x in out]


def spans_text(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


class Katz:
    """Bigram Katz model over rows of (id, text) that ``train`` keeps."""

    def __init__(self, rows, train, k=5):
        self.uni, self.bi, self.docs = Counter(), defaultdict(Counter), 0
        for i, t in rows:
            if train(i):
                toks = self.tokens(t)
                self.uni.update(toks)
                self.docs += 1
                for h, w in zip([None, *toks], toks):
                    self.bi[h][w] += 1
        self.n, self.v, self.k = sum(self.uni.values()), len(self.uni), k
        cc = Counter(c for ws in self.bi.values() for c in ws.values())
        rest = (k + 1) * cc[k + 1] / cc[1] if cc[1] else 1.0
        self.d = {}
        for r in range(1, k + 1):
            x = ((r + 1) * cc[r + 1] / (r * cc[r]) - rest) / (1 - rest) if cc[r] and rest < 1 else 0.0
            self.d[r] = x if 0 < x < 1 else (r - 0.5) / r

    @staticmethod
    def tokens(text):
        return [*words(ascii_lower(text)), "\n"]

    def base(self, w):
        return (self.uni[w] + 1) / (self.n + self.v + 1)

    def p(self, h, w):
        ws = self.bi.get(h)
        if not ws:
            return self.base(w)
        whole = sum(ws.values()) + (min(ws.values()) > self.k)
        seen = {x: self.d.get(c, 1.0) * c / whole for x, c in ws.items()}
        if w in seen:
            return seen[w]
        return (1 - sum(seen.values())) / (1 - sum(self.base(x) for x in ws)) * self.base(w)

    def score(self, text):
        toks = self.tokens(text)
        return (len(toks), sum(self.uni[w] > 0 for w in toks), sum(math.log10(self.base(w)) for w in toks),
                sum(math.log10(self.p(h, w)) for h, w in zip([None, *toks], toks)))


def water(sizes, weights=(5, 2, 1), cap=3.0):
    """{source: target} by repeated clamping."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        left, ws = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / ws > cap * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / ws for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def pairs(n):
    return itertools.combinations(range(n), 2)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=20):
    """[(item, rank, doc, score)] for rows of (id, text)."""
    held = [(i, Counter(TERM.findall(ascii_lower(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) *
                        ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in TERM.findall(ascii_lower(text)) if t in c)
            if score > 0:
                found.append((-score, math.inf if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return out


def damaged(rows):
    """Damaged (conv, turn, role, text) rows."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        r = zlib.crc32(key.encode()) % 20
        if r:
            text = "" if r == 1 else re.sub("[.!?]", "", text) if r == 2 else text
            out += [(conv, turn, "user" if r == 4 else role, text)] * (2 if r == 3 else 1)
    return out


def cheapest(rows, costs=(1, 2, 5, 5)):
    """(cost, audit, repaired messages) for (initial, fault, role, text) rows: whole edit
    strings are carried for every state of the pattern."""
    rerole, delete, insert, cut = costs
    best = {"": (0, "", [])}        # what the roles end in: nothing, s, u or a

    def put(table, state, x):
        if state not in table or x[:2] < table[state][:2]:
            table[state] = x

    def grown(table):
        for _ in range(4):
            for state, (c, audit, out) in list(table.items()):
                role = "assistant" if state == "u" else "user"
                put(table, role[0], (c + insert, audit + "I", [*out, (role, "")]))
        return table

    for initial, fault, role, text in rows:
        table = {}
        for state, (c, audit, out) in grown(best).items():
            put(table, state, (c + delete, audit + "D", out))
            if fault in "bd":
                continue
            more = cut if fault == "t" else 0
            if initial == "s" and state == "" or initial == "u" and state != "u" or initial == "a" and state == "u":
                put(table, initial, (c + more, audit + "K", [*out, (role, text)]))
            new = "assistant" if state == "u" else "user"
            put(table, new[0], (c + more + rerole, audit + "R", [*out, (new, text)]))
        best = table
    best = grown(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def conversations(rows):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)}"""
    groups = defaultdict(list)
    for conv, *rest in rows:
        groups[conv].append(rest)
    out = {}
    for conv, got in groups.items():
        got = sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), ""
        for _, role, text in got:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults += "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-"
            seen.add((role, text))
        turns = [t for t, _, _ in got if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        cost, audit, made = cheapest([(r[:1], f, r, x) for f, (_, r, x) in zip(faults, got)])
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"),
                     faults.count("t"), illegal, cost, audit, sha)
    return out
