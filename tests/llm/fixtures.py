"""Small documents with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re
import zlib
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ASCII_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(rng, n):
    return " ".join("".join(rng.choice(("the", "an", "er", "tion", "ing", "th", "ed", "le", "ß", "é")) for _ in range(rng.randint(1, 3))) for _ in range(n))


def awkward(seed=1, n=60):
    """Rows with copies, near copies, shared passages, nulls, empty, blank and long texts, repeated rows and extra columns."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = [words(rng, rng.randint(3, 120)) for _ in range(n)]
    texts += [texts[0]] * 4 + [texts[1].upper(), texts[1]]
    base = words(rng, 150)
    for k in range(12):
        w = base.split(" ")
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(1000))
        texts.append(" ".join(w))
    texts += [f"{words(rng, 20)} {passage} {words(rng, 15)}" for _ in range(5)]
    texts += [None, "", "   \n\t ", "one", "one two", "one two", "a b c", "x" * 200, "x" * 200 + "y", words(rng, 20_000), "line one\nline one\nline two", "12 % & * $ # |", "🙂🙂 émoji ÉMOJI"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i * 3, texts[k], ["en", "de", None][k % 3], None if k % 7 == 0 else f"src{k % 3}", None if texts[k] is None else len(texts[k]), 0.5, k) for i, k in enumerate(order)]
    return rows + [rows[0], rows[5]]


def suffix_dedup(rows, length=50):
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    key = lambda d: float("inf") if d is None else d
    for d, b in data:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, float("inf")), key(d))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key(d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(_ASCII_LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_id = {}
    for i, (d, s) in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j][1])
            if s and sets[j][1] and 100 * both >= 75 * len(s | sets[j][1]) or (d is not None and d == sets[j][0] and s and s == sets[j][1]):
                parent[root(i)] = root(j)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            by_id[root(i)] = min(by_id.get(root(i), d), d)
    return sorted((d, len(s), by_id[root(i)] if s else d) for i, (d, s) in enumerate(sets))


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    twice = {g for g in grams if times[g] > 1}
    cover = set()
    for i, g in enumerate(grams):
        if g in twice:
            cover |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def kept(rows, spread, least):
    """doc_id to kept; rows (doc_id, text, lang, source). Quantiles: the value of rank q n, rounded up."""
    ratios = {"symbol": (2, 1, 1), "lines": (3, 5, 1), "repeat": (4, 0, 10), "length": (1, 0, None)}
    data = []
    for d, t, lang, source in rows:
        c = (*base_counts(t), len([x for x in (t or "").split("\n") if WORD.search(x)]))
        data.append((d, lang, source, c, {r: c[a] / max(c[b], 1) for r, (a, b, _) in ratios.items()}))

    def quantile(values, q):
        v = sorted(values)
        return v[max(0, min(len(v) - 1, -int(-(q * len(v)) // 1) - 1))]

    def level(part):
        out = {}
        for r, (_, b, _) in ratios.items():
            v = [x[4][r] for x in part]
            m = quantile(v, 0.5)
            up = min(quantile(v, 0.75) - m, (quantile(v, 0.6) - m) * 2.662)
            down = min(m - quantile(v, 0.25), (m - quantile(v, 0.4)) * 2.662)
            out[r] = (m, up, down, quantile([x[3][b] for x in part], 0.5))
        return out

    everything = level(data)
    langs = {k: [x for x in data if x[1] == k] for k in {x[1] for x in data}}
    groups = {k: [x for x in data if x[1:3] == k] for k in {x[1:3] for x in data}}
    of_lang = {k: level(p) if len(p) >= least else everything for k, p in langs.items()}
    of_group = {k: level(p) if len(p) >= least else of_lang[k[0]] for k, p in groups.items()}
    result = {}
    for d, lang, source, c, v in data:
        good = c[0] >= 10 and 100 * c[4] <= 20 * c[0]
        for r, (_, b, grain) in ratios.items():
            m, up, down, long = of_group[lang, source][r]
            if grain is None:
                wider = max(1.0, (long / max(c[b], 1)) ** 0.5)
                up, down = up * wider, down * wider
            else:
                up = max(up, grain / max(min(long, c[b]), 1))
            good = good and v[r] <= m + spread * up and (grain is not None or v[r] >= m - spread * down)
        result[d] = good
    return result


def copied(rows, items, window=10, few=5, enough=4, share=0.5):
    """(doc_id, item_id, windows, the item's windows) of the pairs that plain words decide."""
    def words(text):
        out = []
        for n, line in enumerate((text or "").split("\n")):
            out += [(w, n) for raw in WORD.findall(line) if (w := re.sub(r"^[^0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+$", "", raw).lower())]
        return out

    out = []
    known = [(i, [w for w, _ in words(t)]) for i, t in items]
    for d, text in rows:
        w = words(text)
        for i, own in known:
            k = min(window, len(own))
            if not k:
                continue
            mine = {tuple(own[q : q + k]) for q in range(len(own) - k + 1)}
            hits = set()
            for p in range(len(w) - k + 1):
                whole = (p == 0 or w[p - 1][1] < w[p][1]) and (p + k == len(w) or w[p + k][1] > w[p + k - 1][1])
                g = tuple(x for x, _ in w[p : p + k])
                if g in mine and (len(own) >= few or whole):
                    hits |= {q for q in range(len(own) - k + 1) if tuple(own[q : q + k]) == g}
            total = len(own) - k + 1
            if len(hits) >= enough or (hits and len(hits) >= share * total):
                out.append((d, i, len(hits), total))
    return out


def fold(i):
    return zlib.crc32(str(i).encode()) % 5
