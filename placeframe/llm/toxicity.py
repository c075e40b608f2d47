"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary labelled text and one on the toxic spans of toxic labelled text. A
toxic label covers a whole document of mostly ordinary words, so its toxic spans are found first: words that are, or have
a substring that is, in more toxic documents than chance allows, counted within each language and so that the bound does
not hang on other markers. The contrast is repeated on the toxic documents that no marker explains yet. A text is cut into
windows, and each is compressed twice, with the ordinary dictionary as history and with the toxic one put before it. The
bytes saved by the second are the distance: nothing for ordinary windows, several where the toxic dictionary holds a word
of the window.

The strongest windows, and the counts beyond thresholds calibrated on ordinary windows, make a logistic score, fitted on
folds that neither dictionary has seen.

Spans beyond ``TOXIC_BYTES`` are left out of the dictionary by their rank in their language. Two dictionaries trained on the
two classes' texts as they are, without the search for spans, do not tell the classes apart here (see the README).

A null or empty text gets the score of a text without windows of note; long texts are scored whole; repeated rows get equal
scores; without labels of both classes every score is the share of the class that is there (0 without any). Where the
labelled rows of a class all lie in the same folds, dictionaries and calibration share rows, and scores are too sure. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from placeframe.llm import dictionaries as D

WINDOW = 64
#: Bytes of a toxic marker besides whole words (a blank stands for a word's end); toxic documents that must have it; the
#: number of false markers that chance may add to a contrast.
MARKERS, MARKER_DOCS, CHANCE = (5, 8), 3, 0.1
ORDINARY_BYTES, TOXIC_BYTES = 96 * 1024, 64 * 1024
#: Shares of ordinary windows beyond each threshold.
TAILS = (0.01, 0.002, 0.0005)
TOP = 6
_WORD = re.compile(rb"[^\s.,!?;:|*#$%&]+")


def _markers(word: bytes) -> set[bytes]:
    if len(word) < 4:
        return set()
    w = b" " + word + b" "
    return {w} | {w[i : i + k] for k in MARKERS for i in range(len(w) - k + 1)}


def toxic_spans(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The words of toxic texts of one language, a byte of context about them, that toxic texts have more often than chance allows."""
    codes: dict[bytes, int] = {}
    known: dict[bytes, list[int]] = {}

    def coded(text: bytes) -> np.ndarray:
        for w in (words := set(_WORD.findall(text))):
            if w not in known:
                known[w] = [codes.setdefault(m, len(codes)) for m in _markers(w)]
        return np.unique(np.array([m for w in words for m in known[w]], np.int64))

    plain = [coded(t) for t in set(ordinary)]
    open_ = [coded(t) for t in set(toxic)]
    count = lambda parts: np.bincount(np.concatenate([*parts, np.zeros(0, np.int64)]), minlength=len(codes))
    seen, marked = count(plain), np.zeros(len(codes), bool)
    while open_:
        k = count(open_).astype(float)
        total, base = k + seen, len(open_) / (len(open_) + len(plain))
        tried = (k >= MARKER_DOCS) & ~marked
        with np.errstate(divide="ignore", invalid="ignore"):
            p = k / total
            # Hoeffding's bound on the chance of so many toxic documents among those that have the marker.
            evidence = total * (p * np.log(p / base) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - base)), 0))
        fresh = tried & (p > base) & (evidence >= np.log(max(tried.sum(), 1) / CHANCE))
        if not fresh.any():
            break
        marked |= fresh
        open_ = [c for c in open_ if not marked[c].any()]
    toxic_words = {w for w, c in known.items() if marked[c].any()}
    return [t[max(0, m.start() - 1) : m.end() + 1] for t in toxic for m in _WORD.finditer(t) if m.group() in toxic_words]


def toxic_history(spans: list[list[bytes]]) -> bytes:
    """The distinct spans of all groups, the commonest last; those beyond TOXIC_BYTES are dropped by their rank in the group."""
    ranked = sorted((rank, g, s) for g, group in enumerate(spans) for rank, (s, _) in enumerate(Counter(group).most_common()))
    out = list(dict.fromkeys(s for _, _, s in ranked))
    room = np.cumsum([len(s) for s in out]) <= TOXIC_BYTES
    return b"".join(s for s, fits in zip(reversed(out), reversed(room.tolist()), strict=True) if fits)


def differences(sizes: D.Sizes, texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the toxic dictionary saves in each window of all texts, and the windows' texts."""
    parts = [D.pieces(t.lower(), window) for t in texts]
    a, b = sizes([p for ps in parts for p in ps])
    return a - b, np.repeat(np.arange(len(texts)), [len(ps) for ps in parts])


def features(model: D.Model, sizes: D.Sizes, texts: list[bytes]) -> np.ndarray:
    d, row = differences(sizes, texts, model.window)
    n = np.bincount(row, minlength=len(texts))
    out = [np.log(n), np.bincount(row, d, len(texts)) / n]
    order = np.lexsort((-d, row))
    rank = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
    for k in range(TOP):
        best = np.zeros(len(texts))
        at = order[rank == k]
        best[row[at]] = d[at]
        out.append(best)
    for t in model.thresholds:
        over = np.bincount(row[d >= t], minlength=len(texts))
        out += [np.log1p(over), over / n]
    return np.stack(out, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = D.PER_CLASS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> D.Model:
    """Fitted on the labelled sample; without a column ``lang_col`` all texts count as one language."""
    return fit_rows(D.labelled_sample(docs, labels, label, per_class, id_col, text_col, lang_col if lang_col in docs.columns else None))


def fit_rows(rows: list[tuple], window: int = WINDOW) -> D.Model:
    """rows: (fold, text, label) and, where known, the language."""
    y = np.array([r[2] for r in rows], float)
    if len(rows) < 2 or y.min() == y.max():
        return D.Model(b"\n", b"\n", window, prior=float(y.mean()) if len(y) else 0.0)
    texts = [r[1].encode().lower() for r in rows]  # ASCII letters, as in scoring
    held, dictionary = D.split_folds(rows, y)
    of = lambda c: [t for t, k, v in zip(texts, dictionary, y, strict=True) if k and v == c]
    langs = [r[3] if len(r) > 3 else None for r in rows]
    of_lang = lambda c, g: [t for t, k, v, x in zip(texts, dictionary, y, langs, strict=True) if k and v == c and x == g]
    spans = [toxic_spans(of_lang(1, g), of_lang(0, g)) for g in dict.fromkeys(langs)]
    ordinary = D.train_dictionary(of(0), window, ORDINARY_BYTES)
    toxic = toxic_history(spans)
    model = D.Model(ordinary, toxic + ordinary, window, raw=True)
    sizes = D.Sizes(model)
    held_texts, held_y = [t for t, k in zip(texts, held, strict=True) if k], y[held]
    plain, _ = differences(sizes, [t for t, v in zip(held_texts, held_y, strict=True) if v == 0], window)
    model.thresholds = [max(1.0, float(np.quantile(plain, 1 - t))) for t in TAILS] if len(plain) else [1.0]
    w, centre, scale = D.logistic(features(model, sizes, held_texts), held_y)
    model.weights, model.centre, model.scale = w.tolist(), centre.tolist(), scale.tolist()
    return model


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    return D.score_frame(docs, fit(docs, labels, label, id_col=id_col, text_col=text_col), features, cut, id_col, text_col)
