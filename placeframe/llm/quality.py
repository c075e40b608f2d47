"""Quality by compression: the normalised difference of a text's size under a good and a bad dictionary.

Zstandard dictionaries are trained on texts labelled good and bad. A text's windows are compressed with both; the summed
difference of the sizes over the text's length is the one thing that is scored. It becomes a probability by an isotonic
fit, on folds that neither dictionary has seen, with straight lines between its steps.

A null or empty text has difference 0 and gets the score that goes with it; long texts are compressed whole, window by
window; repeated rows get equal scores; without labels of both classes every score is the share of the class that is there
(0 without any). Where the labelled rows of a class all lie in the same folds, dictionaries and calibration share rows, and
scores are too sure. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from placeframe.llm import dictionaries as D

WINDOW = 256


def features(model: D.Model, sizes: D.Sizes, texts: list[bytes]) -> np.ndarray:
    """One column: bytes that the good dictionary saves against the bad one, per byte of text."""
    parts = [D.pieces(t, model.window) for t in texts]
    bad, good = sizes([p for ps in parts for p in ps])
    row = np.repeat(np.arange(len(texts)), [len(ps) for ps in parts])
    return (np.bincount(row, bad - good, len(texts)) / np.array([max(1, len(t)) for t in texts]))[:, None]


def fit_rows(rows: list[tuple[int, str, int]], window: int = WINDOW) -> D.Model:
    """rows: (fold, text, label); folds 1 and 2 train the dictionaries, 3 and 4 calibrate."""
    y = np.array([r[2] for r in rows], float)
    if len(rows) < 2 or y.min() == y.max():
        return D.Model(b"\n", b"\n", window, prior=float(y.mean()) if len(y) else 0.0)
    texts = [r[1].encode() for r in rows]
    held, dictionary = D.split_folds(rows, y)
    of = lambda c: [t for t, k, v in zip(texts, dictionary, y, strict=True) if k and v == c]
    model = D.Model(D.train_dictionary(of(0), window), D.train_dictionary(of(1), window), window)
    model.knots = D.isotonic(features(model, D.Sizes(model), [t for t, k in zip(texts, held, strict=True) if k])[:, 0], y[held])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = D.PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> D.Model:
    return fit_rows(D.labelled_sample(docs, labels, label, per_class, id_col, text_col))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    return D.score_frame(docs, fit(docs, labels, label, id_col=id_col, text_col=text_col), features, cut, id_col, text_col)
