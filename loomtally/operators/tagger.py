"""The character tagger as a pluggable scorer: numpy recurrent nets, ONNX where given, Viterbi.

A tagger proposes spans and never decides a verdict. Artifacts load once per worker; windows are
scored in batches of similar length, padding masked so that a batch gives what single windows give.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.functions import rules as R
from loomtally.operators.extract import EXTRACTION, spans_of_tags

PAD, UNKNOWN = 0, 1
FORBIDDEN = -1e4


def transition_mask() -> np.ndarray:
    """0 where one tag may follow another under BIOES, a large negative number where not."""
    n = len(R.TAGS)
    mask = np.zeros((n, n))
    for i, a in enumerate(R.TAGS):
        for j, b in enumerate(R.TAGS):
            pa, _, ea = a.partition("-")
            pb, _, eb = b.partition("-")
            inside = pa in ("B", "I")
            ok = (pb in ("I", "E") and ea == eb) if inside else pb not in ("I", "E")
            mask[i, j] = 0.0 if ok else FORBIDDEN
    return mask


def viterbi(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
    """Best path; the lowest tag wins ties."""
    if not len(emissions):
        return []
    score, back = start + emissions[0], []
    for row in emissions[1:]:
        step = score[:, None] + transitions
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + row
    path = [int((score + end).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def viterbi_batch(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Best paths [texts, steps] of padded texts side by side, each as ``viterbi`` gives it; what lies beyond
    a text's length repeats its last tag."""
    n = emissions.shape[2]
    score, back = start + emissions[:, 0], []
    for t in range(1, emissions.shape[1]):
        step = score[:, :, None] + transitions
        going = (t < lengths)[:, None]
        back.append(np.where(going, step.argmax(axis=1), np.arange(n)))
        score = np.where(going, step.max(axis=1) + emissions[:, t], score)
    rows = np.arange(len(emissions))
    path = [(score + end).argmax(axis=1)]
    for b in reversed(back):
        path.append(b[rows, path[-1]])
    return np.stack(path[::-1], axis=1)


def _array(x: dict) -> np.ndarray:
    return np.frombuffer(base64.b64decode(x["data"]), "<f4").astype(np.float64).reshape(x["shape"])


def packed(a: np.ndarray) -> dict:
    """An array as the artifact stores it."""
    return {"data": base64.b64encode(np.ascontiguousarray(a, "<f4").tobytes()).decode(), "shape": list(a.shape)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _gru(x, h, c, w):
    a = x @ w["W_ih"].T + w["b_ih"]
    b = h @ w["W_hh"].T + w["b_hh"]
    k = h.shape[1]
    gates = _sigmoid(a[:, : 2 * k] + b[:, : 2 * k])
    reset, keep = gates[:, :k], gates[:, k:]
    return keep * h + (1 - keep) * np.tanh(a[:, 2 * k :] + reset * b[:, 2 * k :]), c


def _lstm(x, h, c, w):
    a = x @ w["W_ih"].T + w["b_ih"] + h @ w["W_hh"].T + w["b_hh"]
    k = h.shape[1]
    c = _sigmoid(a[:, k : 2 * k]) * c + _sigmoid(a[:, :k]) * np.tanh(a[:, 2 * k : 3 * k])
    return _sigmoid(a[:, 3 * k :]) * np.tanh(c), c


class Recurrent:
    """A bidirectional GRU or LSTM over characters, from a weights artifact."""

    def __init__(self, artifact: dict):
        self.cell = {"gru": _gru, "lstm": _lstm}[artifact["unit"]]
        self.hidden = artifact["hidden"]
        self.embedding = _array(artifact["embedding"])
        self.layers: dict = {}
        for e in artifact["rnn"]:
            self.layers.setdefault(e["layer"], {})[e["direction"]] = {k: _array(e[k]) for k in ("W_ih", "W_hh", "b_ih", "b_hh")}
        self.out = _array(artifact["out"]["W"]), _array(artifact["out"]["b"])
        self.crf = artifact.get("crf")
        self.pad = artifact.get("pad_id", PAD)

    def _pass(self, x: np.ndarray, mask: np.ndarray, w: dict, backward: bool) -> np.ndarray:
        h = c = np.zeros((len(x), self.hidden))
        out = np.empty((*x.shape[:2], self.hidden))
        steps = range(x.shape[1])
        for t in reversed(steps) if backward else steps:
            h, c = self.cell(x[:, t], h, c, w)
            if backward:  # padding comes first here and must leave no trace
                h, c = h * mask[:, t, None], c * mask[:, t, None]
            out[:, t] = h
        return out

    def logits(self, ids: np.ndarray) -> np.ndarray:
        x, mask = self.embedding[ids], (ids != self.pad).astype(float)
        for k in sorted(self.layers):
            x = np.concatenate([self._pass(x, mask, self.layers[k][d], d == "backward") for d in ("forward", "backward")], axis=2)
        return x @ self.out[0].T + self.out[1]


class Convolutional:
    """Stacked dilated convolutions over characters, same length out as in, from a weights artifact
    (each layer's W is [out, in, width], its dilation beside it)."""

    def __init__(self, artifact: dict):
        self.embedding = _array(artifact["embedding"])
        self.layers = [(_array(e["W"]), _array(e["b"]), int(e["dilation"])) for e in artifact["convs"]]
        self.out = _array(artifact["out"]["W"]), _array(artifact["out"]["b"])

    def logits(self, ids: np.ndarray) -> np.ndarray:
        x = self.embedding[ids]
        for w, b, dilation in self.layers:
            width, n = w.shape[2], x.shape[1]
            side = dilation * (width // 2)
            padded = np.pad(x, ((0, 0), (side, side), (0, 0)))
            x = np.maximum(0, b + sum(padded[:, k * dilation : k * dilation + n] @ w[:, :, k].T for k in range(width)))
        return x @ self.out[0].T + self.out[1]


class Tagger:
    """Windows to tags: a scorer, a character map and a decoder (argmax, or Viterbi with transitions)."""

    def __init__(self, scorer, chars: dict[str, int], crf: dict | None = None):
        self.scorer, self.chars = scorer, chars
        self.crf = {k: np.asarray(v, dtype=float) for k, v in crf.items()} if crf else None

    def encode(self, text: str) -> list[int]:
        return [self.chars.get(c, UNKNOWN) for c in text]

    def tags(self, texts: list[str], size: int = 64) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in texts]
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
        for a in range(0, len(order), size):
            part = order[a : a + size]
            ids = np.full((len(part), max(len(texts[i]) for i in part)), PAD, dtype=np.int64)
            for r, i in enumerate(part):
                ids[r, : len(texts[i])] = self.encode(texts[i])
            scores = self.scorer.logits(ids)
            if self.crf:
                lengths = np.array([len(texts[i]) for i in part])
                best = viterbi_batch(np.asarray(scores, dtype=float), lengths, self.crf["transitions"], self.crf["start"], self.crf["end"])
            else:
                best = scores.argmax(axis=2)
            for r, i in enumerate(part):
                out[i] = [R.TAGS[k] for k in best[r, : len(texts[i])].tolist()]
        return out


class Onnx:
    """An ONNX session with one thread; (batch, time) ids to logits."""

    def __init__(self, path: str):
        import onnxruntime

        o = onnxruntime.SessionOptions()
        o.intra_op_num_threads = o.inter_op_num_threads = 1
        self.session = onnxruntime.InferenceSession(path, o, providers=["CPUExecutionProvider"])
        self.name = self.session.get_inputs()[0].name

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return self.session.run(None, {self.name: ids})[0]


@lru_cache(maxsize=4)
def load(folder: str) -> Tagger:
    """The tagger of a model folder: charmap.json with weights.json, or with tagger.onnx and decoder.json."""
    at = Path(folder)
    chars = json.loads((at / "charmap.json").read_text(encoding="utf-8"))["chars"]
    if (at / "weights.json").exists():
        artifact = json.loads((at / "weights.json").read_text(encoding="utf-8"))
        scorer = Convolutional if artifact.get("unit") == "cnn" else Recurrent
        return Tagger(scorer(artifact), chars, artifact.get("crf"))
    if not (at / "tagger.onnx").exists():
        raise FileNotFoundError(f"{folder} holds neither weights.json nor tagger.onnx")
    d = json.loads((at / "decoder.json").read_text(encoding="utf-8"))
    return Tagger(Onnx(str(at / "tagger.onnx")), chars, {k: d[k] for k in ("transitions", "start", "end")} if d.get("has_crf") else None)


def results_of(text: str, tags: list[str]) -> list[dict]:
    """Results of a tagged window, one per group of spans that has a statistic."""
    groups: list[dict] = []
    for a, b, entity in spans_of_tags(tags):
        if not groups or entity == "TEST" or entity == "STAT" and "STAT" in groups[-1]:
            groups.append({})
        groups[-1].setdefault(entity, (a, b))
    signs = {v: k for k, v in R.OPERATOR_ENTITY.items()}
    out = []
    for g in groups:
        if "STAT" not in g:
            continue
        cut = {k: text[a:b] for k, (a, b) in g.items()}
        start, end = min(a for a, _ in g.values()), max(b for _, b in g.values())
        out.append({
            "test_type": cut.get("TEST", "").strip().lower() or None, "statistic": cut["STAT"], "df1": cut.get("DF1"), "df2": cut.get("DF2"), "n": cut.get("N"),
            "p_operator": next((signs[k] for k in g if k in signs), None), "p_value": cut.get("PVAL"), "start": start, "end": end, "raw": text[start:end],
        })
    return out


def finder(folder: str):
    """A plug-in for the online path: array of window texts -> array of arrays of extractions."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(EXTRACTION)))
    def run(texts: pd.Series) -> pd.Series:
        tagger = load(folder)
        flat = [t or "" for ts in texts if ts is not None for t in ts]
        tags = iter(tagger.tags(flat))
        return pd.Series([None if ts is None else [results_of(t or "", next(tags)) for t in ts] for ts in texts])

    return lambda column: run(column)


def tag_udf(folder: str):
    """Tags of every character of a text."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(load(folder).tags([t or "" for t in texts]))

    return run


def tags_by(tagger: Tagger):
    """Tags of every character of a text by a tagger at hand, which goes to the workers with the plan."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(tagger.tags([t or "" for t in texts]))

    return run


def agreement(a: Column, b: Column) -> Column:
    """Share of equal tags of two tag arrays."""
    same = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"]))
    return same / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0))
