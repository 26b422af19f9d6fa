"""Generated, minified, vendored and data files among source files (problem 5).

A linear support-vector machine over hashed features decides: character n-grams of the text and of its shape (letters,
digits and blanks reduced to classes), path components, whether the project excludes the path, and which part of the
file's line windows occurs in other projects too. The leading comment is masked, so a notice alone proves nothing
and files whose notice was removed look like those that kept it. Training labels come from strict rules on a bounded
sample (``SAMPLE_FILES``); validation is split by repository.

The part of shared windows is exact over all files: windows are grouped by their hash with the smallest and the
largest project (an algebraic state, so a window that is everywhere costs no more than any other), and joined back.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import written

#: Files that the classifier is fitted on, at most, and size of the hashed feature space.
SAMPLE_FILES = 5_000
BITS = 17
#: Lines of a window.
WINDOW = 4
EPOCHS = 12
PRIOR_WINDOWS = 3
#: Labels of the training files: shared windows from here are third-party code, below there hand-written.
COPY_FROM, OWN_BELOW = 0.60, 0.45
#: A line of the leading comment that says of the file itself that a tool wrote it: the claim opens the line.
_NOTICE = re.compile(
    r"(?i)^[^\w@<]*(?:this (?:file|class|code|module) (?:is|was|has been) |(?:source|code|file) )?(?:<?auto-?generated\b|automatically generated\b|@generated\b|generated (?:on|by|from|with|using)\b|generated file\b|produced by\b|machine[- ](?:written|generated)\b|do not (?:edit|modify)\b)"
    r"|\bdo not (?:edit|modify)[\W_]*$"
)
_DATA_LINE = re.compile(r"""^\s*(?:[\[\](){},;]|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[-+]?(?:0x[0-9a-fA-F]+|\d[\d_.eE+-]*)[lLfFdD]?|true|false|null|None|True|False|:|\s|\w+\s*:(?=\s*["'\d\[{-]))+$""")
_LEADING = re.compile(r"\s*(?:#!.*\n)?(?:\s*(?:/\*.*?\*/|//[^\n]*|#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''))*", re.S)


def lines_of(text: str) -> list[str]:
    return [x.strip() for x in re.split(r"\r\n|\n|\r", text) if x.strip()]


def masked(text: str) -> str:
    """The text without its leading comments."""
    return text[_LEADING.match(text).end() :].lstrip()


def windows(text: str | None) -> list[int]:
    """Distinct hashes of each ``WINDOW`` successive lines that hold more than brackets (shorter texts: of all)."""
    seq = [x for x in lines_of(masked(text or "")) if len(x) > 3]
    if not seq:
        return []
    return list({xxhash.xxh64_intdigest("\n".join(seq[i : i + WINDOW])) - (1 << 63) for i in range(max(1, len(seq) - WINDOW + 1))})


@lru_cache(maxsize=65_536)
def _shape(line: str) -> str:
    return re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", "a", re.sub(r"a?[\"'`].*?[\"'`]", "s", line)))


def signs(text: str) -> dict[str, float]:
    """Measures of a text for the training rules."""
    body = masked(text)
    lines = lines_of(body)
    n = len(lines)
    if not n:
        return {"lines": 0, "length": 0.0, "data": 0.0, "repeat": 0.0, "notice": 0.0}
    shapes = Counter(re.sub(r"(?:a0?_?)+", "a", _shape(x)) if len(x) < 400 else x[:40] for x in lines)
    top = sum(k for _, k in shapes.most_common(max(2, min(8, n // 8))))
    head = text[: len(text) - len(body)]
    return {"lines": n, "length": sum(map(len, lines)) / n, "data": sum(len(x) for x in lines if _DATA_LINE.match(x)) / sum(map(len, lines)), "repeat": top / n, "notice": float(any(_NOTICE.search(x) for x in lines_of(head)))}


def seed_label(text: str | None, share: float, excluded: bool) -> int | None:
    """1 for files that strict rules take for not hand-written, 0 for those they take for hand-written, else None."""
    if not text or not text.strip():
        return 0
    s = signs(text)
    if share >= COPY_FROM and s["lines"] >= 8 or s["length"] > 300 or s["data"] > 0.85 and s["lines"] >= 15:
        return 1
    if s["notice"] and s["repeat"] > 0.55:
        return 1
    if share < OWN_BELOW and not s["notice"] and s["length"] < 80 and s["data"] < 0.4 and not (s["repeat"] > 0.75 and s["lines"] >= 8):
        return 0
    return None


# --- features -------------------------------------------------------------------------------------------------

_CLASS = np.full(256, ord("?"), np.uint8)
for _a, _b in ((b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"a"), (b"0123456789", b"0"), (b" \t", b" "), (b"\r\n", b"\n")):
    _CLASS[np.frombuffer(_a, np.uint8)] = _b[0]
for _c in b"_$.,;:(){}[]<>=+-*/%&|^!~?@#\"'`\\":
    _CLASS[_c] = _c
_CLASS[128:] = ord("a")
#: Classes of which a run counts once in a shape.
_RUNS = np.zeros(256, bool)
_RUNS[np.frombuffer(b"a0 \n", np.uint8)] = True
#: Lower case, digits as 0.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 48


_PRIME = np.uint64(1099511628211)


def _grams(wide: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashes of the ``n`` successive numbers from each place on."""
    if len(wide) < n:
        return np.zeros(0, np.int64)
    size = len(wide) - n + 1
    h = wide[:size] ^ np.uint64(salt)
    h *= _PRIME
    for i in range(1, n):
        h ^= wide[i : size + i]
        h *= _PRIME
    h ^= h >> np.uint64(29)
    h &= np.uint64((1 << BITS) - 1)
    return h.astype(np.int64)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often they occur."""
    if not len(x):
        return x, x
    x = np.sort(x.astype(np.int32))
    at = np.flatnonzero(x[1:] != x[:-1]) + 1
    first = np.concatenate(([0], at))
    return x[first].astype(np.int64), np.diff(np.concatenate((first, [len(x)])))


def _named(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(x) & ((1 << BITS) - 1) for x in names], np.int64)


def features(path: str | None, text: str | None, excluded: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a file's hashed features, without that of shared windows."""
    body = masked(text or "")
    raw = np.frombuffer(body.encode("utf-8", "replace"), np.uint8)
    cls = _CLASS[raw]
    keep = np.ones(len(cls), bool)
    keep[1:] = (cls[1:] != cls[:-1]) | ~_RUNS[cls[1:]]
    run, lower = cls[keep].astype(np.uint64), _LOWER[raw].astype(np.uint64)
    parts = [(_grams(lower, 5, 11), 1.0), (np.concatenate([_grams(run, 5, 17), _grams(run, 9, 19)]), 1.0)]
    comps = (path or "").lower().split("/")
    file = comps[-1]
    names = [f"dir:{c}" for c in comps[:-1]] + [f"pair:{a}/{b}" for a, b in zip(comps, comps[1:-1])] + [f"ext:{e}" for e in file.split(".")[1:]] + ["end:" + re.sub(r"\d+", "0", file.rsplit(".", 1)[0])[-4:], f"deep:{min(len(comps), 8)}"]
    lines = lines_of(body)
    length = sum(map(len, lines)) / max(1, len(lines))
    names += [f"length:{int(math.log2(length + 1))}", f"lines:{int(math.log2(len(lines) + 1))}", f"excluded:{excluded}"]
    idx, val = [], []
    for grams, weight in parts:
        i, k = _counted(grams)
        v = 1.0 + np.log(k)
        norm = math.sqrt(float(v @ v)) or 1.0
        idx.append(i)
        val.append(v * weight / norm)
    i = _named(names)
    idx.append(i)
    val.append(np.full(len(i), 0.5 / math.sqrt(max(1, len(i)))))
    return np.concatenate(idx), np.concatenate(val)


def copied(share: float) -> float:
    """The value of the feature of shared windows: from 0 (few) to 1 (most); a file that nobody shares may still be generated."""
    return min(1.0, max(0.0, (share - 0.2) / 0.6))


class Machine:
    """A linear support-vector machine, fitted by dual coordinate descent on the hinge loss."""

    def __init__(self) -> None:
        self.w, self.copy, self.bias = np.zeros(1 << BITS), 0.0, 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], share: list[float], label: list[int], c: float = 5.0, epochs: int = EPOCHS, seed: int = 1) -> Machine:
        n, rnd = len(rows), np.random.default_rng(seed)
        y = np.where(np.asarray(label) > 0, 1.0, -1.0)
        cs = np.asarray([copied(s) for s in share])
        alpha = np.zeros(n)
        norm = np.array([float(v @ v) for _, v in rows]) + cs * cs + 1.0
        weight = np.where(y > 0, max(1.0, (y < 0).sum() / max(1, (y > 0).sum())), 1.0) * c
        for _ in range(epochs):
            for j in rnd.permutation(n):
                i, v = rows[j]
                g = y[j] * (v @ self.w[i] + self.copy * cs[j] + self.bias) - 1.0
                a = min(max(alpha[j] - g / norm[j], 0.0), weight[j])
                d = (a - alpha[j]) * y[j]
                if d:
                    alpha[j] = a
                    np.add.at(self.w, i, d * v)
                    self.copy += d * cs[j]
                    self.bias += d
        return self

    def score(self, row: tuple[np.ndarray, np.ndarray]) -> float:
        return float(row[1] @ self.w[row[0]]) + self.bias


# --- plans ----------------------------------------------------------------------------------------------------


def excluded_by(path: str | None, patterns: list[str] | None) -> bool:
    """Whether one of the project's exclude patterns (folder names or globs) covers the path."""
    if not path or patterns is None:
        return False
    comps = path.split("/")
    return any(p in comps[:-1] if re.fullmatch(r"[^*/?]+", p) else bool(_glob(p).fullmatch(path)) for p in patterns if p)


@lru_cache(maxsize=4_096)
def _glob(pattern: str) -> re.Pattern:
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.compile(out, re.S)


def shares(files: DataFrame) -> DataFrame:
    """``file_id, share``: the part of a file's line windows that occur in at least two projects (no row without any).

    Each file is taken to have ``PRIOR_WINDOWS`` unshared ones more, so that a window or two prove nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = pa.array([windows(t) for t in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), w], ["file_id", "project_id", "w"])

    cols = files.select("file_id", F.coalesce("project_id", F.lit("")).alias("project_id"), "text")
    rows = written(cols.mapInArrow(run, "file_id bigint, project_id string, w array<bigint>").select("file_id", "project_id", F.explode("w").alias("w")).distinct(), "windows")
    both = rows.groupBy("w").agg(F.min("project_id").alias("a"), F.max("project_id").alias("b")).where("a < b").select("w", F.lit(1).alias("two"))
    return written(rows.join(both, "w", "left").groupBy("file_id").agg((F.count("two") / (F.count(F.lit(1)) + PRIOR_WINDOWS)).alias("share")), "shares")


def _rows(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files with the exclude patterns of their project (projects are few; no hint, so Spark decides by size)."""
    p = projects.groupBy("project_id").agg(F.first("exclude_paths").alias("exclude_paths"))
    return files.select(F.col("file_id").cast("bigint").alias("file_id"), "project_id", F.col("source_file").alias("path"), F.col("text").alias("text")).join(p, "project_id", "left")


def train(rows: DataFrame, share: DataFrame, sample_files: int = SAMPLE_FILES, hold_out: int | None = None) -> tuple[Machine, dict[str, float]]:
    """Fit on at most ``sample_files`` files (by a hash of their id), leaving out one fifth of the projects for validation.

    Returns the machine, fitted on all of the sample, and the figures of one fitted without the held-out projects. Its labels
    come from the rules, one of which reads the part of shared windows; the figures ``_unshared`` are therefore of the
    machine without that feature, which judges held-out files by their characters and paths alone.
    """
    n = share.count()
    part = min(1.0, sample_files / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64("file_id", F.lit(23)), F.lit(1 << 30)) < int(part * (1 << 30)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            label = [seed_label(t, s, False) for t, s in zip(b["text"], b["share"])]
            keep = [i for i, x in enumerate(label) if x is not None]
            f = [features(b["path"].iloc[i], b["text"].iloc[i], excluded_by(b["path"].iloc[i], b["exclude_paths"].iloc[i] if b["exclude_paths"].iloc[i] is not None else None)) for i in keep]
            yield pd.DataFrame({"file_id": b["file_id"].iloc[keep].to_numpy(), "project_id": b["project_id"].iloc[keep].to_numpy(), "i": [x.astype(np.int32).tobytes() for x, _ in f], "v": [v.astype(np.float32).tobytes() for _, v in f], "share": b["share"].iloc[keep].to_numpy(), "label": [label[i] for i in keep]})

    got = picked.join(share, "file_id", "left").fillna(0.0, ["share"]).mapInPandas(run, "file_id bigint, project_id string, i binary, v binary, share double, label int").toPandas()
    got = got.drop_duplicates("file_id").sort_values("file_id").head(sample_files)
    if not len(got) or got["label"].nunique() < 2:
        return Machine(), {"files": float(len(got)), "accuracy": 1.0, "precision": 1.0, "recall": 1.0}
    data = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(got["i"], got["v"])]
    label, s = got["label"].tolist(), got["share"].tolist()
    held = np.array([xxhash.xxh32_intdigest(str(p)) % 5 == 0 for p in got["project_id"]])
    fit = [i for i in range(len(data)) if not held[i]]
    figures = {"files": float(len(got)), "held_out": float(held.sum())}
    if fit and held.any():
        m = Machine().fit([data[i] for i in fit], [s[i] for i in fit], [label[i] for i in fit])
        pred = np.array([m.score(data[i]) + m.copy * copied(s[i]) > 0 for i in np.flatnonzero(held)])
        true = np.array([label[i] > 0 for i in np.flatnonzero(held)])
        blind = np.array([m.score(data[i]) > 0 for i in np.flatnonzero(held)])  # as if no window were shared
        figures |= {"accuracy": float((pred == true).mean()), "precision": float(true[pred].mean()) if pred.any() else 1.0, "recall": float(pred[true].mean()) if true.any() else 1.0}
        figures |= {"recall_unshared": float(blind[true].mean()) if true.any() else 1.0, "precision_unshared": float(true[blind].mean()) if blind.any() else 1.0}
    return Machine().fit(data, s, label), figures


def classify(files: DataFrame, projects: DataFrame, sample_files: int = SAMPLE_FILES) -> tuple[DataFrame, dict[str, float]]:
    """``file_id, score, share, handwritten`` of every file, and the validation figures.

    ``files`` has ``file_id, project_id, source_file, text``; ``projects`` has ``project_id, exclude_paths``. Null, empty and
    blank texts are hand-written. A null path has no components, a null project is a project of its own. Repeated files
    count once. Without files there are no rows; where the rules find only one class, that's everyone's.
    """
    share = shares(files)
    rows = _rows(files, projects)
    machine, figures = train(rows, share, sample_files)
    model = files.sparkSession.sparkContext.broadcast(machine)  # 2^BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            ids, paths, texts, pats = (b.column(i) for i in range(4))
            empty = [not (t and t.strip()) for t in texts.to_pylist()]
            score = [0.0 if e else m.score(features(p, t, excluded_by(p, x))) for e, p, t, x in zip(empty, paths.to_pylist(), texts.to_pylist(), pats.to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(score, pa.float64()), pa.array(empty, pa.bool_())], ["file_id", "part", "empty"])

    parts = rows.select("file_id", "path", "text", "exclude_paths").mapInArrow(run, "file_id bigint, part double, empty boolean").groupBy("file_id").agg(F.min("part").alias("part"), F.min("empty").alias("empty"))
    s = F.coalesce("share", F.lit(0.0))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s - 0.2) / 0.6))
    scored = parts.join(share, "file_id", "left").select("file_id", "empty", s.alias("share"), (F.col("part") + F.lit(machine.copy) * value).alias("score"))
    return scored.select("file_id", F.when(F.col("empty"), F.lit(-1.0)).otherwise(F.col("score")).alias("score"), "share", (F.col("empty") | (F.col("score") <= 0)).alias("handwritten")), figures
