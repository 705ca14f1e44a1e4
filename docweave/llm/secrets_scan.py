"""Secret scan: fixed patterns, and character Markov models for the rest.

Base spans come from three patterns (assignments, access keys, long hex runs).
The method adds runs of SHORTEST or more token characters that a first-order
Markov model of random strings explains better than one of ordinary
identifiers. What is compared is the log-likelihood ratio of the whole run, so
a short run has to be more plainly random than a long one.

Both models are trained on labelled samples. Secrets: generated random strings
over usual alphabets, and the values that the base patterns find in a sample of
the corpus. Identifiers: that sample's other tokens that stand in two documents
or more (a secret hardly does, so those that the patterns miss don't count as
identifiers), joins of them as programmers write names, numbers, and product and
ticket ids. The cut lies above the ratios of the identifiers that are held out from training.

Defined cases: a null or empty text has no spans; overlapping spans of
different base kinds all stay; a method span that touches a base span is left
out; rows are scanned each on their own whatever their id; without documents
the models know generated strings only; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.shared import small_batches
from docweave.llm.textbuf import pieces

#: The contract's patterns (fixed values), and each one's least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that names in programs, paths and headers are made of (fixed values).
NAME_WORDS = (
    "get set add remove update create delete find load save read write open close start stop init run build test check parse format convert handle process send receive request response "
    "user account name email address phone password session login token key value item list map array string number integer double boolean object class method function field column table row "
    "index count size length width height offset limit page file path directory folder image video audio text html json xml http https url server client host port network socket connection "
    "database query result error exception message event listener handler manager service controller factory provider configuration settings option default application module package library "
    "version system local remote global public private static final abstract interface identifier reference internal external source target input output buffer stream thread worker queue cache "
    "memory storage data model view template style color background foreground border margin content header footer sidebar navigation button label title description content type encoded form "
    "www com org net usr bin lib python java script node modules dist main index utils helper common shared core base custom current previous next first last total average maximum minimum"
).split()
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
TOKEN_CHARS = string.ascii_letters + string.digits + "+/_-"
#: A run of fewer characters is not judged: product, media and ticket ids are as
#: random as a secret of their length.
SHORTEST = 14
TOKEN = re.compile(f"[{re.escape(TOKEN_CHARS)}]{{{SHORTEST},}}")
#: How far the cut lies above the ratios of the held-out identifiers, in nats:
#: the prior odds, of one run in ten thousand being a secret.
MARGIN = 9.2
#: Bounds of the labelled sample: different documents read, and strings of either label.
SAMPLE_DOCS, SAMPLE_STRINGS = 4000, 20_000

_STATE = np.zeros(256, np.int64)
for _i, _c in enumerate(TOKEN_CHARS):
    _STATE[ord(_c)] = _i + 1
_N = len(TOKEN_CHARS) + 1
_IS_TOKEN = _STATE > 0
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and non-overlapping within each kind."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(*m.span(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return found


class CharModel:
    """Log-likelihood ratio of two first-order Markov models over a whole run."""

    def __init__(self, secrets: list[str], identifiers: list[str]):
        ordinary = identifiers + joined_names(identifiers) + joined_names(NAME_WORDS, 8000) + numbers() + rules() + codes()
        held = [w for w in ordinary if _held_out(w)]
        self.table = self._logs([w for w in secrets if not _held_out(w)]) - self._logs([w for w in ordinary if not _held_out(w)])
        # Of the held-out identifiers one in a thousand may be mislabelled.
        scores = sorted(self.ratio(w) for w in held if len(w) >= SHORTEST)
        top = scores[int(0.999 * (len(scores) - 1))] if scores else 0.0
        self.cut = max(top, 0.0) + MARGIN

    @staticmethod
    def _logs(words: list[str]) -> np.ndarray:
        counts = np.full((_N, _N), 0.05)
        for w in words:
            s = _STATE[np.frombuffer(w.encode("latin-1", "replace"), np.uint8)]
            np.add.at(counts, (np.concatenate(([0], s[:-1])), s), 1)
        return np.log(counts / counts.sum(axis=1, keepdims=True))

    def ratio(self, word: str) -> float:
        s = _STATE[np.frombuffer(word.encode("latin-1", "replace"), np.uint8)]
        return float(self.table[np.concatenate(([0], s[:-1])), s].sum()) if len(s) else 0.0

    def ratios(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The ratio of each run of bytes."""
        s = _STATE[raw]
        steps = np.concatenate(([0.0], np.cumsum(np.concatenate(([0.0], self.table[s[:-1], s[1:]])))))
        return self.table[0, s[start]] + steps[end] - steps[start + 1]

    def is_secret(self, word: str) -> bool:
        return len(word) >= SHORTEST and self.ratio(word) > self.cut


def _held_out(word: str) -> bool:
    return zlib.crc32(word.encode("utf-8", "replace")) % 4 == 0


def random_strings(n: int = 3000, seed: int = 7) -> list[str]:
    """Generated samples of random strings over usual alphabets."""
    rng = random.Random(seed)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"]
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(16, 44))) for i in range(n)]


def numbers(n: int = 3000, seed: int = 11) -> list[str]:
    """Generated numbers as texts have them: plain, grouped, dates, and with a sign or a unit."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices(string.digits, k=k))
    shapes = [lambda: digits(rng.randint(8, 24)), lambda: "-".join(digits(4) for _ in range(4)), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"+{digits(2)}-{digits(3)}-{digits(7)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}"]
    return [shapes[i % len(shapes)]() for i in range(n)]


def rules(n: int = 1500, seed: int = 17) -> list[str]:
    """Generated rules and fillers: one character again and again, and pieces of
    the alphabet and of keyboard rows."""
    rng = random.Random(seed)
    rows = [string.ascii_lowercase, string.ascii_uppercase, string.digits, *KEYBOARD]
    out = [rng.choice(TOKEN_CHARS) * rng.randint(8, 40) for _ in range(n)]
    for i in range(n):
        row = rows[i % len(rows)] * 2
        at = rng.randrange(len(row) // 2)
        out.append(row[at : at + rng.randint(6, 20)])
    return out


def codes(n: int = 4000, seed: int = 19) -> list[str]:
    """Generated product, part and ticket ids: short groups of letters or digits,
    joined by marks, and groups with a prefix that is a word."""
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choices(string.ascii_uppercase, k=k))
    digits = lambda k: "".join(rng.choices(string.digits, k=k))
    out = []
    for i in range(n):
        groups = [rng.choice((letters, digits))(rng.randint(2, 5)) for _ in range(rng.randint(2, 5))]
        groups = [letters(rng.randint(2, 4)), *groups] if i % 2 else [rng.choice(NAME_WORDS), *groups]
        code = rng.choice("--_/").join(groups)
        out.append(code.lower() if i % 5 == 0 else code)
    return out


def joined_names(words: list[str], n: int = 4000, seed: int = 13) -> list[str]:
    """Names of two or three words, joined as in programs and paths."""
    plain = sorted({w for w in words if w.isalpha() and len(w) <= 12})
    if not plain:
        return []
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = rng.choices(plain, k=rng.randint(2, 3))
        styles = ["_".join(parts), "-".join(parts), "/".join(parts), parts[0] + "".join(p.capitalize() for p in parts[1:]), "_".join(parts).upper(), f"{parts[0]}_{rng.randint(1, 9999)}"]
        out.append(styles[i % len(styles)])
    return out


def _overlaps(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) meets one of the sorted, disjoint spans."""
    at = bisect.bisect_left(spans, (b,))
    return at > 0 and spans[at - 1][1] > a


def _united(spans: list) -> list[tuple[int, int]]:
    """The spans (start, end, ...) as sorted, disjoint ones."""
    out: list[tuple[int, int]] = []
    for a, b, *_ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, label): the different ones of each document."""
    word = re.compile(f"[{re.escape(TOKEN_CHARS)}]{{3,}}")
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            spans = base_spans(text)
            rows += [(w, 1) for w in {(ASSIGN.fullmatch(text[a:b])[2] if kind == "assign" else text[a:b])[:200] for a, b, kind in spans}]
            covered = _united(spans)
            rows += [(w, 0) for w in {m[0][:200] for m in word.finditer(text) if not _overlaps(covered, *m.span())}]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.int64())], names=["word", "label"])


def train(docs: DataFrame, text_col: str = "text") -> CharModel:
    """The models, from at most SAMPLE_DOCS different documents, give or take
    chance, and SAMPLE_STRINGS of either label."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    total = texts.count()
    if total > SAMPLE_DOCS:
        texts = texts.where(F.pmod("key", F.lit(1 << 30)) < int((1 << 30) * SAMPLE_DOCS / total))
    # Copies are one document; the least keys, so that a rerun reads the same ones.
    texts = texts.groupBy("key").agg(F.min("text").alias("text")).orderBy("key").limit(2 * SAMPLE_DOCS)
    words = texts.select("text").mapInArrow(_samples, "word string, label long").groupBy("word", "label").agg(F.count("*").alias("n"))
    words = words.where("label = 1 or n > 1")
    drawn = [words.where(F.col("label") == k).orderBy(F.xxhash64("word"), "word").limit(SAMPLE_STRINGS).collect() for k in (1, 0)]
    return CharModel(random_strings() + [r.word for r in drawn[0]], [r.word for r in drawn[1]])


def _long_runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of runs of at least ``least`` within one row."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    use = end - start >= least
    start, end = start[use], end[use]
    # Rows touch one another; a run across a row's end is cut there.
    row_a, row_b = np.searchsorted(off, start, "right"), np.searchsorted(off, end, "left")
    across = np.flatnonzero(row_b > row_a)
    if len(across):
        pieces_ = [(s, e) for i in across for s, e in _cut(int(start[i]), int(end[i]), off) if e - s >= least]
        whole = np.ones(len(start), bool)
        whole[across] = False
        start = np.concatenate([start[whole], [s for s, _ in pieces_]]).astype(np.int64)
        end = np.concatenate([end[whole], [e for _, e in pieces_]]).astype(np.int64)
    return start, end


def _cut(a: int, b: int, off: np.ndarray) -> list[tuple[int, int]]:
    inner = off[(off > a) & (off < b)]
    edges = [a, *np.unique(inner).tolist(), b]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _scan(model: CharModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for lo, hi, raw, off in pieces(batch.column(0)):
                rows = hi - lo
                data = raw.tobytes()
                low = data.lower()
                look = np.zeros(rows, bool)
                for needle, where in [*((w, low) for w in _WORDS), (b"AKIA", data)]:
                    at = where.find(needle)
                    while at >= 0:
                        row = int(np.searchsorted(off, at, "right")) - 1
                        look[row] = True
                        at = where.find(needle, max(int(off[row + 1]), at + 1))
                start, _ = _long_runs(_IS_HEX[raw], off, LEAST["hex"])
                look[np.searchsorted(off, start, "right") - 1] = True
                start, end = _long_runs(_IS_TOKEN[raw], off, SHORTEST)
                if len(start):
                    use = model.ratios(raw, start, end) > model.cut
                    start, end = start[use], end[use]
                more: dict[int, list[tuple[int, int]]] = {}
                if len(start):
                    # Code points before a byte: bytes that don't continue one.
                    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                    home = np.searchsorted(off, start, "right") - 1
                    base = points[off[home]]
                    for row, a, b in zip(home.tolist(), (points[start] - base).tolist(), (points[end] - base).tolist(), strict=True):
                        look[row] = True
                        more.setdefault(row, []).append((a, b))
                counts = np.zeros((rows, 4), np.int64)
                sha, spans = [empty] * rows, [""] * rows
                for row in np.flatnonzero(look).tolist():
                    base_found = base_spans(data[off[row] : off[row + 1]].decode("utf-8", "replace"))
                    covered = _united(base_found)
                    added = [(a, b, "markov") for a, b in more.get(row, ()) if not _overlaps(covered, a, b)]
                    key = lambda s: (s[0], KINDS.index(s[2]))
                    said = lambda x: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(x, key=key))
                    for _, _, k in base_found + added:
                        counts[row, KINDS.index(k)] += 1
                    sha[row] = hashlib.sha256(said(base_found).encode()).hexdigest()
                    spans[row] = said(base_found + added)
                others = [batch.column(i).slice(lo, rows) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [*others, *(pa.array(counts[:, k].copy()) for k in range(3)), pa.array(sha), pa.array(spans), pa.array(counts[:, 3].copy())],
                    names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
                )

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: CharModel | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) for each row."""
    small_batches(docs.sparkSession)
    model = model or train(docs, text_col)
    frame = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    longs = [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")]
    texts = [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    schema = T.StructType([frame.schema["id"], *longs, *texts, T.StructField("n_markov", T.LongType())])
    return frame.mapInArrow(_scan(model), schema).withColumnRenamed("id", id_col)


def redact(text: str, spans: str, mark: str = "[secret]") -> str:
    """The text with its spans replaced."""
    cuts = sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s)
    out, at = [], 0
    for a, b in cuts:
        if b > at:
            out += [text[at : max(a, at)], mark]
            at = b
    return "".join(out) + text[at:]
