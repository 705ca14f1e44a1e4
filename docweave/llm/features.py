"""Document statistics for the classifiers, vectorised over pieces of text."""

from __future__ import annotations

import numpy as np

from docweave.llm.textbuf import SPACED, Words, mix

#: Words of address, second person (fixed values).
SECOND_PERSON = "you your yours yourself ur du dich dir dein deine euch ihr tu te toi vous votre vos tú ti usted ustedes vosotros os su"
#: Insults and slurs of mild kind, four languages (fixed values).
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless trash garbage scum clown clowns disgusting filth filthy vermin fool fools "
    "imbecile jerk freak creep hate shut crap damn hell suck sucks ugly liar coward "
    "dummkopf trottel abschaum widerlich dumm blöd versager müll arschloch "
    "imbécile connard crétin nul ordure pauvre débile salaud minable "
    "estúpido imbécil basura asqueroso escoria payaso inútil patético"
)

#: Characters read as letters where a word is obfuscated (fixed values).
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_PLAIN = np.zeros(256, np.uint8)
for _c in range(0x61, 0x7B):
    _PLAIN[_c] = _PLAIN[_c - 32] = _c
for _c in range(0x80, 0x100):
    _PLAIN[_c] = _c
_LEET = _PLAIN.copy()
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
_CLASS = np.zeros(256, np.uint8)
for _c in range(0x41, 0x5B):
    _CLASS[_c] = 1
for _c in range(0x30, 0x3A):
    _CLASS[_c] = 2
for _c in range(0x21, 0x30):
    _CLASS[_c] = 3
for _c in [*range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]:
    _CLASS[_c] = 3
for _c in b"#*$%&|<>":
    _CLASS[_c] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("\n")] = 6
_CLASS[ord(" ")] = 7
for _c in range(0x61, 0x7B):
    _CLASS[_c] = 8
for _c in range(0xC0, 0x100):
    _CLASS[_c] = 9
for _c in range(0x80, 0xC0):
    _CLASS[_c] = 10


def word_hashes(words: str) -> np.ndarray:
    raw = np.frombuffer(words.encode(), np.uint8)
    return np.unique(Words(raw, np.array([0, len(raw)]), _PLAIN).hash)


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return table[at] == h


PREFIXES = (4, 5, 6, 7, 8)


def term_keys(words: Words) -> list[np.ndarray]:
    """For each word: its hash, and hashes of its first bytes (0 where the word is shorter)."""
    out = [words.hash]
    length = words.end - words.start
    mapped = words.mapped.astype(np.uint64)
    for k in PREFIXES:
        acc = np.zeros(len(words.hash), np.uint64)
        long = np.flatnonzero(length >= k)
        at = words.start[long]
        part = np.zeros(len(long), np.uint64)
        for j in range(k):
            part = part * np.uint64(257) + mapped[at + j] + np.uint64(1)
        acc[long] = mix(part + np.uint64(k << 56))
        out.append(acc)
    return out


def statistics(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[str], Words]:
    """Dense statistics of each row: (rows, columns), names, and the words."""
    rows = len(off) - 1
    size = np.diff(off)
    doc_of = np.repeat(np.arange(rows), size)
    kinds = np.bincount(doc_of * 11 + _CLASS[raw], minlength=rows * 11).reshape(rows, 11).astype(float)
    chars = np.maximum(size - kinds[:, 10], 1)
    plain = Words(raw, off, _PLAIN)
    spaced = Words(raw, off, SPACED, hashed=False)
    n, m = np.maximum(plain.count, 1), np.maximum(spaced.count, 1)
    length = (plain.end - plain.start).astype(float)
    by = lambda v, w: np.bincount(w.doc, v, rows)
    mean = by(length, plain) / n
    spread = np.sqrt(np.maximum(by(length**2, plain) / n - mean**2, 0))
    key = np.sort((plain.doc.astype(np.uint64) << np.uint64(54)) | (plain.hash >> np.uint64(10)))
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[fresh] >> np.uint64(54)).astype(np.int64), minlength=rows) if len(key) else np.zeros(rows)
    again = np.zeros(len(plain.hash), bool)
    again[1:] = (plain.hash[1:] == plain.hash[:-1]) & (plain.doc[1:] == plain.doc[:-1])
    # Five-word windows seen before in the row.
    h = plain.hash
    five = h.copy()
    for j in range(1, 5):
        five[: len(h) - j] = mix(five[: len(h) - j] + h[j:] * np.uint64(2 * j + 1)) if len(h) > j else five[: len(h) - j]
    ok = np.arange(len(h)) + 5 <= plain.first[1:][plain.doc] if len(h) else np.zeros(0, bool)
    wkey = np.sort((plain.doc[ok].astype(np.uint64) << np.uint64(54)) | (five[ok] >> np.uint64(10)))
    rep = np.concatenate(([False], wkey[1:] == wkey[:-1])) if len(wkey) else np.zeros(0, bool)
    repeats = np.bincount((wkey[rep] >> np.uint64(54)).astype(np.int64), minlength=rows) if len(wkey) else np.zeros(rows)
    # All capitals: words without a lower-case letter.
    first = raw[plain.start] if len(plain.start) else np.zeros(0, np.uint8)
    title = (first >= 0x41) & (first <= 0x5A)
    last = raw[plain.end - 1] if len(plain.end) else first
    capital = title & (last >= 0x41) & (last <= 0x5A) & (length > 1)
    lines = kinds[:, 6] + 1
    # Spaced words with a digit or symbol between letters.
    mixed = np.zeros(len(raw) + 1, np.int64)
    letter = (_CLASS[raw] == 1) | (_CLASS[raw] == 8)
    odd = np.isin(_CLASS[raw], (2, 3, 4, 5))
    if len(raw) > 2:
        mixed[2:-1] = np.cumsum((letter[:-2] & odd[1:-1] & letter[2:]).astype(np.int64))
        mixed[-1] = mixed[-2]
    inner = (mixed[np.maximum(spaced.end - 1, 0)] - mixed[np.minimum(spaced.start + 1, len(raw))] > 0) if len(spaced.start) else np.zeros(0, bool)
    cols = {
        "log_words": np.log1p(plain.count),
        "log_chars": np.log1p(size),
        "chars_per_word": chars / m,
        "mean_word": mean,
        "spread_word": spread,
        "capitals": kinds[:, 1] / chars,
        "digits": kinds[:, 2] / chars,
        "punctuation": kinds[:, 3] / chars,
        "symbols": kinds[:, 4] / chars,
        "exclamation": kinds[:, 5] / chars,
        "spaces": kinds[:, 7] / chars,
        "non_ascii": kinds[:, 9] / chars,
        "words_per_line": plain.count / lines,
        "distinct": distinct / n,
        "doubled": by(again, plain) / n,
        "repeats": repeats / n,
        "title_words": by(title, plain) / n,
        "capital_words": by(capital, plain) / n,
        "obfuscated": by(inner, spaced) / m,
        "bare_tokens": plain.count / m,
    }
    return np.column_stack(list(cols.values())), list(cols), plain
