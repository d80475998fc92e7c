"""Secret scans: fixed patterns, and windows of high entropy.

Besides the patterns, candidate strings (runs of CANDIDATE characters) are
searched with a sliding window of WINDOW characters.  Characters fall into four
classes (lower case, upper case, digits, other); the counts of each character
and each class move with the window, and so does the sum of c log c, from which
the Shannon entropy of the window and of each class follows without recounting.
Windows that carry enough entropy as a whole and within every class that they
use join to spans: n characters of a class must reach CLASS_SHARE of log2 n bits.  Keys over a small alphabet
(hex, base32) and keys of letters alone cannot reach that bar and have rules of
their own (alphabet_windows).  Shapes of public identifiers are cut out of a run
before it is searched; an allow-list suppresses the spans found that are known
to be harmless.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .staging import table

KINDS = ("assign", "access", "hex", "entropy")
# fixed values: the base patterns, with the length a match must have
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_MIN = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_MIN = 20
HEX = re.compile(r"[0-9a-f]+")
HEX_MIN = 24
# the same three as one filter that needs no backtracking
_ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: What may follow a key in base64; elsewhere "=" parts a name from its value.
PADDING = re.compile(r"={1,2}(?![A-Za-z0-9+/_=-])")
WINDOW = 20
#: Bits that the characters of a window must carry, and the share of the most that those of each class can carry.
MIN_BITS, CLASS_SHARE = 3.4, 0.6
#: Bits for each alphabet: hex digits of one case, base32, and letters alone.
HEX_BITS, BASE32_BITS, LETTER_KEY_BITS = 2.9, 3.2, 3.4
MIN_LETTERS, MIN_DIGITS = 4, 2
_SAMPLE = r"(?i:example|sample|placeholder|changeme|xxxx)"
#: Public identifiers and names of sample folders, which part what stands before and after them.
PUBLIC = re.compile(rf"(?<![0-9A-Za-z])[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}(?![0-9A-Za-z])|(?<![0-9A-Za-z])sha(?:1-[A-Za-z0-9+/]{{27}}|256-[A-Za-z0-9+/]{{43}}|384-[A-Za-z0-9+/]{{64}}|512-[A-Za-z0-9+/]{{86}})(?![A-Za-z0-9+/_-])|(?<![^/])[A-Za-z_-]*{_SAMPLE}[A-Za-z_-]*[0-9]{{0,3}}(?![^/])")
#: Spans that match are no secrets: sample values, numbers, and words with numbers.
ALLOW = tuple(re.compile(p) for p in (rf".*{_SAMPLE}.*", r"[0-9_/=+-]+", r"(?:(?:[A-Za-z]+[0-9]{0,3}|[0-9]{1,4})[_/=-]+)+[A-Za-z]*[0-9]{0,4}"))

_LOG = np.concatenate([[0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))])
_CLASS_BITS = [CLASS_SHARE * math.log2(max(1, n)) - 1e-9 for n in range(WINDOW + 1)]
_CLASS = {c: k for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-")) for c in chars}


def entropy_windows(text: str) -> list[tuple[int, int]]:
    """Maximal spans of windows with high entropy, by counts that move with the window."""
    counts: dict[str, int] = {}
    total, sums = [0, 0, 0, 0], [0.0, 0.0, 0.0, 0.0]  # by class: characters, and sum of c log2 c
    whole = 0.0
    spans: list[tuple[int, int]] = []

    def bits(n: int, s: float) -> float:
        return math.log2(n) - s / n if n else 0.0

    for i, ch in enumerate(text):
        if i >= WINDOW:
            old = text[i - WINDOW]
            c, k = counts[old], _CLASS[old]
            counts[old] = c - 1
            total[k] -= 1
            sums[k] += _LOG[c - 1] - _LOG[c]
            whole += _LOG[c - 1] - _LOG[c]
        c, k = counts.get(ch, 0), _CLASS[ch]
        counts[ch] = c + 1
        total[k] += 1
        sums[k] += _LOG[c + 1] - _LOG[c]
        whole += _LOG[c + 1] - _LOG[c]
        if i >= WINDOW - 1 and total[2] >= MIN_DIGITS and total[0] + total[1] >= MIN_LETTERS and bits(WINDOW, whole) >= MIN_BITS and all(bits(n, s) >= _CLASS_BITS[n] for n, s in zip(total, sums, strict=True)):
            a, b = i - WINDOW + 1, i + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return spans


def _members(chars: str) -> np.ndarray:
    table = np.zeros(128, bool)
    table[[ord(c) for c in chars]] = True
    return table


_LOWER, _UPPER, _DIGIT = _members("abcdefghijklmnopqrstuvwxyz"), _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _members("0123456789")
_HEX_LOWER, _HEX_UPPER, _BASE32 = _members("0123456789abcdef"), _members("0123456789ABCDEF"), _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
_WORDY = re.compile(r"[A-Z][a-z]{2,}|[a-z]{3,}")
_VOWEL = _members("aeiouAEIOU")


def _runs(flag: np.ndarray, length: int) -> np.ndarray:
    """Where a run of ``length`` flags ends."""
    total = np.concatenate([[0], np.cumsum(flag)])
    out = np.zeros(len(flag), bool)
    out[length - 1 :] = total[length:] - total[:-length] == length
    return out


def alphabet_windows(text: str) -> list[int]:
    """Where windows begin that look random within a small alphabet or in letters alone.

    Letters of one case must lack the vowels of words and hold a long run of
    consonants; letters of both cases must not be words with capitals.
    """
    code = np.frombuffer(text.encode("ascii"), np.uint8)
    if len(code) < WINDOW:
        return []

    def within(flag: np.ndarray, skip: int = 0) -> np.ndarray:
        """How many of a window's characters, but the first ``skip``, have a flag."""
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[WINDOW:] - total[skip : len(total) - WINDOW + skip]

    lower, upper, digit, vowel = _LOWER[code], _UPPER[code], _DIGIT[code], _VOWEL[code]
    low, up, digits = within(lower), within(upper), within(digit)
    letters, mixed = low + up, digits >= MIN_DIGITS
    wordy = np.zeros(len(code), bool)
    for m in _WORDY.finditer(text):
        wordy[m.start() : m.end()] = True
    few = within(vowel) <= 7
    harsh = few & (within(_runs((lower | upper) & ~vowel, 5), 4) > 0)
    hexed = ((within(_HEX_LOWER[code]) == WINDOW) | (within(_HEX_UPPER[code]) == WINDOW)) & mixed & (letters >= 3)
    based = (within(_BASE32[code]) == WINDOW) & mixed & (letters >= MIN_LETTERS)
    one_case = (letters >= WINDOW - 3) & (letters + digits == WINDOW) & ((low == 0) | (up == 0)) & harsh
    two_cases = (letters >= WINDOW - 4) & (low >= 3) & (up >= 3) & few & (within(wordy) <= 15)
    bar = np.full(len(low), np.inf)
    bar[one_case | two_cases] = LETTER_KEY_BITS
    bar[based] = BASE32_BITS
    bar[hexed] = HEX_BITS
    some = np.flatnonzero(np.isfinite(bar))
    windows = np.lib.stride_tricks.sliding_window_view(code, WINDOW)
    good = []
    for at in range(0, len(some), 4096):
        part = some[at : at + 4096]
        w = windows[part]
        same = (w[:, :, None] == w[:, None, :]).sum(axis=2)
        bits = math.log2(WINDOW) - np.log2(same).sum(axis=1) / WINDOW
        good += part[bits >= bar[part]].tolist()
    return good


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(run: str) -> Iterator[tuple[int, str]]:
    """What PUBLIC leaves of a run, with the place where it begins."""
    at = 0
    for m in PUBLIC.finditer(run):
        yield at, run[at : m.start()]
        at = m.end()
    yield at, run[at:]


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span of a text in code points, by start and then by kind."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_MIN]
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    base += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    covered = sorted((a, b) for a, b, _ in base)
    extra = []
    for m in CANDIDATE.finditer(text):
        for at, piece in _pieces(m.group()):
            for a, b in _joined(entropy_windows(piece) + [(i, i + WINDOW) for i in alphabet_windows(piece)]):
                if any(p.fullmatch(piece, a, b) for p in ALLOW):
                    continue
                start, end = m.start() + at + a, m.start() + at + b
                if end == m.end() and (pad := PADDING.match(text, end)):
                    end = pad.end()
                if not any(x < end and start < y for x, y in covered):
                    extra.append((start, end, "entropy"))
    return sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_NOTHING = hashlib.sha256(b"").hexdigest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.sub_batches(batches, "text"):
        texts = tk.clean(batch.column(1))
        n = len(texts)
        counts = np.zeros((n, 3), np.int64)
        digest, spans = [_NOTHING] * n, [""] * n
        # a window with entropy lies in a long candidate with a digit; the rest cannot hold a span
        maybe = pc.or_(pc.match_substring_regex(texts, _ANY), pc.match_substring_regex(texts, r"[A-Za-z0-9+/_=-]{20}"))
        for i in np.flatnonzero(maybe.to_numpy(zero_copy_only=False)).tolist():
            found = find_secrets(texts[i].as_py())
            base = [s for s in found if s[2] != "entropy"]
            for _, _, kind in base:
                counts[i, KINDS.index(kind)] += 1
            digest[i], spans[i] = hashlib.sha256(_written(base).encode()).hexdigest(), _written(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(3)), pa.array(digest), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of ``docs``.

    Spans of one kind do not overlap.  An entropy span that overlaps a span of a
    pattern is left out, for the pattern names it better.  Null text counts as
    empty and has no span; repeated rows repeat, a missing id stays missing,
    extra columns are ignored, an empty table gives an empty table.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
