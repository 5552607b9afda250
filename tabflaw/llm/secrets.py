"""Secret scans: patterns with fixed rules, and strings that a vocabulary cannot shorten.

Base kinds, each found from the left without overlaps, over whole texts:
``assign`` (a key word, = or :, a value), ``access`` (an access key) and
``hex`` (a long run of lower-case hexadecimal digits); matches whose value is
too short are dropped after matching.

Token efficiency adds the kind ``random``: a run of key characters is encoded
with a byte-pair vocabulary; words and names need few tokens for their length,
random strings need one for every character or two.  A run is reported if its
characters per token are below ``max_ratio``.  Known digests (hexadecimal of a
usual digest's length, and such with dashes as in UUIDs) are left out.  In
identifiers (words joined by signs or capital letters, with short numbers at
their ends) only the words count, and numbers as long as a run: they are left
out if these are cheap too, where a word of one token is never dear.  If a run as
a whole is cheap, its stretches of parts between signs are judged, so words
do not hide a key in a path: the dearest stretch of RUN's least length is
reported, then what stands before and behind it is judged.  Base spans always
stay, and a string may be reported by both.

Positions are code points, ends exclusive.

Defined results: null is the empty text: no spans.  Extra columns are ignored,
repeated rows are scanned one by one.  A run of more than ENCODED characters is
encoded in slices, so its token count may differ by one a slice.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import struct_type, text_udf

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")           # 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 16                       # characters of a run
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
MAX_RATIO = 2.5                  # characters per token; prose and names have 3 to 6, random strings 1.2 to 2.5
#: the same for the words of identifiers (letters of one case: random ones 1.3 to 2.0, rare long words from 2.2 on) and
#: for long numbers (at most three digits a token: random ones 2.0 to 2.7)
MAX_WORD_RATIO, MAX_NUMBER_RATIO = 2.1, 3.0
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
                    r"|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", re.IGNORECASE)
#: words (also as humps of three letters or more) with up to four digits at the end, or numbers, joined by signs
IDENTIFIER = re.compile(r"[+/_-]*(?:(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)(?:[A-Z][a-z]{2,})*[0-9]{0,4}|[0-9]+)"
                        r"(?:[+/_-]+(?:(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)(?:[A-Z][a-z]{2,})*[0-9]{0,4}|[0-9]+))*[+/_-]*")
#: what counts of an identifier
WORD = re.compile(r"[A-Za-z]+|[0-9]{%d,}" % LEAST)
#: digests between signs, or the parts of a run
PART = re.compile(rf"(?<![A-Za-z0-9]){DIGEST.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+", re.IGNORECASE)
ENCODED = 512                    # characters given to the vocabulary at once (longer runs in slices)


@functools.cache
def encoding(path: str, pattern: str):
    """A tiktoken encoding from a rank file, kept by the worker."""
    import base64

    import tiktoken
    with open(path, encoding="ascii") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds, in the order of start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def dearness(part: str, encode, max_ratio: float) -> float:
    """Characters that ``part`` falls short of the limit for its tokens: above 0 for random strings."""
    def short(s: str, limit: float, least: float = 0) -> float:
        return limit * sum(len(encode(s[k:k + ENCODED])) for k in range(0, len(s), ENCODED)) - max(len(s), least)

    if DIGEST.fullmatch(part):
        return 0.0
    if IDENTIFIER.fullmatch(part):
        return sum(short(w, MAX_NUMBER_RATIO) if w.isdigit() else short(w, MAX_WORD_RATIO, MAX_WORD_RATIO) for w in WORD.findall(part))
    return short(part, max_ratio)


def dear_stretches(run: str, encode, max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of the dearest stretches of a run's parts with LEAST characters or more; they don't overlap."""
    parts = [m.span() for m in PART.finditer(run)]
    if len(parts) < 2:
        return []
    dear = [dearness(run[s:e], encode, max_ratio) for s, e in parts]
    out, left = [], [(0, len(parts))]
    while left:
        lo, hi = left.pop()
        best, total, sums, least, i = None, 0.0, [0.0], None, lo
        for j in range(lo, hi):                        # stretches that end with part j; the best start so far is ``least``
            total += dear[j]
            sums.append(total)
            while i <= j and parts[j][1] - parts[i][0] >= LEAST:
                if dear[i] > 0 and (least is None or sums[i - lo] < sums[least - lo]):
                    least = i
                i += 1
            if least is not None and dear[j] > 0 and (gain := total - sums[least - lo]) > 0 and (best is None or gain > best[0]):
                best = gain, least, j + 1
        if best is not None:
            _, a, b = best
            out.append((parts[a][0], parts[b - 1][1]))
            left += [(lo, a), (b, hi)]
    return sorted(out)


def random_spans(text: str, encode, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """Runs of key characters that the vocabulary needs many tokens for, or stretches of such runs."""
    out = []
    for m in RUN.finditer(text):
        run = m.group()
        if DIGEST.fullmatch(run):
            continue
        if dearness(run, encode, max_ratio) > 0:
            out.append((m.start(), 3, m.end()))
        else:
            out += [(m.start() + s, 3, m.start() + e) for s, e in dear_stretches(run, encode, max_ratio)]
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FOUND = struct_type([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                      ("base_sha256", pa.string()), ("spans", pa.string())])
_FOUND_SQL = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def find_secrets(text: Column, vocabulary: str, pattern: str, max_ratio: float = MAX_RATIO) -> Column:
    """Struct (n_assign, n_access, n_hex, base_sha256, spans) of a text column.

    ``vocabulary`` is a rank file that every executor has, ``pattern`` its split pattern.
    """
    def run(texts: list) -> list:
        encode, out = encoding(vocabulary, pattern).encode_ordinary, []
        for t in texts:
            t = t or ""
            base = base_spans(t)
            n = [sum(k == x for _, k, _ in base) for x in range(3)]
            out.append({"n_assign": n[0], "n_access": n[1], "n_hex": n[2],
                        "base_sha256": hashlib.sha256(listed(base).encode()).hexdigest(),
                        "spans": listed(sorted(base + random_spans(t, encode, max_ratio)))})
        return out

    return text_udf(run, _FOUND_SQL, _FOUND)(text)


def secret_scan(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text",
                max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), find_secrets(F.col(text), vocabulary, pattern, max_ratio).alias("s")) \
        .select("doc_id", "s.*")
