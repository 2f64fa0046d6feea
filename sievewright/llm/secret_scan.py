"""Secret scan: base patterns, and a battery of randomness tests for other tokens.

A token is a run of 20 or more characters of ``[A-Za-z0-9+/_-]`` (with ``=`` at
its end) that has both a letter and a digit.  Its encoding is inferred from its
alphabet (hex, base32, base36, base62, base64).  The battery asks twice.

Is it random?  Chi-squared uniformity over the encoding's alphabet, the
correlation of neighbours, and the number of runs of like characters; a token
that one of the three refutes at ``REFUTED`` (keyboard rows, counters, repeated
blocks) has the p-value 1.

Is it an ordinary identifier?  The same three properties as words have them:

* the characters: uniform over the encoding's alphabet, or as in words;
* neighbours: vowels and consonants take turns in words;
* runs: changes between classes of characters are too many for an identifier,
  in which a class changes with probability ``STICKY``.

Together they are the likelihood of the token as random over that of an ordinary
identifier; an ordinary one exceeds t with a probability of at most 1 / t, which
is the p-value.  Tokens are declared by the Benjamini-Hochberg rule at rate
``FDR`` within each class of lengths, from a histogram of p-values over all
documents (a fixed number of bins, however many tokens).

Defined results: a null text counts as empty; a document without spans has the
hash of the empty string; repeated rows are scanned each on its own; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._common import stored

# Kinds of base spans in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
MIN_ASSIGNED = 6

FDR = 0.001
#: A p-value below which a test refutes that a token is random.
REFUTED = 1e-4
STICKY = 0.15
#: Frequencies of letters in words, the share of letters that come from no word, and how often a vowel follows a vowel, a consonant and neither.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1), strict=True))
STRAY = 0.1
VOWELS, VOWEL_AFTER = "aeiou", (0.2, 0.5, 0.385)
#: Bins a decade of the histogram of p-values, and decades; lengths from which a class begins.
BINS, DECADES = 20, 30
LENGTHS = (20, 24, 32, 48, 64, 128)


def _upper_binomial(n: int, k: int, p: float) -> float:
    """P(X >= k) for a binomial X."""
    if k <= 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _upper_chi2(x: float, df: int) -> float:
    """P(X >= x) by the cube-root approximation of the chi-squared distribution."""
    if x <= 0:
        return 1.0
    spread = 2 / (9 * df)
    return _upper_normal(((x / df) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def encoding(token: str) -> tuple[str, str]:
    """The smallest alphabet that holds the token: its name and its characters."""
    if re.fullmatch(r"[0-9a-f]+", token):
        return "hex", "0123456789abcdef"
    if re.fullmatch(r"[0-9A-F]+", token):
        return "hex", "0123456789ABCDEF"
    if re.fullmatch(r"[A-Z2-7]+", token):
        return "base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    for name, found, letters in (("base36", r"[0-9a-z]+", "abcdefghijklmnopqrstuvwxyz"), ("base36", r"[0-9A-Z]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("base62", r"[0-9A-Za-z]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")):
        if re.fullmatch(found, token):
            return name, letters + "0123456789"
    ends = "-_" if "-" in token or "_" in token else "+/"
    return "base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + ends


def _char_class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2


def battery(token: str) -> tuple[float, float, float]:
    """P-values of a random token of the inferred encoding: chi-squared uniformity, serial correlation, runs."""
    body = token.rstrip("=")
    _, alphabet = encoding(body)
    value = {c: i for i, c in enumerate(alphabet)}
    codes = [value[c] for c in body if c in value]
    n, m = len(codes), len(alphabet)
    if n < 2:
        return 1.0, 1.0, 1.0
    seen: dict[int, int] = {}
    for x in codes:
        seen[x] = seen.get(x, 0) + 1
    chi = sum(c * c for c in seen.values()) * m / n - n
    mean = sum(codes) / n
    spread = sum((x - mean) ** 2 for x in codes)
    serial = abs(sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False)) / spread) * math.sqrt(n) if spread else math.inf
    classes = [_char_class(c) for c in body if c.isalnum()]
    shares = [sum(_char_class(c) == k for c in alphabet if c.isalnum()) for k in range(3)]
    change = 1 - sum(x * x for x in shares) / sum(shares) ** 2
    steps, changes = max(0, len(classes) - 1), sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    tails = _upper_binomial(steps, changes, change), _upper_binomial(steps, steps - changes, 1 - change)
    return _upper_chi2(chi, m - 1), 2 * _upper_normal(serial), min(1.0, 2 * min(tails))


def _letter_logs() -> dict[tuple[str, int], float]:
    """Log-likelihood of a letter in a word after a vowel (0), a consonant (1) or neither (2)."""
    out = {}
    for c, n in LETTERS.items():
        vowel = c in VOWELS
        share = n / sum(m for x, m in LETTERS.items() if (x in VOWELS) == vowel)
        for after, p in enumerate(VOWEL_AFTER):
            out[c, after] = math.log((1 - STRAY) * share * (p if vowel else 1 - p) + STRAY / 26)
    return out


_LETTER_LOGS = _letter_logs()
#: Encodings among which the likelihood as random is shared out: hex and base36 in two cases each, base32, base62, base64.
ENCODINGS = 7


def combined(token: str) -> float:
    """P-value of the token as an ordinary identifier, by its characters, their neighbours and its runs."""
    body = [c for c in token if c.isalnum()]  # separators are no evidence
    name, alphabet = encoding(token.rstrip("="))
    size = 62 if name == "base64" else len(alphabet)
    log = -len(body) * math.log(size) - math.log(ENCODINGS)
    cls, after = -1, 2
    for c in body:
        own = _char_class(c)
        log -= math.log(1 / 3 if cls < 0 else 1 - STICKY if own == cls else STICKY / 2)
        cls = own
        if own == 0:
            log += math.log(10)
            after = 2
        else:
            low = c.lower()
            log -= _LETTER_LOGS[low, after]
            after = 0 if low in VOWELS else 1
    return math.exp(-max(0.0, min(log, 700.0)))


def p_value(token: str) -> float:
    """As an ordinary identifier; 1 for a token that is not random either."""
    p = combined(token)
    return 1.0 if p > FDR or min(battery(token)) < REFUTED else p


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS)


def p_bin(p: float) -> int:
    """The bin of a p-value: 0 holds 1, larger bins hold smaller values."""
    return min(BINS * DECADES, int(-math.log10(max(p, 10.0**-DECADES)) * BINS + 1e-9))


def base_spans(text: str, patterns) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, sorted."""
    assign, access, hexes = patterns
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    spans += [(m.start(), 1, m.end()) for m in access.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    patterns = re.compile(ASSIGN, re.IGNORECASE | re.ASCII), re.compile(ACCESS), re.compile(HEX)
    token, mixed = re.compile(TOKEN), re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tokens"]
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    others = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("bin", pa.int32())]))
    for batch in batches:
        counts, digests, bases, tokens = [], [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            spans = base_spans(text, patterns)
            counts.append([sum(kind == x for _, kind, _ in spans) for x in range(3)])
            digests.append(hashlib.sha256(joined(spans).encode()).hexdigest())
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            found = []
            for m in token.finditer(text):
                if mixed.match(m[0]) and not any(s < m.end() and m.start() < e for s, _, e in spans):
                    found.append({"start": m.start(), "end": m.end(), "class": length_class(len(m[0])), "bin": p_bin(p_value(m[0]))})
            tokens.append(found)
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(bases, kinds), pa.array(tokens, others)], names)


def declared_bins(histogram: list[tuple[int, int, int]]) -> dict[int, int]:
    """For each length class, the smallest bin that the Benjamini-Hochberg rule declares; classes without one are absent."""
    found: dict[int, int] = {}
    for cls in {c for c, _, _ in histogram}:
        bins = sorted(((b, n) for c, b, n in histogram if c == cls), reverse=True)
        total, upto = sum(n for _, n in bins), 0
        for b, n in bins:
            upto += n
            if 10 ** (-b / BINS) <= FDR * upto / total:  # the largest p-value of the bin
                found[cls] = b
    return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base spans, ``base_sha256``, ``spans`` and ``n_random``."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start: long, kind: int, end: long>>, tokens array<struct<start: long, end: long, class: int, bin: int>>"
    scanned = stored(rows.mapInArrow(_scan, schema), "secret-scan")
    histogram = scanned.select(F.inline("tokens")).groupBy("class", "bin").count()  # at most len(LENGTHS) * BINS * DECADES rows
    limits = declared_bins([(r["class"], r["bin"], r["count"]) for r in histogram.collect()])

    def is_declared(t):
        out = F.lit(False)
        for cls, least in limits.items():
            out = out | ((t["class"] == cls) & (t["bin"] >= least))
        return out

    extra = F.transform(F.filter("tokens", is_declared), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    every = F.array_sort(F.concat("base", extra))
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(F.transform(every, name), ",").alias("spans"), F.size(extra).cast("long").alias("n_random"))
