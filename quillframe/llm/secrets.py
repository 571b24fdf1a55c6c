"""Secret scan by the novelty of strings under dictionary-primed zstandard.

Known forms are found by pattern. Further strings that stand in a sensitive
context are candidates: each is measured by its marginal compressed bytes, what
it adds to the compressed size of the code around it when the compressor
already knows common identifiers. Prose, paths and names cost little; keys do
not compress. A random string costs about what its alphabet asks (3.3 bits a digit, 4.7 a
letter of one case, 6 where all are mixed), whatever its length; what costs at least ``SHARE`` of
that, and ``TOTAL`` or ``TOTAL_PLAIN`` bits in all, is reported. A name and the value assigned to it without a space are told
apart first.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches

#: Least share of the bits that a random string of the same alphabet has.
SHARE = 0.9
#: Least marginal bits in all. Where letters and digits change kind no more often than every ``WORDED`` characters, as in names made of words, more is asked, and of the longest piece of one kind: words and numbers are such pieces, but seldom so long.
TOTAL, TOTAL_PLAIN, WORDED = 64, 88, 4
#: Least characters of a candidate: fewer cannot hold ``TOTAL``.
LEAST = 8
#: Share of letters in known words from which a string is a name, whatever is between them.
SPELT = 0.6
#: Characters of surrounding code on either side, and how far a sensitive word may stand before.
AROUND, REACH = 160, 48

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=~-]{{{LEAST},}}")
#: Names and values of a candidate; what it ends with is padding.
_PART = re.compile(r"[^=]+(?:=+\Z)?")
_WORDS = ("key", "auth", "cred", "bearer", "private", "signature", "session", "login", "pwd", "pass", "secret", "token", "jwt", "cert")
_SENSITIVE = re.compile("|".join(_WORDS), re.A | re.I)
_HINTS = ("pass", "secret", "token", "api")

#: What the compressor knows beforehand: common identifiers and phrases of code and configuration.
IDENTIFIERS = """
access_key access_token account api_key apikey app application args authorization authorized_keys aws_access_key_id
aws_secret_access_key base64 bearer branch build bucket cache callback certificate changeme class client client_id
client_secret client_secret_here commit config configuration connection connection_string const content cookie count credential credentials
data database default def description digest document domain enabled encoding encryption endpoint environment error example
export expression false file filename float function generate_token get_secret github handler hash header host hostname
html http https identifier import index input instance integer integrity jwt json kernel keystore label length library localhost login
manager message method model module name namespace node number object option organization output package parameter
passphrase password password_hash path payload permission placeholder platform policy port private_key process production project property protocol provider proxy
public_key python query queue record refresh_token registry release remote repository request resource response result return role root
sandbox schema script secret secret_key secret_manager security select self server service session session_id session_token settings sha1 sha256 signature
signing_key source ssh_key staging status storage store string system table target template tenant test timestamp tls token token_endpoint true type
undefined unauthorized update upload url user user_id username utf8 value variable vault vendor verify version warning webhook workspace xml yaml your_api_key_here
/usr/local/lib/python3/site-packages /usr/share /home/user /var/log /etc/ssl/certs /opt/bin node_modules dist-packages
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789
"""


class Novelty:
    """Marginal compressed bits a character of a string within its surroundings."""

    def __init__(self, known: str = IDENTIFIERS):
        primer = zstandard.ZstdCompressionDict(known.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
        base = len(self.packer.compress(around.encode()))
        return 8 * (len(self.packer.compress((around + text[start:end]).encode())) - base) / max(1, end - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the known forms; each kind leftmost and not overlapping itself."""
    out, low = [], text.lower()
    if any(h in low for h in _HINTS):
        out += [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(*m.span(), 2) for m in _HEX.finditer(text)]
    return out


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def parts(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, from) of what may be a secret: names and values of the candidates as far as they lie outside known forms. A sensitive word may stand between from and start."""
    known = _joined(base)
    ends = [b for _, b in known]
    for m in _CANDIDATE.finditer(text):
        before, k = m.start(), bisect_right(ends, m.start())
        for p in _PART.finditer(m[0]):
            at, end = m.start() + p.start(), m.start() + p.end()
            start = at
            while True:
                a, b = known[k] if k < len(known) and known[k][0] < end else (end, end)
                if min(a, end) - at >= LEAST:
                    yield at, min(a, end), max(0, min(before, at) - REACH)
                at = max(at, b)
                if b >= end:
                    break
                k += 1
            before = start


_KNOWN = {w for w in re.findall("[a-z]{4,}", IDENTIFIERS.lower()) if len(w) < 20}
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def spelt(value: str) -> bool:
    """Whether a string is spelt from known words, whatever is between them."""
    letters = sum(c.isalpha() for c in value)
    return letters > 0 and sum(len(w) for w in _NAME_PART.findall(value) if w.lower() in _KNOWN) >= SPELT * letters


def random_bits(value: str) -> float:
    """Bits a character of a random string of the least usual alphabet that has all letters and digits of this one."""
    digits, lower, upper = (any(test(c) for c in value) for test in (str.isdigit, str.islower, str.isupper))
    if (digits or lower or upper) and not (lower and upper) and digits and all(c in "0123456789abcdefABCDEF" or not c.isalnum() for c in value):
        return 4.0 if lower or upper else math.log2(10)
    return math.log2(max(10, 10 * digits + 26 * lower + 26 * upper))


def is_novel(text: str, start: int, end: int, novelty: Novelty) -> bool:
    """Whether a string costs what a random one does."""
    value = text[start:end]
    if spelt(value):
        return False
    pieces = list(_PIECE.finditer(value))
    plain = bool(pieces) and sum(len(m[0]) for m in pieces) >= WORDED * len(pieces)
    if plain:
        longest = max(pieces, key=lambda m: len(m[0]))
        start, end = start + longest.start(), start + longest.end()
    bits = novelty(text, start, end)
    return bits >= SHARE * random_bits(text[start:end]) and bits * (end - start) >= (TOTAL_PLAIN if plain else TOTAL)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible strings outside the known forms that stand in a sensitive context: the name they are assigned to, or what is before."""
    out, low = [], text.lower()
    if not any(w in low for w in _WORDS):
        return out
    for start, end, since in parts(text, base):
        if not _SENSITIVE.search(text, since, start):
            continue
        if is_novel(text, start, end, novelty):
            out.append((start, end, 3))
    return out


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, strings.

    Spans are kind:start:end in code points, by start and then kind, comma-joined; base_sha256 is
    of the known forms alone, spans of all. strings are the reported strings in that order. A null
    text is empty, and has none. Known forms always stay; novel strings are added. Rows that repeat, and null ids, are
    rows like others; an empty table gives none; further columns, of any name, are not read.
    """

    def make():
        novelty = Novelty()
        show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)
        order = lambda s: (s[0], s[2])

        def step(batch):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = sorted(base_spans(text), key=order)
                spans = sorted(base + novel_spans(text, base, novelty), key=order)
                kinds = [k for _, _, k in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(show(base).encode()).hexdigest(), show(spans), [text[a:b] for a, b, _ in spans]))
            names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "strings")
            return {"doc_id": batch.column(0)} | {k: list(v) for k, v in zip(names, zip(*rows))}

        return step

    return by_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, strings array<string>")
