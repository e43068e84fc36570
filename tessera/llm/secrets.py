"""Secrets in whole texts: three fixed patterns, and a test of token efficiency for what they miss.

A byte-pair vocabulary spells everyday text in few tokens, as it learned its strings; a random string has none to use.
Runs of at least ``LEAST`` characters of keys (letters, digits, ``+/_=-``) with at most ``RATIO`` characters a token are
random strings. Of 3,000 drawn strings of mixed letters and digits of 20 characters 99 % have at most 1.67, of names in
code hardly any have under 2.5. Not tested are

* what overlaps a span of the fixed patterns, which stays as it is;
* known digests: hex strings, in either case, of the lengths in ``DIGESTS``;
* known identifiers: UUIDs, and words, capitals or numbers alone or joined by single ``+/_=-`` (slugs, paths, constants,
  dates, card and phone numbers). Words of one case tell nothing: a long compound may be as rare as a random string.

Spans are (kind, start, end) in code points, end excluded, in order of start and then of kind as in ``KINDS``. Null and
empty texts have no spans. Very long texts are scanned whole, each in one worker. Rows are neither merged nor dropped,
repeated ones each have their own result, and other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

KINDS = ("assign", "access", "hex", "random")
# Fixed patterns; only ASCII letters have two cases here.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Characters of a string that is tested, at least.
LEAST = 16
#: Characters for each token of a random string, at most.
RATIO = 2.0
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
# Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_PART = r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"
_NAME = re.compile(rf"[+/_=-]*{_PART}(?:[+/_=-]{_PART})*[+/_=-]*|[+/_=-]+")
#: Verdicts on strings that a Python worker keeps.
CACHE = 200_000

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tiktoken encoding of a file of ranks, made once for each worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _encodings[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def known(string: str) -> bool:
    """Whether a string is a digest or an identifier of a known form."""
    return bool((len(string) in DIGESTS and _HEX_ONLY.fullmatch(string)) or _UUID.fullmatch(string) or _NAME.fullmatch(string))


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place of the kind) of what the fixed patterns match, those of a kind from left to right."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


class Scanner:
    """Finds spans, keeping the verdicts on strings seen before."""

    def __init__(self, path: str, ratio: float = RATIO):
        self.encode, self.ratio, self.seen = encoding(path).encode_ordinary, ratio, {}

    def random(self, string: str) -> bool:
        verdict = self.seen.get(string)
        if verdict is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            verdict = self.seen[string] = not known(string) and len(string) <= self.ratio * len(self.encode(string))
        return verdict

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """All spans (start, end, place of the kind) of a text, those of the fixed patterns before the others."""
        found = fixed_spans(text)
        merged: list[list[int]] = []
        for start, end, _ in sorted(found):
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        at, more = 0, []
        for m in RUN.finditer(text):
            while at < len(merged) and merged[at][1] <= m.start():
                at += 1
            if (at == len(merged) or merged[at][0] >= m.end()) and self.random(m.group()):
                more.append((m.start(), m.end(), 3))
        return found + more


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, ranks: str, ratio: float = RATIO) -> DataFrame:
    """Per row of docs: doc_id and found, an array of (kind, start, end). ranks is the path of a tiktoken vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ranks, ratio)
        for batch in common.slices(batches):
            found = []
            for text in batch.column("text").to_pylist():
                spans = sorted(scanner.spans(text), key=lambda s: (s[0], s[2]))
                found.append([{"kind": KINDS[kind], "start": start, "end": end} for start, end, kind in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS)], names=["doc_id", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, found array<struct<kind: string, start: int, end: int>>")


def digest(found: DataFrame) -> DataFrame:
    """Per row of scan(): doc_id, n_assign, n_access, n_hex, base_sha256 and spans, written as kind:start:end, comma-joined."""

    def of(kind: str):
        return F.filter("found", lambda s: s["kind"] == kind)

    def joined(kept):
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["kind"] != KINDS[3])
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
