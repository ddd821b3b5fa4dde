"""URL filters: host and path rules, and globs, run as one bit-parallel automaton.

All globs are laid side by side in the bits of several 64-bit words. For each byte of a
canonical URL (host in lower case, then path) every pattern takes one Shift-And step at once:

    D = ((D << 1) & accepts[byte]) | (D & loops[byte])

A glob has literals, ``?`` (a byte other than ``/``), ``*`` (a run of those) and ``**`` (any run), and
must match the whole URL. A batch of URLs goes through the steps together, longest first.

A rule (verdict, host, path) fits its host and all subdomains where the URL's path starts with the rule's; of
fitting rules the longest wins. Where none fits, a URL that a glob matches is blocked, any other allowed. The host is what
stands between the first ``://`` and the next of ``/?#``, the path what follows up to ``?`` or ``#``. A null URL, or one
without ``://``, has neither and is allowed. Repeated and very long URLs are judged like any other; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at, lower_ascii, sealed


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def globs(self) -> tuple[str, str]:
        """The host itself and its subdomains; a host part has no slash, so ``*`` stays inside it."""
        return f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"


# Hosts that sell or spam, whatever the path.
BLOCKED_HOSTS = ("*spam-*", "*cheap-*", "*-pills*", "*casino*")
BATCH = 4096


def host_globs(host: str) -> tuple[str, str]:
    """Any path of a host, or none."""
    return host, f"{host}/**"


class Automaton:
    """Masks of all globs; ``matches`` tells which of them match which texts."""

    def __init__(self, globs: Sequence[str]):
        tokens = [self._tokens(g.encode()) for g in globs]
        # One bit per pattern before its first symbol, and one per symbol.
        sizes = [1 + sum(t not in (b"*", b"**") for t in ts) for ts in tokens]
        starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.words = max(1, int(-(-starts[-1] // 64)))
        self.accepts = np.zeros((256, self.words), np.uint64)
        self.loops = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.last = starts[1:] - 1
        segment = np.arange(256) != ord("/")
        for first, ts in zip(starts[:-1].tolist(), tokens):
            self._mark(self.start, first)
            bit = first
            for t in ts:
                if t in (b"*", b"**"):
                    self._mark(self.loops, bit, segment if t == b"*" else slice(None))
                else:
                    bit += 1
                    self._mark(self.accepts, bit, segment if t == b"?" else t[-1])

    @staticmethod
    def _tokens(glob: bytes) -> list[bytes]:
        out, i = [], 0
        while i < len(glob):
            if glob[i : i + 2] == b"**":
                out.append(b"**")
                i += 2
            elif glob[i : i + 1] in (b"*", b"?"):
                out.append(glob[i : i + 1])
                i += 1
            else:
                out.append(b"=" + glob[i : i + 1])
                i += 1
        return out

    @staticmethod
    def _mark(masks: np.ndarray, bit: int, rows: object = ...) -> None:
        one = np.uint64(1) << np.uint64(bit % 64)
        if masks.ndim == 1:
            masks[bit // 64] |= one
        else:
            masks[rows, bit // 64] |= one

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """Booleans, texts by globs."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        joined = np.frombuffer(b"".join(texts[i] for i in order) + b"\0", np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.tile(self.start, (len(texts), 1))
        one, high = np.uint64(1), np.uint64(63)
        active = len(texts)
        for step in range(int(lengths[0]) if len(texts) else 0):
            while active and lengths[active - 1] <= step:
                active -= 1
            now = state[:active]
            byte = joined[starts[:active] + step]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> high
            state[:active] = (moved & self.accepts[byte]) | (now & self.loops[byte])
        ends = (state[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & one
        out = np.empty(ends.shape, bool)
        out[order] = ends.astype(bool)
        return out


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], blocked_hosts: Sequence[str] = BLOCKED_HOSTS, blocked_globs: Sequence[str] = (),
    id_column: str = "page_id", url_column: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    globs = [g for rule in rules for g in rule.globs]
    n_rules = len(globs)
    globs += [g for host in blocked_hosts for g in host_globs(host)] + list(blocked_globs)
    automaton = Automaton(globs)
    by_length = sorted(range(len(rules)), key=lambda k: -len((rules[k].host + rules[k].path).encode()))
    names = [rules[k].host + rules[k].path for k in by_length]
    verdicts = [rules[k].verdict for k in by_length]
    url = F.coalesce(at(pages, url_column).cast("string"), F.lit(""))
    parts = sealed(pages).select(
        at(pages, id_column).alias("id"),
        lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    schema = parts.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                found = automaton.matches([(h + p).encode() for h, p in zip(hosts, paths)])
                fits = (found[:, 0:n_rules:2] | found[:, 1:n_rules:2])[:, by_length]
                blocked = found[:, n_rules:].any(1)
                first = np.where(fits.any(1), fits.argmax(1) if names else 0, -1).tolist()
                rule = [names[k] if k >= 0 else None for k in first]
                verdict = [verdicts[k] if k >= 0 else "block" if b else "allow" for k, b in zip(first, blocked.tolist())]
                yield pa.record_batch([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=schema.names)

    return parts.mapInArrow(rows, schema).toDF(id_column, "host", "path", "rule", "verdict")
