"""URL filter by a bit-parallel wildcard automaton.

Rules are globs over the canonical URL, a text of the form ``.host<SEP>path``: ``*`` stands for
any run of characters and ``?`` for one. All globs are packed into one row of 64-bit words; a
set bit is a live position of the Shift-And automaton. One step per character moves all
positions of all globs at once, for all URLs of a batch, so the cost per URL grows with its
length and the number of words, not with the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matrel.llm.common import batches_of

SEP = "\x01"        # between host and path; a host or path that holds it is read as if it held \x02
BLOCK_URLS = 4096   # URLs simulated together: bounds the work memory of a task


@dataclass(frozen=True)
class Rule:
    """A glob, its verdict, the name it is reported by, and its rank (the highest match wins)."""

    glob: str
    verdict: str
    name: str | None = None
    rank: int = 0


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with all its subdomains and a path prefix; the longer rule ranks higher."""
    return Rule(f"*.{host}{SEP}{path}*", verdict, host + path, len(host + path))


#: Host and path rules of the production list.
PREFIX_RULES = [
    prefix_rule("allow", "com", "/"), prefix_rule("block", "example.com", "/en/"),
    prefix_rule("allow", "www.example.com", "/en/"), prefix_rule("block", "net", "/es/"),
    prefix_rule("block", "net", "/fr/"),
]
#: The method's own globs; they decide only where no rule above fits.
SPAM_GLOBS = [
    Rule(f"*{word}*{SEP}*", "block", rank=-1)
    for word in ("spam", "casino", "cheap-pills", "free-download", "adult", "xxx")
]
RULES = PREFIX_RULES + SPAM_GLOBS


class WildcardAutomaton:
    """Shift-And masks of many globs. ``match`` gives the matching globs of many texts."""

    def __init__(self, globs: Iterable[str]):
        starts, loops, accepts, tests = [], [], [], []   # per bit
        for glob in globs:
            # a bit per character, after one start bit; '*' lets the bit before it stay alive
            starts.append(len(tests))
            tests.append(None)
            loops.append(False)
            for ch in glob:
                if ch == "*":
                    loops[-1] = True
                else:
                    tests.append(ch)
                    loops.append(False)
            accepts.append(len(tests) - 1)
        self.bits = len(tests)
        self.words = max(1, -(-self.bits // 64))
        self.start = self._mask(starts)
        self.loop = self._mask([i for i, on in enumerate(loops) if on])
        self.accepts = accepts
        self.any_char = self._mask([i for i, ch in enumerate(tests) if ch == "?"])
        named = sorted({ch for ch in tests if ch not in (None, "?")})
        self.codes = np.array([ord(ch) for ch in named] or [-1], dtype=np.int64)
        self.table = np.stack([self.any_char] + [
            self.any_char | self._mask([i for i, t in enumerate(tests) if t == ch]) for ch in named])

    def _mask(self, bits: list[int]) -> np.ndarray:
        mask = np.zeros(self.words, dtype=np.uint64)
        for i in bits:
            mask[i // 64] |= np.uint64(1 << (i % 64))
        return mask

    def match(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix texts x globs: the glob matches the whole text."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        # class of each character: 0 for one that no glob names
        at = np.searchsorted(self.codes, flat).clip(0, len(self.codes) - 1)
        classes = np.where(self.codes[at] == flat, at + 1, 0) if len(self.table) > 1 else np.zeros(len(flat), dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))[:-1][order]
        lengths = lengths[order]
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        live = len(texts)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            while lengths[live - 1] <= step:     # texts are in falling length
                live -= 1
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            # a shift out of one glob lands on the start bit of the next, which no table row allows
            moved &= self.table[classes[offsets[:live] + step]]
            state[:live] = moved | (now & self.loop)
        found = np.zeros((len(texts), len(self.accepts)), dtype=bool)
        for g, bit in enumerate(self.accepts):
            found[order, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host = rest[:cut].translate(_LOWER)
    tail = rest[cut:]
    stop = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return host, tail[:stop]


_LOWER = {c: c + 32 for c in range(65, 91)}


def canonical(host: str, path: str) -> str:
    return f".{host.replace(SEP, chr(2))}{SEP}{path.replace(SEP, chr(2))}"


def judge_urls(pages: DataFrame, rules: list[Rule] = RULES, default: str = "allow") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    The matching rule of the highest rank decides; ``rule`` is its name, null for a glob without
    one. A null URL and one without ``://`` have an empty host and path; they match no host rule
    and get the verdict of the globs that match, else ``default``. Repeated rows are judged one
    by one, other columns are ignored, and an empty table gives an empty result.
    """
    ranked = sorted(rules, key=lambda r: -r.rank)
    id_type = pages.schema["page_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WildcardAutomaton([r.glob for r in ranked])
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK_URLS):
                batch = whole.slice(begin, BLOCK_URLS)
                (urls,) = batches_of(batch, "url")
                parts = [split_url(u) for u in urls]
                hits = automaton.match([canonical(*p) for p in parts])
                best = np.where(hits.any(axis=1), hits.argmax(axis=1), -1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(batch.schema.get_field_index("page_id")),
                    pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()),
                    pa.array([ranked[b].name if b >= 0 else None for b in best], pa.string()),
                    pa.array([ranked[b].verdict if b >= 0 else default for b in best], pa.string()),
                ], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(
        judge, f"page_id {id_type}, host string, path string, rule string, verdict string")


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
r AS (SELECT *, '.' || host AS dotted FROM c),
m AS (SELECT *, CASE WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                     WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                     WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
                     WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                     WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, 'spam|casino|cheap-pills|free-download|adult|xxx') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
