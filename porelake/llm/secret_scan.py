"""Operator 2: secret scans through trigram inverted indexes.

The documents of an Arrow batch are cut into segments, and each segment gets an inverted index from
trigrams to postings (its documents that hold them). Every rule's regex is parsed into a Boolean
query over trigrams that any match must hold; postings are intersected and united accordingly, and
the regex verifies the candidates only. A rule whose regex has no mandatory trigram (runs of hex
digits) scans every document. Segments never leave their task, so nothing is shuffled.

Defined results: a null text counts as empty; offsets are code points, ends exclusive; a span is
the whole match; spans that start together stand in the order of their rules. Repeated rows are
scanned one by one; an empty table gives no rows; further columns are ignored. Base rules (assign,
access, hex) come first among kinds; the rules after them only add spans. A segment ends at 4 MB of
text, so a very long text is one by itself; no rule scans a run of characters more than a few times,
so its time is in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from porelake.llm._shared import id_and_text, map_batches, plain_names, slices, table

SPAN_SCHEMA = "doc_id long, kinds array<string>, starts array<int>, ends array<int>"
DIGEST_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # code points that the group must have; shorter matches are dropped


BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Well-known formats of issued credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

ALL = True  # the query that every document answers


def both(a, b):
    return b if a is ALL else a if b is ALL else ("and", a, b)


def either(queries: list):
    out = queries[0]
    for q in queries[1:]:
        if out is ALL or q is ALL:
            return ALL
        out = ("or", out, q)
    return out


def spelled(strings: set[str]):
    """Some string of the set occurs: for each one all its trigrams."""
    if not strings or min(map(len, strings)) < 3:
        return ALL
    parts = []
    for s in sorted(strings):
        q = ALL
        for t in dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)):
            q = both(q, t)
        parts.append(q)
    return either(parts)


def trigram_query(pattern: str, most: int = 64):
    """Boolean query over lower-case ASCII trigrams; ALL if none is mandatory. It never misses a
    document that the pattern matches, since both sides are lower-cased."""

    def exact(items) -> set[str] | None:
        """All strings that the items can spell, if these are few."""
        texts = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                more = {chr(arg).lower()} if arg < 128 else None
            elif op is sre.IN:
                more = set()
                for kind, x in arg:
                    if kind is sre.LITERAL and x < 128:
                        more.add(chr(x).lower())
                    else:
                        more = None
                        break
            elif op is sre.SUBPATTERN:
                more = exact(arg[3])
            elif op is sre.BRANCH:
                branches = [exact(b) for b in arg[1]]
                more = None if None in branches else set().union(*branches)
            elif op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 3:
                inner = exact(arg[2])
                more = None
                if inner is not None:
                    more, power = set(), {""}
                    for n in range(arg[1] + 1):
                        more |= power if n >= arg[0] else set()
                        power = {a + b for a in power for b in inner}
            else:
                more = None
            if more is None or len(texts) * len(more) > most:
                return None
            texts = {a + b for a in texts for b in more}
        return texts

    def walk(items):
        query, run = ALL, {""}
        for item in items:
            more = exact([item])
            if more is not None and len(run) * len(more) <= most:
                run = {a + b for a in run for b in more}
                continue
            query, run = both(query, spelled(run)), {""}
            op, arg = item
            if more is not None:
                run = more
            elif op is sre.SUBPATTERN:
                query = both(query, walk(arg[3]))
            elif op is sre.BRANCH:
                query = both(query, either([walk(b) for b in arg[1]]))
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                query = both(query, walk(arg[2]))
        return both(query, spelled(run))

    return walk(list(sre_parser.parse(pattern)))


def trigrams_of(query) -> set[str]:
    return set() if query is ALL else {query} if isinstance(query, str) else trigrams_of(query[1]) | trigrams_of(query[2])


class Scanner:
    """Compiled rules and the trigrams that their queries look up."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.regexes = [re.compile(r.pattern) for r in rules]
        self.trigrams = sorted(set().union(*map(trigrams_of, self.queries)))
        self.slot_of = np.zeros(1 << 24, np.uint16)
        for n, t in enumerate(self.trigrams):
            self.slot_of[int.from_bytes(t.encode(), "big")] = n + 1

    def postings(self, texts: list[str], step: int = 1 << 20) -> dict[str, np.ndarray]:
        """The segment's inverted index: trigram -> ascending numbers of the documents that hold it.
        Trigrams are looked up ``step`` bytes at a time."""
        raw = [t.encode("utf-8", "replace").lower() for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        whole = np.frombuffer(b"\n".join(raw), np.uint8)
        found = [np.zeros(0, np.int64)]
        for start in range(0, len(whole) - 2, step):
            data = whole[start : start + step + 2].astype(np.uint32)
            slots = self.slot_of[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
            at = np.flatnonzero(slots)
            found.append(np.unique(slots[at].astype(np.int64) * len(texts) + np.searchsorted(ends, start + at, "right")))
        slot, doc = np.divmod(np.unique(np.concatenate(found)), max(1, len(texts)))
        cuts = np.searchsorted(slot, np.arange(1, len(self.trigrams) + 2))
        return {t: doc[cuts[n] : cuts[n + 1]] for n, t in enumerate(self.trigrams)}

    def answer(self, query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is ALL:
            return np.arange(n)
        if isinstance(query, str):
            return postings.get(query, np.zeros(0, np.int64))
        a, b = (self.answer(q, postings, n) for q in query[1:])
        return np.intersect1d(a, b, assume_unique=True) if query[0] == "and" else np.union1d(a, b)

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans (start, place of the rule, end), sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.postings(texts)
        for place, (rule, query, regex) in enumerate(zip(self.rules, self.queries, self.regexes)):
            for d in self.answer(query, postings, len(texts)):
                for m in regex.finditer(texts[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[d].append((m.start(), place, m.end()))
        for spans in found:
            spans.sort()
        return found


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, segment: int = 1000) -> DataFrame:
    """(doc_id, kinds, starts, ends): the spans of every document, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in chain.from_iterable(slices(x, segment) for x in batches):
            spans = scanner.scan([t or "" for t in b.column("text").to_pylist()])
            yield pa.record_batch({
                "doc_id": b.column("doc_id"),
                "kinds": pa.array([[rules[k].kind for _, k, _ in s] for s in spans], pa.list_(pa.string())),
                "starts": pa.array([[a for a, _, _ in s] for s in spans], pa.list_(pa.int32())),
                "ends": pa.array([[e for _, _, e in s] for s in spans], pa.list_(pa.int32())),
            })

    return map_batches(id_and_text(docs), run, SPAN_SCHEMA)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]", segment: int = 1000) -> DataFrame:
    """The documents with every secret replaced by ``mark`` (overlapping spans by one), and n_chars,
    where there is such a column, counted anew for the texts that changed. Nulls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in chain.from_iterable(slices(x, segment) for x in batches):
            texts, names = b.column("text").to_pylist(), b.schema.names
            sizes = b.column("n_chars").to_pylist() if "n_chars" in names else None
            for d, spans in enumerate(scanner.scan([t or "" for t in texts])):
                if spans:
                    out, at, text = [], 0, texts[d]
                    for start, _, end in spans:
                        if start >= at:
                            out += [text[at:start], mark]
                        at = max(at, end)
                    texts[d] = "".join([*out, text[at:]])
                    if sizes:
                        sizes[d] = len(texts[d])
            b = b.set_column(names.index("text"), b.schema.field("text"), pa.array(texts, b.schema.field("text").type))
            yield b.set_column(names.index("n_chars"), b.schema.field("n_chars"), pa.array(sizes, b.schema.field("n_chars").type)) if sizes else b

    named, back = plain_names(docs, ("text", "n_chars"))
    return back(map_batches(named, run, named.schema))


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES, segment: int = 1000) -> DataFrame:
    """Counts per base rule, the digest of the base spans, and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kinds = [r.kind for r in rules]
        for b in chain.from_iterable(slices(x, segment) for x in batches):
            spans = scanner.scan([t or "" for t in b.column("text").to_pylist()])
            said = lambda s, least: ",".join(f"{kinds[k]}:{a}:{e}" for a, k, e in s if k < least)
            yield pa.record_batch({
                "doc_id": b.column("doc_id"),
                **{f"n_{kind}": pa.array([sum(k == n for _, k, _ in s) for s in spans], pa.int64()) for n, kind in enumerate(kinds[:3])},
                "base_sha256": pa.array([hashlib.sha256(said(s, len(BASE)).encode()).hexdigest() for s in spans], pa.string()),
                "spans": pa.array([said(s, len(rules)) for s in spans], pa.string()),
            })

    return map_batches(id_and_text(docs), run, DIGEST_SCHEMA)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def _scan_sql() -> str:
    """The scan in SQL: matches of a rule and the text between them give the offsets. Letters of
    either case are spelled out, runs that are too short are left to the pattern where that is the
    same, and the character before a jwt is part of the match, as there is no look-behind."""
    either_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    written = {"assign": rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}", "jwt": next(r.pattern for r in RULES if r.kind == "jwt").replace("(?<![A-Za-z0-9_-])", "(^|[^A-Za-z0-9_-])")}
    found = []
    for place, r in enumerate(RULES):
        p = written.get(r.kind, r.pattern)
        skip = f"length(regexp_extract(m, '{p}', 1))" if r.kind == "jwt" else "0"
        least = f"WHERE length(regexp_extract(m, '{p}', {r.group})) >= {r.least}" if r.kind == "assign" else ""
        found.append(f"""SELECT doc_id, {place} AS place, '{r.kind}' AS kind, pos + {skip} AS start, pos + length(m) AS stop FROM (
    SELECT doc_id, m, sum(length(m) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS pos FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(gaps[1 : len(ms)]) AS gap, generate_subscripts(ms, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gaps FROM d))) {least}""")
    said = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) {where}, '')"
    counts = ", ".join(f"count(*) FILTER (place = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(found)})
SELECT doc_id, {counts}, sha256({said("FILTER (place < 3)")}) AS base_sha256, {said("FILTER (place >= 0)")} AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""


ORACLE_SQL = _scan_sql()
