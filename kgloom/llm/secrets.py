"""Operator 5: secret scans through a trigram inverted index.

Each rule's regex is parsed, and a Boolean query over trigrams that any match must hold is derived from it. Per
block of rows, postings (trigram to row numbers) are made for the trigrams that occur in some query, queries are
evaluated by intersecting and uniting postings, and only candidates are verified by the regex itself. A rule
whose query is empty (no mandatory trigram) scans every row.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as K  # the parse tree's names
from re import _parser as parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import map_rows, short_batches, unused
from kgloom.session import table

#: (kind, regex, group, least characters of that group). The first three are the base; the order is the order of ties.
RULES: list[tuple[str, str, int, int]] = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 24),
]
BASE = 3
#: Alternatives of exact strings kept for a part of a regex before it counts as unknown.
EXACT = 64

# A query is True (any text), ("tri", t), ("and", [..]) or ("or", [..]).


def _and(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _or(parts: list):
    return True if any(p is True for p in parts) or not parts else parts[0] if len(parts) == 1 else ("or", parts)


def _strings(exact: set[str]):
    """The query of a part that is one of these strings."""
    return _or([_and([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(exact)])


def _walk(tree) -> tuple[set[str] | None, object]:
    """(exact strings or None, query) of a sequence; runs of exact parts are joined before trigrams are taken."""
    run: set[str] | None = {""}
    found, whole = [], True
    for op, arg in tree:
        exact, query = _part(op, arg)
        if exact is not None and run is not None and len(exact) * len(run) <= EXACT:
            run = {a + b for a in run for b in exact}
            continue
        whole = False
        found.append(_strings(run or {""}))
        if exact is not None:
            run = exact
        else:
            found.append(query)
            run = {""}
    return (run, _strings(run)) if whole else (None, _and([*found, _strings(run or {""})]))


def _part(op, arg) -> tuple[set[str] | None, object]:
    if op is K.LITERAL:
        return {chr(arg).lower()}, True
    if op is K.IN:
        chars: set[str] = set()
        for kind, v in arg:
            if kind is K.LITERAL:
                chars.add(chr(v).lower())
            elif kind is K.RANGE and v[1] - v[0] < 8:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op is K.SUBPATTERN:
        return _walk(arg[3])
    if op is K.BRANCH:
        each = [_walk(x) for x in arg[1]]
        if all(e is not None for e, _ in each) and len(union := set().union(*[e for e, _ in each])) <= EXACT:
            return union, _strings(union)
        return None, _or([q for _, q in each])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        low, high, body = arg
        exact, query = _walk(body)
        if exact is not None and high == 1:
            return exact | {""} if low == 0 else exact, True
        if exact is not None and low == high and len(exact) == 1:
            return {next(iter(exact)) * low}, True
        return None, query if low else True
    if op is K.AT or op in (K.ASSERT, K.ASSERT_NOT):
        return {""}, True
    return None, True


def trigram_query(pattern: str):
    """Boolean trigram query (over lower-cased text) that holds wherever the regex matches; True: no mandatory trigram."""
    return _walk(parser.parse(pattern))[1]


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


def evaluate(query, postings: dict[str, set[int]], rows: range):
    """Candidate row numbers."""
    if query is True:
        return rows
    if query[0] == "tri":
        return postings[query[1]]
    each = [evaluate(q, postings, rows) for q in query[1]]
    if query[0] == "or":
        return set().union(*each)
    each.sort(key=len)
    return set(each[0]).intersection(*each[1:])


class Scanner:
    """Compiled rules with their queries and the index's trigrams."""

    def __init__(self, rules: list[tuple[str, str, int, int]] = RULES):
        self.rules = [(kind, re.compile(self.tight(p, group, least), re.ASCII), group, least, trigram_query(p)) for kind, p, group, least in rules]
        self.grams = sorted(set().union(*[trigrams(q) for *_, q in self.rules]))

    @staticmethod
    def tight(pattern: str, group: int, least: int) -> str:
        """A lone repeated class needs no match below its least length: a run's first match is the whole run."""
        return f"{pattern[:-1]}{{{least},}}" if group == 0 and re.fullmatch(r"\[[^\]]+\]\+", pattern) else pattern

    def block(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans as (start, rule, end), in code points, by start and then by rule."""
        low = [t.lower() if t.isascii() else "".join(c.lower() if c < "\x80" else c for c in t) for t in texts]
        postings = {g: {i for i, t in enumerate(low) if g in t} for g in self.grams}
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for r, (_, regex, group, least, query) in enumerate(self.rules):
            for i in evaluate(query, postings, range(len(texts))):
                for m in regex.finditer(texts[i]):
                    if m.end(group) - m.start(group) >= least:
                        out[i].append((m.start(), r, m.end()))
        return [sorted(x) for x in out]


def spans_text(spans: list[tuple[int, int, int]], rules=RULES) -> str:
    return ",".join(f"{rules[r][0]}:{a}:{b}" for a, r, b in spans)


_held: list[Scanner] = []


def held() -> Scanner:
    """The scanner of RULES, one per Python worker."""
    if not _held:
        _held.append(Scanner())
    return _held[0]


def scan(docs: DataFrame) -> DataFrame:
    """Counts, base digest and all spans of every whole text; no shuffle.

    Null and empty texts have no span and the digest of nothing. Spans are in the order of their start and, where several
    kinds start at one place, of RULES. Repeated rows are scanned each, an empty table gives no rows, a null doc_id stays
    null. Columns but doc_id and text are not read, so none can clash.
    """

    def make():
        scanner = held()

        def work(x: dict) -> dict:
            found = scanner.block([t or "" for t in x["text"]])
            return {
                "doc_id": x["doc_id"],
                **{f"n_{RULES[k][0]}": [sum(r == k for _, r, _ in s) for s in found] for k in range(BASE)},
                "base_sha256": [hashlib.sha256(spans_text([y for y in s if y[1] < BASE]).encode()).hexdigest() for s in found],
                "spans": [spans_text(s) for s in found],
            }

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], rules=RULES) -> str:
    """The text with each span, overlapping ones united, replaced by [kind]."""
    out, at = [], 0
    for a, r, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{rules[r][0]}]"]
        at = b
    return "".join(out) + text[at:]


def redact_column(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with secrets in the text column replaced, and n_chars set anew where a text changed. No row goes.

    Null stays null and empty stays empty; overlapping spans become one mark, of the kind that starts first. Repeated rows are
    cleaned each; all other columns stay as they are, whatever their names.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def clean(s):
        import pandas as pd

        scanner, out = held(), []
        texts = [None if t is None else str(t) for t in s]
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            out += [t if t is None or not x else redact(t, x) for t, x in zip(part, scanner.block([t or "" for t in part]))]
        return pd.Series(out, dtype=object)

    same, new = docs.columns, unused("clean", docs.columns)
    out = short_batches(docs).withColumn(new, clean(F.col(text)))
    if n_chars in same:
        out = out.withColumn(n_chars, F.when(F.col(new).eqNullSafe(F.col(text)), F.col(n_chars)).otherwise(F.length(new).cast(docs.schema[n_chars].dataType)))
    return out.withColumn(text, F.col(new)).select(*same)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of documents; odd cases are those of scan()."""
    return scan(table(spark, sf_dir, "documents"))
