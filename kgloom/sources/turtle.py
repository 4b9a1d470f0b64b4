"""Turtle files to triples. A file's prefixes hold for all of it, so that a file is read by one task; files are read in parallel."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<long>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*''')
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<node>_:[\w.-]*[\w-])
    |(?P<name>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_CHARS = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _CHARS.get(m[1], m[1]), text)


class Reader:
    """One document's triples as (s, p, o, kind, dtype, lang). ValueError where it is no Turtle."""

    def __init__(self, text: str, blank: str = "b"):
        self.text, self.blank, self.made = text, blank, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.out: list[tuple] = []
        self.tokens = self.scan()
        self.ahead: tuple[str, str] = next(self.tokens)

    def scan(self) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m:
                raise ValueError(f"not Turtle: {self.text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0]
        yield "end", ""

    def take(self, mark: str | None = None) -> tuple[str, str]:
        now = self.ahead
        if mark is not None and now != ("mark", mark):
            raise ValueError(f"{mark!r} is missing before {now[1]!r}")
        self.ahead = next(self.tokens, ("end", ""))
        return now

    def next_is(self, mark: str) -> bool:
        return self.ahead == ("mark", mark)

    def triples(self) -> list[tuple]:
        while self.ahead[0] != "end":
            kind, word = self.ahead
            if word.lower() in ("@prefix", "prefix") and kind in ("at", "word"):
                self.take()
                name = self.take()[1]
                self.prefixes[name[:-1]] = self.iri(self.take()[1])
            elif word.lower() in ("@base", "base") and kind in ("at", "word"):
                self.take()
                self.base = self.iri(self.take()[1])
            else:
                anonymous = self.next_is("[")
                subject = self.term()
                if not (anonymous and self.next_is(".")):
                    self.predicates(subject)
                self.take(".")
                continue
            if kind == "at":
                self.take(".")
        return self.out

    def iri(self, token: str) -> str:
        return urljoin(self.base, _plain(token[1:-1])) if self.base else _plain(token[1:-1])

    def fresh(self) -> tuple[str, str, None, None]:
        self.made += 1
        return f"_:{self.blank}.{self.made}", "bnode", None, None

    def predicates(self, subject: tuple) -> None:
        while True:
            p = (RDF + "type", "iri", None, None) if self.ahead == ("word", "a") and self.take() else self.term()
            while True:
                o = self.term()
                self.out.append((subject[0], p[0], *o))
                if not self.next_is(","):
                    break
                self.take()
            while self.next_is(";"):
                self.take()
                if self.ahead[1] in (".", "]", ";"):
                    continue
                break
            else:
                return
            if self.ahead[1] in (".", "]"):
                return

    def term(self) -> tuple:
        """(value, kind, dtype, lang)."""
        kind, t = self.take()
        if kind == "iri":
            return self.iri(t), "iri", None, None
        if kind == "name":
            prefix, _, local = t.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None, None
        if kind == "node":
            return f"_:{self.blank}-{t[2:]}", "bnode", None, None
        if kind in ("text", "long"):
            value = _plain(t[3:-3] if kind == "long" else t[1:-1])
            if self.ahead[0] == "at":
                return value, "literal", None, self.take()[1][1:]
            if self.ahead[0] == "type":
                self.take()
                return value, "literal", self.term()[0], None
            return value, "literal", None, None
        if kind == "number":
            return t, "literal", XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer"), None
        if kind == "word" and t in ("true", "false"):
            return t, "literal", XSD + "boolean", None
        if (kind, t) == ("mark", "["):
            node = self.fresh()
            if not self.next_is("]"):
                self.predicates(node)
            self.take("]")
            return node
        if (kind, t) == ("mark", "("):
            items = []
            while not self.next_is(")"):
                items.append(self.term())
            self.take()
            rest = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                node = self.fresh()
                self.out += [(node[0], RDF + "first", *item), (node[0], RDF + "rest", *rest)]
                rest = node
            return rest
        raise ValueError(f"unexpected {t!r}")


def turtle_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, kind, dtype, lang) of Turtle files. Blank nodes are told apart by file; a file that is no Turtle fails the read."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for text, mark in zip(batch.column("value"), batch.column("mark")):
                rows = Reader(text.as_py(), mark.as_py()).triples()
                for at in range(0, len(rows), 10_000):
                    columns = zip(*rows[at : at + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["s", "p", "o", "kind", "dtype", "lang"])

    files = spark.read.text(path, wholetext=True).select("value", F.substring(F.md5(F.input_file_name()), 1, 12).alias("mark"))
    return files.mapInArrow(run, "s string, p string, o string, kind string, dtype string, lang string")
