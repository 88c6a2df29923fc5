"""Turtle and N-Triples files, split and parsed by the executors; Turtle texts of driver size."""

from __future__ import annotations

import contextlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import GraphError, SparqlError
from ..plans import ast as A
from ..plans.parser import ESCAPES, TOKEN, Parser, unescape
from ..plans.terms import term
from ..scratch import materialize
from .triples import SCHEMA, TripleStore

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


class _Turtle(Parser):
    """Turtle shares its terms with the query language; directives and collections are its own."""

    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = "", name: tuple[str, str] = ("", "")):
        """``name`` is put before the number of a blank node without a label, and behind any."""
        super().__init__(text, {} if prefixes is None else prefixes)
        self.base, self.name, self.out = base, name, []

    def iri(self, token: tuple[str, str]) -> A.Iri:
        kind, v = token
        if kind == "iri" and ":" not in v:
            return A.Iri(self.base + v[1:-1])
        return super().iri(token)

    def blank(self, label: str | None = None) -> A.Var:
        if label is None:
            return A.Var(f"g{self.name[0]}{next(self.fresh)}{self.name[1]}")
        return A.Var(f"l{label}{self.name[1]}")

    def document(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, v = self.peek()
            if (kind, v) in (("lang", "@prefix"), ("lang", "@base")) or kind == "word" and v.upper() in ("PREFIX", "BASE"):
                self.at += 1
                if "prefix" in v.lower():
                    name = self.kind("pname") or self.fail("a prefix")
                    self.prefixes[name[:-1]] = self.iri(("iri", self.kind("iri") or self.fail("an IRI"))).value
                else:
                    self.base = self.iri(("iri", self.kind("iri") or self.fail("an IRI"))).value
                if v.startswith("@"):
                    self.need(".")
                continue
            before = self.peek()
            s = self.node(self.out)
            if not (before[1] == "[" and self.is_(".")):
                self.predicates(s, self.out)
            self.need(".")
        return self.out

    def node(self, items: list):
        if self.take("["):
            v = self.blank()
            if not self.take("]"):
                self.predicates(v, items)
                self.need("]")
            return v
        if self.take("("):
            members = []
            while not self.take(")"):
                members.append(self.node(items))
            rest: object = A.Iri(RDF + "nil")
            for m in reversed(members):
                cell = self.blank()
                items += [A.Triple(cell, A.Iri(RDF + "first"), m), A.Triple(cell, A.Iri(RDF + "rest"), rest)]
                rest = cell
            return rest
        if self.peek()[0] == "bnode":
            return self.blank(self.kind("bnode")[2:])
        t = self.term()
        return self.fail("a term") if isinstance(t, A.Var) else t

    def path(self):
        return self.path_iri()


def parse_turtle(text: str) -> list[tuple]:
    """Rows (s, p, o) of the graph, terms as tuples (kind, lex, datatype, language), without repeats."""
    try:
        found = _Turtle(text).document()
    except SparqlError as e:
        raise GraphError(f"invalid Turtle: {str(e).removeprefix('invalid SPARQL: ')}") from e
    return list(dict.fromkeys((_row(t.s), t.p.value, _row(t.o)) for t in found))


def _row(x: A.Iri | A.Var | A.Lit) -> tuple:
    if isinstance(x, A.Iri):
        return (0, x.value, None, None)
    return (1, x.name, None, None) if isinstance(x, A.Var) else (2, x.lex, x.dt, x.lang)


_WS, _IRI, _PNAME = r"[ \t\r\n]*+", r'<([^<>"{}|^`\\\x00-\x20]*+)>', r"((?>(?:[^\W\d_][\w.-]*)?:(?:(?:\w|%[0-9A-Fa-f]{2})(?:[\w.:-]*[\w:-])?)?))"
_SUBJECT = re.compile(rf"{_WS}(?:{_IRI}|{_PNAME})")
_PREDICATE = re.compile(rf"{_WS}(?:{_IRI}|{_PNAME}|(a)(?=[ \t\r\n<]))")
_OBJECT = re.compile(
    rf"{_WS}(?:{_IRI}|{_PNAME}"
    r'|(?:"""((?:[^"\\]|\\.|"(?!""))*+)"""|"(?!"")((?:[^"\\\r\n]|\\.)*+)")'
    rf"(?:@([A-Za-z]++(?:-[A-Za-z0-9]++)*+)|\^\^(?:{_IRI}|{_PNAME}))?"
    rf"|(?:(-)|\+)?+((?>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+))){_WS}([;,.])",
    re.DOTALL,
)


def _flat(text: str, prefixes: dict[str, str], base: str) -> list[tuple] | None:
    """The rows of a statement of IRIs, names and plain literals, by one match a term; None for any other, which the parser reads."""

    def iri(full: str | None, name: str | None) -> str:
        if full is not None:
            return full if ":" in full else base + full
        prefix, _, local = name.partition(":")
        return prefixes[prefix] + local

    try:
        m = _SUBJECT.match(text)
        if m is None:
            return None
        s, out, after = (0, iri(*m.groups()), None, None), [], ";"
        while after != ".":
            if after == ";":
                if (m := _PREDICATE.match(text, m.end())) is None:
                    return None
                p = RDF + "type" if m[3] else iri(m[1], m[2])
            if (m := _OBJECT.match(text, m.end())) is None:
                return None
            full, name, long, short, lang, kind, kind_name, minus, number, after = m.groups()
            if full is not None or name is not None:
                o = (0, iri(full, name), None, None)
            elif number is not None:
                dt = "double" if "e" in number.lower() else "decimal" if "." in number else "integer"
                o = (2, (minus or "") + number, A.XSD + dt, None)
            else:
                lex = short if long is None else long
                lex = unescape(lex) if "\\" in lex else lex
                dt = RDF + "langString" if lang else A.XSD + "string" if kind is None and kind_name is None else iri(kind, kind_name)
                o = (2, lex, dt, lang and lang.lower())
            out.append((s, p, o))
    except (KeyError, SparqlError):  # the parser tells what is wrong
        return None
    return None if text[m.end() :].strip(" \t\r\n") else out


#: Tokens at which no statement ends, no bracket stands and no string of several lines begins.
_BORING = re.compile(
    r'(?:"""(?:[^"\\]|\\.|"(?!""))*+"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*+\'\'\'|(?!"""|\'\'\')(?>' + re.sub(r"\(\?P<\w+>", "(?:", TOKEN.pattern).replace(r"(?:\^\^", r"(?![.\[\]()])(?:\^\^") + r"|[^.\[\]()]))*+",
    re.VERBOSE | re.DOTALL,
)


class _Scan:
    """Where statements end. Between lines only a long string or open brackets can be unfinished; both are carried."""

    CLOSE = {
        '"': re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.DOTALL),
        "'": re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.DOTALL),
    }

    def __init__(self, quote: str = "", depth: int = 0):
        self.quote, self.depth = quote, depth

    def line(self, text: str) -> list[int]:
        """The places behind the dots that end a statement."""
        at, ends = 0, []
        while at < len(text):
            if self.quote:
                m = self.CLOSE[self.quote].match(text, at) if self.quote * 3 in text else None
                if m is None:
                    return ends
                self.quote, at = "", m.end()
                continue
            at = _BORING.match(text, at).end()
            here = text[at : at + 1]
            if here in ("[", "("):
                self.depth += 1
            elif here in ("]", ")"):
                self.depth -= 1
            elif here in self.CLOSE:  # begins here, ends in another line
                self.quote, at = here, at + 2
            elif here == "." and self.depth == 0:
                ends.append(at + 1)
            at += 1
        return ends


_HALF = "file string, block long, seq long, part string, text string"
_CHANGE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("before", pa.string()), ("after", pa.string()), ("depth", pa.int64())])
_TERM = pa.struct([("k", pa.int8()), ("lex", pa.string()), ("dt", pa.string()), ("lang", pa.string())])
_MARKS = "\"\"\"|'''|[\\[\\]()]"
_DIRECTIVE = r"(?i)^(?:\s++|#[^\n]*+(?:\n|$))*+(?:@prefix|@base|prefix|base)\b"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines of Spark's own splits of the files; a split's lines come in their order."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The lines of each split that a task reads."""
    def runs() -> Iterator[tuple[tuple[str, int], pa.Array]]:
        for b in batches:
            files, blocks = pc.dictionary_encode(b.column("file")), b.column("block").to_numpy()
            begins = np.flatnonzero(np.append(True, (np.diff(files.indices.to_numpy()) != 0) | (np.diff(blocks) != 0)))[: len(b)].tolist()
            for i, j in zip(begins, [*begins[1:], len(b)], strict=True):
                yield (files[i].as_py(), int(blocks[i])), b.column("value").slice(i, j - i)

    for key, own in groupby(runs(), key=lambda r: r[0]):
        yield key, chain.from_iterable(v.to_pylist() for _, v in own)


class _Open:
    """What is open (a long string's quote, the number of brackets) at the begin of a split; known for splits with such marks, told for others."""

    def __init__(self, changes: dict[tuple[str, int, str], tuple[str, int]]):
        self.marked = sorted({k[:2] for k in changes})
        self.before, self.after, last = {}, {}, None
        for at in self.marked:
            open_ = self.after[last] if last is not None and last[0] == at[0] else ("", 0)
            quote, depth = changes[(*at, open_[0])]
            self.before[at], self.after[at], last = open_, (quote, open_[1] + depth), at

    def at(self, file: str, block: int) -> tuple[str, int]:
        if (file, block) in self.before:
            return self.before[file, block]
        i = bisect_left(self.marked, (file, block)) - 1
        return self.after[self.marked[i]] if i >= 0 and self.marked[i][0] == file else ("", 0)


def _open_marks(lines: DataFrame) -> _Open:
    """Only lines with marks of long strings or brackets are looked at. A split says for each of three states at its begin what
    is open at its end; these few numbers a split go to the driver, of all splits at once (an iterator would read split after split)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), own in _by_split(batches):
            scans = {q: _Scan(q) for q in ("", '"', "'")}
            for text in own:
                for scan in scans.values():
                    scan.line(text)
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "before": q, "after": s.quote, "depth": s.depth} for q, s in scans.items()], schema=_CHANGE)

    marked = lines.where(F.rlike("value", F.lit(_MARKS))).mapInArrow(run, "file string, block long, before string, after string, depth long")
    return _Open({(r["file"], r["block"], r["before"]): (r["after"], r["depth"]) for r in marked.collect()})


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "seq", "part", "text"])


_READ = ["s", "p", "o", "at", "error"]


def _terms(terms: list[tuple]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*terms, strict=True), _TERM, strict=True)], fields=list(_TERM))


def statements(lines: DataFrame) -> DataFrame:
    """(file, block, seq, text): the statements of Turtle files, cut in parallel; ``seq`` counts within a split.

    A statement over several splits is put together from its pieces: the end of one split, whole splits, the begin of another.
    """
    held = lines.sparkSession.sparkContext.broadcast(_open_marks(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), own in _by_split(batches):
            scan, piece, seq, rows = _Scan(*held.value.at(file, block)), [], 0, []
            for text in own:
                at = 0
                for end in scan.line(text):
                    rows.append((file, block, seq, None if seq else "head", "\n".join([*piece, text[at:end]])))
                    piece, at, seq = [], end, seq + 1
                piece.append(text[at:])
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
            yield _batch([*rows, (file, block, seq, "tail" if seq else "all", "\n".join(piece))])

    cut = materialize(lines.mapInArrow(run, _HALF))
    pieces = cut.where("part IS NOT NULL")  # two a split
    so_far = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    begun = pieces.withColumn("begin", F.coalesce(F.sum(F.when(F.col("part") == "tail", 1)).over(so_far), F.lit(0)))
    in_order = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    joined = begun.groupBy("file", "begin").agg(F.min(F.struct("block", "seq")).alias("at"), F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("text"))
    return cut.where("part IS NULL").select("file", "block", "seq", "text").unionByName(joined.select("file", "at.block", "at.seq", "text"))


def _contexts(found: DataFrame) -> list[tuple[tuple, dict[str, str], str]]:
    """(place, prefixes, base) behind each statement that has a directive; the driver holds the directives."""
    out, prefixes, base, last = [], {}, "", None
    for r in sorted(found.where(F.rlike("text", F.lit(_DIRECTIVE))).collect()):
        prefixes, base = (dict(prefixes), base) if r["file"] == last else ({}, "")
        last = r["file"]
        with contextlib.suppress(SparqlError):  # told with its place when the statement is read
            t = _Turtle(r["text"], prefixes, base)
            t.document()
            base = t.base
        out.append(((r["file"], r["block"], r["seq"]), prefixes, base))
    return out


def load_graph(spark: SparkSession, path: str | Path) -> TripleStore:
    """Turtle files as a graph: cut into statements where Spark splits the files, and parsed by the executors.

    The driver holds the directives and a few numbers a split. Labels of blank nodes are those of their file. The first
    statement that is none is an error.
    """
    lines = _lines(spark, str(path))
    several = len(lines.inputFiles()) > 1
    found = statements(lines)
    held = spark.sparkContext.broadcast(_contexts(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [c[0] for c in held.value]
        for b in batches:
            s, p, o, at, error = [], [], [], [], []
            for place in zip(*(b.column(c).to_pylist() for c in ("file", "block", "seq", "text")), strict=True):
                i = bisect_left(places, place[:3]) - 1
                _, prefixes, base = held.value[i] if i >= 0 and places[i][0] == place[0] else (None, {}, "")
                if (rows := _flat(place[3], prefixes, base)) is None:
                    name = f"{place[1]}-{place[2]}-", f"-{zlib.crc32(place[0].encode()):x}" if several else ""
                    try:
                        rows = [(_row(t.s), t.p.value, _row(t.o)) for t in _Turtle(place[3], dict(prefixes), base, name).document()]
                    except SparqlError as e:
                        at.append(f"{place[0]} {place[1]:020d} {place[2]:020d}")
                        error.append(str(e).removeprefix("invalid SPARQL: "))
                        continue
                for subject, predicate, value in rows:
                    s.append(subject), p.append(predicate), o.append(value)
            none = pa.nulls(len(p), pa.string())
            if p:
                yield pa.RecordBatch.from_arrays([_terms(s), pa.array(p, pa.string()), _terms(o), none, none], _READ)
            if error:
                n = len(error)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, _TERM), pa.nulls(n, pa.string()), pa.nulls(n, _TERM), pa.array(at, pa.string()), pa.array(error, pa.string())], _READ)

    read = materialize(found.mapInArrow(run, f"{SCHEMA}, at string, error string").distinct())
    first = read.where("error IS NOT NULL").agg(F.min(F.struct("at", "error")).alias("e")).first()["e"]
    if first is not None:
        raise GraphError(f"invalid Turtle: {first['error']}")
    return TripleStore(read.select("s", "p", "o"))


def graph_of(spark: SparkSession, text: str) -> TripleStore:
    return TripleStore(spark.createDataFrame(parse_turtle(text), SCHEMA))


def unescaped(text: Column) -> Column:
    r"""``text`` with the escapes of N-Triples decoded, by columns: \t \b \n \r \f \" \' \\ and code points of four or eight digits."""
    plain = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def one(piece: Column) -> Column:
        number = F.lpad(F.upper(F.substring(piece, 3, 8)), 8, "0")
        point = F.when(number == "0000FEFF", "\ufeff").otherwise(F.decode(F.unhex(number), "UTF-32"))  # the decoder takes that one for a byte order mark
        known = F.coalesce(F.try_element_at(plain, F.substring(piece, 2, 1)), F.raise_error(F.concat(F.lit("unknown escape "), piece)))
        return F.when(~piece.startswith("\\"), piece).when(piece.rlike("^.[uU]."), point).otherwise(known)

    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def load_ntriples(spark: SparkSession, path: str) -> TripleStore:
    """N-Triples, read and parsed by the executors. A line that is no statement, comment or blank is an error."""
    lines = spark.read.text(path).where(~F.rlike("value", F.lit("^\\s*(#.*)?$")))
    iri = r"<((?:[^<>\"{}|^`\\\x00-\x20]++|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+)>"
    node = rf"{iri}|_:(\S+)"
    pattern = rf'^\s*(?:{node})\s+{iri}\s+(?:{iri}|_:(\S+)|"((?:[^"\\]++|\\.)*+)"(?:\^\^{iri}|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'
    g = lambda i: F.regexp_extract("value", pattern, i)
    some = lambda c: F.when(c != "", c)
    lang = F.lower(some(g(8)))
    dt = F.coalesce(unescaped(some(g(7))), F.when(lang.isNotNull(), F.lit(RDF + "langString")), F.lit(A.XSD + "string"))
    o = F.coalesce(term(0, unescaped(some(g(4)))), term(1, some(g(5))), term(2, unescaped(g(6)), dt, lang))
    subject = F.coalesce(term(0, unescaped(some(g(1)))), term(1, some(g(2))))
    good = F.when(F.rlike("value", F.lit(pattern)), subject).otherwise(F.raise_error(F.concat(F.lit("not an N-Triples statement: "), F.col("value"))))
    return TripleStore(lines.select(good.alias("s"), unescaped(g(3)).alias("p"), o.alias("o")).distinct())
