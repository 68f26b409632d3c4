"""Secret scans: fixed patterns, and assignments lexed with constants followed."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexer import Join, Reader
from .staging import NO_ID, from_key, table
from .vectext import tidy

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "lexed")

# Words of sensitive target names, with weights.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "apikey": 3, "credential": 3, "credentials": 3,
    "token": 2, "private": 2, "auth": 2, "bearer": 2, "access": 1, "key": 1, "signing": 1, "encryption": 1,
}
# Literals that stand for a secret without being one.
PLACEHOLDERS = {"", "none", "null", "true", "false", "changeme", "change_me", "example", "your_password", "placeholder", "todo", "xxx"}

# Names whose quoted literals may hold blanks.
PHRASES = {"password", "passwd", "pwd", "passphrase"}

# Last words of names that say something about a secret and hold none.
ABOUT = {"hint", "label", "prompt", "help", "message", "placeholder", "title", "description", "column", "type", "policy", "header", "prefix"}

# No name without one of these has a weight.
HINT = re.compile("pass|pwd|secret|api|credential|token|private|auth|bearer|access|key|signing|encryption", re.I)
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# Lower-case words in a row, as of a slug, are no secret except under a phrase's name.
PLAIN = re.compile(r"[a-z]+(?:[-_./][a-z]+){2,}+")
MIN_SCORE, MIN_LITERAL = 4.0, 8
MAX_LITERAL_WEIGHT = 3.0


def name_weight(name: str) -> float:
    """How sensitive a target is by the words of its name, written in any case style."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    if words and words[-1] in ABOUT:
        return 0
    joined = [a + b for a, b in zip(words, words[1:])]  # api_key, pass_word
    return max((SENSITIVE.get(w, 0) for w in words + joined), default=0) + 0.5 * (sum(w in SENSITIVE for w in words) > 1)


@dataclass(slots=True)
class Shape:
    """What the weight of a literal depends on; shapes of parts add up to that of the whole, whose words may be phrases."""

    size: int = 0
    counts: Counter = field(default_factory=Counter)
    stops: bool = False  # it stands for a secret, or is plain words

    def __iadd__(self, other: Shape) -> Shape:
        self.stops = other.stops and (self.stops or not self.size)
        self.size += other.size
        self.counts.update(other.counts)
        return self


def shape(text: str) -> Shape:
    return Shape(len(text), Counter(text), text.lower() in PLACEHOLDERS if len(text) < 20 else bool(PLAIN.fullmatch(text)))


def shape_weight(x: Shape, blanks: bool = False) -> float:
    """How much a literal looks like a secret: its length, mix and entropy."""
    if x.size < MIN_LITERAL or len(x.counts) < 4 or (x.stops and not blanks) or (not blanks and any(c.isspace() for c in x.counts)):
        return -10.0
    entropy = -sum(c / x.size * math.log2(c / x.size) for c in x.counts.values())
    present = "".join(x.counts)
    kinds = sum(bool(re.search(p, present)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return (entropy >= 2.8) + (x.size >= 16) + 0.5 * (kinds >= 2) + 0.5 * (kinds >= 3)


def literal_weight(text: str, blanks: bool = False) -> float:
    if text.lower() in PLACEHOLDERS:
        return -10.0
    return shape_weight(shape(text), blanks)


def wholes(read: Reader, keys: list[tuple[int, str]]) -> dict[tuple[int, str], Shape]:
    """Shapes of the values of constants and of all they are made of: the first join, else the first literal, else the first constant.

    A constant that is made of itself adds nothing where it comes again.
    """
    done: dict[tuple[int, str], Shape] = {}
    begun: set[tuple[int, str]] = set()
    todo = list(keys)
    while todo:
        key = todo[-1]
        if key in done:
            todo.pop()
            continue
        b = read.bindings.get(key)
        if b and b.joins:
            own, below = b.joins[0].literals, parts(read, b.joins[0])
        else:
            own = [x for x in b.literals if x.quoted or x.value not in read.where][:1] if b else []
            below = [] if own else read.beyond(key)[:1]
        if key not in begun:
            begun.add(key)
            rest = [x for x in below if x not in begun]
            if rest:
                todo += rest
                continue
        total = Shape()
        for literal in own:
            total += shape(literal.value)
        for x in below:
            total += done.get(x, Shape())
        done[key] = total
        todo.pop()
    return done


def parts(read: Reader, join: Join) -> list[tuple[int, str]]:
    """The constants that a join takes, one for each of its names that is bound."""
    return [x for name in join.refs for x in read.resolve(join.scope, name)[:1]]


def phrase_name(name: str) -> bool:
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    return not PHRASES.isdisjoint(words + [a + b for a, b in zip(words, words[1:])])


def lexed(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name.

    Name-literal pairs come from ``lexer.Reader``.  A value that names a
    constant passes its target's name on to the literals of that constant, in
    the nearest scope around it, through any number of steps.  The parts of a
    joined literal are judged as one and reported each, names among them too.
    """
    if not HINT.search(text):
        return []
    read = Reader(text)
    own = {key: name_weight(key[1]) for key in read.bindings}
    weights: dict[tuple[int, str], float] = {}
    phrases: set[tuple[int, str]] = set()
    for start in sorted(own, key=own.__getitem__, reverse=True):
        if not own[start] or own[start] + MAX_LITERAL_WEIGHT < MIN_SCORE:
            break
        todo = [start]
        while todo:
            key = todo.pop()
            if key not in weights:
                weights[key] = own[start]
                todo += read.beyond(key)
    todo = [key for key in weights if phrase_name(key[1])]
    while todo:
        key = todo.pop()
        if key not in phrases:
            phrases.add(key)
            todo += read.beyond(key)
    found: dict[tuple[int, int], float] = {}
    for key, weight in weights.items():
        for literal in read.bindings[key].literals if key in read.bindings else ():
            if not literal.quoted and literal.value in read.where:  # a constant's name; its literal is judged instead
                continue
            score = weight + literal_weight(literal.value, literal.quoted and key in phrases)
            if score >= MIN_SCORE:
                for span in literal.spans:
                    found[span] = max(score, found.get(span, score))
    joins = [(key, join) for key in weights if key in read.bindings for join in read.bindings[key].joins]
    whole = wholes(read, [x for _, join in joins for x in parts(read, join)]) if joins else {}
    judged = []
    for key, join in joins:
        total = Shape()
        for literal in join.literals:
            total += shape(literal.value)
        for x in parts(read, join):
            total += whole[x]
        score = weights[key] + shape_weight(total, key in phrases)
        if score >= MIN_SCORE:
            judged.append((score, join))
    told: set[tuple[int, str]] = set()
    for score, join in sorted(judged, key=lambda x: -x[0]):
        literals, todo = list(join.literals), parts(read, join)
        while todo:
            key = todo.pop()
            if key not in told:
                told.add(key)
                todo += read.beyond(key)
                literals += read.bindings[key].literals if key in read.bindings else ()
        for literal in literals:
            for span in literal.spans if literal.quoted else ():
                found[span] = max(score, found.get(span, score))
    return [(a, b, s) for (a, b), s in found.items()]


def scan(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans, by start, then kind."""
    spans = []
    if "=" in text or ":" in text:
        spans += [("assign", m.start(), m.end(), 10.0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), 10.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [("hex", m.start(), m.end(), 5.0) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        base = sorted((a, b) for _, a, b, _ in spans)
        starts = [a for a, _ in base]
        reach = list(accumulate((b for _, b in base), max))  # the farthest end of the spans up to each
        within = lambda a, b: (i := bisect_right(starts, a)) > 0 and reach[i - 1] >= b
        spans += [("lexed", a, b, s) for a, b, s in lexed(text) if not within(a, b)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are one."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scan_batches(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            texts = [x or "" for x in part.column("text").to_pylist()]
            spans = [scan(x) for x in texts]
            rows = [[{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in x] for x in spans]
            redacted = [redact(t, s) if s else None for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(rows, _SPANS), pa.array(redacted, pa.string())], ["k", "spans", "redacted"])


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, score) and redacted.

    ``redacted`` is the text with its spans replaced, null where there is none.
    One row per input row; a null or empty text has no span; repeated rows are
    scanned each; other columns are ignored; an empty table gives an empty
    result.  No shuffle and no state: a task holds a few hundred texts.  A very
    long text is scanned whole, in time linear in its length.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), "text")
    schema = "k bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>, redacted string"
    return keyed.mapInArrow(tidy(_scan_batches), schema).select(from_key().alias("doc_id"), "spans", "redacted")


def _redact_batches(column: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(column).to_pylist()
            out = [x and redact(x, scan(x)) for x in texts]
            arrays = batch.columns
            arrays[column] = pa.array(out, batch.schema.field(column).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return run


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``secret_scan`` replaced in text, other columns as they are."""
    return docs.mapInArrow(tidy(_redact_batches(docs.columns.index("text"))), docs.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "lexed")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
