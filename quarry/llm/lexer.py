"""Name-literal pairs of source and configuration text: a lexer, small grammars, scopes and constants.

``lex`` cuts a text into names, strings, numbers, operators and line ends, in
one pass.  ``Reader`` walks the tokens and binds names to values: assignments
with or without a type, chains, comparisons, mapping entries, subscripts, named
arguments, call pairs, setters, shell flags, YAML blocks, here-documents; XML
elements and attributes have patterns of their own.  A value is a string,
several joined ones, a bare word, the name of another constant, which is looked
up from the scope outwards, or names and strings joined.  A quote that would
close right before a value, as an apostrophe of the words before it does, opens
none.  Every pass over the tokens is linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

NAME, STRING, OP, LINE, OTHER = "name", "string", "op", "line", "other"
TOKEN = re.compile(
    r"""(?P<name>[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+)
    |(?P<line>\n)
    |(?P<op>:=|=>|===?|!==?|<=|>=|->|::|\+=|\?\?=?|\|\|=?|&&|[:=+.,;(){}\[\]<>&|?!*/#\\@%^~\-])
    |(?P<other>[0-9][0-9A-Za-z_.]*+|[^\s"'`A-Za-z_$0-9:=+.,;(){}\[\]<>&|?!*/#\\@%^~\-]++)""",
    re.X | re.A,
)
BLANK = re.compile(r"[^\S\n]++")
SHORT = {q: re.compile(rf"{q}((?:[^{q}\\\n]++|\\(?s:.))*+){q}") for q in "\"'`"}
LONG = {q: re.compile(rf"{q * 3}((?:[^{q}\\]++|\\.|{q}(?!{q * 2}))*+){q * 3}", re.S) for q in "\"'"}
PREFIX = re.compile(r"[rRbBfFuU]{1,2}(?=[\"'])")
ESCAPE = re.compile(r"\\(.)", re.S)
BARE = re.compile(r"[^\s\"',;#]++")
IDENTIFIER = re.compile(r"[A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)*+", re.A)
PADDING = re.compile(r"={1,2}(?=[^\S\n]*(?:[\n,;)\]}]|\Z))")
INDENT = re.compile(r"[^\S\n]*")
HEREDOC = re.compile(r"""(?:\$\([^\S\n]*cat[^\S\n]*)?<<[<~\-]?[^\S\n]*(["']?)([A-Za-z_]\w*+)\1[^\n]*+\n""", re.A)
MARKER = re.compile(r"^[^\S\n]*+([A-Za-z_]\w*+)[^\S\n]*+[;,)\"]*+[^\S\n]*+$", re.A | re.M)
# Places of a literal that another value fills in.
FILLED = re.compile(r"\$\{([^{}]*)\}|\{\{([^{}]*)\}\}|\{([A-Za-z_][\w.]*)\}|\$([A-Za-z_]\w*)|%([A-Za-z_]\w*)%", re.A)
ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1>", re.A)
TAG = re.compile(r"<[A-Za-z_][\w.:\-]*+(\s[^<>]*+)>", re.A)
ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.\-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""", re.A)

# Operators that give or compare a value, that join strings, and words of the grammars.
BINDS = {"=", ":=", "=>", ":", "==", "===", "!=", "!==", "+=", "??=", "||="}
JOINS = {"+", ".", "&"}
DECLARES = {"var", "const", "let", "val", "dim"}
OPENS_BLOCK = {"def", "class"}
LOOKUPS = ("get", "env", "read", "load", "fetch", "find", "lookup", "input", "prompt", "ask")
SETTERS = ("set", "with", "put", "add")
KEYS, VALUES = {"key", "name", "id", "property"}, {"value", "val", "content"}
TYPES = {"str", "string", "String", "bytes", "Text", "text", "any", "Any", "object", "Object", "char", "AnyStr", "CharSequence"}
IN_TYPE = {"|", "&", "*", "?", "!", "->", "::", ".", "<", ">", "[", "]", "(", ")", "{", "}", ","}


@dataclass(slots=True)
class Token:
    kind: str
    start: int
    end: int
    text: str  # of a string: what is between its quotes
    inner: int = 0  # where that begins


@dataclass(slots=True)
class Literal:
    spans: list[tuple[int, int]]
    value: str
    quoted: bool


@dataclass(slots=True)
class Join:
    """A value of several parts, some of them names."""

    scope: int
    literals: list[Literal]
    refs: list[str]


@dataclass(slots=True)
class Binding:
    literals: list[Literal] = field(default_factory=list)
    refs: list[tuple[int, str]] = field(default_factory=list)  # scope and name of constants it takes
    joins: list[Join] = field(default_factory=list)


def closes_too_late(text: str, m: re.Match) -> bool:
    """Whether what closes a string stands where a value begins: after a name and its operator, before a letter or digit."""
    body = m[1].rstrip(" \t")
    if not body.endswith(("=", ":")) or not text[m.end() : m.end() + 1].isalnum():
        return False
    return body[:-1].rstrip(" \t")[-1:].isidentifier() or body[:-1].rstrip(" \t")[-1:].isdigit()


def lex(text: str) -> list[Token]:
    """Tokens in order.  A quote that closes nowhere (on its line, or at all for triple ones), or closes too late, is skipped."""
    out: list[Token] = []
    at, n = 0, len(text)
    dead = {q: 0 for q in ("\"", "'", "`", '"""', "'''")}  # up to where a quote is known not to close

    def string(at: int) -> int:
        q = text[at]
        if q in LONG and text.startswith(q * 3, at) and at >= dead[q * 3]:
            m = LONG[q].match(text, at)
            if m:
                out.append(Token(STRING, at, m.end(), m[1], m.start(1)))
                return m.end()
            dead[q * 3] = n
        if at >= dead[q] and not (q == "'" and at and text[at - 1].isalnum() and not (out and out[-1].kind == OTHER and out[-1].text == "prefix")):
            m = SHORT[q].match(text, at)
            if m and closes_too_late(text, m):
                return at + 1
            if m:
                out.append(Token(STRING, at, m.end(), m[1], m.start(1)))
                return m.end()
            end = text.find("\n", at)
            dead[q] = n if end < 0 else end
        return at + 1

    while at < n:
        c = text[at]
        if c in "\"'`":
            at = string(at)
            continue
        m = BLANK.match(text, at)
        if m:
            at = m.end()
            continue
        m = PREFIX.match(text, at)
        if m and not (at and text[at - 1].isalnum()):
            out.append(Token(OTHER, at, m.end(), "prefix"))
            before = len(out)
            at = string(m.end())
            if len(out) > before:
                del out[before - 1]
            continue
        m = TOKEN.match(text, at)
        if m is None:
            at += 1
            continue
        if m.lastgroup == "op" and c == "=" and at and text[at - 1].isalnum() and PADDING.match(text, at):
            at = PADDING.match(text, at).end()
            continue
        out.append(Token(m.lastgroup, at, m.end(), m[0]))
        at = m.end()
    return out


ANY = -1  # stands for all scopes of a name, so that they are listed once, not for each look-up


class Reader:
    """Bindings of a text by scope and name."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = lex(text)
        self.bindings: dict[tuple[int, str], Binding] = {}
        self.where: dict[str, dict[int, None]] = {}  # scopes in which a name is bound, in order
        self.parent = [0]
        self.passed = 0  # tokens before this one belong to a type
        self.markers: dict[str, list[tuple[int, int]]] | None = None  # lines of one name, which may end a here-document
        self.here = 0  # up to where here-documents have been read
        self._walk()
        self._markup()

    # -- bindings ------------------------------------------------------------

    def bind(self, scope: int, name: str, literals: list[Literal], refs: list[str], joined: bool = False) -> None:
        b = self.bindings.get((scope, name))
        if b is None:
            b = self.bindings[scope, name] = Binding()
            self.where.setdefault(name, {})[scope] = None
            last = name.rsplit(".", 1)[-1]
            if last != name:  # found by its last part too
                self.bindings.setdefault((scope, last), Binding()).refs.append((scope, name))
                self.where.setdefault(last, {})[scope] = None
        b.literals += literals
        b.refs += [(scope, r) for r in refs if r != name]
        if joined and refs:
            b.joins.append(Join(scope, literals, refs))

    def resolve(self, scope: int, name: str) -> list[tuple[int, str]]:
        """The bindings that a name stands for: of the nearest scope around, else of any, which are one step further."""
        for x in dict.fromkeys((name, name.rsplit(".", 1)[-1])):
            scopes = self.where.get(x)
            if not scopes:
                continue
            if len(scopes) > 1:
                at = scope
                while at not in scopes and at:
                    at = self.parent[at]
                return [(at if at in scopes else ANY, x)]
            return [(s, x) for s in scopes]
        return []

    def beyond(self, key: tuple[int, str]) -> list[tuple[int, str]]:
        """The bindings that a binding takes constants from."""
        if key[0] == ANY:
            return [(s, key[1]) for s in self.where[key[1]]]
        return [x for scope, name in self.bindings[key].refs for x in self.resolve(scope, name)]

    # -- grammar -------------------------------------------------------------

    def _op(self, i: int) -> str:
        return self.tokens[i].text if i < len(self.tokens) and self.tokens[i].kind == OP else ""

    def _kind(self, i: int) -> str:
        return self.tokens[i].kind if i < len(self.tokens) else ""

    def _typed(self, i: int) -> tuple[int, str] | None:
        """After a colon at i - 1: (place of the value, type if it is one name) where a type and ``=`` follow in the line."""
        depth, j, words, after_word = 0, i, 0, False
        while j < len(self.tokens):
            t = self.tokens[j]
            if t.kind == OP and t.text == "=" and depth == 0:
                only = self.tokens[i].text if j == i + 1 and t.start and self.tokens[i].kind == NAME else ""
                blank = t.start and self.text[t.start - 1] in " \t"
                quoted = self._kind(j + 1) == STRING
                # without a blank before it and a quote after it, it may belong to a word
                return (j + 1, only) if words and (blank or quoted) else None
            if t.kind == LINE:
                return None
            if t.kind in (NAME, STRING):
                if depth == 0 and after_word and self.tokens[j - 1].text not in ("mut", "const", "dyn", "static"):
                    return None
                words, after_word = words + 1, True
            elif t.kind == OP and t.text in IN_TYPE:
                depth += (t.text in "[({<") - (t.text in "])}>")
                if depth < 0 or (t.text == "," and depth == 0):
                    return None
                after_word = after_word and t.text in "[]"
            elif t.kind == OTHER and (t.text.isdigit() or depth):
                pass
            else:
                return None
            j += 1
        return None

    def _bare(self, i: int) -> tuple[list[Literal], list[str]]:
        """The bare word that begins at a token: up to a blank, quote, comma, or a bracket it does not open."""
        m = BARE.match(self.text, self.tokens[i].start)
        if not m:
            return [], []
        word, depth = m[0], 0
        if word[-1] in "([{" and self.text[m.end() : m.end() + 1] in ("'", '"'):
            return [], []  # code around a string
        if not set("()[]{}<").isdisjoint(word):
            for k, c in enumerate(word):
                depth += (c in "([{") - (c in ")]}")
                if depth < 0 or (c == "<" and word[k + 1 : k + 2] == "/"):
                    word = word[:k]
                    break
        if not word:
            return [], []
        literal = [Literal([(m.start(), m.start() + len(word))], word, False)]
        found = FILLED.search(word)
        refs = [next(filter(None, found.groups()))] if found and found[0] == word and any(found.groups()) else []
        if IDENTIFIER.fullmatch(word):
            refs = [word]
        return ([] if found and found[0] == word else literal), refs

    def _joined(self, i: int) -> tuple[list[Literal], list[str], int]:
        """Strings from token i on, adjacent or joined by an operator, and the names joined with them."""
        spans, parts, refs, j, nested = [], [], [], i, i > 0 and self._op(i - 1) == "("
        while j < len(self.tokens):
            t = self.tokens[j]
            if t.kind == STRING:
                spans.append((t.inner, t.inner + len(t.text)))
                body = ESCAPE.sub(r"\1", t.text) if "\\" in t.text else t.text
                for m in FILLED.finditer(body):
                    refs += [g.strip() for g in m.groups() if g]
                parts.append(FILLED.sub("", body))
            elif t.kind == NAME and (j > i or self._names(i)) and self._op(j + 1) not in BINDS:
                refs.append(t.text)
            else:
                break
            j += 1
            k = j
            if self._op(k) in JOINS:
                k += 1
                while self._kind(k) == LINE:
                    k += 1
            elif nested:
                while self._kind(k) == LINE:
                    k += 1
            elif self._kind(k) == LINE:
                m = k + 1
                if self._op(m) in JOINS and self._kind(m + 1) == STRING:  # an operator leads the next line
                    k = m + 1
                else:
                    break
            if k == j and self._kind(k) != STRING:
                break
            j = k
        value = "".join(parts)
        return ([Literal([s for s in spans if s[1] > s[0]], value, True)] if value else []), refs, j

    def _block(self, i: int, key: Token) -> list[Literal]:
        """The indented lines of a YAML block scalar whose mark is token i."""
        at = self.text.find("\n", self.tokens[i].start)
        if at < 0 or self.text[self.tokens[i].end : at].strip(" \t+-0123456789"):
            return []
        line = self.text.rfind("\n", 0, key.start) + 1
        margin = len(INDENT.match(self.text, line)[0])
        start, end = at + 1, at + 1
        while end < len(self.text):
            stop = self.text.find("\n", end)
            stop = len(self.text) if stop < 0 else stop
            body = self.text[end:stop]
            if body.strip() and len(INDENT.match(body)[0]) <= margin:
                break
            end = stop + 1
        raw = self.text[start:end].rstrip()
        lines = [x.strip() for x in raw.split("\n")]
        value = "".join(x for x in lines if not (x.startswith("-----") and x.endswith("-----")))
        lead = len(raw) - len(raw.lstrip())
        return [Literal([(start + lead, start + len(raw))], value, True)] if value else []

    def _names(self, i: int) -> bool:
        """Whether token i is a name that an operator joins with what follows."""
        return self._kind(i) == NAME and self._op(i + 1) in JOINS and self._kind(i + 2) in (NAME, STRING) and self._op(i + 3) not in BINDS

    def _heredoc(self, i: int) -> list[Literal] | None:
        """The lines of the here-document that token i opens, up to its marker; one inside another is a part of it."""
        m = HEREDOC.match(self.text, self.tokens[i].start)
        if not m or m.start() < self.here:
            return None
        if self.markers is None:
            self.markers = {}
            for line in MARKER.finditer(self.text):
                self.markers.setdefault(line[1], []).append((line.start(), line.end()))
        ends = self.markers.get(m[2], [])
        at = bisect_left(ends, (m.end(), 0))
        if at == len(ends):
            return None
        stop, self.here = ends[at]
        raw = self.text[m.end() : stop].rstrip()
        value = "".join(x for x in (x.strip() for x in raw.split("\n")) if not (x.startswith("-----") and x.endswith("-----")))
        lead = len(raw) - len(raw.lstrip())
        return [Literal([(m.end() + lead, m.end() + len(raw))], value, True)] if value else []

    def _value(self, i: int, key: Token, op: str) -> tuple[list[Literal], list[str]]:
        while self._op(i) in ("(", "&", "*") or (self._kind(i) == NAME and self.tokens[i].text in ("new", "await")):
            i += 1
        while self._kind(i) == LINE and i and self._op(i - 1) == "(":
            i += 1
        if i >= len(self.tokens) or self.tokens[i].kind == LINE:
            return [], []
        t = self.tokens[i]
        if t.kind == STRING or self._names(i):
            literals, refs, _ = self._joined(i)
            return literals, refs
        if (t.text in ("<", "$")) and (lines := self._heredoc(i)) is not None:
            return lines, []
        if t.kind == OP and t.text in ("|", ">") and op == ":":
            return self._block(i, key), []
        if t.kind == OP and t.text in ("{", "[", ",", ";", ")", "]", "}", "#"):
            return [], []
        if t.kind == NAME and self._op(i + 1) in BINDS and self.tokens[i + 1].text not in ("==", "===", "!=", "!=="):
            return [], [t.text]  # the next target of a chain
        if t.kind == NAME and self._op(i + 1) == "(" and self.tokens[i + 1].start == t.end:
            lookup = any(x in t.text.lower() for x in LOOKUPS)
            literals, refs, depth, j, nth = [], [], 0, i + 1, 0
            while j < len(self.tokens):
                x = self.tokens[j]
                if x.kind == OP and x.text in "([{":
                    depth += 1
                elif x.kind == OP and x.text in ")]}":
                    depth -= 1
                    if depth == 0:
                        break
                elif x.kind in (LINE, OP) and (x.kind == LINE or x.text in BINDS):
                    break
                elif x.kind == OP and x.text == "," and depth == 1:
                    nth += 1
                elif x.kind == STRING and depth == 1 and not (lookup and nth == 0):
                    more, names, j = self._joined(j)
                    literals += more
                    refs += names
                    continue
                j += 1
            return literals, refs
        return self._bare(i)

    def _walk(self) -> None:
        tokens, scope = self.tokens, 0
        braces: list[int] = []
        indents: list[tuple[int, int]] = []  # (margin, scope outside) of blocks that end by their margin
        fresh = True
        for i, t in enumerate(tokens):
            if t.kind == LINE:
                fresh = True
                continue
            if fresh:
                fresh = False
                line = self.text.rfind("\n", 0, t.start) + 1
                margin = t.start - line
                while indents and margin <= indents[-1][0] and not braces:
                    scope = indents.pop()[1]
                if t.kind == NAME and t.text in OPENS_BLOCK and self._kind(i + 1) == NAME:
                    indents.append((margin, scope))
                    self.parent.append(scope)
                    scope = len(self.parent) - 1
            if t.kind == OP:
                if t.text == "{":
                    braces.append(scope)
                    self.parent.append(scope)
                    scope = len(self.parent) - 1
                elif t.text == "}" and braces:
                    scope = braces.pop()
                continue
            if t.kind not in (NAME, STRING) or i < self.passed:
                continue
            if t.kind == NAME and self.text.startswith("--", t.start - 2) and t.start >= 2 and self._kind(i + 1) in (NAME, STRING, OTHER) and tokens[i + 1].start > t.end:
                literals, refs = self._value(i + 1, t, "")
                self.bind(scope, t.text, literals, refs)
                continue
            if t.kind == NAME and self._op(i + 1) == "(" and self._kind(i + 2) == STRING:
                self._call(scope, i)
                continue
            self._target(scope, i)

    def _call(self, scope: int, i: int) -> None:
        """``f("NAME", "literal")`` and ``setName("literal")``."""
        first = self.tokens[i + 2]
        if self._op(i + 3) == "," and self._kind(i + 4) == STRING and IDENTIFIER.fullmatch(first.text.replace("-", "_")):
            literals, refs, _ = self._joined(i + 4)
            self.bind(scope, first.text, literals, refs)
        elif self._op(i + 3) == ")" and self.tokens[i].text.rsplit(".", 1)[-1].lower().startswith(SETTERS):
            literals, refs, _ = self._joined(i + 2)
            self.bind(scope, self.tokens[i].text, literals, refs)

    def _target(self, scope: int, i: int) -> None:
        t, j = self.tokens[i], i + 1
        if self._op(j) == "]" and i and self._op(i - 1) == "[":
            j += 1
        op = self._op(j)
        if op == "=" and t.kind == NAME and i > 1 and self.tokens[i - 1].kind == NAME and self.tokens[i - 2].text in DECLARES:
            t = self.tokens[i - 1]  # a type stands after the name
        if op not in BINDS or (t.kind == STRING and not IDENTIFIER.fullmatch(re.sub(r"[\s\-/]", "_", t.text))):
            return
        j += 1
        names, target = [], t.text
        if op == ":" and (typed := self._typed(j)):
            j, only = typed
            self.passed = j
            if only and only not in TYPES and IDENTIFIER.fullmatch(only):
                names.append(only)
        literals, refs = self._value(j, t, op)
        joined = len(refs) > 1 or (bool(refs) and any(x.quoted for x in literals))
        for name in (target, *names):
            self.bind(scope, name, literals, refs, joined)

    def _markup(self) -> None:
        if "</" in self.text:
            for m in ELEMENT.finditer(self.text):
                body = m[2].strip()
                if body:
                    at = m.start(2) + m[2].index(body)
                    self.bind(0, m[1], [Literal([(at, at + len(body))], body, True)], [])
        if "<" in self.text and "=" in self.text:
            for m in TAG.finditer(self.text):
                key = value = None
                for a in ATTRIBUTE.finditer(m[1]):
                    group = 2 if a[2] is not None else 3
                    if a[1].lower() in KEYS and key is None:
                        key = a[group]
                    elif a[1].lower() in VALUES and a[group]:
                        value = (m.start(1) + a.start(group), m.start(1) + a.end(group), a[group])
                if key and value:
                    self.bind(0, key, [Literal([value[:2]], value[2], True)], [])
