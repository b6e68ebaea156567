"""Lexer and expression parser shared by the query and the loop language.

The tree is plain tuples: (kind, ...). Parse errors raise ``SyntaxError`` with
the place.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"""\s*(?:(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<num>\d+\.\d+(?:[eE][-+]?\d+)?|\d+[lL]?)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<id>[A-Za-z_]\w*)|(?P<op><--|<-|=>|::|:=|\+=|\*=|&&=|\|\|=|==|!=|<=|>=|&&|\|\||\+\+|[-+*/%^&|!<>=(){}\[\],.:;@\#]))""", re.S)
REDUCE_WORDS = {"count", "avg", "min", "max"}
KEYWORDS = {"select", "distinct", "from", "where", "group", "by", "having", "order", "desc", "asc", "some", "all", "let", "in", "if", "else", "match", "case", "repeat", "step", "until", "limit", "union", "intersect", "minus", "member", "for", "do", "while", "var", "true", "false"}
_LEVELS = [{"union", "minus", "intersect", "member", "++"}, {"||"}, {"&&"}, {"==", "!=", "="}, {"<", "<=", ">", ">="}, {"|", "^", "&"}, {"+", "-"}, {"*", "/", "%"}]


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"unexpected {text[at : at + 20]!r} at {at}")
        at = m.end()
        if m.lastgroup != "comment":
            out.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
    return [*out, ("end", "", len(text))]


class Parser:
    def __init__(self, text: str, monoids: set[str] = frozenset(), operators: dict[str, int] | None = None):
        self.text, self.toks, self.i = text, tokens(text), 0
        self.monoids = REDUCE_WORDS | set(monoids)
        self.levels = [set(s) for s in _LEVELS]
        for op, level in (operators or {}).items():
            self.levels[level].add(op)

    # ---- tokens
    @property
    def tok(self) -> str:
        return self.toks[self.i][1] if self.toks[self.i][0] != "str" else "\0"

    def peek(self, k: int = 1) -> str:
        return self.toks[min(self.i + k, len(self.toks) - 1)][1]

    def kind(self) -> str:
        return self.toks[self.i][0]

    def take(self, *want: str) -> str:
        kind, value, at = self.toks[self.i]
        if want and (value not in want or kind == "str"):
            raise SyntaxError(f"expected {' or '.join(want)} but found {value or 'the end'!r} at {at}: ...{self.text[max(0, at - 20) : at + 20]}...")
        self.i += 1
        return value

    def maybe(self, *want: str) -> str | None:
        return self.take() if self.tok in want and self.kind() != "str" else None

    def name(self) -> str:
        if self.kind() != "id" or self.tok in KEYWORDS:
            raise SyntaxError(f"expected a name but found {self.tok!r} at {self.toks[self.i][2]}")
        return self.take()

    def many(self, item, end: str | None = None, sep: str = ",") -> list:
        out = []
        if end and self.tok == end:
            return out
        while True:
            out.append(item())
            if not self.maybe(sep):
                return out

    # ---- patterns
    def pattern(self):
        p = self.simple_pattern()
        if self.maybe("::"):
            return ("cons", p, self.pattern())
        return p

    def simple_pattern(self):
        if self.maybe("("):
            ps = self.many(self.pattern)
            self.take(")")
            return ps[0] if len(ps) == 1 else ("tuple", ps)
        if self.kind() in ("num", "str") or self.tok in ("true", "false", "-"):
            return ("lit", self.literal())
        n = self.name()
        if n == "_":
            return ("any",)
        if self.maybe("@"):
            if self.tok == "_" and self.peek() == "*":
                self.take()
                self.take()
                return ("rest", n)
            return ("as", n, self.pattern())
        if self.maybe("("):
            ps = self.many(self.pattern, ")")
            self.take(")")
            return ("list", ps) if n == "List" else ("tuple", ps)
        return ("var", n)

    def literal(self):
        if self.maybe("-"):
            return -self.literal()
        kind, v = self.kind(), self.take()
        if kind == "num":
            return float(v) if "." in v else int(v.rstrip("lL"))
        if kind == "str":
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), v[1:-1])
        return v == "true"

    # ---- expressions
    def expr(self):
        t = self.tok
        if self.kind() == "str":
            return self.binary(0)
        if t == "select":
            return self.select()
        if t in ("some", "all"):
            self.take()
            quals = self.many(self.qualifier)
            self.take(":")
            return (t, quals, self.expr())
        if t == "let":
            self.take()
            binds = self.many(lambda: (self.pattern(), self.take("="), self.expr())[::2])
            self.take("in")
            return ("let", binds, self.expr())
        if t == "if":
            self.take()
            self.take("(")
            c = self.expr()
            self.take(")")
            a = self.expr()
            self.take("else")
            return ("if", c, a, self.expr())
        if t == "repeat":
            self.take()
            p = self.pattern()
            self.take("=")
            init = self.expr()
            self.take("step")
            step, until, limit = self.expr(), None, None
            if self.maybe("until"):
                until = self.expr()
            if self.maybe("limit"):
                limit = self.expr()
            if until is None and limit is None:
                raise SyntaxError("repeat needs until or limit")
            return ("repeat", p, init, step, until, limit)
        return self.binary(0)

    def qualifier(self):
        at = self.i
        try:
            p = self.pattern()
            op = self.maybe("<-", "<--", "=")
        except SyntaxError:
            op = None
        if op is None:
            self.i = at
            return ("cond", self.expr())
        e = self.expr()
        return ("bind", p, e) if op == "=" else ("gen", p, e, op == "<--")

    def select(self):
        self.take("select")
        distinct = bool(self.maybe("distinct"))
        head = self.expr()
        self.take("from")
        quals = self.many(self.qualifier)
        where = self.expr() if self.maybe("where") else None
        group = second = having = order = None
        if self.maybe("group"):
            self.take("by")
            group = self.group_key()
            if self.maybe("from"):
                q2 = self.many(self.qualifier)
                w2 = self.expr() if self.maybe("where") else None
                self.take("group")
                self.take("by")
                second = (q2, w2, self.group_key())
            if self.maybe("having"):
                having = self.expr()
        if self.maybe("order"):
            self.take("by")
            order = self.order()
        return ("select", distinct, head, quals, where, group, second, having, order)

    def group_key(self):
        p = self.pattern()
        return (p, self.expr() if self.maybe(":") else None)

    def order(self):
        def key():
            e = self.binary(0)
            return (e, self.maybe("desc", "asc") == "desc")

        if self.tok == "(":
            at = self.i
            try:
                self.take("(")
                keys = self.many(key)
                self.take(")")
                if self.tok in ("", ";", ")", ","):
                    return keys
            except SyntaxError:
                pass
            self.i = at
        return [key()]

    def binary(self, level: int):
        if level == len(self.levels):
            return self.cons()
        left = self.binary(level + 1)
        while self.kind() in ("op", "id") and self.tok in self.levels[level]:
            op = self.take()
            right = self.expr() if self.tok in ("select", "some", "all", "if", "let") else self.binary(level + 1)
            left = ("op", "==" if op == "=" else op, left, right)
        return left

    def cons(self):
        left = self.unary()
        if self.maybe("::"):
            return ("op", "::", left, self.cons())
        return left

    def unary(self):
        t = self.tok
        if self.kind() != "str":
            if t in ("-", "!"):
                self.take()
                return ("neg" if t == "-" else "not", self.unary())
            if (t in ("+", "*", "&&", "||", "++") or t in self.monoids) and self.peek() == "/":
                self.take()
                self.take("/")
                return ("reduce", t, self.unary())
        return self.postfix(self.atom())

    def postfix(self, e):
        while True:
            if self.kind() == "str":
                return e
            if self.tok == ".":
                self.take()
                n = self.take()
                if self.maybe("("):
                    args = self.many(self.argument, ")")
                    self.take(")")
                    e = ("method", e, n, args)
                elif self.tok == "{" and self.peek() == "case":
                    e = ("method", e, n, [("lambda", ["_case"], ("match", ("var", "_case"), self.arms()))])
                else:
                    e = ("field", e, n)
            elif self.tok == "#":
                self.take()
                e = ("field", e, f"_{int(self.take())}")
            elif self.tok == "[":
                self.take()
                index = self.many(self.expr)
                self.take("]")
                e = ("index", e, index)
            elif self.tok == "match":
                self.take()
                e = ("match", e, self.arms())
            else:
                return e

    def argument(self):
        if self.kind() == "id" and self.peek() == "=>":
            n = self.name()
            self.take("=>")
            return ("lambda", [n], self.expr())
        e = self.expr()
        names = [f"_{i}" for i in range(count_holes(e))]  # _ + 1, _ + _: each is a parameter of its own
        return ("lambda", names, fill_holes(e, iter(names))) if names else e

    def arms(self):
        self.take("{")
        arms = []
        while self.maybe("case"):
            p = self.pattern()
            guard = self.expr() if self.maybe("by") else None
            self.take("=>")
            arms.append((p, guard, self.expr()))
        self.take("}")
        return arms

    def atom(self):
        if self.kind() in ("num", "str") or self.tok in ("true", "false"):
            return ("lit", self.literal())
        if self.maybe("("):
            es = self.many(self.expr, ")")
            self.take(")")
            return es[0] if len(es) == 1 else ("tuple", es)
        if self.maybe("<"):  # a record <a = e, ...>
            fields = self.many(lambda: (self.name(), self.take("="), self.binary(5))[::2])
            self.take(">")
            return ("record", fields)
        n = self.name()
        if self.maybe("("):
            args = self.many(self.argument, ")")
            self.take(")")
            return ("list", args) if n == "List" else ("call", n, args)
        return ("var", n)


def count_holes(e) -> int:
    """Placeholders of an expression that belong to no lambda inside it."""
    if isinstance(e, list):
        return sum(map(count_holes, e))
    if not isinstance(e, tuple) or not e or e[0] in ("lambda", "select", "match", "some", "all"):
        return 0
    return 1 if e == ("var", "_") else sum(map(count_holes, e[1:] if isinstance(e[0], str) else e))


def fill_holes(e, names):
    if isinstance(e, list):
        return [fill_holes(x, names) for x in e]
    if not isinstance(e, tuple) or not e or e[0] in ("lambda", "select", "match", "some", "all"):
        return e
    return ("var", next(names)) if e == ("var", "_") else tuple(fill_holes(x, names) for x in e)


def free(e, bound: frozenset = frozenset()) -> set[str]:
    """Free variables of an expression."""
    kind = e[0]
    if kind == "var":
        return set() if e[1] in bound else {e[1]}
    if kind == "lit":
        return set()
    if kind in ("some", "all"):
        out, inner = _quals(e[1], bound)
        return out | free(e[2], inner)
    if kind == "select":
        _, _, head, quals, where, group, second, having, order = e
        out, inner = _quals(quals, bound)
        out |= free(where, inner) if where else set()
        if group:
            out |= free(group[1], inner) if group[1] else set()
            inner |= pattern_vars(group[0])
        if second:
            more, other = _quals(second[0], bound)
            out |= more | (free(second[1], other) if second[1] else set()) | (free(second[2][1], other) if second[2][1] else set())
            inner |= other | pattern_vars(second[2][0])
        for x in (head, having, *[o[0] for o in order or []]):
            out |= free(x, inner) if x else set()
        return out
    if kind == "let":
        out = set()
        for p, x in e[1]:
            out |= free(x, bound)
            bound |= pattern_vars(p)
        return out | free(e[2], bound)
    if kind == "lambda":
        return free(e[2], bound | set(e[1]))
    if kind == "match":
        out = free(e[1], bound)
        for p, g, x in e[2]:
            inner = bound | pattern_vars(p)
            out |= (free(g, inner) if g else set()) | free(x, inner)
        return out
    if kind == "record":
        return set().union(*[free(x, bound) for _, x in e[1]])
    out = set()
    for x in e[1:]:
        if isinstance(x, tuple) and x and isinstance(x[0], str):
            out |= free(x, bound)
        elif isinstance(x, list):
            for y in x:
                out |= free(y, bound)
    return out


def _quals(quals, bound: frozenset) -> tuple[set[str], frozenset]:
    out = set()
    for q in quals:
        if q[0] == "cond":
            out |= free(q[1], bound)
        else:
            out |= free(q[2], bound)
            bound |= pattern_vars(q[1])
    return out, bound


def pattern_vars(p) -> frozenset:
    kind = p[0]
    if kind in ("var", "rest"):
        return frozenset([p[1]])
    if kind == "as":
        return frozenset([p[1]]) | pattern_vars(p[2])
    if kind in ("tuple", "list"):
        return frozenset().union(*map(pattern_vars, p[1]))
    if kind == "cons":
        return pattern_vars(p[1]) | pattern_vars(p[2])
    return frozenset()
