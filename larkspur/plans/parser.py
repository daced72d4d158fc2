"""Text of the query language to relations: a lexer and a recursive-descent parser.

Precedence, loosest first: $ (right), ||, &&, not, comparisons and `is` and =~ (non-associative),
+ - <>, * /, application.
"""

from __future__ import annotations

import re

from .expr import AGGREGATES, Agg, Apply, Bin, Call, Exists, If, Is, Lambda, Let, Lit, Not, Path
from .model import CheckError
from .rel import Item, Join, Rel, Term, Use

_TOKEN = re.compile(r"""\s*(?:--[^\n]*\n?)?\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<id>[A-Za-z_]\w*)|(?P<op>><|->|:>|==|/=|<=|>=|=~|<>|&&|\|\||[-+*/<>(){},.|$=:`\\]))""")
_CLAUSES = {"where", "group", "order", "limit", "at"}


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of each token; the last is ("end", "", line)."""
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise CheckError(f"can't read {text[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup], text.count("\n", 0, m.start(m.lastgroup))))
        at = m.end()
        while at < len(text) and (text[at].isspace() or text.startswith("--", at)):
            at = at + 1 if text[at].isspace() else (text.find("\n", at) + 1 or len(text))
    return [*out, ("end", "", text.count("\n"))]


class _Parser:
    def __init__(self, text: str):
        self.toks, self.i = tokens(text), 0
        self.indent = [len(x) - len(x.lstrip()) for x in text.strip().split("\n")]
        self.by_line = False  # in a block of predicates, an argument is on its function's line

    def peek(self, *values: str) -> bool:
        return self.toks[self.i][1] in values and self.toks[self.i][0] != "str"

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v, _ = self.toks[self.i]
        if (value is not None and v != value) or (kind is not None and k != kind):
            raise CheckError(f"expected {value or kind}, found {v or 'the end'!r}")
        self.i += 1
        return v

    def accept(self, value: str) -> bool:
        if self.peek(value):
            self.i += 1
            return True
        return False

    def path(self) -> Path:
        parts = [self.take(kind="id")]
        while self.peek(".") and self.toks[self.i + 1][0] == "id":
            self.i += 1
            parts.append(self.take(kind="id"))
        return Path(tuple(parts))

    def string(self) -> str:
        return re.sub(r"\\(.)", r"\1", self.take(kind="str")[1:-1])

    # --- queries
    def query(self, bare: bool = False) -> Rel:
        """A query; a bare one, in boolean position, ends before what shapes a result."""
        if self.accept("("):
            rel = Rel(source=self.query())
            self.take(")")
        else:
            name = ".".join(self.path().parts)
            if self.peek("("):  # a query function of rows
                self.take("(")
                rel = Rel(source=Use(name, self.query()))
                self.take(")")
            elif self.toks[self.i][0] == "id" and self.toks[self.i][1] not in _CLAUSES | {"as", "via", "in"}:
                rel = Rel(source=Use(name, Rel(source=".".join(self.path().parts))))
            else:
                rel = Rel(source=name)
        while True:
            if self.accept("where"):
                rel = rel.where(self.expr())
            elif self.accept("><"):
                rel = rel._add(self.join())
            elif bare:
                return rel
            elif self.accept("group"):
                rel = rel.group(".".join(self.path().parts))
            elif self.accept("order"):
                self.take("by")
                rel = rel.order(*self.order())
            elif self.accept("limit"):
                rel = rel.limit(int(self.take(kind="num")))
            elif self.accept("at"):
                rel = rel.at(self.string())
            elif self.peek("{") and not self.record_follows():
                self.take("{")
                rel = rel.project(*self.items())
            elif self.peek("|") and self.union_follows():
                self.take("|")
                rel = rel | self.query()
            else:
                return rel

    def record_follows(self) -> bool:
        """A brace block of bindings: a row, not a projection."""
        return self.toks[self.i + 1][0] == "id" and self.toks[self.i + 2][1] == "=" and self.toks[self.i + 2][0] == "op"

    def union_follows(self) -> bool:
        return self.toks[self.i - 1][1] == "}"

    def record(self) -> dict[str, object]:
        out = {}
        self.take("{")
        while not self.accept("}"):
            name = self.take(kind="id")
            self.take("=")
            out[name] = self.expr()
            self.accept(",")
        return out

    def order(self) -> list[str]:
        out = []
        while True:
            p = ".".join(self.path().parts)
            out.append(f"-{p}" if self.accept("desc") else p)
            self.accept("asc")
            if not self.accept(","):
                return out

    def term(self) -> Term:
        if self.accept("("):
            inner = self.query()
            self.take(")")
            return Term(inner.source if isinstance(inner.source, str) else "", inner)
        return Term(".".join(self.path().parts))

    def join(self) -> Join:
        terms = [self.term()]
        while self.accept("|"):
            terms.append(self.term())
        via = self.take(kind="id") if self.accept("via") else None
        alias = self.take(kind="id") if self.accept("as") else None
        return Join(tuple(terms), via, alias)

    def items(self) -> list[Item]:
        out = []
        while not self.accept("}"):
            if self.accept("*"):
                out.append(Item("*"))
            elif self.toks[self.i][0] == "id" and self.toks[self.i + 1][1] == "." and self.toks[self.i + 2][1] == "*":
                out.append(Item(f"{self.take(kind='id')}.*"))
                self.i += 2
            else:
                e = self.expr()
                if self.toks[self.i][1] in AGGREGATES:
                    fn = self.take()
                    e = Agg(fn, e, float(self.take(kind="num")) if fn == "percentile" else None)
                name = self.take(kind="id") if self.accept("as") else None
                if name is None and not isinstance(e, Path):
                    raise CheckError("an expression in a projection needs a name: as <name>")
                out.append(Item(e, name))
            self.accept(",")
        return out

    # --- expressions
    def expr(self):
        if self.peek("self") and self.toks[self.i + 1][1] in ("><", "where"):
            return Exists(self.query(bare=True))
        left = self.either()
        if self.accept("$"):
            return self.apply(left, self.expr())
        return left

    @staticmethod
    def apply(f, x):
        if isinstance(f, Path):
            return Not(x) if f.parts == ("not",) else Call(f.name, (x,))
        if isinstance(f, Call):
            return Call(f.name, (*f.args, x))
        if isinstance(f, Lambda):
            return Apply(f, (x,))
        raise CheckError("$ needs a function on its left")

    def either(self):
        e = self.both()
        while self.accept("||"):
            e = Bin("||", e, self.both())
        return e

    def both(self):
        e = self.negation()
        while self.accept("&&"):
            e = Bin("&&", e, self.negation())
        return e

    def negation(self):
        if self.peek("not"):
            self.i += 1
            return Not(self.expr()) if self.accept("$") else Not(self.negation())
        return self.comparison()

    def comparison(self):
        e = self.sum()
        if self.accept("is"):
            negated = self.accept("not")
            if not isinstance(e, Path):
                raise CheckError("`is` tests a field")
            return Is(e, self.take(kind="id"), negated)
        for op in ("==", "/=", "<=", ">=", "<", ">", "=~"):
            if self.accept(op):
                return Bin(op, e, self.sum())
        return e

    def sum(self):
        e = self.product()
        while self.peek("+", "-", "<>"):
            op = self.take()
            e = Bin(op, e, self.product())
        return e

    def product(self):
        e = self.infix()
        while self.peek("*", "/"):
            op = self.take()
            e = Bin(op, e, self.infix())
        return e

    def infix(self):
        e = self.application()
        while self.accept("`"):
            name = ".".join(self.path().parts)
            self.take("`")
            e = Call(name, (e, self.application()))
        return e

    def lambda_(self) -> Lambda:
        self.take("\\")
        params = [self.take(kind="id")]
        while not self.accept("->"):
            params.append(self.take(kind="id"))
        return Lambda(tuple(params), self.expr())

    def application(self):
        if self.accept("if"):
            cond = self.expr()
            self.take("then")
            then = self.expr()
            self.take("else")
            return If(cond, then, self.expr())
        if self.accept("let"):
            name = self.take(kind="id")
            self.take("=")
            value = self.expr()
            self.take("in")
            return Let(name, value, self.expr())
        if self.peek("\\"):
            return self.lambda_()
        e = self.atom()
        if isinstance(e, Lambda):
            args = []
            while self.toks[self.i][0] in ("num", "str") or self.peek("(") or self.toks[self.i][0] == "id" and self._starts_argument():
                args.append(self.atom())
            return Apply(e, tuple(args)) if args else e
        if isinstance(e, Path) and len(e.parts) == 1:
            args = []
            while (self.toks[self.i][0] in ("num", "str") or self.peek("(") or self.toks[self.i][0] == "id") and self._starts_argument():
                args.append(self.atom())
            if args:
                return Call(e.name, tuple(args))
        return e

    def _starts_argument(self) -> bool:
        word = self.toks[self.i][1]
        if self.by_line and self.toks[self.i][2] != self.toks[self.i - 1][2]:
            return False
        return word not in (_CLAUSES | set(AGGREGATES) | {
            "as",
            "is",
            "then",
            "else",
            "via",
            "by",
            "asc",
            "desc",
            "not",
            "in",
            "let",
            "if",
            "emit",
            "unique",
            "indexed",
        })

    def atom(self):
        k, v, _ = self.toks[self.i]
        if k == "num":
            self.i += 1
            return Lit(float(v) if "." in v else int(v))
        if k == "str":
            return Lit(self.string())
        if self.accept("("):
            e = self.lambda_() if self.peek("\\") else self.expr()
            self.take(")")
            return e
        if self.accept("-"):
            e = self.atom()
            return Lit(-e.value) if isinstance(e, Lit) else Bin("-", Lit(0), e)
        if v in ("True", "False"):
            self.i += 1
            return Lit(v == "True")
        return self.path()


def parse(text: str) -> Rel:
    p = _Parser(text)
    rel = p.query()
    p.take("", "end")
    return rel


def parse_expr(text: str):
    p = _Parser(text)
    e = p.expr()
    p.take("", "end")
    return e
