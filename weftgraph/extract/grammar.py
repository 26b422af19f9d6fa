"""Recursive-descent acceptors over the lexers' tokens: does a Java 17, JavaScript or TypeScript file parse?

They follow the published grammars as far as acceptance needs: no tree is built and precedence is ignored, since
any sequence of operands and binary operators parses under some precedence. Alternatives that begin alike (casts,
lambdas, generic calls, declarations) are tried in turn from a remembered position.
"""

from __future__ import annotations

from typing import NamedTuple

from weftgraph.extract.lexers import Bad, Tokens

JS_RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
JS_BINARY = frozenset("+ - * / % ** & | ^ && || ?? == != === !== < <= <<".split())
JS_ASSIGN = frozenset("= += -= *= /= %= **= &= |= ^= <<= &&= ||= ??=".split())
TS_MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor".split())
JAVA_RESERVED = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split())
JAVA_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
JAVA_PRIMITIVES = frozenset("boolean byte short int long char float double".split())
JAVA_BINARY = frozenset("+ - * / % & | ^ && || == != < <= <<".split())
JAVA_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())


class Function(NamedTuple):
    """A function or method, by tokens: its name, the first of its declaration, its body's braces (-1 without; a body that's an expression has no first, and its last token)."""

    name: int
    start: int
    open: int
    close: int
    owner: str | None


class Type(NamedTuple):
    """A declared type, by tokens: kind, name, first token of its declaration, its body's braces, bases."""

    kind: str
    name: int
    start: int
    open: int
    close: int
    owner: str | None
    extends: list[str]
    implements: list[str]


class _Base:
    """What was declared: ``found`` functions, ``classes`` (name, base names), ``declared`` types, ``fields`` (name, first token, owner)."""

    def __init__(self, tokens: Tokens) -> None:
        self.k, self.t, self.at, self.nl, self.match, _ = tokens
        self.i = 0
        self.found: list[Function] = []
        self.classes: list[tuple[str, list[str]]] = []
        self.owners: list[str] = []
        self.declared: list[Type] = []
        self.fields: list[tuple[int, int, str | None]] = []

    def note(self, name: int, start: int, body: int) -> None:
        """A function whose body, if it has one, opens at token ``body``."""
        close = self.match.get(body, -1) if body >= 0 and self.t[body] == "{" else -1
        self.found.append(Function(name, start, body if close >= 0 else -1, close, self.owners[-1] if self.owners else None))

    def typed_as(self, kind: str, name: int, start: int, head: int) -> None:
        """A type whose bases stand between token ``head`` and the body that opens at the current token."""
        split = next((i for i in range(head, self.i) if self.t[i] == "implements"), self.i)
        owner = self.owners[-1] if self.owners else None
        self.declared.append(Type(kind, name, start, self.i, self.match.get(self.i, -1), owner, self.names_between(head, split), self.names_between(split, self.i)))

    def names_between(self, a: int, b: int) -> list[str]:
        """The last segment of each type name between two tokens, without type arguments."""
        out, depth, i = [], 0, a
        while i < b:
            t = self.t[i]
            depth += (t == "<") - (t == ">")
            if not depth and self.k[i] == "id" and t not in ("extends", "implements", "permits") and self.t[i + 1] != ".":
                out.append(t)
            i += 1
        return out

    def bad(self) -> None:
        raise Bad("premature end" if self.k[self.i] == "end" else "unexpected token", self.at[self.i])

    def eat(self, text: str) -> bool:
        if self.t[self.i] == text and self.k[self.i] in ("op", "id"):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            self.bad()

    def attempt(self, f, *a) -> bool:
        back, n, m, o, y, z = self.i, len(self.found), len(self.classes), len(self.owners), len(self.declared), len(self.fields)
        try:
            f(*a)
            return True
        except Bad:
            self.i = back
            del self.found[n:], self.classes[m:], self.owners[o:], self.declared[y:], self.fields[z:]
            return False

    def shift(self) -> str:
        """``>`` with what adjoins it: >, >=, >>, >>=, >>>, >>>=; else ''. Moves beyond it."""
        if self.t[self.i] != ">" or self.k[self.i] != "op":
            return ""
        s, p = ">", self.at[self.i] + 1
        self.i += 1
        while self.k[self.i] == "op" and self.at[self.i] == p and self.t[self.i] in (">", "=", "==") and len(s) < 3 and not s.endswith("="):
            if self.t[self.i] == "==":
                break
            s += self.t[self.i]
            p += 1
            self.i += 1
        if s == ">>>" and self.t[self.i] == "=" and self.at[self.i] == p:
            s += "="
            self.i += 1
        return s


class Script(_Base):
    """JavaScript, or TypeScript with ``ts``."""

    def __init__(self, tokens: Tokens, ts: bool) -> None:
        super().__init__(tokens)
        self.ts, self.loops, self.functions = ts, 0, 0
        self.start, self.pre, self.arrow_at, self.arrow_open = 0, -1, -1, -1

    def file(self) -> None:
        while self.k[self.i] != "end":
            self.statement()

    # names

    def is_name(self, i: int | None = None) -> bool:
        i = self.i if i is None else i
        return self.k[i] == "id" and self.t[i] not in JS_RESERVED and self.t[i][0] != "#"

    def name(self) -> None:
        if not self.is_name():
            self.bad()
        self.i += 1

    def word(self) -> None:
        if self.k[self.i] != "id":
            self.bad()
        self.i += 1

    def semi(self) -> None:
        if self.eat(";") or self.t[self.i] == "}" and self.k[self.i] in ("op", "tail", "mid") or self.k[self.i] == "end" or self.nl[self.i]:
            return
        self.bad()

    # statements

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement()

    def statement(self) -> None:
        k, t, i = self.k[self.i], self.t[self.i], self.i
        self.start, self.pre = (self.pre if self.pre >= 0 else i), -1
        if k == "op":
            if t == "{":
                return self.block()
            if t == ";":
                self.i += 1
                return
            if t == "@":
                first = self.start
                self.decorators()
                self.eat("export")
                self.eat("default")
                self.eat("abstract")
                return self.class_(first=first)
        elif k == "id":
            f = self.HEADS.get(t)
            if f is not None:
                return f(self)
            nxt, same = self.t[i + 1], not self.nl[i + 1]
            if t == "async" and nxt == "function" and same:
                self.i += 1
                return self.function(True)
            if t == "let" and (self.k[i + 1] == "id" and self.t[i + 1] not in ("in", "instanceof", "of") or nxt in ("[", "{")):
                self.declare()
                return self.semi()
            if t == "using" and self.is_name(i + 1) and same and self.t[i + 2] == "=":
                self.declare()
                return self.semi()
            if self.ts and same and self.typed(t, nxt, i):
                return
            if nxt == ":" and self.is_name():
                self.i += 2
                return self.statement()
        self.expression()
        self.semi()

    def typed(self, t: str, nxt: str, i: int) -> bool:
        """The declarations of TypeScript alone."""
        word = self.k[i + 1] == "id"
        if t == "interface" and word:
            first = self.start
            self.i += 1
            own, name = self.t[self.i], self.i
            self.name()
            self.type_params()
            head = self.i
            if self.eat("extends"):
                self.heritage()
            self.classes.append((own, self.names_between(head, self.i)))
            self.typed_as("interface", name, first, head)
            self.owners.append(own)
            self.members(True)
            self.owners.pop()
        elif t == "type" and word and self.t[i + 2] in ("=", "<"):
            self.i += 1
            self.name()
            self.type_params()
            self.need("=")
            self.type()
            self.semi()
        elif t in ("namespace", "module") and (word or self.k[i + 1] == "str"):
            self.i += 1
            if self.k[self.i] == "str":
                self.i += 1
            else:
                self.name()
                while self.eat("."):
                    self.name()
            if self.t[self.i] == "{":
                self.block()
            else:
                self.semi()
        elif t == "abstract" and nxt == "class":
            self.i += 1
            self.class_()
        elif t == "declare" and word:
            self.i += 1
            if self.t[self.i] == "global" and self.t[self.i + 1] == "{":
                self.i += 1
                self.block()
            else:
                self.statement()
        else:
            return False
        return True

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def body(self) -> None:
        self.loops += 1
        self.statement()
        self.loops -= 1

    def if_(self) -> None:
        self.i += 1
        self.paren()
        self.statement()
        if self.eat("else"):
            self.statement()

    def while_(self) -> None:
        self.i += 1
        self.paren()
        self.body()

    def do_(self) -> None:
        self.i += 1
        self.body()
        self.need("while")
        self.paren()
        self.eat(";")

    def for_(self) -> None:
        self.i += 1
        self.eat("await")
        self.need("(")
        if not self.eat(";"):
            if self.t[self.i] in ("var", "let", "const") and self.k[self.i] == "id":
                self.declare(no_in=True)
            else:
                self.expression(no_in=True)
            if self.t[self.i] in ("of", "in") and self.k[self.i] == "id":
                self.i += 1
                self.expression()
                self.need(")")
                return self.body()
            self.need(";")
        if not self.eat(";"):
            self.expression()
            self.need(";")
        if not self.eat(")"):
            self.expression()
            self.need(")")
        self.body()

    def jump(self) -> None:
        self.i += 1
        if not self.nl[self.i] and self.is_name():
            self.i += 1
        self.semi()

    def return_(self) -> None:
        if not self.functions:
            self.bad()
        self.i += 1
        if not (self.t[self.i] in (";", "}") and self.k[self.i] != "str" or self.k[self.i] == "end" or self.nl[self.i]):
            self.expression()
        self.semi()

    def throw_(self) -> None:
        self.i += 1
        if self.nl[self.i]:
            self.bad()
        self.expression()
        self.semi()

    def try_(self) -> None:
        self.i += 1
        self.block()
        done = False
        if self.eat("catch"):
            done = True
            if self.eat("("):
                self.binding()
                self.annotation()
                self.need(")")
            self.block()
        if self.eat("finally"):
            done = True
            self.block()
        if not done:
            self.bad()

    def switch_(self) -> None:
        self.i += 1
        self.paren()
        self.need("{")
        self.loops += 1
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while self.t[self.i] not in ("case", "default", "}") or self.k[self.i] == "str":
                self.statement()
        self.loops -= 1

    def with_(self) -> None:
        self.i += 1
        self.paren()
        self.statement()

    def import_(self) -> None:
        if self.t[self.i + 1] in ("(", "."):
            self.expression()
            return self.semi()
        self.i += 1
        if self.k[self.i] == "str":
            self.i += 1
            return self.semi()
        if self.ts and self.t[self.i] == "type" and (self.is_name(self.i + 1) and self.t[self.i + 1] != "from" or self.t[self.i + 1] in ("{", "*")):
            self.i += 1
        if self.is_name():
            self.i += 1
            if self.ts and self.eat("="):
                self.expression()
                return self.semi()
            if not self.eat(","):
                return self.origin()
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.specifiers()
        self.origin()

    def origin(self) -> None:
        self.need("from")
        if self.k[self.i] != "str":
            self.bad()
        self.i += 1
        if self.t[self.i] in ("with", "assert") and not self.nl[self.i]:
            self.i += 1
            self.object_()
        self.semi()

    def specifiers(self) -> None:
        self.need("{")
        while not self.eat("}"):
            words = 0
            while self.k[self.i] in ("id", "str") and words < 4:
                self.i += 1
                words += 1
            if not words:
                self.bad()
            if self.t[self.i] != "}":
                self.need(",")

    def export_(self) -> None:
        first = self.start
        self.i += 1
        if self.eat("default"):
            t = self.t[self.i]
            if t == "function" or t == "async" and self.t[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.eat("async")
                return self.function(False)
            if t == "class" or t == "@" or self.ts and t == "abstract" and self.t[self.i + 1] == "class":
                self.decorators()
                self.eat("abstract")
                return self.class_(False, first)
            if self.ts and t == "interface" and self.k[self.i + 1] == "id":
                return self.statement()
            self.start = first
            self.assign()
            return self.semi()
        if self.eat("*"):
            if self.eat("as"):
                self.word() if self.k[self.i] == "id" else self.bad()
            return self.origin()
        if self.ts and self.eat("="):
            self.expression()
            return self.semi()
        if self.ts and self.t[self.i] == "type" and self.t[self.i + 1] in ("{", "*"):
            self.i += 1
            if self.eat("*"):
                return self.origin()
        if self.t[self.i] == "{":
            self.specifiers()
            return self.origin() if self.t[self.i] == "from" else self.semi()
        t = self.t[self.i]
        if t in ("var", "let", "const", "function", "class", "async", "@", "import") or self.ts and t in ("interface", "type", "enum", "namespace", "module", "abstract", "declare"):
            self.pre = first
            return self.statement()
        self.bad()

    def declare(self, no_in: bool = False) -> None:
        first = self.start
        self.i += 1
        while True:
            name = self.i if self.is_name() else -1
            if name >= 0 and not no_in:
                self.fields.append((name, first if first >= 0 else name, self.owners[-1] if self.owners and not self.functions else None))
            self.binding()
            if self.ts:
                if self.t[self.i] == "!" and self.t[self.i + 1] == ":":
                    self.i += 1
                self.annotation()
            if self.eat("="):
                self.value_of(name, first, no_in)
            first = -1
            if not self.eat(","):
                return

    def value_of(self, name: int, first: int, no_in: bool = False) -> None:
        """The value given to a variable or field; a function there gets its name."""
        a, t = self.i, self.t[self.i]
        function = t == "function" or t == "async" and self.t[a + 1] == "function"
        self.assign(no_in)
        z = self.i - 1
        if name < 0:
            return
        if not function and self.arrow_at == a and self.arrow_open < 0:  # an arrow function whose body is an expression
            self.found.append(Function(name, first if first >= 0 else name, -1, z, self.owners[-1] if self.owners else None))
            return
        if not (function or self.t[z] == "}"):
            return
        if function or self.arrow_at == a and self.match.get(self.arrow_open) == z:
            opened = next((o for o in range(z - 1, a, -1) if self.match.get(o) == z), -1)
            self.note(name, first if first >= 0 else name, opened)

    def var_(self) -> None:
        if self.ts and self.t[self.i] == "const" and self.t[self.i + 1] == "enum":
            self.i += 1
            return self.enum_()
        self.declare()
        self.semi()

    def enum_(self) -> None:
        if not self.ts:
            self.bad()
        first, name = self.start, self.i + 1
        self.i += 1
        self.name()
        self.typed_as("enum", name, first, self.i)
        self.need("{")
        while not self.eat("}"):
            if self.k[self.i] not in ("id", "str"):
                self.bad()
            self.i += 1
            if self.eat("="):
                self.assign()
            if self.t[self.i] != "}":
                self.need(",")

    def debugger_(self) -> None:
        self.i += 1
        self.semi()

    def binding(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assign()
                if self.t[self.i] != "]":
                    self.need(",")
        elif self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    self.binding()
                else:
                    plain = self.is_name()
                    self.key()
                    if self.eat(":"):
                        self.binding()
                    elif not plain:
                        self.bad()
                    if self.eat("="):
                        self.assign()
                if self.t[self.i] != "}":
                    self.need(",")
        else:
            self.name()

    # functions and classes

    def function(self, named: bool = True) -> None:
        first = self.start
        self.need("function")
        self.eat("*")
        name = self.i if named or self.is_name() else -1
        if name >= 0:
            self.name()
        self.signature(None, name, first)

    def signature(self, bodyless: bool | None = None, name: int = -1, first: int = -1) -> None:
        if self.ts:
            self.type_params()
        self.params()
        if self.ts and self.eat(":"):
            self.return_type()
        if name >= 0 and self.k[name] == "id":
            self.note(name, first, self.i if self.t[self.i] == "{" else -1)
        if self.t[self.i] == "{":
            self.function_body()
        elif self.ts and bodyless is not False:
            self.semi()
        else:
            self.bad()

    def function_body(self) -> None:
        loops, self.loops = self.loops, 0
        self.functions += 1
        self.block()
        self.functions -= 1
        self.loops = loops

    def params(self) -> None:
        self.need("(")
        while not self.eat(")"):
            if self.ts:
                self.decorators()
                while self.t[self.i] in ("public", "private", "protected", "readonly", "override") and (self.k[self.i + 1] == "id" or self.t[self.i + 1] in ("{", "[")):
                    self.i += 1
            self.eat("...")
            if self.ts and self.t[self.i] == "this":
                self.i += 1
            else:
                self.binding()
            if self.ts:
                self.eat("?")
                self.annotation()
            if self.eat("="):
                self.assign()
            if self.t[self.i] != ")":
                self.need(",")

    def decorators(self) -> None:
        while self.eat("@"):
            if self.t[self.i] == "(":
                self.paren()
                continue
            self.word()
            while self.eat("."):
                self.word()
            if self.t[self.i] == "(":
                self.args()

    def expression_start(self) -> int:
        """Where a class begins that is part of an expression: with its statement, unless that began far back."""
        return self.start if self.start <= self.i and self.i - self.start < 64 else self.i

    def class_(self, named: bool = True, first: int | None = None) -> None:
        """``first``: the token it begins with, known where decorators or modifiers were read before."""
        first = self.expression_start() if first is None else first
        self.need("class")
        own, name = "?", -1
        if named or self.is_name() and self.t[self.i] not in ("implements",):
            own, name = self.t[self.i], self.i
            self.name()
        if self.ts:
            self.type_params()
        head = self.i
        if self.eat("extends"):
            self.lhs()
            if self.ts and self.t[self.i] == "<":
                self.type_args()
        if self.ts and self.eat("implements"):
            self.heritage()
        self.classes.append((own, self.names_between(head, self.i)))
        if name >= 0:
            self.typed_as("class", name, first, head)
        self.owners.append(own)
        self.need("{")
        while not self.eat("}"):
            self.member()
        self.owners.pop()

    def heritage(self) -> None:
        while True:
            self.type()
            if not self.eat(","):
                return

    def member(self) -> None:
        if self.eat(";"):
            return
        first = self.i
        self.decorators()
        ends = ("(", "=", ";", "}", ":", "?", "!", "<", ",")
        mods = TS_MODIFIERS if self.ts else ("static", "async", "accessor")
        while self.k[self.i] == "id" and self.t[self.i] in mods and self.t[self.i + 1] not in ends and not (self.nl[self.i + 1] and self.t[self.i] != "static"):
            if self.t[self.i] == "static" and self.t[self.i + 1] == "{":
                self.i += 1
                return self.function_body()
            self.i += 1
        self.eat("*")
        if self.t[self.i] in ("get", "set") and self.k[self.i] == "id" and self.t[self.i + 1] not in ends and not self.nl[self.i + 1]:
            self.i += 1
        if self.ts and self.t[self.i] == "[" and self.k[self.i + 1] == "id" and self.t[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.need("]")
            self.annotation()
            return self.semi()
        name = self.i
        self.key(True)
        if self.ts and not self.eat("?"):
            self.eat("!")
        if self.t[self.i] == "(" or self.ts and self.t[self.i] == "<":
            return self.signature(None, name, first)
        if self.k[name] == "id":
            self.fields.append((name, first, self.owners[-1] if self.owners else None))
        if self.ts:
            self.annotation()
        if self.eat("="):
            self.functions += 1
            self.value_of(name if self.k[name] == "id" else -1, first)
            self.functions -= 1
        self.semi()

    def key(self, private: bool = False) -> None:
        k = self.k[self.i]
        if k == "id" and (private or self.t[self.i][0] != "#") or k in ("str", "num"):
            self.i += 1
        elif self.eat("["):
            self.assign()
            self.need("]")
        else:
            self.bad()

    # expressions

    def expression(self, no_in: bool = False) -> None:
        self.assign(no_in)
        while self.eat(","):
            self.assign(no_in)

    def arrow_body(self, a: int = -1) -> None:
        if self.nl[self.i]:
            self.bad()
        self.need("=>")
        if self.t[self.i] == "{":
            o = self.i
            self.function_body()
            self.arrow_at, self.arrow_open = a, o
        else:
            self.assign()
            self.arrow_at, self.arrow_open = a, -1

    def arrow(self) -> None:
        if self.ts:
            self.type_params()
        self.params()
        if self.ts and self.eat(":"):
            self.return_type()
        if self.t[self.i] != "=>":
            self.bad()

    def assign(self, no_in: bool = False) -> None:
        i, t = self.i, self.t[self.i]
        if self.k[i] == "id":
            if t == "yield":
                self.i += 1
                if self.eat("*") or not self.nl[self.i] and self.t[self.i] not in (")", "]", "}", ",", ";", ":") and self.k[self.i] != "end":
                    self.assign(no_in)
                return
            if t == "async" and not self.nl[i + 1] and (self.t[i + 1] in ("(", "<") or self.is_name(i + 1) and self.t[i + 2] == "=>"):
                self.i += 1
                if self.is_name():
                    self.i += 1
                    return self.arrow_body(i)
                if self.attempt(self.arrow):
                    return self.arrow_body(i)
                self.i = i
            if self.t[i + 1] == "=>" and self.is_name():
                self.i += 1
                return self.arrow_body(i)
        elif t == "(" and self.k[i] == "op":
            after = self.t[self.match[i] + 1]
            if after == "=>" or self.ts and after == ":":
                if self.attempt(self.arrow):
                    return self.arrow_body(i)
        elif t == "<" and self.ts:
            if self.attempt(self.arrow):
                return self.arrow_body(i)
        target = self.binary(no_in)
        if self.eat("?"):
            self.assign()
            self.need(":")
            return self.assign(no_in)
        if self.k[self.i] == "op" and self.t[self.i] in JS_ASSIGN:
            if not target:
                self.bad()
            self.i += 1
            return self.assign(no_in)
        back = self.i
        s = self.shift()
        if s in (">>=", ">>>="):
            if not target:
                self.bad()
            return self.assign(no_in)
        self.i = back

    def binary(self, no_in: bool) -> bool:
        """Operands and operators; whether it's a lone target of an assignment."""
        target = self.unary()
        while True:
            k, t = self.k[self.i], self.t[self.i]
            if k == "op":
                if t in JS_BINARY:
                    self.i += 1
                elif t == ">":
                    back = self.i
                    if self.shift() in (">>=", ">>>="):
                        self.i = back
                        return target
                else:
                    return target
            elif k == "id" and (t == "instanceof" or t == "in" and not no_in):
                self.i += 1
            elif k == "id" and self.ts and t in ("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                if not self.eat("const"):
                    self.type()
                continue
            else:
                return target
            self.unary()
            target = False

    def unary(self) -> bool:
        k, t = self.k[self.i], self.t[self.i]
        if k == "op" and t in ("!", "~", "+", "-", "++", "--") or k == "id" and (t in ("typeof", "void", "delete") or t == "await" and self.starts(self.i + 1)):
            self.i += 1
            self.unary()
            return False
        if t == "<" and k == "op" and self.ts:
            self.need("<")
            if not self.eat("const"):
                self.type()
            self.need(">")
            self.unary()
            return False
        target = self.lhs()
        if self.t[self.i] in ("++", "--") and self.k[self.i] == "op" and not self.nl[self.i]:
            if not target:
                self.bad()
            self.i += 1
            return False
        return target

    def starts(self, i: int) -> bool:
        """Whether token ``i`` may begin an operand right after 'await'."""
        k, t = self.k[i], self.t[i]
        return k in ("num", "str", "tpl", "head", "re", "markup") or k == "id" and t not in ("in", "of", "instanceof", "as") or t in ("(", "[", "{", "!", "~", "<")

    def lhs(self) -> bool:
        if self.t[self.i] == "new" and self.k[self.i] == "id":
            self.i += 1
            if self.eat("."):
                self.need("target")
            else:
                if self.t[self.i] == "new":
                    self.lhs()
                else:
                    self.primary()
                    self.trailers(False)
                if self.ts and self.t[self.i] == "<":
                    self.attempt(self.call_types)
                if self.t[self.i] == "(":
                    self.args()
            target = False
        else:
            target = self.primary()
        return self.trailers(True, target)

    def call_types(self) -> None:
        self.type_args()
        if self.t[self.i] not in ("(", ")", "]", ",", ";", ":", ".", "?.") and self.k[self.i] not in ("tpl", "head", "end") and not self.nl[self.i]:
            self.bad()

    def trailers(self, calls: bool, target: bool = False) -> bool:
        while True:
            k, t = self.k[self.i], self.t[self.i]
            if k == "op":
                if t == ".":
                    self.i += 1
                    self.word()
                    target = True
                elif t == "?." and calls:
                    self.i += 1
                    if self.t[self.i] == "(":
                        self.args()
                    elif self.eat("["):
                        self.expression()
                        self.need("]")
                    else:
                        self.word()
                    target = False
                elif t == "[":
                    self.i += 1
                    self.expression()
                    self.need("]")
                    target = True
                elif t == "(" and calls:
                    self.args()
                    target = False
                elif t == "!" and self.ts and not self.nl[self.i]:
                    self.i += 1
                elif t == "<" and self.ts and calls and self.attempt(self.call_types):
                    target = False
                else:
                    return target
            elif k in ("tpl", "head"):
                self.template()
                target = False
            else:
                return target

    def args(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.eat("...")
            self.assign()
            if self.t[self.i] != ")" or self.k[self.i] != "op":
                self.need(",")

    def template(self) -> None:
        if self.k[self.i] == "tpl":
            self.i += 1
            return
        while True:
            self.i += 1
            self.expression()
            if self.k[self.i] == "tail":
                self.i += 1
                return
            if self.k[self.i] != "mid":
                self.bad()

    def primary(self) -> bool:
        k, t = self.k[self.i], self.t[self.i]
        if k in ("num", "str", "re"):
            self.i += 1
            return False
        if k in ("tpl", "head"):
            self.template()
            return False
        if k == "markup":
            self.element()
            return False
        if k == "id":
            if t == "function" or t == "async" and self.t[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.eat("async")
                self.need("function")
                self.eat("*")
                if self.is_name():
                    self.i += 1
                self.signature(False)
                return False
            if t == "class":
                self.class_(False)
                return False
            if t in ("this", "null", "true", "false"):
                self.i += 1
                return False
            if t == "super":
                self.i += 1
                if self.t[self.i] not in ("(", ".", "["):
                    self.bad()
                return False
            if t == "import":
                self.i += 1
                if self.t[self.i] not in ("(", "."):
                    self.bad()
                return False
            if t[0] == "#":
                self.i += 1
                if self.t[self.i] != "in":
                    self.bad()
                return False
            if t in JS_RESERVED:
                self.bad()
            self.i += 1
            return True
        if t == "(":
            self.i += 1
            self.expression()
            self.need(")")
            return self.t[self.i - 2] not in (")",) or True
        if t == "[":
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assign()
                if self.t[self.i] != "]":
                    self.need(",")
            return True
        if t == "{":
            self.object_()
            return True
        if t == "@":
            first = self.expression_start()
            self.decorators()
            self.class_(False, first)
            return False
        self.bad()
        return False

    def element(self) -> None:
        """A markup element: the expressions in its braces."""
        self.i += 1
        while self.k[self.i] != "endmarkup":
            self.need("{")
            if not self.eat("}"):
                self.eat("...")
                self.expression()
                self.need("}")
        self.i += 1

    def object_(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.eat("..."):
                self.assign()
            else:
                first = self.i
                ends = ("(", ":", ",", "}", "=", "<")
                if self.t[self.i] == "async" and self.t[self.i + 1] not in ends:
                    self.i += 1
                self.eat("*")
                if self.t[self.i] in ("get", "set") and self.k[self.i] == "id" and self.t[self.i + 1] not in ends:
                    self.i += 1
                plain, name = self.is_name() or self.t[self.i] in ("this",), self.i
                self.key()
                if self.eat(":"):
                    self.value_of(name if self.k[name] == "id" else -1, first)
                elif self.t[self.i] == "(" or self.ts and self.t[self.i] == "<":
                    self.signature(False, name, first)
                elif not plain:
                    self.bad()
                elif self.eat("="):
                    self.assign()
            if self.t[self.i] != "}" or self.k[self.i] == "str":
                self.need(",")

    # types

    def annotation(self) -> None:
        if self.ts and self.eat(":"):
            self.type()

    def return_type(self) -> None:
        if self.t[self.i] == "asserts" and self.k[self.i + 1] == "id" and not self.nl[self.i + 1]:
            self.i += 2
            if self.eat("is"):
                self.type()
            return
        self.type()
        if self.t[self.i] == "is" and not self.nl[self.i]:
            self.i += 1
            self.type()

    def type_params(self) -> None:
        if not self.ts or not self.eat("<"):
            return
        while True:
            while self.t[self.i] in ("const", "in", "out") and self.k[self.i + 1] == "id":
                self.i += 1
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(",") or self.t[self.i] == ">":
                break
        self.need(">")

    def type_args(self) -> None:
        self.need("<")
        while True:
            self.type()
            if not self.eat(","):
                break
        self.need(">")

    def function_type(self) -> None:
        self.type_params()
        self.params()
        self.need("=>")
        self.return_type()

    def type(self) -> None:
        t = self.t[self.i]
        if t == "(" and self.k[self.i] == "op" and self.attempt(self.function_type) or t == "<" and self.attempt(self.function_type):
            return
        if t == "new" or t == "abstract" and self.t[self.i + 1] == "new":
            self.eat("abstract")
            self.i += 1
            return self.function_type()
        self.eat("|") or self.eat("&")
        while True:
            self.type_operand()
            if not (self.eat("|") or self.eat("&")):
                break
        if self.t[self.i] == "extends" and not self.nl[self.i]:
            back = self.i
            self.i += 1
            self.type()
            if not self.eat("?"):
                self.i = back
                return
            self.type()
            self.need(":")
            self.type()

    def type_operand(self) -> None:
        k, t = self.k[self.i], self.t[self.i]
        if k == "id" and t in ("keyof", "unique", "readonly", "infer", "typeof") and (self.k[self.i + 1] in ("id",) or self.t[self.i + 1] in ("(", "[", "{")) and not (self.t[self.i + 1] in ("(", "[") and t in ("infer", "unique")):
            self.i += 1
            if t == "typeof" and self.t[self.i] == "import":
                pass
            elif t == "typeof":
                self.word()
                while self.eat("."):
                    self.word()
                if self.t[self.i] == "<" and not self.nl[self.i]:
                    self.type_args()
                return self.type_suffix()
            return self.type_operand()
        if k in ("str", "num", "tpl"):
            self.i += 1
        elif k == "head":
            while True:
                self.i += 1
                self.type()
                if self.k[self.i] == "tail":
                    self.i += 1
                    break
                if self.k[self.i] != "mid":
                    self.bad()
        elif t == "-" and self.k[self.i + 1] == "num":
            self.i += 2
        elif t == "import" and self.t[self.i + 1] == "(":
            self.i += 1
            self.args()
            while self.eat("."):
                self.word()
            if self.t[self.i] == "<":
                self.type_args()
        elif k == "id" and (t not in JS_RESERVED or t in ("this", "void", "null", "true", "false")):
            self.i += 1
            while self.eat("."):
                self.word()
            if self.t[self.i] == "<" and not self.nl[self.i]:
                self.type_args()
        elif t == "{":
            self.members()
        elif t == "[":
            self.i += 1
            while not self.eat("]"):
                self.eat("...")
                if self.k[self.i] == "id" and (self.t[self.i + 1] == ":" or self.t[self.i + 1] == "?" and self.t[self.i + 2] == ":"):
                    self.i += 1
                    self.eat("?")
                    self.need(":")
                self.type()
                self.eat("?")
                if self.t[self.i] != "]":
                    self.need(",")
        elif t == "(":
            self.i += 1
            self.type()
            self.need(")")
        else:
            self.bad()
        self.type_suffix()

    def type_suffix(self) -> None:
        while self.t[self.i] == "[" and self.k[self.i] == "op" and not self.nl[self.i]:
            self.i += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def members(self, named: bool = False) -> None:
        """Members of an interface (whose methods are noted) or of a type literal."""
        self.need("{")
        while not self.eat("}"):
            first = name = self.i
            while self.t[self.i] in ("+", "-") and self.t[self.i + 1] == "readonly":
                self.i += 1
            ends = ("(", ":", "?", ";", ",", "}", "<")
            while self.t[self.i] in ("readonly", "get", "set", "new") and self.k[self.i] == "id" and self.t[self.i + 1] not in ends:
                self.i += 1
            if self.t[self.i] == "new" and self.t[self.i + 1] in ("(", "<"):
                self.i += 1
            if self.t[self.i] in ("(", "<"):
                pass
            elif self.t[self.i] == "[" and self.k[self.i + 1] == "id" and self.t[self.i + 2] in (":", "in"):
                self.i += 2
                self.i += 1
                self.type()
                if self.eat("as"):
                    self.type()
                self.need("]")
                if self.t[self.i] in ("+", "-"):
                    self.i += 1
                self.eat("?")
            else:
                name = self.i
                self.key()
                self.eat("?")
            if self.t[self.i] in ("(", "<"):
                if named and self.k[name] == "id" and name < self.i:
                    self.note(name, first, -1)
                self.type_params()
                self.params()
                if self.eat(":"):
                    self.return_type()
            else:
                self.annotation()
            if not (self.eat(";") or self.eat(",") or self.t[self.i] == "}" or self.nl[self.i]):
                self.bad()

    HEADS = {"if": if_, "while": while_, "do": do_, "for": for_, "break": jump, "continue": jump, "return": return_, "throw": throw_, "try": try_, "switch": switch_, "with": with_, "import": import_, "export": export_, "var": var_, "const": var_, "function": function, "class": class_, "enum": enum_, "debugger": debugger_}


class Java(_Base):
    """Java 17."""

    def file(self) -> None:
        while self.eat(";"):
            pass
        back = self.i
        self.annotations()
        if self.eat("package"):
            self.qualified()
            self.need(";")
        else:
            self.i = back
        while self.t[self.i] in ("import", ";"):
            if self.eat(";"):
                continue
            self.i += 1
            self.eat("static")
            self.name()
            while self.eat("."):
                if self.eat("*"):
                    break
                self.name()
            self.need(";")
        if self.t[self.i] in ("module", "open") and self.k[self.i + 1] == "id":
            while not self.t[self.i] == "{":
                self.i += 1
                if self.k[self.i] == "end":
                    self.bad()
            self.i = self.match[self.i] + 1
        while self.k[self.i] != "end":
            if not self.eat(";"):
                first = self.i
                self.modifiers()
                self.type_decl(first)

    # names and types

    def is_name(self, i: int | None = None) -> bool:
        i = self.i if i is None else i
        return self.k[i] == "id" and self.t[i] not in JAVA_RESERVED

    def name(self) -> None:
        if not self.is_name():
            self.bad()
        self.i += 1

    def qualified(self) -> None:
        self.name()
        while self.t[self.i] == "." and self.is_name(self.i + 1):
            self.i += 2

    def annotations(self) -> None:
        while self.t[self.i] == "@" and self.t[self.i + 1] != "interface":
            self.i += 1
            self.qualified()
            if self.eat("("):
                while not self.eat(")"):
                    if self.is_name() and self.t[self.i + 1] == "=":
                        self.i += 2
                    self.element()
                    if self.t[self.i] != ")":
                        self.need(",")

    def element(self) -> None:
        if self.t[self.i] == "@":
            self.annotations()
        elif self.eat("{"):
            while not self.eat("}"):
                self.element()
                if self.t[self.i] != "}":
                    self.need(",")
        else:
            self.expression()

    def modifiers(self) -> None:
        while True:
            if self.t[self.i] == "@" and self.t[self.i + 1] != "interface":
                self.annotations()
            elif self.k[self.i] == "id" and self.t[self.i] in JAVA_MODIFIERS and not (self.t[self.i] == "default" and self.t[self.i + 1] in (":", "->")) and not (self.t[self.i] == "sealed" and self.t[self.i + 1] not in JAVA_MODIFIERS | {"class", "interface"}) and not (self.t[self.i] == "synchronized" and self.t[self.i + 1] == "("):
                self.i += 1
            elif self.t[self.i] == "non" and self.t[self.i + 1] == "-" and self.t[self.i + 2] == "sealed":
                self.i += 3
            else:
                return

    def type(self, dims: bool = True) -> None:
        self.annotations()
        if self.k[self.i] == "id" and self.t[self.i] in JAVA_PRIMITIVES:
            self.i += 1
        else:
            self.name()
            self.type_args()
            while self.t[self.i] == "." and (self.is_name(self.i + 1) or self.t[self.i + 1] == "@"):
                self.i += 1
                self.annotations()
                self.name()
                self.type_args()
        if dims:
            self.dims()

    def dims(self) -> None:
        while self.t[self.i] == "[" and self.t[self.i + 1] == "]" or self.t[self.i] == "@" and self.t[self.i + 1] != "interface":
            self.annotations()
            if not self.eat("["):
                return
            self.need("]")

    def type_args(self) -> None:
        if not self.eat("<"):
            return
        if self.eat(">"):
            return
        while True:
            self.annotations()
            if self.eat("?"):
                if self.eat("extends") or self.eat("super"):
                    self.type()
            else:
                self.type()
            if not self.eat(","):
                break
        self.need(">")

    def type_params(self) -> None:
        if not self.eat("<"):
            return
        while True:
            self.annotations()
            self.name()
            if self.eat("extends"):
                self.type()
                while self.eat("&"):
                    self.type()
            if not self.eat(","):
                break
        self.need(">")

    def types(self) -> None:
        while True:
            self.type()
            if not self.eat(","):
                return

    # declarations

    def starts_type_decl(self) -> bool:
        t = self.t[self.i]
        return t in ("class", "interface", "enum") or t == "@" and self.t[self.i + 1] == "interface" or t == "record" and self.is_name(self.i + 1) and self.t[self.i + 2] in ("(", "<")

    def type_decl(self, first: int = -1) -> None:
        if not self.starts_type_decl():
            self.bad()
        first = first if first >= 0 else self.i
        self.eat("@")
        what = self.t[self.i]
        self.i += 1
        own, name = self.t[self.i], self.i
        self.name()
        self.type_params()
        if what == "record":
            self.params()
        head = self.i
        if self.eat("extends"):
            self.types()
        if self.eat("implements"):
            self.types()
        if self.t[self.i] == "permits":
            self.i += 1
            self.types()
        self.classes.append((own, self.names_between(head, self.i)))
        self.typed_as(what, name, first, head)
        self.owners.append(own)
        self.class_body(what)
        self.owners.pop()

    def class_body(self, what: str = "class") -> None:
        self.need("{")
        if what == "enum":
            while True:
                self.annotations()
                if not self.is_name():
                    break
                self.i += 1
                if self.t[self.i] == "(":
                    self.args()
                if self.t[self.i] == "{":
                    self.class_body()
                if not self.eat(","):
                    break
            if not self.eat(";"):
                return self.need("}")
        while not self.eat("}"):
            self.member(what)

    def member(self, what: str) -> None:
        if self.eat(";"):
            return
        if self.t[self.i] == "static" and self.t[self.i + 1] == "{":
            self.i += 1
        if self.t[self.i] == "{":
            return self.block()
        first = self.i
        self.modifiers()
        if self.starts_type_decl():
            return self.type_decl(first)
        self.type_params()
        if self.is_name() and self.t[self.i + 1] == "(":  # constructor
            name = self.i
            self.i += 1
            self.params()
            self.throws()
            self.note(name, first, self.i)
            return self.block()
        if what == "record" and self.is_name() and self.t[self.i + 1] == "{":
            self.i += 1
            return self.block()
        if not self.eat("void"):
            self.type()
        name = self.i
        self.name()
        if self.t[self.i] == "(":
            self.params()
            self.dims()
            self.throws()
            if self.eat("default"):
                self.element()
            self.note(name, first, self.i if self.t[self.i] == "{" else -1)
            if self.t[self.i] == "{":
                return self.block()
            return self.need(";")
        self.fields.append((name, first, self.owners[-1] if self.owners else None))
        self.declarators()
        self.need(";")

    def throws(self) -> None:
        if self.eat("throws"):
            self.types()

    def params(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.modifiers()
            self.type()
            self.annotations()
            self.eat("...")
            if not self.eat("this"):
                self.name()
                if self.t[self.i] == "." and self.t[self.i + 1] == "this":
                    self.i += 2
            self.dims()
            if self.t[self.i] != ")":
                self.need(",")
                if self.t[self.i] == ")":
                    self.bad()

    def declarators(self) -> None:
        """What follows the first name."""
        while True:
            self.dims()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.eat("{"):
            while not self.eat("}"):
                self.initializer()
                if self.t[self.i] != "}":
                    self.need(",")
        else:
            self.expression()

    # statements

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement(True)

    def local(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        if self.k[self.i] != "op" or self.t[self.i] not in ("=", ";", ",", "[", ":"):
            self.bad()

    def statement(self, declare: bool = False) -> None:
        k, t = self.k[self.i], self.t[self.i]
        if k == "op" and t == "{":
            return self.block()
        if self.eat(";"):
            return
        if k == "id":
            f = self.HEADS.get(t)
            if f is not None and not (t == "switch" and self.switch_value()):
                return f(self)
            if t == "yield" and self.t[self.i + 1] not in ("=", ".", "(", "[", "++", "--"):
                self.i += 1
                self.expression()
                return self.need(";")
            if self.t[self.i + 1] == ":" and self.is_name():
                self.i += 2
                return self.statement()
        if declare:
            back = self.i
            self.modifiers()
            if self.starts_type_decl():
                return self.type_decl()
            self.i = back
            if self.attempt(self.local):
                self.declarators()
                return self.need(";")
        start = self.i
        if self.expression() not in ("call", "assign", "new", "step"):
            self.i = max(start, self.i)
            self.bad()
        self.need(";")

    def switch_value(self) -> bool:
        """A switch at the start of a statement is an expression if a member of it is used."""
        if self.t[self.i + 1] != "(":
            return False
        body = self.match.get(self.i + 1, 0) + 1
        return self.t[body] == "{" and self.t[self.match[body] + 1] in (".",)

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def if_(self) -> None:
        self.i += 1
        self.paren()
        self.statement()
        if self.eat("else"):
            self.statement()

    def while_(self) -> None:
        self.i += 1
        self.paren()
        self.statement()

    def do_(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.paren()
        self.need(";")

    def for_(self) -> None:
        self.i += 1
        self.need("(")
        if not self.eat(";"):
            if self.attempt(self.local):
                if self.eat(":"):
                    self.expression()
                    self.need(")")
                    return self.statement()
                self.declarators()
            else:
                self.list()
            self.need(";")
        if not self.eat(";"):
            self.expression()
            self.need(";")
        if not self.eat(")"):
            self.list()
            self.need(")")
        self.statement()

    def list(self) -> None:
        while True:
            self.expression()
            if not self.eat(","):
                return

    def jump(self) -> None:
        self.i += 1
        if self.is_name():
            self.i += 1
        self.need(";")

    def return_(self) -> None:
        self.i += 1
        if not self.eat(";"):
            self.expression()
            self.need(";")

    def throw_(self) -> None:
        self.i += 1
        self.expression()
        self.need(";")

    def assert_(self) -> None:
        self.i += 1
        self.expression()
        if self.eat(":"):
            self.expression()
        self.need(";")

    def synchronized_(self) -> None:
        self.i += 1
        self.paren()
        self.block()

    def try_(self) -> None:
        self.i += 1
        done = False
        if self.eat("("):
            done = True
            while not self.eat(")"):
                if self.attempt(self.local):
                    self.declarators()
                else:
                    self.expression()
                if self.t[self.i] != ")":
                    self.need(";")
        self.block()
        while self.eat("catch"):
            done = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.eat("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.eat("finally"):
            done = True
            self.block()
        if not done:
            self.bad()

    def switch_(self) -> None:
        self.i += 1
        self.paren()
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                while True:
                    self.i += 0
                    if not self.eat("default") and not self.attempt(self.pattern):
                        self.ternary()
                    if not self.eat(","):
                        break
            else:
                self.need("default")
            if self.eat("->"):
                if self.t[self.i] == "{":
                    self.block()
                elif self.t[self.i] == "throw":
                    self.throw_()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while self.t[self.i] not in ("case", "default", "}") or self.k[self.i] == "str":
                    self.statement(True)

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        if self.t[self.i] not in ("->", ":", ",", "&&", ")", "||", "?", ";"):
            self.bad()

    # expressions: each gives what kind of expression it was

    def lambda_head(self) -> None:
        if self.is_name() and self.t[self.i + 1] == "->":
            self.i += 1
        elif self.t[self.i] == "(":
            if self.t[self.match[self.i] + 1] != "->":
                self.bad()
            if self.is_name(self.i + 1) and self.t[self.i + 2] in (",", ")") or self.t[self.i + 1] == ")":
                self.i += 1
                while not self.eat(")"):
                    self.name()
                    if self.t[self.i] != ")":
                        self.need(",")
            else:
                self.params()
        else:
            self.bad()
        self.need("->")

    def expression(self) -> str:
        i = self.i
        if self.is_name() and self.t[i + 1] == "->" or self.t[i] == "(" and self.k[i] == "op" and self.t[self.match[i] + 1] == "->":
            self.lambda_head()
            if self.t[self.i] == "{":
                self.block()
            else:
                self.expression()
            return "lambda"
        kind = self.ternary()
        if self.k[self.i] == "op":
            op = self.t[self.i]
            if op in JAVA_ASSIGN:
                if kind != "name":
                    self.bad()
                self.i += 1
                self.expression()
                return "assign"
            back = self.i
            if self.shift() in (">>=", ">>>="):
                if kind != "name":
                    self.bad()
                self.expression()
                return "assign"
            self.i = back
        return kind

    def ternary(self) -> str:
        kind = self.unary()
        while True:
            k, t = self.k[self.i], self.t[self.i]
            if k == "op" and t in JAVA_BINARY:
                self.i += 1
                self.unary()
            elif k == "op" and t == ">":
                back = self.i
                if self.shift() in (">>=", ">>>="):
                    self.i = back
                    return kind
                self.unary()
            elif k == "id" and t == "instanceof":
                self.i += 1
                self.modifiers()
                self.type()
                if self.is_name():
                    self.i += 1
            elif k == "op" and t == "?":
                self.i += 1
                self.expression()
                self.need(":")
                if not self.attempt_lambda():
                    self.ternary()
                return "value"
            else:
                return kind
            kind = "value"

    def attempt_lambda(self) -> bool:
        i = self.i
        if self.is_name() and self.t[i + 1] == "->" or self.t[i] == "(" and self.k[i] == "op" and self.t[self.match[i] + 1] == "->":
            self.expression()
            return True
        return False

    def cast(self) -> None:
        self.need("(")
        plain = self.t[self.i] in JAVA_PRIMITIVES
        self.type()
        plain = plain and self.t[self.i - 1] != "]"
        while self.eat("&"):
            self.type()
        self.need(")")
        k, t = self.k[self.i], self.t[self.i]
        if plain and t in ("+", "-", "++", "--"):
            return
        if not (k in ("str", "num", "chr") or t in ("(", "!", "~") and k == "op" or k == "id" and (t not in JAVA_RESERVED or t in ("this", "super", "new", "true", "false", "null", "switch") or t in JAVA_PRIMITIVES)):
            self.bad()

    def unary(self) -> str:
        t = self.t[self.i]
        if self.k[self.i] == "op":
            if t in ("++", "--"):
                self.i += 1
                if self.unary() != "name":
                    self.bad()
                return "step"
            if t in ("+", "-", "!", "~"):
                self.i += 1
                self.unary()
                return "value"
            if t == "(" and self.attempt(self.cast):
                if not self.attempt_lambda():
                    self.unary()
                return "value"
        kind = self.postfix()
        while self.t[self.i] in ("++", "--") and self.k[self.i] == "op":
            if kind != "name":
                self.bad()
            self.i += 1
            kind = "step"
        return kind

    def args(self) -> None:
        self.need("(")
        if self.eat(")"):
            return
        while True:
            self.expression()
            if not self.eat(","):
                break
        self.need(")")

    def generic_ref(self) -> None:
        """A type before '::' or '.class'."""
        self.type()
        if self.t[self.i] == "::" or self.t[self.i] == "." and self.t[self.i + 1] == "class":
            return
        self.bad()

    def postfix(self) -> str:
        k, t = self.k[self.i], self.t[self.i]
        kind = "value"
        if k in ("str", "num", "chr"):
            self.i += 1
        elif k == "op" and t == "(":
            self.i += 1
            kind = self.expression()
            kind = "name" if kind == "name" else "value"
            self.need(")")
        elif k != "id":
            self.bad()
        elif t == "new":
            self.i += 1
            self.new()
            kind = "new"
        elif t in ("this", "super"):
            self.i += 1
            if self.t[self.i] == "(":
                self.args()
                kind = "call"
        elif t in ("true", "false", "null"):
            self.i += 1
        elif t == "switch":
            self.switch_()
        elif t in JAVA_PRIMITIVES or t == "void":
            self.i += 1
            self.dims()
            if self.t[self.i] not in ("::", "."):
                self.bad()
        elif (self.t[self.i + 1] in ("<", "[", ".")) and self.attempt(self.generic_ref):
            pass
        else:
            self.name()
            kind = "name"
            if self.t[self.i] == "(":
                self.args()
                kind = "call"
        while True:
            t = self.t[self.i]
            if self.k[self.i] != "op":
                return kind
            if t == ".":
                self.i += 1
                if self.eat("new"):
                    self.new()
                    kind = "new"
                    continue
                if self.eat("class") or self.eat("this"):
                    kind = "value"
                    continue
                if self.t[self.i] == "<":
                    self.type_args()
                if not self.eat("super"):
                    self.name()
                kind = "name"
                if self.t[self.i] == "(":
                    self.args()
                    kind = "call"
            elif t == "[":
                self.i += 1
                self.expression()
                self.need("]")
                kind = "name"
            elif t == "::":
                self.i += 1
                self.type_args()
                if not self.eat("new"):
                    self.name()
                kind = "value"
            else:
                return kind

    def new(self) -> None:
        self.type_args()
        self.type(False)
        if self.t[self.i] in ("[", "@"):
            if self.t[self.i + 1] == "]":
                self.dims()
                if self.t[self.i] != "{":
                    self.bad()
                return self.initializer()
            while self.t[self.i] == "[" and self.t[self.i + 1] != "]":
                self.i += 1
                self.expression()
                self.need("]")
            return self.dims()
        self.args()
        if self.t[self.i] == "{":
            self.class_body()

    HEADS = {"if": if_, "while": while_, "do": do_, "for": for_, "break": jump, "continue": jump, "return": return_, "throw": throw_, "assert": assert_, "synchronized": synchronized_, "try": try_, "switch": switch_}
