"""Facts of a file, in one pass over its tokens: nodes of blocks, and what stands in them.

What isn't understood is skipped to the end of its statement and leaves no fact; blocks still match by their `end`.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

from arborq.parser.lexer import KEYWORDS, KINDS, OPENERS, SyntaxProblem, Token, Tokens

UNBOUNDED = 2**31 - 1
#: Macros that open a scope with a test body.
TEST_MACROS = ("@testitem", "@testset", "@safetestset", "@testmodule", "@testsnippet")
#: Those of them whose body is a module of its own.
TEST_MODULES = ("@testitem", "@testmodule", "@testsnippet")
#: Blocks and brackets in one another, at most.
DEPTH = 300
_GUARDS = ("isfile", "ispath", "isdefined", "@isdefined")


@dataclass
class Facts:
    nodes: list[tuple] = field(default_factory=list)  # (node_id, parent_id, kind, name, start, stop)
    items: list[tuple] = field(default_factory=list)  # (ord, name, qualifier, kind, module path, min, max, kws, kwsplat, start, where the name starts)
    imports: list[tuple] = field(default_factory=list)  # (ord, keyword, dots, path, names, module path, start, what they are called here, where they start)
    exports: list[tuple] = field(default_factory=list)  # (name, kind, module path, start)
    includes: list[tuple] = field(default_factory=list)  # (ordinal, target or None, guarded, test node or None, module path, start)
    calls: list[tuple] = field(default_factory=list)  # (callee, min, max, kws, start, stop)
    tests: list[tuple] = field(default_factory=list)  # (kind, label or None, start)
    findings: list[tuple] = field(default_factory=list)  # (rule_id, message, start, stop)
    scopes: list[tuple] = field(default_factory=list)  # (scope_id, kind, module path, scopes from itself out to its module)
    bindings: list[tuple] = field(default_factory=list)  # (scope_id, name, kind, start)
    refs: list[tuple] = field(default_factory=list)  # (scope_id, name, start, in_macro)
    members: list[tuple] = field(default_factory=list)  # (qualifier, name, module path, start): names after names and dots

    def size(self) -> int:
        return sum(map(len, vars(self).values()))


def parse(text: str | None) -> Facts:
    """Facts of a file. Where it can't be understood further, those so far and a finding; that goes for a fault of the parser too, so that a file never costs the others their facts."""
    facts = Facts()
    for piece in pieces(text, None):
        for name, rows in vars(piece).items():
            getattr(facts, name).extend(rows)
    facts.nodes.sort()
    return facts


def parsed(text: str, facts: Facts) -> None:
    """Puts the facts of a file into facts. SyntaxProblem where it can't be understood further."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20 * DEPTH))
    try:
        for _ in _Parser(Tokens(text), facts).file(len(text), None):
            pass
    finally:
        sys.setrecursionlimit(limit)


def pieces(text: str | None, room: int | None) -> Iterator[Facts]:
    """The facts of `parse` in pieces of little over `room` facts, one at least; between two of them a statement of the file or of a module ends. A node is in the piece where it ends."""
    text = text or ""
    parser, problem = None, None
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20 * DEPTH))
    try:
        parser = _Parser(Tokens(text), Facts())
        yield from parser.file(len(text), room)
    except SyntaxProblem as e:
        problem = ("syntax_errors", e.message, e.start, e.stop)
    except Exception as e:  # noqa: BLE001
        problem = ("syntax_errors", f"this can't be parsed: {e!r}", 0, len(text))
    finally:
        sys.setrecursionlimit(limit)
    last = parser.f if parser else Facts()
    if parser:
        last.nodes.extend((*n[:5], len(text)) for n in parser.open.values())
        last.nodes.sort()
    if problem:
        last.findings.append(problem)
    yield last


class _Parser:
    def __init__(self, toks: Tokens, facts: Facts):
        self.t, self.n, self.at, self.f = toks, len(toks), 0, facts
        self.path: list[str] = []
        self.parents: list[int] = [0]
        self.loops = self.functions = self.scopes = self.guards = 0
        self.test: int | None = None
        self.order = 0
        self.n_nodes = self.n_scopes = 0
        self.open: dict[int, tuple] = {}  # nodes that haven't ended
        self.scope: list[tuple] = []  # from the file's in
        self.named: list[bool] = []  # for each bracket around: whether `name = value` in it names an argument
        self.bound: set[int] = set()  # where names stand that are bound, and so aren't uses
        self.in_macro = False
        self.depth = 0
        self.saw = [False]  # for each bracket around: whether what stands in it so far asks if something exists
        self.heads: set[int] = set()  # where the heads of short functions begin
        self.closes = array("i", [-1]) * len(toks)  # of each bracket, where it ends
        around: list[int] = []
        opens, closes = KINDS.index("open"), KINDS.index("close")
        for k, kind in enumerate(toks.kinds):
            if kind == opens:
                around.append(k)
            elif kind == closes and around:
                self.closes[around.pop()] = k
        self.open_scope("file")

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            p = self.peek() or self.t[-1]
            raise SyntaxProblem(f"blocks and brackets are nested over {DEPTH} deep", p.start, p.stop)

    def matching(self, at: int) -> int | None:
        if self.t[at].kind != "open":
            return matching(self.t, at)
        return self.closes[at] if self.closes[at] >= 0 else None

    # tokens
    def peek(self, k: int = 0) -> Token | None:
        at = self.at + k
        return self.t[at] if at < self.n else None

    def take(self) -> Token:
        self.at += 1
        return self.t[self.at - 1]

    def is_(self, *texts: str) -> bool:
        p = self.peek()
        return p is not None and p.text in texts and p.kind not in ("string", "rawstring", "char")

    def next_order(self) -> int:
        self.order += 1
        return self.order

    # scopes
    def open_scope(self, kind: str) -> None:
        i = self.n_scopes
        self.n_scopes += 1
        out = [i] if kind in ("module", "file") else [i, *self.scope[-1][3]]
        self.scope.append((i, kind, list(self.path), out))
        self.f.scopes.append(self.scope[-1])

    def bind(self, t: Token, kind: str) -> None:
        if t.start not in self.bound:
            self.bound.add(t.start)
            self.f.bindings.append((self.scope[-1][0], t.text, kind, t.start))

    def use(self, t: Token) -> None:
        if t.start not in self.bound:
            self.f.refs.append((self.scope[-1][0], t.text, t.start, self.in_macro))

    def head_uses(self, head: list[Token], params: list[Token]) -> None:
        """Of a method's head: arguments and type parameters are bound, other names but the method's own are used."""
        for t in params:
            self.bind(t, "argument")
        where = False
        first = next((k for k, t in enumerate(head) if t.kind == "open"), len(head))
        for k, t in enumerate(head):
            if t.text == "where":
                where = True
            elif t.kind == "name" and k > first and not (head[k - 1].text == "." and head[k - 1].stop == t.start):
                if where and head[k - 1].text in ("where", "{", ","):
                    self.bind(t, "typeparam")
                else:
                    self.use(t)

    # blocks
    def file(self, size: int, room: int | None) -> Iterator[Facts]:
        self.f.nodes.append((0, -1, "file", None, 0, size))
        self.n_nodes = 1
        yield from self.pieces(("",), room)
        if self.peek():
            p = self.peek()
            raise SyntaxProblem(f"{p.text} has nothing to end", p.start, p.stop)

    def statements(self, stop: tuple[str, ...]) -> None:
        while (p := self.peek()) is not None:
            if p.kind in ("newline", "semicolon", "comma"):
                self.take()
            elif p.kind == "keyword" and (p.text in stop or p.text in ("end", "else", "elseif", "catch", "finally")):
                return
            elif p.kind == "close":
                return
            else:
                self.statement()

    def pieces(self, stop: tuple[str, ...], room: int | None) -> Iterator[Facts]:
        """`statements` of a file or a module that stands in none but modules, giving the facts so far whenever there are over `room`."""
        while (p := self.peek()) is not None:
            if p.kind in ("newline", "semicolon", "comma"):
                self.take()
            elif p.kind == "keyword" and (p.text in stop or p.text in ("end", "else", "elseif", "catch", "finally")):
                return
            elif p.kind == "close":
                return
            elif p.kind == "keyword" and p.text in ("module", "baremodule"):
                opened = self.open_module()
                yield from self.pieces(("end",), room)
                self.close_module(opened)
            else:
                self.statement()
            if room is not None and self.f.size() > room:
                yield self.given()

    def given(self) -> Facts:
        """The facts so far, which are taken away, as is what is known of places that lie behind."""
        out, self.f = self.f, Facts()
        out.nodes.sort()
        at = self.t[self.at - 1].stop
        self.bound = {x for x in self.bound if x >= at}
        self.heads = {x for x in self.heads if x >= at}
        return out

    def node(self, kind: str, name: str | None, start: int) -> int:
        i = self.n_nodes
        self.n_nodes += 1
        self.open[i] = (i, self.parents[-1], kind, name, start, -1)
        self.parents.append(i)
        return i

    def close(self, i: int, stop: int) -> None:
        self.f.nodes.append((*self.open.pop(i)[:5], stop))
        self.parents.pop()

    def end(self, opener: Token) -> int:
        if not self.is_("end"):
            p = self.peek() or self.t[-1]
            raise SyntaxProblem(f"{opener.text} is not closed", opener.start, p.stop)
        return self.take().stop

    def skip_newlines(self) -> None:
        while self.peek() and self.peek().kind in ("newline", "semicolon"):
            self.take()

    def statement(self) -> None:
        p = self.peek()
        if p is None:
            return None
        if p.kind == "keyword":
            word = p.text
            if word in ("module", "baremodule"):
                return self.module()
            if word in ("import", "using"):
                return self.imported()
            if word in ("export", "public"):
                return self.exported()
            if word in ("function", "macro"):
                return self.function()
            if word in ("struct", "mutable", "abstract", "primitive"):
                nxt = self.peek(1)
                if word == "struct" or (nxt and nxt.text in ("struct", "type")):
                    return self.datatype()
            if word in ("const", "global", "local"):
                return self.qualified()
        self.expression()

    def module(self) -> None:
        opened = self.open_module()
        self.statements(("end",))
        self.close_module(opened)

    def open_module(self) -> tuple:
        opener = self.take()
        self.deeper()
        called = self.take() if self.peek() else opener
        name = called.text if called is not opener else ""
        if self.path and self.path[-1] == name:
            self.f.findings.append(("module_name", f"module {name} has its parent's name", opener.start, opener.stop))
        i = self.node(opener.text, name, opener.start)
        if self.top():
            self.f.items.append((self.next_order(), name, [], opener.text, list(self.path), None, None, [], False, opener.start, called.start))
        self.path.append(name)
        saved = self.functions, self.scopes, self.loops
        self.functions = self.scopes = self.loops = 0
        self.open_scope("module")
        return opener, i, saved

    def close_module(self, opened: tuple) -> None:
        opener, i, saved = opened
        self.scope.pop()
        self.functions, self.scopes, self.loops = saved
        self.path.pop()
        self.depth -= 1
        self.close(i, self.end(opener))

    def top(self) -> bool:
        return self.functions == 0 and self.scopes == 0

    def names_until_line(self) -> list[Token]:
        out: list[Token] = []
        while (p := self.peek()) is not None:
            if p.kind in ("newline", "semicolon"):
                if out and out[-1].text in (",", ":", ".") and p.kind == "newline":
                    self.take()
                    continue
                break
            out.append(self.take())
        return out

    def imported(self) -> None:
        keyword = self.take()
        toks = self.names_until_line()
        clauses: list[tuple[int, list[str], list[str], list[str], list[int]]] = []
        colon = False
        dots, path = 0, []
        names: list[str] = []
        called: list[str] = []  # the names' aliases; without names, the module's
        starts: list[int] = []
        alias = False
        for t in toks:
            if t.text == "as":
                alias = True
            elif t.text == ":" and not colon:
                colon, called = True, []
            elif t.kind == "comma":
                alias = False
                if not colon:
                    clauses.append((dots, path, [], called, starts))
                    dots, path, called, starts = 0, [], [], []
            elif alias:
                if t.kind in ("name", "macro"):
                    called = [*called[:-1], t.text] if colon else [t.text]
            elif colon:
                if t.kind in ("name", "macro", "keyword", "op") and t.text != ".":
                    names.append(t.text)
                    called.append(t.text)
                    starts.append(t.start)
            elif t.kind == "op" and set(t.text) == {"."}:
                if not path:
                    dots += len(t.text)
            elif t.kind in ("name", "macro", "keyword"):
                path.append(t.text)
                called, starts = [t.text], [t.start]
        if colon:
            starts = starts[-len(names) :] if names else []
        clauses.append((dots, path, names, called, starts))
        for dots, path, names, called, starts in clauses:
            if path or dots:
                self.f.imports.append((self.next_order(), keyword.text, dots, path, names, list(self.path), keyword.start, called, starts))
                for name in called:
                    self.f.bindings.append((self.scope[-1][0], name, "import", keyword.start))
                if dots - 1 > len(self.path):
                    self.f.findings.append(("relative_import", "more dots than there are modules around", keyword.start, keyword.stop))
        if keyword.text == "using" and not colon:
            self.f.findings.append(("bare_using", "using without a list of names", keyword.start, keyword.stop))

    def exported(self) -> None:
        kind = self.take().text
        for t in self.names_until_line():
            if t.kind in ("name", "macro", "keyword", "op"):
                self.f.exports.append((t.text, kind, list(self.path), t.start))

    def datatype(self) -> None:
        first = self.take()
        self.deeper()
        kind = first.text
        if kind in ("mutable", "abstract", "primitive"):
            self.take()
            kind = {"mutable": "mutable_struct"}.get(kind, kind)
        called = self.take() if self.peek() and self.peek().kind in ("name", "keyword") else first
        name = called.text if called is not first else ""
        i = self.node(kind, name, first.start)
        if self.top():
            self.f.items.append((self.next_order(), name, [], kind, list(self.path), None, None, [], False, first.start, called.start))
        self.functions += 1
        self.open_scope("struct")
        if self.is_("{"):
            stop = self.matching(self.at)
            for k in range(self.at, stop if stop is not None else self.at):
                if self.t[k].kind == "name" and self.t[k - 1].text in ("{", ","):
                    self.bind(self.t[k], "field")
        while self.peek() and self.peek().kind not in ("newline", "semicolon") and not self.is_("end"):
            self.simple()
        self.statements(("end",))
        self.scope.pop()
        self.functions -= 1
        self.depth -= 1
        self.close(i, self.end(first))

    def function(self) -> None:
        opener = self.take()
        self.deeper()
        i = self.node(opener.text, None, opener.start)
        head: list[Token] = []
        depth = 0
        while (p := self.peek()) is not None:
            if depth == 0 and (p.kind in ("newline", "semicolon") or p.text == "end" and p.kind == "keyword"):
                break
            depth += (p.kind == "open") - (p.kind == "close")
            head.append(self.take())
            if depth == 0 and p.kind == "close" and not (self.peek() and self.peek().text in ("::", "where", "(", "{")):
                break
        names, arity, params = signature(head)
        if names and opener.text == "macro":
            names[-1] = "@" + names[-1]
        if names:
            self.open[i] = (*self.open[i][:3], ".".join(names), *self.open[i][4:])
            if self.top():
                self.f.items.append((self.next_order(), names[-1], names[:-1], opener.text, list(self.path), *arity, opener.start, head[min(2 * len(names), len(head)) - 2].start if len(names) > 1 else head[0].start))
        self.duplicates(params)
        self.functions += 1
        saved, self.loops = self.loops, 0
        self.open_scope("function")
        self.head_uses(head, params)
        self.statements(("end",))
        self.scope.pop()
        self.loops = saved
        self.functions -= 1
        self.depth -= 1
        self.close(i, self.end(opener))

    def duplicates(self, params: list[Token]) -> None:
        seen: set[str] = set()
        for t in params:
            if t.text in seen and set(t.text) != {"_"}:
                self.f.findings.append(("duplicate_function_argument", f"{t.text} is an argument twice", t.start, t.stop))
            seen.add(t.text)

    def qualified(self) -> None:
        word = self.take()
        if word.text == "const" and self.is_("local"):
            self.f.findings.append(("global_const_decl", "a local can't be const", word.start, word.stop))
        if self.peek() and self.peek().kind == "keyword":
            return self.statement()
        self.expression("const" if word.text == "const" else "global" if word.text == "global" else "local")

    # expressions
    def expression(self, declared: str | None = None) -> None:
        """To the end of a statement; a declaration, if it is an assignment or a short function at the top."""
        first = self.at
        p = self.peek()
        if p is None:
            return
        saved = self.in_macro, self.functions, self.guards
        around = len(self.scope)
        self.saw[-1] = False
        if p.kind == "name":
            short = self.declaration(declared)
            self.targets(declared)
            self.functions += short
        depth = len(self.parents)
        while (p := self.peek()) is not None:
            if p.kind == "semicolon" or p.kind == "close":
                break
            if p.kind == "newline":
                if self.at > first and continues(self.t[self.at - 1]):
                    self.take()
                    continue
                break
            if p.kind == "keyword" and p.text in ("end", "else", "elseif", "catch", "finally"):
                break
            self.simple()
        assert len(self.parents) == depth
        del self.scope[around:]
        self.in_macro, self.functions, self.guards = saved

    def targets(self, declared: str | None) -> None:
        """Names that the statement at hand assigns to, and what `local` and `global` name."""
        k, own = self.at, []
        while k < self.n and self.t[k].kind == "name":
            own.append(self.t[k])
            k += 1
            if k < self.n and self.t[k].text == "::":
                while k < self.n and self.t[k].text != "=" and self.t[k].kind not in ("newline", "semicolon", "comma"):
                    k += 1
            if k < self.n and self.t[k].kind == "comma":
                k += 1
                continue
            break
        if own and (declared or k < self.n and self.t[k].text == "="):
            kind = "global" if self.top() or declared == "global" else "local"
            if self.scope[-1][1] == "struct":
                kind = "field"
            for t in own:
                self.bind(t, kind)
        elif len(own) == 1 and self.scope[-1][1] == "struct":
            self.bind(own[0], "field")

    def declaration(self, declared: str | None) -> bool:
        """Looks at a statement that begins with a name, without taking it; true, if it is a short function."""
        k, names = self.at, []
        while k < self.n and self.t[k].kind == "name":
            names.append(self.t[k].text)
            if k + 1 < self.n and self.t[k + 1].text == "." and self.t[k + 1].start == self.t[k].stop:
                k += 2
            else:
                k += 1
                break
        if k >= self.n:
            return False
        start = self.t[self.at].start
        if self.t[k].text == "(" and self.t[k].start == self.t[k - 1].stop or self.t[k].text == "{":
            stop = self.matching(k)
            while stop is not None and stop + 1 < self.n and self.t[stop + 1].text in ("::", "where"):
                stop = stop + 2 if stop + 2 < self.n else None
                if stop is not None and stop + 1 < self.n and self.t[stop + 1].kind == "open":
                    stop = self.matching(stop + 1)
            if stop is not None and stop + 1 < self.n and self.t[stop + 1].text == "=":
                names, arity, params = signature(self.t[self.at : stop + 1])
                if names and self.scope[-1][1] != "struct":
                    if self.top():
                        self.f.items.append((self.next_order(), names[-1], names[:-1], "function", list(self.path), *arity, start, self.t[k - 1].start))
                    elif len(names) == 1:
                        self.bind(self.t[self.at], "local")
                    self.duplicates(params)
                    self.bound.add(self.t[self.at].start)
                    self.open_scope("function")
                    self.head_uses(self.t[self.at : stop + 1], params)
                    self.bound.update(t.start for t in self.t[self.at : stop + 1] if t.kind == "name")
                    self.heads.add(self.t[k - 1].start)
                    return True
            return False
        if not self.top() or declared == "local":
            return False
        if self.t[k].text == "::":
            while k < self.n and self.t[k].text != "=" and self.t[k].kind not in ("newline", "semicolon"):
                k += 1
        if k < self.n and self.t[k].text == "=" and len(names) == 1:
            self.f.items.append((self.next_order(), names[0], [], declared or "assignment", list(self.path), None, None, [], False, start, start))
        return False

    def simple(self) -> None:
        """One token, or a bracket or block with all in it."""
        p = self.peek()
        if p.kind == "open":
            return self.brackets()
        if p.kind == "macro":
            return self.macro()
        if p.kind == "keyword":
            if p.text in OPENERS or p.text in ("mutable", "abstract", "primitive"):
                if p.text in ("mutable", "abstract", "primitive"):
                    return self.datatype() if self.peek(1) and self.peek(1).text in ("struct", "type") else self.take()
                return self.block()
            if p.text in ("break", "continue") and not self.loops:
                self.f.findings.append(("break_continue", f"{p.text} outside a loop", p.start, p.stop))
            self.take()
            return None
        if p.kind == "op":
            self.operator()
            if p.text in ("&&", "||", "?") and self.saw[-1]:
                self.guards += 1  # to the end of the statement or bracket
        elif p.kind == "name" and p.text in _GUARDS:
            self.saw[-1] = True
        elif p.kind == "comma":
            self.saw[-1] = False
        prev = self.t[self.at - 1] if self.at else None
        self.take()
        nxt = self.peek()
        if p.kind == "string":
            for name in interpolated(p.text):
                self.f.refs.append((self.scope[-1][0], name, p.start, self.in_macro))
        elif p.kind == "name":
            member = prev is not None and prev.stop == p.start and (prev.text == "." or prev.text == ":" and not (self.at > 2 and self.t[self.at - 3].stop == prev.start and self.t[self.at - 3].kind in ("name", "number", "close")))
            if member and prev.text == "." and (qualifier := self.qualifier(self.at - 2)):
                self.f.members.append((qualifier, p.text, list(self.path), p.start))
            if nxt and nxt.text == "->":
                self.bind(p, "argument")
            elif not member and not (self.named and self.named[-1] and nxt and nxt.text == "="):
                self.use(p)
        if p.kind == "name" and nxt and nxt.kind == "open" and nxt.text == "(" and nxt.start == p.stop:
            self.call(p)
        return None

    def qualifier(self, at: int) -> list[str]:
        """The names before the dot at a place, if nothing but names and dots stand there."""
        out: list[str] = []
        while at > 0 and self.t[at].text == "." and self.t[at - 1].kind == "name" and self.t[at - 1].stop == self.t[at].start:
            out.append(self.t[at - 1].text)
            at -= 2
            if at < 0 or self.t[at].stop != self.t[at + 1].start or self.t[at].text != ".":
                touching = at >= 0 and self.t[at].stop == self.t[at + 1].start and self.t[at].kind in ("name", "close", "string", "number")
                return [] if touching else out[::-1]
        return []

    def operator(self) -> None:
        p, left, right = self.peek(), self.t[self.at - 1] if self.at else None, self.peek(1)
        sides = [x for x in (left, right) if x]
        if p.text in ("==", "!=", "≠", ".==", ".!=", ".≠"):
            if any(x.text in ("NaN", "NaN16", "NaN32", "NaN64") for x in sides):
                self.f.findings.append(("nan_comparison", "a comparison with NaN is never true", p.start, p.stop))
            if p.text in ("==", "!=", "≠") and any(x.text == "nothing" and x.kind == "name" for x in sides):
                self.f.findings.append(("nothing_comparison", "compare nothing with === or !==", p.start, p.stop))
        elif p.text == "*" and any(x.kind == "string" for x in sides):
            self.f.findings.append(("string_concat_style", "strings are joined by *", p.start, p.stop))
        elif p.text == "||" and left and left.text in ("true", "false") and left.kind == "keyword" or p.text == "&&" and any(x.text in ("true", "false") and x.kind == "keyword" for x in sides):
            self.f.findings.append(("pointless_boolean", "a literal decides this", p.start, p.stop))

    def brackets(self, call: bool = False) -> None:
        opener = self.take()
        first = self.at
        stop = self.matching(self.at - 1)
        if stop is not None and stop + 1 < self.n and self.t[stop + 1].text == "->":
            for k in range(first, stop):
                if self.t[k].kind == "name" and self.t[k - 1].kind in ("open", "comma", "semicolon"):
                    self.bind(self.t[k], "argument")
        self.named.append(opener.text == "(")
        self.deeper()
        self.saw.append(False)
        guards, asked = self.guards, False
        while (p := self.peek()) is not None and p.kind != "close":
            prev = self.t[self.at - 1]
            if p.kind == "keyword" and p.text == "end" and opener.text == "[":
                self.take()  # an index
            elif p.kind == "keyword" and p.text in ("for", "if") and self.at > first and prev.kind not in ("comma", "semicolon", "newline", "open") and prev.text not in ("=", "=>", "->", "&&", "||", "?", ":"):
                word = self.take()  # a generator
                if word.text == "for":
                    self.loop_names("generator")
            elif p.kind == "keyword" and p.text in ("end", "else", "elseif", "catch", "finally"):
                raise SyntaxProblem(f"{opener.text} is not closed", opener.start, p.stop)
            else:
                asked |= self.saw[-1]
                if p.kind in ("comma", "semicolon"):
                    self.guards = guards
                self.simple()
        if self.peek() is None:
            raise SyntaxProblem(f"{opener.text} is not closed", opener.start, self.t[-1].stop)
        self.named.pop()
        asked |= self.saw.pop()
        self.saw[-1] |= asked
        self.guards = guards
        self.depth -= 1
        closer = self.take()
        if {"(": ")", "[": "]", "{": "}"}[opener.text] != closer.text:
            raise SyntaxProblem(f"{opener.text} is closed by {closer.text}", opener.start, closer.stop)

    def call(self, callee: Token) -> None:
        stop = self.matching(self.at)
        if stop is None:
            raise SyntaxProblem("( is not closed", self.peek().start, self.t[-1].stop)
        low, high, kws = arguments(self.t[self.at + 1 : stop])
        before = self.t[self.at - 2] if self.at > 1 else None
        own = before is not None and before.text in ("function", "macro", ".") or self.defines(stop) or callee.start in self.heads
        if not own:
            self.f.calls.append((callee.text, low, high, kws, callee.start, self.t[stop].stop))
        inside = [t for t in self.t[self.at + 1 : stop] if t.kind != "newline"] if callee.text in ("include", "includet") else []
        # a call of one argument; a method's own head isn't a call
        if inside and low == high == 1 and not kws and callee.start not in self.heads and not (before is not None and before.text in ("function", "macro", ".")):
            target = static_path(inside) if not self.functions else None
            self.f.includes.append((self.next_order(), target, self.guards > 0, self.test, list(self.path), callee.start))
        self.brackets()

    def defines(self, stop: int) -> bool:
        """Whether the call that ends at stop is the head of a short function."""
        return stop + 1 < self.n and self.t[stop + 1].text == "=" and (self.at < 2 or self.t[self.at - 2].kind in ("newline", "semicolon", "macro"))

    def macro(self) -> None:
        t = self.take()
        self.in_macro = True
        name = t.text.rpartition(".")[2]
        name = name if name.startswith("@") else "@" + name
        if name in _GUARDS:
            self.saw[-1] = True
        if name == "@show":
            self.f.findings.append(("debug_statement", "a debugging statement", t.start, t.stop))
        elif name == "@async":
            self.f.findings.append(("async_task", "a task on the same thread", t.start, t.stop))
        if name in TEST_MACROS:
            label = self.peek().text.strip('"') if self.peek() and self.peek().kind == "string" else self.peek().text if self.peek() and self.peek().kind == "name" else None
            if name != "@testset" and name != "@safetestset":
                self.f.tests.append((name[1:], label, t.start))
                if label is None:
                    self.f.findings.append(("testitem_errors", "a test item needs a name", t.start, t.stop))
            saved = self.test
            if name in TEST_MODULES and self.test is None:
                self.test = self.n_nodes
            self.scopes += 1
            self.in_macro = False
            self.open_scope("test")
            i = self.node(name[1:], label, t.start)
            while (p := self.peek()) is not None and p.kind not in ("newline", "semicolon", "close"):
                if p.kind == "keyword" and p.text == "begin":
                    self.block()
                    break
                self.simple()
            self.close(i, self.t[self.at - 1].stop)
            self.scope.pop()
            self.scopes -= 1
            self.test = saved

    def block(self) -> None:
        opener = self.take()
        kind = opener.text
        if kind in ("function", "macro", "module", "baremodule", "struct"):
            self.at -= 1
            return {"struct": self.datatype, "module": self.module, "baremodule": self.module}.get(kind, self.function)()
        self.deeper()
        i = self.node(kind, None, opener.start)
        loop, scope = kind in ("for", "while"), kind in ("let", "do", "for", "while", "try")
        guarded = 0
        conditions: list[tuple] = []
        if scope:
            self.open_scope(kind)
        if kind in ("if", "while", "for", "let", "do"):
            if kind == "for":
                self.loop_names("loop")
            elif kind in ("do", "let"):
                self.header_names(kind)
            self.condition(kind, conditions)
            guarded = int(kind == "if" and any(x in _GUARDS for x in conditions[-1]))
        self.loops += loop
        self.scopes += scope
        self.guards += guarded
        self.statements(("end", "else", "elseif", "catch", "finally"))
        while self.is_("else", "elseif", "catch", "finally") and self.peek().kind == "keyword":
            word = self.take()
            if word.text == "elseif":
                start = self.at
                self.condition("if", conditions)
                own = conditions[-1]
                if any(x in _GUARDS for x in own):
                    self.guards += 1
                    guarded += 1
                if own and own in conditions[:-1] and "(" not in own and not any(x.startswith("@") for x in own):
                    self.f.findings.append(("duplicate_branch_condition", "an earlier branch has this condition", self.t[start].start, self.t[self.at - 1].stop))
            elif word.text == "catch" and self.peek() and self.peek().kind == "name":
                self.bind(self.take(), "caught")
            self.statements(("end", "else", "elseif", "catch", "finally"))
        if scope:
            self.scope.pop()
        self.guards -= guarded
        self.scopes -= scope
        self.loops -= loop
        self.depth -= 1
        self.close(i, self.end(opener))

    def loop_names(self, kind: str) -> None:
        """Binds the names before `in` of a loop's head, and of the further ones after commas."""
        k, own, depth = self.at, [], 0
        while k < self.n and self.t[k].kind in ("name", "comma", "open", "close"):
            depth += (self.t[k].kind == "open") - (self.t[k].kind == "close")
            if depth < 0:
                return
            if self.t[k].kind == "name":
                if self.t[k].text == "in":
                    break
                own.append(self.t[k])
            k += 1
        if k < self.n and self.t[k].text in ("in", "=", "∈"):
            for t in own:
                self.bind(t, kind)
            self.bound.add(self.t[k].start)
        # for i in a, j in b
        depth = 0
        for j in range(k, self.n - 2):
            t = self.t[j]
            if t.kind == "newline" or depth < 0:
                break
            depth += (t.kind == "open") - (t.kind == "close")
            if depth == 0 and t.kind == "comma" and self.t[j + 1].kind == "name" and self.t[j + 2].text in ("in", "=", "∈"):
                self.bind(self.t[j + 1], kind)
                self.bound.add(self.t[j + 2].start)

    def header_names(self, kind: str) -> None:
        """Binds the arguments of `do` and the names that `let` sets."""
        k, depth = self.at, 0
        while k < self.n and self.t[k].kind not in ("newline", "semicolon"):
            t = self.t[k]
            depth += (t.kind == "open") - (t.kind == "close")
            after = self.t[k - 1].kind in ("comma", "open") or k == self.at
            if t.kind == "name" and (kind == "do" and after or kind == "let" and after and depth == 0):
                self.bind(t, "argument" if kind == "do" else "local")
            k += 1

    def condition(self, kind: str, conditions: list[tuple]) -> None:
        start = self.at
        while (p := self.peek()) is not None:
            if p.kind == "semicolon" or p.kind == "newline" and not (self.at > start and continues(self.t[self.at - 1])) or p.kind == "keyword" and p.text in ("end", "else", "elseif"):
                break
            self.simple()
        own = [t for t in self.t[start : self.at] if t.kind != "newline"]
        conditions.append(tuple(t.text for t in own))
        if kind == "if" and own:
            if len(own) == 1 and own[0].text in ("true", "false"):
                if not (self.at > 2 and self.t[start - 2].text == "@static"):
                    self.f.findings.append(("const_if_condition", "the condition is a literal", own[0].start, own[0].stop))
            else:
                depth = 0
                for t in own:
                    depth += (t.kind == "open") - (t.kind == "close")
                    if t.text == "=" and t.kind == "op" and depth == 0:
                        self.f.findings.append(("const_if_condition", "an assignment as a condition", t.start, t.stop))
        if kind == "for":
            text = [t for t in own if t.kind != "open"]
            if len(text) >= 3 and text[1].text in ("in", "=", "∈") and text[2].kind == "number" and len(text) == 3:
                self.f.findings.append(("incorrect_iter_spec", "a loop over a number", text[2].start, text[2].stop))


_INSIDE = re.compile(r"(?<!\\)\$(?:\(((?:[^()]|\([^()]*\))*)\)|([^\W\d]\w*!?))")
_NAME = re.compile(r"(?<![\w.:@])[^\W\d]\w*!?(?!\s*=[^=])")


def interpolated(text: str) -> list[str]:
    """Names used inside a string's $name and $(...)."""
    out: list[str] = []
    for code, name in _INSIDE.findall(text):
        out += [name] if name else [x for x in _NAME.findall(re.sub(r'"[^"]*"', "", code)) if x not in KEYWORDS]
    return out


def continues(t: Token) -> bool:
    return t.kind == "op" and t.text not in ("'", "...") and t.text != "!" or t.kind in ("comma", "open") or t.text in ("=", "->", "in")


def matching(toks: list[Token], at: int) -> int | None:
    depth = 0
    for k in range(at, len(toks)):
        depth += (toks[k].kind == "open") - (toks[k].kind == "close")
        if depth == 0:
            return k
    return None


def split_arguments(toks: list[Token]) -> tuple[list[list[Token]], list[list[Token]]]:
    """(arguments before the semicolon, those after it)."""
    before: list[list[Token]] = []
    after: list[list[Token]] = []
    into, own, depth = before, [], 0
    for t in toks:
        if depth == 0 and t.kind in ("comma", "semicolon"):
            if own:
                into.append(own)
            own = []
            if t.kind == "semicolon":
                into = after
            continue
        depth += (t.kind == "open" or t.kind == "keyword" and t.text in OPENERS - {"for", "if"}) - (t.kind == "close" or t.kind == "keyword" and t.text == "end")
        if t.kind != "newline":
            own.append(t)
    if own:
        into.append(own)
    return before, after


def arguments(toks: list[Token]) -> tuple[int, int, list[str]]:
    """(fewest, most, keywords) of a call."""
    before, after = split_arguments(toks)
    low, splat, kws = 0, False, []
    for a in before:
        if a[-1].text == "...":
            splat = True
        elif len(a) > 1 and a[0].kind == "name" and a[1].text == "=":
            kws.append(a[0].text)
        elif any(t.kind == "keyword" and t.text == "for" for t in a):
            low += 1
        else:
            low += 1
    kws += [a[0].text for a in after if a[0].kind == "name" and a[-1].text != "..."]
    return low, UNBOUNDED if splat else low, kws


def signature(toks: list[Token]) -> tuple[list[str], tuple, list[Token]]:
    """(names, (fewest, most, keywords, takes any keyword), argument names) of a method's head."""
    k, names = 0, []
    while k < len(toks) and toks[k].kind in ("name", "op", "keyword") and toks[k].text not in ("(", "::", "="):
        if toks[k].text != ".":
            names.append(toks[k].text)
        k += 1
    while k < len(toks) and toks[k].text == "{":
        stop = matching(toks, k)
        if stop is None:
            return names, (None, None, [], False), []
        k = stop + 1
    if k >= len(toks) or toks[k].text != "(":
        return names, (None, None, [], False), []
    stop = matching(toks, k)
    before, after = split_arguments(toks[k + 1 : stop])
    low = high = 0
    params: list[Token] = []
    for a in before:
        if any(t.text == "..." for t in a):
            high = UNBOUNDED
        else:
            optional = any(t.text == "=" for t in a)
            low += not optional
            high = high if high == UNBOUNDED else high + 1
        if a[0].kind == "name":
            params.append(a[0])
    params += [a[0] for a in after if a[0].kind == "name"]
    splat = any(a[-1].text == "..." for a in after)
    return names, (low, high, [a[0].text for a in after if a[0].kind == "name" and a[-1].text != "..."], splat), params


def static_path(toks: list[Token]) -> str | None:
    """The path an include names: a plain string, or joinpath of such and @__DIR__; null if it has to be computed."""
    if len(toks) == 1 and toks[0].kind == "string" and "$" not in toks[0].text:
        return toks[0].text.strip('"')
    if len(toks) > 2 and toks[0].text == "joinpath" and toks[1].text == "(" and toks[-1].text == ")":
        parts = []
        for t in toks[2:-1]:
            if t.kind == "comma" or t.text == "@__DIR__":
                continue
            if t.kind != "string" or "$" in t.text:
                return None
            parts.append(t.text.strip('"'))
        return "/".join(parts) if parts else None
    return None
