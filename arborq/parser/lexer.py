"""Tokens of Julia source: (kind, text, start, stop), in code points. Comments and blanks are left out, line ends are not."""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

#: The language's reserved words, and those that open a block which `end` closes.
KEYWORDS = frozenset("baremodule begin break catch const continue do else elseif end export false finally for function global if import let local macro module quote return struct true try using while mutable abstract primitive type where public".split())
OPENERS = frozenset("baremodule begin do for function if let macro module quote struct try while".split())

_TOKEN = re.compile(
    r"""
    (?P<blank>[ \t\r ]+)
  | (?P<newline>\n)
  | (?P<comment>\#(?!=)[^\n]*)
  | (?P<block>\#=)
  | (?P<macro>@(?:[^\W\d][\w!]*\.)*[^\W\d][\w!]*|@\.)
  | (?P<number>0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|(?:\d[\d_]*\.?(?!\.)[\d_]*|\.\d[\d_]*)(?:[eEf][+-]?\d+)?)
  | (?P<char>'(?:\\(?:x[0-9a-fA-F]+|u[0-9a-fA-F]+|.)|[^\\'\n])')
  | (?P<name>(?:[^\W\d]|[∀-⋿₀-ₜ′])[\w!′₀-ₜ]*)
  | (?P<open>[(\[{])
  | (?P<close>[)\]}])
  | (?P<semicolon>;)
  | (?P<comma>,)
  | (?P<op>\.{3}|===|!==|\.?==|\.?!=|\.?<=|\.?>=|\.?≠|\|>|<\||->|=>|<:|>:|::|\.?&&|\.?\|\||\.?[-+*/^\\%÷&|⊻<>]=?|[-+*/^%&|]=|:=|=|\.=|!|~|\?|:|\.|\$|√|∈|∉|⊆)
""",
    re.VERBOSE,
)


@dataclass(frozen=True, slots=True)
class Token:
    kind: str
    text: str
    start: int
    stop: int


class SyntaxProblem(Exception):
    def __init__(self, message: str, start: int, stop: int):
        super().__init__(message)
        self.message, self.start, self.stop = message, start, stop


def _string(text: str, at: int, quote: str) -> int:
    """Where a string ends that begins (after its quotes) at `at`; $(...) inside is skipped, strings in it too."""
    n = len(text)
    while at < n:
        if text.startswith(quote, at):
            return at + len(quote)
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "$" and at + 1 < n and text[at + 1] == "(":
            depth, at = 1, at + 2
            while at < n and depth:
                if text[at] == '"':
                    inner = '"""' if text.startswith('"""', at) else '"'
                    at = _string(text, at + len(inner), inner)
                    continue
                depth += (text[at] == "(") - (text[at] == ")")
                at += 1
        else:
            at += 1
    raise SyntaxProblem("a string is not closed", min(at, n), n)


#: Kinds of tokens; a token's is kept as its place here.
KINDS = ("name", "keyword", "newline", "macro", "number", "char", "open", "close", "semicolon", "comma", "op", "string", "command", "rawstring", "other")
_CODES = {kind: code for code, kind in enumerate(KINDS)}


def tokens(text: str) -> list[Token]:
    return list(Tokens(text))


class Tokens:
    """All tokens of a text as a sequence that holds nine bytes for each; those near the last one asked for are there as Token."""

    WINDOW = 4096

    def __init__(self, text: str):
        self.text = text
        self.kinds, self.starts, self.stops = bytearray(), array("i"), array("i")
        self.base, self.window = 0, []
        self._read()

    def __len__(self) -> int:
        return len(self.kinds)

    def __getitem__(self, k):
        try:
            i = k - self.base
        except TypeError:  # a slice
            return [self[i] for i in range(*k.indices(len(self.kinds)))]
        if 0 <= i < len(self.window):
            return self.window[i]
        n = len(self.kinds)
        if k < 0:
            k += n
        if not 0 <= k < n:
            raise IndexError(k)
        if not -self.WINDOW <= k - self.base < 2 * self.WINDOW:  # a look far away
            return self._token(k)
        self.base = max(0, k - 64)
        self.window = [self._token(j) for j in range(self.base, min(n, self.base + self.WINDOW))]
        return self.window[k - self.base]

    def _token(self, k: int) -> Token:
        start, stop = self.starts[k], self.stops[k]
        return Token(KINDS[self.kinds[k]], self.text[start:stop], start, stop)

    def _is(self, back: int, word: str) -> bool:
        """Whether the last token but `back` is that text."""
        return len(self.kinds) > back and self.text[self.starts[-1 - back] : self.stops[-1 - back]] == word

    def _put(self, kind: str, start: int, stop: int) -> None:
        self.kinds.append(_CODES[kind])
        self.starts.append(start)
        self.stops.append(stop)

    def _read(self) -> None:
        text, kinds, starts, stops = self.text, self.kinds, self.starts, self.stops
        name, number, close = _CODES["name"], _CODES["number"], _CODES["close"]
        at, n = 0, len(text)
        while at < n:
            c = text[at]
            if c in '"`':
                quote = c * 3 if text.startswith(c * 3, at) else c
                stop = _string(text, at + len(quote), quote)
                if kinds and kinds[-1] == name and stops[-1] == at:  # r"..." and the like
                    kinds[-1], stops[-1] = _CODES["rawstring"], stop
                else:
                    self._put("string" if c == '"' else "command", at, stop)
                at = stop
                continue
            m = _TOKEN.match(text, at)
            if c == "'" and (not m or m.lastgroup != "char" or (kinds and stops[-1] == at and (kinds[-1] in (name, close, number) or self._is(0, "'")))):
                self._put("op", at, at + 1)  # an adjoint
                at += 1
                continue
            if not m:
                self._put("other", at, at + 1)
                at += 1
                continue
            kind = m.lastgroup
            if kind == "block":
                depth, k = 1, at + 2
                while depth:
                    o, e = text.find("#=", k), text.find("=#", k)
                    if e < 0:
                        raise SyntaxProblem("a comment is not closed", at, n)
                    if 0 <= o < e:
                        depth, k = depth + 1, o + 2
                    else:
                        depth, k = depth - 1, e + 2
                at = k
                continue
            stop = m.end()
            if kind == "number" and m.group().endswith(".") and stop < n and (text[stop].isalpha() or text[stop] in "*/^+-"):
                stop -= 1  # 1.method or 1.*x
            if kind not in ("blank", "comment"):
                if kind == "name" and text[at:stop] in KEYWORDS and not (kinds and stops[-1] == at and (self._is(0, ".") or self._is(0, ":") and (len(kinds) < 2 or kinds[-2] not in (name, number, close) or stops[-2] != starts[-1]))):
                    kind = "keyword"
                self._put(kind, at, stop)
            at = stop
