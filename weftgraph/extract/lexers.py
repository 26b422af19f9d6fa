"""Lexers of Java, JavaScript, TypeScript and Python with a pushdown stack of open delimiters.

A lexer gives tokens and comments, and stops with :class:`Bad` at an unterminated literal or comment, at a
merge-conflict marker, at a character that no token starts with, and where delimiters don't match or end too early.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple


class Bad(Exception):
    """The text isn't valid: ``kind`` of error and its offset."""

    def __init__(self, kind: str, at: int) -> None:
        super().__init__(kind, at)
        self.kind, self.at = kind, at


class Tokens(NamedTuple):
    kind: list[str]  # id num str chr re tpl head mid tail op markup endmarkup end
    text: list[str]
    at: list[int]
    newline: list[bool]  # a line break lies between this token and the one before
    match: dict[int, int]  # index of an opening delimiter's token -> that of the closing one
    comments: list[tuple[int, int]]


CLOSE = {"(": ")", "[": "]", "{": "}"}
_CONFLICT = re.compile(r"(?m)^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?|\|{7}(?: .*)?)\r?$")
_ID = r"(?:[^\W\d]|\$)(?:\w|\$)*"
_COMMON = r"""(?P<ws>[ \t\f\v\xa0﻿]+)|(?P<nl>\r\n|[\n\r  ])|(?P<cm>//[^\n\r  ]*|/\*.*?\*/)|(?P<badcm>/\*)"""
_NUM = r"0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?[lLnfFdD]?|0[bB][01_]+[lLn]?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[nlLfFdD]?"
_JAVA = re.compile(
    _COMMON
    + r'|(?P<tb>"""[ \t\f]*(?:\r\n|\n|\r)(?:[^\\]|\\.)*?""")|(?P<str>"(?:[^"\\\n\r]|\\.)*")'
    + r"|(?P<chr>'(?:[^'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)')"
    + rf"|(?P<id>{_ID})|(?P<num>{_NUM})"
    + r"|(?P<op>\.\.\.|<<=|->|::|\+\+|--|&&|\|\||==|!=|<=|[+\-*/&|^%]=|<<|[(){}\[\];,.@=<>!~?:+\-*/&|^%])",
    re.S,
)
_JS = re.compile(
    _COMMON
    + r'|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|\'(?:[^\'\\\n\r]|\\(?:\r\n|.))*\')'
    + rf"|(?P<id>\#?{_ID})|(?P<num>{_NUM})"
    + r"|(?P<op>\.\.\.|=>|\*\*=|\*\*|&&=|\|\|=|\?\?=|\?\?|\?\.(?!\d)|===|!==|==|!=|<<=|<<|<=|\+\+|--|&&|\|\||[+\-*/&|^%]=|[(){}\[\];,.@=<>!~?:+\-*/&|^%])"
    + r"|(?P<tick>`)",
    re.S,
)
_TPL = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?:(`)|(\$\{))", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-z]*")
#: Extensions of files with markup elements (fixed values).
MARKUP = (".tsx", ".jsx")
_TAG = re.compile(r"<\s*((?:[^\W\d]|\$)[\w$.:\-]*)?")
_END_TAG = re.compile(r"</\s*((?:[^\W\d]|\$)[\w$.:\-]*)?\s*>")
_BLANK = re.compile(r"(?:\s|//[^\n\r]*|/\*.*?\*/)*", re.S)
_ATTRIBUTE = re.compile(r"(?:[^\W\d]|\$)[\w$:.\-]*")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
#: In TypeScript, ``<`` where an operand may stand opens type parameters if one of these follows.
_TYPE_PARAMETERS = re.compile(r"<\s*(?:const\s+)?(?:[^\W\d]|\$)[\w$]*\s*(?:,|=|extends\b)")
_TYPED_CALL = re.compile(r"<\s*(?:[^\W\d]|\$)[\w$]*\s*>\s*\(")
#: After these words a slash starts a regular expression.
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())


def conflict(text: str) -> int:
    """Offset of the first merge-conflict marker line, or -1.

    A line of seven equals signs alone counts only in company of another marker (it may be an underline).
    """
    hits = list(_CONFLICT.finditer(text))
    if any(h.group()[0] in "<>" for h in hits):
        return hits[0].start()
    return -1


def dialect(language: str, path: str | None) -> str:
    """What :func:`c_tokens` reads a file of a language as."""
    return "java" if language == "java" else "jsx" if (path or "").lower().endswith(MARKUP) else "js"


def c_tokens(text: str, lang: str) -> Tokens:
    """Tokens of Java ('java'), of JavaScript and TypeScript ('js'), and of both with markup elements ('jsx').

    An element is a token ``markup``, the tokens of the expressions in it within their braces, and a token ``endmarkup``.
    """
    rx, jsx = (_JAVA if lang == "java" else _JS), lang == "jsx"
    lang = "js" if jsx else lang
    kind: list[str] = []
    out: list[str] = []
    at: list[int] = []
    newline: list[bool] = []
    comments: list[tuple[int, int]] = []
    match: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    parens: dict[int, bool] = {}  # closing paren -> it ends the head of if, while, for or with
    pos, n, nl = 0, len(text), False
    if text.startswith("﻿"):
        pos = 1
    if lang == "js" and text.startswith("#!", pos):
        pos = (text + "\n").index("\n")

    def push(k: str, t: str, p: int) -> None:
        nonlocal nl
        kind.append(k)
        out.append(t)
        at.append(p)
        newline.append(nl)
        nl = False

    def opened(p: int) -> int:
        """Read the start of a tag at ``p``, up to its attributes."""
        m = _TAG.match(text, p)
        stack.append(("<tag", m.group(1) or ""))
        q = m.end()
        if m.group(1) and text.startswith("<", q):  # type arguments of the element
            depth = 0
            while q < n:
                depth += (text[q] == "<") - (text[q] == ">")
                q += 1
                if not depth:
                    break
        return q

    def markup(p: int) -> int:
        """Read on in the element on top of the stack, up to an expression's brace or the end of the outermost element."""
        while True:
            if stack[-1][0] == "<tag":
                p = _BLANK.match(text, p).end()
                if text.startswith("/>", p) and stack[-1][1]:
                    stack.pop()
                    p += 2
                elif text.startswith(">", p):
                    stack[-1] = ("<kids", stack[-1][1])
                    p += 1
                    continue
                elif text.startswith("{", p):
                    stack.append(("{", len(kind)))
                    push("op", "{", p)
                    return p + 1
                else:
                    m = _ATTRIBUTE.match(text, p) if stack[-1][1] else None
                    if m is None:
                        raise Bad("premature end" if p >= n else "unexpected token", p)
                    p = _BLANK.match(text, m.end()).end()
                    if text.startswith("=", p):
                        p = _BLANK.match(text, p + 1).end()
                        m = _QUOTED.match(text, p)
                        if m:
                            p = m.end()
                        elif text.startswith("<", p):
                            p = opened(p)
                        elif not text.startswith("{", p):
                            raise Bad("premature end" if p >= n else "unterminated literal" if text[p] in "\"'" else "unexpected token", p)
                    continue
            else:
                while p < n and text[p] not in "{}<>":
                    p += 1
                if text.startswith("{", p):
                    stack.append(("{", len(kind)))
                    push("op", "{", p)
                    return p + 1
                if not text.startswith("<", p):
                    raise Bad("premature end" if p >= n else "unexpected token", min(p, n - 1))
                if not text.startswith("</", p):
                    p = opened(p)
                    continue
                m = _END_TAG.match(text, p)
                if m is None or (m.group(1) or "") != stack[-1][1]:
                    raise Bad("unbalanced delimiter", p)
                stack.pop()
                p = m.end()
            if not stack or stack[-1][0] not in ("<tag", "<kids"):
                push("endmarkup", "", p)
                return p

    match_at = rx.match
    while pos < n:
        m = match_at(text, pos)
        if m is None:
            raise Bad("unterminated literal" if text[pos] in "\"'" else "stray character", pos)
        g, start = m.lastgroup, pos
        pos = m.end()
        if g == "ws":
            continue
        if g == "nl":
            nl = True
            continue
        t = m.group()
        if g == "cm":
            comments.append((start, pos))
            if "\n" in t or "\r" in t:
                nl = True
            continue
        if g == "badcm":
            raise Bad("unterminated comment", start)
        if g == "op":
            if lang == "js" and t in ("/", "/=") and _regex_next(kind, out, parens):
                r = _REGEX.match(text, start)
                if r is None:
                    raise Bad("unterminated literal", start)
                pos = r.end()
                push("re", r.group(), start)
                continue
            i = len(kind)
            if jsx and t == "<" and _opens_markup(text, start, kind, out, parens):
                push("markup", "", start)
                pos = markup(opened(start))
                continue
            if t in CLOSE:
                stack.append((t, i))
            elif t in ")]}":
                if t == "}" and stack and stack[-1][0] == "`":
                    h = _TPL.match(text, pos)
                    if h is None:
                        raise Bad("unterminated literal", start)
                    pos = h.end()
                    if h.group(1):
                        stack.pop()
                        push("tail", "`", start)
                    else:
                        push("mid", "}", start)
                    continue
                if not stack or CLOSE.get(stack[-1][0]) != t:
                    raise Bad("unbalanced delimiter", start)
                o = stack.pop()[1]
                match[o] = i
                if t == ")":
                    parens[i] = o > 0 and out[o - 1] in ("if", "while", "for", "with") and (o < 2 or out[o - 2] != ".")
            kind.append("op")
            out.append(t)
            at.append(start)
            newline.append(nl)
            nl = False
            if jsx and t == "}" and stack and stack[-1][0] in ("<tag", "<kids"):
                pos = markup(pos)
        elif g == "tick":
            h = _TPL.match(text, pos)
            if h is None:
                raise Bad("unterminated literal", start)
            pos = h.end()
            if h.group(1):
                push("tpl", text[start:pos], start)
            else:
                stack.append(("`", len(kind)))
                push("head", "`", start)
        else:
            if g == "num" and pos < n and (text[pos].isalpha() or text[pos] in "_$"):
                raise Bad("stray character", pos)
            kind.append("str" if g == "tb" else g)
            out.append(t)
            at.append(start)
            newline.append(nl)
            nl = False
    if stack:
        raise Bad("premature end", n)
    push("end", "", n)
    return Tokens(kind, out, at, newline, match, comments)


def _opens_markup(text: str, at: int, kind: list[str], out: list[str], parens: dict[int, bool]) -> bool:
    """Whether ``<`` at ``at`` opens an element: an operand may stand there and it's no list of type parameters."""
    after = text[at + 1 : at + 2]
    if not (after.isalpha() or after in ("_", "$", ">")) or not _regex_next(kind, out, parens) or _TYPE_PARAMETERS.match(text, at):
        return False
    if _TYPED_CALL.match(text, at) and out:
        if out[-1] == "=":  # type F = <T>(x: T) => T
            i = len(out) - 2
            while i >= 0 and out[i] not in (";", "{", "}"):
                if out[i] == "type" and kind[i] == "id":
                    return False
                i -= 1
        return out[-1] != ":" or "</" in text[at:]
    return True


def _regex_next(kind: list[str], out: list[str], parens: dict[int, bool]) -> bool:
    if not kind:
        return True
    k, t = kind[-1], out[-1]
    if k == "id":
        return t in _BEFORE_REGEX and not (len(out) > 1 and out[-2] in (".", "?."))
    if k == "op":
        return parens.get(len(kind) - 1, False) if t == ")" else t not in ("]", "}", "++", "--")
    return k in ("head", "mid")


# --- Python ---------------------------------------------------------------------------------------------------

_PY_STR = re.compile(r"""(?i:(?:[rbuf]|br|rb|fr|rf)?)('''|\"\"\"|'|")""")
_PY = re.compile(
    r"""(?P<ws>[ \t\f]+|\\\r?\n)|(?P<nl>\r\n|[\n\r])|(?P<cm>\#[^\n\r]*)"""
    + rf"|(?P<num>{_NUM.replace('[nlLfFdD]?', '[jJ]?')})|(?P<id>[^\W\d]\w*)"
    + r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|[+\-*/%&|^@]=|[(){}\[\],.:;=<>+\-*/%&|^~@])"
)


@lru_cache(maxsize=16)
def _py_end(quote: str, raw: bool) -> re.Pattern:
    body = r"(?:[^\\]|\\.)*?" if len(quote) == 3 else r"(?:[^\\\n\r]|\\(?:\r\n|.))*?"
    return re.compile(body + re.escape(quote), re.S)


def py_tokens(text: str) -> Tokens:
    """Tokens of Python; ``newline`` marks the first token of a logical line (a line break inside brackets isn't one)."""
    kind: list[str] = []
    out: list[str] = []
    at: list[int] = []
    newline: list[bool] = []
    comments: list[tuple[int, int]] = []
    match: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    pos, n, nl = 1 if text.startswith("﻿") else 0, len(text), True
    while pos < n:
        s = _PY_STR.match(text, pos)
        if s:
            e = _py_end(s.group(1), False).match(text, s.end())
            if e is None:
                raise Bad("unterminated literal", pos)
            kind.append("str")
            out.append(text[pos : e.end()])
            at.append(pos)
            newline.append(nl)
            nl, pos = False, e.end()
            continue
        m = _PY.match(text, pos)
        if m is None:
            raise Bad("stray character", pos)
        g, t, start = m.lastgroup, m.group(), pos
        pos = m.end()
        if g == "ws":
            continue
        if g == "nl":
            nl = nl or not stack
            continue
        if g == "cm":
            comments.append((start, pos))
            continue
        if g == "op":
            if t in CLOSE:
                stack.append((t, len(kind)))
            elif t in ")]}":
                if not stack or CLOSE[stack[-1][0]] != t:
                    raise Bad("unbalanced delimiter", start)
                match[stack.pop()[1]] = len(kind)
        kind.append("op" if g == "op" else g)
        out.append(t)
        at.append(start)
        newline.append(nl)
        nl = False
    if stack:
        raise Bad("premature end", n)
    kind.append("end")
    out.append("")
    at.append(n)
    newline.append(True)
    return Tokens(kind, out, at, newline, match, comments)
