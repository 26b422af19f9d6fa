"""Source files to nodes, edges and errors.

Per file (independently, in Arrow-fed tasks) the acceptors give types, functions and fields with their exact extent;
Python files go through the interpreter's syntax tree. Node ids are qualified names, edge ids ``source_type_target``.
Files that don't parse give an error row instead of an exception.
"""

from __future__ import annotations

import ast
import builtins
import re
import sys
import warnings
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.extract import frameworks
from weftgraph.extract.grammar import Java, Script
from weftgraph.extract.lexers import Bad, Tokens, c_tokens, dialect
from weftgraph.graph import Graph, first_wins
from weftgraph.session import written

LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".java": "java", ".py": "python"}
#: Names that look like calls but aren't (fixed values).
NO_CALL = frozenset("if for while switch catch return throw new super this function typeof await synchronized try assert do else import require".split())
JAVA_LANG = frozenset("String Object Integer Long Double Float Boolean Byte Short Character Number Math System Thread Runnable Exception RuntimeException Error Throwable Iterable Comparable CharSequence StringBuilder Class Enum Record Void IllegalStateException IllegalArgumentException NullPointerException UnsupportedOperationException IndexOutOfBoundsException ArithmeticException ClassCastException InterruptedException".split())
BUILTIN_TYPES = frozenset("int long double float boolean byte short char void var str bool list dict set tuple object bytes None".split())
PY_BUILTIN_BASES = frozenset(n for n in dir(builtins) if n[0].isupper()) | {"object", "dict", "list", "int", "str", "tuple", "set", "type"}
MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed export async readonly declare override const".split())
_EXCEPTION = re.compile(r"(?:Exception|Error)$")


class Sheet:
    """What one file yields."""

    def __init__(self, project: str, path: str, language: str) -> None:
        self.project, self.path, self.language = project, path, language
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.errors: list[dict] = []

    def node(self, kind: str, name: str, qn: str, start: int | None = None, end: int | None = None, **more) -> str:
        self.nodes.append({"id": qn, "type": kind, "name": name, "qualified_name": qn, "start_line": start, "end_line": end, "modifiers": [], "annotations": [], "parameters": [], "return_type": None, "description": None} | more)
        return qn

    def edge(self, kind: str, source: str, target: str, line: int | None = None) -> None:
        self.edges.append({"id": f"{source}_{kind}_{target}", "type": kind, "source": source, "target": target, "line": line})

    def error(self, message: str, line: int | None = None) -> None:
        self.errors.append({"message": message, "line": line, "severity": "error"})


# --- documentation, annotations, calls --------------------------------------------------------------------------


def documentation(comment: str) -> dict[str, list[str]]:
    """A comment's prose under '' and its tags (``@param`` and the like, or the sections of a docstring) by name."""
    text = re.sub(r"^/\*+|\*+/$", "", comment.strip())
    text = re.sub(r"(?m)^\s*(?:\*|//+|#+)\s?", "", text)
    out: dict[str, list[str]] = {"": []}
    at = ""
    for line in text.strip().splitlines():
        bare = line.strip()
        tag = re.match(r"@(\w+)\s*(.*)|:(\w+)\s*([^:]*):\s*(.*)", bare)
        section = re.match(r"(Args|Arguments|Parameters|Returns?|Raises|Yields?|Examples?|Attributes|Notes?):\s*$", bare)
        if tag:
            at = tag.group(1) or tag.group(3)
            out.setdefault(at, []).append((tag.group(2) if tag.group(1) else f"{tag.group(4)} {tag.group(5)}".strip()) or "")
        elif section:
            at = section.group(1).lower()
            out.setdefault(at, [])
        elif bare:
            if at and out[at] and not re.match(r"\w+\s*(\(.*\))?:", bare):
                out[at][-1] = f"{out[at][-1]} {bare}".strip()
            else:
                out[at].append(bare)
    return out


def split_arguments(text: str) -> list[str]:
    """Arguments at the outer level: commas inside brackets, type arguments or quotes don't split.

    The text is cut by the lexer; ``<`` opens type arguments only if its ``>`` comes before the next argument's operator.
    """
    try:
        tokens = c_tokens(text, "js")
    except Bad:
        return [text.strip()] if text.strip() else []
    cuts, i = [], 0
    while tokens.kind[i] != "end":
        if tokens.text[i] == "<" and tokens.kind[i] == "op":
            i = _generic_end(tokens, i)
        elif tokens.kind[i] == "op" and tokens.text[i] == ",":
            cuts.append(tokens.at[i])
        i = tokens.match.get(i, i) + 1
    parts = [text[a:b].strip() for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)])]
    return parts[:-1] + [p for p in parts[-1:] if p]


def _generic_end(tokens: Tokens, i: int) -> int:
    """The token that closes type arguments opened at token ``i``, or ``i`` if it's a comparison: types hold names, dots, commas, ? and []."""
    depth, j = 0, i
    while tokens.kind[j] in ("id", "op"):
        t = tokens.text[j]
        depth += (t == "<") - (t == ">")
        if not depth:
            return j if tokens.text[j + 1] in ("", "(", ")", ",", ".", ">", "[", "::", "{") else i
        if tokens.kind[j] == "op" and t not in ("<", ">", ",", ".", "?", "[", "]", "&", "|"):
            return i
        j += 1
    return i


def argument_type(value: str) -> str:
    if re.fullmatch(r"([\"'`]).*\1", value, re.S):
        return "string"
    if value in ("true", "false", "True", "False"):
        return "boolean"
    if value in ("null", "None", "undefined"):
        return "null"
    if re.fullmatch(r"[-+]?\d[\d_.]*[lLfFdD]?", value):
        return "number"
    return "collection" if value[:1] in "[{(" else "identifier"


def annotation(name: str, arguments: str | None, line: int, language: str, imports: dict[str, str] | None = None) -> dict:
    """An annotation with its parameters, framework and category (null where unknown), if need be from the file's imports."""
    params = []
    for i, a in enumerate(split_arguments(arguments or "")):
        m = re.match(r"(\w+)\s*[=:]\s*(?!=)(.*)", a, re.S)
        key, value = (m.group(1), m.group(2)) if m and a[:1] not in "\"'{[" else (f"arg{i}" if i else "value", a)
        params.append({"name": key, "value": value, "type": argument_type(value)})
    own, lang = name.removeprefix("@"), "typescript" if language == "javascript" else language
    source = (imports or {}).get(own.split(".")[0])
    known = frameworks.known(lang).get(own) or source and frameworks.by_import(lang, source)
    return {"name": name if language == "python" else "@" + name, "type": "decorator" if language != "java" else "annotation", "source_line": line, "framework": known and known[0], "category": known and known[1], "parameters": params}


def calls(text: str, language: str, imports: dict[str, str], known: dict[str, str]) -> list[dict]:
    """Calls in a piece of code: ``target, kind, line, receiver``; kinds are constructor, super, static, instance, function."""
    out = []
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        for n in ast.walk(tree):
            if isinstance(n, ast.Call):
                f = n.func
                if isinstance(f, ast.Name):
                    out.append({"target": imports.get(f.id, known.get(f.id, f.id)), "kind": "constructor" if f.id[:1].isupper() else "function", "line": n.lineno, "receiver": None})
                elif isinstance(f, ast.Attribute):
                    r = ast.unparse(f.value)
                    sup = r == "super()"
                    base = imports.get(r.split(".")[0])
                    out.append({"target": f.attr if sup or r == "self" or not base else f"{base}{r[len(r.split('.')[0]) :]}.{f.attr}", "kind": "super" if sup else "static" if r[:1].isupper() or base else "instance", "line": n.lineno, "receiver": r})
        return out
    try:
        t = c_tokens(text, "java" if language == "java" else "js")
    except Bad:
        return []
    return token_calls(t, 0, len(t.kind) - 1, imports, known, lambda p: text.count("\n", 0, p) + 1)


def token_calls(t: Tokens, a: int, z: int, imports: dict[str, str], known: dict[str, str], line_of) -> list[dict]:
    out = []
    for i in range(a, z):
        if t.kind[i] != "id" or t.text[i + 1] != "(" or t.text[i] in NO_CALL:
            if not (t.kind[i] == "id" and t.text[i] == "super" and t.text[i + 1] == "("):
                continue
        name, before = t.text[i], t.text[i - 1] if i else ""
        receiver = t.text[i - 2] if before in (".", "?.") and i > 1 else None
        if name == "super" or receiver == "super":
            kind = "super"
        elif before == "new" or receiver and i > 3 and t.text[i - 3] == "new":
            kind = "constructor"
        elif before in (".", "?."):
            kind = "static" if receiver and receiver[:1].isupper() else "instance"
        else:
            kind = "function"
        target = imports.get(name, known.get(name, name)) if receiver is None or receiver == "this" else f"{imports[receiver]}.{name}" if receiver in imports else name
        out.append({"target": target, "kind": kind, "line": line_of(t.at[i]), "receiver": receiver})
    return out


# --- Java, JavaScript, TypeScript -------------------------------------------------------------------------------


def _java_imports(t: Tokens) -> tuple[str | None, dict[str, str]]:
    package, imports, i = None, {}, 0
    while i < len(t.kind) - 1 and t.text[i] not in ("class", "interface", "enum", "{"):
        if t.text[i] in ("package", "import"):
            z = t.text.index(";", i)
            words = [x for x in t.text[i + 1 : z] if x != "static"]
            name = "".join(words)
            if t.text[i] == "package":
                package = name
            elif not name.endswith("*"):
                imports[name.rsplit(".", 1)[-1]] = name
            i = z
        i += 1
    return package, imports


_IMPORT = re.compile(r"""import\s+(?:type\s+)?([^'"();]*?)\s*from\s*['"]([^'"]+)['"]|(?:const|let|var)\s+([^=;]+?)\s*=\s*require\(\s*['"]([^'"]+)['"]\s*\)""")


def _js_imports(text: str) -> dict[str, str]:
    out = {}
    for m in _IMPORT.finditer(text):
        what, module = (m.group(1), m.group(2)) if m.group(2) else (m.group(3), m.group(4))
        for part in re.split(r"[{},]", what):
            names = re.split(r"\s+as\s+|\s*:\s*", part.strip().removeprefix("type "))
            if names[-1] and re.fullmatch(r"[\w$]+", names[-1]):
                whole = names[0] in ("*", names[-1]) and "{" not in what
                out[names[-1]] = module if whole else f"{module}.{names[0]}"
    return out


def _dotted(path: str) -> str:
    """A module's dotted name from its path, without source folders and extension."""
    base = re.sub(r"\.\w+$", "", path).strip("/")
    base = re.sub(r"^(?:.*/)?src/(?:main|test)/java/|^(?:\./)?(?:src|lib|app)/", "", base)
    return base.replace("/", ".")


def c_like(sheet: Sheet, text: str, extended: bool = True) -> None:
    java = sheet.language == "java"
    t = c_tokens(text, dialect(sheet.language, sheet.path))
    p = Java(t) if java else Script(t, sheet.language == "typescript")
    p.file()
    breaks = [0, *(m.end() for m in re.finditer(r"\r\n|\n|\r", text))]
    line = lambda at: bisect_right(breaks, at)
    if java:
        package, imports = _java_imports(t)
        home = package if package is not None else _dotted(sheet.path).rpartition(".")[0]
        if home:
            sheet.node("package", home.rsplit(".", 1)[-1], home)
        file = re.sub(r"\.\w+$", "", sheet.path.rsplit("/", 1)[-1])
        module = sheet.node("module", file, f"{home}.{file}#module" if home else f"{file}#module", 1, len(breaks))
        if home:
            sheet.edge("belongs_to", module, home)
    else:
        imports, home = _js_imports(text), _dotted(sheet.path)
        module = sheet.node("module", home.rsplit(".", 1)[-1], home, 1, len(breaks))
    names: dict[str, str] = {}
    for ty in sorted(p.declared, key=lambda d: d.start):
        own = t.text[ty.name]
        names[own] = f"{names[ty.owner]}.{own}" if ty.owner in names else f"{home}.{own}" if home else own

    def resolve(name: str) -> str:
        if name in names:
            return names[name]
        if name in imports:
            return imports[name]
        if java:
            return f"java.lang.{name}" if name in JAVA_LANG else f"{home}.{name}" if home else name
        return f"typescript.{name}" if name in ("Error", "Array", "Map", "Set", "Promise", "Object", "Date", "Function", "EventTarget") else f"{home}.{name}"

    def head(start: int, name: int) -> dict:
        mods, notes, i = [], [], start
        while i < name:
            if t.text[i] == "@" and t.kind[i + 1] == "id":
                j = i + 2
                while t.text[j] == ".":
                    j += 2
                called = "".join(t.text[i + 1 : j])
                args = None
                if t.text[j] == "(" and j in t.match:
                    args = text[t.at[j] + 1 : t.at[t.match[j]]]
                    j = t.match[j] + 1
                notes.append(annotation(called, args, line(t.at[i]), sheet.language, imports))
                i = j
                continue
            if t.text[i] in MODIFIERS and t.kind[i] == "id":
                mods.append(t.text[i])
            i += 1
        before = [c for c in t.comments if c[1] <= t.at[start] and not text[c[1] : t.at[start]].strip()]
        doc = text[before[-1][0] : before[-1][1]] if before and text[before[-1][0] : before[-1][1]].startswith("/**") else None
        return {"modifiers": mods, "annotations": notes, "description": " ".join(documentation(doc)[""]) or None if doc else None}

    for ty in p.declared:
        own = t.text[ty.name]
        qn = names[own]
        kind = {"record": "class"}.get(ty.kind, ty.kind)
        bases = [*ty.extends, *ty.implements]
        if extended and kind == "class" and any(_EXCEPTION.search(b) for b in ty.extends):
            kind = "exception"
        sheet.node(kind, own, qn, line(t.at[ty.start]), line(t.at[ty.close]) if ty.close >= 0 else None, **head(ty.start, ty.name))
        if ty.owner in names:
            sheet.edge("contains", names[ty.owner], qn)
        elif home:
            sheet.edge("belongs_to", qn, home)
        for b in ty.extends:
            sheet.edge("extends", qn, resolve(b))
        for b in ty.implements:
            sheet.edge("implements", qn, resolve(b))
        del bases
    methods = {(f.owner, t.text[f.name]) for f in p.found}
    for f in p.found:
        own = t.text[f.name]
        owner = names.get(f.owner)
        if java and owner is None:
            continue
        qn = f"{owner}.{own}" if owner else f"{home}.{own}"
        opened = next((j for j in range(f.name, len(t.kind)) if t.text[j] == "("), -1)
        params = []
        for a in split_arguments(text[t.at[opened] + 1 : t.at[t.match[opened]]]) if opened in t.match else []:
            a = re.sub(r"@\w+(?:\([^)]*\))?\s*|\b(?:final|public|private|protected|readonly)\s+", "", a).split("=")[0].strip()
            m = re.match(r"(.+?)\s+(\w+)$", a, re.S) if java else re.match(r"(?:\.\.\.)?([\w$]+)\??\s*(?::\s*(.+))?$", a, re.S)
            params.append({"name": (m.group(2) if java else m.group(1)) if m else a, "type": (m.group(1) if java else m.group(2)) if m else None, "description": None})
        returns = None
        if java:
            words = [i for i in range(f.start, f.name)]
            keep = [i for i in words if t.text[i] not in MODIFIERS]
            while keep and t.text[keep[0]] == "@":
                skip = keep[0] + 2
                skip = t.match[skip] + 1 if t.text[skip] == "(" and skip in t.match else skip
                keep = [i for i in keep if i >= skip and t.text[i] not in MODIFIERS]
            returns = text[t.at[keep[0]] : t.at[f.name]].strip() if keep else None
        elif opened in t.match and t.text[t.match[opened] + 1] == ":":
            a = t.match[opened] + 2
            z = f.open if f.open >= 0 else a + 1
            returns = text[t.at[a] : t.at[z]].strip().removesuffix("=>").strip()
        sheet.node("method" if owner else "function", own, qn, line(t.at[f.start]), line(t.at[f.close]) if f.close >= 0 else line(t.at[f.name]), parameters=params, return_type=returns, **head(f.start, f.name))
        sheet.edge("contains" if owner else "belongs_to", owner if owner else qn, qn if owner else module)
        if f.close >= 0:
            known = {n: f"{names[o]}.{n}" if o in names else f"{home}.{n}" for o, n in methods if o == f.owner or o is None}
            for c in token_calls(t, f.open if f.open >= 0 else f.name + 1, f.close + 1, imports, known | names, line):
                if c["kind"] != "super":
                    sheet.edge("calls", qn, c["target"] if "." in c["target"] or not home else f"{home}.{c['target']}", c["line"])
            if extended and java:
                z = t.match.get(opened, f.open)
                if t.text[z + 1] == "throws":
                    for b in p.names_between(z + 2, f.open):
                        if b != "throws":
                            sheet.edge("throws", qn, resolve(b))
    functions = {f.name for f in p.found}
    for name, start, owner_name in p.fields:
        if name in functions:
            continue
        owner = names.get(owner_name)
        own = t.text[name]
        qn = f"{owner}.{own}" if owner else f"{home}.{own}"
        kind = None
        if java:
            i = name - 1
            while i > start and t.text[i] in (">", "]", "[", ",", "?") or i > start and t.text[i - 1] in ("<", ","):
                i -= 1
            kind = next((t.text[j] for j in range(start, name) if t.kind[j] == "id" and t.text[j] not in MODIFIERS and t.text[j - 1] != "@"), None)
        elif t.text[name + 1] == ":" and t.kind[name + 2] == "id":
            kind = t.text[name + 2]
        sheet.node("field", own, qn, line(t.at[start]), line(t.at[name]), return_type=kind, **head(start, name))
        sheet.edge("contains" if owner else "belongs_to", owner if owner else qn, qn if owner else module)
        if kind and kind not in BUILTIN_TYPES and kind[:1].isupper():
            sheet.edge("references", qn, resolve(kind))


# --- Python -----------------------------------------------------------------------------------------------------


def python(sheet: Sheet, text: str, extended: bool = True) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    home = _dotted(sheet.path)
    if home.endswith("__init__"):
        home = home.rpartition(".")[0] or home
    lines = text.count("\n") + 1
    if not home.endswith("__main__"):
        sheet.node("module", home.rsplit(".", 1)[-1], home, 1, lines, description=(ast.get_docstring(tree) or "").split("\n")[0] or None)
    imports: dict[str, str] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports |= {(a.asname or a.name).split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            imports |= {a.asname or a.name: f"{'.' * n.level}{n.module or ''}.{a.name}".lstrip(".") for a in n.names}
    names = {n.name: f"{home}.{n.name}" for n in tree.body if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)}

    def decorators(node) -> list[dict]:
        out = []
        for d in node.decorator_list:
            f = d.func if isinstance(d, ast.Call) else d
            args = ", ".join([*(ast.unparse(a) for a in d.args), *(f"{k.arg}={ast.unparse(k.value)}" for k in d.keywords)]) if isinstance(d, ast.Call) else None
            out.append(annotation(ast.unparse(f), args, d.lineno, "python"))
        return out

    def base_name(b: ast.expr) -> str:
        b = b.value if isinstance(b, ast.Subscript) else b
        name = ast.unparse(b)
        first = name.split(".")[0]
        if name in names:
            return names[name]
        if first in imports:
            return imports[first] + name[len(first) :]
        return f"builtins.{name}" if name in PY_BUILTIN_BASES else f"{home}.{name}"

    def modifiers(name: str) -> list[str]:
        return ["dunder"] if re.fullmatch(r"__\w+__", name) else ["private"] if name.startswith("_") else []

    def function(node, owner: str | None) -> None:
        qn = f"{owner}.{node.name}" if owner else f"{home}.{node.name}"
        doc = documentation(ast.get_docstring(node) or "")
        a = node.args
        params = [{"name": x.arg, "type": ast.unparse(x.annotation) if x.annotation else None, "description": None} for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])] if x.arg not in ("self", "cls")]
        mods = modifiers(node.name) + (["async"] if isinstance(node, ast.AsyncFunctionDef) else []) + [d.id for d in node.decorator_list if isinstance(d, ast.Name) and d.id in ("staticmethod", "classmethod", "property")]
        sheet.node("method" if owner else "function", node.name, qn, min([node.lineno, *(d.lineno for d in node.decorator_list)]), node.end_lineno, modifiers=mods, annotations=decorators(node), parameters=params, return_type=ast.unparse(node.returns) if node.returns else None, description=" ".join(doc[""]) or None)
        sheet.edge("contains" if owner else "belongs_to", owner or qn, qn if owner else home)
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                target, f = None, n.func
                if isinstance(f, ast.Name):
                    target = imports.get(f.id) or names.get(f.id) or (None if f.id in dir(builtins) else f"{home}.{f.id}")
                elif isinstance(f, ast.Attribute):
                    r = ast.unparse(f.value)
                    first = r.split(".")[0]
                    target = f"{owner}.{f.attr}" if owner and r in ("self", "cls") else f"{imports[first]}{r[len(first) :]}.{f.attr}" if first in imports else None
                if target:
                    sheet.edge("calls", qn, target, n.lineno)
            elif extended and isinstance(n, ast.Raise) and n.exc is not None:
                e = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
                if isinstance(e, ast.Name | ast.Attribute):
                    sheet.edge("throws", qn, base_name(e), n.lineno)

    def field(target: ast.expr, node, owner: str | None) -> None:
        if isinstance(target, ast.Name):
            qn = f"{owner}.{target.id}" if owner else f"{home}.{target.id}"
            v = node.value
            kind = ast.unparse(node.annotation) if isinstance(node, ast.AnnAssign) else type(v.value).__name__ if isinstance(v, ast.Constant) else {ast.List: "list", ast.Dict: "dict", ast.Set: "set", ast.Tuple: "tuple"}.get(type(v))
            sheet.node("field", target.id, qn, node.lineno, node.end_lineno, modifiers=modifiers(target.id), return_type=kind)
            sheet.edge("contains" if owner else "belongs_to", owner or qn, qn if owner else home)

    def body(nodes, owner: str | None, enum: bool = False) -> None:
        for n in nodes:
            if isinstance(n, ast.ClassDef):
                qn = f"{owner}.{n.name}" if owner else f"{home}.{n.name}"
                bases = [base_name(b) for b in n.bases]
                is_enum = any(b.rsplit(".", 1)[-1] in ("Enum", "IntEnum", "StrEnum", "Flag") for b in bases)
                kind = "enum" if is_enum else "exception" if extended and any(_EXCEPTION.search(b) for b in bases) else "class"
                sheet.node(kind, n.name, qn, min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno, modifiers=modifiers(n.name), annotations=decorators(n), description=" ".join(documentation(ast.get_docstring(n) or "")[""]) or None)
                sheet.edge("contains" if owner else "belongs_to", owner or qn, qn if owner else home)
                for b in bases:
                    sheet.edge("extends", qn, b)
                body(n.body, qn, is_enum)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                function(n, owner)
            elif isinstance(n, ast.Assign):
                for x in n.targets:
                    field(x, n, owner)
            elif isinstance(n, ast.AnnAssign):
                field(n.target, n, owner)

    body(tree.body, None)


def language_of(path: str) -> str | None:
    m = re.search(r"(\.[^./]+)$", path)
    return LANGUAGES.get(m.group(1).lower()) if m else None


def extract(project: str, path: str, text: str | None, extended: bool = True) -> Sheet:
    """Nodes, edges and errors of one file; nothing of an empty file, an error for a file without parser or with bad syntax."""
    language = language_of(path)
    sheet = Sheet(project, path, language or "")
    if language is None:
        sheet.error(f"no parser for {path}")
        return sheet
    if not text or not text.strip():
        return sheet
    try:
        (python if language == "python" else c_like)(sheet, text, extended)
    except Bad as e:
        sheet = Sheet(project, path, language)
        sheet.error(e.kind, text.count("\n", 0, e.at) + 1)
    except SyntaxError as e:
        sheet = Sheet(project, path, language)
        sheet.error(e.msg or "invalid syntax", e.lineno)
    except (RecursionError, MemoryError, ValueError, IndexError) as e:
        sheet = Sheet(project, path, language)
        sheet.error(f"{type(e).__name__}: {e}")
    return sheet


# --- plans ------------------------------------------------------------------------------------------------------

_ANN = pa.struct([("name", pa.string()), ("type", pa.string()), ("source_line", pa.int64()), ("framework", pa.string()), ("category", pa.string()), ("parameters", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("type", pa.string())])))])
_PAR = pa.struct([("name", pa.string()), ("type", pa.string()), ("description", pa.string())])
_SCHEMA = pa.schema([("kind", pa.string()), ("project_id", pa.string()), ("source_file", pa.string()), ("seq", pa.int64()), ("id", pa.string()), ("type", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("description", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("modifiers", pa.list_(pa.string())), ("annotations", pa.list_(_ANN)), ("parameters", pa.list_(_PAR)), ("return_type", pa.string()), ("source", pa.string()), ("target", pa.string()), ("line", pa.int64()), ("message", pa.string()), ("severity", pa.string())])
#: The schema of extracted rows.
EXTRACTED = "kind string, project_id string, source_file string, seq bigint, id string, type string, name string, qualified_name string, description string, start_line bigint, end_line bigint, modifiers array<string>, annotations array<struct<name string, type string, source_line bigint, framework string, category string, parameters array<struct<name string, value string, type string>>>>, parameters array<struct<name string, type string, description string>>, return_type string, source string, target string, line bigint, message string, severity string"


def rows(files: DataFrame, extended: bool = True) -> DataFrame:
    """All rows (``kind`` node, edge, error) of files with ``project_id, source_file, text``."""

    modules = frameworks.snapshot()  # as registered on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(1_000_000)  # the acceptors' frames lie on the heap
        for b in batches:
            frameworks.restore(modules)
            out = []
            for project, path, text in zip(*(c.to_pylist() for c in b.columns)):
                if path is None:
                    continue
                s = extract(project, path, text, extended)
                at = {"project_id": project, "source_file": path}
                out += [{"kind": k, "seq": i} | at | r for k, rs in (("node", s.nodes), ("edge", s.edges), ("error", s.errors)) for i, r in enumerate(rs)]
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return files.select(F.col("project_id").cast("string").alias("project_id"), F.col("source_file").cast("string").alias("source_file"), F.col("text").cast("string").alias("text")).mapInArrow(run, EXTRACTED)


def scan(files: DataFrame, extended: bool = True) -> tuple[Graph, DataFrame]:
    """The graph of source files and the errors; every file is parsed once.

    Of nodes with the same project and id the first (by file and place) wins, and so do links with the same id.
    """
    all_ = written(rows(files, extended), "extracted")
    return graph_of(all_), errors_of(all_)


def graph_of(all_: DataFrame) -> Graph:
    """The graph of extracted rows."""
    order = ["source_file", "seq"]
    n = first_wins(all_.where("kind = 'node'"), ["project_id", "id"], order)
    attributes = F.struct("parameters", "return_type")
    nodes = n.select("project_id", "id", "type", "name", "qualified_name", "source_file", "description", "start_line", "end_line", "modifiers", "annotations", attributes.alias("attributes"))
    e = first_wins(all_.where("kind = 'edge'"), ["project_id", "id"], order)
    edges = e.select("id", "project_id", "type", "source", "target", "source_file", F.struct(F.col("line").alias("line_number")).alias("attributes"))
    return Graph(nodes, edges)


def errors_of(all_: DataFrame) -> DataFrame:
    return all_.where("kind = 'error'").select("project_id", F.col("source_file").alias("file_path"), "line", "message", "severity")
