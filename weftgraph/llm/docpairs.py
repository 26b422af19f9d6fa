"""Functions paired with their documentation (problem 6).

Per file, functions and methods come from the acceptors of :mod:`weftgraph.extract.grammar` (Python: from its syntax
tree), and their documentation is the docstring, or the comment directly above the declaration or its annotations.
Documentation is reduced to prose (markup, tags and their descriptions removed) and judged trivial or not.

Methods whose own documentation says nothing inherit from overridden methods: class hierarchies, as parsed from
the same project's files, are walked one level at a time by joins until every method is resolved or has no further
ancestor. A class is one of one file; the name of its base is looked up in the file, then by the file's package or
module and imports, so classes of the same name don't mix. A method overrides one of its name, in Java also of as many
parameters. A method meets an ancestor class once, however many ways lead there.
"""

from __future__ import annotations

import ast
import posixpath
import re
import sys
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.extract.grammar import Java, Script
from weftgraph.extract.lexers import Bad, Tokens, c_tokens, dialect, py_tokens
from weftgraph.llm.syntax import DEPTH, language_of
from weftgraph.session import written

#: Words of prose besides those of the name and filler that make documentation say something.
LEAST_WORDS = 4
#: Words that say nothing by themselves (fixed values).
FILLER = frozenset(
    """a an the this that these those it its is are was were be been being of to in on at by for from with without into as and or but not no if then else so do does did
    has have had will would shall should can could may might must given any all each every some which who whose what when where here there one
    method function class helper constructor getter setter procedure routine object value values instance returns return returned gets sets get set
    param parameter parameters argument arguments result results void null none self just simply used uses using use implementation implements
    performs perform executes execute handles handle does call calls called""".split()
)
_PLACEHOLDER = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|tba|wip|n/?a|placeholder|none|undocumented|add (?:a )?(?:doc|description|documentation|comment)\w*|(?:missing|no|auto-?generated|insert|write|fill in|describe|document) .{0,30}?(?:doc\w*|description|comment|here|me|later|method stub|this)\b|description(?: goes here)?|documentation(?: goes here)?|lorem ipsum)\b", re.I)
_ELSEWHERE = re.compile(r"^\W*(?:\(?non-javadoc\)?|(?:please\s+)?(?:see|cf\.?|refer to|as in|same as|like|documented in|described in|copied from|inherited from|inherits? (?:doc|from)|overrides?|implements)\b)|\{@inheritdoc\}|@inheritdoc\b|@see\b", re.I)
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:return\b.*|else\b.*|if\s*\(.*|for\s*\(.*|while\s*\(.*|(?:public|private|protected|static|const|let|var|def|class|import|from|function|export)\b.*[=(;:{].*|@\w+(?:\(.*\))?\s*|[\w.\[\]]+\s*(?:[-+*/]?=)\s*\S.*|[\w.]+\(.*\)[;:]?|\}.*)\s*$")

_SECTION = re.compile(r"(?:args|arguments|params|parameters|returns?|yields?|raises|throws|exceptions|examples?|attributes|keyword args|see also|notes?|other parameters)\s*:?\s*$", re.I)


class Doc(NamedTuple):
    name: str
    line: int
    owner: str | None
    body: bool
    doc: str | None
    code: str
    arity: int = -1


class Class(NamedTuple):
    """A class of a file: the names others may know it by, and for each base its possible names, best first."""

    name: str
    keys: list[str]
    wants: list[list[str]]


def prose(comment: str) -> str:
    """The prose of a comment or docstring: no comment signs, markup, tags or sections of parameters and returns."""
    text = comment.replace("\r\n", "\n").replace("\r", "\n").strip()
    if text.startswith("/*"):
        text = re.sub(r"^/\*+!?|\*+/$", "", text)
        text = re.sub(r"(?m)^[ \t]*\*+(?!/)[ \t]?", "", text)
    elif text.startswith("//"):
        text = re.sub(r"(?m)^[ \t]*//+!?[ \t]?", "", text)
    elif text.startswith("#"):
        text = re.sub(r"(?m)^[ \t]*#+!?:?[ \t]?", "", text)
    text = re.sub(r"<(?:pre|code)>.*?</(?:pre|code)>", " ", text, flags=re.S | re.I)
    text = re.sub(r"```.*?(?:```|\Z)", " ", text, flags=re.S)
    out, skip = [], False
    for line in text.split("\n"):
        bare = line.strip()
        if re.match(r"@inheritdoc\b", bare, re.I):
            out.append("{@inheritDoc}")
        elif tag := re.match(r"@(\w+)|:(\w+)[^:\n]*:(?!:)", bare):
            skip = (tag.group(1) or tag.group(2)).lower() not in ("description", "desc", "summary", "brief", "remarks")
            if not skip:
                out.append(bare[tag.end() :])
        elif _SECTION.match(bare):
            skip = True
        elif skip:  # what a tag or section says goes on until a blank line
            skip = bool(bare)
        else:
            out.append(line)
    text = "\n".join(out)
    text = re.sub(r"\{@inheritdoc\}", "\x00", text, flags=re.I)
    text = re.sub(r"\{@\w+\s+([^}]*)\}", r"\1", text)
    text = re.sub(r"</?\w+[^<>]*>", " ", text)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r":\w+:`([^`]*)`", r"\1", text)
    text = re.sub(r"https?://\S+", " ", text)
    return text.replace("\x00", "{@inheritDoc}").replace("`", " ").replace("**", " ").strip()


def words(text: str) -> list[str]:
    """Words in lower case; names in camel case and with underscores are split."""
    parts = re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", text.replace("_", " ").replace("'", "").replace("’", "")))
    return [p.lower() for p in parts]


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """A rough stem that inflections of one word share."""
    w = word
    for end in ("ingly", "edly", "ations", "ation", "ators", "ator", "ings", "ing", "ied", "ies", "ers", "er", "ors", "or", "ed", "es", "ly", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: len(w) - len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] in "eyi" else w


def telling(comment: str | None, name: str) -> str | None:
    """The prose of a comment that says something about the function called ``name``, else None."""
    if comment is None:
        return None
    text = prose(comment)
    if not any(c.isalpha() for c in text) or _PLACEHOLDER.search(text) or _ELSEWHERE.search(text):
        return None
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    code = sum(bool(_CODE_LINE.search(x)) for x in lines)
    if code * 2 >= len(lines) and code:
        return None
    own, n = {stem(w) for w in words(name)}, 0
    for w in words(text):
        n += len(w) > 1 and w not in FILLER and stem(w) not in own
        if n >= LEAST_WORDS:
            return text
    return None


def trivial(comment: str | None, name: str) -> bool:
    """Whether a comment says nothing about the function called ``name``."""
    return telling(comment, name) is None


def _above(text: str, comments: list[tuple[int, int]], ends: list[int], at: int) -> str | None:
    """The comment whose last line is directly above (or which stands directly before) offset ``at``."""
    i = bisect_right(ends, at) - 1
    if i < 0:
        return None
    a, b = comments[i]
    gap = text[b:at].replace("\r\n", "\n").replace("\r", "\n")
    if gap.strip() or gap.count("\n") > 1:
        return None
    head = text[max(text.rfind("\n", 0, a), text.rfind("\r", 0, a)) + 1 : a]
    if head.strip() and ("\n" in gap or not text.startswith("/*", a)):
        return None  # it trails code
    if text.startswith("/*", a):
        return text[a:b]
    while i > 0:  # lines of line comments that adjoin
        c, e = comments[i - 1]
        between = text[e:a].replace("\r\n", "\n").replace("\r", "\n")
        line = text[max(text.rfind("\n", 0, c), text.rfind("\r", 0, c)) + 1 : c]
        if between.strip() or between.count("\n") > 1 or text.startswith("/*", c) or line.strip():
            break
        a, i = c, i - 1
    return text[a:b]


def _arity(tokens: Tokens, name: int) -> int:
    """The number of parameters of the Java method whose name is token ``name``."""
    a = name + 1
    b = tokens.match.get(a, -1)
    if tokens.text[a] != "(" or b <= a + 1:
        return 0
    n, depth, i = 1, 0, a + 1
    while i < b:
        t = tokens.text[i]
        if t in "([{" and i in tokens.match:
            i = tokens.match[i]
        depth += (t == "<") - (t == ">")
        n += t == "," and not depth
        i += 1
    return n


def _java_bases(tokens: Tokens) -> tuple[str, dict[str, str], list[str]]:
    """The package, the imported classes by their simple names, and the packages imported whole."""
    package, single, whole, i = "", {}, [], 0
    while tokens.text[i] in ("package", "import", ";", "@"):
        end = i
        while tokens.kind[end] != "end" and tokens.text[end] != ";":
            end += 1
        parts = [t for t in tokens.text[i + 1 : end] if t not in (".", "static")]
        if tokens.text[i] == "package":
            package = ".".join(parts)
        elif tokens.text[i] == "import" and parts:
            if parts[-1] == "*":
                whole.append(".".join(parts[:-1]))
            else:
                single[parts[-1]] = ".".join(parts)
        i = end + (tokens.kind[end] != "end")
    return package, single, whole


def _script_imports(tokens: Tokens) -> dict[str, tuple[str, str]]:
    """Module and name of every imported name."""
    out: dict[str, tuple[str, str]] = {}
    for i, t in enumerate(tokens.text):
        if t != "import" or tokens.kind[i] != "id" or tokens.text[i + 1] in ("(", "."):
            continue
        end = i + 1
        while tokens.kind[end] not in ("str", "end") and tokens.text[end] != ";":
            end += 1
        if tokens.kind[end] != "str":
            continue
        module, names = tokens.text[end][1:-1], [x for x in tokens.text[i + 1 : end] if x not in ("{", "}", ",", "type", "from")]
        j = 0
        while j < len(names):
            alias = names[j + 2] if j + 2 < len(names) and names[j + 1] == "as" else names[j]
            out[alias] = (module, names[j])
            j += 3 if alias is not names[j] else 1
    return out


def _module(path: str) -> str:
    """A script's path without its extension and without a last part ``index``."""
    bare = re.sub(r"(?:\.d)?\.[cm]?[jt]sx?$", "", posixpath.normpath(path))
    return bare.removesuffix("/index")


def _c_like(text: str, language: str, path: str) -> tuple[list[Doc], list[Class]]:
    tokens = c_tokens(text, dialect(language, path))
    p = Java(tokens) if language == "java" else Script(tokens, language == "typescript")
    p.file()
    ends = [e for _, e in tokens.comments]
    starts_line = [0]
    for m in re.finditer(r"\r\n|\n|\r", text):
        starts_line.append(m.end())
    out = []
    for f in p.found:
        name_at = tokens.at[f.name]
        start = f.start
        bare = start  # the declaration behind its annotations
        while tokens.text[bare] == "@" and bare < f.name:
            bare += 2
            while tokens.text[bare] == ".":
                bare += 2
            if tokens.text[bare] == "(" and bare in tokens.match:
                bare = tokens.match[bare] + 1
        doc = _above(text, tokens.comments, ends, tokens.at[bare]) if bare != start else None
        own = _above(text, tokens.comments, ends, tokens.at[start])
        stop = tokens.at[f.close] + 1 if f.close >= 0 else name_at + len(tokens.text[f.name])
        best = own if doc is None or own is not None and trivial(doc, tokens.text[f.name]) else doc
        out.append(Doc(tokens.text[f.name], bisect_right(starts_line, name_at), f.owner, f.open >= 0, best, text[tokens.at[start] : stop], _arity(tokens, f.name) if language == "java" else -1))
    if not p.classes:
        return out, []
    if language == "java":
        package, single, whole = _java_bases(tokens)
        known = lambda b: [f"java:{single[b]}"] if b in single else [*(f"java:{q}.{b}" for q in (package, *whole)), f"java:#{b}"]
        return out, [Class(c, [f"java:{package}.{c}", f"java:#{c}"], [known(b) for b in bases]) for c, bases in p.classes]
    imports, home = _script_imports(tokens), posixpath.dirname(path)

    def known(b: str) -> list[str]:
        if b not in imports:
            return [f"js:#{b}"]
        module, name = imports[b]
        return [f"js:{_module(posixpath.join(home, module) if module.startswith('.') else module)}#{name}"]

    return out, [Class(c, [f"js:{_module(path)}#{c}", f"js:#{c}"], [known(b) for b in bases]) for c, bases in p.classes]


def _python(text: str, path: str) -> tuple[list[Doc], list[Class]]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    lines = re.split(r"\r\n|\n|\r", text)
    out: list[Doc] = []
    classes: list[Class] = []
    parts = re.sub(r"(?:/__init__)?\.pyi?$", "", posixpath.normpath(path)).split("/")
    package = parts if path.endswith(("/__init__.py", "/__init__.pyi")) else parts[:-1]
    imports: dict[str, tuple[str, str]] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            stem_ = package[: len(package) - node.level + 1] if node.level else []
            module = ".".join([*stem_, *([node.module] if node.module else [])])
            imports.update({a.asname or a.name: (module, a.name) for a in node.names})
        elif isinstance(node, ast.Import):
            imports.update({a.asname or a.name: (a.name, "") for a in node.names})

    def known(base: ast.expr) -> list[str] | None:
        if isinstance(base, ast.Subscript):
            base = base.value
        if isinstance(base, ast.Name):
            module, name = imports.get(base.id, ("", base.id))
            return [f"py:{module}#{name}"]
        if isinstance(base, ast.Attribute):
            module = ast.unparse(base.value)
            of, name = imports.get(module, (module, ""))
            return [f"py:{'.'.join(x for x in (of, name) if x)}#{base.attr}"]
        return None

    def comment_above(line: int) -> str | None:
        got = []
        i = line - 2
        while i >= 0 and lines[i].lstrip().startswith("#"):
            got.append(lines[i].strip())
            i -= 1
        return "\n".join(reversed(got)) or None

    def visit(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                keys = [f"py:{'.'.join(parts[i:])}#{child.name}" for i in range(len(parts))] + [f"py:#{child.name}"]
                classes.append(Class(child.name, keys, [k for k in map(known, child.bases) if k]))
                visit(child, child.name)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                head = child.body[0]
                doc = head.value.value if isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) and isinstance(head.value.value, str) else None
                tried = [d for d in (doc, comment_above(child.lineno) if first != child.lineno else None, comment_above(first)) if d is not None]
                best = next((d for d in tried if not trivial(d, child.name)), tried[0] if tried else None)
                out.append(Doc(child.name, child.lineno, owner, True, best, "\n".join(lines[first - 1 : child.end_lineno])))
                visit(child, None)
            else:
                visit(child, owner)

    visit(tree, None)
    return out, classes


def functions_of(text: str | None, language: str | None, path: str = "") -> tuple[list[Doc], list[Class]]:
    """Functions with their documentation, and classes; nothing of texts that don't parse."""
    if not text or language is None:
        return [], []
    try:  # the same lexers and acceptors as in the syntax check, run once
        if language == "python":
            py_tokens(text)
            return _python(text, path)
        return _c_like(text, language, path)
    except (Bad, RecursionError, MemoryError, SyntaxError, ValueError):
        return [], []


_SCHEMA = pa.schema(
    [("file_id", pa.int64()), ("project_id", pa.string()), ("language", pa.string()), ("kind", pa.string()), ("owner", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("has_body", pa.bool_())]
    + [("doc", pa.string()), ("own", pa.bool_()), ("code", pa.string()), ("cls", pa.string()), ("sign", pa.string()), ("keys", pa.list_(pa.string()))]
)
_FUNCTIONS = "file_id bigint, project_id string, language string, kind string, owner string, name string, line bigint, has_body boolean, doc string, own boolean, code string, cls string, sign string, keys array<string>"


def functions(files: DataFrame, code: bool = True) -> DataFrame:
    """One row per function ('function'), class ('class') and base of a class ('base'), of files with ``file_id, project_id, source_file, text``.

    ``own`` tells whether the function's own documentation says something; ``doc`` is its prose. ``cls`` is the class of the
    row, as file and name, ``sign`` what an overriding method shares, ``keys`` the names of a class, or the possible ones of
    a base, best first. Null texts, empty texts and texts that don't parse give no rows; null paths have no language, hence
    no rows. Repeated files give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        for b in batches:
            rows = []
            for file_id, project, path, text in zip(*(c.to_pylist() for c in b.columns)):
                language = language_of(path)
                found, classes = functions_of(text, language, path or "")
                for f in found:
                    doc = telling(f.doc, f.name)
                    sign = f.name if f.arity < 0 else f"{f.name}/{f.arity}"
                    rows.append((file_id, project, language, "function", f.owner, f.name, f.line, f.body, doc, doc is not None, f.code if code else None, None if f.owner is None else f"{file_id}#{f.owner}", sign, None))
                for c in classes:
                    me = (None, None, None, None, f"{file_id}#{c.name}", None)
                    rows.append((file_id, project, language, "class", c.name, None, None, *me, [f"file:{file_id}#{c.name}", *c.keys]))
                    for wants in c.wants:
                        local = wants[0].rsplit("#", 1)[-1].rsplit(".", 1)[-1]
                        rows.append((file_id, project, language, "base", c.name, None, None, *me, [f"file:{file_id}#{local}", *wants]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA.types)], schema=_SCHEMA)

    cols = files.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("project_id").cast("string").alias("project_id"), F.col("source_file").cast("string").alias("p"), F.col("text").cast("string").alias("t"))
    return cols.mapInArrow(run, _FUNCTIONS)


def hierarchy(found: DataFrame) -> DataFrame:
    """``cls, base`` of the classes of :func:`functions`: every base by its best name that a class of the project has.

    A bare name (``:#``, for bases that are neither imported nor near) counts only if one class of the project has it; of
    several with the same full name the smallest is taken. Bases without a class in the project have no row.
    """
    project = F.coalesce("project_id", F.lit("")).alias("project")
    named = found.where("kind = 'class'").select(project, "cls", F.explode("keys").alias("key")).groupBy("project", "key").agg(F.min("cls").alias("base"), F.max("cls").alias("last")).where("base = last or not contains(key, ':#')").drop("last")
    wants = found.where("kind = 'base'").select(project, "cls", "keys").distinct().select("project", "cls", "keys", F.posexplode("keys").alias("at", "key"))
    best = wants.join(named, ["project", "key"]).groupBy("project", "cls", "keys").agg(F.min(F.struct("at", "base")).alias("b"))
    return best.select("cls", F.col("b.base").alias("base")).where("cls <> base").distinct()


def pairs(files: DataFrame, code: bool = True, inherit: bool = True) -> DataFrame:
    """``file_id, project_id, language, owner, name, line, doc, code, inherited``: functions with a body and documentation.

    Own documentation comes first; otherwise, with ``inherit``, that of the nearest overridden method in an ancestor class of
    the project (ties: the smallest class). Functions whose documentation stays empty or trivial are dropped. Repeated files
    count once.
    """
    found = functions(files, code)
    if inherit:
        found = written(found, "functions")
    fun = found.where("kind = 'function'").dropDuplicates(["file_id", "name", "line"])
    cols = ["file_id", "project_id", "language", "owner", "name", "line"]
    out = fun.where("has_body and own").select(*cols, "doc", "code", F.lit(False).alias("inherited"))
    if not inherit:
        return out
    me = ["file_id", "line", "name"]
    up = written(hierarchy(found), "bases")
    docs = written(found.where("kind = 'function' and own and cls is not null").groupBy(F.col("cls").alias("base"), "sign").agg(F.min("doc").alias("doc")), "docs")
    todo = found.where("kind = 'function' and has_body and not own and cls is not null").select(*me, "sign", "cls").distinct()
    met, got = written(todo.join(up.select("cls").distinct(), "cls", "left_semi"), "met"), []
    todo = met
    while True:
        step = todo.join(up, "cls").select(*me, "sign", F.col("base").alias("cls")).distinct().join(met, [*me, "sign", "cls"], "left_anti")
        step = written(step.join(docs.withColumnRenamed("base", "cls"), ["cls", "sign"], "left").select(*me, "sign", "cls", "doc"), "step")
        if step.isEmpty():
            break
        hit = written(step.where("doc is not null").groupBy(*me).agg(F.min(F.struct("cls", "doc")).alias("h")).select(*me, F.col("h.doc").alias("idoc")), "hit")
        got.append(hit)
        todo = written(step.select(*me, "sign", "cls").join(hit.select(*me), me, "left_anti"), "rest")
        met = met.unionByName(todo)
    for hit in got:
        more = fun.where("has_body and not own").drop("doc").join(hit, me)
        out = out.unionByName(more.select(*cols, F.col("idoc").alias("doc"), "code", F.lit(True).alias("inherited")))
    return out
