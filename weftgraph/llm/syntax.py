"""Source files that do not parse (problem 3).

Per file: the lexer of the extension's language runs with a pushdown stack of open delimiters and finds
unterminated literals, unbalanced delimiters, premature ends and merge-conflict markers; the acceptors of
:mod:`weftgraph.extract.grammar` (pushdown automata over the same tokens) find the rest. Python files that pass the lexer
get Python's own parser as an exact check. Files are independent of each other, so nothing is shuffled but verdicts.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.extract.grammar import Java, Script
from weftgraph.extract.lexers import Bad, c_tokens, conflict, dialect, py_tokens

#: Languages by extension (fixed values).
EXTENSIONS = {"java": "java", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}
#: Deeply nested files need deep recursion; the acceptors' frames lie on the heap, not on the C stack.
DEPTH = 1_000_000


def language_of(path: str | None) -> str | None:
    """The language of a path's extension, whatever its case; None for others."""
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path.rsplit("/", 1)[-1] else None


def _python(text: str) -> None:
    py_tokens(text)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "file.py", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (SyntaxError, ValueError) as e:
        line = getattr(e, "lineno", None) or 1
        kind = "indentation" if isinstance(e, IndentationError) else "unexpected token"
        raise Bad(kind, sum(len(x) for x in text.splitlines(True)[: line - 1])) from None
    except (MemoryError, RecursionError):  # more than Python's own parser takes
        raise Bad("nesting", 0) from None


def check(text: str | None, language: str | None, path: str | None = None) -> tuple[str, int] | None:
    """The first error as its kind and line (from 1), or None if the text is valid; in .tsx and .jsx files markup is.

    Null and empty texts and texts of unknown language are valid.
    """
    if not text or not text.strip() or language is None:
        return None
    at = conflict(text)
    try:
        if language == "python":
            try:
                _python(text)
            except Bad as e:
                if at >= 0:
                    raise Bad("merge conflict", at) from None
                raise e
            return None
        try:
            tokens = c_tokens(text, dialect(language, path))
            (Java(tokens) if language == "java" else Script(tokens, language == "typescript")).file()
        except Bad as e:
            if at >= 0:
                raise Bad("merge conflict", at) from None
            raise e
    except Bad as e:
        return e.kind, text.count("\n", 0, e.at) + 1
    except RecursionError:  # nested beyond any parser's limits
        return "nesting", 1
    return None


def verdicts(files: DataFrame, id_col: str = "file_id", path_col: str = "source_file", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``file_id, language, valid, error, error_line`` and the columns ``keep`` of every row.

    Null, empty and blank texts are valid; files of other extensions have a null language and are valid. Whole texts
    are read, however long. Repeated rows give repeated verdicts. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        for b in batches:
            paths = b.column(1).to_pylist()
            lang = [language_of(p) for p in paths]
            got = [check(t, x, p) for t, x, p in zip(b.column(2).to_pylist(), lang, paths)]
            cols = [b.column(0), pa.array(lang, pa.string()), pa.array([g is None for g in got]), pa.array([g and g[0] for g in got], pa.string()), pa.array([g and g[1] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *(b.column(3 + i) for i in range(len(keep)))], ["file_id", "language", "valid", "error", "error_line", *keep])

    rows = files.select(F.col(id_col).cast("bigint").alias("file_id"), F.col(path_col).cast("string").alias("__p"), F.col(text_col).cast("string").alias("__t"), *[F.col(c).cast("string").alias(c) for c in keep])
    return rows.mapInArrow(run, ", ".join(["file_id bigint, language string, valid boolean, error string, error_line bigint", *(f"{c} string" for c in keep)]))


def rates(verdict: DataFrame, by: list[str]) -> DataFrame:
    """``by`` columns, ``files, invalid, rate``; repeated files count once (rows of one id are repeats)."""
    once = verdict.groupBy("file_id").agg(*[F.min(c).alias(c) for c in by], F.max((~F.col("valid")).cast("bigint")).alias("bad"))
    out = once.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("bad").alias("invalid"))
    return out.withColumn("rate", F.col("invalid") / F.col("files"))
