"""Column functions: ids, paths, vectors, embedding text, Git addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scoped_id(project: Column, entity: Column) -> Column:
    """``project:entity``."""
    return F.concat_ws(":", project, entity)


def scoped_project(scoped: Column) -> Column:
    """What's before the first colon; null without one."""
    return F.when(F.contains(scoped, F.lit(":")), F.split_part(scoped, F.lit(":"), F.lit(1)))


def scoped_entity(scoped: Column) -> Column:
    """What's behind the first colon (further colons are kept); null without one."""
    return F.when(F.contains(scoped, F.lit(":")), F.regexp_extract(scoped, r"(?s)^[^:]*:(.*)$", 1))


def project_label(project: Column, node_type: Column) -> Column:
    """``Project_<id>_<Type>`` with other characters than letters, digits and underscores replaced."""
    return F.concat(F.lit("Project_"), F.regexp_replace(project, r"[^a-zA-Z0-9_]", "_"), F.lit("_"), F.upper(F.substring(node_type, 1, 1)), F.substring(node_type, 2, 1 << 20))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last extension in lower case, with its dot; '' without one."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


LANGUAGE_OF = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".java": "java", ".py": "python", ".cs": "csharp"}


def language(path: Column) -> Column:
    """The language of a path's extension, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv]), extension(path))


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, scale: str = "normalized") -> Column:
    """Cosine similarity, 'raw' from -1 to 1 or 'normalized' to ``(1 + cos) / 2``; null for zero vectors and other lengths."""
    raw = F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))
    return raw if scale == "raw" else (raw + 1.0) / 2.0


def truncated(text: Column, max_tokens: int) -> Column:
    """Texts beyond ``max_tokens`` (four characters each) are cut and end in dots."""
    return F.when(F.length(text) / 4 > max_tokens, F.concat(F.substring(text, 1, max_tokens * 4), F.lit("..."))).otherwise(text)


def embedding_text(name: Column, qualified_name: Column, description: Column, parameters: Column, return_type: Column, annotations: Column, modifiers: Column) -> Column:
    """What of a node is embedded: its non-empty parts, joined by `` | ``."""
    some = lambda c: F.when(F.length(c) > 0, c)
    listed = lambda label, arr: F.when(F.size(arr) > 0, F.concat(F.lit(label), F.array_join(arr, ", ")))
    params = F.transform(parameters, lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.lit(": "), F.coalesce(p["type"], F.lit("any")), F.when(F.length(p["description"]) > 0, F.concat(F.lit(" - "), p["description"])).otherwise("")))
    return F.concat_ws(" | ", some(name), F.when(~qualified_name.eqNullSafe(name), some(qualified_name)), some(description), listed("Parameters: ", params), F.when(F.length(return_type) > 0, F.concat(F.lit("Returns: "), return_type)), listed("Annotations: ", F.transform(annotations, lambda a: a["name"])), listed("Modifiers: ", modifiers))


# --- Git addresses ----------------------------------------------------------------------------------------------

_HTTPS, _SSH, _GIT = r"^https?://(?:[^@/]+@)?([^/:]+)(?::\d+)?/([^/]+)/([^/]+?)(?:\.git)?/?$", r"^(?:ssh://)?git@([^/:]+)[:/](?:\d+/)?([^/]+)/([^/]+?)(?:\.git)?/?$", r"^git://([^/:]+)(?::\d+)?/([^/]+)/([^/]+?)(?:\.git)?/?$"


def git_part(url: Column, i: int) -> Column:
    """Part 1 (host), 2 (owner) or 3 (repository) of a Git address; null if it's none."""
    u = F.trim(url)
    return F.coalesce(*[F.nullif(F.regexp_extract(u, p, i), F.lit("")) for p in (_HTTPS, _SSH, _GIT)])


def git_protocol(url: Column) -> Column:
    u = F.trim(url)
    return F.when(u.rlike(_HTTPS), "https").when(u.rlike(_SSH), "ssh").when(u.rlike(_GIT), "git")


def git_provider(url: Column) -> Column:
    h = F.lower(git_part(url, 1))
    return F.when(h.isNull(), None).when(h == "github.com", "github").when(h == "gitlab.com", "gitlab").when(h == "bitbucket.org", "bitbucket").otherwise("generic")


def is_git_url(url: Column) -> Column:
    return git_protocol(url).isNotNull()


def clone_url(url: Column, protocol: str = "https") -> Column:
    """The address to clone from, by https or ssh."""
    h, o, r = (git_part(url, i) for i in (1, 2, 3))
    return F.concat(F.lit("https://"), h, F.lit("/"), o, F.lit("/"), r, F.lit(".git")) if protocol == "https" else F.concat(F.lit("git@"), h, F.lit(":"), o, F.lit("/"), r, F.lit(".git"))


def git_project_id(url: Column) -> Column:
    return F.concat(git_part(url, 2), F.lit("-"), git_part(url, 3))


def git_cache_key(host: Column, owner: Column, repo: Column, branch: Column) -> Column:
    """The first 16 digits of the SHA-256 of host/owner/repo/branch."""
    return F.substring(F.sha2(F.concat_ws("/", host, owner, repo, F.coalesce(branch, F.lit("default"))), 256), 1, 16)


def is_json(text: Column) -> Column:
    """Whether a text is valid JSON; null of null."""
    return F.when(text.isNotNull(), F.try_parse_json(text).isNotNull())
