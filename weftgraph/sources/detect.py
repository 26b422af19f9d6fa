"""Detection of build systems, languages, frameworks and sub-projects from the files of a tree."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.scalar import basename, dirname, language
from weftgraph.sources import tree
from weftgraph.sources.tree import ScanConfig, matches

#: Build files: pattern, language, build system (fixed values of public tools).
BUILD_FILES = (
    ("package.json", "javascript", "npm"), ("package-lock.json", "javascript", "npm"), ("yarn.lock", "javascript", "yarn"), ("pnpm-lock.yaml", "javascript", "pnpm"), ("tsconfig.json", "typescript", "npm"), ("lerna.json", "javascript", "lerna"), ("nx.json", "typescript", "nx"),
    ("pom.xml", "java", "maven"), ("build.gradle", "java", "gradle"), ("build.gradle.kts", "java", "gradle"), ("settings.gradle", "java", "gradle"), ("build.xml", "java", "ant"), ("BUILD.bazel", "java", "bazel"),
    ("setup.py", "python", "setuptools"), ("pyproject.toml", "python", "poetry"), ("requirements.txt", "python", "pip"), ("Pipfile", "python", "pipenv"), ("environment.yml", "python", "conda"), ("setup.cfg", "python", "setuptools"),
    ("*.csproj", "csharp", "dotnet"), ("*.sln", "csharp", "dotnet"), ("packages.config", "csharp", "nuget"),
)
#: Dependencies that name a framework, in order of preference (fixed values).
FRAMEWORKS = (("react", "React"), ("vue", "Vue"), ("@angular/core", "Angular"), ("express", "Express"), ("@nestjs/core", "NestJS"), ("next", "Next.js"))
SUPPORTED = ("typescript", "javascript", "java", "python")
EXCLUDES = {"typescript": ("node_modules", "dist", "build", "coverage"), "javascript": ("node_modules", "dist", "build", "coverage"), "java": ("target", "build", ".gradle"), "python": ("__pycache__", ".venv", "venv", "build", "dist")}


def can_detect(path: str) -> bool:
    """Whether a file is a known build file."""
    return any(matches(path, p) for p, _, _ in BUILD_FILES)


def build_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``source_file, text, language, build_system`` of the build files among ``source_file, text`` (a small dimension join)."""
    rows = [("^" + re.escape(p).replace(r"\*", ".*") + "$", lang, system, i) for i, (p, lang, system) in enumerate(BUILD_FILES)]
    dim = F.broadcast(spark.createDataFrame(rows, "regex string, language string, build_system string, ord int"))  # BUILD_FILES
    hit = files.select("source_file", "text", basename(F.col("source_file")).alias("base")).join(dim, F.expr("base rlike regex"))
    return hit.drop("regex", "base", "ord")


def metadata(name: str, text: str | None) -> dict[str, object]:
    """Name, version, dependencies and framework of one build file; empty values where it says nothing or is broken."""
    out: dict[str, object] = {"name": None, "version": None, "dependencies": [], "framework": None}
    base, text = name.rsplit("/", 1)[-1], text or ""
    if base == "package.json":
        try:
            data = json.loads(text)
        except ValueError:
            return out
        if not isinstance(data, dict):
            return out
        deps = {**(data.get("dependencies") or {}), **(data.get("devDependencies") or {})}
        return {"name": data.get("name"), "version": data.get("version"), "dependencies": sorted(deps), "framework": next((f for d, f in FRAMEWORKS if d in deps), None)}
    one = lambda rx: (m.group(1) if (m := re.search(rx, text)) else None)
    if base == "pom.xml":
        own = re.sub(r"(?s)<(parent|dependencies|build|plugins|dependencyManagement)>.*?</\1>", "", text)
        deps = [f"{g}:{a}" for g, a in re.findall(r"(?s)<dependency>\s*<groupId>(.*?)</groupId>\s*<artifactId>(.*?)</artifactId>", text)]
        first = lambda tag: (m.group(1) if (m := re.search(rf"<{tag}>(.*?)</{tag}>", own)) else None)
        return {"name": first("artifactId"), "version": first("version"), "dependencies": deps, "framework": "Spring Boot" if "spring-boot" in text else None}
    if base.startswith(("build.gradle", "settings.gradle")):
        deps = re.findall(r"(?:implementation|api|compile|testImplementation)\s*\(?\s*['\"]([^'\"]+)['\"]", text)
        return {"name": one(r"rootProject\.name\s*=\s*['\"]([^'\"]+)"), "version": one(r"(?m)^\s*version\s*=?\s*['\"]([^'\"]+)"), "dependencies": deps, "framework": "Spring Boot" if "spring-boot" in text or "springframework.boot" in text else None}
    if base in ("setup.py", "pyproject.toml", "setup.cfg"):
        return {"name": one(r"name\s*=\s*['\"]?([\w.\-]+)"), "version": one(r"version\s*=\s*['\"]?([\w.\-]+)"), "dependencies": _requirements(text), "framework": next((f for f in ("Django", "Flask", "FastAPI") if f.lower() in text.lower()), None)}
    if base == "requirements.txt":
        deps = [m.group(1) for line in text.splitlines() if (m := re.match(r"\s*([A-Za-z][\w.\-]*)", line))]
        return {"name": None, "version": None, "dependencies": deps, "framework": next((f for f in ("Django", "Flask", "FastAPI") if f.lower() in {d.lower() for d in deps}), None)}
    if base.endswith(".sln"):
        own = re.findall(r'(?m)^Project\("[^"]*"\)\s*=\s*"([^"]+)",\s*"[^"]*proj"', text)
        return {"name": base.removesuffix(".sln"), "version": one(r"VisualStudioVersion\s*=\s*([\d.]+)"), "dependencies": own, "framework": None}
    if base.endswith(".csproj"):
        return {"name": one(r"<AssemblyName>(.*?)<") or base.removesuffix(".csproj"), "version": one(r"<Version>(.*?)<"), "dependencies": re.findall(r'PackageReference\s+Include="([^"]+)"', text), "framework": one(r"<TargetFramework>(.*?)<")}
    return out


def _requirements(text: str) -> list[str]:
    """Names required by a setup script or project file: lists of requirements, and Poetry's tables of dependencies."""
    lists = re.findall(r"(?s)(?:install_requires|dependencies)\s*=\s*\[(.*?)\]", text)
    out = [m for part in lists for m in re.findall(r"['\"]\s*([A-Za-z][\w.\-]*)", part)]
    for table in re.findall(r"(?ms)^\[tool\.poetry\.(?:group\.\w+\.)?(?:dev-)?dependencies\]\s*$(.*?)(?=^\[|\Z)", text):
        out += [m for m in re.findall(r"(?m)^([A-Za-z][\w.\-]*)\s*=", table) if m != "python"]
    section = re.search(r"(?ms)^install_requires\s*=\s*\n((?:[ \t]+\S.*\n?)+)", text)  # setup.cfg
    out += re.findall(r"(?m)^\s+([A-Za-z][\w.\-]*)", section.group(1)) if section else []
    return list(dict.fromkeys(out))


def package_manager(names: set[str]) -> str:
    """npm, yarn or pnpm by lock file."""
    return "pnpm" if "pnpm-lock.yaml" in names else "yarn" if "yarn.lock" in names else "npm"


def languages(files: DataFrame) -> DataFrame:
    """``language, files``: by extension, most files first."""
    n = files.select(language(F.col("source_file")).alias("language")).where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    return n.orderBy(F.desc("files"), "language")


def detect(spark: SparkSession, files: DataFrame) -> dict[str, object]:
    """Build systems, languages, primary language, sub-projects and whether it's a mono-repository.

    Sub-projects are folders below the root with a build file of their own. Build files of one tree are few and are read
    on the driver; other files only as counts.
    """
    found = build_files(spark, files).orderBy("source_file").collect()
    by_ext = {r["language"]: r["files"] for r in languages(files).collect()}  # one row a language
    names = {r["source_file"].rsplit("/", 1)[-1] for r in found}
    meta = [{"path": r["source_file"], "language": r["language"], "build_system": package_manager(names) if r["build_system"] == "npm" else r["build_system"], **metadata(r["source_file"], r["text"])} for r in found]
    subs = sorted({r["source_file"].rsplit("/", 1)[0] for r in found if "/" in r["source_file"]})
    langs = list(dict.fromkeys([*(m["language"] for m in meta), *by_ext]))
    primary = max(by_ext, key=lambda k: by_ext[k]) if by_ext else (langs[0] if langs else None)
    return {"languages": langs, "primary": primary, "metadata": meta, "sub_projects": subs, "mono_repo": len(subs) > 1 or len(subs) == 1 and len(meta) > 1, "file_counts": by_ext}


def validate_languages(langs: list[str]) -> dict[str, list[str]]:
    """Which languages can be parsed and which can't."""
    return {"supported": [x for x in langs if x in SUPPORTED], "unsupported": [x for x in langs if x not in SUPPORTED]}


def recommended(langs: list[str]) -> dict[str, object]:
    """A scan configuration for the languages."""
    ok = validate_languages(langs)["supported"]
    return {"languages": tuple(ok), "exclude_paths": tuple(dict.fromkeys([".git", *(e for x in ok for e in EXCLUDES[x])])), "include_tests": True}


def validate_structure(spark: SparkSession, files: DataFrame) -> dict[str, object]:
    """Whether anything can be scanned, with suggestions where not."""
    found = detect(spark, files)
    ok = validate_languages(found["languages"])  # type: ignore[arg-type]
    tips = [] if ok["supported"] else ["no source file of a supported language was found; check the path and the excludes"]
    if ok["unsupported"]:
        tips.append("not parsed: " + ", ".join(ok["unsupported"]))
    return {"valid": bool(ok["supported"]), "suggestions": tips, **found}


def detect_tree(spark: SparkSession, config: ScanConfig) -> dict[str, object]:
    """:func:`validate_structure` of a tree: its source files and its build files."""
    sources = tree.source_files(spark, config)
    builds = tree.build_files(spark, config, tuple(p for p, _, _ in BUILD_FILES)).join(sources.select("source_file"), "source_file", "left_anti")
    return validate_structure(spark, sources.unionByName(builds.select(*sources.columns)))


def build_folders(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Build systems per folder."""
    return build_files(spark, files).select(dirname(F.col("source_file")).alias("folder"), "build_system").distinct()
