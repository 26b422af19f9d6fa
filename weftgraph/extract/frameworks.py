"""Frameworks of annotations and imports: dimension tables, and detection by joins against them (or per file).

Names of annotations are listed only for the frameworks met most; for all others the import decides: an annotation
belongs to the framework whose packages it's imported from, and a word of its package gives the category.

The tables are small and meant to be extended: every function takes them as DataFrames, and :func:`register` adds modules
to the built-in ones. Later modules win where two know the same annotation; earlier ones win ties of confidence.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: language, module -> category -> annotations (fixed values of public frameworks).
ANNOTATIONS: dict[tuple[str, str], dict[str, str]] = {
    ("java", "Spring Boot"): {
        "web": "RestController Controller RequestMapping GetMapping PostMapping PutMapping DeleteMapping PatchMapping RequestParam PathVariable RequestBody ResponseBody",
        "injection": "Component Service Repository Autowired Qualifier Bean Configuration Value",
        "lifecycle": "SpringBootApplication EnableAutoConfiguration Scheduled Async EventListener",
        "persistence": "Transactional",
        "security": "PreAuthorize Secured EnableWebSecurity",
        "testing": "SpringBootTest WebMvcTest MockBean",
    },
    ("java", "JPA"): {"persistence": "Entity Table Id Column GeneratedValue OneToMany ManyToOne ManyToMany OneToOne JoinColumn"},
    ("java", "JUnit"): {"testing": "Test BeforeEach AfterEach BeforeAll AfterAll ParameterizedTest RepeatedTest Disabled DisplayName Nested Tag ExtendWith"},
    ("java", "Mockito"): {"testing": "Mock InjectMocks Spy Captor"},
    ("java", "Bean Validation"): {"validation": "NotNull NotEmpty NotBlank Size Min Max Email Pattern Valid Positive Past Future"},
    ("java", "Lombok"): {"generation": "Data Getter Setter Builder AllArgsConstructor NoArgsConstructor RequiredArgsConstructor ToString EqualsAndHashCode Slf4j"},
    ("java", "Java"): {"core": "Override Deprecated SuppressWarnings FunctionalInterface SafeVarargs"},
    ("typescript", "Angular"): {"web": "Component Directive Pipe NgModule Input Output HostListener HostBinding ViewChild", "injection": "Injectable"},
    ("typescript", "NestJS"): {"web": "Controller Get Post Put Delete Patch Body Param Query Headers", "injection": "Module Inject Global", "security": "UseGuards", "web interception": "UseInterceptors UsePipes UseFilters"},
    ("typescript", "TypeORM"): {"persistence": "Entity Column PrimaryGeneratedColumn PrimaryColumn OneToMany ManyToOne ManyToMany OneToOne JoinTable JoinColumn"},
    ("python", "Python"): {"core": "property staticmethod classmethod dataclass abstractmethod cached_property lru_cache wraps"},
    ("python", "Pytest"): {"testing": "pytest.fixture pytest.mark.parametrize pytest.mark.skip fixture"},
    ("python", "Flask"): {"web": "app.route route blueprint.route app.before_request"},
    ("python", "Django"): {"security": "login_required permission_required csrf_exempt"},
    ("python", "Celery"): {"tasks": "shared_task task app.task"},
}
#: language, module -> import patterns with their confidence (fixed values; * stands for anything).
IMPORTS: dict[tuple[str, str], dict[str, int]] = {
    ("java", "Spring Boot"): {"org.springframework.boot*": 95, "org.springframework.*": 85},
    ("java", "JPA"): {"javax.persistence*": 95, "jakarta.persistence*": 95},
    ("java", "JUnit"): {"org.junit.jupiter*": 95, "org.junit*": 90},
    ("java", "Mockito"): {"org.mockito*": 95},
    ("java", "Bean Validation"): {"javax.validation*": 95, "jakarta.validation*": 95},
    ("java", "Lombok"): {"lombok*": 95},
    ("java", "Java"): {"java.*": 30},
    ("java", "Hibernate"): {"org.hibernate*": 95},
    ("java", "Quarkus"): {"io.quarkus*": 95},
    ("java", "Micronaut"): {"io.micronaut*": 95},
    ("java", "DropWizard"): {"io.dropwizard*": 95, "com.codahale.metrics*": 80},
    ("java", "Jersey"): {"org.glassfish.jersey*": 95, "javax.ws.rs*": 75, "jakarta.ws.rs*": 75},
    ("java", "JSF"): {"javax.faces*": 95, "jakarta.faces*": 95, "org.primefaces*": 85},
    ("java", "Apache Struts"): {"org.apache.struts*": 95, "com.opensymphony.xwork2*": 85},
    ("java", "Apache Camel"): {"org.apache.camel*": 95},
    ("java", "Apache Spark"): {"org.apache.spark*": 95},
    ("java", "Apache Wicket"): {"org.apache.wicket*": 95},
    ("java", "Axon Framework"): {"org.axonframework*": 95},
    ("java", "Blade"): {"com.hellokaton.blade*": 95, "com.blade*": 90},
    ("java", "GWT"): {"com.google.gwt*": 95, "org.gwtproject*": 90},
    ("java", "Grails"): {"grails.*": 90, "org.grails*": 95},
    ("java", "JHipster"): {"io.github.jhipster*": 95, "tech.jhipster*": 95},
    ("java", "Play Framework"): {"play.*": 90},
    ("java", "Vaadin"): {"com.vaadin*": 95},
    ("java", "Vert.x"): {"io.vertx*": 95},
    ("typescript", "TypeScript"): {"typescript": 60, "tslib*": 60},
    ("typescript", "Angular"): {"@angular/*": 95},
    ("typescript", "NestJS"): {"@nestjs/*": 95},
    ("typescript", "React"): {"react": 95, "react-dom*": 90},
    ("typescript", "TypeORM"): {"typeorm": 95},
    ("python", "Flask"): {"flask*": 95},
    ("python", "Django"): {"django*": 95},
    ("python", "Pytest"): {"pytest*": 90},
    ("python", "Celery"): {"celery*": 90},
}


#: Words of a package that tell the category of what it holds, the first that occurs (fixed values).
PACKAGE_WORDS = {
    "testing": "test testing junit mockito mock",
    "security": "security auth authorization",
    "validation": "validation constraints valid",
    "persistence": "persistence orm jpa data hibernate repository envers",
    "web": "web http rest rs ws mvc faces servlet router routing ui",
    "messaging": "messaging kafka jms amqp queue commandhandling eventhandling",
    "injection": "inject di ioc context beans",
    "lifecycle": "scheduling scheduled lifecycle event events boot",
}


def register(language: str, module: str, annotations: dict[str, str] | None = None, imports: dict[str, int] | None = None) -> None:
    """Add a module (or replace it); it counts as the latest."""
    remove(language, module)
    ANNOTATIONS[language, module] = annotations or {}
    IMPORTS[language, module] = imports or {}
    _forget()


def remove(language: str, module: str) -> None:
    ANNOTATIONS.pop((language, module), None)
    IMPORTS.pop((language, module), None)
    _forget()


def _forget() -> None:
    for f in (known, _patterns, by_import):
        f.cache_clear()


def snapshot() -> tuple[dict, dict]:
    """The modules as they are, to be sent to executors; :func:`restore` puts them in place there."""
    return dict(ANNOTATIONS), dict(IMPORTS)


def restore(state: tuple[dict, dict]) -> None:
    for have, want in zip((ANNOTATIONS, IMPORTS), state):
        if have != want or list(have) != list(want):
            have.clear()
            have.update(want)
            _forget()


@lru_cache(maxsize=16)
def known(language: str) -> dict[str, tuple[str, str]]:
    """Framework and category of the listed annotations of a language; the module registered last counts."""
    return {a: (mod, cat) for lang, mod, _, a, cat in annotation_rows() if lang == language}


@lru_cache(maxsize=16)
def _patterns(language: str) -> list[tuple[re.Pattern, str, int]]:
    return [(re.compile(_regex(p), re.S), mod, c) for (lang, mod), ps in IMPORTS.items() if lang == language for p, c in ps.items()]


def _regex(pattern: str) -> str:
    return "^" + pattern.replace(".", "\\.").replace("*", ".*") + "$"


@lru_cache(maxsize=50_000)
def by_import(language: str, module: str) -> tuple[str, str] | None:
    """Framework (of the best pattern, the earlier module at ties) and category of what's imported from ``module``."""
    hits = [(-c, i, mod) for i, (rx, mod, c) in enumerate(_patterns(language)) if rx.search(module)]
    if not hits:
        return None
    words = re.findall(r"[a-z]+", module.rsplit(".", 1)[0].lower())
    return min(hits)[2], next((cat for cat, names in PACKAGE_WORDS.items() if set(words) & set(names.split())), "general")


def modules(language: str | None = None) -> list[tuple[str, str]]:
    """Known modules in their order."""
    return [k for k in dict.fromkeys([*ANNOTATIONS, *IMPORTS]) if language in (None, k[0])]


def annotation_rows() -> list[tuple[str, str, int, str, str]]:
    """language, module, order of the module, annotation, category."""
    order = {k: i for i, k in enumerate(modules())}
    return [(lang, mod, order[lang, mod], a, cat) for (lang, mod), cats in ANNOTATIONS.items() for cat, names in cats.items() for a in names.split()]


def framework_annotations(spark: SparkSession) -> DataFrame:
    """One row per language and annotation: the module that knows it last."""
    df = spark.createDataFrame(annotation_rows(), "language string, framework string, module_order int, annotation string, category string")
    w = W.partitionBy("language", "annotation").orderBy(F.desc("module_order"))
    return df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def framework_imports(spark: SparkSession) -> DataFrame:
    order = {k: i for i, k in enumerate(modules())}
    rows = [(lang, mod, order[lang, mod], p, _regex(p), c) for (lang, mod), ps in IMPORTS.items() for p, c in ps.items()]
    return spark.createDataFrame(rows, "language string, framework string, module_order int, pattern string, regex string, confidence int")


def bare(name):
    """An annotation's name without the sign and blanks."""
    return F.regexp_replace(F.trim(name), "^@", "")


def annotated(rows: DataFrame, dimension: DataFrame, name_col: str = "name", language_col: str = "language") -> DataFrame:
    """Rows with ``framework`` and ``category`` of their annotation (null where unknown).

    Of several modules that know an annotation, the latest counts, so that no row is doubled. No hint: Spark decides by size.
    """
    latest = dimension.groupBy(F.col("language").alias("__l"), F.col("annotation").alias("__a")).agg(F.max_by(F.struct("framework", "category"), "module_order").alias("__k"))
    d = latest.select("__l", "__a", "__k.framework", "__k.category")
    return rows.join(d, (bare(F.col(name_col)) == F.col("__a")) & (F.col(language_col) == F.col("__l")), "left").drop("__a", "__l")


def by_annotations(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """``file, framework, confidence, module_order``: per file, the framework with the most known annotations, 20 points each, at most 90."""
    d = dimension.select(F.col("language").alias("__l"), F.col("annotation").alias("__a"), "framework", "module_order")
    hit = rows.join(d, (bare(F.col("name")) == F.col("__a")) & (F.col("language") == F.col("__l")))
    n = hit.groupBy("file", "framework").agg(F.count(F.lit(1)).alias("n"), F.min("module_order").alias("module_order"))
    best = n.groupBy("file").agg(F.max_by(F.struct("framework", "n", "module_order"), F.struct("n", -F.col("module_order"))).alias("b"))
    return best.select("file", "b.framework", F.least(F.lit(90), F.lit(20) * F.col("b.n")).cast("int").alias("confidence"), "b.module_order")


def by_imports(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``file, framework, confidence, module_order``: per file, the best import pattern; ties go to the earlier module.

    Each distinct module meets only the patterns whose text before the first ``*`` begins it, by an equality of prefixes.
    """
    p = patterns.select("language", F.regexp_extract("pattern", r"^[^*]*", 0).alias("prefix"), "regex", "framework", "confidence", "module_order")
    m = rows.select("language", "module").distinct()
    heads = m.select("language", "module", F.explode(F.transform(F.sequence(F.lit(0), F.length("module")), lambda n: F.substring("module", F.lit(1), n))).alias("prefix"))
    met = heads.join(p, ["language", "prefix"]).where(F.expr("module rlike regex"))
    per_module = met.groupBy("language", "module").agg(F.max_by(F.struct("framework", "confidence", "module_order"), F.struct("confidence", -F.col("module_order"))).alias("b"))
    hit = rows.join(per_module.select("language", "module", "b.*"), ["language", "module"])
    best = hit.groupBy("file").agg(F.max_by(F.struct("framework", "confidence", "module_order"), F.struct("confidence", -F.col("module_order"))).alias("b"))
    return best.select("file", "b.framework", "b.confidence", "b.module_order")


def combined(annotations: DataFrame, imports: DataFrame) -> DataFrame:
    """Both kinds of evidence: summed up to 100 where they agree, else the stronger (annotations win ties)."""
    a = annotations.select("file", F.col("framework").alias("af"), F.col("confidence").alias("ac"))
    i = imports.select("file", F.col("framework").alias("if"), F.col("confidence").alias("ic"))
    j = a.join(i, "file", "full_outer")
    same = F.col("af") == F.col("if")
    first = F.col("if").isNull() | (F.col("ac") >= F.col("ic"))
    return j.select("file", F.when(same | first, F.col("af")).otherwise(F.col("if")).alias("framework"), F.when(same, F.least(F.lit(100), F.col("ac") + F.col("ic"))).when(first, F.col("ac")).otherwise(F.col("ic")).alias("confidence"))


def statistics(spark: SparkSession) -> DataFrame:
    """Annotations and import patterns of every module."""
    a = spark.createDataFrame(annotation_rows(), "language string, framework string, module_order int, annotation string, category string").groupBy("language", "framework").agg(F.count_distinct("annotation").alias("annotations"))
    i = framework_imports(spark).groupBy("language", "framework").agg(F.count(F.lit(1)).alias("patterns"))
    return a.join(i, ["language", "framework"], "full_outer").fillna(0, ["annotations", "patterns"])
