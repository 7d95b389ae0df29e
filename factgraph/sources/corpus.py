"""Corpora of source files: reading, ignoring, inventories, components and technologies."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.operators.reach import shared_table

#: What is never read, whatever the rules say (fixed values).
ALWAYS_IGNORED = (r"(^|/)(\.git|node_modules|target|build|dist|\.venv|__pycache__)(/|$)", r"(^|/)(\.env(\..*)?|id_rsa|.*\.pem|.*\.p12|.*\.jks)$")
LANGUAGES = {
    "java": "JAVA", "kt": "KOTLIN", "kts": "KOTLIN", "ts": "TYPESCRIPT", "tsx": "TYPESCRIPT", "js": "JAVASCRIPT", "jsx": "JAVASCRIPT", "mjs": "JAVASCRIPT", "cjs": "JAVASCRIPT",
    "sql": "SQL", "py": "PYTHON", "go": "GO", "cs": "CSHARP", "rs": "RUST", "rb": "RUBY", "php": "PHP",
}
MANIFESTS = ("pom.xml", "build.gradle", "build.gradle.kts", "package.json", "composer.json", "go.mod", "Cargo.toml", "pyproject.toml", "Gemfile")
#: Names of manifests, and what each speaks for: kind, tag, evidence, confidence.
MANIFEST_TAGS = (
    (r"^pom\.xml$", "build", "MAVEN", "MAVEN_XML", 1.0),
    (r"\.csproj$", "build", "MSBUILD", "MSBUILD_MANIFEST", 1.0),
    (r"\.csproj$", "language", "CSHARP", "MSBUILD_MANIFEST", 1.0),
    (r"^package\.json$", "build", "NPM", "PACKAGE_JSON_DEPENDENCIES", 1.0),
    (r"^composer\.json$", "build", "COMPOSER", "COMPOSER_JSON", 1.0),
    (r"^composer\.json$", "language", "PHP", "COMPOSER_JSON", 1.0),
    (r"^(build|settings)\.gradle", "build", "GRADLE", "GRADLE_LITERAL_COORDINATES", 0.85),
    (r"^go\.mod$", "build", "GO_MODULES", "GO_MODULE_MANIFEST", 0.95),
    (r"^go\.mod$", "language", "GO", "GO_MODULE_MANIFEST", 0.95),
    (r"^Cargo\.toml$", "build", "CARGO", "CARGO_MANIFEST", 0.95),
    (r"^Cargo\.toml$", "language", "RUST", "CARGO_MANIFEST", 0.95),
    (r"^(pyproject\.toml|requirements\.txt)$", "build", "PYTHON_PACKAGING", "PYTHON_MANIFEST", 0.95),
    (r"^poetry\.lock$", "build", "POETRY", "PYTHON_MANIFEST", 0.95),
    (r"^(pyproject\.toml|requirements\.txt|poetry\.lock)$", "language", "PYTHON", "PYTHON_MANIFEST", 0.95),
    (r"^Gemfile$", "build", "BUNDLER", "RUBY_MANIFEST", 0.95),
    (r"^Gemfile$", "language", "RUBY", "RUBY_MANIFEST", 0.95),
)
#: Languages and file names, and the text in them that speaks for a framework.
MARKERS = (
    (("JAVA", "KOTLIN"), "^$", "org.springframework.", "SPRING_BOOT", "SPRING_IMPORT"),
    (("JAVA", "KOTLIN"), "^$", "jakarta.persistence.", "JPA", "JPA_IMPORT"),
    (("JAVA", "KOTLIN"), "^$", "javax.persistence.", "JPA", "JPA_IMPORT"),
    (("PYTHON",), r"^(requirements\.txt|pyproject\.toml)$", "fastapi", "FASTAPI", "FASTAPI_DEPENDENCY"),
    (("PYTHON",), r"^(requirements\.txt|pyproject\.toml)$", "django", "DJANGO", "DJANGO_DEPENDENCY"),
    (("PYTHON",), r"^(requirements\.txt|pyproject\.toml)$", "flask", "FLASK", "FLASK_DEPENDENCY"),
    (("PYTHON",), r"^(requirements\.txt|pyproject\.toml)$", "sqlalchemy", "SQLALCHEMY", "SQLALCHEMY_DEPENDENCY"),
    (("GO",), r"^go\.mod$", "github.com/gin-gonic/gin", "GIN", "GIN_DEPENDENCY"),
    (("GO",), r"^go\.mod$", "github.com/labstack/echo", "ECHO", "ECHO_DEPENDENCY"),
    (("GO",), r"^go\.mod$", "github.com/gofiber/fiber", "FIBER", "FIBER_DEPENDENCY"),
    (("GO",), r"^go\.mod$", "gorm.io/gorm", "GORM", "GORM_DEPENDENCY"),
    (("CSHARP",), r"\.csproj$", "Microsoft.AspNetCore", "ASPNETCORE", "ASPNETCORE_DEPENDENCY"),
    (("CSHARP",), r"\.csproj$", "Microsoft.EntityFrameworkCore", "EFCORE", "EFCORE_DEPENDENCY"),
    (("PHP",), r"^composer\.json$", "laravel/framework", "LARAVEL", "LARAVEL_DEPENDENCY"),
    (("PHP",), r"^composer\.json$", "Illuminate\\", "LARAVEL", "LARAVEL_DEPENDENCY"),
    (("PHP",), r"^composer\.json$", "symfony/", "SYMFONY", "SYMFONY_DEPENDENCY"),
)
NPM_TAGS = {
    "typescript": ("language", "TYPESCRIPT"), "@nestjs/core": ("framework", "NESTJS"), "@nestjs/common": ("framework", "NESTJS"), "express": ("framework", "EXPRESS"),
    "react": ("framework", "REACT"), "pg": ("database", "POSTGRESQL"), "vite": ("build", "VITE"),
}
COORDINATE_TAGS = (
    (r"^org\.springframework\.boot:", "framework", "SPRING_BOOT"),
    (r"^org\.springframework:.*web", "framework", "SPRING_MVC"),
    (r"data-jpa|^org\.hibernate:|^jakarta\.persistence:", "framework", "JPA"),
    (r"^org\.postgresql:", "database", "POSTGRESQL"),
    (r"^org\.flywaydb:", "database", "FLYWAY"),
    (r"^org\.liquibase:", "database", "LIQUIBASE"),
)
FREE_OF_FRAMEWORKS = ("java-spring", "typescript-node", "postgresql")
SQL_WORDS = ("SQL", "POSTGRESQL", "FLYWAY", "LIQUIBASE")


#: Orders of paths' hashes that running totals are kept for.
SLOTS = 4096


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content, bytes of every file below root that has a byte: Spark's sources leave empty files out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    return files.select(path.alias("path"), "content", F.col("length").alias("bytes"))


def write_files(files: DataFrame, root: str) -> None:
    """Writes each file (path, content) below root, a local or mounted folder that all tasks see.  A file appears whole, and
    a task that runs again gives the same.  Hadoop's local file system runs chmod for each file and folder that it makes."""
    top = re.sub("^file:(//)?", "", root)

    def write(rows) -> None:
        for r in rows:
            to = os.path.join(top, r.path)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = os.path.join(top, f".{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(r.content)
            os.replace(part, to)

    os.makedirs(top, exist_ok=True)
    files.select("path", "content").foreachPartition(write)


def corpus_verdicts(files: DataFrame, file_bytes: int = 1 << 20, files_most: int = 20_000, bytes_most: int = 268_435_456) -> DataFrame:
    """path, bytes, verdict of each file (path, content, bytes), and files_so_far, bytes_so_far of those that count: kept,
    FILE_SIZE_LIMIT, BINARY (a NUL byte), FILES_LIMIT or BYTES_LIMIT.

    Files too large or binary don't count.  The others come in the order of the hashes of their paths, which is the same in
    every run; totals run over those that a limit leaves out too, so that all that follow go as well.  No task sees the
    whole listing: totals of the SLOTS ranges of hashes are summed up first, then each range counts on from its own.
    """
    order = F.sha2("path", 256)
    seen = files.select("path", "bytes", F.when(F.col("bytes") > file_bytes, "FILE_SIZE_LIMIT").when(F.contains("content", F.lit(b"\x00")), "BINARY").alias("verdict"), order.alias("_order"))
    seen = shared_table(seen.withColumn("_slot", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")), "listing")  # texts are not read again for totals
    counted = seen.where("verdict IS NULL")
    totals = counted.groupBy("_slot").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # at most SLOTS rows
    starts = totals.select("_slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    own = Window.partitionBy("_slot").orderBy("_order", "path")
    placed = counted.join(starts, "_slot").withColumns({"files_so_far": F.col("n0") + F.row_number().over(own), "bytes_so_far": F.col("b0") + F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    verdict = F.when(F.col("files_so_far") > files_most, "FILES_LIMIT").when(F.col("bytes_so_far") > bytes_most, "BYTES_LIMIT").otherwise("kept")
    placed = placed.select("path", "bytes", verdict.alias("verdict"), "files_so_far", "bytes_so_far")
    return placed.unionByName(seen.where("verdict IS NOT NULL").select("path", "bytes", "verdict"), allowMissingColumns=True)


def read_corpus(spark: SparkSession, root: str, rules: list[str] | None = None, file_bytes: int = 1 << 20, files_most: int = 20_000, bytes_most: int = 268_435_456) -> tuple[DataFrame, DataFrame]:
    """Files (path, content, text, bytes, sha256) below root within the limits, and a row (path, bytes, verdict) for each that
    a limit or a NUL byte leaves out; files that the rules ignore are in neither.  Contents are read twice: for NUL bytes,
    and for those that stay."""
    files = read_files(spark, root)
    files = ignore_filter(files, rules) if rules is not None else files
    judged = shared_table(corpus_verdicts(files, file_bytes, files_most, bytes_most), "verdicts")
    kept = files.join(judged.where("verdict = 'kept'").select("path"), "path", "left_semi")
    kept = kept.select("path", "content", "bytes", F.sha2("content", 256).alias("sha256"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return kept, judged.where("verdict <> 'kept'").select("path", "bytes", "verdict")


def rule_regex(rule: str) -> tuple[str, bool]:
    """A line of an ignore file as a pattern of paths, and whether it takes files back in."""
    back, rule = rule.startswith("!"), rule.removeprefix("!").strip()
    anchored = "/" in rule.rstrip("/")
    body = "".join({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?/]+|/", rule.strip("/")))
    return ("^" if anchored else "(?:^|/)") + body + "(?:/|$)", back


def ignore_filter(files: DataFrame, rules: list[str]) -> DataFrame:
    """Files that no rule excludes; the last rule that matches counts.  The rules are one expression over the path."""
    kept = F.lit(True)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            pattern, back = rule_regex(rule)
            kept = F.when(F.col("path").rlike(pattern), F.lit(back)).otherwise(kept)
    for pattern in ALWAYS_IGNORED:
        kept = kept & ~F.col("path").rlike(pattern)
    return files.where(kept)


def file_role(path: Column) -> Column:
    return F.when(path.rlike(r"(?i)(^|/)(tests?|__tests__|spec)(/|$)|[._-](test|spec)\.[a-z]+$|Test\.java$"), "test").when(path.rlike(r"(?i)\.(md|rst|adoc)$"), "doc").when(path.rlike(r"(?i)\.(java|kt|ts|tsx|js|jsx|mjs|py|go|rs|cs|sql)$"), "source").when(path.rlike(r"(?i)\.(json|ya?ml|toml|xml|properties)$"), "config").otherwise("other")


def file_inventory(files: DataFrame) -> DataFrame:
    """path, text, content -> area, role, bytes, lines and sha256 of each file."""
    return files.select("path", F.split("path", "/")[0].alias("area"), file_role(F.col("path")).alias("role"), F.octet_length("content").cast("long").alias("bytes"), F.size(F.split("text", "\n")).alias("lines"), F.sha2("content", 256).alias("sha256"))


def area_rollup(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("area").agg(F.count("*").alias("files"), F.count_if(F.col("role") == "source").alias("sources"), F.count_if(F.col("role") == "test").alias("tests"), F.sum("bytes").alias("bytes"))


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def component_roots(files: DataFrame) -> DataFrame:
    """The folder of every manifest, and the root."""
    own = files.where(_name(F.col("path")).isin(*MANIFESTS) | F.col("path").endswith(".csproj")).select(_dir(F.col("path")).alias("root"))
    return own.union(files.limit(1).select(F.lit(".").alias("root"))).distinct()


def assign_component(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Each file with the longest root that holds it: its folders are looked up by equality."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    hit = files.select("path", F.explode(above).alias("root")).join(roots, "root")
    best = hit.groupBy("path").agg(F.max_by("root", F.when(F.col("root") == ".", 0).otherwise(F.length("root"))).alias("component"))
    return files.join(best, "path", "left")


def file_language(path: Column, first_line: Column) -> Column:
    name = _name(path)
    ext = F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    build = name.rlike(r"^(build|settings)\.gradle\.kts$")
    return F.when(~build, F.coalesce(known[ext], F.when(first_line.rlike("^#!.*python"), "PYTHON")))


def _tag(kind: str, tag: str | None = None, evidence: str | None = None, confidence: float | None = None) -> Column:
    names = ("tag_kind", "tag", "evidence_type")
    return F.struct(*[F.lit(v).cast("string").alias(n) for v, n in zip((kind, tag, evidence), names, strict=True)], F.lit(confidence).cast("double").alias("confidence"))


def _coordinates(name: Column, text: Column) -> Column:
    """group:artifact of Maven's and Gradle's dependencies."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<(?:dependency|parent)>(.*?)</(?:dependency|parent)>"), F.lit(1))
    pairs = F.transform(blocks, lambda b: F.concat_ws(":", F.regexp_extract(b, r"<groupId>\s*([^<\s]+)", 1), F.regexp_extract(b, r"<artifactId>\s*([^<\s]+)", 1)))
    quoted = F.regexp_extract_all(text, F.lit(r"""["']([A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+)(?::[^"']*)?["']"""), F.lit(1))
    return F.when(name == "pom.xml", pairs).when(name.rlike(r"^(build|settings)\.gradle"), quoted).otherwise(F.array().cast("array<string>"))


def malformed_manifests(files: DataFrame) -> DataFrame:
    """path of each manifest that can't be read as what its name says, as a diagnostic; its other evidence counts."""
    name, text = _name(F.col("path")), F.col("text")
    no_object = F.json_object_keys(text).isNull() | F.try_parse_json(text).isNull()
    lists = F.coalesce(F.col("text").rlike(r'"(dependencies|devDependencies|peerDependencies)"\s*:\s*[^{\s]'), F.lit(False))
    bad = F.when(name.isin("package.json", "composer.json"), no_object | ((name == "package.json") & lists)).when(name == "pom.xml", ~text.rlike(r"(?s)^\s*(<\?.*?\?>\s*|<!--.*?-->\s*)*<project[\s>].*</project>\s*$"))
    return files.where(F.coalesce(bad, F.lit(False))).select("path", F.lit("MALFORMED_MANIFEST").alias("code"), F.lit("WARNING").alias("severity"))


def technology_tags(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """path, component, tag_kind, tag, evidence_type, confidence of what each file (path, component, text) speaks for.

    tag_kind is language, framework, build, database, or evidence for a row that says only what was seen.  The built-in
    rules are one expression over the file; rules of one's own (file_name, text_pattern, tag_kind, tag, evidence_type,
    confidence) are joined by the file's name, so that a text is searched only by the rules for files of that name.
    """
    name, path, text = _name(F.col("path")), F.col("path"), F.coalesce("text", F.lit(""))
    language = file_language(path, F.substring_index(text, "\n", 1))
    found: list[Column] = [F.when(language.isNotNull(), F.struct(F.lit("language").alias("tag_kind"), language.alias("tag"), F.lit("FILE_EXTENSION_OR_SHEBANG").alias("evidence_type"), F.lit(0.99).alias("confidence")))]
    for names, kind, tag, evidence, confidence in MANIFEST_TAGS:
        found.append(F.when(name.rlike(names), _tag(kind, tag, evidence, confidence)))
    for speaks, names, marker, tag, evidence in MARKERS:
        fits = F.coalesce(language.isin(*speaks), F.lit(False)) | name.rlike(names)
        has = F.contains(F.lower(text), F.lit(marker)) if "PYTHON" in speaks else F.contains(text, F.lit(marker))
        found.append(F.when(fits & has, _tag("framework", tag, evidence, 0.95)))
    sql = F.coalesce(language == "SQL", F.lit(False))
    found += [
        F.when(sql, _tag("database", "POSTGRESQL", "SQL_SOURCE", 0.8)),
        F.when(sql & (F.contains(path, F.lit("/migration/")) | name.rlike(r"^V[0-9].*__.*\.sql$")), _tag("database", "FLYWAY", "SQL_SOURCE", 0.8)),
        F.when(F.contains(path, F.lit("db/changelog")) | F.contains(F.lower(name), F.lit("liquibase")), _tag("database", "LIQUIBASE", "CHANGELOG", 0.8)),
        F.when(name.rlike(r"^(build|settings)\.gradle") & text.rlike(r"""\bid\s*\(?["']org\.springframework\.boot["']"""), _tag("framework", "SPRING_BOOT", "GRADLE_LITERAL_COORDINATES", 0.85)),
    ]
    deps = [F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{k}")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies", "peerDependencies")]
    deps = F.when(name == "package.json", F.concat(*deps)).otherwise(F.array().cast("array<string>"))
    for dep, (kind, tag) in NPM_TAGS.items():
        found.append(F.when(F.array_contains(deps, dep), _tag(kind, tag, "PACKAGE_JSON_DEPENDENCIES", 1.0)))
    own = _coordinates(name, text)
    sure = F.when(name == "pom.xml", 1.0).otherwise(0.85)
    for pattern, kind, tag in COORDINATE_TAGS:
        hit = F.exists(own, _matches(pattern))
        found.append(F.when(hit, F.struct(F.lit(kind).alias("tag_kind"), F.lit(tag).alias("tag"), F.lit("COORDINATES").alias("evidence_type"), sure.alias("confidence"))))
    tags = files.select("path", "component", F.explode(F.array_compact(F.array(*found))).alias("x")).select("path", "component", "x.*").distinct()
    if rules is None:
        return tags
    named = files.withColumn("file_name", _name(F.col("path"))).join(rules, "file_name")
    more = named.where(F.col("text_pattern").isNull() | F.expr("regexp_like(text, text_pattern)"))
    return tags.union(more.select("path", "component", "tag_kind", "tag", "evidence_type", "confidence")).distinct()


def _matches(pattern: str):
    return lambda x: x.rlike(pattern)


def component_rollup(tags: DataFrame, inventory: DataFrame, diagnostics: DataFrame | None = None, most: int = 200) -> DataFrame:
    """Each component with its sorted tags, the first paths that speak for it, a fingerprint of its files and its
    malformed manifests; those without language or build are left out.  inventory: component, path, sha256."""

    def tagged(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("tag_kind") == kind, F.col("tag"))))

    one = tags.select("component", "tag_kind", "tag").distinct()
    t = one.groupBy("component").agg(tagged("language").alias("languages"), tagged("framework").alias("frameworks"), tagged("build").alias("builds"), tagged("database").alias("databases"))
    ranked = tags.select("component", "path").distinct().withColumn("place", F.row_number().over(Window.partitionBy("component").orderBy("path"))).where(F.col("place") <= most)
    evidence = ranked.groupBy("component").agg(F.array_sort(F.collect_list("path")).alias("evidence"))
    content = tree_hash(inventory, "component").select("component", "fingerprint")
    out = content.join(t, "component").join(evidence, "component", "left").where((F.size("languages") > 0) | (F.size("builds") > 0))
    if diagnostics is None:
        return out
    told = diagnostics.join(inventory.select("path", "component"), "path").groupBy("component").agg(F.array_sort(F.collect_set(F.struct("code", "path"))).alias("diagnostics"))
    return out.join(told, "component", "left")


def tree_hash(files: DataFrame, *keys: str) -> DataFrame:
    """keys, fingerprint: a hash of all files (path, sha256) of each key, whatever their order.

    Files are dealt into 4096 leaves by their path's hash; a leaf hashes its sorted lines, the root the leaves' hashes.
    So no row ever holds all paths.
    """
    leaf = F.substring(F.sha2("path", 256), 1, 3).alias("leaf")
    line = F.concat("path", F.lit("\0"), "sha256")
    leaves = files.groupBy(*keys, leaf).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    root = F.array_join(F.array_sort(F.collect_list(F.concat("leaf", F.lit(":"), "h"))), "\n")
    return leaves.groupBy(*keys).agg(F.concat(F.lit("sha256:"), F.sha2(root, 256)).alias("fingerprint"))


def corpus_fingerprint(files: DataFrame) -> DataFrame:
    """One row: the tree hash of all files, and the revision id from it."""
    return tree_hash(files).withColumn("revision", F.concat(F.lit("local-"), F.substring("fingerprint", 8, 40)))


def plan_analyzers(components: DataFrame, definitions: DataFrame) -> DataFrame:
    """component, analyzer_key, version, reason: the latest usable definition of each key that fits a component.

    A definition fits by a language; the one for SQL (postgresql) also by a database.  One that names frameworks needs
    one of them, but for the keys of FREE_OF_FRAMEWORKS.  Usable are those that are enabled and not retired, of
    contract 1.x, resolve no dependencies and use no network.  Definitions meet components by what they name.
    components: component, languages, frameworks, databases.
    """
    usable = definitions.where("enabled AND retired_at IS NULL AND contract_version LIKE '1.%' AND network = 'DENY' AND NOT resolves_dependencies")
    spoken = F.when(F.col("analyzer_key") == "postgresql", F.array(*map(F.lit, SQL_WORDS))).otherwise(F.col("languages"))
    words = usable.select("analyzer_key", "version", "created_at", F.col("frameworks").alias("wanted"), F.explode(spoken).alias("word"))
    has = components.select("component", "languages", "frameworks", F.explode(F.array_union("languages", F.coalesce("databases", F.array().cast("array<string>")))).alias("word"))
    fit = has.join(words, "word").where((F.size("wanted") == 0) | F.col("analyzer_key").isin(*FREE_OF_FRAMEWORKS) | F.arrays_overlap("wanted", "frameworks"))
    best = fit.groupBy("component", "analyzer_key").agg(F.max(F.struct("created_at", "version")).alias("d"), F.first("languages").alias("languages"), F.first("frameworks").alias("frameworks"))
    told = F.concat(F.lit("Detected languages "), F.array_join("languages", ", "), F.lit("; frameworks "), F.array_join("frameworks", ", "))
    reason = F.when(F.col("analyzer_key") == "postgresql", "SQL or database migration evidence detected").otherwise(told)
    return best.select("component", "analyzer_key", F.col("d.version").alias("version"), reason.alias("reason"))


def coverage_gaps(components: DataFrame, plan: DataFrame, definitions: DataFrame) -> DataFrame:
    covered = plan.join(definitions.select("analyzer_key", F.explode("languages").alias("language")), "analyzer_key").select("component", "language").distinct()
    return components.select("component", F.explode("languages").alias("language")).join(covered, ["component", "language"], "left_anti").groupBy("component").agg(F.array_sort(F.collect_set("language")).alias("languages")).withColumn("code", F.lit("ANALYZER_COVERAGE_GAP"))
