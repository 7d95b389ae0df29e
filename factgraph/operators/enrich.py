"""Bookkeeping of enrichments: what to ask for, what is cached, what a quota grants, and what came of it.  No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import semantics as S

CACHE_KEY = ("org_id", "provider", "model", "prompt_key", "prompt_version", "request_hash")


def enrichment_targets(endpoints: DataFrame, scenarios: DataFrame) -> DataFrame:
    """run_id, stable_key, target_key: an endpoint's scenario where it has one, else the endpoint."""
    s = scenarios.select("run_id", F.col("entry_key").alias("stable_key"), F.col("stable_key").alias("scenario_key"))
    return endpoints.join(s, ["run_id", "stable_key"], "left").select("run_id", "stable_key", F.coalesce("scenario_key", "stable_key").alias("target_key"))


#: Properties of a fact that a bundle may show (fixed values), and what stands where a snippet was cut.
BUNDLE_FIELDS = (
    "name", "symbolSignature", "entryPointKey", "actors", "roles", "security", "authorization", "normalizedCondition", "condition", "resolvedConstants", "constants",
    "trueOutcomes", "falseOutcomes", "outcome", "preconditions", "callPath", "dataReads", "dataWrites", "externalEffects", "exceptions", "relatedTests", "status", "statuses",
    "httpMethod", "path", "table", "column", "ownerKey", "enclosingMethod", "enclosingDeclaration",
)
CUT, CUT_AGAIN = "\n// ... [snippet truncated for AI context]", "\n// ... [truncated]"
#: What no bundle may cite: absolute, parent and drive paths, environments and keys (a fixed pattern).
PRIVATE_PATH = r"(?i)^/|\.\./|:|(^|/)(\.env(\..*)?|[^/]+\.(pem|key|p12|pfx))$"


def evidence_bundle(
    nodes: DataFrame, facts: DataFrame, evidence: DataFrame, priority: Column, owners: DataFrame | None = None, allowed: str = ".*",
    facts_most: int = 32, evidence_most: int = 8, facts_least: int = 8, bytes_most: int = 48_000,
) -> DataFrame:
    """run_id, node_key, bundle, bundle_bytes, fact_ids, n_evidence, request_hash, refusal of each node: the JSON text that a
    model is shown, or why there is none.

    nodes: run_id, node_key, fingerprint; facts: run_id, node_key, fact_id, kind, properties; evidence: run_id, fact_id,
    evidence_id, file_path, start_line, end_line, snippet, of verified evidence; owners: run_id, owner_key, evidence_id,
    snippet, of the owners that facts name.

    The first facts by priority and id, of which those whose allowed fields take over 12 000 characters and those without
    evidence go; the first evidence of each by id.  A snippet without a declaration gets its owner's, is cut at 4000
    characters and redacted.  A bundle over `bytes_most` has its snippets cut at 1000, then loses facts from the end down to
    `facts_least`.  Refusals: NO_FACTS, PATH (any cited path is private or not allowed), TOO_LARGE.  All other columns of a
    refused bundle but its keys are null.
    """
    node, fact = ["run_id", "node_key"], ["run_id", "node_key", "fact_id"]
    own = facts.select(*fact, "kind", "properties").withColumn("place", F.row_number().over(Window.partitionBy(*node).orderBy(priority, "fact_id"))).where(F.col("place") <= facts_most)
    props = F.from_json(S.canonical_json(F.col("properties")), "map<string,variant>")
    own = own.withColumn("shown", F.coalesce(_redact_json(F.to_json(F.map_filter(props, lambda k, _: k.isin(*BUNDLE_FIELDS)))), F.lit("{}")))
    own = own.withColumn("owner_key", F.trim(F.coalesce(F.get_json_object("properties", "$.ownerKey"), F.lit(""))))
    e = evidence.join(own.select("run_id", "fact_id").distinct(), ["run_id", "fact_id"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("run_id", "fact_id").orderBy("evidence_id"))).where(F.col("nth") <= evidence_most)
    # a fact of several nodes gives each of them its evidence
    e = own.where(F.length("shown") <= 12_000).join(e, ["run_id", "fact_id"])
    bare = (F.col("owner_key") != "") & ~F.col("snippet").rlike(r"\{|public |private ")
    if owners is not None:
        first = owners.groupBy("run_id", "owner_key").agg(F.min_by("snippet", "evidence_id").alias("_owner"))
        first = first.select("run_id", F.col("owner_key").alias("_key"), F.when(F.contains("_owner", F.lit("{")), F.trim(F.substring_index("_owner", "{", 1))).alias("_head"))
        # evidence that needs no owner is dealt by its own ids
        e = e.withColumn("_key", F.when(bare, F.col("owner_key")).otherwise(F.concat(F.lit("\x00"), "evidence_id"))).join(first, ["run_id", "_key"], "left")
        e = e.withColumn("snippet", F.when(F.col("_head") != "", F.concat(F.lit("// in method: "), "_head", F.lit("\n"), "snippet")).otherwise(F.col("snippet")))
    path = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    long = S.redact_secrets(F.when(F.length("snippet") > 4000, F.concat(F.substring("snippet", 1, 3900), F.lit(CUT))).otherwise(F.col("snippet")))
    e = e.withColumns({"bad": path.rlike(PRIVATE_PATH) | ~path.rlike(allowed), "long": long})
    e = e.withColumn("short", F.when(F.length("long") > 1000, F.concat(F.substring("long", 1, 950), F.lit(CUT_AGAIN))).otherwise(F.col("long")))
    cited = {size: F.to_json(F.array_sort(F.collect_list(F.struct("evidence_id", "end_line", F.col("file_path").alias("path"), F.col(size).alias("snippet"), "start_line")))) for size in ("long", "short")}  # at most evidence_most
    f = e.groupBy(*fact, "place", "kind", "shown").agg(F.count("*").alias("n"), F.bool_or("bad").alias("bad"), *[x.alias(size) for size, x in cited.items()])

    def whole(size: str) -> Column:
        return F.concat(F.lit('{"evidence":'), size, F.lit(',"factId":'), _quoted("fact_id"), F.lit(',"kind":'), _quoted("kind"), F.lit(',"properties":'), "shown", F.lit("}"))

    f = f.withColumns({size: whole(size) for size in cited})
    held = f.groupBy(*node).agg(F.bool_or("bad").alias("bad"), F.array_sort(F.collect_list(F.struct("place", "fact_id", "n", "long", "short"))).alias("facts"))  # at most facts_most
    named = own.select(*node).distinct().withColumn("any", F.lit(True))
    out = nodes.select(*node, "fingerprint").join(named, node, "left").join(held, node, "left").withColumn("facts", F.coalesce("facts", F.expr("array()").cast("array<struct<place:int,fact_id:string,n:bigint,long:string,short:string>>")))
    tail = F.concat(F.lit('],"fingerprint":'), F.coalesce(_quoted("fingerprint"), F.lit("null")), F.lit(',"nodeId":'), _quoted("node_key"), F.lit("}"))
    out = out.withColumn("_tail", tail)
    frame = F.lit(len('{"facts":[')) + F.octet_length("_tail")

    def size_of(texts: Column) -> Column:
        """Bytes of a bundle of these facts: theirs, the commas between them, and what stands around."""
        return F.aggregate(texts, F.lit(0), lambda n, x: n + F.octet_length(x)) + F.greatest(F.size(texts) - 1, F.lit(0)) + frame

    texts = F.when(size_of(F.col("facts.long")) > bytes_most, F.col("facts.short")).otherwise(F.col("facts.long"))
    out = out.withColumn("_texts", texts)
    # sums of bytes as facts come; the longest run of them that fits stays
    start = F.struct(frame.cast("int").alias("so_far"), F.lit(0).alias("kept"))
    fits = F.aggregate("_texts", start, lambda a, x: F.struct((a["so_far"] + F.octet_length(x) + 1).alias("so_far"), (a["kept"] + (a["so_far"] + F.octet_length(x) <= bytes_most).cast("int")).alias("kept")))
    out = out.withColumn("_kept", F.greatest(fits["kept"], F.least(F.size("facts"), F.lit(facts_least))))
    out = out.withColumn("_bundle", F.concat(F.lit('{"facts":['), F.array_join(F.slice("_texts", 1, F.col("_kept")), ","), "_tail"))
    out = out.withColumn("refusal", F.when(F.col("any").isNull(), "NO_FACTS").when(F.col("bad"), "PATH").when(F.octet_length("_bundle") > bytes_most, "TOO_LARGE"))
    good, kept = F.col("refusal").isNull(), F.slice("facts", 1, F.col("_kept"))
    shown = {
        "bundle": F.col("_bundle"), "bundle_bytes": F.octet_length("_bundle"), "fact_ids": kept["fact_id"], "n_evidence": F.aggregate(kept["n"], F.lit(0).cast("bigint"), lambda a, x: a + x),
        "request_hash": F.sha2("_bundle", 256),
    }
    return out.select(*node, *[F.when(good, x).alias(c) for c, x in shown.items()], "refusal")


def _redact_json(text: Column) -> Column:
    """redact_secrets for JSON text: a value ends with its string, and what a secret's name holds is masked whole."""
    rest = r'(?:\\[^nrt]|[^\s"\\])+'
    text = F.regexp_replace(text, r'(?i)("(?:authorization|password|secret|api[-_]?key|token)"\s*:\s*)"(?:\\.|[^"\\])*"', '$1"[REDACTED]"')
    text = F.regexp_replace(text, r"(?i)(authorization\s*[:=]\s*)(?:(?:bearer|basic)\s*)?" + rest, "$1[REDACTED]")
    return F.regexp_replace(text, r"(?i)((?:password|secret|api[-_]?key|token)\s*[:=]\s*)" + rest, "$1[REDACTED]")


def _quoted(c: str) -> Column:
    """A string as JSON."""
    return F.substring(F.to_json(F.array(F.col(c).cast("string"))), F.lit(2), F.length(F.to_json(F.array(F.col(c).cast("string")))) - 2)


def path_policy(evidence: DataFrame, allowed: str = r".*") -> DataFrame:
    """run_id, node_key, refused: bundles that touch absolute, parent, key or environment paths, or others than allowed."""
    p = F.col("file_path")
    bad = p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|(^|/)\.env(\.|$)|\.(pem|p12|jks|key)$") | ~p.rlike(allowed)
    return evidence.groupBy("run_id", "node_key").agg(F.bool_or(bad).alias("refused"))


def cache_split(targets: DataFrame, executions: DataFrame, now: Column) -> DataFrame:
    """targets with `cache`: hit, running or miss; what has run for over two minutes counts as given up."""
    fresh = F.col("started_at") >= now - F.expr("INTERVAL 2 MINUTES")
    state = executions.groupBy(*CACHE_KEY).agg(F.bool_or(F.col("status") == "SUCCEEDED").alias("done"), F.bool_or((F.col("status") == "RUNNING") & fresh).alias("busy"))
    out = targets.join(state, list(CACHE_KEY), "left")
    return out.withColumn("cache", F.when(F.col("done"), "hit").when(F.col("busy"), "running").otherwise("miss")).drop("done", "busy")


def quota_reserve(requests: DataFrame, limits: DataFrame, attempts: int = 2) -> DataFrame:
    """requests (org_id, day, request_no) with `granted`: in order, while all attempts of the day stay within the limit."""
    w = Window.partitionBy("org_id", "day").orderBy("request_no")
    used = F.row_number().over(w) * attempts + F.coalesce("used", F.lit(0))
    return requests.join(limits, ["org_id", "day"], "left").withColumn("granted", F.coalesce(used <= F.col("limit"), F.lit(False))).drop("limit", "used")


def propagate_steps(enrichments: DataFrame, members: DataFrame) -> DataFrame:
    """The i-th step of a story as the title of the i-th member by depth, the i-th error as that of the i-th exception.

    enrichments: run_id, entry_key, steps, errors; members: run_id, entry_key, member_key, kind, depth.
    """
    thrown = F.col("kind") == "EXCEPTION"
    placed = members.where("depth > 0").withColumn("thrown", thrown).withColumn("i", F.row_number().over(Window.partitionBy("run_id", "entry_key", "thrown").orderBy("depth", "member_key")) - 1)
    told = [enrichments.select("run_id", "entry_key", F.lit(flag).alias("thrown"), F.posexplode(c).alias("i", "title")) for c, flag in (("steps", False), ("errors", True))]
    title = F.trim(F.regexp_replace("title", r"^\s*\d+[.)]\s*", ""))
    title = F.when(F.length(title) > 60, F.concat(F.substring(title, 1, 57), F.lit("..."))).otherwise(title)
    return placed.join(told[0].union(told[1]), ["run_id", "entry_key", "thrown", "i"]).select("run_id", "entry_key", "member_key", title.alias("title"))


def enrichment_progress(endpoints: DataFrame, executions: DataFrame) -> DataFrame:
    """run_id, total, ready, running, failed and whole percent, by the latest execution of each endpoint.

    executions: run_id, stable_key, seq, status.
    """
    last = executions.groupBy("run_id", "stable_key").agg(F.max_by("status", F.struct("seq", "status")).alias("status"))
    out = endpoints.join(last, ["run_id", "stable_key"], "left").groupBy("run_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(n) for n, s in (("ready", "SUCCEEDED"), ("running", "RUNNING"), ("failed", "FAILED"))])
    return out.withColumn("percent", F.floor(F.col("ready") * 100 / F.col("total")).cast("long"))


def business_label(nodes: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """nodes with title and subtitle: their enrichment's title, else that of the first rule (pattern, title, subtitle)
    whose pattern the kind and label meet; the rules are one expression."""
    text = F.lower(F.concat_ws(" ", "kind", "label"))
    made, sub = F.col("label"), F.lit(None).cast("string")
    for pattern, t, s in reversed(rules):
        hit = text.rlike(pattern)
        made, sub = F.when(hit, F.lit(t)).otherwise(made), F.when(hit, F.lit(s)).otherwise(sub)
    return nodes.withColumn("subtitle", sub).withColumn("title", F.coalesce("title", made))


#: What marks a made-up title as one that shouldn't be shown.
BAD_TITLES = (r"missing required field", r"identify missing", r"\b(?:table|column|database schema)\b", r"service:\s*\w+", r"\b(?:validation|entity validation|resource path validation)\b", r"\b(?:service method)\b")
#: What each HTTP method does to one entity, and to one without a name of its own.
VERBS = {"POST": "Create", "PUT": "Update", "PATCH": "Update", "DELETE": "Delete"}


def is_bad_title(title: Column) -> Column:
    """Whether a title is empty or speaks of diagnostics and schemas."""
    bad = F.trim(F.coalesce(title, F.lit(""))) == ""
    for pattern in BAD_TITLES:
        bad = bad | title.rlike(f"(?i){pattern}")
    return F.coalesce(bad, F.lit(True))


def endpoint_title(title: Column, method: Column, path: Column, name: Column, *, methods: dict[str, str] | None = None, paths: list[tuple[str, str]] | None = None, entities: dict[str, tuple[str, str]] | None = None) -> Column:
    """The title of an endpoint: its enrichment's if usable, else by the handler's name, else by the first pattern of
    paths that fits, else the verb with the last part of the path that isn't a parameter.

    methods, paths, entities: the deployment's own words (handler -> title, pattern -> title, part -> one and many).
    """
    verb = F.upper(F.coalesce(method, F.lit("GET")))
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: (x != "") & ~x.isin("api", "v1"))
    detail = F.coalesce(F.startswith(F.try_element_at(parts, F.lit(-1)), F.lit("{")), F.lit(False))
    last = F.coalesce(F.lower(F.try_element_at(F.filter(parts, lambda x: ~F.startswith(x, F.lit("{"))), F.lit(-1))), F.lit("data"))

    def named(many: bool) -> Column:
        out = F.lit(None).cast("string")
        for part, words in (entities or {}).items():
            out = F.when(last == part, F.lit(words[many])).otherwise(out)
        return F.coalesce(out, last)

    made = F.when(detail, F.concat(F.initcap(named(False)), F.lit(" details"))).otherwise(F.concat(F.lit("List of "), named(True)))
    for m, word in VERBS.items():
        made = F.when(verb == m, F.concat(F.lit(f"{word}: "), named(False))).otherwise(made)
    for pattern, text in reversed(paths or []):
        made = F.when(path.rlike(pattern), F.lit(text)).otherwise(made)
    for m, text in (methods or {}).items():
        made = F.when(name == m, F.lit(text)).otherwise(made)
    return F.when(~is_bad_title(title), F.trim(title)).otherwise(made)


#: Categories and fields of an enrichment, and what a claim may not hold.
CATEGORIES = ("BUSINESS_RULE", "VALIDATION_RULE", "AUTHORIZATION_RULE", "DATA_RULE", "SIDE_EFFECT", "UNKNOWN")
FIELDS = tuple(
    "name symbolSignature entryPointKey actors roles security authorization normalizedCondition condition resolvedConstants constants trueOutcomes falseOutcomes outcome "
    "preconditions callPath dataReads dataWrites externalEffects exceptions relatedTests status statuses httpMethod path table column ownerKey enclosingMethod enclosingDeclaration".split()
)
INJECTION = r"(?is)(ignore|disregard|override).{0,60}(instruction|prompt)|(?:system|developer|assistant)\s*:|execute\s+(?:command|shell)|run\s+(?:command|shell)|powershell|curl\s+https?://"
LISTS = ("actors", "businessSteps", "businessRules", "errorScenarios")
RESPONSE = "title string, businessPurpose string, category string, " + ", ".join(f"{x} array<string>" for x in LISTS) + ", supportedFactIds array<string>, claims array<struct<factId:string,field:string,value:string>>"


def fallback_enrichment(facts: DataFrame) -> DataFrame:
    """run_id, node_key and a record made of the facts alone: title, purpose, category and the four lists.

    facts: run_id, node_key, fact_id, properties; of several facts of a node the last by id names method and path, the
    first its handler.  All is one aggregate of a node's facts.
    """
    p, by = F.col("properties"), F.col("fact_id")

    def values(key: str) -> Column:
        """A property that is a list or a single text, as a list."""
        x = S.prop(p, key)
        return F.coalesce(F.from_json(F.when(F.startswith(x, F.lit("[")), x), "array<string>"), F.when(x.isNotNull() & (x != ""), F.array(x)), F.array().cast("array<string>"))

    name = S.prop(p, "name")
    one = facts.select(
        "run_id", "node_key", by, S.prop(p, "httpMethod").alias("method"), S.prop(p, "path").alias("path"), F.when(~F.contains(name, F.lit(" ")), name).alias("name"),
        F.concat(values("table"), values("dataReads"), values("dataWrites")).alias("tables"), values("exceptions").alias("exceptions"), S.prop(p, "normalizedCondition").isNotNull().alias("conditions"),
    )
    out = one.groupBy("run_id", "node_key").agg(
        F.coalesce(F.max_by("method", F.when(F.col("method").isNotNull(), by)), F.lit("")).alias("method"),
        F.coalesce(F.max_by("path", F.when(F.col("path").isNotNull(), by)), F.lit("")).alias("path"),
        F.min_by("name", F.when(F.col("name").isNotNull(), by)).alias("name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tables")))).alias("tables"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("exceptions")))).alias("exceptions"),
        F.bool_or("conditions").alias("conditions"),
        F.array_sort(F.collect_set("fact_id")).alias("supportedFactIds"),
    )
    c, lit = F.col, F.lit
    read = c("method") == "GET"
    verb = F.when(c("method") == "", "HTTP").otherwise(c("method"))
    title = endpoint_title(lit(None).cast("string"), c("method"), c("path"), c("name"))
    work = F.when(F.size("tables") > 0, F.concat(lit("Work on the database ("), F.array_join("tables", ", "), lit(")"))).otherwise("Work of the service")
    http = F.array(*[lit(x) for x in ("400: parameters out of form", "401, 403: not allowed", "404: not found", "500: failure of the service")])
    return out.select(
        "run_id", "node_key", title.alias("title"), F.concat(title, lit(" by "), verb, lit(" "), c("path")).alias("businessPurpose"), F.when(read, "BUSINESS_RULE").otherwise("SIDE_EFFECT").alias("category"),
        F.array_compact(F.array(F.when(read, "User").otherwise("Administrator or client"), F.when(c("path").rlike("/(internal|system)/"), "Internal service"))).alias("actors"),
        F.array(F.concat(lit("Take and check the parameters of "), verb, lit(" "), c("path")), lit("Check what the caller may do"), work, lit("Answer the caller")).alias("businessSteps"),
        F.array_compact(F.array(lit("The caller is known"), F.when(c("conditions"), "Bounds and identifiers are checked"), F.when(F.contains("path", lit("{")), "What is asked for exists"))).alias("businessRules"),
        F.when(F.size("exceptions") > 0, c("exceptions")).otherwise(http).alias("errorScenarios"), "supportedFactIds",
    )


def validate_enrichment(responses: DataFrame, facts: DataFrame) -> DataFrame:
    """Responses (run_id, node_key, response) as records, each with what it lacks from fallback_enrichment(facts).

    A response that is no JSON object is replaced as a whole (origin HEURISTIC).  Titles under three characters, empty
    purposes and empty lists are filled; unknown categories become UNKNOWN; of the facts it names those of the node
    count, all if none is; claims stay that name a fact of the node and a known field, and hold no instructions.
    """
    raw = F.regexp_replace(F.trim("response"), r"^```(?:json)?\s*|\s*```$", "")
    r = responses.select("run_id", "node_key", F.when(F.startswith(raw, F.lit("{")) & F.try_parse_json(raw).isNotNull(), F.from_json(raw, RESPONSE)).alias("r"))
    out = fallback_enrichment(facts).join(r, ["run_id", "node_key"])
    c, has = F.col, F.col("r").isNotNull()
    title, purpose = F.trim(F.coalesce("r.title", F.lit(""))), F.trim(F.coalesce("r.businessPurpose", F.lit("")))
    claims = F.coalesce(F.filter("r.claims", lambda x: F.array_contains("supportedFactIds", x["factId"]) & x["field"].isin(*FIELDS) & ~x["value"].rlike(INJECTION)), F.from_json(F.lit("[]"), "array<struct<factId:string,field:string,value:string>>"))
    named = F.array_intersect(F.coalesce("r.supportedFactIds", F.array().cast("array<string>")), "supportedFactIds")
    supported = F.array_sort(F.array_union(F.when(F.size(named) > 0, named).otherwise(c("supportedFactIds")), F.transform(claims, lambda x: x["factId"])))
    known = F.when(F.col("r.category").isin(*CATEGORIES), c("r.category")).otherwise("UNKNOWN")
    return out.select(
        "run_id", "node_key", F.when(has & (F.length(title) >= 3), title).otherwise(c("title")).alias("title"), F.when(has & (purpose != ""), purpose).otherwise(c("businessPurpose")).alias("businessPurpose"),
        F.when(has, known).otherwise(c("category")).alias("category"), *[F.when(F.coalesce(F.size(f"r.{x}") > 0, F.lit(False)), c(f"r.{x}")).otherwise(c(x)).alias(x) for x in LISTS],
        F.when(has, supported).otherwise(c("supportedFactIds")).alias("supportedFactIds"), F.when(has, claims).otherwise(F.array()).alias("claims"),
        F.lit("UNVERIFIED").alias("trust"), F.when(has, "LLM_ENRICHMENT").otherwise("HEURISTIC").alias("origin"),
    )
