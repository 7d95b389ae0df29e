"""Scalar functions over facts and properties, as Spark columns.  Properties are JSON text of an object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factgraph.functions import vocabulary as V


def canonical_json(x: Column) -> Column:
    """The JSON text with the keys of every object sorted; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(x))


def text_hash(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def hash_bytes(x: Column) -> Column:
    """What text_hash() gives as its bytes, in the same order at half the size; other texts as they are."""
    return F.coalesce(F.when(F.startswith(x, F.lit("sha256:")), F.unhex(F.substring(x, 8, 64))), x.cast("binary"))


def content_hash(x: Column) -> Column:
    """The hash of JSON text, whatever the order of its keys."""
    return text_hash(canonical_json(x))


def prop(props: Column, key: str) -> Column:
    """A property as text: strings as they are, other values as JSON; null if absent or null."""
    return F.get_json_object(props, f"$['{key}']")


def has_prop(props: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(props), key), F.lit(False))


def is_true(props: Column, key: str) -> Column:
    return _is_boolean(props, key, "true")


def is_false(props: Column, key: str) -> Column:
    return _is_boolean(props, key, "false")


def _is_boolean(props: Column, key: str, value: str) -> Column:
    """Whether a property is this Boolean; its name as a text is not."""
    typed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(props), f"$['{key}']", "variant")) == "BOOLEAN"
    return F.coalesce((prop(props, key) == value) & typed, F.lit(False))


def list_size(props: Column, key: str) -> Column:
    return F.coalesce(F.json_array_length(prop(props, key)), F.lit(0))


def _without(parsed: Column, keys: tuple[str, ...]) -> Column:
    own = F.try_variant_get(parsed, "$", "map<string,variant>")  # with its keys sorted
    # what a lambda holds is computed for each key that gets to it: the map is looked at again for these two alone
    stated = F.map_contains_key(own, F.lit("normalizedCondition"))
    return F.to_json(F.map_filter(own, lambda k, _: ~k.isin(*keys) & ~(k.isin("condition", "sourceExpression") & stated)))


def behavioral(props: Column) -> Column:
    """The properties that say what a thing does, as canonical JSON: without where it stands and how it is shown."""
    return behavioral_of(F.try_parse_json(props))


def behavioral_of(parsed: Column) -> Column:
    """behavioral() of properties that are parsed already."""
    return _without(parsed, V.PRESENTATION)


def kind_hash(kind: Column, props: Column) -> Column:
    return text_hash(F.concat(F.lit('{"kind":'), F.to_json(F.array(kind)), F.lit(',"properties":'), props, F.lit("}")))


def fingerprint(kind: Column, props: Column) -> Column:
    return kind_hash(kind, behavioral(props))


def structural(kind: Column, props: Column) -> Column:
    """A fingerprint that a rename or a move to another owner leaves as it is."""
    return kind_hash(kind, _without(F.try_parse_json(props), (*V.PRESENTATION, "ownerKey", "symbolSignature")))


def node_kind(kind: Column, props: Column) -> Column:
    effect = F.coalesce(prop(props, "effectKind"), F.lit(""))
    return (
        F.when(kind == "TYPE", F.when(F.lower(F.coalesce(prop(props, "typeKind"), F.lit(""))) == "interface", "INTERFACE").otherwise("CLASS"))
        .when(kind == "ORM_ENTITY", "ENTITY")
        .when(kind == "DATA_READ", "DATABASE_READ")
        .when(kind == "DATA_WRITE", "DATABASE_WRITE")
        .when(kind == "TEST", "TEST_CASE")
        .when(kind == "FAILURE_BRANCH", "EXCEPTION")
        .when((kind == "SIDE_EFFECT") & effect.isin(*V.EFFECT_KINDS), effect)
        .otherwise(kind)
    )


def _case(of: Column, values: dict, other) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(of == k, F.lit(v))
    return out.otherwise(F.lit(other))


def origin_order(origin: Column) -> Column:
    """Which origin is believed first: the smallest number."""
    return _case(origin, V.ORIGIN_ORDER, 4)


def confidence_ceiling(origin: Column, reported: Column, props: Column, partial: Column) -> Column:
    """The confidence that an origin allows: less if unresolved, ambiguous or of partial coverage, never more than reported."""
    top = _case(origin, V.ORIGIN_CEILING, V.OTHER_CEILING)
    top = F.when(is_false(props, "resolved"), F.least(top, F.lit(0.45))).otherwise(top)
    top = top - F.least(F.lit(0.3), list_size(props, "ambiguities") * 0.1) - F.when(partial, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(top, reported))


def list_union(a: Column, b: Column) -> Column:
    return F.array_union(F.coalesce(a, F.array()), F.coalesce(b, F.array()))


def contains_ci(label: Column, key: Column, needle: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", label, key)), F.lower(F.lit(needle)))


def slim_properties(props: Column, limit: int = 16384) -> Column:
    """Properties as they are shown: without alternatives, or only which they are if still too long."""
    own = F.from_json(canonical_json(props), "map<string,variant>")
    slim = F.to_json(F.map_filter(own, lambda k, _: k != "factAlternatives"))
    stub = F.to_json(F.map_filter(own, lambda k, _: k.isin("name", "filePath", "ownerKey", "symbolSignature")))
    return F.when(F.octet_length(slim) <= limit, slim).otherwise(stub)


def owner_name(key: Column) -> Column:
    """The short name in an owner key: what follows the last dot."""
    return F.substring_index(key, ".", -1)


def owner_package(key: Column) -> Column:
    """What stands between the last colon and the last dot."""
    return F.regexp_extract(F.substring_index(key, ":", -1), r"^(.*)\.[^.]*$", 1)


def declaration_of(kind: Column, snippet: Column) -> Column:
    """The line that declares a type, what stands before the first brace, or the first line."""
    lines = F.split(snippet, "\n")
    typed = F.element_at(F.filter(lines, lambda x: x.rlike(r"\b(class|interface|record|enum)\b")), 1)
    head = F.trim(F.substring_index(snippet, "{", 1))
    return F.when(kind.isin("CLASS", "INTERFACE", "ENTITY", "DTO") & typed.isNotNull(), F.trim(typed)).when(F.contains(snippet, F.lit("{")) & (head != ""), head).otherwise(F.trim(lines[0]))


def return_node_id(node_id: Column) -> Column:
    """The name-based (version 3) UUID of a node's return."""
    h = F.md5(F.concat(node_id, F.lit(":return")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("bigint")))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def redact_secrets(text: Column) -> Column:
    """Masks authorization headers and the values of passwords, secrets, keys and tokens."""
    text = F.regexp_replace(text, r"(?i)(authorization\s*[:=]\s*)(bearer|basic)?\s*\S+", "$1[REDACTED]")
    return F.regexp_replace(text, r"(?i)((?:password|secret|api[-_]?key|token)\s*[:=]\s*)\S+", "$1[REDACTED]")


def source_layer(frameworks: Column, origin: Column) -> Column:
    """DATABASE, BACKEND or FRONTEND where exactly one of the sides speaks."""
    back = F.arrays_overlap(frameworks, F.array(*map(F.lit, ("spring", "spring-boot", "jakarta", "express", "nestjs", "django", "fastapi"))))
    front = F.arrays_overlap(frameworks, F.array(*map(F.lit, ("react", "angular", "vue", "svelte", "nextjs"))))
    return F.when(origin == "DATABASE_DERIVED", "DATABASE").when(back & ~front, "BACKEND").when(front & ~back, "FRONTEND")
