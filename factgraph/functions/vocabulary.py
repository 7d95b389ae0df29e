"""The enumerations that the operators test against."""

ENTRY_KINDS = ("ENDPOINT", "SCHEDULED_JOB", "MESSAGE_CONSUMER", "COMMAND_ENTRY_POINT", "UI_ACTION")
RULE_KINDS = ("CONDITION", "DECISION", "BUSINESS_RULE", "BUSINESS_CONSTRAINT", "VALIDATION_RULE", "AUTHORIZATION_RULE", "SECURITY_RULE", "DATA_RULE", "OPERATIONAL_RULE", "COMPLIANCE_RULE", "TECHNICAL_GUARD", "UNKNOWN_RULE")
ORIGINS = ("STATIC_EXACT", "STATIC_TYPED", "STATIC_SYNTAX", "FRAMEWORK_DERIVED", "DATABASE_DERIVED", "RUNTIME_OBSERVED", "HEURISTIC")
ORIGIN_CEILING = {"STATIC_EXACT": 1.0, "DATABASE_DERIVED": 1.0, "RUNTIME_OBSERVED": 1.0, "STATIC_TYPED": 0.98, "STATIC_RESOLVED": 0.98, "FRAMEWORK_DERIVED": 0.92, "STATIC_SYNTAX": 0.75, "STATIC_INFERRED": 0.65, "HEURISTIC": 0.50}
OTHER_CEILING = 0.30
ORIGIN_ORDER = {"STATIC_EXACT": 0, "STATIC_RESOLVED": 1, "STATIC_TYPED": 1, "DATABASE_DERIVED": 1, "RUNTIME_OBSERVED": 2, "FRAMEWORK_DERIVED": 3}
EFFECT_KINDS = ("EXTERNAL_CALL", "EVENT_PUBLICATION", "NOTIFICATION", "CACHE_OPERATION", "FILE_OPERATION")
ASYNC_KINDS = ("EVENT_PUBLICATION", "MESSAGE_PUBLICATION", "MESSAGE_CONSUMER", "EXTERNAL_CALL")
TRAVERSABLE = ("CALLS", "ENTRY_TO", "TRIGGERS", "CONTAINS", "GUARDED_BY", "AUTHORIZED_BY", "VALIDATES", "READS", "WRITES", "FILTERS", "TRANSFORMS", "EMITS", "CALLS_EXTERNAL", "THROWS", "RETURNS", "CHANGES_STATUS", "BRANCH_TRUE", "BRANCH_FALSE", "VERIFIED_BY", "PRECEDES")
IMPACTS = ("THROW", "THROWS", "DOMAIN_EXCEPTION", "BUSINESS_EXCEPTION", "REJECT", "DENY", "ALLOW", "RETURN", "RETURN_STATUS", "STATUS_TRANSITION", "DATABASE_WRITE", "EXTERNAL_CALL", "EVENT_PUBLICATION", "NOTIFICATION", "RESPONSE", "FILTER", "CHANGE_PRICE", "CHANGE_MONEY", "WRITE")
PLUMBING = ("LOGGING", "RETRY", "TIMEOUT", "CACHE_PRESENCE", "PARSER_DEFENSIVE", "FRAMEWORK_BOILERPLATE", "INSTRUMENTATION", "COLLECTION_BOUNDS", "NULL_CHECK")
LOG_GUARDS = ("isTraceEnabled", "isDebugEnabled", "isInfoEnabled", "isWarnEnabled", "isErrorEnabled")
GENERIC_EXCEPTIONS = ("NullPointerException", "IllegalArgumentException", "IndexOutOfBoundsException", "ArrayIndexOutOfBoundsException", "UnsupportedOperationException")
PRESENTATION = ("name", "label", "description", "filePath", "startLine", "endLine", "startColumn", "endColumn", "scoreBreakdown", "provenance", "analyzers", "origins", "frameworks", "componentPaths")
IMPACT_KEYS = (("actors", "ACTOR_CHANGED"), ("roles", "ROLE_CHANGED"), ("allowedStatuses", "ALLOWED_STATUS_CHANGED"), ("dataWrites", "DATABASE_WRITE_CHANGED"), ("externalEffects", "EXTERNAL_EFFECT_CHANGED"), ("ownerKey", "OWNERSHIP_CHANGED"), ("trueOutcomes", "OUTCOME_CHANGED"), ("falseOutcomes", "OUTCOME_CHANGED"))
HIDDEN_DECISIONS = ("REJECTED", "MARKED_TECHNICAL", "MERGED")
VIEW_KINDS = {
    "BUSINESS": ("REPOSITORY", "COMPONENT", "MODULE", "BUSINESS_CONTEXT", "BUSINESS_SCENARIO", "BUSINESS_RULE", "VALIDATION_RULE", "AUTHORIZATION_RULE", "SECURITY_RULE", "ENDPOINT", "SCHEDULED_JOB", "MESSAGE_CONSUMER", "UI_ACTION", "COMMAND_ENTRY_POINT", "ENTITY", "DATABASE_READ", "DATABASE_WRITE", "EVENT_PUBLICATION", "MESSAGE_PUBLICATION", "EXTERNAL_CALL", "RETURN_OUTCOME", "EXCEPTION", "DATA_TRANSFORMATION", "TRANSACTION", "DATA_RULE", "UNKNOWN_RULE"),
    "DATA_OWNERSHIP": ("ENDPOINT", "BUSINESS_SCENARIO", "COMPONENT", "MODULE", "CLASS", "INTERFACE", "ENTITY", "ENTITY_FIELD", "TABLE", "COLUMN", "DATABASE_VIEW", "DATABASE_TRIGGER", "DATABASE_FUNCTION", "DATABASE_READ", "DATABASE_WRITE", "DTO", "DTO_FIELD", "DATA_SOURCE", "EXTERNAL_CALL"),
    "SECURITY": ("AUTHORIZATION_RULE", "SECURITY_RULE", "ENDPOINT", "BUSINESS_SCENARIO", "METHOD", "FUNCTION"),
    "DATA_PIPELINE": ("ENDPOINT", "DTO", "VALIDATION_RULE", "AUTHORIZATION_RULE", "DATA_SOURCE", "DATABASE_READ", "FILTER", "DATA_TRANSFORMATION", "SORT", "AGGREGATION", "DATABASE_WRITE", "RETURN_OUTCOME", "BUSINESS_SCENARIO", "METHOD", "FUNCTION"),
}
VIEWS = ("BUSINESS", "DEVELOPER", "DATA_OWNERSHIP", "SECURITY", "DATA_PIPELINE", "CONFIDENCE")
NOISE_KINDS = ("LITERAL", "PARAMETER", "IMPORT", "ASSIGNMENT", "CONSTANT", "ANNOTATION", "TECHNICAL_GUARD", "FILE", "PACKAGE")
CODE_KINDS = ("CLASS", "INTERFACE", "METHOD", "FUNCTION", "FIELD")
LOD_LIMIT = {0: 80, 1: 120, 2: 250, 3: 500}
LOD0_KINDS = ("REPOSITORY", "COMPONENT", "MODULE")
LOD1_KINDS = ("COMPONENT", "MODULE", "BUSINESS_SCENARIO", "ENDPOINT", "SCHEDULED_JOB", "MESSAGE_CONSUMER", "UI_ACTION", "COMMAND_ENTRY_POINT")
