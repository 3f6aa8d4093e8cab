"""Fixed values.

Everything in this module is a value that has to be exactly what it is for the
results to be right: word lists, limits, patterns, labels and wording. Nothing
here is logic. Patterns are plain regular-expression text; ``words`` lists are
turned into whole-word patterns by ``functions.text.whole_words``.
"""

# --- corpus selection -------------------------------------------------------
SOURCE_EXTENSIONS = ["ts", "tsx", "js", "jsx", "py", "java"]
DEFAULT_EXCLUDES = [
    "node_modules",
    "bower_components",
    "dist",
    "build",
    ".next",
    ".nuxt",
    "coverage",
    ".git",
    ".codestrata",
    "**/*.d.ts",
    "**/*.min.js",
    "**/__pycache__",
    "**/*.class",
]
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "py": "python",
    "java": "java",
}

# --- markers and generic word lists -----------------------------------------
MARKERS = ["TODO", "FIXME", "HACK"]
HTTP_CLIENTS = [
    "requests",
    "httpx",
    "aiohttp",
    r"urllib\.request",
    "fetch",
    "RestTemplate",
    "WebClient",
    "HttpClient",
    "OkHttpClient",
    "FeignClient",
]

# --- Python and Java functions ----------------------------------------------
PYTHON_DEF = (
    r"^(\s*)(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)\s*(?:->\s*[^:]+)?\s*:"
)
JAVA_TYPE_WORDS = ["class", "record", "interface", "enum"]
JAVA_CONSTRUCTOR_MODIFIERS = ["public", "private", "protected"]
JAVA_METHOD_MODIFIERS = [
    "public",
    "private",
    "protected",
    "static",
    "final",
    "abstract",
    "synchronized",
    "native",
    "default",
    "strictfp",
]
JAVA_NOT_METHODS = ["if", "for", "while", "switch", "catch"]
JAVA_ANNOTATIONS = r"^\s*(?:@[\w.]+(?:\([^)]*\))?\s+)*"
CONDITION_WORDS = [
    "if", "elif", "else if", "for", "while", "case", "catch", "except", "switch",
]
TRY_WORDS = ["try", "catch", "except", "finally"]
PYTHON_BRANCH_WORDS = ["if", "elif", "else", "for", "while", "try", "except"]
JAVA_BRANCH_WORDS = ["if", "for", "while", "switch", "try", "catch"]
MIN_HASHED_LINES = 8

PYTHON_IMPORT_LINE = r"^\s*(import|from)\s+"
PYTHON_IMPORT_SOURCE = r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"
JAVA_IMPORT_SOURCE = r"^\s*import\s+(?:static\s+)?([\w.*]+);"
PYTHON_EXPORT_LINE = r"^(?:async\s+)?def\s+|^class\s+"
JAVA_EXPORT_LINE = r"^\s*public\s+"

# --- responsibility tags, Python and Java -----------------------------------
TAG_VALIDATION_WORDS = [
    "validate", "schema", "pydantic", "BaseModel", "Field", "validator", "marshmallow",
    r"javax\.validation", r"jakarta\.validation", "required", "Validated", "Valid",
    "NotNull", "NotBlank", "NotEmpty", "Size", "Pattern",
]
TAG_DATABASE_WORDS = [
    "sqlalchemy", r"django\.db", "Session", "Repository", "CrudRepository",
    "JpaRepository", "EntityManager", "JdbcTemplate", "jdbc", "database", "query",
]
TAG_DATABASE_ANNOTATIONS = ["Entity", "Table", "Repository"]
TAG_AUTH_WORDS = [
    "auth", "permission", "jwt", "token", "login", "logout", "security",
    "OAuth2PasswordBearer", "Principal",
]
TAG_ROUTING_WORDS = [
    "route", "router", "APIRouter", "Controller", "RestController", "RequestMapping",
    "GetMapping", "PostMapping", "PutMapping", "PatchMapping", "DeleteMapping",
    "Flask", "FastAPI", "Django",
]
TAG_ROUTING_DECORATOR = r"@\w+\.(?:route|get|post|put|patch|delete)\s*\("
TAG_LOGIC_WORDS = [
    "if", "for", "while", "switch", "map", "filter", "reduce", "calculate", "compute",
    "transform", "normalize",
]
TAG_LOGIC_JAVA_CLASS = r"class\s+[A-Z]"

# --- responsibility tags, TypeScript and JavaScript --------------------------
SCRIPT_STATE_WORDS = [
    "useState", "useReducer", "useEffect", "useMemo", "useCallback", "zustand", "redux",
    "jotai",
]
SCRIPT_VALIDATION_WORDS = [
    "validate", "schema", "zod", "yup", "joi", "parse", "safeParse", "required",
]
SCRIPT_DATABASE_WORDS = ["prisma", "drizzle", "mongoose", "sequelize", "typeorm"]
SCRIPT_DATABASE_PREFIXES = ["sql`", r"db\."]
SCRIPT_AUTH_WORDS = [
    "auth", "session", "jwt", "token", "permission", "role", "login", "logout",
]
SCRIPT_ROUTING_WORDS = ["useRouter", "react-router", "next/navigation"]
SCRIPT_ROUTING_PREFIXES = [r"router\.", r"redirect\(", r"navigate\("]
SCRIPT_STYLING_WORDS = ["className", "tailwind"]
SCRIPT_STYLING_PREFIXES = ["style=", r"styled\.", "css`", "sx=", r"styles\."]
SCRIPT_LOGIC_WORDS = [
    "map", "filter", "reduce", "sort", "calculate", "compute", "transform", "normalize",
]

# --- request calls, TypeScript and JavaScript --------------------------------
NETWORK_NAMES = ["fetch", "request"]
NETWORK_RECEIVERS = ["axios", "ky"]
DATA_HOOK_NAMES = ["useQuery", "useMutation", "useSWR"]
PROMISE_METHODS = ["then", "catch", "finally"]
QUERY_BUILDER_RECEIVER = "supabase"
QUERY_BUILDER_START = "from"
HTTP_VERBS = ["get", "post", "put", "patch", "delete", "request"]
CLIENT_NAMES = [
    "api", "apiClient", "http", "httpClient", "client", "request", "axios", "ky", "trpc",
]
SERVICE_MODULE = r"(^|/)(api|services?)(/|$)"
CLIENT_MODULE = r"(^|/)(api|services?|client|http)(/|$)"
INLINE_STYLE = "style={{"
MAX_STORED_CALLS = 8

# --- limits used by rules and scores -----------------------------------------
SMALL_TEST_FILE_LINES = 300
LARGE_TRY_LINES = 40
DEEP_NESTING = 3
SENSITIVE_TAGS = ["auth", "database", "validation"]
DUPLICATE_GROUPS_PER_REPO = 10
COMPLEX_FUNCTIONS_PER_FILE = 3
LABEL_HIGH = 75
LABEL_MEDIUM = 40
ANONYMOUS_PREFIX = "anonymous_line_"
BLOB_READER_REQUEST = "XMLHttpRequest"
BLOB_READER_TYPE = r"responseType\s*=\s*['\"]blob['\"]"
BLOB_READER_TITLE = "Extract Shared Local File Blob Reader"
BLOB_READER_LABEL = "Local File Blob Reader"
BLOB_READER_HELPER = "readLocalFileAsBlob"

# --- project facts -------------------------------------------------------------
LOCK_FILES = [
    ("pnpm-lock.yaml", "pnpm"),
    ("yarn.lock", "yarn"),
    ("bun.lockb", "bun"),
    ("bun.lock", "bun"),
    ("package-lock.json", "npm"),
]
FRAMEWORK_DEPENDENCIES = [
    (["expo", "expo-router"], "expo"),
    (["react-native"], "react-native"),
    (["next"], "next"),
    (["react", "react-dom"], "react"),
    (["express"], "express"),
]
TEST_DEPENDENCIES = [
    (["vitest"], "vitest"),
    (["jest"], "jest"),
    (["@playwright/test", "playwright"], "playwright"),
]
CHECK_SCRIPTS = ["typecheck", "test", "lint", "build"]
SCRIPT_COMMANDS = {"pnpm": "pnpm ", "yarn": "yarn ", "bun": "bun run ", "npm": "npm run "}

# --- opportunity types -------------------------------------------------------------
SPLIT, HOOK, SERVICE = "split-large-component", "extract-hook", "extract-service-layer"
SIMPLIFY, BOUNDARIES = "simplify-complex-function", "improve-module-boundaries"
ADD_TESTS, DEAD_CODE, DEDUPLICATE = (
    "add-tests-before-refactor", "remove-dead-code", "deduplicate-logic",
)
TYPE_LABELS = {
    SPLIT: "Split Large Component",
    HOOK: "Extract Custom Hook",
    SERVICE: "Extract Service Layer",
    DEDUPLICATE: "Deduplicate Logic",
    SIMPLIFY: "Simplify Complex Function",
    BOUNDARIES: "Improve Module Boundaries",
    ADD_TESTS: "Add Tests Before Refactor",
    DEAD_CODE: "Remove Dead or Suspicious Code",
}
# {subject} is the displayed name, {focus} the function or file in back ticks.
# Keys ending in "/service" hold the wording for UI files that call services only.
TITLES = {
    SPLIT: "Split Large {subject} Component",
    HOOK: "Extract Hook From {subject}",
    SERVICE: "Move API Calls Out Of {subject}",
    SERVICE + "/service": "Move Data Loading Out Of {subject}",
    SIMPLIFY: "Simplify {subject}",
    BOUNDARIES: "Clarify Responsibilities In {subject}",
    ADD_TESTS: "Add Tests Before Refactoring {subject}",
    DEAD_CODE: "Review TODOs In {subject}",
    DEDUPLICATE: "Deduplicate {subject} Logic",
}
EXPLANATIONS = {
    SPLIT: "This React file is large enough that rendering, state, data shaping, and event handling are likely competing in one place. Splitting it into smaller components and hooks should make changes easier to review and test.",
    HOOK: "This component uses enough hooks that state transitions, effects, and rendering are probably tightly coupled. Extracting a focused hook can isolate behavior while keeping the UI component easier to scan.",
    SERVICE: "The UI appears to perform network or request work directly. Moving request code into a service or API module makes the component easier to test and keeps transport details out of rendering code.",
    SERVICE + "/service": "The UI calls data/service functions directly. Moving loading orchestration into a hook can keep data state and rendering concerns easier to test independently.",
    SIMPLIFY: "This function is long or branch-heavy enough that it is hard to reason about all paths at once. Smaller helpers and guard clauses can reduce local complexity without changing public behavior.",
    BOUNDARIES: "This file appears to combine several responsibilities. Clearer module boundaries reduce the chance that a UI, data, validation, or state change accidentally affects unrelated behavior.",
    ADD_TESTS: "This area has enough complexity or sensitivity that changing structure without tests would be risky. Characterization tests should lock down current behavior before any extraction work starts.",
    DEAD_CODE: "TODO, FIXME, or HACK comments are signs that code may contain unfinished decisions or temporary workarounds. These should be triaged before broader refactors rely on them.",
    DEDUPLICATE: "The scanner found matching function bodies in multiple files. Extracting shared logic can reduce maintenance cost, but the existing call sites should be covered before changing imports.",
}
STEPS = {
    SPLIT: [
        "Identify independent UI regions and extract the lowest-risk presentational component first.",
        "Move stateful or data-loading logic into a named custom hook only after current behavior is covered.",
        "Keep the original component as a composition layer so props and visible behavior stay stable.",
    ],
    HOOK: [
        "Group related state, effects, and derived values by responsibility.",
        "Extract one cohesive group into a `useX` hook with a small return shape.",
        "Leave JSX and styling in the component; keep the hook free of rendering concerns.",
    ],
    SERVICE: [
        "Identify fetch, client, or request calls inside the UI file.",
        "Create or reuse a service module for the request and response normalization.",
        "Update the component to consume the extracted boundary without changing visible behavior.",
    ],
    SERVICE + "/service": [
        "Identify service/data calls and the loading, error, and refresh state coupled to them.",
        "Extract a focused hook that owns the service calls and exposes a small state/action surface.",
        "Update the component to consume the extracted boundary without changing visible behavior.",
    ],
    SIMPLIFY: [
        "Add characterization coverage for the important branches before changing structure.",
        "Extract pure helper functions for repeated decisions or transformations.",
        "Prefer guard clauses to reduce nesting, and keep function inputs and outputs unchanged.",
    ],
    BOUNDARIES: [
        "List the responsibilities currently present in the file.",
        "Extract the responsibility with the smallest external surface first.",
        "Keep public imports stable until tests prove the boundary change is safe.",
    ],
    ADD_TESTS: [
        "Add focused tests around {focus} and the most important user-visible or data behavior.",
        "Cover success, failure, and edge-case branches that are easy to break during extraction.",
        "Run the test suite before starting any structural refactor.",
    ],
    DEAD_CODE: [
        "Review each TODO/FIXME/HACK and decide whether it is still relevant.",
        "Convert real follow-up work into tracked issues or small code changes.",
        "Remove stale comments only after confirming the surrounding behavior is still needed.",
    ],
    DEDUPLICATE: [
        "Compare the duplicated functions and confirm they are intentionally equivalent.",
        "Add tests around at least one current call site before extracting a shared helper.",
        "Move the shared behavior into a utility module and update one call site at a time.",
    ],
}
TESTS_WHEN_COVERED = {
    SPLIT: "Extend the existing component test around the UI behavior being extracted.",
    HOOK: "Cover the state/effect behavior that will move into the hook.",
    SERVICE: "Mock the service boundary in the existing UI test.",
    SERVICE + "/service": "Mock the service boundary in the existing UI test.",
    SIMPLIFY: "Add branch-focused cases for {focus}.",
    BOUNDARIES: "Keep existing tests passing and add coverage around the extracted boundary.",
    ADD_TESTS: "Characterization tests for {focus} branches.",
    ADD_TESTS + "/file": "Characterization tests for current file behavior.",
    DEAD_CODE: "Run nearby tests before removing or changing suspicious code.",
    DEDUPLICATE: "Characterization tests for the duplicated behavior before extraction.",
}
TESTS_WHEN_UNCOVERED = {
    SPLIT: "Add a render or behavior test for the component before splitting it.",
    HOOK: "Add a component behavior test or hook test before moving stateful logic.",
    SERVICE: "Add a smoke test for loading, success, and error UI states before extracting requests.",
    SERVICE + "/service": "Add a smoke test for loading, success, and error UI states before extracting requests.",
    SIMPLIFY: "Add characterization tests for {focus} before refactoring.",
    BOUNDARIES: "Add tests around the behavior owned by each responsibility before moving code.",
    ADD_TESTS: "Characterization tests for {focus} branches.",
    ADD_TESTS + "/file": "Characterization tests for current file behavior.",
    DEAD_CODE: "Add a focused test if the comment points at risky behavior.",
    DEDUPLICATE: "Characterization tests for the duplicated behavior before extraction.",
}
FIRST_STEP_FALLBACK = "Inspect the file and confirm the opportunity."
FIRST_TEST_FALLBACK = "Run existing tests before changing code."
EXPLAIN_COVERED_FALLBACK = "Run nearby tests before changing structure."
EXPLAIN_UNCOVERED_FALLBACK = "Add characterization tests before refactoring this file."
EVIDENCE_FALLBACK = "Scanner found structural indicators for this opportunity."
REPORT_EVIDENCE_FALLBACK = "Structural heuristic matched this opportunity."

# --- task brief wording --------------------------------------------------------------
BRIEF_CONSTRAINTS = [
    "Do not change user-facing behavior.",
    "Do not change public API names unless absolutely necessary.",
    "Keep existing tests passing.",
    "Add tests before refactoring if behavior is not currently covered.",
    "Prefer small, reviewable changes.",
    "Do not make unrelated formatting-only rewrites.",
]
BRIEF_BOUND = "Only work on the files listed below and the smallest extracted helper, hook, service, or test needed for this opportunity. Do not combine this task with nearby refactors from the report."
BRIEF_PLAN = [
    "Read the target file and identify its current responsibilities.",
    "Add or update tests for current behavior before moving risky logic.",
    "Extract the lowest-risk helper, hook, component, or service first.",
    "Run tests and typecheck after the first extraction.",
    "Continue extraction only if tests pass.",
    "Summarize the final diff and any behavior intentionally left unchanged.",
]
BRIEF_ACCEPTANCE = [
    "Existing behavior is unchanged.",
    "Tests pass.",
    "Main file is shorter or easier to scan.",
    "Extracted modules have clear names and single responsibilities.",
    "No unrelated files are modified.",
]

# --- run messages -----------------------------------------------------------------------
WARN_NO_VCS = "Git is unavailable for this workspace, so unrelated changed files could not be inspected."
WARN_NO_COMMANDS = "No check commands were run."
WARN_OUTSIDE = "Files outside the refactor scope changed: "
WARN_WORSE = "Target file appears materially larger or more complex: "
FAIL_REMOVED = "Target file was removed: "
SUMMARY_CHECKED = "Completed with check recommendation: {verdict}."
SUMMARY_UNCHECKED = "Completed without a recorded check result."
