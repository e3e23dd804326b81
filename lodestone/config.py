"""All constants in one place; what a caller may change is a field of a frozen dataclass."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: results depend on them being exactly these ----

STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "to", "of", "in", "on", "for", "with", "and", "or", "not", "it", "this",
    "that", "these", "those", "at", "by", "from", "as", "into", "where", "how", "what", "when", "which", "who", "whom", "does", "do", "add", "fix",
    "make", "use", "using", "my", "our", "your", "i", "we", "handled", "handle", "implement", "implemented", "implementing", "create", "created",
    "creating", "should", "would", "could", "can", "need", "needs", "want", "please", "some", "any", "all", "there",
]
EVAL_STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "be", "not", "this", "that", "it", "as", "at", "by", "from",
    "into",
]
EXTENSIONS = {
    "typescript": [".ts", ".mts", ".cts", ".tsx"],
    "javascript": [".js", ".mjs", ".cjs", ".jsx"],
    "json": [".json", ".jsonc"],
    "markdown": [".md", ".markdown"],
}
#: Names excluded from every scan; the last is the folder of our own index.
DEFAULT_EXCLUDES = [
    ".git", "node_modules", "dist", "build", "out", "coverage", ".cache", ".tmp", "tmp", ".env", ".env.*", "*.pem", "*.key", "*.log",
    "*.min.js", "*.map", "__pycache__", ".lodestone-store", ".lodestone-store.*",
]
SENSITIVE_PATHS = [
    (r"(?i)(^|/)\.env($|\.)", "environment file"),
    (r"(?i)\.(pem|key|p12|pfx|jks|keystore)$", "key material"),
    (r"(^|/)id_(rsa|dsa|ecdsa|ed25519)($|\.[^.]+$)", "SSH private key"),
    (r"(?i)(^|/)(credentials|secrets?)(\.[^/]+)?$", "credential store"),
    (r"(^|/)\.npmrc$|(^|/)\.pypirc$|(^|/)\.netrc$", "registry credentials file"),
    (r"(?i)(^|/)secrets?\.(ya?ml|json)$", "secrets file"),
    (r"(^|/)\.git-credentials$", "git credential store"),
]
BOT_MARKS = [
    "dependabot", "renovate", "github-actions", "actions-user", "semantic-release-bot", "semantic-release", "codecov", "greenkeeper",
    "changeset-bot", "snaily", "automated", "bot@", "devcontainer", "github bot", "chore", "noreply",
]
LOCKFILES = ["package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "deno.lock", "go.sum", "poetry.lock"]
SEED_LOCKFILES = [*LOCKFILES, "cargo.lock"]
TEST_PATH = r"(?i)(^|/)(__tests__|tests?|spec|specs|e2e)(/|$)|\.((test|spec|e2e)\.[cm]?[jt]sx?|test|spec)$"
SOURCE_PATH = r"(?i)\.[cm]?[jt]sx?$"
DECLARATION_PATH = r"(?i)\.d\.[cm]?tsx?$"
PARSED_PATH = r"(?i)\.(?:(?:m|c)?(?:t|j)sx?|json|jsonc|md|markdown)$"
DOCS_PATH = r"(?i)\.mdx?$|(^|/)docs?(/|$)|(^|/)(changelog|code_of_conduct|contributing|license|readme)"
CI_PATH = r"(?i)^\.github/|(^|/)(\.gitlab-ci|\.circleci|\.travis|jenkinsfile|\.prettierrc|\.eslintrc)|\.(yml|yaml|toml|cfg|ini|editorconfig|npmrc|nvmrc|node-version)$|\.json$"
GENERATED_PATH = r"(?i)(^|/)(?:dist|build|out|coverage|node_modules|\.next|\.nuxt|\.turbo)(?:/|$)|\.(?:min\.js|min\.css|js\.map|css\.map)$"
ENTRY_POINT = r"^(index|main|app|server|entry)\.[cm]?[jt]sx?$"
VERSION_SUBJECT = r"(?i)^(?:chore|build|release|dev)?\s*[(:]?\s*(?:release|v\d|bump(?:\s+(?:version|deps))?|prepare\s+(?:release|for\s+release)|\d+\.\d+\.\d+)|^(?:release|bump)\b"
FORMAT_SUBJECT = r"(?i)\b(?:format(?:ting)?|prettier|lint(?:ing)?|eslint|style:? reformat|clang-format|code style)\b"
REVERT_SUBJECT = r"(?i)^(?:revert\b|this reverts commit )"
#: Tiers from the strongest to the weakest, with the words that explain them.
TIERS = {
    "USER_SELECTED": "explicitly selected by user",
    "EXACT_SYMBOL": "exact symbol match",
    "CHANGE_SEED": "changed in your working tree",
    "DIRECT_DEPENDENCY": "direct dependency",
    "DIRECT_DEPENDENT": "direct dependent",
    "RELEVANT_TESTS": "relevant test",
    "STRONG_LEXICAL": "strong lexical match",
    "ARCHITECTURAL": "architectural context",
    "LOWER_CONFIDENCE": "lower-confidence match",
}
SIGNAL_TEXT = {
    "EXACT_SYMBOL": "Exact symbol match: %s",
    "FILE_NAME": "File name matches query: %s",
    "DIRECT_DEPENDENCY": "Direct dependency: imported by %s",
    "DIRECT_DEPENDENT": "Direct dependent: imports %s",
    "CALL_EDGE": "Call relationship with %s",
    "TEST_OF": "Test file for %s (naming convention)",
    "INHERITANCE": "Inherits from / implements symbol in %s",
    "SAME_DIRECTORY": "Same directory as top match: %s",
    "RECENCY": "Recently modified (git recency, %s)",
    "HUB": "Hub file (most connected): %s",
    "DIFF_TOUCHED": "Changed in your working tree (%s)",
    "DIAGNOSTIC": "Has a diagnostic: %s",
    "STACK_FRAME": "Appears in the parsed stack trace (%s)",
    "SEED_NEIGHBOR": "Graph neighbor of a changed file (%s)",
}
CONTENT_KINDS = ["LEXICAL", "EXACT_SYMBOL", "FILE_NAME"]
STATE_PRIORITY = {"staged": 0, "unstaged": 1, "untracked": 2, "deleted": 3}

# ---- end of fixed values ----


@dataclass(frozen=True)
class Lexical:
    """Weights of the fields and of the parts of the lexical score."""

    symbol: float = 3.0
    path: float = 2.0
    io: float = 2.0
    summary: float = 1.2
    identifier: float = 0.8
    max_tf: int = 10
    body: bool = True
    body_weight: float = 0.5
    k1: float = 1.2
    b: float = 0.75
    reference_length: int = 2000
    body_terms: int = 192
    body_max_tf: int = 8
    identifiers: int = 400
    prefix_discount: float = 0.7
    coverage_base: float = 0.6

    @property
    def max_weight(self) -> float:
        return self.symbol + self.path + self.io + self.summary + self.identifier


@dataclass(frozen=True)
class Retrieval:
    """How signals become a score. Switches: ``fusion``, ``lexical.body``, ``rank_priority``, ``neighbor_boost``."""

    lexical: Lexical = field(default_factory=Lexical)
    exact_symbol: float = 1.0
    file_name: float = 0.8
    lexical_weight: float = 0.9
    recency: float = 0.15
    recency_ranks: int = 25
    dependency: float = 0.6
    dependent: float = 0.5
    call: float = 0.5
    test_of: float = 0.7
    inheritance: float = 0.6
    same_directory: float = 0.2
    structural_cap: float = 1.0
    fusion: bool = True
    fusion_weight: float = 2.0
    seeds: int = 5
    depth: int = 2
    limit: int = 20
    rank_priority: int = 6
    seed_weights: dict = field(default_factory=lambda: {"DIFF_TOUCHED": 0.6, "OPEN_EDITOR": 0.3, "DIAGNOSTIC": 0.4, "STACK_FRAME": 0.4, "SELECTION": 0.8})
    neighbor_boost: float = 0.0
    #: "slots" appends seeds that did not rank; "signal-only" doesn't.
    slot_policy: str = "signal-only"


@dataclass(frozen=True)
class Budget:
    """Hard limits of a package; a value under the least allowed is an error."""

    max_files: int = 40
    max_chars: int = 120_000
    max_lines: int = 3_000
    max_tokens: int = 30_000
    max_graph_depth: int = 3
    max_lines_per_file: int = 400
    tree_depth: int = 4
    change_tokens: int = 1_500
    tree_entries: int = 400

    def __post_init__(self):
        for name, least in {"max_files": 1, "max_chars": 1000, "max_lines": 10, "max_tokens": 100, "max_graph_depth": 1, "max_lines_per_file": 10, "tree_depth": 1, "change_tokens": 0}.items():
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")


LEXICAL, RETRIEVAL, BUDGET = Lexical(), Retrieval(), Budget()
EVAL_SEED, EVAL_LIMIT = 20260918, 50
