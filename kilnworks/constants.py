"""Thresholds, caps and closed vocabularies that decide results."""

# Regression thresholds.
REGRESSION_MIN_SECONDS = 0.5
REGRESSION_MIN_PERCENT = 10.0

# Fewest builds for which a percentile is meaningful.
MIN_HISTORY = 5

# Row caps per build in a stored document.
MAX_TARGETS_LOCAL = 100
MAX_TARGETS_PUSHED = 40
MAX_PHASES = 64
MAX_FILES = 500
MAX_SWIFT_TIMINGS = 500
MAX_DIAGNOSTICS = 500
MAX_TESTS = 2000

# Row caps per build in a standard-detail activity summary.
STANDARD_PHASES = 100
STANDARD_FILES = 50
STANDARD_SWIFT_TIMINGS = 50
STANDARD_STEPS_PER_TARGET = 20

# Row caps of the build detail view.
DETAIL_TARGETS = 100
DETAIL_PHASES = 50
DETAIL_FILES = 50
DETAIL_SWIFT_TIMINGS = 50
DETAIL_DIAGNOSTICS = 50
DETAIL_TESTS = 50
DETAIL_STEPS = 500

SLOWEST_TESTS = 20
SLOWEST_TIMING_TARGETS = 10
GRAPH_HOTSPOTS = 20

# Bottleneck ranking.
BOTTLENECK_MIN_SECONDS = 1.0
BOTTLENECK_LIMIT = 5

# Type-check advice.
ADVICE_SITE_MS = 150.0
ADVICE_SITE_LIMIT = 5
ADVICE_BODY_LINES = 200
ADVICE_FILE_SHARE = 0.25
ADVICE_FILE_MS = 400.0
ADVICE_TARGET_SHARE = 0.15
ADVICE_TARGET_MS = 1500.0

# Evidence weights.
EVIDENCE_EXACT = 30
EVIDENCE_SUFFIX = 25
EVIDENCE_REGRESSION = {"high": 25, "medium": 15, "low": 5}
EVIDENCE_DIAGNOSTIC = 20
EVIDENCE_SUITE = 15
EVIDENCE_ENVIRONMENT = -20
EVIDENCE_SUSPENDED = -25
EVIDENCE_MIN_CONFIDENCE = 25
EVIDENCE_MIN_POSITIVE = 2

# Change-relation weights and thresholds.
RELATION_DIAGNOSTIC = 60
RELATION_MANIFEST = 20
RELATION_FAILURES = 10
RELATION_CRASH = 10
RELATION_LIKELY = 60
RELATION_UNRELATED = 20

# A step may start this many seconds before its build and still count as run.
CLOCK_SKEW_SECONDS = 1.0
APPLE_EPOCH_OFFSET = 978_307_200.0

WIRE_VERSION = 2

BUILD_CATEGORIES = ("clean", "incremental", "noop", "unknown")
BUILD_STATUSES = ("succeeded", "failed", "cancelled", "pending_tests")
ATTRIBUTIONS = ("anonymous", "pseudonymous", "identified")

# Steps that run whether or not anything was compiled.
NON_COMPILATION_STEPS = ("other", "scriptExecution", "copySwiftLibs")

# Phases of a log that set up a build service without building.
SETUP_PHASES = (
    "Send project description to build service",
    "Create build operation",
    "Create build request",
    "Build preparation",
    "Prepare packages",
    "Compute target dependency graph",
    "Cleaning",
    "Prepare clean",
)

# Warnings that say a log was only partly decoded.
PARTIAL_DECODE_MARKERS = ("keeping partial result", "truncated", "unknown SLF")

KNOWN_ARCHITECTURES = (
    "arm64",
    "arm64e",
    "arm64_32",
    "armv7",
    "armv7k",
    "armv7s",
    "x86_64",
    "x86_64h",
    "i386",
)

SWIFT6_CATEGORIES = ("swift_concurrency", "swift_sendable", "swift_actor_isolation")

TAG_MAX_KEY = 64
TAG_MAX_VALUE = 256
USER_MAX_ENTRIES = 64
