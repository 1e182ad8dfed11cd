"""Screening rules held as data.

A :class:`RuleSet` is a handful of typed rules (tens of rows) living on the driver. Operators turn it
into Column expressions while the plan is built, so no rule table is ever joined or shipped to
executors. Two sets are provided: ``REPAIRED`` (the default) holds the rules as they were plainly
meant, ``SHIPPED`` holds them as the configuration spells them: typos in a character class or a group
opener change what a rule matches, or make the rule invalid so that it is silently absent.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from .functions.regex import compile_check

SEVERITY_WEIGHT = {"low": 0.2, "medium": 0.4, "high": 0.7, "critical": 1.0}

# Score at which a text is blocked / warned about, per sensitivity.
THRESHOLDS = {"low": (0.8, 0.6), "medium": (0.6, 0.4), "high": (0.4, 0.2)}


# The first row with a keyword occurring in a rule's description names its threat type.
_TYPE_KEYWORDS = (
    ("instruction_override", ("override", "instruction")),
    ("role_manipulation", ("role", "manipulation")),
    ("prompt_extraction", ("prompt", "extract")),
    ("code_execution", ("code", "exec")),
    ("encoding_bypass", ("encod", "bypass")),
    ("tag_injection", ("tag",)),
)


def threat_type_of(description: str) -> str:
    """Threat type implied by a rule description; ``jailbreak_attempt`` when no keyword occurs."""
    words = description.lower()
    hits = (kind for kind, keys in _TYPE_KEYWORDS if any(k in words for k in keys))
    return next(hits, "jailbreak_attempt")


# ``needs`` holds literals without which a pattern cannot match: one of every group must occur in the
# lowered text. Literal search is some ten times cheaper than a regex, so most texts never reach the
# regex. It only saves work: an empty ``needs`` gives the same results.
Needs = tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class RegexRule:
    pattern: str
    severity: str
    description: str
    needs: Needs = ()

    @property
    def threat_type(self) -> str:
        return threat_type_of(self.description)

    @property
    def weight(self) -> float:
        return SEVERITY_WEIGHT[self.severity]


@dataclass(frozen=True)
class PiiRule:
    name: str
    pattern: str
    action: str = "flag"
    replacement: str | None = None
    # A cheaper pattern without which this one cannot match; saves work only, as ``needs`` does.
    hint: str | None = None

    @property
    def redaction(self) -> str:
        return self.replacement or f"[{self.name.upper()} REDACTED]"


@dataclass(frozen=True)
class LeakRule:
    pattern: str
    description: str
    needs: Needs = ()


@dataclass(frozen=True)
class TextPattern:
    pattern: str
    needs: Needs = ()


# Phrases that are blocked wherever they occur, in any letter case.
BLOCKED_PHRASES = (
    "ignore previous instructions",
    "ignore all previous",
    "ignore above instructions",
    "disregard previous",
    "disregard all previous",
    "forget previous instructions",
    "forget your instructions",
    "override your instructions",
    "bypass your instructions",
    "new instructions:",
    "system prompt:",
    "you are now",
    "pretend you are",
    "act as if",
    "roleplay as",
    "jailbreak",
    "DAN mode",
    "developer mode",
    "ignore safety",
    "ignore restrictions",
    "ignore guidelines",
    "reveal your prompt",
    "show your instructions",
    "print your system",
    "output your rules",
    "what are your instructions",
    "repeat the above",
    "repeat everything above",
    "echo your prompt",
)

# Injection patterns with severity and description.
INJECTION_RULES = (
    RegexRule(
        r"(?i)(ignore|disregard|forget|override|bypass)\s*(all\s*)?(previous|above|prior|earlier|system|safety|security)",
        "critical",
        "Instruction override attempt",
        (("ignore", "disregard", "forget", "override", "bypass"), ("previous", "above", "prior", "earlier", "system", "safety", "security")),
    ),
    RegexRule(
        r"(?i)(you\s+are\s+now|pretend\s+(to\s+be|you\s+are)|act\s+as\s+(if|though)|roleplay\s+as)",
        "high",
        "Role manipulation attempt",
        (("now", "pretend", "act", "roleplay"), ("you", "to", "as")),
    ),
    RegexRule(
        r"(?i)(reveal|show|print|output|display|echo|repeat)\s*(your|the|system)?\s*(prompt|instructions|rules|guidelines)",
        "critical",
        "System prompt extraction attempt",
        (("reveal", "show", "print", "output", "display", "echo", "repeat"), ("prompt", "instructions", "rules", "guidelines")),
    ),
    RegexRule(
        r"(?i)(exec|eval|import\s+os|subprocess|system\(|shell_exec|`.*`)",
        "critical",
        "Code execution attempt",
        (("exec", "eval", "import", "subprocess", "system(", "`"),),
    ),
    RegexRule(
        r"(?i)(base64|rot13|hex\s*encode|url\s*encode).*instruction",
        "high",
        "Encoding bypass attempt",
        (("base64", "rot13", "hex", "url"), ("instruction",)),
    ),
    RegexRule(
        r"<\|.*\|>|<<.*>>|\[\[.*\]\]",
        "medium",
        "Potential tag injection",
        (("<|", "<<", "[["), ("|>", ">>", "]]")),
    ),
    RegexRule(
        r"(?i)(what|tell|show|reveal)\s*(is|me|are)?\s*(your|the)?\s*(system|initial|original|hidden)",
        "high",
        "Prompt leaking attempt",
        (("what", "tell", "show", "reveal"), ("system", "initial", "original", "hidden")),
    ),
)

# Terms that only raise a warning.
WARNING_TERMS = (
    "administrator",
    "sudo",
    "root access",
    "unlimited",
    "no restrictions",
    "full access",
)

# Words counted for the instruction-density heuristic.
INSTRUCTION_WORDS = ("must", "always", "never", "ignore", "forget", "instead")

# Fake conversation markers, tried in this order.
_SPEAKER = (("user:", "assistant:", "system:", "human:", "ai:"),)
CONVERSATION_MARKERS = (
    TextPattern(r"(?i)^(user|assistant|system|human|ai):\s*", _SPEAKER),
    TextPattern(r"(?i)\n(user|assistant|system|human|ai):\s*", _SPEAKER),
    TextPattern(
        r"(?i)<\|?(user|assistant|system|im_start|im_end)\|?>",
        (("<",), (">",), ("user", "assistant", "system", "im_start", "im_end")),
    ),
)
SYSTEM_SIMULATION = TextPattern(
    r"(?i)^system\s*prompt|system\s*message|<system>",
    (("system",), ("prompt", "message", "<system>")),
)

# Personal-data patterns, applied in this order.
PII_RULES = (
    PiiRule("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "redact", "[SSN REDACTED]", r"\d{3}-\d"),
    PiiRule("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "redact", "[CARD REDACTED]", r"\d{4}"),
    PiiRule("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", hint="@"),
    PiiRule("phone", r"\b(?:\+\d{1,2}\s?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", hint=r"\d{3}"),
    PiiRule("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", hint=r"\d\.\d"),
)

# Outputs that are blocked outright.
BLOCKED_OUTPUTS = (
    LeakRule(
        r"(?i)here\s+(is|are)\s+(my|the)\s+(system|initial)\s+(prompt|instructions)",
        "System prompt leak",
        (("here",), ("prompt", "instructions")),
    ),
    LeakRule(
        r"(?i)(password|secret|api.?key|token)\s*[:=]\s*\S+",
        "Credential leak",
        (("password", "secret", "api", "token"), (":", "=")),
    ),
)

# Credential shapes that raise one warning each.
CREDENTIAL_RULES = (
    LeakRule(r"""(?i)api[_-]?key\s*[=:]\s*['"]?[\w-]{20,}""", "Potential API key", (("api",), ("key",))),
    LeakRule(r"""(?i)password\s*[=:]\s*['"]?[^\s'"]{8,}""", "Potential password", (("password",),)),
    LeakRule(r"""(?i)secret\s*[=:]\s*['"]?[\w-]{16,}""", "Potential secret", (("secret",),)),
    LeakRule(r"""(?i)token\s*[=:]\s*['"]?[\w.-]{20,}""", "Potential token", (("token",),)),
    LeakRule(r"(?i)bearer\s+[\w.-]{20,}", "Potential bearer token", (("bearer",),)),
)

# Phrases of an answer that talks about its own instructions.
DISCLOSURE_PATTERNS = (
    TextPattern(r"(?i)my (system )?instructions (are|say|tell)", (("instructions ",),)),
    TextPattern(r"(?i)i was (programmed|instructed|told) to", (("i was ",),)),
    TextPattern(r"(?i)my (initial|original|base) prompt", ((" prompt",),)),
)


@dataclass(frozen=True)
class RuleSet:
    blocked_phrases: tuple[str, ...] = BLOCKED_PHRASES
    injection_rules: tuple[RegexRule, ...] = INJECTION_RULES
    warning_terms: tuple[str, ...] = WARNING_TERMS
    conversation_markers: tuple[TextPattern, ...] = CONVERSATION_MARKERS
    system_simulation: TextPattern | None = SYSTEM_SIMULATION
    pii_rules: tuple[PiiRule, ...] = PII_RULES
    blocked_outputs: tuple[LeakRule, ...] = BLOCKED_OUTPUTS
    credential_rules: tuple[LeakRule, ...] = CREDENTIAL_RULES
    disclosure_patterns: tuple[TextPattern, ...] = DISCLOSURE_PATTERNS

    def with_injection_rule(
        self, spark: SparkSession, pattern: str, severity: str, description: str
    ) -> "RuleSet":
        """Copy with one more injection rule; ``ValueError`` if Spark cannot use the pattern."""
        if severity not in SEVERITY_WEIGHT:
            raise ValueError(f"Unknown severity: {severity}")
        compile_check(spark, pattern, ignore_case=True, multiline=True)
        rule = RegexRule(pattern, severity, description)
        return replace(self, injection_rules=self.injection_rules + (rule,))

    def with_pii_rule(
        self,
        spark: SparkSession,
        name: str,
        pattern: str,
        action: str = "flag",
        replacement: str | None = None,
    ) -> "RuleSet":
        """Copy with one more personal-data rule; ``ValueError`` on a bad pattern or action."""
        if action not in ("redact", "flag", "block"):
            raise ValueError(f"Unknown action: {action}")
        compile_check(spark, pattern)
        rule = PiiRule(name, pattern, action, replacement)
        return replace(self, pii_rules=self.pii_rules + (rule,))


REPAIRED = RuleSet()

SHIPPED = RuleSet(
    conversation_markers=(CONVERSATION_MARKERS[0], CONVERSATION_MARKERS[2]),
    system_simulation=None,
    pii_rules=tuple(r for r in PII_RULES if r.name not in ("credit_card", "phone")),
    blocked_outputs=(
        BLOCKED_OUTPUTS[0],
        LeakRule(r"(?i)(password|secret|api. ? key|token)\s*[: =]\s*\S+", "Credential leak"),
    ),
    credential_rules=(
        LeakRule(r"""(?i)api[_-]? key\s*[=: ]\s*['"]?[\w-]{20,}""", "Potential API key"),
    )
    + CREDENTIAL_RULES[1:],
    disclosure_patterns=DISCLOSURE_PATTERNS[:2],
)


@dataclass(frozen=True)
class InputLimits:
    """Limits on prompts and documents."""

    max_prompt_length: int = 10000
    max_document_size_mb: float = 50
    max_documents_per_request: int = 20
    allowed_mime_types: tuple[str, ...] = (
        "application/pdf",
        "image/png",
        "image/jpeg",
        "image/webp",
        "image/gif",
        "text/plain",
        "text/markdown",
        "text/html",
        "text/csv",
        "application/json",
        "audio/mpeg",
        "audio/wav",
        "video/mp4",
        "video/webm",
    )


@dataclass(frozen=True)
class RateLimits:
    """Per-user limits. ``requests_per_hour`` (500 in the configuration) is declared but
    never enforced, so it is off unless a number is given."""

    enabled: bool = True
    requests_per_minute: int = 60
    tokens_per_minute: int = 100_000
    concurrent_requests: int = 10
    requests_per_hour: int | None = None


@dataclass(frozen=True)
class AuditOptions:
    """Audit switches; ``log_outputs`` is accepted for completeness and has no effect."""

    enabled: bool = True
    log_inputs: bool = True
    log_outputs: bool = True
    log_blocked_requests: bool = True
    sensitive_field_masking: bool = True
    retention_days: int = 90


@dataclass(frozen=True)
class Settings:
    """Everything a screening pipeline needs, with the defaults in force."""

    rules: RuleSet = field(default_factory=RuleSet)
    limits: InputLimits = field(default_factory=InputLimits)
    rates: RateLimits = field(default_factory=RateLimits)
    audit: AuditOptions = field(default_factory=AuditOptions)
    sensitivity: str = "high"
    detect_enabled: bool = True
    filter_enabled: bool = True
