"""Plain-Python row models of the operators, written from the operator descriptions.

They are the yardstick for random-text tests; nothing in the package uses them.
"""

import html
import math
import re
import unicodedata
from collections import Counter

from docwarden import rules as R

WEIGHT = {"low": 0.2, "medium": 0.4, "high": 0.7, "critical": 1.0}


def injection(text, rules=R.REPAIRED, sensitivity="high"):
    """(is_safe, score, [(type, severity, matched, start, end, confidence)], warnings)."""
    norm = text.lower().strip()
    found, warns = [], []
    for p in (p.lower() for p in rules.blocked_phrases):
        at = norm.find(p)
        if at >= 0:
            found.append(("instruction_override", "critical", p, at, at + len(p), 1.0))
    for r in rules.injection_rules:
        for m in re.finditer(r.pattern, text, re.I | re.M):
            found.append((R.threat_type_of(r.description), r.severity, m[0], *m.span(), 1.0))
    warns += [f"Suspicious term detected: '{t}'" for t in rules.warning_terms if t in norm]
    if any(ord(c) < 32 and c not in "\t\n\r" for c in text):
        found.append(("encoding_bypass", "high", "[control characters]", None, None, 1.0))
    plain = set(".,!?;:'\"()-")
    special = sum(
        not (c in plain or c.isspace() or (c.isascii() and c.isalnum())) for c in text
    )
    ratio = special / (len(text) or 1)
    if ratio > 0.3:
        found.append(
            ("encoding_bypass", "medium", f"special_char_ratio={ratio:.2f}", None, None, min(1.0, 2 * ratio))
        )
    if text.count("`" * 3) > 6 or text.count("-" * 3) > 10:
        found.append(("context_manipulation", "medium", "[excessive formatting]", None, None, 1.0))
    words = sum(text.lower().count(w) for w in R.INSTRUCTION_WORDS)
    if words > 5:
        found.append(
            ("instruction_override", "medium", f"instruction_word_count={words}", None, None, min(words / 10, 1.0))
        )
    n = len(text)
    if n > 50:
        bits = sum(-k / n * math.log2(k / n) for k in Counter(text).values())
        if bits > 5.5:
            warns.append(f"High text entropy ({bits:.2f}) - possible encoded content")
    if re.search(R"[A-Za-z0-9+/]{50,}", text):
        warns.append("Potential base64 encoded content detected")
    marker = next((m.pattern for m in rules.conversation_markers if re.search(m.pattern, text)), None)
    if marker:
        found.append(("context_manipulation", "high", marker, None, None, 1.0))
    if rules.system_simulation and re.search(rules.system_simulation.pattern, text):
        found.append(("context_manipulation", "critical", "system prompt simulation", None, None, 1.0))
    x = sum(WEIGHT[f[1]] * f[5] for f in found) + 0.1 * len(warns)
    score = min(1.0, 1 - math.exp(-x))
    block, warn = {"low": (0.8, 0.6), "medium": (0.6, 0.4), "high": (0.4, 0.2)}.get(sensitivity, (0.6, 0.4))
    if warn <= score < block:
        warns.append(f"Elevated risk score: {score:.2f}")
    return score < block, score, found, warns


def filtered(text, rules=R.REPAIRED, redact=True, leaks=True):
    """(is_safe, filtered, [(type, value, start, end)], blocked, warnings, modified)."""
    blocked = [r.description for r in rules.blocked_outputs if leaks and re.search(r.pattern, text, re.I)]
    if blocked:
        return False, "[OUTPUT BLOCKED:  Security policy violation detected]", [], blocked, [], True
    pii, warns, modified = [], [], False
    for r in rules.pii_rules:
        hits = list(re.finditer(r.pattern, text))[::-1]
        pii += [(r.name, m[0], *m.span()) for m in hits]
        if r.action == "flag":
            warns += [f"PII detected ({r.name}): position {m.start()}-{m.end()}" for m in hits]
        if redact and r.action == "redact" and hits:
            modified = True
            text = re.sub(r.pattern, lambda m, r=r: r.redaction, text)
    warns += [f"{r.description} detected in output" for r in rules.credential_rules if re.search(r.pattern, text)]
    if any(re.search(p.pattern, text) for p in rules.disclosure_patterns):
        warns.append("Potential system prompt disclosure detected")
    return True, text, pii, [], warns, modified


def sanitized(text, limit=10000, strip_html=True, whitespace=True):
    """(value, modifications, warnings)."""
    mods, now = [], text

    def step(new, label):
        nonlocal now
        if new != now:
            mods.append(label)
        now = new

    step(now[:limit], f"Truncated from {len(text)} to {limit} characters")
    warns = ["Input was truncated to maximum length"] if mods else []
    step(unicodedata.normalize("NFKC", now), "Normalized unicode characters")
    step("".join(c for c in now if c in "\t\n\r" or not (ord(c) < 32 or ord(c) == 127)), "Removed control characters")
    if strip_html:
        step(html.escape(now), "Escaped HTML entities")
    if whitespace:
        now = re.sub(r"\r\n?", "\n", now)
        now = "\n".join(re.sub(r"\s+", " ", line).rstrip() for line in now.split("\n"))
        if now != text:
            mods.append("Normalized whitespace")
    return now.strip(), mods, warns


def admitted(rows, rpm=60, tpm=100_000, active_limit=10, rph=None, window=60_000_000):
    """Sequential admission over (user, ts_us, kind, seq, tokens) rows: {seq: (allowed, message)}."""
    out, log, active = {}, {}, Counter()
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2] != "release", r[3]))
    for user, ts, kind, seq, tokens in order:
        if kind == "release":
            active[user] = max(0, active[user] - 1)
            out[seq] = (None, None)
            continue
        past = log.setdefault(user, [])
        recent = [(t, k) for t, k in past if t > ts - window]
        if active[user] >= active_limit:
            out[seq] = (False, f"Concurrent request limit ({active_limit}) exceeded")
        elif len(recent) >= rpm:
            out[seq] = (False, f"Rate limit ({rpm}/min) exceeded")
        elif rph is not None and sum(t > ts - 3_600_000_000 for t, _ in past) >= rph:
            out[seq] = (False, f"Rate limit ({rph}/hour) exceeded")
        elif sum(max(k, 0) for _, k in recent) + tokens > tpm:
            out[seq] = (False, f"Token limit ({tpm}/min) exceeded")
        else:
            past.append((ts, tokens))
            active[user] += 1
            out[seq] = (True, None)
    return out
