"""The recognizers: what each finds, with which priority, and what must hold of a match."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

#: The entity types, in the order of reports.
ENTITY_TYPES = ("SECRET", "CREDIT_CARD", "SSN", "EMAIL", "PHONE", "IP_ADDRESS", "URL", "DOB", "ADDRESS", "PERSON", "ID", "IBAN", "MODEL_PRIVATE")

PROFILES = ("broad", "transcript")
EXTERNAL_PRIORITY = 85


@dataclass(frozen=True)
class Recognizer:
    """value is the span; before and after must stand around it. flags: pattern flags. transcript: whether the
    transcript profile runs it. gate: (kind, argument) of a cheap test that every text with a match passes: has (a string),
    like (a pattern) or words (any of some strings, separated by |, in the text in lower case)."""

    name: str
    entity: str
    priority: int
    value: str
    before: str = ""
    after: str = ""
    flags: str = ""
    valid: str = ""
    transcript: bool = True
    gate: tuple[str, str] | None = None

    @property
    def pattern(self) -> str:
        """Group 1 is what stands before the value, group 2 the value."""
        return f"{self.flags}({self.before})({self.value}){self.after}"


# Patterns and priorities.
_LINK = r"\s*(?:is|:|=)?\s*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_SECRET_WORDS = r"\b(?:api[_-]?key|secret|access[_-]?token|auth[_-]?token|token|password|passwd|pwd|bearer)\b"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl"
_NAMED = r"\b(?:my name is|customer name is|patient name is|user name is|full name is|name\s*[:=]|called)\s+"
_ACCOUNTS = r"\b(?:account|acct|claim|policy|member|customer id|customer number|case|patient id)\s*(?:number|no\.?|#|id)?"
_PROJECTS = r"\b(?:[Ii]nternal\s+)?(?:[Cc]odename|[Cc]ode name|[Pp]roject|[Pp]rogram|[Ss]ystem name|[Aa]pp name|[Aa]pplication name)"
RECOGNIZERS = (
    Recognizer("private_key", "SECRET", 120, r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", flags="(?s)", gate=("has", "PRIVATE KEY-----")),
    Recognizer("jwt", "SECRET", 110, r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b", gate=("has", "eyJ")),
    Recognizer("cloud_key", "SECRET", 110, r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", gate=("like", "AKIA|ASIA")),
    Recognizer("key_sk", "SECRET", 110, r"\bsk-(?:proj-)?[A-Za-z0-9_\-]{20,}\b", gate=("has", "sk-")),
    Recognizer("key_sk_ant", "SECRET", 110, r"\bsk-ant-[A-Za-z0-9_\-]{20,}\b", gate=("has", "sk-ant-")),
    Recognizer("git_token", "SECRET", 110, r"(?:\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{30,}\b|\bgithub_pat_[A-Za-z0-9_]{50,}\b)", gate=("like", "gh[pousr]_|github_pat_")),
    Recognizer("chat_token", "SECRET", 110, r"\bxox[baprs]-[A-Za-z0-9\-]{20,}\b", gate=("has", "xox")),
    Recognizer("maps_key", "SECRET", 110, r"\bAIza[0-9A-Za-z_\-]{30,}\b", gate=("has", "AIza")),
    Recognizer("secret_context", "SECRET", 108, r"[A-Za-z0-9_\-./+=]{8,}", _SECRET_WORDS + r"\s*[:=]?\s*[\"']?", r"[\"']?", "(?i)", gate=("words", "api|secret|token|passw|pwd|bearer")),
    Recognizer("bearer", "SECRET", 108, r"[A-Za-z0-9_\-./+=]{16,}", r"\bBearer\s+", r"\b", "(?i)", gate=("words", "bearer")),
    Recognizer("card", "CREDIT_CARD", 95, r"\b(?:\d[ -]*?){13,19}\b", valid="card", gate=("like", "[0-9](?:[ -]*[0-9]){12}")),
    Recognizer("iban", "IBAN", 94, r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", flags="(?i)", valid="iban", gate=("like", "[0-9]{2}")),
    Recognizer("ssn", "SSN", 90, r"\b\d{3}-?\d{2}-?\d{4}\b", valid="ssn", transcript=False, gate=("like", "[0-9]{3}")),
    Recognizer("email", "EMAIL", 80, r"\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b", flags="(?i)", gate=("has", "@")),
    Recognizer("url_query", "URL", 88, r"https?://[^\s\"'<>]+\?[^\s\"'<>]+", gate=("has", "://")),
    Recognizer("ipv4", "IP_ADDRESS", 70, rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b", gate=("like", r"[0-9]\.[0-9]")),
    Recognizer("ipv6", "IP_ADDRESS", 70, r"\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\b", flags="(?i)", gate=("has", ":")),
    Recognizer("phone_context", "PHONE", 66, r"\+?[0-9][0-9().\-\s]{6,}[0-9]", r"\b(?:phone|mobile|cell|tel|telephone|call)" + _LINK, r"\b", "(?i)", "phone", gate=("like", "[0-9]")),
    Recognizer("dob_context", "DOB", 64, r"(?:[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})", r"\b(?:dob|date of birth|born)" + _LINK, r"\b", "(?i)", gate=("like", "[0-9][/-][0-9]")),
    Recognizer("address", "ADDRESS", 62, rf"[0-9]{{1,6}}\s+[A-Za-z0-9 .'\-]{{2,60}}\s+(?:{_STREETS})\b(?:[.,]?\s*[A-Za-z .'\-]{{2,40}})?", r"\b(?:address|mailing address|home address|ship(?:ping)? address)" + _LINK, flags="(?i)", gate=("like", "[0-9]")),
    Recognizer("phone", "PHONE", 65, r"\b(?:\+?\d{1,3}[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-]?)\d{3}[\s.\-]?\d{4}\b", valid="phone", transcript=False, gate=("like", "[0-9]{4}")),
    Recognizer("id_context", "ID", 61, r"[A-Za-z0-9][A-Za-z0-9\-]{4,}", _ACCOUNTS + _LINK, r"\b", "(?i)", transcript=False, gate=("words", "account|acct|claim|policy|member|customer|case|patient")),
    Recognizer("project_context", "MODEL_PRIVATE", 60, r"[A-Z][A-Za-z0-9_-]+(?:\s+[A-Z][A-Za-z0-9_-]+){0,3}", _PROJECTS + r"\s*(?:is|:|=)?\s+", r"\b", transcript=False, gate=("words", "odename|ode name|roject|rogram|ystem name|pp name|pplication name")),
    Recognizer("person", "PERSON", 55, r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}", _NAMED, r"\b", "(?i)", "person", gate=("words", "name|called")),
)

# Words near a card, and words that make a transcript's secret a false positive.
CARD_TERMS = ("credit card", "card number", "card:", "card ", "cc number", "payment card", "visa", "mastercard", "amex")
BENIGN_SECRETS = ("token-classification", "secretmanager", "secret-manager", "secret-store", "secret_store", "secret files", "secret-file", "secrets)")
KEYWORD_PLACES = ("pipeline", "type", "path", "file")

# Characters seen before and after a card or a secret.
CARD_WINDOW, SECRET_WINDOW = (80, 40), (48, 48)

# Labels of model findings; all others are MODEL_PRIVATE.
MODEL_LABELS = {
    "private_email": "EMAIL", "email": "EMAIL",
    "private_phone": "PHONE", "phone": "PHONE", "phone_number": "PHONE",
    "private_person": "PERSON", "person": "PERSON", "name": "PERSON",
    "private_address": "ADDRESS", "address": "ADDRESS", "location": "ADDRESS",
    "private_ip": "IP_ADDRESS", "ip": "IP_ADDRESS", "ip_address": "IP_ADDRESS",
    "private_url": "URL", "url": "URL",
    "private_credential": "SECRET", "credential": "SECRET", "secret": "SECRET", "password": "SECRET",
    "private_id": "ID", "id": "ID",
}

BY_NAME = {r.name: r for r in RECOGNIZERS}


def profile_of(name: str | None, strict: bool = False) -> str:
    """A profile by its name. Unknown names are broad; with strict, an empty one is transcript and others raise."""
    name = (name or "").strip().lower()
    if strict:
        name = name or "transcript"
        if name not in PROFILES:
            raise ValueError(f"unknown profile {name!r}")
        return name
    return name if name in PROFILES else "broad"


def entities_of(names: str | Sequence[str] | None, every: bool = False) -> tuple[str, ...]:
    """Entity types from a list or a comma-separated text; IP stands for IP_ADDRESS; nothing, or ALL, for no
    restriction. every: ALL means each type, as it does in a list of types that aren't wanted."""
    parts = names.split(",") if isinstance(names, str) else list(names or ())
    found = [{"IP": "IP_ADDRESS"}.get(p.strip().upper(), p.strip().upper()) for p in parts if p.strip()]
    if "ALL" in found:
        return ENTITY_TYPES if every else ()
    if unknown := [f for f in found if f not in ENTITY_TYPES]:
        raise ValueError(f"unknown entity types {unknown}")
    return tuple(dict.fromkeys(found))
